"""Exact robust statistics; quantiles interpolate linearly and are never approximate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from furrow.functions.boxes import finite
from furrow.storage import checkpointed

SUMMARY = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


def quantile_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Minimum, 5, 25, 50, 75, 95 % and maximum of the finite values, nulls where there are none."""
    q = F.percentile(F.when(finite(F.col(value)), F.col(value)), F.array(*[F.lit(p) for p in SUMMARY]))
    return df.groupBy(*by).agg(q.alias("_q")).select(*by, *[F.get("_q", F.lit(i)).alias(f"p{int(p * 100)}") for i, p in enumerate(SUMMARY)])


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str, order: list[str]) -> DataFrame:
    """The lower weighted median: the first value at which the summed weights reach half of all. Weights are 1e-6 at least."""
    w = F.greatest(F.col(weight), F.lit(1e-6))
    running = W.partitionBy(*by).orderBy(value, *order).rowsBetween(W.unboundedPreceding, 0)
    held = df.withColumn("_w", w).withColumn("_run", F.sum("_w").over(running)).withColumn("_all", F.sum("_w").over(W.partitionBy(*by)))
    return held.where(F.col("_run") >= 0.5 * F.col("_all")).groupBy(*by).agg(F.min(value).alias("weighted_median"))


def robust_spacing(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Spacing as the median of values up to their 65 % quantile, confidence as 1 - 1.4826 MAD / spacing within 0..1."""
    good = df.where(finite(F.col(value)) & (F.col(value) > 0))
    cut = good.groupBy(*by).agg(F.percentile(value, 0.65).alias("_cut"))
    base = good.join(cut, by).where(F.col(value) <= F.col("_cut"))
    mid = base.groupBy(*by).agg(F.median(value).alias("spacing"))
    mad = base.join(mid, by).groupBy(*by, "spacing").agg(F.median(F.abs(F.col(value) - F.col("spacing"))).alias("mad"))
    share = 1 - 1.4826 * F.col("mad") / F.greatest(F.col("spacing"), F.lit(1e-9))
    return mad.withColumn("confidence", F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def axial_peak(df: DataFrame, by: list[str], degrees: str, distance: str, width: float = 2.0, near: float = 8.0) -> DataFrame:
    """Peak of the histogram of angles mod 180 weighted by 1/distance (the lower bin of equals), and the axial mean of the angles near its middle."""
    bins = int(180 / width)
    theta = F.pmod(F.col(degrees), F.lit(180.0))
    weight = 1 / F.greatest(F.col(distance), F.lit(1e-9))
    held = df.withColumn("_theta", theta).withColumn("_w", weight).withColumn("_bin", F.least(F.floor(F.col("_theta") / width), F.lit(bins - 1)))
    hist = held.groupBy(*by, "_bin").agg(F.round(F.sum("_w"), 9).alias("_sum"))
    peak = hist.groupBy(*by).agg(F.max_by("_bin", F.struct("_sum", -F.col("_bin"))).alias("peak_bin"), F.max("_sum").alias("peak_weight"), F.sum("_sum").alias("total_weight"))
    off = F.abs(F.pmod(F.col("_theta") - (F.col("peak_bin") + 0.5) * width + 90, F.lit(180.0)) - 90)
    close = held.join(peak, by).where(off <= near)
    rad = F.radians(2 * F.col("_theta"))
    mean = F.pmod(F.degrees(F.atan2(F.sum(F.col("_w") * F.sin(rad)), F.sum(F.col("_w") * F.cos(rad)))) / 2, F.lit(180.0))
    return close.groupBy(*by, "peak_bin", "peak_weight", "total_weight").agg(mean.alias("orientation_deg"))


def similarity(df: DataFrame, by: list[str], sx: str, sy: str, tx: str, ty: str) -> DataFrame:
    """Least-squares rotation, scale and shift of (sx, sy) onto (tx, ty), from sums alone: target = [a -b; b a] source + shift."""
    s = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in (sx, sy, tx, ty)],
        F.sum(F.col(sx) * F.col(tx) + F.col(sy) * F.col(ty)).alias("_dot"), F.sum(F.col(sx) * F.col(ty) - F.col(sy) * F.col(tx)).alias("_cross"),
        F.sum(F.col(sx) * F.col(sx) + F.col(sy) * F.col(sy)).alias("_norm"),
    )
    m = lambda c: F.col(f"m_{c}")
    norm = F.col("_norm") - F.col("n") * (m(sx) * m(sx) + m(sy) * m(sy))
    a = (F.col("_dot") - F.col("n") * (m(sx) * m(tx) + m(sy) * m(ty))) / F.when(norm > 0, norm)
    b = (F.col("_cross") - F.col("n") * (m(sx) * m(ty) - m(sy) * m(tx))) / F.when(norm > 0, norm)
    out = s.withColumn("a", a).withColumn("b", b)
    return out.select(
        *by, "n", "a", "b", (m(tx) - F.col("a") * m(sx) + F.col("b") * m(sy)).alias("shift_x"), (m(ty) - F.col("b") * m(sx) - F.col("a") * m(sy)).alias("shift_y"),
        F.hypot("a", "b").alias("scale"), F.degrees(F.atan2("b", "a")).alias("rotation_deg"),
    )


def without_outliers(df: DataFrame, by: list[str], sx: str, sy: str, tx: str, ty: str, rounds: int = 5) -> DataFrame:
    """Rows that stay after up to ``rounds`` fits: residual at most max(0.5, median + 3.5 x 1.4826 MAD), groups under 3 rows untouched."""
    for _ in range(rounds):
        fit = similarity(df, by, sx, sy, tx, ty).select(*by, "n", "a", "b", "shift_x", "shift_y")
        held = df.join(fit, by)
        px = F.col("a") * F.col(sx) - F.col("b") * F.col(sy) + F.col("shift_x")
        py = F.col("b") * F.col(sx) + F.col("a") * F.col(sy) + F.col("shift_y")
        held = held.withColumn("_r", F.round(F.hypot(px - F.col(tx), py - F.col(ty)), 9))
        mid = held.groupBy(*by).agg(F.median("_r").alias("_m"))
        held = held.join(mid, by)
        mad = held.groupBy(*by).agg(F.median(F.abs(F.col("_r") - F.col("_m"))).alias("_mad"))
        held = held.join(mad, by)
        limit = F.greatest(F.lit(0.5), F.col("_m") + 3.5 * 1.4826 * F.col("_mad"))
        df = checkpointed(held.where((F.col("_r") <= limit) | (F.col("n") < 3)).select(*df.columns))
    return df


def axis_ratio(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Ratio of the smaller to the larger principal standard deviation, by the closed form of 2x2 eigenvalues."""
    s = df.groupBy(*by).agg(F.var_pop(x).alias("_a"), F.var_pop(y).alias("_c"), F.covar_pop(x, y).alias("_b"))
    root = F.sqrt(F.pow((F.col("_a") - F.col("_c")) / 2, F.lit(2.0)) + F.col("_b") * F.col("_b"))
    mid = (F.col("_a") + F.col("_c")) / 2
    return s.select(*by, F.sqrt(F.greatest(mid - root, F.lit(0.0)) / F.when(mid + root > 0, mid + root)).alias("axis_ratio"))


def path_progress(df: DataFrame, by: list[str], order: str, x: str, y: str, slack: float = 0.05) -> DataFrame:
    """(by, axis_ratio, progress, reversals): the way made along a path's main axis, which points from its first row to its last, and how often a step goes back by more than ``slack``."""
    m = df.groupBy(*by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), (F.atan2(2 * F.covar_pop(x, y), F.var_pop(x) - F.var_pop(y)) / 2).alias("_angle"))
    held = df.join(m, by).withColumn("_p", (F.col(x) - F.col("_mx")) * F.cos("_angle") + (F.col(y) - F.col("_my")) * F.sin("_angle"))
    step = F.col("_p") - F.lag("_p").over(W.partitionBy(*by).orderBy(order))
    out = held.withColumn("_step", step).groupBy(*by).agg(
        (F.max_by("_p", order) - F.min_by("_p", order)).alias("_net"), F.count_if(F.col("_step") < -slack).alias("_back"), F.count_if(F.col("_step") > slack).alias("_on")
    )
    turned = F.col("_net") < 0
    out = out.select(*by, F.abs("_net").alias("progress"), F.when(turned, F.col("_on")).otherwise(F.col("_back")).alias("reversals"))
    return axis_ratio(df, by, x, y).join(out, by)


def fill_rates(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, field, filled, rate) for each column: how many rows have a value."""
    s = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    return s.unpivot([*by, "_n"], columns, "field", "filled").select(*by, "field", "filled", (F.col("filled") / F.col("_n")).alias("rate"))


def steps(df: DataFrame, by: list[str], order: str, x: str, y: str) -> DataFrame:
    """Add ``step``, the distance from the row before; null on the first."""
    w = W.partitionBy(*by).orderBy(order)
    return df.withColumn("step", F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)))


def direction_cosine(df: DataFrame, by: list[str], order: str, a: tuple[str, str], b: tuple[str, str], least: float = 0.01) -> DataFrame:
    """Add ``cosine`` between the steps of two paths, null unless both steps are longer than ``least``."""
    w = W.partitionBy(*by).orderBy(order)
    d = lambda c: F.col(c) - F.lag(c).over(w)
    held = df.select("*", d(a[0]).alias("_ax"), d(a[1]).alias("_ay"), d(b[0]).alias("_bx"), d(b[1]).alias("_by"))
    la, lb = F.hypot("_ax", "_ay"), F.hypot("_bx", "_by")
    cosine = F.when((la > least) & (lb > least), (F.col("_ax") * F.col("_bx") + F.col("_ay") * F.col("_by")) / (la * lb))
    return held.withColumn("cosine", cosine).drop("_ax", "_ay", "_bx", "_by")


def running_median(df: DataFrame, by: list[str], order: list[str], value: str, rows: int = 120) -> DataFrame:
    """Add ``running_median``: the median of the row and the ``rows`` - 1 before it, without nulls; of rows that tie in ``order`` any may come first."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn("running_median", F.percentile(value, 0.5).over(w))


def unwrapped(df: DataFrame, by: list[str], order: str, phase: str) -> DataFrame:
    """Add ``unwrapped``: the phase (radians) without jumps of more than half a turn."""
    w = W.partitionBy(*by).orderBy(order)
    d = F.col(phase) - F.lag(phase).over(w)
    wrapped = d - 2 * F.pi() * F.floor((d + F.pi()) / (2 * F.pi()))
    held = df.withColumn("_d", F.coalesce(wrapped, F.col(phase)))
    return held.withColumn("unwrapped", F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_d")


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in a total order."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
