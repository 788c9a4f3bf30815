"""Rows of plants: expected slots, missing slots, runs of missing slots, and their summaries.

Columns: plot_id, row_id, plant_id, along, across for plants in the frame of their rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from furrow.functions.gates import gap_evidence
from furrow.operators.sync import chain_clusters
from furrow.storage import checkpointed


def expected_slots(plants: DataFrame, spacing: DataFrame) -> DataFrame:
    """Slots of each row: its plants, and between neighbours as many points as the spacing asks for, evenly spaced.

    (plot_id, row_id, slot_index, along, across); slot 0 is the row's first plant. ``spacing`` is by plot, or by row if it has row_id;
    rows without a spacing have no slots.
    """
    by = ["plot_id", "row_id"]
    w = W.partitionBy(*by).orderBy("along", "plant_id")
    keys = [c for c in by if c in spacing.columns]
    held = plants.join(spacing.select(*keys, "spacing"), keys)
    held = held.select(*by, "plant_id", "along", "across", "spacing", F.lead("along").over(w).alias("_a"), F.lead("across").over(w).alias("_c"))
    n = F.greatest(F.lit(1), F.rint(F.hypot(F.col("_a") - F.col("along"), F.col("_c") - F.col("across")) / F.col("spacing")).cast("int"))
    held = held.withColumn("_n", F.when(F.col("_a").isNotNull(), n).otherwise(0))
    run = F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    held = held.withColumn("_from", run).withColumn("_first", F.row_number().over(w) == 1)
    k = F.explode(F.sequence(F.when(F.col("_first"), 0).otherwise(1), F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.when(F.col("_first"), 0).otherwise(1))))
    held = held.where(F.col("_first") | (F.col("_n") > 0)).withColumn("_k", k)
    part = F.coalesce(F.col("_k") / F.when(F.col("_n") > 0, F.col("_n")), F.lit(0.0))
    mid = lambda c, d: F.col(c) + part * F.coalesce(F.col(d) - F.col(c), F.lit(0.0))
    return held.select(*by, (F.col("_from") + F.col("_k")).cast("long").alias("slot_index"), mid("along", "_a").alias("along"), mid("across", "_c").alias("across"))


def missing_slots(expected: DataFrame, plants: DataFrame, spacing: DataFrame, tolerance: float = 0.45) -> DataFrame:
    """Expected slots without a plant of the plot within ``tolerance`` spacings. ``spacing`` is by plot, or by row if it has row_id.

    Slots meet plants by cells of four times the plot's largest spacing; a plant goes to the cells that its tolerance reaches, one or two for most. Spark takes exploded plants for no larger than
    the file that they come from, so the join is told to shuffle them; a broadcast would send all of them through the driver.
    """
    keys = [c for c in ("plot_id", "row_id") if c in spacing.columns]
    size = spacing.groupBy("plot_id").agg(F.max("spacing").alias("_most")).withColumn("_cell", F.col("_most") * max(4.0, tolerance))
    held = expected.join(spacing.select(*keys, F.col("spacing").alias("_spacing")), keys, "left").join(size.select("plot_id", "_cell"), "plot_id", "left")
    e = held.withColumn("_ga", F.floor(F.col("along") / F.col("_cell"))).withColumn("_gc", F.floor(F.col("across") / F.col("_cell")))

    def reached(c: str) -> Column:
        far = F.col("_most") * (tolerance * (1 + 1e-9)) + F.abs(c) * 1e-15  # not less than the tolerance in doubles
        return F.explode(F.sequence(F.floor((F.col(c) - far) / F.col("_cell")), F.floor((F.col(c) + far) / F.col("_cell"))))

    p = plants.join(size, "plot_id").select("plot_id", "along", "across", "_most", "_cell").withColumn("_ga", reached("along")).withColumn("_gc", reached("across"))
    p = p.select(F.col("plot_id").alias("_plot"), F.col("along").alias("_pa"), F.col("across").alias("_pc"), F.col("_ga").alias("_pga"), F.col("_gc").alias("_pgc"))
    near = F.hypot(F.col("along") - F.col("_pa"), F.col("across") - F.col("_pc")) <= tolerance * F.col("_spacing")
    met = (F.col("plot_id") == F.col("_plot")) & (F.col("_ga") == F.col("_pga")) & (F.col("_gc") == F.col("_pgc")) & near
    return e.join(p.hint("merge"), met, "left_anti").select(*expected.columns)


def adjacent_distances(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add ``step``, the distance from each row to the next of its group; null on the last."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("step", F.hypot(F.lead("along").over(w) - F.col("along"), F.lead("across").over(w) - F.col("across")))


def runs(missing: DataFrame, by: list[str], slot: str = "slot_index") -> DataFrame:
    """Add ``run``: the same number for consecutive slots of a group."""
    w = W.partitionBy(*by).orderBy(slot)
    return missing.withColumn("run", F.col(slot) - F.row_number().over(w))


def run_members(missing: DataFrame, by: list[str], slot: str = "slot_index") -> DataFrame:
    """Add ``run`` and ``first``, the smallest slot of the run: the way back from a run to its members, by a window."""
    return runs(missing, by, slot).withColumn("first", F.min(slot).over(W.partitionBy(*by, "run")))


def gaps(missing: DataFrame) -> DataFrame:
    """One row for each run of missing slots (plot_id, row_id, slot_index, along, across, coverage_count, nearby_suspicious_count, confidence)."""
    held = runs(missing, ["plot_id", "row_id"])
    out = held.groupBy("plot_id", "row_id", "run").agg(
        F.min("slot_index").alias("start_slot"), F.max("slot_index").alias("end_slot"), F.count(F.lit(1)).alias("estimated_missing_plants"),
        F.avg("along").alias("along"), F.avg("across").alias("across"), F.min("coverage_count").alias("coverage_count"),
        F.sum("nearby_suspicious_count").alias("nearby_suspicious_count"), F.avg("confidence").alias("gap_confidence"),
    )
    return out.drop("run").withColumn("evidence_status", gap_evidence(F.col("nearby_suspicious_count"), F.col("gap_confidence")))


def plot_summary(plots: DataFrame, plants: DataFrame, expected: DataFrame, found: DataFrame, least: int = 3, lanes: DataFrame | None = None) -> DataFrame:
    """One row for each plot, those with too few plants too: counts, missing rate (null without capacity), status. Rows are counted in ``lanes`` or, without it, in ``plants``."""
    count = plants.groupBy("plot_id").agg(F.count(F.lit(1)).alias("plants"))
    p = count.join((plants if lanes is None else lanes).groupBy("plot_id").agg(F.countDistinct("row_id").alias("rows")), "plot_id", "left")
    e = expected.groupBy("plot_id").agg(F.count(F.lit(1)).alias("expected_capacity"))
    g = found.groupBy("plot_id").agg(F.count(F.lit(1)).alias("gap_count"), F.sum("estimated_missing_plants").alias("estimated_missing_plants"))
    out = plots.select("plot_id").join(p, "plot_id", "left").join(e, "plot_id", "left").join(g, "plot_id", "left")
    out = out.fillna(0, ["plants", "rows", "expected_capacity", "gap_count", "estimated_missing_plants"])
    rate = F.col("estimated_missing_plants") / F.when(F.col("expected_capacity") > 0, F.col("expected_capacity"))
    status = F.when(F.col("plants") < least, "insufficient_unique_plants").otherwise("complete_candidate_review_required")
    return out.withColumn("missing_rate", rate).withColumn("analysis_status", status)


def live_slots(plants: DataFrame, spacing: DataFrame) -> DataFrame:
    """The streaming variant: slots at whole spacings from the row's first plant, its ends left out."""
    span = plants.groupBy("plot_id", "row_id").agg(F.min("along").alias("_lo"), F.max("along").alias("_hi"), F.avg("across").alias("across"))
    span = span.join(spacing.select("plot_id", "spacing"), "plot_id").withColumn("_n", F.rint((F.col("_hi") - F.col("_lo")) / F.col("spacing")).cast("int") - 1)
    slots = span.where("_n >= 1").withColumn("slot_index", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return slots.select("plot_id", "row_id", F.col("slot_index").cast("long").alias("slot_index"), (F.col("_lo") + F.col("slot_index") * F.col("spacing")).alias("along"), "across")


def live_rows(points: DataFrame, gap: float) -> DataFrame:
    """The streaming variant of rows: chains over the across coordinate."""
    return chain_clusters(points, ["plot_id"], "across", [F.col("across"), F.col("plant_id")], gap).withColumnRenamed("cluster", "row_id")


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter cut at 4 sigma, with the ends mirrored (the end value twice)."""
    radius = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    padded = np.pad(values.astype(float), radius, mode="symmetric")
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def peaks(values: np.ndarray, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Places of local maxima (middles of plateaus), the higher first to clear ``distance``, then those of enough prominence."""
    found, i, n = [], 1, len(values)
    while i < n - 1:
        if values[i] > values[i - 1]:
            j = i
            while j + 1 < n and values[j + 1] == values[i]:
                j += 1
            if j + 1 < n and values[j + 1] < values[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    kept: list[int] = []
    for p in sorted(found, key=lambda p: (-values[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def rise(p: int) -> float:
        left = right = values[p]
        for q in range(p - 1, -1, -1):
            if values[q] > values[p]:
                break
            left = min(left, values[q])
        for q in range(p + 1, n):
            if values[q] > values[p]:
                break
            right = min(right, values[q])
        return values[p] - max(left, right)

    return np.array(sorted(p for p in kept if rise(p) >= prominence), int)


def row_bands(points: DataFrame, bin_width: float, row_spacing: float) -> DataFrame:
    """Assign (plot_id, plant_id, along, across) to rows by the peaks of the smoothed density over the across coordinate.

    The density is a histogram per plot, so what a plot's task holds grows with the plot's width and not with its plants: the
    peaks come from counted bins, and plants are joined to the nearest peak afterwards.
    """
    binned = points.withColumn("_bin", F.floor(F.col("across") / bin_width).cast("long"))
    hist = binned.groupBy("plot_id", "_bin").agg(F.count(F.lit(1)).alias("n"))

    def find(plot: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(plot["_bin"].min()), int(plot["_bin"].max())
        margin = int(np.ceil(row_spacing / bin_width))
        density = np.zeros(hi - lo + 1 + 2 * margin)
        density[plot["_bin"].to_numpy() - lo + margin] = plot["n"].to_numpy()
        smooth = smoothed(density, max(0.5, 0.15 * row_spacing / bin_width))
        at = peaks(smooth, max(1, int(0.6 * row_spacing / bin_width)), 0.1 * smooth.max())
        mid = (at + lo - margin + 0.5) * bin_width
        edges = np.concatenate([[-np.inf], (mid[1:] + mid[:-1]) / 2, [np.inf]]) if len(mid) else np.array([-np.inf, np.inf])
        return pd.DataFrame({"plot_id": plot["plot_id"].iloc[0], "row_id": np.arange(len(edges) - 1), "lo": edges[:-1], "hi": edges[1:]})

    bands = hist.groupBy("plot_id").applyInPandas(find, "plot_id long, row_id long, lo double, hi double")
    held = points.join(bands, "plot_id").where((F.col("across") >= F.col("lo")) & (F.col("across") < F.col("hi")))
    return held.drop("lo", "hi")


def split_rows(plants: DataFrame, inside: DataFrame, least: int = 2) -> DataFrame:
    """Split rows where a step leaves the area: ``inside`` holds (plot_id, row_id, plant_id, ok) of the step to the next plant.

    Adds ``segment``; segments with fewer than ``least`` plants are dropped.
    """
    w = W.partitionBy("plot_id", "row_id").orderBy("along", "plant_id")
    held = plants.join(inside, ["plot_id", "row_id", "plant_id"], "left")
    cut = F.coalesce((~F.lag("ok").over(w)).cast("int"), F.lit(0))
    held = held.withColumn("_cut", cut).withColumn("segment", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_cut", "ok")
    n = F.count(F.lit(1)).over(W.partitionBy("plot_id", "row_id", "segment"))
    return held.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def samples_between(plants: DataFrame, n: int = 21) -> DataFrame:
    """``n`` evenly spaced points on the step from each plant to the next of its row: (plot_id, row_id, plant_id, sample, x, y)."""
    w = W.partitionBy("plot_id", "row_id").orderBy("along", "plant_id")
    held = plants.withColumn("_a", F.lead("along").over(w)).withColumn("_c", F.lead("across").over(w)).where(F.col("_a").isNotNull())
    held = held.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_p", F.col("_i") / (n - 1))
    return held.select("plot_id", "row_id", "plant_id", F.col("_i").alias("sample"), (F.col("along") + F.col("_p") * (F.col("_a") - F.col("along"))).alias("x"), (F.col("across") + F.col("_p") * (F.col("_c") - F.col("across"))).alias("y"))


def row_distances(near: DataFrame, spacing: DataFrame, least: int = 5) -> DataFrame:
    """(plot_id, inter_row): the distance of rows, from steps (plot_id, along, across) between near plants that lie side by side.

    The first peak of the smoothed histogram of steps of 1.5 to 4.5 spacings across, in units; 2.6 spacings where there are fewer than ``least`` such steps or no peak.
    """
    s = F.col("spacing")
    side = near.join(spacing.select("plot_id", "spacing"), "plot_id").withColumn("_a", F.abs("along")).withColumn("_c", F.abs("across"))
    side = side.where((F.col("_a") < 0.55 * s) & (F.col("_c") > 1.5 * s) & (F.col("_c") < 4.5 * s))
    counted = side.groupBy("plot_id", "spacing", F.floor(F.col("_c") - 1.5 * s).cast("int").alias("_bin")).agg(F.count(F.lit(1)).alias("n"))

    def find(plot: pd.DataFrame) -> pd.DataFrame:
        s = float(plot["spacing"].iloc[0])
        out = 2.6 * s
        if plot["n"].sum() >= least:
            sigma, n = max(1.0, 0.12 * s), int(np.ceil(3 * s)) + 1
            pad = int(4 * sigma) + 2  # so that steps at the ends of the range make a peak too
            values = np.zeros(n + 2 * pad)
            values[plot["_bin"].to_numpy() + pad] = plot["n"].to_numpy()
            smooth = smoothed(values, sigma)
            at = peaks(smooth, max(3, round(1.2 * s)), max(1.0, 0.1 * float(np.quantile(smooth[pad : pad + n], 0.5))))
            out = 1.5 * s + at[0] - pad + 0.5 if len(at) else out
        return pd.DataFrame({"plot_id": plot["plot_id"].iloc[:1], "inter_row": [float(out)]})

    found = counted.groupBy("plot_id").applyInPandas(find, "plot_id long, inter_row double")
    return spacing.select("plot_id", "spacing").join(found, "plot_id", "left").select("plot_id", F.coalesce("inter_row", 2.6 * s).alias("inter_row"))


def straightened(points: DataFrame, scale: DataFrame, least: int = 5) -> DataFrame:
    """Add ``straight``: the across coordinate without the slow drift that all rows of a plot share.

    ``scale`` has (plot_id, spacing, inter_row). The phase of the repeated rows is averaged in 7 to 35 stretches along the rows, unwrapped, smoothed
    and interpolated. What a plot's task holds are its stretches.
    """
    span = points.groupBy("plot_id").agg(F.min("along").alias("_lo"), F.max("along").alias("_hi"))
    n = F.least(F.greatest(F.floor((F.col("_hi") - F.col("_lo")) / F.greatest(10 * F.col("spacing"), F.lit(1.0))), F.lit(7)), F.lit(35))
    span = span.join(scale, "plot_id").withColumn("_n", n).withColumn("_width", F.greatest((F.col("_hi") - F.col("_lo")) / F.col("_n"), F.lit(1e-9)))
    held = points.join(span, "plot_id").withColumn("_bin", F.least(F.floor((F.col("along") - F.col("_lo")) / F.col("_width")), F.col("_n") - 1))
    turn = F.lit(2 * np.pi) * F.col("across") / F.col("inter_row")
    bins = held.groupBy("plot_id", "_bin", "_lo", "_width", "inter_row").agg(F.count(F.lit(1)).alias("n"), F.avg(F.sin(turn)).alias("_s"), F.avg(F.cos(turn)).alias("_c")).where(F.col("n") >= least)

    def drift(plot: pd.DataFrame) -> pd.DataFrame:
        plot = plot.sort_values("_bin")
        unit = float(plot["inter_row"].iloc[0]) / (2 * np.pi)
        at, value = (plot["_lo"] + (plot["_bin"] + 0.5) * plot["_width"]).to_numpy(), np.unwrap(np.arctan2(plot["_s"], plot["_c"])) * unit
        if len(value) >= 3:
            value = smoothed(value, 1.0)
        return pd.DataFrame({"plot_id": plot["plot_id"].iloc[:1], "at": [at.tolist()], "drift": [(value if len(value) > 1 else np.zeros(1)).tolist()]})

    knots = bins.groupBy("plot_id").applyInPandas(drift, "plot_id long, at array<double>, drift array<double>")
    held = points.join(knots, "plot_id", "left")
    i = F.size(F.filter("at", lambda a: a <= F.col("along")))
    v, a = (lambda k: F.get("drift", k)), (lambda k: F.get("at", k))
    between = v(i - 1) + (F.col("along") - a(i - 1)) / (a(i) - a(i - 1)) * (v(i) - v(i - 1))
    fitted = F.coalesce(F.when(i <= 0, v(F.lit(0))).when(i >= F.size("at"), v(F.size("at") - 1)).otherwise(between), F.lit(0.0))
    held = checkpointed(held.withColumn("_drift", fitted).drop("at", "drift"))
    middle = held.groupBy("plot_id").agg(F.median("_drift").alias("_mid"))
    return held.join(middle, "plot_id").withColumn("straight", F.col("across") - F.col("_drift") + F.col("_mid")).drop("_drift", "_mid")


def reconstructed(points: DataFrame, scale: DataFrame, least: int = 5, band: float = 0.42) -> DataFrame:
    """Add ``row_id`` (1 for a plot's first row) to (plot_id, plant_id, along, across); plants outside all rows, and rows of fewer than ``least``, are left out.

    Rows are the peaks of the smoothed density over the straightened coordinate, in units; a plant belongs to the nearest one, within the
    band of 2 units, ``band`` row distances or the 99.5 % quantile of all residuals, whichever is widest.
    """
    held = straightened(points, scale, least)
    hist = held.groupBy("plot_id", F.floor("straight").cast("long").alias("_bin")).agg(F.count(F.lit(1)).alias("n")).join(scale, "plot_id")

    def find(plot: pd.DataFrame) -> pd.DataFrame:
        s, inter = float(plot["spacing"].iloc[0]), float(plot["inter_row"].iloc[0])
        pad, lo, hi = max(10, round(1.5 * s)), int(plot["_bin"].min()), int(plot["_bin"].max())
        density = np.zeros(hi - lo + 1 + 2 * pad)
        density[plot["_bin"].to_numpy() - lo + pad] = plot["n"].to_numpy()
        smooth = smoothed(density, max(1.5, 0.18 * s))
        at = peaks(smooth, max(3, round(0.65 * inter)), max(0.25, 0.15 * float(np.quantile(smooth, 0.6))))
        return pd.DataFrame({"plot_id": plot["plot_id"].iloc[:1], "rows": [(at + lo - pad + 0.5).tolist()]})

    middles = hist.groupBy("plot_id").applyInPandas(find, "plot_id long, rows array<double>")
    near = F.array_min(F.transform("rows", lambda r, i: F.struct(F.abs(F.col("straight") - r).alias("off"), i.alias("row"))))
    held = checkpointed(held.join(middles, "plot_id").withColumn("_near", near).where(F.col("_near").isNotNull()).drop("rows"))
    limit = held.groupBy("plot_id").agg(F.percentile(F.col("_near.off"), 0.995).alias("_q")).join(scale, "plot_id")
    limit = limit.select("plot_id", F.greatest(F.lit(2.0), band * F.col("inter_row"), F.col("_q")).alias("_limit"))
    held = held.join(limit, "plot_id").where(F.col("_near.off") <= F.col("_limit")).withColumn("_row", F.col("_near.row"))
    full = held.groupBy("plot_id", "_row").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    numbered = full.withColumn("row_id", F.row_number().over(W.partitionBy("plot_id").orderBy("_row")).cast("long")).select("plot_id", "_row", "row_id")
    return held.join(numbered, ["plot_id", "_row"]).drop("_near", "_limit", "_row")


def live_spacing(df: DataFrame, by: list[str], value: str, share: float = 0.65) -> DataFrame:
    """(by, spacing): the streaming variant, the median of the first ``share`` of the sorted values; groups of fewer than three have none."""
    w = W.partitionBy(*by)
    held = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    return held.where((F.col("_n") >= 3) & (F.col("_i") <= F.floor(F.col("_n") * share))).groupBy(*by).agg(F.median(value).alias("spacing"))
