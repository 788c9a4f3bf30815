"""Registration: similarities between frames from point matches of which many are wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.functions.boxes import finite
from furrow.functions.geometry import affine_metrics, inverse, rescaled
from furrow.operators import folds, fusion
from furrow.storage import checkpointed

_MODEL = ("a", "b", "tx", "ty")
_SEEDS = 8


def _error2(m: Column) -> Column:
    """Squared distance between a match's target and its source through the similarity ``m``."""
    du = m["a"] * F.col("x") - m["b"] * F.col("y") + m["tx"] - F.col("u")
    dv = m["b"] * F.col("x") + m["a"] * F.col("y") + m["ty"] - F.col("v")
    return du * du + dv * dv


def hypotheses(matches: DataFrame, by: list[str], many: int = 64) -> DataFrame:
    """(by, models): similarities through two matches each, of up to ``many`` pairs of a group, chosen by hash: the same rows give the same pairs.

    Pairs of one place are no hypothesis. Each of eight seeds orders a group by hash and takes neighbours as pairs.
    """
    each = -(-many // _SEEDS)
    point = F.struct("x", "y", "u", "v")
    drawn = matches.withColumn("_seed", F.explode(F.sequence(F.lit(1), F.lit(_SEEDS)))).withColumn("_h", F.xxhash64("_seed", "x", "y", "u", "v"))
    drawn = drawn.withColumn("_n", F.row_number().over(W.partitionBy(*by, "_seed").orderBy("_h", "x", "y", "u", "v"))).where(F.col("_n") <= 2 * each)
    pairs = drawn.groupBy(*by, "_seed", F.floor((F.col("_n") - 1) / 2).alias("_k")).agg(F.min_by(point, "_n").alias("p"), F.max_by(point, "_n").alias("q"))
    dx, dy, du, dv = (F.col(f"q.{c}") - F.col(f"p.{c}") for c in ("x", "y", "u", "v"))
    long = dx * dx + dy * dy
    a, b = (dx * du + dy * dv) / F.when(long > 1e-9, long), (dx * dv - dy * du) / F.when(long > 1e-9, long)
    model = F.struct(a.alias("a"), b.alias("b"), (F.col("p.u") - a * F.col("p.x") + b * F.col("p.y")).alias("tx"), (F.col("p.v") - b * F.col("p.x") - a * F.col("p.y")).alias("ty"))
    return pairs.where(long > 1e-9).select(*by, model.alias("m")).groupBy(*by).agg(F.sort_array(F.collect_list("m")).alias("models"))


def _refitted(matches: DataFrame, models: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by, m): least squares over the matches that agree with a group's model; sums of a group are combined in each task."""
    near = matches.join(models, by).where(_error2(F.col("m")) <= threshold * threshold)
    x, y, u, v = (F.col(c) for c in "xyuv")
    sums = {"n": F.count(F.lit(1)), "sx": F.sum(x), "sy": F.sum(y), "su": F.sum(u), "sv": F.sum(v), "xx": F.sum(x * x + y * y), "xu": F.sum(x * u + y * v), "xv": F.sum(x * v - y * u)}
    s = near.groupBy(*by).agg(*[c.alias(k) for k, c in sums.items()])
    c = F.col
    spread = c("xx") - (c("sx") * c("sx") + c("sy") * c("sy")) / c("n")
    safe = F.when(spread > 1e-9, spread)
    a = (c("xu") - (c("sx") * c("su") + c("sy") * c("sv")) / c("n")) / safe
    b = (c("xv") - (c("sx") * c("sv") - c("sy") * c("su")) / c("n")) / safe
    s = s.withColumns({"a": a, "b": b}).where("a is not null")
    return s.select(*by, F.struct("a", "b", ((c("su") - c("a") * c("sx") + c("b") * c("sy")) / c("n")).alias("tx"), ((c("sv") - c("b") * c("sx") - c("a") * c("sy")) / c("n")).alias("ty")).alias("m"))


def estimated(matches: DataFrame, by: list[str], threshold: float = 3.0, many: int = 64, rounds: int = 3) -> DataFrame:
    """Matches (by, x, y, u, v) to one row a group: (by, matrix, match_count, inlier_count, inlier_ratio, reprojection_error_p50, reprojection_error_p95, determinant, scale, rotation_deg, translation_x, translation_y).

    Hypothesise and verify: each match votes for the hypotheses that bring it within ``threshold`` of its target; votes are counted in each task, so what shuffles is a row
    for each task, group and hypothesis. The one with the most votes, and of those the smallest error, is fitted anew to its inliers ``rounds`` times. ``matrix`` is row-major,
    3 x 3; it and what follows from it are null for groups without a hypothesis (fewer than two different places). Matches without a finite place count for nothing.
    """
    good = matches.where(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("u")) & finite(F.col("v"))).select(*by, *[F.col(c).cast("double").alias(c) for c in "xyuv"])
    good = checkpointed(good)
    models = hypotheses(good, by, many)
    votes = good.join(models, by).select(*by, "x", "y", "u", "v", F.explode("models").alias("m"))
    votes = votes.withColumn("e", F.least(_error2(F.col("m")), F.lit(threshold * threshold)))
    counted = votes.groupBy(*by, "m").agg(F.count_if(F.col("e") < threshold * threshold).alias("votes"), F.sum("e").alias("e"))
    model = checkpointed(counted.groupBy(*by).agg(F.max_by("m", F.struct("votes", -F.col("e"), "m")).alias("m")))
    for _ in range(rounds):
        again = _refitted(good, model, by, threshold).withColumnRenamed("m", "_m")
        model = checkpointed(model.join(again, by, "left").select(*by, F.coalesce("_m", "m").alias("m")))
    error = F.sqrt(_error2(F.col("m")))
    inlier = error <= threshold
    m = F.col("m")
    held = good.join(model, by, "left").groupBy(*by).agg(
        F.first("m").alias("m"), F.count(F.lit(1)).alias("match_count"), F.count_if(inlier).alias("inlier_count"),
        F.percentile(F.when(inlier, error), 0.5).alias("reprojection_error_p50"), F.percentile(F.when(inlier, error), 0.95).alias("reprojection_error_p95"),
    )
    cells = [m["a"], -m["b"], m["tx"], m["b"], m["a"], m["ty"], F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    metrics = affine_metrics(cells)
    return held.select(
        *by, F.when(m.isNotNull(), F.array(*cells)).alias("matrix"), "match_count", "inlier_count", (F.col("inlier_count") / F.col("match_count")).alias("inlier_ratio"),
        "reprojection_error_p50", "reprojection_error_p95", *[c.alias(k) for k, c in metrics.items()],
    )


def registered(frames: DataFrame, matches: DataFrame, by: list[str], limits: dict[str, float], threshold: float = 3.0, preview: tuple[float, float] = (1.0, 1.0), offset: float = 0.0) -> DataFrame:
    """Frames (by, frame_index) with the similarity to their map: (by, frame_index, chain_segment, chain, accepted, gate_reasons, match_count, inlier_count, scale, rotation_deg).

    ``matches`` (by, frame_index, x, y, u, v) lead from the frame before to this one, in previews that are ``preview`` times as large as the frames. A frame whose
    registration the gate doesn't accept, or that has no matches, begins a segment; the first frame of a group is its own map. The chain is the product of the
    edges' inverses, so it leads from a frame to the map.
    """
    keys = [*by, "frame_index"]
    edges = fusion.registration_gate(estimated(matches, keys, threshold), limits)
    full = inverse(rescaled([F.get("matrix", F.lit(i)) for i in range(9)], *preview))
    held = frames.select(*keys).distinct().join(edges, keys, "left")
    first = F.row_number().over(W.partitionBy(*by).orderBy("frame_index")) == 1
    unit = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    ok = F.coalesce(F.col("accepted") & F.col("matrix").isNotNull(), F.lit(False))
    why = F.when(F.col("match_count").isNull(), "insufficient_correspondences").when(F.col("matrix").isNull(), "estimator_failed").otherwise(F.col("gate_reasons"))
    held = held.withColumns({"_first": first, "gate_reasons": why, "accepted": ok, "matrix": F.when(ok, F.array(*full))})
    held = held.withColumns({"matrix": F.when(F.col("_first"), unit).otherwise(F.col("matrix")), "accepted": F.col("accepted") | F.col("_first"), "gate_reasons": F.when(F.col("_first"), "first").otherwise(F.col("gate_reasons"))})
    out = folds.chained_transforms(held.select(*keys, "matrix", "accepted", "gate_reasons", "match_count", "inlier_count", "scale", "rotation_deg"), by, offset=offset)
    return out.select(*keys, "chain_segment", "chain", "accepted", "gate_reasons", "match_count", "inlier_count", "scale", "rotation_deg")
