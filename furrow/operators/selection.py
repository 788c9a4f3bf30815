"""Top-k, evidence and sampling selections, tiles, and small set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from furrow.storage import checkpointed


def overlay_top(detections: DataFrame, least: float, limit: int, width: float, height: float, centrality: float = 0.1, digits: int | None = None) -> DataFrame:
    """The ``limit`` best eligible boxes of each frame by (1 - centrality) x confidence + centrality x closeness to the center.

    With ``digits`` scores are rounded before they are ranked, so that boxes that lie mirrored are equal and go by confidence and id. Adds ``score``, ``position``, ``eligible`` (of the frame) and ``truncated``.
    """
    half = F.lit(((width / 2) ** 2 + (height / 2) ** 2) ** 0.5)
    dx, dy = (F.col("x1") + F.col("x2")) / 2 - width / 2, (F.col("y1") + F.col("y2")) / 2 - height / 2
    score = (1 - centrality) * F.col("confidence") + centrality * F.greatest(1 - F.sqrt(dx * dx + dy * dy) / half, F.lit(0.0))
    if digits is not None:
        score = F.round(score * 10.0**digits) / 10.0**digits
    held = detections.where(F.col("confidence") >= least).withColumn("score", score)
    w = W.partitionBy("frame_index")
    held = held.withColumn("position", F.row_number().over(w.orderBy(F.desc("score"), F.desc("confidence"), "detection_id"))).withColumn("eligible", F.count(F.lit(1)).over(w))
    return held.where(F.col("position") <= limit).withColumn("truncated", F.greatest(F.col("eligible") - limit, F.lit(0)))


def tiles(frames: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Windows over (frame_id, width, height): steps of tile - overlap, the last clamped to the edge, one if the frame is smaller."""

    def starts(length: str) -> Column:
        last = F.greatest(F.col(length) - tile, F.lit(0))
        return F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), last, F.lit(tile - overlap)), lambda s: s < F.greatest(last, F.lit(1))), F.array(last)))

    held = frames.select("*", F.explode(starts("height")).alias("tile_y")).select("*", F.explode(starts("width")).alias("tile_x"))
    return held.withColumn("tile_width", F.least(F.lit(tile), F.col("width"))).withColumn("tile_height", F.least(F.lit(tile), F.col("height")))


def evidence(gaps: DataFrame, largest: int = 10, per_status: int = 5, limit: int = 40) -> DataFrame:
    """Gaps to look at: the largest, then the most confident of each status, then the least confident, each once, up to ``limit``."""
    size = [F.desc("estimated_missing_plants"), F.desc("gap_confidence"), F.col("gap_id")]
    first = gaps.orderBy(*size).limit(largest).withColumn("_from", F.lit(0)).withColumn("_at", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*size)))
    best = W.partitionBy("evidence_status").orderBy(F.desc("gap_confidence"), "gap_id")
    second = gaps.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= per_status).withColumn("_from", F.lit(1)).withColumn("_at", F.col("_r")).drop("_r")
    low = [F.col("gap_confidence"), F.col("gap_id")]
    third = gaps.orderBy(*low).limit(limit).withColumn("_from", F.lit(2)).withColumn("_at", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*low)))
    every = first.unionByName(second).unionByName(third)
    once = every.withColumn("_n", F.row_number().over(W.partitionBy("gap_id").orderBy("_from", "_at"))).where("_n = 1")
    order = [F.col("_from"), F.col("_at"), F.col("evidence_status"), F.col("gap_id")]
    return once.orderBy(*order).limit(limit).withColumn("priority", F.col("_from")).select(*gaps.columns, "priority")


def first_rejected(rejected: DataFrame, most: int = 8) -> DataFrame:
    """Per reason the first of each plot by boundary share, and of those the first ``most``."""
    order = [F.col("boundary_fraction"), F.col("candidate_id")]
    one = rejected.withColumn("_n", F.row_number().over(W.partitionBy("rejection_reason", "plot_id").orderBy(*order))).where("_n = 1")
    return one.withColumn("position", F.row_number().over(W.partitionBy("rejection_reason").orderBy(*order))).where(F.col("position") <= most).drop("_n")


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with the same key the last one in order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def quantile_positions(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Rows at ``n`` evenly spaced places of the order, ends included.

    The places need ranks over the whole table; ranks come from a range-partitioned sort with partition offsets, not from one window.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    held = checkpointed(ordered.withColumn("_p", F.spark_partition_id()))  # the numbers must be the same in both readings
    local = held.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    sizes = {r["_p"]: r["n"] for r in held.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each partition
    total, before = sum(sizes.values()), {}
    at = 0
    for p in sorted(sizes):
        before[p] = at
        at += sizes[p]
    wanted = sorted({round(k * (total - 1) / max(1, n - 1)) for k in range(n)}) if total else []
    start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.lit(None).cast("map<int,int>")
    return local.withColumn("position", F.col("_i") - 1 + start[F.col("_p")]).where(F.col("position").isin(wanted)).drop("_p", "_i")


def mask_comparison(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Pixels of two masks (by, px, py): intersection over union and the shares that only one has."""
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), [*by, "px", "py"], "full")
    ina, inb = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    n = lambda c: F.count_if(c)
    out = both.groupBy(*by).agg(n(ina & inb).alias("both"), n(ina | inb).alias("either"), n(ina & ~inb).alias("only_a"), n(inb & ~ina).alias("only_b"))
    return out.withColumn("iou", F.col("both") / F.col("either"))


def majority(votes: DataFrame, by: list[str], share: float = 0.5) -> DataFrame:
    """Pixels that the given share of the valid votes (by, vote 0/1, null if not valid) or more accept."""
    out = votes.groupBy(*by).agg(F.sum("vote").alias("votes"), F.count("vote").alias("valid"))
    return out.withColumn("accepted", F.coalesce(F.col("votes") / F.when(F.col("valid") > 0, F.col("valid")) >= share, F.lit(False)))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with the side."""
    only = lambda x, y, name: x.select(*keys).distinct().join(y.select(*keys).distinct(), keys, "left_anti").withColumn("only_in", F.lit(name))
    return only(a, b, "left").unionByName(only(b, a, "right"))
