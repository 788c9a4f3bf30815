"""Checks, budgets and summaries over records: validated joins, ordered shards, rules, silences, shown results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from furrow.functions.boxes import finite
from furrow.operators import folds, selection, spatial, statistics
from furrow.operators.reports import connected_cells
from furrow.operators.sync import asof_both
from furrow.sources.readers import unsorted_rows
from furrow.storage import checkpointed


def joined_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join that fails when it is read if a key is on a side more than once. A null key joins with nothing and may repeat."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    text = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])

    def once(df: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        """Rows with a key, checked, and those without one, which would be one window."""
        n = F.count(F.lit(1)).over(W.partitionBy(*keys))
        fail = F.raise_error(F.concat(F.lit(f"key repeated on the {side}: "), text)).cast("boolean")
        return df.where(known).withColumn("_n", n).where(F.when(F.col("_n") > 1, fail).otherwise(True)).drop("_n"), df.where(~known)

    (l, l_rest), (r, r_rest) = once(left, "left"), once(right, "right")
    joined = l.join(r, keys, how)
    for side, rest in (("left", l_rest), ("right", r_rest)):
        if how in (side, f"{side}_outer", f"{side}outer", "full", "outer", "full_outer", "fullouter"):
            joined = joined.unionByName(rest, allowMissingColumns=True)
    return joined


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Add ``name``: 1, 2, 3 ... over all rows in a total order.

    Rows are dealt by ranges and numbered in each; what a range begins with is the sum of the sizes of those before, of which there are as many as tasks. No row goes to a single task for its number.
    """
    held = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = checkpointed(held.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_range", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return held.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_range", "_at", "_first", "_before")


def group_sizes(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n): groups by size, the largest first, then by key; sorted by ranges. A null key is a group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by)


def totals(df: DataFrame, distinct: dict[str, str], counted: dict[str, Column], ranged: dict[str, tuple[str, str]]) -> DataFrame:
    """One row over a whole table: ``observations``, numbers of different values, numbers of rows for which a condition holds, and least and largest values under two names each.

    Sums are combined in each task. Of an empty table all numbers are 0 and the values null.
    """
    return df.agg(
        F.count(F.lit(1)).alias("observations"), *[F.countDistinct(c).alias(n) for n, c in distinct.items()], *[F.count_if(c).alias(n) for n, c in counted.items()],
        *[f(c).alias(n) for c, names in ranged.items() for f, n in zip((F.min, F.max), names, strict=True)],
    )


def key_union(rows: DataFrame, column: str) -> DataFrame:
    """One row with ``keys``: all keys of a map column's rows, sorted, each once. Null maps have none. Keys are made distinct in each task before they meet."""
    keys = rows.select(F.explode(F.map_keys(column)).alias("key")).distinct()
    return keys.agg(F.array_sort(F.collect_list("key")).alias("keys"))


def shards_in_order(shards: list[DataFrame], order: list[str]) -> DataFrame:
    """All shards' rows as one table sorted by ``order``, dealt by ranges; columns that a shard lacks are null."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
    return every.repartitionByRange(*order).sortWithinPartitions(*order)


def taken_by_frame(rows: DataFrame, frames: DataFrame, order: str = "row_id", key: str = "frame_index") -> tuple[DataFrame, DataFrame]:
    """What a single pass over sorted rows gives each wanted frame, and the rows it must reject: (row, problem).

    A row is rejected if its frame is smaller than that of the row before, or isn't wanted (it would stay unconsumed).
    """
    wanted = frames.select(key).distinct()
    unsorted = unsorted_rows(rows, order, key).select(F.col("at").alias("row"), F.lit("unsorted").alias("problem"))
    stray = rows.join(wanted, key, "left_anti").select(F.col(order).alias("row"), F.lit("unexpected_frame").alias("problem"))
    return rows.join(wanted, key, "left_semi"), unsorted.unionByName(stray)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``violated``: the names of the rules that a row breaks, in their order; a rule that is null is broken."""
    names = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.withColumn("violated", F.array_compact(names))


def within_budget(df: DataFrame, group: list[str], order: list[Column], at: str, size: str, least: float, budget: int) -> DataFrame:
    """Rows that a saver keeps: ``least`` or more behind the last kept one, while the bytes kept stay within ``budget``. What doesn't fit is skipped; smaller ones may follow."""

    def step(state, t, n):
        last, used = state or (None, 0)
        ok = t is not None and n is not None and (last is None or t - last >= least) and used < budget and used + n <= budget
        return ((t, used + n) if ok else (last, used)), ok

    return folds.carried(df, group, order, [at, size], step)


def session_summary(records: DataFrame, group: list[str], size: str, order: str, most: int, backups: int) -> DataFrame:
    """What a session's rotated log holds at its end: records, bytes written, rotations, files discarded, bytes on disk, whether the cap was reached."""
    chunks = folds.rotated_chunks(records, group, size, order, most).groupBy(*group, "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    last = chunks.groupBy(*group).agg(F.max("chunk").alias("last"))
    held = chunks.join(last, group).groupBy(*group, "last").agg(F.sum("n").alias("records"), F.sum("bytes").alias("bytes_written"), F.sum(F.when(F.col("chunk") >= F.col("last") - backups, F.col("bytes"))).alias("bytes_on_disk"))
    gone = F.greatest(F.col("last") - backups, F.lit(0)).cast("long")
    return held.select(*group, "records", "bytes_written", F.col("last").cast("long").alias("rotations"), gone.alias("files_discarded"), "bytes_on_disk", (gone > 0).alias("storage_cap_reached"))


def silences(beats: DataFrame, by: list[str], at: str, most: float) -> DataFrame:
    """(by, at, silence): heartbeats after which none came for more than ``most``."""
    gap = F.lead(at).over(W.partitionBy(*by).orderBy(at)) - F.col(at)
    return beats.withColumn("silence", gap).where(F.col("silence") > most).select(*by, at, "silence")


def shown_results(frames: DataFrame, results: DataFrame, by: list[str], at: str, generated: str, most: float) -> DataFrame:
    """Each frame with ``shown``, the latest result generated up to its time, null if that is more than ``most`` old."""
    held = asof_both(frames, results, by, at, generated)
    before = F.col("before")
    return held.withColumn("shown", F.when(F.col(at) - before[generated] <= most, before)).select(*frames.columns, "shown")


def rolling_rate(samples: DataFrame, by: list[str], at: str, count: str) -> DataFrame:
    """Add ``fps``: counted frames since the sample before over the time since then; null on the first and where no time has passed."""
    w = W.partitionBy(*by).orderBy(at)
    seconds = F.col(at) - F.lag(at).over(w)
    return samples.withColumn("fps", (F.col(count) - F.lag(count).over(w)) / F.when(seconds > 0, seconds))


def gate_summary(gates: DataFrame, by: list[str]) -> DataFrame:
    """Per plant: observations, how many were accepted, for review and rejected, and the smallest distance."""
    n = lambda s: F.count_if(F.col("status") == s)
    return gates.groupBy(*by).agg(F.count(F.lit(1)).alias("observations"), n("accepted").alias("accepted"), n("boundary_review").alias("boundary_review"), n("outside_rejected").alias("outside_rejected"), F.min("distance").alias("least_distance"))


def mask_union(masks: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per pixel (by, px, py) the largest value of all instances."""
    return masks.groupBy(*by, "px", "py").agg(F.max(value).alias(value))


def spacing_sample(points: DataFrame, by: str, frame: str, every: int = 25) -> DataFrame:
    """Quantiles of the nearest distance inside every ``every``-th frame (from the first) of each group: a sampling operator."""
    n = F.row_number().over(W.partitionBy(by).orderBy(frame)) - 1
    sampled = points.select(by, frame).distinct().withColumn("_n", n).where(F.col("_n") % every == 0).select(by, frame)
    held = points.join(sampled, [by, frame], "left_semi")
    near = spatial.nearest(held, held, 1, by=[by, frame])
    return statistics.quantile_summary(near, [by], "distance")


def by_area(rings: DataFrame, by: list[str]) -> DataFrame:
    """Add ``position``: rings of a group by area, the largest first, then by their box and their points."""
    xs, ys = F.col("xs"), F.col("ys")
    order = [F.desc("area"), F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), F.concat_ws(",", xs.cast("array<string>"), ys.cast("array<string>"))]
    return rings.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def area_candidates(instances: DataFrame, by: list[str], least: float, limit: int) -> DataFrame:
    """Of each group the ``limit`` largest instances of an area of ``least`` or more; of equal areas the one with the larger index first."""
    return statistics.ranked(instances.where(finite(F.col("area")) & (F.col("area") >= least)), by, [F.desc("area"), F.desc("index")], limit, "position")


def same_sources(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct sources that only one of two tables names, with the side."""
    return selection.same_keys(a, b, [key])


def largest_gaps(gaps: DataFrame, n: int = 25) -> DataFrame:
    """The ``n`` gaps that a map labels: by missing plants, then confidence, then id. A report, so limited by purpose."""
    return gaps.orderBy(F.desc("estimated_missing_plants"), F.desc("gap_confidence"), "gap_id").limit(n)


def strided(df: DataFrame, order: str, stride: int, start: int = 0, most: int | None = None) -> DataFrame:
    """A sampling operator: rows whose number is ``start`` or a whole number of strides behind it, the first ``most`` of them."""
    held = df.where((F.col(order) >= start) & ((F.col(order) - start) % stride == 0))
    return held if most is None else held.orderBy(order).limit(most)


def frame_flags(observations: DataFrame, by: list[str], low: float) -> DataFrame:
    """Per frame the observations of each gate status and those of low confidence; another status is an error."""
    known = ["accepted", "boundary_review", "outside_rejected"]
    fail = F.raise_error(F.concat(F.lit("unknown gate status: "), F.coalesce("status", F.lit("null")))).cast("boolean")
    held = observations.where(F.when(~F.coalesce(F.col("status").isin(known), F.lit(False)), fail).otherwise(True))
    return held.groupBy(*by).agg(*[F.count_if(F.col("status") == k).alias(k) for k in known], F.count_if(F.col("confidence") < low).alias("low_confidence"))


def counts_with_zeros(frames: DataFrame, found: DataFrame, by: list[str], name: str) -> DataFrame:
    """Each frame with the number of found rows, 0 where there are none."""
    n = found.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    return frames.select(*by).distinct().join(n, by, "left").fillna(0, [name])


def region(x: Column, y: Column, width: Column, height: Column, frame_width: Column, frame_height: Column) -> Column:
    """A region of interest as a struct; reading one that is empty or leaves the frame is an error."""
    good = (x >= 0) & (y >= 0) & (width > 0) & (height > 0) & (x + width <= frame_width) & (y + height <= frame_height)
    box = F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))
    return F.when(good, box).otherwise(F.raise_error(F.concat_ws(" ", F.lit("region outside the frame:"), *[c.cast("string") for c in (x, y, width, height)])).cast("struct<x:int,y:int,width:int,height:int>"))


def plant_blocks(points: DataFrame, by: list[str], radius: int, least: int) -> DataFrame:
    """(by, block, plants, cells, x, y): blocks of plants (x, y) whose surroundings of ``radius`` cells touch, in the order of their middles from the top.

    Each plant's pixel is widened to an ellipse, cells that touch are one component, and components of fewer than ``least`` plants are left out.
    """
    pixel = points.select(*by, F.rint("x").cast("long").alias("px"), F.rint("y").cast("long").alias("py"))
    wide = pixel.distinct().withColumn("_dy", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    reach = F.rint(radius * F.sqrt(1 - F.pow(F.col("_dy") / radius, F.lit(2.0)))).cast("int")
    wide = wide.withColumn("_dx", F.explode(F.sequence(-reach, reach)))
    cells = wide.select(*by, (F.col("px") + F.col("_dx")).alias("px"), (F.col("py") + F.col("_dy")).alias("py")).distinct()
    labels = connected_cells(cells, by)
    root = ["root_x", "root_y"]
    shape = labels.groupBy(*by, *root).agg(F.count(F.lit(1)).alias("cells"), F.avg("px").alias("x"), F.avg("py").alias("y"))
    plants = pixel.join(labels, [*by, "px", "py"]).groupBy(*by, *root).agg(F.count(F.lit(1)).alias("plants")).where(F.col("plants") >= least)
    place = F.row_number().over(W.partitionBy(*by).orderBy("y", "x", *root))
    return shape.join(plants, [*by, *root]).withColumn("block", place).select(*by, "block", "plants", "cells", "x", "y")


def bounded_queue(df: DataFrame, group: list[str], order: list[Column], at: str, service: float, capacity: int) -> DataFrame:
    """Add ``written`` and ``done``: rows that a writer with a queue of ``capacity`` takes, each ``service`` long, one after another, and when it has written them.

    A row that finds the queue full (the one being written counts) is dropped; so is one without a time.
    """

    def step(state, t):
        waiting = [x for x in state or () if t is None or x > t]
        if t is None or len(waiting) >= capacity:
            return waiting, (False, None)
        done = max([t, *waiting]) + service
        return [*waiting, done], (True, done)

    return folds.carried(df, group, order, [at], step, "written boolean, done double")
