"""Smaller reports: extents, circular means, interpolation, central frames, connected cells, parity of two detectors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from furrow.operators.spatial import by_density, with_cells
from furrow.storage import checkpointed


def extents(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Bounding box of each group; nulls don't count, and a group of nulls has a box of nulls."""
    return df.groupBy(*by).agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))


def circular_mean(df: DataFrame, by: list[str], phase: str) -> DataFrame:
    """Mean direction (radians) of phases and the length of the mean vector."""
    s, c = F.avg(F.sin(phase)), F.avg(F.cos(phase))
    return df.groupBy(*by).agg(F.atan2(s, c).alias("mean_phase"), F.hypot(s, c).alias("resultant"))


def interpolated(queries: DataFrame, knots: DataFrame, by: list[str], at: str) -> DataFrame:
    """Linear interpolation of ``value`` over ``at`` between the knots around each query, the end value outside."""
    q = queries.withColumn("_q", F.lit(True)).withColumn("value", F.lit(None).cast("double"))
    both = q.unionByName(knots.select(*by, at, "value", F.lit(False).alias("_q")), allowMissingColumns=True)
    known = F.when(~F.col("_q"), F.struct(F.col(at).alias("t"), F.col("value").alias("v")))
    ahead = W.partitionBy(*by).orderBy(at, "_q").rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(*by).orderBy(F.desc(at), "_q").rowsBetween(W.unboundedPreceding, 0)
    held = both.withColumn("_b", F.last(known, ignorenulls=True).over(ahead)).withColumn("_a", F.last(known, ignorenulls=True).over(back)).where("_q")
    b, a = F.col("_b"), F.col("_a")
    part = F.when(a["t"] > b["t"], (F.col(at) - b["t"]) / (a["t"] - b["t"])).otherwise(0.0)
    value = F.when(b.isNull(), a["v"]).when(a.isNull(), b["v"]).otherwise(b["v"] + part * (a["v"] - b["v"]))
    return held.withColumn("value", value).drop("_q", "_b", "_a")


def central_frames(gaps: DataFrame, frames: DataFrame, cell: float) -> DataFrame:
    """Of the frames (frame_index, x0, y0, x1, y1) that cover each gap (gap_id, x, y) the one whose middle is nearest, ties to the earlier frame.

    Gaps meet middles by cells that the middles' density asks for, of ``cell`` at most. A frame that covers a gap and whose middle is no further off than a cell is its nearest; gaps without one go on with
    cells of twice the size, up to the longest way from a middle to its frame's corners, beyond which no frame covers. Frames and gaps without a finite position are left out. Frames may bring their middles (cx, cy); else these are
    half the sum of the corners, whose last bit decides among frames that are as near.
    """
    own = {"cx", "cy"} <= set(frames.columns)
    cx, cy = (F.col("cx"), F.col("cy")) if own else ((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    finite = lambda c: F.abs(c) < float("inf")
    f = frames.where(finite(cx) & finite(cy)).select("frame_index", "x0", "y0", "x1", "y1", cx.alias("_cx"), cy.alias("_cy"))
    off = lambda lo, c, hi: F.greatest(F.col(c) - F.col(lo), F.col(hi) - F.col(c))
    reach = F.max(F.hypot(off("x0", "_cx", "x1"), off("y0", "_cy", "y1")))
    far = f.agg(reach.alias("reach"), ((F.max("_cx") - F.min("_cx")) * (F.max("_cy") - F.min("_cy"))).alias("area"), F.count(F.lit(1)).alias("n")).first()
    even = math.sqrt(2 * far["area"] / far["n"]) if far["n"] else 0.0
    wide, last = min(float(cell), even or float(cell)), (far["reach"] or 0.0) * (1 + 1e-9)
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    todo, done = gaps.where(finite(F.col("x")) & finite(F.col("y"))).select("gap_id", "x", "y"), None
    while True:
        met = with_cells(f, wide, "_cx", "_cy").join(with_cells(todo, wide, ring=1).hint("merge"), ["gx", "gy"]).where("x >= x0 and x < x1 and y >= y0 and y < y1").withColumn("distance", F.sqrt(dx * dx + dy * dy))
        best = met.where(F.col("distance") <= wide).groupBy("gap_id").agg(F.min(F.struct("distance", "frame_index")).alias("b"))
        found = checkpointed(best.select("gap_id", F.col("b.frame_index").alias("frame_index"), F.col("b.distance").alias("distance")))
        done = found if done is None else done.unionByName(found)
        if wide >= last:
            return done
        todo, wide = checkpointed(todo.join(found.select("gap_id"), "gap_id", "left_anti")), wide * 2
        if todo.isEmpty():
            return done


def overlapping_areas(cells: DataFrame) -> DataFrame:
    """Pairs of areas (area_id, px, py) that share cells, with how many."""
    other = cells.select(F.col("area_id").alias("other_id"), "px", "py")
    return cells.join(other, ["px", "py"]).where("area_id < other_id").groupBy("area_id", "other_id").agg(F.count(F.lit(1)).alias("shared"))


def connected_cells(cells: DataFrame, by: list[str], most_rounds: int = 200) -> DataFrame:
    """Label each cell (by, px, py) with the smallest (px, py) of its eight-connected component, by labels that spread and jump."""
    key = F.struct("px", "py")
    labels = checkpointed(cells.select(*by, "px", "py").distinct().withColumn("root", key))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    for _ in range(most_rounds):
        spread = labels.select(*by, steps.alias("s"), "px", "py", "root").select(*by, (F.col("px") + F.col("s.i")).alias("px"), (F.col("py") + F.col("s.j")).alias("py"), "root")
        near = spread.groupBy(*by, "px", "py").agg(F.min("root").alias("near"))
        taken = labels.join(near, [*by, "px", "py"]).select(*by, "px", "py", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(*by, key.alias("k"), F.col("root").alias("up")).select(*by, F.col("k").alias("root"), "up")
        taken = checkpointed(taken.join(jump, [*by, "root"], "left").select(*by, "px", "py", "was", F.least("root", "up").alias("root")))
        labels = taken.drop("was")
        if taken.where("root <> was").isEmpty():
            return labels.select(*by, "px", "py", F.col("root.px").alias("root_x"), F.col("root.py").alias("root_y"))
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def parity(matches: DataFrame, by: list[str], box_error: float, confidence_error: float) -> DataFrame:
    """(by, iou, box_error, confidence_error, of matched boxes) to counts, worst errors, mean overlap and whether all is within the limits."""
    out = matches.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matches"), F.max("box_error").alias("max_box_error"), F.max("confidence_error").alias("max_confidence_error"), F.avg("iou").alias("mean_iou")
    )
    return out.withColumn("passed", (F.col("max_box_error") <= box_error) & (F.col("max_confidence_error") <= confidence_error))


def notable_frames(df: DataFrame, by: list[str], frame: str, value: str) -> DataFrame:
    """First, middle and last frame of each group and those with the largest and smallest value (earliest of equals), each once."""
    n = df.groupBy(*by).agg(
        F.min(frame).alias("first"), F.max(frame).alias("last"), F.expr(f"percentile_disc(0.5) within group (order by {frame})").cast("long").alias("mid"),
        F.max_by(frame, F.struct(F.col(value), -F.col(frame))).alias("most"), F.min_by(frame, F.struct(value, frame)).alias("least"),
    )
    return n.select(*by, F.explode(F.array_distinct(F.array("first", "mid", "last", "most", "least"))).alias(frame))


def sampled_windows(df: DataFrame, by: list[str], order: str, size: int) -> DataFrame:
    """Two windows of ``size`` rows in a row: from the start and from the middle of each group."""
    w = W.partitionBy(*by)
    held = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    mid = F.floor(F.col("_n") / 2)
    return held.where((F.col("_i") < size) | ((F.col("_i") >= mid) & (F.col("_i") < mid + size))).drop("_i", "_n")


def nonadjacent_minimum(path: DataFrame, by: list[str], order: str, cell: float, apart: int = 30) -> DataFrame:
    """Smallest distance between points of a path that lie ``apart`` or more places from one another; null if there are none.

    Points meet by cells, so a path that comes near itself makes few pairs. Each path begins with cells that its own density asks for, of ``cell`` at most; one without a distance up to
    its cells goes on with cells of twice the size, until they cover its extent.
    """
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    held = path.where(finite("x") & finite("y"))
    extent = held.groupBy(*by).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max("x").alias("_x1"), F.max("y").alias("_y1"), F.count(F.lit(1)).alias("_n"), (F.max(order) - F.min(order)).alias("_places"))
    span = F.hypot(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    todo = by_density(held, extent.where(F.col("_places") >= apart), 2, by).select(*by, span.alias("_span"), F.least("_cell", F.lit(float(cell))).alias("_cell"))
    todo, done = checkpointed(todo), None
    while True:
        left = held.join(todo.select(*by, "_cell"), by)
        a = left.withColumn("gx", F.floor(F.col("x") / F.col("_cell"))).withColumn("gy", F.floor(F.col("y") / F.col("_cell")))
        b = left.select(*by, F.col(order).alias("_o"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.floor(F.col("x") / F.col("_cell")).alias("_gx"), F.floor(F.col("y") / F.col("_cell")).alias("_gy"))
        b = b.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumn("gx", F.col("_gx") + F.col("_i")).withColumn("gy", F.col("_gy") + F.col("_j")).drop("_gx", "_gy", "_i", "_j")
        dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
        near = a.join(b.hint("merge"), [*by, "gx", "gy"]).where(F.col("_o") >= F.col(order) + apart).withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= F.col("_cell"))
        found = checkpointed(near.groupBy(*by).agg(F.min("d").alias("min_distance")))
        done = found if done is None else done.unionByName(found)
        todo = checkpointed(todo.join(found, by, "left_anti").where(F.col("_span") > F.col("_cell")).withColumn("_cell", F.col("_cell") * 2))
        if todo.isEmpty():
            return path.select(*by).distinct().join(done, by, "left")


def breaks(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows whose number doesn't follow the one before by one: an empty result means a contiguous sequence."""
    was = F.lag(order).over(W.partitionBy(*by).orderBy(order))
    return df.withColumn("previous", was).where(F.col("previous").isNotNull() & (F.col(order) != F.col("previous") + 1))


def looked_up(wanted: DataFrame, index: DataFrame, key: str, index_key: str) -> DataFrame:
    """Each wanted key with its row of the index; reading a key that has no row raises an error."""
    held = wanted.join(index.withColumn("_there", F.lit(True)), F.col(key) == F.col(index_key), "left")
    checked = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no row for key "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return held.where(checked).drop("_there", index_key)
