"""Spatial joins: grid cells turn radius, nearest-neighbour and polygon predicates into equi-joins.

Every cell join hashes on (group, cell), so no side is broadcast and no pair outside neighbouring cells is made. Pairs within one table are made from packed blocks of its cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from furrow.functions.geometry import crosses, segment_distance
from furrow.storage import checkpointed, ship


_MOST_ROUNDS = 200
#: Points that may be broadcast with their nine cells.
_FEW = 1000
#: Points of one cell that are sent as one block, and pairs of points that a task tests at once.
_BLOCK, _TESTS = 8192, 1 << 16


def _distance() -> Column:
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    return F.sqrt(dx * dx + dy * dy)


def with_cells(df: DataFrame, size: float | Column, x: str = "x", y: str = "y", ring: int = 0) -> DataFrame:
    """Add the cell (gx, gy); with ``ring``, one row for each cell up to ``ring`` away."""
    gx, gy = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not ring:
        return df.withColumn("gx", gx).withColumn("gy", gy)
    steps = F.sequence(F.lit(-ring), F.lit(ring))
    wide = df.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return wide.withColumn("gx", gx + F.col("_dx")).withColumn("gy", gy + F.col("_dy")).drop("_dx", "_dy")


def radius_join(left: DataFrame, right: DataFrame, radius: float, by: list[str] | None = None) -> DataFrame:
    """Pairs (id, other_id, distance) of left and right points within the radius, borders included. Columns: by, id, x, y.

    With a radius of 0 points meet their equals. Points without a position and null groups meet nothing; rows that repeat give a pair each time.
    """
    by, size = by or [], radius if radius > 0 else 1.0
    l = with_cells(left.select(*by, "id", "x", "y"), size)
    r = with_cells(right.select(*by, F.col("id").alias("other_id"), F.col("x").alias("ox"), F.col("y").alias("oy")), size, "ox", "oy", 1)
    pairs = l.join(r, [*by, "gx", "gy"])
    return pairs.withColumn("distance", _distance()).where(F.col("distance") <= radius).select(*by, "id", "other_id", "distance")


def _near_pairs(radius: float, by: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's meetings of two blocks to their pairs, a few points against a whole block at once, so that what is held is bounded. The smaller id leads and keeps its pairs together."""

    def meet(p: np.ndarray, x: np.ndarray, y: np.ndarray, q: np.ndarray, ox: np.ndarray, oy: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
        step = max(1, _TESTS // len(q))
        for k in range(0, len(p), step):
            ids = p[k : k + step]
            d, dy = x[k : k + step, None] - ox, y[k : k + step, None] - oy
            d *= d
            dy *= dy
            d += dy
            np.sqrt(d, out=d)
            near = d <= radius
            i, j = np.divmod(np.flatnonzero(near & (ids[:, None] < q)), len(q))
            yield ids.take(i), q.take(j), d.take(i * len(q) + j)
            if not same:  # a block that meets itself has each pair in both orders
                near &= ids[:, None] > q
                j, i = np.divmod(np.flatnonzero(near.T), len(ids))
                yield q.take(j), ids.take(i), d.take(i * len(q) + j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(name) for name in batch.schema.names}
            found, held = [], 0

            def made() -> pa.RecordBatch:
                rows, *cols = (np.concatenate(c) for c in zip(*found, strict=True))
                kinds = [at["_id"].type.value_type, at["_id"].type.value_type, pa.float64()]
                out = [at[c].take(pa.array(rows)) for c in by] + [pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)]
                return pa.RecordBatch.from_arrays(out, [*by, "id", "other_id", "distance"])

            for row in range(batch.num_rows):
                sides = (at[c][row].values.to_numpy(zero_copy_only=False) for c in ("_id", "_x", "_y", "_oid", "_ox", "_oy"))
                for pairs in meet(*sides, at["_same"][row].as_py()):
                    if len(pairs[0]):
                        found.append((np.full(len(pairs[0]), row, np.int32), *pairs))
                        held += len(pairs[0])
                    if held >= _TESTS:
                        yield made()
                        found, held = [], 0
            if found:
                yield made()

    return run


def radius_pairs(points: DataFrame, radius: float, by: list[str] | None = None) -> DataFrame:
    """Each pair of points within the radius once, the smaller id first; points that share an id are no pair.

    Points are packed by cell into blocks of about ``_BLOCK`` at most, so what shuffles are arrays. A block is sent to its own cell and four of those around it, once for each block
    there, and pairs are made where two blocks meet and go nowhere from there. Cells are wider than the radius by more than rounding can undo.
    """
    ship(points.sparkSession)
    by, size = by or [], radius * (1 + 2.0**-20) if radius > 0 else 1.0
    most = F.lit(2.0**62)
    place = lambda c: F.floor(F.greatest(-most, F.least(most, F.col(c) / size)))
    known = reduce(and_, [F.col(c).isNotNull() for c in [*by, "id"]] + [F.abs(c) < float("inf") for c in ("x", "y")])
    held = points.select(*by, "id", "x", "y").where(known).withColumn("gx", place("x")).withColumn("gy", place("y"))
    cell = [*by, "gx", "gy"]
    full = F.broadcast(held.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("_parts")).where("_parts > 1"))
    parts = F.coalesce("_parts", F.lit(1))
    # Said for the planner: the join asks for these on one side only, and two exchanges that differ by that are not made once.
    there = "gx is not null and gy is not null and _part is not null"
    dealt = held.join(full, cell, "left").withColumn("_part", F.pmod(F.xxhash64("id"), parts)).where(there)
    point = F.struct("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y")])
    packed = dealt.groupBy(*cell, "_part").agg(F.collect_list(point).alias("_p")).select(*cell, "_part", *[F.col(f"_p.{c}").alias(f"_{c}") for c in ("id", "x", "y")])

    to = F.explode(F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i, j in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))]))
    sent = packed.select(*by, "gx", "gy", F.col("_part").alias("_opart"), *[F.col(f"_{c}").alias(f"_o{c}") for c in ("id", "x", "y")], to.alias("_to"))
    sent = sent.withColumns({"gx": F.col("gx") + F.col("_to.x"), "gy": F.col("gy") + F.col("_to.y"), "_own": F.expr("_to.x = 0 and _to.y = 0")}).drop("_to")
    sent = sent.join(full, cell, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts").where("not _own or _part <= _opart")
    # The rows are few and small beside the work in them, so their partitions aren't to be made fewer.
    sent = sent.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell, "_part")
    met = packed.hint("shuffle_hash").join(sent, [*cell, "_part"])
    both = [f"_{o}{c}" for o in ("", "o") for c in ("id", "x", "y")]
    met = met.select(*by, *both, F.expr("_own and _part = _opart").alias("_same"))
    kind = lambda c: points.schema[c].dataType.simpleString()
    fields = "".join(f"`{c}` {kind(c)}, " for c in by) + f"id {kind('id')}, other_id {kind('id')}, distance double"
    return met.mapInArrow(_near_pairs(radius, by), fields)


def by_density(points: DataFrame, extent: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Add ``_cell`` to the groups' extents: the side of a cell that would hold k points if they lay evenly, divided by the least power of four (up to 4**5) that leaves no
    more than 8 k points in the fullest cell; of powers that leave as many the least. Points are counted in each task for all powers at once."""
    wide, high = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    area = F.when((wide > 0) & (high > 0), wide * high).otherwise(F.pow(F.greatest(wide, high), F.lit(2.0)) / F.col("_n"))
    even = extent.withColumn("_even", F.when(area > 0, F.sqrt(area * k / F.col("_n"))).otherwise(1.0))
    tried = points.select(*by, "x", "y").join(even.select(*by, "_even"), by).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(5))))
    size = F.col("_even") / F.pow(F.lit(4.0), F.col("_j"))
    full = tried.groupBy(*by, "_even", "_j", F.floor(F.col("x") / size).alias("_gx"), F.floor(F.col("y") / size).alias("_gy")).agg(F.count(F.lit(1)).alias("_m"))
    full = full.groupBy(*by, "_even", "_j").agg(F.max("_m").alias("_m"))
    best = full.groupBy(*by, "_even").agg(F.min(F.struct(F.greatest("_m", F.lit(8 * k)).alias("m"), "_j")).alias("_b"))
    return extent.join(best.select(*by, (F.col("_even") / F.pow(F.lit(4.0), F.col("_b._j"))).alias("_cell")), by)


def nearest(left: DataFrame, right: DataFrame, k: int, cell: float | None = None, by: list[str] | None = None, itself: bool = False) -> DataFrame:
    """Exact k nearest right points of each left point: (by, id, other_id, distance, rank).

    Points meet those of the nine cells around them. A result is certain once the k-th distance is no larger than a cell, or the cells
    cover the group's extent; points that aren't certain yet go on with cells of twice the size. A point
    with fewer than k others gets those there are. Without a size to begin with, each group's cells begin with what its own density asks for: about k points on
    average, or less where its fullest cell would hold over 8 k, so a group or a part of one that is much denser than the rest doesn't meet itself as a whole. Points without
    a finite position are left out on both sides.

    Once few points are left, and that is counted, they are broadcast and the right points stay where they are; their candidates are ranked in
    parts before they meet, so a large cell isn't one task.
    """
    finite = lambda df: df.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    left, right = finite(left), finite(right)
    if not by:
        alone = nearest(left.withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0)), k, cell, ["_all"], itself)
        return alone.drop("_all")
    extent = right.groupBy(*by).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max("x").alias("_x1"), F.max("y").alias("_y1"), F.count(F.lit(1)).alias("_n"))
    extent = extent.withColumn("_cell", F.lit(float(cell))) if cell is not None else by_density(right, extent, k, by)
    extent = checkpointed(extent.drop("_n"))
    todo = left.select(*by, "id", "x", "y").join(extent, by)
    far = F.greatest(F.abs(F.col("x") - F.col("_x0")), F.abs(F.col("x") - F.col("_x1")), F.abs(F.col("y") - F.col("_y0")), F.abs(F.col("y") - F.col("_y1")))
    todo = todo.withColumn("_far", far).select(*by, "id", "x", "y", "_far", "_cell")
    others = right.select(*by, F.col("id").alias("other_id"), F.col("x").alias("ox"), F.col("y").alias("oy")).join(extent.select(*by, F.col("_cell").alias("_size")), by)
    one = W.partitionBy(*by, "id")
    done, few, times = None, False, 1.0
    for _ in range(_MOST_ROUNDS):
        wide = F.col("_cell") * times
        wanted = with_cells(todo, wide, ring=1)
        pairs = with_cells(others, F.col("_size") * times, "ox", "oy").drop("_size").join(F.broadcast(wanted) if few else wanted, [*by, "gx", "gy"])
        if not itself:
            pairs = pairs.where("id <> other_id")
        pairs = pairs.withColumn("distance", _distance())
        if few:
            part = W.partitionBy(*by, "id", "_part").orderBy("distance", "other_id")
            pairs = pairs.withColumn("_part", F.pmod(F.xxhash64("other_id"), F.lit(64))).withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= k).drop("_n")
        ranked = pairs.withColumn("rank", F.row_number().over(one.orderBy("distance", "other_id"))).where(F.col("rank") <= k)
        sure = ranked.withColumn("_kth", F.max(F.when(F.col("rank") == k, F.col("distance"))).over(one))
        sure = sure.where((F.col("_kth") <= wide) | (F.col("_far") <= wide))
        found = checkpointed(sure.select(*by, "id", "other_id", "distance", "rank"))
        done = found if done is None else done.unionByName(found)
        rest = todo.join(found.select(*by, "id").distinct(), [*by, "id"], "left_anti").where(F.col("_far") > wide)
        todo, times = checkpointed(rest), times * 2
        left_over = todo.count()
        if not left_over:
            return done
        few = left_over <= _FEW
    raise RuntimeError(f"points remain after {_MOST_ROUNDS} doublings of the cells")


def edges_of(rings: DataFrame, by: list[str]) -> DataFrame:
    """(by, ring_id, xs, ys) to the ring's edges (by, ring_id, ax, ay, bx, by_), closing the ring."""
    n = F.size("xs")
    i = F.explode(F.sequence(F.lit(0), n - 1))
    e = rings.select(*by, "ring_id", "xs", "ys", i.alias("_i"))
    nxt = (F.col("_i") + 1) % F.size("xs")
    return e.select(*by, "ring_id", F.get("xs", "_i").alias("ax"), F.get("ys", "_i").alias("ay"), F.get(F.col("xs"), nxt).alias("bx"), F.get(F.col("ys"), nxt).alias("by_"))



def _whole(areas: DataFrame) -> DataFrame:
    """(area_id, part, hole, xs, ys) to one row for each area with its parts as an array of arrays of rings. Areas without a part column have one."""
    held = areas if "part" in areas.columns else areas.withColumn("part", F.lit(0))
    parts = held.groupBy("area_id", "part").agg(F.collect_list(F.struct("hole", "xs", "ys")).alias("rings"))
    return parts.groupBy("area_id").agg(F.collect_list("rings").alias("parts"))


def _in_ring(ring: Column) -> Column:
    xs, ys = ring["xs"], ring["ys"]
    n = F.size(xs)
    flips = F.transform(F.sequence(F.lit(0), n - 1), lambda i: crosses(F.col("x"), F.col("y"), F.get(xs, i), F.get(ys, i), F.get(xs, (i + 1) % n), F.get(ys, (i + 1) % n)).cast("int"))
    return F.aggregate(flips, F.lit(0), lambda s, v: s + v) % 2 == 1


def points_in_areas(points: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """(id, x, y) with each area (area_id, part, hole, xs, ys) that holds them: some part has them inside its outer ring and in none of its holes.

    A point that repeats gives a row each time; points without a position are in no area. Areas are spread over the cells of their outer rings'
    boxes and meet points by cell; an area's rings are one row, which joins by its id afterwards, and the test is one expression over it.
    """
    corners = ((F.min, F.array_min, "xs", "x0"), (F.max, F.array_max, "xs", "x1"), (F.min, F.array_min, "ys", "y0"), (F.max, F.array_max, "ys", "y1"))
    box = areas.where(~F.col("hole")).groupBy("area_id").agg(*[f(g(c)).alias(a) for f, g, c, a in corners])
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    cells = box.withColumn("gx", F.explode(span("x0", "x1"))).withColumn("gy", F.explode(span("y0", "y1")))
    met = with_cells(points, cell).join(cells, ["gx", "gy"]).where("x between x0 and x1 and y between y0 and y1").select(*points.columns, "area_id")
    held = met.join(_whole(areas), "area_id")
    within = F.exists("parts", lambda rings: F.exists(rings, lambda r: ~r["hole"] & _in_ring(r)) & ~F.exists(rings, lambda r: r["hole"] & _in_ring(r)))
    return held.where(within).select(*points.columns, "area_id")


def ring_distances(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Add ``boundary_distance`` to (area_id, id, x, y): to the nearest edge of its area's rings, holes included. A point that repeats gives a row each time."""

    def edge(r: Column) -> Column:
        n = F.size(r["xs"])
        nxt = lambda c, i: F.get(r[c], (i + 1) % n)
        return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), lambda i: segment_distance(F.col("x"), F.col("y"), F.get(r["xs"], i), F.get(r["ys"], i), nxt("xs", i), nxt("ys", i))))

    held = points.join(_whole(areas), "area_id")
    return held.select(*points.columns, F.array_min(F.transform(F.flatten("parts"), edge)).alias("boundary_distance"))


def coverage_counts(spans: DataFrame, cell: float, by: list[str]) -> DataFrame:
    """How many footprints (by, x0, y0, x1, y1) cover each cell whose origin they hold: (by, px, py, n)."""
    axis = lambda lo, hi: F.sequence(F.ceil(F.col(lo) / cell), F.greatest(F.ceil(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    cells = spans.withColumn("px", F.explode(axis("x0", "x1"))).withColumn("py", F.explode(axis("y0", "y1")))
    return cells.groupBy(*by, "px", "py").agg(F.count(F.lit(1)).alias("n"))


def raster_at(points: DataFrame, raster: DataFrame, by: list[str], value: str = "n") -> DataFrame:
    """The raster's value at each point's nearest pixel (half to even), 0 outside."""
    held = points.withColumn("px", F.rint("x").cast("long")).withColumn("py", F.rint("y").cast("long"))
    return held.join(raster, [*by, "px", "py"], "left").withColumn(value, F.coalesce(value, F.lit(0))).drop("px", "py")


#: Rows of a block of descriptors that are worth a task of their own, and blocks that are made to keep tasks busy.
_BUSY, _TASKS = 2048, 8
#: Rows and columns of distances that are estimated at once, candidates that are kept before they are measured, and those that are measured at once.
_HIGH, _WIDE, _KEPT, _MEASURED = 512, 2048, 1 << 20, 1 << 15


def _blocks(rows: int, most: int) -> int:
    """How many blocks to deal rows into. Each row is sent once for each block of the other side, so there are no more than hold ``most`` rows each, or keep tasks busy."""
    return max(1, math.ceil(rows / most), min(_TASKS, math.ceil(rows / _BUSY)))


class _Tops:
    """The two nearest partners of each of some rows. Estimated squares, off by ``error`` at most, say which partners may be among them; only these are measured."""

    def __init__(self, n: int, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], scale: float, error: float, unit: float) -> None:
        self.measure, self.scale, self.error, self.unit = measure, scale, error, unit
        self.low, self.most = np.full((2, n), np.inf), np.full(n, np.inf, np.float32)
        self.d, self.who = np.full((2, n), np.inf), np.full((2, n), -1)
        self.kept, self.held = [], 0

    def _limit(self, rows: np.ndarray, square: np.ndarray) -> None:
        """Partners with estimates over what a known second one's true square allows, give or take the rounding of both distances, are none of the two."""
        most = ((np.sqrt(square) + 2 * self.unit / self.scale) ** 2 + self.error) * (1 + 1e-6)
        self.most[rows] = np.minimum(self.most[rows], most)

    def see(self, rows: np.ndarray, squares: np.ndarray, first: int) -> None:
        """Estimates of the rows (ascending) to partners numbered from ``first`` on, which rise from call to call."""
        at, low = np.arange(len(rows)), np.empty((4, len(rows)))
        low[:2] = self.low[:, rows]
        best = squares.argmin(1)
        low[2] = value = squares[at, best]
        squares[at, best] = np.inf
        low[3] = squares.min(1)
        squares[at, best] = value
        low.sort(0)
        self.low[:, rows] = low[:2]
        self._limit(rows, np.maximum(low[1], 0) + self.error)
        i, j = np.divmod(np.flatnonzero(squares <= self.most[rows][:, None]), squares.shape[1])
        found = squares[i, j]
        real = np.isfinite(found)
        i, j, found = i[real], j[real], found[real]
        self.kept.append((rows[i], first + j, found))
        self.held += len(i)
        if self.held > _KEPT:
            self.settle()

    def settle(self) -> None:
        """Measure what is kept, and keep the two nearest of each row; of equals the first. After two at 0 no later partner counts."""
        i, j, found = (np.concatenate(c) for c in zip(*self.kept, strict=True)) if self.kept else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        good = found <= self.most[i]
        i, j = i[good], j[good]
        d = np.concatenate([self.measure(i[k : k + _MEASURED], j[k : k + _MEASURED]) for k in range(0, len(i), _MEASURED)] or [np.zeros(0)])
        rows = np.unique(i)
        for k in range(2):
            real = rows[self.who[k, rows] >= 0]
            i, j, d = np.concatenate([i, real]), np.concatenate([j, self.who[k, real]]), np.concatenate([d, self.d[k, real]])
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        begin = np.flatnonzero(np.diff(i, prepend=-1))
        self.d[0, rows], self.who[0, rows] = d[begin], j[begin]
        again = begin[np.diff(begin, append=len(i)) > 1]
        self.d[1, i[again]], self.who[1, i[again]] = d[again + 1], j[again + 1]
        full = rows[np.isfinite(self.d[1, rows])]
        self._limit(full, (self.d[1, full] / self.scale) ** 2)
        self.most[full[self.d[1, full] == 0]] = -np.inf
        self.kept, self.held = [], 0


def _two_nearest(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray, digits: int, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The two nearest q of each p and, if ``both``, the two nearest p of each q: (left, ids, others, distances) by rank. ids x and y ascend; equal ids don't count, nor do vectors that aren't finite.

    Squares of distances are estimated for a tile of rows and columns at once, by one product of single precision, with a bound on what it is off by; what may be among a row's two nearest is
    measured in doubles and rounded to ``digits``. So the result is that of measuring all pairs, in bounded memory.
    """
    finite = lambda ids, v: (ids[(ok := np.isfinite(v).all(1))], v[ok])
    (x, p), (y, q) = finite(x, p), finite(y, q)
    if not len(x) or not len(y):
        return
    middle = q.mean(0)
    u, v = p - middle, q - middle
    big = max(np.abs(u).max(initial=0), np.abs(v).max(initial=0)) or 1.0
    scale = big * (math.sqrt(max(((u / big) ** 2).sum(1).max(), ((v / big) ** 2).sum(1).max())) or 1.0)
    u, v = u / scale, v / scale
    one = lambda w: np.ones((len(w), 1))
    square = lambda w: (w**2).sum(1, keepdims=True)
    left = np.hstack([-2 * u, square(u), one(u)]).astype(np.float32)
    right = np.ascontiguousarray(np.hstack([v, one(v), square(v)]).astype(np.float32).T)
    # Lengths are 1 at most, so the terms of a square sum up to 4 at most, and each step of casting, multiplying and adding is off by 2**-24 of that.
    error = 4 * (left.shape[1] + 8) * 2.0**-24
    measure = lambda i, j: np.round(np.sqrt(((q[j] - p[i]) ** 2).sum(1)), digits)
    rows = _Tops(len(x), measure, scale, error, 10.0**-digits)
    cols = _Tops(len(y), lambda j, i: measure(i, j), scale, error, 10.0**-digits) if both else None
    low, high = np.searchsorted(y, x), np.searchsorted(y, x, "right")
    tile = np.empty(_HIGH * _WIDE, np.float32)  # new memory for each tile would take longer than the product
    for a in range(0, len(x), _HIGH):
        b = min(a + _HIGH, len(x))
        same = np.repeat(np.arange(a, b), high[a:b] - low[a:b])
        twin = np.concatenate([np.arange(*ends) for ends in zip(low[a:b], high[a:b], strict=True)])
        for c in range(0, len(y), _WIDE):
            wide = min(_WIDE, len(y) - c)
            s = np.matmul(left[a:b], right[:, c : c + wide], out=tile[: (b - a) * wide].reshape(b - a, wide))
            here = (twin >= c) & (twin < c + wide)
            s[same[here] - a, twin[here] - c] = np.inf
            near = np.flatnonzero(s.min(1) <= rows.most[a:b])
            if len(near):
                rows.see(a + near, s[near], c)
            if cols:
                near = np.flatnonzero(s.min(0) <= cols.most[c : c + _WIDE])
                if len(near):
                    cols.see(c + near, np.ascontiguousarray(s[:, near].T), a)
    for forward, tops, ids, others in ((True, rows, x, y), (False, cols, y, x)):
        if tops:
            tops.settle()
            for k in range(2):
                real = np.isfinite(tops.d[k])
                yield np.full(real.sum(), forward), ids[real], others[tops.who[k][real]], tops.d[k][real]


def mutual_matches(left: DataFrame, right: DataFrame | None, ratio: float, by: list[str] | None = None, block: int = 65_536, digits: int = 6) -> DataFrame:
    """Pairs (by, a, b, d) that are each other's best, where the best is below ``ratio`` times the second best on both sides.

    ``left`` has (by, a, p) and ``right`` (by, b, q), p and q arrays of numbers; pairs with a = b don't count, and of equal distances the smaller id is
    the better. Without ``right`` left's rows are matched among themselves, and two blocks meet once, not twice. Both sides are dealt into blocks of at most about ``block`` rows; each block meets each
    other one in a task that returns the two best of each row, so what shuffles are a copy of each row for each block of the other side and two rows for each row and block, and never all pairs.
    """
    by, alone = by or [], right is None
    ship(left.sparkSession)
    left = left.where("a is not null and p is not null")
    right = left.select(*by, F.col("a").alias("b"), F.col("p").alias("q")) if alone else right.where("b is not null and q is not null")
    parts = lambda df: _blocks(df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0, block)
    n = parts(left)
    m = n if alone else parts(right)
    own = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    each = lambda low, k: F.explode(F.sequence(low, F.lit(k - 1)))
    l = left.select(*by, "a", "p", own("a", n).alias("_i")).select("*", each(F.col("_i") if alone else F.lit(0), m).alias("_j"))
    r = right.select(*by, "b", "q", own("b", m).alias("_j"))
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.col("_j") if alone else F.lit(n - 1))).alias("_i"))

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            a, b = a.sort_values("a"), b.sort_values("b")
            p, q, x, y = np.stack(a["p"]).astype(float), np.stack(b["q"]).astype(float), a["a"].to_numpy(), b["b"].to_numpy()
            for forward, ids, others, d in _two_nearest(x, p, y, q, digits, not (alone and key[-2] == key[-1])):
                found.append(pd.DataFrame(dict(zip(by, key, strict=False)) | {"forward": forward | alone, "id": ids, "other": others, "d": d}))
        return pd.concat(found) if found else pd.DataFrame([], columns=[*by, "forward", "id", "other", "d"])

    keys = [*by, "_i", "_j"]
    types = "".join(f"`{c}` {left.schema[c].dataType.simpleString()}, " for c in by)
    # Meetings are few and long beside their rows, so they get partitions enough that hardly two share one.
    dealt = lambda df: df.repartition(max(2 * n * m, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys).groupBy(*keys)
    found = dealt(l).cogroup(dealt(r)).applyInPandas(meet, f"{types}forward boolean, id long, other long, d double")
    ranked = found.withColumn("_r", F.row_number().over(W.partitionBy(*by, "forward", "id").orderBy("d", "other"))).where("_r <= 2")
    tops = checkpointed(ranked.groupBy(*by, "forward", "id").agg(F.min(F.struct("_r", "other", "d")).alias("t"), F.max(F.when(F.col("_r") == 2, F.col("d"))).alias("second")))
    good = tops.where(F.col("second").isNull() | (F.col("t.d") < ratio * F.col("second"))).select(*by, "forward", "id", F.col("t.other").alias("other"), F.col("t.d").alias("d"))
    forward = good.where("forward").select(*by, F.col("id").alias("a"), F.col("other").alias("b"), "d")
    back = good.where("forward" if alone else "not forward").select(*by, F.col("other").alias("a"), F.col("id").alias("b"))
    return forward.join(back, [*by, "a", "b"])
