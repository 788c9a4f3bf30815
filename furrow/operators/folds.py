"""Order-dependent operators.

Greedy ones over a frame are native folds over its sorted array, since the sensor bounds a frame. Ones over a session, which
nothing bounds, pass the session's sorted rows through a function that carries a small state: linear time, constant memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from furrow.functions.boxes import center_distance, finite, iou
from furrow.storage import ship

Conflict = Callable[[Column, Column], Column]


#: Rows of a group that are folded as one array; a fold compares each row with all kept ones, so boxes of larger groups go through a grid.
_MOST_FOLDED = 512
_CORNERS = ("x1", "y1", "x2", "y2")


def greedy_keep(df: DataFrame, group: list[str], order: list[Column], conflict: Conflict, large: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows taken in ``order`` unless they conflict with one taken before, within ``group``. The order must be total.

    ``large`` does the same for groups of over ``_MOST_FOLDED`` boxes with finite corners in doubles, which it gets as rows with their place ``_at`` in the order.
    """
    keys = [c.alias(f"_k{i}") for i, c in enumerate(order)]
    rest = [c for c in df.columns if c not in group]
    rows = F.sort_array(F.collect_list(F.struct(*keys, *rest)))
    held = df.groupBy(*group).agg(rows.alias("_rows"))
    empty = F.slice(F.col("_rows"), 1, 0)
    kept = F.aggregate("_rows", empty, lambda out, x: F.when(F.exists(out, lambda k: conflict(k, x)), out).otherwise(F.concat(out, F.array(x))))
    columns = [*group, *[F.col(f"_row.{c}") for c in rest]]
    types = dict(df.dtypes)
    if large is None or any(types[c] != "double" for c in _CORNERS):
        return held.select(*group, F.explode(kept).alias("_row")).select(*columns)
    gridded = (F.size("_rows") > _MOST_FOLDED) & F.forall("_rows", lambda r: reduce(and_, [finite(r[c]) for c in _CORNERS]))
    folded = held.where(~gridded).select(*group, F.explode(kept).alias("_row")).select(*columns)
    many = held.where(gridded).select(*group, F.posexplode("_rows").alias("_at", "_row")).select(*columns, "_at")
    return folded.unionByName(large(many).drop("_at"))


def _gridded(group: list[str], reach: Callable[[tuple], tuple[float, float, float, float]], size: Callable[[tuple], float], ratio: float, conflict: Callable[[tuple, tuple], bool]) -> Callable[[DataFrame], DataFrame]:
    """``large`` for boxes: those taken lie in grids by the power of two of their ``size``, each in the cells that its ``reach`` (x0, y0, x1, y1) covers, and a box meets those of the cells that it
    reaches itself. Boxes conflict only where their reaches meet and neither's size is below ``ratio`` times the other's. What a task holds are the boxes kept of one group.
    A box without a size conflicts with none."""

    def spread(level: int, box: tuple) -> tuple[range, range]:
        side = 2.0**level
        x0, y0, x1, y1 = reach(box)
        return range(math.floor(x0 / side), math.floor(x1 / side) + 1), range(math.floor(y0 / side), math.floor(y1 / side) + 1)

    def step(grids, *box):
        grids, s = {} if grids is None else grids, size(box)
        if s <= 0:
            return grids, True
        x0, y0, x1, y1 = reach(box)
        for level, cells in grids.items():
            if (2.0**level < ratio * s * 0.99) or (2.0 ** (level - 1) * ratio > s * 1.01):
                continue
            side = 2.0**level
            few = (x1 - x0 + side) * (y1 - y0 + side) < 4 * len(cells) * side * side
            if few:
                xs, ys = spread(level, box)
            near = (cells.get((i, j), ()) for i in xs for j in ys) if few else cells.values()
            if any(conflict(k, box) for some in near for k in some):
                return grids, False
        own = math.ceil(math.log2(s))
        cells = grids.setdefault(own, {})
        xs, ys = spread(own, box)
        for i in xs:
            for j in ys:
                cells.setdefault((i, j), []).append(box)
        return grids, True

    return lambda many: carried(many, group, [F.col("_at")], [*_CORNERS], step)


def _iou(a: tuple, b: tuple) -> float:
    """As ``boxes.iou``, of (x1, y1, x2, y2)."""
    w, h = max(min(a[2], b[2]) - max(a[0], b[0]), 0.0), max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)
    union = max(a[2] - a[0], 0.0) * max(a[3] - a[1], 0.0) + max(b[2] - b[0], 0.0) * max(b[3] - b[1], 0.0) - w * h
    return w * h / union if union > 0 else 0.0


def suppress_overlaps(detections: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Class-aware non-maximum suppression in each frame: the more confident box stays where IoU exceeds the threshold.

    Boxes whose IoU exceeds it have sides of no smaller ratio than it, so a box of a large frame meets those of like size near it.
    """
    order = [-F.col("confidence"), F.col("x1"), F.col("y1"), F.col("detection_id")]
    group = ["frame_index", "class_id"]
    large = None
    if threshold >= 0:
        large = _gridded(group, lambda b: b, lambda b: max(b[2] - b[0], b[3] - b[1]) if b[2] > b[0] and b[3] > b[1] else 0.0, threshold, lambda k, x: _iou(k, x) > threshold)
    return greedy_keep(detections, group, order, lambda k, x: iou(k, x) > threshold, large)


def suppress_close_centers(detections: DataFrame, radius: float = 8.0) -> DataFrame:
    """Of boxes of one class whose centers lie within ``radius`` the more confident one stays."""
    order = [-F.col("confidence"), F.col("x1"), F.col("y1"), F.col("detection_id")]
    group = ["frame_index", "class_id"]

    def around(b: tuple) -> tuple[float, float, float, float]:
        x, y, r = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, radius * 0.51 + 1e-12 * (abs(b[0]) + abs(b[1]) + abs(b[2]) + abs(b[3]))
        return x - r, y - r, x + r, y + r

    distance = lambda k, x: math.hypot((k[0] + k[2]) / 2 - (x[0] + x[2]) / 2, (k[1] + k[3]) / 2 - (x[1] + x[3]) / 2)
    large = _gridded(group, around, lambda b: radius, 1.0, lambda k, x: distance(k, x) <= radius) if radius > 0 else None
    return greedy_keep(detections, group, order, lambda k, x: center_distance(k, x) <= radius, large)


def overlapping_pairs(detections: DataFrame, least: float) -> DataFrame:
    """(frame_index, class_id, a, b, iou): pairs of boxes of one class in one frame that overlap by ``least`` or more, the smaller detection_id first.

    A frame's boxes are one array, as the sensor bounds them; its pairs are made inside of the row, so boxes shuffle once and pairs don't.
    """
    held = detections.groupBy("frame_index", "class_id").agg(F.sort_array(F.collect_list(F.struct("detection_id", "x1", "y1", "x2", "y2"))).alias("_rows"))
    pair = lambda p, q: F.struct(p["detection_id"].alias("a"), q["detection_id"].alias("b"), iou(p, q).alias("iou"))
    later = lambda i: F.slice("_rows", i + 2, F.size("_rows"))
    pairs = F.flatten(F.transform("_rows", lambda p, i: F.filter(F.transform(later(i), lambda q: pair(p, q)), lambda s: s["iou"] >= least)))
    return held.select("frame_index", "class_id", F.explode(pairs).alias("_p")).select("frame_index", "class_id", "_p.*")


def merged_counts(detections: DataFrame, threshold: float, radius: float) -> DataFrame:
    """(frame_index, class_id, raw, after_nms, after_center): boxes before and after both suppressions, each frame's array folded once."""
    box = F.struct((-F.col("confidence")).alias("_k"), "x1", "y1", "detection_id", "x2", "y2")
    held = detections.groupBy("frame_index", "class_id").agg(F.sort_array(F.collect_list(box)).alias("_rows"))
    keep = lambda rows, conflict: F.aggregate(rows, F.slice(rows, 1, 0), lambda out, x: F.when(F.exists(out, lambda k: conflict(k, x)), out).otherwise(F.concat(out, F.array(x))))
    held = held.withColumn("_nms", keep(F.col("_rows"), lambda k, x: iou(k, x) > threshold))
    sizes = F.transform(F.array("_nms"), lambda rows: F.struct(F.size(rows).alias("n"), F.size(keep(rows, lambda k, x: center_distance(k, x) <= radius)).alias("m")))
    held = held.select("frame_index", "class_id", F.size("_rows").cast("long").alias("raw"), F.get(sizes, F.lit(0)).alias("_s"))
    return held.select("frame_index", "class_id", "raw", F.col("_s.n").cast("long").alias("after_nms"), F.col("_s.m").cast("long").alias("after_center"))


def greedy_matching(edges: DataFrame, group: list[str]) -> DataFrame:
    """One-to-one matching of (prev, cur, distance) edges: shortest first, ties by prev and cur, each end once."""
    order = [F.col("distance"), F.col("prev"), F.col("cur")]
    return greedy_keep(edges, group, order, lambda k, x: (k["prev"] == x["prev"]) | (k["cur"] == x["cur"]))


def carried(df: DataFrame, group: list[str], order: list[Column], used: list[str], step: Callable, added: str = "") -> DataFrame:
    """Rows of each group, in ``order``, through ``step(state, *values of used) -> (state, result)``; the state begins as None.

    Without ``added`` the results say which rows stay; with it, they are the values of the added columns (names and types).
    """
    ship(df.sparkSession)
    names = [c.partition(" ")[0] for c in added.split(", ")] if added else []
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    types = [pa.list_(pa.float64()) if c.endswith("array<double>") else {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[c.rpartition(" ")[2]] for c in added.split(", ")] if added else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            at = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: E731,B023
            out = []
            for k, *values in zip(zip(*map(at, group), strict=True), *map(at, used), strict=True):
                if k != key:
                    key, state = k, None
                state, result = step(state, *values)
                out.append(result)
            if names:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])
            else:
                yield batch.filter(pa.array(out, pa.bool_()))

    held = df.repartition(*group).sortWithinPartitions(*group, *order)
    return held.mapInArrow(run, f"{fields}, {added}" if added else fields)


def accepted_at_interval(df: DataFrame, group: list[str], at: str, least: float, order: list[Column]) -> DataFrame:
    """Rows whose ``at`` is ``least`` or more behind the last accepted one; the first of a group is accepted. Rows without ``at`` are left out."""

    def step(last, t):
        ok = t is not None and (last is None or t - last >= least)
        return (t if ok else last), ok

    return carried(df, group, order, [at], step)


def keyframes(path: DataFrame, group: str, step: float) -> DataFrame:
    """(group, frame_index, segment, x, y): frames that begin a segment or lie ``step`` or more from the last keyframe, and the last frame.

    Of rows that repeat a frame the smallest counts; a frame without a position is a keyframe only as the last one.
    """
    held = path.groupBy(group, "frame_index").agg(F.min(F.struct("segment", "x", "y")).alias("_r")).select(group, "frame_index", "_r.*")
    held = held.withColumn("_last", F.lead("frame_index").over(W.partitionBy(group).orderBy("frame_index")).isNull())

    def take(last, segment, x, y, final):
        ok = x is not None and y is not None and (last is None or last[0] != segment or (x - last[1]) ** 2 + (y - last[2]) ** 2 >= step * step)
        return ((segment, x, y) if ok else last), ok or final

    return carried(held, [group], [F.col("frame_index")], ["segment", "x", "y", "_last"], take).drop("_last")


def chained_transforms(edges: DataFrame, group: list[str], size: int = 3, offset: float = 0.0) -> DataFrame:
    """Add ``chain_segment`` and ``chain``: the product of the row-major matrices up to each frame.

    A row whose ``accepted`` is false (the column may be absent) begins a segment anew from the identity, moved by ``offset`` times the
    segment's number in x, so that segments don't overlap on the map. A null matrix is a break too.
    """
    unit = [1.0 if i % (size + 1) == 0 else 0.0 for i in range(size * size)]
    held = edges if "accepted" in edges.columns else edges.withColumn("accepted", F.lit(True))

    def step(state, matrix, accepted):
        segment, m = state or (0, unit)
        if not accepted or matrix is None:
            segment += 1
            m = [*unit]
            m[size - 1] = segment * offset
        else:
            m = [sum(m[size * i + k] * matrix[size * k + j] for k in range(size)) for i in range(size) for j in range(size)]
        return (segment, m), (segment, m)

    out = carried(held, group, [F.col("frame_index")], ["matrix", "accepted"], step, "chain_segment long, chain array<double>")
    return out if "accepted" in edges.columns else out.drop("accepted")


def rotated_chunks(records: DataFrame, group: list[str], size: str, order: str, most: int) -> DataFrame:
    """Add ``chunk``, the number of the file that each record goes to if a file is rotated before a write would make it exceed ``most`` bytes.

    A record that is larger than a file has one of its own.
    """

    def write(state, n):
        used, chunk = state or (0, 0)
        if used and used + n > most:
            used, chunk = 0, chunk + 1
        return (used + n, chunk), (chunk,)

    return carried(records.select(*group, order, size), group, [F.col(order), F.col(size)], [size], write, "chunk int")
