"""Fusion of observations into unique plants: association across frames, tracklet merging, support and georeference."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from furrow.functions.boxes import center
from furrow.functions.gates import in_roi, reasons, support_status
from furrow.functions.geometry import from_enu, project
from furrow.operators.folds import carried
from furrow.operators.spatial import radius_pairs
from furrow.operators.statistics import weighted_median
from furrow.storage import checkpointed, ship


def to_local(detections: DataFrame, transforms: DataFrame) -> DataFrame:
    """Add local_x, local_y: box centers through their frame's row-major ``matrix``; null where the divisor vanishes."""
    held = detections.join(transforms.select("frame_index", "matrix"), "frame_index")
    x, y = project([F.get("matrix", F.lit(i)) for i in range(9)], center(F.col("x1"), F.col("x2")), center(F.col("y1"), F.col("y2")))
    return held.withColumn("local_x", x).withColumn("local_y", y).drop("matrix")


def association_radius(spacing: Column, reprojection: Column, least: float = 4.0, share: float = 0.35, times: float = 3.0, cap: float = 0.45) -> Column:
    return F.least(F.greatest(F.lit(least), share * spacing, times * reprojection), cap * spacing)


def radius_sensitivity(pairs: DataFrame, radius: float, factors: tuple[float, ...] = (0.8, 1.0, 1.2)) -> DataFrame:
    """Links kept at each multiple of the radius."""
    counts = pairs.agg(*[F.count_if(F.col("distance") <= f * radius).alias(str(i)) for i, f in enumerate(factors)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(str(i)).alias("links")) for i, f in enumerate(factors)])).alias("_")).select("_.*")


class Tracker:
    """Live tracks of one segment in a grid of cells of the radius; tracks that have aged are dropped."""

    def __init__(self, radius: float, max_gap: int, neighbours: int) -> None:
        self.radius, self.max_gap, self.neighbours = radius, max_gap, neighbours
        self.live: dict[int, tuple[float, float, int, tuple[int, int]]] = {}
        self.cells: dict[tuple[int, int], set[int]] = {}
        self.seen: dict[int, set[int]] = {}  # tracks by the place they were seen at last
        self.count = 0

    def _cell(self, x: float, y: float) -> tuple[int, int]:
        return math.floor(x / self.radius), math.floor(y / self.radius)

    def _drop(self, t: int) -> None:
        _, _, place, cell = self.live.pop(t)
        self.cells[cell].discard(t)
        if not self.cells[cell]:
            del self.cells[cell]
        self.seen[place].discard(t)

    def _put(self, t: int, x: float, y: float, place: int) -> None:
        if t in self.live:
            self._drop(t)
        cell = self._cell(x, y)
        self.live[t] = (x, y, place, cell)
        self.cells.setdefault(cell, set()).add(t)
        self.seen.setdefault(place, set()).add(t)

    def frame(self, place: int, xs: list[float], ys: list[float]) -> list[int]:
        for old in [p for p in self.seen if place - p > self.max_gap]:
            for t in [*self.seen[old]]:
                self._drop(t)
            del self.seen[old]
        finite = [x is not None and y is not None and math.isfinite(x) and math.isfinite(y) for x, y in zip(xs, ys, strict=True)]
        edges = []
        for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
            if finite[k]:
                cx, cy = self._cell(x, y)
                around = [t for i in (-1, 0, 1) for j in (-1, 0, 1) for t in self.cells.get((cx + i, cy + j), ())]
                near = sorted((math.hypot(self.live[t][0] - x, self.live[t][1] - y), t) for t in around)
                edges += [(d, t, k) for d, t in near[: self.neighbours] if d <= self.radius]
        taken, owner = set(), {}
        for _, t, k in sorted(edges):
            if t not in taken and k not in owner:
                taken.add(t)
                owner[k] = t
        for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
            if k not in owner:
                owner[k] = self.count
                self.count += 1
            if finite[k]:
                self._put(owner[k], x, y, place)
        return [owner[k] for k in range(len(xs))]


def associate(observations: DataFrame, radius: float, max_gap: int, neighbours: int = 3, frames: DataFrame | None = None) -> DataFrame:
    """Add ``track_id`` to (segment_id, frame_index, observation_id, x, y).

    Frames are taken in order. Each observation offers edges to its nearest ``neighbours`` live tracks within the radius; edges are taken
    shortest first (then by track and observation), each end once; what is left begins a track. A track lives for ``max_gap`` *processed* frames: ``frames``
    (segment_id, frame_index) has all of them, those without observations too; without it, the frames that have some. Observations without a
    finite position begin tracks that nothing joins. Segments are independent of each other: a segment is a stretch of flight without a
    registration break, and one pass over its sorted rows, which holds the live tracks and one frame.
    """
    ship(observations.sparkSession)
    every = observations.select("segment_id", "frame_index") if frames is None else frames.select("segment_id", "frame_index").unionByName(observations.select("segment_id", "frame_index"))
    place = F.row_number().over(W.partitionBy("segment_id").orderBy("frame_index"))
    places = every.distinct().withColumn("_place", place)
    held = observations.join(places, ["segment_id", "frame_index"]).select(*observations.columns, "_place")
    held = held.repartition("segment_id").sortWithinPartitions("segment_id", "_place", "observation_id")
    names = observations.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracker, at, waiting, done, n = None, (None, None), [], [], 0

        def close() -> None:
            nonlocal n
            frame = pa.Table.from_batches(waiting)
            ids = tracker.frame(at[1], frame["x"].to_pylist(), frame["y"].to_pylist())
            done.append(frame.select(names).append_column("track_id", pa.array(ids, pa.int64())))
            n += frame.num_rows
            waiting.clear()

        def ready() -> Iterator[pa.RecordBatch]:
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done.clear()

        for batch in batches:
            keys = [*zip(batch.column(names.index("segment_id")).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            first = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[first]:
                    if waiting and keys[first] != at:
                        close()
                    if tracker is None or keys[first][0] != at[0]:
                        tracker = Tracker(radius, max_gap, neighbours)
                    at = keys[first]
                    waiting.append(batch.slice(first, i - first))
                    first = i
            if n > 10_000:
                yield from ready()
                n = 0
        if waiting:
            close()
        yield from ready()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in observations.schema.fields)
    return held.mapInArrow(run, f"{fields}, track_id long")


def components(pairs: DataFrame, by: list[str], most_rounds: int = 64) -> DataFrame:
    """(by, id, root): the smallest id that each id of ``pairs`` (by, id, other_id) is connected with.

    Labels go over to neighbours and then jump to their label's label, so the rounds are about the logarithm of the longest way; both are joins and minima, which combine
    in each task. An id without a pair has no row.
    """
    ends = pairs.select(*by, "id", "other_id").unionByName(pairs.select(*by, F.col("other_id").alias("id"), F.col("id").alias("other_id"))).where("id <> other_id").distinct()
    ends = checkpointed(ends)
    labels = checkpointed(ends.groupBy(*by, "id").agg(F.least(F.col("id"), F.min("other_id")).alias("root")))
    for _ in range(most_rounds):
        there = labels.select(*by, F.col("id").alias("other_id"), F.col("root").alias("_near"))
        near = ends.join(there, [*by, "other_id"]).groupBy(*by, "id").agg(F.min("_near").alias("_near"))
        taken = labels.join(near, [*by, "id"]).select(*by, "id", F.col("root").alias("_was"), F.least("root", "_near").alias("root"))
        up = labels.select(*by, F.col("id").alias("root"), F.col("root").alias("_up"))
        taken = checkpointed(taken.join(up, [*by, "root"]).select(*by, "id", "_was", F.least("root", "_up").alias("root")))
        labels = taken.drop("_was")
        if taken.where("root <> _was").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def merge_tracks(tracks: DataFrame, observations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(segment_id, track_id) to ``plant``: tracks within the radius joined shortest first, unless their members share a frame.

    ``pairs`` has (segment_id, id, other_id, distance). The veto depends on what was joined before, but only inside of a component of the pairs, which is the sightings of
    one plant or of a few neighbours; each component is settled by itself, and tracks without a pair, most of them, stay as they are and don't move.
    """
    frames = observations.groupBy("segment_id", "track_id").agg(F.collect_set("frame_index").alias("frames"))
    left = tracks.select("segment_id", "track_id")
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides may come from the same table
    left, pairs = fresh(left), checkpointed(fresh(pairs.select("segment_id", "id", "other_id", "distance")))
    roots = components(pairs, ["segment_id"])
    member = fresh(fresh(roots).withColumnRenamed("id", "track_id").join(fresh(frames), ["segment_id", "track_id"]))
    edges = fresh(pairs.join(fresh(roots), ["segment_id", "id"]))

    def one(key, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        up = {t: t for t in nodes["track_id"]}
        seen = {t: set(f) for t, f in zip(nodes["track_id"], nodes["frames"], strict=True)}

        def top(t):
            while up[t] != t:
                up[t] = up[up[t]]
                t = up[t]
            return t

        for _, a, b in sorted(zip(edges["distance"], edges["id"], edges["other_id"], strict=True)):
            a, b = top(a), top(b)
            if a != b and not seen[a] & seen[b]:
                a, b = min(a, b), max(a, b)
                up[b] = a
                seen[a] |= seen.pop(b)
        ids = sorted(up)
        return pd.DataFrame({"segment_id": key[0], "track_id": ids, "plant": [top(t) for t in ids]})

    keys = ["segment_id", "root"]
    settled = member.groupBy(*keys).cogroup(edges.groupBy(*keys)).applyInPandas(one, "segment_id long, track_id long, plant long")
    alone = left.join(fresh(roots.select("segment_id", F.col("id").alias("track_id"))), ["segment_id", "track_id"], "left_anti").withColumn("plant", F.col("track_id"))
    return settled.unionByName(alone)


def merged_within(tracks: DataFrame, observations: DataFrame, radius: float) -> DataFrame:
    """What ``merge_tracks`` gives for all pairs of ``tracks`` (segment_id, track_id, x, y) within the radius, without making the pairs of tracks that lie on one point.

    Those come first, as nothing is nearer: each goes to the first of its point that it shares no frame with, by id. What they are joined to only grows, so a veto between two such clusters
    holds for good, and the first of their pairs, that of their smallest ids, decides; only these ids are paired.
    """
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    frames = observations.groupBy("segment_id", "track_id").agg(F.collect_set("frame_index").alias("frames"))
    held = tracks.where(finite).select("segment_id", "track_id", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).join(frames, ["segment_id", "track_id"])

    def step(clusters, track, frames):
        clusters = [] if clusters is None else clusters
        for first, seen in clusters:
            if seen.isdisjoint(frames):
                seen.update(frames)
                return clusters, (first,)
        clusters.append((track, {*frames}))
        return clusters, (track,)

    joined = checkpointed(carried(held, ["segment_id", "x", "y"], [F.col("track_id")], ["track_id", "frames"], step, "_first long").drop("frames"))
    firsts = joined.where("track_id = _first").select("segment_id", "track_id", "x", "y")
    seen = observations.select("segment_id", "track_id", "frame_index").join(joined.select("segment_id", "track_id", "_first"), ["segment_id", "track_id"]).select("segment_id", F.col("_first").alias("track_id"), "frame_index")
    settled = merge_tracks(firsts, seen, radius_pairs(firsts.withColumnRenamed("track_id", "id"), radius, ["segment_id"]))
    out = joined.select("segment_id", "track_id", "_first").join(settled.select("segment_id", F.col("track_id").alias("_first"), "plant"), ["segment_id", "_first"]).select("segment_id", "track_id", "plant")
    lost = tracks.where(~F.coalesce(finite, F.lit(False))).select("segment_id", "track_id", F.col("track_id").alias("plant"))
    return out.unionByName(lost)


def unique_plants(observations: DataFrame, by: list[str]) -> DataFrame:
    """One row for each plant of (by, frame_index, observation_id, x, y, confidence)."""
    base = observations.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observation_count"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"),
        F.avg("confidence").alias("mean_confidence"), F.max("confidence").alias("max_confidence"), F.countDistinct("frame_index").alias("temporal_support"),
    )
    for c in ("x", "y"):
        median = weighted_median(observations, by, c, "confidence", ["observation_id"]).withColumnRenamed("weighted_median", f"local_{c}")
        base = base.join(median, by)
    return base


#: Plants and frames that one task compares; more are dealt into parts that meet pairwise.
_MOST_PLANTS, _MOST_FRAMES = 50_000, 100_000


def _times_inside(px: np.ndarray, py: np.ndarray, m: np.ndarray, width: float, height: float) -> np.ndarray:
    """For each point, how many of the row-major transforms ``m`` (9, n) take it into the image.

    Points are halved along the wider side of their box. A transform that takes all corners of a box inside by more than rounding can undo counts for all of its points, one that takes
    all of them past one border for none, and what is left goes on to the halves, or is tested point by point.
    """
    count = np.zeros(len(px), np.int64)

    def image(x, y, m):
        w = m[6] * x + m[7] * y + m[8]
        safe = np.where(np.abs(w) >= 1e-12, w, np.nan)
        return (m[0] * x + m[1] * y + m[2]) / safe, (m[3] * x + m[4] * y + m[5]) / safe

    todo = [(np.arange(len(px)), m)]
    while todo:
        at, m = todo.pop()
        x, y = px[at], py[at]
        x0, x1, y0, y1 = x.min(), x.max(), y.min(), y.max()
        cx, cy = np.array([[x0], [x1], [x1], [x0]]), np.array([[y0], [y0], [y1], [y1]])
        far, high = max(abs(x0), abs(x1)), max(abs(y0), abs(y1))
        w, size = m[6] * cx + m[7] * cy + m[8], np.abs(m)
        least = np.abs(w).min(0)
        sure = (least > 1e-11 + 1e-11 * (size[6] * far + size[7] * high + size[8])) & ((w > 0).all(0) | (w < 0).all(0))
        u, v = image(cx, cy, m)
        rounding = lambda i: 1e-11 * ((size[i] * far + size[i + 1] * high + size[i + 2]) / least) * (1 + (size[6] * far + size[7] * high + size[8]) / least)  # noqa: E731,B023
        du, dv, (u0, u1, v0, v1) = rounding(0), rounding(3), (u.min(0), u.max(0), v.min(0), v.max(0))
        every = sure & (u0 >= du) & (u1 < width - du) & (v0 >= dv) & (v1 < height - dv)
        none = sure & ((u1 < -du) | (u0 >= width + du) | (v1 < -dv) | (v0 >= height + dv))
        count[at] += np.count_nonzero(every)
        m = m[:, ~every & ~none]
        if not m.shape[1]:
            continue
        if len(at) <= 8 or len(at) * m.shape[1] <= 4096 or (x0 == x1 and y0 == y1):
            step = max(1, 2_000_000 // m.shape[1])
            for i in range(0, len(at), step):
                u, v = image(x[i : i + step, None], y[i : i + step, None], m)
                count[at[i : i + step]] += np.count_nonzero((u >= 0) & (u < width) & (v >= 0) & (v < height), 1)
            continue
        order = np.argsort(x if x1 - x0 >= y1 - y0 else y, kind="stable")
        todo += [(at[order[: len(at) // 2]], m), (at[order[len(at) // 2 :]], m)]
    return count


def visibility(plants: DataFrame, frames: DataFrame, width: float, height: float) -> DataFrame:
    """In how many frames each plant (plant_id, x, y) lies inside the image. ``frames`` has (frame_index, x0, y0, x1, y1, inverse).

    x0..y1 is the frame's footprint in local space; plants meet frames by cells of the footprints' median size, whatever the unit, and are counted there without making pairs. Plants
    and frames of a cell are dealt into parts of bounded size, so a task holds one part of each.
    """
    ship(plants.sparkSession)
    cell = (frames.agg(F.median(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 0.0) or 1.0
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    names = [f"m{i}" for i in range(9)]
    f = frames.select("frame_index", "x0", "y0", "x1", "y1", *[F.get("inverse", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]).dropna(subset=names)
    f = f.withColumn("gx", F.explode(span("x0", "x1"))).withColumn("gy", F.explode(span("y0", "y1"))).drop("x0", "y0", "x1", "y1")
    p = plants.select("plant_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    p = p.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    parts = lambda df, most, name: df.groupBy("gx", "gy").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    many = checkpointed(parts(p, _MOST_PLANTS, "_n").join(parts(f, _MOST_FRAMES, "_m"), ["gx", "gy"]))
    mine = lambda c, *by: F.pmod(F.xxhash64(*by), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    p = p.join(many, ["gx", "gy"]).withColumn("_i", mine("_n", "plant_id")).withColumn("_j", each("_m")).drop("_n", "_m")
    f = f.join(many, ["gx", "gy"]).withColumn("_j", mine("_m", "frame_index")).withColumn("_i", each("_n")).drop("_n", "_m", "frame_index")

    def meet(plants: pd.DataFrame, frames: pd.DataFrame) -> pd.DataFrame:
        if not len(plants) or not len(frames):
            return pd.DataFrame({"plant_id": plants["plant_id"].iloc[:0], "n": np.zeros(0, np.int64)})
        with np.errstate(all="ignore"):
            n = _times_inside(plants["x"].to_numpy(float), plants["y"].to_numpy(float), frames[names].to_numpy(float).T.copy(), width, height)
        return pd.DataFrame({"plant_id": plants["plant_id"][n > 0], "n": n[n > 0]})

    keys, spark = ["gx", "gy", "_i", "_j"], plants.sparkSession
    dealt = lambda df: df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys).groupBy(*keys)  # noqa: E731  little data and much work, so parts aren't joined
    seen = dealt(p).cogroup(dealt(f)).applyInPandas(meet, f"plant_id {plants.schema['plant_id'].dataType.simpleString()}, n long")
    seen = seen.groupBy("plant_id").agg(F.sum("n").alias("visibility_opportunity"))
    return plants.join(seen, "plant_id", "left").withColumn("visibility_opportunity", F.coalesce("visibility_opportunity", F.lit(0)))


def with_support(plants: DataFrame) -> DataFrame:
    return plants.withColumn("support_status", support_status(F.col("observation_count"), F.col("visibility_opportunity")))


def registration_gate(edges: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Add ``gate_reasons`` (fixed names) and ``accepted`` to edges with match_count, inlier_count, inlier_ratio, reprojection_error_p95, scale, rotation_deg."""
    c, m = F.col, limits
    why = reasons(
        ("too_few_matches", c("match_count") < m["min_mutual_matches"]),
        ("too_few_inliers", c("inlier_count") < m["min_inliers"]),
        ("low_inlier_ratio", c("inlier_ratio") < m["min_inlier_ratio"]),
        ("high_reprojection_error", c("reprojection_error_p95") > m["max_p95_reprojection"]),
        ("implausible_scale", ~c("scale").between(m["min_scale"], m["max_scale"])),
        ("implausible_rotation", F.abs(c("rotation_deg")) > m["max_rotation_deg"]),
    )
    return edges.withColumn("gate_reasons", why).withColumn("accepted", F.col("gate_reasons") == "accepted")


def georeference_gate(fits: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Add ``gate_reasons`` (fixed names) and ``geo_valid``: valid if no reason holds."""
    c, m = F.col, limits
    why = reasons(
        ("flight_path_cross_track_geometry_underconstrained", c("cross_track_ratio") < m["min_cross_track_ratio"]),
        ("high_pose_alignment_residual", c("p95_residual") > m["max_p95_residual"]),
        ("visual_scale_disagrees_with_assumed_camera_profile", c("scale_disagreement") > m["max_scale_disagreement"]),
        ("visual_motion_direction_inconsistent_with_gps", (c("direction_p50") < m["min_direction_p50"]) | (c("positive_direction") < m["min_positive_direction"])),
        ("camera_not_verified_near_nadir", ~c("near_nadir")),
    )
    return fits.withColumn("gate_reasons", why).withColumn("geo_valid", F.col("gate_reasons") == "accepted")


def georeferenced(points: DataFrame, fit: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Local points to latitude and longitude by the similarity (a, b, shift_x, shift_y) to metres around (lat0, lon0); null unless geo_valid."""
    held = points.join(fit, by, how)
    east = F.col("a") * F.col("x") - F.col("b") * F.col("y") + F.col("shift_x")
    north = F.col("b") * F.col("x") + F.col("a") * F.col("y") + F.col("shift_y")
    lat, lon = from_enu(east, north, F.col("lat0"), F.col("lon0"))
    return held.withColumn("latitude", F.when(F.col("geo_valid"), lat)).withColumn("longitude", F.when(F.col("geo_valid"), lon))
