"""Polygons and masks: filling, contours and repair, as joins of edges.

Areas are rows (area_id, part, ring_id, hole, xs, ys), masks are rows (by, px, py) of set pixels. A pixel's centre has its numbers as
coordinates, so its square reaches half a unit to each side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.functions import geometry
from furrow.operators.spatial import edges_of
from furrow.storage import checkpointed, ship

_MOST_ROUNDS = 64


def filled_spans(areas: DataFrame) -> DataFrame:
    """(area_id, py, x0, x1): the runs of pixels, from x0 to x1 in row py, whose centres lie inside an area.

    The edge table: each edge meets the rows of pixels between its ends (half-open, so a corner counts once); the crossings of a row,
    sorted, bound its spans by the even-odd rule over all rings of a part, so holes need no rule of their own. Parts that overlap give
    overlapping spans. Edges without a finite position and level edges meet no row.
    """
    held = areas if "part" in areas.columns else areas.withColumn("part", F.lit(0))
    e = edges_of(held.where(F.size("xs") >= 3), ["area_id", "part"])
    low, high = F.least("ay", "by_"), F.greatest("ay", "by_")
    finite = F.abs(F.col("ax") + F.col("ay") + F.col("bx") + F.col("by_")) < float("inf")
    e = e.where(finite & (F.ceil(low) < F.ceil(high))).withColumn("py", F.explode(F.sequence(F.ceil(low), F.ceil(high) - 1)))
    # the same expression as in geometry.crosses, so that both agree to the last bit
    at = (F.col("bx") - F.col("ax")) * (F.col("py") - F.col("ay")) / (F.col("by_") - F.col("ay")) + F.col("ax")
    rows = e.groupBy("area_id", "part", "py").agg(F.sort_array(F.collect_list(F.ceil(at))).alias("c"))
    spans = rows.select("area_id", "py", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 1), lambda i: F.struct(F.get("c", 2 * i).alias("x0"), (F.get("c", 2 * i + 1) - 1).alias("x1")))).alias("s"))
    return spans.select("area_id", "py", "s.x0", "s.x1").where("x0 <= x1")


def filled(areas: DataFrame, tile: int = 256) -> DataFrame:
    """(area_id, px, py): the pixels of each area, once each. Spans are cut at tiles before they are spread, so a wide one isn't one row's work."""
    s = filled_spans(areas)
    tiles = F.sequence(F.floor(F.col("x0") / tile), F.floor(F.col("x1") / tile))
    cut = s.withColumn("_t", F.explode(tiles)).select("area_id", "py", F.greatest("x0", F.col("_t") * tile).alias("x0"), F.least("x1", F.col("_t") * tile + tile - 1).alias("x1"))
    return cut.select("area_id", F.explode(F.sequence("x0", "x1")).alias("px"), "py").distinct()


def overlaps(areas: DataFrame) -> DataFrame:
    """(area_id, other_id, pixels, share): pairs of areas, the smaller id first, with the pixels they share and these over the smaller area's.

    Areas meet by pixel, so areas without a common pixel make no pair.
    """
    cells = checkpointed(filled(areas))
    sizes = cells.groupBy("area_id").agg(F.count(F.lit(1)).alias("n"))
    met = cells.join(cells.withColumnRenamed("area_id", "other_id"), ["px", "py"]).where("area_id < other_id").groupBy("area_id", "other_id").agg(F.count(F.lit(1)).alias("pixels"))
    held = met.join(sizes, "area_id").join(sizes.select(F.col("area_id").alias("other_id"), F.col("n").alias("m")), "other_id")
    return held.select("area_id", "other_id", "pixels", (F.col("pixels") / F.least("n", "m")).alias("share"))


def ring_order(links: DataFrame, by: list[str]) -> DataFrame:
    """(by, e, next) to (by, e, root, place, size): the cycles of a permutation, ranked from their smallest element.

    Pointer doubling: each element knows the smallest of its next 2**k and how far it is, so a cycle of n elements takes about log2(n) joins, and no cycle is
    brought into one task. A round in which no smallest element changes is the last.
    """
    state = checkpointed(links.select(*by, "e", F.col("next").alias("jump"), F.col("e").alias("root"), F.lit(0).cast("long").alias("far")))
    step = 1
    for _ in range(_MOST_ROUNDS):
        there = state.select(*by, F.col("e").alias("jump"), F.col("jump").alias("_jump"), F.col("root").alias("_root"), F.col("far").alias("_far"))
        less = F.col("_root") < F.col("root")
        moved = state.join(there, [*by, "jump"]).select(
            *by, "e", F.col("_jump").alias("jump"), F.when(less, F.col("_root")).otherwise(F.col("root")).alias("root"),
            F.when(less, F.col("_far") + step).otherwise(F.col("far")).alias("far"), less.alias("_changed"),
        )
        state, step = checkpointed(moved), step * 2
        if state.where("_changed").isEmpty():
            sizes = state.groupBy(*by, "root").agg(F.count(F.lit(1)).alias("size"))
            return state.join(sizes, [*by, "root"]).select(*by, "e", "root", F.pmod(F.col("size") - F.col("far"), F.col("size")).alias("place"), "size")
        state = state.drop("_changed")
    raise RuntimeError(f"rings still change after {_MOST_ROUNDS} rounds")


def _rings(placed: DataFrame, by: list[str]) -> DataFrame:
    """(by, root, place, x, y) to (by, root, xs, ys)."""
    corners = F.sort_array(F.collect_list(F.struct("place", "x", "y")))
    held = placed.groupBy(*by, "root").agg(corners.alias("c"))
    return held.select(*by, "root", F.transform("c", lambda c: c["x"]).alias("xs"), F.transform("c", lambda c: c["y"]).alias("ys"))


def contours(cells: DataFrame, by: list[str], diagonal: bool = True) -> DataFrame:
    """(by, ring, area, xs, ys): the borders of a mask's components and of their holes, along the sides of pixels, corners only.

    A side belongs to the border if one of its two pixels is set. Borders run with the set pixels on their left, so
    outer rings have a positive area and holes a negative one. Sides in a line are one edge; edges are linked at their ends, and where four
    meet, pixels that touch at a corner stay together (``diagonal``) or part. Rings are numbered by area, the largest first, then by their first corner. Repeated pixels count once; an
    empty mask has no rings.
    """
    side = lambda axis, x, y, d: F.struct(F.lit(axis).alias("axis"), x.alias("x"), y.alias("y"), F.lit(d).alias("d"))
    px, py = F.col("px").cast("long"), F.col("py").cast("long")
    sides = cells.select(*by, F.explode(F.array(side(0, px, py, 0), side(1, px + 1, py, 1), side(0, px, py + 1, 2), side(1, px, py, 3))).alias("s")).select(*by, "s.*")
    border = sides.distinct().groupBy(*by, "axis", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d")).where("n = 1")
    # sides in a row, in their line
    line, along = F.when(F.col("axis") == 0, F.col("y")).otherwise(F.col("x")), F.when(F.col("axis") == 0, F.col("x")).otherwise(F.col("y"))
    runs = border.select(*by, "d", "axis", line.alias("line"), along.alias("at"))
    runs = runs.withColumn("_run", F.col("at") - F.row_number().over(W.partitionBy(*by, "d", "line").orderBy("at")))
    runs = runs.groupBy(*by, "d", "axis", "line", "_run").agg(F.min("at").alias("lo"), (F.max("at") + 1).alias("hi"))
    forth = F.col("d") < 2
    ends = runs.select(*by, "d", "axis", "line", F.when(forth, F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(forth, F.col("hi")).otherwise(F.col("lo")).alias("b"))
    corner = lambda c: (F.when(F.col("axis") == 0, F.col(c)).otherwise(F.col("line")), F.when(F.col("axis") == 0, F.col("line")).otherwise(F.col(c)))
    (ax, ay), (bx, by_) = corner("a"), corner("b")
    edges = checkpointed(ends.select(*by, "d", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by_.alias("by_")))
    key = F.struct(F.col("ay").alias("y"), F.col("ax").alias("x"), F.col("d").alias("d"))
    here = edges.select(*by, key.alias("e"), F.col("bx").alias("_x"), F.col("by_").alias("_y"), "d")
    onward = edges.select(*by, key.alias("next"), F.col("ax").alias("_x"), F.col("ay").alias("_y"), F.col("d").alias("_d"))
    turn = F.pmod(F.col("_d") - F.col("d"), F.lit(4))  # 1 to the left, 3 to the right
    links = here.join(onward, [*by, "_x", "_y"]).groupBy(*by, "e").agg((F.max_by if diagonal else F.min_by)("next", turn).alias("next"))
    placed = ring_order(links, by).select(*by, "root", "place", (F.col("e.x") - 0.5).alias("x"), (F.col("e.y") - 0.5).alias("y"))
    rings = _rings(placed, by).withColumn("area", geometry.shoelace(F.col("xs"), F.col("ys")))
    number = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.abs("area")), "root") if by else W.orderBy(F.desc(F.abs("area")), "root"))
    return rings.withColumn("ring", number).select(*by, "ring", "area", "xs", "ys")


def _far_from(points: np.ndarray, a: int, b: int) -> tuple[int, float]:
    """The point between a and b that is farthest from their segment, and how far."""
    p, q, between = points[a], points[b], points[a + 1 : b]
    along, length = q - p, float(((q - p) ** 2).sum())
    t = np.clip(((between - p) @ along) / length, 0, 1) if length else np.zeros(len(between))
    away = np.sqrt(((between - (p + t[:, None] * along)) ** 2).sum(1))
    k = int(away.argmax())
    return a + 1 + k, float(away[k])


def _simplified(xs: np.ndarray, ys: np.ndarray, epsilon: float) -> np.ndarray:
    """Numbers of the corners that are kept: none that is left out is farther than ``epsilon`` from the line of its neighbours."""
    points = np.column_stack([xs, ys])
    opposite = int(((points - points[0]) ** 2).sum(1).argmax())
    closed, keep = np.vstack([points, points[:1]]), {0, opposite}
    todo = [(0, opposite), (opposite, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        k, away = _far_from(closed, a, b)
        if away > epsilon:
            keep.add(k)
            todo += [(a, k), (k, b)]
    return np.array(sorted(keep))


def largest_contours(rings: DataFrame, by: list[str], least: float, ratio: float = 0.0, most: int = 256) -> DataFrame:
    """(by, position, area, xs, ys): outer rings of an area of ``least`` or more, the largest first, simplified to ``ratio`` of their length.

    A ring of more than ``most`` points is thinned to that many at even distances; one that is left with fewer than three points is left out.
    """
    ship(rings.sparkSession)

    @F.pandas_udf("array<int>")
    def kept(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys, strict=True):
            x, y = np.asarray(x, float), np.asarray(y, float)
            length = float(np.hypot(np.diff(x, append=x[0]), np.diff(y, append=y[0])).sum())
            k = _simplified(x, y, ratio * length)
            out.append((k if len(k) <= most else k[np.linspace(0, len(k) - 1, most).astype(int)]).tolist())
        return pd.Series(out)

    held = rings.where((F.col("area") >= least) & (F.col("area") > 0)).withColumn("_k", kept("xs", "ys")).where(F.size("_k") >= 3)
    pick = lambda c: F.transform("_k", lambda i: F.get(F.col(c), i)).alias(c)
    held = held.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("area"), "ring")))
    return held.select(*by, "position", "area", pick("xs"), pick("ys"))


# Repair. Nodes are where edges of an area meet; between nodes edges are pieces.


def _cells(lo: str, hi: str) -> Column:
    return F.sequence(F.floor(F.col(lo) / F.col("size")), F.floor(F.col(hi) / F.col("size")))


def _noded(edges: DataFrame, digits: int) -> DataFrame:
    """Edges (area_id, ring, hole, n, ax, ay, bx, by_, size) cut at their meetings with others of the area: (area_id, ring, hole, ax, ay, bx, by_)."""
    e = edges.withColumns({"x0": F.least("ax", "bx"), "x1": F.greatest("ax", "bx"), "y0": F.least("ay", "by_"), "y1": F.greatest("ay", "by_")})
    e = e.withColumn("gx", F.explode(_cells("x0", "x1"))).withColumn("gy", F.explode(_cells("y0", "y1")))
    own = ["n", "ax", "ay", "bx", "by_"]
    p, q = (e.select("area_id", "gx", "gy", *[F.col(c).alias(f"{c}{k}") for c in own], F.col("x0").alias(f"x0{k}"), F.col("x1").alias(f"x1{k}"), F.col("y0").alias(f"y0{k}"), F.col("y1").alias(f"y1{k}")) for k in "pq")
    slack = 10.0**-digits
    pairs = p.join(q, ["area_id", "gx", "gy"]).where("np < nq").where((F.col("x0p") <= F.col("x1q") + slack) & (F.col("x0q") <= F.col("x1p") + slack) & (F.col("y0p") <= F.col("y1q") + slack) & (F.col("y0q") <= F.col("y1p") + slack))
    pairs = pairs.select("area_id", *[f"{c}{k}" for k in "pq" for c in own]).distinct()
    rx, ry, sx, sy = F.col("bxp") - F.col("axp"), F.col("by_p") - F.col("ayp"), F.col("bxq") - F.col("axq"), F.col("by_q") - F.col("ayq")
    dx, dy = F.col("axq") - F.col("axp"), F.col("ayq") - F.col("ayp")
    cross, long_p, long_q = rx * sy - ry * sx, F.sqrt(rx * rx + ry * ry), F.sqrt(sx * sx + sy * sy)
    even = F.abs(cross) <= 1e-12 * long_p * long_q
    t, u = (dx * sy - dy * sx) / F.when(~even, cross), (dx * ry - dy * rx) / F.when(~even, cross)
    at = lambda c: F.round(c, digits)
    inside = lambda v, length: (v >= -slack / length) & (v <= 1 + slack / length)
    x, y = at(F.col("axp") + t * rx), at(F.col("ayp") + t * ry)
    point = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    ends = {k: [(F.col(f"ax{k}"), F.col(f"ay{k}")), (F.col(f"bx{k}"), F.col(f"by_{k}"))] for k in "pq"}
    near = lambda px, py, qx, qy: (F.abs(px - qx) <= slack) & (F.abs(py - qy) <= slack)
    # a meeting close to an end is the end
    met = F.when(F.lit(False), point(x, y))
    for ex, ey in [*ends["p"], *ends["q"]]:
        met = met.when(near(x, y, ex, ey), point(ex, ey))
    met = F.when(~even & inside(t, long_p) & inside(u, long_q), met.otherwise(point(x, y)))
    # edges in a line meet at the ends that lie on the other one
    on = lambda px, py, k: geometry.segment_distance(px, py, *ends[k][0], *ends[k][1]) <= slack
    shared = F.array(met, *[F.when(even & on(ex, ey, "q"), point(ex, ey)) for ex, ey in ends["p"]], *[F.when(even & on(ex, ey, "p"), point(ex, ey)) for ex, ey in ends["q"]])
    nodes = pairs.select("area_id", "np", "nq", F.explode(F.filter(shared, lambda s: s.isNotNull())).alias("s"))
    nodes = nodes.select("area_id", F.explode(F.array("np", "nq")).alias("n"), "s").groupBy("area_id", "n").agg(F.collect_set("s").alias("nodes"))
    held = edges.join(nodes, ["area_id", "n"], "left")
    a, b = point(F.col("ax"), F.col("ay")), point(F.col("bx"), F.col("by_"))
    away = lambda s: (s["x"] - F.col("ax")) * (F.col("bx") - F.col("ax")) + (s["y"] - F.col("ay")) * (F.col("by_") - F.col("ay"))
    chain = F.array_sort(F.transform(F.array_union(F.array(a, b), F.coalesce("nodes", F.array().cast("array<struct<x:double,y:double>>"))), lambda s: F.struct(away(s).alias("d"), s["x"].alias("x"), s["y"].alias("y"))))
    held = held.withColumn("_c", chain)
    piece = F.explode(F.transform(F.sequence(F.lit(0), F.size("_c") - 2), lambda i: F.struct(F.get("_c", i).alias("a"), F.get("_c", i + 1).alias("b"))))
    return held.where(F.size("_c") >= 2).select("area_id", "ring", "hole", "n", piece.alias("s")).select("area_id", "ring", "hole", "n", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by_"))


def _faced(pieces: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pieces that part inside from outside, once each, with the inside on their left: (area_id, ax, ay, bx, by_).

    A place is inside if, in some part, an outer ring winds around it an odd number of times and no hole does. Each piece's middle sends a ray, to the right or, if
    the piece is level, upwards; the pieces that it crosses, counted by ring, say which rings are odd on one side, and the rings that run an odd number of times over the piece
    itself change on the other side.
    """
    up = (F.col("ay") < F.col("by_")) | ((F.col("ay") == F.col("by_")) & (F.col("ax") < F.col("bx")))
    turned = [F.when(up, F.col(c)).otherwise(F.col(d)).alias(c) for c, d in (("ax", "bx"), ("ay", "by_"), ("bx", "ax"), ("by_", "ay"))]
    runs = checkpointed(pieces.select("area_id", "ring", "hole", *turned).groupBy("area_id", "ring", "hole", "ax", "ay", "bx", "by_").agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1").drop("odd"))
    place = ["ax", "ay", "bx", "by_"]
    level = F.col("ay") == F.col("by_")
    one = runs.select("area_id", *place).distinct().join(sizes, "area_id")
    # (u, v): along the ray and across it
    mid_u = F.when(level, (F.col("ay") + F.col("by_")) / 2).otherwise((F.col("ax") + F.col("bx")) / 2)
    mid_v = F.when(level, (F.col("ax") + F.col("bx")) / 2).otherwise((F.col("ay") + F.col("by_")) / 2)
    rays = one.select("area_id", *[F.col(c).alias(f"_{c}") for c in place], level.alias("level"), mid_u.alias("u"), mid_v.alias("v"), F.floor(mid_v / F.col("size")).alias("g"))
    across = lambda flat: runs.join(sizes, "area_id").select(
        "area_id", "ring", "hole", *place, F.lit(flat).alias("level"),
        *[F.col(c).alias(n) for c, n in zip(("ay", "ax", "by_", "bx") if flat else place, ("au", "av", "bu", "bv"), strict=True)], "size",
    ).withColumns({"lo": F.least("av", "bv"), "hi": F.greatest("av", "bv")})
    walls = across(True).unionByName(across(False)).withColumn("g", F.explode(_cells("lo", "hi"))).drop("size", "lo", "hi")
    met = rays.join(walls, ["area_id", "level", "g"])
    own = (F.col("_ax") == F.col("ax")) & (F.col("_ay") == F.col("ay")) & (F.col("_bx") == F.col("bx")) & (F.col("_by_") == F.col("by_"))
    hit = ((F.col("av") > F.col("v")) != (F.col("bv") > F.col("v"))) & ((F.col("bu") - F.col("au")) * (F.col("v") - F.col("av")) / (F.col("bv") - F.col("av")) + F.col("au") > F.col("u"))
    keys = ["area_id", *[f"_{c}" for c in place]]
    counted = met.groupBy(*keys, "level", "ring", "hole").agg(F.count_if(hit & ~own).alias("hits"), F.max(own).alias("own"))
    beyond = F.col("hits") % 2 == 1
    behind = beyond != F.col("own")
    both = (("beyond", beyond), ("behind", behind))
    by_part = counted.groupBy(*keys, "level", "ring.part").agg(*[(F.coalesce(F.max(s & ~F.col("hole")), F.lit(False)) & ~F.coalesce(F.max(s & F.col("hole")), F.lit(False))).alias(name) for name, s in both])
    sides = by_part.groupBy(*keys, "level").agg(*[F.max(name).alias(name) for name, _ in both])
    # beyond is to the right of a piece that goes up, and to the left of a level one that goes right
    left, right = F.when(F.col("level"), F.col("beyond")).otherwise(F.col("behind")), F.when(F.col("level"), F.col("behind")).otherwise(F.col("beyond"))
    held = sides.where(left != right).withColumn("_left", left)
    return held.select("area_id", *[F.when(F.col("_left"), F.col(f"_{c}")).otherwise(F.col(f"_{d}")).alias(c) for c, d in (("ax", "bx"), ("ay", "by_"), ("bx", "ax"), ("by_", "ay"))])


def _cycles(xs: list[float], ys: list[float]) -> list[tuple[list[float], list[float]]]:
    """A walk that comes to a place twice, in rings that don't, without the corners that lie in a line."""
    out, stack, at = [], [], {}
    for p in zip(xs, ys, strict=True):
        if p in at:
            ring = stack[at[p] :]
            for q in ring:
                del at[q]
            del stack[len(stack) - len(ring) :]
            out.append(ring)
        at[p] = len(stack)
        stack.append(p)
    out.append(stack)
    return [([x for x, _ in r], [y for _, y in r]) for r in out if len(r) > 2]


def repaired(areas: DataFrame, least_area: float = 1.0, least_hole: float = 1.0, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """Valid areas, and one row for each input area: (area_id, status, parts, holes, parts_dropped, holes_dropped, area).

    What is inside of an outer ring of some part (by the even-odd rule) and of no hole of that part stays: crossings become corners, spikes and doubled edges vanish, outer rings that
    overlap are joined, holes outside of their ring have no effect, islands in holes are parts. Coordinates are rounded to ``digits``. Parts smaller than ``least_area`` and
    holes smaller than ``least_hole`` go. Parts are numbered by area, the largest first, then by their first corner; outer rings run against the clock, holes with it.
    ``status`` is ``unchanged`` if no edge was cut, turned out to be doubled, or went, ``unrecoverable`` if nothing is left (so with an area without a finite corner), else ``repaired``.
    An area with a null id is left out.
    """
    ship(areas.sparkSession)
    held = (areas if "part" in areas.columns else areas.withColumn("part", F.lit(0))).where("area_id is not null")
    held = held.select("area_id", F.struct("part", "ring_id").alias("ring"), "hole", *[F.transform(c, lambda v: F.round(v.cast("double"), digits)).alias(c) for c in ("xs", "ys")])
    named = held.select("area_id").distinct()
    flat = edges_of(held.withColumn("ring_id", F.struct("ring", "hole")).where(F.size("xs") >= 3), ["area_id"])
    finite = F.abs(F.col("ax") + F.col("ay") + F.col("bx") + F.col("by_")) < float("inf")
    flat = flat.where(finite & ((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by_")))).select("area_id", "ring_id.ring", "ring_id.hole", F.monotonically_increasing_id().alias("n"), "ax", "ay", "bx", "by_")
    flat = checkpointed(flat)
    extent = F.greatest(F.max(F.greatest("ax", "bx")) - F.min(F.least("ax", "bx")), F.max(F.greatest("ay", "by_")) - F.min(F.least("ay", "by_")))
    sizes = checkpointed(flat.groupBy("area_id").agg(F.greatest(extent / F.ceil(F.sqrt(F.count(F.lit(1)))), F.lit(10.0**-digits)).alias("size"), F.count(F.lit(1)).alias("edges")))
    pieces = checkpointed(_noded(flat.join(sizes.drop("edges"), "area_id"), digits))
    faced = checkpointed(_faced(pieces, sizes.drop("edges")))
    # of the edges that leave a corner the first with the clock, seen from the one that came, bounds the same face
    key = F.struct("ax", "ay", "bx", "by_")
    here = faced.select("area_id", key.alias("e"), F.col("bx").alias("_x"), F.col("by_").alias("_y"), F.atan2(F.col("ay") - F.col("by_"), F.col("ax") - F.col("bx")).alias("_back"))
    onward = faced.select("area_id", key.alias("next"), F.col("ax").alias("_x"), F.col("ay").alias("_y"), F.atan2(F.col("by_") - F.col("ay"), F.col("bx") - F.col("ax")).alias("_on"))
    links = here.join(onward, ["area_id", "_x", "_y"]).groupBy("area_id", "e").agg(F.min_by("next", F.pmod(F.col("_back") - F.col("_on"), F.lit(2 * np.pi))).alias("next"))
    walks = _rings(ring_order(links, ["area_id"]).select("area_id", "root", "place", F.col("e.ax").alias("x"), F.col("e.ay").alias("y")), ["area_id"])

    @F.pandas_udf("array<struct<xs:array<double>,ys:array<double>>>")
    def cycles(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([[{"xs": a, "ys": b} for a, b in _cycles(list(x), list(y))] for x, y in zip(xs, ys, strict=True)])

    rings = walks.select("area_id", F.explode(cycles("xs", "ys")).alias("r")).select("area_id", "r.xs", "r.ys").withColumn("area", geometry.shoelace(F.col("xs"), F.col("ys")))
    box = {"x0": F.array_min("xs"), "y0": F.array_min("ys"), "x1": F.array_max("xs"), "y1": F.array_max("ys")}
    rings = checkpointed(rings.withColumns(box).withColumn("key", F.struct("x0", "y0", "x1", "y1", F.get("xs", F.lit(0)), F.get("ys", F.lit(0)))))
    outer, holes = rings.where("area > 0"), rings.where("area < 0")
    kept, inner = outer.where(F.col("area") >= least_area), holes.where(-F.col("area") >= least_hole)
    number = F.row_number().over(W.partitionBy("area_id").orderBy(F.desc("area"), "x0", "y0", "x1", "y1", "xs", "ys"))
    kept = checkpointed(kept.withColumn("part", (number - 1).cast("long")))
    nested = checkpointed(_nested(inner, kept))
    # holes take from the area of their part
    lost = nested.groupBy("area_id", "part").agg(F.sum(-F.col("area")).alias("lost"))
    whole = kept.join(lost, ["area_id", "part"], "left").where(F.col("area") - F.coalesce("lost", F.lit(0.0)) >= least_area)
    valid = whole.select("area_id", "part", F.lit(0).cast("long").alias("ring_id"), F.lit(False).alias("hole"), "xs", "ys", "area")
    order = F.row_number().over(W.partitionBy("area_id", "part").orderBy("area", "x0", "y0", "xs", "ys")).cast("long")
    cut = nested.join(whole.select("area_id", "part"), ["area_id", "part"], "left_semi").select("area_id", "part", order.alias("ring_id"), F.lit(True).alias("hole"), "xs", "ys", "area")
    valid = checkpointed(valid.unionByName(cut))
    tally = lambda df, *cols: df.groupBy("area_id").agg(*cols)
    n = F.count(F.lit(1))
    report = named
    for part in (
        tally(valid, F.count_if(~F.col("hole")).alias("parts"), F.count_if("hole").alias("holes"), F.sum("area").alias("area")),
        tally(outer, n.alias("_outer")), tally(holes, n.alias("_inner")), tally(pieces, n.alias("_pieces")), tally(faced, n.alias("_faced")), sizes.select("area_id", "edges"),
        tally(held, n.alias("_rings"), F.count_if("hole").alias("_given"), F.sum(F.size("xs")).alias("_corners")),
    ):
        report = report.join(part, "area_id", "left")
    report = report.fillna(0)
    same = (F.col("_pieces") == F.col("edges")) & (F.col("_faced") == F.col("edges")) & (F.col("parts") + F.col("holes") == F.col("_rings")) & (F.col("holes") == F.col("_given"))
    status = F.when(F.col("parts") == 0, "unrecoverable").when(same, "unchanged").otherwise("repaired")
    report = report.select("area_id", status.alias("status"), "parts", "holes", (F.col("_outer") - F.col("parts")).alias("parts_dropped"), (F.col("_inner") - F.col("holes")).alias("holes_dropped"), F.col("area"))
    return valid.drop("area"), report


def _nested(holes: DataFrame, outer: DataFrame) -> DataFrame:
    """Holes with the part that they lie in: of the outer rings around the middle of their first side the smallest."""
    xs, ys = F.col("xs"), F.col("ys")
    mid = lambda c: (F.get(c, F.lit(0)) + F.get(c, F.lit(1))) / 2
    h = holes.withColumns({"x": mid(xs), "y": mid(ys)})
    o = outer.select(F.col("area_id").alias("_id"), "part", F.col("area").alias("_area"), F.struct("xs", "ys").alias("_ring"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    rx, ry = F.col("_ring.xs"), F.col("_ring.ys")
    k = F.size(rx)
    flips = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0), lambda s, i: s + geometry.crosses(F.col("x"), F.col("y"), F.get(rx, i), F.get(ry, i), F.get(rx, (i + 1) % k), F.get(ry, (i + 1) % k)).cast("int"))
    boxed = F.expr("area_id = _id and x0 >= _x0 and x1 <= _x1 and y0 >= _y0 and y1 <= _y1")
    met = h.join(o, boxed)
    met = met.where(flips % 2 == 1)
    return met.groupBy("area_id", "key").agg(F.min_by("part", "_area").alias("part"), F.first("xs").alias("xs"), F.first("ys").alias("ys"), F.first("area").alias("area"), F.first("x0").alias("x0"), F.first("y0").alias("y0"))
