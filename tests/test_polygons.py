from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from furrow.operators import polygons

AREAS = "area_id long, part long, ring_id long, hole boolean, xs array<double>, ys array<double>"


def crossing(px: float, py: float, xs: list[float], ys: list[float]) -> bool:
    odd = False
    for i in range(len(xs)):
        ax, ay, bx, by = xs[i], ys[i], xs[(i + 1) % len(xs)], ys[(i + 1) % len(xs)]
        if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def star(r: random.Random, cx: float, cy: float, size: float, n: int) -> tuple[list[float], list[float]]:
    angles = sorted(r.uniform(0, 2 * np.pi) for _ in range(n))
    return [cx + size * r.uniform(0.4, 1) * float(np.cos(a)) for a in angles], [cy + size * r.uniform(0.4, 1) * float(np.sin(a)) for a in angles]


def test_filled_equals_point_in_polygon(spark):
    r, rows = random.Random(1), []
    for i in range(12):
        cx, cy = r.uniform(0, 40), r.uniform(0, 40)
        rows.append((i, 0, 0, False, *star(r, cx, cy, 15, 9)))
        rows.append((i, 0, 1, True, *star(r, cx, cy, 4, 5)))
        rows.append((i, 1, 0, False, *star(r, cx + 30, cy, 6, 7)))
    rows += [(90, 0, 0, False, [0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0]), (91, 0, 0, False, [0.0, 4.0], [0.0, 4.0]), (92, 0, 0, False, [], []), (93, 0, 0, False, [0.0, float("nan"), 3.0], [0.0, 1.0, 3.0]), (94, 0, 0, False, [0.2, 0.4, 0.3], [0.2, 0.2, 0.4])]
    got = {tuple(x) for x in polygons.filled(spark.createDataFrame(rows, AREAS), tile=7).collect()}
    want = set()
    for i in [*range(12), 90, 94]:
        for px in range(-30, 90):
            for py in range(-30, 70):
                parts = defaultdict(int)
                for row in rows:
                    if row[0] == i:
                        parts[row[1]] ^= crossing(px, py, row[4], row[5])
                if any(parts.values()):
                    want.add((i, px, py))
    assert got == want and len({x for x in got if x[0] == 90}) == 16


def test_overlaps(spark):
    square = lambda i, x: (i, 0, 0, False, [x, x + 10, x + 10, x], [0.0, 0.0, 10.0, 10.0])
    got = polygons.overlaps(spark.createDataFrame([square(1, 0.0), square(2, 4.0), square(3, 50.0)], AREAS)).collect()
    assert [tuple(x) for x in got] == [(1, 2, 60, 0.6)]


def masks() -> dict[int, set[tuple[int, int]]]:
    r = random.Random(3)
    noise = {(x, y) for x in range(12) for y in range(9) if r.random() < 0.55}
    frame = {(x, y) for x in range(8) for y in range(8)} - {(x, y) for x in range(2, 6) for y in range(2, 6)} | {(3, 3)}
    return {1: noise, 2: frame, 3: {(0, 0)}, 4: {(0, 0), (1, 1)}, 5: {(x - 5, -y) for x, y in noise}}


@pytest.mark.parametrize("diagonal", [True, False])
def test_contours_give_the_mask_back(spark, diagonal):
    held = masks()
    rows = [(g, x, y) for g, cells in held.items() for x, y in cells for _ in range(1 + x % 2)]
    rings = polygons.contours(spark.createDataFrame(rows, "g long, px int, py int"), ["g"], diagonal)
    found = rings.orderBy("g", "ring").collect()
    again = polygons.filled(rings.selectExpr("g as area_id", "ring as ring_id", "area < 0 as hole", "xs", "ys"))
    assert {tuple(x) for x in again.collect()} == {(g, x, y) for g, x, y in rows}
    for g, cells in held.items():
        own = [x for x in found if x["g"] == g]
        assert sum(x["area"] for x in own) == len(cells) and [abs(x["area"]) for x in own] == sorted((abs(x["area"]) for x in own), reverse=True)
        assert sum(x["area"] > 0 for x in own) == components(cells, diagonal)
        assert sum(x["area"] < 0 for x in own) == components({(x, y) for x in range(-30, 30) for y in range(-30, 30)} - cells, not diagonal) - 1
        for x in own:  # corners only: the direction changes at each
            d = np.sign(np.diff(np.array([x["xs"], x["ys"]]), append=np.array([[x["xs"][0]], [x["ys"][0]]])))
            assert not (d == np.roll(d, 1, axis=1)).all(0).any()


def components(cells: set[tuple[int, int]], diagonal: bool) -> int:
    left, n = set(cells), 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            x, y = todo.pop()
            near = {(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if diagonal or dx * dy == 0} & left
            left -= near
            todo += near
    return n


def test_contours_without_pixels(spark):
    assert polygons.contours(spark.createDataFrame([], "g long, px int, py int"), ["g"]).count() == 0


def test_largest_contours(spark):
    steps = [(float(i), float(i // 3)) for i in range(30)] + [(29.0, 30.0), (0.0, 30.0)]
    rows = [(1, 1, 700.0, [x for x, _ in steps], [y for _, y in steps]), (1, 2, -600.0, [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]), (1, 3, 4.0, [0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 2.0, 2.0]), (1, 4, 1.0, [0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 1.0])]
    rings = spark.createDataFrame(rows, "g long, ring int, area double, xs array<double>, ys array<double>")
    got = polygons.largest_contours(rings, ["g"], 2.0, ratio=0.01).orderBy("position").collect()
    assert [x["area"] for x in got] == [700.0, 4.0] and len(got[1]["xs"]) == 4 and len(got[0]["xs"]) < 8
    capped = polygons.largest_contours(rings, ["g"], 2.0, most=5).orderBy("position").collect()
    assert [len(x["xs"]) for x in capped] == [5, 4] and [x["position"] for x in capped] == [1, 2]


def test_ring_order_ranks_cycles(spark):
    r, rows, want = random.Random(2), [], {}
    for g, sizes in ((1, [1, 2, 7, 40]), (2, [100])):
        ids = r.sample(range(1000), sum(sizes))
        for n in sizes:
            ring, ids = ids[:n], ids[n:]
            rows += [(g, a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
            k = ring.index(min(ring))
            want |= {(g, e): (min(ring), i, n) for i, e in enumerate(ring[k:] + ring[:k])}
    got = polygons.ring_order(spark.createDataFrame(rows, "g long, e long, next long"), ["g"]).collect()
    assert {(x["g"], x["e"]): (x["root"], x["place"], x["size"]) for x in got} == want


def repair(spark, rings: list[tuple], **more) -> tuple[dict, dict]:
    valid, report = polygons.repaired(spark.createDataFrame(rings, AREAS), **more)
    out = defaultdict(list)
    for x in valid.orderBy("area_id", "part", "ring_id").collect():
        out[x["area_id"]].append((x["part"], x["ring_id"], x["hole"], x["xs"], x["ys"]))
    return dict(out), {x["area_id"]: x for x in report.collect()}


def shoelace(xs: list[float], ys: list[float]) -> float:
    return sum(xs[i] * ys[(i + 1) % len(xs)] - xs[(i + 1) % len(xs)] * ys[i] for i in range(len(xs))) / 2


def box(x0: float, y0: float, x1: float, y1: float) -> tuple[list[float], list[float]]:
    return [x0, x1, x1, x0], [y0, y0, y1, y1]


def test_repair_of_known_faults(spark):
    ring = lambda i, xy, part=0, ring_id=0, hole=False: (i, part, ring_id, hole, [float(v) for v in xy[0]], [float(v) for v in xy[1]])
    rows = [
        ring(1, box(0, 0, 10, 10)),
        ring(2, ([0, 10, 10, 0], [0, 10, 0, 10])),  # bow-tie
        ring(3, ([0, 10, 10, 15, 10, 10, 0], [0, 0, 5, 5, 5, 10, 10])),  # spike
        ring(4, box(0, 0, 10, 10)), ring(4, box(20, 20, 25, 25), ring_id=1, hole=True),  # hole outside of its ring
        ring(5, box(0, 0, 30, 30)), ring(5, box(5, 5, 25, 25), ring_id=1, hole=True), ring(5, box(10, 10, 20, 20), part=1), ring(5, box(12, 12, 14, 14), part=1, ring_id=1, hole=True),  # an island with a lake
        ring(6, ([0, 1, 2], [0, 0, 0])),  # no area
        ring(7, ([0, float("nan"), 2], [0, 0, 3])),
        ring(8, box(0, 0, 10, 10)), ring(8, box(5, 5, 15, 15), part=1),  # overlapping parts
        ring(9, box(0, 0, 10, 10)), ring(9, box(2, 2, 2.5, 2.5), ring_id=1, hole=True), ring(9, box(50, 50, 50.5, 50.5), part=1),  # too small
        ring(10, box(0, 0, 10, 10)), ring(10, ([0, 5, 5], [5, 3, 7]), ring_id=1, hole=True),  # a hole that touches its ring
        ring(11, ([0, 10, 10, 0, 0], [0, 0, 10, 10, 0])),  # closed
        ring(12, box(0, 0, 10, 10)), ring(12, box(10, 0, 20, 10), part=1),  # parts with a common side
        ring(13, box(0, 0, 10, 10)), ring(13, box(2, 2, 6, 6), ring_id=1, hole=True), ring(13, box(4, 4, 8, 8), ring_id=2, hole=True),  # overlapping holes
        ring(14, ([], [])),
    ]
    valid, report = repair(spark, rows)
    seen = {i: (x["status"], x["parts"], x["holes"], round(x["area"], 6)) for i, x in report.items()}
    assert seen[1] == ("unchanged", 1, 0, 100.0) and seen[11] == ("unchanged", 1, 0, 100.0)
    assert seen[2] == ("repaired", 2, 0, 50.0) and seen[3] == ("repaired", 1, 0, 100.0) and seen[4] == ("repaired", 1, 0, 100.0)
    assert seen[5] == ("unchanged", 2, 2, 596.0)
    assert seen[6] == seen[7] == seen[14] == ("unrecoverable", 0, 0, 0.0)
    assert seen[8] == ("repaired", 1, 0, 175.0) and seen[12] == ("repaired", 1, 0, 200.0)
    assert seen[9] == ("repaired", 1, 0, 100.0) and (report[9]["parts_dropped"], report[9]["holes_dropped"]) == (1, 1)
    assert seen[10][:3] == ("unchanged", 1, 1) or seen[10][:3] == ("repaired", 1, 1)
    assert seen[10][3] == 90.0 and seen[13] == ("repaired", 1, 1, 72.0)
    for i, rings in valid.items():
        for _, _, hole, xs, ys in rings:
            assert (shoelace(xs, ys) < 0) == hole and len(set(zip(xs, ys, strict=True))) == len(xs)
        assert sum(shoelace(xs, ys) for *_, xs, ys in rings) == pytest.approx(seen[i][3])


def test_repair_of_random_rings_keeps_what_is_inside(spark):
    """Places inside of some part's outer ring and of no hole of the part before are inside of a repaired part and of none of its holes, and no others."""
    r, rows = random.Random(8), []
    for i in range(14):
        at = lambda: [float(r.randint(0, 40)) for _ in range(r.randint(3, 9))]  # noqa: E731, B023
        for part in range(r.randint(1, 3)):
            xs = at()
            rows.append((i, part, 0, False, xs, [float(r.randint(0, 40)) for _ in xs]))
        xs = at()[:4]
        rows.append((i, 0, 1, True, xs, [float(r.randint(0, 40)) for _ in xs]))
    valid, report = repair(spark, rows, least_area=0.0, least_hole=0.0)
    points = [(r.uniform(-2, 42), r.uniform(-2, 42)) for _ in range(400)]
    wrong = Counter()
    for i in range(14):
        before = [x[1:] for x in rows if x[0] == i]
        for p in points:
            within = {(part, h) for part, _, h, xs, ys in before if crossing(*p, xs, ys)}
            was = any((part, False) in within and (part, True) not in within for part in range(3))
            parts = defaultdict(lambda: [False, False])
            for part, _, hole, xs, ys in valid.get(i, []):
                parts[part][hole] |= crossing(*p, xs, ys)
            wrong[i] += was != any(a and not b for a, b in parts.values())
        assert sum(shoelace(xs, ys) for *_, xs, ys in valid.get(i, [])) == pytest.approx(report[i]["area"])
    assert sum(wrong.values()) == 0 and sum(x["parts"] for x in report.values()) > 20


def test_repair_of_nothing(spark):
    valid, report = polygons.repaired(spark.createDataFrame([], AREAS))
    assert valid.count() == report.count() == 0
