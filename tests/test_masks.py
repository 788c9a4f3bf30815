from __future__ import annotations

import random

import pytest

from furrow.operators import masks

SIDE = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]


def made() -> set[tuple[int, int]]:
    """Across tile borders, with negative places, holes and lone pixels."""
    r = random.Random(6)
    blob = {(x, y) for x in range(-20, 40) for y in range(100, 150) if (x - 8) ** 2 + 2 * (y - 127) ** 2 < 700 and r.random() < 0.97}
    return blob | {(r.randint(-140, 140), r.randint(-20, 150)) for _ in range(150)} | {(127, y) for y in range(120, 136)} | {(128, y) for y in range(120, 136)}


def grown(cells: set, radius: int) -> set:
    return {(x + dx, y + dy) for x, y in cells for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)}


def shrunk(cells: set, radius: int) -> set:
    return {(x, y) for x, y in cells if grown({(x, y)}, radius) <= cells}


def frame(spark, cells: set):
    return spark.createDataFrame([("a", x, y) for x, y in cells] + [("b", x + 7, y) for x, y in list(cells)[:200] * 2] + [("b", None, 3)], "g string, px int, py int")


@pytest.mark.parametrize("radius", [1, 3])
@pytest.mark.parametrize("operation", ["dilate", "erode", "close", "open"])
def test_morphology_equals_brute_force(spark, operation, radius):
    cells = made()
    want = {"dilate": lambda c: grown(c, radius), "erode": lambda c: shrunk(c, radius), "close": lambda c: shrunk(grown(c, radius), radius), "open": lambda c: grown(shrunk(c, radius), radius)}[operation]
    got = [tuple(x) for x in masks.morphology(frame(spark, cells), ["g"], operation, radius).collect()]
    assert len(got) == len(set(got))
    assert {x[1:] for x in got if x[0] == "a"} == want(cells) and {x[1:] for x in got if x[0] == "b"} == want({(x + 7, y) for x, y in list(cells)[:200]})


def test_distances_equal_brute_force(spark):
    cells = made()
    unset = grown(cells, 1) - cells
    got = {(x["px"], x["py"]): x["distance"] for x in masks.distances(frame(spark, cells), ["g"]).where("g = 'a'").collect()}
    assert got == {(x, y): min((x - u) ** 2 + (y - v) ** 2 for u, v in unset) ** 0.5 for x, y in cells} and max(got.values()) > 3


def test_gated_points(spark):
    cells = spark.createDataFrame([(1, x, y) for x in range(9) for y in range(9)], "g long, px long, py long")
    points = spark.createDataFrame([(1, 4.2, 3.9, "a"), (1, 0.4, 4.0, "b"), (1, 9.0, 4.0, "c"), (2, 4.0, 4.0, "d"), (1, 2.0, 2.0, "e")], "g long, x double, y double, k string")
    got = {x["k"]: (x["status"], x["distance"]) for x in masks.gated(points, cells, ["g"], 3.0).collect()}
    assert got == {"a": ("accepted", 5.0), "b": ("boundary_review", 1.0), "c": ("outside_rejected", 0.0), "d": ("outside_rejected", 0.0), "e": ("accepted", 3.0)}


def test_nothing(spark):
    none = spark.createDataFrame([], "px long, py long")
    assert masks.morphology(none, [], "close").count() == masks.distances(none, []).count() == 0
