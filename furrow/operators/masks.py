"""Masks on sparse tiles: morphology and exact distances. A mask is rows (by, px, py) of set pixels; nothing else is stored."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.operators import spatial
from furrow.functions import gates
from furrow.storage import ship

TILE = 128


def _tiled(cells: DataFrame, by: list[str], halo: int) -> DataFrame:
    """Cells with the tiles (tx, ty) that need them: their own, and those whose border is within ``halo``."""
    tiles = lambda c: F.sequence(F.floor((F.col(c) - halo) / TILE), F.floor((F.col(c) + halo) / TILE))
    held = cells.select(*by, F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py")).where("px is not null and py is not null")
    return held.withColumn("tx", F.explode(tiles("px"))).withColumn("ty", F.explode(tiles("py")))


def _spread(a: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """Each set place sets those within ``radius`` along an axis."""
    n = a.shape[axis]
    sums = np.concatenate([np.zeros_like(a.take([0], axis), np.int64), np.cumsum(a, axis, dtype=np.int64)], axis)
    hi, lo = np.minimum(np.arange(n) + radius + 1, n), np.maximum(np.arange(n) - radius, 0)
    return sums.take(hi, axis) > sums.take(lo, axis)


def _square(a: np.ndarray, radius: int, grow: bool) -> np.ndarray:
    """Dilation or erosion by a square; what lies outside of the array counts as unset for both."""
    if grow:
        return _spread(_spread(a, radius, 0), radius, 1)
    padded = np.pad(~a, radius, constant_values=True)
    return ~_spread(_spread(padded, radius, 0), radius, 1)[radius:-radius, radius:-radius]


_STEPS = {"dilate": (True,), "erode": (False,), "close": (True, False), "open": (False, True)}


def morphology(cells: DataFrame, by: list[str], operation: str, radius: int = 1) -> DataFrame:
    """(by, px, py): the mask dilated, eroded, closed or opened by a square of 2 x ``radius`` + 1 pixels.

    Each tile is dealt with by itself, with a halo of what its steps can reach; only cells near a tile's border go to more than one tile. The mask has no
    frame: pixels that aren't listed are unset wherever they lie, and a dilated mask may reach farther than the given one. Repeated pixels
    count once, pixels without a place are left out, an empty mask stays empty.
    """
    steps = _STEPS[operation]
    halo = radius * len(steps)
    ship(cells.sparkSession)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(key[-2]) * TILE - halo, int(key[-1]) * TILE - halo
        a = np.zeros((TILE + 2 * halo,) * 2, bool)
        a[rows["py"].to_numpy() - y0, rows["px"].to_numpy() - x0] = True
        for grow in steps:
            a = _square(a, radius, grow)
        py, px = np.nonzero(a[halo : halo + TILE, halo : halo + TILE])
        out = pd.DataFrame({"px": px + x0 + halo, "py": py + y0 + halo})
        for i, c in enumerate(by):
            out[c] = pd.Series([key[i]] * len(out), index=out.index, dtype=object if isinstance(key[i], str) else None)
        return out[[*by, "px", "py"]]

    types = "".join(f"`{c}` {cells.schema[c].dataType.simpleString()}, " for c in by)
    return _tiled(cells, by, halo).groupBy(*by, "tx", "ty").applyInPandas(one, f"{types}px long, py long")


def _envelope(g: np.ndarray) -> np.ndarray:
    """Squared distances of a run of pixels to the nearest unset one: the lower envelope of the parabolas (x - i)**2 + g[i]**2, and of those of the unset pixels at both ends."""
    f = np.concatenate([[0], g.astype(np.int64) ** 2, [0]])
    n, at, edge = len(f), [0], [-np.inf]
    for i in range(1, n):
        while True:
            j = at[-1]
            s = ((f[i] + i * i) - (f[j] + j * j)) / (2 * (i - j))
            if s > edge[-1]:
                break
            at.pop()
            edge.pop()
        at.append(i)
        edge.append(s)
    own = np.asarray(at)[np.searchsorted(edge, np.arange(n), "right") - 1]
    return ((np.arange(n) - own) ** 2 + f[own])[1:-1]


def distances(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, px, py, distance): of each set pixel the exact Euclidean distance to the nearest unset one, wherever that lies.

    Two passes. Along columns a pixel's distance follows from the ends of its run, which is a window over the mask's rows. Along rows each run
    of set pixels is one array, whose result is the lower envelope of its parabolas: pixels beyond a run's ends are farther than the unset pixel at its end, so
    no run needs another, and no tile's border matters. A run is as long as a mask is wide at most.
    """
    ship(cells.sparkSession)
    held = cells.select(*by, F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py")).where("px is not null and py is not null").distinct()

    def runs(df: DataFrame, line: str, along: str) -> DataFrame:
        return df.withColumn("_run", F.col(along) - F.row_number().over(W.partitionBy(*by, line).orderBy(along)))

    column = W.partitionBy(*by, "px", "_run")
    held = runs(held, "px", "py")
    held = held.withColumn("_g", F.least(F.col("py") - F.min("py").over(column), F.max("py").over(column) - F.col("py")) + 1).drop("_run")

    @F.pandas_udf("array<long>")
    def squared(runs_: pd.Series) -> pd.Series:
        return pd.Series([_envelope(np.asarray(g)).tolist() for g in runs_])

    rows = runs(held, "py", "px").groupBy(*by, "py", "_run").agg(F.min("px").alias("_x"), F.sort_array(F.collect_list(F.struct("px", "_g"))).alias("_gs"))
    rows = rows.withColumn("_d", squared(F.transform("_gs", lambda s: s["_g"])))
    return rows.select(*by, "py", "_x", F.posexplode("_d").alias("_i", "_v")).select(*by, (F.col("_x") + F.col("_i")).alias("px"), "py", F.sqrt(F.col("_v").cast("double")).alias("distance"))


def gated(points: DataFrame, cells: DataFrame, by: list[str], buffer: float) -> DataFrame:
    """Points (by, x, y) with ``distance`` at their pixel (0 outside of the mask) and ``status``: outside_rejected, boundary_review nearer than ``buffer`` to the border, accepted."""
    held = spatial.raster_at(points, distances(cells, by), by, "distance")
    return held.withColumn("status", gates.mask_gate(F.col("distance") > 0, F.col("distance"), buffer))
