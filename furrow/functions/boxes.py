"""Boxes: conversion, clipping, overlap, mapping between coordinate spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """True for a value that is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    return {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}


def center(a: Column, b: Column) -> Column:
    return (a + b) / 2


def argmax(scores: Column) -> tuple[Column, Column]:
    """Place (from 0, the first of equals) and value of the largest score."""
    top = F.array_max(scores)
    return F.array_position(scores, top) - 1, top


def clip(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """The box inside the frame as a struct; null if a side isn't finite or nothing is left."""
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    box = F.struct(inside(x1, width).alias("x1"), inside(y1, height).alias("y1"), inside(x2, width).alias("x2"), inside(y2, height).alias("y2"))
    return F.when(finite(x1) & finite(y1) & finite(x2) & finite(y2) & (box["x2"] > box["x1"]) & (box["y2"] > box["y1"]), box)


def unletterbox(v: Column, pad: Column, scale: Column) -> Column:
    return (v - pad) / scale


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs; 0 where the union is empty."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def center_distance(a: Column, b: Column) -> Column:
    return F.hypot((a["x1"] + a["x2"]) / 2 - (b["x1"] + b["x2"]) / 2, (a["y1"] + a["y2"]) / 2 - (b["y1"] + b["y2"]) / 2)


def to_display(x: Column, y: Column, width: Column, height: Column, mode: str, rotation: Column, aspect: float = 16 / 9, space: int = 10_000) -> tuple[Column, Column]:
    """Map a source point into 0..space on a display of the given aspect ratio.

    stretch fills both axes; contain keeps the ratio with bars; cover keeps it and crops. Rotation is 0, 90, 180 or 270 degrees
    clockwise. Results are clamped and rounded half to even.
    """
    u, v = x / width, y / height
    r = (width / height) / aspect
    if mode == "contain":
        u, v = F.when(r < 1, (u - 0.5) * r + 0.5).otherwise(u), F.when(r > 1, (v - 0.5) / r + 0.5).otherwise(v)
    elif mode == "cover":
        u, v = F.when(r > 1, (u - 0.5) * r + 0.5).otherwise(u), F.when(r < 1, (v - 0.5) / r + 0.5).otherwise(v)
    ru = F.when(rotation == 90, 1 - v).when(rotation == 180, 1 - u).when(rotation == 270, v).otherwise(u)
    rv = F.when(rotation == 90, u).when(rotation == 180, 1 - v).when(rotation == 270, 1 - u).otherwise(v)
    put = lambda c: F.rint(F.least(F.greatest(c * space, F.lit(0.0)), F.lit(float(space)))).cast("int")
    return put(ru), put(rv)
