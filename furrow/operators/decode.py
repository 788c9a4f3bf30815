"""Raw model outputs, which are array columns, to boxes and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import boxes
from furrow.operators import folds, statistics


def _anchors(output: Column, features: int, scores: tuple[int, int], rest: tuple[int, int] | None = None) -> Column:
    """An output [features][n] or [n][features] as an array of (x, y, w, h, scores, rest); another shape is an error when it is read."""
    whole = lambda r: F.size(r) == features
    tall = F.size(output) == features
    bad = F.raise_error(F.format_string("an output of %d x %d isn't xywh and scores of %d features", F.size(output), F.coalesce(F.size(F.get(output, F.lit(0))), F.lit(0)), F.lit(features)))
    value = lambda i, k: F.when(tall, F.get(F.get(output, F.lit(k)), i)).otherwise(F.get(F.get(output, i), F.lit(k))).cast("double")
    span = lambda i, of: F.array(*[value(i, k) for k in range(*of)])
    n = F.when(tall, F.size(F.get(output, F.lit(0)))).when(F.forall(output, whole), F.size(output)).otherwise(bad.cast("int"))
    one = lambda i: F.struct(*[value(i, k).alias(c) for k, c in enumerate(("x", "y", "w", "h"))], span(i, scores).alias("scores"), (span(i, rest) if rest else F.array().cast("array<double>")).alias("rest"), i.alias("anchor"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<struct<x:double,y:double,w:double,h:double,scores:array<double>,rest:array<double>,anchor:int>>"))


def _found(outputs: DataFrame, features: int, scores: tuple[int, int], rest: tuple[int, int] | None, threshold: float, overlap: float, most: int) -> DataFrame:
    """Boxes in model space that suppression leaves: (frame_index, detection_id, class_id, confidence, x1, y1, x2, y2, rest). Anchors under the threshold aren't spread."""
    best = lambda a: F.array_max(a["scores"])
    sure = F.filter(_anchors(F.col("output"), features, scores, rest), lambda a: boxes.finite(best(a)) & (best(a) >= threshold))
    a = outputs.select("frame_index", F.explode(sure).alias("a"))
    c = F.col
    held = a.select("frame_index", c("a.anchor").cast("long").alias("detection_id"), (F.array_position("a.scores", F.array_max("a.scores")) - 1).cast("int").alias("class_id"), F.array_max("a.scores").alias("confidence"), *[v.alias(k) for k, v in boxes.from_center(c("a.x"), c("a.y"), c("a.w"), c("a.h")).items()], c("a.rest").alias("rest"))
    kept = folds.suppress_overlaps(held, overlap)
    return statistics.ranked(kept, ["frame_index"], [F.desc("confidence"), c("detection_id")], most, "_place").drop("_place")


def detections(outputs: DataFrame, metas: DataFrame, names: list[str], threshold: float = 0.25, overlap: float = 0.45, most: int = 300) -> DataFrame:
    """Outputs (frame_index, output) of 4 + classes rows or columns to (frame_index, detection_id, class_id, class_name, confidence, x1, y1, x2, y2) in the frame.

    ``metas`` (frame_index, scale, pad_left, pad_top, width, height) say how the frame was fitted into the model's input. The class is the
    first of the largest scores; scores that aren't finite are below any threshold; the ``most`` most confident boxes that suppression leaves
    stay; those with nothing inside the frame go. A null output, and a frame without a meta, has no detections.
    """
    found = _found(outputs.where("output is not null"), 4 + len(names), (4, 4 + len(names)), None, threshold, overlap, most)
    held = found.join(metas, "frame_index")
    c = F.col
    back = {k: boxes.unletterbox(c(k), c("pad_left" if k[0] == "x" else "pad_top"), c("scale")) for k in ("x1", "y1", "x2", "y2")}
    box = boxes.clip(*back.values(), c("width"), c("height"))
    held = held.withColumn("_box", box).where("_box is not null")
    name = F.get(F.array(*[F.lit(n) for n in names]), c("class_id"))
    return held.select("frame_index", "detection_id", "class_id", name.alias("class_name"), "confidence", "_box.x1", "_box.y1", "_box.x2", "_box.y2")


def segments(outputs: DataFrame, prototypes: DataFrame, coefficients: int = 32, threshold: float = 0.25, overlap: float = 0.45, most: int = 300) -> DataFrame:
    """(frame_index, px, py): pixels of the prototypes' grid that some instance covers.

    ``outputs`` (frame_index, output) have 4 + 1 + ``coefficients`` rows or columns, ``prototypes`` (frame_index, px, py, p) the values of all prototypes at a pixel. An instance covers a pixel if the
    product of its coefficients and the pixel's prototypes isn't negative (a logistic of one half or more). A frame's few instances are one array, which joins its pixels; products that aren't numbers
    cover nothing.
    """
    found = _found(outputs.where("output is not null"), 5 + coefficients, (4, 5), (5, 5 + coefficients), threshold, overlap, most)
    held = prototypes.join(found.groupBy("frame_index").agg(F.collect_list("rest").alias("_c")), "frame_index")
    product = lambda k: F.aggregate(F.zip_with(k, F.col("p"), lambda a, b: a * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    covers = F.exists("_c", lambda k: F.coalesce(boxes.finite(product(k)) & (product(k) >= 0), F.lit(False)))
    return held.where(covers).select("frame_index", "px", "py")


def to_frame(cells: DataFrame, metas: DataFrame, stride: float) -> DataFrame:
    """Pixels of the prototypes' grid (frame_index, px, py), ``stride`` input pixels wide, as the frame's pixels (frame_index, px, py) whose middles lie in them."""
    c = F.col
    held = cells.join(metas, "frame_index")

    def span(cell: str, pad: str, size: str) -> Column:
        low = lambda k: F.ceil((k * stride - c(pad)) / c("scale") - 0.5)
        first, last = F.greatest(low(c(cell)), F.lit(0)), F.least(low(c(cell) + 1) - 1, c(size).cast("long") - 1)
        return F.when(first <= last, F.sequence(first, last))

    held = held.select("frame_index", F.explode(span("px", "pad_left", "width")).alias("_x"), "py", "pad_top", "scale", "height")
    return held.select("frame_index", c("_x").alias("px"), F.explode(span("py", "pad_top", "height")).alias("_y")).select("frame_index", "px", c("_y").alias("py"))
