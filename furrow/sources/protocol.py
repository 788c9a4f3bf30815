"""The line protocol of results: RESULT, BOX, CONTOUR and END lines to rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

BOX_LIMIT, CONTOUR_LIMIT, POINT_LIMIT = 2048, 64, 128


def parse_results(lines: DataFrame) -> dict[str, DataFrame]:
    """(message_id, line_no, value) to tables ``results``, ``boxes`` and ``contours``; what exceeds the limits or doesn't parse is dropped.

    A message without an END line is incomplete and gives no rows.
    """
    t = lines.withColumn("t", F.split(F.trim("value"), r"\s+"))
    whole = t.where(F.col("t")[0] == "END").select("message_id").distinct()
    t = t.join(whole, "message_id", "left_semi")
    at = lambda i, kind: F.get("t", F.lit(i)).try_cast(kind)
    results = t.where(F.col("t")[0] == "RESULT").select(
        "message_id", at(1, "long").alias("frame_index"), at(2, "long").alias("capture_ns"), at(3, "long").alias("generated_ns"), at(4, "double").alias("latency_ms"),
        at(5, "double").alias("fps"), at(6, "double").alias("p50_ms"), F.get("t", F.lit(7)).alias("status"), at(8, "int").alias("warnings"), at(9, "int").alias("detections"),
        at(10, "int").alias("selected"), at(11, "int").alias("gaps"), at(12, "int").alias("width"), at(13, "int").alias("height"), at(14, "int").alias("stride"),
    ).where("frame_index is not null")
    w = W.partitionBy("message_id").orderBy("line_no")
    boxes = t.where(F.col("t")[0] == "BOX").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= BOX_LIMIT).select(
        "message_id", at(1, "int").alias("detection_id"), at(2, "int").alias("class_id"), at(3, "double").alias("confidence"),
        *[at(4 + i, "double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
    ).where("y2 is not null")
    contours = t.where(F.col("t")[0] == "CONTOUR").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= CONTOUR_LIMIT)
    n = F.least(at(2, "int"), F.lit(POINT_LIMIT), F.floor((F.size("t") - 3) / 2).cast("int"))
    number = lambda i: F.get("t", i).try_cast("double")
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(number(3 + 2 * i).alias("x"), number(4 + 2 * i).alias("y")))
    contours = contours.where(n > 0).select("message_id", at(1, "int").alias("contour_id"), points.alias("points"))
    return {"results": results, "boxes": boxes, "contours": contours}


def write_boxes(boxes: DataFrame, space: float = 10_000.0) -> DataFrame:
    """(message_id, detection_id, class_id, confidence, x1..y2 in 0..space) to one text of BOX lines for each message; empty boxes are dropped."""
    good = boxes.where("x2 > x1 and y2 > y1 and confidence is not null and not isnan(confidence)")
    line = F.format_string("BOX %d %d %.8f %.8f %.8f %.8f %.8f", "detection_id", "class_id", "confidence", *[F.col(c) / space for c in ("x1", "y1", "x2", "y2")])
    listed = F.sort_array(F.collect_list(F.struct("detection_id", line.alias("line"))))
    return good.groupBy("message_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))


def write_results(results: DataFrame, boxes: DataFrame, contours: DataFrame, space: float = 10_000.0) -> DataFrame:
    """One text for each message: its RESULT line, BOX lines, CONTOUR lines and END. Columns as ``parse_results`` gives them, boxes and contour points in 0..space.

    Contours of fewer than three points are dropped, and points beyond the limit.
    """
    names = ["frame_index", "capture_ns", "generated_ns", "latency_ms", "fps", "p50_ms", "status", "warnings", "detections", "selected", "gaps", "width", "height", "stride"]
    head = F.format_string("RESULT %d %d %d %.3f %.3f %.3f %s %d %d %d %d %d %d %d", *names)
    point = lambda p: F.concat_ws(" ", F.format_string("%.8f", p["x"] / space), F.format_string("%.8f", p["y"] / space))
    shown = F.slice("points", 1, POINT_LIMIT)
    line = F.concat_ws(" ", F.lit("CONTOUR"), F.col("contour_id").cast("string"), F.size(shown).cast("string"), F.array_join(F.transform(shown, point), " "))
    rings = contours.where(F.size("points") >= 3).groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("contour_id", line.alias("line")))).alias("_c"))
    held = results.select("message_id", head.alias("_head")).join(write_boxes(boxes, space).withColumnRenamed("text", "_boxes"), "message_id", "left").join(rings, "message_id", "left")
    return held.select("message_id", F.concat_ws("\n", "_head", "_boxes", F.nullif(F.array_join(F.transform("_c", lambda c: c["line"]), "\n"), F.lit("")), F.lit("END")).alias("text"))


def pilot_box(x1: Column, y1: Column, x2: Column, y2: Column, space: int = 10_000) -> Column:
    """Center and size of a box in 0..1 as whole numbers in 0..space (halves away from zero), null if a side has no length."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    put = lambda c: F.round(unit(c) * space).cast("int")
    w, h = x2 - x1, y2 - y1
    box = F.struct(put(x1 + w / 2).alias("cx"), put(y1 + h / 2).alias("cy"), put(w).alias("w"), put(h).alias("h"))
    return F.when((box["w"] > 0) & (box["h"] > 0), box)
