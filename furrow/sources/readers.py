"""Readers with declared schemas: CSV tables, rotated JSON lines, polygons, frame images, control files, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

DETECTIONS = (
    "frame_index long, video_time_seconds double, detection_id int, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double, "
    "center_x double, center_y double, source_tile_x int, source_tile_y int, source_tile_width int, source_tile_height int, latitude double, longitude double, altitude double, "
    "gimbal_pitch double, srt_sync_status string"
)
FRAME_SUMMARY = (
    "frame_index long, video_time_seconds double, plant_count int, raw_tile_predictions int, after_global_nms int, after_center_suppression int, tile_count int, "
    "inference_ms double, render_ms double, effective_fps double, srt_index int, sync_delta_seconds double, sync_status string"
)
AREAS = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
    return df.select(*columns) if columns else df


def read_records(spark: SparkSession, folder: str, stem: str, schema: str) -> DataFrame:
    """Session records of a stem and its rotated files; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{folder}/{stem}*.jsonl")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, each a whole file with one object or a list of them: a row for each object, with ``path`` and ``problem``.

    ``problem`` is the text of a document that isn't JSON or doesn't fit the schema, whose other columns are then null as far as they couldn't be read; else it is null. Fields that the
    schema doesn't name are left out, and fields that a document lacks are null.
    """
    df = spark.read.schema(f"{schema}, problem string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "problem").json(path)
    return df.select("*", F.col("_metadata.file_path").alias("path"))


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """Polygons and multipolygons of a feature collection: (area_id, properties, part, ring_id, hole, xs, ys), one row for each ring; ring_id counts in its part."""
    doc = spark.read.schema(AREAS).option("multiLine", True).json(path)
    f = doc.select(F.posexplode("features").alias("area_id", "f"))
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    one = F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    polygons = f.select("area_id", F.col("f.properties").alias("properties"), F.posexplode(F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(one)).alias("part", "rings"))
    rings = polygons.select("area_id", "properties", "part", F.posexplode("rings").alias("ring", "points"))
    return rings.select(
        "area_id", "properties", "part", F.col("ring").alias("ring_id"), (F.col("ring") > 0).alias("hole"),
        F.transform("points", lambda p: p[0]).alias("xs"), F.transform("points", lambda p: p[1]).alias("ys"),
    )


def clean_ring(points: str):
    """Finite points without repeats in a row and without the closing one; null if fewer than three different ones stay."""
    ok = F.filter(points, lambda p: F.abs(p["x"]) + F.abs(p["y"]) < float("inf"))
    one = F.filter(ok, lambda p, i: (i == 0) | (p != F.get(ok, i - 1)))
    shut = (F.size(one) > 1) & (F.get(one, F.lit(0)) == F.get(one, F.size(one) - 1))
    out = F.when(shut, F.slice(one, 1, F.greatest(F.size(one) - 1, F.lit(0)))).otherwise(one)
    return F.when(F.size(F.array_distinct(out)) >= 3, out)


def frame_number(path: Column) -> Column:
    """The number in a name like frame_000012.jpg, null for other names."""
    return F.regexp_extract(path, r"(?:^|/)frame_(\d+)\.jpg$", 1).try_cast("long")


def read_frame_images(spark: SparkSession, folder: str) -> DataFrame:
    """frame_*.jpg as (frame_index, path, length); other names are dropped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "frame_*.jpg").load(folder)
    return files.select(frame_number(F.col("path")).alias("frame_index"), "path", "length").where("frame_index is not null")


def parse_control(lines: DataFrame, defaults: dict[str, int], value: str = "value", order: str = "line_no") -> DataFrame:
    """Numbered key=value lines to (key, value): the last whole number of each known key, else its default."""
    part = F.split(value, "=", 2)
    got = lines.select(F.trim(part[0]).alias("key"), F.trim(F.get(part, F.lit(1))).try_cast("int").alias("value"), F.col(order).alias("_n"))
    got = got.where(F.col("key").isin([*defaults]) & F.col("value").isNotNull()).groupBy("key").agg(F.max_by("value", "_n").alias("value"))
    known = lines.sparkSession.createDataFrame([*defaults.items()], "key string, initial int")
    return known.join(got, "key", "left").select("key", F.coalesce("value", "initial").alias("value"))


def read_control(spark: SparkSession, path: str, defaults: dict[str, int]) -> DataFrame:
    """A control file, which is small, read whole so that its lines have numbers."""
    whole = spark.read.option("wholetext", True).text(path)
    return parse_control(whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "value")), defaults)


def missing_shards(wanted: DataFrame, present: DataFrame, key: str = "frame_index") -> DataFrame:
    """Wanted rows whose key isn't present; a null key is always missing, and rows that repeat stay."""
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def unsorted_rows(df: DataFrame, order: str, key: str, bucket: int = 100_000) -> DataFrame:
    """Numbers of rows whose key is smaller than that of the row before; an empty result means the stream is sorted.

    Rows are compared within buckets of row numbers, and the buckets' ends with one another, so no task sees all rows.
    """
    held = df.select(F.col(order).alias("at"), F.col(key).alias("key"), F.floor(F.col(order) / bucket).alias("b"))
    before = F.lag("key").over(W.partitionBy("b").orderBy("at"))
    inside = held.withColumn("before", before).where("key < before").select("at")
    ends = held.groupBy("b").agg(F.min("at").alias("at"), F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"))
    across = ends.join(ends.select((F.col("b") + 1).alias("b"), F.col("last").alias("before")), "b").where("first < before").select("at")
    return inside.unionByName(across)


def paired_media(videos: DataFrame, subtitles: DataFrame) -> DataFrame:
    """(path) tables joined on the case-folded stem; fails unless there is one pair, or one file of each."""
    stem = lambda c: F.lower(F.regexp_extract(c, r"([^/]+?)\.[^./]*$", 1))
    v, s = videos.withColumn("stem", stem("path")), subtitles.withColumn("stem", stem("path")).withColumnRenamed("path", "subtitle_path")
    both = v.join(s, "stem")
    if both.limit(2).count() == 1:
        return both
    if v.limit(2).count() == 1 and s.limit(2).count() == 1:
        return v.join(s.drop("stem"))
    raise ValueError("there must be one video and one subtitle file with the same stem")
