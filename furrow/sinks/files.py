"""Sinks: delimited tables, feature collections, shapefiles, rotated JSON lines and manifests."""

from __future__ import annotations

import json
import math
import os
import struct
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.boxes import finite
from furrow.operators.folds import rotated_chunks

WGS84 = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'


def write_json(value: object, path: str) -> None:
    """A small document, written beside its place and moved there, keys sorted, NaN and infinities as null."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return None if isinstance(v, float) and not math.isfinite(v) else v

    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(plain(value), f, sort_keys=True, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def write_csv(df: DataFrame, fields: list[str], path: str, mode: str = "overwrite") -> None:
    """The named fields in their order; other columns are left out, absent ones are empty. ``append`` adds files, each with a header."""
    have = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields]
    df.select(*have).write.mode(mode).option("header", True).csv(path)


def finite_json(columns: list[Column]) -> Column:
    """JSON of the columns with null for NaN and infinities."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def point_features(df: DataFrame, x: str, y: str, properties: list[str]) -> DataFrame:
    """One feature text for each row with finite coordinates."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return df.where(finite(F.col(x)) & finite(F.col(y))).select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"}).alias("value"))


def polygon_features(df: DataFrame, xs: str, ys: str, properties: list[str]) -> DataFrame:
    """One feature text for each ring, closed."""
    points = F.zip_with(xs, ys, lambda a, b: F.array(a, b))
    closed = F.concat(points, F.slice(points, 1, 1))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"}).alias("value"))


def line_features(df: DataFrame, points: str, properties: list[str]) -> DataFrame:
    """One feature text for each line, an array of (x, y) of two points or more."""
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    return df.where(F.size(points) >= 2).select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"}).alias("value"))


def export_run(tables: dict[str, DataFrame], path: str, summary: dict | None = None) -> dict:
    """A run's tables, each as CSV (<name>_csv) and JSON lines (<name>_jsonl), and their row counts with ``summary`` as JSON (summary). Non-finite numbers are null in JSON."""
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}_csv")
        plain = [F.when(finite(F.col(f.name)), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields]
        df.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/{name}_jsonl")
        counts[name] = df.sparkSession.read.text(f"{path}/{name}_jsonl").count()
    told = {"rows": counts, **(summary or {})}
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    return told


def markdown(title: str, facts: dict[str, object], table: DataFrame | None = None, most: int = 50) -> str:
    """A short report: facts as a list and the first ``most`` rows of a small table."""
    lines = [f"# {title}", "", *(f"- {k}: {'n/a' if v is None or v != v else v}" for k, v in facts.items())]
    if table is not None:
        lines += ["", "| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
        lines += ["| " + " | ".join("n/a" if v is None else str(v) for v in row) + " |" for row in table.limit(most).collect()]
    return "\n".join(lines) + "\n"


def renamed_copies(tables: dict[str, DataFrame], names: dict[str, str]) -> None:
    """Views of tables under the names that older readers ask for."""
    for old, new in names.items():
        tables[old].createOrReplaceTempView(new)


def write_features(features: DataFrame, path: str, name: str) -> None:
    """A feature collection in one file, streamed row by row through the driver: reports are small, and memory holds one partition."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps({"type": "FeatureCollection", "name": name})[:-1] + ', "features": [')
        for i, row in enumerate(features.toLocalIterator()):
            f.write((",\n" if i else "\n") + row["value"])
        f.write("\n]}\n")


def write_shapefile(df: DataFrame, path: str, x: str, y: str, fields: list[str], projection: str = WGS84) -> int:
    """Points and attributes (numbers, else text of 80 bytes) as SHP, SHX, DBF and PRJ; rows without finite coordinates are left out.

    Returns the number of points. For reports: rows are streamed through the driver.
    """
    base = Path(path).with_suffix("")
    numeric = {f.name: f.dataType.typeName() in ("integer", "long", "double", "float", "short") for f in df.schema.fields}
    n, box = 0, [math.inf, math.inf, -math.inf, -math.inf]
    with open(f"{base}.shp", "wb") as shp, open(f"{base}.shx", "wb") as shx, open(f"{base}.dbf", "wb") as dbf:
        shp.write(bytes(100))
        shx.write(bytes(100))
        width = {c: 24 if numeric[c] else 80 for c in fields}
        head = 32 + 32 * len(fields) + 1
        record = 1 + sum(width.values())
        dbf.write(bytes(head))
        for row in df.where(finite(F.col(x)) & finite(F.col(y))).select(x, y, *fields).toLocalIterator():
            px, py = float(row[0]), float(row[1])
            shx.write(struct.pack(">ii", (100 + 28 * n) // 2, 10))
            n += 1
            shp.write(struct.pack(">ii", n, 10) + struct.pack("<idd", 1, px, py))
            box = [min(box[0], px), min(box[1], py), max(box[2], px), max(box[3], py)]
            out = b" "
            for c, v in zip(fields, row[2:], strict=True):
                text = "" if v is None or (isinstance(v, float) and not math.isfinite(v)) else (f"{v:.10g}" if isinstance(v, float) else str(v))
                data = text.encode("utf-8")[: width[c]]
                out += data.rjust(width[c]) if numeric[c] else data.ljust(width[c])
            dbf.write(out)
        dbf.write(b"\x1a")
        if not n:
            box = [0.0] * 4
        for f, size in ((shp, 28), (shx, 8)):
            f.seek(0)
            f.write(struct.pack(">i20xi", 9994, (100 + size * n) // 2) + struct.pack("<ii4d", 1000, 1, *box) + bytes(32))
        dbf.seek(0)
        dbf.write(struct.pack("<BBBBIHH20x", 3, 100, 1, 1, n, head, record))
        for c in fields:
            dbf.write(struct.pack("<11sc4xBB14x", c.encode()[:10], b"N" if numeric[c] else b"C", width[c], 10 if numeric[c] and dict(df.dtypes)[c] in ("double", "float") else 0))
        dbf.write(b"\r")
    Path(f"{base}.prj").write_text(projection, encoding="ascii")
    return n


def write_rotated(records: DataFrame, path: str, most: int, backups: int) -> DataFrame:
    """JSON lines of each session in files of up to ``most`` bytes, the newest ``backups`` + 1 files kept; returns counts of rows kept and discarded.

    ``records`` has (session_id, sequence, value); one directory for each session and file.
    """
    sized = records.withColumn("size", (F.octet_length("value") + 1).cast("long"))
    chunks = rotated_chunks(sized, ["session_id"], "size", "sequence", most)
    last = chunks.groupBy("session_id").agg(F.max("chunk").alias("last"))
    kept = chunks.join(last, "session_id").withColumn("kept", F.col("chunk") >= F.col("last") - backups)
    records.join(kept.where("kept"), ["session_id", "sequence"]).select("session_id", "chunk", "value").write.mode("overwrite").partitionBy("session_id", "chunk").text(path)
    return kept.groupBy("session_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("discarded"))


def manifest(files: DataFrame) -> DataFrame:
    """(path, content) to (path, bytes, sha256)."""
    return files.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def fingerprint(listed: DataFrame) -> DataFrame:
    """One digest over a manifest: SHA-256 of its sorted path, size and digest records. A manifest lists files, not data."""
    record = F.concat_ws("\0", "path", F.col("bytes").cast("string"), "sha256")
    return listed.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(record)), "\n"), 256).alias("fingerprint"))
