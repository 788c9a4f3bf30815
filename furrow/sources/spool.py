"""Binary frame spool: a fixed header with telemetry and validity bits, then rows of pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.gates import valid_if

# Fixed values of the format: first bytes, version, layout (little-endian) and which bit vouches for which fields.
MAGIC, VERSION = b"GPAIFRM2", 2
HEADER = struct.Struct("<8sHHQIQQQIIIII14diiII")
WHOLE = ["sequence", "source_frame_id", "capture_monotonic_ns", "capture_wall_ns", "telemetry_monotonic_ns", "width", "height", "row_stride", "channels", "data_len"]
TELEMETRY = [
    "aircraft_latitude", "aircraft_longitude", "relative_altitude", "absolute_altitude", "aircraft_roll", "aircraft_pitch", "aircraft_yaw",
    "gimbal_roll", "gimbal_pitch", "gimbal_yaw", "velocity_x", "velocity_y", "velocity_z", "speed_mps",
]
STATUS = ["rtk_status", "gps_signal_level", "visible_satellites", "valid_mask"]
BITS = {
    0: ["aircraft_latitude"],
    1: ["aircraft_longitude"],
    2: ["relative_altitude"],
    3: ["absolute_altitude"],
    4: ["gimbal_roll", "gimbal_pitch", "gimbal_yaw"],
    5: ["aircraft_roll", "aircraft_pitch", "aircraft_yaw"],
    6: ["rtk_status"],
    7: ["velocity_x", "velocity_y", "velocity_z", "speed_mps"],
    8: ["gps_signal_level", "visible_satellites"],
}
_SCHEMA = ", ".join(["path string", "problem string", *(f"{c} long" for c in WHOLE), *(f"{c} double" for c in TELEMETRY), *(f"{c} long" for c in STATUS)])


def decode(path: str, data: bytes) -> tuple:
    """The header's values behind what is wrong with the file, if anything."""
    none = [None] * (len(WHOLE) + len(TELEMETRY) + len(STATUS))
    if len(data) < HEADER.size:
        return (path, "shorter than the header", *none)
    magic, version, _, *values = HEADER.unpack_from(data)
    width, height, stride, channels, size = values[5:10]
    if magic != MAGIC or version != VERSION or channels != 3:
        return (path, "unknown magic, version or channels", *none)
    if stride < width * channels or size != stride * height or len(data) != HEADER.size + size:
        return (path, "inconsistent sizes", *none)
    return (path, None, *values)


def _parsed(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        for b in batches:
            rows = pd.DataFrame([decode(p, bytes(c)) for p, c in zip(b["path"], b["content"], strict=True)], columns=names)
            yield rows.astype({c: "Int64" for c in (*WHOLE, *STATUS)} | {c: "float64" for c in TELEMETRY})

    raw = files.select("path", "content").mapInPandas(run, _SCHEMA)
    checked = {c: valid_if(F.col("valid_mask"), bit, F.col(c)) for bit, names in BITS.items() for c in names}
    held = raw.withColumns({c: F.when(~F.isnan(v), v) if c in TELEMETRY else v for c, v in checked.items()})
    return held.withColumn("gps_signal_level", F.when(F.col("gps_signal_level") >= 0, F.col("gps_signal_level"))).withColumn("aircraft_heading", F.col("aircraft_yaw"))


def read_spool(spark: SparkSession, folder: str, pattern: str = "*.bin") -> DataFrame:
    """One row for each file; ``problem`` says why a file was rejected. Telemetry is null unless its validity bit is set."""
    return _parsed(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder))


def stream_spool(spark: SparkSession, folder: str, pattern: str = "*.bin", most_files: int | None = None) -> DataFrame:
    """The spool as a stream: each file once, also over restarts, from any file system that Spark reads; rows as in ``read_spool``. ``most_files`` bounds a micro-batch."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern)
    if most_files is not None:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return _parsed(reader.load(folder))
