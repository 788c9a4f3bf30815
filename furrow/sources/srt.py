"""Subtitle telemetry: timed blocks of key: value pairs to typed rows, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.strings import clock_seconds, first_number, key, strip_tags

# Names that recorders use for each field.
ALIASES = {
    "framecnt": "frame_counter",
    "frame_count": "frame_counter",
    "difftime": "diff_time_ms",
    "iso": "iso",
    "shutter": "shutter",
    "fnum": "aperture",
    "aperture": "aperture",
    "ev": "exposure",
    "exposure": "exposure",
    "focal_len": "focal_length",
    "focal_length": "focal_length",
    "dzoom_ratio": "digital_zoom",
    "zoom": "digital_zoom",
    "latitude": "latitude",
    "lat": "latitude",
    "longitude": "longitude",
    "lon": "longitude",
    "lng": "longitude",
    "rel_alt": "relative_altitude",
    "relative_altitude": "relative_altitude",
    "abs_alt": "absolute_altitude",
    "absolute_altitude": "absolute_altitude",
    "gps_alt": "gps_altitude",
    "gps_altitude": "gps_altitude",
    "baro_alt": "barometer_altitude",
    "barometer_altitude": "barometer_altitude",
    "heading": "heading",
    "yaw": "yaw",
    "pitch": "pitch",
    "roll": "roll",
    "gb_yaw": "gimbal_yaw",
    "gimbal_yaw": "gimbal_yaw",
    "gb_pitch": "gimbal_pitch",
    "gimbal_pitch": "gimbal_pitch",
    "gb_roll": "gimbal_roll",
    "gimbal_roll": "gimbal_roll",
    "home_distance": "home_distance",
    "home_dist": "home_distance",
    "flight_speed": "flight_speed",
    "speed": "flight_speed",
}
FIELDS = list(dict.fromkeys(ALIASES.values()))
TEXT_FIELDS = ("shutter",)
WHOLE_FIELDS = ("frame_counter", "iso", "diff_time_ms")
# Fixed patterns of the format: the timing line, whose hours may pass 99, and a date.
TIMING = r"(\d+:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d+:\d{2}:\d{2}[,.]\d{3})"
DATE = r"\b\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?\b"
_BLANK = " \t\r\n"
_NAME = "[A-Za-z][A-Za-z0-9_ ]*"
_PAIRS = "array<struct<key:string,value:string>>"


def key_values(text: Column) -> Column:
    """Array of (key, value) of the pairs in a text, keys normalised.

    Brackets, commas and line ends separate groups. A group is cut at its colons: a piece between two colons is the value of the name
    before it, and ends with the name of the next pair if its last words may be one; if not, the value goes on behind the colon.
    """

    def step(s: Column, piece: Column) -> Column:
        name = F.regexp_extract(piece, rf"(?:^|\s)\s*({_NAME}?)\s*$", 1)
        # behind a value there must be something before the name
        inner = F.regexp_extract(piece, rf"^\s*\S.*?\s+({_NAME}?)\s*$", 1)
        body = F.regexp_extract(piece, rf"^(\s*\S.*?)\s+{_NAME}?\s*$", 1)
        open_ = s["name"] != ""
        whole = F.concat(s["value"], F.when(s["value"] == "", body).otherwise(F.concat(F.lit(":"), body)))
        done = F.concat(s["out"], F.array(F.struct(s["name"].alias("key"), whole.alias("value"))))
        longer = F.when(s["value"] == "", piece).otherwise(F.concat(s["value"], F.lit(":"), piece))
        return (
            F.when(~open_, F.struct(s["out"].alias("out"), name.alias("name"), F.lit("").alias("value")))
            .when(inner != "", F.struct(done.alias("out"), inner.alias("name"), F.lit("").alias("value")))
            .otherwise(F.struct(s["out"].alias("out"), s["name"].alias("name"), longer.alias("value")))
        )

    def close(s: Column) -> Column:
        return F.when((s["name"] != "") & (F.btrim(s["value"], F.lit(_BLANK)) != ""), F.concat(s["out"], F.array(F.struct(s["name"].alias("key"), s["value"].alias("value"))))).otherwise(s["out"])

    def group(part: Column) -> Column:
        pieces = F.split(part, ":")
        n = F.size(pieces)
        start = F.struct(F.array().cast(_PAIRS).alias("out"), F.lit("").alias("name"), F.lit("").alias("value"))
        held = F.aggregate(F.slice(pieces, 1, F.greatest(n - 1, F.lit(0))), start, step)
        rest = F.element_at(pieces, -1)
        # the last piece is all value
        last = F.transform(F.array(held), lambda s: close(F.struct(s["out"].alias("out"), s["name"].alias("name"), F.when(s["value"] == "", rest).otherwise(F.concat(s["value"], F.lit(":"), rest)).alias("value"))))
        return F.get(last, F.lit(0))

    parts = F.filter(F.split(text, r"[\]\[,\n]"), lambda x: x.contains(":"))
    found = F.flatten(F.transform(parts, group))
    return F.transform(found, lambda p: F.struct(key(p["key"]).alias("key"), F.btrim(p["value"], F.lit(_BLANK)).alias("value")))


def blocks_of(text: Column) -> Column:
    """Array of blocks, each an array of lines. A block begins with a number alone on the first line or behind an empty one."""
    lines = F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")

    def cut(ls: Column) -> Column:
        begins = lambda i: F.get(ls, i).rlike(r"^\s*\d+\s*$") & ((i == 0) | (F.btrim(F.get(ls, i - 1), F.lit(_BLANK)) == ""))
        starts = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), begins)
        return F.transform(F.array(starts), lambda at: F.transform(at, lambda s, k: F.slice(ls, s + 1, F.coalesce(F.get(at, k + 1), F.size(ls)) - s)))[0]

    return F.transform(F.array(lines), cut)[0]


def parse_blocks(texts: DataFrame, text: str = "value") -> DataFrame:
    """Whole subtitle texts to one row for each block with a valid timing: index, start/end seconds, fields, extras, raw_text.

    Of a field named twice the later value counts; unknown keys go to ``extras``, and so does, as ``unparsed_date_time``, a date that no calendar has. Blocks without a valid timing line give no row; ``report`` counts them.
    """
    own = [c for c in texts.columns if c != text]
    b = texts.select(*own, F.explode(blocks_of(F.col(text))).alias("_b"))
    rest = F.array_join(F.slice("_b", 3, F.greatest(F.size("_b") - 2, F.lit(0))), "\n")
    b = b.select(*own, F.trim(F.get("_b", F.lit(0))).cast("int").alias("srt_index"), F.coalesce(F.get("_b", F.lit(1)), F.lit("")).alias("_t"), F.btrim(rest, F.lit(_BLANK)).alias("raw_text"))
    plain = strip_tags(F.col("raw_text"))
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    known = lambda p: F.struct(alias[p["key"]].alias("field"), p["key"].alias("key"), p["value"].alias("value"), first_number(p["value"]).alias("number"))
    b = b.where(F.col("_t").rlike(TIMING)).withColumn("_pairs", F.transform(key_values(plain), known)).withColumn("_date", F.nullif(F.regexp_extract(plain, DATE, 0), F.lit("")))
    is_date = F.col("_date").try_cast("timestamp_ntz").isNotNull()

    def field(name: str) -> Column:
        good = F.filter("_pairs", lambda p: (p["field"] == name) if name in TEXT_FIELDS else (p["field"] == name) & p["number"].isNotNull())
        last = F.element_at(F.when(F.size(good) > 0, good), -1)
        return (last["value"] if name in TEXT_FIELDS else last["number"].cast("int") if name in WHOLE_FIELDS else last["number"]).alias(name)

    other = F.filter("_pairs", lambda p: p["field"].isNull())
    final = F.filter(other, lambda p, i: ~F.exists(F.slice(other, i + 2, F.size(other)), lambda q: q["key"] == p["key"]))
    entries = F.transform(final, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))
    odd = F.filter(F.array(F.struct(F.lit("unparsed_date_time").alias("key"), F.col("_date").alias("value"))), lambda e: e["value"].isNotNull() & ~is_date & ~F.exists(entries, lambda p: p["key"] == e["key"]))
    return b.select(
        *own, "srt_index", clock_seconds(F.regexp_extract("_t", TIMING, 1)).alias("start_seconds"),
        clock_seconds(F.regexp_extract("_t", TIMING, 2)).alias("end_seconds"), "raw_text", F.when(is_date, F.col("_date")).alias("date_time"), *[field(f) for f in FIELDS],
        F.map_from_entries(F.concat(odd, entries)).alias("extras"),
    )


def report(texts: DataFrame, text: str = "value") -> DataFrame:
    """One row for each text: blocks, those with a valid timing, and of these the ones that have each field."""
    own = [c for c in texts.columns if c != text]
    found = parse_blocks(texts, text).groupBy(*own).agg(F.count(F.lit(1)).alias("parsed"), *[F.count(f).alias(f"{f}_count") for f in FIELDS])
    all_ = texts.groupBy(*own).agg(F.sum(F.size(blocks_of(F.col(text)))).cast("long").alias("blocks"))
    counts = ["parsed", *(f"{f}_count" for f in FIELDS)]
    return all_.join(found, own, "left").fillna(0, counts).withColumn("skipped", F.col("blocks") - F.col("parsed"))


#: The characters of Windows-1252 that stand where Latin-1 has control characters; a few places are empty.
_WINDOWS = {chr(b): c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}
_EMPTY = "".join(chr(b) for b in range(0x80, 0xA0) if chr(b) not in _WINDOWS)


def _western(latin: Column) -> Column:
    return F.when(latin.rlike(f"[{_EMPTY}]"), latin).otherwise(F.translate(latin, "".join(_WINDOWS), "".join(_WINDOWS.values())))


def decoded(content: Column) -> Column:
    """Bytes to text: by the byte order mark, else UTF-8 if valid, else Windows-1252, and Latin-1 if some byte has no meaning there. The mark is dropped."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    utf8 = F.try_validate_utf8(content)
    text = F.when(head(2) == "FFFE", F.decode(content, "UTF-16LE")).when(head(2) == "FEFF", F.decode(content, "UTF-16BE")).when(utf8.isNotNull(), utf8).otherwise(_western(F.decode(content, "ISO-8859-1")))
    return F.regexp_replace(text, "^\ufeff", "")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle files, one text each; the encoding is found from the bytes."""
    raw = spark.read.format("binaryFile").load(path)
    return parse_blocks(raw.select(F.col("path"), decoded(F.col("content")).alias("value")))
