"""Queries of text parsing, JSON, hashes and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import boxes, geometry, strings
from furrow.plans.base import query
from furrow.sinks import files
from furrow.sources import protocol, srt

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NOTES = "SELECT event_id, concat('Frame Cnt: ', event_id, ', ISO : ', event_id % 800, ' [Rel_Alt: ', CAST(event_id % 120 AS DOUBLE) / 4, '] Mode: ', event_type, ' x') AS note FROM {events}"


@query(
    """WITH m AS (SELECT event_id, unnest(['Frame Cnt', 'ISO', 'Rel_Alt', 'Mode']) AS raw, unnest([event_id::VARCHAR, (event_id % 800)::VARCHAR, regexp_extract(note, 'Rel_Alt: ([0-9.]+)', 1), event_type || ' x']) AS value FROM (SELECT n.*, regexp_extract(note, 'Mode: ([a-z_]+)', 1) AS event_type FROM n))
SELECT event_id, trim(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '_', 'g'), '_') AS key, value, TRY_CAST(regexp_extract(value, '[-+]?[0-9]+(?:\\.[0-9]+)?') AS DOUBLE) AS number FROM m""",
    n=_NOTES,
)
def kv_extract_normalise(n: DataFrame) -> DataFrame:
    pairs = n.select("event_id", F.explode(srt.key_values(F.col("note"))).alias("p"))
    return pairs.select("event_id", "p.key", "p.value", strings.first_number(F.col("p.value")).alias("number"))


@query(
    "SELECT page_id, sha256(" + "replace(" * len(strings.ENTITIES) + "regexp_replace(html, '<[^>]*>', '', 'g')" + "".join(f", '{k}', {_quoted(v)})" for k, v in strings.ENTITIES.items()) + ") AS text_sha256 FROM h",
    h="SELECT page_id, html FROM {pages}",
)
def html_strip(h: DataFrame) -> DataFrame:
    return h.select("page_id", F.sha2(strings.strip_tags(F.col("html")), 256).alias("text_sha256"))


@query("SELECT event_id, CASE WHEN r IS NULL OR isnan(r) OR isinf(r) THEN NULL ELSE r END AS r FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE ELSE value END AS r FROM e)", e="SELECT event_id, value FROM {events}")
def json_nonfinite_null(e: DataFrame) -> DataFrame:
    """NaN and infinities become null on the way through JSON."""
    r = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).when(F.col("event_id") % 4 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    text = files.finite_json([F.col("event_id"), boxes.finite_or_null(r).alias("r")])
    return e.select(F.from_json(text, "event_id long, r double").alias("j")).select("j.*")


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS sha256 FROM d", d="SELECT doc_id, text FROM {documents}")
def sha256_manifest(d: DataFrame) -> DataFrame:
    listed = files.manifest(d.select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content")))
    return listed.withColumnRenamed("path", "doc_id")


@query("SELECT doc_id, line, pattern FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line FROM d), (VALUES ('digits', '[0-9]{4,}'), ('key', '(?i)secret|token')) v(pattern, p) WHERE regexp_matches(x, p)", d="SELECT doc_id, text FROM {documents}")
def matching_lines(d: DataFrame) -> DataFrame:
    """Numbers of lines that match a pattern, with its name."""
    found = strings.matching_lines(F.col("text"), {"digits": "[0-9]{4,}", "key": "(?i)secret|token"})
    return d.select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.*")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE printf('%.2f', v) END AS shown, chr(CAST(8364 + event_id % 50 AS INT)) || 'x' || chr(CAST(65 + event_id % 26 AS INT)) AS entity FROM e", e="SELECT event_id, CAST(floor(value * 4) / 4 AS DOUBLE) AS v FROM {events}")
def formatted_numbers(e: DataFrame) -> DataFrame:
    """Numbers with two digits or n/a, and numbered entities as characters."""
    code = F.concat(F.lit("&#"), 8364 + F.col("event_id") % 50, F.lit(";x&#x"), F.hex(65 + F.col("event_id") % 26), F.lit(";"))
    return e.select("event_id", strings.number_text(F.when(F.col("event_id") % 7 != 0, F.col("v")), 2).alias("shown"), strings.numbered_entities(code).alias("entity"))


_FILES = "SELECT n_name AS path, CAST(length(n_name) AS BIGINT) AS bytes, n_name AS content FROM {nation}"


@query("SELECT sha256(string_agg(path || chr(0) || bytes || chr(0) || sha256(content), chr(10) ORDER BY path || chr(0) || bytes || chr(0) || sha256(content))) AS fingerprint FROM f", f=_FILES)
def run_fingerprint(f: DataFrame) -> DataFrame:
    return files.fingerprint(files.manifest(f.select("path", F.encode("content", "UTF-8").alias("content"))))


@query(
    """SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock, ms / 1000 AS seconds, 'plant_' || lpad(event_id::VARCHAR, 7, '0') AS plant FROM (SELECT event_id, event_id * 7919 AS ms FROM e)""",
    e="SELECT event_id FROM {events}",
)
def clock_and_ids(e: DataFrame) -> DataFrame:
    seconds = F.col("event_id") * 7919 / 1000
    text = strings.clock(seconds)
    return e.select("event_id", text.alias("clock"), F.round(strings.clock_seconds(text), 3).alias("seconds"), strings.padded_id("plant_", F.col("event_id")).alias("plant"))


@query("SELECT k, CASE WHEN d = 0 THEN NULL ELSE n / d END AS fps FROM t", t="SELECT o_orderkey AS k, CAST(o_orderkey AS DOUBLE) AS n, CAST(o_orderkey % 5 AS DOUBLE) AS d FROM {orders}")
def fraction_rates(t: DataFrame) -> DataFrame:
    text = F.concat(F.col("n").cast("long").cast("string"), F.lit("/"), F.col("d").cast("long").cast("string"))
    return t.select("k", strings.fraction(text).alias("fps"))


@query(
    """SELECT flight, srt_index, srt_index * 1.0 AS start_seconds, srt_index + 0.5 AS end_seconds, event_id::INT AS frame_counter, round(value, 3) AS latitude, (event_id % 800)::INT AS iso FROM e""",
    e="SELECT event_id % 8 AS flight, CAST(floor(event_id / 8) AS INT) AS srt_index, event_id, value FROM {events}",
)
def srt_blocks(e: DataFrame) -> DataFrame:
    """Subtitle files built from telemetry, one for each flight, parsed back to it."""
    stamp = lambda s: F.replace(strings.clock(s), F.lit("."), F.lit(","))
    body = F.format_string("%d\n%s --> %s\n<b>FrameCnt: %d</b>, [iso: %d] [latitude: %.3f] [mode: auto]", "srt_index", stamp(F.col("srt_index") * 1.0), stamp(F.col("srt_index") + 0.5), "event_id", F.col("event_id") % 800, F.col("value"))
    files_ = e.groupBy("flight").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("srt_index", body.alias("b")))), lambda x: x["b"]), "\n\n").alias("value"))
    out = srt.parse_blocks(files_)
    return out.select("flight", "srt_index", "start_seconds", "end_seconds", "frame_counter", "latitude", "iso")


@query(
    """SELECT message_id, detection_id, class_id, round(confidence, 8) AS confidence, round(x1 / 10000, 8) AS x1, round(y1 / 10000, 8) AS y1, round(x2 / 10000, 8) AS x2, round(y2 / 10000, 8) AS y2 FROM b WHERE x2 > x1""",
    b="SELECT l_orderkey AS message_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS detection_id, CAST(l_linenumber % 2 AS INT) AS class_id, l_discount AS confidence, CAST(l_partkey % 5000 AS DOUBLE) AS x1, CAST(l_suppkey % 5000 AS DOUBLE) AS y1, CAST(l_partkey % 5000 + l_linenumber * 100 - 200 AS DOUBLE) AS x2, CAST(l_suppkey % 5000 + 40 AS DOUBLE) AS y2 FROM {lineitem}",
)
def box_protocol_round_trip(b: DataFrame) -> DataFrame:
    """Boxes written as protocol lines and parsed again."""
    text = protocol.write_boxes(b)
    lines = text.select("message_id", F.posexplode(F.split(F.concat(F.col("text"), F.lit("\nEND")), "\n")).alias("line_no", "value"))
    return protocol.parse_results(lines)["boxes"]


@query(
    "SELECT id, round(2 * degrees(atan(t * w / sqrt(w * w + h * h))), 6) AS horizontal, round(2 * degrees(atan(t * h / sqrt(w * w + h * h))), 6) AS vertical FROM (SELECT *, tan(radians(fov) / 2) AS t FROM c)",
    c="SELECT p_partkey AS id, CAST(40 + p_partkey % 60 AS DOUBLE) AS fov, CAST(1000 + p_size * 10 AS DOUBLE) AS w, CAST(700 + p_size AS DOUBLE) AS h FROM {part}",
)
def camera_axes(c: DataFrame) -> DataFrame:
    h, v = geometry.fov_axes(F.col("fov"), F.col("w"), F.col("h"))
    return c.select("id", F.round(h, 6).alias("horizontal"), F.round(v, 6).alias("vertical"))
