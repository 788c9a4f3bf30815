from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from furrow.sinks import files
from furrow.sources import config, protocol, readers, spool, srt

SRT = """﻿1
00:00:00,000 --> 00:00:00,033
<font size="28">FrameCnt: 1, DiffTime: 33ms
2024-05-01 10:00:00.000
[iso: 100] [shutter: 1/800.0] [fnum: 2.8] [latitude: 41.5] [longitude: -8.25] [rel_alt: 30.5 abs_alt: 120.1] [ct: 5500] [ct: 5600]</font>

2
bad timing --> here
x

3
00:00:00,066 --> 00:00:00,100
gb_yaw : -12.5 gb_pitch : -90.0 mode: auto &amp; on
"""


def test_srt(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT, encoding="utf-8")
    got = {r["srt_index"]: r for r in srt.read_srt(spark, f"file://{tmp_path}").collect()}
    assert {*got} == {1, 3}
    a, b = got[1], got[3]
    assert (a["frame_counter"], a["iso"], a["shutter"], a["aperture"], a["latitude"], a["longitude"]) == (1, 100, "1/800.0", 2.8, 41.5, -8.25)
    assert (a["relative_altitude"], a["absolute_altitude"], a["date_time"], a["start_seconds"], a["end_seconds"]) == (30.5, 120.1, "2024-05-01 10:00:00.000", 0.0, 0.033)
    assert a["extras"] == {"ct": "5600"} and b["gimbal_yaw"] == -12.5 and b["gimbal_pitch"] == -90.0 and b["extras"] == {"mode": "auto & on"} and b["iso"] is None


def frame(mask: int, pad: int = 0, cut: int = 0) -> bytes:
    w, h = 4, 2
    stride = w * 3 + pad
    head = spool.HEADER.pack(spool.MAGIC, 2, 1, 9, 5, 100, 200, 300, w, h, stride, 3, stride * h, *[float(i) for i in range(14)], 50, 4, 17, mask)
    return (head + bytes(stride * h))[: len(head) + stride * h - cut]


def test_spool(spark, tmp_path):
    assert spool.HEADER.size == 196
    for name, data in {"a": frame(0), "b": frame(0x1FF, pad=4), "c": b"short", "d": frame(1, cut=3), "e": b"XXXXXXXX" + frame(0)[8:]}.items():
        (tmp_path / f"{name}.bin").write_bytes(data)
    got = {r["path"][-5]: r for r in spool.read_spool(spark, f"file://{tmp_path}").collect()}
    assert got["a"]["problem"] is None and got["a"]["aircraft_latitude"] is None and got["a"]["rtk_status"] is None and got["a"]["sequence"] == 9
    assert got["b"]["problem"] is None and got["b"]["aircraft_longitude"] == 1.0 and got["b"]["aircraft_heading"] == 6.0 and got["b"]["speed_mps"] == 13.0 and got["b"]["rtk_status"] == 50
    assert all(got[k]["problem"] and got[k]["sequence"] is None for k in "cde")


def test_protocol_limits_and_incomplete_messages(spark):
    text = ["RESULT 7 1 2 3.5 1.0 3.0 ok 0 2 2 -1 1920 1080 5760", "BOX 0 0 0.90000000 0.1 0.2 0.3 0.4", "BOX x", "CONTOUR 0 2 0.1 0.2 0.3 0.4", "NOISE", "END"]
    lines = [(1, i, v) for i, v in enumerate(text)] + [(2, 0, text[0])]
    got = protocol.parse_results(spark.createDataFrame(lines, "message_id long, line_no int, value string"))
    r = got["results"].collect()
    assert len(r) == 1 and (r[0]["frame_index"], r[0]["status"], r[0]["gaps"], r[0]["stride"]) == (7, "ok", -1, 5760)
    assert [x["x2"] for x in got["boxes"].collect()] == [0.3]
    assert [(p["x"], p["y"]) for p in got["contours"].first()["points"]] == [(0.1, 0.2), (0.3, 0.4)]


def test_records_and_areas(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 3}\n')
    (tmp_path / "d.1.jsonl").write_text('{"a": 2}\n')
    assert sorted(r["a"] for r in readers.read_records(spark, f"file://{tmp_path}", "d", "a long").collect() if r["a"]) == [1, 2, 3]
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"plot_id": "p"}, "geometry": {"type": "Polygon", "coordinates": [square, hole]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [hole]]}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    got = readers.read_areas(spark, f"file://{tmp_path}/a.geojson").collect()
    assert len(got) == 4 and [(r["hole"], len(r["xs"])) for r in got if r["area_id"] == 0] == [(False, 5), (True, 5)] and got[0]["properties"] == {"plot_id": "p"}


def test_clean_ring(spark):
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    rows = [(p((0, 0), (0, 0), (1, 0), (1, 1), ("nan", 0), (0, 0)),), (p((0, 0), (1, 1), (0, 0)),)]
    got = [r[0] for r in spark.createDataFrame(rows, "pts array<struct<x:double,y:double>>").select(readers.clean_ring("pts")).collect()]
    assert [(q["x"], q["y"]) for q in got[0]] == [(0, 0), (1, 0), (1, 1)] and got[1] is None


def test_control_and_images(spark, tmp_path):
    (tmp_path / "control").write_text("running = 1\nsnapshot_seq=9\nsnapshot_seq=x\nother=3\nsnapshot_seq=4\n")
    assert {r["key"]: r["value"] for r in readers.read_control(spark, f"file://{tmp_path}/control", {"running": 0, "snapshot_seq": 0, "absent": 7}).collect()} == {"running": 1, "snapshot_seq": 4, "absent": 7}
    for n in ("frame_000012.jpg", "frame_x.jpg", "other.jpg"):
        (tmp_path / n).write_bytes(b"x")
    assert [r["frame_index"] for r in readers.read_frame_images(spark, f"file://{tmp_path}").collect()] == [12]


def test_unsorted_rows(spark):
    keys = [1, 2, 2, 5, 4, 6, 3]
    df = spark.createDataFrame([*enumerate(keys)], "row_id long, frame_index long")
    for bucket in (2, 3, 100):
        assert sorted(r["at"] for r in readers.unsorted_rows(df, "row_id", "frame_index", bucket).collect()) == [4, 6]


def test_paired_media(spark):
    t = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert readers.paired_media(t("/a/Flight1.MP4", "/a/b.mp4"), t("/a/flight1.srt", "/a/c.srt")).count() == 1
    with pytest.raises(ValueError, match="one video"):
        readers.paired_media(t("/a/x.mp4", "/a/y.mp4"), t("/a/z.srt"))


def test_config(tmp_path):
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "p": "${HOME_DIR:-/d}/q"}')
    (tmp_path / "own.json").write_text('{"extends": "base.json", "a": {"y": 5}}')
    assert config.load(tmp_path / "own.json", {}) == {"a": {"x": 1, "y": 5}, "p": "/d/q"}
    (tmp_path / "base.json").write_text('{"extends": "own.json"}')
    with pytest.raises(ValueError, match="extends itself"):
        config.load(tmp_path / "own.json", {})
    assert config.problems({"a": {"x": 3}, "b": True}, {"a.x": (0, 2), "b": (0, 1), "c": (0, 1)}) == ["a.x = 3 isn't in 0..2", "b isn't a number", "c isn't a number"]


def test_shapefile_and_features(spark, tmp_path):
    d = spark.createDataFrame([(1.0, 2.0, "p1", 5), (float("nan"), 0.0, "p2", 6), (3.0, -4.0, "p3", None)], "x double, y double, name string, n int")
    assert files.write_shapefile(d, str(tmp_path / "s.shp"), "x", "y", ["name", "n"]) == 2
    shp = (tmp_path / "s.shp").read_bytes()
    assert struct.unpack(">i", shp[:4])[0] == 9994 and struct.unpack(">i", shp[24:28])[0] * 2 == len(shp) == 100 + 2 * 28
    assert struct.unpack("<4d", shp[36:68]) == (1.0, -4.0, 3.0, 2.0) and struct.unpack("<2d", shp[112:128]) == (1.0, 2.0)
    dbf = (tmp_path / "s.dbf").read_bytes()
    n, head, size = struct.unpack("<IHH", dbf[4:12])
    assert n == 2 and len(dbf) == head + n * size + 1 and dbf[head + 1 : head + 3] == b"p1"
    files.write_features(files.point_features(d, "x", "y", ["name", "n"]), str(tmp_path / "f.geojson"), "plants")
    doc = json.loads((tmp_path / "f.geojson").read_text())
    assert [f["geometry"]["coordinates"] for f in doc["features"]] == [[1.0, 2.0], [3.0, -4.0]] and doc["features"][1]["properties"] == {"name": "p3", "n": None}


def test_rotation_keeps_the_newest(spark, tmp_path):
    rec = spark.createDataFrame([("s", i, "x" * 39) for i in range(10)], "session_id string, sequence long, value string")
    got = files.write_rotated(rec, f"file://{tmp_path}/log", 100, 1).first()
    assert (got["kept"], got["discarded"]) == (4, 6)
    assert spark.read.text(f"file://{tmp_path}/log").count() == 4


def test_json_and_csv(spark, tmp_path):
    files.write_json({"b": float("nan"), "a": [1.5, float("inf")]}, str(tmp_path / "j.json"))
    assert json.loads((tmp_path / "j.json").read_text()) == {"a": [1.5, None], "b": None}
    files.write_csv(spark.range(2).withColumn("extra", F.lit(1)), ["absent", "id"], f"file://{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").columns == ["absent", "id"]


def test_configuration_rules():
    good = {"overlay": {"enabled": True, "stale_result_timeout_ms": 1500, "mode": "compact", "selection_strategy": "confidence", "aspect_mode": "contain", "rotation_degrees": 90}, "registration": {"preview_width": 960, "ratio_test": 0.75}, "roi_mode": "full_frame"}
    assert config.broken(good) == [] and config.broken({}) == []
    bad = {**good, "registration": {"preview_width": 319, "ratio_test": 1}, "overlay": {**good["overlay"], "rotation_degrees": 45, "enabled": 1}, "roi_mode": "x"}
    assert {b.split(" ")[0] for b in config.broken(bad)} == {"registration.preview_width", "registration.ratio_test", "overlay.rotation_degrees", "overlay.enabled", "roi_mode"}
    detector = {"task": "detect", "image_size": 640, "confidence_threshold": 0.2, "nms_iou_threshold": 0.5, "interval_frames": 1, "tile_size": 100, "tile_overlap": 100, "global_nms_iou": 0.5, "max_detections_full_frame": 1}
    segmenter = {"task": "segment", "image_size": 640, "confidence_threshold": 0.2, "nms_iou_threshold": float("nan"), "interval_frames": 1}
    assert [b.split(" ")[0] for b in config.broken({"models": {"detector": detector, "segmenter": segmenter}})] == ["models.detector.tile_overlap", "models.segmenter.nms_iou_threshold"]


def test_entities_and_reports(spark):
    from furrow.functions import strings

    d = spark.createDataFrame([("a &#x1F389;&#233; &lt;b&gt; &amp;#65; <i>x</i> &#0; &#xD800;",)], "t string")
    assert d.select(strings.strip_tags(F.col("t"))).first()[0] == "a 🎉é <b> &#65; x &#0; &#xD800;"
    text = files.markdown("Run", {"frames": 3, "rate": None}, spark.createDataFrame([(1, None)], "a int, b string"))
    assert text == "# Run\n\n- frames: 3\n- rate: n/a\n\n| a | b |\n| --- | --- |\n| 1 | n/a |\n"
    files.renamed_copies({"old": spark.range(2)}, {"old": "new_name"})
    assert spark.table("new_name").count() == 2


def test_bytes_to_text(spark):
    rows = [("a", b"\xff\xfe" + "1\n00:00:00,000 --> 00:00:01,000\niso: 5 é".encode("utf-16le")), ("b", "é".encode("latin-1")), ("c", "\ufeffé".encode())]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "n string, c binary").select("n", srt.decoded(F.col("c"))).collect()}
    assert got["a"].endswith("iso: 5 é") and got["b"] == got["c"] == "é"


def test_texts_that_are_not_utf8(spark):
    """Windows-1252 before Latin-1, which a byte without a meaning there makes it."""
    from furrow.sources.srt import decoded

    rows = [(b"\x93A\x92\x94 \x80 \xe9",), (b"\x93A\x81",), ("\ufeffäö".encode(),), ("ß".encode("utf-16"),), (b"plain",)]
    got = [x[0] for x in spark.createDataFrame(rows, "c binary").select(decoded(F.col("c"))).collect()]
    assert got == ["\u201cA\u2019\u201d \u20ac \u00e9", "\x93A\x81", "äö", "ß", "plain"]


def test_dates_that_no_calendar_has(spark):
    from furrow.sources.srt import parse_blocks

    block = "{}\n00:00:0{},000 --> 00:00:0{},500\n{} iso: 100"
    text = "\n\n".join(block.format(i, i, i, d) for i, d in enumerate(["2024-02-29 10:11:12.5", "2023-02-29 10:11:12", "2024-01-01T25:00:00", "none"], 1))
    got = {x["srt_index"]: (x["date_time"], x["extras"].get("unparsed_date_time")) for x in parse_blocks(spark.createDataFrame([(text,)], "value string")).collect()}
    assert got == {1: ("2024-02-29 10:11:12.5", None), 2: (None, "2023-02-29 10:11:12"), 3: (None, "2024-01-01T25:00:00"), 4: (None, None)}


def test_the_spool_as_a_stream(spark, tmp_path):
    """Each file once, over triggers and a restart, with the rows of the batch reader."""
    (tmp_path / "in").mkdir()
    got, seen = [], []
    for names in ("ab", "cd"):
        for k in names:
            (tmp_path / "in" / f"{k}.bin").write_bytes(b"short" if k == "c" else frame(0x1FF if k == "b" else 1))
        q = spool.stream_spool(spark, f"file://{tmp_path}/in", most_files=1).writeStream.foreachBatch(lambda df, i: (got.extend(df.collect()), seen.append(i))).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    key = lambda x: x["path"][-5]
    assert sorted(got, key=key) == sorted(spool.read_spool(spark, f"file://{tmp_path}/in").collect(), key=key) and len(got) == 4 and len(set(seen)) >= 4


def test_stages_are_resumed(spark, tmp_path):
    """A second run reads; a changed setting or file makes what follows, and nothing else; what was broken off is made again."""
    from furrow.storage import Stages

    spark.range(10).write.parquet(f"file://{tmp_path}/in")

    def flow(times: int, least: int):
        stages = Stages(f"file://{tmp_path}/stages")
        source = spark.read.parquet(f"file://{tmp_path}/in")
        other = stages.stage(spark, "other", [source], {}, lambda: source.where("id = 3"))
        product = stages.stage(spark, "product", [source], {"times": times}, lambda: source.select((F.col("id") * times).alias("v")))
        large = stages.stage(spark, "large", [product, other], {"least": least}, lambda: product.where(F.col("v") >= least))
        return stages.made, sorted(x["v"] for x in large.collect()), next(k for _, k in stages.keys.values() if k.startswith("large"))

    assert flow(2, 14)[:2] == (["other", "product", "large"], [14, 16, 18])
    assert flow(2, 14)[:2] == ([], [14, 16, 18])
    assert flow(2, 16)[:2] == (["large"], [16, 18])
    made, rows, key = flow(3, 14)
    assert (made, rows) == (["product", "large"], [15, 18, 21, 24, 27])
    (tmp_path / "stages" / key / "_SUCCESS").unlink()
    assert flow(3, 14)[:2] == (["large"], [15, 18, 21, 24, 27])
    spark.range(10, 12).write.mode("append").parquet(f"file://{tmp_path}/in")
    assert flow(2, 14)[:2] == (["other", "product", "large"], [14, 16, 18, 20, 22])


def test_json_documents(spark, tmp_path):
    """Objects and lists of them over several lines; what isn't JSON is put aside and not lost."""
    for name, text in {"a": '{\n "n": 1,\n "more": {"k": 2}\n}', "b": '[{"n": 2, "s": "x"},\n {"n": 3}]', "c": "not json", "d": '{"n": "text"}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = [(x["path"][-6], x["n"], x["s"], x["problem"] is None) for x in readers.read_documents(spark, f"file://{tmp_path}", "n long, s string").collect()]
    assert sorted(got, key=str) == [("a", 1, None, True), ("b", 2, "x", True), ("b", 3, None, True), ("c", None, None, False), ("d", None, None, False)]
