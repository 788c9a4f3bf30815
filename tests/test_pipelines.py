"""The whole way from detections to gaps on a made flight, and a made session."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from furrow import pipelines
from furrow.operators import fusion


def test_gap_report_finds_the_missing_plants(spark):
    """A field of 12 rows of 20 plants, turned by 20 degrees, seen by four shifted frames; one place and one run of two are empty."""
    r, angle = random.Random(1), math.radians(20)
    empty = {(8, 5), (3, 9), (4, 9)}
    field = {(i, j): (400 + 40 * i * math.cos(angle) - 60 * j * math.sin(angle), 100 + 40 * i * math.sin(angle) + 60 * j * math.cos(angle)) for i in range(20) for j in range(12)}
    boxes, frames = [], []
    for f in range(4):
        dx, dy = 11.0 * f, 7.0 * f
        frames.append((f, 0, [1.0, 0.0, dx, 0.0, 1.0, dy, 0.0, 0.0, 1.0], [1.0, 0.0, -dx, 0.0, 1.0, -dy, 0.0, 0.0, 1.0], dx, dy, dx + 2000, dy + 2000))
        for n, (k, (x, y)) in enumerate(sorted(field.items())):
            if k not in empty:
                x, y = x - dx + r.uniform(-0.5, 0.5), y - dy + r.uniform(-0.5, 0.5)
                boxes.append((f, 0, 0.9, x - 9, y - 9, x + 9, y + 9, 2 * n))
                boxes.append((f, 0, 0.6, x - 8, y - 9, x + 10, y + 9, 2 * n + 1))  # found twice
        boxes.append((f, 0, 0.1, 50.0, 50.0, 70.0, 70.0, 9999))
    d = spark.createDataFrame(boxes, "frame_index long, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double, detection_id long")
    t = spark.createDataFrame(frames, "frame_index long, segment_id long, matrix array<double>, inverse array<double>, x0 double, y0 double, x1 double, y1 double")
    areas = spark.createDataFrame([(7, 0, False, [-500.0, 3000.0, 3000.0, -500.0], [-500.0, -500.0, 3000.0, 3000.0]), (8, 0, False, [5000.0, 5100.0, 5100.0], [0.0, 0.0, 100.0])], "area_id long, ring_id long, hole boolean, xs array<double>, ys array<double>")
    out = pipelines.gap_report(d, t, areas, pipelines.GapSettings(image=(2000.0, 2000.0)))
    plants = out["plants"].collect()
    assert len(plants) == 240 - len(empty) and all(p["support_status"] == "confirmed" and p["temporal_support"] == 4 and p["plot_id"] == 7 and p["segment_id"] == 0 for p in plants)
    assert out["rows"].select("row_id").distinct().count() == 12 and out["expected"].count() == 240
    gaps = sorted(out["gaps"].collect(), key=lambda g: g["estimated_missing_plants"])
    assert [g["estimated_missing_plants"] for g in gaps] == [1, 2]
    x, y = field[8, 5]
    assert gaps[0]["local_x"] == pytest.approx(x, abs=1.0) and gaps[0]["local_y"] == pytest.approx(y, abs=1.0) and gaps[0]["coverage_count"] == 4
    assert gaps[0]["square"][2]["x"] - gaps[0]["square"][0]["x"] == pytest.approx(8.0)
    summary = {s["plot_id"]: s for s in out["summary"].collect()}
    assert summary[7]["estimated_missing_plants"] == 3 and summary[7]["missing_rate"] == pytest.approx(3 / 240)
    assert summary[8]["analysis_status"] == "insufficient_unique_plants" and summary[8]["missing_rate"] is None and summary[8]["rows"] == summary[8]["row_segments"] == 0
    assert (summary[7]["rows"], summary[7]["row_segments"], summary[7]["row_segment_cuts"], summary[7]["short_fragments_discarded"]) == (12, 12, 0, 0)
    assert (summary[7]["confirmed_unique_plants"], summary[7]["low_support_unique_plants"], summary[7]["candidates_before_gates"]) == (237, 0, 3)
    assert summary[7]["orientation_deg"] == pytest.approx(20, abs=0.5) and summary[7]["along_row_spacing"] == pytest.approx(40, abs=1) and summary[7]["cross_row_spacing"] == pytest.approx(60, abs=2)
    totals = out["totals"].first()
    assert (totals["plots"], totals["analysed"], totals["rows"], totals["gap_count"], totals["estimated_missing_plants"], totals["expected_capacity"]) == (2, 1, 12, 2, 3, 240)
    fit = spark.createDataFrame([(7, 0.5, 0.0, 10.0, -20.0, 48.0, 11.0, True, "path_fit", "usable", 2.5)], "plot_id long, a double, b double, shift_x double, shift_y double, lat0 double, lon0 double, geo_valid boolean, geo_method string, geo_quality string, horizontal_uncertainty_m double")
    again = pipelines.gap_report(d, t, areas, pipelines.GapSettings(image=(2000.0, 2000.0), association=None), fit)
    placed = sorted(again["gaps"].collect(), key=lambda g: g["estimated_missing_plants"])
    assert [g["estimated_missing_plants"] for g in placed] == [1, 2] and placed[0]["geo_quality"] == "usable" and placed[0]["horizontal_uncertainty_m"] == 2.5
    assert placed[0]["latitude"] == pytest.approx(48 + math.degrees((0.5 * placed[0]["local_y"] - 20) / 6_378_137)) and again["plants"].where("latitude is null").count() == 0
    lost = fusion.georeferenced(out["gaps"].withColumnsRenamed({"local_x": "x", "local_y": "y"}), fit.withColumn("geo_valid", F.lit(False)), ["plot_id"], "left")
    assert lost.where("latitude is null and geo_method = 'path_fit'").count() == 2
    assert [g["gap_id"] for g in out["gaps"].orderBy("plot_id", "row_id", "start_slot").collect()] == ["gap_000001", "gap_000002"]


def test_gap_report_gates(spark):
    """A field with a strip cut out of its middle: a plant of low support is present, an empty place near the border is rejected, one near a suspicious sighting is halved, and no slot lies in the strip."""
    low, near_border, doubtful, empty = (4, 2), (1, 5), (20, 7), (14, 8)
    field = {(i, j): (100 + 40.0 * i, 100 + 104.0 * j) for i in range(30) for j in range(10) if not 8 <= i <= 10}
    frames, boxes = [], []
    for f in range(4):
        move = 5.0 * f
        # two frames see the left half only, so a single sighting on the left has four opportunities and one on the right two
        x1 = 500.0 if f > 1 else 2000.0
        frames.append((f, 0, [1.0, 0.0, move, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [1.0, 0.0, -move, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], move, 0.0, 2000.0, 2000.0))
        for n, (k, (x, y)) in enumerate(sorted(field.items())):
            if k in (near_border, doubtful, empty) or (k == low and f) or x - move > x1:
                continue
            boxes.append((f, 0, 0.9, x - move - 9, y - 9, x - move + 9, y + 9, n))
    x, y = field[doubtful]
    boxes.append((0, 0, 0.9, x + 12 - 9, y - 9, x + 12 + 9, y + 9, 5000))  # once, though four frames could see it
    d = spark.createDataFrame(boxes, "frame_index long, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double, detection_id long")
    t = spark.createDataFrame(frames, "frame_index long, segment_id long, matrix array<double>, inverse array<double>, x0 double, y0 double, x1 double, y1 double")
    left, right = ([60.0, 400.0, 400.0, 60.0], [60.0, 60.0, 1100.0, 1100.0]), ([510.0, 1340.0, 1340.0, 510.0], [60.0, 60.0, 1100.0, 1100.0])
    areas = spark.createDataFrame([(0, 0, False, *left), (0, 1, False, *right)], "area_id long, part int, hole boolean, xs array<double>, ys array<double>")
    status = {"suspicious": 5}  # the low-support plant is seen once and could be seen by four
    out = pipelines.gap_report(d, t, areas, pipelines.GapSettings(image=(4000.0, 2000.0), boundary=2.1, **status))
    by = {r["support_status"]: r["n"] for r in out["plants"].groupBy("support_status").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by["low_support"] == 2 and out["expected"].where("x > 400 and x < 510").count() == 0
    assert out["rows"].select("row_id").distinct().count() == 20
    gaps = {(round(g["local_x"]), round(g["local_y"])): g for g in out["gaps"].collect()}
    assert {*gaps} == {tuple(map(round, field[empty]))}
    rejected = out["rejected"].collect()
    assert [(round(r["x"]), round(r["y"]), r["rejection_reason"]) for r in rejected] == [(*map(round, field[near_border]), "polygon_boundary_exclusion_buffer")]
    told = out["summary"].first()
    assert (told["rows"], told["row_segments"], told["row_segment_cuts"], told["short_fragments_discarded"]) == (10, 20, 10, 0) and told["low_support_unique_plants"] == 2
    assert told["suppressed_by_low_support"] == 2 and told["rejected_boundary"] == 1 and told["rejected_coverage"] == 0
    doubted = pipelines.gap_report(d, t, areas, pipelines.GapSettings(image=(4000.0, 2000.0), boundary=2.1))
    both = {(round(g["local_x"]), round(g["local_y"])): g for g in doubted["gaps"].collect()}
    half = both[tuple(map(round, field[doubtful]))]
    assert half["evidence_status"] == "review_near_suspicious_support" and half["gap_confidence"] < 0.6 * both[tuple(map(round, field[empty]))]["gap_confidence"]
    assert "nearby_suspicious_singletons=1|confidence_downgraded" in doubted["missing"].where("nearby_suspicious_count > 0").first()["reasons"]


def test_live_gaps(spark):
    """A field of 5 rows of 10 with one empty place gives 49 plants and one gap there; few plants aren't judged."""
    r, angle = random.Random(2), math.radians(21)
    at = lambda i, j: (300 + 40 * i * math.cos(angle) - 90 * j * math.sin(angle), 90 + 40 * i * math.sin(angle) + 90 * j * math.cos(angle))
    plants = [("a", 10 * j + i, *(v + r.uniform(-0.5, 0.5) for v in at(i, j))) for j in range(5) for i in range(10) if (i, j) != (5, 2)]
    plants += [("b", k, 10.0 * k, 0.0) for k in range(5)] + [("a", 999, float("nan"), 0.0)]
    out = pipelines.live_gaps(spark.createDataFrame(plants, "session_id string, plant_id long, x double, y double"))
    gap = out["gaps"].collect()
    assert len(gap) == 1 and gap[0]["local_x"] == pytest.approx(at(5, 2)[0], abs=4.0) and gap[0]["local_y"] == pytest.approx(at(5, 2)[1], abs=4.0)
    told = {s["session_id"]: (s["plants"], s["gap_count"], s["status"], s["reason"]) for s in out["sessions"].collect()}
    assert told == {"a": (49, 1, "gaps_found", None), "b": (5, None, "NOT_EVALUATED", "insufficient_plants")}


def test_live_session(spark, tmp_path):
    box = "struct<confidence:double,class_id:int,x1:double,y1:double,x2:double,y2:double>"
    schema = f"session_id string, sequence long, started timestamp, captured timestamp, seconds double, detections array<{box}>"
    rows = [("s", i, 10, t, float(t), [(0.1 * k, 0, 0.0, 0.0, 1.0, 1.0) for k in range(10)]) for i, t in enumerate([5, 10, 11, 13, 14, 16])] + [("s", 3, 10, 13, 13.0, [])]
    raw = spark.createDataFrame([(a, b, c, d, e, f) for a, b, c, d, e, f in rows], schema.replace("timestamp", "long"))
    raw.withColumn("started", F.timestamp_seconds("started")).withColumn("captured", F.timestamp_seconds("captured")).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    got = []
    stream = pipelines.live_session(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), 3.0, 4)
    q = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["sequence"] for r in got) == [1, 3, 5]
    one = next(r for r in got if r["sequence"] == 1)
    assert len(one["shown"]) == 4 and one["shown"][0]["confidence"] == pytest.approx(0.9) and one["truncated"] == 3
