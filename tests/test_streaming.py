"""Stateful operators over several batches give what their batch twins give over all rows."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.operators import folds, sync
from furrow.streaming import stateful

SCHEMA = "g long, n long, t double, v double, s string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    return [(i % 3, i, i + r.random(), r.random() if r.random() < 0.3 else None, r.choice(["IDLE", "STARTING", "RUNNING", "STOPPING"])) for i in range(120)]


def run(spark, rows, make, tmp_path, batches=4):
    """In files of rows in order, one for each trigger."""
    step = len(rows) // batches
    for k in range(batches):
        df = spark.createDataFrame(rows[k * step : (k + 1) * step], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = []
    q = make(stream).writeStream.foreachBatch(lambda df, _: got.append(df.toPandas())).option("checkpointLocation", f"file://{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(got) >= batches
    return pd.concat(got)


def test_rate_limit(spark, rows, tmp_path):
    got = run(spark, rows, lambda s: stateful.rate_limited(s, "g", "t", 10.0), tmp_path)
    want = folds.accepted_at_interval(spark.createDataFrame(rows, SCHEMA), ["g"], "t", 10.0, [F.col("t")]).toPandas()
    assert sorted(got["n"]) == sorted(want["n"])


def test_carry_forward(spark, rows, tmp_path):
    got = run(spark, rows, lambda s: stateful.carried_forward(s, "g", "t", "v"), tmp_path).set_index("n").sort_index()
    want = sync.carry_forward(spark.createDataFrame(rows, SCHEMA), ["g"], [F.col("t")], "v").toPandas().set_index("n").sort_index()
    assert got["reused"].tolist() == want["reused"].tolist()
    assert got["reused_value"].fillna(-1).tolist() == want["reused_value"].fillna(-1).tolist()


def test_state_machine(spark, tmp_path):
    steps = ["IDLE", "STARTING", "RUNNING", "IDLE", "STOPPING", "FINALIZING", "RUNNING", "IDLE"]
    got = run(spark, [(0, i, float(i), None, s) for i, s in enumerate(steps)], lambda s: stateful.checked_states(s, "g", "t", "s"), tmp_path).sort_values("n")
    assert got["legal"].tolist() == [True, True, True, False, True, True, False, True]


def test_admission(spark, rows, tmp_path):
    twice = [*rows[:60], *rows[30:60], *rows[60:], *rows[:30]]
    make = lambda s: stateful.admitted(s.select("g", "n", F.timestamp_seconds("t").alias("at"), F.timestamp_seconds(F.lit(20)).alias("start")), "start", "at", "g", "n")
    got = run(spark, twice, make, tmp_path, 3)
    assert sorted(got["n"]) == [n for _, n, t, _, _ in rows if t >= 20]


def test_session_logs_are_idempotent(spark, tmp_path):
    write = stateful.session_logs(f"file://{tmp_path}/logs", {"all": lambda d: d, "even": lambda d: d.where("id % 2 = 0")})
    for batch in (0, 1, 1):
        write(spark.range(10), batch)
    assert spark.read.parquet(f"file://{tmp_path}/logs/all").count() == 20 and spark.read.parquet(f"file://{tmp_path}/logs/even").count() == 10


def test_rates_and_expiry(spark):
    rows = [("s", i, i // 2) for i in range(40)]
    frames = spark.createDataFrame(rows, "s string, n long, sec long").withColumn("at", F.timestamp_seconds("sec"))
    got = stateful.frame_rate(frames, "at", ["s"]).orderBy("start").collect()
    assert [(r["frames"], r["fps"]) for r in got] == [(20, 2.0), (20, 2.0)]
    now = F.timestamp_seconds(F.lit(19))
    assert stateful.fresh(frames, "at", now).select("sec").distinct().count() == 2  # 18 and 19: 17.5 is the limit


def test_a_session_without_frames_stalls(spark, tmp_path):
    """A session that gets no more frames is reported once, while another's frames come."""
    import time

    seen = []
    write = lambda k, rows: spark.createDataFrame(rows, "s string, n long").coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    write(0, [("a", 0), ("a", 1)])
    raw = spark.readStream.schema("s string, n long").json(f"file://{tmp_path}/in")
    q = stateful.stalled_sessions(raw, "s", 1500).writeStream.outputMode("append").foreachBatch(lambda b, _: seen.extend(tuple(r) for r in b.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="300 milliseconds").start()
    try:
        for k in range(1, 60):
            time.sleep(0.5)
            if ("a", 2, True) in seen:
                break
            write(k, [("b", k)])
    finally:
        q.stop()
    assert ("a", 2, False) in seen and ("a", 2, True) in seen and not any(s == "a" and n != 2 for s, n, _ in seen)


def test_association_over_micro_batches_equals_the_batch(spark, tmp_path):
    import random

    from furrow.operators import fusion

    r, schema = random.Random(4), "segment_id long, frame_index long, observation_id long, x double, y double"
    rows = [(s, f, 1000 * s + 20 * f + k, r.uniform(0, 60), r.uniform(0, 60)) for s in range(2) for f in range(12) for k in range(r.randint(2, 7))]
    for part in range(4):
        spark.createDataFrame([x for x in rows if x[1] // 3 == part], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    seen = []
    q = stateful.tracked(raw, "segment_id", 12.0, 2).writeStream.outputMode("append").foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {x["observation_id"]: x["track_id"] for x in fusion.associate(spark.createDataFrame(rows, schema), 12.0, 2).collect()}
    assert {x["observation_id"]: x["track_id"] for x in seen} == want


def test_status_documents(spark, tmp_path):
    import json
    import time

    from furrow.sinks import files

    told = []
    listener = stateful.StatusListener(lambda d: (told.append(d), files.write_json(d, str(tmp_path / "status.json"))))
    spark.streams.addListener(listener)
    try:
        spark.range(7).write.parquet(f"file://{tmp_path}/in")
        q = spark.readStream.schema("id long").parquet(f"file://{tmp_path}/in").writeStream.queryName("seven").foreachBatch(lambda b, _: b.count()).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):
            if told and told[-1]["state"] == "IDLE":
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert told[0] == {"query": "seven", "state": "STARTING"} and any(d.get("rows") == 7 and d["state"] == "RUNNING" for d in told)
    assert json.loads((tmp_path / "status.json").read_text())["state"] == "IDLE"


def test_rate_limit_after_a_frame_without_a_time(spark, tmp_path):
    rows = [(0, 0, None, None, ""), (0, 1, 1.0, None, ""), (0, 2, 5.0, None, ""), (0, 3, float("nan"), None, ""), (0, 4, 9.0, None, ""), (0, 5, 30.0, None, "")]
    got = run(spark, rows, lambda s: stateful.rate_limited(s, "g", "t", 6.0), tmp_path, 3)
    want = folds.accepted_at_interval(spark.createDataFrame(rows, SCHEMA).where("t is not null and not isnan(t)"), ["g"], "t", 6.0, [F.col("t")]).toPandas()
    assert sorted(got["n"]) == sorted(want["n"]) == [1, 4, 5]


def fed(spark, tmp_path, pieces: list[list[tuple]], make, stop: int | None = None) -> list:
    """Rows in one file for each trigger; with ``stop`` the query is run on so many files first, ends, and begins again with the others."""
    got = []
    for k, piece in enumerate(pieces):
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        if stop in (None, k + 1) or k == len(pieces) - 1:
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
            make(stream).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return got


def test_latest_reading_in_event_time(spark, tmp_path):
    """Readings and frames in any order within the delay, over micro-batches and a restart: the batch's result."""
    r = random.Random(4)
    rows = [(i % 3, i, i + r.random() / 2, (None if r.random() < 0.1 else r.random()) if i % 4 else None, "reading" if i % 4 else "frame") for i in range(160)]
    late = sorted(rows, key=lambda x: x[2] + r.uniform(0, 18))  # up to 18 seconds late
    rows.append((0, 999, 400.0, 1.0, "reading"))
    pieces = [late[k : k + 16] for k in range(0, 160, 16)] + [[rows[-1]]]
    make = lambda s: stateful.with_latest(s.where("s = 'frame'").select("g", "n", "t"), s.where("s = 'reading'"), "g", "t", "v", "20 seconds")
    got = fed(spark, tmp_path, pieces, make, stop=4)
    known = [(g, t, v) for g, _, t, v, s in rows if s == "reading" and v is not None]
    want = {(g, n): max(((u, v) for h, u, v in known if h == g and u <= t), default=(0, None))[1] for g, n, t, _, s in rows if s == "frame"}
    assert {(x["g"], x["n"]): x["latest"] for x in got} == want and len(got) == len(want)


def test_a_frame_between_two_readings_that_came_before_it(spark, tmp_path):
    pieces = [[(0, 1, 10.0, 1.0, "reading"), (0, 2, 100.0, 2.0, "reading")], [(0, 3, 50.0, None, "frame")], [(0, 4, 300.0, 3.0, "reading"), (0, 5, None, None, "frame")]]
    make = lambda s: stateful.with_latest(s.where("s = 'frame'").select("g", "n", "t"), s.where("s = 'reading'"), "g", "t", "v", "60 seconds")
    assert [(x["n"], x["latest"]) for x in fed(spark, tmp_path, pieces, make)] == [(3, 1.0)]


def test_newest_frame_of_each_trigger(spark, tmp_path):
    pieces = [[(0, 1, 0.0, None, ""), (0, 3, 0.0, None, ""), (0, 2, 0.0, None, ""), (1, 5, 0.0, None, "")], [(0, 2, 0.0, None, ""), (0, None, 0.0, None, "")], [(0, 4, 0.0, None, ""), (0, 9, 0.0, None, ""), (1, 6, 0.0, None, "")]]
    got = fed(spark, tmp_path, pieces, lambda s: stateful.newest_only(s, "g", "n"), stop=1)
    assert sorted((x["g"], x["n"], x["pushed"], x["dropped"], x["popped"]) for x in got) == [(0, 3, 3, 2, 1), (0, 9, 7, 5, 2), (1, 5, 1, 0, 1), (1, 6, 2, 0, 2)]


def test_the_finalizer_judges_each_session_once(spark, tmp_path):
    """A stream of two sessions that end, one of them again after a restart."""
    from furrow import pipelines

    r = random.Random(2)
    field = [(s, 10 * j + i, 40.0 * i + r.uniform(-0.5, 0.5), 90.0 * j + r.uniform(-0.5, 0.5)) for s in (0, 1) for j in range(5) for i in range(10) if (s, i, j) != (1, 5, 2)]
    plants = spark.createDataFrame(field, "session_id long, plant_id long, x double, y double")
    out = f"file://{tmp_path}/out"
    events = [[(0, 1, 1.0, None, "on"), (1, 2, 2.0, None, "on"), (1, 3, 3.0, None, "on")], [(1, 4, 4.0, None, "off")], [(0, 5, 5.0, None, "off"), (7, 6, 6.0, None, "on")], [(1, 7, 7.0, None, "on"), (1, 8, 8.0, None, "off"), (7, 9, 9.0, None, "off")]]
    judge = pipelines.finalizer(lambda closed: plants.join(closed.select("session_id"), "session_id", "left_semi"), out)
    closed = lambda s: stateful.closed_sessions(s.select(F.col("g").alias("session_id"), "n", (F.col("s") == "on").alias("on")), "session_id", "n", "on")
    for k, piece in enumerate(events):
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        if k in (1, 3):
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
            closed(stream).writeStream.foreachBatch(judge).option("checkpointLocation", f"file://{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    told = {x["session_id"]: x for x in spark.read.parquet(f"{out}/sessions").collect()}
    assert spark.read.parquet(f"{out}/sessions").count() == 3 and {k: (x["status"], x["plants"], x["gap_count"], x["records"]) for k, x in told.items()} == {0: ("zero_gaps_confirmed", 50, 0, 1), 1: ("gaps_found", 49, 1, 2), 7: ("NOT_EVALUATED", 0, None, 1)}
    gaps = spark.read.parquet(f"{out}/gaps").collect()
    assert [x["session_id"] for x in gaps] == [1]
    # a batch that is run again changes nothing
    judge(spark.createDataFrame([(1, 2, 4, 2)], "session_id long, started long, ended long, records long"), told[1]["batch_id"])
    assert spark.read.parquet(f"{out}/sessions").count() == 3 and spark.read.parquet(f"{out}/gaps").count() == 1


def test_json_logs_under_a_budget(spark, tmp_path):
    """Three triggers, the budget holds about two of them; a batch that is run again changes nothing."""
    import json

    pieces = [[(g, 10 * k + i, float(k), None, "a b/=" if i else "ü") for g in (0, 1) for i in range(3 if g else 1)] + [(None, 5, 1.0, None, "")] for k in range(3)]
    folder = f"file://{tmp_path}/logs"
    logs = {"frames": lambda df: df.select("g", "n", "s"), "times": lambda df: df.where("g = 1").select("g", "t")}
    put = stateful.json_logs(folder, logs, "g", 75)
    for k, piece in enumerate(pieces):
        for _ in range(2):
            put(spark.createDataFrame(piece, SCHEMA), k)
    lines = {(g, name): [json.loads(x) for f in sorted((tmp_path / "logs" / name / f"g={g}").rglob("*.txt")) for x in f.read_text().splitlines()] for g in (0, 1) for name in logs}
    told = {(x["g"], x["log"]): x for x in stateful.session_summary(spark, folder, "g", 75).collect()}
    assert sorted(x["n"] for x in lines[0, "frames"]) == [0, 10, 20] and sorted(x["n"] for x in lines[1, "frames"]) == [20, 21, 22] and (0, "times") not in told
    assert [told[1, "frames"][c] for c in ("batches", "records", "records_kept", "records_discarded")] == [3, 9, 3, 6] and told[0, "frames"]["records_discarded"] == 0
    assert told[0, "frames"]["bytes"] == sum(len(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode()) + 1 for x in lines[0, "frames"])
    assert len(lines[1, "times"]) == told[1, "times"]["records_kept"]
