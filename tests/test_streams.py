"""State machines: the stream equals the batch fold, and both equal a plain loop."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corpusloom.streaming import lifecycle as L

SCHEMA = "key string, seq long, ts timestamp, event string, expected_version long"


def log(spark, rows):
    return spark.createDataFrame(rows, "key string, seq long, s long, event string, expected_version long").select("key", "seq", F.timestamp_seconds("s").alias("ts"), "event", "expected_version")


def test_task_life(spark):
    steps = ["create", "claim", "append", "append", "save", "fail", "save", "retry", "claim", "complete"]
    want = [None, None, 1, 1, 1, None, 2, None, None, None]
    rows = [("t", i, 100 + i, e, v) for i, (e, v) in enumerate(zip(steps, want, strict=True))]
    got = L.fold(log(spark, rows), "task").orderBy("seq").collect()
    assert [r.accepted for r in got] == [True, True, True, False, True, True, True, True, True, True]
    assert json.loads(got[-1].state) | {"expires": 0} == {"status": "completed", "version": 3, "progress": 3, "count": 1, "expires": 0}
    late = L.fold(log(spark, [("t", 0, 0, "create", None), ("t", 1, 1801, "claim", None)]), "task").orderBy("seq").collect()
    assert not late[1].accepted and json.loads(late[1].state)["status"] == "expired"


def test_progress_refuses_stale_versions(spark):
    rows = [("p", 0, 0, "create", None), ("p", 1, 1, "save", 1), ("p", 2, 2, "save", 1), ("p", 3, 3, "complete", None)]
    assert [r.accepted for r in L.fold(log(spark, rows), "progress").orderBy("seq").collect()] == [True, True, False, True]


def test_quota(spark):
    rows = [("g", i, i, e, None) for i, e in enumerate(["reserve", "reserve", "reserve", "release", "reserve", "restart", "reserve"])]
    got = L.fold(log(spark, rows), "quota").orderBy("seq").collect()
    assert [r.accepted for r in got] == [True, True, False, True, True, True, True] and json.loads(got[-1].state) == {"total": 4, "active": 1}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    names = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "click", "append").otherwise("fail")
    rows = events.where("user_id < 8").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), names.alias("event"), F.lit(1).cast("long").alias("expected_version"))
    ordered = rows.orderBy("ts", "seq").toPandas()
    half = len(ordered) // 2
    for machine in ("task", "asset"):
        for i, part in enumerate((ordered[:half], ordered[half:])):
            spark.createDataFrame(part).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{machine}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{machine}/in")
        q = L.follow(stream, machine).writeStream.format("memory").queryName(f"out_{machine}").outputMode("append").option("checkpointLocation", f"{tmp_path}/{machine}/cp").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert sorted(map(tuple, spark.table(f"out_{machine}").collect())) == sorted(map(tuple, L.fold(rows, machine).collect()))


def test_ingest_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "v": "x"}\n{"id": 2, "v": "y"}\n')

    def run():
        L.ingest_stream(spark, f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/cp", lambda df: df, "id long, v string", ["id"]).awaitTermination(300)
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/table").select("id", "v").collect()))

    assert run() == [(1, "x"), (2, "y")] == run()
    (tmp_path / "in" / "b.json").write_text('{"id": 2, "v": "z"}\n{"id": 3, "v": "w"}\n')
    assert run() == [(1, "x"), (2, "z"), (3, "w")]


def test_ingest_keeps_the_last_of_a_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(f'{{"id": {i % 5}, "n": {i}}}\n' for i in range(50)))
    L.ingest_stream(spark, f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/cp", lambda df: df, "id long, n long", ["id"], "n").awaitTermination(300)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/table").select("id", "n").collect())) == [(i, 45 + i) for i in range(5)]


def test_document_life(spark):
    steps = [("create", None), ("reset", None), ("failed", None), ("reset", None), ("ready", 7), ("reset", None)]
    got = L.fold(log(spark, [("d", i, i, e, v) for i, (e, v) in enumerate(steps)]), "document").orderBy("seq").collect()
    assert [r.accepted for r in got] == [True, False, True, True, True, False] and json.loads(got[-1].state) == {"status": "ready", "chunks": 7}


def run_watch(spark, path, machine, parts, delay="10 minutes"):
    """Each part is one micro-batch; the stream's rows, and the state rows after each batch."""
    for i, part in enumerate(parts):
        log(spark, part).coalesce(1).write.parquet(f"{path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        q = L.watch(stream, machine, delay).writeStream.format("parquet").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start(f"{path}/out")
        q.awaitTermination(300)
    held = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if json.loads(p.json)["stateOperators"]]
    rows = spark.read.schema(L.TIMED).parquet(f"{path}/out").collect()
    return sorted(map(tuple, rows), key=repr), held[-1]


NOW = 1_700_000_000


def test_expiry_comes_without_a_further_event(spark, tmp_path):
    parts = [[("t", 0, NOW, "create", None), ("t", 1, NOW + 60, "claim", None), ("done", 2, NOW + 5, "create", None), ("done", 3, NOW + 9, "claim", None), ("done", 4, NOW + 20, "complete", None)], [("clock", 9, NOW + 10 * 86400, "tick", None)]]
    rows, held = run_watch(spark, tmp_path, "task", parts)
    timers = [(r[0], r[2] - NOW, r[3], r[5] and json.loads(r[5] or "null") and json.loads(r[5])["status"]) for r in rows if r[1] is None]
    assert sorted(timers) == [("done", 1806 + 86400, "forget", None), ("t", 1801, "expire", "expired"), ("t", 1801 + 86400, "forget", None)]
    assert sorted(r[2] - NOW for r in rows if r[1] is not None) == [0, 5, 9, 20, 60]
    assert held <= 3  # the clock's own event waits: its row, its list's size and its timer


def test_a_forgotten_key_begins_again(spark, tmp_path):
    day = 86400
    parts = [[("t", 0, NOW, "create", None)], [("t", 1, NOW + 3 * day, "create", None)], [("t", 2, NOW + 3 * day + 10, "claim", None), ("clock", 3, NOW + 9 * day, "tick", None)]]
    rows, _ = run_watch(spark, tmp_path, "task", parts)
    assert [r[4] for r in sorted(rows, key=lambda r: r[2])] == [True] * 7
    want = L.timed_fold(log(spark, [e for p in parts for e in p]).where("key <> 'clock'"), "task")
    assert rows == sorted(map(tuple, want.collect()), key=repr)


def test_watch_equals_the_timed_fold(spark, tmp_path):
    import random

    kinds = {
        "task": ["create", "claim", "append", "save", "fail", "retry", "cancel", "complete", "restart"], "progress": ["create", "save", "save_ready", "abandon", "complete"],
        "quota": ["reserve", "release", "restart"], "asset": ["create", "claim", "uploading", "ready", "failed"],
    }
    for m, (machine, names) in enumerate(kinds.items()):
        rng = random.Random(m)
        rows, seq = [], 0
        for batch in range(4):  # within a batch in any order, and up to five minutes older than the batch before
            part = []
            for _ in range(60):
                seq += 1
                part.append((f"k{rng.randint(0, 12)}" if rng.random() > 0.03 else None, seq, NOW + batch * 40_000 + rng.randint(-250, 39_000), rng.choice(names), rng.choice([None, 1, 2])))
            rows.append(part)
        rows[-1].append(("clock", 0, NOW + 100 * 86400, "tick", None))
        got, held = run_watch(spark, f"{tmp_path}/{machine}", machine, rows)
        want = L.timed_fold(log(spark, [e for p in rows for e in p]).where("key <> 'clock'"), machine)
        assert got == sorted(map(tuple, want.collect()), key=repr), machine
        assert sum(r[1] is None for r in got) >= 10 and held <= 3


def test_the_clock_stops_where_it_is_told(spark):
    rows = log(spark, [("t", 0, NOW, "create", None), ("t", 1, NOW + 1801, "claim", None), ("t", 2, NOW + 4000, "claim", None)])
    got = L.timed_fold(rows, "task", NOW + 1801).collect()
    assert [(r.event, r.accepted) for r in got] == [("create", True), ("expire", True), ("claim", False)]
    assert L.timed_fold(rows.where("false"), "task").count() == 0


def test_a_hot_key_is_folded_in_blocks(spark):
    import random

    for machine, names in (("quota", ["reserve", "release", "restart", "noise"]), ("asset", ["create", "claim", "uploading", "failed", "ready"])):
        rng = random.Random(3)
        rows = [("hot" if rng.random() < 0.8 else f"k{rng.randint(0, 30)}", i, NOW + rng.randint(0, 3_000), rng.choices(names, [6, 3, 1, 1, 1][: len(names)])[0], None) for i in range(8_000)]
        events = log(spark, rows).repartition(5)
        got, want = L.segmented_fold(events, machine, 16), L.fold(events, machine)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert L.segmented_fold(events.where("false"), "asset").count() == 0


def test_a_block_is_a_transition():
    rows = [{"key": "k", "seq": i, "ts": i, "event": e, "expected_version": None} for i, e in enumerate(["claim", "failed", "create", "claim", "uploading", "failed"])]
    for machine in ("asset", "quota"):
        for start in L.STARTS[machine]:
            held = None if start is None else start | dict.fromkeys(L.SUMS[machine], 7)
            true, zero = held, start
            for e in rows:
                true, zero = L.MACHINES[machine](true, e)[0], L.MACHINES[machine](zero, e)[0]
            assert L._moved(machine, held, zero) == true and (true is None or L._control(machine, true) in L.STARTS[machine])
