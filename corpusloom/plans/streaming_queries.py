"""Queries of the state machines over the event table, folded in batch (tests hold the streams against them), and of the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.plans.views import table
from corpusloom.sources.snapshots import Snapshots
from corpusloom.sources.stages import shared_folder
from corpusloom.streaming import lifecycle as L


def events(spark, sf_dir, names, by_day=False):
    """Events of a user (and day) under the machine's names, in the order click, error, purchase, signup, view."""
    e = table(spark, sf_dir, "events")
    kind = F.coalesce(*[F.when(F.col("event_type") == t, n) for t, n in zip(("click", "error", "purchase", "signup", "view"), names, strict=True)])
    key = F.concat_ws(":", "user_id", F.to_date("ts")) if by_day else F.col("user_id").cast("string")
    return e.select(key.alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event"), F.floor(F.col("value") % 4).alias("expected_version"))


_KINDS = ("click", "error", "purchase", "signup", "view")


def _machine_sql(names, first: str, ok: str, new: dict[str, str], state: str, end: str = "") -> str:
    """A machine as a recursion over each key's events; ``s_*`` is the state before an event. ``end`` is another query over ``r``."""
    kind = " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in zip(_KINDS, names, strict=True))
    cols = ", ".join(new)
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS n FROM (SELECT concat(user_id, ':', CAST(ts AS DATE)) AS key, event_id AS seq,
    CAST(floor(epoch(ts)) AS BIGINT) AS ts, CASE event_type {kind} END AS event, CAST(floor(value % 4) AS BIGINT) AS want FROM events)),
r(key, n, seq, event, ok, {cols}) AS (SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', false, {first} FROM e
    UNION ALL SELECT key, n, seq, event, ok, {", ".join(new.values())} FROM (SELECT e.*, {", ".join(f"{c} AS s_{c}" for c in new)}, coalesce({ok}, false) AS ok FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1))
{end or f"SELECT key, seq, event, ok AS accepted, {state} AS state FROM r WHERE n > 0"}"""


_LIVE = "status IN ('in_progress', 'ready_for_report')"
_T2 = ("save", "abandon", "save_ready", "create", "save")
_T3 = ("reserve", "restart", "reserve", "reserve", "release")
_T6 = ("claim", "failed", "ready", "create", "uploading")
_T1 = ("append", "fail", "complete", "create", "claim")
#: The clock may have run out before the event counts.
_NOW = "CASE WHEN e.ts > r.expires AND r.status IN ('queued', 'generating', 'failed') THEN 'expired' ELSE r.status END"
_LATE = _NOW.replace("e.ts", "ts").replace("r.expires", "s_expires").replace("r.status", "s_status")


_TASK = (_T1, "NULL::VARCHAR, 0::BIGINT, 0::BIGINT, 0::BIGINT", f"""CASE event WHEN 'create' THEN r.status IS NULL WHEN 'claim' THEN ({_NOW}) = 'queued'
    WHEN 'append' THEN ({_NOW}) IN ('generating', 'queued') AND want = r.version WHEN 'complete' THEN ({_NOW}) IN ('generating', 'completed') WHEN 'fail' THEN ({_NOW}) NOT IN ('completed', 'expired') END""".replace("event", "e.event", 1), {
    "status": f"CASE WHEN NOT ok THEN {_LATE} WHEN event = 'create' THEN 'queued' WHEN event IN ('claim', 'append') THEN 'generating' WHEN event = 'fail' THEN 'failed' ELSE 'completed' END",
    "version": "CASE WHEN NOT ok THEN s_version WHEN event = 'create' THEN 1 ELSE s_version + (event IN ('append', 'complete'))::BIGINT END",
    "count": "CASE WHEN ok AND event = 'append' THEN s_count + 1 ELSE s_count END", "expires": "CASE WHEN ok AND event = 'create' THEN ts + 1800 ELSE s_expires END",
}, """CASE WHEN status IS NULL THEN 'null' ELSE concat('{"count": ', count, ', "expires": ', expires, ', "progress": 1, "status": "', status, '", "version": ', version, '}') END""")
_PROGRESS = (_T2, "NULL::VARCHAR, 0::BIGINT", f"CASE e.event WHEN 'create' THEN r.status IS NULL WHEN 'abandon' THEN r.{_LIVE} ELSE r.{_LIVE} AND want = r.version END", {
    "status": "CASE WHEN NOT ok THEN s_status WHEN event = 'abandon' THEN 'abandoned' WHEN event = 'save_ready' THEN 'ready_for_report' ELSE 'in_progress' END",
    "version": "CASE WHEN NOT ok THEN s_version WHEN event = 'create' THEN 1 ELSE s_version + 1 END",
}, """CASE WHEN status IS NULL THEN 'null' ELSE concat('{"status": "', status, '", "version": ', version, '}') END""")
_QUOTA = (_T3, "0::BIGINT, 0::BIGINT", "CASE e.event WHEN 'reserve' THEN r.total < 10 AND r.active < 2 ELSE true END", {
    "total": "s_total + (ok AND event = 'reserve')::BIGINT",
    "active": "CASE WHEN NOT ok THEN s_active WHEN event = 'reserve' THEN s_active + 1 WHEN event = 'release' THEN greatest(s_active - 1, 0) ELSE 0 END",
}, """concat('{"active": ', active, ', "total": ', total, '}')""")
_ASSET = (_T6, "NULL::VARCHAR, 0::BIGINT", """CASE e.event WHEN 'create' THEN r.status IS NULL WHEN 'claim' THEN r.status = 'pending' WHEN 'uploading' THEN r.status IN ('generating', 'uploading')
    WHEN 'ready' THEN r.status = 'uploading' ELSE r.status IN ('pending', 'generating', 'uploading') END""", {
    "status": "CASE WHEN NOT ok THEN s_status WHEN event = 'create' THEN 'pending' WHEN event = 'claim' THEN 'generating' ELSE event END",
    "retries": "s_retries + (ok AND event = 'failed')::BIGINT",
}, """CASE WHEN status IS NULL THEN 'null' ELSE concat('{"retries": ', retries, ', "status": "', status, '"}') END""")


@query("task_state_t1", _machine_sql(*_TASK))
def task_state_t1(spark, sf_dir):
    return L.fold(events(spark, sf_dir, _T1, True), "task")


@query("progress_state_t2", _machine_sql(*_PROGRESS))
def progress_state_t2(spark, sf_dir):
    return L.fold(events(spark, sf_dir, _T2, True), "progress")


@query("quota_t3", _machine_sql(*_QUOTA))
def quota_t3(spark, sf_dir):
    return L.fold(events(spark, sf_dir, _T3, True), "quota")


@query("asset_state_t6", _machine_sql(*_ASSET))
def asset_state_t6(spark, sf_dir):
    return L.fold(events(spark, sf_dir, _T6, True), "asset")


@query("quota_blocks_t3", _machine_sql(*_QUOTA))
def quota_blocks_t3(spark, sf_dir):
    return L.segmented_fold(events(spark, sf_dir, _T3, True), "quota")


@query("asset_blocks_t6", _machine_sql(*_ASSET))
def asset_blocks_t6(spark, sf_dir):
    return L.segmented_fold(events(spark, sf_dir, _T6, True), "asset")


_DOCUMENT = ("ready", "failed", "reset", "create", "ready")


@query("document_state_u15", _machine_sql(_DOCUMENT, "NULL::VARCHAR, 0::BIGINT", "CASE e.event WHEN 'create' THEN r.status IS NULL WHEN 'reset' THEN r.status = 'failed' ELSE r.status IS NOT NULL END", {
    "status": "CASE WHEN NOT ok THEN s_status WHEN event IN ('create', 'reset') THEN 'processing' ELSE event END", "chunks": "CASE WHEN ok AND event = 'ready' THEN want ELSE s_chunks END",
}, """CASE WHEN status IS NULL THEN 'null' ELSE concat('{"chunks": ', chunks, ', "status": "', status, '"}') END"""))
def document_state_u15(spark, sf_dir):
    return L.fold(events(spark, sf_dir, _DOCUMENT, True), "document")


def _as_stream(df, name, **options):
    """A table's rows written once to the shared folder, and a stream over its files."""
    path = f"{shared_folder(df.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/in")
    return df.sparkSession.readStream.schema(df.schema).options(**options).parquet(f"{path}/in"), path


def _timed_sql(machine: tuple, forget: str, gone: str = "status IS NOT NULL", expire: str = "") -> str:
    """The machine's rows with their times, and those of its timers: a key's events are of one day, so all are over before it is forgotten."""
    state = machine[4]
    end = f"""SELECT key, seq, (SELECT any_value(e.ts) FROM e WHERE e.key = r.key AND e.n = r.n) AS ts, event, ok AS accepted, {state} AS state FROM r WHERE n > 0
    {expire.format(state=state)} UNION ALL SELECT key, NULL, {forget}, 'forget', true, 'null' FROM (SELECT r.*, (SELECT any_value(e.ts) FROM e WHERE e.key = r.key AND e.n = r.n) AS last FROM r
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1) WHERE {gone}"""
    return _machine_sql(*machine, end)


def _on_stream(spark, sf_dir, machine: str, names):
    """The events as two arrivals on a stream, the second with a tick of a clock long after; what the stream has put out."""
    rows = events(spark, sf_dir, names, True)
    middle = rows.select(F.unix_timestamp("ts").alias("ts")).approxQuantile("ts", [0.5], 0.01)[0]
    tick = rows.agg((F.max("ts") + F.expr("interval 90 days")).alias("ts")).select(F.lit("clock").alias("key"), F.lit(0).cast("long").alias("seq"), "ts", F.lit("tick").alias("event"), F.lit(None).cast("long").alias("expected_version"))
    path = f"{shared_folder(spark)}/stream-{machine}-{uuid.uuid4().hex}"
    early = F.unix_timestamp("ts") < middle
    for part in (rows.where(early), rows.where(~early).unionByName(tick)):
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        L.watch(stream, machine).writeStream.format("parquet").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(L.TIMED).parquet(f"{path}/out")


_ENDED = "CASE WHEN status IN ({0}) THEN last + 86400 ELSE last + 2592000 END"


@query("task_stream_t1", _timed_sql(_TASK, "expires + 86401", expire="""UNION ALL SELECT key, NULL, expires + 1, 'expire', true, {state} FROM (SELECT * REPLACE ('expired' AS status) FROM (SELECT r.* FROM r JOIN e ON e.key = r.key AND e.n = r.n
    WHERE e.ts <= r.expires QUALIFY row_number() OVER (PARTITION BY r.key ORDER BY r.n DESC) = 1) WHERE status IN ('queued', 'generating', 'failed'))"""))
def task_stream_t1(spark, sf_dir):
    return _on_stream(spark, sf_dir, "task", _T1)


@query("progress_stream_t2", _timed_sql(_PROGRESS, _ENDED.format("'completed', 'abandoned'")))
def progress_stream_t2(spark, sf_dir):
    return _on_stream(spark, sf_dir, "progress", _T2)


@query("quota_stream_t3", _timed_sql(_QUOTA, "(last // 86400 + 1) * 86400", "n > 0"))
def quota_stream_t3(spark, sf_dir):
    return _on_stream(spark, sf_dir, "quota", _T3)


@query("asset_stream_t6", _timed_sql(_ASSET, _ENDED.format("'ready', 'failed'")))
def asset_stream_t6(spark, sf_dir):
    return _on_stream(spark, sf_dir, "asset", _T6)


_INGESTED = """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"""


@query("ingest_upsert_t4", _INGESTED)
def ingest_upsert_t4(spark, sf_dir):
    """The table that the ingest stream keeps: the last row of each key, over two runs of the stream."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    path = f"{shared_folder(spark)}/stream-ingest-{uuid.uuid4().hex}"
    for half in (0, 1):
        e.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == half).write.mode("append").json(f"{path}/in")
        L.ingest_stream(spark, f"{path}/in", f"{path}/table", f"{path}/cp", lambda df: df, e.schema.simpleString()[7:-1].replace(":", " "), ["user_id"], "event_id", newest=True).awaitTermination()
    return spark.read.parquet(f"{path}/table").select("user_id", "event_id", "event_type")


@query("ingest_commits_t4", _INGESTED)
def ingest_commits_t4(spark, sf_dir):
    """The same into a table of commits, a version for each arrival."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    path = f"{shared_folder(spark)}/stream-commits-{uuid.uuid4().hex}"
    held = Snapshots(spark, f"{path}/table", "bucket")
    for half in (0, 1):
        e.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == half).write.mode("append").json(f"{path}/in")
        L.ingest_commits(spark, f"{path}/in", held, f"{path}/cp", lambda df: df, e.schema.simpleString()[7:-1].replace(":", " "), ["user_id"], "event_id").awaitTermination()
    return held.read().select("user_id", "event_id", "event_type")


@query("upload_dedupe_t5", "SELECT user_id, sha256(event_type) AS content_hash, CAST(ts AS DATE) AS day FROM events GROUP BY ALL")
def upload_dedupe_t5(spark, sf_dir):
    """Uploads of a day stand for one content; the stream lets the first of each through."""
    u = table(spark, sf_dir, "events").select("user_id", F.sha2("event_type", 256).alias("content_hash"), F.to_date("ts").alias("day"), F.to_date("ts").cast("timestamp").alias("ts"))
    stream, path = _as_stream(u, "uploads")
    L.dedupe_uploads(stream, "400 days", keys=("user_id", "content_hash", "day")).writeStream.format("parquet").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(u.schema).parquet(f"{path}/out").select("user_id", "content_hash", "day")
