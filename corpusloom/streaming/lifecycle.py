"""Keyed state machines over event logs: a batch fold, and the same machine on a stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.sources.snapshots import Snapshots
from corpusloom.sources.stages import staged
from corpusloom.sources.tables import upsert

EVENT = ["key", "seq", "ts", "event", "expected_version"]
#: A machine takes its state (None at first) and an event, and gives the new state and whether the event counted.
Machine = Callable[[dict | None, dict], tuple[dict | None, bool]]
#: Task lifetime in seconds, and a guest's quota.
TTL, DAILY, ACTIVE = 1800, 10, 2


def task_machine(s: dict | None, e: dict) -> tuple[dict | None, bool]:
    """Queued, generating, completed, failed, cancelled; expired once the clock passes half an hour."""
    kind, now = e["event"], e["ts"]
    if s and now > s["expires"] and s["status"] in ("queued", "generating", "failed"):
        s = s | {"status": "expired"}
    if kind == "create":
        return ({"status": "queued", "version": 1, "progress": 1, "count": 0, "expires": now + TTL}, True) if s is None else (s, False)
    if s is None:
        return s, False
    st, want = s["status"], e["expected_version"]
    if kind == "claim" and st == "queued":
        return s | {"status": "generating"}, True
    if kind == "append" and st in ("generating", "queued") and want == s["version"]:
        return s | {"status": "generating", "version": s["version"] + 1, "count": s["count"] + 1}, True
    if kind == "save" and st in ("queued", "generating", "failed", "completed") and want == s["progress"]:
        return s | {"progress": s["progress"] + 1}, True
    if kind == "complete" and st in ("generating", "completed"):
        return s | {"status": "completed", "version": s["version"] + 1}, True
    if kind == "fail" and st not in ("completed", "expired"):
        return s | {"status": "failed"}, True
    if kind == "retry" and st == "failed":
        return s | {"status": "queued"}, True
    if kind == "cancel" and st in ("queued", "generating"):
        return s | {"status": "cancelled"}, True
    if kind == "restart" and st == "generating":
        return s | {"status": "failed"}, True
    return s, False


def progress_machine(s: dict | None, e: dict) -> tuple[dict | None, bool]:
    """Saves apply only at the version they were made for."""
    kind = e["event"]
    if kind == "create":
        return ({"status": "in_progress", "version": 1}, True) if s is None else (s, False)
    if s is None:
        return s, False
    live = s["status"] in ("in_progress", "ready_for_report")
    if kind in ("save", "save_ready") and live and e["expected_version"] == s["version"]:
        return {"status": "ready_for_report" if kind == "save_ready" else "in_progress", "version": s["version"] + 1}, True
    if kind == "abandon" and live:
        return {"status": "abandoned", "version": s["version"] + 1}, True
    if kind == "complete":
        return {"status": "completed", "version": s["version"] + 1}, True
    return s, False


def quota_machine(s: dict | None, e: dict) -> tuple[dict | None, bool]:
    """Keyed by guest and day; reserve below both limits, release never under zero, restart clears the active ones."""
    s = s or {"total": 0, "active": 0}
    if e["event"] == "reserve" and s["total"] < DAILY and s["active"] < ACTIVE:
        return {"total": s["total"] + 1, "active": s["active"] + 1}, True
    if e["event"] == "release":
        return s | {"active": max(s["active"] - 1, 0)}, True
    if e["event"] == "restart":
        return s | {"active": 0}, True
    return s, False


def asset_machine(s: dict | None, e: dict) -> tuple[dict | None, bool]:
    """Pending, generating, uploading, ready or failed."""
    kind = e["event"]
    if kind == "create":
        return ({"status": "pending", "retries": 0}, True) if s is None else (s, False)
    moves = {
        "claim": ("generating", ["pending"]), "uploading": ("uploading", ["generating", "uploading"]), "ready": ("ready", ["uploading"]),
        "failed": ("failed", ["pending", "generating", "uploading"]),
    }
    if s is None or kind not in moves or s["status"] not in moves[kind][1]:
        return s, False
    return {"status": moves[kind][0], "retries": s["retries"] + (kind == "failed")}, True


def document_machine(s: dict | None, e: dict) -> tuple[dict | None, bool]:
    """Processing, ready with its chunks (the event's expected version), failed; only failed documents are reset."""
    kind = e["event"]
    if kind == "create":
        return ({"status": "processing", "chunks": 0}, True) if s is None else (s, False)
    if s is None or kind not in ("ready", "failed", "reset") or (kind == "reset" and s["status"] != "failed"):
        return s, False
    if kind == "ready":
        return {"status": "ready", "chunks": e["expected_version"] or 0}, True
    return s | {"status": "failed" if kind == "failed" else "processing"}, True


MACHINES: dict[str, Machine] = {"document": document_machine, "task": task_machine, "progress": progress_machine, "quota": quota_machine, "asset": asset_machine}
OUT = "key string, seq long, event string, accepted boolean, state string"


def _events(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string"), F.col("seq").cast("long"), F.unix_timestamp("ts").alias("ts"), "event", F.col("expected_version").cast("long"))


def _plain(r: dict) -> dict:
    return r | {"expected_version": None if pd.isna(r["expected_version"]) else int(r["expected_version"]), "ts": int(r["ts"])}


def fold(events: DataFrame, machine: str) -> DataFrame:
    """All events in (ts, seq) order per key with their verdict and the state after them (JSON).

    A key's events come to one task in order, which holds one state at a time, so
    memory does not grow with a key's history.
    """
    step = MACHINES[machine]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                if r["key"] != key:
                    key, state = r["key"], None
                state, ok = step(state, _plain(r))
                out.append((key, r["seq"], r["event"], ok, json.dumps(state, sort_keys=True)))
            yield pd.DataFrame(out, columns=["key", "seq", "event", "accepted", "state"])

    return _events(events).repartition("key").sortWithinPartitions("key", "ts", "seq").mapInPandas(run, OUT)


#: Machines whose next step depends on finitely many states, and what in a state only adds up.
STARTS: dict[str, list[dict | None]] = {
    "quota": [None, *({"total": t, "active": a} for t in range(DAILY + 1) for a in range(ACTIVE + 1))],
    "asset": [None, *({"status": s, "retries": 0} for s in ("pending", "generating", "uploading", "ready", "failed"))],
}
SUMS = {"quota": [], "asset": ["retries"]}


def _control(machine: str, s: dict | None) -> dict | None:
    return None if s is None else s | dict.fromkeys(SUMS[machine], 0)


def _moved(machine: str, s: dict | None, end: dict | None) -> dict | None:
    """The end of a block that began at ``s``, from what the block makes of ``s`` with its sums at zero."""
    return end if s is None or end is None else end | {c: end[c] + s[c] for c in SUMS[machine]}


def segmented_fold(events: DataFrame, machine: str, parts: int | None = None) -> DataFrame:
    """``fold`` for machines of finitely many states, with a key's history dealt over many tasks.

    Events are sorted over ranges of (key, ts, seq), so a hot key fills several, each a block of
    events in order. A block is summarised as a transition: where it leads from each state. A
    key's transitions, one a block, are composed from its first; then all blocks run again,
    from the states that they really begin at. Keys of one block skip the first steps.
    """
    step, starts = MACHINES[machine], STARTS[machine]
    order = ["key", "ts", "seq"]
    rows = _events(events).where("key is not null")
    placed = (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).withColumn("part", F.spark_partition_id())
    placed = staged(placed, "blocks")
    hot = placed.select("key", "part").distinct().groupBy("key").count().where("count > 1").select("key")

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, ends, out = None, [], []
        for b in batches:
            for r in b.to_dict("records"):
                if (r["key"], r["part"]) != block:
                    out += [(*block, json.dumps(ends))] if block else []
                    block, ends = (r["key"], r["part"]), [None if s is None else dict(s) for s in starts]
                e = _plain(r)
                ends = [step(s, e)[0] for s in ends]
        yield pd.DataFrame(out + ([(*block, json.dumps(ends))] if block else []), columns=["key", "part", "ends"])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        out, now = [], None
        for key, part, ends in pdf.sort_values("part")[["key", "part", "ends"]].itertuples(index=False):
            out.append((key, part, json.dumps(now)))
            now = _moved(machine, now, json.loads(ends)[starts.index(_control(machine, now))])
        return pd.DataFrame(out, columns=["key", "part", "start"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, s = None, None
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                if (r["key"], r["part"]) != block:
                    block, s = (r["key"], r["part"]), json.loads(r["start"]) if r["start"] else None
                s, ok = step(s, _plain(r))
                out.append((r["key"], r["seq"], r["event"], ok, json.dumps(s, sort_keys=True)))
            yield pd.DataFrame(out, columns=["key", "seq", "event", "accepted", "state"])

    def in_order(df: DataFrame) -> DataFrame:
        """Blocks in one task each, with their events in order; many short ones stream through a task."""
        return df.repartition("key", "part").sortWithinPartitions("key", "part", "ts", "seq")

    ends = in_order(placed.join(hot, "key", "left_semi")).mapInPandas(summarise, "key string, part int, ends string")
    begins = staged(ends.groupBy("key").applyInPandas(compose, "key string, part int, start string"), "begins")
    return in_order(placed.join(begins, ["key", "part"], "left")).mapInPandas(run, OUT)


def latest(folded: DataFrame) -> DataFrame:
    """The last state per key and how many events counted. States come in event order, so the largest seq per key must be the last."""
    return folded.groupBy("key").agg(F.count(F.when(F.col("accepted"), 1)).alias("n_accepted"), F.count(F.lit(1)).alias("n_events"), F.max_by("state", "seq").alias("state"))


def follow(events: DataFrame, machine: str) -> DataFrame:
    """The same machine on a stream: state lives in the state store; within a micro-batch events are ordered by (ts, seq)."""
    step = MACHINES[machine]

    def run(key, frames, state):
        now = json.loads(state.get[0]) if state.exists else None
        b = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
        out = []
        for r in b.to_dict("records"):
            now, ok = step(now, _plain(r))
            out.append((r["key"], r["seq"], r["event"], ok, json.dumps(now, sort_keys=True)))
        state.update((json.dumps(now, sort_keys=True),))
        yield pd.DataFrame(out, columns=["key", "seq", "event", "accepted", "state"])

    return _events(events).groupBy("key").applyInPandasWithState(run, OUT, "state string", "append", "NoTimeout")


#: A state that no event has touched for so long is forgotten; one that has come to its end, much sooner.
IDLE, ENDED = 30 * 86400, 86400
ENDS = {"progress": ("completed", "abandoned"), "asset": ("ready", "failed"), "document": ("ready",)}
TIMED = "key string, seq long, ts long, event string, accepted boolean, state string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def due(machine: str, s: dict, last: int) -> tuple[int, str]:
    """When (seconds) a state whose last event was at ``last`` changes by itself, and how.

    A task's half hour runs out: it is ``expire``d in the first second after it, if it is
    still open, and any task is forgotten a day later. A guest's day ends at midnight.
    Other states are forgotten a day after they came to their end, or after thirty days.
    """
    if machine == "task":
        return (s["expires"] + 1, "expire") if s["status"] in ("queued", "generating", "failed") else (s["expires"] + 1 + ENDED, "forget")
    if machine == "quota":
        return (last // 86400 + 1) * 86400, "forget"
    return last + (ENDED if s["status"] in ENDS[machine] else IDLE), "forget"


class Clocked:
    """A machine with a clock for one key: events and what falls due by itself, in the order of time; timers first."""

    def __init__(self, machine: str, s: dict | None = None, last: int = 0):
        self.machine, self.s, self.last = machine, s, last

    def due(self) -> int | None:
        return None if self.s is None else due(self.machine, self.s, self.last)[0]

    def until(self, now: int) -> Iterator[tuple]:
        """The rows of all timers up to ``now``: ``(seq, ts, event, accepted, state)``."""
        while self.s is not None:
            at, how = due(self.machine, self.s, self.last)
            if at > now:
                return
            self.s = self.s | {"status": "expired"} if how == "expire" else None
            yield None, at, how, True, json.dumps(self.s, sort_keys=True)

    def event(self, e: dict) -> Iterator[tuple]:
        yield from self.until(e["ts"])
        self.s, ok = MACHINES[self.machine](self.s, e)
        self.last = e["ts"]
        yield e["seq"], e["ts"], e["event"], ok, json.dumps(self.s, sort_keys=True)


def timed_fold(events: DataFrame, machine: str, until: int | None = None) -> DataFrame:
    """The machine with its clock in batch: all events in (ts, seq) order per key, and the rows of timers among and after them.

    ``until`` (seconds) is where the clock stops: later events don't count, later timers
    don't run. Without it all timers run. As ``fold``, it holds one state at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, clock, end = None, None, 1 << 62 if until is None else until
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                if clock is None or r["key"] != key:
                    out += [(key, *row) for row in (clock.until(end) if clock else ())]
                    key, clock = r["key"], Clocked(machine)
                out += [(key, *row) for row in clock.event(_plain(r))]
            yield _rows(out)
        if clock:
            yield _rows([(key, *row) for row in clock.until(end)])

    rows = _events(events).where("key is not null")
    rows = rows if until is None else rows.where(F.col("ts") <= until)
    return rows.repartition("key").sortWithinPartitions("key", "ts", "seq").mapInPandas(run, TIMED)


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["key", "seq", "ts", "event", "accepted", "state"]).astype({"seq": "Int64"})


def watch(events: DataFrame, machine: str, delay: str = "10 minutes", buckets: int = 4096) -> DataFrame:
    """A stream of events -> the rows of ``timed_fold``, each as soon as the watermark has passed it.

    Events wait until the watermark has passed them, so they count in the order of time. A
    key's state changes by itself when it falls due, without a further event, and is
    removed once it is forgotten, so the state store holds only keys that are alive. Events may
    come in any order within ``delay``; later ones are dropped, as the fold could no longer
    take them into account. What is newer than the watermark waits. Null keys are left out.

    Keys share ``buckets`` of state by their hash (fixed for a checkpoint), each with one timer,
    for the first of its keys that falls due: a call costs far more than a key's few events.
    Uses the RocksDB state store, which this sets for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def run(_, frames, held):
        keys: dict[str, list] = json.loads(held.get[0]) if held.exists else {}  # state, time of the last event, waiting events, next time
        came: dict[str, list] = {}
        for b in frames:
            for r in b[EVENT].to_dict("records"):
                e = _plain(r)
                came.setdefault(e["key"], []).append((e["ts"], int(e["seq"]), e["event"], e["expected_version"]))
        now = held.getCurrentWatermarkMs() // 1000 - 1  # the last whole second that is surely over
        out = []
        for key in [k for k, v in keys.items() if k not in came and v[3] <= now] + [*came]:
            s, last, waiting, _ = keys.pop(key, (None, 0, [], 0))
            clock, waiting = Clocked(machine, s, last), sorted([*map(tuple, waiting), *came.get(key, [])], key=lambda w: w[:2])
            n = sum(w[0] <= now for w in waiting)
            for ts, seq, event, version in waiting[:n]:
                out += [(key, *row) for row in clock.event({"ts": ts, "seq": seq, "event": event, "expected_version": version})]
            out += [(key, *row) for row in clock.until(now)]
            times = [t for t in (waiting[n][0] if n < len(waiting) else None, clock.due()) if t is not None]
            if times:
                keys[key] = [clock.s, clock.last, waiting[n:], min(times)]
        if keys:
            held.update((json.dumps(keys),))
            held.setTimeoutTimestamp((min(v[3] for v in keys.values()) + 1) * 1000 - 1)  # passed once that second is over
        elif held.exists:
            held.remove()
        if out:
            yield _rows(out)

    late = events.where("key is not null").withColumn("time", F.col("ts")).withWatermark("time", delay)
    bucket = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(buckets)).cast("int")
    rows = late.select(
        bucket.alias("bucket"), F.col("key").cast("string"), F.col("seq").cast("long"), F.unix_timestamp("ts").alias("ts"), "event", F.col("expected_version").cast("long"), "time"
    )
    return rows.groupBy("bucket").applyInPandasWithState(run, TIMED, "keys string", "append", "EventTimeTimeout")


def dedupe_uploads(uploads: DataFrame, watermark: str = "1 hour", time: str = "ts", keys: tuple[str, ...] = ("user_id", "content_hash")) -> DataFrame:
    """T5: the first upload per user and content within the watermark, which bounds the state."""
    return uploads.withWatermark(time, watermark).dropDuplicatesWithinWatermark(list(keys))


def ingest_stream(
    spark: SparkSession, in_dir: str, table: str, checkpoint: str, to_rows: Callable[[DataFrame], DataFrame], schema: str, keys: list[str],
    order: str | None = None, buckets: int = 64, newest: bool = False,
) -> StreamingQuery:
    """T4: new files to rows, upserted into a table; a repeated file or batch changes nothing.

    The table is partitioned by a hash of the keys, and a micro-batch rewrites only the
    partitions that its keys fall in. Of several rows of a key the last by ``order`` counts
    (by all columns without one), so running a batch again gives the same table. With
    ``newest`` it also has to be later by ``order`` than what the table holds.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = to_rows(batch)
        shape = StructType([*rows.schema.fields, StructField("bucket", LongType())])
        ranked = rows.withColumn("_order", F.struct(*([order] if order else rows.columns)))
        rows = upsert(ranked.limit(0), ranked, keys, "_order").drop("_order").withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
        rows = staged(rows, "batch")
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        base = spark.read.schema(shape).parquet(table).where(F.col("bucket").isin(touched)) if _exists(spark, table) else rows.limit(0)
        merged = upsert(base.limit(0), base.unionByName(rows), keys, order) if newest else upsert(base, rows, keys)
        merged = staged(merged, "merged")  # read before its partitions are replaced
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)

    source = spark.readStream.schema(schema).json(in_dir)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_commits(
    spark: SparkSession, in_dir: str, table: Snapshots, checkpoint: str, to_rows: Callable[[DataFrame], DataFrame], schema: str, keys: list[str],
    order: str | None = None, buckets: int = 64, name: str = "ingest",
) -> StreamingQuery:
    """T4 into a table of commits, divided by ``bucket``: a micro-batch is one version.

    The entry's note has the stream's last epoch, so a batch that was committed before the
    stream could write its own checkpoint changes nothing when it comes again. A writer that
    dies earlier leaves the old version. Of several rows of a key the last by ``order`` counts,
    against what the table holds as well.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = to_rows(batch)
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        if table.entry()["note"].get(name, -1) >= epoch:
            return
        rows = staged(rows, "batch")
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        last = F.struct(*([order] if order else []), *rows.columns)

        def merged(base: DataFrame) -> DataFrame:
            both = base.select(*rows.columns).unionByName(rows).withColumn("_order", last)
            return upsert(both.limit(0), both, keys, "_order").drop("_order")

        if touched:
            table.update(touched, merged, rows.schema, table.entry()["note"] | {name: epoch})

    source = spark.readStream.schema(schema).json(in_dir)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("x int").parquet(path)
    except AnalysisException:
        return False
    return True
