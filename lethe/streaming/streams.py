"""The event operators as Structured Streaming jobs.

Streams give the same results as the batch operators and are tested against them.
Keyed state lives in Spark's state store. Streams with timers or expiry by the clock
(``due_stream``, and others where that is asked for) go on until they are stopped: run them with
a time trigger or batch by batch (``once``), not with ``availableNow``, which waits for an end of
the timers.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import GENESIS, Intake, chain_head
from ..operators.lifecycle import LEADS_TO, PREDECESSOR, TERMINAL


def ingest_requests(events: DataFrame, mapping: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Webhook events (provider, body, received_at) as mapped requests, each
    idempotency key once within the watermark."""
    from ..operators.ingest import mapped, parsed

    once = parsed(events.withWatermark("received_at", watermark)).dropDuplicatesWithinWatermark(["idempotency_key"])
    return mapped(once, mapping)


def replay_guard(requests: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Signed requests (client_id, signature, received_at), each signature once
    within the window."""
    return requests.withWatermark("received_at", window).dropDuplicatesWithinWatermark(["client_id", "signature"])


def _rocks(df: DataFrame) -> DataFrame:
    """Keyed state with maps, timers and expiry lives in RocksDB, on the executors' disks and
    in the query's checkpoint."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df


_JOB = Row("job_id", "status", "applied", "refused", "rule", "notice_due", "shred_due", "shredded_at")
_TASK = Row("job_id", "client_id", "task_type", "due_at", "attempts", "status")
_ALLOWED = Row("key", "ts", "allowed", "remaining", "reset")
_ENTRY = Row("chain", "id", "key", "payload", "event_type", "job_id", "code", "previous_hash", "current_hash")


def _ms(at: datetime) -> int:
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def _utc(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


class _JobStates(StatefulProcessor):
    """A job after its events. A job that is over is forgotten ``keep_ms`` later."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, applied int, refused int, rule string, notice_due timestamp, shred_due timestamp, shredded_at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, applied, refused, rule, notice, shred, ended = self.job.get() if self.job.exists() else ("EXECUTING", 0, 0, None, None, None, None)
        for r in sorted(rows, key=lambda r: r.seq):
            if status not in TERMINAL and PREDECESSOR.get(r.event_type) == status:
                status, applied = LEADS_TO[r.event_type], applied + 1
                if r.event_type == "USER_VAULTED":
                    rule, notice, shred = r.rule, r.notice_due, r.shred_due
                if status == "SHREDDED":
                    ended = r.at
                    if self.keep_ms is not None:
                        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
            else:
                refused += 1
        state = (status, applied, refused, rule, notice, shred, ended)
        self.job.update(state)
        yield _JOB(*key, *state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.job.clear()
        return iter(())


def job_state_stream(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Updates of job states from (job_id, seq, event_type) and, where events have them,
    rule, notice_due, shred_due (set by the vault event) and at (of the end): what
    ``lifecycle.job_state_fold`` gives. Within a micro-batch events go by sequence; a job's
    later batches must follow. With ``keep_ms`` a job's state is dropped so long after its end,
    by the clock."""
    kinds = {"rule": "string", "notice_due": "timestamp", "shred_due": "timestamp", "at": "timestamp"}
    rows = _rocks(events).select("job_id", "seq", "event_type", *[(F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    out = f"job_id {dict(events.dtypes)['job_id']}, status string, applied int, refused int, rule string, notice_due timestamp, shred_due timestamp, shredded_at timestamp"
    return rows.groupBy("job_id").transformWithState(_JobStates(keep_ms), out, "Update", "None" if keep_ms is None else "ProcessingTime")


class _Due(StatefulProcessor):
    """Tasks of a job when they are due, by timers: each once, and again after a failure
    that may be tried again."""

    def __init__(self, most: int, base_ms: int):
        self.most, self.base_ms = most, base_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "client_id string, task_type string, due bigint")
        self.tasks = handle.getMapState("tasks", "task_type string", "attempts int, at bigint, status string")

    def _emit(self, key, task: str, at: int, now: int) -> Iterator[Row]:
        """Now, or when a timer says so."""
        if at <= now:
            attempts = self.tasks.getValue((task,))[0] if self.tasks.containsKey((task,)) else 0
            self.tasks.updateValue((task,), (attempts, at, "DISPATCHED"))
            client = self.job.get()[0] if self.job.exists() else None
            yield _TASK(*key, client, task, _utc(at), attempts, "DISPATCHED")
        else:
            self.handle.registerTimer(at)

    def _acked(self, key, r, now: int) -> Iterator[Row]:
        if not self.tasks.containsKey((r.task_type,)):
            return
        attempts, at, status = self.tasks.getValue((r.task_type,))
        if status != "DISPATCHED":
            return
        client = self.job.get()[0] if self.job.exists() else None
        if r.ack == "completed":
            self.tasks.updateValue((r.task_type,), (attempts, at, "COMPLETED"))
        elif not r.retryable or attempts + 1 >= self.most:
            self.tasks.updateValue((r.task_type,), (attempts + 1, at, "DEAD_LETTER"))
            yield _TASK(*key, client, r.task_type, _utc(at), attempts + 1, "DEAD_LETTER")
        else:
            at = now + min(self.base_ms * 2**attempts, 300_000)
            self.tasks.updateValue((r.task_type,), (attempts + 1, at, "QUEUED"))
            yield from self._emit(key, r.task_type, at, now)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for r in sorted(rows, key=lambda r: r.seq):
            if r.ack is not None:
                yield from self._acked(key, r, now)
                continue
            task, due = {"VAULTED": ("NOTIFY", r.notification_due_at), "NOTICE_SENT": ("SHRED", r.shred_due_at)}.get(r.status, (None, None))
            if task is None or due is None:
                self.job.clear()  # nothing is due in this state any more
            else:
                self.job.update((r.client_id, task, _ms(due)))
                if not self.tasks.containsKey((task,)):
                    yield from self._emit(key, task, _ms(due), now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.job.exists():
            _, task, due = self.job.get()
            if not self.tasks.containsKey((task,)):
                yield from self._emit(key, task, due, now)
        for (task,), (_, at, status) in list(self.tasks.iterator()):
            if status == "QUEUED" and at <= now:
                yield from self._emit(key, task, at, now)


def due_stream(jobs: DataFrame, most: int = 10, base_ms: int = 1000) -> DataFrame:
    """Tasks as they fall due, from job changes (job_id, seq, client_id, status,
    notification_due_at, shred_due_at) and workers' answers (job_id, seq, task_type, ack,
    retryable) in one stream: job_id, client_id, task_type, due_at, attempts and status.

    NOTIFY of a vaulted job and SHRED of one with its notice sent are emitted at their
    time by timers of the state, each once, whatever restarts come between; a job that has
    left the state before is passed over. A failed answer brings the task again after a
    delay that doubles, or DEAD_LETTER after ``most`` attempts or where it is not retryable.
    Due tasks are those of ``lifecycle.materialize_due`` and answers end as in
    ``lifecycle.retry_or_dead_letter``."""
    kinds = {"client_id": "string", "status": "string", "notification_due_at": "timestamp", "shred_due_at": "timestamp", "task_type": "string", "ack": "string", "retryable": "boolean"}
    rows = _rocks(jobs).select("job_id", "seq", *[(F.col(c) if c in jobs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    out = f"job_id {dict(jobs.dtypes)['job_id']}, client_id string, task_type string, due_at timestamp, attempts int, status string"
    return rows.groupBy("job_id").transformWithState(_Due(most, base_ms), out, "Append", "ProcessingTime")


class _Budget(StatefulProcessor):
    """The open window of a key; its state ends with it."""

    def __init__(self, window_s: int, most: int):
        self.window_s, self.most = window_s, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "reset bigint, n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        reset, n = self.window.get() if self.window.exists() else (0, 0)
        opened = set()
        for r in sorted(rows, key=lambda r: r.micros):
            if r.micros >= reset:
                reset, n = r.micros + self.window_s * 1_000_000, 0
                opened = {reset}
            n += 1
            yield _ALLOWED(*key, r.ts, n <= self.most, max(self.most - n, 0), reset)
        for at in opened:
            self.handle.registerTimer(at // 1000 + 1)
        self.window.update((reset, n))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.window.exists() and self.window.get()[0] // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter(())


def budget_stream(requests: DataFrame, window_s: int, most: int, watermark: str = "1 hour") -> DataFrame:
    """Rate limits of (key, ts) by windows that open at the first request, as
    ``lifecycle.fixed_window_budget`` gives them. A window's state ends when the watermark
    passes its end; requests later than the watermark are dropped. A request without
    a time is a window of its own."""
    kind = dict(requests.dtypes)["key"]
    timed = _rocks(requests).where("ts is not null").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).withWatermark("ts", watermark)
    out = timed.groupBy("key").transformWithState(_Budget(window_s, most), f"key {kind}, ts timestamp, allowed boolean, remaining int, reset bigint", "Append", "EventTime")
    own = requests.where("ts is null").select("key", "ts", F.lit(most >= 1).alias("allowed"), F.lit(max(most - 1, 0)).alias("remaining"), F.lit(None).cast("timestamp").alias("reset_at"))
    return out.select("key", "ts", "allowed", "remaining", F.timestamp_micros("reset").alias("reset_at")).unionByName(own)


class _Chains(StatefulProcessor):
    """``operators.ledger.Intake`` over a stream: head, known keys and jobs are state."""

    def __init__(self, most_bytes: int | None, ttl_ms: int | None):
        self.most_bytes, self.ttl_ms = most_bytes, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "hash string")
        self.keys = handle.getMapState("keys", "key string", "digest binary", self.ttl_ms)
        self.jobs = handle.getMapState("jobs", "job string", "status string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        intake = Intake(self.head.get()[0] if self.head.exists() else GENESIS, _Held(self.keys), _Held(self.jobs), self.most_bytes)
        for r in sorted(rows, key=lambda r: (r.created_at is not None, r.created_at, r.id)):
            code, before, now = intake.take(r.payload, r.key, r.event_type, r.previous_hash, r.current_hash, r.job_id, r.status)
            yield _ENTRY(*key, r.id, r.key, r.payload, r.event_type, r.job_id, code, before, now)
        self.head.update((intake.head,))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if initialState.key is None:
            self.head.update((initialState.hash,))
        else:
            self.keys.updateValue((initialState.key,), (bytes(initialState.digest),))


class _Held:
    """Map state as a dictionary."""

    def __init__(self, state):
        self.state = state

    def get(self, key):
        if key is None or not self.state.containsKey((key,)):
            return None
        value = self.state.getValue((key,))[0]
        return bytes(value) if isinstance(value, (bytes, bytearray)) else value

    def __setitem__(self, key, value) -> None:
        self.state.updateValue((key,), (value,))


def ledger_stream(entries: DataFrame, ledger: DataFrame | None = None, most_bytes: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The intake of (chain, created_at, id, payload, key, previous_hash, current_hash, and
    maybe event_type, job_id, status) as a stream: what ``operators.ledger.take_in``
    gives for the same entries at once, if they come in their order. Returns chain, id, key,
    payload, event_type, job_id, code (null: accepted), previous_hash and current_hash.

    A chain's head, its keys and its jobs are state, which goes on from ``ledger`` (chain,
    seq, key, payload, current_hash, event_type) in a new query. Keys and jobs not written
    for ``ttl_ms`` are forgotten, if it is given: a replay that comes later counts as new."""
    optional = [(F.col(c) if c in entries.columns else F.lit(None)).cast("string").alias(c) for c in ("event_type", "job_id", "status")]
    rows = _rocks(entries).select("chain", "created_at", "id", "payload", "key", "previous_hash", "current_hash", *optional)
    kinds = dict(entries.dtypes)
    out = f"chain {kinds['chain']}, id {kinds['id']}, key string, payload string, event_type string, job_id string, code string, previous_hash string, current_hash string"
    start = None
    if ledger is not None:
        kind = F.coalesce("event_type", F.lit("")) if "event_type" in ledger.columns else F.lit("")
        digest = F.substring(F.unhex(F.sha2(F.concat(kind, F.lit("\n"), "payload"), 256)), 1, 16)
        none = F.lit(None).cast("string")
        heads = chain_head(ledger).select("chain", none.alias("key"), F.col("head").alias("hash"), none.cast("binary").alias("digest"))
        start = heads.unionByName(ledger.select("chain", "key", none.alias("hash"), digest.alias("digest"))).groupBy("chain")
    return rows.groupBy("chain").transformWithState(_Chains(most_bytes, ttl_ms), out, "Append", "None" if ttl_ms is None else "ProcessingTime", start)


def ledger_ingest(batch: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of one micro-batch against the ledger, as ``operators.ledger.take_in``
    judges them: rows to append and rejects (code). For use in ``foreachBatch``, where the
    ledger is a table; both results come from one written frame."""
    from ..operators.ledger import take_in
    from ..sources.tables import stored

    taken = stored(take_in(batch, ledger))
    more = [c for c in ("created_at", "payload", "key", "event_type", "job_id") if c in batch.columns]
    sent = batch.select("chain", "id", *more, F.col("current_hash").alias("worker_hash"))
    accepted = taken.where("code is null").drop("code").join(sent, ["chain", "id"])
    return accepted, taken.where("code is not null").select("chain", "id", "code")


def append_batches(stream: DataFrame, path: str, key: list[str], checkpoint: str, buckets: int = 64):
    """Start a query that appends each key once to a Parquet table, over all batches.

    The table is partitioned by buckets of the key's hash. A micro-batch is joined to
    the buckets that it touches alone (dynamic partition pruning by its own, few bucket
    numbers), and of these only the key columns are read."""
    from ..sources.tables import append_once

    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_bucket", bucket).persist()
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        exists = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
        target = spark.read.schema(rows.schema).parquet(path).where(F.col("_bucket").isin(touched)) if exists else rows.limit(0)
        append_once(target, rows, key, [F.col(batch.columns[0])]).write.mode("append").partitionBy("_bucket").parquet(path)
        rows.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
