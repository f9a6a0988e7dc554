"""Requests, jobs, tasks and certificates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.crypto import canonical_json, deterministic_uuid, sha256_hex
from ..functions.text import certificate_delay_s, egress_violation, retry_delay_ms

#: The state from which each event is allowed, and the state it leads to.
PREDECESSOR = {"USER_VAULTED": "EXECUTING", "USER_HARD_DELETED": "EXECUTING", "NOTIFICATION_SENT": "VAULTED", "SHRED_SUCCESS": "NOTICE_SENT"}
LEADS_TO = {"USER_VAULTED": "VAULTED", "USER_HARD_DELETED": "SHREDDED", "NOTIFICATION_SENT": "NOTICE_SENT", "SHRED_SUCCESS": "SHREDDED"}
TERMINAL = ("CANCELLED", "FAILED")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def transition_code(status: Column, event: Column) -> Column:
    """Null where an event may follow a state, else the refusal's code."""
    return F.when(status.isin(*TERMINAL), "API_OUTBOX_JOB_TERMINAL").when(~F.coalesce(F.try_element_at(_map(PREDECESSOR), event) == status, F.lit(False)), "API_OUTBOX_EVENT_OUT_OF_ORDER")


def job_state_fold(events: DataFrame) -> DataFrame:
    """Each job after its ordered events (job_id, seq, event_type): job_id, status,
    applied and refused; and where events carry rule, notice_due, shred_due (set by the
    vault event) or at (shredded_at), these. Refused events change nothing.

    A job goes through few states, so only events that may matter count: the first of
    each kind after the one it needs, found by windows over the job's rows (they spill);
    a job with very many refused events gathers nothing."""
    c, w = F.col, Window.partitionBy("job_id")
    first = lambda cond: F.min(F.when(cond, c("seq"))).over(w)
    rows = events.withColumn("_open", first(c("event_type").isin("USER_VAULTED", "USER_HARD_DELETED")))
    rows = rows.withColumn("_vault", F.max(F.when((c("seq") == c("_open")) & (c("event_type") == "USER_VAULTED"), c("seq"))).over(w))
    rows = rows.withColumn("_notice", first((c("event_type") == "NOTIFICATION_SENT") & (c("seq") > c("_vault"))))
    rows = rows.withColumn("_shred", first((c("event_type") == "SHRED_SUCCESS") & (c("seq") > c("_notice"))))
    of = lambda name, cond: F.max(F.when(cond, c(name)))
    is_vault, is_end = c("seq") == c("_vault"), (c("seq") == c("_shred")) | ((c("seq") == c("_open")) & c("_vault").isNull())
    more = (("rule", is_vault, "rule"), ("notice_due", is_vault, "notice_due"), ("shred_due", is_vault, "shred_due"), ("at", is_end, "shredded_at"))
    steps = lambda name: (F.max(name).isNotNull()).cast("int")
    applied = steps("_open") + steps("_notice") + steps("_shred")
    status = F.when(F.max("_shred").isNotNull(), "SHREDDED").when(F.max("_notice").isNotNull(), "NOTICE_SENT").when(F.max("_vault").isNotNull(), "VAULTED").when(F.max("_open").isNotNull(), "SHREDDED").otherwise("EXECUTING")
    return rows.groupBy("job_id").agg(status.alias("status"), applied.alias("applied"), (F.count("*").cast("int") - applied).alias("refused"), *[of(name, cond).alias(out) for name, cond, out in more if name in events.columns])


def envelope_code(pairs: list[tuple[Column, Column, str]]) -> Column:
    """The code of the first field in which an event differs from its job."""
    return F.coalesce(*[F.when(~a.eqNullSafe(b), code) for a, b, code in pairs])


def payload_too_large(payload: Column, limit: int = 32_768) -> Column:
    return F.octet_length(canonical_json(payload)) > limit


def schedule_ok(notice: Column, expiry: Column) -> Column:
    """Whether both times parse and the notice is not after the expiry."""
    a, b = F.try_to_timestamp(notice), F.try_to_timestamp(expiry)
    return F.coalesce(a <= b, F.lit(False))


def materialize_due(jobs: DataFrame, tasks: DataFrame, now: Column, per_client: int = 1000) -> DataFrame:
    """Tasks to create: NOTIFY for vaulted jobs and SHRED for noticed ones that are
    due, the earliest of each client and type, once for each job and type."""
    kind = F.when((F.col("status") == "VAULTED") & (F.col("notification_due_at") <= now), "NOTIFY").when((F.col("status") == "NOTICE_SENT") & (F.col("shred_due_at") <= now), "SHRED")
    due = jobs.withColumn("task_type", kind).where("task_type is not null").withColumn("due_at", F.when(F.col("task_type") == "NOTIFY", F.col("notification_due_at")).otherwise(F.col("shred_due_at")))
    new = due.join(tasks.select("job_id", "task_type"), ["job_id", "task_type"], "left_anti")
    order = F.row_number().over(Window.partitionBy("client_id", "task_type").orderBy("due_at", "job_id"))
    return new.withColumn("_n", order).where(F.col("_n") <= per_client).select("job_id", "client_id", "task_type", "due_at")


def next_due(tasks: DataFrame, now: Column) -> DataFrame:
    """The first task of each client that may run now."""
    ready = tasks.where((F.col("status") == "QUEUED") & (F.col("next_attempt_at") <= now))
    order = F.row_number().over(Window.partitionBy("client_id").orderBy(F.coalesce("due_at", "created_at"), "next_attempt_at", "created_at", "task_id"))
    return ready.withColumn("_n", order).where("_n = 1").drop("_n")


def after_ack(task_status: Column, ack: Column, retryable: Column, attempts: Column, most: int = 10) -> Column:
    """A task's state after a worker's answer; answers to tasks not dispatched change nothing."""
    return F.when(task_status != "DISPATCHED", task_status).when(ack == "completed", "COMPLETED").when(~retryable | (attempts + 1 >= most), "DEAD_LETTER").otherwise("QUEUED")


def retry_or_dead_letter(tasks: DataFrame, most: int = 10, base_ms: int = 1000) -> DataFrame:
    """Tasks with ack and retryable: their new status, attempts and delay."""
    status = after_ack(F.col("status"), F.col("ack"), F.col("retryable"), F.col("attempt_count"), most)
    failed = (F.col("status") == "DISPATCHED") & (F.col("ack") == "failed")
    attempts = F.col("attempt_count") + failed.cast("int")
    return tasks.select("task_id", status.alias("new_status"), attempts.alias("attempts"), F.when(failed & (status == "QUEUED"), retry_delay_ms(attempts, base_ms)).alias("delay_ms"), F.when(failed & (status == "DEAD_LETTER"), "FAILED").alias("job_status"))


def burn_in(tasks: DataFrame, needed: int = 100) -> DataFrame:
    """For each client: distinct completed shadow tasks, whether it may go live, and
    when it reached the number."""
    done = tasks.where("shadow and task_type = 'VAULT' and status = 'COMPLETED'").groupBy("client_id", "task_id").agg(F.min("completed_at").alias("completed_at"))
    counts = done.groupBy("client_id").agg(F.count("*").alias("successes"))
    # a client's first tasks alone are ranked: Spark limits each group before the shuffle
    first = done.withColumn("n", F.row_number().over(Window.partitionBy("client_id").orderBy("completed_at", "task_id"))).where(F.col("n") <= needed)
    since = first.where(F.col("n") == needed).select("client_id", F.col("completed_at").alias("live_since"))
    return counts.join(since, "client_id", "left").select("client_id", "successes", (F.col("successes") >= needed).alias("live"), "live_since")


def refusal_code(client_active: Column, live_since: Column, shadow: Column, callback_url: Column) -> Column:
    """Null where a client may ask for an erasure, else the code of the first reason
    against it: the client is inactive, has not finished its burn-in (and asks for more
    than a shadow run), or names a callback that must not be called."""
    early = live_since.isNull() & ~F.coalesce(shadow, F.lit(False))
    return F.when(~F.coalesce(client_active, F.lit(False)), "API_CLIENT_INACTIVE").when(early, "API_BURN_IN_REQUIRED").when(callback_url.isNotNull(), egress_violation(callback_url))


def create_requests(requests: DataFrame, jobs: DataFrame, clients: DataFrame | None = None) -> DataFrame:
    """Each request by its key: created, replayed (equal body), conflict, or refused.
    With ``clients`` (client_id, active, live_since), requests also have client_id,
    shadow and callback_url, and code says why one is refused; refused requests hold no
    key."""
    code = F.lit(None).cast("string")
    if clients is not None:
        requests = requests.join(clients.select("client_id", "active", "live_since"), "client_id", "left")
        code = refusal_code(F.col("active"), F.col("live_since"), F.col("shadow"), F.col("callback_url"))
    requests = requests.withColumn("code", code)
    old = jobs.select("idempotency_key", F.col("body").alias("_body"))
    order = Window.partitionBy("idempotency_key", F.col("code").isNull()).orderBy("request_id")
    first = F.first("body").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = requests.withColumn("_first", first).withColumn("_n", F.row_number().over(order)).join(old, "idempotency_key", "left")
    held = F.coalesce(F.col("_body"), F.when(F.col("_n") > 1, F.col("_first")))
    outcome = F.when(F.col("code").isNotNull(), "refused").when(held.isNull(), "created").when(held == F.col("body"), "replayed").otherwise("conflict")
    return out.select("request_id", "idempotency_key", outcome.alias("outcome"), *(["code"] if clients is not None else []))


#: Distinct ids that one bulk purge may name.
BULK_LIMIT = 10_000


def bulk_purge(ids: DataFrame, jobs: DataFrame, run: str, batch: str | None = None, limit: int = BULK_LIMIT) -> DataFrame:
    """Jobs for ids, with keys that the run and the id alone decide: subject_id,
    idempotency_key, outcome (inserted, duplicate or, in a ``batch`` of more distinct ids
    than the limit, refused) and task_type (VAULT where a task is to be made)."""
    own = [batch] if batch else []
    keyed = ids.select(*own, "subject_id", deterministic_uuid(F.concat_ws(":", F.lit(run), F.col("subject_id").cast("string"))).alias("idempotency_key"))
    size = keyed.groupBy(*own).agg(F.count_distinct("subject_id").alias("_size"))
    keyed = keyed.join(size, own) if own else keyed.withColumn("_one", F.lit(1)).join(size.withColumn("_one", F.lit(1)), "_one").drop("_one")
    n = F.row_number().over(Window.partitionBy("idempotency_key", F.col("_size") > limit).orderBy("subject_id", *own))
    old = jobs.select("idempotency_key").distinct().withColumn("_old", F.lit(True))
    outcome = F.when(F.col("_size") > limit, "refused").when(F.col("_old") | (F.col("_n") > 1), "duplicate").otherwise("inserted")
    out = keyed.withColumn("_n", n).join(old, "idempotency_key", "left").withColumn("outcome", outcome)
    return out.select(*own, "subject_id", "idempotency_key", "outcome", F.when(F.col("outcome") == "inserted", "VAULT").alias("task_type"))


def cancel_code(status: Column) -> Column:
    """Null where a job may still be cancelled."""
    return F.when(status != "WAITING_COOLDOWN", F.concat(F.lit("API_JOB_NOT_CANCELLABLE_"), status))


def cancel_jobs(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Jobs (job_id, status) whose cancellation is asked for, with their tasks (task_id,
    job_id, status): job_id, task_id, code, and the states afterwards. Jobs that may be
    cancelled are, and their open tasks fail; others keep theirs."""
    own = tasks.select("job_id", "task_id", F.col("status").alias("_task"))
    code = cancel_code(F.col("status"))
    task = F.when(code.isNull() & F.col("_task").isin("QUEUED", "DISPATCHED"), "FAILED").otherwise(F.col("_task"))
    return jobs.join(own, "job_id", "left").select("job_id", "task_id", code.alias("code"), F.when(code.isNull(), "CANCELLED").otherwise(F.col("status")).alias("status"), task.alias("task_status"))


def certificates(events: DataFrame) -> DataFrame:
    """One for each finished job (job_id, seq, event_type, current_hash): method,
    canonical payload and its hash."""
    last = events.where(F.col("event_type").isin("SHRED_SUCCESS", "USER_HARD_DELETED")).groupBy("job_id").agg(F.min_by(F.struct("event_type", "current_hash", "seq"), "seq").alias("e"))
    method = F.when(F.col("e.event_type") == "USER_HARD_DELETED", "HARD_DELETE").otherwise("CRYPTO_SHRED")
    payload = canonical_json(F.to_json(F.struct(F.col("e.current_hash").alias("final_hash"), "job_id", method.alias("method"))))
    return last.select("job_id", method.alias("method"), payload.alias("payload"), sha256_hex(payload).alias("payload_hash"))


def mint_certificates(certs: DataFrame, stored: DataFrame) -> DataFrame:
    """New certificates against stored ones (job_id, payload_hash): minted, existing
    (equal payload) or conflict; a stored payload is never replaced."""
    old = stored.select("job_id", F.col("payload_hash").alias("_old"))
    outcome = F.when(F.col("_old").isNull(), "minted").when(F.col("_old") == F.col("payload_hash"), "existing").otherwise("conflict")
    return certs.join(old, "job_id", "left").withColumn("outcome", outcome).drop("_old")


def certificate_ok(payload: Column, payload_hash: Column) -> Column:
    return sha256_hex(canonical_json(payload)) == payload_hash


def archive_due(certs: DataFrame, organisations: DataFrame, now: Column) -> DataFrame:
    """Certificates not archived that are due, with retain_until by their organisation."""
    due = certs.where(F.col("archived_at").isNull() & (F.col("next_archive_at") <= now)).join(organisations, "org_id")
    return due.select("cert_id", "org_id", (now + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.col("retention_days"))).alias("retain_until"), certificate_delay_s(F.col("attempts")).alias("next_delay_s"))


def completion_notices(jobs: DataFrame, targets: DataFrame) -> DataFrame:
    """Callback rows of finished jobs: their own URL and active targets of their
    organisation, client and provider; one for each job and URL."""
    own = jobs.where("callback_url is not null").select("job_id", F.col("callback_url").alias("url"))
    other = jobs.join(targets.where("active"), ["org_id", "client_id", "provider"]).select("job_id", "url")
    return own.unionByName(other).distinct()


def dead_letters(tasks: DataFrame, limit: int | None = None) -> DataFrame:
    out = tasks.where("status = 'DEAD_LETTER'").orderBy(F.desc_nulls_last("dead_lettered_at"), "task_id")
    return out.limit(limit) if limit else out


def release_audit(heartbeats: DataFrame, releases: DataFrame) -> DataFrame:
    """Heartbeats whose configuration is unknown, not approved, or differs from its
    release."""
    r = releases.select("config_hash", F.col("status").alias("_status"), F.col("version").alias("_version"), F.col("dpo").alias("_dpo"))
    code = F.when(F.col("_status").isNull(), "UNKNOWN").when(F.col("_status") != "APPROVED", "NOT_APPROVED").when(~F.col("version").eqNullSafe(F.col("_version")), "VERSION_DIFFERS").when(~F.col("dpo").eqNullSafe(F.col("_dpo")), "DPO_DIFFERS")
    return heartbeats.join(r, "config_hash", "left").withColumn("code", code).where("code is not null").select(*heartbeats.columns, "code")


def _windows(key: str, window_s: int):
    """Requests that come sorted by key and ts, in microseconds; only the open window
    is held. It opens at its first request, not at a clock mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, reset, n = object(), None, 0
        for rows in batches:
            resets, counts = [], []
            for k, ts in zip(rows.column(key).to_pylist(), rows.column("ts").to_pylist(), strict=True):
                if k != own:
                    own, reset = k, None
                if reset is None or (ts is not None and ts >= reset):
                    reset, n = None if ts is None else ts + window_s * 1_000_000, 0
                n += 1
                resets.append(reset)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([rows.column(key), rows.column("ts"), pa.array(counts, pa.int64()), pa.array(resets, pa.int64())], names=[key, "ts", "n", "reset"])

    return run


def fixed_window_budget(requests: DataFrame, key: str, window_s: int, most: int) -> DataFrame:
    """key, ts, allowed, remaining and reset_at for (key, ts). A key's requests are
    sorted in one partition (with spill) and stream by, none gathered in a row."""
    rows = requests.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")).repartition(key).sortWithinPartitions(key, "ts")
    kinds = StructType([rows.schema[key], *(StructField(n, LongType()) for n in ("ts", "n", "reset"))])
    seen = rows.mapInArrow(_windows(key, window_s), kinds)
    return seen.select(key, F.timestamp_micros("ts").alias("ts"), (F.col("n") <= most).alias("allowed"), F.greatest(F.lit(most) - F.col("n"), F.lit(0)).cast("int").alias("remaining"), F.timestamp_micros("reset").alias("reset_at"))
