"""Ledger, jobs, tasks, certificates, ingest: made from the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.crypto import canonical_json, sha256_hex
from ..operators import ingest, ledger, lifecycle, report
from ..sources import tables
from .base import Registry, load

R = Registry()
NOW_TS = "2024-06-01 00:00:00"


def _now():
    return F.to_timestamp(F.lit(NOW_TS))


def _pending(spark, sf_dir):
    """A chain for each user; payloads are canonical JSON."""
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"), canonical_json(F.col("props")).alias("payload"), F.concat(F.lit("k:"), F.col("event_id").cast("string")).alias("key"), "event_type")


def _ledger(spark, sf_dir):
    """The built chains as a ledger; event types error are heartbeats, and every
    tenth user's chain has a corrupted row."""
    rows = _pending(spark, sf_dir)
    beats = rows.where("event_type = 'error'").select("chain", F.col("id").alias("seq"), "payload", "key", F.lit("HEARTBEAT").alias("event_type"), sha256_hex("key").alias("previous_hash"), sha256_hex("key").alias("current_hash"))
    chains = ledger.chain_finalize(rows.where("event_type <> 'error'")).join(rows.select("chain", "id", "payload", "key", "event_type"), ["chain", "id"])
    last = F.max("id").over(Window.partitionBy("chain"))
    bad = (F.col("chain") % 10 == 3) & (F.col("id") == last)
    chains = chains.withColumn("payload", F.when(bad, F.lit("{}")).otherwise(F.col("payload")))
    return chains.select("chain", F.col("id").alias("seq"), "payload", "key", "event_type", "previous_hash", "current_hash").unionByName(beats)


_ORDERED = "(SELECT user_id AS chain, event_id AS id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS payload, 'k:' || CAST(event_id AS VARCHAR) AS key, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events@)"
_CHAIN = "WITH RECURSIVE p AS (SELECT * FROM " + _ORDERED + " o), c AS (SELECT chain, id, n, 'GENESIS' AS previous_hash, sha256('GENESIS' || payload || key) AS current_hash FROM p WHERE n = 1 UNION ALL SELECT p.chain, p.id, p.n, c.current_hash, sha256(c.current_hash || p.payload || p.key) FROM c JOIN p ON p.chain = c.chain AND p.n = c.n + 1)"


@R.add(_CHAIN.replace("@", "") + " SELECT chain, id, previous_hash, current_hash FROM c")
def chain_finalize(spark, sf_dir):
    return ledger.chain_finalize(_pending(spark, sf_dir))


_QUIET = _CHAIN.replace("@", " WHERE event_type <> 'error'")


@R.add(_QUIET + " SELECT chain, arg_max(current_hash, id) AS head FROM c GROUP BY 1")
def chain_head(spark, sf_dir):
    return ledger.chain_head(_ledger(spark, sf_dir))


@R.add(_QUIET + """, bad AS (SELECT chain, max(id) AS at FROM c WHERE chain % 10 = 3 GROUP BY 1),
    allrows AS (SELECT e.user_id AS chain, e.event_id AS seq, e.event_type FROM events e)
    SELECT a.chain, count(*) AS checked, max(b.at) AS first_bad_seq, max(CASE WHEN b.at IS NOT NULL THEN 'current_hash_mismatch' END) AS reason,
           arg_max(c.current_hash, CASE WHEN c.id IS NOT NULL AND (b.at IS NULL OR c.id < b.at) THEN a.seq END) AS head
    FROM allrows a LEFT JOIN bad b ON b.chain = a.chain LEFT JOIN c ON c.id = a.seq AND c.chain = a.chain WHERE b.at IS NULL OR a.seq <= b.at GROUP BY 1""")
def chain_verify(spark, sf_dir):
    return ledger.chain_verify(_ledger(spark, sf_dir))


@R.add(_CHAIN.replace("@", "") + """, run AS (SELECT c.*, min(CASE WHEN c.id % 9 <> 5 THEN 1 ELSE 0 END) OVER (PARTITION BY chain ORDER BY n) AS ok FROM c)
    SELECT chain, id AS seq FROM run WHERE ok = 1""")
def chain_contiguous_batch(spark, sf_dir):
    built = ledger.chain_finalize(_pending(spark, sf_dir)).withColumnRenamed("id", "seq")
    late = _now() + F.make_dt_interval(F.when(F.col("seq") % 9 == 5, 1).otherwise(-1))
    none = spark.createDataFrame([], "chain long, last_hash string")
    return ledger.contiguous_batch(built.withColumn("next_attempt_at", late), none, _now()).select("chain", "seq")


@R.add(_QUIET + " SELECT CAST(id AS BIGINT) AS seq, current_hash FROM c WHERE chain = 4 AND id > 100")
def ledger_export(spark, sf_dir):
    return ledger.ledger_export(_ledger(spark, sf_dir).where("event_type <> 'HEARTBEAT'"), chain=4, after_seq=100).select("seq", "current_hash")


@R.add("SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1")
def event_type_counts(spark, sf_dir):
    """Of the subjects of one segment."""
    own = load(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"))
    return report.group_counts(load(spark, sf_dir, "events").join(own, "user_id", "left_semi"), ["event_type"])


@R.add("SELECT event_id FROM events WHERE regexp_matches(props, '\"k\": 8[0-9]')")
def leak_scan(spark, sf_dir):
    return ledger.leak_scan(load(spark, sf_dir, "events").withColumn("payload", F.col("props")), patterns=['"k": 8[0-9]']).select("event_id")


_PAYLOADS = "(SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{\"name\":\"' || c_name || '\"}' WHEN event_id % 4 = 1 THEN '{\"a.b\":\"' || replace(c_name, '#', 'x') || '\"}' ELSE props END AS payload FROM events LEFT JOIN customer ON c_custkey = user_id) p"


@R.add(f"SELECT event_id, c_name AS marker FROM {_PAYLOADS} JOIN customer ON contains(payload, c_name) WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE')")
def leak_matches(spark, sf_dir):
    """Payloads of which some hold names, searched for the raw names of two segments."""
    c = load(spark, sf_dir, "customer")
    n = F.col("event_id") % 4
    rows = load(spark, sf_dir, "events").join(c.select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id", "left")
    payload = F.when(n == 0, F.concat(F.lit('{"name":"'), "c_name", F.lit('"}'))).when(n == 1, F.concat(F.lit('{"a.b":"'), F.replace("c_name", F.lit("#"), F.lit("x")), F.lit('"}'))).otherwise(F.col("props"))
    return ledger.leak_matches(rows.select("event_id", payload.alias("payload")), c.where(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE")).select(F.col("c_name").alias("marker")), ["event_id"])


@R.add("""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) t
    WHERE n = 1 AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id % 50 = 0)""")
def append_once(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return tables.append_once(events.where("event_id % 50 = 0"), events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "event_type")


@R.add("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (old AND event_type = 'purchase') DESC, event_id DESC) AS n
    FROM (SELECT *, event_id % 2 = 0 AS old FROM events) e) t WHERE n = 1""")
def upsert_latest(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.col("event_type") == "purchase"), F.desc("event_id")))
    old = rows.where("event_id % 2 = 0").withColumn("n", newest).where("n = 1").drop("n")
    return tables.upsert_latest(old, rows.where("event_id % 2 = 1"), ["user_id"], F.col("event_id"), F.col("event_type") == "purchase").select("user_id", "event_id", "value")


@R.add("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) t WHERE n = 1")
def dedupe_first(spark, sf_dir):
    return tables.dedupe_first(load(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@R.add("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def purge_partition_rows(spark, sf_dir):
    return tables.purge_expired(load(spark, sf_dir, "events"), "ts", F.to_timestamp(F.lit("2024-01-15"))).select("event_id")


#: view vaults, click notifies, purchase shreds, error deletes; signup is no event of a job.
_AS_EVENT = {"view": "USER_VAULTED", "click": "NOTIFICATION_SENT", "purchase": "SHRED_SUCCESS", "error": "USER_HARD_DELETED", "signup": "UNKNOWN"}
_EVENT_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _AS_EVENT.items()) + " END"


def _job_events(spark, sf_dir):
    name = F.element_at(F.create_map(*[F.lit(x) for kv in _AS_EVENT.items() for x in kv]), F.col("event_type"))
    # ten events of a user make a job
    return load(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).select((F.col("user_id") * 1000000 + F.floor(F.col("n") / 10)).alias("job_id"), F.col("event_id").alias("seq"), name.alias("event_type"))


_FITS = "((f.status = 'EXECUTING' AND ev IN ('USER_VAULTED', 'USER_HARD_DELETED')) OR (f.status = 'VAULTED' AND ev = 'NOTIFICATION_SENT') OR (f.status = 'NOTICE_SENT' AND ev = 'SHRED_SUCCESS'))"
_FOLD = f"""WITH RECURSIVE e AS (SELECT user_id * 1000000 + (n - 1) // 10 AS job_id, event_id AS seq, (n - 1) % 10 + 1 AS i, {_EVENT_SQL} AS ev FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) x),
    f AS (SELECT job_id, CAST(0 AS BIGINT) AS i, 'EXECUTING' AS status, 0 AS applied, 0 AS refused, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS BIGINT) AS seq FROM (SELECT DISTINCT job_id FROM e) j
    UNION ALL SELECT e.job_id, e.i, CASE WHEN {_FITS} THEN CASE ev WHEN 'USER_VAULTED' THEN 'VAULTED' WHEN 'NOTIFICATION_SENT' THEN 'NOTICE_SENT' ELSE 'SHREDDED' END ELSE f.status END,
        f.applied + CASE WHEN {_FITS} THEN 1 ELSE 0 END, f.refused + CASE WHEN {_FITS} THEN 0 ELSE 1 END, CASE WHEN {_FITS} THEN NULL ELSE 'API_OUTBOX_EVENT_OUT_OF_ORDER' END, e.seq FROM f JOIN e ON e.job_id = f.job_id AND e.i = f.i + 1)"""


_RULE = "'rule ' || CAST(seq % 3 AS VARCHAR)"
_FOLDED = _FOLD.replace("CAST(NULL AS BIGINT) AS seq FROM (SELECT DISTINCT", "CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS kind FROM (SELECT DISTINCT").replace("e.seq FROM f JOIN e", "e.seq, e.ev FROM f JOIN e")


@R.add(_FOLDED + f""", last AS (SELECT job_id, arg_max(status, i) AS status, arg_max(applied, i) AS applied, arg_max(refused, i) AS refused, max(CASE WHEN code IS NULL AND kind = 'USER_VAULTED' THEN seq END) AS vaulted, max(CASE WHEN code IS NULL AND kind IN ('SHRED_SUCCESS', 'USER_HARD_DELETED') THEN seq END) AS ended FROM f GROUP BY 1)
    SELECT job_id, status, applied, refused, {_RULE.replace('seq', 'vaulted')} AS rule, v.ts + INTERVAL 5 DAY AS notice_due, v.ts + INTERVAL 7 DAY AS shred_due, x.ts AS shredded_at
    FROM last LEFT JOIN events v ON v.event_id = vaulted LEFT JOIN events x ON x.event_id = ended""")
def job_state_fold(spark, sf_dir):
    times = load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    rows = _job_events(spark, sf_dir).join(times, "seq").withColumn("rule", F.concat(F.lit("rule "), (F.col("seq") % 3).cast("string")))
    return lifecycle.job_state_fold(rows.withColumn("notice_due", F.col("at") + F.make_dt_interval(F.lit(5))).withColumn("shred_due", F.col("at") + F.make_dt_interval(F.lit(7))))


@R.add(f"""SELECT s AS status, ev AS event_type, CASE WHEN s IN ('CANCELLED', 'FAILED') THEN 'API_OUTBOX_JOB_TERMINAL' WHEN (s = 'EXECUTING' AND ev IN ('USER_VAULTED', 'USER_HARD_DELETED')) OR (s = 'VAULTED' AND ev = 'NOTIFICATION_SENT')
    OR (s = 'NOTICE_SENT' AND ev = 'SHRED_SUCCESS') THEN NULL ELSE 'API_OUTBOX_EVENT_OUT_OF_ORDER' END AS code, count(*) AS n
    FROM (SELECT {_EVENT_SQL} AS ev, ['EXECUTING', 'VAULTED', 'NOTICE_SENT', 'SHREDDED', 'WAITING_COOLDOWN', 'CANCELLED', 'FAILED'][CAST(event_id % 7 AS INTEGER) + 1] AS s FROM events) t GROUP BY 1, 2, 3""")
def transition_guard(spark, sf_dir):
    states = F.array(*[F.lit(s) for s in ("EXECUTING", "VAULTED", "NOTICE_SENT", "SHREDDED", "WAITING_COOLDOWN", "CANCELLED", "FAILED")])
    rows = _job_events(spark, sf_dir).withColumn("status", F.get(states, (F.col("seq") % 7).cast("int")))
    return rows.groupBy("status", "event_type", lifecycle.transition_code(F.col("status"), F.col("event_type")).alias("code")).agg(F.count("*").alias("n"))


def _jobs(spark, sf_dir):
    """Orders as jobs: states and times by order number."""
    n = F.col("o_orderkey")
    states = F.array(*[F.lit(s) for s in ("WAITING_COOLDOWN", "EXECUTING", "VAULTED", "NOTICE_SENT", "SHREDDED", "FAILED", "CANCELLED")])
    return load(spark, sf_dir, "orders").select(n.alias("job_id"), (n % 5).alias("client_id"), F.get(states, (n % 7).cast("int")).alias("status"), (F.col("o_orderdate") + F.make_interval(F.lit(1))).alias("notification_due_at"), (F.col("o_orderdate") + F.make_interval(F.lit(2))).alias("shred_due_at"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("subject_id"))


_JOBS = "(SELECT o_orderkey AS job_id, o_orderkey % 5 AS client_id, ['WAITING_COOLDOWN', 'EXECUTING', 'VAULTED', 'NOTICE_SENT', 'SHREDDED', 'FAILED', 'CANCELLED'][CAST(o_orderkey % 7 AS INTEGER) + 1] AS status, o_orderdate + to_years(1) AS notification_due_at, o_orderdate + to_years(2) AS shred_due_at, o_orderdate AS created_at, o_custkey AS subject_id FROM orders)"
_DUE = "1997-06-01 00:00:00"


@R.add(f"""SELECT job_id, client_id, task_type, due_at FROM (SELECT *, row_number() OVER (PARTITION BY client_id, task_type ORDER BY due_at, job_id) AS n FROM (
    SELECT job_id, client_id, CASE WHEN status = 'VAULTED' THEN 'NOTIFY' ELSE 'SHRED' END AS task_type, CASE WHEN status = 'VAULTED' THEN notification_due_at ELSE shred_due_at END AS due_at
    FROM {_JOBS} j WHERE status IN ('VAULTED', 'NOTICE_SENT')) d WHERE due_at <= TIMESTAMP '{_DUE}' AND job_id % 10 <> 0) t WHERE n <= 1000""")
def materialize_due(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    have = jobs.where("job_id % 10 = 0").select("job_id", F.explode(F.array(F.lit("NOTIFY"), F.lit("SHRED"))).alias("task_type"))
    return lifecycle.materialize_due(jobs, have, F.to_timestamp(F.lit(_DUE)))


def _tasks(spark, sf_dir):
    """Line items as tasks."""
    n, k = F.col("l_orderkey"), F.col("l_linenumber")
    kinds = F.array(*[F.lit(s) for s in ("VAULT", "NOTIFY", "SHRED")])
    states = F.array(*[F.lit(s) for s in ("QUEUED", "DISPATCHED", "COMPLETED", "FAILED", "DEAD_LETTER")])
    at = F.col("l_shipdate")
    return load(spark, sf_dir, "lineitem").select((n * 10 + k).alias("task_id"), n.alias("job_id"), (n % 5).alias("client_id"), F.get(kinds, (k % 3).cast("int")).alias("task_type"), F.get(states, ((n + k) % 5).cast("int")).alias("status"), ((n + k) % 12).cast("int").alias("attempt_count"), F.when(n % 2 == 0, "failed").otherwise("completed").alias("ack"), (n % 3 != 0).alias("retryable"), (k % 2 == 0).alias("shadow"), at.alias("created_at"), at.alias("next_attempt_at"), at.alias("due_at"), (at + F.make_dt_interval(F.lit(0), F.lit(0), (n % 60).cast("int"))).alias("completed_at"))


_TASKS = "(SELECT l_orderkey * 10 + l_linenumber AS task_id, l_orderkey AS job_id, l_orderkey % 5 AS client_id, ['VAULT', 'NOTIFY', 'SHRED'][CAST(l_linenumber % 3 AS INTEGER) + 1] AS task_type, ['QUEUED', 'DISPATCHED', 'COMPLETED', 'FAILED', 'DEAD_LETTER'][CAST((l_orderkey + l_linenumber) % 5 AS INTEGER) + 1] AS status, CAST((l_orderkey + l_linenumber) % 12 AS INTEGER) AS attempt_count, l_orderkey % 2 = 0 AS failed, l_orderkey % 3 <> 0 AS retryable, l_linenumber % 2 = 0 AS shadow, l_shipdate AS created_at, l_shipdate + to_minutes(CAST(l_orderkey % 60 AS INTEGER)) AS completed_at FROM lineitem)"


@R.add(f"SELECT client_id, task_id FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY created_at, task_id) AS n FROM {_TASKS} t WHERE status = 'QUEUED' AND created_at <= TIMESTAMP '{_DUE}') x WHERE n = 1")
def next_due_per_client(spark, sf_dir):
    return lifecycle.next_due(_tasks(spark, sf_dir), F.to_timestamp(F.lit(_DUE))).select("client_id", "task_id")


@R.add(f"""SELECT task_id, new_status, attempts, CASE WHEN hit AND new_status = 'QUEUED' THEN CAST(least(1000 * pow(2, attempts - 1), 300000) AS BIGINT) END AS delay_ms, CASE WHEN hit AND new_status = 'DEAD_LETTER' THEN 'FAILED' END AS job_status FROM (
    SELECT *, status = 'DISPATCHED' AND failed AS hit, attempt_count + CASE WHEN status = 'DISPATCHED' AND failed THEN 1 ELSE 0 END AS attempts,
    CASE WHEN status <> 'DISPATCHED' THEN status WHEN NOT failed THEN 'COMPLETED' WHEN NOT retryable OR attempt_count + 1 >= 10 THEN 'DEAD_LETTER' ELSE 'QUEUED' END AS new_status FROM {_TASKS} t) x""")
def retry_or_dead_letter(spark, sf_dir):
    return lifecycle.retry_or_dead_letter(_tasks(spark, sf_dir))


@R.add(f"""SELECT client_id, max(n) AS successes, max(n) >= 100 AS live, min(CASE WHEN n = 100 THEN completed_at END) AS live_since FROM (
    SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY completed_at, task_id) AS n FROM (SELECT client_id, task_id, min(completed_at) AS completed_at FROM {_TASKS} t WHERE shadow AND task_type = 'VAULT' AND status = 'COMPLETED' GROUP BY 1, 2) d) x GROUP BY 1""")
def burn_in(spark, sf_dir):
    return lifecycle.burn_in(_tasks(spark, sf_dir), 100)


@R.add(f"SELECT task_id, job_id FROM {_TASKS} t WHERE status = 'DEAD_LETTER'")
def dead_letter_list(spark, sf_dir):
    return lifecycle.dead_letters(_tasks(spark, sf_dir).withColumn("dead_lettered_at", F.col("completed_at"))).select("task_id", "job_id")


@R.add(f"SELECT task_id, CASE WHEN status = 'DEAD_LETTER' AND client_id = 2 THEN 'QUEUED' ELSE status END AS status FROM {_TASKS} t")
def dead_letter_requeue(spark, sf_dir):
    hit = (F.col("status") == "DEAD_LETTER") & (F.col("client_id") == 2)
    return _tasks(spark, sf_dir).select("task_id", F.when(hit, "QUEUED").otherwise(F.col("status")).alias("status"))


@R.add(f"""SELECT task_type, quantile_cont((epoch_us(completed_at) - epoch_us(created_at)) / 1000, 0.95) AS p95_ms FROM {_TASKS} t WHERE status = 'COMPLETED' GROUP BY GROUPING SETS ((task_type), ())""")
def task_latency_p95(spark, sf_dir):
    return report.task_latency_p95(_tasks(spark, sf_dir).where("status = 'COMPLETED'"))


@R.add(f"SELECT count(*) AS total, count(*) FILTER (status = 'VAULTED') AS n_vaulted, count(*) FILTER (status = 'FAILED') AS n_failed FROM {_JOBS} j")
def job_status_counts(spark, sf_dir):
    return report.job_status_counts(_jobs(spark, sf_dir), ["VAULTED", "FAILED"])


@R.add(f"SELECT status, task_type, count(*) AS n FROM {_TASKS} t GROUP BY 1, 2")
def status_group_counts(spark, sf_dir):
    return report.group_counts(_tasks(spark, sf_dir), ["status", "task_type"])


@R.add(f"SELECT count(*) AS jobs, round(count(*) / 3600.0, 2) AS jobs_per_second FROM {_JOBS} j")
def lifecycle_throughput(spark, sf_dir):
    return report.lifecycle_throughput(_jobs(spark, sf_dir), 3600.0)


@R.add(f"SELECT job_id, status FROM {_JOBS} j WHERE status = 'VAULTED' ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 100")
def jobs_page(spark, sf_dir):
    return report.page(_jobs(spark, sf_dir), [F.desc("created_at"), F.col("job_id")], 50, 100, F.col("status") == "VAULTED").select("job_id", "status")


@R.add(f"SELECT job_id FROM {_JOBS} j WHERE client_id = 3 AND status = 'FAILED'")
def optional_filters(spark, sf_dir):
    from ..sources.catalog import conditions

    return _jobs(spark, sf_dir).where(conditions(client_id=3, status="FAILED", subject_id=None)).select("job_id")


@R.add("SELECT count(*) FILTER (event_type <> 'purchase') AS unfinished, count(*) FILTER (event_type = 'error') AS unfinalised FROM events")
def outbox_lag(spark, sf_dir):
    kind = F.col("event_type")
    return report.outbox_lag(load(spark, sf_dir, "events").select(F.when(kind == "purchase", "PROCESSED").otherwise("PENDING").alias("status"), F.when(kind != "error", "h").alias("current_hash")))


@R.add(f"""SELECT j.job_id, task_id, CASE WHEN j.status <> 'WAITING_COOLDOWN' THEN 'API_JOB_NOT_CANCELLABLE_' || j.status END AS code, CASE WHEN j.status = 'WAITING_COOLDOWN' THEN 'CANCELLED' ELSE j.status END AS status,
    CASE WHEN j.status = 'WAITING_COOLDOWN' AND t.status IN ('QUEUED', 'DISPATCHED') THEN 'FAILED' ELSE t.status END AS task_status
    FROM {_JOBS} j LEFT JOIN (SELECT l_orderkey AS job_id, l_orderkey * 10 + l_linenumber AS task_id, ['QUEUED', 'DISPATCHED', 'COMPLETED'][l_linenumber % 3 + 1] AS status FROM lineitem) t ON t.job_id = j.job_id""")
def cancel_requests(spark, sf_dir):
    """Orders as jobs, their lines as tasks."""
    states = F.array(*[F.lit(s) for s in ("QUEUED", "DISPATCHED", "COMPLETED")])
    tasks = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("task_id"), F.get(states, F.col("l_linenumber") % 3).alias("status"))
    return lifecycle.cancel_jobs(_jobs(spark, sf_dir), tasks)


_URLS = ["https://hooks.example/x", "http://hooks.example/x", "https://10.0.0.8/x"]
_CODED = """(SELECT event_id AS request_id, 'r' || CAST(user_id AS VARCHAR) || event_type AS idempotency_key, CAST(event_id % 3 = 0 AS VARCHAR) AS body, CASE WHEN user_id % 11 = 10 OR user_id % 11 = 0 THEN 'API_CLIENT_INACTIVE' WHEN user_id % 11 IN (3, 4) AND event_id % 2 = 1 THEN 'API_BURN_IN_REQUIRED'
    WHEN event_id % 7 = 1 THEN 'API_WEBHOOK_URL_PROTOCOL_INVALID' WHEN event_id % 7 = 2 THEN 'API_WEBHOOK_URL_HOST_FORBIDDEN' END AS code, event_type, user_id FROM events)"""


@R.add(f"""SELECT request_id, idempotency_key, CASE WHEN code IS NOT NULL THEN 'refused' WHEN held IS NULL THEN 'created' WHEN held = body THEN 'replayed' ELSE 'conflict' END AS outcome, code FROM (
    SELECT *, CASE WHEN ends_with(idempotency_key, 'click') THEN 'true' WHEN row_number() OVER w > 1 THEN first_value(body) OVER w END AS held FROM {_CODED} r WINDOW w AS (PARTITION BY user_id, event_type, code IS NULL ORDER BY request_id)) x""")
def create_request(spark, sf_dir):
    """Clients by user; some unknown, inactive or not live yet, some callbacks unsafe."""
    client = F.col("user_id") % 11
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("r"), F.col("user_id").cast("string"), "event_type").alias("idempotency_key"), (F.col("event_id") % 3 == 0).cast("string").alias("body"), "event_type", client.alias("client_id"), (F.col("event_id") % 2 == 0).alias("shadow"), F.get(F.array(*[F.lit(u) for u in _URLS]), (F.col("event_id") % 7).cast("int")).alias("callback_url"))
    clients = rows.select("client_id").distinct().where("client_id <> 10").select("client_id", (F.col("client_id") != 0).alias("active"), F.when(~F.col("client_id").isin(3, 4), _now()).alias("live_since"))
    stored = rows.where("event_type = 'click'").select("idempotency_key", F.lit("true").alias("body")).distinct()
    return lifecycle.create_requests(rows, stored, clients)


@R.add("""SELECT batch, subject_id, outcome, CASE WHEN outcome = 'inserted' THEN 'VAULT' END AS task_type FROM (SELECT batch, subject_id, CASE WHEN size > 100 THEN 'refused' WHEN subject_id % 4 = 0 OR row_number() OVER (PARTITION BY subject_id, size > 100 ORDER BY batch) > 1 THEN 'duplicate' ELSE 'inserted' END AS outcome
    FROM (SELECT o_orderpriority AS batch, o_custkey AS subject_id FROM orders) o JOIN (SELECT o_orderpriority AS batch, count(DISTINCT o_custkey) AS size FROM orders GROUP BY 1) s USING (batch)) t""")
def bulk_purge(spark, sf_dir):
    """A batch for each priority of orders; those of more than a hundred ids are refused."""
    ids = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("batch"), F.col("o_custkey").alias("subject_id"))
    stored = lifecycle.bulk_purge(ids.where("subject_id % 4 = 0").select("subject_id").distinct(), spark.createDataFrame([], "idempotency_key string"), "run", limit=1 << 40)
    return lifecycle.bulk_purge(ids, stored, "run", "batch", 100).select("batch", "subject_id", "outcome", "task_type")


def _finished(spark, sf_dir):
    rows = _job_events(spark, sf_dir)
    return rows.withColumn("current_hash", sha256_hex(F.col("seq").cast("string")))


_CERTS = f"""SELECT job_id, arg_min(CASE WHEN ev = 'USER_HARD_DELETED' THEN 'HARD_DELETE' ELSE 'CRYPTO_SHRED' END, seq) AS method,
    '{{"final_hash":"' || sha256(CAST(min(seq) AS VARCHAR)) || '","job_id":' || CAST(job_id AS VARCHAR) || ',"method":"' || arg_min(CASE WHEN ev = 'USER_HARD_DELETED' THEN 'HARD_DELETE' ELSE 'CRYPTO_SHRED' END, seq) || '"}}' AS payload
    FROM (SELECT user_id * 1000000 + (n - 1) // 10 AS job_id, event_id AS seq, {_EVENT_SQL} AS ev FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) x) e WHERE ev IN ('SHRED_SUCCESS', 'USER_HARD_DELETED') GROUP BY 1"""


@R.add(f"SELECT job_id, method, payload, sha256(payload) AS payload_hash FROM ({_CERTS}) c")
def certificate_mint(spark, sf_dir):
    return lifecycle.certificates(_finished(spark, sf_dir))


@R.add(f"SELECT job_id, method, sha256(payload) AS payload_hash, CASE job_id % 3 WHEN 0 THEN 'conflict' WHEN 1 THEN 'existing' ELSE 'minted' END AS outcome FROM ({_CERTS}) c")
def certificate_conflicts(spark, sf_dir):
    """A third of the jobs have a certificate of another payload, a third of this one."""
    c = lifecycle.certificates(_finished(spark, sf_dir))
    stored = c.where("job_id % 3 <= 1").select("job_id", F.when(F.col("job_id") % 3 == 0, sha256_hex("payload_hash")).otherwise(F.col("payload_hash")).alias("payload_hash"))
    return lifecycle.mint_certificates(c, stored).select("job_id", "method", "payload_hash", "outcome")


@R.add(f"SELECT job_id, job_id % 3 <> 0 AS ok FROM ({_CERTS}) c")
def certificate_payload_check(spark, sf_dir):
    c = lifecycle.certificates(_finished(spark, sf_dir))
    return c.select("job_id", lifecycle.certificate_ok(F.col("payload"), F.when(F.col("job_id") % 3 != 0, F.col("payload_hash")).otherwise("")).alias("ok"))


@R.add(f"""SELECT o_orderkey AS cert_id, o_custkey % 4 AS org_id, TIMESTAMP '{_DUE}' + to_days(CAST((o_custkey % 4 + 1) * 30 AS INTEGER)) AS retain_until, CAST(60 * pow(2, o_orderkey % 5) AS BIGINT) AS next_delay_s
    FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '{_DUE}'""")
def archive_due(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    certs = orders.select(F.col("o_orderkey").alias("cert_id"), (F.col("o_custkey") % 4).alias("org_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("archived_at"), F.col("o_orderdate").alias("next_archive_at"), (F.col("o_orderkey") % 5).cast("int").alias("attempts"))
    orgs = orders.select((F.col("o_custkey") % 4).alias("org_id")).distinct().withColumn("retention_days", ((F.col("org_id") + 1) * 30).cast("int"))
    return lifecycle.archive_due(certs, orgs, F.to_timestamp(F.lit(_DUE)))


@R.add(f"""SELECT job_id, 'https://a.example/' || CAST(client_id AS VARCHAR) AS url FROM {_JOBS} j WHERE status = 'SHREDDED' AND job_id % 2 = 0
    UNION SELECT job_id, 'https://t.example/' || CAST(client_id AS VARCHAR) FROM {_JOBS} j WHERE status = 'SHREDDED' AND client_id <> 4""")
def completion_notices(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).where("status = 'SHREDDED'").select("job_id", "client_id", F.lit(1).alias("org_id"), F.lit("jira").alias("provider"), F.when(F.col("job_id") % 2 == 0, F.concat(F.lit("https://a.example/"), F.col("client_id").cast("string"))).alias("callback_url"))
    targets = jobs.select("org_id", "client_id", "provider").distinct().select("*", (F.col("client_id") != 4).alias("active"), F.concat(F.lit("https://t.example/"), F.col("client_id").cast("string")).alias("url"))
    return lifecycle.completion_notices(jobs, targets)


@R.add("""SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'UNKNOWN' WHEN user_id % 5 = 1 THEN 'NOT_APPROVED' WHEN event_id % 3 = 1 THEN 'VERSION_DIFFERS' WHEN event_id % 3 = 2 THEN 'DPO_DIFFERS' END AS code
    FROM events WHERE user_id % 5 IN (0, 1) OR event_id % 3 <> 0""")
def config_release_audit(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    beats = rows.select("event_id", (F.col("user_id") % 5).alias("config_hash"), F.when(F.col("event_id") % 3 == 1, 2).otherwise(1).alias("version"), F.when(F.col("event_id") % 3 == 2, "x").otherwise("dpo").alias("dpo"))
    releases = beats.select("config_hash").distinct().where("config_hash > 0").select("config_hash", F.when(F.col("config_hash") == 1, "DRAFT").otherwise("APPROVED").alias("status"), F.lit(1).alias("version"), F.lit("dpo").alias("dpo"))
    return lifecycle.release_audit(beats, releases).select("event_id", "code")


_BUDGET = """WITH RECURSIVE p AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
    b AS (SELECT user_id, n, ts, ts + INTERVAL 6 HOUR AS reset_at, 1 AS used FROM p WHERE n = 1
    UNION ALL SELECT p.user_id, p.n, p.ts, CASE WHEN p.ts >= b.reset_at THEN p.ts + INTERVAL 6 HOUR ELSE b.reset_at END, CASE WHEN p.ts >= b.reset_at THEN 1 ELSE b.used + 1 END FROM b JOIN p ON p.user_id = b.user_id AND p.n = b.n + 1)"""


@R.add(_BUDGET + " SELECT user_id, ts, used <= 3 AS allowed, CAST(greatest(3 - used, 0) AS INTEGER) AS remaining, reset_at FROM b")
def fixed_window_budget(spark, sf_dir):
    return lifecycle.fixed_window_budget(load(spark, sf_dir, "events").select("user_id", "ts"), "user_id", 6 * 3600, 3)


def _hooks(spark, sf_dir):
    u, t = F.col("user_id").cast("string"), F.col("event_type")
    provider = F.when(t == "view", "onetrust").when(t == "click", "jira").when(t == "purchase", "zendesk").otherwise("generic")
    ref = F.concat(F.lit("ref-"), F.floor(F.col("event_id") / 2).cast("string"))
    body = (
        F.when(t == "view", F.concat(F.lit('{"requestId":"'), ref, F.lit('","dataSubjectId":"u'), u, F.lit('","timestamp":"t"}')))
        .when(t == "click", F.concat(F.lit('{"webhookEvent":"jira:issue_created","issue":{"id":"'), ref, F.lit('","fields":{"reporter":{"accountId":"u'), u, F.lit('"}}},"timestamp":"t"}')))
        .when(t == "purchase", F.concat(F.lit('{"event_id":"'), ref, F.lit('","requester":{"id":"u'), u, F.lit('"},"created_at":"t"}')))
        .otherwise(F.concat(F.lit('{"request_id":"'), ref, F.lit('","subject":"u'), u, F.lit('"}')))
    )
    return load(spark, sf_dir, "events").select("event_id", provider.alias("provider"), body.alias("body"))


_HOOKS = "(SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'onetrust' WHEN 'click' THEN 'jira' WHEN 'purchase' THEN 'zendesk' ELSE 'generic' END AS provider, 'ref-' || CAST(event_id // 2 AS VARCHAR) AS reference, 'u' || CAST(user_id AS VARCHAR) AS subject_key FROM events)"


@R.add(f"SELECT event_id, provider, reference, subject_key, sha256(provider || chr(10) || subject_key) AS subject_hash FROM {_HOOKS} h")
def ingest_requests(spark, sf_dir):
    return ingest.parsed(_hooks(spark, sf_dir)).select("event_id", "provider", "reference", "subject_key", "subject_hash")


@R.add(f"SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'opaque-' || subject_key END AS subject_opaque_id, CASE WHEN user_id % 3 = 0 THEN 'API_SUBJECT_UNMAPPED' END AS code FROM {_HOOKS} h")
def subject_map_join(spark, sf_dir):
    rows = ingest.parsed(_hooks(spark, sf_dir))
    mapping = rows.where(F.substring("subject_key", F.lit(2), F.lit(20)).cast("long") % 3 != 0).select("provider", "subject_hash", F.concat(F.lit("opaque-"), "subject_key").alias("subject_opaque_id")).distinct()
    return ingest.mapped(rows, mapping).select("event_id", "subject_opaque_id", "code")


@R.add(f"""SELECT event_id, CASE WHEN held IS NULL THEN 'new' WHEN subject_key = held THEN 'duplicate' ELSE 'conflict' END AS outcome FROM (
    SELECT event_id, h.subject_key, coalesce(s.subject_key, CASE WHEN row_number() OVER w > 1 THEN first_value(h.subject_key) OVER w END) AS held
    FROM (SELECT * FROM {_HOOKS} a WHERE event_id % 5 <> 0) h LEFT JOIN (SELECT provider, reference, arg_min(subject_key, event_id) AS subject_key FROM {_HOOKS} b WHERE event_id % 5 = 0 GROUP BY 1, 2) s ON s.provider = h.provider AND s.reference = h.reference
    WINDOW w AS (PARTITION BY h.provider, h.reference ORDER BY event_id)) x""")
def replay_lookup_left(spark, sf_dir):
    """Every fifth event is stored from earlier."""
    rows = ingest.parsed(_hooks(spark, sf_dir))
    stored = rows.where("event_id % 5 = 0").groupBy("idempotency_key").agg(F.min_by("subject_hash", "event_id").alias("subject_hash"))
    return ingest.replay_lookup(rows.where("event_id % 5 <> 0"), stored).select("event_id", "outcome")


@R.add("""SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) <= 3600000000, false) AS replayed FROM events""")
def replay_guard(spark, sf_dir):
    return ingest.replayed(load(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 3600).select("event_id", "replayed")


@R.add("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def subject_mapping_upsert(spark, sf_dir):
    """Later events of each user against a table of the earlier ones'."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id")
    stored = rows.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return tables.upsert_latest(stored, rows.where("event_id % 2 = 1"), ["user_id"], F.col("event_id"))


@R.add("""SELECT user_id AS chain, config AS key FROM (SELECT user_id, json_extract_string(props, '$.k') AS config, min(event_id % 7) AS stored FROM events GROUP BY 1, 2) t WHERE stored <> 0""")
def config_heartbeat(spark, sf_dir):
    """One marker for each client and configuration hash that none is stored for, with
    two equal hashes."""
    beats = load(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), F.get_json_object("props", "$.k").alias("key"), "event_id")
    return tables.append_once(beats.where("event_id % 7 = 0"), beats, ["chain", "key"], [F.col("event_id")]).select("chain", "key")


#: What a worker sends of new entries (event number 2 modulo 6): copies numbered from 0 to 4.
_SENT = """(SELECT user_id AS chain, event_id + m * CAST(1000000000 AS BIGINT) AS id, m, '{"k":' || json_extract_string(props, '$.k') || '}' AS payload, CASE m WHEN 3 THEN 'n:' ELSE 'k:' END || CAST(event_id AS VARCHAR) AS key,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id + m * CAST(1000000000 AS BIGINT)) AS n FROM events, (SELECT unnest([0, 3]) AS m) c WHERE event_id % 6 = 2)"""


@R.add("WITH RECURSIVE " + _CHAIN.replace("@", " WHERE event_id % 6 NOT IN (2, 3, 4)").split("WITH RECURSIVE ")[1] + f""", heads AS (SELECT chain, arg_max(current_hash, n) AS head FROM c GROUP BY 1), s AS (SELECT * FROM {_SENT} t),
    a AS (SELECT s.chain, id, n, coalesce(head, 'GENESIS') AS previous_hash, sha256(coalesce(head, 'GENESIS') || payload || key) AS current_hash FROM s LEFT JOIN heads h ON h.chain = s.chain WHERE n = 1
        UNION ALL SELECT s.chain, s.id, s.n, a.current_hash, sha256(a.current_hash || s.payload || s.key) FROM a JOIN s ON s.chain = a.chain AND s.n = a.n + 1)
    SELECT chain, id, 'ACCEPTED' AS code, previous_hash, current_hash FROM a UNION ALL SELECT user_id, event_id, ['REPLAY', 'CONFLICT', NULL, 'BAD_HASH', 'OUT_OF_ORDER'][event_id % 6 + 1], NULL, NULL FROM events WHERE event_id % 6 NOT IN (2, 5)
    UNION ALL SELECT user_id, event_id + m * CAST(1000000000 AS BIGINT), ['REPLAY', 'CONFLICT', NULL, 'OUT_OF_ORDER'][m], NULL, NULL FROM events, (SELECT unnest([1, 2, 4]) AS m) x WHERE event_id % 6 = 2""")
def ledger_ingest(spark, sf_dir):
    """A worker's batch against the rest of the ledger, by event number modulo 6: known
    entries (0), known keys with other payloads (1), new entries (2; rebased onto the
    head of their chain), wrong hashes (3), events no job of that state allows (4). Each
    new entry is sent again (1), with another payload (2), and its job goes on: a notice
    (3), which the vault event before it allows, and a second vault event (4), which it doesn't."""
    rows = _pending(spark, sf_dir).select("chain", "created_at", "id", "payload", "key")
    stored = ledger.chain_finalize(rows.where("id % 6 not in (2, 3, 4)")).join(rows, ["chain", "id"]).withColumn("seq", F.struct("created_at", "id"))
    n = F.col("id") % 6
    copies = F.explode(F.when(n == 2, F.array(*map(F.lit, range(5)))).otherwise(F.array(F.lit(0)))).alias("m")
    sent = rows.where("id % 6 <> 5").withColumn("job_id", F.col("id").cast("string")).select("*", copies)
    m = F.col("m").cast("long")
    sent = sent.withColumn("payload", F.when((n == 1) | (m == 2), F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))).withColumn("previous_hash", F.lit("worker"))
    sent = sent.withColumn("key", F.when(m == 3, F.replace("key", F.lit("k:"), F.lit("n:"))).when(m == 4, F.replace("key", F.lit("k:"), F.lit("v:"))).otherwise(F.col("key")))
    sent = sent.withColumn("current_hash", F.when(n == 3, "bad").otherwise(ledger.link_hash(F.col("previous_hash"), F.col("payload"), F.col("key"))))
    sent = sent.withColumn("status", F.lit("EXECUTING")).withColumn("event_type", F.when(n == 4, "SHRED_SUCCESS").when(m == 3, "NOTIFICATION_SENT").otherwise("USER_VAULTED"))
    sent = sent.withColumn("id", F.col("id") + m * 1_000_000_000).drop("m")
    stored = stored.withColumn("event_type", F.lit("USER_VAULTED"))
    return ledger.take_in(sent, stored).withColumn("code", F.coalesce("code", F.lit("ACCEPTED")))


@R.add("SELECT event_id, n_name, r_name FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def dimension_joins(spark, sf_dir):
    """ledger_client_join, cert_org_join, task_job_join and release_client_join: a fact
    joined to its dimensions."""
    e, c, n, r = (load(spark, sf_dir, t) for t in ("events", "customer", "nation", "region"))
    return e.join(c, F.col("c_custkey") == F.col("user_id")).join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey")).select("event_id", "n_name", "r_name")


@R.add("SELECT event_id AS seq, user_id AS chain, c_name AS client FROM events JOIN customer ON c_custkey = user_id")
def ledger_client_join(spark, sf_dir):
    """Ledger rows with the client whose chain they are of."""
    clients = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chain"), F.col("c_name").alias("client"))
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("chain")).join(clients, "chain")


@R.add(f"SELECT job_id, method, n_name AS organisation FROM ({_CERTS}) c JOIN nation ON n_nationkey = job_id % 25")
def cert_org_join(spark, sf_dir):
    """Certificates with their organisation."""
    orgs = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("org_id"), F.col("n_name").alias("organisation"))
    return lifecycle.certificates(_finished(spark, sf_dir)).withColumn("org_id", F.col("job_id") % 25).join(orgs, "org_id").select("job_id", "method", "organisation")


@R.add(f"SELECT t.task_id, t.job_id, t.task_type, j.status AS job_status, j.subject_id FROM {_TASKS} t JOIN {_JOBS} j ON j.job_id = t.job_id")
def task_job_join(spark, sf_dir):
    """Tasks with the state and subject of their job."""
    jobs = _jobs(spark, sf_dir).select("job_id", F.col("status").alias("job_status"), "subject_id")
    return _tasks(spark, sf_dir).select("task_id", "job_id", "task_type").join(jobs, "job_id")


@R.add("SELECT o_orderkey AS release_id, c_name AS client, o_orderstatus AS status FROM orders JOIN customer ON c_custkey = o_custkey")
def release_client_join(spark, sf_dir):
    """Releases of configurations with the client that they are for."""
    releases = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("release_id"), F.col("o_custkey").alias("client_id"), F.col("o_orderstatus").alias("status"))
    clients = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"), F.col("c_name").alias("client"))
    return releases.join(clients, "client_id").select("release_id", "client", "status")


R.part("materialize_due", due_topk=["job_id", "client_id", "task_type", "due_at"], due_join=["job_id", "task_type"])


@R.add("SELECT o_custkey AS subject_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    """Ids that a purge batch holds more than once: an error of the batch."""
    return load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject_id")).agg(F.count("*").alias("n")).where("n > 1")


@R.add("SELECT user_id FROM (SELECT DISTINCT user_id FROM events) e EXCEPT SELECT o_custkey FROM orders")
def missing_set(spark, sf_dir):
    """Expected minus found, as sets."""
    return load(spark, sf_dir, "events").select("user_id").subtract(load(spark, sf_dir, "orders").select("o_custkey"))


@R.add(f"SELECT job_id, 'https://t.example/' || CAST(client_id AS VARCHAR) AS url FROM {_JOBS} j WHERE status = 'SHREDDED' AND client_id <> 4")
def completion_targets(spark, sf_dir):
    return completion_notices(spark, sf_dir).where(F.col("url").startswith("https://t."))


QUERIES, SQL = R.queries, R.sql
