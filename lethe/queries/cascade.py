"""Subjects, retention, cascades, masks, vault: over customer, orders, lineitem."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crypto import decrypt, encrypt, mask_value, pseudonym, unwrap_key, user_hash
from ..functions.text import blob_mask, object_ref_hash
from ..operators import cascade as ops
from ..operators import subjects, vault
from ..sources.tables import Versions, shared_folder, stored
from .base import HMAC_KEY, KEK, NOW, SCHEMA, TEXT_KEY, Registry, hmac_sql, load

R = Registry()
SEGMENT = ["MACHINERY", "FURNITURE"]
PLAN = [
    ops.Target("customer", None, primary_key=("c_custkey",), rules={"c_name": "HMAC"}),
    ops.Target("orders", "customer", ("o_custkey",), ("c_custkey",), ("o_orderkey",), rules={"o_orderpriority": "STATIC_MASK"}),
    ops.Target("lineitem", "orders", ("l_orderkey",), ("o_orderkey",), ("l_orderkey", "l_linenumber"), action="delete"),
]
#: The batch of most queries: customers of two segments with little on their account.
_BATCH = "c_mktsegment IN ('MACHINERY', 'FURNITURE') AND c_acctbal < 1000"
_SUBJECTS = f"SELECT c_custkey FROM customer WHERE {_BATCH}"


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: load(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")}


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").where(_BATCH).select("c_custkey")


def _now():
    return F.to_timestamp(F.lit(NOW))


@R.add("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE') ORDER BY c_custkey LIMIT 10000")
def purge_select_enum(spark, sf_dir):
    return subjects.purge_enum(load(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", SEGMENT)


@R.add("SELECT c_custkey FROM (SELECT *, c_acctbal < 0 AS overdrawn FROM customer) t WHERE overdrawn ORDER BY c_custkey LIMIT 10000")
def purge_select_boolean(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").withColumn("overdrawn", F.col("c_acctbal") < 0)
    return subjects.purge_boolean(rows, "c_custkey", "overdrawn")


@R.add("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' ORDER BY o_orderkey LIMIT 10000")
def purge_select_before(spark, sf_dir):
    return subjects.purge_before(load(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate", F.to_timestamp(F.lit("1996-01-01")))


@R.add(f"SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN ({_SUBJECTS})")
def cascade_rows(spark, sf_dir):
    hits = ops.cascade_rows(_tables(spark, sf_dir), PLAN, _subjects(spark, sf_dir), "c_custkey")
    return hits["lineitem"].select("l_orderkey", "l_linenumber")


@R.add(f"""SELECT c_custkey, CASE WHEN {_BATCH} THEN {hmac_sql("'app:customer:c_name:' || c_name", HMAC_KEY)} ELSE c_name END AS c_name,
           c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def root_redact(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return ops.redact_target(t["customer"], t["customer"].where(_BATCH), PLAN[0], SCHEMA, HMAC_KEY)


_KYC_URL = "CASE WHEN c_custkey % 2 = 0 THEN 's3://kyc-bucket/' || CAST(c_custkey AS {0}) WHEN c_custkey % 3 = 0 THEN ' ' END"


@R.add(f"""SELECT c_custkey, CASE WHEN {_BATCH} THEN {hmac_sql("'app:customer:c_name:' || c_name", HMAC_KEY)} ELSE c_name END AS c_name,
           CASE WHEN {_BATCH} AND trim(url) <> '' THEN {hmac_sql("'blob-url:app:customer:kyc_url:' || url", TEXT_KEY)} ELSE url END AS kyc_url
           FROM (SELECT *, {_KYC_URL.format('VARCHAR')} AS url FROM customer) c""")
def root_redact_blobs(spark, sf_dir):
    """The root's redaction with the URLs of its objects masked."""
    c = load(spark, sf_dir, "customer").withColumn("kyc_url", F.expr(_KYC_URL.format("STRING")))
    target = ops.Target("customer", None, primary_key=("c_custkey",), rules={"c_name": "HMAC"}, blobs=("kyc_url",))
    return ops.redact_target(c, c.where(_BATCH), target, SCHEMA, HMAC_KEY).select("c_custkey", "c_name", "kyc_url")


@R.add(f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
           CASE WHEN o_custkey IN ({_SUBJECTS}) THEN '[REDACTED]' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def redact_target(spark, sf_dir):
    return ops.erase_batch(_tables(spark, sf_dir), PLAN, _subjects(spark, sf_dir), "c_custkey", SCHEMA, HMAC_KEY)["orders"]


@R.add(f"""SELECT l.* FROM lineitem l WHERE NOT EXISTS (
           SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey IN ({_SUBJECTS}))""")
def hard_delete_target(spark, sf_dir):
    return ops.erase_batch(_tables(spark, sf_dir), PLAN, _subjects(spark, sf_dir), "c_custkey", SCHEMA, HMAC_KEY)["lineitem"]


@R.add(f"""SELECT 'customer' AS target, 'redact' AS action, count(*) AS affected_rows FROM customer WHERE {_BATCH}
    UNION ALL SELECT 'orders', 'redact', count(*) FROM orders WHERE o_custkey IN ({_SUBJECTS})
    UNION ALL SELECT 'lineitem', 'delete', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN ({_SUBJECTS})""")
def mutation_summary(spark, sf_dir):
    hits = ops.cascade_rows(_tables(spark, sf_dir), PLAN, _subjects(spark, sf_dir), "c_custkey", keep=stored)
    return ops.mutation_summary(hits, PLAN)


_COUNTS = f"""SELECT 'customer' AS target, 'redact' AS action, count(*) FILTER (WHERE {_BATCH}) AS affected_rows, count(*) AS rows_after FROM customer
    UNION ALL SELECT 'orders', 'redact', count(*) FILTER (WHERE o_custkey IN ({_SUBJECTS})), count(*) FROM orders
    UNION ALL SELECT 'lineitem', 'delete', count(*) FILTER (WHERE hit), count(*) FILTER (WHERE NOT hit) FROM (
        SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey IN ({_SUBJECTS})) AS hit FROM lineitem) l"""


def _store(spark, tables, **more):
    """A new store under the shared folder with these tables."""
    out = Versions(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    out.commit(tables, **more)
    return out


@R.add(f"SELECT c.*, CASE target WHEN 'lineitem' THEN 0 ELSE affected_rows END AS rows_masked FROM ({_COUNTS}) c")
def erase_by_file(spark, sf_dir):
    """The batch erased in a store, by file: what was counted on the way, and what the
    store then holds."""
    store = _store(spark, _tables(spark, sf_dir), cluster={"customer": ["c_custkey"], "orders": ["o_custkey"], "lineitem": ["l_orderkey"]})
    done = spark.createDataFrame([(r["target"], r["action"], r["affected_rows"]) for r in ops.erase_files(store, PLAN, _subjects(spark, sf_dir), "c_custkey", SCHEMA, HMAC_KEY)], "target string, action string, affected_rows long")
    masked = {"customer": F.length("c_name") == 64, "orders": F.col("o_orderpriority") == "[REDACTED]", "lineitem": F.lit(False)}
    left = [store.read(t).agg(F.count("*").alias("rows_after"), F.count_if(m).alias("rows_masked")).select(F.lit(t).alias("target"), "rows_after", "rows_masked") for t, m in masked.items()]
    return done.join(reduce(DataFrame.unionAll, left), "target")


@R.add(f"SELECT * FROM ({_COUNTS}) c")
def shadow_by_observation(spark, sf_dir):
    """A shadow run in one pass over each table, counted as the rows go by."""
    done = ops.shadow_counts(_tables(spark, sf_dir), PLAN, _subjects(spark, sf_dir), "c_custkey", SCHEMA, HMAC_KEY)
    return spark.createDataFrame([tuple(r.values()) for r in done], "target string, action string, affected_rows long, rows_after long")


@R.add(f"""SELECT o_orderkey FROM orders WHERE o_custkey IN ({_SUBJECTS}) AND o_orderstatus <> 'F'""")
def not_processed_anti(spark, sf_dir):
    rows = ops.cascade_rows(_tables(spark, sf_dir), PLAN[:2], _subjects(spark, sf_dir), "c_custkey")["orders"]
    done = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.lit("orders").alias("target"), F.to_json(F.array(F.col("o_orderkey").cast("string"))).alias("row_key"))
    return ops.not_processed(rows, ("o_orderkey",), done, "orders").select("o_orderkey")


@R.add(f"SELECT event_id, user_id FROM events WHERE user_id IN ({_SUBJECTS})")
def satellite_rows(spark, sf_dir):
    roots = _subjects(spark, sf_dir)
    return ops.satellite_rows(load(spark, sf_dir, "events"), "user_id", roots, "c_custkey").select("event_id", "user_id")


@R.add(f"""SELECT event_id, CASE WHEN user_id IN ({_SUBJECTS}) THEN {hmac_sql("'app:events:user_id:' || CAST(user_id AS VARCHAR)", HMAC_KEY)}
           ELSE CAST(user_id AS VARCHAR) END AS user_id, event_type FROM events""")
def satellite_redact(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ops.satellite_redact(rows, "events", "user_id", _subjects(spark, sf_dir), "c_custkey", SCHEMA, HMAC_KEY)


@R.add(f"SELECT event_id, user_id FROM events WHERE user_id IS NULL OR user_id NOT IN ({_SUBJECTS})")
def satellite_delete(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    return ops.delete_target(rows, ops.satellite_rows(rows, "user_id", _subjects(spark, sf_dir), "c_custkey"), ("event_id",)).select("event_id", "user_id")


@R.add(f"SELECT * FROM customer WHERE NOT ({_BATCH} AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey))")
def root_hard_delete(spark, sf_dir):
    """Subjects of the batch on which nothing depends are deleted outright."""
    t = _tables(spark, sf_dir)
    free = t["customer"].where(_BATCH).join(t["orders"], F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return ops.delete_target(t["customer"], free, ("c_custkey",))


@R.add(f"SELECT c_custkey, c_nationkey FROM customer WHERE {_BATCH} AND c_nationkey = 3")
def tenant_filter(spark, sf_dir):
    t = {"customer": load(spark, sf_dir, "customer").withColumn("tenant_id", F.col("c_nationkey").cast("string"))}
    return ops.cascade_rows(t, PLAN[:1], _subjects(spark, sf_dir), "c_custkey", tenant="3")["customer"].select("c_custkey", "c_nationkey")


@R.add(f"SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE {_BATCH}")
def app_table_read(spark, sf_dir):
    return load(spark, sf_dir, "customer").join(_subjects(spark, sf_dir), "c_custkey", "left_semi").select("c_custkey", "c_name", "c_mktsegment")


@R.add(f"""SELECT c_custkey, {hmac_sql("'app:customer:c_name:' || c_name", HMAC_KEY)} AS hashed, '[REDACTED]' AS masked,
           CAST(NULL AS VARCHAR) AS nulled FROM customer""")
def mask_values(spark, sf_dir):
    mask = lambda rule: mask_value(rule, F.col("c_name"), SCHEMA, "customer", "c_name", HMAC_KEY)
    return load(spark, sf_dir, "customer").select("c_custkey", mask("HMAC").alias("hashed"), mask("STATIC_MASK").alias("masked"), mask("NULLIFY").alias("nulled"))


_RULES = [subjects.Rule("RBI_KYC", 5, "orders", "o_custkey"), subjects.Rule("PMLA_FINANCIAL", 10, "large", "o_custkey"), subjects.Rule("TIE", 5, "events", "user_id")]
_RETENTION = """SELECT c_custkey, CASE WHEN big THEN 10 WHEN o OR e THEN 5 ELSE 1 END AS retention_years,
    CASE WHEN big THEN 'PMLA_FINANCIAL' WHEN o THEN 'RBI_KYC' WHEN e THEN 'TIE' ELSE 'DEFAULT' END AS rule_name
    FROM (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS o, c_custkey IN (SELECT user_id FROM events) AS e,
          c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) AS big FROM customer) t"""


def _retention(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    evidence = {"orders": orders, "large": orders.where("o_totalprice > 450000"), "events": load(spark, sf_dir, "events")}
    return subjects.retention_pick(load(spark, sf_dir, "customer"), "c_custkey", _RULES, evidence, 1)


@R.add(_RETENTION)
def retention_pick(spark, sf_dir):
    return _retention(spark, sf_dir)


@R.add(f"""SELECT c_custkey, TIMESTAMP '{NOW}' + to_years(retention_years) AS retention_expiry,
    greatest(TIMESTAMP '{NOW}', TIMESTAMP '{NOW}' + to_years(retention_years) - to_hours(48)) AS notification_due_at FROM ({_RETENTION}) r""")
def retention_window(spark, sf_dir):
    expiry, notice = subjects.retention_window(_now(), F.col("retention_years"), 48)
    return _retention(spark, sf_dir).select("c_custkey", expiry.alias("retention_expiry"), notice.alias("notification_due_at"))


@R.add("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def evidence_semi(spark, sf_dir):
    return load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def _plan_sql(rest: str, years: int) -> str:
    """A subject's action; hash, rule and times of those that go to the vault."""
    user = hmac_sql("'app:customer::' || CAST(c_custkey AS VARCHAR)", TEXT_KEY)
    action = f"""CASE WHEN u.user_id IN (SELECT user_id FROM events WHERE event_type = 'view') THEN 'already_vaulted'
    WHEN u.user_id IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'already_hard_deleted'
    WHEN u.user_id NOT IN (SELECT c_custkey FROM customer) THEN 'missing' ELSE '{rest}' END"""
    longest = f"CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) AND 8 > {years} THEN 8 ELSE {years} END"
    return f"""SELECT c_custkey, action, user_hash, CASE WHEN action = 'vault' THEN CAST(years AS INTEGER) END AS retention_years, CASE WHEN action = 'vault' THEN CASE WHEN years > {years} THEN 'TAX' ELSE 'DEFAULT' END END AS rule_name,
    CASE WHEN action = 'vault' THEN TIMESTAMP '{NOW}' + to_years(CAST(years AS INTEGER)) END AS retention_expiry, CASE WHEN action = 'vault' THEN greatest(TIMESTAMP '{NOW}', TIMESTAMP '{NOW}' + to_years(CAST(years AS INTEGER)) - INTERVAL 48 HOUR) END AS notification_due_at
    FROM (SELECT *, {user} AS user_hash, {longest} AS years FROM (SELECT u.user_id AS c_custkey, {action} AS action
    FROM (SELECT DISTINCT user_id FROM (SELECT user_id FROM events UNION ALL SELECT c_custkey * 3 FROM customer) x) u) y) z"""


def _planned(spark, sf_dir, dependents, years):
    """Users of events and a third of the customers are asked for; orders are evidence
    of a rule of eight years."""
    events, orders = load(spark, sf_dir, "events"), load(spark, sf_dir, "orders")
    asked = events.select(F.col("user_id").alias("c_custkey")).unionAll(load(spark, sf_dir, "customer").select(F.col("c_custkey") * 3)).distinct()
    of = lambda kind: events.where(F.col("event_type") == kind).select(F.col("user_id").alias("c_custkey"))
    actions = subjects.erasure_plan(asked, "c_custkey", load(spark, sf_dir, "customer"), of("view"), of("error"), dependents)
    kept = subjects.retention_pick(asked, "c_custkey", [subjects.Rule("TAX", 8, "orders", "o_custkey")], {"orders": orders}, years)
    return subjects.plan_batch(actions, "c_custkey", kept, _now(), SCHEMA, "customer", HMAC_KEY)


@R.add(_plan_sql("vault", 3))
def erasure_plan_batch(spark, sf_dir):
    return _planned(spark, sf_dir, ops.dependency_count(PLAN), 3)


@R.add(_plan_sql("hard_delete", 0))
def dry_run(spark, sf_dir):
    """The plan of a batch without dependents; nothing is written."""
    return _planned(spark, sf_dir, 0, 0)


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.000Z')"
_AT = _ISO.format(f"TIMESTAMP '{NOW}'")


@R.add(f"""SELECT 'vault:app:customer:c_custkey:' || CAST(c_custkey AS VARCHAR) AS idempotency_key, user_hash, 'USER_VAULTED' AS event_type, '{{"applied_rule_name":"' || rule_name || '","dependency_count":2,"event_timestamp":"' || {_AT} || '","notification_due_at":"' || {_ISO.format('notification_due_at')}
    || '","retention_expiry":"' || {_ISO.format('retention_expiry')} || '","retention_years":' || CAST(retention_years AS VARCHAR) || ',"root_id":"' || CAST(c_custkey AS VARCHAR) || '","root_table":"customer"}}' AS payload, TIMESTAMP '{NOW}' AS created_at
    FROM ({_plan_sql("vault", 3)}) p WHERE action = 'vault' AND c_custkey % 5 <> 0""")
def vault_events(spark, sf_dir):
    """Events of a batch; every fifth subject's is stored from an earlier run."""
    plan = erasure_plan_batch(spark, sf_dir)
    events = lambda rows, stored=None: vault.vaulted_events(rows, "c_custkey", SCHEMA, "customer", ops.dependency_count(PLAN), _now(), stored)
    return events(plan, events(plan.where("c_custkey % 5 = 0")))


_DELETED_PLAN = _plan_sql("hard_delete", 0)


@R.add(f"""SELECT 'hard-delete:app:customer:c_custkey:' || CAST(c_custkey AS VARCHAR) AS idempotency_key, user_hash, 'USER_HARD_DELETED' AS event_type,
    '{{"deleted_at":"' || {_AT} || '","dependency_count":0,"event_timestamp":"' || {_AT} || '","root_id":"' || CAST(c_custkey AS VARCHAR) || '","root_table":"customer"}}' AS payload, TIMESTAMP '{NOW}' AS created_at
    FROM ({_DELETED_PLAN}) p WHERE action = 'hard_delete'""")
def hard_delete_events(spark, sf_dir):
    return vault.hard_deleted_events(dry_run(spark, sf_dir), "c_custkey", SCHEMA, "customer", _now())


def _messages(spark, sf_dir):
    own = load(spark, sf_dir, "customer").select("c_custkey", user_hash(SCHEMA, "customer", F.col("c_custkey"), HMAC_KEY).alias("user_hash"))
    return own.withColumn("idempotency_key", F.concat(F.lit("notice:"), "user_hash"))


_USER = hmac_sql("'app:customer::' || CAST(c_custkey AS VARCHAR)", TEXT_KEY)


@R.add(f"""SELECT 'notice:app:customer:' || CAST(c_custkey AS VARCHAR) AS idempotency_key, {_USER} AS user_hash, 'NOTIFICATION_SENT' AS event_type,
    '{{"event_timestamp":"' || {_AT} || '","root_id":"' || CAST(c_custkey AS VARCHAR) || '","root_table":"customer","sent_at":"' || {_AT} || '"}}' AS payload, TIMESTAMP '{NOW}' AS created_at FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def notice_events(spark, sf_dir):
    """The mail sender confirms the messages of one segment, some of them twice."""
    m = _messages(spark, sf_dir)
    sent = m.join(load(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'"), "c_custkey", "left_semi")
    return vault.sent_notices(m, sent.unionAll(sent), SCHEMA, "customer", "c_custkey", _now())[1]


@R.add(f"SELECT 'notice:' || {_USER} AS idempotency_key, {_USER} AS user_hash, TIMESTAMP '{NOW}' AS sent_at FROM customer WHERE c_mktsegment = 'MACHINERY'")
def notice_receipts(spark, sf_dir):
    m = _messages(spark, sf_dir)
    sent = m.join(load(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'"), "c_custkey", "left_semi")
    return vault.sent_notices(m, sent, SCHEMA, "customer", "c_custkey", _now())[0]


@R.add(f"""SELECT 'customer' AS table_name, count(*) AS rows_after FROM customer
    UNION ALL SELECT 'orders', count(*) FROM orders
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey IN ({_SUBJECTS}))""")
def shadow_run(spark, sf_dir):
    """All frames of a batch evaluated, none kept."""
    after = ops.erase_batch(_tables(spark, sf_dir), PLAN, _subjects(spark, sf_dir), "c_custkey", SCHEMA, HMAC_KEY, keep=stored)
    return reduce(DataFrame.unionAll, [df.agg(F.count("*").alias("rows_after")).select(F.lit(n).alias("table_name"), "rows_after") for n, df in after.items()])


@R.add(f"""SELECT c_custkey, {hmac_sql("'app:customer::' || CAST(c_custkey AS VARCHAR)", TEXT_KEY)} AS user_hash,
    'dpdp_' || substr({hmac_sql("CAST(c_custkey AS VARCHAR) || ':' || c_name", b'salt:' + TEXT_KEY)}, 1, 24) || '@dpdp.invalid' AS pseudonym FROM customer""")
def user_hash_pseudonym(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", user_hash(SCHEMA, "customer", F.col("c_custkey"), HMAC_KEY).alias("user_hash"), pseudonym(F.col("c_custkey"), F.col("c_name"), F.lit("salt"), HMAC_KEY).alias("pseudonym"))


def _vaulted(spark, sf_dir):
    """Vault rows with times set by the customer number, without random parts."""
    c = F.col("c_custkey")
    when = lambda cond, days: F.when(cond, _now() + F.make_dt_interval(days))
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_hash"), F.lit("{}").alias("encrypted_pii"), (_now() + F.make_dt_interval(c.cast("int") % 7 - 3)).alias("notification_due_at"), (_now() + F.make_dt_interval(c.cast("int") % 11 - 4)).alias("retention_expiry"), when(c % 5 == 0, F.lit(-1)).alias("notification_sent_at"), when(c % 13 == 0, F.lit(-1)).alias("shredded_at"))


_VAULT = f"""(SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS user_hash, TIMESTAMP '{NOW}' AS now, TIMESTAMP '{NOW}' + to_days(CAST(c_custkey % 7 - 3 AS INTEGER)) AS due,
    TIMESTAMP '{NOW}' + to_days(CAST(c_custkey % 11 - 4 AS INTEGER)) AS expiry, c_custkey % 5 = 0 AS sent, c_custkey % 13 = 0 AS shredded, c_custkey % 17 <> 0 AS has_key FROM customer) v"""


@R.add(f"""SELECT user_hash, CASE WHEN shredded THEN 'shredded' WHEN sent THEN 'already_sent' WHEN now < due THEN 'not_due'
           WHEN now >= expiry THEN 'window_missed' ELSE 'send' END AS state FROM {_VAULT}""")
def notice_due(spark, sf_dir):
    return _vaulted(spark, sf_dir).select("user_hash", vault.notice_state(_now()).alias("state"))


@R.add(f"""SELECT user_hash, CASE WHEN shredded THEN 'already_shredded' WHEN expiry > now THEN 'SHREDDER_RETENTION_NOT_REACHED'
           WHEN NOT sent THEN 'SHREDDER_NOTICE_MISSING' WHEN NOT has_key THEN 'SHREDDER_KEY_MISSING' ELSE 'shred' END AS outcome FROM {_VAULT}""")
def shred_subjects(spark, sf_dir):
    v = _vaulted(spark, sf_dir)
    return vault.shred(v, v.where(F.col("user_hash").cast("long") % 17 != 0).select("user_hash"), _now())[2]


_SHREDS = "NOT shredded AND expiry <= now AND sent AND has_key"


@R.add(f"""SELECT user_hash, CASE WHEN shredded THEN 'already_shredded' WHEN expiry > now THEN 'SHREDDER_RETENTION_NOT_REACHED'
           WHEN NOT sent THEN 'SHREDDER_NOTICE_MISSING' WHEN NOT has_key THEN 'SHREDDER_KEY_MISSING' ELSE 'shred' END AS outcome,
           has_key AND NOT ({_SHREDS}) AS has_key, CASE WHEN {_SHREDS} THEN '{vault.DESTROYED}' ELSE '{{}}' END AS encrypted_pii FROM {_VAULT}""")
def shred_by_file(spark, sf_dir):
    """What is due shredded in a store: each row's outcome, what is left of its key and its ciphertext."""
    v = _vaulted(spark, sf_dir)
    store = _store(spark, {"vault": v, "keys": v.where(F.col("user_hash").cast("long") % 17 != 0).select("user_hash", F.lit("k").alias("wrapped_dek"))}, cluster={"vault": ["user_hash"], "keys": ["user_hash"]})
    outcome = vault.shred_files(store, _now())
    left = store.read("keys").select("user_hash", F.lit(True).alias("_key"))
    return outcome.join(store.read("vault").select("user_hash", "encrypted_pii"), "user_hash").join(left, "user_hash", "left").select("user_hash", "outcome", F.col("_key").isNotNull().alias("has_key"), "encrypted_pii")


@R.add(f"""SELECT 'shred:app:customer:' || user_hash AS idempotency_key, user_hash, 'SHRED_SUCCESS' AS event_type, '{{"event_timestamp":"' || {_AT} || '","root_id":"' || user_hash || '","root_schema":"app","root_table":"customer","shredded_at":"' || {_AT}
    || '","subject_opaque_id":"' || user_hash || '"}}' AS payload, TIMESTAMP '{NOW}' AS created_at FROM {_VAULT} WHERE {_SHREDS} AND c_custkey % 4 <> 0""")
def shred_events(spark, sf_dir):
    """Events of what was shredded; every fourth subject's is stored from an earlier run."""
    v = _vaulted(spark, sf_dir)
    outcome = vault.shred(v, v.where(F.col("user_hash").cast("long") % 17 != 0).select("user_hash"), _now())[2]
    done = outcome.where("outcome = 'shred'").withColumn("c_custkey", F.col("user_hash"))
    events = lambda rows, stored=None: vault.shredded_events(rows, "c_custkey", SCHEMA, "customer", _now(), stored)
    return events(done, events(done.where("c_custkey % 4 = 0")))


@R.add(f"""SELECT user_hash, CASE WHEN shredded THEN 'shredded' WHEN expiry <= now THEN 'expired' WHEN sent THEN 'notified'
           WHEN due <= now THEN 'notice_due' ELSE 'vaulted' END AS phase FROM {_VAULT}""")
def vault_state_view(spark, sf_dir):
    return _vaulted(spark, sf_dir).select("user_hash", vault.phase(_now()).alias("phase"))


@R.add("SELECT c_custkey, c_name AS opened, true AS sizes_fit, true AS wrong_key_fails FROM customer")
def aes_gcm_round_trip(spark, sf_dir):
    sealed = load(spark, sf_dir, "customer").select("c_custkey", "c_name", encrypt(F.col("c_name"), F.lit(KEK)).alias("s"))
    return sealed.select("c_custkey", decrypt(F.col("s"), F.lit(KEK)).alias("opened"), (F.octet_length("s") == F.octet_length("c_name") + 28).alias("sizes_fit"), decrypt(F.col("s"), F.lit(HMAC_KEY)).isNull().alias("wrong_key_fails"))


def _stored_keys(spark, sf_dir):
    """Random keys are written to the shared folder and read back before use. The file
    holds wrapped keys alone; deleting it is the caller's."""
    return stored(vault.draw_keys(load(spark, sf_dir, "customer").where(_BATCH), "c_custkey", SCHEMA, "customer", HMAC_KEY, KEK), "keys")


@R.add(f"SELECT {_USER} AS user_hash, true AS fresh, true AS unwraps, true AS wrong_key_fails FROM customer WHERE {_BATCH}")
def wrap_unwrap_dek(spark, sf_dir):
    """Random keys of 32 bytes and salts of 16, each its own, wrapped and unwrapped."""
    keys = _stored_keys(spark, sf_dir)
    counts = keys.agg(F.count_distinct("wrapped_dek").alias("deks"), F.count_distinct("salt").alias("salts"), F.count("*").alias("n")).withColumn("one", F.lit(1))
    rows = keys.withColumn("one", F.lit(1)).join(counts, "one")
    return rows.select("user_hash", ((F.col("deks") == F.col("n")) & (F.col("salts") == F.col("n")) & (F.length("salt") == 32)).alias("fresh"), (F.octet_length(unwrap_key(F.col("wrapped_dek"), KEK)) == 32).alias("unwraps"), unwrap_key(F.col("wrapped_dek"), HMAC_KEY).isNull().alias("wrong_key_fails"))


_PERSONAL = ["c_name", "c_mktsegment"]


@R.add(f"""SELECT {hmac_sql("'app:customer::' || CAST(c_custkey AS VARCHAR)", TEXT_KEY)} AS user_hash,
    '{{"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}}' AS payload FROM customer WHERE {_BATCH}""")
def vault_subjects(spark, sf_dir):
    """The batch is vaulted under fresh keys and opened again."""
    keys = _stored_keys(spark, sf_dir)
    rows = vault.vault_rows(load(spark, sf_dir, "customer"), keys, "c_custkey", _PERSONAL, HMAC_KEY, KEK, _now(), F.lit(5))
    return vault.open_vault(rows, keys, KEK)


@R.add(f"""SELECT {hmac_sql("'app:customer::' || CAST(c_custkey AS VARCHAR)", TEXT_KEY)} AS user_hash, c_mktsegment AS email, c_name AS name,
    'notice:' || {hmac_sql("'app:customer::' || CAST(c_custkey AS VARCHAR)", TEXT_KEY)} AS idempotency_key FROM customer WHERE {_BATCH}""")
def notice_payload(spark, sf_dir):
    return vault.notice_payload(vault_subjects(spark, sf_dir), "$.c_mktsegment", "$.c_name")


def _objects(spark, sf_dir):
    """Objects of customers: two neighbours in number share each third object."""
    c = F.col("c_custkey")
    held = F.when(c % 3 == 0, c).when(c % 3 == 1, c - 1).otherwise(c)
    return load(spark, sf_dir, "customer").select(c.cast("string").alias("user_hash"), F.lit("s3").alias("provider"), F.concat(F.lit("b"), F.col("c_nationkey").cast("string")).alias("bucket_of"), F.concat(F.lit("kyc/"), held.cast("string")).alias("key"), F.when(c % 4 == 3, "destroyed").when(c % 4 == 2, "retained").otherwise("pending").alias("state"), F.when(c % 5 == 0, "legal_hold_only").when(c % 5 == 1, "hard_delete").otherwise("version_purge").alias("action"), F.lit("v1").alias("version_id"), F.lit("v9").alias("overwrite_version")).withColumn("bucket", F.lit("kyc")).drop("bucket_of")


_OBJECTS = """(SELECT CAST(c_custkey AS VARCHAR) AS user_hash, 's3' AS provider, 'kyc' AS bucket,
    'kyc/' || CAST(CASE WHEN c_custkey % 3 = 1 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR) AS key,
    CASE WHEN c_custkey % 4 = 3 THEN 'destroyed' WHEN c_custkey % 4 = 2 THEN 'retained' ELSE 'pending' END AS state,
    CASE WHEN c_custkey % 5 = 0 THEN 'legal_hold_only' WHEN c_custkey % 5 = 1 THEN 'hard_delete' ELSE 'version_purge' END AS action FROM customer)"""
_SHARED = f"""SELECT a.user_hash, a.provider, a.bucket, a.key, count(DISTINCT b.user_hash) AS holders FROM {_OBJECTS} a JOIN {_OBJECTS} b
    ON a.bucket = b.bucket AND a.key = b.key AND a.user_hash <> b.user_hash AND b.state IN ('pending', 'retained')
    WHERE a.state IN ('pending', 'retained') GROUP BY ALL"""


@R.add(_SHARED)
def shared_object_refs(spark, sf_dir):
    return ops.shared_object_refs(_objects(spark, sf_dir))


@R.add(f"""SELECT o.user_hash, {hmac_sql("'s3-object-ref:kyc' || chr(10) || o.key || chr(10) || 'v1'", TEXT_KEY)} AS ref_hash,
    CASE WHEN o.action = 'legal_hold_only' THEN 'retained' WHEN s.key IS NOT NULL THEN 'refused_shared' ELSE 'delete' END AS outcome,
    CASE WHEN o.action = 'legal_hold_only' OR s.key IS NOT NULL THEN 0 WHEN o.action = 'hard_delete' THEN 1 ELSE 2 END AS versions
    FROM {_OBJECTS} o LEFT JOIN ({_SHARED}) s ON s.user_hash = o.user_hash AND s.key = o.key""")
def blob_shred_plan(spark, sf_dir):
    objects = _objects(spark, sf_dir)
    versions = objects.select("bucket", "key").distinct().select("bucket", "key", F.explode(F.array(F.lit("v1"), F.lit("v2"), F.lit("v9"))).alias("version_id"))
    return ops.blob_shred_plan(objects, versions, HMAC_KEY)


@R.add(f"SELECT user_hash, count(*) AS n FROM {_OBJECTS} WHERE state = 'pending' GROUP BY 1")
def pending_blob_count(spark, sf_dir):
    from ..operators.report import pending_blob_count as count

    return count(_objects(spark, sf_dir))


_URL = "'s3://kyc/kyc/' || CAST(c_custkey AS VARCHAR) || '.pdf?versionId=v1'"


def _with_url(spark, sf_dir):
    return load(spark, sf_dir, "customer").withColumn("url", F.concat(F.lit(" s3://kyc/kyc/"), F.col("c_custkey").cast("string"), F.lit(".pdf?versionId=v1 ")))


@R.add(f"SELECT 'customer' AS table_name, 'url' AS column_name, {_URL} AS url FROM customer WHERE {_BATCH}")
def blob_candidates(spark, sf_dir):
    rows = _with_url(spark, sf_dir).where(_BATCH)
    return ops.blob_candidates({"customer": rows}, {"customer": ["url"]}, {"customer": rows})


@R.add(f"""SELECT c_custkey, {hmac_sql("'blob-url:app:customer:url:' || " + _URL, HMAC_KEY)} AS masked,
    {hmac_sql("'s3-object-ref:kyc' || chr(10) || 'k' || CAST(c_custkey AS VARCHAR) || chr(10) || 'v1'", TEXT_KEY)} AS ref_hash FROM customer""")
def blob_mask_refs(spark, sf_dir):
    rows = _with_url(spark, sf_dir)
    return rows.select("c_custkey", blob_mask(F.trim("url"), SCHEMA, "customer", "url", HMAC_KEY).alias("masked"), object_ref_hash(F.lit("kyc"), F.concat(F.lit("k"), F.col("c_custkey").cast("string")), F.lit("v1"), HMAC_KEY).alias("ref_hash"))


@R.add(f"""SELECT 'customer' AS table_name, count(*) FILTER (after LIKE 'Customer#%') AS leaks FROM (SELECT CASE WHEN {_BATCH} THEN {hmac_sql("'app:customer:c_name:' || c_name", HMAC_KEY)} ELSE c_name END AS after FROM customer WHERE {_BATCH}) c
    UNION ALL SELECT 'orders', count(*) FILTER (after <> '[REDACTED]') FROM (SELECT CASE WHEN o_custkey IN ({_SUBJECTS}) THEN '[REDACTED]' ELSE o_orderpriority END AS after FROM orders WHERE o_custkey IN ({_SUBJECTS})) o
    UNION ALL SELECT 'customer before', count(*) FILTER (c_name LIKE 'Customer#%') FROM customer WHERE {_BATCH}""")
def leak_invariants(spark, sf_dir):
    """After a batch no row of its subjects may hold a raw value; before it, all do."""
    from ..operators.discovery import leak_invariants as leaks

    t = _tables(spark, sf_dir)
    after = ops.erase_batch(t, PLAN, _subjects(spark, sf_dir), "c_custkey", SCHEMA, HMAC_KEY, keep=stored)
    batch = _subjects(spark, sf_dir)
    own = after["customer"].join(batch, "c_custkey", "left_semi")
    orders = after["orders"].join(batch, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    before = t["customer"].join(batch, "c_custkey", "left_semi")
    raw = F.col("c_name").startswith("Customer#")
    return leaks({"customer": (own, raw), "customer before": (before, raw), "orders": (orders, F.col("o_orderpriority") != "[REDACTED]")})


R.part("mask_values", mask_value=["c_custkey", "hashed", "masked", "nulled"])
R.part("user_hash_pseudonym", user_hash=["c_custkey", "user_hash"], pseudonym=["c_custkey", "pseudonym"])
R.part("blob_mask_refs", blob_mask=["c_custkey", "masked"])
QUERIES, SQL = R.queries, R.sql
