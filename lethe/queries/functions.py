"""Scalar functions over whole tables: hashes, URLs, subjects, intervals, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crypto, text
from .base import HMAC_KEY, Registry, hmac_sql, load

R = Registry()
_DNS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@R.add(f"SELECT event_id, sha256(props) AS sha, {hmac_sql('props', HMAC_KEY)} AS mac FROM events")
def sha256_hmac_hex(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", crypto.sha256_hex("props").alias("sha"), crypto.hmac_sha256_hex(F.col("props"), HMAC_KEY).alias("mac"))


@R.add(f"SELECT c_custkey, {hmac_sql('c_name', b'row key')} AS mac FROM customer")
def hmac_row_key(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").withColumn("k", F.concat(F.lit("row"), F.lit(" key")))
    return rows.select("c_custkey", crypto.hmac_row_sha256_hex(F.col("c_name"), F.col("k")).alias("mac"))


@R.add("SELECT event_id, event_id % 4 <> 3 AS valid FROM events")
def hmac_verify(spark, sf_dir):
    mac = crypto.hmac_sha256_hex(F.col("props"), HMAC_KEY)
    n = F.col("event_id") % 4
    given = F.when(n == 0, mac).when(n == 1, F.concat(F.lit("sha256="), mac)).when(n == 2, F.base64(F.unhex(mac))).otherwise(F.sha2(F.col("props"), 256))
    return load(spark, sf_dir, "events").select("event_id", crypto.hmac_verify(F.col("props"), given, HMAC_KEY).alias("valid"))


@R.add("""SELECT event_id, '{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS canonical FROM events""")
def canonical_json(spark, sf_dir):
    doc = F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(', "event_type" : "'), F.col("event_type"), F.lit('"}'))
    return load(spark, sf_dir, "events").select("event_id", crypto.canonical_json(doc).alias("canonical"))


@R.add("""SELECT event_id, '{"9":2,"10":1,"a":2,"a_b":' || CAST(event_id * 100 AS VARCHAR) || ',"B":[1000,0.5],"z":' || CAST(event_id AS VARCHAR) || '.5}' AS canonical FROM events""")
def canonical_json_js(spark, sf_dir):
    """Numbers in several spellings, a repeated key, keys that are indexes, capitals."""
    n = F.col("event_id").cast("string")
    doc = F.concat(F.lit('{"z": '), n, F.lit('.50, "10": 1, "9": 2.0, "a_b": '), n, F.lit('e2, "B": [1e3, 5E-1], "a": 1, "a": 2}'))
    return load(spark, sf_dir, "events").select("event_id", crypto.canonical_json_js(doc).alias("canonical"))


def _uuid_sql(digest: str) -> str:
    nibble = f"substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr({digest}, 17, 1)), 1)"
    return f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || {nibble} || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12)"


@R.add(f"SELECT c_custkey, {_uuid_sql('s')} AS v5, {_uuid_sql('h')} AS det FROM (SELECT c_custkey, sha1(from_hex('{_DNS.replace('-', '')}') || encode(c_name)) AS s, sha256(c_name) AS h FROM customer) t")
def uuids(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", crypto.uuid_v5(F.col("c_name"), _DNS).alias("v5"), crypto.deterministic_uuid(F.col("c_name")).alias("det"))


@R.add("""SELECT page_id, CASE WHEN starts_with(url, 'https') THEN NULL ELSE 'API_WEBHOOK_URL_PROTOCOL_INVALID' END AS plain,
    CASE page_id % 6 WHEN 0 THEN 'API_WEBHOOK_URL_HOST_FORBIDDEN' WHEN 1 THEN NULL WHEN 2 THEN 'API_WEBHOOK_URL_CREDENTIALS_FORBIDDEN' WHEN 3 THEN 'API_WEBHOOK_URL_INVALID' WHEN 4 THEN 'API_WEBHOOK_URL_HOST_FORBIDDEN' ELSE 'API_WEBHOOK_URL_HOST_FORBIDDEN' END AS made FROM pages""")
def egress_url_check(spark, sf_dir):
    path = F.concat(F.lit("/p/"), F.col("page_id").cast("string"))
    n = F.col("page_id") % 6
    host = F.when(n == 0, "https://10.1.2.3").when(n == 1, "https://8.8.8.8:8443").when(n == 2, "https://u:p@example.com").when(n == 3, "no url").when(n == 4, "https://[fe80::1]").otherwise("https://a.localhost")
    return load(spark, sf_dir, "pages").select("page_id", text.egress_violation(F.col("url")).alias("plain"), text.egress_violation(F.concat(host, path)).alias("made"))


@R.add("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE 'b' || CAST(o_custkey AS VARCHAR) END AS bucket, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE 'kyc/a b ' || CAST(o_orderkey AS VARCHAR) END AS key,
    CASE o_orderkey % 4 WHEN 0 THEN 'v1' END AS version_id FROM orders""")
def parse_s3_url(spark, sf_dir):
    b, k = F.concat(F.lit("b"), F.col("o_custkey").cast("string")), F.concat(F.lit("kyc/a%20b%20"), F.col("o_orderkey").cast("string"))
    n = F.col("o_orderkey") % 4
    url = F.when(n == 0, F.concat(F.lit("s3://"), b, F.lit("/"), k, F.lit("?versionId=v1"))).when(n == 1, F.concat(F.lit("https://"), b, F.lit(".s3.eu-west-1.amazonaws.com/"), k)).when(n == 2, F.concat(F.lit("https://s3.amazonaws.com/"), b, F.lit("/"), k)).otherwise(F.concat(F.lit("https://example.com/"), k))
    return load(spark, sf_dir, "orders").withColumn("u", text.parse_s3_url(url)).select("o_orderkey", "u.bucket", "u.key", "u.version_id")


@R.add("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'email_sha256:' || sha256('user' || CAST(user_id AS VARCHAR) || '@example.com')
    WHEN 1 THEN 'phone_sha256:' || sha256('+9198765' || lpad(CAST(user_id AS VARCHAR), 5, '0')) WHEN 2 THEN 'usr_' || CAST(user_id AS VARCHAR)
    WHEN 3 THEN 'email_sha256:' || sha256(CAST(user_id AS VARCHAR)) ELSE 'phone_sha256:' || sha256('98765' || lpad(CAST(user_id AS VARCHAR), 5, '0')) END AS subject_key,
    CASE event_id % 5 WHEN 2 THEN 'opaque' WHEN 1 THEN 'phone_sha256' WHEN 4 THEN 'phone_sha256' ELSE 'email_sha256' END AS kind, event_id % 5 IN (2, 3) AS opaque FROM events""")
def normalize_subject(spark, sf_dir):
    u, n = F.col("user_id").cast("string"), F.col("event_id") % 5
    five = F.lpad(u, 5, "0")
    raw = F.when(n == 0, F.concat(F.lit(" User"), u, F.lit("@Example.com "))).when(n == 1, F.concat(F.lit("0091 98765-"), five)).when(n == 2, F.concat(F.lit("usr_"), u)).when(n == 3, F.concat(F.lit("EMAIL_sha256:"), F.upper(F.sha2(u, 256)))).otherwise(F.concat(F.lit("(98765) "), five))
    key = text.normalize_subject(raw)
    return load(spark, sf_dir, "events").select("event_id", key.alias("subject_key"), text.subject_kind(key).alias("kind"), text.opaque_id(raw).alias("opaque"))


@R.add("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, json_extract_string(props, '$.k')) AS first FROM events")
def coalesce_fields(spark, sf_dir):
    doc = F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(', "blank": "  ", "in": {"t": "'), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(" "), F.lit('"}}'))
    return load(spark, sf_dir, "events").select("event_id", text.coalesce_fields(doc, ["$.none", "$.blank", "$.in.t", "$.k"]).alias("first"))


@R.add("""SELECT event_id, CAST(least(1000.0 * pow(2, event_id % 12), 300000) AS BIGINT) AS task_ms, CAST(least(60 * pow(2, event_id % 12 + 1), 21600) AS BIGINT) AS certificate_s,
    CASE WHEN event_id % 12 + 1 < 10 THEN CAST(60 * pow(2, event_id % 12 + 1) AS BIGINT) END AS webhook_s FROM events""")
def retry_delay(spark, sf_dir):
    n = F.col("event_id") % 12 + 1
    return load(spark, sf_dir, "events").select("event_id", text.retry_delay_ms(n).alias("task_ms"), text.certificate_delay_s(n).alias("certificate_s"), text.webhook_delay_s(n).alias("webhook_s"))


@R.add("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') || '000Z' AS iso, o_orderdate + to_years(5) AS five_years, o_orderdate + to_days(30) AS due_at FROM orders""")
def dates_iso_due(spark, sf_dir):
    d = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select("o_orderkey", text.iso_timestamp(d).alias("iso"), text.after(d, years=5).alias("five_years"), text.after(d, days=30).alias("due_at"))


@R.add("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '[REDACTED]|[REDACTED]' ELSE event_type || '|' || repeat('x', 125) || '...' END AS params FROM events""")
def redact_query_log(spark, sf_dir):
    sql = F.when(F.col("event_id") % 2 == 0, "UPDATE t SET Email = $1").otherwise("SELECT emails FROM t")
    out = text.redact_query_params(sql, F.array("event_type", F.repeat(F.lit("x"), 200)), ["email", "full_name"])
    return load(spark, sf_dir, "events").select("event_id", F.array_join(out, "|").alias("params"))


@R.add("""SELECT event_id, '{"k": "[REDACTED]", "user": {"token": "[REDACTED]", "id": ' || CAST(user_id AS VARCHAR) || '}}' AS line FROM events""")
def redact_log_paths(spark, sf_dir):
    line = F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(', "user": {"token": "'), F.col("event_type"), F.lit('", "id": '), F.col("user_id").cast("string"), F.lit("}}"))
    return load(spark, sf_dir, "events").select("event_id", text.redact_paths(line, ["k", "*.token"]).alias("line"))


@R.add("SELECT c_custkey, CASE WHEN c_acctbal < 1000 THEN NULL ELSE '[REDACTED]' END AS secret FROM customer")
def redact_secret_column(spark, sf_dir):
    secret = F.when(F.col("c_acctbal") >= 1000, F.col("c_name"))
    return load(spark, sf_dir, "customer").select("c_custkey", F.when(secret.isNotNull(), "[REDACTED]").alias("secret"))


@R.add("""SELECT event_id, '{"event_id":' || CAST(event_id AS VARCHAR) || CASE WHEN event_type = 'click' THEN '' ELSE ',"event_type":"' || event_type || '"' END || '}' AS payload FROM events""")
def strip_null_payload(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("event_type"))).alias("payload"))


@R.add(f"""SELECT event_id, event_id % 3 = 0 AS too_large, event_id % 4 <> 1 AND event_id % 4 <> 3 AS schedule_ok,
    CASE WHEN user_id % 7 <> event_id % 7 THEN 'USER_MISMATCH' WHEN event_type = 'error' THEN 'TYPE_MISMATCH' END AS envelope FROM events""")
def guards(spark, sf_dir):
    """payload_size_guard, schedule_guard and envelope_guard."""
    from ..operators.lifecycle import envelope_code, payload_too_large, schedule_ok

    n = F.col("event_id") % 4
    notice = F.when(n == 1, "no time").when(n == 3, "2030-01-02T00:00:00.000Z").otherwise("2026-01-01T00:00:00.000Z")
    large = F.concat(F.lit('{"a" : "'), F.repeat(F.lit("x"), F.when(F.col("event_id") % 3 == 0, 100).otherwise(10)), F.lit('"}'))
    code = envelope_code([(F.col("user_id") % 7, F.col("event_id") % 7, "USER_MISMATCH"), (F.col("event_type") == "error", F.lit(False), "TYPE_MISMATCH")])
    return load(spark, sf_dir, "events").select("event_id", payload_too_large(large, 50).alias("too_large"), schedule_ok(notice, F.lit("2030-01-01T00:00:00.000Z")).alias("schedule_ok"), code.alias("envelope"))


@R.add(f"""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'API_SIGNATURE_STALE' WHEN event_id % 5 IN (2, 3) THEN 'API_SIGNATURE_INVALID' END AS code FROM events""")
def signature_filter(spark, sf_dir):
    from ..operators.ingest import signature_code

    n, ts = F.col("event_id") % 5, F.col("ts")
    key = F.when(n == 1, "old").when(n == 2, "other").when(n == 3, "old").otherwise("new")
    rotated = F.when(n == 3, ts - F.make_dt_interval(F.lit(2))).otherwise(ts - F.make_dt_interval(F.lit(0), F.lit(1)))
    rows = load(spark, sf_dir, "events").withColumn("sig", crypto.hmac_row_sha256_hex(F.col("props"), key)).withColumn("sent", F.when(n == 4, ts - F.make_dt_interval(F.lit(0), F.lit(1))).otherwise(ts)).withColumn("rotated", rotated)
    return rows.select("event_id", signature_code(F.col("props"), F.col("sig"), F.col("sent"), ts, F.lit("new"), F.lit("old"), F.col("rotated")).alias("code"))


@R.add("SELECT event_id, event_id % 48 <= 24 AS in_grace FROM events")
def secret_grace(spark, sf_dir):
    """Secrets rotated up to two days before each event."""
    from ..operators.ingest import in_grace

    rotated = F.col("ts") - F.make_dt_interval(F.lit(0), (F.col("event_id") % 48).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", in_grace(F.col("ts"), rotated).alias("in_grace"))


@R.add("SELECT event_id, event_type || ' ' || event_type AS trimmed FROM events")
def text_trim(spark, sf_dir):
    from ..functions.classify import text_trim as trim

    padded = F.concat(F.lit("\u00a0\u2003\n "), "event_type", F.lit(" "), "event_type", F.lit("\t\u3000\u2028"))
    return load(spark, sf_dir, "events").select("event_id", trim(padded).alias("trimmed"))


@R.add("SELECT event_id, printf('%.3f', floor(event_id % 33 / 16.0 * 1000 + 0.5) / 1000) AS score FROM events")
def number_format(spark, sf_dir):
    """Sixteenths, half of which lie between two texts."""
    return load(spark, sf_dir, "events").select("event_id", text.score_text(F.col("event_id") % 33 / 16).alias("score"))


@R.add("""SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), '>' ORDER BY l_suppkey, l_linenumber) AS path, count(*) FILTER (l_linenumber = 2) > 0 AS visited,
    CASE WHEN count(*) FILTER (l_linenumber = 2) = 0 THEN string_agg(CAST(l_linenumber AS VARCHAR), '>' ORDER BY l_suppkey, l_linenumber) || '>2' END AS longer FROM lineitem GROUP BY 1""")
def array_ops(spark, sf_dir):
    """Ordered aggregation (an order has few lines), membership, and paths that never
    visit twice."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_suppkey", "l_linenumber"))).alias("l"))
    lines = lines.select("l_orderkey", F.transform("l", lambda x: x["l_linenumber"].cast("string")).alias("path"))
    return lines.select("l_orderkey", F.array_join("path", ">").alias("path"), F.array_contains("path", "2").alias("visited"), F.array_join(text.path_with(F.col("path"), F.lit("2")), ">").alias("longer"))


@R.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'o_clerk,o_comment' ELSE 'o_clerk' END AS changed, CASE WHEN o_orderkey % 2 = 0 THEN 'o_custkey' ELSE 'o_comment,o_custkey' END AS blanked FROM orders""")
def map_ops(spark, sf_dir):
    rules = F.create_map(F.lit("o_custkey"), F.lit("NULLIFY"), F.lit("o_comment"), F.when(F.col("o_orderkey") % 2 == 0, "STATIC_MASK").otherwise("NULLIFY"), F.lit("o_clerk"), F.lit("HMAC"))
    changed, blanked = text.rule_columns(rules)
    return load(spark, sf_dir, "orders").select("o_orderkey", F.array_join(changed, ",").alias("changed"), F.array_join(blanked, ",").alias("blanked"))


@R.add("SELECT event_id, 3 AS objects, CAST(user_id + 3 AS BIGINT) AS versions, 's3' AS provider FROM events")
def blob_receipt_summary(spark, sf_dir):
    from ..operators.report import receipt_summary

    one = lambda n: F.struct(F.lit("s3").alias("provider"), n.cast("long").alias("versions"))
    return receipt_summary(load(spark, sf_dir, "events").withColumn("receipts", F.array(one(F.col("user_id")), one(F.lit(1)), one(F.lit(2)))))


R.part("sha256_hmac_hex", sha256_hex=["event_id", "sha"], hmac_sha256_hex=["event_id", "mac"])
R.part("uuids", uuid_v5=["c_custkey", "v5"], deterministic_uuid=["c_custkey", "det"])
R.part("normalize_subject", opaque_id_check=["event_id", "opaque"])
R.part("guards", payload_size_guard=["event_id", "too_large"], schedule_guard=["event_id", "schedule_ok"], envelope_guard=["event_id", "envelope"])
R.part("dates_iso_due", iso_timestamp=["o_orderkey", "iso"], due_at=["o_orderkey", "due_at"])
QUERIES, SQL = R.queries, R.sql
