"""Requests from other systems: normalise, check, map and deduplicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crypto import hmac_row_sha256_hex, sha256_hex, uuid_v5
from ..functions.text import coalesce_fields, normalize_subject

#: JSON paths of the request, the subject and the time, by provider.
PROVIDERS = {
    "onetrust": (["$.requestId", "$.id"], ["$.dataSubjectId", "$.subject.id", "$.email"], ["$.timestamp", "$.createdAt"]),
    "jira": (["$.issue.id", "$.issue.key", "$.webhookEvent"], ["$.issue.fields.reporter.accountId"], ["$.timestamp"]),
    "zendesk": (["$.event_id", "$.ticket.id"], ["$.requester.id", "$.requester.email"], ["$.created_at"]),
    "generic": (["$.request_id", "$.k"], ["$.subject", "$.k"], ["$.timestamp"]),
}
#: Name space of idempotency keys.
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def parsed(events: DataFrame) -> DataFrame:
    """provider, reference, subject key, its hash and the idempotency key of webhook
    events (provider, body, ...)."""

    def field(k: int) -> Column:
        return F.coalesce(*[F.when(F.col("provider") == p, coalesce_fields(F.col("body"), paths[k])) for p, paths in PROVIDERS.items()])

    subject = normalize_subject(field(1))
    out = events.withColumn("reference", field(0)).withColumn("subject_key", subject).withColumn("requested_at", field(2))
    out = out.withColumn("subject_hash", sha256_hex(F.concat(F.col("provider"), F.lit("\n"), F.col("subject_key"))))
    return out.withColumn("idempotency_key", uuid_v5(F.concat_ws(":", "provider", "reference"), NAMESPACE))


def mapped(requests: DataFrame, mapping: DataFrame) -> DataFrame:
    """Requests with the opaque subject of their hash; unmatched ones carry a code."""
    out = requests.join(mapping, ["provider", "subject_hash"], "left")
    return out.withColumn("code", F.when(F.col("subject_opaque_id").isNull(), "API_SUBJECT_UNMAPPED"))


def replay_lookup(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Each request against what is stored under its key: new, duplicate, or conflict
    (same reference, other subject)."""
    old = stored.select("idempotency_key", F.col("subject_hash").alias("_old"))
    first = F.first("subject_hash").over(Window.partitionBy("idempotency_key").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    n = F.row_number().over(Window.partitionBy("idempotency_key").orderBy("event_id"))
    out = requests.withColumn("_first", first).withColumn("_n", n).join(old, "idempotency_key", "left")
    held = F.coalesce(F.col("_old"), F.when(F.col("_n") > 1, F.col("_first")))
    return out.withColumn("outcome", F.when(held.isNull(), "new").when(held.eqNullSafe(F.col("subject_hash")), "duplicate").otherwise("conflict")).drop("_first", "_n", "_old")


def in_grace(received_at: Column, rotated_at: Column, grace_h: int = 24) -> Column:
    """Whether the secret before a rotation still holds."""
    return F.coalesce(received_at <= rotated_at + F.make_dt_interval(F.lit(0), F.lit(grace_h)), F.lit(False))


def signature_code(body: Column, signature: Column, sent_at: Column, received_at: Column, secret: Column, previous: Column, rotated_at: Column, skew_s: int = 300, grace_h: int = 24) -> Column:
    """Null for a fresh request signed with the secret, or with the previous one while
    its grace lasts."""
    stale = F.abs(F.unix_timestamp(received_at) - F.unix_timestamp(sent_at)) > skew_s
    given = F.lower(F.regexp_replace(signature, "^sha256=", ""))
    now = given == hmac_row_sha256_hex(body, secret)
    old = F.coalesce(in_grace(received_at, rotated_at, grace_h) & (given == hmac_row_sha256_hex(body, previous)), F.lit(False))
    return F.when(stale, "API_SIGNATURE_STALE").when(~(now | old), "API_SIGNATURE_INVALID")


def replayed(requests: DataFrame, key: list[str], at: str, window_s: int) -> DataFrame:
    """Requests with whether the same key was seen within a window before."""
    before = F.lag(at).over(Window.partitionBy(*key).orderBy(at, "event_id"))
    return requests.withColumn("replayed", F.coalesce(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp")) <= window_s * 1_000_000, F.lit(False)))
