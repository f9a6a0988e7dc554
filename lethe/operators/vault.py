"""Vault, notice and destruction of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import canonical_json, decrypt, encrypt, pseudonym, random_bytes, unwrap_key, user_hash, wrap_key
from ..functions.text import iso_timestamp
from ..sources.tables import Change, stored
from .subjects import retention_window

#: What stands in place of a ciphertext whose key is destroyed.
DESTROYED = '{"v":1,"destroyed":true}'


def draw_keys(subjects: DataFrame, key: str, schema: str, table: str, secret: bytes, kek: bytes) -> DataFrame:
    """user_hash, wrapped_dek and salt for each subject. The keys are random: write
    this frame and read it back before using it, or a lost task would draw others."""
    drawn = subjects.select(key, user_hash(schema, table, F.col(key), secret).alias("user_hash"), random_bytes(32).alias("dek"), F.hex(random_bytes(16)).alias("salt"))
    return drawn.select(key, "user_hash", wrap_key(F.col("dek"), kek).alias("wrapped_dek"), "salt")


def vault_rows(root: DataFrame, keys: DataFrame, key: str, pii: list[str], secret: bytes, kek: bytes, now: Column, years: Column, notice_hours: int = 48) -> DataFrame:
    """Vault records: ciphertext of the personal columns as JSON, pseudonym, and due
    times. ``keys`` is the stored frame of ``draw_keys``."""
    joined = root.join(keys, key)
    payload = F.to_json(F.struct(*pii))
    first = F.coalesce(F.col(pii[0]).cast("string"), payload)
    expiry, notice = retention_window(now, years, notice_hours)
    return joined.select("user_hash", pseudonym(F.col(key), first, F.col("salt"), secret).alias("pseudonym"), F.to_json(F.struct(F.lit(1).alias("v"), F.base64(encrypt(payload, unwrap_key(F.col("wrapped_dek"), kek))).alias("data"))).alias("encrypted_pii"), notice.alias("notification_due_at"), expiry.alias("retention_expiry"))


def open_vault(vault: DataFrame, keys: DataFrame, kek: bytes) -> DataFrame:
    """user_hash and payload; null payloads where the key is gone."""
    data = F.unbase64(F.get_json_object("encrypted_pii", "$.data"))
    return vault.join(keys.select("user_hash", "wrapped_dek"), "user_hash", "left").select("user_hash", decrypt(data, unwrap_key(F.col("wrapped_dek"), kek)).alias("payload"))


def notice_state(now: Column) -> Column:
    """Of a vault row: shredded, already_sent, not_due, window_missed or send."""
    c = F.col
    return F.when(c("shredded_at").isNotNull(), "shredded").when(c("notification_sent_at").isNotNull(), "already_sent").when(now < c("notification_due_at"), "not_due").when(now >= c("retention_expiry"), "window_missed").otherwise("send")


def notice_payload(opened: DataFrame, email_path: str = "$.email", name_path: str = "$.full_name") -> DataFrame:
    """Messages for a mail sender: user_hash, email, name and idempotency_key."""
    text = lambda p: F.nullif(F.trim(F.try_variant_get(F.try_parse_json("payload"), p, "string")), F.lit(""))
    return opened.select("user_hash", text(email_path).alias("email"), F.coalesce(text(name_path), F.lit("User")).alias("name"), F.concat(F.lit("notice:"), "user_hash").alias("idempotency_key"))


def shred_state(now: Column, has_key: Column, require_notice: bool = True) -> Column:
    """Of a vault row: already_shredded, a refusal's code, or shred."""
    c = F.col
    out = F.when(c("shredded_at").isNotNull(), "already_shredded").when(c("retention_expiry") > now, "SHREDDER_RETENTION_NOT_REACHED")
    if require_notice:
        out = out.when(c("notification_sent_at").isNull(), "SHREDDER_NOTICE_MISSING")
    return out.when(~has_key, "SHREDDER_KEY_MISSING").otherwise("shred")


def shred(vault: DataFrame, keys: DataFrame, now: Column, require_notice: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vault and key tables after destruction, and the outcome of each row. The key
    table must replace the old one and the old files be deleted (``Versions.forget``)."""
    marked = vault.join(keys.select("user_hash").distinct().withColumn("_key", F.lit(True)), "user_hash", "left").withColumn("outcome", shred_state(now, F.col("_key").isNotNull(), require_notice))
    gone = F.col("outcome") == "shred"
    after_ = marked.select(*[F.when(gone, F.lit(DESTROYED)).otherwise(F.col(c)).alias(c) if c == "encrypted_pii" else F.when(gone, now).otherwise(F.col(c)).alias(c) if c == "shredded_at" else F.col(c) for c in vault.columns])
    left = keys.join(marked.where(gone).select("user_hash"), "user_hash", "left_anti")
    return after_, left, marked.select("user_hash", "outcome")


def shred_files(store, now: Column, require_notice: bool = True, keys: str = "keys", vault: str = "vault") -> DataFrame:
    """Shred what is due in a store (``sources.tables.Versions``): only files of the key
    and vault tables with a row to destroy are written anew, one manifest switches both,
    and superseded files of the keys are deleted. Returns the outcome of each vault row."""
    own = store.rows(keys)
    marked = store.rows(vault).join(own.select("user_hash").distinct().withColumn("_key", F.lit(True)), "user_hash", "left")
    outcome = stored(marked.select("user_hash", "_file", shred_state(now, F.col("_key").isNotNull(), require_notice).alias("outcome")))
    gone = outcome.where("outcome = 'shred'").select("user_hash").distinct().withColumn("_gone", F.lit(True))
    # the names of files, no more than the manifest has
    old_keys = [r[0] for r in own.join(gone, "user_hash", "left_semi").select("_file").distinct().collect()]
    old_vault = [r[0] for r in outcome.where("outcome = 'shred'").select("_file").distinct().collect()]
    if old_vault:
        part = store.read(vault, old_vault)
        new = {"encrypted_pii": F.lit(DESTROYED), "shredded_at": now}
        rows = part.join(gone, "user_hash", "left").select(*[F.when(F.col("_gone"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in part.columns])
        left = store.read(keys, old_keys)
        store.commit(changes={vault: Change(rows, old_vault), keys: Change(left.join(gone, "user_hash", "left_anti").select(*left.columns), old_keys)})
        store.forget(keys)
    return outcome.drop("_file")


def shredded_events(rows: DataFrame, key: str, schema: str, table: str, now: Column, stored: DataFrame | None = None) -> DataFrame:
    """SHRED_SUCCESS for vault rows (user_hash, the subject's ``key`` and, where they are
    known, the fields of the request) that were shredded."""
    request = [c for c in ("request_id", "tenant_id", "trigger_source", "legal_framework", "actor_opaque_id", "applied_rule_name", "applied_rule_citation") if c in rows.columns]
    root = F.col(key).cast("string")
    payload = [*map(F.col, request), root.alias("subject_opaque_id"), iso_timestamp(now).alias("event_timestamp"), F.lit(schema).alias("root_schema"), F.lit(table).alias("root_table"), root.alias("root_id"), iso_timestamp(now).alias("shredded_at")]
    return outbox_rows(rows, "SHRED_SUCCESS", f"shred:{schema}:{table}", key, payload, now, stored)


def phase(now: Column) -> Column:
    """A vault row's phase, from its times."""
    c = F.col
    return F.when(c("shredded_at").isNotNull(), "shredded").when(c("retention_expiry") <= now, "expired").when(c("notification_sent_at").isNotNull(), "notified").when(c("notification_due_at") <= now, "notice_due").otherwise("vaulted")


def outbox_rows(rows: DataFrame, event_type: str, prefix: str, key: str, payload: list[Column], now: Column, stored: DataFrame | None = None) -> DataFrame:
    """Events to append to the outbox (idempotency_key, user_hash, event_type, payload,
    created_at): one for each idempotency key, and none that is stored already. The key
    is the request's, where ``rows`` has a request_id, else the subject's."""
    name = F.coalesce(F.col("request_id"), key_of(prefix, key)) if "request_id" in rows.columns else key_of(prefix, key)
    own = F.concat(F.lit(f"{prefix.split(':')[0]}:"), name)
    out = rows.select(own.alias("idempotency_key"), "user_hash", F.lit(event_type).alias("event_type"), canonical_json(F.to_json(F.struct(*payload))).alias("payload"), now.alias("created_at")).dropDuplicates(["idempotency_key"])
    return out if stored is None else out.join(stored.select("idempotency_key"), "idempotency_key", "left_anti")


def key_of(prefix: str, key: str) -> Column:
    """A subject's place (schema, table and id column behind the prefix's first colon) and id."""
    return F.concat(F.lit(prefix.split(":", 1)[1] + ":"), F.col(key).cast("string"))


def vaulted_events(plan: DataFrame, key: str, schema: str, table: str, dependents: int, now: Column, stored: DataFrame | None = None) -> DataFrame:
    """USER_VAULTED for the subjects of a plan (``subjects.plan_batch``) that went to
    the vault."""
    payload = [F.col("rule_name").alias("applied_rule_name"), F.lit(dependents).alias("dependency_count"), iso_timestamp(now).alias("event_timestamp"), iso_timestamp(F.col("notification_due_at")).alias("notification_due_at"), iso_timestamp(F.col("retention_expiry")).alias("retention_expiry"), F.col("retention_years"), F.col(key).cast("string").alias("root_id"), F.lit(table).alias("root_table")]
    return outbox_rows(plan.where("action = 'vault'"), "USER_VAULTED", f"vault:{schema}:{table}:{key}", key, payload, now, stored)


def hard_deleted_events(plan: DataFrame, key: str, schema: str, table: str, now: Column, stored: DataFrame | None = None) -> DataFrame:
    """USER_HARD_DELETED for the subjects of a plan that were deleted outright."""
    payload = [iso_timestamp(now).alias("deleted_at"), F.lit(0).alias("dependency_count"), iso_timestamp(now).alias("event_timestamp"), F.col(key).cast("string").alias("root_id"), F.lit(table).alias("root_table")]
    return outbox_rows(plan.where("action = 'hard_delete'"), "USER_HARD_DELETED", f"hard-delete:{schema}:{table}:{key}", key, payload, now, stored)


def sent_notices(messages: DataFrame, sent: DataFrame, schema: str, table: str, key: str, now: Column, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Receipts (idempotency_key, user_hash, sent_at) and NOTIFICATION_SENT rows for the
    messages (user_hash, the subject's key, idempotency_key) that a mail sender confirms
    (idempotency_key)."""
    done = messages.join(sent.select("idempotency_key").distinct(), "idempotency_key", "left_semi")
    receipts = done.select("idempotency_key", "user_hash", now.alias("sent_at"))
    payload = [iso_timestamp(now).alias("event_timestamp"), F.col(key).cast("string").alias("root_id"), F.lit(table).alias("root_table"), iso_timestamp(now).alias("sent_at")]
    return receipts, outbox_rows(done, "NOTIFICATION_SENT", f"notice:{schema}:{table}", key, payload, now, stored)
