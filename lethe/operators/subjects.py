"""Which subjects to erase, how long the law keeps them, and what a batch will do."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import user_hash
from ..functions.text import after


def purge_select(rows: DataFrame, key: str, wanted: Column, limit: int, max_batch: int = 10_000) -> DataFrame:
    """Ids of the rows that a rule selects, in order, at most a batch of them."""
    return rows.where(wanted).select(key).orderBy(key).limit(min(limit, max_batch))


def purge_boolean(rows: DataFrame, key: str, flag: str, value: bool = True, limit: int = 10_000) -> DataFrame:
    return purge_select(rows, key, F.col(flag) == value, limit)


def purge_enum(rows: DataFrame, key: str, column: str, values: list, limit: int = 10_000) -> DataFrame:
    return purge_select(rows, key, F.col(column).isin(values), limit)


def purge_before(rows: DataFrame, key: str, column: str, cutoff: Column, limit: int = 10_000) -> DataFrame:
    return purge_select(rows, key, F.col(column) < cutoff, limit)


@dataclass(frozen=True)
class Rule:
    """A retention rule: subjects with a row in the evidence table are kept so long."""

    name: str
    years: int
    evidence: str
    column: str | None = None


def retention_pick(subjects: DataFrame, key: str, rules: list[Rule], evidence: dict[str, DataFrame], default_years: int = 0) -> DataFrame:
    """The longest rule of which a subject has evidence (the first of equals), or
    DEFAULT where none is longer than the default: key, retention_years, rule_name."""
    hits = None
    for order, rule in enumerate(rules):
        keys = evidence[rule.evidence].select(F.col(rule.column or key).alias(key))
        own = subjects.select(key).join(keys, key, "left_semi").select(key, F.lit(rule.years).alias("years"), F.lit(-order).alias("rank"), F.lit(rule.name).alias("name"))
        hits = own if hits is None else hits.unionAll(own)
    if hits is None:
        return subjects.select(key, F.lit(default_years).alias("retention_years"), F.lit("DEFAULT").alias("rule_name"))
    best = hits.where(F.col("years") > default_years).groupBy(key).agg(F.max_by(F.struct("years", "name"), F.struct("years", "rank")).alias("best"))
    return subjects.select(key).join(best, key, "left").select(key, F.coalesce("best.years", F.lit(default_years)).alias("retention_years"), F.coalesce("best.name", F.lit("DEFAULT")).alias("rule_name"))


def retention_window(now: Column, years: Column, notice_hours: int) -> tuple[Column, Column]:
    """When retention ends and when the notice is due, which is never before now."""
    expiry = after(now, years=years)
    return expiry, F.greatest(now, after(expiry, hours=-notice_hours))


def erasure_plan(requests: DataFrame, key: str, root: DataFrame, vaulted: DataFrame, deleted: DataFrame, dependents: int, blobs: DataFrame | None = None) -> DataFrame:
    """What happens to each requested subject: already_vaulted, already_hard_deleted,
    missing, hard_delete (nothing depends on it and it holds no object) or vault."""
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    out = requests.select(key).distinct()
    for df, name in ((vaulted, "_v"), (deleted, "_d"), (root, "_r"), *(((blobs, "_b"),) if blobs is not None else ())):
        out = out.join(flag(df, name), key, "left")
    holds = F.col("_b").isNotNull() if blobs is not None else F.lit(False)
    action = F.when(F.col("_v"), "already_vaulted").when(F.col("_d"), "already_hard_deleted").when(F.col("_r").isNull(), "missing").when(F.lit(dependents == 0) & ~holds, "hard_delete").otherwise("vault")
    return out.select(key, action.alias("action"))


def plan_batch(actions: DataFrame, key: str, retention: DataFrame, now: Column, schema: str, table: str, secret: bytes, notice_hours: int = 48) -> DataFrame:
    """The plan of a batch in full: the actions of ``erasure_plan`` with user_hash, and
    for subjects that go to the vault retention_years, rule_name, retention_expiry and
    notification_due_at (from ``retention_pick`` of the requested subjects)."""
    expiry, notice = retention_window(now, F.col("retention_years"), notice_hours)
    kept = F.col("action") == "vault"
    out = actions.join(retention, key, "left").withColumn("retention_expiry", expiry).withColumn("notification_due_at", notice)
    return out.select(key, "action", user_hash(schema, table, F.col(key), secret).alias("user_hash"), *[F.when(kept, F.col(c)).alias(c) for c in ("retention_years", "rule_name", "retention_expiry", "notification_due_at")])
