"""Erasure over all tables that hang off a batch of subjects.

A plan is a list of targets. Key sets of all targets are found before anything is
masked, as chains of semi joins from the root downward: only keys travel, and the
batch narrows each level. Frames are changed as a whole, once for the batch; tables
of a store file by file (``erase_files``).
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.crypto import mask_value
from ..functions.text import blob_mask
from ..sources.tables import Change, stored


@dataclass(frozen=True)
class Target:
    """A table of the plan: how it joins its parent and what happens to its rows.
    ``blobs`` are columns with object URLs, which are masked by a hash of their own."""

    table: str
    parent: str | None
    child_columns: tuple[str, ...] = ()
    parent_columns: tuple[str, ...] = ()
    primary_key: tuple[str, ...] = ()
    action: str = "redact"
    rules: dict[str, str] = field(default_factory=dict)
    blobs: tuple[str, ...] = ()


def cascade_rows(tables: dict[str, DataFrame], plan: list[Target], subjects: DataFrame, key: str, tenant: str | None = None, keep=None) -> dict[str, DataFrame]:
    """For each target (parents first), its rows that belong to the subjects.

    ``keep`` (say ``sources.tables.stored``) writes the key set of every parent once, so
    that neither a deeper level nor a later use of the rows evaluates the levels above
    it again; without it all is one plan."""
    out: dict[str, DataFrame] = {}
    for t in plan:
        rows = tables[t.table]
        if t.parent is None:
            rows = rows.where(F.col("tenant_id") == tenant) if tenant is not None else rows
            batch = subjects.select(key).distinct()
            out[t.table] = rows.join(keep(batch) if keep else batch, key, "left_semi")
        else:
            keys = out[t.parent].select(*[F.col(p).alias(f"_{c}") for c, p in zip(t.child_columns, t.parent_columns, strict=True)]).distinct()
            on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in t.child_columns])
            out[t.table] = rows.join(keep(keys) if keep else keys, on, "left_semi")
    return out


def not_processed(rows: DataFrame, primary_key: tuple[str, ...], processed: DataFrame, target: str) -> DataFrame:
    """Rows that an earlier part of a run hasn't handled. ``processed`` has target and
    row_key, a JSON array of the key columns as text."""
    own = F.to_json(F.array(*[F.col(c).cast("string") for c in primary_key]))
    return rows.withColumn("row_key", own).join(processed.where(F.col("target") == target).select("row_key"), "row_key", "left_anti").drop("row_key")


def _mask(target: Target, c: str, schema: str, key: bytes) -> Column:
    """What a hit row has in a column: its rule's value, or where the cell is an object's
    URL the hash that stands for it (keyed by the key's base64 text)."""
    own = mask_value(target.rules[c], F.col(c), schema, target.table, c, key) if c in target.rules else F.col(c)
    url = F.trim(F.col(c).cast("string"))
    return F.when(url != "", blob_mask(url, schema, target.table, c, base64.b64encode(key))).otherwise(own) if c in target.blobs else own


def redact_target(table: DataFrame, hit: DataFrame, target: Target, schema: str, key: bytes) -> DataFrame:
    """The table with the rule columns and object URLs of the hit rows masked, others
    untouched."""
    changed = {*target.rules, *target.blobs}
    missing = changed - set(table.columns)
    if missing:
        raise ValueError(f"{target.table} has no column {sorted(missing)}")
    marks = hit.select(*target.primary_key).distinct().withColumn("_hit", F.lit(True))
    joined = table.join(marks, list(target.primary_key), "left")
    masked = [F.when(F.col("_hit"), _mask(target, c, schema, key)).otherwise(F.col(c).cast("string")).alias(c) if c in changed else F.col(c) for c in table.columns]
    return joined.select(*masked)


def delete_target(table: DataFrame, hit: DataFrame, primary_key: tuple[str, ...]) -> DataFrame:
    """The table without the hit rows."""
    return table.join(hit.select(*primary_key).distinct(), list(primary_key), "left_anti").select(*table.columns)


def satellite_rows(table: DataFrame, lookup: str, roots: DataFrame, root_column: str, tenant: bool = False) -> DataFrame:
    """Rows whose lookup column has a root row's value; nulls never match."""
    on = F.col(lookup) == F.col("_value")
    keys = roots.where(F.col(root_column).isNotNull()).select(F.col(root_column).alias("_value"), *([F.col("tenant_id").alias("_tenant")] if tenant else [])).distinct()
    return table.join(keys, on & (F.col("tenant_id") == F.col("_tenant")) if tenant else on, "left_semi")


def satellite_redact(table: DataFrame, name: str, lookup: str, roots: DataFrame, root_column: str, schema: str, key: bytes, rules: dict[str, str] | None = None) -> DataFrame:
    """The table with the lookup column of matching rows hashed, and with ``rules``
    also other columns masked."""
    keys = roots.where(F.col(root_column).isNotNull()).select(F.col(root_column).alias("_value")).distinct().withColumn("_hit", F.lit(True))
    joined = table.join(keys, F.col(lookup) == F.col("_value"), "left")
    rules = {lookup: "HMAC"} | (rules or {})
    return joined.select(*[F.when(F.col("_hit"), mask_value(rules[c], F.col(c), schema, name, c, key)).otherwise(F.col(c).cast("string")).alias(c) if c in rules else F.col(c) for c in table.columns])


def mutation_summary(hits: dict[str, DataFrame], plan: list[Target]) -> DataFrame:
    """Target, action and affected rows."""
    rows = [hits[t.table].agg(F.count("*").alias("affected_rows")).select(F.lit(t.table).alias("target"), F.lit(t.action).alias("action"), "affected_rows") for t in plan]
    return reduce(DataFrame.unionAll, rows)


def erase_batch(tables: dict[str, DataFrame], plan: list[Target], subjects: DataFrame, key: str, schema: str, secret: bytes, keep=None) -> dict[str, DataFrame]:
    """All tables of the plan after the batch. Nothing is written: a shadow run
    evaluates the frames, a real one commits them together (``sources.tables``)."""
    hits = cascade_rows(tables, plan, subjects, key, keep=keep)
    out = {}
    for t in plan:
        if t.action == "delete":
            out[t.table] = delete_target(tables[t.table], hits[t.table], t.primary_key)
        elif t.action == "redact":
            out[t.table] = redact_target(tables[t.table], hits[t.table], t, schema, secret)
    return out


def _masked(target: Target, columns: list[str], kinds: dict[str, str], schema: str, key: bytes) -> list[Column]:
    """The columns of rows marked by ``_hit``, masked where they are hit. Types stay, as
    other files of the table have them: what is not text can only be nullified."""
    changed = {*target.rules, *target.blobs}
    wrong = [c for c in changed if (target.rules.get(c) != "NULLIFY" or c in target.blobs) and kinds.get(c) != "string"]
    if wrong or changed - set(columns):
        raise ValueError(f"{target.table}: no text column {sorted({*wrong, *(changed - set(columns))})}")
    rule = lambda c: F.when(F.col("_hit"), _mask(target, c, schema, key).cast(kinds[c])).otherwise(F.col(c)).alias(c)
    return [rule(c) if c in changed else F.col(c) for c in columns]


def _observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """Rows marked by ``_hit`` that are counted as they pass by."""
    seen = Observation()
    return rows.observe(seen, F.count("*").alias("rows"), F.count_if(F.coalesce("_hit", F.lit(False))).alias("hits")), seen


def erase_files(store, plan: list[Target], subjects: DataFrame, key: str, schema: str, secret: bytes) -> list[dict]:
    """Erase a batch from the tables of a ``sources.tables.Versions``, by file.

    The key sets of all targets are found first, with the file of every hit row; only
    keys are read for that. Then each file with a hit is read and written anew, all
    others stay as they are, and one manifest switches to the result. Counts are taken
    while rows are written, so that nothing is read for them again. Of each target:
    target, action, affected_rows, rows_read, files and files_rewritten. With nothing
    to change, no run is committed."""
    hits = cascade_rows({t.table: store.rows(t.table) for t in plan}, plan, subjects, key, keep=stored)
    changes, out = {}, []
    for t in plan:
        files, row = store.files(t.table), {"target": t.table, "action": t.action, "affected_rows": 0, "rows_read": 0}
        touched, seen = [], None
        if t.action in ("delete", "redact"):
            marks = stored(hits[t.table].select(*t.primary_key, "_file").distinct())
            touched = [r[0] for r in marks.select("_file").distinct().collect()]  # no more than the manifest has
        if touched:
            part = store.read(t.table, touched)
            marked, seen = _observed(part.join(marks.drop("_file").withColumn("_hit", F.lit(True)), list(t.primary_key), "left"))
            kept = marked.where("_hit is null").select(*part.columns) if t.action == "delete" else marked.select(*_masked(t, part.columns, dict(part.dtypes), schema, secret))
            changes[t.table] = Change(kept, touched)
        out.append((row | {"files": len(files), "files_rewritten": len(touched)}, seen))
    if changes:
        store.commit(changes=changes)
    return [row | ({"affected_rows": seen.get["hits"], "rows_read": seen.get["rows"]} if seen else {}) for row, seen in out]


def erase_satellite_files(store, name: str, lookup: str, roots: DataFrame, root_column: str, schema: str, secret: bytes, rules: dict[str, str] | None = None, delete: bool = False) -> dict:
    """The same for a table whose ``lookup`` column has a root row's value: rows are
    deleted, or their lookup column hashed (with ``rules``, others masked too)."""
    keys = stored(roots.where(F.col(root_column).isNotNull()).select(F.col(root_column).alias("_value")).distinct())
    rows = store.rows(name)
    on = F.col(lookup) == F.col("_value")
    touched = [r[0] for r in rows.join(keys, on, "left_semi").select("_file").distinct().collect()]  # no more than the manifest has
    out = {"target": name, "action": "delete" if delete else "redact", "affected_rows": 0, "rows_read": 0, "files": len(store.files(name)), "files_rewritten": len(touched)}
    if not touched:
        return out
    part = store.read(name, touched)
    marked, seen = _observed(part.join(keys.withColumn("_hit", F.lit(True)), on, "left"))
    target = Target(name, None, rules={lookup: "HMAC"} | (rules or {}))
    kept = marked.where("_hit is null").select(*part.columns) if delete else marked.select(*_masked(target, part.columns, dict(part.dtypes), schema, secret))
    store.commit(changes={name: Change(kept, touched)})
    return out | {"affected_rows": seen.get["hits"], "rows_read": seen.get["rows"]}


def shadow_counts(tables: dict[str, DataFrame], plan: list[Target], subjects: DataFrame, key: str, schema: str, secret: bytes) -> list[dict]:
    """What a batch would do, from one pass over each table: all result rows are made,
    counted on their way (hits, and rows left) and thrown away."""
    hits, out = cascade_rows(tables, plan, subjects, key, keep=stored), []
    for t in plan:
        rows = tables[t.table]
        marks = hits[t.table].select(*t.primary_key).distinct().withColumn("_hit", F.lit(True))
        marked, seen = _observed(rows.join(marks, list(t.primary_key), "left"))
        kept = marked.where("_hit is null").select(*rows.columns) if t.action == "delete" else marked.select(*_masked(t, rows.columns, dict(rows.dtypes), schema, secret)) if t.action == "redact" else marked.select(*rows.columns)
        kept.write.format("noop").mode("overwrite").save()
        n = seen.get
        out.append({"target": t.table, "action": t.action, "affected_rows": n["hits"], "rows_after": n["rows"] - (n["hits"] if t.action == "delete" else 0)})
    return out


def dependency_count(plan: list[Target]) -> int:
    return len({t.table for t in plan if t.parent is not None})


def blob_candidates(tables: dict[str, DataFrame], columns: dict[str, list[str]], hits: dict[str, DataFrame]) -> DataFrame:
    """Non-blank object URLs of the hit rows: table_name, column_name, url."""
    rows = [hits[t].select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.trim(c).alias("url")).where("url <> ''") for t, cs in columns.items() for c in cs]
    return reduce(DataFrame.unionAll, rows)


def shared_object_refs(objects: DataFrame) -> DataFrame:
    """Pending or retained objects that another subject also holds: user_hash,
    provider, bucket, key and holders (the number of other subjects)."""
    live = objects.where(F.col("state").isin("pending", "retained"))
    where = ["provider", "bucket", "key"]
    holders = live.groupBy(*where).agg(F.count_distinct("user_hash").alias("n")).where("n > 1")
    return live.join(holders, where).select("user_hash", *where, (F.col("n") - 1).alias("holders")).distinct()


def blob_shred_plan(objects: DataFrame, versions: DataFrame, key: bytes) -> DataFrame:
    """What to do with each object (action legal_hold_only, hard_delete or
    version_purge): retained, refused where shared, or the versions to delete, with
    hashed references only."""
    from ..functions.text import object_ref_hash

    shared = shared_object_refs(objects).select("user_hash", "provider", "bucket", "key").withColumn("_shared", F.lit(True))
    joined = objects.join(shared, ["user_hash", "provider", "bucket", "key"], "left")
    listed = joined.join(versions.groupBy("bucket", "key").agg(F.array_sort(F.collect_list("version_id")).alias("all_versions")), ["bucket", "key"], "left")
    outcome = F.when(F.col("action") == "legal_hold_only", "retained").when(F.col("_shared"), "refused_shared").otherwise("delete")
    some = F.when(F.col("action") == "hard_delete", F.array("version_id")).otherwise(F.filter(F.coalesce("all_versions", F.array().cast("array<string>")), lambda v: F.coalesce(v != F.col("overwrite_version"), F.lit(True))))
    return listed.select("user_hash", object_ref_hash(F.col("bucket"), F.col("key"), F.col("version_id"), key).alias("ref_hash"), outcome.alias("outcome"), F.when(outcome == "delete", F.size(some)).otherwise(0).alias("versions"))
