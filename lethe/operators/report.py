"""Counts, latencies and throughput over jobs, tasks and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def job_status_counts(jobs: DataFrame, states: list[str]) -> DataFrame:
    """Total and the count of each state, in one row."""
    return jobs.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in states])


def group_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def task_latency_p95(tasks: DataFrame, share: float = 0.95) -> DataFrame:
    """Exact percentile (interpolated) of milliseconds from creation to completion, for
    each task type and (null) for all.

    By ranks: equal values are counted first, and the counts are summed up in order
    within ranges of values, then over the ranges, so that no group of tasks is gathered
    or sorted in one task."""
    us = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    counts = tasks.where("completed_at is not null").select("task_type", us.alias("us")).where("us is not null").groupBy("task_type", "us").agg(F.count("*").alias("n"))
    both = counts.select(F.col("task_type"), F.lit(False).alias("every"), "us", "n").unionAll(counts.groupBy("us").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string"), F.lit(True), "us", "n"))
    # ranges of values that halve with their distance from zero: few, and of some thousand distinct values each at most where values are milliseconds
    part = F.struct((F.signum("us") * F.floor(F.log2(F.abs("us") + 1))).cast("int").alias("power"), F.floor(F.col("us") / 1_000_000).alias("second"))
    ranged = both.withColumn("part", part)
    sizes = ranged.groupBy("every", "task_type", "part").agg(F.sum("n").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("every", "task_type").orderBy("part.second", "part.power"))
    total = F.sum("size").over(Window.partitionBy("every", "task_type"))
    sizes = sizes.withColumn("upto", upto).withColumn("total", total)
    # the two ranks (from 0) that the percentile lies between
    at = (F.col("total") - 1) * share
    sought = sizes.select("every", "task_type", "part", (F.col("upto") - F.col("size")).alias("below"), "upto", at.alias("at")).where((F.col("below") <= F.ceil("at")) & (F.col("upto") > F.floor("at")))
    same = F.col("l.every") == F.col("r.every")
    inside = ranged.alias("l").join(sought.alias("r"), same & F.col("l.task_type").eqNullSafe(F.col("r.task_type")) & (F.col("l.part") == F.col("r.part"))).select("l.every", "l.task_type", "l.part", "l.us", "l.n", "r.below", "r.at")
    last = F.col("below") + F.sum("n").over(Window.partitionBy("every", "task_type", "part").orderBy("us")) - 1
    value = lambda rank: F.min(F.when(F.col("last") >= rank, F.col("us")))
    out = inside.withColumn("last", last).groupBy("every", "task_type", "at").agg(value(F.floor("at")).alias("lo"), value(F.ceil("at")).alias("hi"))
    return out.select("task_type", ((F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))) / 1000).alias("p95_ms"))


def lifecycle_throughput(jobs: DataFrame, seconds: float) -> DataFrame:
    """Jobs for each second, rounded to two places."""
    return jobs.agg(F.count("*").alias("jobs"), F.round(F.count("*") / F.lit(seconds), 2).alias("jobs_per_second"))


def outbox_lag(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(F.col("status") != "PROCESSED").alias("unfinished"), F.count_if(F.col("current_hash").isNull()).alias("unfinalised"))


def pending_blob_count(objects: DataFrame) -> DataFrame:
    return objects.where("state = 'pending'").groupBy("user_hash").agg(F.count("*").alias("n"))


def receipt_summary(events: DataFrame) -> DataFrame:
    """Objects, versions and provider of nested receipts (array of provider and versions)."""
    total = F.aggregate("receipts", F.lit(0).cast("long"), lambda n, r: n + r["versions"])
    return events.select("event_id", F.size("receipts").alias("objects"), total.alias("versions"), F.get("receipts", F.lit(0))["provider"].alias("provider"))


def page(rows: DataFrame, order: list, limit: int = 50, offset: int = 0, where=None) -> DataFrame:
    """A page of rows, ordered; limits as in the service (1 to 200)."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be in [1, 200] and offset not negative")
    return (rows.where(where) if where is not None else rows).orderBy(*order).offset(offset).limit(limit)


def by_names(*names: str, joined: str = ".") -> list[Column]:
    """Sort keys that put names as readers of a report expect: joined with a dot, in the
    root collation (letters before case, accents after letters, signs before digits),
    not by bytes. Names that the collation holds equal go by bytes; a name with a null
    part stands first."""
    name = F.when(F.forall(F.array(*names), lambda n: n.isNotNull()), F.concat_ws(joined, *names))
    return [F.collate(name, "UNICODE"), name]


def findings_order(table: str = "table_name", column: str = "column_name", score: str = "confidence") -> list[Column]:
    """Surest findings first, then by name."""
    return [F.desc_nulls_last(score), *by_names(table, column)]


def targets_order(table: str = "table_name", depth: str = "depth", deepest_first: bool = False) -> list[Column]:
    """Targets from the root downward, as plans list them, or the deepest first, as they
    are erased; then by name."""
    return [F.desc(depth) if deepest_first else F.asc(depth), *by_names(table)]


def in_order(rows: DataFrame, order: list[Column], within: list[str] | tuple[str, ...], position: str = "position") -> DataFrame:
    """Rows with their place (from 1) in the order of their group. A group is sorted in
    one task: reports and plans have as many rows as a catalog has columns; longer lists
    need a finer ``within``, or ``orderBy`` alone, which sorts by ranges."""
    return rows.withColumn(position, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def plan_counts(plan: DataFrame) -> DataFrame:
    """Targets, rules and personal columns of a plan (target, rules, pii_columns)."""
    return plan.agg(F.count("*").alias("targets"), F.sum(F.coalesce(F.size(F.map_keys("rules")), F.lit(0))).alias("rules"), F.sum(F.size("pii_columns")).alias("pii_columns"))
