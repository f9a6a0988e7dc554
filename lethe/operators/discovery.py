"""Finding personal data: in columns, in JSON cells and in free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import schema_fingerprint
from ..functions.classify import LIKELY, THRESHOLD, candidates, classify_leaf, name_score, signature_hits, weight_of


_LEAF = "array<struct<path:string,value:string>>"


def leaves_of(cell: Column, max_depth: int = 10) -> Column:
    """The leaves of a JSON cell as an array of path (arrays as ``[i]``, objects as
    ``.key``) and value, to a depth; nulls left out. Text that is no JSON is one leaf of
    its own, without a path. One expression, so that a table is read and parsed once."""
    kind = lambda e: F.schema_of_variant(e["v"])
    node = lambda path, v: F.struct(path.alias("path"), v.alias("v"))

    def opened(e: Column) -> Column:
        keys = F.transform(F.map_entries(e["v"].cast("map<string,variant>")), lambda kv: node(F.concat(e["path"], F.lit("."), kv["key"]), kv["value"]))
        items = F.transform(e["v"].cast("array<variant>"), lambda v, i: node(F.concat(e["path"], F.lit("["), i.cast("string"), F.lit("]")), v))
        return F.when(kind(e).startswith("OBJECT"), keys).when(kind(e).startswith("ARRAY"), items).otherwise(F.array(e))

    nested = lambda e: kind(e).startswith("OBJECT") | kind(e).startswith("ARRAY")
    start = F.array(node(F.lit(""), F.try_parse_json(cell)))
    step = lambda nodes, _: F.when(F.exists(nodes, nested), F.flatten(F.transform(nodes, opened))).otherwise(nodes)
    nodes = F.aggregate(F.sequence(F.lit(1), F.lit(max_depth)), start, step)
    leaves = F.transform(F.filter(nodes, lambda e: ~nested(e) & (kind(e) != "VOID")), lambda e: F.struct(e["path"].alias("path"), e["v"].cast("string").alias("value")))
    plain = F.array(F.struct(F.lit("").alias("path"), cell.alias("value")))
    is_json = cell.rlike(r"(?s)^\s*(?:\[.*\]|\{.*\})\s*\z") & F.try_parse_json(cell).isNotNull()
    return F.when(cell.isNull(), F.array().cast(_LEAF)).when(is_json, leaves).otherwise(plain)


def json_leaves(rows: DataFrame, key: list[str], column: str, max_depth: int = 10) -> DataFrame:
    """Leaves of JSON cells: key, path and value, as ``leaves_of`` has them."""
    return rows.select(*key, F.explode(leaves_of(F.col(column), max_depth)).alias("leaf")).select(*key, "leaf.path", "leaf.value")


def json_path_score(path: Column) -> Column:
    """The name score of a path, its separators and indexes read as underscores."""
    return name_score(F.regexp_replace(path, r"[.\[\]]+", "_"))


def column_taxonomy(df: DataFrame, table: str, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Findings for the text columns of a sampled table: sample_size, matches, ratio,
    weight (of the heaviest signature), meta (score of the name or of a JSON path),
    confidence and signatures; those of at least the threshold.

    One scan for all columns: cells are put below each other with their column's name,
    so that the signatures are compiled once, however many columns there are. JSON
    cells are classified leaf by leaf; paths that score the threshold count as matches
    of their own (``json_path:<path>``), and hints may come from the path. Equal cells of
    a column are classified once; the shuffle that counts them also deals the cells of a
    table in few row groups over all tasks."""
    stacked = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    cells = df.select(F.explode(F.array(*stacked)).alias("c")).select("c.*").where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    cells = cells.select("column_name", "n", leaves_of(F.col("value")).alias("leaves"))
    scored = F.transform("leaves", lambda e: F.struct(e["path"].alias("path"), F.when(e["path"] != "", json_path_score(e["path"])).otherwise(0.0).alias("score"), classify_leaf(e["value"], F.concat_ws("_", "column_name", e["path"])).alias("found")))
    cells = cells.select("column_name", "n", scored.alias("leaves"))
    paths = F.transform(F.filter("leaves", lambda e: e["score"] >= threshold), lambda e: F.concat(F.lit("json_path:"), e["path"]))
    found = F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform("leaves", lambda e: e["found"])), paths)))
    cells = cells.select("column_name", "n", found.alias("found"), F.coalesce(F.array_max(F.transform("leaves", lambda e: e["score"])), F.lit(0.0)).alias("score"))
    # few different lists of signatures come from many cells
    kinds = cells.groupBy("column_name", "found").agg(F.sum("n").alias("n"), F.max("score").alias("score"))
    each = kinds.groupBy("column_name").agg(F.sum("n").alias("sample_size"), F.coalesce(F.sum(F.when(F.size("found") > 0, F.col("n"))), F.lit(0)).alias("matches"), F.max(weight_of(F.col("found"))).alias("weight"), F.max("score").alias("path_score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))).alias("signatures"))
    return _scored(each, table, threshold)


def _scored(each: DataFrame, table: str, threshold: float) -> DataFrame:
    ratio, meta = F.col("matches") / F.col("sample_size"), F.greatest(name_score(F.col("column_name")), F.col("path_score"))
    both = ratio * F.col("weight")
    confidence = F.greatest(F.when(meta >= threshold, meta).otherwise(0.0), both, 0.3 * meta + 0.7 * both)
    out = each.select(F.lit(table).alias("table_name"), "column_name", "sample_size", "matches", ratio.alias("ratio"), "weight", meta.alias("meta"), confidence.alias("confidence"), F.array_join("signatures", ",").alias("signatures"))
    return out.where(F.col("confidence") >= threshold)


def text_pii_scan(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, signature and how many of a text's candidates (its tokens without
    punctuation at the edges and the text as a whole, each once) have it. Candidates
    that lack what every signature needs are passed over."""
    found = rows.where(F.col(text).rlike(LIKELY)).select(key, F.explode(candidates(F.col(text))).alias("t")).where(F.col("t").rlike(LIKELY))
    named = F.filter(F.array(*[F.when(hit, F.lit(n)) for n, hit in signature_hits(F.col("t")).items()]), lambda x: x.isNotNull())
    return found.select(key, F.explode(named).alias("signature")).groupBy(key, "signature").agg(F.count("*").alias("n"))


def scan_metadata_only(catalog: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Columns whose names alone score the threshold, as a list for each table, best
    first."""
    scored = catalog.withColumn("score", name_score(F.col("column_name"))).where(F.col("score") >= threshold)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "column_name")))
    return scored.groupBy("table_name").agg(F.array_join(F.transform(rows, lambda r: r["column_name"]), ",").alias("columns"), F.max("score").alias("best"))


def findings_summary(findings: DataFrame, targets: DataFrame, links: DataFrame) -> DataFrame:
    """Counts of tables and columns with findings, by confidence, and of the targets
    (table_name) and logical links that go with them."""
    own = findings.agg(F.count_distinct("table_name").alias("tables_with_pii"), F.count("*").alias("columns"), F.count_if(F.col("confidence") >= 0.9).alias("high_confidence"), F.count_if(F.col("confidence") < 0.9).alias("review_required"))
    alone = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
    return own.withColumn("one", F.lit(1)).join(alone(targets.select("table_name").distinct(), "targets"), "one").join(alone(links, "links"), "one").drop("one")


def draft_rules(findings: DataFrame, root: str) -> DataFrame:
    """The default plan: every finding of a table other than the root becomes HMAC."""
    own = findings.where(F.col("table_name") != root).groupBy("table_name").agg(F.array_sort(F.collect_set("column_name")).alias("pii"))
    return own.select("table_name", F.lit("redact").alias("action"), F.map_from_arrays("pii", F.array_repeat(F.lit("HMAC"), F.size("pii"))).alias("rules"), F.array(F.lit("id")).alias("primary_key"))


def introspect(catalog: DataFrame, edges: DataFrame, findings: DataFrame, root: str) -> DataFrame:
    """Targets of a draft plan: the closure of the root, tables grafted by logical
    links (at the depth limit, so that they are erased first), the columns and the condition by
    which each joins its parent, its findings, and the fingerprint of the schema they hold for."""
    from ..plans.graph import MAX_DEPTH, fk_closure, graft_links, logical_link_pairs

    named = lambda c: F.array_join(c, ",")
    keys = edges.select("constraint_name", named("child_columns").alias("child_columns"), named("parent_columns").alias("parent_columns"))
    closure = fk_closure(edges, root).join(keys, "constraint_name", "left").select("table_name", "parent_table", "depth", F.lit("foreign_key").alias("found_by"), "child_columns", "parent_columns")
    grafted = graft_links(closure, logical_link_pairs(catalog, edges), root).select("table_name", "parent_table", F.lit(MAX_DEPTH).alias("depth"), F.lit("logical_link").alias("found_by"), F.col("column_name").alias("child_columns"), F.col("parent_column").alias("parent_columns"))
    pair = lambda p, c: F.concat("parent_table", F.lit("."), p, F.lit(" = "), "table_name", F.lit("."), c)
    condition = F.when(F.col("parent_table").isNotNull(), F.array_join(F.zip_with(F.split("parent_columns", ","), F.split("child_columns", ","), pair), " AND "))
    per_table = findings.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("pii_columns"))
    print_ = schema_fingerprint(catalog).withColumn("one", F.lit(1))
    return closure.unionByName(grafted).withColumn("condition", condition).join(per_table, "table_name", "left").withColumn("one", F.lit(1)).join(print_, "one").drop("one")


def discovery_accuracy(found: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Precision and recall of found against expected keys, with both counts of errors."""
    both = found.select(*key).distinct().withColumn("_f", F.lit(True)).join(expected.select(*key).distinct().withColumn("_e", F.lit(True)), key, "full_outer")
    hit, f, e = F.count_if(F.col("_f") & F.col("_e")), F.count("_f"), F.count("_e")
    return both.agg((hit / F.nullif(f, F.lit(0))).alias("precision"), (hit / F.nullif(e, F.lit(0))).alias("recall"), (e - hit).alias("missing"), (f - hit).alias("false_positives"))


def leak_invariants(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """For each table, rows for which the condition of a leak holds."""
    return reduce(DataFrame.unionAll, [df.agg(F.count_if(cond).alias("leaks")).select(F.lit(name).alias("table_name"), "leaks") for name, (df, cond) in tables.items()])
