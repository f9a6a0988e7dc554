"""Catalog, foreign keys, links and plans: over the tables' schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.crypto import mask_value
from ..operators.report import by_names, in_order, targets_order
from ..plans import graph
from ..sources import catalog
from .base import DELETE_CODES, HMAC_KEY, SCHEMA, TABLES, Registry, hmac_sql, load

R = Registry()


def _catalog(spark, sf_dir):
    return catalog.catalog_scan(spark, {t: load(spark, sf_dir, t) for t in TABLES})


_CATALOG_SQL = "(SELECT table_name, column_name, ordinal_position, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>' ELSE 'timestamp_ntz' END AS data_type FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, row_number() OVER () AS ordinal_position, column_type AS data_type FROM (DESCRIBE {t})" for t in TABLES) + ") x) c"


def _edges(spark, sf_dir):
    """The keys that the tables' data bear out. A catalog has tens of them, so that the
    driver may hold them while they are walked."""
    found = graph.found_keys({t: load(spark, sf_dir, t) for t in TABLES}).collect()
    rows = [(r.constraint_name, r.child_table, [r.child_column], r.parent_table, [r.parent_column], DELETE_CODES.get(r.constraint_name, "a")) for r in found]
    return spark.createDataFrame(rows, "constraint_name string, child_table string, child_columns array<string>, parent_table string, parent_columns array<string>, delete_code string")


#: Integer columns of one name in two tables or more.
_INTEGERS = (("nation", "n_regionkey"), ("region", "r_regionkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey"), ("supplier", "s_nationkey"), ("customer", "c_custkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("orders", "o_orderkey"), ("lineitem", "l_partkey"), ("part", "p_partkey"), ("lineitem", "l_suppkey"), ("supplier", "s_suppkey"), ("documents", "doc_id"), ("labels", "doc_id"))


def _edges_sql() -> str:
    """A test of each pair of columns: unique here, and none of the values there missing."""
    base = lambda c: c[2:] if c[1] == "_" else c
    tests = []
    for child, cc in _INTEGERS:
        for parent, pc in _INTEGERS:
            if child != parent and base(cc) == base(pc):
                same = f" AND NOT ((SELECT count(*) = count(DISTINCT {cc}) FROM {child}) AND NOT EXISTS (SELECT 1 FROM {parent} WHERE {pc} NOT IN (SELECT {cc} FROM {child} WHERE {cc} IS NOT NULL)))" if child < parent else ""
                tests.append(f"SELECT '{child}_{parent}' AS constraint_name, '{child}' AS child_table, '{cc}' AS child_column, '{parent}' AS parent_table, '{pc}' AS parent_column, '{DELETE_CODES.get(f'{child}_{parent}', 'a')}' AS delete_code "
                             f"WHERE (SELECT count(*) = count(DISTINCT {pc}) FROM {parent}) AND EXISTS (SELECT 1 FROM {child} WHERE {cc} IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM {child} WHERE {cc} NOT IN (SELECT {pc} FROM {parent})){same}")
    return "(" + " UNION ALL ".join(tests) + ") e"


_EDGES = _edges_sql()


@R.add(f"SELECT 'app' AS table_schema, table_name, column_name, data_type, CAST(ordinal_position AS INTEGER) AS ordinal_position FROM {_CATALOG_SQL}")
def catalog_scan(spark, sf_dir):
    return _catalog(spark, sf_dir)


@R.add(f"SELECT sha256(string_agg(table_name || column_name || data_type, '' ORDER BY table_name, ordinal_position)) AS fingerprint FROM {_CATALOG_SQL}")
def schema_fingerprint(spark, sf_dir):
    return catalog.schema_fingerprint(_catalog(spark, sf_dir))


@R.add(f"""SELECT fingerprint, 'none' AS approved, true AS quarantined FROM (
    SELECT sha256(string_agg(table_name || column_name || data_type, '' ORDER BY table_name, ordinal_position)) AS fingerprint FROM {_CATALOG_SQL}) f""")
def schema_drift(spark, sf_dir):
    return catalog.schema_drift(_catalog(spark, sf_dir), "none")


@R.add(f"""SELECT 'COLUMN_MISSING' AS code, 'customer.c_email' AS detail UNION ALL SELECT 'TABLE_MISSING', 'profiles'
    UNION ALL SELECT 'TABLE_NOT_COVERED', table_name FROM (SELECT DISTINCT table_name FROM {_CATALOG_SQL}) t WHERE table_name NOT IN ('customer', 'orders', 'lineitem', 'events')""")
def config_compat(spark, sf_dir):
    required = spark.createDataFrame([("customer", "c_name"), ("customer", "c_email"), ("profiles", "bio")], "table_name string, column_name string")
    covered = spark.createDataFrame([(t,) for t in ("customer", "orders", "lineitem", "events")], "table_name string")
    return catalog.compatibility(_catalog(spark, sf_dir), required, covered)


@R.add(f"SELECT constraint_name, child_table, parent_table, child_column AS child_columns, parent_column AS parent_columns FROM {_EDGES}")
def fk_edges(spark, sf_dir):
    """Edges found in the data whose columns the catalog has, from aligned key rows."""
    have = _catalog(spark, sf_dir)
    key = _edges(spark, sf_dir).select("*", F.lit(1).alias("position"))
    child = key.select("constraint_name", "position", "child_table", F.element_at("child_columns", 1).alias("child_column")).join(have.select(F.col("table_name").alias("child_table"), F.col("column_name").alias("child_column")), ["child_table", "child_column"])
    parent = key.select("constraint_name", "position", "parent_table", F.element_at("parent_columns", 1).alias("parent_column")).join(have.select(F.col("table_name").alias("parent_table"), F.col("column_name").alias("parent_column")), ["parent_table", "parent_column"])
    out = graph.fk_edges(graph.fk_align(child, parent))
    return out.select("constraint_name", "child_table", "parent_table", F.array_join("child_columns", ",").alias("child_columns"), F.array_join("parent_columns", ",").alias("parent_columns"))


def closure_sql(root: str) -> str:
    return f"""WITH RECURSIVE keys AS (SELECT * FROM {_EDGES}), walk AS (SELECT '{root}' AS table_name, CAST(NULL AS VARCHAR) AS parent_table, CAST(NULL AS VARCHAR) AS constraint_name, 0 AS depth, ['{root}'] AS path
    UNION ALL SELECT e.child_table, e.parent_table, e.constraint_name, w.depth + 1, list_append(w.path, e.child_table) FROM walk w JOIN keys e ON e.parent_table = w.table_name
    WHERE w.depth < 32 AND NOT list_contains(w.path, e.child_table))"""


_CLOSURE = closure_sql("region")


@R.add(_CLOSURE + " SELECT table_name, parent_table, constraint_name, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1, 2, 3")
def fk_closure(spark, sf_dir):
    return graph.fk_closure(_edges(spark, sf_dir), "region")


@R.add(_CLOSURE + """ SELECT table_name, parent_table, CAST(depth AS INTEGER) AS depth, CASE code WHEN 'a' THEN 'NO ACTION' WHEN 'c' THEN 'CASCADE' ELSE 'SET NULL' END AS delete_action,
    CASE WHEN code <> 'a' THEN 'UNSAFE_DELETE_ACTION' END AS violation FROM (
    SELECT w.*, e2.code, row_number() OVER (PARTITION BY table_name ORDER BY depth, w.constraint_name) AS n FROM walk w
    JOIN (SELECT constraint_name AS cn, delete_code AS code FROM keys) e2 ON e2.cn = w.constraint_name WHERE depth > 0) x WHERE n = 1""")
def dependency_tree(spark, sf_dir):
    return graph.dependency_tree(_edges(spark, sf_dir), "region")


@R.add(_CLOSURE + """ SELECT table_name, parent_table, CAST(depth AS INTEGER) AS depth, CAST(NULL AS VARCHAR) AS violation FROM (
    SELECT w.*, row_number() OVER (PARTITION BY table_name ORDER BY depth, w.constraint_name) AS n FROM walk w WHERE depth > 0) x WHERE n = 1
    UNION ALL SELECT 'accounts', NULL, 0, 'ROOT_MISSING'""")
def dependency_tree_missing_root(spark, sf_dir):
    """The trees of a root that is there and of one that is not, over edges without an action of their own."""
    edges = _edges(spark, sf_dir).withColumn("delete_code", F.lit("a"))
    tables = _catalog(spark, sf_dir).select("table_name").distinct()
    trees = [graph.dependency_tree(edges, root, tables=tables) for root in ("region", "accounts")]
    return trees[0].unionByName(trees[1]).select("table_name", "parent_table", "depth", "violation")


#: Customers as accounts that refer to others: five to a parent, and pairs that refer to each other.
_PARENT_SQL = "CASE c_custkey % 50 WHEN 1 THEN c_custkey + 1 WHEN 2 THEN c_custkey - 1 ELSE c_custkey // 5 END"
_ROOTS = "c_custkey % 40 = 7 OR c_custkey % 500 = 1"


@R.add(f"""WITH RECURSIVE e AS (SELECT c_custkey AS child, {_PARENT_SQL} AS parent FROM customer), walk AS (
    SELECT c_custkey AS node, 0 AS depth FROM customer WHERE {_ROOTS} UNION SELECT child, depth + 1 FROM walk JOIN e ON parent = node AND child <> parent WHERE depth < 32)
    SELECT node AS c_custkey, CAST(min(depth) AS INTEGER) AS depth, {hmac_sql("'app:customer:c_name:' || any_value(c_name)", HMAC_KEY)} AS c_name FROM walk JOIN customer ON c_custkey = node GROUP BY node""")
def subtree_erasure(spark, sf_dir):
    """Subjects with all accounts below them by a self-reference, their names masked."""
    c, n = load(spark, sf_dir, "customer"), F.col("c_custkey")
    parent = F.when(n % 50 == 1, n + 1).when(n % 50 == 2, n - 1).otherwise((n / 5).cast("long"))
    tree = graph.subtree(c.select(n.alias("child"), parent.alias("parent")), c.where(_ROOTS).select(n.alias("node")))
    return c.join(tree, n == F.col("node")).select("c_custkey", "depth", mask_value("HMAC", F.col("c_name"), SCHEMA, "customer", "c_name", HMAC_KEY).alias("c_name"))


def _linked(spark, sf_dir):
    """The catalog, with customer's key under the name that others use for it."""
    return _catalog(spark, sf_dir).withColumn("column_name", F.when(F.col("column_name").isin("c_custkey", "o_custkey", "conv_id"), "user_id").otherwise(F.col("column_name")))


_IDENTIFIED = f"(SELECT table_name, CASE WHEN column_name IN ('c_custkey', 'o_custkey', 'conv_id') THEN 'user_id' ELSE column_name END AS column_name FROM {_CATALOG_SQL})"
_LINKS_SQL = f"""SELECT a.table_name AS left_table, b.table_name AS right_table, a.column_name FROM {_IDENTIFIED} a JOIN {_IDENTIFIED} b ON b.column_name = a.column_name AND a.table_name < b.table_name
    WHERE a.column_name IN ('user_id', 'account_id', 'customer_id', 'client_id', 'actor_id', 'member_id', 'subject_id', 'target_email', 'user_email') AND NOT EXISTS (
    SELECT 1 FROM {_EDGES} WHERE least(child_table, parent_table) = a.table_name AND greatest(child_table, parent_table) = b.table_name AND a.column_name IN (child_column, parent_column))"""


@R.add(_LINKS_SQL)
def logical_link_pairs(spark, sf_dir):
    return graph.logical_link_pairs(_linked(spark, sf_dir), _edges(spark, sf_dir))


@R.add(f"""WITH RECURSIVE keys AS (SELECT * FROM {_EDGES}),
    picked AS (SELECT child_table AS target, parent_table AS parent FROM (SELECT *, row_number() OVER (PARTITION BY child_table ORDER BY constraint_name) AS n FROM keys) k WHERE n = 1 AND child_table <> 'nation'),
    plan AS (SELECT * FROM picked UNION ALL SELECT DISTINCT parent_table, NULL FROM keys WHERE parent_table NOT IN (SELECT child_table FROM keys)),
    about AS (SELECT table_name AS target, count(*) FILTER (WHERE data_type = 'string') AS texts, count(*) FILTER (WHERE data_type LIKE 'timestamp%') AS times FROM {_CATALOG_SQL} GROUP BY 1),
    reached AS (SELECT target FROM plan WHERE parent IS NULL UNION SELECT plan.target FROM plan JOIN reached ON plan.parent = reached.target),
    full_plan AS (SELECT plan.*, texts, times FROM plan JOIN about ON about.target = plan.target)
    SELECT target, 'MISSING_PARENT' AS code FROM full_plan WHERE parent IS NOT NULL AND parent NOT IN (SELECT target FROM plan)
    UNION ALL SELECT target, 'UNREACHABLE' FROM full_plan WHERE parent IN (SELECT target FROM plan) AND target NOT IN (SELECT target FROM reached)
    UNION ALL SELECT target, 'PII_WITHOUT_ACTION' FROM full_plan WHERE texts > 0 AND times = 0
    UNION ALL SELECT target, 'REDACT_WITHOUT_RULES' FROM full_plan WHERE times > 0 AND texts < 3
    UNION ALL SELECT target, 'KEY_SIZES_DIFFER' FROM full_plan WHERE parent = 'customer'
    UNION ALL SELECT target, 'NO_PRIMARY_KEY' FROM full_plan WHERE target NOT IN (SELECT parent_table FROM keys)""")
def plan_check(spark, sf_dir):
    """A plan made from the keys that the data bear out, one table left out: tables with
    times are redacted (by rules, where they have three text columns), others have no
    action, and only keys that others refer to are primary ones."""
    edges, cat = _edges(spark, sf_dir), _catalog(spark, sf_dir)
    first = edges.groupBy(F.col("child_table").alias("target")).agg(F.min_by(F.struct("parent_table", "child_columns", "parent_columns"), "constraint_name").alias("e")).where("target <> 'nation'")
    more = F.when(F.col("e.parent_table") == "customer", F.concat("e.parent_columns", F.array(F.lit("c_nationkey")))).otherwise(F.col("e.parent_columns"))
    targets = first.select("target", F.col("e.parent_table").alias("parent"), F.col("e.child_columns").alias("child_columns"), more.alias("parent_columns"))
    none = F.lit(None).cast("array<string>")
    roots = edges.select(F.col("parent_table").alias("target")).distinct().join(edges.select(F.col("child_table").alias("target")), "target", "left_anti")
    targets = targets.unionByName(roots.select("target", F.lit(None).cast("string").alias("parent"), none.alias("child_columns"), none.alias("parent_columns")))
    about = cat.groupBy(F.col("table_name").alias("target")).agg(F.collect_list(F.when(F.col("data_type") == "string", F.col("column_name"))).alias("pii_columns"), F.count_if(F.col("data_type").startswith("timestamp")).alias("times"))
    keys = edges.groupBy(F.col("parent_table").alias("target")).agg(F.min("parent_columns").alias("primary_key"))
    rules = F.when(F.size("pii_columns") >= 3, F.map_from_arrays("pii_columns", F.array_repeat(F.lit("HMAC"), F.size("pii_columns"))))
    return graph.plan_check(targets.join(about, "target").join(keys, "target", "left").withColumn("action", F.when(F.col("times") > 0, "redact")).withColumn("rules", rules))


@R.add(f"SELECT count(*) AS targets, CAST(count(*) AS BIGINT) AS rules, CAST(sum(n) AS BIGINT) AS pii_columns FROM (SELECT table_name, count(*) AS n FROM {_CATALOG_SQL} GROUP BY 1) t")
def plan_counts(spark, sf_dir):
    from ..operators.report import plan_counts as counts

    plan = _catalog(spark, sf_dir).groupBy(F.col("table_name").alias("target")).agg(F.collect_list("column_name").alias("pii_columns")).withColumn("rules", F.create_map(F.lit("x"), F.lit("HMAC")))
    return counts(plan)


@R.add(_CLOSURE + " SELECT count(DISTINCT table_name) AS n FROM walk WHERE depth > 0")
def dependency_count(spark, sf_dir):
    return graph.fk_closure(_edges(spark, sf_dir), "region").where("depth > 0").agg(F.count_distinct("table_name").alias("n"))


@R.add(_CLOSURE + """, targets AS (SELECT table_name, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1)
    SELECT table_name, depth, row_number() OVER (ORDER BY depth, icu_sort_key(table_name, 'en')) AS listed, row_number() OVER (ORDER BY depth DESC, icu_sort_key(table_name, 'en')) AS erased FROM targets""")
def targets_in_order(spark, sf_dir):
    """Targets as a plan lists them, and in the order in which they are erased."""
    targets = graph.fk_closure(_edges(spark, sf_dir), "region").groupBy(F.lit("region").alias("root"), "table_name").agg(F.min("depth").alias("depth"))
    both = in_order(in_order(targets, targets_order(), ["root"], "listed"), targets_order(deepest_first=True), ["root"], "erased")
    return both.select("table_name", "depth", "listed", "erased")


#: Names of mixed case and signs, which bytes would sort another way.
_MIXED = ("a", "a_b", "a1", "aB", "b", "B")


@R.add(f"""SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY icu_sort_key(name, 'en'), name) AS position FROM (
    SELECT 'column' AS kind, column_name AS name FROM {_CATALOG_SQL} UNION SELECT 'column', unnest([{", ".join(f"'{n}'" for n in _MIXED)}])
    UNION SELECT 'word of ' || lang || ', ' || lower(left(w, 1)), w FROM (SELECT lang, regexp_extract(text, '[0-9A-Za-z\u00C0-\u00FF_]+') AS w FROM documents) d WHERE w <> '') n""")
def names_in_order(spark, sf_dir):
    """Columns of the catalog, names of mixed case and the first words of all documents, each list in the root collation."""
    word = F.regexp_extract("text", "[0-9A-Za-z\u00C0-\u00FF_]+", 0)
    words = load(spark, sf_dir, "documents").select("lang", word.alias("name")).where("name <> ''").select(F.concat(F.lit("word of "), "lang", F.lit(", "), F.lower(F.substring("name", 1, 1))).alias("kind"), "name")
    columns = _catalog(spark, sf_dir).select("column_name").unionAll(spark.createDataFrame([(n,) for n in _MIXED], "column_name string"))
    return in_order(columns.select(F.lit("column").alias("kind"), F.col("column_name").alias("name")).unionAll(words).distinct(), by_names("name"), ["kind"])


R.part("fk_edges", fk_align=["constraint_name", "child_columns", "parent_columns"])
R.part("fk_closure", fk_recursive=["table_name", "constraint_name", "depth"])
R.part("dependency_tree", shortest_depth=["table_name", "depth"])
R.part("config_compat", compat_anti=["code", "detail"])
QUERIES, SQL = R.queries, R.sql
