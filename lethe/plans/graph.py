"""Foreign keys, their closure from a root, logical links, and plan checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Column names that identify a subject.
IDENTIFIER = r"^(?:user_id|account_id|customer_id|client_id|actor_id|user_uuid|member_id|subject_id|.*_user_id|target_email|user_email)$"
#: Link columns that hold a root's e-mail address.
MAIL_LINKS = ("target_email", "user_email", "email_address")
DELETE_ACTIONS = {"a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"}
MAX_DEPTH = 32


def value_blocks(columns: list[tuple[DataFrame, str]]) -> DataFrame:
    """The values of whole-number columns as bitmaps: column (its place in the list), block
    (the value without its last six bits; null for nulls), bits (which of the block's 64
    values occur) and n (rows). Keys that lie close take one row for 64 values."""
    value = lambda c: F.col(c).cast("long")
    cells = [df.select(F.lit(i).alias("column"), value(c).alias("value")) for i, (df, c) in enumerate(columns)]
    bit = F.expr("shiftleft(1L, cast(value & 63 as int))")
    return reduce(DataFrame.unionAll, cells).groupBy("column", F.shiftright("value", 6).alias("block")).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))


def found_keys(tables: dict[str, DataFrame], prefix: str = r"^[a-z]_") -> DataFrame:
    """Foreign keys that the data of tables without declared ones bear out.

    Candidates are integer columns of one name (without ``prefix``) in two tables. A
    column is a key if it is unique and never null there; another column refers to it
    if all its values occur in it. Of two keys with the very same values, the table of
    the greater name refers to the other. Each column is read once and reduced to bitmaps
    of its values (``value_blocks``, written) before anything is joined: it is unique if
    it has as many bits as rows."""
    import re
    from collections import Counter

    from ..sources.tables import stored

    columns = [(t, f.name, re.sub(prefix, "", f.name)) for t, df in sorted(tables.items()) for f in df.schema.fields if isinstance(f.dataType, IntegralType)]
    often = Counter(base for _, _, base in columns)
    columns = [c for c in columns if often[c[2]] > 1]
    spark = next(iter(tables.values())).sparkSession
    if not columns:
        return spark.createDataFrame([], "constraint_name string, child_table string, child_column string, parent_table string, parent_column string")
    blocks = stored(value_blocks([(tables[t], c) for t, c, _ in columns]), "blocks")
    named = spark.createDataFrame([(i, *c) for i, c in enumerate(columns)], "column int, table_name string, column_name string, base string")
    # a row for each column
    about = blocks.groupBy("column").agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("distinct"), F.sum("n").alias("n"), F.count_if(F.col("block").isNull()).alias("nulls")).join(named, "column")
    about = about.select("column", "table_name", "column_name", "base", "distinct", ((F.col("n") == F.col("distinct")) & (F.col("nulls") == 0)).alias("unique"))
    side = lambda name, rows: rows.select(*[F.col(c).alias(f"{name}_{c}") for c in rows.columns])
    child, parent = side("child", about), side("parent", about.where("unique"))
    pairs = child.join(parent, F.col("child_base") == F.col("parent_base")).where("child_table_name <> parent_table_name")
    bits = blocks.where("block is not null").select("column", "block", "bits")
    own = bits.select(F.col("column").alias("child_column"), "block", "bits").join(F.broadcast(pairs.select("child_column", "parent_column")), "child_column")
    met = own.join(bits.select(F.col("column").alias("parent_column"), "block", F.col("bits").alias("there")), ["parent_column", "block"])
    met = met.groupBy("child_column", "parent_column").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("there")))).alias("met"))
    all_met = pairs.join(met, ["child_column", "parent_column"]).where("met = child_distinct")
    one_way = all_met.where("not (child_unique and child_distinct = parent_distinct and child_table_name < parent_table_name)")
    return one_way.select(F.concat_ws("_", "child_table_name", "parent_table_name").alias("constraint_name"), F.col("child_table_name").alias("child_table"), F.col("child_column_name").alias("child_column"), F.col("parent_table_name").alias("parent_table"), F.col("parent_column_name").alias("parent_column"))


def fk_edges(keys: DataFrame) -> DataFrame:
    """Edges from key column rows (constraint_name, child_table, child_column,
    parent_table, parent_column, position): columns as arrays, by position."""
    both = F.array_sort(F.collect_list(F.struct("position", "child_column", "parent_column")))
    out = keys.groupBy("constraint_name", "child_table", "parent_table").agg(both.alias("both"))
    return out.select("constraint_name", "child_table", "parent_table", F.transform("both", lambda b: b["child_column"]).alias("child_columns"), F.transform("both", lambda b: b["parent_column"]).alias("parent_columns"))


def fk_align(child_keys: DataFrame, parent_keys: DataFrame) -> DataFrame:
    """Key column rows from the referencing and the referenced side of constraints,
    aligned by position."""
    return child_keys.join(parent_keys, ["constraint_name", "position"]).select("constraint_name", "child_table", "child_column", "parent_table", "parent_column", "position")


def fk_closure(edges: DataFrame, root: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Tables that hang off a root: table_name, parent_table, constraint_name, depth
    (the least for each table and constraint). Paths never visit a table twice and
    end at ``max_depth``. The root comes with depth 0."""
    spark = edges.sparkSession
    spark.conf.set("spark.sql.cteRecursionLevelLimit", max(100, max_depth + 1))
    out = spark.sql(
        """
        WITH RECURSIVE walk(table_name, parent_table, constraint_name, depth, path) AS (
            SELECT CAST(:root AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), 0, array(CAST(:root AS STRING))
            UNION ALL
            SELECT e.child_table, e.parent_table, e.constraint_name, w.depth + 1, concat(w.path, array(e.child_table))
            FROM walk w JOIN {edges} e ON e.parent_table = w.table_name
            WHERE w.depth < :most AND NOT array_contains(w.path, e.child_table))
        SELECT table_name, parent_table, constraint_name, min(depth) AS depth
        FROM walk GROUP BY table_name, parent_table, constraint_name""",
        args={"root": root, "most": max_depth},
        edges=edges,
    )
    return out


def subtree(edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Rows that hang off some rows by references of any number (child, parent), such as
    a self-reference of accounts: node and depth, the least number of steps from a root
    (``roots`` has node), which has 0.

    For graphs as large as tables: each level is a join of the last one with the edges,
    without what was visited before (so cycles end), and is written; the walk ends where a
    level is empty or at ``max_depth``."""
    from ..sources.tables import stored

    edges = edges.where("parent is not null and child is not null and parent <> child").select("child", "parent")
    frontier = stored(roots.where("node is not null").select("node").distinct(), "level")
    levels, visited = [frontier.withColumn("depth", F.lit(0))], frontier
    for depth in range(1, max_depth + 1):
        below = frontier.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        frontier = stored(below.join(visited, "node", "left_anti"), "level")
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(depth)))
        visited = visited.unionAll(frontier)
    return reduce(DataFrame.unionAll, levels)


def dependency_tree(edges: DataFrame, root: str, max_depth: int = MAX_DEPTH, tables: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Each dependent table once, at its least depth, with the delete action
    (``delete_code`` of the edge) and a violation: actions that change rows by
    themselves, and tables at the depth limit. Where ``tables`` (table_name) are given
    and the root is none of them, one row says so (ROOT_MISSING). ``strict`` makes the
    first violation an error of the job that reads the result."""
    walk = fk_closure(edges, root, max_depth).where("depth > 0").join(edges.select("constraint_name", "child_table", "delete_code").withColumnRenamed("child_table", "table_name"), ["constraint_name", "table_name"])
    best = walk.withColumn("_n", F.row_number().over(Window.partitionBy("table_name").orderBy("depth", "constraint_name"))).where("_n = 1")
    action = F.element_at(F.create_map(*[F.lit(x) for kv in DELETE_ACTIONS.items() for x in kv]), F.col("delete_code"))
    wrong = F.when(action.isin("CASCADE", "SET NULL", "SET DEFAULT"), "UNSAFE_DELETE_ACTION").when(F.col("depth") >= max_depth, "DEPTH_LIMIT")
    out = best.select("table_name", "parent_table", "depth", action.alias("delete_action"), wrong.alias("violation"))
    if tables is not None:
        none = F.lit(None).cast("string")
        there = tables.where(F.col("table_name") == root).agg(F.count("*").alias("n"))
        out = out.unionByName(there.where("n = 0").select(F.lit(root).alias("table_name"), none.alias("parent_table"), F.lit(0).alias("depth"), none.alias("delete_action"), F.lit("ROOT_MISSING").alias("violation")))
    if strict:
        stop = F.raise_error(F.concat_ws(" ", "violation", "table_name")).cast("string")
        out = out.withColumn("violation", F.when(F.col("violation").isNotNull(), stop))
    return out


def logical_link_pairs(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of tables that share an identifier-like column and have no foreign key
    between them over that column."""
    ids = catalog.where(F.lower("column_name").rlike(IDENTIFIER)).select("table_name", "column_name")
    a, b = ids.withColumnRenamed("table_name", "left_table"), ids.withColumnRenamed("table_name", "right_table")
    pairs = a.join(b, "column_name").where("left_table < right_table")
    key = edges.select(F.least("child_table", "parent_table").alias("left_table"), F.greatest("child_table", "parent_table").alias("right_table"), F.explode(F.array_union("child_columns", "parent_columns")).alias("column_name"))
    return pairs.join(key, ["left_table", "right_table", "column_name"], "left_anti").select("left_table", "right_table", "column_name")


def plan_check(plan: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Violations of an erasure plan (target, parent, action, rules map, pii_columns,
    child_columns, parent_columns, primary_key): target, code."""
    from ..sources.tables import stored

    plan = stored(plan, "plan")
    reached = subtree(plan.select(F.col("target").alias("child"), "parent"), plan.where("parent is null").select(F.col("target").alias("node")), max_depth).select(F.col("node").alias("target"))
    known = plan.select(F.col("target").alias("parent"))
    bad = lambda where, code: plan.where(where).select("target", F.lit(code).alias("code"))
    orphan = plan.where("parent is not null").join(known, "parent", "left_anti").select("target", F.lit("MISSING_PARENT").alias("code"))
    unreached = plan.where("parent is not null").join(known, "parent", "left_semi").join(reached, "target", "left_anti").join(orphan.select("target"), "target", "left_anti")
    cycle = unreached.select("target", F.lit("UNREACHABLE").alias("code"))
    return (
        orphan.unionByName(cycle)
        .unionByName(bad("size(pii_columns) > 0 AND action IS NULL", "PII_WITHOUT_ACTION"))
        .unionByName(bad("action = 'redact' AND (rules IS NULL OR cardinality(rules) = 0)", "REDACT_WITHOUT_RULES"))
        .unionByName(bad("size(child_columns) <> size(parent_columns)", "KEY_SIZES_DIFFER"))
        .unionByName(bad("primary_key IS NULL OR size(primary_key) = 0", "NO_PRIMARY_KEY"))
    )


def graft_links(targets: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """Tables that only a logical link ties to a known target, the first link (by
    column) of each: table_name, parent_table, column_name and parent_column. A root's
    column is not the one of the link: it is its e-mail where the link is one, else its id."""
    known = targets.select("table_name").distinct()
    sides = links.select(F.col("left_table").alias("table_name"), F.col("right_table").alias("parent_table"), "column_name").unionByName(links.select(F.col("right_table").alias("table_name"), F.col("left_table").alias("parent_table"), "column_name"))
    fresh = sides.join(known, "table_name", "left_anti").join(known.withColumnRenamed("table_name", "parent_table"), "parent_table", "left_semi")
    first = F.row_number().over(Window.partitionBy("table_name").orderBy(F.desc(F.col("parent_table") == root), "column_name", "parent_table"))
    own = F.when(F.col("parent_table") != root, F.col("column_name")).when(F.col("column_name").isin(*MAIL_LINKS), "email").otherwise("id")
    return fresh.withColumn("_n", first).where("_n = 1").select("table_name", "parent_table", "column_name", own.alias("parent_column"))
