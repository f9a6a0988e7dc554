"""Catalog frames, samples of columns and objects, fingerprints and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.crypto import sha256_hex

_COLUMNS = "table_schema string, table_name string, column_name string, data_type string, ordinal_position int"


def catalog_scan(spark: SparkSession, tables: dict[str, DataFrame], schema: str = "app", types: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each column of the given tables, from their schemas alone; no
    table is read. ``types`` keeps columns of those types only."""
    rows = [(schema, name, f.name, f.dataType.simpleString(), i + 1) for name, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]
    out = spark.createDataFrame(rows, _COLUMNS)
    return out.where(F.col("data_type").isin(*types)) if types else out


def _bounds(percent: float, limit: int) -> None:
    if not 0 < percent <= 100 or not 1 <= limit <= 1000:
        raise ValueError("percent must be in (0, 100] and limit in [1, 1000]")


def _lowest(rows: DataFrame, columns: list[str], key: list[str], limit: int, counted: bool = False) -> DataFrame:
    """column_name and value: of each column, the ``limit`` non-null values whose rows come
    first by a hash of column and key. All columns in one pass: cells are put
    below each other, and each task passes on at most ``limit`` of a column (a group limit
    before the shuffle), so the aggregate is bounded and any order of parts gives the same.

    A group limit sorts all cells of a task. Where they are many, a pass that counts them by
    the first two digits of their hashes (``counted``) tells beyond which digits there is none
    of the lowest, and only cells up to these, one in 256 or as many as it takes, are sorted."""
    row = F.concat_ws(":", *[F.col(k).cast("string") for k in key]) if key else F.xxhash64(*rows.columns).cast("string")
    cells = rows.select(row.alias("_row"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("c")).select("c.*", "_row").where("value is not null")
    digest = F.md5(F.concat_ws(":", "column_name", "_row"))
    if counted:
        digits = F.substring(digest, 1, 2)
        so_far = F.sum("count").over(Window.partitionBy("column_name").orderBy("_digits"))
        below = cells.groupBy("column_name", digits.alias("_digits")).count().withColumn("_below", so_far - F.col("count"))
        last = below.where(F.col("_below") < limit).groupBy("column_name").agg(F.max("_digits").alias("_last"))
        cells = cells.join(F.broadcast(last), "column_name").where(digits <= F.col("_last"))
    order = Window.partitionBy("column_name").orderBy(digest, "_row", "value")
    return cells.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).select("column_name", "value")


def column_sample(df: DataFrame, percent: float = 1.0, limit: int = 100, key: list[str] | None = None) -> DataFrame:
    """column_name and value: of each column, at most ``limit`` of the non-null values in
    a share of the rows; for columns that have none there, of all its non-null values.

    A row is in the sample or not by a hash of its ``key`` columns (of all columns
    without one), and of the values those with the lowest hashes are taken, so the
    result depends neither on partitions nor on order. This reads the whole frame: of a
    Parquet table ``table_sample`` reads a part."""
    _bounds(percent, limit)
    key = key or []
    drawn = F.pmod(F.xxhash64(*(key or df.columns)), F.lit(1_000_000)) < round(percent * 10_000)
    some = _lowest(df if percent == 100 else df.where(drawn), df.columns, key, limit)
    rest = _lowest(df, df.columns, key, limit)
    return some.unionAll(rest.join(some.select("column_name").distinct(), "column_name", "left_anti"))


def table_sample(spark: SparkSession, path: str, percent: float = 1.0, limit: int = 100, key: list[str] | None = None, seed: str = "7") -> DataFrame:
    """The same of a Parquet table, of which only row groups chosen by hash are read (whole
    files where there are many, ``sources.objects.chosen_blocks``). Columns without a value
    there are looked for in the whole table, these columns (and the key) alone.

    Row groups depend on how a table was written, and so do the rows of a share of them. At
    100 per cent Spark reads the whole table, and the rows alone decide."""
    from .objects import register
    from .tables import stored

    _bounds(percent, limit)
    key = key or []
    if percent == 100:
        whole = spark.read.parquet(path)
        return _lowest(whole, whole.columns, key, limit, counted=True)
    rows = register(spark).read.format("parquet_blocks").option("percent", percent).option("seed", seed).load(path)
    some = stored(_lowest(rows, rows.columns, key, limit), "sample")
    found = {r[0] for r in some.select("column_name").distinct().collect()}  # names of columns
    missing = [c for c in rows.columns if c not in found]
    if not missing:
        return some
    return some.unionAll(_lowest(spark.read.parquet(path).select(*dict.fromkeys([*key, *missing])), missing, key, limit))


def _unpacked(most_bytes: int):
    """Prefixes of objects (content, kind), gzip unpacked, with a warning where an
    object can't be read."""
    import zlib
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, warnings = [], []
            for raw, kind in zip(batch.column("content").to_pylist(), batch.column("format").to_pylist(), strict=True):
                head, warning = None, None
                if raw is not None and kind == "gzip":
                    try:
                        head = zlib.decompressobj(31).decompress(raw, most_bytes)
                    except zlib.error:
                        warning = "UNREADABLE_GZIP"
                elif raw is not None and kind == "text":
                    head = raw[:most_bytes]
                heads.append(None if head is None else head.decode("utf-8", "replace"))
                warnings.append(warning)
            own = [batch.column(c) for c in ("path", "length", "format", "content_type", "head")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(heads, pa.string()), pa.array(warnings, pa.string())], names=["path", "length", "format", "content_type", "head", "prefix", "warning"])

    return run


#: Media types by format.
_MEDIA = {"parquet": "application/vnd.apache.parquet", "avro": "application/avro", "gzip": "application/gzip", "json": "application/json", "csv": "text/csv", "text": "text/plain"}


def object_sample(spark: SparkSession, path: str, most_bytes: int = 1 << 20) -> DataFrame:
    """Each object with its length, format (by extension and first bytes), content type,
    the prefix of its text (gzip unpacked), whether it is scanned, and a warning.

    At most ``most_bytes`` of an object are read, whatever its length; columnar objects
    (four bytes are read) are not scanned as text and carry COLUMNAR_NOT_SCANNED."""
    from .objects import register

    read = register(spark).read.format("object_heads").option("mostBytes", most_bytes).load(path)
    head, name = F.hex(F.substring("content", 1, 4)), F.lower(F.col("path"))
    kind = F.when(name.endswith(".parquet") | (head == "50415231"), "parquet").when(name.endswith(".avro") | (head == "4F626A01"), "avro").when(name.endswith(".gz") | head.startswith("1F8B"), "gzip").otherwise("text")
    media = F.coalesce(*[F.when(name.rlike(rf"\.{e}(\.gz)?$"), m) for e, m in _MEDIA.items() if e in ("json", "csv")], *[F.when(F.col("format") == k, m) for k, m in _MEDIA.items()])
    typed = read.withColumn("format", kind).withColumn("content_type", media).withColumn("head", head)
    out = typed.select("path", "length", "format", "content_type", "head", F.when(F.col("format").isin("text", "gzip"), F.col("content")).alias("content")).mapInArrow(_unpacked(most_bytes), "path string, length long, format string, content_type string, head string, prefix string, warning string")
    warning = F.coalesce("warning", F.when(F.col("format").isin("parquet", "avro"), "COLUMNAR_NOT_SCANNED"))
    return out.withColumn("warning", warning).withColumn("scanned", F.col("format").isin("text", "gzip") & F.col("warning").isNull())


def schema_fingerprint(catalog: DataFrame, separators: bool = False) -> DataFrame:
    """SHA-256 over the ordered table, column and type names; without separators as
    approved fingerprints have it, with them (version 2) unambiguous."""
    parts = ["table_name", "column_name", "data_type"]
    one = F.concat_ws("\x1f", *parts) if separators else F.concat(*parts)
    rows = F.array_sort(F.collect_list(F.struct("table_name", "ordinal_position", one.alias("one"))))
    return catalog.agg(sha256_hex(F.array_join(F.transform(rows, lambda r: r["one"]), "\x1e" if separators else "")).alias("fingerprint"))


def schema_drift(catalog: DataFrame, approved: str) -> DataFrame:
    """The fingerprint, the approved one, and whether work must stop."""
    return schema_fingerprint(catalog).select("fingerprint", F.lit(approved).alias("approved"), (F.col("fingerprint") != approved).alias("quarantined"))


def compatibility(catalog: DataFrame, required: DataFrame, covered: DataFrame) -> DataFrame:
    """Violations: required columns (table_name, column_name) and tables that are not
    there, and tables that no plan row (table_name) covers."""
    tables = catalog.select("table_name").distinct()
    missing_table = required.select("table_name").distinct().join(tables, "table_name", "left_anti").select(F.lit("TABLE_MISSING").alias("code"), F.col("table_name").alias("detail"))
    there = required.join(tables, "table_name", "left_semi")
    missing = there.join(catalog, ["table_name", "column_name"], "left_anti").select(F.lit("COLUMN_MISSING").alias("code"), F.concat_ws(".", "table_name", "column_name").alias("detail"))
    bare = tables.join(covered.select("table_name"), "table_name", "left_anti").select(F.lit("TABLE_NOT_COVERED").alias("code"), F.col("table_name").alias("detail"))
    return missing_table.unionByName(missing).unionByName(bare)


def conditions(**wanted) -> Column:
    """Equality on each column whose value is given; None means no filter."""
    out = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            out &= F.col(name) == value
    return out
