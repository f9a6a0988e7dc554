"""Queries over tables laid out as larger ones are: folders of files, many row groups."""

import shutil
from pathlib import Path

import duckdb
import pytest

from lethe import queries as library
from lethe.queries.base import TABLES

DIR = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def laid_out(tmp_path_factory):
    """The smallest tables, documents in a folder of two files, events in row groups of 100 rows."""
    import pyarrow.parquet as pq

    at = tmp_path_factory.mktemp("laid-out")
    for t in TABLES:
        if t == "documents":
            rows = pq.read_table(DIR / f"{t}.parquet")
            (at / f"{t}.parquet").mkdir()
            for k in range(2):
                pq.write_table(rows.slice(k * rows.num_rows // 2, rows.num_rows // 2), at / f"{t}.parquet/part-{k}.parquet")
        elif t == "events":
            pq.write_table(pq.read_table(DIR / f"{t}.parquet"), at / f"{t}.parquet", row_group_size=100)
        else:
            shutil.copy(DIR / f"{t}.parquet", at)
    return at


def rows_of(spark, at, name):
    """What a query and its SQL give, both sorted."""
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{at}/{t}.parquet{'/*.parquet' if (at / f'{t}.parquet').is_dir() else ''}'")
    want = c.sql(library.oracle_sql()[name])
    got = library.queries()[name](spark, str(at)).select(*want.columns).collect()
    return sorted(map(str, map(tuple, got))), sorted(map(str, want.fetchall()))


def test_objects_of_tables_in_folders(spark, laid_out):
    got, want = rows_of(spark, laid_out, "object_sample")
    assert got == want and len(got) == len(TABLES)


def test_samples_of_tables_with_many_row_groups(spark, laid_out):
    got, want = rows_of(spark, laid_out, "table_sample")
    assert got == want and len(got) > 200


def test_samples_of_tables_are_of_all_rows(spark, laid_out):
    """The hundred lowest hashes among all events, of the query and of its SQL; a part of the events has others."""
    import hashlib

    import pyarrow.parquet as pq

    events = pq.read_table(laid_out / "events.parquet").to_pylist()
    first = lambda c: sorted((hashlib.md5(f"{c}:{e['event_id']}".encode()).hexdigest(), str(e[c])) for e in events if e[c] is not None)[:100]
    want = sorted(str((c, value)) for c in ("event_id", "user_id", "event_type", "props") for _, value in first(c))
    assert rows_of(spark, laid_out, "table_sample") == (want, want) and len(want) == 400


def test_samples_of_events_with_odd_ids(spark, tmp_path):
    """Null, repeated, negative and far ids, a column with few values and one with none, in many files."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "events.parquet").mkdir()
    ids = [None, None, -(2**63), -1, 0, 2**63 - 1, *[5] * 200, *range(100)]
    for k in range(30):
        rows = {"event_id": ids, "ts": [None] * len(ids), "user_id": [k * 1000 + i for i in range(len(ids))], "event_type": [f"\u00e4{i % 7}" if k == 29 and i < 3 else None for i in range(len(ids))], "value": [1.5] * len(ids), "props": [None] * len(ids)}
        types = {"event_id": pa.int64(), "ts": pa.timestamp("us"), "user_id": pa.int64(), "event_type": pa.string(), "value": pa.float64(), "props": pa.string()}
        pq.write_table(pa.table({c: pa.array(v, types[c]) for c, v in rows.items()}), tmp_path / f"events.parquet/part-{k:02d}.parquet", row_group_size=50)
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = c.sql(library.oracle_sql()["table_sample"]).fetchall()
    got = library.queries()["table_sample"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 100 + 100 + 3


def test_samples_sort_few_cells(spark, tmp_path):
    """Cells are counted by the first digits of their hashes before they are sorted; the sample is that of all cells."""
    from pyspark.sql import functions as F

    from lethe.sources import catalog

    rows = spark.range(50_000).select("id", (F.col("id") % 3).alias("few"), F.when(F.col("id") % 9_000 == 1, F.col("id")).alias("rare"), F.lit(None).cast("string").alias("none"))
    rows.write.parquet(str(tmp_path / "t"))
    whole = spark.read.parquet(str(tmp_path / "t"))
    for key in (["id"], ["few"], []):
        for limit in (1, 10, 1000):
            got, want = (sorted(map(tuple, df.collect())) for df in (catalog.table_sample(spark, str(tmp_path / "t"), 100, limit, key), catalog.column_sample(whole, 100, limit, key)))
            assert got == want and len(got) == 2 * limit + min(limit, 6)


def test_row_keys_of_any_bytes(spark):
    """Keys of every byte and of all lengths around a block; no function over arrays, which this Spark interprets."""
    import hashlib
    import hmac

    from pyspark.sql import functions as F

    from lethe.functions.crypto import hmac_row_sha256_hex

    keys = [bytes(range(k, k + 64)) for k in (0, 64, 128, 192)] + [b"", b"\0", b"6" * 8, b"\xff" * 64, b"k" * 65, bytes(range(256))]
    rows = spark.createDataFrame([(i, k, f"text \u00e4 {i}") for i, k in enumerate(keys)], "i int, k binary, m string").withColumn("mac", hmac_row_sha256_hex(F.col("m"), F.col("k")))
    assert [r.mac for r in rows.orderBy("i").collect()] == [hmac.new(k, f"text \u00e4 {i}".encode(), hashlib.sha256).hexdigest() for i, k in enumerate(keys)]
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_equal_cells_are_classified_once(spark):
    """Counts are of cells all the same; the signatures are looked for after equal cells have met."""
    from lethe.operators.discovery import column_taxonomy

    rows = spark.createDataFrame([("a@example.com",)] * 3 + [("none",)] * 2 + [(None,)], "contact string")
    found = column_taxonomy(rows, "t", ["contact"], 0.05)
    assert [(r.sample_size, r.matches, r.signatures) for r in found.collect()] == [(5, 3, "email")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Aggregate" in line][-1].count("value") >= 1


def test_keys_by_bitmaps(spark):
    """Dense values take a row for 64; negative, sparse, repeated and null values count as before."""
    from lethe.plans import graph

    assert graph.value_blocks([(spark.range(64_000), "id")]).count() == 1000
    frame = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name}_k long")
    far = [-(2**62), -65, -64, -1, 0, 63, 64, 2**62]
    tables = {"p": frame("p", far), "c": frame("c", [-65, -65, None, 2**62, 0]), "d": frame("d", [0, 1]), "q": frame("q", [*far, None]), "e": frame("e", far[::-1]), "n": frame("n", [None])}
    got = {(r.child_table, r.parent_table) for r in graph.found_keys(tables).collect()}
    assert got == {("c", "p"), ("c", "e"), ("p", "e"), ("q", "p"), ("q", "e")}
