"""Stores that change file by file: what stays, what a crash leaves, what is forgotten."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lethe.operators import cascade, vault
from lethe.sources import tables

KEY = b"\x24" * 32
PLAN = [
    cascade.Target("users", None, primary_key=("id",), rules={"name": "HMAC", "age": "NULLIFY"}),
    cascade.Target("orders", "users", ("user_id",), ("id",), ("order_id",), rules={"note": "STATIC_MASK"}),
    cascade.Target("items", "orders", ("order_id",), ("order_id",), ("order_id", "n"), action="delete"),
]


@pytest.fixture()
def store(spark, tmp_path):
    """100 files of orders in the order of users, 20 of the others."""
    out = tables.Versions(spark, str(tmp_path / "s"))
    users = spark.range(10_000).select("id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("name"), (F.col("id") % 90).alias("age"))
    orders = spark.range(30_000).select(F.col("id").alias("order_id"), (F.col("id") / 3).cast("long").alias("user_id"), F.lit("hello").alias("note"))
    items = orders.select("order_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    out.commit({"users": users.repartitionByRange(20, "id"), "orders": orders.repartitionByRange(100, "user_id"), "items": items.repartitionByRange(20, "order_id")})
    return out


def contents(store, name):
    return {f: Path(f"{store.root}/{f}").read_bytes() for f in store.files(name)}


def erased(spark, store, ids):
    done = cascade.erase_files(store, PLAN, spark.createDataFrame([(i,) for i in ids], "id long"), "id", "app", KEY)
    return {r["target"]: r for r in done}


def test_only_files_with_hits_change(spark, store):
    before = {t: contents(store, t) for t in ("users", "orders", "items")}
    assert len(before["orders"]) == 100
    done = erased(spark, store, [5000])  # one of ten thousand
    assert {t: (r["affected_rows"], r["files_rewritten"] <= 2) for t, r in done.items()} == {"users": (1, True), "orders": (3, True), "items": (6, True)}
    for t, old in before.items():
        now = contents(store, t)
        same = set(old) & set(now)
        assert len(same) == len(old) - done[t]["files_rewritten"] and all(now[f] == old[f] for f in same)
        assert done[t]["rows_read"] < store.read(t).count() / 8
    assert store.read("users").count() == 10_000 and store.read("orders").count() == 30_000 and store.read("items").count() == 59_994
    row = store.read("users").where("id = 5000").first()
    assert len(row["name"]) == 64 and row.age is None
    assert {r.note for r in store.read("orders").where("user_id = 5000").collect()} == {"[REDACTED]"}
    assert store.read("orders").where("note <> 'hello'").count() == 3


def test_an_erasure_is_what_whole_frames_give(spark, store):
    ids = list(range(0, 10_000, 977))
    frames = {t: store.read(t) for t in ("users", "orders", "items")}
    subjects = spark.createDataFrame([(i,) for i in ids], "id long")
    want = {t: sorted(map(tuple, df.collect()), key=str) for t, df in cascade.erase_batch(frames, [PLAN[0].__class__("users", None, primary_key=("id",), rules={"name": "HMAC"}), *PLAN[1:]], subjects, "id", "app", KEY).items()}
    shadow = cascade.shadow_counts(frames, PLAN, subjects, "id", "app", KEY)
    done = erased(spark, store, ids)
    assert [(r["target"], r["affected_rows"]) for r in shadow] == [(t, r["affected_rows"]) for t, r in done.items()]
    assert [r["rows_after"] for r in shadow] == [store.read(r["target"]).count() for r in shadow]
    got = {t: sorted(map(tuple, store.read(t).collect()), key=str) for t in want}
    ages = {r[0] for r in got["users"] if r[2] is None}
    assert ages == set(ids) and [r[:2] for r in got["users"]] == sorted([r[:2] for r in want["users"]], key=str)
    assert got["orders"] == want["orders"] and got["items"] == want["items"]


def test_nothing_to_erase_commits_nothing(spark, store):
    before = store.manifest()
    assert all(r["affected_rows"] == r["files_rewritten"] == 0 for r in erased(spark, store, [-1]).values())
    assert store.manifest() == before and store._latest() == 1


def test_a_crash_changes_nothing_and_is_forgotten(spark, store, monkeypatch):
    before = {t: contents(store, t) for t in ("users", "orders", "items")}
    fs = store._fs

    class Broken:
        def __getattr__(self, name):
            if name == "rename":
                raise OSError("crash")
            return getattr(fs, name)

    monkeypatch.setattr(store, "_fs", Broken())
    with pytest.raises(OSError):
        erased(spark, store, [7])
    again = tables.Versions(spark, store.root)
    assert {t: contents(again, t) for t in before} == before
    left = {str(p) for p in Path(store.root).rglob("part-*.parquet")}
    assert len(left) > sum(map(len, before.values()))
    for t in before:
        again.forget(t)
    assert {str(p) for p in Path(store.root).rglob("part-*.parquet")} == {f"{store.root}/{f}" for t in before.values() for f in t}
    assert erased(spark, again, [7])["users"]["affected_rows"] == 1


def test_forgetting_deletes_superseded_files_only(spark, store):
    old = set(store.files("orders"))
    erased(spark, store, [1, 9999])
    gone = old - set(store.files("orders"))
    store.forget("orders")
    assert gone and not any(Path(f"{store.root}/{f}").exists() for f in gone) and store.read("orders").count() == 30_000


def test_two_runs_over_the_same_files_and_changed_types_are_refused(spark, store):
    files = store.files("users")[:1]
    rows = store.read("users", files)
    with pytest.raises(ValueError):
        store.commit(changes={"users": tables.Change(rows.withColumn("age", F.lit("x")), files)})
    store.commit(changes={"users": tables.Change(rows, files)})
    with pytest.raises(RuntimeError):
        store.commit(changes={"users": tables.Change(rows, files)})
    with pytest.raises(ValueError):
        cascade.erase_files(store, [cascade.Target("users", None, primary_key=("id",), rules={"age": "HMAC"})], spark.createDataFrame([(1,)], "id long"), "id", "app", KEY)


def test_all_rows_of_a_table_and_satellites(spark, tmp_path):
    out = tables.Versions(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(i, f"r{i % 10}", "x") for i in range(200)], "id int, ref string, more string").repartitionByRange(10, "ref")
    out.commit({"a": rows, "b": rows, "none": rows.where("false")})
    roots = spark.createDataFrame([("r3",), (None,), ("r7",)], "ref string")
    done = cascade.erase_satellite_files(out, "a", "ref", roots, "ref", "app", KEY, rules={"more": "NULLIFY"})
    assert (done["affected_rows"], done["files_rewritten"]) == (40, 2) and out.read("a").where("length(ref) = 64 and more is null").count() == 40
    assert cascade.erase_satellite_files(out, "b", "ref", rows, "ref", "app", KEY, delete=True)["affected_rows"] == 200 and out.read("b").count() == 0
    assert cascade.erase_satellite_files(out, "b", "ref", roots, "ref", "app", KEY)["files_rewritten"] == 0
    assert cascade.erase_satellite_files(out, "none", "ref", roots, "ref", "app", KEY)["affected_rows"] == 0


def test_shredding_by_file(spark, tmp_path):
    now = F.to_timestamp(F.lit("2026-01-01"))
    rows = spark.range(100).select(F.format_string("h%03d", "id").alias("user_hash"), F.lit("secret").alias("encrypted_pii"), (now - F.make_dt_interval(F.when(F.col("id") == 42, 1).otherwise(-1))).alias("retention_expiry"), now.alias("notification_sent_at"), F.lit(None).cast("timestamp").alias("shredded_at"))
    out = tables.Versions(spark, str(tmp_path / "v"))
    out.commit({"vault": rows.repartitionByRange(10, "user_hash"), "keys": rows.select("user_hash", F.lit("k").alias("dek")).repartitionByRange(10, "user_hash")})
    before = {**contents(out, "keys"), **contents(out, "vault")}
    outcome = {r.user_hash: r.outcome for r in vault.shred_files(out, now).collect()}
    assert [h for h, o in outcome.items() if o == "shred"] == ["h042"] and len(outcome) == 100
    after = {**contents(out, "keys"), **contents(out, "vault")}
    assert len(set(before) & set(after)) == 18
    every = spark.read.parquet(*[str(p) for p in (tmp_path / "v/keys").rglob("part-*.parquet")])
    assert every.where("user_hash = 'h042'").isEmpty() and every.count() == 99
    assert out.read("vault").where("user_hash = 'h042'").first().encrypted_pii == vault.DESTROYED
    assert {r.outcome for r in vault.shred_files(out, now).where("user_hash = 'h042'").collect()} == {"already_shredded"}
