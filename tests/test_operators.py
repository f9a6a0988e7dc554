"""Operators on the small schemas of the fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lethe.operators import cascade, ledger, lifecycle, subjects, vault
from lethe.plans import graph
from lethe.sources import catalog, tables

KEY, KEK = b"\x24" * 32, b"\x42" * 32


def edges(spark, pairs):
    return spark.createDataFrame([(f"fk_{c}_{p}", c, ["k"], p, ["id"], "c" if c == "cascade_child" else "a") for c, p in pairs], "constraint_name string, child_table string, child_columns array<string>, parent_table string, parent_columns array<string>, delete_code string")


def test_graph(spark):
    e = edges(spark, [("orders", "users"), ("shipping", "orders"), ("logs", "shipping"), ("level_4", "logs"), ("level_5", "level_4"), ("profiles", "users"), ("circ_a", "circ_b"), ("circ_b", "circ_a"), ("cascade_child", "cascade_root")])
    depth = {r.table_name: r.depth for r in graph.fk_closure(e, "users").collect()}
    assert depth == {"users": 0, "orders": 1, "profiles": 1, "shipping": 2, "logs": 3, "level_4": 4, "level_5": 5}
    assert {r.table_name for r in graph.fk_closure(e, "circ_a").collect()} == {"circ_a", "circ_b"}
    assert graph.dependency_tree(e, "cascade_root").first().violation == "UNSAFE_DELETE_ACTION"
    assert {r.violation for r in graph.dependency_tree(e, "users", 3).collect()} == {None, "DEPTH_LIMIT"}


def test_cascade_redacts_and_deletes(spark):
    t = {
        "users": spark.createDataFrame([(1, "compiled@example.com", "Compiled User"), (2, "b@x", "B")], "id int, email string, full_name string"),
        "orders": spark.createDataFrame([(500, 1, None), (501, 2, None)], "id int, user_id int, amount decimal(18,2)"),
        "addresses": spark.createDataFrame([(1, 500, "221B Baker Street", "Mumbai"), (2, 501, "x", "y"), (3, None, "x", "y")], "id int, order_id int, street string, city string"),
        "devices": spark.createDataFrame([(7, 1, 1, "p"), (7, 1, 2, "q"), (8, 2, 1, "r")], "device_id int, user_id int, event_seq int, payload string"),
    }
    plan = [cascade.Target("users", None, primary_key=("id",), rules={"email": "HMAC", "full_name": "NULLIFY"}), cascade.Target("orders", "users", ("user_id",), ("id",), ("id",), action="keep"), cascade.Target("addresses", "orders", ("order_id",), ("id",), ("id",), rules={"street": "STATIC_MASK", "city": "STATIC_MASK"}), cascade.Target("devices", "users", ("user_id",), ("id",), ("device_id", "event_seq"), action="delete")]
    batch = spark.createDataFrame([(1,)], "id int")
    out = cascade.erase_batch(t, plan, batch, "id", "app", KEY)
    assert {(r.id, r.street, r.city) for r in out["addresses"].collect()} == {(1, "[REDACTED]", "[REDACTED]"), (2, "x", "y"), (3, "x", "y")}
    assert [tuple(r)[:3] for r in out["devices"].collect()] == [(8, 2, 1)]
    users = {r.id: r for r in out["users"].collect()}
    assert users[2].email == "b@x" and len(users[1].email) == 64 and users[1].full_name is None
    hits = cascade.cascade_rows(t, plan, batch, "id")
    assert {(r.target, r.affected_rows) for r in cascade.mutation_summary(hits, plan).collect()} == {("users", 1), ("orders", 1), ("addresses", 1), ("devices", 2)}
    with pytest.raises(ValueError):
        cascade.redact_target(t["orders"], hits["orders"], cascade.Target("orders", "users", primary_key=("id",), rules={"nothing": "HMAC"}), "app", KEY)


def test_satellites(spark):
    rows = spark.createDataFrame([(i, "legacy-user") for i in range(5)] + [(5, "other-user"), (6, None)], "id int, user_ref string")
    roots = spark.createDataFrame([("legacy-user",), (None,)], "user_ref string")
    out = cascade.satellite_redact(rows, "orders", "user_ref", roots, "user_ref", "app", KEY).collect()
    assert sum(len(r.user_ref or "") == 64 for r in out) == 5 and len(out) == 7
    assert cascade.satellite_rows(rows, "user_ref", roots, "user_ref").count() == 5


def test_purge_and_retention(spark):
    d = dt.datetime
    users = spark.createDataFrame([("usr_001", True, "deleted", d(2026, 1, 1)), ("usr_002", False, "active", None), ("usr_003", True, "deleted", d(2026, 1, 2)), ("usr_004", False, "closed", d(2026, 4, 1))], "id string, purge_eligible boolean, account_state string, disabled_at timestamp")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(subjects.purge_boolean(users, "id", "purge_eligible")) == ["usr_001", "usr_003"]
    assert ids(subjects.purge_enum(users, "id", "account_state", ["closed", "deleted"], 2)) == ["usr_001", "usr_003"]
    assert ids(subjects.purge_before(users, "id", "disabled_at", F.to_timestamp(F.lit("2026-03-01")))) == ["usr_001", "usr_003"]
    own = spark.createDataFrame([("usr_multi",)], "u string")
    rules = [subjects.Rule("RBI_KYC", 5, "kyc"), subjects.Rule("PMLA_FINANCIAL", 10, "tx")]
    got = subjects.retention_pick(spark.createDataFrame([("usr_multi",), ("other",)], "u string"), "u", rules, {"kyc": own, "tx": own}, 1)
    assert {tuple(r) for r in got.collect()} == {("usr_multi", 10, "PMLA_FINANCIAL"), ("other", 1, "DEFAULT")}


def entries(spark):
    return spark.createDataFrame([("c", 1, dt.datetime(2026, 1, 1), '{"a":1}', "k1"), ("c", 2, dt.datetime(2026, 1, 2), '{"a":2}', "k2"), ("c", 3, dt.datetime(2026, 1, 3), '{"a":3}', "k3"), ("d", 4, dt.datetime(2026, 1, 1), "{}", "k4")], "chain string, id long, created_at timestamp, payload string, key string")


def test_chains(spark):
    import hashlib

    built = ledger.chain_finalize(entries(spark))
    rows = {r.id: r for r in built.collect()}
    h1 = hashlib.sha256(b'GENESIS{"a":1}k1').hexdigest()
    assert rows[1].current_hash == h1 == rows[2].previous_hash
    assert rows[2].current_hash == hashlib.sha256((h1 + '{"a":2}k2').encode()).hexdigest()
    full = built.join(entries(spark), ["chain", "id"]).withColumnRenamed("id", "seq").withColumn("event_type", F.lit("X"))
    assert {(r.chain, r.checked, r.first_bad_seq, r.reason) for r in ledger.chain_verify(full).collect()} == {("c", 3, None, None), ("d", 1, None, None)}
    bad = full.withColumn("payload", F.when(F.col("seq") == 2, "{}").otherwise(F.col("payload")))
    got = {r.chain: r for r in ledger.chain_verify(bad).collect()}["c"]
    assert (got.checked, got.first_bad_seq, got.reason, got.head) == (2, 2, "current_hash_mismatch", h1)
    torn = full.withColumn("previous_hash", F.when(F.col("seq") == 3, "x").otherwise(F.col("previous_hash")))
    assert {r.reason for r in ledger.chain_verify(torn).collect()} == {None, "previous_hash_mismatch"}


def test_long_chain_and_window_of_one_key(spark):
    """60,000 rows of one key, which no array should gather; and rows without payload."""
    import hashlib

    n = 60_000
    rows = spark.range(n).select(F.lit("c").alias("chain"), F.timestamp_seconds("id").alias("created_at"), "id", F.lit("{}").alias("payload"), F.col("id").cast("string").alias("key"))
    built = ledger.chain_finalize(rows)
    assert "collect_list" not in built._jdf.queryExecution().toString()
    last = "GENESIS"
    for i in range(n):
        last = hashlib.sha256(f"{last}{{}}{i}".encode()).hexdigest()
    assert built.count() == n and built.where(f"id = {n - 1}").first().current_hash == last
    budget = lifecycle.fixed_window_budget(rows.select("chain", F.col("created_at").alias("ts")), "chain", 100, 3)
    assert "collect_list" not in budget._jdf.queryExecution().toString()
    assert budget.count() == n and budget.where("allowed").count() == n // 100 * 3
    gap = spark.createDataFrame([("c", 1, 1, "a", "k"), ("c", 2, 2, None, "k"), ("c", 3, 3, "b", "k")], "chain string, created_at int, id int, payload string, key string")
    got = {r.id: (r.previous_hash, r.current_hash) for r in ledger.chain_finalize(gap, spark.createDataFrame([("c", "tail")], "chain string, tail string")).collect()}
    first = hashlib.sha256(b"tailak").hexdigest()
    third = hashlib.sha256(f"{first}bk".encode()).hexdigest()  # goes on from the last good hash
    assert got == {1: ("tail", first), 2: (first, None), 3: (first, third)}


def test_shredding_leaves_no_key(spark, tmp_path):
    store = tables.Versions(spark, str(tmp_path / "store"))
    root = spark.createDataFrame([("1", "a@x", "A"), ("2", "b@x", None)], "id string, email string, full_name string")
    store.commit({"keys": vault.draw_keys(root, "id", "app", "users", KEY, KEK)})
    now = F.to_timestamp(F.lit("2026-01-01"))
    rows = vault.vault_rows(root, store.read("keys"), "id", ["email", "full_name"], KEY, KEK, now, F.lit(0))
    store.commit({"vault": rows.withColumn("notification_sent_at", F.when(F.col("user_hash").isNotNull(), now)).withColumn("shredded_at", F.lit(None).cast("timestamp"))})
    opened = vault.notice_payload(vault.open_vault(store.read("vault"), store.read("keys"), KEK))
    assert {(r.email, r.name) for r in opened.collect()} == {("a@x", "A"), ("b@x", "User")}
    one = store.read("keys").where("id = '1'").first()
    after, keys, outcome = vault.shred(store.read("vault").where(F.col("user_hash") == one.user_hash), store.read("keys"), now)
    assert [r.outcome for r in outcome.collect()] == ["shred"]
    assert after.first().encrypted_pii == vault.DESTROYED
    store.commit({"keys": keys})
    store.forget("keys")
    files = spark.read.parquet(str(tmp_path / "store/keys/*"))
    assert files.where(F.col("user_hash") == one.user_hash).count() == 0 and files.count() == 1
    assert {r.payload is None for r in vault.open_vault(store.read("vault"), store.read("keys"), KEK).collect()} == {True, False}


def test_transitions(spark):
    states = ["WAITING_COOLDOWN", "EXECUTING", "VAULTED", "NOTICE_SENT", "SHREDDED", "FAILED", "CANCELLED"]
    pairs = spark.createDataFrame([(s, e) for s in states for e in lifecycle.PREDECESSOR], "s string, e string")
    for r in pairs.select("s", "e", lifecycle.transition_code(F.col("s"), F.col("e")).alias("c")).collect():
        want = "API_OUTBOX_JOB_TERMINAL" if r.s in lifecycle.TERMINAL else None if lifecycle.PREDECESSOR[r.e] == r.s else "API_OUTBOX_EVENT_OUT_OF_ORDER"
        assert r.c == want


def test_versions_and_upsert(spark, tmp_path):
    store = tables.Versions(spark, str(tmp_path / "s"))
    assert store.manifest() == {}
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "done")], "k int, v int, t string")
    store.commit({"t": old})
    new = spark.createDataFrame([(1, 2, "b"), (2, 2, "c"), (3, 1, "d")], "k int, v int, t string")
    store.commit({"t": tables.upsert_latest(store.read("t"), new, ["k"], F.col("v"), F.col("t") == "done")})
    assert {tuple(r) for r in store.read("t").collect()} == {(1, 2, "b"), (2, 1, "done"), (3, 1, "d")}


def test_a_crash_before_the_switch_loses_nothing(spark, tmp_path, monkeypatch):
    """Readers follow the old manifest until the new one has its name."""
    store = tables.Versions(spark, str(tmp_path / "s"))
    store.commit({"t": spark.range(3), "u": spark.range(1)})
    before = store.manifest()

    class Broken:
        def __getattr__(self, name):
            if name == "rename":
                raise OSError("crash")
            return getattr(fs, name)

    fs = store._fs
    monkeypatch.setattr(store, "_fs", Broken())
    with pytest.raises(OSError):
        store.commit({"t": spark.range(5)})
    again = tables.Versions(spark, str(tmp_path / "s"))
    assert again.manifest() == before and again.read("t").count() == 3
    again.commit({"t": spark.range(7)})
    assert again.read("t").count() == 7 and again.read("u").count() == 1
    monkeypatch.setattr(again, "_latest", lambda: 1)  # a second writer that started from the first manifest
    with pytest.raises(RuntimeError):
        again.commit({"t": spark.range(9)})
    assert tables.Versions(spark, str(tmp_path / "s")).read("t").count() == 7


def test_samples_by_column(spark):
    rows = spark.createDataFrame([(i, None if i % 50 else f"v{i}", None, None if i < 995 else "late") for i in range(1000)], "a int, b string, c string, d string")
    for parts in (1, 4, 9):  # whatever the partitions
        got = sorted(map(tuple, catalog.column_sample(rows.repartition(parts), 20, 10, ["a"]).collect()))
        if parts > 1:
            assert got == before
        before = got
    by = {c: [v for x, v in got if x == c] for c in "abcd"}
    assert len(by["a"]) == 10 and 0 < len(by["b"]) <= 10 and not by["c"] and 0 < len(by["d"]) <= 5
    assert catalog.column_sample(rows, 100, 10).where("column_name = 'b'").count() == 10
    sparse = catalog.column_sample(rows, 0.01, 100, ["a"])  # a share without any value: all its non-null values count
    assert sparse.where("column_name = 'd'").count() == 5


def test_block_samples_read_a_part(spark, tmp_path):
    """One per cent of 200 row groups; a column that is null but for the last rows has samples."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lethe.sources import objects

    n = 200_000
    (tmp_path / "t").mkdir()
    for k in range(2):
        pq.write_table(pa.table({"id": range(k * n, k * n + n), "text": [f"{i:060d}" for i in range(n)], "late": pa.array([None] * (n - 3) + (["x"] * 3 if k else [None] * 3), pa.string())}), tmp_path / f"t/part-{k}.parquet", row_group_size=2000, compression="none")
    blocks = objects.chosen_blocks(str(tmp_path / "t"), 1)
    meta = {f: pq.ParquetFile(f).metadata for f, _ in blocks}
    read = sum(meta[f].row_group(g).total_byte_size for f, gs in blocks for g in gs)
    assert 0 < read < 0.05 * sum(f.stat().st_size for f in (tmp_path / "t").iterdir())
    rows = objects.register(spark).read.format("parquet_blocks").option("percent", 1).load(str(tmp_path / "t"))
    assert rows.count() == 2000 * sum(len(gs) for _, gs in blocks) and rows.columns == ["id", "text", "late"]
    got = {(r.column_name, r.n) for r in catalog.table_sample(spark, str(tmp_path / "t"), 1, 50, ["id"]).groupBy("column_name").agg(F.count("*").alias("n")).collect()}
    assert got == {("id", 50), ("text", 50), ("late", 3)}
    many = [(tmp_path / f"m{i:03d}.parquet") for i in range(300)]
    for f in many:
        pq.write_table(pa.table({"a": [1]}), f)
    some = objects.chosen_blocks(str(tmp_path / "m*.parquet"), 20)
    assert 30 < len(some) < 90 and all(gs is None for _, gs in some)
    assert spark.read.format("parquet_blocks").option("percent", 20).load(str(tmp_path / "m*.parquet")).count() == len(some)


def test_heads_of_objects(spark, tmp_path):
    import gzip

    (tmp_path / "a.json.gz").write_bytes(gzip.compress(b'{"k": 1}' * 1000))
    (tmp_path / "b.gz").write_bytes(b"\x1f\x8bbroken")
    (tmp_path / "c.csv").write_text("x,y" * 100)
    (tmp_path / "d").write_bytes(b"Obj\x01rest")
    (tmp_path / "e.txt").write_bytes(b"")
    with (tmp_path / "huge.txt").open("wb") as f:  # a gigabyte, with holes
        f.write(b"start")
        f.truncate(1 << 30)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.format, r.content_type, r.scanned, r.prefix, r.warning) for r in catalog.object_sample(spark, str(tmp_path), 8).collect()}
    assert got["a.json.gz"][1:] == ("gzip", "application/json", False, None, "UNREADABLE_GZIP") or got["a.json.gz"][3]
    assert got["b.gz"][1:] == ("gzip", "application/gzip", False, None, "UNREADABLE_GZIP") and got["c.csv"] == (300, "text", "text/csv", True, "x,yx,yx,", None)
    assert got["d"][1:] == ("avro", "application/avro", False, None, "COLUMNAR_NOT_SCANNED") and got["e.txt"] == (0, "text", "text/plain", True, "", None)
    assert got["huge.txt"] == (1 << 30, "text", "text/plain", True, "start\0\0\0", None)
    (full,) = catalog.object_sample(spark, str(tmp_path / "a.json.gz"), 100).collect()
    assert full.prefix == ('{"k": 1}' * 13)[:100] and full.scanned


def test_verification_over_ranges(spark, monkeypatch):
    """Chains of several ranges, with a fault in each place in turn."""
    monkeypatch.setattr(ledger, "RANGE", 8)
    rows = spark.createDataFrame([(c, i, i, "{}", f"k{i}") for c in range(6) for i in range(c, 40 + c, 1 + c)], "chain int, created_at int, id int, payload string, key string")
    good = ledger.chain_finalize(rows).join(rows, ["chain", "id"]).withColumn("seq", F.col("id").cast("long")).withColumn("event_type", F.lit("E"))
    assert {(r.chain, r.checked, r.first_bad_seq) for r in ledger.chain_verify(good).collect()} == {(c, len(range(c, 40 + c, 1 + c)), None) for c in range(6)}
    for at in (0, 7, 8, 17, 39):
        bad = good.withColumn("previous_hash", F.when((F.col("chain") == 0) & (F.col("seq") == at), "x").otherwise(F.col("previous_hash")))
        r = ledger.chain_verify(bad).where("chain = 0").first()
        head = good.where(f"chain = 0 and seq = {at - 1}").first()
        assert (r.checked, r.first_bad_seq, r.reason, r["head"]) == (at + 1, at, "previous_hash_mismatch", head.current_hash if head else None)
        pending = bad.withColumn("next_attempt_at", F.lit(0))
        none = spark.createDataFrame([], "chain int, last_hash string")
        run = ledger.contiguous_batch(pending, none, F.lit(1)).where("chain = 0")
        assert {x.seq for x in run.collect()} == set(range(at)) and ledger.contiguous_batch(pending, none, F.lit(1), 12).where("chain = 0").count() == min(at, 12)


def test_fingerprint_and_sample(spark, tmp_path):
    t = {"a": spark.createDataFrame([(1,)], "bc int")}
    c = catalog.catalog_scan(spark, t)
    one, two = catalog.schema_fingerprint(c).first()[0], catalog.schema_fingerprint(c, True).first()[0]
    assert one != two and catalog.schema_drift(c, one).first().quarantined is False
    with pytest.raises(ValueError):
        catalog.column_sample(t["a"], 0)
    assert catalog.column_sample(t["a"], 1, 5).count() == 1
    (tmp_path / "x.bin").write_bytes(b"PAR1rest")
    (tmp_path / "y.txt").write_text("text")
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.scanned, r.prefix) for r in catalog.object_sample(spark, str(tmp_path)).collect()}
    assert got == {"x.bin": ("parquet", False, None), "y.txt": ("text", True, "text")}


def test_json_leaves(spark):
    from lethe.operators.discovery import json_leaves

    deep = "1"
    for _ in range(11):
        deep = f'{{"d":{deep}}}'
    rows = spark.createDataFrame([(1, '{"a":[1,{"b":"x"}],"n":null}'), (2, "no json"), (3, None), (4, deep)], "id int, j string")
    assert {tuple(r) for r in json_leaves(rows, ["id"], "j").collect()} == {(1, ".a[0]", "1"), (1, ".a[1].b", "x"), (2, "", "no json")}


def test_subtrees_end_at_cycles_and_depth(spark):
    from lethe.plans.graph import subtree

    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (4, 3), (4, 2), (5, 5), (6, None), (8, 7)], "child int, parent int")
    got = lambda *roots, **more: {tuple(r) for r in subtree(edges, spark.createDataFrame([(r,) for r in roots], "node int"), **more).collect()}
    assert got(1) == {(1, 0), (2, 1), (3, 2), (4, 2)}
    assert got(3, 5, 9) == {(3, 0), (5, 0), (9, 0), (1, 1), (4, 1), (2, 2)}
    assert got(1, max_depth=1) == {(1, 0), (2, 1)} and got() == set()
    chain = spark.range(40).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"))
    assert subtree(chain, spark.range(1).select(F.col("id").alias("node"))).count() == 33


def test_a_missing_root_and_strict_trees(spark):
    from lethe.plans.graph import dependency_tree

    edges = spark.createDataFrame([("k", "orders", "users", ["u"], ["id"], "c")], "constraint_name string, child_table string, parent_table string, child_columns array<string>, parent_columns array<string>, delete_code string")
    tables = spark.createDataFrame([("users",), ("orders",)], "table_name string")
    assert [r.violation for r in dependency_tree(edges, "nobody", tables=tables).collect()] == ["ROOT_MISSING"]
    assert [r.violation for r in dependency_tree(edges, "users", tables=tables).collect()] == ["UNSAFE_DELETE_ACTION"]
    with pytest.raises(Exception, match="UNSAFE_DELETE_ACTION orders"):
        dependency_tree(edges, "users", strict=True).collect()


def test_burn_in(spark):
    tasks = spark.createDataFrame([(c, t, t * 10 + k, True, "VAULT", "COMPLETED") for c in (1, 2) for t in range(c * 4) for k in (0, 1)], "client_id int, task_id int, completed_at int, shadow boolean, task_type string, status string")
    assert {tuple(r) for r in lifecycle.burn_in(tasks, 5).collect()} == {(1, 4, False, None), (2, 8, True, 40)}


def test_markers_are_found_letter_for_letter(spark):
    rows = spark.createDataFrame([(1, "call +919876543210 now"), (2, "aXb@c.de"), (3, "x a.b@c.de, Customer#01 Customer#012"), (4, None), (5, ""), (6, "+91")], "id int, payload string")
    assert [r.id for r in ledger.leak_scan(rows, ["+919876543210", "a.b@c.de"]).orderBy("id").collect()] == [1, 3]
    assert [r.id for r in ledger.leak_scan(rows, patterns=["[+]91$"]).collect()] == [6] and ledger.leak_scan(rows).count() == 0
    markers = spark.createDataFrame([(m,) for m in ("+919876543210", "a.b@c.de", "Customer#01", "Customer#012", "Customer#0123", "", None, "none of these")], "marker string")
    want = {(1, "+919876543210"), (3, "a.b@c.de"), (3, "Customer#01"), (3, "Customer#012")}
    for bound in (1 << 20, 150):  # one index, and slices
        found = ledger.leak_matches(rows, markers, ["id"], bound).collect()
        assert {tuple(r) for r in found} == want and len(found) == 4
    many = spark.range(100_000).select(F.concat(F.lit("m-"), F.col("id").cast("string"), F.lit(";")).alias("marker"))
    text = spark.createDataFrame([(1, "m-5; m-99999; m-100000; m-7")], "id int, payload string")
    assert {r.marker for r in ledger.leak_matches(text, many, ["id"]).collect()} == {"m-5;", "m-99999;"}


def test_reports_are_listed_in_the_root_collation(spark):
    from lethe.operators.report import by_names, findings_order, in_order, targets_order

    names = spark.createDataFrame([(n,) for n in ("B", "b", "aB", "a1", "a_b", "a", None, "ä", "z")], "n string")
    assert [r.n for r in names.orderBy(*by_names("n")).collect()] == [None, "a", "ä", "a_b", "a1", "aB", "b", "B", "z"]
    found = spark.createDataFrame([("s", "t", "b", 0.9), ("s", "t", "a_b", 0.9), ("s", "t", "a", None), ("s", "T", "z", 1.0), ("s", "t", "a1", 0.9), ("s", "t", "a1", 0.9)], "schema string, table_name string, column_name string, confidence double")
    placed = in_order(found, findings_order(), ["schema"])
    assert [r.column_name for r in placed.orderBy("position").collect()] == ["z", "a_b", "a1", "a1", "b", "a"]
    plan = spark.createDataFrame([("r", 0), ("order_lines", 2), ("Orders", 1), ("order2", 2)], "table_name string, depth int")
    assert [r.table_name for r in plan.orderBy(*targets_order()).collect()] == ["r", "Orders", "order_lines", "order2"]
    assert [r.table_name for r in plan.orderBy(*targets_order(deepest_first=True)).collect()] == ["order_lines", "order2", "Orders", "r"]
    assert in_order(plan.limit(0), targets_order(), []).count() == 0
