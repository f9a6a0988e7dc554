"""Streams give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from lethe.operators import lifecycle
from lethe.streaming import streams


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


def streamed(spark, df, folder, parts):
    path = str(folder / "in")
    df.repartition(1).sortWithinPartitions(df.columns[0]).write.parquet(path) if parts == 1 else [df.where(F.col(df.columns[0]) % parts == i).coalesce(1).write.mode("append").parquet(path) for i in range(parts)]
    return spark.readStream.schema(df.schema).parquet(path)


def run(stream, mode, folder, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_job_state(spark, events, tmp_path):
    jobs = events.select("user_id", F.col("event_id").alias("seq"), F.concat(F.lit("rule "), (F.col("event_id") % 3).cast("string")).alias("rule"), (F.col("ts") + F.make_dt_interval(F.lit(5))).alias("notice_due"), (F.col("ts") + F.make_dt_interval(F.lit(7))).alias("shred_due"), F.col("ts").alias("at"), F.when(F.col("event_type") == "view", "USER_VAULTED").when(F.col("event_type") == "click", "NOTIFICATION_SENT").otherwise("SHRED_SUCCESS").alias("event_type")).withColumnRenamed("user_id", "job_id")
    got = run(streams.job_state_stream(streamed(spark, jobs, tmp_path, 1)), "update", tmp_path, "states")
    want = {r.job_id: r.asDict() for r in lifecycle.job_state_fold(jobs).collect()}
    assert {r.job_id: r.asDict() for r in got.collect()} == want


def test_budget(spark, events, tmp_path):
    asked = events.select(F.col("user_id").alias("key"), "ts")
    got = run(streams.budget_stream(streamed(spark, asked, tmp_path, 1), 6 * 3600, 3), "append", tmp_path, "budget")
    want = lifecycle.fixed_window_budget(asked, "key", 6 * 3600, 3)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_replay_guard(spark, events, tmp_path):
    asked = events.select(F.lit("c").alias("client_id"), F.col("event_type").alias("signature"), F.to_timestamp(F.lit("2024-01-01")).alias("received_at"))
    got = run(streams.replay_guard(streamed(spark, asked, tmp_path, 1)), "append", tmp_path, "guard")
    assert got.count() == events.select("event_type").distinct().count()


def test_append_batches(spark, events, tmp_path):
    rows = events.select("user_id", "event_type")
    for k in range(2):  # a second run over the same rows adds nothing
        (tmp_path / f"s{k}").mkdir()
        streams.append_batches(streamed(spark, rows, tmp_path / f"s{k}", 3), str(tmp_path / "out"), ["user_id", "event_type"], str(tmp_path / f"cp{k}")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == rows.distinct().count() == out.distinct().count()


def test_ingest_requests(spark, events, tmp_path):
    """Each key once, although every request is sent three times; mapped to its subject."""
    from lethe.operators import ingest

    body = F.concat(F.lit('{"request_id":"r'), F.col("event_id").cast("string"), F.lit('","subject":"u'), F.col("user_id").cast("string"), F.lit('"}'))
    sent = events.select("event_id", F.lit("generic").alias("provider"), body.alias("body"), F.to_timestamp(F.lit("2024-01-01")).alias("received_at"))
    mapping = ingest.parsed(sent).where("event_id % 2 = 0").select("provider", "subject_hash", F.concat(F.lit("o-"), "subject_key").alias("subject_opaque_id")).distinct()
    got = run(streams.ingest_requests(streamed(spark, sent.unionAll(sent).unionAll(sent), tmp_path, 3), mapping), "append", tmp_path, "requests")
    want = ingest.mapped(ingest.parsed(sent), mapping).select("idempotency_key", "subject_opaque_id", "code")
    assert sorted(map(str, got.select("idempotency_key", "subject_opaque_id", "code").collect())) == sorted(map(str, want.collect()))


def test_ledger_ingest_by_batches(spark, events, tmp_path):
    """Entries in three micro-batches give the ledger that one chain over all would have;
    what is sent again is a replay."""
    from lethe.operators import ledger

    rows = events.where("user_id < 3").select(F.col("user_id").alias("chain"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.lit("{}").alias("payload"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"))
    sent = rows.withColumn("created_at", F.timestamp_seconds(F.col("id") % 3 * 1_000_000 + F.col("id"))).withColumn("previous_hash", F.lit("w"))
    sent = sent.withColumn("current_hash", ledger.link_hash(F.col("previous_hash"), F.col("payload"), F.col("key")))
    stored, refused = str(tmp_path / "ledger"), str(tmp_path / "refused")
    empty = "chain long, seq long, id long, payload string, key string, event_type string, previous_hash string, current_hash string"
    spark.createDataFrame([], empty).write.parquet(stored)

    def put(batch, number):
        accepted, rejects = streams.ledger_ingest(batch, spark.read.schema(empty).parquet(stored))
        place = F.unix_seconds("created_at").alias("seq")
        accepted = accepted.select("chain", place, "id", "payload", "key", F.lit("DONE").alias("event_type"), "previous_hash", "current_hash")
        rejects.withColumn("number", F.lit(number)).write.mode("append").parquet(refused)
        accepted.write.mode("append").parquet(stored)

    for again in range(2):
        (tmp_path / f"s{again}").mkdir()
        stream = streamed(spark, sent.select("id", *[c for c in sent.columns if c != "id"]), tmp_path / f"s{again}", 3)
        stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / f"cp{again}")).option("maxFilesPerTrigger", 1).trigger(availableNow=True).start().awaitTermination()
    got = {(r.chain, r.id): r.current_hash for r in spark.read.schema(empty).parquet(stored).collect()}
    assert len(got) == rows.count() == spark.read.parquet(refused).where("code = 'REPLAY'").count()
    # batches come in the order of their files, entries within one by time: heads link on without a gap
    kept = spark.read.schema(empty).parquet(stored)
    heads = kept.join(kept.select("chain", F.col("previous_hash").alias("current_hash")), ["chain", "current_hash"], "left_anti")
    assert heads.count() == kept.select("chain").distinct().count() and kept.where(F.col("previous_hash") == ledger.GENESIS).count() == heads.count()
    assert kept.select("chain", "previous_hash").distinct().count() == kept.count()
    assert kept.where(F.col("current_hash") != ledger.link_hash(F.col("previous_hash"), F.col("payload"), F.col("key"))).isEmpty()


def by_batches(stream, mode, folder, **trigger):
    """The rows of an ``availableNow`` run (or with another trigger), and the query."""
    out = []
    query = stream.writeStream.foreachBatch(lambda df, n: out.append(df.collect())).outputMode(mode).option("checkpointLocation", str(folder)).trigger(**(trigger or {"availableNow": True})).start()
    assert query.awaitTermination(120)
    return [r for rows in out for r in rows], query


def held(query):
    return next(p["stateOperators"][0]["numRowsTotal"] for p in reversed(query.recentProgress) if p["stateOperators"])


def test_jobs_that_are_over_are_forgotten(spark, tmp_path):
    schema = "job_id long, seq long, event_type string"
    into = tmp_path / "in"
    into.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(into))
    spark.createDataFrame([(j, 1, "USER_HARD_DELETED") for j in range(50)] + [(99, 1, "USER_VAULTED")], schema).write.mode("append").parquet(str(into))
    _, first = by_batches(streams.job_state_stream(stream, keep_ms=1), "update", tmp_path / "cp", once=True)
    spark.createDataFrame([(99, 2, "NOTIFICATION_SENT")], schema).write.mode("append").parquet(str(into))
    rows, second = by_batches(streams.job_state_stream(stream, keep_ms=1), "update", tmp_path / "cp", once=True)
    assert [(r.job_id, r.status) for r in rows] == [(99, "NOTICE_SENT")] and held(first) > 50 and held(second) < 5


def test_windows_end_with_the_watermark(spark, tmp_path):
    schema = "key long, ts timestamp"
    into = tmp_path / "in"
    into.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(into))
    rows = spark.range(200).select(F.col("id").alias("key"), F.timestamp_seconds(F.lit(1000)).alias("ts"))
    rows.unionAll(spark.createDataFrame([(5, None), (5, None)], schema)).write.mode("append").parquet(str(into))
    got, first = by_batches(streams.budget_stream(stream, 60, 1, "1 minute"), "append", tmp_path / "cp")
    assert len(got) == 202 and sorted(r.reset_at is None for r in got)[-2:] == [True, True] and all(r.allowed for r in got)
    for t in (100_000, 200_000):  # time goes on, with one key
        spark.createDataFrame([(7,)], "key long").select("key", F.timestamp_seconds(F.lit(t)).alias("ts")).write.mode("append").parquet(str(into))
        got, last = by_batches(streams.budget_stream(stream, 60, 1, "1 minute"), "append", tmp_path / "cp")
    assert held(first) >= 200 and held(last) < 10 and [r.allowed for r in got] == [True]


def test_due_tasks_by_timers(spark, tmp_path):
    """What is due at once is what the batch operator gives; what is due later comes at its
    time; each once, over restarts."""
    import time

    now = F.to_timestamp(F.lit("2030-01-01"))
    jobs = spark.range(300).select(F.col("id").alias("job_id"), F.lit(1).cast("long").alias("seq"), (F.col("id") % 3).cast("string").alias("client_id"), F.get(F.array(*map(F.lit, ("VAULTED", "NOTICE_SENT", "EXECUTING", "SHREDDED"))), (F.col("id") % 4).cast("int")).alias("status"), F.timestamp_seconds(F.when(F.col("id") % 5 == 0, 4_000_000_000).otherwise(F.col("id") * 1000)).alias("notification_due_at"), F.timestamp_seconds(F.col("id") * 2000).alias("shred_due_at"))
    into = tmp_path / "in"
    jobs.repartition(3).write.parquet(str(into))
    stream = spark.readStream.schema(jobs.schema).parquet(str(into))
    got, _ = by_batches(streams.due_stream(stream), "append", tmp_path / "cp", once=True)
    want = lifecycle.materialize_due(jobs, spark.createDataFrame([], "job_id long, task_type string"), now)
    assert sorted((r.job_id, r.client_id, r.task_type, r.due_at) for r in got) == sorted((r.job_id, r.client_id, r.task_type, r.due_at) for r in want.collect())
    soon = F.timestamp_millis(F.lit(int(time.time() * 1000) + 15_000))
    more = jobs.where("job_id in (20, 40)").withColumn("seq", F.lit(2).cast("long")).withColumn("notification_due_at", soon)
    more.unionByName(jobs.where("job_id = 4").withColumn("seq", F.lit(2).cast("long"))).write.mode("append").parquet(str(into))
    got, _ = by_batches(streams.due_stream(stream), "append", tmp_path / "cp", once=True)
    assert got == []  # 4 was emitted before, the others are not due yet
    jobs.where("job_id = 40").withColumn("seq", F.lit(3).cast("long")).withColumn("status", F.lit("CANCELLED")).write.mode("append").parquet(str(into))
    time.sleep(16)
    got, _ = by_batches(streams.due_stream(stream), "append", tmp_path / "cp", once=True)
    assert [(r.job_id, r.task_type) for r in got] == [(20, "NOTIFY")]


def test_failed_tasks_come_again_or_die(spark, tmp_path):
    schema = "job_id long, seq long, client_id string, status string, notification_due_at timestamp, shred_due_at timestamp, task_type string, ack string, retryable boolean"
    import datetime

    old = datetime.datetime(2020, 1, 1)
    rows = [(j, 1, "c", "VAULTED", old, old, None, None, None) for j in (1, 2, 3)]
    rows += [(1, 2, None, None, None, None, "NOTIFY", "failed", True), (2, 2, None, None, None, None, "NOTIFY", "failed", False), (3, 2, None, None, None, None, "NOTIFY", "completed", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got, _ = by_batches(streams.due_stream(stream, base_ms=1), "append", tmp_path / "cp", once=True)
    assert sorted((r.job_id, r.attempts, r.status) for r in got)[:4] == [(1, 0, "DISPATCHED"), (2, 0, "DISPATCHED"), (2, 1, "DEAD_LETTER"), (3, 0, "DISPATCHED")]
    spark.createDataFrame([(1, 3, None, None, None, None, "NOTIFY", "failed", True), (9, 1, None, "EXECUTING", None, None, None, None, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again, _ = by_batches(streams.due_stream(stream, most=2, base_ms=1), "append", tmp_path / "cp", once=True)
    tries = sorted((r.attempts, r.status) for r in [*got, *again] if r.job_id == 1)
    assert tries[0] == (0, "DISPATCHED") and (1, "DISPATCHED") in tries or (2, "DEAD_LETTER") in tries


# --- the intake of a ledger


def sequential(entries, stored):
    """One entry after the other, as a server would take them."""
    import hashlib

    heads, keys, jobs, out = {}, {}, {}, []
    for c, _, key, payload, current in stored:
        heads[c], keys[c, key] = current, ("USER_VAULTED", payload)
    for c, _, i, payload, key, previous, current, event, job, status in entries:
        h = lambda p: hashlib.sha256(f"{p}{payload}{key}".encode()).hexdigest()  # noqa: B023, E731
        if payload is None or key is None:
            out.append((c, i, "INCOMPLETE", None, None))
        elif (c, key) in keys:
            out.append((c, i, "REPLAY" if keys[c, key] == (event, payload) else "CONFLICT", None, None))
        elif (state := jobs.get((c, job), status)) in lifecycle.TERMINAL:
            out.append((c, i, "TERMINAL", None, None))
        elif lifecycle.PREDECESSOR.get(event) != state:
            out.append((c, i, "OUT_OF_ORDER", None, None))
        elif previous is None or current != h(previous):
            out.append((c, i, "BAD_HASH", None, None))
        else:
            before = heads.get(c, "GENESIS")
            heads[c], keys[c, key], jobs[c, job] = h(before), (event, payload), lifecycle.LEADS_TO[event]
            out.append((c, i, None, before, heads[c]))
    return out


ENTRY = "chain long, created_at long, id long, payload string, key string, previous_hash string, current_hash string, event_type string, job_id string, status string"
STORED = "chain long, seq long, key string, payload string, current_hash string, event_type string"


@pytest.fixture(scope="module")
def entries():
    """Entries with repeated keys, several events of a job, wrong hashes and nulls."""
    import hashlib
    import random

    rng = random.Random(4)
    stored = [(c, n, f"s{n}", "{}", hashlib.sha256(f"{c}{n}".encode()).hexdigest()) for c in range(4) for n in range(3)]
    out = []
    for i in range(600):
        c, job = rng.randrange(6), rng.randrange(25)
        event = rng.choice(list(lifecycle.PREDECESSOR))
        key = None if rng.random() < 0.02 else rng.choice([f"s{rng.randrange(4)}", f"k{rng.randrange(300)}"])
        payload = rng.choice(["{}", '{"a":1}', None if rng.random() < 0.1 else "{}"])
        previous = rng.choice(["GENESIS", "w", None if rng.random() < 0.1 else "x"])
        right = hashlib.sha256(f"{previous}{payload}{key}".encode()).hexdigest()
        out.append((c, i // 2, i, payload, key, previous, right if rng.random() < 0.9 else "bad", event, f"{c}-{job}", "CANCELLED" if job == 7 else "EXECUTING"))
    return out, stored


def test_intake_is_the_sequential_one(spark, entries):
    from lethe.operators import ledger

    rows, stored = entries
    held = spark.createDataFrame([(c, n, k, p, h, "USER_VAULTED") for c, n, k, p, h in stored], STORED).withColumn("chain", F.col("chain"))
    batch = spark.createDataFrame(rows, ENTRY)
    want = sequential(rows, stored)
    assert {c for _, _, c, *_ in want} == {None, "REPLAY", "CONFLICT", "TERMINAL", "OUT_OF_ORDER", "BAD_HASH", "INCOMPLETE"}
    got = ledger.take_in(batch, held).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])


def test_intake_of_the_judge(spark):
    from lethe.operators import ledger

    h = lambda p, k: __import__("hashlib").sha256(f"w{p}{k}".encode()).hexdigest()
    rows = [(1, t, t, p, k, "w", h(p, k), e, "j", "EXECUTING") for t, (p, k, e) in enumerate([("{}", "k1", "USER_VAULTED"), ("{}", "k1", "USER_VAULTED"), ('{"x":1}', "k1", "USER_VAULTED"), ("{}", "k2", "NOTIFICATION_SENT"), ("{}", "k3", "USER_VAULTED")])]
    got = ledger.take_in(spark.createDataFrame(rows, ENTRY), spark.createDataFrame([], STORED)).orderBy("id").collect()
    assert [r.code for r in got] == [None, "REPLAY", "CONFLICT", None, "OUT_OF_ORDER"]


@pytest.mark.parametrize("parts", [1, 4])
def test_intake_as_a_stream(spark, entries, tmp_path, parts):
    rows, stored = entries
    held = spark.createDataFrame([(c, n, k, p, h, "USER_VAULTED") for c, n, k, p, h in stored], STORED)
    into = tmp_path / "in"
    into.mkdir()
    stream, got = spark.readStream.schema(ENTRY).parquet(str(into)), []
    for k in range(parts):  # each part in a run of its own: state lives on in the checkpoint
        spark.createDataFrame(rows[k * 600 // parts : (k + 1) * 600 // parts], ENTRY).coalesce(1).write.mode("append").parquet(str(into))
        got += by_batches(streams.ledger_stream(stream, held), "append", tmp_path / "cp")[0]
    assert sorted(((r.chain, r.id, r.code, r.previous_hash, r.current_hash) for r in got), key=lambda r: r[1]) == sequential(rows, stored)


def test_a_stream_without_a_ledger_and_keys_that_expire(spark, tmp_path):
    import time

    h = __import__("hashlib").sha256(b"w{}k").hexdigest()
    row = spark.createDataFrame([(1, 1, 1, "{}", "k", "w", h)], ", ".join(ENTRY.split(", ")[:7]))
    into, codes = tmp_path / "in", []
    into.mkdir()
    stream = spark.readStream.schema(row.schema).parquet(str(into))
    for wait in (0, 0, 3):
        time.sleep(wait)
        row.write.mode("append").parquet(str(into))
        codes += [r.code for r in by_batches(streams.ledger_stream(stream, ttl_ms=2000 if wait else 600_000), "append", tmp_path / ("cp" if not wait else "cp2"), once=True)[0]]
    assert codes[:2] == [None, "REPLAY"]
