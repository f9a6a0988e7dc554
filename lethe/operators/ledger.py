"""Hash chains: build, take in, verify, export, search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.crypto import sha256_hex
from .lifecycle import LEADS_TO, PREDECESSOR, TERMINAL

GENESIS = "GENESIS"


def link_hash(previous: Column, payload: Column, key: Column) -> Column:
    """The hash of an entry: over the previous hash, its canonical payload and its key."""
    return sha256_hex(F.concat(previous, payload, key))


def entry_hash(previous: str, payload: str, key: str) -> str:
    """``link_hash`` of one entry."""
    return hashlib.sha256(f"{previous}{payload}{key}".encode()).hexdigest()


def _hash_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash rows that come sorted by chain and order; only the last hash is held. A
    row without payload or key gets no hash, and the next goes on from the one before."""
    chain, last = object(), None
    for rows in batches:
        before, now = [], []
        for c, tail, payload, key in zip(*(rows.column(k).to_pylist() for k in ("chain", "tail", "payload", "key")), strict=True):
            if c != chain:
                chain, last = c, tail
            before.append(last)
            if payload is None or key is None:
                now.append(None)
                continue
            last = entry_hash(last, payload, key)
            now.append(last)
        yield pa.RecordBatch.from_arrays([rows.column("chain"), rows.column("id"), pa.array(before, pa.string()), pa.array(now, pa.string())], names=["chain", "id", "previous_hash", "current_hash"])


def chain_finalize(pending: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """Hashes of pending entries (chain, created_at, id, payload, key) in order,
    from each chain's tail or GENESIS. A chain is sequential by nature, but of any
    length: its rows are sorted in one partition (with spill) and hashed as they
    stream by, none gathered in a row."""
    rows = pending.select("chain", "created_at", F.col("id").cast("long").alias("id"), "payload", "key")
    rows = rows.join(tails.select("chain", "tail"), "chain", "left").withColumn("tail", F.coalesce("tail", F.lit(GENESIS))) if tails is not None else rows.withColumn("tail", F.lit(GENESIS))
    ordered = rows.repartition("chain").sortWithinPartitions("chain", "created_at", "id", "payload", "key").select("chain", "id", "tail", "payload", "key")
    kinds = StructType([ordered.schema["chain"], *(StructField(n, t) for n, t in (("id", LongType()), ("previous_hash", StringType()), ("current_hash", StringType())))])
    return ordered.mapInArrow(_hash_on, kinds)


def chain_head(ledger: DataFrame) -> DataFrame:
    """The last hash of each chain, heartbeats aside."""
    return ledger.where("event_type <> 'HEARTBEAT'").groupBy("chain").agg(F.max_by("current_hash", "seq").alias("head"))


#: Sequence numbers that a range of a chain spans.
RANGE = 1 << 16


def _ranged(rows: DataFrame) -> DataFrame:
    """Rows dealt by chain and range of sequence numbers, so that no task holds a whole
    chain."""
    return rows.withColumn("range", F.floor(F.col("seq") / RANGE)).repartition("chain", "range")


def _before(rows: DataFrame, beat: Column, first: Column | None = None) -> Column:
    """For rows dealt by ranges and joined with ``tail`` (``_tails``): the hash before."""
    inside = F.lag("current_hash").over(Window.partitionBy("chain", "range", beat).orderBy("seq"))
    return F.coalesce(inside, F.col("tail"), *([first] if first is not None else []), F.lit(GENESIS))


def _tails(rows: DataFrame) -> DataFrame:
    """chain, range and the last hash of the ranges before: one row for each range."""
    ends = rows.groupBy("chain", "range").agg(F.max_by("current_hash", "seq").alias("end"))
    return ends.withColumn("tail", F.lag("end").over(Window.partitionBy("chain").orderBy("range"))).drop("end")


def chain_verify(ledger: DataFrame) -> DataFrame:
    """For each chain: rows checked (up to and with the first violation), the first
    violation's sequence and reason, and the last valid hash before it.

    Ranges of a chain are verified in parallel, each from the last hash of the range
    before, and then summed up: a row for each range goes to the chain's task."""
    beat = F.col("event_type") == "HEARTBEAT"
    dealt = _ranged(ledger)
    rows = dealt.join(_tails(dealt.where(~beat)), ["chain", "range"], "left")
    before = _before(rows, beat)
    wrong = (
        F.when(beat & (F.col("previous_hash") != F.col("current_hash")), "heartbeat_mismatch")
        .when(~beat & (F.col("previous_hash") != before), "previous_hash_mismatch")
        .when(~beat & (F.col("current_hash") != link_hash(F.col("previous_hash"), F.col("payload"), F.col("key"))), "current_hash_mismatch")
    )
    rows = rows.withColumn("reason", wrong)
    first = F.min(F.when(F.col("reason").isNotNull(), F.col("seq"))).over(Window.partitionBy("chain", "range"))
    rows = rows.withColumn("first", first).where("first is null or seq <= first")
    good = ~beat & F.col("reason").isNull()
    parts = rows.groupBy("chain", "range").agg(F.count("*").alias("checked"), F.min("first").alias("first"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("seq"))).alias("reason"), F.max_by("current_hash", F.when(good, F.col("seq"))).alias("head"))
    bad = F.min(F.when(F.col("first").isNotNull(), F.col("range"))).over(Window.partitionBy("chain"))
    parts = parts.withColumn("bad", bad).where("bad is null or range <= bad")
    return parts.groupBy("chain").agg(F.sum("checked").alias("checked"), F.min("first").alias("first_bad_seq"), F.max("reason").alias("reason"), F.max_by("head", F.when(F.col("head").isNotNull(), F.col("range"))).alias("head"))


def contiguous_batch(pending: DataFrame, last: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """From each chain's last delivered hash, the longest run of entries that link on
    and are due. Ranges of a chain are compared in parallel; where the run ends, and how
    many rows come before each range, is found from a row for each range."""
    dealt = _ranged(pending)
    rows = dealt.join(_tails(dealt), ["chain", "range"], "left")
    rows = rows.join(last.select("chain", "last_hash"), "chain", "left")
    before = _before(rows, F.lit(False), F.col("last_hash"))
    fits = (F.col("previous_hash") == before) & (F.col("next_attempt_at") <= now)
    rows = rows.withColumn("_stop", F.when(~F.coalesce(fits, F.lit(False)), F.col("seq")))
    ranges = rows.groupBy("chain", "range").agg(F.min("_stop").alias("stop"), F.count("*").alias("n"))
    chain = Window.partitionBy("chain")
    upto = F.sum("n").over(chain.orderBy("range")) - F.col("n")
    ranges = ranges.select("chain", "range", F.min("stop").over(chain).alias("stop"), upto.alias("upto"))
    out = rows.drop("_stop").join(ranges, ["chain", "range"]).where("stop is null or seq < stop")
    if limit:
        n = F.row_number().over(Window.partitionBy("chain", "range").orderBy("seq")) + F.col("upto")
        out = out.withColumn("_n", n).where(F.col("_n") <= limit)
    return out.select(*pending.columns)


def ledger_export(ledger: DataFrame, chain=None, after_seq: int | None = None) -> DataFrame:
    """Rows in order, of one chain and after a sequence number where these are given."""
    if chain is not None:
        ledger = ledger.where(F.col("chain") == chain)
    if after_seq is not None:
        ledger = ledger.where(F.col("seq") > after_seq)
    return ledger.orderBy("seq")


def _markers(values: list[bytes]) -> tuple[int, np.ndarray, list[list[int]], frozenset[bytes]]:
    """Markers by their first bytes: how many bytes (at most eight) all have, the
    distinct numbers these bytes make in order, the lengths of each one's markers, markers."""
    width = min(8, min(map(len, values)))
    lengths: dict[int, set[int]] = {}
    for v in values:
        lengths.setdefault(int.from_bytes(v[:width], "big"), set()).add(len(v))
    heads = sorted(lengths)
    return width, np.array(heads, np.uint64), [sorted(lengths[h]) for h in heads], frozenset(values)


def _found(payload: list[bytes], index) -> Iterator[tuple[int, bytes]]:
    """Each payload's number with each marker in it, once. All places of all payloads
    are compared by their first bytes at once, and what agrees by all bytes."""
    width, heads, lengths, values = index
    ends = np.cumsum([len(p) + 1 for p in payload])
    joined = b"\0".join(payload) + b"\0"
    raw = np.frombuffer(joined, np.uint8).astype(np.uint64)
    if len(raw) < width:
        return
    here = np.zeros(len(raw) - width + 1, np.uint64)
    for k in range(width):
        here = (here << np.uint64(8)) | raw[k : k + len(here)]
    at = np.minimum(np.searchsorted(heads, here), len(heads) - 1)
    seen = set()
    for place in np.flatnonzero(heads[at] == here).tolist():
        row = int(np.searchsorted(ends, place, side="right"))
        for size in lengths[at[place]]:
            value = joined[place : place + size]
            if value in values and place + size < ends[row] and (row, value) not in seen:
                seen.add((row, value))
                yield row, value


def leak_matches(ledger: DataFrame, markers: DataFrame, key: list[str], most_bytes: int = 32 << 20) -> DataFrame:
    """Rows (``key``, marker) of the ledger whose payload holds a raw value of ``markers``
    (its column ``marker``), letter for letter, once each. Empty and null markers find nothing.

    The values' bytes are summed before anything is gathered. Up to ``most_bytes`` they
    are one index that every task gets; more go in slices by hash, one pass over the
    payloads for each, so that no index outgrows the bound."""
    spark = ledger.sparkSession
    values = markers.select(F.col("marker").cast("string").alias("marker")).where("marker <> ''").distinct()
    total = values.agg(F.sum(F.octet_length("marker") + 64)).first()[0] or 0
    slices = max(1, -(-total // most_bytes))
    rows = ledger.select(*key, "payload").where("payload is not null")
    schema = StructType([*(rows.schema[k] for k in key), StructField("marker", StringType())])
    out = []
    for k in range(slices):
        own = [r.marker.encode() for r in values.where(F.pmod(F.xxhash64("marker"), F.lit(slices)) == k).toLocalIterator()]  # within the bound
        if own:
            index = spark.sparkContext.broadcast(_markers(own))

            def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for at in range(0, batch.num_rows, 512):
                        part = batch.slice(at, 512)
                        hits = list(_found([p.encode() for p in part.column("payload").to_pylist()], index.value))
                        if hits:
                            n, found = zip(*hits, strict=True)
                            own = [part.column(c).take(pa.array(n)) for c in key]
                            yield pa.RecordBatch.from_arrays([*own, pa.array([v.decode() for v in found], pa.string())], names=[*key, "marker"])

            out.append(rows.mapInArrow(scan, schema))
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], schema)


def leak_scan(ledger: DataFrame, markers: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """Entries whose payload holds one of a few raw markers, letter for letter, or
    matches a regular expression. For the values of a whole batch see ``leak_matches``."""
    tests = [F.contains("payload", F.lit(m)) for m in markers] + [F.col("payload").rlike(p) for p in patterns]
    return ledger.where(reduce(lambda a, b: a | b, tests, F.lit(False)))


class Intake:
    """What becomes of the entries of one chain, in order.

    ``head`` is the chain's last hash; ``keys`` maps a known key to its (event type,
    payload) digest and ``jobs`` a job to its state: dictionaries, or state of a stream.
    The tests go as follows: a known key is a replay if event and payload are equal, else a conflict;
    the job's state must allow the event; the payload must not be too large; the
    sender's own hash must be right. What passes is linked to the head, whatever
    head the sender knew."""

    def __init__(self, head: str, keys, jobs, most_bytes: int | None = None):
        self.head, self.keys, self.jobs, self.most_bytes = head, keys, jobs, most_bytes

    def take(self, payload, key, event, previous, current, job=None, status=None, known: bytes | None = None) -> tuple[str | None, str | None, str | None]:
        """code (None: accepted), previous_hash and current_hash in the ledger."""
        if payload is None or key is None:
            return "INCOMPLETE", None, None
        own = same(event, payload)
        known = known or self.keys.get(key)
        if known is not None:
            return ("REPLAY" if known == own else "CONFLICT"), None, None
        if event is not None and (job is not None or status is not None):
            state = self.jobs.get(job) if job is not None else None
            state = status if state is None else state
            if state in TERMINAL:
                return "TERMINAL", None, None
            if state is None or PREDECESSOR.get(event) != state:
                return "OUT_OF_ORDER", None, None
        if self.most_bytes is not None and len(payload.encode()) > self.most_bytes:
            return "TOO_LARGE", None, None
        if previous is None or current != entry_hash(previous, payload, key):
            return "BAD_HASH", None, None
        before, self.head = self.head, current if previous == self.head else entry_hash(self.head, payload, key)
        self.keys[key] = own
        if job is not None and event is not None:
            self.jobs[job] = LEADS_TO[event]
        return None, before, self.head


def same(event: str | None, payload: str) -> bytes:
    """Equal for entries that count as one."""
    return hashlib.sha256(f"{event or ''}\n{payload}".encode()).digest()[:16]


_TAKEN = ("chain", "id", "code", "previous_hash", "current_hash")


def _take_in(most_bytes: int | None):
    """Rows sorted by chain and order. A key or job is held from its first row to its
    last in the batch, so a task holds those that are open at one time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, intake = object(), None
        for rows in batches:
            out = []
            columns = [rows.column(c).to_pylist() for c in ("chain", "tail", "payload", "key", "event_type", "previous_hash", "current_hash", "job_id", "status", "known", "keys_left", "jobs_left")]
            for c, tail, payload, key, event, previous, current, job, status, known, keys_left, jobs_left in zip(*columns, strict=True):
                if c != chain:
                    chain, intake = c, Intake(tail, {}, {}, most_bytes)
                out.append(intake.take(payload, key, event, previous, current, job, status, known))
                if not keys_left:
                    intake.keys.pop(key, None)
                if not jobs_left:
                    intake.jobs.pop(job, None)
            code, before, now = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([rows.column("chain"), rows.column("id"), pa.array(code, pa.string()), pa.array(before, pa.string()), pa.array(now, pa.string())], names=list(_TAKEN))

    return run


def take_in(batch: DataFrame, ledger: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """What becomes of each entry of a batch: chain, id, code (null: accepted),
    previous_hash and current_hash (as the ledger links it).

    The batch has chain, created_at, id, payload, key, previous_hash, current_hash, and
    maybe event_type, job_id and status (of the job before the batch); the ledger has
    chain, seq, key, payload, current_hash, and maybe event_type. A chain's entries are
    taken one after the other by created_at and id, as ``Intake`` says: a key repeated in the
    batch is a replay or a conflict of the one accepted, and each event finds its job
    as the events before it have left it. A chain is sorted in one partition (with
    spill) and streams by; entries without payload or key are refused."""
    optional = [F.col(c) if c in batch.columns else F.lit(None).cast("string").alias(c) for c in ("event_type", "job_id", "status")]
    rows = batch.select("chain", "created_at", "id", "payload", "key", "previous_hash", "current_hash", *optional)
    kind = F.coalesce("event_type", F.lit("")) if "event_type" in ledger.columns and "event_type" in batch.columns else F.lit("")
    digest = F.substring(F.unhex(F.sha2(F.concat(kind, F.lit("\n"), "payload"), 256)), 1, 16)
    rows = rows.join(ledger.select("chain", "key", digest.alias("known")).dropDuplicates(["chain", "key"]), ["chain", "key"], "left")
    rows = rows.join(chain_head(ledger).select("chain", F.col("head").alias("tail")), "chain", "left").withColumn("tail", F.coalesce("tail", F.lit(GENESIS)))
    order = [F.desc(c) for c in ("created_at", "id", "payload")]
    later = lambda by: F.row_number().over(Window.partitionBy("chain", by).orderBy(*order)) - 1
    rows = rows.withColumn("keys_left", later("key")).withColumn("jobs_left", later("job_id"))
    ordered = rows.repartition("chain").sortWithinPartitions("chain", "created_at", "id", "payload")
    kinds = StructType([ordered.schema["chain"], ordered.schema["id"], *(StructField(n, StringType()) for n in _TAKEN[2:])])
    return ordered.mapInArrow(_take_in(most_bytes), kinds)
