"""SimHash near-deduplication by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Two fingerprints that
differ in at most three bits differ in at most one bit of some segment, so each
fingerprint is stored once under either segment's value and looks up the Hamming
ball of radius one around it. Of two values one bit apart just one has the bit
set, so a ball is enumerated by clearing set bits only: about 17 keys instead of
33. Matches are verified by their complete distance.

The whole search runs on distinct fingerprints: copies meet in one row first.
Components come from the links by alternating large-star and small-star steps,
which never gather a node's neighbours in one task; each step's table is written
to the shared folder.

Edge cases: null and blank texts have fingerprint zero and link like any other;
texts of fewer words than a shingle have one shingle of all their words; repeated
rows give one row each; rows without a doc_id link nothing and get the component of
the rows with their very fingerprint, or null if there are none; an empty table gives
an empty result; other columns are ignored. Texts of any length are hashed whole; a task holds some hundred
bytes for each word of one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_id, materialise, mix, release, slices, texts


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    k = min(shingle, len(words))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    one = xxhash.xxh64_intdigest
    return np.array([one(joined[s : e - 1], 42) for s, e in zip(starts, starts[k:], strict=False)], np.uint64)


def vote(h: np.ndarray) -> int:
    """A bit is set if it is in more than half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array([vote(shingle_hashes(t, shingle)) for t in texts(part.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and print, the 64-bit fingerprint as a signed integer."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prints(shingle), "doc_id long, print long")


_SEGMENTS = 2


def _segment(k: int):
    return F.shiftrightunsigned("print", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))


def links(points: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (u, v) of nodes whose prints differ in 1 to ``distance`` bits.
    ``points`` has distinct prints, with node as each one's label."""
    if not 0 <= distance < 2 * _SEGMENTS:
        raise ValueError("a ball of radius one in each of two segments finds distances up to three")
    tag = lambda k, value: F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(value)
    stored = points.select("print", "node", F.explode(F.array(*[tag(k, _segment(k)) for k in range(_SEGMENTS)])).alias("key"))
    bits = F.array(*[F.lit(1 << b).cast("long") for b in range(32)])

    def ball(k: int):
        own = _segment(k)
        cleared = F.transform(F.filter(bits, lambda b: own.bitwiseAND(b) != 0), lambda b: tag(k, own.bitwiseXOR(b)))
        return F.concat(F.array(tag(k, own)), cleared)

    keys = F.concat(*[ball(k) for k in range(_SEGMENTS)])
    sought = points.select(F.col("print").alias("other"), F.col("node").alias("u"), F.explode(keys).alias("key"))
    near = sought.join(stored, "key").where((F.col("print") != F.col("other")) & (F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= distance))
    return near.select("u", F.col("node").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """node and component, its least reachable node, for all nodes of edges (u, v)."""
    spark = edges.sparkSession
    pairs = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while (now := pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != state:
        state = now
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        pairs = materialise(small.where("u <> v").distinct(), "edges")
        release(spark)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def simhash_components(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that
    links of at most ``distance`` differing bits reach, for every row."""
    prints = materialise(fingerprints(docs, shingle), "prints")
    points = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("node")), "points")
    found = components(links(points, distance))
    # written, so that both sides of the last join are dealt for it and a large group can be split
    points = materialise(points.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id")), "points")
    text = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return prints.join(points, "print").select("doc_id", text.alias("fingerprint"), "component_id")


def _views(shingle: int, views: int):
    """The fingerprint of each text, and for each view the one of the three distinct
    shingles that come first in the view's order (the majority of their bits)."""
    salts = mix(np.arange(views, dtype=np.uint64))

    def keys(h: np.ndarray) -> list[int]:
        if not len(h):
            return []
        own = np.unique(h)
        first = np.partition(mix(np.resize(own, max(3, len(own))) ^ salts[:, None]), 2, axis=1)[:, :3]
        a, b, c = first.T
        return mix(((a & b) | (a & c) | (b & c)) ^ salts).view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                hashes = [shingle_hashes(t, shingle) for t in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array([vote(h) for h in hashes], np.uint64).view(np.int64)), pa.array([keys(h) for h in hashes], pa.list_(pa.int64()))], names=["doc_id", "print", "keys"])

    return run


#: Bits of a text's marks.
_MARKS = 256


def _sets(shingle: int):
    """The distinct shingles of each text, and marks: for each of 256 places whether an
    odd number of them fall there. Two sets differ in at least as many shingles as their marks in bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                own = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts(part.column("text"))]
                marks = [np.packbits(np.bincount(h & (_MARKS - 1), minlength=_MARKS).astype(np.uint8) & 1).view(np.int64) for h in own]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "shingles", "marks"])

    return run


def similar_components(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 3, views: int = 12, exact: bool = True) -> DataFrame:
    """doc_id and component_id (its least doc_id) over links between documents whose
    shingle sets have a Jaccard similarity of ``similarity`` or more.

    Candidates come from fingerprints. Three bits of the whole text's fingerprint
    stand for a similarity of 0.98 and miss most pairs at 0.8, so each text also has
    fingerprints of ``views`` min-wise samples of three shingles: two texts of
    similarity s agree in one with a chance of about s**3. Texts that agree are each
    compared with one of them, another for each view; all pairs of a group never are.
    Groups of three or more that this leaves in parts are then dealt anew by their
    rare shingles (``_across``), with two texts of each shingle to compare with, then
    with about ``_CENTRES``, which joins most of what has links; what is still in parts
    then is compared with all texts of a shingle in other parts, so that no link of
    texts that agree in a fingerprint is missed. Every candidate is verified by the
    exact similarity.

    Without ``exact`` the last two steps are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = materialise(docs.mapInArrow(_views(shingle, views), "doc_id long, print long, keys array<long>"), "views")
    points = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("node")), "points")
    near = materialise(links(points, distance), "near")
    whole = near.unionAll(prints.select(F.col("doc_id").alias("u"), "print").join(points, "print").select("u", F.col("node").alias("v")))
    seen = prints.select("doc_id", F.posexplode("keys").alias("view", "key"))
    chosen = materialise(seen.groupBy("view", "key").agg(F.min_by("doc_id", F.xxhash64("doc_id", "view")).alias("v"), F.count("*").alias("n")).where("n > 1").drop("n"), "chosen")
    pairs = whole.unionAll(seen.join(chosen, ["view", "key"]).select(F.col("doc_id").alias("u"), "v"))
    pairs = materialise(pairs.where("u <> v").distinct(), "pairs")
    nodes = materialise(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "nodes")
    sets = materialise(by_id(docs, nodes, "left_semi").mapInArrow(_sets(shingle), "doc_id long, shingles array<long>, marks array<long>"), "sets")
    release(docs.sparkSession, chosen)
    found = components(_verified(pairs, sets, similarity))
    part = materialise(nodes.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("part")), "part")
    # prints that links join are one group
    tied = components(near)
    groups = points.join(tied, "node", "left").select("print", F.coalesce("component", "node").alias("key"))
    keys = seen.select("doc_id", F.col("view").cast("int").alias("view"), "key").unionAll(prints.select("doc_id", "print").join(groups, "print").select("doc_id", F.lit(-1).alias("view"), "key"))
    release(docs.sparkSession, pairs)
    done = []
    for centres in (2, _CENTRES, None) if exact else (2,):
        # pairs of two that agree were compared, and larger groups of one part are joined already
        groups = keys.join(part, "doc_id")
        mixed = materialise(groups.groupBy("view", "key").agg(F.count("*").alias("n"), F.min("part").alias("a"), F.max("part").alias("b")).where("n > 2 and a < b").select("view", "key"), "mixed")
        rest = materialise(groups.join(mixed, ["view", "key"]).select("doc_id", "view", "key", "part"), "rest")
        if rest.isEmpty():
            break
        pairs = _across(sets.join(rest.select("doc_id", "part").distinct(), "doc_id"), similarity, centres)
        joined = components(_between(_verified(pairs, sets, similarity), part))
        release(docs.sparkSession, pairs, mixed, *done)
        part = materialise(part.join(joined, F.col("part") == F.col("node"), "left").select("doc_id", F.coalesce("component", "part").alias("part")), "part")
        # groups only ever lose parts, so that the next round looks at these alone
        keys, done = rest.drop("part"), [rest]
    return prints.select("doc_id").join(part, "doc_id", "left").select("doc_id", F.coalesce("part", "doc_id").alias("component_id"))


def _between(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """Links (u, v) of parts, from links of their texts."""
    ends = lambda name: part.select(F.col("doc_id").alias(name), F.col("part").alias(f"{name}_part"))
    return pairs.join(ends("u"), "u").join(ends("v"), "v").select(F.col("u_part").alias("u"), F.col("v_part").alias("v"))


#: Rows into which the set of a text is dealt that very many others are compared with.
_SALTS = 64


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are as similar. Many u may share a v: its set is
    dealt by salts, of which only those that occur get a copy."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(_SALTS)))
    side = lambda name: sets.select(F.col("doc_id").alias(name), F.col("shingles").alias(f"{name}_set"))
    sought = salted.select("v", "salt").distinct().join(side("v"), "v")
    both = salted.join(side("u"), "u").join(sought, ["v", "salt"])
    common = F.size(F.array_intersect("u_set", "v_set"))
    # by counts, so that no rounding decides: common / (all - common) >= similarity
    return both.where(common * (1 + similarity) >= (F.size("u_set") + F.size("v_set")) * similarity - 1e-9).select("u", "v")


#: Texts of a shingle that each other one is compared with, in the second of three rounds.
_CENTRES = 128


def _across(parts: DataFrame, similarity: float, centres: int | None) -> DataFrame:
    """Candidate pairs (u, v) of different parts.

    A prefix filter: shingles are put in one order, those of a single part first (no
    pair sought shares them), then the rarest. Before their first common shingle, at
    places i and j, two texts of a and b shingles have nothing in common, so that
    i + j <= (a + b) * (1 - similarity) / (1 + similarity). Hence one of them has it
    in that share of its own shingles, and either in its first 1 - similarity. Texts
    that only share a passage have their own shingles first, so they meet nowhere.

    Of all texts that meet in a shingle, each is compared with two (so that of three
    every pair is); many shingles have the same two, so that few pairs come from
    many. More than two ``centres`` are chosen by a hash of the text, about as many of
    each shingle; None takes all pairs but those inside the largest part, in one
    direction where both may lead. In any case only pairs are candidates whose marks differ in no more bits
    than the sets may in shingles.
    """
    most = (1 - similarity) / (1 + similarity)
    rows = parts.select("doc_id", "part", F.size("shingles").alias("size"), F.explode("shingles").alias("token"))
    held = rows.groupBy("token", "part").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.max_by("part", F.struct("n", "part")).alias("major"), F.count("*").alias("parts"))
    shared = materialise(held.where("parts > 1").drop("parts"), "shared")
    marks = parts.select("doc_id", *[F.get("marks", F.lit(k)).alias(f"mark{k}") for k in range(_MARKS // 64)])
    own = Window.partitionBy("doc_id")
    placed = rows.join(shared, "token").withColumn("at", F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "token")) - 1)
    leads = F.col("over") <= 1e-6
    if centres and centres > 2:
        leads &= F.pmod(F.xxhash64("doc_id", F.pmod("token", F.lit(8))), F.lit(1 << 20)) * F.col("n") < centres << 20
    near = placed.where(F.col("at") <= F.col("size") * (1 - similarity) + 1e-6).withColumn("over", F.col("at") - F.col("size") * most)
    first = materialise(near.select("token", "doc_id", "part", "size", "over", leads.alias("leads"), (F.col("part") == F.col("major")).alias("inside")).join(marks, "doc_id"), "first")
    marked = [f"mark{k}" for k in range(_MARKS // 64)]
    one = first.where("leads").select("token", F.col("doc_id").alias("v"), F.col("part").alias("v_part"), F.col("size").alias("v_size"), F.col("over").alias("v_over"), F.col("inside").alias("v_inside"), *[F.col(m).alias(f"v_{m}") for m in marked])
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(m).bitwiseXOR(F.col(f"v_{m}"))) for m in marked])
    fits = (apart <= (F.col("size") + F.col("v_size")) * most + 1e-6) & (F.col("v_part") != F.col("part")) & (F.col("v_over") + F.col("over") <= 1e-6) & (F.least("v_size", "size") >= F.greatest("v_size", "size") * similarity - 1e-6)
    met = lambda a, b, on: a.join(b, "token").where(on).select(F.col("doc_id").alias("u"), "v")
    if centres != 2:
        # of two texts that lead in the shingle, one meets the other
        once = fits & (~F.col("leads") | (F.col("v") < F.col("doc_id")))
        out = met(one.where("not v_inside"), first, once).unionAll(met(one.where("v_inside"), first.where("not inside"), once))
        out = materialise(out.distinct(), "pairs")
        release(parts.sparkSession, shared, first)
        return out
    order = F.xxhash64("v", F.pmod("token", F.lit(4)))
    text = F.struct("v", "v_part", "v_size", "v_over", *[f"v_{m}" for m in marked])
    two = one.groupBy("token").agg(F.min_by(text, order).alias("a"), F.max_by(text, order).alias("b"))
    out = materialise(met(two.select("token", F.explode(F.array("a", "b")).alias("t")).select("token", "t.*"), first, fits).distinct(), "pairs")
    release(parts.sparkSession, shared, first)
    return out


def drop_near_copies(docs: DataFrame, **more) -> DataFrame:
    """The document of smallest doc_id of each component, with all its columns. Rows
    without a doc_id stay as they are."""
    found = similar_components(docs.where("doc_id is not null"), **more)
    dropped = materialise(found.where("doc_id <> component_id").select("doc_id"), "near")
    return by_id(docs, dropped, "left_anti")
