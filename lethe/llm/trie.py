"""The prefix trie of conversations, by vertical bitmaps.

Conversations are dealt into shards: ranges of ids that end at multiples of
``block``, so that a conversation and the one it takes its first turns from are
together. A shard indexes (position, turn) to the set of its conversations, as
bits of one integer, and walks depth first: the intersection of a node's set with
the postings of the next position gives its children, their sizes and who ends.

Shards meet by node keys, 128 bits of a digest of the path, one row for each shard
and node, however many conversations a node has. Of all shards that hold a node, the
one with its smallest member charges it, so that sums over subtrees are sums over
shards of what each has charged below. End lists are digested as a sorted stream of
one row for each shard. Texts never move: a turn is 128 bits of its role and text.

Edge cases: rows of one conversation with the same turn are ordered by role, then by
the turn's digest; rows without a conv_id belong to no conversation; null and empty
roles and texts are the same; repeated rows are turns of their own; an empty table has
no node, not even the root; other columns are ignored; for negative ids the remainder
has the sign of the id, as in SQL. A text of any length is one digest. A shard holds
``shard_rows`` turns or one block of conversations, whatever that has: some 500 bytes for
each turn.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

_NODES = "shard long, idx int, up int, depth long, k1 long, k2 long, n long, least long, n_ends long, ends array<long>, words long"
_SUMS = "k1 long, k2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_ROOT = hashlib.md5(b"").digest()


def rows_of(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True)


def rebuilt(base: int, own: dict[int, list]) -> Iterator[tuple[int, list]]:
    """Each conversation of a block with its first turns from those of the block's base."""
    first = own.get(base, [])
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        yield c, first[:h] + turns[h:]


def local_trie(convs: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, int, int, bytes, int, int, list[int], bytes | None]]:
    """Nodes of the trie over (id, turns), ids ascending, in depth-first order: index, index
    of the parent, depth, key, members, smallest member, who ends here, last turn."""
    postings: dict[tuple[int, bytes], int] = {}
    lasting: dict[int, int] = {}
    for i, (_, turns) in enumerate(convs):
        bit = 1 << i
        for d, t in enumerate(turns):
            postings[d, t] = postings.get((d, t), 0) | bit
        lasting[len(turns)] = lasting.get(len(turns), 0) | bit
    stack = [((1 << len(convs)) - 1, -1, 0, _ROOT, None)]
    n = 0
    while stack:
        members, up, depth, key, last = stack.pop()
        ends, found = members & lasting.get(depth, 0), []
        rest = members ^ ends
        while ends:
            low = ends & -ends
            found.append(convs[low.bit_length() - 1][0])
            ends ^= low
        yield n, up, depth, key, members.bit_count(), convs[(members & -members).bit_length() - 1][0], found, last
        while rest:
            turn = convs[(rest & -rest).bit_length() - 1][1][depth]
            child = rest & postings[depth, turn]
            rest ^= child
            stack.append((child, n, depth + 1, hashlib.md5(key + turn).digest(), turn))
        n += 1


def _shards(shard_rows: int):
    def trie(blocks: list[tuple[int, dict[int, list]]], words: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        convs = [x for base, own in blocks for x in rebuilt(base, own)]
        nodes = list(local_trie(convs))
        for at in range(0, len(nodes), 8192):
            part = nodes[at : at + 8192]
            idx, up, depth, key, n, least, ends, last = zip(*part, strict=True)
            k = np.frombuffer(b"".join(key), np.int64).reshape(-1, 2)
            cols = [pa.array([blocks[0][0]] * len(part), pa.int64()), pa.array(idx, pa.int32()), pa.array(up, pa.int32()), pa.array(depth, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(n, pa.int64()), pa.array(least, pa.int64()), pa.array([len(e) for e in ends], pa.int64()), pa.array([e or None for e in ends], pa.list_(pa.int64())), pa.array([words.get(t, 0) for t in last], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "idx", "up", "depth", "k1", "k2", "n", "least", "n_ends", "ends", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, words, held = [], {}, 0
        for base, rows in groupby(rows_of(batches), lambda r: r[0]):
            if held >= shard_rows:
                yield from trie(blocks, words)
                blocks, words, held = [], {}, 0
            own: dict[int, list] = {}
            for _, c, turn, n in rows:
                own.setdefault(c, []).append(turn)
                words[turn] = n
                held += 1
            blocks.append((base, own))
        if blocks:
            yield from trie(blocks, words)

    return run


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each shard adds to its nodes: children, leaves and saved tokens that it
    charges. Rows come sorted by shard and depth-first index."""
    names = ["shard", "idx", "up", "k1", "k2", "depth", "words", "least", "conv_id", "n_convs", "all_ends"]

    def sums(rows: list[tuple]) -> pa.RecordBatch:
        c = dict(zip(names, map(np.array, zip(*rows, strict=True)), strict=True))
        mine = c["least"] == c["conv_id"]
        leaves = (mine & (c["all_ends"] == c["n_convs"])).astype(np.int64)
        saved = np.where(mine, (c["n_convs"] - 1) * c["words"], 0)
        children = np.zeros(len(mine), np.int64)
        up = c["up"]
        np.add.at(children, up[mine & (up >= 0)], 1)
        for i in range(len(up) - 1, 0, -1):
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
        parents = pa.array(c["conv_id"][up], mask=up < 0)
        send = mine | (leaves > 0) | (saved > 0) | (children > 0)
        cols = [c["k1"], c["k2"], c["depth"], c["conv_id"], parents, c["n_convs"], children, leaves, saved]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=[f.split()[0] for f in _SUMS.split(", ")]).filter(pa.array(send))

    for _, rows in groupby(rows_of(batches), lambda r: r[0]):
        yield sums(list(rows))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's end list. Rows come sorted by node and shard."""
    out = []
    for key, rows in groupby(rows_of(batches), lambda r: r[:2]):
        sha, comma = hashlib.sha256(), b""
        for *_, ends in rows:
            sha.update(comma + ",".join(map(str, ends)).encode())
            comma = b","
        out.append((*key, sha.hexdigest()))
        if len(out) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["k1", "k2", "ends_sha256"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["k1", "k2", "ends_sha256"])


def trie_nodes(conversations: DataFrame, block: int = 20, shard_rows: int = 20_000) -> DataFrame:
    """A row for each node of the trie: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    spark = conversations.sparkSession
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = (
        conversations.where("conv_id is not null")
        .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .select((F.col("conv_id") - F.col("conv_id") % block).alias("base"), "conv_id", "turn", "role", F.unhex(F.md5(said)).alias("said"), F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).alias("words"))
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-conversations.count() // (10 * shard_rows)))
    dealt = rows.repartitionByRange(tasks, "base").sortWithinPartitions("base", "conv_id", F.col("turn").asc_nulls_first(), "role", "said")
    local = materialise(dealt.select("base", "conv_id", "said", "words").mapInArrow(_shards(shard_rows), _NODES), "tries")
    every = local.groupBy("k1", "k2").agg(F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("n_ends").alias("all_ends"))
    known = local.drop("ends", "n", "n_ends").join(every, ["k1", "k2"])
    known = known.select("shard", "idx", "up", "k1", "k2", "depth", "words", "least", "conv_id", "n_convs", "all_ends")
    below = known.repartition("shard").sortWithinPartitions("shard", "idx").mapInArrow(_below, _SUMS)
    most = [F.max(c).alias(c) for c in ("depth", "conv_id", "parent_conv_id", "n_convs")]
    nodes = below.groupBy("k1", "k2").agg(*most, *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    ends = local.where("n_ends > 0").select("k1", "k2", "shard", "ends")
    ends = ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "shard").drop("shard").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(ends, ["k1", "k2"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
