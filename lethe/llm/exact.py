"""Exact deduplication by content-defined chunk recipes.

A text becomes a recipe: the list of identifiers of its content-defined chunks.
Only recipes are shuffled and compared, about one per cent of the text, and the
text itself never moves.

A chunk's identifier is its 64-bit fingerprint, verified against length and 128
bits of SHA-256 over all chunks of the corpus: a fingerprint that different
chunks share is no identifier, and the chunks' digests take its place in every
recipe that holds it.

Edge cases: null counts as the empty text, whose recipe is empty; repeated rows
of one doc_id with one text share one result and all count in group_size, and rows
of one doc_id with different texts are told apart; a row without a doc_id is kept
only where its whole group has none (``drop_copies`` leaves all such rows as they
are); an empty table gives an empty result; other columns are ignored. Texts of any
length are cut into chunks of at most 16 kB; a task holds one text at a time besides
its recipe, about one per cent of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_id, materialise, mix, slices, texts

_GEAR = mix(np.arange(256, dtype=np.uint64)).astype(np.uint32)
_SPACE = b" \t\n\v\f\r"
_RECIPE = "doc_id long, text_sha256 string, recipe array<struct<print:long,size:int,d1:long,d2:long>>"
_WHITE = "[\\x20\\x09-\\x0D]+"


def one_space(text: bytes) -> bytes:
    """Each run of white space becomes one space."""
    out = b" ".join(text.split())
    if text[:1] in _SPACE and text:
        out = b" " + out
    if text[-1:] in _SPACE and text and len(out) != 1:
        out += b" "
    return out if out or not text else b" "


def cuts(text: bytes, bits: int = 11, least: int = 512, most: int = 16384) -> list[int]:
    """Ends of content-defined chunks: where the top ``bits`` bits of a rolling
    sum over the last 32 bytes are zero, no sooner than ``least`` and no later
    than ``most`` bytes after the last cut."""
    n = len(text)
    if n <= least:
        return [n] if n else []
    h = _GEAR[np.frombuffer(text, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if k < n:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    out, at = [], 0
    for c in [*(np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist(), n]:
        while c - at > most:
            at += most
            out.append(at)
        if c - at >= least or c == n and c > at:
            out.append(c)
            at = c
    return out


def _recipes(print_bits: int):
    shift = 64 - print_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                shas, ends, prints, sizes, digests = [], [0], [], [], []
                for text in texts(part.column("text")):
                    text = one_space(text or b"")
                    shas.append(hashlib.sha256(text).hexdigest())
                    at = 0
                    for c in cuts(text):
                        chunk = text[at:c]
                        prints.append(xxhash.xxh3_64_intdigest(chunk) >> shift)
                        sizes.append(c - at)
                        digests.append(hashlib.sha256(chunk).digest()[:16])
                        at = c
                    ends.append(len(prints))
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                chunks = pa.StructArray.from_arrays([pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["print", "size", "d1", "d2"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shas, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunks)], names=["doc_id", "text_sha256", "recipe"])

    return run


def exact_groups(docs: DataFrame, print_bits: int = 64) -> DataFrame:
    """Groups of equal texts, white-space runs taken as one space.

    Returns doc_id, keep_id (smallest doc_id of the group), group_size, kept and
    text_sha256 for every row. ``print_bits`` below 64 shortens fingerprints (to
    test what happens when they clash).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # rows are told apart by a number of their own, fixed by writing it
    recipes = materialise(docs.mapInArrow(_recipes(print_bits), _RECIPE).withColumn("row", F.monotonically_increasing_id()), "recipes")
    chunks = recipes.select(F.explode("recipe").alias("c")).select("c.*")
    both = lambda c: (F.min(c) != F.max(c)).alias(f"{c}_differs")
    clashing = chunks.groupBy("print").agg(both("size"), both("d1"), both("d2")).where("size_differs or d1_differs or d2_differs").select("print")
    clashing = materialise(clashing, "clashing")
    lists = recipes.withColumn("ids", F.transform("recipe", lambda c: c["print"]))
    if not clashing.isEmpty():
        held = recipes.select("row", F.posexplode("recipe").alias("at", "c")).withColumn("print", F.col("c.print")).join(clashing, "print")
        held = held.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("c.size", "c.d1", "c.d2").alias("digest")))).alias("unsure"))
        digest = lambda i: F.try_element_at(F.col("unsure"), i)
        sure = F.transform("recipe", lambda c, i: F.struct(F.when(digest(i).isNull(), c["print"]).alias("print"), digest(i).alias("digest")))
        lists = recipes.join(held, "row", "left").withColumn("ids", sure)
    lists = lists.select("doc_id", "text_sha256", "ids")
    groups = lists.groupBy("ids").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # written, so that both sides of the join are dealt for it and a large group can be split
    several = materialise(groups.where("group_size > 1"), "groups")
    out = lists.join(several, "ids", "left")
    return out.select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("group_size").isNull() | F.equal_null("keep_id", "doc_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, **more) -> DataFrame:
    """One document of each group of equal texts, with all its columns."""
    found = materialise(exact_groups(docs, **more).where("doc_id is not null").select("doc_id", "kept", "text_sha256"), "copies")
    ids = materialise(found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")), "ids")
    left = by_id(docs, ids.where("not kept").select("doc_id"), "left_anti")
    twice = ids.where("kept and n > 1").select("doc_id")
    if twice.isEmpty():
        return left
    # repeated rows of one doc_id, each looked up by its own text
    text = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), _WHITE, " "), 256)
    own = next(n for k in count() if (n := f"sha256_{k}") not in {c.lower() for c in docs.columns})  # a name that no column has
    rows = by_id(left, twice, "left_semi").withColumn(own, text).dropDuplicates(["doc_id", own])
    rows = rows.join(found.where("kept").select("doc_id", F.col("text_sha256").alias(own)).distinct(), ["doc_id", own], "left_semi").select(*docs.columns)
    return by_id(left, twice, "left_anti").unionByName(rows)
