"""Benchmark decontamination: broadcast hash set of normalised test n-grams.

The benchmark's windows are hashed into one sorted array and broadcast with the
benchmark's words, each of which is held once; every task scans the token windows
of its documents, compares the words behind each hash hit, and marks the words
that a window covers. With one slice nothing is shuffled.

The broadcast's size is bounded: the index's bytes are summed in Spark before it is
built (its words, and 24 bytes for each window), and a benchmark of more than
``broadcast_bytes`` is dealt into slices. Long items are cut into overlapping pieces
beforehand, so that slices come out even. Slices are built, broadcast, scanned and
released one after the other; only one is alive at a time.

Edge cases: null texts and items have no words; items without words have no window;
items without an id are called "null"; repeated items count once; repeated rows and
rows without a doc_id get a result each, however many slices there are; an empty
table gives an empty result; other columns are ignored. Texts of any length are
scanned whole; a task holds some eight bytes for each word of one text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Windows, keep_rows, materialise, slices, texts, word_hashes

#: Lower-cases A-Z; what is neither a letter, a digit nor outside ASCII parts words.
_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = "doc_id long, print binary, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
#: Words of an item that one row holds.
_PIECE = 4096
#: Bytes of an index entry besides the words.
_ENTRY = 24


def item_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _pieces(width: int):
    """Items' words in pieces that overlap so that each window lies in one, with the
    length of the item's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, parts, held = [], [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), texts(batch.column("text")), strict=True):
                words = item_words(text)
                n = min(width, len(words))
                for at in range(0, max(1, len(words) - n + 1) if n else 0, _PIECE):
                    own = words[at : at + _PIECE + n - 1]
                    ids.append(item)
                    sizes.append(n)
                    parts.append(b" ".join(own))
                    held.append(len(parts[-1]) + _ENTRY * (len(own) - n + 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sizes, pa.int32()), pa.array(parts, pa.binary()), pa.array(held, pa.int64())], names=["item_id", "n", "words", "bytes"])

    return run


class _Index:
    """Windows of benchmark items by length: sorted hashes, where their words lie in
    one run of bytes, and their items."""

    def __init__(self, pieces: Iterable[tuple[str, int, bytes]]):
        text, at, self.items = [], 0, []
        number: dict[str, int] = {}
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for item, n, piece in pieces:
            if item not in number:
                number[item] = len(self.items)
                self.items.append(item)
            words = piece.split()
            w = Windows(n)(word_hashes(words))
            ends = np.cumsum([len(x) + 1 for x in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            found.setdefault(n, []).append((w, at + starts[: len(w)], (ends[n - 1 :] - starts[: len(w)]).astype(np.int32), np.full(len(w), number[item], np.int32)))
            text.append(piece)
            at += len(piece)
        self.text = b"".join(text)
        self.by_length = {}
        for n, parts in found.items():
            w, start, size, own = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((start, own, w))
            w, start, size, own = w[order], start[order], size[order], own[order]
            again = np.flatnonzero((w[1:] == w[:-1]) & (own[1:] == own[:-1])) + 1
            twice = [i for i in again.tolist() if self._words(start, size, i) == self._words(start, size, i - 1)]
            keep = np.ones(len(w), bool)
            keep[twice] = False
            self.by_length[n] = (w[keep], start[keep], size[keep], own[keep])

    def _words(self, start: np.ndarray, size: np.ndarray, i: int) -> bytes:
        return self.text[start[i] : start[i] + size[i]]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of words inside windows, and the items that these are of."""
        spans, items = [], set()
        if not words:
            return spans, items
        h = word_hashes(words)
        for n, (hashes, start, size, owner) in self.by_length.items():
            w = Windows(n)(h)
            lo = np.searchsorted(hashes, w)
            for i in np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == w).tolist():
                own, j = b" ".join(words[i : i + n]), lo[i]
                while j < len(hashes) and hashes[j] == w[i]:
                    if self._words(start, size, j) == own:
                        spans.append((i, i + n))
                        items.add(self.items[owner[j]])
                    j += 1
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _structs(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS)


def _scan(index, only_hits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prints, n, spans, items = [], [], [], []
                for text in texts(part.column("text")):
                    words = item_words(text)
                    s, i = index.value.scan(words)
                    prints.append(hashlib.blake2b(text or b"", digest_size=16).digest())
                    n.append(len(words))
                    spans.append(s)
                    items.append(sorted(i))
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints, pa.binary()), pa.array(n, pa.int64()), _structs(spans), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "print", "n_words", "spans", "items"])
                yield out.filter(pa.array([bool(i) for i in items], pa.bool_())) if only_hits else out

    return run


def _slices(benchmark: DataFrame, width: int, broadcast_bytes: int) -> Iterator[tuple[int, object]]:
    """How many slices there are, and the broadcast index of each; an index is gone
    when the next is asked for."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").distinct()
    pieces = materialise(items.mapInArrow(_pieces(width), "item_id string, n int, words binary, bytes long"), "items")
    size = pieces.agg(F.sum("bytes")).first()[0] or 0
    parts = -(-size // broadcast_bytes) or 1
    for k in range(parts):
        own = pieces.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)) == k) if parts > 1 else pieces
        index = spark.sparkContext.broadcast(_Index((r.item_id, r.n, bytes(r.words)) for r in own.toLocalIterator()))
        yield parts, index
        if parts > 1:
            index.destroy()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and items that several slices found in one text."""
    for batch in batches:
        spans = [merged([(s["start"], s["end"]) for found in row for s in found]) for row in batch.column("spans").to_pylist()]
        items = [sorted({i for found in row for i in found}) for row in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n"), _structs(spans), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "n", "spans", "items"])


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Words of documents that a benchmark window covers: doc_id, n_words, spans
    (word offsets, end exclusive) and items (ids, sorted as strings)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for parts, index in _slices(benchmark, width, broadcast_bytes):
        one = docs.mapInArrow(_scan(index, bool(found)), _FOUND)
        if parts == 1:
            return one.drop("print")
        found.append(materialise(one.withColumn("n", F.lit(0 if found else 1)), "spans"))
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    # equal rows (doc_id and text) have equal results: they meet here, and come out as often as they came in
    sets = every.groupBy("doc_id", "print", "n_words").agg(F.sum("n").alias("n"), F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items")).drop("print")
    out = sets.mapInArrow(_joined, "doc_id long, n_words long, n long, spans array<struct<start:int,end:int>>, items array<string>")
    return out.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, **more) -> DataFrame:
    """doc_id, n_words, n_hit (words covered), n_items, items_sha256 (of the item
    ids, comma-joined) and contaminated for every document."""
    found = contaminated_spans(docs, benchmark, width, **more)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns. With
    several slices, what each leaves is written before the next."""
    for parts, index in _slices(benchmark, width, broadcast_bytes):
        docs = keep_rows(docs, lambda index=index: lambda part: [not index.value.scan(item_words(t))[1] for t in texts(part.column("text"))])
        if parts > 1:
            docs = materialise(docs, "clean")
    return docs
