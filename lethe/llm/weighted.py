"""Document fingerprints by consistent weighted sampling.

A text is a bag of words, each weighted by how often it occurs. Every one of ``samples``
draws has for each word two gamma variables r and c and a uniform one b, fixed by the
word and the draw. With weight w, t = floor(ln w / r + b) and the word's value is
ln c - r * (t - b + 1); the word of least value, with its t, is the draw's sample. Two
texts have the same sample with a chance equal to the generalised Jaccard similarity of
their weights (sum of minima over sum of maxima), so the share of equal samples
estimates it, with a standard error of at most 0.5 / sqrt(samples).

Variables come from tables of quantiles looked up by bits of a hash, and all else is
additions, one division and comparisons, so every machine draws the same.

A text and its successor must meet once to make the edited text. Documents are dealt
into ranges of ids and sorted there, and the first of each range is sent to the range
before as well; texts move once.

Edge cases: null is the empty text, whose fingerprint is all zeros: alike to itself, unlike any
other; rows of one doc_id follow each other by a hash of their texts (equal texts don't matter), rows
without a doc_id come last; a single row is followed by itself; repeated rows give one
row each; an empty table gives an empty result; other columns are ignored. Texts of any
length are read whole, words of more than ``_LONG`` bytes in pieces of ``_PIECE``; a task holds two texts
and one text's draws for ``_PART`` words at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, word_hashes

SAMPLES = 128
_BITS = 16
_LONG, _PIECE = 24, 12
_CACHE = 1 << 13
_PART = 2048


@cache
def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the gamma distribution of shape two, and their logarithms, by
    Newton's steps on its distribution function 1 - (1 + x) exp(-x)."""
    n = 1 << _BITS
    p = (np.arange(n) + 0.5) / n
    x = np.where(p < 0.5, np.sqrt(2 * p), -np.log1p(-p) + 1)
    for _ in range(40):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), 1e-9)
    # to multiples of 2**-12, so that no last digit of a machine's exp or log shows
    return tuple((np.round(v * 4096) / 4096).astype(np.float32) for v in (x, np.log(x)))


def terms(text: bytes) -> Counter:
    """Words with their counts; long ones, as of scripts without spaces, in pieces."""
    words = text.split()
    if len(text) > _LONG and max(map(len, words), default=0) > _LONG:
        words = [p for w in words for p in ([w] if len(w) <= _LONG else [w[k : k + _PIECE] for k in range(0, len(w), _PIECE)])]
    return Counter(words)


def _mix32(x: np.ndarray) -> np.ndarray:
    """A bijection on 32-bit words (two rounds of shift and odd multiplier)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


class Sampler:
    """Draws of a task; the variables of words seen lately are kept."""

    def __init__(self, samples: int = SAMPLES):
        salts = mix(np.arange(samples, dtype=np.uint64))
        self.low, self.high = salts.astype(np.uint32), (salts >> np.uint64(32)).astype(np.uint32)
        self.samples, self.draw = samples, np.arange(samples)
        self.gamma, self.ln_gamma = _gamma()
        self.places: dict[bytes, int] = {}
        self.hashes = np.empty(_CACHE, np.uint64)
        self.once = np.empty((_CACHE, samples), np.float32)

    def variables(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, ln c and 1 - b for words with the hashes ``h``, a column for each draw."""
        two = _mix32(h.astype(np.uint32)[:, None] ^ self.low)
        r = self.gamma.take((two & np.uint32(0xFFFF)).astype(np.intp), mode="clip")
        ln_c = self.ln_gamma.take((two >> np.uint32(16)).astype(np.intp), mode="clip")
        rest = _mix32((h >> np.uint64(32)).astype(np.uint32)[:, None] ^ self.high)
        rest >>= np.uint32(8)
        return r, ln_c, rest.astype(np.float32) * np.float32(2.0**-24)

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Where each word's values at weight one (t is 0) are; those of new words are drawn."""
        new = [w for w in words if w not in self.places]
        if len(self.places) + len(new) > _CACHE:
            self.places.clear()
            new = words
        if new:
            at = slice(len(self.places), len(self.places) + len(new))
            self.places.update(zip(new, range(at.start, at.stop), strict=True))
            self.hashes[at] = h = word_hashes(new)
            r, ln_c, less = self.variables(h)
            less *= r
            np.subtract(ln_c, less, out=self.once[at])
        return np.array([self.places[w] for w in words])

    def __call__(self, text: bytes) -> np.ndarray:
        """The samples of a text, 16 bits each and never 0 (all 0 without words)."""
        bag = terms(text)
        if not bag:
            return np.zeros(self.samples, np.uint16)
        words, n = list(bag), np.fromiter(bag.values(), np.int64, len(bag))
        least = np.full(self.samples, np.inf, np.float32)
        out = np.zeros(self.samples, np.uint64)
        for at in range(0, len(words), _PART):
            place, w = self._places(words[at : at + _PART]), n[at : at + _PART]
            value, t = self.once[place], None
            more = np.flatnonzero(w > 1)
            if len(more):
                r, ln_c, less = self.variables(self.hashes[place[more]])
                t = np.floor(np.log(w[more].astype(np.float64)).astype(np.float32)[:, None] / r + (np.float32(1) - less))
                value[more] = ln_c - r * (t + less)
            first = value.argmin(axis=0)
            lowest = value[first, self.draw]
            found = self.hashes[place[first]]
            if len(more):
                row = np.full(len(w), -1)
                row[more] = np.arange(len(more))
                found = found ^ mix(np.where(row[first] >= 0, t[row[first], self.draw], 0).astype(np.uint64))
            else:
                found = found ^ mix(np.zeros(1, np.uint64))
            out = np.where(lowest < least, mix(found), out)
            least = np.minimum(least, lowest)
        return (out % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = Sampler(samples)
        last = None
        for batch in batches:
            out = []
            for part in slices(batch, "text"):
                for bucket, i, extra, text in zip(*(part.column(c).to_pylist() for c in ("bucket", "doc_id", "extra", "text")), strict=True):
                    own = draw(text.encode())
                    if last is not None and last[0] == bucket:
                        _, before, said, prints = last
                        n = len(said)
                        new = (said[: n - n // 3] + text[: n // 3]).encode()
                        changed = draw(new)
                        out.append((before, n, hashlib.sha256(new).hexdigest(), prints.astype(">u2").tobytes().hex(), changed.astype(">u2").tobytes().hex(), likeness(prints, changed), likeness(prints, own)))
                    last = None if extra else (bucket, i, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, rows: int = 2000, most: int = 20_000) -> DataFrame:
    """For each document its fingerprint, that of its edited text (the last third made
    of the start of the next document, by descending doc_id), and how alike they are.

    Ranges have about ``rows`` documents, more where there would be over ``most`` ranges.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = min(most, max(1, -(-docs.count() // rows)))
    bounds = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n).alias("q")).first()["q"] if n > 1 else None
    bounds = sorted(set(bounds or []))

    # range 0 has the largest ids; rows without an id come after all others, in ranges by hash
    @F.arrow_udf("int")
    def bucket(ids: pa.Array, ties: pa.Array) -> pa.Array:
        at = [len(bounds) - bisect_left(bounds, i) if i is not None else len(bounds) + 1 + ((t + (1 << 63)) >> 52) for i, t in zip(ids.to_pylist(), ties.to_pylist(), strict=True)]
        return pa.array(at, pa.int32())

    dealt = docs.withColumn("bucket", bucket("doc_id", "tie"))
    order = F.struct((-F.col("doc_id")).alias("less"), "tie")
    firsts = sorted(dealt.groupBy("bucket").agg(F.min(order).alias("o")).collect())
    before = [(firsts[k - 1]["bucket"], -r["o"]["less"] if r["o"]["less"] is not None else None, r["o"]["tie"]) for k, r in enumerate(firsts)]
    sent = docs.sparkSession.createDataFrame(before, "bucket int, first_id long, first_tie long")
    # the firsts are at most as many rows as there are ranges
    extra = docs.join(F.broadcast(sent), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")))
    extra = extra.select("doc_id", "text", "tie", "bucket", F.lit(1).alias("extra")).dropDuplicates(["bucket"])
    every = dealt.withColumn("extra", F.lit(0)).select("doc_id", "text", "tie", "bucket", "extra").unionByName(extra)
    by_order = every.repartition("bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "tie")
    return by_order.select("bucket", "doc_id", "extra", "text").mapInArrow(_edited(samples), _OUT)
