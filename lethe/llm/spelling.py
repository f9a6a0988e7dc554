"""Spelling variants of the words of a corpus, by dense prefix-suffix tiles.

Two words are near if one code point is inserted, deleted or replaced: just then the
common prefix and the common suffix together reach the longer length minus one.

Words meet in blocks. With b the longer length, p the common prefix and g = b / 3
rounded up, x = g * floor(p / g) is one of three or four cuts, the two words agree in
x code points in front and in b - x - g behind, and both hash alike. So a word goes to
its blocks of b = its length and b = its length + 1, and no near pair is lost; a pair
counts in the block of its own cut only, hence once. A block of many words is cut into
chunks by hash, and each pair of chunks is a tile of its own, in whatever task.
In a tile, code points lie in padded matrices, one aligned left and one right, and all
pairs of a block are compared at once; only near pairs leave it.

Edge cases: null and blank texts have no words; rows without a doc_id keep their runs
unchanged, since nothing says which to alter; repeated rows count each; of forms with the same n the
smallest in code-point order wins; an empty table gives an empty result; other columns
are ignored. A text of any length is read whole; a task holds one text's words and at
most ``_HELD`` counted words before it passes them on.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, slices, texts

_HELD = 200_000
_PAIRS = 1 << 19
_LEAST = 7


def runs_of(doc_id: int | None, text: bytes, every: int = 31) -> Counter:
    """Runs of at least seven letters, in lower case, of which one in ``every`` has
    lost a code point; shorter ones can't become long enough."""
    found = Counter(re.findall(r"[a-zÀ-ÿ]{%d,}" % _LEAST, text.lower().decode("utf-8", "replace")))
    if doc_id is None:
        return found
    start = zlib.crc32(b"%d:" % doc_id)
    out = Counter()
    for w, n in found.items():
        h = zlib.crc32(w.encode(), start)
        if h % every == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
            if len(w) < _LEAST:
                continue
        out[w] += n
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return done

    for batch in batches:
        for part in slices(batch, "text"):
            for i, t in zip(part.column("doc_id").to_pylist(), texts(part.column("text")), strict=True):
                for w, n in runs_of(i, t or b"").items():
                    held[w] += n
                if len(held) >= _HELD:
                    yield out()
    if held:
        yield out()


def vocabulary(docs: DataFrame, least: int = 2) -> DataFrame:
    """word and n, its occurrences in all documents, of ``least`` or more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return rows.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _cuts(b: int) -> list[tuple[int, int]]:
    """How many code points a block of longer length ``b`` takes in front and behind."""
    g = -(-b // 3)
    return [(x, max(0, b - x - g)) for x in range(0, b, g)]


def _codes(words: list[str], width: int, right: bool) -> np.ndarray:
    """Latin-1 code points, a row for each word, padded on one side with zeros."""
    fill = str.rjust if right else str.ljust
    return np.frombuffer("".join([fill(w, width, "\0") for w in words]).encode("latin-1"), np.uint8).reshape(len(words), width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of a word: key (a hash of what is shared, the longer length
    and the cut), word, n."""
    for batch in batches:
        words, n = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy()
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            codes = _codes(words[own].tolist(), int(size), False)
            # sums over the first and over the last code points, by powers of odd numbers: equal texts have equal sums
            at = mix(np.arange(size, dtype=np.uint64)) | np.uint64(1)
            spread = mix(codes.astype(np.uint64))
            front, behind = np.cumsum(spread * at, axis=1), np.cumsum(spread[:, ::-1] * at, axis=1)
            zero = np.zeros(len(own), np.uint64)
            for b in (int(size), int(size) + 1):
                for k, (x, y) in enumerate(_cuts(b)):
                    head, tail = front[:, x - 1] if x else zero, behind[:, y - 1] if y else zero
                    key = mix(mix(head ^ np.uint64(k)) ^ (tail + np.uint64(b)))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(own), b, np.int32)), pa.array(np.full(len(own), x, np.int32)), pa.array(words[own], pa.string()), pa.array(n[own])], names=["key", "b", "x", "word", "n"])


def near_pairs(words: list[str], b: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of places (left, right) are single edits of a longer length ``b`` with
    the cut ``x``, both given for each pair."""
    sizes = np.array([len(w) for w in words], np.int32)
    width = int(sizes.max())
    fits = (np.maximum(sizes[left], sizes[right]) == b) & (np.minimum(sizes[left], sizes[right]) >= b - 1)
    out = np.zeros(len(left), bool)
    chosen = np.flatnonzero(fits)
    ahead, back = _codes(words, width, False), _codes(words, width, True)
    for at in range(0, len(chosen), 1 << 16):
        own = chosen[at : at + (1 << 16)]
        i, j, longer = left[own], right[own], b[own]
        least = np.minimum(sizes[i], sizes[j])
        prefix = np.minimum(np.where((ne := ahead[i] != ahead[j]).any(axis=1), ne.argmax(axis=1), width), least)
        suffix = np.minimum(np.where((ne := back[i, ::-1] != back[j, ::-1]).any(axis=1), ne.argmax(axis=1), width), least)
        # a cut of the block, so that a pair in several blocks counts in one
        g = -(-longer // 3)
        out[own] = (prefix + suffix >= longer - 1) & (prefix < longer) & (g * (prefix // g) == x[own])
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways, of tiles that lie one after the other in the rows."""
    names = ["key", "i", "j", "b", "x", "chunk", "word", "n"]

    def compare(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = {k: t.column(k).to_numpy() for k in names if k != "word"}
        words = t.column("word").to_pylist()
        new = np.ones(t.num_rows, bool)
        new[1:] = (np.diff(c["key"]) != 0) | (np.diff(c["i"]) != 0) | (np.diff(c["j"]) != 0) | (np.diff(c["b"]) != 0) | (np.diff(c["x"]) != 0)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], t.num_rows)
        # row r meets the rows after it in its tile: in a tile of two chunks only those of the other chunk
        until = np.repeat(ends, ends - starts)
        meets = until - np.arange(t.num_rows) - 1
        at = 0
        total = np.cumsum(meets)
        while at < t.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + _PAIRS, side="right")))
            m = meets[at:to]
            left = np.repeat(np.arange(at, to), m)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
            apart = (c["i"][left] == c["j"][left]) | (c["chunk"][left] != c["chunk"][right])
            left, right = left[apart], right[apart]
            if len(left):
                hit = near_pairs(words, c["b"][left], c["x"][left], left, right)
                u, v = np.concatenate([left[hit], right[hit]]), np.concatenate([right[hit], left[hit]])
                if len(u):
                    yield pa.RecordBatch.from_arrays([t.column("word").take(pa.array(u)), t.column("word").take(pa.array(v)), pa.array(c["n"][v])], names=["word", "other", "other_n"])
            at = to

    kept = None
    for batch in batches:
        t = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks().to_batches()[0]
        last = [t.column(k)[t.num_rows - 1].as_py() for k in names[:5]]
        tail = np.logical_and.reduce([t.column(k).to_numpy() == v for k, v in zip(names[:5], last, strict=True)])
        first = int(tail.argmax())  # the last tile may go on in the next batch
        if first:
            yield from compare(t.slice(0, first))
        kept = t.slice(first)
    if kept is not None:
        yield from compare(kept)


def near_words(words: DataFrame, chunk: int = 1024) -> DataFrame:
    """Rows (word, other, other_n), both ways, of all words (word, n) that are a single
    edit apart."""
    rows = materialise(words.select("word", "n").mapInArrow(_blocks, "key long, b int, x int, word string, n long"), "blocks")
    block = ["key", "b", "x"]
    sizes = rows.groupBy(*block).agg(F.count("*").alias("size")).where("size > 1")
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    dealt = rows.join(sizes, block).select(*block, "word", "n", chunks.alias("m")).withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("m")).cast("int"))
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j"))))
    dealt = dealt.withColumn("tile", tile).select("key", "tile.i", "tile.j", "b", "x", "chunk", "word", "n")
    by = ["key", "i", "j", "b", "x"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_tiles, "word string, other string, other_n long")


def spelling_variants(docs: DataFrame, least: int = 2, times: int = 10, chunk: int = 1024) -> DataFrame:
    """word, form (its near word of largest n, if that is ``times`` as large), root (the
    last of the forms' forms), n, n_near and form_n for every word."""
    words = materialise(vocabulary(docs, least), "words")
    near = near_words(words, chunk).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    best = F.when(-F.col("best.less") >= times * F.col("n"), F.col("best"))
    found = materialise(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), best.alias("form")), "forms")
    # n grows tenfold with each step, so forms lead to the last in few rounds of doubling
    steps = found.where("form is not null").select("word", F.col("form.other").alias("root"))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialise(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    out = found.join(steps, "word", "left")
    return out.select("word", F.col("form.other").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("form.less")).alias("form_n"))
