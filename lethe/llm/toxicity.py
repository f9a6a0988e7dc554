"""Toxicity scoring by a weighted lexicon.

Texts are folded first: lower case, look-alike letters of other scripts to
Latin, full-width forms to ASCII, digits and signs that stand for letters to
those letters, and invisible characters dropped. A lexicon of terms is matched
by one Aho-Corasick automaton at word starts; of a word's matches the heaviest
counts, unless it lies in an exception phrase. The weights' sum, normalised by
length, and the share and number of matches give the score by a logistic curve.

The lexicon is learned from labelled rows: candidates are whole words and their
prefixes (stems, for languages that compound), weighted by the log ratio of how
often either class has them. Exception phrases are pairs of neighbouring words
around a term that only occur in clean rows; more may be given.

How sure a term is, is tested: the likelihood ratio of its counts against chance, with
the cut of Benjamini and Hochberg over all candidates, so that the share of chance terms
stays below ``chance`` at any size and the lexicon grows only with words that do mark a
class (a chance term costs little, since the curve weighs all matches; a missed one costs
documents, hence 0.3). Phrases likewise: so many clean rows and no other are no chance.

Bounds: what a lexicon takes in a worker's memory is summed in Spark before any of it is
collected. Up to ``memory`` bytes (some 85,000 terms) it is collected and broadcast whole.
Beyond that it goes in slices of that size, one after the other: a word's terms all begin
with its first letters, by which slices are dealt, so that each slice judges its own words
alone, and sums of all slices are put together for each document. The curve is fitted on at
most ``sample`` rows, chosen by hash of doc_id. Counts cover all rows that may be learned from.

Edge cases: null counts as empty; texts without a match get the curve's value
for zero; without labels of both classes the lexicon is empty and all scores
are the share of label 1 (0 without any); repeated rows get one score each, the same;
rows without a doc_id are scored, their held_out is null, and none is learned from; of several
labels of one doc_id the largest counts; terms of equal weight are all kept, and of a
word's matches of equal weight it doesn't matter which counts; an empty table gives an empty
result. Texts of any length are folded and matched whole; a task holds one text's words and
matches at a time besides the lexicon. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialise, slices
from .labels import bounded_sample, hashed_share, labelled, logistic, sigmoid

#: Letters of other scripts that look like Latin ones, in two aligned rows.
_LOOKS = "абвгеіјкмнорстухѕһԁԛԝαβγεικνορτυχωѵ"
_LATIN = "abbreijkmhopctyxshdqwabyeikvoptuxwv"
#: Digits and signs that stand for letters.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_HIDDEN = "­​‌‍⁠﻿"

_TABLE = {ord(a): b for a, b in zip(_LOOKS, _LATIN, strict=True)} | {ord(c): None for c in _HIDDEN} | {i: chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F)}
#: Bytes of a worker's memory that a lexicon, or a slice of one, may take.
MEMORY = 64 << 20
#: Bytes for an entry and for each byte of its letters: terms (automaton and weights), phrases.
_TERM, _PHRASE = (300, 60), (250, 1)
#: Steps of the test's statistic, tenths up to 1,000.
_STEPS = 10_000
_WORDS = re.compile(r"[@$]*[^\W_]+(?:[@$]+[^\W_]+)*")
_DIGIT = re.compile(r"[0-9@$]")


def folded(text: str | None) -> list[str]:
    """The words of a text, folded. Words without a letter are left out."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).translate(_TABLE)
    out = []
    for w in _WORDS.findall(text):
        if not w.isalpha() and _DIGIT.search(w):
            if not any(map(str.isalpha, w)):
                continue
            w = "".join(_LEET.get(c, c) for c in w)
        out.append(w)
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each word, by class, summed within a part of a batch."""
    for batch in batches:
        for part in slices(batch, "text"):
            one, every = Counter(), Counter()
            for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                words = set(folded(text))
                every.update(words)
                if y:
                    one.update(words)
            yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array([one[w] for w in every], pa.int64()), pa.array(list(every.values()), pa.int64())], names=["word", "one", "every"])


class Lexicon:
    """Terms with weights (a leading space marks a word's start, a trailing one
    its end) and exception phrases of two words. Picklable; the automaton is
    built once in each worker."""

    def __init__(self, terms: dict[str, float], phrases: set[tuple[str, str]] | frozenset = frozenset(), curve: np.ndarray | None = None):
        self.terms, self.phrases, self.curve = terms, phrases, curve

    def automaton(self):
        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w))
        if self.terms:
            a.make_automaton()
        return a

    def matches(self, words: list[str], automaton) -> dict[int, float]:
        """Weight of the heaviest term in each word that has one, by the word's index."""
        if not self.terms or not words:
            return {}
        text = " " + " ".join(words) + " "
        best: dict[int, float] = {}
        for end, (size, weight) in automaton.iter(text):
            at = end - size + 1
            if weight > best.get(at, 0.0):
                best[at] = weight
        if not best:
            return {}
        starts = {}
        at = 0
        for i, w in enumerate(words):
            if at in best:
                starts[i] = best[at]
            at += len(w) + 1
        if self.phrases:
            starts = {i: w for i, w in starts.items() if not ((i and (words[i - 1], words[i]) in self.phrases) or (i + 1 < len(words) and (words[i], words[i + 1]) in self.phrases))}
        return starts

    def sums(self, words: list[str], automaton) -> tuple[float, float, int, int]:
        """Heaviest and summed weight of the matches, their number, and the number of words."""
        found = self.matches(words, automaton)
        return max(found.values(), default=0.0), sum(found.values()), len(found), len(words)


def traits(top, total, n, size) -> np.ndarray:
    """What the curve takes: heaviest weight, summed weight, and both the
    weight and the count of matches for a hundred words (as logarithms)."""
    top, total, n, size = (np.asarray(x, float) for x in (top, total, n, size))
    size = np.maximum(size, 20)
    return np.column_stack([top, np.log1p(total), np.log1p(100 * total / size), np.log1p(100 * n / size), n > 0])


class Slices:
    """A lexicon of any size: written terms and phrases, of which one slice at a time
    is collected. ``length`` letters (with the leading space) deal words to slices."""

    def __init__(self, terms: DataFrame, phrases: DataFrame, given: set[tuple[str, str]], length: int, memory: int):
        self.terms, self.phrases, self.given, self.length = terms, phrases, given, length
        of = lambda sizes, *names: F.coalesce(F.sum(F.lit(sizes[0]) + sizes[1] * sum(F.octet_length(c) for c in names)), F.lit(0))
        self.size = terms.agg(of(_TERM, "term")).first()[0] + phrases.agg(of(_PHRASE, "a", "b")).first()[0]
        self.count, self.curve = max(1, -(-self.size // memory)), None

    def _dealt(self, spaced: Column) -> Column:
        return F.crc32(F.substring(spaced, 1, self.length)) % self.count

    def part(self, j: int) -> Lexicon:
        """Terms of one slice, and the phrases in which a word of it stands."""
        word = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
        terms = self.terms.where(self._dealt(F.col("term")) == j).orderBy("term").toArrow()
        phrases = self.phrases.where((self._dealt(word("a")) == j) | (self._dealt(word("b")) == j)).select("a", "b").toArrow()
        named = dict(zip(terms.column("term").to_pylist(), terms.column("weight").to_pylist(), strict=True))
        return Lexicon(named, self.given | set(zip(phrases.column("a").to_pylist(), phrases.column("b").to_pylist(), strict=True)), self.curve)

    def each(self, run, what: str) -> DataFrame:
        """The rows that ``run(shared lexicon, number)`` gives for all slices, each slice's
        written before the next one is sent."""
        out = None
        for j in range(self.count):
            shared = self.terms.sparkSession.sparkContext.broadcast(self.part(j))
            rows = run(shared, j)
            if self.count > 1:
                rows = materialise(rows, f"{what}-{j}")
                shared.destroy()
            out = out.unionAll(rows) if out is not None else rows
        return out


def _count_phrases(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        automaton = lexicon.automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                one, every = Counter(), Counter()
                for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                    words = folded(text)
                    pairs = set()
                    for i in lexicon.matches(words, automaton):
                        pairs.update(p for p in (tuple(words[max(0, i - 1) : i + 1]), tuple(words[i : i + 2])) if len(p) == 2)
                    every.update(pairs)
                    if y:
                        one.update(pairs)
                first, second = zip(*every, strict=True) if every else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array([one[p] for p in every], pa.int64()), pa.array(list(every.values()), pa.int64())], names=["a", "b", "one", "every"])

    return run


_SUMS = "doc_id long, top double, total double, n long, size long, y double, digest binary, slice int"


def _sums(shared, j: int):
    """What a slice finds in each row; texts are named by a digest, since rows may share a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        automaton = lexicon.automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                sums = zip(*[lexicon.sums(folded(t), automaton) for t in texts], strict=True)
                digests = pa.array([xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.binary())
                found = [pa.array(x, t) for x, t in zip(sums, (pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found, part.column("y"), digests, pa.array([j] * len(texts), pa.int32())], names=[c.split()[0] for c in _SUMS.split(", ")])

    return run


def _sliced_sums(rows: DataFrame, lexicon: Slices) -> DataFrame:
    """Sums over all slices, a row for each row."""
    found = lexicon.each(lambda shared, j: rows.mapInArrow(_sums(shared, j), _SUMS), "sums")
    if lexicon.count == 1:
        return found
    copies = F.count_if(F.col("slice") == 0)
    whole = found.groupBy("doc_id", "digest", "y").agg(copies.alias("copies"), F.max("top").alias("top"), (F.sum("total") / copies).alias("total"), (F.sum("n") / copies).cast("long").alias("n"), F.max("size").alias("size"))
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def _scores(curve: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = traits(*(batch.column(c).to_numpy() for c in ("top", "total", "n", "size")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(x @ curve[:-1] + curve[-1]))], names=["doc_id", "score"])

    return run


def discovery_cut(counts: dict[int, int], candidates: int, tail, chance: float) -> int | None:
    """The least step of a statistic at which chance would give at most a share ``chance``
    of the rows at or above it (Benjamini and Hochberg); None if there is none."""
    above, cut = 0, None
    for step in sorted(counts, reverse=True):
        above += counts[step]
        if candidates * tail(step) <= chance * above:
            cut = step
    return cut


def _histogram(rows: DataFrame, step: Column) -> dict[int, int]:
    """Rows by step, at most ``_STEPS`` + 1 of them."""
    return {r.step: r["count"] for r in rows.groupBy(F.least(step, F.lit(_STEPS)).cast("int").alias("step")).count().collect()}


def learn(docs: DataFrame, labels: DataFrame, target: str = "toxic", support: int = 5, heaviest: float = 1.5, prefixes: tuple[int, ...] = (3, 4, 5, 6, 7), sample: int = 20_000, exceptions: tuple[str, ...] = (), chance: float = 0.3, memory: int = MEMORY) -> Lexicon | Slices:
    """A lexicon, or slices of one where it is larger than ``memory``."""
    rows = labelled(docs, labels, target)
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    given = {tuple(folded(p)) for p in exceptions}
    if not n or ones in (0, n):
        return Lexicon({}, given, np.array([0.0] * 5 + [35.0 if ones else -35.0]))
    words = materialise(rows.mapInArrow(_count_words, "word string, one long, every long").groupBy("word").agg(F.sum("one").alias("one"), F.sum("every").alias("every")), "words")
    cut = F.array(F.concat(F.lit(" "), "word", F.lit(" ")), *[F.when(F.length("word") >= k, F.concat(F.lit(" "), F.substring("word", 1, k))) for k in prefixes])
    counts = words.select(F.explode(cut).alias("term"), "one", "every").where("term is not null").groupBy("term").agg(F.sum("one").alias("one"), F.sum("every").alias("every"))
    smooth, zero, share = 0.5, F.col("every") - F.col("one"), ones / n
    weight = F.log((F.col("one") + smooth) / (ones + 1)) - F.log((zero + smooth) / (n - ones + 1))
    part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("every") * p))).otherwise(0.0)
    ratio = F.when(F.col("one") > F.col("every") * share, F.floor(20 * (part(F.col("one"), share) + part(zero, 1 - share)))).otherwise(0)
    candidates = materialise(counts.where(F.col("every") >= support).select("term", "one", weight.alias("weight"), ratio.alias("ratio")), "candidates")
    steps = _histogram(candidates, F.col("ratio"))
    # the statistic's tail is that of a squared normal variable, one side of it
    sure = discovery_cut(steps, sum(steps.values()), lambda step: math.erfc(math.sqrt(step / 20)) / 2, chance)
    passed = candidates.select("term", "one", "weight").where((F.col("one") >= support) & (F.col("weight") >= heaviest) & (F.col("ratio") >= (math.inf if sure is None else sure)))
    # a term and its longer forms share their first letters, so each group is pruned on its own
    length = 1 + min(prefixes, default=1)
    terms = materialise(passed.groupBy(F.substring("term", 1, length)).applyInArrow(_pruned_group, "term string, weight double"), "terms")
    lexicon = Slices(terms, terms.sparkSession.createDataFrame([], "a string, b string"), given, length, memory)
    summed = lambda shared, _: rows.mapInArrow(_count_phrases(shared), "a string, b string, one long, every long").groupBy("a", "b").agg(F.sum("one").alias("one"), F.sum("every").alias("every"))
    # whether a word matches doesn't depend on where it stands, so slices that both have a pair count the same rows
    pairs = materialise(lexicon.each(summed, "pairs").groupBy("a", "b").agg(F.max("one").alias("one"), F.max("every").alias("every")).where(F.col("every") >= support), "pairs")
    toxic, every = pairs.agg(F.sum("one"), F.sum("every")).first()
    clean = pairs.where("one = 0")
    usual = (toxic or 0) / every if every else 0.0
    enough = discovery_cut(_histogram(clean, F.col("every")), pairs.count(), lambda step: (1 - usual) ** step, chance)
    phrases = clean.where(F.col("every") >= (math.inf if enough is None else enough)).select("a", "b")
    lexicon = Slices(terms, phrases, given, length, memory)
    whole = lexicon.part(0) if lexicon.count == 1 else None
    taken = bounded_sample(_sliced_sums(hashed_share(rows, n, sample), lexicon).select("doc_id", "y", "top", "total", "n", "size"), n, sample)
    curve = logistic(traits(*(taken.column(c).to_numpy() for c in ("top", "total", "n", "size"))), taken.column("y").to_numpy())
    lexicon.curve = curve
    if whole:
        whole.curve = curve
    return whole or lexicon


def _pruned(terms: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Leave out prefixes that nearly only one longer term fills (the longer one is
    meant), then terms that a shorter one of nearly the same weight stands for."""
    longer: dict[str, int] = {}
    for t, (_, n) in terms.items():
        for k in range(2, len(t)):
            longer[t[:k]] = max(longer.get(t[:k], 0), n)
    general = {t: w for t, (w, n) in terms.items() if longer.get(t, 0) < 0.8 * n}
    out: dict[str, float] = {}
    for t in sorted(general, key=len):
        shorter = [out[t[:k]] for k in range(2, len(t)) if t[:k] in out]
        if not any(w >= general[t] - 0.3 for w in shorter):
            out[t] = general[t]
    return out


def _pruned_group(rows: pa.Table) -> pa.Table:
    terms, weights, ones = (rows.column(c).to_pylist() for c in ("term", "weight", "one"))
    left = _pruned(dict(zip(terms, zip(weights, ones, strict=True), strict=True)))
    return pa.table({"term": pa.array(list(left), pa.string()), "weight": pa.array(list(left.values()), pa.float64())})


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, lexicon: Lexicon | Slices | None = None, **more) -> DataFrame:
    """doc_id, held_out, score (likelihood of label 1) and predicted for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("double").alias("y"))
    lexicon = lexicon or learn(docs.drop("y"), labels, **more)
    if isinstance(lexicon, Slices):
        found = _sliced_sums(docs, lexicon)
    else:
        found = docs.mapInArrow(_sums(docs.sparkSession.sparkContext.broadcast(lexicon), 0), _SUMS)
    scored = found.select("doc_id", "top", "total", "n", "size").mapInArrow(_scores(lexicon.curve), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
