"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams: of its words (hashed), and of its
words' shapes (case, punctuation around them, whether the word repeats the one
before). Every indicator is scaled by its log-count ratio between the classes,
counted over all labelled rows that may be learned from; a linear hinge-loss
model is then fitted on the scaled indicators by dual coordinate descent, and
its margin is turned into a probability by a logistic fit on rows that the
descent didn't see.

Bounds: features are hashed into 2**``bits`` places, so the model has a fixed
size; the descent takes at most ``sample`` rows, chosen by hash of doc_id.

Edge cases: null texts count as empty, and an empty text has no indicators: its
score is the one of the intercept. Without labels of both classes all scores
are the share of label 1 (a half without any). Repeated rows get one score each, the
same; rows without a doc_id are scored, their held_out is null, and none is learned from;
features that share a place share its weight; an empty table gives an empty result. Texts of
any length are read whole; a task holds one text's n-grams at a time besides the model.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, keep_rows, materialise, mix, slices, texts
from .labels import bounded_sample, labelled, lists, logistic, sigmoid

_EDGES = re.compile(rb"^([^0-9A-Za-z\x80-\xff]*)(.*?)([^0-9A-Za-z\x80-\xff]*)$", re.S)
_SAME = np.uint64(0x5D)


def _shape(word: bytes) -> int:
    lead, core, tail = _EDGES.match(word).groups()
    core = core.decode("utf-8", "replace")
    kind = "n" if not core else "9" if core.isdigit() else "x" if any(c.isdigit() for c in core) else "A" if core.isupper() and len(core) > 1 else "C" if core[0].isupper() else "a"
    return xxhash.xxh64_intdigest(kind.encode() + b"\0" + lead[:2] + b"\0" + tail[:3])


class Features:
    """Indicators of word and shape n-grams, as sorted places below 2**bits."""

    def __init__(self, bits: int = 18, orders: int = 3, words: bool = True):
        self.bits, self.orders, self.words = bits, orders, words
        self.shapes: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        if not words:
            return np.zeros(0, np.int32)
        known = self.shapes
        if len(known) > 200_000:
            known.clear()
        s = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            v = known.get(w)
            if v is None:
                v = known[w] = _shape(w)
            s[i] = v
        h = np.fromiter(map(hash_word, words), np.uint64, len(words))
        s[1:] ^= np.where(h[1:] == h[:-1], _SAME, np.uint64(0))
        found = [mix(s ^ np.uint64(1))]
        run = s
        for n in range(2, self.orders + 1):
            run = mix(run[:-1]) ^ s[n - 1 :]
            found.append(mix(run ^ np.uint64(n)))
        if self.words:
            found.append(mix(h))
        return np.unique(np.concatenate(found) >> np.uint64(64 - self.bits)).astype(np.int32)


def hash_word(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word.lower())


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 1.0, rounds: int = 25, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for a hinge-loss model over scaled indicators; y is
    1 or -1. Returns weights (by place) and bias. Rows are scaled to unit length."""
    w, bias = np.zeros(len(scale)), 0.0
    values = [scale[r] for r in rows]
    values = [v / max(1e-12, np.sqrt(v @ v)) for v in values]
    norm = np.array([v @ v + 1.0 for v in values])
    dual = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)):
            r, v = rows[i], values[i]
            slope = y[i] * (w[r] @ v + bias) - 1
            now = min(max(dual[i] - slope / norm[i], 0.0), c)
            move = (now - dual[i]) * y[i]
            if move:
                worst = max(worst, abs(move))
                w[r] += move * v
                bias += move
                dual[i] = now
        if worst < 1e-3:
            break
    return w, bias


class Model:
    """Weights by place, bias, and the slope and offset of the calibration."""

    def __init__(self, weights: np.ndarray, scale: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.scale, self.bias, self.slope, self.offset = weights.astype(np.float32), scale.astype(np.float32), bias, slope, offset

    def margin(self, places: np.ndarray) -> float:
        v = self.scale[places].astype(np.float64)
        size = np.sqrt(v @ v)
        return float(self.weights[places] @ v / max(1e-12, size)) + self.bias

    def score(self, places: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.margin(places) + self.offset))


def _extract(bits: int, orders: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits, orders, words)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([features(t) for t in texts(part.column("text"))], pa.list_(pa.int32()))], names=["doc_id", "y", "places"])

    return run


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", bits: int = 18, orders: int = 3, words: bool = True, sample: int = 8_000, smooth: float = 1.0) -> Model:
    rows = materialise(labelled(docs, labels, target).mapInArrow(_extract(bits, orders, words), "doc_id long, y double, places array<int>"), "features")
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    none = np.zeros(1 << bits)
    if not n or ones in (0, n):
        share = ones / n if n else 0.5
        return Model(none, none, 0.0, 0.0, float(np.log((share * n + 0.5) / (n - share * n + 0.5))) if n else 0.0)
    counts = rows.select("y", F.explode("places").alias("place")).groupBy("place").agg(F.sum("y").alias("one"), F.count("*").alias("all"))
    one, every = np.full(1 << bits, smooth), np.full(1 << bits, 2 * smooth)
    found = counts.toArrow()  # at most 2**bits rows
    at = found.column("place").to_numpy()
    one[at] += found.column("one").to_numpy()
    every[at] += found.column("all").to_numpy()
    scale = np.log(one / (ones + 2 * smooth)) - np.log((every - one) / (n - ones + 2 * smooth))
    scale[every == 2 * smooth] = 0
    taken = bounded_sample(rows, n, sample)
    places = lists(taken.column("places"))
    y = 2 * taken.column("y").to_numpy() - 1
    aside = np.arange(len(places)) % 4 == 0
    learn = np.flatnonzero(~aside)
    w, bias = descend([places[i] for i in learn], y[learn], scale)
    model = Model(w, scale, bias, 1.0, 0.0)
    margins = np.array([model.margin(places[i]) for i in np.flatnonzero(aside)])
    if len(margins):
        model.slope, model.offset = logistic(margins[:, None], (y[aside] + 1) / 2, ridge=1e-1)
    return model


def _score(shared, bits: int, orders: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(bits, orders, words), shared.value
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([model.score(features(t)) for t in texts(part.column("text"))], pa.float64())], names=["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = 0.3, bits: int = 18, orders: int = 3, words: bool = True, **more) -> DataFrame:
    """doc_id, held_out, score (likelihood of label 1) and predicted for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, target, bits, orders, words, **more))  # 2**bits pairs of floats
    scored = docs.mapInArrow(_score(model, bits, orders, words), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = 0.3, bits: int = 18, orders: int = 3, words: bool = True, **more) -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, target, bits, orders, words, **more))

    def decide():
        features = Features(bits, orders, words)
        return lambda part: [model.value.score(features(t)) >= threshold for t in texts(part.column("text"))]

    return keep_rows(docs, decide)
