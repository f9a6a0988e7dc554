"""The classifiers against plain Python: counts, selection, weights and scores."""

import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lethe.llm import quality, toxicity

DIR = "/root/testdata/sf0.01"
MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DIR}/labels.parquet")


@pytest.fixture(scope="module")
def rows(tables):
    docs, labels = tables
    return {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r for r in labels.collect()}


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def words_of(text):
    """Words as the toxicity folding has them, letter by letter."""
    looks, latin = "абвгеіјкмнорстухѕһԁԛԝαβγεικνορτυχωѵ", "abbreijkmhopctyxshdqwabyeikvoptuxwv"
    leet = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
    out = []
    text = "".join(latin[looks.index(c)] if c in looks else "" if c in "­​‌‍⁠﻿" else chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) < 0xFF5F else c for c in unicodedata.normalize("NFC", text.lower()))
    for w in re.findall(r"[@$]*[^\W_]+(?:[@$]+[^\W_]+)*", text):
        if re.search(r"[0-9@$]", w):
            if not any(c.isalpha() for c in w):
                continue
            w = "".join(leet.get(c, c) for c in w)
        out.append(w)
    return out


def in_plain_python(texts, labels):
    """Terms, phrases and the training rows of a toxicity lexicon."""
    train = [(i, words_of(texts[i]), labels[i].toxic) for i in sorted(labels) if i in texts and labels[i].toxic in (0, 1) and not held_out(i)]
    n, ones = len(train), sum(y for *_, y in train)
    one, every = Counter(), Counter()
    for _, ws, y in train:
        for w in set(ws):
            # a word counts once in a row for each of its forms
            for term in {f" {w} ", *(f" {w[:k]}" for k in (3, 4, 5, 6, 7) if len(w) >= k)}:
                every[term] += 1
                one[term] += y
    weight = {t: math.log((one[t] + 0.5) / (ones + 1)) - math.log((every[t] - one[t] + 0.5) / (n - ones + 1)) for t in every}
    sure = {}
    for t in every:
        if every[t] >= 5:
            a, b, p = one[t], every[t] - one[t], ones / n
            chance = [(a, a / (every[t] * p)), (b, b / (every[t] * (1 - p)))]
            sure[t] = math.floor(20 * sum(k * math.log(x) for k, x in chance if k)) if a > every[t] * p else 0
    cut = least_sure(list(sure.values()), lambda step: math.erfc(math.sqrt(step / 20)) / 2, len(sure))
    passed = {t for t in sure if one[t] >= 5 and weight[t] >= 1.5 and sure[t] >= cut}
    general = {t for t in passed if not any(u != t and u.startswith(t) and one[u] >= 0.8 * one[t] for u in passed)}
    terms = {}
    for t in sorted(general, key=len):
        if not any(t.startswith(s) and s != t and w >= weight[t] - 0.3 for s, w in terms.items()):
            terms[t] = weight[t]
    return train, terms


def least_sure(steps, tail, candidates):
    """The least step at which chance gives at most 30 % of what is kept."""
    return min((s for s in set(steps) if candidates * tail(s) <= 0.3 * sum(t >= s for t in steps)), default=math.inf)


def matches(words, terms, phrases):
    best = {}
    for i, w in enumerate(words):
        own = [x for t, x in terms.items() if f" {w} ".startswith(t)]
        around = {tuple(words[i - 1 : i + 1]) if i else (), tuple(words[i : i + 2])}
        if own and not around & phrases:
            best[i] = max(own)
    return best


def test_sliced_lexicon_scores_alike(spark, tables):
    """A lexicon of several slices against the whole, with repeated rows and rows without ids."""
    docs, labels = tables
    more = docs.unionAll(docs.where("doc_id % 10 = 3")).unionAll(docs.where("doc_id % 10 = 4").selectExpr("null", "text"))
    whole, sliced = toxicity.learn(docs, labels), toxicity.learn(docs, labels, memory=4_000)
    assert isinstance(sliced, toxicity.Slices) and sliced.count > 2 and np.allclose(sliced.curve, whole.curve, atol=1e-6)
    parts = [sliced.part(j) for j in range(sliced.count)]
    assert sum(len(p.terms) for p in parts) == len(whole.terms) and set().union(*(p.phrases for p in parts)) == whole.phrases
    rows = [sorted(((r.doc_id is None, r.doc_id, round(r.score, 6)) for r in toxicity.toxicity_scores(more, labels, lexicon=x).collect()), key=str) for x in (whole, sliced)]
    assert len(rows[0]) == more.count() and rows[0] == rows[1]


def test_discovery_cut():
    assert toxicity.discovery_cut({}, 0, lambda s: 1.0, 0.05) is None and toxicity.discovery_cut({0: 100, 3: 2}, 102, lambda s: 0.5, 0.05) is None
    # 10 rows at 30 against 102 * 0.001 by chance; at 20 still 12 rows against 0.5
    assert toxicity.discovery_cut({0: 90, 20: 2, 30: 10}, 102, lambda s: {0: 0.5, 20: 0.005, 30: 0.001}[s], 0.05) == 20


def test_toxicity_in_plain_python(tables, rows):
    docs, labels = tables
    texts, known = rows
    train, terms = in_plain_python(texts, known)
    lexicon = toxicity.learn(docs, labels)
    assert lexicon.terms.keys() == terms.keys() and all(abs(lexicon.terms[t] - w) < 1e-9 for t, w in terms.items()) and len(terms) > 20
    one, every = Counter(), Counter()
    for _, ws, y in train:
        pairs = {p for i in matches(ws, terms, set()) for p in (tuple(ws[max(0, i - 1) : i + 1]), tuple(ws[i : i + 2])) if len(p) == 2}
        every.update(pairs)
        one.update(pairs if y else ())
    often = [p for p in every if every[p] >= 5]
    usual = sum(one[p] for p in often) / max(1, sum(every[p] for p in often))
    enough = least_sure([every[p] for p in often if not one[p]], lambda k: (1 - usual) ** k, len(often))
    phrases = {p for p in often if not one[p] and every[p] >= enough}
    assert lexicon.phrases == phrases

    def score(text):
        ws = words_of(text)
        found = matches(ws, terms, phrases)
        total, size = sum(found.values()), max(len(ws), 20)
        x = [max(found.values(), default=0.0), math.log1p(total), math.log1p(100 * total / size), math.log1p(100 * len(found) / size), float(bool(found))]
        return 1 / (1 + math.exp(-min(35, max(-35, float(np.dot(x, lexicon.curve[:-1]) + lexicon.curve[-1])))))

    # the curve is where the penalised likelihood is level
    slope = np.zeros(6)
    for _, ws, y in train:
        found = matches(ws, terms, phrases)
        total, size = sum(found.values()), max(len(ws), 20)
        x = np.array([max(found.values(), default=0.0), math.log1p(total), math.log1p(100 * total / size), math.log1p(100 * len(found) / size), float(bool(found)), 1.0])
        slope += (y - 1 / (1 + math.exp(-min(35, max(-35, float(x @ lexicon.curve)))))) * x
    assert np.abs(slope - 1e-2 * lexicon.curve).max() < 1e-4
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels, lexicon=lexicon).collect()}
    assert got.keys() == texts.keys()
    assert all(abs(r.score - score(texts[i])) < 1e-9 and r.held_out == held_out(i) and r.predicted == int(r.score >= 0.5) for i, r in got.items())


def mix(x):
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def places_of(text, bits=18):
    """Places of word and shape n-grams, one at a time."""
    words = text.encode().split()
    shapes, before = [], None
    for w in words:
        lead, core, tail = re.match(rb"^([^0-9A-Za-z\x80-\xff]*)(.*?)([^0-9A-Za-z\x80-\xff]*)$", w, re.S).groups()
        c = core.decode("utf-8", "replace")
        kind = "n" if not c else "9" if c.isdigit() else "x" if any(x.isdigit() for x in c) else "A" if c.isupper() and len(c) > 1 else "C" if c[0].isupper() else "a"
        shape = xxhash.xxh64_intdigest(kind.encode() + b"\0" + lead[:2] + b"\0" + tail[:3])
        shapes.append(shape ^ (0x5D if before == w.lower() else 0))
        before = w.lower()
    out = {mix(xxhash.xxh64_intdigest(w.lower())) for w in words} | {mix(s ^ 1) for s in shapes}
    for n in (2, 3):
        for k in range(len(shapes) - n + 1):
            run = shapes[k]
            for s in shapes[k + 1 : k + n]:
                run = mix(run) ^ s
            out.add(mix(run ^ n))
    return sorted({h >> (64 - bits) for h in out})


def test_quality_in_plain_python(tables, rows):
    docs, labels = tables
    texts, known = rows
    model = quality.fit(docs, labels)
    train = [(places_of(texts[i]), known[i].quality) for i in sorted(known) if i in texts and known[i].quality in (0, 1) and not held_out(i)]
    one, every, ones = Counter(), Counter(), sum(y for _, y in train)
    for places, y in train:
        every.update(places)
        one.update(places if y else ())
    ratio = {p: math.log((one[p] + 1) / (ones + 2)) - math.log((every[p] - one[p] + 1) / (len(train) - ones + 2)) for p in every}
    assert set(np.flatnonzero(model.scale)) <= ratio.keys() and all(abs(model.scale[p] - r) < 1e-5 for p, r in ratio.items())

    def score(text):
        places = places_of(text)
        size = math.sqrt(sum(ratio.get(p, 0.0) ** 2 for p in places))
        margin = sum(float(model.weights[p]) * ratio.get(p, 0.0) for p in places) / max(1e-12, size) + model.bias
        return 1 / (1 + math.exp(-min(35, max(-35, model.slope * margin + model.offset))))

    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert got.keys() == texts.keys()
    assert all(abs(r.score - score(texts[i])) < 1e-4 and r.held_out == held_out(i) and r.predicted == int(r.score >= 0.3) for i, r in got.items())


def test_dual_coordinate_descent_finds_the_least_loss():
    """The primal objective at the found weights is close to the dual's, which bounds it."""
    r = np.random.default_rng(3)
    scale = r.normal(size=60)
    rows = [np.sort(r.choice(60, 12, replace=False)) for _ in range(200)]
    y = np.where(np.array([scale[x].sum() for x in rows]) + r.normal(size=200) > 0, 1, -1)
    w, bias = quality.descend(rows, y, scale, rounds=2000)
    values = [scale[x] / np.linalg.norm(scale[x]) for x in rows]
    loss = lambda w, b: 0.5 * (w @ w + b * b) + sum(max(0.0, 1 - yi * (w[x] @ v + b)) for x, v, yi in zip(rows, values, y))
    best = loss(w, bias)
    for _ in range(300):
        assert loss(w + r.normal(size=60) * 0.02, bias + r.normal() * 0.02) > best - 0.05
