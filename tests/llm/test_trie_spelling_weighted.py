"""Weighted fingerprints, the prefix trie and spelling variants against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lethe.llm import queries
from lethe.llm.spelling import _cuts, near_words, runs_of, spelling_variants
from lethe.llm.trie import trie_nodes
from lethe.llm.weighted import SAMPLES, Sampler, edited_fingerprints, likeness, terms

DIR = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


# --- prefix trie


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for path, m in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in m if len(built[c]) == len(path))
        children = lambda p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].split()) for p in below if p)
        out.add((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children(path)), sum(not children(p) for p in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def made_conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), n):
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, None if t == 0 and rng.random() < 0.3 else t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "hi", "hi there", "a b  c\nd"])))
    rows += [(500, 1, "user", "same"), (500, 2, "user", "same"), (501, 1, "user", "same"), (501, 2, "user", "same"), (None, 1, "user", "x")]
    return rows


@pytest.mark.parametrize(("seed", "shard_rows"), [(1, 20_000), (2, 7), (3, 1)])
def test_trie_is_the_plain_one_whatever_the_shards(spark, seed, shard_rows):
    rows = made_conversations(seed, 60)
    got = trie_nodes(spark.createDataFrame(rows, TURNS), shard_rows=shard_rows).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plain_trie(rows)


def test_trie_of_no_conversation_of_copies_and_of_clashing_columns(spark):
    assert trie_nodes(spark.createDataFrame([], TURNS)).collect() == []
    rows = [(c, t, "user", f"say {t}") for c in range(300) for t in range(6)]
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], TURNS + ", base long, depth long, words long, n_convs string")
    got = sorted(trie_nodes(df, shard_rows=100).collect(), key=lambda r: r.depth)
    ids = ",".join(map(str, range(300)))
    assert [(r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves) for r in got] == [(0, d, 300, int(d < 6), 1) for d in range(7)]
    assert got[6].ends_sha256 == hashlib.sha256(ids.encode()).hexdigest() and got[0].saved_tokens == 6 * 299 * 2
    long = spark.createDataFrame([(7, t, "user", "w " * 50_000 if t == 3 else None) for t in range(3000)], TURNS)
    assert trie_nodes(long).where("n_children = 0").count() == 1


# --- spelling variants


def edits(a, b):
    """True for one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(docs):
    n = Counter()
    for i, text in docs:
        n.update(runs_of(i, (text or "").encode()))
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [v for v in n if edits(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def made_texts(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abçdé") for _ in range(rng.randint(6, 12))) for _ in range(25)]
    docs = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = stems[min(24, int(rng.expovariate(0.3)))]
            if rng.random() < 0.1:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", "é", w[at] * 2]) + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    return [*docs, (None, "onlyhere onlyhere"), (900, None), (901, ""), (902, "ÀÉÎÕÜß " * 3)]


@pytest.mark.parametrize("chunk", [1024, 3])
def test_variants_are_the_plain_ones_whatever_the_tiles(spark, chunk):
    docs = made_texts(chunk)
    got = spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), chunk=chunk).collect()
    assert len(got) == len({r.word for r in got})
    assert {tuple(r) for r in got} == plain_variants(docs)


def test_every_edit_of_every_length_shares_a_block(spark):
    rng = random.Random(5)
    for length in range(7, 20):
        w = "".join(rng.choice("ab") for _ in range(length))
        others = {w[:k] + x + w[k + j :] for k in range(length + 1) for j in (0, 1) for x in ("", "a", "c")} - {w}
        others = {v for v in others if edits(w, v) and len(v) >= 7}
        df = spark.createDataFrame([(x, 2) for x in (w, *others)], "word string, n long")
        assert {r.other for r in near_words(df).where(F.col("word") == w).collect()} == others
        assert all(x + y <= length for x, y in _cuts(length))


def test_runs_lose_a_code_point_by_document():
    w = "abcdéfgh"
    for i in range(400):
        h = zlib.crc32(f"{i}:{w}".encode())
        gone = h % len(w)
        want = w if h % 31 else w[:gone] + w[gone + 1 :]
        assert runs_of(i, f"1{w.upper().replace('É', 'é')}2 short".encode()) == {want: 1}


def test_variants_of_nothing_long_texts_and_clashing_columns(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "lengthy " * 400_000, "a", 1, "b"), (1, "lengthx lengthx", "a", 1, "b")], "doc_id long, text string, word string, n long, form string")
    got = {r.word: r for r in spelling_variants(df).collect()}
    assert len(got) == 2 and {r.root for r in got.values()} == {max(got, key=lambda w: got[w].n)}


# --- weighted fingerprints


def test_samples_agree_as_often_as_the_weights_do():
    rng = random.Random(3)
    sample, z = Sampler(), []
    for trial in range(300):  # words of its own for each, so that trials are independent
        a, b = ([f"{trial}{rng.choice('abcdefghijklmnopqrstuvwxyz'[: rng.randint(3, 26)])}" for _ in range(rng.randint(1, 200))] for _ in range(2))
        b = a[: rng.randint(0, len(a))] + b
        one, two = Counter(a), Counter(b)
        j = sum((one & two).values()) / sum((one | two).values())
        got = likeness(sample(" ".join(a).encode()), sample(" ".join(b).encode()))
        if 0 < j < 1:
            z.append((got - j) / np.sqrt(j * (1 - j) / SAMPLES))
        elif j == 1:
            assert got == 1
    assert abs(np.mean(z)) < 0.25 and 0.8 < np.std(z) < 1.25


def test_bags_keep_parts_of_long_words():
    assert terms(b" a b\ta ") == {b"a": 2, b"b": 1}
    assert terms(b"x" * 30) == {b"x" * 12: 2, b"x" * 6: 1}


def plain_edited(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    out = {}
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        a, b = a or "", b or ""
        m = len(a) // 3
        new = a[: len(a) - m] + b[:m]
        s = Sampler()
        p, q, r = s(a.encode()), s(new.encode()), s(b.encode())
        out[i] = (len(a), hashlib.sha256(new.encode()).hexdigest(), p.astype(">u2").tobytes().hex(), q.astype(">u2").tobytes().hex(), likeness(p, q), likeness(p, r))
    return out


@pytest.mark.parametrize("rows", [2000, 7, 1])
def test_edited_texts_follow_descending_ids_over_range_borders(spark, rows):
    rng = random.Random(rows)
    docs = [(i * 7 - 300, rng.choice([None, "", "é", "one two", " ".join(rng.choice("abcdeéü") * 3 for _ in range(rng.randint(1, 90)))])) for i in rng.sample(range(500), 120)]
    docs.append((None, "last of all"))
    df = spark.createDataFrame([(*d, 5, "x") for d in docs], "doc_id long, text string, bucket int, tie string")
    got = {r.doc_id: tuple(r)[1:] for r in edited_fingerprints(df, rows=rows).collect()}
    assert got == plain_edited(docs)


def test_fingerprints_of_nothing_one_copies_and_long_texts(spark):
    schema = "doc_id long, text string"
    assert edited_fingerprints(spark.createDataFrame([], schema)).collect() == []
    (one,) = edited_fingerprints(spark.createDataFrame([(1, "alone here")], schema)).collect()
    assert one.near_next == 1 and one.n_chars == 10
    rows = edited_fingerprints(spark.createDataFrame([(1, "same text")] * 3 + [(2, "same text"), (None, None), (None, "x"), (3, "w1 w2 " * 300_000)], schema), rows=2).collect()
    assert len(rows) == 7 and len({r.fingerprint for r in rows if r.n_chars == 9}) == 1
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {"0" * 4 * SAMPLES}


# --- against SQL


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_spelling_variants"])
def test_query_is_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    want = c.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    assert sorted(str([r[k] for k in columns]) for r in df.collect()) == sorted(str([dict(zip(want.columns, r, strict=True))[k] for k in columns]) for r in want.fetchall())
