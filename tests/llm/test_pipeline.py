"""The pipeline's stages against brute force."""

import re
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline  # noqa: E402
from lethe.llm import quality, simhash, spm  # noqa: E402
from lethe.llm.decontam import item_words  # noqa: E402

DIR = "/root/testdata/sf0.001"


def jaccard_roots(texts, least, shingle=5):
    sets = {i: set(simhash.shingle_hashes((t or "").encode(), shingle).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common >= least * (len(sets[a] | sets[b])):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in texts}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    after = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert name == "tokens" or out.columns == docs.columns
        after[name], docs = {r.doc_id: r for r in out.collect()}, out
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    good = {r.doc_id for r in quality.quality_scores(spark.read.parquet(f"{DIR}/documents.parquet"), labels).where("predicted = 1").collect()}
    assert set(after["quality"]) == good

    groups = defaultdict(list)
    for i in good:
        groups[re.sub("[\x20\x09-\x0d]+", " ", texts[i])].append(i)
    exact = {min(g) for g in groups.values()}
    assert set(after["exact dedup"]) == exact

    root = jaccard_roots({i: texts[i] for i in exact}, 0.8)
    near = {i for i in exact if root[i] == i}
    assert set(after["near dedup"]) == near

    windows = set()
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = item_words(r.text.encode())
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}

    def hit(t):
        w = item_words(t.encode())
        return any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))

    clean = {i for i in near if not hit(texts[i])}
    assert set(after["decontamination"]) == clean == set(after["tokens"])
    encoder = spm.Encoder(spm.Vocabulary(spm.default_model()))
    assert all(encoder.decode(list(r.ids)) == texts[i] for i, r in after["tokens"].items())


def test_run_on_awkward_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "a b c", None), (3, "a b c", None), (4, "a  b c", "t")], "doc_id long, text string, source string").withColumn("score", F.lit(1))
    for name, df in {"documents": rows, "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, None)], "item_id long, text string")}.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.doc_id: r.n_tokens for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 3}
    rows.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_similar_components(spark, similarity):
    """Copies with a few words changed; a component's documents are a brute-force one's."""
    import random

    r = random.Random(9)
    texts = {}
    for c in range(30):
        base = [f"w{r.randrange(400)}" for _ in range(r.randrange(60, 300))]
        for k in range(6):
            own = list(base)
            for _ in range(k * len(own) // 100):
                own[r.randrange(len(own))] = "changed"
            texts[c * 10 + k] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.similar_components(docs, similarity=similarity).collect()}
    want = jaccard_roots(texts, similarity)
    assert sum(got[i] == want[i] for i in texts) >= 0.95 * len(texts)
    assert all(want[i] == want[got[i]] for i in texts), "only linked documents are joined"


def test_similar_pairs_in_a_group_that_shares_a_passage(spark):
    """300 texts with a similarity of 0.75 through one passage, 30 pairs of them with 0.82."""
    passage = [f"p{i}" for i in range(244)]
    texts = {}
    for i in range(300):
        pair = [f"pair{i // 2}_{k}" for k in range(13)] if i < 60 else []
        texts[i] = " ".join(passage + pair + [f"own{i}_{k}" for k in range(40 - len(pair))])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {i: i - i % 2 if i < 60 else i for i in texts}
    assert jaccard_roots(texts, 0.8) == want
    assert {x.doc_id: x.component_id for x in simhash.similar_components(docs).collect()} == want


def test_every_pair_of_a_large_group_is_compared(spark):
    """300 texts with one passage and three of sixty blocks each: a block is in many texts, so that links (two blocks) often
    are between texts that are the centre of no shingle they share."""
    import random

    r = random.Random(5)
    passage, texts = [f"p{i}" for i in range(230)], {}
    for i in range(300):
        blocks = sorted(r.sample(range(60), 3))
        texts[i] = " ".join(passage + [f"b{b}_{k}" for b in blocks for k in range(11)] + [f"own{i}_{k}" for k in range(14)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = jaccard_roots(texts, 0.8)
    found = lambda **more: {x.doc_id: x.component_id for x in simhash.similar_components(docs, **more).collect()}
    assert 1 < len(set(want.values())) < 300 and found() == want
    assert found(exact=False) != want, "too easy a case"


def test_pairs_of_a_group(spark):
    """60 texts that are a part each and near one another: every link is a candidate, and in
    one direction; with centres a text meets some of the others only."""
    texts = {i: " ".join(f"own{i}_{k}" if 40 <= k < 44 + i % 3 else f"w{k}" for k in range(160)) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    parts = docs.mapInArrow(simhash._sets(5), "doc_id long, shingles array<long>, marks array<long>").withColumn("part", F.col("doc_id"))
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in texts.items()}
    want = {(i, j) for i in texts for j in texts if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) == 60 * 59 // 2
    every = [(r.u, r.v) for r in simhash._across(parts, 0.8, None).collect()]
    assert len(every) == len(want) and {(min(p), max(p)) for p in every} == want
    some = {(min(r), max(r)) for r in simhash._across(parts, 0.8, 3).collect()}
    assert 0 < len(some) < len(want)


def test_sweep(spark, tmp_path):
    from pathlib import Path

    from lethe.llm import common

    df = common.materialise(spark.range(3), "three")
    at = Path(common._written[-1])
    assert df.count() == 3 and at.exists()
    common.sweep(spark)
    assert not at.exists()
