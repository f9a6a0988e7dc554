"""Texts of several megabytes, repeated rows, rows without ids, ties and empty tables, for every operator and stage."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline  # noqa: E402
from lethe.llm import chat, decontam, exact, pii, quality, sharding, simhash, spm, substring, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, print long, kept boolean, row long, n long, ids long"


def long_text(seed, n):
    """Words like those of the other texts, with some never seen again."""
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(50_000)}" if r.random() < 0.99 else f"x{k}" for k in range(n))


@pytest.fixture(scope="module")
def rows():
    passage = " ".join(f"p{k}" for k in range(30))
    big = long_text(1, 500_000)
    own = [(1, big), (2, f"in front {passage} behind"), (3, f"{passage} again"), (4, None), (5, ""), (6, big + " end"), (7, "short one"), (8, "short one")]
    return [*own, own[1], own[1], own[3], own[6]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns named like those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "web", 0, 0.5, 7, False, 3, 4, 5) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([("a", " ".join(f"p{k}" for k in range(12))), ("b", None), ("a", " ".join(f"p{k}" for k in range(12)))], "item_id string, text string")


def operators(docs, labels, benchmark):
    return {
        "op1": lambda d: toxicity.toxicity_scores(d, labels), "op2": lambda d: substring.duplicate_spans(d), "op3": lambda d: quality.quality_scores(d, labels), "op4": lambda d: exact.exact_groups(d), "op5": lambda d: pii.surrogate_texts(d, b"k"),
        "op6": lambda d: decontam.contamination(d, benchmark), "op7": lambda d: spm.encode_documents(d), "op9": lambda d: simhash.simhash_components(d), "op10": lambda d: sharding.jump_shards(d), "near": lambda d: simhash.similar_components(d),
    }


@pytest.fixture(scope="module")
def results(docs, labels, benchmark):
    return {name: [r.asDict(recursive=True) for r in f(docs).collect()] for name, f in operators(docs, labels, benchmark).items()}


def test_every_row_has_a_result(results, rows):
    want = Counter(i for i, _ in rows)
    assert all(Counter(r["doc_id"] for r in out) == want for out in results.values())


def test_repeated_rows_have_equal_results(results):
    for name, out in results.items():
        for i in (2, 4, 7):
            assert len({str({k: v for k, v in r.items() if k != "slot"}) for r in out if r["doc_id"] == i}) == 1, name


def test_results_on_long_texts(results, rows):
    text = dict(rows)
    got = {name: {r["doc_id"]: r for r in out} for name, out in results.items()}
    n = len(text[1].split())
    assert len(text[1]) > 2_500_000 and got["op2"][1]["n_words"] == got["op6"][1]["n_words"] == n and got["op6"][6]["n_words"] == n + 1
    # of the long text's copy only the new last word stays
    assert (got["op2"][1]["n_removed"], got["op2"][6]["n_removed"]) == (0, n) and got["op2"][6]["kept_sha256"] == hashlib.sha256(b"end").hexdigest()
    assert got["op4"][1]["text_sha256"] == hashlib.sha256(text[1].encode()).hexdigest() and got["op4"][1]["group_size"] == 1 and got["op4"][8]["keep_id"] == 7
    assert got["op5"][1]["text"] == text[1] and got["op5"][4]["text"] is None
    assert all(r["restored"] for r in got["op7"].values()) and got["op7"][1]["n_tokens"] > n
    assert got["op9"][6]["component_id"] == 1 == got["near"][6]["component_id"] and got["op9"][5]["component_id"] == 4
    assert (got["op10"][1]["size"], got["op10"][1]["text_crc32"]) == (len(text[1]) + 1, zlib.crc32(text[1].encode()))
    assert got["op2"][3]["n_removed"] == 30 and got["op6"][2]["n_hit"] == 12 and got["op6"][3]["n_items"] == 1
    assert all(0 <= got[k][i]["score"] <= 1 for k in ("op1", "op3") for i in text)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=spm.default_model())
    assert got["op7"][6]["ids"] == library.encode(text[6])


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op9", "op10", "near"])
def test_rows_without_ids_and_empty_tables(spark, docs, labels, benchmark, name):
    f = operators(docs, labels, benchmark)[name]
    few = docs.where("doc_id in (2, 3, 5, 7)")
    nameless = few.withColumn("doc_id", F.lit(None).cast("long"))
    got = f(few.unionAll(nameless)).collect()
    assert len(got) == 2 * few.count() and sum(r.doc_id is None for r in got) == few.count()
    assert f(docs.limit(0)).count() == 0


def test_conversation_of_many_long_turns(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], long_text(k, 20_000)) for k in range(40)]
    table = spark.createDataFrame([*turns, turns[3], (2, None, None, None), (None, 1, "user", "x")], "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r.conv_id: r for r in chat.chat_digests(table).collect()}
    told = "".join(f"{role}\n{t}\n" for _, _, role, t in sorted([*turns, turns[3]]))
    assert got[1].turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and got[1].n_turns == 41 and (got[2].n_turns, got[None].n_turns) == (1, 1)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages(spark, docs, labels, benchmark, tmp_path, name):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(pipeline.STAGES)[name]
    got = Counter(r.doc_id for r in stage(spark, docs, str(tmp_path)).select("doc_id").collect())
    every = Counter(r.doc_id for r in docs.select("doc_id").collect())
    want = {"exact dedup": {1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 7: 1}, "near dedup": {k: v for k, v in every.items() if k not in (3, 5, 6, 8)}, "decontamination": {k: v for k, v in every.items() if k not in (2, 3)}, "tokens": dict(every)}
    assert dict(got) == want[name] if name in want else set(got) <= set(every) and all(got[k] == every[k] for k in got)
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.count() == 0 and (name == "tokens" or empty.columns == docs.columns)


def test_scores_of_equal_terms_and_rows(spark):
    """Ties: terms of one weight, rows of one score, labels that contradict each other."""
    texts = [(i, "bad worse" if i % 2 else "fine good") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(200)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (toxicity.toxicity_scores(docs, labels), quality.quality_scores(docs, labels)):
        got = {r.doc_id: r.score for r in out.collect()}
        assert len({round(s, 12) for i, s in got.items() if i % 2}) == 1 and len(set(got.values())) == 2
    assert {r.predicted for r in toxicity.toxicity_scores(docs, labels).where("doc_id % 2 = 1").collect()} == {1}


def test_a_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from lethe.llm import common

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match=re.escape("spark.checkpoint.dir")):
        common.shared_dir(Session())
