"""Surrogates where formats have few values, and columns that clash with names used inside stages."""

import ipaddress
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline  # noqa: E402
from lethe.llm import exact, pii  # noqa: E402

SCHEMA = "doc_id long, text string"


def replaced(spark, texts, schema=SCHEMA):
    rows = pii.surrogate_texts(spark.createDataFrame(list(enumerate(texts)), schema), b"k").orderBy("doc_id").collect()
    return [r.text for r in rows]


def test_short_and_mapped_addresses_stay_valid_and_apart(spark):
    own = [f"::{i}" for i in range(10)] + ["fe80::1", "fe80::2", "::ffff:10.1.2.3", "::ffff:192.168.1.20", "2001:db8:1:2:3:4:10.1.2.3", "fd00::5"]
    out = replaced(spark, [f"at {a} now" for a in own] + ["again ::3 and fe80::1"])
    new = [re.fullmatch(r"at (\S+) now", t)[1] for t in out[: len(own)]]
    parsed = [ipaddress.IPv6Address(a) for a in new]
    assert len(set(parsed)) == len(own) and not set(parsed) & {ipaddress.IPv6Address(a) for a in own}
    assert all(str(ipaddress.IPv6Address(a)).startswith(("fe80", "fd")) for a in (new[10], new[11], new[15]))
    assert [a.ipv4_mapped.is_private for a in parsed[12:14]] == [True, True]
    assert out[-1] == f"again {new[3]} and {new[10]}"


def test_a_full_format_gets_marks(spark):
    """All ten passport numbers of a made-up format of one digit."""
    entities = spark.createDataFrame([("short", str(i), "n") for i in range(10)], "kind string, value string, gender string")
    found = pii.settled(entities, b"k").withColumn("new", pii.surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.col("attempt"), b"k")).collect()
    assert len({r.new for r in found}) == 10 and all(re.fullmatch(r"\[short [0-9a-f]{16}\]", r.new) for r in found)


def test_phones_in_two_fives_and_names_in_capitals(spark):
    one, two = replaced(spark, ["98765-43210 or 98765 43210 or 9876543210", "JOHN SMITH met Mr. John Smith"])
    digits = [re.sub(r"\D", "", p) for p in one.split(" or ")]
    assert len(set(digits)) == 1 and digits[0] != "9876543210" and re.fullmatch(r"\d{5}-\d{5} or \d{5} \d{5} or \d{10}", one)
    capital, plain = re.fullmatch(r"([A-Z]+ [A-Z]+) met Mr\. (\w+ \w+)", two).groups()
    assert capital == plain.upper() and "SMITH" not in capital


def test_rows_without_a_doc_id_are_told_apart_by_their_text(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("::"), (F.col("id") % 8).cast("string"), F.lit(" n "), F.col("id").cast("string")).alias("text"))
    got = pii.surrogate_texts(rows, b"k").select(F.regexp_extract("text", r"^(\S+) n", 1).alias("new"), (F.regexp_extract("text", r" n (\d+)$", 1).cast("long") % 8).alias("old"))
    assert got.count() == 3000 and got.distinct().count() == got.select("new").distinct().count() == 8


INSIDE = ("text_sha256", "kept", "size", "shard", "row", "sha256_0", "keep_id", "group_size", "ids", "print", "keys", "score", "n", "node", "component_id", "at", "part", "token", "recipe")


@pytest.mark.parametrize("stage", ["exact dedup", "near dedup"])
def test_columns_named_as_inside_pass_through_with_repeated_rows(spark, stage):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text), (1, text), (1, "another text of this document that differs from the first"), (2, text), (3, "quite something else with words of its own"), (3, "quite something else with words of its own"), (None, text)]
    docs = spark.createDataFrame([(i, t, "en", "web", 0, *[f"mine {n}" for n in INSIDE]) for i, t in rows], SCHEMA + ", lang string, source string, n_chars long" + "".join(f", {n} string" for n in INSIDE))
    out = dict(pipeline.STAGES)[stage](spark, docs, None)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[n] == f"mine {n}" for r in got for n in INSIDE)


def test_exact_dedup_of_repeated_rows_leaves_columns_alone(spark):
    docs = spark.createDataFrame([(1, "a", "mine", "own"), (1, "a", "mine", "own"), (1, "b", "mine", "own")], SCHEMA + ", TEXT_SHA256 string, sha256_0 string")
    assert {(r.text, r.TEXT_SHA256, r.sha256_0) for r in exact.drop_copies(docs).collect()} == {("a", "mine", "own"), ("b", "mine", "own")}
