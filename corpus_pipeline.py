"""The corpus pipeline: stages over documents, each written and read again.

For all stages: other columns pass through unchanged whatever their names; rows without
a doc_id are never dropped as copies of others; an empty table gives an empty one with
the same columns; texts of any length are read whole; a lost executor costs no more than
the running stage, since each stage's result is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lethe.llm.common import materialise, table
from lethe.llm.decontam import drop_contaminated
from lethe.llm.exact import drop_copies
from lethe.llm.quality import keep_good
from lethe.llm.simhash import drop_near_copies
from lethe.llm.spm import encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (a score below 0.3) go.

    Null and empty texts have the score of the intercept. Repeated rows and equal texts
    share one fate. Without labels of both classes every document has one score, the
    share of label 1 (a half without any label)."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white-space runs, the document of smallest doc_id
    stays; null counts as empty. Of repeated rows of one document one stays, with the
    columns of any; rows of one doc_id with different texts are judged one by one."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, a similarity of 0.8 or more, verified exactly)
    the document of smallest doc_id stays; links carry on, so that a chain of near copies
    is one group. Null, blank and empty texts are copies of each other. A text of fewer
    than five words has one shingle. Repeated rows share one fate."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of ten words (or a whole shorter item) of a benchmark
    item occurs go whole. Null texts and items have no words and no windows; repeated
    items count once; repeated rows share one fate."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and restored of what is left, a row for each row. Null and
    empty texts have no ids."""
    return encode_documents(docs)


STAGES = [("quality", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: The classifier can't be put in SQL; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
