"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) leaves this remainder are held out.
FOLDS, HELD_OUT = 5, 0

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id="doc_id"):
    """True for the rows that no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A local folder serves only where all
    executors are threads of this process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        at = tempfile.mkdtemp(prefix="lethe-checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_written: list[str] = []


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete the intermediate tables that this process has written. Results that
    were not written themselves can't be read any more."""
    while _written:
        _delete(spark, _written.pop())


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This cuts the lineage: executors that are lost later cost no recomputation,
    and what follows plans with the real sizes.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _written.append(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Let Spark drop the shuffle files of finished jobs before the next large one, and
    delete written tables that nothing reads any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    for df in done:
        if df.written_at in _written:
            _written.remove(df.written_at)
            _delete(spark, df.written_at)


def texts(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of ``column`` each, so that a
    task holds few rows' working arrays at once."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection on 64-bit words."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """XXH64 of each word."""
    one = xxhash.xxh64_intdigest
    return np.fromiter(map(one, words, repeat(seed)), np.uint64, len(words))


class Windows:
    """Hashes of every ``width`` consecutive words, by a polynomial over word
    hashes modulo 2**64. ``lane`` picks one of several independent functions."""

    def __init__(self, width: int, lane: int = 0):
        self.width = width
        self.base = int(mix(np.array([1000 + lane], np.uint64))[0]) | 1
        self.salt = mix(np.array([2000 + lane], np.uint64))[0]
        self.weights = np.array([pow(self.base, width - 1 - i, 1 << 64) for i in range(width)], np.uint64)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        n = len(words) - self.width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        words = mix(words ^ self.salt)
        out = np.zeros(n, np.uint64)
        for i, w in enumerate(self.weights):
            out += words[i : i + n] * w
        return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def by_id(docs: DataFrame, ids: DataFrame, how: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """A semi or anti join of documents with written ids (doc_id). The ids are
    counted: up to ``broadcast_rows`` (some 60 MB) they are broadcast, so that texts
    don't move; beyond that both sides are shuffled."""
    ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids.hint("merge")
    return docs.join(ids, "doc_id", how).select(*docs.columns)


def keep_rows(docs: DataFrame, decide) -> DataFrame:
    """The rows that a task's decider keeps, all columns unchanged. ``decide()`` is
    called once in each task and gives a function from record batches to masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps = decide()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                yield part.filter(pa.array(keeps(part), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
