"""Readers that take less than whole files: heads of objects, and row groups of tables.

Both are Python data sources, so that Spark deals their parts over tasks: one row for each
object with at most ``most_bytes`` of it, and one part for each chosen row group.
Paths are local or of any store that the Arrow file systems open (``file``, ``s3``, ``gs``,
``hdfs``); a name may hold ``*`` and ``?``.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

#: What columnar objects begin with.
MAGIC = {b"PAR1": "parquet", b"Obj\x01": "avro"}


class Found(NamedTuple):
    path: str
    size: int


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def listed(path: str) -> list[Found]:
    """The objects under a folder, or those that a name with wild cards means, by path.
    Names that begin with ``_`` or ``.`` are left out, as Spark leaves them out."""
    from pyarrow import fs

    folder, _, name = path.rstrip("/").rpartition("/")
    wild = any(c in name for c in "*?")
    system, at = _system(folder if wild else path.rstrip("/"))
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    below = lambda i: i.path[len(at) :].strip("/")
    shown = lambda i: info.type == fs.FileType.File or not any(p[:1] in "_." for p in below(i).split("/"))
    return sorted(Found(i.path, i.size) for i in every if i.type == fs.FileType.File and shown(i) and (not wild or fnmatch.fnmatch(below(i).split("/")[0], name)))


def _scheme(path: str) -> str:
    return path.split("://")[0] if "://" in path else "file"


class _Heads(DataSourceReader):
    """Packs of objects; an object is opened and its first bytes are read, no more."""

    def __init__(self, options: dict[str, str]):
        self.path, self.most_bytes, self.pack = options["path"], int(options.get("mostbytes", 1 << 20)), int(options.get("pack", 64))

    def partitions(self) -> list[InputPartition]:
        every = listed(self.path)
        return [InputPartition(every[k : k + self.pack]) for k in range(0, len(every), self.pack)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path if not any(c in self.path for c in "*?") else self.path.rpartition("/")[0])
        for path, size in partition.value:
            with system.open_input_stream(path, compression=None) as f:
                head = f.read(4)
                if head not in MAGIC and not path.lower().endswith((".parquet", ".avro")):  # columnar ones are told by four bytes
                    head += f.read(max(0, self.most_bytes - len(head)))
            yield pa.RecordBatch.from_arrays([pa.array([f"{_scheme(self.path)}:{path}"]), pa.array([size], pa.int64()), pa.array([head], pa.binary())], names=["path", "length", "content"])


class ObjectHeads(DataSource):
    """``spark.read.format("object_heads").option("mostBytes", n).load(path)``: path,
    length and content (the first bytes) of each object."""

    @classmethod
    def name(cls) -> str:
        return "object_heads"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Heads(dict(self.options))


def _share(name: str, seed: str) -> float:
    """A number from 0 to 1 that a name and the seed alone decide."""
    return int.from_bytes(hashlib.md5(f"{seed}:{name}".encode()).digest()[:8], "big") / 2**64


def chosen_blocks(path: str, percent: float, seed: str = "7", many: int = 20) -> list[tuple[str, list[int] | None]]:
    """Files with their row groups (None: all) that make up about ``percent`` of a table.

    Where that is ``many`` files or more, whole files are chosen by a hash of their names and
    no footer is read; else row groups, by their file's name and number. One block is
    chosen at least, that of the least hash, so no table is without a sample."""
    import pyarrow.parquet as pq

    files = listed(path)
    share = percent / 100
    base = lambda f: f.path.rsplit("/", 1)[-1]
    if len(files) * share >= many:
        return [(f.path, None) for f in files if _share(base(f), seed) < share]
    system, _ = _system(path.rpartition("/")[0] if any(c in path for c in "*?") else path)
    groups = []
    for f in files:
        with system.open_input_file(f.path) as raw:
            meta = pq.ParquetFile(raw).metadata
            groups += [(_share(f"{base(f)}:{g}", seed), f.path, g) for g in range(meta.num_row_groups) if meta.row_group(g).num_rows]
    out: dict[str, list[int]] = {}
    for s, at, g in groups:
        if s < share or s == min(groups)[0]:
            out.setdefault(at, []).append(g)
    return list(out.items())


class _Blocks(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.options, self.columns = options, columns

    def partitions(self) -> list[InputPartition]:
        own = chosen_blocks(self.options["path"], float(self.options.get("percent", 1)), self.options.get("seed", "7"))
        return [InputPartition((f, None if gs is None else [g])) for f, gs in own for g in (gs or [0])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        path, groups = partition.value
        system, _ = _system(self.options["path"].rpartition("/")[0] if any(c in self.options["path"] for c in "*?") else self.options["path"])
        with system.open_input_file(path) as raw:
            yield from pq.ParquetFile(raw).iter_batches(4096, row_groups=groups, columns=self.columns)


class ParquetBlocks(DataSource):
    """``spark.read.format("parquet_blocks").option("percent", p).load(path)``: the rows of
    some row groups of a Parquet table; others are not read. Option ``columns`` (names
    with commas between) reads these columns only."""

    @classmethod
    def name(cls) -> str:
        return "parquet_blocks"

    def _arrow(self) -> pa.Schema:
        import pyarrow.parquet as pq

        path = self.options["path"]
        system, _ = _system(path.rpartition("/")[0] if any(c in path for c in "*?") else path)
        with system.open_input_file(listed(path)[0].path) as raw:
            own = pq.ParquetFile(raw).schema_arrow
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        return pa.schema([own.field(c) for c in wanted]) if wanted else own

    def schema(self):
        return from_arrow_schema(self._arrow())

    def reader(self, schema) -> DataSourceReader:
        return _Blocks(dict(self.options), schema.names)


def register(spark: SparkSession) -> SparkSession:
    """Make both formats known to a session."""
    spark.dataSource.register(ObjectHeads)
    spark.dataSource.register(ParquetBlocks)
    return spark
