"""Registration, roles of the driver's tables, and SQL that several queries share."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession

#: Demonstration keys; real ones are the caller's.
HMAC_KEY, KEK = bytes([0x24]) * 32, bytes([0x42]) * 32
#: The base64 text of the key, where the key of a hash is that text.
TEXT_KEY = base64.b64encode(HMAC_KEY)
SCHEMA = "app"
NOW = "2026-01-01 00:00:00"

#: What deleting a parent does, where it is not "no action" (the data can't tell): by constraint.
DELETE_CODES = {"lineitem_orders": "c", "lineitem_supplier": "n"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put

    def part(self, of: str, **names: list[str]) -> None:
        """Register some columns of a query under names of their own: the operators
        that a query over several at once holds."""
        for name, columns in names.items():
            self.queries[name] = lambda spark, sf_dir, columns=tuple(columns): self.queries[of](spark, sf_dir).select(*columns)
            self.sql[name] = f"SELECT {', '.join(columns)} FROM ({self.sql[of]}) part"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hmac_sql(message: str, key: bytes) -> str:
    """HMAC-SHA-256 (hex) of a SQL text expression under a constant key."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda n: "from_hex('" + bytes(b ^ n for b in block).hex() + "')"
    return f"sha256({pad(0x5C)} || from_hex(sha256({pad(0x36)} || encode({message}))))"
