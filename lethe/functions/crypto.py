"""Hashes, keyed hashes, encryption and identifiers as Spark expressions.

All but random bytes and ``canonical_json_js`` are built-in expressions. Keys appear as literals
in query plans; set ``spark.redaction.regex`` for event logs, or pass per-row
keys from a joined one-row frame.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import unicodedata
from decimal import Decimal
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256_hex(text: Column | str) -> Column:
    return F.sha2(_col(text), 256)


def _block(key: bytes) -> bytes:
    return (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")


def hmac_sha256_hex(message: Column, key: bytes) -> Column:
    """HMAC-SHA-256 under one key; both pads are folded on the driver."""
    pad = lambda n: F.lit(bytes(b ^ n for b in _block(key)))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def _xored(block: Column, n: int) -> Column:
    """A 64-byte block (its hex digits), each byte combined with ``n``: eight bytes at a
    time as a whole number, all in generated code."""
    mask = F.lit(int.from_bytes(bytes([n]) * 8, "big", signed=True))
    eight = lambda i: F.conv(F.substring(block, 16 * i + 1, 16), 16, -10).cast("long").bitwiseXOR(mask)
    return F.unhex(F.concat(*[F.lpad(F.hex(eight(i)), 16, "0") for i in range(8)]))


def hmac_row_sha256_hex(message: Column, key: Column) -> Column:
    """HMAC-SHA-256 under a key of each row (text or binary)."""
    raw = key.cast("binary")
    short = F.when(F.octet_length(raw) > 64, F.unhex(F.sha2(raw, 256))).otherwise(raw)
    block = F.rpad(F.hex(short), 128, "0")
    inner = F.unhex(F.sha2(F.concat(_xored(block, 0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(_xored(block, 0x5C), inner), 256)


def hmac_verify(body: Column, signature: Column, key: bytes) -> Column:
    """Whether a signature (hex, ``sha256=`` and hex, or base64) is the body's."""
    want = hmac_sha256_hex(body, key)
    given = F.regexp_replace(F.trim(signature), "^sha256=", "")
    as_hex = F.when(given.rlike("^[0-9a-fA-F]{64}$"), F.lower(given))
    as_base64 = F.when(given.rlike("^[A-Za-z0-9+/]{43}=$"), F.lower(F.hex(F.unbase64(given))))
    return F.coalesce(F.coalesce(as_hex, as_base64) == want, F.lit(False))


def user_hash(schema: str, table: str, root_id: Column, key: bytes, tenant: Column | None = None) -> Column:
    """A subject's lookup hash. The HMAC key is the base64 text of the key bytes."""
    tenant = F.coalesce(tenant.cast("string"), F.lit("")) if tenant is not None else F.lit("")
    return hmac_sha256_hex(F.concat(F.lit(f"{schema}:{table}:"), tenant, F.lit(":"), root_id.cast("string")), base64.b64encode(key))


def pseudonym(root_id: Column, value: Column, salt: Column, key: bytes) -> Column:
    """A synthetic address that can't be turned back."""
    row_key = F.concat(salt, F.lit(":" + base64.b64encode(key).decode()))
    digest = hmac_row_sha256_hex(F.concat(root_id.cast("string"), F.lit(":"), value), row_key)
    return F.concat(F.lit("dpdp_"), F.substring(digest, 1, 24), F.lit("@dpdp.invalid"))


def mask_value(rule: str, value: Column, schema: str, table: str, column: str, key: bytes | None = None) -> Column:
    """A column under a mutation rule: STATIC_MASK, NULLIFY or HMAC (null stays null)."""
    if rule == "STATIC_MASK":
        return F.lit("[REDACTED]")
    if rule == "NULLIFY":
        return F.lit(None).cast("string")
    if rule == "HMAC":
        return hmac_sha256_hex(F.concat(F.lit(f"{schema}:{table}:{column}:"), value.cast("string")), key)
    raise ValueError(f"unknown rule {rule}")


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no blanks; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(text))


def js_number(x: int | float) -> str:
    """A number as JavaScript writes it: the shortest text that reads back as the same
    double, plain from 1e-6 to 1e21."""
    x = float(x)
    if x == 0 or x != x or x in (float("inf"), float("-inf")):
        return "0" if x == 0 else "null"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + exponent  # places before the decimal point
    if len(text) <= point <= 21:
        out = text + "0" * (point - len(text))
    elif 0 < point <= 21:
        out = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        out = f"0.{'0' * -point}{text}"
    else:
        e = point - 1
        out = f"{text[0]}{'.' + text[1:] if len(text) > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"
    return "-" * sign + out


#: The order of ASCII characters in the root collation, letters aside.
_ROOT_ORDER = "\t\n\v\f\r _-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$0123456789"


@cache
def _weights(c: str) -> list[tuple]:
    """A character's weights in the root collation: base, accents, case. Letters go by
    base letter first, then by accents, then small before capital; a sharp s is two s."""
    base, *marks = unicodedata.normalize("NFD", c)
    at = _ROOT_ORDER.find(base)
    small = base.casefold()
    of = lambda s: (0, at, "") if at >= 0 else (2, 0, s) if s.isalpha() else (1, 0, s)
    return [(of(s), tuple(marks), base != small) for s in small]


def _root_order(key: str) -> tuple:
    own = [w for c in key for w in _weights(c)]
    return [w[0] for w in own], [w[1] for w in own], [w[2] for w in own], key


def _index_like(key: str) -> bool:
    return key.isascii() and key.isdigit() and (key == "0" or key[0] != "0") and int(key) < 2**32 - 1


def _ordered(pairs: list[tuple[str, object]]) -> dict:
    """Of repeated keys the last value; keys that are array indexes first, by number,
    then the others by the root collation."""
    own = dict(pairs)
    index = sorted((k for k in own if _index_like(k)), key=int)
    return {k: own[k] for k in [*index, *sorted((k for k in own if not _index_like(k)), key=_root_order)]}


def js_canonical(text: str | None) -> str | None:
    """Canonical JSON of one text, None where it is no JSON."""
    if text is None:
        return None

    def refuse(word: str):
        raise ValueError(word)

    def out(v) -> str:
        if isinstance(v, dict):
            return "{" + ",".join(f"{_quoted(k)}:{out(x)}" for k, x in v.items()) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(out, v)) + "]"
        if isinstance(v, bool) or v is None:
            return {True: "true", False: "false", None: "null"}[v]
        return js_number(v) if isinstance(v, float) else _quoted(v)

    try:
        return out(json.loads(text, object_pairs_hook=_ordered, parse_int=float, parse_constant=refuse))
    except (ValueError, RecursionError):
        return None


def _quoted(text: str) -> str:
    """Quoted as JavaScript does: characters beyond ASCII stay, but for halves of pairs."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(text, ensure_ascii=False))


@F.arrow_udf(StringType())
def _canonical_js(texts: pa.Array) -> pa.Array:
    return pa.array(map(js_canonical, texts.to_pylist()), pa.string())


def canonical_json_js(text: Column) -> Column:
    """JSON as a JavaScript service serialises it canonically, for hashes that such a
    service must be able to verify: numbers in their shortest form (``1e3`` is 1000), the
    last of repeated keys, keys that are array indexes in front, others in the order of
    the root collation. Null where the text is no JSON. ``canonical_json`` stays inside
    the JVM and gives the same for objects with keys in byte order and plain integers."""
    return _canonical_js(text)


def _uuid(digest: Column, version: str) -> Column:
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit(version), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def uuid_v5(name: Column, namespace: str) -> Column:
    """The name-based (SHA-1) UUID of RFC 4122."""
    return _uuid(F.sha1(F.concat(F.lit(bytes.fromhex(namespace.replace("-", ""))), F.encode(name, "UTF-8"))), "5")


def deterministic_uuid(text: Column) -> Column:
    """A UUID from the first 16 bytes of SHA-256, of version 5."""
    return _uuid(F.sha2(text, 256), "5")


@F.pandas_udf(BinaryType())
def _random(sizes: pd.Series) -> pd.Series:
    return pd.Series([os.urandom(n) for n in sizes])


#: Draws anew whenever it is evaluated: write the result before using it twice.
_random = _random.asNondeterministic()


def random_bytes(n: int) -> Column:
    return _random(F.lit(n))


def encrypt(text: Column, key: Column) -> Column:
    """AES-256-GCM: a 12-byte nonce, the ciphertext, a 16-byte tag."""
    return F.aes_encrypt(text.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"))


def decrypt(data: Column, key: Column) -> Column:
    """The text, or null if key or data don't fit."""
    return F.try_aes_decrypt(data, key, F.lit("GCM"), F.lit("DEFAULT")).cast("string")


def wrap_key(dek: Column, kek: bytes) -> Column:
    return F.aes_encrypt(dek, F.lit(kek), F.lit("GCM"), F.lit("DEFAULT"))


def unwrap_key(wrapped: Column, kek: bytes) -> Column:
    """The data key; older rings hold it as base64 text."""
    raw = F.try_aes_decrypt(wrapped, F.lit(kek), F.lit("GCM"), F.lit("DEFAULT"))
    return F.when(F.octet_length(raw) == 32, raw).otherwise(F.unbase64(raw.cast("string")))
