"""Functions on URLs, subject references, identifiers, intervals and log texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .crypto import sha256_hex

_EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"


def opaque_id(value: Column) -> Column:
    """Whether an id is neither blank nor like an e-mail address or a phone number."""
    v = F.trim(value)
    return (v != "") & ~v.rlike(_EMAIL) & ~F.regexp_replace(v, r"[\s()-]", "").rlike(r"^\+?[0-9]{7,15}\z")


def normalize_subject(value: Column) -> Column:
    """A subject reference as a lookup key without personal data: hashed e-mail
    addresses and Indian phone numbers, anything else as it is (trimmed)."""
    v = F.trim(value)
    plain = F.regexp_replace(v, r"[\s().-]", "")
    phone = F.regexp_replace(plain, r"^(?:\+91|0091|91)(?=[6789]\d{9}\z)", "+91")
    return (
        F.when(F.lower(v).rlike(r"^(?:email|phone)_sha256:[0-9a-f]{64}\z"), F.lower(v))
        .when(v.rlike(_EMAIL), F.concat(F.lit("email_sha256:"), sha256_hex(F.lower(v))))
        .when(plain.rlike(r"^(?:\+91|0091|91)?[6789]\d{9}\z"), F.concat(F.lit("phone_sha256:"), sha256_hex(phone)))
        .otherwise(v)
    )


def subject_kind(key: Column) -> Column:
    return F.when(key.startswith("email_sha256:"), "email_sha256").when(key.startswith("phone_sha256:"), "phone_sha256").otherwise("opaque")


# --- fixed values: public address plan -----------------------------------------
#: First octets and ranges of second octets of private and special IPv4 networks.
_SPECIAL = ((0, None), (10, None), (127, None), (100, (64, 127)), (169, (254, 254)), (172, (16, 31)), (192, (0, 0)), (192, (168, 168)), (198, (18, 19)), (198, (51, 51)), (203, (0, 0)))
# -------------------------------------------------------------------------------


def special_ipv4(host: Column) -> Column:
    """Whether a host is an IPv4 literal in a private or special network."""
    octets = F.transform(F.when(host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), F.split(host, r"\.")), lambda x: x.cast("int"))

    def special(o: Column) -> Column:
        a, b = F.get(o, F.lit(0)), F.get(o, F.lit(1))
        out = a >= 224
        for first, second in _SPECIAL:
            out |= (a == first) if second is None else (a == first) & b.between(*second)
        return out & (F.array_max(o) <= 255)

    return F.coalesce(F.exists(F.array(octets), special), F.lit(False))


def special_ipv6(host: Column) -> Column:
    h = F.lower(host)
    return h.contains(":") & (h.isin("::", "::1") | h.rlike("^(?:fe80:|ff|fc|fd)") | special_ipv4(F.substring_index(h, ":", -1)))


def egress_violation(url: Column) -> Column:
    """The code of the first rule that a callback URL breaks, or null."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    user = F.regexp_extract(authority, r"^(.*)@", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    return (
        F.when(url.isNull() | (scheme == "") | url.rlike(r"\s") | ((scheme.isin("http", "https")) & (host == "")), "API_WEBHOOK_URL_INVALID")
        .when(scheme != "https", "API_WEBHOOK_URL_PROTOCOL_INVALID")
        .when(~user.isin("", ":"), "API_WEBHOOK_URL_CREDENTIALS_FORBIDDEN")
        .when((bare == "localhost") | bare.endswith(".localhost") | special_ipv4(bare) | special_ipv6(bare), "API_WEBHOOK_URL_HOST_FORBIDDEN")
    )


def parse_s3_url(url: Column) -> Column:
    """bucket, key and version_id of an ``s3://`` or https S3 URL (virtual-host or
    path style); null where it is none."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    host = F.regexp_extract(url, r"^[^:]+://([^/?#:]*)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/?#]*/*([^?#]*)", 1), r"^/+", "")
    version = F.nullif(F.regexp_extract(url, r"[?&]versionId=([^&#]*)", 1), F.lit(""))
    virtual = F.regexp_extract(host, r"^(.+?)\.s3(?:[.-].*)?$", 1)
    by_path = F.regexp_extract(path, r"^([^/]+)/(.+)$", 1)
    bucket = F.when(scheme == "s3", host).when((scheme == "https") & (virtual != ""), virtual).when((scheme == "https") & host.rlike(r"^s3[.-]"), by_path)
    key = F.when((scheme == "https") & (virtual == ""), F.regexp_extract(path, r"^([^/]+)/(.+)$", 2)).otherwise(path)
    return F.when((bucket != "") & (key != ""), F.struct(bucket.alias("bucket"), F.url_decode(key).alias("key"), F.url_decode(version).alias("version_id")))


def coalesce_fields(document: Column, paths: list[str]) -> Column:
    """The first non-blank text or number among JSON paths of a document."""
    parsed = F.try_parse_json(document)
    found = [F.nullif(F.trim(F.try_variant_get(parsed, p, "string")), F.lit("")) for p in paths]
    return F.coalesce(*found)


def retry_delay_ms(attempt: Column, base: int = 1000, most: int = 300_000) -> Column:
    """Delay after the n-th failure: doubled each time, up to a limit."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(most))).cast("long")


def certificate_delay_s(attempt: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt) * 60, F.lit(6.0 * 3600)).cast("long")


def webhook_delay_s(attempt: Column, limit: int = 10) -> Column:
    """Null once the attempts are used up."""
    return F.when(attempt < limit, (F.pow(F.lit(2.0), attempt) * 60).cast("long"))


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def after(ts: Column, years: Column | int = 0, days: Column | int = 0, hours: Column | int = 0) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return ts + F.make_interval(lit(years), F.lit(0), F.lit(0), lit(days), lit(hours))


def redact_query_params(statement: Column, params: Column, pii_columns: list[str]) -> Column:
    """All parameters blanked if a statement names a personal column as a whole
    word; else long ones cut."""
    named = statement.rlike(r"(?i)\b(?:" + "|".join(pii_columns) + r")\b") if pii_columns else F.lit(False)
    short = F.transform(params, lambda p: F.when(F.length(p) > 128, F.concat(F.substring(p, 1, 125), F.lit("..."))).otherwise(p))
    return F.when(named, F.transform(params, lambda p: F.lit("[REDACTED]"))).otherwise(short)


def redact_paths(document: Column, paths: list[str]) -> Column:
    """A JSON text with the values at paths censored; ``*.key`` means any parent
    one level down."""
    out = document
    for path in paths:
        key = path.split(".")[-1]
        out = F.regexp_replace(out, rf'("{key}"\s*:\s*)(?:"(?:[^"\\]|\\.)*"|[^,}}\]]+)', '$1"[REDACTED]"')
    return out


def blob_mask(url: Column, schema: str, table: str, column: str, key: bytes) -> Column:
    from .crypto import hmac_sha256_hex

    return hmac_sha256_hex(F.concat(F.lit(f"blob-url:{schema}:{table}:{column}:"), url), key)


def object_ref_hash(bucket: Column, key_name: Column, version: Column, key: bytes) -> Column:
    """The hash that receipts carry in place of an object's path."""
    import base64

    from .crypto import hmac_sha256_hex

    return hmac_sha256_hex(F.concat(F.lit("s3-object-ref:"), bucket, F.lit("\n"), key_name, F.lit("\n"), F.coalesce(version, F.lit(""))), base64.b64encode(key))


def score_text(score: Column) -> Column:
    """A score with three decimals, halves rounded up."""
    return F.format_string("%.3f", score)


def rule_columns(rules: Column) -> tuple[Column, Column]:
    """Of a map of mutation rules by column: the columns that get a new value and those
    that are blanked, in order."""
    of = lambda blank: F.array_sort(F.map_keys(F.map_filter(rules, lambda _, rule: (rule == "NULLIFY") == blank)))
    return of(F.lit(False)), of(F.lit(True))


def path_with(path: Column, step: Column) -> Column:
    """A path with one more step, or null if it has been there."""
    return F.when(~F.array_contains(path, step), F.array_append(path, step))
