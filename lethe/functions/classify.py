"""Classification of columns by name and of values by pattern and checksum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
STRONG, MEDIUM, WEAK = 0.92, 0.82, 0.62
THRESHOLD = 0.75
#: Name patterns and their scores, on lower-cased column names.
NAME_PATTERNS = (
    (r"(^|_)(full_name|first_name|last_name|middle_name|surname|given_name|display_name)($|_)", STRONG),
    (r"(^|_)name($|_)", MEDIUM),
    (r"(^|_)(password|passwd|pwd|secret|token|api_key|access_token|refresh_token|auth_token|hash|salt)($|_)", STRONG),
    (r"(^|_)(role|roles|permission|permissions|group|groups|acl|access_level)($|_)", WEAK),
    (r"(^|_)(email|e_mail|email_address|mail_address|contact_email)($|_)", STRONG),
    (r"(^|_)(phone|mobile|msisdn|telephone|contact_number|whatsapp)(_number|_no)?($|_)", STRONG),
    (r"(^|_)(aadhaar|aadhar|uidai)(_number|_no|_id)?($|_)", STRONG),
    (r"(^|_)(pan|pan_number|pan_no)($|_)", STRONG),
    (r"(^|_)(gstin|gst_number|gst_no)($|_)", STRONG),
    (r"(^|_)(credit_card|debit_card|card_number|card_no|cc_number|cc_no)($|_)", STRONG),
    (r"(^|_)(upi|vpa|upi_id|upi_address)($|_)", STRONG),
    (r"(^|_)(ifsc|ifsc_code)($|_)", STRONG),
    (r"(^|_)(passport|passport_number|passport_no)($|_)", STRONG),
    (r"(^|_)(voter|voter_id|epic|epic_number|epic_no)($|_)", STRONG),
    (r"(^|_)(dob|date_of_birth|birth_date|birthday)($|_)", MEDIUM),
    (r"(^|_)(ip|ip_address|ipv4|ipv6|mac|mac_address)($|_)", MEDIUM),
    (r"(^|_)(bank_account|account_number|account_no|iban|swift)($|_)", MEDIUM),
    (r"(^|_)(driving_license|driving_licence|license_number|licence_number|dl_number|dl_no)($|_)", MEDIUM),
    (r"(^|_)(address|street|postal_code|zip_code|pin_code|pincode)($|_)", WEAK),
    (r"(^|_)(device_fingerprint|device_id|advertising_id|gaid|idfa)($|_)", WEAK),
    (r"(^|_)(document_number|identity_number|id_number)($|_)", WEAK),
)
#: Value signatures: name, pattern, weight, and a pattern of column names they need.
SIGNATURES = (
    ("aadhaar", r"^[2-9][0-9]{3}[\s-]?[0-9]{4}[\s-]?[0-9]{4}$", 0.98, None),
    ("pan", r"^[A-Z]{5}[0-9]{4}[A-Z]$", 0.96, None),
    ("gstin", r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$", 0.94, None),
    ("credit_card", r"^(?:\d[ -]?){13,19}$", 0.97, None),
    ("email", r"^[^\s@]+@[^\s@]+\.[^\s@]+$", 0.95, None),
    ("upi", r"^[a-zA-Z0-9.\-_]{2,256}@[a-zA-Z]{2,64}$", 0.93, None),
    ("ifsc", r"^[A-Z]{4}0[A-Z0-9]{6}$", 0.9, None),
    ("indian_mobile", r"^(?:(?:\+|0{0,2})91(\s*[-]\s*)?|[0]?)?[6789]\d{9}$", 0.9, None),
    ("indian_passport", r"^[A-Z][0-9]{7}$", 0.88, None),
    ("voter_epic", r"^[A-Z]{3}[0-9]{7}$", 0.88, None),
    ("ipv4", r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$", 0.82, None),
    ("ipv6", r"^[0-9A-Fa-f:.]+$", 0.82, None),
    ("mac_address", r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$", 0.82, None),
    ("bank_account", r"^\d{9,18}$", 0.78, r"bank|account|iban"),
    ("date_of_birth", r"^(?:19|20)\d{2}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])$", 0.82, r"dob|birth|date_of_birth"),
    ("indian_driving_license", r"^[A-Z]{2}[-\s]?[0-9]{2}[-\s]?[0-9]{11}$", 0.84, r"driving|licen[cs]e|(^|_)dl(_|$)"),
    ("indian_pin_code", r"^[1-9][0-9]{5}$", 0.78, r"pincode|pin_code|postal|zip"),
)
PAN_STATUS = "PCHFATBLJG"
#: The first permutation of the Verhoeff check; the others are its powers.
VERHOEFF_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
# -----------------------------------------------------------------------------


def _dihedral(a: int, b: int) -> int:
    """The product of two symmetries of a pentagon: turns are 0 to 4, flips 5 to 9."""
    turn = (a + b) % 5 if a < 5 else (a - b) % 5
    return turn if (a < 5) == (b < 5) else turn + 5


def _powers(step: tuple[int, ...], n: int) -> list[list[int]]:
    out = [list(range(10))]
    while len(out) < n:
        out.append([step[x] for x in out[-1]])
    return out


#: The tables of the Verhoeff check, as digits row by row for the look-up by position.
VERHOEFF_D = "".join(str(_dihedral(a, b)) for a in range(10) for b in range(10))
VERHOEFF_P = "".join(str(x) for row in _powers(VERHOEFF_STEP, 8) for x in row)


def name_score(column: Column) -> Column:
    """The best score of all patterns that a column name fits, else 0."""
    name = F.lower(column)
    return F.greatest(F.lit(0.0), *[F.when(name.rlike(p), F.lit(s)).otherwise(0.0) for p, s in NAME_PATTERNS])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _all_equal(d: Column) -> Column:
    return F.replace(d, F.substring(d, 1, 1), F.lit("")) == ""


def valid_aadhaar(value: Column) -> Column:
    """Twelve digits from 2 up, not all equal, with a right Verhoeff check digit."""
    d = digits(value)
    at = lambda table, row, col: F.substring(F.lit(table), row * 10 + col + 1, F.lit(1)).cast("int")
    digit = lambda i: F.substring(d, F.lit(12) - i, F.lit(1)).cast("int")
    check = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), lambda c, i: at(VERHOEFF_D, c, at(VERHOEFF_P, i % 8, digit(i))))
    return F.when(d.rlike("^[2-9][0-9]{11}$"), ~_all_equal(d) & (check == 0)).otherwise(False)


def valid_luhn(value: Column) -> Column:
    """13 to 19 digits, not all equal, that pass the Luhn test."""
    d = digits(value)
    return F.when(d.rlike("^[0-9]{13,19}$"), ~_all_equal(d) & F.call_function("luhn_check", d)).otherwise(False)


def valid_pan(value: Column) -> Column:
    return F.upper(F.trim(value)).rlike(rf"^[A-Z]{{3}}[{PAN_STATUS}][A-Z][0-9]{{4}}[A-Z]\z")


def valid_gstin(value: Column) -> Column:
    v = F.upper(F.trim(value))
    return v.rlike(r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\z") & valid_pan(F.substring(v, 3, 10))


_GROUP, _QUAD = "[0-9A-Fa-f]{1,4}", r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def _ipv6_pattern() -> str:
    """All groups, or a gap for at least one group, the last two maybe as a quad."""
    forms = []
    for tail, size in ((_GROUP, 1), (_QUAD, 2)):
        forms.append(f"(?:{_GROUP}:){{{8 - size}}}{tail}")
        for left in range(8 - size):
            right = 7 - size - left
            head = f"(?:{_GROUP}:){{{left - 1}}}{_GROUP}" if left else ""
            forms.append(f"{head}::(?:{_GROUP}:){{0,{right}}}{tail}")
    forms += [f"(?:{_GROUP}:){{{n - 1}}}{_GROUP}::" for n in range(1, 8)] + ["::"]
    return "^(?:" + "|".join(forms) + r")\z"


IPV6 = _ipv6_pattern()


def valid_ipv6(value: Column) -> Column:
    return value.contains(":") & value.rlike(IPV6)


_CHECKS = {"aadhaar": valid_aadhaar, "pan": valid_pan, "gstin": valid_gstin, "credit_card": valid_luhn, "ipv6": valid_ipv6}


def signature_hits(value: Column, column_name: Column | str = "") -> dict[str, Column]:
    """For each signature: whether a value has it. Those that need a hint ask the name
    of the column, which may be a column itself."""
    named = F.lower(F.lit(column_name) if isinstance(column_name, str) else column_name)
    out = {}
    for name, pattern, _, hint in SIGNATURES:
        hit = value.rlike(pattern.removesuffix("$") + r"\z")
        hit = hit & _CHECKS[name](value) if name in _CHECKS else hit
        out[name] = named.rlike(hint) & hit if hint else hit
    return out


def text_trim(value: Column) -> Column:
    """A text without blanks at its edges, Unicode's included."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def candidates(value: Column) -> Column:
    """The trimmed value and its tokens without punctuation at the edges, each once."""
    whole = text_trim(value)
    tokens = F.transform(F.split(whole, r"(?U)\s+"), lambda t: F.regexp_replace(t, r"^[^\w+]+|\W+$", ""))
    return F.filter(F.array_distinct(F.concat(F.array(whole), tokens)), lambda t: t != "")


#: What every signature needs: a digit, an at sign, a colon, or pairs of letters with
#: dashes (a hardware address may have no digit).
LIKELY = "[0-9@:]|(?:[A-Fa-f]{2}-){5}[A-Fa-f]{2}"


def classify_leaf(value: Column, column_name: Column | str = "") -> Column:
    """Signatures that a value or one of its tokens has, in their fixed order."""
    place = {n: i for i, (n, *_) in enumerate(SIGNATURES)}

    def named(c: Column) -> Column:
        hits = [F.when(hit, F.struct(F.lit(place[n]).alias("place"), F.lit(n).alias("name"))) for n, hit in signature_hits(c, column_name).items()]
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    likely = F.filter(candidates(value), lambda c: c.rlike(LIKELY))
    # sorted and read off once: nothing above is evaluated again for each signature
    return F.transform(F.array_sort(F.array_distinct(F.flatten(F.transform(likely, named)))), lambda x: x["name"])


def weight_of(signatures: Column) -> Column:
    """The largest weight of a list of signatures, else 0."""
    return reduce(lambda rest, s: F.when(F.array_contains(signatures, s[0]), F.lit(s[2])).otherwise(rest), sorted(SIGNATURES, key=lambda s: s[2]), F.lit(0.0))
