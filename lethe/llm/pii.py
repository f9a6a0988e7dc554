"""Surrogates for personal data, in Spark expressions only.

Entities are found by one pattern and replaced by keyed surrogates of their own
kind: letters by letters of the same case and script, digits by digits, so that
separators and length stay (but for redrawn mail addresses); network addresses stay
valid and private ones private; numbers that pass the Luhn or Verhoeff test still do;
country codes stay; names become names of the same gender and script.

Found are: mail and payment addresses, hexadecimal secrets, network (IPv4, IPv6,
MAC) addresses, social security, phone (international, 3-3-4, or ten digits from 6
up, in one or as 5-5), card, Aadhaar (in groups), PAN, GSTIN, IFSC, passport and voter
numbers, and names after a title or with a known given name (``GIVEN_NAMES``, to which the
caller may add), capitalised or in capitals. Not found are names with neither (also where
a title tells them elsewhere in the corpus), names after a title in capitals, street addresses,
dates, bare numbers of other lengths, and numbers that only a column's name explains.

A surrogate depends on the key, the kind and the normalised entity alone, so one
entity gets one surrogate in all documents, spellings and titles. A given name's
gender is the one its titles (or the list of known names) say anywhere in the corpus;
where they differ it gets a name of either gender. All entities of the corpus are
checked for collisions: where two would share a surrogate, or one would get what is
another's real value, all but the first draw anew, until none is left. With each draw
names get a syllable and mail addresses a letter more, private addresses whose
range is full go to 10/8, and short IPv6 addresses are written in full, so no corpus is too
large for these. In formats of a fixed number of digits, an entity that finds no free value in
twelve draws gets a mark like ``[ssn 5f0c...]`` instead, with 64 bits of its own.

Only entities that drew again or changed gender are joined to their documents, by a
salted key; all other surrogates are computed in place, without a shuffle of texts.

Edge cases: null texts stay null; texts without entities are unchanged; repeated rows
(with or without a doc_id) are replaced alike; of entities that draw the same, the
least value keeps it; an empty table gives an empty result; other columns are ignored.
Texts of any length are searched whole, a mention at a time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import IPV6, PAN_STATUS, valid_aadhaar
from .common import materialise

_UP = r"[\p{Lu}]"
#: Titles by gender; the last group leaves it open.
TITLES = {"m": ("Mr", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "г-н", "κ."), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "г-жа", "κα"), "n": ("Dr", "Prof")}
#: Given names by script and gender that surrogates start with, and syllables that they grow by and family names are made of.
_GIVEN = {
    "latin_m": "Adam Albert Bruno Carl Daniel Emil Felix Hugo Ivan Jonas Karl Leon Martin Oscar Paul Robert Simon Thomas Victor Walter",
    "latin_f": "Ada Alice Anna Berta Clara Diana Elena Emma Flora Greta Helena Irene Julia Laura Maria Nora Olga Paula Rosa Vera",
    "latin_n": "Alex Andrea Chris Dana Eden Jamie Jules Kim Lee Mika Noa Robin Sam Sasha Toni",
    "cyrillic_m": "Алексей Борис Виктор Глеб Иван Николай Олег Павел Сергей Фёдор",
    "cyrillic_f": "Алла Вера Галина Елена Ирина Мария Нина Ольга Раиса Татьяна",
    "cyrillic_n": "Женя Саша Валя Слава Шура",
    "greek_m": "Αλέξανδρος Ανδρέας Δημήτρης Κώστας Μιχάλης Νίκος Πέτρος Στέλιος",
    "greek_f": "Άννα Βασιλική Ειρήνη Ελένη Ζωή Κατερίνα Μαρία Σοφία",
    "greek_n": "Άρτεμις Άγγελις Μελίνης Φανής",
}
_SYLLABLES = {
    "latin": "bar ben cor dal den fal gar hal kel lan lor mar mel nor pel ran ros sal tan tor val ver wal win",
    "cyrillic": "бар вел гор дан зор кал лев мар нор пав рас сол тар фед хол чер",
    "greek": "βαλ γαρ δορ θαν καλ λεν μαρ νικ παν ρολ σαν τερ φιλ χαρ",
}
#: Given names by which a name without a title is told, besides those above.
GIVEN_NAMES = {
    "m": "James John William George Charles Henry David Richard Joseph Michael Peter Andrew Stephen Edward Frank Jack Hans Klaus Wolfgang Jürgen Stefan Pierre Jean Jacques Michel Luc José Juan Carlos Pedro Luis Miguel Иван Пётр Дмитрий Михаил Γιώργος Γιάννης".split(),
    "f": "Mary Elizabeth Sarah Susan Margaret Jane Linda Barbara Jennifer Patricia Ursula Ingrid Sabine Petra Heike Marie Sophie Claire Camille Carmen Lucía Isabel Pilar Dolores Анна Наталья Светлана Κατερίνα".split(),
}


def _names(more: dict[str, list[str]] | None) -> dict[str, str]:
    """The gender of each known given name."""
    own = {g: [*GIVEN_NAMES[g], *(w for k, ws in _GIVEN.items() if k.endswith(f"_{g}") for w in ws.split()), *((more or {}).get(g, ()))] for g in ("m", "f")}
    return {w: "n" if w in own["m"] and w in own["f"] else g for g in ("m", "f") for w in own[g]}


_TITLE = "|".join(t.replace(".", r"\.") for ts in TITLES.values() for t in ts)
_TITLED = rf"^(?:{_TITLE})\.?$"
_WORD = rf"{_UP}[\p{{L}}'’-]+"
_FREE = r"(?![\p{L}\p{N}])"
_LATIN_START = r"(?<![\p{L}\p{N}])"


def kinds(names: dict[str, str]) -> dict[str, str]:
    """Kinds and their patterns, in the order in which they are tried."""
    return {
        "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
        "upi": rf"(?<![\p{{L}}\p{{N}}._%+-])[A-Za-z0-9._-]{{2,256}}+@[A-Za-z]{{2,64}}(?![\p{{L}}\p{{N}}@-]|\.[\p{{L}}\p{{N}}])",
        "secret": rf"{_LATIN_START}(?=[0-9A-Fa-f]*[0-9])(?:[0-9a-f]{{32,64}}|[0-9A-F]{{32,64}}){_FREE}",
        "mac": rf"(?<![\p{{L}}\p{{N}}:-])(?:[0-9A-Fa-f]{{2}}:){{5}}[0-9A-Fa-f]{{2}}(?![\p{{L}}\p{{N}}:-])|(?<![\p{{L}}\p{{N}}:-])(?:[0-9A-Fa-f]{{2}}-){{5}}[0-9A-Fa-f]{{2}}(?![\p{{L}}\p{{N}}:-])",
        "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)(?=[A-Fa-f:]*[0-9])(?:{IPV6[4:-3]})(?![\p{{L}}\p{{N}}:]|\.\d)",
        "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        "phone": r"(?<![\p{L}\d+])\+\d{8,15}(?!\d)|(?<![\p{L}\d+])\+(?=(?:[ .()-]{0,2}\d){8})\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,5}){1,3}(?!\d)|(?<![\d.])(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\p{L}\d.,+-])[6-9]\d{4}[ -]?\d{5}(?![\p{L}\d-]|[.,]\d)",
        "card": r"(?<![\d.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])",
        "aadhaar": r"(?<![\d.-])[2-9]\d{3}(?: \d{4} \d{4}|-\d{4}-\d{4})(?![\d-])",
        "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
        "gstin": rf"{_LATIN_START}\d{{2}}[A-Z]{{3}}[{PAN_STATUS}][A-Z]\d{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]{_FREE}",
        "pan": rf"{_LATIN_START}[A-Z]{{3}}[{PAN_STATUS}][A-Z]\d{{4}}[A-Z]{_FREE}",
        "ifsc": rf"{_LATIN_START}[A-Z]{{4}}0[A-Z0-9]{{6}}{_FREE}",
        "voter": rf"{_LATIN_START}[A-Z]{{3}}\d{{7}}{_FREE}",
        "passport": rf"{_LATIN_START}[A-Z]\d{{7}}{_FREE}",
        "name": rf"(?<![\p{{L}}])(?:(?:{_TITLE})\.? {_WORD}(?: {_WORD}){{0,2}}|(?:{'|'.join(sorted({*names, *map(str.upper, names)}))}) {_WORD}(?: {_WORD})?)",
    }


#: What every kind of a group starts with, tested once before its patterns are.
_GUARDS = (
    (rf"{_LATIN_START}(?=[\p{{L}}\p{{N}}._%+-]++@)", ("email", "upi")),
    (rf"{_LATIN_START}(?=[0-9A-Fa-f:])", ("secret", "mac", "ipv6")),
    (r"(?<!\d)(?=[\d+(])", ("ssn", "phone", "card", "aadhaar", "ip")),
    (rf"{_LATIN_START}(?=[A-Z\d])", ("gstin", "pan", "ifsc", "voter", "passport")),
    (r"(?<!\p{L})(?=\p{Lu}|[гκ])", ("name",)),
)


def pattern(names: dict[str, str]) -> str:
    """All kinds in one, each group behind its guard."""
    own = kinds(names)
    return "|".join(f"{guard}(?:{'|'.join(f'(?:{own[k]})' for k in group)})" for guard, group in _GUARDS)


def _letters_of(first: int, last: int, lower: bool | None = None) -> str:
    """Letters of a range of code points; of a case that has a counterpart, if asked."""
    own = [c for c in map(chr, range(first, last + 1)) if c.isalpha()]
    return "".join(c for c in own if lower is None or (c.islower() == lower and len(c.swapcase()) == 1 and first <= ord(c.swapcase()) <= last))


#: Letters by script and case.
_ALPHABETS = (
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    _letters_of(0x100, 0x17F, True), _letters_of(0x100, 0x17F, False), _letters_of(0x386, 0x3CE, True), _letters_of(0x386, 0x3CE, False), _letters_of(0x400, 0x45F, True), _letters_of(0x400, 0x45F, False),
    _letters_of(0x531, 0x586, True), _letters_of(0x531, 0x586, False), _letters_of(0x5D0, 0x5EA), _letters_of(0x621, 0x63A) + _letters_of(0x641, 0x64A), _letters_of(0x905, 0x939), _letters_of(0xE01, 0xE2E), _letters_of(0x10D0, 0x10F0), _letters_of(0x3042, 0x3093), _letters_of(0x30A2, 0x30F3),
)
#: Scripts of very many letters: the first code point and how many follow.
_LARGE = ((0x4E00, 20_000), (0xAC00, 11_172))


def _hmac(key: bytes, message: Column) -> Column:
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda n: F.lit(bytes(k ^ n for k in key))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))), 256)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kind_of(mention: Column, names: dict[str, str]) -> Column:
    found = F.lit("other")
    for kind, p in reversed(kinds(names).items()):
        found = F.when(mention.rlike(f"^(?:{p})$"), F.lit(kind)).otherwise(found)
    return found


def units(mention: Column, names: dict[str, str]) -> Column:
    """The entities in a mention, as structs of kind, normalised value and gender: its
    digits (without a country code), its lower-cased spelling, or each word of a name."""
    digits = F.regexp_replace(mention, r"\D", "")
    abroad = F.when(mention.rlike(r"^\+\d{1,3}[ .(-]"), F.regexp_replace(F.regexp_replace(mention, r"^\+\d{1,3}", ""), r"\D", "")).when(F.startswith(mention, F.lit("+")), F.substring(digits, F.lit(3), F.length(digits))).otherwise(digits)

    def of(kind: Column) -> Column:
        value = F.when(kind == "phone", F.right(abroad, F.lit(10))).when(kind.isin("card", "ssn", "aadhaar"), digits).otherwise(F.lower(mention))
        return F.when(kind == "name", _name_units(mention, names)).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("value"), F.lit("n").alias("gender"))))

    return _let(kind_of(mention, names), of)


def _titled(mention: Column) -> Column:
    return F.substring_index(mention, " ", 1).rlike(_TITLED)


def _name_words(mention: Column) -> Column:
    words = F.split(mention, " ")
    return F.when(_titled(mention), F.slice(words, F.lit(2), F.size(words) - 1)).otherwise(words)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").when(word.rlike(r"\p{IsLatin}"), "latin").otherwise("other")


def _name_units(mention: Column, names: dict[str, str]) -> Column:
    title = F.substring_index(mention, " ", 1)
    bare = F.regexp_replace(title, r"\.$", "")
    by_title = F.when(title.isin(*TITLES["m"]) | bare.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]) | bare.isin(*TITLES["f"]), "f")
    known = F.create_map(*[F.lit(x) for w, g in sorted(names.items()) for x in (w.lower(), g)])
    words = _name_words(mention)
    unit = lambda kind, w, gender: F.struct(F.concat(F.lit(kind), _script(w)).alias("kind"), F.lower(w).alias("value"), gender.alias("gender"))
    given = lambda w: unit("given_", w, F.coalesce(by_title, F.try_element_at(known, F.lower(w)), F.lit("n")))
    return F.transform(words, lambda w, i: F.when(i < F.size(words) - 1, given(w)).otherwise(unit("family_", w, F.lit("n"))))


def _draw(seed: Column, i, choices: Column | int) -> Column:
    return F.pmod(F.xxhash64(seed, i if isinstance(i, Column) else F.lit(i)), F.lit(choices) if isinstance(choices, int) else choices).cast("int")


def _letters(value: Column, seed: Column, hexadecimal: bool = False) -> Column:
    """Every letter and digit by one of its alphabet; the rest stays."""
    alphabets = F.array(*[F.lit(a) for a in (("0123456789abcdef",) if hexadecimal else _ALPHABETS)])

    def one(c: Column, i: Column) -> Column:
        out = _let(F.filter(alphabets, lambda a: F.instr(a, c) > 0), lambda own: F.when(F.size(own) > 0, _let(F.get(own, F.lit(0)), lambda a: F.substring(a, _draw(seed, i, F.length(a).cast("long")) + 1, F.lit(1)))))
        for first, n in _LARGE:
            drawn = F.decode(F.unhex(F.hex((_draw(seed, i, n) + first).cast("long"))), "UTF-16BE")
            out = F.coalesce(out, F.when(F.ascii(c).between(first, first + n - 1), drawn))
        return F.coalesce(out, c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


#: Draws in a private address's own range, before all of 10/8 is open to it.
_OWN_RANGE = 8


def _address(value: Column, seed: Column, attempt: Column) -> Column:
    part = lambda k: F.element_at(F.split(value, r"\."), k)
    free = lambda i: _draw(seed, i, 254) + 1
    narrow = value.rlike(r"^(192\.168|172\.(1[6-9]|2\d|3[01])|127\.0|169\.254)\.")
    private = F.when((part(1) == "10") | (narrow & (attempt >= _OWN_RANGE)), F.concat_ws(".", F.lit("10"), free(2), free(3), free(4))).when(narrow, F.concat_ws(".", part(1), part(2), free(3), free(4)))
    first = F.element_at(F.array(*[F.lit(n) for n in range(11, 224) if n not in (127, 169, 172, 192)]), _draw(seed, 1, 209) + 1)
    return F.coalesce(private, F.concat_ws(".", first, free(2), free(3), free(4)))


#: Draws at an IPv6 address's own length, before it is written in full.
_OWN_LENGTH = 2
#: Draws after which a format counts as full and a mark takes the surrogate's place.
_MARKED = 12


def _address6(value: Column, seed: Column, attempt: Column) -> Column:
    """Of the same length and range, and from the third draw on all eight groups, in the
    range of the private or of the documentation addresses, which no corpus fills. A
    dotted end is an IPv4 address of its own."""
    groups = lambda start, first: F.concat_ws(":", start, *[F.substring(seed, F.lit(first + 4 * k), F.lit(4)) for k in range(6)])
    whole = F.when(value.rlike("^(?:fe[89ab]|f[cd])"), groups(F.concat(F.lit("fd"), F.substring(seed, 1, 2), F.lit(":"), F.substring(seed, 3, 4)), 7)).otherwise(groups(F.lit("2001:db8"), 7))
    local = "^(?:fe[89ab]|f[cd])[^:]{0,2}"
    hexes = F.concat(F.regexp_extract(value, f"({local}|)", 1), _letters(F.regexp_replace(value, local, ""), seed, True))
    front = F.regexp_extract(value, "^(.*:)[^:]*$", 1)
    mapped = F.concat(F.when(front.rlike("^::(ffff:(0:)?)?$|^64:ff9b:"), front).otherwise(_letters(front, seed, True)), _address(F.substring_index(value, ":", -1), seed, attempt))
    return F.when(F.contains(value, F.lit(".")), mapped).when(attempt >= _OWN_LENGTH, whole).otherwise(hexes)


def _checked(value: Column, seed: Column, head: Column, valid) -> Column:
    """``head`` with a last digit that makes it valid just where the value is."""
    was = valid(value)
    last = F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: valid(F.concat(head, d)) == was)
    return F.concat(head, F.coalesce(F.get(last, F.pmod(F.xxhash64(seed, F.lit("last")), F.greatest(F.size(last), F.lit(1))).cast("int")), F.lit("0")))


def _first_digit(value: Column, seed: Column, *groups: str) -> Column:
    """A first digit of the same group."""
    out = F.substring(value, 1, 1)
    for g in groups:
        out = F.when(F.instr(F.lit(g), F.substring(value, 1, 1)) > 0, F.substring(F.lit(g), _draw(seed, "first", len(g)) + 1, F.lit(1))).otherwise(out)
    return out


def _pick(words: str, seed: Column, i: int) -> Column:
    own = words.split()
    return F.element_at(F.array(*[F.lit(w) for w in own]), _draw(seed, i, len(own)) + 1)


def _more(words: str, seed: Column, n: Column) -> Column:
    """``n`` further syllables or letters."""
    own = F.array(*[F.lit(w) for w in words.split()])
    drawn = lambda j: F.element_at(own, _draw(seed, F.lit(8) + j, len(words.split())) + 1)
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), drawn), "")).otherwise("")


def surrogate(kind: Column, value: Column, gender: Column, attempt: Column, key: bytes) -> Column:
    """The normalised surrogate of an entity's normalised value."""
    return _let(_hmac(key, F.concat_ws("|", kind, value, attempt.cast("string"))), lambda seed: _drawn(kind, value, gender, attempt, seed))


def _drawn(kind: Column, value: Column, gender: Column, attempt: Column, seed: Column) -> Column:
    # names grow by a syllable with each attempt, and mail addresses by a letter, so that no pool has an end
    once = F.struct(_letters(value, seed).alias("letters"), _more(" ".join(_ALPHABETS[0]), seed, attempt).alias("grown"), *[_more(w, seed, attempt).alias(script) for script, w in _SYLLABLES.items()])
    return _let(once, lambda bound: _by_kind(kind, value, gender, attempt, seed, bound))


def _by_kind(kind: Column, value: Column, gender: Column, attempt: Column, seed: Column, bound: Column) -> Column:
    letters, grown = bound["letters"], bound["grown"]
    kept = lambda *places: F.concat(*[F.substring(value if old else letters, F.lit(a), F.lit(b - a + 1)) for a, b, old in places])
    endless = kind.isin("email", "upi", "ipv6") | F.startswith(kind, F.lit("given_")) | F.startswith(kind, F.lit("family_"))
    out = F.when((attempt >= _MARKED) & (~endless | F.contains(value, F.lit(".")) & (kind == "ipv6")), F.concat(F.lit("["), kind, F.lit(" "), F.substring(seed, 1, 16), F.lit("]")))
    out = out.when(kind == "ip", _address(value, seed, attempt)).when(kind.isin("secret", "mac"), _letters(value, seed, True)).when(kind == "ipv6", _address6(value, seed, attempt))
    out = out.when(kind == "card", _checked(value, seed, F.substring(letters, F.lit(1), F.length(value) - 1), lambda v: F.call_function("luhn_check", v)))
    out = out.when(kind == "aadhaar", _checked(value, seed, F.concat(_first_digit(value, seed, "23456789"), F.substring(letters, 2, 10)), valid_aadhaar))
    out = out.when(kind == "phone", F.concat(_first_digit(value, seed, "6789", "2345", "01"), F.substring(letters, F.lit(2), F.length(value))))
    # what is fixed in a format, or tells the kind of holder, stays
    out = out.when(kind == "pan", kept((1, 3, False), (4, 4, True), (5, 10, False))).when(kind == "gstin", kept((1, 5, False), (6, 6, True), (7, 12, False), (13, 14, True), (15, 15, False))).when(kind == "ifsc", kept((1, 4, False), (5, 5, True), (6, 11, False)))
    out = out.when(kind == "upi", F.concat(grown, F.substring_index(letters, "@", 1), F.regexp_extract(value, "(@.*)$", 1)))
    # the last label of a mail domain stays
    ending = F.regexp_extract(value, r"(\.[^.]+)$", 1)
    out = out.when(kind == "email", F.concat(grown, F.substring(letters, F.lit(1), F.length(value) - F.length(ending)), ending))
    for which, words in _GIVEN.items():
        script, own = which.split("_")
        out = out.when((kind == f"given_{script}") & (gender == own), F.lower(F.concat(_pick(words, seed, 1), bound[script])))
    for script, syllables in _SYLLABLES.items():
        out = out.when(kind == f"family_{script}", F.concat(*[_pick(syllables, seed, i) for i in range(1, 5)], bound[script]))
    return out.when(kind.isin("given_other", "family_other"), F.concat(letters, F.repeat(F.substring(letters, 1, 1), attempt))).otherwise(letters)


def _dressed(mention: Column, kind: Column, new: Column) -> Column:
    """A surrogate in the spelling of its mention: digits go where digits were (a
    country code before them stays), and capitals where capitals were."""
    count = lambda s: F.length(F.regexp_replace(s, r"\D", ""))
    place = lambda i: count(F.substring(mention, F.lit(1), i + 1)) - count(mention) + F.length(new)
    digits = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike(r"\d") & (place(i) > 0), F.substring(new, place(i), F.lit(1))).otherwise(c)), "")
    longer = F.greatest(F.length(new) - F.length(mention), F.lit(0))
    letter = lambda i: F.substring(new, longer + i + 1, F.lit(1))
    cased = F.concat(F.substring(new, F.lit(1), longer), F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(letter(i))).otherwise(letter(i))), ""))
    whole = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(new)).otherwise(new)
    return F.when(F.startswith(new, F.lit("[")), new).when(kind.isin("phone", "card", "ssn", "aadhaar"), digits).when(kind == "ip", new).when(kind.isin("secret", "mac", "ipv6", "pan", "gstin", "ifsc", "voter", "passport"), whole).otherwise(cased)


def _named(mention: Column, news: Column) -> Column:
    """A name's title, if it has one, with the surrogate words, capitalised (or in
    capitals) as they were."""
    fit = lambda n, w: F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(n)).otherwise(F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, F.lit(2), F.length(n))))
    return F.concat_ws(" ", F.when(_titled(mention), F.substring_index(mention, " ", 1)), F.zip_with(news, _name_words(mention), fit))


def settled(entities: DataFrame, key: bytes) -> DataFrame:
    """The attempt (kind, value, gender, attempt) at which none of the entities (kind,
    value, gender) shares a surrogate with another and none has another's real value.
    All draw once; then only those that lost draw, against all. Names and mail addresses
    have no end of values, and what has draws marks at last, so the rounds end."""
    draw = surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.col("attempt"), key)  # built once: it is a large expression
    state = materialise(entities.withColumn("attempt", F.lit(0)).withColumn("new", draw), "surrogates")
    real = state.select("kind", F.col("value").alias("new"), F.lit(True).alias("real"))
    while True:
        owner = state.groupBy("kind", "new").agg(F.min(F.struct("attempt", "value")).alias("owner"), F.count("*").alias("n"))
        lost = owner.join(real, ["kind", "new"], "left").where("n > 1 or real").select("kind", "new", F.when(F.col("real"), F.lit(None)).otherwise(F.col("owner.value")).alias("keeps"), F.lit(True).alias("lost"))
        lost = materialise(lost, "lost")
        if lost.isEmpty():
            return state.select("kind", "value", "gender", "attempt")
        again = F.col("lost") & (F.col("keeps").isNull() | (F.col("keeps") != F.col("value")))
        marked = state.join(lost, ["kind", "new"], "left").withColumn("again", F.coalesce(again, F.lit(False)))
        moved = marked.withColumn("attempt", F.col("attempt") + F.col("again").cast("int"))
        state = materialise(moved.withColumn("new", F.when(F.col("again"), draw).otherwise(F.col("new"))).select("kind", "value", "gender", "attempt", "new"), "surrogates")


#: Rows into which an entity that very many documents have is dealt.
_SALTS = 16


def surrogate_texts(docs: DataFrame, key: bytes, given_names: dict[str, list[str]] | None = None, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, text with every entity replaced, n_entities (mentions) and kinds
    (sorted) for every row. ``given_names`` adds names by gender ("m", "f") to those by
    which a name without a title is told.

    The table of what changed is joined by doc_id: broadcast up to ``broadcast_bytes``
    (measured), by a shuffle beyond that."""
    names = _names(given_names)
    every = pattern(names)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # rows without a doc_id are known by their text, so that they don't gather in one place
    place = (F.coalesce("doc_id", F.xxhash64("text")).alias("at"), F.isnull("doc_id").alias("nameless"))
    found = docs.withColumn("mentions", F.coalesce(F.regexp_extract_all("text", F.lit(every), F.lit(0)), F.array().cast("array<string>")))
    held = materialise(found.select("*", *place).where(F.size("mentions") > 0).select("at", "nameless", F.explode(F.array_distinct(F.flatten(F.transform(F.array_distinct("mentions"), lambda m: units(m, names))))).alias("u")).select("at", "nameless", "u.*"), "entities")
    says = lambda g: F.bool_or(F.col("gender") == g)
    entities = held.groupBy("kind", "value").agg(F.when(says("m") & ~says("f"), "m").when(says("f") & ~says("m"), "f").otherwise("n").alias("gender"), (F.min("gender") != F.max("gender")).alias("varies"))
    entities = materialise(entities, "entities")
    changed = settled(entities.drop("varies"), key).join(entities.select("kind", "value", "varies"), ["kind", "value"]).where("varies or attempt > 0")
    dealt = changed.select("kind", "value", F.col("gender").alias("own"), "attempt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    name = F.concat_ws("|", "kind", "value")
    redrawn = held.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(_SALTS)).cast("int")).join(dealt, ["kind", "value", "salt"])
    redrawn = redrawn.groupBy("at", "nameless").agg(F.map_from_entries(F.collect_set(F.struct(name.alias("entity"), F.struct(F.col("own").alias("gender"), "attempt")))).alias("again"))
    redrawn = materialise(redrawn, "redrawn")
    size = redrawn.agg(F.sum(F.aggregate(F.map_keys("again"), F.lit(32).cast("long"), lambda n, k: n + F.octet_length(k) + 32))).first()[0] or 0
    none = F.lit(None).cast("map<string,struct<gender:string,attempt:int>>")
    if not size:
        found = found.withColumn("again", none)
    else:
        side = F.broadcast(redrawn) if size <= broadcast_bytes else redrawn.hint("merge")
        found = found.join(side, (F.coalesce("doc_id", F.xxhash64("text")) == F.col("at")) & (F.isnull("doc_id") == F.col("nameless")), "left")

    def new(u: Column) -> Column:
        return _let(F.try_element_at(F.col("again"), F.concat_ws("|", u["kind"], u["value"])), lambda a: surrogate(u["kind"], u["value"], F.coalesce(a["gender"], u["gender"]), F.coalesce(a["attempt"], F.lit(0)), key))

    put = lambda m: _let(F.struct(units(m, names).alias("units")), lambda s: _let(F.transform(s["units"], new), lambda n: F.when(F.get(s["units"], F.lit(0))["kind"].rlike("^(given|family)_"), _named(m, n)).otherwise(_dressed(m, F.get(s["units"], F.lit(0))["kind"], F.get(n, F.lit(0))))))
    parts = F.split("text", every, -1)
    text = F.when(F.size("mentions") > 0, F.array_join(F.zip_with(parts, F.transform("mentions", put), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), F.size("mentions").cast("long").alias("n_entities"), F.array_sort(F.array_distinct(F.transform("mentions", lambda m: kind_of(m, names)))).alias("kinds"))
