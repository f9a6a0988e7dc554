"""Surrogates in plain Python: every entity of all texts in one dictionary."""

import hashlib
import hmac
import re
import struct

import regex
import xxhash

from lethe.llm import pii

NAMES = pii._names(None)
KINDS = {k: regex.compile(p) for k, p in pii.kinds(NAMES).items()}
ANY = regex.compile("|".join(f"(?:{p})" for p in pii.kinds(NAMES).values()))
LOWER = {w.lower(): g for w, g in NAMES.items()}
D5 = [[(a + b) % 5 if a < 5 and b < 5 else (a + b) % 5 + 5 if a < 5 else (a - b) % 5 + 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
P5 = [list(range(10)), [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]]
while len(P5) < 8:
    P5.append([P5[1][x] for x in P5[-1]])


def luhn(v):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(v)))) % 10 == 0


def verhoeff(v):
    c = 0
    for k, d in enumerate(map(int, reversed(v))):
        c = D5[c][P5[k % 8][d]]
    return c == 0 and len(v) == 12 and v[0] in "23456789" and len(set(v)) > 1


def draw(seed, i, n):
    h = xxhash.xxh64_intdigest(seed, 42)
    h = xxhash.xxh64_intdigest(i if isinstance(i, str) else struct.pack("<i", i), h)
    return (h - (1 << 64) if h >> 63 else h) % n


def letters(value, seed, alphabets=pii._ALPHABETS):
    out = ""
    for i, c in enumerate(value):
        own = next((a for a in alphabets if c in a), None)
        large = next(((f, n) for f, n in pii._LARGE if f <= ord(c) < f + n), None)
        out += own[draw(seed, i, len(own))] if own else chr(large[0] + draw(seed, i, large[1])) if large else c
    return out


def checked(value, seed, head, valid):
    last = [d for d in "0123456789" if valid(head + d) == valid(value)]
    return head + last[draw(seed, "last", len(last))]


def more(words, seed, n):
    return "".join(words[draw(seed, 8 + j, len(words))] for j in range(1, n + 1))


def surrogate(kind, value, gender, attempt, key):
    seed = hmac.new(key, f"{kind}|{value}|{attempt}".encode(), hashlib.sha256).hexdigest()
    own, hexa = letters(value, seed), ["0123456789abcdef"]
    syllables = {s: w.split() for s, w in pii._SYLLABLES.items()}
    first = lambda *groups: next(g[draw(seed, "first", len(g))] for g in groups if value[0] in g)
    if kind == "ip":
        a = value.split(".")
        free = [str(draw(seed, i, 254) + 1) for i in (2, 3, 4)]
        narrow = re.match(r"(192\.168|172\.(1[6-9]|2\d|3[01])|127\.0|169\.254)\.", value)
        if a[0] == "10" or narrow and attempt >= 8:
            return ".".join(["10", *free])
        if narrow:
            return ".".join([*a[:2], *free[1:]])
        return ".".join([str([n for n in range(11, 224) if n not in (127, 169, 172, 192)][draw(seed, 1, 209)]), *free])
    if kind in ("secret", "mac"):
        return letters(value, seed, hexa)
    if kind == "ipv6":
        keep = re.match("(?:fe[89ab]|f[cd])[^:]{0,2}|", value)[0]
        return keep + letters(value[len(keep) :], seed, hexa)
    if kind == "card":
        return checked(value, seed, own[:-1], luhn)
    if kind == "aadhaar":
        return checked(value, seed, first("23456789") + own[1:11], verhoeff)
    if kind == "phone":
        return first("6789", "2345", "01") + own[1:]
    if kind == "pan":
        return own[:3] + value[3] + own[4:]
    if kind == "gstin":
        return own[:5] + value[5] + own[6:12] + value[12:14] + own[14]
    if kind == "ifsc":
        return own[:4] + value[4] + own[5:]
    if kind in ("upi", "email"):
        front, back = value.split("@") if kind == "upi" else value.rsplit(".", 1)
        return more(pii._ALPHABETS[0], seed, attempt) + letters(front, seed) + ("@" if kind == "upi" else ".") + back
    part, _, script = kind.partition("_")
    if part == "given" and f"{script}_{gender}" in pii._GIVEN:
        words = pii._GIVEN[f"{script}_{gender}"].split()
        return (words[draw(seed, 1, len(words))] + more(syllables[script], seed, attempt)).lower()
    if part == "family" and script in syllables:
        return "".join(syllables[script][draw(seed, i, len(syllables[script]))] for i in range(1, 5)) + more(syllables[script], seed, attempt)
    return own + own[0] * attempt if script == "other" else own


def kind_of(mention):
    return next(k for k, p in KINDS.items() if p.fullmatch(mention))


def title_of(mention):
    t = mention.split(" ")[0]
    return next((g for g, ts in pii.TITLES.items() if t in ts or t.removesuffix(".") in ts), None)


def units(mention):
    kind, digits = kind_of(mention), re.sub(r"\D", "", mention)
    if kind == "name":
        title, words = title_of(mention), mention.split(" ")
        words = words[1:] if title else words
        out = []
        for i, w in enumerate(words):
            script = next((s for s in ("Cyrillic", "Greek", "Latin") if regex.search(rf"\p{{{s}}}", w)), "other").lower()
            gender = title if title in ("m", "f") else LOWER.get(w.lower(), "n")
            out.append((f"given_{script}", w.lower(), gender) if i < len(words) - 1 else (f"family_{script}", w.lower(), "n"))
        return out
    if kind == "phone":
        abroad = re.sub(r"\D", "", re.sub(r"^\+\d{1,3}", "", mention)) if re.match(r"\+\d{1,3}[ .(-]", mention) else digits[2:] if mention[0] == "+" else digits
        return [(kind, abroad[-10:], "n")]
    return [(kind, digits if kind in ("card", "ssn", "aadhaar") else mention.lower(), "n")]


def dressed(mention, kind, new):
    if kind in ("phone", "card", "ssn", "aadhaar"):
        left, out = len(re.sub(r"\D", "", mention)) - len(new), ""
        for c in mention:
            if c.isdigit():
                out += new[-left] if left <= 0 else c
                left -= 1
            else:
                out += c
        return out
    if kind == "ip":
        return new
    if kind in ("secret", "mac", "ipv6", "pan", "gstin", "ifsc", "voter", "passport"):
        return new.upper() if mention == mention.upper() else new
    longer = max(0, len(new) - len(mention))
    return new[:longer] + "".join(n.upper() if regex.match(r"\p{Lu}", m) else n for m, n in zip(mention, new[longer:]))


def surrogates(texts, key):
    found = [[m[0] for m in ANY.finditer(t or "")] for t in texts]
    genders = {}
    for ms in found:
        for m in ms:
            for kind, value, g in units(m):
                genders.setdefault((kind, value), set()).add(g)
    gender = {e: "m" if "m" in g and "f" not in g else "f" if "f" in g and "m" not in g else "n" for e, g in genders.items()}
    attempt = dict.fromkeys(gender, 0)
    new = {e: surrogate(*e, gender[e], 0, key) for e in gender}
    while True:
        held = {}
        for e in sorted(new, key=lambda e: (attempt[e], e[1])):
            held.setdefault((e[0], new[e]), []).append(e)
        lost = [e for (kind, n), es in held.items() for e in (es if (kind, n) in gender else es[1:])]
        if not lost:
            break
        for e in lost:
            attempt[e] += 1
            new[e] = surrogate(*e, gender[e], attempt[e], key)

    def put(m):
        own = [new[u[:2]] for u in units(m)]
        if kind_of(m) != "name":
            return dressed(m, kind_of(m), own[0])
        title = m.split(" ")[:1] if title_of(m) else []
        words = m.split(" ")[len(title) :]
        return " ".join([*title, *(n.upper() if w == w.upper() and len(w) > 1 else n[:1].upper() + n[1:] for n, w in zip(own, words, strict=True))])

    return [(None if t is None else ANY.sub(lambda m: put(m[0]), t), len(ms), tuple(sorted({kind_of(m) for m in ms}))) for t, ms in zip(texts, found, strict=True)]
