"""The training-data operators against brute force, on small and awkward tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

import plain_pii
from lethe.functions import classify
from lethe.llm import chat, decontam, exact, pii, quality, sharding, simhash, spm, substring, toxicity

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score double, print long, kept boolean"


def words(t):
    return (t or "").encode().split()


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def make(n=60, seed=1):
    """Texts with passages in common, near and exact copies, nulls, blanks, long ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ß", "漢字"]
    passage = [" ".join(r.choice(vocabulary) for _ in range(k)) for k in (19, 20, 21, 45, 120)]
    rows = [None, "", "   ", "\n", "one", "one  two", " one two", "one two ", "a" * 5000, "x " * 300, "x " * 300, " ".join(vocabulary * 60)]
    for _ in range(n):
        own = [r.choice(vocabulary) for _ in range(r.randrange(0, 90))]
        own.insert(r.randrange(0, len(own) + 1), r.choice(passage))
        rows.append(r.choice((" ", "\t", "  ")).join(own))
    rows += [rows[20], rows[20], rows[25] + " end", rows[30].upper()]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, 0.5, 7, False) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_substring(docs, rows, empty):
    seen, want = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.duplicate_spans(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 500
    assert substring.duplicate_spans(empty).count() == 0


def test_substring_of_one_word_texts(spark):
    texts = ["a " * 25, "a " * 19, "a " * 20 + "b"]
    got = substring.duplicate_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_removed) for r in got} == {(0, 24), (1, 0), (2, 20)}


def test_substring_hashes_only_what_it_looks_up(monkeypatch):
    """Blocks bring their lengths, so that later passes don't cut texts again: of a text with one block to look up (15
    windows from word 100 on) 34 words are hashed, and none for the result."""
    import pyarrow as pa

    hashed, real = [], substring.word_hashes
    monkeypatch.setattr(substring, "word_hashes", lambda words, *seed: hashed.extend(words) or real(words, *seed))
    text = " ".join(f"w{k}" for k in range(5000))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text], "firsts": pa.array([[2 * (100 * 15 + 14) + 1, 2 * 9]], pa.list_(pa.int64())), "fresh": pa.array([[101, 102]], pa.list_(pa.int32()))})
    (out,) = substring._boundaries(20, 6)(iter([batch]))
    assert sorted(out.column("at").to_pylist()) == list(range(100, 115)) and hashed == [f"w{k}".encode() for k in range(100, 134)]
    (out,) = substring._factor(20, 6)(iter([batch]))
    # windows 0 to 9 stand first, 101 and 102 are looked up and new, all others repeat
    assert out.column("spans").to_pylist() == [[{"start": 10, "end": 5000}]] and out.column("n_removed").to_pylist() == [4990] and len(hashed) == 34


@pytest.mark.parametrize("bits", [64, 3])
def test_exact(docs, rows, empty, bits):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {r.doc_id: tuple(r)[1:] for r in exact.exact_groups(docs, print_bits=bits).collect()} == want
    assert exact.exact_groups(empty).count() == 0


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_with_repeated_and_null_ids(spark, docs, rows, bits):
    """Rows count one by one, whatever ids they have."""
    text = dict(rows)
    own = [(0, text[20]), (0, text[20]), (100, text[20]), (None, text[20]), (None, text[21]), (None, text[21]), (5, text[22]), (5, text[23]), (3, text[23]), (7, ""), (None, None)]
    table = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    groups = defaultdict(list)
    for i, t in own:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    want = []
    for t, g in groups.items():
        least = min((i for i in g if i is not None), default=None)
        want += [(i, least, len(g), i == least, hashlib.sha256(t.encode()).hexdigest()) for i in g]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in exact.exact_groups(table, print_bits=bits).collect()), key=key) == sorted(want, key=key)
    left = sorted(map(tuple, exact.drop_copies(table, print_bits=bits).collect()), key=key)
    assert left == sorted([(0, text[20]), (None, text[20]), (None, text[21]), (None, text[21]), (5, text[22]), (3, text[23]), (7, ""), (None, None)], key=key)


def test_decontamination_of_a_long_item(spark, monkeypatch):
    """An item is cut into pieces that go to different slices."""
    monkeypatch.setattr(decontam, "_PIECE", 50)
    item = [f"x{k}" for k in range(700)]
    bench = spark.createDataFrame([("long", " ".join(item))], "item_id string, text string")
    texts = [" ".join(item[at : at + 10 + at % 7]) for at in range(0, 690, 13)] + [" ".join(item), "x1 x2 x3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (64 << 20, 4000):
        got = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.contamination(docs, bench, broadcast_bytes=size).collect()}
        assert got == {i: (len(t.split()), 1) if len(t.split()) >= 10 else (0, 0) for i, t in enumerate(texts)}


def test_chunks():
    r = random.Random(2)
    text = bytes(r.randrange(256) for _ in range(60_000)) + b"z" * 70_000
    ends = exact.cuts(text)
    assert ends[-1] == len(text) and all(0 < b - a <= 16384 for a, b in zip([0, *ends], ends))
    moved = exact.cuts(b"put in front" + text)
    assert len({text[a:b] for a, b in zip([0, *ends], ends)} & {(b"put in front" + text)[a:b] for a, b in zip([0, *moved], moved)}) > 10


def test_drop_copies_of_repeated_rows(docs):
    left = exact.drop_copies(docs.unionAll(docs.where("doc_id = 20")))
    assert left.columns == docs.columns and left.where("doc_id = 20").count() == 1
    assert left.count() == exact.exact_groups(docs).where("kept").count()


@pytest.mark.parametrize("size", [64 << 20, 800])
def test_decontamination(spark, docs, rows, empty, size):
    items = [(1, "W1 w2, w3"), (2, rows[20][1]), (10, " ".join(f"w{i}" for i in range(30))), (3, None), (4, "?!"), (10, "One"), (None, "w5 w6 w7 w8 w9")]
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("null" if i is None else str(i))
    want = {}
    for i, t in rows:
        w, hit, found = word.findall(low(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    got = {r.doc_id: tuple(r)[1:] for r in decontam.contamination(docs, bench, broadcast_bytes=size).collect()}
    assert got == want
    again = docs.where("doc_id in (4, 20, 21)")
    nameless = again.withColumn("doc_id", F.lit(None).cast("long"))
    got = sorted(map(str, decontam.contamination(again.unionAll(again).unionAll(nameless).unionAll(nameless), bench, broadcast_bytes=size).collect()))
    assert got == sorted(str(Row(doc_id=i, n_words=w[0], n_hit=w[1], n_items=w[2], items_sha256=w[3], contaminated=w[4])) for k in (4, 20, 21) for w in [want[k]] for i in (k, k, None, None))
    kept = {r.doc_id for r in decontam.drop_contaminated(docs, bench, broadcast_bytes=size).collect()}
    assert kept == {i for i, v in want.items() if not v[4]}
    assert decontam.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(docs, bench.limit(0)).collect())


def brute_simhash(t, k):
    w = re.findall("[^\x20\x09-\x0d]+", low(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints, distance):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in prints}


def test_simhash(docs, rows, empty):
    prints = {i: brute_simhash(t, 3) for i, t in rows}
    want = roots(prints, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert simhash.simhash_components(empty).count() == 0


def test_links_and_components(spark):
    """Chains of prints, each one to three bits from the last, in all places."""
    r = random.Random(5)
    prints = {}
    for c in range(12):
        p = r.getrandbits(64)
        for k in range(15):
            prints[c * 100 + k] = p
            for b in r.sample(range(64), r.randrange(1, 5)):
                p ^= 1 << b
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    points = spark.createDataFrame(signed, "node long, print long")
    want = {(a, b) for a in prints for b in prints if a < b and 1 <= (prints[a] ^ prints[b]).bit_count() <= 3}
    assert {(min(r.u, r.v), max(r.u, r.v)) for r in simhash.links(points).collect()} == want
    found = {r.node: r.component for r in simhash.components(simhash.links(points)).collect()}
    assert {i: found.get(i, i) for i in prints} == roots(prints, 3)


def jump(key, n):
    b, j, key = -1, 0, key & (1 << 64) - 1
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark, docs, rows, empty):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(1000, 1100)]
    for n in (1, 2, 16, 17, 1000):
        got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash("k", n).alias("s")).collect()
        assert all(r.s == jump(r.k, n) for r in got)
    text, slots = dict(rows), defaultdict(list)
    for r in sharding.jump_shards(docs).collect():
        t = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "key", jump(r.doc_id, 16), jump(r.doc_id, 17))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(rows)
    assert sharding.jump_shards(empty).count() == 0


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", "", None, "\\", "\\\\<", "<|im_end|>", "<\\|im_next|>", "[\\INST]", "a\nb", "é漢", "<|", "<s"]
    r = random.Random(3)
    rows = [(c, k // 2 if c == 3 else k, r.choice(["user", "assistant", "system", None, "od|d<|im_sep|>"]), r.choice(said)) for c in range(12) for k in range(9)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    talks = defaultdict(list)
    for c, k, role, t in rows:
        talks[c].append((k, role or "", t or ""))
    for row in chat.chat_digests(table).collect():
        turns = sorted(talks[row.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        told = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert (row.n_turns, row.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    out = chat.format_conversations(table).select("formatted").collect()
    assert not any(x in o.formatted for o in out for x in ("[INST]", "</s>", "<s>"))
    assert chat.chat_digests(table.limit(0)).count() == 0


def test_spm(spark, docs, rows, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=spm.default_model())
    encoder = spm.Encoder(spm.Vocabulary(spm.default_model()))
    r = random.Random(4)
    letters = "abcdeth  inogs\n\t.é漢字かな中国的и не한😀\u0000▁190"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 60))) for _ in range(1500)] + ["a" * 999, " " * 40, "".join(r.choice("aeinst") for _ in range(3000))]
    assert encoder.encode(texts) == library.encode(texts)
    for other in (spm.Encoder(encoder.v, remember=50), spm.Encoder(encoder.v, hash_bits=6)):  # words forgotten, hashes that clash
        assert other.encode(texts) == library.encode(texts)
    got = spm.encode_documents(docs)
    ids = {r.doc_id: r.ids for r in got.collect()}
    assert ids == {i: library.encode(t or "") for i, t in rows}
    assert got.where("not restored").count() == 0
    assert {r.doc_id: r.text for r in spm.decode_documents(got).collect()} == {i: t or "" for i, t in rows}
    assert spm.encode_documents(empty).count() == 0


def test_spm_unigram_is_the_best_path():
    """Scores of a unigram model: the best of all segmentations."""
    import itertools

    import numpy as np

    v = spm.Vocabulary.__new__(spm.Vocabulary)
    pieces = ["a", "b", "c", "ab", "bc", "abc", "ca", "aa"]
    scores = np.array([-3.0, -2.5, -4.0, -4.1, -5.0, -7.4, -5.5, -5.9])
    v._set(list(enumerate(pieces)), scores, False, False)
    v.unknown, v.bytes = 0, {}
    encoder = spm.Encoder(v)

    def best(w):
        if not w:
            return 0.0
        return max(scores[pieces.index(w[:k])] + best(w[k:]) for k in range(1, 4) if w[:k] in pieces)

    for n in (1, 2, 5, 7):
        own = ["".join(p) for p in itertools.product("abc", repeat=n)][:300]
        for w, ids in zip(own, encoder.encode(own)):
            assert "".join(pieces[i] for i in ids) == w
            assert abs(sum(scores[i] for i in ids) - best(w)) < 1e-9


def test_surrogates(spark, empty):
    texts = ["Mail Joe.Bloggs@Mail7.example.com or joe.bloggs@mail7.example.com, +1 (017) 555-7713.", "017-555-7713 and 4111 1111 1111 1111, 4111-1111-1111-1112", "ip 10.0.0.7 8.8.8.8 end", "Mr. John Smith met Mrs SMITH, г-жа Иванова", None, "", "nothing 12 @ here", "joe.bloggs@mail7.example.com"]
    rows = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, kinds int")
    got = {r.doc_id: r for r in pii.surrogate_texts(rows, b"k").collect()}
    a = re.findall(r"\S+@\S+?(?=[ ,]|$)", got[0].text)
    assert a[0].lower() == a[1] == got[7].text and a[0][0].isupper() and a[1].endswith(".com") and "bloggs" not in a[1]
    digits = lambda t: re.sub(r"\D", "", t)[-10:]
    phone = re.search(r"\+1 (\(\d{3}\) \d{3}-\d{4})", got[0].text)[1]
    assert digits(phone) == digits(got[1].text[:12]) != "0175557713"
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", got[1].text)
    luhn = lambda c: sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(re.sub(r"\D", "", c))))) % 10 == 0
    assert luhn(cards[0]) and not luhn(cards[1]) and " " in cards[0] and "-" in cards[1]
    assert re.fullmatch(r"ip 10\.\d+\.\d+\.\d+ \d+\.\d+\.\d+\.\d+ end", got[2].text) and "8.8.8.8" not in got[2].text
    name = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+), г-жа ([А-Я][а-я]+)", got[3].text)
    assert name[2].upper() == name[3] and name[1] in pii._GIVEN["latin_m"].split() and "Иванова" not in got[3].text
    assert (got[4].text, got[5].text, got[6].text) == (None, "", "nothing 12 @ here") and got[6].n_entities == 0
    assert pii.surrogate_texts(empty, b"k").count() == 0
    again = {r.doc_id: r.text for r in pii.surrogate_texts(rows, b"other").collect()}
    assert again[0] != got[0].text


def test_surrogates_stay_distinct(spark):
    """A format with few values: 600 private addresses of two free octets."""
    values = [f"192.168.{i // 254 + 1}.{i % 254 + 1}" for i in range(600)]
    rows = spark.createDataFrame([(i, f"at {v} now") for i, v in enumerate(values)], "doc_id long, text string")
    got = [r.text.split()[1] for r in pii.surrogate_texts(rows, b"k").collect()]
    assert len(set(got)) == 600 and not set(got) & set(values)


def test_surrogates_of_more_values_than_a_pool_first_has(spark):
    """1,000 names of each kind, short and Chinese mail addresses, most of 192.168."""
    import itertools

    latin = ["".join(p) for p in itertools.product("bcdfghklmn", "aeiou", "bdfgklmnpr", "aeiou")][:1000]
    cyrillic = ["".join(p) for p in itertools.product("бвгдзклмнп", "аеиоу", "бвгдзклмнп", "аеиоу")][:1000]
    titles = [("Mr", latin), ("Mrs", latin), ("Dr", latin), ("г-н", cyrillic), ("г-жа", cyrillic), ("Prof", cyrillic)]
    names = [f"{t} {w.capitalize()} {w.capitalize()}" for t, ws in titles for w in ws]
    mails = [f"{a}@{b}.co" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"] + ["张三@例子.cn", "李四@例子.cn"]
    rows = spark.createDataFrame(list(enumerate(names + mails)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.surrogate_texts(rows, b"k").collect()}
    for k in range(6):
        new = [got[i].split()[1].lower() for i in range(k * 1000, k * 1000 + 1000)]
        assert len(set(new)) == 1000 and not set(new) & set(titles[k][1])
    new = [got[i] for i in range(len(names), len(got))]
    assert len(set(new)) == len(mails) and not set(new) & set(mails) and all(m.endswith((".co", ".cn")) for m in new)

    values = [f"192.168.{i // 254 + 1}.{i % 254 + 1}" for i in range(33_000)]
    held = spark.createDataFrame([("ip", v) for v in values], "kind string, value string")
    held = held.withColumn("gender", F.lit("n"))
    drawn = pii.settled(held, b"k").select(pii.surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.col("attempt"), b"k").alias("new"))
    new = {r.new for r in drawn.collect()}
    assert len(new) == len(values) and not new & set(values) and all(n.startswith(("192.168.", "10.")) for n in new)


def test_surrogates_of_one_entity_in_all_its_forms(spark):
    """Coreference over titles, spellings and scripts; genders, formats and checks that stay."""
    texts = [
        "Dr. John Smith met Mr. John Smith and John Smith; Ms John Smith? no", "Mr. Γιώργος Παπαδόπουλος, κα Ελένη Νικολάου, Prof. Παπαδόπουλος", "Mrs Andrea Jones and Mr Andrea Jones",
        "ip 2001:db8::1 2001:DB8::FF fe80::1 at 12:30:45 in std::vector", "+44 20 7946 0958, +919876543210 9876543210 +91 98765 43210",
        "PAN ABCPE1234F GSTIN 27ABCPE1234F1Z5 IFSC HDFC0001234 pass K1234567 voter ABC1234567 joe@okbank", "2345 6789 0124, 2345-6789-0123 AA-BB-CC-DD-EE-FF", "Mr. Հայկ Սարգսյան 张三@例子.cn",
        "Frau Anna Marie Schmidt", "John Smith", "Dr. Zbigniew Smith and Mr Zbigniew Smith",
    ]
    rows = spark.createDataFrame([*enumerate(texts), (None, texts[10]), (None, "John Smith")], "doc_id long, text string")
    out = pii.surrogate_texts(rows, b"k", given_names={"m": ["Zbigniew"]}).collect()
    got = {r.doc_id: r.text for r in out if r.doc_id is not None}
    assert sorted(r.text for r in out if r.doc_id is None) == sorted([got[10], got[9]])
    john, smith = got[9].split()
    assert got[0] == f"Dr. {john} {smith} met Mr. {john} {smith} and {john} {smith}; Ms {john} {smith}? no" and "Smith" not in got[0]
    greek = re.fullmatch(r"Mr\. ([Ͱ-ϿΆ-ώ]+) ([Ͱ-Ͽ]+), κα ([Ͱ-Ͽ]+) ([Ͱ-Ͽ]+), Prof\. ([Ͱ-Ͽ]+)", got[1])
    assert greek[1] in pii._GIVEN["greek_m"].split() and greek[3] in pii._GIVEN["greek_f"].split() and greek[2] == greek[5] != "Παπαδόπουλος"
    andrea = re.fullmatch(r"Mrs (\w+) (\w+) and Mr (\w+) (\w+)", got[2])
    assert andrea[1] == andrea[3] and andrea[2] == andrea[4] and any(andrea[1].startswith(n) for n in pii._GIVEN["latin_n"].split())
    assert re.fullmatch(r"ip [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f] [0-9A-F]{4}:[0-9A-F]{3}::[0-9A-F]{2} fe80::[0-9a-f] at 12:30:45 in std::vector", got[3]) and "db8" not in got[3].lower()
    phone = re.fullmatch(r"\+44 (\d\d \d{4} \d{4}), \+91(\d{10}) (\d{10}) \+91 (\d{5} \d{5})", got[4])
    assert phone[2] == phone[3] == phone[4].replace(" ", "") != "9876543210" and phone[2][0] in "6789" and phone[1] != "20 7946 0958"
    assert re.fullmatch(r"PAN [A-Z]{3}P[A-Z]\d{4}[A-Z] GSTIN \d\d[A-Z]{3}P[A-Z]\d{4}[A-Z]1Z\d IFSC [A-Z]{4}0\d{6} pass [A-Z]\d{7} voter [A-Z]{3}\d{7} [a-z]{3}@okbank", got[5])
    assert not any(x in got[5] for x in ("ABCPE1234F", "HDFC", "K1234567", "ABC1234567", "joe"))
    assert re.fullmatch(r"[2-9]\d{3} \d{4} \d{4}, [2-9]\d{3}-\d{4}-\d{4} (?:[0-9A-F]{2}-){5}[0-9A-F]{2}", got[6]) and "AA-BB" not in got[6]
    valid = lambda t: [r.v for r in spark.createDataFrame([(x,) for x in t], "t string").select(classify.valid_aadhaar(F.col("t")).alias("v")).collect()]
    assert valid(re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}", got[6])) == valid(["2345 6789 0124", "2345-6789-0123"])
    assert re.fullmatch(r"Mr\. [Ա-Ֆ][ա-և]{3} [Ա-Ֆ][ա-և]{7} [一-鿿]{2}@[一-鿿]{2}\.cn", got[7]) and "Հայկ" not in got[7] and "张" not in got[7]
    assert re.fullmatch(r"Frau \w+ \w+ \w+", got[8]) and not {"Marie", "Schmidt"} & set(got[8].split())
    assert got[10].split()[1] == got[10].split()[5] and any(got[10].split()[1].startswith(n) for n in pii._GIVEN["latin_m"].split())


def test_surrogates_of_a_hundred_thousand_names(spark):
    """Distinct names of one kind keep distinct surrogates."""
    name = F.concat(F.lit("Q"), F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "aeioubdfgk"))
    held = spark.range(100_000).select(F.lit("given_latin").alias("kind"), F.lower(name).alias("value"), F.lit("m").alias("gender"))
    drawn = pii.settled(held, b"k").select("value", pii.surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.col("attempt"), b"k").alias("new"))
    assert drawn.select("new").distinct().count() == 100_000 and drawn.join(drawn.select(F.col("new").alias("value")), "value").isEmpty()


def test_surrogates_against_plain_python(spark):
    """All rows of the smallest documents table, and some with every kind."""
    more = [(-1, "Dr. John Smith and Mrs Anna Berg, Mr Anna Berg; Joe.B@x.org, 192.168.0.1 10.1.2.3 8.8.4.4"), (-2, "4111 1111 1111 1111 and 017-555-7713, 123-45-6789, AB:CD:EF:01:23:45, joe@okbank, 2345 6789 0123"), (-3, "2001:db8::1, fe80::7, ABCPE1234F 27ABCPE1234F1Z5 HDFC0001234 K1234567 ABC1234567 deadbeefdeadbeefdeadbeefdeadbee1, г-жа Вера Иванова, John Smith"), (-4, None), (-4, ""), (-1, "John Smith")]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, str(r.text), r.n_entities, tuple(r.kinds)) for r in pii.surrogate_texts(docs, b"k").collect())
    assert got == sorted((i, str(t), n, k) for (i, _), (t, n, k) in zip(rows, plain_pii.surrogates([t for _, t in rows], b"k"), strict=True))
    assert len({k for *_, ks in got for k in ks}) == 16


def test_models_without_labels(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        q = quality.quality_scores(docs, table).collect()
        t = toxicity.toxicity_scores(docs, table).collect()
        assert len(q) == len(t) == docs.count() and all(0 <= r.score <= 1 for r in q + t)
    assert quality.quality_scores(empty, labels).count() == toxicity.toxicity_scores(empty, labels).count() == 0


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    out = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((out.predicted == out.quality).mean() > 0.95) and out[out.quality == 1].predicted.mean() > 0.98
    assert (out.predicted == (out.score >= 0.3)).all()


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    out = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.toxic).mean() > 0.93 and out[out.toxic == 0].predicted.mean() < 0.03


def test_every_toxic_word_is_learned(spark):
    """2,500 words, each in eight or more toxic rows only."""
    r = random.Random(11)
    words = sorted({"".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(2500)})
    rows = []
    for k in range(16):
        r.shuffle(words)
        rows += [(" ".join(words[at : at + 50]), 1) for at in range(0, len(words), 50)]
    rows += [(f"quite fine {k % 7}", 0) for k in range(4000)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int"))
    automaton = lexicon.automaton()
    assert len(words) == 2500 and sum(bool(lexicon.matches([w], automaton)) for w in words) == 2500


def test_toxic_words_in_disguise():
    lexicon = toxicity.Lexicon({" idiot": 5.0, " scum ": 4.0}, {("no", "idiot")})
    automaton = lexicon.automaton()
    hits = lambda t: set(lexicon.matches(toxicity.folded(t), automaton).values())
    assert hits("You 1D10T!") == hits("ｉｄｉｏｔｓ") == hits("іdіоt") == hits("id​iot") == {5.0}
    assert hits("no idiot") == hits("scumble 10101 x") == hits("") == hits(None) == set()
    assert hits("$cum") == {4.0}


def test_held_out_rows_teach_nothing(spark, tables):
    """Labels of held-out rows can be anything."""
    docs, labels = tables
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, t) for t in (labels, turned))
    assert (a.weights == b.weights).all() and a.bias == b.bias
