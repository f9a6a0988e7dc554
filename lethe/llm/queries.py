"""The registered queries of the training-data operators, and their SQL.

Each query applies one operator with production parameters to its whole table.
Queries without SQL are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat import chat_digests
from .common import table
from .decontam import contamination
from .exact import exact_groups
from .pii import surrogate_texts
from .quality import quality_scores
from .sharding import jump_shards
from .simhash import simhash_components
from .spm import encode_documents
from .spelling import spelling_variants
from .substring import duplicate_spans
from .toxicity import toxicity_scores
from .trie import trie_nodes
from .weighted import edited_fingerprints

#: For the registered query only; real keys are the caller's.
DEMO_KEY = b"lethe demonstration key"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_spans(table(spark, sf_dir, "documents")).drop("spans")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate_texts(table(spark, sf_dir, "documents"), DEMO_KEY)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    fixed = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digests(rows.unionAll(fixed))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards(table(spark, sf_dir, "documents"))


def op11_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_substring_dedup, op3_quality, op4_exact_dedup, op5_pii_surrogates, op6_decontamination, op7_sentencepiece, op8_chat_format, op9_simhash, op10_jump_sharding, op11_weighted_fingerprints, op12_prefix_trie, op13_spelling_variants)}

_ESCAPED = "replace({0}, '\\', '\\\\')"
for _c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"):
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

#: The table of the reflected CRC-32 polynomial, as a SQL list.
_CRC = []
for _n in range(256):
    for _ in range(8):
        _n = _n >> 1 ^ (0xEDB88320 if _n & 1 else 0)
    _CRC.append(_n)
_SHARD = """(SELECT doc_id, max(b) AS shard FROM (WITH RECURSIVE j AS (
        SELECT doc_id, CAST(CASE WHEN doc_id < 0 THEN doc_id + 18446744073709551616 ELSE doc_id END AS HUGEINT) AS k, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS nxt FROM documents
        UNION ALL SELECT doc_id, k2, nxt, CAST(floor((nxt + 1) * (CAST(2147483648.0 AS DOUBLE) / ((k2 // 8589934592) + 1))) AS BIGINT)
        FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM j WHERE nxt < {0}) n)
        SELECT * FROM j) x GROUP BY 1)"""



def _crc_sql(hexed: str) -> str:
    """CRC-32 of a text from its hex digits, byte by byte."""
    digit = lambda k: f"strpos('0123456789ABCDEF', substr(b, {k}, 1))"  # noqa: E731
    bytes_ = f"list_transform(regexp_extract_all({hexed}, '..'), lambda b: CAST({digit(1)} * 16 + {digit(2)} - 17 AS BIGINT))"
    table_ = "[" + ", ".join(map(str, _CRC)) + "]"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, x: xor(c >> 8, CAST({table_}[(xor(c, x) & 255) + 1] AS BIGINT))), 4294967295)"

#: The letters from U+00C0 to U+00FF, and as many ASCII characters that no word has, for functions on bytes.
_LETTERS = "".join(map(chr, range(0xC0, 0x100)))
_STAND_INS = "".join(chr(c) for c in range(33, 127) if not chr(c).islower() and chr(c) not in "'\\")[: len(_LETTERS)]

ORACLE_SQL = {
    "op12_prefix_trie": rf"""
        WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS p
                   FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) x),
        c AS (SELECT conv_id, {_crc_sql('h')} % 4 AS h FROM (SELECT DISTINCT conv_id, hex(CAST(conv_id AS VARCHAR)) AS h FROM t) x),
        r AS (SELECT c.conv_id, 0 AS own, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND p <= h
              UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE p > h),
        k AS (SELECT conv_id, row_number() OVER one AS depth, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER one) AS node, text
              FROM r WINDOW one AS (PARTITION BY conv_id ORDER BY own, p)
              UNION ALL SELECT conv_id, 0, 'root', NULL FROM c),
        l AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM k),
        n AS (SELECT node, min(depth) AS depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids,
                     len(list_filter(string_split_regex(coalesce(min(text), ''), '[ 	-]+'), lambda x: x <> '')) AS words FROM l GROUP BY node),
        kids AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY 1),
        v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * words AS saved FROM n LEFT JOIN kids USING (node)),
        below AS (SELECT l.node, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM v JOIN l ON l.conv_id = v.conv_id AND l.depth <= v.depth GROUP BY 1)
        SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(v.ids, '')) AS ends_sha256
        FROM v JOIN below ON below.node = v.node LEFT JOIN v up ON up.node = v.parent""",
    "op13_spelling_variants": f"""
        WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
        one AS (SELECT doc_id, w, count(*) AS n, hex(CAST(doc_id AS VARCHAR) || ':' || w) AS x FROM runs WHERE length(w) >= 7 GROUP BY ALL),
        hashed AS (SELECT w, n, {_crc_sql('x')} AS h FROM one),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, translate(word, '{_LETTERS}', '{_STAND_INS}') AS plain
                  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed) x
                  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM words a JOIN words b ON left(a.plain, 3) = left(b.plain, 3) AND abs(length(a.plain) - length(b.plain)) <= 1 AND levenshtein(a.plain, b.plain) = 1
                  UNION SELECT a.word, b.word, b.n FROM words a JOIN words b ON right(a.plain, 3) = right(b.plain, 3) AND abs(length(a.plain) - length(b.plain)) <= 1 AND levenshtein(a.plain, b.plain) = 1),
        near AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
        forms AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM words LEFT JOIN near USING (word)),
        steps AS (SELECT word, word AS root, form FROM forms UNION ALL SELECT steps.word, steps.form, forms.form FROM steps JOIN forms ON forms.word = steps.form)
        SELECT forms.word, forms.form, steps.root, n, n_near, form_n FROM forms JOIN steps ON steps.word = forms.word AND steps.form IS NULL""",
    "op10_jump_sharding": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, hex(coalesce(text, '')) AS h, hex(CAST(doc_id AS VARCHAR)) AS ih FROM documents),
        r AS (SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size, {_crc_sql('h')} AS text_crc32, {_crc_sql('ih')} % 4096 AS block FROM d)
        SELECT r.doc_id, size, text_crc32, 'key' AS law, CAST(s.shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY s.shard ORDER BY block, r.doc_id) - 1 AS slot, CAST(g.shard AS INTEGER) AS grown_shard
        FROM r JOIN {_SHARD.format(16)} s ON s.doc_id = r.doc_id JOIN {_SHARD.format(17)} g ON g.doc_id = r.doc_id""",
    "op2_substring_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        win AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w) t),
        dup AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM win) t WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM dup),
        every AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM every ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op6_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0) x) y),
        dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) m WHERE len(ws) >= n) y),
        hit AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, k)),
        words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) t GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) t GROUP BY 1)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op8_chat_format": f"""
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        m AS (
            SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) THEN 0 ELSE 1 END AS opens FROM r)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
               CAST(sum(length({_ESCAPED.format('text')}) + CASE WHEN opens = 1
                    THEN length('<|im_start|><|im_sep|><|im_end|>') + length({_ESCAPED.format('role')}) ELSE length('<|im_next|>') END) AS BIGINT) AS formatted_chars,
               CAST(sum(opens) AS BIGINT) AS n_blocks
        FROM m GROUP BY conv_id""",
}
