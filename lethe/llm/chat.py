"""Chat formatting as a relational job, in Spark expressions only.

A conversation's rows are collected as structs, sorted by turn, merged where
adjacent turns have one role, and concatenated by a template:

    <|im_start|>role<|im_sep|>text[<|im_next|>text ...]<|im_end|>

``<|im_next|>`` parts merged turns, so that each can be read back. In texts and
roles a backslash is doubled, and one is put behind the first character of every
control string (those of the template and some of other common templates), so
that none occurs in the output but as markup; dropping the escapes gives the
text back exactly.

Edge cases: null texts and roles count as empty; ties of turn are ordered by
role, then text; repeated rows are turns of their own; null turns come first;
rows without a conv_id are one conversation of their own; an empty table gives an empty
result; other columns are ignored. Texts of any length are escaped whole, inside expressions; a
conversation's texts are one row, so a task holds one conversation at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
#: What no text may hold in the output, as prefixes that are enough to tell.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(rows: DataFrame, train_on: str = "assistant") -> DataFrame:
    """conv_id, segments (array of text and loss flag; the loss mask covers the
    segments of ``train_on`` texts, without markup), formatted (the segments'
    concatenation) and n_blocks (turns after merging)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    at = lambda i: F.get("turns", i)
    first = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"]))
    talks = talks.withColumn("first", first)
    stop = lambda k: F.coalesce(F.get("first", k + 1), F.size("turns"))
    block = lambda i, k: F.struct(at(i)["role"].alias("role"), F.transform(F.slice("turns", i + 1, stop(k) - i), lambda t: t["text"]).alias("texts"))
    talks = talks.withColumn("blocks", F.transform("first", block))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def spelt(b: Column) -> Column:
        own = b["role"] == train_on
        part = lambda t, i: F.array(segment(F.when(i > 0, F.lit(NEXT)).otherwise(F.concat(F.lit(START), escape(b["role"]), F.lit(SEP))), no), segment(escape(t), own))
        return F.concat(F.flatten(F.transform(b["texts"], part)), F.array(segment(F.lit(END), no)))

    talks = talks.withColumn("segments", F.flatten(F.transform("blocks", spelt)))
    return talks.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.size("blocks").cast("long").alias("n_blocks"))


def read_back(formatted: Column) -> Column:
    """The turns (role and text) of a formatted conversation, in order."""
    quoted = lambda s: rf"\Q{s}\E"
    bodies = F.filter(F.split(formatted, quoted(START)), lambda b: b != "")
    body = lambda b: F.regexp_replace(F.substring_index(b, END, 1), rf"(?s)^.*?{quoted(SEP)}", "")
    turns = lambda b: F.transform(F.split(body(b), quoted(NEXT)), lambda t: F.struct(unescape(F.substring_index(b, SEP, 1)).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(bodies, turns))


def chat_digests(rows: DataFrame, train_on: str = "assistant") -> DataFrame:
    """What reading the formatted conversations back gives: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks."""
    out = format_conversations(rows, train_on).withColumn("turns", read_back(F.col("formatted")))
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("loss_text", loss)
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "n_blocks")
