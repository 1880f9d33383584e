r"""Chat formatting, in Spark expressions only.

A conversation becomes one string of blocks::

    ### role: text<next>text</turn>

Adjacent turns of one role share a block.  In roles and texts a backslash
becomes \e, # becomes \h, < becomes \l, and in roles : becomes \c, so that no
control string can come from a text and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import let

HEAD, COLON, NEXT, END = "### ", ": ", "<next>", "</turn>\n"
#: Escapes, the backslash first.
ESCAPES = (("\\", "\\e"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
LEARNED = "assistant"


def escaped(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, pairs=ESCAPES) -> Column:
    """The backslash last: after the others, each one left starts \\e."""
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _merged(turns: Column) -> Column:
    """Sorted turns as blocks of (role, texts): a block starts where the role changes."""

    def blocks(a: Column) -> Column:
        role = lambda i: F.element_at(a, i)["role"]
        starts = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: F.when(i == 1, True).otherwise(role(i) != role(F.greatest(i - 1, F.lit(1)))))
        end = lambda s, k: F.coalesce(F.get(s, k + 1), F.size(a) + 1)
        cut = lambda s: F.transform(s, lambda x, k: F.struct(role(x).alias("role"), F.transform(F.slice(a, x, end(s, k) - x), lambda t: t["text"]).alias("texts")))
        return let(starts, cut)

    return let(turns, blocks)


def _starts(lengths: Column, chunk: int = 256) -> Column:
    """0 and the sums of the first 1, 2, ... lengths, one for each length; in chunks, so that a long array isn't copied for each element."""
    start = lambda: F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("a"))
    step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a"))
    upto = lambda xs: F.aggregate(xs, start(), step, lambda acc: acc["a"])
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / chunk).cast("int") - 1), lambda i: F.slice(lengths, i * chunk + 1, chunk))
    both = lambda p: F.flatten(F.zip_with(p, upto(F.transform(p, total)), lambda xs, before: F.transform(upto(xs), lambda y: y + before)))
    return let(parts, both)


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from rows (conv_id, turn, role, text).

    loss_spans are (start, length): the characters of formatted, counted from 1,
    that a model learns from, one span for each text of the assistant, in order.
    Turns are in order of turn, then role, then text, null turns first; equal
    rows are turns of their own.  Null roles and texts count as empty; null
    conv_ids are one conversation.  Other columns are ignored; an empty table
    gives no rows.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    convs = rows.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("_turns"))
    head = lambda b: F.concat(F.lit(HEAD), escaped(b["role"], ROLE_ESCAPES), F.lit(COLON))
    last = lambda b, i: F.when(i == F.size(b["texts"]) - 1, END).otherwise("")
    part = lambda b: lambda t, i: F.struct(b["role"].alias("role"), F.when(i == 0, head(b)).otherwise(NEXT).alias("lead"), escaped(t).alias("body"), last(b, i).alias("end"))
    parts = F.flatten(F.transform(_merged(F.array_sort("_turns")), lambda b: F.transform(b["texts"], part(b))))

    def out(p: Column) -> Column:
        text = F.array_join(F.transform(p, lambda x: F.concat(x["lead"], x["body"], x["end"])), "")
        lengths = F.transform(p, lambda x: (F.length(x["lead"]) + F.length(x["body"]) + F.length(x["end"])).cast("long"))
        span = lambda x, s: F.when(x["role"] == LEARNED, F.struct((s + F.length(x["lead"]) + 1).cast("int").alias("start"), F.length(x["body"]).alias("length")))
        spans = let(lengths, lambda n: F.zip_with(p, _starts(n), span))
        return F.struct(text.alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))

    return convs.select("conv_id", let(parts, out).alias("o")).select("conv_id", "o.formatted", "o.loss_spans")


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted_chars, turns, loss_text) from the output of formatted alone.

    turns are (role, text) by the template; loss_text is the characters under
    the spans, one after the other, unescaped.
    """

    def turns(b: Column) -> Column:
        role = F.substring_index(F.substring(b, len(HEAD) + 1, 1 << 30), ":", 1)
        text = F.substr(b, F.length(role) + len(HEAD) + len(COLON) + 1)
        return F.transform(F.split(text, NEXT), lambda t: F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(t).alias("text")))

    blocks = let(F.split("formatted", END), lambda p: F.slice(p, 1, F.size(p) - 1))
    learned = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"], s["length"])))
    return chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.flatten(F.transform(blocks, turns)).alias("turns"), F.array_join(learned, "").alias("loss_text"))


def digests(read: DataFrame) -> DataFrame:
    """What a reader sees, as digests."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
