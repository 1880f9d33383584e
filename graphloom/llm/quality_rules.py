"""Quality rules with host verdicts, in Spark expressions only.

Each document is measured on its whole text.  Rule failures are summed by
host, and the failure rate of a host is drawn towards the mean of all hosts by a
beta prior fitted to the hosts themselves.  The shrunken rate gives a verdict:
a host over the limit is rejected with all its documents; a host well under what
the prior expects is trusted, and only the base rules count for its documents;
for all others every rule does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, let, staged, text_of, words_of

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; the first two are the base rules."""

    min_words: int = 20
    repeat_percent: int = 30
    symbol_percent: int = 100  # symbols per 100 words
    dup_line_percent: int = 30  # of the lines with a word
    min_mean_chars: int = 2
    max_mean_chars: int = 15
    host_rate: float = 0.5  # hosts over it are rejected
    trusted_below: float = 0.67  # standard deviations of the prior under its mean: about its lower quarter
    least_prior: float = 4.0  # prior documents: bounds of the fitted strength
    most_prior: float = 1000.0


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in a window whose hash is there twice or more.

    Sorted by hash, a repeated window has an equal neighbour.  The windows that
    remain, in text order, each add the words that the one before left out.
    """

    def covered(s: Column) -> Column:
        same = lambda i, x: F.when((i >= 1) & (i <= F.size(s)), F.element_at(s, i)["h"] == x["h"]).otherwise(False)
        twice = F.filter(s, lambda x, i: same(i, x) | same(i + 2, x))
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, covered))


def measure(text: Column, rules: Rules) -> Column:
    """Struct of the measures of a non-null text and of what failed.

    One expression with every array bound by let: the optimizer may move it
    into a filter, but no part of it comes to be computed for each element.
    """
    no_words = F.array().cast("array<bigint>")

    def windows(hw: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(hw) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(hw, i + k) for k in range(WINDOW)]))
        return F.when(F.size(hw) >= WINDOW, each).otherwise(no_words)

    def judged(m: Column) -> Column:
        words, chars, symbols, lines, twice, repeats = (m[c] for c in MEASURES)
        base = (words < rules.min_words) | (100 * repeats > rules.repeat_percent * words)
        other = (
            (100 * symbols > rules.symbol_percent * words)
            | (100 * twice > rules.dup_line_percent * lines)
            | (chars < rules.min_mean_chars * words)
            | (chars > rules.max_mean_chars * words)
        )
        return F.struct(*[m[c].alias(c) for c in MEASURES], base.alias("base_failed"), (base | other).alias("rule_failed"))

    def counted(w: Column, lines: Column) -> Column:
        repeats = let(let(F.transform(w, lambda x: F.xxhash64(x)), windows), _repeat_words)
        counts = (
            F.size(w),
            F.length(F.array_join(w, "")),
            F.regexp_count(text, F.lit(SYMBOLS)),
            F.size(lines),
            F.size(lines) - F.size(F.array_distinct(lines)),
            repeats,
        )
        return F.struct(*[c.cast("long").alias(n) for n, c in zip(MEASURES, counts)])

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(let(words_of(text), lambda w: let(lines, lambda x: counted(w, x))), judged)


def host_verdicts(failed: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(source, host_docs, host_failed, host_rate, host_rejected, host_trusted), one row per host; a null source is a host of its own.

    The prior is the beta distribution of host rates by the moments of a
    beta-binomial.  Its mean m is that of all documents.  The spread between
    hosts, S = sum n (f/n - m)^2, holds (K - 1) m(1-m) of chance for K hosts;
    what is left over, against its largest value, is the correlation r within
    hosts, and 1/r - 1 is the strength.  Hosts that differ no more than by
    chance get the greatest strength.
    """
    hosts = staged(
        failed.groupBy("source").agg(F.count("*").alias("host_docs"), F.sum(F.col("rule_failed").cast("long")).alias("host_failed")),
        "hosts",
    )
    n, f = F.col("host_docs"), F.col("host_failed")
    docs, bad, squares, own, k = hosts.agg(F.sum(n), F.sum(f), F.sum(n.cast("double") * n), F.sum(f.cast("double") * f / n), F.count("*")).first()
    m, strength = (bad / docs if docs else 0.0), rules.most_prior
    chance = m * (1 - m)
    free = docs - squares / docs - (k - 1) if docs else 0.0
    if chance > 0 and free > 0:
        r = (own - docs * m * m - (k - 1) * chance) / (chance * free)
        strength = min(rules.most_prior, max(rules.least_prior, 1 / r - 1)) if r > 0 else rules.most_prior
    rate = (f + F.lit(m * strength)) / (n + F.lit(strength))
    trusted = m - rules.trusted_below * (chance / (strength + 1)) ** 0.5
    return staged(hosts.withColumn("host_rate", rate).withColumn("host_rejected", rate > rules.host_rate).withColumn("host_trusted", rate < trusted), "verdicts")


def _verdict() -> Column:
    return ~F.col("base_failed") & ~F.col("host_rejected") & (~F.col("rule_failed") | F.col("host_trusted"))


def judged(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document with its measures, base_failed, rule_failed, the rate and verdict of its host, and kept.

    Only doc_id, text and source are read; other columns, whatever their names,
    are ignored.  Nulls: a null text has no words and fails; documents without a
    source form one host.  Repeated rows are judged alike, each on its own row.
    An empty table gives no rows.
    """
    failed = staged(docs.select("doc_id", "source", measure(text_of(), rules).alias("m")).select("doc_id", "source", "m.*"), "measures")
    hosts = host_verdicts(failed, rules).withColumnRenamed("source", "_host")
    out = failed.join(hosts, F.col("source").eqNullSafe(F.col("_host")), "left")
    return out.withColumn("kept", _verdict()).drop("_host")


def kept_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that judged keeps, with the columns of docs, whatever their names; an empty table gives no rows.

    Each text is measured once: rows are written with what failed, those that
    fail the base rules without their other columns.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)], F.col("source").alias("source"), measure(text_of(), rules).alias("m"))
    base = F.col("m.base_failed")
    rows = rows.select("source", base.alias("base_failed"), F.col("m.rule_failed").alias("rule_failed"), *[F.when(~base, F.col(o)).alias(o) for o in own])
    rows = staged(rows, "judged")
    hosts = host_verdicts(rows, rules).select(F.col("source").alias("_host"), "host_rejected", "host_trusted")
    kept = rows.filter("NOT base_failed").join(hosts, F.col("source").eqNullSafe(F.col("_host"))).filter(_verdict())
    return kept.select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own)])
