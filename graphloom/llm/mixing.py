"""Mixing sources to target weights, in Spark expressions only.

Targets come from water filling over the sources.  Complete epochs of a source
come first; what is left of its target goes to documents in the order of
Efraimidis-Spirakis keys, exponential draws divided by the document's quality
weight, up to the word budget.  A hot source is never sorted in one task: its
keys are cut at quantiles, whole ranges are settled by their sums, and the range
that the budget ends in is cut again until it has bucket_rows documents at most;
only that is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import columns_of, n_words_of, staged, text_of

#: Characters that lower a document's quality weight.
JUNK = r"[0-9#*$%&|<>=+_{}~^@/\\]"
SEED = "mix-1"


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def quality_weight(text: Column) -> Column:
    """chars / (chars + 10 junk characters), 1 for an empty text."""
    chars, junk = F.length(text).cast("double"), F.regexp_count(text, F.lit(JUNK)).cast("double")
    return F.when(chars == 0, F.lit(1.0)).otherwise(chars / (chars + 10 * junk))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, counted from 0 by the code points of source, null last; sorted by range, never in one task."""
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_p").count()  # a row a partition
    before = counts.withColumn("_before", F.sum("count").over(Window.orderBy("_p")) - F.col("count")).drop("count")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("_i", place).join(before, "_p").withColumn("rank", F.col("_before") + F.col("_i") - 1).drop("_p", "_i", "_before")


def targets(sources: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: int = 2) -> DataFrame:
    """sources(source, source_size, ...) with target = least(most * source_size, level * weight).

    The level at which the targets add up is bracketed between quantiles of
    cap / weight, CUTS at a time, so that the rounds grow with the logarithm of
    the number of sources.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    s = staged(ranked(sources).withColumn("_w", w).withColumn("_cap", F.col("source_size") * most).withColumn("_r", F.col("_cap") / F.col("_w")), "targets")
    goal = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    low, high = -1.0, float("inf")
    while cuts := s.filter((F.col("_r") > low) & (F.col("_r") < high)).agg(_quantiles("_r")).first()[0]:
        cuts = sorted(set(cuts))
        filled = s.agg(*[F.sum(F.least(F.col("_cap").cast("double"), F.lit(c) * F.col("_w"))) for c in cuts]).first()
        low = max([low, *[c for c, x in zip(cuts, filled) if x <= goal]])
        high = min([high, *[c for c, x in zip(cuts, filled) if x > goal]])
    over = F.col("_r") <= low
    capped, rest = s.agg(F.sum(F.when(over, F.col("_cap")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("_w")))).first()
    level = (goal - capped) / rest if rest else max(low, 0.0)
    target = F.when(over, F.col("_cap").cast("double")).otherwise(F.lit(level) * F.col("_w"))
    return s.withColumn("target", target).drop("_w", "_cap", "_r", "rank")


#: Ranges that keys are cut into at once.
CUTS = 64


def _quantiles(key: str) -> Column:
    return F.percentile_approx(key, [i / CUTS for i in range(1, CUTS)], 10 * CUTS)


def _rows(docs: DataFrame, seed: str, also: list[Column] = []) -> DataFrame:
    """(doc_id, source, size, _key) and what else is asked for."""
    draw = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)
    return docs.select(F.col("doc_id"), F.col("source"), n_words_of(text_of()).alias("size"), (-F.log(draw) / quality_weight(text_of())).alias("_key"), *also)


def _ends(rows: DataFrame, plan: DataFrame, bucket_rows: int) -> DataFrame:
    """plan(_source, _left, ...) with _end, where the budget of a source ends in the order of (_key, doc_id, size).

    _end has the place, how many rows are there and how many of them the budget
    takes whole, and the words that it takes of one more.  Rows before it are
    taken, rows after it aren't.  Null where nothing is left over.
    """
    here = F.col("source").eqNullSafe(F.col("_source"))
    # rows up to _lo fit; the budget ends over _lo and up to _hi, with _room words over those before
    now = plan.filter("_left > 0").select("_source", F.lit(float("-inf")).alias("_lo"), F.lit(float("inf")).alias("_hi"), F.col("_left").alias("_room"), F.col("_docs").alias("_n"))
    while True:
        now = staged(now, "bounds")
        inside = rows.join(now, here).filter((F.col("_key") > F.col("_lo")) & (F.col("_key") <= F.col("_hi")))
        wide = inside.filter(F.col("_n") > bucket_rows)
        if now.filter(F.col("_n") > bucket_rows).isEmpty():
            break
        cuts = staged(wide.groupBy(F.col("_source").alias("_s")).agg(F.sort_array(F.array_distinct(_quantiles("_key"))).alias("_cuts")), "cuts")
        at = F.size(F.filter("_cuts", lambda c: c < F.col("_key")))
        sums = wide.join(cuts, F.col("_source").eqNullSafe(F.col("_s"))).groupBy("_source", "_lo", "_hi", "_room", F.col("_n").alias("_was"), "_cuts", at.alias("_b")).agg(F.sum("size").alias("_sum"), F.count("*").alias("_n"))
        upto = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_b"))
        end = sums.withColumn("_to", upto).filter((F.col("_to") >= F.col("_room")) & (F.col("_to") - F.col("_sum") < F.col("_room")))
        low = F.when(F.col("_b") == 0, F.col("_lo")).otherwise(F.get("_cuts", F.col("_b") - 1))
        high = F.coalesce(F.get("_cuts", "_b"), F.col("_hi"))
        # equal keys can't be cut: they count as narrow
        narrow = F.when((F.col("_n") == F.col("_was")) & (F.size("_cuts") == 1), F.lit(0)).otherwise(F.col("_n"))
        end = end.select("_source", low.alias("_lo"), high.alias("_hi"), (F.col("_room") - F.col("_to") + F.col("_sum")).alias("_room"), narrow.cast("long").alias("_n"))
        now = end.union(now.filter(F.col("_n") <= bucket_rows))
    groups = inside.groupBy("_source", "_key", "doc_id", "size", "_room").agg(F.count("*").alias("_c"))
    order = Window.partitionBy("_source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("_c") * F.col("size")
    left = F.col("_room") - F.coalesce(F.sum(words).over(order), F.lit(0))
    end = groups.withColumn("_over", left).filter((F.col("_over") > 0) & (words >= F.col("_over")))
    whole = F.floor(F.col("_over") / F.col("size")).cast("long")
    place = F.struct("_key", "doc_id", "size").alias("place")
    end = end.select(F.col("_source").alias("_s"), F.struct(place, F.col("_c").alias("rows"), whole.alias("whole"), (F.col("_over") - whole * F.col("size")).alias("part")).alias("_end"))
    return staged(plan.join(end, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s"), "ends")


def _plan(rows: DataFrame, share: float, weights: tuple[int, ...], most: int, bucket_rows: int) -> DataFrame:
    """(_source, source_size, target, epochs, _left, _end), a row a source."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    plan = targets(sources, share, weights, most)
    size = F.col("source_size")
    epochs = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("_left", F.floor("target").cast("long") - epochs * size)
    return _ends(rows, staged(plan.withColumnRenamed("source", "_source"), "plan"), bucket_rows)


def _parts(rows: DataFrame, plan: DataFrame, tie: Column | None = None) -> DataFrame:
    """rows with the columns of plan and part, the words taken after whole epochs.

    Only where equal rows stand at the end of a budget, and it takes some of
    them, are these numbered, in order of tie.
    """
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    own, end = F.struct("_key", "doc_id", "size"), F.col("_end.place")
    at = own.eqNullSafe(end)
    size, part = F.col("size"), F.col("_end.part")
    sole = F.when(F.col("_end").isNull(), 0).when(at, F.when(F.col("_end.whole") == F.col("_end.rows"), size).otherwise(part)).when(own < end, size).otherwise(0)
    tied = F.coalesce(at & (F.col("_end.rows") > 1) & (F.col("_end.whole") < F.col("_end.rows")), F.lit(False))
    if plan.filter("_end.rows > 1 AND _end.whole < _end.rows").isEmpty():
        return placed.withColumn("part", sole.cast("long"))
    nth = F.row_number().over(Window.partitionBy("_source").orderBy(F.lit(0) if tie is None else tie))
    each = F.when(nth <= F.col("_end.whole"), size).when(nth == F.col("_end.whole") + 1, part).otherwise(0)
    return placed.filter(~tied).withColumn("part", sole.cast("long")).unionByName(placed.filter(tied).withColumn("part", each.cast("long")))


def mixed(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: int = 2, bucket_rows: int = 4096, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, epochs, part), one row per row of docs.

    taken = epochs * size + part; the words of a source add up to its target,
    rounded down.  The document in which a budget ends gives a part of its
    words.  Null text: size 0.  Null source: a source of its own, last in order.
    Rows that repeat a doc_id share a draw and are taken one after the other;
    equal rows are interchangeable.  Other columns are ignored; an empty table
    gives no rows.  Reruns agree: draws come from a hash of doc_id.
    """
    rows = staged(_rows(docs, seed), "sizes")
    out = _parts(rows, _plan(rows, share, weights, most, bucket_rows))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "epochs", "part")


def mixed_documents(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: int = 2, bucket_rows: int = 4096, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it, with the columns of docs, whatever their names.

    The document in which a budget ends is taken whole.  Documents without
    words stay once.  Rows that repeat a doc_id, nulls and empty tables are as
    in mixed.  Texts are never shuffled: only the place where the budget of a
    source ends is joined to them.
    """
    plan = _plan(staged(_rows(docs, seed), "sizes"), share, weights, most, bucket_rows)
    own = [f"_in{i}" for i in range(len(docs.columns))]
    rows = _rows(docs, seed, [c.alias(o) for c, o in zip(columns_of(docs), own)])
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("epochs") + (F.col("part") > 0).cast("long")).cast("int")
    # rows of one doc_id and size can have different texts: reruns keep the same ones
    text = F.xxhash64(F.col(own[[c.lower() for c in docs.columns].index("text")]).cast("string"))
    kept = _parts(rows, plan, text).withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return kept.select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns)])
