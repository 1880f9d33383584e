"""Line dedup by distinct-site spread, in Spark expressions only.

Every line gets a HyperLogLog sketch of the sites it stands on, merged by
aggregation.  Lines well over the limit are boilerplate, lines well under it are
not, and lines near it are counted exactly.  Boilerplate goes from every
document.  A text that stands on several sites as a whole counts once, for the
first of them, so that copies of a document, which are for document dedup to
settle, don't make boilerplate of all it says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, columns_of, staged, text_of

MIN_SITES = 10
LG_K = 10


def _key(line: Column) -> Column:
    """128 bits of hash."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, t, keys): the key of a text, and those of its lines with a word, each with the place of its line."""
    lines = F.filter(F.transform(F.split(text_of(), "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("at"))), lambda x: x["line"].rlike(WORD))
    keys = F.transform(lines, lambda x: F.struct(F.xxhash64(x["line"]).alias("h1"), F.xxhash64(F.lit(7), x["line"]).alias("h2"), x["at"].alias("at")))
    return staged(docs.filter(F.col("text").isNotNull()).select("doc_id", "source", _key(text_of()).alias("t"), keys.alias("keys")), "lines")


def _found(keyed: DataFrame, min_sites: int, lg_k: int) -> DataFrame:
    texts = keyed.filter(F.col("source").isNotNull()).groupBy("t").agg(F.min("source").alias("site"), F.first("keys").alias("keys"))
    lines = texts.select("site", F.explode("keys").alias("k")).select("site", "k.h1", "k.h2")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    # 1.04 / sqrt(2^lg_k) is the relative error of such a sketch; five of them and two sites on either side are exact
    band = 2 + min_sites * 5 * 1.04 / (1 << lg_k) ** 0.5
    seen = staged(spread.filter(F.col("sites") >= min_sites - band), "spread")
    near = seen.filter(F.col("sites") <= min_sites + band).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").count().filter(F.col("count") >= min_sites).select("h1", "h2")
    return staged(seen.filter(F.col("sites") > min_sites + band).select("h1", "h2").union(exact), "boilerplate")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2) of the lines on min_sites distinct sites or more; a null source is no site."""
    return _found(_keyed(docs), min_sites, lg_k)


def deduped(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, keep: list[str] | None = None) -> DataFrame:
    """keep (doc_id where it isn't given) with text, n_lines and n_removed, one row per row of docs.

    Lines are the parts between line feeds; those with a word can be
    boilerplate.  A document of nothing else gets an empty text.  A null text
    stays null, with no lines; a null source is no site, but its documents lose
    boilerplate too.  Repeated rows are treated alike.  Other columns are
    ignored; an empty table gives no rows.
    """
    keep = keep or ["doc_id"]
    keyed = _keyed(docs)
    found = _found(keyed, min_sites, lg_k)
    # places of boilerplate, for each doc_id and text: rows of one doc_id, or of none, may differ in their texts
    uses = keyed.select("doc_id", "t", F.explode("keys").alias("k")).select("doc_id", "t", "k.h1", "k.h2", "k.at")
    hit = uses.join(found, ["h1", "h2"]).groupBy(F.col("doc_id").alias("_id"), F.col("t.h1").alias("_t1"), F.col("t.h2").alias("_t2")).agg(F.collect_set("at").alias("_hit"))
    own = [c for c in keep if c != "text"]
    d = docs.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(own)], F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("_t"))
    key = _key(F.col("_t"))
    d = d.join(hit, F.col("_doc").eqNullSafe(F.col("_id")) & (key["h1"] == F.col("_t1")) & (key["h2"] == F.col("_t2")), "left").withColumn("_l", F.split("_t", "\n"))
    # array_except hashes the places, so that a text of very many lines takes time in proportion to them
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), "_hit"), lambda i: F.get("_l", i))
    d = d.withColumn("_stay", F.when(F.col("_hit").isNull(), F.col("_l")).otherwise(stay))
    text = F.when(F.size("_l") == F.size("_stay"), F.col("_t")).otherwise(F.array_join("_stay", "\n"))
    count = lambda c: F.when(F.col("_t").isNull(), 0).otherwise(c).cast("long")
    return d.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(own)], text.alias("text"), count(F.size("_l")).alias("n_lines"), count(F.size("_l") - F.size("_stay")).alias("n_removed"))


def deduped_documents(docs: DataFrame, **options) -> DataFrame:
    """All rows of docs without boilerplate lines, with the columns of docs, whatever their names; n_chars, where there is one, follows the text.

    An empty table gives no rows; null doc_ids and texts stay.
    """
    names = {c: c if c in ("doc_id", "source", "text") else f"_own{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[c.alias(n) for c, n in zip(columns_of(docs), names.values())])
    out = deduped(plain, keep=list(names.values()), **options)
    length = lambda c: F.length("text").cast(docs.schema[c].dataType)
    return out.select(*[(length(c) if c == "n_chars" else F.col(n)).alias(c) for c, n in names.items()])
