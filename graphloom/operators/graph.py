"""Nodes and edges as DataFrames: upserts, lookups and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_TYPE = "Entity"


def from_triples(triples: DataFrame, types: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, type), edges) of triples(src, rel, dst); types(id, type) names the types that aren't the default."""
    edges = triples.select("src", "rel", "dst").distinct()
    ids = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    if types is None:
        return ids.withColumn("type", F.lit(DEFAULT_TYPE)), edges
    return ids.join(types, "id", "left").select("id", F.coalesce("type", F.lit(DEFAULT_TYPE)).alias("type")), edges


def upsert_nodes(log: DataFrame) -> DataFrame:
    """(id, type, props) from a log(seq, id, type, props map): the last type that isn't the default wins, and the last value of each property."""
    named = F.max_by("type", F.when(F.col("type") != DEFAULT_TYPE, F.col("seq")))
    types = log.groupBy("id").agg(F.coalesce(named, F.lit(DEFAULT_TYPE)).alias("type"))
    return types.join(_merged(log, ["id"]), "id", "left")


def upsert_edges(log: DataFrame) -> DataFrame:
    """(src, rel, dst, props) from a log(seq, src, rel, dst, props map): one edge a triple, the last value of each property."""
    return log.select("src", "rel", "dst").distinct().join(_merged(log, ["src", "rel", "dst"]), ["src", "rel", "dst"], "left")


def _merged(log: DataFrame, key: list[str]) -> DataFrame:
    each = log.select(*key, "seq", F.explode("props").alias("k", "v")).groupBy(*key, "k").agg(F.max_by("v", "seq").alias("v"))
    return each.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))


def endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes and the ends of edges that aren't among them, with the default type."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.select("id", "type").unionByName(ids.join(nodes, "id", "left_anti").withColumn("type", F.lit(DEFAULT_TYPE)))


def outgoing(edges: DataFrame, ids: DataFrame, rel: str | None = None) -> DataFrame:
    """Distinct (id, neighbour) along edges, of one relation or all."""
    e = edges if rel is None else edges.filter(F.col("rel") == rel)
    return e.select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).join(ids.select("id").distinct(), "id", "left_semi").distinct()


def incoming(edges: DataFrame, ids: DataFrame, rel: str | None = None) -> DataFrame:
    return outgoing(edges.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst")), ids, rel)


def in_relations(edges: DataFrame) -> DataFrame:
    """(id, relations): as out_relations, against the edges."""
    return out_relations(edges.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst")))


def entities(nodes: DataFrame) -> DataFrame:
    """Distinct (id)."""
    return nodes.select("id").distinct()


def relations(edges: DataFrame) -> DataFrame:
    """Distinct (rel)."""
    return edges.select("rel").distinct()


def types(nodes: DataFrame) -> DataFrame:
    """(type, n): the types and how many nodes have each."""
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def nodes_of_type(nodes: DataFrame, type_: str) -> DataFrame:
    """(id) of one type."""
    return nodes.filter(F.col("type") == type_).select("id")


def has_nodes(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """asked(id) with found and the node's type, null where there is none; null ids are never found."""
    return asked.join(nodes.select("id", "type").dropDuplicates(["id"]), "id", "left").withColumn("found", F.col("type").isNotNull())


def has_edges(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """asked(src, rel, dst) with found."""
    here = edges.select("src", "rel", "dst").distinct().withColumn("_here", F.lit(True))
    return asked.join(here, ["src", "rel", "dst"], "left").withColumn("found", F.coalesce("_here", F.lit(False))).drop("_here")


def out_relations(edges: DataFrame) -> DataFrame:
    """(id, relations): a map from relation to the sorted set of neighbours."""
    each = edges.groupBy(F.col("src").alias("id"), "rel").agg(F.array_sort(F.collect_set("dst")).alias("n"))
    return each.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel", "n")))).alias("relations"))


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): distinct neighbours out plus distinct neighbours in."""
    sides = edges.select(F.col("src").alias("id"), F.lit("o").alias("side"), F.col("dst").alias("n")).union(edges.select("dst", F.lit("i"), "src"))
    # one shuffle by id: what is distinct of an id is counted where it lies
    return sides.repartition("id").distinct().groupBy("id").agg(F.count("*").alias("degree"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, types, relations."""
    n = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("type").alias("types"))
    e = edges.agg(F.count("*").alias("edges"), F.countDistinct("rel").alias("relations"))
    return n.crossJoin(e).select("nodes", "edges", "types", "relations")  # a row each


def without_asked(edges: DataFrame, workload: DataFrame) -> DataFrame:
    """Edges whose (src, rel) nobody asks for."""
    asked = workload.select(F.col("head").alias("src"), F.col("relation").alias("rel")).distinct()
    return edges.join(asked, ["src", "rel"], "left_anti")


def candidates(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """(relation, id): nodes whose type is in the range of ranges(name, range); all nodes for * and for no range."""
    anyone = F.col("range").isNull() | F.array_contains("range", "*")
    wide = ranges.filter(anyone).select(F.col("name").alias("relation"))
    narrow = ranges.filter(~anyone).select(F.col("name").alias("relation"), F.explode("range").alias("type")).distinct()
    return narrow.join(nodes, "type").select("relation", "id").union(wide.crossJoin(nodes.select("id")))


def split(triples: DataFrame, ratios: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = 0) -> DataFrame:
    """triples with split train, valid or test, cut in the order of a hash; each ratio's share is rounded down."""
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios have to sum to 1")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "src", "rel", "dst"))
    # cut by the hash itself, so that no global sort is needed
    u = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return triples.withColumn("split", F.when(u < ratios[0], "train").when(u < ratios[0] + ratios[1], "valid").otherwise("test"))


def last_assertion(log: DataFrame) -> DataFrame:
    """One row a triple: the last by seq."""
    w = Window.partitionBy("src", "rel", "dst").orderBy(F.desc("seq"))
    return log.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")


def with_truth(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """Distinct edges and those that truth(head, relation, tails) says: what rules are scored on."""
    true = truth.select(F.col("head").alias("src"), F.col("relation").alias("rel"), F.explode("tails").alias("dst"))
    return edges.select("src", "rel", "dst").union(true).distinct()
