"""Typed overlay: gates, integrity checks, induction."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.rules import Rule, is_var

RELATION_SCHEMA = "name string, domain array<string>, range array<string>, symmetric boolean, transitive boolean, functional boolean, inverse_of string"


def accepts(domain, range_, source_type, target_type):
    """The type check of a relation; * takes any type."""
    fits = lambda allowed, t: F.array_contains(allowed, "*") | F.array_contains(allowed, t)
    return fits(domain, source_type) & fits(range_, target_type)


def allows(candidates: DataFrame, nodes: DataFrame, edges: DataFrame, relations: DataFrame) -> DataFrame:
    """candidates(src, rel, dst) with allowed.

    Refused are undeclared relations, missing ends, wrong types, and for a
    functional relation another tail than the one there is.
    """
    n = nodes.select("id", "type")
    rel = relations.withColumnRenamed("name", "rel").select("rel", "domain", "range", "functional")
    # only edges of functional relations, and no list of tails
    tails = edges.join(rel.filter("functional").select("rel"), "rel", "left_semi").groupBy("src", "rel").agg(F.min("dst").alias("_low"))
    here = edges.join(rel.filter("functional").select("rel"), "rel", "left_semi").select("src", "rel", "dst").distinct().withColumn("_here", F.lit(True))
    c = candidates.join(rel, "rel", "left")
    c = c.join(n.select(F.col("id").alias("src"), F.col("type").alias("_s")), "src", "left").join(n.select(F.col("id").alias("dst"), F.col("type").alias("_t")), "dst", "left")
    c = c.join(tails, ["src", "rel"], "left").join(here, ["src", "rel", "dst"], "left")
    free = ~F.col("functional") | F.col("_low").isNull() | F.col("_here")
    ok = F.col("domain").isNotNull() & F.col("_s").isNotNull() & F.col("_t").isNotNull() & accepts(F.col("domain"), F.col("range"), F.col("_s"), F.col("_t")) & free
    return c.select(*candidates.columns, F.coalesce(ok, F.lit(False)).alias("allowed"))


def validate(nodes: DataFrame, edges: DataFrame, relations: DataFrame, node_types: DataFrame | None = None) -> DataFrame:
    """(kind, detail) of all violations: missing_property, unknown_relation, domain_range, functional.

    nodes(id, type, props map); node_types(name, required_props).
    """
    rel = relations.withColumnRenamed("name", "rel")
    n = nodes.select("id", "type")
    seen = edges.join(rel, "rel", "left").join(n.select(F.col("id").alias("src"), F.col("type").alias("_s")), "src", "left").join(n.select(F.col("id").alias("dst"), F.col("type").alias("_t")), "dst", "left")
    wrong = F.col("_s").isNotNull() & F.col("_t").isNotNull() & ~accepts(F.col("domain"), F.col("range"), F.col("_s"), F.col("_t"))
    kind = F.when(F.col("domain").isNull(), "unknown_relation").when(wrong, "domain_range")
    bad = seen.select(kind.alias("kind"), F.concat_ws(" ", "src", "rel", "dst").alias("detail")).filter("kind IS NOT NULL")
    least = F.min("dst") != F.max("dst")  # two tails or more, without a list of them
    many = edges.join(rel.filter("functional"), "rel", "left_semi").groupBy("src", "rel").agg(least.alias("many")).filter("many").select(F.lit("functional"), F.concat_ws(" ", "src", "rel"))
    parts = [bad, many]
    if node_types is not None:
        need = node_types.select(F.col("name").alias("type"), F.explode("required_props").alias("p"))
        missing = nodes.join(need, "type").filter(~F.coalesce(F.array_contains(F.map_keys("props"), F.col("p")), F.lit(False)))
        parts.append(missing.select(F.lit("missing_property"), F.concat_ws(" ", "id", "p")))
    return reduce(DataFrame.union, parts)


def induce(nodes: DataFrame, edges: DataFrame, symmetric_percent: int = 60) -> DataFrame:
    """(name, domain, range, functional, symmetric) from what edges do.

    Functional: no source has two tails; symmetric: at least the given share of
    edges has its mirror, a loop being its own.  A symmetric relation is never
    functional.
    """
    n = nodes.select("id", "type")
    # dealt by source once: distinct edges and fans need no other shuffle
    e = edges.select("src", "rel", "dst").repartition("rel", "src").distinct()
    typed = e.join(n.select(F.col("id").alias("src"), F.col("type").alias("s")), "src").join(n.select(F.col("id").alias("dst"), F.col("type").alias("t")), "dst")
    ends = typed.groupBy("rel").agg(F.array_sort(F.collect_set("s")).alias("domain"), F.array_sort(F.collect_set("t")).alias("range"))
    fan = e.groupBy("rel", "src").agg(F.count("*").alias("n")).groupBy("rel").agg(F.max("n").alias("fan"))
    # the directions of each pair of ends, as bits: both set, or a loop, is a mirror
    way = F.when(F.col("src") == F.col("dst"), 4).when(F.col("src") < F.col("dst"), 1).otherwise(2)
    pairs = edges.groupBy("rel", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.bit_or(way).alias("ways"))
    mirror = pairs.groupBy("rel").agg(F.sum(F.when(F.col("ways") == 3, 2).when(F.col("ways") == 4, 1).otherwise(0)).alias("mirrored"), F.sum(F.when(F.col("ways") == 3, 2).otherwise(1)).alias("total"))
    out = ends.join(fan, "rel").join(mirror, "rel").withColumn("symmetric", 100 * F.col("mirrored") >= symmetric_percent * F.col("total"))
    return out.select(F.col("rel").alias("name"), "domain", "range", ((F.col("fan") <= 1) & ~F.col("symmetric")).alias("functional"), "symmetric")


def rule_consistent(rule: Rule, relations: dict[str, tuple[set[str], set[str]]]) -> bool:
    """Whether some typing of the variables fits all patterns and every head variable is inside the head's types.

    relations maps a name to its domain and range; without any, all is allowed.
    A head variable that the body leaves open must not be closed by the head.
    """
    if not relations:
        return True
    allowed: dict[str, set[str] | None] = {}

    def narrow(x: str, types: set[str]) -> bool:
        if is_var(x) and "*" not in types:
            now = allowed.get(x)
            allowed[x] = set(types) if now is None else now & types
            return bool(allowed[x])
        return True

    for s, r, o in rule.body:
        if r not in relations or not narrow(s, relations[r][0]) or not narrow(o, relations[r][1]):
            return False
    s, r, o = rule.head
    if r not in relations:
        return False
    for x, types in zip((s, o), relations[r]):
        if is_var(x) and "*" not in types and (allowed.get(x) is None or not allowed[x] <= types):
            return False
    return True


def type_new_ends(edges: DataFrame, nodes: DataFrame, relations: DataFrame, default: str = "Entity") -> DataFrame:
    """(id, type) of ends that aren't nodes yet: the smallest type that every use admits; known nodes keep theirs."""
    rel = relations.select(F.col("name").alias("rel"), "domain", "range")
    e = edges.join(rel, "rel", "left")
    uses = e.select(F.col("src").alias("id"), F.col("domain").alias("types")).union(e.select("dst", "range"))
    closed = uses.filter(F.col("types").isNotNull() & ~F.array_contains("types", "*"))
    n_uses = closed.groupBy("id").agg(F.count("*").alias("uses"))
    both = closed.select("id", F.explode(F.array_distinct("types")).alias("type")).groupBy("id", "type").count()
    best = both.join(n_uses, "id").filter("count = uses").groupBy("id").agg(F.min("type").alias("type"))
    new = uses.select("id").distinct().join(nodes, "id", "left_anti")
    return new.join(best, "id", "left").select("id", F.coalesce("type", F.lit(default)).alias("type"))


@dataclass(frozen=True)
class RelationType:
    """What a relation may connect; * takes any type."""

    name: str
    domain: tuple[str, ...] = ("*",)
    range: tuple[str, ...] = ("*",)
    symmetric: bool = False
    transitive: bool = False
    functional: bool = False
    inverse_of: str | None = None


@dataclass(frozen=True)
class Ontology:
    """Node types with their required properties, and relation types; adding gives a new ontology, a later entry of a name replaces the earlier one."""

    node_types: dict[str, tuple[str, ...]] = field(default_factory=dict)
    relation_types: dict[str, RelationType] = field(default_factory=dict)

    def with_node_type(self, name: str, required: tuple[str, ...] = ()) -> Ontology:
        return replace(self, node_types={**self.node_types, name: required})

    def with_relation_type(self, r: RelationType) -> Ontology:
        return replace(self, relation_types={**self.relation_types, r.name: r})

    def relation(self, name: str) -> RelationType | None:
        return self.relation_types.get(name)

    def tables(self, spark) -> tuple[DataFrame, DataFrame]:
        """(node_types(name, required_props), relations) as the gates take them."""
        rows = [(r.name, list(r.domain), list(r.range), r.symmetric, r.transitive, r.functional, r.inverse_of) for r in self.relation_types.values()]
        return spark.createDataFrame([(n, list(p)) for n, p in self.node_types.items()], "name string, required_props array<string>"), spark.createDataFrame(rows, RELATION_SCHEMA)

    def ends(self) -> dict[str, tuple[set[str], set[str]]]:
        """{relation: (domain, range)} for rule_consistent."""
        return {r.name: (set(r.domain), set(r.range)) for r in self.relation_types.values()}


def revised(relations: DataFrame, proposals: DataFrame) -> DataFrame:
    """relations with the proposals(name, r1, r2, ...) that have a new name: a path of two goes from the domain of the first to the range of the second.

    Nothing that is there is changed; a proposal over an undeclared relation is
    left out.
    """
    r = relations.select(F.col("name").alias("r1"), "domain")
    q = relations.select(F.col("name").alias("r2"), "range")
    new = proposals.select("name", "r1", "r2").dropDuplicates(["name"]).join(relations.select("name"), "name", "left_anti").join(r, "r1").join(q, "r2")
    no = F.lit(False)
    return relations.unionByName(new.select("name", "domain", "range", no.alias("symmetric"), no.alias("transitive"), no.alias("functional"), F.lit(None).cast("string").alias("inverse_of")))


def revised_node_types(node_types: DataFrame, induced: DataFrame) -> DataFrame:
    """node_types(name) with induced(name) that are new."""
    return node_types.select("name").union(induced.select("name").distinct().join(node_types, "name", "left_anti"))
