"""Formal concepts and induced node types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.stage import staged


def context(edges: DataFrame, min_support: int = 1, max_attributes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(attributes(attr, rel, dst, n), incidence(obj, attr)): attributes are (rel, dst) with min_support objects, numbered by count and name."""
    e = edges.select("src", "rel", "dst").distinct()
    counts = e.groupBy("rel", "dst").agg(F.count("*").alias("n")).filter(F.col("n") >= min_support)
    if max_attributes is not None:
        counts = counts.orderBy(F.desc("n"), "rel", "dst").limit(max_attributes)
    # numbered by count first: attributes of one count are numbered among themselves, after all with a higher one
    counts = staged(counts)
    sizes = counts.groupBy("n").agg(F.count("*").alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("n").orderBy("rel", "dst")) - 1
    attrs = counts.withColumn("_own", own).join(sizes, "n").select((F.col("_before") + F.col("_own")).cast("int").alias("attr"), "rel", "dst", "n")
    return attrs, e.join(attrs, ["rel", "dst"]).select(F.col("src").alias("obj"), "attr")


def objects_of(incidence: DataFrame, intent: list[int]) -> DataFrame:
    """Objects that have all of intent; all objects for an empty one."""
    if not intent:
        return incidence.select("obj").distinct()
    return incidence.filter(F.col("attr").isin(intent)).groupBy("obj").agg(F.countDistinct("attr").alias("n")).filter(F.col("n") == len(set(intent))).select("obj")


def attributes_of(incidence: DataFrame, attrs: DataFrame, extent: DataFrame) -> DataFrame:
    """Attributes that all objects of extent have; all attributes for an empty one."""
    n = extent.select("obj").distinct().agg(F.count("*").alias("total"))
    have = incidence.join(extent.select("obj").distinct(), "obj", "left_semi").groupBy("attr").agg(F.countDistinct("obj").alias("k"))
    return attrs.select("attr").join(have, "attr", "left").crossJoin(n).filter(F.coalesce("k", F.lit(0)) == F.col("total")).select("attr")


#: Attributes in one word of a bitset.
WORD = 62


class Bits:
    """Sets of n attributes as columns of words, under a prefix."""

    def __init__(self, n: int) -> None:
        self.n, self.words = n, max(1, -(-n // WORD))

    def names(self, prefix: str) -> list[str]:
        return [f"{prefix}{k}" for k in range(self.words)]

    def listed(self, word_of, least: Column | int = 0) -> Column:
        """The attributes from least on that the words word_of(k) hold, ascending."""

        def part(k: int) -> Column:
            return F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(word_of(k), i) == 1), lambda i: i + WORD * k)

        return F.filter(F.concat(*map(part, range(self.words))), lambda j: j >= least)

    def below(self, k: int, attr: Column) -> Column:
        """A mask over word k: the attributes under attr."""
        return F.when(attr >= WORD * (k + 1), F.lit((1 << WORD) - 1)).when(attr <= WORD * k, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (attr - WORD * k).cast("int")) - 1)

    def size(self, prefix: str) -> Column:
        return reduce(Column.__add__, [F.bit_count(c) for c in self.names(prefix)])


def _intents(incidence: DataFrame, bits: Bits) -> DataFrame:
    """(obj, o0, o1, ...): the attributes of each object as words."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("attr") % WORD).cast("int"))
    return incidence.groupBy("obj").agg(*[F.bit_or(F.when(F.floor(F.col("attr") / WORD) == k, one).otherwise(F.lit(0).cast("long"))).alias(c) for k, c in enumerate(bits.names("o"))])


def _steps(members: DataFrame, bits: Bits) -> tuple[DataFrame, DataFrame]:
    """Each concept b of members(b..., o..., y) with one more attribute from y on that some member has: (b..., y, attr, o...) as rows, and (b..., attr, d..., n) with their closure d."""
    b, o, d = bits.names("b"), bits.names("o"), bits.names("d")
    more = bits.listed(lambda k: F.col(o[k]).bitwiseAND(F.bitwise_not(F.col(b[k]))), F.col("y"))
    rows = members.select(*b, *o, F.explode(more).alias("attr"))
    return rows, rows.groupBy(*b, "attr").agg(*[F.bit_and(x).alias(y) for x, y in zip(o, d)])


def closed_sets(incidence: DataFrame, attrs: DataFrame) -> tuple[DataFrame, Bits]:
    """(b..., o...): every concept that has objects, by its intent, with each distinct object intent it contains; close-by-one.

    A level extends each concept by one attribute after the last one that made
    it.  The closure is the meet of the members' intents, and counts only if it
    brings no attribute before the new one: so each concept is made once, by one
    branch, and none has to be compared with the others.  Members carry their
    intents along, so that branches meet nothing but their own rows.
    """
    bits = Bits(attrs.count())
    b, o, d = bits.names("b"), bits.names("o"), bits.names("d")
    rows = staged(_intents(incidence, bits).select(*o).distinct())
    root = rows.agg(*[F.bit_and(x) for x in o]).first()  # what all objects have
    now = staged(rows.select(*[F.lit(w).cast("long").alias(y) for w, y in zip(root, b)], *o, F.lit(0).alias("y")))
    out = [now]
    while not now.isEmpty():
        each, closures = _steps(now, bits)
        first = reduce(Column.__and__, [F.col(x).bitwiseAND(bits.below(k, F.col("attr"))) == F.col(y).bitwiseAND(bits.below(k, F.col("attr"))) for k, (x, y) in enumerate(zip(b, d))])
        good = closures.filter(first)
        now = staged(each.join(good, [*b, "attr"]).select(*[F.col(x).alias(y) for x, y in zip(d, b)], *o, (F.col("attr") + 1).cast("int").alias("y")))
        out.append(now)
    return reduce(DataFrame.union, out).select(*b, *o), bits


def _listed(bits: Bits, prefix: str) -> Column:
    return bits.listed(lambda k: F.col(bits.names(prefix)[k]))


def _all(bits: Bits) -> list[int]:
    return [(1 << max(0, min(WORD, bits.n - WORD * k))) - 1 for k in range(bits.words)]


def concept_sizes(incidence: DataFrame, attrs: DataFrame) -> DataFrame:
    """(intent, n): all concepts with the number of their objects; the set of all attributes is there whether or not an object has it."""
    members, bits = closed_sets(incidence, attrs)
    b, o = bits.names("b"), bits.names("o")
    times = _intents(incidence, bits).groupBy(*o).agg(F.count("*").alias("times"))
    found = members.join(times, o).groupBy(*b).agg(F.sum("times").alias("n"))
    bottom = incidence.sparkSession.range(1).select(*[F.lit(w).cast("long").alias(c) for w, c in zip(_all(bits), b)], F.lit(0).cast("long").alias("n"))
    return found.unionByName(bottom).groupBy(*b).agg(F.max("n").alias("n")).select(_listed(bits, "b").alias("intent"), "n")


def concepts(incidence: DataFrame, attrs: DataFrame) -> DataFrame:
    """(intent, extent) of all concepts, both as sorted arrays; concept_sizes has the numbers alone, where extents are too long for a row."""
    members, bits = closed_sets(incidence, attrs)
    b = bits.names("b")
    pairs = members.join(_intents(incidence, bits), bits.names("o")).select(*b, "obj")
    bottom = incidence.sparkSession.range(1).select(*[F.lit(w).cast("long").alias(c) for w, c in zip(_all(bits), b)], F.lit(None).cast(incidence.schema["obj"].dataType).alias("obj"))
    return pairs.unionByName(bottom).groupBy(*b).agg(F.array_sort(F.collect_set("obj")).alias("extent")).select(_listed(bits, "b").alias("intent"), "extent")


def lattice_edges(incidence: DataFrame, attrs: DataFrame) -> DataFrame:
    """(lower, upper) intents of direct covers: the upper concept has the smaller intent.

    A closure of a concept and one attribute covers it if every attribute that
    it adds gives the same closure.  Where no member has any other attribute,
    the set of all attributes is the cover.
    """
    members, bits = closed_sets(incidence, attrs)
    b, d = bits.names("b"), bits.names("d")
    members = staged(members.withColumn("y", F.lit(0)))
    closures = _steps(members, bits)[1].groupBy(*b, *d).agg(F.count("*").alias("same"))
    covers = closures.filter(F.col("same") == bits.size("d") - bits.size("b")).select(*d, *b)
    full = members.groupBy(*b).agg(*[F.bit_or(F.col(x)).alias(y) for x, y in zip(bits.names("o"), d)])
    same = reduce(Column.__and__, [F.col(x) == F.col(y) for x, y in zip(b, d)])
    lone = full.filter(same & (bits.size("b") < bits.n)).select(*[F.lit(w).cast("long").alias(c) for w, c in zip(_all(bits), d)], *b)
    return covers.unionByName(lone).select(_listed(bits, "d").alias("lower"), _listed(bits, "b").alias("upper"))


def signatures(edges: DataFrame) -> DataFrame:
    """(id, signature): sorted rel:out and rel:in of each node."""
    e = edges.select("src", "rel", "dst").distinct()
    ends = e.select(F.col("src").alias("id"), F.concat("rel", F.lit(":out")).alias("s")).union(e.select("dst", F.concat("rel", F.lit(":in"))))
    return ends.groupBy("id").agg(F.array_sort(F.collect_set("s")).alias("signature"))


def induce_types(edges: DataFrame, k: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members(cluster, id), types(cluster, signature)): k-means over presence vectors; a signature has what half of the members have."""
    from pyspark.ml.clustering import KMeans

    rows = _as_vectors(_presence(edges)[1])
    model = KMeans(k=k, seed=seed, featuresCol="f", predictionCol="cluster").fit(rows)
    members = model.transform(rows).select("cluster", "id", "signature")
    size = members.groupBy("cluster").agg(F.count("*").alias("n"))
    share = members.select("cluster", F.explode("signature").alias("s")).groupBy("cluster", "s").count().join(size, "cluster")
    types = share.filter(2 * F.col("count") >= F.col("n")).groupBy("cluster").agg(F.array_sort(F.collect_set("s")).alias("signature"))
    return members.select("cluster", "id"), types


def described(signature: str, most: int = 5):
    """The first few of a sorted signature as text."""
    return F.array_join(F.slice(F.array_sort(signature), 1, most), ", ")


def lattice_summary(found: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of found(intent, n) and edges: concepts, edges, and the sizes of the largest extent and intent."""
    c = found.agg(F.count("*").alias("concepts"), F.max("n").alias("largest_extent"), F.max(F.size("intent")).cast("long").alias("largest_intent"))
    return c.crossJoin(edges.agg(F.count("*").alias("edges")))  # a row each


def induce_types_by_elbow(edges: DataFrame, max_k: int = 8, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """induce_types with the number of clusters that the elbow of the training costs gives."""
    from pyspark.ml.clustering import KMeans

    vectors = staged(_presence(edges)[1])
    kinds = vectors.select("signature").distinct().count()
    costs = [KMeans(k=k, seed=seed, featuresCol="f").fit(_as_vectors(vectors)).summary.trainingCost for k in range(2, min(max_k, kinds) + 1)]
    one = _one_cluster_cost(vectors)
    return induce_types(edges, max(2, elbow([one, *costs])), seed)


def _presence(edges: DataFrame) -> tuple[list[str], DataFrame]:
    """(names, rows(id, signature, a)): a has 1 where the node has the name."""
    sig = staged(signatures(edges))
    names = sorted(r.s for r in sig.select(F.explode("signature").alias("s")).distinct().collect())  # two for each relation
    return names, sig.select("id", "signature", F.array(*[F.array_contains("signature", n).cast("double") for n in names]).alias("a"))


def _as_vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.select("id", "signature", array_to_vector("a").alias("f"))


def _one_cluster_cost(rows: DataFrame) -> float:
    """Sum of squared distances to the mean."""
    per = rows.select(F.posexplode("a").alias("at", "x")).groupBy("at").agg((F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.avg("x")).alias("c"))
    return per.agg(F.sum("c")).first()[0] or 0.0


def elbow(costs: list[float]) -> int:
    """Number of clusters before the first drop of less than 30 % of the cost; costs[i] belongs to i + 1 clusters."""
    for i in range(1, len(costs)):
        if costs[i - 1] <= 0 or (costs[i - 1] - costs[i]) < 0.3 * costs[i - 1]:
            return i
    return len(costs)
