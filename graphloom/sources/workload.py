"""A made-up organisation with questions on it: people, companies, places, and what a system may or may not know of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.evaluation import running_sum
from graphloom.operators.ontology import RELATION_SCHEMA
from graphloom.plans.fixpoint import closure
from graphloom.plans.rules import Rule
from graphloom.plans.stage import staged

#: Classes of questions: stated, deduced by given rules, deduced by rules to discover, to be induced, and beyond the graph.
CLASSES = ("STATED", "DED_GIVEN", "DED_DISCOVER", "INDUCTIVE", "NOVEL")

#: The rules that ship with the graph.
GIVEN = [
    Rule("given:ancestor_base", (("?x", "parent_of", "?y"),), ("?x", "ancestor_of", "?y")),
    Rule("given:ancestor_step", (("?x", "ancestor_of", "?z"), ("?z", "parent_of", "?y")), ("?x", "ancestor_of", "?y")),
]
_SUPERIOR = [
    Rule("superior_base", (("?x", "manages", "?y"),), ("?x", "superior_of", "?y")),
    Rule("superior_step", (("?x", "superior_of", "?z"), ("?z", "manages", "?y")), ("?x", "superior_of", "?y")),
]


@dataclass(frozen=True)
class Size:
    people: int = 120
    companies: int = 8
    departments: int = 6
    skills: int = 12
    languages: int = 4
    regions: int = 6
    cities_per_region: int = 3
    foods: int = 8
    questions: int = 300
    repeat_rate: float = 0.30
    class_mix: tuple[float, ...] = (0.22, 0.20, 0.20, 0.23, 0.15)
    language_noise: float = 0.15
    language_withheld: float = 0.30
    language_calibration: float = 0.10
    seed: int = 0


def u(size: Size, what: str, key: Column) -> Column:
    """Uniform in [0, 1) from a hash of the seed, what is drawn and for whom."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(size.seed)), F.lit(what), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def pick(size: Size, what: str, key: Column, n) -> Column:
    return F.floor(u(size, what, key) * n).cast("long")


def _name(kind: str, c: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), c.cast("string"))


def people(spark: SparkSession, size: Size) -> DataFrame:
    """(i, person, company, city, department, language, food, shown) by number; shown is stated, asked or calibration for the language."""
    i = F.col("i")
    n_cities = size.regions * size.cities_per_region
    p = spark.range(size.people).select(F.col("id").alias("i"))
    p = p.withColumn("company", pick(size, "company", i, size.companies))
    home = F.when(u(size, "stays", i) < 0.75, pick(size, "seat", F.col("company"), n_cities)).otherwise(pick(size, "city", i, n_cities))
    own = F.when(u(size, "other", i) < size.language_noise, pick(size, "language", i, size.languages)).otherwise(F.col("company") % size.languages)
    v = u(size, "shown", i)
    shown = F.when(v < size.language_withheld, "asked").when(v < size.language_withheld + size.language_calibration, "calibration").otherwise("stated")
    return p.select("i", _name("person", i).alias("person"), "company", home.alias("city"), pick(size, "department", i, size.departments).alias("department"), own.alias("language"), pick(size, "food", i, size.foods).alias("food"), shown.alias("shown"))


def _edge(df: DataFrame, src: Column, rel: str, dst: Column) -> DataFrame:
    return df.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))


def base_facts(spark: SparkSession, size: Size) -> DataFrame:
    """(src, rel, dst) of the graph, without what is only asked."""
    p = staged(people(spark, size))
    me, i = F.col("person"), F.col("i")
    cities = spark.range(size.regions * size.cities_per_region)
    out = [
        _edge(cities, _name("city", F.col("id")), "part_of", _name("region", F.floor(F.col("id") / size.cities_per_region))),
        _edge(spark.range(size.regions), _name("region", F.col("id")), "part_of", _name("country", F.col("id") % max(2, size.regions // 3))),
        _edge(spark.range(size.companies), _name("company", F.col("id")), "located_in", _name("city", pick(size, "seat", F.col("id"), size.regions * size.cities_per_region))),
        _edge(p, me, "works_at", _name("company", F.col("company"))),
        _edge(p, me, "lives_in", _name("city", F.col("city"))),
        _edge(p, me, "member_of", _name("department", F.col("department"))),
        _edge(p.filter("shown = 'stated'"), me, "primary_language", _name("language", F.col("language"))),
    ]
    skill = p.withColumn("k", F.explode(F.sequence(F.lit(0), 1 + pick(size, "skills", i, 3))))
    out.append(_edge(skill, me, "has_skill", _name("skill", pick(size, "skill", F.concat_ws("-", "department", F.col("k")), size.skills))))
    # colleagues are numbered within their company by a hash
    staff = staged(p.select("i", "person", "company", F.row_number().over(Window.partitionBy("company").orderBy(u(size, "staff", i), "i")).alias("place")))
    n = staff.groupBy("company").agg(F.count("*").alias("n"))
    numbered = staff.select("company", F.col("place").alias("at"), F.col("person").alias("other"))
    boss = staff.filter("place > 1").withColumn("at", (1 + pick(size, "boss", i, F.col("place") - 1)).cast("int"))
    out.append(_edge(boss.join(numbered, ["company", "at"]), F.col("other"), "manages", me))
    friend = staff.join(n, "company").withColumn("k", F.explode(F.sequence(F.lit(1), 1 + pick(size, "friends", i, 3)))).withColumn("at", (1 + pick(size, "friend", F.concat_ws("-", i, F.col("k")), F.col("n"))).cast("int"))
    friend = staged(friend.join(numbered, ["company", "at"]).filter("person <> other").select("person", "other"))
    out += [_edge(friend, me, "friend_of", F.col("other")), _edge(friend, F.col("other"), "friend_of", me)]
    child = p.filter((i >= size.people // 2) & (u(size, "has_parent", i) < 0.7))
    out.append(_edge(child, _name("person", pick(size, "parent", i, i)), "parent_of", me))
    every = out[0]
    for e in out[1:]:
        every = every.union(e)
    return staged(every.distinct())


def truth(spark: SparkSession, size: Size, facts: DataFrame) -> DataFrame:
    """(head, relation, tails) of all that can be asked of people; tails are sorted."""
    p = people(spark, size)
    one = lambda rel, kind, c: p.select(F.col("person").alias("head"), F.lit(rel).alias("relation"), _name(kind, F.col(c)).alias("tail"))
    rows = one("works_at", "company", "company").union(one("lives_in", "city", "city")).union(one("member_of", "department", "department")).union(one("primary_language", "language", "language")).union(one("favourite_food", "food", "food"))
    for rel, base, rules in (("ancestor_of", "parent_of", GIVEN), ("superior_of", "manages", _SUPERIOR)):
        rows = rows.union(closure(facts.filter(F.col("rel") == base), rules).filter(F.col("rel") == rel).select(F.col("src"), "rel", "dst"))
    got = rows.groupBy("head", "relation").agg(F.array_sort(F.collect_set("tail")).alias("tails"))
    staff = p.groupBy("company").agg(F.array_sort(F.collect_list("person")).alias("staff"))
    mates = p.join(staff, "company").select(F.col("person").alias("head"), F.lit("colleague_of").alias("relation"), F.array_remove("staff", F.col("person")).alias("tails"))
    return staged(got.union(mates))


def relations(spark: SparkSession) -> DataFrame:
    spec = [
        ("works_at", ["Person"], ["Company"], "functional"), ("lives_in", ["Person"], ["City"], "functional"), ("member_of", ["Person"], ["Department"], "functional"),
        ("located_in", ["Company"], ["City"], "functional"), ("part_of", ["City", "Region"], ["Region", "Country"], "transitive"), ("friend_of", ["Person"], ["Person"], "symmetric"),
        ("has_skill", ["Person"], ["Skill"], ""), ("parent_of", ["Person"], ["Person"], ""), ("manages", ["Person"], ["Person"], ""), ("primary_language", ["Person"], ["Language"], "functional"),
        ("ancestor_of", ["Person"], ["Person"], ""), ("superior_of", ["Person"], ["Person"], ""), ("colleague_of", ["Person"], ["Person"], ""), ("favourite_food", ["Person"], ["Food"], ""),
    ]
    return spark.createDataFrame([(n, d, r, k == "symmetric", k == "transitive", k == "functional", None) for n, d, r, k in spec], RELATION_SCHEMA)


def nodes(facts: DataFrame) -> DataFrame:
    """(id, type) by the names: person_3 is a Person."""
    ids = facts.select(F.col("src").alias("id")).union(facts.select("dst")).distinct()
    return ids.select("id", F.initcap(F.substring_index("id", "_", 1)).alias("type"))


def questions(spark: SparkSession, size: Size, true: DataFrame) -> DataFrame:
    """(idx, head, relation, qclass): distinct questions as they are drawn, with repeats of earlier ones in between."""
    d = spark.range(4 * size.questions).select(F.col("id").alias("draw"))
    draw, v = F.col("draw"), u(size, "class", F.col("draw"))
    edge, kind = 0.0, F.lit(CLASSES[-1])
    bounds = []
    for c, m in zip(CLASSES, size.class_mix):
        edge += m
        bounds.append((c, edge))
    for c, b in reversed(bounds[:-1]):
        kind = F.when(v < b, c).otherwise(kind)
    d = d.withColumn("qclass", kind)
    stated = F.element_at(F.array(*[F.lit(x) for x in ("works_at", "lives_in", "member_of")]), (1 + pick(size, "stated", draw, 3)).cast("int"))
    rel = F.when(F.col("qclass") == "STATED", stated).when(F.col("qclass") == "DED_GIVEN", "ancestor_of").when(F.col("qclass") == "INDUCTIVE", "primary_language").when(F.col("qclass") == "NOVEL", "favourite_food")
    d = d.withColumn("relation", rel.otherwise(F.when(u(size, "discover", draw) < 0.5, "superior_of").otherwise("colleague_of")))
    # who can be asked: those with an answer, and only people whose language isn't stated
    shown = people(spark, size).select(F.col("person").alias("head"), "shown")
    can = true.filter(F.size("tails") > 0).select("head", "relation").join(shown, "head").filter("relation <> 'primary_language' OR shown = 'asked'")
    can = can.withColumn("at", F.row_number().over(Window.partitionBy("relation").orderBy("head")) - 1).select("relation", "at", "head")
    n = can.groupBy("relation").agg(F.count("*").alias("n"))
    asked = d.join(n, "relation").withColumn("at", pick(size, "who", draw, F.col("n")).cast("int")).join(can, ["relation", "at"])
    first = asked.groupBy("head", "relation").agg(F.min(F.struct("draw", "qclass")).alias("f"))
    placed = first.select("head", "relation", "f.qclass", "f.draw", F.lit(1).alias("one"))
    distinct = staged(running_sum(placed, "one", "draw", None, "j").select("head", "relation", "qclass", "j"))
    most = max(1, int(size.questions * (1 - size.repeat_rate)))
    distinct = distinct.filter(F.col("j") <= most)
    have = distinct.count()
    rows = spark.range(size.questions).select(F.col("id").alias("idx"))
    again = (F.col("idx") > 0) & (u(size, "again", F.col("idx")) < size.repeat_rate)
    rows = running_sum(rows.withColumn("_new", (~again).cast("long")), "_new", "idx", None, "_k")
    issued = F.least(F.col("_k"), F.lit(have))
    j = F.when((F.col("_new") == 1) & (F.col("_k") <= have), F.col("_k")).otherwise(1 + pick(size, "repeat", F.col("idx"), issued))
    return rows.withColumn("j", j).join(distinct.withColumn("j", F.col("j").cast("long")), "j").select("idx", "head", "relation", "qclass")


def organisation(spark: SparkSession, size: Size = Size()) -> dict:
    """{facts, nodes, relations, rules, truth, questions, calibration}: the same for the same size and seed."""
    facts = base_facts(spark, size)
    true = truth(spark, size, facts)
    held = people(spark, size).filter("shown = 'calibration'").select(F.col("person").alias("head"), F.lit("primary_language").alias("relation"), _name("language", F.col("language")).alias("tail"))
    return {"facts": facts, "nodes": nodes(facts), "relations": relations(spark), "rules": list(GIVEN), "truth": true, "questions": staged(questions(spark, size, true)), "calibration": held}


def synthetic_dataset(spark: SparkSession, size: Size = Size(), seed: int = 0) -> DataFrame:
    """The facts cut into train, valid and test."""
    from graphloom.operators.graph import split

    return split(base_facts(spark, size), seed=seed)


def random_dag(spark: SparkSession, n: int, p: float, seed: int = 0) -> DataFrame:
    """(src, rel, dst) of a random graph whose parent edges go from smaller to larger numbers, each with probability p."""
    a = spark.range(n).select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id") + 1, F.lit(n))).alias("b")).filter(F.col("b") < n)
    key = F.concat_ws(":", F.lit(str(seed)), "a", "b")
    there = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32) < p
    return a.filter(there).select(_name("n", F.col("a")).alias("src"), F.lit("parent").alias("rel"), _name("n", F.col("b")).alias("dst"))
