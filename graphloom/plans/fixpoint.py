"""Least fixpoint of rules, semi-naive, with one derivation for each derived fact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.rules import Rule, heads, is_var, join_body
from graphloom.plans.stage import staged, written

KEY = ["src", "rel", "dst"]


#: Rounds in which a transitive rule goes on by steps only; longer chains are then doubled.
STEPS = 32


class NotConverged(RuntimeError):
    """New facts still came in the last round."""


def transitive(rule: Rule) -> bool:
    """Whether the rule says that its relation is transitive, and nothing else."""
    (x, r, z), body = rule.head, rule.body
    return len(body) == 2 and not rule.distinct and len({x, z, body[0][2]}) == 3 and all(map(is_var, (x, z, body[0][2]))) and body == ((x, r, body[0][2]), (body[0][2], r, z))


def steps(facts: DataFrame, rule: Rule) -> DataFrame:
    """The facts(..., rule) that a transitive rule didn't derive: all that it derives is a chain of these."""
    return facts.filter(F.col("rule").isNull() | (F.col("rule") != rule.name))


def closure(facts: DataFrame, rules: list[Rule], max_rounds: int = 100, by: list[str] | None = None, by_steps: bool = False) -> DataFrame:
    """(by..., src, rel, dst, round, rule, premises): facts and all that follows.

    Given facts have round 0, no rule and no premises.  A derived fact has the
    first round it appears in and, of its derivations in that round, the one of
    the earliest rule with the smallest premises.  by names columns that split
    the facts into worlds of their own, closed side by side in one fixpoint.
    max_rounds counts the last round, which finds nothing; more raise
    NotConverged.

    With by_steps, a transitive rule joins its facts only to those that it
    didn't derive itself, one step longer in each round, and not every fact to
    every other: a pair has a derivation for each step into its end, and not
    for each of all middles.  The facts are the same; rounds are those of the
    steps, and after STEPS of them what is left is doubled.
    """
    by = by or []
    key = [*by, *KEY]
    spark = facts.sparkSession
    if rules and not by and (strata := _strata(rules)):
        return _in_one_plan(facts, rules, strata)
    premises = "array<struct<src:string,rel:string,dst:string>>"
    base = facts.select(*key).distinct()
    used = sorted({p[1] for r in rules for p in r.body} | {r.head[1] for r in rules})
    # facts of a round stay where they were written; what is known is one scan over all of them
    own = F.coalesce(F.col("rel").isin(used), F.lit(False))
    given = [written(base.filter(own).withColumn("rule", F.lit(None).cast("string")))] if rules else []
    key_schema, found, kinds = T.StructType([*base.schema.fields, T.StructField("rule", T.StringType())]), [], None
    told = sorted({r.head[1] for r in rules})
    for n in range(1, max_rounds + 1):
        if not rules:
            break
        known = spark.read.schema(key_schema).parquet(*given, *found)
        whole = n == 1 or by_steps and n == STEPS + 1
        fresh = known if whole else spark.read.schema(key_schema).parquet(found[-1])
        short = by_steps and n <= STEPS
        derived = [d for k, r in enumerate(rules) for d in _derive(r, k, known, fresh, by, None if whole else kinds, short and transitive(r))]
        if not derived:
            break
        every = reduce(DataFrame.unionByName, derived).join(known.filter(F.col("rel").isin(told)).select(*key), key, "left_anti")
        first = every.groupBy(*key).agg(F.min(F.struct("order", "premises", "rule")).alias("d"))
        new = first.select(*key, F.lit(n).alias("round"), "d.rule", F.col("d.premises").cast(premises).alias("premises"))
        path = written(new)
        kinds = {(r.rel, r.rule) for r in spark.read.schema(new.schema).parquet(path).select("rel", "rule").distinct().collect()}  # a row for each rule at most
        if not kinds:
            break
        found.append(path)
        schema = new.schema
    else:
        raise NotConverged(f"no fixpoint after {max_rounds} rounds")
    base = spark.read.schema(key_schema).parquet(*given).select(*key).unionByName(base.filter(~own)) if rules else base
    out = base.select(*key, F.lit(0).alias("round"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast(premises).alias("premises"))
    return out.unionByName(spark.read.schema(schema).parquet(*found)) if found else out


def _strata(rules: list[Rule]) -> list[str]:
    """Head relations, each after those that its rules need; empty if a relation needs itself."""
    needs = {h: {p[1] for r in rules if r.head[1] == h for p in r.body} for h in {r.head[1] for r in rules}}
    out: list[str] = []
    while left := [h for h in needs if h not in out]:
        free = sorted(h for h in left if not needs[h] & set(left))
        if not free:
            return []
        out += free
    return out


def _in_one_plan(facts: DataFrame, rules: list[Rule], strata: list[str]) -> DataFrame:
    """closure without recursion: one plan, a relation at a time, in place of rounds.

    The round of a fact is one more than that of its latest premise; of several
    derivations that of the earliest round counts.
    """
    premises = "array<struct<src:string,rel:string,dst:string>>"
    base = facts.select(*KEY).distinct()
    known = base.withColumn("round", F.lit(0))
    out = known.select(*KEY, "round", F.lit(None).cast("string").alias("rule"), F.lit(None).cast(premises).alias("premises"))
    for h in strata:
        each = []
        for k, r in enumerate(rules):
            if r.head[1] == h:
                b = heads(join_body([known] * len(r.body), r.body, premises=True), r)
                n = F.greatest(*[F.col(f"_p{i}_round") for i in range(len(r.body))]) if len(r.body) > 1 else F.col("_p0_round")
                each.append(b.select(*KEY, (n + 1).alias("round"), F.lit(k).alias("order"), F.array(*[F.col(f"_p{i}") for i in range(len(r.body))]).alias("premises"), F.lit(r.name).alias("rule")))
        first = reduce(DataFrame.unionByName, each).groupBy(*KEY).agg(F.min(F.struct("round", "order", "premises", "rule")).alias("d"))
        first = first.join(base.filter(F.col("rel") == h), KEY, "left_anti")
        new = first.select(*KEY, "d.round", "d.rule", F.col("d.premises").cast(premises).alias("premises"))
        if any(p[1] == h for r in rules for p in r.body):
            new = staged(new)  # read again by the rules that need it
        known = known.unionByName(new.select(*KEY, "round"))
        out = out.unionByName(new)
    return out


def _derive(rule: Rule, order: int, known: DataFrame, fresh: DataFrame, by: list[str], kinds: set[tuple[str, str]] | None, short: bool = False) -> list[DataFrame]:
    """Heads with at least one premise that is new since the last round; one join for each place it can stand.

    kinds(relation, rule) are those of what is new, none at the start; short: the
    second premise is a step of the rule.
    """
    out = []
    start = kinds is None
    for i in [0] if start else range(len(rule.body)):
        if not start and not any(rel == rule.body[i][1] and not (short and i == 1 and by_rule == rule.name) for rel, by_rule in kinds):
            continue
        sources = [known if start or j != i else fresh for j in range(len(rule.body))]
        if short:
            sources[1] = steps(sources[1], rule)
        if by:
            bindings = _join_by(sources, rule, i, by)
        else:
            bindings = join_body(sources, rule.body, i, premises=True)
        h = heads(bindings.withColumnsRenamed({b: f"_pby_{b}" for b in by}), rule)
        listed = F.array(*[F.col(f"_p{j}") for j in range(len(rule.body))])
        out.append(h.select(*[F.col(f"_pby_{b}").alias(b) for b in by], *KEY, F.lit(order).alias("order"), listed.alias("premises"), F.lit(rule.name).alias("rule")))
    return out


def _join_by(sources: list[DataFrame], rule: Rule, first: int, by: list[str]) -> DataFrame:
    """join_body within each world."""
    from graphloom.plans.rules import atom, in_order, is_var

    out, bound = None, set()
    for i in in_order(rule.body, first):
        own = {x for x in rule.body[i] if is_var(x)}
        rows = atom(sources[i], rule.body[i], f"_p{i}").select("*") if not by else _atom_by(sources[i], rule.body[i], f"_p{i}", by)
        out = rows if out is None else out.join(rows, [*by, *sorted(bound & own)])
        bound |= own
    return out


def _atom_by(facts: DataFrame, pattern, premise: str, by: list[str]) -> DataFrame:
    from graphloom.plans.rules import is_var

    s, r, o = pattern
    rows = facts.filter(F.col("rel") == r)
    for x, c in ((s, "src"), (o, "dst")):
        if not is_var(x):
            rows = rows.filter(F.col(c) == x)
    if is_var(s) and s == o:
        rows = rows.filter("src = dst")
    cols = {x: c for x, c in ((o, "dst"), (s, "src")) if is_var(x)}
    return rows.select(*by, *[F.col(c).alias(x) for x, c in cols.items()], F.struct("src", "rel", "dst").alias(premise))


def axiom_rules(relation_types: list[dict]) -> list[Rule]:
    """Rules of relations that are symmetric, transitive or the inverse of another; inverse_of works one way."""
    out = []
    for t in relation_types:
        r = t["name"]
        if t.get("symmetric"):
            out.append(Rule(f"ax:sym:{r}", (("?x", r, "?y"),), ("?y", r, "?x")))
        if t.get("transitive"):
            out.append(Rule(f"ax:trans:{r}", (("?x", r, "?y"), ("?y", r, "?z")), ("?x", r, "?z")))
        if inv := t.get("inverse_of"):
            out.append(Rule(f"ax:inv:{r}:{inv}", (("?x", r, "?y"),), ("?y", inv, "?x")))
    return out


def answers(closed: DataFrame, workload: DataFrame) -> DataFrame:
    """workload(head, relation, ...) with answers, sorted, and answered."""
    tails = closed.select(F.col("src").alias("head"), F.col("rel").alias("relation"), "dst")
    asked = workload.select("head", "relation").distinct().join(tails, ["head", "relation"]).groupBy("head", "relation").agg(F.array_sort(F.collect_set("dst")).alias("answers"))
    none = F.array().cast("array<string>")
    out = workload.join(asked, ["head", "relation"], "left").withColumn("answers", F.coalesce("answers", none))
    return out.withColumn("answered", F.size("answers") > 0)


def with_facts(closed: DataFrame, added: DataFrame) -> DataFrame:
    """closed with added facts that it doesn't have, visible at once and without new derivations."""
    new = added.select(*KEY).distinct().join(closed, KEY, "left_anti")
    premises = closed.schema["premises"].dataType
    return closed.unionByName(new.select(*KEY, F.lit(0).alias("round"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast(premises).alias("premises")))


def proof_steps(closed: DataFrame, goals: DataFrame) -> DataFrame:
    """(goal_src, goal_rel, goal_dst, src, rel, dst, rule, round): every fact that the derivations of the goals(src, rel, dst) rest on.

    Premises always come from an earlier round, so that at most as many steps
    are needed as there are rounds.
    """
    goal = [F.col(c).alias(f"goal_{c}") for c in KEY]
    now = staged(goals.select(*KEY).distinct().join(closed, KEY).select(*goal, *KEY, "rule", "round", "premises"))
    out = [now]
    while not (todo := now.filter(F.size("premises") > 0)).isEmpty():
        nxt = todo.select(*[f"goal_{c}" for c in KEY], F.explode("premises").alias("p")).select(*[f"goal_{c}" for c in KEY], "p.src", "p.rel", "p.dst").distinct()
        now = staged(nxt.join(closed, KEY).select(*[f"goal_{c}" for c in KEY], *KEY, "rule", "round", "premises"))
        out.append(now)
    return reduce(DataFrame.unionByName, out).drop("premises").distinct()


def grounded(closed: DataFrame, base: DataFrame, known_rules: list[str]) -> DataFrame:
    """closed with grounded: given facts that are in base, and facts whose rule is known and whose premises are all grounded."""
    given = closed.join(base.select(*KEY).distinct().withColumn("_in", F.lit(True)), KEY, "left")
    ok = F.when(F.col("rule").isNull(), F.coalesce("_in", F.lit(False))).otherwise(F.col("rule").isin(known_rules))
    flagged = staged(given.withColumn("ok", ok).drop("_in"))
    uses = staged(flagged.filter(F.size("premises") > 0).select(*KEY, F.explode("premises").alias("p")).select(*[F.col(c).alias(f"h_{c}") for c in KEY], "p.src", "p.rel", "p.dst"))
    bad = new = staged(flagged.filter(~F.col("ok")).select(*KEY))
    while not new.isEmpty():
        above = uses.join(new, KEY).select(*[F.col(f"h_{c}").alias(c) for c in KEY]).distinct()
        new = staged(above.join(bad, KEY, "left_anti"))
        bad = staged(bad.union(new))
    return flagged.drop("ok").join(bad.withColumn("_bad", F.lit(True)), KEY, "left").withColumn("grounded", F.col("_bad").isNull()).drop("_bad")
