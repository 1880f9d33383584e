"""Planning for many questions at once: states are rows, actions are joins, and a level of the search is one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.planner import Action
from graphloom.plans.fixpoint import KEY, closure
from graphloom.plans.rules import Pattern, Rule, is_var
from graphloom.plans.stage import staged

FACTS = "array<struct<src:string,rel:string,dst:string>>"
STATE = ["q", "state"]


def state_of(facts: Column) -> Column:
    """A name for a set of facts: the digest of its sorted form, whose parts are told apart by their lengths."""
    written = F.transform(facts, lambda f: F.concat_ws(":", F.length(f["src"]), f["src"], F.length(f["rel"]), f["rel"], F.length(f["dst"]), f["dst"]))
    return F.sha2(F.array_join(written, ";"), 256)


def _as_set(facts: Column) -> Column:
    return F.array_sort(F.array_distinct(facts))


def starts_of(facts: DataFrame) -> DataFrame:
    """(q, facts) from rows (q, src, rel, dst): the first state of each question."""
    return facts.groupBy("q").agg(_as_set(F.collect_set(F.struct(*KEY))).cast(FACTS).alias("facts"))


def _exploded(states: DataFrame) -> DataFrame:
    return states.select(*STATE, F.explode("facts").alias("f")).select(*STATE, "f.src", "f.rel", "f.dst")


def grounded(states: DataFrame, action: Action, entities: DataFrame | None = None) -> DataFrame:
    """(q, state, a column per variable): the bindings under which all that the action needs is there.

    One join of the states' facts for each pattern, within a state.  Variables
    that only effects have take every entity of the state, and of
    entities(q, entity).
    """
    facts = _exploded(states)
    out, bound = states.select(*STATE), set()
    for p in action.needs:
        rows, names = facts, {}
        for x, c in zip(p, KEY):
            if not is_var(x):
                rows = rows.filter(F.col(c) == x)
            elif x in names:
                rows = rows.filter(F.col(c) == F.col(names[x]))
            else:
                names[x] = c
        rows = rows.select(*STATE, *[F.col(c).alias(x) for x, c in names.items()]).distinct()
        out = out.join(rows, [*STATE, *sorted(bound & set(names))])
        bound |= set(names)
    free = sorted({x for p in (*action.adds, *action.removes) for x in p if is_var(x)} - bound)
    if free:
        known = facts.select(*STATE, F.explode(F.array("src", "dst")).alias("e"))
        if entities is not None:
            known = known.unionByName(states.select(*STATE).join(entities.select("q", F.col("entity").alias("e")), "q"))
        known = staged(known.distinct())
        for x in free:
            out = out.join(known.withColumnRenamed("e", x), STATE)
    return out


def _filled(patterns: tuple[Pattern, ...]) -> Column:
    value = lambda x: F.col(f"`{x}`") if is_var(x) else F.lit(x)
    one = lambda p: F.struct(*[value(x).cast("string").alias(c) for x, c in zip(p, KEY)])
    return F.array(*map(one, patterns)).cast(FACTS)


def applied(states: DataFrame, action: Action, entities: DataFrame | None = None) -> DataFrame:
    """(q, state, facts, cost, steps) of the states(q, state, facts, cost, steps) after the action, in every way that it can be taken."""
    bound = grounded(states, action, entities).join(states, STATE)
    names = sorted(c for c in bound.columns if is_var(c))
    step = F.concat(F.lit(f"{action.name}("), F.concat_ws(", ", *[F.col(f"`{x}`") for x in names]), F.lit(")"))
    facts = _as_set(F.array_union(F.array_except("facts", _filled(action.removes)), _filled(action.adds)))
    return bound.select("q", facts.alias("facts"), (F.col("cost") + action.cost).alias("cost"), F.concat("steps", F.array(step)).alias("steps")).select("q", state_of(F.col("facts")).alias("state"), "facts", "cost", "steps")


def satisfied(states: DataFrame, goals: DataFrame, rules: list[Rule]) -> DataFrame:
    """The states(q, state, facts) whose closure under the rules has, for each of goals(q, src, rel, dst) of its question, a fact like it; a null is like anything."""
    facts = _exploded(states)
    if rules:
        facts = closure(facts, rules, by=STATE).select(*STATE, *KEY)
    wanted = goals.select("q", *[F.col(c).alias(f"_{c}") for c in KEY]).distinct()
    like = reduce(Column.__and__, [F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c)) for c in KEY])
    met = facts.join(wanted, "q").filter(like).select(*STATE, "_src", "_rel", "_dst").distinct().groupBy(*STATE).agg(F.count("*").alias("met"))
    need = wanted.groupBy("q").agg(F.count("*").alias("need"))
    return states.join(met, STATE).join(need, "q").filter("met = need").drop("met", "need")


def plans(starts: DataFrame, goals: DataFrame, actions: list[Action], rules: list[Rule] | None = None, max_depth: int = 6, entities: DataFrame | None = None) -> DataFrame:
    """(q, cost, steps): a cheapest plan of at most max_depth steps for each question that has one.

    starts(q, facts) are closed under the rules first.  A level extends all
    states of all questions by every action; a state that was reached as
    cheaply before, or costs as much as a plan that is known, is dropped.  Of
    several ways to a state at one cost the first one by its steps stays.  A
    state is a row, and has to fit in one; questions are independent, and none
    is searched on the driver.
    """
    rules = rules or []
    first = starts.select("q", _as_set(F.col("facts").cast(FACTS)).alias("facts")).withColumn("state", state_of(F.col("facts")))
    if rules:
        closed = closure(_exploded(first), rules, by=STATE).groupBy("q").agg(F.collect_set(F.struct(*KEY)).alias("facts"))
        empty = first.select("q").join(closed, "q", "left")
        first = empty.select("q", _as_set(F.coalesce(F.col("facts").cast(FACTS), F.array().cast(FACTS))).alias("facts")).withColumn("state", state_of(F.col("facts")))
    now = staged(first.select("q", "state", "facts", F.lit(0.0).alias("cost"), F.array().cast("array<string>").alias("steps")))
    goals = staged(goals.select("q", *KEY))
    known = now.select("q", "state", "cost")
    done = staged(satisfied(now, goals, rules).select("q", "cost", "steps"))
    for _ in range(max_depth):
        after = reduce(DataFrame.unionByName, [applied(now, a, entities) for a in actions])
        best = after.groupBy(*STATE).agg(F.min(F.struct("cost", "steps", "facts")).alias("b")).select(*STATE, "b.facts", "b.cost", "b.steps")
        before = known.groupBy(*STATE).agg(F.min("cost").alias("had"))
        limit = done.groupBy("q").agg(F.min("cost").alias("most"))
        new = best.join(before, STATE, "left").join(limit, "q", "left").filter((F.col("had").isNull() | (F.col("cost") < F.col("had"))) & (F.col("most").isNull() | (F.col("cost") < F.col("most"))))
        now = staged(new.select("q", "state", "facts", "cost", "steps"))
        if now.isEmpty():
            break
        known = known.unionByName(now.select("q", "state", "cost"))
        done = staged(done.unionByName(satisfied(now, goals, rules).select("q", "cost", "steps")))
    return done.groupBy("q").agg(F.min(F.struct("cost", F.size("steps").alias("n"), "steps")).alias("b")).select("q", "b.cost", "b.steps")
