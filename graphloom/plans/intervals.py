"""Fixpoint over facts with validity intervals: premises hold together where their intervals meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import KEY, NotConverged
from graphloom.plans.rules import Rule, heads, in_order, is_var
from graphloom.plans.stage import staged, written

LOW, HIGH = float("-inf"), float("inf")
SPAN = ["valid_from", "valid_to"]


def bounded(edges: DataFrame) -> DataFrame:
    """(src, rel, dst, valid_from, valid_to) with infinities for open ends; intervals without an instant are left out."""
    return edges.select(*KEY, F.coalesce(F.col("valid_from").cast("double"), F.lit(LOW)).alias("valid_from"), F.coalesce(F.col("valid_to").cast("double"), F.lit(HIGH)).alias("valid_to")).filter("valid_from < valid_to")


def opened(facts: DataFrame) -> DataFrame:
    """The reverse of bounded: null for open ends."""
    null = lambda c, x: F.when(F.col(c) != x, F.col(c)).alias(c)
    return facts.select(*KEY, null("valid_from", LOW), null("valid_to", HIGH))


def coalesced(facts: DataFrame) -> DataFrame:
    """Each fact's intervals as the fewest that cover the same instants; intervals that touch are one."""
    w = Window.partitionBy(*KEY).orderBy(*SPAN)
    reach = F.max("valid_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = facts.select(*KEY, *SPAN).withColumn("_new", F.when(reach.isNull() | (F.col("valid_from") > reach), 1).otherwise(0))
    run = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*KEY, "_run").agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to")).drop("_run")


def _atom(facts: DataFrame, pattern, n: int) -> DataFrame:
    """Bindings of a pattern with its interval as _p<n>_from and _p<n>_to."""
    s, r, o = pattern
    rows = facts.filter(F.col("rel") == r)
    for x, c in ((s, "src"), (o, "dst")):
        if not is_var(x):
            rows = rows.filter(F.col(c) == x)
    if is_var(s) and s == o:
        rows = rows.filter("src = dst")
    names = {x: c for x, c in ((o, "dst"), (s, "src")) if is_var(x)}
    return rows.select(*[F.col(c).alias(x) for x, c in names.items()], F.col("valid_from").alias(f"_p{n}_from"), F.col("valid_to").alias(f"_p{n}_to"))


def _derived(rule: Rule, known: DataFrame, fresh: DataFrame, start: bool) -> list[DataFrame]:
    """Heads with the meet of their premises' intervals, at least one premise being fresh."""
    out = []
    for first in [0] if start else range(len(rule.body)):
        rows, bound, done = None, set(), []
        for i in in_order(rule.body, first):
            own = {x for x in rule.body[i] if is_var(x)}
            part = _atom(known if start or i != first else fresh, rule.body[i], i)
            if rows is None:
                rows = part
            elif not (keys := sorted(bound & own)):
                raise ValueError(f"{rule.name}: a pattern shares no variable with the others")
            else:
                meets = [F.col(f"_p{x}_from") < F.col(f"_p{y}_to") for j in done for x, y in ((i, j), (j, i))]
                rows = rows.join(part, keys).filter(reduce(Column.__and__, meets))
            bound |= own
            done.append(i)
        h = heads(rows, rule)
        of = lambda pick, end: pick(*[F.col(f"_p{i}_{end}") for i in range(len(rule.body))]) if len(rule.body) > 1 else F.col(f"_p0_{end}")
        out.append(h.select(*KEY, of(F.greatest, "from").alias("valid_from"), of(F.least, "to").alias("valid_to")).filter("valid_from < valid_to"))
    return out


def interval_closure(edges: DataFrame, rules: list[Rule], max_rounds: int = 100) -> DataFrame:
    """(src, rel, dst, valid_from, valid_to): edges and all that follows, each fact with the instants at which it does.

    A fact holds at an instant if it is given there, or if a rule derives it from
    facts that hold there; so the slice at any instant is the closure of the
    edges' slice.  Intervals are half-open, null for open ends, and coalesced.  A
    round joins what is new since the last one with what is known; instants that
    a fact has already are not new, so that rounds end.  The plan and its rows
    don't depend on how many instants are asked for.
    """
    spark = edges.sparkSession
    used = sorted({p[1] for r in rules for p in r.body} | {r.head[1] for r in rules})
    base = coalesced(bounded(edges))
    if not rules:
        return opened(base)
    other, given = base.filter(~F.col("rel").isin(used)), staged(base.filter(F.col("rel").isin(used)))
    schema, found = given.schema, []
    fresh = given
    for n in range(1, max_rounds + 1):
        known = given if not found else given.unionByName(spark.read.schema(schema).parquet(*found))
        derived = reduce(DataFrame.unionByName, [d for r in rules for d in _derived(r, known, fresh, n == 1)])
        candidates = staged(coalesced(derived))
        before = known.join(candidates.select(*KEY).distinct(), KEY, "left_semi")
        delta = coalesced(before.unionByName(candidates)).join(coalesced(before), [*KEY, *SPAN], "left_anti")
        path = written(delta.select(*schema.names))
        fresh = spark.read.schema(schema).parquet(path)
        if fresh.isEmpty():
            break
        found.append(path)
    else:
        raise NotConverged(f"no fixpoint after {max_rounds} rounds")
    every = coalesced(given.unionByName(spark.read.schema(schema).parquet(*found))) if found else given
    return opened(other.unionByName(every))
