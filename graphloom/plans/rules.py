"""Rules: patterns, checks, JSON, and bodies compiled to joins."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Pattern = tuple[str, str, str]


def is_var(token: str) -> bool:
    return token.startswith("?")


@dataclass(frozen=True)
class Rule:
    """head holds wherever all of body does and no pair of distinct is equal.

    Variables start with ?.  Relations are constants; head and distinct
    variables have to be bound by the body.
    """

    name: str
    body: tuple[Pattern, ...]
    head: Pattern
    distinct: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self) -> None:
        bound = {x for p in self.body for x in (p[0], p[2]) if is_var(x)}
        if any(is_var(p[1]) for p in (*self.body, self.head)):
            raise ValueError(f"{self.name}: a relation must not be a variable")
        if loose := {x for x in (self.head[0], self.head[2]) if is_var(x)} - bound:
            raise ValueError(f"{self.name}: head variables {sorted(loose)} are not bound by the body")
        if loose := {x for pair in self.distinct for x in pair if is_var(x)} - bound:
            raise ValueError(f"{self.name}: distinct variables {sorted(loose)} are not bound by the body")


def rules_to_json(rules: list[Rule]) -> str:
    return json.dumps([{"name": r.name, "body": [list(p) for p in r.body], "head": list(r.head), "distinct": [list(p) for p in r.distinct]} for r in rules], indent=1)


def rules_from_json(text: str) -> list[Rule]:
    triple = lambda p: (p[0], p[1], p[2])
    return [Rule(x["name"], tuple(map(triple, x["body"])), triple(x["head"]), tuple((a, b) for a, b in x.get("distinct", []))) for x in json.loads(text)]


def atom(facts: DataFrame, pattern: Pattern, premise: str | None = None) -> DataFrame:
    """Bindings of one pattern over facts(src, rel, dst): a column per variable, and the fact itself as a struct, with its round where facts have one, if premise names it."""
    s, r, o = pattern
    rows = facts.filter(F.col("rel") == r)
    if not is_var(s):
        rows = rows.filter(F.col("src") == s)
    if not is_var(o):
        rows = rows.filter(F.col("dst") == o)
    if is_var(s) and s == o:
        rows = rows.filter(F.col("src") == F.col("dst"))
    cols = {x: c for x, c in ((o, "dst"), (s, "src")) if is_var(x)}
    out = [F.col(c).alias(x) for x, c in cols.items()]
    fact = [F.struct("src", "rel", "dst").alias(premise)] if premise else []
    return rows.select(*out, *fact, *([F.col("round").alias(f"{premise}_round")] if premise and "round" in rows.columns else []))


def in_order(body: tuple[Pattern, ...], first: int = 0) -> list[int]:
    """Positions of the body from first on, each sharing a variable with those before where that is possible."""
    left, order, bound = [i for i in range(len(body)) if i != first], [first], {x for x in body[first] if is_var(x)}
    while left:
        i = next((i for i in left if bound & {body[i][0], body[i][2]}), left[0])
        left.remove(i)
        order.append(i)
        bound |= {x for x in body[i] if is_var(x)}
    return order


def join_body(sources: list[DataFrame], body: tuple[Pattern, ...], first: int = 0, premises: bool = False, seed: DataFrame | None = None, products: bool = False) -> DataFrame:
    """Bindings of a body; sources[i] has the facts for its i-th pattern.

    seed restricts variables to given rows first.  A pattern that shares no
    variable with those before makes a product, which has to be allowed.
    """
    parts = [(atom(sources[i], body[i], f"_p{i}" if premises else None), {x for x in body[i] if is_var(x)}) for i in in_order(body, first)]
    if seed is not None:
        parts.insert(0, (seed, set(seed.columns)))

    def step(acc, part):
        (left, bound), (right, own) = acc, part
        keys = sorted(bound & own)
        if not keys and own and not products:
            raise ValueError(f"{body}: a pattern shares no variable with the others; say products=True for their product")
        return (left.join(right, keys) if keys else left.crossJoin(right)), bound | own

    return reduce(step, parts[1:], parts[0])[0]


def heads(bindings: DataFrame, rule: Rule) -> DataFrame:
    """The head of each binding that passes the guards, with the other columns kept."""
    value = lambda x: F.col(f"`{x}`") if is_var(x) else F.lit(x)
    for a, b in rule.distinct:
        bindings = bindings.filter(value(a) != value(b))
    return bindings.select(value(rule.head[0]).alias("src"), F.lit(rule.head[1]).alias("rel"), value(rule.head[2]).alias("dst"), *[c for c in bindings.columns if c.startswith("_p")])


def composed(edges: DataFrame, legs: list[tuple[str, bool]], most: int | None = 25) -> DataFrame:
    """(x, ys): the other ends of paths along legs(relation, backwards), without x itself; ends with more than most answers are left out."""
    def leg(rel: str, back: bool, a: str, b: str) -> DataFrame:
        e = edges.filter(F.col("rel") == rel)
        return e.select(F.col("dst" if back else "src").alias(a), F.col("src" if back else "dst").alias(b))

    # from the last leg to the first: what the middle legs lead to is folded to distinct ends before the first one meets it
    out = leg(*legs[-1], "m", "y")
    for rel, back in reversed(legs[1:-1]):
        out = leg(rel, back, "_x", "m").join(out, "m").select(F.col("_x").alias("m"), "y").distinct()
    if len(legs) > 1:
        out = leg(*legs[0], "x", "m").join(out, "m")
    else:
        out = out.withColumnRenamed("m", "x")
    got = out.filter("x <> y").groupBy("x").agg(F.array_sort(F.collect_set("y")).alias("ys"))
    return got if most is None else got.filter(F.size("ys") <= most)


def named_paths(edges: DataFrame, recipes: dict[str, list[tuple[str, bool]]], most: int | None = 25) -> DataFrame:
    """(relation, x, ys) of derived relations by their recipes: legs(relation, backwards) under a name."""
    parts = [composed(edges, legs, most).select(F.lit(name).alias("relation"), "x", "ys") for name, legs in recipes.items()]
    return reduce(DataFrame.unionByName, parts)


class RuleBook:
    """Rules by name: a name that is there, and a rule that no typing of the relations allows, are refused."""

    def __init__(self, relations: dict | None = None) -> None:
        self.rules: list[Rule] = []
        self.relations = relations or {}

    def add(self, rule: Rule) -> bool:
        from graphloom.operators.ontology import rule_consistent

        if rule.name in self.names() or not rule_consistent(rule, self.relations):
            return False
        self.rules.append(rule)
        return True

    def names(self, axioms: list[Rule] | None = None) -> set[str]:
        """Names of all rules that a proof may rest on."""
        return {r.name for r in [*self.rules, *(axioms or [])]}
