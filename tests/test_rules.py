"""Rules, fixpoints and proofs on tiny graphs."""

import random

import pytest

from graphloom.operators import ontology
from graphloom.plans import fixpoint
from graphloom.plans.rules import Rule, heads, join_body, rules_from_json, rules_to_json

E = "src string, rel string, dst string"
ANCESTOR = [
    Rule("base", (("?x", "parent", "?y"),), ("?x", "ancestor", "?y")),
    Rule("step", (("?x", "parent", "?y"), ("?y", "ancestor", "?z")), ("?x", "ancestor", "?z")),
]


def edges(spark, *triples):
    return spark.createDataFrame(list(triples), E)


def triples(df):
    return {(r.src, r.rel, r.dst) for r in df.collect()}


def test_axioms(spark):
    e = edges(spark, ("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"))
    rules = fixpoint.axiom_rules([{"name": "r", "transitive": True}])
    w = spark.createDataFrame([("a", "r"), ("d", "r"), ("x", "s")], "head string, relation string")
    got = {(r.head, r.relation): (r.answers, r.answered) for r in fixpoint.answers(fixpoint.closure(e, rules), w).collect()}
    assert got == {("a", "r"): (["b", "c", "d"], True), ("d", "r"): ([], False), ("x", "s"): ([], False)}
    both = fixpoint.closure(edges(spark, ("a", "r", "b")), fixpoint.axiom_rules([{"name": "r", "symmetric": True, "inverse_of": "q"}]))
    assert triples(both) == {("a", "r", "b"), ("b", "r", "a"), ("b", "q", "a"), ("a", "q", "b")}


def naive(facts, rules):
    known = set(facts)
    while True:
        new = set()
        for r in rules:
            binds = [{}]
            for s, p, o in r.body:
                out = []
                for b in binds:
                    for fs, fr, fo in known:
                        if fr != p:
                            continue
                        c = dict(b)
                        if all((c.setdefault(x, v) == v) if x.startswith("?") else x == v for x, v in ((s, fs), (o, fo))):
                            out.append(c)
                binds = out
            for b in binds:
                if all(b.get(x, x) != b.get(y, y) for x, y in r.distinct):
                    new.add((b.get(r.head[0], r.head[0]), r.head[1], b.get(r.head[2], r.head[2])))
        if new <= known:
            return known
        known |= new


@pytest.mark.parametrize("seed", [0, 1])
def test_semi_naive_equals_naive(spark, seed):
    rng = random.Random(seed)
    facts = {(f"n{rng.randrange(7)}", rng.choice("pq"), f"n{rng.randrange(7)}") for _ in range(9)}
    rules = [
        Rule("t", (("?x", "p", "?y"), ("?y", "p", "?z")), ("?x", "p", "?z")),
        Rule("m", (("?x", "p", "?y"), ("?y", "q", "?z")), ("?z", "s", "?x"), (("?x", "?z"),)),
        Rule("c", (("n1", "s", "?x"), ("?x", "q", "?x")), ("?x", "loop", "n1")),
        Rule("u", (("?x", "s", "?y"),), ("?x", "q", "?y")),
    ]
    closed = fixpoint.closure(edges(spark, *facts).repartition(3), rules)
    assert triples(closed) == naive(facts, rules)
    rows = closed.collect()
    have = {(r.src, r.rel, r.dst): r for r in rows}
    assert len(rows) == len(have)
    for r in rows:  # every derivation holds, from earlier rounds
        if r.rule:
            p = [(x.src, x.rel, x.dst) for x in r.premises]
            assert all(have[x].round < r.round for x in p)
            assert (r.src, r.rel, r.dst) in naive(p, [x for x in rules if x.name == r.rule])
        else:
            assert (r.src, r.rel, r.dst) in facts and r.round == 0


def test_worlds_side_by_side(spark):
    rows = [(1, "a", "parent", "b"), (1, "b", "parent", "c"), (2, "b", "parent", "c"), (2, "c", "parent", "d")]
    got = fixpoint.closure(spark.createDataFrame(rows, f"w int, {E}"), ANCESTOR, by=["w"]).filter("rel = 'ancestor'")
    assert {(r.w, r.src, r.dst) for r in got.collect()} == {(1, "a", "b"), (1, "b", "c"), (1, "a", "c"), (2, "b", "c"), (2, "c", "d"), (2, "b", "d")}


def test_not_converged(spark):
    e = edges(spark, *[(f"a{i}", "r", f"a{i + 1}") for i in range(20)])
    rule = [Rule("right", (("?x", "q", "?y"), ("?y", "r", "?z")), ("?x", "q", "?z")), Rule("base", (("?x", "r", "?y"),), ("?x", "q", "?y"))]
    with pytest.raises(fixpoint.NotConverged):
        fixpoint.closure(e, rule, max_rounds=3)


def test_proofs(spark):
    e = edges(spark, ("a", "parent", "b"), ("b", "parent", "c"))
    closed = fixpoint.closure(e, ANCESTOR)
    goal = edges(spark, ("a", "ancestor", "c"))
    steps = {(r.src, r.rel, r.dst): r.rule for r in fixpoint.proof_steps(closed, goal).collect()}
    assert steps == {("a", "ancestor", "c"): "step", ("a", "parent", "b"): None, ("b", "ancestor", "c"): "base", ("b", "parent", "c"): None}
    ok = lambda base, names: {(r.src, r.rel, r.dst): r.grounded for r in fixpoint.grounded(closed, base, names).collect()}
    assert all(ok(e, ["base", "step"]).values())
    part = ok(e, ["step"])
    assert not part[("a", "ancestor", "c")] and part[("a", "parent", "b")]
    assert not ok(edges(spark, ("a", "parent", "b")), ["base", "step"])[("a", "ancestor", "c")]


def test_added_facts_are_seen_without_derivations(spark):
    closed = fixpoint.closure(edges(spark, ("a", "parent", "b")), ANCESTOR)
    more = fixpoint.with_facts(closed, edges(spark, ("b", "parent", "c"), ("a", "parent", "b")))
    assert triples(more) == {("a", "parent", "b"), ("a", "ancestor", "b"), ("b", "parent", "c")}


def test_rules_are_checked():
    with pytest.raises(ValueError):
        Rule("x", (("?a", "r", "?b"),), ("?a", "r", "?c"))
    with pytest.raises(ValueError):
        Rule("x", (("?a", "?r", "?b"),), ("?a", "r", "?b"))
    with pytest.raises(ValueError):
        Rule("x", (("?a", "r", "?b"),), ("?a", "r", "?b"), (("?a", "?z"),))
    rules = [*ANCESTOR, Rule("d", (("?a", "r", "?b"),), ("?b", "r", "?a"), (("?a", "?b"),))]
    assert rules_from_json(rules_to_json(rules)) == rules


def test_bodies(spark):
    e = edges(spark, ("a", "r", "a"), ("a", "r", "b"), ("b", "s", "c"), ("x", "s", "y"))
    rows = lambda *body: {tuple(sorted(r.asDict().items())) for r in join_body([e] * len(body), body, products=True).collect()}
    assert rows(("?x", "r", "?x")) == {(("?x", "a"),)}
    assert rows(("?x", "r", "?y"), ("?y", "s", "c")) == {(("?x", "a"), ("?y", "b"))}
    assert len(rows(("?x", "r", "?y"), ("?p", "s", "?q"))) == 4
    with pytest.raises(ValueError, match="shares no variable"):
        join_body([e, e], (("?x", "r", "?y"), ("?p", "s", "?q")))
    rule = Rule("d", (("?x", "r", "?y"),), ("?y", "t", "k"), (("?x", "?y"),))
    assert triples(heads(join_body([e], rule.body), rule)) == {("b", "t", "k")}


def test_rule_typing():
    rel = {"lives": ({"Person"}, {"City"}), "in": ({"City"}, {"Country"}), "knows": ({"*"}, {"*"})}
    ok = lambda *a: ontology.rule_consistent(Rule("x", *a), rel)
    assert ok((("?a", "lives", "?b"),), ("?a", "lives", "?b"))
    assert not ok((("?a", "lives", "?b"), ("?b", "lives", "?c")), ("?a", "knows", "?c"))
    assert not ok((("?a", "lives", "?b"),), ("?b", "lives", "?a"))
    assert not ok((("?a", "knows", "?b"),), ("?a", "lives", "?b"))
    assert not ok((("?a", "unknown", "?b"),), ("?a", "knows", "?b"))
    assert ontology.rule_consistent(Rule("x", (("?a", "z", "?b"),), ("?a", "z", "?b")), {})
