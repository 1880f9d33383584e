"""Plans by tables against the search of one question at a time."""

import random

from pyspark.sql import functions as F

from graphloom.operators import frontier, planner
from graphloom.operators.planner import Action
from graphloom.plans.rules import Rule

FACT = "q string, src string, rel string, dst string"
MOVE = Action("move", (("?x", "at", "?a"), ("?a", "road", "?b")), (("?x", "at", "?b"),), (("?x", "at", "?a"),))
FLY = Action("fly", (("?x", "at", "?a"), ("?a", "air", "?b")), (("?x", "at", "?b"),), (("?x", "at", "?a"),), 2.5)
CALL = Action("call", (), (("?w", "is", "called"),), (), 5.0)
RULES = [Rule("home", (("?x", "at", "d"),), ("?x", "is", "home"))]


def found(spark, starts, goals, actions, **kw):
    s = spark.createDataFrame([(q, *f) for q, fs in starts.items() for f in fs], FACT)
    g = spark.createDataFrame([(q, *[None if x.startswith("?") else x for x in p]) for q, ps in goals.items() for p in ps], FACT)
    return {r.q: (r.cost, r.steps) for r in frontier.plans(frontier.starts_of(s), g, actions, **kw).collect()}


def test_plans_are_as_cheap_as_the_search(spark):
    rng = random.Random(4)
    starts, goals = {}, {}
    for q in range(12):
        roads = {(rng.choice("abcd"), rng.choice(["road", "road", "air"]), rng.choice("abcd")) for _ in range(5)}
        starts[f"q{q}"] = sorted(roads | {("me", "at", "a")})
        goals[f"q{q}"] = [("me", "is", "home")] if q % 2 else [("me", "at", "c"), ("?y", "road", "?z")]
    got = found(spark, starts, goals, [MOVE, FLY], rules=RULES, max_depth=3)
    for q, facts in starts.items():
        one = planner.plan(set(facts), goals[q], [MOVE, FLY], max_depth=3, rules=RULES)
        assert (got[q][0] if q in got else None) == (one[0] if one else None), q
        if one:
            assert sum(1.0 if s.startswith("move") else 2.5 for s in got[q][1]) == got[q][0]
    assert 0 < len(got) < 12


def test_bounds_and_free_variables(spark):
    starts = {"far": [("me", "at", "a"), ("a", "road", "b"), ("b", "road", "c")], "here": [("me", "at", "c")]}
    goals = {q: [("me", "at", "c")] for q in starts}
    got = found(spark, starts, goals, [MOVE])
    assert got["here"] == (0.0, []) and got["far"][0] == 2.0 and len(got["far"][1]) == 2
    assert set(found(spark, starts, goals, [MOVE], max_depth=1)) == {"here"}
    extra = spark.createDataFrame([("here", "z")], "q string, entity string")
    called = {"here": [("z", "is", "called")]}
    assert found(spark, {"here": starts["here"]}, called, [CALL], max_depth=1) == {}
    assert found(spark, {"here": starts["here"]}, called, [CALL], max_depth=1, entities=extra) == {"here": (5.0, ["call(z)"])}


def test_actions_are_joins(spark):
    states = spark.createDataFrame([("q", "s")], "q string, state string").withColumn("facts", F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("rel"), F.lit(c).alias("dst")) for a, b, c in (("me", "at", "a"), ("a", "road", "b"), ("a", "road", "c"))]))
    rows = sorted((r["?a"], r["?b"], r["?x"]) for r in frontier.grounded(states, MOVE).collect())
    assert rows == [("a", "b", "me"), ("a", "c", "me")]
    loop = Action("loop", (("?a", "road", "?a"),), ())
    assert frontier.grounded(states, loop).count() == 0
