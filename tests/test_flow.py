"""Merging by any strategy, interval fixpoints, closures kept up to date, streams with state: against brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import cascade, concepts, federation, mining, service, temporal
from graphloom.plans import intervals, maintain
from graphloom.plans.fixpoint import closure
from graphloom.plans.rules import Rule
from graphloom.plans.stage import staged
from graphloom.streaming import state

E = "src string, rel string, dst string"
CHAIN = [Rule("step", (("?x", "r", "?y"),), ("?x", "p", "?y")), Rule("side", (("?x", "s", "?y"),), ("?x", "p", "?y")), Rule("join", (("?x", "p", "?y"), ("?y", "p", "?z")), ("?x", "p", "?z"), (("?x", "?z"),))]


def facts(df):
    return sorted(tuple(r) for r in df.select("src", "rel", "dst").collect())


# strategies


def test_merge_by_any_strategy(spark):
    rng = random.Random(1)
    rows = [(f"a{rng.randrange(6)}", "r", f"b{rng.randrange(3)}", rng.choice("xyz"), rng.random()) for _ in range(200)] + [("hot", "r", "b", "x", i / 5000) for i in range(5000)]
    schema = f"{E}, writer string, trust double"
    a, b = spark.createDataFrame(rows[::2], schema), spark.createDataFrame(rows[1::2], schema)
    by = {}
    for s, r, d, w, t in rows:
        by.setdefault((s, r, d), []).append((w, t))
    want = lambda f: sorted((*k, len(v), len({w for w, _ in v})) for k, v in by.items() if f([t for _, t in v]))
    got = lambda s: sorted(map(tuple, federation.merge(a, b, s).collect()))
    assert got(lambda records: next(iter(records)) is not None) == want(bool)  # a predicate may stop early
    assert got(lambda records: sum(r["trust"] for r in records) > 4) == want(lambda t: sum(t) > 4)
    mean = federation.Fold(lambda: (0, 0.0), lambda s, r: (s[0] + 1, s[1] + r["trust"]), lambda s, t: (s[0] + t[0], s[1] + t[1]), lambda s: s[1] / s[0] > 0.5)
    assert got(mean) == want(lambda t: sum(t) / len(t) > 0.5)
    assert federation.merge(a.limit(0), b.limit(0), mean).count() == 0


# intervals


def test_interval_closure_is_the_closure_of_every_slice(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(40):
        s = rng.choice([None, *range(10)])
        e = rng.choice([None, *range(1, 12)])
        rows.append((f"n{rng.randrange(8)}", rng.choice("rs"), f"n{rng.randrange(8)}", None if s is None else float(s), None if e is None else float(e)))
    edges = spark.createDataFrame(rows, f"{E}, valid_from double, valid_to double")
    got = staged(intervals.interval_closure(edges, CHAIN))
    for t in (-5.0, 0.0, 5.5, 11.0):
        assert facts(temporal.slice_at(got, t)) == facts(closure(temporal.slice_at(edges, t), CHAIN)), t
    again = got.groupBy("src", "rel", "dst").agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to"))).alias("x")).collect()
    for r in again:  # coalesced: a gap between any two
        assert all(a.valid_to is not None and b.valid_from is not None and a.valid_to < b.valid_from for a, b in zip(r.x, r.x[1:]))
    assert intervals.interval_closure(edges.limit(0), CHAIN).count() == 0


def test_history_plan_does_not_grow(spark):
    edges = spark.createDataFrame([("a", "r", "b", 0.0, 10.0), ("b", "r", "c", 5.0, None)], f"{E}, valid_from double, valid_to double")
    asked = spark.createDataFrame([("a", "p")], "head string, relation string")
    for n in (2, 20):
        h = temporal.history(edges, CHAIN, asked, spark.range(n).select(F.col("id").cast("double").alias("instant")))
        assert {r.instant: r.answers for r in h.collect()} == {float(t): (["b", "c"] if t >= 5 else ["b"]) if t < 10 else [] for t in range(n)}


# maintenance


@pytest.mark.parametrize("seed", [1, 2])
def test_maintenance_equals_a_closure_from_scratch(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(f"n{rng.randrange(12)}", rng.choice("rs"), f"n{rng.randrange(12)}") for _ in range(30)} | {("n1", "p", "n2"), ("lone", "q", "x")})
    edges = spark.createDataFrame(rows, E)
    closed = staged(closure(edges, CHAIN))
    away = rng.sample(rows, 5) + [("n1", "p", "n2")]
    left = [r for r in rows if r not in away]
    gone, kept = spark.createDataFrame(away, E), spark.createDataFrame(left, E)
    want = facts(closure(kept, CHAIN))
    after = staged(maintain.deleted(closed, CHAIN, gone))
    assert facts(after) == want
    known = {(r.src, r.rel, r.dst): r.round for r in after.collect()}
    for r in after.collect():  # proofs stay sound: premises are there, from earlier rounds
        assert all(known[tuple(p)] < r.round for p in r.premises or [])
    assert facts(maintain.deleted(closed, CHAIN, retired=["side"])) == facts(closure(edges, [c for c in CHAIN if c.name != "side"]))
    assert facts(maintain.inserted(after, CHAIN, gone)) == facts(closed)


def test_service_keeps_its_closure(spark):
    """Facts told, forgotten and told again: always the closure of what is there."""
    rows = [("a", "r", "b"), ("b", "r", "c"), ("a", "s", "c"), ("c", "r", "d")]
    edges = spark.createDataFrame(rows, E)
    s = service.Service(cascade.Session(edges, CHAIN, None, learn=False), spark.createDataFrame([(x, "T") for x in "abcde"], "id string, type string"), spark.createDataFrame([], "name string"))
    s.session.warmup()
    s.distill(spark.createDataFrame([("d", "r", "e")], E))
    assert ("a", "p", "e") not in facts(s.session.closed)
    s.forget(spark.createDataFrame([("b", "r", "c")], E))
    left = spark.createDataFrame([x for x in rows if x[0] != "b"] + [("d", "r", "e")], E)
    assert facts(s.session.closed) == facts(closure(left, CHAIN)) and ("a", "p", "e") in facts(s.session.closed)
    assert facts(s.session.facts) == facts(left)


def test_untouched_facts_are_not_deleted(spark):
    """What goes is bounded by what rests on the deleted fact."""
    edges = spark.createDataFrame([(f"c{i}", "r", f"c{i + 1}") for i in range(10)] + [("x", "r", "y"), ("y", "r", "z")], E)
    closed = staged(closure(edges, CHAIN))
    assert facts(maintain.overdeleted(closed, spark.createDataFrame([("x", "r", "y")], E))) == [("x", "p", "y"), ("x", "p", "z"), ("x", "r", "y")]


# streams


def test_shadow_stream_across_a_restart(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"rule{rng.randrange(4)}", i, f"h{rng.randrange(9)}", rng.random() > 0.1) for i in range(300)] + [("fine", 400 + i, f"h{i % 4}", True) for i in range(9)] + [("bad", 350, "h", False), ("young", 500, "h", True)]
    schema = "rule string, idx long, head string, agrees boolean"
    batch = sorted(map(tuple, mining.shadow(spark.createDataFrame(rows, schema)).collect()))
    rng.shuffle(rows)
    source, folder = str(tmp_path / "in"), f"file://{tmp_path}/run"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    for part in (rows[:100], rows[100:200] + rows[:50], rows[200:]):  # some rows come twice
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(source)
        got = state.shadow_run(stream(), folder)
    assert sorted(map(tuple, got.collect())) == batch
    assert {r[1] for r in batch} >= {"promoted", "demoted", "shadow"}


def test_feedback_stream_and_late_verdicts(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda m: t0 + datetime.timedelta(minutes=m)
    asks = [(i, f"u{i % 3}", at(10 * i)) for i in range(30)]
    says = [(f"u{i % 3}", i % 2 == 0, at(10 * i + 25)) for i in range(30)]
    a, v = "id long, head string, ts timestamp", "head string, correct boolean, said_at timestamp"
    paths = [str(tmp_path / x) for x in ("asks", "says")]
    run = lambda: state.marked_run(spark.readStream.schema(a).parquet(paths[0]), spark.readStream.schema(v).parquet(paths[1]), f"file://{tmp_path}/run")
    for rows, schema, path in ((asks, a, paths[0]), (says, v, paths[1])):
        spark.createDataFrame(rows, schema).write.parquet(path)
    got, late = run()
    batch = state.marked(spark.createDataFrame(asks, a), spark.createDataFrame(says, v))
    assert late == 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    spark.createDataFrame([(99, "u0", at(600))], a).write.mode("append").parquet(paths[0])
    spark.createDataFrame([("u0", True, at(610))], v).write.mode("append").parquet(paths[1])
    run()
    spark.createDataFrame([("u1", True, at(20))], v).write.mode("append").parquet(paths[1])  # ten hours too late
    again, late = run()
    assert late == 1 and again.count() == batch.count() + 1


# concepts


def test_concepts_of_many_attributes(spark):
    """Seventy attributes, two words of bits; against all meets of object intents."""
    rng = random.Random(8)
    objects = {f"o{i}": frozenset(rng.sample(range(70), rng.choice([1, 4, 12, 40]))) for i in range(14)}
    objects |= {"same": objects["o3"], "most": frozenset(range(69))}
    inc = spark.createDataFrame([(o, a) for o, s in objects.items() for a in s], "obj string, attr int")
    attrs = spark.createDataFrame([(a,) for a in range(70)], "attr int")
    intents = set(objects.values())
    while more := {a & b for a in intents for b in objects.values()} - intents:
        intents |= more
    intents.add(frozenset(range(70)))
    want = {i: sum(i <= s for s in objects.values()) for i in intents}
    found = concepts.concept_sizes(inc, attrs)
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    got = [(frozenset(r.intent), r.n) for r in found.collect()]
    assert len(got) == len(want) and dict(got) == want
    below = {(l, u) for l in intents for u in intents if u < l}
    covers = {(l, u) for l, u in below if not any((l, m) in below and (m, u) in below for m in intents)}
    assert {(frozenset(r.lower), frozenset(r.upper)) for r in concepts.lattice_edges(inc, attrs).collect()} == covers
    assert {frozenset(r.intent): frozenset(r.extent) for r in concepts.concepts(inc, attrs).collect()} == {i: frozenset(o for o, s in objects.items() if i <= s) for i in intents}
    assert concepts.concept_sizes(inc.limit(0), attrs).collect()[0].n == 0
