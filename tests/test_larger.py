"""Cases that a larger run found: keys, chains and groups that the smallest tables lack."""

import hashlib
import os

import pytest

from graphloom.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name, folder):
    """Rows of a query and of its SQL on the tables of a folder."""
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"create view {t[:-8]} as select * from '{folder}/{t}{'/*.parquet' if os.path.isdir(f'{folder}/{t}') else ''}'")
    want = con.sql(ORACLE[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, folder).collect()), key=repr)
    return got, sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.fixture
def tables(tmp_path):
    """The smallest tables in a folder of their own, where one can be replaced."""
    for t in os.listdir(SF):
        os.symlink(f"{SF}/{t}", tmp_path / t)
    return tmp_path


def replaced(tables, name, df):
    """A table of the folder with the rows of df in place of its own."""
    (tables / f"{name}.parquet").unlink()
    df.toPandas().to_parquet(tables / f"{name}.parquet", index=False)


def test_warmup_asks_for_a_customer_without_other_edges(spark, tables):
    """Customer 0 is managed by nobody; its nation is held out, so that no edge of it is left to be fitted."""
    held = next(n for n in range(25) if int(hashlib.md5(f"7|C0|lives_in|N{n}".encode()).hexdigest()[:8], 16) / 2**32 >= 0.9)
    c = spark.read.parquet(f"{SF}/customer.parquet")
    replaced(tables, "customer", c.selectExpr("* except (c_nationkey)", f"cast(if(c_custkey = 0, {held}, c_nationkey) as int) as c_nationkey").select(c.columns))
    got, want = same_as_sql(spark, "c2_warmup", str(tables))
    assert got == want


E_ = "src string, rel string, dst string"


def chain(spark, monkeypatch):
    """A chain of 12 edges of either kind, with rounds of steps that end before it does."""
    from graphloom.plans import fixpoint, maintain

    monkeypatch.setattr(fixpoint, "STEPS", 3)
    monkeypatch.setattr(maintain, "STEPS", 3)
    rows = [(f"c{i}", "manages" if i % 3 else "mentors", f"c{i + 1}") for i in range(12)] + [("c2", "mentors", "c4"), ("c4", "mentors", "c5")]
    return rows, spark.createDataFrame(rows, E_)


def pairs(rows, gone=(), without=None):
    """The pairs that the edges left lead to."""
    e = {(s, d) for s, r, d in rows if (s, r, d) not in gone and r != without}
    out = set(e)
    while more := {(a, d) for a, b in out for c, d in e if b == c} - out:
        out |= more
    return sorted(out)


def over(df):
    return sorted(map(tuple, df.filter("rel = 'over'").select("src", "dst").collect()))


def test_facts_deleted_from_a_closure_by_steps(spark, monkeypatch):
    """As many derivations as steps into an end, not as middles; premises of earlier rounds; whatever the length of chains."""
    from graphloom.plans import fixpoint, maintain
    from graphloom.plans.stage import staged
    from graphloom.queries_flow import OVER

    rows, e = chain(spark, monkeypatch)
    closed = staged(fixpoint.closure(e, list(OVER), by_steps=True))
    assert over(closed) == pairs(rows)
    of = {(r.src, r.rel, r.dst): r for r in closed.collect()}
    for r in of.values():
        assert all(of[tuple(p)].round < r.round for p in r.premises or [])
        assert r.rule != "both" or r.round > 3 or of[tuple(r.premises[1])].rule != "both"  # the second premise is a step
    gone = [rows[3], rows[7], rows[12]]
    after = staged(maintain.deleted(closed, list(OVER), spark.createDataFrame(gone, E_)))
    assert over(after) == pairs(rows, gone) and after.count() == after.select("src", "rel", "dst").distinct().count()
    known = {(r.src, r.rel, r.dst): r.round for r in after.collect()}
    assert all(known[tuple(p)] < r.round for r in after.collect() for p in r.premises or [])


def test_rule_retired_from_a_closure_by_steps(spark, monkeypatch):
    """What the retired rule's steps led to goes, but for what others lead to."""
    from graphloom.plans import fixpoint, maintain
    from graphloom.queries_flow import OVER

    rows, e = chain(spark, monkeypatch)
    closed = fixpoint.closure(e, list(OVER), by_steps=True)
    assert over(maintain.deleted(closed, list(OVER), retired=["mentor"])) == pairs(rows, without="mentors")


def test_facts_inserted_into_a_closure_by_steps(spark, monkeypatch):
    """New steps in the middle of long chains."""
    from graphloom.plans import fixpoint, maintain
    from graphloom.queries_flow import OVER

    rows, _ = chain(spark, monkeypatch)
    new = [rows[3], rows[7], rows[12]]
    closed = fixpoint.closure(spark.createDataFrame([r for r in rows if r not in new], E_), list(OVER), by_steps=True)
    more = maintain.inserted(closed, list(OVER), spark.createDataFrame(new, E_))
    assert over(more) == pairs(rows) and more.count() == more.select("src", "rel", "dst").distinct().count()


def test_lineages_go_on_by_steps(spark, monkeypatch):
    """Every cause with all it leads to, on a chain longer than the rounds of steps, with a loop at its end."""
    from graphloom.operators import causal
    from graphloom.plans import fixpoint

    seen = []
    plain = fixpoint._derive
    monkeypatch.setattr(fixpoint, "_derive", lambda *a: seen.append(a[-1]) or plain(*a))
    rows, _ = chain(spark, monkeypatch)
    rows = [(s, "causes", d) for s, _, d in rows] + [("c12", "causes", "c10")]
    got = causal.lineages(spark.createDataFrame(rows, E_).select("src", "dst"))
    assert sorted(map(tuple, got.collect())) == pairs(rows)
    assert seen[:4] == [True, True, True, False]


def test_text_starts_by_a_table_of_signs(spark):
    """No sign is hashed for a row: the projection is there before any text is read."""
    from graphloom.operators import link

    got = link.seeded(spark.createDataFrame([("a", "b c")], "id string, text string"), 2, 8)
    assert "md5" not in got._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("kind", ["complex", "rotate"])
def test_scores_are_written_out(spark, kind):
    """The same scores as those of the plain expression, which is kept for vectors of several lengths and for missing coordinates."""
    import random

    from pyspark.sql import functions as F

    from graphloom.operators import link

    score = {"complex": link.complex_score, "rotate": link.rotate_score}[kind]
    rng = random.Random(3)
    vec = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(f"e{i}", vec(5), vec(5)) for i in range(7)]
    schema = "id string, re array<double>, im array<double>"
    rels = spark.createDataFrame([("r", vec(5), vec(5)), ("s", [0.0] * 5, [0.0] * 5)], schema)
    q = spark.createDataFrame([("q1", "e1", "r"), ("q2", "e2", "s"), ("q3", "none", "r")], "q string, head string, relation string")
    for extra, short in (([], True), ([("x", vec(4), vec(4))], False), ([("x", [None, *vec(4)], vec(5)), ("y", None, vec(5))], False)):
        ents = spark.createDataFrame(rows + extra, schema)
        got = link.scores(q, ents, rels, score=score)
        plain = link.scores(q, ents, rels, ents.select(F.explode(F.array(F.lit("r"), F.lit("s"))).alias("relation"), "id"), score=score)
        key = lambda d: {(r.q, r.head, r.relation, r.tail): None if r.score is None else round(r.score, 9) for r in d.collect()}
        assert key(got) == key(plain) and len(key(got)) == 2 * (6 + len(extra))
        assert ("aggregate(" not in got._jdf.queryExecution().analyzed().toString()) == short


def test_best_tails_by_a_bound(spark):
    """Predictions and temperatures against plain sums, with ties, few tails and many."""
    import math
    import random

    from graphloom.operators import link

    rng = random.Random(4)
    by = {"many": {f"t{i}": rng.randrange(40) / 10 for i in range(300)}, "few": {"a": 1.0, "b": 1.0, "c": -2.0}, "same": {f"s{i}": 0.5 for i in range(70)}}
    s = spark.createDataFrame([(q, t, x) for q, own in by.items() for t, x in own.items()], "q string, tail string, score double")
    got = {r.q: r for r in link.predictions(s, 0.5).collect()}
    for q, own in by.items():
        best = sorted(own, key=lambda t: (-own[t], t))[:5]
        assert got[q].ranking == best and got[q].tail == best[0]
        assert math.isclose(got[q].confidence, 1 / sum(math.exp((x - own[best[0]]) / 0.5) for x in own.values()))
    gold = {"many": "t7", "few": "c"}
    nll = {r.temperature: r.nll for r in link.calibrate(s, spark.createDataFrame(list(gold.items()), "q string, tail string"), [0.5, 2.0]).collect()}
    for t, x in nll.items():
        assert math.isclose(x, sum(math.log(sum(math.exp(v / t) for v in by[q].values())) - by[q][g] / t for q, g in gold.items()) / 2)
    assert len(nll) == 2 and link.BUCKETS > 5


def test_ranks_by_a_condition(spark):
    """Known tails as a condition and as a table give the same ranks."""
    from pyspark.sql import functions as F

    from graphloom.operators import evaluation

    s = spark.createDataFrame([("q", f"{i}", float(i % 7)) for i in range(30)] + [("p", "4", 1.0), ("p", "5", 1.0)], "q string, tail string, score double")
    gold = spark.createDataFrame([("q", "5"), ("q", "3"), ("p", "4"), ("p", "none")], "q string, tail string")
    known = F.col("tail").cast("long") % 10 == 3
    rows = lambda k: sorted(map(tuple, evaluation.filtered_ranks(s, gold, k).collect()))
    assert rows(known) == rows(s.filter(known).select("q", "tail")) and len(rows(known)) == 3


def test_pairs_of_one_nation_are_not_dealt_out_again(spark, tables):
    """Pairs come once where each supplier has one nation, and are made distinct where one has two."""
    distinct = lambda: "Deduplicate" in (p := QUERIES["r5_distinct_guard"](spark, str(tables))._jdf.queryExecution().analyzed().toString()) or "Distinct" in p
    assert not distinct()
    c = spark.read.parquet(f"{SF}/supplier.parquet")
    replaced(tables, "supplier", c.union(c.filter("s_suppkey < 3").selectExpr(*[f"cast((s_nationkey + 1) % 3 as int) as {x}" if x == "s_nationkey" else x for x in c.columns])).union(c.filter("s_suppkey < 4").selectExpr(*[f"cast(1 as int) as {x}" if x == "s_nationkey" else x for x in c.columns])))
    got, want = same_as_sql(spark, "r5_distinct_guard", str(tables))
    assert got == want and distinct()
