"""Operators on the small cases of the blueprint."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import cascade, causal, concepts, episodes, evaluation, federation, graph, link, mining, ontology, planner, temporal
from graphloom.operators.planner import Action
from graphloom.plans.rules import Rule
from graphloom.sources import graphs as S
from graphloom.streaming import dashboards

E = "src string, rel string, dst string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# graph and sources


def test_upserts(spark):
    log = spark.createDataFrame([(1, "a", "Person", {"x": "1"}), (2, "a", "Entity", {"x": "2", "y": "3"}), (3, "b", "Entity", None)], "seq int, id string, type string, props map<string,string>")
    got = {r.id: (r.type, r.props) for r in graph.upsert_nodes(log).collect()}
    assert got == {"a": ("Person", {"x": "2", "y": "3"}), "b": ("Entity", None)}
    e = spark.createDataFrame([(1, "a", "r", "b", {"p": "1"}), (2, "a", "r", "b", {"p": "2", "q": "3"})], f"seq int, {E}, props map<string,string>")
    assert [r.props for r in graph.upsert_edges(e).collect()] == [{"p": "2", "q": "3"}]
    nodes, edges = graph.from_triples(e, spark.createDataFrame([("a", "Person")], "id string, type string"))
    assert rows(nodes) == [("a", "Person"), ("b", "Entity")] and edges.count() == 1
    assert rows(graph.endpoints(nodes.filter("id = 'a'"), edges)) == rows(nodes)


def test_degree_counts_neighbours(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("a", "s", "b"), ("b", "r", "a"), ("c", "r", "a")], E)
    assert dict(rows(graph.degree(e))) == {"a": 3, "b": 2, "c": 1}
    assert rows(graph.outgoing(e, e.select(F.lit("a").alias("id")))) == [("a", "b")]


def test_files(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"name": "g", "nodes": [{"id": "a", "type": "T", "props": {"k": "v"}}, {"id": "b"}], "edges": [{"source": "a", "relation": "r", "target": "b"}]}')
    nodes, edges = S.read_json(spark, str(tmp_path / "g.json"))
    assert rows(nodes.select("id", "type")) == [("a", "T"), ("b", "Entity")] and rows(edges.select("src", "rel", "dst")) == [("a", "r", "b")]
    S.write_json(nodes, edges, str(tmp_path / "out"))
    again, _ = S.read_json(spark, str(tmp_path / "out"))
    assert rows(again.select("id", "type")) == rows(nodes.select("id", "type"))
    (tmp_path / "t.txt").write_text("# no\n\na\tr\tb\textra\nshort\tline\n c \tr\td\n")
    assert rows(S.read_triples(spark, str(tmp_path / "t.txt"))) == [("a", "r", "b"), ("c", "r", "d")]
    (tmp_path / "kb.txt").write_text("m|directed by|p\n")
    assert rows(S.read_kb(spark, str(tmp_path / "kb.txt"))) == [("m", "directed by", "p")]
    (tmp_path / "e.csv").write_text("source,relation,target\na,r,b\na,r,b\n")
    assert rows(S.read_csv(spark, str(tmp_path / "e.csv"))) == [("a", "r", "b")]
    (tmp_path / "qa.txt").write_text("who made [The Film]\tann|bob||\n")
    assert rows(S.read_questions(spark, str(tmp_path / "qa.txt"))) == [("who made [The Film]", "The Film", ["ann", "bob"])]
    S.write_tables(nodes, edges, str(tmp_path / "tables"))
    n2, e2 = S.read_tables(spark, str(tmp_path / "tables"))
    assert n2.count() == 2 and rows(e2.select("src", "rel", "dst")) == [("a", "r", "b")]
    S.save_state(str(tmp_path / "state"), edges, "[]")
    back = S.load_state(spark, str(tmp_path / "state"))
    assert back["edges"].count() == 1 and back["rules"] == "[]" and back["nodes"] is None and back["episodes"] is None
    S.save_state(str(tmp_path / "state"), edges, "[]", nodes, nodes)
    back = S.load_state(spark, str(tmp_path / "state"))
    assert rows(back["nodes"].select("id", "type")) == rows(nodes.select("id", "type")) and rows(back["episodes"].select("id", "type")) == rows(nodes.select("id", "type"))
    for s in ("train", "valid", "test"):
        (tmp_path / f"{s}.txt").write_text("a\tr\tb\n" * (2 if s == "train" else 1))
    assert rows(S.dataset_stats(S.read_splits(spark, str(tmp_path)))) == [(2, 1, 2, 1, 1)]
    (tmp_path / "half").mkdir()
    (tmp_path / "half" / "valid.txt").write_text("a\tr\tb\n")
    with pytest.raises(FileNotFoundError, match="train.txt, test.txt"):
        S.read_splits(spark, str(tmp_path / "half"))


def test_arrow_and_theories(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"a": [1, 2], "b": [["x"], []]})
    for name, writer in (("f", pa.ipc.new_file), ("s", pa.ipc.new_stream)):
        with pa.OSFile(str(tmp_path / name), "wb") as f, writer(f, t.schema) as w:
            w.write_table(t)
        assert rows(S.read_arrow(spark, str(tmp_path / name), "b array<string>, a long")) == [(["x"], 1), ([], 2)]
    cases = spark.createDataFrame([("c1", [" A", "a", None, ""], None), ("c2", [], ["b", "A "])], "case_id string, x array<string>, y array<string>")
    assert rows(S.case_slots(cases, ["x", "y"])) == [("c1", "x", "a"), ("c1", "y", "none"), ("c2", "x", "none"), ("c2", "y", "a"), ("c2", "y", "b")]
    (tmp_path / "p.jsonl").write_text(
        r'{"id": "t1", "triples": {"a": {"representation": "(\"bob\" \"is\" \"kind\" \"+\")"}}, "rules": {"r": {"representation": "(((\"someone\" \"is\" \"kind\" \"+\")) -> (\"someone\" \"is\" \"nice\" \"+\"))"}}, "questions": {"q": {"question": "?", "representation": "(\"bob\" \"is\" \"nice\" \"-\")", "answer": false, "QDep": 1}}}' + "\n"
        r'{"id": "t2", "triples": {}, "rules": {"r": {"representation": "(((\"x\" \"is\" \"kind\" \"~\")) -> (\"x\" \"is\" \"nice\" \"+\"))"}}, "questions": {}}' + "\n"
    )
    a, b = sorted(S.read_theories(spark, str(tmp_path / "p.jsonl")).collect(), key=lambda r: r.id)
    assert a.expressible and not b.expressible
    assert [tuple(x) for x in a.facts] == [("bob", "is", "kind", True)]
    assert tuple(a.rules[0].head) == ("?x", "is", "nice", True) and a.rules[0].body[0].s == "?x"
    assert tuple(a.questions[0].atom) == ("bob", "is", "nice", False) and a.questions[0].answer is False


def test_zipf_favours_low_ranks(spark):
    pool = spark.range(1, 11).select(F.col("id").alias("rank"), F.col("id").cast("string").alias("item"))
    n = {r.item: r["count"] for r in S.zipf(pool, 2000).groupBy("item").count().collect()}
    assert sum(n.values()) == 2000 and n["1"] > n["2"] > n["5"]


# time


def test_slices_and_history(spark):
    e = spark.createDataFrame([("eve", "works_at", "acme", 2018.0, 2021.0), ("eve", "works_at", "zoot", 2021.0, 2024.0), ("eve", "works_at", "ever", 2024.0, None), ("acme", "part_of", "x", None, None)], f"{E}, valid_from double, valid_to double")
    at = lambda t: {r.dst for r in temporal.slice_at(e, t).filter("rel = 'works_at'").collect()}
    assert (at(2019.0), at(2021.0), at(2030.0)) == ({"acme"}, {"zoot"}, {"ever"})
    assert {r.dst for r in temporal.slice_between(e, 2020.0, 2023.0).collect()} == {"acme", "zoot", "x"}
    rule = [Rule("w", (("?p", "works_at", "?c"), ("?c", "part_of", "?g")), ("?p", "works_for", "?g"))]
    w = spark.createDataFrame([("eve", "works_for")], "head string, relation string")
    times = spark.createDataFrame([(2019.0,), (2022.0,)], "instant double")
    for bucket in (None, 2.0):
        got = {r.instant: r.answers for r in temporal.history(e, rule, w, times, bucket).collect()}
        assert got == {2019.0: ["x"], 2022.0: []}
    assert temporal.query_at(e, rule, w, 2019.0).first().answers == ["x"]
    assert temporal.query_during(e, rule, w, 2015.0, 2018.5).first().answers == ["x"]


def test_allen(spark):
    cases = [((1, 3), (2, 4), "overlaps"), ((2, 3), (1, 4), "during"), ((1, 2), (3, 4), "before"), ((5, 6), (3, 4), "after"), ((1, 2), (2, 3), "meets"), ((1, 2), (1, 2), "equal"), ((1, 2), (1, 3), "starts"), ((1, 3), (1, 2), "started_by"), ((2, 3), (1, 3), "finishes"), ((1, 3), (2, 3), "finished_by"), ((1, 4), (2, 3), "contains"), ((2, 4), (1, 3), "overlapped_by"), ((2, 3), (1, 2), "met_by"), ((None, 2), (1, 3), "overlaps"), ((1, None), (1, None), "equal")]
    df = spark.createDataFrame([(*map(lambda x: None if x is None else float(x), (*a, *b)), want) for a, b, want in cases], "a double, b double, c double, d double, want string")
    assert df.filter(temporal.allen(*[F.col(c) for c in "abcd"]) != F.col("want")).count() == 0


# ontology


def test_gates(spark):
    nodes = spark.createDataFrame([("a", "P", {"name": "x"}), ("b", "P", {}), ("c", "C", None)], "id string, type string, props map<string,string>")
    rel = spark.createDataFrame([("lives", ["P"], ["C"], False, False, True, None), ("knows", ["*"], ["*"], True, False, False, None)], ontology.RELATION_SCHEMA)
    edges = spark.createDataFrame([("a", "lives", "c"), ("a", "likes", "b"), ("b", "lives", "a"), ("b", "lives", "c")], E)
    kinds = rows(ontology.validate(nodes, edges, rel, spark.createDataFrame([("P", ["name"])], "name string, required_props array<string>")))
    assert kinds == [("domain_range", "b lives a"), ("functional", "b lives"), ("missing_property", "b name"), ("unknown_relation", "a likes b")]
    c = spark.createDataFrame([("a", "lives", "c"), ("a", "lives", "d"), ("c", "lives", "c"), ("a", "knows", "c"), ("a", "likes", "c")], E)
    assert {(r.src, r.rel, r.dst): r.allowed for r in ontology.allows(c, nodes, edges, rel).collect()} == {("a", "lives", "c"): True, ("a", "lives", "d"): False, ("c", "lives", "c"): False, ("a", "knows", "c"): True, ("a", "likes", "c"): False}
    got = {r.name: r for r in ontology.induce(nodes, spark.createDataFrame([("a", "k", "b"), ("b", "k", "a"), ("a", "m", "c"), ("b", "m", "c"), ("a", "l", "b"), ("a", "l", "c")], E)).collect()}
    assert got["k"].symmetric and not got["k"].functional and got["m"].functional and not got["l"].functional and got["m"].domain == ["P"]
    new = ontology.type_new_ends(spark.createDataFrame([("n", "lives", "m"), ("z", "knows", "z")], E), nodes, rel)
    assert rows(new) == [("m", "C"), ("n", "P"), ("z", "Entity")]


# mining


def chain_graph(spark, extra=()):
    e = [(f"x{i}", "R1", f"y{i}") for i in range(10)] + [(f"x{i}", "target", f"y{i}") for i in range(10)]
    e += [(f"a{i}", "R2", f"b{i}") for i in range(10)] + [(f"b{i}", "R3", f"c{i}") for i in range(10)] + [(f"a{i}", "target2", f"c{i}") for i in range(10)]
    return spark.createDataFrame([*e, *e[:5], *extra], E)


def test_mining(spark):
    g = chain_graph(spark)
    assert ("target<=R1", 10, 1.0) in [(r.name, r.support, r.confidence) for r in mining.mine(g, "target").collect()]
    assert ("target2<=R2.R3", 10, 1.0) in [(r.name, r.support, r.confidence) for r in mining.mine(g, "target2").collect()]
    more = chain_graph(spark, [("x99", "R1", "y99")])
    names = lambda o: [r.name for r in mining.mine(more, "target", options=o).collect()]
    assert "target<=R1" not in names(mining.Mining()) and "target<=R1" in names(mining.Mining(confidence_percent=90))
    heads = spark.createDataFrame([(f"x{i}",) for i in range(10)], "id string")
    row = next(r for r in mining.mine(more, "target", heads).collect() if r.name == "target<=R1")
    assert row.confidence == 1.0
    rule = mining.to_rule(row, "target")
    assert mining.world_precision(rule, more).first().precision == pytest.approx(10 / 11)
    assert mining.mine(g, "absent").collect() == []


def test_amie(spark):
    e = [(f"a{i}", "manages", f"b{i}") for i in range(20)] + [(f"b{i}", "manages", f"c{i}") for i in range(20)] + [(f"a{i}", "indirect", f"c{i}") for i in range(20)]
    r = mining.amie(spark.createDataFrame(e, E)).collect()
    assert [(x.body1, x.body2, x.head, x.support, x.pca_confidence) for x in r] == [("manages", "manages", "indirect", 20, 1.0)]


def test_case_rules(spark):
    cases = [(i, {"a", "b"} if i < 10 else {"a"} if i < 20 else {"c", "b"}) for i in range(30)]
    atoms = spark.createDataFrame([(i, x) for i, s in cases for x in s], "case_id int, atom string")
    targets = spark.createDataFrame([(i, "no" if s == {"a", "b"} else "yes") for i, s in cases], "case_id int, target string")
    got = {(tuple(r.pattern), r.target) for r in mining.mine_cases(atoms, targets).collect()}
    assert got == {(("a", "b"), "no"), (("c",), "yes")}


def test_gates_and_shadow(spark):
    log = [("p", i, i, True) for i in range(3)] + [("d", 0, 0, True), ("d", 1, 1, False), ("d", 2, 2, True), ("d", 3, 3, True)] + [("s", 0, 0, True), ("s", 1, 0, True), ("s", 2, 0, True)]
    got = {r.rule: (r.state, r.at) for r in mining.shadow(spark.createDataFrame(log, "rule string, idx int, head int, agrees boolean")).collect()}
    assert got == {"p": ("promoted", 2), "d": ("demoted", 1), "s": ("shadow", None)}
    s = spark.createDataFrame([("h", "r", i, a) for i, a in enumerate((["x", "x"], ["x", "y"], ["z"]))], "head string, relation string, sample int, answers array<string>")
    assert mining.majority(s, 3).first().answers == ["x"]
    d = spark.createDataFrame([(0.95, 0.95, 0.96), (0.5, 0.9, 0.9), (0.95, 0.5, 0.99), (0.95, None, 0.9), (0.95, 0.88, 0.2)], "f double, c double, k double")
    assert [r[0] for r in d.select(mining.admission(F.col("f"), F.col("c"), F.col("k"))).collect()] == ["admit", "not_candidate", "reject_leak", "undecided", "hold"]
    g = spark.createDataFrame([(0.55, 0.5), (0.54, 0.1), (0.9, 0.6)], "c double, r double")
    assert [r[0] for r in g.select(mining.gate(F.col("c"), F.col("r"))).collect()] == [True, False, False]


def test_concepts(spark):
    e = [("alice", "works", "acme"), ("alice", "speaks", "en"), ("bob", "works", "acme"), ("bob", "works", "zoot"), ("bob", "speaks", "en"), ("carol", "works", "acme"), ("carol", "works", "zoot"), ("carol", "speaks", "fr")]
    attrs, inc = concepts.context(spark.createDataFrame(e, E))
    found = concepts.concepts(inc, attrs)
    assert sorted(map(tuple, (r.extent for r in found.collect()))) == [(), ("alice", "bob"), ("alice", "bob", "carol"), ("bob",), ("bob", "carol"), ("carol",)]
    assert concepts.lattice_edges(inc, attrs).count() == 7
    first = attrs.filter("attr = 0").first()
    assert (first.rel, first.dst, first.n) == ("works", "acme", 3)
    assert rows(concepts.objects_of(inc, [0, 1])) == rows(inc.filter("attr = 1").select("obj"))
    assert concepts.attributes_of(inc, attrs, inc.filter("obj = 'bob'").select("obj")).count() == 3
    assert concepts.attributes_of(inc, attrs, inc.limit(0).select("obj")).count() == 4
    assert concepts.elbow([100.0, 50.0, 45.0, 44.0]) == 2


# cascade, episodes, evaluation


def test_session_learns(spark):
    base = [(f"o{i}", "placed_by", f"c{i % 5}") for i in range(40)] + [(f"c{i}", "lives_in", f"n{i % 3}") for i in range(5)]
    calls = []

    def teacher(h, r):
        return [f"n{int(h[1:]) % 5 % 3}"]

    s = cascade.Session(spark.createDataFrame(base, E), [], teacher)
    ask = lambda a, b: s.ask(spark.createDataFrame([(i, f"o{i}", "nation_of") for i in range(a, b)], "idx int, head string, relation string")).collect()
    first = ask(0, 12)
    assert {r.tier for r in first} == {3} and all(r.answers == teacher(r.head, "") for r in first)
    assert {r.tier for r in ask(0, 12)} == {1}
    later = ask(12, 40)
    assert {r.tier for r in later} == {1} and all(r.answers == teacher(r.head, "") for r in later)
    assert "nation_of<=placed_by.lives_in" in {r.name for r in s.rules} and not calls


def test_tiers(spark):
    w = spark.createDataFrame([(1, "a", "r"), (2, "b", "r"), (3, "c", "r"), (4, "d", "r")], "idx int, head string, relation string")
    from graphloom.plans.fixpoint import closure

    closed = closure(spark.createDataFrame([("a", "r", "x")], E), [])
    p = spark.createDataFrame([("b", "r", "y", 0.7, True), ("c", "r", "y", 0.7, False), ("a", "r", "z", 0.99, True)], "head string, relation string, tail string, confidence double, allowed boolean")
    t = spark.createDataFrame([("c", "r", ["q"]), ("d", "r", [])], "head string, relation string, answers array<string>")
    got = {r.head: (r.tier, r.answers, r.cost) for r in cascade.ask(w, closed, p, t).collect()}
    assert got == {"a": (1, ["x"], 0.0001), "b": (2, ["y"], 0.001), "c": (3, ["q"], 0.05), "d": (0, [], 0.05)}


def test_costs_raise_without_price(spark):
    u = spark.createDataFrame([("m", 1000, 1000, 500, False, None, None), ("m", 1, 1, 1, True, 0.5, 7), ("m", 0, 0, 0, True, None, 10**10)], "model string, prompt_tokens long, completion_tokens long, reasoning_tokens long, reasoning_included_in_completion boolean, cost double, cost_in_usd_ticks long")
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, prompt_per_1k double, completion_per_1k double")
    assert sorted(r.usd for r in cascade.costs(u, prices).collect()) == [0.5, 1.0, 4.0]
    with pytest.raises(Exception, match="no price"):
        cascade.costs(u.withColumn("model", F.lit("k")), prices).filter("cost is null").collect()


def test_trust(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (0, 0)], "p int, n int")
    assert [round(r[0], 6) for r in df.select(episodes.trust(F.col("p"), F.col("n"))).collect()] == [round(2 / 3, 6), 0.0, 0.5]


def test_measures(spark):
    p = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.9, 0), (0.9, 0)], "p double, label int")
    assert evaluation.calibration_error(p).first().ece == pytest.approx(0.65)
    s = spark.createDataFrame([("q", str(i), x) for i, x in enumerate((0.1, 0.9, 0.5, 0.2, 0.8))], "q string, tail string, score double")
    gold = spark.createDataFrame([("q", "2")], "q string, tail string")
    rank = lambda k: evaluation.filtered_ranks(s, gold, spark.createDataFrame([("q", x) for x in k], "q string, tail string")).first()["rank"]
    assert (rank(["4"]), rank([])) == (2, 3)
    lo, hi = evaluation.wilson(F.col("k"), F.col("n"))
    assert tuple(spark.createDataFrame([(0.0, 0.0)], "k double, n double").select(lo, hi).first()) == (0.0, 0.0)
    c = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 0.0), ("b", 0.0, 0.0), ("b", 1.0, 0.1)], "g string, x double, y double")
    assert {r.g: r.x for r in evaluation.crossing(c, 0.25, ["g"]).collect()} == {"a": 0.75, "b": None}
    b = evaluation.bootstrap(spark.createDataFrame([(i, float(i % 2)) for i in range(50)], "i long, v double"), 200).first()
    assert b.low < b.mean == 0.5 < b.high
    t = evaluation.t_summary(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "k string, v double"), "v", ["k"])
    assert {r.k: round(r.half_width, 3) for r in t.collect()} == {"a": 12.706, "b": 0.0}


def test_proof_metrics(spark):
    from graphloom.plans.fixpoint import answers, closure, grounded

    e = spark.createDataFrame([("a", "parent", "b"), ("b", "parent", "c")], E)
    rules = [Rule("base", (("?x", "parent", "?y"),), ("?x", "ancestor", "?y")), Rule("step", (("?x", "parent", "?y"), ("?y", "ancestor", "?z")), ("?x", "ancestor", "?z"))]
    closed = closure(e, rules)
    w = answers(closed, spark.createDataFrame([("a", "ancestor"), ("z", "ancestor")], "head string, relation string"))
    m = evaluation.proof_metrics(w, grounded(closed, e, ["base", "step"])).first()
    assert tuple(m) == (2, 1, 0.5, 1.0)


# links, federation, causal, planner


def test_links(spark):
    triples = [(f"a{i}", "r", f"b{i % 4}") for i in range(24)] + [(f"b{i}", "in", "c") for i in range(4)]
    edges = spark.createDataFrame(triples, E)
    ents, rels = link.fitted(edges, dim=8, rounds=3, passes=60, shard_rows=14)
    q = spark.createDataFrame([(str(i), f"a{i}", "r") for i in range(24)] + [("x", "nobody", "r")], "q string, head string, relation string")
    p = {r.q: r for r in link.predictions(link.scores(q, ents, rels)).collect()}
    assert len(p) == 24 and sum(p[str(i)].tail == f"b{i % 4}" for i in range(24)) >= 20
    assert all(0 < r.confidence <= 1 and len(r.ranking) == 5 for r in p.values())
    more, _ = link.fitted(edges.union(spark.createDataFrame([("new", "r", "b0")], E)), dim=8, rounds=1, start=(ents, rels))
    assert more.count() == ents.count() + 1 and more.filter("id = 'new'").count() == 1
    assert link.fitted(edges.limit(0), dim=4)[0].collect() == []
    one = spark.createDataFrame([([1.0], [2.0], [0.5], [-1.0], [3.0], [1.0])], "a array<double>, b array<double>, c array<double>, d array<double>, e array<double>, f array<double>")
    z = (1 + 2j) * (0.5 - 1j) * (3 - 1j)
    assert one.select(link.complex_score(*[F.col(c) for c in "abcdef"])).first()[0] == pytest.approx(z.real)
    r = (0.5 - 1j) / abs(0.5 - 1j)
    assert one.select(link.rotate_score(*[F.col(c) for c in "abcdef"])).first()[0] == pytest.approx(6 - abs((1 + 2j) * r - (3 + 1j)))


def test_federation(spark):
    s = f"{E}, writer string, trust double"
    a = spark.createDataFrame([("x", "r", "y", "a", 0.9), ("z", "r", "y", "a", 0.3)], s)
    b = spark.createDataFrame([("x", "r", "y", "b", 0.8)], s)
    keep = lambda k: {r.src for r in federation.merge(a, b, k, 0.5).collect()}
    assert (keep("latest_wins"), keep("trust_weighted"), keep("majority")) == ({"x", "z"}, {"x"}, {"x"})
    w = lambda *r: spark.createDataFrame(list(r), "writer string, trust double")
    assert rows(federation.merge_writers(w(("a", 0.1), ("c", 0.2)), w(("a", 0.9)))) == [("a", 0.9), ("c", 0.2)]


def test_causal(spark):
    m = causal.CausalModel()
    flip = lambda ps, u: F.when(u < 0.5, 1).otherwise(0)
    m.add("smoking", (0, 1), (), flip)
    m.add("tar", (0, 1), ("smoking",), lambda p, u: p["smoking"])
    m.add("cancer", (0, 1), ("tar",), lambda p, u: F.when(u < 0.1 + 0.8 * p["tar"], 1).otherwise(0))
    m.add_bidirected("smoking", "cancer")
    assert m.front_door_set("smoking", "cancer") == {"tar"} and m.ancestors("cancer") == {"smoking", "tar"}
    do = {r.value: r.probability for r in m.distribution(spark, "cancer", 4000, do={"smoking": 1}).collect()}
    assert do[1] == pytest.approx(0.9, abs=0.03)
    cf = {r.value: r.n for r in m.counterfactual(spark, {"smoking": 1, "cancer": 1}, {"smoking": 0}, "cancer", 4000).collect()}
    assert cf[0] > cf.get(1, 0)
    with pytest.raises(ValueError):
        m.add("x", (0,), ("later",), flip)
    v = causal.CausalModel()
    v.add("instrument", (0, 1), (), flip)
    v.add("treatment", (0, 1), ("instrument",), flip)
    v.add("outcome", (0, 1), ("treatment",), flip)
    v.add_bidirected("treatment", "outcome")
    assert v.instruments("treatment", "outcome") == ["instrument"] and v.backdoor_set("treatment", "outcome") == {"instrument"}
    assert v.paths("instrument", "outcome") == [["instrument", "treatment", "outcome"]]


def test_causal_fitted(spark):
    """Shares, draws, twins and adjustment sets of a model fitted to a table, against plain counts."""
    import random

    rng = random.Random(3)
    data = []
    for i in range(3000):
        z = rng.choice("abc")
        x = int(rng.random() < {"a": 0.2, "b": 0.5, "c": 0.9}[z])
        data.append((i, z, x, int(rng.random() < 0.1 + 0.5 * x + (0.3 if z == "c" else 0))))
    table = spark.createDataFrame([*data, (3000, None, 1, 1)], "id long, z string, x int, y int")
    m = causal.fitted(table, {"z": (), "x": ("z",), "y": ("x", "z")}, seed="1")
    assert m.variables["z"].domain == ("a", "b", "c") and m.variables["y"].parents == ("x", "z")
    share = lambda keep, hit: sum(map(hit, d := [r for r in data if keep(r)])) / len(d)
    effect = sum(share(lambda r: r[1] == z and r[2] == 1, lambda r: r[3]) * share(lambda r: True, lambda r: r[1] == z) for z in "abc")
    assert m.probability(table, "y", 1, do={"x": 1}).first().probability == pytest.approx(effect, abs=0.04)
    # what changes nothing leaves a row as it was; a rise of x never takes y away where it is more likely so
    same = m.twins(table.dropna(), {}).collect()
    assert len(same) == 3000 and all((r.z, r.x, r.y) == (r.had_z, r.had_x, r.had_y) for r in same)
    had = m.twins(table.dropna(), {"x": 1}).collect()
    assert all(r.had_x == 1 and r.had_z == r.z and r.had_y >= r.y for r in had)
    assert sum(r.had_y for r in had) / 3000 == pytest.approx(effect, abs=0.03)
    odd = spark.createDataFrame([(1, "new", 1, 1)], "id long, z string, x int, y int")
    r = m.twins(odd, {"x": 0}).first()
    assert r.had_z is None and r.had_x == 0 and r.had_y in (0, 1)
    with pytest.raises(ValueError):
        causal.fitted(table.limit(0), {"z": ()})
    e = spark.createDataFrame([("z", "x"), ("z", "y"), ("x", "y"), ("x", "w"), ("w", "y"), ("v", "w")], "src string, dst string")
    assert rows(causal.lineages(e)) == [("v", "w"), ("v", "y"), ("w", "y"), ("x", "w"), ("x", "y"), ("z", "w"), ("z", "x"), ("z", "y")]
    pairs = spark.createDataFrame([("x", "y"), ("w", "y"), ("z", "y")], "x string, y string")
    assert rows(causal.backdoor_sets(e, pairs)) == [("w", "y", "v"), ("w", "y", "x"), ("x", "y", "z")]


def test_teacher_as_table(spark):
    """A table of what is known answers as a function of it does; what it lacks has no answers."""
    known = spark.createDataFrame([("a", "r", ["x", "y"]), ("b", "r", [])], "head string, relation string, tails array<string>")
    asked = spark.createDataFrame([("a", "r"), ("a", "r"), ("b", "r"), ("c", "r")], "head string, relation string")
    told = {"a": ["x", "y"]}
    got = lambda t: sorted((r.head, r.relation, r.answers) for r in cascade.call_teacher(asked, t).collect())
    assert got(known) == got(lambda h, r: told.get(h, [])) == [("a", "r", ["x", "y"]), ("b", "r", []), ("c", "r", [])]


def test_planner():
    move = Action("move", (("?x", "at", "?a"), ("?a", "road", "?b")), (("?x", "at", "?b"),), (("?x", "at", "?a"),))
    start = {("me", "at", "a"), ("a", "road", "b"), ("b", "road", "c")}
    cost, steps = planner.plan(start, [("me", "at", "c")], [move])
    assert cost == 2 and len(steps) == 2
    assert planner.plan(start, [("me", "at", "d")], [move]) is None
    assert planner.plan(start, [("me", "at", "c")], [move], max_depth=1) is None
    paint = Action("paint", (("?x", "at", "?a"),), (("?a", "colour", "?c"),))
    assert planner.plan(start, [("a", "colour", "b")], [paint])[0] == 1


# text and windows


def test_redaction(spark):
    d = spark.createDataFrame([(1, "Email a@x.com or b@y.org for details."), (2, "nothing"), (3, "card 4785 3805 9239 1139 and ssn 123-45-6789"), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in text.redacted(d).collect()}
    assert got[1].text == "Email <EMAIL_1> or <EMAIL_2> for details." and got[1].n_email == 2
    assert got[2].text == "nothing" and got[4].text is None
    assert got[3].text == "card <CC_1> and ssn <SSN_1>"


def test_extraction_and_replies(spark):
    d = spark.createDataFrame([(1, "Ann works at Acme. bob WORKS AT Zoot")], "doc_id int, text string")
    assert [(r.src, r.rel, r.dst) for r in text.extracted(d, [(r"(\w+) works at (\w+)", "works_at")]).collect()] == [("Ann", "works_at", "Acme"), ("bob", "works_at", "Zoot")]
    raw = ['["a", "b"]', '```json\n["a"]\n```', 'sure: ["x", "y"]!', '{"answers": ["q"], "n": 1}', '{"a": ["q"], "b": ["r"]}', "none", ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "raw string").select(text.json_list(F.col("raw"))).collect()]
    assert got == [["a", "b"], ["a"], ["x", "y"], ["q"], [], [], []]
    v, a = text.compliance(F.col("x"))
    c = spark.createDataFrame([(["Prohibit", "Article 6", "art6(1)", "ART 17"],), (["hm"],), ([],)], "x array<string>")
    assert [tuple(r) for r in c.select(v, a).collect()] == [("prohibit", ["art17", "art6"]), ("abstain", []), ("abstain", [])]


def test_hash_encoder(spark):
    d = spark.createDataFrame([(1, "Ab ab"), (2, ""), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.v for r in text.hash_encoded(d, 8).collect()}
    assert got[1][(97 + 98) % 8] == 1.0 and sum(got[1]) == 1.0 and got[2] == got[3] == [0.0] * 8


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    log = spark.range(100).select(F.col("id").alias("idx"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("ts"), (F.col("id") % 3 + 1).cast("int").alias("tier"), F.lit(0.5).alias("cost"))
    log.write.parquet(src)
    stream = spark.readStream.schema(log.schema).parquet(src)
    dashboards.to_table(stream, str(tmp_path / "out"), str(tmp_path / "c1"), ["idx"]).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    q = dashboards.by_tier(stream).writeStream.format("memory").queryName("tiers").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("tiers").agg(F.sum("n")).first()[0] == 100
    assert rows(spark.table("tiers").select("start", "tier", "n")) == rows(dashboards.by_tier(log).select("start", "tier", "n"))
    q = dashboards.quantiles(dashboards.histogram(spark.createDataFrame([(1, 80.0)] * 50 + [(1, 700.0)] * 50, "tier int, latency_ms double")))
    assert {r.q: r.seconds for r in q.collect()} == {0.5: pytest.approx(0.1), 0.95: pytest.approx(0.95), 0.99: pytest.approx(0.99)}


def test_ask_stream(spark, tmp_path):
    w = spark.createDataFrame([(i, f"h{i % 3}", "r") for i in range(9)], "idx int, head string, relation string")
    w.write.parquet(str(tmp_path / "in"))
    s = cascade.Session(spark.createDataFrame([("h0", "r", "t")], E), [], lambda h, r: [f"{h}!"])
    stream = spark.readStream.schema(w.schema).parquet(str(tmp_path / "in"))
    dashboards.ask_stream(stream, s, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 9 and {r.head: r.answers for r in got} == {"h0": ["t"], "h1": ["h1!"], "h2": ["h2!"]}
    assert not math.isnan(got[0].cost)


def test_trained_covers_all_edges(spark):
    """k2 predicts for each source of its relations."""
    from graphloom import queries

    d = "/root/testdata/sf0.001"
    heads = {r.src for r in queries.kg(spark, d, "part_of", "lives_in").select("src").distinct().collect()}
    assert {r.q for r in queries.k2_trained(spark, d).select("q").collect()} == heads


# what the later queries don't show


def test_answer_log(spark, tmp_path):
    from graphloom.sources.answers import AnswerLog

    rows_ = lambda *h: spark.createDataFrame([(x, "r", [x], 0.1) for x in h], "head string, relation string, answers array<string>, cost double")
    book = AnswerLog(spark, str(tmp_path / "log"), {"model": "m"})
    assert book.read().collect() == []
    book.append(0, rows_("a"))
    book.append(1, rows_("b", "c"))
    (tmp_path / "log" / "batches" / "batch=2").mkdir()  # a crash left it half written
    again = AnswerLog(spark, str(tmp_path / "log"), {"model": "m"})
    assert {r.head for r in again.read().collect()} == {"a", "b", "c"} and again.batches() == [0, 1]
    with pytest.raises(ValueError, match="recorded under"):
        AnswerLog(spark, str(tmp_path / "log"), {"model": "other"})
    book.append(4, rows_("d"))
    with pytest.raises(ValueError, match="lacks batches"):
        book.read()


def test_path_sizes_equal_listed_pairs(spark):
    rng = random.Random(4)
    e = [(f"x{rng.randint(0, 30)}", rng.choice("rs"), f"m{rng.randint(0, 4)}") for _ in range(120)]
    f = [(f"m{rng.randint(0, 5)}", rng.choice("tu"), f"x{rng.randint(0, 30)}") for _ in range(60)]
    first = spark.createDataFrame([(r, x, m) for x, r, m in e], "r1 string, x string, m string")
    second = spark.createDataFrame(f, "m string, r2 string, y string")
    want = {}
    for x, r1, m in set(e):
        for m2, r2, y in set(f):
            if m == m2:
                want.setdefault((r1, r2), set()).add((x, y))
    got = {(r.r1, r.r2): r.pairs for r in mining.path_sizes(first, second, ["r1"], ["r2"]).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    labels = [(f"x{i}", lab) for i in range(31) for lab in "ab" if (i + ord(lab)) % 3]
    got = {(r.r1, r.r2, r.label): r.pairs for r in mining.path_sizes(first, second, ["r1"], ["r2"], spark.createDataFrame(labels, "x string, label string")).collect()}
    assert got == {(*k, lab): n for k, v in want.items() for lab in "ab" if (n := sum((x, lab) in labels for x, _ in v))}
    goal = spark.createDataFrame([(f"x{i}", f"x{j}") for i in range(31) for j in range(31) if (i * j) % 7 == 1], "x string, y string")
    have = {(r.x, r.y) for r in goal.collect()}
    got = {(r.r1, r.r2): r.hits for r in mining.path_hits(first, second, ["r1"], ["r2"], goal).collect()}
    assert got == {k: n for k, v in want.items() if (n := len(v & have))}


def test_no_silent_folder_on_a_cluster(monkeypatch):
    from graphloom.plans import stage

    class Option:
        def isDefined(self):
            return False

    class Context:
        master = "spark://somewhere:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Option()})()})()

        def getConf(self):
            return {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stage.shared_dir(type("Spark", (), {"sparkContext": Context()})())


def test_masking_patterns(spark):
    """A number split by any white space is masked; one word character more is not."""
    seen = ["call +49 30 1234 5678 now", "call 49\t30\n1234 5678", "call 555.123.4567", "card 1234567890123", "card 12345678901234"]
    d = spark.createDataFrame(list(enumerate(seen)), "doc_id int, text string")
    got = [r.text for r in text.redacted(d).orderBy("doc_id").collect()]
    assert got[:3] == ["call +<PHONE_1> now", "call <PHONE_1>", "call <PHONE_1>"] and got[4] == "card <CC_1>" and "CC" not in got[3]


def test_one_plan_equals_rounds(spark):
    """Rules without recursion give the same facts, rounds, rules and premises as rounds do."""
    from graphloom.plans.fixpoint import closure

    e = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c"), ("a", "q", "c"), ("a", "t", "c"), ("d", "q", "c"), ("a", "p", "d")], E)
    rules = [Rule("one", (("?x", "p", "?y"), ("?y", "q", "?z")), ("?x", "t2", "?z")), Rule("two", (("?x", "t2", "?z"),), ("?x", "t", "?z")), Rule("three", (("?x", "q", "?z"),), ("?x", "t", "?z"))]
    key = lambda df: sorted(((*r[:4], r.rule, [tuple(p) for p in r.premises or []]) for r in df.select("src", "rel", "dst", "round", "rule", "premises").collect()), key=repr)
    slow = closure(e.withColumn("w", F.lit(1)), rules, by=["w"]).drop("w")
    assert key(closure(e, rules)) == key(slow)


def test_planner_closes_states(spark):
    from graphloom.operators.planner import Action

    go = Action("go", (("?x", "at", "?a"), ("?a", "road", "?b")), (("?x", "at", "?b"),), (("?x", "at", "?a"),))
    start = {("c", "at", "a"), ("a", "road", "b")}
    rule = Rule("home", (("?x", "at", "b"),), ("?x", "is", "home"))
    assert planner.plan(start, [("c", "is", "home")], [go]) is None
    assert planner.plan(start, [("c", "is", "home")], [go], rules=[rule]) == (1.0, ["go(a, b, c)"])
    call = Action("call", (), (("?w", "is", "called"),))
    assert planner.plan(start, [("z", "is", "called")], [call]) is None and planner.plan(start, [("z", "is", "called")], [call], entities={"z"})[0] == 1.0


def test_compliance_arms(spark):
    cases = spark.createDataFrame([(i, f"c{i}", ["a=1", f"b={i % 2}"]) for i in range(40)], "idx long, case_id string, atoms array<string>")
    told = spark.createDataFrame([(f"c{i}", "prohibit" if i % 2 else "permit", ["art5"] if i % 2 else [], 0.5) for i in range(40)], "case_id string, verdict string, articles array<string>, usd double")
    for out, calls in ((cascade.arm_llm_only(cases, told), 40), (cascade.arm_cache(cases, told), 2), (cascade.arm_compile_once(cases, told, 20), 20), (cascade.arm_full(cases, told, [10, 20]), 2)):
        got = {r.idx: r for r in out.collect()}
        assert len(got) == 40 and sum(r.teacher_call for r in got.values()) == calls and math.isclose(sum(r.usd for r in got.values()), calls / 2)
        assert all((r.verdict, r.articles) == (("prohibit", ["art5"]) if i % 2 else ("permit", [])) for i, r in got.items())
    v = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 0.9], [1.0, 0.05]]
    cases = spark.createDataFrame([(i, f"c{i}", x) for i, x in enumerate(v)], "idx long, case_id string, v array<double>")
    weak = told.filter("case_id <> 'c4'")
    got = {r.idx: r.teacher_call for r in cascade.arm_retrieved(cases, told, weak, 0.9).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}
