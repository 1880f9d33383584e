"""Vocabularies by batches, nested properties, graphs in SQL."""

import json

import pytest

from graphloom.plans import views
from graphloom.plans.fixpoint import closure
from graphloom.plans.rules import Rule
from graphloom.sources import properties, vocabulary


def test_vocabulary(spark):
    values = spark.createDataFrame([(f"v{i:03}",) for i in range(25)] * 2 + [(None,)], "x string")
    assert vocabulary.categories_of(spark.createDataFrame([("Big Thing!",), ("big  thing",), ("",), (None,), ("é-x",)], "c string"), "c") == ["big_thing", "other", "é_x"]

    def ask(batch, categories):
        assert categories == ["even", "odd", "other"] and batch == sorted(batch) and len(batch) <= 10
        said = [" Even " if int(v[1:]) % 2 == 0 else "odd" for v in batch]
        said[0] = "unheard of"
        return said + ["odd"] if batch[0] == "v010" else said  # too long, both times

    got = {r.value: (r.category, r.asked) for r in vocabulary.mapped(values, "x", ["even", "odd", "other"], ask, 10).collect()}
    assert got == {f"v{i:03}": ("other" if i % 10 == 0 else ["even", "odd"][i % 2], 2 if 10 <= i < 20 else 1) for i in range(25)}
    n = {r.category: (r.n, r.share) for r in vocabulary.shares(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "x")], "value string, category string")).collect()}
    assert n == {"x": (3, 0.75), "y": (1, 0.25)}
    assert vocabulary.mapped(values.limit(0), "x", ["other"], ask, 10).count() == 0


def test_properties(spark, tmp_path):
    rows = [(1, '{"n": 2, "deep": {"list": [1, {"x": 2.5}]}}'), (2, '{"n": "two"}'), (3, "{broken"), (4, None), (5, "7")]
    p = properties.parsed(spark.createDataFrame(rows, "id int, props string"), "props")
    properties.write(p, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    got = {r.id: tuple(r)[1:] for r in back.select("id", "malformed", properties.number("props", "$.n").alias("n"), properties.number("props", "$.deep.list[1].x").alias("x"), properties.text("props", "$.n").alias("t")).collect()}
    assert got == {1: (False, 2.0, 2.5, "2"), 2: (False, None, None, "two"), 3: (True, None, None, None), 4: (False, None, None, None), 5: (False, None, None, None)}
    assert "BIGINT" in {r.kind for r in properties.kinds(back).collect()}
    graph = {"name": "g", "nodes": [{"id": "a", "props": {"n": 1, "z": {"q": [1, 2]}}}, {"id": "b", "type": "T"}], "edges": [{"source": "a", "relation": "r", "target": "b", "props": {"w": 0.5}}]}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    nodes, edges = properties.read_json(spark, str(tmp_path / "g.json"))
    assert {(r.id, r.type, r.q) for r in nodes.select("id", "type", properties.number("props", "$.z.q[1]").alias("q")).collect()} == {("a", "Entity", 2.0), ("b", "T", None)}
    assert [tuple(r) for r in edges.select("src", "rel", "dst", properties.number("props", "$.w")).collect()] == [("a", "r", "b", 0.5)]


def test_graphs_in_sql(spark):
    edges = spark.createDataFrame([("a", "r", "b", 0.0, 5.0), ("b", "r", "c", None, None), ("c", "s", "a", 3.0, None)], "src string, rel string, dst string, valid_from double, valid_to double")
    nodes = spark.createDataFrame([("a", "T"), ("b", "T"), ("c", "U")], "id string, type string")
    rules = [Rule("far", (("?x", "r", "?y"), ("?y", "r", "?z")), ("?x", "far", "?z"))]
    names = views.register(spark, "toy", edges, nodes, rules)
    assert {"toy_edges", "toy_nodes", "toy_closure", "toy_out", "toy_at"} <= set(names)
    rows = lambda q: sorted(map(tuple, spark.sql(q).collect()))
    assert rows("SELECT * FROM toy_out('a')") == [("r", "b")] and rows("SELECT * FROM toy_into('a')") == [("c", "s")]
    assert rows("SELECT src, rel, dst FROM toy_closure") == sorted(map(tuple, closure(edges.select("src", "rel", "dst"), rules).select("src", "rel", "dst").collect()))
    assert rows("SELECT * FROM toy_answers('a', 'far')") == [("c",)]
    assert rows("SELECT dst FROM toy_at(2D)") == [("b",), ("c",)] and rows("SELECT dst FROM toy_between(5D, 9D)") == [("a",), ("c",)]
    assert rows("SELECT n.id, o.dst FROM toy_nodes n, LATERAL toy_out(n.id) o WHERE n.type = 'T'") == [("a", "b"), ("b", "c")]
    with pytest.raises(ValueError):
        views.register(spark, "a b", edges)
    assert views.register(spark, "bare", edges.select("src", "rel", "dst")) and spark.sql("SELECT * FROM bare_at(1D)").count() == 3
