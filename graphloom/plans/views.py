"""A graph for SQL: views of its tables and its closure, and table functions over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import closure
from graphloom.plans.rules import Rule
from graphloom.plans.stage import staged

#: Table functions, by the end of their name: arguments, columns, query over the views.
FUNCTIONS = {
    "out": ("id STRING", "rel STRING, dst STRING", "SELECT rel, dst FROM {0}_edges WHERE src = {0}_out.id"),
    "into": ("id STRING", "src STRING, rel STRING", "SELECT src, rel FROM {0}_edges WHERE dst = {0}_into.id"),
    "answers": ("head STRING, relation STRING", "answer STRING", "SELECT DISTINCT dst FROM {0}_closure WHERE src = {0}_answers.head AND rel = {0}_answers.relation"),
    "at": ("t DOUBLE", "src STRING, rel STRING, dst STRING", "SELECT src, rel, dst FROM {0}_edges WHERE (valid_from IS NULL OR valid_from <= {0}_at.t) AND (valid_to IS NULL OR {0}_at.t < valid_to)"),
    "between": ("a DOUBLE, b DOUBLE", "src STRING, rel STRING, dst STRING", "SELECT src, rel, dst FROM {0}_edges WHERE (valid_from IS NULL OR valid_from < {0}_between.b) AND (valid_to IS NULL OR {0}_between.a < valid_to)"),
}


def register(spark: SparkSession, name: str, edges: DataFrame, nodes: DataFrame | None = None, rules: list[Rule] | None = None) -> list[str]:
    """The names of views and table functions that spark.sql can use from now on in this session.

    name_edges has edges(src, rel, dst, ...), with open valid times where these
    are missing; name_nodes the nodes, where given; name_closure (src, rel, dst,
    round, rule) all that follows by the rules, computed once.  The functions are
    name_out(id), name_into(id), name_answers(head, relation), name_at(t) and
    name_between(a, b).  They are SQL: the planner sees through them, pushes
    conditions down and joins them by LATERAL.
    """
    if not name.isidentifier():
        raise ValueError(f"{name!r} is no identifier")
    for c in ("valid_from", "valid_to"):
        if c not in edges.columns:
            edges = edges.withColumn(c, F.lit(None).cast("double"))
    made = {f"{name}_edges": edges, f"{name}_closure": staged(closure(edges.select("src", "rel", "dst"), rules or []).select("src", "rel", "dst", "round", "rule"))}
    if nodes is not None:
        made[f"{name}_nodes"] = nodes
    for view, df in made.items():
        df.createOrReplaceTempView(view)
    for end, (arguments, columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_{end}({arguments}) RETURNS TABLE ({columns}) RETURN {body.format(name)}")
    return [*made, *(f"{name}_{end}" for end in FUNCTIONS)]
