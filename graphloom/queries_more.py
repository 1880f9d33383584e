"""More operators on the shared tables: files written and read back, lookups, learning, arms, reports and forecasts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import cascade, causal, concepts, dynamics, episodes, evaluation, frontier, graph, link, mining, ontology, planner, service, temporal
from graphloom.plans import fixpoint
from graphloom.plans.rules import Rule, RuleBook, atom, join_body, rules_from_json, rules_to_json
from graphloom.plans.stage import shared_dir, staged
from graphloom.queries import KG, LOG, MANAGES, MINE, ORDER_NATION, ORDER_REGION, PAIRS, STATES, _id, _u, all_episodes, joined, kg, kg_nodes, log, model_tables, query, read, relation_types, scm, vectors, withheld
from graphloom.sources import graphs as S
from graphloom.sources import workload as O
from graphloom.sources.answers import AnswerLog
from graphloom.streaming import metrics


def folder(spark) -> str:
    """A new folder in the shared one, for files that are read back."""
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


# Files

@query(f"with {KG}, e as (select * from kg where rel in ('lives_in', 'part_of')) select src, rel, dst, s.type as src_type, d.type as dst_type from e join nodes s on s.id = src join nodes d on d.id = dst")
def s2_json_round_trip(spark, sf):
    """A graph written as one JSON document and read back."""
    e = kg(spark, sf, "lives_in", "part_of")
    ends = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    at = folder(spark)
    S.write_json(kg_nodes(spark, sf).join(ends, "id", "left_semi"), e, at)
    nodes, edges = S.read_json(spark, at)
    t = nodes.select("id", "type")
    return edges.select("src", "rel", "dst").join(t.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src").join(t.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst")


@query(f"with {KG} select src, rel, dst from kg where rel in ('placed_by', 'part_of')")
def s3_csv_round_trip(spark, sf):
    e, at = kg(spark, sf, "placed_by", "part_of"), folder(spark)
    e.select(F.col("src").alias("source"), F.col("rel").alias("relation"), F.col("dst").alias("target")).write.option("header", True).csv(at)
    return S.read_csv(spark, at)


@query(f"with {KG} select src, rel, dst from kg where rel = 'lives_in'")
def s5_triple_lines(spark, sf):
    """Lines with a fourth field, comments, blank lines and short ones."""
    e, at = kg(spark, sf, "lives_in"), folder(spark)
    lines = e.select(F.concat_ws("\t", "src", "rel", "dst", F.lit("extra")).alias("value"))
    odd = spark.createDataFrame([("# a comment\tx\ty",), ("",), ("too\tshort",)], "value string")
    lines.union(odd).write.text(at)
    return S.read_triples(spark, at)


@query(f"""with {KG}, u as (select src, rel, dst, cast('0x' || substr(md5('7|' || src || '|' || rel || '|' || dst), 1, 8) as bigint) / 4294967296.0::double as u from kg where rel = 'placed_by')
select src, rel, dst, case when u < 0.8 then 'train' when u < 0.9 then 'valid' else 'test' end as split from u""")
def s6_split_files(spark, sf):
    parts, at = graph.split(kg(spark, sf, "placed_by"), (0.8, 0.1, 0.1), 7), folder(spark)
    for s in ("train", "valid", "test"):
        parts.filter(F.col("split") == s).select(F.concat_ws("\t", "src", "rel", "dst").alias("value")).write.text(f"{at}/{s}.txt")
    return S.read_splits(spark, at).select("src", "rel", "dst", "split")


@query("select count(distinct i) as people, count(*) filter (where stays) as at_the_seat from (select range as i, cast('0x' || substr(md5('0:stays:' || range), 1, 8) as bigint) / 4294967296.0::double < 0.75 as stays from range(2000))")
def s9_synthetic_dataset(spark, sf):
    """The made-up organisation as a dataset: its people, and how many are drawn to live at their company's seat."""
    size = O.Size(people=2000)
    split = O.synthetic_dataset(spark, size)
    people = split.filter("rel = 'works_at'").select("src").distinct().agg(F.count("*").alias("people"))
    stays = spark.range(2000).filter(O.u(size, "stays", F.col("id")) < 0.75).agg(F.count("*").alias("at_the_seat"))
    return people.crossJoin(stays)


@query("select concat('S', s_suppkey) as src, 'named' as rel, trim(s_name) as dst from supplier")
def s10_pipe_file(spark, sf):
    at = folder(spark)
    read(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey", F.lit(" | named | "), "s_name").alias("value")).write.text(at)
    return S.read_kb(spark, at)


@query("select concat('t', s_suppkey) as id, s_suppkey % 4 <> 0 as expressible, concat('S', s_suppkey) as fact, '?x' as head, s_suppkey % 3 <> 0 as answer from supplier")
def s12_theories(spark, sf):
    """Theories as JSON lines in the layout of a depth: a rule with a negated atom makes one inexpressible, and it stays."""
    at = folder(spark)
    k = F.col("s_suppkey")
    who = F.concat(F.lit('("S'), k.cast("string"), F.lit('" "is" "red" "+")'))
    body = F.concat(F.lit('("someone" "is" "red" "'), F.when(k % 4 == 0, "~").otherwise("+"), F.lit('") -> ("someone" "is" "kind" "+")'))
    rep = lambda c: F.create_map(F.lit("one"), F.struct(c.alias("representation")))
    asked = F.create_map(F.lit("Q1"), F.struct(F.lit("?").alias("question"), who.alias("representation"), (k % 3 != 0).alias("answer"), F.lit(0).alias("QDep")))
    read(spark, sf, "supplier").select(F.concat(F.lit("t"), k.cast("string")).alias("id"), rep(who).alias("triples"), rep(body).alias("rules"), asked.alias("questions")).write.json(f"{at}/depth-1/meta-test.jsonl")
    t = S.read_theory_split(spark, at, 1)
    return t.select("id", "expressible", F.get("facts", F.lit(0))["s"].alias("fact"), F.get("rules", F.lit(0))["head"]["s"].alias("head"), F.get("questions", F.lit(0))["answer"].alias("answer"))


@query("select count(*) as n from supplier where s_suppkey % 4 <> 0")
def f14_expressible(spark, sf):
    k = F.col("s_suppkey")
    return S.expressible(read(spark, sf, "supplier").select(k, (k % 4 != 0).alias("expressible"))).agg(F.count("*").alias("n"))


@query("select concat('O', o_orderkey) as case_id, 'status' as slot, lower(o_orderstatus) as value from orders union all select concat('O', o_orderkey), 'segment', case when o_custkey % 3 = 0 then 'none' else 'x' || (o_custkey % 3) end from orders")
def s14_arrow_cases(spark, sf):
    """Cases written as Arrow files by tasks, read back and normalised: values trimmed and lower-cased, none for null."""
    import pyarrow as pa

    o = read(spark, sf, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("case_id"), F.array(F.concat(F.lit(" "), "o_orderstatus"), F.col("o_orderstatus")).alias("status"), F.when(F.col("o_custkey") % 3 != 0, F.array(F.concat(F.lit("X"), (F.col("o_custkey") % 3).cast("string")))).alias("segment"))

    def packed(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["content"])

    blobs = staged(o.mapInArrow(packed, "content binary"))
    back = S.arrow_rows(blobs, "case_id string, status array<string>, segment array<string>")
    return S.case_slots(back, ["status", "segment"])


@query("select s as src, 'has_' || slot as rel, slot || ':' || v as dst from (select concat('O', o_orderkey) as s, 'status' as slot, o_orderstatus as v from orders)")
def s16_case_ontology(spark, sf):
    """Every edge of a case graph is allowed by the ontology built for its slots."""
    o = read(spark, sf, "orders").select(_id("O", "o_orderkey").alias("case_id"), F.lit("status").alias("slot"), F.col("o_orderstatus").alias("category"))
    e = S.case_edges(o)
    rel = spark.createDataFrame(S.case_ontology(["status"]), ontology.RELATION_SCHEMA)
    nodes = e.select(F.col("src").alias("id"), F.lit("Case").alias("type")).union(e.select("dst", F.lit("Value"))).distinct()
    return ontology.allows(e, nodes, e.limit(0), rel).filter("allowed").select("src", "rel", "dst")


@query("select name, 2 as legs, (select count(distinct o_orderkey) from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey) as derived from (values ('order_nation'), ('order_region')) t(name)")
def s18_rules_json(spark, sf):
    """Rules written as JSON and read back, and what they derive from the graph."""
    at = folder(spark)
    spark.createDataFrame([(rules_to_json([ORDER_NATION, ORDER_REGION]),)], "value string").write.text(at, lineSep="␞")
    back = rules_from_json(spark.read.text(at, wholetext=True).first()[0].rstrip("␞"))
    return _derived(kg(spark, sf, "placed_by", "lives_in", "part_of"), back)


def _derived(edges, rules) -> DataFrame:
    """(name, legs, derived) of rules with heads of their own: facts that each adds to edges."""
    named = edges.sparkSession.createDataFrame([(r.name, len(r.body), r.head[1]) for r in rules], "name string, legs int, rel string")
    n = fixpoint.closure(edges, rules).filter("round > 0").groupBy("rel").agg(F.count("*").alias("n"))
    return named.join(n, "rel", "left").select("name", "legs", F.coalesce("n", F.lit(0)).alias("derived"))


@query("select event_id as id, value as cost, case when event_id % 2 = 0 then event_id % 3 <> 0 end as ok from events")
def s19_episodes_json(spark, sf):
    eps, at = all_episodes(spark, sf), folder(spark)
    episodes.save(eps, at)
    back = episodes.load(spark, at, eps.schema)
    return back.select("id", "cost", F.col("feedback.correct").alias("ok"))


@query(f"with {KG} select (select count(*) from kg where rel = 'lives_in') as edges, (select count(*) from nodes) as nodes, (select count(*) from events) as episodes, 2::bigint as rules")
def s20_state(spark, sf):
    at = folder(spark)
    S.save_state(at, kg(spark, sf, "lives_in"), rules_to_json([ORDER_NATION, ORDER_REGION]), all_episodes(spark, sf), kg_nodes(spark, sf))
    back = S.load_state(spark, at)
    n = lambda name: back[name].agg(F.count("*").alias(name))
    return n("edges").crossJoin(n("nodes")).crossJoin(n("episodes")).withColumn("rules", F.lit(len(rules_from_json(back["rules"]))).cast("long"))


@query("select concat('U', user_id) as head, event_type as relation, count(*) as answers, round(sum(value), 4) as cost from events group by all")
def s21_answer_log(spark, sf):
    """Recorded in three batches, one of them twice, as after a crash."""
    e = read(spark, sf, "events").select(_id("U", "user_id").alias("head"), F.col("event_type").alias("relation"), F.array(F.col("event_id").cast("string")).alias("answers"), F.col("value").alias("cost"), (F.col("event_id") % 3).alias("batch"))
    book = AnswerLog(spark, folder(spark), {"model": "m", "seed": 1})
    for b in (0, 1, 1, 2):
        book.append(b, e.filter(F.col("batch") == b))
    return book.read().groupBy("head", "relation").agg(F.sum(F.size("answers")).alias("answers"), F.round(F.sum("cost"), 4).alias("cost"))


_ORG = O.Size(people=400, companies=10, questions=600)
_OU = lambda what, key: f"cast('0x' || substr(md5('0:{what}:' || {key}), 1, 8) as bigint) / 4294967296.0::double"


@query(f"""with p as (select range as i, floor({_OU('company', 'range')} * 10)::bigint as company, floor({_OU('department', 'range')} * 6)::bigint as department from range(400)), c as (select *, case when {_OU('stays', 'i')} < 0.75 then floor({_OU('seat', 'company')} * 18)::bigint else floor({_OU('city', 'i')} * 18)::bigint end as city from p)
select 'person_' || i as src, 'works_at' as rel, 'company_' || company as dst from c union all select 'person_' || i, 'member_of', 'department_' || department from c union all select 'person_' || i, 'lives_in', 'city_' || city from c union all select 'city_' || range, 'part_of', 'region_' || (range // 3) from range(18) union all select 'region_' || range, 'part_of', 'country_' || (range % 2) from range(6)""")
def s22_facts(spark, sf):
    return O.base_facts(spark, _ORG).filter("rel IN ('works_at', 'member_of', 'lives_in', 'part_of')")


@query()
def s22_workload(spark, sf):
    """Questions of the five classes with repeats, against what is true and what the graph has."""
    org = O.organisation(spark, _ORG)
    q = org["questions"].join(org["truth"], ["head", "relation"], "left")
    return q.groupBy("qclass").agg(F.count("*").alias("n"), F.countDistinct("head", "relation").alias("distinct_questions"), F.count(F.when(F.size("tails") > 0, 1)).alias("answerable"))


@query(f"with {LOG}, c as (select 'asks_total' as name, tier, count(*)::double as v from log group by tier union all select 'cost_usd_total', tier, sum(cost) from log group by tier) select name, 'tier=\"' || tier || '\"' as labels, round(v, 4) as value from c union all select 'feedback_total', 'verdict=\"' || case when correct then 'correct' else 'wrong' end || '\"', count(*)::double from log group by correct")
def s24_counters(spark, sf):
    l = log(spark, sf)
    return metrics.counters(l, l.select("correct")).select("name", "labels", F.round("value", 4).alias("value"))


@query(f"with {LOG}, b as (select tier, le, count(*) filter (where latency_ms <= 1000 * le) as n from log, (select unnest(list_append([0.005, 0.01, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30]::double[], 'infinity'::double)) as le) group by all) select 'latency_seconds_bucket{{tier=\"' || tier || '\",le=\"' || case when isinf(le) then '+Inf' else le::varchar end || '\"}} ' || n::double::varchar as line from b")
def s24_exposition(spark, sf):
    return metrics.exposition(metrics.latencies(log(spark, sf)))


# Lookups

@query(f"with {KG}, a as (select concat('O', o_orderkey) as src, 'placed_by' as rel, concat('C', o_orderkey % 100 + 1) as dst from orders) select src, rel, dst, exists (select 1 from kg where kg.src = a.src and kg.rel = a.rel and kg.dst = a.dst) as found from a")
def f3_has_edge(spark, sf):
    asked = read(spark, sf, "orders").select(_id("O", "o_orderkey").alias("src"), F.lit("placed_by").alias("rel"), _id("C", F.col("o_orderkey") % 100 + 1).alias("dst"))
    return graph.has_edges(asked, kg(spark, sf, "placed_by"))


@query(f"with {KG}, a as (select concat('C', o_orderkey) as id from orders) select a.id, type, type is not null as found from a left join nodes using (id)")
def f3_has_node(spark, sf):
    return graph.has_nodes(read(spark, sf, "orders").select(_id("C", "o_orderkey").alias("id")), kg_nodes(spark, sf))


@query(f"with {KG}, r as (select dst as id, rel, count(distinct src) as n from kg where rel in ('lives_in', 'placed_by', 'supplied_by') group by all) select id, string_agg(rel || '=' || n, ';' order by rel) as relations from r group by id")
def f5_in_relations(spark, sf):
    m = graph.in_relations(kg(spark, sf, "lives_in", "placed_by", "supplied_by"))
    return m.select("id", F.array_join(F.transform(F.map_entries("relations"), lambda e: F.concat(e["key"], F.lit("="), F.size(e["value"]).cast("string"))), ";").alias("relations"))


@query(f"with {KG} select 'type' as kind, type as name, count(*) as n from nodes group by type union all select 'relation', rel, 1 from kg group by rel union all select 'entities', 'all', count(distinct id) from nodes union all select 'nodes_of_type', 'Nation', count(*) from nodes where type = 'Nation'")
def f7_scans(spark, sf):
    nodes, edges = kg_nodes(spark, sf), kg(spark, sf)
    row = lambda df, kind, name, n: df.select(F.lit(kind).alias("kind"), name.alias("name"), n.cast("long").alias("n"))
    out = row(graph.types(nodes), "type", F.col("type"), F.col("n")).union(row(graph.relations(edges), "relation", F.col("rel"), F.lit(1)))
    out = out.union(row(graph.entities(nodes).agg(F.count("*").alias("n")), "entities", F.lit("all"), F.col("n")))
    return out.union(row(graph.nodes_of_type(nodes, "Nation").agg(F.count("*").alias("n")), "nodes_of_type", F.lit("Nation"), F.col("n")))


@query("select o_orderkey as id, o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus = 'F' as accepted from orders")
def f12_accepts(spark, sf):
    ok = ontology.accepts(F.array(F.lit("1-URGENT"), F.lit("2-HIGH")), F.array(F.lit("F")), F.col("o_orderpriority"), F.col("o_orderstatus"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), ok.alias("accepted"))


@query(f"with {LOG} select idx from log where head = 'U1' and relation = 'view'")
def f13_for_query(spark, sf):
    return episodes.for_query(log(spark, sf), "U1", "view").select("idx")


# Rules

@query(f"with {KG} select src as o from kg where rel = 'placed_by' and dst = 'C1' union all select 'loop:' || src from kg where rel = 'placed_by' and src = dst")
def r1_constants(spark, sf):
    """A constant object, and a variable that stands twice."""
    e = kg(spark, sf, "placed_by")
    return atom(e, ("?o", "placed_by", "C1")).select(F.col("?o").alias("o")).union(atom(e, ("?x", "placed_by", "?x")).select(F.concat(F.lit("loop:"), F.col("?x"))))


@query("select rule, taken, case when taken then (select count(distinct o_orderkey) from orders join customer on o_custkey = c_custkey) else 0 end as derived from (values ('order_nation', true), ('order_nation again', false), ('order_region', false), ('?r refused', true)) t(rule, taken) where rule <> '?r refused' union all select '?r refused', true, 0")
def r9_rule_book(spark, sf):
    """What a book of rules takes, by name and by the types that the graph shows, and what that derives; a variable for a relation is refused at once."""
    e = kg(spark, sf, "placed_by", "lives_in", "part_of")
    ends = {r.name: (set(r.domain), set(r.range)) for r in ontology.induce(kg_nodes(spark, sf), e).collect()}  # a row a relation
    book = RuleBook(ends | {"order_nation": ({"Order"}, {"Nation"}), "order_region": ({"Order"}, {"Customer"})})
    rows = [("order_nation", book.add(ORDER_NATION)), ("order_nation again", book.add(ORDER_NATION)), ("order_region", book.add(ORDER_REGION))]
    try:
        Rule("any", (("?x", "?r", "?y"),), ("?x", "seen", "?y"))
        rows.append(("?r refused", False))
    except ValueError:
        rows.append(("?r refused", book.names() == {"order_nation"}))
    got = _derived(e, book.rules).select(F.col("name").alias("rule"), F.lit(True).alias("taken"), "derived")
    return spark.createDataFrame(rows, "rule string, taken boolean").join(got, ["rule", "taken"], "left").select("rule", "taken", F.coalesce("derived", F.lit(0)).alias("derived"))


#: Customers as a graph without cycles: of number k, the causes are k / 2 and k / 3.
DAG = """e as (select 'C' || (k // d) as src, 'C' || k as dst from (select c_custkey as k, unnest([2, 3]) as d from customer) where k >= d union select '', '' where false), c as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src)"""


def customer_dag(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    by = read(spark, sf, "customer").select(k, F.explode(F.array(F.lit(2), F.lit(3))).alias("d")).filter(k >= F.col("d"))
    return by.select(_id("C", F.floor(k / F.col("d"))).alias("src"), F.lit("parent").alias("rel"), _id("C", k).alias("dst")).distinct()


@query(f"with recursive {DAG} select src, dst from c")
def r17_recursive_boundary(spark, sf):
    """What the base rule and the step rule cover of a graph without cycles: its closure."""
    rules = [Rule("base", (("?x", "parent", "?y"),), ("?x", "anc", "?y")), Rule("step", (("?x", "anc", "?z"), ("?z", "parent", "?y")), ("?x", "anc", "?y"))]
    return fixpoint.closure(customer_dag(spark, sf), rules).filter("rel = 'anc'").select("src", "dst")


@query(f"with {KG} select src, rel, dst from kg where rel = 'part_of' union select concat('O', o_orderkey), 'order_nation', concat('N', c_nationkey) from orders join customer on o_custkey = c_custkey")
def r21_scoring_graph(spark, sf):
    """Base facts and the truth, as a rule is scored on."""
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    true = o.select(_id("O", "o_orderkey").alias("head"), F.lit("order_nation").alias("relation"), F.array(_id("N", "c_nationkey")).alias("tails"))
    return graph.with_truth(kg(spark, sf, "part_of"), true)


# Time

@query(f"with {STATES} select src as head, 'busy' as relation, string_agg(distinct dst, ',' order by dst) as answers from states where valid_from <= 1705000000 and (valid_to is null or 1705000000 < valid_to) group by src")
def t3_query_at(spark, sf):
    st = temporal.states(read(spark, sf, "events"))
    asked = st.select(F.col("src").alias("head"), F.lit("busy").alias("relation")).distinct()
    rule = Rule("busy", (("?u", "in_state", "?s"),), ("?u", "busy", "?s"))
    return temporal.query_at(st, [rule], asked, 1705000000.0).filter("answered").select("head", "relation", joined("answers"))


@query(f"with {STATES} select src as head, 'in_state' as relation, string_agg(distinct dst, ',' order by dst) as answers from states where valid_from < 1705086400 and (valid_to is null or 1705000000 < valid_to) group by src")
def t5_query_during(spark, sf):
    st = temporal.states(read(spark, sf, "events"))
    asked = st.select(F.col("src").alias("head"), F.col("rel").alias("relation")).distinct()
    return temporal.query_during(st, [], asked, 1705000000.0, 1705086400.0).filter("answered").select("head", "relation", joined("answers"))


@query("select concat('U', user_id) as src, 'did' as rel, event_type as dst, floor(epoch(ts))::double as valid_from, null::double as valid_to from events")
def t7_temporal_edges(spark, sf):
    e = temporal.temporal_edge(_id("U", "user_id"), F.lit("did"), F.col("event_type"), temporal.seconds("ts"))
    return read(spark, sf, "events").select(e.alias("e")).select("e.*")


@query(f"with {STATES}, x as (select src, dst, valid_from as f from states) select side, count(*) as n from (select distinct 'before' as side, src, dst, 0 as f from x where f <= 1705000000 union all select 'event', src, dst, f from x where f > 1705000000 and f <= 1705086400 union all select distinct 'after', src, dst, 0 from x where f <= 1705086400) group by side")
def t8_transition(spark, sf):
    return temporal.transition(temporal.states(read(spark, sf, "events")), 1705000000.0, 86400.0).groupBy("side").agg(F.count("*").alias("n"))


@query("with d as (select distinct datediff('day', date '2014-01-01', ts::date) as d from events order by d limit 5) select datediff('day', date '2014-01-01', ts::date)::double as valid_from, count(*) as n from events where datediff('day', date '2014-01-01', ts::date) in (from d) group by 1")
def t9_first_days(spark, sf):
    q = read(spark, sf, "events").select(_id("U", "user_id").alias("s"), F.col("event_type").alias("r"), F.lit("site").alias("o"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return temporal.first_days(temporal.quads(q), 5).groupBy("valid_from").agg(F.count("*").alias("n"))


# Ontology

@query(f"with {KG}, n as (select rel as name, count(*) as allowed from kg where rel in ('contains', 'placed_by') group by 1) select name, domain, range, functional, coalesce(allowed, 0) as allowed from (values ('contains', 'Order', 'Part', false), ('order_nation', 'Order', 'Nation', false), ('placed_by', 'Order', 'Customer', true)) t(name, domain, range, functional) left join n using (name)")
def o4_registry(spark, sf):
    """A registry of types, revised by induced relations that have a new name, and how many edges of the graph it lets in."""
    o = ontology.Ontology().with_node_type("Order").with_relation_type(ontology.RelationType("contains", ("Order",), ("Part",))).with_relation_type(ontology.RelationType("placed_by", ("Order",), ("Customer",), functional=True)).with_relation_type(ontology.RelationType("placed_by", ("Order",), ("Customer",), functional=True))
    o = o.with_relation_type(ontology.RelationType("lives_in", ("Customer",), ("Nation",)))
    _, rel = o.tables(spark)
    new = spark.createDataFrame([("order_nation", "placed_by", "lives_in"), ("contains", "placed_by", "lives_in"), ("lost", "placed_by", "nowhere")], "name string, r1 string, r2 string")
    out = ontology.revised(rel, new).filter("name <> 'lives_in'")
    e = kg(spark, sf, "contains", "placed_by", "supplied_by")
    n = ontology.allows(e, kg_nodes(spark, sf), e.limit(0), out).filter("allowed").groupBy(F.col("rel").alias("name")).agg(F.count("*").alias("allowed"))
    return out.join(n, "name", "left").select("name", joined("domain"), joined("range"), "functional", F.coalesce("allowed", F.lit(0)).alias("allowed"))


@query(f"with {KG}, p as (select distinct a.rel as r1, b.rel as r2, a.src as x, b.dst as y from kg a join kg b on a.dst = b.src where a.rel in ('placed_by', 'lives_in', 'part_of') and b.rel in ('placed_by', 'lives_in', 'part_of')) select r1 || '.' || r2 as name from p where x <> y group by r1, r2 having count(*) >= 10 union all select unnest(['lives_in', 'part_of', 'placed_by', 'contains', 'supplied_by', 'manages'])")
def o6_revise(spark, sf):
    """The declared relations and those induced as paths, none overwritten."""
    new = mining.induce_relations(kg(spark, sf, "placed_by", "lives_in", "part_of"))
    return ontology.revised(relation_types(spark), new).select("name")


@query("select 'missing_property' as kind, 'O' || o_orderkey || ' status' as detail from orders where o_orderkey % 3 = 0")
def o2_missing_properties(spark, sf):
    i = F.col("o_orderkey")
    nodes = read(spark, sf, "orders").select(_id("O", "o_orderkey").alias("id"), F.lit("Order").alias("type"), F.when(i % 3 == 0, F.create_map(F.lit("priority"), "o_orderpriority")).otherwise(F.create_map(F.lit("status"), "o_orderstatus")).alias("props"))
    types = spark.createDataFrame([("Order", ["status"]), ("Part", ["x"])], "name string, required_props array<string>")
    none = spark.createDataFrame([], "src string, rel string, dst string")
    return ontology.validate(nodes, none, relation_types(spark), types)


# Mining

@query(f"{MINE} select name, body, support from c where split_part(name, '<=', 2) not like '%order_nation%'")
def m2_no_target_in_body(spark, sf):
    facts, heads_ = withheld(spark, sf)
    return mining.candidates(staged(facts), "order_nation", heads_, options=mining.Mining(target_in_body=False)).select("name", "body", "support")


@query(f"{MINE}, g as (select name, row_number() over (order by support / body desc, support desc, contains(name, '.'), name) as i from c where body >= 3 and support >= 3 and 100 * support >= 95 * body) select 'order_nation' as relation, name from g where i <= 8")
def m4_synthesise(spark, sf):
    """What the teacher said of most orders, mined once the relation has heads enough."""
    facts, heads_ = withheld(spark, sf)
    said = facts.filter("rel = 'order_nation'").groupBy(F.col("src").alias("head"), F.col("rel").alias("relation")).agg(F.collect_set("dst").alias("answers"))
    found = mining.synthesise(facts.filter("rel <> 'order_nation'"), said, spark.createDataFrame([], "relation string"))
    return spark.createDataFrame([(r, x.name) for r, rules in found.items() for x in rules], "relation string, name string")


@query("select case when o_orderstatus = 'F' then 'prohibit' else 'permit' end as verdict, case when o_orderstatus = 'F' then 'flag' else '' end as articles, count(*) as n from orders group by 1, 2")
def m8_case_rules(spark, sf):
    """Mined patterns as rules with constants, run by the engine on the case graph."""
    from graphloom.queries import cases

    atoms, targets = cases(spark, sf)
    rules = mining.case_rules(mining.mine_cases(atoms, targets, max_atoms=1))
    slot = F.substring_index("atom", "=", 1)
    edges = atoms.select(F.col("case_id").cast("string").alias("src"), F.concat(F.lit("has_"), slot).alias("rel"), F.concat(slot, F.lit(":"), F.substring_index("atom", "=", -1)).alias("dst"))
    closed = fixpoint.closure(edges, rules)
    out = cascade.compliance_answers(closed, edges.select(F.col("src").alias("case_id")))
    return out.groupBy("verdict", joined("articles")).agg(F.count("*").alias("n"))


@query()
def m11_elbow(spark, sf):
    """Node types with as many clusters as the elbow of the costs says."""
    members, types = concepts.induce_types_by_elbow(kg(spark, sf), 6)
    return members.groupBy("cluster").agg(F.count("*").alias("n")).join(types, "cluster").select("n", concepts.described("signature").alias("description"))


@query(f"with {KG}, s as (select distinct src as id, rel || ':out' as s from kg union select dst, rel || ':in' from kg), g as (select id, list_sort(list(s)) as s from s group by id) select array_to_string(s[1:5], ', ') as description, count(*) as n from g group by all")
def m12_described(spark, sf):
    return concepts.signatures(kg(spark, sf)).groupBy(concepts.described("signature").alias("description")).agg(F.count("*").alias("n"))


@query("select 'objects' as what, count(*) as n from supplier where s_suppkey % 2 = 0 and s_acctbal > 5000 union all select 'attributes', count(*) from (select 'half' as a from supplier where s_suppkey % 2 = 0 and s_acctbal > 5000 having count(*) > 0 union all select 'rich' from supplier where s_suppkey % 2 = 0 and s_acctbal > 5000 having count(*) > 0 union all select 'third' from supplier where s_suppkey % 2 = 0 and s_acctbal > 5000 having count(distinct s_suppkey % 3) = 1 union all select 'region' from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 2 = 0 and s_acctbal > 5000 having count(distinct n_regionkey) = 1)")
def m14_closures(spark, sf):
    """Objects of two attributes, and the attributes that all of these have."""
    from graphloom.queries import small_context

    attrs, inc = concepts.context(small_context(spark, sf))
    attrs, inc = staged(attrs), staged(inc)
    two = [r.attr for r in attrs.filter("(rel = 'half' AND dst = '0') OR (rel = 'rich' AND dst = 'true')").collect()]
    objects = staged(concepts.objects_of(inc, two))
    n = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return n(objects, "objects").union(n(concepts.attributes_of(inc, attrs, objects), "attributes"))


from graphloom.queries import CTX  # noqa: E402


@query(f"{CTX}, b as (select l.intent as lower, u.intent as upper from every l join every u on len(u.intent) < len(l.intent) and list_has_all(l.intent, u.intent)), d as (select * from b where not exists (select 1 from b x join b y on x.upper = y.lower where x.lower = b.lower and y.upper = b.upper)) select (select count(*) from c) as concepts, (select count(*) from d) as edges, (select max(n) from c) as largest_extent, (select max(len(intent)) from c)::bigint as largest_intent")
def m16_summary(spark, sf):
    from graphloom.queries import small_context

    attrs, inc = concepts.context(small_context(spark, sf))
    inc, attrs = staged(inc), staged(attrs)
    return concepts.lattice_summary(concepts.concept_sizes(inc, attrs), concepts.lattice_edges(inc, attrs))


CELLS = """cells as (select 'acme_model.' || (user_id % 3) || '_hop2_lim300_s' || (user_id % 5) || case when user_id % 2 = 0 then '_forbid' else '' end as stem, event_id, 'syn:t<=' || case event_id % 4 when 0 then 'a.b' when 1 then 't.~t' when 2 then 'c' else '~a.t' end as rule from events)"""


@query(f"with {CELLS} select stem, 'acme/model.' || regexp_extract(stem, 'model.([0-9])', 1) as slug, regexp_extract(stem, '_s([0-9])', 1)::int as seed, 'acme/model' || regexp_extract(stem, 'model.([0-9])', 1) || '#' || regexp_extract(stem, '_s([0-9])', 1) as match_key, case when contains(rule, 'a') and contains(split_part(rule, '<=', 2), 'b') then 'composition' when contains(split_part(rule, '<=', 2), 't') then 'self_referential' else 'other' end as class, count(*) as n from cells group by all")
def m20_rule_classes(spark, sf):
    u, i = F.col("user_id"), F.col("event_id")
    stem = F.concat(F.lit("acme_model."), (u % 3).cast("string"), F.lit("_hop2_lim300_s"), (u % 5).cast("string"), F.when(u % 2 == 0, "_forbid").otherwise(""))
    rule = F.concat(F.lit("syn:t<="), F.when(i % 4 == 0, "a.b").when(i % 4 == 1, "t.~t").when(i % 4 == 2, "c").otherwise("~a.t"))
    c = mining.cell_names(read(spark, sf, "events").select(stem.alias("stem"), rule.alias("rule")))
    return mining.rule_classes(c, ["a", "b"]).groupBy("stem", "slug", "seed", "match_key", "class").agg(F.count("*").alias("n"))


@query("""with h as (select o_orderkey, o_orderkey % 5 <> 0 as ok, ascii(substr(sha256('0:O' || o_orderkey), 64, 1)) as x from orders join customer on o_custkey = c_custkey), g as (select ok, (case when x >= 97 then x - 87 else x - 48 end) % 2 as side from h)
select 'order_nation' as name, case when avg(ok::int) >= 0.95 then 'composition' else 'leakage' end as class, round(avg(ok::int) filter (where side = 0), 8) as fit, round(avg(ok::int) filter (where side = 1), 8) as "check", case when avg(ok::int) filter (where side = 0) < 0.90 then 'not_candidate' when avg(ok::int) >= 0.95 and avg(ok::int) filter (where side = 1) >= 0.90 then 'admit' when avg(ok::int) filter (where side = 1) < 0.85 then 'reject_leak' else 'hold' end as decision from g""")
def m21_admission(spark, sf):
    facts, _ = withheld(spark, sf)
    out = mining.score_rules([ORDER_NATION], facts)
    return out.select("name", "class", F.round("fit", 8).alias("fit"), F.round("check", 8).alias("check"), "decision")


def _nm(what: str) -> str:
    return f"cast('0x' || substr(md5(seed || ':{what}:' || id), 1, 8) as bigint) / 4294967296.0::double"


NEAR_MISS = f"""t as (select unnest([0.2, 0.4, 0.8])::double as theta), c as (select theta, 1 as seed, o_orderkey as id from t, orders), e as (select *, least(199, floor(pow({_nm('entity')} * (pow(200.0::double, -0.3::double) - 1) + 1, 1 / -0.3::double))::int - 1) as x, ascii(substr(sha256('1:' || id), 64, 1)) as hx from c), g as (select *, (x * 11 + 5) % 200 as m, (case when hx >= 97 then hx - 87 else hx - 48 end) % 2 as side, {_nm('fired')} < theta as fired from e), w as (select *, case when m <> x and (m * 7 + 3) % 200 <> x then (m * 7 + 3) % 200 end as gold, (x + 1 + floor({_nm('wrong')} * 199)::int) % 200 as wrong from g), a as (select *, case when fired then case when {_nm('right')} < 1 - theta and gold is not null then gold else wrong end end as leak from w)"""


@query(f"with {NEAR_MISS}, r as (select theta, avg(1.0) filter (where side = 1 and gold is not null) as comp, avg(coalesce(leak = gold, false)::int) filter (where side = 1 and fired) as est, avg(coalesce(leak = gold, false)::int) filter (where fired) as exact from a group by theta) select theta, round(comp, 8) as comp_estimate, round(est, 8) as leak_estimate, round(exact, 8) as leak_exact, (case when est is null then 'N' when est < 0.85 and comp >= 0.9 then 'A' else 'D' end) = (case when exact is null then 'N' when exact < 0.85 then 'A' else 'D' end) as matches from r")
def m22_near_miss(spark, sf):
    out = None
    for theta in (0.2, 0.4, 0.8):
        c = mining.near_miss_cell(mining.near_miss_world(read(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id")), theta, 1)).withColumn("theta", F.lit(theta))
        out = c if out is None else out.unionByName(c)
    return out.select("theta", *[F.round(c, 8).alias(c) for c in ("comp_estimate", "leak_estimate", "leak_exact")], "matches")


@query(f"with {NEAR_MISS}, r as (select theta, avg(1.0) filter (where side = 1 and gold is not null) as comp, avg(coalesce(leak = gold, false)::int) filter (where side = 1 and fired) as est from a group by theta) select case when bool_and(comp - est >= 0.20) filter (where theta <= 0.4) then 'POSITIVE' when bool_or(comp - est < 0.05) then 'NEGATIVE' else 'NEUTRAL' end as decision from r")
def m22_campaign(spark, sf):
    cells = None
    for theta in (0.2, 0.4, 0.8):
        c = mining.near_miss_cell(mining.near_miss_world(read(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id")), theta, 1)).withColumn("theta", F.lit(theta))
        cells = c if cells is None else cells.unionByName(c)
    return mining.campaign(cells).select("decision")


GATED = """g as (select event_type as cell, case when event_id % 3 = 0 then 'leakage' else 'composition' end as class, case when event_id % 11 <> 0 then event_id % 100 / 100.0::double end as confidence, event_id % 7 as fired, least(event_id % 7, event_id % 5) as matched, value as precision, event_id % 2 = 0 as other from events), d as (select *, case when confidence is null or fired = 0 then 1 else 1 - matched / fired end as risk from g), a as (select *, confidence is not null and confidence >= 0.55 and risk <= 0.5 as ok from d)"""


@query(f"with {GATED} select cell, count(*) as n_rules, round(avg((not ok)::int) filter (where class = 'leakage'), 8) as reject_leakage, round(avg(ok::int) filter (where class = 'composition'), 8) as keep_composition, round(avg(precision) filter (where ok and class = 'composition') - coalesce(avg(precision) filter (where ok and class = 'leakage'), 0), 6) as delta, round(avg((ok = other)::int), 8) as agreement from a group by cell")
def m23_gate_stats(spark, sf):
    i = F.col("event_id")
    r = read(spark, sf, "events").select(F.col("event_type").alias("cell"), F.when(i % 3 == 0, "leakage").otherwise("composition").alias("class"), F.when(i % 11 != 0, (i % 100) / 100.0).alias("confidence"), (i % 7).alias("fired"), F.least(i % 7, i % 5).alias("matched"), F.col("value").alias("precision"), (i % 2 == 0).alias("other_admitted"))
    out = mining.gate_stats(mining.gated(r), ["cell"])
    return out.select("cell", "n_rules", *[F.round(c, 8).alias(c) for c in ("reject_leakage", "keep_composition")], F.round("delta", 6).alias("delta"), F.round("agreement", 8).alias("agreement"))


# Learning cascade

def in_region(spark, sf) -> DataFrame:
    """(head, relation, tails): the region of every customer, which no edge states."""
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(_id("C", "c_custkey").alias("head"), F.lit("in_region").alias("relation"), F.array(_id("R", "n_regionkey")).alias("tails"))


@query("""with u as (select c_custkey, cast('0x' || substr(md5('7|C' || c_custkey || '|lives_in|N' || c_nationkey), 1, 8) as bigint) / 4294967296.0::double as u from customer)
select 2 as tier, 1 as answers, true as nation, count(*) as n from u where u >= 0.9 having count(*) > 0""")
def c2_warmup(spark, sf):
    """Where a tenth of all customers live, by tier 2: embeddings are fitted to the nations of eight tenths and to who manages whom, and calibrated on another tenth."""
    split = staged(graph.split(kg(spark, sf, "lives_in").filter("src LIKE 'C%'"), (0.8, 0.1, 0.1), 7))
    part = lambda name: split.filter(F.col("split") == name).select("src", "rel", "dst")
    named = lambda e: e.select(F.col("src").alias("head"), F.col("rel").alias("relation"), F.col("dst").alias("tail"))
    types = relation_types(spark).filter("name IN ('lives_in', 'part_of', 'manages')")
    s = cascade.Session(kg(spark, sf, "part_of", "manages").union(part("train")), [], in_region(spark, sf), cascade.Tiers(accept=0.0), learn=False, embed=True, nodes=kg_nodes(spark, sf), relations=types, dim=8, rounds=2)
    s.warmup(named(part("valid")))
    asked = named(part("test")).select(F.substring("head", 2, 20).cast("long").alias("idx"), "head", "relation")
    nation = F.coalesce(F.get("answers", F.lit(0)).startswith("N"), F.lit(False))
    return s.ask(asked).groupBy("tier", F.size("answers").alias("answers"), nation.alias("nation")).agg(F.count("*").alias("n"))


@query("with c as (select row_number() over (order by c_custkey) <= ceil(count(*) over () / 3) as first from customer join nation on c_nationkey = n_nationkey) select case when first then 3 else 1 end as tier, count(*) as n, round(count(*) * case when first then 0.05::double else 0.0001::double end, 4) as cost, 1.0::double as accuracy, 1 as rules from c group by first")
def c18_full(spark, sf):
    """In three batches, the region of every customer; the teacher tells those of the first, which is mined, and the rule answers all others."""
    true = in_region(spark, sf)
    s = cascade.Session(kg(spark, sf, "lives_in", "part_of"), [], true)
    w = staged(true.select(F.substring("head", 2, 20).cast("long").alias("idx"), "head", "relation"))
    out = cascade.run_stream(s, w, max(1, -(-w.count() // 3)))
    right = F.avg(evaluation.exact(F.col("answers"), F.coalesce("tails", cascade.none())).cast("double"))
    return out.join(true, ["head", "relation"], "left").groupBy("tier").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"), F.round(right, 6).alias("accuracy")).withColumn("rules", F.lit(len(s.rules)))


@query("select * from (values ('before', (select count(*) from orders), 1), ('retired', 1, 0), ('after', 0, 0), ('ingested', (select count(*) from customer where c_custkey % 10 = 0), 0)) t(step, n, rules)")
def c21_service(spark, sf):
    """Asked of every order; told that all answers are wrong, the service retires the rule; then new facts come in by the gates."""
    lives = kg(spark, sf, "placed_by", "lives_in")
    s = service.Service(cascade.Session(lives, [ORDER_NATION], Nobody(), learn=False), kg_nodes(spark, sf), relation_types(spark))
    w = read(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), _id("O", "o_orderkey").alias("head"), F.lit("order_nation").alias("relation"))
    step = lambda name, n: n.select(F.lit(name).alias("step"), "n").withColumn("rules", F.lit(len(s.session.rules)))
    answered = lambda df: df.agg(F.count(F.when(F.col("tier") == 1, 1)).alias("n"))
    out = step("before", answered(s.ask(w)))
    gone = s.feedback(w.select("head", "relation", F.lit(False).alias("correct")))
    out = out.union(step("retired", spark.range(1).select(F.lit(len(gone)).cast("long").alias("n"))))
    out = out.union(step("after", answered(s.ask(w.withColumn("idx", F.col("idx") + 1_000_000_000)))))
    new = read(spark, sf, "customer").filter("c_custkey % 10 = 0").select(F.lit(0).alias("doc_id"), F.lit(0).alias("n"), F.col("c_custkey").alias("pos"), _id("O", F.col("c_custkey") + 500_000_000).alias("src"), F.lit("placed_by").alias("rel"), _id("C", "c_custkey").alias("dst"))
    return out.union(step("ingested", s.ingest(new).filter("status = 'added'").agg(F.count("*").alias("n"))))


class Nobody:
    """A teacher that knows nothing."""

    def __call__(self, head: str, relation: str) -> list[str]:
        return []


@query(f"with {LOG} select relation, count(*) as n, round(count(*) * 0.5::double, 4) as cost, 0.7::double as accept, 5 as trigger_, 'a|b' as models from log group by relation")
def c24_settings(spark, sf):
    """What the log would cost if a teacher were asked everything, under settings from the session's configuration; it is left as it was."""
    own = {"graphloom.tier.cost": "0.001,0.01,0.5", "graphloom.tier.accept": "0.7", "graphloom.trigger": "5", "graphloom.models": "a,b"}
    for k, v in own.items():
        spark.conf.set(k, v)
    got = service.settings(spark)
    for k in own:
        spark.conf.unset(k)
    l = log(spark, sf)
    asked = cascade.llm_only(l.select("idx", "head", "relation"), l.select("head", "relation").distinct().withColumn("tails", cascade.none()), got["tiers"])
    out = asked.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"))
    return out.select("*", F.lit(got["tiers"].accept).alias("accept"), F.lit(got["trigger"]).alias("trigger_"), F.lit("|".join(got["models"])).alias("models"))


@query(f"with {LOG}, r as (select idx, idx % 3 as t from log) select t::int as teacher, count(*) as n from (select case when idx % 3 = 1 and idx between 100 and 500 then 2 else idx % 3 end as t from r) group by t")
def c10_rotation(spark, sf):
    cooling = spark.createDataFrame([(1, 100, 500)], "teacher int, from_idx long, to_idx long")
    return cascade.rotated(log(spark, sf).select("idx"), 3, cooling).groupBy("teacher").agg(F.count("*").alias("n"))


@query("with c as (select user_id, event_id as idx, case when event_id % 5 = 0 then value else (event_id % 100 * 0.2 + (event_id % 50 + event_id % 9) * 0.6) / 1000 end as usd from events) select user_id, idx, round(sum(usd) over (partition by user_id order by idx), 4) as usd_so_far from c")
def c14_metered(spark, sf):
    """Usage as JSON under either of two vocabularies, priced and summed up."""
    i = F.col("event_id")
    one = F.to_json(F.struct((i % 100).alias("prompt_tokens"), (i % 50).alias("completion_tokens"), (i % 9).alias("reasoning_tokens"), F.when(i % 5 == 0, F.col("value")).alias("cost")))
    two = F.to_json(F.struct((i % 100).alias("input_tokens"), (i % 50).alias("output_tokens"), F.struct((i % 9).alias("reasoning_tokens")).alias("completion_tokens_details"), F.when(i % 5 == 0, F.col("value")).alias("cost")))
    calls = read(spark, sf, "events").select("user_id", i.alias("idx"), F.lit("m").alias("model"), F.lit(False).alias("reasoning_included_in_completion"), F.when(i % 2 == 0, one).otherwise(two).alias("usage"))
    prices = spark.createDataFrame([("m", 0.2, 0.6)], "model string, prompt_per_1k double, completion_per_1k double")
    return cascade.metered(calls, prices, "user_id").select("user_id", "idx", F.round("usd_so_far", 4).alias("usd_so_far"))


@query("with v as (select l_orderkey, l_suppkey, count(distinct l_linenumber) as n from lineitem where l_linenumber <= 3 group by all), w as (select l_orderkey from lineitem where l_linenumber <= 3 group by 1 having count(distinct l_linenumber) = 3) select concat('O', k.l_orderkey) as head, coalesce(string_agg('S' || l_suppkey, ',' order by 'S' || l_suppkey), '') as answers from w k left join v on v.l_orderkey = k.l_orderkey and n >= 2 group by 1")
def c15_k_samples(spark, sf):
    l = read(spark, sf, "lineitem")
    whole = l.filter("l_linenumber <= 3").groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("n")).filter("n = 3").select("l_orderkey")
    s = l.filter("l_linenumber <= 3").join(whole, "l_orderkey").groupBy("l_orderkey", (F.col("l_linenumber") - 1).alias("sample")).agg(F.collect_list(_id("S", "l_suppkey")).alias("answers"))
    return cascade.k_samples(s.select(_id("O", "l_orderkey").alias("head"), F.lit("supplier").alias("relation"), "sample", "answers"), 3).select("head", joined("answers"))


@query("select concat('O', o_orderkey) as head, case when o_orderkey % 2 = 0 then 'Where does O' || o_orderkey || ' go?' else 'What is the placed by of O' || o_orderkey || '?' end as question from orders")
def c17_composition(spark, sf):
    rel = F.when(F.col("o_orderkey") % 2 == 0, "order_nation").otherwise("placed_by")
    t = spark.createDataFrame([("order_nation", "Where does {head} go?")], "relation string, template string")
    return cascade.composition_teacher(read(spark, sf, "orders").select(_id("O", "o_orderkey").alias("head"), rel.alias("relation")), t).select("head", "question")


ARMS = """c as (select row_number() over (order by o_orderkey) - 1 as idx, 'O' || o_orderkey as case_id, [ 'priority=' || o_orderpriority, 'segment=' || c_mktsegment, 'status=' || o_orderstatus ] as atoms, case when o_orderpriority = '1-URGENT' then 'prohibit' else 'permit' end as verdict, case when o_orderpriority = '1-URGENT' then 'art9' else '' end as articles from orders join customer on o_custkey = c_custkey)"""


def arms(spark, sf):
    """Orders as cases in the order of their keys, and a teacher that prohibits what is urgent."""
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    place = evaluation.running_sum(o.withColumn("one", F.lit(1)), "one", "o_orderkey", None, "idx", before=True)
    cid = _id("O", "o_orderkey").alias("case_id")
    cases = staged(place.select(F.col("idx").cast("long").alias("idx"), cid, F.array(F.concat(F.lit("priority="), "o_orderpriority"), F.concat(F.lit("segment="), "c_mktsegment"), F.concat(F.lit("status="), "o_orderstatus")).alias("atoms")))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    teacher = o.select(cid, F.when(urgent, "prohibit").otherwise("permit").alias("verdict"), F.when(urgent, F.array(F.lit("art9"))).otherwise(cascade.none()).alias("articles"), F.lit(0.05).alias("usd"))
    return cases, staged(teacher)


def _arm_totals(out: DataFrame) -> DataFrame:
    return out.groupBy("verdict", joined("articles")).agg(F.count("*").alias("n"), F.count(F.when(F.col("teacher_call"), 1)).alias("calls"), F.round(F.sum("usd"), 4).alias("usd"))


@query(f"with {ARMS} select verdict, articles, count(*) as n, count(*) as calls, round(count(*) * 0.05::double, 4) as usd from c group by all")
def c19_llm_only(spark, sf):
    return _arm_totals(cascade.arm_llm_only(*arms(spark, sf)))


@query(f"with {ARMS}, f as (select *, row_number() over (partition by atoms order by idx) = 1 as new from c) select verdict, articles, count(*) as n, count(*) filter (where new) as calls, round(count(*) filter (where new) * 0.05::double, 4) as usd from f group by all")
def c19_cache(spark, sf):
    return _arm_totals(cascade.arm_cache(*arms(spark, sf)))


FROZEN = f"""{ARMS}, a as (select idx, unnest(atoms) as atom, verdict from c), one as (select idx, [atom] as p, verdict from a), two as (select a.idx, [a.atom, b.atom] as p, a.verdict from a join a b on a.idx = b.idx and a.atom < b.atom), three as (select a.idx, [a.atom, b.atom, d.atom] as p, a.verdict from a join a b on a.idx = b.idx and a.atom < b.atom join a d on d.idx = a.idx and b.atom < d.atom), pat as (from one union all from two union all from three),
m as (select p, count(*) as matched, count(*) filter (where verdict = 'prohibit') as art, count(*) filter (where verdict = 'permit') as ok from pat where idx < 300 group by p having count(*) >= 5),
f as (select idx, bool_or(art >= 5 and 100 * art >= 90 * matched) as art, bool_or(ok >= 5 and 100 * ok >= 90 * matched) as ok from pat join m using (p) where idx >= 300 group by idx),
o as (select verdict, articles, idx < 300 or coalesce(art, false) = coalesce(ok, false) as call from c left join f using (idx))"""


@query(f"with {FROZEN} select verdict, articles, count(*) as n, count(*) filter (where call) as calls, round(count(*) filter (where call) * 0.05::double, 4) as usd from o group by all")
def c19_compile_once(spark, sf):
    """Rules of the first 300 cases answer what comes, where they don't contradict each other."""
    return _arm_totals(cascade.arm_compile_once(*arms(spark, sf), 300))


@query(f"with {ARMS}, f as (select *, row_number() over (partition by atoms order by idx) = 1 as new from c where idx < 300) select verdict, articles, count(*) as n, (select count(*) from f where new and f.verdict = c.verdict) as calls, round((select count(*) from f where new and f.verdict = c.verdict) * 0.05::double, 4) as usd from c group by all")
def c19_full(spark, sf):
    """Blocks of 300 at first, then all others: the first has no rules yet and pays for each set of atoms once; rules answer the rest."""
    return _arm_totals(cascade.arm_full(*arms(spark, sf), [300]))


@query("""with recursive v as (select row_number() over (order by vec_id) as k, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from embeddings), m as (
  select 0::bigint as k, []::double[][] as mem, 0::bigint as told union all
  select v.k, case when len(list_filter(mem, lambda x: list_dot_product(x, v.v) >= 0.2)) > 0 then mem else list_append(mem, v.v) end, case when len(list_filter(mem, lambda x: list_dot_product(x, v.v) >= 0.2)) > 0 then told else told + 1 end from m join v on v.k = m.k + 1
), l as (select k, told from m order by k desc limit 1)
select unnest([true, false]) as teacher_call, unnest([told, k - told]) as n, round(unnest([told, k - told]) * 0.05, 4) as usd from l""")
def c19_retrieved(spark, sf):
    """All vectors, in order: covered by an earlier one in the memory, or put to the teacher."""
    v = vectors(spark, sf)
    cases = v.select(F.col("id").alias("idx"), F.col("id").cast("string").alias("case_id"), "v")
    t = v.select(F.col("id").cast("string").alias("case_id"), F.lit("permit").alias("verdict"), cascade.none().alias("articles"), F.lit(0.05).alias("usd"))
    out = cascade.arm_retrieved(cases, t, t, 0.2)
    return out.groupBy("teacher_call").agg(F.count("*").alias("n"), F.round(F.sum("usd"), 4).alias("usd"))


@query("select event_id as id from events where event_id % 50 <> 0")
def c25_valid_ingests(spark, sf):
    i = F.col("event_id")
    t = F.array(F.struct(F.col("event_type").alias("src"), F.lit("r").alias("rel"), F.when(i % 50 == 0, "much too long").otherwise("ok").alias("dst")))
    return cascade.valid_ingests(read(spark, sf, "events").select(i.alias("id"), t.alias("triples")), chars=10).select("id")


# Text

@query(r"select doc_id, 0 as pos, 'text' as src, 'starts' as rel, regexp_extract(text, '^[A-Za-z]+') as dst from documents where regexp_extract(coalesce(text, ''), '^[A-Za-z]+') <> ''")
def i2_called(spark, sf):
    import re

    def first(text: str) -> list[tuple[str, str, str]]:
        m = re.match(r"[A-Za-z]+", text)
        return [("text", "starts", m.group(0))] if m else []

    return T.call_extractor(read(spark, sf, "documents").select("doc_id", "text"), first)


@query("select 1::bigint as documents, count(*) as triples, count(*) filter (where o_orderkey % 10 > 3) as added, count(*) filter (where o_orderkey % 10 = 3) as duplicate, count(*) filter (where o_orderkey % 10 = 0) as unknown_relation, count(*) filter (where o_orderkey % 10 = 1) as type_violation, count(*) filter (where o_orderkey % 10 = 2) as functional from orders")
def i5_report(spark, sf):
    o = read(spark, sf, "orders")
    k, src = F.col("o_orderkey") % 10, _id("O", "o_orderkey")
    t = o.select(F.lit(0).alias("doc_id"), F.lit(0).alias("n"), F.col("o_orderkey").alias("pos"), src.alias("src"), F.when(k == 0, "paid_by").otherwise("placed_by").alias("rel"), F.when(k == 1, "N1").otherwise(_id("C", "o_custkey")).alias("dst"))
    have = o.filter(k.isin(2, 3)).select(src.alias("src"), F.lit("placed_by").alias("rel"), F.when(k == 2, "C-1").otherwise(_id("C", "o_custkey")).alias("dst"))
    return T.ingest_report(T.ingest(t, kg_nodes(spark, sf), have, relation_types(spark)))


@query("""with w as (select p_partkey as p, list_sum(list_transform(string_split(t, ''), lambda c: ascii(c))) % 64 as slot, count(*)::double as n from (select p_partkey, unnest(list_filter(string_split_regex(lower(p_name), '\\s+'), lambda x: x <> '')) as t from part) group by all),
norm as (select p, sqrt(sum(n * n)) as norm from w group by p),
sign as (select i, k, case when ascii(upper(substr(md5('0:' || i || ':' || k), 1, 1))) % 2 = case when substr(md5('0:' || i || ':' || k), 1, 1) between '0' and '9' then 0 else 1 end then 1.0 else -1.0 end as s from (select range as i from range(64)), (select range as k from range(16))),
v as (select w.p, k, round(sum(n / norm * s) / 8, 6) as x from w join norm using (p) join sign on i = slot group by all)
select 'P' || p as id, list(x order by k) filter (where k < 8) as re, list(x order by k) filter (where k >= 8) as im from v group by p""")
def k7_text_start(spark, sf):
    """Part names as a start for embeddings: hashed words by a random projection."""
    p = read(spark, sf, "part").select(_id("P", "p_partkey").alias("id"), F.col("p_name").alias("text"))
    six = lambda c: F.transform(c, lambda x: F.round(x, 6) + 0.0).alias(c)
    return link.seeded(p, 8).select("id", six("re"), six("im"))


@query()
def k6_trained(spark, sf):
    """K6: rotations with self-adversarial negatives on all of where customers, suppliers and nations are; ranks of held-out tails before and after."""
    split = staged(graph.split(kg(spark, sf, "lives_in", "part_of"), (0.8, 0.1, 0.1), 7))
    near = places(spark, sf)
    one = lambda name, rounds: link.evaluated(split, 8, rounds, "rotate", near).withColumn("model", F.lit(name))
    return one("start", 0).unionByName(one("rotate", 3))


def places(spark, sf):
    """What can be the tail of each of the two relations."""
    rels = spark.createDataFrame([("lives_in", ["Nation"]), ("part_of", ["Region"])], "name string, range array<string>")
    return graph.candidates(kg_nodes(spark, sf).filter("type IN ('Nation', 'Region')"), rels)


@query()
def k9_evaluated(spark, sf):
    return link.evaluated(graph.split(kg(spark, sf, "lives_in", "part_of"), (0.8, 0.1, 0.1), 7), 8, 3, candidates=places(spark, sf))


# Evaluation

@query("select o_orderstatus as status, count(*) as n, count(*) filter (where o_orderkey % 3 = 0) as exact, count(*) filter (where o_orderkey % 3 <> 1) as covered from orders group by 1")
def a1_correct(spark, sf):
    i = F.col("o_orderkey")
    o = read(spark, sf, "orders").select("o_orderstatus", F.when(i % 3 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("a"))).when(i % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("said"))
    gold = F.array(F.lit("a"), F.lit("b"))
    n = lambda c: F.count(F.when(c, 1))
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), n(evaluation.exact(F.col("said"), gold)).alias("exact"), n(evaluation.contains_gold(F.col("said"), gold)).alias("covered"))


EXPERIMENTS = """runs as (select ['E1', 'E3', 'E4', 'E5', 'E6'][user_id % 5 + 1] as experiment, 's' || (user_id % 3) as system, event_type as tag, value as total_cost, value / 100 as accuracy, value * 10 as latency from events),
named as (select *, case experiment when 'E1' then system when 'E3' then tag when 'E4' then tag else system || '|' || tag end as name from runs),
each as (select experiment, name, 'cost' as value, total_cost as x from named union all select experiment, name, 'accuracy', accuracy from named union all select experiment, name, 'latency_ms', latency from named where experiment = 'E1')"""


def runs(spark, sf):
    u = F.col("user_id")
    e = F.element_at(F.array(*[F.lit(x) for x in ("E1", "E3", "E4", "E5", "E6")]), (u % 5 + 1).cast("int"))
    return read(spark, sf, "events").select(e.alias("experiment"), F.concat(F.lit("s"), (u % 3).cast("string")).alias("system"), F.col("event_type").alias("tag"), F.col("value").alias("total_cost"), (F.col("value") / 100).alias("accuracy"), (F.col("value") * 10).alias("avg_latency_ms"))


@query(f"with {EXPERIMENTS} select experiment, name, value, count(*) as n, round(avg(x), 6) as mean, round(coalesce(stddev_samp(x), 0), 6) as sd from each group by all")
def a8_experiments(spark, sf):
    return evaluation.experiments(runs(spark, sf)).select("experiment", "name", "value", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"with {EXPERIMENTS} select name as system, round(avg(x) filter (where value = 'cost'), 6) as cost, round(avg(x) filter (where value = 'accuracy'), 6) as accuracy, round(avg(x) filter (where value = 'latency_ms'), 6) as latency_ms, 100.0::double as percent_without_llm from each where experiment = 'E1' group by name")
def a26_main_table(spark, sf):
    r = runs(spark, sf)
    shares = evaluation.tier_shares(r.filter("experiment = 'E1'").select("system", F.lit(0).alias("run"), F.when(F.col("tag") == "view", 1).otherwise(2).alias("tier")))
    t = evaluation.main_table(evaluation.experiments(r), shares)
    return t.select("system", *[F.round(c, 6).alias(c) for c in ("cost", "accuracy", "latency_ms", "percent_without_llm")])


@query(f"with {EXPERIMENTS} select list_position(['purchase', 'view', 'no'], name)::bigint as place, name as tag, round(avg(x) filter (where value = 'cost'), 6) as cost, round(avg(x) filter (where value = 'accuracy'), 6) as accuracy from each where experiment = 'E4' and name in ('purchase', 'view', 'no') group by name")
def a26_ablation_table(spark, sf):
    t = evaluation.ablation_table(evaluation.experiments(runs(spark, sf)), ["purchase", "view", "no"])
    return t.select("place", "tag", F.round("cost", 6).alias("cost"), F.round("accuracy", 6).alias("accuracy"))


SWEEP = """cells as (select user_id % 3 * 0.1::double as gamma, user_id % 4 * 0.05::double as error_rate, event_id as seed, value as saved, value / 100 as acc, event_id % 3 = 0 as installed, value / 100 - 0.3 as delta, value / 100 - 0.3 >= -0.02 as ok from events)"""


def cells(spark, sf):
    u, i, v = F.col("user_id"), F.col("event_id"), F.col("value")
    c = read(spark, sf, "events").select((u % 3 * F.lit(0.1)).alias("gamma"), (u % 4 * F.lit(0.05)).alias("error_rate"), i.alias("seed"), v.alias("calls_saved_pct"), (v / 100).alias("cache_accuracy"), (v / 100).alias("teacher_answer_accuracy"), (i % 3 == 0).alias("rule_installed"), (v / 100 - 0.3).alias("accuracy_delta"))
    return c.withColumn("cell_valid", evaluation.cell_valid(F.col("accuracy_delta"))).withColumn("synthesised_rules", F.when(F.col("rule_installed"), F.array(F.lit("r")))).withColumn("rule_world_precision", F.when(F.col("rule_installed"), F.col("cache_accuracy")))


@query(f"with {SWEEP} select round(error_rate, 4) as error_rate, count(*) as n_seeds, round(avg(saved), 6) as mean_saved, count(*) filter (where installed) as n_installed, round(count(*) filter (where installed) / count(*), 8) as p_installed, round(avg(delta), 6) as mean_accuracy_delta, count(*) filter (where not ok) as n_invalid, case when avg(saved) >= 20 then 'reduces' when avg(saved) >= 0 then 'neutral' else 'costs' end as verdict from cells group by 1")
def a12_error_rates(spark, sf):
    e = evaluation.error_rates(cells(spark, sf), ["error_rate"])
    return e.select(F.round("error_rate", 4).alias("error_rate"), "n_seeds", F.round("mean_saved", 6).alias("mean_saved"), "n_installed", F.round("p_installed", 8).alias("p_installed"), F.round("mean_accuracy_delta", 6).alias("mean_accuracy_delta"), "n_invalid", "verdict")


@query(f"with {SWEEP} select round(gamma, 4) as gamma, round(error_rate, 4) as error_rate, count(*) as n_seeds, round(avg(acc), 6) as arm_accuracy, round(count(*) filter (where installed) / count(*), 8) as p_install, round(avg(saved), 6) as mean_saved, round(avg(acc) filter (where installed), 6) as mean_precision, count(*) filter (where not ok) as n_invalid from cells group by 1, 2")
def a14_oracle_cells(spark, sf):
    e = evaluation.oracle_cells(cells(spark, sf))
    return e.select(F.round("gamma", 4).alias("gamma"), F.round("error_rate", 4).alias("error_rate"), "n_seeds", F.round("arm_accuracy", 6).alias("arm_accuracy"), F.round("p_install", 8).alias("p_install"), F.round("mean_saved", 6).alias("mean_saved"), F.round("mean_precision", 6).alias("mean_precision"), "n_invalid")


@query(f"{PAIRS} select count(distinct src) as asked, count(distinct src) as answered, 1.0::double as coverage, 1.0::double as validity from closed")
def a16_proofs(spark, sf):
    e = kg(spark, sf, "manages")
    closed = staged(fixpoint.closure(e, MANAGES))
    w = closed.select(F.col("src").alias("head"), F.col("rel").alias("relation")).distinct()
    return evaluation.proof_metrics(fixpoint.answers(closed, w), fixpoint.grounded(closed, e, ["ax:trans:manages"]))


@query("select count(*) as n, round(avg((o_orderkey % 4 <> 0)::int), 8) as accuracy from orders")
def a20_teacher_accuracy(spark, sf):
    i = F.col("o_orderkey")
    o = read(spark, sf, "orders")
    key = [_id("O", "o_orderkey").alias("head"), F.lit("r").alias("relation")]
    said = o.select(*key, F.when(i % 4 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("a"))).alias("answers"))
    return evaluation.teacher_accuracy(said.union(said), o.select(*key, F.array(F.lit("a"), F.lit("b")).alias("tails"))).select("n", F.round("accuracy", 8).alias("accuracy"))


MATRIX = """runs as (select teacher, seed, unnest(['llm_only', 'cache', 'full']) as arm from (select distinct 't' || (user_id % 3) as teacher, user_id % 7 as seed from events)), c as (select *, (seed + 1) * case arm when 'llm_only' then 10 when 'cache' then 5 else 2 end::double as cost, seed / 10.0::double as f1 from runs)"""


@query(f"with {MATRIX} select teacher, arm, count(*) as n, round(avg(case arm when 'llm_only' then 1 when 'cache' then 2 else 5 end), 6) as factor_mean, 0.0::double as factor_sd, round(avg(f1), 6) as f1 from c group by teacher, arm")
def a27_matrix(spark, sf):
    u = F.col("user_id")
    base = read(spark, sf, "events").select(F.concat(F.lit("t"), (u % 3).cast("string")).alias("teacher"), (u % 7).alias("seed")).distinct()
    arm = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(float(k)).alias("k")) for a, k in (("llm_only", 10), ("cache", 5), ("full", 2))])).alias("a")
    r = base.select("*", arm).select("teacher", "seed", "a.arm", ((F.col("seed") + 1) * F.col("a.k")).alias("cost"), F.lit(1.0).alias("accuracy"), (F.col("seed") / 10.0).alias("f1"))
    m = evaluation.teacher_matrix(r)
    return m.select("teacher", "arm", "n", F.round("factor_mean", 6).alias("factor_mean"), F.round("factor_sd", 6).alias("factor_sd"), F.round("f1", 6).alias("f1"))


@query("select round(avg(user_id))::bigint as distinct_patterns, round(sum(value), 4) as spend from events")
def a27_totals(spark, sf):
    m = evaluation.matrix_totals(read(spark, sf, "events").select(F.col("user_id").alias("distinct_patterns"), F.col("value").alias("spend")))
    return m.select("distinct_patterns", F.round("spend", 4).alias("spend"))


@query(f"with {LOG}, o as (select user_id % 5 as seed, relation, tier, correct, case when idx % 2 = 0 then 'cache' else 'full' end as arm from log), c as (select relation, seed, count(*) filter (where arm = 'cache' and tier = 3) as cc, count(*) filter (where arm = 'full' and tier = 3) as fc, avg(correct::int) filter (where arm = 'cache') as ca, avg(correct::int) filter (where arm = 'full') as fa from o group by all) select relation, seed, cc as cache_calls, fc as full_calls, round(case when cc = 0 then 0 else 100.0 * (cc - fc) / cc end, 6) as calls_saved_pct, round(fa - ca, 6) as accuracy_delta, fa - ca >= -0.02 as cell_valid from c")
def a28_sweep(spark, sf):
    o = log(spark, sf).select((F.col("user_id") % 5).alias("seed"), "relation", "tier", "correct", F.when(F.col("idx") % 2 == 0, "cache").otherwise("full").alias("arm"))
    s = evaluation.sweep(o, ["relation"])
    return s.select("relation", "seed", "cache_calls", "full_calls", F.round("calls_saved_pct", 6).alias("calls_saved_pct"), F.round("accuracy_delta", 6).alias("accuracy_delta"), "cell_valid")


# Causal graphs and plans

from graphloom.queries import SCM  # noqa: E402


@query(f"{SCM} select round(avg(y), 8) as probability, count(*) as n from s where x = 1")
def x3_probability(spark, sf):
    m, units = scm(spark, sf)
    return m.probability(units, "y", 1, evidence={"x": 1}).select(F.round("probability", 8).alias("probability"), "n")


@query(f"{SCM} select 'association' as estimand, round(avg(y) filter (where x = 1), 8) as value from s union all select 'do_1', round(avg(y_do1), 8) from s union all select 'do_0', round(avg(y_do0), 8) from s union all select 'average_effect', round(avg(y_do1) - avg(y_do0), 8) from s")
def x9_estimands(spark, sf):
    m, units = scm(spark, sf)
    return m.estimands(units, "x", "y").select("estimand", F.round("value", 8).alias("value"))


@query(f"with recursive {DAG}, a as (select dst as x, count(*) as n from c group by 1), d as (select src as x, count(*) as n from c group by 1), p as (select dst as x, string_agg(src, ',' order by src) as z from e group by 1) select e.src as x, e.dst as y, coalesce(p.z, '') as backdoor, coalesce(a.n, 0) as ancestors, coalesce(d.n, 0) as descendants from e left join p on p.x = e.src left join a on a.x = e.src left join d on d.x = e.src")
def x6_graph(spark, sf):
    """X6 to X8 on a causal graph that is a table: of each cause x of y, what to adjust for, and how many variables lead to x and from it."""
    e = staged(customer_dag(spark, sf).select("src", "dst"))
    pairs = e.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    lines = causal.lineages(e)
    z = causal.backdoor_sets(e, pairs, lines).groupBy("x", "y").agg(F.collect_list("z").alias("backdoor"))
    n = lambda c, name: lines.groupBy(F.col(c).alias("x")).agg(F.count("*").alias(name))
    out = pairs.join(z, ["x", "y"], "left").join(n("dst", "ancestors"), "x", "left").join(n("src", "descendants"), "x", "left")
    return out.select("x", "y", F.coalesce(joined("backdoor"), F.lit("")).alias("backdoor"), F.coalesce("ancestors", F.lit(0)).alias("ancestors"), F.coalesce("descendants", F.lit(0)).alias("descendants"))


@query("select concat('S', s_suppkey) as supplier, 2.0::double as cost, 'move(S' || s_suppkey || ', N' || s_nationkey || ', hub),move(S' || s_suppkey || ', hub, port)' as steps from supplier")
def p3_plans(spark, sf):
    """Each supplier's ship goes to the port by way of the hub; that it is ready there follows by a rule."""
    move = planner.Action("move", (("?a", "at", "?b"), ("?b", "road", "?c")), (("?a", "at", "?c"),), (("?a", "at", "?b"),))
    rules = [Rule("ready", (("?a", "at", "port"),), ("?a", "ready", "yes"))]

    ships = read(spark, sf, "supplier").select(_id("S", "s_suppkey").alias("q"), _id("N", "s_nationkey").alias("n"))
    fact = lambda s, r, o: F.struct(s.alias("src"), F.lit(r).alias("rel"), o.alias("dst"))
    starts = ships.select("q", F.array(fact(F.col("q"), "at", F.col("n")), fact(F.col("n"), "road", F.lit("hub")), fact(F.lit("hub"), "road", F.lit("port"))).alias("facts"))
    goals = ships.select("q", F.col("q").alias("src"), F.lit("ready").alias("rel"), F.lit("yes").alias("dst"))
    found = frontier.plans(starts, goals, [move], rules, max_depth=3)
    return found.select(F.col("q").alias("supplier"), "cost", F.array_join("steps", ",").alias("steps"))


# Dynamics

@query(f"with {STATES}, x as (select distinct src, dst, min(valid_from) as f from states group by src, dst) select step, count(*) as n from x, (select unnest([1, 2, 3]) as step) where f <= 1705000000 group by step")
def p4_identity_rollout(spark, sf):
    m = dynamics.IdentityWorldModel(temporal.states(read(spark, sf, "events")))
    m.observe(1705000000.0)
    return m.rollout(3).groupBy("step").agg(F.count("*").alias("n"))


@query(f"with {STATES}, e as (select src as id, valid_from as f from states union all select dst, valid_from from states), s as (select id, min(f) as f from e group by id), k as (select case when id like 'U%' then 'User' else 'Entity' end as type, f from s) select t as instant, type, round(count(*) / sum(count(*)) over (partition by t), 8) as share from k, (select unnest([1704500000, 1705000000])::double as t) where f <= t group by t, type")
def p5_bag_of_types(spark, sf):
    st = temporal.states(read(spark, sf, "events"))
    nodes = st.select(F.col("src").alias("id"), F.lit("User").alias("type")).distinct()
    times = spark.createDataFrame([(1704500000.0,), (1705000000.0,)], "instant double")
    return dynamics.bag_of_types(st, nodes, times).select("instant", "type", F.round("share", 8).alias("share"))


@query("with e as (select floor(epoch(ts) / 86400) * 86400 as instant, event_type as type, user_id from events), v as (select vec_id as id, embedding[1]::double as x from embeddings), m as (select instant, round(avg(x), 6) as first from e join v on v.id = user_id group by instant), k as (select instant, round((count(*) filter (where type = 'view')) / count(*), 8) as views from e group by instant) select k.instant::double as instant, views, first from k left join m using (instant)")
def p5_actions(spark, sf):
    e = read(spark, sf, "events").select((F.floor(temporal.seconds("ts") / 86400) * 86400).cast("double").alias("instant"), F.col("event_type").alias("type"), F.col("user_id").alias("actor"), F.col("user_id").alias("target"))
    a = dynamics.actions_as_nodes(e, vectors(spark, sf).select("id", "v"))
    return a.select("instant", F.round(F.coalesce(F.try_element_at("kinds", F.lit("view")), F.lit(0.0)), 8).alias("views"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query(f"with {STATES}, f as (select src, dst, min(valid_from) as f from states group by src, dst), n as (select src, dst from f where f > 1705000000 and f <= 1705086400), s as (select src, k.dst, length(k.dst)::double as score from (select distinct src from states) u, (select distinct dst from states) k), r as (select n.src, n.dst, 1 + (select count(*) from s where s.src = n.src and s.score > length(n.dst) and s.dst <> n.dst and not exists (select 1 from n m where m.src = n.src and m.dst = s.dst)) as rank from n) select count(*) as n, round(coalesce(avg(1 / rank), 0), 8) as mrr, round(coalesce(avg((rank <= 1)::int), 0), 8) as hits1 from r")
def p7_single_step(spark, sf):
    st = temporal.states(read(spark, sf, "events"))
    all_pairs = st.select("src").distinct().crossJoin(st.select("dst").distinct())  # users by three states
    scored = all_pairs.select(F.lit(1705000000.0).alias("instant"), "src", F.lit("in_state").alias("rel"), "dst", F.length("dst").cast("double").alias("score"))
    return dynamics.forecast_ranks(st, scored, 86400.0).select("n", F.round("mrr", 8).alias("mrr"), F.round("hits1", 8).alias("hits1"))


@query("select step, 50::bigint as n, 1.0::double as coherent from (select unnest([1, 2]) as step)")
def p7_coherence(spark, sf):
    """Every edge that a state without change rolls out is one that the ontology allows."""
    m = dynamics.IdentityWorldModel(kg(spark, sf, "contains").withColumn("valid_from", F.lit(0.0)))
    m.observe(0.0)
    return dynamics.rollout_coherence(m.rollout(2), kg_nodes(spark, sf), relation_types(spark), 50)


@query(f"with {STATES}, f as (select src, dst, min(valid_from) as f from states group by src, dst), k as (select unnest([1, 2]) as step) select step, 1.0::double as precision, round((select count(*) from f where f <= 1705000000) / (select count(*) from f where f <= 1705000000 + 86400 * step), 8) as recall from k")
def p7_fidelity(spark, sf):
    st = temporal.states(read(spark, sf, "events"))
    m = dynamics.IdentityWorldModel(st)
    m.observe(1705000000.0)
    return dynamics.rollout_fidelity(m.rollout(2), st, 1705000000.0, 86400.0).select("step", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))
