"""Queries of merging by any strategy, interval fixpoints, closures kept up to date, and streams with state; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.operators import evaluation, federation, temporal
from graphloom.plans import fixpoint, intervals, maintain, views
from graphloom.plans.rules import Rule
from graphloom.plans.stage import shared_dir
from graphloom.queries import ASSERTIONS, KG, MANAGES, STATES, _id, assertions, kg, query, read
from graphloom.sources import properties, vocabulary
from graphloom.streaming import state

# Federation


@query(f"with {ASSERTIONS} select src, rel, dst, count(*) as records, count(distinct writer) as n_writers from ab group by src, rel, dst having max(trust) >= 0.9 and min(trust) >= 0.5")
def g4_predicate(spark, sf):
    """Kept where somebody is sure and nobody unsure: a predicate over a triple's records, as they come."""

    def sure(records) -> bool:
        best = 0.0
        for r in records:
            if r["trust"] < 0.5:
                return False
            best = max(best, r["trust"])
        return best >= 0.9

    return federation.merge(*assertions(spark, sf), sure)


@query(f"with {ASSERTIONS} select src, rel, dst, count(*) as records, count(distinct writer) as n_writers from ab group by src, rel, dst having max(trust) - min(trust) >= 0.4")
def g4_fold(spark, sf):
    """Kept where writers differ much: the least and the greatest trust, of parts of the records, then of all."""
    spread = federation.Fold(lambda: (1.0, 0.0), lambda s, r: (min(s[0], r["trust"]), max(s[1], r["trust"])), lambda s, t: (min(s[0], t[0]), max(s[1], t[1])), lambda s: s[1] - s[0] >= 0.4)
    return federation.merge(*assertions(spark, sf), spread)


# Time

#: Who hears of whose states: users follow the one of half their number for the month's first twenty days, and hear what those hear.
FOLLOWS = (Rule("hears", (("?y", "follows", "?x"), ("?x", "in_state", "?s")), ("?y", "hears", "?s")), Rule("hears_of", (("?y", "follows", "?x"), ("?x", "hears", "?s")), ("?y", "hears", "?s")))


@query(f"""with recursive {STATES}, users as (select distinct user_id as u from events where user_id > 0), above as (
  select u, u // 2 as v from users union select above.u, above.v // 2 from above where above.v > 0 and above.v in (select u from users)
), h as (
  select concat('U', above.u) as src, states.dst, greatest(valid_from, 1704067200.0::double) as f, least(coalesce(valid_to, 'infinity'::double), 1705795200.0::double) as t
  from above join states on states.src = concat('U', above.v)
), n as (
  select *, max(t) over (partition by src, dst order by f, t rows between unbounded preceding and 1 preceding) as reach from h where f < t
), r as (
  select *, sum((reach is null or f > reach)::int) over (partition by src, dst order by f, t rows unbounded preceding) as run from n
) select src, dst, min(f) as valid_from, max(t) as valid_to from r group by src, dst, run""")
def t4_interval_closure(spark, sf):
    """The fixpoint of rules over intervals: one run for all instants, each fact with the times at which it holds."""
    e = read(spark, sf, "events")
    users = e.filter("user_id > 0").select("user_id").distinct()
    follows = users.select(_id("U", "user_id").alias("src"), F.lit("follows").alias("rel"), _id("U", F.floor(F.col("user_id") / 2)).alias("dst"), F.lit(1704067200.0).alias("valid_from"), F.lit(1705795200.0).alias("valid_to"))
    return intervals.interval_closure(temporal.states(e).unionByName(follows), list(FOLLOWS)).filter("rel = 'hears'").select("src", "dst", "valid_from", "valid_to")


# Maintenance

#: Everyone below someone by either of two relations: most pairs have several derivations.
OVER = (Rule("manager", (("?x", "manages", "?y"),), ("?x", "over", "?y")), Rule("mentor", (("?x", "mentors", "?y"),), ("?x", "over", "?y")), Rule("both", (("?x", "over", "?y"), ("?y", "over", "?z")), ("?x", "over", "?z")))
STAFF = """staff as (
  select c_custkey // 2 as s, 'manages' as rel, c_custkey as d from customer where c_custkey >= 2
  union all select c_custkey // 3, 'mentors', c_custkey from customer where c_custkey >= 3
)"""
GONE = "substr(md5(concat(rel, d)), 1, 1) = '0'"


def staff(spark, sf):
    c = read(spark, sf, "customer")
    edge = lambda rel, k: c.filter(F.col("c_custkey") >= k).select(_id("C", F.floor(F.col("c_custkey") / k)).alias("src"), F.lit(rel).alias("rel"), _id("C", "c_custkey").alias("dst"))
    return edge("manages", 2).union(edge("mentors", 3))


def gone(edges):
    return edges.filter(F.substring(F.md5(F.concat("rel", F.substring("dst", 2, 20))), 1, 1) == "0")


@query(f"with recursive {STAFF}, e as (select * from staff where not ({GONE})), o as (select s, d from e union select o.s, e.d from o join e on o.d = e.s) select concat('C', s) as src, concat('C', d) as dst from o")
def c3_facts_deleted(spark, sf):
    """The closure after one edge in sixteen has gone, from the closure before."""
    e = staff(spark, sf)
    closed = fixpoint.closure(e, list(OVER), by_steps=True)
    return maintain.deleted(closed, list(OVER), gone(e)).filter("rel = 'over'").select("src", "dst")


@query(f"with recursive {STAFF}, m as (select * from staff where rel = 'manages'), o as (select s, d from m union select o.s, m.d from o join m on o.d = m.s) select concat('C', s) as src, concat('C', d) as dst from o")
def c3_rule_retired(spark, sf):
    """The closure after the mentors' rule has retired, from the closure before."""
    closed = fixpoint.closure(staff(spark, sf), list(OVER), by_steps=True)
    return maintain.deleted(closed, list(OVER), retired=["mentor"]).filter("rel = 'over'").select("src", "dst")


@query(f"with recursive {STAFF}, o as (select s, d from staff union select o.s, staff.d from o join staff on o.d = staff.s) select concat('C', s) as src, concat('C', d) as dst from o")
def c21_facts_inserted(spark, sf):
    """The closure of all edges, from that of fifteen in sixteen."""
    e = staff(spark, sf)
    left = e.join(gone(e), ["src", "rel", "dst"], "left_anti")
    closed = fixpoint.closure(left, list(OVER), by_steps=True)
    return maintain.inserted(closed, list(OVER), gone(e)).filter("rel = 'over'").select("src", "dst")


# Streams


def _events(spark, sf):
    """The table as a stream; a pattern, as a path without one has to be a folder."""
    return spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""with l as (select event_type as rule, event_id as idx, user_id as head, event_id % 40 <> 0 as agrees from events), f as (select rule, head, agrees, min(idx) as idx from l group by all), r as (select *, row_number() over (partition by rule, agrees order by idx) as n from f), m as (select rule, min(idx) filter (where not agrees) as no, min(idx) filter (where agrees and n = 3) as yes from r group by rule)
select rule, case when yes is not null and (no is null or yes < no) then 'promoted' when no is not null then 'demoted' else 'shadow' end as state, case when yes is not null and (no is null or yes < no) then yes else no end as at from m""")
def m24_shadow_stream(spark, sf):
    """m24_shadow as a stream with keyed state; the second run goes on from the first one's checkpoint and finds nothing new."""
    log = _events(spark, sf).select(F.col("event_type").alias("rule"), F.col("event_id").alias("idx"), F.col("user_id").alias("head"), (F.col("event_id") % 40 != 0).alias("agrees"))
    at = state.folder(spark, "shadow")
    state.shadow_run(log, at)
    return state.shadow_run(log, at)


@query("select a.event_id as id, v.event_id as said, v.value > 5 as correct from events a join events v on a.user_id = v.user_id and a.event_type = 'view' and v.event_type = 'purchase' and v.ts >= a.ts and v.ts <= a.ts + interval 6 hours")
def c22_feedback_stream(spark, sf):
    """Views joined to the user's purchases in the six hours after, as verdicts on them, by two streams."""
    head = F.col("user_id").alias("head")
    asks = _events(spark, sf).filter("event_type = 'view'").select(F.col("event_id").alias("id"), head, "ts")
    says = _events(spark, sf).filter("event_type = 'purchase'").select(head, F.struct(F.col("event_id").alias("said"), (F.col("value") > 5).alias("ok")).alias("correct"), F.col("ts").alias("said_at"))
    pairs, _ = state.marked_run(asks, says, state.folder(spark, "marks"), "6 hours")
    return pairs.select("id", "correct.said", F.col("correct.ok").alias("correct"))


# Vocabulary


@query("""with d as (select p_name as v, row_number() over (order by p_name) - 1 as place from (select distinct p_name from part)), b as (select *, place // 20 as batch, count(*) over (partition by place // 20) as n, row_number() over (partition by place // 20 order by v) as k from d)
select v as value, case when batch % 3 = 1 and k = n then 'other' when substr(v, length(v)) = 'y' then 'other' else 'ends_' || substr(v, length(v)) end as category, case when batch % 3 = 0 then 1 else 2 end as asked from b""")
def s26_vocabulary(spark, sf):
    """All part names mapped in batches of 20: of three batches one is answered at once, one at the second time, and one falls short twice."""
    parts = read(spark, sf, "part")
    names = parts.select(F.concat(F.lit("Ends "), F.substring("p_name", -1, 1)).alias("c")).filter("c <> 'Ends y'")
    numbers = {r.p_name: r.place for r in vocabulary.placed(parts, "p_name").filter("place % 20 = 0").collect()}  # one name of each batch, for the mock

    class Mock:
        def __init__(self) -> None:
            self.asked: dict[str, int] = {}

        def __call__(self, values, categories):
            kind = numbers[values[0]] // 20 % 3
            self.asked[values[0]] = n = self.asked.get(values[0], 0) + 1
            said = ["Ends_" + v[-1] for v in values]
            return said[:-1] if kind == 1 or kind == 2 and n == 1 else said

    return vocabulary.mapped(parts, "p_name", vocabulary.categories_of(names, "c"), Mock(), 20)


# Properties


@query("""with e as (select event_id, case when event_id % 50 = 0 then substr(props, 1, length(props) - 1) else props end as p, value, user_id from events)
select event_id, json_valid(p) = false as malformed, case when json_valid(p) then (p::json->>'k')::double + 0.5 end as k_half, case when json_valid(p) then value end as v, case when json_valid(p) then user_id % 3 end as third from e""")
def i8_variant(spark, sf):
    """Properties of all events, nested, written as VARIANT and read back; one text in fifty is no JSON."""
    e = read(spark, sf, "events").withColumn("text", F.when(F.col("event_id") % 50 == 0, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props")))
    whole = F.when(F.try_parse_json("text").isNotNull(), F.concat(F.lit('{"p": '), "text", F.lit(', "in": [{"v": '), F.col("value").cast("string"), F.lit(', "third": '), (F.col("user_id") % 3).cast("string"), F.lit("}]}"))).otherwise(F.col("text"))
    path = f"{shared_dir(spark)}/variant-{uuid.uuid4().hex}"
    properties.write(properties.parsed(e.select("event_id", whole.alias("text")), "text").drop("text"), path)
    back = spark.read.parquet(path)
    return back.select("event_id", "malformed", (properties.number("props", "$.p.k") + 0.5).alias("k_half"), properties.number("props", "$.in[0].v").alias("v"), F.try_variant_get("props", "$.in[0].third", "bigint").alias("third"))


# SQL


@query(f"with recursive {KG}, c as (select src, dst from kg where rel = 'manages' union select c.src, k.dst from c join kg k on k.rel = 'manages' and c.dst = k.src) select src, count(*) as n from c group by src")
def sql_closure(spark, sf):
    """The closure as a view, in SQL text."""
    views.register(spark, "staffing", kg(spark, sf, "manages"), rules=MANAGES)
    return spark.sql("SELECT src, count(*) AS n FROM staffing_closure GROUP BY src")


@query(f"with {KG} select a.id, k.rel, k.dst from (select 'N' || n_nationkey as id from nation) a join kg k on k.src = a.id")
def sql_neighbours(spark, sf):
    """A table function, joined to the rows that it is asked for, in SQL text."""
    views.register(spark, "places", kg(spark, sf, "lives_in", "part_of"))
    read(spark, sf, "nation").createOrReplaceTempView("places_asked")
    return spark.sql("SELECT a.id, o.rel, o.dst FROM (SELECT concat('N', n_nationkey) AS id FROM places_asked) a, LATERAL places_out(a.id) o")


@query(f"with {STATES} select dst, count(*) as n, count(distinct src) as users from states where valid_from <= 1705000000 and (valid_to is null or 1705000000 < valid_to) group by dst")
def sql_slice(spark, sf):
    """A slice in time as a table function, in SQL text."""
    views.register(spark, "history", temporal.states(read(spark, sf, "events")))
    return spark.sql("SELECT dst, count(*) AS n, count(DISTINCT src) AS users FROM history_at(1705000000D) GROUP BY dst")


# Evaluation


@query(f"""with v as (select s_suppkey as i, s_acctbal::double as v from supplier), g as (
  select d, v, list_sum(list_transform({list(evaluation.POISSON)}, lambda x: (u >= x)::int)) as w from (select d, v, cast('0x' || substr(md5('12345:' || d || ':' || i), 1, 8) as bigint) / 4294967296.0::double as u from v, (select range as d from range(400)))
), m as (select sum(v * w) / sum(w) as m from g group by d having sum(w) > 0)
select (select round(avg(v), 6) from v) as mean, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m""")
def a10_poisson(spark, sf):
    """The bootstrap in one pass: every value counts a Poisson number of times in each draw."""
    v = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("i"), F.col("s_acctbal").cast("double").alias("v"))
    return evaluation.poisson_bootstrap(v, 400).select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])
