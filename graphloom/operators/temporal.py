"""Valid time: half-open intervals [valid_from, valid_to), null for unbounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import answers, closure
from graphloom.plans.intervals import interval_closure
from graphloom.plans.rules import Rule


def valid_at(t, start: str = "valid_from", end: str = "valid_to") -> Column:
    s, e = F.col(start), F.col(end)
    return (s.isNull() | (s <= t)) & (e.isNull() | (F.lit(t) < e if not isinstance(t, Column) else t < e))


def slice_at(edges: DataFrame, t) -> DataFrame:
    return edges.filter(valid_at(t))


def slice_between(edges: DataFrame, a, b) -> DataFrame:
    """Edges valid at some instant of [a, b); those without times always are."""
    s, e = F.col("valid_from"), F.col("valid_to")
    return edges.filter((s.isNull() | (s < b)) & (e.isNull() | (F.lit(a) < e)))


def instants(edges: DataFrame, times: DataFrame, bucket: float | None = None) -> DataFrame:
    """edges of each instant of times(instant).

    With bucket, bounded intervals meet instants in buckets of that width, an
    equi-join; unbounded ones are few and meet the broadcast instants.
    """
    t = times.select("instant").distinct()
    if bucket is None:
        return edges.join(t, valid_at(F.col("instant")))
    span = edges.filter(F.col("valid_from").isNotNull() & F.col("valid_to").isNotNull())
    rest = edges.filter(F.col("valid_from").isNull() | F.col("valid_to").isNull())
    cell = lambda c: F.floor(c / bucket)
    cells = span.withColumn("_b", F.explode(F.sequence(cell(F.col("valid_from")), cell(F.col("valid_to")))))
    hit = cells.join(t.withColumn("_b", cell(F.col("instant"))), "_b").filter(valid_at(F.col("instant"))).drop("_b")
    return hit.unionByName(rest.join(t, valid_at(F.col("instant"))))


def history(edges: DataFrame, rules: list[Rule], workload: DataFrame, times: DataFrame, bucket: float | None = None) -> DataFrame:
    """workload(head, relation) at each instant with its answers: one fixpoint over intervals, which instants then look into."""
    asked = workload.select("head", "relation").distinct()
    tails = interval_closure(edges, rules).withColumnsRenamed({"src": "head", "rel": "relation"}).join(asked, ["head", "relation"])
    found = instants(tails, times, bucket).groupBy("instant", "head", "relation").agg(F.array_sort(F.collect_set("dst")).alias("answers"))
    every = asked.crossJoin(times.select("instant").distinct())  # every pair is asked at every instant
    found = every.join(found, ["instant", "head", "relation"], "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<string>")))
    return found.withColumn("answered", F.size("answers") > 0)


def query_at(edges: DataFrame, rules: list[Rule], workload: DataFrame, t) -> DataFrame:
    return answers(closure(slice_at(edges, t), rules), workload)


def query_during(edges: DataFrame, rules: list[Rule], workload: DataFrame, a, b) -> DataFrame:
    """Over all edges that overlap [a, b); a derivation may join edges that were never valid together."""
    return answers(closure(slice_between(edges, a, b), rules), workload)


def allen(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Which of Allen's thirteen relations a has to b; the first that holds, in this order."""
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    a, b, c, d = F.coalesce(a_from, low), F.coalesce(a_to, high), F.coalesce(b_from, low), F.coalesce(b_to, high)
    ordered = (
        ("before", b < c),
        ("meets", b == c),
        ("equal", (a == c) & (b == d)),
        ("starts", (a == c) & (b < d)),
        ("started_by", (a == c) & (b > d)),
        ("finishes", (b == d) & (a > c)),
        ("finished_by", (b == d) & (a < c)),
        ("during", (a > c) & (b < d)),
        ("contains", (a < c) & (b > d)),
        ("overlaps", (a < c) & (b > c) & (b < d)),
        ("overlapped_by", (a > c) & (a < d) & (b > d)),
        ("met_by", a == d),
    )
    out = F.when(ordered[0][1], ordered[0][0])
    for name, holds in ordered[1:]:
        out = out.when(holds, name)
    return out.otherwise("after")


def seconds(c: str | Column) -> Column:
    """Seconds since 1970 of a timestamp without a zone, whatever the session's zone is."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c) if isinstance(c, str) else c)


def states(events: DataFrame) -> DataFrame:
    """(src, rel, dst, valid_from, valid_to) from events(user_id, ts, event_id, event_type): a state lasts to the user's next event."""
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("src"), F.lit("in_state").alias("rel"), F.col("event_type").alias("dst"), seconds("ts").cast("double").alias("valid_from"), seconds(nxt).cast("double").alias("valid_to"))


def new_edges(edges: DataFrame, t: float, step: float = 1.0) -> DataFrame:
    """Triples first valid in (t, t + step]: what a snapshot has over the one before."""
    first = edges.groupBy("src", "rel", "dst").agg(F.min("valid_from").alias("first"))
    return first.filter((F.col("first") > t) & (F.col("first") <= t + step)).select("src", "rel", "dst")


def apply_events(events: DataFrame) -> DataFrame:
    """Edges from events(ts, type, actor, target): a missing target is the actor."""
    return events.select(F.col("actor").alias("src"), F.col("type").alias("rel"), F.coalesce("target", "actor").alias("dst"), F.col("ts").alias("valid_from"), F.lit(None).cast("double").alias("valid_to"))


def quads(rows: DataFrame, origin: str = "2014-01-01", last_write: bool = False) -> DataFrame:
    """Edges from (s, r, o, date): valid from the day counted from origin.

    Every assertion keeps its own row; last_write keeps the latest day only.
    """
    day = F.datediff(F.to_date("date"), F.to_date(F.lit(origin))).cast("double")
    out = rows.select(F.col("s").alias("src"), F.col("r").alias("rel"), F.col("o").alias("dst"), day.alias("valid_from"), F.lit(None).cast("double").alias("valid_to"))
    if last_write:
        out = out.groupBy("src", "rel", "dst").agg(F.max("valid_from").alias("valid_from")).withColumn("valid_to", F.lit(None).cast("double"))
    return out


def temporal_edge(src: Column, rel: Column, dst: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """An edge as a struct with its interval; null bounds are open."""
    bound = lambda c: F.lit(None).cast("double") if c is None else c.cast("double")
    return F.struct(src.alias("src"), rel.alias("rel"), dst.alias("dst"), bound(start).alias("valid_from"), bound(end).alias("valid_to"))


def snapshot(edges: DataFrame, t: float) -> DataFrame:
    """Distinct triples first asserted up to t: what a trajectory holds at t."""
    return edges.filter(F.col("valid_from").isNull() | (F.col("valid_from") <= t)).select("src", "rel", "dst").distinct()


def events_at(edges: DataFrame, t: float, step: float = 1.0) -> DataFrame:
    """The assertions in (t, t + step]."""
    return edges.filter((F.col("valid_from") > t) & (F.col("valid_from") <= t + step))


def transition(edges: DataFrame, t: float, step: float = 1.0) -> DataFrame:
    """(src, rel, dst, side): the triples of the snapshots before and after, and the events between."""
    side = lambda df, name: df.select("src", "rel", "dst", F.lit(name).alias("side"))
    return side(snapshot(edges, t), "before").union(side(events_at(edges, t, step), "event")).union(side(snapshot(edges, t + step), "after"))


def first_days(edges: DataFrame, days: int) -> DataFrame:
    """The edges of the first days on which anything is asserted."""
    keep = edges.select(F.floor("valid_from").alias("_d")).filter(F.col("_d").isNotNull()).distinct().orderBy("_d").limit(days)
    return edges.withColumn("_d", F.floor("valid_from")).join(keep, "_d", "left_semi").drop("_d")
