"""Graphs that change: encoders of a state, a world model that expects no change, and what its forecasts are worth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.evaluation import filtered_ranks, ranking_metrics
from graphloom.operators.ontology import allows
from graphloom.operators.temporal import snapshot


def bag_of_types(edges: DataFrame, nodes: DataFrame, times: DataFrame) -> DataFrame:
    """(instant, type, share): how the ends of the edges that are there at each of times(instant) spread over the types; the default type for unknown ends."""
    ends = edges.select("valid_from", F.explode(F.array("src", "dst")).alias("id"))
    first = ends.groupBy("id").agg(F.min("valid_from").alias("_since")).join(nodes.select("id", "type"), "id", "left").select(F.coalesce("type", F.lit("Entity")).alias("type"), "_since")
    per = first.groupBy("type", "_since").agg(F.count("*").alias("_n"))
    there = times.select("instant").distinct().join(per, F.col("_since").isNull() | (F.col("_since") <= F.col("instant"))).groupBy("instant", "type").agg(F.sum("_n").alias("n"))
    total = there.groupBy("instant").agg(F.sum("n").alias("_t"))
    return there.join(total, "instant").select("instant", "type", (F.col("n") / F.col("_t")).alias("share"))


def actions_as_nodes(events: DataFrame, vectors: DataFrame) -> DataFrame:
    """(instant, kinds, v) of events(instant, type, actor, target): a map of shares of the types, and the mean of the vectors(id, v) of all actors and targets."""
    n = events.groupBy("instant", "type").agg(F.count("*").alias("c"))
    total = events.groupBy("instant").agg(F.count("*").alias("_t"))
    kinds = n.join(total, "instant").groupBy("instant").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", (F.col("c") / F.col("_t")).alias("s"))))).alias("kinds"))
    who = events.select("instant", F.explode(F.array("actor", F.coalesce("target", "actor"))).alias("id")).join(vectors, "id")
    mean = who.select("instant", F.posexplode("v").alias("at", "x")).groupBy("instant", "at").agg(F.avg("x").alias("x"))
    v = mean.groupBy("instant").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))
    return kinds.join(v, "instant", "left")


class IdentityWorldModel:
    """Expects the state to stay as it is: the baseline that a learned model has to beat."""

    def __init__(self, edges: DataFrame) -> None:
        self.edges, self.now = edges, None

    def observe(self, t: float) -> DataFrame:
        """The snapshot at t, which is now the state."""
        self.now = snapshot(self.edges, t)
        return self.now

    def predict(self) -> DataFrame:
        """(src, rel, dst, probability) after the next step."""
        if self.now is None:
            raise ValueError("observe a state first")
        return self.now.withColumn("probability", F.lit(1.0))

    def rollout(self, steps: int) -> DataFrame:
        """(step, src, rel, dst, probability) of the next steps."""
        return self.predict().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select("step", "src", "rel", "dst", "probability")


def forecast_ranks(edges: DataFrame, scored: DataFrame, step: float = 1.0) -> DataFrame:
    """One row of ranking metrics of scored(instant, src, rel, dst, score) for the edges that are new in (instant, instant + step].

    Each new edge is ranked among the scored tails of its head and relation,
    without the other new ones; one that isn't scored has no rank.
    """
    first = edges.groupBy("src", "rel", "dst").agg(F.min("valid_from").alias("since"))
    at = F.concat_ws("\t", F.col("instant").cast("string"), "src", "rel").alias("q")
    t = scored.select("instant").distinct()
    new = first.join(t, (F.col("since") > F.col("instant")) & (F.col("since") <= F.col("instant") + step)).select(at, F.col("dst").alias("tail"))
    return ranking_metrics(filtered_ranks(scored.select(at, F.col("dst").alias("tail"), "score"), new, new))


def rollout_coherence(rolled: DataFrame, nodes: DataFrame, relations: DataFrame, top: int = 50) -> DataFrame:
    """(step, n, coherent): the share of the top edges of each step, by probability, that the ontology allows.

    The top edges of a step are found bucket by bucket, so that a step isn't
    sorted in one task.
    """
    from pyspark.sql import Window

    by = [F.desc("probability"), "src", "rel", "dst"]
    bucket = F.pmod(F.xxhash64("src", "rel", "dst"), F.lit(64))
    few = rolled.withColumn("_i", F.row_number().over(Window.partitionBy("step", bucket).orderBy(*by))).filter(F.col("_i") <= top)
    best = few.withColumn("_i", F.row_number().over(Window.partitionBy("step").orderBy(*by))).filter(F.col("_i") <= top)
    none = rolled.select("src", "rel", "dst").limit(0)
    ok = allows(best.select("step", "src", "rel", "dst"), nodes, none, relations)
    return ok.groupBy("step").agg(F.count("*").alias("n"), F.avg(F.col("allowed").cast("double")).alias("coherent"))


def rollout_fidelity(rolled: DataFrame, edges: DataFrame, start: float, step: float = 1.0) -> DataFrame:
    """(step, precision, recall) of rolled(step, src, rel, dst) against the snapshots that came."""
    steps = rolled.select("step").distinct()
    first = edges.groupBy("src", "rel", "dst").agg(F.min("valid_from").alias("since"))
    came = first.join(steps, F.col("since").isNull() | (F.col("since") <= F.lit(start) + F.col("step") * step)).select("step", "src", "rel", "dst", F.lit(1).alias("_r"))
    both = rolled.select("step", "src", "rel", "dst", F.lit(1).alias("_p")).join(came, ["step", "src", "rel", "dst"], "full")
    hit = F.count(F.when(F.col("_p").isNotNull() & F.col("_r").isNotNull(), 1))
    return both.groupBy("step").agg((hit / F.nullif(F.count("_p"), F.lit(0))).alias("precision"), (hit / F.nullif(F.count("_r"), F.lit(0))).alias("recall"))
