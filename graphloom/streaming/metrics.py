"""Counters, gauges and histograms over a log, in the text form that monitoring systems scrape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.streaming.dashboards import histogram


def counters(log: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """(name, labels, value): questions and cost by tier, and feedback by verdict."""
    tier = F.concat(F.lit('tier="'), F.col("tier").cast("string"), F.lit('"'))
    asked = log.groupBy(tier.alias("labels")).agg(F.count("*").cast("double").alias("n"), F.sum("cost").alias("c"))
    out = asked.select(F.lit("asks_total").alias("name"), "labels", F.col("n").alias("value")).union(asked.select(F.lit("cost_usd_total"), "labels", "c"))
    if feedback is not None:
        said = F.concat(F.lit('verdict="'), F.when(F.col("correct"), "correct").otherwise("wrong"), F.lit('"'))
        out = out.union(feedback.groupBy(said.alias("labels")).agg(F.count("*").cast("double").alias("n")).select(F.lit("feedback_total"), "labels", "n"))
    return out


def latencies(log: DataFrame) -> DataFrame:
    """(name, labels, value) of the cumulative latency buckets of each tier."""
    from pyspark.sql import Window

    h = histogram(log)
    upto = F.sum("n").over(Window.partitionBy("tier").orderBy("le"))
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    return h.select(F.lit("latency_seconds_bucket").alias("name"), F.concat(F.lit('tier="'), F.col("tier").cast("string"), F.lit('",le="'), le, F.lit('"')).alias("labels"), upto.cast("double").alias("value"))


def exposition(metrics: DataFrame) -> DataFrame:
    """(line) of metrics(name, labels, value)."""
    labels = F.when(F.length("labels") > 0, F.concat(F.lit("{"), "labels", F.lit("}"))).otherwise("")
    return metrics.select(F.concat("name", labels, F.lit(" "), F.col("value").cast("string")).alias("line"))
