"""Operational windows over query logs, for tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets, in seconds.
BUCKETS = (0.005, 0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)


def _late(log: DataFrame, delay: str) -> DataFrame:
    return log.withWatermark("ts", delay) if log.isStreaming else log


def rates(log: DataFrame, size: str = "5 minutes", slide: str = "1 minute", seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """(start, n, qps, usd_per_hour, tier3_ratio) for each sliding window: counts over the window's length."""
    g = _late(log, late).groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.avg((F.col("tier") == 3).cast("double")).alias("tier3_ratio"))
    return g.select(F.col("window.start").alias("start"), "n", (F.col("n") / seconds).alias("qps"), (F.col("cost") / seconds * 3600).alias("usd_per_hour"), "tier3_ratio")


def by_tier(log: DataFrame, size: str = "1 minute", seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """(start, tier, n, qps) for each tumbling window."""
    g = _late(log, late).groupBy(F.window("ts", size), "tier").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "tier", "n", (F.col("n") / seconds).alias("qps"))


def verdicts(log: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    g = _late(log, late).groupBy(F.window("ts", size), "correct").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "correct", "n")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's rows without a longer gap."""
    g = _late(log, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def histogram(log: DataFrame) -> DataFrame:
    """(tier, le, n) of latencies in seconds, for every bucket, the open one as infinity."""
    le = F.lit(float("inf"))
    for b in reversed(BUCKETS):
        le = F.when(F.col("latency_ms") <= 1000 * b, b).otherwise(le)
    counts = log.groupBy("tier", le.alias("le")).agg(F.count("*").alias("n"))
    grid = log.select("tier").distinct().select("tier", F.explode(F.array(*[F.lit(float(b)) for b in (*BUCKETS, float("inf"))])).alias("le"))
    return grid.join(counts, ["tier", "le"], "left").select("tier", "le", F.coalesce("n", F.lit(0)).alias("n"))


def quantiles(hist: DataFrame, qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(tier, q, seconds): linear inside the first bucket that reaches q of all; the last finite bound for the open one."""
    w = Window.partitionBy("tier").orderBy("le")
    c = hist.withColumn("upto", F.sum("n").over(w)).withColumn("lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("total", F.sum("n").over(Window.partitionBy("tier")))
    c = c.select("*", F.explode(F.array(*[F.lit(q) for q in qs])).alias("q"))
    need = F.col("q") * F.col("total")
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * (need - (F.col("upto") - F.col("n"))) / F.nullif("n", F.lit(0))
    value = F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(inside)
    return c.filter((F.col("upto") >= need) & (F.col("n") > 0)).groupBy("tier", "q").agg(F.min_by(value, "le").alias("seconds"))


def cumulative_cost(log: DataFrame) -> DataFrame:
    """(tier, minute, total): running cost by minute; minutes are summed first."""
    m = log.groupBy("tier", F.date_trunc("minute", "ts").alias("minute")).agg(F.sum("cost").alias("cost"))
    return m.select("tier", "minute", F.sum("cost").over(Window.partitionBy("tier").orderBy("minute")).alias("total"))


def to_table(stream: DataFrame, path: str, checkpoint: str, key: list[str]) -> object:
    """Append-only sink that a replayed batch can't double: each batch writes a folder of its own, over what it wrote before."""

    def write(df: DataFrame, batch: int) -> None:
        df.dropDuplicates(key).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ask_stream(stream: DataFrame, session, path: str, checkpoint: str) -> object:
    """The cascade over a stream of questions: each micro-batch is asked, its answers are written back and its records appended."""

    def run(df: DataFrame, batch: int) -> None:
        session.ask(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
