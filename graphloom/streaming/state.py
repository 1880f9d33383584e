"""Streams with keyed state: shadow validation of rules, and feedback joined to questions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.plans.stage import shared_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Parts that the heads of one rule are dealt to, so that a rule of every question is no hot key.
PARTS = 16
SHADOW_SCHEMA = "rule string, part int, no long, yes array<long>"


class ShadowRules(StatefulProcessor):
    """For each rule and part of its heads: the first disagreement, and the k smallest first agreements of different heads.

    Both are least values, so that neither the order of rows nor a batch that is
    read again changes them.  A head that falls out of the k smallest can come
    back only with a smaller place, which the row itself brings.
    """

    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.no = handle.getValueState("no", "idx long")
        self.yes = handle.getMapState("yes", "head string", "idx long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        no = self.no.get()[0] if self.no.exists() else None
        before = {h[0]: i[0] for h, i in self.yes.iterator()}
        yes = dict(before)
        for batch in rows:
            wrong = batch.loc[~batch["agrees"], "idx"]
            if len(wrong):
                no = int(wrong.min()) if no is None else min(no, int(wrong.min()))
            for head, idx in batch.loc[batch["agrees"]].groupby("head", sort=False)["idx"].min().items():
                yes[head] = min(int(idx), yes.get(head, int(idx)))
            if len(yes) > self.k:
                yes = dict(sorted(yes.items(), key=lambda x: (x[1], x[0]))[: self.k])
        if no is not None:
            self.no.update((no,))
        for head in before.keys() - yes.keys():
            self.yes.removeKey((head,))
        for head, idx in yes.items():
            if before.get(head) != idx:
                self.yes.updateValue((head,), (idx,))
        yield pd.DataFrame({"rule": [key[0]], "part": [key[1]], "no": pd.array([no], dtype="Int64"), "yes": [sorted(yes.values())]})

    def close(self) -> None:
        pass


def shadow_updates(log: DataFrame, k: int = 3, parts: int = PARTS) -> DataFrame:
    """(rule, part, no, yes): the state of each key whenever rows of log(rule, idx, head, agrees), a stream, changed it.

    Null heads and rules are keys like others; rows without agrees or idx say nothing.
    """
    rows = log.filter("agrees IS NOT NULL AND idx IS NOT NULL").select("rule", F.coalesce(F.col("head").cast("string"), F.lit("")).alias("head"), F.col("idx").cast("long").alias("idx"), "agrees")
    keyed = rows.withColumn("part", F.pmod(F.xxhash64("head"), F.lit(parts)).cast("int")).groupBy("rule", "part")
    return keyed.transformWithStateInPandas(ShadowRules(k), SHADOW_SCHEMA, "Update", "None")


def shadow_states(updates: DataFrame, k: int = 3) -> DataFrame:
    """(rule, state, at) from stored updates; of a key's updates the least values are the last ones, so that repeated ones change nothing."""
    last = updates.groupBy("rule", "part").agg(F.min("no").alias("no"), F.max_by("yes", "version").alias("yes"))
    each = last.groupBy("rule").agg(F.min("no").alias("no"), F.get(F.slice(F.array_sort(F.flatten(F.collect_list("yes"))), 1, k), F.lit(k - 1)).alias("yes"))
    promoted = F.col("yes").isNotNull() & (F.col("no").isNull() | (F.col("yes") < F.col("no")))
    state = F.when(promoted, "promoted").when(F.col("no").isNotNull(), "demoted").otherwise("shadow")
    return each.select("rule", state.alias("state"), F.when(promoted, F.col("yes")).otherwise(F.col("no")).alias("at"))


@contextmanager
def rocks(spark: SparkSession):
    """RocksDB as the state store, which keyed state of this kind needs, for the streams that start inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _to_versions(out: str):
    """A sink that keeps each micro-batch under its number: one that is written again replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("version", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return write


def shadow_run(log: DataFrame, folder: str, k: int = 3) -> DataFrame:
    """Read what a stream log has now, going on where folder says that the last run ended; the states so far."""
    spark = log.sparkSession
    with rocks(spark):
        q = shadow_updates(log, k).writeStream.outputMode("update").foreachBatch(_to_versions(f"{folder}/updates")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    if q.exception():
        raise q.exception()
    schema = spark.createDataFrame([], SHADOW_SCHEMA + ", version long").schema
    stored = spark.read.schema(schema).parquet(f"{folder}/updates/batch=*") if _there(spark, f"{folder}/updates") else spark.createDataFrame([], schema)
    return shadow_states(stored, k)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def marked(asks: DataFrame, verdicts: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(id, ts, correct, said_at): asks(id, head, ts) with each of verdicts(head, correct, said_at) on their head that comes within the time.

    Tables and streams alike.  On streams both sides keep only what can still
    meet: a verdict more than late behind what was seen is dropped, and the
    progress of the query counts it.
    """
    if asks.isStreaming:
        asks, verdicts = asks.withWatermark("ts", late), verdicts.withWatermark("said_at", late)
    a, v = asks.alias("a"), verdicts.alias("v")
    meets = (F.col("a.head") == F.col("v.head")) & (F.col("v.said_at") >= F.col("a.ts")) & (F.col("v.said_at") <= F.col("a.ts") + F.expr(f"INTERVAL {within}"))
    return a.join(v, meets).select("a.id", "a.ts", "v.correct", "v.said_at")


def marked_run(asks: DataFrame, verdicts: DataFrame, folder: str, within: str = "1 hour", late: str = "10 minutes") -> tuple[DataFrame, int]:
    """marked over what both streams have now, going on where the last run ended; all pairs so far, and the rows of this run that came too late."""
    spark = asks.sparkSession
    rows = marked(asks, verdicts, within, late)
    q = rows.writeStream.outputMode("append").foreachBatch(_to_versions(f"{folder}/marks")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/marks/batch=*") if _there(spark, f"{folder}/marks") else spark.createDataFrame([], rows.schema)
    return stored, dropped


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for a stream that nobody goes on with."""
    return f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
