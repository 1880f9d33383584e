"""A log of paid answers that can be replayed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.graphs import exists

SCHEMA = "head string, relation string, answers array<string>, cost double, batch long"


class AnswerLog:
    """Answers in batches under path, with the provenance that they were recorded under.

    A batch is a folder of its own that counts once it is whole: writing it
    again replaces it, and what a crash left half written is not read.  A gap
    between batches and another provenance are errors.
    """

    def __init__(self, spark: SparkSession, path: str, provenance: dict) -> None:
        self.spark, self.path = spark, path
        text = json.dumps(provenance, sort_keys=True)
        if exists(spark, f"{path}/provenance/_SUCCESS"):
            found = spark.read.text(f"{path}/provenance").first()[0]
            if found != text:
                raise ValueError(f"{path} was recorded under {found}, not {text}")
        else:
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/provenance")

    def append(self, batch: int, answers: DataFrame) -> None:
        """answers(head, relation, answers, cost) as batch, counted from 0."""
        answers.select("head", "relation", "answers", "cost").write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch}")

    def batches(self) -> list[int]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        whole = sorted(int(n.split("=")[1]) for n in names if exists(self.spark, f"{self.path}/batches/{n}/_SUCCESS"))
        if whole != list(range(len(whole))):
            raise ValueError(f"{self.path} lacks batches before {whole[-1]}")
        return whole

    def read(self) -> DataFrame:
        """(head, relation, answers, cost, batch) of all whole batches."""
        paths = [f"{self.path}/batches/batch={b}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.option("basePath", f"{self.path}/batches").schema(SCHEMA).parquet(*paths)
        return rows.withColumn("batch", F.col("batch").cast("long"))
