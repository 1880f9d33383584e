"""What the operators of this subpackage share: words, shared tables, sizes."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.stage import staged as _staged

#: White space between words, and what a word is made of.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Rows of whole texts that go to a Python worker at once.
ARROW_ROWS = 512


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a non-null text; empty without words."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda a plain reference may be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df under their own names, dots and all."""
    return [F.col(f"`{c}`") for c in df.columns]


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back, as plans.stage does it; label names the step for readers of the code."""
    return _staged(df)


def _ship(spark: SparkSession) -> None:
    """Give the workers this package, once a context: they may lack the driver's path."""
    context = spark.sparkContext
    if getattr(context, "_graphloom", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp()) / "graphloom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(to))
    context._graphloom = True


def tuned(spark: SparkSession) -> SparkSession:
    """Ready for Python workers, with small Arrow batches: a batch of whole texts has to fit in a worker.

    The session keeps the smaller spark.sql.execution.arrow.maxRecordsPerBatch: plans are run after this returns.
    """
    _ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
