"""Mapping the values of an open field to few categories, batch by batch, by anyone who answers batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.evaluation import placed

OTHER = "other"
BATCH = 80


def as_category(text: Column) -> Column:
    """Lower case, runs of other characters than letters, digits and _ as one _, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_]+", "_"), F.lit("_"))


def categories_of(names: DataFrame, column: str) -> list[str]:
    """Sorted categories from proposed names, other among them; they are few, as every question carries them."""
    rows = names.select(as_category(F.col(column).cast("string")).alias("c")).filter("c IS NOT NULL AND c <> ''").distinct().collect()
    return sorted({r.c for r in rows} | {OTHER})


def mapping(ask: Callable[[list[str], list[str]], list[str]], categories: list[str]):
    """A table function over (batch, value): ask(values of a batch, categories) has to answer each value.

    An answer of another length is asked for once more; what is missing then, or
    is none of the categories, is other.
    """
    known = frozenset(categories)

    class Mapping:
        def __init__(self) -> None:
            self.values: list[str] = []

        def eval(self, row) -> None:
            self.values.append(row["value"])

        def terminate(self):
            if not self.values:
                return
            said, asked = list(ask(list(self.values), list(categories))), 1
            if len(said) != len(self.values):
                said, asked = list(ask(list(self.values), list(categories))), 2
            for value, category in zip(self.values, [*said, *[OTHER] * len(self.values)]):
                name = str(category).strip().lower()
                yield value, name if name in known else OTHER, asked

    return F.udtf(Mapping, returnType="value string, category string, asked int")


def mapped(values: DataFrame, column: str, categories: list[str], ask: Callable[[list[str], list[str]], list[str]], batch: int = BATCH) -> DataFrame:
    """(value, category, asked) of the distinct values of a column, null left out; asked counts the questions of a value's batch.

    Batches are runs of the sorted values, numbered by ranges; each is a group
    of its own, so that as many are asked at once as there are tasks.
    """
    numbered = placed(values, column).select(F.col(column).cast("string").alias("value"), F.floor(F.col("place") / batch).alias("batch"))
    return mapping(ask, categories)(numbered.asTable().partitionBy("batch").orderBy("value"))


def shares(found: DataFrame) -> DataFrame:
    """(category, n, share) of mapped values."""
    n = found.groupBy("category").agg(F.count("*").alias("n"))
    total = found.agg(F.count("*").alias("total"))
    return n.crossJoin(total).select("category", "n", (F.col("n") / F.col("total")).alias("share"))  # total is one row
