"""Assertions of several writers: trust, disagreement and merging."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["src", "rel", "dst"]
#: Parts that the records of one triple are dealt to before a Fold joins its states.
CHUNKS = 16


@dataclass(frozen=True)
class Fold:
    """A strategy in parts: start, then add each record(a dict), then join the states of parts, then keep or not.

    States are plain Python values; join must not depend on the order.
    """

    start: Callable[[], Any]
    add: Callable[[Any, dict], Any]
    join: Callable[[Any, Any], Any]
    keep: Callable[[Any], bool]


Strategy = str | Fold | Callable[[Iterable[dict]], bool]


def trust(assertions: DataFrame, writers: DataFrame) -> DataFrame:
    """(src, rel, dst, trust, writers): the best of record trust times writer trust, unknown writers counting 1."""
    a = assertions.join(writers.select("writer", F.col("trust").alias("w")), "writer", "left")
    return a.groupBy(*KEY).agg(F.max(F.col("trust") * F.coalesce("w", F.lit(1.0))).alias("trust"), F.array_sort(F.collect_set("writer")).alias("writers"))


def disagreements(assertions: DataFrame) -> DataFrame:
    """(src, rel, tails): all distinct tails that are asserted for a pair, sorted."""
    return assertions.groupBy("src", "rel").agg(F.array_sort(F.collect_set("dst")).alias("tails"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def kept_by(records: DataFrame, predicate: Callable[[Iterable[dict]], bool]) -> DataFrame:
    """The triples(src, rel, dst) of records that any predicate over a triple's records keeps.

    A triple's records come one after the other, in the order of their other
    columns, and needn't fit in memory: the predicate may stop at any of them.
    Each is a dict of all columns.  Triples are dealt by hash, so that one with
    many records is read by one task; a Fold deals these as well.
    """
    rest = [c for c in records.columns if c not in KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.string()) for i in range(3)], KEY)
            kept.clear()
            return rows

        for key, group in groupby(_records(batches), lambda r: (r["src"], r["rel"], r["dst"])):
            if predicate(group):
                kept.append(key)
                if len(kept) >= 4096:
                    yield out()
        yield out()

    dealt = records.repartition(*KEY).sortWithinPartitions(*KEY, *rest)
    return dealt.mapInArrow(run, "src string, rel string, dst string")


def folded(records: DataFrame, fold: Fold, chunks: int = CHUNKS) -> DataFrame:
    """The triples that a Fold keeps: states of parts of a triple's records first, which are few, then of the triple."""
    data = [c for c in records.columns if c not in KEY]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states: dict[tuple, Any] = {}
            for r in b.to_pylist():
                key = (r["src"], r["rel"], r["dst"], r.pop("_part"))
                states[key] = fold.add(states[key] if key in states else fold.start(), r)
            yield _states(states)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in groupby(_records(batches), lambda r: (r["src"], r["rel"], r["dst"], r["_part"])):
            state = None
            for n, r in enumerate(group):
                other = cloudpickle.loads(r["state"])
                state = other if not n else fold.join(state, other)
            yield _states({key: state})

    def _states(states: dict) -> pa.RecordBatch:
        keys = list(states)
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([k[3] for k in keys], pa.int32()), pa.array([cloudpickle.dumps(states[k]) for k in keys], pa.binary())], [*KEY, "_part", "state"])

    schema = "src string, rel string, dst string, _part int, state binary"
    part = F.pmod(F.xxhash64(*data), F.lit(chunks)).cast("int") if data else F.lit(0)
    one = records.withColumn("_part", part).mapInArrow(parts, schema)
    two = one.repartition(*KEY, "_part").sortWithinPartitions(*KEY, "_part").mapInArrow(joined, schema)
    three = two.withColumn("_part", F.lit(0)).repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(joined, schema)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([bool(fold.keep(cloudpickle.loads(s))) for s in b.column(4).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays(b.columns[:3], KEY).filter(keep)

    return three.mapInArrow(last, "src string, rel string, dst string")


def merge(a: DataFrame, b: DataFrame, strategy: Strategy = "latest_wins", threshold: float = 0.5) -> DataFrame:
    """Triples of both that the strategy keeps, with their records and writers counted.

    By name: any (latest_wins), those whose record trusts add up to the
    threshold (trust_weighted), or those of two writers or more (majority).
    Else a Fold, or any predicate over the records of a triple.
    """
    both = a.unionByName(b)
    g = both.groupBy(*KEY).agg(F.count("*").alias("records"), F.sum("trust").alias("total"), F.countDistinct("writer").alias("n_writers"))
    if isinstance(strategy, str):
        keep = {"latest_wins": F.lit(True), "trust_weighted": F.col("total") >= threshold, "majority": F.col("n_writers") >= 2}[strategy]
        return g.filter(keep).select(*KEY, "records", "n_writers")
    kept = folded(both, strategy) if isinstance(strategy, Fold) else kept_by(both, strategy)
    return g.join(kept, KEY, "left_semi").select(*KEY, "records", "n_writers")


def merge_writers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Writer trusts of both; b overrides a."""
    return b.select("writer", "trust").unionByName(a.join(b, "writer", "left_anti").select("writer", "trust"))
