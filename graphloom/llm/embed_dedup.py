"""Near-duplicate embeddings by spherical-cap filters with verification.

A filter is the cap of directions whose inner product with a unit direction is
over a threshold.  The directions are a product code: after a random rotation a
vector is cut into blocks, each block has a random codebook, and a direction is
one word from each.  Decoding a vector lists all directions over the threshold
without trying each.  Vectors that share a filter are compared exactly in double
precision; each pair is counted in the first filter that it shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import staged, tuned
from graphloom.llm.components import components

THRESHOLD = 0.95
#: Filters that a vector passes on average, and vectors in one on average.
PASSES = 16
PER_FILTER = 64
#: Filters that a vector has at least.
LEAST = 16
#: Step in which the threshold of a vector with fewer is lowered; scores spread as 1 / sqrt(dimension), and so does the step.
STEP = 0.24
MOST_WORDS = 512
SEED = 20


def code_size(n: int) -> tuple[int, int]:
    """(blocks, words in each codebook) for n vectors."""
    filters, m = max(256, n * PASSES / PER_FILTER), 2
    while filters ** (1 / m) > MOST_WORDS:
        m += 1
    return m, int(np.ceil(filters ** (1 / m)))


def unit(v) -> np.ndarray | None:
    """v at length 1 in double precision; None where it has no direction.  For one vector at a time; tasks use units."""
    if v is None or not len(v) or any(x is None for x in v):
        return None
    x = np.asarray(v, np.float64)
    most = np.abs(x).max()
    if not np.isfinite(x).all() or most == 0:
        return None
    x = x / most
    return x / np.sqrt(x @ x)


class Code:
    """A structured random product code for one dimension."""

    def __init__(self, dim: int, m: int, words: int) -> None:
        rng = np.random.default_rng([SEED, dim, m, words])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.linspace(0, dim, min(m, dim) + 1).astype(int)
        self.words = words
        books = [rng.standard_normal((words, b - a)) for a, b in zip(self.cuts, self.cuts[1:])]
        self.books = [b / np.linalg.norm(b, axis=1, keepdims=True) * np.sqrt(b.shape[1] / dim) for b in books]
        filters = float(words) ** len(books)
        self.least = NormalDist().inv_cdf(1 - min(0.4, PASSES / filters)) / np.sqrt(dim)
        self.step = STEP / np.sqrt(dim)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Sorted ids of all filters that x passes.

        A vector that passes fewer than LEAST of them is given a lower threshold,
        in steps, so that no list is thin.
        """
        y = x @ self.turn
        scores = [b @ y[a:c] for b, a, c in zip(self.books, self.cuts, self.cuts[1:])]
        rest = np.append(np.cumsum([s.max() for s in scores[::-1]])[::-1], 0.0)
        least, enough = self.least, min(LEAST, self.words ** len(scores))
        while len(ids := self._over(scores, rest, least)) < enough:
            least -= self.step
        return np.sort(ids)

    def _over(self, scores: list[np.ndarray], rest: np.ndarray, least: float) -> np.ndarray:
        """Block by block; a prefix is dropped once the best that can follow leaves it under the threshold."""
        ids, sums = np.zeros(1, np.int64), np.zeros(1)
        for k, s in enumerate(scores):
            both = sums[:, None] + s[None, :]
            i, j = np.nonzero(both >= least - rest[k + 1] - 1e-12)
            ids, sums = ids[i] * self.words + j, both[i, j]
        return ids


def units(flat: np.ndarray, dim: int) -> np.ndarray:
    """Sound vectors of one dimension, one after the other, each at length 1 in double precision."""
    x = flat.reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def _decoded(m: int, words: int):
    """(id, v packed, filters) from (id, v); the vectors of a batch are read from its buffer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Code] = {}
        for b in batches:
            lists = b.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ids, packed = [], []
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
                dim = e - s
                if dim not in codes:
                    codes[dim] = Code(dim, m, words)
                ids.append(codes[dim].decode(units(flat[s:e], dim)[0]))
                packed.append(flat[s:e].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), pa.array(ids, pa.list_(pa.int64()))], ["id", "v", "filters"])

    return run


def _bucket(ids: np.ndarray, x: np.ndarray, times: np.ndarray, lower, side: np.ndarray, cross: bool, threshold: float):
    """Links inside one filter: (id, links not counted in a lower filter, smallest id linked in here).

    lower(i) has the filters of row i below this one; it is asked for linked rows only.
    """
    close = x @ x.T >= threshold
    np.fill_diagonal(close, False)
    if cross:
        close &= side[:, None] != side[None, :]
    at = np.flatnonzero(close.any(axis=1))
    if not len(at):
        return
    close = close[np.ix_(at, at)]
    lists = [lower(i) for i in at]
    _, place = np.unique(np.concatenate(lists), return_inverse=True)
    has = np.zeros((len(at), place.max(initial=-1) + 1), np.float32)
    has[np.repeat(np.arange(len(at)), [len(x) for x in lists]), place] = 1
    new = close & (has @ has.T == 0)
    links = new @ times[at]
    label = ids[at].copy()
    while True:  # the smallest id spreads over the links
        then = np.minimum(label, np.where(close, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (then == label).all():
            break
        label = then
    yield from zip(ids[at].tolist(), links.tolist(), label.tolist())


def _verified(threshold: float, m: int, words: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (dim, filter, pair of chunks, own chunk, id, times, v packed) come sorted by the first four; a group may go on in the next batch."""
        out: list[tuple] = []
        codes: dict[int, Code] = {}
        known: dict[int, np.ndarray] = {}

        def filters(id_: int, x: np.ndarray) -> np.ndarray:
            if id_ not in known:
                if len(known) > 50_000:
                    known.clear()
                if len(x) not in codes:
                    codes[len(x)] = Code(len(x), m, words)
                known[id_] = codes[len(x)].decode(x)
            return known[id_]

        def group(rows: np.ndarray, raw: bytes) -> None:
            if len(rows) > 1:
                dim, f, i, j = rows[0, :4].tolist()
                x = units(np.frombuffer(raw, kind), dim)

                def lower(r: int) -> np.ndarray:
                    own = filters(int(rows[r, 5]), x[r])
                    return own[own < f]

                out.extend(_bucket(rows[:, 5], x, rows[:, 6], lower, rows[:, 4], i != j, threshold))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "links", "root"])

        held, raw = np.empty((0, 7), np.int64), []
        for b in batches:
            rows = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(7)], axis=1)
            v = b.column(7).to_pylist()
            rows, raw = np.concatenate([held, rows]), raw + v
            starts = np.concatenate([[0], np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1, [len(rows)]])
            for s, e in zip(starts[:-2].tolist(), starts[1:-1].tolist()):
                group(rows[s:e], b"".join(raw[s:e]))
            held, raw = rows[starts[-2] :], raw[starts[-2] :]
            if len(out) > 5000:
                yield flush()
        group(held, b"".join(raw))
        yield flush()

    return run


def linked(vectors: DataFrame, threshold: float = THRESHOLD, chunk: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors(vec_id, embedding).

    Equal vectors are compared once and counted as often as they are there.
    A filter with more than chunk vectors is cut into chunks, and each pair of
    chunks is a task of its own.  Vectors that are null, empty or zero, or hold
    null or non-finite components, link with nothing, equal ones among them
    too, and so do vectors of another dimension; each is a component of its
    own.  Every row is a vector: rows that repeat a vec_id link with each other
    if their vectors do.  A null vec_id links with nothing and has no component
    but is kept.  Other columns are ignored; an empty table gives no rows.
    """
    spark = tuned(vectors.sparkSession)
    sound = F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", F.coalesce(sound, F.lit(False)).alias("_sound"))
    # -0.0 and 0.0 are the same component
    same = F.transform("embedding", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))
    keyed = rows.filter("_sound").select("vec_id", same.alias("v")).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), F.col("v")))
    keyed = staged(keyed, "keyed")
    classes = staged(keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"), F.first("v").alias("v")), "classes")
    m, words = code_size(classes.count())
    single = classes.schema["v"].dataType.elementType.simpleString() == "float"
    kind, width = ("<f4", 4) if single else ("<f8", 8)
    plain = classes.select("id", "v" if single else F.col("v").cast("array<double>"))
    found = staged(plain.mapInArrow(_decoded(m, words), "id long, v binary, filters array<long>"), "decoded")
    dim = (F.length("v") / width).cast("int").alias("dim")
    # a packed vector meets its copies in other filters by the shuffle alone
    in_filters = found.join(classes.select("id", "times"), "id").select(dim, F.explode("filters").alias("f"), "id", "v", "times")
    large = staged(found.select(dim, F.explode("filters").alias("f")).groupBy("dim", "f").count().filter(F.col("count") > chunk).select("dim", "f", F.ceil(F.col("count") / chunk).cast("int").alias("n")), "large")
    n = F.coalesce("n", F.lit(1))
    dealt = in_filters.join(large, ["dim", "f"], "left").withColumn("own", F.pmod(F.xxhash64("id"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    dealt = dealt.select("dim", "f", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "times", "v")
    dealt = dealt.repartition("dim", "f", "i", "j").sortWithinPartitions("dim", "f", "i", "j")
    per_filter = staged(dealt.mapInArrow(_verified(threshold, m, words, kind), "id long, links long, root long"), "links")
    links = per_filter.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(per_filter.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, "id", "left").join(roots, classes.id == roots.node, "left")
    named = named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    sound_rows = keyed.select("vec_id", "h1", "h2").join(staged(named, "named"), ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    others = rows.filter("NOT _sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return sound_rows.union(others).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
