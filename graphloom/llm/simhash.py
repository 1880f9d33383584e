"""SimHash near-duplicates by BK-trees over shards of fingerprints.

Two fingerprints within r bits agree on some b - r of b blocks of bits.  Each
distinct fingerprint goes to one shard for every such choice of blocks, so that
any linked pair meets in at least one shard; each shard is searched by a
BK-tree that is built, queried and dropped in one task.  The trees reach their
queries by the shuffle instead of a driver broadcast, as the trees of all
shards hold every fingerprint.  A shard over shard_rows is cut into chunks; each
chunk is searched by its own tree, and its tree by each later chunk.  Tasks
return stars, not pairs: a row for each fingerprint that isn't the smallest of
those it hangs with in its shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import columns_of, staged, tuned
from graphloom.llm.components import components

BITS = 64
RADIUS = 4
SHINGLE = 4


def shingle_hashes(text: str, n: int = SHINGLE) -> np.ndarray:
    """XXH64 with seed 42 of each n-word shingle; of all words where there are fewer than n; none without words."""
    import xxhash

    # bytes.lower and bytes.split know just A-Z and the six ASCII spaces
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - np.array([len(w) + 1 for w in words])).tolist()
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if more than half of the hashes have it; 0 without hashes."""
    ones, step = np.zeros(BITS, np.int64), 1 << 16
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = [fingerprint(shingle_hashes(t.as_py() or "")) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp the 64 bits as a signed long; a null text is an empty one."""
    tuned(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def blocks_for(n: int, radius: int = RADIUS, shard: int = 4096) -> int:
    """How many blocks keep the mean shard small: with b blocks, b - radius of them, so 64 (b - radius) / b bits, agree."""
    b = radius + 1
    while b < radius + 5 and n > shard << (BITS * (b - radius) // b):
        b += 1
    return b


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """The bits that agree, as signed longs, for each choice of blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    of = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [int(np.uint64(sum(of[i] for i in c)).view(np.int64)) for c in combinations(range(blocks), blocks - radius)]


class BKTree:
    """A BK-tree over distinct fingerprints: a node for each, its children by their integer distance to it.

    Nodes are numbered; children of node i are those whose parent it is, edge
    has their distance to it.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.value = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        # a whole subtree at a time: its first is its root, the others go on by their distance to it
        todo = [np.arange(len(values))] if len(values) else []
        while todo:
            own = todo.pop()
            top, rest = int(own[0]), own[1:]
            d = np.bitwise_count(values[rest] ^ values[top])
            order = np.argsort(d, kind="stable")
            rest, d = rest[order], d[order]
            for part in np.split(rest, np.flatnonzero(d[1:] != d[:-1]) + 1) if len(rest) else []:
                self.children[top][int(np.bitwise_count(values[part[0]] ^ values[top]))] = int(part[0])
                todo.append(part)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, places of the queries within the radius of it): all queries go down at once, each along the edges within its radius."""
        todo = [(0, np.arange(len(queries)))] if len(self.value) else []
        while todo:
            node, at = todo.pop()
            d = np.bitwise_count(queries[at] ^ self.value[node]).astype(np.int16)
            yield node, at[d <= radius]
            for edge, child in self.children[node].items():
                near = at[np.abs(d - edge) <= radius]
                if len(near):
                    todo.append((child, near))


def _stars(tree: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint it hangs together with) for those that aren't the smallest; queries may be the tree's own."""
    both = np.unique(np.concatenate([tree, queries]))
    label, place, node = np.arange(len(both)), np.searchsorted(both, queries), np.searchsorted(both, tree)
    for i, hits in BKTree(tree).search(queries, radius):
        if len(hits):
            joined = np.unique(label[np.append(place[hits], node[i])])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    other = np.flatnonzero(label != np.arange(len(both)))
    return both[other], both[label[other]]


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard and pair of chunks, own chunk, fingerprint) come sorted by the former; a shard may go on in the next batch."""
        held: tuple | None = None

        def searched(cuts: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for s, n in zip(cuts[size > 1].tolist(), size[size > 1].tolist()):
                first, second, own, f = key[s, 2], key[s, 3], key[s : s + n, 4], fp[s : s + n]
                out.append(_stars(f, f, radius) if first == second else _stars(f[own == first], f[own == second], radius))
            a, b = (np.concatenate([o[i] for o in out]) if out else np.empty(0, np.uint64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for b in batches:
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns - 1)], axis=1)
            fp = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            if held is not None:
                key, fp = np.concatenate([held[0], key]), np.concatenate([held[1], fp])
            cut = np.flatnonzero((key[1:, :4] != key[:-1, :4]).any(axis=1)) + 1
            starts = np.concatenate([[0], cut]).astype(int)
            yield searched(starts[:-1], np.diff(starts))
            held = key[starts[-1] :], fp[starts[-1] :]
        if held is not None:
            key, fp = held
            yield searched(np.array([0]), np.array([len(fp)]))

    return run


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints(fp) that connect just what pairs within the radius connect."""
    n = distinct.count()
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks(blocks_for(n, radius, shard_rows), radius))])
    sharded = distinct.select("fp", F.explode(keys).alias("s")).select("fp", "s.c", "s.k")
    large = staged(sharded.groupBy("c", "k").count().filter(F.col("count") > shard_rows).select("c", "k", F.ceil(F.col("count") / shard_rows).cast("int").alias("n")), "large")
    chunks = F.coalesce(F.col("n"), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    dealt = sharded.join(large, ["c", "k"], "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.select("c", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    dealt = dealt.repartition("c", "k", "i", "j").sortWithinPartitions("c", "k", "i", "j")
    return dealt.mapInArrow(_shard_links(radius), "a long, b long")


def _classes(fps: DataFrame, radius: int) -> DataFrame:
    """(_fp, root, component_id) of distinct fingerprints from fps(doc_id, fp): root is the smallest fingerprint of the component."""
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    member = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    member = staged(member, "members")
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return staged(member.join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id"), "named")


def components_of(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs.

    Null and empty texts have fingerprint zero and are linked like any other.
    Rows that repeat a doc_id are linked each by its own text.  A null doc_id is
    no component_id unless there is no other.  Other columns are ignored; an
    empty table gives no rows.
    """
    fps = staged(fingerprints(docs), "fingerprints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(_classes(fps, radius), F.col("fp") == F.col("_fp")).select("doc_id", hexed, "component_id")


def first_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each component, the one with the smallest doc_id, with the columns of docs, whatever their names.

    Rows are chosen one by one: of rows that repeat a doc_id, those in the
    component of a smaller one go, and of those that are left in one component,
    one stays, by fingerprint and then by text.  Null doc_ids come last.  An
    empty table gives no rows.
    """
    fps = staged(fingerprints(docs), "fingerprints")
    named = _classes(fps, radius)
    placed = fps.join(named, F.col("fp") == F.col("_fp"))
    # doc_ids that stand on one row are settled by doc_id alone, without their texts
    often = staged(fps.groupBy("doc_id").count().filter((F.col("count") > 1) | F.col("doc_id").isNull()).select(F.col("doc_id").alias("_often")), "often")
    own = [f"_in{i}" for i in range(len(docs.columns))]
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), *[c.alias(o) for c, o in zip(columns_of(docs), own)])
    gone = placed.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    out = rows.join(staged(gone.union(often).distinct(), "gone"), F.col("_id").eqNullSafe(F.col("_gone")), "left_anti")
    if not often.isEmpty():
        text = own[[c.lower() for c in docs.columns].index("text")]
        few = staged(rows.join(often, F.col("_id").eqNullSafe(F.col("_often")), "left_semi"), "often_rows")
        few = few.withColumn("_h", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
        fp = fingerprints(few.select(F.col("_h").alias("doc_id"), F.col(text).alias("text")).dropDuplicates(["doc_id"])).select(F.col("doc_id").alias("_hash"), "fp")
        few = few.join(fp, F.col("_h") == F.col("_hash")).join(named, F.col("fp") == F.col("_fp")).filter(F.col("component_id").eqNullSafe(F.col("_id")))
        # a row of the component that a unique doc_id begins is out by component_id <> _id
        few = few.groupBy("root").agg(F.min_by(F.struct(*own), F.struct("fp", "_h")).alias("r"))
        out = out.select(*own).union(few.select(*[F.col(f"r.{o}") for o in own]))
    return out.select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns)])
