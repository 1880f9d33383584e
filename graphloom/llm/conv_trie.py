"""Prefix trie of conversations from sorted turn arrays.

Conversations are sorted over the whole cluster by their turns, as digests of
role and text, and by id.  Neighbours share as many turns as their longest
common prefix (LCP) has; each task sweeps its sorted rows with a stack, and an
interval of rows that share a prefix becomes a node when the LCP falls below
its depth.  A node on the path of a task's first or last row may go on in
another task: it stays open, each task gives its piece, and the pieces are
stitched by the digest of the prefix.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import staged, text_of, tuned

#: Children or ids that a node on the stack holds at most; a node with more is open from then on, and hands them out.
HELD = 1 << 14
#: Conversations of one block have the same first turns, as far as a rebuilt one takes them, and so many turns of it at most.
BLOCK, HEAD = 100, 5
NOTHING = hashlib.sha256(b"").hexdigest()


def _turns(turns: DataFrame) -> DataFrame:
    """(conv_id, t) with t = (turn, key, chars): key stands for role and text, chars counts the text's code points."""
    role, text = text_of("role"), text_of("text")
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    t = F.struct(F.col("turn"), F.substring(key, 1, 16).alias("key"), F.length(text).cast("long").alias("chars"))
    return turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), t.alias("t"))


def _arrays(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", F.transform("ts", lambda t: t["key"]).alias("keys"), F.transform("ts", lambda t: t["chars"]).alias("chars"))


def turn_arrays(turns: DataFrame) -> DataFrame:
    """(conv_id, keys, chars) of each conversation in turns(conv_id, turn, role, text): as it is, null turns first.

    Rows of the same turn are turns of their own, in the order of their digests.
    Null roles and texts are empty ones.  Rows without conv_id belong to no
    conversation and are left out.  Other columns are ignored.
    """
    return _arrays(_turns(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, keys, chars): of each conversation c, the first h turns of conversation c - c % BLOCK, then its own after its first h; h = crc32(c) % (HEAD + 1).

    Ordered and read as in turn_arrays.  A conversation without turns left is
    there with empty arrays.  c % BLOCK has the sign of c.
    """
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    own = _turns(turns).withColumn("base", base).repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    heads = own.filter(F.col("conv_id") == F.col("base")).select("base", F.slice("ts", 1, HEAD).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("ts", 1, 0))
    tail = F.slice("ts", F.col("h") + 1, F.greatest(F.size("ts") - F.col("h"), F.lit(0)))
    both = own.join(heads, "base", "left").withColumn("h", h)
    return _arrays(both.select("conv_id", F.concat(head, tail).alias("ts")))


class Node:
    """A node on the stack, as far as this task has seen it."""

    __slots__ = ("children", "chars", "convs", "depth", "digest", "ids", "leaves", "least", "open", "parent", "pieces", "saved", "turn", "waiting")

    def __init__(self, parent: Node | None, turn: bytes, chars: int, is_open: bool):
        self.parent, self.turn, self.chars, self.open = parent, turn, chars, is_open
        self.depth = parent.depth + 1 if parent else 0
        self.convs = self.children = self.leaves = self.saved = self.pieces = 0
        self.least: int | None = None
        self.digest: bytes | None = None
        self.ids, self.waiting = array("q"), []

    def key(self) -> bytes:
        """Stands for the whole prefix."""
        path, node = [], self
        while node is not None and node.digest is None:
            path.append(node)
            node = node.parent
        for x in reversed(path):
            x.digest = hashlib.blake2b((x.parent.digest if x.parent else b"") + x.turn, digest_size=16).digest()
        return self.digest


class Sweep:
    """Sorted rows of one task in; nodes, pieces of open nodes and ids that end at these out."""

    FIELDS = ("kind", "part", "at", "span", "key", "parent_key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "chars", "ends_sha256", "ids")
    SCHEMA = "kind string, part int, at long, span long, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string, ids array<long>"

    def __init__(self, part: int, held: int = HELD):
        self.part, self.held, self.at, self.out = part, held, 0, []
        self.stack: list[Node] = []
        self.last: list[bytes] = []

    def put(self, **values) -> None:
        self.out.append(values | {"part": self.part})

    def add(self, conv_id: int, keys: list[bytes], chars: list[int]) -> None:
        first = not self.stack
        if first:
            self.stack.append(Node(None, b"", 0, True))
        lcp = 0
        for x, y in zip(self.last, keys):
            if x != y:
                break
            lcp += 1
        while len(self.stack) > lcp + 1:
            self.close()
        for k in range(lcp, len(keys)):
            self.stack.append(Node(self.stack[-1], keys[k], chars[k], first))
        top = self.stack[-1]
        top.convs += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        top.ids.append(conv_id)
        if len(top.ids) >= self.held:
            self.opened(top)
            self.hand_out_ids(top)
        self.last = keys

    def opened(self, node: Node) -> None:
        """node and all above it are open from now on."""
        while node is not None and not node.open:
            node.open = True
            self.hand_out_children(node)
            node = node.parent

    def hand_out_children(self, node: Node) -> None:
        for row in node.waiting:
            self.put(**row, parent_key=node.key())
        node.waiting = []

    def hand_out_ids(self, node: Node) -> None:
        if node.ids:
            self.put(kind="ids", key=node.key(), at=self.at, ids=list(node.ids))
            self.at += 1
            node.ids = array("q")

    def close(self) -> None:
        node = self.stack.pop()
        above = node.parent
        if above is not None:
            above.convs += node.convs
            above.least = node.least if above.least is None else min(above.least, node.least)
        if node.open:
            self.hand_out_children(node)
            self.hand_out_ids(node)
            self.put(kind="piece", at=self.at, span=node.pieces + 1, key=node.key(), parent_key=above.key() if above else None, depth=node.depth, conv_id=node.least, n_convs=node.convs, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, chars=node.chars)
            self.at += 1
            if above is not None:
                above.pieces += node.pieces + 1
            return
        leaves = node.leaves or 1
        saved = node.saved + (node.convs - 1) * node.chars
        above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
        for row in node.waiting:
            self.put(**row, parent_conv_id=node.least)
        ends = hashlib.sha256(",".join(map(str, node.ids)).encode()).hexdigest() if node.ids else NOTHING
        row = {"kind": "node", "depth": node.depth, "conv_id": node.least, "n_convs": node.convs, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends}
        if above.open:
            self.put(**row, parent_key=above.key())
        else:
            above.waiting.append(row)
            if len(above.waiting) >= self.held:
                self.opened(above)

    def end(self) -> None:
        if self.stack:
            self.opened(self.stack[-1])
        while self.stack:
            self.close()

    def taken(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], schema.field(f).type) for f in self.FIELDS], schema=schema)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in Sweep.SCHEMA.split(", "))])


def swept(convs: DataFrame, held: int = HELD) -> DataFrame:
    """Rows of Sweep over (conv_id, keys, chars), sorted over all tasks.  Equal arrays are in order of conv_id, and so may lie in several tasks."""
    tuned(convs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, sweep = _arrow_schema(), Sweep(TaskContext.get().partitionId(), held)
        for b in batches:
            for conv_id, keys, chars in zip(*(c.to_pylist() for c in b.columns)):
                sweep.add(conv_id, keys, chars)
                if len(sweep.out) >= 4096:
                    yield sweep.taken(schema)
        sweep.end()
        yield sweep.taken(schema)

    ordered = convs.select("conv_id", "keys", "chars").repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    return ordered.mapInArrow(run, Sweep.SCHEMA)


def _digests(ids: DataFrame) -> DataFrame:
    """(key, ends_sha256): the ids of each open node, from all tasks in order, one list after the other, so that none has to be held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])

        for b in batches:
            for k, some in zip(b.column(0).to_pylist(), b.column(1)):
                if k != key:
                    if key is not None:
                        yield out()
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(",".join(map(str, some.as_py())).encode())
        if key is not None:
            yield out()

    return ids.repartition("key").sortWithinPartitions("key", "part", "at").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def _stitched(rows: DataFrame) -> DataFrame:
    """Open nodes of all tasks as whole nodes, with their key."""
    pieces = rows.filter(F.col("kind") == "piece")
    total = lambda *names: [F.sum(n).alias(n) for n in names]
    whole = pieces.groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *total("n_convs", "n_children", "n_leaves", "saved_tokens"), F.first("chars").alias("chars"), F.min("part").alias("part"))
    kids = whole.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    whole = whole.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = whole.select("key", "part", (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("l"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("s"))
    # What is below a node: in the order in which a task closes its open nodes, a subtree is a run of span rows that ends with its top.
    # Each open node counts in the first task that has it, where all nodes above it have pieces as well.
    at = pieces.select("part", "at", "span", "key").join(own, ["part", "key"], "left")
    w = Window.partitionBy("part").orderBy("at")
    at = at.withColumn("no", F.row_number().over(w)).withColumns({c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) for c in ("l", "s")})
    before = at.select("part", F.col("no").alias("before"), F.col("l").alias("l0"), F.col("s").alias("s0"))
    below = at.withColumn("before", F.col("no") - F.col("span")).join(before, ["part", "before"], "left").groupBy("key").agg(*(F.sum(F.col(c) - F.coalesce(F.col(c + "0"), F.lit(0))).alias(n) for c, n in (("l", "n_leaves"), ("s", "saved_tokens"))))
    ends = _digests(rows.filter(F.col("kind") == "ids"))
    whole = whole.drop("n_leaves", "saved_tokens", "more", "chars", "part").join(below, "key").join(ends, "key", "left")
    whole = whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(parents, "parent_key", "left")


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(convs: DataFrame, label: str = "trie", held: int = HELD) -> DataFrame:
    """One row per node of the trie of (conv_id, keys, chars), each conv_id once: the members with the same first depth turns.

    conv_id is the smallest member, parent_conv_id that of the node above (null
    for the root), n_convs the members, n_children the nodes right below,
    n_leaves the nodes of the subtree that have none, saved_tokens the sum over
    the subtree of (n_convs - 1) times the characters of a node's last turn, and
    ends_sha256 the digest of the ids of members with depth turns, ascending,
    with commas between.  Other columns are ignored; no conversations, no nodes.
    """
    rows = staged(swept(convs, held), label)
    whole = staged(_stitched(rows).select("key", *COLUMNS), label + "-open")
    closed = rows.filter(F.col("kind") == "node")
    inner = closed.filter(F.col("parent_key").isNull()).select(*COLUMNS)
    of_pieces = rows.filter(F.col("kind") == "piece").select("part", F.col("key").alias("parent_key")).join(whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up")), "parent_key")
    under = closed.filter(F.col("parent_key").isNotNull()).drop("parent_conv_id").join(of_pieces, ["part", "parent_key"]).withColumnRenamed("up", "parent_conv_id").select(*COLUMNS)
    return inner.unionByName(under).unionByName(whole.select(*COLUMNS))
