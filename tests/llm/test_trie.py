"""The prefix trie of conversations against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import conv_trie

TURNS = "conv_id long, turn int, role string, text string"


def sha(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def brute(convs):
    """{conv_id: [(role, text), ...]} to rows of the trie."""
    if not convs:
        return []
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], sha(c for c in m if len(convs[c]) == len(p))) for p, m in members.items())


def rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((-1 if turn is None else turn, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in convs.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + t[h:]
    return own, out


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*conv_trie.COLUMNS).collect())


def rows_of(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), *range(1000, 1000 + n), -5, -100]:
        for k in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            rows.append((c, k, rng.choice(["user", "assistant", None]), rng.choice(["a", "", None, "é" * 3, "hello there"])))
    hot = [(c, k, "user", "same") for c in range(2000, 2000 + n) for k in range(3)]
    rows += hot + [(3000, None, "user", "null turn"), (3000, 0, "x", "zero"), (3000, None, "user", "null turn"), (None, 1, "user", "nobody's"), (4000, 0, "user", "long " * 50_000), *[(5000, k, "user", str(k)) for k in range(300)]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("held", [2, conv_trie.HELD])
@pytest.mark.parametrize("parts", [1, 7])
def test_trie(spark, held, parts):
    rows = rows_of(parts, 60)
    df = spark.createDataFrame(rows, TURNS).select("*", *[F.lit("clash").alias(c) for c in ("keys", "chars", "ts", "t", "base", "h", "head", "key", "part", "kind")])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        own, want = rebuilt(rows)
        assert got(conv_trie.nodes(conv_trie.rebuilt(df), held=held)) == brute(want)
        assert got(conv_trie.nodes(conv_trie.turn_arrays(df), held=held)) == brute(own)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sweep_in_pieces():
    """Rows cut into tasks anywhere: each conversation is counted once by every node above it."""
    rng = random.Random(3)
    rows = sorted(([bytes([rng.randrange(3)]) for _ in range(rng.randrange(6))], c) for c in range(200))
    for held, cuts in ((h, c) for h in (3, 1000) for c in ([], [50], [1, 2, 3, 100, 199], list(range(1, 200)))):
        n = 0
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, 200])):
            s = conv_trie.Sweep(part, held)
            for keys, c in rows[a:b]:
                s.add(c, keys, [1] * len(keys))
            s.end()
            n += sum(r["n_convs"] for r in s.out if r["kind"] == "piece" and r["depth"] == 0)
            spans = [r["span"] for r in s.out if r["kind"] == "piece"]
            assert spans[-1] == len(spans)
        assert n == 200


def test_empty(spark):
    empty = spark.createDataFrame([], TURNS)
    assert got(conv_trie.nodes(conv_trie.rebuilt(empty))) == []
    only = spark.createDataFrame([(7, 0, "user", "x")], TURNS)
    own, want = rebuilt([(7, 0, "user", "x")])
    assert got(conv_trie.nodes(conv_trie.rebuilt(only))) == brute(want)
