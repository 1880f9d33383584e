"""Induced types, text starts and evaluated models against plain computations."""

import hashlib
import math
from collections import Counter, defaultdict


from graphloom.operators import concepts, link
from graphloom.plans.stage import staged

E = "src string, rel string, dst string"


def test_induced_types_are_the_kinds_of_nodes(spark):
    """Kinds that share nothing: clusters are exactly the groups of one signature, and the elbow finds how many there are."""
    rows = [(f"p{i}", "works", f"c{i % 4}") for i in range(20)] + [(f"d{i}", "treats", f"s{i % 5}") for i in range(15)]
    edges = spark.createDataFrame(rows, E)
    want = defaultdict(set)
    for s, r, t in rows:
        want[r + ":out"].add(s)
        want[r + ":in"].add(t)
    for members, types in (concepts.induce_types(edges, 4), concepts.induce_types_by_elbow(edges, 6)):
        groups = defaultdict(set)
        for r in members.collect():
            groups[r.cluster].add(r.id)
        signature = {r.cluster: r.signature for r in types.collect()}
        for cluster, ids in groups.items():
            share = Counter(s for i in ids for s, own in want.items() if i in own)
            assert signature[cluster] == sorted(s for s, n in share.items() if 2 * n >= len(ids))
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) or len(groups) < 4
    exact = concepts.induce_types(edges, 4)[0].groupBy("cluster").count().count()
    assert exact == 4


def test_text_starts(spark):
    texts = [("a", "Blue metal blue"), ("b", ""), ("c", None), ("d", "x  y\tZ é")]
    got = {r.id: [*r.re, *r.im] for r in link.seeded(spark.createDataFrame(texts, "id string, text string"), 3, 64, 1).collect()}
    for key, text in texts:
        n = Counter(sum(map(ord, t)) * 2 % 64 for t in (text or "").lower().split())
        norm = math.sqrt(sum(c * c for c in n.values())) or 1.0
        sign = lambda i, k: 1 if int(hashlib.md5(f"1:{i}:{k}".encode()).hexdigest()[0], 16) % 2 == 0 else -1
        want = [sum(c / norm * sign(i, k) for i, c in n.items()) / 8 for k in range(6)]
        assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(got[key], want))


def test_evaluated_ranks(spark):
    """Metrics of a model against ranks that are counted one by one from its vectors."""
    rows = [(f"c{i}", "in", f"n{i % 4}", "train") for i in range(40)] + [(f"c{i}", "in", f"n{(i + 1) % 4}", "test") for i in range(0, 40, 5)] + [("new", "in", "n0", "test")]
    split = staged(spark.createDataFrame(rows, E + ", split string"))
    near = spark.createDataFrame([("in", f"n{i}") for i in range(4)], "relation string, id string")
    for kind, candidates in (("complex", near), ("n3", None), ("rotate", near)):
        got = link.evaluated(split, 4, 1, kind, candidates, passes=2).first()
        ents, rels = ({r.id: (r.re, r.im) for r in m.collect()} for m in link.fitted(split.filter("split = 'train'"), 4, 1, kind=kind, passes=2))
        ranks = []
        for h, r, t, part in rows:
            if part == "test":
                def score(tail):
                    z = [complex(a, b) for a, b in zip(*ents[h])]  # noqa: B023
                    w = [complex(a, b) for a, b in zip(*rels[r])]  # noqa: B023
                    v = [complex(a, b) for a, b in zip(*ents[tail])]
                    if kind == "rotate":  # noqa: B023
                        return 6 - sum(abs(x * y / max(abs(y), 1e-12) - u) for x, y, u in zip(z, w, v))
                    return sum((x * y * u.conjugate()).real for x, y, u in zip(z, w, v))
                if h not in ents:
                    continue
                known = {x[2] for x in rows if x[:2] == (h, r)}
                pool = [f"n{i}" for i in range(4)] if candidates is not None else [e for e in ents if e != h]
                ranks.append(1 + sum(score(x) > score(t) + 1e-12 for x in pool if x not in known))
        assert got.n == len(ranks)
        if ranks:
            assert math.isclose(got.mrr, sum(1 / x for x in ranks) / len(ranks), abs_tol=1e-9)
            assert math.isclose(got.hits1, sum(x == 1 for x in ranks) / len(ranks), abs_tol=1e-9)
