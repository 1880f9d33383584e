"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, langid_crf, line_dedup, lm_scoring, mixing, quality_rules, simhash
from graphloom.llm.queries import RANKS

SPACE = re.compile(r"[\x20\x09-\x0D]+")
CLASHING = ["n_words", "kept", "_t", "_hit", "_host", "size", "component_id", "fp", "_key", "fingerprint", "n", "words", "_id", "_copy", "_copies", "_in0", "m", "part", "copy", "root", "r.s", "base_failed", "n_lines", "_own1"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def made(seed=0, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(400)]
    line = lambda: " ".join(rng.choices(vocab, k=rng.randint(1, 12)))
    common = [line() + " one two three four five" for _ in range(3)]
    rows = []
    for i in range(n):
        lines = [line() for _ in range(rng.randint(1, 9))] + rng.sample(common, rng.randint(0, 2))
        if i % 7 == 0:
            lines += lines[:3]
        text = "\n".join(lines)
        if i % 11 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1] or "x"
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "d", "é", None]), len(text)))
    rows += [(100, None, "en", "a", None), (101, "", "fr", None, 0), (102, " \n\t ", None, "b", 4), (103, "#" * 50, "en", "a", 50), (104, "\x1c x\x85y z", "en", "a", 7)]
    rows += [(105, "one two", None, "zz", 7), (106, "one two", None, "zz", 7), rows[3], rows[3], (107, "longish word " * 30_000, "en", "a", 390_000), (108, "x" * 200_000, "en", "b", 200_000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(made(), DOCS)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


# quality rules


def measured(text):
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if words(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = Counter(windows)
    covered = {j for i, x in enumerate(windows) if c[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered), len(lines)


def verdicts(rows):
    m = [measured(r[1]) for r in rows]
    base = [x[0] < 20 or 100 * x[4] > 30 * x[0] for x in m]
    fail = [b or 100 * x[2] > 100 * x[0] or 100 * x[3] > 30 * x[5] or x[1] < 2 * x[0] or x[1] > 15 * x[0] for b, x in zip(base, m)]
    return m, base, [not b and v != "rejected" and (not f or v == "trusted") for b, f, v in zip(base, fail, host_verdict([r[3] for r in rows], fail))]


def host_verdict(hosts, fail):
    by = defaultdict(list)
    for h, f in zip(hosts, fail):
        by[h].append(f)
    n, k, m = len(fail), len(by), sum(fail) / len(fail)
    free = n - sum(len(f) ** 2 for f in by.values()) / n - (k - 1)
    spread = sum(len(f) * (sum(f) / len(f) - m) ** 2 for f in by.values())
    r = (spread - (k - 1) * m * (1 - m)) / (m * (1 - m) * free) if 0 < m < 1 and free > 0 else 0
    strength = min(1000, max(4, 1 / r - 1)) if r > 0 else 1000
    rate = {h: (sum(f) + m * strength) / (len(f) + strength) for h, f in by.items()}
    trusted = m - 0.67 * math.sqrt(m * (1 - m) / (strength + 1))
    return ["rejected" if rate[h] > 0.5 else "trusted" if rate[h] < trusted else "strict" for h in hosts]


def test_quality_rules(docs):
    m, base, kept = verdicts(made())
    want = [(r[0], *x[:5], b, k) for r, x, b, k in zip(made(), m, base, kept)]
    got = quality_rules.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    same([tuple(r) for r in got.collect()], want)
    assert any(kept) and not all(kept)


def test_quality_keeps_columns_and_rejects_hosts(spark, docs):
    _, _, kept = verdicts(made())
    out = quality_rules.kept_documents(docs)
    assert out.columns == docs.columns
    same([r.doc_id for r in out.collect()], [r[0] for r, k in zip(made(), kept) if k])
    bad = [(i, "short", "en", "junk", 5) for i in range(300)] + [(900, "word " * 5 + " ".join(f"w{j}" for j in range(40)), "en", "junk", 9)]
    good = [(1000 + i, " ".join(f"w{i}x{j}" for j in range(40)), "en", f"h{i % 9}", 9) for i in range(300)]
    kept_ids = {r.doc_id for r in quality_rules.kept_documents(spark.createDataFrame(bad + good, DOCS)).collect()}
    assert kept_ids == {r[0] for r in good}


def test_hosts_decide(spark, empty):
    """The prior leaves chance out: small hosts with one failure aren't rejected, and what fails a soft rule stays on a trusted host only."""
    clean = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    soft = lambda i: clean(i).replace("x", "##x")
    rows, i = [], 0
    for host, n, bad in [("clean", 400, 2), ("middle", 400, 60), ("poor", 400, 140), ("junk", 400, 380)] + [(f"one{k}", 1, k % 4 == 0) for k in range(40)] + [(f"two{k}", 2, k % 3 == 0) for k in range(40)] + [("five", 5, 1)]:
        for k in range(n):
            rows.append((i, soft(i) if k < bad else clean(i), "en", host, 1))
            i += 1
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality_rules.judged(df).collect()}
    want = host_verdict([r[3] for r in rows], ["#" in r[1] for r in rows])
    for r, v in zip(rows, want):
        g = got[r[0]]
        assert (g.host_rejected, g.host_trusted) == (v == "rejected", v == "trusted")
        assert g.kept == (v != "rejected" and (v == "trusted" or "#" not in r[1]))
    verdict = dict(zip((r[3] for r in rows), want))
    assert verdict["junk"] == "rejected" and verdict["clean"] == "trusted" and {v for h, v in verdict.items() if h[:3] in ("one", "two", "fiv")} == {"strict"}
    assert sorted(r.doc_id for r in quality_rules.kept_documents(df).collect()) == sorted(i for i, g in got.items() if g.kept)
    assert quality_rules.judged(empty).collect() == [] == quality_rules.kept_documents(empty).collect()


# mixing


def mix_plan(rows, share=1.5):
    size = [len(words(r[1])) for r in rows]
    total = defaultdict(int)
    for r, s in zip(rows, size):
        total[r[3]] += s
    names = sorted(total, key=lambda x: (x is None, (x or "").encode()))
    w = {x: (3, 1, 2)[i % 3] for i, x in enumerate(names)}
    target, open_, left = {}, list(names), share * sum(size)
    while open_:
        level = left / sum(w[x] for x in open_)
        over = [x for x in open_ if 2 * total[x] < level * w[x]]
        if not over:
            target.update({x: level * w[x] for x in open_})
            break
        for x in over:
            target[x] = 2.0 * total[x]
            left -= target[x]
        open_ = [x for x in open_ if x not in over]
    return size, total, target


def test_mixing(docs, empty):
    rows = made()
    size, total, target = mix_plan(rows)
    got = mixing.mixed(docs, bucket_rows=4).collect()
    same([(r.doc_id, r.size, r.source_size) for r in got], [(r[0], s, total[r[3]]) for r, s in zip(rows, size)])
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for x in total:
        assert math.isclose(next(r.target for r in got if r.source == x), target[x], abs_tol=1e-6)
        assert taken[x] == math.floor(target[x] + 1e-9)
    same([tuple(r) for r in got], [tuple(r) for r in mixing.mixed(docs.repartition(7), bucket_rows=1000).collect()])
    for x in total:  # whole epochs first: no one is a full copy behind
        own = {r.taken // r.size for r in got if r.source == x and r.size}
        assert not own or max(own) - min(own) <= 1
    assert mixing.mixed(empty).collect() == []


def test_mixing_prefers_quality(spark):
    rows = [(i, ("### " if i % 2 else "abc ") * 20, "en", s, 80) for i in range(400) for s in ("big", "small")]
    rows = [(i, t, x, s, n) for i, (_, t, x, s, n) in enumerate(rows)] + [(10_000 + i, "w " * 30_000, "en", "b2", 1) for i in range(3)]
    got = mixing.mixed(spark.createDataFrame(rows, DOCS), share=0.4, weights=(1, 1, 6)).collect()
    junk = {r[0] for r in rows if "#" in r[1]}
    part = [r for r in got if r.source == "big"]
    assert sum(r.taken for r in part if r.doc_id in junk) < sum(r.taken for r in part if r.doc_id not in junk)


@pytest.mark.parametrize("bucket_rows", [1, 4096])
def test_mixed_documents(spark, docs, empty, bucket_rows):
    """As many copies as the plan says, row by row: also of rows that repeat a doc_id, at the end of a budget too."""
    plan = Counter()
    for r in mixing.mixed(docs, bucket_rows=bucket_rows).collect():
        plan[(r.doc_id, r.size)] += 1 if r.size == 0 else r.epochs + (r.part > 0)
    out = mixing.mixed_documents(docs, bucket_rows=bucket_rows)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, len(words(r.text))) for r in out.collect())
    assert got == Counter({k: v for k, v in plan.items() if v})
    assert mixing.mixed_documents(empty).collect() == []
    rows = [(7, "a b c d", "en", "one", 7)] * 10 + [(8, "a b", "en", "two", 3)] * 3 + [(None, "x", None, None, 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    taken = Counter()
    for r in mixing.mixed(df, share=0.6, bucket_rows=bucket_rows).collect():
        taken[r.source] += r.taken
    size, total, target = mix_plan(rows, share=0.6)
    assert taken == Counter({x: math.floor(t + 1e-9) for x, t in target.items()})
    copies = Counter(r.doc_id for r in mixing.mixed_documents(df, share=0.6, bucket_rows=bucket_rows).collect())
    assert copies[7] == math.ceil(taken["one"] / 4) and 0 < copies[7] < 10


def test_mixing_ranges_stay_narrow(spark, monkeypatch):
    """A hot junk source: no more than bucket_rows documents of it are sorted in one task."""
    rng = random.Random(9)
    rows = [(i, "### " * rng.randint(0, 9) + "w " * rng.randint(0, 9), "en", "hot" if i % 3 else "cold", 1) for i in range(6000)]
    df = spark.createDataFrame(rows, DOCS)
    seen = []
    keep = mixing.staged
    monkeypatch.setattr(mixing, "staged", lambda d, label: (seen.append(d) if label == "bounds" else None, keep(d, label))[1])
    got = mixing.mixed(df, share=0.7, bucket_rows=20).collect()
    bounds = [{r["_source"]: r for r in d.collect()} for d in seen]
    assert len(bounds) >= 3 and all(r["_n"] <= 20 for r in bounds[-1].values())
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    _, _, target = mix_plan(rows, share=0.7)
    assert taken == Counter({x: math.floor(t + 1e-9) for x, t in target.items()})


def test_many_sources(spark):
    """Targets by brackets equal those by rounds of water filling."""
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 2, 40, 300]), "en", f"s{rng.randint(0, 180)}", 1) for i in range(400)]
    _, total, target = mix_plan(rows)
    got = {r.source: r.target for r in mixing.mixed(spark.createDataFrame(rows, DOCS)).collect()}
    assert got.keys() == target.keys() and all(math.isclose(got[x], target[x], abs_tol=1e-6) for x in target)


# SimHash


def brute_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, near):
    up = {i: i for i in range(len(ids))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if near(a, b):
                up[root(a)] = root(b)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(x, least.get(root(i), x))
    return [least[root(i)] for i in range(len(ids))]


def test_simhash(docs, empty):
    rows = made()
    fp = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components([r[0] for r in rows], lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 4)
    got = simhash.components_of(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    same([tuple(r) for r in got.collect()], [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fp, comp)])
    assert simhash.components_of(empty).collect() == []
    first = simhash.first_documents(docs)
    assert first.columns == docs.columns
    assert sorted(r.doc_id for r in first.collect()) == sorted({r[0] for r, c in zip(rows, comp) if r[0] == c})
    assert simhash.first_documents(empty).collect() == []


def test_first_documents_by_row(spark):
    """One row of each component, chosen by row: a repeated doc_id neither loses another text nor keeps a repeat."""
    text = {x: " ".join(f"{x}{i}" for i in range(30)) for x in "ABCDE"}
    rows = [(1, "A"), (5, "A"), (5, "B"), (7, "C"), (7, "C"), (9, "D"), (9, "E"), (None, "A"), (None, "F"), (None, "F"), (11, None), (12, None)]
    df = spark.createDataFrame([(i, text.get(x, x), "en", "s", 1) for i, x in rows], DOCS).withColumn("_id", F.lit(0)).withColumn("_fp", F.lit(0))
    name = {v: k for k, v in text.items()}
    got = sorted(((r.doc_id, name.get(r.text, r.text)) for r in simhash.first_documents(df).collect()), key=repr)
    assert got == sorted([(1, "A"), (5, "B"), (7, "C"), (9, "D"), (9, "E"), (None, "F"), (11, None)], key=repr)


@pytest.mark.parametrize("shard", [16, 4096])
@pytest.mark.parametrize("seed", [1, 2])
def test_fingerprint_links(spark, shard, seed):
    """Dense balls, chains and bridges: the links connect what the pairs connect, whole trees or cut into chunks."""
    rng = np.random.default_rng(seed)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 8):
        at = int(centre)
        for _ in range(60):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                at ^= 1 << int(b)
            fps.add(at)
            if rng.random() < 0.3:
                at = int(centre)
    fps = sorted(fps)
    comp = brute_components(fps, lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), shard_rows=shard).collect()
    up = {x: x for x in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in found:
        up[root(r.a)] = root(r.b)
    groups, want = defaultdict(set), defaultdict(set)
    for x, c in zip(signed, comp):
        groups[root(x)].add(x)
        want[c].add(x)
    same([sorted(g) for g in groups.values()], [sorted(g) for g in want.values()])


def test_blocks():
    for n in (0, 10**6, 10**9, 10**12):
        b = simhash.blocks_for(n)
        for m in simhash.masks(b):
            assert -(1 << 63) <= m < 1 << 63
        rng = random.Random(n)
        for _ in range(50):
            x = sum(1 << i for i in rng.sample(range(64), 4))
            assert any(x & (m % (1 << 64)) == 0 for m in simhash.masks(b))


# line dedup


def test_line_dedup(docs, empty):
    rows = made()
    first = {}
    for r in rows:
        if r[1] is not None and r[3] is not None:
            first[r[1]] = min(r[3], first.get(r[1], r[3]))
    sites = defaultdict(set)
    for text, site in first.items():
        for x in text.split("\n"):
            if words(x):
                sites[x].add(site)
    want = []
    for r in rows:
        lines = [] if r[1] is None else r[1].split("\n")
        stay = [x for x in lines if len(sites[x]) < 4]
        want.append((r[0], None if r[1] is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    got = line_dedup.deduped(docs, min_sites=4)
    same([tuple(r) for r in got.collect()], want)
    assert sum(x[3] for x in want) > 5
    out = line_dedup.deduped_documents(docs, min_sites=4)
    assert out.columns == docs.columns
    same([(r.doc_id, r.text, r.n_chars) for r in out.collect()], [(i, t, None if t is None else len(t)) for i, t, *_ in want])
    assert line_dedup.deduped(empty).collect() == [] == line_dedup.deduped_documents(empty).collect()


def test_copies_count_once(spark):
    """A text on twelve sites is a copy; a line in twelve texts on twelve sites is boilerplate, however short, and goes from the copy too."""
    rows = [(i, "a whole article\nwith two lines\nAll rights reserved.", "en", f"s{i}", 1) for i in range(12)]
    rows += [(20 + i, f"text {i}\nAll rights reserved.\n\nnotice", "en", f"s{i}", 1) for i in range(12)] + [(40, "All rights reserved.\nnotice", "en", None, 1), (None, "notice", "en", "s1", 1)]
    got = {r.doc_id: r.text for r in line_dedup.deduped(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[3] == "a whole article\nwith two lines" and got[25] == "text 5\n" and got[40] == "" and got[None] == ""


def test_line_spread_is_exact_near_the_limit(spark):
    """Far more sites than the sketch counts exactly, around a limit of 300."""
    rows = [(s, f"this line is on {n} sites\nhere {n} {s}", "en", f"s{s}", 1) for n in (250, 299, 300, 301, 400) for s in range(n)]
    found = line_dedup.boilerplate(spark.createDataFrame(rows, DOCS), min_sites=300)
    assert found.count() == 3


# BPE


def test_bpe(docs, empty):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in made():
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    same([tuple(r) for r in bpe.round_trip(docs, P.path(RANKS), P.PATTERN).collect()], want)
    back = bpe.decoded(bpe.encoded(docs, P.path(RANKS), P.PATTERN), P.path(RANKS), P.PATTERN)
    same([(r.doc_id, bytes(r.bytes).decode()) for r in back.collect()], [(r[0], r[1] or "") for r in made()])
    assert bpe.round_trip(empty, P.path(RANKS), P.PATTERN).collect() == []
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choices("ab é1'st \n\t \x1c\x85#.", k=rng.randint(1, 80)))
        parts = list(bpe.pieces(t, 7))
        assert "".join(parts) == t
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)


def test_bpe_runs_of_white_space(spark):
    """Runs that the pattern's engine can't take, at the start, inside and at the end; shorter ones as tiktoken has them."""
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for blank in (" ", "\n", "\t \r\n", "\u3000", " \x85"):
        run = (blank * 9000)[:9000]
        for t in (run, f"abc{run}", f"{run}abc", f"a {run}d e", f"x.{run}!{run}\x1c{run}1", f"{run}\xa0{run}'s"):
            assert bpe.encode(t, enc).tolist() == enc.encode_ordinary(t)
    long = [(b * 2_000_000)[:2_000_000] for b in (" ", "\n", "\t \n")]
    rows = [(i, t) for i, t in enumerate(x for r in long for x in (r, f"a{r}", f"{r}b", f"a{r}b"))]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), P.path(RANKS), P.PATTERN).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}


# language ID


def test_language_id(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid_crf.labelled(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_rare_languages_are_sampled(spark):
    """A language of one document in a hundred and fifty has a sample of its own, and reruns agree."""
    rows = [(i, f"text {i}", "xx" if i % 150 == 0 else "en" if i % 2 else "de") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid_crf.sample(df, 200, 20)
    n = Counter(x for _, x in got)
    assert n["xx"] == 20 and 80 < n["en"] < 110 and 80 < n["de"] < 110
    assert got == langid_crf.sample(df.repartition(5), 200, 20)
    assert all(zlib.crc32(t.split()[1].encode()) % 4 != 2 for t, _ in got)


def test_language_id_edges(docs, empty):
    got = langid_crf.labelled(docs).collect()
    assert len(got) == len(made())
    by = {r.doc_id: r for r in got}
    for i in (100, 101, 102, 103):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert {r.lang_pred for r in got} <= {"en", "fr", "und"}
    assert langid_crf.labelled(empty).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid_crf.labelled(unlabelled).collect()} == {"und"}


def test_code_switching_and_marginals(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 4000").limit(400).collect()]
    model = langid_crf.fit([t for t, _ in rows], [x for _, x in rows])
    en = next(t for t, x in rows if x == "en").split()[:12]
    de = next(t for t, x in rows if x == "de").split()[:12]
    _, p = model.word_labels([" ".join(en + de)])
    got = [model.langs[i] for i in p.argmax(axis=1)]
    assert got[:10].count("en") >= 9 and got[-10:].count("de") >= 9
    # forward-backward against all label sequences
    w = langid_crf.words_of([" ".join(en[:2] + de[:2])])
    e = model.emissions(*model.features(w), w.n)
    k, total = len(model.langs), np.zeros((w.n, len(model.langs)))
    for s in np.ndindex(*[k] * w.n):
        total[np.arange(w.n), s] += np.exp(sum(e[i, x] for i, x in enumerate(s)) + sum(model.moves[a, b] for a, b in zip(s, s[1:])))
    assert np.allclose(model.marginals(e, np.array([0]))[0], total / total.sum(axis=1, keepdims=True), atol=1e-8)


def test_document_prediction_by_all_sequences(spark):
    """Language and score of short documents against every sequence of labels; words by a plain regular expression."""
    import regex

    rows = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 4000").limit(300).collect()]
    model = langid_crf.fit([t for t, _ in rows], [x for _, x in rows])
    k = len(model.langs)
    texts = [" ".join(t.split()[i : i + 4]) for i, (t, _) in enumerate(rows[:40])] + ["12 34", "", "Él 7 the_und"]
    for text, (lang, score) in zip(texts, model.predict(texts)):
        words_ = regex.findall(r"\p{L}+", text.lower())
        if not words_:
            assert (lang, score) == ("und", 0.0)
            continue
        each = [langid_crf.words_of([w]) for w in words_]
        e = np.concatenate([model.emissions(*model.features(w), 1) for w in each])
        total = np.zeros((len(words_), k))
        for s in np.ndindex(*[k] * len(words_)):
            total[np.arange(len(words_)), s] += np.exp(sum(e[i, x] for i, x in enumerate(s)) + sum(model.moves[a, b] for a, b in zip(s, s[1:])))
        mean = (total / total.sum(axis=1, keepdims=True)).mean(axis=0)
        assert lang == model.langs[mean.argmax()] and math.isclose(score, mean.max(), abs_tol=1e-6)


# LM scoring


def test_lm_scoring(docs, empty):
    frequent, net = lm_scoring.fitted(docs)
    counts = Counter(w for r in made() for w in lm_scoring.split(r[1] or ""))
    assert frequent == sorted(counts, key=lambda w: (-counts[w], w))[: lm_scoring.FREQUENT]
    got = lm_scoring.scored(docs).collect()
    assert len(got) == len(made())
    ids = lm_scoring.Ids(frequent)
    for r, d in zip(sorted(got, key=lambda r: (r.doc_id, r.n_tokens)), sorted(made(), key=lambda r: (r[0], len(words(r[1]))))):
        assert r.n_tokens == len(words(d[1]))
        if not r.n_tokens:
            assert r.log_likelihood == 0 and r.mean_log_prob is None
        elif r.n_tokens < 100:
            assert math.isclose(r.log_likelihood, brute_score(ids.of(lm_scoring.split(d[1])), net), rel_tol=1e-4)
    assert lm_scoring.scored(empty).collect() == []


def brute_score(ids, net):
    """One position after the other, in double precision."""
    total, s = 0.0, lm_scoring.SIDE
    padded = [0] * s + ids.tolist() + [0] * s
    for i in range(len(ids)):
        around = padded[i : i + s] + padded[i + s + 1 : i + 2 * s + 1]
        h = np.tanh(sum(net.table[x].astype(float) * net.scale[k] for k, x in enumerate(around)) + net.bias)
        z = h @ net.out.astype(float) + net.out_bias
        t = int(ids[i]) - 1
        group = t // lm_scoring.GROUP if t < lm_scoring.FREQUENT else lm_scoring.GROUPS + t - lm_scoring.FREQUENT
        total += z[group] - np.log(np.exp(z).sum())
        if t < lm_scoring.FREQUENT:
            y = h @ net.word[group].astype(float) + net.word_bias[group]
            total += y[t % lm_scoring.GROUP] - np.log(np.exp(y).sum())
    return total


def test_lm_gradient(spark):
    """A step against the numeric gradient, and finite scores whatever the weights."""
    rng = np.random.default_rng(2)
    w = rng.integers(1, lm_scoring.TOKENS, (40, 2 * lm_scoring.SIDE + 1)).astype(np.uint16)
    w[:, lm_scoring.SIDE] = rng.choice([3, 5, 300, lm_scoring.FREQUENT + 4], 40)
    net = lm_scoring.Net.fresh()
    before = net.log_probs(w).sum()
    for _ in range(20):
        net.train(w, rng, 0.1)
    assert net.log_probs(w).sum() > before + 40
    for p, at in ((net.table, (int(w[0, 0]), 2)), (net.scale, (1, 3)), (net.out, (4, 0)), (net.word, (0, 5, 2)), (net.word_bias, (1, 5)), (net.bias, (7,))):
        fresh = lm_scoring.Net.of_flat(net.flat())
        one = [x for x, y in zip(fresh.params(), net.params()) if y is p][0]
        up, down = [], []
        for out, e in ((up, 1e-2), (down, -1e-2)):
            keep = one[at]
            one[at] = keep + e
            out.append(fresh.log_probs(w).sum())
            one[at] = keep
        slope = (up[0] - down[0]) / 2e-2 / len(w)
        stepped = lm_scoring.Net.of_flat(net.flat())
        stepped.train(w, np.random.default_rng(0), 1e-3)
        move = [x for x, y in zip(stepped.params(), net.params()) if y is p][0][at] - p[at]
        assert math.isclose(move, 1e-3 * slope / math.sqrt(1e-2 + slope * slope), rel_tol=0.1, abs_tol=2e-6)
    big = lm_scoring.Net(*[p * 40 for p in net.params()])
    assert np.isfinite(big.log_probs(w)).all()


def test_lm_runs_share_their_embeddings():
    """Windows of a run cost one look-up a position, and score and train as they do apart."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, lm_scoring.TOKENS, n).astype(np.uint16) for n in (0, 1, 2, 15, 16, 17, 400, 0, 1000, 90)]
    runs, side, n = lm_scoring.runs(texts), lm_scoring.SIDE, sum(map(len, texts))
    assert runs.size < 2 * n
    gap = [0] * side
    apart = [[*gap, *t.tolist(), *gap][i : i + 2 * side + 1] for t in texts for i in range(len(t))]
    apart = np.array(apart, np.uint16)
    one, two = lm_scoring.Net.fresh(), lm_scoring.Net.fresh()
    for _ in range(3):  # each step takes all windows
        one.train(runs, rng, 0.1, batch=1 << 13)
        two.train(apart, rng, 0.1, batch=1 << 13)
    assert not np.allclose(one.flat(), lm_scoring.Net.fresh().flat(), atol=1e-2)
    assert np.allclose(one.flat(), two.flat(), atol=1e-4)
    middle = runs[:, side:-side].ravel()
    got = one.log_probs(runs)
    assert np.array_equal(middle[middle > 0], apart[:, side]) and not got[middle == 0].any()
    assert np.allclose(got[middle > 0], one.log_probs(apart), atol=1e-5)
    want = [brute_score(t, one) for t in texts]
    assert np.allclose(lm_scoring.log_likelihoods(np.array([len(t) for t in texts]), np.concatenate(texts), one), want, rtol=1e-5)
    for empty in (lm_scoring.runs([]), lm_scoring.runs([texts[0]] * 9)):
        one.train(empty, rng, 0.1)
        assert not one.log_probs(empty).any()


def test_lm_words_of_odd_texts(monkeypatch):
    """Words and tokens of many texts at once are those of one text, one word after the other."""
    import pyarrow as pa

    texts = [None, "", " ", "a", " \t\n\x0b\x0c\r", "\x0bAb\x0cC\r\nd  ", "\x1cA\x1fb\x85c\u00a0D\u2003E", "\u00c4\u00d6 \u0130I \u1e9e", "x\x00y \x00", "\U0001f600 \u00e9" * 50, "Z" * 5000, *(r[1] for r in made())]
    want = [lm_scoring.split(t or "") for t in texts]
    frequent = sorted({w for t in want for w in t})[::7]
    ids = lm_scoring.Ids(frequent)

    def token(w):
        if w in frequent:
            return 1 + frequent.index(w)
        return 1 + lm_scoring.FREQUENT + (w[-1] * 7 + (w[-2] * 3 if len(w) > 1 else 0) + min(len(w), 11) // 4) % lm_scoring.CLASSES

    for size in (1 << 22, 100):
        monkeypatch.setattr(lm_scoring, "TEXTS", size)
        for column, first in ((pa.array(texts, pa.string()), 0), (pa.array(texts, pa.string()).slice(3), 3)):
            place = 0
            for at, n, words in lm_scoring._split(column):
                own = want[first + at : first + at + len(n)]
                assert at == place and n.tolist() == list(map(len, own))
                assert words.to_pylist() == [w for t in own for w in t]
                assert ids.of(words).tolist() == [token(w) for t in own for w in t]
                place += len(n)
            assert place == len(column)
    assert [ids[w] for w in want[5]] == [token(w) for w in want[5]] == ids.of(want[5]).tolist()


def test_lm_learns(spark):
    """Shuffled words score lower than the text they come from."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    frequent, net = lm_scoring.fitted(df)
    ids, fresh = lm_scoring.Ids(frequent), lm_scoring.Net.fresh()
    texts = [r.text for r in df.limit(200).collect()]
    mean = lambda n, ts: sum(lm_scoring.log_likelihood(lm_scoring.split(t), ids, n)[1] for t in ts) / sum(len(words(t)) for t in ts)
    rng = random.Random(1)
    mixed = [" ".join(rng.sample(words(t), len(words(t)))) for t in texts]
    assert mean(net, texts) > mean(fresh, texts) + 0.3
    assert mean(net, texts) > mean(net, mixed)


def test_lm_trains_on_every_position(spark, docs):
    """All positions of all documents are windows of one round each; short documents too."""
    import pyarrow as pa

    texts = [r[1] for r in made() if r[1]]
    ids = lm_scoring.Ids(lm_scoring.fitted(docs)[0])
    rows = [ids.of(lm_scoring.split(t)).tobytes() for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(rows)), pa.array(rows, pa.binary())], ["replica", "ids"])
    start = lm_scoring.Net.fresh().flat()
    seen = sum(b.column(0)[0].as_py() for k in range(lm_scoring.ROUNDS) for b in lm_scoring._trained(start, k)(iter([batch])))
    assert seen == sum(len(words(t)) for t in texts)
    short = spark.createDataFrame([(16 * i + 15, "a few words only") for i in range(20)], "doc_id long, text string")
    assert not np.array_equal(lm_scoring.fitted(short)[1].flat(), start)


@pytest.mark.parametrize("known", [1 << 16, 120])
def test_lm_scores_every_word(spark, monkeypatch, known):
    """A word of a class counts with its share of the class, whether its count is broadcast or joined."""
    monkeypatch.setattr(lm_scoring, "KNOWN", known)
    rows = made() + [(3000 + i, " ".join(f"w{k}" for k in range(40 * i, 40 * i + 60)), "en", "a", 1) for i in range(70)]
    docs = spark.createDataFrame(rows, DOCS)
    counts = Counter(w for r in rows for w in lm_scoring.split(r[1] or ""))
    ids = lm_scoring.Ids(sorted(counts, key=lambda w: (-counts[w], w))[: lm_scoring.FREQUENT])
    totals = Counter()
    for w, n in counts.items():
        totals[ids[w]] += n
    share = lambda t: sum(math.log(counts[w] / totals[ids[w]]) for w in lm_scoring.split(t or ""))
    want = Counter((r[0], round(share(r[1]), 3) + 0.0) for r in rows)
    got = lm_scoring.scored(docs).collect()
    assert Counter((r.doc_id, round(r.word_log_likelihood - r.log_likelihood, 3) + 0.0) for r in got) == want
    assert all(math.isclose(r.mean_log_prob * r.n_tokens, r.word_log_likelihood) for r in got if r.n_tokens)
    assert sum(x < -1 for _, x in want) > 20
    alone = lambda t: sum(n for w, n in Counter(lm_scoring.split(t or "")).items() if counts[w] == n)
    assert Counter((r.doc_id, r.unseen_words) for r in got) == Counter((r[0], alone(r[1])) for r in rows) and sum(r.unseen_words > 0 for r in got) > 3


def test_lines_of_one_id_and_very_many_lines(spark):
    """Texts that share a doc_id or have none lose their own lines only, however often and where they stand; a text of very many lines takes time in proportion."""
    shared = [f"shared passage number {i} of all the sites" for i in range(3000)]
    rows = [(None if i % 2 else 7, f"s{i}", f"own text {i}\n{shared[i % 3]}\n\n{shared[i % 3]}\nend {i}") for i in range(60)]
    rows += [(100 + i, f"t{i}", "\n".join([*shared, f"tail {i}"])) for i in range(12)]
    rows.append((500, "t0", "\n".join(x for i in range(30) for x in [*shared, f"kept {i}"])))
    got = line_dedup.deduped(spark.createDataFrame(rows, "doc_id long, source string, text string"), min_sites=10).collect()
    assert sorted(r.text for r in got if r.doc_id in (None, 7)) == sorted(f"own text {i}\n\nend {i}" for i in range(60))
    assert {r.n_removed for r in got if r.doc_id in (None, 7)} == {2}
    assert sorted(r.text for r in got if (r.doc_id or 0) in range(100, 112)) == sorted(f"tail {i}" for i in range(12))
    assert [r.text.split("\n") for r in got if r.doc_id == 500] == [[f"kept {i}" for i in range(30)]]
