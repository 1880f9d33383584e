"""Tokenizer alignment against brute force over token occurrences; toxicity against edit distances and held-out labels."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from graphloom.llm import token_align, toxicity
from graphloom.llm.queries import TOKENS_A, TOKENS_B

DOCS = "doc_id long, text string"
A, B = P.path(TOKENS_A), P.path(TOKENS_B)


@pytest.fixture(scope="module")
def library():
    """Ids and bytes by the two libraries themselves, whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    chars = token_align.byte_chars()
    names = {i: x for x, i in json.load(open(A))["model"]["vocab"].items()}

    def both(text):
        a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        raw_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in b)]
        return [(i, bytes(chars[c] for c in names[i])) for i in a], list(zip(b, raw_b))

    return both


def brute(library, texts):
    made = []
    for text in texts:
        a, b = library(text or "") if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a = b = []
        spans = [[], []]
        for out, tokens in zip(spans, (a, b)):
            at = 0
            for i, x in tokens:
                out.append((at, at + len(x), i))
                at += len(x)
        ends = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        links, k = [], 0
        for s, e, i in spans[0]:
            while k and spans[1][k][0] > s:
                k -= 1
            for s2, e2, j in spans[1][k:]:
                if s2 >= e:
                    break
                if e2 > s:
                    links.append((i, j))
            while k < len(spans[1]) and spans[1][k][1] <= e:
                k += 1
            k = min(k, max(0, len(spans[1]) - 1))
        parts, ia, ib = [], 0, 0
        for end in sorted(ends):
            ga, gb = [], []
            while ia < len(spans[0]) and spans[0][ia][1] <= end:
                ga.append(str(spans[0][ia][2]))
                ia += 1
            while ib < len(spans[1]) and spans[1][ib][1] <= end:
                gb.append(str(spans[1][ib][2]))
                ib += 1
            parts.append(",".join(ga) + "|" + ",".join(gb))
        made.append((len(a), len(b), len(ends), links, hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""))
    count = Counter(x for m in made for x in m[3])
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    return [(a, b, g, len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), sha) for a, b, g, x, sha in made]


def texts():
    rng = random.Random(5)
    odd = ["", " ", "  ", "\n\n\t", "a", " a  b ", "naïve café — déjà vu", "日本語のテキスト", "😀😀 👩‍👩‍👧", "▁ under", "a\x00b", "<|endoftext|> </s> <s>", "x" * 3000, " " * 5000 + "x", "é combining", "﻿bom", " line", "\x1c\x85 odd"]
    words = ["the", "Häuser", "foo_bar", "1234567", "don't", "ñandú", "...", "(x)", "interestingly", "été"]
    return [None, *odd, *(" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)), "same text", "same text", "long words and  spaces " * 6000]


@pytest.mark.parametrize("common", [token_align.COMMON_PAIRS, 5])
def test_alignment(spark, library, monkeypatch, common):
    """With few pairs in arrays, most counts come by the join."""
    monkeypatch.setattr(token_align, "COMMON_PAIRS", common)
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, DOCS).select("*", *[F.lit("clash").alias(c) for c in ("row", "pairs", "times", "n_a", "pair", "n", "b", "x", "t")])
    got = token_align.tokenizer_links(df, A, B, P.PATTERN)
    want = [(i, *w) for (i, _), w in zip(rows, brute(library, [t for _, t in rows]))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert token_align.tokenizer_links(spark.createDataFrame([], DOCS), A, B, P.PATTERN).count() == 0


def test_ranks_only_where_proven():
    model = json.load(open(A))["model"]
    assert token_align.ranks_of(model, {"<|endoftext|>"}) is not None
    chars = {b: c for c, b in token_align.byte_chars().items()}
    base = {chars[i]: i for i in range(256)}
    merges = [["b", "c"], ["a", "b"], ["ab", "c"]]
    vocab = base | {"bc": 256, "ab": 257, "abc": 258}
    assert token_align.ranks_of({"vocab": vocab, "merges": merges}, set()) is None  # the merges make a, bc of abc
    assert token_align.ranks_of({"vocab": base | {"ab": 256, "abc": 257}, "merges": [["a", "b"], ["ab", "c"]]}, set()) is not None


def test_links_are_overlaps():
    rng = np.random.default_rng(1)
    for _ in range(300):
        total = int(rng.integers(1, 30))
        cut = lambda: np.array(sorted({total, *rng.integers(1, total + 1, rng.integers(0, total)).tolist()}))
        a, b = cut(), cut()
        group_a, group_b, x, y, n = token_align.aligned(a, b)
        start = lambda e: np.concatenate([[0], e[:-1]])
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if start(a)[i] < b[j] and start(b)[j] < a[i]]
        assert list(zip(x.tolist(), y.tolist())) == want and n == len(set(a.tolist()) & set(b.tolist())) and len(want) == len(a) + len(b) - n
        assert all(group_a[i] == group_b[j] for i, j in want)


# toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abc", k=n))
    terms = {word(rng.randint(3, 10)) for _ in range(25)} | {word(rng.randint(4, 9)) + "*" for _ in range(6)}
    auto = toxicity.Automaton(terms)
    for _ in range(4000):
        w = rng.choice([word(rng.randint(1, 12)), *[t.rstrip("*") for t in rng.sample(sorted(terms), 1)]])
        if rng.random() < 0.5 and w:
            k = rng.randrange(len(w))
            w = w[:k] + rng.choice(["", "a", "x", "bz"]) + w[k + rng.randint(0, 1) :]
        best = []
        for i, t in enumerate(auto.terms):
            stem, plain = t.endswith("*"), t.rstrip("*")
            e = min(distance(plain, w[:k]) for k in range(len(w) + 1)) if stem else distance(plain, w)
            if e <= toxicity.allowed(plain, stem):
                best.append((e, i))
        assert auto.match(w) == min(best, default=None), w


def test_states_are_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "KEPT_STATES", 5)
    auto = toxicity.Automaton(["idiotic", "moronic", "worthless"])
    assert [auto.match(w) for w in ("idiotic", "idi0tic", "wrthles", "table")] == [(0, 0), (1, 0), (2, 2), None]


def corpus():
    rng = random.Random(4)
    plain = ["".join(rng.choices("abdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(1500)]
    text = lambda n: rng.choices(plain, k=n)
    rows, labels = [], []
    for i in range(3000):
        words, toxic = text(rng.randint(8, 60)), int(i % 5 == 0)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(words))
            if toxic:
                words.insert(at, rng.choice(["grumblax", "snortwick", "zork" + rng.choice(plain)]))
            elif i % 5 == 1:
                words[at:at] = ["someone", "wrote", '"' + " ".join(text(2)), rng.choice(["grumblax", "snortwick"]) + '"', "there"]
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    odd = {9001: "You are a GRUMBLAXX and such a sn0rtwick today", 9002: 'The report says that "grumblax snortwick" was written there', 9003: "nothing to see", 9004: "zorkyness all over", 9005: "grumblax " * 20_000}
    return rows + [*odd.items(), (9006, None), (9007, ""), (None, "a snortwick you grumblax are")], labels


def test_toxicity(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit("clash").alias(c) for c in ("toxic", "w", "run", "fold", "weight", "held_out", "score")])
    marks = spark.createDataFrame([*labels, (5, None), (0, 1), (None, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = {r.doc_id: r for r in toxicity.scored(docs, marks).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels) and not got[None].held_out
    right = lambda y: sum(p == t for p, t in held if t == y) / sum(t == y for _, t in held)
    assert right(1) >= 0.97 and right(0) >= 0.98
    assert [got[i].predicted for i in (9001, 9002, 9003, 9004, 9005, 9006, 9007, None)] == [1, 0, 0, 1, 1, 0, 0, 1]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], DOCS)
    for marks in ([], [(1, 0), (2, 0)], [(1, None)]):
        got = toxicity.scored(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
        assert len(got) == 2 and all(r.predicted == 0 for r in got)
    assert toxicity.scored(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_toxicity_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.scored(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out and toxic = 0").collect()
    assert sum(r.predicted for r in got) == 0
