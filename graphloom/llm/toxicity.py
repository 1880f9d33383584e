"""Toxicity by a lexicon that tolerates misspellings, read in context.

The lexicon is learned: words, and stems that many words share, which toxic
training documents have and clean ones haven't.  It is held as a trie.  A
Levenshtein automaton runs along the trie: a state is the set of (node, errors)
that the letters read so far can mean, made into one deterministic state the
first time it is met.  Each hit is weighed by its context: quotation marks
around it, and the words near it that tell reports from abuse.  A logistic
regression turns a document's hits into its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import staged, text_of, tuned

#: Bounds of the labelled sample: toxic and clean documents; twice as many labels are drawn, as copies go.
SAMPLE_TOXIC, SAMPLE_CLEAN = 5_000, 15_000
#: Bounds of what is learned: terms, forms that are only close to a term, and words of contexts.
TERMS, FORMS, CONTEXTS = 4_000, 20_000, 2_000
#: Stems have so many letters at least; errors are allowed from so many letters on, one and two.
STEM, STEM_TO, ONE, TWO = 4, 9, 5, 8
#: Words on each side of a hit that are its context.
WINDOW = 6
#: How often the odds must turn for a term, and how unlikely by chance (in nats, after the terms that are tried).
TIMES, NATS = 20.0, 2.0
#: Words and states that a worker keeps.
KEPT_WORDS, KEPT_STATES = 300_000, 50_000
#: Letters and digits, with single signs between that stand for a letter.
WORD = re.compile(r"[^\W_]+(?:[*@$!+][^\W_]+)*")
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’"}
LONGEST = 40


def allowed(term: str, stem: bool) -> int:
    """Errors that a misspelling of term may have."""
    n = len(term)
    return (n >= TWO) if stem else (n >= ONE) + (n >= TWO)


@dataclass
class Lexicon:
    """term, with a star behind a stem, to its weight in nats."""

    terms: dict[str, float] = field(default_factory=dict)
    forms: frozenset[str] = frozenset()
    contexts: dict[str, float] = field(default_factory=dict)


class Automaton:
    """Levenshtein automaton of all terms at once, along their trie, deterministic as far as it was used."""

    def __init__(self, terms: Iterable[str]):
        self.terms = sorted(terms)
        self.child: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.limit: list[int] = [0]
        for i, term in enumerate(self.terms):
            stem, plain, node = term.endswith("*"), term.rstrip("*"), 0
            most = allowed(plain, stem)
            self.limit[0] = max(self.limit[0], most)
            for c in plain:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.limit.append(0)
                node = self.child[node][c]
                self.limit[node] = max(self.limit[node], most)
            (self.stem if stem else self.word)[node] = i
        self.alphabet = {c for x in self.child for c in x}
        self.most = [allowed(t.rstrip("*"), t.endswith("*")) for t in self.terms]
        self.reset()

    def reset(self) -> None:
        self.ids: dict = {}
        self.moves: list[dict[str, int]] = []
        self.states: list = []
        self.ends: list[tuple[int, int] | None] = []
        self.start = self.made({0: 0}, None)

    def made(self, nodes: dict[int, int], found: tuple[int, int] | None) -> int:
        """The state of nodes with their fewest errors; found is the best stem so far, as (errors, term)."""
        todo = list(nodes)
        while todo:  # letters that are missing
            node = todo.pop()
            for x in self.child[node].values():
                e = nodes[node] + 1
                if e <= self.limit[x] and e < nodes.get(x, 99):
                    nodes[x] = e
                    todo.append(x)
        for node, e in nodes.items():
            i = self.stem[node]
            if i >= 0 and e <= self.most[i]:
                found = min(found or (99, 0), (e, i))
        key = (frozenset(nodes.items()), found)
        if key not in self.ids:
            words = [(e, self.word[n]) for n, e in nodes.items() if self.word[n] >= 0 and e <= self.most[self.word[n]]]
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.ends.append(min([*words, *([found] if found else [])], default=None))
        return self.ids[key]

    def move(self, state: int, c: str) -> int:
        nodes, found = self.states[state]
        to: dict[int, int] = {}
        for node, e in nodes:
            for letter, x in self.child[node].items():
                k = e + (letter != c)
                if k <= self.limit[x] and k < to.get(x, 99):
                    to[x] = k
            if e + 1 <= self.limit[node] and e + 1 < to.get(node, 99):
                to[node] = e + 1
        return self.made(to, found) if to or found else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """(errors, term) of the closest term, None if there is none in reach."""
        state, moves, alphabet = self.start, self.moves, self.alphabet
        for c in word:
            if c not in alphabet:
                c = ""
            to = moves[state].get(c)
            if to is None:
                to = moves[state][c] = self.move(state, c)
            if to < 0:
                return None
            state = to
        found = self.ends[state]
        if len(self.states) > KEPT_STATES:
            self.reset()
        return found


class Reader:
    """Hits of texts in a worker."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton = lexicon, Automaton(lexicon.terms)
        self.none: set[str] = set()

    def found(self, words: Iterable[str]) -> dict[str, tuple[int, int]]:
        """The words that a term is in reach of."""
        out = {}
        for w in set(words) - self.none:
            hit = self.automaton.match(w) if len(w) <= LONGEST else None
            if hit is None:
                if len(self.none) < KEPT_WORDS:
                    self.none.add(w)
            else:
                out[w] = hit
        return out

    def hits(self, text: str) -> tuple[list[tuple[str, str, int, bool, list[str]]], int]:
        """(word, term, errors, quoted, context) of each hit, and the number of words."""
        low = text.lower()
        words = WORD.findall(low)
        found = self.found(words)
        if not found:
            return [], len(words)
        spans = [m.span() for m in WORD.finditer(low)]
        quoted = quotations(low)
        out = []
        for k, w in enumerate(words):
            if w in found:
                e, i = found[w]
                around = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
                at = int(np.searchsorted(quoted, spans[k][0], "right")) if len(quoted) else 0
                out.append((w, self.automaton.terms[i], e, at % 2 == 1, around))
        return out, len(words)

    def features(self, text: str) -> list[float]:
        """1, the strongest hit, the sum of hits, terms without errors, hits a hundred words; all but the first 0 without hits."""
        hits, n = self.hits(text)
        best = total = 0.0
        exact = set()
        lex = self.lexicon
        for w, term, e, quoted, around in hits:
            if e and w in lex.forms:
                continue
            context = sum(lex.contexts.get(x, 0.0) for x in set(around))
            if quoted:
                context -= QUOTED
            weight = min(lex.terms[term], 8.0) / 8 * 0.8**e * 2 / (1 + math.exp(-min(0.0, max(-30.0, context))))
            best, total = max(best, weight), total + weight
            if not e and context > -1:
                exact.add(term)
        return [1.0, best, math.log1p(total), math.log1p(len(exact)), math.log1p(100 * total / n) if n else 0.0]


#: What quotation marks around a hit take from its context, in nats.
QUOTED = 3.0
#: Coefficients before any label is seen, and how many nats each may cost to leave.
PRIOR = np.array([-4.0, 5.0, 1.0, 1.0, 0.2])
SPREAD = np.array([0.01, 0.3, 0.3, 0.3, 0.3])


def quotations(text: str) -> np.ndarray:
    """Starts and ends of quotations in turn: marks in pairs within a paragraph and 400 characters."""
    out: list[int] = []
    at = 0
    while True:
        m = _OPEN.search(text, at)
        if not m:
            return np.array(out, np.int64)
        end = text.find(QUOTES[m[0]], m.end(), m.end() + 400)
        stop = text.find("\n", m.end(), m.end() + 400)
        if end < 0 or 0 <= stop < end:
            at = m.end()
            continue
        out += [m.start(), end + 1]
        at = end + 1


_OPEN = re.compile("[" + "".join(QUOTES) + "]")


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, weight, fold): labelled documents, each text and each group of close copies about once, twice SAMPLE_TOXIC and SAMPLE_CLEAN of them at most on average, before copies go.

    Only documents whose crc32(doc_id as text) mod 5 is not 0.  Close copies are
    told by the smallest hash of their five-word runs.  weight tells for how many
    documents of its label one stands.
    """
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = staged(marked.filter(~_held_out(5)), "toxic-labels")
    counts = dict(tuple(r) for r in marked.groupBy("toxic").count().collect())
    rate = {t: min(1.0, 2 * most / max(1, counts.get(t, 0))) for t, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))}
    # so many labels at most, on average: they go to the texts, and no text is shuffled for them
    few = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, int(rate[1] * (1 << 20))).otherwise(int(rate[0] * (1 << 20))))
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter(F.col("text") != "").join(F.broadcast(few), "doc_id")
    words = F.filter(F.split(F.lower("text"), r"\W+"), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("w", i, 5))))
    alone = kept.withColumn("w", words).withColumn("run", F.array_min(runs)).groupBy("run", "toxic").agg(F.min("text").alias("text"))
    return alone.select("text", "toxic", F.when(F.col("toxic") == 1, 1 / rate[1]).otherwise(1 / rate[0]).alias("weight"), (F.pmod(F.xxhash64("text"), F.lit(2))).cast("int").alias("fold"))


def _held_out(mod: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == 0, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """(kind, term, fold, toxic, n) summed over a task; of(text) gives the (kind, term) that a text counts once for."""
    n: Counter = Counter()

    def out():
        keys = list(n)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([n[k] for k in keys], pa.int64())], ["kind", "term", "fold", "toxic", "n"])

    for b in batches:
        for text, toxic, fold in zip(*(c.to_pylist() for c in b.columns)):
            for kind, term in of(text):
                n[kind, term, fold, toxic] += 1
        if len(n) > 500_000:
            yield out()
            n.clear()
    yield out()


_COUNTED = "kind int, term string, fold int, toxic int, n long"


def terms_of(text: str) -> set[tuple[int, str]]:
    """Words (0) and stems (1) outside quotations, each once."""
    low = text.lower()
    cuts = [0, *quotations(low).tolist(), len(low)]
    words = {w for a, b in zip(cuts[::2], cuts[1::2]) for w in WORD.findall(low[a:b]) if len(w) <= LONGEST}
    return {(0, w) for w in words if len(w) > 2} | {(1, w[:k]) for w in words for k in range(STEM, min(STEM_TO, len(w) - 1) + 1)}


def _table(rows: DataFrame, most: int, least: int) -> dict[tuple[int, str], np.ndarray]:
    """{(kind, term): [fold][toxic] documents} of the terms of most toxic documents."""
    at = {(f, t): F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)) for f in (0, 1) for t in (0, 1)}
    wide = rows.groupBy("kind", "term").agg(*(c.alias(f"n{f}{t}") for (f, t), c in at.items()))
    toxic, clean = F.col("n01") + F.col("n11"), F.col("n00") + F.col("n10")
    top = wide.filter(toxic >= least).orderBy((toxic / (toxic + 4 * clean + 8)).desc(), toxic.desc(), "kind", "term").limit(most)
    return {(r[0], r[1]): np.array([[r[2], r[3]], [r[4], r[5]]]) for r in top.collect()}


def weight_of(p: float, n: float, toxic: float, clean: float, tried: float) -> float:
    """Nats that a term adds to the odds of toxic; 0 unless it turns them enough and not by chance."""
    share = toxic / max(1.0, toxic + clean)
    if p <= 0 or not 0 < share < 1:
        return 0.0
    gain = math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))
    q = p / (p + n)
    chance = p * math.log(q / share) + (n * math.log((1 - q) / (1 - share)) if n else 0.0) if q > share else 0.0
    return gain if gain >= math.log(TIMES) and chance >= math.log(tried) + NATS else 0.0


def chosen(table: dict[tuple[int, str], np.ndarray], totals: np.ndarray, folds: tuple[int, ...], tried: float) -> dict[str, float]:
    """The terms that the folds show: the shortest stem of a word that is toxic whatever follows, else the word."""
    toxic, clean = (float(sum(totals[f][t] for f in folds)) for t in (1, 0))
    seen = {k: (float(sum(v[f][1] for f in folds)), float(sum(v[f][0] for f in folds))) for k, v in table.items()}
    good = {k: w for k, (p, n) in seen.items() if (w := weight_of(p, n, toxic, clean, tried))}
    most: dict[str, float] = defaultdict(float)  # documents of the most frequent word below a stem
    for (kind, w), (p, _) in seen.items():
        if kind == 0:
            for k in range(STEM, min(STEM_TO, len(w)) + 1):
                most[w[:k]] = max(most[w[:k]], p)
    stems = {t for kind, t in good if kind == 1 and seen[1, t][0] >= 1.5 * most[t] and seen[1, t][1] <= 0.02 * seen[1, t][0] * max(1.0, clean / max(1.0, toxic))}
    stems = {t for t in stems if not any(t[:k] in stems for k in range(STEM, len(t)))}
    out = {t + "*": good[1, t] for t in stems}
    out |= {w: x for (kind, w), x in good.items() if kind == 0 and not any(w[:k] in stems for k in range(STEM, len(w) + 1))}
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:TERMS])


def fitted(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression, held near PRIOR where labels say little; none but the first is negative."""
    beta = PRIOR.copy()
    if not len(y):
        return beta
    w = w * len(w) / w.sum()
    loss = lambda b: float((w * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ b))).sum() + (SPREAD * (b - PRIOR) ** 2).sum() / 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(SPREAD), x.T @ (w * (p - y)) + SPREAD * (beta - PRIOR))
        size = 1.0
        while size > 1e-4:
            to = beta - size * step
            to[1:] = np.maximum(to[1:], 0.0)
            if loss(to) <= loss(beta):
                break
            size /= 2
        else:
            break
        done = np.abs(to - beta).max() < 1e-7
        beta = to
        if done:
            break
    return beta


_readers: dict = {}


def _reader(key: str, lexicon: Lexicon) -> Reader:
    """One for each worker process and lexicon."""
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(lexicon)
    return _readers[key]


def learned(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """The lexicon, and the coefficients of its features.

    Coefficients come from one half of the sample, read with a lexicon of the
    other half, as a lexicon looks better than it is on what it was learned from.
    """
    spark = tuned(docs.sparkSession)
    rows = staged(sample(docs, labels), "toxic-sample")
    totals = np.zeros((2, 2))
    for fold, toxic, n in rows.groupBy("fold", "toxic").count().collect():
        totals[fold][toxic] = n
    narrow = rows.select("text", "toxic", "fold")
    terms = staged(narrow.mapInArrow(lambda b: _counts(b, terms_of), _COUNTED).groupBy("kind", "term", "fold", "toxic").agg(F.sum("n").alias("n")), "toxic-terms")
    tried = float(max(1, terms.select("kind", "term").distinct().count()))
    table = _table(terms, 5 * TERMS, 3)
    everything, half = chosen(table, totals, (0, 1), tried), chosen(table, totals, (0,), tried)

    read = spark.sparkContext.broadcast(Lexicon(everything))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(read.value)

        def of(text: str) -> set[tuple[int, str]]:
            hits = reader.hits(text)[0]
            return {(0, w) for w, _, e, _, _ in hits if e} | {(1, x) for _, _, e, _, around in hits if not e for x in around} | ({(2, "")} if any(not h[2] for h in hits) else set())

        return _counts(batches, of)

    close = staged(narrow.mapInArrow(near, _COUNTED).groupBy("kind", "term", "fold", "toxic").agg(F.sum("n").alias("n")), "toxic-close")

    def forms(folds: tuple[int, ...]) -> frozenset[str]:
        """Words close to a term that clean documents have as often as chance would."""
        clean = close.filter((F.col("kind") == 0) & F.col("fold").isin(*folds)).groupBy("term").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"))
        return frozenset(r[0] for r in clean.filter("n > 0 and n >= 0.5 * p").orderBy(F.desc("n"), "term").limit(FORMS).collect())

    def contexts(folds: tuple[int, ...]) -> dict[str, float]:
        """Words near hits that clean documents with hits have and toxic ones haven't, or the reverse."""
        t = _table(close.filter((F.col("kind") >= 1) & F.col("fold").isin(*folds)), CONTEXTS, 0)
        all_of = t.pop((2, ""), np.zeros((2, 2)))
        toxic, clean = float(sum(all_of[f][1] for f in folds)), float(sum(all_of[f][0] for f in folds))
        if min(toxic, clean) < 20:
            return {}
        out, share = {}, toxic / (toxic + clean)
        for (_, x), v in t.items():
            p, n = (float(sum(v[f][k] for f in folds)) for k in (1, 0))
            chance = sum(k * math.log(k / (p + n) / q) for k, q in ((p, share), (n, 1 - share)) if k)
            if chance >= math.log(len(t)) + NATS:
                out[x] = max(-3.0, min(1.0, math.log((p + 1) / (toxic + 2)) - math.log((n + 1) / (clean + 2))))
        return out

    first = spark.sparkContext.broadcast(Lexicon(half, forms((0,)), contexts((0,))))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(first.value)
        for b in batches:
            x = [reader.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "toxic", "weight"])

    got = rows.filter(F.col("fold") == 1).select("text", "toxic", "weight").mapInArrow(measured, "x array<double>, toxic int, weight double").collect()
    ys = np.array([r[1] for r in got], float)
    beta = fitted(np.array([r[0] for r in got]).reshape(-1, len(PRIOR)), ys, np.array([r[2] for r in got])) if 0 < ys.sum() < len(ys) else PRIOR
    return Lexicon(everything, forms((0, 1)), contexts((0, 1))), beta


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs(doc_id, text), learned from labels(doc_id, toxic).

    score is the probability of toxic, predicted whether it is 0.5 or more.
    Null and empty texts have no hits and the score of such.  Without labels of
    both kinds there are no terms, and every score is the same low one.  Null
    toxic marks count for nothing, several of one document as the highest.
    Repeated rows stay; null doc_ids are not held out and never learned from;
    other columns are ignored; an empty table gives no rows.
    """
    spark = tuned(docs.sparkSession)
    lexicon, beta = learned(docs, labels)
    given = spark.sparkContext.broadcast((lexicon, beta.tolist(), f"{id(lexicon)}-{len(lexicon.terms)}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, b, key = given.value
        reader = _reader(key, lex)
        for batch in batches:
            z = [sum(x * y for x, y in zip(reader.features(t.as_py() or ""), b)) for t in batch.column(2)]
            p = 1 / (1 + np.exp(-np.array(z, float)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", _held_out(5).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
