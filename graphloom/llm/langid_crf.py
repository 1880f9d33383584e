"""Language ID of words and documents by a linear-chain conditional random field.

Words are runs of letters, lower-cased.  Features are hashed: prefixes and
suffixes of one to three letters, letter pairs and triples, and words of a
learned lexicon.  Training sequences are spans of labelled documents in random
order, so that transitions between languages are learned as well.  Forward and
backward passes give each word its distribution over languages; a document's is
their mean.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import tuned

#: Hash buckets of the features; the model has so many rows and a column per language.
BUCKETS = 1 << 16
#: Words of one sequence; longer texts are several sequences.
SEQUENCE = 64
#: Bounds of the labelled sample that the model is fitted on: documents in all, of one language at least where it has so many, and their characters.
SAMPLE_DOCS, SAMPLE_EACH = 1200, 60
SAMPLE_CHARS = 20_000
#: Documents of each language where there are very many languages.
FEW = 12
LEXICON = 200
UNKNOWN = "und"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_letters: list[np.ndarray] = []
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, kept for the next texts."""
    have = _powers.get(int(base))
    if have is None or len(have) <= n:
        with np.errstate(over="ignore"):
            have = _powers[int(base)] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 20), base, np.uint64)]), dtype=np.uint64)
    return have


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A bucket for each of x."""
    x = (x + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(48 - BUCKETS.bit_length() + 1)).astype(np.int64) & (BUCKETS - 1)


@dataclass
class Words:
    """The words of some texts one after the other: features as (bucket, word), hashes, and the text of each word."""

    bucket: np.ndarray
    word: np.ndarray
    hashes: np.ndarray
    text: np.ndarray

    @property
    def n(self) -> int:
        return len(self.hashes)


def words_of(texts: list[str]) -> Words:
    """Letter runs of whole texts; all arithmetic is on the code points of all texts at once."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer(" ".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    pad = np.concatenate([[False], letter, [False]])
    starts, ends = np.flatnonzero(~pad[:-1] & pad[1:]), np.flatnonzero(pad[:-1] & ~pad[1:])
    bounds = np.cumsum([len(t) + 1 for t in lower])
    text = np.searchsorted(bounds, starts, "right")
    c = codes.astype(np.uint64)
    n = len(codes)
    with np.errstate(over="ignore"):
        two = c[:-1] * np.uint64(1 << 21) + c[1:] if n > 1 else c[:0]
        three = two[:-1] * np.uint64(1 << 21) + c[2:] if n > 2 else c[:0]
        power, back = _powers_of(_BASE, n), _powers_of(_INVERSE, n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * power[:n])])
        hashes = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)
        each = np.arange(len(starts))
        size = ends - starts
        owner = np.cumsum(~pad[:-1] & pad[1:])[:n] - 1  # the word that a letter is in
        found: list[tuple[np.ndarray, np.ndarray]] = []
        grams = {1: c, 2: two, 3: three}
        for k in (1, 2, 3):
            has = size >= k
            found += [(_mix(grams[k][starts[has]], 11 * k), each[has]), (_mix(grams[k][ends[has] - k], 101 * k), each[has])]
        for k in (2, 3):
            inside = letter[: n - k + 1].copy()
            for j in range(1, k):
                inside &= letter[j : n - k + 1 + j]
            at = np.flatnonzero(inside)
            found.append((_mix(grams[k][at], 1009 * k), owner[at]))
    return Words(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), hashes, text)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features and then lexicon words, by language
    moves: np.ndarray  # log potentials from language to language
    lexicon: np.ndarray  # sorted hashes

    def features(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.lexicon):
            return w.bucket, w.word
        at = np.minimum(np.searchsorted(self.lexicon, w.hashes), len(self.lexicon) - 1)
        known = np.flatnonzero(self.lexicon[at] == w.hashes)
        return np.concatenate([w.bucket, BUCKETS + at[known]]), np.concatenate([w.word, known])

    def emissions(self, bucket: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        columns = np.ascontiguousarray(self.weights.T)
        return np.stack([np.bincount(word, c.take(bucket), n) for c in columns], axis=1) if len(columns) else np.zeros((n, 0))

    def marginals(self, emissions: np.ndarray, breaks: np.ndarray, moves: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(distribution of each word, expected moves where they are asked for); sequences start at breaks and have SEQUENCE words at most."""
        n, k = emissions.shape
        size = np.diff(np.append(breaks, n))
        steps, rows = int(size.max(initial=0)), len(breaks)
        place = breaks[:, None] + np.arange(steps)[None, :]
        real = np.arange(steps)[None, :] < size[:, None]
        local = np.ones((steps, rows, k))
        local[real.T] = np.exp(emissions - emissions.max(axis=1, keepdims=True))[place.T[real.T]]
        move = np.exp(self.moves - self.moves.max())
        forward, backward = np.empty_like(local), np.ones_like(local)
        forward[0] = local[0] / local[0].sum(axis=1, keepdims=True)
        for t in range(1, steps):
            x = (forward[t - 1] @ move) * local[t]
            forward[t] = x / x.sum(axis=1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            x = (backward[t + 1] * local[t + 1]) @ move.T
            backward[t] = np.where(real[:, t + 1, None], x / x.sum(axis=1, keepdims=True), 1.0)
        both = forward * backward
        both /= both.sum(axis=2, keepdims=True)
        pairs = np.zeros((k, k))
        for t in range(1, steps if moves else 0):
            on = real[:, t]
            a, b = forward[t - 1][on], (local[t] * backward[t])[on]
            joint = a[:, :, None] * move[None] * b[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        out = np.empty_like(emissions)
        out[place[real]] = both.transpose(1, 0, 2)[real]
        return out, pairs

    def word_labels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text of each word, its distribution over langs)."""
        w = words_of(texts)
        if not w.n:
            return w.text, np.zeros((0, len(self.langs)))
        return w.text, self.marginals(self.emissions(*self.features(w), w.n), _breaks(w.text))[0]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        text, p = self.word_labels(texts)
        total = np.stack([np.bincount(text, p[:, k], len(texts)) for k in range(len(self.langs))], axis=1)
        count = np.bincount(text, minlength=len(texts))
        best = total.argmax(axis=1)
        return [(self.langs[b], float(min(1.0, t[b] / c))) if c else (UNKNOWN, 0.0) for b, t, c in zip(best, total, count)]


def _breaks(text: np.ndarray) -> np.ndarray:
    """Where sequences start: at each text and after every SEQUENCE words of it."""
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(np.append(first, len(text)))
    cuts = -(-size // SEQUENCE)
    return np.repeat(first, cuts) + SEQUENCE * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))


def fit(texts: list[str], labels: list[str], epochs: int = 3, batch: int = 24, rate: float = 0.3, decay: float = 1e-6, seed: int = 3) -> Model:
    """Train by AdaGrad on the log-likelihood of span sequences."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    counts: dict[str, Counter] = {x: Counter() for x in langs}
    for t, x in zip(texts, labels):
        counts[x].update(words_of([t]).hashes.tolist())
    lexicon = np.array(sorted({h for c in counts.values() for h, _ in c.most_common(LEXICON)}), np.uint64)
    k = len(langs)
    m = Model(langs, np.zeros((BUCKETS + len(lexicon), k)), np.zeros((k, k)), lexicon)
    seen_w, seen_m = np.full_like(m.weights, 1e-2), np.full_like(m.moves, 1.0)
    gold = np.array([langs.index(x) for x in labels])
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            w = words_of([texts[i] for i in own])
            if not w.n:
                continue
            bucket, word = m.features(w)
            y = gold[own][w.text]
            cuts = np.flatnonzero((rng.random(w.n) < 1 / 25) | np.concatenate([[True], w.text[1:] != w.text[:-1]]))
            spans = np.split(np.arange(w.n), cuts[1:])
            line = np.concatenate([spans[i] for i in rng.permutation(len(spans))])
            e = m.emissions(bucket, word, w.n)[line]
            breaks = np.arange(0, w.n, SEQUENCE)
            p, pairs = m.marginals(e, breaks, True)
            error = np.empty_like(p)
            p[np.arange(w.n), y[line]] -= 1
            error[line] = p
            grad = np.stack([np.bincount(bucket, error[word, j], len(m.weights)) for j in range(k)], axis=1) / w.n * 100 + decay * m.weights
            inner = np.ones(w.n, bool)
            inner[breaks] = False
            right = np.flatnonzero(inner)
            np.subtract.at(pairs, (y[line[right - 1]], y[line[right]]), 1)
            seen_w += grad * grad
            m.weights -= rate * grad / np.sqrt(seen_w)
            step = pairs / w.n * 10
            seen_m += step * step
            m.moves -= rate * step / np.sqrt(seen_m)
    m.weights = m.weights.astype(np.float32)
    return m


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, n: int = SAMPLE_DOCS, least: int = SAMPLE_EACH, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """Labelled texts of at most chars characters that aren't held out, by a hash of doc_id and text, so that reruns agree.

    Every language is learned: it gets its share of n, and least at the least, or
    all that it has.  Where there are more than n / least languages, the least is
    n over their number, but not under FEW.  The texts of the smallest hashes are
    taken.  So there are at most 2 n texts, or FEW for each language if that is
    more.
    """
    learn = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & (F.length("text") <= chars))
    lang = F.col("lang").cast("string").alias("lang")
    # one row a language reaches the driver
    counts = learn.groupBy(lang).count().orderBy(F.desc("count"), "lang").collect()
    total = sum(r["count"] for r in counts)
    if not total:
        return []
    least = max(FEW, min(least, n // len(counts)))
    want = {r.lang: max(least, round(n * r["count"] / total)) for r in counts}
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, 2 * want[r.lang] / r["count"] + 20 / r["count"]))])
    h = F.pmod(F.xxhash64("doc_id", "text", F.lit("crf")), F.lit(1 << 30))
    # about twice as many as are wanted of each language, in one pass; the smallest hashes of these are kept
    few = learn.select(lang, "text", h.alias("h")).filter(F.col("h") < F.try_element_at(share, "lang") * float(1 << 30)).orderBy("h", "lang", "text").limit(4 * sum(want.values())).collect()
    out: list[tuple[str, str]] = []
    for x in sorted(want):
        out += [(r.text, r.lang) for r in few if r.lang == x][: want[x]]
    return out


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of docs.

    A null text or one without letters is `und` with score 0, and so are all
    where nothing is labelled.  Ties go to the language that comes first by code
    point.  Rows that repeat a doc_id are labelled each by its own text.  Other
    columns are ignored; an empty table gives no rows.
    """
    spark = tuned(docs.sparkSession)
    rows = sample(docs)
    model = fit([t for t, _ in rows], [x for _, x in rows]) if rows else Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0, np.uint64))
    # at most (BUCKETS + LEXICON * languages) * languages * 4 bytes
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            out, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t)
                if size > 1 << 19:
                    out += shared.value.predict(part)
                    part, size = [], 0
            out += shared.value.predict(part) if part else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows_in = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out().alias("held_out"))
    return rows_in.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
