"""Documents scored by masked pseudo-likelihood.

A small network sees the tokens in a window on both sides of a position and
predicts the one in the middle; the log-probabilities of all tokens of a
document add up to its score.  Tokens are words: the 2,048 most frequent ones of
the whole corpus, and classes of the others by their ending and length.  A token
is predicted in two steps, first its group of 128 words or its class, then the
word in the group.  A word of a class adds its log share of the class, from the
counts of all words of the corpus.

Every position of every document is a training window in one of the rounds, so
they grow with the corpus.  Positions that follow each other stay together in
runs, so that the embedding of a token is looked up and changed once for all
windows of its run; steps take runs in random order.  Documents are dealt out to
replicas by hash; in each round every replica trains on its share from the common
parameters, and the mean weighted by windows is the next common state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import staged, tuned

#: Tokens: padding, frequent words in groups, classes of other words.
GROUPS, GROUP, CLASSES = 16, 128, 32
FREQUENT = GROUPS * GROUP
TOKENS = 1 + FREQUENT + CLASSES
SIDE, HIDDEN = 3, 16
RUN = 16  # windows that are kept together
ROUNDS = 3
WINDOWS = 1 << 20  # of one replica
#: Windows of a training step, and tokens that are scored at once.
BATCH, BLOCK = 1 << 11, 1 << 13
#: Shares of the most frequent words are broadcast, KNOWN at most; those of all others are joined.  Rows of such words that leave a worker at once.
KNOWN, ROWS = 1 << 16, 50_000
#: Bytes of texts that are split at once, one text at least, and of words that are counted at once.
TEXTS, COUNTED = 1 << 22, 1 << 23
#: Bytes of the words of these shares, and of a word that can be frequent.
KNOWN_BYTES, LONGEST = 1 << 22, 1 << 18


def split(text: str) -> list[bytes]:
    """Words of a text between ASCII white space, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _split(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(place of the first text, number of words of each, all their words) of a few texts at a time, as split gives them; null has none."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXTS, "right")))
        each = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, upto - at).fill_null("")))
        words, offsets = each.flatten().cast(pa.binary()), each.offsets.to_numpy()
        # white space at the ends of a text leaves an empty word there
        some = pc.greater(pc.binary_length(words), 0)
        before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
        yield at, np.diff(before[offsets - offsets[0]]), words.filter(some)
        at = upto


class Ids:
    """Token ids of words."""

    def __init__(self, frequent: list[bytes]) -> None:
        self.frequent = pa.array(frequent, pa.binary())

    def __getitem__(self, w: bytes) -> int:
        return int(self.of([w])[0])

    def of(self, words: list[bytes] | pa.Array) -> np.ndarray:
        words = words.cast(pa.binary()) if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        if not len(words):
            return np.empty(0, np.uint16)
        ids = _places(words, self.frequent) + 1
        rest = np.flatnonzero(ids == 0)
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
        data, end = np.frombuffer(data, np.uint8), offsets[1:][rest]
        length = end - offsets[:-1][rest]
        last, second = data[end - 1].astype(np.int32), np.where(length > 1, data[end - 2], 0).astype(np.int32)
        ids[rest] = 1 + FREQUENT + (last * 7 + second * 3 + np.minimum(length, 11) // 4) % CLASSES
        return ids.astype(np.uint16)


def _places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each word is found, -1 if it is not there."""
    return pc.index_in(words, value_set=among).fill_null(-1).to_numpy(zero_copy_only=False)


#: Logits within it need no shift by their greatest: sums of their exponentials are float32.
SAFE = 60.0


def _exps(z: np.ndarray, at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in z.ravel() of one column of each row of logits, these logits, sums of the exponentials of the row); z becomes the exponentials.

    Logits come from values within 1 by these weights, whose sums bound them:
    only where those are large is each row shifted by its greatest logit first.
    """
    if not np.abs(weights).sum(axis=-2).max(initial=0) < SAFE:
        z -= z.max(axis=1, keepdims=True)
    cells = np.arange(0, z.size, z.shape[1]) + at
    right = z.ravel()[cells]
    np.exp(z, out=z)
    return cells, right, z @ np.ones(z.shape[1], np.float32)


def _log_at(z: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-probability of one column of each row of logits."""
    _, right, sums = _exps(z, at, weights)
    return right.astype(np.float64) - np.log(sums.astype(np.float64))


def _errors(z: np.ndarray, at: np.ndarray, weights: np.ndarray, n: int) -> None:
    """Logits become the probabilities less 1 in one column of each row, over n."""
    cells, _, sums = _exps(z, at, weights)
    z *= (1 / (sums * np.float32(n)))[:, None]
    z.ravel()[cells] -= np.float32(1 / n)


@dataclass
class Net:
    """tanh of a sum of embeddings, scaled by the place in the window; then a softmax over groups and classes, and one over the words of the group."""

    table: np.ndarray  # token, hidden
    scale: np.ndarray  # place, hidden
    bias: np.ndarray
    out: np.ndarray  # hidden, groups and classes
    out_bias: np.ndarray
    word: np.ndarray  # group, hidden, word
    word_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 1) -> Net:
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.standard_normal(s).astype(np.float32) * np.float32(0.1)
        zero = lambda *s: np.zeros(s, np.float32)
        return cls(f(TOKENS, HIDDEN), 1 + f(2 * SIDE, HIDDEN), zero(HIDDEN), f(HIDDEN, GROUPS + CLASSES), zero(GROUPS + CLASSES), f(GROUPS, HIDDEN, GROUP), zero(GROUPS, GROUP))

    def params(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params()])

    @classmethod
    def of_flat(cls, x: np.ndarray) -> Net:
        at, parts = 0, []
        for p in cls.fresh().params():
            parts.append(x[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return cls(*parts)

    def with_biases(self) -> tuple[np.ndarray, np.ndarray]:
        """out and word, each with its bias as a last row."""
        return np.concatenate([self.out, self.out_bias[None]]), np.concatenate([self.word, self.word_bias[:, None]], axis=1)

    def hidden(self, near: np.ndarray) -> np.ndarray:
        """Of all windows of runs, from the embeddings of the runs; a last column of ones meets the biases."""
        run = near.shape[1] // HIDDEN - 2 * SIDE
        z, part = np.tile(self.bias, (len(near), run)), np.empty((len(near), run * HIDDEN), np.float32)
        for own, scale in zip(_sides(run), np.tile(self.scale, run)):
            z += np.multiply(near[:, own], scale, out=part)
        h = np.ones((len(near) * run, HIDDEN + 1), np.float32)
        h[:, :HIDDEN] = np.tanh(z, out=z).reshape(-1, HIDDEN)
        return h

    def near(self, windows: np.ndarray) -> np.ndarray:
        """The embeddings of runs, side by side."""
        return self.table.take(windows, axis=0).reshape(len(windows), windows.shape[1] * HIDDEN)

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        """Of the positions of runs, one after the other; 0 for padding."""
        out, word = self.with_biases()
        middle = windows[:, SIDE:-SIDE].ravel()
        order, first, ends = _by_group(middle)
        h = self.hidden(self.near(windows)).take(order, axis=0)
        right = _log_at(h @ out, first, out)
        right[: ends[-1]] += _log_at(_words(h, word, ends), WITHIN.take(middle[order[: ends[-1]]]), word)
        back = np.zeros(len(middle))
        back[order] = right
        return back

    def train(self, windows: np.ndarray, rng: np.random.Generator, rate: float, batch: int = BATCH) -> None:
        """One pass of AdaGrad over runs in random order."""
        # all parameters lie in one array, all slopes in another; net and the names below are views of them
        flat = np.concatenate([p.ravel() for p in (self.table, self.scale, self.bias, *self.with_biases())])
        slopes, seen, step = np.zeros_like(flat), np.full_like(flat, 1e-2), np.empty_like(flat)
        table, scale, bias, out, word = _views(flat)
        to_table, to_scale, to_bias, to_out, to_word = _views(slopes)
        net = Net(table, scale, bias, out[:-1], out[-1], word[:, :-1], word[:, -1])
        run = windows.shape[1] - 2 * SIDE
        order, runs = rng.permutation(len(windows)), max(1, batch // run)
        for at in range(0, len(order), runs):
            w = windows[order[at : at + runs]]
            middle = w[:, SIDE:-SIDE].ravel()
            rows, first, ends = _by_group(middle)
            if not (n := len(rows)):
                continue
            near = net.near(w)
            h = net.hidden(near).take(rows, axis=0)
            z, y = h @ out, _words(h, word, ends)
            _errors(z, first, out, n)
            _errors(y, WITHIN.take(middle[rows[: ends[-1]]]), word, n)
            np.matmul(h.T, z, out=to_out)
            dh = z @ out[:-1].T
            for g in range(GROUPS):
                own = slice(ends[g], ends[g + 1])
                np.matmul(h[own].T, y[own], out=to_word[g])
                dh[own] += y[own] @ word[g, :-1].T
            h = h[:, :HIDDEN]
            dh *= 1 - h * h
            np.matmul(np.ones(n, np.float32), dh, out=to_bias)
            back = np.zeros((len(middle), HIDDEN), np.float32)
            back[rows] = dh
            back = back.reshape(len(w), -1)
            # windows of a run share its embeddings: all of them are added up before the table is
            parts, part, one = np.zeros_like(near), np.empty_like(back), np.ones(len(w), np.float32)
            for k, own in enumerate(_sides(run)):
                to_scale[k] = (one @ np.multiply(near[:, own], back, out=part)).reshape(run, HIDDEN).sum(axis=0)
                parts[:, own] += np.multiply(back, np.tile(scale[k], run), out=part)
            to_table[:] = np.bincount(TABLE_CELLS.take(w.ravel(), axis=0).ravel(), parts.ravel(), TOKENS * HIDDEN).reshape(TOKENS, HIDDEN)
            seen += np.multiply(slopes, slopes, out=step)
            np.divide(slopes, np.sqrt(seen, out=step), out=step)
            step *= np.float32(rate)
            flat -= step
        for p, q in zip(self.params(), net.params()):
            p[...] = q


def _sides(run: int) -> list[slice]:
    """Where the embeddings of a run hold those of each place of its windows but the middle."""
    return [slice(k * HIDDEN, (k + run) * HIDDEN) for k in range(2 * SIDE + 1) if k != SIDE]


def _views(flat: np.ndarray) -> list[np.ndarray]:
    """table, scale, bias, out and word with their biases, as they lie in one array."""
    at, parts = 0, []
    for shape in ((TOKENS, HIDDEN), (2 * SIDE, HIDDEN), (HIDDEN,), (HIDDEN + 1, GROUPS + CLASSES), (GROUPS, HIDDEN + 1, GROUP)):
        size = math.prod(shape)
        parts.append(flat[at : at + size].reshape(shape))
        at += size
    return parts


#: The group or, after the groups, the class of each token, and its place in the group; padding comes last.
FIRST = np.concatenate([[GROUPS + CLASSES], np.repeat(np.arange(GROUPS), GROUP), GROUPS + np.arange(CLASSES)]).astype(np.uint8)
WITHIN = (np.arange(TOKENS) - 1) % GROUP
#: Places of the embedding of each token in the table.
TABLE_CELLS = np.arange(TOKENS * HIDDEN).reshape(TOKENS, HIDDEN)


def _by_group(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of tokens by group and class, without padding; these in that order; where each group begins and the last one ends)."""
    first = FIRST.take(tokens)
    order = np.argsort(first, kind="stable")
    first = first[order]
    n = np.searchsorted(first, FIRST[0])
    return order[:n], first[:n], np.searchsorted(first, np.arange(GROUPS + 1, dtype=np.uint8))


def _words(h: np.ndarray, word: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Logits of the words of its group for each row that has one."""
    z = np.empty((ends[-1], GROUP), np.float32)
    for g in range(GROUPS):
        own = slice(ends[g], ends[g + 1])
        np.matmul(h[own], word[g], out=z[own])
    return z


def runs(texts: list[np.ndarray]) -> np.ndarray:
    """All positions of texts, RUN to a row, with SIDE tokens before and after; padding (token 0) parts the texts."""
    gap = np.zeros(SIDE, np.uint16)
    return _rows(np.concatenate([gap, *[x for t in texts for x in (t, gap)]]))


def _rows(tokens: np.ndarray) -> np.ndarray:
    """runs of texts that are parted already."""
    n = -(-(len(tokens) - 2 * SIDE) // RUN)
    if n < 1:
        return np.empty((0, RUN + 2 * SIDE), np.uint16)
    padded = np.concatenate([tokens, np.zeros(n * RUN + 2 * SIDE - len(tokens), np.uint16)])
    return np.lib.stride_tricks.sliding_window_view(padded, RUN + 2 * SIDE)[::RUN]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Array] = []

    def rows() -> pa.RecordBatch:
        each = pc.value_counts(pa.concat_arrays(held))
        held.clear()
        return pa.RecordBatch.from_arrays([each.field("values"), each.field("counts")], ["word", "n"])

    for b in batches:
        for _, _, words in _split(b.column(0)):
            held.append(words)
            if sum(x.nbytes for x in held) > COUNTED:
                yield rows()
    if held:
        yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of all documents."""
    return staged(docs.select(F.col("text").cast("string")).mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def _class_counts(frequent: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total = Ids(frequent), np.zeros(TOKENS, np.int64)
        for b in batches:
            np.add.at(total, ids.of(b.column(0)), b.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(range(TOKENS), pa.int32()), pa.array(total)], ["token", "n"])

    return run


def shares(counts: DataFrame, frequent: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(the most frequent words, their counts, their log shares of their tokens, log count of each token).

    The least count of a word that is broadcast comes from a histogram of the
    counts, so that there are KNOWN at most, of KNOWN_BYTES, whatever the corpus.
    """
    totals = np.ones(TOKENS)
    for r in counts.mapInArrow(_class_counts(frequent), "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 0").collect():
        totals[r.token] = r.n
    logs = np.log(totals)
    step = F.ceil(8 * F.log2("n")).cast("int")
    least, have, size = 1 << 60, 0, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.sum(F.length("word")).alias("bytes")).orderBy(F.desc("step")).collect():  # eight rows a doubling
        if (have := have + r.k) > KNOWN or (size := size + r.bytes) > KNOWN_BYTES:
            break
        least = r.step
    best = counts.filter(step >= least).collect()
    words, n = pa.array([bytes(r.word) for r in best], pa.binary()), np.array([r.n for r in best], np.int64)
    return words, n, np.log(n) - logs[Ids(frequent).of(words)], logs


def _tokens(frequent: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(frequent)
        for b in batches:
            for at, n, words in _split(b.column(1)):
                ends = np.concatenate([[0], np.cumsum(2 * n)]).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids.of(words))])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), b.column(2).slice(at, len(n)), blobs], ["doc_id", "replica", "ids"])

    return run


def _trained(start: np.ndarray, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by replica; (windows, parameters times windows) of all replicas of a task."""
        held: list[np.ndarray] = []
        now, n, size, total = None, 0, 0, np.zeros(len(start))

        def train() -> None:
            nonlocal n
            w = runs(held)[round_::ROUNDS]
            held.clear()
            net = Net.of_flat(start)
            net.train(w, np.random.default_rng([round_, now]), 0.4 / (1 + round_))
            own = int(np.count_nonzero(w[:, SIDE:-SIDE]))
            n += own
            np.add(total, net.flat().astype(np.float64) * own, out=total)

        for b in batches:
            for r, x in zip(b.column(0).to_pylist(), b.column(1)):
                if held and (r != now or size > 2 * WINDOWS):  # a large share is trained on in parts
                    train()
                    size = 0
                now = r
                held.append(np.frombuffer(x.as_py(), np.uint16))
                size += len(held[-1])
        if held:
            train()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total], pa.list_(pa.float64()))], ["n", "params"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, 0.0
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1)):
            n, total = n + k, total + x.values.to_numpy(zero_copy_only=False)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total], pa.list_(pa.float64()))], ["n", "params"])


def fitted(docs: DataFrame, counts: DataFrame | None = None) -> tuple[list[bytes], Net]:
    """(the most frequent words, ties by byte order; network) from all documents, with their word_counts."""
    counts = word_counts(docs) if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = [bytes(r.word) for r in counts.filter(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    replicas = max(1, -(-total // WINDOWS))
    # by what a row holds and where it lies: neither null ids nor copies meet in one replica
    replica = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id() % 1024), F.lit(replicas)).alias("replica")
    gathered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), replica).mapInArrow(_tokens(frequent), "doc_id long, replica long, ids binary")
    # a replica lies in one file, in order, and each round reads it as it lies
    gathered = staged(gathered.filter(F.length("ids") > 0).repartition("replica").sortWithinPartitions("replica", "doc_id", "ids"), "tokens").select("replica", "ids")
    params = Net.fresh().flat()
    for r in range(ROUNDS):
        each = gathered.mapInArrow(_trained(params, r), "n long, params array<double>")
        # each task has one sum; four sums of these reach the driver, however many replicas there are
        found = each.repartition(4).mapInArrow(_summed, "n long, params array<double>").collect()
        if not found:
            break
        params = (np.sum([x.params for x in found], axis=0) / sum(x.n for x in found)).astype(np.float32)
    return frequent, Net.of_flat(params)


def log_likelihood(words: list[bytes], ids: Ids, net: Net) -> tuple[int, float]:
    """(tokens, sum of their conditional log-probabilities) of the words of a whole text."""
    windows = runs([ids.of(words)])
    return len(words), float(_log_probs(windows, net).sum())


def _log_probs(windows: np.ndarray, net: Net) -> np.ndarray:
    """net.log_probs of runs, a block after the other."""
    step = BLOCK // RUN
    return np.concatenate([net.log_probs(windows[at : at + step]) for at in range(0, len(windows), step)] or [np.empty(0)])


def log_likelihoods(n: np.ndarray, tokens: np.ndarray, net: Net) -> np.ndarray:
    """Log-likelihoods of texts of n tokens each, whose windows are scored together."""
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(tokens)) + SIDE * text
    padded = np.zeros(len(tokens) + SIDE * (len(n) + 1), np.uint16)
    padded[at + SIDE] = tokens
    return np.bincount(text, _log_probs(_rows(padded), net)[at], len(n))


def _by_text(text: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, how often it is there) of the words of texts, numbered below words."""
    both, n = np.unique(text * max(1, words) + word, return_counts=True)
    return *np.divmod(both, max(1, words)), n


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, word_log_likelihood, mean_log_prob, unseen_words, unseen_share), one row per row of docs.

    log_likelihood sums log P(token | context).  word_log_likelihood adds log
    P(word | token) of every word, and mean_log_prob is its mean.  unseen_words
    are the running words that the corpus has in this row alone: what a model of
    all other rows has never seen, so that texts that occur twice have none.

    Null and empty texts have no tokens, log-likelihood 0 and a null mean and
    share.  Documents that repeat count as often as they are there.  Other
    columns are ignored; an empty table gives no rows.
    """
    spark = tuned(docs.sparkSession)
    counts = word_counts(docs)
    frequent, net = fitted(docs, counts)
    shared = spark.sparkContext.broadcast((frequent, net.flat(), *shares(counts, frequent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with head for each document, and one for each of its words that are not known here."""
        frequent, flat, known, counted, share, logs = shared.value
        ids, net = Ids(frequent), Net.of_flat(flat)
        row = TaskContext.get().partitionId() << 40
        kind = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("token", pa.float64()), ("word", pa.float64()), ("alone", pa.int64())])

        def rows(at: np.ndarray, words: pa.Array, n: np.ndarray, head: pa.Array) -> Iterator[pa.RecordBatch]:
            b = pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), words, pa.array(n, pa.int64()), head], ["row", "word", "n", "head"])
            for k in range(0, len(at), ROWS):
                yield b.slice(k, ROWS)

        for b in batches:
            for first, n, words in _split(b.column(1)):
                tokens, place, text = ids.of(words), _places(words, known), np.repeat(np.arange(len(n)), n)
                here = place >= 0
                shares_ = np.bincount(text, np.where(here, share[place] if len(share) else 0.0, -logs[tokens]), len(n))
                # a known word can be in one text alone if all there are of it are among these texts
                whole = np.bincount(place[here], minlength=len(counted)) == counted
                at = np.flatnonzero(here)[whole[place[here]]]
                text_, word, k = _by_text(text[at], place[at], len(counted))
                alone = np.bincount(text_, k * (k == counted[word]), len(n)).astype(np.int64)
                at = row + np.arange(len(n))
                head = [b.column(0).slice(first, len(n)), pa.array(n, pa.int64()), pa.array(log_likelihoods(n, tokens, net)), pa.array(shares_), pa.array(alone)]
                # no word has a space: heads meet no count, and are dealt evenly
                yield from rows(at, pa.array([b" %d" % i for i in at.tolist()], pa.binary()), np.zeros(len(n), np.int64), pa.StructArray.from_arrays(head, fields=list(kind)))
                rest = words.filter(pa.array(~here)).dictionary_encode()
                text_, word, k = _by_text(text[~here], rest.indices.to_numpy(), len(rest.dictionary))
                yield from rows(at[text_], rest.dictionary.take(pa.array(word)), k, pa.nulls(len(k), kind))
                row += len(n)

    each = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "row long, word binary, n long, head struct<doc_id long, n_tokens long, token double, word double, alone long>")
    each = each.join(counts.withColumnRenamed("n", "count"), "word", "left")
    alone = F.coalesce(F.col("head.alone"), F.when(F.col("n") == F.col("count"), F.col("n")).otherwise(0))
    each = each.select("row", F.coalesce(F.col("head.word"), F.col("n") * F.log("count")).alias("share"), alone.alias("alone"), "head.doc_id", "head.n_tokens", "head.token")
    sums = each.groupBy("row").agg(F.sum("share").alias("share"), F.sum("alone").alias("alone"), *[F.max(c).alias(c) for c in ("doc_id", "n_tokens", "token")])
    whole = F.col("token") + F.col("share")
    some = lambda c: F.when(F.col("n_tokens") > 0, c / F.col("n_tokens"))
    return sums.select("doc_id", "n_tokens", F.col("token").alias("log_likelihood"), whole.alias("word_log_likelihood"), some(whole).alias("mean_log_prob"), F.col("alone").alias("unseen_words"), some(F.col("alone")).alias("unseen_share"))
