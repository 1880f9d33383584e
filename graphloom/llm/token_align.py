"""Alignment of two tokenizers by byte offsets, and counts of the id pairs that they link.

Each text is cut into tokens twice.  Cumulated byte lengths are the ends of
tokens; ends that both have (intersect1d) cut the tokens into groups, and
searchsorted gives each token its group.  A token of A overlaps a run of tokens
of B, so that repeating each by the length of its run gives all links, and only
those.  Pairs are counted over the whole corpus in two shuffles, the first one
salted; the counts that most links need are few and reach the tasks as sorted
arrays of bounded size, the others by a join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm.common import staged, tuned

#: Pairs whose counts reach every task as arrays (17 bytes each); the others are joined.
COMMON_PAIRS = 1 << 20
#: Salts of the first of the two shuffles that count pairs.
SALTS = 16
#: Pairs that a task holds before it adds equal ones up.
HELD = 1 << 21
#: Texts are encoded in parts of about so many characters.
PIECE = 1 << 15
BLANK = "▁"
_made: dict = {}


@dataclass(frozen=True)
class Tables:
    """What the tasks need of both tokenizers: bytes and written forms of each id."""

    bytes_a: list[bytes]
    bytes_b: list[bytes]
    ranks: dict[bytes, int] | None
    splits: bool


def byte_chars() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a character: printable ones of Latin-1 as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _merged(token: bytes, order: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """token by the merges, lowest first."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        rank, at = min((order.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def ranks_of(model: dict, special: set[str]) -> dict[bytes, int] | None:
    """The vocabulary as ranks, None where ranks could give other tokens than the merges do.

    Ranks merge any neighbours whose join is a token, merges only the listed
    pair.  Where ids are in the order of merges and every token is what the
    merges make of its bytes, the only pair left when a token's turn comes is
    the listed one, as no merge so far went across its borders: both agree.
    """
    chars = byte_chars()
    raw = {t: bytes(chars[c] for c in t) for t in model["vocab"] if t not in special and all(c in chars for c in t)}
    if len(raw) + len(special & set(model["vocab"])) != len(model["vocab"]):
        return None
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = {(raw[x], raw[y]): i for i, (x, y) in enumerate(pairs)}
    ids = [model["vocab"][x + y] for x, y in pairs]
    ordered = all(x < y for x, y in zip(ids, ids[1:])) and all(model["vocab"][t] < ids[0] for t, b in raw.items() if len(b) == 1) if ids else True
    whole = ordered and all(_merged(b, order) == [b] for b in raw.values())
    return {b: model["vocab"][t] for t, b in raw.items()} if whole else None


def tables_of(bpe_json: bytes, pieces_model: bytes) -> Tables:
    import sentencepiece

    j = json.loads(bpe_json)
    chars, model = byte_chars(), j["model"]
    special = {x["content"] for x in j["added_tokens"]}
    a = [b""] * (1 + max([*model["vocab"].values(), *(x["id"] for x in j["added_tokens"])]))
    for t, i in model["vocab"].items():
        a[i] = t.encode() if t in special else bytes(chars[c] for c in t)
    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces_model)
    written = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(written)]
    return Tables(a, b, ranks_of(model, special), not any(BLANK in p.lstrip(BLANK) for p in written))


class Encoders:
    """Both tokenizers in a worker.

    A is tiktoken with the ranks of the vocabulary where these are proven to
    agree with the merges, else the tokenizers library.  B adds a space in
    front; no piece has a space after another character, so that a long text is
    cut in front of a space, which the added one stands for.
    """

    def __init__(self, bpe_json: bytes, pieces_model: bytes, tables: Tables, pattern: str):
        import sentencepiece

        self.tables = tables
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=pieces_model)
        if tables.ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=tables.ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.fast, self.slow = None, Tokenizer.from_str(bpe_json.decode())
            self.slow.encode_special_tokens = True
        self.length_a = np.array([len(x) for x in tables.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in tables.bytes_b], np.int64)
        ids = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.text_a = ids(len(tables.bytes_a), ","), ids(len(tables.bytes_a), "|")
        self.text_b = ids(len(tables.bytes_b), ","), ids(len(tables.bytes_b), ";")

    def a(self, text: str) -> np.ndarray:
        if self.fast is not None:
            return bpe.encode(text, self.fast).astype(np.int64)
        return np.array([i for p in bpe.pieces(text, PIECE) for i in self.slow.encode(p, add_special_tokens=False).ids], np.int64)

    def b(self, text: str) -> np.ndarray:
        """text begins with the space that the tokenizer adds."""
        parts = [p[1:] for p in bpe.pieces(text, PIECE)] if self.tables.splits else [text[1:]]
        return np.array([i for ids in self.sp.encode(parts, num_threads=1) for i in ids], np.int64)

    def both(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids by A and by B; none where either loses a byte of the text."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        raw = (" " + text).encode()
        a, b = self.a(" " + text), self.b(" " + text)
        t = self.tables
        if b"".join([t.bytes_a[i] for i in a.tolist()]) != raw or b"".join([t.bytes_b[i] for i in b.tolist()]) != raw:
            return none, none
        return a, b


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Group of each token of A and of B, and the links as places in A and in B; the number of groups last."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    starts_a = np.concatenate([[0], ends_a[:-1]])
    first = np.searchsorted(ends_b, starts_a, "right")  # the token of B that the first byte lies in
    last = np.searchsorted(ends_b, ends_a, "left")  # and the last byte
    width = last - first + 1
    link_a = np.repeat(np.arange(len(ends_a)), width)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(width) - width - first, width)
    return group_a, group_b, link_a, link_b, len(cuts)


def written(e: Encoders, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n: int) -> str:
    """a1,a2|b1;a3|b2,b3: the ids of each group in order."""
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    out = np.empty(len(a) + len(b), object)
    mid, end = e.text_a
    part = mid[a]
    part[upto_a - 1] = end[a[upto_a - 1]]
    out[np.arange(len(a)) + (upto_b - in_b)[group_a]] = part
    mid, end = e.text_b
    part = mid[b]
    part[upto_b - 1] = end[b[upto_b - 1]]
    out[np.arange(len(b)) + upto_a[group_b]] = part
    return "".join(out.tolist())[:-1]


def _worker(key: int, given) -> Encoders:
    """One for each worker process and pair of files."""
    if key not in _made:
        _made.clear()
        _made[key] = Encoders(*given.value)
    return _made[key]


_PER_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def links(docs: DataFrame, bpe_path: str, pieces_path: str, pattern: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times), one row per row of docs.

    pairs are the id pairs that links of the text hold, each once, ascending, as
    a * (ids of B) + b, and times how many of its links hold each.
    """
    spark = tuned(docs.sparkSession)
    raw = []
    for p in (bpe_path, pieces_path):
        with open(p, "rb") as f:
            raw.append(f.read())
    tables = tables_of(*raw)
    given = spark.sparkContext.broadcast((*raw, tables, pattern))
    key, base = hash((raw[0], raw[1], pattern)), len(tables.bytes_b)

    def of(e: Encoders, text: str):
        a, b = e.both(text)
        if not len(a):
            return 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int32)
        group_a, group_b, link_a, link_b, n = aligned(np.cumsum(e.length_a[a]), np.cumsum(e.length_b[b]))
        pairs, times = np.unique(a[link_a] * base + b[link_b], return_counts=True)
        sha = hashlib.sha256(written(e, a, b, group_a, group_b, n).encode()).hexdigest()
        return len(a), len(b), n, len(link_a), sha, pairs, times.astype(np.int32)

    def lists(arrays: list[np.ndarray], kind) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _worker(key, given)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                x = batch.slice(at, 64)
                n_a, n_b, n_groups, n_links, sha, pairs, times = zip(*(of(e, t.as_py() or "") for t in x.column(2)))
                numbers = [pa.array(v, pa.int64()) for v in (n_a, n_b, n_groups, n_links)]
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), *numbers, pa.array(sha, pa.string()), lists(pairs, pa.int64()), lists(times, pa.int32())], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"row long, doc_id long, {_PER_DOC}, pairs array<long>, times array<int>")


def _added(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal pairs added up."""
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p, t = np.concatenate(pairs), np.concatenate(times)
    order = np.argsort(p, kind="stable")
    p, t = p[order], t[order]
    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.empty(0, np.int64)
    return p[starts], np.add.reduceat(t, starts) if len(p) else t


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n): the links of the whole corpus that hold each pair.  Salted sums first, so that a pair of every text meets in SALTS tasks, then their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, held = [], [], 0

        def out():
            p, t = _added(pairs, times)
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(t, pa.int64())], ["pair", "n"])

        for b in batches:
            pairs.append(b.column(0).flatten().to_numpy())
            times.append(b.column(1).flatten().to_numpy().astype(np.int64))
            held += len(pairs[-1])
            if held > HELD:
                p, t = _added(pairs, times)
                pairs, times, held = [p], [t], len(p)
                if held > HELD // 2:
                    yield out()
                    pairs, times, held = [], [], 0
        yield out()

    partial = linked.select("pairs", "times").mapInArrow(run, "pair long, n long")
    salted = partial.groupBy("pair", (F.spark_partition_id() % SALTS).alias("salt")).agg(F.sum("n").alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("n"))


def ranked(counts: DataFrame, ids_b: int) -> DataFrame:
    """(pair, n, best): whether n is the highest of the pairs with the same id of B."""
    counts = counts.withColumn("b", F.col("pair") % ids_b)
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _common(pairs: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The least count such that at most COMMON_PAIRS pairs have it, and these pairs ascending with n and best."""
    at, least = 0, 1
    power = F.floor(F.log2("n")).cast("int")
    for k, rows in sorted(((r[0], r[1]) for r in pairs.groupBy(power).count().collect()), reverse=True):
        at += rows
        if at > COMMON_PAIRS:
            least = 1 << (k + 1)
            break
    t = pairs.filter(F.col("n") >= least).toArrow()
    p, n, best = (t.column(i).to_numpy() for i in range(3))
    order = np.argsort(p)
    return least, (p[order], n[order], best[order])


def tokenizer_links(docs: DataFrame, bpe_path: str, pieces_path: str, pattern: str, label: str = "links") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of docs.

    Texts that are null or empty, or that a tokenizer can't give back byte by
    byte, have no tokens: zeros and an empty groups_sha256.  Repeated rows stay
    and count each time; null doc_ids stay; other columns are ignored; an empty
    table gives no rows.
    """
    import sentencepiece

    spark = docs.sparkSession
    done = staged(links(docs, bpe_path, pieces_path, pattern), label)
    ids_b = sentencepiece.SentencePieceProcessor(model_file=pieces_path).vocab_size()
    pairs = staged(ranked(pair_counts(done), ids_b), label + "-pairs")
    least, arrays = _common(pairs)
    common = spark.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, best = common.value
        for b in batches:
            offsets = b.column(b.num_columns - 2).offsets.to_numpy()
            p = b.column(b.num_columns - 2).values.to_numpy()[offsets[0] : offsets[-1]]
            t = b.column(b.num_columns - 1).flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(key, p), max(0, len(key) - 1))
            found = key[at] == p if len(key) else np.zeros(len(p), bool)
            row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            total = lambda w, r: np.bincount(r, w, b.num_rows).astype(np.int64)
            sums = np.zeros(b.num_rows, np.int64)
            np.add.at(sums, row[found], t[found] * count[at[found]])
            n_best = total(t[found] * best[at[found]], row[found]) if found.any() else sums * 0
            rest = ~found
            left = np.concatenate([[0], np.cumsum(total(np.ones(int(rest.sum())), row[rest]))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[rest], kind)) for x, kind in ((p, pa.int64()), (t, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(n_best), pa.array(sums), *lists], [*b.schema.names[:-2], "n_best", "count_sum", "pairs", "times"])

    per_row = done.mapInArrow(run, f"row long, doc_id long, {_PER_DOC}, n_best long, count_sum long, pairs array<long>, times array<long>")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least == 1:
        return per_row.select(*out)
    per_row = staged(per_row, label + "-rest")
    rest = per_row.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("t"))
    rest = rest.join(pairs.filter(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.col("t") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("more_best"))
    both = per_row.drop("pairs", "times").join(rest, "row", "left")
    plus = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return both.select(*out[:5], plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")
