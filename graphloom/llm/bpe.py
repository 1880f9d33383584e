"""Byte-level BPE by tiktoken with a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import tuned

#: Texts are encoded in pieces of about so many characters.
PIECE = 1 << 15
#: No match of the pattern goes on from a letter, digit or underscore to a space: only white space may follow white space inside one.
_SAFE = re.compile(r"(?<=\w)(?= )")
#: Unicode white space, which \s of the pattern means.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space that the pattern isn't tried on: its engine needs stack for each character of one.
_LONG = re.compile(f"[{BLANK}]{{4096,}}")
_made: dict = {}


def _encoding(ranks: bytes, pattern: str):
    """One for each worker process and rank file."""
    key = (hash(ranks), pattern)
    if key not in _made:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _made[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _made[key]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in parts of size characters, each prolonged to the next safe boundary."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def matches(text: str) -> Iterator[tuple[bool, str]]:
    """The text in parts: (True, a single match of the pattern) or (False, a part that the pattern is tried on).

    A long run of white space is one match up to its last character, and whole
    at the end of the text.  Its last character goes with what follows.  A blank
    in front of the run is part of it, so that what comes before ends in no
    white space and its matches end there too.
    """
    at = 0
    for run in _LONG.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > at:
            yield False, text[at : run.start()]
        yield True, text[run.start() : end]
        at = end
    if at < len(text):
        yield False, text[at:]


def encode(text: str, enc) -> np.ndarray:
    """ids as little-endian unsigned 32-bit integers, the same as those of the whole text at once."""
    parts = [np.empty(0, "<u4")]
    for single, part in matches(text):
        if single:
            parts.append(np.array(enc._encode_single_piece(part), "<u4"))
        else:
            parts += [np.array(enc.encode_ordinary(p), "<u4") for p in pieces(part)]
    return np.concatenate(parts)


def decode(ids: np.ndarray, enc) -> bytes:
    """Raw bytes, in parts, so that a long text needs no list of all its ids."""
    return b"".join(enc.decode_bytes(ids[a : a + PIECE].tolist()) for a in range(0, len(ids), PIECE))


def _ranks(spark, path: str):
    """The rank file as a broadcast: it is read once, by the driver, and has under a megabyte."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, path: str, pattern: str, id_name: str = "doc_id") -> DataFrame:
    """(id_name, n_tokens, ids) with ids as binary, one row per row of docs; a null text is an empty one."""
    spark = tuned(docs.sparkSession)
    ranks = _ranks(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks.value, pattern)
        for b in batches:
            ids = [encode(t.as_py() or "", enc) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], [id_name, "n_tokens", "ids"])

    kind = docs.schema[id_name].dataType.simpleString()
    return docs.select(id_name, F.col("text").cast("string")).mapInArrow(run, f"`{id_name}` {kind}, n_tokens long, ids binary")


def decoded(tokens: DataFrame, path: str, pattern: str, id_name: str = "doc_id") -> DataFrame:
    """(id_name, bytes) from (id_name, ids); null ids give no bytes."""
    spark = tuned(tokens.sparkSession)
    ranks = _ranks(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks.value, pattern)
        for b in batches:
            raw = [decode(np.frombuffer(x.as_py() or b"", "<u4"), enc) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], [id_name, "bytes"])

    kind = tokens.schema[id_name].dataType.simpleString()
    return tokens.select(id_name, "ids").mapInArrow(run, f"`{id_name}` {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of docs.

    Each text is encoded, and its ids are decoded again, in one pass; digests
    are of the ids as bytes and of the decoded bytes.  Null text: empty.
    Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    spark = tuned(docs.sparkSession)
    ranks = _ranks(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks.value, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            rows = []
            for t in b.column(1):
                ids = encode(t.as_py() or "", enc)
                rows.append((len(ids), sha(ids.tobytes()), sha(decode(ids, enc))))
            n, a, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
