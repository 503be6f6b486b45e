"""Corpus-wide lookups without shuffling a row for every word.

Documents are packed into chunks of some megabytes of text (a compressed blob a chunk, a
written table). A pass over the chunks sends, to each bucket of a hash space, one sorted
array of the distinct keys it asks about; a reducer sees the arrays of one bucket, of all
chunks, and answers each chunk with one array. A key that a third of the corpus holds
is sent once a chunk. Joining answers to chunks by number moves blobs, never rows of words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, give_back, tidy

CHUNK_BYTES = 4 << 20
KEYS_PER_BUCKET = 250_000
LETTERS = 1 << 17  # hashed at a time, but for a longer word: each letter takes some 40 bytes meanwhile
U = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NULL_ID = (1 << 63) - 1  # a null id counts as larger than any other


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_SEEDS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_TABLES = [mix64(np.arange(1, 257, dtype=U) * s) for s in _SEEDS]  # random multipliers of the places in a word


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the starts and ends of the words of ``raw``."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.empty(len(b) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_WS[b], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: a sum of bytes times random multipliers of their places, mixed with the length.

    ``which``: one of two independent ones.
    """
    if not len(starts):
        return np.zeros(0, U)
    b, lengths = np.frombuffer(raw, np.uint8), ends - starts
    most = int(lengths.max())
    if most > len(_TABLES[which]):
        _TABLES[which] = mix64(np.arange(1, most + 1, dtype=U) * _SEEDS[which])
    upto = np.cumsum(lengths)
    cuts = np.searchsorted(upto, np.arange(LETTERS, int(upto[-1]), LETTERS))
    edges = np.unique(np.concatenate([[0], cuts, [len(starts)]])).tolist()
    out = np.empty(len(starts), U)
    for lo, hi in zip(edges[:-1], edges[1:]):
        n = lengths[lo:hi]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        letters = b[place + np.repeat(starts[lo:hi], n)].astype(U)
        out[lo:hi] = mix64(np.add.reduceat(_TABLES[which][place] * (letters + U(1)), first) + n.astype(U))
    return out


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` consecutive hashes (a polynomial built by doubling)."""
    if len(h) < n:
        return np.zeros(0, U)
    r, acc, size, bit = U(0xD1342543DE82EF95), None, 0, 1
    power, run = r, h  # run covers ``bit`` elements, power is r ** bit
    with np.errstate(over="ignore"):
        while bit <= n:
            if n & bit:
                m = len(h) - (size + bit) + 1
                acc = run[:m].copy() if acc is None else acc[:m] * power + run[size : size + m]
                size += bit
            if bit * 2 <= n:
                run = run[:-bit] * power + run[bit:]
            power, bit = power * power, bit * 2
        return mix64(acc)


def pack(scratch: Scratch, docs: DataFrame, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, ids, lens, blob, rest): the documents (doc_id, text[, rest]) in chunks, by ascending id within one.

    ``lens`` are the bytes of each text, a null text has none. ``rest`` keeps other columns.
    """
    rest = "rest" in docs.columns
    kind = [("chunk", T.LongType()), ("ids", T.ArrayType(T.LongType())), ("lens", T.ArrayType(T.LongType())), ("blob", T.BinaryType())]
    kind += [("rest", T.ArrayType(docs.schema["rest"].dataType))] if rest else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        squeeze = zstandard.ZstdCompressor(level=1)

        def close() -> pd.DataFrame:
            order = sorted(range(len(held)), key=lambda k: held[k][0])
            out = {
                "chunk": [number], "ids": [[held[k][0] for k in order]], "lens": [[len(held[k][1]) for k in order]],
                "blob": [squeeze.compress(b"".join(held[k][1] for k in order))],
            }
            if rest:
                out["rest"] = [[held[k][2] for k in order]]
            return pd.DataFrame(out)

        for f in frames:
            more = f["rest"].tolist() if rest else [None] * len(f)
            if rest and isinstance(f["rest"], pd.DataFrame):
                more = f["rest"].to_dict("records")
            for i, t, m in zip(f["doc_id"].array, f["text"].tolist(), more):
                raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
                held.append((NULL_ID if pd.isna(i) else int(i), raw, m))
                size += len(raw) + 16
                if size >= chunk_bytes:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return scratch.cut(docs.mapInPandas(tidy(run), T.StructType([T.StructField(*x) for x in kind])))


class Chunk:
    """The texts of a chunk as one byte string, with its words."""

    def __init__(self, ids, lens, blob: bytes, lower: bool = False):
        self.ids = np.asarray(ids, np.int64)
        self.lens = np.asarray(lens, np.int64)
        raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, int(self.lens.sum())))
        # A line feed between texts keeps the last word of one from running into the next.
        at = np.concatenate([[0], np.cumsum(self.lens)])
        parts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        self.raw = b"\n".join(parts) + b"\n"
        if lower:
            self.raw = self.raw.lower()
        self.begin = at[:-1] + np.arange(len(self.lens))  # where texts begin in raw
        self.starts, self.ends = word_spans(self.raw)
        self.first = np.searchsorted(self.starts, self.begin)  # index of a text's first word
        self.words = np.diff(np.concatenate([self.first, [len(self.starts)]]))
        self.doc = np.repeat(np.arange(len(self.ids)), self.words)  # text of each word

    def hashes(self, which: int = 0) -> np.ndarray:
        return word_hashes(self.raw, self.starts, self.ends, which)


def bucket_count(keys: int) -> int:
    """A power of two of buckets, about KEYS_PER_BUCKET keys each."""
    want = max(16, keys // KEYS_PER_BUCKET + 1)
    return 1 << (want - 1).bit_length()


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of ascending ``keys``, dealt by their upper bits."""
    shift = U(64 - buckets.bit_length() + 1)
    b = (keys >> shift).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]])
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if hi > lo:
            yield int(b[lo]), lo, hi


def send(chunks: DataFrame, ask: Callable[[pd.Series], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """(chunk, bucket, payload) for what ``ask`` yields of each chunk row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, row in f.iterrows():
                got = list(ask(row))
                yield pd.DataFrame({"chunk": row["chunk"], "bucket": [b for b, _ in got], "payload": [p for _, p in got]})

    return chunks.mapInPandas(tidy(run), "chunk long, bucket int, payload binary")


def answer(messages: DataFrame, reduce: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(chunk, payload): ``reduce`` turns the payloads of a bucket into one for each of their chunks (b'' for none)."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("chunk")
        out = reduce(f["payload"].tolist())
        keep = [bool(p) for p in out]
        give_back()
        return pd.DataFrame({"chunk": f["chunk"][keep], "bucket": f["bucket"][keep], "payload": [p for p in out if p]})

    return messages.groupBy("bucket").applyInPandas(run, "chunk long, bucket int, payload binary")


def with_answers(chunks: DataFrame, answers: DataFrame, name: str = "answers") -> DataFrame:
    """The chunks with the payloads sent to them, by ascending bucket."""
    got = answers.groupBy(F.col("chunk").alias("to")).agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "payload"))), lambda x: x["payload"]).alias(name))
    return chunks.join(got, F.col("chunk") == F.col("to"), "left").drop("to")


def joined(payloads, dtype="<u8") -> np.ndarray:
    """The arrays of some payloads, one after the other."""
    return np.frombuffer(b"".join(payloads), dtype) if payloads is not None and len(payloads) else np.zeros(0, dtype)


def member(keys: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which of ``keys`` occur in ``ascending``."""
    if not len(ascending):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(ascending, keys), len(ascending) - 1)
    return ascending[at] == keys
