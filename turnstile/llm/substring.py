"""Removing passages that repeat from documents with smaller ids.

A window is ``window`` consecutive words. Every text is cut in non-overlapping blocks of
``block`` words with 2 x block - 1 <= window, so each window of any text holds a whole
block of that text. The blocks are the index; every rolling run of ``block`` words of all
texts probes it. A run that is a block somewhere and occurs at least twice is an anchor.
Anchors are extended by one word at a time to both sides: the windows that hold one are
looked up by all their words, and where the same window starts in a document with a
smaller id its words are marked. Overlapping marked windows join, which gives the maximal
exact repeats of a window's length or more. Blocks are looked up by 54 bits of hash, which
can only add candidates; windows by 128 bits, of two independent hashes of their words, so
among 10^13 windows two different ones meet with a probability below 10^-12.

Cases: a null or empty text has no words; ids that are equal don't remove each other's
words, a null id counts as the largest; texts shorter than a window are kept whole;
repeats inside one document stay unless a smaller id holds them; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import CHUNK_BYTES, NULL_ID, U, Chunk, answer, bucket_count, by_bucket, joined, member, pack, send, windows, with_answers
from .common import Scratch, named, table, tidy

WINDOW = 13
BLOCK = 7


def _runs(c: Chunk, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text, and the words they start at."""
    all_runs = windows(h, n)
    ok = c.doc[: len(all_runs)] == c.doc[n - 1 :] if len(all_runs) else np.zeros(0, bool)
    return all_runs[ok], np.flatnonzero(ok)


def _index_and_probe(block: int, buckets: int):
    """Sends the distinct rolling runs; the lowest two bits tell: also a block, more than once."""

    def ask(row: pd.Series):
        c = Chunk(row["ids"], row["lens"], row["blob"])
        runs, at = _runs(c, c.hashes(), block)
        aligned = (at - c.first[c.doc[at]]) % block == 0 if len(at) else np.zeros(0, bool)
        keys = np.sort((runs & ~U(3)) | aligned.astype(U))
        base = keys & ~U(3)
        if not len(base):
            return
        new = np.concatenate([[True], base[1:] != base[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(base)]]))
        last = first + size - 1
        out = base[first] | (keys[last] & U(1)) | ((size > 1).astype(U) << U(1))
        for b, lo, hi in by_bucket(out, buckets):
            yield b, _short(out[lo:hi])

    return ask


def _short(keys: np.ndarray) -> bytes:
    """The lower 56 bits of keys; the upper ones follow from the bucket or aren't needed."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _long(payload: bytes) -> np.ndarray:
    out = np.zeros((len(payload) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(payload, np.uint8).reshape(-1, 7)
    return out.view("<u8").reshape(-1).astype(U)


def _anchors(payloads: list[bytes]) -> list[bytes]:
    """Answers each chunk the runs of its own that are a block somewhere and occur twice."""
    own = [_long(p) for p in payloads]
    every = np.sort(np.concatenate(own))
    base = every >> U(2)
    first = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]]))
    size = np.diff(np.concatenate([first, [len(base)]]))
    flags = np.bitwise_or.reduceat(every & U(3), first)
    good = base[first][((flags & U(1)) > 0) & ((size > 1) | ((flags & U(2)) > 0))]
    return [(k << U(2)).tobytes() if len(k := (o >> U(2))[member(o >> U(2), good)]) else b"" for o in own]


def _extend(window: int, block: int, buckets: int):
    """Sends the distinct windows that hold an anchor, with their smallest id in the chunk."""

    def ask(row: pd.Series):
        if row["answers"] is None or not len(row["answers"]):
            return
        c = Chunk(row["ids"], row["lens"], row["blob"])
        found = _candidates(c, row["answers"], window, block)
        for b, lo, hi in by_bucket(found.one, buckets):
            yield b, b"".join(x[lo:hi].tobytes() for x in (found.one, found.two, found.least))

    return ask


class _Found:
    """The windows of a chunk that hold an anchor: ``at`` (first words), ``which`` (of the distinct
    windows), and of these the two hashes, ascending, and the smallest id."""

    def __init__(self, c: Chunk, at: np.ndarray, one: np.ndarray, two: np.ndarray):
        order = np.lexsort((two, one))  # stable: of equal windows the smallest id comes first, as ids ascend
        one, two = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.at, self.which = at, np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.one, self.two = one[new].astype("<u8"), two[new].astype("<u8")
        self.least = c.ids[c.doc[at[order[new]]]].astype("<i8")


def _candidates(c: Chunk, answers, window: int, block: int) -> _Found:
    h = c.hashes()
    short = windows(h, block)
    mask = U((1 << 56) - 4)
    hit = member(short & mask, np.unique(joined(answers) & mask))
    upto = np.concatenate([[0], np.cumsum(hit)])
    runs, at = _runs(c, h, window)
    if not len(at):
        return _Found(c, at, runs, runs)
    holds = upto[at + window - block + 1] > upto[at]
    return _Found(c, at[holds], runs[holds], windows(c.hashes(1), window)[at[holds]])


def _earliest(payloads: list[bytes]) -> list[bytes]:
    """Answers each chunk the places, among the windows it sent, of those that another one holds in a smaller id."""
    own = [np.frombuffer(p, "<u8").reshape(3, -1) for p in payloads]
    one, two, ids = (np.concatenate(x) for x in zip(*own))
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    least = np.minimum.reduceat(ids.view(np.int64)[order], np.flatnonzero(new))
    smaller = np.empty(len(order), bool)
    smaller[order] = ids.view(np.int64)[order] > least[np.cumsum(new) - 1]
    cut = np.cumsum([x.shape[1] for x in own])[:-1]
    return [b"+" + np.flatnonzero(x).astype("<u4").tobytes() for x in np.split(smaller, cut)]


def _mark(c: Chunk, anchors, smaller, window: int, block: int, buckets: int) -> np.ndarray:
    """Which words of the chunk are covered."""
    cover = np.zeros(len(c.starts) + 1, np.int64)
    if anchors is not None and len(anchors):
        found = _candidates(c, anchors, window, block)
        elsewhere = np.zeros(len(found.one), bool)
        for (_, lo, _), places in zip(by_bucket(found.one, buckets), smaller if smaller is not None else ()):
            elsewhere[lo + np.frombuffer(places, "<u4", offset=1).astype(np.int64)] = True
        bad = elsewhere[found.which] | (c.ids[c.doc[found.at]] > found.least[found.which])
        np.add.at(cover, found.at[bad], 1)
        np.add.at(cover, found.at[bad] + window, -1)
    return np.cumsum(cover)[:-1] > 0


def remove_repeats(spark: SparkSession, docs: DataFrame, *, doc_id="doc_id", text="text", window=WINDOW, block=BLOCK, rest: list[str] = (), chunk_bytes=CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept[, rest]) of every document.

    ``removed``: the maximal covered spans as (first word, words); ``kept``: the words
    that stay, joined by one space. ``rest``: columns to carry along as one struct; then
    ``kept`` is the text itself without the spans, white space and all. ``chunk_bytes``: text
    that a task works on at a time, for its memory; rows don't depend on it.
    """
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block: 2 * block - 1 <= window")
    scratch = Scratch(spark, "substring")
    base = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"), *([F.struct(*[named(c).alias(c) for c in rest]).alias("rest")] if rest else []))
    chunks = pack(scratch, base, chunk_bytes=chunk_bytes)
    total = chunks.select(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = bucket_count(total // 6)
    plain = chunks.select("chunk", "ids", "lens", "blob")
    anchors = scratch.cut(answer(send(plain, _index_and_probe(block, buckets)), _anchors))
    held = with_answers(plain, anchors)
    smaller = scratch.cut(answer(send(held, _extend(window, block, buckets)), _earliest))
    marked = with_answers(held, smaller, "smaller")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, row in f.iterrows():
                c = Chunk(row["ids"], row["lens"], row["blob"])
                gone = _mark(c, row["answers"], row["smaller"], window, block, buckets)
                out = []
                for k in range(len(c.ids)):
                    a, n = int(c.first[k]), int(c.words[k])
                    text = c.raw[c.begin[k] : c.begin[k] + c.lens[k]]
                    words = [] if rest else text.split()
                    g = gone[a : a + n]
                    spans = []
                    if g.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                        spans = [{"first": s, "words": e - s} for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist())]
                        if rest:  # from the first word of a span to the next word that stays
                            cut = np.concatenate([c.starts[a : a + n] - c.begin[k], [len(text)]])
                            ends = [0, *(int(cut[s["first"] + s["words"]]) for s in spans)]
                            text = b"".join(text[e : int(cut[s["first"]])] for e, s in zip(ends, spans)) + text[ends[-1] :]
                        words = [w for w, x in zip(words, g.tolist()) if not x]
                    i = int(c.ids[k])
                    text = text if rest else b" ".join(words)
                    out.append((row["chunk"], k, None if i == NULL_ID else i, n, int(g.sum()), spans, text.decode("utf-8", "replace")))
                frame = pd.DataFrame(out, columns=["chunk", "pos", "doc_id", "n_words", "n_removed", "removed", "kept"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    out = marked.mapInPandas(tidy(run), "chunk long, pos int, doc_id long, n_words long, n_removed long, removed array<struct<first:long,words:long>>, kept string")
    if rest:
        more = chunks.select("chunk", F.posexplode("rest").alias("pos", "rest"))
        out = out.join(more, ["chunk", "pos"])
    return out.drop("chunk", "pos")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that earlier documents hold in windows of 13 words."""
    out = remove_repeats(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
