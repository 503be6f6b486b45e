"""Homomorphic multiset fingerprints of documents.

A paragraph (text between line feeds) is hashed to a wide vector: 8 lanes of 64 random
bits, and 256 lanes that take a signed count for each of its byte n-grams. A document's
fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo 2^64. So it doesn't depend on the order of paragraphs, a paragraph is inserted or
deleted by adding or subtracting its vector, and equal multisets have equal fingerprints.
The random lanes decide equality; the counts, an unbiased sketch of inner products, give the likeness of two documents (a cosine of n-gram counts, off by about 1/16).

Cases: a null text is the empty text, which is one empty paragraph; repeated rows follow
one another; a table of one document has itself as the next; an empty table gives no
rows; null ids come last; other columns are ignored. No text is long enough to make a
count wrap.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_rows, bucket_of, id_buckets, partitions, table, tidy

WIDE = 8
NARROW = 256
GRAM = 12
_R = [pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64) for k in range(4)]
_R1, _R2, _R4, _R8 = (np.uint64(r) for r in _R)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Fingerprint:
    """A sum of paragraph vectors; ``+`` and ``-`` insert and delete paragraphs."""

    __slots__ = ("wide", "narrow")

    def __init__(self, wide: np.ndarray, narrow: np.ndarray):
        self.wide, self.narrow = wide, narrow

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        return cls(*_vectors((text or "").encode("utf-8", "surrogatepass")))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.wide + other.wide, self.narrow + other.narrow)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.wide - other.wide, self.narrow - other.narrow)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.wide == other.wide).all() and (self.narrow == other.narrow).all())

    __hash__ = None

    def text(self) -> str:
        """Base64; the counts in as few bytes each as the largest needs (2, 4 or 8)."""
        size = next(k for k in (2, 4, 8) if k == 8 or -(1 << (8 * k - 1)) <= self.narrow.min() and self.narrow.max() < 1 << (8 * k - 1))
        return base64.b64encode(self.wide.astype("<u8").tobytes() + self.narrow.astype(f"<i{size}").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        size = (len(raw) - 8 * WIDE) // NARROW
        return cls(np.frombuffer(raw[: 8 * WIDE], "<u8").astype(np.uint64), np.frombuffer(raw[8 * WIDE :], f"<i{size}").astype(np.int64))

    def likeness(self, other: Fingerprint) -> float:
        """Cosine of the n-gram counts, 0 to 1; 1 for equal fingerprints."""
        if self == other:
            return 1.0
        a, b = (x.narrow.astype(np.float64) for x in (self, other))
        norm = float(np.sqrt((a @ a) * (b @ b)))
        return float(min(1.0, max(0.0, (a @ b) / norm))) if norm else 0.0


def _vectors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    paragraphs = raw.split(b"\n")
    digests = [hashlib.blake2b(p, digest_size=8 * WIDE).digest() for p in paragraphs]
    wide = np.frombuffer(b"".join(digests), "<u8").reshape(-1, WIDE).sum(0, dtype=np.uint64)
    counts = np.zeros(2 * NARROW, np.int64)
    short = [int.from_bytes(d[:2], "little") % (2 * NARROW) for p, d in zip(paragraphs, digests) if 0 < len(p) < GRAM]
    if short:
        counts += np.bincount(short, minlength=2 * NARROW)
    step = 1 << 20  # bounds the memory of very long texts
    for at in range(0, max(0, len(raw) - GRAM + 1), step):
        b = np.frombuffer(raw[at : at + step + GRAM - 1], np.uint8)
        x = b.astype(np.uint64) + np.uint64(1)
        h2 = x[:-1] * _R1 + x[1:]
        h4 = h2[:-2] * _R2 + h2[2:]
        h8 = h4[:-4] * _R4 + h4[4:]
        h = h8[:-4] * _R4 + h4[8:]  # GRAM bytes from each position
        h ^= h >> np.uint64(31)
        h *= _MIX
        lane = (h >> np.uint64(55)).astype(np.int64)
        feeds = np.flatnonzero(b == 10)
        if len(feeds):
            keep = np.ones(len(lane), bool)
            for p in feeds.tolist():
                keep[max(0, p - GRAM + 1) : p + 1] = False
            lane = lane[keep]
        counts += np.bincount(lane, minlength=2 * NARROW)
    return wide, counts[0::2] - counts[1::2]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(spark: SparkSession, docs: DataFrame, *, doc_id="doc_id", text="text", rows_per_bucket: int = 500) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and likenesses.

    Documents are dealt once, into ranges of ids; a range also gets the first document of
    the range that follows, so every document meets the next one without a global sort.
    """
    batch_rows(spark)
    docs = docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"coalesce(`{text}`, '') text")
    cuts, _ = id_buckets(docs.select("doc_id"), "doc_id", rows_per_bucket)
    docs = docs.withColumn("b", bucket_of("doc_id", cuts))
    # The first document of every range goes to the range above it; ranges are linked by their numbers alone.
    heads = docs.groupBy("b").agg(F.max("doc_id").alias("head"))
    links = heads.select("b", "head", F.coalesce(F.lead("b").over(Window.orderBy("b")), F.min("b").over(Window.partitionBy(F.lit(1)))).alias("to"))
    links = F.broadcast(links.withColumnRenamed("b", "from"))  # a row a range, at most 65,537
    ends = docs.join(links, (F.col("b") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("head")))
    ends = ends.groupBy(F.col("to").alias("b")).agg(F.max("text").alias("text"))
    rows = docs.select("b", F.lit(0).alias("end"), "doc_id", "text").unionByName(ends.select("b", F.lit(1).alias("end"), F.lit(None).cast("long").alias("doc_id"), "text"))
    n = max(partitions(spark), 1)
    rows = rows.repartition(n, "b").sortWithinPartitions("b", "end", F.col("doc_id").desc_nulls_last(), F.col("text").desc())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # (range, id, text, fingerprint) that waits for the next row
        for f in frames:
            out = []
            for b, end, i, t in zip(f["b"].tolist(), f["end"].tolist(), f["doc_id"].array, f["text"].tolist()):
                own = Fingerprint.of(t)
                if last is not None and last[0] == b:
                    _, j, s, fp = last
                    e = edited(s, t)
                    efp = Fingerprint.of(e)
                    sha = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((j, len(s), sha, fp.text(), efp.text(), fp.likeness(efp), fp.likeness(own)))
                last = None if end else (b, None if pd.isna(i) else int(i), t, own)
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return rows.mapInPandas(tidy(run), OUT)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(spark, table(spark, sf_dir, "documents"))
