"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function maps a document's shingles to numbers; the ``k`` smallest are its
sketch. Documents of equal shingle sets form a class, its smallest id stands for it.
Two sets of Jaccard similarity s share a value among the k smallest of their union with
probability s each, so linked classes share at least ``t`` sketch values but for five
standard deviations. Inverted lists of retained values find them: a value goes in only if
it is among the k - t + 1 rarest of its sketch (each pair with t shared values meets in
such a list) and a second class holds it. The lists of one smallest class, its pivot, form
a group. Within a group overlaps of sketches are counted by the inverted lists, the
estimate from the union's sketch filters, and the whole shingle sets of what is left
decide exactly. A group emits a spanning forest of its links, never all of them; a group
above ``BLOCK`` members, or ``BLOCK_SHINGLES`` shingles of whole sets, is compared in pairs
of blocks. Components of these edges follow.

Cases: null and empty texts have no shingles and no links; a text of fewer words than a
shingle is one shingle; repeated rows and rows of one id are one document; rows without
id have no component and are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import U, mix64, windows, word_hashes, word_spans
from .common import Scratch, by_groups, named, probably_in, table, tidy, whole_groups
from .components import components

K = 64
BLOCK = 4096
BLOCK_SHINGLES = 4_000_000  # of whole sets in one block: 32 MB of numbers and about as much text


def least_overlap(k: int, threshold: float) -> int:
    """Sketch values that sets of at least this similarity share, but for five standard deviations."""
    return max(0, math.floor(k * threshold - 5 * math.sqrt(k * threshold * (1 - threshold))))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The ascending distinct 63-bit hashes of a text's word shingles."""
    raw = text.encode("utf-8", "surrogatepass").lower() if isinstance(text, str) else b""
    h = word_hashes(raw, *word_spans(raw)) if raw else np.zeros(0, U)
    if not len(h):
        return np.zeros(0, np.int64)
    return np.unique(windows(h, min(n, len(h))) >> U(1)).astype(np.int64)


def sketches(docs: DataFrame, n: int, k: int) -> DataFrame:
    """(doc_id, n, k1, k2, sketch): set size, a 128-bit digest of the set, its k smallest hashes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, t in zip(f["doc_id"].array, f["text"].tolist()):
                s = shingles(t, n)
                u = s.astype(U)
                k1, k2 = (int(mix64(u * U(m) + U(1)).sum(dtype=U).astype(np.int64)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
                out.append((None if pd.isna(i) else int(i), len(s), k1, k2, s[:k]))
            frame = pd.DataFrame(out, columns=["doc_id", "n", "k1", "k2", "sketch"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.mapInPandas(tidy(run), "doc_id long, n long, k1 long, k2 long, sketch array<long>")


class Overlaps:
    """Intersection sizes of one set with all others, through inverted lists of shared elements."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        every, self.owner = every[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        self.values, self.lo = every[first], first
        self.hi = np.concatenate([first[1:], [len(every)]]) if len(first) else first

    def row(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.values, s)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == s)]
        lists = [self.owner[a:b] for a, b in zip(self.lo[at].tolist(), self.hi[at].tolist())]
        return np.bincount(np.concatenate(lists), minlength=len(self.sizes)) if lists else np.zeros(len(self.sizes), np.int64)


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Share of the k smallest values of the union that both ascending sketches hold."""
    both = np.sort(np.concatenate([a, b]))
    same = both[1:][both[1:] == both[:-1]]
    union = np.unique(both)
    union = union[: min(k, max(len(a), len(b)) if len(union) >= k else len(union))]
    return float((same <= union[-1]).sum()) / len(union) if len(union) else 0.0


def _promising(sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, threshold: float, k: int) -> np.ndarray:
    """Members for which the sketch of the union with some other one allows the threshold."""
    over = Overlaps(sets)
    need = np.array([least_overlap(len(s), threshold) for s in sets])
    low = threshold - 5 * math.sqrt(threshold * (1 - threshold) / k)
    found = np.zeros(len(sets), bool)
    for i, s in enumerate(sets):
        c = over.row(s)
        ok = (c >= np.maximum(1, np.minimum(need, need[i]))) & (np.minimum(sizes, sizes[i]) >= threshold * np.maximum(sizes, sizes[i]) - 1e-9)
        ok[i] = False
        if side[i] >= 0:
            ok &= side != side[i]
        j = np.flatnonzero(ok)
        if found[i]:
            j = j[~found[j]]
        j = j[np.argsort(-c[j], kind="stable")]
        for x in j.tolist():
            if found[i] and found[x]:
                continue
            if max(len(s), len(sets[x])) < k or union_estimate(s, sets[x], k) >= low:
                found[i] = found[x] = True
    return found


def _forest(sets: list[np.ndarray], names: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with den * |A n B| >= num * |A u B|."""
    over = Overlaps(sets)
    label = np.arange(len(sets))
    edges = []
    for i, s in enumerate(sets):
        c = over.row(s)
        ok = den * c >= num * (over.sizes + over.sizes[i] - c)
        ok &= (label != label[i]) & (c > 0)
        if side[i] >= 0:
            ok &= side != side[i]
        for j in np.flatnonzero(ok).tolist():
            if label[j] != label[i]:
                edges.append((int(names[i]), int(names[j])))
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
    return edges


def _blocks(groups: DataFrame, size: int, load: str = "1L", most: int = BLOCK) -> DataFrame:
    """(p, rep) dealt to (p, i, j, side): one block for a group of up to ``size`` members and a ``load``
    of ``most``, else every pair of blocks, with ``side`` 0 and 1 for the two and -1 within one block."""
    n = groups.groupBy("p").agg(F.ceil(F.greatest(F.count("*") / size, F.sum(F.expr(load)) / most)).cast("int").alias("blocks"))
    g = groups.join(n, "p").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    g = g.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return g.select("p", "rep", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))


def linked(
    spark: SparkSession, docs: DataFrame, *, doc_id="doc_id", text="text", words: int = 5, threshold: float = 0.8, k: int = K, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document. ``threshold`` counts in hundredths."""
    scratch = Scratch(spark, "neardup")
    num = round(threshold * 100)
    docs = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"))
    every = scratch.cut(sketches(docs, words, k))
    held = every.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.cut(held.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")))
    reps = held.join(classes.select("k1", "k2", "n", "rep"), ["k1", "k2", "n"]).where("doc_id = rep").select("rep", "n", "sketch").dropDuplicates(["rep", "n", "sketch"])
    reps = scratch.cut(reps)

    values = reps.select("rep", F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("df")).where("df >= 2")
    need = F.greatest(F.lit(0), F.floor(F.col("k") * threshold - 5 * F.sqrt(F.col("k") * threshold * (1 - threshold))))
    rare = values.join(often, "v").groupBy("rep", "k").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("xs"))
    rare = rare.withColumn("m", (F.size("xs") - need + 1).cast("int")).where("m > 0").select("rep", F.explode(F.slice("xs", 1, F.col("m"))["v"]).alias("v"))
    lists = scratch.cut(rare.distinct())
    pivots = lists.groupBy("v").agg(F.min("rep").alias("p"), F.count("*").alias("c")).where("c >= 2")
    groups = scratch.cut(lists.join(pivots, "v").select("p", "rep").distinct())
    scratch.drop(lists)

    keys = ["p", "i", "j"]

    def promising(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, at in whole_groups(frames, keys):
            good = np.zeros(len(f), bool)
            sketch, n, side = (f[c].to_numpy() for c in ("sketch", "n", "side"))
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                if hi - lo > 1:
                    good[lo:hi] = _promising(list(sketch[lo:hi]), n[lo:hi], side[lo:hi], threshold, k)
            yield f.loc[good, ["p", "rep", "n"]]

    dealt = _blocks(groups, block, most=block).join(reps, "rep")
    left = scratch.cut(by_groups(dealt, keys).mapInPandas(tidy(promising), "p long, rep long, n long").distinct())

    def forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, at in whole_groups(frames, keys):
            texts, rep, side = (f[c].to_numpy() for c in ("text", "rep", "side"))
            edges = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                order = lo + np.lexsort((side[lo:hi], rep[lo:hi]))
                edges += _forest([shingles(t, words) for t in texts[order]], rep[order], side[order], num, 100)
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    texts = probably_in(docs, "doc_id", left, "rep").join(left.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").withColumnRenamed("doc_id", "rep")
    edges = by_groups(_blocks(left, block, "n", BLOCK_SHINGLES).join(texts, "rep"), keys).mapInPandas(tidy(forest), "a long, b long")
    comp = components(scratch, edges)
    scratch.drop(groups, left)

    # A row of a class whose smallest id is shared between classes keeps to that id.
    out = every.join(classes, ["k1", "k2", "n"], "left").join(comp, F.col("rep") == F.col("node"), "left")
    found = F.when(F.col("n") > 0, F.coalesce("comp", "rep", "doc_id")).otherwise(F.col("doc_id"))
    found = F.when(F.col("doc_id").isNotNull(), found)
    return out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components: three words a shingle, Jaccard of at least 0.85."""
    return linked(spark, table(spark, sf_dir, "documents"), words=3, threshold=0.85)


def without_near_copies(spark: SparkSession, docs: DataFrame, *, doc_id="doc_id", **how) -> DataFrame:
    """The rows of ``docs``, all columns, of one document for each component: that of its smallest id.

    Rows of one id are one document: all of them stay or go together, equal rows as one.
    Rows without id stay.
    """
    kept = linked(spark, docs, doc_id=doc_id, **how).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    known = named(doc_id).isNotNull()
    held = docs.where(known).join(kept, named(doc_id).cast("long") == F.col("kept_id"), "left_semi").dropDuplicates()
    return held.unionByName(docs.where(~known))
