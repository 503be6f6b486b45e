"""Near-duplicate embeddings by lattice hashing.

Directions are projected at random to ``PARTS`` times eight dimensions, once for each table,
and each eight are decoded to the nearest point of the E8 lattice; the points together are
the vector's cell. A vector also visits the cells made of the ``probes`` neighbouring
points that lie nearest to each of its projections. Vectors that meet in a cell, one at
home there, are compared by cosine in double precision. A pair is counted in the first
table it meets in (once if it meets in two cells of it), so counts of links need no table
of pairs; a cell emits counts and a spanning forest. A cell of more than ``BLOCK`` vectors
is compared in pairs of blocks, all of them.

One setting (``SETTING``) serves tables of every size, so whether a pair is found follows from
its two vectors alone. By simulation (64 dimensions, 6,000 pairs) a pair of cosine 0.9 meets
with probability 0.991, one of 0.93 with 0.9998, and a vector is compared with 0.0005 of
random others.

Cases: vectors that are null, empty, zero or hold nulls or non-finite numbers have no
links; equal vectors are one class and linked with each other; vectors of different
lengths aren't linked; rows without id have no links and no component and are kept; rows
of one id with different vectors share a component; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import U, mix64
from .common import Scratch, by_groups, named, table, tidy, whole_groups
from .components import components
from .lattice import decode, neighbours

PARTS = 2
BLOCK = 4096
PAIRS = 1 << 18  # counted at a time
SEED = 5
_PROJECTIONS: dict[tuple, np.ndarray] = {}


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _cell(points: np.ndarray, t: int) -> np.ndarray:
    """A 64-bit name of lattice points (... x 8) of table ``t``."""
    h = np.full(points.shape[:-1], U(t + 1))
    for k in range(8):
        h = mix64(h * U(0x9E3779B97F4A7C15) + points[..., k].astype(U))
    return h.astype(np.int64)


@dataclass(frozen=True)
class Setting:
    """``scale``: how fine the cells are."""

    tables: int
    probes: int
    scale: float


SETTING = Setting(19, 2, 0.6)


def setting_for(vectors: int) -> Setting:
    """``SETTING``, whatever the number of vectors."""
    return SETTING


def cells(x: np.ndarray, t: int, how: Setting) -> tuple[np.ndarray, np.ndarray]:
    """Home cell and visited cells of unit vectors in table ``t``."""
    key = (x.shape[1], t, how.scale)
    if key not in _PROJECTIONS:
        _PROJECTIONS[key] = np.random.default_rng([SEED, t, x.shape[1]]).standard_normal((x.shape[1], 8 * PARTS)) * how.scale
    y = x @ _PROJECTIONS[key]
    every = np.zeros((len(x), 1), U)  # the home first, then the other combinations of points
    for k in range(PARTS):
        part = y[:, 8 * k : 8 * k + 8]
        home = decode(part)
        points = np.concatenate([_cell(home, t)[:, None], _cell(neighbours(part, home, how.probes), t)], 1).astype(U)
        every = mix64(every[:, :, None] * U(0x9E3779B97F4A7C15) + points[:, None, :]).reshape(len(x), -1)
    every = every.astype(np.int64)
    return every[:, 0], every[:, 1:]


def _met(i: np.ndarray, j: np.ndarray, home: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return (home[i] == home[j]) | (seen[i] == home[j][:, None]).any(1) | (seen[j] == home[i][:, None]).any(1)


class _Links:
    """New links of the rows of a frame (in copies of the other's class); pairs of many cells are counted at once."""

    def __init__(self, f: pd.DataFrame, how: Setting):
        self.ids, self.order, self.mult, self.cell, self.v = (f[c].to_numpy() for c in ("rep", "h", "mult", "cell", "v"))
        self.how, self.links = how, np.zeros(len(f), np.int64)
        self.kind, self.held, self.n = None, [], 0

    def add(self, i: np.ndarray, j: np.ndarray, size: int, t: int) -> None:
        """Pairs of rows, vectors of ``size``, that meet in a cell of table ``t``."""
        for k in range(0, len(i), PAIRS):
            if self.kind != (size, t) or self.n >= PAIRS:
                self.count()
            self.kind, self.n = (size, t), self.n + len(i[k : k + PAIRS])
            self.held.append((i[k : k + PAIRS], j[k : k + PAIRS]))

    def count(self) -> None:
        if not self.held:
            return
        (i, j), (size, t) = map(np.concatenate, zip(*self.held)), self.kind
        self.held, self.n = [], 0
        for s in range(t + 1):
            rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            home, seen = cells(unit(np.concatenate(self.v[rows]).reshape(-1, size).astype(np.float64)), s, self.how)
            p, q = at[: len(i)], at[len(i) :]
            if s < t:
                new = ~_met(p, q, home, seen)
            else:
                new = np.ones(len(i), bool)
                apart = np.flatnonzero(home[p] != home[q])  # such a pair may meet in the home of either; the home of the smaller one counts
                a, b = i[apart], j[apart]
                smaller = (self.ids[a] < self.ids[b]) | ((self.ids[a] == self.ids[b]) & (self.order[a] < self.order[b]))
                lo, hi = np.where(smaller, p[apart], q[apart]), np.where(smaller, q[apart], p[apart])
                twice = (seen[lo] == home[hi][:, None]).any(1) & (seen[hi] == home[lo][:, None]).any(1)
                new[apart[twice & (home[lo] != self.cell[a])]] = False
            i, j = i[new], j[new]
            if not len(i):
                return
        np.add.at(self.links, i, self.mult[j])
        np.add.at(self.links, j, self.mult[i])


def _compare(x, ids, side, at_home, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Pairs of close unit vectors of a cell, and with them edges of a spanning forest."""
    label = np.arange(len(x))
    for a in range(0, len(x), 512):
        close = x[a : a + 512] @ x.T >= least
        i, j = np.nonzero(close)
        i += a
        ok = (i < j) & (at_home[i] | at_home[j]) & ((side[i] < 0) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        edges = []
        for p, q in zip(i.tolist(), j.tolist()) if len(i) < 64 else _pairs(i, j, label):
            if label[p] != label[q]:
                edges.append((int(ids[p]), int(ids[q])))
                lo, hi = sorted((label[p], label[q]))
                label[label == hi] = lo
        yield i, j, edges


def _pairs(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of many pairs, those that still join two parts, looked up again after each join."""
    while True:
        open_ = np.flatnonzero(label[i] != label[j])
        if not len(open_):
            return
        i, j = i[open_], j[open_]
        _, first = np.unique(label[i], return_index=True)
        for k in first.tolist():
            yield int(i[k]), int(j[k])


def linked(
    spark: SparkSession, vectors: DataFrame, *, vec_id="vec_id", embedding="embedding", least: float = 0.9,
    how: Setting = SETTING, block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    scratch = Scratch(spark, "embeddings")
    v = named(embedding)
    single = isinstance(vectors.schema[embedding].dataType, T.ArrayType) and isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType)
    rows = vectors.select(named(vec_id).cast("long").alias("vec_id"), (v if single else v.cast("array<double>")).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("h", F.xxhash64("v"))
    classes = scratch.cut(good.groupBy("v", "h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")))

    def codes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["size"] = f["v"].map(len)
            for size, g in f.groupby("size"):
                x = unit(np.stack(g["v"].to_numpy()).astype(np.float64))
                for t in range(how.tables):
                    home, seen = cells(x, t, how)
                    cell = np.concatenate([home, seen.T.reshape(-1)])
                    n = seen.shape[1] + 1
                    yield pd.DataFrame({
                        "rep": np.tile(g["rep"].to_numpy(), n), "h": np.tile(g["h"].to_numpy(), n), "size": size, "t": t,
                        "cell": cell, "home": np.arange(len(cell)) < len(home),
                    })

    held = scratch.cut(classes.mapInPandas(tidy(codes), "rep long, h long, size int, t int, cell long, home boolean"))
    busy = held.groupBy("size", "t", "cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("homes")).where("n >= 2 AND homes >= 1")
    busy = busy.select("size", "t", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = held.join(busy, ["size", "t", "cell"]).withColumn("own", F.pmod(F.xxhash64("rep", "h"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("rep", "h", "size", "t", "cell", "home", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))
    dealt = dealt.join(classes.withColumn("size", F.size("v")), ["rep", "h", "size"])

    keys = ["size", "t", "cell", "i", "j"]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, at in whole_groups(frames, keys):
            ids, h, side, at_home, ts, sizes, vs = (f[c].to_numpy() for c in ("rep", "h", "side", "home", "t", "size", "v"))
            links, out = _Links(f, how), []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                if hi - lo < 2 or not at_home[lo:hi].any():
                    continue
                k = lo + np.lexsort((h[lo:hi], ids[lo:hi]))
                x = unit(np.concatenate(vs[k]).reshape(-1, sizes[lo]).astype(np.float64))
                for i, j, edges in _compare(x, ids[k], side[k], at_home[k], least):
                    links.add(k[i], k[j], int(sizes[lo]), int(ts[lo]))
                    out += [(p, None, q, None) for p, q in edges]
            links.count()
            some = np.flatnonzero(links.links)
            out += zip(ids[some].tolist(), h[some].tolist(), [None] * len(some), links.links[some].tolist())
            columns = zip(*out) if out else [()] * 4
            yield pd.DataFrame({c: pd.array(list(v), "Int64") for c, v in zip("ahbn", columns)})  # whole longs, nulls and all

    found = scratch.cut(by_groups(dealt, keys).mapInPandas(tidy(compare), "a long, h long, b long, n long"))
    scratch.drop(held)
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep"), "h").agg(F.sum("n").alias("links"))
    same_id = good.groupBy("vec_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi")
    own = good.join(classes.select("v", "h", "rep"), ["v", "h"]).join(same_id, "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    comp = components(scratch, found.where("b IS NOT NULL").select("a", "b").union(own))
    classes = classes.join(links, ["rep", "h"], "left").join(comp, F.col("rep") == F.col("node"), "left")
    classes = classes.select("v", "h", F.coalesce("links", F.lit(0)).alias("links"), "mult", F.coalesce("comp", "rep").alias("comp"))
    usable = F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))
    out = rows.withColumn("h", F.when(usable, F.xxhash64("v"))).join(classes.withColumnRenamed("v", "w"), ["h"], "left")
    out = out.where("w IS NULL OR w = v")  # only if two classes share a hash
    out = out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("mult", F.lit(1)) - 1).alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 and more between all embeddings."""
    return linked(spark, table(spark, sf_dir, "embeddings"))
