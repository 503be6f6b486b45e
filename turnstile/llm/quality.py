"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Statistics of each whole text are standardised and mapped to cosines of random
projections, which approximate a Gaussian kernel. The normal equations are summed by
partition over all labelled training rows, a fold apart each, and the sums of partitions
in rounds, so the ridge fits and their
out-of-fold scores come from two passes over small feature rows. Isotonic regression on
the out-of-fold scores, counted in 4096 bins, calibrates.

Cases: a null text is empty and gets the statistics of an empty text; rows without label
are scored, not learnt from; labels other than 0 and 1 and null ids are ignored; repeated
labels count as often as they occur; without any label every score is 0.5; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fold_of, summed_in_rounds, table, tidy
from .learning import BINS, calibrated, inner_fold, isotonic

COSINES = 256
BANDWIDTH = 4.0
FOLDS = 5
RIDGES = (0.1, 1.0, 10.0, 100.0)
THRESHOLD = 0.3
SEED = 77

_CLASSES = np.zeros(256, np.uint8)  # by byte: what a character counts as
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if _c.isdigit() and _b < 128 else 4 if _c in " \t\r\x0b\x0c" else 5 if _c == "\n" else 6 if _c in ".,;:?'\"-()" else 7 if _c == "!" else 8 if _b < 128 else 9
N_STATS = 26


def statistics(text: str | None) -> list[float]:
    """Shape, repetition and character statistics of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(len(raw), 1)
    share = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=10)[1:10] / n if raw else np.zeros(9)
    words = raw.split()
    m = max(len(words), 1)
    seen = Counter(words)
    top = max(seen.values(), default=0) / m
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct_lines = len(set(lines)) / max(len(lines), 1)
    pairs = len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)
    again = sum(a == b for a, b in zip(words, words[1:])) / m
    stops = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")
    marks = raw.count(b" | ")
    letters = share[0] + share[1] + share[8]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), lengths.mean(), lengths.std(), len(seen) / m, top, *share.tolist(),
        distinct_lines, np.log1p(len(lines)), np.log1p(len(raw) / max(len(lines), 1)), pairs, again, stops / m, marks / m,
        share[1] / max(letters, 1e-9), float((lengths <= 3).mean()), float((lengths >= 14).mean()),
        len(re.findall(rb"(\S)\1\1", raw)) / m,
    ]


def _assemble(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "x": [statistics(t) for t in f["text"]]})


def features(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, x): the statistics of every text."""
    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text").mapInPandas(tidy(_assemble), "doc_id long, x array<double>")


class Cosines:
    """z -> sqrt(2/D) cos(W z + b), and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((len(mean), COSINES)) / BANDWIDTH
        self.b = rng.uniform(0, 2 * np.pi, COSINES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2.0 / COSINES), np.ones((len(x), 1))], 1)


def normal_equations(rows: DataFrame, cosines: Cosines) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Sums of Z'Z, Z'y and y'y by fold of rows (fold, x, y): in each partition, then partitions in rounds."""
    from pyspark import TaskContext

    d = COSINES + 1

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for f in frames:
            z = np.concatenate([cosines(np.stack(f["x"].to_numpy())), f[["y"]].to_numpy(float)], 1)
            for k in np.unique(f["fold"]):
                part = z[f["fold"].to_numpy() == k]
                sums[k] = sums.get(k, 0) + part.T @ part
        part = TaskContext.get().partitionId()
        yield pd.DataFrame({"fold": list(map(int, sums)), "part": part, "payload": [s.astype("<f8").tobytes() for s in sums.values()]})

    def add(payloads: list[bytes]) -> bytes:
        out = np.zeros((d + 1) ** 2)
        for b in payloads:
            out += np.frombuffer(b, "<f8")
        return out.tobytes()

    parts = summed_in_rounds(rows.mapInPandas(tidy(local), "fold int, part long, payload binary"), ["fold"], add)
    out = {}
    for r in parts.collect():  # one row a fold
        s = np.frombuffer(r["payload"], "<f8").reshape(d + 1, d + 1)
        out[r["fold"]] = (s[:d, :d], s[:d, d], s[d, d])
    return out


def ridge(a: np.ndarray, b: np.ndarray, lam: float) -> np.ndarray:
    pen = np.full(len(b), lam)
    pen[-1] = 1e-9
    return np.linalg.solve(a + np.diag(pen), b)


def fit(scratch: Scratch, feats: DataFrame, labels: DataFrame, label: str, learn_from) -> dict | None:
    """The model from all labelled rows of ``feats`` (doc_id, x) for which ``learn_from`` holds."""
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn_from).select("doc_id", F.col(label).cast("double").alias("y"))
    rows = scratch.cut(feats.join(y, "doc_id").select(inner_fold("doc_id", FOLDS).alias("fold"), "x", "y"))
    m = rows.select(F.count("*"), *[f(F.col("x")[i]) for i in range(N_STATS) for f in (F.avg, F.stddev_pop)]).first()
    if not m[0]:
        return None
    mean, sd = np.array(m[1::2], float), np.array(m[2::2], float)
    cosines = Cosines(mean, np.where(sd > 1e-9, sd, 1.0))
    sums = normal_equations(rows, cosines)
    a, b = sum(s[0] for s in sums.values()), sum(s[1] for s in sums.values())

    def loss(lam: float) -> float:
        out = 0.0
        for ak, bk, yk in sums.values():
            w = ridge(a - ak, b - bk, lam)
            out += w @ ak @ w - 2 * w @ bk + yk
        return out

    lam = min(RIDGES, key=loss)
    without = {k: ridge(a - ak, b - bk, lam) for k, (ak, bk, _) in sums.items()}

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for f in frames:
            z = cosines(np.stack(f["x"].to_numpy()))
            s = np.einsum("ij,ij->i", z, np.stack([without[k] for k in f["fold"]]))
            counts.update(zip(_bin(s).tolist(), f["y"].tolist()))
        yield pd.DataFrame([(i, v, n) for (i, v), n in counts.items()], columns=["bin", "y", "n"])

    got = rows.mapInPandas(tidy(binned), "bin long, y double, n long").groupBy("bin").agg(F.sum("n"), F.sum(F.col("y") * F.col("n"))).orderBy("bin").collect()  # at most BINS rows
    scratch.drop(rows)
    t = np.array([tuple(r) for r in got], float)
    knots = isotonic((t[:, 0] + 0.5) / BINS * 3 - 1, t[:, 2] / t[:, 1], t[:, 1])
    return {"cosines": cosines, "w": ridge(a, b, lam), "knots": knots}


def _bin(score: np.ndarray) -> np.ndarray:
    """Ridge scores lie about 0 to 1; -1 to 2 is cut in BINS parts, the ends open."""
    return np.clip(((score + 1) / 3 * BINS).astype(np.int64), 0, BINS - 1)


def score(feats: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if model is None:
                s = np.full(len(f), 0.5)
            else:
                s = calibrated(model["cosines"](np.stack(f["x"].to_numpy())) @ model["w"], model["knots"]) if len(f) else np.zeros(0)
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": s})

    return feats.mapInPandas(tidy(run), "doc_id long, score double")


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, label="quality", mod=5, held=0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; learns from labels with crc32(id) mod ``mod`` other than ``held``."""
    scratch = Scratch(spark, "quality")
    feats = scratch.cut(features(docs))
    model = fit(scratch, feats, labels, label, fold_of("doc_id", mod) != held)
    out = score(feats, model).select("doc_id", (fold_of("doc_id", mod) == held).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
