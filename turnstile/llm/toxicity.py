"""Toxicity scores: gradient-boosted trees over dense text features, isotonic calibration.

Words are compared in a plain form: lower case, digits and signs that stand for letters
undone, other signs dropped. A lexicon of insults is part of the module, a second one is
learnt: plain words and stems that labelled toxic rows hold far more often than others.
Features of a whole text are the densities of both, how near second-person words stand
to lexicon words, capitals, punctuation, and how many words are obfuscated. Trees are
grown on at most ``MOST_LABELLED`` labelled rows (those with the smallest hash of their
id, a fixed bound); features and scores cover every row. Rows are scored out of fold,
with lexicon and trees from the other folds, for the isotonic calibration.

Cases: a null text is empty and is scored like an empty text; unlabelled rows are only
scored; labels other than 0 and 1 and null ids are ignored; repeated labels count as
often as they occur; without labels of both kinds the lexicon density alone gives the
score; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fold_of, give_back, named, table, tidy
from .learning import calibrated, inner_fold, isotonic

MOST_LABELLED = 20_000
FOLDS = 4
THRESHOLD = 0.3
#: Insults and slurs of everyday English, German, French and Spanish.
LEXICON = frozenset(
    "idiot idiots idiotic stupid moron morons moronic loser losers trash scum scumbag worthless pathetic disgusting clown dumb dumbass "
    "imbecile retard retarded garbage filth filthy vermin bastard bitch asshole fuck fucking fucked shit shitty crap jerk freak creep "
    "pig pigs cretin dimwit fool hate kill die ugly nasty useless idiota idiotas estupido imbecil basura asqueroso inutil payaso "
    "idiote stupide debile ordure salaud connard minable degoutant nul dumm blod trottel abschaum wertlos widerlich versager depp".split()
)
SECOND = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tus ti usted ustedes vosotros".split())
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "é": "e", "è": "e", "ê": "e", "á": "a", "à": "a", "â": "a", "ä": "a", "í": "i", "î": "i", "ó": "o", "ô": "o", "ö": "o", "ú": "u", "û": "u", "ü": "u", "ñ": "n", "ç": "c", "ß": "s"})
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SIGNS = re.compile(r"[\W_]+")
_RUN = re.compile(r"(.)\1{2,}")
_NEAR = 5


def plain(word: str) -> str:
    """The form in which words are compared: 'Id10t!!' and 'i.d.i.o.t' are 'idiot'."""
    w = _EDGE.sub("", word.lower())
    if w.isalpha() and w.isascii():
        return _RUN.sub(r"\1\1", w) if len(w) > 2 else w
    return _RUN.sub(r"\1\1", _SIGNS.sub("", w.translate(_PLAIN)))


def terms(word: str) -> list[str]:
    """What the learnt lexicon may hold of a word: the plain word and its stems."""
    p = plain(word)
    w = _EDGE.sub("", word.lower())
    return [p, *{f"{w[:k]}~" for k in (4, 5, 6, 7, 8) if len(w) > k}] if p else []


class Lexicon:
    """Flags of words: 1 insult, 2 learnt word, 4 learnt stem, 8 second person, 16 obfuscated insult."""

    MOST = 500_000

    def __init__(self, learnt: frozenset[str]):
        self.learnt = learnt
        self.known: dict[str, int] = {}

    def flags(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.MOST:
            known.clear()
        out = []
        for w in words:
            f = known.get(w)
            if f is None:
                f = known[w] = self._flag(w)
            out.append(f)
        return np.array(out, np.uint8) if out else np.zeros(0, np.uint8)

    def _flag(self, word: str) -> int:
        t = terms(word)
        if not t:
            return 0
        p, bare = t[0], _EDGE.sub("", word.lower())
        hit = p in LEXICON or p in self.learnt
        return (p in LEXICON) + 2 * (p in self.learnt) + 4 * any(x in self.learnt for x in t[1:]) + 8 * (p in SECOND) + 16 * (hit and not bare.isalpha())


def spelled(words: list[str]) -> list[str]:
    """Joins runs of single letters ('i d i o t') of at least four."""
    out: list[str] = []
    run: list[str] = []
    for w in words:
        if len(w) == 1 and w.isalpha():
            run.append(w)
            continue
        if len(run) >= 4:
            out.append("".join(run))
        run = []
    if len(run) >= 4:
        out.append("".join(run))
    return out


NAMES = ["insults", "learnt", "stems", "any", "log_hits", "obfuscated", "spelled", "second", "near_second", "caps", "caps_words", "exclaim", "question", "signs", "digits", "log_words", "max_window", "spread"]


def text_features(text: str | None, lex: Lexicon) -> list[float]:
    text = text or ""
    words = text.split()
    n = max(len(words), 1)
    f = lex.flags(words)
    joined = spelled(words) if len(words) >= 4 else []
    hit = (f & 7) > 0
    at = np.flatnonzero(hit)
    sp = sum((x & 7) > 0 for x in lex.flags(joined).tolist())
    you = np.flatnonzero(f & 8)
    near = 0.0
    if len(at) and len(you):
        k = np.searchsorted(you, at)
        gap = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - at), np.abs(you[np.maximum(k - 1, 0)] - at))
        near = float((gap <= _NEAR).sum()) / len(at)
    window = float(np.convolve(hit, np.ones(20), "same").max()) if len(at) else 0.0
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    c = np.bincount(raw, minlength=128) if len(raw) else np.zeros(128)
    m = max(len(raw), 1)
    caps = c[65:91].sum()
    return [
        ((f & 1) > 0).sum() / n, ((f & 2) > 0).sum() / n, ((f & 4) > 0).sum() / n, len(at) / n, np.log1p(len(at) + sp), ((f & 16) > 0).sum() / n, sp / n,
        len(you) / n, near, caps / max(caps + c[97:123].sum(), 1), sum(w.isupper() and len(w) > 2 for w in words) / n, c[33] / m, c[63] / m,
        c[[35, 36, 37, 38, 42, 64, 94, 95, 124]].sum() / m, c[48:58].sum() / m, np.log1p(len(words)), window, (at[-1] - at[0]) / n if len(at) else 0.0,
    ]


class Trees:
    """Boosted regression trees for logistic loss on histogram bins."""

    def __init__(self, rounds=80, depth=3, rate=0.15, bins=64, l2=2.0, least=4):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        # Quantiles miss rare positive values of sparse densities; those get edges of their own.
        self.edges = [np.unique(np.r_[0.0, e, np.quantile(c[c > 0], np.linspace(0, 1, 17)[:-1])]) if (c > 0).any() else e for e, c in zip(self.edges, x.T)]
        b = self._bin(x)
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-raw))
            tree = self._grow(b, q - y, q * (1 - q))
            raw += self._apply(tree, b)
            self.trees.append(tree)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def _grow(self, b, g, h) -> list[tuple]:
        """Nodes (feature, bin, left, right, value); feature -1 is a leaf."""
        nodes: list = [None]
        todo = [(0, np.arange(len(g)), 0)]
        while todo:
            at, rows, depth = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0)
            if depth < self.depth and len(rows) >= 2 * self.least:
                for j in range(b.shape[1]):
                    size = len(self.edges[j]) + 1
                    gj, hj, nj = (np.cumsum(np.bincount(b[rows, j], weights=w, minlength=size))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    gain = gj**2 / (hj + self.l2) + (gs - gj) ** 2 / (hs - hj + self.l2) - gs**2 / (hs + self.l2)
                    gain[(nj < self.least) | (len(rows) - nj < self.least)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
            if best[1] < 0:
                nodes[at] = (-1, 0, 0, 0, -self.rate * gs / (hs + self.l2))
                continue
            _, j, t = best
            left = b[rows, j] <= t
            nodes[at] = (j, t, len(nodes), len(nodes) + 1, 0.0)
            todo += [(len(nodes), rows[left], depth + 1), (len(nodes) + 1, rows[~left], depth + 1)]
            nodes += [None, None]
        return nodes

    def _apply(self, tree, b) -> np.ndarray:
        f, t, lo, hi, v = (np.array(c) for c in zip(*tree))
        at = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            inner = f[at] >= 0
            go = np.where(b[np.arange(len(b)), np.maximum(f[at], 0)] <= t[at], lo[at], hi[at])
            at = np.where(inner, go, at)
        return v[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.base + sum((self._apply(t, b) for t in self.trees), np.zeros(len(b)))


def telling(a: Column, c: Column, pos: float, neg: float) -> Column:
    """Whether a term, in ``a`` of ``pos`` toxic and ``c`` of ``neg`` other rows, is in toxic rows far
    more often: in at least 3 of them, 4 standard errors of the log odds."""
    odds = F.log((a + 0.5) / (F.lit(pos) - a + 0.5)) - F.log((c + 0.5) / (F.lit(neg) - c + 0.5))
    z = odds / F.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))
    return (a >= 3) & (odds > 2.5) & ((z > 4) | ((c == 0) & (a >= 5) & (z > 2.5)))


def learn_terms(held: DataFrame, sizes: dict[int, tuple[float, float]]) -> dict[int | None, frozenset[str]]:
    """The lexicon learnt without each fold, and (None) from all, of ``held`` (t, fold, y), a row for each
    term of each labelled row, and the folds' (rows, toxic rows).

    Only learnt terms are collected: those in at least three of at most ``MOST_LABELLED`` rows.
    """
    one = lambda c, k, name: F.coalesce(F.sum(F.when(F.col("fold") == k, c)), F.lit(0.0)).alias(f"{name}{k}")
    wide = held.groupBy("t").agg(*[x for k in sizes for x in (one(F.lit(1.0), k, "n"), one(F.col("y"), k, "pos"))])
    flags = []
    for skip in (None, *sizes):
        folds = [k for k in sizes if k != skip]
        a = sum((F.col(f"pos{k}") for k in folds), F.lit(0.0))
        n = sum((F.col(f"n{k}") for k in folds), F.lit(0.0))
        pos, rows = sum(sizes[k][1] for k in folds), sum(sizes[k][0] for k in folds)
        flags.append(telling(a, n - a, pos, rows - pos).alias("all" if skip is None else f"not{skip}"))
    got = wide.select("t", *flags).where(" OR ".join(["all", *(f"not{k}" for k in sizes)])).collect()
    return {k: frozenset(r["t"] for r in got if r["all" if k is None else f"not{k}"]) for k in (None, *sizes)}


def training_terms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, fold, y, terms): the distinct terms of each labelled row's whole text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["terms"] = [list({t for w in set((x or "").split()) for t in terms(w)}) for x in f["text"]]
            yield f[["doc_id", "fold", "y", "terms", "text"]]

    rows = docs.join(labels, "doc_id").select("doc_id", inner_fold("doc_id", FOLDS).alias("fold"), "y", "text")
    return rows.mapInPandas(tidy(run), "doc_id long, fold int, y double, terms array<string>, text string")


def fit(scratch: Scratch, docs: DataFrame, labels: DataFrame, label: str, learn_from) -> dict:
    """Lexicon, trees and calibration from labelled rows for which ``learn_from`` holds."""
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn_from).select("doc_id", F.col(label).cast("double").alias("y"))
    sample = scratch.cut(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED))
    rows = scratch.cut(training_terms(docs, sample))
    sizes = {r["fold"]: (r["n"], r["pos"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()}
    pos = sum(p for _, p in sizes.values())
    neg = sum(n - p for n, p in sizes.values())
    if not pos or not neg:
        scratch.drop(sample, rows)
        return {"learnt": frozenset(), "trees": None, "knots": (np.zeros(0), np.zeros(0))}

    lexicons = learn_terms(rows.select("fold", "y", F.explode("terms").alias("t")), sizes)

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = {k: Lexicon(v) for k, v in lexicons.items()}
        for f in frames:
            yield pd.DataFrame({"fold": f["fold"], "y": f["y"], "x": [text_features(t, lex[k]) for t, k in zip(f["text"], f["fold"])]})

    t = rows.select("fold", "y", "text", "doc_id").mapInPandas(tidy(local), "fold int, y double, x array<double>").collect()  # at most MOST_LABELLED rows
    scratch.drop(sample, rows)
    fold, yy, x = np.array([r["fold"] for r in t]), np.array([r["y"] for r in t]), np.array([r["x"] for r in t], float)
    order = np.lexsort((*x.T, yy, fold))  # the same whatever order the rows came in
    fold, yy, x = fold[order], yy[order], x[order]
    out = np.zeros(len(yy))
    for k in np.unique(fold):
        rest = fold != k
        out[~rest] = Trees().fit(x[rest], yy[rest]).raw(x[~rest]) if 0 < yy[rest].sum() < rest.sum() else 0.0
    o = np.argsort(out, kind="stable")
    xs, first = np.unique(out[o], return_index=True)
    ends = np.r_[first[1:], len(o)]
    sums = np.add.reduceat(yy[o], first)
    return {"learnt": lexicons[None], "trees": Trees().fit(x, yy), "knots": isotonic(xs, sums / (ends - first), (ends - first).astype(float))}


def scores(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``score`` of every row of ``docs``."""
    schema = docs.select(*keep).schema.add("score", "double")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(model["learnt"])
        for f in frames:
            x = np.array([text_features(t, lex) for t in f["text"]], float).reshape(len(f), len(NAMES))
            if model["trees"] is None:
                s = 1 - np.exp(-20 * x[:, 3])
            else:
                s = calibrated(model["trees"].raw(x), model["knots"])
            out = f[keep].copy()
            out["score"] = s
            yield out

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInPandas(tidy(run), schema)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, label="toxic", mod=4, held=2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; learns from labels with crc32(id) mod ``mod`` other than ``held``."""
    scratch = Scratch(spark, "toxicity")
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    model = fit(scratch, docs, labels, label, fold_of("doc_id", mod) != held)
    out = scores(docs, model, ["doc_id"]).select("doc_id", (fold_of("doc_id", mod) == held).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", label="toxic", threshold=THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``; learns from every labelled row.

    Null and empty texts are scored as empty ones, rows without id like others; equal rows stay or go together.
    """
    model = fit(Scratch(spark, "toxicity"), docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text")), labels, label, F.lit(True))
    return docs.where(score_of(model)(named(text)) < threshold)


def score_of(model: dict):
    """The score of a text column as an expression."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lex = Lexicon(model["learnt"])
        for t in texts:
            x = np.array([text_features(v, lex) for v in t], float).reshape(len(t), len(NAMES))
            yield pd.Series(1 - np.exp(-20 * x[:, 3]) if model["trees"] is None else calibrated(model["trees"].raw(x), model["knots"]))
        give_back()

    return score
