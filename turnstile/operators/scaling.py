"""Scaling of performances to [0, 1] with fitted scalars.

Fitting is one aggregation (two for the symmetric loop's rounds); transforming is an
expression, so it fuses with whatever follows.
"""

from __future__ import annotations

from contextlib import ExitStack
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import clip, finite, interpolate, kept
from .quantiles import percentiles


@dataclass
class PartialStandard:
    """(x - mean) / sd * ratio + target, bounded."""

    features: list[str]
    ratio: float = 0.55
    target: float = 0.5
    max_value: float = 2.0
    prefix: str = ""
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> PartialStandard:
        r = df.agg(*[x for f in self.features for x in (F.avg(finite(F.col(f))).alias(f"{f}_m"), F.stddev_samp(finite(F.col(f))).alias(f"{f}_s"))]).first()
        self.params = {f: (r[f"{f}_m"], r[f"{f}_s"]) for f in self.features}
        return self

    def expr(self, f: str) -> Column:
        m, s = self.params[f]
        x = (finite(F.col(f)) - F.lit(m)) / F.lit(s) * self.ratio + self.target
        return clip(x, -self.max_value + self.target, self.max_value)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({self.prefix + f: self.expr(f) for f in self.features})


@dataclass
class MinMax:
    """Quantile bounds to [0, 1], then aligned so that the mean becomes 0.5."""

    features: list[str]
    quantile: float = 0.98
    multiply_align: bool = False
    add_align: bool = True
    prefix: str = ""
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> MinMax:
        r = {f: percentiles(df, finite(F.col(f)), [1 - self.quantile, self.quantile]).get(()) for f in self.features}
        for f in self.features:
            if r[f] is None or r[f][0] == r[f][1]:
                raise ValueError(f"the bounds of {f} are equal")
        self.params = {f: (r[f][0], r[f][1], None) for f in self.features}
        r = df.agg(*[F.avg(self._scaled(f)).alias(f) for f in self.features]).first()
        self.params = {f: (*self.params[f][:2], r[f]) for f in self.features}
        return self

    def _scaled(self, f: str) -> Column:
        lo, hi, _ = self.params[f]
        return clip((finite(F.col(f)) - F.lit(lo)) / F.lit(hi - lo), 0, 1)

    def expr(self, f: str) -> Column:
        mean = self.params[f][2]
        x = self._scaled(f) * F.lit(0.5 / mean) if self.multiply_align else self._scaled(f)
        return x + F.lit(0.5 - mean) if self.add_align else x

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({self.prefix + f: self.expr(f) for f in self.features})


@dataclass
class Diminishing:
    """Beyond a cut-off the excess counts only in part; ``reverse`` mirrors it at the lower end."""

    features: list[str]
    cutoff: float | None = None
    quantile: float = 0.93
    multiplier: float = 0.8
    reverse: bool = False
    prefix: str = ""
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Diminishing:
        q = 1 - self.quantile if self.reverse else self.quantile
        if self.cutoff is None:
            self.params = {f: percentiles(df, finite(F.col(f)), [q]).get((), [None])[0] for f in self.features}
        else:
            self.params = {f: self.cutoff for f in self.features}
        return self

    def expr(self, f: str) -> Column:
        x, c = finite(F.col(f)), F.lit(self.params[f])
        if self.reverse:
            return F.when(x < c, c - (c - x) * self.multiplier).otherwise(x)
        return F.when(x > c, (x - c) * self.multiplier + c).otherwise(x)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({self.prefix + f: self.expr(f) for f in self.features})


@dataclass
class Symmetric:
    """Diminishes the longer tail until the skewness of each group is small enough.

    Each round fits a diminisher on the original values, with a smaller multiplier and an
    earlier cut-off, at the end that the last round left too long. All groups go through a
    round together, in one aggregation.
    """

    features: list[str]
    granularity: list[str] = field(default_factory=list)
    skewness: float = 0.14
    rounds: int = 50
    cutoff: float = 0.95
    multiplier: float = 0.8
    least_multiplier: float = 0.04
    least_rows: int = 10
    prefix: str = ""
    steps: dict = field(default_factory=dict)

    def _key(self) -> Column:
        return F.concat_ws("_", *[F.col(c).cast("string") for c in self.granularity]) if self.granularity else F.lit("")

    @staticmethod
    def _bent(x: Column, c: Column, m: Column, reverse: Column) -> Column:
        low = F.when(x <= c, c - (c - x) * m).otherwise(x)
        high = F.when(x >= c, (x - c) * m + c).otherwise(x)
        return F.when(reverse, low).otherwise(high)

    def _plan(self, q: list, low: float, at: int, round_: int, reverse: bool, n: int) -> list[tuple]:
        """The next ``n`` rounds of a group if its tail stays on one side: (round, cut index, cut-off, multiplier)."""
        out = []
        for k in range(round_, min(round_ + n, self.rounds)):
            mult = self.multiplier * 0.94**k
            out.append((k, at, q[self.rounds + 1 + at] if reverse else q[at], mult))
            if mult * 0.94 < self.least_multiplier:
                break
            if q[at + 1] > low:  # bending keeps the order, so quantiles of the original values decide
                at += 1
        return out

    def fit(self, df: DataFrame) -> Symmetric:
        cuts = [self.cutoff * 0.994**k for k in range(self.rounds + 1)]
        for f in self.features:
            rows = df.select(self._key().alias("g"), finite(F.col(f)).alias("x")).where("x IS NOT NULL")
            first = rows.groupBy("g").agg(F.skewness("x").alias("s"), F.count("*").alias("n"), F.min("x").alias("lo")).collect()  # one row a group
            grid = percentiles(rows, F.col("x"), [*cuts, *[1 - c for c in cuts]], ["g"])
            info = {r["g"]: {**r.asDict(), "q": grid[(r["g"],)]} for r in first}
            todo = {g: (0, 0, r["s"]) for g, r in info.items() if r["s"] is not None and r["n"] > self.least_rows and abs(r["s"]) > self.skewness}
            done: dict[str, tuple] = {}
            while todo:  # some rounds at a time, as the side of the tail seldom changes
                plans = {g: self._plan(info[g]["q"], info[g]["lo"], at, k, s < 0, 8) for g, (k, at, s) in todo.items()}
                flat = [(g, todo[g][2] < 0, k, float(c), float(m)) for g, p in plans.items() for k, _, c, m in p]
                if not flat:
                    break
                part = rows.join(F.broadcast(df.sparkSession.createDataFrame(flat, "g string, rev boolean, k int, c double, m double")), "g")
                skew = part.groupBy("g", "k").agg(F.skewness(self._bent(F.col("x"), F.col("c"), F.col("m"), F.col("rev"))).alias("s")).collect()
                skew = {(r["g"], r["k"]): r["s"] for r in skew}
                nxt = {}
                for g, p in plans.items():
                    rev = todo[g][2] < 0
                    for j, (k, at, c, m) in enumerate(p):
                        s = skew[g, k]
                        done[g] = (rev, c, m)
                        if s is None or abs(s) <= self.skewness or m * 0.94 < self.least_multiplier or k + 1 >= self.rounds:
                            break
                        if (s < 0) != rev or j == len(p) - 1:
                            nxt[g] = (k + 1, at + (info[g]["q"][at + 1] > info[g]["lo"]), s)
                            break
                todo = nxt
            self.steps[f] = done
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for f in self.features:
            x = finite(F.col(f))
            y = x
            for g, (rev, c, m) in self.steps[f].items():
                y = F.when(self._key() == g, self._bent(x, F.lit(c), F.lit(m), F.lit(rev))).otherwise(y)
            out[self.prefix + f] = y
        return df.withColumns(out)


@dataclass
class Quantile:
    """Zeros to half their share, other values to their rank among the others above it."""

    features: list[str]
    zero: float = 1e-10
    n: int = 1000
    weight: str | None = None
    prefix: str = ""
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Quantile:
        for f in self.features:
            x = finite(F.col(f))
            rows = df.select(x.alias("x"), (finite(F.col(self.weight)) if self.weight else F.lit(1.0)).alias("w")).where("x IS NOT NULL AND w > 0")
            is_zero = F.abs("x") < self.zero
            steps = [k / self.n for k in range(self.n + 1)]
            if not self.weight:
                pi = rows.agg(F.avg(is_zero.cast("double"))).first()[0]
                self.params[f] = (pi or 0.0, percentiles(rows, F.when(~is_zero, F.col("x")), steps).get(()))
                continue
            total = rows.agg(F.sum(F.when(is_zero, F.col("w"))), F.sum("w")).first()
            self.params[f] = ((total[0] or 0.0) / total[1] if total[1] else 0.0, self._weighted(rows.where(~is_zero), steps))
        return self

    def _weighted(self, rows: DataFrame, steps: list[float]) -> list[float] | None:
        """Weighted quantiles: values summed up, cumulated over ranges of about equal size, then looked up."""
        values = rows.groupBy("x").agg(F.sum("w").alias("w"))
        cuts = sorted(set(values.approxQuantile("x", [k / 64 for k in range(1, 64)], 0.005)))
        bucket = F.size(F.filter(F.lit(cuts or [0.0]).cast("array<double>"), lambda c: c <= F.col("x")))
        values = values.withColumn("b", bucket)
        sums = values.groupBy("b").agg(F.sum("w").alias("bw"))  # at most 64 rows
        before = sums.withColumn("base", F.coalesce(F.sum("bw").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        total = sums.agg(F.sum("bw")).first()[0]
        if not total:
            return None
        w = Window.partitionBy("b").orderBy("x")
        cdf = values.join(F.broadcast(before), "b").withColumn("p", (F.col("base") + F.sum("w").over(w)) / total)
        last = Window.orderBy("b")
        edge = cdf.groupBy("b").agg(F.max(F.struct("p", "x")).alias("e")).withColumn("prev", F.lag("e").over(last)).select("b", "prev")
        cdf = cdf.withColumn("lag", F.lag(F.struct("p", "x")).over(w)).join(F.broadcast(edge), "b").withColumn("lag", F.coalesce("lag", "prev"))
        # The steps that fall between a value's and its predecessor's share.
        lo = F.coalesce(F.col("lag.p"), F.lit(-1.0))
        k = F.expr(f"sequence(CAST(greatest(0, floor(coalesce(lag.p, -1) * {self.n})) AS INT), CAST(least({self.n}, ceil(p * {self.n}) + 1) AS INT))")
        got = cdf.withColumn("k", F.explode(k)).withColumn("s", F.col("k") / self.n)
        got = got.where((F.col("s") > lo) & (F.col("s") <= F.col("p")))
        y = F.when(F.col("lag").isNull(), F.col("x")).otherwise(F.col("lag.x") + (F.col("x") - F.col("lag.x")) * (F.col("s") - F.col("lag.p")) / (F.col("p") - F.col("lag.p")))
        found = {r["k"]: r["y"] for r in got.select("k", y.alias("y")).collect()}  # n + 1 rows
        top = values.agg(F.max("x")).first()[0]  # the last step, should shares add up to a little less than one
        return [found.get(i, top) for i in range(self.n + 1)]

    def expr(self, f: str) -> Column:
        pi, q = self.params[f]
        x = finite(F.col(f))
        zero = F.when(F.abs(x) < self.zero, F.lit(pi / 2))
        if not q:
            return zero
        # Values between equal quantiles take the last rank, as interpolation on sorted knots does.
        rank = interpolate(x, q, [k / (len(q) - 1) for k in range(len(q))])
        return F.coalesce(zero, F.lit(pi) + (1 - F.lit(pi)) * rank)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({self.prefix + f: self.expr(f) for f in self.features})


@dataclass
class GroupMeans:
    """The mean (or sum) of features in each group at the time of fitting, on the rows of any table; null for unseen groups."""

    features: list[str]
    granularity: list[str]
    how: str = "mean"
    prefix: str = "group_"
    table: DataFrame | None = None

    def fit(self, df: DataFrame) -> GroupMeans:
        agg = {"mean": F.avg, "sum": F.sum}[self.how]
        self.table = df.groupBy(*self.granularity).agg(*[agg(finite(F.col(f))).alias(self.prefix + f) for f in self.features])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[self.prefix + f for f in self.features]).join(self.table, self.granularity, "left")


class Performance:
    """Symmetric, standardised and min-max scaled in turn, bounded to [0, 1].

    A feature with more than ``zeros`` zeros and more than three values is scaled by
    quantiles instead.
    """

    def __init__(self, features: list[str], names=("symmetric", "partial_standard", "min_max"), zeros: float = 0.15, weight: str | None = None, prefix: str = "performance__", low=0.0, high=1.0):
        self.features, self.names, self.zeros, self.weight, self.prefix, self.low, self.high = features, names, zeros, weight, prefix, low, high

    def fit(self, df: DataFrame) -> Performance:
        aggs = [x for f in self.features for x in (F.avg((finite(F.col(f)) == 0).cast("double")).alias(f"{f}_z"), F.approx_count_distinct(finite(F.col(f))).alias(f"{f}_d"))]
        r = df.agg(*aggs).first()
        inflated = [f for f in self.features if (r[f"{f}_z"] or 0) > self.zeros and r[f"{f}_d"] > 3]
        plain = [f for f in self.features if f not in inflated]
        self.chain = [Quantile(inflated, weight=self.weight, prefix=self.prefix).fit(df)] if inflated else []
        current = df.withColumns({self.prefix + f: finite(F.col(f)) for f in plain}) if plain else df
        kinds = {"symmetric": Symmetric, "partial_standard": PartialStandard, "min_max": MinMax}
        own = [self.prefix + f for f in plain]
        with ExitStack() as held:
            for n in self.names if plain else ():
                # What a step is fitted on is made once: its passes would each compute the steps before it,
                # whose expressions multiply where a filter is pushed below them.
                current = held.enter_context(kept(current.select(own), anew=True))
                step = kinds[n](own).fit(current)
                current = step.transform(current)
                self.chain.append(step)
        self.plain = plain
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        df = df.withColumns({self.prefix + f: finite(F.col(f)) for f in self.plain}) if self.plain else df
        for step in self.chain:
            df = step.transform(df)
        return df.withColumns({self.prefix + f: clip(F.col(self.prefix + f), self.low, self.high) for f in self.features})


@dataclass(frozen=True)
class ColumnWeight:
    name: str
    weight: float
    lower_is_better: bool = False

    def __post_init__(self):
        if not 0 <= self.weight <= 1:
            raise ValueError("a weight lies between 0 and 1")


def weighted_mix(df: DataFrame, weights: list[ColumnWeight], prefix: str = "", alias: str = "weighted_performance", low=0.0, high=1.0) -> DataFrame:
    """Weighted mean of columns; missing ones leave their weight to the others, a row with
    none raises when the plan runs."""
    xs = [finite(F.col(prefix + w.name)) for w in weights]
    total = sum(F.when(x.isNotNull(), F.lit(float(w.weight))).otherwise(0.0) for x, w in zip(xs, weights))
    mix = sum(F.coalesce((1 - x if w.lower_is_better else x) * F.lit(float(w.weight)), F.lit(0.0)) for x, w in zip(xs, weights))
    return df.withColumn(alias, clip(F.when(total > 0, mix / total).otherwise(F.raise_error(F.lit("a row has no performance at all")).cast("double")), low, high))


def scaled_weight(df: DataFrame, column: str, alias: str) -> tuple[DataFrame, float | None]:
    """Participation weights divided by their 99th percentile, bounded to [0, 1], if any lies outside it."""
    c = finite(F.col(column))
    r = df.agg(F.min(c), F.max(c)).first()
    if r[0] is None or r[0] >= -1e-6 and r[1] <= 1 + 1e-6:
        return df.withColumn(alias, c), None
    top = percentiles(df, c, [0.99])[()][0]
    return df.withColumn(alias, clip(c / F.lit(top), 0, 1)), top
