"""Scores of predictions: filters, levels, groups, naive baselines.

A score is one aggregation: all groups of a granularity come from one ``groupBy``. A
scorer gives a frame (granularity columns, ``score``); ``value`` runs it where there is
one number only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shaping import Filter, apply_filters, with_target


def expected(prediction: Column, classes: list) -> Column:
    """Mean of a list of class probabilities."""
    labels = F.lit([float(c) for c in classes]).cast("array<double>")
    return F.aggregate(F.zip_with(prediction, labels, lambda p, k: p * k), F.lit(0.0), lambda a, x: a + x)


def running(prediction: Column) -> Column:
    """Cumulative sums of a list."""
    return F.transform(F.sequence(F.lit(1), F.size(prediction)), lambda k: F.aggregate(F.slice(prediction, 1, k), F.lit(0.0), lambda a, x: a + x))


@dataclass
class Scorer:
    """Shared configuration. ``level`` aggregates predictions and targets first (sum, mean,
    first or ("weighted_mean", column) for each; lists element-wise); ``naive`` reports the
    baseline's score minus the model's."""

    prediction: str
    target: str
    filters: list[Filter] = field(default_factory=list)
    validation: str | None = None
    level: list[str] | None = None
    how: dict[str, Any] = field(default_factory=dict)
    granularity: list[str] = field(default_factory=list)
    naive: bool = False
    naive_granularity: list[str] = field(default_factory=list)
    weight: str | None = None

    def metric(self) -> Column:
        """The score as an aggregate of columns ``p`` and ``y`` (and ``w``)."""
        raise NotImplementedError

    @property
    def name(self) -> str:
        """Words of the kind, what is scored, and how: mean_absolute_error_points_by_league."""
        kind = re.sub(r"(?<=[a-z])(?=[A-Z])", "_", type(self).__name__).lower()
        return "_".join([kind, self.target, *(["by", *self.granularity] if self.granularity else []), *(["naive"] if self.naive else [])])

    def baseline(self, df: DataFrame) -> DataFrame:
        """``df`` with ``p`` replaced by the mean target of its naive group, inside each score group."""
        keys = [*self.granularity, *self.naive_granularity]
        w = Window.partitionBy(*(keys or [F.lit(1)]))
        if not keys:  # one row, broadcast: a window without keys would gather all rows
            return df.drop("p").crossJoin(F.broadcast(df.agg(F.avg("y").alias("p"))))
        return df.withColumn("p", F.avg("y").over(w))

    def rows(self, df: DataFrame) -> DataFrame:
        filters = [*self.filters, *([Filter(self.validation, True, "==")] if self.validation else [])]
        df = with_target(apply_filters(df, filters), self.target)
        if self.level:
            df = self.levelled(df)
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        return df.withColumns({"p": F.col(self.prediction), "y": F.col(self.target), "w": w})

    def levelled(self, df: DataFrame) -> DataFrame:
        aggs = []
        for c, key in ((self.prediction, "pred"), (self.target, "target")):
            how = self.how.get(key, "sum")
            if isinstance(df.schema[c].dataType, T.ArrayType):
                return self._levelled_lists(df)
            if how == "first":
                agg = F.min_by(c, F.struct(*[F.col(x) for x in df.columns if not isinstance(df.schema[x].dataType, T.MapType)]))
            elif isinstance(how, tuple):
                agg = F.sum(F.col(c) * F.col(how[1])) / F.sum(how[1])
            else:
                agg = {"sum": F.sum, "mean": F.avg}[how](c)
            aggs.append(agg.alias(c))
        if self.weight:
            aggs.append(F.sum(self.weight).alias(self.weight))
        more = [F.min(g).alias(g) for g in self.granularity + self.naive_granularity if g not in self.level]
        return df.groupBy(*self.level).agg(*aggs, *more)

    def _levelled_lists(self, df: DataFrame) -> DataFrame:
        how = self.how.get("pred", "mean")
        if isinstance(how, tuple):
            raise ValueError("lists can't be aggregated by a weighted mean")
        long = df.select("*", F.posexplode(self.prediction).alias("__k", "__p"))
        per = long.groupBy(*self.level, "__k").agg((F.avg if how == "mean" else F.sum)("__p").alias("__p"))
        lists = per.groupBy(*self.level).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__p"))), lambda x: x["__p"]).alias(self.prediction))
        target = {"sum": F.sum, "mean": F.avg, "first": F.min}[self.how.get("target", "sum")]
        more = [F.min(g).alias(g) for g in self.granularity + self.naive_granularity if g not in self.level]
        more += [F.sum(self.weight).alias(self.weight)] if self.weight else []
        return df.groupBy(*self.level).agg(target(self.target).alias(self.target), *more).join(lists, self.level)

    def score(self, df: DataFrame) -> DataFrame:
        rows = self.rows(df)
        if not self.naive:
            return self._agg(rows, self.metric().alias("score"))
        model = self._agg(rows, self.metric().alias("model"))
        base = self._agg(self.baseline(rows), self.metric().alias("base"))
        both = model.join(base, self.granularity) if self.granularity else model.crossJoin(base)  # one row each
        return both.select(*self.granularity, (F.col("base") - F.col("model")).alias("score"))

    def _agg(self, rows: DataFrame, agg: Column) -> DataFrame:
        return rows.groupBy(*self.granularity).agg(agg) if self.granularity else rows.agg(agg)

    def value(self, df: DataFrame) -> float:
        return self.score(df).first()["score"]


def _mean(x: Column) -> Column:
    return F.sum(x * F.col("w")) / F.sum("w")


class MeanAbsoluteError(Scorer):
    def metric(self):
        return _mean(F.abs(F.col("p") - F.col("y")))


class MeanSquaredError(Scorer):
    def metric(self):
        return _mean((F.col("p") - F.col("y")) ** 2)


class RootMeanSquaredError(Scorer):
    def metric(self):
        return F.sqrt(_mean((F.col("p") - F.col("y")) ** 2))


class LogLoss(Scorer):
    """Binary cross entropy; probabilities are kept off 0 and 1."""

    def metric(self):
        p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
        return -_mean(F.when(F.col("y").cast("double") == 1, F.log(p)).otherwise(F.log(1 - p)))


class Accuracy(Scorer):
    def metric(self):
        return _mean(((F.col("p") >= 0.5).cast("int") == F.col("y").cast("int")).cast("double"))


class AreaUnderCurve(Scorer):
    """Probability that a positive outranks a negative, ties counting half, by counts at each distinct prediction."""

    def score(self, df: DataFrame) -> DataFrame:
        rows = self.rows(df)
        keys = self.granularity
        per = rows.groupBy(*keys, "p").agg(F.sum((F.col("y") == 1).cast("double")).alias("a"), F.sum((F.col("y") != 1).cast("double")).alias("b"))
        w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("p")
        below = F.coalesce(F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        part = per.withColumn("u", F.col("a") * (below + F.col("b") / 2))
        agg = (F.sum("u") / (F.sum("a") * F.sum("b"))).alias("score")
        return part.groupBy(*keys).agg(agg) if keys else part.agg(agg)


@dataclass
class MeanBias(Scorer):
    """Mean of prediction minus target. ``relative``: a 0/1 column; then how the predictions
    differ between its two groups minus how the targets do."""

    classes: list | None = None
    relative: str | None = None

    def rows(self, df):
        out = super().rows(df)
        return out.withColumn("p", expected(F.col("p"), self.classes)) if self.classes is not None else out

    def metric(self):
        if self.relative is None:
            return F.coalesce(_mean(F.col("p") - F.col("y")), F.lit(0.0))
        part = lambda c, k: F.sum(F.when(F.col(self.relative) == k, F.col(c) * F.col("w"))) / F.sum(F.when(F.col(self.relative) == k, F.col("w")))
        return (part("p", 1) - part("p", 0)) - (part("y", 1) - part("y", 0))


@dataclass
class ClassScorer(Scorer):
    """A scorer of lists of class probabilities; its baseline are the empirical class shares."""

    classes: list = field(default_factory=list)

    def baseline(self, df):
        keys = [*self.granularity, *self.naive_granularity]
        shares = F.array(*[F.avg((F.col("y") == c).cast("double")) for c in self.classes]).alias("p")
        if not keys:
            return df.drop("p").crossJoin(F.broadcast(df.agg(shares)))
        return df.drop("p").join(df.groupBy(*keys).agg(shares), keys)


@dataclass
class ListScorer(ClassScorer):
    """Scores of the class lists themselves. Lists shorter than ``classes`` count as ending in zeros.

    The naive baseline is the commonest class of its group, the smaller one on ties.
    """

    def rows(self, df):
        k = len(self.classes)
        padded = F.slice(F.concat(F.col("p"), F.array_repeat(F.lit(0.0), k)), 1, k)
        return super().rows(df).withColumn("p", padded)

    def baseline(self, df):
        keys = [*self.granularity, *self.naive_granularity]
        counts = [F.struct(F.sum((F.col("y") == c).cast("int")).alias("n"), F.lit(-k).alias("k")) for k, c in enumerate(self.classes)]
        mode = F.greatest(*counts)["k"]
        p = F.transform(F.sequence(F.lit(0), F.lit(len(self.classes) - 1)), lambda k: F.when(k == -F.col("__mode"), 1.0).otherwise(0.0))
        if not keys:
            return df.drop("p").crossJoin(F.broadcast(df.agg(mode.alias("__mode")))).withColumn("p", p)
        return df.drop("p").join(df.groupBy(*keys).agg(mode.alias("__mode")), keys).withColumn("p", p)


class ClassLogLoss(ListScorer):
    """Cross entropy of the class that occurred; probabilities are kept off 0 and 1 and add up to one."""

    def metric(self):
        labels = F.lit([float(c) for c in self.classes]).cast("array<double>")
        kept = F.transform("p", lambda x: F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), x)))
        total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
        return -_mean(F.log(F.element_at(kept, F.array_position(labels, F.col("y").cast("double")).cast("int")) / total))


class ClassAccuracy(ListScorer):
    """How often the likeliest class (the first of equals) occurred."""

    def metric(self):
        labels = F.lit([float(c) for c in self.classes]).cast("array<double>")
        best = F.element_at(labels, F.array_position("p", F.array_max("p")).cast("int"))
        return _mean((best == F.col("y").cast("double")).cast("double"))


class ProbabilityWeightedSquaredError(ClassScorer):
    """Mean over rows of the squared distances of all classes to the target, weighted by their probabilities."""

    def levelled(self, df):
        return df  # lists aren't aggregated here

    def metric(self):
        labels = F.lit([float(c) for c in self.classes]).cast("array<double>")
        y = F.col("y").cast("double")
        return _mean(F.aggregate(F.zip_with(F.col("p"), labels, lambda p, k: p * (k - y) * (k - y)), F.lit(0.0), lambda a, x: a + x))


class RankedProbability(ClassScorer):
    """Mean squared distance of the cumulative distributions, over K - 1 thresholds."""

    def metric(self):
        k = len(self.classes)
        labels = F.lit([float(c) for c in self.classes]).cast("array<double>")
        y = F.col("y").cast("double")
        gaps = F.zip_with(running(F.col("p")), labels, lambda c, t: (c - F.when(y <= t, 1.0).otherwise(0.0)) ** 2)
        return _mean(F.aggregate(F.slice(gaps, 1, k - 1), F.lit(0.0), lambda a, x: a + x) / (k - 1))


class OrdinalLoss(ClassScorer):
    """Log loss of 'below the threshold' for each threshold, weighted by how often the class
    just below it occurs among targets under the top class.

    Where that class occurs, the cumulative probability is kept in [0.0001, 0.9999] and goes
    on from there; where it doesn't, it is only kept in [0, 1].
    """

    def score(self, df: DataFrame) -> DataFrame:
        if not self.naive:
            return self._loss(self.rows(df)).withColumnRenamed("loss", "score")
        rows = self.rows(df)
        model, base = self._loss(rows), self._loss(self.baseline(rows)).withColumnRenamed("loss", "base")
        both = model.join(base, self.granularity) if self.granularity else model.crossJoin(base)
        return both.select(*self.granularity, (F.col("base") - F.col("loss")).alias("score"))

    def _loss(self, rows: DataFrame) -> DataFrame:
        cs = sorted(int(c) for c in self.classes)
        if len(cs) < 2 or cs != list(range(cs[0], cs[0] + len(cs))):
            raise ValueError("at least two consecutive classes are needed")
        keys = self.granularity
        counts = rows.groupBy(*keys).agg(F.array(*[F.sum((F.col("y") == c).cast("double")) for c in cs[:-1]]).alias("n"), F.sum((F.col("y") < cs[-1]).cast("double")).alias("total")) if keys else rows.agg(F.array(*[F.sum((F.col("y") == c).cast("double")) for c in cs[:-1]]).alias("n"), F.sum((F.col("y") < cs[-1]).cast("double")).alias("total"))
        held = rows.join(F.broadcast(counts), keys) if keys else rows.crossJoin(F.broadcast(counts))
        wide = F.raise_error(F.lit("a prediction's length differs from the number of classes"))
        p = F.when(F.size("p") == len(cs), F.col("p")).otherwise(wide.cast("array<double>"))
        cum, loss = p[0], F.lit(0.0)
        held = held.withColumns({"__c0": cum, "__l0": loss})
        for k, c in enumerate(cs[1:], start=1):
            share = F.when(F.col("total") > 0, F.col("n")[k - 1] / F.col("total")).otherwise(0.0)
            inside = F.greatest(F.lit(0.0001), F.least(F.lit(0.9999), F.col(f"__c{k - 1}")))
            step = -share * F.when(F.col("y") < c, F.log(inside)).otherwise(F.log(1 - inside))
            onward = F.when(share > 0, inside).otherwise(F.col(f"__c{k - 1}")) + F.col("p")[k]
            held = held.withColumns({f"__c{k}": F.greatest(F.lit(0.0), F.least(F.lit(1.0), onward)), f"__l{k}": F.col(f"__l{k - 1}") + F.when(share > 0, step).otherwise(0.0)})
        agg = F.coalesce(F.avg(f"__l{len(cs) - 1}"), F.lit(0.0)).alias("loss")
        return held.groupBy(*keys).agg(agg) if keys else held.agg(agg)


@dataclass
class ThresholdEvent(ClassScorer):
    """Scores P(outcome at or beyond a row's rounded threshold), by log loss unless ``inner`` says otherwise."""

    threshold: str = "threshold"
    comparator: str = ">="
    inner: type = LogLoss

    def score(self, df: DataFrame) -> DataFrame:
        t = F.rint(F.col(self.threshold))
        ops = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}
        cmp = ops[self.comparator]
        labels = F.lit([float(c) for c in self.classes]).cast("array<double>")
        p = F.aggregate(F.zip_with(F.col(self.prediction), labels, lambda q, k: F.when(cmp(k, t), q).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
        df = df.withColumns({"__p": F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)), "__y": cmp(F.col(self.target).cast("double"), t).cast("int")})
        return self.inner("__p", "__y", filters=self.filters, validation=self.validation, granularity=self.granularity, naive=self.naive, naive_granularity=self.naive_granularity, weight=self.weight, level=self.level, how=self.how).score(df)


class CallableScorer(Scorer):
    """Any function (targets, predictions) -> number, on each group's rows, which must fit into one task."""

    def __init__(self, function, *args, **kw):
        super().__init__(*args, **kw)
        self.function = function

    def metric(self):
        f = self.function

        @F.pandas_udf("double")
        def call(y: pd.Series, p: pd.Series) -> float:
            return float(f(y.to_numpy(), p.to_numpy()))

        return call(F.col("y").cast("double"), F.col("p").cast("double"))
