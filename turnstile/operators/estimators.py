"""Model stages on ``pyspark.ml``, temporal cross-validation, and wrappers around them.

A model here has ``fit(df) -> fitted`` and ``fitted.transform(df)``, which adds a
``prediction`` column, and for classifiers ``probability``, an array in class order.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Roles
from ..functions.frames import clip, finite, kept
from .shaping import Filter, apply_filters, match_number, reduce_groups, target_of

KINDS = {
    "linear": (LinearRegression, False), "logistic": (LogisticRegression, True), "gbt": (GBTRegressor, False), "gbt_classifier": (GBTClassifier, True),
    "forest": (RandomForestRegressor, False), "forest_classifier": (RandomForestClassifier, True),
}


def day_weighted(df: DataFrame, date: str, alias: str, epsilon: float = 0.1) -> DataFrame:
    """Later rows weigh more: the days since the first one over twice the whole span, both a little longer."""
    t = F.unix_micros(F.col(date).cast("timestamp")) / 86_400e6
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    return df.withColumn(alias, (t - F.lit(lo) + epsilon) / (2 * (hi - lo) + epsilon)) if lo is not None else df.withColumn(alias, F.lit(1.0))


@dataclass(frozen=True)
class Model:
    """Feature preparation and an estimator, chosen from the schema.

    Numbers are imputed (and for linear kinds scaled), other columns indexed (one-hot for
    linear kinds; unseen values get an index of their own). Filters, clipping of the target
    and dropping of null targets apply when fitting only. With ``granularity`` the model is
    fitted on group means and predicts for all members of a group.
    """

    kind: str
    target: str
    features: tuple[str, ...] = ()
    granularity: tuple[str, ...] = ()
    aggregation_weight: str | None = None
    filters: tuple[Filter, ...] = ()
    min_target: float | None = None
    max_target: float | None = None
    sample_weight: str | None = None
    day_weight: str | None = None
    day_epsilon: float = 0.1
    min_prediction: float | None = None
    max_prediction: float | None = None
    scale: bool | None = None
    params: dict = field(default_factory=dict)
    output: str = "prediction"

    @property
    def classifier(self) -> bool:
        return KINDS[self.kind][1]

    def columns(self, df: DataFrame) -> list[str]:
        skip = {self.target, self.sample_weight, self.day_weight, self.aggregation_weight, *self.granularity}
        return list(self.features) or [f.name for f in df.schema.fields if f.name not in skip and not isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType, T.ArrayType, T.MapType, T.StructType))]

    def reduced(self, df: DataFrame, target: bool) -> DataFrame:
        keep = [*self.granularity, *[c for c in self.columns(df) if c not in self.granularity]]
        keep += [c for c in (self.aggregation_weight, self.day_weight) if c and c not in keep]
        more = target_of(self.target, self.sample_weight) if target else []
        return reduce_groups(df, list(self.granularity), self.aggregation_weight, columns=keep, more=more)

    def reads(self, df: DataFrame, *more: str) -> list[str]:
        """The columns of ``df`` that fitting needs, and ``more``."""
        need = {*self.columns(df), *self.granularity, *[f.column for f in self.filters], self.target, self.aggregation_weight, self.sample_weight, self.day_weight, *more}
        return [c for c in df.columns if c in need]

    def training(self, df: DataFrame) -> DataFrame:
        df = apply_filters(df, list(self.filters)).where(F.col(self.target).isNotNull())
        if self.granularity:
            df = self.reduced(df, True)
        return df.withColumn(self.target, clip(F.col(self.target).cast("double"), self.min_target, self.max_target))

    def fit(self, df: DataFrame) -> FittedModel:
        """The stages pass over the rows some times, which are made once."""
        rows = self.training(df)
        with kept(rows.select(self.reads(rows))) as rows:
            return self._fit(rows)

    def _fit(self, rows: DataFrame) -> FittedModel:
        names = self.columns(rows)
        numbers = [c for c in names if isinstance(rows.schema[c].dataType, (T.NumericType, T.BooleanType))]
        words = [c for c in names if c not in numbers]
        linear = self.kind in ("linear", "logistic")
        rows = rows.withColumns({c: F.col(c).cast("double") for c in numbers}) if numbers else rows
        stages: list = []
        if numbers:
            stages.append(Imputer(inputCols=numbers, outputCols=[f"__i_{c}" for c in numbers]))
        if words:
            stages.append(StringIndexer(inputCols=words, outputCols=[f"__x_{c}" for c in words], handleInvalid="keep", stringOrderType="alphabetAsc"))
            if linear:
                stages.append(OneHotEncoder(inputCols=[f"__x_{c}" for c in words], outputCols=[f"__o_{c}" for c in words], handleInvalid="keep"))
        inputs = [f"__i_{c}" for c in numbers] + [("__o_" if linear else "__x_") + c for c in words]
        stages.append(VectorAssembler(inputCols=inputs, outputCol="__raw", handleInvalid="keep"))
        scale = linear if self.scale is None else self.scale
        if scale:
            stages.append(StandardScaler(inputCol="__raw", outputCol="__features", withMean=False))
        label, labels = self.target, None
        if self.classifier:
            labels = [r[0] for r in rows.select(self.target).distinct().orderBy(self.target).collect()]  # one row a class
            code = F.array_position(F.lit(labels).cast("array<double>"), F.col(self.target)) - 1
            rows, label = rows.withColumn("__label", code.cast("double")), "__label"
            if len(labels) < 2:
                raise ValueError("at least two classes are needed")
        weight = self.sample_weight
        if self.day_weight:
            rows = day_weighted(rows, self.day_weight, "__w", self.day_epsilon)
            rows = rows.withColumn("__w", F.col("__w") * (F.col(weight) if weight else F.lit(1.0)))
            weight = "__w"
        est = KINDS[self.kind][0](featuresCol="__features" if scale else "__raw", labelCol=label, predictionCol="__prediction", **({"weightCol": weight} if weight else {}), **self.params)
        if not hasattr(est, "seed") or est.hasParam("seed") and "seed" not in self.params:
            est = est.setSeed(7) if hasattr(est, "setSeed") else est
        fitted = Pipeline(stages=[*stages, est]).fit(rows)
        return FittedModel(self, fitted, numbers, words, labels)


@dataclass(frozen=True)
class FittedModel:
    model: Model
    pipeline: object
    numbers: list[str]
    words: list[str]
    classes: list | None

    def transform(self, df: DataFrame) -> DataFrame:
        m = self.model
        if m.granularity:
            group = self._predict(m.reduced(df, False)).select(*m.granularity, *self.outputs())
            return df.join(group, list(m.granularity), "left")
        return self._predict(df)

    def outputs(self) -> list[str]:
        return [self.model.output, *(["probability"] if self.classes else [])]

    def _predict(self, df: DataFrame) -> DataFrame:
        m = self.model
        keep = df.columns
        held = df.withColumns({f"__k_{c}": F.col(c) for c in self.numbers}).withColumns({c: F.col(c).cast("double") for c in self.numbers}) if self.numbers else df
        out = self.pipeline.transform(held)
        p = F.col("__prediction")
        if self.classes:
            p = F.element_at(F.lit(self.classes).cast("array<double>"), (p + 1).cast("int"))
        names = [F.col(f"__k_{c}").alias(c) if c in self.numbers else F.col(c) for c in keep if c not in self.outputs()]
        prob = [vector_to_array("probability").alias("probability")] if self.classes else []
        return out.select(*names, clip(p, m.min_prediction, m.max_prediction).alias(m.output), *prob)

    def importances(self) -> list[tuple[str, float]]:
        """Features by absolute importance; one-hot parts are added up."""
        last = self.pipeline.stages[-1]
        values = (last.featureImportances if hasattr(last, "featureImportances") else last.coefficients).toArray()
        names, at = [], 0
        sizes = {}
        if self.words and self.model.kind in ("linear", "logistic"):
            enc = next(s for s in self.pipeline.stages if "OneHot" in type(s).__name__)
            sizes = dict(zip(self.words, enc.categorySizes))
        for c in [*self.numbers, *self.words]:
            n = sizes.get(c, 1) if c in sizes else 1
            names.append((c, float(sum(values[at : at + n], 0.0))))
            at += n
        return sorted(names, key=lambda x: -abs(x[1]))


# -- cross-validation ------------------------------------------------------


@dataclass(frozen=True)
class MatchKFold:
    """Expanding windows over matches: train before a cut, validate the next step of matches."""

    roles: Roles
    n_splits: int = 3
    min_date: object = None

    def labelled(self, df: DataFrame, hold: bool = False) -> tuple[DataFrame, int, int]:
        """``df`` with ``__match``, the first cut, and the step. ``hold``: its rows are kept for later passes."""
        df = match_number(df, self.roles, "__match")
        df = df.persist() if hold else df
        t = F.unix_micros(F.col(self.roles.date).cast("timestamp"))
        if self.min_date is None:  # the middle distinct date
            dates = df.select(t.alias("d")).distinct()
            n = dates.count()
            cut = F.lit(dates.agg(F.expr(f"percentile_disc({(n // 2 + 0.5) / n}) WITHIN GROUP (ORDER BY d)")).first()[0])
        else:
            cut = F.unix_micros(F.lit(self.min_date).cast("timestamp"))
        last, first = df.agg(F.max("__match"), F.min(F.when(t >= cut, F.col("__match")))).first()
        return df, first, max(1, (last - first) // self.n_splits)

    def split_labels(self, df: DataFrame) -> DataFrame:
        """``df`` with ``fold``: the fold that validates a row, -1 for rows that only train."""
        rows, first, step = self.labelled(df)
        fold = F.least(F.floor((F.col("__match") - first) / step), F.lit(self.n_splits - 1)).cast("int")
        return rows.withColumn("fold", F.when(F.col("__match") < first, -1).otherwise(fold)).drop("__match")

    def prepared(self, df: DataFrame) -> Folds:
        """The folds over ``df``, numbered and held once for any number of models."""
        return Folds(self, *self.labelled(df, hold=True))

    def predictions(self, df: DataFrame, model, add_training: bool = False) -> DataFrame:
        """Validation rows of all folds with the predictions of models that saw earlier matches only."""
        return self.prepared(df).predictions(model, add_training)


@dataclass(frozen=True)
class Folds:
    """Held rows with ``__match``, the first cut, and the step."""

    by: MatchKFold
    rows: DataFrame
    first: int
    step: int

    def predictions(self, model, add_training: bool = False) -> DataFrame:
        out, n = [], self.by.n_splits
        for i in range(n):
            cut = self.first + i * self.step
            train = self.rows.where(F.col("__match") < cut)
            valid = self.rows.where(F.col("__match") >= cut)
            if i < n - 1:
                valid = valid.where(F.col("__match") < cut + self.step)
            if train.isEmpty() or valid.isEmpty():
                raise ValueError("a fold has no training or no validation rows")
            fitted = model.fit(train.drop("__match"))
            if add_training and not i:
                out.append(fitted.transform(train.drop("__match")).withColumn("is_validation", F.lit(False)))
            out.append(fitted.transform(valid.drop("__match")).withColumn("is_validation", F.lit(True)))
        return reduce(DataFrame.unionByName, out)

    def release(self) -> None:
        """The rows needn't be held any more."""
        self.rows.unpersist()


@dataclass(frozen=True)
class RegressorFeature:
    """Out-of-fold predictions as a feature; ``fitted`` is the model on all rows for later ones."""

    model: Model
    folds: MatchKFold

    def fit(self, df: DataFrame) -> tuple[DataFrame, FittedModel]:
        if self.model.classifier:
            raise ValueError("a regressor is needed")
        return self.folds.predictions(df, self.model, add_training=True).drop("is_validation"), self.model.fit(df)


@dataclass(frozen=True)
class NetOverPredicted:
    """The target minus its prediction."""

    model: Model
    alias: str = "net_over_predicted"

    def fit(self, df: DataFrame):
        if self.model.classifier:
            raise ValueError("a regressor is needed")
        return _Residual(self.model.fit(df), self.alias)


@dataclass(frozen=True)
class _Residual:
    fitted: FittedModel
    alias: str

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.fitted.transform(df)
        return out.withColumn(self.alias, F.col(self.fitted.model.target) - F.col(self.fitted.model.output))


@dataclass(frozen=True)
class Imputed:
    """The target where it is a finite number, else its prediction from the other columns."""

    model: Model

    def fit(self, df: DataFrame):
        t = self.model.target
        return _FittedImputed(replace(self.model, output="__filled").fit(df.withColumn(t, finite(F.col(t)))))


@dataclass(frozen=True)
class _FittedImputed:
    fitted: FittedModel

    def transform(self, df: DataFrame) -> DataFrame:
        t = self.fitted.model.target
        out = self.fitted.transform(df)
        return out.withColumn(t, F.coalesce(finite(F.col(t)), F.col("__filled"))).drop("__filled")


@dataclass(frozen=True)
class Ratio:
    """A row's prediction over its group's; the group model learns from group means."""

    model: Model
    group: tuple[str, ...]
    alias: str = "ratio"
    row_column: str | None = None
    group_column: str | None = None

    def fit(self, df: DataFrame):
        own = None if self.row_column else replace(self.model, output="__row").fit(df)
        means = df.groupBy(*self.group).agg(*[F.avg(c).alias(c) for c in (*self.model.features, self.model.target)])
        team = None if self.group_column else replace(self.model, output="__group").fit(means)
        return _FittedRatio(self, own, team)


@dataclass(frozen=True)
class _FittedRatio:
    ratio: Ratio
    own: FittedModel | None
    team: FittedModel | None

    def transform(self, df: DataFrame) -> DataFrame:
        r = self.ratio
        out = self.own.transform(df) if self.own else df.withColumn("__row", F.col(r.row_column))
        if self.team:
            means = df.groupBy(*r.group).agg(*[F.avg(c).alias(c) for c in r.model.features])
            out = out.join(self.team.transform(means).select(*r.group, "__group"), list(r.group), "left")
        else:
            out = out.withColumn("__group", F.col(r.group_column))
        return out.withColumn(r.alias, F.col("__row") / F.col("__group")).drop("__row", "__group")


@dataclass(frozen=True)
class ByValue:
    """One model for each value of a column; rows of unseen values get no prediction."""

    model: Model
    column: str

    def fit(self, df: DataFrame):
        reads = self.model.reads(df, self.column) if isinstance(self.model, Model) and self.model.features else df.columns
        with kept(df.select(reads)) as df:
            values = [r[0] for r in df.select(self.column).distinct().orderBy(self.column).collect() if r[0] is not None]
            return _FittedByValue(self, {v: self.model.fit(df.where(F.col(self.column) == v)) for v in values})


@dataclass(frozen=True)
class _FittedByValue:
    by: ByValue
    models: dict

    def transform(self, df: DataFrame) -> DataFrame:
        c = F.col(self.by.column)
        parts = [m.transform(df.where(c == v)) for v, m in self.models.items()]
        rest = df.where(c.isNull() | ~c.isin(*self.models)) if self.models else df
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*parts, rest])


def frequency_buckets(shares: dict[float, float], least: float) -> list[list[float]]:
    """Classes in order, runs of rare neighbours joined until they reach ``least`` together."""
    out: list[list[float]] = []
    weight, run = 0.0, None
    for c in sorted(shares):
        if shares[c] >= least:
            out.append([c])
            run = None
        elif run is not None and weight < least:
            run.append(c)
            weight += shares[c]
        else:
            run, weight = [c], shares[c]
            out.append(run)
    return out


@dataclass(frozen=True)
class FrequencyBuckets:
    """A classifier over buckets of rare classes; a bucket's probability is spread evenly."""

    model: Model
    least: float = 0.003

    def fit(self, df: DataFrame):
        rows = self.model.training(df)
        with kept(rows.select(self.model.reads(rows))) as rows:
            return self._fit(rows)

    def _fit(self, rows: DataFrame):
        n = rows.count()
        shares = {r[0]: r[1] / n for r in rows.groupBy(self.model.target).count().collect()}  # one row a class
        buckets = frequency_buckets(shares, self.least)
        if len(shares) < 2:
            raise ValueError("at least two classes are needed")
        code = reduce(lambda a, kb: F.when(F.col(self.model.target).isin(*kb[1]), F.lit(float(kb[0]))).otherwise(a), enumerate(buckets), F.lit(None).cast("double"))
        inner = replace(self.model, min_target=None, max_target=None)
        return _FittedBuckets(inner.fit(rows.withColumn(self.model.target, code)), buckets)


@dataclass(frozen=True)
class _FittedBuckets:
    fitted: FittedModel
    buckets: list

    @property
    def classes(self) -> list:
        return [c for b in self.buckets for c in b]

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.fitted.transform(df)
        p = F.flatten(F.array(*[F.array_repeat(F.col("probability")[k] / len(b), len(b)) for k, b in enumerate(self.buckets)]))
        best = F.element_at(F.lit(self.classes).cast("array<double>"), F.array_position(F.col("probability"), F.array_max("probability")).cast("int"))
        out = out.withColumn("probability", p)
        return out.withColumn(self.fitted.model.output, best)


@dataclass(frozen=True)
class Ordinal:
    """K - 1 binary models of 'above this class'; differences of their probabilities."""

    model: Model

    def fit(self, df: DataFrame):
        feats = self.model.columns(df)
        with kept(df.select(self.model.reads(df))) as df:
            return self._fit(df, feats)

    def _fit(self, df: DataFrame, feats: list[str]):
        t = self.model.target
        classes = [r[0] for r in df.where(F.col(t).isNotNull()).select(F.col(t).cast("double")).distinct().orderBy(t).collect()]
        if len(classes) < 3:
            raise ValueError("at least three classes are needed")
        models = [replace(self.model, features=tuple(feats), target="__above", output=f"__p{k}").fit(df.withColumn("__above", F.when(F.col(t).isNotNull(), (F.col(t) > c).cast("double")))) for k, c in enumerate(classes[:-1])]
        return _FittedOrdinal(models, classes)


@dataclass(frozen=True)
class _FittedOrdinal:
    models: list
    classes: list

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for k, m in enumerate(self.models):
            out = m.transform(out).withColumn(f"__a{k}", F.col("probability")[1]).drop("probability", f"__p{k}")
        n = len(self.models)
        ps = [1 - F.col("__a0"), *[F.col(f"__a{k - 1}") - F.col(f"__a{k}") for k in range(1, n)], F.col(f"__a{n - 1}")]
        out = out.withColumn("probability", F.array(*[F.greatest(p, F.lit(0.0)) for p in ps])).drop(*[f"__a{k}" for k in range(n)])
        best = F.array_position("probability", F.array_max("probability")).cast("int")
        return out.withColumn("prediction", F.element_at(F.lit(self.classes).cast("array<double>"), best))


@dataclass(frozen=True)
class Conditional:
    """P(below a row's distance) gates two models of the difference to it; their mixture is
    mapped to classes, mass beyond the ends goes to the end classes."""

    model: Model
    gate: str

    def fit(self, df: DataFrame):
        t = self.model.target
        feats = tuple(self.model.columns(df))
        rows = df.where(F.col(t).isNotNull()).select(self.model.reads(df, self.gate))
        with kept(rows) as rows:
            return self._fit(rows, feats)

    def _fit(self, rows: DataFrame, feats: tuple[str, ...]):
        t = self.model.target
        classes = [int(r[0]) for r in rows.select(F.col(t).cast("int")).distinct().orderBy(t).collect()]
        rows = rows.withColumns({"__gate": (F.col(self.gate) > F.col(t)).cast("double"), "__diff": F.col(t) - F.col(self.gate)})
        make = lambda target, out, part: replace(self.model, features=feats, target=target, output=out).fit(part)
        return _FittedConditional(self, make("__gate", "__g", rows), make("__diff", "__d0", rows.where("__gate = 0")), make("__diff", "__d1", rows.where("__gate = 1")), classes)


@dataclass(frozen=True)
class _FittedConditional:
    by: Conditional
    gate: FittedModel
    over: FittedModel
    under: FittedModel
    classes: list

    def _mapped(self, probs: Column, diffs: list) -> list[Column]:
        g = F.col(self.by.gate).cast("int")
        lo, hi = self.classes[0], self.classes[-1]
        known = F.lit(self.classes).cast("array<int>")
        out = []
        for c in self.classes:
            parts = []
            for k, d in enumerate(diffs):
                to = g + int(d)
                hit = to == c
                if c == lo:
                    hit = hit | (to < lo)
                if c == hi:
                    hit = hit | ((to > lo) & ~F.array_contains(known, to))
                parts.append(F.when(hit, probs[k]).otherwise(0.0))
            out.append(reduce(lambda a, b: a + b, parts))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.gate.transform(df).withColumnRenamed("probability", "__pg")
        out = self.over.transform(out).withColumnRenamed("probability", "__po")
        out = self.under.transform(out).withColumnRenamed("probability", "__pu")
        a, b = self._mapped(F.col("__po"), self.over.classes), self._mapped(F.col("__pu"), self.under.classes)
        p = F.array(*[F.col("__pg")[0] * x + F.col("__pg")[1] * y for x, y in zip(a, b)])
        # In steps, so that the mixture and its sum are computed once.
        out = out.withColumn("__mix", p).withColumn("__total", F.aggregate("__mix", F.lit(0.0), lambda s, x: s + x))
        out = out.withColumn("probability", F.transform("__mix", lambda x: F.when(F.col("__total") > 0, x / F.col("__total")).otherwise(x))).drop("__mix", "__total")
        best = F.element_at(F.lit(self.classes).cast("array<double>"), F.array_position("probability", F.array_max("probability")).cast("int"))
        return out.withColumn("prediction", best).drop("__pg", "__po", "__pu", "__g", "__d0", "__d1")


# -- tuning ------------------------------------------------------------------


@dataclass(frozen=True)
class Param:
    """A range (float or int, optionally on a log scale), choices, or a bool."""

    low: float | None = None
    high: float | None = None
    choices: tuple = ()
    whole: bool = False
    log: bool = False

    def draw(self, rng: random.Random):
        import math

        if self.choices:
            return rng.choice(self.choices)
        if self.low is None:
            return rng.random() < 0.5
        x = math.exp(rng.uniform(math.log(self.low), math.log(self.high))) if self.log else rng.uniform(self.low, self.high)
        return round(x) if self.whole else x


#: Ranges by model kind and for ratings.
SPACES = {
    "linear": {"regParam": Param(1e-4, 1.0, log=True), "elasticNetParam": Param(0.0, 1.0)},
    "logistic": {"regParam": Param(1e-4, 1.0, log=True), "elasticNetParam": Param(0.0, 1.0)},
    "gbt": {"maxDepth": Param(2, 6, whole=True), "stepSize": Param(0.02, 0.3, log=True), "maxIter": Param(10, 60, whole=True)},
    "forest": {"maxDepth": Param(3, 8, whole=True), "numTrees": Param(10, 60, whole=True)},
    "rating": {
        "offence_multiplier": Param(10, 120), "defence_multiplier": Param(10, 120), "confidence_weight": Param(0.3, 1.0), "confidence_max_days": Param(30, 300, whole=True),
        "confidence_denominator": Param(50, 300), "least_ratio": Param(0.02, 0.4), "coef": Param(0.002, 0.01),
    },
}


def search(objective: Callable[[dict], float], space: dict[str, Param], trials: int = 10, fixed: dict | None = None, first: list[dict] = (), seed: int = 7, maximise: bool = False) -> tuple[dict, float, list[tuple[dict, float]]]:
    """Random search: the best parameters, their score, and all trials; a failing trial counts as the worst."""
    rng = random.Random(seed)
    tried = []
    for k in range(trials):
        params = dict(first[k]) if k < len(first) else {n: p.draw(rng) for n, p in space.items()}
        params |= fixed or {}
        try:
            score = float(objective(params))
        except (ValueError, ArithmeticError):
            score = float("-inf" if maximise else "inf")
        tried.append((params, score))
    best = (max if maximise else min)(tried, key=lambda t: t[1])
    return *best, tried
