"""Leakage-free window features: lags, rolling aggregates, day ranges, outcome splits.

Every generator groups rows to ``(match, *granularity)`` where they aren't already, sees
only earlier groups of an entity, gives the rows of one update batch the same values, and
can add the opponents' mean. ``fit`` keeps the tail of history as a state frame, with the
values that an entity's last row carries forward; ``update`` computes over state and new
rows and trims afterwards, ``project`` looks up one row of features for each entity and
never changes state.

All generators of one granularity use the same window keys and order, so Spark sorts and
exchanges the rows once for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Roles
from ..functions.frames import micros

DAY = 86_400_000_000


@dataclass(frozen=True)
class Generator:
    """What all window features share."""

    features: tuple[str, ...]
    granularity: tuple[str, ...]
    roles: Roles
    add_opponent: bool = False
    prefix: str = ""
    group_to: tuple[str, ...] | None = None
    unique: tuple[str, ...] | None = None

    def __post_init__(self):
        for name in ("features", "granularity"):
            v = getattr(self, name)
            object.__setattr__(self, name, (v,) if isinstance(v, str) else tuple(v))

    # -- names -----------------------------------------------------------
    def entity_features(self) -> list[str]:
        raise NotImplementedError

    @property
    def features_out(self) -> list[str]:
        own = self.entity_features()
        return own + [f"{c}_opponent" for c in own] if self.add_opponent else own

    @property
    def keys(self) -> list[str]:
        return list(dict.fromkeys(self.group_to or (self.roles.match, *self.granularity)))

    def inputs(self) -> list[str]:
        """Numeric columns that the window reads."""
        return list(self.features)

    # -- windows ---------------------------------------------------------
    def by(self):
        return Window.partitionBy(*self.granularity).orderBy(self.roles.date, self.roles.match)

    def window(self, g: DataFrame) -> DataFrame:
        """``g`` (one row a group) with the features."""
        raise NotImplementedError

    def newest(self, g: DataFrame) -> DataFrame:
        """One row an entity with the features of a match after all of ``g`` (a state)."""
        raise NotImplementedError

    def tail(self, g: DataFrame) -> DataFrame:
        """The rows of ``g`` (grouped, with or without features) that later features can need."""
        raise NotImplementedError

    def completed(self, df: DataFrame) -> DataFrame:
        """Projected rows with the features that depend on the rows themselves."""
        return df

    # -- plan ------------------------------------------------------------
    def grouped(self, df: DataFrame) -> DataFrame:
        unique = self.unique or self.roles.unique
        carry = [c for c in dict.fromkeys((self.roles.date, self.roles.batch, *self.also())) if c not in self.keys]
        cols = [c for c in dict.fromkeys(self.inputs()) if c not in self.keys]
        if set(unique) <= set(self.keys):
            return df.select(*self.keys, *carry, *cols)
        return df.groupBy(*self.keys).agg(*[F.min(c).alias(c) for c in carry], *[F.avg(c).alias(c) for c in cols])

    def also(self) -> tuple[str, ...]:
        """Other columns a group keeps."""
        return ()

    def equalised(self, g: DataFrame) -> DataFrame:
        """The first value of an entity inside an update batch holds for the whole batch."""
        if self.roles.batch in self.keys and self.roles.batch == self.roles.match:
            return g
        w = Window.partitionBy(self.roles.batch, *self.granularity).orderBy(self.roles.date, self.roles.match)
        return g.withColumns({c: F.first(c).over(w) for c in self.entity_features()})

    def merged(self, df: DataFrame, g: DataFrame) -> DataFrame:
        own = self.entity_features()
        return df.drop(*own).join(g.select(*self.keys, *own), self.keys, "left")

    def opponents(self, df: DataFrame) -> DataFrame:
        return opponent_means(df, self.roles, self.entity_features()) if self.add_opponent else df

    def transform(self, df: DataFrame) -> DataFrame:
        """All rows with their features, from the rows themselves."""
        unique = set(self.unique or self.roles.unique)
        g = self.grouped(df)
        if unique <= set(self.keys):  # rows are groups: no grouping, no join back
            out = self.equalised(self.window(df))
        else:
            out = self.merged(df, self.equalised(self.window(g)))
        return self.opponents(out)

    def fit(self, df: DataFrame) -> tuple[DataFrame, Fitted]:
        return self.transform(df), Fitted(self, self.tail(self.window(self.grouped(df))))


@dataclass(frozen=True)
class Fitted:
    """A generator with the tail of its history."""

    generator: Generator
    state: DataFrame

    def update(self, df: DataFrame) -> tuple[DataFrame, Fitted]:
        """Features of later rows, and the state after them. Trimming follows computing."""
        g = self.generator
        new = g.grouped(df)
        both = self.state.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)), allowMissingColumns=True)
        newest = Window.partitionBy(*g.keys).orderBy(F.col("__new").desc())
        both = both.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
        held = g.window(both)
        done = g.equalised(held.where("__new").drop("__new", *[c for c in held.columns if c.startswith(CARRIED)]))
        return g.opponents(g.merged(df, done)), replace(self, state=g.tail(held.drop("__new")))

    def project(self, df: DataFrame) -> DataFrame:
        """Features of future rows by entity; opponents' means follow from them."""
        g = self.generator
        latest = g.newest(self.state)
        latest = latest.select(*g.granularity, *[c for c in g.entity_features() if c in latest.columns])
        out = df.join(latest, list(g.granularity), "left") if g.granularity else df.crossJoin(F.broadcast(latest))  # without granularity one row
        return g.completed(g.opponents(g.completed(out)))


CARRIED = "__carried_"


def carried_on(raw: DataFrame, names: list[str], by) -> DataFrame:
    """Values forward over gaps. Rows of a state (not ``__new``) bring what they carried, as
    their own frames are cut off."""
    if "__new" in raw.columns and CARRIED + names[0] in raw.columns:
        raw = raw.withColumns({n: F.when(F.col("__new"), F.col(n)).otherwise(F.col(CARRIED + n)) for n in names})
    return raw.withColumns({n: filled(F.col(n), by) for n in names})


def kept(g: DataFrame, by_cols: tuple[str, ...], roles: Roles, n: int, names: list[str]) -> DataFrame:
    """The last ``n`` rows of each entity; its last one keeps the values of ``names`` as carried ones."""
    known = [c for c in names if c in g.columns]
    last = _last_rows(g, by_cols, roles, n)
    last = last.withColumns({CARRIED + c: F.when(F.col("__k") == 1, F.col(c)) for c in known}) if known else last
    return last.drop("__k", *known)


def first_known(df: DataFrame, roles: Roles, granularity: list[str], columns: list[str]) -> DataFrame:
    """Future rows with the values of each entity's first one: what is known before it holds for all."""
    by = Window.partitionBy(*granularity).orderBy(roles.date, roles.match, roles.team)
    return df.withColumns({c: F.first(c).over(by) for c in columns})


def known_matches(df: DataFrame, history: DataFrame, roles: Roles) -> tuple[DataFrame, DataFrame]:
    """The rows of matches that ``history`` holds, and the rows of others."""
    ids = history.select(roles.match).distinct()
    return df.join(ids, roles.match, "left_semi"), df.join(ids, roles.match, "left_anti")


def checked_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``; two rows of the same ``columns`` raise when the plan runs."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*columns))
    one = F.when(n == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"rows are not unique by {columns}")).cast("boolean"))
    return df.withColumn("__one", one).where("__one").drop("__one")


def checked_order(df: DataFrame, roles: Roles, number: str) -> DataFrame:
    """``df``; rows whose ``number`` doesn't ascend with (date, match, team) raise when the plan runs.

    Neighbours are compared within a day and days by their ends, so nothing is sorted as a whole.
    """
    key = F.struct(roles.date, roles.match, roles.team)
    inside = Window.partitionBy("__day").orderBy(key)
    df = df.withColumn("__day", F.to_date(roles.date))
    ends = df.groupBy("__day").agg(F.min(number).alias("__lo"), F.max(number).alias("__hi"))  # a row a day
    ends = ends.withColumn("__before", F.max("__hi").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))).drop("__hi")
    ok = (F.col(number) > F.coalesce(F.lag(number).over(inside), F.col(number) - 1)) & (F.col("__lo") > F.coalesce("__before", F.col("__lo") - 1))
    ok = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("rows are not in order of date, match and team")).cast("boolean"))
    return df.join(ends, "__day").withColumn("__ok", ok).where("__ok").drop("__ok", "__day", "__lo", "__before")


def opponent_means(df: DataFrame, roles: Roles, columns: list[str]) -> DataFrame:
    """``{column}_opponent``: the mean over the rows of the other team in the same update batch.

    What the batch holds less what the own team holds, so both windows share one exchange
    (by batch) and nothing is joined or computed twice.
    """
    all_, own = Window.partitionBy(roles.batch), Window.partitionBy(roles.batch, roles.team)

    def mean(c: str) -> Column:
        n = F.count(c).over(all_) - F.count(c).over(own)
        return F.when(n > 0, (F.sum(c).over(all_) - F.coalesce(F.sum(c).over(own), F.lit(0.0))) / n)

    return df.withColumns({f"{c}_opponent": mean(c) for c in columns})


def filled(c: Column, by) -> Column:
    """The last value that isn't null, up to the current row."""
    return F.last(c, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _last_rows(df: DataFrame, by_cols: tuple[str, ...], roles: Roles, n: int) -> DataFrame:
    if not by_cols:  # the top n by sorting in parts; the window then sees n rows
        df = df.orderBy(F.col(roles.date).desc(), F.col(roles.match).desc()).limit(n)
    w = Window.partitionBy(*by_cols).orderBy(F.col(roles.date).desc(), F.col(roles.match).desc())
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n)


@dataclass(frozen=True)
class Lag(Generator):
    """The 1st to ``length``-th value before (with ``future``: after) a match."""

    length: int = 1
    future: bool = False
    prefix: str = "lag"

    def entity_features(self):
        return [f"{self.prefix}_{f}{k}" for f in self.features for k in range(1, self.length + 1)]

    def window(self, g):
        move = F.lead if self.future else F.lag
        return g.withColumns({f"{self.prefix}_{f}{k}": move(f, k).over(self.by()) for f in self.features for k in range(1, self.length + 1)})

    def newest(self, g):
        last = _last_rows(g, self.granularity, self.roles, self.length)
        pick = [F.max(F.when(F.col("__k") == k, F.col(f))).alias(f"{self.prefix}_{f}{k}") for f in self.features for k in range(1, self.length + 1)]
        return last.groupBy(*self.granularity).agg(*pick)

    def tail(self, g):
        return _last_rows(g, self.granularity, self.roles, self.length).drop("__k", *self.entity_features())


@dataclass(frozen=True)
class Rolling(Generator):
    """Mean, sum or sample variance of the previous ``size`` rows, carried forward over gaps.

    ``weight``: weighted mean; the weights of null values count in the divisor.
    """

    size: int = 10
    how: str = "mean"
    min_periods: int = 1
    weight: str | None = None
    prefix: str = ""

    def __post_init__(self):
        super().__post_init__()
        if self.how not in ("mean", "sum", "var") or self.weight and self.how != "mean":
            raise ValueError("how is mean, sum or var; weights go with the mean")

    def _name(self, f):
        return f"{self.prefix or 'rolling_' + self.how}_{f}{self.size}"

    def entity_features(self):
        return [self._name(f) for f in self.features]

    def inputs(self):
        return [*self.features, *([self.weight] if self.weight else [])]

    def _value(self, f: str, over) -> Column:
        c = F.col(f)
        if self.weight:
            w = F.col(self.weight)
            total = over(F.sum(w))
            return F.when((total > 0) & (over(F.count(c)) >= self.min_periods), over(F.sum(c * w)) / total)
        agg = {"mean": F.avg, "sum": F.sum, "var": F.var_samp}[self.how]
        return F.when(over(F.count(c)) >= max(self.min_periods, 2 if self.how == "var" else 1), over(agg(c)))

    def window(self, g):
        frame = self.by().rowsBetween(-self.size, -1)
        raw = g.withColumns({self._name(f): self._value(f, lambda a: a.over(frame)) for f in self.features})
        return carried_on(raw, self.entity_features(), self.by())

    def newest(self, g):
        last = _last_rows(g, self.granularity, self.roles, self.size)
        return last.groupBy(*self.granularity).agg(*[self._value(f, lambda a: a).alias(self._name(f)) for f in self.features])

    def tail(self, g):
        return kept(g, self.granularity, self.roles, self.size, self.entity_features())


@dataclass(frozen=True)
class RollingDays(Generator):
    """Mean over the ``days`` days before a row's date, without the date itself.

    The divisor counts rows, null values too (``null_policy="skip"``: without them).
    """

    days: int = 30
    min_games: int | None = None
    weight: str | None = None
    add_count: bool = False
    null_policy: str = "count"
    prefix: str = "rolling_mean_days"

    def _name(self, f):
        return f"{self.prefix}_{f}{self.days}"

    @property
    def count_name(self):
        return f"{self.prefix}_count{self.days}"

    def entity_features(self):
        return [self._name(f) for f in self.features] + ([self.count_name] if self.add_count else [])

    def inputs(self):
        return [*self.features, *([self.weight] if self.weight else [])]

    def window(self, g):
        frame = Window.partitionBy(*self.granularity).orderBy("__t").rangeBetween(-self.days * DAY, -1)
        g = g.withColumn("__t", micros(F.col(self.roles.date)))
        rows = F.count(F.lit(1)).over(frame)
        out = {}
        for f in self.features:
            c = F.col(f)
            if self.weight:
                w = F.col(self.weight)
                value = F.when(F.sum(w).over(frame) > 0, F.sum(c * w).over(frame) / F.sum(w).over(frame))
            else:
                value = F.coalesce(F.sum(c).over(frame), F.lit(0.0)) / (rows if self.null_policy == "count" else F.count(c).over(frame))
            out[self._name(f)] = F.when(rows >= (self.min_games or 1), value)
        if self.add_count:
            out[self.count_name] = F.coalesce(rows, F.lit(0))
        return g.withColumns(out).drop("__t")

    def opponents(self, df):
        out = super().opponents(df)
        if self.add_opponent and self.add_count:
            out = out.fillna(0, [f"{self.count_name}_opponent"])
        return out

    def _recent(self, g):
        g = g.withColumn("__t", micros(F.col(self.roles.date)))
        last = g.agg(F.max("__t").alias("__max"))  # one row
        return g.join(F.broadcast(last), F.col("__t") > F.col("__max") - self.days * DAY).drop("__t", "__max")

    def newest(self, g):
        aggs = []
        for f in self.features:
            c = F.col(f)
            value = F.avg(c)
            if self.weight:
                w = F.col(self.weight)
                value = F.when(F.sum(w) > 0, F.sum(c * w) / F.sum(w))
            aggs.append(F.when(F.count(c) >= (self.min_games or 1), value).alias(self._name(f)))
        if self.add_count:
            aggs.append(F.count(self.features[0]).alias(self.count_name))
        return self._recent(g).groupBy(*self.granularity).agg(*aggs)

    def tail(self, g):
        return self._recent(g.drop(*self.entity_features()))


@dataclass(frozen=True)
class RollingBinary(Generator):
    """Means of the previous ``size`` rows by an outcome: those with flag 1 and those with 0.

    ``probability``: blends the two by the row's probability of a 1.
    """

    size: int = 10
    flag: str = "won"
    probability: str | None = None
    min_periods: int = 1
    prefix: str = "rolling_mean_binary"

    def _names(self, f):
        return [f"{self.prefix}_{f}{self.size}_{k}" for k in (1, 0)]

    def _blend(self, f):
        return f"{self.prefix}_{f}{self.size}_{self.probability}"

    def entity_features(self):
        return [n for f in self.features for n in self._names(f)] + ([self._blend(f) for f in self.features] if self.probability else [])

    def inputs(self):
        return [*self.features, self.flag, *([self.probability] if self.probability else [])]

    def _split(self, f, over):
        return {n: F.when(over(F.count(c)) >= self.min_periods, over(F.avg(c))) for n, k in zip(self._names(f), (1, 0)) for c in [F.when(F.col(self.flag) == k, F.col(f))]}

    def _means(self) -> list[str]:
        return [n for f in self.features for n in self._names(f)]

    def completed(self, df):
        """Both means blended by the row's own probability; the opponents' by the probability of a 0."""
        if not self.probability:
            return df
        p, out = F.col(self.probability), {}
        for f in self.features:
            one, zero = self._names(f)
            out[self._blend(f)] = F.col(one) * p + F.col(zero) * (1 - p)
            if f"{one}_opponent" in df.columns:
                out[f"{self._blend(f)}_opponent"] = F.col(f"{one}_opponent") * (1 - p) + F.col(f"{zero}_opponent") * p
        return df.withColumns(out)

    def opponents(self, df):
        return self.completed(super().opponents(df))

    def window(self, g):
        frame = self.by().rowsBetween(-self.size, -1)
        raw = g.withColumns({n: v for f in self.features for n, v in self._split(f, lambda a: a.over(frame)).items()})
        return self.completed(carried_on(raw, self._means(), self.by()))

    def newest(self, g):
        """The means, carried forward where the last rows have none."""
        last = _last_rows(g, self.granularity, self.roles, self.size)
        means = {n: v for f in self.features for n, v in self._split(f, lambda a: a).items()}
        if CARRIED + self._means()[0] in g.columns:
            means = {n: F.coalesce(v, F.max(CARRIED + n)) for n, v in means.items()}
        return last.groupBy(*self.granularity).agg(*[v.alias(n) for n, v in means.items()])

    def tail(self, g):
        return kept(g.drop(*[self._blend(f) for f in self.features]), self.granularity, self.roles, self.size, self._means())


class _Against(Rolling):
    """Rolling means of (opponent, ...) groups, none of which is a row."""

    def also(self):
        return (self.roles.match,)


@dataclass(frozen=True)
class AgainstOpponent:
    """A rolling mean keyed by (opponent, *granularity): how entities of a kind fare against this opponent."""

    features: tuple[str, ...]
    granularity: tuple[str, ...]
    roles: Roles
    size: int = 10
    min_periods: int = 1
    opponent: str = "__opponent"
    prefix: str = "rolling_mean_against"

    def with_opponent(self, df: DataFrame) -> DataFrame:
        """Each row with the other team of its match."""
        if self.opponent in df.columns:
            return df
        sides = df.select(self.roles.match, self.roles.team).distinct()
        other = sides.select(F.col(self.roles.match).alias("__m"), F.col(self.roles.team).alias(self.opponent))
        pairs = sides.join(other, (F.col(self.roles.match) == F.col("__m")) & (F.col(self.roles.team) != F.col(self.opponent))).drop("__m")
        return df.join(pairs, [self.roles.match, self.roles.team], "left")

    @property
    def features_out(self) -> list[str]:
        return [f"{self.prefix}_{f}{self.size}" for f in self.features]

    @property
    def inner(self) -> Generator:
        keys = list(dict.fromkeys((self.opponent, *self.granularity)))
        return _Against(self.features, keys, self.roles, size=self.size, min_periods=self.min_periods, prefix=self.prefix, group_to=(self.roles.batch, *keys), unique=("__no_row_is_a_group",))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.inner.transform(self.with_opponent(df))

    def fit(self, df: DataFrame) -> tuple[DataFrame, FittedAgainst]:
        rows, fitted = self.inner.fit(self.with_opponent(df))
        return rows, FittedAgainst(self, fitted)


@dataclass(frozen=True)
class FittedAgainst:
    """Rows of later matches bring their opponents with them, or both sides of a match are there."""

    generator: AgainstOpponent
    fitted: Fitted

    @property
    def state(self) -> DataFrame:
        return self.fitted.state

    def update(self, df: DataFrame) -> tuple[DataFrame, FittedAgainst]:
        rows, after = self.fitted.update(self.generator.with_opponent(df))
        return rows, replace(self, fitted=after)

    def project(self, df: DataFrame) -> DataFrame:
        return self.fitted.project(self.generator.with_opponent(df))


@dataclass(frozen=True)
class FeatureChain:
    """Generators in a row, with checks of their names, and an optional reduction to teams."""

    generators: tuple
    roles: Roles
    to_team: bool = False
    names: list[str] = field(default_factory=list, compare=False)

    def features_out(self) -> list[str]:
        out = [c for g in self.generators for c in g.features_out]
        if len(out) != len(set(out)):
            raise ValueError("two generators give the same feature")
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.features_out()
        for g in self.generators:
            df = g.transform(df)
            if missing := set(g.features_out) - set(df.columns):
                raise ValueError(f"features not made: {sorted(missing)}")
        return self.team_rows(df, out) if self.to_team else df

    def fit(self, df: DataFrame) -> tuple[DataFrame, FittedChain]:
        out, fitted = self.features_out(), []
        for g in self.generators:
            df, one = g.fit(df)
            fitted.append(one)
        return (self.team_rows(df, out) if self.to_team else df), FittedChain(self, tuple(fitted))

    def team_rows(self, df: DataFrame, features: list[str], historical: bool = True) -> DataFrame:
        """One row a (match, team): weighted means of the features, plain ones without weights."""
        r = self.roles
        keys = [c for c in dict.fromkeys((r.match, r.team, r.date, r.batch))]
        order = (r.weight, r.projected_weight) if historical else (r.projected_weight, r.weight)
        weights = [F.col(c) for c in order if c and c in df.columns]
        if not weights:
            return df.groupBy(*keys).agg(*[F.avg(f).alias(f) for f in features])
        df = df.withColumn("__w", F.coalesce(*weights))
        w = F.col("__w")

        def mean(f):
            c = F.col(f)
            total = F.sum(F.when(c.isNotNull(), w))
            return F.when(total > 0, F.sum(c * w) / total).otherwise(F.avg(c)).alias(f)

        return df.groupBy(*keys).agg(*[mean(f) for f in features])


@dataclass(frozen=True)
class FittedChain:
    """A chain whose generators are fitted; a later generator sees the features of the earlier ones."""

    chain: FeatureChain
    fitted: tuple

    def update(self, df: DataFrame) -> tuple[DataFrame, FittedChain]:
        after = []
        for f in self.fitted:
            df, one = f.update(df)
            after.append(one)
        rows = self.chain.team_rows(df, self.chain.features_out(), historical=False) if self.chain.to_team else df
        return rows, replace(self, fitted=tuple(after))

    def project(self, df: DataFrame) -> DataFrame:
        for f in self.fitted:
            df = f.project(df)
        return self.chain.team_rows(df, self.chain.features_out(), historical=False) if self.chain.to_team else df
