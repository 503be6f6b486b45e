"""Row-level reshaping: filters, arithmetic, normalising, reducing, wide to long."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import GameRoles, Roles

OPERATORS = {
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "in": lambda c, v: c.isin(*v), "not in": lambda c, v: ~c.isin(*v),
}


@dataclass(frozen=True)
class Filter:
    """``column operator value``; null never passes."""

    column: str
    value: Any
    operator: str

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}")

    def condition(self, schema: T.StructType) -> Column:
        c, v = F.col(self.column), self.value
        if isinstance(schema[self.column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            cast = lambda x: F.lit(x).cast(schema[self.column].dataType) if isinstance(x, str) else F.lit(x)
            v = [cast(x) for x in v] if isinstance(v, (list, tuple, set)) else cast(v)
        elif isinstance(v, (set, tuple)):
            v = list(v)
        return c.isNotNull() & OPERATORS[self.operator](c, v)


def apply_filters(df: DataFrame, filters: list[Filter] | None) -> DataFrame:
    """Rows that pass all filters."""
    return reduce(lambda d, f: d.where(f.condition(df.schema)), filters or [], df)


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is neither null nor NaN."""
    c = F.col(target)
    number = isinstance(df.schema[target].dataType, (T.DoubleType, T.FloatType))
    return df.where(c.isNotNull() & ~F.isnan(c) if number else c.isNotNull())


ARITHMETIC = {"subtract": ("minus", lambda a, b: a - b), "multiply": ("times", lambda a, b: a * b), "divide": ("divided_by", lambda a, b: a / b), "add": ("plus", lambda a, b: a + b)}


def arithmetic(df: DataFrame, a: str, b: str, operation: str, alias: str | None = None, drop: bool = False) -> DataFrame:
    """``a operation b`` as a new column, named after both unless ``alias`` is given."""
    if missing := {a, b} - set(df.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    word, f = ARITHMETIC[operation]
    out = df.withColumn(alias or f"{a}_{word}_{b}", f(F.col(a), F.col(b)))
    return out.drop(a, b) if drop else out


def normalise_to(df: DataFrame, column: str, granularity: list[str], total: float) -> DataFrame:
    """Scales a column so that it adds up to ``total`` in each group."""
    w = Window.partitionBy(*granularity)
    return df.withColumn(column, F.col(column) / F.sum(column).over(w) * F.lit(float(total)))


def aggregate_over(df: DataFrame, column: str, granularity: list[str], how: str, alias: str) -> DataFrame:
    """A group's sum or mean on each of its rows; without granularity that of the whole table."""
    agg = {"sum": F.sum, "mean": F.avg}[how](column)
    if granularity:
        return df.withColumn(alias, agg.over(Window.partitionBy(*granularity)))
    return df.crossJoin(F.broadcast(df.agg(agg.alias(alias))))  # one row


def reduce_groups(df: DataFrame, granularity: list[str], weight: str | None = None, order: list[str] = (), columns: list[str] | None = None, more: list[Column] = ()) -> DataFrame:
    """One row a group: weighted (or plain) means of numbers, the sum of the weight, and of
    other columns the first value by ``order``. ``columns``: of these only; ``more``: further aggregates."""
    aggs = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in granularity or columns is not None and f.name not in columns:
            continue
        if f.name == weight:
            aggs.append(F.sum(c).alias(f.name))
        elif isinstance(f.dataType, T.NumericType):
            mean = F.avg(c)
            if weight:
                w = F.col(weight)
                total = F.sum(F.when(c.isNotNull(), w))
                mean = F.when(F.coalesce(total, F.lit(0)) != 0, F.sum(c * w) / total).otherwise(mean)
            aggs.append(mean.alias(f.name))
        else:
            key = F.struct(*(order or [f.name]))
            aggs.append(F.min_by(c, key).alias(f.name))
    return df.groupBy(*granularity).agg(*aggs, *more)


def constant_target(df: DataFrame, granularity: list[str], target: str, weight: str | None = None) -> DataFrame:
    """The target of each group; a group with two targets raises when the plan runs."""
    return df.groupBy(*granularity).agg(*target_of(target, weight))


def target_of(target: str, weight: str | None = None) -> list[Column]:
    """Aggregates: the one target of a group, and the sum of its weights."""
    one = F.when(F.min(target) == F.max(target), F.min(target)).otherwise(F.raise_error(F.lit("target varies within a group")))
    return [one.alias(target), *([F.sum(weight).alias(weight)] if weight else [])]


def wide_to_long(df: DataFrame, roles: GameRoles, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each side of a match, with each performance and the opponent's."""

    def side(own: int) -> Column:
        team, other = (roles.team1, roles.team2) if own == 0 else (roles.team2, roles.team1)
        cols = [F.col(team).alias("team_id"), F.col(other).alias("opponent_id")]
        for out, pair in roles.pairs.items():
            cols += [F.col(pair[own]).alias(out), F.col(pair[1 - own]).alias(f"opponent_{out}")]
        return F.struct(*cols)

    return df.select(roles.match, roles.date, *carry, F.inline(F.array(side(0), side(1))))


def match_number(df: DataFrame, roles: Roles, alias: str = "match_number") -> DataFrame:
    """Matches numbered from 0 by (date, match).

    Only the distinct matches are ordered: they are numbered within their day, days are
    offset by the running count of matches, and rows look the number up.
    """
    first = df.groupBy(roles.match).agg(F.min(roles.date).alias("__d")).withColumn("__day", F.to_date("__d"))
    per_day = first.groupBy("__day").agg(F.count("*").alias("__n"))  # one row a day
    offset = per_day.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("__day").orderBy("__d", roles.match)
    numbers = first.withColumn("__k", F.row_number().over(inside) - 1).join(offset, first["__day"].eqNullSafe(offset["__day"]))
    return df.join(numbers.select(roles.match, (F.col("__before") + F.col("__k")).alias(alias)), roles.match)


def league_by_history(df: DataFrame, roles: Roles, matches_back: int = 25, alias: str = "game_league") -> DataFrame:
    """The most frequent league of a player's previous matches, the latest one on ties; null at first."""
    w = Window.partitionBy(roles.player).orderBy(roles.date, roles.match).rowsBetween(-matches_back, -1)
    past = F.collect_list(F.struct(F.col(roles.league).alias("l"))).over(w)
    df = df.withColumn("__past", F.transform(past, lambda x: x["l"]))
    distinct = F.array_distinct("__past")
    ranked = F.transform(distinct, lambda l: F.struct(F.size(F.filter("__past", lambda x: x == l)).alias("n"), (F.size("__past") - F.array_position(F.reverse("__past"), l)).alias("at"), l.alias("l")))
    return df.withColumn(alias, F.array_max(ranked)["l"]).drop("__past")
