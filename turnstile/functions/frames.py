"""Small expressions used everywhere."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is null, never NaN: applied once, where data comes in."""
    cols = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def finite(c: Column) -> Column:
    """The value where it is a finite number, else null."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds a value; null stays null."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def day_number(c: Column) -> Column:
    """Days since 1999-12-31; dates, timestamps and ISO-like strings, 1 where it can't be read."""
    s = c.cast("string")
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    parsed = F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in forms], F.to_date(F.try_to_timestamp(s)))
    return F.coalesce(F.datediff(parsed, F.lit("2000-01-01").cast("date")) + 1, F.lit(1))


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def interpolate(c: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation on ascending knots, flat outside; knots are a bounded literal."""
    x = F.lit([float(v) for v in xs]).cast("array<double>")
    y = F.lit([float(v) for v in ys]).cast("array<double>")
    # The rightmost knot not above the value, by halving the steps.
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, (len(xs) - 1).bit_length()) - 1, -1, -1)])
    below = lambda k: F.element_at(x, F.least(k, F.lit(len(xs)))) <= c
    at = F.aggregate(steps, F.lit(1), lambda k, jump: F.when((k + jump <= len(xs)) & below(k + jump), k + jump).otherwise(k))
    nxt = F.least(at + 1, F.lit(len(xs)))
    x0, x1, y0, y1 = F.element_at(x, at), F.element_at(x, nxt), F.element_at(y, at), F.element_at(y, nxt)
    inside = F.when(x1 > x0, y0 + (y1 - y0) * (c - x0) / (x1 - x0)).otherwise(y0)
    return F.when(c.isNull(), F.lit(None)).when(c <= float(xs[0]), F.lit(float(ys[0]))).when(c >= float(xs[-1]), F.lit(float(ys[-1]))).otherwise(inside)


@contextmanager
def kept(df: DataFrame, anew: bool = False) -> Iterator[DataFrame]:
    """``df``, held in memory or on disk inside the block; unless ``anew`` not where its rows come from held ones anyhow."""
    above, held, _ = df._jdf.queryExecution().withCachedData().toString().partition("InMemoryRelation")
    if held and not anew and not re.search("Aggregate|Join|Window|Sort|Union|Repartition|Generate", above):
        yield df
        return
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def place(xs: Column, most: int, below) -> Column:
    """How many of the first values of an ascending array (of at most ``most``) are ``below``, by halving the steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, most.bit_length()) - 1, -1, -1)])
    test = lambda k: (k <= F.size(xs)) & below(F.element_at(xs, F.least(k, F.size(xs))))
    return F.aggregate(steps, F.lit(0), lambda k, jump: F.when(test(k + jump), k + jump).otherwise(k))
