"""Exact quantiles (linear between neighbours) that no single task has to hold a column for.

Up to ``ROWS`` rows one aggregation is enough. Beyond, the distinct values are counted, dealt
to ranges by approximate cut points, cumulated inside the ranges, and looked up by rank: the
cut points only steer the dealing, so the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import kept, place

ROWS = 1_000_000
RANGES = 256


def percentiles(df: DataFrame, column: Column, at: list[float], by: list[str] = (), rows: int = ROWS) -> dict[tuple, list[float]]:
    """The quantiles ``at`` of the values of ``column`` that aren't null, by group: one list a group comes to the driver."""
    by = list(by)
    x = df.select(*by, column.cast("double").alias("__x")).where("__x IS NOT NULL")
    if x.count() <= rows:
        agg = F.percentile("__x", F.lit([float(q) for q in at]).cast("array<double>")).alias("__q")
        got = (x.groupBy(*by).agg(agg) if by else x.agg(agg)).collect()
        return {tuple(r[c] for c in by): r["__q"] for r in got if r["__q"] is not None}
    steps = F.lit([k / RANGES for k in range(1, RANGES)]).cast("array<double>")
    cuts = x.groupBy(*by).agg(F.array_distinct(F.percentile_approx("__x", steps, 10 * RANGES)).alias("__cuts"), F.count("*").alias("__n"))
    spot = F.transform(F.lit([float(q) for q in at]).cast("array<double>"), lambda q: q * (F.col("__n") - 1))
    cuts = cuts.withColumn("__ranks", F.array_sort(F.array_distinct(F.concat(F.transform(spot, lambda h: F.floor(h)), F.transform(spot, lambda h: F.ceil(h))))))
    out: dict[tuple, tuple[int, dict[int, float]]] = {}
    with kept(cuts, anew=True) as cuts:  # a row a group
        for r in _ranked(x, by, cuts, 2 * len(at)).collect():  # two rows a quantile and group
            out.setdefault(tuple(r[c] for c in by), (r["__n"], {}))[1][r["__rank"]] = r["__x"]

    def value(n: int, known: dict[int, float], q: float) -> float:
        h = q * (n - 1)
        lo = int(h)
        hi = lo if h == lo else lo + 1
        return known[lo] + (known[hi] - known[lo]) * (h - lo)

    return {key: [value(n, known, float(q)) for q in at] for key, (n, known) in out.items()}


def _ranked(x: DataFrame, by: list[str], cuts: DataFrame, most: int) -> DataFrame:
    """The values at the ranks of ``cuts`` (at most ``most`` a group)."""
    beside = lambda d, c: d.join(F.broadcast(c), by) if by else d.crossJoin(F.broadcast(c))
    held = beside(x.groupBy(*by, "__x").agg(F.count("*").alias("__c")), cuts.select(*by, "__cuts"))
    held = held.withColumn("__b", place(F.col("__cuts"), RANGES, lambda c: c <= F.col("__x"))).drop("__cuts")
    sums = held.groupBy(*by, "__b").agg(F.sum("__c").alias("__s"))  # at most RANGES rows a group
    base = F.coalesce(F.sum("__s").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.join(F.broadcast(sums.select(*by, "__b", base.alias("__base"))), [*by, "__b"])
    upto = F.col("__base") + F.sum("__c").over(Window.partitionBy(*by, "__b").orderBy("__x"))
    held = beside(held.withColumn("__upto", upto), cuts.select(*by, "__n", "__ranks"))
    # A value has the ranks from those before it up to those with it.
    first, last = (place(F.col("__ranks"), most, lambda r, to=to: r < to) for to in (F.col("__upto") - F.col("__c"), F.col("__upto")))
    held = held.withColumns({"__from": first, "__to": last}).where("__to > __from")
    return held.select(*by, "__n", "__x", F.explode(F.slice("__ranks", F.col("__from") + 1, F.col("__to") - F.col("__from"))).alias("__rank"))
