"""What a task holds, and how often inputs are read, as tables grow."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstile.config import Roles
from turnstile.functions.frames import place
from turnstile.operators import distributions as dist
from turnstile.operators import estimators as est
from turnstile.operators import scaling
from turnstile.sources import inputs


def explained(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_squads_are_dealt_by_rows(spark, sf, monkeypatch):
    """More rows, more tasks; suppliers don't deal the lines out once more."""
    whole = sorted(map(tuple, inputs.squad_matches(spark, sf).collect()))
    monkeypatch.setattr(inputs, "TASK_ROWS", 100)
    df = inputs.squad_matches(spark, sf)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    plan = explained(df)
    assert f"{-(-lines // 100)}), REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning(l_suppkey") == 0
    assert sorted(map(tuple, df.collect())) == whole


def test_halved_steps_find_places(spark):
    xs = [1.0, 2.0, 2.0, 5.0, 9.0]
    df = spark.createDataFrame([(float(v),) for v in range(-1, 12)], "v double").withColumn("xs", F.lit(xs).cast("array<double>"))
    for r in df.withColumns({"upto": place(F.col("xs"), 5, lambda c: c <= F.col("v")), "below": place(F.col("xs"), 300, lambda c: c < F.col("v"))}).collect():
        assert (r["upto"], r["below"]) == (sum(x <= r["v"] for x in xs), sum(x < r["v"] for x in xs))
    assert df.select(place(F.array().cast("array<double>"), 5, lambda c: c < F.col("v")).alias("n")).distinct().collect() == [(0,)]


def passes(spark, make) -> int:
    """How often the rows below are computed, one at a time, while ``make`` works on them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    df = spark.range(0, 200, 1, 2).select(F.col("id").alias("id"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"), F.concat(F.lit("w"), F.col("id") % 2).alias("word"))
    make(df.withColumn("x", counted.asNondeterministic()("x")))
    return seen.value / 200


def test_training_rows_are_made_once(spark):
    m = est.Model("logistic", "y", features=("x", "word"))
    two = est.Model("linear", "y", features=("x",))
    assert passes(spark, m.fit) <= 1
    assert passes(spark, est.Ordinal(m).fit) <= 1
    assert passes(spark, est.ByValue(two, "word").fit) <= 1
    assert passes(spark, lambda d: est.Conditional(m, "gate").fit(d.withColumn("gate", F.col("id") % 2 * 2.0))) <= 1
    grouped = est.Model("linear", "t", features=("x",), granularity=("y",))
    assert passes(spark, lambda d: grouped.fit(d.withColumn("t", F.col("y") * 2))) <= 1


def test_folds_are_made_once(spark):
    roles = Roles(match="id", team="id", date="d")
    dated = lambda d: d.withColumn("d", F.timestamp_seconds(F.col("id") * 50_000))
    m = est.Model("linear", "y", features=("x",))

    def trials(d):
        folds = est.MatchKFold(roles, n_splits=2).prepared(dated(d))
        for _ in range(3):
            assert folds.predictions(m).count() == 100
        folds.release()

    assert passes(spark, trials) <= 2  # numbering the matches reads them, too


def test_scaled_steps_are_made_once(spark):
    steps = scaling.Performance(["x"], zeros=0.5, prefix="")
    assert passes(spark, steps.fit) <= 2  # zeros are counted first


def test_student_t_of_many_rows(spark):
    rows = [(k % 97 / 10 - 2, 0.1 + k % 31 / 5) for k in range(3000)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "m double, s double").coalesce(1).withColumn("p", dist.student_t(F.col("m"), F.col("s"), 4.5, 0, 6))
    began = time.process_time()
    got = df.collect()
    for r in got[::97]:
        p = [b - a for a, b in zip(*(lambda c: (c, c[1:]))([dist.student_cdf((k - 0.5 - r["m"]) / r["s"], 4.5) for k in range(8)]))]
        assert r["p"] == pytest.approx([x / sum(p) for x in p], abs=1e-12)
    assert got[-1]["p"] == pytest.approx([1 / 7] * 7) and time.process_time() - began < 30
    x = np.random.default_rng(1).normal(0, 3, 300_000)
    began = time.process_time()
    dist.incomplete_betas(2.25, 0.5, 4.5 / (4.5 + x * x))
    assert time.process_time() - began < 3  # one at a time they take several times as long
