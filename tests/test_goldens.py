"""Hand-computed results on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnstile.config import GameRoles, Roles
from turnstile.operators import estimators, ratings, scaling, scoring, shaping
from turnstile.operators.windows import FeatureChain, Lag, Rolling, RollingBinary, RollingDays


def day(k):
    return dt.datetime(2023, 1, 1) + dt.timedelta(days=k)


def values(df, column, keys):
    return [None if r[column] is None else round(r[column], 9) for r in df.orderBy(*keys).collect()]


TEAM = Roles(match="game", team="team", date="start_date")
PLAYER = Roles(match="game", team="team", date="start_date", player="player", weight="participation_weight")


def test_rolling_mean_with_opponents(spark):
    data = [(1, 1.0, day(0), 1), (1, 2.0, day(0), 2), (2, 3.0, day(1), 1), (2, 2.0, day(1), 3), (3, 4.0, day(2), 1), (3, 5.0, day(2), 2)]
    df = spark.createDataFrame(data, "game int, points double, start_date timestamp, team int")
    g = Rolling("points", ("team",), TEAM, size=3, add_opponent=True)
    got = g.transform(df)
    assert values(got, "rolling_mean_points3", ("game", "team")) == [None, None, 1.0, None, 2.0, 2.0]
    assert values(got, "rolling_mean_points3_opponent", ("game", "team")) == [None, None, None, 1.0, 2.0, 2.0]


def test_weights_of_missing_values_count(spark):
    data = [("a", 1, 1.0, day(0), 1, 1.0), ("a", 2, None, day(1), 1, 0.5), ("a", 3, 3.0, day(2), 1, 0.5), ("a", 4, 9.0, day(3), 1, 1.0)]
    df = spark.createDataFrame(data, "player string, game int, points double, start_date timestamp, team int, participation_weight double")
    got = Rolling("points", ("player",), PLAYER, size=2, weight="participation_weight").transform(df)
    assert values(got, "rolling_mean_points2", ("game",)) == [None, 1.0, round(1.0 / 1.5, 9), round(1.5 / 1.0, 9)]


def test_lag_of_grouped_rows(spark):
    data = [(p, t, g, x, day(g)) for g, t, p, x in [(1, 1, "a", 1.0), (1, 1, "b", 2.0), (1, 2, "c", 3.0), (1, 2, "d", 2.0), (2, 1, "a", 4.0), (2, 1, "b", 5.0), (2, 2, "c", 6.0), (2, 2, "d", 7.0)]]
    df = spark.createDataFrame(data, "player string, team int, game int, points double, start_date timestamp")
    got = Lag("points", ("team",), Roles("game", "team", "start_date", "player"), length=1).transform(df)
    assert values(got, "lag_points1", ("game", "player")) == [None, None, None, None, 1.5, 1.5, 2.5, 2.5]


def test_day_windows(spark):
    data = [("a", 1, 1.0, day(0)), ("a", 2, 2.0, day(0)), ("a", 3, None, day(1)), ("a", 4, 4.0, day(3)), ("a", 5, 5.0, day(9))]
    df = spark.createDataFrame(data, "player string, game int, points double, start_date timestamp").withColumn("team", F.lit(1))
    got = RollingDays("points", ("player",), Roles("game", "team", "start_date", "player"), days=2, add_count=True).transform(df)
    assert values(got, "rolling_mean_days_points2", ("game",)) == [None, None, 1.5, 0.0, None]
    assert values(got, "rolling_mean_days_count2", ("game",)) == [0, 0, 2, 1, 0]


def test_outcomes_and_names(spark):
    data = [("a", k, float(k), day(k), k % 2) for k in range(6)]
    df = spark.createDataFrame(data, "player string, game int, points double, start_date timestamp, won int").withColumn("team", F.lit(1))
    g = RollingBinary("points", ("player",), Roles("game", "team", "start_date", "player"), size=4, flag="won")
    assert values(g.transform(df), "rolling_mean_binary_points4_1", ("game",)) == [None, None, 1.0, 1.0, 2.0, 2.0]
    with pytest.raises(ValueError):
        FeatureChain((g, g), Roles("game", "team", "start_date", "player")).transform(df)


def test_no_leakage_and_batches(spark):
    """A later value never changes an earlier feature, and a batch shares its values."""
    data = [("a", k, float(k * k % 7), day(k), k // 3) for k in range(12)]
    roles = Roles("game", "team", "start_date", "player", update="series")
    df = spark.createDataFrame(data, "player string, game int, points double, start_date timestamp, series int").withColumn("team", F.lit(1))
    g = Rolling("points", ("player",), roles, size=3)
    one = values(g.transform(df), g.features_out[0], ("game",))
    two = values(g.transform(df.withColumn("points", F.when(F.col("game") >= 9, 1000.0).otherwise(F.col("points")))), g.features_out[0], ("game",))
    assert one[:10] == two[:10] and all(len(set(one[k : k + 3])) == 1 for k in (3, 6, 9))


def test_state_life_cycle(spark):
    data = [("a", k, float(k), day(k)) for k in range(8)] + [("b", 100 + k, float(k * 2), day(k)) for k in range(8)]
    roles = Roles("game", "team", "start_date", "player")
    df = spark.createDataFrame(data, "player string, game int, points double, start_date timestamp").withColumn("team", F.lit(1))
    g = Rolling("points", ("player",), roles, size=3)
    whole = {r["game"]: r["rolling_mean_points3"] for r in g.transform(df).collect()}
    early = df.where(F.col("start_date") < F.lit(day(5)))
    _, fitted = g.fit(early)
    rows, after = fitted.update(df.where(F.col("start_date") >= F.lit(day(5))))
    assert {r["game"]: r["rolling_mean_points3"] for r in rows.collect()} == {k: v for k, v in whole.items() if k % 100 >= 5}
    future = spark.createDataFrame([("a", 999), ("z", 998)], "player string, game int").withColumns({"team": F.lit(1), "start_date": F.lit(day(20))})
    got = {r["player"]: r["rolling_mean_points3"] for r in after.project(future).collect()}
    assert got == {"a": 6.0, "z": None} and after.state.count() == 6


def test_player_ratings(spark):
    """Changes of a first match: multiplier 50 * (17/14) * 0.9 + 5, expected performance one half."""
    roles = Roles(match="mid", team="tid", date="dt", player="pid", weight="pw")
    data = [("P1", "T1", "M1", "2024-01-01", 0.6, 1.0), ("P2", "T1", "M1", "2024-01-01", 0.4, 1.0), ("P3", "T2", "M1", "2024-01-01", 0.7, 1.0), ("P4", "T2", "M1", "2024-01-01", 0.3, 1.0)]
    df = spark.createDataFrame(data, "pid string, tid string, mid string, dt string, perf double, pw double")
    folded = ratings.player_ratings(df, roles, "perf")
    m = 50 * (17 / 14) * 0.9 + 5
    got = {r["player"]: (r["player_off_rating"], r["player_def_rating"]) for r in folded.where("kind = 'state'").collect()}
    for p, change in (("P1", 0.1), ("P2", -0.1), ("P3", 0.2), ("P4", -0.2)):
        assert got[p][0] == pytest.approx(1000 + change * m) and got[p][1] == pytest.approx(1000.0)
    rows = ratings.player_features(df, folded, roles).collect()
    assert {r["player_off_rating"] for r in rows} == {1000.0} and {r["team_rating_difference_projected"] for r in rows} == {0.0}


def test_team_ratings_are_batched(spark):
    roles = Roles(match="m", team="t", date="d", update="batch")
    data = [(k, b, t, day(b), p) for k, b, x, y in [(1, 1, "a", "b"), (2, 1, "a", "c"), (3, 2, "a", "b")] for t, p in ((x, 1.0), (y, 0.0))]
    df = spark.createDataFrame(data, "m int, batch int, t string, d timestamp, won double")
    folded = ratings.team_fold(ratings.team_matches(df, roles, "won"), ratings.RatingConfig())
    off = {(r["match"], r["team"]): r["team_off_rating_projected"] for r in folded.where("kind = 'match'").collect()}
    assert off[2, "a"] == 1000.0 and off[3, "a"] > 1040 and off[3, "b"] < 1000
    with pytest.raises(TypeError):
        ratings.RatingConfig(rating_change_multiplier=30)
    with pytest.raises(ValueError):
        ratings.validate_performance(df, "m")


def test_ordinal_loss(spark):
    data = [([0.1, 0.6, 0.3], 1), ([0.5, 0.3, 0.2], 0), ([0.2, 0.3, 0.5], 2)]
    df = spark.createDataFrame(data, "p array<double>, y int")
    import math

    low = [0.1, 0.5, 0.2]
    mid = [0.7, 0.8, 0.5]
    one = -sum(math.log(p) if y < 1 else math.log(1 - p) for p, (_, y) in zip(low, data)) / 3
    two = -sum(math.log(p) if y < 2 else math.log(1 - p) for p, (_, y) in zip(mid, data)) / 3
    assert scoring.OrdinalLoss("p", "y", classes=[0, 1, 2]).value(df) == pytest.approx(0.5 * one + 0.5 * two)
    with pytest.raises(ValueError):
        scoring.OrdinalLoss("p", "y", classes=[0, 2]).value(df)


def test_small_transformers(spark):
    df = spark.createDataFrame([(1, 10, 10), (1, 10, 20), (2, 20, 30), (2, 20, 40)], "game int, team int, minutes int")
    assert values(shaping.aggregate_over(df, "minutes", ["game"], "sum", "s"), "s", ("game", "minutes")) == [30, 30, 70, 70]
    wide = spark.createDataFrame([(1, day(0), "a", "b", 3, 1)], "match_id int, start_date timestamp, home string, away string, hs int, as int")
    long = shaping.wide_to_long(wide, GameRoles("match_id", "start_date", "home", "away", {"score": ("hs", "as")}))
    assert sorted((r["team_id"], r["score"], r["opponent_score"]) for r in long.collect()) == [("a", 3, 1), ("b", 1, 3)]
    with pytest.raises(ValueError):
        GameRoles("m", "d", "a", "b", {})
    with pytest.raises(ValueError):
        shaping.Filter("a", 1, "~")
    same = spark.createDataFrame([(1, 1.0), (1, 2.0)], "g int, y double")
    with pytest.raises(Exception, match="target varies"):
        shaping.constant_target(same, ["g"], "y").collect()


def test_buckets_and_weights(spark):
    assert estimators.frequency_buckets({0: 0.5, 1: 0.001, 2: 0.001, 3: 0.0015, 4: 0.4965}, 0.003) == [[0], [1, 2, 3], [4]]
    assert estimators.frequency_buckets({0: 0.6, 1: 0.1, 2: 0.3}, 0.2) == [[0], [1], [2]]
    df = spark.createDataFrame([(1.0, None), (0.2, 0.4)], "a double, b double")
    got = scaling.weighted_mix(df, [scaling.ColumnWeight("a", 0.6), scaling.ColumnWeight("b", 0.4, True)])
    assert values(got, "weighted_performance", ("b",)) == [1.0, round(0.2 * 0.6 + 0.6 * 0.4, 9)]


def test_weighted_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x, w = rng.normal(size=400).round(3), rng.uniform(0.1, 2, 400).round(3)
    df = spark.createDataFrame(list(zip(x.tolist(), w.tolist())), "x double, w double")
    q = scaling.Quantile(["x"], n=50, weight="w").fit(df).params["x"][1]
    order = np.argsort(x, kind="stable")
    xs, idx = np.unique(x[order], return_inverse=True)
    cdf = np.cumsum(np.bincount(idx, w[order])) / w.sum()
    assert q == pytest.approx(np.interp(np.linspace(0, 1, 51), cdf, xs).tolist(), abs=1e-9)


def test_streamed_features(spark, tmp_path):
    from turnstile.streaming.micro_batches import StreamedFeatures

    roles = Roles("game", "team", "start_date", "player")
    data = [("a", k, float(k), day(k), 1) for k in range(6)]
    df = spark.createDataFrame(data, "player string, game int, points double, start_date timestamp, team int")
    g = Rolling("points", ("player",), roles, size=3)
    s = StreamedFeatures(g, str(tmp_path))
    s.process(df.where("game < 3"), 0)
    s.process(df.where("game >= 3"), 1)
    s.process(df.where("game >= 3"), 1)  # run again after a failure
    got = {r["game"]: r["rolling_mean_points3"] for r in spark.read.parquet(f"{tmp_path}/features").collect()}
    assert got == {r["game"]: r["rolling_mean_points3"] for r in g.transform(df).collect()}


def test_missing_targets_are_filled(spark):
    data = [(float(k), 2.0 * k + 1 if k % 3 else None) for k in range(12)] + [(20.0, float("nan"))]
    df = spark.createDataFrame(data, "a double, target double")
    got = estimators.Imputed(estimators.Model("linear", "target", features=("a",))).fit(df).transform(df)
    assert {r["a"]: pytest.approx(r["target"], abs=1e-3) for r in got.collect()} == {**{float(k): 2.0 * k + 1 for k in range(12)}, 20.0: 41.0}
    assert got.columns == df.columns


def test_exact_quantiles_in_ranges(spark):
    from turnstile.operators.quantiles import percentiles

    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 1013 / 7.0).alias("x"))
    at = [0.0, 0.02, 0.25, 0.5, 0.77, 0.999, 1.0]
    for by in ([], ["g"]):
        one, many = percentiles(df, F.col("x"), at, by), percentiles(df, F.col("x"), at, by, rows=0)
        assert one.keys() == many.keys() and all(many[k] == pytest.approx(one[k], abs=1e-12) for k in one)
    assert percentiles(df.limit(0), F.col("x"), at) == {} == percentiles(df.limit(0), F.col("x"), at, rows=-1)


def test_checks_of_rows(spark):
    from turnstile.operators.windows import checked_order, checked_unique, known_matches

    data = [(1, day(0), "a", 1), (1, day(0), "b", 2), (2, day(1), "a", 3)]
    df = spark.createDataFrame(data, "game int, start_date timestamp, team string, k int")
    assert checked_unique(df, ["game", "team"]).count() == 3 and checked_order(df, TEAM, "k").count() == 3
    for bad in (checked_unique(df, ["game"]), checked_order(df.withColumn("k", -F.col("k")), TEAM, "k")):
        with pytest.raises(Exception, match="unique|order"):
            bad.collect()
    old, new = known_matches(df, df.where("game = 1"), TEAM)
    assert (old.count(), new.count()) == (2, 1)


def test_references_are_calibrated(spark):
    roles = Roles(match="mid", team="tid", date="dt", player="pid", weight="pw")
    data = [(f"P{2 * t + i}", f"T{t}", f"M{m}", day(m), 0.5 + 0.1 * t - 0.05 * i, 1.0) for m in range(6) for t in (0, 1) for i in (0, 1)]
    df = spark.createDataFrame(data, "pid string, tid string, mid string, dt timestamp, perf double, pw double")
    config = ratings.RatingConfig(predictor="ignore_opponent")
    folded, found = ratings.calibrated_player_ratings(df, roles, "perf", config)
    first = ratings.player_ratings(df, roles, "perf", config).where("kind = 'match'")
    mean = first.agg(F.avg(1 / (1 + F.exp(-F.lit(config.slope) * (F.col("player_off_rating") - found.reference))))).first()[0]
    assert mean == pytest.approx(0.5, abs=1e-6) and folded.where("kind = 'match'").count() == 24
    with pytest.raises(ValueError):
        ratings.calibrated_reference(first.limit(0), "player_off_rating", 0.01)
    with pytest.raises(Exception, match="exactly two teams"):
        ratings.player_ratings(df.where("tid = 'T0'"), roles, "perf").collect()
    assert scoring.MeanAbsoluteError("p", "y", granularity=["league"]).name == "mean_absolute_error_y_by_league"
