"""The folds of ratings: what is kept between matches gives the values that recounting everything gives."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from turnstile.config import Roles
from turnstile.operators import ratings

ROLES = Roles(match="m", team="t", date="d", player="p", weight="w", league="l")


def quantile(xs, q):
    xs, at = sorted(xs), q * (len(xs) - 1)
    return xs[int(at)] + (xs[min(int(at) + 1, len(xs) - 1)] - xs[int(at)]) * (at - int(at))


def test_start_ratings_are_quantiles_of_recent_players():
    rng, starts, known = random.Random(1), ratings.Starts(ratings.StartRating(least_count=5, max_days=20)), {}
    for step in range(4000):
        day = step // 20 if step % 500 < 490 else step // 20 - 15  # days go back now and then
        player, league = rng.randrange(300), rng.choice("ab")
        known[player] = (league, day, round(rng.gauss(1000, 50), rng.choice((0, 6))))
        starts.learn(player, *known[player])
        if rng.random() < 0.3:
            recent = [r for of, d, r in known.values() if of == league and day - d <= 20]
            assert starts.value(league, day) == (quantile(recent, 0.2) if len(recent) >= 5 else 1000.0)


def test_new_players_cost_the_same_among_many():
    starts, rng, began = ratings.Starts(ratings.StartRating()), random.Random(2), time.process_time()
    for k in range(30_000):
        at = starts.value("a", 7)
        starts.learn(k, "a", 7, at + rng.random())
    assert time.process_time() - began < 15  # sorting all players for each takes minutes


def rows(spark, n, players, adjust=False):
    rng, out = random.Random(3), []
    for m in range(n):
        a, b = rng.sample(range(players), 2), rng.sample(range(players, 2 * players), rng.choice((1, 2)))
        for side, ps in (("x", a), ("y", b)):
            out += [(m, side, p, dt.datetime(2024, 1, 1) + dt.timedelta(days=m // 4 * (3 if adjust else 1)), rng.random(), rng.choice((0.5, 1.0)), "q") for p in ps]
    return spark.createDataFrame(out, "m int, t string, p long, d timestamp, x double, w double, l string")


def test_active_players_keep_their_mean():
    """The shift of all as one number, against shifting each."""
    rng, n = random.Random(4), 60
    off, dfn, plain_off, plain_def, last = [1000.0] * n, [1000.0] * n, [1000.0] * n, [1000.0] * n, [None] * n
    level = ratings.Level(off, dfn, 1000.0, 10)
    level.live = [False] * n
    for step in range(3000):
        day = step // 7 if step % 400 < 390 else step // 7 - 12
        k, a, b = rng.randrange(n if step % 300 < 150 else 20), rng.gauss(1, 5), rng.gauss(0, 5)
        level.played(k, a, b, last[k], day)
        last[k] = day
        plain_off[k] += a
        plain_def[k] += b
        if step % 5 == 0:
            level.adjust(day, last)
            active = [p for p in range(n) if last[p] is not None and day - last[p] <= 10]
            shift = 1000.0 - sum((plain_off[p] + plain_def[p]) / 2 for p in active) / len(active)
            for p in active:
                plain_off[p] += shift
                plain_def[p] += shift
        assert off[k] + (level.by if level.live[k] else 0.0) == pytest.approx(plain_off[k], abs=1e-8)


def test_adjusting_many_players_costs_by_those_who_play():
    n = 20_000
    off, dfn, last, began = [1000.0] * n, [1000.0] * n, [None] * n, time.process_time()
    level = ratings.Level(off, dfn, 1000.0, 250)
    level.live = [False] * n
    for step in range(100_000):
        k, day = step * 7919 % n, step // 1000
        level.played(k, 0.5, -0.25, last[k], day)
        last[k] = day
        if step % 10 == 9:
            level.adjust(day, last)
    assert time.process_time() - began < 10  # 10,000 rounds over 20,000 players take a minute
    assert sum((off[k] + dfn[k]) / 2 + level.by for k in range(n)) / n == pytest.approx(1000.0)


@pytest.mark.parametrize("adjust", [False, True])
def test_matches_that_go_on_in_the_next_batch(spark, adjust):
    config = ratings.RatingConfig(predictor="mean" if adjust else "difference", mean_adjustment=adjust, adjust_every=3, active_days=9, start=ratings.StartRating(least_count=4, max_days=15))
    df, keys = rows(spark, 150, 12, adjust), ("kind", "match", "player")
    got = []
    for size in ("10000", "4"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            folded = ratings.player_ratings(df, ROLES, "x", config, extra=("l", "d"), independent=("l",))
            got.append([tuple(r) for r in folded.orderBy(*keys).collect()])
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] and len(got[0]) == df.count() + df.select("p").distinct().count()


def test_team_folds_of_trials_go_on_in_the_next_batch(spark):
    df = rows(spark, 90, 5).groupBy("m", "d", "l").agg(F.min(F.when(F.col("t") == "x", F.col("p"))).alias("a"), F.min(F.when(F.col("t") == "y", F.col("p"))).alias("b"))
    long = df.select("m", "d", "l", F.explode(F.array("a", "b")).alias("t")).withColumn("x", (F.col("t") * 37 + F.col("m") * 11) % 10 / 10)
    roles = Roles(match="m", team="t", date="d", league="l")
    configs, got = {"a": ratings.RatingConfig(), "b": ratings.RatingConfig(coef=0.01, split=False, max_predict=0.9)}, []
    for size in ("10000", "4"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            f = ratings.team_fold(ratings.with_trials(ratings.team_matches(long, roles, "x"), configs), configs, ("trial",))
            got.append([tuple(r) for r in f.orderBy("trial", "kind", "match", "team").collect()])
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] and {r[0] for r in got[0]} == {"a", "b"}
