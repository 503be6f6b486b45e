"""Registered queries of the match-analytics engine and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Roles
from ..functions.frames import day_number
from ..operators import distributions as dist
from ..operators import estimators as est
from ..operators import ratings, scaling, scoring, shaping
from ..operators.shaping import Filter
from ..operators.windows import AgainstOpponent, FeatureChain, Lag, Rolling, RollingBinary, RollingDays, first_known, known_matches
from ..sources import inputs
from ..sources.inputs import DUELS, EVENTS, GAMES, SQUADS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PLAYERS = ("user_id",)
SHIFT = 3.7e-7


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def out(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys and values to six places. Before rounding values are shifted a little, the same
    on both sides of a comparison, so that exact halves don't depend on the last bit."""
    return df.select(*keys, *[(F.round(F.col(c).cast("double") + F.lit(SHIFT), 6) + F.lit(0.0)).alias(c) for c in values])


def r6(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE) + {SHIFT:.8f}, 6) + 0.0 AS {name}"


# -- inputs in SQL ------------------------------------------------------------

HOLES = "e AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, 0.1 + (event_id % 10) / 10.0 AS w, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS won, (event_id % 10) / 10.0 AS prob FROM events)"
GAMES_SQL = """games AS (SELECT a.event_id // 2 AS match_id, a.ts AS start_date, a.user_id AS team1, b.user_id AS team2, a.value AS score1, b.value AS score2, a.event_type AS league
  FROM events a JOIN events b ON a.event_id // 2 = b.event_id // 2 AND a.event_id % 2 = 0 AND b.event_id % 2 = 1 WHERE a.user_id <> b.user_id),
duels AS (SELECT match_id, start_date, league, team1 AS team_id, team2 AS opponent_id, score1 AS score, score2 AS opponent_score FROM games
  UNION ALL SELECT match_id, start_date, league, team2, team1, score2, score1 FROM games)"""
SQUADS_SQL = """li AS (SELECT l_orderkey, l_suppkey, sum(l_quantity)::DOUBLE AS points, sum(l_quantity * l_discount)::DOUBLE AS points2, count(*) AS lines, max(l_tax)::DOUBLE AS weight FROM lineitem GROUP BY ALL),
sr AS (SELECT li.*, n_regionkey, s_nationkey FROM li JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
two AS (SELECT l_orderkey FROM sr GROUP BY 1 HAVING count(DISTINCT n_regionkey) = 2),
squads AS (SELECT sr.l_orderkey AS match_id, n_regionkey AS team_id, l_suppkey AS player_id, CAST(o_orderdate AS TIMESTAMP) AS start_date, points, points2, lines, weight, s_nationkey AS league
  FROM sr JOIN two ON sr.l_orderkey = two.l_orderkey JOIN orders ON sr.l_orderkey = o_orderkey)"""
BY = "PARTITION BY user_id ORDER BY ts, event_id"


def rolled(value: str, name: str, keys: str = "event_id, user_id", by: str = BY, source: str = "e", ctes: str = HOLES) -> str:
    """A window expression carried forward."""
    return f"WITH {ctes}, g AS (SELECT *, {value} AS x FROM {source}) SELECT {keys}, {r6(f'last_value(x IGNORE NULLS) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', name)} FROM g"


def frame(n: int, by: str = BY) -> str:
    return f"({by} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def holes(spark: SparkSession, sf: str) -> DataFrame:
    e = inputs.entity_events(spark, sf)
    return e.select(
        "event_id", "ts", "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), (F.lit(0.1) + (F.col("event_id") % 10) / 10.0).alias("w"),
        (F.col("event_id") % 3 == 0).cast("int").alias("won"), ((F.col("event_id") % 10) / 10.0).alias("prob"),
    )


def one(spark, sf, generator, keys=("event_id", "user_id")) -> DataFrame:
    return out(generator.transform(holes(spark, sf)), list(keys), generator.features_out)


# -- lags and windows -----------------------------------------------------------


@query(rolled(f"avg(v) OVER {frame(10)}", "rolling_mean_v10"))
def rolling_mean(spark, sf):
    return one(spark, sf, Rolling("v", PLAYERS, EVENTS, size=10))


@query(rolled(f"sum(v) OVER {frame(5)}", "rolling_sum_v5"))
def rolling_sum(spark, sf):
    return one(spark, sf, Rolling("v", PLAYERS, EVENTS, size=5, how="sum"))


@query(rolled(f"CASE WHEN count(v) OVER {frame(8)} >= 4 THEN var_samp(v) OVER {frame(8)} END", "rolling_var_v8"))
def rolling_var(spark, sf):
    return one(spark, sf, Rolling("v", PLAYERS, EVENTS, size=8, how="var", min_periods=4))


@query(rolled(f"CASE WHEN sum(w) OVER {frame(6)} > 0 AND count(v) OVER {frame(6)} >= 2 THEN sum(v * w) OVER {frame(6)} / sum(w) OVER {frame(6)} END", "rolling_mean_v6"))
def rolling_weighted(spark, sf):
    return one(spark, sf, Rolling("v", PLAYERS, EVENTS, size=6, weight="w", min_periods=2))


@query(f"WITH {HOLES} SELECT event_id, user_id, {', '.join(r6(f'lag(v, {k}) OVER ({BY})', f'lag_v{k}') for k in (1, 2, 3))} FROM e")
def lag_k(spark, sf):
    return one(spark, sf, Lag("v", PLAYERS, EVENTS, length=3))


@query(f"WITH {HOLES} SELECT event_id, user_id, {', '.join(r6(f'lead(v, {k}) OVER ({BY})', f'lead_v{k}') for k in (1, 2))} FROM e")
def lead_k(spark, sf):
    return one(spark, sf, Lag("v", PLAYERS, EVENTS, length=2, future=True, prefix="lead"))


_DAYS = "(PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {0} PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {HOLES} SELECT event_id, user_id, {r6(f"CASE WHEN count(*) OVER {_DAYS.format(2 * 86400000000)} >= 1 THEN coalesce(sum(v) OVER {_DAYS.format(2 * 86400000000)}, 0) / count(*) OVER {_DAYS.format(2 * 86400000000)} END", "rolling_mean_days_v2")},
  {r6(f"count(*) OVER {_DAYS.format(2 * 86400000000)}", "rolling_mean_days_count2")} FROM e""")
def rolling_days(spark, sf):
    return one(spark, sf, RollingDays("v", PLAYERS, EVENTS, days=2, add_count=True))


@query(f"""WITH {HOLES} SELECT event_id, user_id, {r6(f"CASE WHEN count(*) OVER {_DAYS.format(7 * 86400000000)} >= 3 AND sum(w) OVER {_DAYS.format(7 * 86400000000)} > 0 THEN sum(v * w) OVER {_DAYS.format(7 * 86400000000)} / sum(w) OVER {_DAYS.format(7 * 86400000000)} END", "rolling_mean_days_v7")} FROM e""")
def rolling_days_weighted(spark, sf):
    return one(spark, sf, RollingDays("v", PLAYERS, EVENTS, days=7, min_games=3, weight="w"))


_SPLIT = f"""WITH {HOLES}, g AS (SELECT *, avg(CASE WHEN won = 1 THEN v END) OVER {frame(10)} AS x1, avg(CASE WHEN won = 0 THEN v END) OVER {frame(10)} AS x0 FROM e),
h AS (SELECT *, last_value(x1 IGNORE NULLS) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y1, last_value(x0 IGNORE NULLS) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y0 FROM g)
SELECT event_id, user_id, {r6('y1', 'rolling_mean_binary_v10_1')}, {r6('y0', 'rolling_mean_binary_v10_0')}"""


@query(f"{_SPLIT} FROM h")
def rolling_binary(spark, sf):
    return one(spark, sf, RollingBinary("v", PLAYERS, EVENTS, size=10, flag="won"))


@query(f"{_SPLIT}, {r6('y1 * prob + y0 * (1 - prob)', 'rolling_mean_binary_v10_prob')} FROM h")
def rolling_binary_prob(spark, sf):
    return one(spark, sf, RollingBinary("v", PLAYERS, EVENTS, size=10, flag="won", probability="prob"))


@query(f"""WITH {GAMES_SQL}, g AS (SELECT opponent_id, match_id, league, min(start_date) AS d, avg(score) AS s FROM duels GROUP BY ALL),
x AS (SELECT *, avg(s) OVER (PARTITION BY opponent_id, league ORDER BY d, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS x FROM g),
y AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY opponent_id, league ORDER BY d, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM x)
SELECT duels.match_id, team_id, {r6('y', 'rolling_mean_against_score5')} FROM duels LEFT JOIN y ON duels.opponent_id = y.opponent_id AND duels.match_id = y.match_id AND duels.league = y.league""")
def rolling_against_opponent(spark, sf):
    g = AgainstOpponent(("score",), ("league",), DUELS, size=5)
    return out(g.transform(inputs.duel_matches(spark, sf)), ["match_id", "team_id"], g.features_out)


@query(f"""WITH {SQUADS_SQL}, g AS (SELECT *, avg(points) OVER (PARTITION BY player_id ORDER BY start_date, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS x FROM squads),
h AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY player_id ORDER BY start_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM g),
t AS (SELECT match_id, team_id, avg(y) AS m FROM h GROUP BY ALL)
SELECT h.match_id, h.team_id, player_id, {r6('y', 'rolling_mean_points10')}, {r6('t.m', 'rolling_mean_points10_opponent')} FROM h LEFT JOIN t ON h.match_id = t.match_id AND h.team_id <> t.team_id""")
def opponent_join(spark, sf):
    g = Rolling("points", ("player_id",), SQUADS, size=10, add_opponent=True)
    return out(g.transform(inputs.squad_matches(spark, sf)), ["match_id", "team_id", "player_id"], g.features_out)


@query(f"""WITH {SQUADS_SQL}, g AS (SELECT match_id, team_id, min(start_date) AS d, avg(points) AS p FROM squads GROUP BY ALL),
x AS (SELECT *, lag(p) OVER (PARTITION BY team_id ORDER BY d, match_id) AS y FROM g)
SELECT squads.match_id, squads.team_id, player_id, {r6('y', 'lag_points1')} FROM squads JOIN x ON squads.match_id = x.match_id AND squads.team_id = x.team_id""")
def group_to_granularity(spark, sf):
    g = Lag("points", ("team_id",), SQUADS, length=1)
    return out(g.transform(inputs.squad_matches(spark, sf)), ["match_id", "team_id", "player_id"], g.features_out)


BATCHED = Roles(match="event_id", team="user_id", date="ts", player="user_id", update="batch")


@query(f"""WITH {HOLES}, g AS (SELECT *, event_id // 20 AS batch, avg(v) OVER {frame(4)} AS x FROM e),
h AS (SELECT *, last_value(x IGNORE NULLS) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM g)
SELECT event_id, user_id, {r6('first_value(y) OVER (PARTITION BY batch, user_id ORDER BY ts, event_id)', 'rolling_mean_v4')} FROM h""")
def equal_in_batch(spark, sf):
    g = Rolling("v", PLAYERS, BATCHED, size=4)
    return out(g.transform(holes(spark, sf).withColumn("batch", F.expr("event_id DIV 20"))), ["event_id", "user_id"], g.features_out)


_LAST = "l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM e)"


@query(f"WITH {HOLES}, {_LAST} SELECT user_id, {r6('avg(v)', 'rolling_mean_v10')} FROM l WHERE k <= 10 GROUP BY user_id")
def future_state_rolling(spark, sf):
    g = Rolling("v", PLAYERS, EVENTS, size=10)
    df = holes(spark, sf)
    return out(g.newest(g.tail(g.grouped(df))), ["user_id"], g.features_out)


@query(f"WITH {HOLES}, {_LAST} SELECT user_id, {', '.join(r6(f'max(CASE WHEN k = {k} THEN v END)', f'lag_v{k}') for k in (1, 2, 3))} FROM l WHERE k <= 3 GROUP BY user_id")
def future_state_lag(spark, sf):
    g = Lag("v", PLAYERS, EVENTS, length=3)
    return out(g.newest(g.tail(g.grouped(holes(spark, sf)))), ["user_id"], g.features_out)


@query(f"WITH {HOLES} SELECT user_id, {r6('avg(v)', 'rolling_mean_days_v10')}, {r6('count(v)', 'rolling_mean_days_count10')} FROM e WHERE epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM events) - 864000000000 GROUP BY user_id")
def future_state_days(spark, sf):
    g = RollingDays("v", PLAYERS, EVENTS, days=10, add_count=True)
    return out(g.newest(g.tail(g.grouped(holes(spark, sf)))), ["user_id"], g.features_out)


_HALF = "c AS (SELECT quantile_disc(epoch_us(ts), 0.5) AS t FROM events)"


def halves(spark, sf, of=holes, date="ts") -> tuple[DataFrame, DataFrame]:
    """Rows up to and after the middle date."""
    df = of(spark, sf)
    t = F.unix_micros(date)
    cut = df.agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros({date}))")).first()[0]
    return df.where(t <= cut), df.where(t > cut)


@query(f"""WITH {HOLES}, {_HALF}, g AS (SELECT *, CASE WHEN count(v) OVER {frame(4)} >= 4 THEN avg(v) OVER {frame(4)} END AS x FROM e),
h AS (SELECT *, last_value(x IGNORE NULLS) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM g)
SELECT event_id, user_id, {r6('y', 'rolling_mean_v4')} FROM h, c WHERE epoch_us(ts) > t""")
def update_after_fit(spark, sf):
    """Fit on the first half of the stream, update with the second: as if computed at once, nulls and all."""
    early, late = halves(spark, sf)
    g = Rolling("v", PLAYERS, EVENTS, size=4, min_periods=4)
    rows, _ = g.fit(early)[1].update(late)
    return out(rows, ["event_id", "user_id"], g.features_out)


@query(f"""WITH {HOLES}, {_HALF}, g AS (SELECT *, avg(CASE WHEN won = 1 THEN v END) OVER {frame(5)} AS x1, avg(CASE WHEN won = 0 THEN v END) OVER {frame(5)} AS x0 FROM e),
h AS (SELECT *, last_value(x1 IGNORE NULLS) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y1, last_value(x0 IGNORE NULLS) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y0 FROM g)
SELECT event_id, user_id, {r6('y1', 'rolling_mean_binary_v5_1')}, {r6('y0', 'rolling_mean_binary_v5_0')}, {r6('y1 * prob + y0 * (1 - prob)', 'rolling_mean_binary_v5_prob')} FROM h, c WHERE epoch_us(ts) > t""")
def binary_update(spark, sf):
    early, late = halves(spark, sf)
    g = RollingBinary("v", PLAYERS, EVENTS, size=5, flag="won", probability="prob")
    rows, _ = g.fit(early)[1].update(late)
    return out(rows, ["event_id", "user_id"], g.features_out)


@query(f"""WITH {HOLES}, {_HALF}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM e, c WHERE epoch_us(ts) <= t),
p AS (SELECT *, avg(CASE WHEN won = 1 THEN v END) OVER {frame(5)} AS x1, avg(CASE WHEN won = 0 THEN v END) OVER {frame(5)} AS x0 FROM e, c WHERE epoch_us(ts) <= t),
w AS (SELECT user_id, arg_max(x1, (ts, event_id)) FILTER (x1 IS NOT NULL) AS c1, arg_max(x0, (ts, event_id)) FILTER (x0 IS NOT NULL) AS c0 FROM p GROUP BY user_id),
s AS (SELECT user_id, avg(CASE WHEN won = 1 THEN v END) AS m1, avg(CASE WHEN won = 0 THEN v END) AS m0 FROM k WHERE k <= 5 GROUP BY user_id),
m AS (SELECT s.user_id, coalesce(m1, c1) AS y1, coalesce(m0, c0) AS y0 FROM s JOIN w ON s.user_id = w.user_id)
SELECT event_id, e.user_id, {r6('y1', 'rolling_mean_binary_v5_1')}, {r6('y0', 'rolling_mean_binary_v5_0')}, {r6('y1 * prob + y0 * (1 - prob)', 'rolling_mean_binary_v5_prob')}
FROM e JOIN c ON epoch_us(ts) > t LEFT JOIN m ON e.user_id = m.user_id""")
def binary_projected(spark, sf):
    """Future rows: each outcome's latest mean, blended by the row's own probability."""
    early, late = halves(spark, sf)
    g = RollingBinary("v", PLAYERS, EVENTS, size=5, flag="won", probability="prob")
    return out(g.fit(early)[1].project(late.select("event_id", "ts", "user_id", "prob")), ["event_id", "user_id"], g.features_out)


_DUEL_HALF = "c AS (SELECT quantile_disc(epoch_us(start_date), 0.5) AS t FROM duels)"
_AGAINST = f"""WITH {GAMES_SQL}, {_DUEL_HALF}, g AS (SELECT opponent_id, match_id, league, min(start_date) AS d, avg(score) AS s FROM duels GROUP BY ALL)"""


def duels(spark, sf) -> DataFrame:
    return inputs.duel_matches(spark, sf).withColumnRenamed("opponent_id", "__opponent")


@query(f"""{_AGAINST}, x AS (SELECT *, avg(s) OVER (PARTITION BY opponent_id, league ORDER BY d, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS y FROM g)
SELECT duels.match_id, team_id, {r6('y', 'rolling_mean_against_score5')} FROM duels JOIN c ON epoch_us(start_date) > t JOIN x ON duels.opponent_id = x.opponent_id AND duels.match_id = x.match_id AND duels.league = x.league""")
def against_opponent_update(spark, sf):
    early, late = halves(spark, sf, duels, "start_date")
    g = AgainstOpponent(("score",), ("league",), DUELS, size=5)
    rows, _ = g.fit(early)[1].update(late)
    return out(rows, ["match_id", "team_id"], g.features_out)


@query(f"""{_AGAINST}, k AS (SELECT *, row_number() OVER (PARTITION BY opponent_id, league ORDER BY d DESC, match_id DESC) AS k FROM g, c WHERE epoch_us(d) <= t),
m AS (SELECT opponent_id, league, avg(s) AS y FROM k WHERE k <= 5 GROUP BY ALL)
SELECT duels.match_id, team_id, {r6('y', 'rolling_mean_against_score5')} FROM duels JOIN c ON epoch_us(start_date) > t LEFT JOIN m ON duels.opponent_id = m.opponent_id AND duels.league = m.league""")
def against_opponent_projected(spark, sf):
    early, late = halves(spark, sf, duels, "start_date")
    g = AgainstOpponent(("score",), ("league",), DUELS, size=5)
    return out(g.fit(early)[1].project(late.drop("score", "opponent_score", "perf")), ["match_id", "team_id"], g.features_out)


CHAIN = FeatureChain((Lag("v", PLAYERS, EVENTS, length=1), Rolling("lag_v1", PLAYERS, EVENTS, size=3)), EVENTS)
_CHAIN = f"""WITH {HOLES}, {_HALF}, l AS (SELECT *, lag(v) OVER ({BY}) AS l FROM e), g AS (SELECT *, avg(l) OVER {frame(3)} AS x FROM l),
h AS (SELECT *, last_value(x IGNORE NULLS) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM g)"""


@query(f"{_CHAIN} SELECT event_id, user_id, {r6('l', 'lag_v1')}, {r6('y', 'rolling_mean_lag_v13')} FROM h, c WHERE epoch_us(ts) > t")
def chain_update(spark, sf):
    """A generator over another one's feature, fitted and then updated."""
    early, late = halves(spark, sf)
    rows, _ = CHAIN.fit(early)[1].update(late)
    return out(rows, ["event_id", "user_id"], CHAIN.features_out())


@query(f"""{_CHAIN}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM l, c WHERE epoch_us(ts) <= t),
m AS (SELECT user_id, max(CASE WHEN k = 1 THEN v END) AS a, avg(l) AS b FROM k WHERE k <= 3 GROUP BY user_id)
SELECT event_id, e.user_id, {r6('a', 'lag_v1')}, {r6('b', 'rolling_mean_lag_v13')} FROM e JOIN c ON epoch_us(ts) > t LEFT JOIN m ON e.user_id = m.user_id""")
def chain_projected(spark, sf):
    """Future rows look up the state of history."""
    early, late = halves(spark, sf)
    return out(CHAIN.fit(early)[1].project(late.select("event_id", "ts", "user_id")), ["event_id", "user_id"], CHAIN.features_out())


@query(f"WITH {HOLES} SELECT event_id, user_id, {r6('first_value(v) OVER (PARTITION BY user_id ORDER BY ts, event_id, user_id)', 'v')} FROM e")
def future_first_known(spark, sf):
    return out(first_known(holes(spark, sf), EVENTS, ["user_id"], ["v"]), ["event_id", "user_id"], ["v"])


@query(f"WITH {HOLES} SELECT {r6('avg(v)', 'rolling_mean_v25')} FROM (SELECT * FROM e ORDER BY ts DESC, event_id DESC LIMIT 25)")
def future_state_overall(spark, sf):
    """Without granularity: the state of the whole stream."""
    g = Rolling("v", (), EVENTS, size=25)
    return out(g.newest(g.tail(g.grouped(holes(spark, sf)))), [], g.features_out)


@query(f"WITH {HOLES}, {_HALF} SELECT event_id, event_id // 2 IN (SELECT event_id // 2 FROM e, c WHERE epoch_us(ts) <= t) AS known FROM e, c WHERE epoch_us(ts) > t")
def rows_of_known_matches(spark, sf):
    """Later rows by whether their match is in history."""
    pair = lambda d: d.withColumn("match_id", F.expr("event_id DIV 2"))
    early, late = map(pair, halves(spark, sf))
    old, new = known_matches(late, early, Roles(match="match_id", team="user_id", date="ts"))
    return old.select("event_id", F.lit(True).alias("known")).unionByName(new.select("event_id", F.lit(False).alias("known")))


@query(f"""WITH {SQUADS_SQL}, g AS (SELECT *, lag(points) OVER (PARTITION BY player_id ORDER BY start_date, match_id) AS y FROM squads)
SELECT match_id, team_id, {r6('CASE WHEN sum(CASE WHEN y IS NOT NULL THEN weight END) > 0 THEN sum(y * weight) / sum(CASE WHEN y IS NOT NULL THEN weight END) ELSE avg(y) END', 'lag_points1')} FROM g GROUP BY match_id, team_id""")
def team_auto_aggregate(spark, sf):
    g = FeatureChain((Lag("points", ("player_id",), SQUADS, length=1),), SQUADS, to_team=True)
    return out(g.transform(inputs.squad_matches(spark, sf)), ["match_id", "team_id"], g.features_out())


# -- shaping ----------------------------------------------------------------------


@query(f"""WITH {SQUADS_SQL} SELECT match_id, team_id, {r6("CASE WHEN coalesce(sum(weight), 0) <> 0 THEN sum(points * weight) / sum(weight) ELSE avg(points) END", 'points')}, {r6('sum(weight)', 'weight')} FROM squads GROUP BY ALL""")
def group_reducer_weighted(spark, sf):
    df = inputs.squad_matches(spark, sf).select("match_id", "team_id", "points", "weight")
    return out(shaping.reduce_groups(df, ["match_id", "team_id"], "weight"), ["match_id", "team_id"], ["points", "weight"])


@query(f"WITH {SQUADS_SQL}, x AS (SELECT *, sum(points) OVER (PARTITION BY match_id, team_id) AS target FROM squads) SELECT match_id, team_id, {r6('max(target)', 'target')}, {r6('sum(weight)', 'weight')} FROM x GROUP BY ALL")
def group_target(spark, sf):
    """The one target of each group, and the sum of its sample weights."""
    df = inputs.squad_matches(spark, sf).withColumn("target", F.sum("points").over(Window.partitionBy("match_id", "team_id")))
    return out(shaping.constant_target(df, ["match_id", "team_id"], "target", "weight"), ["match_id", "team_id"], ["target", "weight"])


@query(f"WITH {SQUADS_SQL} SELECT match_id, team_id, player_id, {r6('points2 / points', 'share')} FROM squads")
def arithmetic_in_place(spark, sf):
    df = shaping.arithmetic(inputs.squad_matches(spark, sf), "points2", "points", "divide", alias="share", drop=True)
    return out(df.select([c for c in df.columns if c not in ("points", "points2")]), ["match_id", "team_id", "player_id"], ["share"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def playing_time_maps(spark, sf):
    """Maps of shares read from JSON text."""
    e = inputs.entity_events(spark, sf)
    return e.select("event_id", ratings.playing_time(e, "props")["k"].alias("k"))


@query(f"WITH {SQUADS_SQL} SELECT match_id, team_id, player_id, {r6('points / sum(points) OVER (PARTITION BY match_id, team_id) * 240', 'points')} FROM squads")
def normalize_to(spark, sf):
    return out(shaping.normalise_to(inputs.squad_matches(spark, sf), "points", ["match_id", "team_id"], 240), ["match_id", "team_id", "player_id"], ["points"])


@query(f"WITH {SQUADS_SQL} SELECT match_id, team_id, player_id, {r6('sum(points) OVER (PARTITION BY match_id, team_id)', 'team_points')}, {r6('avg(points) OVER ()', 'all_points')} FROM squads")
def aggregator_over(spark, sf):
    df = shaping.aggregate_over(inputs.squad_matches(spark, sf), "points", ["match_id", "team_id"], "sum", "team_points")
    return out(shaping.aggregate_over(df, "points", [], "mean", "all_points"), ["match_id", "team_id", "player_id"], ["team_points", "all_points"])


@query(f"WITH {SQUADS_SQL} SELECT match_id, team_id, player_id, {r6('points - points2', 'points_minus_points2')}, {r6('points * points2', 'points_times_points2')}, {r6('points2 / points', 'points2_divided_by_points')}, {r6('points + points2', 'points_plus_points2')} FROM squads")
def column_arithmetic(spark, sf):
    df = inputs.squad_matches(spark, sf)
    for a, b, op in (("points", "points2", "subtract"), ("points", "points2", "multiply"), ("points2", "points", "divide"), ("points", "points2", "add")):
        df = shaping.arithmetic(df, a, b, op)
    return out(df, ["match_id", "team_id", "player_id"], ["points_minus_points2", "points_times_points2", "points2_divided_by_points", "points_plus_points2"])


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS match_number FROM events")
def match_number(spark, sf):
    return shaping.match_number(inputs.entity_events(spark, sf), EVENTS).select("event_id", F.col("match_number").cast("long").alias("match_number"))


@query("""WITH n AS (SELECT event_id, ts, dense_rank() OVER (ORDER BY ts, event_id) - 1 AS k FROM events),
d AS (SELECT list(DISTINCT ts ORDER BY ts) AS ds FROM events), c AS (SELECT min(k) AS lo, (SELECT max(k) FROM n) AS hi FROM n, d WHERE ts >= ds[len(ds) // 2 + 1])
SELECT event_id, CAST(CASE WHEN k < lo THEN -1 ELSE least(3, floor((k - lo) / greatest(1, (hi - lo) // 4))) END AS INTEGER) AS fold FROM n, c""")
def cv_split_labels(spark, sf):
    return est.MatchKFold(EVENTS, n_splits=4).split_labels(inputs.entity_events(spark, sf)).select("event_id", "fold")


@query("SELECT event_id, CAST(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS day_number FROM events")
def day_numbers(spark, sf):
    return inputs.entity_events(spark, sf).select("event_id", day_number(F.col("ts")).cast("int").alias("day_number"))


@query(f"WITH {GAMES_SQL} SELECT match_id, team_id, opponent_id, {r6('score', 'score')}, {r6('opponent_score', 'opponent_score')} FROM duels")
def wide_to_long(spark, sf):
    return out(shaping.wide_to_long(inputs.games(spark, sf), GAMES), ["match_id", "team_id", "opponent_id"], ["score", "opponent_score"])


@query("""WITH i AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
c AS (SELECT a.event_id, b.event_type, count(*) AS n, max(b.k) AS last FROM i a JOIN i b ON a.user_id = b.user_id AND b.k < a.k AND a.k - b.k <= 25 GROUP BY ALL),
w AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, last DESC) AS r FROM c)
SELECT i.event_id, w.event_type AS game_league FROM i LEFT JOIN w ON i.event_id = w.event_id AND r = 1""")
def league_mode_25(spark, sf):
    return shaping.league_by_history(inputs.entity_events(spark, sf), EVENTS).select("event_id", "game_league")


@query("""SELECT event_id FROM events WHERE value > 10 AND value <= 80 AND event_type <> 'view' AND event_id % 2 IN (0, 1) AND user_id NOT IN (1, 2, 3) AND user_id IN (SELECT user_id FROM events WHERE user_id >= 5)
  AND ts >= (SELECT min(ts) FROM events)""")
def filters_all_ops(spark, sf):
    e = inputs.entity_events(spark, sf).withColumn("parity", F.col("event_id") % 2)
    first = e.agg(F.min("ts").cast("string")).first()[0]
    fs = [Filter("value", 10, ">"), Filter("value", 80, "<="), Filter("event_type", "view", "!="), Filter("parity", [0, 1], "in"), Filter("user_id", [1, 2, 3], "not in"), Filter("user_id", 5, ">="), Filter("ts", first, ">=")]
    return shaping.apply_filters(e, fs).select("event_id")


# -- scaling ------------------------------------------------------------------------


def scaled(spark, sf, step, names=("value",)) -> DataFrame:
    e = inputs.entity_events(spark, sf)
    return out(step.fit(e).transform(e), ["event_id"], list(names))


@query(f"SELECT event_id, {r6('least(2.0, greatest(-1.5, (value - avg(value) OVER ()) / stddev_samp(value) OVER () * 0.55 + 0.5))', 'value')} FROM events")
def std_scaler(spark, sf):
    return scaled(spark, sf, scaling.PartialStandard(["value"]))


@query(f"""WITH q AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM events), x AS (SELECT event_id, least(1, greatest(0, (value - lo) / (hi - lo))) AS x FROM events, q)
SELECT event_id, {r6('x + 0.5 - avg(x) OVER ()', 'value')} FROM x""")
def minmax_scaler(spark, sf):
    return scaled(spark, sf, scaling.MinMax(["value"]))


@query(f"WITH q AS (SELECT quantile_cont(value, 0.93) AS c FROM events) SELECT event_id, {r6('CASE WHEN value > c THEN (value - c) * 0.8 + c ELSE value END', 'value')} FROM events, q")
def diminishing(spark, sf):
    return scaled(spark, sf, scaling.Diminishing(["value"]))


@query(f"""WITH q AS (SELECT quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM events), x AS (SELECT event_id, least(1, greatest(0, (value - lo) / (hi - lo))) AS x FROM events, q)
SELECT event_id, {r6('x * 0.5 / avg(x) OVER ()', 'value')} FROM x""")
def minmax_multiplied(spark, sf):
    return scaled(spark, sf, scaling.MinMax(["value"], quantile=0.9, multiply_align=True, add_align=False))


@query(f"WITH q AS (SELECT quantile_cont(value, 0.07) AS c FROM events) SELECT event_id, {r6('CASE WHEN value < c THEN c - (c - value) * 0.8 ELSE value END', 'value')} FROM events, q")
def diminishing_reverse(spark, sf):
    return scaled(spark, sf, scaling.Diminishing(["value"], reverse=True))


@query(f"""WITH {HOLES}, {_HALF}, m AS (SELECT user_id, avg(v) AS a, sum(w) AS b FROM e, c WHERE epoch_us(ts) <= t GROUP BY user_id)
SELECT event_id, {r6('a', 'group_v')} FROM e JOIN c ON epoch_us(ts) > t LEFT JOIN m ON e.user_id = m.user_id""")
def group_means_at_fit(spark, sf):
    """Means of the first half by user, on the rows of the second."""
    early, late = halves(spark, sf)
    return out(scaling.GroupMeans(["v"], ["user_id"]).fit(early).transform(late), ["event_id"], ["group_v"])


_KNOTS = ", ".join(str(k / 200) for k in range(201))


@query(f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END AS x FROM events),
z AS (SELECT avg(CASE WHEN abs(x) < 1e-10 THEN 1.0 ELSE 0 END) AS pi, quantile_cont(CASE WHEN abs(x) >= 1e-10 THEN x END, [{_KNOTS}]) AS q FROM x),
k AS (SELECT *, len(list_filter(q, lambda v: v <= x)) AS k FROM x, z)
SELECT event_id, {r6("CASE WHEN abs(x) < 1e-10 THEN pi / 2 WHEN k >= 201 THEN 1.0 WHEN k < 1 THEN pi ELSE pi + (1 - pi) * (k - 1 + (x - q[k]) / (q[k + 1] - q[k])) / 200 END", 'x')} FROM k""")
def quantile_scaler(spark, sf):
    e = inputs.entity_events(spark, sf).withColumn("x", F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value")))
    return out(scaling.Quantile(["x"], n=200).fit(e).transform(e), ["event_id"], ["x"])


@query(f"""WITH {HOLES}, m AS (SELECT event_id, v / 100.0 AS a, prob AS b FROM e)
SELECT event_id, {r6("least(1, greatest(0, (coalesce(a * 0.6, 0) + (1 - b) * 0.4) / (CASE WHEN a IS NULL THEN 0 ELSE 0.6 END + 0.4)))", 'mix')} FROM m""")
def weights_mix(spark, sf):
    df = holes(spark, sf).withColumns({"a": F.col("v") / 100.0, "b": F.col("prob")})
    return out(scaling.weighted_mix(df, [scaling.ColumnWeight("a", 0.6), scaling.ColumnWeight("b", 0.4, True)], alias="mix"), ["event_id"], ["mix"])


@query(f"WITH q AS (SELECT quantile_cont(value, 0.99) AS q FROM events) SELECT event_id, {r6('least(1, greatest(0, value / q))', 'weight')} FROM events, q")
def participation_p99(spark, sf):
    df, _ = scaling.scaled_weight(inputs.entity_events(spark, sf), "value", "weight")
    return out(df, ["event_id"], ["weight"])


@query()
def symmetric_scaler(spark, sf):
    return scaled(spark, sf, scaling.Symmetric(["value"], ["event_type"]))


@query()
def performance_chain(spark, sf):
    return scaled(spark, sf, scaling.Performance(["value"], prefix=""))


# -- ratings ----------------------------------------------------------------------------

_MULT = "greatest(5.0, 50.0 * ((30.0 - {c}) / 140.0 + 1) * 0.9 + 5.0)"
_CONF = "greatest(0.0, least(-least(CASE WHEN {l} IS NULL THEN 0 ELSE day - {l} END, 90.0) * 0.06 + {c} + 1.0, 150.0))"


def _side(old: str, a: str, b: str) -> str:
    return f"list_transform({old}, lambda x, j: CASE WHEN j = ia THEN {a} WHEN j = ib THEN {b} ELSE x END)"


def _sig(x: str) -> str:
    return f"1 / (1 + exp(-0.005757 * ({x})))"


_FOLD = f"""WITH RECURSIVE {GAMES_SQL},
t AS (SELECT team_id, row_number() OVER (ORDER BY team_id) AS i FROM (SELECT DISTINCT team_id FROM duels)),
m AS (SELECT row_number() OVER (ORDER BY start_date, match_id) AS n, match_id, date_diff('day', DATE '2000-01-01', CAST(start_date AS DATE)) + 1 AS day,
  least(team1, team2) AS ta, greatest(team1, team2) AS tb, (CASE WHEN team1 < team2 THEN score1 ELSE score2 END) AS sa, (CASE WHEN team1 < team2 THEN score2 ELSE score1 END) AS sb FROM games),
p AS (SELECT m.*, a.i AS ia, b.i AS ib, sa / (sa + 50.0) AS pa, sb / (sb + 50.0) AS pb FROM m JOIN t a ON ta = a.team_id JOIN t b ON tb = b.team_id),
f AS (SELECT CAST(0 AS BIGINT) AS n, (SELECT list(1000.0::DOUBLE) FROM t) AS o, (SELECT list(1000.0::DOUBLE) FROM t) AS d, (SELECT list(0.0::DOUBLE) FROM t) AS c, (SELECT list(NULL::DOUBLE) FROM t) AS l
  UNION ALL SELECT p.n,
    {_side('o', f"o[ia] + (pa - {_sig('o[ia] - d[ib]')}) * {_MULT.format(c='c[ia]')}", f"o[ib] + (pb - {_sig('o[ib] - d[ia]')}) * {_MULT.format(c='c[ib]')}")},
    {_side('d', f"d[ia] + (1 - pb - {_sig('d[ia] - o[ib]')}) * {_MULT.format(c='c[ia]')}", f"d[ib] + (1 - pa - {_sig('d[ib] - o[ia]')}) * {_MULT.format(c='c[ib]')}")},
    {_side('c', _CONF.format(l='l[ia]', c='c[ia]'), _CONF.format(l='l[ib]', c='c[ib]'))},
    {_side('l', 'day', 'day')} FROM f JOIN p ON p.n = f.n + 1)
SELECT match_id, ta AS team_id, {r6('o[ia]', 'team_off_rating_projected')}, {r6('d[ia]', 'team_def_rating_projected')}, {r6('d[ib]', 'opponent_def_rating_projected')}, {r6(_sig('o[ia] - d[ib]'), 'team_predicted_off_performance')}, {r6('o[ia] - d[ib]', 'team_rating_difference_projected')} FROM f JOIN p ON p.n = f.n + 1
UNION ALL SELECT match_id, tb, {r6('o[ib]', 'x')}, {r6('d[ib]', 'y')}, {r6('d[ia]', 'z')}, {r6(_sig('o[ib] - d[ia]'), 'u')}, {r6('o[ib] - d[ia]', 'v')} FROM f JOIN p ON p.n = f.n + 1"""


def duel_performance(spark, sf) -> DataFrame:
    return inputs.duel_matches(spark, sf).withColumn("perf", F.col("score") / (F.col("score") + 50.0))


@query(_FOLD)
def team_rating(spark, sf):
    df = duel_performance(spark, sf)
    folded = ratings.team_fold(ratings.team_matches(df, DUELS, "perf"), ratings.RatingConfig())
    names = ["team_off_rating_projected", "team_def_rating_projected", "opponent_def_rating_projected", "team_predicted_off_performance", "team_rating_difference_projected"]
    return out(ratings.team_features(df, folded, DUELS), ["match_id", "team_id"], names)


_LAST_STATE = _FOLD[: _FOLD.index("\nSELECT match_id, ta AS team_id")] + ", z AS (SELECT o, d FROM f ORDER BY n DESC LIMIT 1)"


@query(f"""{_LAST_STATE} SELECT match_id, duels.team_id AS team_id, {r6('o[a.i]', 'team_off_rating_projected')}, {r6('d[a.i]', 'team_def_rating_projected')}, {r6('o[b.i]', 'opponent_off_rating_projected')}, {r6('d[b.i]', 'opponent_def_rating_projected')},
  {r6(_sig('o[a.i] - d[b.i]'), 'team_predicted_off_performance')}, {r6(_sig('d[a.i] - o[b.i]'), 'team_predicted_def_performance')} FROM duels JOIN t a ON duels.team_id = a.team_id JOIN t b ON opponent_id = b.team_id, z""")
def team_rating_future(spark, sf):
    df = duel_performance(spark, sf)
    folded = ratings.team_fold(ratings.team_matches(df, DUELS, "perf"), ratings.RatingConfig())
    future = df.select("match_id", "start_date", "team_id", "opponent_id")
    return out(ratings.project_teams(future, folded, DUELS), ["match_id", "team_id"], ratings.TEAM_OUT)


def _trial(name: str, coef: float) -> str:
    return _FOLD.replace("0.005757", str(coef)).replace("WITH RECURSIVE", f"SELECT '{name}' AS trial, match_id, team_id, team_off_rating_projected FROM (WITH RECURSIVE", 1) + ")"


@query(f"{_trial('flat', 0.003)} UNION ALL {_trial('steep', 0.009)}")
def team_rating_trials(spark, sf):
    """Rating configurations side by side: one pairing of the sides, a fold a trial in tasks of their own."""
    configs = {"flat": ratings.RatingConfig(coef=0.003), "steep": ratings.RatingConfig(coef=0.009)}
    matches = ratings.with_trials(ratings.team_matches(duel_performance(spark, sf), DUELS, "perf"), configs)
    f = ratings.team_fold(matches, configs, ("trial",)).where("kind = 'match'")
    return out(f.withColumnsRenamed({"match": "match_id", "team": "team_id"}), ["trial", "match_id", "team_id"], ["team_off_rating_projected"])


def squad_performance(spark, sf) -> DataFrame:
    return inputs.squad_matches(spark, sf).withColumns({"perf": F.col("points") / (F.col("points") + 25.0), "weight": F.least(F.lit(1.0), F.col("lines") / 2.0)})


PLAYER_FEATURES = [
    "player_off_rating", "player_def_rating", "player_predicted_off_performance", "team_off_rating_projected", "opponent_def_rating_projected", "team_rating_difference_projected",
    "rating_mean_projected", "player_rating_difference_projected", "player_opponent_mean_projected", "team_rating", "opponent_rating",
]


def _over(side: int, value: str) -> str:
    """The mean of a match's list over one side, by weight."""
    total = lambda x: f"list_sum(list_transform(range(1, len(js) + 1), lambda i: CASE WHEN sd[i] = {side} THEN {x} ELSE 0 END))"
    return f"{total(value + '[i] * w[i]')} / {total('w[i]')}"


def _each(x: str) -> str:
    return f"list_transform(range(1, len(js) + 1), lambda i: {x})"


_KNOWN = "list_filter(range(1, len(o) + 1), lambda i: l[i] IS NOT NULL AND day - l[i] <= 600)"
_PLAYERS = f"""WITH RECURSIVE {SQUADS_SQL},
s AS (SELECT *, points / (points + 25.0) AS perf, least(1.0, lines / 2.0) AS pw, date_diff('day', DATE '2000-01-01', CAST(start_date AS DATE)) + 1 AS day FROM squads),
t AS (SELECT player_id, row_number() OVER (ORDER BY player_id) AS i FROM (SELECT DISTINCT player_id FROM s)),
m AS (SELECT row_number() OVER (ORDER BY start_date, match_id) AS n, * FROM (SELECT match_id, min(start_date) AS start_date, min(day) AS day, min(team_id) AS ta, max(team_id) AS tb FROM s GROUP BY match_id)),
p AS (SELECT n, m.match_id, m.day, list(t.i ORDER BY s.team_id, s.player_id) AS js, list(CASE WHEN s.team_id = ta THEN 0 ELSE 1 END ORDER BY s.team_id, s.player_id) AS sd,
  list(s.perf ORDER BY s.team_id, s.player_id) AS pf, list(s.pw ORDER BY s.team_id, s.player_id) AS w, any_value(ta) AS ta, any_value(tb) AS tb FROM m JOIN s ON s.match_id = m.match_id JOIN t ON t.player_id = s.player_id GROUP BY n, m.match_id, m.day),
f AS (SELECT CAST(0 AS BIGINT) AS n, (SELECT list(NULL::DOUBLE) FROM t) AS o, (SELECT list(NULL::DOUBLE) FROM t) AS d, (SELECT list(0.0::DOUBLE) FROM t) AS c, (SELECT list(NULL::DOUBLE) FROM t) AS l,
    []::BIGINT[] AS js, []::DOUBLE[] AS eo, []::DOUBLE[] AS ed, 0.0::DOUBLE AS oa, 0.0::DOUBLE AS ob, 0.0::DOUBLE AS da, 0.0::DOUBLE AS db, []::DOUBLE[] AS po
  UNION ALL SELECT n,
    list_transform(o, lambda x, j: coalesce(no[list_position(js, j)], x)), list_transform(d, lambda x, j: coalesce(nd[list_position(js, j)], x)),
    list_transform(c, lambda x, j: CASE WHEN list_contains(js, j) THEN {_CONF.format(l='l[j]', c='x')} ELSE x END), list_transform(l, lambda x, j: CASE WHEN list_contains(js, j) THEN day ELSE x END),
    js, eo, ed, oa, ob, da, db, po FROM (
  SELECT *, {_each(f"eo[i] + (pf[i] - po[i]) * {_MULT.format(c='c[js[i]]')} * w[i]")} AS no, {_each(f"ed[i] + (1 - CASE WHEN sd[i] = 0 THEN qb ELSE qa END - 1 / (1 + exp(-0.005757 * (ed[i] - CASE WHEN sd[i] = 0 THEN ob ELSE oa END)))) * {_MULT.format(c='c[js[i]]')} * w[i]")} AS nd FROM (
  SELECT *, {_each("1 / (1 + exp(-0.005757 * (eo[i] - CASE WHEN sd[i] = 0 THEN db ELSE da END)))")} AS po FROM (
  SELECT *, {_over(0, 'eo')} AS oa, {_over(1, 'eo')} AS ob, {_over(0, 'ed')} AS da, {_over(1, 'ed')} AS db, {_over(0, 'pf')} AS qa, {_over(1, 'pf')} AS qb FROM (
  SELECT *, {_each('coalesce(o[js[i]], st)')} AS eo, {_each('coalesce(d[js[i]], st)')} AS ed FROM (
  SELECT p.n, p.day, p.js, p.sd, p.pf, p.w, f.o, f.d, f.c, f.l, CASE WHEN len({_KNOWN}) < 50 THEN 1000.0 ELSE list_aggregate(list_transform({_KNOWN}, lambda i: o[i]), 'quantile_cont', 0.2) END AS st FROM f JOIN p ON p.n = f.n + 1))))))"""
_PLAYER_ROWS = f"""{_PLAYERS},
x AS (SELECT p.match_id, unnest(p.js) AS i, unnest(p.sd) AS side, unnest(p.w) AS w, unnest(f.eo) AS eo, unnest(f.ed) AS ed, unnest(f.po) AS po, ta, tb, oa, ob, da, db FROM f JOIN p ON p.n = f.n),
y AS (SELECT *, avg(eo) OVER (PARTITION BY match_id, side) AS mine, sum(eo * w) OVER (PARTITION BY match_id) / sum(w) OVER (PARTITION BY match_id) AS m, CASE WHEN side = 0 THEN oa ELSE ob END AS own, CASE WHEN side = 0 THEN db ELSE da END AS opp FROM x),
z AS (SELECT *, (sum(eo) OVER (PARTITION BY match_id) - sum(eo) OVER (PARTITION BY match_id, side)) / (count(*) OVER (PARTITION BY match_id) - count(*) OVER (PARTITION BY match_id, side)) AS other FROM y)
SELECT match_id, CASE WHEN side = 0 THEN ta ELSE tb END AS team_id, player_id, {r6('eo', 'player_off_rating')}, {r6('ed', 'player_def_rating')}, {r6('po', 'player_predicted_off_performance')}, {r6('own', 'team_off_rating_projected')}, {r6('opp', 'opponent_def_rating_projected')},
  {r6('own - opp', 'team_rating_difference_projected')}, {r6('m', 'rating_mean_projected')}, {r6('eo - opp', 'player_rating_difference_projected')}, {r6('(eo + opp) / 2', 'player_opponent_mean_projected')}, {r6('mine', 'team_rating')}, {r6('other', 'opponent_rating')} FROM z JOIN t ON z.i = t.i"""


@query(_PLAYER_ROWS)
def player_rating(spark, sf):
    df = squad_performance(spark, sf)
    return out(ratings.player_features(df, ratings.player_ratings(df, SQUADS, "perf"), SQUADS), ["match_id", "team_id", "player_id"], PLAYER_FEATURES)


@query(f"""{_PLAYERS}, v AS (SELECT n FROM (SELECT n, start_date FROM m) ORDER BY n DESC LIMIT 1), e AS (SELECT unnest(range(1, len(o) + 1)) AS i, unnest(o) AS o, unnest(d) AS d FROM f JOIN v ON f.n = v.n),
g AS (SELECT match_id, team_id, s.player_id, coalesce(o, 1000.0) AS eo, coalesce(d, 1000.0) AS ed, pw FROM s JOIN t ON s.player_id = t.player_id JOIN e ON e.i = t.i),
h AS (SELECT match_id, team_id, sum(eo * pw) / sum(pw) AS tm, sum(ed * pw) / sum(pw) AS dm FROM g GROUP BY ALL)
SELECT g.match_id, g.team_id, player_id, {r6('eo', 'player_off_rating')}, {r6('ed', 'player_def_rating')}, {r6('1 / (1 + exp(-0.005757 * (eo - h.dm)))', 'player_predicted_off_performance')}, {r6('1 / (1 + exp(-0.005757 * (ed - h.tm)))', 'player_predicted_def_performance')}
FROM g JOIN h ON g.match_id = h.match_id AND g.team_id <> h.team_id""")
def player_rating_future(spark, sf):
    """Matches as if they were to come: ratings after all matches, nothing learnt from them."""
    df = squad_performance(spark, sf)
    folded = ratings.player_ratings(df, SQUADS, "perf")
    return out(ratings.project_players(df.drop("perf"), folded, SQUADS), ["match_id", "team_id", "player_id"], ratings.PLAYER_OUT)


@query(f"""WITH RECURSIVE {SQUADS_SQL}, c AS (SELECT quantile_disc(epoch_us(start_date), 0.5) AS t FROM squads), late AS (SELECT DISTINCT match_id FROM squads, c WHERE epoch_us(start_date) > t)
SELECT r.match_id, team_id, player_id, player_off_rating, player_def_rating FROM ({_PLAYER_ROWS}) r JOIN late ON r.match_id = late.match_id""")
def player_rating_update(spark, sf):
    """Ratings of the first half of the matches, then of the second from their state: as if folded at once."""
    early, late = halves(spark, sf, squad_performance, "start_date")
    first = ratings.player_ratings(early, SQUADS, "perf")
    second = ratings.player_ratings(late, SQUADS, "perf", state=first).where("kind = 'match'")
    return out(second.select(F.col("match").alias("match_id"), F.col("team").alias("team_id"), F.col("player").alias("player_id"), *ratings.PLAYER_OUT), ["match_id", "team_id", "player_id"], ratings.PLAYER_OUT[:2])


@query()
def player_rating_mean(spark, sf):
    df = squad_performance(spark, sf)
    c = ratings.RatingConfig(predictor="mean", mean_adjustment=True, start=ratings.StartRating(quantile=0.3, least_count=20))
    return out(ratings.player_features(df, ratings.player_ratings(df, SQUADS, "perf", c), SQUADS), ["match_id", "team_id", "player_id"], PLAYER_FEATURES)


# -- scores ---------------------------------------------------------------------------------

PRED_SQL = """s AS (SELECT event_id, user_id, event_type, value AS y, value * 0.8 + (event_id * 37 % 41) - 20.0 AS p, 1.0 + event_id % 3 AS w, event_id % 2 AS flag,
  ((event_id * 37 % 1000) + 0.5) / 1000 AS prob, CASE WHEN (event_id * 91 % 1000) / 1000.0 < ((event_id * 37 % 1000) + 0.5) / 1000 THEN 1 ELSE 0 END AS hit FROM events)"""
CLASS_SQL = """c0 AS (SELECT event_id, user_id, event_type, event_id * 13 % 5 AS y, [1.0 + event_id * 3 % 11, 1.0 + event_id * 4 % 11, 1.0 + event_id * 5 % 11, 1.0 + event_id * 6 % 11, 1.0 + event_id * 7 % 11] AS raw, (event_id % 9) / 2.0 AS thr FROM events),
c AS (SELECT *, list_transform(raw, lambda x: x / list_sum(raw)) AS p FROM c0)"""


def predicted(spark, sf) -> DataFrame:
    i = F.col("event_id")
    prob = ((i * 37 % 1000) + 0.5) / 1000
    return inputs.entity_events(spark, sf).select(
        "event_id", "user_id", "event_type", F.col("value").alias("y"), (F.col("value") * 0.8 + (i * 37 % 41) - 20.0).alias("p"), (F.lit(1.0) + i % 3).alias("w"), (i % 2).alias("flag"),
        prob.alias("prob"), F.when((i * 91 % 1000) / 1000.0 < prob, 1).otherwise(0).alias("hit"),
    )


def classed(spark, sf) -> DataFrame:
    i = F.col("event_id")
    raw = F.array(*[F.lit(1.0) + i * k % 11 for k in range(3, 8)])
    df = inputs.entity_events(spark, sf).select("event_id", "user_id", "event_type", (i * 13 % 5).alias("y"), raw.alias("raw"), ((i % 9) / 2.0).alias("thr"))
    return df.withColumn("p", F.transform("raw", lambda x: x / F.aggregate("raw", F.lit(0.0), lambda a, b: a + b)))


def score(df: DataFrame, keys=()) -> DataFrame:
    return out(df, list(keys), ["score"])


@query(f"WITH {PRED_SQL} SELECT {r6('avg(abs(p - y))', 'score')} FROM s")
def score_mae(spark, sf):
    return score(scoring.MeanAbsoluteError("p", "y").score(predicted(spark, sf)))


@query(f"WITH {PRED_SQL} SELECT {r6('sum((p - y) * (p - y) * w) / sum(w)', 'score')} FROM s")
def score_mse_weighted(spark, sf):
    return score(scoring.MeanSquaredError("p", "y", weight="w").score(predicted(spark, sf)))


@query(f"WITH {PRED_SQL} SELECT event_type, {r6('sqrt(avg((p - y) * (p - y)))', 'score')} FROM s WHERE y > 5 GROUP BY event_type")
def score_rmse_by_group(spark, sf):
    return score(scoring.RootMeanSquaredError("p", "y", granularity=["event_type"], filters=[Filter("y", 5, ">")]).score(predicted(spark, sf)), ["event_type"])


@query(f"WITH {PRED_SQL} SELECT {r6('-avg(CASE WHEN hit = 1 THEN ln(prob) ELSE ln(1 - prob) END)', 'score')} FROM s")
def score_log_loss(spark, sf):
    return score(scoring.LogLoss("prob", "hit").score(predicted(spark, sf)))


@query(f"WITH {PRED_SQL} SELECT {r6('avg(CASE WHEN (prob >= 0.5) = (hit = 1) THEN 1.0 ELSE 0 END)', 'score')} FROM s")
def score_accuracy(spark, sf):
    return score(scoring.Accuracy("prob", "hit").score(predicted(spark, sf)))


@query(f"""WITH {PRED_SQL}, g AS (SELECT event_type, prob, sum(hit) AS a, sum(1 - hit) AS b FROM s GROUP BY ALL),
u AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY event_type ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT event_type, {r6('sum(a * (below + b / 2)) / (sum(a) * sum(b))', 'score')} FROM u GROUP BY event_type""")
def score_auc_by_group(spark, sf):
    return score(scoring.AreaUnderCurve("prob", "hit", granularity=["event_type"]).score(predicted(spark, sf)), ["event_type"])


@query(f"WITH {PRED_SQL} SELECT {r6('avg(p - y)', 'score')} FROM s")
def score_bias(spark, sf):
    return score(scoring.MeanBias("p", "y").score(predicted(spark, sf)))


@query(f"WITH {PRED_SQL} SELECT {r6('(avg(p) FILTER (flag = 1) - avg(p) FILTER (flag = 0)) - (avg(y) FILTER (flag = 1) - avg(y) FILTER (flag = 0))', 'score')} FROM s")
def score_relative_bias(spark, sf):
    return score(scoring.MeanBias("p", "y", relative="flag").score(predicted(spark, sf)))


@query(f"WITH {CLASS_SQL} SELECT {r6('avg(p[2] + 2 * p[3] + 3 * p[4] + 4 * p[5] - y)', 'score')} FROM c")
def score_bias_lists(spark, sf):
    return score(scoring.MeanBias("p", "y", classes=[0, 1, 2, 3, 4]).score(classed(spark, sf)))


@query(f"WITH {CLASS_SQL} SELECT {r6('avg(p[1] * y * y + p[2] * (1 - y) * (1 - y) + p[3] * (2 - y) * (2 - y) + p[4] * (3 - y) * (3 - y) + p[5] * (4 - y) * (4 - y))', 'score')} FROM c")
def score_pwmse(spark, sf):
    return score(scoring.ProbabilityWeightedSquaredError("p", "y", classes=[0, 1, 2, 3, 4]).score(classed(spark, sf)))


_RPS = " + ".join(f"pow(list_sum(p[1:{k + 1}]) - (CASE WHEN y <= {k} THEN 1 ELSE 0 END), 2)" for k in range(4))


@query(f"WITH {CLASS_SQL} SELECT event_type, {r6(f'avg(({_RPS}) / 4)', 'score')} FROM c GROUP BY event_type")
def score_rps_by_group(spark, sf):
    return score(scoring.RankedProbability("p", "y", classes=[0, 1, 2, 3, 4], granularity=["event_type"]).score(classed(spark, sf)), ["event_type"])


_INSIDE = "least(0.9999, greatest(0.0001, {0}))"
_NAIVE_P = "list_value(" + ", ".join(f"avg(CASE WHEN y = {k} THEN 1.0 ELSE 0 END)" for k in range(5)) + ")"


def _ordinal(p: str) -> str:
    """The summed loss with every class present, as it is in these rows."""
    cum, terms = f"{p}[1]", []
    for k in range(1, 5):
        inside = _INSIDE.format(cum)
        terms.append(f"-(n[{k}] / total) * CASE WHEN y < {k} THEN ln({inside}) ELSE ln(1 - {inside}) END")
        cum = f"least(1.0, {inside} + {p}[{k + 1}])"
    return " + ".join(terms)


_COUNTS = "k AS (SELECT list_value(" + ", ".join(f"sum(CASE WHEN y = {i} THEN 1.0 ELSE 0 END)" for i in range(4)) + f") AS n, sum(CASE WHEN y < 4 THEN 1.0 ELSE 0 END) AS total, {_NAIVE_P} AS np FROM c)"


@query(f"WITH {CLASS_SQL}, {_COUNTS} SELECT {r6(f'avg({_ordinal("p")})', 'score')} FROM c, k")
def score_ordinal(spark, sf):
    return score(scoring.OrdinalLoss("p", "y", classes=[0, 1, 2, 3, 4]).score(classed(spark, sf)))


@query(f"WITH {CLASS_SQL}, {_COUNTS} SELECT {r6(f'avg({_ordinal("np")}) - avg({_ordinal("p")})', 'score')} FROM c, k")
def score_ordinal_naive(spark, sf):
    return score(scoring.OrdinalLoss("p", "y", classes=[0, 1, 2, 3, 4], naive=True).score(classed(spark, sf)))


_CUT = "list_transform(p, lambda x: least(1 - 1e-15, greatest(1e-15, x)))"


@query(f"WITH {CLASS_SQL} SELECT event_type, {r6(f'-avg(ln({_CUT}[y + 1] / list_sum({_CUT})))', 'score')} FROM c GROUP BY event_type")
def score_class_log_loss(spark, sf):
    return score(scoring.ClassLogLoss("p", "y", classes=[0, 1, 2, 3, 4], granularity=["event_type"]).score(classed(spark, sf)), ["event_type"])


@query(f"WITH {CLASS_SQL} SELECT {r6('avg(CASE WHEN list_position(p, list_max(p)) = y + 1 THEN 1.0 ELSE 0 END)', 'score')} FROM c")
def score_class_accuracy(spark, sf):
    return score(scoring.ClassAccuracy("p", "y", classes=[0, 1, 2, 3, 4]).score(classed(spark, sf)))


@query(f"""WITH {CLASS_SQL}, g AS (SELECT event_type, y, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT event_type, y AS mode FROM g QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, y) = 1)
SELECT event_type, {r6('avg(CASE WHEN mode = y THEN 1.0 ELSE 0 END) - avg(CASE WHEN list_position(p, list_max(p)) = y + 1 THEN 1.0 ELSE 0 END)', 'score')} FROM c JOIN m USING (event_type) GROUP BY event_type""")
def score_class_accuracy_naive(spark, sf):
    """Against the commonest class of each group."""
    return score(scoring.ClassAccuracy("p", "y", classes=[0, 1, 2, 3, 4], granularity=["event_type"], naive=True).score(classed(spark, sf)), ["event_type"])


@query(f"WITH {PRED_SQL} SELECT {r6('sqrt(sum(w * (p - y) * (p - y)) / sum(w))', 'score')} FROM s WHERE flag = 1 AND user_id < 60")
def score_validation(spark, sf):
    """Validation rows only, filtered and weighted."""
    df = predicted(spark, sf).withColumn("is_validation", F.col("flag") == 1)
    return score(scoring.RootMeanSquaredError("p", "y", validation="is_validation", filters=[Filter("user_id", 60, "<")], weight="w").score(df))


@query(f"""WITH {CLASS_SQL}, g AS (SELECT user_id, event_type, [{', '.join(f'avg(p[{k}])' for k in range(1, 6))}] AS p, min(y) AS y, sum(thr) AS thr FROM c GROUP BY user_id, event_type)
SELECT event_type, {r6(f'sum(thr * ({_RPS}) / 4) / sum(thr)', 'score')} FROM g GROUP BY event_type""")
def score_list_level_weighted(spark, sf):
    s = scoring.RankedProbability("p", "y", classes=[0, 1, 2, 3, 4], level=["user_id", "event_type"], how={"pred": "mean", "target": "first"}, granularity=["event_type"], weight="thr")
    return score(s.score(classed(spark, sf)), ["event_type"])


_EVENT = "(CASE WHEN 0 >= t THEN p[1] ELSE 0 END + CASE WHEN 1 >= t THEN p[2] ELSE 0 END + CASE WHEN 2 >= t THEN p[3] ELSE 0 END + CASE WHEN 3 >= t THEN p[4] ELSE 0 END + CASE WHEN 4 >= t THEN p[5] ELSE 0 END)"


@query(f"""WITH {CLASS_SQL}, x AS (SELECT *, round_even(thr, 0) AS t FROM c), q AS (SELECT greatest(1e-15, least(1 - 1e-15, {_EVENT})) AS q, y >= t AS hit FROM x)
SELECT {r6('-avg(CASE WHEN hit THEN ln(q) ELSE ln(1 - q) END)', 'score')} FROM q""")
def score_threshold_event(spark, sf):
    return score(scoring.ThresholdEvent("p", "y", classes=[0, 1, 2, 3, 4], threshold="thr").score(classed(spark, sf)))


@query(f"WITH {PRED_SQL}, b AS (SELECT *, avg(y) OVER (PARTITION BY event_type) AS m FROM s) SELECT {r6('avg(abs(m - y)) - avg(abs(p - y))', 'score')} FROM b")
def score_naive(spark, sf):
    return score(scoring.MeanAbsoluteError("p", "y", naive=True, naive_granularity=["event_type"]).score(predicted(spark, sf)))


@query(f"WITH {PRED_SQL}, g AS (SELECT user_id, sum(p * w) / sum(w) AS p, avg(y) AS y FROM s GROUP BY user_id) SELECT {r6('avg(abs(p - y))', 'score')} FROM g")
def score_by_level(spark, sf):
    return score(scoring.MeanAbsoluteError("p", "y", level=["user_id"], how={"pred": ("weighted_mean", "w"), "target": "mean"}).score(predicted(spark, sf)))


@query(f"""WITH {CLASS_SQL}, g AS (SELECT user_id, [{', '.join(f'avg(p[{k}])' for k in range(1, 6))}] AS p, min(y) AS y FROM c GROUP BY user_id) SELECT {r6(f'avg(({_RPS}) / 4)', 'score')} FROM g""")
def score_list_level(spark, sf):
    return score(scoring.RankedProbability("p", "y", classes=[0, 1, 2, 3, 4], level=["user_id"], how={"pred": "mean", "target": "first"}).score(classed(spark, sf)))


# -- distributions and models --------------------------------------------------------------------


def exploded(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return out(df.select(*keys, F.posexplode(column).alias("k", "p")), [*keys, "k"], ["p"])


@query(f"""WITH e AS (SELECT event_id, abs(value) / 10 + 0.1 AS mu, 2.0 + event_id % 5 AS r FROM events), k AS (SELECT unnest(range(0, 21)) AS k),
x AS (SELECT event_id, CAST(k AS INTEGER) AS k, exp(lgamma(k + r) - lgamma(r) - lgamma(k + 1) + k * ln(mu / (r + mu)) + r * ln(r / (r + mu))) AS p FROM e, k)
SELECT event_id, k, {r6('p / sum(p) OVER (PARTITION BY event_id)', 'p')} FROM x""")
def negative_binomial(spark, sf):
    e = inputs.entity_events(spark, sf).select("event_id", (F.abs("value") / 10 + 0.1).alias("mu"), (F.lit(2.0) + F.col("event_id") % 5).alias("r"))
    return exploded(e.withColumn("p", dist.negative_binomial(F.col("mu"), F.col("r"), 0, 20)), ["event_id"], "p")


@query()
def negative_binomial_fitted(spark, sf):
    """Dispersion by event type, then the distribution of each row around its rolling mean."""
    e = inputs.entity_events(spark, sf).withColumn("n", F.round(F.abs("value") / 5))
    g = Rolling("n", PLAYERS, EVENTS, size=10)
    rows = g.transform(e).where(F.col(g.features_out[0]) > 0)
    r = dist.fit_dispersion(rows, g.features_out[0], "n", ["event_type"])
    rows = rows.join(F.broadcast(r), "event_type").withColumn("p", dist.negative_binomial(F.col(g.features_out[0]), F.col("r"), 0, 30))
    return exploded(rows, ["event_id"], "p")


_SERIES = "sum(exp((2 * j + 1) * ln(abs(x)) - x * x / 2 - lgamma(j + 1.5) - (j + 1) * ln(2) + 0.5 * ln(pi()))) / sqrt(2 * pi())"


@query(f"""WITH b AS (SELECT event_id, CAST(k AS INTEGER) AS k, (k - 0.5 - value / 10) / 2.5 + 1e-15 AS x FROM events, (SELECT unnest(range(0, 14)) AS k)),
c AS (SELECT event_id, k, x, 0.5 + sign(x) * CASE WHEN abs(x) > 8 THEN 0.5 ELSE {_SERIES} END AS c FROM b, (SELECT unnest(range(0, 150)) AS j) GROUP BY event_id, k, x)
SELECT a.event_id, a.k, {r6('b.c - a.c', 'p')} FROM c a JOIN c b ON a.event_id = b.event_id AND b.k = a.k + 1""")
def normal_distribution(spark, sf):
    """The distribution function in SQL is its power series."""
    e = inputs.entity_events(spark, sf).withColumn("p", dist.normal(F.col("value") / 10, 2.5, 0, 12))
    return exploded(e, ["event_id"], "p")


_T5 = "0.5 + (x / (sqrt(5.0) * (1 + x * x / 5)) * (1 + 2 / (3 * (1 + x * x / 5))) + atan(x / sqrt(5.0))) / pi()"


@query(f"""WITH {PRED_SQL}, q AS (SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS q FROM s), r AS (SELECT event_id, p, y - p AS e, len(list_filter(q, lambda v: v < p)) AS cell FROM s, q),
m AS (SELECT cell, greatest(1.4826 * mad(e), 0.001) AS sigma, count(*) AS n FROM r GROUP BY cell), a AS (SELECT greatest(1.4826 * mad(e), 0.001) AS sigma FROM r),
b AS (SELECT event_id, CAST(k AS INTEGER) AS k, (k - 0.5 - p / 10) / (CASE WHEN n >= 30 THEN m.sigma ELSE a.sigma END / 10) AS x FROM r JOIN m USING (cell), a, (SELECT unnest(range(0, 14)) AS k)),
c AS (SELECT event_id, k, {_T5} AS c FROM b), d AS (SELECT u.event_id, u.k, v.c - u.c AS p FROM c u JOIN c v ON u.event_id = v.event_id AND v.k = u.k + 1)
SELECT event_id, k, {r6('p / sum(p) OVER (PARTITION BY event_id)', 'p')} FROM d""")
def student_t_distribution(spark, sf):
    """Scales by cells of the predictions; five degrees of freedom have a closed form."""
    rows = predicted(spark, sf)
    fitted = dist.StudentT("p", "y", low=0, high=12, degrees=5.0, divide=10.0).fit(rows)
    return exploded(fitted.transform(rows), ["event_id"], "distribution")


@query(f"""WITH t AS (SELECT event_id, epoch_us(ts) / 86400e6 AS t FROM events) SELECT event_id, {r6('(t - min(t) OVER () + 0.1) / (2 * (max(t) OVER () - min(t) OVER ()) + 0.1)', 'weight')} FROM t""")
def day_weights(spark, sf):
    return out(est.day_weighted(inputs.entity_events(spark, sf), "ts", "weight"), ["event_id"], ["weight"])


def modelled(spark, sf) -> DataFrame:
    g = Rolling("value", PLAYERS, EVENTS, size=10)
    df = g.transform(inputs.entity_events(spark, sf).select("event_id", "ts", "user_id", "event_type", "value")).withColumnRenamed(g.features_out[0], "form")
    return df.withColumns({"high": (F.col("value") > 50).cast("double"), "level": F.floor(F.least(F.lit(3.0), F.greatest(F.lit(0.0), F.col("value") / 30)))})


_FORM = f"""g AS (SELECT *, avg(value) OVER {frame(10)} AS x FROM events), h AS (SELECT event_id, ts, user_id, event_type, value,
  last_value(x IGNORE NULLS) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS form FROM g)"""
LINE = est.Model("linear", "value", features=("form",))


FORM = est.Model("linear", "value", features=("form", "event_type"))


@query()
def model_pipeline(spark, sf):
    df = modelled(spark, sf)
    return out(FORM.fit(df).transform(df), ["event_id"], ["prediction"])


@query()
def cv_predictions(spark, sf):
    df = modelled(spark, sf)
    m = est.Model("logistic", "high", features=("form", "event_type"))
    return est.MatchKFold(EVENTS, n_splits=2).predictions(df, m).select("event_id", F.round(F.col("probability")[1], 6).alias("p"), "is_validation")


_CV = f"""WITH {_FORM}, n AS (SELECT *, dense_rank() OVER (ORDER BY ts, event_id) - 1 AS k FROM h), d AS (SELECT list(DISTINCT ts ORDER BY ts) AS ds FROM events),
b AS (SELECT min(k) AS lo, greatest(1, ((SELECT max(k) FROM n) - min(k)) // 2) AS step FROM n, d WHERE ts >= ds[len(ds) // 2 + 1]),
i AS (SELECT 0 AS i, lo AS cut, lo + step AS upto FROM b UNION ALL SELECT 1, lo + step, 1000000000000 FROM b),
u AS (SELECT i, avg(form) AS filled FROM n, i WHERE k < cut GROUP BY i),
m AS (SELECT i.i, any_value(filled) AS filled, regr_slope(value, coalesce(form, filled)) AS a, regr_intercept(value, coalesce(form, filled)) AS b FROM n, i JOIN u ON i.i = u.i WHERE k < cut GROUP BY i.i)"""


@query(f"""{_CV} SELECT event_id, {r6('a * coalesce(form, filled) + b', 'prediction')}, true AS is_validation FROM n, i JOIN m ON i.i = m.i WHERE k >= cut AND k < upto""")
def cv_linear(spark, sf):
    """Validation rows, each predicted from earlier matches only."""
    rows = est.MatchKFold(EVENTS, n_splits=2).predictions(modelled(spark, sf), LINE)
    return out(rows, ["event_id", "is_validation"], ["prediction"])


@query(f"""{_CV} SELECT event_id, {r6('a * coalesce(form, filled) + b', 'prediction')} FROM n, i JOIN m ON i.i = m.i WHERE k >= cut AND k < upto OR i.i = 0 AND k < cut""")
def regressor_feature(spark, sf):
    rows, _ = est.RegressorFeature(LINE, est.MatchKFold(EVENTS, n_splits=2)).fit(modelled(spark, sf))
    return out(rows, ["event_id"], ["prediction"])


_LINE = f"WITH {_FORM}, u AS (SELECT avg(form) AS filled FROM h), z AS (SELECT event_id, ts, event_type, user_id, value, coalesce(form, filled) AS x FROM h, u)"


@query(f"{_LINE}, m AS (SELECT regr_slope(value, x) AS a, regr_intercept(value, x) AS b FROM z) SELECT event_id, {r6('value - (a * x + b)', 'net_over_predicted')} FROM z, m")
def net_over_predicted(spark, sf):
    df = modelled(spark, sf)
    return out(est.NetOverPredicted(LINE).fit(df).transform(df), ["event_id"], ["net_over_predicted"])


@query(f"""WITH {_FORM}, u AS (SELECT avg(form) AS filled FROM h WHERE event_id % 9 <> 0), z AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN value END AS value, coalesce(form, filled) AS x FROM h, u),
m AS (SELECT regr_slope(value, x) AS a, regr_intercept(value, x) AS b FROM z) SELECT event_id, {r6('coalesce(value, a * x + b)', 'value')} FROM z, m""")
def imputed_by_model(spark, sf):
    df = modelled(spark, sf).withColumn("value", F.when(F.col("event_id") % 9 != 0, F.col("value")))
    return out(est.Imputed(LINE).fit(df).transform(df), ["event_id"], ["value"])


_W = "((epoch_us(ts) / 86400e6 - lo + 0.1) / (2 * (hi - lo) + 0.1))"


@query(f"""WITH {_FORM}, f AS (SELECT *, least(90.0, greatest(5.0, value)) AS y FROM h WHERE event_type <> 'view' AND event_id % 11 <> 0), u AS (SELECT avg(form) AS filled, min(epoch_us(ts) / 86400e6) AS lo, max(epoch_us(ts) / 86400e6) AS hi FROM f),
w AS (SELECT y, coalesce(form, filled) AS x, {_W} AS w FROM f, u), c AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w),
m AS (SELECT sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS a, any_value(mx) AS mx, any_value(my) AS my FROM w, c)
SELECT event_id, {r6('least(55.0, greatest(45.0, my + a * (coalesce(form, filled) - mx)))', 'prediction')} FROM h, m, u""")
def model_with_filters(spark, sf):
    """Row filters, dropped null targets, a clipped target and day weights at fitting only; clipped predictions of all rows."""
    df = modelled(spark, sf).withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value")))
    m = est.Model("linear", "value", features=("form",), filters=(Filter("event_type", "view", "!="),), min_target=5, max_target=90, day_weight="ts", min_prediction=45, max_prediction=55)
    return out(m.fit(df).transform(df), ["event_id"], ["prediction"])


@query(f"""WITH {_FORM}, z AS (SELECT event_id, CAST(ts AS DATE) AS day, value, coalesce(form, 0) AS x FROM h), a AS (SELECT regr_slope(value, x) AS a, regr_intercept(value, x) AS b FROM z),
d AS (SELECT day, avg(x) AS x, avg(value) AS value FROM z GROUP BY day), gm AS (SELECT regr_slope(value, x) AS ga, regr_intercept(value, x) AS gb FROM d)
SELECT event_id, {r6('(a.a * z.x + a.b) / (ga * d.x + gb)', 'ratio')} FROM z JOIN d ON z.day = d.day, a, gm""")
def ratio_to_group(spark, sf):
    df = modelled(spark, sf).fillna({"form": 0.0}).withColumn("day", F.to_date("ts"))
    return out(est.Ratio(LINE, ("day",)).fit(df).transform(df), ["event_id"], ["ratio"])


@query(f"""WITH {_FORM}, z AS (SELECT event_id, event_type, value, coalesce(form, avg(form) OVER (PARTITION BY event_type)) AS x FROM h),
m AS (SELECT event_type, regr_slope(value, x) AS a, regr_intercept(value, x) AS b FROM z GROUP BY event_type) SELECT event_id, {r6('a * x + b', 'prediction')} FROM z JOIN m USING (event_type)""")
def model_by_value(spark, sf):
    df = modelled(spark, sf)
    return out(est.ByValue(LINE, "event_type").fit(df).transform(df), ["event_id"], ["prediction"])


@query(f"""WITH {SQUADS_SQL}, g AS (SELECT match_id, team_id, CASE WHEN sum(weight) <> 0 THEN sum(points * weight) / sum(weight) ELSE avg(points) END AS x, CASE WHEN sum(weight) <> 0 THEN sum(lines * weight) / sum(weight) ELSE avg(lines) END AS z, sum(points) AS y FROM squads GROUP BY ALL),
c AS (SELECT covar_pop(x, x) AS xx, covar_pop(x, z) AS xz, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM g),
m AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b FROM c)
SELECT squads.match_id, squads.team_id, player_id, {r6('my + a * (x - mx) + b * (z - mz)', 'prediction')} FROM squads JOIN g ON squads.match_id = g.match_id AND squads.team_id = g.team_id, m""")
def group_model(spark, sf):
    df = inputs.squad_matches(spark, sf)
    m = est.Model("linear", "team_points", features=("points", "lines"), granularity=("match_id", "team_id"), aggregation_weight="weight")
    df = df.withColumn("team_points", F.sum("points").over(Window.partitionBy("match_id", "team_id")))
    return out(m.fit(df).transform(df), ["match_id", "team_id", "player_id"], ["prediction"])


@query()
def ordinal_classifier(spark, sf):
    df = modelled(spark, sf)
    return exploded(est.Ordinal(est.Model("logistic", "level", features=("form", "event_type"))).fit(df).transform(df), ["event_id"], "probability")


@query()
def frequency_bucketing(spark, sf):
    df = modelled(spark, sf)
    return exploded(est.FrequencyBuckets(est.Model("logistic", "level", features=("form", "event_type")), least=0.2).fit(df).transform(df), ["event_id"], "probability")


@query()
def conditional_classifier(spark, sf):
    df = modelled(spark, sf).withColumn("distance", F.lit(2.0))
    return exploded(est.Conditional(est.Model("logistic", "level", features=("form", "event_type", "distance")), "distance").fit(df).transform(df), ["event_id"], "probability")


@query()
def tuned_model(spark, sf):
    """A random search over ridge strengths by cross-validated error; all trials are returned."""
    folds = est.MatchKFold(EVENTS, n_splits=1).prepared(modelled(spark, sf))

    def objective(params: dict) -> float:
        m = est.Model("linear", "value", features=("form", "event_type"), params=params)
        return scoring.MeanAbsoluteError("prediction", "value").value(folds.predictions(m))

    _, _, tried = est.search(objective, {"regParam": est.SPACES["linear"]["regParam"]}, trials=3)
    folds.release()
    return spark.createDataFrame([(k, float(p["regParam"]), float(s)) for k, (p, s) in enumerate(tried)], "trial int, reg double, score double")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


