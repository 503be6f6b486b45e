"""Match-structured inputs derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import GameRoles, Roles
from ..functions.frames import nan_to_null
from .tables import table

EVENTS = Roles(match="event_id", team="user_id", date="ts", player="user_id", league="event_type")
DUELS = Roles(match="match_id", team="team_id", date="start_date")
SQUADS = Roles(match="match_id", team="team_id", date="start_date", player="player_id", weight="weight")
TASK_ROWS = 750_000
GAMES = GameRoles(match="match_id", date="start_date", team1="team1", team2="team2", pairs={"score": ("score1", "score2")})


def entity_events(spark: SparkSession, root: str) -> DataFrame:
    """One stream of events an entity."""
    df = table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return nan_to_null(df)


def games(spark: SparkSession, root: str) -> DataFrame:
    """One row a match: consecutive events of two different users."""
    e = table(spark, root, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e = e.withColumn("match_id", F.expr("event_id DIV 2"))
    one = e.where("event_id % 2 = 0").select("match_id", F.col("ts").alias("start_date"), F.col("user_id").alias("team1"), F.col("value").alias("score1"), F.col("event_type").alias("league"))
    two = e.where("event_id % 2 = 1").select("match_id", F.col("user_id").alias("team2"), F.col("value").alias("score2"))
    return one.join(two, "match_id").where("team1 <> team2")


def duel_matches(spark: SparkSession, root: str) -> DataFrame:
    """Two rows a match, with the winner as performance 1, 0.5 or 0."""
    from ..operators.shaping import wide_to_long

    long = wide_to_long(games(spark, root), GAMES, carry=("league",))
    perf = F.when(F.col("score") > F.col("opponent_score"), 1.0).when(F.col("score") < F.col("opponent_score"), 0.0).otherwise(0.5)
    return long.withColumn("perf", perf)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Dealt by ``keys`` to tasks of about ``TASK_ROWS``, so that what a task holds doesn't grow with the input."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def squad_matches(spark: SparkSession, root: str) -> DataFrame:
    """Orders served by suppliers of exactly two regions: suppliers are players, regions teams."""
    # One exchange by order serves the grouping, the window and the join with orders. Suppliers
    # and nations are joined one after the other before it, each broadcast if Spark finds it small.
    li = table(spark, root, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    n = li.count()
    suppliers = table(spark, root, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nations = table(spark, root, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    li = dealt(li.join(suppliers, "l_suppkey").join(nations, "s_nationkey"), n, "l_orderkey")
    rows = li.groupBy("l_orderkey", "l_suppkey", "n_regionkey", "s_nationkey").agg(
        F.sum("l_quantity").cast("double").alias("points"), F.sum(F.col("l_quantity") * F.col("l_discount")).cast("double").alias("points2"), F.count("*").alias("lines"), F.max("l_tax").cast("double").alias("weight")
    )
    match = Window.partitionBy("l_orderkey")
    least, most = F.min("n_regionkey").over(match), F.max("n_regionkey").over(match)
    between = F.max(F.when((F.col("n_regionkey") > F.col("__lo")) & (F.col("n_regionkey") < F.col("__hi")), 1)).over(match)
    rows = rows.withColumns({"__lo": least, "__hi": most}).withColumn("__more", between).where("__lo < __hi AND __more IS NULL")
    orders = table(spark, root, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("timestamp").alias("start_date"))
    out = rows.join(orders, "l_orderkey")
    return out.select(
        F.col("l_orderkey").alias("match_id"), F.col("n_regionkey").alias("team_id"), F.col("l_suppkey").alias("player_id"), "start_date",
        "points", "points2", "lines", "weight", F.col("s_nationkey").alias("league"),
    )
