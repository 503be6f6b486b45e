"""Sequential offence and defence ratings of teams and players.

Match t needs both sides' state after all earlier batches, so matches are folded in
order. Spark pairs the sides, attaches what the fold needs, and sorts; the fold streams
over sorted matches in one task for each independent competition (``independent``), keeps
states as lists by entity, and emits pre-match values. A match costs about the same however
many entities there are: start ratings come from sorted runs, and what all active players
are shifted by is one number. Everything before and after is expressions. Configurations run side by side as further competitions (``with_trials``): their
matches are paired once and folded in a task each.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Roles
from ..functions.frames import day_number, finite, sigmoid

EXPECTED_CONFIDENCE = 30.0


@dataclass(frozen=True)
class StartRating:
    """Where an unseen entity starts."""

    fixed: float | None = None
    leagues: dict = field(default_factory=dict)
    default: float = 1000.0
    quantile: float = 0.2
    least_count: int = 50
    max_days: int = 600
    team_weight: float = 0.0
    team_subtract: float = 80.0
    team_least_games: int = 2


@dataclass(frozen=True)
class RatingConfig:
    """All knobs; unknown ones are refused by the constructor."""

    predictor: str = "difference"  # difference, mean, ignore_opponent
    coef: float | None = None
    team_from_entity_coef: float = 0.0
    team_diff_coef: float = 0.0
    max_predict: float = 1.0
    last_samples: int = 1500
    least_samples: int = 200
    reference: float = 1000.0
    offence_multiplier: float = 50.0
    defence_multiplier: float = 50.0
    confidence_days_multiplier: float = 0.06
    confidence_max_days: float = 90.0
    confidence_denominator: float = 140.0
    confidence_max: float = 150.0
    confidence_weight: float = 0.9
    least_ratio: float = 0.1
    split: bool = True
    start: StartRating = StartRating()
    mean_adjustment: bool = False
    adjust_every: int = 50
    active_days: int = 250
    adjust_target: float = 1000.0
    future_opponent: str = "defence"  # what a projected offence meets; "offence" as some published engines do

    def __post_init__(self):
        if self.predictor not in ("difference", "mean", "ignore_opponent"):
            raise ValueError(f"unknown predictor {self.predictor!r}")

    @property
    def slope(self) -> float:
        return self.coef if self.coef is not None else 0.0015 if self.predictor == "ignore_opponent" else 0.005757


def logistic(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x)) if x >= 0 else math.exp(x) / (1.0 + math.exp(x))


class Predictor:
    """Expected performance of a rating against an opponent's, inside the own team."""

    def __init__(self, c: RatingConfig, team_level: bool):
        self.c, self.team_level = c, team_level
        self.sum, self.n, self.recent = 0.0, 0, []

    def __call__(self, own: float, opponent: float, team: float | None = None) -> float:
        c = self.c
        if c.predictor == "ignore_opponent":
            ref = c.reference
            if self.team_level:
                ref = sum(self.recent) / len(self.recent) if len(self.recent) > c.least_samples else 1000.0
                self.recent = (self.recent + [own])[-c.last_samples :]
            return logistic(c.slope * (own - ref))
        if c.predictor == "mean":
            self.sum, self.n = self.sum + own, self.n + 1
            x = c.slope * (0.5 * own + 0.5 * opponent - self.sum / self.n)
        else:
            team = own if team is None else team
            x = c.slope * (own - opponent) + c.team_from_entity_coef * (team - own) + c.team_diff_coef * (team - opponent)
        return min(max(logistic(x), 1 - c.max_predict), c.max_predict)


def multipliers(config: RatingConfig, *bases: float):
    """By confidence: what the surprises of ``bases`` (offence, defence) are multiplied with."""
    denominator, weight = config.confidence_denominator, config.confidence_weight
    (o, d), (low_o, low_d) = bases, [b * config.least_ratio for b in bases]
    rest_o, rest_d = (1 - weight) * o, (1 - weight) * d

    def of(confidence: float) -> tuple[float, float]:
        x = (EXPECTED_CONFIDENCE - confidence) / denominator + 1
        m_o, m_d = o * x * weight + rest_o, d * x * weight + rest_d
        return m_o if m_o > low_o else low_o, m_d if m_d > low_d else low_d

    return of


class Ranked:
    """Numbers in order, in runs of bounded length, so that adding, removing and the k-th one stay cheap."""

    RUN = 512

    def __init__(self):
        self.runs: list[list[float]] = []
        self.tops: list[float] = []
        self.n = 0

    def _split(self, at: int) -> None:
        run = self.runs[at]
        if len(run) > 2 * self.RUN:
            self.runs[at : at + 1] = run[: self.RUN], run[self.RUN :]
            self.tops[at : at + 1] = run[self.RUN - 1], run[-1]

    def add(self, x: float) -> None:
        self.n += 1
        if not self.runs:
            self.runs, self.tops = [[x]], [x]
            return
        at = min(bisect_left(self.tops, x), len(self.runs) - 1)
        run = self.runs[at]
        insort(run, x)
        self.tops[at] = run[-1]
        self._split(at)

    def remove(self, x: float) -> None:
        self.n -= 1
        at = bisect_left(self.tops, x)
        run = self.runs[at]
        del run[bisect_left(run, x)]
        if run:
            self.tops[at] = run[-1]
        if len(run) < self.RUN // 2 and len(self.runs) > 1 or not run:  # joins a neighbour
            del self.runs[at], self.tops[at]
            if run:
                at = min(at, len(self.runs) - 1)
                self.runs[at] = run + self.runs[at] if run[-1] <= self.runs[at][0] else self.runs[at] + run
                self.tops[at] = self.runs[at][-1]
                self._split(at)

    def __getitem__(self, k: int) -> float:
        for run in self.runs:
            if k < len(run):
                return run[k]
            k -= len(run)
        raise IndexError(k)


class Starts:
    """Start ratings: fixed, or the league's until it knows enough recent players, then their quantile.

    What is learnt waits until a start rating is asked for; then only the players that played
    since the last time move in the order of their league.
    """

    def __init__(self, s: StartRating):
        self.s = s
        self.new: dict = {}  # player: (league, day, rating), not yet in order
        self.known: dict = {}  # player: the same
        self.counted: set = set()  # known players whose rating is in the order of their league
        self.order: dict[object, Ranked] = {}
        self.ages: dict[object, list] = {}  # (day, player) by league, a heap
        self.cut: dict = {}
        self.cache: dict = {}

    def learn(self, player, league, day: int, rating: float) -> None:
        self.new[player] = (league, day, rating)

    def _count(self, player, league, day: int, rating: float) -> None:
        self.counted.add(player)
        self.order.setdefault(league, Ranked()).add(rating)
        heappush(self.ages.setdefault(league, []), (day, player))

    def _settle(self) -> None:
        for player, now in self.new.items():
            if player in self.counted:
                league, _, rating = self.known[player]
                self.order[league].remove(rating)
            self.known[player] = now
            self._count(player, *now)
        self.new.clear()
        self.cache.clear()

    def _recent(self, league, cut: int) -> Ranked:
        """The ratings of a league's players that played on day ``cut`` or later."""
        order, ages = self.order.setdefault(league, Ranked()), self.ages.setdefault(league, [])
        if cut < self.cut.get(league, cut):  # days went back
            for player, (of, day, rating) in self.known.items():
                if of == league and day >= cut and player not in self.counted:
                    self._count(player, of, day, rating)
        self.cut[league] = cut
        while ages and ages[0][0] < cut:
            day, player = heappop(ages)
            if player in self.counted and self.known[player][:2] == (league, day):
                self.counted.discard(player)
                order.remove(self.known[player][2])
        return order

    def value(self, league, day: int, mates: list[tuple[float, float, float]] = ()) -> float:
        s = self.s
        if s.fixed is not None:
            return s.fixed
        if self.new:
            self._settle()
        key = (league, day)
        if key not in self.cache:
            recent = self._recent(league, day - s.max_days)
            if recent.n < s.least_count:
                self.cache[key] = s.leagues.get(league, s.default)
            else:
                at = s.quantile * (recent.n - 1)
                lo = int(at)
                hi = min(lo + 1, recent.n - 1)
                self.cache[key] = recent[lo] + (recent[hi] - recent[lo]) * (at - lo)
        start = self.cache[key]
        if s.team_weight > 0 and sum(g for _, g, _ in mates) >= s.team_least_games:
            w = sum(p for _, _, p in mates)
            team = sum(r * p for r, _, p in mates) / w if w > 0 else 0.0
            return start * (1 - s.team_weight) + s.team_weight * (team - s.team_subtract)
        return start


class Level:
    """Keeps the mean rating of the active players at a target, by shifting all of them together.

    The shift is one number: an active player's held ratings lack it, and get it for good when
    the player has been away for too long. The sum of what is held is kept with its rounding
    error, so it doesn't drift.
    """

    def __init__(self, off: list, dfn: list, target: float, days: int):
        self.off, self.dfn, self.target, self.days = off, dfn, target, days
        self.by, self.n, self.total, self.changes = 0.0, 0, (0.0, 0.0), []
        self.live: list[bool] = []
        self.on: dict[int, set] = {}  # active players by the day of their last match
        self.order: list[int] = []  # these days, a heap
        self.last: int | None = None

    def _held(self, k: int) -> float:
        return (self.off[k] + self.dfn[k]) / 2 - self.target

    def _on(self, k: int, day: int) -> None:
        if day not in self.on:
            self.on[day] = set()
            heappush(self.order, day)
        self.on[day].add(k)

    def enter(self, k: int, day: int) -> None:
        """A player's ratings, held in full so far, are shifted with the others from now on."""
        self.off[k] -= self.by
        self.dfn[k] -= self.by
        self.live[k] = True
        self.n += 1
        self.changes.append(self._held(k))
        self._on(k, day)

    def played(self, k: int, d_off: float, d_def: float, before: int | None, day: int) -> None:
        self.off[k] += d_off
        self.dfn[k] += d_def
        if not self.live[k]:
            self.enter(k, day)
            return
        self.changes.append((d_off + d_def) / 2)
        if before != day:
            self.on[before].discard(k)
            self._on(k, day)

    def leave(self, k: int) -> None:
        self.changes.append(-self._held(k))
        self.off[k] += self.by
        self.dfn[k] += self.by
        self.live[k] = False
        self.n -= 1

    def adjust(self, day: int, played: list) -> None:
        """``played``: the day of each player's last match."""
        if self.last is not None and day < self.last:  # days went back, players may be active again
            for k, before in enumerate(played):
                if before is not None and day - before <= self.days and not self.live[k]:
                    self.enter(k, before)
        self.last = day
        while self.order and self.order[0] < day - self.days:
            for k in self.on.pop(heappop(self.order)):
                self.leave(k)
        parts = [*self.total, *self.changes]
        high = math.fsum(parts)
        self.total = (high, math.fsum([*parts, -high]))
        self.changes.clear()
        if self.n:
            self.by = -(self.total[0] + self.total[1]) / self.n


def validate_performance(df: DataFrame, column: str) -> DataFrame:
    """``df``, if its performances are null or finite, within [-0.02, 1.02], with a mean in [0.42, 0.58]."""
    c = F.col(column).cast("double")
    r = df.agg(F.min(c), F.max(c), F.avg(finite(c)), F.count(F.when(F.isnan(c) | (F.abs(c) == float("inf")), 1))).first()
    if r[3] or r[0] is None or r[0] < -0.02 or r[1] > 1.02 or not 0.42 <= r[2] <= 0.58:
        raise ValueError(f"{column} must be finite, lie in [0, 1] and have a mean of about 0.5, found {r[0]} to {r[1]}, mean {r[2]}, {r[3]} not finite")
    return df


# -- teams ---------------------------------------------------------------

TEAM_OUT = ["team_off_rating_projected", "team_def_rating_projected", "opponent_off_rating_projected", "opponent_def_rating_projected", "team_predicted_off_performance", "team_predicted_def_performance"]


def team_matches(df: DataFrame, roles: Roles, performance: str | None, independent: tuple[str, ...] = ()) -> DataFrame:
    """One row a match, sides ordered by id. More or fewer than two teams raise when the plan runs."""
    side = F.struct(F.col(roles.team).alias("team"), (finite(F.col(performance)) if performance else F.lit(None).cast("double")).alias("perf"))
    keys = list(dict.fromkeys((roles.match, roles.batch, *independent)))
    league = [F.min(roles.league).cast("string").alias("league")] if roles.league else [F.lit(None).cast("string").alias("league")]
    m = df.groupBy(*keys).agg(F.min(roles.date).alias("date"), F.array_sort(F.collect_set(side)).alias("sides"), *league)
    two = F.when(F.size("sides") == 2, F.col("sides")).otherwise(F.raise_error(F.lit("a match needs exactly two teams")).cast(m.schema["sides"].dataType))
    m = m.withColumn("sides", two)
    return m.select(
        *independent, F.col(roles.match).alias("match"), F.col(roles.batch).alias("batch"), "date", day_number(F.col("date")).alias("day"), "league",
        *[F.col("sides")[k][x].alias(f"{x}{k}") for k in (0, 1) for x in ("team", "perf")],
    )


def team_fold(matches: DataFrame, config: RatingConfig | dict[str, RatingConfig], independent: tuple[str, ...] = (), state: list | None = None) -> DataFrame:
    """Pre-match values (match, team, ...) and, with kind 'state', the states after all matches.

    ``config``: by trial (the last of ``independent``), or one for all. ``state``: what the fold goes on from (``team_states``).
    """
    configs, whole = (config, None) if isinstance(config, dict) else (None, config)
    types = {c: t.simpleString() for c, t in ((f.name, f.dataType) for f in matches.schema.fields)}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in independent), "kind string", f"match {types['match']}", f"team {types['team0']}", *(f"{c} double" for c in TEAM_OUT), "confidence double", "games double", "day int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fold, like = None, None, None
        for b in batches:
            like = b.schema
            c = {n: b.column(n).to_pylist() for n in like.names}
            keys = list(zip(*[c[x] for x in independent])) if independent else [()] * b.num_rows
            for i, j in stretches(keys):
                if fold is None or keys[i] != at:
                    if fold is not None:
                        yield _team_states(at, fold, like, independent)
                    at, fold = keys[i], TeamFold(configs[keys[i][-1]] if configs else whole, state)
                values = fold.matches(c, i, j)
                twice = pa.array([r for r in range(i, j) for _ in (0, 1)], pa.int64())
                n = 2 * (j - i)
                team = pa.array([t for two in zip(c["team0"][i:j], c["team1"][i:j]) for t in two], like.field("team0").type)
                own = [b.column(x).take(twice) for x in (*independent, "match")]
                numbers = [pa.array(v, pa.float64()) for v in values]
                yield _out([*own[:-1], _words("match", n, like), own[-1], team, *numbers, pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int32())], [*independent, "kind", "match", "team", *TEAM_OUT, "confidence", "games", "day"])
        if fold is not None:
            yield _team_states(at, fold, like, independent)

    ordered = matches.repartition(*independent) if independent else matches.repartition(1)
    needed = [*independent, "match", "batch", "day", "league", "team0", "perf0", "team1", "perf1"]
    return ordered.sortWithinPartitions(*independent, "date", "batch", "match").select(*needed).mapInArrow(run, schema)


def stretches(keys: list) -> list[tuple[int, int]]:
    """Places (from, to) of equal neighbours."""
    cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)] if keys else []
    return list(zip(cuts, cuts[1:]))


def _words(word: str, n: int, like: pa.Schema) -> pa.Array:
    return pa.array([word] * n, like.field("league").type)


def _out(arrays: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _team_states(at: tuple, fold: TeamFold, like: pa.Schema, independent: tuple[str, ...]) -> pa.RecordBatch:
    fold.apply()
    n, none = len(fold.ids), pa.float64()
    own = [pa.array([v] * n, like.field(c).type) for c, v in zip(independent, at)]
    held = [pa.array(v, pa.float64()) for v in (fold.off, fold.dfn)]
    rest = [pa.array(fold.confidence, pa.float64()), pa.array(fold.games, pa.float64()), pa.array(fold.day, pa.int32())]
    return _out(
        [*own, _words("state", n, like), pa.nulls(n, like.field("match").type), pa.array(fold.ids, like.field("team0").type), *held, *[pa.nulls(n, none)] * 4, *rest],
        [*independent, "kind", "match", "team", *TEAM_OUT, "confidence", "games", "day"],
    )


class Fold:
    """States of one competition's entities, as lists by place."""

    def __init__(self, config: RatingConfig, team_level: bool):
        self.config, self.predict, self.starts = config, Predictor(config, team_level), Starts(config.start)
        self.at: dict = {}  # entity: place
        self.ids, self.off, self.dfn, self.confidence, self.games, self.day = [], [], [], [], [], []
        self.batch, self.queue = None, []
        # The difference of two ratings decides alone: no bounds, no part of the team.
        self.plain = config.predictor == "difference" and config.max_predict == 1.0 and not config.team_from_entity_coef and not config.team_diff_coef

    def add(self, entity, off: float, dfn: float, confidence: float = 0.0, games: float = 0.0, day: int | None = None) -> int:
        k = self.at[entity] = len(self.ids)
        for to, x in ((self.ids, entity), (self.off, off), (self.dfn, dfn), (self.confidence, confidence), (self.games, games), (self.day, day)):
            to.append(x)
        return k


class TeamFold(Fold):
    def __init__(self, config: RatingConfig, state: list | None):
        super().__init__(config, True)
        for row in state or ():
            self.add(*row)

    def apply(self) -> None:
        off, dfn, confidence, games, days, c = self.off, self.dfn, self.confidence, self.games, self.day, self.config
        longest, per_day, most = c.confidence_max_days, c.confidence_days_multiplier, c.confidence_max
        for k, d_off, d_def, day in self.queue:
            before = days[k]
            ago = 0.0 if before is None else float(day - before)
            x = confidence[k] - (ago if ago < longest else longest) * per_day + 1.0
            confidence[k] = 0.0 if x < 0.0 else x if x < most else most
            off[k] += d_off
            dfn[k] += d_def
            games[k] += 1.0
            days[k] = day
        self.queue.clear()

    def matches(self, c: dict[str, list], first: int, last: int) -> list[list[float]]:
        """TEAM_OUT for both sides of the matches ``first`` to ``last``."""
        config, predict, at, off, dfn, confidence, queue = self.config, self.predict, self.at, self.off, self.dfn, self.confidence, self.queue
        of, exp, slope, plain, split = multipliers(config, config.offence_multiplier, config.defence_multiplier), math.exp, config.slope, self.plain, config.split
        out: list[list[float]] = [[], [], [], [], [], []]
        own_off, own_def, other_off, other_def, p_offs, p_defs = (x.append for x in out)
        batches, days, leagues = c["batch"], c["day"], c["league"]
        for r, t0, t1, x0, x1 in zip(range(first, last), c["team0"][first:last], c["team1"][first:last], c["perf0"][first:last], c["perf1"][first:last]):
            if self.batch is not None and batches[r] != self.batch:
                self.apply()
            self.batch, day = batches[r], days[r]
            for t in (t0, t1):
                if t not in at:
                    start = self.starts.value(leagues[r], day)
                    self.add(t, start, start)
            a, b = at[t0], at[t1]
            for k, o, got, met in ((a, b, x0, x1), (b, a, x1, x0)):
                o_off, o_def, t_off, t_def = off[k], dfn[k], off[o], dfn[o]
                if plain:
                    x, y = slope * (o_off - t_def), slope * (o_def - t_off)
                    p_off = 1.0 / (1.0 + exp(-x)) if x >= 0 else exp(x) / (1.0 + exp(x))
                    p_def = 1.0 / (1.0 + exp(-y)) if y >= 0 else exp(y) / (1.0 + exp(y))
                else:
                    p_off, p_def = predict(o_off, t_def), predict(o_def, t_off)
                if not split:
                    p_def = p_off
                d_off = d_def = 0.0
                if got is not None:
                    kept = (1.0 - (met if met is not None else 0.0)) if split else got
                    m_off, m_def = of(confidence[k])
                    d_off, d_def = (got - p_off) * m_off, (kept - p_def) * m_def
                own_off(o_off), own_def(o_def), other_off(t_off), other_def(t_def), p_offs(p_off), p_defs(p_def)
                queue.append((k, d_off, d_def, day))
        return out


def team_features(df: DataFrame, folded: DataFrame, roles: Roles, independent: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the projected ratings, their difference and mean."""
    pre = folded.where("kind = 'match'").select(*independent, F.col("match").alias(roles.match), F.col("team").alias(roles.team), *TEAM_OUT)
    out = df.join(pre, [*independent, roles.match, roles.team], "left")
    return out.withColumns({
        "team_rating_projected": F.col("team_off_rating_projected"), "opponent_rating_projected": F.col("opponent_def_rating_projected"),
        "team_rating_difference_projected": F.col("team_off_rating_projected") - F.col("opponent_def_rating_projected"),
        "rating_mean_projected": (F.col("team_off_rating_projected") + F.col("opponent_def_rating_projected")) / 2,
    })


def team_states(folded: DataFrame) -> list:
    """The states of a fold without ``independent``, one a team, to go on from."""
    rows = folded.where("kind = 'state'").select("team", TEAM_OUT[0], TEAM_OUT[1], "confidence", "games", "day").collect()
    return [tuple(r) for r in rows]


def start_of(df: DataFrame, roles: Roles, start: StartRating) -> Column:
    """The start rating of unseen entities: fixed, by league, or the default."""
    if start.fixed is not None or not roles.league or not start.leagues:
        return F.lit(float(start.fixed if start.fixed is not None else start.default))
    by = F.create_map(*[F.lit(x) for k, v in start.leagues.items() for x in (str(k), float(v))])
    return F.coalesce(by[F.col(roles.league).cast("string")], F.lit(float(start.default)))


def predicted(own: Column, opponent: Column, config: RatingConfig, team: Column | None = None, reference: float | None = None) -> Column:
    """Expected performance from fixed states."""
    if config.predictor == "mean":
        raise ValueError("the mean predictor follows the matches in order; it can't be projected from states alone")
    if config.predictor == "ignore_opponent":
        return sigmoid(F.lit(config.slope) * (own - F.lit(config.reference if reference is None else reference)))
    team = own if team is None else team
    x = F.lit(config.slope) * (own - opponent) + F.lit(config.team_from_entity_coef) * (team - own) + F.lit(config.team_diff_coef) * (team - opponent)
    return F.least(F.greatest(sigmoid(x), F.lit(1 - config.max_predict)), F.lit(config.max_predict))


def project_teams(df: DataFrame, state: DataFrame, roles: Roles, config: RatingConfig = RatingConfig()) -> DataFrame:
    """Future rows against fitted states, which stay as they are; unseen teams get the start rating."""
    s = state.where("kind = 'state'").select(F.col("team").alias("__t"), F.col(TEAM_OUT[0]).alias("__o"), F.col(TEAM_OUT[1]).alias("__d"))
    start = start_of(df, roles, config.start)
    own = df.join(s, df[roles.team] == F.col("__t"), "left").withColumns({TEAM_OUT[0]: F.coalesce("__o", start), TEAM_OUT[1]: F.coalesce("__d", start)}).drop("__t", "__o", "__d")
    sides = own.select(F.col(roles.match).alias("__m"), F.col(roles.team).alias("__p"), F.col(TEAM_OUT[0]).alias(TEAM_OUT[2]), F.col(TEAM_OUT[1]).alias(TEAM_OUT[3])).distinct()
    out = own.join(sides, (F.col(roles.match) == F.col("__m")) & (F.col(roles.team) != F.col("__p")), "left").drop("__m", "__p")
    meets = F.col(TEAM_OUT[2] if config.future_opponent == "offence" else TEAM_OUT[3])
    out = out.withColumn(TEAM_OUT[4], predicted(F.col(TEAM_OUT[0]), meets, config, reference=1000.0))
    return out.withColumn(TEAM_OUT[5], predicted(F.col(TEAM_OUT[1]), F.col(TEAM_OUT[2]), config, reference=1000.0) if config.split else F.col(TEAM_OUT[4]))


# -- players -------------------------------------------------------------

PLAYER_OUT = ["player_off_rating", "player_def_rating", "player_predicted_off_performance", "player_predicted_def_performance"]


def player_matches(df: DataFrame, roles: Roles, performance: str, defence: str | None = None, extra: tuple[str, ...] = (), independent: tuple[str, ...] = ()) -> DataFrame:
    """What the fold reads: one row a player and match, in any order, without columns that nothing fills.
    ``kind`` 1; rows of kind 0 bring states."""
    w = F.coalesce(finite(F.col(roles.weight)), F.lit(None).cast("double")) if roles.weight else F.lit(1.0)
    pw = finite(F.col(roles.projected_weight)) if roles.projected_weight else w
    dw = finite(F.col(roles.defence_weight)) if roles.defence_weight else w
    league = F.col(roles.league).cast("string") if roles.league else F.lit(None).cast("string")
    times = {"with_team": roles.team_playing_time, "with_opponent": roles.opponent_playing_time}
    return df.select(
        *dict.fromkeys((*independent, *extra)), F.lit(1).alias("kind"), F.col(roles.match).alias("match"), F.col(roles.batch).alias("batch"),
        F.col(roles.date).alias("date"), day_number(F.col(roles.date)).alias("day"), F.col(roles.team).alias("team"), F.col(roles.player).alias("id"),
        finite(F.col(performance)).alias("perf"), w.alias("w"), pw.alias("pw"), dw.alias("dw"), league.alias("league"),
        *([finite(F.col(defence)).alias("def_perf")] if defence else []), *[playing_time(df, c).alias(n) for n, c in times.items() if c],
    )


STATE = [("held_off", "double"), ("held_def", "double"), ("confidence", "double"), ("games", "double")]


def _states(state: DataFrame, like: DataFrame, independent: tuple[str, ...]) -> DataFrame:
    """States of an earlier fold as rows of kind 0 that come before all matches."""
    own = {"kind": F.lit(0), "id": F.col("player"), "held_off": F.col(PLAYER_OUT[0]), "held_def": F.col(PLAYER_OUT[1])}
    own |= {c: F.col(c) for c in ("team", "day", "confidence", "games", "league", *independent)}
    types = [*((f.name, f.dataType) for f in like.schema.fields), *STATE]
    return state.where("kind = 'state'").select(*[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in types])


def playing_time(df: DataFrame, column: str):
    """A map of shares of playing time, or JSON text of one; bad JSON raises, nulls are dropped, empty is null."""
    c = F.col(column)
    if df.schema[column].dataType.simpleString() == "string":
        c = F.from_json(c, "map<string,double>", {"mode": "FAILFAST"})
    kept = F.map_filter(c.cast("map<string,double>"), lambda _, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def player_fold(rows: DataFrame, config: RatingConfig, independent: tuple[str, ...] = (), extra: tuple[str, ...] = (), has_defence: bool = False) -> DataFrame:
    """Pre-match values (match, team, player, ...) and, with kind 'state', the states after all
    matches, from rows of ``player_matches``. More or fewer than two teams in a match raise."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keep = list(dict.fromkeys((*independent, *extra)))
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "kind string", f"match {types['match']}", f"team {types['team']}", f"player {types['id']}", *(f"{c} double" for c in PLAYER_OUT), "confidence double", "games double", "day int", "league string"])
    names = [*keep, "kind", "match", "team", "player", *PLAYER_OUT, "confidence", "games", "day", "league"]
    read = [c for c in rows.columns if c in independent or c not in (*extra, "date")]

    def states(at: tuple, fold: PlayerFold, like: pa.Schema) -> pa.RecordBatch:
        fold.apply()
        n, known = len(fold.ids), dict(zip(independent, at))
        off, dfn = ([x + fold.level.by if on else x for x, on in zip(v, fold.level.live)] if fold.level else v for v in (fold.off, fold.dfn))
        own = [pa.array([known[c]] * n, like.field(c).type) if c in known else pa.nulls(n, like.field(c).type) for c in keep]
        ids = [pa.nulls(n, like.field("match").type), pa.array(fold.team, like.field("team").type), pa.array(fold.ids, like.field("id").type)]
        numbers = [pa.array(off, pa.float64()), pa.array(dfn, pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array(fold.confidence, pa.float64()), pa.array(fold.games, pa.float64()), pa.array(fold.day, pa.int32())]
        return _out([*own, _words("state", n, like), *ids, *numbers, pa.array(fold.league, like.field("league").type)], names)

    def played(b: pa.RecordBatch, i: int, j: int, values: list[list[float]]) -> pa.RecordBatch:
        n, like = j - i, b.schema
        own = lambda *of: [b.column(c).slice(i, n) for c in of]
        none = [pa.nulls(n, t) for t in (pa.float64(), pa.float64(), pa.int32(), like.field("league").type)]
        return _out([*own(*keep), _words("match", n, like), *own("match", "team", "id"), *[pa.array(v, pa.float64()) for v in values], *none], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fold, held = None, None, None

        def folded(b: pa.RecordBatch, whole: bool) -> Iterator[pa.RecordBatch]:
            """The matches of a batch; but for the last batch, the last one may go on in the next."""
            nonlocal at, fold, held
            c = {n: b.column(n).to_pylist() for n in read}
            key, kind = list(zip(*[c[x] for x in independent])) if independent else [()] * b.num_rows, c["kind"]
            places = stretches(list(zip(key, c["match"], c["batch"], kind, [0 if k else -r for r, k in enumerate(kind)])))
            held = None if whole else b.slice(places.pop()[0])
            n = 0
            while n < len(places):
                i = places[n][0]
                if fold is None or key[i] != at:
                    if fold is not None:
                        yield states(at, fold, b.schema)
                    at, fold = key[i], PlayerFold(config, has_defence)
                if kind[i] == 0:
                    fold.hold(c, i)
                    n += 1
                    continue
                first = n
                while n < len(places) and kind[places[n][0]] == 1 and key[places[n][0]] == at:
                    n += 1
                yield played(b, i, places[n - 1][1], fold.matches(c, places[first:n]))

        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if b.num_rows:
                yield from folded(b, False)
        if held is not None:
            like = held.schema
            yield from folded(held, True)
            yield states(at, fold, like)

    order = [*independent, "kind", "date", "batch", "match", "team", "id"]
    dealt = rows.repartition(*independent) if independent else rows.repartition(1)
    ordered = dealt.sortWithinPartitions(*order)
    return (ordered if "date" in keep else ordered.drop("date")).mapInArrow(run, schema)


class PlayerFold(Fold):
    def __init__(self, config: RatingConfig, has_defence: bool):
        super().__init__(config, False)
        self.has_defence, self.rounds = has_defence, 0
        self.team, self.league = [], []
        self.level = Level(self.off, self.dfn, config.adjust_target, config.active_days) if config.mean_adjustment else None

    def add(self, entity, off, dfn, confidence=0.0, games=0.0, day=None, team=None) -> int:
        self.team.append(team)
        self.league.append(None)
        if self.level:
            self.level.live.append(False)
        return super().add(entity, off, dfn, confidence, games, day)

    def hold(self, c: dict[str, list], r: int) -> None:
        """A state of an earlier fold."""
        day, league = c["day"][r], c["league"][r]
        k = self.add(c["id"][r], c["held_off"][r], c["held_def"][r], c["confidence"][r], c["games"][r], day, c["team"][r])
        if self.level and day is not None:
            self.level.enter(k, day)
        self.league[k] = league
        self.starts.learn(k, league, day or 0, c["held_off"][r])

    def apply(self) -> None:
        if not self.queue:
            return
        off, dfn, confidence, games, days, team, league, level, learnt, c = self.off, self.dfn, self.confidence, self.games, self.day, self.team, self.league, self.level, self.starts.new, self.config
        longest, per_day, most = c.confidence_max_days, c.confidence_days_multiplier, c.confidence_max
        for k, own, pre, d_off, d_def, day, of in self.queue:
            before = days[k]
            if level:
                level.played(k, d_off, d_def, before, day)
            else:
                off[k] += d_off
                dfn[k] += d_def
            ago = 0.0 if before is None else float(day - before)
            x = confidence[k] - (ago if ago < longest else longest) * per_day + 1.0
            confidence[k] = 0.0 if x < 0.0 else x if x < most else most
            games[k] += 1.0
            days[k] = day
            team[k], league[k] = own, of
            learnt[k] = (of, day, pre + d_off)
        day = self.queue[-1][5]
        self.queue.clear()
        if level:
            self.rounds += 1
            if self.rounds >= c.adjust_every:
                self.rounds = 0
                level.adjust(day, self.day)

    def _met(self, c: dict[str, list], sides: tuple, day: int) -> None:
        """Players that are new get the start rating."""
        ids, pw = c["id"], c["pw"]
        for side in sides:
            if all(ids[r] in self.at for r in side):
                continue
            known = []
            if self.config.start.team_weight > 0:
                known = [(self.rating(self.at[ids[r]]), self.games[self.at[ids[r]]], pw[r] or 0.0) for r in side if ids[r] in self.at]
            for r in side:
                if ids[r] not in self.at:
                    start = self.starts.value(c["league"][r], day, known)
                    self.add(ids[r], start, start)

    def rating(self, k: int) -> float:
        return self.off[k] + self.level.by if self.level and self.level.live[k] else self.off[k]

    def matches(self, c: dict[str, list], places: list[tuple[int, int]]) -> list[list[float]]:
        """PLAYER_OUT of the rows of matches, a match a place (from, to)."""
        config, predict, at, off, dfn, confidence, queue, level = self.config, self.predict, self.at, self.off, self.dfn, self.confidence, self.queue, self.level
        of, exp, slope, plain, split = multipliers(config, config.offence_multiplier, config.defence_multiplier), math.exp, config.slope, self.plain, config.split
        ids, teams, perf, w, pw, dw, days, batches, leagues = (c[x] for x in ("id", "team", "perf", "w", "pw", "dw", "day", "batch", "league"))
        def_perf, timed = c.get("def_perf") if self.has_defence else None, "with_team" in c or "with_opponent" in c
        base = places[0][0]
        out = [[0.0] * (places[-1][1] - base) for _ in range(4)]
        out_off, out_def, out_po, out_pd = out

        def mean(xs: list[float], weights: list) -> float:
            total = sum([x or 0.0 for x in weights])
            return sum([v * (x or 0.0) for v, x in zip(xs, weights)]) / total if total > 0 else sum(xs) / len(xs)

        def weighted(xs: list, side) -> float | None:
            """The mean of the values that are there, by ``w``."""
            seen = [(xs[r], w[r] or 0.0) for r in side if xs[r] is not None]
            total = sum([x for _, x in seen])
            return sum([v * x for v, x in seen]) / total if total > 0 else None

        def by_time(times, values: dict, fallback: float) -> float:
            known = {n: v for n, v in times.items() if n in values} if times else {}
            total = sum(known.values())
            return sum(values[n] * v for n, v in known.items()) / total if total > 0 else fallback

        for i, j in places:
            if self.batch is not None and batches[i] != self.batch:
                self.apply()
            self.batch, day, own = batches[i], days[i], teams[i]
            m = i + 1
            while m < j and teams[m] == own:
                m += 1
            if m < j and teams[m:j].count(teams[m]) == j - m:
                sides = (range(i, m), range(m, j))
            else:
                found = list(dict.fromkeys(teams[i:j]))
                if len(found) != 2:
                    raise ValueError(f"a match needs exactly two teams, {c['match'][i]} has {len(found)}")
                sides = tuple([r for r in range(i, j) if teams[r] == t] for t in found)
            ks = [at.get(x) for x in ids[i:j]]
            if None in ks:
                self._met(c, sides, day)
                ks = [at[x] for x in ids[i:j]]
            if level:
                by, live = level.by, level.live
                os = [off[k] + by if live[k] else off[k] for k in ks]
                ds = [dfn[k] + by if live[k] else dfn[k] for k in ks]
            else:
                os, ds = [off[k] for k in ks], [dfn[k] for k in ks]
            side_off, side_def, side_perf = [], [], []
            for side in sides:
                if len(side) == 1:
                    r = side[0]
                    x, v = pw[r] or 0.0, w[r] or 0.0
                    side_off.append(os[r - i] * x / x if x > 0 else os[r - i])
                    side_def.append(ds[r - i] * x / x if x > 0 else ds[r - i])
                    side_perf.append(perf[r] * v / v if perf[r] is not None and v > 0 else None)
                    continue
                weights = [pw[r] for r in side]
                side_off.append(mean([os[r - i] for r in side], weights))
                side_def.append(mean([ds[r - i] for r in side], weights))
                side_perf.append(weighted(perf, side))
            names_off, names_def = ({str(x): v for x, v in zip(ids[i:j], vs)} for vs in (os, ds)) if timed else (None, None)
            for s, o in ((0, 1), (1, 0)):
                kept = (1.0 - side_perf[o] if side_perf[o] is not None else None) if split else side_perf[s]
                team_mean = weighted(def_perf, sides[s]) if def_perf else None
                met_off, met_def = side_off[o], side_def[o]
                for r in sides[s]:
                    k, rated, defended, got, x_w, x_dw = ks[r - i], os[r - i], ds[r - i], kept, w[r], dw[r]
                    if plain and not timed:
                        x, y = slope * (rated - met_def), slope * (defended - met_off)
                        p_off = 1.0 / (1.0 + exp(-x)) if x >= 0 else exp(x) / (1.0 + exp(x))
                        p_def = 1.0 / (1.0 + exp(-y)) if y >= 0 else exp(y) / (1.0 + exp(y))
                    elif timed:
                        mates, others = (dict(c[n][r] or ()) if n in c else None for n in ("with_team", "with_opponent"))
                        p_off = predict(rated, by_time(others, names_def, met_def), by_time(mates, names_off, side_off[s]))
                        p_def = predict(defended, by_time(others, names_off, met_off), by_time(mates, names_def, side_def[s]))
                    else:
                        p_off, p_def = predict(rated, met_def, side_off[s]), predict(defended, met_off, side_def[s])
                    m_off, m_def = of(confidence[k])
                    d_off = 0.0 if perf[r] is None else (perf[r] - p_off) * m_off * (x_w if x_w is not None else 0.0)
                    if def_perf and got is not None and def_perf[r] is not None and team_mean is not None:
                        got = min(max(got + def_perf[r] - team_mean, 0.0), 1.0)
                    if not split:
                        p_def, got = p_off, perf[r]
                    d_def = 0.0 if got is None or x_dw is None else (got - p_def) * m_def * x_dw
                    at_ = r - base
                    out_off[at_], out_def[at_], out_po[at_], out_pd[at_] = rated, defended, p_off, p_def
                    queue.append((k, teams[r], rated, d_off, d_def, day, leagues[r]))
        return out


def player_ratings(
    df: DataFrame, roles: Roles, performance: str, config: RatingConfig = RatingConfig(), defence: str | None = None,
    extra: tuple[str, ...] = (), independent: tuple[str, ...] = (), state: DataFrame | None = None,
) -> DataFrame:
    """The fold of player matches, ready for ``player_features`` and state look-ups; ``state``: an earlier fold to go on from."""
    m = player_matches(df, roles, performance, defence, extra, independent)
    m = m.unionByName(_states(state, m, independent), allowMissingColumns=True) if state is not None else m
    return player_fold(m, config, independent, extra, defence is not None)


def project_players(df: DataFrame, state: DataFrame, roles: Roles, config: RatingConfig = RatingConfig()) -> DataFrame:
    """Future rows with PLAYER_OUT against fitted states, which stay as they are; unseen players get the start rating."""
    s = state.where("kind = 'state'").select(F.col("player").alias("__p"), F.col(PLAYER_OUT[0]).alias("__o"), F.col(PLAYER_OUT[1]).alias("__d"))
    start = start_of(df, roles, config.start)
    out = df.join(s, df[roles.player] == F.col("__p"), "left").withColumns({PLAYER_OUT[0]: F.coalesce("__o", start), PLAYER_OUT[1]: F.coalesce("__d", start)}).drop("__p", "__o", "__d")
    weight = roles.projected_weight or roles.weight
    side = Window.partitionBy(roles.match, roles.team)
    out = out.withColumns({"__to": weighted_over(PLAYER_OUT[0], weight, side), "__td": weighted_over(PLAYER_OUT[1], weight, side)})
    match = Window.partitionBy(roles.match)
    for c in ("o", "d"):
        least, most = (f(F.struct(F.col(roles.team).alias("t"), F.col(f"__t{c}").alias("v"))).over(match) for f in (F.min, F.max))
        out = out.withColumn(f"__x{c}", F.when(F.col(roles.team) == least["t"], most["v"]).otherwise(least["v"]))
    off, dfn = F.col(PLAYER_OUT[0]), F.col(PLAYER_OUT[1])
    out = out.withColumn(PLAYER_OUT[2], predicted(off, F.col("__xd"), config, F.col("__to")))
    out = out.withColumn(PLAYER_OUT[3], predicted(dfn, F.col("__xo"), config, F.col("__td")) if config.split else F.col(PLAYER_OUT[2]))
    return out.drop("__to", "__td", "__xo", "__xd")


def weighted_over(c: str, weight: str | None, w) -> Column:
    x = F.col(c)
    if weight is None:
        return F.avg(x).over(w)
    total = F.sum(weight).over(w)
    return F.when(total > 0, F.sum(x * F.col(weight)).over(w) / total).otherwise(F.avg(x).over(w))


def player_features(df: DataFrame, folded: DataFrame, roles: Roles, extra: tuple[str, ...] = (), independent: tuple[str, ...] = ()) -> DataFrame:
    """All derived rating features of player rows; sides meet by window sums, so no join of opponents is needed."""
    keep = list(dict.fromkeys((*independent, *extra)))
    pre = folded.where("kind = 'match'").select(*keep, F.col("match").alias(roles.match), F.col("team").alias(roles.team), F.col("player").alias(roles.player), *PLAYER_OUT)
    return derived_features(df.join(pre, [*keep, roles.match, roles.team, roles.player]), roles, keep)


def derived_features(out: DataFrame, roles: Roles, keep: list[str] = ()) -> DataFrame:
    """Team, opponent, difference and mean features of player rows, historical or projected, from PLAYER_OUT."""
    weight = roles.projected_weight or roles.weight
    side = Window.partitionBy(roles.match, *keep, roles.team)
    match = Window.partitionBy(roles.match, *keep)
    names = {"team_off_rating_projected": ("player_off_rating", weight), "team_def_rating_projected": ("player_def_rating", weight), "team_rating": ("player_off_rating", None)}
    out = out.withColumns({n: weighted_over(c, w, side) for n, (c, w) in names.items()})
    # The other side's value: of the two distinct (team, value) pairs of a match, the one that isn't the own.
    for own, other in (("team_off_rating_projected", "opponent_off_rating_projected"), ("team_def_rating_projected", "opponent_def_rating_projected"), ("team_rating", "opponent_rating")):
        least, most = (f(F.struct(F.col(roles.team).alias("t"), F.col(own).alias("v"))).over(match) for f in (F.min, F.max))
        out = out.withColumn(other, F.when(F.col(roles.team) == least["t"], most["v"]).otherwise(least["v"]))
    out = out.withColumns({"player_rating": F.col("player_off_rating"), "player_predicted_performance": F.col("player_predicted_off_performance"), "team_rating_projected": F.col("team_off_rating_projected"), "opponent_rating_projected": F.col("opponent_def_rating_projected")})
    return out.withColumns({
        "player_rating_difference_projected": F.col("player_rating") - F.col("opponent_def_rating_projected"),
        "player_rating_difference_from_team_projected": F.col("player_off_rating") - F.col("team_off_rating_projected"),
        "team_rating_difference_projected": F.col("team_rating_projected") - F.col("opponent_rating_projected"),
        "rating_mean_projected": weighted_over("player_off_rating", weight, match),
        "player_opponent_mean_projected": (F.col("player_rating") + F.col("opponent_rating_projected")) / 2,
        "team_rating_difference": F.col("team_rating") - F.col("opponent_rating"),
    })


def calibrated_reference(ratings: DataFrame, column: str, coef: float, low: float = 0.0, high: float = 3000.0, rounds: int = 40) -> float:
    """The anchor at which the mean expected performance is 0.5, by halving the bracket: one
    aggregation for each round, over 15 anchors inside it."""
    x = ratings.select(F.col(column).cast("double").alias("r")).where("r IS NOT NULL")
    if x.isEmpty():
        raise ValueError("there are no ratings to calibrate")
    mean = lambda at: F.avg(sigmoid(F.lit(coef) * (F.col("r") - F.lit(at))))
    ends = x.agg(mean(low), mean(high)).first()
    if ends[0] < 0.5 or ends[1] > 0.5:
        raise ValueError(f"no anchor between {low} and {high} gives a mean of one half")
    while rounds > 0 and high - low > 1e-9:
        at = [low + (high - low) * k / 16 for k in range(1, 16)]
        got = x.agg(*[mean(a) for a in at]).first()
        low, high = max([low, *(a for a, m in zip(at, got) if m >= 0.5)]), min([high, *(a for a, m in zip(at, got) if m < 0.5)])
        rounds -= 4
    return (low + high) / 2


def calibrated_player_ratings(df: DataFrame, roles: Roles, performance: str, config: RatingConfig, **how) -> tuple[DataFrame, RatingConfig]:
    """Two passes for the predictor that ignores opponents: the first gives the ratings that its reference is calibrated on."""
    if config.predictor != "ignore_opponent":
        raise ValueError("only the predictor that ignores opponents has a reference")
    first = player_ratings(df, roles, performance, config, **how).where("kind = 'match'")
    config = replace(config, reference=calibrated_reference(first, PLAYER_OUT[0], config.slope))
    return player_ratings(df, roles, performance, config, **how), config


def with_trials(matches: DataFrame, configs: dict[str, RatingConfig]) -> DataFrame:
    """A copy of paired matches for each trial, as an independent competition ``trial``; the fold takes ``configs``."""
    return matches.withColumn("trial", F.explode(F.array(*[F.lit(k) for k in configs])))


def optimise_league_starts(fit, leagues: dict, error_rows, rounds: int = 3, rate: float = 0.1, scale: float = 1.0, least_rows: int = 10) -> dict:
    """Moves league start ratings by the mean error of matches between leagues, refitting each round.

    ``fit(leagues)`` gives fitted rows; ``error_rows(rows)`` gives (league, error) rows of
    matches between leagues.
    """
    for _ in range(rounds):
        rows = error_rows(fit(dict(leagues)))
        for r in rows.groupBy("league").agg(F.avg("error").alias("e"), F.count("*").alias("n")).collect():  # one row a league
            if r["n"] >= least_rows and r["e"] is not None:
                leagues = {**leagues, r["league"]: leagues.get(r["league"], 1000.0) + rate * r["e"] * scale}
    return leagues
