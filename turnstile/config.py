"""Which columns of a table play which part in a match."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    """Physical column names by role. ``update`` names the batch whose rows share their
    state before the batch; it is the match unless given."""

    match: str
    team: str
    date: str
    player: str | None = None
    update: str | None = None
    parent_team: str | None = None
    league: str | None = None
    position: str | None = None
    weight: str | None = None
    projected_weight: str | None = None
    defence_weight: str | None = None
    projected_defence_weight: str | None = None
    team_playing_time: str | None = None
    opponent_playing_time: str | None = None
    other: tuple[str, ...] = ()

    @property
    def batch(self) -> str:
        return self.update or self.match

    @property
    def unique(self) -> tuple[str, ...]:
        """What identifies a row."""
        return tuple(c for c in (self.match, self.team, self.player) if c)


@dataclass(frozen=True)
class GameRoles:
    """A table of one row a match; ``pairs`` maps an output to its (team 1, team 2) columns."""

    match: str
    date: str
    team1: str
    team2: str
    pairs: dict[str, tuple[str, str]]

    def __post_init__(self):
        names = [self.match, self.date, self.team1, self.team2, *self.pairs, *(c for p in self.pairs.values() for c in p)]
        if not self.pairs or any(not n or not n.strip() for n in names):
            raise ValueError("at least one pair of performance columns and no blank names are needed")
