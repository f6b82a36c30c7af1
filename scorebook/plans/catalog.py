"""The catalog of objects, links, attributes and metrics that queries are built from."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.functions.sport import rounded

#: Longest link path between a fact and a linked object.
MOST_HOPS = 2
AGGREGATIONS = ("sum", "avg", "identity", "count_win", "count_loss", "count_true", "ratio")
#: Words that follow a metric's polarity, and those that don't.
POLAR_WORDS = {"best": True, "top": True, "leader": True, "worst": False, "bottom": False}
PLAIN_WORDS = {"most": "desc", "highest": "desc", "fewest": "asc", "lowest": "asc"}


@dataclass(frozen=True)
class ObjectDef:
    """A table with its key, display name, date and attributes that are SQL templates over its columns ({column})."""

    name: str
    key: tuple[str, ...]
    display: str | None = None
    date: str | None = None
    context: str | None = None
    derived: dict[str, str] = field(default_factory=dict)
    hidden: frozenset[str] = frozenset()


@dataclass(frozen=True)
class LinkDef:
    """A many-to-one link; `role` tells links with the same target apart."""

    source: str
    target: str
    keys: tuple[tuple[str, str], ...]
    role: str | None = None


@dataclass(frozen=True)
class MetricDef:
    """`expr` is a SQL expression: of one row (sum, avg, identity, counts) or of aggregates (ratio)."""

    name: str
    agg: str
    expr: str
    lower_is_better: bool = False

    def column(self) -> Column:
        x = F.expr(self.expr)
        match self.agg:
            case "sum":
                return F.sum(x)
            case "avg":
                return rounded(F.avg(x), 1)
            case "identity":
                return F.max(x)
            case "count_win":
                return F.sum(F.when(x == "win", 1).otherwise(0))
            case "count_loss":
                return F.sum(F.when(x == "loss", 1).otherwise(0))
            case "count_true":
                return F.sum(F.when(x, 1).otherwise(0))
            case "ratio":
                return x
        raise ValueError(f"{self.agg} is no aggregation of {AGGREGATIONS}")

    def direction(self, word: str | None = None) -> str:
        """asc or desc for a ranking word: polar words follow the metric, plain ones don't; desc without a word."""
        if word in POLAR_WORDS:
            return "desc" if POLAR_WORDS[word] != self.lower_is_better else "asc"
        if word is None or word in PLAIN_WORDS:
            return PLAIN_WORDS.get(word, "desc")
        raise ValueError(f"{word!r} is no ranking word")


@dataclass(frozen=True)
class Catalog:
    objects: dict[str, ObjectDef]
    links: tuple[LinkDef, ...]
    metrics: dict[str, MetricDef] = field(default_factory=dict)

    def path(self, source: str, target: str, role: str | None = None) -> tuple[LinkDef, ...]:
        """The shortest link path, first defined first; `role` must name its last link."""
        if source == target:
            return ()
        waiting = deque([(source, ())])
        while waiting:
            at, links = waiting.popleft()
            for link in self.links:
                if link.source != at or len(links) >= MOST_HOPS:
                    continue
                if link.target == target and link.role == role:
                    return (*links, link)
                waiting.append((link.target, (*links, link)))
        raise ValueError(f"no link path from {source} to {target}" + (f" as {role}" if role else ""))


def game_metrics(schema: T.StructType, rates: frozenset[str] = frozenset(), skip: frozenset[str] = frozenset(), overrides: dict[str, MetricDef] | None = None) -> dict[str, MetricDef]:
    """total_x and average_x for every numeric column (no total for rate columns), then the overrides."""
    out: dict[str, MetricDef] = {}
    for f in schema.fields:
        if isinstance(f.dataType, T.NumericType) and f.name not in skip:
            if f.name not in rates:
                out[f"total_{f.name}"] = MetricDef(f"total_{f.name}", "sum", f.name)
            out[f"average_{f.name}"] = MetricDef(f"average_{f.name}", "avg", f.name)
    return out | (overrides or {})


def season_metrics(schema: T.StructType, skip: frozenset[str] = frozenset()) -> dict[str, MetricDef]:
    """The column itself as the metric, for tables that are aggregated already."""
    return {f.name: MetricDef(f.name, "identity", f.name) for f in schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip}


def _rounded(x: str, digits: int) -> str:
    """`sport.rounded` as a SQL expression."""
    return f"round(({x}) * {10**digits}D) / {10**digits}D"


def _ratio(name: str, top: str, bottom: str, scale: str = "", digits: int | None = None, lower: bool = False) -> MetricDef:
    body = f"try_divide({scale}({top}), cast({bottom} as double))"
    return MetricDef(name, "ratio", _rounded(body, digits) if digits is not None else body, lower)


def _shooting(prefix: str = "") -> dict[str, MetricDef]:
    s = lambda c: f"sum({prefix}{c})"
    made, tried = "field_goals_made", "field_goals_attempted"
    out = [
        _ratio(f"{prefix}field_goal_percentage", s(made), s(tried), "100 * ", 1),
        _ratio(f"{prefix}two_point_percentage", f"{s(made)} - {s('three_pointers_made')}", f"({s(tried)} - {s('three_pointers_attempted')})", "100 * ", 1),
        _ratio(f"{prefix}three_point_percentage", s("three_pointers_made"), s("three_pointers_attempted"), "100 * ", 1),
        _ratio(f"{prefix}free_throw_percentage", s("free_throws_made"), s("free_throws_attempted"), "100 * ", 1),
        _ratio(f"{prefix}effective_field_goal_percentage", f"{s(made)} + 0.5 * {s('three_pointers_made')}", s(tried), "100 * ", 1),
        _ratio(f"{prefix}true_shooting_percentage", s("points"), f"(2 * ({s(tried)} + 0.44 * {s('free_throws_attempted')}))", "100 * ", 1),
        _ratio(f"{prefix}three_point_attempt_rate", s("three_pointers_attempted"), s(tried), "", 3),
        _ratio(f"{prefix}free_throw_attempt_rate", s("free_throws_attempted"), s(tried), "", 3),
    ]
    return {m.name: m for m in out}


def player_game_metrics() -> dict[str, MetricDef]:
    """Metrics of player games beyond totals and averages."""
    own = [
        MetricDef("games_won", "count_win", "win_loss_result"),
        MetricDef("games_lost", "count_loss", "win_loss_result", True),
        MetricDef("games_started", "count_true", "is_starter"),
        _ratio("assist_turnover_ratio", "sum(assists)", "sum(turnovers)", "", 2),
        MetricDef("total_possessions", "ratio", "sum((offensive_possessions + defensive_possessions) / 2)"),
        MetricDef("average_possessions", "ratio", _rounded("avg((offensive_possessions + defensive_possessions) / 2)", 1)),
        _ratio("pace", "48 * sum((offensive_possessions + defensive_possessions) / 2)", "(sum(seconds_played) / 60)", "", 1),
        MetricDef("net_rating", "ratio", _rounded("try_divide(100 * sum(points_for), cast(sum(offensive_possessions) as double)) - try_divide(100 * sum(points_against), cast(sum(defensive_possessions) as double))", 1)),
        _ratio("steal_percentage", "sum(steals)", "sum(defensive_possessions)", "100 * ", 1),
    ]
    return {m.name: m for m in own} | _shooting()


def team_game_metrics() -> dict[str, MetricDef]:
    """Metrics of team games, for the team and (opponent_) its opponents."""
    rebound = lambda name, own, other: _ratio(name, f"sum({own})", f"(sum({own}) + sum({other}))", "100 * ", 1)
    rate = lambda name, points, poss, lower=False: _ratio(name, f"sum({points})", f"sum({poss})", "100 * ", 1, lower)
    own = [
        MetricDef("wins", "count_win", "win_loss_result"),
        MetricDef("losses", "count_loss", "win_loss_result", True),
        MetricDef("average_point_differential", "avg", "points - opponent_points"),
        MetricDef("average_possessions", "ratio", _rounded("avg((offensive_possessions + defensive_possessions) / 2)", 1)),
        _ratio("pace", "240 * sum((offensive_possessions + defensive_possessions) / 2)", "(sum(seconds_played) / 60)", "", 1),
        rate("offensive_rating", "points", "offensive_possessions"),
        rate("defensive_rating", "opponent_points", "defensive_possessions", True),
        MetricDef("net_rating", "ratio", _rounded("try_divide(100 * sum(points), cast(sum(offensive_possessions) as double)) - try_divide(100 * sum(opponent_points), cast(sum(defensive_possessions) as double))", 1)),
        _ratio("assist_percentage", "sum(assists)", "sum(field_goals_made)", "100 * ", 1),
        _ratio("assist_turnover_ratio", "sum(assists)", "sum(turnovers)", "", 2),
        rebound("offensive_rebound_percentage", "offensive_rebounds", "opponent_defensive_rebounds"),
        rebound("defensive_rebound_percentage", "defensive_rebounds", "opponent_offensive_rebounds"),
        rebound("rebound_percentage", "rebounds", "opponent_rebounds"),
        _ratio("steal_percentage", "sum(steals)", "sum(defensive_possessions)", "100 * ", 1),
    ]
    return {m.name: m for m in own} | _shooting() | _shooting("opponent_")


#: Counting statistics that season tables hold as <name>_total.
COUNTING = ("points", "assists", "rebounds", "offensive_rebounds", "defensive_rebounds", "steals", "blocks", "turnovers", "personal_fouls", "field_goals_made", "field_goals_attempted", "three_pointers_made", "three_pointers_attempted", "free_throws_made", "free_throws_attempted", "plus_minus", "seconds_played")


def season_derived_metrics(team: bool = False) -> dict[str, MetricDef]:
    """Per-game metrics (exact ties to the even digit) and percentages over <name>_total columns."""
    games = "(wins + losses)" if team else "games_played"
    tied = lambda a, b: f"case when {b} > 0 then case when (coalesce({a}, 0) * 10) % {b} * 2 = {b} then bround(cast(coalesce({a}, 0) as decimal(20,0)) / {b}, 1) else round(cast(coalesce({a}, 0) as double) / {b}, 1) end end"
    out = {f"{c}_per_game": MetricDef(f"{c}_per_game", "identity", tied(f"{c}_total", games)) for c in COUNTING}
    share = lambda top, bottom: _rounded(f"100 * try_divide({top}, cast({bottom} as double))", 1)
    pairs = {
        "field_goal_percentage": ("field_goals_made_total", "field_goals_attempted_total"),
        "three_point_percentage": ("three_pointers_made_total", "three_pointers_attempted_total"),
        "free_throw_percentage": ("free_throws_made_total", "free_throws_attempted_total"),
        "effective_field_goal_percentage": ("field_goals_made_total + 0.5 * three_pointers_made_total", "field_goals_attempted_total"),
        "true_shooting_percentage": ("points_total", "(2 * (field_goals_attempted_total + 0.44 * free_throws_attempted_total))"),
    } | ({"win_percentage": ("wins", "(wins + losses)")} if team else {})
    return out | {n: MetricDef(n, "identity", share(f"({a})", b)) for n, (a, b) in pairs.items()}


def per_minutes_columns(columns: list[str], minutes: int, seconds: str = "seconds_played_total") -> dict[str, Column]:
    """A rate per `minutes` minutes for every <name>_total column."""
    totals = [c for c in columns if c.endswith("_total") and c != seconds]
    return {f"{c.removesuffix('_total')}_per_{minutes}": F.try_divide(F.col(c) * (minutes * 60.0), F.col(seconds)) for c in totals}
