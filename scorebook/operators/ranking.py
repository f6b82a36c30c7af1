"""Percentile tables of player and team seasons: which metrics, in which direction, and who is eligible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.operators.relational import percentiles, surrogate_keys

# The least games, seconds and attempts of an eligible player season.
LEAST_GAMES, LEAST_SECONDS, LEAST_FIELD_GOALS, LEAST_THREES, LEAST_FREE_THROWS, LEAST_SCORING = 5, 6000, 25, 10, 10, 25.0
# The metrics by eligibility, and those of which less is better.
PLAYER_METRICS = {
    "games": ("seconds_played_average", "points_per_game", "assists_per_game", "rebounds_per_game"),
    "field_goals": ("field_goals_percentage", "three_point_attempt_rate", "free_throw_attempt_rate"),
    "threes": ("three_pointers_percentage",),
    "free_throws": ("free_throws_percentage",),
    "scoring": ("effective_field_goal_percentage", "true_shooting_percentage"),
    "minutes": (
        "minutes", "offensive_rating", "defensive_rating", "net_rating", "assist_percentage", "ast_to_turnover_ratio", "assist_ratio", "offensive_rebound_percentage", "defensive_rebound_percentage", "rebound_percentage", "turnover_ratio",
        "usage_percentage", "pace", "pie", "steal_percentage", "block_percentage",
    ),
}
TEAM_METRICS = (
    "win_percentage", "points_for_per_game", "points_against_per_game", "point_differential_per_game", "field_goals_percentage", "free_throws_percentage", "three_pointers_percentage", "two_pointers_percentage",
    "offensive_rating", "defensive_rating", "net_rating", "assist_percentage", "ast_to_turnover_ratio", "assist_ratio", "offensive_rebound_percentage", "defensive_rebound_percentage", "rebound_percentage",
    "steal_percentage", "block_percentage", "turnover_ratio", "effective_field_goal_percentage", "three_point_attempt_rate", "free_throw_attempt_rate", "true_shooting_percentage", "pace", "pie",
)
# The player metrics in the order of their table.
PLAYER_ORDER = (
    "seconds_played_average", "field_goals_percentage", "three_pointers_percentage", "free_throws_percentage", "points_per_game", "assists_per_game", "rebounds_per_game", "minutes", "offensive_rating", "defensive_rating", "net_rating", "assist_percentage", "ast_to_turnover_ratio", "assist_ratio",
    "offensive_rebound_percentage", "defensive_rebound_percentage", "rebound_percentage", "turnover_ratio", "effective_field_goal_percentage", "three_point_attempt_rate", "free_throw_attempt_rate", "true_shooting_percentage", "usage_percentage", "pace", "pie", "steal_percentage", "block_percentage",
)
LESS_IS_BETTER = {"defensive_rating", "turnover_ratio", "points_against_per_game"}
SEASON = ("season_year", "raw_season_type_code")


def eligible() -> dict[str, Column]:
    """Who is ranked in the metrics of each kind; a missing number counts as none."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    games = z("games_played") >= LEAST_GAMES
    return {
        "games": games, "minutes": games & (z("seconds_played_total") >= LEAST_SECONDS), "field_goals": games & (z("field_goals_attempted_total") >= LEAST_FIELD_GOALS), "threes": games & (z("three_pointers_attempted_total") >= LEAST_THREES),
        "free_throws": games & (z("free_throws_attempted_total") >= LEAST_FREE_THROWS), "scoring": games & (z("field_goals_attempted_total") + 0.44 * z("free_throws_attempted_total") >= LEAST_SCORING),
    }


def ranked(rows: DataFrame, row_id: str, specs: list[tuple[str, Column]], kind: str, order: Sequence[str], source: str | None) -> DataFrame:
    """The table in contract order: surrogate key (dense by id, start year and type code), season columns, percentiles."""
    keys = [row_id, *SEASON]
    rows = rows.dropna(subset=keys)
    have = lambda c, t: F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)
    start = F.coalesce(have("season_start_year", "long"), F.regexp_extract("season_year", r"^(\d{4})\b", 1).try_cast("long"))
    rows = rows.withColumns({"_now": have(f"current_{kind}_sk", "long"), "_start": start, "_type": have("season_type", "string")})
    out = percentiles(rows, list(SEASON), [(m, f"{m}_percentile", m in LESS_IS_BETTER, ok) for m, ok in specs], [row_id])
    out = out.select(*keys, "_now", "_start", "_type", *[f"{m}_percentile" for m in order], F.coalesce("_start", F.lit(-1)).alias("_year"))
    out = surrogate_keys(out, [row_id, "_year", "raw_season_type_code"], f"{kind}_season_percentiles_sk")
    return out.select(
        f"{kind}_season_percentiles_sk", row_id, F.col("_now").alias(f"current_{kind}_sk"), "season_year", F.col("_start").alias("season_start_year"), "raw_season_type_code", F.col("_type").alias("season_type"),
        *[F.col(f"{m}_percentile").cast("long").alias(f"{m}_percentile") for m in order], F.lit(source).cast("string").alias("record_source"),
    )


def player_season_percentiles(seasons: DataFrame, advanced: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """A row per player season with the percentiles of 27 metrics; each among the eligible of its season.

    seasons: person_id, season_year, raw_season_type_code, totals and metrics, and current_player_sk, season_start_year
    and season_type if known; a start year that isn't comes from the season's label. `advanced` adds metrics by the keys.
    """
    rows = seasons if advanced is None else seasons.join(advanced, ["person_id", *SEASON], "left")
    ok = eligible()
    return ranked(rows, "person_id", [(m, ok[kind]) for kind, metrics in PLAYER_METRICS.items() for m in metrics], "player", PLAYER_ORDER, source)


def team_season_percentiles(seasons: DataFrame, advanced: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """As `player_season_percentiles`, 26 metrics of teams; each among the teams with a game in the season."""
    rows = seasons if advanced is None else seasons.join(advanced, ["team_id", *SEASON], "left")
    played = F.coalesce(F.col("games_played") > 0, F.lit(False))
    return ranked(rows, "team_id", [(m, played) for m in TEAM_METRICS], "team", TEAM_METRICS, source)
