"""The nine clean tables that queries read, and the advanced season views, as functions of base tables.

Column names and types are fixed (`SCHEMAS`); `conformed` selects and casts to them. Inputs are named in each function.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.functions.sport import effective_fg, impact_terms, percent, rating, ratio, rounded, true_shooting, usage
from scorebook.functions.text import null_if_empty, position_group
from scorebook.operators.dimensions import current_profile, with_age
from scorebook.operators.relational import best_row, opponents

# The counting statistics of a game row, in order.
SHOTS = ("field_goals_made", "field_goals_attempted", "two_pointers_made", "two_pointers_attempted", "three_pointers_made", "three_pointers_attempted", "free_throws_made", "free_throws_attempted")
FOULS = ("offensive_fouls_committed", "personal_fouls_committed", "technical_fouls_committed", "fouls_drawn", "fast_break_points", "points_in_paint", "second_chance_points")
COUNTS = ("points", "assists", "turnovers", "total_rebounds", "offensive_rebounds", "defensive_rebounds", "steals", "blocks", *FOULS, *SHOTS)
# Columns and types of the nine tables, in order.
SCHEMAS = {
    "player": """
        person_id long, full_name string, first_name string, last_name string, primary_position string, position_group string,
        latest_team_id long, latest_jersey_number string, birth_date date, school string, country string,
        height_inches long, weight_lbs long, draft_year long, draft_round long, draft_pick_number long
    """,
    "team": """
        team_id long, team_name string, team_city string, team_state string, team_country string, team_abbreviation string,
        conference string, division string
    """,
    "arena": """
        arena_id long, arena_name string, arena_city string, arena_state string, arena_country string, arena_timezone string
    """,
    "game": """
        game_id string, season_year string, season_type string, game_date date, game_start_time_utc timestamp,
        arena_id long, home_team_id long, away_team_id long
    """,
    "player_game": """
        game_id string, person_id long, team_id long, opponent_team_id long, season_year string, season_type string,
        game_date date, game_start_time_utc timestamp, team_home_or_away string, is_starter boolean, win_loss_result string,
        minutes_played double, plus_minus long, points long, assists long, turnovers long,
        total_rebounds long, offensive_rebounds long, defensive_rebounds long, steals long, blocks long, opponent_blocks long,
        offensive_fouls_committed long, personal_fouls_committed long, technical_fouls_committed long, fouls_drawn long,
        fast_break_points long, points_in_paint long, second_chance_points long,
        field_goals_made long, field_goals_attempted long, two_pointers_made long, two_pointers_attempted long,
        three_pointers_made long, three_pointers_attempted long, free_throws_made long, free_throws_attempted long,
        offensive_possessions double, defensive_possessions double, offensive_rating double, defensive_rating double,
        assist_percentage double, usage_percentage double, offensive_rebound_percentage double,
        defensive_rebound_percentage double, rebound_percentage double, block_percentage double
    """,
    "team_game": """
        game_id string, team_id long, opponent_team_id long, season_year string, season_type string, game_date date,
        game_start_time_utc timestamp, team_home_or_away string, win_loss_result string, minutes_played double,
        score long, opponent_score long, assists long, opponent_assists long, turnovers long, opponent_turnovers long,
        total_rebounds long, offensive_rebounds long, defensive_rebounds long,
        opponent_total_rebounds long, opponent_offensive_rebounds long, opponent_defensive_rebounds long,
        steals long, opponent_steals long, blocks long, opponent_blocks long,
        offensive_fouls_committed long, opponent_offensive_fouls_committed long,
        personal_fouls_committed long, opponent_personal_fouls_committed long,
        technical_fouls_committed long, opponent_technical_fouls_committed long, fouls_drawn long, opponent_fouls_drawn long,
        fast_break_points long, opponent_fast_break_points long, points_in_paint long, opponent_points_in_paint long,
        second_chance_points long, opponent_second_chance_points long,
        points_off_turnovers long, opponent_points_off_turnovers long,
        field_goals_made long, field_goals_attempted long, opponent_field_goals_made long, opponent_field_goals_attempted long,
        two_pointers_made long, two_pointers_attempted long, opponent_two_pointers_made long, opponent_two_pointers_attempted long,
        three_pointers_made long, three_pointers_attempted long,
        opponent_three_pointers_made long, opponent_three_pointers_attempted long,
        free_throws_made long, free_throws_attempted long, opponent_free_throws_made long, opponent_free_throws_attempted long,
        offensive_possessions double, defensive_possessions double, block_percentage double
    """,
    "player_season": """
        person_id long, season_year string, season_type string, age_on_jan_31 long, team_count long, is_multi_team_season boolean,
        games_played long, games_started long, minutes_total double, plus_minus_total long,
        points_total long, assists_total long, turnovers_total long,
        rebounds_total long, offensive_rebounds_total long, defensive_rebounds_total long,
        steals_total long, blocks_total long, opponent_blocks_total long,
        offensive_fouls_committed_total long, personal_fouls_committed_total long, technical_fouls_committed_total long,
        fouls_drawn_total long, fast_break_points_total long, points_in_paint_total long, second_chance_points_total long,
        field_goals_made_total long, field_goals_attempted_total long, two_pointers_made_total long,
        two_pointers_attempted_total long, three_pointers_made_total long, three_pointers_attempted_total long,
        free_throws_made_total long, free_throws_attempted_total long,
        offensive_possessions_total double, defensive_possessions_total double, pace double,
        offensive_rating double, defensive_rating double, net_rating double, assist_percentage double, usage_percentage double,
        offensive_rebound_percentage double, defensive_rebound_percentage double, rebound_percentage double, block_percentage double
    """,
    "player_season_team": """
        person_id long, team_id long, season_year string, season_type string, games_played long, games_started long,
        minutes_total double, points_total long, assists_total long,
        rebounds_total long, offensive_rebounds_total long, defensive_rebounds_total long,
        steals_total long, blocks_total long, opponent_blocks_total long, turnovers_total long, plus_minus_total long,
        offensive_fouls_committed_total long, personal_fouls_committed_total long, technical_fouls_committed_total long,
        fouls_drawn_total long, fast_break_points_total long, points_in_paint_total long, second_chance_points_total long,
        field_goals_made_total long, field_goals_attempted_total long, two_pointers_made_total long,
        two_pointers_attempted_total long, three_pointers_made_total long, three_pointers_attempted_total long,
        free_throws_made_total long, free_throws_attempted_total long,
        offensive_possessions_total double, defensive_possessions_total double, pace double,
        offensive_rating double, defensive_rating double, net_rating double, assist_percentage double, usage_percentage double,
        offensive_rebound_percentage double, defensive_rebound_percentage double, rebound_percentage double, block_percentage double
    """,
    "team_season": """
        team_id long, season_year string, season_type string, games_played long, wins long, losses long,
        minutes long, minutes_per_game double, points_total long, assists_total long, turnovers_total long,
        rebounds_total long, offensive_rebounds_total long, defensive_rebounds_total long, steals_total long, blocks_total long,
        offensive_fouls_committed_total long, personal_fouls_committed_total long, technical_fouls_committed_total long,
        fouls_drawn_total long, field_goals_made_total long, field_goals_attempted_total long,
        two_pointers_made_total long, two_pointers_attempted_total long, three_pointers_made_total long,
        three_pointers_attempted_total long, free_throws_made_total long, free_throws_attempted_total long,
        offensive_possessions double, defensive_possessions double, pace double, defensive_rating double, net_rating double,
        offensive_rebound_percentage double, defensive_rebound_percentage double, rebound_percentage double, block_percentage double
    """,
}
KEYS = {
    "player": ("person_id",), "team": ("team_id",), "arena": ("arena_id",), "game": ("game_id",), "player_game": ("game_id", "person_id"), "team_game": ("game_id", "team_id"),
    "player_season": ("person_id", "season_year", "season_type"), "player_season_team": ("person_id", "team_id", "season_year", "season_type"), "team_season": ("team_id", "season_year", "season_type"),
}


def fields_of(table: str) -> list[list[str]]:
    """[name, type] of the table's columns."""
    return [x.split() for x in SCHEMAS[table].split(",")]


def conformed(df: DataFrame, table: str) -> DataFrame:
    """The table's columns and types, one best row per key, no null keys; missing columns are null."""
    fields = fields_of(table)
    out = df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])
    return best_row(out.dropna(subset=list(KEYS[table])), KEYS[table])


def player(events: DataFrame, profiles: DataFrame, time: str = "event_time") -> DataFrame:
    """Latest non-null event values of a person, completed by a profile row (person_id and any of the columns)."""
    columns = [c for c in events.columns if c not in ("person_id", time, "season_year")]
    latest = current_profile(events, "person_id", time, columns, "season_year").drop("first_season", "last_season")
    p = profiles.select("person_id", *[F.col(c).alias(f"_{c}") for c in profiles.columns if c != "person_id"])
    j = latest.join(p, "person_id", "full_outer")
    names = [n for n, _ in fields_of("player")][1:]
    pick = lambda c: F.coalesce(*[F.col(x) for x in (c, f"_{c}") if x in j.columns], F.lit(None))
    out = j.select("person_id", *[pick(c).alias(c) for c in names])
    return conformed(out.withColumn("position_group", F.coalesce(null_if_empty(F.col("position_group")), position_group(F.col("primary_position")))), "player")


def team(events: DataFrame, histories: DataFrame, cities: dict[str, str] | None = None, time: str = "event_time") -> DataFrame:
    """Latest event per team, completed from its history; `cities` maps a city to its usual name."""
    columns = [c for c in events.columns if c not in ("team_id", time, "season_year")]
    latest = current_profile(events, "team_id", time, columns, "season_year").drop("first_season", "last_season")
    h = best_row(histories, ["team_id"]).select("team_id", *[F.col(c).alias(f"_{c}") for c in histories.columns if c != "team_id"])
    j = latest.join(h, "team_id", "full_outer")
    names = [n for n, _ in fields_of("team")][1:]
    out = j.select("team_id", *[F.coalesce(*[F.col(x) for x in (c, f"_{c}") if x in j.columns], F.lit(None)).cast("string").alias(c) for c in names])
    if cities:
        usual = F.create_map(*[F.lit(x) for pair in cities.items() for x in pair])
        out = out.withColumn("team_city", F.coalesce(usual[F.col("team_city")], "team_city"))
    return conformed(out, "team")


def arena(rows: DataFrame) -> DataFrame:
    """Trimmed arena rows, the most filled per arena."""
    return conformed(rows.select([null_if_empty(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]), "arena")


def game(rows: DataFrame) -> DataFrame:
    """Games with both teams and a date."""
    return conformed(rows.where("home_team_id is not null and away_team_id is not null and game_date is not null"), "game")


def player_game(facts: DataFrame, possessions: DataFrame, opportunities: DataFrame, teams: DataFrame) -> DataFrame:
    """Player rows with possessions and on-court rates.

    possessions: game_id, person_id, offensive_possessions, defensive_possessions, used_offensive_possessions, points_for,
    points_against. opportunities: teammate_field_goals_made, offensive_, defensive_ and total_rebound_opportunities,
    opponent_two_point_attempts. teams: game_id, team_id and team_ sums for the proxy of usage (team_field_goals_attempted,
    team_free_throws_attempted, team_turnovers, team_minutes).
    """
    keys = ["game_id", "person_id"]
    j = facts.join(possessions, keys, "left").join(opportunities, keys, "left").join(teams, ["game_id", "team_id"], "left")
    c = F.col
    rates = {
        "two_pointers_made": c("field_goals_made") - c("three_pointers_made"), "two_pointers_attempted": c("field_goals_attempted") - c("three_pointers_attempted"),
        "offensive_rating": rounded(rating(c("points_for"), c("offensive_possessions")), 1), "defensive_rating": rounded(rating(c("points_against"), c("defensive_possessions")), 1),
        "assist_percentage": percent(c("assists"), c("teammate_field_goals_made")),
        "usage_percentage": usage(c("used_offensive_possessions"), c("offensive_possessions"), c("field_goals_attempted"), c("free_throws_attempted"), c("turnovers"), c("minutes_played"), c("team_field_goals_attempted"), c("team_free_throws_attempted"), c("team_turnovers"), c("team_minutes")),
        "offensive_rebound_percentage": percent(c("offensive_rebounds"), c("offensive_rebound_opportunities")), "defensive_rebound_percentage": percent(c("defensive_rebounds"), c("defensive_rebound_opportunities")),
        "rebound_percentage": percent(c("total_rebounds"), c("total_rebound_opportunities")), "block_percentage": percent(c("blocks"), c("opponent_two_point_attempts")),
    }
    return conformed(j.withColumns(rates), "player_game")


def team_game(facts: DataFrame, possessions: DataFrame) -> DataFrame:
    """Team rows with their opponent's statistics side by side; statistics that the facts lack are null.

    possessions: game_id, team_id and the two counts. A score that the facts lack is the points.
    """
    own = facts.withColumns({"two_pointers_made": F.col("field_goals_made") - F.col("three_pointers_made"), "two_pointers_attempted": F.col("field_goals_attempted") - F.col("three_pointers_attempted")})
    if "score" not in own.columns:
        own = own.withColumn("score", F.col("points"))
    shared = [c for c in ("score", "points_off_turnovers", *COUNTS[1:]) if c in own.columns]
    j = opponents(own, "game_id", "team_id", "team_home_or_away", shared).join(possessions, ["game_id", "team_id"], "left")
    blocks = percent(F.col("blocks"), F.col("opponent_two_pointers_attempted")) if "blocks" in own.columns else F.lit(None).cast("double")
    return conformed(j.withColumn("block_percentage", blocks), "team_game")


def _season_sums(games: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    sums = {f"{c.removeprefix('total_') if c == 'total_rebounds' else c}_total": total(c) for c in counts if c in games.columns}
    sums |= {"minutes_total": total("minutes_played"), "offensive_possessions_total": total("offensive_possessions"), "defensive_possessions_total": total("defensive_possessions")}
    return games.dropna(subset=list(keys)), sums


#: Rates of a season that the games' rates are weighed to, with their counts.
IMPLIED = {"assist_percentage": "assists", "offensive_rebound_percentage": "offensive_rebounds", "defensive_rebound_percentage": "defensive_rebounds", "rebound_percentage": "total_rebounds", "block_percentage": "blocks"}


def _implied(part: str, rate: str) -> Column:
    """The opportunities that a game's rate implies."""
    return F.when(F.col(rate) > 0, 100 * F.col(part) / F.col(rate))


def _in_order(games: str, c: str) -> Column:
    """The sum of a field of collected games in their order, so that a double's last digit doesn't depend on tasks."""
    return F.aggregate(games, F.lit(None).cast("double"), lambda total, g: F.coalesce(total + g[c], total, g[c]))


def player_season_team(games: DataFrame, keys: Sequence[str] = KEYS["player_season_team"]) -> DataFrame:
    """Season sums and rates of player_game rows by person, team, season and kind of season."""
    rows, sums = _season_sums(games, keys, (*COUNTS, "opponent_blocks", "plus_minus"))
    played = F.col("minutes_played") > 0
    weigh = lambda r, p: ratio(F.sum(F.col(r) * F.col(p)), F.sum(F.when(F.col(r).isNotNull(), F.col(p))))
    out = rows.groupBy(*keys).agg(
        F.sum(played.cast("long")).alias("games_played"), F.sum(F.coalesce(F.col("is_starter"), F.lit(False)).cast("long")).alias("games_started"), *[c.alias(n) for n, c in sums.items()],
        rounded(weigh("offensive_rating", "offensive_possessions"), 1).alias("offensive_rating"), rounded(weigh("defensive_rating", "defensive_possessions"), 1).alias("defensive_rating"),
        rounded(weigh("usage_percentage", "offensive_possessions"), 1).alias("usage_percentage"),
        *[F.sum(F.when(_implied(p, r).isNotNull(), F.col(p))).alias(f"_{r}") for r, p in IMPLIED.items()],
        F.array_sort(F.collect_list(F.struct(F.length("game_id").alias("_digits"), "game_id", *[_implied(p, r).alias(r) for r, p in IMPLIED.items()]))).alias("_games"),
    )
    # a rate is the counts' sum over the sum of the opportunities that the game rates imply
    out = out.withColumns({r: percent(F.col(f"_{r}"), _in_order("_games", r)) for r in IMPLIED})
    poss = (F.col("offensive_possessions_total") + F.col("defensive_possessions_total")) / 2
    out = out.withColumns({"pace": rounded(ratio(48 * poss, F.col("minutes_total")), 1), "net_rating": rounded(F.col("offensive_rating") - F.col("defensive_rating"), 1)})
    return conformed(out, "player_season_team") if "team_id" in keys else out.drop("_games")


def player_season(games: DataFrame, players: DataFrame) -> DataFrame:
    """Season sums over all teams, with age on 31 January and the number of teams. players: person_id, birth_date."""
    keys = KEYS["player_season"]
    teams = games.dropna(subset=list(keys)).groupBy(*keys).agg(F.count_distinct("team_id").alias("team_count"))
    out = player_season_team(games, keys).join(teams, list(keys)).join(players.select("person_id", "birth_date"), "person_id", "left")
    out = with_age(out.withColumn("_start", F.substring("season_year", 1, 4).try_cast("int")), "birth_date", "_start", "age_on_jan_31")
    return conformed(out.withColumn("is_multi_team_season", F.col("team_count") > 1), "player_season")


def team_season_sums(games: DataFrame) -> DataFrame:
    """Season sums of team_game rows for the team and (opponent_) its opponents, wins, losses, pace and ratings.

    Ratings are per hundred possessions, of which a team has half of those at both ends.
    """
    keys = KEYS["team_season"]
    names = ("score", *COUNTS[1:])
    rows, sums = _season_sums(games, keys, [x for c in names for x in (c, f"opponent_{c}")])
    n = lambda r: F.sum(F.when(F.col("win_loss_result") == r, 1).otherwise(0)).cast("long")
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("games_played"), n("win").alias("wins"), n("loss").alias("losses"), *[c.alias(x) for x, c in sums.items()])
    out = out.withColumnsRenamed({"score_total": "points_total", "opponent_score_total": "opponent_points_total", "opponent_total_rebounds_total": "opponent_rebounds_total"})
    both = F.col("offensive_possessions_total") + F.col("defensive_possessions_total")
    poss = F.when(both > 0, both / 2)
    off, de = rating(F.col("points_total"), poss), rating(F.col("opponent_points_total"), poss)
    return out.withColumns({"pace": rounded(ratio(240 * poss, F.col("minutes_total")), 1), "offensive_rating": rounded(off, 1), "defensive_rating": rounded(de, 1), "net_rating": rounded(off - de, 1)})


def team_season(games: DataFrame, shots: DataFrame | None = None) -> DataFrame:
    """The team-season table of team_game rows.

    shots: game_id, team_id, opponent_two_point_attempts, for the share of blocked shots (else null).
    """
    keys = list(KEYS["team_season"])
    out = team_season_sums(games)
    if shots is not None:
        tried = games.select("game_id", *keys).join(shots, ["game_id", "team_id"]).groupBy(*keys).agg(F.sum("opponent_two_point_attempts").alias("_tried"))
        out = out.join(tried, keys, "left")
    t = lambda c: F.col(f"{c}_total")
    share = lambda own, other: percent(t(own), t(own) + t(f"opponent_{other}"))
    some = lambda c: F.when(t(c) > 0, rounded(t(c), 1))
    return conformed(out.withColumns({
        "minutes": F.when(t("minutes") > 0, F.round(t("minutes") / 5).cast("long")), "minutes_per_game": rounded(ratio(t("minutes") / 5, F.col("games_played")), 1),
        "offensive_possessions": some("offensive_possessions"), "defensive_possessions": some("defensive_possessions"),
        "offensive_rebound_percentage": share("offensive_rebounds", "defensive_rebounds"), "defensive_rebound_percentage": share("defensive_rebounds", "offensive_rebounds"), "rebound_percentage": share("rebounds", "rebounds"),
        "block_percentage": percent(t("blocks"), F.col("_tried")) if shots is not None else F.lit(None).cast("double"),
    }), "team_season")


def advanced_player_season(season: DataFrame, team_context: DataFrame, percentiles: DataFrame | None = None, keys: Sequence[str] = KEYS["player_season"]) -> DataFrame:
    """A player season with shooting, assist, turnover, rebound, usage and impact measures.

    team_context, per key: team_minutes_total (of the games the player was in) and sums of the team (team_) and its
    opponents (opponent_) in them, and impact_total, the games' sum of the impact form.
    """
    j = season.join(team_context, list(keys), "left")
    t = lambda c: F.col(f"{c}_total")
    fga, fta, ast, tov = t("field_goals_attempted"), t("free_throws_attempted"), t("assists"), t("turnovers")
    share = ratio(t("minutes"), F.col("team_minutes_total") / 5)
    plays = fga + 0.44 * fta + ast + tov
    reb = lambda own, a, b: rounded(100 * ratio(t(own), share * (F.col(a) + F.col(b))), 1)
    pie = impact_terms(t("points"), t("field_goals_made"), t("free_throws_made"), fga, fta, t("defensive_rebounds"), t("offensive_rebounds"), ast, t("steals"), t("blocks"), t("personal_fouls_committed"), tov)
    out = j.withColumns({
        "effective_field_goal_percentage": rounded(100 * effective_fg(t("field_goals_made"), t("three_pointers_made"), fga), 1), "true_shooting_percentage": rounded(100 * true_shooting(t("points"), fga, fta), 1),
        "assist_percentage": rounded(100 * ratio(ast, share * F.col("team_field_goals_made_total") - t("field_goals_made")), 1),
        "assist_turnover_ratio": rounded(ratio(ast, tov), 2), "assist_ratio": rounded(100 * ratio(ast, plays), 1), "turnover_ratio": rounded(100 * ratio(tov, plays), 1),
        "offensive_rebound_percentage": reb("offensive_rebounds", "team_offensive_rebounds_total", "opponent_defensive_rebounds_total"), "defensive_rebound_percentage": reb("defensive_rebounds", "team_defensive_rebounds_total", "opponent_offensive_rebounds_total"),
        "three_point_attempt_rate": rounded(ratio(t("three_pointers_attempted"), fga), 3), "free_throw_attempt_rate": rounded(ratio(fta, fga), 3), "pie": ratio(pie, F.col("impact_total")),
    })
    return out.join(percentiles, list(keys), "left") if percentiles is not None else out


def advanced_team_season(season: DataFrame, percentiles: DataFrame | None = None, keys: Sequence[str] = KEYS["team_season"]) -> DataFrame:
    """Team season sums with shooting, ball and rebound measures for the team and its opponents."""
    t = lambda c: F.col(f"{c}_total")
    add = {"win_percentage": percent(F.col("wins"), F.col("wins") + F.col("losses"))}
    for p, o in (("", "opponent_"), ("opponent_", "")):
        fga, fta = t(f"{p}field_goals_attempted"), t(f"{p}free_throws_attempted")
        add |= {
            f"{p}effective_field_goal_percentage": rounded(100 * effective_fg(t(f"{p}field_goals_made"), t(f"{p}three_pointers_made"), fga), 1), f"{p}true_shooting_percentage": rounded(100 * true_shooting(t(f"{p}points"), fga, fta), 1),
            f"{p}offensive_rebound_percentage": percent(t(f"{p}offensive_rebounds"), t(f"{p}offensive_rebounds") + t(f"{o}defensive_rebounds")), f"{p}assist_percentage": percent(t(f"{p}assists"), t(f"{p}field_goals_made")),
            f"{p}three_point_attempt_rate": rounded(ratio(t(f"{p}three_pointers_attempted"), fga), 3),
        }
    out = season.withColumns(add)
    return out.join(percentiles, list(keys), "left") if percentiles is not None else out
