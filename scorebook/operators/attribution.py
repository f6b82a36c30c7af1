"""On-court attribution: what happens while a player or team is on court, by the best method for each game.

A method counts for a game only if it resolves every row of it. Possessions are exploded to their ten players and summed
at once, so nothing larger than ten times the possessions is shuffled, and only sums are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions.sport import possessions_estimate, ratio
from scorebook.functions.text import lineup_people
from scorebook.operators.relational import containing, linked_row, opponents
from scorebook.operators.sequence import Cols

METHODS = ("exact", "ot_fallback", "event_estimated", "boxscore_estimated")
VALUES = ("offensive_possessions", "defensive_possessions", "used_offensive_possessions", "points_for", "points_against")


def sides_of(rows: DataFrame) -> DataFrame:
    """Possessions with offense and defense player arrays; null where the lineups or sides are unknown."""
    home, away = lineup_people(F.col("homeLineupId")), lineup_people(F.col("awayLineupId"))
    h = F.col("offenseHomeAway")
    return rows.withColumns({"offense": F.when(h == "h", home).when(h == "v", away), "defense": F.when(h == "h", away).when(h == "v", home)})


def from_possessions(rows: DataFrame, played: DataFrame, method: str, used: DataFrame | None = None) -> DataFrame:
    """(gameId, personId, method, values) from counted possessions; only games whose every possession has two lineups.

    `used`: (gameId, possessionNumber, usedPersonId).
    """
    counted = sides_of(rows.where("countsAsPossession"))
    known = F.col("offense").isNotNull() & F.col("defense").isNotNull()
    whole = counted.groupBy("gameId").agg(F.bool_and(known).alias("ok")).where("ok").select("gameId")
    counted = counted.join(whole, "gameId", "left_semi")
    points = F.coalesce(F.col("pointsScoredOnPossession"), F.lit(0)).cast("double")
    role = lambda people, off: F.transform(people, lambda p: F.struct(p.alias("personId"), F.lit(off).alias("off")))
    on = counted.select("gameId", points.alias("pts"), F.explode(F.concat(role(F.col("offense"), 1), role(F.col("defense"), 0))).alias("p"))
    off = F.col("p.off")
    sums = on.groupBy("gameId", F.col("p.personId").alias("personId")).agg(
        F.sum(off).cast("double").alias("offensive_possessions"), F.sum(1 - off).cast("double").alias("defensive_possessions"),
        F.sum(off * F.col("pts")).alias("points_for"), F.sum((1 - off) * F.col("pts")).alias("points_against"),
    )
    out = played.select("gameId", "personId").join(whole, "gameId").join(sums, ["gameId", "personId"], "left")
    if used is not None:
        n = used.where("usedPersonId is not null").groupBy("gameId", F.col("usedPersonId").alias("personId")).agg(F.count(F.lit(1)).cast("double").alias("used_offensive_possessions"))
        out = out.join(n, ["gameId", "personId"], "left")
    else:
        out = out.withColumn("used_offensive_possessions", F.lit(None).cast("double"))
    return out.select("gameId", "personId", F.lit(method).alias("method"), *[F.coalesce(v, F.lit(0.0)).alias(v) for v in VALUES])


def used_players(rows: DataFrame, events: DataFrame, c: Cols = Cols()) -> DataFrame:
    """(gameId, possessionNumber, usedPersonId): who ended the possession, if of the offence.

    Turnovers, made shots and free throws go to their player; a defensive rebound goes to the shooter of the missed shot.
    """
    own = ["isTurnover", "isMadeShot", "isFreeThrow", "isRebound", "isDreb"]
    linked = linked_row(events.select(c.game, c.action, c.shot_action, c.team, c.person, *own), [c.game], c.shot_action, c.action, [c.team, c.person], "shot_")
    own = F.col("isTurnover") | F.col("isMadeShot") | F.col("isFreeThrow")
    team = F.when(own, F.col(c.team)).when(F.col("isRebound") & F.col("isDreb"), F.col(f"shot_{c.team}"))
    person = F.when(own, F.col(c.person)).when(F.col("isRebound") & F.col("isDreb"), F.col(f"shot_{c.person}"))
    ends = linked.select(F.col(c.game).alias("gameId"), F.col(c.action).alias("endActionNumber"), team.alias("_t"), person.alias("_p"))
    ends = ends.groupBy("gameId", "endActionNumber").agg(F.max_by(F.struct("_t", "_p"), F.col("_p").isNotNull()).alias("_e"))
    out = rows.where("countsAsPossession").join(ends, ["gameId", "endActionNumber"], "left")
    return out.select("gameId", "possessionNumber", F.when(F.col("_e._t") == F.col("offenseTeamId"), F.col("_e._p")).alias("usedPersonId"))


def on_court(events: DataFrame, lineups: DataFrame, c: Cols = Cols()) -> DataFrame:
    """Events with the stint they fall into (start order <= order < end order)."""
    s = lineups.select(c.game, "period", "start_orderNumber", "end_orderNumber", "home_personIds", "away_personIds", F.col("home_teamId").alias("stint_home"), F.col("away_teamId").alias("stint_away"), "lineup_valid_flag")
    return containing(events, s, [c.game, c.period], c.order, "start_orderNumber", "end_orderNumber", small_groups=True)


def from_events(events: DataFrame, lineups: DataFrame, played: DataFrame, c: Cols = Cols()) -> DataFrame:
    """Estimate from score changes and possession ends of events placed in stints; every such event must have a valid one."""
    need = events.where((F.col("pointsHome") > 0) | (F.col("pointsAway") > 0) | F.col("isPossessionEndingEvent"))
    placed = on_court(need, lineups, c)
    ok = F.col("home_personIds").isNotNull() & F.col("away_personIds").isNotNull()
    whole = placed.groupBy(c.game).agg(F.bool_and(ok).alias("ok")).where("ok").select(c.game)
    side = lambda people, s: F.transform(F.col(people), lambda p: F.struct(p.alias("personId"), F.lit(s).alias("side")))
    on = placed.join(whole, c.game, "left_semi").withColumn("p", F.explode(F.concat(side("home_personIds", "h"), side("away_personIds", "v"))))
    home, attack = F.col("p.side") == "h", F.col("p.side") == F.col("offenseHomeAway")
    counts = F.coalesce(F.col("countAsPossession"), F.lit(False))
    n = lambda x: F.sum(F.when(x, 1.0).otherwise(0.0))
    out = on.groupBy(c.game, F.col("p.personId").alias("personId")).agg(
        n(counts & attack).alias("offensive_possessions"), n(counts & ~attack).alias("defensive_possessions"),
        F.sum(F.when(home, F.col("pointsHome")).otherwise(F.col("pointsAway"))).cast("double").alias("points_for"),
        F.sum(F.when(home, F.col("pointsAway")).otherwise(F.col("pointsHome"))).cast("double").alias("points_against"),
    )
    own = events.where(F.col("isTurnover") | F.col("isMadeShot")).groupBy(c.game, F.col(c.person).alias("personId")).agg(F.count(F.lit(1)).cast("double").alias("used_offensive_possessions"))
    base = played.select("gameId", "personId").join(whole, "gameId").join(out, ["gameId", "personId"], "left").join(own, ["gameId", "personId"], "left")
    return base.select("gameId", "personId", F.lit("event_estimated").alias("method"), *[F.coalesce(v, F.lit(0.0)).alias(v) for v in VALUES])


def from_boxscore(played: DataFrame, teams: DataFrame) -> DataFrame:
    """Estimate by the share of minutes: seconds / (team seconds / 5) of the game's possessions estimate.

    teams: gameId, teamId, fga, fta, oreb, tov, points, seconds; played also has teamId, seconds, fga, fta, tov.
    """
    t = opponents(teams, "gameId", "teamId", None, ["fga", "fta", "oreb", "tov", "points"])
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    estimate = possessions_estimate(*[z(x) for x in ("fga", "fta", "oreb", "tov")], *[z(f"opponent_{x}") for x in ("fga", "fta", "oreb", "tov")])
    t = t.where("seconds > 0").select("gameId", "teamId", estimate.alias("_poss"), F.col("seconds").alias("_team_seconds"), z("points").alias("_for"), z("opponent_points").alias("_against"))
    rows = played.join(t, ["gameId", "teamId"], "left")
    whole = rows.groupBy("gameId").agg(F.bool_and(F.col("_poss").isNotNull()).alias("ok")).where("ok").select("gameId")
    share = z("seconds") / (F.col("_team_seconds") / 5.0)
    return rows.join(whole, "gameId", "left_semi").select(
        "gameId", "personId", F.lit("boxscore_estimated").alias("method"), (share * F.col("_poss")).alias("offensive_possessions"), (share * F.col("_poss")).alias("defensive_possessions"),
        (z("fga") + 0.44 * z("fta") + z("tov")).alias("used_offensive_possessions"), (share * F.col("_for")).alias("points_for"), (share * F.col("_against")).alias("points_against"),
    )


def waterfall(parts: Sequence[DataFrame], everyone: DataFrame, keys: Sequence[str], game: str = "gameId", methods: Sequence[str] = METHODS) -> DataFrame:
    """For each game the rows of its first method that has any; games without one get rows with method missing."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    rank = F.coalesce(*[F.when(F.col("method") == m, i) for i, m in enumerate(methods)])
    best = whole.select(game, rank.alias("_r")).groupBy(game).agg(F.min("_r").alias("_best"))
    chosen = whole.withColumn("_r", rank).join(best, game).where("_r = _best").drop("_r", "_best")
    values = [c for c in whole.columns if c not in (*keys, "method")]
    out = everyone.select(*keys).distinct().join(chosen, list(keys), "left")
    return out.select(*keys, F.coalesce("method", F.lit("missing")).alias("method"), *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def team_possessions(rows: DataFrame, method: str = "exact") -> DataFrame:
    """(gameId, teamId, method, values) of teams from counted possessions with known sides."""
    counted = rows.where("countsAsPossession")
    whole = counted.groupBy("gameId").agg(F.bool_and(F.col("offenseTeamId").isNotNull() & F.col("defenseTeamId").isNotNull()).alias("ok")).where("ok")
    counted = counted.join(whole.select("gameId"), "gameId", "left_semi")
    pts = F.coalesce(F.col("pointsScoredOnPossession"), F.lit(0)).cast("double")
    both = F.explode(F.array(F.struct(F.col("offenseTeamId").alias("t"), F.lit(1.0).alias("off")), F.struct(F.col("defenseTeamId").alias("t"), F.lit(0.0).alias("off"))))
    x = counted.select("gameId", pts.alias("pts"), both.alias("s"))
    off = F.col("s.off")
    return x.groupBy("gameId", F.col("s.t").alias("teamId")).agg(
        F.sum(off).alias("offensive_possessions"), F.sum(1 - off).alias("defensive_possessions"), F.sum(off * F.col("pts")).alias("points_for"), F.sum((1 - off) * F.col("pts")).alias("points_against")
    ).select("gameId", "teamId", F.lit(method).alias("method"), "offensive_possessions", "defensive_possessions", "points_for", "points_against")


def team_points(rows: DataFrame, whole: DataFrame, played: DataFrame, counts: Column, method: str) -> DataFrame:
    """Team values of events in `whole` games: counted possessions by resolved sides, points by score changes."""
    n = lambda side: F.sum(F.when(counts & (F.col(side) == F.col("_team")), 1.0).otherwise(0.0))
    home = F.col("_team") == F.col("homeTeamId")
    points = lambda mine, theirs: F.sum(F.coalesce(F.when(home, F.col(mine)).otherwise(F.col(theirs)), F.lit(0))).cast("double")
    x = rows.join(whole, "gameId", "left_semi").withColumn("_team", F.explode(F.array("homeTeamId", "awayTeamId")))
    sums = x.groupBy("gameId", F.col("_team").alias("teamId")).agg(
        n("resolvedOffenseTeamId").alias("offensive_possessions"), n("resolvedDefenseTeamId").alias("defensive_possessions"),
        points("pointsHome", "pointsAway").alias("points_for"), points("pointsAway", "pointsHome").alias("points_against"),
    )
    names = ("offensive_possessions", "defensive_possessions", "points_for", "points_against")
    out = played.select("gameId", "teamId").distinct().join(whole, "gameId").join(sums, ["gameId", "teamId"], "left")
    return out.select("gameId", "teamId", F.lit(method).alias("method"), *[F.coalesce(v, F.lit(0.0)).alias(v) for v in names])


def team_possessions_from_events(events: DataFrame, played: DataFrame) -> DataFrame:
    """Teams' estimate from events that count as possessions; each must have both sides, of the teams that played."""
    counts = F.coalesce(F.col("countAsPossession"), F.lit(False))
    teams = played.groupBy("gameId").agg(F.collect_set("teamId").alias("_teams"))
    known = F.coalesce(F.array_contains("_teams", F.col("resolvedOffenseTeamId")) & F.array_contains("_teams", F.col("resolvedDefenseTeamId")), F.lit(False))
    whole = events.where(counts).join(teams, "gameId").groupBy("gameId").agg(F.bool_and(known).alias("ok")).where("ok").select("gameId")
    return team_points(events, whole, played, counts, "event_estimated")


def whole_games(rows: DataFrame, known: Column) -> DataFrame:
    """`rows` of the games in which `known` holds for every row."""
    return rows.join(rows.groupBy("gameId").agg(F.bool_and(F.coalesce(known, F.lit(False))).alias("ok")).where("ok").select("gameId"), "gameId", "left_semi")


def team_possessions_from_boxscore(teams: DataFrame) -> DataFrame:
    """Teams' estimate from the box score of games in which every team has an opponent (columns as in from_boxscore)."""
    t = opponents(teams, "gameId", "teamId", None, ["fga", "fta", "oreb", "tov", "points"])
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    estimate = possessions_estimate(*[z(x) for x in ("fga", "fta", "oreb", "tov")], *[z(f"opponent_{x}") for x in ("fga", "fta", "oreb", "tov")])
    return t.select("gameId", "teamId", F.lit("boxscore_estimated").alias("method"), estimate.alias("offensive_possessions"), estimate.alias("defensive_possessions"), z("points").alias("points_for"), z("opponent_points").alias("points_against"))


def team_defensive_shots(events: DataFrame, played: DataFrame, teams: DataFrame) -> list[DataFrame]:
    """Parts (exact, event- and boxscore-estimated) of opponents' two-point attempts: (gameId, teamId, method, value).

    Exact: each attempt's resolved defence. Event-estimated: without it, the other team than the resolved offence.
    """
    shots = events.where((F.col("isMadeShot") | F.col("isMissedShot")) & (F.col("shotValue") == 2))
    o, h, a = F.col("resolvedOffenseTeamId"), F.col("homeTeamId"), F.col("awayTeamId")
    other = F.when(o == h, a).when(o == a, h)
    pairs = played.select("gameId", "teamId").distinct()
    parts = []
    for method, defence in (("exact", F.col("resolvedDefenseTeamId")), ("event_estimated", F.coalesce("resolvedDefenseTeamId", other))):
        x = shots.select("gameId", defence.alias("teamId")).join(pairs.withColumn("_in", F.lit(True)), ["gameId", "teamId"], "left")
        x = whole_games(x, F.col("_in"))
        n = x.groupBy("gameId", "teamId").agg(F.count(F.lit(1)).cast("double").alias("_n"))
        out = pairs.join(x.select("gameId").distinct(), "gameId").join(n, ["gameId", "teamId"], "left")
        parts.append(out.select("gameId", "teamId", F.lit(method).alias("method"), F.coalesce("_n", F.lit(0.0)).alias("opponent_two_point_attempts")))
    t = opponents(teams, "gameId", "teamId", None, ["fga", "fg3a"])
    parts.append(t.select("gameId", "teamId", F.lit("boxscore_estimated").alias("method"), two_point_attempts().alias("opponent_two_point_attempts")))
    return parts


def two_point_attempts() -> Column:
    """The opponent's two-point attempts in the box score."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    return F.greatest(z("opponent_fga") - z("opponent_fg3a"), F.lit(0.0))


def contexts_from_boxscore(played: DataFrame, teams: DataFrame) -> dict[str, DataFrame]:
    """The player contexts estimated by minutes, for games in which every player has a team with minutes and an opponent.

    teams: gameId, teamId, seconds, fga, fg3a, fgm, reb; played also has teamId, seconds, fgm.
    """
    t = opponents(teams, "gameId", "teamId", None, ["fga", "fg3a", "fgm", "fg3m", "reb"]).where("seconds > 0")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    made = F.greatest(z("opponent_fgm") - z("opponent_fg3m"), F.lit(0.0))
    t = t.select("gameId", "teamId", F.col("seconds").alias("_team"), z("fgm").alias("_fgm"), z("reb").alias("_reb"), z("opponent_reb").alias("_other"), two_point_attempts().alias("_twos"), made.alias("_twos_made"))
    rows = whole_games(played.select("gameId", "personId", "teamId", z("seconds").alias("_s"), z("fgm").alias("_own")).join(t, ["gameId", "teamId"], "left"), F.col("_team").isNotNull())
    share = F.col("_s") / (F.col("_team") / 5.0)
    values = {
        "defensive_shot": {"opponent_two_point_attempts": share * F.col("_twos"), "opponent_two_point_makes": share * F.col("_twos_made")},
        "assist": {"teammate_field_goals_made": F.greatest(share * F.col("_fgm") - F.col("_own"), F.lit(0.0))},
        "rebound": {"own_rebounds_on_court": share * F.col("_reb"), "other_rebounds_on_court": share * F.col("_other"), "rebound_opportunities": share * (F.col("_reb") + F.col("_other"))},
    }
    return {k: rows.select("gameId", "personId", F.lit("boxscore_estimated").alias("method"), *[v.alias(n) for n, v in x.items()]) for k, x in values.items()}


def per_player(events: DataFrame, lineups: DataFrame, played: DataFrame, counted: dict[str, tuple[Column, str]], method: str, c: Cols = Cols(), context: DataFrame | None = None) -> DataFrame:
    """Counts of events while a player is on court, for games in which each such event has a lineup and one of its teams.

    `counted`: output -> (which events, whose players: offense, defense, teammates (offence without the event's own
    player) or both). This is the core of the defensive-shot, assist and rebound contexts. `context`: one row per event
    with its own fives (gameId, actionNumber, home_teamId, away_teamId, home_personIds, away_personIds) instead of stints,
    for the event-estimated method.
    """
    any_event = None
    for test, _ in counted.values():
        any_event = test if any_event is None else any_event | test
    need = events.where(F.coalesce(any_event, F.lit(False)))
    if context is None:
        placed = on_court(need, lineups, c)
    else:
        at = context.select(F.col("gameId").alias(c.game), F.col("actionNumber").alias(c.action), "home_personIds", "away_personIds", F.col("home_teamId").alias("stint_home"), F.col("away_teamId").alias("stint_away"))
        placed = need.join(at, [c.game, c.action], "left")
    ours = F.coalesce((F.col(c.team) == F.col("stint_home")) | (F.col(c.team) == F.col("stint_away")), F.lit(False))
    ok = F.col("home_personIds").isNotNull() & F.col("away_personIds").isNotNull() & ours
    broken = placed.groupBy(c.game).agg(F.bool_and(ok).alias("ok")).where("not ok").select(c.game)
    home_attacks = F.col(c.team) == F.col("stint_home")
    role = lambda people, off: F.transform(people, lambda p: F.struct(p.alias("personId"), F.lit(off).alias("off")))
    off = F.when(home_attacks, F.col("home_personIds")).otherwise(F.col("away_personIds"))
    de = F.when(home_attacks, F.col("away_personIds")).otherwise(F.col("home_personIds"))
    on = placed.where(ok).withColumn("p", F.explode(F.concat(role(off, True), role(de, False))))
    who = {"offense": F.col("p.off"), "defense": ~F.col("p.off"), "both": F.lit(True), "teammates": F.col("p.off") & ~F.col("p.personId").eqNullSafe(F.col(c.person))}
    sums = on.groupBy(c.game, F.col("p.personId").alias("personId")).agg(*[F.sum(F.when(test & who[w], 1.0).otherwise(0.0)).alias(n) for n, (test, w) in counted.items()])
    base = played.select("gameId", "personId").join(broken, "gameId", "left_anti").join(events.select(c.game).distinct(), "gameId", "left_semi")
    return base.join(sums, ["gameId", "personId"], "left").select("gameId", "personId", F.lit(method).alias("method"), *[F.coalesce(n, F.lit(0.0)).alias(n) for n in counted])


def contexts(c: Cols = Cols()) -> dict[str, dict[str, tuple[Column, str]]]:
    """The events counted by the defensive-shot, assist and rebound contexts."""
    two = (F.col("isMadeShot") | F.col("isMissedShot")) & (F.coalesce(F.col("shotValue"), F.lit(2)) == 2)
    missed = F.col("isRebound") & F.col("isRealRebound")
    return {
        "defensive_shot": {"opponent_two_point_attempts": (two, "defense"), "opponent_two_point_makes": (two & F.col("isMadeShot"), "defense")},
        "assist": {"teammate_field_goals_made": (F.col("isMadeShot"), "teammates")},
        "rebound": {
            "own_rebounds_on_court": (missed, "offense"), "other_rebounds_on_court": (missed, "defense"), "rebound_opportunities": (missed, "both"),
        },
    }


def by_minutes(played: DataFrame, teams: DataFrame, values: dict[str, Column], method: str = "boxscore_estimated") -> DataFrame:
    """A player's share, by minutes, of team values (over the team row and its opponent_ columns)."""
    rows = played.select("gameId", "personId", "teamId", F.col("seconds").alias("_s")).join(teams, ["gameId", "teamId"])
    share = ratio(F.col("_s"), F.col("seconds") / 5.0)
    return rows.select("gameId", "personId", F.lit(method).alias("method"), *[F.coalesce(share * v, F.lit(0.0)).alias(n) for n, v in values.items()])


def finalized(rows: DataFrame, keys: Sequence[str] = ("gameId", "personId")) -> DataFrame:
    """Totals, method flags, possessions by method and season fields for the context tables."""
    flags = {f"{m}_game_flag": (F.col("method") == m).cast("int") for m in (*METHODS, "missing")}
    total = F.col("offensive_possessions") + F.col("defensive_possessions")
    counts = {f"{m}_possessions_count": F.when(F.col("method") == m, total).otherwise(0.0) for m in METHODS}
    return rows.withColumns(flags | counts | {"total_possessions": total, "row_in_game": F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys))})
