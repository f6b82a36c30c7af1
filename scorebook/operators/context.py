"""Context of events: names and sides from the box score, game state, and who is on court."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions.text import lineup_id, null_if_empty, replaced_name
from scorebook.operators.attribution import on_court
from scorebook.operators.sequence import Cols


def box_context(events: DataFrame, teams: DataFrame, players: DataFrame, named: dict[str, tuple[str, str | None]] | None = None, c: Cols = Cols()) -> DataFrame:
    """Events with side, names of team and opponent, full names of persons, and who came in.

    teams: gameId, team_side, teamId, teamCity, teamName; a game with two teams has opponents. players: gameId, personId,
    name. `named`: output -> (person column, column with a name to fall back on). A substitute named in the description
    is found if only one of the game's players has that name.
    """
    named = named or {"playerFullName": (c.person, None), "stealFullName": (c.steal, None), "blockFullName": ("blockPersonId", None)}
    g = F.col("gameId").alias(c.game)
    own = teams.select(g, F.col("teamId").alias(c.team), F.when(F.col("team_side") == "home", "h").otherwise("v").alias("location"), null_if_empty(F.col("teamCity")).alias("playerteamCity"), null_if_empty(F.col("teamName")).alias("playerteamName"))
    pair = Window.partitionBy(c.game)
    own = own.withColumn("_all", F.collect_list(F.struct(F.col(c.team).alias("t"), F.col("playerteamCity").alias("city"), F.col("playerteamName").alias("name"))).over(pair))
    other = F.when(F.size("_all") == 2, F.filter("_all", lambda x: x["t"] != F.col(c.team))[0])
    own = own.withColumns({"opponentteamCity": other["city"], "opponentteamName": other["name"]}).drop("_all")
    out = events.join(own, [c.game, c.team], "left")
    roster = players.select(g, F.col("personId").alias("_p"), null_if_empty(F.col("name")).alias("_full")).where("_p is not null and _full is not null").groupBy(c.game, "_p").agg(F.max("_full").alias("_full"))
    for name, (person, fallback) in named.items():
        full = roster.withColumnRenamed("_p", person).withColumnRenamed("_full", "_name")
        known = out.join(full, [c.game, person], "left")
        out = known.withColumn(name, F.coalesce("_name", null_if_empty(F.col(fallback))) if fallback else F.col("_name")).drop("_name")
    if "description" in events.columns:
        key = lambda x: F.lower(F.trim(x))
        one = roster.groupBy(c.game, key(F.col("_full")).alias("_key")).agg(F.count_distinct("_p").alias("_n"), F.max("_p").alias("subsInPersonId"), F.max("_full").alias("subsInFullName")).where("_n = 1").drop("_n")
        out = out.withColumn("_key", key(replaced_name(F.col("description")))).join(one, [c.game, "_key"], "left").drop("_key")
    return out


def game_state(df: DataFrame, c: Cols = Cols()) -> DataFrame:
    """Enriched events with the game's teams (home and away, else in order of appearance), offence of record, running sums.

    offenseOfRecord: a real defensive rebound ends the possession of the offence before it. teamScore and personFouls are
    those of the event's team and person up to it.
    """
    game = Window.partitionBy(c.game).orderBy(c.period, c.order)
    first = df.where(F.col(c.team) > 0).groupBy(c.game, c.team).agg(F.min(F.struct(c.period, c.order)).alias("at"))
    teams = first.groupBy(c.game).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", c.team))), lambda x: x[c.team]).alias("orderedTeamIds"))
    dreb = F.col("isRealRebound") & ~F.col("isOreb")
    points = F.when(F.col("isMadeShot"), F.coalesce(F.col("shotValue"), F.lit(0))).when(F.col("isFreeThrow") & (F.lower(F.trim(F.col(c.result))) == "made"), 1).otherwise(0)
    upto = lambda key: Window.partitionBy(c.game, key).orderBy(c.period, c.order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({
        "offenseOfRecord": F.when(dreb, F.coalesce(F.lag("resolvedOffenseTeamId").over(game), F.col("resolvedOffenseTeamId"))).otherwise(F.col("resolvedOffenseTeamId")),
        "teamScore": F.sum(points).over(upto(c.team)), "personFouls": F.sum(F.col("isFoul").cast("int")).over(upto(c.person)),
    })
    known = F.col("homeTeamId").isNotNull() & F.col("awayTeamId").isNotNull()
    return out.join(teams, c.game, "left").withColumn("orderedTeamIds", F.when(known, F.array("homeTeamId", "awayTeamId")).otherwise(F.col("orderedTeamIds")))


def event_context(events: DataFrame, lineups: DataFrame, c: Cols = Cols()) -> DataFrame:
    """(game, event) with players on court, lineup ids and fouls to give of both sides, and the starters of a period.

    Starters stand on the first event of each period. `context_issues` finds what mustn't be.
    """
    placed = on_court(events, lineups, c)
    start = F.lag(c.order).over(c.by_period).isNull()
    ids = {f"{s}_current_player_ids": F.array_sort(f"{s}_personIds") for s in ("home", "away")}
    out = placed.withColumns(ids | {f"{s}_lineup_id": lineup_id(F.col(f"{s}_personIds")) for s in ("home", "away")} | {f"{s}_period_starter_ids": F.when(start, F.array_sort(f"{s}_personIds")) for s in ("home", "away")})
    return out.select(
        F.col(c.game).alias("game_id"), F.col(c.action).alias("event_num"), F.col("homeTeamId").alias("home_team_id"), F.col("awayTeamId").alias("away_team_id"), *ids, "home_lineup_id", "away_lineup_id",
        F.col("homeFoulsToGive").alias("home_fouls_to_give"), F.col("awayFoulsToGive").alias("away_fouls_to_give"), "home_period_starter_ids", "away_period_starter_ids",
    )


def context_issues(context: DataFrame) -> DataFrame:
    """(game_id, event_num, issue): duplicate events, sides that can't be told apart, lineup ids unlike their players."""
    unlike = lambda s: F.col(f"{s}_lineup_id").isNull() | ~F.col(f"{s}_lineup_id").eqNullSafe(lineup_id(F.col(f"{s}_current_player_ids")))
    sides = F.col("home_team_id").isNull() | F.col("away_team_id").isNull() | (F.col("home_team_id") == F.col("away_team_id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("game_id", "event_num"))
    found = F.array_compact(F.array(F.when(n > 1, "duplicate_event"), F.when(sides, "unusable_sides"), F.when(unlike("home") | unlike("away"), "lineup_id_mismatch")))
    return context.withColumn("_found", found).select("game_id", "event_num", F.explode("_found").alias("issue")).distinct()
