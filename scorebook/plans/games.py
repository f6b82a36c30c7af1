"""Registered queries of event sequences, lineups and attribution over games made from the event table.

A user's month is a game of up to four periods and an overtime; purchases and clicks are shots, views rebounds, errors
turnovers, sign-ups fouls or substitutions. Two teams of eight take turns every three events. A substitution is a pair
(out, in) on one clock: a team's n-th takes its n-th player off and brings the (n + 5)-th, counted round the eight, so
fives turn. Some fouls bring two free throws, some of those with a timeout in between; some turnovers a timeout. In every
tenth game the last event of period 4 is a substitution that can't be, in every other tenth the game's second one is; in
every fourth, substitutions also come within possessions. The rules are those of real games; the rows follow the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorebook.operators import attribution, context, lineups, sequence
from scorebook.operators.relational import percentiles
from scorebook.plans import game_sql
from scorebook.plans.demo import tables
from scorebook.sources.stored import dealt, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HOME, AWAY = 100, 200


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(tables(spark, d), spark, d)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def raw_events(t: dict[str, DataFrame]) -> DataFrame:
    """The events of all games, dealt by game once; all windows stay within a game."""
    period = (F.floor((F.dayofmonth("ts") - 1) / 7) + 1).cast("long")
    e = t["events"].select(F.lpad(F.col("user_id").cast("string"), 10, "0").alias("gameId"), F.col("user_id").alias("u"), period.alias("period"), F.col("event_id").alias("e"), F.col("event_type").alias("kind"), "value")
    e = dealt(e, "gameId")
    w = Window.partitionBy("gameId", "period").orderBy("e")
    e = e.withColumns({"k": F.row_number().over(w), "last": F.lead("e").over(w).isNull()})
    possession = (F.lit(HOME) + F.floor(F.col("k") / 3) % 2 * (AWAY - HOME)).cast("long")
    forced = (F.col("u") % 10 == 0) & (F.col("period") == 4) & F.col("last") & (F.col("k") % 6 != 1)  # else it would share a clock with the one before
    swap = (F.col("kind") == "signup") & ((F.col("k") % 6 == 0) | (F.col("k") == 1) | ((F.col("u") % 4 == 1) & (F.col("k") % 6 == 4)))
    e = e.withColumns({"possession": possession, "forced": forced, "swap": swap | forced})
    e = e.withColumn("teamId", F.when(F.col("e") % 5 == 0, F.lit(HOME + AWAY) - F.col("possession")).otherwise(F.col("possession")).cast("long"))
    game = Window.partitionBy("gameId").orderBy("period", "e").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda test, over: F.coalesce(F.sum(test.cast("int")).over(over), F.lit(0))
    own = lambda team: count(F.col("swap") & (F.col("teamId") == team), game.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumns({"bad": F.col("swap") & (F.col("forced") | ((F.col("u") % 10 == 5) & (count(F.col("swap"), game) == 2))), "j": F.when(F.col("teamId") == HOME, own(HOME)).otherwise(own(AWAY))})
    absent, doubled = F.col("bad") & (F.col("u") % 20 < 10), F.col("bad") & (F.col("u") % 20 >= 10)
    nth = lambda n: F.col("teamId") + (F.col("j") + n) % 8
    leaves, comes = nth(F.when(absent, 6).otherwise(0)), nth(F.when(doubled, 1).otherwise(5))
    is_ = lambda *kinds: ~F.col("swap") & F.col("kind").isin(*kinds)
    foul, turnover = is_("signup"), is_("error")
    parts = (
        F.when(F.col("swap"), F.array(F.lit("out"), F.lit("in"))).when(foul & (F.col("e") % 6 == 0), F.array(*[F.lit(x) for x in ("", "1 of 2", "timeout", "2 of 2")]))
        .when(foul & (F.col("e") % 3 == 0), F.array(F.lit(""), F.lit("1 of 2"), F.lit("2 of 2"))).when(turnover & (F.col("e") % 4 == 0), F.array(F.lit(""), F.lit("timeout"))).otherwise(F.array(F.lit("")))
    )
    e = e.select("*", leaves.alias("leaves"), comes.alias("comes"), F.posexplode(parts).alias("s", "part"))
    plain, throw = F.col("part") == "", F.col("part").endswith(" of 2")
    goal, three = is_("click", "purchase"), F.col("kind") == "purchase"
    hit = F.when(throw, (F.floor("value") + F.col("s")) % 2 == 0).otherwise(goal & (F.col("value") > 9))
    points = F.when(hit & throw, 1).when(hit & three, 3).when(hit, 2).otherwise(0)
    left = F.greatest(F.when(F.col("period") <= 4, 720.0).otherwise(300.0) - F.floor(F.col("k") / 2) * 17.5, F.lit(0.0))
    kinds = F.when(F.col("swap"), "substitution").when(throw, "freethrow").when(F.col("part") == "timeout", "timeout").when(F.col("kind") == "click", "2pt").when(F.col("kind") == "purchase", "3pt").when(F.col("kind") == "view", "rebound").when(F.col("kind") == "error", "turnover").otherwise("foul")
    sub_type = F.when(~plain, F.when(F.col("part") != "timeout", F.col("part"))).when(F.col("kind") == "view", F.when(F.col("teamId") == F.col("possession"), "offensive").otherwise("defensive")).when(F.col("kind") == "error", "badpass").otherwise("personal")
    team = F.when(throw, F.col("possession")).otherwise(F.col("teamId"))
    person = F.when(F.col("part") == "out", F.col("leaves")).when(F.col("part") == "in", F.col("comes")).when(F.col("part") == "timeout", None).otherwise(team + F.col("e") % 8)
    e = e.withColumns({"orderNumber": F.col("e") * 4 + F.col("s"), "type": kinds, "subType": sub_type, "hit": hit, "points": points, "clock": F.format_string("PT%02dM%05.2fS", F.floor(left / 60), left - F.floor(left / 60) * 60), "person": person.cast("long"), "goal": goal & plain, "throw": throw, "teamId": team})
    score = Window.partitionBy("gameId").orderBy("period", "orderNumber").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda side: F.sum(F.when(F.col("teamId") == side, F.col("points")).otherwise(0)).over(score)
    before = F.lag(F.when(F.col("goal"), F.col("orderNumber"))).over(Window.partitionBy("gameId", "period").orderBy("orderNumber"))
    return e.select(
        "gameId", "period", "orderNumber", F.col("orderNumber").alias("actionNumber"), F.col("type").alias("actionType"), "subType", F.lit(None).cast("string").alias("descriptor"), F.array().cast("array<string>").alias("qualifiers"), "clock",
        F.when(F.col("goal") | F.col("throw"), F.when(F.col("hit"), "Made").otherwise("Missed")).alias("shotResult"), F.col("goal").cast("long").alias("isFieldGoal"), "teamId", F.col("person").alias("personId"), "possession",
        F.when((F.col("type") == "turnover") & (F.col("e") % 2 == 0), F.col("e") % 8).alias("stealPersonId"), before.alias("shotActionNumber"), F.when(F.col("goal"), F.when(three, 3).otherwise(2)).cast("long").alias("shotValue"), F.lit(None).cast("long").alias("blockPersonId"),
        total(HOME).alias("scoreHome"), total(AWAY).alias("scoreAway"), F.lit(HOME).cast("long").alias("homeTeamId"), F.lit(AWAY).cast("long").alias("awayTeamId"), (F.col("value") * 10 - 100).alias("xLegacy"), (F.col("e") % 280).cast("double").alias("yLegacy"), F.lit(None).cast("double").alias("shotDistance"),
    )


def box(t: dict[str, DataFrame]) -> DataFrame:
    """Box score: both teams' eight, the first five as starters, with minutes and sums of their events."""
    games = t["events"].select(F.lpad(F.col("user_id").cast("string"), 10, "0").alias("gameId")).distinct()
    side = lambda s, team: games.select("gameId", F.lit(team).cast("long").alias("teamId"), F.lit(s).alias("team_side"), F.explode(F.sequence(F.lit(team).cast("long"), F.lit(team + 7).cast("long"))).alias("personId"))
    people = side("home", HOME).unionByName(side("away", AWAY))
    n = F.col("personId") - F.col("teamId")
    return people.withColumns({"starter": (n < 5).cast("long"), "seconds": (F.lit(2880) - n * 200).cast("long")})


@dataclass(frozen=True)
class Game:
    """Layers of all games, each stored once."""

    events: DataFrame
    box: DataFrame
    stints: DataFrame  # as read
    effective: DataFrame  # after repairs

    @property
    def repaired(self) -> DataFrame:
        """Games with a repaired overtime."""
        return self.effective.where(~F.col("method").isin("exact", "unrepaired")).select("gameId").distinct()

    def possessions(self) -> DataFrame:
        return lineups.possessions(dealt(self.events, "gameId"))


LAYERS: dict[tuple[str, str], Game] = {}


def still_there(spark: SparkSession, df: DataFrame) -> bool:
    """Whether the first file of a stored layer exists."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path((df.inputFiles() or ["/"])[0])
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def known(spark: SparkSession, d: str) -> Game | None:
    """The layers of the games of a folder if this application has them and they haven't been deleted."""
    g = LAYERS.get((spark.sparkContext.applicationId, d))
    return g if g and still_there(spark, g.events) and still_there(spark, g.effective) else None


def game(t, spark: SparkSession, d: str) -> Game:
    """The layers of the games of a folder, worked out once in an application, or again once they have been deleted."""
    if (g := known(spark, d)) is None:
        events = stored(sequence.enriched(raw_events(t)))
        b = box(t)
        s = stored(lineups.stints(dealt(events, "gameId"), b))
        g = LAYERS[(spark.sparkContext.applicationId, d)] = Game(events, b, s, stored(lineups.effective(s, events)))
    return g


def team_box(events: DataFrame, *names: str) -> DataFrame:
    """Teams' box score as sums of their events; with names, these sums alone."""
    n = lambda x: F.sum(F.coalesce(x, F.lit(False)).cast("int"))
    c = F.col
    three = c("shotValue") == 3
    sums = {
        "fga": F.sum("isFieldGoal"), "fta": n(c("isFreeThrow")), "oreb": n(c("isOreb")), "tov": n(c("isTurnover")),
        "points": F.max(F.when(c("teamId") == c("homeTeamId"), c("scoreHome")).otherwise(c("scoreAway"))),
        "fg3a": n((c("isFieldGoal") == 1) & three), "fgm": n(c("isMadeShot")), "fg3m": n(c("isMadeShot") & three), "reb": n(c("isRebound") & c("isRealRebound")),
    }
    return events.where("teamId is not null").groupBy("gameId", "teamId").agg(*[sums[x].alias(x) for x in names or sums]).withColumn("seconds", F.lit(14400))


def player_box(g: Game) -> DataFrame:
    """Players' box score with sums of their events."""
    n = lambda x: F.sum(F.col(x).cast("int"))
    own = g.events.groupBy("gameId", "personId").agg(F.sum("isFieldGoal").alias("fga"), n("isFreeThrow").alias("fta"), n("isTurnover").alias("tov"), n("isMadeShot").alias("fgm"))
    return g.box.join(own, ["gameId", "personId"], "left")


@query(game_sql.EVENT_FLAGS)
def event_flags(t, spark, d):
    e = sequence.neighbours(sequence.event_flags(raw_events(t)))
    return e.select("gameId", "orderNumber", "isMadeShot", "isMissedShot", "isRebound", "isTurnover", "isFreeThrow", "isTimeout", "isSubstitution", "prevOrderNumber", "nextOrderNumber")


@query(game_sql.EVENT_CLASSES)
def event_classes(t, spark, d):
    """Turnover, foul and free-throw classes, and the places of free throws in their trips."""
    e = sequence.class_flags(sequence.event_flags(raw_events(t)))
    return e.select("gameId", "orderNumber", "isOreb", "isDreb", "countsTowardsPenalty", "isBadPassTurnover", F.col("freeThrowNumber").cast("int").alias("freeThrowNumber"), F.col("freeThrowOf").cast("int").alias("freeThrowOf"), "isEndFreeThrow")


@query(game_sql.FREE_THROW_TRIPS)
def free_throw_trips(t, spark, d):
    """Trips to the line, put together across what comes between their throws."""
    return sequence.free_throw_trips(sequence.class_flags(sequence.event_flags(raw_events(t))))


@query(game_sql.ENRICHED)
def enriched_events(t, spark, d):
    """All event enrichments."""
    return sequence.enriched(raw_events(t)).select("gameId", "period", "orderNumber", "resolvedOffenseTeamId", "offenseHomeAway", "isPossessionEndingEvent", "countAsPossession", "possessionBoundaryReason", "isRealRebound", "isSecondChanceEvent", "foulsToGiveDefense", "isPenaltyEvent", "scoreMarginBefore", "scoreMarginAfter")


@query(game_sql.SHOT_LOCATIONS)
def shot_locations(t, spark, d):
    return sequence.shot_locations(sequence.event_flags(raw_events(t))).select("gameId", "orderNumber", "shotZone", "shotRange", "locationReason")


@query(game_sql.BOX_CONTEXT)
def box_context(t, spark, d):
    """Events with sides and names of the box score; two players share a name, one of each team has none."""
    b = box(t)
    n = F.col("personId") % 100
    players = b.select("gameId", "personId", F.when(n < 7, F.concat(F.lit("P "), F.when(F.col("personId") == 203, 103).otherwise(F.col("personId")).cast("string"))).otherwise(" ").alias("name"))
    home = F.col("team_side") == "home"
    teams = b.select("gameId", "team_side", "teamId", F.when(home, "Hall").otherwise("Vale").alias("teamCity"), F.when(home, "Homers").otherwise("Visitors").alias("teamName")).distinct()
    events = raw_events(t).withColumn("description", F.when(F.col("actionType") == "substitution", F.concat(F.lit("SUB: X replaced by p "), F.col("personId").cast("string"))))
    out = context.box_context(events, teams, players)
    return out.select("gameId", "orderNumber", "location", "playerteamCity", "opponentteamName", "playerFullName", "stealFullName", "subsInPersonId")


@query(game_sql.GAME_STATE)
def game_state(t, spark, d):
    """Teams in order of appearance, offence of record, running scores and fouls."""
    out = context.game_state(sequence.enriched(raw_events(t)))
    return out.select("gameId", "orderNumber", "offenseOfRecord", F.col("teamScore").cast("long").alias("teamScore"), "personFouls", F.array_join("orderedTeamIds", ",").alias("orderedTeamIds"))


@query(game_sql.EVENT_CONTEXT)
def event_context(t, spark, d):
    """Players on court, lineup ids and fouls to give at every event."""
    g = game(t, spark, d)
    out = context.event_context(g.events, g.effective)
    return out.select("game_id", "event_num", "home_team_id", "away_team_id", "home_lineup_id", "away_lineup_id", F.when(F.col("home_current_player_ids").isNotNull(), F.size("home_current_player_ids")).alias("home_players"), "home_fouls_to_give", "away_fouls_to_give", F.array_join("away_period_starter_ids", "-").alias("away_starters"))


@query(game_sql.CONTEXT_ISSUES)
def context_issues(t, spark, d):
    """Events whose context can't be right."""
    g = game(t, spark, d)
    return context.context_issues(context.event_context(g.events, g.effective)).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def with_ids(s: DataFrame) -> DataFrame:
    return s.withColumns({"home_lineup": F.array_join("home_personIds", "-"), "away_lineup": F.array_join("away_personIds", "-")}).drop("home_personIds", "away_personIds")


@query(game_sql.LINEUP_STINTS)
def lineup_stints(t, spark, d):
    """Stints as read, with both fives."""
    return with_ids(game(t, spark, d).stints)


@query(game_sql.EFFECTIVE_STINTS)
def effective_stints(t, spark, d):
    """Stints after repairs, with method, failed period and whether opening substitutions were applied."""
    return with_ids(game(t, spark, d).effective)


@query(game_sql.POSSESSION_ROWS)
def possessions(t, spark, d):
    """Possessions with their lineups as read."""
    g = game(t, spark, d)
    return lineups.stamped(g.possessions(), g.stints)


@query(game_sql.POSSESSION_REPAIRED)
def possessions_repaired(t, spark, d):
    """Lineups of the possessions of repaired games."""
    g = game(t, spark, d)
    rows = lineups.stamped(g.possessions(), g.effective).join(g.repaired, "gameId", "left_semi")
    return rows.select("gameId", "possessionNumber", "period", "homeLineupId", "awayLineupId", "lineupValidFlag", "lineupIssue")


@query(game_sql.STARTER_CHECK)
def starter_check(t, spark, d):
    g = game(t, spark, d)
    played = g.events.where("personId is not null").select("gameId", "period", "teamId", "personId").distinct()
    return lineups.starter_check(g.events, g.effective, played).select("gameId", "period", "teamId", "status")


@query(game_sql.PLAYER_POSSESSIONS)
def player_possessions(t, spark, d):
    """Possessions and points on court by the best method of each game: exact, repaired, from events, by minutes."""
    g = game(t, spark, d)
    rows, played = stored(g.possessions()), stored(player_box(g))
    read, repaired = stored(lineups.stamped(rows, g.stints)), stored(lineups.stamped(rows.join(g.repaired, "gameId", "left_semi"), g.effective))
    parts = [
        attribution.from_possessions(read, played, "exact", attribution.used_players(read, g.events)), attribution.from_possessions(repaired, played, "ot_fallback", attribution.used_players(repaired, g.events)),
        attribution.from_events(g.events, g.effective, played), attribution.from_boxscore(played, team_box(g.events)),
    ]
    return attribution.finalized(attribution.waterfall(parts, played, ["gameId", "personId"]))


@query(game_sql.TEAM_POSSESSIONS)
def team_possessions(t, spark, d):
    """Teams' possessions and points by the best method of each game; repaired games aren't exact."""
    g = game(t, spark, d)
    rows = stored(g.possessions())
    parts = [
        attribution.team_possessions(rows.join(g.repaired, "gameId", "left_anti")), attribution.team_possessions(rows.join(g.repaired, "gameId", "left_semi"), "ot_fallback"),
        attribution.team_possessions_from_events(g.events, g.box), attribution.team_possessions_from_boxscore(team_box(g.events)),
    ]
    return attribution.waterfall(parts, g.box, ["gameId", "teamId"])


@query(game_sql.TEAM_DEFENSIVE_SHOTS)
def team_defensive_shots(t, spark, d):
    """Opponents' two-point attempts by the best method of each game.

    Shots and their offence are all it needs, so without the layers it stores these and builds no lineups.
    """
    g = known(spark, d)
    if g is None:
        shots = ["gameId", "teamId", "homeTeamId", "awayTeamId", "resolvedOffenseTeamId", "resolvedDefenseTeamId", "isMadeShot", "isMissedShot", "isFieldGoal", "shotValue"]
        events, people = stored(sequence.with_offense(raw_events(t)).select(*shots)), box(t)
    else:
        events, people = g.events, g.box
    return attribution.waterfall(attribution.team_defensive_shots(events, people, team_box(events, "fga", "fg3a")), people, ["gameId", "teamId"])


@query(game_sql.ON_COURT_CONTEXTS)
def on_court_contexts(t, spark, d):
    """Defensive-shot, assist and rebound contexts of players, each by the best method of each game.

    Exact by stints as read; event-estimated by the fives of the event context, which knows repaired overtimes.
    """
    g = game(t, spark, d)
    c = attribution.contexts()
    at = context.event_context(g.events, g.effective)
    at = stored(at.select(F.col("game_id").alias("gameId"), F.col("event_num").alias("actionNumber"), "home_team_id", "away_team_id", F.col("home_current_player_ids").alias("home_personIds"), F.col("away_current_player_ids").alias("away_personIds")).withColumnsRenamed({"home_team_id": "home_teamId", "away_team_id": "away_teamId"}))
    estimates = attribution.contexts_from_boxscore(stored(player_box(g)), team_box(g.events))
    keys = ["gameId", "personId"]
    exact = lambda k: attribution.per_player(g.events, g.stints, g.box, c[k], "exact")
    seen = lambda k: attribution.per_player(g.events, g.stints, g.box, c[k], "event_estimated", context=at)
    best = lambda k: attribution.waterfall([exact(k), seen(k), estimates[k]], g.box, keys)
    parts = [stored(best(k).withColumnRenamed("method", f"{k}_method")) for k in ("defensive_shot", "assist", "rebound")]
    return parts[0].join(parts[1], keys, "full_outer").join(parts[2], keys, "full_outer")


@query(game_sql.SEASON_PERCENTILES)
def season_percentiles(t, spark, d):
    """Percentiles of players' possessions over all games."""
    rows = stored(QUERIES["player_possessions"](spark, d))
    season = rows.groupBy("personId").agg(F.round(F.sum("total_possessions"), 6).alias("possessions"), F.round(F.sum("points_for"), 6).alias("points"), F.count(F.lit(1)).alias("games")).withColumn("season", F.lit("all"))
    return percentiles(season, ["season"], [("possessions", "possessions_percentile", False, None), ("points", "points_percentile", False, F.col("games") > 1)], ["personId"])
