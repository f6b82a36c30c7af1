"""Lineups (stints), possessions and their repairs.

Stints follow an order-dependent rule per game: a fold over the game's substitution moments, with both fives as its state.
All else is windows and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions.dates import clock_seconds
from scorebook.functions.text import lineup_id
from scorebook.operators.relational import overlapping
from scorebook.operators.sequence import Cols

FIVE = 5
# The clocks that open a period, and the names of lineup issues.
OPENING_CLOCKS, OVERTIME_CLOCK = ("PT12M00.00S", "PT05M00.00S", "12:00", "5:00"), "PT05M00.00S"
NO_STARTERS, NO_CARRY, BAD_OPENING = "missing_boxscore_starters_period_1", "carry_forward_unavailable_period_start", "invalid_opening_substitution_cluster"
NOT_FIVE, NOT_ON_COURT = "substitution_produces_duplicate_or_non_five_lineup", "substitution_removes_player_not_on_court"

STINTS = "gameId string, period long, stint_id long, start_orderNumber long, end_orderNumber long, start_actionNumber long, end_actionNumber long, start_clock string, end_clock string, home_teamId long, away_teamId long, home_personIds array<long>, away_personIds array<long>, lineup_valid_flag long, lineup_issue string"


def starters(box: DataFrame) -> DataFrame:
    """(gameId, teamId, starters): the five unique starters of a team; teams with any other number are left out."""
    people = box.where("starter = 1 and personId is not null").groupBy("gameId", "teamId").agg(F.collect_set("personId").alias("s"), F.count(F.lit(1)).alias("n"))
    return people.where((F.size("s") == FIVE) & (F.col("n") == FIVE)).select("gameId", "teamId", F.array_sort("s").alias("starters"))


def game_sides(box: DataFrame) -> DataFrame:
    """(gameId, homeTeamId, awayTeamId); a side with conflicting teams is null."""
    side = lambda s: F.when(F.count_distinct(F.when(F.col("team_side") == s, F.col("teamId"))) == 1, F.max(F.when(F.col("team_side") == s, F.col("teamId"))))
    return box.where("teamId is not null").groupBy("gameId").agg(side("home").alias("homeTeamId"), side("away").alias("awayTeamId"))


def let(value: Column, body) -> Column:
    """`body` of a value that it uses more than once, so that the value is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fives(home: Column, away: Column, issue: Column) -> Column:
    return F.struct(home.alias("home"), away.alias("away"), issue.cast("string").alias("issue"))


def walked(home: Column, away: Column, subs: Column, home_team: Column, away_team: Column) -> Column:
    """Who is on court after some substitutions in order, and the first rule that they break: struct(home, away, issue).

    subs: array of (team, person, way). Nobody comes in who is on court or leaves who isn't.
    """
    state = _fives

    def step(s: Column, e: Column) -> Column:
        known = e["team"].eqNullSafe(home_team) | e["team"].eqNullSafe(away_team)
        at_home = e["team"].eqNullSafe(home_team)
        there = F.array_contains(F.when(at_home, s["home"]).otherwise(s["away"]), e["person"])
        comes = e["way"] == "in"
        issue = F.when(~known | e["person"].isNull() | ~F.coalesce(e["way"].isin("in", "out"), F.lit(False)) | (comes & there), NOT_FIVE).when(~comes & ~there, NOT_ON_COURT)
        moved = lambda five: F.when(comes, F.array_append(five, e["person"])).otherwise(F.array_remove(five, e["person"]))
        next_ = state(F.when(at_home, moved(s["home"])).otherwise(s["home"]), F.when(at_home, s["away"]).otherwise(moved(s["away"])), F.lit(None))
        return F.when(s["issue"].isNotNull(), s).when(issue.isNotNull(), state(s["home"], s["away"], issue)).otherwise(next_)

    return F.aggregate(subs, state(home, away, F.lit(None)), step)


def after(home: Column, away: Column, subs: Column, home_team: Column, away_team: Column) -> Column:
    """As `walked`; in the end each side must have five."""
    full = lambda s: (F.size(s["home"]) == FIVE) & (F.size(s["away"]) == FIVE)
    return let(walked(home, away, subs, home_team, away_team), lambda s: _fives(s["home"], s["away"], F.when(s["issue"].isNotNull(), s["issue"]).when(~full(s), NOT_FIVE)))


def moments(events: DataFrame) -> DataFrame:
    """(gameId, period, first, last, opens, clusters): each period's first and last mark and its substitution clusters.

    A cluster is what follows a substitution up to the last neighbour with its clock. A mark is (order, action, clock).
    `opens`: the first cluster is the period's first event and has an opening clock.
    """
    columns = ["orderNumber", "actionNumber", "clock", "teamId", "personId", "subType", "isSubstitution"]
    e = events.where("period is not null").select("gameId", "period", *columns)
    w = Window.partitionBy("gameId", "period").orderBy(*columns)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.struct(F.col("orderNumber").alias("o"), F.col("actionNumber").alias("a"), F.col("clock").alias("c"))
    e = e.withColumns({"_n": F.row_number().over(w), "_new": (~F.col("clock").eqNullSafe(F.lag("clock").over(w)) | (F.row_number().over(w) == 1)).cast("int"), "mark": mark})
    e = e.withColumn("_run", F.sum("_new").over(upto))
    way = F.lower(F.trim(F.coalesce("subType", F.lit(""))))
    sub = F.when(F.col("isSubstitution"), F.struct(F.col("_n").alias("n"), F.struct(F.col("teamId").alias("team"), F.col("personId").alias("person"), way.alias("way")).alias("e")))
    runs = e.groupBy("gameId", "period", "_run").agg(
        F.min(F.struct("_n", "mark")).alias("f"), F.max(F.struct("_n", "mark")).alias("l"), F.max("orderNumber").alias("top"),
        F.min(F.when(F.col("isSubstitution"), F.struct("_n", "mark"))).alias("head"), F.sort_array(F.collect_list(sub)).alias("subs"),
    )
    cluster = F.when(F.col("head").isNotNull(), F.struct(F.col("head._n").alias("n"), F.col("head.mark").alias("head"), F.transform("subs", lambda x: x["e"]).alias("subs")))
    out = runs.groupBy("gameId", "period").agg(F.min("f").alias("f"), F.max("l").alias("l"), F.max("top").alias("top"), F.sort_array(F.collect_list(cluster)).alias("clusters"))
    first_cluster = F.get("clusters", F.lit(0))
    return out.select(
        "gameId", "period", F.col("f.mark").alias("first"), F.struct((F.col("top") + 1).alias("o"), F.col("l.mark.a").alias("a"), F.col("l.mark.c").alias("c")).alias("last"),
        F.coalesce((F.col("period") > 1) & (first_cluster["n"] == 1) & F.col("f.mark.c").isin(*OPENING_CLOCKS), F.lit(False)).alias("opens"), "clusters",
    )


def stints(events: DataFrame, box: DataFrame) -> DataFrame:
    """On-court stints of every game from substitution events and the box score's starters.

    One fold over a game's periods, and within each over its substitution clusters, with both fives as the state.
    """
    s = starters(box)
    home = s.select("gameId", F.col("teamId").alias("homeTeamId"), F.col("starters").alias("homeStarters"))
    away = s.select("gameId", F.col("teamId").alias("awayTeamId"), F.col("starters").alias("awayStarters"))
    start = game_sides(box).where("homeTeamId <> awayTeamId").join(home, ["gameId", "homeTeamId"], "left").join(away, ["gameId", "awayTeamId"], "left")
    periods = moments(events).groupBy("gameId").agg(F.sort_array(F.collect_list(F.struct("period", "first", "last", "opens", "clusters"))).alias("periods"))
    teams = (F.col("homeTeamId"), F.col("awayTeamId"))
    mark = "struct<o:bigint,a:bigint,c:string>"
    row = f"struct<period:bigint,s:{mark},e:{mark},home:array<bigint>,away:array<bigint>,issue:string>"
    people = "array<bigint>"
    none = F.lit(None)

    def stint(p: Column, s: Column, e: Column, home: Column, away: Column, issue: Column) -> Column:
        return F.struct(p["period"].alias("period"), s.alias("s"), e.alias("e"), home.alias("home"), away.alias("away"), issue.alias("issue")).cast(row)

    def state(home: Column, away: Column, opened: Column, out: Column) -> Column:
        """Fives (null: unknown), where the open stint began (null: the period is over for lineups), stints so far."""
        return F.struct(home.cast(people).alias("home"), away.cast(people).alias("away"), opened.cast(mark).alias("opened"), out.cast(f"array<{row}>").alias("out"))

    def add(s: Column, *rows: Column) -> Column:
        return F.concat(s["out"], F.array(*rows))

    def at_cluster(p: Column):
        def step(s: Column, c: Column) -> Column:
            def moved(n: Column) -> Column:
                grown = F.when(s["opened"] != c["head"], add(s, stint(p, s["opened"], c["head"], s["home"], s["away"], none))).otherwise(s["out"])
                broken = F.concat(grown, F.array(stint(p, c["head"], p["last"], none, none, n["issue"])))
                return F.when(n["issue"].isNotNull(), state(none, none, none, broken)).otherwise(state(n["home"], n["away"], c["head"], grown))

            return F.when(s["opened"].isNull(), s).otherwise(let(after(s["home"], s["away"], c["subs"], *teams), moved))

        return step

    def at_period(s: Column, p: Column) -> Column:
        one = p["period"] == 1
        begun = F.struct(F.when(one, F.col("homeStarters")).otherwise(s["home"]).cast(people).alias("home"), F.when(one, F.col("awayStarters")).otherwise(s["away"]).cast(people).alias("away"))

        def opened(f: Column) -> Column:
            lost = lambda issue: state(none, none, none, add(s, stint(p, p["first"], p["last"], none, none, issue)))
            apply = lambda n: F.when(n["issue"].isNotNull(), lost(F.lit(BAD_OPENING))).otherwise(state(n["home"], n["away"], p["first"], s["out"]))
            opening = F.when(p["opens"], F.get(p["clusters"], F.lit(0))["subs"]).otherwise(F.filter(F.get(p["clusters"], F.lit(0))["subs"], lambda x: F.lit(False)))
            known = let(after(f["home"], f["away"], F.coalesce(opening, F.array().cast("array<struct<team:bigint,person:bigint,way:string>>")), *teams), apply)
            return F.when(f["home"].isNull() | f["away"].isNull(), lost(F.when(one, NO_STARTERS).otherwise(NO_CARRY))).otherwise(known)

        rest = F.when(p["opens"], F.slice(p["clusters"], F.lit(2), F.size(p["clusters"]))).otherwise(p["clusters"])
        close = lambda x: F.when(x["opened"].isNull(), state(none, none, none, x["out"])).otherwise(state(x["home"], x["away"], none, add(x, stint(p, x["opened"], p["last"], x["home"], x["away"], none))))
        return F.aggregate(rest, let(begun, opened), at_cluster(p), close)

    folded = F.aggregate("periods", state(none, none, none, F.array()), at_period, lambda s: s["out"])
    rows = periods.join(start, "gameId").select("gameId", *teams, F.posexplode(folded).alias("n", "x"))
    return rows.select(
        "gameId", F.col("x.period").alias("period"), (F.col("n") + 1).cast("long").alias("stint_id"), F.col("x.s.o").alias("start_orderNumber"), F.col("x.e.o").alias("end_orderNumber"), F.col("x.s.a").alias("start_actionNumber"), F.col("x.e.a").alias("end_actionNumber"),
        F.col("x.s.c").alias("start_clock"), F.col("x.e.c").alias("end_clock"), F.col("homeTeamId").alias("home_teamId"), F.col("awayTeamId").alias("away_teamId"), F.array_sort("x.home").alias("home_personIds"), F.array_sort("x.away").alias("away_personIds"),
        F.col("x.issue").isNull().cast("long").alias("lineup_valid_flag"), F.col("x.issue").alias("lineup_issue"),
    )


def starter_check(events: DataFrame, lineups: DataFrame, period_players: DataFrame) -> DataFrame:
    """Per period and team: the five of the first stint against those who played and didn't first come in as substitutes.

    Status: match, mismatch, invalid_lineup, incomplete_reference (not five) or missing_lineup.
    """
    way = F.lower(F.trim("subType"))
    first_sub = events.where("isSubstitution").groupBy("gameId", "period", "teamId", "personId").agg(F.min_by(way, "orderNumber").alias("way"))
    reference = period_players.join(first_sub, ["gameId", "period", "teamId", "personId"], "left").where("way is null or way <> 'in'")
    reference = reference.groupBy("gameId", "period", "teamId").agg(F.array_sort(F.collect_set("personId")).alias("reference"))
    first = lineups.groupBy("gameId", "period").agg(F.min_by(F.struct("home_teamId", "away_teamId", "home_personIds", "away_personIds", "lineup_valid_flag"), "stint_id").alias("s"))
    side = lambda x: first.select("gameId", "period", F.col(f"s.{x}_teamId").alias("teamId"), F.col(f"s.{x}_personIds").alias("lineup"), F.col("s.lineup_valid_flag").alias("valid"))
    both = reference.join(side("home").unionByName(side("away")), ["gameId", "period", "teamId"], "left")
    status = (
        F.when(F.col("valid").isNull(), "missing_lineup").when((F.col("valid") == 0) | F.col("lineup").isNull(), "invalid_lineup")
        .when(F.size("reference") != FIVE, "incomplete_reference").when(F.array_sort("lineup") == F.col("reference"), "match").otherwise("mismatch")
    )
    return both.withColumns({"status": status, "missing": F.array_except("reference", "lineup"), "extra": F.array_except("lineup", "reference")})


def end_type() -> Column:
    """How a possession ends, by its last event."""
    e = lambda x: F.col(f"e.{x}")
    return (
        F.when(e("isPeriodEnd"), "period_end").when(e("isMadeShot"), "made_shot").when(e("isTurnover"), "turnover")
        .when(e("isRebound"), F.when(e("isDreb"), "def_rebound").otherwise("rebound")).when(e("isFreeThrow"), "free_throw")
        .when(e("isJumpBall"), "jump_ball_change").otherwise(F.coalesce(e("possessionBoundaryReason"), F.lit("offense_change")))
    )


def start_type(timeout: Column, l: str = "l") -> Column:
    """How a possession starts, by the previous one's last event that is no substitution (struct `l`)."""
    e = lambda x: F.col(f"{l}.{x}")
    three = F.when(F.coalesce(e("shotValue"), e("linkedShotValue")) == 3, "off_3pt").otherwise("off_2pt")
    made_ft = e("isFreeThrow") & (F.lower(F.trim(e("shotResult"))) == "made")
    return (
        F.when(F.col(l).isNull(), "off_deadball").when(timeout, "off_timeout").when(made_ft, "off_ft_make")
        .when(e("isMadeShot"), F.when(e("shotValue") == 3, "off_3pt_make").otherwise("off_2pt_make"))
        .when(e("isTurnover"), F.when(e("stealPersonId").isNotNull(), "off_live_ball_turnover").otherwise("off_deadball"))
        .when(e("isRebound") & (F.coalesce(e("personId"), F.lit(0)) == 0), "off_deadball")
        .when(e("isRebound") & F.coalesce(e("linkedFreeThrow"), F.lit(False)), "off_ft_miss")
        .when(e("isRebound"), F.concat(three, F.when(e("linkedBlock").isNotNull(), "_block").otherwise("_miss")))
        .otherwise("off_deadball")
    )


def possessions(df: DataFrame, c: Cols = Cols()) -> DataFrame:
    """One row per possession of enriched events: numbers, clocks, scores, types, counts and neighbours.

    Events after the last possession end form an open possession that doesn't count. Start clock and score are the end
    values of the previous possession, unless the possession holds a period start.
    """
    g = Window.partitionBy(c.game).orderBy(c.period, c.order)
    ended = F.coalesce(F.sum(F.col("isPossessionEndingEvent").cast("int")).over(g.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("possessionNumber", ended + 1)
    p = Window.partitionBy(c.game, "possessionNumber").orderBy(c.period, c.order)
    nxt = lambda x: F.lead(x).over(p)
    df = df.withColumns({"_end_clock": F.last("clock").over(p.rowsBetween(Window.currentRow, Window.unboundedFollowing)), "_next_ft": F.coalesce(nxt("isFreeThrow"), F.lit(False)) & (nxt("clock") == F.col("clock")), "_next_tech": F.coalesce(nxt("isTechnicalFt"), F.lit(False))})
    # a timeout counts unless a (non-technical) free throw of the same moment follows; at the end's clock only before a turnover of that moment
    turnover_after = F.max((F.col("isTurnover")).cast("int")).over(Window.partitionBy(c.game, "possessionNumber", "clock").orderBy(c.period, c.order).rowsBetween(1, Window.unboundedFollowing)) == 1
    inside = F.col("clock") != F.col("_end_clock")
    own_timeout = F.col("isTimeout") & (inside & ~(F.coalesce(F.col("_next_ft"), F.lit(False)) & ~F.col("_next_tech")) | F.coalesce(turnover_after, F.lit(False)))
    df = df.withColumns({"_own_timeout": own_timeout, "_end_timeout": F.col("isTimeout") & ~F.coalesce(F.col("_next_ft"), F.lit(False))})
    at, keep = F.struct(c.period, c.order), [x for x in df.columns if not x.startswith("_") and x != "possessionNumber"]
    linked = {"linkedShotValue": "long", "linkedBlock": "long", "linkedFreeThrow": "boolean"}
    have = lambda x: F.col(x) if x in df.columns else F.lit(None).cast(linked.get(x, "string"))
    whole = F.struct(*[F.col(x) for x in keep], *[have(x).alias(x) for x in linked if x not in keep])
    n = lambda x: F.sum(x.cast("int"))
    one = df.groupBy(c.game, "possessionNumber").agg(
        F.min_by(whole, at).alias("f"), F.max_by(whole, at).alias("e"), F.max_by(whole, F.when(~F.col("isSubstitution"), at)).alias("l"),
        F.bool_or("isPeriodStart").alias("_starts"), F.bool_or("isPossessionEndingEvent").alias("_closed"), F.bool_or("_own_timeout").alias("possessionHasTimeout"),
        F.collect_set(F.when(F.col("_end_timeout"), F.col("clock"))).alias("_timeouts"),
        F.min_by("resolvedOffenseTeamId", F.when(F.col("resolvedOffenseTeamId").isNotNull(), at)).alias("offenseTeamId"),
        F.min_by("resolvedDefenseTeamId", F.when(F.col("resolvedDefenseTeamId").isNotNull(), at)).alias("defenseTeamId"),
        F.min_by("offenseHomeAway", F.when(F.col("offenseHomeAway").isNotNull(), at)).alias("offenseHomeAway"),
        F.bool_or("isSecondChanceEvent").alias("isSecondChancePossession"), F.bool_or("isPenaltyEvent").alias("isPenaltyPossession"),
        n(F.col("isMadeShot") | F.col("isMissedShot")).alias("fieldGoalAttempts"), n(F.col("isMadeShot")).alias("madeFieldGoals"), n(F.col("isFreeThrow")).alias("freeThrowAttempts"),
        n(F.col("isTurnover")).alias("turnovers"), n(F.col("isOreb") & F.col("isRealRebound")).alias("offensiveRebounds"),
    )
    w = Window.partitionBy(c.game).orderBy("possessionNumber")
    before = lambda x: F.when(~F.col("_starts"), F.lag(x).over(w))
    one = one.withColumn("prev", before(F.struct("e", "l", "possessionNumber", "_timeouts")))
    start = lambda x: F.when(F.col("prev").isNotNull(), F.col(f"prev.e.{x}")).otherwise(F.col(f"f.{x}"))
    home, away = "scoreHome", "scoreAway"
    points = lambda get: F.when(F.col("offenseHomeAway") == "h", get(home)).when(F.col("offenseHomeAway") == "v", get(away))
    margin = lambda get: F.when(F.col("offenseHomeAway") == "h", get(home) - get(away)).when(F.col("offenseHomeAway") == "v", get(away) - get(home))
    end = lambda x: F.col(f"e.{x}")
    earlier = F.coalesce(F.array_contains("prev._timeouts", start("clock")), F.lit(False))
    timeout = F.col("possessionHasTimeout") | earlier
    elapsed = F.greatest(clock_seconds(start("clock")) - clock_seconds(end("clock")), F.lit(0.0))
    closed = lambda x: F.when(F.col("_closed"), x)
    in_period = F.row_number().over(Window.partitionBy(c.game, F.col(f"e.{c.period}")).orderBy("possessionNumber"))
    return one.select(
        c.game, "possessionNumber", in_period.alias("possessionNumberInPeriod"), F.col(f"e.{c.period}").alias("period"),
        F.col(f"f.{c.order}").alias("startOrderNumber"), end(c.order).alias("endOrderNumber"), F.col(f"f.{c.action}").alias("startActionNumber"), end(c.action).alias("endActionNumber"),
        start("clock").alias("startClock"), end("clock").alias("endClock"), closed(elapsed).alias("secondsElapsed"), "offenseTeamId", "defenseTeamId", "offenseHomeAway",
        margin(start).alias("startScoreMargin"), margin(end).alias("endScoreMargin"), closed(points(end) - points(start)).alias("pointsScoredOnPossession"),
        F.when(F.col("_closed"), start_type(timeout, "prev.l")).otherwise("off_deadball").alias("possessionStartType"), end_type().alias("possessionEndType"),
        end("possessionBoundaryReason").alias("possessionBoundaryReason"), "possessionHasTimeout", earlier.alias("previousPossessionHasTimeout"),
        "isSecondChancePossession", "isPenaltyPossession", (F.col("_closed") & end("countAsPossession")).alias("countsAsPossession"),
        F.col("prev.possessionNumber").alias("previousPossessionNumber"), F.lead("possessionNumber").over(w).alias("nextPossessionNumber"),
        "fieldGoalAttempts", "madeFieldGoals", "freeThrowAttempts", "turnovers", "offensiveRebounds",
    )


def stamped(rows: DataFrame, lineups: DataFrame, c: Cols = Cols()) -> DataFrame:
    """Possessions with one lineup id per side, a validity flag and the issues found.

    Stints meet a possession in the same period's order range. Several stints that all start at the possession's start
    clock count as the last of them.
    """
    s = lineups.select(
        c.game, "period", F.col("start_orderNumber").alias("_s"), F.col("end_orderNumber").alias("_e"), F.col("stint_id").alias("_i"), F.col("start_clock").alias("_c"),
        lineup_id(F.col("home_personIds")).alias("_home"), lineup_id(F.col("away_personIds")).alias("_away"), F.col("lineup_valid_flag").alias("_v"), F.col("lineup_issue").alias("_q"),
    )
    met = overlapping(rows.select(c.game, "possessionNumber", "period", "startOrderNumber", "endOrderNumber", "startClock"), s, [c.game, "period"], "startOrderNumber", "endOrderNumber", "_s", "_e", "inner", small_groups=True)
    last = F.struct(F.coalesce("_s", F.lit(0)), F.coalesce("_e", F.lit(0)), F.coalesce("_i", F.lit(0)))
    at_start = F.coalesce(F.col("_c") == F.col("startClock"), F.lit(False))
    found = met.groupBy(c.game, "possessionNumber").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and(at_start).alias("_same"), F.collect_set("_home").alias("_homes"), F.collect_set("_away").alias("_aways"),
        F.max_by(F.struct("_home", "_away"), last).alias("_last"), F.bool_or(F.col("_v") == 0).alias("_bad"), F.array_sort(F.collect_set(F.when(F.col("_v") == 0, F.col("_q")))).alias("_qs"),
    )
    out = rows.join(found, [c.game, "possessionNumber"], "left")
    one = (F.col("_n") > 1) & F.col("_same")
    side = lambda x: F.when(one, F.col(f"_last._{x}")).when(F.size(f"_{x}s") == 1, F.col(f"_{x}s")[0])
    many = lambda x: F.when((F.size(f"_{x}s") > 1) & ~one, F.concat(F.lit(f"multiple_{x}_lineups(count="), F.size(f"_{x}s").cast("string"), F.lit(")")))
    issues = F.concat(F.array_compact(F.array(F.when(F.col("_n").isNull(), "missing_on_court_coverage"), many("home"), many("away"), F.when(F.col("_bad"), "overlapping_invalid_stint"))), F.coalesce("_qs", F.array().cast("array<string>")))
    issues = F.array_distinct(issues)
    return out.select(*rows.columns, side("home").alias("homeLineupId"), side("away").alias("awayLineupId"), (F.size(issues) == 0).cast("int").alias("lineupValidFlag"), F.when(F.size(issues) > 0, F.array_join(issues, " | ")).alias("lineupIssue"))


def whole(home: str = "home_personIds", away: str = "away_personIds") -> Column:
    """Both sides have five."""
    return F.coalesce((F.size(home) == FIVE) & (F.size(away) == FIVE), F.lit(False))


def effective(lineups: DataFrame, events: DataFrame) -> DataFrame:
    """Stints after the repair of the first overtime without a valid start, with method, failed_period, opening_applied.

    The first that works counts: clear the flags of stints that are whole but for a substitute leaving who isn't on
    court; take the fives that the period before ended with, as far as they are known, through the opening substitutions,
    and fill one open place from its last valid five; take that five itself through the opening substitutions. Games with
    nothing to repair are exact if all their stints are valid, else unrepaired. Only games to repair are looked at again.
    """
    names = [f.split()[0] for f in STINTS.split(", ")]
    place = F.struct(F.col("start_orderNumber").isNull(), "start_orderNumber", F.col("stint_id").isNull(), "stint_id")  # nulls last
    first = lineups.groupBy("gameId", "period").agg(F.min_by("lineup_valid_flag", F.struct("start_orderNumber", "stint_id")).alias("flag"))
    failed = first.groupBy("gameId").agg(F.min(F.when((F.col("period") > 4) & (F.col("flag") == 0), F.col("period"))).alias("failed_period"))
    ok = F.bool_and(F.col("lineup_valid_flag") == 1).over(Window.partitionBy("gameId"))
    rows = lineups.join(failed, "gameId")
    plain = rows.where("failed_period is null").withColumns({"method": F.when(ok, "exact").otherwise("unrepaired"), "opening_applied": F.lit(False)})
    bad = rows.where("failed_period is not null")
    own, before = F.col("period") == F.col("failed_period"), F.col("period") == F.col("failed_period") - 1
    end = F.struct(F.coalesce("end_orderNumber", F.lit(-1)), F.coalesce("stint_id", F.lit(-1)))
    fives = F.struct(F.col("home_personIds").alias("home"), F.col("away_personIds").alias("away"), F.col("home_teamId").alias("home_team"), F.col("away_teamId").alias("away_team"))
    stale = whole() & (F.coalesce("lineup_issue", F.lit("")).isin("", NOT_ON_COURT))
    games = bad.groupBy("gameId", "failed_period").agg(
        F.bool_and(F.when(own, stale)).alias("stale"), F.min_by(F.struct(*names), F.when(own, place)).alias("own"),
        F.max_by(fives, F.when(before & (F.col("lineup_valid_flag") == 1) & whole(), end)).alias("seed"), F.max_by(fives, F.when(before, end)).alias("last"),
    )
    # the overtime's first and last mark, its substitutions at the opening clock, and those that its first ones make up
    mine = events.join(bad.select("gameId", "failed_period").distinct(), "gameId").where("period = failed_period")
    order = ["orderNumber", "actionNumber", "clock", "teamId", "personId", "subType", "isSubstitution"]
    w = Window.partitionBy("gameId").orderBy(*order)
    sub = F.struct(F.col("teamId").alias("team"), F.col("personId").alias("person"), F.lower(F.trim(F.coalesce("subType", F.lit("")))).alias("way"))
    mine = mine.withColumns({"_n": F.row_number().over(w), "_sub": F.col("isSubstitution"), "_head": F.first(F.when(F.col("isSubstitution"), F.col("clock")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    breaks = F.col("_head").isNotNull() & ~(F.col("_sub") & F.col("clock").eqNullSafe(F.col("_head")))
    mine = mine.withColumn("_lead", F.col("_sub") & (F.sum(breaks.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0) & (F.col("_head") == OVERTIME_CLOCK))
    listed = lambda test: F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("_n", sub.alias("e"))))), lambda x: x["e"])
    mark = F.struct(F.col("orderNumber").alias("o"), F.col("actionNumber").alias("a"), F.col("clock").alias("c"))
    openings = mine.groupBy("gameId").agg(F.min_by(mark, "_n").alias("a"), F.max_by(mark, "_n").alias("z"), listed(F.col("_sub") & (F.col("clock") == OVERTIME_CLOCK)).alias("opening"), listed(F.col("_lead")).alias("lead"))
    games = games.join(openings, "gameId", "left")
    nobody = F.array().cast("array<bigint>")
    side = lambda x, s: F.coalesce(F.col(f"{x}.{s}"), nobody)
    short = lambda x: F.array(*[F.size(side(x, s)) < FIVE for s in ("home", "away")])
    own_short = F.array(*[F.coalesce(F.size(f"own.{s}_personIds"), F.lit(0)) < FIVE for s in ("home", "away")])

    def drifted(s: str) -> Column:
        """A side's five by what it drifted to: null if a substitution contradicts it or more than one place is open."""
        team = F.col(f"seed.{s}_team")
        at = walked(side("last", s), nobody, F.filter("opening", lambda e: e["team"] == team), team, F.lit(None).cast("long"))
        fill = lambda now: F.concat(now, F.slice(F.array_except(F.col(f"seed.{s}"), now), F.lit(1), F.greatest(F.lit(FIVE) - F.size(now), F.lit(0))))
        return let(at, lambda n: F.when(n["issue"].isNull() & F.size(n["home"]).between(FIVE - 1, FIVE), F.array_sort(F.array_distinct(fill(n["home"])))))

    five = lambda c: F.size(c) == FIVE
    may_drift = F.col("seed").isNotNull() & F.array_contains(short("last"), True) & (short("last") == own_short) & (F.size("opening") > 0)
    games = games.withColumns({"_dh": F.when(may_drift, drifted("home")), "_da": F.when(may_drift, drifted("away"))})
    carried = after(F.col("seed.home"), F.col("seed.away"), F.coalesce("lead", F.array().cast("array<struct<team:bigint,person:bigint,way:string>>")), F.col("seed.home_team"), F.col("seed.away_team"))
    games = games.withColumn("_c", F.when(F.col("seed").isNotNull(), carried))
    drift_ok = F.coalesce(five("_dh") & five("_da"), F.lit(False))
    method = F.when(F.coalesce("stale", F.lit(False)), "stale_sub_out").when(F.col("a").isNull() | F.col("last").isNull(), "unrepaired").when(drift_ok, "end_q4_reconciled").when(F.col("_c").isNotNull() & F.col("_c.issue").isNull(), "ot_carry_forward").otherwise("unrepaired")
    games = games.withColumn("method", method).withColumn("opening_applied", F.when(F.col("method") == "end_q4_reconciled", F.lit(True)).otherwise((F.col("method") == "ot_carry_forward") & (F.size("lead") > 0)))
    rebuilt = F.col("method").isin("end_q4_reconciled", "ot_carry_forward")
    drift = F.col("method") == "end_q4_reconciled"
    new = {
        "start_orderNumber": F.col("a.o"), "end_orderNumber": F.coalesce("z.o", F.lit(0)) + 1, "start_actionNumber": F.col("a.a"), "end_actionNumber": F.col("z.a"), "start_clock": F.col("a.c"), "end_clock": F.col("z.c"),
        "home_personIds": F.when(drift, F.col("_dh")).otherwise(F.array_sort("_c.home")), "away_personIds": F.when(drift, F.col("_da")).otherwise(F.array_sort("_c.away")), "lineup_valid_flag": F.lit(1).cast("long"), "lineup_issue": F.lit(None).cast("string"),
    }
    made = games.where(rebuilt).select(*[new.get(c, F.col(f"own.{c}") if c != "gameId" else F.col(c)).alias(c) for c in names], "failed_period", "method", "opening_applied")
    kept = bad.join(games.select("gameId", "method", "opening_applied"), "gameId").where(~(rebuilt & (F.col("period") == F.col("failed_period"))))
    cleared = (F.col("method") == "stale_sub_out") & (F.col("period") == F.col("failed_period"))
    kept = kept.withColumns({"lineup_valid_flag": F.when(cleared, 1).otherwise(F.col("lineup_valid_flag")).cast("long"), "lineup_issue": F.when(~cleared, F.col("lineup_issue"))})
    columns = [*names, "failed_period", "method", "opening_applied"]
    return plain.select(columns).unionByName(kept.select(columns)).unionByName(made.select(columns))
