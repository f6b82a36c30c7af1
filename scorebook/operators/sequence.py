"""Event sequences: flags, neighbours, offence, possession ends, fouls to give, rebounds.

An event table has one row per (game, period, order). Windows are partitioned by game and period, whose groups are a few
hundred events. Column names are fields of `Cols`, so any event table can be used.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions.dates import clock_seconds
from scorebook.functions.sport import is_three, shot_range, shot_value, shot_zone
from scorebook.functions.text import alphanumeric, free_throw_trip, has_qualifier, null_if_empty
from scorebook.operators.relational import linked_row

# Fouls that count towards the penalty.
COUNTED_FOULS = ("shooting", "looseball", "inbound", "awayfromplay", "clearpath", "flagranttype1", "flagranttype2", "block", "take", "transition")
LAST_SECONDS = 2


@dataclass(frozen=True)
class Cols:
    game: str = "gameId"
    period: str = "period"
    order: str = "orderNumber"
    action: str = "actionNumber"
    type: str = "actionType"
    sub_type: str = "subType"
    descriptor: str = "descriptor"
    qualifiers: str = "qualifiers"
    clock: str = "clock"
    result: str = "shotResult"
    field_goal: str = "isFieldGoal"
    team: str = "teamId"
    person: str = "personId"
    possession: str = "possession"
    steal: str = "stealPersonId"
    shot_action: str = "shotActionNumber"

    @property
    def by_period(self):
        return Window.partitionBy(self.game, self.period).orderBy(self.order)


def ever_before(flag: Column, w) -> Column:
    return F.max(flag.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)) == 1


def event_flags(df: DataFrame, c: Cols = Cols()) -> DataFrame:
    """Seconds left, shot results and event classes of each row."""
    t, result = alphanumeric(F.col(c.type)), F.lower(F.trim(F.col(c.result)))
    goal = F.coalesce(F.col(c.field_goal).cast("int"), F.lit(0)) != 0
    is_ = lambda x: F.coalesce(t == x, F.lit(False))
    return df.withColumns({
        "secondsRemainingInPeriod": clock_seconds(F.col(c.clock)),
        "isMadeShot": goal & F.coalesce(result == "made", F.lit(False)),
        "isMissedShot": goal & F.coalesce(result == "missed", F.lit(False)),
        "isFreeThrow": is_("freethrow"), "isRebound": is_("rebound"), "isTurnover": is_("turnover"), "isFoul": is_("foul"),
        "isSubstitution": is_("substitution"), "isTimeout": is_("timeout"), "isJumpBall": is_("jumpball"),
        "isPeriodStart": is_("period") & F.coalesce(alphanumeric(F.col(c.sub_type)) == "start", F.lit(False)),
        "isPeriodEnd": is_("game") | (is_("period") & F.coalesce(alphanumeric(F.col(c.sub_type)) == "end", F.lit(False))),
    })


def class_flags(df: DataFrame, c: Cols = Cols()) -> DataFrame:
    """Flags by sub-type and descriptor; steals decide about bad-pass and lost-ball turnovers."""
    sub, desc = alphanumeric(F.col(c.sub_type)), alphanumeric(F.col(c.descriptor))
    both = lambda flag, test: F.col(flag) & F.coalesce(test, F.lit(False))
    stolen = F.col(c.steal).isNotNull()
    counted = (sub == "personal") & null_if_empty(F.col(c.descriptor)).isNull() | desc.isin(*COUNTED_FOULS)
    trip = free_throw_trip(F.col(c.sub_type))
    return df.withColumns({
        "isOreb": both("isRebound", sub == "offensive"), "isDreb": both("isRebound", sub == "defensive"),
        "isShootingFoul": both("isFoul", desc == "shooting"), "countsTowardsPenalty": both("isFoul", counted),
        "isTechnicalFt": both("isFreeThrow", desc == "technical"), "isFlagrantFt": both("isFreeThrow", desc == "flagrant"),
        "isBadPassTurnover": both("isTurnover", stolen & (sub == "badpass")), "isLostBallTurnover": both("isTurnover", stolen & (sub == "lostball")),
        "isTravelTurnover": both("isTurnover", sub == "traveling"), "isShotClockTurnover": both("isTurnover", sub == "shotclock"),
        "freeThrowNumber": F.when(F.col("isFreeThrow"), trip["number"]), "freeThrowOf": F.when(F.col("isFreeThrow"), trip["of"]),
        "isEndFreeThrow": F.col("isFreeThrow") & F.coalesce(trip["number"] == trip["of"], F.lit(True)),
    })


def free_throw_trips(df: DataFrame, c: Cols = Cols()) -> DataFrame:
    """(game, period, tripNumber, team, person, clock, kind, throws, expected, made, first, last, interrupted, complete).

    A trip is the free throws of one kind (plain, flagrant, technical) that one player takes within one moment of the
    clock, whatever comes between them; a number that doesn't grow starts the next trip. Interrupted: another event came
    between two of its throws. Complete: as many throws as its last one says.
    """
    kind = F.when(F.col("isTechnicalFt"), "technical").when(F.col("isFlagrantFt"), "flagrant").otherwise("plain")
    throws = df.withColumn("_place", F.row_number().over(c.by_period)).where("isFreeThrow").withColumn("_kind", kind)
    moment = Window.partitionBy(c.game, c.period, c.team, c.person, c.clock, "_kind").orderBy(c.order)
    again = F.coalesce(F.col("freeThrowNumber") <= F.lag("freeThrowNumber").over(moment), F.lit(False))
    throws = throws.withColumn("_trip", F.sum(again.cast("int")).over(moment.rowsBetween(Window.unboundedPreceding, 0)))
    made = F.lower(F.trim(F.col(c.result))) == "made"
    one = throws.groupBy(c.game, c.period, c.team, c.person, c.clock, "_kind", "_trip").agg(
        F.count(F.lit(1)).alias("throws"), F.max("freeThrowOf").cast("int").alias("expected"), F.sum(F.coalesce(made, F.lit(False)).cast("int")).alias("made"), F.min(c.order).alias("first"), F.max(c.order).alias("last"),
        (F.max("_place") - F.min("_place") + 1 > F.count(F.lit(1))).alias("interrupted"),
    )
    number = F.row_number().over(Window.partitionBy(c.game, c.period).orderBy("first"))
    return one.select(c.game, c.period, number.alias("tripNumber"), c.team, c.person, c.clock, F.col("_kind").alias("kind"), "throws", "expected", "made", "first", "last", "interrupted", F.coalesce(F.col("throws") == F.col("expected"), F.lit(True)).alias("complete"))


def neighbours(df: DataFrame, c: Cols = Cols()) -> DataFrame:
    """Numbers of the previous and next event of the period, and seconds since the previous one (0 at least)."""
    w = c.by_period
    previous = lambda x: F.when(~F.col("isPeriodStart"), F.lag(x).over(w))
    now, before = F.col("secondsRemainingInPeriod"), F.lag("secondsRemainingInPeriod").over(w)
    return df.withColumns({
        "prevActionNumber": previous(c.action), "nextActionNumber": F.lead(c.action).over(w),
        "prevOrderNumber": previous(c.order), "nextOrderNumber": F.lead(c.order).over(w),
        "secondsSincePreviousEvent": F.when(now.isNotNull(), F.greatest(F.coalesce(before - now, F.lit(0.0)), F.lit(0.0))),
    })


def starting_team(df: DataFrame, c: Cols = Cols(), overrides: DataFrame | None = None) -> DataFrame:
    """Add periodStartTeamId: who starts the period with the ball, for period-start rows.

    An override (game, period, team) wins; in period 1 and overtime the team of a jump ball that follows at once; else
    the team of the first later shot, turnover or non-technical free throw.
    """
    w = c.by_period
    decides = F.col("isMadeShot") | F.col("isMissedShot") | F.col("isTurnover") | (F.col("isFreeThrow") & ~F.col("isTechnicalFt"))
    later = F.first(F.when(decides, F.struct(F.col(c.team).alias("t"))), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))["t"]
    jump = ((F.col(c.period) == 1) | (F.col(c.period) >= 5)) & F.coalesce(F.lead("isJumpBall").over(w), F.lit(False))
    team = F.when(jump, F.lead(c.team).over(w)).otherwise(later)
    df = df.withColumn("periodStartTeamId", F.when(F.col("isPeriodStart"), team))
    if overrides is None:
        return df
    o = overrides.select(F.col(c.game), F.col(c.period), F.col(c.team).alias("_override"))
    chosen = F.when(F.col("isPeriodStart"), F.coalesce("_override", "periodStartTeamId"))
    return df.join(o, [c.game, c.period], "left").withColumn("periodStartTeamId", chosen).drop("_override")


def offense(df: DataFrame, c: Cols = Cols(), home: str = "homeTeamId", away: str = "awayTeamId") -> DataFrame:
    """Offence and defence of each event: the source's possession, the period's starter, carried forward.

    A defensive rebound still belongs to the possession that ends with it, so it takes the previous event's offence.
    """
    w = c.by_period
    source = F.when(F.col(c.possession) > 0, F.col(c.possession))
    own = F.when(F.col("isPeriodStart"), F.col("periodStartTeamId")).otherwise(source)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # the offence without the rule for defensive rebounds; a run of them takes what stands before the run
    rebound = F.coalesce(F.col("isRebound") & F.col("isDreb"), F.lit(False)) & (F.row_number().over(w) > 1)
    df = df.withColumn("_own", own).withColumn("_rebound", rebound)
    before = F.last(F.when(~F.col("_rebound"), F.col("_own")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_kept", F.when(F.col("_rebound"), F.coalesce(before, F.col("_own"))).otherwise(F.col("_own")))
    off = F.last("_kept", ignorenulls=True).over(upto)
    df = df.withColumn("resolvedOffenseTeamId", off).drop("_own", "_rebound", "_kept")
    team = F.col("resolvedOffenseTeamId")
    return df.withColumns({
        "resolvedDefenseTeamId": F.when(team == F.col(home), F.col(away)).when(team == F.col(away), F.col(home)),
        "offenseHomeAway": F.when(team == F.col(home), "h").when(team == F.col(away), "v"),
    })


def score_margins(df: DataFrame, c: Cols = Cols(), home: str = "scoreHome", away: str = "scoreAway") -> DataFrame:
    """Scores carried forward, the margin before and after from the offence's view, and the event's points (0 at least)."""
    g = Window.partitionBy(c.game).orderBy(c.period, c.order)
    upto = g.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_h": F.coalesce(F.last(home, ignorenulls=True).over(upto), F.lit(0)), "_a": F.coalesce(F.last(away, ignorenulls=True).over(upto), F.lit(0))})
    was = lambda x: F.coalesce(F.lag(x).over(g), F.lit(0))
    sign = F.when(F.col("offenseHomeAway") == "h", 1).when(F.col("offenseHomeAway") == "v", -1)
    return df.withColumns({
        "scoreMarginBefore": sign * (was("_h") - was("_a")), "scoreMarginAfter": sign * (F.col("_h") - F.col("_a")),
        "pointsHome": F.greatest(F.col("_h") - was("_h"), F.lit(0)), "pointsAway": F.greatest(F.col("_a") - was("_a"), F.lit(0)),
    }).drop("_h", "_a")


def possession_ends(df: DataFrame, c: Cols = Cols()) -> DataFrame:
    """Which event ends a possession, whether it counts, and why it ends.

    The last event of a period ends one; so does a change of offence. An end with more than two seconds left counts. A
    later one counts if the end before it came with more than two seconds left, or if a shot or free throw fell since.
    """
    w = c.by_period
    nxt = F.lead("resolvedOffenseTeamId").over(w)
    last = F.lead(c.order).over(w).isNull()
    team = F.col("resolvedOffenseTeamId")
    start_near = F.col("isPeriodStart") | F.coalesce(F.lead("isPeriodStart").over(w), F.lit(False))
    changes = F.coalesce((team > 0) & (nxt > 0) & (team != nxt), F.lit(False))
    df = df.withColumns({"isPossessionEndingEvent": last | (~start_near & changes), "_changes": changes, "_last": last, "_place": F.row_number().over(w)})
    end = F.col("isPossessionEndingEvent")
    seconds = F.col("secondsRemainingInPeriod")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({
        "_before": F.last(F.when(end, F.struct(seconds.alias("s"))), ignorenulls=True).over(before)["s"],
        "_n": F.coalesce(F.sum(end.cast("int")).over(before), F.lit(0)),
        "_scored": F.max(F.when(F.col("isFreeThrow") | F.col("isMadeShot"), F.col("_place"))).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_ended": F.max(F.when(end, F.col("_place"))).over(before),
    })
    scored = F.coalesce(F.col("_scored") > F.coalesce("_ended", F.lit(0)), F.lit(False))
    late = F.col("_before").isNull() | (F.col("_before") > LAST_SECONDS) | scored
    reason = (
        F.when(~end, None).when(F.col("isMadeShot"), "made_shot").when(F.col("isTurnover"), "turnover")
        .when(F.col("isRebound") & F.col("_changes"), "def_rebound").when(F.col("isFreeThrow") & F.col("_changes"), "free_throw")
        .when(F.col("isJumpBall") & F.col("_changes"), "jump_ball_change").when(F.col("_last"), "period_end").otherwise("offense_change")
    )
    counts = end & F.coalesce((seconds > LAST_SECONDS), F.lit(False)) | (end & late)
    return df.withColumns({"countAsPossession": counts, "possessionBoundaryReason": reason, "_possession": F.col("_n")}).drop("_changes", "_last", "_before", "_n", "_scored", "_ended")


def rebounds(df: DataFrame, c: Cols = Cols()) -> DataFrame:
    """Rebound side by the linked shot, mismatch with the source, placeholder and real rebounds."""
    linked = ["isFreeThrow", "isFlagrantFt", "isEndFreeThrow", "secondsRemainingInPeriod", c.team]
    df = linked_row(df, [c.game], c.shot_action, c.action, linked, "_shot_")
    w = c.by_period
    sub, t = alphanumeric(F.col(c.sub_type)), alphanumeric(F.col(c.type))
    inferred = F.when(F.col("isRebound"), F.when(F.col(c.team) == F.col(f"_shot_{c.team}"), "offensive").when(F.col(c.team) != F.col(f"_shot_{c.team}"), "defensive"))
    dead = has_qualifier(F.col(c.qualifiers), "deadball") if c.qualifiers in df.columns else F.lit(False)
    placeholder = F.col("isRebound") & (dead | F.coalesce(F.col("_shot_isFlagrantFt"), F.lit(False)))
    stops = (t == "turnover") & (sub == "shotclock") | (t == "violation") & (sub == "kickedball")
    clock = F.struct("secondsRemainingInPeriod")
    stopped = F.array_contains(F.collect_set(F.when(stops, clock)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), clock)
    nobody = F.coalesce(F.col(c.person), F.lit(0)) == 0
    following = w.rowsBetween(1, Window.unboundedFollowing)
    next_end = F.first(F.when(F.coalesce(t != "instantreplay", F.lit(True)), F.struct(F.col("isPeriodEnd").alias("e"))), ignorenulls=True).over(following)["e"]
    seconds = F.col("secondsRemainingInPeriod")
    at_end = nobody & (seconds == 0) & F.coalesce(next_end, F.lit(True))
    at_shot = nobody & (seconds <= 3) & (seconds == F.col("_shot_secondsRemainingInPeriod")) & F.coalesce(next_end, F.lit(False))
    mid_trip = F.coalesce(F.col("_shot_isFreeThrow") & ~F.col("_shot_isEndFreeThrow"), F.lit(False))
    no = lambda x: ~F.coalesce(x, F.lit(False))
    real = F.col("isRebound") & no(placeholder) & no(mid_trip) & no(nobody & stopped) & no(at_end) & no(at_shot)
    mismatch = F.col("isRebound") & F.coalesce(sub.isin("offensive", "defensive") & (inferred != sub), F.lit(False))
    out = df.withColumns({"inferredReboundType": inferred, "reboundTypeSourceMismatchFlag": mismatch, "isPlaceholderRebound": placeholder, "isRealRebound": real})
    return out.drop(*[f"_shot_{x}" for x in linked])


def second_chances(df: DataFrame, c: Cols = Cols()) -> DataFrame:
    """isSecondChanceEvent: a real offensive rebound since the last possession end, or directly before."""
    w = c.by_period
    oreb = F.col("isOreb") & F.col("isRealRebound")
    just = F.coalesce(F.lag(oreb).over(w), F.lit(False))
    last_before = lambda test: F.max(F.when(test, F.col("_place"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    since = F.coalesce(last_before(oreb) > F.coalesce(last_before(F.col("isPossessionEndingEvent")), F.lit(0)), F.lit(False))
    return df.withColumn("isSecondChanceEvent", just | since).drop("_place")


def fouls_to_give(df: DataFrame, c: Cols = Cols()) -> DataFrame:
    """Fouls to give of the fouling order's teams after each event: foulsToGiveOffense and foulsToGiveDefense.

    Each team starts a period with 4 (overtime: 3); the last two minutes cap that at 1; a counted foul takes 1, not below 0.
    Cap and floor turn the counter into start - fouls before the cap, then min(that, 1) - fouls after it, floored at 0.
    """
    w = c.by_period
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    seconds = F.col("secondsRemainingInPeriod")
    capped = F.coalesce(F.max((F.coalesce(seconds <= 120, F.lit(False))).cast("int")).over(upto), F.lit(0)) == 1
    df = df.withColumn("_capped", capped)
    start = F.when(F.col(c.period) <= 4, 4).otherwise(3)

    def left(team: str) -> Column:
        foul = F.col("countsTowardsPenalty") & F.coalesce(F.col(c.team) == F.col(team), F.lit(False))
        before = F.sum((foul & ~F.col("_capped")).cast("int")).over(upto)
        after = F.sum((foul & F.col("_capped")).cast("int")).over(upto)
        free = F.greatest(start - before, F.lit(0))
        return F.greatest(F.when(F.col("_capped"), F.least(free, F.lit(1))).otherwise(free) - after, F.lit(0))

    home, away = left("homeTeamId"), left("awayTeamId")
    side = lambda x: F.when(F.col(x) == F.col("homeTeamId"), home).when(F.col(x) == F.col("awayTeamId"), away)
    df = df.withColumns({"foulsToGiveOffense": side("resolvedOffenseTeamId"), "foulsToGiveDefense": side("resolvedDefenseTeamId"), "homeFoulsToGive": home, "awayFoulsToGive": away}).drop("_capped")
    # the foul that led to the bonus was not itself in the penalty
    spent = F.col("foulsToGiveDefense") == 0
    before_foul = F.coalesce(F.lag("foulsToGiveDefense").over(w) == 0, F.lit(False))
    own = F.col("countsTowardsPenalty") & F.coalesce(F.col(c.team) == F.col("resolvedDefenseTeamId"), F.lit(False))
    return df.withColumn("isPenaltyEvent", F.coalesce(spent & (~own | before_foul), F.lit(False)))


def packed(df: DataFrame, needed: Sequence[str], name: str, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`df` after `steps` that need some of its columns; the others travel as one value `name`.

    A window copies its rows twice, and the JVM doesn't compile the copying of a row with many columns.
    """
    kept = [c for c in dict.fromkeys(needed) if c in df.columns]
    df = df.select(*kept, F.struct(*[c for c in df.columns if c not in kept]).alias(name))
    for step in steps:
        df = step(df)
    return df


def with_offense(df: DataFrame, c: Cols = Cols(), overrides: DataFrame | None = None) -> DataFrame:
    """Flags, classes, offence and defence of raw events as `enriched` has them, without its other windows."""
    return offense(starting_team(class_flags(event_flags(df, c), c), c, overrides), c)


def enriched(df: DataFrame, c: Cols = Cols(), overrides: DataFrame | None = None) -> DataFrame:
    """All of the above for raw events with homeTeamId and awayTeamId.

    Rebounds come first, as their links need an order of their own; all else goes by period and order.
    """
    at, sides = [c.game, c.period, c.order], ["homeTeamId", "awayTeamId"]
    rebound = ["isRebound", "isFreeThrow", "isFlagrantFt", "isEndFreeThrow", "isPeriodEnd", "secondsRemainingInPeriod"]
    ends = ["isRebound", "isFreeThrow", "isMadeShot", "isTurnover", "isJumpBall", "isPeriodStart", "secondsRemainingInPeriod"]
    later = [*ends, "isOreb", "isRealRebound", "countsTowardsPenalty"]
    df = class_flags(event_flags(df, c), c)
    columns = df.columns
    df = packed(df, [*at, c.action, c.shot_action, c.type, c.sub_type, c.qualifiers, c.team, c.person, *rebound], "_a", lambda x: rebounds(x, c))
    first = [x for x in df.columns if x != "_a"]
    df = df.select(*first, *[F.col(f"_a.{x}") for x in columns if x not in first])
    df = packed(df, [*at, c.action, c.team, c.possession, *sides, "scoreHome", "scoreAway", "isMissedShot", "isTechnicalFt", "isDreb", *later], "_b", lambda x: neighbours(x, c), lambda x: starting_team(x, c, overrides), lambda x: offense(x, c), lambda x: score_margins(x, c))
    df = packed(df, [*at, c.team, *sides, "resolvedOffenseTeamId", "resolvedDefenseTeamId", *later], "_c", lambda x: possession_ends(x, c), lambda x: second_chances(x, c), lambda x: fouls_to_give(x, c))
    inner = [x for x in df.schema["_c"].dataType.names if x != "_b"]
    return df.select(*[x for x in df.columns if x != "_c"], *[F.col(f"_c.{x}") for x in inner], "_c._b.*")


def recredited(df: DataFrame, c: Cols = Cols()) -> DataFrame:
    """teamIdOfRecord: defensive rebounds are credited to the team that gets the ball (the next event's offence)."""
    w = c.by_period
    return df.withColumn("teamIdOfRecord", F.when(F.col("isDreb"), F.coalesce(F.lead("resolvedOffenseTeamId").over(w), F.col(c.team))).otherwise(F.col(c.team)))


def shot_locations(df: DataFrame, c: Cols = Cols(), x: str = "xLegacy", y: str = "yLegacy", distance: str = "shotDistance", zone: str = "area") -> DataFrame:
    """Field goals with the source's zone or one derived from coordinates, and how it was found."""
    value = F.coalesce(F.col("shotValue"), shot_value(F.col(c.type))) if "shotValue" in df.columns else shot_value(F.col(c.type))
    derived = shot_zone(F.col(x), F.col(y), F.col(distance), is_three(F.col(c.type), value, F.col(distance)))
    source = null_if_empty(F.col(zone)) if zone in df.columns else F.lit(None).cast("string")
    reason = F.when(source.isNotNull(), "source").when(derived.isNotNull(), "derived").otherwise("missing_legacy_coordinates")
    return df.where(F.col("isMadeShot") | F.col("isMissedShot")).withColumns({"shotZone": F.coalesce(source, derived), "shotRange": shot_range(F.col(distance), F.col(x)), "locationReason": reason})
