"""Event sequences, lineups, possessions and attribution on hand-made games."""

import pytest
from pyspark.sql import functions as F

from scorebook.operators import attribution, context, lineups, sequence

KIND = (
    "gameId string, period long, orderNumber long, actionNumber long, actionType string, subType string, descriptor string, qualifiers array<string>, clock string, shotResult string, isFieldGoal long, teamId long, personId long, "
    "possession long, stealPersonId long, shotActionNumber long, shotValue long, blockPersonId long, scoreHome long, scoreAway long, homeTeamId long, awayTeamId long"
)
H, A = 1, 2


def event(n, kind, clock, team=None, person=None, poss=None, sub=None, result=None, value=None, shot=None, home=None, away=None, period=1, desc=None, steal=None, quals=()):
    return ("g", period, n, n, kind, sub, desc, list(quals), clock, result, int(kind in ("2pt", "3pt")), team, person, poss, steal, shot, value, None, home, away, H, A)


def table(spark, *events):
    return spark.createDataFrame(list(events), KIND)


GAME = (
    event(1, "period", "PT12M00.00S", sub="start", home=0, away=0),
    event(2, "jumpball", "PT12M00.00S", H, 11, H),
    event(3, "2pt", "PT11M40.00S", H, 11, H, result="Made", value=2, home=2, away=0),
    event(4, "timeout", "PT11M30.00S", A, None, A),
    event(5, "turnover", "PT11M10.00S", A, 21, A, sub="badpass", steal=12),
    event(6, "3pt", "PT10M50.00S", H, 12, H, result="Missed", value=3),
    event(7, "rebound", "PT10M48.00S", H, 13, H, sub="offensive", shot=6),
    event(8, "2pt", "PT10M40.00S", H, 13, H, result="Missed", value=2),
    event(9, "rebound", "PT10M38.00S", A, 22, A, sub="defensive", shot=8),
    event(10, "2pt", "PT10M20.00S", A, 22, A, result="Made", value=2, home=2, away=2),
    event(11, "period", "PT00M00.00S", sub="end", poss=H),
)


def scored(spark, events):
    """The events with the score carried forward, as real feeds have it on every row."""
    home = away = 0
    out = []
    for e in events:
        home, away = (e[-4] if e[-4] is not None else home), (e[-3] if e[-3] is not None else away)
        out.append((*e[:-4], home, away, *e[-2:]))
    return table(spark, *out)


@pytest.fixture
def enriched(spark):
    return sequence.enriched(scored(spark, GAME)).cache()


def test_offence_ends_and_reasons(enriched):
    got = {r.orderNumber: r for r in enriched.collect()}
    assert [got[n].resolvedOffenseTeamId for n in range(1, 12)] == [H, H, H, A, A, H, H, H, H, A, H]
    assert [n for n in got if got[n].isPossessionEndingEvent] == [3, 5, 9, 10, 11]
    assert [got[n].possessionBoundaryReason for n in (3, 5, 9, 10, 11)] == ["made_shot", "turnover", "def_rebound", "made_shot", "period_end"]
    assert got[8].isSecondChanceEvent and not got[6].isSecondChanceEvent and got[7].isRealRebound
    assert got[3].secondsSincePreviousEvent == 20.0 and got[1].prevOrderNumber is None and got[2].nextOrderNumber == 3
    assert (got[10].scoreMarginBefore, got[10].scoreMarginAfter, got[10].pointsAway) == (-2, 0, 2)


def test_possessions(spark, enriched):
    p = lineups.possessions(enriched).orderBy("possessionNumber").collect()
    assert [(x.offenseTeamId, x.possessionStartType, x.possessionEndType, x.pointsScoredOnPossession, x.secondsElapsed) for x in p] == [
        (H, "off_deadball", "made_shot", 2, 20.0), (A, "off_timeout", "turnover", 0, 30.0), (H, "off_live_ball_turnover", "def_rebound", 0, 32.0), (A, "off_2pt_miss", "made_shot", 2, 18.0), (H, "off_2pt_make", "period_end", 0, 620.0),
    ]
    assert [x.nextPossessionNumber for x in p] == [2, 3, 4, 5, None] and p[2].offensiveRebounds == 1 and p[2].isSecondChancePossession


def test_last_two_seconds_count_only_after_a_score(spark):
    e = [event(1, "period", "PT12M00.00S", sub="start"), event(2, "turnover", "PT00M01.50S", H, 1, H), event(3, "turnover", "PT00M01.00S", A, 2, A), event(4, "turnover", "PT00M00.50S", H, 1, H), event(5, "period", "PT00M00.00S", sub="end", poss=A)]
    got = sequence.enriched(table(spark, *e)).where("isPossessionEndingEvent").orderBy("orderNumber").collect()
    assert [r.countAsPossession for r in got] == [True, False, False, False]


def test_fouls_to_give(spark):
    foul = lambda n, clock, team=A, sub="personal", desc=None: event(n, "foul", clock, team, 20, H, sub=sub, desc=desc)
    e = [event(1, "period", "PT12M00.00S", sub="start", poss=H), event(2, "2pt", "PT11M50.00S", H, 1, H, result="Missed", value=2), foul(3, "PT11M00.00S"), foul(4, "PT10M00.00S", sub="offensive", desc="offensive"), foul(5, "PT09M00.00S", desc="shooting"), event(6, "2pt", "PT01M59.00S", H, 1, H, result="Missed", value=2), foul(7, "PT01M30.00S"), foul(8, "PT01M00.00S"), event(9, "freethrow", "PT01M00.00S", H, 1, H, sub="1 of 2", result="Made")]
    got = {r.orderNumber: r for r in sequence.enriched(table(spark, *e)).collect()}
    assert [got[n].foulsToGiveDefense for n in range(2, 10)] == [4, 3, 3, 2, 1, 0, 0, 0]
    assert [got[n].isPenaltyEvent for n in (6, 7, 8, 9)] == [False, False, True, True]


def test_rebounds_that_are_not_real(spark):
    e = [event(1, "period", "PT12M00.00S", sub="start", poss=H), event(2, "freethrow", "PT11M00.00S", H, 1, H, sub="1 of 2", result="Missed"), event(3, "rebound", "PT11M00.00S", H, 0, H, sub="offensive", shot=2), event(4, "freethrow", "PT11M00.00S", H, 1, H, sub="2 of 2", result="Missed"), event(5, "rebound", "PT10M58.00S", A, 2, A, sub="offensive", shot=4), event(6, "rebound", "PT10M00.00S", A, 2, A, sub="defensive", quals=["deadball"])]
    got = {r.orderNumber: r for r in sequence.enriched(table(spark, *e)).collect()}
    assert [got[n].isRealRebound for n in (3, 5, 6)] == [False, True, False]
    assert got[5].inferredReboundType == "defensive" and got[5].reboundTypeSourceMismatchFlag and got[6].isPlaceholderRebound


BOX = [("g", team, side, team * 10 + i, int(i <= 5)) for team, side in ((H, "home"), (A, "away")) for i in range(1, 8)]


def box(spark, people=BOX):
    return spark.createDataFrame(people, "gameId string, teamId long, team_side string, personId long, starter long")


def subs(spark, *more, periods=(1, 2)):
    rows = [event(100 * p, "period", "PT12M00.00S", sub="start", period=p) for p in periods] + [event(100 * p + 99, "period", "PT00M00.00S", sub="end", period=p) for p in periods]
    return sequence.event_flags(table(spark, *rows, *more))


def sub(n, clock, team, person, way, period=1):
    return event(n, "substitution", clock, team, person, sub=way, period=period)


def test_stints(spark):
    e = subs(spark, sub(110, "PT08M00.00S", H, 11, "out"), sub(111, "PT08M00.00S", H, 16, "in"), sub(201, "PT12M00.00S", A, 21, "out", 2), sub(202, "PT12M00.00S", A, 26, "in", 2))
    got = lineups.stints(e, box(spark)).orderBy("stint_id").collect()
    assert [(s.period, s.start_orderNumber, s.end_orderNumber, s.lineup_valid_flag) for s in got] == [(1, 100, 110, 1), (1, 110, 200, 1), (2, 200, 201, 1), (2, 201, 300, 1)]
    assert got[0].home_personIds == [11, 12, 13, 14, 15] and got[1].home_personIds == [12, 13, 14, 15, 16] and 26 not in got[2].away_personIds
    assert got[2].home_personIds == got[1].home_personIds and 26 in got[3].away_personIds
    # substitutions that open a period make no stint of their own
    opening = subs(spark, sub(201, "PT12M00.00S", A, 21, "out", 2), sub(202, "PT12M00.00S", A, 26, "in", 2), event(299, "period", "PT00M00.00S", sub="end", period=2), periods=(1,))
    got = lineups.stints(opening, box(spark)).orderBy("stint_id").collect()
    assert [(s.period, s.start_orderNumber, s.end_orderNumber) for s in got] == [(1, 100, 200), (2, 201, 300)] and 26 in got[1].away_personIds


def test_broken_lineups_and_repairs(spark):
    e = subs(spark, sub(110, "PT08M00.00S", H, 17, "out"))
    got = lineups.stints(e, box(spark)).orderBy("stint_id").collect()
    assert [s.lineup_issue for s in got] == [None, lineups.NOT_ON_COURT, lineups.NO_CARRY]
    assert [s.lineup_issue for s in lineups.stints(subs(spark, periods=(1,)), box(spark, [x for x in BOX if x[3] != 15])).collect()] == [lineups.NO_STARTERS]
    built = lineups.stints(e, box(spark))
    assert {(s.method, s.failed_period) for s in lineups.effective(built, e).collect()} == {("unrepaired", None)}
    assert {s.method for s in lineups.effective(built.where("lineup_valid_flag = 1"), e).collect()} == {"exact"}


def overtime(spark, home4, home5, issue5, *events, flag4=0):
    """Effective stints of a game with a valid and a last stint in period 4, and a broken overtime."""
    away = [21, 22, 23, 24, 25]
    stint = lambda i, period, s, e, home, flag, issue: ("g", period, i, s, e, s, e, "PT05M00.00S", "PT00M00.00S", H, A, home, away, flag, issue)
    rows = [stint(1, 4, 400, 450, [11, 12, 13, 14, 15], 1, None), stint(2, 4, 450, 500, home4, flag4, "x" if not flag4 else None), stint(3, 5, 500, 600, home5, 0, issue5)]
    e = spark.createDataFrame([("g", 5, o, o, clock, team, person, way, way is not None) for o, clock, team, person, way in (*events, (599, "PT00M00.00S", None, None, None))], "gameId string, period long, orderNumber long, actionNumber long, clock string, teamId long, personId long, subType string, isSubstitution boolean")
    return lineups.effective(spark.createDataFrame(rows, lineups.STINTS), e).orderBy("period", "stint_id").collect()


OPEN = "PT05M00.00S"


def test_overtime_repairs(spark):
    five = [11, 12, 13, 14, 15]
    last = lambda got: (got[-1].method, got[-1].failed_period, got[-1].home_personIds, got[-1].lineup_valid_flag, got[-1].opening_applied)
    stale = overtime(spark, five, [12, 13, 14, 15, 16], lineups.NOT_ON_COURT)
    assert last(stale) == ("stale_sub_out", 5, [12, 13, 14, 15, 16], 1, False) and len(stale) == 3 and stale[1].lineup_valid_flag == 0
    # one of the seed fills the place that the drift left open
    drift = overtime(spark, [12, 13, 14, 16], None, lineups.NO_CARRY, (500, OPEN, A, 21, "out"), (501, OPEN, A, 26, "in"))
    fives = lambda got: (got[-1].method, got[-1].home_personIds, got[-1].away_personIds)
    assert fives(drift) == ("end_q4_reconciled", [11, 12, 13, 14, 16], [22, 23, 24, 25, 26])
    whole = overtime(spark, five, None, lineups.NO_CARRY, (500, OPEN, A, 21, "out"), (501, OPEN, A, 26, "in"))
    assert fives(whole) == ("ot_carry_forward", five, [22, 23, 24, 25, 26])  # nothing drifted
    drift = overtime(spark, [12, 13, 14, 16], [12, 13, 14, 16], lineups.NOT_FIVE, (500, OPEN, A, 21, "out"), (501, OPEN, A, 26, "in"), (502, OPEN, H, 16, "out"), (503, OPEN, H, 17, "in"))
    assert fives(drift) == ("end_q4_reconciled", [11, 12, 13, 14, 17], [22, 23, 24, 25, 26]) and drift[-1].start_orderNumber == 500 and drift[-1].end_orderNumber == 600
    two = overtime(spark, [12, 13, 14], [12, 13, 14], lineups.NOT_FIVE, (500, OPEN, H, 14, "out"), (501, OPEN, H, 17, "in"))
    assert last(two) == ("ot_carry_forward", 5, [11, 12, 13, 15, 17], 1, True)  # two places are too many to reconcile
    late = overtime(spark, five, None, lineups.NO_CARRY, (500, "PT04M10.00S", H, 14, "out"), (501, "PT04M10.00S", H, 17, "in"))
    assert last(late) == ("ot_carry_forward", 5, five, 1, False)
    bad = overtime(spark, five, None, lineups.NO_CARRY, (500, OPEN, H, 99, "out"), (501, OPEN, H, 17, "in"))
    assert (bad[-1].method, bad[-1].failed_period, bad[-1].lineup_valid_flag) == ("unrepaired", 5, 0)
    later = overtime(spark, [12, 13, 14, 15, 16], None, lineups.NO_CARRY, flag4=1)
    assert last(later) == ("ot_carry_forward", 5, [12, 13, 14, 15, 16], 1, False)


def test_stamping(spark, enriched):
    p = lineups.possessions(enriched)
    s = lineups.stints(enriched, box(spark))
    got = lineups.stamped(p, s).collect()
    assert {(x.homeLineupId, x.awayLineupId, x.lineupValidFlag) for x in got} == {("11-12-13-14-15", "21-22-23-24-25", 1)}
    two = s.unionByName(s.withColumns({"stint_id": F.lit(2).cast("long"), "home_personIds": F.array(*[F.lit(x).cast("long") for x in (12, 13, 14, 15, 16)]), "start_clock": F.lit("PT11M00.00S")}))
    assert {x.lineupIssue for x in lineups.stamped(p, two).collect()} == {"multiple_home_lineups(count=2)"}
    assert {x.lineupIssue for x in lineups.stamped(p, s.where("period = 9")).collect()} == {"missing_on_court_coverage"}


def test_starter_check(spark, enriched):
    s = lineups.stints(enriched, box(spark))
    played = spark.createDataFrame([("g", 1, H, 10 + i) for i in range(1, 6)] + [("g", 1, A, 20 + i) for i in range(1, 5)], "gameId string, period long, teamId long, personId long")
    assert {(x.teamId, x.status) for x in lineups.starter_check(enriched, s, played).collect()} == {(H, "match"), (A, "incomplete_reference")}


def test_attribution_and_waterfall(spark, enriched):
    s = lineups.stints(enriched, box(spark))
    p = lineups.stamped(lineups.possessions(enriched), s).cache()
    played = box(spark).withColumn("seconds", F.lit(1000))
    exact = attribution.from_possessions(p, played, "exact", attribution.used_players(p, enriched))
    got = {x.personId: x for x in exact.collect()}
    assert (got[11].offensive_possessions, got[11].defensive_possessions, got[11].points_for, got[11].points_against) == (3.0, 2.0, 2.0, 2.0)
    assert got[13].used_offensive_possessions == 1.0 and got[11].used_offensive_possessions == 1.0 and got[16].offensive_possessions == 0.0
    broken = p.withColumn("homeLineupId", F.when(F.col("possessionNumber") != 2, F.col("homeLineupId")))
    assert attribution.from_possessions(broken, played, "exact").count() == 0  # one unresolved possession drops the game
    event_based = attribution.from_events(enriched, s, played)
    chosen = attribution.waterfall([attribution.from_possessions(broken, played, "exact"), event_based], played, ["gameId", "personId"])
    assert {x.method for x in chosen.collect()} == {"event_estimated"}
    nobody = attribution.waterfall([exact.limit(0)], played, ["gameId", "personId"])
    assert {x.method for x in nobody.collect()} == {"missing"}
    team = {x.teamId: x for x in attribution.team_possessions(p).collect()}
    assert (team[H].offensive_possessions, team[A].points_for) == (3.0, 2.0)


def test_contexts(spark, enriched):
    s = lineups.stints(enriched, box(spark))
    c = attribution.contexts()
    shots = {x.personId: x for x in attribution.per_player(enriched, s, box(spark), c["defensive_shot"], "exact").collect()}
    assert (shots[11].opponent_two_point_attempts, shots[21].opponent_two_point_attempts, shots[16].opponent_two_point_attempts) == (1.0, 2.0, 0.0)
    assists = {x.personId: x for x in attribution.per_player(enriched, s, box(spark), c["assist"], "exact").collect()}
    assert (assists[11].teammate_field_goals_made, assists[12].teammate_field_goals_made) == (0.0, 1.0)


def test_boxscore_estimate(spark):
    teams = spark.createDataFrame([("g", H, 80, 20, 10, 12, 100, 14400), ("g", A, 85, 15, 9, 11, 95, 14400)], "gameId string, teamId long, fga int, fta int, oreb int, tov int, points int, seconds int")
    played = spark.createDataFrame([("g", H, 11, 1440, 10, 5, 2)], "gameId string, teamId long, personId long, seconds int, fga int, fta int, tov int")
    x = attribution.from_boxscore(played, teams).collect()[0]
    poss = 0.5 * ((80 + 0.44 * 20 - 10 + 12) + (85 + 0.44 * 15 - 9 + 11))
    assert abs(x.offensive_possessions - 0.5 * poss) < 1e-9 and abs(x.used_offensive_possessions - 14.2) < 1e-9 and x.points_for == 50.0


def test_context_waterfalls(spark, enriched):
    b = box(spark).withColumns({"seconds": F.lit(1440), "fgm": F.when(F.col("personId") == 11, 1).otherwise(0)})
    enriched = spark.createDataFrame(enriched.collect(), enriched.schema)
    made = lineups.stints(enriched, box(spark))
    s = spark.createDataFrame(made.collect(), made.schema)
    teams = spark.createDataFrame([("g", H, 80, 20, 10, 12, 100, 30, 40, 10, 44, 14400), ("g", A, 85, 15, 9, 11, 95, 25, 36, 9, 40, 14400)], "gameId string, teamId long, fga int, fta int, oreb int, tov int, points int, fg3a int, fgm int, fg3m int, reb int, seconds int")
    c, estimates, keys = attribution.contexts(), attribution.contexts_from_boxscore(b, teams), ["gameId", "personId"]
    cut = s.withColumn("home_personIds", F.lit(None).cast("array<long>"))
    best = lambda k, x: {r.personId: r for r in attribution.waterfall([attribution.per_player(enriched, x, b, c[k], "exact"), estimates[k]], b, keys).collect()}
    assert len(best("assist", s)) == 14 and {r.method for r in best("assist", s).values()} == {"exact"}
    got = best("defensive_shot", cut)  # games without a whole lineup stay, estimated by minutes
    assert len(got) == 14 and {r.method for r in got.values()} == {"boxscore_estimated"} and (got[11].opponent_two_point_attempts, got[11].opponent_two_point_makes) == (30.0, 13.5)
    assert best("assist", cut)[11].teammate_field_goals_made == 19.0 and best("rebound", cut)[21].rebound_opportunities == 42.0
    context = enriched.select("gameId", "actionNumber", F.col("homeTeamId").alias("home_teamId"), F.col("awayTeamId").alias("away_teamId"), F.array(*[F.lit(x).cast("long") for x in range(12, 17)]).alias("home_personIds"), F.array(*[F.lit(x).cast("long") for x in range(21, 26)]).alias("away_personIds"))
    own = {r.personId: r for r in attribution.per_player(enriched, cut, b, c["assist"], "event_estimated", context=context).collect()}
    assert own[16].teammate_field_goals_made == 1.0 and own[21].method == "event_estimated"
    p = lineups.possessions(enriched)
    p = spark.createDataFrame(p.collect(), p.schema)
    unknown = p.withColumn("defenseTeamId", F.when(F.col("possessionNumber") != 2, F.col("defenseTeamId")))
    lost = enriched.withColumn("resolvedDefenseTeamId", F.lit(None).cast("long"))
    tries = lambda e: {r.teamId: r for r in attribution.waterfall([attribution.team_possessions(unknown), attribution.team_possessions_from_events(e, b), attribution.team_possessions_from_boxscore(teams)], b, ["gameId", "teamId"]).collect()}
    x, y = tries(enriched), tries(lost)
    assert (x[H].method, x[H].offensive_possessions, x[A].defensive_possessions, x[A].points_for) == ("event_estimated", 3.0, 3.0, 2.0)
    assert (y[H].method, y[H].points_for) == ("boxscore_estimated", 100.0) and y[H].offensive_possessions > 80
    shots = lambda e: {r.teamId: r for r in attribution.waterfall(attribution.team_defensive_shots(e, b, teams), b, ["gameId", "teamId"]).collect()}
    assert [(r.method, r.opponent_two_point_attempts) for r in (shots(enriched)[A], shots(lost)[A])] == [("exact", 2.0), ("event_estimated", 2.0)]
    nobody = lost.withColumn("resolvedOffenseTeamId", F.lit(None).cast("long"))
    assert [(r.method, r.opponent_two_point_attempts) for r in (shots(nobody)[H], shots(nobody)[A])] == [("boxscore_estimated", 60.0), ("boxscore_estimated", 50.0)]


def test_box_context_and_issues(spark, rows):
    teams = spark.createDataFrame([("g", "home", 1, "LA ", "Reds"), ("g", "away", 2, "NY", "Blues"), ("h", "home", 1, "LA", "Reds")], "gameId string, team_side string, teamId long, teamCity string, teamName string")
    players = spark.createDataFrame([("g", 11, "Al Po"), ("g", 12, "Bo"), ("g", 21, "Bo"), ("g", 22, " ")], "gameId string, personId long, name string")
    e = spark.createDataFrame([("g", 1, 1, 11, 22, "SUB: X replaced by al po"), ("g", 2, 2, 22, 12, "replaced by Bo"), ("h", 3, 1, 11, None, None), ("g", 4, None, None, None, "x")], "gameId string, orderNumber long, teamId long, personId long, stealPersonId long, description string")
    got = {r.orderNumber: r for r in context.box_context(e, teams, players, {"playerFullName": ("personId", None), "stealFullName": ("stealPersonId", "description")}).collect()}
    assert (got[1].location, got[1].playerteamCity, got[1].opponentteamName, got[1].playerFullName, got[1].stealFullName, got[1].subsInPersonId) == ("h", "LA", "Blues", "Al Po", "SUB: X replaced by al po", 11)
    assert (got[2].playerFullName, got[2].stealFullName, got[2].subsInPersonId) == (None, "Bo", None)  # two players share the name
    assert (got[3].location, got[3].opponentteamName, got[4].location) == ("h", None, None) and len(got) == 4
    ctx = spark.createDataFrame([("g", 1, 1, 2, [2, 1], [3], "1-2", "3"), ("g", 1, 1, 2, [1], [3], "1", "3"), ("g", 2, 1, 1, [1], [3], "1", "4"), ("g", 3, 1, 2, None, [3], None, "3")], "game_id string, event_num long, home_team_id long, away_team_id long, home_current_player_ids array<long>, away_current_player_ids array<long>, home_lineup_id string, away_lineup_id string")
    assert rows(context.context_issues(ctx)) == [("g", 1, "duplicate_event"), ("g", 2, "lineup_id_mismatch"), ("g", 2, "unusable_sides"), ("g", 3, "lineup_id_mismatch")]
