"""The lineup fold against a plain walk over each game, and trips, overrides and methods on small games."""

import random

from pyspark.sql import functions as F

from scorebook.operators import lineups, sequence
from test_games import A, H, box, event, sub, subs, table

FIVES = {H: {11, 12, 13, 14, 15}, A: {21, 22, 23, 24, 25}}


def plain_stints(events):
    """(period, start, end, home, away, issue) of one game: (period, order, clock, team, person, way or None) in order."""
    out, fives = [], {t: set(f) for t, f in FIVES.items()}
    known = True
    for period in sorted({e[0] for e in events}):
        own = [e for e in events if e[0] == period]
        last = own[-1][1] + 1
        if not known:
            out.append((period, own[0][1], last, None, None, lineups.NO_CARRY))
            continue
        opened, i, broken = own[0][1], 0, False
        while i < len(own) and not broken:
            j = i + 1
            if own[i][5] is not None:
                while j < len(own) and own[j][2] == own[i][2]:
                    j += 1
                opening = period > 1 and i == 0 and own[0][2] in lineups.OPENING_CLOCKS
                if own[i][1] != opened and not opening:
                    out.append((period, opened, own[i][1], sorted(fives[H]), sorted(fives[A]), None))
                issue, now = None, {t: set(f) for t, f in fives.items()}
                for _, _, _, team, person, way in own[i:j]:
                    if way is None or issue:
                        continue
                    if team not in now or person is None or way not in ("in", "out") or (way == "in" and person in now[team]):
                        issue = lineups.NOT_FIVE
                    elif way == "out" and person not in now[team]:
                        issue = lineups.NOT_ON_COURT
                    else:
                        now[team] ^= {person}
                if not issue and any(len(f) != 5 for f in now.values()):
                    issue = lineups.NOT_FIVE
                if issue:
                    start = own[0][1] if opening else own[i][1]
                    out.append((period, start, last, None, None, lineups.BAD_OPENING if opening else issue))
                    broken = True
                else:
                    fives = now
                    opened = own[0][1] if opening else own[i][1]
            i = j
        known = not broken
        if known:
            out.append((period, opened, last, sorted(fives[H]), sorted(fives[A]), None))
    return out


def test_fold_against_a_plain_walk(spark):
    """Games with valid pairs, several pairs on one clock, openings, odd ways, and substitutions that can't be."""
    rng, games, rows = random.Random(8), {}, []
    for g in range(60):
        events, order, now = [], 0, {t: set(f) for t, f in FIVES.items()}
        for period in range(1, rng.choice([2, 4, 5]) + 1):
            clock = 720 if period <= 4 else 300
            for _ in range(rng.randrange(1, 7)):
                at = f"PT{clock // 60:02d}M{clock % 60:05.2f}S"
                kind = rng.random()
                if kind < 0.5:
                    for _ in range(rng.choice([1, 1, 2])):
                        team = rng.choice([H, A])
                        leaves, comes = rng.choice(sorted(now[team])), rng.choice([p for p in range(team * 10 + 1, team * 10 + 9) if p not in now[team]])
                        now[team] = now[team] - {leaves} | {comes}
                        pair = [(team, leaves, "out"), (team, comes, "in")]
                        for team_, person, way in pair if rng.random() < 0.8 else pair[::-1]:
                            events.append((period, order, at, team_, person, way))
                            order += 1
                elif kind < 0.56:
                    events.append((period, order, at, rng.choice([H, A, 3, None]), rng.choice([11, 18, 21, None]), rng.choice(["in", "out", "off", "OUT "])))
                    order += 1
                else:
                    events.append((period, order, at, H, 11, None))
                    order += 1
                clock -= rng.choice([0, 20, 40])
        games[g] = [(p, o, c, t, who, None if way is None else way.strip().lower()) for p, o, c, t, who, way in events]
        rows += [(str(g), p, o, o, c, t, who, way, way is not None) for p, o, c, t, who, way in events]
    e = spark.createDataFrame(rows, "gameId string, period long, orderNumber long, actionNumber long, clock string, teamId long, personId long, subType string, isSubstitution boolean")
    people = [(str(g), team, side, team * 10 + i, int(i <= 5)) for g in games for team, side in ((H, "home"), (A, "away")) for i in range(1, 9)]
    b = spark.createDataFrame(people, "gameId string, teamId long, team_side string, personId long, starter long")
    built = lineups.stints(e.repartition(5), b)
    got = {}
    for s in built.orderBy("gameId", "stint_id").collect():
        got.setdefault(int(s.gameId), []).append((s.period, s.start_orderNumber, s.end_orderNumber, s.home_personIds, s.away_personIds, s.lineup_issue))
    assert {g: plain_stints(ev) for g, ev in games.items()} == got
    issues = {x[5] for stints in got.values() for x in stints}
    assert issues >= {None, lineups.NO_CARRY, lineups.NOT_FIVE, lineups.NOT_ON_COURT}
    plan = built._jdf.queryExecution().executedPlan().toString() + lineups.effective(built, e)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInPandas" not in plan and "ArrowEval" not in plan


def test_free_throw_trips(spark):
    throw = lambda n, clock, person, sub_type, result, desc=None: event(n, "freethrow", clock, H, person, H, sub=sub_type, result=result, desc=desc)
    e = [
        throw(1, "PT11M00.00S", 11, "1 of 2", "Made"), event(2, "timeout", "PT11M00.00S", A), sub(3, "PT11M00.00S", H, 12, "out"), throw(4, "PT11M00.00S", 11, "2 of 2", "Missed"), throw(5, "PT11M00.00S", 12, "1 of 1", "Made", "technical"),
        throw(6, "PT10M00.00S", 11, "1 of 2", "Made"), throw(7, "PT10M00.00S", 11, "2 of 2", "Made"), throw(8, "PT10M00.00S", 11, "1 of 2", "Made"), throw(9, "PT10M00.00S", 11, "2 of 2", "Made"), throw(10, "PT09M00.00S", 13, "1 of 3", "Missed"),
    ]
    got = sequence.free_throw_trips(sequence.class_flags(sequence.event_flags(table(spark, *e)))).orderBy("tripNumber").collect()
    assert [(t.personId, t.kind, t.throws, t.expected, t.made, t["first"], t["last"], t.interrupted, t.complete) for t in got] == [
        (11, "plain", 2, 2, 1, 1, 4, True, True), (12, "technical", 1, 1, 1, 5, 5, False, True), (11, "plain", 2, 2, 2, 6, 7, False, True), (11, "plain", 2, 2, 2, 8, 9, False, True), (13, "plain", 1, 3, 0, 10, 10, False, False),
    ]


def test_starting_team_override(spark):
    """An override names who starts a period; other periods follow their events."""
    rows = [event(100 * p + n, kind, "PT12M00.00S", team, 11 if team == H else 21, None, sub="start" if kind == "period" else "badpass", period=p) for p in (2, 3) for n, kind, team in ((0, "period", None), (1, "turnover", H))]
    over = spark.createDataFrame([("g", 3, A)], "gameId string, period long, teamId long")
    got = {r.period: r.periodStartTeamId for r in sequence.enriched(table(spark, *rows), overrides=over).where(F.col("isPeriodStart")).collect()}
    assert got == {2: H, 3: A}


def test_games_without_usable_sides(spark):
    e = subs(spark, sub(110, "PT08M00.00S", H, 11, "out"), sub(111, "PT08M00.00S", H, 16, "in"))
    one = [("g", H, side, 10 + i, int(i <= 5)) for side in ("home", "away") for i in range(1, 7)]
    assert lineups.stints(e, box(spark, one)).count() == 0 and lineups.stints(e.limit(0), box(spark)).count() == 0
