"""The game queries in DuckDB's SQL.

A team's five follow from how many substitutions it has had: n of them turn the starters by n places round its eight. The
first substitution that can't be (`broken`) ends what is known of a game, until a repair carries the fives of period 4
into the overtime. That and the windows below say all that is needed.
"""

# events with offence, scores, possession ends, rebounds and fouls to give
EVENTS = """
src AS (SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS g, user_id AS u, CAST((day(ts) - 1) // 7 + 1 AS BIGINT) AS p, event_id AS e, event_type AS kind, value, row_number() OVER w AS k, lead(event_id) OVER w IS NULL AS final FROM events WINDOW w AS (PARTITION BY user_id, (day(ts) - 1) // 7 ORDER BY event_id)),
swaps AS (SELECT *, 100 + k // 3 % 2 * 100 AS poss, u % 10 = 0 AND p = 4 AND final AND k % 6 <> 1 AS forced, u % 10 = 0 AND p = 4 AND final AND k % 6 <> 1 OR kind = 'signup' AND (k % 6 = 0 OR k = 1 OR u % 4 = 1 AND k % 6 = 4) AS swap FROM src),
sides AS (SELECT *, CASE WHEN e % 5 = 0 THEN 300 - poss ELSE poss END AS side FROM swaps),
turns AS (SELECT *, count(*) FILTER (swap) OVER (PARTITION BY g ORDER BY p, e) AS m, coalesce(count(*) FILTER (swap) OVER (PARTITION BY g, side ORDER BY p, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS j FROM sides),
faults AS (SELECT *, swap AND (forced OR u % 10 = 5 AND m = 2) AS bad FROM turns),
parts AS (SELECT *, side + (j + CASE WHEN bad AND u % 20 < 10 THEN 6 ELSE 0 END) % 8 AS leaves, side + (j + CASE WHEN bad AND u % 20 >= 10 THEN 1 ELSE 5 END) % 8 AS comes,
  CASE WHEN swap THEN ['out', 'in'] WHEN kind = 'signup' AND e % 6 = 0 THEN ['', '1', 'timeout', '2'] WHEN kind = 'signup' AND e % 3 = 0 THEN ['', '1', '2'] WHEN kind = 'error' AND e % 4 = 0 THEN ['', 'timeout'] ELSE [''] END AS list FROM faults),
flat AS (SELECT *, unnest(range(0, len(list))) AS s FROM parts),
flags AS (SELECT *, e * 4 + s AS o, list[s + 1] AS part, list[s + 1] IN ('1', '2') AS ft, list[s + 1] = 'timeout' AS tmo, swap AS sub, CAST(greatest(CASE WHEN p <= 4 THEN 720 ELSE 300 END - k // 2 * 17.5, 0) AS DOUBLE) AS secs, NOT swap AND s = 0 AS plain FROM flat),
teams AS (SELECT *, plain AND kind IN ('click', 'purchase') AS goal, plain AND kind IN ('click', 'purchase') AND value > 9 AS made, plain AND kind = 'view' AS reb, plain AND kind = 'error' AS tov, plain AND kind = 'signup' AS foul, CASE WHEN plain THEN CASE kind WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 END END AS val, ft AND (CAST(floor(value) AS BIGINT) + s) % 2 = 0 AS hit, CASE WHEN ft THEN poss ELSE side END AS team FROM flags),
people AS (SELECT *, CASE part WHEN 'out' THEN leaves WHEN 'in' THEN comes WHEN 'timeout' THEN NULL ELSE team + e % 8 END AS person, reb AND team <> poss AS dreb, reb AND team = poss AS oreb, CASE WHEN made THEN val WHEN hit THEN 1 ELSE 0 END AS pts, printf('PT%02dM%05.2fS', CAST(floor(secs / 60) AS INTEGER), secs - floor(secs / 60) * 60) AS clock, row_number() OVER (PARTITION BY g, p ORDER BY o) AS rn FROM teams),
offence AS (SELECT *, CASE WHEN dreb AND rn > 1 THEN coalesce(last_value(CASE WHEN NOT (dreb AND rn > 1) THEN poss END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), poss) ELSE poss END AS off,
  sum(CASE WHEN team = 100 THEN pts ELSE 0 END) OVER (PARTITION BY g ORDER BY p, o) AS home, sum(CASE WHEN team = 200 THEN pts ELSE 0 END) OVER (PARTITION BY g ORDER BY p, o) AS away, lag(CASE WHEN goal THEN team END) OVER w AS shot_team, lag(CASE WHEN goal THEN person END) OVER w AS shot_person FROM people WINDOW w AS (PARTITION BY g, p ORDER BY o)),
changes AS (SELECT *, lead(o) OVER w IS NULL AS last, coalesce(off <> lead(off) OVER w, false) AS changed, CASE off WHEN 100 THEN 1 ELSE -1 END AS sign, coalesce(lag(home) OVER (PARTITION BY g ORDER BY p, o), 0) AS home0, coalesce(lag(away) OVER (PARTITION BY g ORDER BY p, o), 0) AS away0 FROM offence WINDOW w AS (PARTITION BY g, p ORDER BY o)),
ends AS (SELECT *, last OR changed AS ended, coalesce(count(*) FILTER (last OR changed) OVER (PARTITION BY g, p ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n, last_value(CASE WHEN last OR changed THEN secs END IGNORE NULLS) OVER (PARTITION BY g, p ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS secs0 FROM changes),
counted AS (SELECT *, ended AND (secs > 2 OR secs0 IS NULL OR secs0 > 2 OR bool_or(made OR ft) OVER (PARTITION BY g, p, n ORDER BY o)) AS counts,
  CASE WHEN ended THEN CASE WHEN made THEN 'made_shot' WHEN tov THEN 'turnover' WHEN reb AND changed THEN 'def_rebound' WHEN ft AND changed THEN 'free_throw' WHEN last THEN 'period_end' ELSE 'offense_change' END END AS reason,
  coalesce(lag(oreb) OVER (PARTITION BY g, p ORDER BY o), false) OR coalesce(bool_or(oreb) OVER (PARTITION BY g, p, n ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS again,
  bool_or(secs <= 120) OVER (PARTITION BY g, p ORDER BY o) AS capped FROM ends),
fouls AS (SELECT *, greatest(CASE WHEN capped THEN least(free, 1) ELSE free END - late, 0) AS togive FROM (SELECT *, greatest(CASE WHEN p <= 4 THEN 4 ELSE 3 END - early, 0) AS free FROM (SELECT *, CASE off WHEN 100 THEN count(*) FILTER (foul AND NOT capped AND team = 200) OVER w ELSE count(*) FILTER (foul AND NOT capped AND team = 100) OVER w END AS early,
  CASE off WHEN 100 THEN count(*) FILTER (foul AND capped AND team = 200) OVER w ELSE count(*) FILTER (foul AND capped AND team = 100) OVER w END AS late FROM counted WINDOW w AS (PARTITION BY g, p ORDER BY o)))),
ev AS (SELECT *, togive = 0 AND (NOT (foul AND team = 300 - off) OR coalesce(lag(togive) OVER (PARTITION BY g, p ORDER BY o) = 0, false)) AS penalty FROM fouls)
"""

EVENT_FLAGS = f"""
WITH {EVENTS}
SELECT g AS "gameId", o AS "orderNumber", made AS "isMadeShot", goal AND NOT made AS "isMissedShot", reb AS "isRebound", tov AS "isTurnover", ft AS "isFreeThrow", tmo AS "isTimeout", sub AS "isSubstitution", lag(o) OVER w AS "prevOrderNumber", lead(o) OVER w AS "nextOrderNumber" FROM people WINDOW w AS (PARTITION BY g, p ORDER BY o)
"""

EVENT_CLASSES = f"""
WITH {EVENTS}
SELECT g AS "gameId", o AS "orderNumber", oreb AS "isOreb", dreb AS "isDreb", foul AS "countsTowardsPenalty", tov AND e % 2 = 0 AS "isBadPassTurnover", CASE WHEN ft THEN CAST(part AS INTEGER) END AS "freeThrowNumber", CASE WHEN ft THEN 2 END AS "freeThrowOf", part = '2' AS "isEndFreeThrow" FROM people
"""

FREE_THROW_TRIPS = f"""
WITH {EVENTS}, trips AS (SELECT g, p, any_value(team) AS team, any_value(person) AS person, any_value(clock) AS clock, e, count(*) AS throws, count(*) FILTER (hit) AS made, min(o) AS a, max(o) AS z FROM people WHERE ft GROUP BY g, p, e)
SELECT g AS "gameId", p AS period, CAST(row_number() OVER (PARTITION BY g, p ORDER BY a) AS INTEGER) AS "tripNumber", CAST(team AS BIGINT) AS "teamId", CAST(person AS BIGINT) AS "personId", clock, 'plain' AS kind, throws, 2 AS expected, made, a AS "first", z AS "last", e % 6 = 0 AS interrupted, true AS complete FROM trips
"""

SHOT_LOCATIONS = f"""
WITH {EVENTS}, x AS (SELECT *, (value * 10 - 100) / 10 AS x, (e % 280) / 10 AS y FROM people WHERE goal)
SELECT g AS "gameId", o AS "orderNumber", CASE WHEN x IS NULL THEN NULL WHEN sqrt(x * x + y * y) <= 4.3 THEN 'Restricted Area' WHEN abs(x) <= 8 AND y <= 13.75 THEN 'In The Paint (Non-RA)' WHEN val = 2 THEN 'Mid-Range'
  WHEN abs(x) >= 22 AND y <= 9 THEN CASE WHEN x < 0 THEN 'Left Corner 3' ELSE 'Right Corner 3' END ELSE 'Above the Break 3' END AS "shotZone", CAST(NULL AS VARCHAR) AS "shotRange", CASE WHEN x IS NULL THEN 'missing_legacy_coordinates' ELSE 'derived' END AS "locationReason" FROM x
"""

ENRICHED = f"""
WITH {EVENTS}
SELECT g AS "gameId", p AS period, o AS "orderNumber", CAST(off AS BIGINT) AS "resolvedOffenseTeamId", CASE off WHEN 100 THEN 'h' ELSE 'v' END AS "offenseHomeAway", ended AS "isPossessionEndingEvent", counts AS "countAsPossession", reason AS "possessionBoundaryReason", reb AS "isRealRebound",
  again AS "isSecondChanceEvent", CAST(togive AS BIGINT) AS "foulsToGiveDefense", penalty AS "isPenaltyEvent", CAST(sign * (home0 - away0) AS BIGINT) AS "scoreMarginBefore", CAST(sign * (home - away) AS BIGINT) AS "scoreMarginAfter" FROM ev
"""

# stints: cut at substitutions; each side's five turned by the substitutions it has had; repairs of overtimes
STINTS = """
heads AS (SELECT g, u, p, o, k, clock, side, bad FROM ev WHERE part = 'out'),
broken AS (SELECT g, p AS bp, o AS bo, clock AS bclock, k = 1 AND p > 1 AS opening, CASE WHEN k = 1 AND p > 1 THEN 'invalid_opening_substitution_cluster' WHEN u % 20 < 10 THEN 'substitution_removes_player_not_on_court' ELSE 'substitution_produces_duplicate_or_non_five_lineup' END AS why FROM heads WHERE bad QUALIFY row_number() OVER (PARTITION BY g ORDER BY p, o) = 1),
periods AS (SELECT g, p, min(o) AS a, max(o) AS z, arg_min(clock, o) AS ca, arg_max(clock, o) AS cz FROM ev GROUP BY ALL),
cuts AS (SELECT g, p, a AS s, ca AS cs FROM periods UNION ALL SELECT g, p, o, clock FROM heads WHERE k <> 1),
pieces AS (SELECT c.g, c.p, s, coalesce(lead(s) OVER w, z + 1) AS t, s AS sa, coalesce(lead(s) OVER w, z) AS ta, cs, coalesce(lead(cs) OVER w, cz) AS ct FROM cuts c JOIN periods x ON c.g = x.g AND c.p = x.p WINDOW w AS (PARTITION BY c.g, c.p ORDER BY s)),
done AS (SELECT x.g, x.p, x.s, x.t, x.sa, x.ta, x.cs, x.ct, count(h.g) FILTER (h.side = 100) AS jh, count(h.g) FILTER (h.side = 200) AS ja FROM pieces x LEFT JOIN heads h ON h.g = x.g AND (h.p < x.p OR h.p = x.p AND h.o <= x.s) GROUP BY ALL),
valid AS (SELECT d.g, d.p, s, t, sa, ta, cs, ct, list_sort([100 + (jh + i) % 8 FOR i IN range(5)]) AS hl, list_sort([200 + (ja + i) % 8 FOR i IN range(5)]) AS al, CAST(NULL AS VARCHAR) AS issue FROM done d LEFT JOIN broken b ON d.g = b.g WHERE b.g IS NULL OR d.p < bp OR d.p = bp AND d.s < bo),
invalid AS (SELECT x.g, x.p, CASE WHEN x.p = bp THEN bo ELSE a END AS s, z + 1 AS t, CASE WHEN x.p = bp THEN bo ELSE a END AS sa, z AS ta, CASE WHEN x.p = bp THEN bclock ELSE ca END AS cs, cz AS ct, NULL AS hl, NULL AS al, CASE WHEN x.p = bp THEN why ELSE 'carry_forward_unavailable_period_start' END AS issue FROM periods x JOIN broken b ON x.g = b.g AND x.p >= bp),
stints AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, s) AS id FROM (SELECT * FROM valid UNION ALL SELECT * FROM invalid)),
failed AS (SELECT g, arg_min(issue IS NOT NULL, s) AS lost FROM stints WHERE p = 5 GROUP BY g HAVING lost),
seed AS (SELECT g, arg_max(hl, t) AS hl, arg_max(al, t) AS al FROM stints WHERE p = 4 AND issue IS NULL GROUP BY g),
opening AS (SELECT g, max(CASE part WHEN 'out' THEN person END) AS leaves, max(CASE part WHEN 'in' THEN person END) AS comes FROM ev WHERE p = 5 AND k = 1 AND sub GROUP BY g),
carried AS (SELECT f.g, o.g IS NOT NULL AS opened, CASE WHEN s.g IS NULL THEN false WHEN o.g IS NULL THEN true WHEN NOT list_contains(list_concat(s.hl, s.al), o.leaves) THEN false ELSE NOT list_contains(list_filter(list_concat(s.hl, s.al), lambda x: x <> o.leaves), o.comes) END AS ok,
  CASE WHEN o.leaves < 200 THEN list_sort(list_append(list_filter(s.hl, lambda x: x <> o.leaves), o.comes)) ELSE s.hl END AS hl, CASE WHEN o.leaves >= 200 THEN list_sort(list_append(list_filter(s.al, lambda x: x <> o.leaves), o.comes)) ELSE s.al END AS al FROM failed f LEFT JOIN seed s ON f.g = s.g LEFT JOIN opening o ON f.g = o.g),
repaired AS (SELECT * FROM carried WHERE ok),
effective AS (SELECT s.g, s.p, id, s, t, sa, ta, cs, ct, s.hl, s.al, issue, CASE WHEN f.g IS NOT NULL THEN 5 END AS failed_period, CASE WHEN r.g IS NOT NULL THEN 'ot_carry_forward' WHEN f.g IS NULL AND bool_and(issue IS NULL) OVER (PARTITION BY s.g) THEN 'exact' ELSE 'unrepaired' END AS method, coalesce(r.opened, false) AS opened FROM stints s LEFT JOIN failed f ON s.g = f.g LEFT JOIN repaired r ON s.g = r.g WHERE r.g IS NULL OR s.p <> 5
  UNION ALL SELECT r.g, 5, (SELECT min(id) FROM stints s WHERE s.g = r.g AND s.p = 5), a, z + 1, a, z, ca, cz, r.hl, r.al, NULL, 5, 'ot_carry_forward', opened FROM repaired r JOIN periods x ON r.g = x.g AND x.p = 5)
"""

_STINT = """g AS "gameId", p AS period, id AS stint_id, s AS "start_orderNumber", t AS "end_orderNumber", sa AS "start_actionNumber", ta AS "end_actionNumber", cs AS start_clock, ct AS end_clock, CAST(100 AS BIGINT) AS "home_teamId", CAST(200 AS BIGINT) AS "away_teamId", CAST(issue IS NULL AS BIGINT) AS lineup_valid_flag, issue AS lineup_issue, array_to_string(hl, '-') AS home_lineup, array_to_string(al, '-') AS away_lineup"""

LINEUP_STINTS = f"WITH {EVENTS}, {STINTS} SELECT {_STINT} FROM stints"
EFFECTIVE_STINTS = f"WITH {EVENTS}, {STINTS} SELECT {_STINT}, CAST(failed_period AS BIGINT) AS failed_period, method, opened AS opening_applied FROM effective"

STARTER_CHECK = f"""
WITH {EVENTS}, {STINTS},
first_sub AS (SELECT g, p, side, person, arg_min(part, o) AS way FROM ev WHERE sub GROUP BY ALL),
reference AS (SELECT e.g, e.p, e.team, list_sort(list(DISTINCT e.person)) AS five FROM ev e LEFT JOIN first_sub f ON e.g = f.g AND e.p = f.p AND e.team = f.side AND e.person = f.person WHERE e.person IS NOT NULL AND (way IS NULL OR way <> 'in') GROUP BY ALL)
SELECT r.g AS "gameId", r.p AS period, CAST(r.team AS BIGINT) AS "teamId", CASE WHEN s.issue IS NOT NULL THEN 'invalid_lineup' WHEN len(five) <> 5 THEN 'incomplete_reference' WHEN five = CASE r.team WHEN 100 THEN s.hl ELSE s.al END THEN 'match' ELSE 'mismatch' END AS status
FROM reference r JOIN effective s ON r.g = s.g AND r.p = s.p QUALIFY row_number() OVER (PARTITION BY r.g, r.p, r.team ORDER BY s.id) = 1
"""

# possessions: first event (f), last event (z), last event that is no substitution (l)
POSSESSIONS = """
numbered AS (SELECT *, 1 + coalesce(count(*) FILTER (ended) OVER (PARTITION BY g ORDER BY p, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num FROM ev),
breaks AS (SELECT *, last_value(clock) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS endclock, coalesce(lead(ft) OVER w AND lead(clock) OVER w = clock, false) AS next_ft, coalesce(bool_or(tov) OVER (PARTITION BY g, num, clock ORDER BY p, o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS tov_after FROM numbered WINDOW w AS (PARTITION BY g, num ORDER BY p, o)),
grouped AS (SELECT g, num, arg_min(x, (p, o)) AS f, arg_max(x, (p, o)) AS z, arg_max(x, (p, o)) FILTER (NOT sub) AS l, bool_or(again) AS again, bool_or(penalty) AS penalty, count(*) FILTER (goal) AS fga, count(*) FILTER (made) AS fgm, count(*) FILTER (ft) AS fta, count(*) FILTER (tov) AS tov, count(*) FILTER (oreb) AS oreb,
  bool_or(tmo AND (clock <> endclock AND NOT next_ft OR tov_after)) AS timeout, list(DISTINCT clock) FILTER (tmo AND NOT next_ft) AS timeouts FROM breaks x GROUP BY g, num),
linked AS (SELECT *, lag(z) OVER w AS pz, lag(l) OVER w AS pl, lag(num) OVER w AS pnum, lag(timeouts) OVER w AS ptimeouts, lead(num) OVER w AS nnum, row_number() OVER (PARTITION BY g, z.p ORDER BY num) AS inp FROM grouped WINDOW w AS (PARTITION BY g ORDER BY num)),
q AS (SELECT *, z.p AS p, coalesce(pz.clock, f.clock) AS clock0, coalesce(pz.secs, f.secs) AS secs0, CASE WHEN pz IS NULL THEN f.home ELSE pz.home END AS h0, CASE WHEN pz IS NULL THEN f.away ELSE pz.away END AS a0, f.off AS off, CASE f.off WHEN 100 THEN 1 ELSE -1 END AS sign, coalesce(list_contains(ptimeouts, coalesce(pz.clock, f.clock)), false) AS before FROM linked)
"""


def stamped(name: str, stints: str) -> str:
    """Possessions with both lineups and their issues, by a table of stints."""
    return f"""
met_{name} AS (SELECT q.g, q.num, count(*) AS n, bool_and(s.cs = q.clock0) AS same, bool_or(s.issue IS NOT NULL) AS bad, list(DISTINCT array_to_string(s.hl, '-')) FILTER (s.hl IS NOT NULL) AS hs, list(DISTINCT array_to_string(s.al, '-')) FILTER (s.al IS NOT NULL) AS vs, list_sort(list(DISTINCT s.issue) FILTER (s.issue IS NOT NULL)) AS issues, arg_max({{'h': array_to_string(s.hl, '-'), 'v': array_to_string(s.al, '-')}}, (s.s, s.t, s.id)) AS final FROM q JOIN {stints} s ON q.g = s.g AND q.p = s.p AND s.t > q.f.o AND s.s <= q.z.o GROUP BY ALL),
poss_{name} AS (SELECT q.*, CASE WHEN n > 1 AND same THEN final.h WHEN len(hs) = 1 THEN hs[1] END AS hid, CASE WHEN n > 1 AND same THEN final.v WHEN len(vs) = 1 THEN vs[1] END AS vid,
  list_concat(list_filter([CASE WHEN n IS NULL THEN 'missing_on_court_coverage' END, CASE WHEN len(hs) > 1 AND NOT same THEN 'multiple_home_lineups(count=' || len(hs) || ')' END, CASE WHEN len(vs) > 1 AND NOT same THEN 'multiple_away_lineups(count=' || len(vs) || ')' END, CASE WHEN bad THEN 'overlapping_invalid_stint' END], lambda x: x IS NOT NULL), coalesce(issues, [])) AS issues FROM q LEFT JOIN met_{name} m ON q.g = m.g AND q.num = m.num)"""


_LINEUPS = """hid AS "homeLineupId", vid AS "awayLineupId", CAST(len(issues) = 0 AS INTEGER) AS "lineupValidFlag", CASE WHEN len(issues) > 0 THEN array_to_string(issues, ' | ') END AS "lineupIssue" """

POSSESSION_ROWS = f"""
WITH {EVENTS}, {STINTS}, {POSSESSIONS}, {stamped("read", "stints")}
SELECT g AS "gameId", num AS "possessionNumber", CAST(inp AS INTEGER) AS "possessionNumberInPeriod", p AS period, f.o AS "startOrderNumber", z.o AS "endOrderNumber", f.o AS "startActionNumber", z.o AS "endActionNumber", clock0 AS "startClock", z.clock AS "endClock", CAST(greatest(secs0 - z.secs, 0) AS DOUBLE) AS "secondsElapsed",
  CAST(off AS BIGINT) AS "offenseTeamId", CAST(300 - off AS BIGINT) AS "defenseTeamId", CASE off WHEN 100 THEN 'h' ELSE 'v' END AS "offenseHomeAway", CAST(sign * (h0 - a0) AS BIGINT) AS "startScoreMargin", CAST(sign * (z.home - z.away) AS BIGINT) AS "endScoreMargin", CAST(CASE off WHEN 100 THEN z.home - h0 ELSE z.away - a0 END AS BIGINT) AS "pointsScoredOnPossession",
  CASE WHEN pl IS NULL THEN 'off_deadball' WHEN timeout OR before THEN 'off_timeout' WHEN pl.hit THEN 'off_ft_make' WHEN pl.made THEN CASE pl.val WHEN 3 THEN 'off_3pt_make' ELSE 'off_2pt_make' END WHEN pl.tov THEN CASE WHEN pl.e % 2 = 0 THEN 'off_live_ball_turnover' ELSE 'off_deadball' END WHEN pl.reb THEN 'off_2pt_miss' ELSE 'off_deadball' END AS "possessionStartType",
  CASE WHEN z.made THEN 'made_shot' WHEN z.tov THEN 'turnover' WHEN z.reb THEN CASE WHEN z.dreb THEN 'def_rebound' ELSE 'rebound' END WHEN z.ft THEN 'free_throw' ELSE z.reason END AS "possessionEndType", z.reason AS "possessionBoundaryReason", timeout AS "possessionHasTimeout", before AS "previousPossessionHasTimeout", again AS "isSecondChancePossession", penalty AS "isPenaltyPossession",
  z.counts AS "countsAsPossession", pnum AS "previousPossessionNumber", nnum AS "nextPossessionNumber", fga AS "fieldGoalAttempts", fgm AS "madeFieldGoals", fta AS "freeThrowAttempts", tov AS turnovers, oreb AS "offensiveRebounds", {_LINEUPS} FROM poss_read
"""

POSSESSION_REPAIRED = f"""
WITH {EVENTS}, {STINTS}, {POSSESSIONS}, {stamped("fixed", "effective")}
SELECT g AS "gameId", num AS "possessionNumber", p AS period, {_LINEUPS} FROM poss_fixed WHERE g IN (SELECT g FROM repaired)
"""

TEAMS = "games AS (SELECT DISTINCT g FROM ev), pairs AS (SELECT g, unnest([100, 200]) AS team FROM games)"

TEAM_POSSESSIONS = f"""
WITH {EVENTS}, {STINTS}, {POSSESSIONS}, {TEAMS},
counted_sides AS (SELECT g, off, CASE off WHEN 100 THEN z.home - h0 ELSE z.away - a0 END AS pts FROM q WHERE z.counts),
sums AS (SELECT g, team, count(*) FILTER (off = team) AS o, count(*) FILTER (off <> team) AS d, sum(CASE WHEN off = team THEN pts ELSE 0 END) AS f, sum(CASE WHEN off <> team THEN pts ELSE 0 END) AS a FROM counted_sides, (VALUES (100), (200)) t(team) GROUP BY ALL)
SELECT x.g AS "gameId", CAST(x.team AS BIGINT) AS "teamId", CASE WHEN s.g IS NULL THEN 'missing' WHEN x.g IN (SELECT g FROM repaired) THEN 'ot_fallback' ELSE 'exact' END AS method, CAST(coalesce(o, 0) AS DOUBLE) AS offensive_possessions, CAST(coalesce(d, 0) AS DOUBLE) AS defensive_possessions, CAST(coalesce(f, 0) AS DOUBLE) AS points_for, CAST(coalesce(a, 0) AS DOUBLE) AS points_against FROM pairs x LEFT JOIN sums s ON x.g = s.g AND x.team = s.team
"""

TEAM_DEFENSIVE_SHOTS = f"""
WITH {EVENTS}, {TEAMS}, twos AS (SELECT g, 300 - off AS team, count(*) AS n FROM ev WHERE val = 2 GROUP BY ALL)
SELECT x.g AS "gameId", CAST(x.team AS BIGINT) AS "teamId", CASE WHEN x.g IN (SELECT g FROM twos) THEN 'exact' ELSE 'boxscore_estimated' END AS method, CAST(coalesce(n, 0) AS DOUBLE) AS opponent_two_point_attempts FROM pairs x LEFT JOIN twos t ON x.g = t.g AND x.team = t.team
"""

# the box score: eight players a team, with minutes and sums of their events and of both teams
BOX = """
box AS (SELECT g, team, team + i AS person, 2880 - i * 200 AS secs FROM pairs, range(8) r(i)),
own AS (SELECT g, person, count(*) FILTER (goal) AS fga, count(*) FILTER (ft) AS fta, count(*) FILTER (made) AS fgm, count(*) FILTER (tov) AS tov FROM ev GROUP BY ALL),
sums AS (SELECT g, team, count(*) FILTER (goal) AS fga, count(*) FILTER (ft) AS fta, count(*) FILTER (oreb) AS oreb, count(*) FILTER (tov) AS tov, count(*) FILTER (val = 3) AS fg3a, count(*) FILTER (made) AS fgm, count(*) FILTER (made AND val = 3) AS fg3m, count(*) FILTER (reb) AS reb, max(CASE team WHEN 100 THEN home ELSE away END) AS pts FROM ev GROUP BY ALL),
duo AS (SELECT a.*, b AS o FROM sums a JOIN sums b ON a.g = b.g AND a.team <> b.team),
played AS (SELECT x.*, coalesce(w.fga, 0) AS fga, coalesce(w.fta, 0) AS fta, coalesce(w.fgm, 0) AS fgm, coalesce(w.tov, 0) AS tov, x.secs / (14400 / 5.0) AS share FROM box x LEFT JOIN own w ON x.g = w.g AND x.person = w.person)
"""


def from_possessions(name: str) -> str:
    """Sums of counted possessions for each player on court, in games whose every counted possession has both lineups."""
    return f"""
whole_{name} AS (SELECT g FROM poss_{name} WHERE z.counts GROUP BY g HAVING bool_and(hid IS NOT NULL AND vid IS NOT NULL)),
on_{name} AS (SELECT g, off, CASE off WHEN 100 THEN z.home - h0 ELSE z.away - a0 END AS pts, unnest(string_split(hid || '-' || vid, '-'))::BIGINT AS person FROM poss_{name} WHERE z.counts AND g IN (FROM whole_{name})),
sum_{name} AS (SELECT g, person, count(*) FILTER (person // 100 * 100 = off) AS o, count(*) FILTER (person // 100 * 100 <> off) AS d, sum(CASE WHEN person // 100 * 100 = off THEN pts ELSE 0 END) AS f, sum(CASE WHEN person // 100 * 100 <> off THEN pts ELSE 0 END) AS a FROM on_{name} GROUP BY ALL),
used_{name} AS (SELECT g, used, count(*) AS u FROM (SELECT g, CASE WHEN z.tov OR z.made OR z.ft THEN CASE WHEN z.team = off THEN z.person END WHEN z.dreb AND z.shot_team = off THEN z.shot_person END AS used FROM poss_{name} WHERE z.counts) WHERE used IS NOT NULL GROUP BY ALL)"""


PLAYER_POSSESSIONS = f"""
WITH {EVENTS}, {STINTS}, {POSSESSIONS}, {stamped("read", "stints")}, {stamped("all", "effective")}, poss_fixed AS (SELECT * FROM poss_all WHERE g IN (SELECT g FROM repaired)), {TEAMS}, {BOX}, {from_possessions("read")}, {from_possessions("fixed")},
needed AS (SELECT g, p, o, off, counts AND ended AS counts, greatest(home - home0, 0) AS ph, greatest(away - away0, 0) AS pa FROM ev WHERE home > home0 OR away > away0 OR ended),
placed AS (SELECT n.*, s.hl, s.al FROM needed n LEFT JOIN effective s ON n.g = s.g AND n.p = s.p AND n.o >= s.s AND n.o < s.t),
whole_seen AS (SELECT g FROM placed GROUP BY g HAVING bool_and(hl IS NOT NULL AND al IS NOT NULL)),
on_seen AS (SELECT *, unnest(list_concat(hl, al)) AS person FROM placed WHERE g IN (FROM whole_seen)),
sum_seen AS (SELECT g, person, count(*) FILTER (counts AND person // 100 * 100 = off) AS o, count(*) FILTER (counts AND person // 100 * 100 <> off) AS d, sum(CASE WHEN person < 200 THEN ph ELSE pa END) AS f, sum(CASE WHEN person < 200 THEN pa ELSE ph END) AS a FROM on_seen GROUP BY ALL),
used_seen AS (SELECT g, person, count(*) AS u FROM ev WHERE tov OR made GROUP BY ALL),
v AS (SELECT x.*, CASE WHEN x.g IN (FROM whole_read) THEN 'exact' WHEN x.g IN (FROM whole_fixed) THEN 'ot_fallback' WHEN x.g IN (FROM whole_seen) THEN 'event_estimated' WHEN b.g IS NOT NULL THEN 'boxscore_estimated' ELSE 'missing' END AS method, 0.5 * (b.fga + 0.44 * b.fta - b.oreb + b.tov + (b.o.fga + 0.44 * b.o.fta - b.o.oreb + b.o.tov)) AS est, b.pts, b.o.pts AS opts FROM played x LEFT JOIN duo b ON x.g = b.g AND x.team = b.team),
r AS (SELECT v.g, v.person, method, CASE method WHEN 'exact' THEN coalesce(r.o, 0) WHEN 'ot_fallback' THEN coalesce(k.o, 0) WHEN 'event_estimated' THEN coalesce(s.o, 0) WHEN 'missing' THEN 0 ELSE share * est END AS o, CASE method WHEN 'exact' THEN coalesce(r.d, 0) WHEN 'ot_fallback' THEN coalesce(k.d, 0) WHEN 'event_estimated' THEN coalesce(s.d, 0) WHEN 'missing' THEN 0 ELSE share * est END AS d,
  CASE method WHEN 'exact' THEN coalesce(ur.u, 0) WHEN 'ot_fallback' THEN coalesce(uk.u, 0) WHEN 'event_estimated' THEN coalesce(us.u, 0) WHEN 'missing' THEN 0 ELSE fga + 0.44 * fta + tov END AS u, CASE method WHEN 'exact' THEN coalesce(r.f, 0) WHEN 'ot_fallback' THEN coalesce(k.f, 0) WHEN 'event_estimated' THEN coalesce(s.f, 0) WHEN 'missing' THEN 0 ELSE share * pts END AS f, CASE method WHEN 'exact' THEN coalesce(r.a, 0) WHEN 'ot_fallback' THEN coalesce(k.a, 0) WHEN 'event_estimated' THEN coalesce(s.a, 0) WHEN 'missing' THEN 0 ELSE share * opts END AS a
  FROM v LEFT JOIN sum_read r ON v.g = r.g AND v.person = r.person LEFT JOIN sum_fixed k ON v.g = k.g AND v.person = k.person LEFT JOIN sum_seen s ON v.g = s.g AND v.person = s.person LEFT JOIN used_read ur ON v.g = ur.g AND v.person = ur.used LEFT JOIN used_fixed uk ON v.g = uk.g AND v.person = uk.used LEFT JOIN used_seen us ON v.g = us.g AND v.person = us.person)
SELECT g AS "gameId", CAST(person AS BIGINT) AS "personId", method, CAST(o AS DOUBLE) AS offensive_possessions, CAST(d AS DOUBLE) AS defensive_possessions, CAST(u AS DOUBLE) AS used_offensive_possessions, CAST(f AS DOUBLE) AS points_for, CAST(a AS DOUBLE) AS points_against, CAST(method = 'exact' AS INTEGER) AS exact_game_flag, CAST(method = 'ot_fallback' AS INTEGER) AS ot_fallback_game_flag, CAST(method = 'event_estimated' AS INTEGER) AS event_estimated_game_flag,
  CAST(method = 'boxscore_estimated' AS INTEGER) AS boxscore_estimated_game_flag, CAST(method = 'missing' AS INTEGER) AS missing_game_flag, CAST(CASE WHEN method = 'exact' THEN o + d ELSE 0 END AS DOUBLE) AS exact_possessions_count, CAST(CASE WHEN method = 'ot_fallback' THEN o + d ELSE 0 END AS DOUBLE) AS ot_fallback_possessions_count, CAST(CASE WHEN method = 'event_estimated' THEN o + d ELSE 0 END AS DOUBLE) AS event_estimated_possessions_count,
  CAST(CASE WHEN method = 'boxscore_estimated' THEN o + d ELSE 0 END AS DOUBLE) AS boxscore_estimated_possessions_count, CAST(o + d AS DOUBLE) AS total_possessions, CAST(row_number() OVER (PARTITION BY g ORDER BY person) AS INTEGER) AS row_in_game FROM r
"""


def context(name: str, stints: str) -> str:
    """For the three contexts by a table of stints: games in which each of their events has its fives, and players' sums."""
    return f"""
at_{name} AS (SELECT e.g, e.team, e.person AS own, val = 2 AS two, made, reb, hl, al FROM ev e LEFT JOIN {stints} s ON e.g = s.g AND e.p = s.p AND e.o >= s.s AND e.o < s.t),
ok_{name} AS (SELECT g, NOT coalesce(bool_or(hl IS NULL AND two), false) AS shots, NOT coalesce(bool_or(hl IS NULL AND made), false) AS assists, NOT coalesce(bool_or(hl IS NULL AND reb), false) AS rebounds FROM at_{name} GROUP BY g),
seen_{name} AS (SELECT *, unnest(list_concat(hl, al)) AS person FROM at_{name} WHERE hl IS NOT NULL AND (two OR made OR reb)),
sum_{name} AS (SELECT g, person, count(*) FILTER (two AND person // 100 * 100 <> team) AS twos, count(*) FILTER (two AND made AND person // 100 * 100 <> team) AS twos_made, count(*) FILTER (made AND person // 100 * 100 = team AND person <> own) AS mates, count(*) FILTER (reb AND person // 100 * 100 = team) AS ours, count(*) FILTER (reb AND person // 100 * 100 <> team) AS theirs FROM seen_{name} GROUP BY ALL)"""


ON_COURT_CONTEXTS = f"""
WITH {EVENTS}, {STINTS}, {TEAMS}, {BOX}, {context("read", "stints")}, {context("fixed", "effective")},
v AS (SELECT x.*, k.shots AS s1, k.assists AS a1, k.rebounds AS r1, n.shots AS s2, n.assists AS a2, n.rebounds AS r2, duo.g IS NOT NULL AS boxed, y AS y1, z AS y2, duo.fgm AS bfgm, duo.reb AS breb, duo.o.reb AS boreb, greatest(duo.o.fga - duo.o.fg3a, 0) AS btwos, greatest(duo.o.fgm - duo.o.fg3m, 0) AS btwos_made
  FROM played x JOIN ok_read k ON x.g = k.g JOIN ok_fixed n ON x.g = n.g LEFT JOIN sum_read y ON x.g = y.g AND x.person = y.person LEFT JOIN sum_fixed z ON x.g = z.g AND x.person = z.person LEFT JOIN duo ON x.g = duo.g AND x.team = duo.team)
SELECT g AS "gameId", CAST(person AS BIGINT) AS "personId", CASE WHEN s1 THEN 'exact' WHEN s2 THEN 'event_estimated' WHEN boxed THEN 'boxscore_estimated' ELSE 'missing' END AS defensive_shot_method,
  CAST(CASE WHEN s1 THEN coalesce(y1.twos, 0) WHEN s2 THEN coalesce(y2.twos, 0) WHEN boxed THEN share * btwos ELSE 0 END AS DOUBLE) AS opponent_two_point_attempts, CAST(CASE WHEN s1 THEN coalesce(y1.twos_made, 0) WHEN s2 THEN coalesce(y2.twos_made, 0) WHEN boxed THEN share * btwos_made ELSE 0 END AS DOUBLE) AS opponent_two_point_makes,
  CASE WHEN a1 THEN 'exact' WHEN a2 THEN 'event_estimated' WHEN boxed THEN 'boxscore_estimated' ELSE 'missing' END AS assist_method, CAST(CASE WHEN a1 THEN coalesce(y1.mates, 0) WHEN a2 THEN coalesce(y2.mates, 0) WHEN boxed THEN greatest(share * bfgm - fgm, 0) ELSE 0 END AS DOUBLE) AS teammate_field_goals_made,
  CASE WHEN r1 THEN 'exact' WHEN r2 THEN 'event_estimated' WHEN boxed THEN 'boxscore_estimated' ELSE 'missing' END AS rebound_method, CAST(CASE WHEN r1 THEN coalesce(y1.ours, 0) WHEN r2 THEN coalesce(y2.ours, 0) WHEN boxed THEN share * breb ELSE 0 END AS DOUBLE) AS own_rebounds_on_court, CAST(CASE WHEN r1 THEN coalesce(y1.theirs, 0) WHEN r2 THEN coalesce(y2.theirs, 0) WHEN boxed THEN share * boreb ELSE 0 END AS DOUBLE) AS other_rebounds_on_court,
  CAST(CASE WHEN r1 THEN coalesce(y1.ours + y1.theirs, 0) WHEN r2 THEN coalesce(y2.ours + y2.theirs, 0) WHEN boxed THEN share * (breb + boreb) ELSE 0 END AS DOUBLE) AS rebound_opportunities FROM v
"""

SEASON_PERCENTILES = f"""
WITH x AS (SELECT "personId", sum(total_possessions) AS possessions, sum(points_for) AS points, count(*) AS games FROM ({PLAYER_POSSESSIONS}) GROUP BY 1),
r AS (SELECT *, count(*) OVER (ORDER BY round(possessions, 6)) AS a, count(*) OVER () AS n, count(CASE WHEN games > 1 THEN 1 END) OVER (ORDER BY CASE WHEN games > 1 THEN round(points, 6) END NULLS LAST) AS b, count(CASE WHEN games > 1 THEN 1 END) OVER () AS m FROM x)
SELECT "personId", 'all' AS season, round(possessions, 6) AS possessions, round(points, 6) AS points, games, CAST(round_even(100.0 * (a - 1) / (n - 1), 0) AS INTEGER) AS possessions_percentile, CASE WHEN games > 1 THEN CAST(round_even(100.0 * (b - 1) / (m - 1), 0) AS INTEGER) END AS points_percentile FROM r
"""

EVENT_CONTEXT = f"""
WITH {EVENTS}, {STINTS},
x AS (SELECT e.*, array_to_string(hl, '-') AS hid, array_to_string(al, '-') AS vid FROM ev e LEFT JOIN effective s ON e.g = s.g AND e.p = s.p AND e.o >= s.s AND e.o < s.t),
y AS (SELECT *, [greatest(CASE WHEN capped THEN least(greatest(CASE WHEN p <= 4 THEN 4 ELSE 3 END - es[i], 0), 1) ELSE greatest(CASE WHEN p <= 4 THEN 4 ELSE 3 END - es[i], 0) END - ls[i], 0) FOR i IN [1, 2]] AS give FROM (SELECT *, [count(*) FILTER (foul AND NOT capped AND team = 100) OVER w, count(*) FILTER (foul AND NOT capped AND team = 200) OVER w] AS es, [count(*) FILTER (foul AND capped AND team = 100) OVER w, count(*) FILTER (foul AND capped AND team = 200) OVER w] AS ls FROM x WINDOW w AS (PARTITION BY g, p ORDER BY o)))
SELECT g AS game_id, o AS event_num, CAST(100 AS BIGINT) AS home_team_id, CAST(200 AS BIGINT) AS away_team_id, hid AS home_lineup_id, vid AS away_lineup_id, CASE WHEN hid IS NOT NULL THEN 5 END AS home_players, CAST(give[1] AS BIGINT) AS home_fouls_to_give, CAST(give[2] AS BIGINT) AS away_fouls_to_give, CASE WHEN rn = 1 THEN vid END AS away_starters FROM y
"""

CONTEXT_ISSUES = f"WITH {EVENTS}, {STINTS} SELECT 'lineup_id_mismatch' AS issue, count(*) AS n FROM ev e LEFT JOIN effective s ON e.g = s.g AND e.p = s.p AND e.o >= s.s AND e.o < s.t WHERE hl IS NULL HAVING count(*) > 0"

GAME_STATE = f"""
WITH {EVENTS}, t AS (SELECT DISTINCT g, [100, 200] AS teams FROM ev)
SELECT e.g AS "gameId", o AS "orderNumber", CAST(CASE WHEN dreb THEN coalesce(lag(off) OVER (PARTITION BY e.g ORDER BY p, o), off) ELSE off END AS BIGINT) AS "offenseOfRecord", CAST(sum(pts) OVER (PARTITION BY e.g, team ORDER BY p, o) AS BIGINT) AS "teamScore", CAST(count(*) FILTER (foul) OVER (PARTITION BY e.g, person ORDER BY p, o) AS BIGINT) AS "personFouls", array_to_string(teams, ',') AS "orderedTeamIds" FROM ev e JOIN t ON e.g = t.g
"""

BOX_CONTEXT = f"""
WITH {EVENTS}
SELECT g AS "gameId", o AS "orderNumber", CASE team WHEN 100 THEN 'h' ELSE 'v' END AS location, CASE team WHEN 100 THEN 'Hall' ELSE 'Vale' END AS "playerteamCity", CASE team WHEN 100 THEN 'Visitors' ELSE 'Homers' END AS "opponentteamName", CASE WHEN person % 100 < 7 THEN 'P ' || CASE WHEN person = 203 THEN 103 ELSE person END END AS "playerFullName",
  CAST(NULL AS VARCHAR) AS "stealFullName", CASE WHEN sub AND person % 100 < 7 AND person % 100 <> 3 THEN person END AS "subsInPersonId" FROM ev
"""
