"""Registered queries of facts, metrics, percentile tables, entities and rule sets, with the same in SQL.

A user's events are a game's shots, an order is a player's game. Column formulas that both engines have are written once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.functions import text
from scorebook.operators import dimensions, quality, ranking, semantic, shots
from scorebook.plans import catalog
from scorebook.plans.demo import tables
from scorebook.sources.stored import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(tables(spark, d), spark, d)
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def selected(columns: dict[str, str]) -> str:
    """A DuckDB select list of formulas in common SQL."""
    return ", ".join(f"{x} AS {c}" for c, x in columns.items()).replace("AS STRING", "AS VARCHAR")


def select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(x).alias(c) for c, x in columns.items()])


# ---------------------------------------------------------------- shots

AREAS = [*shots.SOURCE["area"], "Back Court"]
DETAILS = [*shots.SOURCE["area_detail"], ""]
BUCKETS = [*shots.STANDARD["shot_type"], "Heave"]
_nth = lambda labels: "CASE event_id % " + str(len(labels)) + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(labels)) + " END"
SHOTS = {
    "game_id": "lpad(CAST(user_id AS STRING), 10, '0')", "person_id": "event_id % 8", "is_field_goal": "event_type IN ('click', 'purchase')", "is_made": "value > 9", "shot_value": "CASE event_type WHEN 'purchase' THEN 3 ELSE 2 END",
    "shot_type": _nth(BUCKETS), "area": _nth(AREAS), "area_detail": _nth(DETAILS), "action_type": "CASE WHEN event_id % 10 > 0 THEN '2pt' END", "sub_type": "CASE event_id % 4 WHEN 0 THEN ' jump  shot ' WHEN 1 THEN 'DUNK' WHEN 2 THEN 'tip in' ELSE 'Hook' END",
    "descriptor": "CASE event_id % 3 WHEN 0 THEN 'pull up' WHEN 1 THEN ' ' END",
}
PLAYERS = f"(SELECT DISTINCT lpad(CAST(user_id AS VARCHAR), 10, '0') AS game_id, p AS person_id, 100 + p % 2 * 100 AS team_id, CAST(p < 7 AS INTEGER) AS did_play FROM events, range(9) r(p))"
SHOT_ROWS = f"(SELECT * FROM (SELECT {selected(SHOTS)} FROM events) WHERE is_field_goal AND person_id > 0)"
TOTALS = "count(*) AS field_goals_attempted, count(*) FILTER (is_made) AS field_goals_made, count(*) FILTER (shot_value = 3) AS three_pointers_attempted, count(*) FILTER (is_made AND shot_value = 3) AS three_pointers_made, CAST(coalesce(sum(shot_value) FILTER (is_made), 0) AS BIGINT) AS points_from_field_goals"


def shot_tables(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    games = t["events"].select(F.lpad(F.col("user_id").cast("string"), 10, "0").alias("game_id")).distinct()
    p = F.col("person_id")
    players = games.withColumn("person_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long")))).withColumns({"team_id": 100 + p % 2 * 100, "did_play": (p < 7).cast("int")})
    teams = games.select("game_id", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("team_id"), F.lit(b).cast("long").alias("opponent_team_id")) for a, b in ((100, 200), (200, 100))])).alias("x")).select("game_id", "x.*")
    return players, teams, select(t["events"], SHOTS)


def profile_sql(scheme: dict[str, dict[str, str]]) -> str:
    sums, names = [TOTALS], ["field_goals_attempted", "field_goals_made", "three_pointers_attempted", "three_pointers_made", "points_from_field_goals"]
    for label, buckets in scheme.items():
        tests = {p: f"{label} = '{x}'" for x, p in buckets.items()} | ({shots.UNMAPPED[label]: "coalesce({} NOT IN ({}), true)".format(label, ", ".join(f"'{x}'" for x in buckets))} if label in shots.UNMAPPED else {})
        for p, test in tests.items():
            sums += [f"count(*) FILTER ({test}) AS {p}_field_goals_attempted", f"count(*) FILTER ({test} AND is_made) AS {p}_field_goals_made"]
            names += [f"{p}_field_goals_attempted", f"{p}_field_goals_made"]
    picked = ", ".join(f"coalesce(s.{n}, 0) AS {n}" for n in names)
    return f"SELECT p.game_id, p.person_id, p.team_id, 300 - p.team_id AS opponent_team_id, {picked} FROM {PLAYERS} p LEFT JOIN (SELECT game_id, person_id, {', '.join(sums)} FROM {SHOT_ROWS} GROUP BY ALL) s ON p.game_id = s.game_id AND p.person_id = s.person_id WHERE did_play = 1"


@query(profile_sql(shots.STANDARD))
def shot_profiles_standard(t, spark, d):
    """Shot profiles in the standard buckets."""
    return shots.shot_profiles(*shot_tables(t), shots.STANDARD)


@query(profile_sql(shots.SOURCE))
def shot_profiles_source(t, spark, d):
    """Shot profiles in the source's areas and their details."""
    return shots.shot_profiles(*shot_tables(t), shots.SOURCE)


@query(f"""SELECT 'area' AS "column", area AS label, count(*) AS n FROM {SHOT_ROWS} WHERE area = 'Back Court' GROUP BY ALL""")
def shot_unknown_labels(t, spark, d):
    """Labels that no bucket of the source's scheme has."""
    return shots.unknown_labels(shot_tables(t)[2], shots.SOURCE)


TYPES = f"""
(WITH s AS (SELECT *, regexp_replace(trim(action_type), '\\s+', ' ', 'g') AS a, regexp_replace(trim(sub_type), '\\s+', ' ', 'g') AS b, nullif(regexp_replace(trim(descriptor), '\\s+', ' ', 'g'), '') AS c FROM {SHOT_ROWS} WHERE action_type IS NOT NULL),
g AS (SELECT game_id, person_id, a, b, c, shot_value, {TOTALS} FROM s GROUP BY ALL),
f AS (SELECT *, CASE b WHEN 'jump shot' THEN 'Jump Shot' WHEN 'DUNK' THEN 'Dunk' WHEN 'tip in' THEN 'Tip In' ELSE 'Hook' END AS family FROM g)
SELECT f.*, p.team_id, 300 - p.team_id AS opponent_team_id, concat_ws('|', a, b, coalesce(c, ''), shot_value) AS shot_key, shot_value || 'PT ' || CASE WHEN c IS NOT NULL THEN 'Pull Up ' ELSE '' END || family || CASE WHEN family = 'Jump Shot' THEN '' ELSE ' Shot' END AS label FROM f JOIN {PLAYERS} p ON f.game_id = p.game_id AND f.person_id = p.person_id)
"""


@query(f"SELECT game_id, person_id, team_id, opponent_team_id, a AS action_type, b AS sub_type, c AS descriptor, shot_value, shot_key AS source_shot_type_key, label AS source_shot_type_label, family AS source_shot_type_family, CAST(shot_value = 2 AS INTEGER) AS is_two_point_shot, CAST(shot_value = 3 AS INTEGER) AS is_three_point_shot, field_goals_attempted, field_goals_made, three_pointers_attempted, three_pointers_made, points_from_field_goals FROM {TYPES}")
def shot_types(t, spark, d):
    """Facts by game, player and shot type."""
    return shots.shot_types(*shot_tables(t))


@query(f"SELECT game_id, person_id AS player_id, CASE WHEN person_id < 5 THEN 'Player ' || person_id ELSE '' END AS player_name, CASE team_id WHEN 100 THEN 'HOM' ELSE 'AWY' END AS team, CASE team_id WHEN 100 THEN 'AWY' ELSE 'HOM' END AS opponent, CASE team_id WHEN 100 THEN 'Home' ELSE 'Away' END AS home_away, shot_key AS shot_type_key, label AS shot_type, family AS shot_family, field_goals_attempted, points_from_field_goals FROM {TYPES}")
def shot_type_view(t, spark, d):
    """The reporting view of shot types."""
    players, teams, rows = shot_tables(t)
    games = players.select("game_id", F.lit(100).alias("home_team_id"), F.lit("HOM").alias("home_team_abbreviation"), F.lit("AWY").alias("away_team_abbreviation")).distinct()
    p = F.col("person_id")
    people = players.select("person_id").distinct().withColumns({"display_name": F.when(p % 2 == 0, F.concat(F.lit("Player "), p.cast("string"))), "player_name": F.concat(F.lit("Player "), p.cast("string")), "is_current": (p < 5).cast("int")})
    out = shots.shot_type_view(shots.shot_types(players, teams, rows), games, people.unionByName(people.withColumns({"display_name": F.lit("old"), "is_current": F.lit(0)})))
    return out.select("game_id", "player_id", "player_name", "team", "opponent", "home_away", "shot_type_key", "shot_type", "shot_family", "field_goals_attempted", "points_from_field_goals")


# ---------------------------------------------------------------- metrics and percentiles

GAME = {
    "person_id": "o_custkey", "win_loss_result": "CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' END", "is_starter": "o_orderkey % 3 = 0", "seconds_played": "o_orderkey % 9 * 300", "points": "o_orderkey % 31", "opponent_points": "o_orderkey % 29",
    "points_for": "o_orderkey % 31 + 60", "points_against": "o_orderkey % 37 + 60", "offensive_possessions": "o_orderkey % 20 + 50", "defensive_possessions": "o_orderkey % 13 + 50",
} | {f"{p}{c}": f"o_orderkey % {n + len(p)} + {20 if c.startswith('field_goals') else 0}" for n, c in enumerate(("assists", "turnovers", "rebounds", "offensive_rebounds", "defensive_rebounds", "steals", "field_goals_made", "field_goals_attempted", "three_pointers_made", "three_pointers_attempted", "free_throws_made", "free_throws_attempted"), 4) for p in ("", "opponent_")}
GAMES = f"(SELECT {selected(GAME)} FROM orders)"


def metric_sql(metrics: dict[str, catalog.MetricDef]) -> str:
    """The metrics' formulas in DuckDB's SQL, written from their definitions by hand for each form."""
    div = lambda a, b, k="", digits=1: f"round({k}({a}) / CAST(nullif({b}, 0) AS DOUBLE), {digits})"
    s, poss = (lambda c: f"sum({c})"), "sum((offensive_possessions + defensive_possessions) / 2)"
    forms = {
        "games_won": "count(*) FILTER (win_loss_result = 'win')", "games_lost": "count(*) FILTER (win_loss_result = 'loss')", "games_started": "count(*) FILTER (is_starter)", "assist_turnover_ratio": div(s("assists"), s("turnovers"), digits=2), "total_possessions": poss,
        "average_possessions": "round(avg((offensive_possessions + defensive_possessions) / 2), 1)", "steal_percentage": div(s("steals"), s("defensive_possessions"), "100 * "), "average_point_differential": "round(avg(points - opponent_points), 1)",
        "offensive_rating": div(s("points"), s("offensive_possessions"), "100 * "), "defensive_rating": div(s("opponent_points"), s("defensive_possessions"), "100 * "), "assist_percentage": div(s("assists"), s("field_goals_made"), "100 * "),
    }
    forms |= {"wins": forms["games_won"], "losses": forms["games_lost"]}
    team = "wins" in metrics
    a, b = ("points", "opponent_points") if team else ("points_for", "points_against")
    forms["pace"] = div(f"{240 if team else 48} * {poss}", "sum(seconds_played) / 60")
    forms["net_rating"] = f"round(100 * sum({a}) / CAST(nullif(sum(offensive_possessions), 0) AS DOUBLE) - 100 * sum({b}) / CAST(nullif(sum(defensive_possessions), 0) AS DOUBLE), 1)"
    for name, own, other in (("offensive_rebound_percentage", "offensive_rebounds", "opponent_defensive_rebounds"), ("defensive_rebound_percentage", "defensive_rebounds", "opponent_offensive_rebounds"), ("rebound_percentage", "rebounds", "opponent_rebounds")):
        forms[name] = div(s(own), f"sum({own}) + sum({other})", "100 * ")
    for p in ("", "opponent_"):
        m, t3, t, f = (f"sum({p}{c})" for c in ("field_goals_made", "three_pointers_made", "field_goals_attempted", "free_throws_attempted"))
        a3 = f"sum({p}three_pointers_attempted)"
        forms |= {
            f"{p}field_goal_percentage": div(m, t, "100 * "), f"{p}two_point_percentage": div(f"{m} - {t3}", f"({t} - {a3})", "100 * "), f"{p}three_point_percentage": div(t3, a3, "100 * "), f"{p}free_throw_percentage": div(f"sum({p}free_throws_made)", f, "100 * "),
            f"{p}effective_field_goal_percentage": div(f"{m} + 0.5 * {t3}", t, "100 * "), f"{p}true_shooting_percentage": div(f"sum({p}points)", f"2 * ({t} + 0.44 * {f})", "100 * "), f"{p}three_point_attempt_rate": div(a3, t, digits=3), f"{p}free_throw_attempt_rate": div(f, t, digits=3),
        }
    kinds = {"count_win": "BIGINT", "count_loss": "BIGINT", "count_true": "BIGINT"}
    return f"SELECT person_id, {', '.join(f'CAST({forms[n]} AS {kinds.get(m.agg, 'DOUBLE')}) AS {n}' for n, m in metrics.items())} FROM {GAMES} GROUP BY person_id"


def measured(t, metrics: dict[str, catalog.MetricDef]) -> DataFrame:
    kinds = {"count_win": "long", "count_loss": "long", "count_true": "long"}
    return select(t["orders"], GAME).groupBy("person_id").agg(*[m.column().cast(kinds.get(m.agg, "double")).alias(n) for n, m in metrics.items()])


@query(metric_sql(catalog.player_game_metrics()))
def player_metrics(t, spark, d):
    """All metrics of player games beyond totals and averages (Q16)."""
    return measured(t, catalog.player_game_metrics())


@query(metric_sql(catalog.team_game_metrics()))
def team_metrics(t, spark, d):
    """All metrics of team games, for both sides (Q17)."""
    return measured(t, catalog.team_game_metrics())


SEASON = {"games_played": "count(*)", "wins": "sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)", "losses": "sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)"} | {f"{c}_total": f"sum(o_orderkey % {n})" for n, c in enumerate(catalog.COUNTING, 5)}
SEASONS = f"(SELECT o_custkey, {selected({c: f'CAST({x} AS BIGINT)' for c, x in SEASON.items()})} FROM orders GROUP BY o_custkey)"


def derived_sql(team: bool) -> str:
    games = "(wins + losses)" if team else "games_played"
    share = lambda a, b: f"round(100 * (({a}) / CAST(nullif({b}, 0) AS DOUBLE)), 1)"
    made, tried, free = "field_goals_made_total", "field_goals_attempted_total", "free_throws_attempted_total"
    forms = {f"{c}_per_game": f"CASE WHEN {games} > 0 THEN CASE WHEN {c}_total * 10 % {games} * 2 = {games} THEN round_even({c}_total / {games}, 1) ELSE round({c}_total / {games}, 1) END END" for c in catalog.COUNTING} | {
        "field_goal_percentage": share(made, tried), "three_point_percentage": share("three_pointers_made_total", "three_pointers_attempted_total"), "free_throw_percentage": share("free_throws_made_total", free),
        "effective_field_goal_percentage": share(f"{made} + 0.5 * three_pointers_made_total", tried), "true_shooting_percentage": share("points_total", f"2 * ({tried} + 0.44 * {free})"),
    } | ({"win_percentage": share("wins", "wins + losses")} if team else {})
    return f"SELECT o_custkey, {', '.join(f'CAST({x} AS DOUBLE) AS {n}' for n, x in forms.items())} FROM {SEASONS}"


def season_rows(t) -> DataFrame:
    return t["orders"].groupBy("o_custkey").agg(*[F.expr(x).cast("long").alias(c) for c, x in SEASON.items()])


def derived(t, team: bool) -> DataFrame:
    return season_rows(t).select("o_custkey", *[F.expr(m.expr).cast("double").alias(n) for n, m in catalog.season_derived_metrics(team).items()])


@query(derived_sql(False))
def player_season_metrics(t, spark, d):
    """Per-game metrics and percentages over a player's season totals (Q18)."""
    return derived(t, False)


@query(derived_sql(True))
def team_season_metrics(t, spark, d):
    """The same over a team's season (Q18)."""
    return derived(t, True)


@query("SELECT o_custkey, " + ", ".join(f"{c}_total * 2160.0 / nullif(seconds_played_total, 0) AS {c}_per_36" for c in catalog.COUNTING if c != "seconds_played") + f" FROM {SEASONS}")
def per_minutes(t, spark, d):
    """Rates per 36 minutes of every total (Q19)."""
    rows = season_rows(t)
    return rows.select("o_custkey", *[v.alias(k) for k, v in catalog.per_minutes_columns(rows.columns, 36).items()])


RANKED = {"games_played": "count(*)", "seconds_played_total": "count(*) * 900", "field_goals_attempted_total": "sum(o_orderkey % 7)", "three_pointers_attempted_total": "sum(o_orderkey % 3)", "free_throws_attempted_total": "sum(o_orderkey % 5)"}


def ranked_season(metrics) -> dict[str, str]:
    return RANKED | {m: f"sum(o_orderkey % {n}) - {n}" for n, m in enumerate(metrics, 11) if m not in RANKED}


def percentile_sql(row_id: str, specs: list[tuple[str, str]], season: dict[str, str]) -> str:
    v = lambda m, ok: f"CASE WHEN {ok} THEN {'-' if m in ranking.LESS_IS_BETTER else ''}{m} END"
    counts = ", ".join(f"count({v(m, ok)}) OVER (w ORDER BY {v(m, ok)} NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r{i}, count({v(m, ok)}) OVER w AS n{i}, {ok} AS ok{i}" for i, (m, ok) in enumerate(specs))
    kind = row_id.split("_")[0].replace("person", "player")
    out = ", ".join(f"CAST(CASE WHEN ok{i} THEN CASE WHEN n{i} = 1 THEN 100 ELSE round_even(100.0 * (r{i} - 1) / (n{i} - 1), 0) END END AS BIGINT) AS {m}_percentile" for i, (m, _) in enumerate(specs))
    label = "CAST(2020 + o_custkey % 3 AS VARCHAR) || '-2' || (1 + o_custkey % 3)"
    key = f"row_number() OVER (ORDER BY {row_id}, season_year[1:4], raw_season_type_code) AS {kind}_season_percentiles_sk, {row_id} * 10 AS current_{kind}_sk, CAST(season_year[1:4] AS BIGINT) AS season_start_year, 'Regular Season' AS season_type, 'orders' AS record_source"
    return f"SELECT {row_id}, season_year, raw_season_type_code, {key}, {out} FROM (SELECT *, {counts} FROM (SELECT o_custkey AS {row_id}, {label} AS season_year, '2' AS raw_season_type_code, {selected(season)} FROM orders GROUP BY o_custkey) WINDOW w AS (PARTITION BY season_year, raw_season_type_code))"


def ranked_rows(t, row_id: str, season: dict[str, str]) -> DataFrame:
    rows = t["orders"].groupBy(F.col("o_custkey").alias(row_id)).agg(*[F.expr(x).alias(c) for c, x in season.items()])
    kind = "player" if row_id == "person_id" else "team"
    start = F.lit(2020) + F.col(row_id) % 3
    return rows.withColumns({"season_year": F.concat(start.cast("string"), F.lit("-2"), (start - 2019).cast("string")), "raw_season_type_code": F.lit("2"), f"current_{kind}_sk": F.col(row_id) * 10, "season_type": F.lit("Regular Season")})


_OK = {"games": "games_played >= 5", "minutes": "games_played >= 5 AND seconds_played_total >= 6000", "field_goals": "games_played >= 5 AND field_goals_attempted_total >= 25", "threes": "games_played >= 5 AND three_pointers_attempted_total >= 10", "free_throws": "games_played >= 5 AND free_throws_attempted_total >= 10", "scoring": "games_played >= 5 AND field_goals_attempted_total + 0.44 * free_throws_attempted_total >= 25"}
_PLAYER = [(m, _OK[kind]) for kind, metrics in ranking.PLAYER_METRICS.items() for m in metrics]


@query(percentile_sql("person_id", _PLAYER, ranked_season([m for m, _ in _PLAYER])))
def player_season_percentiles(t, spark, d):
    """All 27 metrics with their eligibility minimums."""
    return ranking.player_season_percentiles(ranked_rows(t, "person_id", ranked_season([m for m, _ in _PLAYER])), source="orders")


@query(percentile_sql("team_id", [(m, "games_played > 0") for m in ranking.TEAM_METRICS], ranked_season(ranking.TEAM_METRICS)))
def team_season_percentiles(t, spark, d):
    """All 26 metrics."""
    return ranking.team_season_percentiles(ranked_rows(t, "team_id", ranked_season(ranking.TEAM_METRICS)), source="orders")


# ---------------------------------------------------------------- entities and facts

AWARDS = {"external_id": "'x' || CAST(o_custkey AS STRING)", "league_code": "CASE WHEN o_orderkey % 4 = 0 THEN 'ABA' ELSE 'NBA' END", "award_family": "o_orderpriority", "season_label": "CAST(year(o_orderdate) AS STRING)", "team_tier": "CAST(o_orderkey % 3 AS STRING)"}


@query(f"WITH l AS (SELECT 'x' || (c_custkey // 2 * 2) AS external_id, c_custkey AS person_id, c_acctbal AS confidence FROM customer), b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY confidence DESC, person_id) = 1) SELECT DISTINCT person_id, award_family AS award_type, season_label AS season_year, nullif(CAST(team_tier AS BIGINT), 0) AS team_tier FROM (SELECT {selected(AWARDS)} FROM orders) a JOIN b ON a.external_id = b.external_id WHERE league_code = 'NBA'")
def award_history(t, spark, d):
    """Awards of one league by the most confident person of an external id."""
    links = t["customer"].select(F.concat(F.lit("x"), (F.floor(F.col("c_custkey") / 2) * 2).cast("string")).alias("external_id"), F.col("c_custkey").alias("person_id"), F.col("c_acctbal").alias("confidence"))
    return dimensions.award_history(select(t["orders"], AWARDS), links)


@query("""
WITH e AS (SELECT user_id AS person_id, ts, event_id, CASE WHEN event_type <> 'error' THEN 'User ' || event_type END AS full_name, CASE WHEN value > 10 THEN 'G-F' END AS primary_position, event_id % 30 AS team FROM events),
l AS (SELECT person_id, arg_max(full_name, ts) FILTER (full_name IS NOT NULL) AS full_name, arg_max(primary_position, ts) FILTER (primary_position IS NOT NULL) AS primary_position, arg_max(team, ts) AS latest_team_id FROM e GROUP BY person_id),
p AS (SELECT c_custkey AS person_id, c_name, CAST(floor(c_acctbal) AS BIGINT) AS weight FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(l.person_id, p.person_id) AS person_id, coalesce(full_name, c_name) AS full_name, coalesce(primary_position, CASE WHEN p.person_id IS NOT NULL THEN 'C' END) AS primary_position, CASE coalesce(primary_position, CASE WHEN p.person_id IS NOT NULL THEN 'C' END) WHEN 'G-F' THEN 'wing' WHEN 'C' THEN 'center' END AS position_group, latest_team_id, weight AS weight_lbs
FROM l FULL JOIN p ON l.person_id = p.person_id
""")
def clean_player(t, spark, d):
    """People: latest event values, completed by profiles."""
    events = t["events"].select(F.col("user_id").alias("person_id"), F.col("ts").alias("event_time"), F.lit("2023-24").alias("season_year"), F.expr("CASE WHEN event_type <> 'error' THEN 'User ' || event_type END").alias("full_name"), F.expr("CASE WHEN value > 10 THEN 'G-F' END").alias("primary_position"), (F.col("event_id") % 30).alias("latest_team_id"))
    profiles = t["customer"].where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("full_name"), F.lit("C").alias("primary_position"), F.floor("c_acctbal").cast("long").alias("weight_lbs"))
    return semantic.player(events, profiles).select("person_id", "full_name", "primary_position", "position_group", "latest_team_id", "weight_lbs")


@query("""
WITH l AS (SELECT s_suppkey AS team_id, max(s_name) AS team_name FROM supplier GROUP BY s_suppkey), h AS (SELECT n_nationkey AS team_id, n_name AS team_name, 'R' || n_regionkey AS conference FROM nation)
SELECT coalesce(l.team_id, h.team_id) AS team_id, coalesce(l.team_name, h.team_name) AS team_name, CASE WHEN l.team_id IS NOT NULL THEN 'Los Angeles' END AS team_city, conference FROM l FULL JOIN h ON l.team_id = h.team_id
""")
def clean_team(t, spark, d):
    """Teams: latest event, history as a fallback, usual city names."""
    events = t["supplier"].select(F.col("s_suppkey").alias("team_id"), F.lit("2024-01-01").cast("timestamp").alias("event_time"), F.lit("2023-24").alias("season_year"), F.col("s_name").alias("team_name"), F.lit("LA").alias("team_city"))
    history = t["nation"].select(F.col("n_nationkey").cast("long").alias("team_id"), F.col("n_name").alias("team_name"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("conference"))
    return semantic.team(events, history, {"LA": "Los Angeles"}).select("team_id", "team_name", "team_city", "conference")


@query("SELECT p_size AS arena_id, trim(max(p_brand)) AS arena_name, max(CASE WHEN p_size % 2 = 0 THEN p_brand END) AS arena_city FROM part GROUP BY p_size".replace("SELECT p_size AS arena_id", "SELECT CAST(p_size AS BIGINT) AS arena_id"))
def clean_arena(t, spark, d):
    """Arenas, trimmed, the most filled row of each."""
    best = t["part"].groupBy(F.col("p_size").cast("long").alias("arena_id")).agg(F.max("p_brand").alias("b"))
    city = F.when(F.col("arena_id") % 2 == 0, F.col("b"))
    full = best.select("arena_id", F.concat(F.lit(" "), "b").alias("arena_name"), city.alias("arena_city"))
    return semantic.arena(full.unionByName(full.withColumns({"arena_city": F.lit(" "), "arena_name": F.lit(" ")}))).select("arena_id", "arena_name", "arena_city")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS game_id, CAST(year(o_orderdate) AS VARCHAR) AS season_year, CAST(o_orderdate AS DATE) AS game_date, o_custkey AS home_team_id, o_custkey + 1 AS away_team_id FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 7 > 0")
def clean_game(t, spark, d):
    """Games with both teams and a date."""
    key = F.col("o_orderkey")
    rows = t["orders"].select(key.cast("string").alias("game_id"), F.year("o_date").cast("string").alias("season_year"), F.when(key % 5 > 0, F.col("o_date")).alias("game_date"), F.col("o_custkey").alias("home_team_id"), F.when(key % 7 > 0, F.col("o_custkey") + 1).alias("away_team_id"))
    return semantic.game(rows).select("game_id", "season_year", "game_date", "home_team_id", "away_team_id")


PG = {"game_id": "CAST(o_orderkey AS STRING)", "person_id": "o_custkey", "team_id": "o_custkey % 30", "points": "o_orderkey % 31", "assists": "o_orderkey % 7", "turnovers": "o_orderkey % 5", "total_rebounds": "o_orderkey % 9", "offensive_rebounds": "o_orderkey % 4", "defensive_rebounds": "o_orderkey % 6", "blocks": "o_orderkey % 3", "field_goals_made": "o_orderkey % 8", "field_goals_attempted": "o_orderkey % 8 + 5", "three_pointers_made": "o_orderkey % 3", "three_pointers_attempted": "o_orderkey % 3 + 1", "free_throws_attempted": "o_orderkey % 4", "minutes_played": "30.0"}


@query(f"""
SELECT game_id, person_id, team_id, points, field_goals_made - three_pointers_made AS two_pointers_made, field_goals_attempted - three_pointers_attempted AS two_pointers_attempted, CAST(60 + person_id % 3 AS DOUBLE) AS offensive_possessions,
  round(100 * (CAST(points + 50 AS DOUBLE) / (60 + person_id % 3)), 1) AS offensive_rating, round(100 * (CAST(points + 40 AS DOUBLE) / 58), 1) AS defensive_rating, round(100 * (CAST(assists AS DOUBLE) / 20), 1) AS assist_percentage,
  round(100 * (CAST(offensive_rebounds AS DOUBLE) / 25), 1) AS offensive_rebound_percentage, round(100 * (CAST(total_rebounds AS DOUBLE) / 50), 1) AS rebound_percentage, round(100 * (CAST(blocks AS DOUBLE) / 16), 1) AS block_percentage, round(100 * (CAST(12 AS DOUBLE) / (60 + person_id % 3)), 1) AS usage_percentage
FROM (SELECT {selected(PG)} FROM orders)
""")
def clean_player_game(t, spark, d):
    """Player games with possessions and on-court rates."""
    g = select(t["orders"], PG)
    keys, c = ["game_id", "person_id"], F.col
    poss = g.select(*keys, (60.0 + c("person_id") % 3).alias("offensive_possessions"), F.lit(58.0).alias("defensive_possessions"), F.lit(12.0).alias("used_offensive_possessions"), (c("points") + 50).alias("points_for"), (c("points") + 40).alias("points_against"))
    chances = g.select(*keys, F.lit(20).alias("teammate_field_goals_made"), F.lit(25).alias("offensive_rebound_opportunities"), F.lit(25).alias("defensive_rebound_opportunities"), F.lit(50).alias("total_rebound_opportunities"), F.lit(16).alias("opponent_two_point_attempts"))
    teams = g.select("game_id", "team_id", *[F.lit(80).alias(f"team_{n}") for n in ("field_goals_attempted", "free_throws_attempted", "turnovers", "minutes")]).distinct()
    out = semantic.player_game(g, poss, chances, teams)
    return out.select("game_id", "person_id", "team_id", "points", "two_pointers_made", "two_pointers_attempted", "offensive_possessions", "offensive_rating", "defensive_rating", "assist_percentage", "offensive_rebound_percentage", "rebound_percentage", "block_percentage", "usage_percentage")


ADVANCED = {"games_played": "count(*)", "minutes_total": "count(*) * 30.0"} | {f"{c}_total": f"sum(o_orderkey % {n})" for n, c in enumerate(("points", "assists", "turnovers", "rebounds", "offensive_rebounds", "defensive_rebounds", "steals", "blocks", "personal_fouls_committed", "field_goals_made", "field_goals_attempted", "three_pointers_made", "three_pointers_attempted", "free_throws_made", "free_throws_attempted"), 5)}


@query(f"""
SELECT person_id, season_year, round(100 * ((field_goals_made_total + 0.5 * three_pointers_made_total) / nullif(CAST(field_goals_attempted_total AS DOUBLE), 0)), 1) AS effective_field_goal_percentage, round(100 * (points_total / nullif(2 * (field_goals_attempted_total + 0.44 * free_throws_attempted_total), 0)), 1) AS true_shooting_percentage,
  round(100 * (CAST(assists_total AS DOUBLE) / nullif(minutes_total / (games_played * 240 / 5) * (games_played * 40) - field_goals_made_total, 0)), 1) AS assist_percentage, round(CAST(assists_total AS DOUBLE) / nullif(turnovers_total, 0), 2) AS assist_turnover_ratio,
  round(100 * (turnovers_total / nullif(field_goals_attempted_total + 0.44 * free_throws_attempted_total + assists_total + turnovers_total, 0)), 1) AS turnover_ratio, round(100 * (offensive_rebounds_total / nullif(minutes_total / (games_played * 240 / 5) * (games_played * 40), 0)), 1) AS offensive_rebound_percentage,
  round(CAST(three_pointers_attempted_total AS DOUBLE) / nullif(field_goals_attempted_total, 0), 3) AS three_point_attempt_rate
FROM (SELECT o_custkey AS person_id, CAST(year(o_orderdate) AS VARCHAR) AS season_year, {selected(ADVANCED)} FROM orders GROUP BY ALL)
""")
def advanced_player_season(t, spark, d):
    """The advanced view of player seasons."""
    season = t["orders"].groupBy(F.col("o_custkey").alias("person_id"), F.year("o_date").cast("string").alias("season_year"), F.lit("Regular Season").alias("season_type")).agg(*[F.expr(x).alias(c) for c, x in ADVANCED.items()])
    n = F.col("games_played")
    per = {"team_minutes_total": 240.0, "team_field_goals_made_total": 40, "team_offensive_rebounds_total": 10, "team_defensive_rebounds_total": 30, "opponent_offensive_rebounds_total": 10, "opponent_defensive_rebounds_total": 30, "impact_total": 100.0}
    context = season.select("person_id", "season_year", "season_type", *[(n * v).alias(c) for c, v in per.items()])
    out = semantic.advanced_player_season(stored(season), context)
    return out.select("person_id", "season_year", "effective_field_goal_percentage", "true_shooting_percentage", "assist_percentage", "assist_turnover_ratio", "turnover_ratio", "offensive_rebound_percentage", "three_point_attempt_rate")


# ---------------------------------------------------------------- quality

RULED = {
    "game_id": "CASE WHEN o_orderkey % 50 > 0 THEN CAST(o_orderkey AS STRING) END", "team_id": "CASE WHEN o_orderkey % 49 > 0 THEN o_custkey % 30 END", "person_id": "o_custkey", "team_side": "CASE o_orderkey % 41 WHEN 0 THEN 'middle' WHEN 1 THEN NULL ELSE 'home' END", "points": "o_orderkey % 37 - 1", "assists": "o_orderkey % 7",
    "rebounds": "o_orderkey % 9", "turnovers": "CASE WHEN o_orderkey % 43 = 0 THEN -2 ELSE 1 END", "field_goals_made": "o_orderkey % 11", "field_goals_attempted": "o_orderkey % 13 + 3", "three_pointers_made": "o_orderkey % 4", "three_pointers_attempted": "o_orderkey % 5 + 2", "free_throws_made": "o_orderkey % 3", "free_throws_attempted": "o_orderkey % 3 + 1",
}


@query(f"""
SELECT coalesce(reason, 'ok') AS reason, count(*) AS rows FROM (SELECT CASE WHEN game_id IS NULL THEN 'missing_game_id' WHEN team_id IS NULL THEN 'missing_team_id' WHEN person_id IS NULL THEN 'missing_person_id' WHEN team_side IS NULL OR team_side NOT IN ('home', 'away') THEN 'invalid_team_side' WHEN points < 0 THEN 'negative_points' WHEN assists < 0 THEN 'negative_assists'
  WHEN rebounds < 0 THEN 'negative_rebounds' WHEN turnovers < 0 THEN 'negative_turnovers' WHEN field_goals_made > field_goals_attempted THEN 'field_goals_made_exceeds_field_goals_attempted' WHEN three_pointers_made > three_pointers_attempted THEN 'three_pointers_made_exceeds_three_pointers_attempted' WHEN free_throws_made > free_throws_attempted THEN 'free_throws_made_exceeds_free_throws_attempted' END AS reason FROM (SELECT {selected(RULED)} FROM orders)) GROUP BY 1
""")
def player_game_rules(t, spark, d):
    """The rules of player games, by first broken one."""
    return quality.quarantine(select(t["orders"], RULED), quality.player_game_rules())[2]


@query("""
SELECT 'period' AS part, CASE WHEN l_orderkey % 9 = 0 THEN 'missing_team_id' WHEN l_linenumber < 2 THEN 'invalid_period' WHEN l_quantity > 45 THEN 'negative_points' ELSE 'ok' END AS reason, count(*) AS rows FROM lineitem GROUP BY ALL
UNION ALL SELECT 'official', CASE WHEN o_orderkey % 6 = 0 THEN 'missing_official_id' ELSE 'ok' END, count(*) FROM orders GROUP BY ALL
UNION ALL SELECT 'matchup', CASE WHEN o_orderkey % 8 = 0 THEN 'missing_defense_person_id' WHEN o_custkey % 10 = o_orderkey % 10 THEN 'same_person' ELSE 'ok' END, count(*) FROM orders GROUP BY ALL
UNION ALL SELECT 'schedule', reason, count(*) FROM (SELECT unnest(CASE WHEN o_orderkey % 5 = 0 THEN ['same_team'] ELSE ['ok'] END || CASE WHEN o_orderkey % 7 = 0 THEN ['missing_date'] ELSE [] END) AS reason FROM orders) GROUP BY ALL
""")
def other_rules(t, spark, d):
    """The rules of team periods, officials, matchups and schedules."""
    o, line, key = t["orders"], t["lineitem"], F.col("o_orderkey")
    parts = {
        "period": (line.select(F.col("l_orderkey").alias("game_id"), F.when(F.col("l_orderkey") % 9 > 0, F.col("l_suppkey")).alias("team_id"), (F.col("l_linenumber") - 1).alias("period"), (45 - F.col("l_quantity")).alias("points")), quality.team_period_rules()),
        "official": (o.select(key.alias("game_id"), F.when(key % 6 > 0, key).alias("official_id")), quality.official_rules()),
        "matchup": (o.select(key.alias("game_id"), (F.col("o_custkey") % 10).alias("offense_person_id"), F.when(key % 8 > 0, key % 10).alias("defense_person_id")), quality.matchup_rules()),
        "schedule": (o.select(key.alias("game_id"), F.col("o_custkey").alias("home_team_id"), F.when(key % 5 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1).alias("away_team_id"), F.when(key % 7 > 0, F.col("o_date")).alias("game_date")), quality.schedule_rules()),
    }
    out = None
    for name, (rows, rules) in parts.items():
        one = quality.quarantine(rows, rules)[2].select(F.lit(name).alias("part"), "reason", "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT 'orders' AS artifact_id, count(*) AS total_rows, count(*) - count(DISTINCT o_orderkey) AS duplicate_rows, CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'ok' ELSE 'failed' END AS status FROM orders
UNION ALL SELECT 'customers_of_orders', count(*), count(*) - count(DISTINCT o_custkey), CASE WHEN count(*) = count(DISTINCT o_custkey) THEN 'ok' ELSE 'failed' END FROM orders
UNION ALL SELECT 'none', 0, 0, 'empty' UNION ALL SELECT 'refunds', NULL, NULL, 'missing_schema'
""")
def parity_lock(t, spark, d):
    """Grain, duplicates, emptiness and missing columns of several tables."""
    o = t["orders"]
    checks = [("orders", o, ["o_orderkey"]), ("customers_of_orders", o, ["o_custkey"]), ("none", o.where("o_orderkey < 0"), ["o_orderkey"]), ("refunds", o, ["refund_id"])]
    return quality.parity_lock(checks).select("artifact_id", "total_rows", "duplicate_rows", "status")


@query("""
SELECT 'orders' AS check_name, count(*) AS source_value, count(*) AS target_value, '' AS local_only_columns, '' AS served_only_columns, 'ok' AS status FROM orders
UNION ALL SELECT 'late', count(*), count(*) FILTER (o_orderkey % 2 = 0), 'o_orderstatus', 'extra', 'mismatch' FROM orders
""")
def serving_parity(t, spark, d):
    """Row-count and column differences of a served table."""
    o = t["orders"]
    late = o.where("o_orderkey % 2 = 0").drop("o_orderstatus").withColumn("extra", F.lit(1))
    return quality.parity("orders", o, o).unionByName(quality.parity("late", o, late)).select("check_name", "source_value", "target_value", "local_only_columns", "served_only_columns", "status")


@query("""
SELECT 'o_totalprice' AS column_name, count(o_totalprice) AS non_null, CASE WHEN count(o_totalprice) > 0 THEN 'populated' ELSE 'missing_data' END AS exposure FROM orders
UNION ALL SELECT 'never', 0, 'missing_data' UNION ALL SELECT 'zero', count(*), 'missing_data' FROM orders UNION ALL SELECT 'o_custkey', count(o_custkey), 'unexposed' FROM orders UNION ALL SELECT 'o_orderkey', count(o_orderkey), 'deferred' FROM orders
""")
def metric_exposure(t, spark, d):
    """Which columns' data are exposed as metrics."""
    o = t["orders"].withColumns({"never": F.lit(None).cast("double"), "zero": F.lit(0)})
    profile = quality.column_profile(o, ["o_totalprice", "never", "zero", "o_custkey", "o_orderkey"])
    return quality.metric_exposure(profile, ["o_totalprice", "never", "zero"], ["o_orderkey"]).select("column_name", "non_null", "exposure")


@query("""
SELECT 'orders' AS check_name, count(*) AS source_value, count(*) FILTER (o_orderkey % 3 > 0) AS target_value, CASE WHEN count(*) = count(*) FILTER (o_orderkey % 3 > 0) THEN 'ok' ELSE 'mismatch' END AS status, 'failed' AS overall FROM orders
UNION ALL SELECT 'refunds', NULL, NULL, 'query_error', 'failed' UNION ALL SELECT 'same', count(*), count(*), 'ok', 'failed' FROM orders
""")
def reconciliation_errors(t, spark, d):
    """Checks of which one can't be run: its status says so, and the others stand."""
    o = t["orders"]
    checks = {
        "orders": lambda: quality.row_count_check("orders", o, o.where("o_orderkey % 3 > 0")), "same": lambda: quality.row_count_check("same", o, o),
        "refunds": lambda: quality.row_count_check("refunds", o, spark.read.parquet(f"{d}/refunds.parquet")),
    }
    return quality.run_checks(spark, checks).select("check_name", "source_value", "target_value", "status", "overall")


@query("""
WITH r AS (SELECT c_custkey, c_nationkey, split_part(c_name, '#', 1) || CASE WHEN c_custkey % 40 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS name FROM customer), u AS (SELECT c_nationkey, name, max(c_custkey) AS id FROM r GROUP BY ALL HAVING count(*) = 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Customer' || CASE WHEN o_custkey % 40 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END END AS replaced_name, CASE WHEN o_orderkey % 2 = 0 THEN u.id END AS replaced_id
FROM orders JOIN customer c ON o_custkey = c.c_custkey LEFT JOIN u ON c.c_nationkey = u.c_nationkey AND u.name = 'Customer' || CASE WHEN o_custkey % 40 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END
""")
def replaced_players(t, spark, d):
    """Who is named by "replaced by NAME": the roster's person of that name, if there is only one."""
    name = F.concat(F.lit("Customer"), F.when(F.col("c_custkey") % 40 == 0, "").otherwise(F.col("c_custkey").cast("string")))
    roster = t["customer"].select(F.col("c_nationkey").alias("team_id"), name.alias("name"), F.col("c_custkey").alias("person_id"))
    events = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("team_id"), F.concat(F.lit("X SUB: "), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("replaced by "), name)).otherwise(F.lit("out"))).alias("description"))
    return text.replaced_people(events, roster, ["team_id"]).select("o_orderkey", "replaced_name", "replaced_id")
