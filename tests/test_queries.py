"""Query families, predicates and the catalog."""

import datetime

import pytest
from pyspark.sql import functions as F

from scorebook.functions.predicates import And, Leaf, Not, Or, TimeScope
from scorebook.plans import query as q
from scorebook.plans.catalog import Catalog, LinkDef, MetricDef, ObjectDef, game_metrics, per_minutes_columns, player_game_metrics, season_derived_metrics, season_metrics, team_game_metrics

CATALOG = Catalog(
    {"game": ObjectDef("game", ("game_id",), None, "game_date"), "player": ObjectDef("player", ("person_id",), "name"), "team": ObjectDef("team", ("team_id",), "team_name")},
    (LinkDef("game", "player", (("person_id", "person_id"),)), LinkDef("game", "team", (("team_id", "team_id"),)), LinkDef("game", "team", (("opponent_id", "team_id"),), "opponent")),
    {"points": MetricDef("points", "sum", "points"), "turnovers": MetricDef("turnovers", "sum", "turnovers", lower_is_better=True)},
)


@pytest.fixture
def tables(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    games = [(n * 10 + p, p, 1 + p % 2, 2 - p % 2, day(n), 10 * p + n if (n, p) != (3, 2) else None, n % 3) for n in range(12) for p in (1, 2, 3)]
    return {
        "game": spark.createDataFrame(games, "game_id int, person_id int, team_id int, opponent_id int, game_date date, points int, turnovers int"),
        "player": spark.createDataFrame([(1, "Ada Lovelace"), (2, "Ben Okri"), (3, "Cy Twombly"), (4, "Ada Okri")], "person_id int, name string"),
        "team": spark.createDataFrame([(1, "Reds"), (2, "Blues")], "team_id int, team_name string"),
    }


def test_rank_over_last_games(tables):
    got = q.rank(CATALOG, tables, "game", "player", ["points"], last_n=10, context="team.team_name", limit=2).collect()
    assert [(r.rank, r.entity_name, r.points, r.context_value) for r in got] == [(1, "Cy Twombly", 365, "Blues"), (2, "Ben Okri", 242, "Reds")]


def test_polarity_and_direction(tables):
    m = CATALOG.metrics["turnovers"]
    assert [m.direction(w) for w in ("best", "worst", "most", "lowest", None)] == ["asc", "desc", "desc", "asc", "desc"]
    assert CATALOG.metrics["points"].direction("best") == "desc"
    with pytest.raises(ValueError):
        m.direction("nicest")


def test_roles_and_paths(tables):
    rows = q.Rows(CATALOG, tables, "game")
    own, other = rows.col("team.team_name"), rows.col("team@opponent.team_name")
    got = rows.df.select(own.alias("a"), other.alias("b")).distinct().collect()
    assert {(r.a, r.b) for r in got} == {("Reds", "Blues"), ("Blues", "Reds")}
    with pytest.raises(ValueError):
        CATALOG.path("player", "team")


def test_predicates(tables):
    where = And((Or((Leaf("player.name", "contains", "OKRI"), Leaf("points", "between", (30, 31)))), Not(Leaf("player.name", "=", "Ada Okri"))))
    got = q.find(CATALOG, tables, "game", ["player.name"], where=where).collect()
    assert {r.player_name for r in got} == {"Ben Okri", "Cy Twombly"}
    for bad in (Leaf("player.name", ">", "x"), Leaf("points", "contains", "1"), Leaf("player.name", "=", ""), Leaf("player.name", "in", ())):
        with pytest.raises(ValueError):
            q.find(CATALOG, tables, "game", ["player.name"], where=bad)
    with pytest.raises(ValueError):
        q.find(CATALOG, tables, "game", ["player.name"])
    assert q.find(CATALOG, tables, "game", ["points"], where=Leaf("points", "not in", (10,))).where("points is null").count() == 0


def test_wildcards_are_plain_text(spark):
    from scorebook.functions.predicates import to_column

    df = spark.createDataFrame([("A_b",), ("Axb",), ("50%",)], "x string")
    assert [r.x for r in df.where(to_column(Leaf("x", "contains", "a_B"), F.col)).collect()] == ["A_b"]
    assert [r.x for r in df.where(to_column(Leaf("x", "contains", "%"), F.col)).collect()] == ["50%"]


def test_time_scopes(tables):
    count = lambda t: sum(r.n for r in q.aggregate(CATALOG, tables, "game", ["person_id"], [MetricDef("n", "ratio", "count(1)")], time=t).collect())
    assert count(TimeScope(last_n_days=3)) == 12  # the anchor is the latest date of all rows
    assert count(TimeScope.named("between", "2024-01-02", "2024-01-03")) == 6
    assert count(TimeScope.named("past_year")) == 36 and count(TimeScope.named("all")) == 36
    for bad in (lambda: TimeScope(last_n_days=3, past_year=True), lambda: TimeScope(last_n_days=0), lambda: TimeScope(season="2023-24"), lambda: TimeScope.named("soon")):
        with pytest.raises(ValueError):
            bad()


def test_having_hidden_and_groups(tables):
    got = q.rank(CATALOG, tables, "game", "player", ["points"], groups=["team.team_name"], having=Leaf("turnovers", ">", 0), hidden=["turnovers"], limit=5)
    assert "turnovers" not in got.columns and "team_name" in got.columns and got.count() == 3


def test_season_surfaces_and_nulls(spark):
    t = {"season": spark.createDataFrame([(1, 5.0), (2, None), (3, 9.0)], "person_id int, ppg double"), "player": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "person_id int, name string")}
    c = Catalog({"season": ObjectDef("season", ("person_id",)), "player": ObjectDef("player", ("person_id",), "name")}, (LinkDef("season", "player", (("person_id", "person_id"),)),), season_metrics(t["season"].schema, frozenset({"person_id"})))
    assert [r.entity_name for r in q.season_rank(c, t, "season", "player", "ppg").collect()] == ["c", "a"]
    assert [r.entity_name for r in q.season_object_rows(c, t, "season", "player", ["ppg"]).collect()] == ["c", "a", "b"]


def test_compare(tables):
    rows = q.compare_rows(CATALOG, tables, "game", "player", [1, 2], last_n=3, size="month")
    got = q.compare_summary(rows, [CATALOG.metrics["points"]]).collect()
    assert [(r.entity_id, r.games, r.points, r.is_leader, r.gap_to_next) for r in got] == [(2, 3, 90, True, 30.0), (1, 3, 60, False, None)]
    assert {r.bucket for r in q.compare_breakdown(rows, [CATALOG.metrics["points"]]).collect()} == {"2024-01"}
    with pytest.raises(ValueError):
        q.compare_rows(CATALOG, tables, "game", "player", [1, 1])


def test_trend_and_last_n(tables):
    got = q.trend(CATALOG, tables, "game", "week", ["points"], series=["player.name"]).collect()
    assert got[0].bucket == "2024-01-01" and len(got) == 6
    assert q.find(CATALOG, tables, "game", ["game_id"], last_n=4).count() == 4


def test_resolve_entities(spark, tables, rows):
    names = spark.createDataFrame([("ben okri",), ("Okri",), ("Twombly",), ("Nobody",)], "wanted string")
    assert rows(q.resolve_entities(names, tables["player"], "person_id", "name")) == [("Nobody", "missing", None), ("Okri", "ambiguous", None), ("Twombly", "resolved", 3), ("ben okri", "resolved", 2)]


def test_metric_catalogs(spark):
    made = game_metrics(spark.createDataFrame([], "id int, points int, pace double, name string").schema, frozenset({"pace"}), frozenset({"id"}))
    assert set(made) == {"total_points", "average_points", "average_pace"}
    columns = ["points", "assists", "turnovers", "rebounds", "offensive_rebounds", "defensive_rebounds", "steals", "field_goals_made", "field_goals_attempted", "three_pointers_made", "three_pointers_attempted", "free_throws_made", "free_throws_attempted", "seconds_played", "offensive_possessions", "defensive_possessions", "points_for", "points_against"]
    wide = [*columns, *[f"opponent_{c}" for c in columns]]
    df = spark.range(1).select(*[F.lit(2 + i % 5).alias(c) for i, c in enumerate(wide)], F.lit("win").alias("win_loss_result"), F.lit(True).alias("is_starter"))
    got = df.agg(*[m.column().alias(n) for n, m in player_game_metrics().items()]).collect()[0]
    assert got.games_won == 1 and got.games_lost == 0 and got.games_started == 1
    team = df.agg(*[m.column().alias(n) for n, m in team_game_metrics().items()]).collect()[0]
    assert team.wins == 1 and team.opponent_field_goal_percentage is not None
    totals = spark.range(1).select(*[F.lit(7).alias(f"{c}_total") for c in ("blocks", "personal_fouls", "plus_minus", *columns)], F.lit(20).alias("games_played"), F.lit(3).alias("wins"), F.lit(1).alias("losses"))
    season = totals.select(*[F.expr(m.expr).alias(n) for n, m in season_derived_metrics(team=True).items()], *[v.alias(k) for k, v in per_minutes_columns(totals.columns, 36).items()]).collect()[0]
    assert season.win_percentage == 75.0 and season.points_per_game == 1.8
