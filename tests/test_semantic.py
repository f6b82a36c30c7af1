"""The clean tables and advanced views."""

import datetime
import functools
import operator

from pyspark.sql import functions as F

from scorebook.operators import semantic as s

DAY = datetime.date(2024, 1, 5)


def games(spark):
    base = {c: 4 for c in s.COUNTS} | {"points": 20, "field_goals_made": 8, "field_goals_attempted": 16, "three_pointers_made": 2, "three_pointers_attempted": 6}
    rows = [(g, 7, t, o, "2023-24", "Regular Season", 30.0, True, 5) for g, t, o in (("g1", 1, 2), ("g2", 3, 2))]
    df = spark.createDataFrame(rows, "game_id string, person_id long, team_id long, opponent_team_id long, season_year string, season_type string, minutes_played double, is_starter boolean, plus_minus int")
    return df.withColumns({k: F.lit(v) for k, v in base.items()} | {"game_date": F.lit(DAY)})


def test_player_tables(spark):
    g = games(spark)
    poss = g.select("game_id", "person_id", *[F.lit(x).alias(n) for n, x in (("offensive_possessions", 60.0), ("defensive_possessions", 58.0), ("used_offensive_possessions", 15.0), ("points_for", 66.0), ("points_against", 58.0))])
    opp = g.select("game_id", "person_id", *[F.lit(20).alias(n) for n in ("teammate_field_goals_made", "offensive_rebound_opportunities", "defensive_rebound_opportunities", "total_rebound_opportunities", "opponent_two_point_attempts")])
    teams = g.select("game_id", "team_id", *[F.lit(80).alias(f"team_{n}") for n in ("field_goals_attempted", "free_throws_attempted", "turnovers", "minutes")])
    pg = s.player_game(g.unionByName(g), poss, opp, teams).cache()
    x = pg.where("game_id = 'g1'").collect()
    assert len(x) == 1 and (x[0].two_pointers_made, x[0].offensive_rating, x[0].defensive_rating, x[0].usage_percentage, x[0].assist_percentage) == (6, 110.0, 100.0, 25.0, 20.0)
    people = spark.createDataFrame([(7, datetime.date(2000, 2, 1))], "person_id long, birth_date date")
    ps = s.player_season(pg, people).collect()[0]
    assert (ps.games_played, ps.team_count, ps.is_multi_team_season, ps.points_total, ps.age_on_jan_31, ps.net_rating, ps.assist_percentage, ps.pace) == (2, 2, True, 40, 23, 10.0, 20.0, 94.4)
    assert s.player_season_team(pg).count() == 2
    context = spark.createDataFrame([(7, "2023-24", "Regular Season", 480.0, 80, 20, 60, 22, 58, 400.0)], "person_id long, season_year string, season_type string, team_minutes_total double, team_field_goals_made_total int, team_offensive_rebounds_total int, team_defensive_rebounds_total int, opponent_offensive_rebounds_total int, opponent_defensive_rebounds_total int, impact_total double")
    a = s.advanced_player_season(s.player_season(pg, people), context).collect()[0]
    assert (a.effective_field_goal_percentage, a.assist_turnover_ratio, a.assist_percentage) == (56.3, 1.0, 23.5)


def test_team_tables(spark):
    g = games(spark).where("game_id = 'g1'").drop("person_id", "opponent_team_id").withColumns({"team_home_or_away": F.lit("home"), "win_loss_result": F.lit("win")})
    both = g.unionByName(g.withColumns({"team_id": F.lit(2).cast("long"), "team_home_or_away": F.lit("away"), "win_loss_result": F.lit("loss"), "points": F.lit(18)}))
    poss = both.select("game_id", "team_id", F.lit(100.0).alias("offensive_possessions"), F.lit(100.0).alias("defensive_possessions"))
    tg = s.team_game(both, poss)
    x = tg.where("team_id = 1").collect()[0]
    assert (x.opponent_team_id, x.score, x.opponent_score, x.opponent_field_goals_made, x.block_percentage) == (2, 20, 18, 8, 40.0)
    season = s.team_season(tg, tg.select("game_id", "team_id", F.lit(8).alias("opponent_two_point_attempts"))).where("team_id = 1").collect()[0]
    assert (season.games_played, season.minutes, season.minutes_per_game, season.points_total, season.rebounds_total, season.rebound_percentage, season.block_percentage, season.defensive_rating) == (1, 6, 6.0, 20, 4, 50.0, 50.0, 18.0)
    ts = s.advanced_team_season(s.team_season_sums(tg)).where("team_id = 1").collect()[0]
    assert (ts.wins, ts.losses, ts.net_rating, ts.win_percentage, ts.offensive_rebound_percentage) == (1, 0, 2.0, 100.0, 50.0)


def test_objects(spark):
    t = lambda n: datetime.datetime(2024, 1, n)
    events = spark.createDataFrame([(1, t(1), "2023-24", "A B", "G-F", 5), (1, t(2), "2023-24", None, None, 6), (None, t(1), "2023-24", "X", "G", 1)], "person_id long, event_time timestamp, season_year string, full_name string, primary_position string, latest_team_id long")
    profiles = spark.createDataFrame([(1, "Z", 190), (2, "Only Profile", 200)], "person_id long, full_name string, weight_lbs long")
    got = {r.person_id: r for r in s.player(events, profiles).collect()}
    assert (got[1].full_name, got[1].position_group, got[1].latest_team_id, got[1].weight_lbs, got[2].full_name) == ("A B", "wing", 6, 190, "Only Profile") and len(got) == 2
    teams = spark.createDataFrame([(1, t(1), "2023-24", "Reds", "LA")], "team_id long, event_time timestamp, season_year string, team_name string, team_city string")
    hist = spark.createDataFrame([(1, "Old", "West"), (2, "Blues", None)], "team_id long, team_name string, conference string")
    x = {r.team_id: r for r in s.team(teams, hist, {"LA": "Los Angeles"}).collect()}
    assert (x[1].team_name, x[1].team_city, x[1].conference, x[2].team_name) == ("Reds", "Los Angeles", "West", "Blues")
    arenas = spark.createDataFrame([(1, " Hall ", None), (1, "Hall", "X")], "arena_id long, arena_name string, arena_city string")
    assert [(r.arena_name, r.arena_city) for r in s.arena(arenas).collect()] == [("Hall", "X")]
    g = spark.createDataFrame([("g", "2023-24", DAY, 1, 2), ("h", "2023-24", None, 1, 2)], "game_id string, season_year string, game_date date, home_team_id long, away_team_id long")
    assert [r.game_id for r in s.game(g).collect()] == ["g"]


def test_season_rates_near_ties(spark):
    """100 * 3 / (100 / 3 + 200 / 34) is 7.65 exactly; opportunities add up in the order of the games, whatever the tasks."""
    parts = [("9", 2, 34.0), ("10", 1, 3.0)], [("300", 6, 20.0), ("40", 3, 34.0), ("5", 3, 17.0)], [("5", 6, 20.0), ("40", 3, 34.0), ("300", 3, 17.0)]
    rows = [(g, p, 1, "2023-24", "x", a, r) for p, games in enumerate(parts) for g, a, r in games]
    df = s.conformed(spark.createDataFrame(rows, "game_id string, person_id long, team_id long, season_year string, season_type string, assists long, assist_percentage double"), "player_game")
    for n in (1, 5):
        got = {r.person_id: r.assist_percentage for r in s.player_season_team(df.repartition(n, "game_id")).collect()}
        in_order = [100 * (3 / (100 * 2 / 34.0 + 100 * 1 / 3.0)), *[100 * (12 / functools.reduce(operator.add, [100 * a / r for _, a, r in sorted(p, key=lambda x: int(x[0]))])) for p in parts[1:]]]
        assert got == {i: float(int(x * 10 + 0.5)) / 10 for i, x in enumerate(in_order)} and got[0] == 7.7


def test_rounding_is_that_of_doubles(spark):
    """23 / 40 is a little less than 0.575 and 7.6499999999999995 * 10 is 76.5."""
    from scorebook.functions.sport import rounded
    from scorebook.plans.catalog import player_game_metrics

    assert spark.range(1).select(rounded(F.lit(7.6499999999999995), 1), rounded(F.lit(23) / F.lit(40), 2), rounded(F.lit(-0.25), 1)).first()[:] == (7.7, 0.57, -0.3)
    row = spark.range(1).select(F.lit(23).alias("assists"), F.lit(40).alias("turnovers"))
    assert row.agg(player_game_metrics()["assist_turnover_ratio"].column()).first()[0] == 0.57


def test_team_metrics_round_doubles_as_sql_does(spark):
    from scorebook.plans.catalog import team_game_metrics

    row = spark.createDataFrame([(23, 40)], "assists long, turnovers long")
    assert row.agg(team_game_metrics()["assist_turnover_ratio"].column()).first()[0] == 0.57
