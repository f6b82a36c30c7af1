"""Functions, keyed operators, dimensions, quality, linkage, increments and files."""

import datetime
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from scorebook.functions import dates, sport, text
from scorebook.operators import dimensions, incremental, linkage, quality
from scorebook.operators import relational as r
from scorebook.sources import files

T = lambda s: datetime.datetime.fromisoformat(s)


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: text.null_if_empty(F.lit("  ")), None), (lambda: text.to_int(F.lit("12.0")), 12), (lambda: text.to_int(F.lit("x")), None), (lambda: text.to_positive_int(F.lit("-3")), None),
        (lambda: text.to_bool(F.lit(" Yes")), True), (lambda: text.to_bool(F.lit("maybe")), None), (lambda: text.to_int_list(F.array(F.lit("1"), F.lit("x"), F.lit("3"))), [1, 3]),
        (lambda: text.normalized_game_id(F.lit("22300001")), "0022300001"), (lambda: text.normalized_game_id(F.lit("abc")), "abc"), (lambda: text.normalized_name(F.lit("Lukáš  O'Neal-Smith Jr.")), "lukas oneal smith"),
        (lambda: text.normalized_name(F.lit("Gary Payton II"), keep_suffix=True), "gary payton ii"), (lambda: text.normalized_school(F.lit("University of North Dakota")), "north dakota"),
        (lambda: text.position_tokens(F.lit("Guard/Forward, G")), ["forward", "guard"]), (lambda: text.position_group(F.lit("G-F")), "wing"), (lambda: text.position_group(F.lit("F/C")), "big"), (lambda: text.position_group(F.lit(None).cast("string")), "unknown"),
        (lambda: text.free_throw_trip(F.lit("1 of 2"))["of"], 2), (lambda: text.replaced_name(F.lit("SUB: A replaced by Jo Doe (x)")), "Jo Doe"), (lambda: text.lineup_id(F.array(F.lit(9), F.lit(10), F.lit(9))), "10-9"),
        (lambda: text.lineup_people(F.lit("10-9")), [10, 9]), (lambda: text.shot_type_family(F.lit("Driving Layup")), "layup"), (lambda: text.shot_type_key(F.lit("Step Back Jump Shot")), "step_back_jump_shot"),
        (lambda: dates.duration_seconds(F.lit("PT12M34.5S")), 754.5), (lambda: dates.duration_seconds(F.lit("12:34")), None), (lambda: dates.duration_minutes(F.lit("PT2M30S")), 2), (lambda: dates.clock_seconds(F.lit("01:30")), 90.0),
        (lambda: dates.season_label(dates.season_start_year(F.lit("2024-06-30").cast("date"))), "2023-24"), (lambda: dates.season_label(F.lit(1999)), "1999-00"), (lambda: dates.season_start_year_of_game(F.lit("0029800001")), 1998),
        (lambda: dates.season_type_of_game(F.lit("0042300001")), "Playoffs"), (lambda: dates.completed_years(F.lit("2000-02-29").cast("date"), F.lit("2023-02-28").cast("date")), 22), (lambda: dates.parsed_date(F.lit("nope")), None),
        (lambda: dates.game_code_date(F.lit("20240131/AAABBB")), datetime.date(2024, 1, 31)), (lambda: dates.bucket(F.lit("2025-01-05").cast("date"), "week"), "2024-12-30"),
        (lambda: dates.local_date(F.lit("2024-01-02 03:00:00").cast("timestamp"), F.lit("America/New_York")), datetime.date(2024, 1, 1)),
        (lambda: sport.ratio(F.lit(1), F.lit(0)), None), (lambda: sport.half_even_ratio(F.lit(5), F.lit(20), 1), 0.2), (lambda: sport.half_even_ratio(F.lit(15), F.lit(20), 1), 0.8), (lambda: sport.half_even_ratio(F.lit(1), F.lit(0), 1), None),
        (lambda: sport.shot_zone(F.lit(-225.0), F.lit(10.0), F.lit(None).cast("double"), F.lit(True)), "Left Corner 3"), (lambda: sport.shot_zone(F.lit(0.0), F.lit(10.0), F.lit(1.0), F.lit(False)), "Restricted Area"), (lambda: sport.shot_value(F.lit("Free Throw")), 1),
        (lambda: sport.is_three(F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(23.0)), True), (lambda: sport.usage(F.lit(None).cast("int"), F.lit(None).cast("int"), *[F.lit(x) for x in (10, 5, 2, 30, 80, 20, 12, 240)]), 22.5),
    ],
)
def test_functions(spark, column, want):
    assert one(spark, column()) == want


def test_versions_carry_and_close(spark):
    e = spark.createDataFrame([(1, T("2024-01-01"), "G", 5), (1, T("2024-01-03"), None, 5), (1, T("2024-02-01"), "G", 6), (2, None, "C", 1), (2, T("2024-05-01"), "C", 1), (None, T("2024-01-01"), "G", 1)], "id long, t timestamp, pos string, team int")
    got = dimensions.versions(e, "id", ["pos", "team"], "t", carry=["pos"]).orderBy("id", "version").collect()
    assert [(x.id, x.pos, x.team, x.valid_from_utc, x.valid_to_utc, x.is_current) for x in got] == [
        (1, "G", 5, T("2024-01-01"), T("2024-01-31 23:59:59.999999"), 0), (1, "G", 6, T("2024-02-01"), None, 1), (2, "C", 1, T("2024-05-01"), None, 1),
    ]


def test_as_of_fallbacks(spark):
    v = spark.createDataFrame([(1, T("2024-01-01"), T("2024-06-30"), 0, 10), (1, T("2024-07-01"), None, 1, 11), (2, T("2025-01-01"), T("2025-02-01"), 0, 20), (3, None, None, 0, 30)], "id long, valid_from_utc timestamp, valid_to_utc timestamp, is_current int, sk long")
    f = spark.createDataFrame([(1, 1, T("2024-03-01")), (2, 1, T("2024-12-01")), (3, 1, T("2020-01-01")), (4, 1, None), (5, 2, T("2026-01-01")), (6, 3, None), (7, 9, T("2024-01-01"))], "fact long, pid long, t timestamp")
    got = r.as_of(f, v, "pid", "id", "t", "sk", "key", ["fact"]).collect()
    assert {x.fact: x.key for x in got} == {1: 10, 2: 11, 3: 10, 4: 11, 5: 20, 6: 30, 7: None}


def test_as_of_against_plain_ranking(spark):
    """Entities with versions that follow one another, with gaps and overlaps, over several months."""
    import random

    rng, versions, facts = random.Random(3), [], []
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(n)
    for who in range(40):
        at, overlap = rng.randrange(40), who % 5 == 0
        for n in range(rng.randrange(5)):
            end = at + rng.randrange(1, 60)
            versions.append((who, day(at), None if rng.random() < 0.1 and overlap else day(end), int(rng.random() < 0.3), who * 10 + n))
            at = end - rng.randrange(20) if overlap else end + rng.randrange(1, 20)
    for i in range(600):
        facts.append((i, rng.randrange(42), None if rng.random() < 0.05 else day(rng.randrange(250)), "x"))
    facts.append((600, None, day(3), "x"))
    v = spark.createDataFrame(versions, "id long, valid_from_utc timestamp, valid_to_utc timestamp, is_current int, sk long")
    f = spark.createDataFrame(facts, "fact long, pid long, t timestamp, note string")

    def plain(who, t):
        own = [x for x in versions if x[0] == who]
        if not own:
            return None
        if t is None:
            return max(own, key=lambda x: (x[3] == 1, x[1], x[4]))[4]
        covering = [x for x in own if x[1] <= t and (x[2] is None or t <= x[2])]
        if covering:
            return max(covering, key=lambda x: (x[1], x[3] != 1, x[4]))[4]
        before = [x for x in own if x[1] <= t]
        return max(before, key=lambda x: (x[1], x[4]))[4] if before else min(own, key=lambda x: (x[1], x[4]))[4]

    got = r.as_of(f, v, "pid", "id", "t", "sk", "key", ["fact"])
    assert got.columns == [*f.columns, "key"]
    assert {x.fact: x.key for x in got.collect()} == {i: plain(who, t) for i, who, t, _ in facts}


def test_percentiles_ties_and_direction(spark):
    df = spark.createDataFrame([(i, "s", v, n) for i, (v, n) in enumerate([(1.0, 9), (2.0, 9), (2.0, 9), (4.0, 9), (9.0, 1), (None, 9)])] + [(9, "t", 3.0, 9)], "id int, season string, v double, n int")
    got = r.percentiles(df, ["season"], [("v", "up", False, F.col("n") > 5), ("v", "down", True, F.col("n") > 5)], ["id"]).collect()
    assert {x.id: (x.up, x.down) for x in got} == {0: (0, 100), 1: (67, 67), 2: (67, 67), 3: (100, 0), 4: (None, None), 5: (None, None), 9: (100, 100)}


def test_surrogate_keys_are_dense_and_sorted(spark):
    df = spark.createDataFrame([(x, i) for i, x in enumerate([5, None, 3, 9, 1, 3])], "v int, i int")
    got = r.surrogate_keys(df, ["v", "i"], "sk").orderBy("sk").collect()
    assert [(x.sk, x.v) for x in got] == list(enumerate([1, 3, 3, 5, 9, None], 1))


def test_ranges_merges_and_runs(spark, rows):
    left, right = spark.createDataFrame([(1, 5, 9)], "g int, a int, b int"), spark.createDataFrame([(1, 1, 5, "x"), (1, 1, 6, "y"), (1, 9, 12, "z"), (1, 10, 11, "w"), (2, 5, 9, "v")], "g int, s int, e int, n string")
    assert rows(r.overlapping(left, right, ["g"], "a", "b", "s", "e"), "n") == [("y",), ("z",)]
    a, b = spark.createDataFrame([(1, "x", None), (2, None, 2)], "k int, p string, q int"), spark.createDataFrame([(1, "y", 5), (3, "z", 6)], "k int, p string, q int")
    assert rows(r.merge_columns([a, b], ["k"])) == [(1, "x", 5), (2, None, 2), (3, "z", 6)]
    e = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "a", None), (1, 3, "b", 7), (1, 4, "a", 1)], "g int, o int, t string, v int")
    assert rows(r.adjacent_merged(e, ["g"], ["o"], ["t"]), "o", "t", "v", "merged_rows") == [(1, "a", 5, 2), (3, "b", 7, 1), (4, "a", 1, 1)]
    assert rows(r.islands(e, ["g"], ["o"], "t"), "island") == [(1,), (1,), (2,), (3,)]
    assert rows(r.prefer([a, b], ["k"]), "k", "p") == [(1, "y"), (2, None), (3, "z")]


def test_order_and_partitions_do_not_matter(spark, rows):
    df = spark.createDataFrame([(i % 7, i, (i * 37) % 11) for i in range(200)], "k int, i int, v int")
    for f in (lambda d: r.best_row(d, ["k"], F.col("v")), lambda d: r.percentiles(d, ["k"], [("v", "p", False, None)], ["i"]), lambda d: r.islands(d, ["k"], ["i"], "v")):
        assert rows(f(df)) == rows(f(df.orderBy(F.desc("v")).repartition(7)))


def test_quarantine_and_group_rule(spark, rows):
    df = spark.createDataFrame([("g1", 1, "home", 5, 3, 4), ("g1", 2, "away", -1, 3, 4), ("g2", 1, "home", 5, 5, 4), ("g2", 1, "up", 5, 3, 4), (None, 1, "home", 5, 3, 4), ("g1", 1, "home", None, 3, 4)], "game_id string, team_id int, team_side string, points int, field_goals_made int, field_goals_attempted int")
    clean, bad, metrics = quality.quarantine(df, quality.team_game_rules(), ["game_id", "team_side"])
    assert rows(clean, "game_id", "points") == [("g1", 5)] and set(quality.REASON_COLUMNS) <= set(bad.columns)
    assert rows(bad, "reason_code") == [("field_goals_made_exceeds_field_goals_attempted",), ("invalid_team_side",), ("missing_game_id",), ("negative_points",)]
    assert dict(rows(metrics))["ok"] == 2
    both = spark.createDataFrame([("a", "home"), ("a", "away"), ("b", "home"), ("c", "home"), ("c", "home"), ("c", "away")], "game_id string, team_side string")
    ok, broken = quality.whole_games(both)
    assert ok.count() == 2 and broken.count() == 4
    for rules in (quality.player_game_rules(), quality.team_period_rules(), quality.official_rules(), quality.matchup_rules(), quality.schedule_rules()):
        assert rules


def test_drift_grain_and_diff(spark, rows):
    a, b = spark.createDataFrame([], "x int, y string, z int"), spark.createDataFrame([], "x long, z int, w int")
    drift = quality.schema_drift(quality.schema_rows(spark, "t", b.schema, "2"), quality.schema_rows(spark, "t", a.schema, "1"))
    assert dict(rows(drift, "column_name", "drift")) == {"x": "type_changed", "y": "removed", "z": "unchanged", "w": "added"}
    df = spark.createDataFrame([(1, 1), (1, 1), (None, 2)], "k int, v int")
    g = quality.grain_check(df, ["k"], "t").collect()[0]
    assert (g.total_rows, g.distinct_grains, g.null_key_rows, g.duplicate_rows, g.status) == (3, 1, 1, 1, "failed")
    assert quality.grain_check(df.limit(0), ["k"], "t").collect()[0].status == "empty"
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "k int, v string")
    assert rows(quality.table_diff(old, new, ["k"], ["v"])) == [("<new only>", 1, "4"), ("<old only>", 1, "3"), ("v", 1, "2")]
    assert quality.parity("t", old, new.withColumn("q", F.lit(1))).collect()[0].status == "mismatch"


def person(i, name, draft=None, weight=None, school=None, positions=(), exact=None):
    return (i, name, exact or name, draft, weight, school, list(positions), 0)


def test_linkage_outcomes(spark, rows):
    kind = "name_key string, exact_name_key string, draft string, weight int, school string, positions array<string>, completeness int"
    left = spark.createDataFrame([person(1, "ann lee"), person(2, "bo ray", "99", 200), person(3, "bo ray", None, 180), person(4, "cy", "1"), person(5, "dee"), person(6, "eve fox"), person(7, "eve fox")], f"left_id long, {kind}")
    right = spark.createDataFrame([person("a", "ann lee"), person("b1", "bo ray", "99", 200), person("b2", "bo ray", "05", 250), person("c", "cy", "1"), person("x", "eve fox"), person("z", "zed")], f"right_id string, {kind}")
    got = rows(linkage.link(left, right, blocked=["eve fox"]))
    status = {(x[0], x[1]): x[2] for x in got}
    assert status[(1, "a")] == status[(2, "b1")] == status[(4, "c")] == "accepted" and status[(5, None)] == "unmatched_left" and status[(None, "z")] == "unmatched_right"
    assert {status[(i, None)] for i in (6, 7)} == {"ambiguous"}
    forced = spark.createDataFrame([(5, "z")], "left_id long, right_id string")
    assert (5, "z", "accepted") in rows(linkage.link(left, right, forced, ["eve fox"]))


def test_html_records(spark, rows):
    page = '<html lang="en"><head><title> Hi </title><script>var a = "<p>";</script></head><body><p>One</p><a href="/x">X</a><a href="/y"> </a></body></html>'
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert rows(linkage.page_fields(df), "page_id", "lang", "title", "n_links", "n_visible")[0] == (1, "en", "Hi", 2, 8)
    assert rows(linkage.page_rows(df, '<a href="([^"]*)">([^<]*)</a>', ["href", "word"])) == [(1, 0, "/x", "X"), (1, 1, "/y", None)]


def test_incremental(spark, rows):
    src = spark.createDataFrame([("a", "k1", T("2024-01-01")), ("a", "k2", T("2024-01-02")), ("b", "k3", T("2024-01-05"))], "game string, key string, modified timestamp")
    now = incremental.fingerprints(src, "game", "key", "modified")
    assert rows(now) == rows(incremental.fingerprints(src.orderBy(F.desc("key")).repartition(3), "game", "key", "modified"))
    old = now.withColumn("source_fingerprint", F.when(F.col("game") == "a", F.col("source_fingerprint")).otherwise("x"))
    assert rows(incremental.changed(now, old, "game")) == [("b", "checkpoint_incremental")]
    assert rows(incremental.changed(now, old, "game", targets=["a", "q"])) == [("a", "targets")]
    assert rows(incremental.changed(now, None, "game", watermark="2024-01-02 00:30:00", lookback_minutes=60), "game") == [("a",), ("b",)]
    assert rows(incremental.updated_checkpoint(old, now.where("game = 'b'"), "game")) == rows(now)


def test_files(spark, tmp_path, rows):
    player = {"personId": 7, "name": "A B", "starter": "1", "played": "1", "position": "G", "statistics": {"points": "3"}}
    team = lambda i: {"teamId": i, "teamName": "T", "teamTricode": "TTT", "score": 9, "periods": [{"period": 1, "score": 4}], "players": [player], "statistics": {}}
    game = {"meta": {"time": "x"}, "game": {"gameId": "0022300001", "gameTimeUTC": "2024-01-01T00:00:00Z", "arena": {"arenaId": 5, "arenaName": "Hall"}, "officials": [{"personId": 1, "name": "R"}], "homeTeam": team(1), "awayTeam": team(2), "actions": [{"actionNumber": 4, "actionType": "2pt"}, {"actionNumber": 7, "orderNumber": 70, "actionType": "foul"}]}}
    (tmp_path / "g.json").write_text(json.dumps(game))
    p = files.read_json(spark, str(tmp_path / "g.json"))
    assert rows(files.actions(p), "gameId", "actionNumber", "orderNumber") == [("0022300001", 4, 0), ("0022300001", 7, 70)]
    assert files.box_players(p).count() == 2 and files.box_teams(p).count() == 2 and files.box_periods(p).count() == 2 and files.box_officials(p).count() == 1 and files.box_games(p).collect()[0].home_team_id == 1
    (tmp_path / "p.csv").write_text("a,b\n1, \n x ,2\n")
    assert rows(files.read_csv_as_strings(spark, str(tmp_path / "p.csv")), "a", "b") == [("1", None), ("x", "2")]
    raw = b"k,v\n1,x\n2,y\n"
    with tarfile.open(tmp_path / "m.tar.xz", "w:xz") as tar:
        info = tarfile.TarInfo("in/a.csv")
        info.size = len(raw)
        tar.addfile(info, io.BytesIO(raw))
    assert rows(files.csv_rows(files.archive_members(spark, str(tmp_path / "m.tar.xz")), "k int, v string"), "k", "v") == [(1, "x"), (2, "y")]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.write_table(df, str(tmp_path / "t"), df.schema)
    files.write_partitions(df, str(tmp_path / "pt"), "v")
    files.write_partitions(df.where("v = 'a'").withColumn("k", F.lit(9)), str(tmp_path / "pt"), "v")
    assert rows(files.read_partitions(spark, str(tmp_path / "pt"), "v", ["a", "b"]), "k") == [(2,), (9,)]
    with pytest.raises(ValueError):
        files.read_table(spark, str(tmp_path / "t"), ["k", "missing"])
    (tmp_path / "h.html").write_text("<p>\ntwo lines\n</p>")
    assert rows(files.read_html(spark, str(tmp_path / "h.html")), "html") == [("<p>\ntwo lines\n</p>",)]
    snap, seasons = str(tmp_path / "snap"), spark.createDataFrame([("2023-24", "Regular Season"), ("2024-25", "Playoffs")], "season_year string, season_type string")
    meta = files.publish_snapshot(spark, {"t": df, "s": seasons}, snap, "now", "v1", ("s", "season_year", "season_type"))
    assert rows(files.latest_regular_season(seasons)) == [("2023-24",)]
    assert dict(rows(files.validate_snapshot(meta, ["t", "q"], files.latest_regular_season(seasons.limit(0))))) == {"t": "ok", "q": "missing", "latest_regular_season": "missing"}
    for bad in ({"t": df.limit(0)}, {"t": df, "s": seasons.where("season_type = 'Playoffs'")}):
        with pytest.raises(ValueError):
            files.publish_snapshot(spark, bad, snap, "later", "v2", ("s", "season_year", "season_type") if "s" in bad else None)
    assert rows(files.read_snapshot(spark, snap, "t")) == [(1, "a"), (2, "b")]
    quoted = spark.createDataFrame([("a", "m", 'k,v\n1,"x, y\nz"\n\n2,\n')], "archive string, member string, text string")
    assert rows(files.csv_rows(quoted, "k int, v string, w date"), "k", "v", "w") == [(1, "x, y\nz", None), (2, None, None)]
    assert "PARTITIONED BY (`v`)" in files.create_table_ddl("x", df.schema, "/p", ["v"])
    assert set(files.LINEAGE) <= set(files.with_lineage(df, "r", "s", "1", "2024-01-01").columns)
    assert rows(files.typed(spark.createDataFrame([("7", "x"), ("q", "y")], "k string, v string"), df.schema), "k") == [(7,), (None,)]


def test_season_tables(spark, rows):
    g = spark.createDataFrame([(1, "s", 5, 10, 1, "g1"), (1, "s", 5, 21, 1, "g2"), (1, "s", 6, None, 0, "g3"), (None, "s", 5, 9, 1, "g1")], "p int, season string, team int, pts int, played int, game string")
    out = dimensions.season_rates(dimensions.season_totals(g, ["p", "season"], ["pts"], F.col("played") == 1, "team", "game"), ["pts"])
    x = out.collect()[0]
    assert out.count() == 1 and (x.games_played, x.pts_total, x.games_on_roster, x.primary_team, x.teams, x.pts_per_game) == (2, 31, 3, 5, 2, 15.5)
    with pytest.raises(ValueError):
        dimensions.must_be_empty(g, "audit")


def test_shot_facts(spark, rows):
    from scorebook.operators import shots

    players = spark.createDataFrame([("g", 1, 10, 1), ("g", 2, 20, 1), ("g", 3, 20, 0), ("g", None, 20, 1)], "game_id string, person_id long, team_id long, did_play int")
    teams = spark.createDataFrame([("g", 10, 20), ("g", 20, 10)], "game_id string, team_id long, opponent_team_id long")
    s = [("g", 1, True, True, 3, "Arc3", "Mid-Range", "0-8 Center"), ("g", 1, True, None, 2, "Heave", "Moon", None), ("g", 1, False, True, 2, "AtRim", "Mid-Range", None), ("g", 0, True, True, 2, "AtRim", "Mid-Range", None)]
    tried = spark.createDataFrame([(*x, "2pt", " Jump  shot", "step back") for x in s], "game_id string, person_id long, is_field_goal boolean, is_made boolean, shot_value int, shot_type string, area string, area_detail string, action_type string, sub_type string, descriptor string")
    got = {r.person_id: r for r in shots.shot_profiles(players, teams, tried, shots.STANDARD).collect()}
    assert set(got) == {1, 2} and (got[1].field_goals_attempted, got[1].field_goals_made, got[1].points_from_field_goals, got[1].arc_3_field_goals_made, got[1].at_rim_field_goals_attempted, got[1].opponent_team_id) == (2, 1, 3, 1, 0, 20)
    assert got[2].field_goals_attempted == 0
    x = shots.shot_profiles(players, teams, tried, shots.SOURCE).where("person_id = 1").collect()[0]
    assert (x.unmapped_source_area_field_goals_attempted, x.unmapped_source_area_field_goals_made, x.unmapped_source_area_detail_field_goals_attempted) == (1, 0, 1)
    assert rows(shots.unknown_labels(tried, shots.SOURCE)) == [("area", "Moon", 1)]
    types = shots.shot_types(players, teams, tried).orderBy("shot_value").collect()
    assert [(r.source_shot_type_label, r.source_shot_type_key, r.source_shot_type_family) for r in types] == [("2PT Step Back Jump Shot", "2pt|Jump shot|step back|2", "Jump Shot"), ("3PT Step Back Jump Shot", "2pt|Jump shot|step back|3", "Jump Shot")]
    assert shots.shot_types(players, teams, tried.limit(0)).count() == 0


def test_season_percentile_tables(spark):
    from scorebook.operators import ranking

    base = {m: 1.0 for ms in ranking.PLAYER_METRICS.values() for m in ms} | {"seconds_played_total": 7000.0, "field_goals_attempted_total": 30.0, "three_pointers_attempted_total": 4.0, "free_throws_attempted_total": 12.0}
    people = [(i, "2023-24", "2", float(i), float(g)) for i, g in ((1, 9), (2, 9), (3, 4), (4, 9))]
    df = spark.createDataFrame(people, "person_id long, season_year string, raw_season_type_code string, points_per_game double, games_played double").withColumns({k: F.lit(v) for k, v in base.items() if k != "points_per_game"})
    df = df.withColumn("defensive_rating", -F.col("points_per_game"))
    got = {r.person_id: r for r in ranking.player_season_percentiles(df).collect()}
    assert len([c for c in ranking.player_season_percentiles(df).columns if c.endswith("_percentile")]) == 27 and len(ranking.TEAM_METRICS) == 26
    assert [got[i].points_per_game_percentile for i in (1, 2, 3, 4)] == [0, 50, None, 100]
    assert [got[i].defensive_rating_percentile for i in (1, 2, 4)] == [0, 50, 100] and got[1].three_pointers_percentage_percentile is None and got[1].pace_percentile == 100


def test_checks_that_fail_to_run(spark, rows):
    df = spark.range(3)
    got = quality.run_checks(spark, {"good": lambda: quality.row_count_check("good", df, df), "bad": lambda: quality.row_count_check("bad", df, spark.table("nowhere"))})
    assert rows(got, "check_name", "status", "overall") == [("bad", "query_error", "failed"), ("good", "ok", "failed")]
    assert rows(quality.parity_lock([("a", df, ["id"]), ("b", df, ["key"])]), "artifact_id", "status") == [("a", "ok"), ("b", "missing_schema")]


def test_awards_and_replaced_people(spark, rows):
    from scorebook.functions.text import replaced_people

    awards = spark.createDataFrame([("x", "NBA", "MVP", "2020-21", "0"), ("x", "NBA", "MVP", "2020-21", "0"), ("x", "ABA", "MVP", "1970-71", "1"), ("y", "NBA", "All", "2020-21", "2"), (None, "NBA", "All", "s", "1")], "external_id string, league_code string, award_family string, season_label string, team_tier string")
    links = spark.createDataFrame([("x", 1, 0.5), ("x", 2, 0.9)], "external_id string, person_id long, confidence double")
    assert rows(dimensions.award_history(awards, links)) == [(2, "MVP", "2020-21", None)]
    roster = spark.createDataFrame([(1, "Jo Smith", 5), (1, "Al Po", 6), (1, "al po", 7), (2, "Jo Smith", 8)], "team_id int, name string, person_id int")
    events = spark.createDataFrame([(1, "SUB: A replaced by jo smith"), (1, "SUB: B replaced by Al Po"), (1, "no"), (2, None)], "team_id int, description string")
    assert rows(replaced_people(events, roster, ["team_id"]), "replaced_name", "replaced_id") == [("Al Po", None), ("jo smith", 5), (None, None), (None, None)]


def test_as_of_needs_no_pairs(spark, monkeypatch):
    """Overlapping versions, some endless, over many cells of time: one pass finds what comparing all pairs finds."""
    import random

    from scorebook.operators import relational

    def no_pairs(*a, **k):
        raise AssertionError("facts must not meet all versions that cover them")

    monkeypatch.setattr(relational, "containing", no_pairs)
    pick, day = random.Random(7), lambda n: datetime.datetime(2020, 1, 1) + datetime.timedelta(n)
    some = lambda p, x: x if pick.random() < p else None
    starts = [(k % 3, k, pick.randrange(-200, 900), pick.choice((0, 3, 40, 400))) for k in range(150)]
    versions = [(i, k, some(0.95, day(a)), some(0.9, day(a + n)), pick.randrange(2)) for i, k, a, n in starts]
    facts = [(f, f % 4, day(pick.randrange(-300, 1000))) for f in range(300)]
    v = spark.createDataFrame(versions, "id long, k long, valid_from_utc timestamp, valid_to_utc timestamp, is_current int")
    got = relational.as_of(spark.createDataFrame(facts, "f long, who int, at timestamp"), v, "who", "id", "at", "k", "key", ["f"])

    def plain(i, t):
        own = [x for x in versions if x[0] == i]
        covers = [x for x in own if (x[2] is None or x[2] <= t) and (x[3] is None or t <= x[3])]
        if covers:
            return max(covers, key=lambda x: (x[2] is None, x[2] or t, x[4] != 1, x[1]))[1]
        began, later = [x for x in own if x[2] and x[2] <= t], [x for x in own if x[2] and x[2] > t]
        return max(began, key=lambda x: (x[2], x[1]))[1] if began else min(later, key=lambda x: (x[2], x[1]))[1] if later else None

    assert {r.f: r.key for r in got.collect()} == {f: plain(i, t) for f, i, t in facts}


def test_html_files_without_the_writers_empty_one(spark, tmp_path):
    """A file of one row group in several splits: the first has no rows, and Spark still writes a file for it."""
    import hashlib
    import os

    import __spark_entry__

    for name in os.listdir("/root/testdata/sf0.001"):
        if name != "pages.parquet":
            os.symlink(f"/root/testdata/sf0.001/{name}", tmp_path / name)
    pages = [(i, "".join(hashlib.md5(f"{i} {k}".encode()).hexdigest() for k in range(200)) + end) for i, end in enumerate(("", " ", "\n\t", " "))]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6kb")
    try:
        got = __spark_entry__.queries()["source_html"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.digest, r.n) for r in got} == {(hashlib.md5(x.rstrip(" \t\n\f\r").encode()).hexdigest(), 1) for _, x in pages}


def test_opponents_shuffle_rows_once_and_make_no_pairs(spark, rows):
    sides = spark.createDataFrame(
        [("g", 1, "home", 10), ("g", 2, "away", 20), ("g", 3, "away", 30), ("g", 4, "home", 40), ("g", None, "away", 5), ("alone", 1, "home", 1), (None, 1, "home", 1), (None, 2, "away", 2), ("n", 7, None, 70), ("n", 6, "home", 60), ("n", 5, None, 50)],
        "game string, team long, side string, points long",
    )
    out = r.opponents(sides, "game", "team", "side", ["points"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert rows(out, "game", "team", "opponent_team", "opponent_points") == [("g", 1, 2, 20), ("g", 2, 1, 10), ("g", 3, 1, 10), ("g", 4, 2, 20), ("n", 5, 6, 60), ("n", 6, 5, 50), ("n", 7, 5, 50)]
    assert out.columns == ["game", "team", "side", "points", "opponent_team", "opponent_side", "opponent_points"]
