"""Games dealt by game: a task's rows don't grow with the input, and all windows stay within the first exchange."""

from pyspark.sql import functions as F

from scorebook.operators.dimensions import player_bios, player_events
from scorebook.operators.relational import linked_row, nearby
from scorebook.operators.sequence import enriched, with_offense
from scorebook.plans.demo import tables
from scorebook.plans import games, page_records, runs
from scorebook.plans.games import raw_events
from scorebook.sources import stored

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_enriched_events_move_once(spark):
    assert exchanges(enriched(raw_events(tables(spark, SF)))) <= 1


def test_parts_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(stored, "PART_ROWS", 100)
    df = stored.dealt(spark.range(1001).withColumn("k", F.col("id") % 7), "k")
    assert df.rdd.getNumPartitions() == 11
    assert sorted(r.id for r in df.collect()) == list(range(1001))


def test_linked_row_nulls_and_doubles(spark):
    rows = [("a", 1, None, 10), ("a", 2, 1, 20), ("a", 2, 9, 30), ("a", 3, 2, 40), ("b", 4, 1, 50), (None, 1, 1, 60), ("a", None, None, 70)]
    df = spark.createDataFrame(rows, "k string, n int, link int, v int")
    got = {r.v: r.linked_v for r in linked_row(df, ["k"], "link", "n", ["v"]).collect()}
    assert got == {10: None, 20: 10, 30: None, 40: 30, 50: None, 60: None, 70: None}


def before_exchange(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().rsplit("Exchange hashpartitioning", 1)[1]


def test_profile_pages_are_dealt_before_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(page_records, "PART_PAGES", 50)
    t = tables(spark, SF)
    assert page_records.profile_pages(t).rdd.getNumPartitions() == -(-t["customer"].count() // 50) > 1
    for df in (page_records.profile_records(t, spark, SF), page_records.profile_rejects(t, spark, SF)):
        assert "meta" not in before_exchange(df)


def test_award_pages_grow_in_parts(spark, monkeypatch):
    monkeypatch.setattr(stored, "PART_ROWS", 100)
    t = tables(spark, SF)
    assert page_records.award_pages(t).rdd.getNumPartitions() == -(-t["orders"].count() // 100) > 2
    assert exchanges(page_records.award_records(t, spark, SF)) == 1


def test_nearby_counts_without_pairs(spark):
    points = [(k, i, t) for i, (k, t) in enumerate([("a", 0), ("a", 7), ("a", 20), ("a", 20), ("a", -13), ("b", 20), (None, 5), ("a", None), ("c", 1)])]
    others = [(k, i, t) for i, (k, t) in enumerate([("a", -2), ("a", 5), ("a", 4), ("a", 10), ("a", 10), ("a", 25), ("b", 18), (None, 5), ("a", None), ("a", -13), ("a", -15)])]
    make = lambda rows, v: spark.createDataFrame(rows, f"k string, {v} long, t long").withColumn("t", F.timestamp_micros("t"))
    df = nearby(make(points, "p"), make(others, "o"), ["k"], "t", 2, 5, "o", ["p"])
    want = {}
    for k, i, t in points:
        met = [o for q, o, u in others if q == k and None not in (t, u) and t - 2 < u <= t + 5]
        want[i] = (len(met), min(met, default=None))
    assert {r.p: (r.n, r.least) for r in df.collect()} == want
    assert "Join" not in runs.range_overlap_hot(tables(spark, SF), spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_player_events_grow_in_parts(spark, monkeypatch):
    monkeypatch.setattr(stored, "PART_ROWS", 100)
    rows, games, bios, teams, links, profiles = runs.player_sources(tables(spark, SF))
    n = rows.where("person_id > 0").count()
    assert player_events(rows, games, player_bios(bios, links, profiles), teams).rdd.getNumPartitions() == -(-n // 100) > 2


def test_defensive_shots_build_no_lineups(spark, monkeypatch):
    monkeypatch.setattr(games, "LAYERS", {})
    columns = ["gameId", "orderNumber", "resolvedOffenseTeamId", "resolvedDefenseTeamId", "isMadeShot", "isMissedShot"]
    raw = raw_events(tables(spark, SF))
    assert with_offense(raw).select(columns).exceptAll(enriched(raw).select(columns)).count() == 0
    alone = games.team_defensive_shots(tables(spark, SF), spark, SF)
    assert games.LAYERS == {}
    got = sorted(map(tuple, alone.collect()))
    games.game(tables(spark, SF), spark, SF)
    assert got == sorted(map(tuple, games.team_defensive_shots(tables(spark, SF), spark, SF).collect())) != []
