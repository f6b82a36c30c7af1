"""Incremental runs that stop, range joins by bins, ranks, digests and player versions against plain versions."""

import datetime
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from scorebook.operators import dimensions, incremental, quality
from scorebook.operators import relational as r

STEPS = ("selected", "written", "committed", "trimmed")


def job(spark, folder, rows):
    df = spark.createDataFrame(rows, "who int, n int, v int, at timestamp")
    index = lambda: incremental.fingerprints(df.withColumn("key", F.concat_ws(":", "n", "v")), "who", "key", "at")
    build = lambda ids: df.where("v > 0").join(ids, "who", "left_semi").groupBy("who").agg(F.sum("v").alias("total"))
    return incremental.Job("who", index, build, f"{folder}/target", f"{folder}/checkpoint")


@pytest.mark.parametrize("stop", STEPS)
def test_a_stop_repeats_work_and_skips_none(spark, stop):
    """After a stop at any step, the next run ends with the rows of a full rebuild, emptied entities included."""
    folder, day = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), datetime.datetime(2024, 1, 1)
    old = [(i % 4, i, i, day) for i in range(1, 13)]
    new = [(w, n, v * 2 if w == 1 else v, d) for w, n, v, d in old if w != 2] + [(2, 0, -1, day), (9, 1, 5, day)]
    incremental.run(spark, job(spark, folder, old), "first")
    for step in incremental.run_steps(spark, job(spark, folder, new), "second"):
        if step == stop:
            break
    after = incremental.Checkpoint(spark, f"{folder}/checkpoint")
    assert {x.pipeline_run_id for x in after.read().collect()} == ({"first"} if stop in STEPS[:2] else {"first", "second"})
    third = job(spark, folder, new)
    left = incremental.changed(third.index(), after.read(), "who").count()
    assert left == (3 if stop in STEPS[:2] else 0)  # 1, 2 and 9
    incremental.run(spark, third, "third")
    totals = {}
    for w, _, v, _ in new:
        totals[w] = totals.get(w, 0) + max(v, 0)
    assert {x.who: x.total for x in spark.read.parquet(f"{folder}/target").collect()} == {w: t for w, t in totals.items() if t}
    assert incremental.changed(third.index(), after.read(), "who").count() == 0


def test_an_unfinished_checkpoint_does_not_count(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    c = incremental.Checkpoint(spark, folder)
    assert c.read() is None
    c.commit(spark.range(3))
    spark.range(9).write.parquet(f"{folder}/run=1")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/run=1/_SUCCESS")
    c._fs.delete(path, False)
    assert c.last() == 0 and c.read().count() == 3
    c.commit(spark.range(5))
    assert c.last() == 2 and c.read().count() == 5
    c.trim(1)
    assert c._runs() == [2]


def test_bins_against_plain_joins(spark):
    """One hot group, short and very long ranges, ranges that end before they start, null ends and keys."""
    rng = random.Random(4)

    def ranges(n, tag):
        out = []
        for i in range(n):
            a = rng.randrange(2000)
            b = a + rng.choice([0, 1, 3, 10, 10, 10, 900, -4])
            out.append((rng.choice([1, 1, 1, 2, None]), a, None if rng.random() < 0.05 else b, f"{tag}{i}"))
        return out

    a, b = ranges(150, "l"), ranges(150, "r")
    left, right = spark.createDataFrame(a, "g int, s int, e int, l string"), spark.createDataFrame(b, "g int, rs int, re int, r string")
    want = {(x[3], y[3]) for x in a for y in b if x[0] == y[0] and None not in (x[2], y[2]) and y[2] > x[1] and y[1] <= x[2]}
    got = [(x.l, x.r) for x in r.overlapping(left, right, ["g"], "s", "e", "rs", "re").collect()]
    assert sorted(got, key=str) == sorted(want | {(x[3], None) for x in a if x[3] not in {p for p, _ in want}}, key=str)
    assert sorted((x.l, x.r) for x in r.overlapping(left, right, ["g"], "s", "e", "rs", "re", "inner").collect()) == sorted(want)
    at = {(x[3], y[3]) for x in a for y in b if x[0] is not None and x[0] == y[0] and y[2] is not None and y[1] <= x[1] < y[2]}
    got = [(x.l, x.r) for x in r.containing(left, right, ["g"], "s", "rs", "re").collect()]
    assert sorted(got, key=str) == sorted(at | {(x[3], None) for x in a if x[3] not in {p for p, _ in at}}, key=str)


def test_ranked_values_across_ranges(spark):
    """A tie never spans two ranges; a group that fills many ranges is counted through them."""
    rows = [("g", v % 37) for v in range(3000)] + [("h", 1), ("h", 1), ("h", 0)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    got = {(x.k, x.v): (x.n, x.upto, x.total) for x in r.ranked_values(df, ["k"], "v").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert got == {(k, v): (sum(x == (k, v) for x in rows), sum(x[0] == k and x[1] <= v for x in rows), sum(x[0] == k for x in rows)) for k, v in set(rows)}


def test_hot_values_in_percentiles(spark, monkeypatch):
    """Values over the bound come by broadcast, with the same numbers."""
    df = spark.createDataFrame([(i, "s", 5.0 if i % 3 else float(i)) for i in range(900)], "id int, season string, v double")
    run = lambda: {x.id: x.p for x in r.percentiles(df, ["season"], [("v", "p", False, None)], ["id"]).collect()}
    hot = run()
    monkeypatch.setattr(r, "HOT_VALUE", 1.0)
    values = [5.0 if i % 3 else float(i) for i in range(900)]
    assert hot == run() == {i: round(100 * (sum(x <= v for x in values) - 1) / 899) for i, v in enumerate(values)}


def test_digests_see_what_the_diff_sees(spark):
    old = spark.createDataFrame([(i, i % 5, str(i)) for i in range(500)] + [(1000, 1, "twice"), (1000, 1, "twice")], "k int, a int, b string")
    new = spark.createDataFrame([(i, None if i == 3 else i % 5, "x" if i in (7, 8) else str(i)) for i in range(500) if i != 9] + [(900, 1, None), (1000, 1, "other"), (1000, 1, "other")], "k int, a int, b string")
    table = lambda df: {x.column_name: (x.mismatches, x.example) for x in df.collect()}
    for buckets in (1, 64, 4096):
        assert table(quality.table_diff_by_digest(old, new, ["k"], ["a", "b"], buckets)) == table(quality.table_diff(old, new, ["k"], ["a", "b"]))
    assert set(table(quality.table_diff_by_digest(old, old, ["k"], ["a", "b"])).values()) == {(0, None)}
    x, y = quality.digested(old, ["k"], ["a", "b"], 64), quality.digested(new, ["k"], ["a", "b"], 64)
    assert 0 < x.join(y, ["bucket", "n", "a", "b"], "left_anti").count() < 10


def test_player_versions_with_late_and_conflicting_dates(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    players = spark.createDataFrame([(1, "a", "P One", "P", "One", "G", 5), (1, "b", "P One", None, None, None, 9), (1, "c", "P One", "P", "One", "F", 9), (2, "a", "P Two", "P", "Two", None, 0), (2, "a", None, None, None, None, 5), (0, "a", "x", None, None, None, 1)], "person_id long, game_id string, player_name string, first_name string, family_name string, primary_position string, team_id long")
    games = spark.createDataFrame([("a", day(1)), ("b", day(3)), ("c", day(5))], "game_id string, game_time_utc timestamp")
    bio = lambda person, born, school: (person, "Bio", "Name", born, school)
    bios = spark.createDataFrame([bio(1, None, None), bio(1, None, "S"), bio(3, datetime.date(1990, 1, 1), None)], "person_id long, first_name string, family_name string, birth_date date, school string").withColumns({c: F.lit(None).cast("int") for c in ("height_inches", "weight_lbs", "draft_year", "draft_round", "draft_number")} | {"country": F.lit(None).cast("string")})
    links = spark.createDataFrame([("x", 1, 0.4), ("y", 1, 0.9), ("z", 1, None), ("w", 2, None), ("v", 3, 1.0), ("n", 2, 0.9)], "external_id string, person_id long, confidence double")
    born = lambda y: datetime.date(y, 1, 1)
    profiles = spark.createDataFrame([("x", born(1981)), ("y", born(1982)), ("z", born(1983)), ("w", born(1984)), ("v", born(1985)), ("n", None)], "external_id string, birth_date date")
    teams = spark.createDataFrame([(9,)], "team_id long")
    got = dimensions.player_versions(players, games, bios, teams, links, profiles).orderBy("person_id", "version").collect()
    assert [(x.person_id, x.version, x.valid_from_utc, x.primary_position, x.latest_team_id, x.latest_nba_team_id, x.display_name, x.is_current) for x in got] == [
        (1, 1, day(1), "G", 5, None, "P One", 0), (1, 2, day(3), "G", 9, 9, "Bio Name", 0), (1, 3, day(5), "F", 9, 9, "P One", 1), (2, 1, day(1), None, None, None, "P Two", 1),
    ]
    assert {(x.person_id, x.birth_date, x.school) for x in got} == {(1, born(1982), "S"), (2, born(1984), None)}
    people = {x.person_id: x.birth_date for x in dimensions.player_bios(bios, links, profiles).collect()}
    assert people == {1: born(1982), 2: born(1984), 3: born(1990)}


def test_layers_are_cleared(spark):
    from scorebook.plans.games import LAYERS
    from scorebook.sources.stored import clear_layers, stored

    kept = stored(spark.range(3))
    assert kept.count() == 3
    (path,) = {f.rsplit("/", 1)[0] for f in kept.inputFiles()}
    clear_layers(spark)
    LAYERS.clear()  # they build on what has gone
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
