"""The streaming rollups give what the same rollups give on a table."""

import datetime

from scorebook.streaming import live


def run(spark, tmp_path, make, mode, table=True):
    t = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    df = spark.createDataFrame([(1, t(0), 2.0), (1, t(10), 3.0), (1, t(75), 4.0), (2, t(5), 1.0), (2, t(5), 1.0)], "user long, ts timestamp, v double")
    df.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName("live_out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(tuple(r) for r in spark.table("live_out").collect()), sorted(tuple(r) for r in make(df).collect()) if table else None


def test_windows(spark, tmp_path):
    got, want = run(spark, tmp_path, lambda e: live.window_totals(e, "user", "ts", "v"), "complete")
    assert got == want and [(r[0], r[3], r[4]) for r in got] == [(1, 2, 5.0), (1, 1, 4.0), (2, 2, 2.0)]


def test_sessions_and_duplicates(spark, tmp_path):
    got, want = run(spark, tmp_path / "a", lambda e: live.sessions(e, "user", "ts"), "complete")
    assert got == want and len(got) == 3
    got, _ = run(spark, tmp_path / "b", lambda e: live.deduplicated(e, ["user", "ts"], "ts"), "append", table=False)
    assert len(got) == 4
