"""Registered queries of the readers and writers: Spark writes a source's files from the tables and reads them back."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.plans.demo import tables
from scorebook.sources import files
from scorebook.sources.stored import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(tables(spark, d), spark, d)
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def documents_of(rows: DataFrame, value: str, folder: str, **options) -> str:
    """Write one text file per row, as sources that keep a file per game have it."""
    rows.select(value).write.options(maxRecordsPerFile=1, **options).text(folder)
    return folder


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_totalprice FROM orders")
def source_table(t, spark, d):
    """A typed full overwrite, read with the required columns only."""
    path = new_folder(spark)
    kinds = T.StructType.fromDDL("o_orderkey long, o_custkey string, o_totalprice double, o_orderstatus string")
    files.write_table(t["orders"].limit(0), path, kinds)
    files.write_table(t["orders"], path, kinds)
    return files.read_table(spark, path, ["o_orderkey", "o_custkey", "o_totalprice"])


@query("SELECT event_id, CAST(user_id % 8 AS INTEGER) AS part, CASE WHEN user_id % 8 IN (1, 2) THEN value * 2 ELSE value END AS value FROM events WHERE user_id % 8 IN (1, 2, 5)")
def source_partitions(t, spark, d):
    """Partitions overwritten where they were worked out anew; some of them read, one of which doesn't exist."""
    path = new_folder(spark)
    rows = t["events"].select("event_id", (F.col("user_id") % 8).cast("int").alias("part"), "value")
    files.write_partitions(rows, path, "part")
    files.write_partitions(rows.where("part in (1, 2)").withColumn("value", F.col("value") * 2), path, "part")
    return files.read_partitions(spark, path, "part", [1, 2, 5, 99], ["event_id", "part", "value"])


def day_payloads(t) -> DataFrame:
    """One game payload per day of events: actions in order, two teams with their players and periods, one official."""
    e = t["events"].withColumn("day", F.date_format("ts", "yyyyMMdd"))
    action = F.struct(
        F.col("event_id").alias("actionNumber"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") * 10).alias("orderNumber"), F.ceil(F.hour("ts") / 6 + 0.01).cast("long").alias("period"), F.date_format("ts", "HH:mm:ss").alias("clock"),
        F.col("event_type").alias("actionType"), (F.col("user_id") % 2 + 1).alias("teamId"), F.col("user_id").alias("personId"), F.when(F.col("event_type") == "click", 1).otherwise(0).cast("long").alias("isFieldGoal"),
    )
    actions = e.groupBy("day").agg(F.sort_array(F.collect_list(action)).alias("actions"))
    people = e.groupBy("day", (F.col("user_id") % 2 + 1).alias("teamId"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 2).alias("best"))
    player = F.struct(
        F.col("user_id").alias("personId"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("name"), F.when(F.col("n") > 2, "1").otherwise("0").alias("starter"), F.lit("1").alias("played"), F.lit("G").alias("position"),
        F.struct(F.col("n").cast("string").alias("events")).alias("statistics"),
    )
    players = people.groupBy("day", "teamId").agg(F.sort_array(F.collect_list(player)).alias("players"), F.sum("n").alias("score"))
    period = e.groupBy("day", (F.col("user_id") % 2 + 1).alias("teamId"), F.ceil(F.hour("ts") / 6 + 0.01).cast("long").alias("period")).agg(F.count(F.lit(1)).alias("score"))
    periods = period.groupBy("day", "teamId").agg(F.sort_array(F.collect_list(F.struct("period", "score"))).alias("periods"))
    team = F.struct("teamId", F.concat(F.lit("Team "), F.col("teamId").cast("string")).alias("teamName"), F.lit("TTT").alias("teamTricode"), "score", "periods", "players")
    sides = players.join(periods, ["day", "teamId"]).groupBy("day").agg(F.max(F.when(F.col("teamId") == 1, team)).alias("homeTeam"), F.max(F.when(F.col("teamId") == 2, team)).alias("awayTeam"))
    game = F.struct(
        F.col("day").alias("gameId"), "actions", F.concat(F.substring("day", 1, 4), F.lit("-"), F.substring("day", 5, 2), F.lit("-"), F.substring("day", 7, 2), F.lit("T20:00:00Z")).alias("gameTimeUTC"),
        F.struct(F.lit(7).alias("arenaId"), F.lit("Hall").alias("arenaName")).alias("arena"), F.array(F.struct(F.lit(9).alias("personId"), F.lit("Ref").alias("name"), F.lit("3").alias("jerseyNum"), F.lit("crew").alias("assignment"))).alias("officials"), "homeTeam", "awayTeam",
    )
    return actions.join(sides, "day").select(F.to_json(F.struct(F.struct(F.lit("t").alias("time")).alias("meta"), game.alias("game"))).alias("payload"))


ACTIONS = "(SELECT strftime(ts, '%Y%m%d') AS day, ts, event_id, user_id, user_id % 2 + 1 AS team, event_type, CAST(ceil(hour(ts) / 6 + 0.01) AS BIGINT) AS period FROM events)"


@query(f"""
SELECT day AS "gameId", event_id AS "actionNumber", CASE WHEN event_id % 2 = 0 THEN event_id * 10 ELSE row_number() OVER (PARTITION BY day ORDER BY event_id) - 1 END AS "orderNumber", period, strftime(ts, '%H:%M:%S') AS clock,
  event_type AS "actionType", team AS "teamId", user_id AS "personId", CAST(event_type = 'click' AS BIGINT) AS "isFieldGoal" FROM {ACTIONS}
""")
def source_game_json(t, spark, d):
    """Actions of nested game payloads; a missing order is the place in the payload."""
    payloads = files.read_json(spark, documents_of(day_payloads(t), "payload", new_folder(spark)))
    return files.actions(payloads).select("gameId", "actionNumber", "orderNumber", "period", "clock", "actionType", "teamId", "personId", "isFieldGoal")


@query(f"""
WITH p AS (SELECT day, team, user_id, count(*) AS n FROM {ACTIONS} GROUP BY ALL), g AS (SELECT day, count(*) FILTER (team = 1) AS h, count(*) FILTER (team = 2) AS a FROM {ACTIONS} GROUP BY day)
SELECT 'player' AS part, day AS "gameId", CASE team WHEN 1 THEN 'home' ELSE 'away' END AS side, user_id AS id, CAST(n > 2 AS BIGINT) AS n, CAST(n AS VARCHAR) AS value FROM p
UNION ALL SELECT 'team', day, CASE team WHEN 1 THEN 'home' ELSE 'away' END, team, count(*), 'Team ' || team FROM {ACTIONS} GROUP BY day, team
UNION ALL SELECT 'period', day, CASE team WHEN 1 THEN 'home' ELSE 'away' END, period, count(*), CAST(team AS VARCHAR) FROM {ACTIONS} GROUP BY day, team, period
UNION ALL SELECT 'official', day, NULL, 9, NULL, 'Ref' FROM g
UNION ALL SELECT 'game', day, NULL, CASE WHEN h > 0 THEN 1 END, h - a, substr(day, 1, 4) || '-' || substr(day, 5, 2) || '-' || substr(day, 7, 2) || ' 20:00:00 Hall' FROM g
""")
def source_boxscore(t, spark, d):
    """Player, team, period, official and game rows of box score payloads."""
    payloads = files.read_json(spark, documents_of(day_payloads(t), "payload", new_folder(spark)))
    part = lambda name, df, side, i, n, value: df.select(F.lit(name).alias("part"), "gameId", side.alias("side"), i.cast("long").alias("id"), n.cast("long").alias("n"), value.cast("string").alias("value"))
    none, side = F.lit(None).cast("string"), F.col("team_side")
    return (
        part("player", files.box_players(payloads), side, F.col("personId"), F.col("starter"), F.col("statistics")["events"])
        .unionByName(part("team", files.box_teams(payloads), side, F.col("teamId"), F.col("score"), F.col("teamName")))
        .unionByName(part("period", files.box_periods(payloads), side, F.col("period"), F.col("score"), F.col("teamId")))
        .unionByName(part("official", files.box_officials(payloads), none, F.col("official_id"), none, F.col("name")))
        .unionByName(part("game", files.box_games(payloads), none, F.col("home_team_id"), F.col("home_score") - F.coalesce("away_score", F.lit(0)), F.concat_ws(" ", F.date_format("game_time_utc", "yyyy-MM-dd HH:mm:ss"), "arena_name")))
    )


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) AS season_year, CAST(o_orderdate AS DATE) AS game_date, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS game_id, CAST(o_orderdate AS DATE) + INTERVAL 20 HOUR AS game_time_utc, o_custkey AS home_team_id, o_custkey + 1 AS away_team_id FROM orders")
def source_schedule(t, spark, d):
    """Games of league schedules, one payload per season."""
    o = t["orders"]
    game = F.struct(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("gameId"), F.date_format("o_date", "yyyy-MM-dd'T20:00:00Z'").alias("gameDateTimeUTC"), F.struct(F.col("o_custkey").alias("teamId")).alias("homeTeam"), F.struct((F.col("o_custkey") + 1).alias("teamId")).alias("awayTeam"))
    days = o.groupBy(F.year("o_date").alias("y"), F.date_format("o_date", "MM/dd/yyyy 00:00:00").alias("gameDate")).agg(F.collect_list(game).alias("games"))
    years = days.groupBy("y").agg(F.collect_list(F.struct("gameDate", "games")).alias("gameDates"))
    payload = F.to_json(F.struct(F.struct(F.col("y").cast("string").alias("seasonYear"), "gameDates").alias("leagueSchedule"))).alias("payload")
    return files.schedule_games(files.read_json(spark, documents_of(years.select(payload), "payload", new_folder(spark)), files.SCHEDULE_SCHEMA))


@query("SELECT c_custkey, trim(c_name) AS c_name, CASE WHEN c_nationkey <> 3 THEN c_acctbal END AS c_acctbal, CAST(NULL AS DATE) AS birth_date FROM customer")
def source_csv(t, spark, d):
    """A header CSV read as trimmed strings and cast to a schema; blanks and missing columns are null."""
    path = new_folder(spark)
    rows = t["customer"].select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"), F.when(F.col("c_nationkey") == 3, " ").when(F.col("c_nationkey") == 4, F.concat(F.lit(" "), F.col("c_acctbal").cast("string"))).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.typed(files.read_csv_as_strings(spark, path), T.StructType.fromDDL("c_custkey long, c_name string, c_acctbal double, birth_date date"))


def tarred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A plain tar archive with one CSV member for each (name, text)."""
    for batch in batches:
        out = []
        for name, text in zip(batch["name"], batch["text"], strict=True):
            raw, held = text.encode("ascii"), io.BytesIO()
            with tarfile.open(fileobj=held, mode="w", format=tarfile.USTAR_FORMAT) as tar:
                info = tarfile.TarInfo(f"in/{name}.csv")
                info.size = len(raw)
                tar.addfile(info, io.BytesIO(raw))
            out.append(held.getvalue().decode("ascii"))
        yield pd.DataFrame({"value": out})


@query("SELECT c_custkey AS k, 'line one, of ' || c_name || chr(10) || 'line two' AS note, 'in/n' || c_nationkey || '.csv' AS member FROM customer WHERE c_nationkey < 20 UNION ALL SELECT c_custkey, c_name, NULL FROM customer WHERE c_nationkey >= 20")
def source_matchups(t, spark, d):
    """JSON rows together with those of CSVs in tar archives, whose quoted fields hold commas and line breaks."""
    c = t["customer"]
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"line one, of '), "c_name", F.lit('\nline two"'))
    texts = c.where("c_nationkey < 20").groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name")).agg(F.concat(F.lit("k,note\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n")).alias("text"))
    archives = documents_of(texts.select("name", "text").mapInPandas(tarred, "value string"), "value", new_folder(spark))
    loose = new_folder(spark)
    c.where("c_nationkey >= 20").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("note")).write.json(loose)
    out = files.read_matchups(spark, loose, archives, "k long, note string")
    return out.select("k", "note", F.when(F.col("archive").isNotNull(), F.col("member")).alias("member"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, event_id DESC) = 1")
def source_latest(t, spark, d):
    """The newest raw object of each entity: by payload day, then by number."""
    return files.latest_snapshots(t["events"].withColumn("day", F.to_date("ts")), ["user_id"], ["day", "event_id"]).select("user_id", "event_id", "value")


@query("SELECT md5(encode(regexp_replace(html, '\\s+$', ''))) AS digest, count(*) AS n FROM pages WHERE html IS NOT NULL GROUP BY 1")
def source_html(t, spark, d):
    """Gzipped HTML files, one row each.

    A document ends with a newline, so an empty file is none: Spark writes one where its first partition has no rows.
    """
    bare = lambda c: F.rtrim(c, F.lit(" \t\n\f\r"))
    pages = spark.read.parquet(f"{d}/pages.parquet").where("html is not null").withColumn("value", bare(F.col("html")))
    got = files.read_html(spark, documents_of(pages, "value", new_folder(spark), compression="gzip")).where("html <> ''")
    return got.groupBy(F.md5(bare(F.col("html"))).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(o_orderdate AS DATE) AS transaction_date, 'order of ' || o_custkey AS description, o_custkey AS person_id, o_orderkey % 30 AS team_id, o_orderstatus AS transaction_type FROM orders")
def source_movements(t, spark, d):
    """Transactions of payloads with a list of rows."""
    row = F.struct(
        F.date_format("o_date", "yyyy-MM-dd'T00:00:00'").alias("TRANSACTION_DATE"), F.concat(F.lit("order of "), F.col("o_custkey").cast("string")).alias("TRANSACTION_DESCRIPTION"), F.col("o_custkey").cast("double").alias("PLAYER_ID"),
        (F.col("o_orderkey") % 30).cast("double").alias("TEAM_ID"), F.col("o_orderstatus").alias("Transaction_Type"),
    )
    years = t["orders"].groupBy(F.date_format("o_date", "yyyyMM").alias("m")).agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("payload"))
    return files.read_movements(spark, documents_of(years, "payload", new_folder(spark)))


@query("SELECT l_suppkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_suppkey IN (1, 3, 7) GROUP BY l_suppkey")
def source_sample(t, spark, d):
    """Rows of chosen ids, a folder for each."""
    path = new_folder(spark)
    files.sample_by_ids(t["lineitem"].select("l_suppkey", "l_quantity"), "l_suppkey", [1, 3, 7], path)
    got = spark.read.parquet(path)
    return got.groupBy(F.col("l_suppkey").cast("long").alias("l_suppkey")).agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


SNAPSHOT = ("orders", "customer", "customer_year")


def published(t, spark) -> tuple[DataFrame, str]:
    path = new_folder(spark)
    seasons = t["customer_year"].select("o_custkey", F.col("o_year").cast("string").alias("season_year"), F.lit("Regular Season").alias("season_type"), "games_played")
    parts = {"orders": t["orders"].drop("o_date"), "customer": t["customer"], "customer_year": seasons}
    return files.publish_snapshot(spark, parts, path, "2024-01-01", "v1", ("customer_year", "season_year", "season_type")), path


@query("SELECT t AS table_name, n AS row_count, '2024-01-01' AS built_at, 'v1' AS scope_version FROM (SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'customer_year', count(DISTINCT (o_custkey, year(o_orderdate))) FROM orders)")
def snapshot_meta(t, spark, d):
    """A snapshot's meta rows after it has been staged, validated and made current."""
    return published(t, spark)[0]


@query("SELECT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS season_year, count(*) AS games_played FROM orders GROUP BY ALL")
def snapshot_current(t, spark, d):
    """A table of the current build, after a build that fails its validation and stays without effect."""
    _, path = published(t, spark)
    try:
        files.publish_snapshot(spark, {"customer_year": t["customer_year"].limit(0)}, path, "2024-01-02", "v1")
    except ValueError:
        return files.read_snapshot(spark, path, "customer_year").select("o_custkey", "season_year", "games_played")
    raise AssertionError("an empty table was published")


@query("SELECT * FROM (VALUES ('orders', 'ok'), ('customer', 'ok'), ('refunds', 'missing')) v(table_name, status) UNION ALL SELECT 'latest_regular_season', CASE WHEN max(year(o_orderdate)) IS NULL THEN 'missing' ELSE 'ok' END FROM orders")
def snapshot_status(t, spark, d):
    """Required tables present and not empty, and the latest regular season."""
    meta, path = published(t, spark)
    latest = files.latest_regular_season(files.read_snapshot(spark, path, "customer_year"))
    return files.validate_snapshot(meta, ["orders", "customer", "refunds"], latest)


@query("SELECT CAST(ts AS DATE) AS run_date, event_type, count(*) AS n, true AS current FROM events GROUP BY ALL")
def registered_tables(t, spark, d):
    """A table over partitioned files, its DDL generated, its date partitions discovered, its columns checked."""
    path, name = new_folder(spark), f"events_{new_folder(spark)[-32:]}"
    rows = t["events"].select("event_id", "event_type", F.to_date("ts").alias("run_date"))
    files.write_partitions(rows, path, "run_date")
    files.register_table(spark, name, rows.schema, path, ["run_date"])
    current = files.is_current(spark, {name: rows.columns}) and not files.is_current(spark, {name: ["event_id"]})
    return spark.table(name).groupBy("run_date", "event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("current", F.lit(current))


@query("SELECT o_orderkey, 'run-7' AS _meta_pipeline_run_id, TIMESTAMP '2024-02-03 04:05:06' AS _meta_ingested_at_utc, 'shop' AS _meta_source_system, 'orders/' || o_custkey AS _meta_source_key, '2' AS _meta_schema_version FROM orders")
def source_lineage(t, spark, d):
    """Lineage columns."""
    out = files.with_lineage(t["orders"], "run-7", "shop", "2", "2024-02-03 04:05:06", F.concat(F.lit("orders/"), F.col("o_custkey").cast("string")))
    return out.select("o_orderkey", *files.LINEAGE)


@query("SELECT form, status, CAST(count(*) OVER () / 2 AS BIGINT) AS runs, (SELECT CAST(count(*) AS VARCHAR) FROM orders) AS rows_out FROM (VALUES ('json', 'ok'), ('json', 'failed'), ('parquet', 'ok'), ('parquet', 'failed')) v(form, status)")
def audit_rows(t, spark, d):
    """One audit row per run, as JSON and as Parquet."""
    path, n = new_folder(spark), str(t["orders"].count())
    for status in ("ok", "failed"):
        files.write_audit(spark, path, {"status": status, "rows_out": n})
    both = spark.read.json(f"{path}/json").select(F.lit("json").alias("form"), "status", "rows_out").unionByName(spark.read.parquet(f"{path}/parquet").select(F.lit("parquet").alias("form"), "status", "rows_out"))
    runs = both.groupBy("form").agg(F.count(F.lit(1)).alias("runs"))
    return both.join(runs, "form")
