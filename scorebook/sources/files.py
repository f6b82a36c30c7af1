"""Readers and writers: typed Parquet, partitions, nested game JSON, string CSV, archives, HTML, lineage, snapshots."""

from __future__ import annotations

import csv
import io
import tarfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.functions.text import null_if_empty
from scorebook.operators.relational import latest_per_key

LINEAGE = ("_meta_pipeline_run_id", "_meta_ingested_at_utc", "_meta_source_system", "_meta_source_key", "_meta_schema_version")


def read_table(spark: SparkSession, path: str, required: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Parquet with only the required columns; ValueError names the missing ones."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.select(*required)


def read_partitions(spark: SparkSession, path: str, column: str, values: Sequence, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of some partitions (or row groups): the filter reaches the scan; values that aren't there give no rows."""
    df = spark.read.parquet(path).where(F.col(column).isin(*values))
    return df.select(*columns) if columns else df


ACTION = "struct<actionNumber:bigint,orderNumber:bigint,period:bigint,clock:string,actionType:string,subType:string,descriptor:string,qualifiers:array<string>,teamId:bigint,personId:bigint,isFieldGoal:bigint,shotResult:string,shotActionNumber:bigint,possession:bigint,scoreHome:string,scoreAway:string,xLegacy:double,yLegacy:double,shotDistance:double,stealPersonId:bigint,blockPersonId:bigint,description:string,timeActual:string>"
PLAYER = "struct<personId:bigint,name:string,starter:string,played:string,position:string,statistics:map<string,string>>"
TEAM = f"struct<teamId:bigint,teamName:string,teamTricode:string,score:bigint,periods:array<struct<period:bigint,score:bigint>>,players:array<{PLAYER}>,statistics:map<string,string>>"
OFFICIAL = "struct<personId:bigint,name:string,jerseyNum:string,assignment:string>"
GAME_SCHEMA = f"meta struct<time:string>, game struct<gameId:string,actions:array<{ACTION}>,gameTimeUTC:string,arena:struct<arenaId:bigint,arenaName:string>,officials:array<{OFFICIAL}>,homeTeam:{TEAM},awayTeam:{TEAM}>"
SCHEDULE_SCHEMA = "leagueSchedule struct<seasonYear:string,gameDates:array<struct<gameDate:string,games:array<struct<gameId:string,gameDateTimeUTC:string,gameStatus:bigint,homeTeam:struct<teamId:bigint>,awayTeam:struct<teamId:bigint>>>>>>"


def read_json(spark: SparkSession, path: str, schema: str = GAME_SCHEMA) -> DataFrame:
    """One row per payload file with its path and modification time."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_modification_time").alias("_modified"))


def actions(payloads: DataFrame) -> DataFrame:
    """One row per action of the games; the place in the payload stands in for a missing order."""
    rows = payloads.select(F.col("game.gameId").alias("gameId"), F.posexplode("game.actions").alias("_n", "a"))
    return rows.select("gameId", "a.*", "_n").withColumn("orderNumber", F.coalesce("orderNumber", F.col("_n").cast("long"))).drop("_n")


def _teams(payloads: DataFrame) -> DataFrame:
    side = lambda s: payloads.select(F.col("game.gameId").alias("gameId"), F.lit(s).alias("team_side"), F.col(f"game.{s}Team").alias("t"))
    return side("home").unionByName(side("away"))


def box_players(payloads: DataFrame) -> DataFrame:
    rows = _teams(payloads).select("gameId", "team_side", F.col("t.teamId").alias("teamId"), F.explode("t.players").alias("p"))
    return rows.select("gameId", "team_side", "teamId", "p.personId", "p.name", F.col("p.starter").try_cast("long").alias("starter"), F.col("p.played").try_cast("long").alias("played"), "p.position", F.col("p.statistics").alias("statistics"))


def box_teams(payloads: DataFrame) -> DataFrame:
    return _teams(payloads).select("gameId", "team_side", "t.teamId", "t.teamName", "t.teamTricode", "t.score", "t.statistics")


def box_periods(payloads: DataFrame) -> DataFrame:
    return _teams(payloads).select("gameId", "team_side", "t.teamId", F.explode("t.periods").alias("p")).select("gameId", "team_side", "teamId", "p.period", "p.score")


def box_officials(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.col("game.gameId").alias("gameId"), F.explode("game.officials").alias("o")).select("gameId", F.col("o.personId").alias("official_id"), "o.name", "o.jerseyNum", "o.assignment")


def box_games(payloads: DataFrame) -> DataFrame:
    g = F.col("game")
    return payloads.select(g["gameId"].alias("gameId"), g["gameTimeUTC"].try_cast("timestamp").alias("game_time_utc"), g["arena"]["arenaId"].alias("arena_id"), g["arena"]["arenaName"].alias("arena_name"), g["homeTeam"]["teamId"].alias("home_team_id"), g["awayTeam"]["teamId"].alias("away_team_id"), g["homeTeam"]["score"].alias("home_score"), g["awayTeam"]["score"].alias("away_score"))


def schedule_games(payloads: DataFrame) -> DataFrame:
    """One row per game of league schedules."""
    days = payloads.select(F.col("leagueSchedule.seasonYear").alias("season_year"), F.explode("leagueSchedule.gameDates").alias("d"))
    games = days.select("season_year", F.col("d.gameDate").alias("game_date"), F.explode("d.games").alias("g"))
    return games.select("season_year", F.to_date(F.substring("game_date", 1, 10), "MM/dd/yyyy").alias("game_date"), F.col("g.gameId").alias("game_id"), F.col("g.gameDateTimeUTC").try_cast("timestamp").alias("game_time_utc"), F.col("g.homeTeam.teamId").alias("home_team_id"), F.col("g.awayTeam.teamId").alias("away_team_id"))


def read_csv_as_strings(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV; every column a trimmed string, blanks null, with the file's path."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.select(*[null_if_empty(F.col(f"`{c}`")).alias(c) for c in df.columns], F.col("_metadata.file_path").alias("_path"))


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """String columns cast to a schema; what doesn't parse becomes null, missing columns are null."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def archive_members(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """(archive, member, text) of the text members of tar archives (plain, gz, bz2, xz); one archive is read at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(suffix):
                            yield pd.DataFrame({"archive": [name], "member": [m.name], "text": [tar.extractfile(m).read().decode("utf-8", "replace")]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, text string")


def csv_rows(members: DataFrame, schema: str) -> DataFrame:
    """Rows of CSV texts by their header line, as a schema; quoted fields may hold commas and line breaks.

    Blanks and what doesn't parse are null, as are columns that a text lacks. A text is held while it is read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, member, text in batch.itertuples(index=False):
                lines = csv.reader(io.StringIO(text, newline=""))
                header = next(lines, [])
                held = [dict(zip(header, line, strict=False)) for line in lines if any(line)]
                yield pd.DataFrame({"archive": archive, "member": member, "r": held}, columns=["archive", "member", "r"])

    rows = members.select("archive", "member", "text").mapInPandas(run, "archive string, member string, r map<string,string>")
    value = lambda f: null_if_empty(F.col("r")[f.name]).try_cast(f.dataType).alias(f.name)
    return rows.select("archive", "member", *[value(f) for f in T.StructType.fromDDL(schema).fields])


def read_matchups(spark: SparkSession, json_path: str, archive_path: str, schema: str) -> DataFrame:
    """Union of JSON rows and of the rows of CSVs in tar archives."""
    loose = spark.read.schema(schema).json(json_path).withColumns({"archive": F.lit(None).cast("string"), "member": F.col("_metadata.file_path")})
    return loose.unionByName(csv_rows(archive_members(spark, archive_path), schema))


def latest_snapshots(df: DataFrame, keys: Sequence[str], times: Sequence[str] = ("meta_time", "_modified")) -> DataFrame:
    """The newest raw object of each entity: by payload time, then by modification time."""
    return latest_per_key(df, keys, times)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, html, modified) of HTML files, gzipped or not; one row per file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"), F.col("_metadata.file_modification_time").alias("modified"))


def read_movements(spark: SparkSession, path: str) -> DataFrame:
    """Player transactions: rows of {rows: [...]} payloads."""
    row = "struct<TRANSACTION_DATE:string,TRANSACTION_DESCRIPTION:string,PLAYER_ID:double,TEAM_ID:double,Transaction_Type:string>"
    df = spark.read.schema(f"rows array<{row}>").option("multiLine", True).json(path)
    r = df.select(F.explode("rows").alias("r")).select("r.*")
    return r.select(F.to_date(F.substring("TRANSACTION_DATE", 1, 10)).alias("transaction_date"), F.col("TRANSACTION_DESCRIPTION").alias("description"), F.col("PLAYER_ID").cast("long").alias("person_id"), F.col("TEAM_ID").cast("long").alias("team_id"), F.col("Transaction_Type").alias("transaction_type"))


def sample_by_ids(df: DataFrame, column: str, ids: Sequence, path: str) -> None:
    """Write the rows of some games, one folder per game; the filter is pushed to the scan."""
    df.where(F.col(column).isin(*ids)).write.mode("overwrite").partitionBy(column).parquet(path)


def with_lineage(df: DataFrame, run: str, system: str, version: str, at: str, source: Column | None = None) -> DataFrame:
    values = (F.lit(run), F.lit(at).cast("timestamp"), F.lit(system), source if source is not None else F.lit(None).cast("string"), F.lit(version))
    return df.withColumns(dict(zip(LINEAGE, values, strict=True)))


def write_table(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Full overwrite with exactly the schema's columns and types."""
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("overwrite").parquet(path)


def write_partitions(df: DataFrame, path: str, column: str) -> None:
    """Overwrite only the partitions that `df` has."""
    df.repartition(column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def write_audit(spark: SparkSession, path: str, row: dict[str, str]) -> None:
    """Append one audit row, as JSON and as Parquet."""
    one = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in row.items()]).coalesce(1)
    one.write.mode("append").json(f"{path}/json")
    one.write.mode("append").parquet(f"{path}/parquet")


def create_table_ddl(name: str, schema: T.StructType, location: str, partitions: Sequence[str] = ()) -> str:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = f" PARTITIONED BY ({', '.join(f'`{p}`' for p in partitions)})" if partitions else ""
    return f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING PARQUET{by} LOCATION '{location}'"


def register_table(spark: SparkSession, name: str, schema: T.StructType, location: str, partitions: Sequence[str] = ()) -> None:
    """Create the table over its files and, if it has partitions, discover them."""
    spark.sql(create_table_ddl(name, schema, location, partitions))
    if partitions:
        spark.sql(f"MSCK REPAIR TABLE {name}")


def publish_snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str, built_at: str, scope: str, seasons: tuple[str, str, str] | None = None) -> DataFrame:
    """Write all tables to a new folder, validate them, and only then make that build the current one.

    Returns the meta rows (table, row count, build). `seasons`: table with season_year and season_type, those two
    columns being named; its latest regular season must exist. ValueError names what fails, and readers keep the build
    that they had: the pointer under `_current` gets its row last, by a commit of its own.
    """
    build, meta = f"{path}/builds/{uuid.uuid4().hex}", None
    for name, df in tables.items():
        df.write.parquet(f"{build}/{name}")
        one = spark.read.parquet(f"{build}/{name}").agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        meta = one if meta is None else meta.unionByName(one)
    meta.withColumns({"built_at": F.lit(built_at), "scope_version": F.lit(scope)}).write.parquet(f"{build}/_snapshot_meta")
    meta = spark.read.parquet(f"{build}/_snapshot_meta")
    latest = latest_regular_season(spark.read.parquet(f"{build}/{seasons[0]}"), *seasons[1:]) if seasons else None
    bad = [f"{r.table_name} {r.status}" for r in validate_snapshot(meta, list(tables), latest).where("status != 'ok'").collect()]  # a row per table
    if bad:
        raise ValueError(f"not published: {', '.join(bad)}")
    spark.range(1).select(F.lit(build).alias("build"), F.lit(built_at).alias("built_at"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/_current")
    return meta


def read_snapshot(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the current build."""
    build = spark.read.parquet(f"{path}/_current").agg(F.max_by("build", F.struct("at", "built_at"))).first()[0]
    return spark.read.parquet(f"{build}/{table}")


def latest_regular_season(rows: DataFrame, year: str = "season_year", kind: str = "season_type", regular: str = "Regular Season") -> DataFrame:
    """One row: the latest season of that kind, or null."""
    return rows.agg(F.max(F.when(F.col(kind) == regular, F.col(year))).cast("string").alias("season"))


def validate_snapshot(meta: DataFrame, required: Sequence[str], latest: DataFrame | None = None) -> DataFrame:
    """(table, status): ok, empty or missing, for each required table and, with `latest`, the latest regular season."""
    want = meta.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in required])).alias("table_name"))
    out = want.join(meta, "table_name", "left").select("table_name", F.when(F.col("row_count").isNull(), "missing").when(F.col("row_count") == 0, "empty").otherwise("ok").alias("status"))
    if latest is None:
        return out
    return out.unionByName(latest.select(F.lit("latest_regular_season").alias("table_name"), F.when(F.col("season").isNull(), "missing").otherwise("ok").alias("status")))


def is_current(spark: SparkSession, tables: dict[str, Sequence[str]]) -> bool:
    """Do all tables exist with exactly these columns?"""
    return all(spark.catalog.tableExists(t) and set(spark.table(t).columns) == set(c) for t, c in tables.items())
