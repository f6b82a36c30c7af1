"""Data quality: quarantine, grain, drift, reconciliation, parity and diffs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.operators.relational import filled
from scorebook.sources.stored import stored

REASON_COLUMNS = ("reason_code", "reason_field", "reason_detail", "rule_severity", "quarantined_at_utc")


@dataclass(frozen=True)
class Rule:
    """A row that `broken` holds for fails the rule; errors go to quarantine, warnings are only counted."""

    code: str
    broken: Column
    field: str = ""
    severity: str = "error"


def required(*columns: str) -> list[Rule]:
    return [Rule(f"missing_{c}", F.col(c).isNull(), c) for c in columns]


def not_negative(*columns: str) -> list[Rule]:
    return [Rule(f"negative_{c}", F.coalesce(F.col(c) < 0, F.lit(False)), c) for c in columns]


def at_most(part: str, whole: str) -> Rule:
    return Rule(f"{part}_exceeds_{whole}", F.coalesce(F.col(part) > F.col(whole), F.lit(False)), part)


def one_of(column: str, values: Sequence[str]) -> Rule:
    return Rule(f"invalid_{column}", F.coalesce(~F.col(column).isin(*values), F.lit(True)), column)


def player_game_rules() -> list[Rule]:
    made = [("field_goals_made", "field_goals_attempted"), ("three_pointers_made", "three_pointers_attempted"), ("free_throws_made", "free_throws_attempted")]
    return [*required("game_id", "team_id", "person_id"), one_of("team_side", ("home", "away")), *not_negative("points", "assists", "rebounds", "turnovers"), *[at_most(a, b) for a, b in made]]


def team_game_rules() -> list[Rule]:
    return [*required("game_id", "team_id"), one_of("team_side", ("home", "away")), *not_negative("points"), at_most("field_goals_made", "field_goals_attempted")]


def team_period_rules() -> list[Rule]:
    return [*required("game_id", "team_id", "period"), Rule("invalid_period", F.coalesce(F.col("period") < 1, F.lit(False)), "period"), *not_negative("points")]


def official_rules() -> list[Rule]:
    return required("game_id", "official_id")


def matchup_rules() -> list[Rule]:
    return [*required("game_id", "offense_person_id", "defense_person_id"), Rule("same_person", F.coalesce(F.col("offense_person_id") == F.col("defense_person_id"), F.lit(False)), "defense_person_id")]


def schedule_rules() -> list[Rule]:
    return [*required("game_id", "home_team_id", "away_team_id"), Rule("same_team", F.coalesce(F.col("home_team_id") == F.col("away_team_id"), F.lit(False)), "away_team_id"), Rule("missing_date", F.col("game_date").isNull(), "game_date", "warning")]


def quarantine(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = (), at: str = "1970-01-01 00:00:00") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean rows, quarantined rows with reason columns, metrics by reason).

    A row's reason is its first broken error rule. Clean rows are deduplicated on `keys` by how filled they are.
    """
    errors, warnings = [r for r in rules if r.severity == "error"], [r for r in rules if r.severity != "error"]
    reason = F.coalesce(*[F.when(r.broken, F.struct(F.lit(r.code).alias("code"), F.lit(r.field).alias("field"), F.lit(r.severity).alias("severity"))) for r in errors])
    marked = df.withColumn("_reason", reason)
    for r in warnings:
        marked = marked.withColumn(f"_warn_{r.code}", r.broken)
    good = marked.where("_reason is null")
    bad = marked.where("_reason is not null").select(
        *df.columns, F.col("_reason.code").alias("reason_code"), F.col("_reason.field").alias("reason_field"),
        F.concat(F.lit("rule "), F.col("_reason.code")).alias("reason_detail"), F.col("_reason.severity").alias("rule_severity"), F.lit(at).cast("timestamp").alias("quarantined_at_utc"),
    )
    counted = marked.select(F.explode(F.array_compact(F.array(F.coalesce(F.col("_reason.code"), F.lit("ok")), *[F.when(F.col(f"_warn_{r.code}"), r.code) for r in warnings]))).alias("reason"))
    metrics = counted.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
    clean = good.select(*df.columns)
    if keys:
        rest = [c for c in df.columns if c not in keys]
        order = Window.partitionBy(*keys).orderBy(filled(rest).desc(), *[F.col(c).asc_nulls_last() for c in rest])
        clean = clean.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
    return clean, bad, metrics


def whole_games(df: DataFrame, game: str = "game_id", side: str = "team_side") -> tuple[DataFrame, DataFrame]:
    """(rows of games with exactly one home and one away row, rows of all other games)."""
    w = Window.partitionBy(game)
    n = lambda s: F.sum((F.col(side) == s).cast("int")).over(w)
    marked = df.withColumn("_ok", (F.coalesce(n("home"), F.lit(0)) == 1) & (F.coalesce(n("away"), F.lit(0)) == 1) & (F.count(F.lit(1)).over(w) == 2))
    return marked.where("_ok").drop("_ok"), marked.where("not _ok").drop("_ok")


def grain_text(columns: Sequence[str]) -> Column:
    """The grain as text: one key as it is (null stays null), several joined with <NULL> for nulls."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")) for c in columns])


def grain_check(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """One row: rows, distinct and duplicate grains, rows with a null key, status."""
    null = F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0))
    out = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct(grain_text(columns)).alias("distinct_grains"), F.coalesce(F.sum(null), F.lit(0)).alias("null_key_rows"))
    duplicates = F.col("total_rows") - F.col("distinct_grains") - (F.col("null_key_rows") if len(columns) == 1 else F.lit(0))
    status = F.when(F.col("total_rows") == 0, "empty").when((F.col("duplicate_rows") > 0) | (F.col("null_key_rows") > 0), "failed").otherwise("ok")
    return out.select(F.lit(name).alias("artifact_id"), "*", duplicates.alias("duplicate_rows")).withColumn("status", status)


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: non-null count, minimum, maximum, is_populated (not all null and not constantly 0); one scan."""
    aggs = [f(F.col(c)).alias(f"{c}|{n}") for c in columns for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    one = df.agg(*aggs)
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}|n`").alias("non_null"), F.col(f"`{c}|lo`").cast("double").alias("minimum"), F.col(f"`{c}|hi`").cast("double").alias("maximum")) for c in columns])
    out = one.select(F.explode(items).alias("x")).select("x.*")
    populated = (F.col("non_null") > 0) & ~((F.col("minimum") == 0) & (F.col("maximum") == 0))
    return out.withColumn("is_populated", F.coalesce(populated, F.lit(False)))


def metric_exposure(profile: DataFrame, exposed: Sequence[str], deferred: Sequence[str] = ()) -> DataFrame:
    """populated, missing_data, deferred or unexposed per column."""
    c = F.col("column_name")
    later = c.isin(*deferred) if deferred else F.lit(False)
    status = F.when(later, "deferred").when(~c.isin(*exposed), "unexposed").when(F.col("is_populated"), "populated").otherwise("missing_data")
    return profile.withColumn("exposure", status)


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """One row: rows, files and bytes of a table read from files."""
    files = df.groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count(F.lit(1)).alias("n"))
    return files.agg(F.lit(name).alias("artifact_id"), F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("object_count"), F.sum("file_size").alias("total_bytes"))


def schema_rows(spark, name: str, schema: T.StructType, run: str) -> DataFrame:
    """(artifact_id, run_id, column_name, data_type, nullable) of a table."""
    rows = [(name, run, f.name, f.dataType.simpleString(), f.nullable) for f in schema.fields]
    return spark.createDataFrame(rows, "artifact_id string, run_id string, column_name string, data_type string, nullable boolean")


def column_facts(df: DataFrame, name: str, run: str) -> DataFrame:
    """`schema_rows` with what the data say: rows and nulls of each column, in one scan."""
    nulls = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f.name).isNull()).alias(f"n{i}") for i, f in enumerate(df.schema.fields)])
    items = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("nullable"), F.col(f"n{i}").alias("nulls")) for i, f in enumerate(df.schema.fields)])
    return nulls.select(F.lit(name).alias("artifact_id"), F.lit(run).alias("run_id"), "rows", F.explode(items).alias("x")).select("artifact_id", "run_id", "rows", "x.*")


def schema_drift(now: DataFrame, before: DataFrame) -> DataFrame:
    """added, removed, type_changed, nullable_changed, unchanged or no_history per (artifact, column)."""
    key = ["artifact_id", "column_name"]
    pick = lambda df, p: df.select(*key, F.col("data_type").alias(f"{p}_type"), F.col("nullable").alias(f"{p}_nullable"))
    known = before.select("artifact_id").distinct().withColumn("_known", F.lit(True))
    out = pick(now, "new").join(pick(before, "old"), key, "full_outer").join(known, "artifact_id", "left")
    status = (
        F.when(F.col("_known").isNull(), "no_history").when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "type_changed").when(F.col("old_nullable") != F.col("new_nullable"), "nullable_changed").otherwise("unchanged")
    )
    return out.select(*key, "old_type", "new_type", status.alias("drift"))


def row_count_trend(runs: DataFrame) -> DataFrame:
    """Each run's row count with the previous run's, the change and a status."""
    w = Window.partitionBy("artifact_id").orderBy("run_date", "run_id")
    before = F.lag("row_count").over(w)
    out = runs.withColumn("previous_row_count", before).withColumn("row_count_delta", F.col("row_count") - F.col("previous_row_count"))
    d = F.col("row_count_delta")
    return out.withColumn("trend", F.when(d.isNull(), "no_history").when(d > 0, "increased").when(d < 0, "decreased").otherwise("unchanged"))


def completeness(expected: DataFrame, observed: DataFrame, key: str = "season") -> DataFrame:
    """Expected against observed counts per season: complete, partial, missing or extra."""
    a = expected.select(key, F.col("n").alias("expected"))
    b = observed.select(key, F.col("n").alias("observed"))
    out = a.join(b, key, "full_outer")
    status = F.when(F.col("expected").isNull(), "extra_season").when(F.coalesce("observed", F.lit(0)) == 0, "missing").when(F.col("observed") < F.col("expected"), "partial").otherwise("complete")
    return out.select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("observed", F.lit(0)).alias("observed"), status.alias("status"))


def row_count_check(name: str, source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: counts of both tables, difference, ok or mismatch."""
    s, t = source.agg(F.count(F.lit(1)).alias("source_value")), target.agg(F.count(F.lit(1)).alias("target_value"))
    out = s.crossJoin(t)  # one row each
    return out.select(F.lit(name).alias("check_name"), "source_value", "target_value", (F.col("target_value") - F.col("source_value")).alias("difference"), F.when(F.col("source_value") == F.col("target_value"), "ok").otherwise("mismatch").alias("status"))


def key_check(name: str, source: DataFrame, target: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row: distinct source keys, those that the target lacks, ok or mismatch."""
    s = source.select(*[F.col(a) for a, _ in pairs]).dropna().distinct()
    t = target.select(*[F.col(b).alias(a) for a, b in pairs]).distinct().withColumn("_hit", F.lit(1))
    joined = s.join(t, [a for a, _ in pairs], "left").agg(F.count(F.lit(1)).alias("source_value"), F.count("_hit").alias("target_value"))
    return joined.select(F.lit(name).alias("check_name"), "source_value", "target_value", (F.col("target_value") - F.col("source_value")).alias("difference"), F.when(F.col("source_value") == F.col("target_value"), "ok").otherwise("mismatch").alias("status"))


def all_checks(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of checks, with the overall status: failed if any isn't ok."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    worst = F.max(F.when(F.col("status") != "ok", 1).otherwise(0)).over(Window.partitionBy(F.lit(1)))  # one row per check
    return out.withColumn("overall", F.when(worst == 1, "failed").otherwise("success"))


def run_checks(spark: SparkSession, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """`all_checks` of those that run; one that raises gives a row with status query_error and the first line of why."""
    kinds = "check_name string, source_value long, target_value long, difference long, status string, error string"
    rows = []
    for name, check in checks.items():
        try:
            rows += [(*r, None) for r in check().select("check_name", "source_value", "target_value", "difference", "status").collect()]  # one row each
        except (AnalysisException, SparkRuntimeException) as e:
            rows.append((name, None, None, None, "query_error", str(e).splitlines()[0]))
    return all_checks([spark.createDataFrame(rows, kinds)])


def parity_lock(tables: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """`grain_check` of several (name, table, grain columns); a table that lacks one of them has status missing_schema."""
    out = None
    for name, df, grain in tables:
        if set(grain) <= set(df.columns):
            one = grain_check(df, grain, name)
        else:
            nothing = {c: F.lit(None).cast("long") for c in ("total_rows", "distinct_grains", "null_key_rows", "duplicate_rows")}
            one = df.sparkSession.range(1).select(F.lit(name).alias("artifact_id"), *[v.alias(c) for c, v in nothing.items()], F.lit("missing_schema").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


def parity(name: str, local: DataFrame, served: DataFrame) -> DataFrame:
    """One row: row-count difference and columns that only one side has."""
    only = lambda a, b: ",".join(sorted(set(a.columns) - set(b.columns)))
    out = row_count_check(name, local, served)
    drift = only(local, served) + only(served, local)
    return out.select("check_name", "source_value", "target_value", "difference", F.lit(only(local, served)).alias("local_only_columns"), F.lit(only(served, local)).alias("served_only_columns"), F.when((F.col("difference") == 0) & F.lit(not drift), "ok").otherwise("mismatch").alias("status"))


def table_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per column: rows of both versions that differ, with the smallest key as an example; plus rows on one side only."""
    pick = lambda df, p: df.select(*keys, F.lit(True).alias(f"{p}_here"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    j = pick(old, "old").join(pick(new, "new"), list(keys), "full_outer")
    both = F.col("old_here").isNotNull() & F.col("new_here").isNotNull()
    tests = {c: both & ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in columns}
    tests |= {"<old only>": F.col("new_here").isNull(), "<new only>": F.col("old_here").isNull()}
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(t, 1).otherwise(0).alias("bad")) for c, t in tests.items()])
    x = j.select(key.alias("k"), F.explode(items).alias("x"))
    return x.groupBy(F.col("x.column_name").alias("column_name")).agg(F.sum("x.bad").alias("mismatches"), F.min(F.when(F.col("x.bad") == 1, F.col("k"))).alias("example"))


def digested(df: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int) -> DataFrame:
    """(bucket, n, a, b): row count and two digests of the rows of each key bucket; no row moves for it."""
    row = [F.struct(F.col(c).isNull(), F.col(c)) for c in (*keys, *columns)]  # a null isn't skipped by the hash
    total = lambda h: F.sum(h.cast("decimal(20, 0)"))
    return df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), total(F.xxhash64(*row)).alias("a"), total(F.xxhash64(F.lit(7), *row)).alias("b"))


def table_diff_by_digest(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = 4096) -> DataFrame:
    """As `table_diff`; only key buckets whose digests differ are aligned row by row.

    Digests are sums of hashes, one row a bucket and task. The numbers of buckets that differ are broadcast, `buckets` at
    most, and both tables are filtered by them before the join, so rows of equal buckets aren't shuffled. Two versions
    with equal digests but different rows would go unseen: one chance in 2 ** 128.
    """
    x, y = digested(old, keys, columns, buckets), digested(new, keys, columns, buckets)
    both = x.join(y.withColumnsRenamed({c: f"_{c}" for c in ("n", "a", "b")}), "bucket", "full_outer")
    same = F.lit(True)
    for c in ("n", "a", "b"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    differ = F.broadcast(stored(both.where(~same).select("bucket")))
    some = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).join(differ, "bucket", "left_semi").drop("bucket")
    found = table_diff(some(old), some(new), keys, columns)
    # columns without a difference have their row even if no bucket differs
    names = old.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in (*columns, "<old only>", "<new only>")])).alias("column_name"))
    return names.join(found, "column_name", "left").select("column_name", F.coalesce("mismatches", F.lit(0).cast("long")).alias("mismatches"), "example")
