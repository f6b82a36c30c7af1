"""Incremental processing: fingerprints, changed entities, watermarks and work lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.operators.relational import prefer
from scorebook.sources.files import write_partitions
from scorebook.sources.stored import stored


def fingerprints(sources: DataFrame, entity: str, key: str, modified: str) -> DataFrame:
    """(entity, source_fingerprint, last_modified): a hash of the entity's sorted (key, modified) pairs.

    Each pair is hashed first, so a group gathers short digests of one entity's artifacts only.
    """
    pair = F.struct(F.coalesce(F.col(key), F.lit("")).alias("key"), F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("modified"))
    return sources.groupBy(entity).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(pair))), 256).alias("source_fingerprint"), F.max(modified).alias("last_modified"))


def changed(current: DataFrame, checkpoint: DataFrame | None, entity: str, *, targets: Sequence | None = None, full: bool = False, watermark: str | None = None, lookback_minutes: int = 0) -> DataFrame:
    """(entity, selection_mode) to process: targets, else all (full), else changed since the checkpoint, else since the watermark, else all."""
    mode = lambda df, name: df.select(entity, F.lit(name).alias("selection_mode"))
    if targets:
        return mode(current.where(F.col(entity).isin(*targets)), "targets")
    if full:
        return mode(current, "full_refresh")
    if checkpoint is not None:
        before = checkpoint.select(entity, F.col("source_fingerprint").alias("_before"))
        return mode(current.join(before, entity, "left").where(~F.col("source_fingerprint").eqNullSafe(F.col("_before"))), "checkpoint_incremental")
    if watermark:
        since = F.lit(watermark).cast("timestamp") - F.make_dt_interval(mins=F.lit(lookback_minutes))
        return mode(current.where(F.col("last_modified") >= since), "watermark")
    return mode(current, "initial")


def updated_checkpoint(checkpoint: DataFrame, processed: DataFrame, entity: str) -> DataFrame:
    """The checkpoint with the processed entities' rows replaced."""
    return prefer([checkpoint, processed], [entity])


def filtered_work(games: DataFrame, *, season: str | None = None, date_from: str | None = None, date_to: str | None = None, today: str | None = None, ids: Sequence | None = None, key: str = "game_id", day: str = "game_date", season_col: str = "season_year") -> DataFrame:
    """Games by season, dates, ids, and not after today."""
    if season:
        games = games.where(F.col(season_col) == season)
    if date_from:
        games = games.where(F.col(day) >= F.lit(date_from).cast("date"))
    if date_to:
        games = games.where(F.col(day) <= F.lit(date_to).cast("date"))
    if today:
        games = games.where(F.col(day) <= F.lit(today).cast("date"))
    return games.where(F.col(key).isin(*ids)) if ids else games


# ---------------------------------------------------------------- a run with commits


class Checkpoint:
    """Entities' fingerprints as of the last finished run: a folder with one subfolder a run, of which the newest whole one counts.

    A run's folder counts once Spark's committer has marked it (_SUCCESS), so a run that stops while it writes leaves
    nothing behind that is read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _runs(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._folder)]  # one per run
        return sorted(int(n[4:]) for n in names if n.startswith("run=") and n[4:].isdigit())

    def last(self) -> int | None:
        """The newest run that finished."""
        mark = lambda n: self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run={n}/_SUCCESS"))
        return next((n for n in reversed(self._runs()) if mark(n)), None)

    def read(self) -> DataFrame | None:
        n = self.last()
        return None if n is None else self.spark.read.parquet(f"{self.path}/run={n}")

    def commit(self, rows: DataFrame) -> None:
        """Write the next run's whole checkpoint; it counts from then on."""
        n = max(self._runs(), default=-1) + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/run={n}")

    def trim(self, keep: int = 2) -> None:
        """Delete all but the newest `keep` runs that finished, and what unfinished runs before them have left."""
        last = self.last()
        for n in self._runs():
            if last is not None and n <= last - keep:
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run={n}"), True)


@dataclass(frozen=True)
class Job:
    """An incremental job: `index` gives (entity, source_fingerprint, last_modified) of all sources, `build` the rows of some entities."""

    entity: str
    index: Callable[[], DataFrame]
    build: Callable[[DataFrame], DataFrame]
    target: str
    checkpoint: str


def run_steps(spark: SparkSession, job: Job, run_id: str, **choose) -> Iterator[str]:
    """Do one run, naming each step once it is done: selected, written, committed, trimmed.

    Entities are selected (options as in `changed`), their rows are built anew and replace their partitions of the target,
    partitions of selected entities without rows go, and only then does the checkpoint name the fingerprints that were
    selected. A stop at any point leaves the checkpoint before, so the next run does that work again and skips none; all
    steps give the same result when they are done twice. A source that changes while the run goes on is selected by the next.
    """
    checkpoint = Checkpoint(spark, job.checkpoint)
    before = checkpoint.read()
    current = job.index()
    # what was selected is pinned: the same fingerprints are built from and committed
    picked = stored(changed(current, before, job.entity, **choose).join(current.select(job.entity, "source_fingerprint"), job.entity))
    yield "selected"
    rows = stored(job.build(picked.select(job.entity)))
    write_partitions(rows, job.target, job.entity)
    _drop_partitions(spark, job, picked.select(job.entity).join(rows.select(job.entity).distinct(), job.entity, "left_anti"))
    yield "written"
    done = picked.select(job.entity, "source_fingerprint", F.lit(run_id).alias("pipeline_run_id"))
    checkpoint.commit(stored(done if before is None else updated_checkpoint(before, done, job.entity)))
    yield "committed"
    checkpoint.trim()
    yield "trimmed"


def _drop_partitions(spark: SparkSession, job: Job, gone: DataFrame) -> None:
    """Delete the target's partitions of some entities, one after the other."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(job.target).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in gone.toLocalIterator():
        fs.delete(path(f"{job.target}/{job.entity}={r[0]}"), True)


def run(spark: SparkSession, job: Job, run_id: str, **choose) -> None:
    """One whole run."""
    for _ in run_steps(spark, job, run_id, **choose):
        pass
