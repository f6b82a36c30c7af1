"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Hot keys are those with at least this share of the rows, so there are at most 1/share of them.
HOT_SHARE = 1 / 2000
#: Rows handed to Python objects at once, and the output bytes after which a batch is sent on.
ROWS_AT_ONCE, BATCH_BYTES = 500, 8 << 20
#: Narrow rows that a file of a table of known size has at least.
ROWS_PER_FILE = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, which the cluster names in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.gettempdir() + "/checkpoints")
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/scorebook-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder path within `shared_root`."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Delete all that this application has put in the shared folder; results that aren't saved yet are lost with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(taken: Iterable[str], name: str) -> str:
    """`name`, with as many underscores after it as keep it apart from the names `taken` (Spark ignores case)."""
    taken = {x.lower() for x in taken}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materialise `df` once as Parquet in the shared folder and read it back, which cuts its lineage.

    `rows`: how many narrow rows it has at most, if known; few of them go to few files.
    """
    path = shared_dir(df.sparkSession)
    (df if rows is None else df.coalesce(max(1, rows // ROWS_PER_FILE))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str | T.StructType) -> DataFrame:
    """Narrow map: `fn` turns an iterator of row tuples into one of output tuples, in bounded Arrow batches."""
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns), strict=True)

        def packed(held: list[tuple]) -> pa.RecordBatch:
            columns = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        held, size = [], 0
        for row in fn(rows()):
            held.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
            if len(held) >= 20 * ROWS_AT_ONCE or size > BATCH_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return df.mapInArrow(run, out)


def keep_rows(df: DataFrame, column: str, test: Callable[[], Callable[[object], bool]]) -> DataFrame:
    """The rows of `df` whose `column` passes; `test` makes the test once for each task. Batches stay small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = test()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                values = part.column(part.schema.get_field_index(column))
                yield part.filter(pa.array((passes(x.as_py()) for x in values), pa.bool_()))

    return df.mapInArrow(run, T.StructType(df.schema.fields))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key's text form, modulo n; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def join_unique(left: DataFrame, right: DataFrame, on: str, how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Join `left` (stored, any skew) to `right` (one row per key) without sending a hot key to one task.

    Keys that hold at least HOT_SHARE of the left rows number at most 1 / HOT_SHARE; only their right rows are
    broadcast. All other keys take an ordinary shuffle join. `how` is left or inner. `hot`: those keys, if known.
    """
    if hot is None:
        counts = left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
        hot = counts.where(F.col("_n") >= least_hot(left.count())).select(on)
    keys = [r[0] for r in hot.collect()]  # at most 1 / HOT_SHARE rows
    if not keys:
        return left.join(right, on, how)
    is_hot = F.coalesce(F.col(on).isin(*keys), F.lit(False))
    head = left.where(is_hot).join(F.broadcast(right.where(is_hot)), on, how)
    return head.unionByName(left.where(~is_hot).join(right, on, how))


#: Bits of a bitmap for each key that it marks, least and most bits in all; a row has 2 ** ROW_SHIFT of them.
BITS_PER_KEY, LEAST_BITS, MOST_BITS, ROW_SHIFT = 16, 1 << 15, 1 << 27, 15


def bitmap(keys: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """(part, marks), bits: a bitmap of about `n` 64-bit hashes, in rows of 4 KB; 16 MB in all at most, however many keys."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * max(n, 1) - 1).bit_length()))
    at = F.col(key).bitwiseAND(F.lit(bits - 1))
    rows = keys.select(F.shiftright(at, ROW_SHIFT).alias("part"), (at % (1 << ROW_SHIFT)).alias("at"))
    return written(rows.groupBy("part").agg(F.bitmap_construct_agg("at").alias("marks"))), bits


def marked(df: DataFrame, key: str, marks: DataFrame, bits: int, name: str) -> DataFrame:
    """`df` with a flag `name`: whether its `key` may be one of the bitmap's; true for all that are, and for a few others."""
    at = F.col(key).bitwiseAND(F.lit(bits - 1))
    part, row = free_name(df.columns, "part"), free_name(df.columns, "marks")
    byte, bit = F.shiftright(at % (1 << ROW_SHIFT), 3).cast("int"), (at % 8).cast("int")
    held = df.withColumn(part, F.shiftright(at, ROW_SHIFT)).join(F.broadcast(marks.toDF(part, row)), part, "left")
    value = F.conv(F.hex(F.substring(row, byte + 1, F.lit(1))), 16, 10).cast("int")
    flag = F.coalesce(value.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit)) > 0, F.lit(False))
    return held.select(*[held[c] for c in df.columns], flag.alias(name))


def may_have(df: DataFrame, key: str, marks: DataFrame, bits: int) -> DataFrame:
    """The rows of `df` whose `key` may be one of the bitmap's."""
    name = free_name(df.columns, "may_have")
    return marked(df, key, marks, bits, name).where(name).drop(name)


def least_hot(rows: int) -> int:
    """The rows from which a key of a table with so many rows is hot."""
    return max(100, int(rows * HOT_SHARE))
