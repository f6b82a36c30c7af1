"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def layers_root(spark: SparkSession, prefix: str = "layer") -> str:
    """This application's folder for layers in the one that driver and executors share, which the cluster names in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.gettempdir() + "/checkpoints")
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{prefix}-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, prefix: str = "layer") -> str:
    """A new folder path within `layers_root`."""
    return f"{layers_root(spark, prefix)}/{uuid.uuid4().hex}"


def clear_layers(spark: SparkSession, prefix: str = "layer") -> None:
    """Delete all layers of this application; results that build on them and aren't saved yet are lost with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(layers_root(spark, prefix))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet under spark.checkpoint.dir and read it back.

    Layers that many results build on (enriched events, stints, possessions) are worked out once that way; the files
    outlive lost executors.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a part of `dealt`: a task sorts its part several times, in wider forms, and holds up to two of them at once.
PART_ROWS = 20_000


def parts(df: DataFrame, rows: int | None = None) -> int:
    """How many parts of about `rows` (PART_ROWS) rows `df` makes, a scan whose rows cost little to count."""
    return max(1, math.ceil(df.count() / (rows or PART_ROWS)))


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """`df`, a scan whose rows cost little to count, dealt by keys to parts of about `rows` (PART_ROWS) rows.

    Parts grow in number with the input, not in size; left to itself, Spark merges shuffled rows by their packed bytes.
    """
    return df.repartition(parts(df, rows), *keys)
