"""Sharding by sampled splitters.

Records are keyed by a hash of their text. A size-weighted sample of the keys gives quantile boundaries that cut the key
space into fine ranges; every record goes to its range; the ranges' exact sizes are measured, and an overfull one is
subdivided by a second key. Runs of whole ranges then become shards of nearly equal bytes. Equal texts share a range,
and so a shard, unless their range is overfull (a hot group) and a shard boundary falls within it.

Null text: size 1, hashed like the empty text. Repeated rows and equal ids: each row has its own slot; their order is by
key, second key and id, or by a given order (the pipeline's mix). An empty table gives no rows. Text length matters only
as a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.llm.common import table, written

#: Shards; fine ranges of all shards, least and most, and the rows that one should have in between.
SHARDS, LEAST_RANGES, MOST_RANGES, ROWS_PER_RANGE = 8, 512, 1 << 17, 100_000
#: Sampled keys per fine range; a range over OVERFULL x its fair size is subdivided.
SAMPLES_PER_RANGE, OVERFULL = 16, 2.0
#: The splitters are found through this many high bits of the key.
PREFIX_BITS = 12
#: Rows in given order that are numbered at once within a shard: least places, and most groups of places.
LEAST_SPAN, MOST_SPANS = 8192, 1 << 14


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id, size, text_crc32, key, second, more): what sharding needs of each record; the texts aren't moved."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        F.xxhash64(text).alias("_key"),
        F.xxhash64(F.col(id_col), F.lit(7)).alias("_second"),
        *more,
    )


def splitters(rows: DataFrame, total: Column, ranges: int) -> DataFrame:
    """(_lo, _hi, _range): fine key ranges whose boundaries are quantiles of a size-weighted key sample.

    A record is drawn with probability size / step, where step spaces SAMPLES_PER_RANGE draws over a fair range; larger
    records are drawn with weight size / step. The sample has about ranges x SAMPLES_PER_RANGE keys, whatever the input.
    """
    step = total / F.lit(ranges * SAMPLES_PER_RANGE)
    draw = F.pmod(F.xxhash64("_key", "_second", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < F.col("_size") / step).select("_key", F.greatest(F.col("_size") / step, F.lit(1.0)).alias("_w"))
    # the sample is bounded, so one window over it is too
    along = Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sample.groupBy("_key").agg(F.sum("_w").alias("_w")).withColumn("_cum", F.sum("_w").over(along))
    cut = F.floor(F.col("_cum") / F.lit(SAMPLES_PER_RANGE))
    bounds = ranked.withColumn("_cut", cut).groupBy("_cut").agg(F.max("_key").alias("_lo")).where("_cut > 0").select("_lo")
    first = rows.sparkSession.range(1).select(F.lit(-(1 << 63)).cast("long").alias("_lo"))
    order = Window.orderBy("_lo")
    return (
        first.unionByName(bounds).distinct()
        .select("_lo", F.lead("_lo").over(order).alias("_hi"), (F.row_number().over(order) - 1).alias("_range"))
    )


def ranged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add each row's fine range. Splitters are spread over key prefixes, so a row meets only its prefix's few."""
    shift = 64 - PREFIX_BITS
    prefix = lambda c: F.shiftright(c, shift)
    last = F.coalesce(F.col("_hi") - 1, F.lit((1 << 63) - 1))
    spread = cuts.withColumn("_p", F.explode(F.sequence(prefix(F.col("_lo")), prefix(last))))
    inside = (F.col("_key") >= F.col("_lo")) & (F.col("_hi").isNull() | (F.col("_key") < F.col("_hi")))
    rows = rows.withColumn("_p", prefix(F.col("_key")))
    # at most 2 ** PREFIX_BITS + ranges rows are broadcast
    return rows.join(F.broadcast(spread), (rows["_p"] == spread["_p"]) & inside).select(*[rows[c] for c in rows.columns if c != "_p"], "_range")


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(id, size, text_crc32, shard, slot): shards of nearly equal bytes; slots are gapless from 0 in each shard."""
    return placed_rows(written(sized(docs, id_col, text_col)), id_col, shards)


def placed_rows(rows: DataFrame, id_col: str = "doc_id", shards: int = SHARDS, order_col: str | None = None) -> DataFrame:
    """`shard_by_bytes` of stored `sized` rows; with `order_col` (unique places from 0) slots follow it in each shard."""
    total, n = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, n // ROWS_PER_RANGE))
    rows = ranged(rows, splitters(rows, F.lit(float(max(total, 1))), ranges))
    fair = max(1.0, total / ranges)
    # exact sizes of the ranges, one row each; overfull ones are cut by the second key
    parts = F.when(F.col("_bytes") > OVERFULL * fair, F.ceil(F.col("_bytes") / F.lit(fair))).otherwise(F.lit(1)).cast("long")
    measured = rows.groupBy("_range").agg(F.sum("_size").alias("_bytes")).select("_range", parts.alias("_parts"))
    rows = rows.join(F.broadcast(measured), "_range").withColumn("_part", F.pmod("_second", "_parts"))
    rows = written(rows.drop("_parts"))
    exact = rows.groupBy("_range", "_part").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    # one row per part: at most 3 x ranges of them
    along = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = exact.withColumn("_before", F.coalesce(F.sum("_bytes").over(along), F.lit(0)))
    middle = (F.col("_before") + F.col("_bytes") / 2) * shards / F.lit(float(max(total, 1)))
    placed = placed.withColumn("shard", F.least(F.floor(middle), F.lit(shards - 1)).cast("int"))
    ahead = Window.partitionBy("shard").orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("_range", "_part", "shard", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_first"))
    if order_col is None:
        within = Window.partitionBy("_range", "_part").orderBy("_key", "_second", "_id", "_size")
        numbered = rows.withColumn("_n", F.row_number().over(within) - 1).join(F.broadcast(placed), ["_range", "_part"])
    else:
        numbered = in_order(rows.join(F.broadcast(placed.drop("_first")), ["_range", "_part"]), order_col, n)
    return numbered.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        "shard",
        (F.col("_first") + F.col("_n")).cast("long").alias("slot"),
    )


def in_order(rows: DataFrame, order_col: str, n: int) -> DataFrame:
    """Add _first and _n, whose sum is the row's place by `order_col` in its shard: exact offsets of spans of places."""
    rows = rows.withColumn("_span", F.floor(F.col(order_col) / F.lit(max(LEAST_SPAN, n // MOST_SPANS))))
    ahead = Window.partitionBy("shard").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard and span, about MOST_SPANS x shards at most
    spans = rows.groupBy("shard", "_span").agg(F.count(F.lit(1)).alias("_rows"))
    first = spans.select("shard", "_span", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_span").orderBy(order_col)
    return rows.withColumn("_n", F.row_number().over(within) - 1).join(F.broadcast(first), ["shard", "_span"])


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
