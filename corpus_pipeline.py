"""The corpus pipeline: documents pass through five stages, each written as Parquet and reread by the next.

Null, empty and letterless texts go in the first stage; without a labelled text there, all texts with letters stay. A
null id: the document stays where others of its group do. Null sources are a source of their own. Repeated rows with
one id share the fate of their group, so a kept id keeps all its rows. Ties: the smallest id of a group stays. Very long
texts are read whole. An empty documents table gives no rows, an empty benchmark drops nothing. Other columns are carried
up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorebook.llm import decontaminate, langid, minhash, mixing, sharding
from scorebook.llm.common import table, written

#: Target weights of the mix, by source; None: by the sources' rows (see mixing.mix).
WEIGHTS: dict[str | None, float] | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return minhash.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs within its error budget."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def text_key(text_col: str) -> Column:
    """The text's hash, as sharding has it."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixing order: files, and rows within them, follow the schedule of the sources' blocks."""
    mixed = mixing.mix(docs, WEIGHTS, tie=text_key("text"))
    return mixed.orderBy(mixed.columns[-1]).select(docs.columns)  # the position is the last of the added columns


def in_file_order(docs: DataFrame, place: str) -> DataFrame:
    """Stored rows with their place in the files, from 0: the rows of the files before, and the row's own number."""
    meta = docs.metadataColumn("_metadata")
    part = F.regexp_extract(meta["file_name"], r"^part-(\d+)", 1).cast("long")
    rows = docs.select("*", part.alias("_part"), meta["file_name"].alias("_file"), meta["row_index"].alias("_row"))
    ahead = Window.orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = rows.groupBy("_part", "_file").agg(F.count(F.lit(1)).alias("_n"))
    files = files.select("_file", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(files), "_file").withColumn(place, F.col("_before") + F.col("_row")).drop("_part", "_file", "_row", "_before")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document that is left; slots follow the rows' order in the files of the stage before.

    Rows that don't come from files have no order; they are mixed and stored first.
    """
    stored = docs if docs.inputFiles() else written(mix_sources(spark, docs, sf_dir))
    sized = sharding.sized(stored.select("doc_id", "text"))
    return sharding.placed_rows(written(in_file_order(sized, "mix_position")), order_col="mix_position")


STAGES = [
    ("identify_language", identify_language),
    ("drop_near_duplicates", drop_near_duplicates),
    ("drop_benchmark_leaks", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Language mixtures, edit distances and sampled splitters have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: (doc_id, size, text_crc32, shard, slot) of those that remain."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs)
    return docs
