"""Exact deduplication by an extendible-hash index on shared files.

A text's key is a 64-bit hash of it, normalised. The index holds an entry for each key that repeats. Its directory is
addressed by leading bits of the key and doubles until every bucket holds no more than its capacity in bytes, so a bucket
is a key range of its own depth, and an overfull range splits while others stay. Owner tasks take whole buckets: an entry
keeps a chain of the different texts of its key, compared byte by byte. Hot keys, which no doubling can split, have their
copies compared where they lie before one row for each text and task moves on. Texts of keys that don't repeat stay where
they are: a bitmap of a bounded size, made from the entries, tells them.

Texts are equal when identical after lower-casing A-Z. Null: empty, and so equal to empty texts. Of equal texts, the row
with the largest id stays (a null id is less than all others); of rows that also share that id, exactly one. Repeated
rows count as rows. An empty table gives no rows. Very long texts are read whole; only those of repeating keys move, once.
Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import bitmap, free_name, join_unique, least_hot, may_have, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Leading bits of the key that the directory looks at when it has doubled most; least bytes that a bucket may hold, and
#: the part of all bytes from which it may hold more.
MOST_DOUBLINGS, LEAST_CAPACITY, MOST_BUCKETS = 16, 256 << 10, 1 << 14


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def slot_of(key: Column) -> Column:
    """The key's slot in the directory after all doublings."""
    return F.shiftrightunsigned(key, 64 - MOST_DOUBLINGS)


def directory(entries: DataFrame, least: int = LEAST_CAPACITY) -> DataFrame:
    """(slot, bucket, depth): the bucket of each slot that has entries (key, bytes), named by its first slot.

    After d doublings a slot's bucket is all keys that share d leading bits; the first doubling at which that fits is the
    bucket's depth. The sums of all doublings have at most 2 ** (MOST_DOUBLINGS + 1) rows.
    """
    slots = entries.groupBy(slot_of(F.col("key")).alias("slot")).agg(F.sum("bytes").alias("bytes"))
    room = max(least, (entries.agg(F.sum("bytes")).first()[0] or 0) // MOST_BUCKETS)
    doubled = slots.select("slot", "bytes", F.explode(F.sequence(F.lit(0), F.lit(MOST_DOUBLINGS))).alias("depth"))
    first = F.expr(f"shiftleft(shiftright(slot, {MOST_DOUBLINGS} - depth), {MOST_DOUBLINGS} - depth)")
    doubled = doubled.withColumn("bucket", first)
    held = doubled.groupBy("depth", "bucket").agg(F.sum("bytes").alias("held"))
    fitting = held.where(f"held <= {room} or depth = {MOST_DOUBLINGS}").select("depth", "bucket")
    return doubled.join(fitting, ["depth", "bucket"]).groupBy("slot").agg(F.min(F.struct("depth", "bucket")).alias("b")).select("slot", "b.bucket", "b.depth")


def chains(texts: DataFrame, entries: DataFrame, hot: DataFrame) -> DataFrame:
    """(bucket, key, links): how many different texts each key's chain has; texts (key, norm), entries (key, bytes)."""
    keys = [r[0] for r in hot.collect()]  # at most 1 / HOT_SHARE
    is_hot = F.col("key").isin(*keys) if keys else F.lit(False)
    cold = texts.where(~is_hot).withColumn("slot", slot_of(F.col("key")))
    owned = cold.join(F.broadcast(directory(entries.where(~is_hot))), "slot", "left").select(F.coalesce("bucket", "slot").alias("bucket"), "key", "norm")
    links = owned.repartition("bucket").groupBy("bucket", "key", "norm").agg(F.count(F.lit(1)).alias("n"))
    out = links.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("links"))
    if keys:
        links = texts.where(is_hot).groupBy("key", "norm").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(links.groupBy(slot_of(F.col("key")).alias("bucket"), "key").agg(F.count(F.lit(1)).alias("links")))
    return out


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, row_col: str | None = None) -> DataFrame:
    """(id, row, keep_id, group_size, kept, sha256) for every row of `docs`.

    `key_bits` of the hash make the key. `row_col`: a column that numbers the rows; by default they are numbered here.
    """
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    norm = normalised(F.col(text_col))
    key = F.shiftleft(F.xxhash64("norm"), 64 - key_bits).alias("key")
    rows = docs.select(F.col(id_col).alias("id"), row.alias("row"), norm.alias("norm"))
    rows = written(rows.select("id", "row", key, F.octet_length("norm").cast("long").alias("bytes"), F.unhex(F.sha2("norm", 256)).alias("sha")))
    group = (F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("top"))
    entries = written(rows.groupBy("key").agg(*group, F.sum("bytes").alias("bytes")).where("n > 1"))
    n_rows, n_entries = rows.count(), entries.count()
    hot = written(entries.where(F.col("n") >= least_hot(n_rows)).select("key"))
    marks, bits = bitmap(entries.select("key"), "key", n_entries)
    texts = docs.select(norm.alias("norm")).select("norm", key)
    chained = written(chains(may_have(texts, "key", marks, bits), entries, hot).where("links > 1").select("key"))
    columns = ["id", "row", F.coalesce("n", F.lit(1)).alias("group_size"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("keep_id"), F.coalesce(F.col("top.row") == F.col("row"), F.lit(True)).alias("kept"), "sha"]
    if chained.isEmpty():
        return join_unique(rows, entries.select("key", "n", "top"), "key", "left", hot).select(*columns)
    # keys whose chains have several links: a link has the rows of one text, told by the digest of its bytes
    alone = written(entries.join(chained, "key", "left_anti").select("key", "n", "top"))
    linked = written(join_unique(rows, chained.withColumn("linked", F.lit(True)), "key", "left", hot))
    links = written(linked.where("linked").groupBy("sha").agg(*group))
    out = join_unique(written(linked.where("linked is null").drop("linked")), alone, "key", "left").select(*columns)
    return out.unionByName(join_unique(written(linked.where("linked").drop("linked")), links, "sha", "left").select(*columns))


def keep_last(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of equal texts the one with the largest id."""
    name = free_name(docs.columns, "row")
    docs_ = written(docs.withColumn(name, F.monotonically_increasing_id()))
    dropped = copies(docs_, id_col, text_col, row_col=name).where(~F.col("kept")).select(F.col("row").alias(name))
    return docs_.join(written(dropped), name, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents, and the row of each that stays."""
    out = copies(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP11_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
