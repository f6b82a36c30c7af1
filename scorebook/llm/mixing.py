"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. A source with weight w of the active total W owns block j in slots
[floor(j W / w), ceil((j + 1) W / w)): its release time and its deadline. Earliest deadline first among the released
blocks fills one slot after the other, so at every slot each source has had its share to within less than one block.
When a source runs out, the others go on in a new phase with the weights that are left. No row is dropped or repeated.

Weights are exact: integers as they are, others to 2 ** -40 of their sum. Any number of sources will do: beyond
MOST_BLOCKS of them, those that fill no more than one block are scheduled together, with the sum of their weights (none
of them can be off by a block). The schedule has one entry per block and is worked out block by block; blocks grow with
the input, so there are at most about twice MOST_BLOCKS. All work on rows is SQL.

Null source: a source of its own, whose weight has the key None. Sources without a weight get 1; a weight that isn't
positive raises ValueError. Rows with equal ids: each row has its own place, ordered by `tie`; ties beyond that are in
any order. An empty table gives no rows. Texts aren't looked at. Columns of the input keep their names and values; an
added column whose name is taken gets an underscore.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.llm.common import free_name, table, written

#: Least rows of a block; most blocks of the whole mix (beside one partly filled for each source) and most sources that
#: are all scheduled on their own.
BLOCK_ROWS, MOST_BLOCKS = 64, 1 << 17
#: Parts that weights are expressed in unless they are integers.
PARTS = 1 << 40
#: Least rows, and most groups, that are numbered on their own.
LEAST_BUCKET, MOST_BUCKETS = 1000, 200_000
ADDED = ("mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position")


def schedule(blocks: list[int], weights: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, slot, release, deadline) of all blocks in slot order, earliest deadline first.

    Shares add up to one, so a released block is always there. Within a phase, sources that haven't had a block yet wait
    in the order of their first deadlines; those that have run out are skipped by links that get shorter each time they
    are followed. So a phase costs no more than the blocks that it serves.
    """
    left, done = list(blocks), [0] * len(blocks)
    order = sorted((s for s in range(len(blocks)) if left[s]), key=lambda s: (-weights[s], s))
    total, active, start = sum(weights[s] for s in order), len(order), 0
    place, link = {s: n for n, s in enumerate(order)}, list(range(len(order) + 1))

    def alive(n: int) -> int:
        """The first place from n on whose source has blocks left."""
        while link[n] != n:
            link[n] = link[link[n]]
            n = link[n]
        return n

    while active:
        window = lambda s, j: (start + j * total // weights[s], start - (-(j + 1) * total // weights[s]))  # noqa: B023, E731
        had: dict[int, int] = {}
        waiting: list[tuple[int, int]] = []  # by release
        ready: list[tuple[int, int]] = []  # by deadline
        slot, new = start, 0
        while True:
            while waiting and waiting[0][0] <= slot:
                s = heapq.heappop(waiting)[1]
                heapq.heappush(ready, (window(s, had[s])[1], s))
            new = alive(new)
            if new < len(order) and (not ready or (window(order[new], 0)[1], order[new]) < ready[0]):
                s = order[new]
                new += 1
            else:
                s = heapq.heappop(ready)[1]
            j = had.get(s, 0)
            release, deadline = window(s, j)
            yield s, done[s], slot, release, deadline
            had[s] = j + 1
            done[s] += 1
            left[s] -= 1
            slot += 1
            if not left[s]:
                break
            heapq.heappush(waiting, (window(s, j + 1)[0], s))
        start, total, active = slot, total - weights[s], active - 1
        link[place[s]] = place[s] + 1


def whole_weights(weights: list[float], parts: int = PARTS) -> list[int]:
    """Integer weights in the same proportions."""
    if all(w == int(w) for w in weights):
        return [int(w) for w in weights]
    total = sum(weights)
    return [max(1, round(parts * (w / total))) for w in weights]


def target(weights: dict[str | None, float] | None, temperature: float, source: Column, rows: Column) -> Column:
    """The weight of a source: the given one (1 if there is none), or its rows to the power `temperature`."""
    if weights is None:
        return F.pow(rows, F.lit(temperature))
    if not all(w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    given = F.from_json(F.lit(json.dumps({k: float(w) for k, w in weights.items() if k is not None})), "map<string,double>")
    return F.when(source.isNull(), float(weights.get(None, 1))).otherwise(F.coalesce(given[source], F.lit(1.0)))


def mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, source_col: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, temperature: float = 0.5, tie: Column | None = None
) -> DataFrame:
    """`docs` with mix_block, mix_slot, mix_release, mix_deadline and mix_position; order by the last for the mix.

    `weights`: weight per source; by default the source's rows to the power `temperature`. Slots, releases and deadlines
    count from the start of the whole mix. `tie` orders rows with equal ids.
    """
    spark = docs.sparkSession
    col = lambda name: F.col(f"`{name}`")
    own = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(
        *[col(c).alias(o) for c, o in zip(docs.columns, own, strict=True)], col(source_col).cast("string").alias("source"), col(id_col).alias("id"),
        F.xxhash64(col(id_col), F.lit(5)).alias("key"), (F.lit(0) if tie is None else tie).alias("tie"),
    )
    # one row per source, weighed; those scheduled on their own, of which there are no more than blocks, get numbers
    sizes = written(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    n_rows, n_sources = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    block_rows = max(block_rows, -(-n_rows // MOST_BLOCKS))
    alone = F.lit(n_sources <= MOST_BLOCKS) | (F.col("n") > block_rows)
    sizes = sizes.withColumn("w", target(weights, temperature, F.col("source"), F.col("n")))
    large = written(sizes.where(alone).withColumn("sid", F.row_number().over(Window.orderBy("source"))))
    streams = {r.sid: (r.n, r.w) for r in large.select("sid", "n", "w").toLocalIterator()}
    small = sizes.where(~alone).agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    if small.n:
        streams[0] = small.n, small.w
    sids = sorted(streams)
    plan = schedule([-(-streams[s][0] // block_rows) for s in sids], whole_weights([streams[s][1] for s in sids]))
    entries = F.from_json(F.lit(json.dumps([[sids[s], *entry] for s, *entry in plan])), "array<array<bigint>>")
    slots = spark.range(1).select(F.explode(entries).alias("e")).select(*[F.col("e")[i].alias(c) for i, c in enumerate(("sid", "block", "slot", "release", "deadline"))])
    slots = written(slots)  # the plans that use it read a small table
    # numbering within a source: exact offsets of hash buckets, whose number grows with the source, plus places in them
    per_bucket = max(LEAST_BUCKET, n_rows // MOST_BUCKETS)
    named = F.broadcast(large.select(F.col("source").alias("name"), "sid", F.col("n").alias("of")))
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("name")), "left")
    buckets_of = F.ceil(F.coalesce("of", F.lit(small.n or 1)) / F.lit(per_bucket)).cast("long")
    rows = rows.select(*own, "id", "key", "tie", F.coalesce("sid", F.lit(0)).cast("long").alias("sid"), F.pmod(F.shiftright("key", 7), buckets_of).alias("bucket"))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("sid", "bucket").agg(F.count(F.lit(1)).alias("n")).select("sid", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("sid", "bucket").orderBy("key", "id", "tie")
    ordinal = F.col("before") + F.col("at")
    placed = rows.withColumn("at", F.row_number().over(within) - 1).join(offsets, ["sid", "bucket"])
    placed = placed.withColumns({"block": F.floor(ordinal / block_rows).cast("long"), "in_block": ordinal % block_rows})
    values = (F.col("block"), F.col("slot"), F.col("release"), F.col("deadline"), F.col("slot") * block_rows + F.col("in_block"))
    return placed.join(F.broadcast(slots), ["sid", "block"]).select(
        *[F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)], *[v.cast("long").alias(free_name(docs.columns, name)) for name, v in zip(ADDED, values, strict=True)]
    )


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Place of every document in the mix of all sources."""
    docs = written(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mix(docs).select("doc_id", "source", *ADDED)
