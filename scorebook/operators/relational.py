"""Keyed operators: choosing rows, joins by time and range, set differences, ranks and keys.

Every function takes and returns lazy DataFrames and names its columns by argument. Windows are partitioned by the given
keys, so their groups are as large as those keys' groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.sources.stored import parts, stored


def filled(columns: Sequence[str]) -> Column:
    """How many of the columns aren't null: the quality score of a row."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def best_row(df: DataFrame, keys: Sequence[str], score: Column | None = None, ties: Sequence[Column] = ()) -> DataFrame:
    """One row per key: the highest score (by default the most filled), then `ties` in order. Null keys form groups."""
    score = filled([c for c in df.columns if c not in keys]) if score is None else score
    order = Window.partitionBy(*keys).orderBy(score.desc(), *(ties or [F.col(c).asc_nulls_last() for c in df.columns if c not in keys]))
    return df.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def latest_per_key(df: DataFrame, keys: Sequence[str], times: Sequence[str]) -> DataFrame:
    """The newest row of each key by the first time, then the next ones; rows without a time are older."""
    order = Window.partitionBy(*keys).orderBy(*[F.col(t).desc_nulls_last() for t in times])
    return df.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def prefer(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of all sources; where several have a key, the last source wins."""
    parts = [df.withColumn("_priority", F.lit(i)) for i, df in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.col("_priority").desc())
    return out.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth", "_priority")


def opponents(df: DataFrame, game: str, team: str, side: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Each team's opponent in a game with opponent_ columns: the other side first, then the lowest team id.

    Every row sees the list of its game's rows and takes one of them, so rows are shuffled by game once and no pairs are
    made; rows that are partitioned by game already stay where they are. The list is held in memory.
    """
    columns = list(dict.fromkeys([team, *([side] if side else []), *carry]))
    other = lambda x: x[team] != F.col(team)
    across = lambda x: F.coalesce(F.col(side) != x[side], F.lit(False)) if side else F.lit(False)
    by_team = Window.partitionBy(game).orderBy(team).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = df.where(F.col(game).isNotNull()).withColumn("_all", F.collect_list(F.struct(*columns)).over(by_team))
    first = lambda test: F.get(F.filter("_all", test), F.lit(0))
    found = listed.withColumn("_other", F.coalesce(first(lambda x: other(x) & across(x)), first(other)) if side else first(other)).drop("_all").where("_other is not null")
    pairs = found.withColumns({f"opponent_{c}": F.col(f"_other.{c}") for c in columns}).withColumn("_across", ~across(F.col("_other"))).drop("_other")
    order = Window.partitionBy(game, team).orderBy("_across", f"opponent_{team}")
    return pairs.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth", "_across")


def as_of(facts: DataFrame, versions: DataFrame, fact_id: str, dim_id: str, event_time: str, key: str, out: str, row_id: Sequence[str]) -> DataFrame:
    """Add `out`: the version key that holds at each fact's time.

    Fallbacks: the covering version that starts last (one without a start counts as last of all), else the latest that
    starts before, else the earliest that starts later, else the current one, else the last of all. `row_id` identifies
    a fact row; no step needs it now.

    Where an entity's versions follow one another, the last to start is the answer, and one window finds it; windows are
    cut by month, so a busy entity spreads over tasks. Facts without a time take their entity's one default. Where
    versions overlap, one pass through each cell of time finds the last that covers (`_best_version`); the rest go by
    the last start.
    """
    v = versions.select(F.col(dim_id).alias("_id"), F.col("valid_from_utc").alias("_from"), F.col("valid_to_utc").alias("_to"), F.col("is_current").alias("_now"), F.col(key).alias("_key"))
    follow = F.lead("_from").over(Window.partitionBy("_id").orderBy("_from", "_key"))
    overlaps = F.col("_from").isNull() | (follow.isNotNull() & (F.col("_to").isNull() | (F.col("_to") >= follow) | (F.col("_from") >= follow)))
    odd = v.withColumn("_odd", overlaps).where("_odd").select(F.col("_id").alias("_odd_id")).distinct()
    marked = facts.join(odd, F.col(fact_id) == F.col("_odd_id"), "left")
    timed = F.col(event_time).isNotNull()
    one, default = marked.where(timed & F.col("_odd_id").isNull()).drop("_odd_id"), marked.where(~timed).drop("_odd_id")
    many = marked.where(timed & F.col("_odd_id").isNotNull()).drop("_odd_id")
    start, no_start = F.unix_micros(F.col("_from").cast("timestamp")), F.col("_from").isNull().cast("int")
    current = (F.coalesce(F.col("_now"), F.lit(0)) == 1).cast("int")
    usual = v.groupBy("_id").agg(F.max_by("_key", F.struct(current, no_start, F.coalesce(start, F.lit(0)), "_key")).alias(out))
    default = default.join(usual, F.col(fact_id) == F.col("_id"), "left").drop("_id")
    return _last_started(one, v, fact_id, event_time, out).unionByName(default).unionByName(_best_version(many, v, fact_id, event_time, out))


def _last_started(facts: DataFrame, v: DataFrame, fact_id: str, event_time: str, out: str) -> DataFrame:
    """For timed facts of entities whose versions follow one another: the last to start until then, else the first."""
    at = lambda c: F.col(c).cast("timestamp")
    row = F.struct(*facts.columns)
    f = facts.select(F.col(fact_id).alias("_id"), at(event_time).alias("_t"), F.lit(1).alias("_fact"), F.lit(None).cast(v.schema["_key"].dataType).alias("_key"), row.alias("_row"))
    starts = v.select("_id", at("_from").alias("_t"), F.lit(0).alias("_fact"), "_key", F.lit(None).cast(f.schema["_row"].dataType).alias("_row"))
    both = f.unionByName(starts).withColumn("_month", F.date_trunc("month", "_t"))
    in_month = Window.partitionBy("_id", "_month").orderBy("_t", "_fact", "_key").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_here", F.last("_key", ignorenulls=True).over(in_month)).where("_fact = 1").select("_id", "_month", "_row", "_here")
    # one row per entity and month that either has
    months = both.groupBy("_id", "_month").agg(F.max_by("_key", F.when(F.col("_fact") == 0, F.struct("_t", "_key"))).alias("_last"), F.min_by("_key", F.when(F.col("_fact") == 0, F.struct("_t", "_key"))).alias("_first"))
    by_month = Window.partitionBy("_id").orderBy("_month")
    before, first = F.last("_last", ignorenulls=True).over(by_month.rowsBetween(Window.unboundedPreceding, -1)), F.first("_first", ignorenulls=True).over(by_month.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    months = months.select("_id", "_month", F.coalesce(before, first).alias("_before"))
    joined = found.join(months, ["_id", "_month"], "left")
    return joined.select("_row.*", F.coalesce("_here", "_before").alias(out))


#: Width in microseconds of the cells of time that `_best_version` works through one by one.
CELL = 30 * 86_400_000_000.0


def _covering(ordered: DataFrame, out: T.StructType) -> DataFrame:
    """Of each time the last version that covers it, by one pass over a cell's versions and times in order.

    A version hides those before it that end no later, so the ends of those in sight fall towards the last, and what has
    ended can be taken off there. Versions without a start come before all others and win against them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, endless, begun = None, [], []
        for batch in batches:
            found = []
            for i, c, t, fact, _, key, end in zip(*(x.to_pylist() for x in batch.columns)):
                if (i, c) != cell:
                    cell, endless, begun = (i, c), [], []
                if fact:
                    for seen in (endless, begun):
                        while seen and seen[-1][0] < t:
                            seen.pop()
                    best = endless or begun
                    if best:
                        found.append((i, t, best[-1][1]))
                else:
                    seen = endless if t is None else begun
                    while seen and seen[-1][0] <= end:
                        seen.pop()
                    seen.append((end, key))
            kinds = [batch.schema.field(n).type for n in (0, 2, 5)]
            columns = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["_id", "_t", "_best"])

    return ordered.mapInArrow(run, out)


def _best_version(facts: DataFrame, v: DataFrame, fact_id: str, event_time: str, out: str) -> DataFrame:
    """For timed facts of entities with any versions: the best that covers them, else by starts, else the usual one.

    Time is cut into cells. Of the versions that cover a whole cell only the best matters, which is a sum over them; the
    others start or end in it, so each meets two cells, and `_covering` passes through them and the cell's times.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    at = micros(F.col(event_time))
    times = facts.select(F.col(fact_id).alias("_id"), at.alias("_t")).dropna().distinct().withColumn("_cell", _bin(F.col("_t"), CELL))
    span = times.agg(F.min("_cell"), F.max("_cell")).first()
    first, last = (span[0] or 0) - 1, (span[1] or 0) + 1  # cells without facts stand for all before and after
    start, end, forever = micros(F.col("_from")), micros(F.col("_to")), F.lit(2**63 - 1)
    late = (F.coalesce(F.col("_now"), F.lit(0)) != 1).alias("_late")
    cell = lambda x, else_: F.least(F.greatest(F.coalesce(_bin(x, CELL), F.lit(else_)), F.lit(first)), F.lit(last))
    ranges = v.where(F.col("_from").isNull() | F.col("_to").isNull() | (start <= end))
    ranges = ranges.select("_id", start.alias("_t"), late, "_key", F.coalesce(end, forever).alias("_end"), cell(start, first).alias("_a"), cell(end, last).alias("_b"))
    edges = ranges.withColumn("_cell", F.explode(F.array_distinct(F.array("_a", "_b")))).drop("_a", "_b")
    rank = F.struct(F.col("_t").isNull().alias("none"), F.col("_t"), F.col("_late"), F.col("_key"))
    best = ranges.where("_b - _a > 1").groupBy("_id", "_a", "_b").agg(F.max(rank).alias("_r")).withColumn("_cell", F.explode(F.sequence(F.col("_a") + 1, F.col("_b") - 1)))
    whole = best.groupBy("_id", "_cell").agg(F.max("_r").alias("_r")).select("_id", "_cell", "_r._t", "_r._late", "_r._key", forever.alias("_end"))
    both = edges.unionByName(whole).withColumn("_fact", F.lit(False)).unionByName(times.withColumn("_fact", F.lit(True)), allowMissingColumns=True)
    order = ["_id", "_cell", "_t", "_fact", "_late", "_key"]
    ordered = both.select(*order, "_end").repartition("_id", "_cell").sortWithinPartitions(*order)
    kinds = [T.StructField(n, ordered.schema[c].dataType) for n, c in (("_id", "_id"), ("_t", "_t"), ("_best", "_key"))]
    covered = _covering(ordered, T.StructType(kinds))
    joined = facts.join(covered, (F.col(fact_id) == F.col("_id")) & (at == F.col("_t")), "left").drop("_id", "_t")
    rest = _last_started(joined.where("_best is null").drop("_best"), v.where("_from is not null"), fact_id, event_time, out)
    usual = v.groupBy("_id").agg(F.max_by("_key", F.struct((F.coalesce(F.col("_now"), F.lit(0)) == 1).cast("int"), "_key")).alias("_usual"))
    rest = rest.join(usual, F.col(fact_id) == F.col("_id"), "left").withColumn(out, F.coalesce(out, "_usual")).drop("_id", "_usual")
    return joined.where("_best is not null").withColumnRenamed("_best", out).unionByName(rest)


def _number(df: DataFrame, column: str) -> Column:
    """A column as a number; times in microseconds."""
    kind = df.schema[column].dataType.typeName()
    return F.unix_micros(F.col(column).cast("timestamp")).cast("double") if kind in ("date", "timestamp", "timestamp_ntz") else F.col(column).cast("double")


def _average_length(df: DataFrame, start: str, end: str) -> float:
    return df.agg(F.avg(F.abs(_number(df, end) - _number(df, start)))).first()[0] or 0.0


def _bin(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def _in_bins(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """Each range once in every bin that it meets: about twice as many rows, as bins are as wide as the average range."""
    return df.withColumn("_bin", F.explode(F.sequence(_bin(_number(df, start), width), _bin(_number(df, end), width))))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str, end: str, right_start: str, right_end: str, how: str = "left", small_groups: bool = False) -> DataFrame:
    """Rows of `right` in the same group whose range meets [start, end]: right_end > start and right_start <= end.

    Both sides are cut into bins as wide as the average range, so a group with many ranges spreads over tasks; a pair
    counts in the first bin that both meet. `small_groups`: groups are known to be small and are compared as they are.
    Null keys form a group; ranges with a null end meet nothing.
    """
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(right_end) > F.col(start), F.col(right_start) <= F.col(end)]
    gone = [f"_{k}" for k in keys]
    if small_groups:
        return left.join(r, on, how).drop(*gone)
    width = max(_average_length(left, start, end), _average_length(r, right_start, right_end), 1e-6)
    a, b = _in_bins(left, start, end, width), _in_bins(r, right_start, right_end, width).withColumnRenamed("_bin", "_right_bin")
    first = F.greatest(_bin(_number(left, start), width), _bin(_number(r, right_start), width))
    met = a.join(b, [*on, F.col("_bin") == F.col("_right_bin"), F.col("_bin") == first]).drop(*gone, "_bin", "_right_bin")
    if how == "inner":
        return met
    have = met.select(*[F.col(c).alias(f"_{c}") for c in left.columns]).distinct()
    alone = left.join(have, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in left.columns], "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


def containing(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, end: str, how: str = "left", small_groups: bool = False) -> DataFrame:
    """Ranges of the same group with start <= at < end; bins and `small_groups` as in `overlapping`."""
    r = ranges.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in ranges.columns if c not in keys])
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(at) >= F.col(start), F.col(at) < F.col(end)]
    gone = [f"_{k}" for k in keys]
    if small_groups:
        return points.join(r, on, how).drop(*gone)
    width = max(_average_length(r, start, end), 1e-6)
    binned = _in_bins(r, start, end, width).withColumnRenamed("_bin", "_range_bin")
    p = points.withColumn("_bin", _bin(_number(points, at), width))
    return p.join(binned, [*on, F.col("_bin") == F.col("_range_bin")], how).drop(*gone, "_bin", "_range_bin")


def nearby(points: DataFrame, others: DataFrame, keys: Sequence[str], at: str, before: int, after: int, value: str, row_id: Sequence[str]) -> DataFrame:
    """(row_id, n, least): how many `others` of the same group have a time in (at - before, at + after] microseconds of a point, and their least `value`.

    Both have `keys` and the time `at`. No pair is made: time is cut into blocks as long as that span, so a point's span
    is the end of one block and the beginning of the next, and running sums from both ends of a block give both parts. A
    task holds the rows of a block. Null keys form a group; points without a time meet nothing.
    """
    span = before + after
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    block = F.col("_t") - F.pmod("_t", F.lit(span))
    probe = lambda t, tail: F.struct(t.alias("_t"), F.lit(tail).alias("_tail"))
    ends = points.select(*keys, *row_id, F.explode(F.array(probe(micros - before, True), probe(micros + after, False))).alias("x")).select(*keys, *row_id, "x.*", F.lit(True).alias("_probe"))
    seen = others.select(*keys, micros.alias("_t"), F.col(value).alias("_v"), F.lit(False).alias("_probe")).where("_t is not null")
    both = seen.unionByName(ends, allowMissingColumns=True).withColumn("_block", block)
    both = both.repartition(parts(others) + 2 * parts(points), *keys, "_block")
    # at one time the others come before the probes, so a tail leaves them out and a head has them
    order = [("_t", "_probe"), (F.col("_t").desc(), F.col("_probe").desc())]
    head, tail = (Window.partitionBy(*keys, "_block").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0) for by in order)
    one = F.when(~F.col("_probe"), 1)
    side = lambda f, x: F.when(F.col("_tail"), f(x).over(tail)).otherwise(f(x).over(head))
    found = both.withColumns({"_n": side(F.count, one), "_least": side(F.min, F.col("_v"))}).where("_probe")
    return found.groupBy(*row_id).agg(F.sum("_n").alias("n"), F.min("_least").alias("least"))


def merge_columns(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge; each column is the first non-null one of the sources in order."""
    columns = list(dict.fromkeys(c for df in sources for c in df.columns if c not in keys))
    out = sources[0].select(*keys, *[F.col(c).alias(f"_0_{c}") for c in sources[0].columns if c not in keys])
    for i, df in enumerate(sources[1:], 1):
        out = out.join(df.select(*keys, *[F.col(c).alias(f"_{i}_{c}") for c in df.columns if c not in keys]), list(keys), "full_outer")
    have = lambda c: [F.col(f"_{i}_{c}") for i, df in enumerate(sources) if c in df.columns]
    return out.select(*keys, *[F.coalesce(*have(c)).alias(c) for c in columns])


def linked_row(df: DataFrame, keys: Sequence[str], link: str, number: str, columns: Sequence[str], prefix: str = "linked_") -> DataFrame:
    """Add columns of the row of the same group whose `number` is this row's `link`; the last if several have it.

    A row stands once where it looks, under its link, and once where it is found, under its number, so one window by the
    group finds the links; rows that are dealt by the group stay where they are.
    """
    rest = [c for c in df.columns if c not in keys]
    found, row = F.struct(*columns), F.struct(*rest)
    known = [F.col(c).isNotNull() for c in (*keys, number)]
    looks = F.struct(F.col(link).alias("n"), row.alias("row"), F.when(F.lit(False), found).alias("found"))
    stands = F.struct(F.col(number).alias("n"), F.when(F.lit(False), row).alias("row"), F.when(F.lit(True), found).alias("found"))
    both = df.select(*keys, F.explode(F.when(reduce(Column.__and__, known), F.array(looks, stands)).otherwise(F.array(looks))).alias("_x"))
    best = F.max("_x.found").over(Window.partitionBy(*keys, "_x.n"))
    out = both.withColumn("_found", best).where("_x.row is not null")
    return out.select(*[F.col(c) if c in keys else F.col(f"_x.row.{c}") for c in df.columns], *[F.col(f"_found.{c}").alias(prefix + c) for c in columns])


def missing_keys(source: DataFrame, target: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct source keys that the target lacks; `pairs` maps source columns to target columns."""
    s = source.select(*[F.col(a) for a, _ in pairs]).dropna().distinct()
    t = target.select(*[F.col(b).alias(a) for a, b in pairs]).distinct()
    return s.join(t, [a for a, _ in pairs], "left_anti")


def overlap_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct keys in both, left only, right only, and the share in both."""
    a = left.select(*keys).dropna().distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).dropna().distinct().withColumn("_r", F.lit(1))
    both = F.sum(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1).otherwise(0))
    one = lambda c, d: F.sum(F.when(F.col(c).isNotNull() & F.col(d).isNull(), 1).otherwise(0))
    out = a.join(b, list(keys), "full_outer").agg(both.alias("in_both"), one("_l", "_r").alias("left_only"), one("_r", "_l").alias("right_only"))
    return out.withColumn("overlap_ratio", F.try_divide(F.col("in_both"), F.col("in_both") + F.col("left_only") + F.col("right_only")))


def work_list(wanted: DataFrame, existing: DataFrame, key: str, order: Sequence[Column], cap: int | None = None) -> DataFrame:
    """Wanted rows that don't exist yet, the first `cap` of them in order."""
    left = wanted.join(existing.select(key).distinct(), key, "left_anti").orderBy(*order)
    return left.limit(cap) if cap is not None else left


def primary_team(df: DataFrame, keys: Sequence[str], team: str, played: Column) -> DataFrame:
    """Per key the team with most games played, then most rows, then the lowest id."""
    per_team = df.groupBy(*keys, team).agg(F.sum(played.cast("int")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    return per_team.groupBy(*keys).agg(F.max_by(team, F.struct("_p", "_n", -F.col(team))).alias("primary_team"), F.count(F.lit(1)).alias("teams"))


def counted_by_label(df: DataFrame, keys: Sequence[str], label: Column, labels: Sequence[str], made: Column, unknown: str = "unmapped") -> DataFrame:
    """attempts_<label> and makes_<label> per key; labels outside the list count as `unknown`."""
    known = F.when(label.isin(*labels), label).otherwise(unknown)
    agg = []
    for x in [*labels, unknown]:
        hit = known == x
        agg += [F.sum(F.when(hit, 1).otherwise(0)).alias(f"attempts_{x}"), F.sum(F.when(hit & made, 1).otherwise(0)).alias(f"makes_{x}")]
    return df.groupBy(*keys).agg(*agg)


def category_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], least: int = 10) -> DataFrame:
    """Per key: rows with two, three and four or more columns of at least `least`."""
    n = sum((F.coalesce((F.col(c) >= least).cast("int"), F.lit(0)) for c in columns), F.lit(0))
    return df.groupBy(*keys).agg(*[F.sum(F.when(n >= k, 1).otherwise(0)).alias(name) for k, name in ((2, "double_doubles"), (3, "triple_doubles"), (4, "quadruple_doubles"))])


#: A value with at least this share of the ranked rows is hot; so there are at most 1 / share of them.
HOT_VALUE = 1 / 2000


def ranked_values(rows: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, n, upto, total): for each distinct value its rows, those up to it and those of its group.

    Rows are summed by value first, so a tie is one row. Values are range-partitioned; a place is the sum within its
    range plus what the group has in the ranges before, so a group of any size is ranked by all tasks.
    """
    by = [*groups, value]
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    ranged = stored(sums.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()))
    ahead = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a group and range
    spans = ranged.groupBy(*groups, "_p").agg(F.sum("n").alias("_n"))
    spans = spans.withColumns({"_before": F.coalesce(F.sum("_n").over(ahead), F.lit(0)), "total": F.sum("_n").over(Window.partitionBy(*groups))}).drop("_n")
    upto = F.sum("n").over(Window.partitionBy(*groups, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_upto", upto).join(spans, [*groups, "_p"]).select(*by, "n", (F.col("_before") + F.col("_upto")).alias("upto"), "total")


def percentiles(df: DataFrame, groups: Sequence[str], specs: Sequence[tuple[str, str, bool, Column | None]], row_id: Sequence[str]) -> DataFrame:
    """Add a percentile 0 to 100 for each spec (source, output, lower is better, eligible).

    Ties take the highest rank; one eligible row alone gets 100; ineligible and null rows get null. All metrics are
    stacked and ranked by `ranked_values`; rows get their value's percentile by a join, hot values by a broadcast of at
    most 1 / HOT_VALUE rows. `row_id` identifies a row within its group; groups aren't null.
    """
    value = lambda s, lower: F.when(F.lit(True), F.col(s).cast("double") * (-1 if lower else 1))
    stacked = [F.struct(F.lit(out).alias("m"), F.when(ok if ok is not None else F.lit(True), value(s, lower)).alias("v")) for s, out, lower, ok in specs]
    long = df.select(*row_id, *groups, F.explode(F.array(*stacked)).alias("x")).select(*row_id, *groups, "x.m", (F.col("x.v") + F.lit(0.0)).alias("v")).where("v is not null")
    by = [*groups, "m"]
    n = F.col("total")
    places = stored(ranked_values(long, by, "v").withColumn("p", F.when(n == 1, 100).otherwise(F.bround(100.0 * (F.col("upto") - 1) / (n - 1)).cast("int"))))
    least = max(100, int((places.agg(F.sum("n")).first()[0] or 0) * HOT_VALUE))
    hot = F.broadcast(places.where(F.col("n") >= least).select(*by, "v", F.col("p").alias("_hot")))
    marked = long.join(hot, [*by, "v"], "left")
    cold = marked.where("_hot is null").drop("_hot").join(places.where(F.col("n") < least).select(*by, "v", "p"), [*by, "v"])
    placed = marked.where("_hot is not null").withColumnRenamed("_hot", "p").unionByName(cold)
    wide = placed.groupBy(*row_id, *groups).agg(*[F.max(F.when(F.col("m") == out, F.col("p"))).alias(out) for _, out, _, _ in specs])
    return df.join(wide, [*row_id, *groups], "left")


def surrogate_keys(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Dense numbers from 1 in sorted order, nulls last, numbered range by range instead of in one task.

    The ranges are stored once in the shared folder, since the counts and the numbers need the same ones.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    ranged = stored(df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_p").orderBy(*by)
    out = ranged.withColumn("_n", F.row_number().over(within)).join(F.broadcast(offsets), "_p")
    return out.withColumn(name, (F.col("_before") + F.col("_n")).cast("long")).drop("_p", "_n", "_before")


def adjacent_merged(df: DataFrame, keys: Sequence[str], order: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Runs of neighbouring rows that agree in `same` become one: the first order values, the last non-null of the rest."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    start = (F.row_number().over(w) == 1) | changed
    runs = df.withColumn("_run", F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rest = [c for c in df.columns if c not in (*keys, *order, *same)]
    at = F.struct(*order)
    merged = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest]
    return runs.groupBy(*keys, "_run").agg(*[F.min_by(c, at).alias(c) for c in (*order, *same)], *merged, F.count(F.lit(1)).alias("merged_rows")).drop("_run")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "island") -> DataFrame:
    """Number the runs of neighbouring rows with an equal value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return df.withColumn(name, F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def first_non_null(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key, each column's first non-null value in order."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])
