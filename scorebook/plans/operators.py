"""Registered queries of the keyed operators, dimensions, quality, linkage and increments, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.functions import dates, sport, text
from scorebook.operators import dimensions, incremental, linkage, quality, semantic
from scorebook.operators import relational as r
from scorebook.plans.demo import tables
from scorebook.sources.stored import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(tables(spark, d), spark, d)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def team_rows(t) -> DataFrame:
    """Team games: the suppliers of an order, with sums of their lines; every other one plays at home."""
    return t["lineitem"].groupBy(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("team_id")).agg(F.sum("l_quantity").alias("points"), F.count(F.lit(1)).alias("lines")).withColumn("team_side", F.when(F.col("team_id") % 2 == 0, "home").otherwise("away"))


TEAMS = "(SELECT l_orderkey AS game_id, l_suppkey AS team_id, sum(l_quantity) AS points, count(*) AS lines, CASE WHEN l_suppkey % 2 = 0 THEN 'home' ELSE 'away' END AS team_side FROM lineitem GROUP BY ALL)"


# ---------------------------------------------------------------- joins


@query(f"""
SELECT game_id, team_id, points, opponent_team_id, opponent_points, points - opponent_points AS point_differential, CASE WHEN points > opponent_points THEN 'win' WHEN points < opponent_points THEN 'loss' ELSE 'tie' END AS result
FROM (SELECT a.game_id, a.team_id, a.points, b.team_id AS opponent_team_id, b.points AS opponent_points, row_number() OVER (PARTITION BY a.game_id, a.team_id ORDER BY CASE WHEN a.team_side <> b.team_side THEN 0 ELSE 1 END, b.team_id) AS k FROM {TEAMS} a JOIN {TEAMS} b ON a.game_id = b.game_id AND a.team_id <> b.team_id) WHERE k = 1
""")
def opponent_facts(t, spark, d):
    """Team games with their opponent: the other side first, then the lowest id."""
    out = dimensions.team_game_facts(team_rows(t), "game_id", "team_id", "points", "team_side")
    return out.select("game_id", "team_id", "points", "opponent_team_id", "opponent_points", "point_differential", "result")


VERSIONS = """
(WITH e AS (SELECT user_id, ts, event_id, event_type, value, lag(event_type) OVER w AS was, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT *, sum(CASE WHEN n = 1 OR was <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM e),
g AS (SELECT user_id, version, min(event_type) AS event_type, min(ts) AS valid_from_utc FROM v GROUP BY user_id, version)
SELECT user_id, CAST(version AS BIGINT) AS version, event_type, valid_from_utc, lead(valid_from_utc) OVER w - INTERVAL 1 MICROSECOND AS valid_to_utc, CASE WHEN lead(version) OVER w IS NULL THEN 1 ELSE 0 END AS is_current FROM g WINDOW w AS (PARTITION BY user_id ORDER BY version))
"""


@query(f"SELECT user_id, version, event_type, valid_from_utc, valid_to_utc, CAST(is_current AS INTEGER) AS is_current, CAST((SELECT min(CAST(ts AS DATE)) FROM events e WHERE e.user_id = v.user_id) AS DATE) AS first_seen, CAST((SELECT max(CAST(ts AS DATE)) FROM events e WHERE e.user_id = v.user_id) AS DATE) AS last_seen FROM {VERSIONS} v")
def scd2_versions(t, spark, d):
    """Type-2 versions of a user's event type."""
    e = t["events"].withColumn("day", F.to_date("ts"))
    return dimensions.versions(e, "user_id", ["event_type"], "ts", order=["ts", "event_id"], day="day").drop("record_source")


@query(f"""
WITH v AS {VERSIONS}, f AS (SELECT event_id, user_id, ts - INTERVAL 36 HOUR AS at_ts FROM events),
c AS (SELECT event_id, version, valid_from_utc, CASE WHEN valid_from_utc <= at_ts AND (valid_to_utc IS NULL OR at_ts <= valid_to_utc) THEN 5 WHEN valid_from_utc <= at_ts THEN 4 ELSE 3 END AS level FROM f JOIN v ON f.user_id = v.user_id)
SELECT event_id, version AS version_key FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY level DESC, CASE WHEN level = 3 THEN valid_from_utc END, valid_from_utc DESC, version DESC) AS k FROM c) WHERE k = 1
""")
def as_of_versions(t, spark, d):
    """The version that held 36 hours before each event, with the fallbacks."""
    v = dimensions.versions(t["events"], "user_id", ["event_type"], "ts", order=["ts", "event_id"])
    f = t["events"].select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 36 HOURS")).alias("at"))
    return r.as_of(f, v, "user_id", "user_id", "at", "version", "version_key", ["event_id"]).select("event_id", "version_key")


STINTS = "(SELECT user_id, island, min(event_id) AS s, max(event_id) + 1 AS e FROM (SELECT user_id, event_id, CAST(ts AS DATE) AS island FROM events) GROUP BY user_id, island)"


def day_stints(t) -> DataFrame:
    e = t["events"].select("user_id", "event_id", F.to_date("ts").alias("island"))
    return e.groupBy("user_id", "island").agg(F.min("event_id").alias("s"), (F.max("event_id") + 1).alias("e"))


@query(f"""
WITH p AS (SELECT user_id, event_id AS a, event_id + 400 AS b FROM events WHERE event_type = 'purchase')
SELECT p.user_id, a, count(s) AS met FROM p LEFT JOIN {STINTS} x ON p.user_id = x.user_id AND x.e > p.a AND x.s <= p.b GROUP BY ALL
""")
def range_overlap(t, spark, d):
    """Ranges of a user that meet the range after each purchase."""
    p = t["events"].where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + 400).alias("b"))
    return r.overlapping(p, day_stints(t), ["user_id"], "a", "b", "s", "e").groupBy("user_id", "a").agg(F.count("s").alias("met"))


@query(f"SELECT v.event_id, x.island FROM events v LEFT JOIN {STINTS} x ON v.user_id = x.user_id AND v.event_id >= x.s AND v.event_id < x.e WHERE v.event_type = 'error'")
def point_in_range(t, spark, d):
    p = t["events"].where("event_type = 'error'").select("user_id", "event_id")
    return r.containing(p, day_stints(t), ["user_id"], "event_id", "s", "e").select("event_id", "island")


@query("""
WITH a AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM customer WHERE c_mktsegment <> 'MACHINERY'), b AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal AS bal FROM supplier)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.name, b.name) AS name, coalesce(a.bal, b.bal) AS bal FROM a FULL JOIN b ON a.id = b.id
""")
def merge_precedence(t, spark, d):
    """Two sources merged; the first non-null value of each column wins."""
    a = t["customer"].where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"))
    b = t["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return r.merge_columns([a, b], ["id"])


@query("SELECT a.event_id, b.event_id AS linked_event_id, b.value AS linked_value FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_id = a.event_id - 7")
def linked_events(t, spark, d):
    e = t["events"].select("user_id", "event_id", "value", (F.col("event_id") - 7).alias("link"))
    return r.linked_row(e, ["user_id"], "link", "event_id", ["event_id", "value"]).select("event_id", "linked_event_id", "linked_value")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def missing_keys(t, spark, d):
    return r.missing_keys(t["customer"], t["orders"].where("o_totalprice > 400000"), [("c_custkey", "o_custkey")])


@query(f"SELECT count(*) AS rows, count(DISTINCT user_id) AS users FROM events e WHERE EXISTS (SELECT 1 FROM {VERSIONS} v WHERE v.user_id = e.user_id AND v.is_current = 1 AND v.event_type = 'click')")
def current_members(t, spark, d):
    """Rows of users whose current state is click."""
    v = dimensions.versions(t["events"], "user_id", ["event_type"], "ts", order=["ts", "event_id"]).where("is_current = 1 and event_type = 'click'")
    return t["events"].join(v, "user_id", "left_semi").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users"))


@query("SELECT p_partkey, s_suppkey FROM part JOIN (SELECT l_partkey, l_suppkey AS s_suppkey FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY sum(l_quantity) DESC, l_suppkey) AS k FROM lineitem GROUP BY l_partkey, l_suppkey) WHERE k = 1) ON p_partkey = l_partkey")
def bridge_best(t, spark, d):
    """Each part with the supplier that it is most surely linked to."""
    links = t["lineitem"].groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("confidence"))
    return dimensions.bridge(t["part"].select("p_partkey"), links, "p_partkey", "s_suppkey", "confidence")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def live_over_historical(t, spark, d):
    return r.prefer([t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), t["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))], ["id"])


# ---------------------------------------------------------------- aggregates and windows


@query("""
SELECT o_custkey, CAST(sum(CASE WHEN p = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS "attempts_1-URGENT", CAST(sum(CASE WHEN p = '1-URGENT' AND won THEN 1 ELSE 0 END) AS BIGINT) AS "makes_1-URGENT",
  CAST(sum(CASE WHEN p = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS "attempts_2-HIGH", CAST(sum(CASE WHEN p = '2-HIGH' AND won THEN 1 ELSE 0 END) AS BIGINT) AS "makes_2-HIGH",
  CAST(sum(CASE WHEN p = 'unmapped' THEN 1 ELSE 0 END) AS BIGINT) AS attempts_unmapped, CAST(sum(CASE WHEN p = 'unmapped' AND won THEN 1 ELSE 0 END) AS BIGINT) AS makes_unmapped
FROM (SELECT o_custkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'unmapped' END AS p, o_orderstatus = 'F' AS won FROM orders) GROUP BY o_custkey
""")
def label_pivot(t, spark, d):
    return r.counted_by_label(t["orders"], ["o_custkey"], F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"], F.col("o_orderstatus") == "F")


@query("SELECT l_suppkey, CAST(sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS double_doubles, CAST(sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS triple_doubles, CAST(sum(CASE WHEN n >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS quadruple_doubles FROM (SELECT l_suppkey, (CASE WHEN l_quantity >= 10 THEN 1 ELSE 0 END) + (CASE WHEN l_extendedprice >= 10 THEN 1 ELSE 0 END) + (CASE WHEN l_linenumber >= 10 THEN 1 ELSE 0 END) + (CASE WHEN l_partkey >= 10 THEN 1 ELSE 0 END) AS n FROM lineitem) GROUP BY l_suppkey")
def category_counts(t, spark, d):
    return r.category_counts(t["lineitem"], ["l_suppkey"], ["l_quantity", "l_extendedprice", "l_linenumber", "l_partkey"])


@query("SELECT l_partkey, arg_max(l_suppkey, (p, n, -l_suppkey)) AS primary_team, count(*) AS teams FROM (SELECT l_partkey, l_suppkey, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS p, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_partkey")
def primary_team(t, spark, d):
    return r.primary_team(t["lineitem"], ["l_partkey"], "l_suppkey", F.col("l_quantity") > 25)


@query("SELECT user_id, bool_or(event_type = 'error') AS any_error, arg_min(CASE WHEN value > 20 THEN value END, event_id) AS first_large FROM events WHERE event_type <> 'view' AND (event_type = 'error' OR value > 20) GROUP BY user_id")
def any_and_first(t, spark, d):
    """A flag over a group's events, and the first non-null value in order."""
    e = t["events"].where("event_type <> 'view' and (event_type = 'error' or value > 20)").withColumn("large", F.when(F.col("value") > 20, F.col("value")))
    first = r.first_non_null(e, ["user_id"], ["event_id"], ["large"]).withColumnRenamed("large", "first_large")
    return e.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("any_error")).join(first, "user_id")


PROFILE = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS non_null, CAST(min({c}) AS DOUBLE) AS minimum, CAST(max({c}) AS DOUBLE) AS maximum, count({c}) > 0 AND NOT (min({c}) = 0 AND max({c}) = 0) AS is_populated, CASE WHEN '{c}' IN ('l_tax') THEN 'unexposed' ELSE 'populated' END AS exposure FROM lineitem" for c in PROFILE))
def column_profile(t, spark, d):
    return quality.metric_exposure(quality.column_profile(t["lineitem"], PROFILE), ["l_quantity", "l_discount", "l_linenumber"])


@query("SELECT 'lineitem' AS artifact_id, count(*) AS total_rows, count(DISTINCT l_orderkey || '|' || l_linenumber) AS distinct_grains, CAST(0 AS INTEGER) AS null_key_rows, count(*) - count(DISTINCT l_orderkey || '|' || l_linenumber) AS duplicate_rows, CASE WHEN count(*) > count(DISTINCT l_orderkey || '|' || l_linenumber) THEN 'failed' ELSE 'ok' END AS status FROM lineitem")
def grain_check(t, spark, d):
    return quality.grain_check(t["lineitem"], ["l_orderkey", "l_linenumber"], "lineitem").withColumn("null_key_rows", F.col("null_key_rows").cast("int"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS games_played, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(100 * (CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS DOUBLE) / count(*)), 1) AS hit_percentage, CAST(sum(l_linenumber) AS DOUBLE) / count(*) AS mean_line FROM lineitem GROUP BY ALL")
def ratio_of_sums(t, spark, d):
    g = t["lineitem"].groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("games_played"), F.sum(F.when(F.col("l_quantity") > 25, 1).otherwise(0)).alias("hits"), F.sum("l_linenumber").alias("lines"))
    return g.select("l_returnflag", "l_linestatus", "games_played", "hits", sport.percent(F.col("hits"), F.col("games_played")).alias("hit_percentage"), sport.ratio(F.col("lines"), F.col("games_played")).alias("mean_line"))


@query("""
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, value, ts, event_id FROM events)
SELECT event_id, lag(event_id) OVER w AS prev_event, lead(event_id) OVER w AS next_event, greatest(coalesce(value - lag(value) OVER w, 0.0), 0.0) AS gain,
  last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried,
  CAST(1 + coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS possession,
  coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS after_error
FROM e WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)
""")
def event_windows(t, spark, d):
    """Neighbours, gain with floor, forward fill, boundary groups, existence since the period's start."""
    from pyspark.sql import Window

    from scorebook.operators.sequence import ever_before

    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    e = t["events"].withColumn("day", F.to_date("ts"))
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    buy = F.col("event_type") == "purchase"
    return e.select(
        "event_id", F.lag("event_id").over(w).alias("prev_event"), F.lead("event_id").over(w).alias("next_event"), F.greatest(F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0)), F.lit(0.0)).alias("gain"),
        F.last(F.when(buy, F.col("value")), ignorenulls=True).over(upto).alias("carried"), (1 + F.coalesce(F.sum(buy.cast("int")).over(before), F.lit(0))).alias("possession"), F.coalesce(ever_before(F.col("event_type") == "error", w), F.lit(False)).alias("after_error"),
    )


@query("""
WITH e AS (SELECT event_id, user_id, ts, event_type, CASE WHEN row_number() OVER w = 1 OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM e
""")
def islands(t, spark, d):
    return r.islands(t["events"], ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "island")


@query("""
WITH e AS (SELECT event_id, user_id, ts, event_type, value, CASE WHEN row_number() OVER w = 1 OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, min(event_id) AS event_id, min(event_type) AS event_type, arg_max(value, event_id) AS value, count(*) AS merged_rows FROM g GROUP BY user_id, run
""")
def adjacent_merged(t, spark, d):
    return r.adjacent_merged(t["events"].select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"], ["event_type"])


@query("""
WITH c AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS total, count(*) AS games, count(*) FILTER (o_orderstatus = 'O') AS losses FROM orders GROUP BY ALL),
a AS (SELECT o_custkey, y, count(*) OVER (PARTITION BY y ORDER BY games RANGE UNBOUNDED PRECEDING) AS up, count(*) OVER (PARTITION BY y) AS n FROM c),
b AS (SELECT o_custkey, y, count(*) OVER (PARTITION BY y ORDER BY -losses RANGE UNBOUNDED PRECEDING) AS up, count(*) OVER (PARTITION BY y) AS n FROM c WHERE games >= 3)
SELECT c.o_custkey, CAST(c.y AS INTEGER) AS season, CAST(CASE WHEN a.n = 1 THEN 100 ELSE round_even(100.0 * (a.up - 1) / (a.n - 1), 0) END AS INTEGER) AS games_percentile, CAST(CASE WHEN b.n = 1 THEN 100 ELSE round_even(100.0 * (b.up - 1) / (b.n - 1), 0) END AS INTEGER) AS losses_percentile
FROM c LEFT JOIN a ON c.o_custkey = a.o_custkey AND c.y = a.y LEFT JOIN b ON c.o_custkey = b.o_custkey AND c.y = b.y
""")
def percentiles(t, spark, d):
    """Percentile ranks in a season: ties take the highest rank, lower is better for losses, three games to qualify."""
    c = t["orders"].groupBy("o_custkey", F.year("o_date").alias("season")).agg(F.count(F.lit(1)).alias("games"), F.sum((F.col("o_orderstatus") == "O").cast("int")).alias("losses"))
    specs = [("games", "games_percentile", False, None), ("losses", "losses_percentile", True, F.col("games") >= 3)]
    return r.percentiles(c, ["season"], specs, ["o_custkey"]).select("o_custkey", "season", "games_percentile", "losses_percentile")


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_nationkey, c_name DESC, c_custkey) AS sk FROM (SELECT c_custkey, c_name, c_nationkey FROM customer)")
def surrogate_keys(t, spark, d):
    c = t["customer"].select("c_custkey", "c_name", "c_nationkey", (-F.col("c_custkey")).alias("neg"))
    # names sort like ids, so descending names are ascending negative ids
    return r.surrogate_keys(c, ["c_nationkey", "neg"], "sk").select("c_custkey", "c_name", "sk")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 10 THEN 1 ELSE 0 END + CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END DESC, event_id) AS k FROM events) WHERE k = 1")
def best_row(t, spark, d):
    """The most filled row per user; the first one if tied."""
    e = t["events"].withColumns({"v": F.when(F.col("value") > 10, F.col("value")), "y": F.when(F.col("event_type") != "view", F.col("event_type"))})
    return r.best_row(e, ["user_id"], r.filled(["v", "y"]), [F.col("event_id")]).select("user_id", "event_type", "value")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000) ORDER BY o_orderdate DESC, o_orderkey LIMIT 40")
def work_list(t, spark, d):
    have = t["customer"].where("c_acctbal < 5000").select(F.col("c_custkey").alias("o_custkey"))
    return r.work_list(t["orders"], have, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey")], 40).select("o_orderkey", "o_orderdate")


@query("SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS in_both, count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / CAST(count(*) AS DOUBLE) AS overlap_ratio FROM (SELECT DISTINCT l_partkey AS a FROM lineitem WHERE l_quantity > 45) FULL JOIN (SELECT DISTINCT l_partkey AS b FROM lineitem WHERE l_discount > 0.08) ON a = b")
def overlap_counts(t, spark, d):
    return r.overlap_counts(t["lineitem"].where("l_quantity > 45"), t["lineitem"].where("l_discount > 0.08"), ["l_partkey"])


@query("SELECT year(o_orderdate) AS season, count(*) AS missing FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def missing_per_season(t, spark, d):
    keys = t["lineitem"].select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return t["orders"].join(keys, "o_orderkey", "left_anti").groupBy(F.year("o_date").cast("long").alias("season")).agg(F.count(F.lit(1)).alias("missing"))


@query("SELECT DISTINCT 'order' AS kind, CAST(o_custkey AS BIGINT) AS id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 450000 UNION ALL SELECT 'event', user_id, CAST(ts AS DATE) FROM events WHERE value > 90 UNION ALL SELECT 'ship', l_suppkey, CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity = 50 AND l_tax = 0")
def event_union(t, spark, d):
    """Events of three sources in one shape."""
    a = t["orders"].where("o_totalprice > 450000").select(F.lit("order").alias("kind"), F.col("o_custkey").alias("id"), F.col("o_date").alias("day")).distinct()
    b = t["events"].where("value > 90").select(F.lit("event").alias("kind"), F.col("user_id").alias("id"), F.to_date("ts").alias("day"))
    c = t["lineitem"].where("l_quantity = 50 and l_tax = 0").select(F.lit("ship").alias("kind"), F.col("l_suppkey").alias("id"), F.col("l_date").alias("day"))
    return a.unionByName(b).unionByName(c)


@query("SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value > 15))) AS seen, list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(list(event_type) FILTER (value > 15), x))) AS missing FROM events GROUP BY user_id HAVING count(*) FILTER (value > 15) > 0")
def array_difference(t, spark, d):
    want = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    g = t["events"].where("value > 15").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("seen"))
    return g.withColumn("missing", F.array_except(want, "seen"))


# ---------------------------------------------------------------- scalars


@query("""
SELECT p_partkey, lower(replace(p_name, ' ', '')) AS alias, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, lpad(right(regexp_replace(p_brand, '[^0-9]', '', 'g'), 10), 10, '0') AS game_id,
  CASE WHEN p_type IN ('PROMO') THEN NULL ELSE p_type END AS type, CASE WHEN p_size % 2 = 0 THEN true ELSE false END AS flag,
  CASE WHEN p_size <= 50 THEN 2000 + p_size ELSE 1900 + p_size END AS season, p_partkey || '-' || (p_partkey + 1) AS pair FROM part
""")
def text_functions(t, spark, d):
    c = F.col
    word = F.when(c("p_size") % 2 == 0, " Yes ").otherwise("0")
    code = F.concat(F.lit("002"), F.lpad(c("p_size").cast("string"), 2, "0"), F.lit("00001"))
    return t["part"].select(
        "p_partkey", text.alphanumeric(c("p_name")).alias("alias"), F.regexp_replace("p_brand", "[^0-9]", "").alias("digits"), text.normalized_game_id(c("p_brand")).alias("game_id"),
        text.null_if_empty(F.when(c("p_type") == "PROMO", "  ").otherwise(c("p_type"))).alias("type"), text.to_bool(word).alias("flag"),
        dates.season_start_year_of_game(code).alias("season"), F.array_join(text.lineup_people(F.concat_ws("-", c("p_partkey"), c("p_partkey") + 1)), "-").alias("pair"),
    )


@query("""
SELECT o_orderkey, CAST(CASE WHEN month(d) >= 7 THEN year(d) ELSE year(d) - 1 END AS INTEGER) AS season, strftime(d, '%Y-%m') AS ym, CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(weekofyear(d) AS INTEGER) AS iso_week, CAST(isodow(d) AS INTEGER) AS iso_weekday, isodow(d) >= 6 AS is_weekend, last_day(d) = d AS is_month_end, strftime(date_trunc('week', d), '%Y-%m-%d') AS week,
  CAST(date_diff('year', d, DATE '2010-01-31') - CASE WHEN strftime(d, '%m%d') > '0131' THEN 1 ELSE 0 END AS INTEGER) AS age, CAST(3600.0 * (o_orderkey % 3) + 60.0 * (o_orderkey % 60) + (o_orderkey % 59) + 0.5 AS DOUBLE) AS seconds
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
""")
def date_functions(t, spark, d):
    day, k = F.col("o_date"), F.col("o_orderkey")
    cal = {c._jc.toString().split(" AS ")[-1].strip("`"): c for c in dates.calendar(day)}
    iso = F.concat(F.lit("PT"), k % 3, F.lit("H"), k % 60, F.lit("M"), k % 59, F.lit(".5S"))
    return t["orders"].select("o_orderkey", dates.season_start_year(day).alias("season"), dates.bucket(day, "month").alias("ym"), *[cal[c] for c in ("date_key", "iso_week", "iso_weekday", "is_weekend", "is_month_end")], dates.bucket(day, "week").alias("week"), dates.completed_years(day, F.lit("2010-01-31").cast("date")).alias("age"), dates.duration_seconds(iso).alias("seconds"))


@query("""
SELECT l_orderkey, l_linenumber, x / 100.0 / NULLIF(l_linenumber - 3, 0) AS plain, CASE WHEN l_linenumber > 0 THEN CASE WHEN (x * 10) % l_linenumber * 2 = l_linenumber THEN CASE WHEN (x * 10 // l_linenumber) % 2 = 0 THEN (x * 10 // l_linenumber) / 10.0 ELSE (x * 10 // l_linenumber + 1) / 10.0 END ELSE round(CAST(x AS DOUBLE) / l_linenumber, 1) END END AS half_even,
  (q + 0.5 * l_linenumber) / (2 * q) AS efg, p / (2 * (q + 0.44 * l_linenumber)) AS ts,
  CASE WHEN sqrt(fx * fx + fy * fy) <= 4.3 THEN 'Restricted Area' WHEN abs(fx) <= 8 AND fy <= 13.75 THEN 'In The Paint (Non-RA)' WHEN sqrt(fx * fx + fy * fy) >= 22 AND abs(fx) >= 22 AND fy <= 9 THEN CASE WHEN fx < 0 THEN 'Left Corner 3' ELSE 'Right Corner 3' END WHEN sqrt(fx * fx + fy * fy) >= 22 THEN 'Above the Break 3' ELSE 'Mid-Range' END AS zone
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS x, l_quantity AS q, l_extendedprice AS p, (l_partkey % 500 - 250) / 10.0 AS fx, (l_suppkey % 300) / 10.0 AS fy FROM lineitem)
""")
def sport_functions(t, spark, d):
    """Ratios, exact half-even rounding, shooting formulas and shot zones."""
    n, x = F.col("l_linenumber"), F.col("l_quantity").cast("long")
    lx, ly = (F.col("l_partkey") % 500 - 250).cast("double"), (F.col("l_suppkey") % 300).cast("double")
    far = F.sqrt(lx / 10 * (lx / 10) + ly / 10 * (ly / 10))
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber", sport.ratio(x / 100.0, n - 3).alias("plain"), sport.half_even_ratio(x, n, 1).alias("half_even"), sport.effective_fg(F.col("l_quantity"), n, 2 * F.col("l_quantity")).alias("efg"),
        sport.true_shooting(F.col("l_extendedprice"), F.col("l_quantity"), n).alias("ts"), sport.shot_zone(lx, ly, F.lit(None).cast("double"), sport.is_three(F.lit("x"), F.lit(2), far)).alias("zone"),
    )


# ---------------------------------------------------------------- dimensions and facts


@query("""
WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders UNION SELECT DISTINCT CAST(ts AS DATE) FROM events)
SELECT day, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, CAST(year(day) AS INTEGER) AS year, CAST(quarter(day) AS INTEGER) AS quarter, CAST(month(day) AS INTEGER) AS month, CAST(day(day) AS INTEGER) AS day_of_month, CASE WHEN month(day) >= 7 THEN printf('%d-%02d', year(day), (year(day) + 1) % 100) ELSE printf('%d-%02d', year(day) - 1, year(day) % 100) END AS season_year FROM days
""")
def date_dimension(t, spark, d):
    out = dimensions.date_dimension([(t["orders"], "o_orderdate"), (t["events"], "ts")])
    day = out.columns.index("day")
    out = out.toDF(*[c if i == day or c != "day" else "day_of_month" for i, c in enumerate(out.columns)])
    return out.select("day", "date_key", "year", "quarter", "month", "day_of_month", "season_year")


@query(f"SELECT game_id, max(team_id) FILTER (team_side = 'home') AS home_team_id, max(points) FILTER (team_side = 'home') AS home_points, max(team_id) FILTER (team_side = 'away') AS away_team_id, max(points) FILTER (team_side = 'away') AS away_points FROM {TEAMS} GROUP BY game_id")
def game_sides(t, spark, d):
    return dimensions.sides(team_rows(t), "game_id", "team_id", "team_side", ["points"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) WHEN s IS NOT NULL THEN s ELSE DATE '1990-01-01' END AS game_date, CASE WHEN o_orderkey % 3 <> 0 THEN 'schedule' WHEN s IS NOT NULL THEN 'ship' ELSE 'default' END AS source FROM orders LEFT JOIN (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def game_dates(t, spark, d):
    """A date by precedence of sources, with the source that gave it."""
    ship = t["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_date").alias("s"))
    value, source = dimensions.first_known([("schedule", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_date"))), ("ship", F.col("s")), ("default", F.lit("1990-01-01").cast("date"))])
    return t["orders"].join(ship, "o_orderkey", "left").select("o_orderkey", value.alias("game_date"), source.alias("source"))


@query("SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS season, CAST(sum(CASE WHEN l_quantity > 5 THEN 1 ELSE 0 END) AS BIGINT) AS games_played, sum(l_quantity) AS l_quantity_total, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber_total, count(DISTINCT l_orderkey) AS games_on_roster FROM lineitem GROUP BY ALL")
def season_totals(t, spark, d):
    rows = t["lineitem"].withColumn("season", F.year("l_date"))
    return dimensions.season_totals(rows, ["l_suppkey", "season"], ["l_quantity", "l_linenumber"], F.col("l_quantity") > 5, game="l_orderkey")


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(CASE WHEN o_totalprice > 200000 THEN o_totalprice END, o_orderkey) AS large, CAST(min(year(o_orderdate)) AS INTEGER) AS first_season, CAST(max(year(o_orderdate)) AS INTEGER) AS last_season FROM orders GROUP BY o_custkey")
def current_profile(t, spark, d):
    rows = t["orders"].withColumns({"season": F.year("o_date"), "large": F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice"))})
    return dimensions.current_profile(rows, "o_custkey", "o_orderkey", ["o_orderstatus", "large"], "season")


@query("SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS rows_F, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS rows_O, count(*) AS rows, round(100 * (CAST(count(*) FILTER (o_orderstatus IN ('F', 'O')) AS DOUBLE) / count(*)), 1) AS coverage_percent, CASE WHEN count(*) FILTER (o_orderstatus IN ('F', 'O')) = 0 THEN NULL WHEN count(*) FILTER (o_orderstatus = 'F') >= count(*) FILTER (o_orderstatus = 'O') THEN 'F' ELSE 'O' END AS dominant_method FROM orders GROUP BY o_custkey")
def provenance(t, spark, d):
    return dimensions.provenance(t["orders"], ["o_custkey"], "o_orderstatus", ["F", "O"])


# ---------------------------------------------------------------- linkage


@query("SELECT n_name AS canonical, alias, regexp_replace(lower(alias), '[^a-z0-9]', '', 'g') AS normalized FROM (SELECT DISTINCT n_name, unnest([n_name, replace(n_name, '_', ' '), CAST(n_nationkey AS VARCHAR)]) AS alias FROM nation)")
def alias_table(t, spark, d):
    n = t["nation"].select("n_name", F.translate("n_name", "_", " ").alias("spaced"), F.col("n_nationkey").alias("code"))
    return linkage.aliases(n, "n_name", ["n_name", "spaced", "code"])


@query("SELECT normalized, list_sort(list_distinct(list(p_brand))) AS canonicals FROM (SELECT p_brand, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS normalized FROM part) GROUP BY normalized HAVING count(DISTINCT p_brand) > 1")
def ambiguous_aliases(t, spark, d):
    return linkage.ambiguous_aliases(linkage.aliases(t["part"], "p_brand", ["p_name"]))


@query("SELECT c_custkey, s AS canonical_value FROM (SELECT c_custkey, regexp_replace(lower(replace(c_name, 'Customer', 'Supplier')), '[^a-z0-9]', '', 'g') AS k FROM customer) LEFT JOIN (SELECT regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS k2, min(s_name) AS s FROM supplier GROUP BY 1 HAVING count(DISTINCT s_name) = 1) ON k = k2")
def canonical_values(t, spark, d):
    a = linkage.aliases(t["supplier"], "s_name", ["s_name"])
    c = t["customer"].select("c_custkey", F.regexp_replace("c_name", "Customer", "Supplier").alias("v"))
    return linkage.canonicalized(c, "v", a).select("c_custkey", "canonical_value")


def link_sides(t) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers as two registers; a name is shared by at most thirty customers and two suppliers."""

    def side(df: DataFrame, name: str, p: str, key: str, per_name: int, school) -> DataFrame:
        number, nation, balance = F.col(key), F.col(f"{p}_nationkey"), F.col(f"{p}_acctbal")
        name_key = F.concat(F.lit("name "), F.floor(number / per_name).cast("string"))
        return df.select(
            number.alias(name), name_key.alias("name_key"), F.when(balance > 7000, F.concat(name_key, F.lit(" jr"))).otherwise(name_key).alias("exact_name_key"), F.when(balance > 2000, F.struct(nation.alias("nation"))).alias("draft"),
            (balance / 100).alias("weight"), school.alias("school"), F.array((nation % 3).cast("string")).alias("positions"), F.when(balance > 5000, 1).otherwise(0).alias("completeness"),
        )

    segments = F.array(*[F.lit(x) for x in ("automobile", "building", "furniture", "household", "machinery")])
    return side(t["customer"], "left_id", "c", "c_custkey", 30, F.lower("c_mktsegment")), side(t["supplier"], "right_id", "s", "s_suppkey", 2, segments[F.col("s_nationkey") % 5])


LINK_PAIRS = """
l AS (SELECT c_custkey AS left_id, 'name ' || (c_custkey // 30) AS k, CASE WHEN c_acctbal > 7000 THEN 'name ' || (c_custkey // 30) || ' jr' ELSE 'name ' || (c_custkey // 30) END AS x, c_nationkey AS nation, c_acctbal > 2000 AS whole, c_acctbal / 100 AS weight, lower(c_mktsegment) AS school, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS completeness FROM customer),
r AS (SELECT s_suppkey AS right_id, 'name ' || (s_suppkey // 2) AS k, CASE WHEN s_acctbal > 7000 THEN 'name ' || (s_suppkey // 2) || ' jr' ELSE 'name ' || (s_suppkey // 2) END AS x, s_nationkey AS nation, s_acctbal > 2000 AS whole, s_acctbal / 100 AS weight, ['automobile', 'building', 'furniture', 'household', 'machinery'][s_nationkey % 5 + 1] AS school FROM supplier),
p AS (SELECT k, left_id, right_id, l.x = r.x AND l.x <> k AS exact, CASE WHEN l.whole AND r.whole AND l.nation = r.nation THEN 1 ELSE 0 END AS draft, CASE WHEN abs(l.weight - r.weight) <= 1 THEN 1 ELSE 0 END AS weight, CASE WHEN l.school = r.school THEN 1 ELSE 0 END AS school, CASE WHEN l.nation % 3 = r.nation % 3 THEN 1 ELSE 0 END AS pos,
 CASE WHEN NOT (l.whole AND r.whole) THEN 0 WHEN l.nation = r.nation THEN 100 ELSE -100 END + CASE WHEN abs(l.weight - r.weight) <= 1 THEN 10 WHEN abs(l.weight - r.weight) >= 15 THEN -10 ELSE 0 END + CASE WHEN l.school = r.school THEN 8 ELSE 0 END + CASE WHEN l.nation % 3 = r.nation % 3 THEN 3 ELSE 0 END AS score
 FROM l JOIN r USING (k))
"""


@query(f"WITH {LINK_PAIRS} SELECT left_id, right_id, CAST(score AS INTEGER) AS score FROM p")
def link_scores(t, spark, d):
    a, b = link_sides(t)
    return linkage.scored(a, b).select("left_id", "right_id", "score")


@query(f"""
WITH {LINK_PAIRS},
c AS (SELECT *, count(*) OVER w AS n, sum(CAST(exact AS INT)) OVER w AS exacts, max(score) OVER w AS top FROM p WINDOW w AS (PARTITION BY left_id)),
c2 AS (SELECT *, score = top AS at_top, sum(CAST(score = top AS INT)) OVER (PARTITION BY left_id) AS tops FROM c),
c3 AS (SELECT *, CASE WHEN exacts = 1 THEN CASE WHEN exact THEN 2 END WHEN n = 1 AND k <> 'name 7' THEN 3 WHEN tops = 1 AND top >= 100 THEN CASE WHEN at_top THEN 1 END WHEN tops = 1 AND top >= 18 THEN CASE WHEN at_top THEN 0 END END AS reason FROM c2),
c4 AS (SELECT *, bool_or(reason IS NOT NULL) OVER (PARTITION BY left_id) AS decided FROM c3),
g AS (SELECT k, left_id, max(top) AS top, bool_and(tops = 1) AS single, max(draft) AS draft, max(completeness) AS completeness, list_sort(list_distinct(list(right_id))) AS candidates FROM c4 JOIN l USING (k, left_id) WHERE NOT decided AND at_top GROUP BY k, left_id),
g2 AS (SELECT *, single AND (draft = 1 OR top >= 15) AS d, sum(CAST(single AND (draft = 1 OR top >= 15) AS INT)) OVER w AS nd, sum(CAST(top > 0 AS INT)) OVER w AS np FROM g WINDOW w AS (PARTITION BY k)),
shared AS (SELECT k, left_id, candidates[1] AS right_id, d AND nd = 1 AND np = 1 AS accepted FROM g2),
proposals AS (SELECT left_id, right_id, draft, school, weight, pos, score, reason FROM c4 WHERE reason IS NOT NULL UNION ALL SELECT c4.left_id, c4.right_id, draft, school, weight, pos, score, -1 FROM c4 JOIN shared USING (left_id, right_id) WHERE accepted),
owned AS (SELECT left_id, right_id, row_number() OVER (PARTITION BY right_id ORDER BY draft DESC, school DESC, weight DESC, pos DESC, score DESC, reason DESC, completeness DESC, left_id) = 1 AS owns FROM proposals JOIN (SELECT left_id, completeness FROM l) USING (left_id))
SELECT left_id, right_id, CASE WHEN owns THEN 'accepted' ELSE 'duplicate' END AS status FROM owned
UNION ALL SELECT left_id, NULL, 'ambiguous' FROM shared WHERE NOT accepted
UNION ALL SELECT left_id, NULL, 'unmatched_left' FROM l WHERE left_id NOT IN (SELECT left_id FROM owned) AND left_id NOT IN (SELECT left_id FROM shared WHERE NOT accepted)
UNION ALL SELECT NULL, right_id, 'unmatched_right' FROM r WHERE right_id NOT IN (SELECT right_id FROM owned WHERE owns)
""")
def link_records(t, spark, d):
    """Accepted, duplicate, ambiguous and unmatched records of two registers."""
    return linkage.link(*link_sides(t), blocked=["name 7"])


@query("SELECT page_id, regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1) AS lang, nullif(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '') AS title, CAST(len(regexp_extract_all(html, '<a ')) AS INTEGER) AS n_links, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS n_paragraphs, CAST(len(regexp_extract_all(html, '<li>')) AS INTEGER) AS n_items FROM pages")
def html_records(t, spark, d):
    return linkage.page_fields(spark.read.parquet(f"{d}/pages.parquet")).drop("n_visible")


@query("SELECT label, count(*) AS pages, CAST(sum(n) AS BIGINT) AS occurrences, min(page_id) AS sample FROM (SELECT page_id, label, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS label FROM pages) GROUP BY ALL) GROUP BY label")
def html_labels(t, spark, d):
    return linkage.labels(spark.read.parquet(f"{d}/pages.parquet"), "<([a-z0-9]+)")


@query("SELECT page_id, CAST(n - 1 AS INTEGER) AS n, nullif(trim(href), '') AS href, nullif(trim(word), '') AS word FROM (SELECT page_id, unnest(range(1, len(h) + 1)) AS n, unnest(h) AS href, unnest(w) AS word FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2) AS w FROM pages))")
def html_rows(t, spark, d):
    """One row per link of a page."""
    return linkage.page_rows(spark.read.parquet(f"{d}/pages.parquet"), '<a href="([^"]*)">([^<]*)</a>', ["href", "word"])


# ---------------------------------------------------------------- quality


def line_rules() -> list[quality.Rule]:
    return [*quality.required("l_orderkey"), quality.Rule("large_quantity", F.col("l_quantity") > 45, "l_quantity"), quality.Rule("no_discount", F.col("l_discount") == 0, "l_discount"), quality.Rule("taxed", F.col("l_tax") > 0.05, "l_tax", "warning")]


@query("SELECT reason, count(*) AS rows FROM (SELECT CASE WHEN l_quantity > 45 THEN 'large_quantity' WHEN l_discount = 0 THEN 'no_discount' ELSE 'ok' END AS reason FROM lineitem UNION ALL SELECT 'taxed' FROM lineitem WHERE l_tax > 0.05) GROUP BY reason")
def quarantine_metrics(t, spark, d):
    return quality.quarantine(t["lineitem"], line_rules())[2]


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 45 THEN 'large_quantity' ELSE 'no_discount' END AS reason_code, CASE WHEN l_quantity > 45 THEN 'l_quantity' ELSE 'l_discount' END AS reason_field FROM lineitem WHERE l_quantity > 45 OR l_discount = 0")
def quarantine_rows(t, spark, d):
    return quality.quarantine(t["lineitem"], line_rules())[1].select("l_orderkey", "l_linenumber", "l_partkey", "reason_code", "reason_field")


@query("SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem WHERE l_quantity <= 45 AND l_discount <> 0 GROUP BY ALL")
def quarantine_clean(t, spark, d):
    """Clean rows, one per key."""
    rows = t["lineitem"].select("l_orderkey", "l_linenumber", (-F.col("l_partkey")).alias("neg"), "l_quantity", "l_discount", "l_tax", "l_partkey")
    return quality.quarantine(rows, line_rules(), ["l_orderkey", "l_linenumber"])[0].select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"SELECT game_id, team_id FROM {TEAMS} QUALIFY count(*) FILTER (team_side = 'home') OVER (PARTITION BY game_id) = 1 AND count(*) FILTER (team_side = 'away') OVER (PARTITION BY game_id) = 1")
def whole_games(t, spark, d):
    return quality.whole_games(team_rows(t))[0].select("game_id", "team_id")


@query("""
SELECT check_name, source_value, target_value, target_value - source_value AS difference, CASE WHEN source_value = target_value THEN 'ok' ELSE 'mismatch' END AS status, 'failed' AS overall FROM (
SELECT 'orders_customers' AS check_name, count(DISTINCT o_custkey) AS source_value, count(DISTINCT c_custkey) AS target_value FROM orders LEFT JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'orders_lines', count(DISTINCT o_orderkey), count(DISTINCT l_orderkey) FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT 'nations', count(*), count(*) FROM nation)
""")
def reconciliation(t, spark, d):
    """Row-count and key-coverage checks with the overall status."""
    parts = [quality.key_check("orders_customers", t["orders"], t["customer"], [("o_custkey", "c_custkey")]), quality.key_check("orders_lines", t["orders"], t["lineitem"], [("o_orderkey", "l_orderkey")]), quality.row_count_check("nations", t["nation"], t["nation"])]
    return quality.all_checks(parts)


@query("SELECT CAST(run_date AS DATE) AS run_date, event_type AS artifact_id, n AS row_count, lag(n) OVER w AS previous_row_count, n - lag(n) OVER w AS row_count_delta, CASE WHEN lag(n) OVER w IS NULL THEN 'no_history' WHEN n > lag(n) OVER w THEN 'increased' WHEN n < lag(n) OVER w THEN 'decreased' ELSE 'unchanged' END AS trend FROM (SELECT CAST(ts AS DATE) AS run_date, event_type, count(*) AS n FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY event_type ORDER BY run_date)")
def row_count_trend(t, spark, d):
    runs = t["events"].groupBy(F.to_date("ts").alias("run_date"), F.col("event_type").alias("artifact_id")).agg(F.count(F.lit(1)).alias("row_count")).withColumn("run_id", F.lit("1"))
    return quality.row_count_trend(runs).drop("run_id")


@query("""
WITH e AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS season, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(e.season, o.season) AS season, coalesce(e.n, 0) AS expected, coalesce(o.n, 0) AS observed, CASE WHEN e.n IS NULL THEN 'extra_season' WHEN coalesce(o.n, 0) = 0 THEN 'missing' WHEN o.n < e.n THEN 'partial' ELSE 'complete' END AS status FROM e FULL JOIN o ON e.season = o.season
""")
def completeness(t, spark, d):
    e = t["orders"].groupBy(F.year("o_date").alias("season")).agg(F.count(F.lit(1)).alias("n"))
    o = t["lineitem"].groupBy(F.year("l_date").alias("season")).agg(F.count_distinct("l_orderkey").alias("n"))
    return quality.completeness(e, o)


@query("""
WITH a AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey <> 3), b AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_nationkey <> 4),
j AS (SELECT CAST(coalesce(a.c_custkey, b.c_custkey) AS VARCHAR) AS k, a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL AS both_, a.c_custkey IS NULL AS new_only, b.c_custkey IS NULL AS old_only, a.c_name IS DISTINCT FROM b.c_name AS n, a.c_acctbal IS DISTINCT FROM b.c_acctbal AS bal, a.c_mktsegment IS DISTINCT FROM b.c_mktsegment AS seg FROM a FULL JOIN b ON a.c_custkey = b.c_custkey)
SELECT column_name, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS mismatches, min(CASE WHEN bad THEN k END) AS example FROM (SELECT k, 'c_name' AS column_name, both_ AND n AS bad FROM j UNION ALL SELECT k, 'c_acctbal', both_ AND bal FROM j UNION ALL SELECT k, 'c_mktsegment', both_ AND seg FROM j UNION ALL SELECT k, '<old only>', old_only FROM j UNION ALL SELECT k, '<new only>', new_only FROM j) GROUP BY column_name
""")
def table_diff(t, spark, d):
    c = t["customer"]
    new = c.where("c_nationkey <> 4").withColumns({"c_acctbal": F.when(F.col("c_custkey") % 7 == 0, -1.0).otherwise(F.col("c_acctbal")), "c_mktsegment": F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment"))})
    return quality.table_diff(c.where("c_nationkey <> 3"), new, ["c_custkey"], ["c_name", "c_acctbal", "c_mktsegment"])


@query("""
WITH n AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS cut, count(*) FILTER (o_custkey % 5 = 0) AS lost, count(*) FILTER (o_custkey % 5 = 0 AND o_orderkey % 3 > 0) AS lost_now FROM orders)
SELECT 'orders' AS artifact_id, c AS column_name, a AS old_type, b AS new_type, drift, CASE WHEN a IS NOT NULL THEN n END AS old_rows, CASE WHEN b IS NOT NULL THEN n - cut END AS new_rows, CASE WHEN a IS NOT NULL THEN CASE c WHEN 'o_totalprice' THEN lost ELSE 0 END END AS old_nulls, CASE WHEN b IS NOT NULL THEN CASE c WHEN 'o_orderpriority' THEN lost_now ELSE 0 END END AS new_nulls FROM n, (VALUES
 ('o_orderkey', 'int', 'bigint', 'type_changed'), ('o_custkey', 'bigint', 'bigint', 'unchanged'), ('o_orderstatus', 'string', NULL, 'removed'), ('o_totalprice', 'double', 'double', 'unchanged'), ('o_orderpriority', 'string', 'string', 'unchanged'), ('o_date', NULL, 'date', 'added')) AS x (c, a, b, drift)
""")
def schema_drift(t, spark, d):
    """Two stored versions of a table: columns added, removed or of another type, and the rows and nulls of each."""
    o, lost = t["orders"].drop("o_orderdate"), F.col("o_custkey") % 5 == 0
    old = stored(o.drop("o_date").withColumns({"o_orderkey": F.col("o_orderkey").cast("int"), "o_totalprice": F.when(~lost, F.col("o_totalprice"))}))
    new = stored(o.where("o_orderkey % 3 > 0").drop("o_orderstatus").withColumn("o_orderpriority", F.when(~lost, F.col("o_orderpriority"))))
    was, now = quality.column_facts(old, "orders", "1"), quality.column_facts(new, "orders", "2")
    seen = lambda df, p: df.select("artifact_id", "column_name", F.col("rows").alias(f"{p}_rows"), F.col("nulls").alias(f"{p}_nulls"))
    keys = ["artifact_id", "column_name"]
    return quality.schema_drift(now, was).join(seen(was, "old"), keys, "left").join(seen(now, "new"), keys, "left")


@query()
def table_profile(t, spark, d):
    """Rows, files and bytes of the line items."""
    return quality.table_profile(spark.read.parquet(f"{d}/lineitem.parquet"), "lineitem")


# ---------------------------------------------------------------- increments


@query("""
SELECT user_id, sha256('[' || string_agg('{"key":"' || key || '","modified":"' || m || '"}', ',' ORDER BY key, m) || ']') AS source_fingerprint, max(ts) AS last_modified
FROM (SELECT user_id, ts, concat_ws(':', event_id, event_type) AS key, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS m FROM events) GROUP BY user_id
""")
def source_fingerprints(t, spark, d):
    """A fingerprint of each user's events."""
    return incremental.fingerprints(t["events"].withColumn("key", F.concat_ws(":", "event_id", "event_type")), "user_id", "key", "ts")


@query("SELECT user_id, 'checkpoint_incremental' AS selection_mode FROM events GROUP BY user_id HAVING count(*) FILTER (value > 49.5) > 0")
def changed_entities(t, spark, d):
    """Users whose fingerprint differs from the checkpoint's, or who aren't in it."""
    make = lambda e: incremental.fingerprints(e.withColumn("key", F.concat_ws(":", "event_id", "event_type")), "user_id", "key", "ts")
    before = make(t["events"].where("value <= 49.5"))
    return incremental.changed(make(t["events"]), before, "user_id")


@query("SELECT user_id, 'watermark' AS selection_mode FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 90 MINUTE")
def watermark_entities(t, spark, d):
    last = t["events"].groupBy("user_id").agg(F.max("ts").alias("last_modified"))
    return incremental.changed(last, None, "user_id", watermark="2024-01-30 12:00:00", lookback_minutes=90)


@query("SELECT user_id, CASE WHEN max(value) FILTER (event_type = 'error') IS NOT NULL THEN max(value) FILTER (event_type = 'error') ELSE max(value) FILTER (event_type = 'view') END AS v FROM events WHERE event_type IN ('view', 'error') GROUP BY user_id")
def checkpoint_upsert(t, spark, d):
    part = lambda k: t["events"].where(F.col("event_type") == k).groupBy("user_id").agg(F.max("value").alias("v"))
    return incremental.updated_checkpoint(part("view"), part("error"), "user_id")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-03-15'")
def filtered_work(t, spark, d):
    return incremental.filtered_work(t["orders"], date_from="1996-02-01", date_to="1996-12-31", today="1996-03-15", day="o_date").select("o_orderkey")


# ---------------------------------------------------------------- clean tables


# statistics of a team's game, in the SQL that both engines have
TEAM_STATS = {
    "points": "sum(l_quantity)", "assists": "sum(l_partkey % 4)", "turnovers": "sum(l_partkey % 3)", "total_rebounds": "sum(l_partkey % 9)", "offensive_rebounds": "sum(l_partkey % 5)", "defensive_rebounds": "sum(l_linenumber % 4)",
    "steals": "sum(l_linenumber % 3)", "blocks": "sum(l_linenumber % 2)", "fouls_drawn": "sum(l_suppkey % 6)", "points_off_turnovers": "sum(l_partkey % 7)", "field_goals_made": "count(*)", "field_goals_attempted": "sum(l_linenumber + 3)",
    "three_pointers_made": "sum(l_partkey % 2)", "three_pointers_attempted": "sum(l_partkey % 4)", "free_throws_made": "sum(l_suppkey % 2)", "free_throws_attempted": "sum(l_suppkey % 3)",
}


def team_facts(t) -> DataFrame:
    """Team games as the clean tables take them: an order's suppliers, with sums of their lines."""
    stats = [F.expr(x).cast("long").alias(c) for c, x in TEAM_STATS.items()]
    # lines are narrower than sums of them, and all that follows is by game
    lines = t["lineitem"].select(F.col("l_orderkey").cast("string").alias("game_id"), F.col("l_suppkey").alias("team_id"), "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_date").repartition("game_id")
    per = lines.groupBy("game_id", "team_id").agg(*stats, F.year(F.min("l_date")).cast("string").alias("season_year"))
    home = F.when(F.col("team_id") % 2 == 0, "home").otherwise("away")
    out = per.withColumns({"season_type": F.lit("Regular Season"), "team_home_or_away": home, "minutes_played": F.lit(240.0)})
    sides = r.opponents(out, "game_id", "team_id", "team_home_or_away", ["points"])
    result = F.when(F.col("points") > F.col("opponent_points"), "win").when(F.col("points") < F.col("opponent_points"), "loss")
    return sides.withColumn("win_loss_result", result).drop("opponent_points", "opponent_team_id", "opponent_team_home_or_away")


def team_games(t) -> DataFrame:
    f = team_facts(t)
    return semantic.team_game(f, f.select("game_id", "team_id", F.lit(100.0).alias("offensive_possessions"), (F.col("assists") + 90.0).alias("defensive_possessions")))


def all_columns(table: str, known: dict[str, str]) -> str:
    """A select list of the table's columns: the known ones by their SQL, the others null."""
    kinds = {"long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}
    return ", ".join(f"CAST({known.get(n, 'NULL')} AS {kinds[k]}) AS {n}" for n, k in semantic.fields_of(table))


GAME_STATS = {**{c: c for c in TEAM_STATS}, "score": "points", "two_pointers_made": "field_goals_made - three_pointers_made", "two_pointers_attempted": "field_goals_attempted - three_pointers_attempted"}
CLEAN = f"""
(WITH p AS (SELECT CAST(l_orderkey AS VARCHAR) AS game_id, l_suppkey AS team_id, {", ".join(f"CAST({x} AS BIGINT) AS {c}" for c, x in TEAM_STATS.items())}, CAST(year(min(l_shipdate)) AS VARCHAR) AS season_year, CASE WHEN l_suppkey % 2 = 0 THEN 'home' ELSE 'away' END AS side FROM lineitem GROUP BY ALL),
j AS (SELECT a.*, b.team_id AS opponent_team_id, b AS o, row_number() OVER (PARTITION BY a.game_id, a.team_id ORDER BY CASE WHEN a.side <> b.side THEN 0 ELSE 1 END, b.team_id) AS k FROM p a JOIN p b ON a.game_id = b.game_id AND a.team_id <> b.team_id)
SELECT {all_columns("team_game", {"game_id": "game_id", "team_id": "team_id", "opponent_team_id": "opponent_team_id", "season_year": "season_year", "season_type": "'Regular Season'", "team_home_or_away": "side", "win_loss_result": "CASE WHEN points > o.points THEN 'win' WHEN points < o.points THEN 'loss' END", "minutes_played": "240", "offensive_possessions": "100", "defensive_possessions": "assists + 90", "block_percentage": "round(100 * (CAST(blocks AS DOUBLE) / nullif(o.field_goals_attempted - o.three_pointers_attempted, 0)), 1)"} | {n: x for c, x in GAME_STATS.items() for n, x in ((c, x), (f"opponent_{c}", " - ".join(f"o.{y}" for y in x.split(" - "))))})} FROM j WHERE k = 1)
"""


@query(CLEAN.strip()[1:-1])
def clean_team_game(t, spark, d):
    """The team-game table, with opponents side by side."""
    return team_games(t)


SEASON_SUMS = [c for c in ("score", *semantic.COUNTS[1:])]
TEAM_SEASON = f"""
(WITH s AS (SELECT team_id, season_year, season_type, count(*) AS games, count(*) FILTER (win_loss_result = 'win') AS w, count(*) FILTER (win_loss_result = 'loss') AS l, sum(minutes_played) AS minutes, sum(offensive_possessions) AS off, sum(defensive_possessions) AS def, {", ".join(f"sum(coalesce({p}{c}, 0)) AS {p}{c}" for c in SEASON_SUMS for p in ("", "opponent_"))}, sum(score + 7) AS tried FROM {CLEAN} GROUP BY ALL)
SELECT *, (off + def) / 2 AS poss FROM s)
"""
_share = lambda own, other: f"round(100 * (CAST({own} AS DOUBLE) / nullif({own} + opponent_{other}, 0)), 1)"


@query(f"""
SELECT {all_columns("team_season", {"team_id": "team_id", "season_year": "season_year", "season_type": "season_type", "games_played": "games", "wins": "w", "losses": "l", "minutes": "round(minutes / 5)", "minutes_per_game": "round(minutes / 5 / games, 1)", "points_total": "score", "rebounds_total": "total_rebounds",
  "offensive_possessions": "round(off, 1)", "defensive_possessions": "round(def, 1)", "pace": "round(240 * poss / minutes, 1)", "defensive_rating": "round(100 * opponent_score / poss, 1)", "net_rating": "round(100 * score / poss - 100 * opponent_score / poss, 1)", "offensive_rebound_percentage": _share("offensive_rebounds", "defensive_rebounds"),
  "defensive_rebound_percentage": _share("defensive_rebounds", "offensive_rebounds"), "rebound_percentage": _share("total_rebounds", "total_rebounds"), "block_percentage": "round(100 * (CAST(blocks AS DOUBLE) / nullif(tried, 0)), 1)"} | {f"{c}_total": c for c in semantic.COUNTS if c not in ("points", "total_rebounds")})} FROM {TEAM_SEASON}
""")
def clean_team_season(t, spark, d):
    """The team-season table."""
    games = stored(team_games(t))
    return semantic.team_season(games, games.select("game_id", "team_id", (F.col("score") + 7).alias("opponent_two_point_attempts")))


@query(f"SELECT team_id, season_year, CAST(score AS BIGINT) AS points_total, CAST(opponent_score AS BIGINT) AS opponent_points_total, round(100 * (CAST(w AS DOUBLE) / nullif(w + l, 0)), 1) AS win_percentage, round(100 * (CAST(field_goals_made + 0.5 * three_pointers_made AS DOUBLE) / nullif(field_goals_attempted, 0)), 1) AS effective_field_goal_percentage, round(100 * (CAST(opponent_assists AS DOUBLE) / nullif(opponent_field_goals_made, 0)), 1) AS opponent_assist_percentage, round(CAST(three_pointers_attempted AS DOUBLE) / nullif(field_goals_attempted, 0), 3) AS three_point_attempt_rate, minutes AS minutes_total FROM {TEAM_SEASON}")
def advanced_team_season(t, spark, d):
    """The advanced view of team seasons."""
    season = semantic.advanced_team_season(semantic.team_season_sums(stored(team_games(t))))
    return season.select("team_id", "season_year", "points_total", "opponent_points_total", "win_percentage", "effective_field_goal_percentage", "opponent_assist_percentage", "three_point_attempt_rate", "minutes_total")


# a player's game: an order, with statistics in the SQL that both engines have
PLAYER_GAME = {
    "game_id": "CAST(o_orderkey AS STRING)", "person_id": "o_custkey", "team_id": "ascii(o_orderstatus)", "season_year": "CAST(year(o_orderdate) AS STRING)", "season_type": "o_orderpriority", "is_starter": "o_orderstatus = 'F'", "minutes_played": "CASE WHEN o_orderkey % 9 > 0 THEN 30.0 ELSE 0.0 END",
    "plus_minus": "o_orderkey % 11 - 5", "points": "CAST(floor(o_totalprice) AS BIGINT)", "assists": "o_orderkey % 7", "total_rebounds": "o_orderkey % 5 + o_orderkey % 3", "offensive_rebounds": "o_orderkey % 3", "defensive_rebounds": "o_orderkey % 5", "blocks": "o_orderkey % 2", "steals": "o_custkey % 3",
    "field_goals_made": "o_orderkey % 8", "field_goals_attempted": "o_orderkey % 8 + 4", "offensive_possessions": "CAST(50 + o_orderkey % 20 AS DOUBLE)", "defensive_possessions": "CAST(50 + o_orderkey % 13 AS DOUBLE)", "offensive_rating": "CAST(90 + o_orderkey % 30 AS DOUBLE)",
    "defensive_rating": "CASE WHEN o_orderkey % 6 > 0 THEN CAST(95 + o_orderkey % 25 AS DOUBLE) END", "assist_percentage": "CAST(o_orderkey % 40 AS DOUBLE)", "usage_percentage": "CAST(10 + o_orderkey % 25 AS DOUBLE)", "rebound_percentage": "CAST(o_orderkey % 4 * 5 AS DOUBLE)",
}


def player_games(t) -> DataFrame:
    return semantic.conformed(t["orders"].select(*[F.expr(x).alias(c) for c, x in PLAYER_GAME.items()]), "player_game")


def player_season_sql(table: str, keys: str, more: dict[str, str]) -> str:
    sums = {f"{'rebounds' if c == 'total_rebounds' else c}_total": f"sum(coalesce({c if c in PLAYER_GAME else '0'}, 0))" for c in (*semantic.COUNTS, "opponent_blocks", "plus_minus")}
    weigh = lambda x: f"round(sum({x} * offensive_possessions) / sum(CASE WHEN {x} IS NOT NULL THEN offensive_possessions END), 1)"
    implied = lambda part, rate: f"round(100 * (CAST(sum(CASE WHEN {rate} > 0 THEN {part} END) AS DOUBLE) / nullif(sum(CASE WHEN {rate} > 0 THEN 100 * {part} / {rate} END), 0)), 1)"
    off, de = weigh("offensive_rating"), weigh("defensive_rating").replace("offensive_possessions", "defensive_possessions")
    known = {k: k for k in keys.split(", ")} | sums | more | {
        "games_played": "count(*) FILTER (minutes_played > 0)", "games_started": "count(*) FILTER (is_starter)", "minutes_total": "sum(minutes_played)", "offensive_possessions_total": "sum(offensive_possessions)", "defensive_possessions_total": "sum(defensive_possessions)",
        "pace": "round(48 * ((sum(offensive_possessions) + sum(defensive_possessions)) / 2) / nullif(sum(minutes_played), 0), 1)", "offensive_rating": off, "defensive_rating": de, "net_rating": f"round({off} - {de}, 1)", "usage_percentage": weigh("usage_percentage"),
        "assist_percentage": implied("assists", "assist_percentage"), "rebound_percentage": implied("total_rebounds", "rebound_percentage"),
    }
    games = ", ".join(f"{x} AS {c}" for c, x in PLAYER_GAME.items()).replace("STRING", "VARCHAR")
    return f"WITH g AS (SELECT {games} FROM orders) SELECT {all_columns(table, known)} FROM g GROUP BY {keys}"


@query(player_season_sql("player_season", "person_id, season_year, season_type", {"age_on_jan_31": "CAST(season_year AS INTEGER) + 1 - 1990", "team_count": "count(DISTINCT team_id)", "is_multi_team_season": "count(DISTINCT team_id) > 1"}))
def clean_player_season(t, spark, d):
    """The player-season table over orders as player games."""
    people = t["customer"].select(F.col("c_custkey").alias("person_id"), F.lit("1990-01-01").cast("date").alias("birth_date"))
    return semantic.player_season(player_games(t), people)


@query(player_season_sql("player_season_team", "person_id, team_id, season_year, season_type", {}))
def clean_player_season_team(t, spark, d):
    """The table of player seasons by team over orders as player games."""
    return semantic.player_season_team(player_games(t))
