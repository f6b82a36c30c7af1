"""Registered queries of the query families, with the same queries in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.functions.predicates import And, Leaf, Not, Or, TimeScope
from scorebook.plans import query as q
from scorebook.plans.catalog import MetricDef, game_metrics
from scorebook.plans.demo import CATALOG, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (tables, spark, folder) under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(tables(spark, d), spark, d)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


ORDERS = "(SELECT *, CAST(o_orderdate AS DATE) AS o_date, year(o_orderdate) AS o_year, CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' END AS o_result FROM orders)"
SEASON = "(SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS o_year, round(sum(o_totalprice), 2) AS price_total, count(*) AS games_played FROM orders GROUP BY ALL)"


@query(f"""
WITH r AS (SELECT c_custkey AS entity_id, c_name, n_name, o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_date DESC, o_orderkey DESC) AS k
  FROM {ORDERS} o JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
a AS (SELECT entity_id, max(c_name) AS entity_name, max(n_name) AS context_value, round(sum(o_totalprice), 2) AS total_price, count(*) AS games FROM r WHERE k <= 10 GROUP BY entity_id)
SELECT CAST(row_number() OVER (ORDER BY total_price DESC, entity_name) AS INTEGER) AS rank, entity_id, entity_name, context_value, games, total_price FROM a ORDER BY total_price DESC, entity_name LIMIT 10
""")
def rank_last_n(t, spark, d):
    """Top ten customers by the total of their last ten orders."""
    out = q.rank(CATALOG, t, "orders", "customer", ["total_price"], last_n=10, context="nation.n_name", display={"games": F.count(F.lit(1))})
    return out.select("rank", "entity_id", "entity_name", "context_value", "games", "total_price")


@query(f"""
WITH m AS (SELECT max(o_date) AS latest FROM {ORDERS}),
a AS (SELECT c_custkey AS entity_id, o_orderpriority, max(c_name) AS entity_name, round(sum(o_totalprice), 2) AS total_price, CAST(sum(CASE WHEN o_result = 'win' THEN 1 ELSE 0 END) AS BIGINT) AS wins
  FROM {ORDERS} o JOIN customer ON o_custkey = c_custkey, m WHERE o_date >= latest - INTERVAL 365 DAY AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY total_price ASC, entity_name) AS INTEGER) AS rank, entity_id, o_orderpriority, entity_name, total_price, wins FROM a WHERE wins >= 1 ORDER BY total_price ASC, entity_name LIMIT 15
""")
def rank_window_having(t, spark, d):
    """Fewest first, grouped, over the last 365 days of the data, with a row and a result predicate."""
    out = q.rank(CATALOG, t, "orders", "customer", ["total_price", "wins"], groups=["o_orderpriority"], where=Leaf("customer.c_mktsegment", "in", ("BUILDING", "MACHINERY")), time=TimeScope(last_n_days=365), having=Leaf("wins", ">=", 1), order="fewest", limit=15)
    return out.select("rank", "entity_id", "o_orderpriority", "entity_name", "total_price", "wins")


@query(f"""
WITH a AS (SELECT c_custkey AS entity_id, max(c_name) AS entity_name, CAST(sum(CASE WHEN o_result = 'loss' THEN 1 ELSE 0 END) AS BIGINT) AS losses, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent, max(o_totalprice) AS largest_price, round(avg(o_totalprice), 1) AS average_price FROM {ORDERS} JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT CAST(row_number() OVER (ORDER BY losses ASC, entity_name) AS INTEGER) AS rank, entity_id, entity_name, losses, urgent, largest_price, average_price FROM a ORDER BY losses ASC, entity_name LIMIT 20
""")
def rank_polarity(t, spark, d):
    """`best` follows the metric: fewest losses first."""
    return q.rank(CATALOG, t, "orders", "customer", ["losses", "urgent", "largest_price", "average_price"], order="best", limit=20).drop("context_value")


@query(f"SELECT CAST(row_number() OVER (ORDER BY price_total DESC, c_name) AS INTEGER) AS rank, c_name AS entity_name, o_year, price_total AS year_total FROM {SEASON} s JOIN customer ON o_custkey = c_custkey WHERE o_year = 1997 ORDER BY price_total DESC, c_name LIMIT 12")
def rank_season(t, spark, d):
    """Top rows of a season table."""
    return q.season_rank(CATALOG, t, "customer_year", "customer", "year_total", where=Leaf("o_year", "=", 1997), limit=12, columns=["o_year"])


@query(f"""
SELECT n_name, o_orderpriority, round(sum(o_totalprice), 2) AS total_price, round(avg(o_totalprice), 1) AS average_price, CAST(sum(CASE WHEN o_result = 'win' THEN 1 ELSE 0 END) AS BIGINT) AS wins
FROM {ORDERS} JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' GROUP BY ALL HAVING wins > 2
""")
def aggregate_groups(t, spark, d):
    """Several metrics by a linked dimension and one of the fact."""
    return q.aggregate(CATALOG, t, "orders", ["nation.n_name", "o_orderpriority"], ["total_price", "average_price", "wins"], time=TimeScope.named("between", "1995-01-01", "1997-12-31"), having=Leaf("wins", ">", 2))


@query(f"SELECT c_mktsegment, max(price_total) AS year_total, max(price_total / games_played) AS year_average FROM {SEASON} JOIN customer ON o_custkey = c_custkey WHERE o_year IN (1996, 1997) GROUP BY c_mktsegment")
def aggregate_season(t, spark, d):
    return q.aggregate(CATALOG, t, "customer_year", ["customer.c_mktsegment"], ["year_total", "year_average"], where=Leaf("o_year", "in", (1996, 1997)), not_null=True)


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_date DESC, o_orderkey DESC) AS k FROM {ORDERS} JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> '5-LOW')
SELECT c_custkey AS entity_id, c_name AS entity_name, round(100.0 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*), 1) AS win_share, round(sum(o_totalprice), 2) AS total_price FROM r WHERE k <= 5 GROUP BY ALL
""")
def object_rows_recent(t, spark, d):
    out = q.object_rows(CATALOG, t, "orders", "customer", ["win_share", "total_price"], where=Leaf("o_orderpriority", "<>", "5-LOW"), last_n=5)
    return out.select("entity_id", "entity_name", "win_share", "total_price")


@query(f"SELECT c_custkey AS entity_id, c_name AS entity_name, o_year, price_total / games_played AS year_average FROM {SEASON} JOIN customer ON o_custkey = c_custkey WHERE o_year = 1998")
def object_rows_season(t, spark, d):
    return q.season_object_rows(CATALOG, t, "customer_year", "customer", ["year_average"], where=Leaf("o_year", "=", 1998), columns=["o_year"])


@query(f"SELECT strftime(o_date, '%Y-%m') AS bucket, round(sum(o_totalprice), 2) AS total_price, CAST(sum(CASE WHEN o_result = 'win' THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM {ORDERS} GROUP BY 1")
def trend_month(t, spark, d):
    return q.trend(CATALOG, t, "orders", "month", ["total_price", "wins"])


@query(f"SELECT strftime(date_trunc('week', o_date), '%Y-%m-%d') AS bucket, r_name, max(o_totalprice) AS largest_price, round(sum(o_totalprice), 2) AS total_price FROM {ORDERS} JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, (SELECT max(o_date) AS latest FROM {ORDERS}) WHERE o_date >= latest - INTERVAL 12 MONTH GROUP BY ALL")
def trend_week_series(t, spark, d):
    """Weekly by region (three hops are two links of a customer's nation), over the past year of the data."""
    t = t | {"nation": t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))}
    return q.trend(CATALOG, t, "orders", "week", ["largest_price", "total_price"], series=["nation.r_name"], time=TimeScope(past_year=True))


@query(f"SELECT CASE WHEN month(o_date) >= 7 THEN printf('%d-%02d', year(o_date), (year(o_date) + 1) % 100) ELSE printf('%d-%02d', year(o_date) - 1, year(o_date) % 100) END AS bucket, count(*) AS games FROM {ORDERS} GROUP BY 1")
def trend_season(t, spark, d):
    """Seasons start in July."""
    return q.trend(CATALOG, t, "orders", "season", [MetricDef("games", "ratio", "count(1)")])


COMPARED = (3, 7, 11, 12)


@query(f"SELECT c_custkey AS entity_id, c_name AS entity_name, o_orderkey, o_totalprice, strftime(o_date, '%Y-%m') AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_date DESC, o_orderkey DESC) AS k FROM {ORDERS} JOIN customer ON o_custkey = c_custkey WHERE c_custkey IN {COMPARED}) WHERE k <= 6")
def compare_rows(t, spark, d):
    return q.compare_rows(CATALOG, t, "orders", "customer", COMPARED, last_n=6, size="month").select("entity_id", "entity_name", "o_orderkey", "o_totalprice", "bucket")


@query(f"SELECT c_custkey AS entity_id, c_name AS entity_name, o_year, games_played, price_total FROM {SEASON} JOIN customer ON o_custkey = c_custkey WHERE c_custkey IN {COMPARED}")
def compare_season(t, spark, d):
    return q.compare_rows(CATALOG, t, "customer_year", "customer", COMPARED).select("entity_id", "entity_name", "o_year", "games_played", "price_total")


@query(f"""
WITH a AS (SELECT c_custkey AS entity_id, max(c_name) AS entity_name, count(*) AS games, round(sum(o_totalprice), 2) AS total_price, round(avg(o_totalprice), 1) AS average_price FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey IN {COMPARED} GROUP BY c_custkey),
b AS (SELECT *, row_number() OVER w AS place, lead(total_price) OVER w AS nxt FROM a WINDOW w AS (ORDER BY total_price DESC, entity_id))
SELECT entity_id, entity_name, games, total_price, average_price, CAST(place AS INTEGER) AS place, place = 1 AS is_leader, round(abs(total_price - nxt), 1) AS gap_to_next FROM b
""")
def compare_summary(t, spark, d):
    return q.compare_summary(q.compare_rows(CATALOG, t, "orders", "customer", COMPARED), [CATALOG.metrics["total_price"], CATALOG.metrics["average_price"]])


@query(f"SELECT CAST(year(o_orderdate) AS VARCHAR) AS bucket, c_custkey AS entity_id, c_name AS entity_name, o_orderstatus AS group_o_orderstatus, count(*) AS games, round(sum(o_totalprice), 2) AS total_price FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey IN {COMPARED} GROUP BY ALL")
def compare_breakdown(t, spark, d):
    rows = q.compare_rows(CATALOG, t, "orders", "customer", COMPARED, size="year", groups=["o_orderstatus"])
    return q.compare_breakdown(rows, [CATALOG.metrics["total_price"]], ["o_orderstatus"])


@query("""
SELECT DISTINCT c_name AS customer_c_name, n_name AS nation_n_name, o_totalprice, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_totalprice > 300000 AND (n_name IN ('NATION_1', 'NATION_2') OR NOT (o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR contains(lower(c_name), '%')) AND c_name ILIKE '%99%')
""")
def find_predicates(t, spark, d):
    """A nested predicate over linked objects; wildcards in a contains text are plain characters."""
    urgent = Not(Or((Leaf("o_orderpriority", "not in", ("1-URGENT", "2-HIGH")), Leaf("customer.c_name", "contains", "%"))))
    where = And((Leaf("o_totalprice", ">", 300000.0), Or((Leaf("nation.n_name", "in", ("NATION_1", "NATION_2")), And((urgent, Leaf("customer.c_name", "contains", "99")))))))
    return q.find(CATALOG, t, "orders", ["customer.c_name", "nation.n_name"], where=where)


@query("SELECT c_name AS customer_c_name FROM (SELECT c_name, max(o_totalprice) AS p FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice BETWEEN 100000 AND 200000 GROUP BY c_name ORDER BY p DESC, c_name LIMIT 25)")
def find_ordered(t, spark, d):
    """Distinct names, ordered by a field that isn't shown."""
    t = t | {"orders": t["orders"].where(F.col("o_totalprice").between(100000, 200000))}
    return q.find(CATALOG, t, "orders", ["customer.c_name"], time=TimeScope(date_from="1900-01-01"), order=[("o_totalprice", "desc")], limit=25)


@query("SELECT DISTINCT o_orderkey, o_date, o_orderstatus FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_date, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30)")
def find_last_n(t, spark, d):
    """The last 30 orders of all, by a bounded sort."""
    return q.find(CATALOG, t, "orders", ["o_orderkey", "o_date", "o_orderstatus"], last_n=30)


@query("""
WITH w(wanted) AS (VALUES ('red widget'), ('RING'), ('nobody'), ('small ring')),
e AS (SELECT wanted, count(DISTINCT p_partkey) AS n, min(p_partkey) AS id FROM w JOIN part ON lower(wanted) = lower(p_name) GROUP BY wanted),
t AS (SELECT wanted, count(DISTINCT p_partkey) AS n, min(p_partkey) AS id FROM w JOIN part ON list_contains(string_split(lower(p_name), ' '), lower(wanted)) WHERE wanted NOT IN (SELECT wanted FROM e) GROUP BY wanted)
SELECT w.wanted, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status, CASE WHEN n = 1 THEN id END AS id FROM w LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM t) f ON w.wanted = f.wanted
""")
def resolve_entities(t, spark, d):
    names = spark.sql("SELECT * FROM VALUES ('red widget'), ('RING'), ('nobody'), ('small ring') AS v(wanted)")
    return q.resolve_entities(names, t["part"], "p_partkey", "p_name")


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS total_l_quantity, round(avg(l_quantity), 1) AS average_l_quantity, round(avg(l_discount), 1) AS average_l_discount, round(avg(l_tax), 1) AS average_l_tax FROM lineitem GROUP BY l_returnflag")
def generated_metrics(t, spark, d):
    """Metrics generated from the fact's schema; rate columns have no total."""
    made = game_metrics(t["lineitem"].schema, rates=frozenset({"l_discount", "l_tax"}), skip=frozenset({"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"}))
    names = ["total_l_quantity", "average_l_quantity", "average_l_discount", "average_l_tax"]
    out = q.aggregate(CATALOG, t, "lineitem", ["l_returnflag"], [made[n] for n in names])
    return out.withColumn("total_l_quantity", F.round("total_l_quantity", 2))


@query("SELECT s_nationkey, n_name, count(*) AS games, strftime(min(CAST(l_shipdate AS DATE)), '%Y-%m-%d') || ' to ' || strftime(max(CAST(l_shipdate AS DATE)), '%Y-%m-%d') AS dates, round(avg(l_quantity), 1) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def display_metadata(t, spark, d):
    """Display columns of a ranking: count, rounded mean, date range."""
    rows = q.Rows(CATALOG, t, "lineitem")
    key, name = rows.col("supplier.s_nationkey"), rows.col("nation.n_name")
    day = F.date_format("l_date", "yyyy-MM-dd")
    return rows.df.groupBy(key.alias("s_nationkey"), name.alias("n_name")).agg(F.count(F.lit(1)).alias("games"), F.concat_ws(" to ", F.min(day), F.max(day)).alias("dates"), F.round(F.avg("l_quantity"), 1).alias("quantity"))


@query("SELECT c_custkey, c.n_name AS home, s.n_name AS away, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY ALL")
def role_join(t, spark, d):
    """The same target joined twice under two roles."""
    from scorebook.plans.catalog import Catalog, LinkDef, ObjectDef

    sales = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    c = Catalog({"sale": ObjectDef("sale", ("l_orderkey", "l_linenumber")), "nation": ObjectDef("nation", ("n_nationkey",), "n_name")}, (LinkDef("sale", "nation", (("c_nationkey", "n_nationkey"),), "home"), LinkDef("sale", "nation", (("s_nationkey", "n_nationkey"),), "away")))
    rows = q.Rows(c, {"sale": sales, "nation": t["nation"]}, "sale")
    home, away = rows.col("nation@home.n_name"), rows.col("nation@away.n_name")
    return rows.df.groupBy("c_custkey", home.alias("home"), away.alias("away")).agg(F.count(F.lit(1)).alias("lines"))
