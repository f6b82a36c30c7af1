"""The catalog over the test tables: orders are games, customers the people, suppliers the teams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.plans.catalog import Catalog, LinkDef, MetricDef, ObjectDef

CATALOG = Catalog(
    objects={
        "orders": ObjectDef("orders", ("o_orderkey",), None, "o_date", derived={"o_year": "year({o_date})", "o_month": "date_format({o_date}, 'yyyy-MM')", "o_result": "case {o_orderstatus} when 'F' then 'win' when 'O' then 'loss' end"}),
        "lineitem": ObjectDef("lineitem", ("l_orderkey", "l_linenumber"), None, "l_date"),
        "customer": ObjectDef("customer", ("c_custkey",), "c_name"),
        "nation": ObjectDef("nation", ("n_nationkey",), "n_name"),
        "region": ObjectDef("region", ("r_regionkey",), "r_name"),
        "supplier": ObjectDef("supplier", ("s_suppkey",), "s_name"),
        "part": ObjectDef("part", ("p_partkey",), "p_name"),
        "customer_year": ObjectDef("customer_year", ("o_custkey", "o_year"), None),
    },
    links=(
        LinkDef("orders", "customer", (("o_custkey", "c_custkey"),)),
        LinkDef("customer", "nation", (("c_nationkey", "n_nationkey"),)),
        LinkDef("nation", "region", (("n_regionkey", "r_regionkey"),)),
        LinkDef("lineitem", "orders", (("l_orderkey", "o_orderkey"),)),
        LinkDef("lineitem", "part", (("l_partkey", "p_partkey"),)),
        LinkDef("lineitem", "supplier", (("l_suppkey", "s_suppkey"),)),
        LinkDef("supplier", "nation", (("s_nationkey", "n_nationkey"),)),
        LinkDef("customer_year", "customer", (("o_custkey", "c_custkey"),)),
    ),
    metrics={
        "total_price": MetricDef("total_price", "ratio", "round(sum(o_totalprice), 2)"),
        "average_price": MetricDef("average_price", "avg", "o_totalprice"),
        "largest_price": MetricDef("largest_price", "identity", "o_totalprice"),
        "wins": MetricDef("wins", "count_win", "o_result"),
        "losses": MetricDef("losses", "count_loss", "o_result", lower_is_better=True),
        "urgent": MetricDef("urgent", "count_true", "o_orderpriority = '1-URGENT'"),
        "win_share": MetricDef("win_share", "ratio", "round(100 * try_divide(sum(case when o_orderstatus = 'F' then 1 else 0 end), cast(count(1) as double)) * 10D) / 10D"),
        "year_total": MetricDef("year_total", "identity", "price_total"),
        "year_average": MetricDef("year_average", "identity", "price_total / games_played"),
    },
)


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    out = {t: read(t) for t in ("customer", "nation", "region", "supplier", "part", "events")}
    out["orders"] = read("orders").withColumn("o_date", F.to_date("o_orderdate"))
    out["lineitem"] = read("lineitem").withColumn("l_date", F.to_date("l_shipdate"))
    out["customer_year"] = out["orders"].groupBy("o_custkey", F.year("o_date").alias("o_year")).agg(F.round(F.sum("o_totalprice"), 2).alias("price_total"), F.count(F.lit(1)).alias("games_played"))
    return out
