"""Panels and dimension tables derived from the star schema, in Spark and as SQL.

Values are sums of decimals divided once, so both engines start from equal doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources import panels

RATE = 0.04


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def segment_panel(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """Mean order price by market segment: a fixed universe of five series."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.date_trunc(unit, "o_orderdate").cast("date").alias("date"))
    joined = orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("series_id")), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("series_id", "date").agg((money("o_totalprice") / F.count("*")).alias("value"))


def segment_sql(unit: str = "week") -> str:
    return f"""seg AS (
        SELECT c_mktsegment AS series_id, date_trunc('{unit}', o_orderdate)::DATE AS date, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS value
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def brand_panel(spark: SparkSession, sf_dir: str, least: int = 3, unit: str = "week") -> DataFrame:
    """Price per unit by brand, with members where enough lines stand behind it: a changing universe."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", F.date_trunc(unit, "l_shipdate").cast("date").alias("date"))
    joined = lines.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("series_id")), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("series_id", "date").agg((money("l_extendedprice") / money("l_quantity")).alias("value"), (F.count("*") >= least).alias("member"), F.count("*").alias("n_lines"))


def brand_sql(least: int = 3, unit: str = "week") -> str:
    return f"""brand AS (
        SELECT p_brand AS series_id, date_trunc('{unit}', l_shipdate)::DATE AS date,
            sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE AS value, count(*) >= {least} AS member, count(*) AS n_lines
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value by type and day."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("date")).agg((money("value") / F.count("*")).alias("value"))


EVENT_SQL = "ev AS (SELECT event_type AS series_id, ts::DATE AS date, sum(value::DECIMAL(18,2))::DOUBLE / count(*) AS value FROM events GROUP BY 1, 2)"


def cash(days: DataFrame) -> DataFrame:
    return panels.cash_accrual(days.select("date").distinct(), RATE)


CASH_SQL = f"cash AS (SELECT DISTINCT date, pow({1 + RATE}::DOUBLE, 1.0::DOUBLE / 252) - 1 AS rf FROM seg)"


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint library: customers' spending shares by order priority as factor loadings."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(money("o_totalprice").alias("x"))
    shares = orders.groupBy("o_custkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("o_orderpriority", "x")))).alias("factor_fingerprint"), F.count("*").alias("n"))
    named = shares.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return named.select(
        F.col("o_custkey").cast("string").alias("entry_id"), F.concat_ws("_", "c_mktsegment", "c_nationkey").alias("card_id"), F.concat_ws(":", "c_nationkey", "n").alias("card_fingerprint"), "factor_fingerprint"
    )


LIBRARY_SQL = """sp AS (SELECT o_custkey, o_orderpriority AS factor, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS x FROM orders GROUP BY 1, 2),
    lib AS (
        SELECT o_custkey::VARCHAR AS entry_id, any_value(c_mktsegment) || '_' || any_value(c_nationkey) AS card_id,
            any_value(c_nationkey) || ':' || count(*) AS card_fingerprint, count(*) AS k
        FROM sp JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey)"""


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards (brands) that require part types; colours of parts stand for kinds."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_brand").alias("card_id"), F.concat_ws("_", "p_type", F.col("p_size").cast("string")).alias("name"), F.col("p_type").alias("kind"), (F.col("p_size") % 3 == 0).alias("mandatory")).distinct()


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and sizes of the parts that were ordered, each a declared proxy of the next size."""
    ordered = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    part = table(spark, sf_dir, "part").join(ordered, "p_partkey", "left_semi").select("p_type", "p_size").distinct()
    name = lambda size: F.concat_ws("_", "p_type", size.cast("string"))
    return part.select(
        name(F.col("p_size")).alias("name"), F.when(F.col("p_size") % 7 == 0, "restated").otherwise("pit").alias("pit_status"), F.array(name(F.col("p_size") + 1)).alias("is_proxy_for"),
        F.array(F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("caveats"), F.col("p_size").alias("ord"),
    )


FEASIBILITY_SQL = """req AS (SELECT DISTINCT p_brand AS card_id, p_type || '_' || p_size AS name, p_type AS kind, p_size % 3 = 0 AS mandatory FROM part),
    reg AS (SELECT DISTINCT p_type || '_' || p_size AS name, CASE WHEN p_size % 7 = 0 THEN 'restated' ELSE 'point_in_time' END AS pit, p_type || '_' || (p_size + 1) AS stands_for FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
    res AS (
        SELECT req.*, CASE WHEN h.name IS NOT NULL THEN CASE WHEN h.pit = 'point_in_time' THEN 'AVAILABLE' ELSE 'DEGRADED' END WHEN x.name IS NOT NULL THEN 'PROXY' ELSE 'UNAVAILABLE' END AS status,
            coalesce(h.name, x.name) AS resolved_to
        FROM req LEFT JOIN reg h ON h.name = req.name LEFT JOIN reg x ON x.stands_for = req.name)"""
