"""Registered queries on reports whose tables come from line items: row counts, captions and conflicts vary with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import evidence
from ledgerline.plans import tables as t
from ledgerline.plans.queries import query, r6


def lot_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, text): a supplier's lots by discount, a page for each return flag, captions above or below the table."""
    lines = t.table(spark, sf_dir, "lineitem")
    k, d = F.col("l_suppkey"), F.round(F.col("l_discount") * 100).cast("int")
    page = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    lots = lines.groupBy(k.alias("k"), page.alias("page"), d.alias("d")).agg(F.count("*").alias("c"), F.max("l_quantity").cast("int").alias("q"))
    lots = lots.where(F.when((F.col("k") % 5 == 0) & (F.col("page") == 1), F.col("d") == 4).otherwise((F.col("k") + 3 * F.col("page") + F.col("d")) % 4 > 0))
    row = F.concat(F.lit("Lot of rate "), F.col("d").cast("string"), F.lit(" each  "), F.col("c").cast("string"), F.lit(" "), F.col("q").cast("string"))
    rows = lots.groupBy("k", "page").agg(F.sort_array(F.collect_list(F.struct("d", row.alias("row")))).alias("r"))
    body = F.array_join(F.col("r.row"), "\n")
    text = F.when(F.col("k") % 2 == 0, F.concat(F.lit("Table 1: lots\nReturn and Volatility\n"), body)).otherwise(F.concat(F.lit("Return and Volatility\n"), body, F.lit("\n\nTable 2. lots again")))
    return rows.select(F.col("k").cast("string").alias("doc_id"), "page", text.alias("text"))


_LOTS = """l AS (SELECT l_suppkey AS k, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS page, round(l_discount * 100)::INT AS d, count(*) AS c, max(l_quantity)::INT AS q FROM lineitem GROUP BY ALL),
    g AS (SELECT * FROM l WHERE CASE WHEN k % 5 = 0 AND page = 1 THEN d = 4 ELSE (k + 3 * page + d) % 4 > 0 END),
    tb AS (SELECT k, page, count(*) AS n_rows, sum(c + q)::DOUBLE AS total FROM g GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT g.* FROM g JOIN tb USING (k, page)),
    cf AS (SELECT k, d, 'cagr' AS metric, count(DISTINCT c) AS n FROM r GROUP BY ALL UNION ALL SELECT k, d, 'vol', count(DISTINCT q) FROM r GROUP BY ALL)"""


@query(f"WITH {_LOTS} SELECT k::VARCHAR AS doc_id, page, n_rows, CASE WHEN k % 2 = 0 THEN 'Table 1: lots' ELSE 'Table 2. lots again' END AS caption, 'Return and Volatility' AS header, round(total, 6) AS total FROM tb")
def lot_tables(spark, sf_dir):
    """Tables of reports by the lines they stand in, with header, caption and the sum of their numbers."""
    tables = evidence.recover_tables(lot_reports(spark, sf_dir))
    total = F.aggregate(F.flatten(F.transform("rows", lambda r: r["numbers"])), F.lit(0.0), lambda a, x: a + x)
    return r6(tables.select("doc_id", "page", "n_rows", "caption", "header", total.alias("total")))


@query(f"WITH {_LOTS} SELECT k::VARCHAR AS doc_id, page, n_rows FROM tb QUALIFY row_number() OVER (PARTITION BY k ORDER BY n_rows DESC, page) = 1")
def lot_largest_tables(spark, sf_dir):
    """Each report's table with the most rows, the first among equals."""
    return evidence.largest_table(evidence.recover_tables(lot_reports(spark, sf_dir))).select("doc_id", "page", "n_rows")


@query(f"WITH {_LOTS} SELECT k::VARCHAR AS doc_id, 'Lot of rate ' || d || ' each' AS portfolio, metric, n AS n_values FROM cf WHERE n > 1")
def lot_conflicts(spark, sf_dir):
    """Numbers that a report prints with several values on its pages."""
    found = evidence.conflicts(evidence.propose_targets(evidence.recover_tables(lot_reports(spark, sf_dir))))
    return found.select("doc_id", "portfolio", "metric", F.size("vals").cast("long").alias("n_values"))


@query(f"""WITH {_LOTS}, p AS (SELECT k, count(DISTINCT page) AS n_pages FROM g GROUP BY 1), a AS (SELECT k, count(*) AS tables, (2 * sum(n_rows))::BIGINT AS targets FROM tb GROUP BY 1), c AS (SELECT k, count(*) AS conflicts FROM cf WHERE n > 1 GROUP BY 1)
    SELECT k::VARCHAR AS doc_id, n_pages, coalesce(tables, 0) AS tables, coalesce(targets, 0) AS targets, coalesce(conflicts, 0) AS conflicts FROM p LEFT JOIN a USING (k) LEFT JOIN c USING (k)""")
def lot_comparison(spark, sf_dir):
    """Reports side by side: pages, tables, proposed targets and conflicts."""
    pages = lot_reports(spark, sf_dir)
    return evidence.compare_documents(pages, evidence.scan(pages)).select("doc_id", "n_pages", "tables", "targets", "conflicts")
