"""Data audits and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import in_order, messages
from ledgerline.sources.panels import provenance


def audit(panel: DataFrame) -> DataFrame:
    """Per series: coverage, gaps, zero returns, extremes, stale runs of five, non-positive prices."""
    held = panel.where("value is not null").withColumn("ret", F.col("value") / F.lag("value").over(in_order("series_id")) - 1)
    last5 = in_order("series_id").rowsBetween(-4, 0)
    marked = held.withColumn("stale5", (F.sum((F.col("ret") == 0).cast("int")).over(last5) == 5).cast("int"))
    stats = marked.groupBy("series_id").agg(
        F.sum((F.col("ret") == 0).cast("int")).alias("zero_returns"), F.max(F.abs("ret")).alias("max_abs_return"), F.sum((F.abs("ret") > 0.2).cast("int")).alias("large_returns"),
        F.sum(F.coalesce("stale5", F.lit(0))).alias("stale_windows"), F.sum((F.col("value") <= 0).cast("int")).alias("non_positive"),
    )
    return provenance(panel).join(stats, "series_id")


def diagnose(master: DataFrame) -> DataFrame:
    """One row: counts, survivors and the messages that block or warn.

    ``master(security_id, date, price, in_universe)``, maybe with ``adv`` and ``free_float_mcap``.
    """
    each = master.groupBy("security_id").agg(F.max(F.when(F.col("price").isNotNull(), F.col("date"))).alias("last"), F.min(F.col("in_universe").cast("int")).alias("always"))
    end = master.agg(F.max("date").alias("end"), F.countDistinct("date").alias("n_dates"))
    joined = each.crossJoin(F.broadcast(end))  # one row
    counts = joined.agg(
        F.count("*").alias("n_securities"), F.first("n_dates").alias("n_dates"), F.sum((F.col("last") == F.col("end")).cast("int")).alias("alive_at_end"),
        F.sum(F.coalesce("always", F.lit(0))).alias("never_left"), F.sum(F.col("last").isNull().cast("int")).alias("never_priced"),
    )
    ratio = F.col("alive_at_end") / F.col("n_securities")
    counts = counts.withColumn("survivor_ratio", ratio)
    blockers = messages(((F.col("survivor_ratio") > 0.98) & (F.col("n_dates") > 500), "nearly every security survives"), (F.col("n_securities") == 0, "no securities"))
    warnings = messages(
        ((F.col("survivor_ratio") > 0.9) & (F.col("survivor_ratio") <= 0.98), "many securities survive"),
        (F.col("never_priced") > 0, "securities without a price"),
        (F.lit("adv" not in master.columns), "no traded value"),
        (F.lit("free_float_mcap" not in master.columns), "no free float"),
    )
    return counts.withColumns({"blockers": blockers, "warnings": warnings})


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Two result sets: per quantity, keys in both and in one, worst difference, and the verdict; null equals null."""
    a = left.select(*keys, *[F.col(v).cast("double").alias(f"{v}_a") for v in values], F.lit(1).alias("in_a"))
    b = right.select(*keys, *[F.col(v).cast("double").alias(f"{v}_b") for v in values], F.lit(1).alias("in_b"))
    both = a.join(b, keys, "full")
    parts = []
    shared = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    for v in values:
        x, y = F.col(f"{v}_a"), F.col(f"{v}_b")
        same = x.eqNullSafe(y) | (F.isnan(x) & F.isnan(y))
        off = F.when(same, 0.0).when(x.isNull() | y.isNull() | F.isnan(x) | F.isnan(y), float("inf")).otherwise(F.abs(x - y))
        parts.append(both.agg(F.lit(v).alias("quantity"), F.sum(shared.cast("int")).alias("shared"), F.sum((~shared).cast("int")).alias("unmatched"), F.max(F.when(shared, off)).alias("worst")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("agrees", (F.coalesce("worst", F.lit(0.0)) <= tolerance) & (F.coalesce("unmatched", F.lit(0)) == 0))


def ledger_totals(calls: DataFrame, *by: str) -> DataFrame:
    """Counts, token sums, cache-hit share, latency and errors of recorded model calls."""
    return calls.groupBy(*by).agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.avg((F.col("cache_read_tokens") > 0).cast("double")).alias("cache_hit_rate"), F.sum("latency_s").alias("latency_s"), F.count("error").alias("errors"),
    )


def top_per_group(df: DataFrame, by: list[str], order: list, k: int, always=None) -> DataFrame:
    """The first ``k`` rows of each group, and rows for which ``always`` holds."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    keep = F.col("_n") <= k
    return df.withColumn("_n", n).where(keep if always is None else keep | F.coalesce(always, F.lit(False))).drop("_n")
