"""Performance metrics of many runs at once: runs_daily(config_id, date, nav, ret, turnover, rf).

``years`` are calendar days / 365.25 between the first and the last row; a year has 252 rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import ANNUAL, full, so_far, trailing

KEY = "config_id"


def years() -> Column:
    return F.datediff(F.max("date"), F.min("date")) / F.lit(365.25)


def cagr(nav: str = "nav") -> Column:
    first, last = F.min_by(nav, "date"), F.max_by(nav, "date")
    return F.when((F.count(nav) >= 2) & (first > 0) & (years() > 0), F.pow(last / first, 1 / years()) - 1)


def annual_vol(ret: str = "ret") -> Column:
    return F.when(F.count(ret) > 2, F.stddev_samp(ret) * math.sqrt(ANNUAL))


def cash_cagr() -> Column:
    return F.when(years() > 0, F.pow(F.product(1 + F.col("rf")), 1 / years()) - 1)


def arithmetic_sharpe() -> Column:
    excess = F.col("ret") - F.col("rf")
    return F.avg(excess) / F.nullif(F.stddev_samp(excess), F.lit(0.0)) * math.sqrt(ANNUAL)


def drawdowns(daily: DataFrame) -> DataFrame:
    return daily.withColumn("dd", F.col("nav") / F.max("nav").over(so_far(KEY)) - 1)


def underwater(daily: DataFrame) -> DataFrame:
    """(config_id, longest_underwater): days from the first row under water to recovery, or to the last row."""
    w = Window.partitionBy(KEY).orderBy("date")
    marked = drawdowns(daily).withColumn("under", F.col("dd") < -1e-12)
    spells = marked.withColumns({"spell": F.sum((~F.col("under")).cast("int")).over(so_far(KEY)), "next": F.lead("date").over(w)}).where("under")
    ends = spells.groupBy(KEY, "spell").agg(F.min("date").alias("start"), F.max_by(F.coalesce("next", "date"), "date").alias("stop"))
    longest = ends.groupBy(KEY).agg(F.max(F.datediff("stop", "start")).alias("longest_underwater"))
    return daily.select(KEY).distinct().join(longest, KEY, "left").fillna(0, ["longest_underwater"])


def cvar(daily: DataFrame, horizon: int = 21, tail: float = 0.05, least: int = 126) -> DataFrame:
    """(config_id, cvar): minus the mean of compounded ``horizon``-row returns at or below their ``tail`` quantile."""
    w = trailing(horizon, KEY)
    made = daily.withColumn("h", full(F.product(1 + F.col("ret")).over(w) - 1, F.col("ret"), w, horizon))
    sized = made.withColumns({"n": F.count("ret").over(Window.partitionBy(KEY)), "q": F.expr(f"percentile(h, {tail})").over(Window.partitionBy(KEY))})
    return sized.groupBy(KEY).agg(F.when(F.max("n") >= least, -F.avg(F.when(F.col("h") <= F.col("q"), F.col("h")))).alias("cvar"))


def yearly_vol_spread(daily: DataFrame) -> DataFrame:
    by_year = daily.groupBy(KEY, F.year("date").alias("y")).agg((F.stddev_samp("ret") * math.sqrt(ANNUAL)).alias("v"))
    return by_year.groupBy(KEY).agg((F.max("v") - F.min("v")).alias("vol_spread"))


def monthly_hit_rate(daily: DataFrame) -> DataFrame:
    """Share of calendar months that gained; months without a row count as no gain."""
    months = daily.groupBy(KEY, F.trunc("date", "month").alias("m")).agg((F.product(1 + F.col("ret")) - 1).alias("r"))
    return months.groupBy(KEY).agg((F.sum((F.col("r") > 0).cast("int")) / (F.months_between(F.max("m"), F.min("m")) + 1)).alias("hit_rate"))


def metrics_table(daily: DataFrame) -> DataFrame:
    """Fifteen metrics a run, from one grouped pass and the path statistics beside it."""
    core = drawdowns(daily).groupBy(KEY).agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n"), cagr().alias("cagr"), annual_vol().alias("vol"), cash_cagr().alias("cash_cagr"),
        arithmetic_sharpe().alias("sharpe_arithmetic"), (-F.min("dd")).alias("max_drawdown"), (-F.avg("dd")).alias("mean_drawdown"), (F.avg("turnover") * ANNUAL).alias("turnover"),
    )
    core = core.withColumn("sharpe", (F.col("cagr") - F.col("cash_cagr")) / F.nullif("vol", F.lit(0.0)))
    for part in (underwater(daily), cvar(daily), yearly_vol_spread(daily), monthly_hit_rate(daily)):
        core = core.join(part, KEY, "left")
    return core


# -- against a benchmark and a book -------------------------------------------------------


def relative(pairs: DataFrame, *by: str, least: int = 100) -> DataFrame:
    """Benchmark-relative statistics of (ret, bench, rf) rows grouped ``by``; null under ``least`` rows.

    ``alpha_row`` is the mean left by beta in a row; ``alpha`` compounds it over a year's rows.
    """
    se, be, active = F.col("ret") - F.col("rf"), F.col("bench") - F.col("rf"), F.col("ret") - F.col("bench")
    beta = F.covar_samp(se, be) / F.nullif(F.var_samp(be), F.lit(0.0))
    root = math.sqrt(ANNUAL)
    capture = lambda cond: F.when(F.count(F.when(cond, 1)) > 20, F.avg(F.when(cond, F.col("ret"))) / F.nullif(F.avg(F.when(cond, F.col("bench"))), F.lit(0.0)))
    ok = F.count("*") >= least
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.when(ok, beta).alias("beta"), F.when(ok, F.avg(se) - beta * F.avg(be)).alias("alpha_row"), F.when(ok, F.pow(1 + F.avg(se) - beta * F.avg(be), ANNUAL) - 1).alias("alpha"),
        F.when(ok, F.stddev_samp(active) * root).alias("tracking_error"), F.when(ok, F.avg(active) / F.nullif(F.stddev_samp(active), F.lit(0.0)) * root).alias("information_ratio"),
        F.when(ok, F.avg(active) * ANNUAL).alias("active_return"), F.when(ok, F.corr("ret", "bench")).alias("corr"),
        F.when(ok, capture(F.col("bench") > 0)).alias("up_capture"), F.when(ok, capture(F.col("bench") < 0)).alias("down_capture"),
    )


def similarity(run: DataFrame, others: DataFrame, least: int = 100) -> DataFrame:
    """Against each series of ``others(series_id, date, ret)``: corr, beta, share of vol left by it."""
    both = run.select("date", F.col("ret").alias("a")).join(others.select("series_id", "date", F.col("ret").alias("b")), "date").where("a is not null and b is not null")
    beta = F.covar_samp("a", "b") / F.nullif(F.var_samp("b"), F.lit(0.0))
    left = F.sqrt(F.greatest(F.var_samp("a") - 2 * beta * F.covar_samp("a", "b") + beta * beta * F.var_samp("b"), F.lit(0.0))) / F.stddev_samp("a")
    out = both.groupBy("series_id").agg(F.count("*").alias("n"), F.corr("a", "b").alias("corr"), beta.alias("beta"), left.alias("residual_vol"))
    return out.where(F.col("n") >= least).sort(F.desc("corr"), "series_id")


def incremental(run: DataFrame, book: DataFrame, sleeves: list[float], least: int = 200) -> DataFrame:
    """For each sleeve weight: the mix's information ratio and its gain, tracking error and CAGR."""
    grid = F.explode(F.array(*[F.lit(float(w)) for w in sorted({0.0, *sleeves})])).alias("sleeve")
    both = run.select("date", F.col("ret").alias("a")).join(book.select("date", F.col("ret").alias("b"), "rf"), "date").select("*", grid)
    mix = F.col("sleeve") * F.col("a") + (1 - F.col("sleeve")) * F.col("b")
    excess = mix - F.col("rf")
    table = both.groupBy("sleeve").agg(
        F.count("*").alias("n"), (F.avg(excess) / F.nullif(F.stddev_samp(excess), F.lit(0.0)) * math.sqrt(ANNUAL)).alias("ir"),
        (F.stddev_samp(mix - F.col("b")) * math.sqrt(ANNUAL)).alias("tracking_error"), (F.pow(F.product(1 + mix), F.lit(float(ANNUAL)) / F.count("*")) - 1).alias("cagr"),
    )
    base = F.first("ir").over(Window.partitionBy("n").orderBy("sleeve").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return table.where(F.col("n") >= least).withColumn("delta_ir", F.col("ir") - base)


def turnover_capacity(runs: DataFrame, adv: float, participation: float = 0.10) -> DataFrame:
    """From (config_id, turnover, n_rebalances, years, aum): traded share and days to trade per rebalance."""
    fraction = F.col("turnover") / (F.col("n_rebalances") / F.col("years"))
    notional = F.col("aum") * fraction * 2
    return runs.withColumns({"fraction": fraction, "notional": notional, "days": notional / (adv * participation)})


def mandate_check(daily: DataFrame, weights: DataFrame, max_cash: float = 0.05, max_weight: float = 0.5) -> DataFrame:
    """Realised cash and weights against a mandate, with the list of violations."""
    cash = daily.groupBy(KEY).agg(F.max("cash_weight").alias("max_cash"), F.avg("cash_weight").alias("mean_cash"), F.sum((F.col("cash_weight") > max_cash).cast("int")).alias("days_over_cash"))
    held = weights.groupBy(KEY).agg(F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"))
    broken = F.array_compact(F.array(F.when(F.col("max_cash") > max_cash, "cash above the limit"), F.when(F.col("min_weight") < 0, "short position"), F.when(F.col("max_weight") > max_weight, "weight above the limit")))
    return cash.join(held, KEY, "left").withColumn("violations", broken)


def replication_gap(targets: DataFrame, measured: DataFrame) -> DataFrame:
    """targets(portfolio, metric, target, tolerance, absolute_tolerance) against measured(portfolio, metric, value)."""
    both = targets.join(measured, ["portfolio", "metric"], "left")
    gap = F.abs(F.col("value") - F.col("target"))
    relative_gap = gap / F.nullif(F.abs("target"), F.lit(0.0))
    passed = F.when(F.col("absolute_tolerance").isNotNull(), gap <= F.col("absolute_tolerance")).otherwise(relative_gap <= F.col("tolerance"))
    return both.withColumns({"gap": gap, "relative_gap": relative_gap, "passed": F.coalesce(passed, F.lit(False))})


def write_metrics(table: DataFrame, path: str) -> None:
    """The metrics table as CSV with a header; an existing folder is refused."""
    flat = table.withColumns({c: F.concat_ws("; ", c) for c, k in table.dtypes if k.startswith("array")})
    flat.write.mode("errorifexists").option("header", True).csv(path)
