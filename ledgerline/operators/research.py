"""Statistical validation: bootstrap, deflated Sharpe, factor regression, windows, sweeps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import ANNUAL, EULER_GAMMA, normal_cdf, normal_quantile, so_far
from ledgerline.operators import portfolio, signals
from ledgerline.operators.metrics import annual_vol, cagr, cash_cagr, metrics_table
from ledgerline.sources.panels import calendar, cash_accrual, settled

# -- deflated Sharpe ----------------------------------------------------------------------


def expected_max_sharpe(trials: Column) -> Column:
    """The expected largest of N standard normal trials; 0 under two."""
    n = trials.cast("double")
    z = (1 - EULER_GAMMA) * normal_quantile(1 - 1 / n) + EULER_GAMMA * normal_quantile(1 - 1 / (n * math.e))
    return F.when(n >= 2, z).otherwise(0.0)


def deflated_sharpe(returns: DataFrame, trials: DataFrame, sharpe_sd: float = 0.5, least: int = 100) -> DataFrame:
    """Per config of (config_id, ret, rf) and (config_id, n_trials): the probability that the Sharpe ratio is real.

    Skewness and kurtosis are the bias-corrected ones.  ``sharpe_sd`` is the annual deviation of
    Sharpe ratios across trials.
    """
    e = F.col("ret") - F.col("rf")
    m = returns.groupBy("config_id").agg(F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("sd"), F.skewness(e).alias("g1"), F.kurtosis(e).alias("g2"))
    n = F.col("n").cast("double")
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6) + 3
    m = m.where(F.col("n") >= least).withColumns({"skew": skew, "kurt": kurt, "sr": F.col("mean") / F.col("sd")}).join(trials, "config_id")
    # one column after the other, so that long expressions are evaluated once
    m = m.withColumn("sr0", expected_max_sharpe(F.col("n_trials")) * sharpe_sd / math.sqrt(ANNUAL))
    spread = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")))
    m = m.withColumn("z", (F.col("sr") - F.col("sr0")) * F.sqrt(n - 1) / spread)
    m = m.withColumn("dsr", normal_cdf(F.col("z")))
    return m.select("config_id", "n", "n_trials", "sr", "skew", "kurt", "sr0", "z", "dsr", (F.col("dsr") >= 0.95).alias("passes"))


# -- factor regression --------------------------------------------------------------------


FIT = (
    "config_id string, n long, lags int, alpha double, alpha_daily double, alpha_t double, alpha_p double, r2 double, residual_vol double, "
    "loadings map<string,double>, t map<string,double>, unit map<string,double>"
)


#: Days of a run that one task works on at once.
DAYS_A_BLOCK = 2048


def bartlett_lags(n: int) -> int:
    """The number of lags by the rule of thumb for ``n`` rows."""
    return math.ceil(4 * (n / 100) ** (2 / 9))


def moments(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cross products of (1, x, y), packed row by row: they add up over the parts of a run."""
    z = np.column_stack([np.ones(len(y)), x, y])
    return (z.T @ z).ravel()


def lagged_scores(y: np.ndarray, x: np.ndarray, beta: np.ndarray, mean: float, lags: int, halo: int) -> np.ndarray:
    """Bartlett sums of score products, squared residuals and squared deviations of the rows after the first ``halo``, packed.

    The rows before are the ``lags`` ones before this part of a run (fewer at its start), so that
    every product of a row with an earlier one is counted in the later row's part; the sums add up.
    """
    full = np.column_stack([np.ones(len(y)), x])
    u = y - full @ beta
    score = full * u[:, None]
    own = score[halo:]
    meat = own.T @ own
    for m in range(1, lags + 1):
        first = max(halo, m)
        cross = score[first:].T @ score[first - m : len(score) - m]
        meat += (1 - m / (lags + 1)) * (cross + cross.T)
    return np.concatenate([meat.ravel(), [u[halo:] @ u[halo:], (y[halo:] - mean) @ (y[halo:] - mean)]])


def fitted(total: np.ndarray, sums: np.ndarray, names: list[str], lags: int) -> dict:
    """The regression that the added :func:`moments` and :func:`lagged_scores` of a run give."""
    k = len(names) + 1
    z = total.reshape(k + 1, k + 1)
    inverse = np.linalg.inv(z[:k, :k])
    b, n = inverse @ z[:k, k], round(z[0, 0])
    meat, rss, tss = sums[: k * k].reshape(k, k), sums[-2], sums[-1]
    t = b / np.sqrt(np.diag(inverse @ meat @ inverse))
    length = float(np.linalg.norm(b[1:])) or 1.0
    named = lambda values: dict(zip(names, map(float, values), strict=True))
    return {
        "n": n, "lags": lags, "alpha": float((1 + b[0]) ** ANNUAL - 1), "alpha_daily": float(b[0]), "alpha_t": float(t[0]), "alpha_p": math.erfc(abs(t[0]) / math.sqrt(2)),
        "r2": float(1 - rss / tss), "residual_vol": float(math.sqrt(rss / (n - k) * ANNUAL)), "loadings": named(b[1:]), "t": named(t[1:]), "unit": named(b[1:] / length),
    }


def _added(parts: DataFrame, column: str, *keys: str) -> DataFrame:
    """Packed arrays of doubles added place by place."""
    each = parts.select(*keys, F.posexplode(column).alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("x"))
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("s")).select(*keys, F.col("s.x").alias(column))


def factor_regressions(runs: DataFrame, factors: DataFrame, lags: int | None = None, least: int = 200, days: int | None = None) -> DataFrame:
    """Per run of (config_id, date, ret, rf): OLS of excess returns on factor excess returns, with Bartlett errors.

    ``factors(series_id, date, ret)`` count on days that have every one of them.  Runs with fewer
    than ``least`` days give no row.  A run is cut into parts of ``days`` days: the parts' cross
    products add up to its coefficients, and with these the parts' lagged score products, each part
    with the days before it that its lags reach, add up to its errors.  Returns alpha (annual, t,
    p), loadings, their t-values and unit-length form, r2 and residual vol.
    """
    days = days or DAYS_A_BLOCK
    n_factors = factors.agg(F.countDistinct("series_id").alias("n"))
    day = factors.where("ret is not null").groupBy("date").agg(F.sort_array(F.collect_list(F.struct("series_id", "ret"))).alias("f"))
    whole = day.crossJoin(F.broadcast(n_factors)).where(F.size("f") == F.col("n")).select("date", F.col("f.series_id").alias("names"), F.col("f.ret").alias("f"))  # n_factors is one row
    joined = runs.where("ret is not null and rf is not null").join(whole, "date")
    excess = joined.select("config_id", "date", (F.col("ret") - F.col("rf")).alias("y"), F.transform("f", lambda x: x - F.col("rf")).alias("x"), "names")
    placed = excess.withColumn("pos", F.row_number().over(Window.partitionBy("config_id").orderBy("date")) - 1)
    rows = settled(placed.withColumn("part", (F.col("pos") / days).cast("int")))

    def pair(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table["y"].to_numpy(), table["x"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)

    def sums_of(table: pa.Table) -> pa.Table:
        return pa.table({"config_id": [table["config_id"][0].as_py()], "names": [table["names"][0].as_py()], "total": [moments(*pair(table))]})

    totals = rows.groupBy("config_id", "part").applyInArrow(sums_of, "config_id string, names array<string>, total array<double>")
    merged = _added(totals, "total", "config_id", "names").where(F.col("total")[0] >= least)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            beta, mean, reach = [], [], []
            for names, total in zip(b["names"].to_pylist(), b["total"].to_pylist(), strict=True):
                k = len(names) + 1
                z = np.array(total).reshape(k + 1, k + 1)
                beta.append(np.linalg.solve(z[:k, :k], z[:k, k]))
                mean.append(z[0, k] / z[0, 0])
                reach.append(bartlett_lags(round(z[0, 0])) if lags is None else lags)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(beta, pa.list_(pa.float64())), pa.array(mean, pa.float64()), pa.array(reach, pa.int32())], [*b.schema.names, "beta", "mean", "lags"])

    solved = settled(merged.mapInArrow(solve, "config_id string, names array<string>, total array<double>, beta array<double>, mean double, lags int"))
    held = rows.select("config_id", "pos", "y", "x", "part").join(solved.select("config_id", "beta", "mean", "lags"), "config_id")
    # a row stands in its own part and in the later ones whose first rows its lags reach
    last = ((F.col("pos") + F.col("lags")) / days).cast("int")
    held = held.withColumn("own", F.col("part")).withColumn("part", F.explode(F.sequence("own", last)))

    def errors_of(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        halo = int((table["own"].to_numpy() != table["part"].to_numpy()).sum())
        y, x = pair(table)
        got = lagged_scores(y, x, np.array(table["beta"][0].as_py()), table["mean"][0].as_py(), table["lags"][0].as_py(), halo)
        return pa.table({"config_id": [table["config_id"][0].as_py()], "sums": [got]})

    sums = _added(held.groupBy("config_id", "part").applyInArrow(errors_of, "config_id string, sums array<double>"), "sums", "config_id")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [{"config_id": c, **fitted(np.array(total), np.array(s), list(names), reach)} for c, total, s, names, reach in zip(b["config_id"], b["total"], b["sums"], b["names"], b["lags"], strict=True)]
            yield pd.DataFrame(found, columns=[c.split()[0] for c in FIT.split(", ")])

    return solved.join(sums, "config_id").select("config_id", "total", "sums", "names", "lags").mapInPandas(finish, FIT)


def factor_regression(run: DataFrame, factors: DataFrame, lags: int | None = None, least: int = 200) -> dict | None:
    """:func:`factor_regressions` of one run, as a dictionary, or None under ``least`` days."""
    row = factor_regressions(run.withColumn("config_id", F.lit("run")), factors, lags, least).first()
    return None if row is None else row.asDict()


# -- bootstrap ----------------------------------------------------------------------------


def drawn_days(n: int, rep: int, block: int = 21, seed: int = 7) -> np.ndarray:
    """The days of one stationary bootstrap sample: geometric blocks that wrap around, one draw for all series.

    A block starts at each place with chance 1/block.  The generator is keyed by (seed, rep), so
    any partitioning and any repeated task gives the same draws.
    """
    rng = np.random.Generator(np.random.Philox(key=[seed, rep]))
    new = rng.random(n) < 1.0 / block
    new[0] = True
    at, first = np.flatnonzero(new), rng.integers(0, n, n)
    start = at[np.cumsum(new) - 1]
    return (first[start] + np.arange(n) - start) % n


def bootstrap_draws(spark, n: int, reps: int, block: int = 21, seed: int = 7) -> DataFrame:
    """(rep, pos, idx): :func:`drawn_days` as rows."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rep in b["id"]:
                yield pd.DataFrame({"rep": rep, "pos": np.arange(n), "idx": drawn_days(n, rep, block, seed)})

    return spark.range(reps).mapInPandas(draw, "rep long, pos int, idx int")


def resampled(ret: np.ndarray, rf: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CAGR, Sharpe, drawdown) of samples, one a row of ``idx``; no Sharpe where returns do not vary."""
    r, e = ret[idx], (ret - rf)[idx]
    nav = np.cumprod(1 + r, axis=1)
    peak = np.maximum(np.maximum.accumulate(nav, axis=1), 1.0)
    sd = e.std(axis=1, ddof=1)
    sharpe = np.where(sd > 0, e.mean(axis=1) / np.where(sd > 0, sd, 1) * math.sqrt(ANNUAL), np.nan)
    return nav[:, -1] ** (ANNUAL / idx.shape[1]) - 1, sharpe, (1 - nav / peak).max(axis=1)


REPS_A_TASK = 100


def bootstrap(daily: DataFrame, baseline: str, reps: int = 2000, block: int = 21, seed: int = 7, least: int = 250) -> tuple[DataFrame, DataFrame]:
    """Confidence intervals per run, and paired Sharpe differences against ``baseline``.

    ``daily(config_id, date, ret, rf)`` over the days that all runs share; it is computed once and
    written, and so is the small table of results.  A run is one row of two arrays over the days;
    every (run, block of repetitions) is one row of work, so nothing is shuffled per sampled day,
    and runs and repetitions spread over all tasks.
    """
    daily = settled(daily.select("config_id", "date", "ret", "rf"))
    days = daily.groupBy("date").agg(F.countDistinct("config_id").alias("k")).crossJoin(F.broadcast(daily.agg(F.countDistinct("config_id").alias("all")))).where("k = all").select("date")  # one row
    n = days.count()
    if n < least:
        raise ValueError(f"{least} common days are needed, {n} found")
    rows = F.sort_array(F.collect_list(F.struct("date", "ret", "rf")))
    runs = daily.join(days, "date", "left_semi").groupBy("config_id").agg(rows.alias("d")).select("config_id", F.col("d.ret").alias("ret"), F.col("d.rf").alias("rf"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(REPS_A_TASK))).alias("first")
    work = runs.select("config_id", "ret", "rf", blocks).repartition("config_id", "first")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for config, ret, rf, first in zip(b["config_id"], b["ret"], b["rf"], b["first"], strict=True):
                some = np.arange(first, min(first + REPS_A_TASK, reps))
                cagr_, sharpe, drawdown = resampled(np.asarray(ret), np.asarray(rf), np.array([drawn_days(n, int(k), block, seed) for k in some]))
                yield pd.DataFrame({"config_id": config, "rep": some, "cagr": cagr_, "sharpe": sharpe, "max_drawdown": drawdown})

    stats = work.mapInPandas(draw, "config_id string, rep long, cagr double, sharpe double, max_drawdown double").withColumn("sharpe", F.nanvl("sharpe", F.lit(None)))
    base = F.max(F.when(F.col("config_id") == baseline, F.col("sharpe"))).over(Window.partitionBy("rep"))
    bounds = [F.expr(f"percentile({c}, array(0.025, 0.5, 0.975))").alias(c) for c in ("cagr", "sharpe", "max_drawdown")]
    paired = [F.avg("d").alias("mean_difference"), F.avg((F.col("d") <= 0).cast("double")).alias("p_not_better")]
    table = settled(stats.withColumn("d", F.col("sharpe") - base).groupBy("config_id").agg(F.count("*").alias("reps"), *bounds, *paired))
    return table.select("config_id", "reps", "cagr", "sharpe", "max_drawdown"), table.where((F.col("config_id") != baseline) & F.col("mean_difference").isNotNull()).select("config_id", "mean_difference", "p_not_better")


# -- windows and sweeps -------------------------------------------------------------------


def in_windows(daily: DataFrame, windows: DataFrame, least: int = 60) -> DataFrame:
    """CAGR, vol, Sharpe and drawdown per run in each window(label, lo, hi), both ends in; null under ``least`` rows.

    A row falls into each window that holds it; rows and windows meet by the years that a window touches.
    """
    touched = windows.select("label", "lo", "hi", F.explode(F.sequence(F.year("lo"), F.year("hi"))).alias("_year"))
    part = daily.withColumn("_year", F.year("date")).join(touched, "_year").where((F.col("date") >= F.col("lo")) & (F.col("date") <= F.col("hi")))
    w = so_far("config_id", "label")
    part = part.withColumn("dd", F.col("nav") / F.max("nav").over(w) - 1)
    ok = F.count("*") >= least
    out = part.groupBy("config_id", "label").agg(
        F.count("*").alias("n"), F.when(ok, cagr()).alias("cagr"), F.when(ok, annual_vol()).alias("vol"), F.when(ok, cash_cagr()).alias("cash"), F.when(ok, -F.min("dd")).alias("max_drawdown")
    )
    return out.withColumn("sharpe", (F.col("cagr") - F.col("cash")) / F.nullif("vol", F.lit(0.0))).drop("cash")


def equal_blocks(daily: DataFrame, n: int = 4) -> DataFrame:
    """windows(label, lo, hi): ``n`` equal calendar blocks and the whole, labelled by number."""
    ends = daily.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    edge = lambda i: F.date_add("a", F.floor(F.datediff("b", "a") * i / n).cast("int"))
    blocks = [F.struct(F.lit(f"block_{i + 1}").alias("label"), (edge(i) if i == 0 else F.date_add(edge(i), 1)).alias("lo"), edge(i + 1).alias("hi")) for i in range(n)]
    return ends.select(F.explode(F.array(*blocks, F.struct(F.lit("full").alias("label"), F.col("a").alias("lo"), F.col("b").alias("hi")))).alias("w")).select("w.*")


def walk_forward(daily: DataFrame, train_years: int = 5, folds: int = 4) -> DataFrame:
    """windows(label, lo, hi) of the test folds after an anchored training span; none if the data are shorter."""
    ends = daily.agg(F.min("date").alias("a0"), F.max("date").alias("b")).withColumn("a", F.add_months("a0", 12 * train_years)).where("a < b")
    edge = lambda i: F.date_add("a", F.floor(F.datediff("b", "a") * i / folds).cast("int"))
    parts = [F.struct(F.lit(f"fold_{i + 1}").alias("label"), (edge(i) if i == 0 else F.date_add(edge(i), 1)).alias("lo"), edge(i + 1).alias("hi")) for i in range(folds)]
    return ends.select(F.explode(F.array(*parts)).alias("w")).select("w.*")


def out_of_sample(daily: DataFrame, **kw) -> DataFrame:
    """Per run: folds measured, least and mean Sharpe over the walk-forward folds."""
    table = in_windows(daily, walk_forward(daily, **kw))
    return table.groupBy("config_id").agg(F.count("sharpe").alias("folds"), F.min("sharpe").alias("min_sharpe"), F.avg("sharpe").alias("mean_sharpe"))


def sweep(configs: DataFrame, name: str, values: list[float]) -> DataFrame:
    """Every config at every value of one parameter; config ids carry the value."""
    points = F.explode(F.array(*[F.lit(float(v)) for v in values]))
    return configs.withColumn("_v", points).withColumns({"base_id": F.col("config_id"), "config_id": F.concat_ws("@", "config_id", F.col("_v").cast("string")), name: F.col("_v")}).drop("_v")


def sweep_grid(configs: DataFrame, axes: dict[str, list[float]]) -> DataFrame:
    """One point a value of each axis, the others as in the config: a base row and its variations."""
    parts = [configs.withColumns({"axis": F.lit("base"), "at": F.lit(None).cast("double")})]
    for name, values in axes.items():
        kind = configs.schema[name].dataType
        points = configs.select("*", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias("at")).withColumns({"axis": F.lit(name), name: F.col("at").cast(kind)})
        parts.append(points.withColumn("config_id", F.concat_ws("@", "config_id", F.concat_ws("=", F.lit(name), F.col("at").cast("string")))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def swept_targets(panel: DataFrame, configs: DataFrame, window: int = 26, frequency: str = "monthly", base_lag: int = 1) -> DataFrame:
    """Targets (config_id, date, asset, weight) of every config at once, by what each knows on a rebalance.

    ``configs(config_id, template, lag, target_vol)``: a signal is known ``base_lag`` + lag trading
    days late, so a config's rebalance meets the signals of an earlier place in the calendar by a
    join on places.  Templates are equal, inverse_vol and ts_momentum; where target_vol is stated,
    weights are scaled down to it by the covariance known then.  Days on which something needed is
    missing keep their holdings.
    """
    returns = signals.simple_returns(panel)
    made = signals.momentum(signals.trailing_vol(returns, window), window)
    place = calendar(panel)
    known = made.join(place, "date").select(F.col("pos").alias("known"), F.col("series_id").alias("asset"), "vol", "mom")
    dates = signals.rebalance_dates(panel.select("date").distinct(), frequency).join(place, "date")
    asked = configs.select("config_id", "template", "lag", "target_vol").crossJoin(dates).withColumn("known", (F.col("pos") - base_lag - F.col("lag")).cast("int"))  # configs times rebalances: the size of the result
    day = Window.partitionBy("config_id", "date")
    rows = asked.join(known, "known")
    vol_ok, mom_ok = F.coalesce(F.col("vol") > 0, F.lit(False)), F.col("mom").isNotNull()
    raw = F.when(F.col("template") == "equal", 1.0).when(F.col("template") == "inverse_vol", 1 / F.col("vol")).when(F.col("mom") > 0, 1 / F.col("vol")).otherwise(0.0)
    fine = F.when(F.col("template") == "equal", F.col("vol").isNotNull()).when(F.col("template") == "inverse_vol", vol_ok).otherwise(vol_ok & mom_ok)
    rows = rows.withColumns({"fine": F.min(fine.cast("int")).over(day)}).where("fine = 1").withColumn("raw", raw)
    rows = rows.withColumn("weight", F.coalesce(F.col("raw") / F.nullif(F.sum("raw").over(day), F.lit(0.0)), F.lit(0.0)))
    cov = signals.rolling_cov(returns, window).join(place, "date").select(F.col("pos").alias("known"), "asset_i", "asset_j", "cov")
    both = cov.unionByName(cov.where("asset_i != asset_j").select("known", F.col("asset_j").alias("asset_i"), F.col("asset_i").alias("asset_j"), "cov"))
    scaled = rows.where("target_vol is not null")
    other = scaled.select("config_id", "date", F.col("asset").alias("asset_j"), F.col("weight").alias("w_j"))
    vols = scaled.select("config_id", "date", "known", F.col("asset").alias("asset_i"), "weight").join(both, ["known", "asset_i"]).join(other, ["config_id", "date", "asset_j"])
    vols = vols.groupBy("config_id", "date").agg(F.sqrt(F.sum(F.col("weight") * F.col("w_j") * F.col("cov"))).alias("mix"))
    out = rows.join(vols, ["config_id", "date"], "left").where("target_vol is null or mix is not null")
    factor = F.when(F.col("target_vol").isNull() | ~(F.col("mix") > 0), 1.0).otherwise(F.least(F.lit(1.0), F.col("target_vol") / F.col("mix")))
    return out.select("config_id", "date", "asset", (F.col("weight") * factor).alias("weight"))


def sweep_metrics(panel: DataFrame, configs: DataFrame, window: int = 26) -> DataFrame:
    """The metrics of every point of a grid, as one job: signals, targets, accounting and statistics.

    ``configs(config_id, template, spread_bps, lag, target_vol, cash_rate)``; see :func:`sweep_grid`.
    """
    targets = swept_targets(panel, configs, window)
    cash = cash_accrual(panel.select("date").distinct(), 0.0)
    daily = portfolio.account(targets, portfolio.asset_returns(panel), cash, configs)
    rate = configs.select("config_id", (F.pow(1 + F.col("cash_rate"), F.lit(1 / ANNUAL)) - 1).alias("rf"))
    return metrics_table(settled(daily.join(rate, "config_id")))  # read by five statistics
