"""Registered queries that re-run a portfolio over grids of its parameters, one job from prices to metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import portfolio, research, signals
from ledgerline.plans import tables as t
from ledgerline.plans.queries import _BRAND_E, _COV, _RET, _XS, ROOT, SPREAD, _configs, _rebalances, _win, account_sql, query, r6

#: Two base configs and the values that each axis takes.
BASES = (("inverse", "inverse_vol"), ("momentum", "ts_momentum"))
AXES = {"spread_bps": [0.0, 60.0], "lag": [1.0, 4.0], "target_vol": [1.0, 4.0], "cash_rate": [0.0, 0.08]}
_BASE = {"spread_bps": 30.0, "lag": 0, "target_vol": None, "cash_rate": 0.04}


def grid(spark: SparkSession) -> DataFrame:
    """Every config of the study: the bases, and each with one parameter moved."""
    schema = "config_id string, template string, spread_bps double, lag int, target_vol double, cash_rate double"
    base = spark.createDataFrame([(name, template, *_BASE.values()) for name, template in BASES], schema)
    return research.sweep_grid(base, AXES)


def _grid_sql() -> str:
    rows = []
    for name, template in BASES:
        for axis, value in [(None, None), *[(a, v) for a, values in AXES.items() for v in values]]:
            point = _BASE | ({axis: value} if axis else {})
            rows.append(f"('{name}{f'@{axis}={value}' if axis else ''}', '{template}', {point['spread_bps']}::DOUBLE, {int(point['lag'])}, {'NULL' if point['target_vol'] is None else point['target_vol']}::DOUBLE, {point['cash_rate']}::DOUBLE)")
    return f"cf(config_id, template, spread_bps, lag, target_vol, cash_rate) AS (VALUES {', '.join(rows)})"


_TARGETS = f"""{_grid_sql()}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM seg)), {_COV},
    sig AS (SELECT series_id AS asset, date, CASE WHEN count(ret) {_win(26)} = 26 THEN stddev_samp(ret) {_win(26)} * {ROOT} END AS vol, value / lag(value, 26) OVER (PARTITION BY series_id ORDER BY date) - 1 AS mom FROM ret),
    known AS (SELECT pos AS known, asset, vol, mom FROM sig JOIN d USING (date)),
    asked AS (SELECT cf.*, date, pos - 1 - lag AS known FROM cf, (SELECT max(date) AS date FROM seg GROUP BY date_trunc('month', date)) JOIN d USING (date)),
    fit AS (SELECT a.*, asset, CASE WHEN template = 'inverse_vol' OR mom > 0 THEN 1 / vol ELSE 0 END AS raw, min((coalesce(vol > 0, false) AND (template = 'inverse_vol' OR mom IS NOT NULL))::INT) OVER (PARTITION BY config_id, date) AS fine FROM asked a JOIN known USING (known)),
    w AS (SELECT *, coalesce(raw / nullif(sum(raw) OVER (PARTITION BY config_id, date), 0), 0) AS w FROM fit WHERE fine = 1),
    sym AS (SELECT pos AS known, asset_i, asset_j, cov FROM (SELECT * FROM cov UNION ALL SELECT date, asset_j, asset_i, cov FROM cov WHERE asset_i <> asset_j) JOIN d USING (date)),
    mix AS (SELECT a.config_id, a.date, sqrt(sum(a.w * b.w * c.cov)) AS mix FROM w a JOIN w b ON b.config_id = a.config_id AND b.date = a.date JOIN sym c ON c.known = a.known AND c.asset_i = a.asset AND c.asset_j = b.asset WHERE a.target_vol IS NOT NULL GROUP BY ALL),
    targets AS (SELECT w.config_id, w.date, asset, w.w * CASE WHEN target_vol IS NULL OR NOT mix > 0 THEN 1 ELSE least(1, target_vol / mix) END AS weight FROM w LEFT JOIN mix ON mix.config_id = w.config_id AND mix.date = w.date WHERE target_vol IS NULL OR mix IS NOT NULL),
    rate AS (SELECT config_id, pow(1 + cash_rate, 1.0::DOUBLE / 252) - 1 AS rf FROM cf)"""
_DAILY = f"""WITH {t.segment_sql()}, sege AS (SELECT *, true AS eligible FROM seg), {account_sql(_TARGETS, "sege", "(SELECT spread_bps FROM cf WHERE cf.config_id = g.config_id)", "rate c ON c.config_id = s.config_id")}"""
_CORE = f"""dd AS (SELECT daily.*, rf, nav / max(nav) OVER (PARTITION BY config_id ORDER BY date) - 1 AS dd FROM daily JOIN rate USING (config_id)),
    core AS (SELECT config_id, count(*) AS n, pow(arg_max(nav, date) / arg_min(nav, date), 365.25::DOUBLE / (max(date) - min(date))) - 1 AS cagr, stddev_samp(ret) * {ROOT} AS vol, pow(product(1 + rf), 365.25::DOUBLE / (max(date) - min(date))) - 1 AS cash_cagr,
        avg(ret - rf) / stddev_samp(ret - rf) * {ROOT} AS sharpe_arithmetic, -min(dd) AS max_drawdown, -avg(dd) AS mean_drawdown, avg(turnover) * 252 AS turnover FROM dd GROUP BY config_id)"""


@query(f"""{_DAILY}, {_CORE} SELECT config_id, n, round(cagr, 6) AS cagr, round(vol, 6) AS vol, round(cash_cagr, 6) AS cash_cagr, round(sharpe_arithmetic, 6) AS sharpe_arithmetic, round(max_drawdown, 6) AS max_drawdown,
    round(mean_drawdown, 6) AS mean_drawdown, round(turnover, 6) AS turnover, round((cagr - cash_cagr) / vol, 6) AS sharpe FROM core""")
def sweep_metrics(spark, sf_dir):
    """Cost, lag, target volatility and cash rate of two templates, every point re-run and measured."""
    out = research.sweep_metrics(t.segment_panel(spark, sf_dir), grid(spark))
    return r6(out.select("config_id", "n", "cagr", "vol", "cash_cagr", "sharpe_arithmetic", "max_drawdown", "mean_drawdown", "turnover", "sharpe"))


@query(f"""WITH {_BRAND_E}, {account_sql(_XS, "be", SPREAD)}, n AS (SELECT config_id, count(DISTINCT date) AS n_rebalances, count(CASE WHEN weight > 0 THEN 1 END) / count(DISTINCT date) AS mean_names FROM targets GROUP BY 1),
    p AS (SELECT config_id, count(CASE WHEN cash_weight > 1e-9 THEN 1 END) AS days_with_cash, sum(forced_exits)::BIGINT AS forced_exits FROM daily GROUP BY 1),
    st AS (SELECT count(*) AS stale_marks FROM vals v JOIN grid0 g ON g.asset = v.asset AND g.date = v.date WHERE g.value IS NULL AND (lost IS NULL OR v.date < lost)),
    el AS (SELECT avg(c) AS mean_eligible, count(*) AS asked FROM (SELECT r.date, count(b.series_id) AS c FROM reb r LEFT JOIN be b ON b.date = r.date AND b.eligible GROUP BY 1))
    SELECT n.config_id, n_rebalances, round(mean_names, 6) AS mean_names, days_with_cash, forced_exits, stale_marks, asked - n_rebalances AS skipped, round(mean_eligible, 6) AS mean_eligible FROM n JOIN p USING (config_id), st, el""")
def run_record(spark, sf_dir):
    """What a cross-sectional run did: trades, holdings, cash, exits, stale marks, and the rebalances that it skipped for want of names."""
    panel = signals.lagged_eligibility(t.brand_panel(spark, sf_dir, 2)).persist()
    scored = signals.momentum(panel, 13, 2, out="score").select("date", F.col("series_id").alias("asset"), "score", F.lit(None).cast("double").alias("vol"), "eligible")
    dates = _rebalances(panel, "top")
    asked = dates.select("*", F.lit(6).alias("n_hold"), F.lit(None).cast("double").alias("quantile"), F.lit(8).alias("min_names"), F.lit(False).alias("ascending"), F.lit("equal").alias("weighting"), F.lit(None).cast("double").alias("max_weight"))
    targets = portfolio.cross_sectional(asked, scored).persist()
    daily = portfolio.account(targets, portfolio.asset_returns(panel), t.cash(panel), _configs(spark, "top"))
    eligible = panel.where("eligible").select("date", F.col("series_id").alias("asset"))
    out = portfolio.run_metadata(daily, targets, dates, eligible)
    return r6(out.withColumns({c: F.col(c).cast("long") for c in ("n_rebalances", "days_with_cash", "forced_exits", "stale_marks", "skipped")}))


@query("""WITH c AS (SELECT c_custkey::VARCHAR AS card_id, c_nationkey % 2 = 0 AS allow_cash, CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey % 3 = 1 END AS m, c_nationkey % 4 AS refs FROM customer)
    SELECT card_id, 1 + coalesce((m <> allow_cash)::INT, 0) + 1 + refs AS n_configs, 1 + coalesce((m <> allow_cash)::INT, 0) AS own, 1 + refs AS rivals FROM c""")
def configs_run(spark, sf_dir):
    """How many configs each card (customer) runs as, with references of its own."""
    n = F.col("c_nationkey")
    reference = lambda i: F.struct(F.concat(F.lit("r"), i.cast("string")).alias("name"), F.lit("equal_weight").alias("template"))
    cards = t.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("card_id"), F.col("c_mktsegment").alias("template"), F.lit(30.0).alias("spread_bps"), (n % 2 == 0).alias("allow_cash"), F.when(n % 3 > 0, n % 3 == 1).alias("mandate_allow_cash"),
        F.array(F.struct(F.lit("flat").alias("name"), F.lit("equal_weight").alias("template"))).alias("benchmarks"),
        F.transform(F.when(n % 4 > 0, F.sequence(F.lit(1), (n % 4).cast("int"))).otherwise(F.array().cast("array<int>")), reference).alias("references"),
    )
    return portfolio.configs_run(portfolio.fan_out(cards))


_EW = "ewm AS (SELECT series_id, date, CASE WHEN k >= 13 THEN a / b * 21 END AS alpha FROM (SELECT series_id, date, sum(ret * pow(2::DOUBLE, n / 13::DOUBLE)) OVER w AS a, sum(CASE WHEN ret IS NOT NULL THEN pow(2::DOUBLE, n / 13::DOUBLE) END) OVER w AS b, count(ret) OVER w AS k FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS n FROM ret) WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING)))"
_MIX = f"m AS (SELECT date, CASE WHEN count(ret) = 5 THEN sum(0.2::DOUBLE * ret) END AS r FROM ret GROUP BY date), mv AS (SELECT date, CASE WHEN count(r) OVER w = 26 THEN stddev_samp(r) OVER w * {ROOT} END AS mix_vol FROM m WINDOW w AS (ORDER BY date ROWS 25 PRECEDING))"


@query(f"""WITH {t.segment_sql()}, {_RET.format("seg")}, {_EW}, {_MIX}, al AS (SELECT 'ewma' AS source, series_id, date, alpha FROM ewm UNION ALL SELECT 'momentum', series_id, date, lag(value, 2) OVER w / lag(value, 28) OVER w - 1 FROM seg WINDOW w AS (PARTITION BY series_id ORDER BY date) UNION ALL SELECT 'none', series_id, date, NULL FROM seg)
    SELECT source, series_id, date, round(alpha, 6) AS alpha, round(mix_vol, 6) AS mix_vol FROM al LEFT JOIN mv USING (date)""", days=("date",))
def signal_inputs(spark, sf_dir):
    """The inputs of an allocator under each source of expected returns, with the vol of the fixed mix."""
    panel = t.segment_panel(spark, sf_dir).persist()
    weights = panel.select("series_id", F.lit(0.2).alias("weight")).distinct()
    parts = [signals.signal_inputs(panel, weights, source, window=26, halflife=13, skip=2, scale=21.0)[0].select(F.lit(source).alias("source"), "series_id", "date", "alpha", "mix_vol") for source in ("ewma", "momentum", "none")]
    return r6(parts[0].unionByName(parts[1]).unionByName(parts[2]))
