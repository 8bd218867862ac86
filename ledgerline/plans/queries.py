"""The registered queries on the driver's tables, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import columns
from ledgerline.operators import checks, evidence, feasibility, metrics, portfolio, research, rules, signals
from ledgerline.operators import library as lib
from ledgerline.plans import tables as t
from ledgerline.sources import panels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ROOT = f"sqrt({columns.ANNUAL}::DOUBLE)"


def query(sql: str | None = None, days: tuple[str, ...] = ()):
    """Register a query; days come out as ISO text on both sides."""

    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c, k in df.dtypes if k == "date"})

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = f"SELECT * REPLACE ({', '.join(f'{d}::VARCHAR AS {d}' for d in days)}) FROM ({sql})" if days else sql
        return run

    return add


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Round the named (or all double) columns to six places."""
    names = names or tuple(c for c, k in df.dtypes if k == "double")
    return df.withColumns({c: F.round(c, 6) for c in names})


# -- panels -------------------------------------------------------------------------------


@query(f"WITH {t.segment_sql()} SELECT series_id, date, value FROM seg", days=("date",))
def panel_segments(spark, sf_dir):
    return t.segment_panel(spark, sf_dir)


@query(f"WITH {t.brand_sql()} SELECT series_id, date, value, member, n_lines FROM brand", days=("date",))
def panel_brands(spark, sf_dir):
    return t.brand_panel(spark, sf_dir)


@query(f"""WITH {t.brand_sql()}, days AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM brand)),
    b AS (SELECT series_id, min(date) AS first_date, max(date) AS last_date, count(*) AS n_obs, arg_min(value, date) AS first_value FROM brand GROUP BY 1),
    rr AS (SELECT *, value / lag(value) OVER (PARTITION BY series_id ORDER BY date) - 1 AS ret FROM brand),
    s AS (SELECT *, sum((ret = 0)::INT) OVER (PARTITION BY series_id ORDER BY date ROWS 4 PRECEDING) AS z5 FROM rr)
    SELECT b.series_id, first_date, last_date, n_obs, round(first_value, 6) AS first_value, h.pos - l.pos + 1 - n_obs AS gaps,
        sum((ret = 0)::INT)::BIGINT AS zero_returns, round(max(abs(ret)), 6) AS max_abs_return, sum((abs(ret) > 0.2)::INT)::BIGINT AS large_returns,
        sum(coalesce((z5 = 5)::INT, 0))::BIGINT AS stale_windows, sum((value <= 0)::INT)::BIGINT AS non_positive
    FROM b JOIN s USING (series_id) JOIN days l ON l.date = first_date JOIN days h ON h.date = last_date GROUP BY ALL""", days=("first_date", "last_date"))
def audit_brands(spark, sf_dir):
    return r6(checks.audit(t.brand_panel(spark, sf_dir)))


@query(f"""WITH {t.brand_sql()}, e AS (SELECT series_id, max(CASE WHEN value IS NOT NULL THEN date END) AS last, min(member::INT) AS always FROM brand GROUP BY 1), d AS (SELECT max(date) AS e, count(DISTINCT date) AS n FROM brand),
    c AS (SELECT count(*) AS n_securities, any_value(n) AS n_dates, count(CASE WHEN last = e THEN 1 END) AS alive_at_end, sum(always)::BIGINT AS never_left, count(*) - count(last) AS never_priced FROM e, d),
    r AS (SELECT *, alive_at_end / n_securities AS ratio FROM c)
    SELECT n_securities, n_dates, alive_at_end, never_left, never_priced, round(ratio, 6) AS survivor_ratio,
        concat_ws('; ', CASE WHEN ratio > 0.98 AND n_dates > 500 THEN 'nearly every security survives' END, CASE WHEN n_securities = 0 THEN 'no securities' END) AS blockers,
        concat_ws('; ', CASE WHEN ratio > 0.9 AND ratio <= 0.98 THEN 'many securities survive' END, CASE WHEN never_priced > 0 THEN 'securities without a price' END, 'no traded value', 'no free float') AS warnings FROM r""")
def diagnose_brands(spark, sf_dir):
    master = t.brand_panel(spark, sf_dir).select(F.col("series_id").alias("security_id"), "date", F.col("value").alias("price"), F.col("member").alias("in_universe"))
    return r6(checks.diagnose(master).withColumns({c: F.concat_ws("; ", c) for c in ("blockers", "warnings")}))


@query(f"""WITH {t.brand_sql()}, n AS (SELECT count(DISTINCT series_id) * count(DISTINCT date) AS c FROM brand)
    SELECT 'value' AS field, round(count(value) / any_value(c), 6) AS ratio FROM brand, n UNION ALL SELECT 'member', round(count(CASE WHEN member THEN 1 END) / any_value(c), 6) FROM brand, n""")
def fill_ratio_brands(spark, sf_dir):
    df = t.brand_panel(spark, sf_dir).withColumn("member", F.when(F.col("member"), 1))
    return r6(panels.fill_ratio(df, ["value", "member"]))


@query(f"""WITH {t.brand_sql()}, w AS (SELECT date FROM brand WHERE series_id IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY date HAVING count(DISTINCT series_id) = 3)
    SELECT series_id, date, value FROM brand WHERE date IN (SELECT date FROM w)""", days=("date",))
def complete_days(spark, sf_dir):
    return panels.require_complete(t.brand_panel(spark, sf_dir).select("series_id", "date", "value"), ["Brand#1", "Brand#2", "Brand#3"])


@query(f"""WITH {t.segment_sql()}, {t.EVENT_SQL}, u AS (SELECT * FROM seg UNION ALL SELECT * FROM ev)
    SELECT series_id, min(date) AS first_date, max(date) AS last_date, count(*) AS n, round(sum(value), 4) AS total FROM u GROUP BY 1""", days=("first_date", "last_date"))
def combined_sources(spark, sf_dir):
    both = panels.add_source(t.segment_panel(spark, sf_dir), t.event_panel(spark, sf_dir))
    return both.groupBy("series_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {t.brand_sql()}, r AS (SELECT * FROM brand WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31')
    SELECT series_id, date, value, member FROM r""", days=("date",))
def restricted_window(spark, sf_dir):
    return panels.restrict(t.brand_panel(spark, sf_dir).select("series_id", "date", "value", "member"), "1996-01-01", "1998-12-31")


@query(f"""WITH {t.segment_sql()}, h AS (SELECT series_id, date, sha256(series_id || '|' || date || '|' || round(value * 100)::BIGINT) AS d FROM seg),
    y AS (SELECT series_id, date_trunc('year', date) AS y, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS d FROM h GROUP BY ALL)
    SELECT series_id, sum(n)::BIGINT AS n, sha256(string_agg(d, '' ORDER BY d)) AS digest FROM y GROUP BY 1""")
def panel_digests(spark, sf_dir):
    """Values in hundredths, since the two engines write doubles differently."""
    whole = t.segment_panel(spark, sf_dir).withColumn("value", F.round(F.col("value") * 100).cast("long"))
    return panels.series_digests(whole)


# -- signals ------------------------------------------------------------------------------

_RET = "ret AS (SELECT *, value / lag(value) OVER (PARTITION BY series_id ORDER BY date) - 1 AS ret FROM {0})"


def _win(k: int, by: str = "series_id") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY date ROWS {k - 1} PRECEDING)"


@query(f"""WITH {t.segment_sql()}, {_RET.format("seg")}
    SELECT series_id, date, round(ret, 6) AS ret, CASE WHEN count(ret) {_win(26)} = 26 THEN round(stddev_samp(ret) {_win(26)} * {ROOT}, 6) END AS vol,
        CASE WHEN count(value) {_win(20)} = 20 THEN round((value - avg(value) {_win(20)}) / nullif(stddev_samp(value) {_win(20)}, 0), 6) END AS z,
        round(lag(value, 4) OVER (PARTITION BY series_id ORDER BY date) / lag(value, 30) OVER (PARTITION BY series_id ORDER BY date) - 1, 6) AS mom
    FROM ret""", days=("date",))
def signals_segments(spark, sf_dir):
    df = signals.trailing_vol(signals.simple_returns(t.segment_panel(spark, sf_dir)), 26)
    return r6(signals.momentum(signals.zscore(df, 20), 26, 4).drop("value"))


@query(f"""WITH {t.segment_sql()}, {_RET.format("seg")},
    v AS (SELECT *, CASE WHEN count(ret) {_win(8)} = 8 THEN stddev_samp(ret) {_win(8)} END AS s, CASE WHEN count(ret) {_win(40)} = 40 THEN stddev_samp(ret) {_win(40)} END AS l,
        value / lag(value, 26) OVER (PARTITION BY series_id ORDER BY date) - 1 AS mom FROM ret)
    SELECT series_id, date, round(ln(nullif(s, 0)) - ln(nullif(l, 0)), 6) AS vol_ratio, round(mom / nullif(s * {ROOT}, 0), 6) AS mom_vol FROM v""", days=("date",))
def signals_scaled(spark, sf_dir):
    df = signals.vol_scaled_momentum(t.segment_panel(spark, sf_dir), 26, 8)
    return r6(signals.vol_ratio(df, 8, 40).select("series_id", "date", "vol_ratio", "mom_vol"))


@query(f"""WITH {t.segment_sql()}, {_RET.format("seg")}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS n FROM ret),
    s AS (SELECT *, sum(ret * pow(2::DOUBLE, n / 13::DOUBLE)) OVER w AS a, sum(CASE WHEN ret IS NOT NULL THEN pow(2::DOUBLE, n / 13::DOUBLE) END) OVER w AS b, count(ret) OVER w AS k FROM n
        WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING))
    SELECT series_id, date, CASE WHEN k >= 13 THEN round(a / b, 6) END AS ewma FROM s""", days=("date",))
def signals_ewma(spark, sf_dir):
    return r6(signals.ewma_return(signals.simple_returns(t.segment_panel(spark, sf_dir)), 13).select("series_id", "date", "ewma"))


_COV = f"""{_RET.format("seg")}, whole AS (SELECT date, (count(ret) = (SELECT count(DISTINCT series_id) FROM ret))::INT AS whole FROM ret GROUP BY date),
    ok AS (SELECT date FROM (SELECT date, sum(whole) OVER (ORDER BY date ROWS 25 PRECEDING) AS k FROM whole) WHERE k = 26),
    pairs AS (SELECT a.date, a.series_id AS asset_i, b.series_id AS asset_j, covar_samp(a.ret, b.ret) OVER (PARTITION BY a.series_id, b.series_id ORDER BY a.date ROWS 25 PRECEDING) * 252 AS cov
        FROM ret a JOIN ret b ON a.date = b.date AND a.series_id <= b.series_id),
    cov AS (SELECT * FROM pairs WHERE date IN (SELECT date FROM ok))"""


@query(f"WITH {t.segment_sql()}, {_COV} SELECT date, asset_i, asset_j, round(cov, 6) AS cov FROM cov", days=("date",))
def rolling_covariance(spark, sf_dir):
    return r6(signals.rolling_cov(signals.simple_returns(t.segment_panel(spark, sf_dir)), 26))


@query(f"""WITH {t.brand_sql()} SELECT series_id, date, round((rank() OVER (PARTITION BY date ORDER BY value) + (count(*) OVER (PARTITION BY date, value) - 1) / 2) / count(*) OVER (PARTITION BY date), 6) AS rank FROM brand""", days=("date",))
def ranks_brands(spark, sf_dir):
    return r6(signals.cross_sectional_rank(t.brand_panel(spark, sf_dir), "value").select("series_id", "date", "rank"))


@query(f"""WITH {t.brand_sql()}, d AS (SELECT DISTINCT date FROM brand), u(frequency) AS (VALUES ('month'), ('quarter'), ('year'))
    SELECT frequency || 'ly' AS frequency, max(date) AS date FROM d, u GROUP BY frequency, date_trunc(frequency, date)""", days=("date",))
def rebalance_calendar(spark, sf_dir):
    days = t.brand_panel(spark, sf_dir).select("date").distinct()
    parts = [signals.rebalance_dates(days, f).select(F.lit(f).alias("frequency"), "date") for f in ("monthly", "quarterly", "yearly")]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""WITH {t.segment_sql()}, {_RET.format("seg")}, m AS (SELECT date, CASE WHEN count(ret) = (SELECT count(DISTINCT series_id) FROM seg) THEN avg(ret) END AS ret FROM ret GROUP BY date)
    SELECT date, round(ret, 6) AS ret, CASE WHEN count(ret) OVER (ORDER BY date ROWS 25 PRECEDING) = 26 THEN round(stddev_samp(ret) OVER (ORDER BY date ROWS 25 PRECEDING) * {ROOT}, 6) END AS vol FROM m""", days=("date",))
def mix_volatility(spark, sf_dir):
    panel = t.segment_panel(spark, sf_dir)
    weights = panel.select("series_id").distinct().crossJoin(F.broadcast(panel.agg(F.countDistinct("series_id").alias("n")))).select("series_id", (1 / F.col("n")).alias("weight"))  # one row
    return r6(signals.portfolio_trailing_vol(signals.simple_returns(panel), weights, 26))


@query(f"""WITH {t.brand_sql()} SELECT series_id, date, lag(value, 2) OVER w AS value, coalesce(lag(member, 2) OVER w, false) AS eligible FROM brand WINDOW w AS (PARTITION BY series_id ORDER BY date)""", days=("date",))
def causal_eligibility(spark, sf_dir):
    known = signals.lagged_eligibility(t.brand_panel(spark, sf_dir))
    return signals.causal_shift(known, ["value"]).select("series_id", "date", "value", "eligible")


@query(f"""WITH {t.segment_sql()}, {_RET.format("seg")}, s AS (SELECT *, avg(ret) {_win(4)} AS s, lead(ret) OVER (PARTITION BY series_id ORDER BY date) AS r1 FROM ret),
    b AS (SELECT series_id, 0 AS h, s, ret AS r FROM s UNION ALL SELECT series_id, 1, s, r1 FROM s)
    SELECT series_id, h, count(*) AS n, round(corr(s, r), 6) AS corr, abs(corr(s, r)) > 0.35 AS breach FROM b WHERE s IS NOT NULL AND r IS NOT NULL GROUP BY ALL HAVING count(*) >= 60""")
def lookahead_tripwire(spark, sf_dir):
    df = signals.simple_returns(t.segment_panel(spark, sf_dir))
    leaky = df.withColumn("s", F.avg("ret").over(columns.trailing(4, "series_id")))
    return r6(signals.tripwire(leaky, "s"))


# -- accounting ---------------------------------------------------------------------------


def account_sql(targets: str, panel: str, spread_bps: float | str, cash: str = "cash c ON c.date = s.date") -> str:
    """CTEs that end in ``daily``: the closed form of the accounting, over ``targets`` and a panel.

    ``spread_bps`` is a number, or SQL over g.config_id; ``cash`` is the join of rates c to days s.
    """
    half = f"{spread_bps / 1e4 / 2}::DOUBLE" if isinstance(spread_bps, float) else f"(({spread_bps}) / 10000.0::DOUBLE / 2)"
    return f"""{targets},
    grid0 AS (SELECT a.series_id AS asset, d.date, b.value, b.eligible FROM (SELECT DISTINCT series_id FROM {panel}) a CROSS JOIN (SELECT DISTINCT date FROM {panel}) d LEFT JOIN {panel} b ON b.series_id = a.series_id AND b.date = d.date),
    rets AS (SELECT asset, date, coalesce(value / lag(value) OVER (PARTITION BY asset ORDER BY date) - 1, 0) AS ret, coalesce(eligible, false) AS eligible FROM grid0),
    rebs AS (SELECT DISTINCT config_id, date FROM targets),
    grid AS (SELECT c.config_id, d.date, r.date IS NOT NULL AS reb FROM (SELECT DISTINCT config_id FROM targets) c CROSS JOIN (SELECT DISTINCT date FROM rets) d LEFT JOIN rebs r ON r.config_id = c.config_id AND r.date = d.date),
    sg AS (SELECT *, max(CASE WHEN reb THEN date END) OVER (PARTITION BY config_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sg FROM grid),
    held AS (SELECT s.*, x.asset, x.weight, r.ret, r.eligible, c.rf FROM sg s JOIN targets x ON x.config_id = s.config_id AND x.date = s.sg AND x.weight <> 0 JOIN rets r ON r.asset = x.asset AND r.date = s.date JOIN {cash}),
    lost AS (SELECT *, min(CASE WHEN NOT eligible THEN date END) OVER (PARTITION BY config_id, sg, asset) AS lost FROM held),
    vals AS (SELECT *, weight * product(CASE WHEN lost IS NULL OR date <= lost THEN 1 + ret ELSE 1 + rf END) OVER (PARTITION BY config_id, sg, asset ORDER BY date) AS v FROM lost),
    idle AS (SELECT s.config_id, s.date, f.c0 * product(1 + rf) OVER (PARTITION BY s.config_id, s.sg ORDER BY s.date) AS c FROM sg s JOIN (SELECT config_id, date, 1 - sum(weight) AS c0 FROM targets GROUP BY ALL) f ON f.config_id = s.config_id AND f.date = s.sg JOIN {cash}),
    tot AS (SELECT i.config_id, i.date, any_value(i.c) + coalesce(sum(v.v), 0) AS s FROM idle i LEFT JOIN vals v ON v.config_id = i.config_id AND v.date = i.date GROUP BY ALL),
    sold AS (SELECT v.config_id, v.date, sum(CASE WHEN v.date = lost THEN v / s ELSE 0 END) AS sold, sum(CASE WHEN v.date = lost THEN 1 ELSE 0 END) AS exits FROM vals v JOIN tot USING (config_id, date) GROUP BY ALL),
    old AS (SELECT v.config_id, v.date, asset, v / s AS old FROM vals v JOIN tot USING (config_id, date) WHERE reb AND (lost IS NULL OR v.date < lost)),
    trd AS (SELECT config_id, date, sum(abs(coalesce(weight, 0) - coalesce(old, 0))) AS traded FROM (SELECT config_id, date, asset, weight FROM targets) n FULL JOIN old USING (config_id, date, asset) GROUP BY ALL),
    steps AS (SELECT g.config_id, g.date, g.sg, tot.s, lag(g.reb) OVER w AS after_reb, lag(tot.s) OVER w AS s0, {half} * coalesce(sold, 0) AS c1, {half} * coalesce(traded, 0) AS c2,
        (coalesce(traded, 0) + coalesce(sold, 0)) / 2 AS turnover, coalesce(exits, 0)::BIGINT AS forced_exits,
        CASE WHEN g.reb THEN 1 - coalesce(f.gross, 0) WHEN g.sg IS NULL THEN 1 ELSE 1 - coalesce(lv.live, 0) / tot.s END AS cash_weight
        FROM sg g LEFT JOIN tot USING (config_id, date) LEFT JOIN sold USING (config_id, date) LEFT JOIN trd USING (config_id, date) LEFT JOIN (SELECT config_id, date, sum(weight) AS gross FROM targets GROUP BY ALL) f USING (config_id, date)
            LEFT JOIN (SELECT config_id, date, sum(v) AS live FROM vals WHERE lost IS NULL OR date < lost GROUP BY ALL) lv USING (config_id, date) WINDOW w AS (PARTITION BY g.config_id ORDER BY g.date)),
    grown AS (SELECT *, CASE WHEN sg IS NULL THEN 1 ELSE s / CASE WHEN after_reb THEN 1 ELSE coalesce(s0, 1) END END * (1 - c1) * (1 - c2) AS g FROM steps),
    daily AS (SELECT config_id, date, product(g) OVER (PARTITION BY config_id ORDER BY date) AS nav, g - 1 AS ret, turnover, c1 + c2 AS cost, forced_exits, cash_weight FROM grown)"""


SPREAD = 30.0
_SEG_E = "sege AS (SELECT *, true AS eligible FROM seg)"
_EQUAL = """reb AS (SELECT max(date) AS date FROM seg GROUP BY date_trunc('month', date)),
    targets AS (SELECT 'equal' AS config_id, s.date, series_id AS asset, 1.0::DOUBLE / count(*) OVER (PARTITION BY s.date) AS weight FROM seg s JOIN reb USING (date))"""
_EQUAL_SQL = f"WITH {t.segment_sql()}, {t.CASH_SQL}, {_SEG_E}, {account_sql(_EQUAL, 'sege', SPREAD)}"


def _configs(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n, SPREAD) for n in names], "config_id string, spread_bps double")


def _rebalances(panel: DataFrame, config: str, frequency: str = "monthly") -> DataFrame:
    return signals.rebalance_dates(panel.select("date").distinct(), frequency).select(F.lit(config).alias("config_id"), "date")


def _equal_run(spark: SparkSession, sf_dir: str, unit: str = "week") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(panel, targets, daily) of the equal-weight portfolio of segments, rebalanced monthly."""
    panel = t.segment_panel(spark, sf_dir, unit).persist()
    targets = portfolio.equal_weight(_rebalances(panel, "equal"), panel.select("date", F.col("series_id").alias("asset")))
    cash = t.cash(panel)
    return panel, targets, portfolio.account(targets, portfolio.asset_returns(panel), cash, _configs(spark, "equal")).join(cash, "date").persist()


@query(f"{_EQUAL_SQL} SELECT config_id, date, round(ln(nav), 6) AS log_nav, round(ret, 6) AS ret, round(turnover, 6) AS turnover, round(cost, 8) AS cost, round(cash_weight, 6) AS cash_weight FROM daily", days=("date",))
def run_equal_weight(spark, sf_dir):
    daily = _equal_run(spark, sf_dir)[2]
    return daily.select("config_id", "date", F.round(F.ln("nav"), 6).alias("log_nav"), *[F.round(c, 6).alias(c) for c in ("ret", "turnover", "cash_weight")], F.round("cost", 8).alias("cost"))


_BRAND_E = f"""{t.brand_sql(2)}, be AS (SELECT series_id, date, value, coalesce(lag(member, 2) OVER (PARTITION BY series_id ORDER BY date), false) AS eligible,
    lag(value, 2) OVER (PARTITION BY series_id ORDER BY date) / lag(value, 15) OVER (PARTITION BY series_id ORDER BY date) - 1 AS score FROM brand), {t.CASH_SQL.replace("FROM seg", "FROM brand")}"""
_XS = """reb AS (SELECT max(date) AS date FROM brand GROUP BY date_trunc('month', date)),
    pool AS (SELECT date, series_id AS asset, row_number() OVER (PARTITION BY date ORDER BY -score, series_id) AS k, count(*) OVER (PARTITION BY date) AS n FROM be JOIN reb USING (date) WHERE eligible AND score IS NOT NULL),
    targets AS (SELECT 'top' AS config_id, date, asset, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM pool WHERE k <= 6 AND n >= 8)"""


@query(f"WITH {_BRAND_E}, {account_sql(_XS, 'be', SPREAD)} SELECT config_id, date, round(nav, 6) AS nav, round(turnover, 6) AS turnover, forced_exits FROM daily", days=("date",))
def run_cross_sectional(spark, sf_dir):
    panel = signals.lagged_eligibility(t.brand_panel(spark, sf_dir, 2)).persist()
    scored = signals.momentum(panel, 13, 2, out="score").select("date", F.col("series_id").alias("asset"), "score", F.lit(None).cast("double").alias("vol"), "eligible")
    dates = _rebalances(panel, "top").select(
        "*", F.lit(6).alias("n_hold"), F.lit(None).cast("double").alias("quantile"), F.lit(8).alias("min_names"), F.lit(False).alias("ascending"), F.lit("equal").alias("weighting"), F.lit(None).cast("double").alias("max_weight")
    )
    targets = portfolio.cross_sectional(dates, scored)
    daily = portfolio.account(targets, portfolio.asset_returns(panel), t.cash(panel), _configs(spark, "top"))
    return r6(daily.select("config_id", "date", "nav", "turnover", F.col("forced_exits").cast("long").alias("forced_exits")))


_SIG = f"""{_RET.format("seg")}, sig0 AS (SELECT series_id, date, CASE WHEN count(ret) {_win(26)} = 26 THEN stddev_samp(ret) {_win(26)} * {ROOT} END AS vol, value / lag(value, 26) OVER (PARTITION BY series_id ORDER BY date) - 1 AS mom FROM ret),
    sig AS (SELECT series_id AS asset, date, lag(vol, 2) OVER (PARTITION BY series_id ORDER BY date) AS vol, lag(mom, 2) OVER (PARTITION BY series_id ORDER BY date) AS mom FROM sig0)"""
_MANY = f"""reb AS (SELECT max(date) AS date FROM seg GROUP BY date_trunc('month', date)), {_SIG},
    fine AS (SELECT s.*, min((vol IS NOT NULL AND vol > 0 AND mom IS NOT NULL)::INT) OVER (PARTITION BY date) AS ok, min((vol IS NOT NULL AND vol > 0)::INT) OVER (PARTITION BY date) AS okv FROM sig s JOIN reb USING (date)),
    targets AS (SELECT 'inverse_vol' AS config_id, date, asset, (1 / vol) / sum(1 / vol) OVER (PARTITION BY date) AS weight FROM fine WHERE okv = 1
        UNION ALL SELECT 'ts_momentum', date, asset, coalesce(CASE WHEN mom > 0 THEN 1 / vol ELSE 0 END / nullif(sum(CASE WHEN mom > 0 THEN 1 / vol ELSE 0 END) OVER (PARTITION BY date), 0), 0) FROM fine WHERE ok = 1)"""


def _signal_targets(panel: DataFrame) -> DataFrame:
    made = signals.momentum(signals.trailing_vol(signals.simple_returns(panel), 26), 26)
    known = signals.causal_shift(made, ["vol", "mom"]).select("date", F.col("series_id").alias("asset"), "vol", "mom")
    return portfolio.inverse_vol(_rebalances(panel, "inverse_vol"), known).unionByName(portfolio.ts_momentum(_rebalances(panel, "ts_momentum"), known))


@query(f"WITH {t.segment_sql()}, {t.CASH_SQL}, {_SEG_E}, {account_sql(_MANY, 'sege', SPREAD)} SELECT config_id, date, round(nav, 6) AS nav, round(turnover, 6) AS turnover FROM daily", days=("date",))
def run_signal_templates(spark, sf_dir):
    panel = t.segment_panel(spark, sf_dir)
    daily = portfolio.account(_signal_targets(panel), portfolio.asset_returns(panel), t.cash(panel), _configs(spark, "inverse_vol", "ts_momentum"))
    return r6(daily.select("config_id", "date", "nav", "turnover"))


@query()
def run_solved_weights(spark, sf_dir):
    """Least variance and equal risk targets at rebalances (checked by their optimality conditions in the tests)."""
    panel = t.segment_panel(spark, sf_dir)
    dates = _rebalances(panel, "solved")
    tiles = signals.covariance_tiles(signals.simple_returns(panel), 26, dates=dates)
    solved = [portfolio.solved_weights(tiles.withColumn("config_id", F.lit(m)), m) for m in ("min_variance", "equal_risk")]
    both = solved[0].unionByName(solved[1])
    return r6(portfolio.position_policy(both))


@query(f"""WITH {t.segment_sql()}, {_COV}, reb AS (SELECT max(date) AS date FROM seg GROUP BY date_trunc('month', date)),
    w AS (SELECT date, series_id AS asset, 0.2::DOUBLE AS w FROM seg JOIN reb USING (date)), sym AS (SELECT * FROM cov UNION ALL SELECT date, asset_j, asset_i, cov FROM cov WHERE asset_i <> asset_j),
    v AS (SELECT a.date, sqrt(sum(a.w * b.w * c.cov)) AS vol FROM w a JOIN sym c ON c.date = a.date AND c.asset_i = a.asset JOIN w b ON b.date = a.date AND b.asset = c.asset_j GROUP BY a.date)
    SELECT 'vol_target' AS config_id, w.date, asset, round(w * least(1, 0.1::DOUBLE / vol), 6) AS weight FROM w JOIN v ON v.date = w.date""", days=("date",))
def run_vol_target(spark, sf_dir):
    panel = t.segment_panel(spark, sf_dir)
    targets = portfolio.fixed_weight(_rebalances(panel, "vol_target"), panel.select(F.lit("vol_target").alias("config_id"), F.col("series_id").alias("asset"), F.lit(0.2).alias("weight")).distinct())
    targets = targets.join(panel.select("date", F.col("series_id").alias("asset")), ["date", "asset"], "left_semi").select("config_id", "date", "asset", "weight")
    vol = portfolio.target_variance(targets, signals.rolling_cov(signals.simple_returns(panel), 26))
    return r6(portfolio.scale_to_vol(targets, vol, 0.1))


@query()
def two_formulations(spark, sf_dir):
    """Accounting by growth against accounting by units: they have to agree to 1e-9."""
    panel = t.segment_panel(spark, sf_dir, "month").persist()
    names = [r[0] for r in panel.select("series_id").distinct().collect()]  # the few market segments
    panel = panels.require_complete(panel, names).persist()
    targets = portfolio.equal_weight(_rebalances(panel, "equal", "quarterly"), panel.select("date", F.col("series_id").alias("asset")))
    daily = portfolio.account(targets, portfolio.asset_returns(panel), t.cash(panel), _configs(spark, "equal"))
    return checks.reconcile(daily, portfolio.units_nav(targets, panel, t.cash(panel), _configs(spark, "equal")), ["config_id", "date"], ["nav"])


# -- metrics ------------------------------------------------------------------------------

_RF = "d AS (SELECT daily.*, rf FROM daily JOIN cash USING (date))"
_METRICS = f"""{_RF}, dd AS (SELECT *, nav / max(nav) OVER (ORDER BY date) - 1 AS dd, lead(date) OVER (ORDER BY date) AS nx FROM d),
    sp AS (SELECT *, sum((dd >= -1e-12)::INT) OVER (ORDER BY date) AS k FROM dd),
    uw AS (SELECT coalesce(max(stop - start), 0)::INT AS longest_underwater FROM (SELECT min(date) AS start, arg_max(coalesce(nx, date), date) AS stop FROM sp WHERE dd < -1e-12 GROUP BY k)),
    h AS (SELECT CASE WHEN count(ret) OVER w = 21 THEN product(1 + ret) OVER w - 1 END AS h FROM d WINDOW w AS (ORDER BY date ROWS 20 PRECEDING)),
    cv AS (SELECT -avg(h) AS cvar FROM h WHERE h <= (SELECT quantile_cont(h, 0.05) FROM h)),
    yv AS (SELECT max(v) - min(v) AS vol_spread FROM (SELECT stddev_samp(ret) * {ROOT} AS v FROM d GROUP BY year(date))),
    mh AS (SELECT sum((r > 0)::INT) / (date_diff('month', min(m), max(m)) + 1) AS hit_rate FROM (SELECT date_trunc('month', date) AS m, product(1 + ret) - 1 AS r FROM d GROUP BY 1)),
    core AS (SELECT config_id, min(date) AS "start", max(date) AS "end", count(*) AS n, pow(arg_max(nav, date) / arg_min(nav, date), 365.25::DOUBLE / (max(date) - min(date))) - 1 AS cagr, stddev_samp(ret) * {ROOT} AS vol,
        pow(product(1 + rf), 365.25::DOUBLE / (max(date) - min(date))) - 1 AS cash_cagr, avg(ret - rf) / stddev_samp(ret - rf) * {ROOT} AS sharpe_arithmetic, -min(dd) AS max_drawdown, -avg(dd) AS mean_drawdown, avg(turnover) * 252 AS turnover
        FROM dd GROUP BY config_id)"""


@query(f"""{_EQUAL_SQL}, {_METRICS}
    SELECT config_id, "start", "end", n, round(cagr, 6) AS cagr, round(vol, 6) AS vol, round(cash_cagr, 6) AS cash_cagr, round(sharpe_arithmetic, 6) AS sharpe_arithmetic, round(max_drawdown, 6) AS max_drawdown,
        round(mean_drawdown, 6) AS mean_drawdown, round(turnover, 6) AS turnover, round((cagr - cash_cagr) / vol, 6) AS sharpe, longest_underwater, round(cvar, 6) AS cvar, round(vol_spread, 6) AS vol_spread, round(hit_rate, 6) AS hit_rate
    FROM core, uw, cv, yv, mh""", days=('"start"', '"end"'))
def metrics_equal_weight(spark, sf_dir):
    return r6(metrics.metrics_table(_equal_run(spark, sf_dir)[2]))


_BOOK = f"""{_RET.format("seg")}, {_RF}"""


def _segment_returns(panel: DataFrame) -> DataFrame:
    return signals.simple_returns(panel).where("ret is not null").select("series_id", "date", "ret")


@query(f"""{_EQUAL_SQL}, {_BOOK}, j AS (SELECT series_id, d.ret, r.ret AS bench, rf FROM d JOIN ret r USING (date) WHERE r.ret IS NOT NULL),
    x AS (SELECT series_id, count(*) AS n, count(*) >= 100 AS ok, covar_samp(ret - rf, bench - rf) / var_samp(bench - rf) AS beta, avg(ret - rf) - covar_samp(ret - rf, bench - rf) / var_samp(bench - rf) * avg(bench - rf) AS a,
        stddev_samp(ret - bench) * {ROOT} AS te, avg(ret - bench) / stddev_samp(ret - bench) * {ROOT} AS ir, avg(ret - bench) * 252 AS ar, corr(ret, bench) AS corr,
        CASE WHEN count(CASE WHEN bench > 0 THEN 1 END) > 20 THEN avg(CASE WHEN bench > 0 THEN ret END) / avg(CASE WHEN bench > 0 THEN bench END) END AS up,
        CASE WHEN count(CASE WHEN bench < 0 THEN 1 END) > 20 THEN avg(CASE WHEN bench < 0 THEN ret END) / avg(CASE WHEN bench < 0 THEN bench END) END AS down FROM j GROUP BY series_id)
    SELECT series_id, n, CASE WHEN ok THEN round(beta, 6) END AS beta, CASE WHEN ok THEN round(a, 6) END AS alpha_row, CASE WHEN ok THEN round(252 * ln(1 + a), 6) END AS log_alpha, CASE WHEN ok THEN round(te, 6) END AS tracking_error,
        CASE WHEN ok THEN round(ir, 6) END AS information_ratio, CASE WHEN ok THEN round(ar, 6) END AS active_return, CASE WHEN ok THEN round(corr, 6) END AS corr, CASE WHEN ok THEN round(up, 6) END AS up_capture, CASE WHEN ok THEN round(down, 6) END AS down_capture FROM x""")
def relative_to_segments(spark, sf_dir):
    """The yearly alpha as its logarithm: weekly means of these tables, compounded 252 times, have forty digits."""
    panel, _, daily = _equal_run(spark, sf_dir)
    pairs = daily.select("date", "ret", "rf").join(_segment_returns(panel).withColumnRenamed("ret", "bench"), "date")
    return r6(metrics.relative(pairs, "series_id").withColumn("log_alpha", columns.ANNUAL * F.log1p("alpha_row")).drop("alpha"))


@query(f"""{_EQUAL_SQL}, {_BOOK}, j AS (SELECT series_id, d.ret AS a, r.ret AS b FROM d JOIN ret r USING (date) WHERE r.ret IS NOT NULL)
    SELECT series_id, count(*) AS n, round(corr(a, b), 6) AS corr, round(covar_samp(a, b) / var_samp(b), 6) AS beta,
        round(sqrt(greatest(var_samp(a) - covar_samp(a, b) * covar_samp(a, b) / var_samp(b), 0)) / stddev_samp(a), 5) AS residual_vol FROM j GROUP BY series_id HAVING count(*) >= 100""")
def similarity_to_segments(spark, sf_dir):
    panel, _, daily = _equal_run(spark, sf_dir)
    return r6(metrics.similarity(daily, _segment_returns(panel)).withColumn("residual_vol", F.round("residual_vol", 5)))


@query(f"""{_EQUAL_SQL}, {_BOOK}, b AS (SELECT date, avg(ret) AS b FROM ret WHERE ret IS NOT NULL GROUP BY date), j AS (SELECT s AS sleeve, s * d.ret + (1 - s) * b AS m, b, rf FROM d JOIN b USING (date), (VALUES (0.0::DOUBLE), (0.1), (0.2)) v(s)),
    g AS (SELECT sleeve, count(*) AS n, avg(m - rf) / stddev_samp(m - rf) * {ROOT} AS ir, stddev_samp(m - b) * {ROOT} AS te, pow(product(1 + m), 252::DOUBLE / count(*)) - 1 AS cagr FROM j GROUP BY sleeve)
    SELECT sleeve, n, round(ir, 6) AS ir, round(te, 6) AS tracking_error, round(ln(1 + cagr), 6) AS log_cagr, round(ir - (SELECT ir FROM g WHERE sleeve = 0), 6) AS delta_ir FROM g WHERE n >= 200""")
def incremental_sleeves(spark, sf_dir):
    panel, _, daily = _equal_run(spark, sf_dir)
    book = _segment_returns(panel).groupBy("date").agg(F.avg("ret").alias("ret")).join(t.cash(panel), "date")
    return r6(metrics.incremental(daily, book, [0.1, 0.2]).withColumn("log_cagr", F.log1p("cagr")).drop("cagr"))


@query(f"""{_EQUAL_SQL}, {_RF}, e AS (SELECT min(date) AS a, max(date) AS b FROM d), k(i) AS (VALUES (0), (1), (2), (3)),
    w AS (SELECT 'block_' || (i + 1) AS label, a + ((b - a) * i // 4)::INT + (i > 0)::INT AS lo, a + ((b - a) * (i + 1) // 4)::INT AS hi FROM e, k UNION ALL SELECT 'full', a, b FROM e),
    p AS (SELECT d.*, label, nav / max(nav) OVER (PARTITION BY label ORDER BY date) - 1 AS dd FROM d JOIN w ON date BETWEEN lo AND hi),
    g AS (SELECT config_id, label, count(*) AS n, pow(arg_max(nav, date) / arg_min(nav, date), 365.25::DOUBLE / (max(date) - min(date))) - 1 AS cagr, stddev_samp(ret) * {ROOT} AS vol, pow(product(1 + rf), 365.25::DOUBLE / (max(date) - min(date))) - 1 AS cash, -min(dd) AS mdd FROM p GROUP BY ALL)
    SELECT config_id, label, n, CASE WHEN n >= 60 THEN round(cagr, 6) END AS cagr, CASE WHEN n >= 60 THEN round(vol, 6) END AS vol, CASE WHEN n >= 60 THEN round(mdd, 6) END AS max_drawdown, CASE WHEN n >= 60 THEN round((cagr - cash) / vol, 6) END AS sharpe FROM g""")
def sub_periods(spark, sf_dir):
    daily = _equal_run(spark, sf_dir)[2]
    return r6(research.in_windows(daily, research.equal_blocks(daily)))


_DAY_EQUAL_SQL = f"WITH {t.segment_sql('day')}, {t.CASH_SQL}, {_SEG_E}, {account_sql(_EQUAL, 'sege', SPREAD)}"
_FOLDS = f"""{_DAY_EQUAL_SQL}, {_RF}, e AS (SELECT (min(date) + INTERVAL 60 MONTH)::DATE AS a, max(date) AS b FROM d), k(i) AS (VALUES (0), (1), (2), (3)),
    w AS (SELECT 'fold_' || (i + 1) AS label, a + ((b - a) * i // 4)::INT + (i > 0)::INT AS lo, a + ((b - a) * (i + 1) // 4)::INT AS hi FROM e, k WHERE a < b),
    p AS (SELECT d.*, label, nav / max(nav) OVER (PARTITION BY label ORDER BY date) - 1 AS dd FROM d JOIN w ON date BETWEEN lo AND hi),
    g AS (SELECT config_id, label, count(*) AS n, pow(arg_max(nav, date) / arg_min(nav, date), 365.25::DOUBLE / (max(date) - min(date))) - 1 AS cagr, stddev_samp(ret) * {ROOT} AS vol, pow(product(1 + rf), 365.25::DOUBLE / (max(date) - min(date))) - 1 AS cash, -min(dd) AS mdd FROM p GROUP BY ALL),
    f AS (SELECT config_id, label, n, CASE WHEN n >= 60 THEN ln(1 + cagr) END AS log_cagr, CASE WHEN n >= 60 THEN vol END AS vol, CASE WHEN n >= 60 THEN mdd END AS max_drawdown, CASE WHEN n >= 60 THEN (cagr - cash) / vol END AS sharpe FROM g)"""


@query(f"{_FOLDS} SELECT config_id, label, n, round(log_cagr, 6) AS log_cagr, round(vol, 6) AS vol, round(max_drawdown, 6) AS max_drawdown, round(sign(sharpe) * ln(1 + abs(sharpe)), 6) AS log_sharpe FROM f")
def walk_forward_folds(spark, sf_dir):
    """Four folds behind five years of training, on the daily panel; large values as logarithms."""
    daily = _equal_run(spark, sf_dir, "day")[2]
    table = research.in_windows(daily, research.walk_forward(daily))
    return r6(table.withColumns({"log_cagr": F.log1p("cagr"), "log_sharpe": F.signum("sharpe") * F.log1p(F.abs("sharpe"))}).drop("cagr", "sharpe"))


@query(f"""{_FOLDS}, s AS (SELECT config_id, count(sharpe) AS folds, min(sharpe) AS lo, avg(sharpe) AS mean FROM f GROUP BY 1)
    SELECT config_id, folds, round(sign(lo) * ln(1 + abs(lo)), 6) AS log_min_sharpe, round(sign(mean) * ln(1 + abs(mean)), 6) AS log_mean_sharpe FROM s""")
def out_of_sample_sharpe(spark, sf_dir):
    out = research.out_of_sample(_equal_run(spark, sf_dir, "day")[2])
    log = lambda c: F.signum(c) * F.log1p(F.abs(c))
    return r6(out.select("config_id", "folds", log("min_sharpe").alias("log_min_sharpe"), log("mean_sharpe").alias("log_mean_sharpe")))


def _quantile_sql(p: str) -> str:
    """AS 241 for p above 0.925, where a trial count puts it, and below exp(-25) of the tail; lowest power first."""
    top = "1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640"
    low = "1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 0.00000000105075007164441684324"
    power = lambda c: f"list_sum(list_transform([{c}]::DOUBLE[], lambda v, i: v * pow(sqrt(-ln(1 - {p})) - 1.6, i - 1)))"
    return f"({power(top)} / {power(low)})"


#: The normal distribution by its series, phi(z) (z + z^3 / 3 + z^5 / 15 + ...) + 1/2; beyond 7 it is 0 or 1 to all digits shown.
_CDF = """ser AS (SELECT z.*, CASE WHEN abs(z) > 7 THEN (z > 0)::INT::DOUBLE ELSE 0.5::DOUBLE + exp(-z * z / 2) / sqrt(2 * pi()) *
    list_sum(list_transform(range(0, 150), lambda k: sign(z) * exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - list_sum(list_transform(range(0, k + 1), lambda j: ln(2 * j + 1.0::DOUBLE)))))) END AS dsr FROM z)"""


@query(f"""{_EQUAL_SQL}, {_RF}, m AS (SELECT count(*)::DOUBLE AS n, avg(ret - rf) / stddev_samp(ret - rf) AS sr, skewness(ret - rf) AS skew, kurtosis(ret - rf) + 3 AS kurt FROM d),
    tr AS (SELECT (SELECT count(DISTINCT p_brand) FROM part)::DOUBLE * 4 AS k), x AS (SELECT k, 1 - 1 / k AS p, 1 - 1 / (k * exp(1::DOUBLE)) AS q FROM tr),
    y AS (SELECT m.*, k, ((1 - 0.5772156649015329::DOUBLE) * {_quantile_sql("p")} + 0.5772156649015329::DOUBLE * {_quantile_sql("q")}) * 0.5 / {ROOT} AS sr0 FROM m, x),
    z AS (SELECT *, (sr - sr0) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr)) AS z FROM y), {_CDF}
    SELECT 'equal' AS config_id, n::BIGINT AS n, k::BIGINT AS n_trials, round(sr, 6) AS sr, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(sr0, 6) AS sr0, round(z, 6) AS z, round(dsr, 6) AS dsr, dsr >= 0.95 AS passes FROM ser WHERE n >= 100""")
def deflated_sharpe(spark, sf_dir):
    trials = t.table(spark, sf_dir, "part").agg((F.countDistinct("p_brand") * 4).alias("n_trials")).select(F.lit("equal").alias("config_id"), "n_trials")
    return r6(research.deflated_sharpe(_equal_run(spark, sf_dir)[2], trials))


@query()
def bootstrap_intervals(spark, sf_dir):
    """Confidence intervals and paired differences from keyed draws (tested against numpy; SQL has other generators)."""
    panel, _, daily = _equal_run(spark, sf_dir)
    others = signals.simple_returns(panel).where("ret is not null").select(F.col("series_id").alias("config_id"), "date", "ret").join(t.cash(panel), "date")
    runs = daily.select("config_id", "date", "ret", "rf").unionByName(others)
    intervals, differences = research.bootstrap(runs, "equal", least=min(250, runs.select("date").distinct().count()))
    return intervals.join(differences, "config_id", "left")


@query()
def factor_fingerprint(spark, sf_dir):
    """Loadings of the portfolio and of every segment on the segments, with robust t-values (tested against numpy)."""
    panel, _, daily = _equal_run(spark, sf_dir)
    segments = _segment_returns(panel)
    runs = daily.select("config_id", "date", "ret", "rf").unionByName(segments.select(F.col("series_id").alias("config_id"), "date", "ret").join(t.cash(panel), "date"))
    fits = research.factor_regressions(runs, segments)
    return fits.select("config_id", "n", "lags", "alpha_t", "r2", F.explode("loadings").alias("factor", "loading"), "t").select("config_id", "n", "lags", "alpha_t", "r2", "factor", "loading", F.col("t")[F.col("factor")].alias("t"))


def _swept(*ids: str) -> str:
    """The equal-weight targets under several configs."""
    return _EQUAL.replace("'equal' AS config_id", "c.config_id").replace("JOIN reb USING (date))", f"JOIN reb USING (date), (VALUES {', '.join(f"('{i}')" for i in ids)}) c(config_id))").replace("PARTITION BY s.date", "PARTITION BY c.config_id, s.date")


@query(f"""WITH {t.segment_sql()}, {t.CASH_SQL}, {_SEG_E}, {account_sql(_swept("equal@0.0", "equal@60.0"), "sege", "CASE g.config_id WHEN 'equal@0.0' THEN 0.0 ELSE 60.0 END")}
    SELECT config_id, round(arg_max(nav, date), 6) AS nav FROM daily GROUP BY 1""")
def cost_sweep(spark, sf_dir):
    """The equal-weight run at two spreads, as one job."""
    panel, targets, _ = _equal_run(spark, sf_dir)
    grid = research.sweep(_configs(spark, "equal"), "spread_bps", [0.0, 60.0])
    each = grid.select("base_id", F.col("config_id").alias("new_id")).join(targets, F.col("base_id") == F.col("config_id")).select(F.col("new_id").alias("config_id"), "date", "asset", "weight")
    daily = portfolio.account(each, portfolio.asset_returns(panel), t.cash(panel), grid)
    return r6(daily.groupBy("config_id").agg(F.max_by("nav", "date").alias("nav")))


# -- feasibility and library --------------------------------------------------------------


@query(f"WITH {t.FEASIBILITY_SQL} SELECT card_id, name, kind, mandatory, status, resolved_to, CASE WHEN resolved_to IS NULL THEN '' ELSE 'size ' || regexp_extract(resolved_to, '_([0-9]+)$', 1) END AS caveats FROM res")
def feasibility_resolved(spark, sf_dir):
    return feasibility.resolve(t.requirements(spark, sf_dir), t.registry(spark, sf_dir)).withColumn("caveats", F.concat_ws("; ", "caveats"))


@query(f"""WITH {t.FEASIBILITY_SQL}, c AS (SELECT card_id, count(CASE WHEN mandatory AND status = 'UNAVAILABLE' THEN 1 END) AS n_blocking, count(CASE WHEN mandatory AND status IN ('DEGRADED', 'PROXY') THEN 1 END) AS n_signoff,
        count(CASE WHEN mandatory AND status = 'AVAILABLE' THEN 1 END) AS clean, count(CASE WHEN mandatory THEN 1 END) AS n_mandatory, count(CASE WHEN status IN ('PROXY', 'DEGRADED') THEN 1 END) AS soft FROM res GROUP BY 1)
    SELECT card_id, n_blocking, n_signoff, clean, n_mandatory, CASE WHEN n_blocking > 0 THEN 'FAIL_FAST' WHEN soft > 0 THEN 'GO_WITH_PROXY' ELSE 'GO' END AS verdict FROM c""")
def feasibility_verdicts(spark, sf_dir):
    out = feasibility.verdicts(feasibility.resolve(t.requirements(spark, sf_dir), t.registry(spark, sf_dir)))
    return out.select("card_id", F.size("blocking").cast("long").alias("n_blocking"), F.size("signoff").cast("long").alias("n_signoff"), "clean", "n_mandatory", "verdict")


@query("""WITH needs AS (SELECT p_brand AS card_id, count(DISTINCT p_type) * 3 AS least, min(p_size) % 2 = 0 AS cross_ FROM part GROUP BY 1),
    u AS (SELECT n_name AS name, count(*) AS breadth, n_regionkey % 2 = 0 AS inside, 1990 + n_nationkey AS since FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
    s AS (SELECT card_id, name AS universe, CASE WHEN cross_ AND breadth >= 2 * least THEN 25 WHEN cross_ AND breadth >= least THEN 15 WHEN cross_ AND breadth >= 0.5 * least THEN -10 WHEN NOT cross_ AND breadth <= 12 THEN 10 ELSE 0 END
        + 20 + CASE WHEN 2020 - since >= 15 THEN 10 ELSE -8 END + CASE WHEN inside THEN 10 ELSE 0 END AS score, cross_ AND breadth < 0.5 * least AS out_ FROM needs, u)
    SELECT card_id, universe, score::DOUBLE AS score, row_number() OVER (PARTITION BY card_id ORDER BY score DESC, universe) AS place FROM s WHERE NOT out_ QUALIFY place <= 5""")
def universes_proposed(spark, sf_dir):
    part = t.table(spark, sf_dir, "part")
    needs = part.groupBy(F.col("p_brand").alias("card_id")).agg((F.countDistinct("p_type") * 3).alias("min_names"), (F.min("p_size") % 2 == 0).alias("needs_cross_section")).withColumns(
        {"cap_segment": F.lit("large"), "sector": F.lit(None).cast("string"), "min_history_years": F.lit(15), "must_be_in_mandate": F.lit(False)}
    )
    nations = t.table(spark, sf_dir, "nation").join(t.table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    universes = nations.groupBy(F.col("n_name").alias("name"), (F.col("n_regionkey") % 2 == 0).alias("in_mandate"), (1990 + F.col("n_nationkey")).alias("history_from")).agg(F.count("*").alias("approx_breadth")).withColumns(
        {"u_segment": F.lit("large"), "u_sector": F.lit(None).cast("string")}
    )
    return feasibility.propose(feasibility.score_universes(needs, universes, 2020)).select("card_id", "universe", "score", F.col("place").cast("long").alias("place"))


_SIM = f"""{t.LIBRARY_SQL}, cosines AS (SELECT a.o_custkey::VARCHAR AS query_id, b.o_custkey::VARCHAR AS entry_id, count(*) AS shared, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS cosine
    FROM sp a JOIN sp b ON a.factor = b.factor AND a.o_custkey <> b.o_custkey WHERE a.o_custkey % 100 = 0 GROUP BY ALL),
    near AS (SELECT c.* FROM cosines c JOIN lib q ON q.entry_id = query_id WHERE shared >= greatest(2, q.k // 2))"""


def _queries(library: DataFrame) -> DataFrame:
    """The stated query set: entries whose number is divisible by 100, against all entries."""
    return library.where(F.col("entry_id").cast("long") % 100 == 0)


@query(f"WITH {_SIM} SELECT query_id, entry_id, round(cosine, 6) AS cosine, shared FROM near WHERE cosine >= 0.9")
def similar_fingerprints(spark, sf_dir):
    library = panels.settled(t.library(spark, sf_dir))
    return r6(lib.similar(_queries(library), library))


@query(f"""WITH {_SIM}, q AS (SELECT entry_id AS query_id, card_id, card_fingerprint AS own FROM lib WHERE entry_id::BIGINT % 100 = 0),
    kin AS (SELECT query_id, own, l.card_fingerprint AS f, 0 AS why FROM q JOIN lib l ON substr(l.card_id, 1, 6) = substr(q.card_id, 1, 6)
        UNION ALL SELECT query_id, own, l.card_fingerprint, 1 FROM near JOIN q USING (query_id) JOIN lib l ON l.entry_id = near.entry_id WHERE cosine >= 0.95),
    g AS (SELECT query_id, f, min(why) AS why FROM kin WHERE f <> own GROUP BY ALL)
    SELECT q.query_id, count(CASE WHEN why = 0 THEN 1 END) AS family, count(CASE WHEN why = 1 THEN 1 END) AS same_bet, count(f) AS total FROM q LEFT JOIN g USING (query_id) GROUP BY 1""")
def trial_budgets(spark, sf_dir):
    library = panels.settled(t.library(spark, sf_dir))
    return lib.trial_budget(_queries(library), library)


@query(f"WITH {t.LIBRARY_SQL} SELECT card_fingerprint, count(*) AS n, min(entry_id) AS first_entry, max(entry_id) AS last_entry FROM lib GROUP BY 1 HAVING count(*) > 1")
def duplicate_experiments(spark, sf_dir):
    return lib.duplicates(t.library(spark, sf_dir))


# -- rules --------------------------------------------------------------------------------

_EVID = """w AS (SELECT l_suppkey::VARCHAR AS card_id, count(*) AS n, sum(l_discount::DECIMAL(18,2))::DOUBLE / count(*) AS disc, sum(l_tax::DECIMAL(18,2))::DOUBLE / count(*) AS tax, max(l_quantity) AS top,
        count(CASE WHEN l_returnflag = 'R' THEN 1 END)::DOUBLE / count(*) AS returned FROM lineitem GROUP BY 1),
    ev AS (SELECT card_id, 'deflated_sharpe' AS key, 1 - disc AS value FROM w UNION ALL SELECT card_id, 'oos_min_sharpe', returned FROM w UNION ALL SELECT card_id, 'bootstrap_p', disc FROM w WHERE n % 3 > 0
        UNION ALL SELECT card_id, 'max_corr_to_book', returned * 2 FROM w WHERE n % 2 = 0 UNION ALL SELECT card_id, 'alpha_t_hac', tax * 60 FROM w UNION ALL SELECT card_id, 'mandate_violations', CASE WHEN top >= 50 THEN 1::DOUBLE ELSE 0::DOUBLE END FROM w)"""


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Evidence by supplier: shares of its order lines stand for statistics of a card."""
    n = F.count("*")
    w = t.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("card_id")).agg(
        n.alias("n"), (t.money("l_discount") / n).alias("disc"), (t.money("l_tax") / n).alias("tax"), F.max("l_quantity").alias("top"), (F.count(F.when(F.col("l_returnflag") == "R", 1)).cast("double") / n).alias("returned")
    )
    cells = {
        "deflated_sharpe": 1 - F.col("disc"), "oos_min_sharpe": F.col("returned"), "bootstrap_p": F.when(F.col("n") % 3 > 0, F.col("disc")), "max_corr_to_book": F.when(F.col("n") % 2 == 0, F.col("returned") * 2),
        "alpha_t_hac": F.col("tax") * 60, "mandate_violations": F.when(F.col("top") >= 50, 1.0).otherwise(0.0),
    }
    rows = w.select("card_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in cells.items()])).alias("e")).select("card_id", "e.*").where("value is not null")
    return w, rows


_GATE_ROWS = """('deflated_sharpe', 'skill beyond the best of the trials', '>=', 0.95::DOUBLE, true, true), ('oos_min_sharpe', 'worst unseen window pays', '>=', 0.3::DOUBLE, true, true),
    ('bootstrap_p', 'ahead of the benchmark by more than luck', '<=', 0.05::DOUBLE, true, true), ('max_corr_to_book', 'not a copy of what is held', '<=', 0.8::DOUBLE, true, false), ('best_delta_ir', 'raises the ratio of the whole book', '>=', 0.05::DOUBLE, true, false),
    ('alpha_t_hac', 'return left after known factors', 'abs', 2.0::DOUBLE, true, true), ('mandate_violations', 'no breach of the mandate', '<=', 0.0::DOUBLE, true, true), ('annual_turnover', 'trades little enough to run', '<=', 4.0::DOUBLE, false, false)"""
_GATE = f"""{_EVID}, g(key, name, op, threshold, blocking, must) AS (VALUES {_GATE_ROWS}), c AS (SELECT card_id, g.*, value FROM w CROSS JOIN g LEFT JOIN ev USING (card_id, key)),
    crit AS (SELECT card_id, key, name, coalesce(CASE op WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold ELSE abs(value) >= threshold END, false) AS passed, CASE WHEN value IS NULL THEN must ELSE blocking END AS blocking FROM c)"""


@query(f"WITH {_GATE} SELECT card_id, key, name, passed, blocking FROM crit")
def gate_b_criteria(spark, sf_dir):
    w, rows = _evidence(spark, sf_dir)
    return rules.gate_b(rows, w).select("card_id", "key", "name", "passed", "blocking")


@query(f"WITH {_GATE} SELECT card_id, 'B' AS gate, bool_and(passed OR NOT blocking) AS passed, count(CASE WHEN NOT passed AND NOT blocking THEN 1 END) AS n_warnings FROM crit GROUP BY card_id")
def gate_b_results(spark, sf_dir):
    w, rows = _evidence(spark, sf_dir)
    return rules.gate_results(rules.gate_b(rows, w)).select("card_id", "gate", "passed", F.size("warnings").cast("long").alias("n_warnings"))


_RUNGS = f"""{_EVID}, wide AS (SELECT card_id, n % 4 = 0 AS adapted, 1 - returned AS rate, returned AS oos, 1 - disc AS dsr, returned - 0.2 AS margin, CASE WHEN n % 2 = 0 THEN returned * 2 END AS corr, tax AS gain, (top >= 50)::INT AS broken FROM w),
    c(card_id, rung, i, name, passed) AS (SELECT card_id, 'REPLICATED', 0, 'printed numbers replicate', coalesce(rate >= 0.8, false) FROM wide UNION ALL SELECT card_id, 'INDIA_VALIDATED', 1, 'positive in every local window', coalesce(oos >= 0.3, false) FROM wide
        UNION ALL SELECT card_id, 'ROBUST', 2, 'clears selection bias', coalesce(dsr >= 0.95, false) FROM wide UNION ALL SELECT card_id, 'ROBUST', 2, 'beats free alternatives', coalesce(margin > 0, false) FROM wide
        UNION ALL SELECT card_id, 'ORTHOGONAL', 3, 'differs from the book', coalesce(corr <= 0.8, false) FROM wide UNION ALL SELECT card_id, 'PORTFOLIO_USEFUL', 4, 'improves the book', coalesce(gain >= 0.05, false) FROM wide
        UNION ALL SELECT card_id, 'PORTFOLIO_USEFUL', 4, 'inside the mandate', broken = 0 FROM wide)"""


def _wide_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by supplier, one row a card, as the rungs read it."""
    w, _ = _evidence(spark, sf_dir)
    return w.select(
        "card_id", F.when(F.col("n") % 4 == 0, "adaptation").otherwise("replication").alias("mode"), (1 - F.col("returned")).alias("replication_pass_rate"), F.col("returned").alias("india_oos_min"), (1 - F.col("disc")).alias("dsr"),
        (F.col("returned") - 0.2).alias("min_margin"), F.when(F.col("n") % 2 == 0, F.col("returned") * 2).alias("max_corr"), F.col("tax").alias("delta_ir"), (F.col("top") >= 50).cast("int").alias("mandate_violations"),
    )


@query(f"WITH {_RUNGS} SELECT card_id, rung, name, passed FROM c")
def rung_evidence(spark, sf_dir):
    return rules.rung_criteria(_wide_evidence(spark, sf_dir)).select("card_id", "rung", "name", "passed")


@query(f"""WITH {_RUNGS}, s0 AS (SELECT card_id, i, bool_and(passed) AS ok FROM c JOIN (SELECT card_id, adapted FROM wide) USING (card_id) WHERE NOT (adapted AND i = 0) GROUP BY ALL), s AS (SELECT card_id, i, min(ok::INT) OVER (PARTITION BY card_id ORDER BY i) AS sofar FROM s0),
    nm(i, rung) AS (VALUES (0, 'REPLICATED'), (1, 'INDIA_VALIDATED'), (2, 'ROBUST'), (3, 'ORTHOGONAL'), (4, 'PORTFOLIO_USEFUL')),
    g AS (SELECT card_id, max(CASE WHEN sofar = 1 THEN i END) AS a, min(CASE WHEN sofar = 0 THEN i END) AS b FROM s GROUP BY 1)
    SELECT card_id, x.rung AS attained_rung, y.rung AS stopped_at FROM g LEFT JOIN nm x ON x.i = a LEFT JOIN nm y ON y.i = b""")
def promotion_ladder(spark, sf_dir):
    wide = _wide_evidence(spark, sf_dir)
    return rules.ladder(wide, rules.rung_criteria(wide))


@query("""WITH m AS (SELECT p_brand AS portfolio, p_type AS metric, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    g AS (SELECT p_brand AS portfolio, p_type AS metric, sum(p_retailprice::DECIMAL(18,2))::DOUBLE / count(*) AS target, CASE WHEN count(*) % 2 = 0 THEN 25::DOUBLE END AS abs_tol FROM part GROUP BY ALL)
    SELECT portfolio, metric, round(abs(value - target), 6) AS gap, round(abs(value - target) / abs(target), 6) AS relative_gap, coalesce(CASE WHEN abs_tol IS NOT NULL THEN abs(value - target) <= abs_tol ELSE abs(value - target) / abs(target) <= 0.02 END, false) AS passed FROM g LEFT JOIN m USING (portfolio, metric)""")
def replication_gaps(spark, sf_dir):
    """List prices by brand and type against the prices that order lines paid."""
    part = t.table(spark, sf_dir, "part").select(F.col("p_brand").alias("portfolio"), F.col("p_type").alias("metric"), "p_retailprice", "p_partkey")
    targets = part.groupBy("portfolio", "metric").agg((t.money("p_retailprice") / F.count("*")).alias("target"), F.lit(0.02).alias("tolerance"), F.when(F.count("*") % 2 == 0, 25.0).alias("absolute_tolerance"))
    lines = t.table(spark, sf_dir, "lineitem").join(part.drop("p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    measured = lines.groupBy("portfolio", "metric").agg((t.money("l_extendedprice") / t.money("l_quantity")).alias("value"))
    return r6(metrics.replication_gap(targets, measured).select("portfolio", "metric", "gap", "relative_gap", "passed"))


@query("""SELECT role AS agent, count(*) AS calls, sum(length(text))::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens, round(avg((turn % 3 > 0)::INT), 6) AS cache_hit_rate, round(sum(length(text) / 8.0), 6) AS latency_s, count(CASE WHEN turn > 3 THEN 1 END) AS errors FROM conversations GROUP BY 1""")
def ledger_by_agent(spark, sf_dir):
    calls = t.table(spark, sf_dir, "conversations").select(
        F.col("role").alias("agent"), F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"), (F.col("turn") % 3).alias("cache_read_tokens"), (F.length("text") / 8.0).alias("latency_s"), F.when(F.col("turn") > 3, "late").alias("error")
    )
    return r6(checks.ledger_totals(calls, "agent"))


@query("""WITH a AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, count(*) AS n_orders, sum((o_totalprice::DECIMAL(18,2) * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1),
    b AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, count(DISTINCT o_orderkey) AS n_orders, sum((l_extendedprice::DECIMAL(18,2) * 100)::BIGINT)::BIGINT AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    x AS (SELECT a.date AS in_a, b.date AS in_b, abs(a.n_orders - b.n_orders) AS d_orders, abs(a.cents - b.cents) AS d_cents FROM a FULL JOIN b USING (date)),
    s AS (SELECT count(CASE WHEN in_a IS NOT NULL AND in_b IS NOT NULL THEN 1 END) AS shared, count(CASE WHEN in_a IS NULL OR in_b IS NULL THEN 1 END) AS unmatched, max(d_orders)::DOUBLE AS w_orders, max(d_cents)::DOUBLE AS w_cents FROM x)
    SELECT 'n_orders' AS quantity, shared, unmatched, w_orders AS worst, w_orders <= 1e-9 AND unmatched = 0 AS agrees FROM s UNION ALL SELECT 'cents', shared, unmatched, w_cents, w_cents <= 1e-9 AND unmatched = 0 FROM s""")
def reconciled_panels(spark, sf_dir):
    """Monthly orders and turnover, once from the orders and once from their lines."""
    orders = t.table(spark, sf_dir, "orders").withColumn("date", F.trunc("o_orderdate", "month"))
    cents = lambda c: F.sum((F.col(c).cast("decimal(18,2)") * 100).cast("long")).alias("cents")
    a = orders.groupBy("date").agg(F.count("*").alias("n_orders"), cents("o_totalprice"))
    lines = t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice").join(orders.select("o_orderkey", "date"), F.col("l_orderkey") == F.col("o_orderkey"))
    b = lines.groupBy("date").agg(F.countDistinct("o_orderkey").alias("n_orders"), cents("l_extendedprice"))
    return checks.reconcile(a, b, ["date"], ["n_orders", "cents"])


# -- evidence -----------------------------------------------------------------------------

_PAGES = """ln AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    pg AS (SELECT doc_id, p AS page, list_aggregate(l[p * 40 + 1 : p * 40 + 40], 'string_agg', chr(10)) AS text FROM (SELECT doc_id, l, unnest(range(0, ((len(l) - 1) // 40) + 1)) AS p FROM ln))"""


_LINE = "regexp_matches(x, '[=≤≥≠±∑∏√∈∞∂∫Α-Ωα-ω]|\\(cid:|[\\^_]\\{')"


@query(f"""WITH {_PAGES}, ls AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM pg),
    q AS (SELECT doc_id, length(text) AS c, len(l) AS n, len(list_filter(l, lambda x: {_LINE})) AS m, regexp_matches(text, 'nruter|ytilitalov|thgieW|oiter|eprahS|etaD|raeY') AS rev FROM ls),
    g AS (SELECT doc_id, count(*) AS n_pages, sum(c)::BIGINT AS n_chars, sum((c < 50)::INT)::BIGINT AS empty_pages, avg(coalesce(m / nullif(n, 0), 0)) AS density, sum(rev::INT)::BIGINT AS reversed_pages, sum(c) / count(*) < 200 AS scanned FROM q GROUP BY doc_id)
    SELECT doc_id, n_pages, n_chars, empty_pages, round(density, 6) AS math_density, reversed_pages, scanned, n_chars > 2000 AND NOT scanned AS usable,
        concat_ws('; ', CASE WHEN scanned THEN 'few characters a page' END, CASE WHEN reversed_pages > 0 THEN 'pages read backwards' END, CASE WHEN empty_pages > 0 THEN 'empty pages' END, CASE WHEN density > 0.2 THEN 'many formulas' END) AS warnings FROM g""")
def extraction_quality(spark, sf_dir):
    pages = evidence.as_pages(t.table(spark, sf_dir, "documents"))
    return r6(evidence.extraction_report(pages).withColumn("warnings", F.concat_ws("; ", "warnings")))


_MARKS = ["abstract", "introduction", "literature review", "methodology", "method", "data and sample", "empirical", "results", "conclusion", "references", "bibliography", "appendix", "we find", "we document", "this paper", "hypothesis", "robustness"]


@query(f"""WITH {_PAGES}, low AS (SELECT doc_id, page, lower(text) AS text FROM pg), u(m) AS (VALUES {", ".join(f"('{m}')" for m in _MARKS)}),
    f AS (SELECT DISTINCT doc_id, m FROM low, u WHERE contains(text, m)), k AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1), d AS (SELECT doc_id, count(*) AS n_pages, sum(length(text))::BIGINT AS n_chars FROM low GROUP BY 1),
    r AS (SELECT d.*, coalesce(n, 0)::INT AS n_markers FROM d LEFT JOIN k USING (doc_id))
    SELECT doc_id, n_pages, n_markers, concat_ws('; ', CASE WHEN n_markers < 3 THEN 'few section markers' END, 'no numeric tables', CASE WHEN n_pages < 5 THEN 'few pages' END, CASE WHEN n_chars < 8000 THEN 'little text' END) AS reasons,
        CASE WHEN n_markers >= 3 THEN 'research_paper' WHEN 1 + (n_markers < 3)::INT + (n_pages < 5)::INT + (n_chars < 8000)::INT >= 3 THEN 'probably_not_a_paper' ELSE 'unclear' END AS verdict FROM r""")
def document_markers(spark, sf_dir):
    out = evidence.classify(evidence.as_pages(t.table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_pages", "n_markers", F.concat_ws("; ", "reasons").alias("reasons"), "verdict")


_RX = r"(?i)\b(\w+ed)\s+(\d+)\b|\b(\w+ing)\s+(?:the|and)\b"


@query(f"""WITH {_PAGES}, h AS (SELECT doc_id, page, unnest(regexp_extract_all(text, '{_RX}', 0)) AS match FROM pg)
    SELECT doc_id, lower(match) AS value, count(*) AS n, min(page)::INT AS first_page FROM h GROUP BY ALL""")
def scanned_values(spark, sf_dir):
    """Frequencies of what a scanner finds; the stock scanners find nothing in these texts."""
    hits = evidence.scan(evidence.as_pages(t.table(spark, sf_dir, "documents")), {"phrase": r"(\b\w+ed\s+\d+\b)|(\b\w+ing\s+(?:the|and)\b)"})
    return evidence.commonest(hits.withColumn("value", F.lower("value"))).select("doc_id", "value", "n", F.col("first_page").cast("int").alias("first_page"))


@query(f"""WITH {_PAGES}, c AS (SELECT doc_id, sum(len(regexp_extract_all(lower(text), 'tion')) + len(regexp_extract_all(lower(text), 'ing ')))::BIGINT AS a, sum(len(regexp_extract_all(lower(text), 'lich')) + len(regexp_extract_all(lower(text), 'keit')))::BIGINT AS b,
    sum(len(regexp_extract_all(lower(text), 'ción')))::BIGINT AS c FROM pg GROUP BY 1)
    SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'fixed_weight' WHEN a >= b AND a >= c THEN 'latin' WHEN b >= c THEN 'german' ELSE 'spanish' END AS template, greatest(a, b, c) AS score FROM c""")
def mechanism_guesses(spark, sf_dir):
    """The guess with a keyword table whose words occur in these texts."""
    words = {"latin": ("tion", "ing "), "german": ("lich", "keit"), "spanish": ("ción",)}
    return evidence.guess_mechanism(evidence.as_pages(t.table(spark, sf_dir, "documents")), words).withColumn("score", F.col("score").cast("long"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weight, rebalanced monthly, net of 30 basis points: the metrics table of the run."""
    return metrics.metrics_table(_equal_run(spark, sf_dir, "month")[2])
