"""Further registered queries: ingestion, feasibility, rules, evidence and portfolio operators on derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import columns
from ledgerline.operators import evidence, feasibility, metrics, portfolio, rules, signals
from ledgerline.operators import library as lib
from ledgerline.plans import tables as t
from ledgerline.plans.queries import _DAY_EQUAL_SQL, _EQUAL_SQL, QUERIES, _configs, _equal_run, _evidence, _rebalances, _wide_evidence, _EVID, _RUNGS, query, r6
from ledgerline.sources import panels

_BEFORE = set(QUERIES)

# -- ingestion ----------------------------------------------------------------------------

_RAW = f"""{t.brand_sql()}, raw AS (SELECT date, series_id AS security_id, value AS price, member AS in_universe, n_lines FROM brand)"""


def _raw_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brand panel as a delivered file has it: other spellings, text for every cell, missing prices and flags."""
    b = t.brand_panel(spark, sf_dir)
    return b.select(
        F.date_format("date", "yyyy-MM-dd").alias("Trade Date"), F.col("series_id").alias("ISIN"), F.when(F.col("n_lines") % 11 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("Adj-Close"),
        F.when(F.col("n_lines") % 13 == 0, F.lit(None)).when(F.col("member"), F.when(F.col("n_lines") % 2 == 0, "Y").otherwise(" True ")).otherwise("0").alias("In Index"), F.col("n_lines").cast("string").alias("Volume"),
    )


_MASTER = f"""{_RAW}, m AS (SELECT date, security_id, CASE WHEN n_lines % 11 <> 0 THEN price END AS price, CASE WHEN n_lines % 13 = 0 THEN false ELSE in_universe END AS in_universe, n_lines FROM raw)"""


@query(f"WITH {_MASTER} SELECT date, security_id, floor(price * 100)::BIGINT AS cents, in_universe, n_lines::VARCHAR AS volume FROM m", days=("date",))
def master_universe(spark, sf_dir):
    """A delivered master table through the alias, date, flag and duplicate rules."""
    out = panels.load_master(_raw_master(spark, sf_dir), require_membership=True)
    return out.select("date", "security_id", F.floor(F.col("price") * 100).alias("cents"), "in_universe", "volume")


@query(f"""WITH {_MASTER}, ok AS (SELECT security_id FROM m GROUP BY 1 HAVING count(price) > 0)
    SELECT security_id AS series_id, date, floor(price * 100)::BIGINT AS cents, in_universe AS member FROM m WHERE security_id IN (SELECT security_id FROM ok)""", days=("date",))
def master_engine_inputs(spark, sf_dir):
    return panels.engine_inputs(panels.load_master(_raw_master(spark, sf_dir))).withColumn("cents", F.floor(F.col("value") * 100)).drop("value")


@query(f"""WITH {_MASTER}, e AS (SELECT security_id, max(CASE WHEN price IS NOT NULL THEN date END) AS last, min(in_universe::INT) AS always FROM m GROUP BY 1), d AS (SELECT max(date) AS e, count(DISTINCT date) AS n FROM m)
    SELECT security_id, last IS NULL AS never_priced, coalesce(last = e, false) AS alive, always = 1 AS never_left FROM e, d""")
def master_survivors(spark, sf_dir):
    master = panels.load_master(_raw_master(spark, sf_dir))
    end = master.agg(F.max("date").alias("end"))
    each = master.groupBy("security_id").agg(F.max(F.when(F.col("price").isNotNull(), F.col("date"))).alias("last"), F.min(F.col("in_universe").cast("int")).alias("always"))
    return each.crossJoin(F.broadcast(end)).select("security_id", F.col("last").isNull().alias("never_priced"), F.coalesce(F.col("last") == F.col("end"), F.lit(False)).alias("alive"), (F.col("always") == 1).alias("never_left"))  # one row


@query(f"""WITH {t.segment_sql()}, r AS (SELECT *, dense_rank() OVER (ORDER BY date) AS source_row FROM seg)
    SELECT series_id, date, round(value, 6) AS value FROM r WHERE series_id <> 'BUILDING' UNION ALL SELECT 'BUILDING SITE', date, round(value, 6) FROM r WHERE series_id = 'BUILDING'
    UNION ALL SELECT s.series_id, d.date, NULL FROM (SELECT DISTINCT CASE series_id WHEN 'BUILDING' THEN 'BUILDING SITE' ELSE series_id END AS series_id FROM r) s, (SELECT DISTINCT date FROM r) d
        WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.date = d.date AND CASE r.series_id WHEN 'BUILDING' THEN 'BUILDING SITE' ELSE r.series_id END = s.series_id)""", days=("date",))
def wide_export(spark, sf_dir):
    """The segment panel as a wide sheet with odd spacing and repeated days, read back as a panel."""
    panel = t.segment_panel(spark, sf_dir)
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]  # the stated columns of the export
    wide = panels.to_wide(panel, names).withColumnRenamed("BUILDING", "BUILDING   SITE ")
    numbered = wide.withColumns({c: F.col(f"`{c}`").cast("string") for c in wide.columns if c != "date"}).withColumn("source_row", F.datediff("date", F.lit("1970-01-01").cast("date")))
    stale = numbered.withColumns({c: F.lit("old") for c in wide.columns if c != "date"}).withColumn("source_row", F.col("source_row") - 1)
    return r6(panels.unpivot_wide(numbered.unionByName(stale)))


@query(f"""WITH {t.brand_sql()}, k AS (SELECT * FROM (VALUES ('Brand#11'), ('Brand#22'), ('Brand#33')) v(s))
    SELECT series_id, date, value FROM brand WHERE series_id IN (SELECT s FROM k) AND EXISTS (SELECT 1 FROM brand b WHERE b.series_id = brand.series_id)""", days=("date",))
def restricted_series(spark, sf_dir):
    panel = t.brand_panel(spark, sf_dir).select("series_id", "date", "value")
    held = panel.where(F.col("series_id").isin("Brand#11", "Brand#22", "Brand#33")).select("series_id").distinct()
    return panels.require_series(panel, held)


@query(f"""WITH {t.segment_sql()}, {t.EVENT_SQL} SELECT series_id, count(*) AS n, min(date) AS first_date FROM (SELECT * FROM seg UNION ALL SELECT 'PROXY_OF_CLICKS', date, value FROM ev WHERE series_id = (SELECT min(series_id) FROM ev)) GROUP BY 1""", days=("first_date",))
def panel_with_proxy(spark, sf_dir):
    events = t.event_panel(spark, sf_dir)
    first = events.join(F.broadcast(events.agg(F.min("series_id").alias("series_id"))), "series_id")  # one row
    both = panels.add_proxy(t.segment_panel(spark, sf_dir), first, "PROXY_OF_CLICKS")
    return both.groupBy("series_id").agg(F.count("*").alias("n"), F.min("date").alias("first_date"))


@query(f"""WITH {t.segment_sql()}, {t.brand_sql()}, d AS (SELECT date FROM seg INTERSECT SELECT date FROM brand) SELECT date FROM d""", days=("date",))
def common_weeks(spark, sf_dir):
    return panels.common_days(t.segment_panel(spark, sf_dir), t.brand_panel(spark, sf_dir))


@query(f"""WITH {t.segment_sql()} SELECT DISTINCT series_id FROM (SELECT series_id FROM seg UNION ALL SELECT p_brand FROM part) WHERE series_id IN (SELECT series_id FROM seg)""")
def needed_series(spark, sf_dir):
    segments = t.segment_panel(spark, sf_dir)
    brands = t.table(spark, sf_dir, "part").select(F.col("p_brand").alias("series_id"))
    return panels.needed_columns(segments.select("series_id"), brands, held=segments)


@query("""WITH r AS (SELECT o_custkey, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderdate::VARCHAR AS o_orderdate, o_orderkey FROM r WHERE n = 1""")
def last_orders(spark, sf_dir):
    """Of orders of one customer and day the last."""
    orders = t.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return panels.keep_last(orders, ["o_custkey", "o_orderdate"], "o_orderkey").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("""WITH e AS (SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_name END AS name, CASE WHEN p_size % 7 > 0 THEN p_brand END AS file, CASE p_size % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'index' WHEN 2 THEN 'gossip' END AS kind, CASE p_size % 3 WHEN 0 THEN 'PIT ' WHEN 1 THEN 'latest' ELSE 'someday' END AS pit_status FROM part)
    SELECT p_partkey, concat_ws('; ', CASE WHEN name IS NULL THEN 'name is required' END, CASE WHEN file IS NULL THEN 'file is required' END, CASE WHEN kind IS NULL THEN 'kind is required' END, CASE WHEN kind = 'gossip' THEN 'unknown kind gossip' END, CASE WHEN pit_status = 'someday' THEN 'unknown pit_status someday' END) AS errors FROM e""")
def supplied_series(spark, sf_dir):
    """Entries of a manifest of supplied series, with what each breaks."""
    size = F.col("p_size")
    entries = t.table(spark, sf_dir, "part").select(
        "p_partkey", F.when(size % 5 > 0, F.col("p_name")).alias("name"), F.when(size % 7 > 0, F.col("p_brand")).alias("file"),
        F.when(size % 4 == 0, "price").when(size % 4 == 1, "index").when(size % 4 == 2, "gossip").alias("kind"), F.when(size % 3 == 0, "PIT ").when(size % 3 == 1, "latest").otherwise("someday").alias("pit_status"),
    )
    return panels.manifest_errors(entries).select("p_partkey", F.concat_ws("; ", "errors").alias("errors"))


@query("""WITH e AS (SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_name END AS file, CASE p_size % 3 WHEN 0 THEN 'point_in_time' WHEN 1 THEN 'restated' ELSE 'pit' END AS s, CASE WHEN p_size % 7 > 0 THEN p_brand ELSE ' ' END AS licence FROM part)
    SELECT p_partkey, concat_ws('; ', CASE WHEN file IS NULL THEN 'master: file is required' END, CASE WHEN trim(licence) = '' THEN 'master: licence is required' END, CASE WHEN s = 'pit' THEN 'master: unknown pit_status pit' END) AS errors FROM e""")
def declared_masters(spark, sf_dir):
    """Declared master universes, with what each breaks."""
    size = F.col("p_size")
    declared = t.table(spark, sf_dir, "part").select(
        "p_partkey", F.when(size % 5 > 0, F.col("p_name")).alias("file"), F.when(size % 3 == 0, "point_in_time").when(size % 3 == 1, "restated").otherwise("pit").alias("pit_status"), F.when(size % 7 > 0, F.col("p_brand")).otherwise(" ").alias("licence")
    )
    return panels.declaration_errors(declared).select("p_partkey", F.concat_ws("; ", "errors").alias("errors"))


@query(f"""WITH {t.FEASIBILITY_SQL}, f AS (SELECT min(name) AS name FROM reg) SELECT 'by name' AS way, name FROM reg WHERE name = (SELECT name FROM f) UNION ALL SELECT 'stands for', name FROM reg WHERE stands_for = 'ECONOMY_10'""")
def registry_selections(spark, sf_dir):
    registry = t.registry(spark, sf_dir)
    first = registry.agg(F.min("name")).first()[0]  # one name
    parts = panels.select_registry(registry, name=first).select(F.lit("by name").alias("way"), "name"), panels.select_registry(registry, proxy_for="ECONOMY_10").select(F.lit("stands for").alias("way"), "name")
    return parts[0].union(parts[1])


# -- signals ------------------------------------------------------------------------------


@query(f"""WITH {t.segment_sql()}, {t.CASH_SQL} SELECT date, round(CASE WHEN count(rf) OVER w = 21 THEN product(1 + rf) OVER w - 1 ELSE 0 END, 8) AS rf_horizon FROM cash WINDOW w AS (ORDER BY date ROWS 20 PRECEDING)""", days=("date",))
def horizon_cash(spark, sf_dir):
    return signals.horizon_cash(t.cash(t.segment_panel(spark, sf_dir))).select("date", F.round("rf_horizon", 8).alias("rf_horizon"))


@query(f"""WITH {t.segment_sql()}, r AS (SELECT *, value / lag(value) OVER (PARTITION BY series_id ORDER BY date) - 1 AS ret FROM seg)
    SELECT series_id, date, round(ret, 6) AS ret, CASE WHEN count(ret) OVER w = 20 THEN round(stddev_samp(ret) OVER w * sqrt(252::DOUBLE), 6) END AS vol, round(lag(value, 2) OVER (PARTITION BY series_id ORDER BY date) / lag(value, 22) OVER (PARTITION BY series_id ORDER BY date) - 1, 6) AS alpha
    FROM r WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 19 PRECEDING)""", days=("date",))
def signal_bundle(spark, sf_dir):
    return r6(signals.signal_bundle(t.segment_panel(spark, sf_dir), "momentum", window=20, skip=2).drop("value"))


# -- portfolios ---------------------------------------------------------------------------


@query(f"""WITH {t.segment_sql()}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM seg)), reb AS (SELECT max(date) AS date FROM seg GROUP BY date_trunc('month', date)), w(warmup) AS (VALUES (0), (26), (60))
    SELECT 'warm_' || warmup AS config_id, date FROM reb JOIN d USING (date), w WHERE pos >= warmup""", days=("date",))
def warmed_rebalances(spark, sf_dir):
    """Monthly rebalances behind three warm-up spans."""
    panel = t.segment_panel(spark, sf_dir)
    days = panel.select("date").distinct()
    parts = [portfolio.after_warmup(_rebalances(panel, f"warm_{n}"), days, n) for n in (0, 26, 60)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH u AS (SELECT DISTINCT c_mktsegment AS asset FROM customer), k AS (SELECT n_nationkey, c_mktsegment AS asset, count(*) AS c FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL), f AS (SELECT n_nationkey FROM k GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM u))
    SELECT n_nationkey::VARCHAR AS config_id, asset, round(c / sum(c) OVER (PARTITION BY n_nationkey), 6) AS weight FROM k WHERE n_nationkey IN (SELECT n_nationkey FROM f) UNION ALL SELECT 'equal_' || r_regionkey, asset, round(1.0 / (SELECT count(*) FROM u), 6) FROM region, u""")
def resolved_weights(spark, sf_dir):
    """Specs of nations that have customers in every segment, as maps, and of regions, as equal."""
    customer = t.table(spark, sf_dir, "customer")
    universe = customer.select(F.col("c_mktsegment").alias("asset")).distinct()
    counts = customer.groupBy(F.col("c_nationkey").cast("string").alias("config_id"), "c_mktsegment").agg(F.count("*").alias("c"))
    maps = counts.groupBy("config_id").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("c_mktsegment", F.col("c").cast("double").alias("c")))).alias("m")).crossJoin(F.broadcast(universe.agg(F.count("*").alias("all")))).where(F.size("m") == F.col("all"))  # one row
    stated = maps.select("config_id", F.lit(False).alias("equal"), F.transform_values("m", lambda _, v: v / F.col("n")).alias("weights"))
    equal = t.table(spark, sf_dir, "region").select(F.concat(F.lit("equal_"), F.col("r_regionkey").cast("string")).alias("config_id"), F.lit(True).alias("equal"), F.lit(None).cast("map<string,double>").alias("weights"))
    return r6(portfolio.resolve_weights(stated.unionByName(equal), universe))


_VARIANTS = f"""{t.brand_sql(2)}, sc AS (SELECT series_id AS asset, date, coalesce(lag(member, 2) OVER w, false) AS eligible, lag(value, 2) OVER w / lag(value, 15) OVER w - 1 AS score, CASE WHEN n_lines % 17 > 0 THEN n_lines::DOUBLE / 10 END AS vol FROM brand WINDOW w AS (PARTITION BY series_id ORDER BY date)),
    cf(config_id, n_hold, quantile, min_names, ascending, weighting, max_weight) AS (VALUES ('quantile', NULL, 0.3::DOUBLE, 5, false, 'equal', NULL), ('losers', 4, NULL, 5, true, 'signal', NULL), ('winners', 5, NULL, 8, false, 'signal', 0.35::DOUBLE), ('steady', 6, NULL, 5, false, 'inverse_vol', NULL)),
    reb AS (SELECT max(date) AS date FROM brand GROUP BY date_trunc('month', date)),
    pool AS (SELECT cf.*, sc.date, asset, score, vol, count(*) OVER d AS n, row_number() OVER (PARTITION BY config_id, sc.date ORDER BY CASE WHEN ascending THEN score ELSE -score END, asset) AS k FROM sc JOIN reb USING (date), cf WHERE eligible AND score IS NOT NULL WINDOW d AS (PARTITION BY config_id, sc.date)),
    held AS (SELECT * FROM pool WHERE n >= min_names AND k <= coalesce(n_hold, greatest(1, round_even(quantile * n, 0)::INT))),
    raw AS (SELECT *, abs(score - CASE WHEN ascending THEN max(score) OVER d ELSE min(score) OVER d END) AS lift, min((coalesce(vol, 0) > 0)::INT) OVER d AS safe FROM held WINDOW d AS (PARTITION BY config_id, date)),
    w1 AS (SELECT *, CASE WHEN weighting = 'signal' AND sum(lift) OVER d > 0 THEN lift WHEN weighting = 'inverse_vol' AND safe = 1 THEN 1 / vol ELSE 1 END AS r FROM raw WINDOW d AS (PARTITION BY config_id, date)),
    w2 AS (SELECT *, least(r / sum(r) OVER (PARTITION BY config_id, date), coalesce(max_weight, 1)) AS w FROM w1)"""


@query(f"WITH {_VARIANTS} SELECT config_id, date, asset, round(w / sum(w) OVER (PARTITION BY config_id, date), 6) AS weight FROM w2", days=("date",))
def cross_sectional_variants(spark, sf_dir):
    """Selection by quantile, of losers, weighted by signal with a cap, and by inverse volatility."""
    panel = t.brand_panel(spark, sf_dir, 2)
    vol = F.when(F.col("n_lines") % 17 > 0, F.col("n_lines").cast("double") / 10)
    scored = signals.momentum(signals.lagged_eligibility(panel), 13, 2, out="score").select("date", F.col("series_id").alias("asset"), "score", vol.alias("vol"), "eligible")
    eligible = signals.causal_shift(panel.withColumn("was", F.col("member")), ["was"]).select("date", F.col("series_id").alias("asset"), F.coalesce("was", F.lit(False)).alias("e"))
    scored = scored.drop("eligible").join(eligible, ["date", "asset"]).withColumnRenamed("e", "eligible")
    configs = spark.createDataFrame(
        [("quantile", None, 0.3, 5, False, "equal", None), ("losers", 4, None, 5, True, "signal", None), ("winners", 5, None, 8, False, "signal", 0.35), ("steady", 6, None, 5, False, "inverse_vol", None)],
        "config_id string, n_hold int, quantile double, min_names int, ascending boolean, weighting string, max_weight double",
    )
    dates = signals.rebalance_dates(panel.select("date").distinct(), "monthly").crossJoin(F.broadcast(configs))  # four stated configs
    return r6(portfolio.cross_sectional(dates, scored))


_SWEEP_LAGS = f"""{t.segment_sql()}, r AS (SELECT *, value / lag(value) OVER (PARTITION BY series_id ORDER BY date) - 1 AS ret FROM seg), k(lag) AS (VALUES (0), (1), (4)),
    v AS (SELECT *, CASE WHEN count(ret) OVER w = 26 THEN stddev_samp(ret) OVER w * sqrt(252::DOUBLE) END AS vol FROM r WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 25 PRECEDING)),
    l AS (SELECT lag, series_id, date, lag(vol, 1) OVER (PARTITION BY series_id ORDER BY date) AS v1, lag(vol, 2) OVER (PARTITION BY series_id ORDER BY date) AS v2, lag(vol, 5) OVER (PARTITION BY series_id ORDER BY date) AS v5 FROM v, k WHERE lag = 0),
    x AS (SELECT 0 AS lag, series_id, date, v1 AS vol FROM l UNION ALL SELECT 1, series_id, date, v2 FROM l UNION ALL SELECT 4, series_id, date, v5 FROM l), reb AS (SELECT max(date) AS date FROM seg GROUP BY date_trunc('month', date)),
    f AS (SELECT x.*, min((vol IS NOT NULL AND vol > 0)::INT) OVER (PARTITION BY lag, date) AS ok FROM x JOIN reb USING (date))"""


@query(f"WITH {_SWEEP_LAGS} SELECT 'inverse@' || lag || '.0' AS config_id, date, series_id AS asset, round((1 / vol) / sum(1 / vol) OVER (PARTITION BY lag, date), 6) AS weight FROM f WHERE ok = 1", days=("date",))
def lag_sweep(spark, sf_dir):
    """Inverse-volatility targets when signals are known 0, 1 or 4 weeks late."""
    panel = t.segment_panel(spark, sf_dir)
    made = signals.trailing_vol(signals.simple_returns(panel), 26)
    parts = [portfolio.inverse_vol(_rebalances(panel, f"inverse@{float(n)}"), signals.causal_shift(made, ["vol"], n).select("date", F.col("series_id").alias("asset"), "vol")) for n in (0, 1, 4)]
    return r6(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(f"""WITH {t.segment_sql()}, d AS (SELECT DISTINCT date FROM seg), k(rate) AS (VALUES (0.0::DOUBLE), (0.04), (0.08)) SELECT 'cash@' || rate AS config_id, count(*) AS n, round(product(1 + pow(1 + rate, 1.0::DOUBLE / 252) - 1), 6) AS growth FROM d, k GROUP BY rate""")
def cash_rate_sweep(spark, sf_dir):
    days = t.segment_panel(spark, sf_dir).select("date").distinct()
    parts = [panels.cash_accrual(days, r).withColumn("config_id", F.lit(f"cash@{r}")) for r in (0.0, 0.04, 0.08)]
    return r6(parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("config_id").agg(F.count("*").alias("n"), F.product(1 + F.col("rf")).alias("growth")))


@query(f"""WITH {t.segment_sql()}, f AS (SELECT series_id, arg_min(value, date) AS v0 FROM seg GROUP BY 1) SELECT series_id, date, round(value / v0, 6) AS nav FROM seg JOIN f USING (series_id)""", days=("date",))
def buy_and_hold_segments(spark, sf_dir):
    return r6(portfolio.buy_and_hold(t.segment_panel(spark, sf_dir)).select("series_id", "date", "nav"))


_TILTS = """tilt AS (SELECT l_suppkey::VARCHAR AS config_id, date_trunc('year', l_shipdate)::DATE AS date, l_returnflag || l_linestatus AS asset, (count(*) - 40)::DOUBLE / 100 AS raw FROM lineitem GROUP BY ALL),
    pos AS (SELECT *, greatest(raw, 0) AS w, sum(greatest(raw, 0)) OVER (PARTITION BY config_id, date) AS gross, count(*) OVER (PARTITION BY config_id, date) AS n FROM tilt)"""


def _tilts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("config_id"), F.trunc("l_shipdate", "year").alias("date"), F.concat("l_returnflag", "l_linestatus").alias("asset"))
    return lines.agg(((F.count("*") - 40).cast("double") / 100).alias("weight"))


@query(f"""WITH {_TILTS} SELECT 'cash' AS policy, config_id, date, asset, round(CASE WHEN gross > 1 THEN w / gross ELSE w END, 6) AS weight FROM pos UNION ALL
    SELECT 'invested', config_id, date, asset, round(CASE WHEN gross > 0 THEN w / gross ELSE 1.0 / n END, 6) FROM pos""", days=("date",))
def position_policies(spark, sf_dir):
    raw = _tilts(spark, sf_dir)
    both = portfolio.position_policy(raw, True).withColumn("policy", F.lit("cash")).unionByName(portfolio.position_policy(raw, False).withColumn("policy", F.lit("invested")))
    return r6(both)


@query(f"""{_EQUAL_SQL}, n AS (SELECT config_id, count(DISTINCT date) AS n_rebalances, count(CASE WHEN weight > 0 THEN 1 END) / count(DISTINCT date) AS mean_names FROM targets GROUP BY 1),
    p AS (SELECT config_id, count(CASE WHEN cash_weight > 1e-9 THEN 1 END) AS days_with_cash, sum(forced_exits)::BIGINT AS forced_exits FROM daily GROUP BY 1)
    SELECT config_id, n_rebalances, round(mean_names, 6) AS mean_names, days_with_cash, forced_exits FROM n JOIN p USING (config_id)""")
def run_summary(spark, sf_dir):
    _, targets, daily = _equal_run(spark, sf_dir)
    out = portfolio.run_metadata(daily, targets).drop("stale_marks")
    return r6(out.withColumns({c: F.col(c).cast("long") for c in ("n_rebalances", "days_with_cash", "forced_exits")}))


@query(f"""{_EQUAL_SQL}, c AS (SELECT config_id, max(cash_weight) AS max_cash, avg(cash_weight) AS mean_cash, count(CASE WHEN cash_weight > 0.05 THEN 1 END) AS days_over_cash FROM daily GROUP BY 1), h AS (SELECT config_id, min(weight) AS min_weight, max(weight) AS max_weight FROM targets GROUP BY 1)
    SELECT config_id, round(max_cash, 6) AS max_cash, round(mean_cash, 6) AS mean_cash, days_over_cash, round(min_weight, 6) AS min_weight, round(max_weight, 6) AS max_weight,
        concat_ws('; ', CASE WHEN max_cash > 0.05 THEN 'cash above the limit' END, CASE WHEN min_weight < 0 THEN 'short position' END, CASE WHEN max_weight > 0.5 THEN 'weight above the limit' END) AS violations FROM c JOIN h USING (config_id)""")
def mandate_of_run(spark, sf_dir):
    _, targets, daily = _equal_run(spark, sf_dir)
    out = metrics.mandate_check(daily, targets)
    return r6(out.withColumns({"violations": F.concat_ws("; ", "violations"), "days_over_cash": F.col("days_over_cash").cast("long")}))


@query(f"""{_EQUAL_SQL}, m AS (SELECT config_id, avg(turnover) * 252 AS turnover, (max(date) - min(date)) / 365.25 AS years FROM daily GROUP BY 1), n AS (SELECT config_id, count(DISTINCT date) AS n FROM targets GROUP BY 1),
    a(aum) AS (VALUES (1e6::DOUBLE), (1e8), (1e10)), f AS (SELECT config_id, aum, turnover / (n / years) AS fraction FROM m JOIN n USING (config_id), a)
    SELECT config_id, aum, round(fraction, 6) AS fraction, round(ln(aum * fraction * 2), 6) AS log_notional, round(ln(aum * fraction * 2 / (2e7 * 0.1)), 6) AS log_days FROM f""")
def capacity_of_run(spark, sf_dir):
    _, targets, daily = _equal_run(spark, sf_dir)
    runs = daily.groupBy("config_id").agg((F.avg("turnover") * columns.ANNUAL).alias("turnover"), (F.datediff(F.max("date"), F.min("date")) / F.lit(365.25)).alias("years"))
    runs = runs.join(targets.groupBy("config_id").agg(F.countDistinct("date").alias("n_rebalances")), "config_id").select("*", F.explode(F.array(*[F.lit(x) for x in (1e6, 1e8, 1e10)])).alias("aum"))
    out = metrics.turnover_capacity(runs, 2e7)
    return r6(out.select("config_id", "aum", "fraction", F.ln("notional").alias("log_notional"), F.ln("days").alias("log_days")))


@query(f"""{_EQUAL_SQL}, runs AS (SELECT config_id, date, nav FROM daily UNION ALL SELECT 'late', date, nav FROM daily), s AS (SELECT (min(date) + INTERVAL 2 YEAR)::DATE AS start FROM targets),
    first AS (SELECT min(date) AS start FROM targets WHERE date >= (SELECT start FROM s)), c AS (SELECT config_id, date, nav / first_value(nav) OVER (PARTITION BY config_id ORDER BY date) AS nav FROM runs WHERE date >= (SELECT start FROM first))
    SELECT config_id, date, round(ln(nav), 6) AS log_nav, round(coalesce(nav / lag(nav) OVER (PARTITION BY config_id ORDER BY date) - 1, 0), 6) AS ret FROM c""", days=("date",))
def aligned_runs(spark, sf_dir):
    """Two runs from the later of their first rebalances on: the same portfolio, begun two years apart."""
    _, targets, daily = _equal_run(spark, sf_dir)
    start = targets.agg(F.add_months(F.min("date"), 24).alias("start"))
    late = targets.crossJoin(F.broadcast(start)).where("date >= start").drop("start")  # one row
    as_late = lambda df: df.withColumn("config_id", F.lit("late"))
    out = portfolio.align_runs(daily.unionByName(as_late(daily)), targets.unionByName(as_late(late)))
    return r6(out.select("config_id", "date", F.ln("nav").alias("log_nav"), "ret"))


@query("""WITH c AS (SELECT c_custkey::VARCHAR AS card_id, c_mktsegment AS template, (c_custkey % 60)::DOUBLE AS spread_bps, c_nationkey % 2 = 0 AS allow_cash, CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey % 3 = 1 END AS m FROM customer)
    SELECT card_id || ':primary' AS config_id, card_id, 'primary' AS role, template, spread_bps, allow_cash FROM c UNION ALL SELECT card_id || ':mandate', card_id, 'mandate', template, spread_bps, m FROM c WHERE m <> allow_cash
    UNION ALL SELECT card_id || ':benchmark_' || b, card_id, 'benchmark_' || b, 'equal_weight', spread_bps, allow_cash FROM c, (VALUES ('flat'), ('cap')) v(b)""")
def config_fan_out(spark, sf_dir):
    """The configs that cards (customers) run as: primary, mandate and rivals."""
    n = F.col("c_nationkey")
    cards = t.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("card_id"), F.col("c_mktsegment").alias("template"), (F.col("c_custkey") % 60).cast("double").alias("spread_bps"), (n % 2 == 0).alias("allow_cash"),
        F.when(n % 3 > 0, n % 3 == 1).alias("mandate_allow_cash"), F.array(*[F.struct(F.lit(b).alias("name"), F.lit("equal_weight").alias("template")) for b in ("flat", "cap")]).alias("benchmarks"),
    )
    return portfolio.fan_out(cards)


# -- feasibility --------------------------------------------------------------------------

_SHORT = f"""{t.FEASIBILITY_SQL}, needed AS (SELECT DISTINCT p_brand AS card_id, p_brand || '_rate' AS name FROM part)"""


@query(f"""WITH {_SHORT}, u AS (SELECT card_id, name FROM res WHERE status = 'UNAVAILABLE' UNION SELECT card_id, name FROM needed)
    SELECT card_id, name, CASE WHEN contains(lower(name), 'rate') THEN 'rate' WHEN contains(lower(name), 'index') THEN 'index' ELSE 'price' END AS kind FROM u""")
def data_shortfall(spark, sf_dir):
    resolved = feasibility.resolve(t.requirements(spark, sf_dir), t.registry(spark, sf_dir))
    instruments = t.table(spark, sf_dir, "part").select(F.col("p_brand").alias("card_id"), F.concat("p_brand", F.lit("_rate")).alias("name")).distinct()
    return feasibility.shortfall(resolved, instruments)


_NEEDS = "needs AS (SELECT DISTINCT p_brand AS universe, p_type || '_' || p_size AS name FROM part)"


@query(f"""WITH {t.FEASIBILITY_SQL}, {_NEEDS} SELECT universe, name, name IN (SELECT name FROM reg) AS held FROM needs""")
def instruments(spark, sf_dir):
    """Instruments of each universe (brand), held by the registry or missing."""
    needed = t.requirements(spark, sf_dir).select(F.col("card_id").alias("universe"), "name")
    registry = t.registry(spark, sf_dir)
    return feasibility.instruments_held(needed, registry).withColumn("held", F.lit(True)).unionByName(feasibility.instruments_missing(needed, registry).withColumn("held", F.lit(False)))


@query(f"""WITH {t.FEASIBILITY_SQL}, adv AS (SELECT DISTINCT p_brand AS card_id, p_type || '_' || p_size AS name, CASE (length(p_type) + p_size) % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'proxy' ELSE 'none' END AS match FROM part WHERE p_size > 10)
    SELECT r.card_id, r.name, status, match, CASE WHEN match IS NOT NULL THEN match = CASE WHEN status = 'AVAILABLE' THEN 'exact' WHEN status IN ('PROXY', 'DEGRADED') THEN 'proxy' ELSE 'none' END END AS agree FROM res r LEFT JOIN adv a ON a.card_id = r.card_id AND a.name = r.name""")
def advice_agreement(spark, sf_dir):
    part = t.table(spark, sf_dir, "part").where("p_size > 10")
    k = (F.length("p_type") + F.col("p_size")) % 3
    advice = part.select(F.col("p_brand").alias("card_id"), F.concat_ws("_", "p_type", F.col("p_size").cast("string")).alias("name"), F.when(k == 0, "exact").when(k == 1, "proxy").otherwise("none").alias("match")).distinct()
    resolved = feasibility.resolve(t.requirements(spark, sf_dir), t.registry(spark, sf_dir))
    return feasibility.advisory_agreement(resolved, advice).select("card_id", "name", "status", "match", "agree")


@query(f"""WITH {t.FEASIBILITY_SQL}, ideal AS (SELECT DISTINCT p_brand AS card_id, p_type AS field, min(p_size) % 2 = 0 AS mv FROM part GROUP BY ALL), asks AS (SELECT DISTINCT p_brand AS card_id, lower(p_type) AS k FROM part WHERE p_size > 25),
    need AS (SELECT card_id, list_aggregate(list_sort(list(field)), 'string_agg', '; ') AS need FROM ideal WHERE mv GROUP BY 1), open_ AS (SELECT card_id, list_aggregate(list_sort(list(field)), 'string_agg', '; ') AS gone FROM ideal JOIN asks USING (card_id) WHERE mv AND lower(field) = k GROUP BY 1),
    st AS (SELECT card_id, list_aggregate(list_sort(list(name || ' -> ' || resolved_to) FILTER (status = 'PROXY')), 'string_agg', '; ') AS proxied, list_aggregate(list_sort(list(name) FILTER (status = 'DEGRADED')), 'string_agg', '; ') AS degraded FROM res GROUP BY 1)
    SELECT c.card_id, coalesce(need, '') AS need, coalesce(gone, '') AS not_in_hand, coalesce(proxied, '') AS proxied, coalesce(degraded, '') AS degraded FROM (SELECT DISTINCT card_id FROM ideal) c LEFT JOIN need USING (card_id) LEFT JOIN open_ USING (card_id) LEFT JOIN st USING (card_id)""")
def data_plans(spark, sf_dir):
    part = t.table(spark, sf_dir, "part")
    fields = part.groupBy(F.col("p_brand").alias("card_id"), "p_type").agg((F.min("p_size") % 2 == 0).alias("mv")).groupBy("card_id").agg(F.collect_list(F.struct(F.col("p_type").alias("field"), F.col("mv").alias("minimum_viable"))).alias("ideal"))
    asks = part.where("p_size > 25").groupBy(F.col("p_brand").alias("card_id")).agg(F.array(F.struct(F.lit("all").alias("item"), F.collect_set(F.concat(F.lit(" "), F.upper("p_type"))).alias("satisfies"))).alias("requests"))
    resolved = feasibility.resolve(t.requirements(spark, sf_dir), t.registry(spark, sf_dir))
    out = feasibility.data_plan(fields.join(asks, "card_id", "left"), resolved)
    return out.select("card_id", *[F.concat_ws("; ", c).alias(c) for c in ("need", "not_in_hand", "proxied", "degraded")])


@query("""WITH late AS (SELECT p_partkey, 'supplied_' || p_partkey AS name, CASE p_size % 3 WHEN 0 THEN 'pit' WHEN 1 THEN 'Latest' ELSE 'restated' END AS s FROM part)
    SELECT name, CASE WHEN s = 'pit' THEN '' ELSE 'not knowable at the time' END AS caveats FROM late UNION ALL
    SELECT DISTINCT p_type || '_' || p_size, 'size ' || p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""")
def extended_registry(spark, sf_dir):
    size = F.col("p_size")
    entries = t.table(spark, sf_dir, "part").select(F.concat(F.lit("supplied_"), F.col("p_partkey").cast("string")).alias("name"), F.when(size % 3 == 0, "pit").when(size % 3 == 1, "Latest").otherwise("restated").alias("pit_status"), F.lit(None).cast("array<string>").alias("caveats"))
    return panels.extend_registry(t.registry(spark, sf_dir), entries).select("name", F.concat_ws("; ", "caveats").alias("caveats"))


_TRANS = """al AS (SELECT n_name AS alias, 'src_' || n_regionkey AS source FROM nation), tr AS (SELECT 'src_' || r_regionkey AS source, r_name AS target, CASE r_regionkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'close' WHEN 2 THEN 'partial' ELSE 'poor' END AS grade FROM region
        UNION ALL SELECT 'src_' || r_regionkey, 'ALT_' || r_name, 'poor' FROM region)"""


def _translations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation, region = t.table(spark, sf_dir, "nation"), t.table(spark, sf_dir, "region")
    source = lambda c: F.concat(F.lit("src_"), F.col(c).cast("string"))
    k = F.col("r_regionkey") % 4
    grade = F.when(k == 0, "exact").when(k == 1, "close").when(k == 2, "partial").otherwise("poor")
    recorded = region.select(source("r_regionkey").alias("source"), F.col("r_name").alias("target"), grade.alias("grade")).unionByName(region.select(source("r_regionkey").alias("source"), F.concat(F.lit("ALT_"), "r_name").alias("target"), F.lit("poor").alias("grade")))
    return nation.select(F.col("n_name").alias("alias"), source("n_regionkey").alias("source")), recorded


@query(f"""WITH {_TRANS}, s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'nowhere' ELSE n_name END AS text FROM supplier JOIN nation ON n_nationkey = s_nationkey), k AS (SELECT s_suppkey, source FROM s LEFT JOIN al ON alias = text),
    r AS (SELECT s_suppkey, source, target, grade, row_number() OVER (PARTITION BY s_suppkey ORDER BY CASE grade WHEN 'exact' THEN 0 WHEN 'close' THEN 1 WHEN 'partial' THEN 2 ELSE 3 END, target) AS place FROM k JOIN tr USING (source))
    SELECT k.s_suppkey, k.source, target, grade FROM k LEFT JOIN r ON r.s_suppkey = k.s_suppkey AND place = 1""")
def best_translations(spark, sf_dir):
    """Suppliers' nations, oddly spelled, to canonical sources and their best recorded translation."""
    aliases, recorded = _translations(spark, sf_dir)
    nation = t.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    text = F.when(F.col("s_suppkey") % 5 == 0, "nowhere").otherwise(F.concat(F.lit("  "), F.lower("n_name")))
    claims = t.table(spark, sf_dir, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", text.alias("text"))
    known = feasibility.canonical_source(claims, aliases)
    best = feasibility.translations_of(known.select("source").distinct(), recorded).where("place = 1").select("source", "target", "grade")
    return known.join(best, "source", "left").select("s_suppkey", "source", "target", "grade")


@query(f"""WITH {_TRANS}, cl AS (SELECT s_suppkey::VARCHAR AS card_id, CASE WHEN s_suppkey % 5 = 0 THEN 'nowhere' ELSE n_name END AS text, CASE WHEN s_suppkey % 3 = 0 THEN 'OTHER' ELSE r_name END AS target, CASE WHEN s_suppkey % 2 = 0 THEN 'close' ELSE 'exact' END AS claimed
        FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey), k AS (SELECT cl.*, al.source FROM cl LEFT JOIN al ON alias = text), g AS (SELECT k.*, grade FROM k LEFT JOIN tr ON tr.source = k.source AND tr.target = k.target),
    miss AS (SELECT r_name AS target, list_aggregate(list_sort(list(n_name) FILTER (n_nationkey % 4 = 0)), 'string_agg', ', ') AS missing FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1),
    sc AS (SELECT card_id, u.r_name AS target, row_number() OVER (PARTITION BY card_id ORDER BY (u.r_regionkey * 7 + card_id::BIGINT) % 11 DESC, u.r_name) AS place FROM cl, region u)
    SELECT g.card_id, source, grade, place, concat_ws('; ', CASE WHEN source IS NULL THEN 'unknown source' END, CASE WHEN source IS NOT NULL AND grade IS NULL THEN 'no recorded translation' END, CASE WHEN grade <> claimed THEN 'grade differs from the record' END,
        CASE WHEN missing IS NOT NULL THEN 'missing: ' || missing END, CASE WHEN place > 5 THEN 'five universes fit better' END) AS findings FROM g LEFT JOIN miss USING (target) LEFT JOIN sc ON sc.card_id = g.card_id AND sc.target = g.target""")
def checked_translations(spark, sf_dir):
    aliases, recorded = _translations(spark, sf_dir)
    nation, region = t.table(spark, sf_dir, "nation"), t.table(spark, sf_dir, "region")
    placed = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    key = F.col("s_suppkey")
    claims = t.table(spark, sf_dir, "supplier").join(placed, F.col("n_nationkey") == F.col("s_nationkey")).select(
        key.cast("string").alias("card_id"), F.when(key % 5 == 0, "nowhere").otherwise(F.col("n_name")).alias("text"), F.when(key % 3 == 0, "OTHER").otherwise(F.col("r_name")).alias("target"), F.when(key % 2 == 0, "close").otherwise("exact").alias("claimed_grade")
    )
    needed = placed.select(F.col("r_name").alias("universe"), F.col("n_name").alias("name"))
    registry = nation.where("n_nationkey % 4 != 0").select(F.col("n_name").alias("name"))
    scored = claims.select("card_id").crossJoin(F.broadcast(region.select("r_name", "r_regionkey"))).select("card_id", F.col("r_name").alias("universe"), ((F.col("r_regionkey") * 7 + F.col("card_id").cast("long")) % 11).cast("double").alias("score"))  # five regions
    out = feasibility.check_translation(claims, aliases, recorded, needed, registry, scored)
    return out.select("card_id", "source", "grade", F.col("place").cast("long").alias("place"), F.concat_ws("; ", "findings").alias("findings"))


# -- library and rules --------------------------------------------------------------------


@query("""SELECT o_orderkey::VARCHAR AS entry_id, o_custkey::VARCHAR AS card_id, o_orderpriority AS outcome, CASE WHEN o_orderkey % 2 = 0 THEN 'ROBUST' END AS attained_rung, o_orderdate::VARCHAR AS created_utc FROM orders""")
def library_summary(spark, sf_dir):
    """Orders as experiments of the library."""
    orders = t.table(spark, sf_dir, "orders")
    entries = orders.select(F.col("o_orderkey").cast("string").alias("entry_id"), F.col("o_custkey").cast("string").alias("card_id"), F.col("o_orderpriority").alias("outcome"), F.when(F.col("o_orderkey") % 2 == 0, "ROBUST").alias("attained_rung"), F.col("o_orderdate").alias("created_utc"), F.lit(1).alias("other"))
    return lib.summary(entries).withColumn("created_utc", F.col("created_utc").cast("string"))


@query("""WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer)
    SELECT c_custkey::VARCHAR AS card_id, substr(sha256('{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}'), 1, 16) AS fingerprint FROM c""")
def economic_fingerprints(spark, sf_dir):
    """Customers' economic fields, whatever their names and texts: equal fields, equal fingerprints."""
    cards = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("card_id"), "c_nationkey", "c_mktsegment")
    return rules.economic_fingerprint(cards, ["c_nationkey", "c_mktsegment"]).select("card_id", "fingerprint")


@query("""SELECT p_partkey::VARCHAR AS card_id, list_aggregate(list_sort(list_filter([CASE WHEN p_size % 2 = 0 THEN 'colour' END, CASE WHEN p_size % 3 = 0 THEN 'weight' END], lambda x: x IS NOT NULL)), 'string_agg', '; ') AS unknown FROM part WHERE p_size % 2 = 0 OR p_size % 3 = 0""")
def unknown_card_keys(spark, sf_dir):
    size = F.col("p_size")
    keys = t.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("card_id"), F.array_compact(F.array(F.lit("paper"), F.lit("costs"), F.when(size % 2 == 0, "colour"), F.when(size % 3 == 0, "weight"))).alias("keys"))
    return rules.unknown_keys(keys, ["paper", "costs", "signal"]).select("card_id", F.concat_ws("; ", F.array_sort("unknown")).alias("unknown"))


@query("""WITH r AS (SELECT o_custkey::VARCHAR AS card_id, list_sort(list({'item': o_orderkey::VARCHAR, 'w': CASE o_orderkey % 4 WHEN 0 THEN 'TBD..' WHEN 1 THEN 'we go on' WHEN 2 THEN 'the test runs on monthly prices only' END})) AS q FROM orders GROUP BY 1),
    c AS (SELECT c_custkey::VARCHAR AS card_id, q, CASE WHEN c_nationkey % 2 = 0 THEN 'every series that the mechanism reads is held' ELSE 'none' END AS argued FROM customer LEFT JOIN r ON r.card_id = c_custkey::VARCHAR)
    SELECT card_id, CASE WHEN q IS NOT NULL THEN 'asked' WHEN length(argued) >= 40 THEN 'argued_none' ELSE 'silent' END AS stance, coalesce(list_aggregate(list_transform(list_filter(q, lambda x: length(coalesce(x.w, '')) < 25), lambda x: x.item), 'string_agg', '; '), '') AS weak FROM c""")
def request_stances(spark, sf_dir):
    """Customers as cards and their orders as data requests with fallbacks."""
    k = F.col("o_orderkey") % 4
    asks = t.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("item"), F.when(k == 0, "TBD..").when(k == 1, "we go on").when(k == 2, " the test runs  on monthly prices only").alias("without_it")))).alias("requests"))
    argued = F.when(F.col("c_nationkey") % 2 == 0, "every series that the mechanism reads is held").otherwise("none")
    cards = t.table(spark, sf_dir, "customer").join(asks, "c_custkey", "left").select(F.col("c_custkey").cast("string").alias("card_id"), "requests", argued.alias("no_further_data_needed"))
    return rules.request_audit(cards).select("card_id", "stance", F.concat_ws("; ", "weak").alias("weak"))


@query("""WITH p AS (SELECT p_partkey::VARCHAR AS card_id, 'material' AS field, p_type AS value FROM part UNION ALL SELECT p_partkey::VARCHAR, 'name', p_name FROM part),
    r(rule_id, field, pattern, kind, requirement) AS (VALUES ('brass', 'material', 'economy', 'price', 'metal prices'), ('tin', 'material', '(tin|promo)$', 'price', 'metal prices'), ('bolts', 'name', '^(large|small) b', 'rate', 'freight rates')),
    m AS (SELECT card_id, rule_id, kind, requirement, p.field FROM p JOIN r ON r.field = p.field AND regexp_matches(lower(value), pattern))
    SELECT card_id, rule_id, kind, requirement, field FROM m UNION ALL SELECT card_id, NULL, NULL, NULL, field FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.card_id = p.card_id AND m.field = p.field)""")
def derived_requirements(spark, sf_dir):
    """Parts as cards, with the data that their properties call for and the properties that no rule matches."""
    part = t.table(spark, sf_dir, "part")
    card = F.col("p_partkey").cast("string").alias("card_id")
    props = part.select(card, F.lit("material").alias("field"), F.col("p_type").alias("value")).unionByName(part.select(card, F.lit("name").alias("field"), F.col("p_name").alias("value")))
    table = spark.createDataFrame([("brass", "material", "Economy", "price", "metal prices"), ("tin", "material", "(tin|promo)$", "price", "metal prices"), ("bolts", "name", "^(Large|small) B", "rate", "freight rates")], "rule_id string, field string, pattern string, kind string, requirement string")
    matched, unmatched = rules.derive_requirements(props, table)
    return matched.select("card_id", "rule_id", "kind", "requirement", "field").unionByName(unmatched.select("card_id", "field"), allowMissingColumns=True)


@query(f"""WITH {_EVID}, g AS (SELECT card_id, returned >= 0.25 AS passed, n % 5 AS k FROM w)
    SELECT card_id, CASE WHEN passed THEN 'PROMOTE' ELSE 'REJECT' END AS recommendation, CASE k WHEN 0 THEN 'PROMOTE' WHEN 1 THEN 'REJECT' ELSE 'PENDING_HUMAN' END AS outcome FROM g""")
def decided_outcomes(spark, sf_dir):
    w, _ = _evidence(spark, sf_dir)
    results = w.select("card_id", (F.col("returned") >= 0.25).alias("passed"))
    decisions = w.where("n % 5 < 2").select("card_id", F.when(F.col("n") % 5 == 0, "promote").otherwise("reject").alias("decision"), F.lit("board").alias("owner"))
    return rules.outcomes(results, decisions).select("card_id", "recommendation", "outcome")


@query(f"""WITH {_RUNGS} SELECT card_id, concat_ws('; ', CASE WHEN dsr < 0.95 THEN 'deflated Sharpe ' || printf('%.2f', dsr) || ' does not clear selection bias' END, CASE WHEN corr > 0.8 THEN 'correlation ' || printf('%.2f', corr) || ' to the book' END,
    CASE WHEN margin <= 0 THEN 'a free alternative does as well' END, CASE WHEN broken > 0 THEN 'outside the mandate' END) AS lessons FROM wide""")
def run_lessons(spark, sf_dir):
    return rules.lessons(_wide_evidence(spark, sf_dir)).select("card_id", F.concat_ws("; ", "lessons").alias("lessons"))


@query(f"""WITH {t.LIBRARY_SQL}, c AS (SELECT a.o_custkey AS q, b.o_custkey AS e, count(*) AS shared, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS cosine FROM sp a JOIN sp b ON a.factor = b.factor AND a.o_custkey <> b.o_custkey WHERE a.o_custkey % 100 = 0 GROUP BY ALL),
    n AS (SELECT c.*, row_number() OVER (PARTITION BY q ORDER BY round(cosine, 9) DESC, e::VARCHAR) AS place FROM c JOIN lib ON lib.entry_id = q::VARCHAR WHERE shared >= greatest(2, k // 2) AND cosine >= 0.9)
    SELECT q::VARCHAR AS query_id, e::VARCHAR AS entry_id, round(cosine, 6) AS cosine, place FROM n WHERE place <= 10""")
def top_similar_fingerprints(spark, sf_dir):
    """The ten most similar entries of each fingerprint of the stated query set."""
    library = panels.settled(t.library(spark, sf_dir))
    found = lib.similar(library.where(F.col("entry_id").cast("long") % 100 == 0), library, best=10)
    return r6(lib.top_similar(found).select("query_id", "entry_id", "cosine", F.col("place").cast("long").alias("place")))


_CARDS = """cards AS (SELECT s_suppkey::VARCHAR AS card_id, s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'adaptation' ELSE 'replication' END AS mode, s_suppkey % 3 > 0 AS has_plan FROM supplier),
    ck(card_id, section, name, weight, passed) AS (
        SELECT card_id, 'paper', 'source file', 3, true FROM cards UNION ALL SELECT card_id, 'paper', 'digest of the source', 3, k % 5 > 0 FROM cards UNION ALL SELECT card_id, 'intent', 'rationale', 2, 60 + k % 40 > 80 FROM cards
        UNION ALL SELECT card_id, 'intent', 'what breaks', 3, k % 4 >= 2 FROM cards WHERE mode = 'adaptation' UNION ALL SELECT card_id, 'intent', 'numbers to replicate', 3, k % 7 > 0 FROM cards WHERE mode = 'replication'
        UNION ALL SELECT card_id, 'signal', 'template', 3, true FROM cards UNION ALL SELECT card_id, 'signal', 'lag of a day or more', 3, k % 3 >= 1 FROM cards UNION ALL SELECT card_id, 'costs', 'own cost', 3, k % 60 >= 20 FROM cards
        UNION ALL SELECT card_id, 'ambiguities', 'logged', 3, k % 6 >= 3 FROM cards UNION ALL SELECT card_id, 'ambiguities', 'all resolved', 3, k % 6 > 0 AND k % 2 = 0 FROM cards UNION ALL SELECT card_id, 'ambiguities', 'some material', 2, k % 6 > 1 FROM cards
        UNION ALL SELECT card_id, 'data plan', 'designed', 3, has_plan FROM cards UNION ALL SELECT card_id, 'data plan', 'fields', 3, k % 4 > 0 FROM cards WHERE has_plan UNION ALL SELECT card_id, 'data plan', 'least set marked', 3, k % 4 > 1 FROM cards WHERE has_plan)"""
#: Sections of the standard table that these cards fill; a table of checks is a parameter.
_SOME = [c for c in rules.STANDARD if (c[0], c[1]) in {("paper", "source file"), ("paper", "digest of the source"), ("intent", "rationale"), ("intent", "what breaks"), ("intent", "numbers to replicate"), ("signal", "template"), ("signal", "lag of a day or more"), ("costs", "own cost"), ("ambiguities", "logged"), ("ambiguities", "all resolved"), ("ambiguities", "some material"), ("data plan", "designed"), ("data plan", "fields"), ("data plan", "least set marked")}]


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cards, their sections filled by their keys."""
    k = F.col("s_suppkey")
    items = lambda n, *fields: F.transform(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(*[f(i) for f in fields]))
    return t.table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("card_id"), F.struct(F.lit("a.pdf").alias("source_file"), F.when(k % 5 > 0, F.col("s_name")).alias("source_sha256")).alias("paper"),
        F.struct(F.when(k % 2 == 0, "adaptation").otherwise("replication").alias("mode"), F.repeat(F.lit("r"), (60 + k % 40).cast("int")).alias("rationale"), F.when(k % 4 > 0, F.array_repeat(F.lit("b"), (k % 4).cast("int"))).alias("broken_assumptions")).alias("intent"),
        F.when(k % 7 > 0, F.array_repeat(F.lit("cagr"), (k % 7).cast("int"))).alias("replication_targets"), F.struct(F.lit("equal_weight").alias("template"), (k % 3).cast("int").alias("lag_days")).alias("signal"), F.struct((k % 60).cast("double").alias("spread_bps")).alias("costs"),
        items(k % 6, lambda i: F.when((k % 2 == 0) | (i > 1), "settled").otherwise(" ").alias("resolution"), lambda i: (i == 2).alias("material")).alias("ambiguities"),
        F.when(k % 3 > 0, F.struct(items(k % 4, lambda i: (i == 2).alias("minimum_viable")).alias("ideal"))).alias("data_plan"),
    )


@query(f"WITH {_CARDS} SELECT card_id, section, name, weight, passed FROM ck")
def card_checks(spark, sf_dir):
    return rules.checked(cards(spark, sf_dir), _SOME).withColumnRenamed("check", "name")


@query(f"""WITH {_CARDS} SELECT card_id, round(sum(CASE WHEN passed THEN weight ELSE 0 END) / sum(weight), 6) AS score, coalesce(list_aggregate(list_sort(list(section || ': ' || name) FILTER (NOT passed AND weight = 3)), 'string_agg', '; '), '') AS gaps FROM ck GROUP BY 1""")
def card_completeness(spark, sf_dir):
    return r6(rules.completeness(cards(spark, sf_dir), _SOME).withColumn("gaps", F.concat_ws("; ", "gaps")))


@query(f"""WITH {_CARDS}, g(card_id, name, passed, blocking) AS (SELECT card_id, 'the universe is translated', false, true FROM cards UNION ALL SELECT card_id, 'the data set is designed', has_plan AND k % 4 > 0, true FROM cards UNION ALL SELECT card_id, 'alternatives were weighed', false, false FROM cards WHERE has_plan
        UNION ALL SELECT card_id, 'the selection is a rule', false, true FROM cards UNION ALL SELECT card_id, 'the test is planned', false, true FROM cards UNION ALL SELECT card_id, 'the strategy can be built', false, true FROM cards
        UNION ALL SELECT card_id, 'ambiguities are resolved', k % 6 > 0 AND k % 2 = 0, true FROM cards UNION ALL SELECT card_id, 'convertibility is assessed', false, false FROM cards UNION ALL SELECT card_id, 'there are numbers to replicate', k % 7 > 0, true FROM cards WHERE mode = 'replication'
        UNION ALL SELECT card_id, 'what breaks is named', k % 4 > 0, false FROM cards WHERE mode = 'adaptation' UNION ALL SELECT card_id, 'no gap in the data blocks', k % 9 > 0, true FROM cards WHERE k % 2 = 0 UNION ALL SELECT card_id, 'no gap in the data blocks', false, true FROM cards WHERE k % 2 > 0)
    SELECT card_id, name, passed, blocking FROM g""")
def gate_a_criteria(spark, sf_dir):
    """Gate A of all cards; half of them have feasibility verdicts."""
    found = cards(spark, sf_dir)
    k = F.col("card_id").cast("long")
    verdicts = found.where(k % 2 == 0).select("card_id", F.when(k % 9 == 0, F.array(F.lit("gap"))).otherwise(F.array().cast("array<string>")).alias("blocking"))
    return rules.gate_a(found, verdicts).select("card_id", "name", "passed", "blocking")


@query(f"""WITH {_CARDS} SELECT card_id, 'missing' AS reason, section || ': ' || name AS item, 'author' AS owner FROM ck WHERE NOT passed UNION SELECT card_id, 'unresolved', 'ambiguities', 'owner' FROM ck WHERE name = 'all resolved' AND NOT passed""")
def review_queue(spark, sf_dir):
    failed = rules.checked(cards(spark, sf_dir), _SOME).where("not passed")
    missing = failed.select("card_id", F.lit("missing").alias("reason"), F.concat_ws(": ", "section", "check").alias("item"), F.lit("author").alias("owner"))
    return rules.review_queue(missing, failed.where("check = 'all resolved'").select("card_id", F.lit("unresolved").alias("reason"), F.lit("ambiguities").alias("item"), F.lit("owner").alias("owner")), missing)


@query("""WITH c AS (SELECT s_suppkey::VARCHAR AS card_id, s_suppkey % 60 AS bps, s_suppkey % 3 AS lag FROM supplier)
    SELECT card_id, 'Costs' AS "group", 'spread' AS label, bps || '.0' AS value, 'DECIDE' AS flag FROM c UNION ALL SELECT card_id, 'Signal', 'lag', lag::VARCHAR, 'GUESS' FROM c""")
def decision_sheets(spark, sf_dir):
    """The flagged facts of every card; plain and blank ones stay off the sheet."""
    flat = cards(spark, sf_dir).select("card_id", F.col("costs.spread_bps").alias("bps"), F.col("signal.lag_days").alias("lag"), F.col("signal.template").alias("template"), F.lit("").alias("nothing"))
    listed = rules.facts(flat, [("Costs", "spread", "bps", "DECIDE"), ("Signal", "lag", "lag", "GUESS"), ("Signal", "template", "template", ""), ("Signal", "empty", "nothing", "BLOCK")])
    return rules.decision_sheet(listed).select("card_id", "group", "label", "value", "flag")


# -- evidence -----------------------------------------------------------------------------

#: Reports of suppliers: three pages with a results table printed twice, and a page that was read backwards.
_REPORT = """rep AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS doc_id, CASE s_suppkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'monthly' ELSE 'quarterly' END AS freq, 5 + s_suppkey % 40 AS bps, 20 + s_suppkey % 100 AS win, s_suppkey % 400 AS ret, s_suppkey % 230 AS vol, 100 + s_suppkey % 290 AS sr FROM supplier)"""


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    tenth = lambda x: F.concat(F.floor(x / 10).cast("string"), F.lit("."), (x % 10).cast("string"))
    freq = F.when(k % 3 == 0, "daily").when(k % 3 == 1, "monthly").otherwise("quarterly")
    ret, vol, sr = k % 400, k % 230, 100 + k % 290
    hundredth = F.concat(F.floor(sr / 100).cast("string"), F.lit("."), F.lpad((sr % 100).cast("string"), 2, "0"))
    lit = F.lit
    first = F.concat(
        lit("Notes of supplier "), k.cast("string"), lit("\nThe book is rebalanced "), freq, lit(" with "), (5 + k % 40).cast("string"), lit(" bps of cost.\nA rolling window of "), (20 + k % 100).cast("string"), lit(" days.\nSharpe ratio of "), hundredth,
        lit(" after cost\nTable 1: Results\nReturn Volatility Sharpe\nAlpha book "), tenth(ret), lit("% "), tenth(vol), lit("% "), hundredth, lit("\nBeta book "), tenth(ret + 5), lit("% ("), tenth(vol), lit("%) 1.25\nend of page"),
    )
    second = F.concat(lit("Return Volatility Sharpe\nAlpha book "), tenth(ret + k % 2), lit("% "), tenth(vol), lit("% "), hundredth, lit("\nGamma book "), tenth(ret), lit("% "), tenth(vol), lit("% 1.00\nGamma note"))
    third = F.concat(lit("nruter evitalumuC 99 bps"))
    return t.table(spark, sf_dir, "supplier").select(k.cast("string").alias("doc_id"), F.posexplode(F.array(first, second, third)).alias("page", "text"))


@query(f"""WITH {_REPORT} SELECT doc_id, 'rebalance' AS kind, freq AS value, 0 AS page FROM rep UNION ALL SELECT doc_id, 'cost_bps', bps::VARCHAR, 0 FROM rep UNION ALL SELECT doc_id, 'lookback', win::VARCHAR, 0 FROM rep
    UNION ALL SELECT doc_id, 'sharpe', printf('%d.%02d', sr // 100, sr % 100), 0 FROM rep""")
def report_hits(spark, sf_dir):
    """What the stock scanners find in reports of suppliers, the first six of each kind; pages read backwards are skipped."""
    return evidence.first_hits(evidence.scan(report_pages(spark, sf_dir))).select("doc_id", "kind", "value", F.col("page").cast("int").alias("page"))


@query(f"""WITH {_REPORT} SELECT doc_id, 3::BIGINT AS n_pages, 1::BIGINT AS empty_pages, 1::BIGINT AS reversed_pages FROM rep""")
def report_quality(spark, sf_dir):
    """Reports have one page that was read backwards, which is also nearly empty."""
    return evidence.extraction_report(report_pages(spark, sf_dir)).select("doc_id", "n_pages", "empty_pages", "reversed_pages")


@query(f"""WITH {_REPORT} SELECT doc_id, CASE WHEN bps BETWEEN 10 AND 30 THEN bps::DOUBLE ELSE 25 END AS value FROM rep""")
def report_costs(spark, sf_dir):
    """The first cost between 10 and 30 basis points, else 25."""
    return evidence.first_number(evidence.scan(report_pages(spark, sf_dir)), "cost_bps", 10, 30, 25)


@query(f"""WITH {_REPORT} SELECT doc_id, 0 AS page, 2::BIGINT AS n_rows, 3::BIGINT AS width, 'Table 1: Results' AS caption, 'Return Volatility Sharpe' AS header, round(sum_, 6) AS total FROM (SELECT *, (ret / 1000.0 + vol / 1000.0 + sr / 100.0 + (ret + 5) / 1000.0 - vol / 1000.0 + 1.25)::DOUBLE AS sum_ FROM rep)
    UNION ALL SELECT doc_id, 1, 2, 3, NULL, 'Return Volatility Sharpe', round(((ret + k % 2) / 1000.0 + vol / 1000.0 + sr / 100.0 + ret / 1000.0 + vol / 1000.0 + 1.0)::DOUBLE, 6) FROM rep""")
def report_tables(spark, sf_dir):
    """Tables recovered from lines, with header, caption and the sum of their numbers."""
    tables = evidence.recover_tables(report_pages(spark, sf_dir))
    numbers = F.flatten(F.transform("rows", lambda r: r["numbers"]))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    return r6(tables.select("doc_id", F.col("page").cast("int").alias("page"), "n_rows", F.col("width").cast("long").alias("width"), "caption", "header", total.alias("total")))


@query(f"""WITH {_REPORT} SELECT doc_id, 0 AS page, 2::BIGINT AS n_rows FROM rep""")
def report_largest_tables(spark, sf_dir):
    """The table with the most rows, the first among equals."""
    out = evidence.largest_table(evidence.recover_tables(report_pages(spark, sf_dir)))
    return out.select("doc_id", F.col("page").cast("int").alias("page"), "n_rows")


_TARGETS = f"""{_REPORT}, tg(doc_id, page, portfolio, metric, value) AS (SELECT doc_id, 0, 'Alpha book', 'cagr', (ret / 1000.0)::DOUBLE FROM rep UNION ALL SELECT doc_id, 0, 'Alpha book', 'vol', (vol / 1000.0)::DOUBLE FROM rep UNION ALL SELECT doc_id, 0, 'Alpha book', 'sharpe', (sr / 100.0)::DOUBLE FROM rep
    UNION ALL SELECT doc_id, 0, 'Beta book', 'cagr', ((ret + 5) / 1000.0)::DOUBLE FROM rep UNION ALL SELECT doc_id, 0, 'Beta book', 'vol', (-vol / 1000.0)::DOUBLE FROM rep UNION ALL SELECT doc_id, 0, 'Beta book', 'sharpe', 1.25::DOUBLE FROM rep
    UNION ALL SELECT doc_id, 1, 'Alpha book', 'cagr', ((ret + k % 2) / 1000.0)::DOUBLE FROM rep UNION ALL SELECT doc_id, 1, 'Alpha book', 'vol', (vol / 1000.0)::DOUBLE FROM rep UNION ALL SELECT doc_id, 1, 'Alpha book', 'sharpe', (sr / 100.0)::DOUBLE FROM rep
    UNION ALL SELECT doc_id, 1, 'Gamma book', 'cagr', (ret / 1000.0)::DOUBLE FROM rep UNION ALL SELECT doc_id, 1, 'Gamma book', 'vol', (vol / 1000.0)::DOUBLE FROM rep UNION ALL SELECT doc_id, 1, 'Gamma book', 'sharpe', 1.0::DOUBLE FROM rep)"""


@query(f"WITH {_TARGETS} SELECT doc_id, page, portfolio, metric, round(value, 6) AS value FROM tg")
def report_targets(spark, sf_dir):
    out = evidence.propose_targets(evidence.recover_tables(report_pages(spark, sf_dir)))
    return r6(out.withColumn("page", F.col("page").cast("int")))


@query(f"""WITH {_TARGETS} SELECT doc_id, portfolio, metric, count(DISTINCT round(value, 6)) AS n_values, count(DISTINCT page) AS n_pages FROM tg GROUP BY ALL HAVING count(DISTINCT round(value, 6)) > 1""")
def report_conflicts(spark, sf_dir):
    """Targets that a report prints with two values."""
    found = evidence.conflicts(evidence.propose_targets(evidence.recover_tables(report_pages(spark, sf_dir))))
    return found.select("doc_id", "portfolio", "metric", F.size("vals").cast("long").alias("n_values"), F.size("pages").cast("long").alias("n_pages"))


@query(f"""WITH {_TARGETS}, c AS (SELECT doc_id, count(*) AS conflicts FROM (SELECT doc_id FROM tg GROUP BY doc_id, portfolio, metric HAVING count(DISTINCT round(value, 6)) > 1) GROUP BY 1)
    SELECT doc_id, 3::BIGINT AS n_pages, 2::BIGINT AS tables, 12::BIGINT AS targets, coalesce(conflicts, 0) AS conflicts, 0 AS has_code, 0::BIGINT AS tickers FROM rep LEFT JOIN c USING (doc_id)""")
def compared_reports(spark, sf_dir):
    pages = report_pages(spark, sf_dir)
    return evidence.compare_documents(pages, evidence.scan(pages)).select("doc_id", "n_pages", "tables", "targets", "conflicts", "has_code", "tickers")


@query("""SELECT p_partkey, len(list_filter(string_split(p_name || ' ' || p_size || ' ' || p_retailprice, ' '), lambda c: regexp_matches(c, '^[0-9]+(\\.[0-9]+)?$'))) / len(string_split(p_name || ' ' || p_size || ' ' || p_retailprice, ' ')) > 0.35 AS is_table FROM part""")
def numeric_cells(spark, sf_dir):
    cells = F.split(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")), " ")
    return t.table(spark, sf_dir, "part").select("p_partkey", evidence.is_numeric_table(cells).alias("is_table"))


@query("""SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(trim('  ' || p_name || ' / ' || p_type || '!')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS slug FROM part""")
def slugs(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select("p_partkey", columns.slug(F.concat(F.lit("  "), "p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"))


#: The queries of this module.
NAMES = tuple(n for n in QUERIES if n not in _BEFORE)
