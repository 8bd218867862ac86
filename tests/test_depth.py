"""Bounded plans, tiles, mergeable regressions, whole sweeps, section rules, lineage and files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import card_rules, portfolio, research, signals
from ledgerline.sources import files, panels
from tests.test_engine import configs, days, loop, panel, prices

# -- accounting ---------------------------------------------------------------------------


def leaves(df):
    plan = df._jdf.queryExecution().optimizedPlan()
    return plan.collectLeaves().size()


def test_accounting_plan_stays_small_and_takes_a_thousand_configs(spark):
    p = panel(spark, prices(40, 3))
    names = spark.range(1000).select(F.concat(F.lit("c"), "id").alias("config_id"), (F.col("id") % 50).cast("double").alias("spread_bps"), (F.col("id") % 7).alias("shift"))
    d = days(40)
    rebalances = spark.createDataFrame([(x,) for x in (d[3], d[11], d[25])], "date date")
    assets = spark.createDataFrame([("A0", 0), ("A1", 1), ("A2", 2)], "asset string, j int")
    targets = names.crossJoin(rebalances).crossJoin(assets).select("config_id", "date", "asset", ((F.col("j") + F.col("shift")) % 3 / 3.0).alias("weight"))
    cash = panels.cash_accrual(p.select("date").distinct(), 0.03)
    daily = portfolio.account(targets, portfolio.asset_returns(p), cash, names)
    assert leaves(daily) < 30
    got = daily.where(F.col("config_id").isin("c0", "c13", "c999")).orderBy("config_id", "date").collect()
    assert daily.count() == 40_000
    for k in (0, 13, 999):
        w = np.array([(j + k % 7) % 3 / 3 for j in range(3)])
        want = loop(prices(40, 3), np.ones((40, 3), bool), {3: w, 11: w, 25: w}, 1.03 ** (1 / 252) - 1, k % 50 / 1e4 / 2)
        assert np.allclose([r["nav"] for r in got if r["config_id"] == f"c{k}"], want, atol=1e-12)


def test_a_configs_own_cash_rate_replaces_the_cash_table(spark):
    p = panel(spark, prices(60, 2, 4))
    d = days(60)
    targets = spark.createDataFrame([("c", d[5], "A0", 0.3), ("c", d[30], "A1", 0.5)], "config_id string, date date, asset string, weight double")
    own = configs(spark, 20.0).withColumn("cash_rate", F.lit(0.08))
    got = [r["nav"] for r in portfolio.account(targets, portfolio.asset_returns(p), panels.cash_accrual(p.select("date").distinct(), 0.0), own).orderBy("date").collect()]
    want = loop(prices(60, 2, 4), np.ones((60, 2), bool), {5: np.array([0.3, 0]), 30: np.array([0, 0.5])}, 1.08 ** (1 / 252) - 1, 0.001)
    assert np.allclose(got, want, atol=1e-12)


def test_targets_off_the_calendar_are_not_traded_and_unknown_assets_hold_nothing(spark):
    p = panel(spark, prices(20, 1))
    d = days(20)
    rows = [("c", d[2], "A0", 0.5), ("c", d[2].replace(year=1999), "A0", 1.0), ("c", d[2], "ZZ", 0.2), ("other", d[2], "A0", 1.0)]
    targets = spark.createDataFrame(rows, "config_id string, date date, asset string, weight double")
    daily = portfolio.account(targets, portfolio.asset_returns(p), panels.cash_accrual(p.select("date").distinct(), 0.0), configs(spark)).orderBy("date").collect()
    assert {r["config_id"] for r in daily} == {"c"} and len(daily) == 20
    assert daily[3]["forced_exits"] == 1 and daily[1]["nav"] == 1.0


# -- covariance ---------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "piece"), [(64, 1024), (3, 25)])
def test_covariance_tiles_equal_numpy(spark, block, piece):
    n, k, window = 90, 7, 12
    p = prices(n, k, 6)
    mask = np.ones((n, k), bool)
    mask[40, 2] = False
    made = signals.simple_returns(panel(spark, p, mask))
    d = {x: i for i, x in enumerate(days(n))}
    r = np.full((n, k), np.nan)
    r[1:] = p[1:] / p[:-1] - 1
    r[40:42, 2] = np.nan
    tiles = signals.covariance_tiles(made, window, block=block, piece=piece).collect()
    seen = {}
    for t in tiles:
        x = np.array(t["tile"]).reshape(len(t["names_i"]), -1)
        for a, row in zip(t["names_i"], x, strict=True):
            for b, v in zip(t["names_j"], row, strict=True):
                seen[d[t["date"]], int(a[1:]), int(b[1:])] = v
    whole = [i for i in range(window, n) if not np.isnan(r[i - window + 1 : i + 1]).any()]
    assert {i for i, _, _ in seen} == set(whole)
    for i in whole:
        want = np.cov(r[i - window + 1 : i + 1].T) * 252
        for a in range(k):
            for b in range(a, k):
                assert seen.get((i, a, b), seen.get((i, b, a))) == pytest.approx(want[a, b], rel=1e-9, abs=1e-12)
    pairs = signals.rolling_cov(made, window)
    assert pairs.count() == len(whole) * k * (k + 1) // 2


def test_weights_solved_from_tiles_do_not_depend_on_blocks(spark):
    made = signals.simple_returns(panel(spark, prices(60, 5, 8)))
    some = made.select("date").distinct().where(F.dayofmonth("date") < 4)
    for method in ("min_variance", "equal_risk"):
        a, b = (portfolio.solved_weights(signals.covariance_tiles(made, 20, dates=some, block=k).withColumn("config_id", F.lit("c")), method).orderBy("date", "asset").collect() for k in (64, 2))
        assert len(a) and [(r["date"], r["asset"]) for r in a] == [(r["date"], r["asset"]) for r in b]
        assert np.allclose([r["weight"] for r in a], [r["weight"] for r in b], atol=1e-9)


# -- factor regressions -------------------------------------------------------------------


@pytest.mark.parametrize("cut", [23, 100, 5000])
def test_regressions_of_runs_in_parts_equal_numpy(spark, cut):
    n, rng, d = 330, np.random.default_rng(2), days(330)
    f = rng.normal(0, 0.01, (n, 3))
    noise = np.convolve(rng.normal(0, 0.004, n + 3), [1, 0.6, 0.3, 0.1])[3 : n + 3]
    runs = {"a": 0.0003 + f @ [0.5, 0.2, -0.1] + noise, "b": f @ [0.0, 1.0, 0.1] + noise[::-1]}
    rows = spark.createDataFrame([(c, d[i], float(y[i]), 0.0001) for c, y in runs.items() for i in range(n) if (c, i) != ("b", 50)], "config_id string, date date, ret double, rf double").repartition(7)
    factors = spark.createDataFrame([(f"f{j}", d[i], float(f[i, j])) for i in range(n) for j in range(3)], "series_id string, date date, ret double")
    fits = {r["config_id"]: r for r in research.factor_regressions(rows, factors, days=cut).collect()}
    for c, y in runs.items():
        keep = np.array([i for i in range(n) if (c, i) != ("b", 50)])
        x, e = np.column_stack([np.ones(len(keep)), f[keep] - 0.0001]), y[keep] - 0.0001
        b, *_ = np.linalg.lstsq(x, e, rcond=None)
        u, inv, fit = e - x @ b, np.linalg.inv(x.T @ x), fits[c]
        g = x * u[:, None]
        s = g.T @ g
        for m in range(1, fit["lags"] + 1):
            cross = g[m:].T @ g[:-m]
            s += (1 - m / (fit["lags"] + 1)) * (cross + cross.T)
        t = b / np.sqrt(np.diag(inv @ s @ inv))
        assert fit["n"] == len(keep) and fit["lags"] == math.ceil(4 * (len(keep) / 100) ** (2 / 9))
        assert [fit["loadings"][f"f{j}"] for j in range(3)] == pytest.approx(b[1:], rel=1e-9, abs=1e-12)
        assert [fit["alpha_t"], *[fit["t"][f"f{j}"] for j in range(3)]] == pytest.approx(t, rel=1e-9)
        assert fit["r2"] == pytest.approx(1 - u @ u / ((e - e.mean()) @ (e - e.mean())), rel=1e-9)


# -- sweeps -------------------------------------------------------------------------------


def test_sweep_points_equal_runs_of_their_own(spark):
    p = panel(spark, prices(300, 3, 11))
    schema = "config_id string, template string, spread_bps double, lag int, target_vol double, cash_rate double"
    base = spark.createDataFrame([("x", "inverse_vol", 30.0, 0, None, 0.04)], schema)
    grid = research.sweep_grid(base, {"lag": [3.0], "target_vol": [0.05], "spread_bps": [0.0], "cash_rate": [0.0]})
    got = {r["config_id"]: r for r in research.sweep_metrics(p, grid).collect()}
    assert set(got) == {"x", "x@lag=3.0", "x@target_vol=0.05", "x@spread_bps=0.0", "x@cash_rate=0.0"}
    assert got["x@target_vol=0.05"]["vol"] < 0.7 * got["x"]["vol"] and got["x@spread_bps=0.0"]["cagr"] > got["x"]["cagr"]
    assert got["x@cash_rate=0.0"]["cash_cagr"] == 0 and got["x@lag=3.0"]["cagr"] != got["x"]["cagr"]
    known = signals.causal_shift(signals.trailing_vol(signals.simple_returns(p), 26), ["vol"], 3).select("date", F.col("series_id").alias("asset"), "vol")
    dates = signals.rebalance_dates(p.select("date").distinct(), "monthly").select(F.lit("x@lag=3.0").alias("config_id"), "date")
    want = {(r["date"], r["asset"]): r["weight"] for r in portfolio.inverse_vol(dates, known).collect()}
    made = {(r["date"], r["asset"]): r["weight"] for r in research.swept_targets(p, grid).where("config_id = 'x@lag=3.0'").collect()}
    assert made.keys() == want.keys() and all(made[k] == pytest.approx(want[k], rel=1e-12) for k in want)


# -- rules --------------------------------------------------------------------------------


def test_section_rules_read_fields_that_tables_lack_as_blank(spark):
    cards = spark.createDataFrame([("a",), ("b",)], "card_id string").withColumn("selection", F.when(F.col("card_id") == "a", F.struct(F.array(F.lit("X")).alias("explicit_securities"))))
    got = {r["card_id"]: set(r["errors"]) for r in card_rules.section_errors(cards).collect()}
    assert got["b"] == {"a config or more was tried"}
    assert got["a"] == got["b"] | {"selection: securities are chosen by a rule", "selection: a named list says what confirmed it", "selection: a named list has a date"}


def test_families_match_words_and_not_parts_of_words(spark):
    text = ["book-to-market", "book to market", "booking", "profits", "profitable", "cap-weighted", "capped", "52-week high", "b/m", "adverse", "adv", "free float adjusted", "trends"]
    got = {r["x"]: {k for k in card_rules.FAMILIES if r[k]} for r in spark.createDataFrame([(x,) for x in text], "x string").select("x", *[F.regexp_like("x", F.lit(card_rules.family_pattern(w))).alias(k) for k, w in card_rules.FAMILIES.items()]).collect()}
    assert got["book to market"] == got["b/m"] == got["profits"] == {"fundamentals"}
    assert got["cap-weighted"] == got["free float adjusted"] == {"cap weights"} and got["adv"] == {"volume"} and got["52-week high"] == {"momentum"}
    assert not got["booking"] and not got["profitable"] and not got["capped"] and not got["adverse"] and not got["trends"]


def test_requirement_trees_and_notes(spark):
    strategy = F.struct(F.array(F.lit("closing prices"), F.lit("satellite images")).alias("inputs_required"), F.lit("momentum").alias("signal_definition"), F.lit(True).alias("cross_sectional"))
    note = F.struct(F.lit("data").alias("category"), F.lit("image dates").alias("item"), F.lit("w").alias("why"), F.lit("p").alias("triggered_by"), F.array(F.lit("Satellite")).alias("addresses"), F.lit(4).alias("evidence_page"))
    cards = spark.createDataFrame([("a",)], "card_id string").withColumns({"strategy": strategy, "local_notes": F.array(note)})
    rows = card_rules.requirements(cards).collect()
    found = {r["rule_id"]: r["item"] for r in rows}
    assert {"membership", "adv_capacity", "halts", "impact", "stock_costs"} <= found.keys() and not {"adv_read", "publication_dates", "sleeve_floor", "short_rate"} & found.keys()
    assert found["membership"] == "membership of the universe, which is not chosen as it was on each day"
    model = [r for r in rows if r["source"] == "model"]
    assert len(model) == 1 and model[0]["page"] == 4 and not model[0]["blocking"]
    assert [tuple(r) for r in card_rules.unread_inputs(cards).collect()] == [("a", "satellite images", True)]


# -- files --------------------------------------------------------------------------------


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    out = work()
    spark.sparkContext.setJobGroup("", "")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_lineage_is_read_off_the_write(spark, tmp_path):
    p = panel(spark, prices(50, 4))

    def plain():
        p.where("series_id != 'A0'").where("value > 100").write.parquet(f"file://{tmp_path}/a")

    def told():
        steps = files.Lineage()
        a = steps.start(p)
        b = steps.step("without the first", a.where("series_id != 'A0'"))
        steps.step("dear ones", b.where("value > 100")).write.parquet(f"file://{tmp_path}/b")
        return steps.record()

    _, without = jobs_of(spark, "plain", plain)
    record, jobs = jobs_of(spark, "told", told)
    left = spark.read.parquet(f"file://{tmp_path}/b").count()
    assert jobs == without and record == [{"step": "without the first", "rows_before": 200, "rows_after": 150}, {"step": "dear ones", "rows_before": 150, "rows_after": left}]


def test_exports_with_headers_anywhere(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\nTitle\n\n Trade Date , X  Y,Z\n2020-01-02,1.5,n/a\n2020-01-03,2,7\nnotes, end,\n2020-01-03,3,8\n")
    (tmp_path / "b.csv").write_text("Z,dt,\n9,2020-01-02,5\n")
    got = {(r["file"][-5:], r["series_id"], str(r["date"]), r["value"]) for r in files.read_exports(spark, f"file://{tmp_path}").collect()}
    assert got == {("a.csv", "X Y", "2020-01-02", 1.5), ("a.csv", "Z", "2020-01-02", None), ("a.csv", "X Y", "2020-01-03", 3.0), ("a.csv", "Z", "2020-01-03", 8.0), ("b.csv", "Z", "2020-01-02", 9.0)}
    (tmp_path / "c.csv").write_text("no header here\n1,2\n")
    with pytest.raises(ValueError, match="without a header"):
        files.read_exports(spark, f"file://{tmp_path}")


def test_records_against_files(spark, tmp_path):
    (tmp_path / "art").mkdir()
    for name, text in (("x.txt", "one"), ("y.txt", "two")):
        (tmp_path / "art" / name).write_text(text)
    now = files.file_digests(spark, f"file://{tmp_path}/art")
    stated = {r["path"]: r["sha256"] for r in now.collect()}
    rows = [("r1", "s", "p", "me", "t1", [("x.txt", stated["x.txt"]), ("z.txt", "00")], {"a": float("nan")}), ("r2", "s", "p", "me", "t2", [("y.txt", stated["y.txt"])], None)]
    files.write_records(spark.createDataFrame(rows, files.RECORD), f"file://{tmp_path}/log")
    (tmp_path / "art" / "y.txt").write_text("changed")
    states = {tuple(r)[::2] + (r["path"],) for r in files.stale_records(files.read_records(spark, f"file://{tmp_path}/log"), files.file_digests(spark, f"file://{tmp_path}/art")).select("record_id", "path", "state").collect()}
    assert states == {("r1", "unchanged", "x.txt"), ("r1", "missing", "z.txt"), ("r2", "changed", "y.txt")}
    with pytest.raises(ValueError, match="operator"):
        files.write_records(spark.createDataFrame(rows, files.RECORD).withColumn("operator", F.lit("")), f"file://{tmp_path}/log")
