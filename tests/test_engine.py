"""Identities, causality, and negative controls of the engine on seeded fixtures."""

import datetime as dt
import math
import random
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import columns
from ledgerline.operators import checks, evidence, library, metrics, portfolio, research, rules, signals
from ledgerline.sources import panels


def days(n, start=dt.date(2015, 1, 1)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def prices(n=320, k=3, seed=0):
    return 100 * np.cumprod(1 + np.random.default_rng(seed).normal(0.0003, 0.01, (n, k)), axis=0)


def panel(spark, p, mask=None):
    d = days(len(p))
    rows = [(f"A{j}", d[i], None if mask is not None and not mask[i, j] else float(p[i, j])) for i in range(len(p)) for j in range(p.shape[1])]
    return spark.createDataFrame(rows, "series_id string, date date, value double")


def configs(spark, bps=0.0, name="c"):
    return spark.createDataFrame([(name, bps)], "config_id string, spread_bps double")


def no_cash(p):
    return panels.cash_accrual(p.select("date").distinct(), 0.0)


def loop(p, eligible, targets, rf, half):
    """The same rules day by day: drift, forced exits, then rebalance."""
    n, k = p.shape
    w, cash, nav, out, started = np.zeros(k), 1.0, 1.0, [], False
    for i in range(n):
        if started:
            r = np.array([p[i, j] / p[i - 1, j] - 1 if np.isfinite(p[i, j]) and np.isfinite(p[i - 1, j]) else 0.0 for j in range(k)])
            w, cash = w * (1 + r), cash * (1 + rf)
            total = w.sum() + cash
            nav, w, cash = nav * total, w / total, cash / total
            gone = (w != 0) & ~eligible[i]
            nav *= 1 - half * w[gone].sum()
            cash += w[gone].sum()
            w[gone] = 0
        if i in targets:
            new = targets[i]
            nav *= 1 - half * np.abs(new - w).sum()
            w, cash, started = new.copy(), 1 - new.sum(), True
        out.append(nav)
    return np.array(out)


def test_buy_and_hold_and_costs(spark):
    p = panel(spark, prices(60, 1))
    targets = spark.createDataFrame([("c", days(60)[0], "A0", 1.0)], "config_id string, date date, asset string, weight double")
    nav = [r["nav"] for r in portfolio.account(targets, portfolio.asset_returns(p), no_cash(p), configs(spark)).orderBy("date").collect()]
    assert np.allclose(nav, prices(60, 1)[:, 0] / prices(60, 1)[0, 0], atol=1e-10)
    first = portfolio.account(targets, portfolio.asset_returns(p), no_cash(p), configs(spark, 100.0)).orderBy("date").first()
    assert abs(first["nav"] - 0.995) < 1e-12 and first["cost"] == pytest.approx(0.005) and first["turnover"] == 0.5


def test_accounting_equals_the_day_loop_with_exits_and_gaps(spark):
    n, k = 120, 4
    p, rng = prices(n, k, 3), np.random.default_rng(9)
    mask = rng.random((n, k)) > 0.05
    mask[70:, 2] = False
    eligible = mask.copy()
    eligible[50:58, 1] = False
    d = days(n)
    df = panel(spark, p, mask)
    marks = spark.createDataFrame([(f"A{j}", d[i], bool(eligible[i, j])) for i in range(n) for j in range(k)], "series_id string, date date, eligible boolean")
    targets = {}
    for i in range(10, n, 17):
        raw = rng.random(k) * eligible[i]
        targets[i] = raw / raw.sum() * 0.9
    rows = [("c", d[i], f"A{j}", float(w[j])) for i, w in targets.items() for j in range(k)]
    t = spark.createDataFrame(rows, "config_id string, date date, asset string, weight double")
    cash = spark.createDataFrame([(x, 0.0002) for x in d], "date date, rf double")
    got = portfolio.account(t, portfolio.asset_returns(df.join(marks, ["series_id", "date"])), cash, configs(spark, 30.0)).orderBy("date").collect()
    want = loop(np.where(mask, p, np.nan), eligible, targets, 0.0002, 30 / 1e4 / 2)
    assert np.abs(np.array([r["nav"] for r in got]) - want).max() < 1e-12
    assert sum(r["forced_exits"] for r in got) > 0


def test_causality_and_tripwire(spark):
    df = signals.simple_returns(panel(spark, prices(300, 2, 5)))
    known = signals.causal_shift(df.withColumn("x", F.col("value")), ["x"], lag=1).orderBy("series_id", "date").collect()
    assert [r["x"] for r in known][:2] == [None, None] and known[5]["x"] == known[3]["value"]
    leak = df.withColumn("s", F.col("ret") * 2)
    ahead = df.withColumn("s", F.lead("ret").over(columns.in_order("series_id")))
    fine = df.withColumn("s", F.lag("ret", 5).over(columns.in_order("series_id")))
    breaches = lambda x: [(r["h"], r["breach"]) for r in signals.tripwire(x, "s").orderBy("h").collect()]
    assert (0, True) in breaches(leak) and (1, True) in breaches(ahead) and not any(b for _, b in breaches(fine))


def test_ewma_matches_its_definition(spark):
    p = prices(80, 1, 2)
    r = p[1:, 0] / p[:-1, 0] - 1
    got = [x["ewma"] for x in signals.ewma_return(signals.simple_returns(panel(spark, p)), 5).orderBy("date").collect()]
    q = 2 ** (-1 / 5)
    for i in (5, 30, 79):
        w = q ** np.arange(i)[::-1]
        assert got[i] == pytest.approx((w * r[:i]).sum() / w.sum(), abs=1e-12)
    assert got[4] is None


def test_solvers():
    rng = np.random.default_rng(4)
    for n in (2, 5, 12):
        x = rng.standard_normal((60, n)) * rng.uniform(0.5, 2, n) + rng.standard_normal((60, 1))
        c = np.cov(x.T)
        w = portfolio.solve_min_variance(c)
        g = c @ w
        assert abs(w.sum() - 1) < 1e-12 and (w >= 0).all() and g.min() > g[w > 1e-9].max() - 1e-8
        e = portfolio.solve_equal_risk(c)
        share = e * (c @ e) / (e @ c @ e)
        assert np.allclose(share, 1 / n, atol=1e-8)


def test_normal_functions(spark):
    z = NormalDist()
    xs = [-8.0, -3.3, -1.0, 0.0, 0.5, 2.7, 6.5]
    ps = [1e-12, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9]
    df = spark.createDataFrame(list(zip(xs, ps, strict=True)), "x double, p double")
    for r in df.select("x", "p", columns.normal_cdf(F.col("x")).alias("c"), columns.normal_quantile(F.col("p")).alias("q")).collect():
        assert abs(r["c"] - z.cdf(r["x"])) < 1e-13 and abs(r["q"] - z.inv_cdf(r["p"])) < 1e-7 * max(1, abs(r["q"]))


def test_factor_regression_matches_numpy(spark):
    n, rng, d = 260, np.random.default_rng(8), days(260)
    f = rng.normal(0, 0.01, (n, 2))
    y = 0.0002 + f @ [0.6, 0.3] + rng.normal(0, 0.004, n)
    run = spark.createDataFrame([(d[i], float(y[i]), 0.0) for i in range(n)], "date date, ret double, rf double")
    factors = spark.createDataFrame([(f"f{j}", d[i], float(f[i, j])) for i in range(n) for j in range(2)], "series_id string, date date, ret double")
    fit = research.factor_regression(run, factors)
    x = np.column_stack([np.ones(n), f])
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    u, inv, lags = y - x @ b, np.linalg.inv(x.T @ x), fit["lags"]
    s = (x * u[:, None]).T @ (x * u[:, None])
    for m in range(1, lags + 1):
        g = (x[m:] * u[m:, None]).T @ (x[:-m] * u[:-m, None])
        s += (1 - m / (lags + 1)) * (g + g.T)
    assert fit["loadings"]["f0"] == pytest.approx(b[1], abs=1e-10) and fit["alpha_t"] == pytest.approx(b[0] / math.sqrt((inv @ s @ inv)[0, 0]), rel=1e-8)
    assert research.factor_regression(run.limit(150), factors) is None


def test_bootstrap_matches_numpy(spark):
    n, rng, d = 60, np.random.default_rng(3), days(60)
    data = {c: rng.normal(m, 0.01, n) for c, m in (("a", 0.0), ("b", 0.001))}
    runs = spark.createDataFrame([(c, d[i], float(x[i]), 0.0001) for c, x in data.items() for i in range(n)], "config_id string, date date, ret double, rf double")
    intervals, differences = research.bootstrap(runs, "a", reps=130, least=50)
    idx = np.array([research.drawn_days(n, k) for k in range(130)])
    sharpe = {}
    for r in intervals.collect():
        got = data[r["config_id"]][idx]
        e = got - 0.0001
        sharpe[r["config_id"]] = e.mean(1) / e.std(1, ddof=1) * math.sqrt(252)
        assert r["reps"] == 130 and np.allclose(r["sharpe"], np.quantile(sharpe[r["config_id"]], [0.025, 0.5, 0.975]))
        assert np.allclose(r["cagr"], np.quantile(np.prod(1 + got, 1) ** (252 / n) - 1, [0.025, 0.5, 0.975]))
    gap = sharpe["b"] - sharpe["a"]
    row = differences.first()
    assert row["mean_difference"] == pytest.approx(gap.mean()) and row["p_not_better"] == pytest.approx((gap <= 0).mean())


def test_sinks_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}"
    entries = spark.createDataFrame([("1", "c", "f", None, "PASS", "ROBUST", {"m": 1.0, "q": float("nan")}, {"cagr": float("inf")})], library.SCHEMA)
    library.append(entries, f"{path}/lib")
    library.append(entries, f"{path}/lib")
    got = library.read(spark, f"{path}/lib").collect()
    assert len(got) == 2 and got[0]["factor_fingerprint"] == {"m": 1.0, "q": None} and got[0]["headline_metrics"] == {"cagr": None}
    records = spark.createDataFrame([("ingest", "tool", "ana", "2020-01-02"), ("audit", "tool", "ben", "2020-01-01")], "stage string, produced_by string, operator string, created_utc string")
    panels.append_records(records, f"{path}/log")
    assert [r["stage"] for r in panels.history(spark, f"{path}/log", "stage string, produced_by string, operator string, created_utc string").collect()] == ["audit", "ingest"]
    with pytest.raises(panels.Refused):
        panels.append_records(records.withColumn("operator", F.lit(" ")), f"{path}/log")
    metrics.write_metrics(spark.createDataFrame([("a", 0.5, ["x", "y"])], "config_id string, cagr double, violations array<string>"), f"{path}/metrics")
    assert spark.read.csv(f"{path}/metrics", header=True).first().asDict() == {"config_id": "a", "cagr": "0.5", "violations": "x; y"}
    (tmp_path / "s.csv").write_text("day,px\n2020-01-02,2.5\nsoon,1\n2020-01-01,oops\n")
    assert [(str(r["date"]), r["value"]) for r in panels.read_series(spark, f"{path}/s.csv", "day", "px", "S").collect()] == [("2020-01-01", None), ("2020-01-02", 2.5)]
    (tmp_path / "master.csv").write_text("Trade Date,PERMNO,adj price,is active\n2020-01-01,a,1.5,yes\n")
    declared = spark.createDataFrame([("master.csv", "restated", "own")], "file string, pit_status string, licence string")
    assert panels.load_declared_master(spark, declared, path).first()["price"] == 1.5 and panels.load_declared_master(spark, declared.limit(0), path) is None
    with pytest.raises(panels.Refused):
        panels.load_declared_master(spark, declared.withColumn("licence", F.lit("")), path)
    for name, size in (("big one.pdf", 2000), ("small.pdf", 10)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert {(r["slug"], r["accepted"]) for r in panels.catalogue(spark, [path]).collect()} == {("big_one", True), ("small", False)}
    assert panels.lineage([("all", records), ("audits", records.where("stage = 'audit'"))]) == [{"step": "audits", "rows_before": 2, "rows_after": 1}]


def test_refusals(spark):
    p = panel(spark, prices(20, 2))
    hole = panel(spark, prices(20, 2), np.arange(40).reshape(20, 2) != 7)
    assert panels.fixed_universe(p).count() == 40
    for bad in (lambda: panels.fixed_universe(hole), lambda: panels.require_series(p, spark.createDataFrame([("B",)], "series_id string")), lambda: panels.add_source(p, p)):
        with pytest.raises(panels.Refused):
            bad()
    weights = spark.createDataFrame([("c", "A0", 1.0)], "config_id string, asset string, weight double")
    universe = spark.createDataFrame([("A0",), ("A1",)], "asset string")
    for bad in (weights, weights.withColumn("asset", F.lit("B"))):
        with pytest.raises(panels.Refused):
            portfolio.check_weights(bad, universe)


def test_bootstrap_draws_are_blocks_and_repeatable(spark):
    a = research.bootstrap_draws(spark, 200, 40).orderBy("rep", "pos").collect()
    b = research.bootstrap_draws(spark, 200, 40).repartition(7).orderBy("rep", "pos").collect()
    assert a == b
    steps = np.array([r["idx"] for r in a]).reshape(40, 200)
    follow = ((steps[:, 1:] - steps[:, :-1]) % 200 == 1).mean()
    assert abs(follow - 20 / 21) < 0.02 and abs(steps.mean() - 99.5) < 12


def test_metrics_by_hand(spark):
    d = [dt.date(2020, 1, 31), dt.date(2020, 2, 28), dt.date(2020, 4, 30), dt.date(2021, 1, 31)]
    nav = [1.0, 1.1, 0.99, 1.2]
    rows = [("c", x, v, None if i == 0 else v / nav[i - 1] - 1, 0.1, 0.0) for i, (x, v) in enumerate(zip(d, nav, strict=True))]
    m = metrics.metrics_table(spark.createDataFrame(rows, "config_id string, date date, nav double, ret double, turnover double, rf double").fillna(0.0, ["ret"])).first()
    assert m["max_drawdown"] == pytest.approx(0.1) and m["longest_underwater"] == (d[3] - d[2]).days and m["cvar"] is None
    assert m["cagr"] == pytest.approx(1.2 ** (365.25 / 366) - 1) and m["hit_rate"] == pytest.approx(2 / 13)


def test_master_rules(spark):
    raw = spark.createDataFrame([("2020-01-01", "a", "10", "Y"), ("2020-01-02", "a", "11", "no")], "Trade_Date string, ISIN string, `Adj Close` string, Member string")
    got = panels.load_master(raw.withColumnRenamed("Adj Close", "adj-close"))
    assert [r["in_universe"] for r in got.orderBy("date").collect()] == [True, False]
    with pytest.raises(panels.Refused):
        panels.load_master(raw.union(raw).withColumnRenamed("Adj Close", "adj_close"))
    with pytest.raises(Exception, match="boolean"):
        panels.load_master(raw.withColumn("Member", F.lit("maybe")).withColumnRenamed("Adj Close", "adj_close")).collect()
    with pytest.raises(Exception, match="date"):
        panels.load_master(raw.withColumn("Trade_Date", F.lit("soon")).withColumnRenamed("Adj Close", "adj_close")).collect()


def test_freeze_detects_a_change(spark, tmp_path):
    p = panel(spark, prices(30, 2))
    record = panels.freeze(p, f"file://{tmp_path}/s", source="test")
    assert record["rows"] == 60 and panels.verify(spark, f"file://{tmp_path}/s")
    assert panels.panel_hash(p) == panels.panel_hash(p.repartition(5))
    assert panels.panel_hash(p) != panels.panel_hash(p.withColumn("value", F.when(F.col("series_id") == "A0", F.col("value") + 1e-9).otherwise(F.col("value"))))


def test_evidence_on_phrases(spark):
    text = "We find results. The portfolio is rebalanced monthly with 10 bps costs.\nTable 1: Results\nReturn Volatility Sharpe\nEqual weight 10.4% 9.3% 0.91\nTilted book 11.0% (2.0%) 0.95\nSharpe ratio of 0.91 using CRSP"
    pages = spark.createDataFrame([("d", 0, text), ("d", 1, "Equal weight 10.5% 9.3% 0.91\nTilted book 11.0% 9.9% 0.95"), ("r", 0, "nruter evitalumuC 10 bps"), ("n", 0, None)], "doc_id string, page int, text string")
    hits = {(r["kind"], r["value"]) for r in evidence.scan(pages).collect()}
    assert {("rebalance", "monthly"), ("cost_bps", "10"), ("sharpe", "0.91"), ("data_source", "CRSP")} <= hits
    tables = evidence.recover_tables(pages).orderBy("page").collect()
    assert len(tables) == 2 and tables[0]["caption"].startswith("Table 1") and tables[0]["header"].startswith("Return")
    assert [list(x["numbers"]) for x in tables[0]["rows"]] == [[pytest.approx(0.104), pytest.approx(0.093), 0.91], [pytest.approx(0.11), pytest.approx(-0.02), 0.95]]
    targets = evidence.propose_targets(evidence.recover_tables(pages)).collect()
    assert ("Equal weight", "cagr") in {(r["portfolio"], r["metric"]) for r in targets}


def test_gates_show_what_is_missing(spark):
    cards = spark.createDataFrame([("a",), ("b",)], "card_id string")
    evidence_ = spark.createDataFrame([("a", k, v) for k, v in (("deflated_sharpe", 0.99), ("oos_min_sharpe", 0.5), ("bootstrap_p", 0.01), ("alpha_t_hac", -2.5), ("mandate_violations", 0.0))], "card_id string, key string, value double")
    criteria = rules.gate_b(evidence_, cards)
    assert criteria.count() == 2 * len(rules.GATE_B)
    out = {r["card_id"]: r for r in rules.gate_results(criteria).collect()}
    assert out["a"]["passed"] and not out["b"]["passed"] and len(out["a"]["warnings"]) == 3
    shown = {r["key"]: r["shown"] for r in criteria.where("card_id = 'b'").collect()}
    assert shown["alpha_t_hac"] == "NOT COMPUTED" and shown["best_delta_ir"] == "NO COMPARISON"


def test_card_rules(spark):
    schema = "card_id string, paper struct<id:string,title:string>, intent struct<mode:string,parent_card:string,broken_assumptions:array<string>>, universe struct<assets:array<string>>, costs struct<spread_bps:double>, signal struct<lag_days:int>, weights map<string,double>, n_configs_tried int, ambiguities array<struct<field:string,confidence:string,material:boolean,resolution:string>>, replication_targets array<struct<metric:string,tolerance:double>>"
    good = ("g", ("p", "t"), ("replication", None, None), (["a"],), (10.0,), (1,), {"a": 1.0}, 1, None, None)
    bad = ("b", ("p", ""), ("adaptation", None, []), ([],), (-1.0,), (1,), {"a": 1.5, "b": -0.1}, 0, [("x", "sure", True, "")], [("cagr", None)])
    got = {r["card_id"]: r["errors"] for r in rules.card_errors(spark.createDataFrame([good, bad], schema)).collect()}
    assert got["g"] == [] and len(got["b"]) >= 9


def test_library_self_exclusion(spark):
    lib = spark.createDataFrame([("1", "mom_a", "f1", {"m": 0.82, "q": 0.11, "v": -0.06}), ("2", "mom_b", "f2", {"m": 0.8364, "q": 0.1122, "v": -0.0612}), ("3", "low", "f3", {"m": -0.1, "q": 0.1, "v": 0.9}), ("4", "one", "f4", {"m": 1.0})], "entry_id string, card_id string, card_fingerprint string, factor_fingerprint map<string,double>")
    found = {(r["query_id"], r["entry_id"]) for r in library.similar(lib, lib, 0.95).collect()}
    assert found == {("1", "2"), ("2", "1")}
    assert {r["query_id"]: r["total"] for r in library.trial_budget(lib, lib, prefix=4).collect()} == {"1": 1, "2": 1, "3": 0, "4": 0}


def _library_rows():
    rng = random.Random(3)
    prints = [{f: (None if rng.random() < 0.05 else round(rng.uniform(-1, 1), 1)) for f in rng.sample("abcde", rng.randrange(6))} for _ in range(150)]
    prints += [dict(prints[0]) for _ in range(30)] + [None, {}]
    return [(str(i), f"card{i % 3}", None if i == 7 else f"c{i % 11}" if i < 100 else "often", m) for i, m in enumerate(prints)]


def _alike(rows, threshold):
    out = {}
    for qid, _, _, q in rows:
        for eid, _, _, e in rows:
            both = [f for f in q or {} if (e or {}).get(f) is not None and q[f] is not None]
            norm = sum(q[f] ** 2 for f in both) * sum(e[f] ** 2 for f in both) if both else 0
            if qid != eid and len(both) >= max(2, len(q or {}) // 2) and norm > 0:
                cosine = sum(q[f] * e[f] for f in both) / norm**0.5
                if cosine >= threshold:
                    out[qid, eid] = (cosine, len(both))
    return out


def test_library_tiles_find_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(library, "QUERIES", 40)
    monkeypatch.setattr(library, "ENTRIES", 16)
    rows = _library_rows()
    lib = spark.createDataFrame(rows, "entry_id string, card_id string, card_fingerprint string, factor_fingerprint map<string,double>")
    for threshold in (0.9001, 0.5001):
        want = _alike(rows, threshold)
        found = library.similar(lib, lib, threshold).collect()
        assert len(found) == len(want) and {(r["query_id"], r["entry_id"]): r["shared"] for r in found} == {k: v[1] for k, v in want.items()}
        first = {}
        for (q, e), (cosine, _) in want.items():
            first.setdefault(q, []).append((-round(cosine, 9), e))
        best = library.top_similar(library.similar(lib, lib, threshold, best=3), 3).collect()
        assert sorted((r["query_id"], r["place"], r["entry_id"]) for r in best) == sorted((q, i + 1, e) for q, x in first.items() for i, (_, e) in enumerate(sorted(x)[:3]))
        config = {r[0]: r[2] for r in rows}
        met = library.similar_configurations(lib, lib, threshold).collect()
        assert sorted(map(tuple, met)) == sorted({(q, config[e]) for q, e in want if config[e] is not None})
    assert library.similar(lib.limit(0), lib).count() == library.similar(lib, lib.limit(0)).count() == library.similar_configurations(lib, lib.limit(0)).count() == 0


def test_library_pairs_leave_a_tile_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(library, "_tiled", lambda queries, entries, spread, made, *_: made)
    fine = [{"key": "m", "value": 1.0}, {"key": "v", "value": 0.5}]
    rows = pa.table({"asks": [True] * 600 + [False] * 2000, "id": [str(i) for i in range(2600)], "f": [fine] * 2600})
    sizes = [b.num_rows for b in library.similar(None, None)(library._Tile(iter(rows.to_batches()), ["id"]))]
    assert sum(sizes) == 600 * 2000 and max(sizes) <= library.CELLS
    assert sum(b.num_rows for b in library.similar(None, None, best=10)(library._Tile(iter(rows.to_batches()), ["id"]))) == 6000


def test_library_writes_a_fingerprint_once_for_all_its_tiles(spark, monkeypatch):
    monkeypatch.setattr(library, "QUERIES", 40)
    monkeypatch.setattr(library, "ENTRIES", 8)
    rows = _library_rows()
    lib = panels.settled(spark.createDataFrame(rows, "entry_id string, card_id string, card_fingerprint string, factor_fingerprint map<string,double>"))
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    assert len(library.similar(lib, lib, 0.9001).collect()) == len(_alike(rows, 0.9001))
    assert written() - before < 2.5 * len(rows)  # five parts of queries, 23 of entries


def test_library_compares_maps_that_hold_no_null_with_others(spark):
    lib = spark.createDataFrame([("1", {"m": 1.0, "v": 0.5, "q": None}), ("2", {"m": 1.0, "v": 0.4})], "entry_id string, factor_fingerprint map<string,double>")
    asked = spark.range(3, 4).select(F.col("id").cast("string").alias("entry_id"), F.create_map(F.lit("m"), F.lit(2.0), F.lit("v"), F.lit(1.0)).alias("factor_fingerprint"))
    assert {(r["query_id"], r["entry_id"], r["shared"]) for r in library.similar(asked, lib).collect()} == {("3", "1", 2), ("3", "2", 2)}


def test_reconcile_treats_null_as_equal(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.5)], "k int, v double")
    assert checks.reconcile(a, a, ["k"], ["v"]).first()["agrees"] and checks.reconcile(a, b, ["k"], ["v"]).first()["worst"] == 0.5
