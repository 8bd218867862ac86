"""Target weights and portfolio accounting as table operators.

Between two rebalances a portfolio is a buy-and-hold: an asset's value is its weight times the
product of its returns, until the day it loses eligibility; then it is sold and accrues cash.  So
daily paths are cumulative products within segments, costs need only the drifted weights at the end
of the segment before, and all configs run in one plan, a group each.

Tables: ``targets(config_id, date, asset, weight)``, ``returns(asset, date, ret, eligible)``,
``cash(date, rf)``, ``configs(config_id, spread_bps, ...)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import ANNUAL, in_order, so_far
from ledgerline.sources.panels import calendar, on_days, refuse

# -- targets ------------------------------------------------------------------------------


def check_weights(weights: DataFrame, universe: DataFrame) -> DataFrame:
    """Weights (config_id, asset, weight) for known assets; unknown and missing names are refused."""
    refuse(weights.join(universe, "asset", "left_anti"), "weights for unknown assets")
    grid = weights.select("config_id").distinct().crossJoin(universe.select("asset").distinct())  # as large as the weights have to be
    refuse(grid.join(weights, ["config_id", "asset"], "left_anti"), "assets without a weight")
    return weights


def resolve_weights(spec: DataFrame, universe: DataFrame) -> DataFrame:
    """(config_id, asset, weight) of specs (config_id, equal boolean, weights map<string,double>) over ``universe(asset)``.

    An equal spec gives 1/n to every asset; a map has to name all of them and no other.
    """
    n = universe.agg(F.countDistinct("asset").alias("n"))
    flat = spec.where("equal").select("config_id").crossJoin(universe.select("asset").distinct()).crossJoin(F.broadcast(n)).select("config_id", "asset", (1 / F.col("n")).alias("weight"))  # n is one row
    stated = spec.where("not equal").select("config_id", F.explode("weights").alias("asset", "weight"))
    return flat.unionByName(check_weights(stated, universe))


def after_warmup(dates: DataFrame, days: DataFrame, warmup: int) -> DataFrame:
    """The rebalances of (config_id, date) that have ``warmup`` trading days of ``days`` or more before them."""
    return dates.join(calendar(days).where(F.col("pos") >= warmup).select("date"), "date", "left_semi")


def fixed_weight(dates: DataFrame, weights: DataFrame) -> DataFrame:
    """Stated weights at every rebalance of (config_id, date)."""
    return dates.join(weights, "config_id").select("config_id", "date", "asset", "weight")


def equal_weight(dates: DataFrame, eligible: DataFrame) -> DataFrame:
    """1/n over what is eligible on the day: ``eligible(date, asset)``."""
    day = dates.join(eligible, "date")
    return day.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("config_id", "date"))).select("config_id", "date", "asset", "weight")


def scale_to_vol(targets: DataFrame, vol: DataFrame, target_vol: float, most: float = 1.0) -> DataFrame:
    """Weights times least(most, target / vol of the day); a vol that is not positive scales nothing, a null one skips the day."""
    scaled = targets.join(vol.select("date", "vol"), "date").where("vol is not null")
    factor = F.when(F.col("vol") > 0, F.least(F.lit(most), target_vol / F.col("vol"))).otherwise(1.0)
    return scaled.withColumn("weight", F.col("weight") * factor).select("config_id", "date", "asset", "weight")


def target_variance(targets: DataFrame, cov: DataFrame) -> DataFrame:
    """(config_id, date, vol) of the targets under (date, asset_i, asset_j, cov), i <= j."""
    both = cov.unionByName(cov.where("asset_i != asset_j").select("date", F.col("asset_j").alias("asset_i"), F.col("asset_i").alias("asset_j"), "cov"))
    a = targets.select("config_id", "date", F.col("asset").alias("asset_i"), F.col("weight").alias("w_i"))
    b = targets.select("config_id", "date", F.col("asset").alias("asset_j"), F.col("weight").alias("w_j"))
    return a.join(both, ["date", "asset_i"]).join(b, ["config_id", "date", "asset_j"]).groupBy("config_id", "date").agg(F.sqrt(F.sum(F.col("w_i") * F.col("w_j") * F.col("cov"))).alias("vol"))


def inverse_vol(dates: DataFrame, vols: DataFrame) -> DataFrame:
    """1/vol, normalised; a day on which any asset's vol is missing or zero keeps its holdings."""
    day = Window.partitionBy("config_id", "date")
    rows = dates.join(vols.select("date", "asset", "vol"), "date").withColumn("bad", F.max((F.col("vol").isNull() | ~(F.col("vol") > 0)).cast("int")).over(day)).where("bad = 0")
    return rows.withColumn("weight", (1 / F.col("vol")) / F.sum(1 / F.col("vol")).over(day)).select("config_id", "date", "asset", "weight")


def ts_momentum(dates: DataFrame, signals: DataFrame, weighting: str = "inverse_vol", least: int = 1) -> DataFrame:
    """Assets with positive momentum, weighted by 1/vol or alike; under ``least`` of them, all cash.

    ``signals(date, asset, mom, vol)``; a day with a missing momentum or vol keeps its holdings.
    A day in cash has rows of weight 0.
    """
    day = Window.partitionBy("config_id", "date")
    rows = dates.join(signals, "date").withColumn("bad", F.max((F.col("mom").isNull() | F.col("vol").isNull() | ~(F.col("vol") > 0)).cast("int")).over(day)).where("bad = 0")
    up = F.col("mom") > 0
    raw = F.when(up, 1 / F.col("vol") if weighting == "inverse_vol" else F.lit(1.0)).otherwise(0.0)
    rows = rows.withColumns({"raw": raw, "n_up": F.sum(up.cast("int")).over(day)})
    weight = F.when((F.col("n_up") >= least) & (F.sum("raw").over(day) > 0), F.col("raw") / F.sum("raw").over(day)).otherwise(0.0)
    return rows.withColumn("weight", weight).select("config_id", "date", "asset", "weight")


def cross_sectional(dates: DataFrame, scores: DataFrame) -> DataFrame:
    """The best of the eligible by score.

    ``dates(config_id, date, n_hold, quantile, min_names, ascending, weighting, max_weight)``: the
    number held is n_hold, else max(1, round(quantile * n)) with halves to even; under min_names
    eligible, the day keeps its holdings.  Ties go by asset.  ``weighting`` is equal, signal (score
    above the least held, equal if all are alike) or inverse_vol (equal if a vol is missing);
    weights above max_weight are cut once and the rest is renormalised.
    ``scores(date, asset, score, vol, eligible)``.
    """
    day = Window.partitionBy("config_id", "date")
    rows = dates.join(scores.where("eligible and score is not null and not isnan(score)"), "date").withColumn("n", F.count("*").over(day)).where("n >= min_names")
    by = F.when(F.col("ascending"), F.col("score")).otherwise(-F.col("score"))
    hold = F.coalesce(F.col("n_hold"), F.greatest(F.lit(1), F.bround(F.col("quantile") * F.col("n")).cast("int")))
    held = rows.withColumn("k", F.row_number().over(day.orderBy(by, "asset"))).where(F.col("k") <= hold)
    lift = F.abs(F.col("score") - F.when(F.col("ascending"), F.max("score").over(day)).otherwise(F.min("score").over(day)))
    safe = F.min((F.coalesce(F.col("vol"), F.lit(0.0)) > 0).cast("int")).over(day) == 1
    raw = F.when((F.col("weighting") == "signal") & (F.sum(lift).over(day) > 0), lift).when((F.col("weighting") == "inverse_vol") & safe, 1 / F.col("vol")).otherwise(1.0)
    held = held.withColumn("raw", raw).withColumn("w", F.col("raw") / F.sum("raw").over(day))
    held = held.withColumn("w", F.least("w", F.coalesce("max_weight", F.lit(1.0))))
    return held.withColumn("weight", F.col("w") / F.sum("w").over(day)).select("config_id", "date", "asset", "weight")


def solve_min_variance(c: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Long-only weights of least variance, by an active set over the least binding asset."""
    n = len(c)
    active = np.ones(n, bool)
    for _ in range(min(rounds, 4 * n)):
        idx = np.flatnonzero(active)
        w = np.zeros(n)
        w[idx] = np.linalg.solve(c[np.ix_(idx, idx)] + 1e-14 * np.eye(len(idx)), np.ones(len(idx)))
        w /= w.sum()
        if (w[idx] < -1e-12).any():
            active[idx[np.argmin(w[idx])]] = False
            continue
        gradient = c @ w
        out = np.flatnonzero(~active)
        if len(out) and gradient[out].min() < gradient[idx].min() - 1e-12:
            active[out[np.argmin(gradient[out])]] = True
            continue
        break
    return np.maximum(w, 0) / np.maximum(w, 0).sum()


def solve_equal_risk(c: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weights of equal risk shares, by cyclical updates of each coordinate."""
    n = len(c)
    w = 1 / np.sqrt(np.diag(c))
    for _ in range(rounds):
        before = w.copy()
        for i in range(n):
            rest = c[i] @ w - c[i, i] * w[i]
            w[i] = (-rest + np.sqrt(rest * rest + 4 * c[i, i] / n)) / (2 * c[i, i])
        if np.abs(w - before).max() < 1e-13 * np.abs(w).max():
            break
    return w / w.sum()


_WEIGHTS_ARROW = pa.schema([("config_id", pa.string()), ("date", pa.date32()), ("asset", pa.string()), ("weight", pa.float64())])


def solved_weights(tiles: DataFrame, method: str) -> DataFrame:
    """Targets ``min_variance`` or ``equal_risk`` from covariance tiles (config_id, date, i, j, names_i, names_j, tile), i <= j.

    A matrix per (config, day) is put together from its tiles and solved; days whose matrix cannot
    be solved keep their holdings.
    """
    solve = {"min_variance": solve_min_variance, "equal_risk": solve_equal_risk}[method]

    def work(table: pa.Table) -> pa.Table:
        parts = {(i, j): (a, b, np.array(x).reshape(len(a), len(b))) for i, j, a, b, x in zip(*(table[c].to_pylist() for c in ("i", "j", "names_i", "names_j", "tile")), strict=True)}
        names = {i: a for (i, _), (a, _, _) in parts.items()}
        order = sorted(names)
        try:
            w = solve(np.block([[parts[i, j][2] if i <= j else parts[j, i][2].T for j in order] for i in order]))
        except (np.linalg.LinAlgError, ZeroDivisionError):
            return _WEIGHTS_ARROW.empty_table()
        if not np.isfinite(w).all():
            return _WEIGHTS_ARROW.empty_table()
        assets = [a for i in order for a in names[i]]
        same = lambda c, kind: pa.array([table[c][0].as_py()] * len(w), kind)
        return pa.Table.from_arrays([same("config_id", pa.string()), same("date", pa.date32()), pa.array(assets), pa.array(w)], schema=_WEIGHTS_ARROW)

    return tiles.groupBy("config_id", "date").applyInArrow(work, "config_id string, date date, asset string, weight double")


def position_policy(targets: DataFrame, allow_cash: bool = True) -> DataFrame:
    """No shorts; without cash fully invested (all zero: 1/n); gross exposure at most 1."""
    day = Window.partitionBy("config_id", "date")
    w = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    out = targets.withColumn("w", w).withColumns({"gross": F.sum("w").over(day), "n": F.count("*").over(day)})
    invested = F.when(F.col("gross") > 0, F.col("w") / F.col("gross")).otherwise(1.0 / F.col("n"))
    weight = F.when(F.col("gross") > 1, F.col("w") / F.col("gross")).otherwise(F.col("w")) if allow_cash else invested
    return out.select("config_id", "date", "asset", weight.alias("weight"))


# -- accounting ---------------------------------------------------------------------------


def asset_returns(panel: DataFrame) -> DataFrame:
    """(asset, date, ret, eligible, stale) from (series_id, date, value[, eligible]) on the full grid of days.

    A missing price is a return of 0 and stale; so is the return of the day after a gap.
    """
    grid = on_days(panel.select("series_id").distinct(), panel)  # the panel completed: series times trading days
    whole = grid.join(panel, ["series_id", "date"], "left")
    ret = F.col("value") / F.lag("value").over(in_order("series_id")) - 1
    eligible = F.coalesce("eligible", F.lit(False)) if "eligible" in panel.columns else F.col("value").isNotNull()
    return whole.select(F.col("series_id").alias("asset"), "date", F.coalesce(ret, F.lit(0.0)).alias("ret"), eligible.alias("eligible"), F.col("value").isNull().alias("stale"))


def _segments(days: DataFrame, targets: DataFrame) -> DataFrame:
    """(config_id, date, seg, reb): the rebalance strictly before each day, and whether it is one itself."""
    rebalances = targets.select("config_id", "date").distinct().withColumn("is_reb", F.lit(True))
    grid = on_days(targets.select("config_id").distinct(), days)  # configs times trading days: the size of the result
    marked = grid.join(rebalances, ["config_id", "date"], "left").withColumn("reb", F.coalesce("is_reb", F.lit(False)))
    before = Window.partitionBy("config_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return marked.select("config_id", "date", "reb", F.last(F.when(F.col("reb"), F.col("date")), ignorenulls=True).over(before).alias("seg"))


def run_path(weights: np.ndarray, at: np.ndarray, ret: np.ndarray, eligible: np.ndarray, stale: np.ndarray, rf: np.ndarray, half: float) -> dict[str, np.ndarray]:
    """The days of one run: ``weights`` (rebalances, assets) are set on the days ``at``; the other tables are (days, assets).

    Between two rebalances values are cumulative products; a sold asset's value accrues cash.
    """
    n = len(rf)
    out = {"growth": np.ones(n), "turnover": np.zeros(n), "cost": np.zeros(n), "cash_weight": np.ones(n), "forced_exits": np.zeros(n, np.int64), "stale_marks": np.zeros(n, np.int64)}
    old = np.zeros(weights.shape[1])
    for k, (start, w) in enumerate(zip(at, weights, strict=True)):
        traded = np.abs(w - old).sum()
        out["growth"][start] *= 1 - half * traded
        out["cost"][start] += half * traded
        out["turnover"][start] += traded / 2
        out["cash_weight"][start] = 1 - w.sum()
        days = slice(start + 1, (at[k + 1] if k + 1 < len(at) else n - 1) + 1)
        if days.stop <= days.start:
            break
        held, bank = np.flatnonzero(w), 1 + rf[days]
        gone = np.logical_or.accumulate(~eligible[days][:, held], axis=0)
        after = np.vstack([np.zeros((1, len(held)), bool), gone[:-1]])
        v = w[held] * np.cumprod(np.where(after, bank[:, None], 1 + ret[days][:, held]), axis=0)
        s = (1 - w.sum()) * np.cumprod(bank) + v.sum(1)
        sold = np.where(gone & ~after, v, 0).sum(1) / s
        out["growth"][days] *= s / np.append(1.0, s[:-1]) * (1 - half * sold)
        out["cost"][days] += half * sold
        out["turnover"][days] += sold / 2
        out["cash_weight"][days] = 1 - np.where(gone, 0, v).sum(1) / s
        out["forced_exits"][days] = (gone & ~after).sum(1)
        out["stale_marks"][days] = (stale[days][:, held] & ~gone).sum(1)
        old = np.zeros(len(w))
        old[held] = np.where(gone[-1], 0, v[-1] / s[-1])
    return out


_RUN = "config_id string, date date, nav double, ret double, turnover double, cost double, cash_weight double, forced_exits long, stale_marks long"
_RUN_ARROW = pa.schema(
    [("config_id", pa.string()), ("date", pa.date32()), *[(c, pa.float64()) for c in ("nav", "ret", "turnover", "cost", "cash_weight")], ("forced_exits", pa.int64()), ("stale_marks", pa.int64())]
)


def _run_of(assets: pa.Table, config: pa.Table) -> pa.Table:
    """One config's assets, with their targets and paths, and its row of trading days, cash rates and spread."""
    if not assets.num_rows or not config.num_rows:
        return _RUN_ARROW.empty_table()
    days = config["days"].combine_chunks().flatten()
    dates, rf, half = days.field("date").cast(pa.int32()).to_numpy(), days.field("rf").to_numpy(), config["half"][0].as_py()
    if (rate := config["cash_rate"][0].as_py()) is not None:
        rf = np.full(len(rf), (1 + rate) ** (1 / ANNUAL) - 1)
    n, k = len(dates), assets.num_rows
    ret, eligible, stale = np.zeros((n, k)), np.zeros((n, k), bool), np.ones((n, k), bool)
    asked = []
    for j, (path, targets) in enumerate(zip(assets["path"], assets["targets"], strict=True)):
        if path.values is not None and len(path.values):
            on = np.searchsorted(dates, path.values.field("date").cast(pa.int32()).to_numpy())
            ret[on, j] = path.values.field("ret").fill_null(0.0).to_numpy()
            eligible[on, j], stale[on, j] = (path.values.field(c).fill_null(c == "stale").to_numpy(zero_copy_only=False) for c in ("eligible", "stale"))
        day, weight = targets.values.field("date").cast(pa.int32()).to_numpy(), targets.values.field("weight").fill_null(0.0).to_numpy()
        on = np.minimum(np.searchsorted(dates, day), n - 1)
        asked.append((on[dates[on] == day], np.full((dates[on] == day).sum(), j), weight[dates[on] == day]))
    on, j, weight = (np.concatenate(x) for x in zip(*asked, strict=True))
    at, place = np.unique(on, return_inverse=True)
    weights = np.zeros((len(at), k))
    np.add.at(weights, (place, j), weight)
    path = run_path(weights, at, ret, eligible, stale, rf, half)
    growth = path.pop("growth")
    columns = {"config_id": pa.array([config["run"][0].as_py()] * n), "date": pa.array(dates, pa.int32()).cast(pa.date32()), "nav": np.cumprod(growth), "ret": growth - 1, **path}
    return pa.Table.from_arrays([pa.array(columns[c]) for c in _RUN_ARROW.names], schema=_RUN_ARROW)


def account(targets: DataFrame, returns: DataFrame, cash: DataFrame, configs: DataFrame) -> DataFrame:
    """runs_daily(config_id, date, nav, ret, turnover, cost, cash_weight, forced_exits, stale_marks).

    NAV is 1 until the first rebalance.  Each day drifts first, then sells what lost eligibility at
    half the spread, then trades to the day's target: cost is half the spread times the sum of
    absolute weight changes, turnover half that sum; a day with both records the sum of both.  A day
    without a row of an asset is a day on which it is not eligible; targets on days without any
    return are not traded.  ``configs`` may carry ``cash_rate``, a yearly rate that replaces ``cash``.

    One grouped pass: an asset's path and a config's targets become arrays, and a config meets the
    paths of its assets in one group, whose size is its assets times trading days.
    """
    days = returns.select("date").distinct().join(cash.select("date", "rf"), "date", "left").agg(F.sort_array(F.collect_list(F.struct("date", F.coalesce("rf", F.lit(0.0)).alias("rf")))).alias("days"))
    paths = returns.groupBy("asset").agg(F.sort_array(F.collect_list(F.struct("date", "ret", "eligible", "stale"))).alias("path"))
    held = targets.groupBy("config_id", "asset").agg(F.sort_array(F.collect_list(F.struct("date", "weight"))).alias("targets"))
    rate = F.col("cash_rate").cast("double") if "cash_rate" in configs.columns else F.lit(None).cast("double")
    each = configs.select(F.col("config_id").alias("run"), (F.col("spread_bps") / 1e4 / 2).alias("half"), rate.alias("cash_rate")).crossJoin(F.broadcast(days))  # one row: the calendar
    return held.join(paths, "asset", "left").groupBy("config_id").cogroup(each.groupBy("run")).applyInArrow(_run_of, _RUN)


def units_nav(targets: DataFrame, panel: DataFrame, cash: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_id, date, nav) by units of each asset and a cash balance: the second formulation.

    For panels without gaps or exits: units are fixed per segment from the NAV at its start, which
    the product of segment growths gives.  It has to equal :func:`account`.
    """
    seg = _segments(panel, targets)
    price = panel.select(F.col("series_id").alias("asset"), "date", "value")
    units = targets.join(price, ["asset", "date"]).select("config_id", F.col("date").alias("seg"), "asset", "weight", (F.col("weight") / F.col("value")).alias("units"))
    rows = seg.where("seg is not null").join(units, ["config_id", "seg"]).join(price, ["asset", "date"])
    rows = rows.groupBy("config_id", "date", "seg", "reb").agg(F.sum(F.col("units") * F.col("value")).alias("invested"), F.sum("weight").alias("w"))
    rates = cash.withColumn("bank", F.product(1 + F.col("rf")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    start = rates.select(F.col("date").alias("seg"), F.col("bank").alias("bank0"))
    s = rows.join(rates.select("date", "bank"), "date").join(start, "seg").withColumn("s", F.col("invested") + (1 - F.col("w")) * F.col("bank") / F.col("bank0"))
    old = rows.select("config_id", "date", "seg", "reb").where("reb").join(units, ["config_id", "seg"]).join(price, ["asset", "date"]).join(s.select("config_id", "date", "s"), ["config_id", "date"])
    old = old.select("config_id", "date", "asset", (F.col("units") * F.col("value") / F.col("s")).alias("old"))
    moved = targets.join(old, ["config_id", "date", "asset"], "full").groupBy("config_id", "date").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("traded"))
    kept = moved.join(configs, "config_id").select("config_id", "date", (1 - F.col("spread_bps") / 1e4 / 2 * F.col("traded")).alias("keep"))
    ends = s.where("reb").select("config_id", "date", "s").join(kept, ["config_id", "date"], "right").withColumn("step", F.coalesce("s", F.lit(1.0)) * F.col("keep"))
    base = ends.select("config_id", F.col("date").alias("seg"), F.product("step").over(so_far("config_id")).alias("base"))
    inside = s.where("not reb").join(base, ["config_id", "seg"]).select("config_id", "date", (F.col("base") * F.col("s")).alias("nav"))
    at = base.select("config_id", F.col("seg").alias("date"), F.col("base").alias("nav"))
    flat = seg.where("seg is null and not reb").select("config_id", "date", F.lit(1.0).alias("nav"))
    return inside.unionByName(at).unionByName(flat)


def buy_and_hold(panel: DataFrame) -> DataFrame:
    """``nav``: each series over its first value."""
    first = F.first("value", ignorenulls=True).over(so_far("series_id"))
    return panel.withColumn("nav", F.col("value") / first)


def run_metadata(daily: DataFrame, targets: DataFrame, dates: DataFrame | None = None, eligible: DataFrame | None = None) -> DataFrame:
    """Per config: rebalances, mean names held, days with cash, forced exits, stale marks.

    With the scheduled ``dates(config_id, date)``: ``skipped``, those without targets; with
    ``eligible(date, asset)`` too: ``mean_eligible``, how many could be held on a scheduled day.
    """
    n = targets.groupBy("config_id").agg(F.countDistinct("date").alias("n_rebalances"), (F.sum((F.col("weight") > 0).cast("int")) / F.countDistinct("date")).alias("mean_names"))
    paths = daily.groupBy("config_id").agg(F.sum((F.col("cash_weight") > 1e-9).cast("int")).alias("days_with_cash"), F.sum("forced_exits").alias("forced_exits"), F.sum("stale_marks").alias("stale_marks"))
    out = n.join(paths, "config_id")
    if dates is None:
        return out
    held = targets.select("config_id", "date").distinct().withColumn("held", F.lit(1))
    asked = dates.select("config_id", "date").join(held, ["config_id", "date"], "left")
    more = [(F.count("*") - F.count("held")).alias("skipped")]
    if eligible is not None:
        asked = asked.join(eligible.groupBy("date").agg(F.countDistinct("asset").alias("n_eligible")), "date", "left")
        more.append(F.avg(F.coalesce("n_eligible", F.lit(0))).alias("mean_eligible"))
    return out.join(asked.groupBy("config_id").agg(*more), "config_id")


def fan_out(cards: DataFrame) -> DataFrame:
    """configs(config_id, role, template, spread_bps, allow_cash) of each card.

    A card runs as primary; as mandate where its mandate's cash stance differs; with each of its
    ``benchmarks array<struct<name, template>>``; and with each of its ``references``, if it has such.
    """
    cols = lambda role, template, cash: [F.concat_ws(":", "card_id", role).alias("config_id"), "card_id", role.alias("role"), template.alias("template"), "spread_bps", cash.alias("allow_cash")]
    primary = cards.select(*cols(F.lit("primary"), F.col("template"), F.col("allow_cash")))
    mandate = cards.where("mandate_allow_cash is not null and mandate_allow_cash != allow_cash").select(*cols(F.lit("mandate"), F.col("template"), F.col("mandate_allow_cash")))
    out = primary.unionByName(mandate)
    for kind in ("benchmark", "reference"):
        if f"{kind}s" in cards.columns:
            rivals = cards.select("*", F.explode(f"{kind}s").alias("b")).select(*cols(F.concat(F.lit(f"{kind}_"), F.col("b.name")), F.col("b.template"), F.col("allow_cash")))
            out = out.unionByName(rivals)
    return out


def configs_run(configs: DataFrame) -> DataFrame:
    """(card_id, n_configs, own, rivals): how many configs a card ran as, its own (primary and mandate) and others."""
    own = F.col("role").isin("primary", "mandate").cast("int")
    return configs.groupBy("card_id").agg(F.countDistinct("config_id").alias("n_configs"), F.sum(own).alias("own"), F.sum(1 - own).alias("rivals"))


def align_runs(daily: DataFrame, targets: DataFrame) -> DataFrame:
    """Runs from the latest first rebalance on, NAV 1 there, returns made anew (first 0)."""
    first = targets.groupBy("config_id").agg(F.min("date").alias("d")).agg(F.max("d").alias("start"))
    cut = daily.crossJoin(F.broadcast(first)).where("date >= start").drop("start")  # one row
    nav = F.col("nav") / F.first("nav").over(so_far("config_id"))
    rebased = cut.withColumn("nav", nav)
    return rebased.withColumn("ret", F.coalesce(F.col("nav") / F.lag("nav").over(in_order("config_id")) - 1, F.lit(0.0)))
