"""Causal signals on a long panel: every window ends at its own row, nulls fill no window.

All time-series signals of one panel share one shuffle on ``series_id``; cross-sectional ones
share one on ``date``.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import ANNUAL, full, in_order, trailing

KEY = "series_id"


def simple_returns(panel: DataFrame) -> DataFrame:
    """``ret``: the close-to-close return; null next to a missing price, nothing is filled forward."""
    return panel.withColumn("ret", F.col("value") / F.lag("value").over(in_order(KEY)) - 1)


def trailing_vol(df: DataFrame, window: int, column: str = "ret", out: str = "vol", annual: int = ANNUAL) -> DataFrame:
    """Annualised sample deviation over full windows."""
    w = trailing(window, KEY)
    return df.withColumn(out, full(F.stddev_samp(column).over(w) * math.sqrt(annual), F.col(column), w, window))


def mix_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """(date, ret) of a fixed mix; null on days on which a weighted series has no return."""
    legs = returns.join(weights, KEY)
    n = weights.agg(F.count("*").alias("n"))
    daily = legs.groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("r"), F.count("ret").alias("k"))
    return daily.crossJoin(F.broadcast(n)).select("date", F.when(F.col("k") == F.col("n"), F.col("r")).alias("ret"))  # n is one row


def portfolio_trailing_vol(returns: DataFrame, weights: DataFrame, window: int) -> DataFrame:
    """(date, vol) of the fixed mix's own returns."""
    return trailing_vol(mix_returns(returns, weights).withColumn(KEY, F.lit("mix")), window).select("date", "ret", "vol")


def ewma_return(df: DataFrame, halflife: int, column: str = "ret", scale: float = 1.0, out: str = "ewma") -> DataFrame:
    """The exponentially weighted mean with finite-sample weights, null before ``halflife`` values.

    With q = 2**(-1/halflife) the mean is sum(x q**-n) / sum(q**-n) over the places n so far, n
    being taken from the start of its own run of 500 half-lives so that the powers stay in range.
    """
    every = in_order(KEY).rowsBetween(Window.unboundedPreceding, 0)
    run = 500 * halflife
    placed = df.withColumn("_n", F.row_number().over(in_order(KEY))).withColumn("_r", F.floor(F.col("_n") / run))
    here = Window.partitionBy(KEY, "_r").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    power = F.pow(F.lit(2.0), (F.col("_n") - F.col("_r") * run) / F.lit(float(halflife)))
    weight = F.when(F.col(column).isNotNull(), power)
    sums = placed.withColumns({"_s": F.sum(F.col(column) * power).over(here), "_w": F.sum(weight).over(here), "_k": F.count(column).over(every)})
    # what came before a run has a weight below 2**-500 against it once the run has begun
    ends = sums.groupBy(KEY, (F.col("_r") + 1).alias("_r")).agg(F.max_by("_s", "_n").alias("_s0"), F.max_by("_w", "_n").alias("_w0"))
    fade = F.pow(F.lit(2.0), F.lit(-float(run) / halflife))
    both = sums.join(ends, [KEY, "_r"], "left")
    mean = (F.coalesce("_s", F.lit(0.0)) + fade * F.coalesce("_s0", F.lit(0.0))) / (F.coalesce("_w", F.lit(0.0)) + fade * F.coalesce("_w0", F.lit(0.0)))
    return both.withColumn(out, F.when(F.col("_k") >= halflife, mean * scale)).select(*df.columns, out)


#: Assets of a block of the covariance matrix, and days of one piece of the calendar.
BLOCK_ASSETS, PIECE_DAYS = 64, 1024
_TILE = "date date, i int, j int, names_i array<string>, names_j array<string>, tile array<double>"
_TILE_ARROW = pa.schema([("date", pa.date32()), ("i", pa.int32()), ("j", pa.int32()), ("names_i", pa.list_(pa.string())), ("names_j", pa.list_(pa.string())), ("tile", pa.list_(pa.float64()))])


def window_covariances(x: np.ndarray, y: np.ndarray, window: int, ends: np.ndarray) -> np.ndarray:
    """Sample covariances of the columns of x and y over the ``window`` rows up to each of ``ends``: differences of prefix sums."""
    fill = lambda v: np.nan_to_num(v - np.nan_to_num(np.nanmean(v, axis=0)))  # noqa: E731  (centred, so that the sums stay small)
    with np.errstate(invalid="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # a column without any value
        x, y = fill(x), fill(y)
    before = lambda v: np.concatenate([np.zeros((1, *v.shape[1:])), np.cumsum(v, axis=0)])
    over = lambda p: p[ends + 1] - p[ends + 1 - window]
    outer = over(before(x[:, :, None] * y[:, None, :]))
    return (outer - over(before(x))[:, :, None] * over(before(y))[:, None, :] / window) / (window - 1)


def covariance_tiles(returns: DataFrame, window: int, annual: int = ANNUAL, dates: DataFrame | None = None, block: int = BLOCK_ASSETS, piece: int = PIECE_DAYS) -> DataFrame:
    """(date, i, j, names_i, names_j, tile): the covariance of asset blocks i <= j, row by row, on days whose window has every return of every asset.

    Assets are dealt into blocks by name and days into pieces, each with the ``window`` - 1 days
    before it; a group holds two blocks over a piece.  ``dates`` keeps only some days.
    """
    piece = max(piece, window)
    names = returns.select(KEY).distinct().withColumn("block", ((F.row_number().over(Window.orderBy(KEY)) - 1) / block).cast("int"))  # one row an asset
    whole = returns.groupBy("date").agg(F.count("ret").alias("k")).crossJoin(F.broadcast(names.agg(F.count("*").alias("n_assets"), F.max("block").alias("last"))))  # one row
    in_days = Window.orderBy("date")  # one row a day
    days = whole.withColumns({"pos": F.row_number().over(in_days) - 1, "ok": F.sum((F.col("k") == F.col("n_assets")).cast("int")).over(in_days.rowsBetween(-(window - 1), 0)) == window})
    if dates is not None:
        days = days.join(dates.select("date").distinct().withColumn("asked", F.lit(True)), "date", "left").withColumn("ok", F.col("ok") & F.col("asked").isNotNull())
    own = (F.col("pos") / piece).cast("int")
    ahead = F.when(F.col("pos") % piece >= piece - (window - 1), own + 1).otherwise(own)
    days = days.select("date", "pos", "last", "ok", F.explode(F.array_distinct(F.array(own, ahead))).alias("piece"), own.alias("own"))
    rows = returns.select("date", KEY, "ret").join(F.broadcast(names), KEY).join(days, "date")  # names: a row an asset
    pairs = lambda first, second: F.struct(first.cast("int").alias("i"), second.cast("int").alias("j"))
    meets = F.concat(F.transform(F.sequence(F.col("block"), F.col("last")), lambda j: pairs(F.col("block"), j)), F.when(F.col("block") > 0, F.transform(F.sequence(F.lit(0), F.col("block") - 1), lambda i: pairs(i, F.col("block")))).otherwise(F.array().cast("array<struct<i:int,j:int>>")))
    dealt = rows.select("date", "pos", KEY, "ret", "block", "piece", (F.col("ok") & (F.col("own") == F.col("piece"))).alias("ok"), F.explode(meets).alias("m"))
    dealt = dealt.select("m.i", "m.j", "piece", "block", KEY, "date", "pos", "ret", "ok")

    def tile(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        blocks, pos = table["block"].to_numpy(), table["pos"].to_numpy()
        first = pos.min()
        names_of, sides = {}, {}
        for b in {i, j}:
            part = table.filter(pa.array(blocks == b))
            names_of[b], at = np.unique(part[KEY].to_numpy(), return_inverse=True)
            sides[b] = np.full((pos.max() - first + 1, len(names_of[b])), np.nan)
            sides[b][part["pos"].to_numpy() - first, at] = part["ret"].to_numpy()
        ok = table["ok"].to_numpy()
        ends, lead = np.unique(pos[ok], return_index=True)
        ends = ends - first
        if not len(ends):
            return _TILE_ARROW.empty_table()
        date = table["date"].combine_chunks().filter(pa.array(ok)).take(pa.array(lead))
        made = window_covariances(sides[i], sides[j], window, ends) * annual
        columns = [date, pa.array([i] * len(ends), pa.int32()), pa.array([j] * len(ends), pa.int32()), [names_of[i].tolist()] * len(ends), [names_of[j].tolist()] * len(ends), list(made.reshape(len(ends), -1))]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, _TILE_ARROW.types, strict=True)], schema=_TILE_ARROW)

    return dealt.groupBy("i", "j", "piece").applyInArrow(tile, _TILE)


def rolling_cov(returns: DataFrame, window: int, annual: int = ANNUAL, dates: DataFrame | None = None) -> DataFrame:
    """(date, asset_i, asset_j, cov) for i <= j over windows in which every asset has every return: :func:`covariance_tiles`, one row a pair.

    ``dates`` keeps only some days.
    """
    tiles = covariance_tiles(returns, window, annual, dates).select("date", "names_i", "names_j", F.posexplode("tile").alias("at", "cov"))
    width = F.size("names_j")
    pairs = tiles.select("date", F.element_at("names_i", F.floor(F.col("at") / width).cast("int") + 1).alias("asset_i"), F.element_at("names_j", F.col("at") % width + 1).alias("asset_j"), "cov")
    return pairs.where("asset_i <= asset_j")


def momentum(df: DataFrame, window: int, skip: int = 0, out: str = "mom") -> DataFrame:
    """Total return from ``skip + window`` rows ago to ``skip`` rows ago."""
    w = in_order(KEY)
    return df.withColumn(out, F.lag("value", skip).over(w) / F.lag("value", skip + window).over(w) - 1)


def vol_scaled_momentum(df: DataFrame, window: int, vol_window: int, skip: int = 0) -> DataFrame:
    """Momentum over trailing vol; null where the vol is zero."""
    both = trailing_vol(momentum(simple_returns(df), window, skip), vol_window)
    return both.withColumn("mom_vol", F.col("mom") / F.nullif("vol", F.lit(0.0)))


def zscore(df: DataFrame, window: int, column: str = "value", out: str = "z") -> DataFrame:
    w = trailing(window, KEY)
    z = (F.col(column) - F.avg(column).over(w)) / F.nullif(F.stddev_samp(column).over(w), F.lit(0.0))
    return df.withColumn(out, full(z, F.col(column), w, window))


def cross_sectional_rank(df: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """The percentile among the day's non-null values, ties at their mean."""
    day = Window.partitionBy("date")
    ties = F.count(column).over(Window.partitionBy("date", column))
    mean_rank = F.rank().over(day.orderBy(F.col(column).asc_nulls_last())) + (ties - 1) / 2
    return df.withColumn(out, F.when(F.col(column).isNotNull(), mean_rank / F.count(column).over(day)))


def vol_ratio(df: DataFrame, short: int, long: int, out: str = "vol_ratio") -> DataFrame:
    """The logarithm of short over long trailing vol."""
    both = trailing_vol(trailing_vol(df, short, out="_s"), long, out="_l")
    log = lambda c: F.ln(F.nullif(c, F.lit(0.0)))
    return both.withColumn(out, log("_s") - log("_l")).drop("_s", "_l")


def causal_shift(df: DataFrame, columns: list[str], lag: int = 1) -> DataFrame:
    """Columns as they were known 1 + lag rows before."""
    return df.withColumns({c: F.lag(c, 1 + lag).over(in_order(KEY)) for c in columns})


def lagged_eligibility(df: DataFrame, lag: int = 1) -> DataFrame:
    """``eligible``: a member 1 + lag rows ago, with a price today."""
    known = F.coalesce(F.lag("member", 1 + lag).over(in_order(KEY)), F.lit(False))
    return df.withColumn("eligible", known & F.col("value").isNotNull())


def rebalance_dates(days: DataFrame, frequency: str) -> DataFrame:
    """(date): the last traded day of each day, week (Monday to Sunday), month, quarter or year."""
    unit = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}[frequency]
    return days.groupBy(F.date_trunc(unit, "date").alias("_p")).agg(F.max("date").alias("date")).select("date")


def horizon_cash(rf: DataFrame, horizon: int = 21) -> DataFrame:
    """``rf_horizon``: the last ``horizon`` rates compounded, 0 before there are as many."""
    w = Window.orderBy("date").rowsBetween(-(horizon - 1), 0)  # the cash series, one row a day
    made = full(F.product(1 + F.col("rf")).over(w) - 1, F.col("rf"), w, horizon)
    return rf.withColumn("rf_horizon", F.coalesce(made, F.lit(0.0)))


def signal_bundle(panel: DataFrame, alpha: str, window: int = 60, halflife: int = 60, skip: int = 0) -> DataFrame:
    """Returns, vol and alpha by source: ``ewma``, ``momentum`` or ``none``."""
    base = trailing_vol(simple_returns(panel), window)
    if alpha == "ewma":
        return ewma_return(base, halflife, out="alpha")
    return momentum(base, window, skip, out="alpha") if alpha == "momentum" else base.withColumn("alpha", F.lit(None).cast("double"))


def signal_inputs(panel: DataFrame, weights: DataFrame, alpha: str, window: int = 60, halflife: int = 60, skip: int = 0, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """What an allocator reads: (date, series_id, value, ret, vol, alpha, mix_vol), and the covariance tiles.

    ``mix_vol`` is the vol of the fixed mix ``weights(series_id, weight)``; ``alpha`` is ``ewma``
    (times ``scale``), ``momentum`` or ``none``.  All windows end at their own day; shift before use.
    """
    if alpha not in ("ewma", "momentum", "none"):
        raise ValueError(f"unknown source of alpha: {alpha}")
    bundle = signal_bundle(panel, alpha, window, halflife, skip)
    if alpha == "ewma":
        bundle = bundle.withColumn("alpha", F.col("alpha") * scale)
    returns = simple_returns(panel)
    mix = portfolio_trailing_vol(returns, weights, window).select("date", F.col("vol").alias("mix_vol"))
    return bundle.join(mix, "date", "left"), covariance_tiles(returns, window)


#: Named primitives, each DataFrame to DataFrame.
PRIMITIVES: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f for f in (simple_returns, trailing_vol, ewma_return, momentum, vol_scaled_momentum, zscore, cross_sectional_rank, vol_ratio)
}


def tripwire(signals: DataFrame, column: str, tolerance: float = 0.35, least: int = 60) -> DataFrame:
    """Look-ahead check: per series and horizon 0 and 1, corr(signal at t, return at t + h).

    A breach is a correlation above ``tolerance`` in size over ``least`` rows or more.
    """
    w = in_order(KEY)
    led = signals.withColumn("_next", F.lead("ret").over(w))
    ahead = led.select(KEY, F.col(column).alias("s"), F.explode(F.array(F.struct(F.lit(0).alias("h"), F.col("ret").alias("r")), F.struct(F.lit(1).alias("h"), F.col("_next").alias("r")))).alias("x"))
    both = ahead.select(KEY, "s", "x.h", "x.r").where("s is not null and r is not null")
    out = both.groupBy(KEY, "h").agg(F.corr("s", "r").alias("corr"), F.count("*").alias("n"), F.stddev_samp("s").alias("sd"), F.stddev_samp("r").alias("sr"))
    fine = out.where((F.col("n") >= least) & (F.col("sd") > 0) & (F.col("sr") > 0))
    return fine.select(KEY, "h", "n", "corr", (F.abs("corr") > tolerance).alias("breach"))
