"""Panels from tables and files: reading, checking, aligning, freezing.

A panel is long: ``series_id, date, value``, one row per series and day, null where the price is
missing.  Checks refuse a whole input rather than guess: ``refuse`` turns the rows that break a
rule into one error.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import ANNUAL, messages

# Spellings of the master file's columns (case and separators aside), and of yes and no.
ALIASES = {
    "date": ("date", "trade_date", "timestamp", "dt", "as_of"),
    "security_id": ("security_id", "sec_id", "id", "isin", "permno", "entity_id"),
    "symbol": ("symbol", "ticker", "scrip", "nse_symbol", "code"),
    "adj_close": ("adj_close", "adjusted_close", "close_adj", "px_adj", "adjusted_price", "adj_price"),
    "close": ("close", "close_price", "px_close", "closing_price", "price"),
    "in_universe": ("in_universe", "in_index", "member", "membership", "is_member", "index_member", "active", "is_active"),
    "free_float_mcap": ("free_float_mcap", "ff_mcap", "free_float_market_cap", "ffmc", "float_mcap"),
    "market_cap": ("market_cap", "mcap", "total_mcap", "full_mcap"),
    "adv": ("adv", "traded_value", "turnover_value", "value_traded", "traded_val", "turnover"),
    "volume": ("volume", "qty", "shares_traded", "traded_qty"),
    "sector": ("sector", "industry", "gics_sector", "macro_sector"),
}
YES = ("1", "true", "t", "y", "yes")
NO = ("0", "false", "f", "n", "no")
PIT_ALIASES = {"pit": "point_in_time", "true_pit": "point_in_time", "point in time": "point_in_time", "restated": "restated", "latest": "restated", "unknown": "unknown"}


class Refused(ValueError):
    """An input that breaks a rule of its contract."""


def refuse(bad: DataFrame, what: str, show: int = 5) -> None:
    """Raise if ``bad`` has a row; shows a few of them."""
    rows = bad.limit(show).collect()
    if rows:
        raise Refused(f"{what}: {[r.asDict() for r in rows]}")


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Rename to canonical columns, case and separators aside; the first spelling wins."""
    norm = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    have: dict[str, str] = {}
    for c in df.columns:
        have.setdefault(norm(c), c)
    found = {k: have[norm(a)] for k, names in aliases.items() for a in reversed(names) if norm(a) in have}
    if not {"date", "security_id"} <= found.keys() or not {"adj_close", "close"} & found.keys():
        raise Refused(f"date, security_id and a price are required; found {sorted(found)}")
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in found.items()])


def strict_boolean(x: Column) -> Column:
    """True or false for known spellings, null for null; other spellings raise."""
    t = F.lower(F.trim(x.cast("string")))
    known = F.when(t.isin(*YES), True).when(t.isin(*NO), False)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.coalesce(known, F.raise_error(F.concat(F.lit("not a boolean: "), t))))


def strict_date(x: Column) -> Column:
    """A date; what cannot be read raises."""
    got = F.to_date(F.try_to_timestamp(x.cast("string")))
    return F.when(x.isNull() | got.isNull(), F.raise_error(F.concat(F.lit("not a date: "), F.coalesce(x.cast("string"), F.lit("null"))))).otherwise(got)


def load_master(raw: DataFrame, require_membership: bool = False) -> DataFrame:
    """The long master table: canonical columns, refused if a rule is broken.

    Membership is the file's column, missing values counting as out; without one, a present
    price is membership, unless ``require_membership``.
    """
    df = resolve_columns(raw)
    price = "adj_close" if "adj_close" in df.columns else "close"
    out = df.withColumns({"date": strict_date(F.col("date")), "price": F.expr(f"try_cast({price} as double)"), "security_id": F.col("security_id").cast("string")})
    refuse(out.groupBy("date", "security_id").count().where("count > 1"), "repeated (date, security)")
    if "in_universe" in df.columns:
        return out.withColumn("in_universe", F.coalesce(strict_boolean(F.col("in_universe")), F.lit(False)))
    if require_membership:
        raise Refused("a membership column is required")
    return out.withColumn("in_universe", F.col("price").isNotNull())


def read_master(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV, text or gzip by header, or Parquet, through :func:`load_master`."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True)
    return load_master(raw, **options)


def read_series(spark: SparkSession, path: str, date: str, value: str, name: str) -> DataFrame:
    """One declared CSV series; rows without a readable date go, dates are sorted."""
    day = F.to_date(F.try_to_timestamp(F.col(f"`{date}`")))
    df = spark.read.csv(path, header=True)
    return df.select(F.lit(name).alias("series_id"), day.alias("date"), F.expr(f"try_cast(`{value}` as double)").alias("value")).where("date is not null").sort("date")


def unpivot_wide(wide: DataFrame, row: str = "source_row", date: str = "date") -> DataFrame:
    """A wide export as a panel: names with single spaces, other than numbers null, last of equal dates."""
    names = [c for c in wide.columns if c not in (row, date) and c.strip()]
    clean = F.create_map(*[F.lit(x) for c in names for x in (c, " ".join(c.split()))])
    long = wide.select(row, F.to_date(F.try_to_timestamp(F.col(date).cast("string"))).alias("date"), *[F.col(f"`{c}`").cast("string").alias(c) for c in names]).unpivot([row, "date"], names, "name", "text")
    last = Window.partitionBy("series_id", "date").orderBy(F.desc(row))
    out = long.where("date is not null").select(row, "date", clean[F.col("name")].alias("series_id"), F.expr("try_cast(text as double)").alias("value"))
    return out.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("series_id", "date", "value")


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def to_wide(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    """One column per named series; for export only."""
    return panel.groupBy("date").pivot("series_id", list(names)).agg(F.first("value", ignorenulls=True))


def calendar(panel: DataFrame) -> DataFrame:
    """(date, pos): the distinct days and their place; as many rows as there are days."""
    days = panel.select("date").distinct()
    return days.withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written, in the folder that spark.checkpoint.dir names; what follows starts from the written rows.

    Only where driver and executors are one process is a folder chosen here.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
        context.setCheckpointDir(named or "file:///tmp/checkpoints")
    return df.checkpoint()


def on_days(keys: DataFrame, days: DataFrame) -> DataFrame:
    """Every row of ``keys`` on every day of ``days``; the calendar travels as one array, which has 366 entries a year at most."""
    calendar_ = days.agg(F.sort_array(F.collect_set("date")).alias("_days"))
    return keys.crossJoin(F.broadcast(calendar_)).select(*keys.columns, F.explode("_days").alias("date"))  # one row


def provenance(panel: DataFrame) -> DataFrame:
    """Per series: first and last valid day, observations, gaps inside, first value."""
    held = panel.where("value is not null").groupBy("series_id").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_obs"), F.min_by("value", "date").alias("first_value")
    )
    at = calendar(panel)
    lo, hi = at.select(F.col("date").alias("first_date"), F.col("pos").alias("lo")), at.select(F.col("date").alias("last_date"), F.col("pos").alias("hi"))
    return held.join(lo, "first_date").join(hi, "last_date").select(
        "series_id", "first_date", "last_date", "n_obs", "first_value", (F.col("hi") - F.col("lo") + 1 - F.col("n_obs")).cast("long").alias("gaps")
    )


def restrict(panel: DataFrame, start: str | None = None, end: str | None = None, value: str = "value", key: str = "series_id") -> DataFrame:
    """The days between both ends, without series that have no value left."""
    cut = panel
    if start:
        cut = cut.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        cut = cut.where(F.col("date") <= F.lit(end).cast("date"))
    return cut.join(cut.where(F.col(value).isNotNull()).select(key).distinct(), key, "left_semi")


def require_series(panel: DataFrame, names: DataFrame) -> DataFrame:
    """Only the named series; refused if one is missing."""
    refuse(names.join(panel.select("series_id").distinct(), "series_id", "left_anti"), "missing series")
    return panel.join(names.select("series_id").distinct(), "series_id", "left_semi")


def require_complete(panel: DataFrame, required: Sequence[str]) -> DataFrame:
    """Only the days on which every required series has a value."""
    whole = panel.where(F.col("series_id").isin(*required) & F.col("value").isNotNull()).groupBy("date").agg(F.countDistinct("series_id").alias("n")).where(F.col("n") == len(set(required)))
    return panel.join(whole, "date", "left_semi")


def add_proxy(panel: DataFrame, proxy: DataFrame, stands_for: str) -> DataFrame:
    """The panel with a declared proxy's rows under the name it stands for."""
    return panel.unionByName(proxy.select(F.lit(stands_for).alias("series_id"), "date", "value"))


def add_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two sources on one calendar: long panels are joined by union; equal names are refused."""
    refuse(left.select("series_id").intersect(right.select("series_id")), "series in both sources")
    return left.select("series_id", "date", "value").unionByName(right.select("series_id", "date", "value"))


def common_days(*panels: DataFrame) -> DataFrame:
    """Days that every panel has."""
    out = panels[0].select("date").distinct()
    for p in panels[1:]:
        out = out.intersect(p.select("date"))
    return out


def cash_accrual(days: DataFrame, annual_rate: float) -> DataFrame:
    """(date, rf): a constant annual rate as a daily one."""
    return days.select("date", (F.pow(F.lit(1.0 + annual_rate), F.lit(1.0 / ANNUAL)) - 1).alias("rf"))


def fixed_universe(panel: DataFrame) -> DataFrame:
    """The panel itself; refused if a value is missing on a day or series of the grid."""
    grid = on_days(panel.select("series_id").distinct(), panel)
    refuse(grid.join(panel.where("value is not null"), ["series_id", "date"], "left_anti"), "missing prices in a fixed universe")
    return panel


def engine_inputs(master: DataFrame) -> DataFrame:
    """(series_id, date, value, member) without securities that never have a price."""
    return restrict(master.select(F.col("security_id").alias("series_id"), "date", F.col("price").alias("value"), F.coalesce("in_universe", F.lit(False)).alias("member")))


def fill_ratio(panel: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, ratio): share of the day-by-security grid that is populated."""
    size = panel.agg(F.countDistinct("series_id").alias("s"), F.countDistinct("date").alias("d"), *[F.count(c).cast("double").alias(c) for c in fields])
    return size.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), (F.col(c) / (F.col("s") * F.col("d"))).alias("ratio")) for c in fields])).alias("x")).select("x.*")


def needed_columns(*lists: DataFrame, held: DataFrame) -> DataFrame:
    """The distinct names of all lists that the source holds."""
    out = lists[0].select("series_id")
    for x in lists[1:]:
        out = out.union(x.select("series_id"))
    return out.distinct().join(held.select("series_id").distinct(), "series_id", "left_semi").sort("series_id")


# -- freezing -----------------------------------------------------------------------------


def row_digest() -> Column:
    day = F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit(""))
    return F.sha2(F.concat_ws("|", "series_id", day, F.coalesce(F.col("value").cast("string"), F.lit("null"))), 256)


def series_digests(panel: DataFrame) -> DataFrame:
    """(series_id, n, digest): each year's row digests are digested, then the series' years, so that no group grows with history."""
    years = panel.withColumn("_d", row_digest()).groupBy("series_id", F.trunc("date", "year").alias("_y")).agg(F.count("*").alias("n"), F.sha2(F.concat_ws("", F.sort_array(F.collect_list("_d"))), 256).alias("_d"))
    return years.groupBy("series_id").agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("", F.sort_array(F.collect_list("_d"))), 256).alias("digest"))


def panel_hash(panel: DataFrame) -> str:
    """A digest that any change of any value changes; rows in any order.  Series are dealt into 4,096 lists by a hash of the name."""
    named = series_digests(panel).select(F.pmod(F.xxhash64("series_id"), F.lit(4096)).alias("_p"), F.concat_ws(":", "series_id", "digest").alias("_h"))
    parts = named.groupBy("_p").agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("_h"))), 256).alias("h"))
    whole = parts.agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256)).first()
    return whole[0] or ""


def freeze(panel: DataFrame, path: str, lineage=None, **manifest) -> dict:
    """Write the panel and a one-row manifest with its hash; an existing folder is refused.

    The panel is computed once, by the write; its hash and extent come from what was written, and
    ``lineage`` (:class:`ledgerline.sources.files.Lineage`) gives the rows of the steps that led to it.
    """
    panel.write.mode("errorifexists").parquet(f"{path}/panel")
    frozen = panel.sparkSession.read.parquet(f"{path}/panel")
    seen = frozen.agg(F.count("*").alias("rows"), F.countDistinct("series_id").alias("series"), F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last")).first().asDict()
    record = {**seen, "hash": panel_hash(frozen), **({"transformations": lineage.record()} if lineage is not None else {}), **manifest}
    panel.sparkSession.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return record


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the frozen panel still has the hash of its manifest."""
    record = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return panel_hash(spark.read.parquet(f"{path}/panel")) == record["hash"]


def lineage(steps: Sequence[tuple[str, DataFrame]]) -> list[dict]:
    """Row counts before and after each named step, all counted by one job."""
    counted = [df.agg(F.lit(i).alias("i"), F.count("*").alias("n")) for i, (_, df) in enumerate(steps)]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    n = {r["i"]: r["n"] for r in out.collect()}
    return [{"step": name, "rows_before": n[i], "rows_after": n[i + 1]} for i, (name, _) in enumerate(steps[1:])]


def catalogue(spark: SparkSession, folders: Sequence[str], pattern: str = "*.pdf", least: int = 1024, strict: bool = False) -> DataFrame:
    """Files by pattern: path, slug, size and SHA-256; those under ``least`` bytes are marked, or with ``strict`` refused."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(folders))
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    if strict:
        refuse(files.where(F.col("length") < least).select("path"), f"files under {least} bytes")
    return files.dropDuplicates(["path"]).select(
        "path", F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "_").alias("slug"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), (F.col("length") >= least).alias("accepted")
    )


def append_records(records: DataFrame, path: str) -> None:
    """Append provenance records; each needs an operator's name."""
    refuse(records.where("coalesce(trim(operator), '') = ''"), "records without an operator")
    records.write.mode("append").json(path)


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records in order of time; lines that are not records are skipped."""
    got = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return got.where("stage is not null and produced_by is not null and operator is not null").sort("created_utc")


# -- declarations -------------------------------------------------------------------------


def pit_status(x: Column) -> Column:
    """The canonical point-in-time status, null for spellings that are not known."""
    table = F.create_map(*[F.lit(v) for k, c in {**PIT_ALIASES, "point_in_time": "point_in_time"}.items() for v in (k, c)])
    return F.try_element_at(table, F.lower(F.trim(x)))


def manifest_errors(entries: DataFrame, kinds: Sequence[str] = ("price", "rate", "index", "fundamental")) -> DataFrame:
    """Entries of supplied series with ``errors``: what each breaks."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return entries.withColumn(
        "errors",
        messages(
            *[(blank(c), f"{c} is required") for c in ("name", "file", "kind", "pit_status")],
            (~blank("kind") & ~F.col("kind").isin(*kinds), F.concat(F.lit("unknown kind "), "kind")),
            (~blank("pit_status") & pit_status(F.col("pit_status")).isNull(), F.concat(F.lit("unknown pit_status "), "pit_status")),
        ),
    )


def declaration_errors(declared: DataFrame) -> DataFrame:
    """Declared master universes (file, pit_status, licence) with ``errors``; a status has to be a canonical one."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    known = F.col("pit_status").isin(*sorted(set(PIT_ALIASES.values())))
    return declared.withColumn(
        "errors",
        messages(*[(blank(c), f"master: {c} is required") for c in ("file", "pit_status", "licence")], (~blank("pit_status") & ~known, F.concat(F.lit("master: unknown pit_status "), "pit_status"))),
    )


def load_declared_master(spark: SparkSession, declared: DataFrame, folder: str, **options) -> DataFrame | None:
    """The master universe that a one-row declaration names, or None without one; a broken one is refused."""
    row = declaration_errors(declared).first()
    if row is None:
        return None
    if row["errors"]:
        raise Refused("; ".join(row["errors"]))
    return read_master(spark, f"{folder}/{row['file']}", **options)


def select_registry(registry: DataFrame, name: str | None = None, kind: str | None = None, proxy_for: str | None = None) -> DataFrame:
    """Registry entries by name, by kind, or declared to stand for a name; in order of names."""
    out = registry
    if name is not None:
        out = out.where(F.col("name") == name)
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if proxy_for is not None:
        out = out.where(F.array_contains("is_proxy_for", proxy_for))
    return out.sort("name")


def extend_registry(registry: DataFrame, entries: DataFrame, caveat: str = "not knowable at the time") -> DataFrame:
    """The registry with supplied series; a name that it has is refused.

    Entries that are not point-in-time, after their spelling is normalised, get the caveat.
    """
    refuse(entries.select("name").join(registry.select("name"), "name", "left_semi"), "names already in the registry")
    late = pit_status(F.col("pit_status")) != "point_in_time"
    more = F.concat(F.coalesce("caveats", F.array().cast("array<string>")), F.when(late, F.array(F.lit(caveat))).otherwise(F.array().cast("array<string>")))
    return registry.unionByName(entries.withColumn("caveats", more), allowMissingColumns=True)
