"""Page-anchored evidence from texts: pages(doc_id, page, text) in, candidates out, never decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import messages

NUMBER = r"(\d+(?:\.\d+)?)"
_YEAR = r"((?:19|20)\d\d)"


def any_of(*words: str) -> str:
    """One of the words, whole, spaces standing for any white space or a hyphen."""
    return r"\b(?:" + "|".join(w.replace(" ", r"[\s-]+") for w in words) + r")\b"


def near(words: str, value: str, reach: int = 40) -> str:
    """``value`` within ``reach`` characters of ``words``, on either side, in one sentence."""
    gap = rf"[^.\n]{{0,{reach}}}?"
    return f"{words}{gap}{value}|{value}{gap}{words}"


_CALENDAR = any_of("daily", "weekly", "monthly", "quarterly", "yearly", "annually")[:-2].replace("(?:", "(", 1) + r"\b"
#: What each scanner looks for, case aside, made from words and the shared number; a hit's value is
#: its first group that matched, else the whole match.
SCANNERS = {
    "rebalance": near(r"\brebalanc\w*", _CALENDAR, 30),
    "cost_bps": NUMBER + r"\s*" + any_of("bps?", "basis points?"),
    "lookback": near(any_of("window", "look ?back", "half life", "rolling", "trailing"), NUMBER + r"[\s-]*" + any_of("days?", "sessions?")),
    "target_vol": near(any_of("target volatility", "volatility target", "target vol", "vol target"), NUMBER + r"\s*%"),
    "sample_period": _YEAR + r"\s*(?:-|–|to|until)\s*" + _YEAR,
    "ticker": "(" + any_of("SPY", "QQQ", "IWM", "EFA", "EEM", "TLT", "IEF", "AGG", "GLD", "NIFTY", "SENSEX") + ")",
    "constraint": "(" + any_of("long only", "no shorts", "unlevered", "no leverage", "no derivatives", "fully invested") + ")",
    "benchmark": r"(\b\d\d/\d\d\b|" + any_of("equal weight(?:ed)?", "cap weight(?:ed)?", "buy and hold", "risk parity") + ")",
    "data_source": "(" + any_of("Bloomberg", "Refinitiv", "CRSP", "Compustat", "FRED", "Yahoo", "NSE", "BSE") + ")",
    "code_url": r"(https?://(?:www\.)?git(?:hub|lab)\.com/\S+)",
    "sharpe": near(any_of("Sharpe", "Sharpe ratio"), r"(\d\.\d+)", 30),
}
GROUPS = {"rebalance": 2, "lookback": 2, "target_vol": 2, "sharpe": 2}
#: Signs that make a line one of formulas.
MATH = r"[=≤≥≠±∑∏√∈∞∂∫Α-Ωα-ω]|\(cid:|[\^_]\{"
# Words that extraction turned backwards, and marks of research papers.
REVERSED = "nruter|ytilitalov|thgieW|oiter|eprahS|etaD|raeY"
PAPER_MARKERS = (
    "abstract", "introduction", "literature review", "methodology", "method", "data and sample", "empirical", "results", "conclusion",
    "references", "bibliography", "appendix", "we find", "we document", "this paper", "hypothesis", "robustness",
)
#: Words that speak for a template; a parameter of :func:`guess_mechanism`.
MECHANISMS = {
    "mean_variance": ("efficient portfolio", "optimal portfolio", "risk aversion", "quadratic program"),
    "vol_target": ("constant volatility", "volatility scaling", "target risk", "risk budget"),
    "ts_momentum": ("trend", "own past return", "breakout"),
    "min_variance": ("least variance", "lowest variance", "minimum risk"),
    "equal_risk": ("risk contribution", "balanced risk", "equal shares of risk"),
    "inverse_vol": ("inverse of volatility", "one over volatility", "volatility weighted"),
}
METRIC_ALIASES = {
    "annualized return": "cagr", "return": "cagr", "cagr": "cagr", "volatility": "vol", "vol": "vol", "std": "vol", "risk": "vol", "sharpe ratio": "sharpe", "sharpe": "sharpe",
    "max drawdown": "max_drawdown", "max dd": "max_drawdown", "drawdown": "max_drawdown", "mean drawdown": "mean_drawdown", "mean dd": "mean_drawdown", "turnover": "turnover",
}


def as_pages(docs: DataFrame, lines_per_page: int = 40) -> DataFrame:
    """(doc_id, page, text): texts cut every ``lines_per_page`` lines; null texts have one empty page."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0)), F.lit(lines_per_page))
    parts = F.transform(starts, lambda s: F.array_join(F.slice(lines, s + 1, lines_per_page), "\n"))
    return docs.select("doc_id", F.posexplode(parts).alias("page", "text"))


def is_reversed(text: Column) -> Column:
    return text.rlike(REVERSED)


def math_density(text: Column) -> Column:
    """Share of non-blank lines with formula marks, 0 without lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(MATH))) / F.nullif(F.size(lines), F.lit(0)), F.lit(0.0))


def scan(pages: DataFrame, scanners: dict[str, str] = SCANNERS, around: int = 70) -> DataFrame:
    """(doc_id, page, kind, n, value, context) of every hit, in one pass; pages read backwards are skipped."""
    text = F.col("text")

    def hits(kind: str, pattern: str) -> Column:
        p = "(?i)" + pattern

        def hit(match: Column, n: Column) -> Column:
            groups = [F.nullif(F.regexp_extract(match, p, g), F.lit("")) for g in range(1, GROUPS.get(kind, 1) + 1)]
            place = F.position(match, text)
            start = F.greatest(place - around, F.lit(1))
            context = F.substr(text, start, place - start + F.length(match) + around)
            return F.struct(F.lit(kind).alias("kind"), n.alias("n"), F.coalesce(*groups, match).alias("value"), context.alias("context"))

        return F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), hit)

    found = F.flatten(F.array(*[hits(kind, pattern) for kind, pattern in scanners.items()]))
    fine = pages.where(text.isNotNull() & ~is_reversed(text))
    return fine.select("doc_id", "page", F.explode(found).alias("h")).select("doc_id", "page", "h.*")


def extraction_report(pages: DataFrame) -> DataFrame:
    """Per document: pages, characters, empty and reversed pages, mean formula density, verdict and warnings."""
    chars = F.length(F.coalesce("text", F.lit("")))
    out = pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.sum(chars).alias("n_chars"), F.sum((chars < 50).cast("int")).alias("empty_pages"), F.avg(math_density(F.coalesce("text", F.lit("")))).alias("math_density"),
        F.sum(F.coalesce(is_reversed(F.col("text")), F.lit(False)).cast("int")).alias("reversed_pages"),
    )
    scanned = F.col("n_chars") / F.col("n_pages") < 200
    out = out.withColumns({"scanned": scanned}).withColumn("usable", (F.col("n_chars") > 2000) & ~F.col("scanned"))
    return out.withColumn("warnings", messages((F.col("scanned"), "few characters a page"), (F.col("reversed_pages") > 0, "pages read backwards"), (F.col("empty_pages") > 0, "empty pages"), (F.col("math_density") > 0.2, "many formulas")))


def classify(pages: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """research_paper at three section markers or more; else by the reasons against."""
    low = F.lower(F.coalesce("text", F.lit("")))
    marks = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.length(low)).alias("n_chars"), *[F.max(low.contains(m).cast("int")).alias(f"m{i}") for i, m in enumerate(PAPER_MARKERS)])
    n = sum((F.col(f"m{i}") for i in range(len(PAPER_MARKERS))), F.lit(0))
    found = F.array_compact(F.array(*[F.when(F.col(f"m{i}") == 1, m) for i, m in enumerate(PAPER_MARKERS)]))
    n_tables = tables.groupBy("doc_id").agg(F.count("*").alias("n_tables")) if tables is not None else pages.select("doc_id").distinct().withColumn("n_tables", F.lit(0).cast("long"))
    out = marks.select("doc_id", "n_pages", "n_chars", found.alias("markers"), n.alias("n_markers")).join(n_tables, "doc_id", "left").fillna(0, ["n_tables"])
    reasons = messages((F.col("n_markers") < 3, "few section markers"), (F.col("n_tables") == 0, "no numeric tables"), (F.col("n_pages") < 5, "few pages"), (F.col("n_chars") < 8000, "little text"))
    verdict = F.when(F.col("n_markers") >= 3, "research_paper").when(F.size(reasons) >= 3, "probably_not_a_paper").otherwise("unclear")
    return out.withColumns({"reasons": reasons, "verdict": verdict})


def guess_mechanism(pages: DataFrame, mechanisms: dict[str, tuple[str, ...]] = MECHANISMS) -> DataFrame:
    """(doc_id, template, score): the template whose words occur most, the first among equals; fixed_weight without any."""
    low = F.lower(F.coalesce("text", F.lit("")))
    scores = pages.groupBy("doc_id").agg(*[F.sum(sum((F.regexp_count(low, F.lit(w)) for w in words), F.lit(0))).alias(k) for k, words in mechanisms.items()])
    each = scores.select("doc_id", F.explode(F.array(*[F.struct(F.col(k).alias("score"), F.lit(-i).alias("ord"), F.lit(k).alias("template")) for i, k in enumerate(mechanisms)])).alias("s"))
    best = each.groupBy("doc_id").agg(F.max("s").alias("s"))
    return best.select("doc_id", F.when(F.col("s.score") > 0, F.col("s.template")).otherwise("fixed_weight").alias("template"), F.col("s.score").alias("score"))


_NUMBER = r"\(?-?\$?\d[\d,]*\.?\d*%?\)?%?"


def number_rows(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line, label, numbers): lines that end in two numbers or more.

    ``%`` divides by 100, ``(x)`` is negative, commas go; a label that is mostly digits is none.
    """
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    tail = F.regexp_extract("raw", rf"((?:\s+{_NUMBER}){{2,}})\s*$", 1)
    label = F.trim(F.substr("raw", F.lit(1), F.length("raw") - F.length(F.regexp_extract("raw", rf"(?:\s+{_NUMBER}){{2,}}\s*$", 0))))
    digits = F.regexp_count("label", F.lit(r"\d"))
    rows = lines.select("doc_id", "page", "line", label.alias("label"), F.trim(tail).alias("tail")).where((F.col("tail") != "") & (F.col("label") != "")).where(digits * 2 < F.length("label"))

    def value(x: Column) -> Column:
        bare = F.regexp_replace(x, r"[,$()%]", "").try_cast("double")
        scaled = F.when(x.contains("%"), bare / 100).otherwise(bare)
        return F.when(x.startswith("("), -scaled).otherwise(scaled)

    return rows.select("doc_id", "page", "line", "label", F.transform(F.split("tail", r"\s+"), value).alias("numbers"))


def recover_tables(pages: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Blocks of two rows or more of at most two widths, with header and caption.

    The header is the last non-blank line up to three above; the caption a ``Table N:`` line up to
    five below or three above.
    """
    rows = number_rows(pages) if rows is None else rows
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    block = rows.withColumn("start", (F.col("line") - F.lag("line").over(w) != 1).cast("int")).withColumn("block", F.sum(F.coalesce("start", F.lit(1))).over(w))
    tables = block.groupBy("doc_id", "page", "block").agg(
        F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n_rows"), F.countDistinct(F.size("numbers")).alias("widths"), F.max(F.size("numbers")).alias("width"),
        F.sort_array(F.collect_list(F.struct("line", "label", "numbers"))).alias("rows"),
    ).where("n_rows >= 2 and widths <= 2")
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("at", "raw")).where("trim(raw) != ''")
    near = tables.join(lines, ["doc_id", "page"], "left").where("at >= first - 3 and at <= last + 5")
    is_caption = F.col("raw").rlike(r"^\s*Table\s+\d+\s*[:.]")
    context = near.groupBy("doc_id", "page", "block").agg(
        F.max_by(F.when((F.col("at") < F.col("first")) & ~is_caption, F.trim("raw")), F.when((F.col("at") < F.col("first")) & ~is_caption, F.col("at"))).alias("header"),
        F.min_by(F.when(is_caption, F.trim("raw")), F.when(is_caption & (F.col("at") > F.col("last")), F.col("at")).when(is_caption & (F.col("at") < F.col("first")), F.col("at") + 100000)).alias("caption"),
    )
    return tables.join(context, ["doc_id", "page", "block"], "left")


def is_numeric_table(cells: Column) -> Column:
    """Whether more than 35 % of an array of cells are numbers."""
    return F.size(F.filter(cells, lambda c: F.trim(c).rlike(rf"^{_NUMBER}$"))) / F.nullif(F.size(cells), F.lit(0)) > 0.35


def propose_targets(tables: DataFrame, aliases: dict[str, str] = METRIC_ALIASES) -> DataFrame:
    """(doc_id, page, portfolio, metric, value) where a header's metric words match the row's width."""
    low, metrics = F.lower(F.coalesce("header", F.lit(""))), []
    for name in sorted(aliases, key=len, reverse=True):
        metrics.append((name, aliases[name]))
    at = F.array(*[F.struct(F.expr(f"locate('{a}', lower(coalesce(header, '')))").alias("at"), F.lit(m).alias("metric"), F.lit(len(a)).alias("size")) for a, m in metrics])
    hits = F.filter(at, lambda x: x["at"] > 0)
    # longest alias first: a shorter one inside a longer one is no hit of its own
    kept = F.filter(hits, lambda x: ~F.exists(hits, lambda y: (y["size"] > x["size"]) & (y["at"] <= x["at"]) & (x["at"] + x["size"] <= y["at"] + y["size"])))
    named = tables.where(low != "").withColumn("metrics", F.transform(F.array_sort(kept), lambda x: x["metric"]))
    rows = named.select("doc_id", "page", "metrics", F.explode("rows").alias("r")).where(F.size("metrics") == F.size("r.numbers"))
    return rows.select("doc_id", "page", F.col("r.label").alias("portfolio"), F.explode(F.arrays_zip("metrics", F.col("r.numbers").alias("numbers"))).alias("z")).select("doc_id", "page", "portfolio", F.col("z.metrics").alias("metric"), F.col("z.numbers").alias("value"))


def conflicts(targets: DataFrame) -> DataFrame:
    """(doc_id, portfolio, metric) printed with more than one value at six decimals."""
    out = targets.groupBy("doc_id", "portfolio", "metric").agg(F.sort_array(F.collect_set(F.round("value", 6))).alias("vals"), F.sort_array(F.collect_set("page")).alias("pages"))
    return out.where(F.size("vals") > 1)


def first_hits(hits: DataFrame, k: int = 6) -> DataFrame:
    """The first ``k`` distinct (value, page) hits of each kind in a document."""
    distinct = hits.groupBy("doc_id", "kind", "value", "page").agg(F.min("n").alias("n"))
    return distinct.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("page", "n", "value"))).where(F.col("_k") <= k).drop("_k")


def commonest(hits: DataFrame) -> DataFrame:
    """Hit values by frequency in (doc, kind), with the first page."""
    return hits.groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n"), F.min("page").alias("first_page"))


def first_number(hits: DataFrame, kind: str, low: float, high: float, default: float) -> DataFrame:
    """Per document the first hit of a kind that is a number in range, else the default."""
    v = F.regexp_replace("value", ",", "").try_cast("double")
    fit = hits.where(F.col("kind") == kind).withColumn("v", v).where(F.col("v").between(low, high)).groupBy("doc_id").agg(F.min_by("v", F.struct("page", "n")).alias("v"))
    return hits.select("doc_id").distinct().join(fit, "doc_id", "left").select("doc_id", F.coalesce("v", F.lit(float(default))).alias("value"))


def largest_table(tables: DataFrame) -> DataFrame:
    return tables.groupBy("doc_id").agg(F.max_by(F.struct("page", "block", "n_rows"), F.struct("n_rows", -F.col("page"), -F.col("block"))).alias("t")).select("doc_id", "t.*")


def compare_documents(pages: DataFrame, hits: DataFrame) -> DataFrame:
    """One row a document: size, formulas, tables, targets, conflicts, code and tickers."""
    tables = recover_tables(pages)
    targets = propose_targets(tables)
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    found = hits.groupBy("doc_id").agg(F.max((F.col("kind") == "code_url").cast("int")).alias("has_code"), F.countDistinct(F.when(F.col("kind") == "ticker", F.upper("value"))).alias("tickers"))
    out = extraction_report(pages).select("doc_id", "n_pages", "n_chars", "math_density")
    for part in (count(tables, "tables"), count(targets, "targets"), count(conflicts(targets), "conflicts"), found):
        out = out.join(part, "doc_id", "left")
    return out.fillna(0, ["tables", "targets", "conflicts", "has_code", "tickers"])
