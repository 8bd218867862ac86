"""Rules of card sections, and requirements that follow from a strategy, as rows compiled to columns.

A section rule names a path into the card, a field, what has to hold, and when; a path that ends in
an array holds for each of its items.  A requirement rule is a tree of all, any, not and simple
conditions over facts of the strategy.  All rules of a table become one projection, so cards are
read once and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

# -- sections -----------------------------------------------------------------------------

# What fields of a card may say.
CONFIDENCES = ("high", "low", "medium")
DATA_KINDS = ("corporate_action", "factor_return", "fundamental", "macro", "membership", "price", "publication_date", "risk_free_rate", "total_return_index", "volume")
FREQUENCIES = ("annual", "daily", "monthly", "quarterly", "weekly")
REBALANCES = ("annual", "calendar_year_end", "daily", "monthly", "quarterly", "weekly")
GRANULARITIES = ("daily", "minute", "monthly", "quarterly", "tick", "weekly")
LIST_SOURCES = ("UNVERIFIED", "firm_registry", "index_factsheet", "master_universe", "paper", "supplied_by_human")
PRIORITIES = ("blocking", "high", "nice_to_have")
ASKED_OF = ("anyone", "data_owner", "pm", "researcher")
NOTE_KINDS = ("cost", "data", "execution", "timing", "validity")
CONVERTIBLE = ("convertible", "convertible_with_data", "mechanism_only", "not_convertible")
CAP_SEGMENTS = ("all", "large", "large_mid", "mega", "micro", "mid", "mid_small", "small")
GRADES = ("close", "exact", "loose", "none")
RESOLUTIONS = ("direct", "exposure_proxy", "infeasible", "needs_data", "sleeve_proxy")
HEADLINE_CHARS = 100


class Rule(NamedTuple):
    """What has to hold for ``field`` at ``path`` ("" for the card), where ``when`` (field, kind, bound) holds.

    Kinds: text (not blank), among, blank or among, items (so many or more), least (a number of so
    much or more), line (at most so many characters, blanks run together), flagged (an item whose
    field ``bound`` is true), true, false, equal, other than, sum (of a map's values, at most),
    no shorts (no negative value in a map).
    """

    path: str
    field: str
    kind: str
    bound: Any
    message: str
    when: tuple[str, str, Any] | None = None


def _headline(path: str) -> Rule:
    return Rule(path, "headline", "line", HEADLINE_CHARS, "the headline fits one line")


#: Sections in alphabetical order, then the card itself.
SECTION_RULES = (
    _headline("ambiguities"),
    Rule("ambiguities", "confidence", "among", CONFIDENCES, "the confidence is high, medium or low"),
    Rule("ambiguities", "resolution", "text", None, "it is resolved before the run"),
    Rule("backtest_plan", "sample_start", "text", None, "the first day is stated"),
    Rule("backtest_plan", "sample_end", "text", None, "the last day is stated"),
    Rule("backtest_plan", "rebalance_rule", "text", None, "the rebalance rule is stated"),
    Rule("backtest_plan", "weights_rule", "text", None, "the weights rule is stated"),
    Rule("backtest_plan", "why_this_window", "text", None, "the window is argued"),
    Rule("backtest_plan", "benchmarks", "items", 1, "a benchmark is named"),
    Rule("backtest_plan", "success_looks_like", "text", None, "success is defined"),
    Rule("backtest_plan", "failure_looks_like", "text", None, "failure is defined"),
    Rule("backtest_plan", "explicit_weights", "sum", 1.0 + 1e-6, "weights are not levered"),
    Rule("backtest_plan", "explicit_weights", "no shorts", None, "no weight is short"),
    Rule("backtest_plan.benchmarks", "name", "text", None, "it has a name"),
    Rule("backtest_plan.benchmarks", "why_this", "text", None, "it has a reason"),
    _headline("convertibility"),
    Rule("convertibility", "verdict", "among", CONVERTIBLE, "the verdict is a known one"),
    Rule("convertibility", "confidence", "among", CONFIDENCES, "the confidence is high, medium or low"),
    Rule("convertibility", "what_must_be_true", "items", 2, "the chain has two links or more"),
    Rule("convertibility", "weakest_link", "text", None, "the weakest link is named"),
    Rule("data_plan", "ideal", "items", 1, "the deserved data set is designed"),
    Rule("data_plan", "optimality_argument", "text", None, "the data set is argued"),
    Rule("data_plan", "ideal", "flagged", "minimum_viable", "the smallest honest set is marked", ("ideal", "items", 1)),
    Rule("data_plan.ideal", "field", "text", None, "the field is named"),
    Rule("data_plan.ideal", "granularity", "among", GRANULARITIES, "the granularity is a known one"),
    Rule("data_plan.ideal", "why", "text", None, "the need is stated"),
    Rule("data_plan.ideal", "why_granularity", "text", None, "the granularity is argued"),
    Rule("data_plan.rejected_alternatives", "option", "text", None, "the option is named"),
    Rule("data_plan.rejected_alternatives", "why_not", "text", None, "the rejection is argued"),
    _headline("data_requests"),
    Rule("data_requests", "item", "text", None, "what is asked for is named"),
    Rule("data_requests", "priority", "among", PRIORITIES, "the priority is a known one"),
    Rule("data_requests", "without_it", "text", None, "there is a fallback"),
    Rule("data_requirements", "kind", "among", DATA_KINDS, "the kind is a known one"),
    Rule("data_requirements", "frequency", "among", FREQUENCIES, "the frequency is a known one"),
    Rule("local_notes", "category", "among", NOTE_KINDS, "the category is a known one"),
    Rule("local_notes", "item", "text", None, "the requirement is named"),
    Rule("local_notes", "why", "text", None, "the requirement is argued"),
    Rule("local_notes", "triggered_by", "text", None, "what raised it is named"),
    _headline("open_questions"),
    Rule("open_questions", "question", "text", None, "the question is asked"),
    Rule("open_questions", "ask_of", "among", ASKED_OF, "who is asked is a known role"),
    Rule("open_questions", "what_i_assumed", "text", None, "it blocks the run or has a working assumption", ("blocks_run", "false", None)),
    Rule("selection", "rule", "text", None, "securities are chosen by a rule"),
    Rule("selection", "verified_against", "among", LIST_SOURCES, "a named list says what confirmed it", ("explicit_securities", "items", 1)),
    Rule("selection", "as_of", "text", None, "a named list has a date", ("explicit_securities", "items", 1)),
    Rule("strategy", "confidence", "among", CONFIDENCES, "the confidence is high, medium or low"),
    Rule("strategy", "signal_definition", "text", None, "the signal is defined"),
    Rule("strategy", "long_only_adaptation", "text", None, "a long-short source is adapted to long only", ("is_long_short", "true", None)),
    Rule("strategy", "template_gap", "text", None, "a missing template is specified", ("engine_template", "equal", "NEEDS_NEW_TEMPLATE")),
    Rule("universe_translation", "source_universe", "text", None, "the source universe is named"),
    Rule("universe_translation", "grade", "blank or among", GRADES, "the grade is a known one"),
    Rule("universe_translation", "resolution", "blank or among", RESOLUTIONS, "the resolution is a known one"),
    Rule("universe_translation", "target_universe", "text", None, "a graded translation has a target", ("grade", "other than", "none")),
    Rule("universe_translation", "transfer_risks", "items", 1, "a translation names its risks", ("target_universe", "text", None)),
    Rule("universe_translation.mechanism_needs", "cap_segment", "among", CAP_SEGMENTS, "the segment is a known one"),
    Rule("universe_translation.mechanism_needs", "min_names", "least", 1, "a name or more is needed"),
    Rule("", "n_configs_tried", "least", 1, "a config or more was tried"),
)


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))


def _length(kind: DataType | None, c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) if kind is not None else F.lit(0)


def _condition(at: Callable[[str], tuple[Column, DataType | None]], field: str, kind: str, bound: Any) -> Column:
    """Whether ``field`` of the struct that ``at`` reads is as it has to be; fields that are missing are null."""
    c, has = at(field)
    text = lambda: F.length(_clean(c)) > 0
    values = lambda: F.map_values(c) if has is not None else F.array().cast("array<double>")
    conditions: dict[str, Callable[[], Column]] = {
        "text": text,
        "among": lambda: c.isin(*bound),
        "blank or among": lambda: ~text() | c.isin(*bound),
        "items": lambda: _length(has, c) >= bound,
        "least": lambda: c >= bound,
        "line": lambda: F.length(_clean(c)) <= bound,
        "flagged": lambda: F.exists(c, lambda v: F.coalesce(v[bound], F.lit(False))) if isinstance(has, ArrayType) and bound in has.elementType.names else F.lit(False),
        "true": lambda: c,
        "false": lambda: ~F.coalesce(c, F.lit(False)),
        "equal": lambda: c == bound,
        "other than": lambda: text() & (c != bound),
        "sum": lambda: F.aggregate(F.coalesce(values(), F.array().cast("array<double>")), F.lit(0.0), lambda s, v: s + v) <= bound,
        "no shorts": lambda: ~F.coalesce(F.exists(values(), lambda v: v < 0), F.lit(False)),
    }
    return F.coalesce(conditions[kind](), F.lit(False))


def _find(schema: StructType, path: str) -> DataType | None:
    at: DataType = schema
    for part in path.split(".") if path else []:
        if not isinstance(at, StructType) or part not in at.names:
            return None
        at = at[part].dataType
    return at


def _numbered(path: str, broken: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda x, i: broken(x, F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]: ")))


def section_errors(cards: DataFrame, rules: Sequence[Rule] = SECTION_RULES) -> DataFrame:
    """``errors``: the rules that a card's sections break, as "path: rule" or "path[i]: rule".

    A section that a card lacks, or that the table has no column for, breaks none; a field that a
    section lacks is blank.
    """
    nothing = F.array().cast("array<string>")
    by_path: dict[str, list[Rule]] = {}
    for rule in rules:
        by_path.setdefault(rule.path, []).append(rule)
    found = []
    for path, held in by_path.items():
        kind = _find(cards.schema, path)
        struct = kind.elementType if isinstance(kind, ArrayType) else kind
        if not isinstance(struct, StructType):
            continue

        def broken(item: Column | None, where: Column, held=held, struct=struct) -> Column:
            def at(field: str) -> tuple[Column, DataType | None]:
                if field not in struct.names:
                    return F.lit(None).cast("string"), None
                return (F.col(field) if item is None else item[field]), struct[field].dataType

            def bad(r: Rule) -> Column:
                fails = ~_condition(at, r.field, r.kind, r.bound)
                return fails & _condition(at, *r.when) if r.when else fails

            return F.array_compact(F.array(*[F.when(bad(r), F.concat(where, F.lit(r.message))) for r in held]))

        if not path:
            found.append(broken(None, F.lit("")))
        elif isinstance(kind, ArrayType):
            found.append(F.coalesce(F.flatten(F.transform(F.col(path), _numbered(path, broken))), nothing))
        else:
            found.append(F.when(F.col(path).isNotNull(), broken(F.col(path), F.lit(f"{path}: "))).otherwise(nothing))
    return cards.withColumn("errors", F.concat(*found) if found else nothing)


# -- requirements -------------------------------------------------------------------------

# Words by which a field of a strategy shows what it reads or does.  A blank stands for any blanks, "-" for one
# character or none, "(s)" for a plural, "*" for any ending.
FAMILIES = {
    "cap weights": ("cap-weight*", "free-float*", "market cap*", "mcap", "size decile*", "size factor*", "size sort*", "value-weight*"),
    "cash": ("cash", "deposit(s)", "mibor", "overnight rate", "repo", "rf", "risk-free", "t-bill(s)", "yield(s)"),
    "fundamentals": (
        "accrual(s)", "asset(s)", "b / m", "balance sheet", "book equity", "book to market", "book value", "cash flow*", "debt", "dividend yield*", "earnings", "ebit", "ebitda", "eps", "fundamental(s)", "margin(s)",
        "p / b", "p / e", "payout", "profit(s)", "revenue", "roa", "roc", "roe", "sales", "shareholder equity", "shareholders equity", "valuation",
    ),
    "momentum": ("52-week", "breakout", "momentum", "reversal(s)", "trend"),
    "prices": ("beta", "close", "momentum", "price(s)", "return(s)", "reversal", "volatilities", "volatility"),
    "risk weights": ("covariance", "inverse-vol*", "risk contribution*", "risk parity"),
    "volume": ("adv", "amihud", "illiquidity", "liquidity", "traded value", "turnover", "volume(s)"),
}
FAST, THIN = ("daily", "weekly"), ("micro", "mid_small", "small")
SLEEVES = "NSE factor sleeves"


def family_pattern(words: Sequence[str]) -> str:
    """One regular expression for a family of words, for lower-cased text."""
    marks = {" ": r"\s*", "-": ".?", "*": r"\w*"}
    plain = lambda w: "".join(marks.get(ch) or re.escape(ch) for ch in w)
    return r"\b(" + "|".join(plain(w.removesuffix("(s)")) + ("s?" if w.endswith("(s)") else "") for w in words) + r")\b"


class Requirement(NamedTuple):
    """``item`` may name facts in braces.  ``holds`` is a fact, ("family", name, fact), ("in", fact, values), or all, any and not of such."""

    rule_id: str
    category: str
    blocking: bool
    item: str
    holds: Any


_FUNDAMENTAL = ("family", "fundamentals", "reads")
_VOLUME = ("family", "volume", "inputs")
#: By category in alphabetical order.
STOCK_RULES = (
    Requirement("breakeven", "cost", False, "the cost at which the edge is gone, reported beside the result", ("all",)),
    Requirement("sleeve_floor", "cost", True, "30 basis points a round trip, the floor of sleeve rotation", "sleeves"),
    Requirement("stock_costs", "cost", True, "the desk's own present cost stack for single stocks: taxes, duty, charges, brokerage and impact", ("not", "sleeves")),
    Requirement("adv_read", "data", True, "daily traded value by name", _VOLUME),
    Requirement("adv_capacity", "data", False, "daily traded value by name", ("all", "cross_sectional", ("not", _VOLUME))),
    Requirement("final_values", "data", True, "the last traded or settled value of names that left", "cross_sectional"),
    Requirement("free_float", "data", True, "free-float market capitalisation, not total", ("family", "cap weights", "does")),
    Requirement("held_sleeves", "data", False, "daily closes of the sleeves, which are held: price returns, filled backwards", ("all", "sleeves", ("not", "cross_sectional"))),
    Requirement("membership", "data", True, "membership of {universe} as it was on each day", "cross_sectional"),
    Requirement("missing_series", "data", True, "series that are not held: {missing}", "has_missing"),
    Requirement("publication_dates", "data", True, "for every fundamental the period it covers and the day it became public", _FUNDAMENTAL),
    Requirement("restatements", "data", False, "whether fundamentals are as first reported or as restated", _FUNDAMENTAL),
    Requirement("short_rate", "data", False, "a local short rate, overnight or 91 days", ("any", ("family", "cash", "all_text"), "allow_cash")),
    Requirement("stock_closes", "data", True, "daily closes of every constituent of {universe}, adjusted for corporate actions", "cross_sectional"),
    Requirement("fast_trading", "execution", True, "an execution model for a {rebalance} rebalance", ("in", "rebalance", FAST)),
    Requirement("halts", "execution", False, "price bands and trading halts", ("family", "momentum", "does")),
    Requirement("impact", "execution", True, "an impact model for the {segment} segment instead of a flat spread", ("any", ("in", "segment", THIN), ("all", "cross_sectional", ("in", "segment", ("all",))))),
    Requirement("leg_returns", "execution", False, "what each leg of the source earned", "is_long_short"),
    Requirement("filing_lag", "timing", True, "a lag longer than the filing lag, from publication dates", _FUNDAMENTAL),
    Requirement("reconstitution", "timing", False, "the reconstitution dates of the universe", "cross_sectional"),
    Requirement("signal_lag", "timing", True, "a lag of a day or more on what is built from a close", ("all",)),
    Requirement("backfill", "validity", False, "filled-back history does not carry a live claim", ("all",)),
    Requirement("fiscal_dates", "validity", True, "fundamentals aligned to the end of their period spoil the test", _FUNDAMENTAL),
    Requirement("raw_prices", "validity", True, "unadjusted prices spoil the test", "cross_sectional"),
    Requirement("survivors", "validity", True, "a file of survivors spoils the test", "cross_sectional"),
)


def _facts(cards: DataFrame) -> dict[str, Column]:
    """What rules may ask of a strategy; missing fields are blank, false or empty."""

    def field(path: str, empty: Any, kind: str = "string") -> Column:
        return F.coalesce(F.col(path), F.lit(empty).cast(kind)) if _find(cards.schema, path) is not None else F.lit(empty).cast(kind)

    inputs = F.coalesce(F.col("strategy.inputs_required"), F.array().cast("array<string>")) if _find(cards.schema, "strategy.inputs_required") is not None else F.array().cast("array<string>")
    missing = F.coalesce(F.col("missing"), F.array().cast("array<string>")) if "missing" in cards.columns else F.array().cast("array<string>")
    signal = field("strategy.signal_definition", "")
    names = F.concat_ws(" ", inputs)
    does = F.concat_ws(" ", field("strategy.weighting_rule", ""), field("strategy.formation_rule", ""), signal)
    own = field("strategy.rebalance_frequency", "")
    universe = field("universe_translation.target_universe", "")
    return {
        "inputs": F.lower(names), "reads": F.lower(F.concat_ws(" ", names, signal)), "does": F.lower(does), "all_text": F.lower(F.concat_ws(" ", names, signal, does)), "each_input": inputs,
        "cross_sectional": field("strategy.cross_sectional", False, "boolean"), "is_long_short": field("strategy.is_long_short", False, "boolean"), "allow_cash": field("portfolio.allow_cash", False, "boolean"),
        "rebalance": F.lower(F.when(own != "", own).otherwise(field("portfolio.rebalance", ""))), "segment": field("universe_translation.mechanism_needs.cap_segment", "all"),
        "universe": F.when(universe == "", "the universe, which is not chosen").otherwise(universe), "sleeves": universe == SLEEVES, "missing": F.array_join(missing, ", "), "has_missing": F.size(missing) > 0,
    }


def _tree(node: Any, facts: dict[str, Column]) -> Column:
    if isinstance(node, str):
        return facts[node]
    kind, *rest = node
    if kind == "family":
        return F.regexp_like(facts[rest[1]], F.lit(family_pattern(FAMILIES[rest[0]])))
    if kind == "in":
        return facts[rest[0]].isin(*rest[1])
    if kind == "not":
        return ~_tree(rest[0], facts)
    out = F.lit(kind == "all")
    for part in rest:
        out = (out & _tree(part, facts)) if kind == "all" else (out | _tree(part, facts))
    return out


def _worded(item: str, facts: dict[str, Column]) -> Column:
    parts = re.split(r"\{(\w+)\}", item)
    return F.concat(*[facts[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def requirements(cards: DataFrame, rules: Sequence[Requirement] = STOCK_RULES) -> DataFrame:
    """(card_id, rule_id, category, item, blocking, source, page): what each card's strategy needs.

    Stock rules follow from the strategy and cannot be argued away (source ``rules``); the card's
    ``local_notes`` add to them and never block (source ``model``, rule_id null).
    """
    facts = _facts(cards)
    row = lambda r: F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), _worded(r.item, facts).alias("item"), F.lit(r.blocking).alias("blocking"), F.lit("rules").alias("source"), F.lit(None).cast("int").alias("page"))
    rows = F.array_compact(F.array(*[F.when(_tree(r.holds, facts), row(r)) for r in rules]))
    if "local_notes" in cards.columns:
        notes = F.transform("local_notes", lambda n: F.struct(F.lit(None).cast("string").alias("rule_id"), n["category"].alias("category"), n["item"].alias("item"), F.lit(False).alias("blocking"), F.lit("model").alias("source"), n["evidence_page"].cast("int").alias("page")))
        rows = F.concat(rows, F.coalesce(notes, F.slice(rows, 1, 0)))
    return cards.select("card_id", F.explode(rows).alias("r")).select("card_id", "r.*")


def unread_inputs(cards: DataFrame) -> DataFrame:
    """(card_id, input, addressed): the strategy's inputs that no family of words reads, and whether a note names them.

    Only what a note declares in ``addresses`` counts: one of the two texts holds the other.
    """
    known = F.lit("|".join(family_pattern(FAMILIES[k]) for k in ("prices", "fundamentals", "volume", "cash")))
    out = cards.select("card_id", F.explode(_facts(cards)["each_input"]).alias("input"), *(["local_notes"] if "local_notes" in cards.columns else []))
    out = out.where(~F.regexp_like(F.lower("input"), known))
    if "local_notes" not in cards.columns:
        return out.withColumn("addressed", F.lit(False))
    claims = F.filter(F.flatten(F.transform("local_notes", lambda n: F.coalesce(n["addresses"], F.array().cast("array<string>")))), lambda a: F.trim(a) != "")
    low = F.lower("input")
    named = F.exists(claims, lambda a: low.contains(F.lower(F.trim(a))) | F.lower(F.trim(a)).contains(low))
    return out.select("card_id", "input", F.coalesce(named, F.lit(False)).alias("addressed"))


# -- facts --------------------------------------------------------------------------------

# The groups of a card in the order of reading, and flags in the order of a decision sheet.
GROUPS = ("PAPER", "UNIVERSE", "SIGNAL", "PORTFOLIO", "COSTS", "DATA", "SECURITIES", "THE RUN", "THE BAR", "RISKS", "VERDICT", "DECIDE", "ASKS")
FLAGS = ("BLOCK", "DECIDE", "GUESS")


class Fact(NamedTuple):
    """One line a card shows: ``value`` of ``path`` (each item, where that is an array), the argument behind it, who owns it.

    ``flags`` are (flag, field, kind, bound), conditions as in :class:`Rule`; the first that holds
    counts.  ``owner`` is a role, or "." and the field that names one.
    """

    group: str
    label: str
    path: str
    value: str
    detail: str = ""
    owner: str = ""
    flags: tuple[tuple[str, str, str, Any], ...] = ()
    page: str = "evidence_page"


FACTS = (
    Fact("UNIVERSE", "target", "universe_translation", "target_universe", "rationale", "pm", (("DECIDE", "grade", "among", ("loose", "close")), ("BLOCK", "grade", "equal", "none"))),
    Fact("SIGNAL", "definition", "strategy", "signal_definition", "formation_rule", "researcher", (("GUESS", "confidence", "equal", "low"),)),
    Fact("PORTFOLIO", "weights", "strategy", "weighting_rule", "", "pm", (("DECIDE", "is_long_short", "true", None),)),
    Fact("DATA", "field", "data_plan.ideal", "field", "why", "data_owner", (("DECIDE", "minimum_viable", "true", None),)),
    Fact("SECURITIES", "rule", "selection", "rule", "why_these", "researcher", (("GUESS", "verified_against", "equal", "UNVERIFIED"),)),
    Fact("THE RUN", "first day", "backtest_plan", "sample_start", "why_this_window", "researcher"),
    Fact("THE BAR", "failure", "backtest_plan", "failure_looks_like", "", "pm"),
    Fact("RISKS", "reading", "ambiguities", "field", "resolution", "researcher", (("DECIDE", "material", "true", None), ("GUESS", "confidence", "equal", "low"))),
    Fact("VERDICT", "convertible", "convertibility", "verdict", "weakest_link", "pm", (("DECIDE", "verdict", "other than", "convertible"),)),
    Fact("ASKS", "question", "open_questions", "question", "what_i_assumed", ".ask_of", (("BLOCK", "blocks_run", "true", None), ("DECIDE", "question", "text", None))),
    Fact("ASKS", "request", "data_requests", "item", "without_it", "data_owner", (("BLOCK", "priority", "equal", "blocking"), ("DECIDE", "item", "text", None))),
)
_FACT = "struct<group:string,label:string,value:string,detail:string,owner:string,flag:string,page:int,ref:string>"


def _counted(cards: DataFrame) -> list[Column]:
    """Facts that no field states: how many of a card's items are of a kind."""
    out = []

    def share(group: str, label: str, path: str, keep: Callable[[Column], Column]) -> None:
        if isinstance(_find(cards.schema, path), ArrayType):
            items = F.col(path)
            value = F.concat(F.size(F.filter(items, keep)).cast("string"), F.lit(" of "), F.size(items).cast("string"))
            row = F.struct(F.lit(group).alias("group"), F.lit(label).alias("label"), value.alias("value"), F.lit("").alias("detail"), F.lit("").alias("owner"), F.lit("").alias("flag"), F.lit(None).cast("int").alias("page"), F.lit(path).alias("ref"))
            out.append(F.when(F.size(items) > 0, F.array(row.cast(_FACT))).otherwise(F.array().cast(f"array<{_FACT}>")))

    share("DATA", "smallest honest set", "data_plan.ideal", lambda d: F.coalesce(d["minimum_viable"], F.lit(False)))
    share("RISKS", "material readings", "ambiguities", lambda a: F.coalesce(a["material"], F.lit(False)))
    share("ASKS", "blocking requests", "data_requests", lambda r: F.coalesce(r["priority"] == "blocking", F.lit(False)))
    return out


def card_facts(cards: DataFrame, layout: Sequence[Fact] = FACTS) -> DataFrame:
    """(card_id, group, label, value, detail, owner, flag, page, ref): every card as displayable lines; blank values have none.

    Runs of blanks in values and details become one; ``ref`` names the field that the line is from.
    """
    empty, found = F.array().cast(f"array<{_FACT}>"), []
    for fact in layout:
        kind = _find(cards.schema, fact.path)
        struct = kind.elementType if isinstance(kind, ArrayType) else kind
        if not isinstance(struct, StructType) or fact.value not in struct.names:
            continue

        def line(item: Column, ref: Column, fact=fact, struct=struct) -> Column:
            at = lambda field: (item[field], struct[field].dataType) if field in struct.names else (F.lit(None).cast("string"), None)
            flag = F.coalesce(*[F.when(_condition(at, *rest), F.lit(name)) for name, *rest in fact.flags], F.lit(""))
            owner = _clean(at(fact.owner[1:])[0]) if fact.owner.startswith(".") else F.lit(fact.owner)
            return F.struct(
                F.lit(fact.group).alias("group"), F.lit(fact.label).alias("label"), _clean(at(fact.value)[0]).alias("value"), _clean(at(fact.detail)[0]).alias("detail"), owner.alias("owner"), flag.alias("flag"),
                at(fact.page)[0].cast("int").alias("page"), ref.alias("ref"),
            ).cast(_FACT)

        if isinstance(kind, ArrayType):
            found.append(F.coalesce(F.transform(F.col(fact.path), _placed(fact, line)), empty))
        else:
            found.append(F.when(F.col(fact.path).isNotNull(), F.array(line(F.col(fact.path), F.lit(f"{fact.path}.{fact.value}")))).otherwise(empty))
    lines = F.concat(*found, *_counted(cards)) if found else empty
    return cards.select("card_id", F.explode(lines).alias("f")).select("card_id", "f.*").where("value != ''")


def _placed(fact: Fact, line: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda x, i: line(x, F.concat(F.lit(f"{fact.path}["), i.cast("string"), F.lit(f"].{fact.value}")))


def flagged_facts(facts: DataFrame) -> DataFrame:
    """A decision sheet: flagged lines with their ``place`` on the card's sheet, what blocks first, then by group."""
    rank = lambda c, names: F.array_position(F.array(*[F.lit(x) for x in names]), F.col(c))
    order = Window.partitionBy("card_id").orderBy(rank("flag", FLAGS), rank("group", GROUPS), "ref")
    return facts.where("flag != ''").withColumn("place", F.row_number().over(order))


# -- review queue -------------------------------------------------------------------------


def review_items(cards: DataFrame, resolved: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """(card_id, reason, item, owner): what people have to look at, from six sources, once each.

    Low-confidence and material ambiguities, targets stated on several bases, open questions (to
    whom they are asked), blocking data requests, and, where given, proxies and degraded series of
    ``resolved(card_id, name, status)`` and material ``findings(card_id, item, material)``.  An item
    that several sources name stands once, under the first of these reasons.
    """
    parts = []

    def add(reason: str, rows: DataFrame, item: Column, owner: Column) -> None:
        parts.append(rows.select("card_id", F.lit(len(parts)).alias("rank"), F.lit(reason).alias("reason"), item.alias("item"), owner.alias("owner")))

    def items(section: str, keep: Callable[[Column], Column]) -> DataFrame | None:
        if section not in cards.columns:
            return None
        return cards.select("card_id", F.explode(F.filter(section, keep)).alias("x"))

    low = items("ambiguities", lambda a: a["confidence"] == "low")
    material = items("ambiguities", lambda a: F.coalesce(a["material"], F.lit(False)))
    if low is not None:
        add("read with low confidence", low, F.col("x.field"), F.lit("researcher"))
        add("material choice", material, F.col("x.field"), F.lit("pm"))
    if "replication_targets" in cards.columns:
        targets = cards.select("card_id", F.explode("replication_targets").alias("x"))
        several = targets.groupBy("card_id", "x.portfolio", "x.metric").agg(F.countDistinct("x.basis").alias("n")).where("n > 1")
        add("stated on several bases", several, F.concat_ws(" / ", "portfolio", "metric"), F.lit("researcher"))
    asked = items("open_questions", lambda q: F.length(F.trim(F.coalesce(q["question"], F.lit("")))) > 0)
    if asked is not None:
        add("open question", asked, F.col("x.question"), F.col("x.ask_of"))
    wanted = items("data_requests", lambda r: r["priority"] == "blocking")
    if wanted is not None:
        add("blocking request", wanted, F.col("x.item"), F.lit("data_owner"))
    if resolved is not None:
        add("stand-in series", resolved.where(F.col("status").isin("PROXY", "DEGRADED")), F.col("name"), F.lit("data_owner"))
    if findings is not None:
        add("material finding", findings.where("material"), F.col("item"), F.lit("pm"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    once = out.groupBy("card_id", "item").agg(F.min(F.struct("rank", "reason", "owner")).alias("first"))
    return once.select("card_id", "first.reason", "item", "first.owner")
