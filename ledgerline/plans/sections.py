"""Registered queries on whole cards: section rules, requirements of strategies, the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import card_rules, evidence, feasibility, rules
from ledgerline.plans import tables as t
from ledgerline.plans.queries import query, r6

_INPUTS = ("book value of equity", "traded value per day", "closing prices", "promoter pledge share", "t-bill yields", "analyst breadth")


def _items(n: Column, *fields) -> Column:
    """An array of ``n`` structs, each field a function of the item's number from 1."""
    numbers = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.struct(*[f(i) for f in fields]))


def _unless(blank: Column, text: Column | str = "x") -> Column:
    return F.when(blank, F.lit("  ")).otherwise(F.lit(text) if isinstance(text, str) else text)


def whole_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cards with every section, filled and spoilt by their keys."""
    k = F.col("s_suppkey")
    pick = lambda n: F.element_at(F.array(*[F.lit(x) for x in _INPUTS]), (n % 6 + 1).cast("int"))
    ambiguities = _items(
        k % 4, lambda i: F.concat(F.lit("f"), i.cast("string")).alias("field"), lambda i: F.repeat(F.lit("h"), (70 + (k * i) % 50).cast("int")).alias("headline"),
        lambda i: F.when((k + i) % 5 == 0, "certain").when((k + i) % 2 == 0, "low").otherwise("high").alias("confidence"), lambda i: _unless((k + i) % 3 == 0).alias("resolution"), lambda i: (i == 2).alias("material"),
    )
    requests = _items(
        k % 3, lambda i: _unless((k + 2 * i) % 7 == 0, F.concat(F.lit("series "), i.cast("string"))).alias("item"), lambda i: F.when((k + i) % 4 == 0, "whenever").when((k + i) % 4 == 1, "blocking").otherwise("high").alias("priority"),
        lambda i: _unless((k * i) % 5 == 0).alias("without_it"),
    )
    questions = _items(
        (k + 1) % 3, lambda i: F.concat(F.lit("q"), i.cast("string")).alias("question"), lambda i: F.when((k + i) % 6 == 0, "nobody").otherwise("pm").alias("ask_of"), lambda i: (i == 2).alias("blocks_run"), lambda i: _unless((k + i) % 2 == 0).alias("what_i_assumed"),
    )
    ideal = _items(
        k % 4, lambda i: F.concat(F.lit("d"), i.cast("string")).alias("field"), lambda i: F.when((k + i) % 5 == 0, "yearly").otherwise("daily").alias("granularity"), lambda i: _unless((k + i) % 6 == 0).alias("why"),
        lambda i: _unless((k + i) % 7 == 0).alias("why_granularity"), lambda i: (i == 2).alias("minimum_viable"),
    )
    plan = F.struct(ideal.alias("ideal"), _unless(k % 5 == 0).alias("optimality_argument"), _items(k % 2, lambda i: F.lit("o").alias("option"), lambda i: _unless(k % 11 == 1).alias("why_not")).alias("rejected_alternatives"))
    selection = F.struct(
        _unless(k % 8 == 0).alias("rule"), F.when(k % 2 == 0, F.array(F.lit("A"))).otherwise(F.array().cast("array<string>")).alias("explicit_securities"), F.when(k % 4 == 0, "memory").when(k % 4 == 2, "paper").alias("verified_against"), _unless(k % 6 == 0).alias("as_of"),
    )
    strategy = F.struct(
        F.when(k % 9 == 0, "sure").otherwise("high").alias("confidence"), F.when(k % 4 == 0, "rank by momentum over a year").when(k % 4 == 1, "earnings over price").when(k % 4 == 2, "a plain spread").otherwise(" ").alias("signal_definition"), (k % 2 == 1).alias("is_long_short"),
        _unless(k % 3 == 1).alias("long_only_adaptation"), F.when(k % 5 == 0, "NEEDS_NEW_TEMPLATE").otherwise("equal_weight").alias("engine_template"), _unless(k % 10 == 0).alias("template_gap"), F.array(pick(k), pick(k * 5 + 1)).alias("inputs_required"),
        F.when(k % 3 == 0, "value-weighted").otherwise("equal").alias("weighting_rule"), F.lit("top decile").alias("formation_rule"), (k % 2 == 0).alias("cross_sectional"), F.when(k % 5 == 0, "Daily").when(k % 5 == 1, "weekly").otherwise("").alias("rebalance_frequency"),
    )
    needs = F.struct(F.when(k % 5 == 0, "tiny").when(k % 5 == 1, "small").otherwise("all").alias("cap_segment"), (k % 9).cast("int").alias("min_names"))
    translation = F.struct(
        _unless(k % 5 == 1).alias("source_universe"), F.when(k % 4 == 0, "exact").when(k % 4 == 1, "none").when(k % 4 == 3, "fair").otherwise("").alias("grade"), F.when(k % 6 == 0, "").when(k % 4 == 1, card_rules.SLEEVES).otherwise("NIFTY 500").alias("target_universe"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("r"))).alias("transfer_risks"), needs.alias("mechanism_needs"),
    )
    convertible = F.struct(F.when(k % 3 == 0, "maybe").otherwise("mechanism_only").alias("verdict"), F.lit("medium").alias("confidence"), F.array_repeat(F.lit("m"), (k % 4).cast("int")).alias("what_must_be_true"), _unless(k % 5 == 0).alias("weakest_link"))
    test = F.struct(
        F.lit("2005").alias("sample_start"), _unless(k % 7 == 0).alias("sample_end"), F.lit("monthly").alias("rebalance_rule"), _unless(k % 4 == 2).alias("weights_rule"), _unless(k % 9 == 2).alias("why_this_window"), F.lit("wins").alias("success_looks_like"), _unless(k % 13 == 0).alias("failure_looks_like"),
        F.create_map(F.lit("A"), 0.5 + (k % 8) / 10, F.lit("B"), F.when(k % 10 == 0, -0.1).otherwise(0.2)).alias("explicit_weights"), _items(k % 2, lambda i: F.lit("b").alias("name"), lambda i: _unless(k % 6 == 3).alias("why_this")).alias("benchmarks"),
    )
    note = F.struct(F.when(k % 2 == 0, "data").otherwise("taste").alias("category"), F.lit("pledges").alias("item"), F.lit("they lead prices").alias("why"), _unless(k % 9 == 0).alias("triggered_by"), F.array(F.lit(" Promoter pledge ")).alias("addresses"), (k % 50).cast("int").alias("evidence_page"))
    targets = _items(k % 3, lambda i: F.lit("all").alias("portfolio"), lambda i: F.lit("cagr").alias("metric"), lambda i: F.concat(F.lit("b"), (i % 2).cast("string")).alias("basis"))
    intent = F.struct(F.when(k % 2 == 0, "adaptation").otherwise("replication").alias("mode"), F.when(k % 4 > 1, F.array(F.lit("liquidity"))).alias("broken_assumptions"))
    return t.table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("card_id"), intent.alias("intent"), ambiguities.alias("ambiguities"), requests.alias("data_requests"), questions.alias("open_questions"), F.when(k % 3 > 0, plan).alias("data_plan"), selection.alias("selection"), strategy.alias("strategy"),
        F.when(k % 7 > 0, translation).alias("universe_translation"), F.when(k % 2 == 1, convertible).alias("convertibility"), F.when(k % 3 != 1, test).alias("backtest_plan"), F.when(k % 3 == 0, F.array(note)).otherwise(F.array().cast("array<struct<category:string,item:string,why:string,triggered_by:string,addresses:array<string>,evidence_page:int>>")).alias("local_notes"),
        F.struct(F.lit("monthly").alias("rebalance"), (k % 3 == 0).alias("allow_cash")).alias("portfolio"), (k % 10).cast("int").alias("n_configs_tried"), targets.alias("replication_targets"), F.when(k % 17 == 0, F.array(F.lit("vix"), F.lit("repo"))).alias("missing"),
    )


_S = "s AS (SELECT s_suppkey::VARCHAR AS card_id, s_suppkey AS k FROM supplier)"
_NUMBERED = f"{_S}, n AS (SELECT card_id, k, unnest([1, 2, 3]) AS i FROM s)"
#: Where a rule is broken: path, rows (items 1 to n of a card, or the card), condition, message.
_BROKEN = (
    ("ambiguities", "i <= k % 4", "(k * i) % 50 > 30", "the headline fits one line"), ("ambiguities", "i <= k % 4", "(k + i) % 5 = 0", "the confidence is high, medium or low"), ("ambiguities", "i <= k % 4", "(k + i) % 3 = 0", "it is resolved before the run"),
    ("data_requests", "i <= k % 3", "(k + 2 * i) % 7 = 0", "what is asked for is named"), ("data_requests", "i <= k % 3", "(k + i) % 4 = 0", "the priority is a known one"), ("data_requests", "i <= k % 3", "(k * i) % 5 = 0", "there is a fallback"),
    ("open_questions", "i <= (k + 1) % 3", "(k + i) % 6 = 0", "who is asked is a known role"), ("open_questions", "i <= (k + 1) % 3", "i <> 2 AND (k + i) % 2 = 0", "it blocks the run or has a working assumption"),
    ("data_plan.ideal", "k % 3 > 0 AND i <= k % 4", "(k + i) % 5 = 0", "the granularity is a known one"), ("data_plan.ideal", "k % 3 > 0 AND i <= k % 4", "(k + i) % 6 = 0", "the need is stated"), ("data_plan.ideal", "k % 3 > 0 AND i <= k % 4", "(k + i) % 7 = 0", "the granularity is argued"),
    ("data_plan.rejected_alternatives", "k % 3 > 0 AND i <= k % 2", "k % 11 = 1", "the rejection is argued"), ("local_notes", "k % 3 = 0 AND i = 1", "k % 2 = 1", "the category is a known one"), ("local_notes", "k % 3 = 0 AND i = 1", "k % 9 = 0", "what raised it is named"),
    ("backtest_plan.benchmarks", "k % 3 <> 1 AND i <= k % 2", "k % 6 = 3", "it has a reason"),
    ("data_plan", "", "k % 3 > 0 AND k % 4 = 0", "the deserved data set is designed"), ("data_plan", "", "k % 3 > 0 AND k % 5 = 0", "the data set is argued"), ("data_plan", "", "k % 3 > 0 AND k % 4 = 1", "the smallest honest set is marked"),
    ("selection", "", "k % 8 = 0", "securities are chosen by a rule"), ("selection", "", "k % 4 = 0", "a named list says what confirmed it"), ("selection", "", "k % 2 = 0 AND k % 6 = 0", "a named list has a date"),
    ("strategy", "", "k % 9 = 0", "the confidence is high, medium or low"), ("strategy", "", "k % 4 = 3", "the signal is defined"), ("strategy", "", "k % 2 = 1 AND k % 3 = 1", "a long-short source is adapted to long only"), ("strategy", "", "k % 10 = 0", "a missing template is specified"),
    ("universe_translation", "", "k % 7 > 0 AND k % 5 = 1", "the source universe is named"), ("universe_translation", "", "k % 7 > 0 AND k % 4 = 3", "the grade is a known one"), ("universe_translation", "", "k % 7 > 0 AND k % 6 = 0 AND k % 4 IN (0, 3)", "a graded translation has a target"),
    ("universe_translation", "", "k % 7 > 0 AND k % 6 > 0 AND k % 3 = 0", "a translation names its risks"), ("universe_translation.mechanism_needs", "", "k % 7 > 0 AND k % 5 = 0", "the segment is a known one"), ("universe_translation.mechanism_needs", "", "k % 7 > 0 AND k % 9 = 0", "a name or more is needed"),
    ("convertibility", "", "k % 2 = 1 AND k % 3 = 0", "the verdict is a known one"), ("convertibility", "", "k % 2 = 1 AND k % 4 < 2", "the chain has two links or more"), ("convertibility", "", "k % 2 = 1 AND k % 5 = 0", "the weakest link is named"),
    ("backtest_plan", "", "k % 3 <> 1 AND k % 7 = 0", "the last day is stated"), ("backtest_plan", "", "k % 3 <> 1 AND k % 4 = 2", "the weights rule is stated"), ("backtest_plan", "", "k % 3 <> 1 AND k % 9 = 2", "the window is argued"), ("backtest_plan", "", "k % 3 <> 1 AND k % 2 = 0", "a benchmark is named"),
    ("backtest_plan", "", "k % 3 <> 1 AND k % 13 = 0", "failure is defined"), ("backtest_plan", "", "k % 3 <> 1 AND 0.5 + (k % 8) / 10 + CASE WHEN k % 10 = 0 THEN -0.1 ELSE 0.2 END > 1.00001", "weights are not levered"), ("backtest_plan", "", "k % 3 <> 1 AND k % 10 = 0", "no weight is short"),
    ("", "", "k % 10 = 0", "a config or more was tried"),
)
_BROKEN_SQL = " UNION ALL ".join(
    f"SELECT card_id, '{p}[' || (i - 1) || ']: {m}' AS error FROM n WHERE {rows} AND {cond}" if rows else f"SELECT card_id, '{p + ': ' if p else ''}{m}' AS error FROM s WHERE {cond}" for p, rows, cond, m in _BROKEN
)


@query(f"WITH {_NUMBERED} {_BROKEN_SQL}")
def card_section_errors(spark, sf_dir):
    """Every rule that a section or an item of a section breaks, over all suppliers' cards."""
    return card_rules.section_errors(whole_cards(spark, sf_dir)).select("card_id", F.explode("errors").alias("error"))


_FACTS = f"""{_S}, f AS (SELECT card_id, k, [{", ".join(f"'{x}'" for x in _INPUTS)}][1 + k % 6] AS a, [{", ".join(f"'{x}'" for x in _INPUTS)}][1 + (k * 5 + 1) % 6] AS b, k % 2 = 0 AS cross_,
        CASE WHEN k % 7 = 0 OR k % 6 = 0 THEN '' WHEN k % 4 = 1 THEN 'NSE factor sleeves' ELSE 'NIFTY 500' END AS target, CASE WHEN k % 7 = 0 THEN 'all' WHEN k % 5 = 0 THEN 'tiny' WHEN k % 5 = 1 THEN 'small' ELSE 'all' END AS segment, CASE k % 5 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS reb FROM s),
    g AS (SELECT *, target = 'NSE factor sleeves' AS sleeves, CASE WHEN target = '' THEN 'the universe, which is not chosen' ELSE target END AS universe, a LIKE 'book value%' OR b LIKE 'book value%' OR k % 4 = 1 AS fund, a LIKE 'traded value%' OR b LIKE 'traded value%' AS vol, a LIKE 't-bill%' OR b LIKE 't-bill%' AS bills FROM f)"""
#: Rule, category, whether it blocks, item in SQL, where it applies.
_NEEDED = (
    ("breakeven", "cost", False, "'the cost at which the edge is gone, reported beside the result'", "true"), ("sleeve_floor", "cost", True, "'30 basis points a round trip, the floor of sleeve rotation'", "sleeves"),
    ("stock_costs", "cost", True, "'the desk''s own present cost stack for single stocks: taxes, duty, charges, brokerage and impact'", "NOT sleeves"), ("adv_read", "data", True, "'daily traded value by name'", "vol"), ("adv_capacity", "data", False, "'daily traded value by name'", "cross_ AND NOT vol"),
    ("final_values", "data", True, "'the last traded or settled value of names that left'", "cross_"), ("free_float", "data", True, "'free-float market capitalisation, not total'", "k % 3 = 0"), ("held_sleeves", "data", False, "'daily closes of the sleeves, which are held: price returns, filled backwards'", "sleeves AND NOT cross_"),
    ("membership", "data", True, "'membership of ' || universe || ' as it was on each day'", "cross_"), ("missing_series", "data", True, "'series that are not held: vix, repo'", "k % 17 = 0"), ("publication_dates", "data", True, "'for every fundamental the period it covers and the day it became public'", "fund"),
    ("restatements", "data", False, "'whether fundamentals are as first reported or as restated'", "fund"), ("short_rate", "data", False, "'a local short rate, overnight or 91 days'", "bills OR k % 3 = 0"), ("stock_closes", "data", True, "'daily closes of every constituent of ' || universe || ', adjusted for corporate actions'", "cross_"),
    ("fast_trading", "execution", True, "'an execution model for a ' || reb || ' rebalance'", "reb IN ('daily', 'weekly')"), ("halts", "execution", False, "'price bands and trading halts'", "k % 4 = 0"), ("impact", "execution", True, "'an impact model for the ' || segment || ' segment instead of a flat spread'", "segment = 'small' OR (cross_ AND segment = 'all')"),
    ("leg_returns", "execution", False, "'what each leg of the source earned'", "k % 2 = 1"), ("filing_lag", "timing", True, "'a lag longer than the filing lag, from publication dates'", "fund"), ("reconstitution", "timing", False, "'the reconstitution dates of the universe'", "cross_"),
    ("signal_lag", "timing", True, "'a lag of a day or more on what is built from a close'", "true"), ("backfill", "validity", False, "'filled-back history does not carry a live claim'", "true"), ("fiscal_dates", "validity", True, "'fundamentals aligned to the end of their period spoil the test'", "fund"),
    ("raw_prices", "validity", True, "'unadjusted prices spoil the test'", "cross_"), ("survivors", "validity", True, "'a file of survivors spoils the test'", "cross_"),
)
_NEEDED_SQL = " UNION ALL ".join(f"SELECT card_id, '{r}' AS rule_id, '{c}' AS category, {i} AS item, {str(b).lower()} AS blocking, 'rules' AS source, NULL::INT AS page FROM g WHERE {w}" for r, c, b, i, w in _NEEDED)


@query(f"WITH {_FACTS} {_NEEDED_SQL} UNION ALL SELECT card_id, NULL, CASE WHEN k % 2 = 0 THEN 'data' ELSE 'taste' END, 'pledges', false, 'model', (k % 50)::INT FROM s WHERE k % 3 = 0")
def card_requirements(spark, sf_dir):
    """What each card's strategy needs by the stock rules, and what its notes add."""
    return card_rules.requirements(whole_cards(spark, sf_dir))


@query(f"WITH {_FACTS}, u AS (SELECT card_id, k, unnest([a, b]) AS input FROM g) SELECT card_id, input, k % 3 = 0 AND input LIKE 'promoter%' AS addressed FROM u WHERE input LIKE 'promoter%' OR input LIKE 'analyst%'")
def unread_strategy_inputs(spark, sf_dir):
    return card_rules.unread_inputs(whole_cards(spark, sf_dir))


_QUEUE = f"""{_NUMBERED}, {t.FEASIBILITY_SQL}, q(card_id, rank, reason, item, owner) AS (
    SELECT card_id, 0, 'read with low confidence', 'f' || i, 'researcher' FROM n WHERE i <= k % 4 AND (k + i) % 5 > 0 AND (k + i) % 2 = 0 UNION ALL SELECT card_id, 1, 'material choice', 'f' || i, 'pm' FROM n WHERE i <= k % 4 AND i = 2
    UNION ALL SELECT card_id, 2, 'stated on several bases', 'all / cagr', 'researcher' FROM s WHERE k % 3 = 2 UNION ALL SELECT card_id, 3, 'open question', 'q' || i, CASE WHEN (k + i) % 6 = 0 THEN 'nobody' ELSE 'pm' END FROM n WHERE i <= (k + 1) % 3
    UNION ALL SELECT card_id, 4, 'blocking request', CASE WHEN (k + 2 * i) % 7 = 0 THEN '  ' ELSE 'series ' || i END, 'data_owner' FROM n WHERE i <= k % 3 AND (k + i) % 4 = 1 UNION ALL SELECT card_id, 5, 'stand-in series', name, 'data_owner' FROM res WHERE status IN ('PROXY', 'DEGRADED')
    UNION ALL SELECT card_id, 6, 'material finding', 'f1', 'pm' FROM s WHERE k % 5 = 2)"""


@query(f"WITH {_QUEUE} SELECT card_id, reason, item, owner FROM q QUALIFY row_number() OVER (PARTITION BY card_id, item ORDER BY rank, reason, owner) = 1")
def review_items(spark, sf_dir):
    """What people have to look at: sections of cards, resolved series of brands, and findings, each item once."""
    found = whole_cards(spark, sf_dir)
    resolved = feasibility.resolve(t.requirements(spark, sf_dir), t.registry(spark, sf_dir))
    findings = found.select("card_id", F.lit("f1").alias("item"), (F.col("card_id").cast("long") % 5 == 2).alias("material"))
    return card_rules.review_items(found, resolved, findings)


_LINES = f"""{_NUMBERED}, u AS (SELECT *, CASE k % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'none' WHEN 3 THEN 'fair' ELSE '' END AS grade, CASE WHEN k % 6 = 0 THEN '' WHEN k % 4 = 1 THEN 'NSE factor sleeves' ELSE 'NIFTY 500' END AS target FROM s WHERE k % 7 > 0),
    l("group", card_id, label, value, detail, owner, flag, ref) AS (
    SELECT 'UNIVERSE', card_id, 'target', target, '', 'pm', CASE WHEN grade = 'none' THEN 'BLOCK' ELSE '' END, 'universe_translation.target_universe' FROM u
    UNION ALL SELECT 'SIGNAL', card_id, 'definition', CASE k % 4 WHEN 0 THEN 'rank by momentum over a year' WHEN 1 THEN 'earnings over price' WHEN 2 THEN 'a plain spread' ELSE '' END, 'top decile', 'researcher', '', 'strategy.signal_definition' FROM s
    UNION ALL SELECT 'PORTFOLIO', card_id, 'weights', CASE WHEN k % 3 = 0 THEN 'value-weighted' ELSE 'equal' END, '', 'pm', CASE WHEN k % 2 = 1 THEN 'DECIDE' ELSE '' END, 'strategy.weighting_rule' FROM s
    UNION ALL SELECT 'DATA', card_id, 'field', 'd' || i, CASE WHEN (k + i) % 6 = 0 THEN '' ELSE 'x' END, 'data_owner', CASE WHEN i = 2 THEN 'DECIDE' ELSE '' END, 'data_plan.ideal[' || (i - 1) || '].field' FROM n WHERE k % 3 > 0 AND i <= k % 4
    UNION ALL SELECT 'SECURITIES', card_id, 'rule', 'x', '', 'researcher', '', 'selection.rule' FROM s WHERE k % 8 > 0 UNION ALL SELECT 'THE RUN', card_id, 'first day', '2005', CASE WHEN k % 9 = 2 THEN '' ELSE 'x' END, 'researcher', '', 'backtest_plan.sample_start' FROM s WHERE k % 3 <> 1
    UNION ALL SELECT 'THE BAR', card_id, 'failure', 'x', '', 'pm', '', 'backtest_plan.failure_looks_like' FROM s WHERE k % 3 <> 1 AND k % 13 > 0
    UNION ALL SELECT 'RISKS', card_id, 'reading', 'f' || i, CASE WHEN (k + i) % 3 = 0 THEN '' ELSE 'x' END, 'researcher', CASE WHEN i = 2 THEN 'DECIDE' WHEN (k + i) % 5 > 0 AND (k + i) % 2 = 0 THEN 'GUESS' ELSE '' END, 'ambiguities[' || (i - 1) || '].field' FROM n WHERE i <= k % 4
    UNION ALL SELECT 'VERDICT', card_id, 'convertible', CASE WHEN k % 3 = 0 THEN 'maybe' ELSE 'mechanism_only' END, CASE WHEN k % 5 = 0 THEN '' ELSE 'x' END, 'pm', 'DECIDE', 'convertibility.verdict' FROM s WHERE k % 2 = 1
    UNION ALL SELECT 'ASKS', card_id, 'question', 'q' || i, CASE WHEN (k + i) % 2 = 0 THEN '' ELSE 'x' END, CASE WHEN (k + i) % 6 = 0 THEN 'nobody' ELSE 'pm' END, CASE WHEN i = 2 THEN 'BLOCK' ELSE 'DECIDE' END, 'open_questions[' || (i - 1) || '].question' FROM n WHERE i <= (k + 1) % 3
    UNION ALL SELECT 'ASKS', card_id, 'request', 'series ' || i, CASE WHEN (k * i) % 5 = 0 THEN '' ELSE 'x' END, 'data_owner', CASE WHEN (k + i) % 4 = 1 THEN 'BLOCK' ELSE 'DECIDE' END, 'data_requests[' || (i - 1) || '].item' FROM n WHERE i <= k % 3 AND (k + 2 * i) % 7 > 0
    UNION ALL SELECT 'DATA', card_id, 'smallest honest set', CASE WHEN k % 4 > 1 THEN '1' ELSE '0' END || ' of ' || (k % 4), '', '', '', 'data_plan.ideal' FROM s WHERE k % 3 > 0 AND k % 4 > 0 UNION ALL SELECT 'RISKS', card_id, 'material readings', CASE WHEN k % 4 > 1 THEN '1' ELSE '0' END || ' of ' || (k % 4), '', '', '', 'ambiguities' FROM s WHERE k % 4 > 0
    UNION ALL SELECT 'ASKS', card_id, 'blocking requests', (SELECT count(*) FROM n WHERE n.card_id = s.card_id AND i <= k % 3 AND (k + i) % 4 = 1) || ' of ' || (k % 3), '', '', '', 'data_requests' FROM s WHERE k % 3 > 0)"""
_GROUP_ORDER = "list_position([" + ", ".join(f"'{g}'" for g in card_rules.GROUPS) + """], "group")"""


@query(f"""WITH {_LINES} SELECT card_id, "group", label, value, detail, owner, flag, ref FROM l WHERE value <> ''""")
def card_facts(spark, sf_dir):
    """Every card as displayable lines, stated and counted."""
    return card_rules.card_facts(whole_cards(spark, sf_dir)).drop("page")


@query(f"""WITH {_LINES} SELECT card_id, label, value, flag, row_number() OVER (PARTITION BY card_id ORDER BY list_position(['BLOCK', 'DECIDE', 'GUESS'], flag), {_GROUP_ORDER}, ref)::INT AS place FROM l WHERE value <> '' AND flag <> ''""")
def flagged_facts(spark, sf_dir):
    """The decision sheets: what blocks, what has to be decided, what was guessed, in order."""
    return card_rules.flagged_facts(card_rules.card_facts(whole_cards(spark, sf_dir))).select("card_id", "label", "value", "flag", "place")


#: The whole standard table on these cards: section, check, weight, where it applies, where it holds (never, where the field is not there or too short).
_CHECKS = (
    ("paper", "source file", 3, "true", "false"), ("paper", "digest of the source", 3, "true", "false"), ("paper", "authors", 1, "true", "false"), ("intent", "rationale", 2, "true", "false"), ("intent", "what transfers", 3, "k % 2 = 0", "false"), ("intent", "what breaks", 3, "k % 2 = 0", "false"),
    ("intent", "numbers to replicate", 3, "k % 2 = 1", "k % 3 > 0"), ("universe", "translation", 3, "true", "k % 7 > 0"), ("universe", "source universe", 2, "k % 7 > 0", "false"), ("universe", "selection rule of the source", 2, "k % 7 > 0", "false"), ("universe", "argument for the target", 3, "k % 7 > 0", "false"),
    ("universe", "risks of the transfer", 3, "k % 7 > 0", "false"), ("universe", "needs of the mechanism", 2, "k % 7 > 0", "true"), ("universe", "alternatives", 2, "k % 7 > 0", "false"), ("universe", "why not these", 2, "k % 7 > 0", "false"), ("universe", "page", 1, "k % 7 > 0", "false"), ("strategy", "reconstruction", 3, "true", "true"),
    ("strategy", "signal", 3, "true", "false"), ("strategy", "inputs", 2, "true", "true"), ("strategy", "formation", 2, "true", "true"), ("strategy", "weighting", 2, "true", "true"), ("strategy", "constraints", 2, "true", "false"), ("strategy", "pages", 2, "true", "false"), ("strategy", "read with confidence", 1, "true", "k % 9 > 0"),
    ("signal", "template", 3, "true", "false"), ("signal", "lookback", 2, "true", "false"), ("signal", "lag of a day or more", 3, "true", "false"), ("signal", "description", 1, "true", "false"), ("portfolio", "first day", 2, "true", "false"), ("portfolio", "cash stance of the mandate", 2, "true", "false"), ("costs", "own cost", 3, "true", "false"),
    ("data", "requirements", 3, "true", "false"), ("data", "a purpose for each", 2, "true", "false"), ("ambiguities", "logged", 3, "true", "k % 4 = 3"), ("ambiguities", "all resolved", 3, "true", "k % 4 > 0 AND NOT EXISTS (SELECT 1 FROM n WHERE n.k = s.k AND i <= k % 4 AND (k + i) % 3 = 0)"), ("ambiguities", "some material", 2, "true", "k % 4 > 1"),
    ("benchmarks", "free alternatives", 3, "true", "false"), ("honesty", "configs tried", 2, "true", "k % 10 > 0"), ("honesty", "notes", 1, "true", "false"), ("data plan", "designed", 3, "true", "k % 3 > 0"), ("data plan", "fields", 3, "k % 3 > 0", "k % 4 > 0"),
    ("data plan", "granularity argued", 3, "k % 3 > 0", "k % 4 > 0 AND NOT EXISTS (SELECT 1 FROM n WHERE n.k = s.k AND i <= k % 4 AND (k + i) % 7 = 0)"), ("data plan", "history argued", 2, "k % 3 > 0", "false"), ("data plan", "adjustments", 2, "k % 3 > 0", "false"), ("data plan", "least set marked", 3, "k % 3 > 0", "k % 4 > 1"),
    ("data plan", "rejected alternatives", 2, "k % 3 > 0", "k % 2 = 1"), ("data plan", "argument", 3, "k % 3 > 0", "false"), ("selection", "rule", 3, "true", "k % 8 > 0"), ("backtest plan", "plan", 3, "true", "k % 3 <> 1"), ("backtest plan", "window argued", 3, "k % 3 <> 1", "k % 9 <> 2"), ("backtest plan", "warm-up", 2, "k % 3 <> 1", "false"),
    ("backtest plan", "weights", 3, "k % 3 <> 1", "k % 4 <> 2"), ("backtest plan", "reasons for benchmarks", 3, "k % 3 <> 1", "k % 2 = 1 AND k % 6 <> 3"), ("backtest plan", "what to beat", 2, "k % 3 <> 1", "false"), ("backtest plan", "failure defined", 3, "k % 3 <> 1", "k % 13 > 0"), ("asks", "open questions", 1, "true", "(k + 1) % 3 > 0"),
    ("convertibility", "verdict", 3, "true", "k % 2 = 1"), ("convertibility", "chain", 2, "k % 2 = 1", "k % 4 = 3"), ("convertibility", "weakest link", 3, "k % 2 = 1", "k % 5 > 0"), ("convertibility", "decisive evidence", 3, "k % 2 = 1", "false"), ("convertibility", "worth of a null result", 2, "k % 2 = 1", "false"), ("convertibility", "capacity", 1, "k % 2 = 1", "false"),
)
_CHECKED = " UNION ALL ".join(f"SELECT card_id, '{section}' AS section, '{name}' AS name, {weight} AS weight, {holds} AS passed FROM s WHERE {where}" for section, name, weight, where, holds in _CHECKS)


@query(f"WITH {_NUMBERED} {_CHECKED}")
def whole_card_checks(spark, sf_dir):
    """The whole table of completeness checks on cards with all sections."""
    return rules.checked(whole_cards(spark, sf_dir)).withColumnRenamed("check", "name")


@query(f"""WITH {_NUMBERED}, ck AS ({_CHECKED}) SELECT card_id, round(sum(CASE WHEN passed THEN weight ELSE 0 END) / sum(weight), 6) AS score, coalesce(list_aggregate(list_sort(list(section || ': ' || name) FILTER (NOT passed AND weight = 3)), 'string_agg', '; '), '') AS gaps FROM ck GROUP BY 1""")
def whole_card_scores(spark, sf_dir):
    return r6(rules.completeness(whole_cards(spark, sf_dir)).withColumn("gaps", F.concat_ws("; ", "gaps")))


#: Gate A on cards with all sections: criterion, whether it blocks, where it applies, where it holds.
_GATE = (
    ("the universe is translated", True, "true", "k % 7 > 0"), ("the data set is designed", True, "true", "k % 3 > 0 AND k % 4 > 0"), ("alternatives were weighed", False, "k % 3 > 0", "k % 2 = 1"), ("the selection is a rule", True, "true", "k % 8 > 0"), ("the test is planned", True, "true", "k % 3 <> 1"),
    ("the strategy can be built", True, "true", "k % 4 <> 3"), ("read with confidence", False, "true", "k % 9 > 0"), ("ambiguities are resolved", True, "true", "k % 4 > 0 AND NOT EXISTS (SELECT 1 FROM n WHERE n.k = s.k AND i <= k % 4 AND (k + i) % 3 = 0)"), ("convertibility is assessed", False, "true", "k % 2 = 1"),
    ("there are numbers to replicate", True, "k % 2 = 1", "k % 3 > 0"), ("what breaks is named", False, "k % 2 = 0", "k % 4 > 1"),
)
_GATE_SQL = " UNION ALL ".join(f"SELECT card_id, '{name}' AS name, {holds} AS passed, {str(blocks).lower()} AS blocking FROM s WHERE {where}" for name, blocks, where, holds in _GATE)


@query(f"WITH {_NUMBERED} {_GATE_SQL}")
def gate_a_document(spark, sf_dir):
    """Gate A on cards whose every section is there for some and not for others."""
    return rules.gate_a(whole_cards(spark, sf_dir)).select("card_id", "name", "passed", "blocking")


@query(f"WITH {_NUMBERED}, g AS ({_GATE_SQL}) SELECT card_id, bool_and(passed OR NOT blocking) AS passed, count(CASE WHEN NOT passed AND NOT blocking THEN 1 END) AS n_warnings FROM g GROUP BY 1")
def gate_a_results(spark, sf_dir):
    found = rules.gate_results(rules.gate_a(whole_cards(spark, sf_dir)))
    return found.select("card_id", "passed", F.size("warnings").cast("long").alias("n_warnings"))


# -- scanners -----------------------------------------------------------------------------

_TICKERS, _SOURCES = ("SPY", "GLD", "NIFTY"), ("Bloomberg", "CRSP", "NSE", "FRED")
_SAID = f"""p AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS doc_id FROM supplier),
    v(doc_id, kind, n, value) AS (SELECT doc_id, 'rebalance', 0, CASE k % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'quarterly' END FROM p UNION ALL SELECT doc_id, 'cost_bps', 0, (5 + k % 40)::VARCHAR FROM p UNION ALL SELECT doc_id, 'cost_bps', 1, (3 + k % 9)::VARCHAR FROM p WHERE k % 2 = 0
        UNION ALL SELECT doc_id, 'lookback', 0, (20 + k % 100)::VARCHAR FROM p UNION ALL SELECT doc_id, 'target_vol', 0, (6 + k % 20)::VARCHAR FROM p WHERE k % 5 > 0 UNION ALL SELECT doc_id, 'sample_period', 0, (1960 + k % 30)::VARCHAR FROM p
        UNION ALL SELECT doc_id, 'ticker', 0, [{", ".join(f"'{x}'" for x in _TICKERS)}][1 + k % 3] FROM p UNION ALL SELECT doc_id, 'constraint', 0, CASE WHEN k % 2 = 0 THEN 'long-only' ELSE 'no leverage' END FROM p UNION ALL SELECT doc_id, 'benchmark', 0, CASE WHEN k % 4 = 0 THEN '60/40' ELSE 'buy and hold' END FROM p
        UNION ALL SELECT doc_id, 'data_source', 0, [{", ".join(f"'{x}'" for x in _SOURCES)}][1 + k % 4] FROM p UNION ALL SELECT doc_id, 'code_url', 0, 'https://github.com/desk/study' || k FROM p WHERE k % 3 = 1 UNION ALL SELECT doc_id, 'sharpe', 0, (k % 3) || '.' || (10 + k % 90) FROM p)"""


@query(f"WITH {_SAID} SELECT doc_id, kind, n, value FROM v")
def all_scanners(spark, sf_dir):
    """Every kind of hit in suppliers' reports, each sentence with values by the supplier's key, every second report with two costs."""
    k = F.col("s_suppkey")
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), (k % len(values) + 1).cast("int"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("The book is rebalanced "), pick(("daily", "weekly", "quarterly")), F.lit(".")), F.concat(F.lit("Trading takes "), (5 + k % 40).cast("string"), F.lit(" basis points.")), F.when(k % 2 == 0, F.concat(F.lit("Others pay "), (3 + k % 9).cast("string"), F.lit(" bps."))),
        F.concat(F.lit("A trailing window of "), (20 + k % 100).cast("string"), F.lit(" days is read.")), F.when(k % 5 > 0, F.concat(F.lit("Its target volatility is "), (6 + k % 20).cast("string"), F.lit(" %."))), F.concat(F.lit("It covers "), (1960 + k % 30).cast("string"), F.lit(" to "), (1995 + k % 30).cast("string"), F.lit(".")),
        F.concat(F.lit("We hold "), pick(_TICKERS), F.lit(".")), F.concat(F.lit("It stays "), F.when(k % 2 == 0, "long-only").otherwise("no leverage"), F.lit(".")), F.concat(F.lit("Against "), F.when(k % 4 == 0, "60/40").otherwise("buy and hold"), F.lit(".")), F.concat(F.lit("Prices are from "), pick(_SOURCES), F.lit(".")),
        F.when(k % 3 == 1, F.concat(F.lit("Code: https://github.com/desk/study"), k.cast("string"))), F.concat(F.lit("Sharpe ratio "), (k % 3).cast("string"), F.lit("."), (10 + k % 90).cast("string")),
    )
    pages = t.table(spark, sf_dir, "supplier").select(k.cast("string").alias("doc_id"), F.lit(0).alias("page"), text.alias("text"))
    return evidence.scan(pages).select("doc_id", "kind", "n", "value")
