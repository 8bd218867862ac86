"""Rules over cards as rows: validation, completeness, gates, the promotion ladder.

Rules are data where they are many (a rule table joined or exploded) and columns where they are
few.  Evidence that is missing fails visibly; no rule drops a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ledgerline.functions.columns import fingerprint, messages

# The ladder's rungs in order; gate B's keys and thresholds (its names are ours); what stands in for an answer without being one.
LADDER = ("REPLICATED", "INDIA_VALIDATED", "ROBUST", "ORTHOGONAL", "PORTFOLIO_USEFUL")
GATE_B = (
    # key, name, direction, threshold, blocking, blocking where missing
    ("deflated_sharpe", "skill beyond the best of the trials", ">=", 0.95, True, True),
    ("oos_min_sharpe", "worst unseen window pays", ">=", 0.30, True, True),
    ("bootstrap_p", "ahead of the benchmark by more than luck", "<=", 0.05, True, True),
    ("max_corr_to_book", "not a copy of what is held", "<=", 0.80, True, False),
    ("best_delta_ir", "raises the ratio of the whole book", ">=", 0.05, True, False),
    ("alpha_t_hac", "return left after known factors", "abs>=", 2.0, True, True),
    ("mandate_violations", "no breach of the mandate", "<=", 0.0, True, True),
    ("annual_turnover", "trades little enough to run", "<=", 4.0, False, False),
)
NO_COMPARISON = ("max_corr_to_book", "best_delta_ir")
NON_ANSWERS = ("", "-", "--", "n/a", "na", "none", "nothing", "tbd", "todo", "unknown", "not applicable", "no fallback", "unclear", "?")
MODES = ("replication", "adaptation")
FALLBACK_CHARS, ARGUED_CHARS = 25, 40


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


# -- cards --------------------------------------------------------------------------------


def card_errors(cards: DataFrame) -> DataFrame:
    """``errors``: the rules that a card breaks; sections are structs and arrays of structs."""
    ambiguity = lambda a: F.array_compact(
        F.array(
            F.when(blank(a["field"]), F.lit("ambiguity without a field")),
            F.when(~F.coalesce(a["confidence"].isin("high", "medium", "low"), F.lit(False)), F.concat(F.lit("ambiguity with unknown confidence: "), F.coalesce(a["field"], F.lit("?")))),
            F.when(F.coalesce(a["material"], F.lit(False)) & blank(a["resolution"]), F.concat(F.lit("material ambiguity without resolution: "), F.coalesce(a["field"], F.lit("?")))),
        )
    )
    target = lambda t: F.array_compact(
        F.array(F.when(blank(t["metric"]), F.lit("target without a metric")), F.when(F.coalesce(t["tolerance"], F.lit(-1.0)) < 0, F.concat(F.lit("target without a tolerance: "), F.coalesce(t["metric"], F.lit("?")))))
    )
    weights = F.map_values("weights")
    adapted = F.col("intent.mode") == "adaptation"
    flat = messages(
        (blank(F.col("paper.id")), "paper.id is required"), (blank(F.col("paper.title")), "paper.title is required"),
        (~F.coalesce(F.col("intent.mode").isin(*MODES), F.lit(False)), "intent.mode is replication or adaptation"),
        (adapted & blank(F.col("intent.parent_card")), "an adaptation names its parent"), (adapted & (F.coalesce(F.size("intent.broken_assumptions"), F.lit(0)) <= 0), "an adaptation names broken assumptions"),
        (F.coalesce(F.size("universe.assets"), F.lit(0)) <= 0, "universe.assets is required"), (F.col("costs.spread_bps") < 0, "negative spread"), (F.coalesce(F.col("signal.lag_days"), F.lit(-1)) < 0, "signal.lag_days is 0 or more"),
        (F.exists(weights, lambda w: w < 0), "negative weight"), (F.aggregate(weights, F.lit(0.0), lambda a, w: a + w) > 1 + 1e-9, "levered weights"),
        (F.col("n_configs_tried") < 1, "n_configs_tried is 1 or more"),
    )
    nested = F.flatten(F.array(F.flatten(F.transform(F.coalesce("ambiguities", F.array()), ambiguity)), F.flatten(F.transform(F.coalesce("replication_targets", F.array()), target))))
    return cards.withColumn("errors", F.concat(flat, F.coalesce(nested, F.array().cast("array<string>"))))


def unknown_keys(keys: DataFrame, allowed: list[str]) -> DataFrame:
    """(card_id, unknown): keys of (card_id, keys array<string>) that no card may have."""
    out = keys.select("card_id", F.array_except("keys", F.array(*[F.lit(k) for k in allowed])).alias("unknown"))
    return out.where(F.size("unknown") > 0)


def economic_fingerprint(cards: DataFrame, fields: list[str]) -> DataFrame:
    return cards.withColumn("fingerprint", fingerprint(*fields))


def facts(cards: DataFrame, layout: list[tuple[str, str, str, str]]) -> DataFrame:
    """(card_id, group, label, value, flag): the layout's (group, label, column, flag) that are not blank, as rows."""
    order = {"BLOCK": 0, "DECIDE": 1, "GUESS": 2}
    rows = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(label).alias("label"), F.col(c).cast("string").alias("value"), F.lit(flag).alias("flag"), F.lit(order.get(flag, 9)).alias("rank"), F.lit(i).alias("ord")) for i, (g, label, c, flag) in enumerate(layout)])
    return cards.select("card_id", F.explode(rows).alias("f")).select("card_id", "f.*").where(~blank(F.col("value")))


def decision_sheet(listed: DataFrame) -> DataFrame:
    """Flagged facts: what blocks, what has to be decided, what was guessed."""
    return listed.where("rank < 9").sort("card_id", "rank", "ord")


# What a complete card has, as (section, check, weight, kind, field, number, where it applies).
# Kinds: text (more than so many characters), items (so many or more), least (a number of so much or more), set, flagged (an item
# whose flag holds), each (every item has the text), equal (that text).  A check applies always, or where the section is there or
# where the card is a replication or an adaptation.
STANDARD = (
    ("paper", "source file", 3, "text", "paper.source_file", 0, ""), ("paper", "digest of the source", 3, "text", "paper.source_sha256", 0, ""), ("paper", "authors", 1, "items", "paper.authors", 1, ""),
    ("intent", "rationale", 2, "text", "intent.rationale", 80, ""), ("intent", "what transfers", 3, "text", "intent.transferred_mechanism", 60, "adaptation"), ("intent", "what breaks", 3, "items", "intent.broken_assumptions", 2, "adaptation"),
    ("intent", "numbers to replicate", 3, "items", "replication_targets", 1, "replication"),
    ("universe", "translation", 3, "set", "universe_translation", 0, ""), ("universe", "source universe", 2, "text", "universe_translation.source_universe", 3, "universe_translation"), ("universe", "selection rule of the source", 2, "text", "universe_translation.source_selection_rule", 0, "universe_translation"),
    ("universe", "argument for the target", 3, "text", "universe_translation.rationale", 80, "universe_translation"), ("universe", "risks of the transfer", 3, "items", "universe_translation.transfer_risks", 2, "universe_translation"), ("universe", "needs of the mechanism", 2, "set", "universe_translation.mechanism_needs", 0, "universe_translation"),
    ("universe", "alternatives", 2, "items", "universe_translation.alternatives_considered", 1, "universe_translation"), ("universe", "why not these", 2, "text", "universe_translation.why_not_alternatives", 0, "universe_translation"), ("universe", "page", 1, "set", "universe_translation.evidence_page", 0, "universe_translation"),
    ("strategy", "reconstruction", 3, "set", "strategy", 0, ""), ("strategy", "signal", 3, "text", "strategy.signal_definition", 120, "strategy"), ("strategy", "inputs", 2, "items", "strategy.inputs_required", 1, "strategy"), ("strategy", "formation", 2, "text", "strategy.formation_rule", 0, "strategy"),
    ("strategy", "weighting", 2, "text", "strategy.weighting_rule", 0, "strategy"), ("strategy", "constraints", 2, "items", "strategy.constraints", 1, "strategy"), ("strategy", "pages", 2, "items", "strategy.evidence_pages", 1, "strategy"), ("strategy", "read with confidence", 1, "equal", "strategy.confidence", "high", "strategy"),
    ("signal", "template", 3, "text", "signal.template", 0, ""), ("signal", "lookback", 2, "set", "signal.lookback_days", 0, ""), ("signal", "lag of a day or more", 3, "least", "signal.lag_days", 1, ""), ("signal", "description", 1, "text", "signal.description", 40, ""),
    ("portfolio", "first day", 2, "text", "portfolio.start", 0, ""), ("portfolio", "cash stance of the mandate", 2, "set", "portfolio.mandate_allow_cash", 0, ""), ("costs", "own cost", 3, "least", "costs.spread_bps", 20, ""),
    ("data", "requirements", 3, "items", "data_requirements", 1, ""), ("data", "a purpose for each", 2, "each", "data_requirements.purpose", 0, ""),
    ("ambiguities", "logged", 3, "items", "ambiguities", 3, ""), ("ambiguities", "all resolved", 3, "each", "ambiguities.resolution", 0, ""), ("ambiguities", "some material", 2, "flagged", "ambiguities.material", 0, ""),
    ("benchmarks", "free alternatives", 3, "items", "benchmark_templates", 2, ""), ("honesty", "configs tried", 2, "least", "n_configs_tried", 1, ""), ("honesty", "notes", 1, "text", "notes", 60, ""),
    ("data plan", "designed", 3, "set", "data_plan", 0, ""), ("data plan", "fields", 3, "items", "data_plan.ideal", 1, "data_plan"), ("data plan", "granularity argued", 3, "each", "data_plan.ideal.why_granularity", 0, "data_plan"), ("data plan", "history argued", 2, "each", "data_plan.ideal.why_history", 0, "data_plan"),
    ("data plan", "adjustments", 2, "each", "data_plan.ideal.adjustments", 0, "data_plan"), ("data plan", "least set marked", 3, "flagged", "data_plan.ideal.minimum_viable", 0, "data_plan"), ("data plan", "rejected alternatives", 2, "items", "data_plan.rejected_alternatives", 1, "data_plan"), ("data plan", "argument", 3, "text", "data_plan.optimality_argument", 80, "data_plan"),
    ("selection", "rule", 3, "text", "selection.rule", 0, ""), ("backtest plan", "plan", 3, "set", "backtest_plan", 0, ""), ("backtest plan", "window argued", 3, "text", "backtest_plan.why_this_window", 0, "backtest_plan"), ("backtest plan", "warm-up", 2, "set", "backtest_plan.warmup_days", 0, "backtest_plan"),
    ("backtest plan", "weights", 3, "text", "backtest_plan.weights_rule", 0, "backtest_plan"), ("backtest plan", "reasons for benchmarks", 3, "each", "backtest_plan.benchmarks.why_this", 0, "backtest_plan"), ("backtest plan", "what to beat", 2, "items", "backtest_plan.must_beat", 1, "backtest_plan"), ("backtest plan", "failure defined", 3, "text", "backtest_plan.failure_looks_like", 0, "backtest_plan"),
    ("asks", "open questions", 1, "items", "open_questions", 1, ""), ("convertibility", "verdict", 3, "set", "convertibility", 0, ""), ("convertibility", "chain", 2, "items", "convertibility.what_must_be_true", 3, "convertibility"), ("convertibility", "weakest link", 3, "text", "convertibility.weakest_link", 0, "convertibility"),
    ("convertibility", "decisive evidence", 3, "text", "convertibility.decisive_evidence", 0, "convertibility"), ("convertibility", "worth of a null result", 2, "text", "convertibility.if_it_fails", 0, "convertibility"), ("convertibility", "capacity", 1, "text", "convertibility.capacity_note", 0, "convertibility"),
)
# Gate A, in the same terms, with whether a failure blocks.
GATE_A = (
    ("universe", "the universe is translated", True, "set", "universe_translation", 0, ""), ("data plan", "the data set is designed", True, "items", "data_plan.ideal", 1, ""), ("data plan", "alternatives were weighed", False, "items", "data_plan.rejected_alternatives", 1, "data_plan"),
    ("selection", "the selection is a rule", True, "text", "selection.rule", 0, ""), ("backtest plan", "the test is planned", True, "set", "backtest_plan", 0, ""), ("strategy", "the strategy can be built", True, "text", "strategy.signal_definition", 0, ""),
    ("strategy", "read with confidence", False, "equal", "strategy.confidence", "high", "strategy"), ("ambiguities", "ambiguities are resolved", True, "each", "ambiguities.resolution", 0, "ambiguities"), ("convertibility", "convertibility is assessed", False, "set", "convertibility", 0, ""),
    ("intent", "there are numbers to replicate", True, "items", "replication_targets", 1, "replication"), ("intent", "what breaks is named", False, "items", "intent.broken_assumptions", 1, "adaptation"),
)


def _holds(cards: DataFrame, kind: str, path: str, number) -> Column:
    """The condition of one check; a field that the table lacks fails it."""
    at = cards.schema
    for part in path.split("."):
        at = at.elementType if isinstance(at, ArrayType) else at
        if not isinstance(at, StructType) or part not in at.names:
            return F.lit(False)
        at = at[part].dataType
    x = F.col(path)
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    conditions = {
        "text": lambda: F.length(clean(x)) > number, "items": lambda: F.size(F.coalesce(x, F.array())) >= number, "least": lambda: x >= number, "set": lambda: x.isNotNull(), "equal": lambda: x == number,
        "flagged": lambda: F.exists(x, lambda v: F.coalesce(v, F.lit(False))), "each": lambda: (F.size(x) > 0) & F.forall(x, lambda v: F.length(clean(v)) > 0),
    }
    return F.coalesce(conditions[kind](), F.lit(False))


def _applies(cards: DataFrame, where: str) -> Column:
    if not where:
        return F.lit(True)
    if where in MODES:
        return F.coalesce(F.col("intent.mode") == where, F.lit(False))
    return F.col(where).isNotNull() if where in cards.columns else F.lit(False)


def checked(cards: DataFrame, table=STANDARD, mark: str = "weight") -> DataFrame:
    """(card_id, section, check, ``mark``, passed): the checks of ``table`` that apply to each card, as rows."""
    rows = [F.when(_applies(cards, w), F.struct(F.lit(s).alias("section"), F.lit(n).alias("check"), F.lit(m).alias(mark), _holds(cards, k, f, x).alias("passed"))) for s, n, m, k, f, x, w in table]
    return cards.select("card_id", F.explode(F.array_compact(F.array(*rows))).alias("c")).select("card_id", "c.*")


def completeness(cards: DataFrame, table=STANDARD) -> DataFrame:
    """(card_id, score, gaps): the weighted share of checks passed, and the failed ones of weight 3."""
    return checked(cards, table).groupBy("card_id").agg(
        (F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0)) / F.sum("weight")).alias("score"),
        F.sort_array(F.collect_list(F.when(~F.col("passed") & (F.col("weight") == 3), F.concat_ws(": ", "section", "check")))).alias("gaps"),
    )


def request_audit(cards: DataFrame) -> DataFrame:
    """``stance`` (asked, argued_none, silent) and ``weak``: requests whose fallback is no decision."""
    text = lambda r: F.trim(F.regexp_replace(F.coalesce(r["without_it"], F.lit("")), r"\s+", " "))
    bare = lambda r: F.trim(F.regexp_replace(F.lower(text(r)), r"\.+$", ""))
    requests = F.coalesce("requests", F.array())
    weak = F.transform(F.filter(requests, lambda r: bare(r).isin(*NON_ANSWERS) | (F.length(text(r)) < FALLBACK_CHARS)), lambda r: r["item"])
    stance = F.when(F.size(requests) > 0, "asked").when(F.length(F.trim(F.coalesce("no_further_data_needed", F.lit("")))) >= ARGUED_CHARS, "argued_none").otherwise("silent")
    return cards.withColumns({"stance": stance, "weak": weak})


def derive_requirements(properties: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules applied to strategy properties: (matched, unmatched).

    ``properties(card_id, field, value)``; ``rules(rule_id, field, pattern, kind, requirement)``: a
    rule matches a property of its field whose value matches its pattern, case aside.
    """
    both = properties.join(rules, "field").where(F.expr("regexp_like(lower(value), lower(pattern))"))
    matched = both.select("card_id", "rule_id", "kind", "requirement", "field").distinct()
    return matched, properties.join(matched.select("card_id", "field").distinct(), ["card_id", "field"], "left_anti")


def review_queue(*parts: DataFrame) -> DataFrame:
    """(card_id, reason, item, owner): the union of what people have to look at, once each."""
    out = parts[0].select("card_id", "reason", "item", "owner")
    for p in parts[1:]:
        out = out.unionByName(p.select("card_id", "reason", "item", "owner"))
    return out.distinct()


# -- gates --------------------------------------------------------------------------------


def gate_a(cards: DataFrame, verdicts: DataFrame | None = None, table=GATE_A) -> DataFrame:
    """Criteria of the interpretation sheet: (card_id, gate, name, passed, value, blocking).

    ``verdicts(card_id, blocking array<string>)`` of data feasibility adds that no gap blocks; cards
    that it does not have fail visibly.
    """
    rows = checked(cards, table, "blocking").select("card_id", F.lit("A").alias("gate"), F.col("check").alias("name"), "passed", F.when(F.col("passed"), "present").otherwise("MISSING").alias("value"), "blocking")
    if verdicts is None:
        return rows
    gaps = cards.select("card_id").join(verdicts.select("card_id", F.size("blocking").alias("n")), "card_id", "left")
    return rows.unionByName(gaps.select("card_id", F.lit("A").alias("gate"), F.lit("no gap in the data blocks").alias("name"), F.coalesce(F.col("n") == 0, F.lit(False)).alias("passed"), F.coalesce(F.col("n").cast("string"), F.lit("MISSING")).alias("value"), F.lit(True).alias("blocking")))


def gate_b(evidence: DataFrame, cards: DataFrame) -> DataFrame:
    """Criteria of the investment decision for every card, from (card_id, key, value) evidence."""
    table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("key", "name", "op", "threshold", "blocking", "must"), row, strict=True)]) for row in GATE_B])
    asked = cards.select("card_id").distinct().select("card_id", F.explode(table).alias("c")).select("card_id", "c.*")
    both = asked.join(evidence, ["card_id", "key"], "left")
    v = F.col("value")
    passed = F.when(F.col("op") == ">=", v >= F.col("threshold")).when(F.col("op") == "<=", v <= F.col("threshold")).otherwise(F.abs(v) >= F.col("threshold"))
    shown = F.when(v.isNotNull(), F.round(v, 6).cast("string")).when(F.col("key").isin(*NO_COMPARISON), "NO COMPARISON").otherwise("NOT COMPUTED")
    return both.select("card_id", F.lit("B").alias("gate"), "key", "name", F.coalesce(passed, F.lit(False)).alias("passed"), shown.alias("shown"), "threshold", F.when(v.isNull(), F.col("must")).otherwise(F.col("blocking")).alias("blocking"))


def gate_results(criteria: DataFrame) -> DataFrame:
    """Per card and gate: passed if every blocking criterion is, and the failed others as warnings."""
    return criteria.groupBy("card_id", "gate").agg(F.bool_and(F.col("passed") | ~F.col("blocking")).alias("passed"), F.sort_array(F.collect_list(F.when(~F.col("passed") & ~F.col("blocking"), F.col("name")))).alias("warnings"))


def rung_criteria(evidence: DataFrame) -> DataFrame:
    """(card_id, rung, name, passed, blocking) from wide evidence, one row a card.

    Columns: replication_pass_rate, india_oos_min, dsr, min_margin (worst Sharpe margin against
    free alternatives), max_corr, delta_ir, mandate_violations; nulls fail.
    """
    rule = lambda rung, name, cond: F.struct(F.lit(rung).alias("rung"), F.lit(name).alias("name"), F.coalesce(cond, F.lit(False)).alias("passed"), F.lit(True).alias("blocking"))
    rows = F.array(
        rule("REPLICATED", "printed numbers replicate", F.col("replication_pass_rate") >= 0.8), rule("INDIA_VALIDATED", "positive in every local window", F.col("india_oos_min") >= 0.3),
        rule("ROBUST", "clears selection bias", F.col("dsr") >= 0.95), rule("ROBUST", "beats free alternatives", F.col("min_margin") > 0), rule("ORTHOGONAL", "differs from the book", F.col("max_corr") <= 0.8),
        rule("PORTFOLIO_USEFUL", "improves the book", F.col("delta_ir") >= 0.05), rule("PORTFOLIO_USEFUL", "inside the mandate", F.col("mandate_violations") == 0),
    )
    return evidence.select("card_id", F.explode(rows).alias("r")).select("card_id", "r.*")


def ladder(cards: DataFrame, criteria: DataFrame) -> DataFrame:
    """(card_id, attained_rung, stopped_at): rungs in order until the first that fails or is missing.

    Adaptations (``mode``) skip the first rung: they never count as replications.
    """
    rungs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("rung")) for i, r in enumerate(LADDER)])
    asked = cards.select("card_id", "mode", F.explode(rungs).alias("r")).select("card_id", "r.i", "r.rung", ((F.col("mode") == "adaptation") & (F.col("r.i") == 0)).alias("skip")).where("not skip")
    done = criteria.groupBy("card_id", "rung").agg(F.bool_and(F.col("passed") | ~F.col("blocking")).alias("ok"))
    path = Window.partitionBy("card_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    walked = asked.join(done, ["card_id", "rung"], "left").withColumn("so_far", F.min(F.coalesce("ok", F.lit(False)).cast("int")).over(path))
    return walked.groupBy("card_id").agg(F.max_by(F.when(F.col("so_far") == 1, F.col("rung")), F.when(F.col("so_far") == 1, F.col("i"))).alias("attained_rung"), F.min_by(F.when(F.col("so_far") == 0, F.col("rung")), F.when(F.col("so_far") == 0, F.col("i"))).alias("stopped_at"))


def outcomes(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Recommendation and recorded decision; undecided cards are PENDING_HUMAN, a decision needs an owner."""
    both = results.join(decisions, "card_id", "left")
    recommendation = F.when(F.col("passed"), "PROMOTE").otherwise("REJECT")
    owned = F.when(F.col("decision").isNull(), "PENDING_HUMAN").when(blank(F.col("owner")), F.raise_error(F.concat(F.lit("decision without an owner: "), "card_id"))).otherwise(F.upper("decision"))
    return both.withColumns({"recommendation": recommendation, "outcome": owned})


def lessons(evidence: DataFrame) -> DataFrame:
    """What a run taught, as sentences, from the same evidence as the rungs."""
    said = messages(
        (F.col("dsr") < 0.95, F.format_string("deflated Sharpe %.2f does not clear selection bias", "dsr")), (F.col("max_corr") > 0.8, F.format_string("correlation %.2f to the book", "max_corr")),
        (F.col("min_margin") <= 0, F.lit("a free alternative does as well")), (F.col("mandate_violations") > 0, F.lit("outside the mandate")),
    )
    return evidence.select("card_id", said.alias("lessons"))
