"""Can a card be tested on the data held?  Requirements, universes, translations as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import messages, normal_text
from ledgerline.sources.panels import pit_status

#: Universes are a stated catalogue; joins broadcast it up to this many rows, and shuffle beyond.
CATALOGUE_ROWS = 10_000
# Cap segments from large to small, and grades of recorded translations from best to worst.
SEGMENTS = {"large": 0, "large_mid": 1, "mid": 2, "small": 3, "all": 2}
GRADES = {"exact": 0, "close": 1, "partial": 2, "poor": 3}


def resolve(requirements: DataFrame, registry: DataFrame) -> DataFrame:
    """Each requirement's status, source and caveats.

    ``requirements(card_id, name, kind, mandatory)``; ``registry(name, pit_status, is_proxy_for
    array<string>, caveats array<string>, ord)``.  A series held directly is AVAILABLE, or DEGRADED
    where its history is not point in time; else the first declared proxy; else UNAVAILABLE.
    """
    wanted = requirements.select("name").distinct()
    held = registry.select("name", F.struct(F.col("name").alias("source"), F.coalesce(pit_status(F.col("pit_status")), F.col("pit_status")).alias("pit"), "caveats").alias("held"))
    stands = registry.select(F.explode("is_proxy_for").alias("name"), "ord", F.struct(F.col("name").alias("source"), F.col("pit_status").alias("pit"), "caveats").alias("proxy"))
    first = stands.join(wanted, "name", "left_semi").groupBy("name").agg(F.min_by("proxy", F.struct("ord", "proxy.source")).alias("proxy"))
    both = requirements.join(held, "name", "left").join(first, "name", "left")
    status = F.when(F.col("held").isNotNull(), F.when(F.col("held.pit") == "point_in_time", "AVAILABLE").otherwise("DEGRADED")).when(F.col("proxy").isNotNull(), "PROXY").otherwise("UNAVAILABLE")
    source = F.coalesce("held", "proxy")
    return both.select("card_id", "name", "kind", "mandatory", status.alias("status"), source["source"].alias("resolved_to"), source["caveats"].alias("caveats"))


def verdicts(resolved: DataFrame, allow_backfilled: bool = True) -> DataFrame:
    """Per card: GO, GO_WITH_PROXY or FAIL_FAST, what blocks, what needs a signature, and counts."""
    must = F.col("mandatory")
    blocks = F.when(must & (F.col("status") == "UNAVAILABLE"), F.concat("name", F.lit(" is mandatory and unavailable"))).when(
        must & (F.col("status") == "DEGRADED") & F.lit(not allow_backfilled), F.concat("name", F.lit(" is backfilled"))
    )
    sign = F.when(must & (F.col("status") == "DEGRADED"), F.concat("name", F.lit(": accept its history?"))).when(must & (F.col("status") == "PROXY"), F.concat("name", F.lit(": approve "), "resolved_to", F.lit("?")))
    count = lambda s: F.sum((F.col("status") == s).cast("int"))
    out = resolved.groupBy("card_id").agg(
        F.sort_array(F.collect_list(blocks)).alias("blocking"), F.sort_array(F.collect_list(sign)).alias("signoff"), F.sum((must & (F.col("status") == "AVAILABLE")).cast("int")).alias("clean"),
        F.sum(must.cast("int")).alias("n_mandatory"), *[count(s).alias(s.lower()) for s in ("AVAILABLE", "PROXY", "DEGRADED", "UNAVAILABLE")],
    )
    verdict = F.when(F.size("blocking") > 0, "FAIL_FAST").when(F.col("proxy") + F.col("degraded") > 0, "GO_WITH_PROXY").otherwise("GO")
    return out.withColumn("verdict", verdict)


def shortfall(resolved: DataFrame, instruments: DataFrame) -> DataFrame:
    """(card_id, name, kind): unavailable requirements and missing instruments, kinds guessed from names."""
    guess = F.when(F.lower("name").contains("rate"), "rate").when(F.lower("name").contains("index"), "index").otherwise("price")
    missing = resolved.where("status = 'UNAVAILABLE'").select("card_id", "name")
    return missing.union(instruments.select("card_id", "name")).distinct().withColumn("kind", guess)


def instruments_missing(needed: DataFrame, registry: DataFrame) -> DataFrame:
    """Needed (universe, name) pairs that the registry lacks."""
    return needed.join(registry.select("name"), "name", "left_anti")


def instruments_held(needed: DataFrame, registry: DataFrame) -> DataFrame:
    return needed.join(registry.select("name"), "name", "left_semi")


def _catalogued(universes: DataFrame) -> DataFrame:
    """Broadcast a catalogue only when its rows are counted to be few."""
    few = universes.limit(CATALOGUE_ROWS + 1).count() <= CATALOGUE_ROWS
    return F.broadcast(universes) if few else universes


def score_universes(needs: DataFrame, universes: DataFrame, as_of_year: int) -> DataFrame:
    """Every need against every catalogued universe: score, reasons against, disqualifiers.

    ``needs(card_id, needs_cross_section, min_names, cap_segment, sector, min_history_years,
    must_be_in_mandate)``; ``universes(name, approx_breadth, u_segment, u_sector, in_mandate,
    history_from int)``.  Breadth, segment, sector, history and mandate add fixed points.
    """
    pairs = needs.join(_catalogued(universes), F.lit(True))
    n, least = F.coalesce("approx_breadth", F.lit(0)), F.col("min_names")
    rank = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in SEGMENTS.items() for v in kv]), F.col(c)), F.lit(2))
    gap = F.abs(rank("u_segment") - rank("cap_segment"))
    cross = F.col("needs_cross_section")
    breadth = F.when(cross & (n >= 2 * least), 25).when(cross & (n >= least), 15).when(cross & (n >= 0.5 * least), -10).when(~cross & (n <= 12), 10).otherwise(0)
    segment = F.when(gap == 0, 20).when(gap <= 1, 8).otherwise(-12 * gap)
    wants, has = F.col("sector").isNotNull(), F.col("u_sector").isNotNull()
    sector = F.when(wants & (F.col("u_sector") == F.col("sector")), 25).when(wants & ~has, -5).when(~wants & has, -20).otherwise(0)
    old = (F.lit(as_of_year) - F.col("history_from")) >= F.col("min_history_years")
    history = F.when(old, 10).otherwise(-8)
    against = messages(
        (cross & (n < least) & (n >= 0.5 * least), "thin breadth"), (gap > 1, "another cap segment"), (wants & ~has, "broad for a sector mechanism"), (~wants & has, "narrow for a broad mechanism"), (~old, "short history"),
        (~F.col("in_mandate") & ~F.col("must_be_in_mandate"), "outside the mandate"),
    )
    out = messages((cross & (n < 0.5 * least), "too few names"), (wants & has & (F.col("u_sector") != F.col("sector")), "wrong sector"), (~F.col("in_mandate") & F.col("must_be_in_mandate"), "not holdable"))
    score = breadth + segment + sector + history + F.when(F.col("in_mandate"), 10).otherwise(0)
    return pairs.select("card_id", F.col("name").alias("universe"), score.cast("double").alias("score"), against.alias("reasons_against"), out.alias("disqualifying"))


def propose(scored: DataFrame, k: int = 5, chosen: str | None = None) -> DataFrame:
    """The best ``k`` usable universes per card, and the chosen one wherever it ranks."""
    usable = scored.where(F.size("disqualifying") == 0)
    ranked = usable.withColumn("place", F.row_number().over(Window.partitionBy("card_id").orderBy(F.desc("score"), "universe")))
    return ranked.where((F.col("place") <= k) | (F.col("universe") == F.lit(chosen or "")))


def canonical_source(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``source``: the alias table's canonical name for the normalised text, never a fuzzy one."""
    table = aliases.select(normal_text(F.col("alias")).alias("_k"), "source")
    return names.withColumn("_k", normal_text(F.col("text"))).join(table, "_k", "left").drop("_k")


def translations_of(sources: DataFrame, translations: DataFrame) -> DataFrame:
    """Recorded translations of each source, best grade first."""
    grade = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in GRADES.items() for v in kv]), F.col("grade")), F.lit(99))
    ranked = sources.join(translations, "source")
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(grade, "target")))


def check_translation(claims: DataFrame, aliases: DataFrame, translations: DataFrame, needed: DataFrame, registry: DataFrame, scored: DataFrame) -> DataFrame:
    """Each claim (card_id, text, target, claimed_grade) with its findings.

    Findings: the canonical source, the recorded grade against the claimed one, instruments held
    and missing for the target, and the target's score and place among the card's universes.
    """
    known = canonical_source(claims, aliases).join(translations.select("source", "target", "grade"), ["source", "target"], "left")
    have = needed.join(registry.select("name", F.lit(True).alias("held")), "name", "left").groupBy(F.col("universe").alias("target")).agg(
        F.sort_array(F.collect_set(F.when(F.col("held"), F.col("name")))).alias("held"), F.sort_array(F.collect_set(F.when(F.col("held").isNull(), F.col("name")))).alias("missing")
    )
    place = scored.withColumn("place", F.row_number().over(Window.partitionBy("card_id").orderBy(F.desc("score"), "universe"))).select("card_id", F.col("universe").alias("target"), "score", "place")
    full = known.join(have, "target", "left").join(place, ["card_id", "target"], "left")
    return full.withColumn(
        "findings",
        messages(
            (F.col("source").isNull(), "unknown source"), (F.col("source").isNotNull() & F.col("grade").isNull(), "no recorded translation"), (F.col("grade") != F.col("claimed_grade"), "grade differs from the record"),
            (F.size("missing") > 0, F.concat(F.lit("missing: "), F.concat_ws(", ", "missing"))), (F.col("place") > 5, "five universes fit better"),
        ),
    )


def data_plan(cards: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per card: minimum-viable fields, those that open requests name (not in hand), proxied and degraded series.

    ``cards(card_id, ideal array<struct<field, minimum_viable>>, requests array<struct<item, satisfies array<string>>>)``.
    """
    clean = lambda c: F.lower(F.trim(c))
    need = cards.select("card_id", F.explode("ideal").alias("d")).where("d.minimum_viable").select("card_id", F.col("d.field").alias("field"))
    claimed = cards.select("card_id", F.explode("requests").alias("r")).select("card_id", F.explode("r.satisfies").alias("s")).select("card_id", clean(F.col("s")).alias("k")).where("k != ''").distinct()
    open_ = need.withColumn("k", clean(F.col("field"))).join(claimed, ["card_id", "k"], "left_semi").groupBy("card_id").agg(F.sort_array(F.collect_list("field")).alias("not_in_hand"))
    needed = need.groupBy("card_id").agg(F.sort_array(F.collect_list("field")).alias("need"))
    by_status = resolved.groupBy("card_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("status") == "PROXY", F.concat("name", F.lit(" -> "), "resolved_to")))).alias("proxied"), F.sort_array(F.collect_list(F.when(F.col("status") == "DEGRADED", F.col("name")))).alias("degraded")
    )
    return cards.select("card_id", (F.size("ideal") > 0).alias("checked")).join(needed, "card_id", "left").join(open_, "card_id", "left").join(by_status, "card_id", "left")


def advisory_agreement(resolved: DataFrame, advice: DataFrame) -> DataFrame:
    """Deterministic status against advisory (card_id, name, match): ``agree`` is null where not assessed."""
    match = F.when(F.col("status") == "AVAILABLE", "exact").when(F.col("status").isin("PROXY", "DEGRADED"), "proxy").otherwise("none")
    both = resolved.join(advice, ["card_id", "name"], "left")
    return both.withColumn("agree", F.when(F.col("match").isNotNull(), F.col("match") == match))


def status_counts(resolved: DataFrame, by: Column | str = "status") -> DataFrame:
    return resolved.groupBy("card_id", by).count()
