"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every document gets ``Poisson(rate)`` copies, ``rate`` being its source's mean repetition
rate.  The draw inverts the Poisson distribution at a uniform number hashed from the seed and
the doc_id, so the same documents come out whatever the partitioning, and a lost task that is
run again repeats its draws.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OTHER = "\0other"


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits, from md5 of the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def poisson_steps(rates: DataFrame, group: str, rate: str) -> DataFrame:
    """(group, steps): per group P(count <= k) for k = 0, 1, ... up to where the tail is below 1e-16.

    Terms are built from their logarithms, so large rates do not underflow, and summed by windows
    over k, so the work grows with the number of steps.  A document's count is the number of steps
    that are at or below its uniform number.  Groups of rate 0 have no row.
    """
    last = F.ceil(F.col(rate) + 12 * F.sqrt(rate) + 40).cast("int")
    terms = rates.where(F.col(rate) > 0).select(group, rate, F.explode(F.sequence(F.lit(0), last)).alias("k"))
    path = Window.partitionBy(group).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_factorial = F.sum(F.ln(F.greatest("k", F.lit(1)).cast("double"))).over(path)
    share = terms.withColumn("p", F.exp(F.col("k") * F.ln(rate) - F.col(rate) - log_factorial))
    return share.withColumn("at_most", F.sum("p").over(path)).groupBy(group).agg(F.sort_array(F.collect_list("at_most")).alias("steps"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float],
    rest: float = 0.0,
    budget: float | None = None,
    seed: int = 17,
    source: str = "source",
) -> DataFrame:
    """Replicate documents so that sources take their target shares, then shuffle globally.

    ``weights`` gives target shares of the output, measured in bytes of text; ``rest`` is the
    share of all sources it does not name, null sources included, taken together.  ``budget``
    is the wanted size of the output in bytes, by default that of the input.  A group whose
    weight is 0 gets no copies.  Returns the columns of ``docs`` and ``copy`` (from 1), ordered
    within partitions by a hash of (seed, doc_id, copy); partitions are dealt by that hash too.

    Null and empty texts have size 0 and are drawn at their source's rate; a group holding only
    such texts has rate 1 (weight above 0).  Repeated doc_ids draw the same count.  An empty
    table gives an empty table.  Columns of ``docs`` named ``copy`` are replaced.

    The table of rates has at most ``len(weights) + 1`` rows, so it is broadcast; it never grows
    with the data.  A hot source is spread by the hash of its documents, never gathered.
    """
    if any(w < 0 for w in (*weights.values(), rest)) or not sum(weights.values()) + rest > 0:
        raise ValueError("weights are non-negative and not all zero")
    total_weight = float(sum(weights.values()) + rest)
    mine = F.when(F.col(source).isin(*weights), F.col(source)).otherwise(F.lit(_OTHER))
    sizes = docs.groupBy(mine.alias("group")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"))
    share = F.create_map(*[x for k, w in {**weights, _OTHER: rest}.items() for x in (F.lit(k), F.lit(float(w)))])
    weight = F.element_at(share, F.col("group"))
    # one window over the table of rates, whose rows are bounded by the named weights
    wanted = F.lit(float(budget)) if budget is not None else F.sum("bytes").over(Window.partitionBy(F.lit(0))).cast("double")
    rates = sizes.withColumn("wanted", wanted).select(
        "group", F.when(F.col("bytes") > 0, weight / total_weight * F.col("wanted") / F.col("bytes").cast("double")).otherwise((weight > 0).cast("double")).alias("rate")
    )
    # the whole row goes into one struct, so that no column of docs can clash with the working ones
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    drawn = docs.select(row.alias("row"), mine.alias("group"), uniform(seed, F.col("doc_id")).alias("u")).join(
        F.broadcast(poisson_steps(rates, "group", "rate")), "group", "left"
    )
    count = F.size(F.filter("steps", lambda p: p <= F.col("u")))
    copies = drawn.withColumn("n", count).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.col("copy")))
    dealt = copies.withColumn("order", key).repartition("order").sortWithinPartitions("order")
    return dealt.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "copy"], "copy")
