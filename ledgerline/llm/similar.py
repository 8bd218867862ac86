"""Near copies by SimHash fingerprints and by shingle similarity: a link of either kind is one.

The fingerprints of :mod:`ledgerline.llm.simhash` link what lies within two bits, by pigeonhole blocks;
this finds texts that differ in words strewn over them, whose shingle similarity may be low.  Texts of a
shingle similarity of 0.8 often differ in more bits; the size-banded tiles of :mod:`ledgerline.llm.jaccard`
find every such pair.  Components are those of both kinds of links together, and no link is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import jaccard
from ledgerline.llm._tools import ROW, cut, discard, hold, keyed_texts, release, with_row_keys, without_rows
from ledgerline.llm.simhash import components, links, simhash_udf


def _joined(rows: DataFrame) -> DataFrame:
    """(node, root) of the roots that fingerprints join; ``rows(root, fp)`` are distinct.

    Roots of one fingerprint are tied to the least of them, and so are the least ones of two
    fingerprints that link, so a fingerprint of many roots makes no pairs among these.
    """
    least = cut(rows.groupBy("fp").agg(F.min("root").alias("lead")), "fingerprint-leaders")
    same = rows.join(least, "fp").where("root != lead").select(F.col("lead").alias("u"), F.col("root").alias("v"))
    lead = lambda fp, to: least.select(F.col("fp").alias(fp), F.col("lead").alias(to))
    near = links(least.select("fp")).join(lead("u", "a"), "u").join(lead("v", "b"), "v").where("a != b")
    out = components(same.unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    discard(least)
    return out


def keep_one_similar(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of ``docs`` that links join: the one of the least doc_id.

    Two texts link if their SimHash fingerprints (3-word shingles, repeats included) differ in at most
    two bits, or if the sets of their ``size``-word shingles have a similarity of ``similarity`` or more;
    A-Z are lower-cased for both.  A fingerprint counts repeats, so texts that are for the most part the
    same repeated words link.  Null and wordless texts are one group and link with no other.  Rows are
    judged one by one: of rows that share a doc_id the first of the table stays, and a row without a
    doc_id stays only if its whole group has none.
    """
    release(docs)
    keyed = with_row_keys(docs)
    texts = keyed_texts(keyed)
    prints = cut(texts.select(ROW, simhash_udf(F.col("text")).alias("fp")), "fingerprints")
    members, roots = jaccard.rooted(texts, jaccard.Rule(size, round(100 * similarity)), ROW, "text")
    whole = members.where("n > 0").select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    grouped = cut(jaccard.with_roots(members, whole).select(F.col("doc_id").alias(ROW), "root").join(prints, ROW).join(texts.select(ROW, "doc_id"), ROW), "similar-rows")
    discard(prints, members, roots)
    named = cut(grouped.where("root is not null").select("root", "fp").distinct(), "root-fingerprints")
    merged = _joined(named)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)).alias("head")
    heads = grouped.groupBy("root").agg(first).join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    heads = heads.groupBy(F.coalesce("to", "root")).agg(F.min("head").alias("head"))
    gone = cut(grouped.select(ROW).join(heads.select(F.col(f"head.{ROW}").alias(ROW)), ROW, "left_anti"), "gone-rows")
    discard(grouped, named, merged)
    hold(keyed, gone)
    return without_rows(keyed, gone)
