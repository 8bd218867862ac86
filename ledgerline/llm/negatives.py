"""Hard negatives by exact scores from a residue number system.

Components become integers.  A block of anchors meets a block of rows as matrix products modulo a
few small primes: residues lie around zero and are so small that float32 adds them without
rounding, strip by strip of the dimensions.  Mixed-radix digits (Garner's form of Chinese
remaindering) give back the exact signed scores; the primes are so many that their product passes
twice the largest score that the rows' lengths allow.

A first meeting gives each anchor its positives, a second one the rows in the range that each
positive sets.  Blocks keep only what can be among the first of all blocks; Spark's windows choose
among these.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import _tools as t

#: Numbers held by a block of rows and by a block of anchors (rows times dimensions), and anchors scored at once.
BLOCK_NUMBERS, STRIP = 1 << 22, 32
#: float32 holds every integer up to this one.
_EXACT = 1 << 24


@lru_cache
def primes_for(limit: int, most: int = 1024) -> tuple[int, ...]:
    """The largest primes up to ``most`` whose product passes 2 * ``limit`` + 1, so that signed values within the limit differ."""
    out, product = [], 1
    for p in range(most, 2, -1):
        if product > 2 * limit + 1:
            break
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            out.append(p)
            product *= p
    return tuple(out)


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """int64 values modulo ``p``, from -(p - 1) / 2 to (p - 1) / 2, as float32."""
    r = values % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def product_modulo(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p`` of residue matrices, each strip of dimensions exact in float32."""
    width = max(1, _EXACT // (p // 2) ** 2)
    total = np.zeros((len(a), len(b)), np.int64)
    for s in range(0, a.shape[1], width):
        total += (a[:, s : s + width] @ b[:, s : s + width].T).astype(np.int64)
    return total % p


def from_residues(parts: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The signed values within half the primes' product that have these residues, by mixed-radix digits.

    Sums are taken modulo 2**64, so the product may pass 64 bits where the values do not.
    """
    digits: list[np.ndarray] = []
    for part, p in zip(parts, primes, strict=True):
        so_far, radix = np.zeros_like(part), 1
        for d, q in zip(digits, primes, strict=False):
            so_far = (so_far + d * (radix % p)) % p
            radix = radix * q
        digits.append((part - so_far) * pow(radix, -1, p) % p)
    product = math.prod(primes)
    half, above = product // 2, np.zeros(parts[0].shape, bool)
    for d, p in zip(digits, primes, strict=True):  # from the lowest digit up: the last that differs decides
        half, h = divmod(half, p)
        above = np.where(d == h, above, d > h)
    value, radix = np.zeros(parts[0].shape, np.uint64), 1
    for d, p in zip(digits, primes, strict=True):
        value += d.astype(np.uint64) * np.uint64(radix % (1 << 64))
        radix *= p
    return (value - np.where(above, np.uint64(product % (1 << 64)), np.uint64(0))).view(np.int64)


class Residues:
    """A matrix of integers modulo each prime, ready for products."""

    def __init__(self, values: np.ndarray, primes: tuple[int, ...]):
        self.primes, self.parts = primes, [residues(values, p) for p in primes]

    def scores(self, other: Residues, rows: slice) -> np.ndarray:
        """Exact inner products of some rows of this matrix with all of ``other``."""
        return from_residues([product_modulo(a[rows], b, p) for a, b, p in zip(self.parts, other.parts, self.primes, strict=True)], self.primes)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, the largest first, ties to the first place."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return at[np.argsort(-scores[at], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")[:k]


_POSITIVES = "anchor long, place long, positive_id long, positive_row long, positive_score long"
_NEGATIVES = "anchor long, place long, negative_id long, negative_row long, negative_score long"


def _tile(anchors: pa.Table, rows: pa.Table, dim: int, primes: tuple[int, ...], choose, names: list[str]) -> pa.Table:
    """``choose(i, scores, other, alike)`` names (place, row) pairs of interest of each anchor of a tile."""
    found = [np.zeros((5, 0), np.int64)]
    if anchors.num_rows and rows.num_rows:
        rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])  # so ties go to the smaller id
        ids, row, label = (rows[c].to_numpy() for c in ("id", "row", "label"))
        own, own_label = anchors["own"].to_numpy(), anchors["own_label"].to_numpy()
        a, b = Residues(_matrix(anchors["own_v"], dim), primes), Residues(_matrix(rows["v"], dim), primes)
        for s in range(0, len(own), STRIP):
            for i, scores in enumerate(a.scores(b, slice(s, s + STRIP)), s):
                for place, at in choose(anchors, i, scores, row != own[i], label == own_label[i]):
                    found.append(np.stack([np.full(len(at), own[i]), np.full(len(at), place), ids[at], row[at], scores[at]]))
    return pa.Table.from_arrays([pa.array(x) for x in np.concatenate(found, 1)], names)


def _meet(anchors: DataFrame, rows: DataFrame, tile, kind: str) -> DataFrame:
    return anchors.groupBy("i", "j").cogroup(rows.groupBy("i", "j")).applyInArrow(tile, kind)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    range_percent: tuple[int, int] = (30, 90),
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    scale: int = 256,
    dim: int | None = None,
    block_numbers: int = BLOCK_NUMBERS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x becomes floor(scale * x), x as double; a score is the inner product of integers.
    An anchor's positives are its first ``positives`` other rows of its label by score, ties to the
    smaller id; for each, the first ``negatives`` rows of other labels whose scores lie within
    ``range_percent`` of the positive's (both ends in; none for a negative positive score) are
    returned, ranked from 1.

    Rows take no part where the id, label or vector is null, a component is null or not finite, or
    the vector has another length than ``dim`` (by default the commonest; there is no inner product
    with them).  Repeated rows count each, also rows that share an id; a repeated anchor is another
    anchor.  An empty table gives an empty table; other columns are not read.  Scores are of 64
    bits: rows so long that one could pass them are refused.
    """
    spark, one = vectors.sparkSession, F.col(vector)
    wanted = F.col(label) if isinstance(label, str) else label
    fine = F.forall(one, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = vectors.where(F.col(vec_id).isNotNull() & wanted.isNotNull() & one.isNotNull() & F.coalesce(fine, F.lit(False)))
    if dim is None:
        top = sound.groupBy(F.size(one).alias("n")).count().where("n > 0").orderBy(F.desc("count"), F.desc("n")).limit(1).collect()  # one row
        dim = top[0]["n"] if top else 1
    whole = F.transform(one, lambda x: F.floor(x.cast("double") * scale))
    squares = F.aggregate(F.transform(one, lambda x: F.floor(x.cast("double") * scale).cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    chosen = sound.where(F.size(one) == dim).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"), wanted.cast("long").alias("label"), whole.alias("v"), is_anchor.alias("is_anchor"), squares.alias("squares")
    )
    kept = t.cut(chosen, "whole-vectors")
    n, n_anchors, longest = kept.agg(F.count("*"), F.count_if("is_anchor"), F.max("squares")).first()
    if longest and longest >= 2.0**62:
        raise ValueError("scores of these vectors can pass 64 bits")
    primes = primes_for(int((longest or 0) * 1.001) + 1)
    block_rows = max(1, block_numbers // dim)
    share = -(-n // (2 * spark.sparkContext.defaultParallelism))  # two blocks a task slot, of 512 rows at least
    n_rows, n_anchor = max(1, -(-n // min(block_rows, max(share, 512)))), max(1, -(-n_anchors // block_rows))
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    block = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    held = kept.select(block("row", n_rows).alias("i"), spread(n_anchor).alias("j"), "row", "id", "label", "v")
    anchors = kept.where("is_anchor")
    dealt = lambda df, *more: df.select(spread(n_rows).alias("i"), block("row", n_anchor).alias("j"), *[F.col(c).alias(n) for c, n in (("row", "own"), ("label", "own_label"), ("v", "own_v"))], *more)

    def near(_, __, scores, other, alike):
        at = np.flatnonzero(other & alike)
        yield 0, at[_first(scores[at], positives)]

    def positive_tile(a: pa.Table, b: pa.Table) -> pa.Table:
        return _tile(a, b, dim, primes, near, ["anchor", "place", "positive_id", "positive_row", "positive_score"])

    by_score = lambda who, *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(f"{who}_score"), f"{who}_id", f"{who}_row"))
    best = _meet(dealt(anchors), held, positive_tile, _POSITIVES).withColumn("place", by_score("positive", "anchor").cast("long")).where(F.col("place") <= positives)
    best = t.cut(best, "positives")
    low, high = range_percent
    lists = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", F.col("positive_score").alias("score")))).alias("p"))  # as many as ``positives``
    asking = anchors.join(lists.withColumnRenamed("anchor", "row"), "row").withColumns({"places": F.col("p.place"), "scores": F.col("p.score")})

    def within(a, i, scores, other, alike):
        bounds = [(p, -(-low * s // 100), high * s // 100) for p, s in zip(a["places"][i].as_py(), a["scores"][i].as_py(), strict=True)]
        least, most = min(x for _, x, _ in bounds), max(x for _, _, x in bounds)
        at = np.flatnonzero(~alike & (scores >= least) & (scores <= most))
        for p, lo, hi in bounds:
            inside = at[(scores[at] >= lo) & (scores[at] <= hi)]
            if len(inside):
                yield p, inside[_first(scores[inside], negatives)]

    def negative_tile(a: pa.Table, b: pa.Table) -> pa.Table:
        return _tile(a, b, dim, primes, within, ["anchor", "place", "negative_id", "negative_row", "negative_score"])

    found = _meet(dealt(asking, "places", "scores"), held, negative_tile, _NEGATIVES)
    ranked = found.withColumn("rank", by_score("negative", "anchor", "place")).where(F.col("rank") <= negatives)
    named = kept.where("is_anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = ranked.join(best.select("anchor", "place", "positive_id", "positive_score"), ["anchor", "place"]).join(named, "anchor")
    out = t.cut(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "hard-negatives")
    t.discard(kept, best)
    return out
