"""Nearest neighbours by randomly rotated one-bit codes with error bounds (after RaBitQ).

Vectors are centred, normalised, rotated at random and reduced to the signs of their coordinates,
packed into bytes, with two correction scalars: the length and the code's agreement with the
vector.  These give an unbiased estimate of an inner product and a bound of its error.  The vectors
of a query's best estimates are scored exactly, in doubles; the k-th of these scores is a floor,
and of all other vectors only those whose upper bound reaches it are scored.

Equal vectors are indexed once, with their smallest ids.  A block of queries meets a block of the
index as one group; blocks are so many that the session's tasks share them, and so large that the
queries sent to each index block, and the vectors sent to each query block, stay few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm._tools import cut, discard

#: Rows of a block of the index at least and at most, and of a block of queries at most.
INDEX_BLOCK, QUERY_BLOCK = (512, 65_536), 65_536
#: How many times k vectors are scored for the floor.
FIRST = 8


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: Column, dim: int) -> Column:
    """Of the wanted length, not zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, lengths, agreements) of centred vectors; agreement is 1 for length 0."""
    rest = vectors - centre
    length = np.linalg.norm(rest, axis=1)
    unit = rest / np.where(length > 0, length, 1)[:, None] @ turn.T
    agree = np.abs(unit).sum(1) / np.sqrt(vectors.shape[1])
    return np.packbits(unit > 0, axis=1), length, np.where(length > 0, agree, 1.0)


class Codes:
    """The packed codes of a block of the index, ready to estimate inner products with queries."""

    def __init__(self, bits: np.ndarray, length: np.ndarray, agree: np.ndarray, centre: np.ndarray, turn: np.ndarray, width: float):
        dim = len(centre)
        self.signs = ((np.unpackbits(bits, axis=1)[:, :dim].astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))).T
        self.scale = (length / agree).astype(np.float32)
        spread = width * length * np.sqrt(np.maximum(1 - agree**2, 0)) / agree / np.sqrt(max(dim - 1, 1))
        self.spread = (spread + 1e-6 * length).astype(np.float32)
        self.centre, self.turn = centre, turn

    def estimate(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimates, error bounds) of queries (rows) by vectors (columns)."""
        at = (queries @ self.turn.T).astype(np.float32) @ self.signs * self.scale + (queries @ self.centre).astype(np.float32)[:, None]
        return at, np.linalg.norm(queries, axis=1).astype(np.float32)[:, None] * self.spread


def best_of(query: np.ndarray, vectors: np.ndarray, estimate: np.ndarray, error: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, exact scores, how many were scored) of all vectors that reach the k-th best score found.

    The vectors of the best ``FIRST`` times k estimates set the floor that upper bounds have to reach.
    """
    if len(estimate) <= k:
        return np.arange(len(estimate)), vectors @ query, len(estimate)
    n = min(FIRST * k, len(estimate))
    first = np.argpartition(estimate, len(estimate) - n)[-n:]
    floor = np.partition(vectors[first] @ query, n - k)[n - k]
    chosen = np.flatnonzero(estimate + error >= floor)
    chosen = np.union1d(chosen, first)
    exact = vectors[chosen] @ query
    least = np.partition(exact, len(exact) - k)[len(exact) - k]
    return chosen[exact >= least], exact[exact >= least], len(chosen)


_TILE = "query_id long, place long, score double, scored long"


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dim: int | None = None,
    seed: int = 11,
    width: float = 2.0,
    index_block: tuple[int, int] = INDEX_BLOCK,
    query_block: int = QUERY_BLOCK,
    centre_rows: int = 4_096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest inner product per query.

    Every row but the query's own is a candidate; nearest first, ties to the smaller id.  Vectors
    that are null, zero, of another length than ``dim`` (by default the commonest; there is no
    inner product with them), or that hold null or non-finite components take no part, nor do rows
    without an id; a repeated id with the same vector counts once, with another vector as another
    candidate (its best score) and as another query under the same id.  An empty table gives an
    empty table.  ``width`` is the number of standard errors in the bound: at 2, a vector among the
    k nearest is missed about once in forty.  The centre is the mean of the
    ``centre_rows`` vectors of least hash (it moves the codes' precision only); every vector is
    indexed.
    """
    if dim is None:
        lengths = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count()
        top = lengths.orderBy(F.desc("count"), F.desc("n")).limit(1).collect()  # one row
        dim = top[0]["n"] if top and top[0]["n"] > 0 else 1
    sound = vectors.where(usable(F.col(vector), dim) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q")
    )
    keyed = sound.withColumn("key", F.unhex(F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)))
    first = keyed.withColumn("r", F.dense_rank().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1)
    kept = cut(first.select("key", "id", "r", F.when(F.col("r") == 1, F.col("v")).alias("v")).distinct(), "vector-ids")
    single = kept.where("r = 1").dropDuplicates(["key"]).select("key", F.xxhash64("key").alias("h"), "v")
    sample = single.orderBy("h", "key").limit(centre_rows).select("v").toPandas()
    centre = np.mean(np.stack(sample["v"].to_list()).astype(float), axis=0) if len(sample) else np.zeros(dim)
    turn = rotation(dim, seed)

    def code(batches):
        for b in batches:
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            bits, length, agree = encode(v, centre, turn)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(length), pa.array(agree)], ["place", "key", "v", "bits", "length", "agree"])

    kind = f"array<{vectors.schema[vector].dataType.elementType.simpleString()}>"
    coded = single.select(F.monotonically_increasing_id().alias("place"), "key", "v").mapInArrow(code, f"place long, key binary, v {kind}, bits binary, length double, agree double")
    coded = cut(coded, "codes")
    asked = keyed.where("q").select(F.col("id").alias("query_id"), "v").dropDuplicates(["query_id", "v"])
    n_index, n_queries = coded.count(), asked.count()
    share = -(-n_index // (4 * vectors.sparkSession.sparkContext.defaultParallelism))  # four blocks a task slot
    index_blocks = max(1, -(-n_index // min(max(share, index_block[0]), index_block[1])))
    query_blocks = max(1, -(-n_queries // query_block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")  # noqa: E731  (both sides need one type to meet)
    left = coded.select(block("key", index_blocks).alias("i"), spread(query_blocks).alias("j"), "place", "v", "bits", "length", "agree")
    right = asked.select(spread(index_blocks).alias("i"), block("query_id", query_blocks).alias("j"), "query_id", F.col("v").alias("qv"))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        if a.num_rows and b.num_rows:
            flat = lambda x: x.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            v, q = flat(a["v"]), flat(b["qv"])
            bits = np.frombuffer(b"".join(a["bits"].to_pylist()), np.uint8).reshape(a.num_rows, -1)
            length, agree, place = (a[c].to_numpy() for c in ("length", "agree", "place"))
            codes = Codes(bits, length, agree, centre, turn, width)
            for s in range(0, len(q), 64):
                estimates, errors = codes.estimate(q[s : s + 64])
                for query, query_id, estimate, error in zip(q[s : s + 64], b["query_id"][s : s + 64].to_pylist(), estimates, errors, strict=True):
                    chosen, exact, scored = best_of(query, v, estimate, error, k + 1)
                    found.append((np.full(len(chosen), query_id), place[chosen], exact, np.full(len(chosen), scored)))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "place", "score", "scored"])

    near = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(tile, _TILE)
    members = kept.join(coded.select("key", "place"), "key").select("place", F.col("id").alias("vec_id")).distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = (
        near.join(members, "place")
        .where("vec_id != query_id")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
    out = cut(ranked, "neighbours")
    discard(kept, coded)
    return out
