"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

A fingerprint is cut into four blocks of 16 bits.  Two fingerprints that differ in at most two
bits agree in at least two blocks, so every such pair meets under one of the six pairs of
blocks.  Exact copies are folded into one fingerprint first; block keys that very many
fingerprints share are worked off through common neighbours instead of pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerline.llm._tools import ROW, cut, discard, hold, keyed_texts, release, whole_rows, with_row_keys

#: Two of the four 16-bit blocks, as masks over signed 64-bit fingerprints.
_MASKS = [(0xFFFF << 16 * i) | (0xFFFF << 16 * j) for i, j in combinations(range(4), 2)]
#: Block keys shared by more fingerprints than this are resolved without forming pairs.
PAIRS_UP_TO = 256
SEED = 42


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: str | None) -> int:
    """The signed 64-bit SimHash of the 3-word shingles of ``text`` (A-Z lower-cased)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = max(1, len(words) - 2)
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) < 3:
        digests = xxhash.xxh64_digest(whole, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        digest = xxhash.xxh64_digest
        digests = b"".join(
            [digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[2:] - 1).tolist(), strict=True)]
        )
    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(n, 64)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 255):
        counts += bits[i : i + 255].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


@F.arrow_udf(LongType())
def simhash_udf(texts: pa.Array) -> pa.Array:
    return pa.array([simhash(t) for t in texts.to_pylist()], pa.int64())


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges (u, v), u < v, over distinct ``fp`` that connect what lies within two bits.

    Block keys with few fingerprints give their verified pairs.  Where a key is shared by more
    than ``PAIRS_UP_TO``, the two agree on the key's 32 bits, and they lie within two bits of
    each other exactly if some point is within one bit of both: each fingerprint names its 33
    points, and a point ties those that name it (33 at most) to the least of them.  That joins
    the same fingerprints without the pairs; both ways lose no link.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(_MASKS)])
    blocks = fingerprints.select("fp", F.explode(keys).alias("b")).select("fp", "b.k", "b.key")
    sizes = blocks.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = blocks.join(sizes, ["k", "key"])
    few = sized.where(F.col("n") <= PAIRS_UP_TO)
    pairs = (
        few.select("k", "key", F.col("fp").alias("u"))
        .join(few.select("k", "key", F.col("fp").alias("v")), ["k", "key"])
        .where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2))
        .select("u", "v")
    )
    flips = F.create_map(
        *[
            x
            for i, m in enumerate(_MASKS)
            for x in (F.lit(i), F.array(*[F.lit(v) for v in [0, *[_signed(1 << b) for b in range(64) if not m >> b & 1]]]))
        ]
    )
    named = (
        sized.where(F.col("n") > PAIRS_UP_TO)
        .select("k", "fp", F.explode(F.element_at(flips, F.col("k"))).alias("flip"))
        .select("k", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    )
    least = named.groupBy("k", "point").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
    ties = named.join(least, ["k", "point"]).where("fp != u").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(ties).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the least node that it reaches.

    Alternating large and small stars: each round hangs neighbours under the least node known,
    in a number of rounds that grows with the logarithm of the longest chain.  Rounds are cut
    into tables; only their sizes and a checksum come to the driver.
    """
    state = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "stars")
    seen = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(nearest, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(nearest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, state = state, cut(small, "stars")
        discard(before)
        now = state.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if now == seen:
            heads = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            roots = cut(state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(heads), "roots")
            discard(state)
            return roots
        seen = now


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Null and empty texts have fingerprint 0 and link like any other.  component_id is the least
    doc_id reached, null ids aside; it is null where a component has no id.  Repeated rows share
    their component.  An empty table gives an empty table; other columns are not read.
    """
    return _grouped(docs, doc_id, text).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, doc_id: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id), and with ``carry`` its columns and the root of the component."""
    prints = cut(docs.select(F.col(doc_id).alias("doc_id"), simhash_udf(F.col(text)).alias("fp"), *carry), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(distinct.select("fp")))
    owner = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    ids = owner.groupBy("root").agg(F.min("least_id").alias("component_id"))
    more = ("root",) if carry else ()
    named = cut(owner.join(ids, "root").select("fp", "component_id", *more), "components")
    out = cut(prints.join(named, "fp").select("doc_id", "fp", "component_id", *more, *carry), "near-duplicates")
    discard(prints, named, roots)
    return out


def fingerprint_hex(fp: str | Column) -> Column:
    """16 lower-case hexadecimal digits of a signed fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One row of each component: of the least doc_id, null ones last, the first of the table."""
    release(docs)
    keyed = with_row_keys(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)).alias("head")
    grouped = _grouped(keyed_texts(keyed), "doc_id", "text", (ROW,))
    hold(keyed, grouped)
    heads = grouped.groupBy("root").agg(first)
    return whole_rows(keyed.join(heads.select(F.col(f"head.{ROW}").alias(ROW)), ROW, "left_semi"))
