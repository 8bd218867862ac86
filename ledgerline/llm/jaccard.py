"""Documents whose sets of word n-grams are alike: size-banded tiles, bitmaps, exact intersections.

Sets of a Jaccard similarity of p per cent differ in at most (100 - p) * (sizes) / (100 + p)
n-grams.  Sizes fall into bands; a band's hash space is cut into more parts than two sets of its
sizes can differ in, so similar sets agree in a whole part.  Sets of a band that agree in a part
have the least of them as a leader, and what has one leader is a tile.  Sets that only share
passages agree in no whole part, so tiles hold near copies, and few others, however common a passage is.

In a tile every set is compared with the leader first; what hangs together then needs no further
comparison, and only where a tile holds several components its sets are compared across these,
nearest ones first, large tiles split into pairs of smaller ones.  A comparison first bounds the overlap from
above: bitmaps hold the parity of a set's n-grams by hash, so where they differ in b bits the sets
differ in b n-grams or more.  What passes has its sorted arrays intersected.  No pair of a tile is
left out that could add a link between components, so none is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from ledgerline.llm import _tools as t
from ledgerline.llm.simhash import components

#: Part keys of the corpus for each range of keys; sets of a half of a split tile, and rows of tiles that one group works on.
KEYS_A_SHARD, TILE, ROWS_A_GROUP = 1 << 19, 1024, 1 << 14
#: Sizes of the least and largest bitmap, in bits; a set has about eight times as many bits as n-grams.
LEAST_BITS, MOST_BITS = 64, 1 << 19
#: Rows of a batch whose texts are Python strings at a time.
SLICE = 256
#: How often a set with many empty parts is dealt anew.
DEALS = 4
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25))
_U32 = np.uint64(32)


class Rule(NamedTuple):
    """What counts as alike."""

    size: int  # words of an n-gram
    percent: int
    seed: int = 0

    def most_apart(self, sizes: int) -> int:
        """The most n-grams in which two alike sets with ``sizes`` n-grams in total can differ."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    def most_partner(self, n: int) -> int:
        """The size of the largest set that can be like one of ``n``."""
        return n * 100 // self.percent

    def bands(self, largest: int) -> list[int]:
        """Upper ends of the bands of sizes: a set is like sets of its own and the next band only."""
        out = [1]
        while self.most_apart(out[-1] + self.most_partner(out[-1])) == 0 and out[-1] < 1 << 20:
            out[-1] += 1
        out[-1] -= 1  # up to here only equal sets are alike
        # a band spans at most three partners' reach, and fewer where its smallest sets would leave parts empty
        parts = 1.1 * (100 - self.percent) / (100 + self.percent) * (1 + 100 / self.percent)
        steps = min(3, max(1, int(-math.log(2.5 * parts) / math.log(100 / self.percent)))) if parts and self.percent < 100 else 3
        while out[-1] < largest:
            n = out[-1]
            for _ in range(steps):
                n = self.most_partner(n) + 1
            out.append(n)
        return out


def shingle_sets(texts: list[str | None], rule: Rule) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams of words (A-Z lower-cased); a shorter text is one n-gram."""
    known: dict[bytes, int] = {}
    parts = [[known.setdefault(w, len(known)) for w in (x or "").encode("utf-8", "replace").lower().split()] for x in texts]
    digests = np.fromiter((xxhash.xxh64_intdigest(w, rule.seed) for w in known), np.uint64, len(known))
    hashed, out = t.mix64(digests), []
    for p in parts:
        h = hashed[np.array(p, np.int64)]
        n = min(rule.size, len(h))
        m = len(h) - n + 1 if n else 0
        total = np.full(m, n, np.uint64)
        for i in range(n):
            total = total + h[i : i + m] * (_ODD[i % len(_ODD)] + np.uint64(2 * i))
        out.append(np.unique(t.mix64(total)))
    return out


def identity(s: np.ndarray) -> tuple[int, int]:
    """A set's number, and a second digest by which equal numbers of different sets are noticed."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(a), int(b)


def part_keys(s: np.ndarray, rule: Rule, bands: list[int]) -> np.ndarray:
    """The keys of a set: one for each part of its band that has an n-gram, and, where it can be like a set of the band below, for those of that band.

    A band has so many parts that, with up to ``spare`` of them empty, two alike sets still agree
    in one that is not.  A set with more empty parts is dealt into parts anew, several times, and at
    last names its empty parts too.
    """
    n, out = len(s), []
    own = int(np.searchsorted(bands, n))
    for band in {own, own - 1 if own and n <= rule.most_partner(bands[own - 1]) else own}:
        apart = rule.most_apart(bands[band] + rule.most_partner(bands[band]))
        if not band:
            continue
        spare = 2 + apart // 10
        m = apart + 1 + spare
        for deal in range(DEALS):
            mixed = s if not deal else np.sort(t.mix64(s + np.uint64(deal)))
            part = ((mixed >> _U32) * np.uint64(m)) >> _U32
            first = np.flatnonzero(np.diff(part, prepend=~part[:1]))
            tag = np.uint64((band * DEALS + deal) << 32)
            out.append(t.mix64(np.add.reduceat(t.mix64(mixed ^ _ODD[3]), first) + t.mix64(part[first] + tag)))
            if m - len(first) <= spare:
                break
        else:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), part)
            out.append(t.mix64(empty + tag + np.uint64(1 << 63)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """The parity of the set's n-grams by hash, as bytes: about eight times as many bits as n-grams, a power of two."""
    bits = min(max(LEAST_BITS, 8 << max(len(s) - 1, 1).bit_length()), MOST_BITS)
    at = (t.mix64(s ^ _ODD[1]) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (or rows of bitmaps) brought to ``size`` bytes: parities of halves add up."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def can_be_alike(n: np.ndarray | int, m: np.ndarray | int, differ: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """Whether sets of ``n`` and ``m`` that differ in ``differ`` n-grams or more can reach the similarity."""
    return (100 + percent) * differ <= (100 - percent) * (n + m)


# -- blocks: sets and keys of the documents that one task reads ----------------------------

_BLOCK = "block long, ids binary, sizes binary, nodes binary, checks binary, key binary, owner binary, n_keys long, largest long"


def _blocks(docs: DataFrame, doc_id: str, text: str, rule: Rule, block_bytes: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting, size, bands = [], 0, rule.bands(1)

        def block() -> pa.RecordBatch:
            nonlocal bands
            sets = shingle_sets([x for _, x in waiting], rule)
            sizes = np.array([len(s) for s in sets], np.int64)
            if sizes.max() > bands[-1]:
                bands = rule.bands(int(sizes.max()))
            named = np.array([identity(s) if len(s) else (0, 0) for s in sets], np.int64).reshape(-1, 2)
            _, first = np.unique(named[:, 0], return_index=True)  # equal sets have equal keys
            first = first[sizes[first] > 0]
            keys = [part_keys(sets[i], rule, bands) for i in first]
            owner, key = np.repeat(first, [len(k) for k in keys]), np.concatenate([np.zeros(0, np.uint64), *keys])
            order = np.lexsort((named[owner, 0], key))
            ids = np.array([t.NO_ID if i is None else i for i, _ in waiting], np.int64)
            values = [number, ids.tobytes(), t.pack_counts(sizes), named[:, 0].tobytes(), named[:, 1].tobytes(), t.pack_sorted(key[order]), t.pack_counts(owner[order]), len(key), int(sizes.max())]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in values], [x.split()[0] for x in _BLOCK.split(", ")])

        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                for row in zip(*(b.column(c)[i : i + SLICE].to_pylist() for c in range(2)), strict=True):
                    waiting.append(row)
                    size += len(row[1] or "") + 32
                    if size >= block_bytes:
                        yield block()
                        number, size = number + 1, 0
                        waiting = []
        if waiting:
            yield block()

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(t.freeing_batches(pack), _BLOCK)


class Keys(NamedTuple):
    key: np.ndarray  # sorted, a row for each set of the block that has it
    node: np.ndarray
    distinct: np.ndarray
    at: np.ndarray  # where each distinct key begins


def _keys(table: pa.Table | pa.RecordBatch) -> Keys:
    nodes = np.frombuffer(table["nodes"][0].as_py(), np.int64)
    key = t.unpack_sorted(table["key"][0].as_py())
    node = nodes[t.unpack_counts(table["owner"][0].as_py()).view(np.int64)]
    distinct, at = np.unique(key, return_index=True)
    return Keys(key, node, distinct, at)


def _name_keys(table: pa.RecordBatch, n_shards: int) -> pa.Table:
    """A block's distinct keys, each with the least and the greatest of its sets."""
    k = _keys(table)
    if not len(k.key):
        return t.REQUEST_ARROW.empty_table()
    low, high = k.node[k.at], k.node[np.append(k.at[1:], len(k.key)) - 1]
    names, place = np.unique(np.concatenate([low, high]), return_inverse=True)
    place, at, rows = place.reshape(2, -1), t.shard_bounds(k.distinct, n_shards, 64), []
    for s, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if j > i:
            rows.append((s, table["block"][0].as_py(), t.pack_sorted(k.distinct[i:j]), [t.pack_counts(place[0, i:j]), t.pack_counts(place[1, i:j]), names.tobytes()]))
    return t.rows_of(rows, t.REQUEST_ARROW)


def _meet(table: pa.Table) -> pa.Table:
    """One range of keys: which keys of each block two different sets share, and the least of these sets."""
    keys, low, high = [t.unpack_sorted(x) for x in table["keys"].to_pylist()], [], []
    for sums in table["sums"].to_pylist():
        names = np.frombuffer(sums[2], np.int64)
        low.append(names[t.unpack_counts(sums[0]).view(np.int64)])
        high.append(names[t.unpack_counts(sums[1]).view(np.int64)])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    least, most = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(least, place, np.concatenate(low))
    np.maximum.at(most, place, np.concatenate(high))
    met, rows, begin = least != most, [], 0
    for block, k in zip(table["block"].to_pylist(), keys, strict=True):
        mine = place[begin : begin + len(k)]
        shared = met[mine]
        rows.append((block, table["shard"][0].as_py(), [np.packbits(shared).tobytes(), least[mine[shared]].tobytes()]))
        begin += len(k)
    return t.rows_of(rows, t.REPLY_ARROW)


_MET = "leader long, node long"


def _met(table: pa.Table, replies: pa.Table, n_shards: int) -> pa.Table:
    """The block's sets that share a key with others, with the least set that has it: distinct (leader, node)."""
    out = np.zeros((2, 0), np.int64)
    if table.num_rows:
        k = _keys(table)
        at, shared, leader = t.shard_bounds(k.distinct, n_shards, 64), np.zeros(len(k.distinct), bool), np.zeros(len(k.distinct), np.int64)
        for s, sums in zip(replies["shard"].to_pylist(), replies["sums"].to_pylist(), strict=True):
            bits = np.unpackbits(np.frombuffer(sums[0], np.uint8), count=at[s + 1] - at[s]).astype(bool)
            shared[at[s] : at[s + 1]] = bits
            leader[at[s] + np.flatnonzero(bits)] = np.frombuffer(sums[1], np.int64)
        place = np.searchsorted(k.distinct, k.key)
        chosen = np.flatnonzero(shared[place])
        out = np.unique(np.stack([leader[place[chosen]], k.node[chosen]]), axis=1)
    return pa.Table.from_arrays([pa.array(x) for x in out], ["leader", "node"])


_MEMBER = "block long, doc_id long, n long, node long, check long"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            at = lambda c: np.frombuffer(b[c][i].as_py(), np.int64)  # noqa: B023, E731
            ids, n = at("ids"), t.unpack_counts(b["sizes"][i].as_py()).view(np.int64)
            columns = [np.full(len(ids), b["block"][i].as_py()), pa.array(ids, mask=ids == t.NO_ID), n, at("nodes"), at("checks")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in _MEMBER.split(", ")])


# -- comparisons -----------------------------------------------------------------------------

_SET = "node long, n long, bits binary, items binary"


def _sets(docs: DataFrame, members: DataFrame, nodes: DataFrame, doc_id: str, text: str, rule: Rule) -> tuple[DataFrame, list[DataFrame]]:
    """(node, n, bits, items) of the sets named by ``nodes``, from the texts of one document each; and the tables that this reads.

    The sets are written once, dealt by node, so that joins on a node do not shuffle them.
    """
    nodes = t.cut(nodes.distinct(), "wanted-sets")
    wanted = members.where("n > 0").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("id"))
    known = F.coalesce(F.col(doc_id).cast("long"), F.lit(t.NO_ID))
    ids = t.cut(wanted.select(F.coalesce("id", F.lit(t.NO_ID)).alias("id")).distinct(), "wanted-documents")
    few = ids.count() <= t.BROADCAST_ROWS  # 8 bytes each
    texts = docs.select(known.alias("id"), F.col(text).alias("text")).join(F.broadcast(ids) if few else ids, "id", "left_semi").select("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies that one task reads are sent once
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                found = {identity(s)[0]: s for s in shingle_sets(b.column(0)[i : i + SLICE].to_pylist(), rule) if len(s)}
                sets = [s for k, s in found.items() if k not in seen]
                seen |= found.keys()
                columns = [[identity(s)[0] for s in sets], [len(s) for s in sets], [bitmap(s).tobytes() for s in sets], [s.tobytes() for s in sets]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["node", "n", "bits", "items"])

    held = t.cut(texts.mapInArrow(t.freeing_batches(scan), _SET), "sets", bucket="node")
    t.discard(ids)
    return held.join(nodes, "node", "left_semi").dropDuplicates(["node"]), [held, nodes]


@F.arrow_udf(LongType())
def _differ(a: pa.Array, b: pa.Array) -> pa.Array:
    """In how many bits two bitmaps differ, the larger one folded."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = (np.frombuffer(z.as_py(), np.uint8) for z in (x, y))
        size = min(len(x), len(y))
        out.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()))
    return pa.array(out, pa.int64())


def _alike(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of the distinct ``pairs`` (u, v) whose sets are alike, as a table: the bitmaps' bound first, then exact intersections.

    What the bitmaps leave is written in between: a task with both tests would have two Python workers, and Spark keeps them.
    """

    @F.arrow_udf(BooleanType())
    def enough(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
            short, long = (x, y) if len(x) < len(y) else (y, x)
            at = np.minimum(np.searchsorted(long, short), len(long) - 1)
            both = int((long[at] == short).sum())
            out.append(100 * both >= rule.percent * (len(x) + len(y) - both))
        return pa.array(out)

    side = lambda name, *cols: sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in cols])
    sized = pairs.join(side("v", "n", "bits"), "v").join(side("u", "n", "bits"), "u")
    close = sized.where(can_be_alike(F.col("n_u"), F.col("n_v"), F.lit(0), rule.percent) & (100 * F.least("n_u", "n_v") >= rule.percent * F.greatest("n_u", "n_v")))
    close = close.where((100 + rule.percent) * _differ("bits_u", "bits_v") <= (100 - rule.percent) * (F.col("n_u") + F.col("n_v"))).select("u", "v")
    close = t.cut(close, "close-pairs")
    out = t.cut(close.join(side("v", "items"), "v").join(side("u", "items"), "u").where(enough("items_u", "items_v")).select("u", "v"), "alike-pairs")
    t.discard(close)
    return out


_PAIR = "u long, v long, unfinished long"


def _allowed(bits: np.ndarray, n: np.ndarray, first: np.ndarray, second: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (first, second) of a tile the sizes and bitmaps allow, and in how many bits they differ."""
    low, high = np.minimum(n[first], n[second]), np.maximum(n[first], n[second])
    near = np.flatnonzero(100 * low >= rule.percent * high)
    first, second = first[near], second[near]
    step = max(1, (1 << 22) // bits.shape[1])
    differ = np.concatenate([np.zeros(0, np.int64), *[np.bitwise_count(bits[first[k : k + step]] ^ bits[second[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(first), step)]])
    fine = can_be_alike(n[first], n[second], differ, rule.percent)
    return near[fine], differ[fine]


def _nearest(first: np.ndarray, second: np.ndarray, differ: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Of the pairs (first, second) those that are, for one of their sets, the nearest to the other's component."""
    each = np.stack([np.append(first, second), np.append(roots[second], roots[first]), np.tile(differ, 2), np.tile(np.arange(len(first)), 2)])
    each = each[:, np.lexsort(each[[2, 1, 0]])]
    lead = np.ones(each.shape[1], bool)
    lead[1:] = (np.diff(each[0]) != 0) | (np.diff(each[1]) != 0)
    return np.unique(each[3, lead])


def _tile_pairs(table: pa.Table, rule: Rule, best: bool) -> pa.Table:
    """Pairs of tiles that lie in different components and that the bitmaps allow.

    With ``best``, a tile that has more such pairs than sets gives only the pair of the fewest
    differing bits of each set and other component, and its leader as ``unfinished``.
    """
    columns = {c: table[c].to_numpy() for c in ("leader", "i", "j", "n", "node", "root", "half")}
    order = np.lexsort([columns[c] for c in ("half", "j", "i", "leader")])
    leader, i, j, n, node, root, half = (columns[c][order] for c in ("leader", "i", "j", "n", "node", "root", "half"))
    held, found, unfinished = table["bits"].to_pylist(), [np.zeros((2, 0), np.int64)], []
    edge = np.flatnonzero((np.diff(leader) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
    for begin, end in zip([0, *edge.tolist()], [*edge.tolist(), len(leader)], strict=True):
        roots, halves = root[begin:end], half[begin:end]
        if (roots == roots[0]).all():
            continue
        bits = [np.frombuffer(held[k], np.uint8) for k in order[begin:end]]
        size = min(map(len, bits))
        bits = np.stack([folded(b, size) for b in bits])
        sizes, nodes, made = n[begin:end], node[begin:end], [np.zeros((3, 0), np.int64)]
        split = int(np.searchsorted(halves, j[begin])) if i[begin] != j[begin] else 0  # the first half's rows stand first
        step = max(1, (1 << 18) // len(nodes))
        for x in range(0, split or len(nodes), step):
            rows = np.arange(x, min(x + step, split or len(nodes)))
            first, second = np.nonzero((roots[rows][:, None] != roots[None, split:]) & (True if split else rows[:, None] < np.arange(len(nodes))[None, :]))
            first, second = rows[first], second + split
            at, differ = _allowed(bits, sizes, first, second, rule)
            made.append(np.stack([first[at], second[at], differ]))
        first, second, differ = np.concatenate(made, 1)
        if best and len(first) > len(nodes):
            at = _nearest(first, second, differ, roots)
            if len(at) < len(first):
                unfinished.append(leader[begin])
            first, second = first[at], second[at]
        found.append(np.sort(np.stack([nodes[first], nodes[second]]), axis=0))
    u, v = np.unique(np.concatenate(found, 1), axis=1)
    none = pa.nulls(len(unfinished), pa.int64())
    ends = [pa.chunked_array([pa.array(c), none]).combine_chunks() for c in (u, v)]
    return pa.Table.from_arrays([*ends, pa.array([None] * len(u) + unfinished, pa.int64())], [x.split()[0] for x in _PAIR.split(", ")])


def _across(tiles: DataFrame, roots: DataFrame, tested: DataFrame, sets: DataFrame, rule: Rule, best: bool) -> tuple[DataFrame, DataFrame]:
    """(pairs, leaders): the pairs (u, v), u < v, of ``tiles(leader, node)`` that lie in different components, are allowed by the bitmaps and not tested; and the tiles that have more.

    Tiles of more sets than ``TILE`` are dealt into halves, and each two halves, and each half with
    itself, are a tile; many small tiles are one group of work.
    """
    rooted_ = tiles.join(roots, "node", "left").select("leader", "node", F.coalesce("root", "node").alias("root"))
    sizes = rooted_.groupBy("leader").agg(F.count("*").alias("g"), F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("leader", "g")
    sized = t.cut(rooted_.join(sizes, "leader"), "open-tiles")
    n_groups = max(1, sized.count() // ROWS_A_GROUP)
    halves = F.ceil(F.col("g") / TILE).cast("int")
    split = sized.withColumn("half", F.pmod(F.xxhash64("node"), halves).cast("int"))
    split = split.select("leader", "node", "root", "half", F.explode(F.sequence(F.lit(0), halves - 1)).alias("to")).select("leader", "node", "root", "half", F.least("half", "to").alias("i"), F.greatest("half", "to").alias("j"))
    split = split.join(sets.select("node", "n", "bits"), "node").withColumn("group", F.pmod(F.xxhash64("leader", "i", "j"), F.lit(n_groups)))
    made = t.cut(split.groupBy("group").applyInArrow(lambda x: t.freed(_tile_pairs(x, rule, best)), _PAIR), "tile-pairs")
    pairs = t.cut(made.where("unfinished is null").select("u", "v").distinct().join(tested, ["u", "v"], "left_anti"), "pairs-across")
    leaders = t.cut(made.where("unfinished is not null").select(F.col("unfinished").alias("leader")).distinct(), "unfinished-tiles")
    t.discard(sized, made)
    return pairs, leaders


def linked(met: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(node, root) of the components that the alike sets of the tiles form.

    ``met(leader, node)``: sets that agree in a part with the leader, which is the least of those that
    do; what agrees with one leader is a tile, so sets that agree in a part share one.  First every
    set is compared with its leaders; then all pairs of tiles that lie across components and that the
    bitmaps allow, where a tile has very many only the nearest of each set and other component; last,
    in these tiles, all that still lie across.
    """
    led = met.where("node != leader").select(F.col("leader").alias("u"), F.col("node").alias("v"))
    tested = t.cut(led.distinct(), "tested-pairs")
    edges = _alike(tested, sets, rule)
    roots, leaders = components(edges), None
    for best in (True, False):
        tiles = met if leaders is None else met.join(leaders, "leader", "left_semi")
        pairs, unfinished = _across(tiles, roots, tested, sets, rule, best)
        if not pairs.isEmpty():
            more = _alike(pairs, sets, rule)
            grown = t.cut(edges.unionByName(more), "alike-pairs")
            both = t.cut(tested.unionByName(pairs), "tested-pairs")
            t.discard(edges, more, tested, roots)
            edges, tested, roots = grown, both, components(grown)
        t.discard(pairs, *([leaders] if leaders is not None else []))
        leaders = unfinished
        if leaders.isEmpty():
            break
    t.discard(tested, edges, leaders)
    return roots


def rooted(docs: DataFrame, rule: Rule, doc_id: str, text: str, block_bytes: int = 6 << 20) -> tuple[DataFrame, DataFrame]:
    """(members, roots) of ``docs``: (block, doc_id, n, node, check) of every row, and (node, root) of the sets that link."""
    while True:
        blocks = t.cut(_blocks(docs, doc_id, text, rule, block_bytes), "set-blocks", bucket="block")
        members = t.cut(blocks.mapInArrow(_members, _MEMBER), "set-members")
        clash = members.where("n > 0").groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a != b")
        if clash.isEmpty():
            break
        t.discard(blocks, members)  # two sets share a number: hash anew
        rule = rule._replace(seed=rule.seed + 1)
    n_keys = blocks.agg(F.sum("n_keys")).first()[0] or 0  # one number, from which the number of ranges follows
    n_shards = max(1, math.ceil(n_keys / KEYS_A_SHARD))
    named = blocks.mapInArrow(t.as_batches(lambda b: t.freed(_name_keys(b, n_shards))), t.REQUEST)
    replies = t.cut(t.by_shard(named, n_shards).applyInArrow(lambda x: t.freed(_meet(x)), t.REPLY), "shared-keys")
    met = t.cut(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda a, b: t.freed(_met(a, b, n_shards)), _MET).distinct(), "tiles")
    t.discard(blocks, replies)
    sets, held = _sets(docs, members, met.select("node"), doc_id, text, rule)
    roots = linked(met, sets, rule)
    t.discard(met, *held)
    return members, roots


def with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, n, node, root) of every row; a set of very many copies meets its root once a block, and the copies meet it there."""
    here = members.where("n > 0").select("block", "node").distinct().join(roots, "node")
    return members.join(here, ["block", "node"], "left").select("doc_id", "n", "node", F.when(F.col("n") > 0, F.col("root")).alias("root"))


def similar_documents(docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 6 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Rows link where 100 * intersection >= ``percent`` * union of their sets of ``size``-word n-grams;
    a text of fewer words is one n-gram.  component_id is the least doc_id that links reach, the
    row's own included and null ids aside; it is null where a component has no id.  Null, empty and
    wordless texts have no n-gram, link with nothing and keep their own id.  Repeated rows, and rows
    with equal sets, share their component; rows that share an id do not by that alone.  A text of
    any length is read whole; an empty table gives an empty table; other columns are not read.
    N-grams are told apart by 64-bit hashes within a pair.
    """
    members, roots = rooted(docs, Rule(size, percent), doc_id, text, block_bytes)
    distinct = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"))
    owned = distinct.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    ids = owned.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = t.cut(owned.join(ids, "root").select("node", F.col("component_id").alias("root")), "set-components")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("root"))
    out = t.cut(with_roots(members, named).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "similar-documents")
    t.discard(members, roots, named)
    return out
