"""Phrase collocations: mergeable Misra-Gries summaries per hash partition, then exact counts.

Texts are split into pieces and words where they are read, and packed into blocks.  First pass:
each block names its n-grams, of one word up to ``most_words``, as sorted hashes with their own
counts, one list for each range of hashes.  Each range adds its lists into one summary of fewer
counters than a capacity over (mass of the range) / threshold: where there are more, the count of the first one beyond
is taken off all.  All that is taken off together stays under the threshold, so every n-gram that
is frequent in the corpus survives; hashes that meet only raise an estimate.  Second pass: blocks
count the survivors by their words, and these counts are added by Spark, so they are exact.

Parts of a frequent phrase are at least as frequent, so the table of frequent n-grams holds every
number that a score needs.  Blocks, ranges and capacities are bounded, whatever a word's frequency.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import _tools as t

#: Fixed values of the task: piece ends and blanks; a piece end is written as the first of them.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_STOP = bytes.maketrans(_ENDS, b"." * len(_ENDS))
#: N-gram occurrences of the corpus for each range of hashes.
MASS_A_SHARD = 1 << 22
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25))
_BLOCK = "block long, langs array<string>, totals array<long>, label binary, lengths binary, tokens binary, words binary, mass long"
_BLOCK_ARROW = pa.schema(
    [("block", pa.int64()), ("langs", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("label", pa.binary()), ("lengths", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary()), ("mass", pa.int64())]
)


def split_words(text: str) -> list[bytes]:
    """Words (A-Z lower-cased), with a "." at every piece end; no word holds one."""
    return text.encode("utf-8", "replace").lower().translate(_TO_STOP).replace(b".", b" . ").split()


class Block(NamedTuple):
    """Token 0 is the end of a piece; each document begins with one."""

    number: int
    langs: list[str]
    lang: np.ndarray  # of each token
    tokens: np.ndarray
    words: list[bytes]


def _mass(tokens: np.ndarray, most_words: int) -> int:
    ends = np.flatnonzero(tokens == 0)
    run = np.diff(np.append(ends, len(tokens))) - 1
    return int(sum(np.maximum(run - n, 0).sum() for n in range(most_words)))


def _pack(docs: DataFrame, lang: str, text: str, most_words: int, block_bytes: int) -> DataFrame:
    """One row a block of about ``block_bytes`` of texts, each task packing the rows that it reads."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0

        def fresh():
            known: dict[bytes, int] = defaultdict(itertools.count().__next__)
            langs: dict[str, int] = defaultdict(itertools.count().__next__)
            known[b"."]
            return known, langs, [], []

        known, langs, labels, parts = fresh()

        def block() -> pa.RecordBatch:
            tokens, label = np.concatenate(parts), np.array(labels, np.int64)
            totals = np.bincount(label, [int((p > 0).sum()) for p in parts], len(langs)).astype(np.int64)
            lengths = np.array([len(p) for p in parts], np.int64)
            values = [number, list(langs), totals.tolist(), t.pack_counts(label), t.pack_counts(lengths), t.pack_counts(tokens), b"\n".join(list(known)), _mass(tokens, most_words)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _BLOCK_ARROW.types, strict=True)], schema=_BLOCK_ARROW)

        for b in batches:
            for named, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = split_words(body or "")
                labels.append(langs["und" if named is None else named])
                parts.append(np.fromiter(map(known.__getitem__, [b".", *words]), np.int64, len(words) + 1))
                size += len(body or "") + 32
                if size >= block_bytes:
                    yield block()
                    number, size = number + 1, 0
                    known, langs, labels, parts = fresh()
        if parts:
            yield block()

    return docs.select(F.col(lang).cast("string"), F.col(text)).mapInArrow(pack, _BLOCK)


def _read(table: pa.Table | pa.RecordBatch) -> Block:
    at = lambda name: table[name][0].as_py()
    lengths = t.unpack_counts(at("lengths")).view(np.int64)
    lang = np.repeat(t.unpack_counts(at("label")).view(np.int64), lengths)
    return Block(at("block"), at("langs"), lang, t.unpack_counts(at("tokens")).view(np.int64), at("words").split(b"\n"))


def _keys(b: Block, most_words: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per n: where n-grams start in the block, and the ``bits``-bit hashes of (language, words)."""
    digest = lambda w: xxhash.xxh64_intdigest(w, 42)
    words = t.mix64(np.fromiter(map(digest, b.words), np.uint64, len(b.words)))
    langs = t.mix64(np.fromiter((digest(x.encode("utf-8", "replace")) for x in b.langs), np.uint64, len(b.langs)))
    hashed, inside, out = words[b.tokens], b.tokens > 0, []
    total, good = langs[b.lang], np.ones(len(b.tokens), bool)
    for n in range(1, most_words + 1):
        m = max(len(hashed) - n + 1, 0)
        total = total[:m] + hashed[n - 1 :] * (_ODD[(n - 1) % len(_ODD)] + np.uint64(2 * n))
        good = good[:m] & inside[n - 1 :]
        start = np.flatnonzero(good)
        out.append((start, t.mix64(total[start] + np.uint64(n)) >> np.uint64(64 - bits)))
    return out


class Plan(NamedTuple):
    """Numbers that follow from the corpus size and are shipped to every task."""

    most_words: int
    threshold: int
    n_shards: int
    bits: int


def _distinct(b: Block, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([k for _, k in _keys(b, plan.most_words, plan.bits)]), return_counts=True)


def add_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys added together, in the order of the keys."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merge_summaries(parts: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, counts, taken off) of the Misra-Gries summary of at most ``capacity`` counters.

    A key's true count is its counter, or 0 where it has none, plus at most what was taken off;
    and taken off times (capacity + 1) is at most the sum of all counts.
    """
    keys, counts, off = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    waiting, held = [], 0
    for i, (k, c) in enumerate(parts):
        waiting.append((k, c.astype(np.int64)))
        held += len(k)
        if held > capacity or i == len(parts) - 1:
            keys, counts = add_counts(np.concatenate([keys, *[x for x, _ in waiting]]), np.concatenate([counts, *[x for _, x in waiting]]))
            waiting, held = [], 0
            if len(keys) > capacity:
                least = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
                left = counts > least
                keys, counts, off = keys[left], counts[left] - least, off + least
    return keys, counts, off


def _survivors(table: pa.Table, plan: Plan) -> pa.Table:
    """One range of hashes: its summary, and which of the n-grams that each block named may be frequent."""
    table = table.sort_by("block")
    named = [t.unpack_sorted(x) for x in table["keys"].to_pylist()]
    counts = [t.unpack_counts(x[0]) for x in table["sums"].to_pylist()]
    mass = int(sum(int(c.sum()) for c in counts))
    keys, found, off = merge_summaries(list(zip(named, counts, strict=True)), mass // plan.threshold + 1)
    keys = keys[found + off >= plan.threshold]
    rows, shard = [], table["shard"][0].as_py()
    for block, k in zip(table["block"].to_pylist(), named, strict=True):
        at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
        known = keys[at] == k if len(keys) else np.zeros(len(k), bool)
        rows.append((block, shard, [np.packbits(known).tobytes()]))
    return t.rows_of(rows, t.REPLY_ARROW)


_COUNTS = "lang string, n_words int, phrase string, f long"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("n_words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _count(table: pa.Table, replies: pa.Table, plan: Plan) -> pa.Table:
    """A block's own counts of the surviving n-grams, told apart by their words."""
    if not table.num_rows:
        return _COUNTS_ARROW.empty_table()
    b = _read(table)
    keys, _ = _distinct(b, plan)
    at, alive = t.shard_bounds(keys, plan.n_shards, plan.bits), np.zeros(len(keys), bool)
    for s, bits in zip(replies["shard"].to_pylist(), replies["sums"].to_pylist(), strict=True):
        alive[at[s] : at[s + 1]] = np.unpackbits(np.frombuffer(bits[0], np.uint8), count=at[s + 1] - at[s])
    words, langs, parts = pa.array([w.decode("utf-8") for w in b.words], pa.string()), pa.array(b.langs, pa.string()), []
    for n, (start, key) in enumerate(_keys(b, plan.most_words, plan.bits), 1):
        start = start[alive[np.searchsorted(keys, key)]]
        group, lead = b.lang[start], start
        for i in range(n):  # word by word, so that the numbers stay small
            _, lead, group = np.unique(group * len(b.words) + b.tokens[start + i], return_index=True, return_inverse=True)
        lead = start[lead]
        phrase = words.take(pa.array(b.tokens[lead]))
        for i in range(1, n):
            phrase = pc.binary_join_element_wise(phrase, words.take(pa.array(b.tokens[lead + i])), " ")
        columns = [langs.take(pa.array(b.lang[lead])), pa.array(np.full(len(lead), n, np.int32)), phrase, pa.array(np.bincount(group, minlength=len(lead)).astype(np.int64))]
        parts.append(pa.Table.from_arrays(columns, schema=_COUNTS_ARROW))
    return pa.concat_tables(parts)


def frequent_ngrams(docs: DataFrame, threshold: int = 10, most_words: int = 3, lang: str = "lang", text: str = "text", block_bytes: int = 6 << 20) -> tuple[DataFrame, DataFrame]:
    """(n-grams, totals) of ``docs``: (lang, n_words, phrase, f) of every n-gram of one to ``most_words`` words with f >= ``threshold``, and (lang, n), all words of each language.

    Counts are exact.  A null language is ``und``; null and empty texts have no words, and a
    language without a word has no row.  Repeated rows count each; a text of any length is one
    block; an empty table gives empty tables; other columns are not read.
    """
    blocks = t.cut(_pack(docs, lang, text, most_words, block_bytes), "phrase-blocks", bucket="block")
    mass = blocks.agg(F.sum("mass")).first()[0] or 0  # one number, from which ranges and hash widths follow
    plan = Plan(most_words, max(1, threshold), max(1, mass // MASS_A_SHARD), min(64, max(32, int(mass).bit_length() + 8)))

    def name(table: pa.RecordBatch) -> pa.Table:
        b = _read(table)
        keys, counts = _distinct(b, plan)
        return t.request_rows(b.number, keys, [counts], plan.n_shards, plan.bits)

    named = blocks.mapInArrow(t.as_batches(name), t.REQUEST)
    alive = t.cut(t.by_shard(named, plan.n_shards).applyInArrow(lambda x: _survivors(x, plan), t.REPLY), "surviving-ngrams")
    counted = blocks.groupBy("block").cogroup(alive.groupBy("block")).applyInArrow(lambda a, r: _count(a, r, plan), _COUNTS)
    whole = counted.groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= threshold)
    ngrams = t.cut(whole, "frequent-ngrams")
    totals = t.cut(blocks.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("n")).where("n > 0"), "words-by-language")
    t.discard(blocks, alive)
    return ngrams, totals


def scored_phrases(ngrams: DataFrame, share: int = 50) -> DataFrame:
    """(lang, phrase, n_words, a, l, r, score) of the phrases of two words or more in a table of frequent n-grams.

    The score of a cut into l and r is floor(1000000 * a * a / (l * r)), in decimals of 38 digits;
    the lowest cut counts, ties to the smallest first part.  A phrase goes where a longer one of
    the table holds its words one after the other, with 100 * f >= ``share`` * a.
    """
    words = F.split("phrase", " ")
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    phrases = ngrams.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), words.alias("w"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "n_words", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"))
    side = lambda name, count: ngrams.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    both = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    exact = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r")}
    both = both.withColumns({f"{c}_": v for c, v in exact.items()}).withColumn("score", F.expr("(1000000BD * (a_ * a_)) div (l_ * r_)"))
    lowest = both.groupBy("lang", "phrase", "n_words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    longer = phrases.where("n_words > 2").select("lang", "a", "w", "n_words", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("size"))
    longer = longer.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)).alias("start"))
    around = longer.groupBy("lang", part(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("around"))
    kept = lowest.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < share * F.col("a")))
    return kept.select("lang", "phrase", "n_words", "a", "s.l", "s.r", "s.score")


def collocations(docs: DataFrame, threshold: int = 10, most_words: int = 3, share: int = 50, top: int = 2000, lang: str = "lang", text: str = "text", block_bytes: int = 6 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    By score, then count, both descending, then phrase in byte order; see :func:`frequent_ngrams`
    and :func:`scored_phrases` for what counts.  Ranks begin with 1 and have no ties.  Tasks cut
    their own rows to ``top`` a language before these meet.
    """
    ngrams, totals = frequent_ngrams(docs, threshold, most_words, lang, text, block_bytes)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored_phrases(ngrams, share).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    out = t.cut(ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    t.discard(ngrams, totals)
    return out
