"""Perplexity by an interpolated modified Kneser-Ney n-gram model counted over the corpus.

Tokens are words (A-Z lower-cased) and one end per text; contexts begin with start signs.  Blocks
of documents name their distinct n-grams as sorted 64-bit hashes with their own training counts;
each shard (an equal range of hashes) merges them into sorted arrays, memory-maps these and answers
the blocks.  Orders go from the highest to single words: below the highest, an n-gram's count is
the number of distinct words before it, and each n-gram's context learns the total and the numbers
of its followers with a count of one, two, three or more.

The shards' arrays are the model: ``train_model`` keeps them as a table in the shared folder, and
``score_texts`` looks other texts up in it.  No worker holds more than a shard, and a frequent word
adds one entry per block.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import _tools as t

_END, _START = b"\n", b"\n\n"  # no word holds a line break
FIRST = (_END, _START)
#: The block number of rows that carry a shard's summary, and of those that carry its arrays.
_SUMMARY, _ARRAYS = -1, -2
#: Tokens of the corpus for each shard.
TOKENS_A_SHARD = 1 << 21
_MIX = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)


def _split(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "replace").lower().split(), _END]


def word_keys(words: list[bytes], seed: int) -> np.ndarray:
    return t.mix64(np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)))


class Level(NamedTuple):
    """Keys of one order in a block: those of its n-grams, and of the start signs before a text."""

    keys: np.ndarray  # sorted distinct hashes
    gram: np.ndarray  # of each token: the place of the n-gram that ends there
    context: np.ndarray  # of each token: the place of the n words before it


def _factor(back: int) -> np.uint64:
    """What the word ``back`` places before the last is multiplied by in an n-gram's hash."""
    return np.uint64(_MIX[(back - 1) % len(_MIX)] + 2 * ((back - 1) // len(_MIX))) if back else np.uint64(1)


def _levels(b: t.Block, wanted: tuple[int, ...], order: int, seed: int) -> dict[int, Level]:
    """The wanted orders; start signs stand before the first word, so what stands before a later
    word is the n-gram that ends at the word before it."""
    words = word_keys(b.words, seed)
    hashed, starts = words[b.tokens], np.cumsum(b.lengths) - b.lengths
    place = np.arange(len(b.tokens)) - np.repeat(starts, b.lengths)
    total, out = np.zeros(len(hashed), np.uint64), {}
    start = np.zeros(1, np.uint64)  # the n-gram of start signs only
    scramble = lambda x, n: t.mix64(x + np.uint64(n)) if n > 1 else x
    for n in range(1, max(wanted) + 1):
        back = hashed if n == 1 else np.concatenate([np.zeros(n - 1, np.uint64), hashed[: -(n - 1) or None]])[: len(hashed)]
        total = total + np.where(place < n - 1, words[1], back) * _factor(n - 1)
        start = start + words[1] * _factor(n - 1)
        if n in wanted:
            more = scramble(start, n) if n < order else start[:0]
            keys, at = np.unique(np.concatenate([scramble(total, n), more]), return_inverse=True)
            context = np.concatenate([[0], at[: len(hashed)]])[: len(hashed)]
            if n < order:
                context[starts] = at[-1]
            out[n] = Level(keys, at[: len(hashed)], context)
    return out


def _first_tokens(at: np.ndarray, n: int) -> np.ndarray:
    last = np.zeros(n, np.int64)
    last[at] = np.arange(len(at))
    return last


#: Sums of an order's keys: its count, and as a context the total, the followers with counts 1, 2, 3 and more; words have their training count too.
N_TOP, N_LOWER, N_WORDS = 1, 5, 6


def _checks(words: list[bytes]) -> np.ndarray:
    """A second hash of words, by which two words with one key are noticed."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(16)


def _requests(table: pa.Table, replies: pa.Table | None, n: int, order: int, seed: int, n_shards: int) -> pa.Table:
    if not table.num_rows:
        return t.REQUEST_ARROW.empty_table()
    b = t.read_block(table, 0, FIRST)
    levels = _levels(b, (n,) if n == order else (n, n + 1), order, seed)
    level = levels[n]
    count = lambda x: np.bincount(x, minlength=len(level.keys))
    train = np.repeat(b.flags, b.lengths)
    if n == order:
        sums = [count(level.gram[train])]
    else:
        above = levels[n + 1]
        counts, own = _above(replies, above.keys, n + 1, order, n_shards)
        token = _first_tokens(above.gram, len(above.keys))[own > 0]
        c, into, after = counts[own > 0].astype(np.int64), level.gram[token], level.context[token]
        weight = np.bincount(after, c.astype(np.float64), len(level.keys)).astype(np.int64)
        sums = [count(into), weight, count(after[c == 1]), count(after[c == 2]), count(after[c >= 3])]
        if n == 1:
            sums.append(count(level.gram[train]))
    if n == 1:  # the start sign's own key stands among those of the words
        check = np.zeros(len(level.keys), np.uint64)
        check[np.searchsorted(level.keys, word_keys(b.words, seed)[[i for i in range(len(b.words)) if i != 1 or order > 1]])] = _checks([w for i, w in enumerate(b.words) if i != 1 or order > 1])
        sums.append(check)
    return t.request_rows(b.number, level.keys, sums, n_shards)


def _above(replies: pa.Table, keys: np.ndarray, n: int, order: int, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    sums = t.read_replies(replies, keys, n_shards, (N_TOP if n == order else N_LOWER) + 1)
    return sums[0], sums[-1]


def _histogram(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def _merge(words: bool, store: bool) -> Callable[[pa.Table], pa.Table]:
    """Merge a shard's requests into sorted arrays and answer every block in the order of its keys.

    With ``words`` the last column of a request is checks, which have to agree at equal keys.

    Each block gets the totals at its keys, and of each whether it is the first block in which the
    n-gram was counted, so that every n-gram has one owner.
    """

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        asked = [t.unpack_sorted(x) for x in table["keys"].to_pylist()]
        keys, place = np.unique(np.concatenate(asked), return_inverse=True)
        n_sums, met = len(table["sums"][0]) - words, 0
        if words:
            checks = np.concatenate([t.unpack_counts(x[-1]) for x in table["sums"].to_pylist()])
            one = np.zeros(len(keys), np.uint64)
            one[place] = checks
            met = int((one[place] != checks).sum())
        totals, first = [], np.full(len(keys), -1, np.int64)
        for i in range(n_sums):
            counts = np.concatenate([t.unpack_counts(x[i]) for x in table["sums"].to_pylist()])
            if i == 0:
                counted = np.flatnonzero(counts)[::-1]
                first[place[counted]] = counted
            totals.append(t.mapped(np.bincount(place, counts.astype(np.float64), len(keys)).astype(np.uint64)))
        del place
        keys, first = t.mapped(keys), t.mapped(first)
        shard, out, at = table["shard"][0].as_py(), [], 0
        for block, wanted in zip(table["block"].to_pylist(), asked, strict=True):
            mine = np.searchsorted(keys, wanted)
            own = first[mine] == np.arange(at, at + len(wanted))
            out.append((block, shard, [t.pack_counts(x[mine]) for x in totals] + [t.pack_counts(own)]))
            at += len(wanted)
        raw = totals[-1] if n_sums == N_WORDS else totals[0]
        seen = totals[0][totals[0] > 0]
        summary = np.array([len(seen), int(raw.sum()), int((raw > 0).sum()), *_histogram(seen), met], np.uint64)
        out.append((_SUMMARY, shard, [t.pack_counts(summary)]))
        if store:
            out.append((_ARRAYS, shard, [t.pack_sorted(keys), *map(t.pack_counts, totals)]))
        return t.rows_of(out, t.REPLY_ARROW)

    return merge


def _summary(replies: DataFrame) -> list[int]:
    """Over all shards: n-grams counted, the sum of raw counts, keys with one, n-grams with counts 1 to 4, and keys that two words share."""

    def read(batches):
        for b in batches:
            rows = [t.unpack_counts(x[0]).astype(np.int64) for x in b.column(0).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in np.sum(rows, 0)], [f"s{i}" for i in range(8)])

    got = replies.where(F.col("block") == _SUMMARY).select("sums").mapInArrow(read, ", ".join(f"s{i} long" for i in range(8)))
    return [x or 0 for x in got.agg(*[F.sum(f"s{i}") for i in range(8)]).first()]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """The modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more (Chen and Goodman)."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    ratio = lambda a, b: a / b if a and b else 1.0
    d = [0.0, 1 - 2 * y * ratio(n2, n1), 2 - 3 * y * ratio(n3, n2), 3 - 4 * y * ratio(n4, n3)]
    return np.array([min(max(x, 0.1 * (i > 0)), i) for i, x in enumerate(d)])


class Numbers(NamedTuple):
    """What a model is besides its arrays."""

    order: int
    seed: int
    n_shards: int
    tokens: int
    words: int
    discount: dict[int, np.ndarray]
    lowest: tuple[float, float]  # the sum of the words' counts, and the mass their discounts leave


class Model(NamedTuple):
    """``arrays(order, shard, sums)``: the shards' sorted hash arrays in the shared folder."""

    numbers: Numbers
    arrays: DataFrame


def _probabilities(b: t.Block, sums: dict[int, list[np.ndarray]], levels: dict[int, Level], m: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """(probability, raw count) of every token, the orders interpolated from the lowest up."""
    total, left = m.lowest
    counts = {n: sums[n][0][levels[n].gram].astype(np.float64) for n in levels}
    cut = lambda n: np.maximum(counts[n] - m.discount[n][np.minimum(counts[n], 3).astype(int)], 0)
    raw = sums[1][5 if m.order > 1 else 0][levels[1].gram].astype(np.float64)
    p = cut(1) / max(total, 1) + left / (m.words + 1)
    for n in range(2, m.order + 1):
        d, (_, weight, one, two, more) = m.discount[n], (x[levels[n - 1].context].astype(np.float64) for x in sums[n - 1][:5])
        seen = np.maximum(weight, 1)
        p = cut(n) / seen + np.where(weight > 0, (d[1] * one + d[2] * two + d[3] * more) / seen, 1.0) * p
    return p, raw


_RESULT = f"{t.ROW} long, doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"
_RESULT_ARROW = pa.schema([(t.ROW, pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _n_sums(n: int, order: int) -> int:
    return N_TOP if n == order else N_WORDS if n == 1 else N_LOWER


def _scores(table: pa.Table, replies: pa.Table, m: Numbers, owned: bool) -> pa.Table:
    if not table.num_rows:
        return _RESULT_ARROW.empty_table()
    b, kind = t.read_block(table, 0, FIRST), replies["n"].to_numpy()
    levels = _levels(b, tuple(range(1, m.order + 1)), m.order, m.seed)
    sums = {n: t.read_replies(replies.filter(pa.array(kind == n)), x.keys, m.n_shards, _n_sums(n, m.order) + owned) for n, x in levels.items()}
    p, raw = _probabilities(b, sums, levels, m)
    row = np.repeat(np.arange(len(b.lengths)), b.lengths)
    total = lambda x: np.bincount(row, x, len(b.lengths))
    columns = [
        b.rows, pa.array(b.ids, mask=b.ids == t.NO_ID), b.flags, b.lengths, total((raw > 0).astype(float)).astype(np.int64),
        total(np.log10((raw + 1) / (m.tokens + m.words + 1))), total(np.log10(p)),
    ]
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, _RESULT_ARROW.types, strict=True)], schema=_RESULT_ARROW)


def _blocks(docs: DataFrame, train: Column | None, block_bytes: int) -> DataFrame:
    return t.cut(t.pack_blocks(docs, _split, FIRST, train, block_bytes=block_bytes), "token-blocks", bucket="block")


def _asked(blocks: DataFrame, above: DataFrame | None, n: int, order: int, seed: int, n_shards: int) -> DataFrame:
    """The blocks' requests of one order, from the answers to the order above."""
    if above is None:
        return blocks.mapInArrow(t.as_batches(lambda a: _requests(a, None, n, order, seed, n_shards)), t.REQUEST)
    answers = above.where("block >= 0").groupBy("block")
    return blocks.groupBy("block").cogroup(answers).applyInArrow(lambda a, r: _requests(a, r, n, order, seed, n_shards), t.REQUEST)


def _count(blocks: DataFrame, order: int, store: bool, seed: int = 0) -> tuple[Numbers, dict[int, DataFrame]]:
    """The model's numbers, and per order the shards' answers to the blocks."""
    n_shards = max(1, (blocks.agg(F.sum("n_tokens")).first()[0] or 0) // TOKENS_A_SHARD)
    replies: dict[int, DataFrame] = {}
    discount, kinds_above = {}, 0
    for n in range(order, 0, -1):
        asked = _asked(blocks, replies.get(n + 1), n, order, seed, n_shards)
        replies[n] = t.cut(t.by_shard(asked, n_shards).applyInArrow(_merge(n == 1, store), t.REPLY), f"grams-{n}")
        kinds, raw, words, *histogram, met = _summary(replies[n])
        if met:  # two words share a hash: hash anew, so that the counts of words are exact
            t.discard(*replies.values())
            return _count(blocks, order, store, seed + 1)
        discount[n] = discounts(*histogram)
        if n > 1:
            kinds_above = kinds  # the sum of the counts of the order below
    total, d = raw if order == 1 else kinds_above, discount[1]
    mass = float(d[1] * histogram[0] + d[2] * histogram[1] + d[3] * (kinds - histogram[0] - histogram[1]))
    lowest = (float(total), mass / total) if total else (0.0, 1.0)
    return Numbers(order, seed, n_shards, raw, words, discount, lowest), replies


def train_model(docs: DataFrame, train: Column, order: int = 3, block_bytes: int = 6 << 20) -> Model:
    """Count the rows where ``train`` is true; the arrays are written to the shared folder.

    A model of an empty table, or without training rows, gives every token the probability 1.
    """
    blocks = _blocks(docs, train, block_bytes)
    numbers, replies = _count(blocks, order, store=True)
    kept = [df.where(F.col("block") == _ARRAYS).select(F.lit(n).alias("n"), "shard", "sums") for n, df in replies.items()]
    arrays = kept[0]
    for x in kept[1:]:
        arrays = arrays.unionByName(x)
    arrays = t.cut(arrays, "ngram-model")
    t.discard(blocks, *replies.values())
    return Model(numbers, arrays)


def _look_up(asked: pa.Table, stored: pa.Table) -> pa.Table:
    """A shard's sorted arrays, memory-mapped, answer what blocks ask; unknown n-grams have zeros."""
    if not asked.num_rows:
        return t.REPLY_ARROW.append(pa.field("n", pa.int32())).empty_table()
    sums, out = stored["sums"][0].as_py() if stored.num_rows else [b"", b""], []
    keys, values = t.mapped(t.unpack_sorted(sums[0])), [t.mapped(t.unpack_counts(x)) if x else np.zeros(0, np.uint64) for x in sums[1:]]
    for block, shard, n, wanted, like in zip(*(asked[c].to_pylist() for c in ("block", "shard", "n", "keys", "sums")), strict=True):
        wanted = t.unpack_sorted(wanted)
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        known = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
        got = [np.where(known, v[at] if len(v) else 0, 0) for v in values] if len(keys) else [np.zeros(len(wanted))] * len(like)
        out.append((block, shard, [t.pack_counts(x) for x in got], n))
    return t.rows_of(out, t.REPLY_ARROW.append(pa.field("n", pa.int32())))


def score_texts(docs: DataFrame, model: Model, block_bytes: int = 6 << 20) -> DataFrame:
    """The columns of :func:`score_by_model` for any texts, by look-ups in a stored model."""
    m = model.numbers
    blocks = _blocks(docs, None, block_bytes)

    def ask(table: pa.RecordBatch) -> pa.Table:
        b, parts = t.read_block(table, 0, FIRST), []
        for n, level in _levels(b, tuple(range(1, m.order + 1)), m.order, m.seed).items():
            part = t.request_rows(b.number, level.keys, [np.zeros(len(level.keys))] * _n_sums(n, m.order), m.n_shards)
            parts.append(part.append_column("n", pa.array([n] * part.num_rows, pa.int32())))
        return pa.concat_tables(parts)

    asked = blocks.mapInArrow(t.as_batches(ask), f"{t.REQUEST}, n int")
    stored = model.arrays
    answers = t.cut(asked.groupBy("n", "shard").cogroup(stored.groupBy("n", "shard")).applyInArrow(_look_up, f"{t.REPLY}, n int"), "answers")
    scored = t.cut(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _scores(a, b, m, False), _RESULT), "scores")
    t.discard(blocks, answers)
    return _finished(scored, m)


def _finished(scored: DataFrame, m: Numbers) -> DataFrame:
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.drop(t.ROW).withColumns({"train_tokens": F.lit(m.tokens).cast("long"), "perplexity": perplexity})


def score_by_model(docs: DataFrame, train: Column, order: int = 3, block_bytes: int = 6 << 20) -> DataFrame:
    """Learn from the rows where ``train`` is true and score all rows.

    Returns (doc_id, train, n_tokens, n_known, base_score, score, train_tokens, perplexity):
    base_score is the add-one unigram score sum(log10((c + 1) / (N + 1 * (V + 1)))), score the
    model's log10 probability of the text, perplexity 10 ** (-score / n_tokens).  Null texts count
    as empty (one end token); a text of any length is read whole.  Without training rows every
    token has the probability 1.  Repeated rows are scored, and counted, each; an empty table gives
    an empty table.  Counts of words are exact: their hashes are checked by a second one, and all are
    hashed anew where two words share one.  Longer n-grams are told apart by 64-bit hashes.  The driver gets a few
    numbers an order.
    """
    blocks = _blocks(docs, train, block_bytes)
    numbers, replies = _count(blocks, order, store=False)
    every = [df.where("block >= 0").withColumn("n", F.lit(n)) for n, df in replies.items()]
    both = every[0]
    for x in every[1:]:
        both = both.unionByName(x)
    scored = blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(lambda a, b: _scores(a, b, numbers, True), _RESULT)
    out = t.cut(scored, "scores")
    t.discard(blocks, *replies.values())
    return _finished(out, numbers)
