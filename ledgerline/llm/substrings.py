"""Substring deduplication: a count-min sketch first, exact groups of the windows it leaves.

A window is 20 consecutive words.  First pass: every block of documents fills its own sketch of
``ROWS`` hash rows and, over all rows, ``WIDTH`` columns for each window of the corpus, counters
stopping at two; it names the cells that it touched.  Sketches are added cell by cell in dense
arrays, one range of columns a task, and each block learns which of its cells came to two.  A
window's estimate, the least of its cells, is never below its count, so no repeated window is
lost.  Second pass: only windows estimated at two are grouped by a digest of their words, which
tells every block the earliest place of each.  Third pass: words covered by a window that starts
earlier elsewhere go.

The sketch is never held whole: ranges are bounded, blocks are bounded in bytes, and a block names
a window once, so a passage found in every document makes no range or block large.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import _tools as t

#: Hash rows of the sketch, and columns a row per window of the corpus (rounded up to a power of two).
ROWS, WIDTH = 2, 8
#: Cells of the sketch that one task adds up, and windows of the corpus for each task of the second pass.
CELLS_A_TASK, WINDOWS_A_TASK = 1 << 25, 1 << 21
_ODD = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_EXACT = "shard long, block long, high binary, low binary, least long, doc binary, start binary"
_EXACT_ARROW = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("least", pa.int64()), ("doc", pa.binary()), ("start", pa.binary())])


class Plan(NamedTuple):
    """Numbers that follow from the corpus size and are shipped to every task."""

    size: int
    bits: int  # of the columns of a row
    n_ranges: int
    n_shards: int

    @property
    def cell_bits(self) -> int:
        return self.bits + (ROWS - 1).bit_length()


class Windows(NamedTuple):
    doc: np.ndarray  # of each window: its document's place in the block, and its start
    start: np.ndarray
    high: np.ndarray  # two halves of a digest of its words: 64 and 32 bits
    low: np.ndarray
    cells: np.ndarray  # distinct cells touched, sorted, over the rows of the sketch one after the other
    place: np.ndarray  # of each row and window: its cell's place in cells


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _rolling(values: np.ndarray, at: np.ndarray, size: int, odd: int) -> np.ndarray:
    """Sums of a window's word hashes times odd powers, moved to the window's start, modulo 2**64, scrambled."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(odd, len(values)), dtype=np.uint64)])
    back = _powers(pow(odd, -1, 1 << 64), len(values) + 1)
    return t.mix64((total[at + size] - total[at]) * back[at])


def windows_of(b: t.Block, plan: Plan) -> Windows:
    """All windows of a block's documents, with their digests and the cells of the sketch they fall into."""
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, b.words)), ">u8").reshape(-1, 2).astype(np.uint64)
    n = np.maximum(b.lengths - plan.size + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    at = (np.cumsum(b.lengths) - b.lengths)[doc] + start
    one, high = (_rolling(digests[b.tokens, i], at, plan.size, _ODD[i]) for i in (0, 1))
    columns = [(one if r == 0 else t.mix64(one * np.uint64(2 * r + 1) + np.uint64(r))) >> np.uint64(64 - plan.bits) for r in range(ROWS)]
    cells, place = np.unique(np.concatenate([c + np.uint64(r << plan.bits) for r, c in enumerate(columns)]), return_inverse=True)
    return Windows(doc, start, high, one & np.uint64(0xFFFFFFFF), cells, place.reshape(ROWS, -1))


def _bits(values: np.ndarray) -> bytes:
    return np.packbits(values > 0).tobytes()


def sketch(b: t.Block, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """A block's own sketch: the cells it touched, sorted, and whether it did so twice or more."""
    w = windows_of(b, plan)
    return w.cells, np.bincount(w.place.ravel(), minlength=len(w.cells)) > 1


def _sketch_rows(table: pa.Table, plan: Plan) -> pa.Table:
    b = t.read_block(table)
    cells, twice = sketch(b, plan)
    return t.request_rows(b.number, cells, [twice], plan.n_ranges, plan.cell_bits, _bits)


def _add_sketches(table: pa.Table, plan: Plan) -> pa.Table:
    """One range of columns: the blocks' sketches added, and which of its cells each block finds at two."""
    shard = table["shard"][0].as_py()
    low, high = ((i << plan.cell_bits) // plan.n_ranges for i in (shard, shard + 1))
    counters = np.zeros(high - low, np.uint8)
    named = [(t.unpack_sorted(k) - np.uint64(low)).astype(np.int64) for k in table["keys"].to_pylist()]
    for cells, twice in zip(named, table["sums"].to_pylist(), strict=True):
        more = np.unpackbits(np.frombuffer(twice[0], np.uint8), count=len(cells)) + np.uint8(1)
        counters[cells] = np.minimum(counters[cells] + more, 2)
    return t.rows_of([(b, shard, [_bits(counters[c] == 2)]) for b, c in zip(table["block"].to_pylist(), named, strict=True)], t.REPLY_ARROW)


class Candidates(NamedTuple):
    """A block's windows with an estimate of two, and its earliest place of each distinct one."""

    window: np.ndarray
    group: np.ndarray  # of each: the position of its digest among the sorted distinct ones
    high: np.ndarray
    low: np.ndarray
    doc: np.ndarray  # of each distinct one: the doc_id and start of its earliest place
    start: np.ndarray


def _candidates(b: t.Block, w: Windows, replies: pa.Table, plan: Plan) -> Candidates:
    at, full = t.shard_bounds(w.cells, plan.n_ranges, plan.cell_bits), np.zeros(len(w.cells), np.uint8)
    for s, sums in zip(replies["shard"].to_pylist(), replies["sums"].to_pylist(), strict=True):
        full[at[s] : at[s + 1]] = np.unpackbits(np.frombuffer(sums[0], np.uint8), count=at[s + 1] - at[s])
    window = np.flatnonzero(full[w.place].all(0))
    high, low, doc, start = w.high[window], w.low[window], b.ids[w.doc[window]], w.start[window]
    order = np.lexsort((start, doc, low, high))
    h, x = high[order], low[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    lead = order[new]
    return Candidates(window, group, h[new], x[new], doc[lead], start[lead])


def _exact_requests(table: pa.Table, replies: pa.Table, plan: Plan) -> pa.Table:
    rows = []
    if table.num_rows:
        b = t.read_block(table)
        c = _candidates(b, windows_of(b, plan), replies, plan)
        at = t.shard_bounds(c.high, plan.n_shards, 64)
        for s, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if j > i:
                least = int(c.doc[i:j].min())
                gap = (c.doc[i:j].astype(np.uint64) - np.uint64(least & (1 << 64) - 1)).astype(np.uint64)
                rows.append((s, b.number, t.pack_sorted(c.high[i:j]), t.pack_counts(c.low[i:j]), least, t.pack_counts(gap), t.pack_counts(c.start[i:j])))
    return t.rows_of(rows, _EXACT_ARROW)


def _earliest(table: pa.Table) -> pa.Table:
    """For the digests that each block named: whether an earlier place is known elsewhere."""
    high = [t.unpack_sorted(x) for x in table["high"].to_pylist()]
    n = [len(x) for x in high]
    high = np.concatenate(high)
    low, start = (np.concatenate([t.unpack_counts(x) for x in table[c].to_pylist()]) for c in ("low", "start"))
    doc = np.concatenate([(t.unpack_counts(x) + np.uint64(k & (1 << 64) - 1)).view(np.int64) for x, k in zip(table["doc"].to_pylist(), table["least"].to_pylist(), strict=True)])
    order = np.lexsort((start, doc, low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    lead = order[new][np.cumsum(new) - 1]
    later = np.empty(len(order), bool)
    later[order] = (doc[order] != doc[lead]) | (start[order] != start[lead])
    parts = np.split(later, np.cumsum(n)[:-1])
    return t.rows_of([(b, s, [_bits(p)]) for b, s, p in zip(table["block"].to_pylist(), table["shard"].to_pylist(), parts, strict=True)], t.REPLY_ARROW)


_RESULT = f"{t.ROW} long, doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
_RESULT_ARROW = pa.schema([(t.ROW, pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])


def _remove(table: pa.Table, replies: pa.Table, plan: Plan, texts: bool) -> pa.Table:
    rows = []
    if table.num_rows:
        b = t.read_block(table)
        w = windows_of(b, plan)
        exact = pa.array(replies["exact"].to_numpy(zero_copy_only=False))
        c = _candidates(b, w, replies.filter(pa.compute.invert(exact)), plan)
        replies = replies.filter(exact)
        at, elsewhere = t.shard_bounds(c.high, plan.n_shards, 64), np.zeros(len(c.high), bool)
        for s, sums in zip(replies["shard"].to_pylist(), replies["sums"].to_pylist(), strict=True):
            elsewhere[at[s] : at[s + 1]] = np.unpackbits(np.frombuffer(sums[0], np.uint8), count=at[s + 1] - at[s]) > 0
        here = (b.ids[w.doc[c.window]] != c.doc[c.group]) | (w.start[c.window] != c.start[c.group])
        gone = c.window[here | elsewhere[c.group]]
        first = np.concatenate([[0], np.cumsum(b.lengths)])
        edge = np.zeros(first[-1] + 1, np.int64)
        np.add.at(edge, first[w.doc[gone]] + w.start[gone], 1)
        np.add.at(edge, first[w.doc[gone]] + w.start[gone] + plan.size, -1)
        kept = np.cumsum(edge)[:-1] == 0
        for i, (row, doc) in enumerate(zip(b.rows.tolist(), b.ids.tolist(), strict=True)):
            span = slice(first[i], first[i + 1])
            left = b" ".join([b.words[k] for k in b.tokens[span][kept[span]].tolist()])
            n, removed = int(b.lengths[i]), int((~kept[span]).sum())
            text = left.decode("utf-8", "replace") if texts and removed else None
            rows.append((row, None if doc == t.NO_ID else doc, n, removed, text, hashlib.sha256(left).hexdigest()))
    return t.rows_of(rows, _RESULT_ARROW)


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").split()


def _removed(docs: DataFrame, size: int, block_bytes: int, texts: bool, key: str | None = None) -> DataFrame:
    blocks = t.cut(t.pack_blocks(docs, _words, window=size, block_bytes=block_bytes, key=key), "word-blocks", bucket="block")
    n_windows = blocks.agg(F.sum("n_windows")).first()[0] or 0  # one number, from which the sketch's width follows
    bits = max(12, (WIDTH * n_windows - 1).bit_length())
    plan = Plan(size, bits, max(1, (ROWS << bits) // CELLS_A_TASK), max(1, n_windows // WINDOWS_A_TASK))
    named = blocks.mapInArrow(t.as_batches(lambda x: _sketch_rows(x, plan)), t.REQUEST)
    full = t.cut(t.by_shard(named, plan.n_ranges).applyInArrow(lambda x: _add_sketches(x, plan), t.REPLY), "full-cells")
    asked = blocks.groupBy("block").cogroup(full.groupBy("block")).applyInArrow(lambda a, b: _exact_requests(a, b, plan), _EXACT)
    later = t.cut(t.by_shard(asked, plan.n_shards).applyInArrow(_earliest, t.REPLY), "later-windows")
    replies = full.withColumn("exact", F.lit(False)).unionByName(later.withColumn("exact", F.lit(True)))
    done = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda a, b: _remove(a, b, plan, texts), _RESULT)
    out = t.cut(done, "kept-words")
    t.discard(blocks, full, later)
    return out


def remove_repeats(docs: DataFrame, size: int = 20, block_bytes: int = 6 << 20, texts: bool = True) -> DataFrame:
    """Remove each word covered by a window of ``size`` words that also starts earlier.

    Earlier: at a smaller doc_id, or in the same document before; null ids come last, and rows
    that share an id count as one document.  Returns (doc_id, n_words, n_removed, kept_text,
    kept_sha256) for every row.  kept_text is the kept words joined by a space where words go, and
    null where none does or without ``texts``; the digest is that of the kept words in any case.
    Null texts count as empty; texts under ``size`` words keep all; one text of any length is read
    whole; an empty table gives an empty table.  Windows are told apart by digests of 96 bits.
    """
    return _removed(docs, size, block_bytes, texts).drop(t.ROW)


def drop_repeated_text(docs: DataFrame, size: int = 20) -> DataFrame:
    """``docs`` with repeated words removed from its texts; rows left without a word go.

    Texts that lose nothing stay as they are, null ones too; others become their kept words joined
    by a space.  A row without words to begin with stays.  Rows are told apart whatever their
    doc_id; of rows equal in doc_id and text the windows start at the same place, so both stay.
    ``n_chars``, if there, is counted anew where words go.
    """
    t.release(docs)
    keyed = t.with_row_keys(docs)
    removed = _removed(t.keyed_texts(keyed), size, 6 << 20, True, t.ROW)
    t.hold(keyed, removed)
    done = removed.select(t.ROW, "n_words", "n_removed", F.col("kept_text").alias("_kept"))
    both = keyed.join(done, t.ROW).where("n_words = 0 or n_removed < n_words")
    at = {c: F.col(t.WHOLE)[c] for c in docs.columns}
    at["text"] = F.coalesce("_kept", at["text"])
    if "n_chars" in at:
        at["n_chars"] = F.when(F.col("n_removed") == 0, at["n_chars"]).otherwise(F.length("_kept")).cast(docs.schema["n_chars"].dataType)
    return both.select(*[at[c].alias(c) for c in docs.columns])
