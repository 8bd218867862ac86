"""SentencePiece encoding and decoding for merge-type vocabularies with byte fallback.

A text is cut before each run of spaces and where the vocabulary's letters meet other characters;
no piece crosses such a place, which is checked when the vocabulary is read, so a text's ids are
those of its parts in order.  Each part keeps an agenda of its adjacent symbol pairs ordered by the
score of the piece they would make, and the best pair (the leftmost among equals) is merged until
none is left.  Short parts advance together, one agenda step per part and round, in numpy; long ones
use a heap.  Every part that a worker learns is checked against the sentencepiece library, and every
text against what the library decodes from its ids.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = "▁"
#: No vocabulary may hold it: what follows it in a text is encoded as if alone.
_APART = "\n"
_LONG = 64
_KNOWN = 600_000
_NONE = np.iinfo(np.int32).max


class MergeVocabulary:
    """A merge-type vocabulary and its agenda encoder."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("a merge-type vocabulary with byte fallback, without normalization, is needed")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.end = self.library.eos_id()
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        chars = sorted({c for p in self.ids for c in p})
        letters = re.escape("".join(c for c in chars if c.isalpha()))
        self.parts = re.compile(f"{_SPACE}*[{letters}]+|{_SPACE}*[^{letters}{_SPACE}]+|{_SPACE}+")
        if any(len(self.parts.findall(p)) != 1 for p in self.ids) or _APART in chars:
            raise ValueError("pieces that cross words, or letters and others, or lines are not supported")
        self.apart = self.library.encode(_APART)
        score = {i: p.score for i, p in enumerate(proto.pieces)}
        # rank 0 is the best score; equal scores share a rank, so that the leftmost of them goes first
        order = {s: r for r, s in enumerate(sorted({score[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {i: order[score[i]] for i in self.ids.values()}
        self.symbols = {c: self.ids.get(c, len(proto.pieces) + k) for k, c in enumerate(chars)}
        self.none = len(proto.pieces) + len(chars)
        size = self.none + 1
        merges = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = (self.symbols[x] if len(x) == 1 else self.ids.get(x) for x in (piece[:k], piece[k:]))
                if a is not None and b is not None:
                    merges[a * size + b] = i
        self.size, self.merges = size, merges
        self.by_char = np.full(0x110000, self.none, np.int32)
        self.by_char[[ord(c) for c in self.symbols]] = list(self.symbols.values())
        self.plain = np.zeros(size, bool)  # the symbols that are pieces
        self.plain[list(self.rank)] = True
        self.names = [str(i) for i in range(len(proto.pieces))]
        self.shared = np.array(range(size), object)  # one int object per symbol, for all parts
        self.pairs = pd.Index(np.array(list(merges), np.int64))
        # one more place at the end answers for pairs that make no piece
        self.pair_ids = np.array([*merges.values(), 0], np.int32)
        self.pair_ranks = np.array([*(self.rank[i] for i in merges.values()), _NONE], np.int32)
        self._forget()

    def _forget(self) -> None:
        """No part is known: its number, and by number where its ids begin and how many there are."""
        self.known: defaultdict[str, int] = defaultdict(count().__next__)  # the next number for a new part
        self.first, self.n_ids, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _finish(self, part: str, symbols: list[int], spans: list[int]) -> tuple[int, ...]:
        """Ids of the merged symbols; single characters outside the vocabulary become bytes."""
        out: list[int] = []
        for k, s in enumerate(symbols):
            if s in self.rank:
                out.append(s)
            else:
                stop = spans[k + 1] if k + 1 < len(spans) else len(part)
                out.extend(self.bytes[b] for b in part[spans[k] : stop].encode("utf-8"))
        return tuple(out)

    def by_heap(self, part: str) -> tuple[int, ...]:
        """One part, with the agenda in a heap of (rank, place)."""
        sym = [self.symbols.get(c, self.none) for c in part]
        n = len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        agenda: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merges.get(sym[i] * self.size + sym[j])) is not None:
                heapq.heappush(agenda, (self.rank[m], i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            j = after[i]
            if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i] = self.merges[a * self.size + b]
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        spans = [i for i in range(n) if alive[i]]
        return self._finish(part, [sym[i] for i in spans], spans)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.pairs.get_indexer(a * np.int64(self.size) + b)
        return self.pair_ranks[at], self.pair_ids[at]

    def together(self, parts: list[str]) -> list[tuple[int, ...]]:
        """Many parts: every round merges the best pair of each part that has one."""
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        sym = self.by_char[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        owner, span = np.repeat(np.arange(len(parts), dtype=np.int32), n), (np.arange(len(sym)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, into = self._pairs(sym, owner)
        while len(sym):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            live = np.repeat(best < _NONE, size)
            if not live.all():
                done.append((owner[~live], sym[~live], span[~live]))
                sym, owner, span, rank, into = sym[live], owner[live], span[live], rank[live], into[live]
                if not len(sym):
                    break
                starts, best = np.flatnonzero(np.diff(owner, prepend=-1)), best[best < _NONE]
                size = np.diff(np.append(starts, len(sym)))
            at = np.flatnonzero(rank == np.repeat(best, size))
            at = at[np.diff(owner[at], prepend=-1) != 0]  # the leftmost of each part
            sym[at] = into[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            moved = at - np.arange(len(at))  # where the merged symbols stand afterwards
            sym, owner, span, rank, into = sym[stay], owner[stay], span[stay], rank[stay], into[stay]
            for here in (moved, moved[moved > 0] - 1):
                right = np.minimum(here + 1, len(sym) - 1)
                r, m = self._ranks(sym[here], sym[right])
                rank[here] = np.where((owner[here] == owner[right]) & (right > here), r, _NONE)
                into[here] = m
        owner, sym, span = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((span, owner))
        owner, sym, span = owner[order], sym[order], span[order]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        plain = np.logical_and.reduceat(self.plain[sym], starts).tolist()
        at, sym, span = np.append(starts, len(owner)).tolist(), self.shared[sym].tolist(), span.tolist()
        return [
            tuple(sym[a:b]) if whole else self._finish(p, sym[a:b], span[a:b])
            for p, whole, a, b in zip(parts, plain, at[:-1], at[1:], strict=True)
        ]

    def _pairs(self, sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, into = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
        r, m = self._ranks(sym[:-1], sym[1:])
        rank[:-1], into[:-1] = np.where(owner[:-1] == owner[1:], r, _NONE), m
        return rank, into

    def learn(self, check: bool) -> None:
        """Encode the parts that have a number but no ids yet."""
        new = sorted(islice(reversed(self.known), len(self.known) - len(self.first)), key=len)
        ids: list[tuple[int, ...]] = []
        short = [p for p in new if len(p) <= _LONG]
        for k in range(0, len(short), 20_000):
            ids.extend(self.together(short[k : k + 20_000]))
        ids.extend(map(self.by_heap, new[len(short) :]))
        if check:
            for p, mine, theirs in zip(new, ids, self.library.encode([_APART + p for p in new], num_threads=1), strict=True):
                if [*self.apart, *mine] != theirs:
                    raise ValueError(f"the library encodes {p!r} differently")
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        at = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new)) - len(self.first)
        first, n_ids = np.empty_like(n), np.empty_like(n)
        first[at], n_ids[at] = len(self.flat) + np.cumsum(n) - n, n
        self.first, self.n_ids = np.append(self.first, first), np.append(self.n_ids, n_ids)
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())))

    def encode(self, texts: list[str], check: bool = True) -> list[tuple[str, list[int]]]:
        """(ids as text, ids) of each text, with the end id."""
        if len(self.known) > _KNOWN:
            self._forget()
        cut = [self.parts.findall(_SPACE + t.replace(" ", _SPACE)) if t else [] for t in texts]
        stops = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        parts = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(stops[-1]) if len(cut) else 0)
        self.learn(check)
        n = self.n_ids[parts]
        ends = np.append(0, np.cumsum(n))
        flat = self.flat[np.repeat(self.first[parts] - ends[:-1], n) + np.arange(ends[-1])]
        out, a = [], 0
        for z in ends[stops].tolist():
            ids = [*flat[a:z].tolist(), self.end]
            out.append((" ".join(map(self.names.__getitem__, ids)), ids))
            a = z
        return out


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> MergeVocabulary:
    """One per Python worker."""
    return MergeVocabulary(model_file)


_SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded string, decoded_sha256 string"
_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.string()]
_SLICE = 2 << 20


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``_SLICE`` characters, so that ids in memory stay bounded."""
    start, total = 0, 0
    for i, x in enumerate(texts):
        total += len(x)
        if total >= _SLICE:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, model_file: str, check: bool = True, outputs: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded, decoded_sha256) for every row.

    Ids are those of the library with an end id only; decoding is the library's.  ``check``
    compares each distinct part's ids with the library's own where a worker learns it, and every
    text with what its ids decode to, and stops at a difference.  Without ``outputs`` the ids and decoded texts are null, and only their digests are returned.  Null
    texts count as empty (one id, the end); repeated rows are encoded each; an empty table gives
    an empty table.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        for b in batches:
            doc_ids, all_texts = b.column(0), [x or "" for x in b.column(1).to_pylist()]
            for a, z in _slices(all_texts):
                texts = all_texts[a:z]
                got = v.encode(texts, check)
                ids = [x for _, x in got]
                decoded = v.library.decode(ids, num_threads=1)
                if check and (meant := [x.replace(_SPACE, " ") for x in texts]) != decoded:
                    k = next(i for i, (x, y) in enumerate(zip(meant, decoded, strict=True)) if x != y)
                    raise ValueError(f"the ids of document {doc_ids[a + k]} do not spell its text")
                sha = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()
                columns = [
                    [len(x) for x in ids], ids if outputs else [None] * len(ids), [sha(x) for x, _ in got],
                    decoded if outputs else [None] * len(ids), [sha(x) for x in decoded],
                ]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(a, z - a), *[pa.array(c, k) for c, k in zip(columns, _KINDS[1:], strict=True)]],
                    ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, _SCHEMA)
