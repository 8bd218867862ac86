"""Language identification by unigram pieces, summed over all segmentations.

Pieces are those of a fixed public vocabulary.  Training counts, per language, the pieces of the
words of its documents, as the vocabulary's own tokenizer cuts them.  A word's probability in a
language is the sum over every way to cut it into pieces (the forward algorithm); pieces never
cross words, so a text's is the product over its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm._tools import crc_remainder, cut, discard

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_CACHE = 200_000
#: Steps of the forward algorithm between two changes of scale: the numbers stay within doubles.
_RESCALE = 4
_UNKNOWN = 1e-9


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters (general category L) and the marks on them, lower-cased."""
    return _WORD.findall((text or "").lower())


def piece_counts(docs: DataFrame, model_file: str, lang: str = "lang") -> DataFrame:
    """(lang, piece, n) over all rows with a language: words are counted first, each cut once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for x, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(x, Counter()).update(words_of(text))
            rows = [(x, w, n) for x, c in seen.items() for w, n in c.items()]
            kinds = [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["lang", "word", "n"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        for b in batches:
            total: Counter = Counter()
            cuts = model.encode(b.column(1).to_pylist(), num_threads=1)
            for x, ids, n in zip(b.column(0).to_pylist(), cuts, b.column(2).to_pylist(), strict=True):
                for i in ids:
                    total[x, i] += n
            rows = list(total.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())],
                ["lang", "piece", "n"],
            )

    words = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), "text").mapInArrow(count, "lang string, word string, n long")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return words.mapInArrow(segment, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Pieces:
    """log P(word) in every language, for many words at once."""

    def __init__(self, pieces: list[str], counts: np.ndarray, smoothing: float = 0.1):
        """``counts``: pieces by languages."""
        smoothed = counts + smoothing
        self.p = np.vstack([smoothed / smoothed.sum(0), np.zeros(counts.shape[1])])
        self.none = len(pieces)
        self.ids = {p: i for i, p in enumerate(pieces) if p and not re.fullmatch(r"<(unk|s|/s|0x[0-9A-F]{2})>", p)}
        self.longest = max(map(len, self.ids), default=1)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, counts.shape[1]))

    def _forward(self, words: list[str]) -> np.ndarray:
        """Words of one length; ``alpha[j]`` sums all cuts of the first j characters.

        Every few steps all sums in reach are divided by the latest, for each word and language,
        and the logarithm of the divisor is kept: words of any length keep their full evidence.
        """
        length, get = len(words[0]), self.ids.get
        alpha = np.zeros((length + 1, len(words), self.p.shape[1]))
        alpha[0], scale = 1.0, np.zeros((len(words), self.p.shape[1]))
        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):
                found = [get(w[i:j], self.none) for w in words]
                if i == j - 1:
                    step = self.p[found]
                    step[np.array(found) == self.none] = _UNKNOWN
                elif any(x != self.none for x in found):
                    step = self.p[found]
                else:
                    continue
                alpha[j] += alpha[i] * step
            if j % _RESCALE == 0:
                top = alpha[j].copy()  # positive: a single character always has a probability
                alpha[max(0, j - self.longest) : j + 1] /= top
                scale += np.log(top)
        return np.log(alpha[length]) + scale

    def score(self, words: list[str]) -> None:
        """Make sure that ``known`` holds the row of each of ``words`` in ``rows``."""
        if len(self.known) > _CACHE:
            self.known.clear()
        by_length: dict[int, list[str]] = {}
        for w in set(words):
            if w not in self.known:
                by_length.setdefault(len(w), []).append(w)
        for group in by_length.values():
            for k in range(0, len(group), 20_000):
                part = group[k : k + 20_000]
                n, scores = len(self.known), self._forward(["▁" + w for w in part])
                while n + len(part) > len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[n : n + len(part)] = scores
                self.known.update(zip(part, range(n, n + len(part)), strict=True))


def identify_language(docs: DataFrame, model_file: str, train: Column, lang: str = "lang", smoothing: float = 0.1, most_languages: int = 1000) -> DataFrame:
    """(doc_id, lang_pred, score) for every row.

    Learns from the text and the non-null language of rows where ``train`` is true; the piece
    counts that reach the driver are bounded by vocabulary times languages.  score is the
    prediction's share of the languages' likelihoods, all alike beforehand.  Null texts, texts
    without letters, and all texts where nothing was learned get ``und`` and score 0; ties go to
    the first language in order; an empty table gives an empty table.  The table that every worker
    gets has a row per piece and a column per language; more than ``most_languages`` are refused.
    """
    from sentencepiece import SentencePieceProcessor

    table = cut(piece_counts(docs.where(train), model_file, lang), "piece-counts")
    names = [r[0] for r in table.select("lang").distinct().sort("lang").limit(most_languages + 1).collect()]
    if len(names) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    counted = table.toPandas()
    discard(table)
    model = SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    counts = np.zeros((len(pieces), max(1, len(names))))
    counts[counted["piece"], [names.index(x) for x in counted["lang"]]] = counted["n"]
    shared = docs.sparkSession.sparkContext.broadcast((pieces, counts.astype(np.float32), names))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_, counts_, names_ = shared.value
        table = Pieces(pieces_, counts_.astype(np.float64), smoothing)
        for b in batches:
            preds, scores = [], []
            texts = [words_of(x) for x in b.column(1).to_pylist()]
            table.score([w for ws in texts for w in ws])
            for ws in texts:
                if not ws or not names_:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                total = table.rows[np.fromiter(map(table.known.__getitem__, ws), np.int64, len(ws))].sum(0)
                best = int(np.argmax(total))
                preds.append(names_[best])
                scores.append(1.0 / math.fsum(np.exp(np.maximum(total - total[best], -700))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return crc_remainder(doc_id, 4) == 2
