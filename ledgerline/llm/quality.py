"""Quality rules as a learned decision list over text statistics.

Sequential covering (after RIPPER): a rule is a conjunction of thresholds, grown by information
gain on two thirds of a bounded labelled sample and pruned on the rest; rules are learned one
after another from the rows that earlier rules leave.  The list becomes one ordered Spark
``when`` expression, so applying it costs a projection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm._tools import cut

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_short", "n_marks", "n_digits")
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS)


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """How many words lie in windows of ``size`` words found twice or more in the list."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    window = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    base, codes, span = len(ids) + 1, window, 1
    while span < size:  # exact codes of longer and longer windows; renumbered before they overflow
        codes = codes[: len(words) - span] * base + window[span:]
        span += 1
        if span < size and int(codes.max()) >= (1 << 62) // base:
            codes = np.unique(codes, return_inverse=True)[1]
    order = np.sort(codes)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(codes, twice)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The statistics named in ``_COUNTS``; all zero for null and blank texts without symbols."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    spaced = re.sub(r"[\x20\x09-\x0D]", "", text) if words else ""
    lines = [x for x in text.split("\n") if x.encode("utf-8", "replace").split()]
    return (
        len(words),
        len(spaced),
        len(_SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        sum(map((4).__gt__, map(len, words))),
        sum(w[-1] in b".,;:!?" for w in words),
        sum(map(text.count, "0123456789")),
    )


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, counts ...) for every row; other columns are not read, null texts count as empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_counts(t) for t in b.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_COUNTS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *_COUNTS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, _SCHEMA)


def features() -> dict[str, Column]:
    """Named ratios over the counts; empty texts give zeros."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeated": F.col("n_repeat_words") / words,
        "words_per_line": F.col("n_words") / lines,
        "distinct": F.col("n_distinct") / words,
        "short": F.col("n_short") / words,
        "marks": F.col("n_marks") / words,
        "digits": F.col("n_digits") / chars,
    }


class Condition(NamedTuple):
    feature: str
    below: bool  # value <= threshold, else value > threshold
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] <= self.threshold if self.below else x[self.feature] > self.threshold

    def column(self) -> Column:
        value = features()[self.feature]
        return value <= self.threshold if self.below else value > self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, n_cuts: int, most: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(y), bool)
    while len(rule) < most and inside.any() and not y[inside].all():
        p0, n0 = y[inside].sum(), inside.sum()
        best = (0.0, None)
        for name in sorted(x):
            v, hit = x[name][inside], y[inside]
            for cut_at in np.unique(np.quantile(v, np.linspace(0, 1, n_cuts), method="lower")):
                low = v <= cut_at
                for below, sel in ((True, low), (False, ~low)):
                    p, n = hit[sel].sum(), sel.sum()
                    if p:
                        gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(name, below, float(cut_at)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def learn_rules(
    x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, precision: float = 0.75, least: int = 5, most_rules: int = 12
) -> list[Rule]:
    """An ordered list of rules for ``bad`` rows; ``prune`` marks the rows held back for pruning.

    The list is bounded by its fit: at most ``most_rules`` rules, of at most four conditions each,
    whose thresholds are among 64 cut points of a ratio's values in the sample.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and (bad & left & ~prune).sum() >= least:
        g, p = left & ~prune, left & prune
        grown = _grow({k: v[g] for k, v in x.items()}, bad[g], 64, 4)
        if not grown:
            break
        held = {k: v[p] for k, v in x.items()}

        def worth(rule: Rule) -> float:
            inside = _covered(rule, held, int(p.sum()))
            hits = int(bad[p][inside].sum())
            return (2 * hits - inside.sum()) / max(1, inside.sum())

        rule = max((grown[: i + 1] for i in reversed(range(len(grown)))), key=worth)
        inside = _covered(rule, x, len(bad)) & left
        if inside.sum() < least or bad[inside].mean() < precision:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def labelled_sample(statistics: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(_h, doc_id, quality, ratios ...) of at most ``max_rows`` labelled rows.

    Where there are more labels, those under a threshold of their hash are drawn, so that 0.95 of
    ``max_rows`` are expected, before the join: no task sends more than its share of the sample.
    The limit behind it only matters where one doc_id carries very many of the labels.
    """
    named = labels.where("quality is not null").select(
        F.xxhash64(F.lit("quality"), "doc_id").alias("_h"), F.col("doc_id").alias("_id"), "quality"
    )
    n = named.count()
    if n > max_rows:
        named = named.where(F.col("_h") < F.lit(int(0.95 * max_rows / n * 2**64) - 2**63))
    ratios = features()
    return (
        named.join(statistics, F.col("_id") == F.col("doc_id"))
        .select("_h", "doc_id", "quality", *[c.alias(k) for k, c in ratios.items()])
        .orderBy("_h", "doc_id", "quality", *ratios)
        .limit(max_rows)
    )


def fit_rules(statistics: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> list[Rule]:
    """Learn from at most ``max_rows`` labelled rows (label 0 or 1 in ``quality``), drawn by hash.

    The sample is the bound on what the driver holds: ``max_rows`` rows of ten ratios; the list has
    at most twelve rules of four conditions (see :func:`learn_rules`).  Null
    labels and labels without a document take no part; without any, the list is empty.
    """
    sample = labelled_sample(statistics, labels, max_rows).toPandas()
    if sample.empty:
        return []
    x = {k: sample[k].to_numpy(float) for k in features()}
    return learn_rules(x, (sample["quality"] == 0).to_numpy(), (sample["_h"].to_numpy() % 3 == 0))


def verdict(rules: list[Rule]) -> Column:
    """True (keep) unless a rule holds: the first rule that does decides."""
    out = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        held = F.lit(True)
        for c in rule:
            held = held & c.column()
        out = out.when(held, F.lit(False))
    return out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every document.

    base_failed: under 10 words, or more than a fifth of the words in repeated 5-word windows.
    kept: false where base_failed, else the learned list's verdict.  Null and empty texts fail
    the base; texts of any length are read whole; repeated rows are judged alike; labels repeated
    for a document count once each, null labels and labels of no document not at all; an empty
    table gives an empty table.
    """
    stats = cut(text_statistics(docs), "text-statistics")
    rules = fit_rules(stats, labels, max_rows)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
