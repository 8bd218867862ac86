"""Toxicity by a lexicon trie walked with Levenshtein automata, and scores of context windows.

The lexicon has public terms of abuse, which match whole words, and roots, which match how a word
begins: roots are learned from labelled training documents, as the shortest beginnings that mark
toxic texts.  The automaton of "within k edits of some term" is the product of the trie and the
Levenshtein automata of its terms; it is made deterministic as words walk it, and most words leave
it after two or three letters.  Each spelling that it accepts is weighted by how often labelled
training documents that hold it are toxic, drawn towards its class (kind of term, edits, quoted, company);
a hit inside quotation marks or next to a word of reporting has classes and weights of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm._tools import BROADCAST_ROWS, ROW, crc_remainder, cut, discard, hold, keyed_texts, release, with_row_keys, without_rows

# Common terms of abuse, and words and marks that introduce a quotation.
LEXICON = (
    "arsehole asshole bastard bitch clown coward creep crap cretin degenerate disgusting dumb dumbass "
    "fool freak garbage hateful hypocrite idiot idiotic ignorant imbecile jerk liar loathsome loser lowlife "
    "moron moronic parasite pathetic pig repulsive retard rubbish scum scumbag shameful shit slut stupid "
    "swine thug trash ugly useless vermin vile weasel whore wimp worthless wretch"
).split()
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes term word insult slur reported".split())
QUOTES = "\"“”„«»‘’"

_WORD = re.compile(r"[^\W_]+")
_CACHE = 300_000
#: Letters of the shortest and the longest root.
ROOTS = (3, 12)
#: Copies of the weights, over which the hits of a common spelling are dealt.
_SALTS = 16


def edits_allowed(term: str) -> int:
    """None for terms under 4 letters, one up to 7, two for longer ones."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


def root_edits(root: str) -> int:
    """None for roots under 5 letters, else one: what follows a root is free, so edits weigh more."""
    return 0 if len(root) < 5 else 1


class LexiconAutomaton:
    """Finds the nearest term or root within its allowed edits; states are made on demand."""

    def __init__(self, lexicon: list[str], roots: list[str] = ()):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, bool, int]]] = [[]]  # per node: (term, is root, edits allowed)
        for term, is_root in sorted({(x, False) for x in lexicon} | {(x, True) for x in roots}):
            node = 0
            for ch in term:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][ch]
            self.ends[node].append((term, is_root, root_edits(term) if is_root else edits_allowed(term)))
        self.reach = [0] * len(self.children)  # most edits allowed to a term at or below the node
        for node in reversed(range(len(self.children))):
            self.reach[node] = max([0, *(k for _, _, k in self.ends[node]), *(self.reach[c] for c in self.children[node].values())])
        self.alphabet = {ch for kids in self.children for ch in kids}
        self.states: dict[tuple, int] = {((), None): 0}
        self.sets: list[tuple] = [((), None)]
        self.accepts: list[tuple[int, str, bool] | None] = [None]
        self.moves: list[dict[str, int]] = [{}]
        self.start = self._state({0: 0}, None)
        self.known: dict[str, tuple[str, int, bool] | None] = {}

    def _state(self, edits: dict[int, int], held: tuple | None) -> int:
        """The state of trie nodes with their least edits, and of the best root matched so far."""
        todo = list(edits)
        while todo:  # letters of the lexicon left out
            node = todo.pop()
            for child in self.children[node].values():
                d = edits[node] + 1
                if d <= self.reach[child] and d < edits.get(child, 99):
                    edits[child] = d
                    todo.append(child)
        found = [(d, term, is_root) for node, d in edits.items() for term, is_root, most in self.ends[node] if d <= most]
        held = min([x for x in found if x[2]] + ([held] if held else []), default=None)
        key = (tuple(sorted(edits.items())), held)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.accepts.append(min(found + ([held] if held else []), default=None))
        return self.states[key]

    def _step(self, state: int, ch: str) -> int:
        out: dict[int, int] = {}
        nodes, held = self.sets[state]
        for node, d in nodes:
            if d + 1 <= self.reach[node]:
                out[node] = min(out.get(node, 99), d + 1)
            for c, child in self.children[node].items():
                cost = d + (c != ch)
                if cost <= self.reach[child]:
                    out[child] = min(out.get(child, 99), cost)
        return self._state(out, held)

    def find(self, word: str) -> tuple[str, int, bool] | None:
        """(term, edits, is root) of the nearest, the first in order among equals, or None."""
        if word in self.known:
            return self.known[word]
        state = self.start
        for ch in word:
            ch = ch if ch in self.alphabet else "\0"
            move = self.moves[state]
            if ch not in move:
                move[ch] = self._step(state, ch)
            state = move[ch]
            if not state:
                break
        if len(self.known) >= _CACHE:
            self.known.clear()
        best = self.accepts[state]
        self.known[word] = best and (best[1], best[0], best[2])
        return self.known[word]


def _quoted(text: str, start: int, end: int, words: list[re.Match], i: int, window: int) -> bool:
    near = words[max(0, i - window) : i + window + 1]
    if any(m[0].lower() in REPORTING for m in near):
        return True
    left, right = text[near[0].start() : start], text[end : near[-1].end() + 1]
    return any(q in left for q in QUOTES) and any(q in right for q in QUOTES)


def hits_in(text: str | None, automaton: LexiconAutomaton, window: int = 5) -> list[tuple[str, str, int, bool, bool]]:
    """(spelling, term, edits, is root, quoted) of each distinct matched spelling and context."""
    lower = (text or "").lower()
    found = {w: hit for w in set(_WORD.findall(lower)) if (hit := automaton.find(w))}
    if not found:
        return []
    words = list(_WORD.finditer(lower))
    return sorted({(m[0], *found[m[0]], _quoted(lower, m.start(), m.end(), words, i, window)) for i, m in enumerate(words) if m[0] in found})


_HITS = "row_id long, doc_id long, hits array<struct<spelling: string, term: string, edits: int, root: boolean, quoted: boolean>>"
_HIT = pa.list_(pa.struct([("spelling", pa.string()), ("term", pa.string()), ("edits", pa.int32()), ("root", pa.bool_()), ("quoted", pa.bool_())]))


def toxic_hits(docs: DataFrame, lexicon: list[str], roots: list[str] = (), window: int = 5, key: str | None = None) -> DataFrame:
    """(row_id, doc_id, hits) for every row; row_id tells repeated rows apart and is the column ``key``, if named."""
    names = [f.name for f in _HIT.value_type]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(lexicon, roots)
        for b in batches:
            found = [[dict(zip(names, hit, strict=True)) for hit in hits_in(x, automaton, window)] for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, _HIT)], ["row_id", "doc_id", "hits"])

    row_id = F.col(key) if key else F.monotonically_increasing_id()
    return docs.select(row_id.alias("row_id"), F.col("doc_id").cast("long"), "text").mapInArrow(scan, _HITS)


# -- learning roots -----------------------------------------------------------------------


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every text the least hash of its runs of three words, which most of its near copies share."""
    for b in batches:
        shapes = []
        for text in b.column(0).to_pylist():
            words = _WORD.findall((text or "").lower())
            runs = map(" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else [" ".join(words)]
            shapes.append(min(map(xxhash.xxh3_64_intdigest, runs)) >> 1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shapes, pa.int64())], ["text", "toxic", "shape"])


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each word stands, and in how many toxic ones, summed over what a task reads."""
    counts: dict[str, list[float]] = {}

    def flush():
        t, n = zip(*counts.values(), strict=True) if counts else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(t, pa.float64()), pa.array(n, pa.float64())], ["word", "t", "n"])

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for word in set(_WORD.findall((text or "").lower())):
                if len(word) >= ROOTS[0]:
                    seen = counts.setdefault(word, [0.0, 0.0])
                    seen[0] += toxic
                    seen[1] += 1.0
            if len(counts) > _CACHE:
                yield flush()
                counts.clear()
    yield flush()


def _gain(t, n, share: float):
    """How much likelier the counts are at their own share than at the overall one."""
    clean = n - t
    toxic = F.when(t > 0, t * (F.log(t / n) - math.log(share))).otherwise(0.0)
    return toxic + F.when(clean > 0, clean * (F.log(clean / n) - math.log(1 - share))).otherwise(0.0)


def learn_roots(docs: DataFrame, marked: DataFrame, share: float = 0.7, evidence: float = 12.0, words: int = 3) -> list[str]:
    """Beginnings of words that mark toxic texts, the shortest of each family, in order.

    ``marked`` has (label_id, toxic); all its rows are used.  A word counts once per text, and of
    texts with one shape and label, near copies as a rule, only one counts.  A beginning is taken where
    ``words`` words or more have it, at least ``share`` of their counts are toxic, and their
    likelihood against the overall share is above exp(``evidence``).  Every root so needs its own
    evidence; there is no other limit on how many are found.
    """
    n, t = marked.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not t or t == n:
        return []
    few = F.broadcast(marked) if n <= BROADCAST_ROWS else marked
    sample = docs.select(F.col("doc_id").alias("label_id"), "text").join(few, "label_id").select("text", "toxic").mapInArrow(_shapes, "text string, toxic double, shape long")
    once = sample.groupBy("shape", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    each = once.mapInArrow(_counted_words, "word string, t double, n double").groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    ends = F.explode(F.sequence(F.lit(ROOTS[0]), F.least(F.length("word"), F.lit(ROOTS[1])))).alias("k")
    begun = each.select("word", "t", "n", ends).groupBy(F.substring("word", 1, F.col("k")).alias("root"))
    sums = begun.agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.count("*").alias("words"))
    telling = sums.where((F.col("words") >= words) & (F.col("t") >= share * F.col("n")) & (_gain(F.col("t"), F.col("n"), t / n) >= evidence)).select("root")
    telling = cut(telling, "toxic-roots")
    shorter = telling.select(F.col("root").alias("longer"), F.explode(F.sequence(F.lit(ROOTS[0]), F.greatest(F.length("root") - 1, F.lit(ROOTS[0])))).alias("k"))
    covered = shorter.where("k < length(longer)").select("longer", F.substring("longer", 1, F.col("k")).alias("root")).join(telling, "root").select(F.col("longer").alias("root"))
    roots = sorted(r[0] for r in telling.join(covered, "root", "left_anti").collect())
    discard(telling)
    return roots


# -- scores -------------------------------------------------------------------------------


def score_toxicity(docs: DataFrame, labels: DataFrame, lexicon: list[str] | None = None, window: int = 5, threshold: float = 0.7, roots: list[str] | None = None, key: str | None = None) -> DataFrame:
    """row_id, doc_id, held_out, score and predicted for every document.

    Roots (unless given) and weights are learned from labelled documents whose crc32(doc_id) mod 3
    is not 1.  A spelling's weight is the share of toxic ones among the training documents that
    hold it, drawn towards the share of its class (root or term, short or not, edits, quoted, and
    how many exact ones stand in the document, up to three) and less the share among documents without a hit; a document's score is that base raised by each
    of its hits.  Null and empty texts get the base score; a text of any length is read whole; of
    terms equally near the first in order is taken.  Labels repeated for a document count once
    each; null labels take no part; without labels there are no roots, exact hits weigh 0.9, near
    ones 0.5 and quoted ones a third of that.  An empty table gives an empty table.
    """
    marked = labels.where("toxic is not null").select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("double").alias("toxic"))
    marked = marked.where(crc_remainder(F.col("label_id"), 3) != 1)
    roots = learn_roots(docs, marked) if roots is None else roots
    hit = cut(toxic_hits(docs, list(LEXICON if lexicon is None else lexicon), roots, window, key), "toxic-hits")
    found = hit.withColumn("held_out", crc_remainder(F.col("doc_id"), 3) == 1)
    train = found.join(marked, F.col("doc_id") == F.col("label_id")).select("row_id", "hits", "toxic")
    base = train.where(F.size("hits") == 0).agg(F.sum("toxic"), F.count("*")).first()
    base_rate = ((base[0] or 0.0) + 1.0) / (base[1] + 20.0)  # two numbers from the driver
    kind = {"near": F.least("edits", F.lit(2)), "is_root": F.col("root"), "short": F.length("term") < 5, "quoted": F.col("quoted"), "company": F.col("company")}
    # how many spellings of its sort the document has that are exact, the first three counted
    company = F.least(F.size(F.filter("hits", lambda x: (x["edits"] == 0) & (x["root"] == F.col("h.root")))), F.lit(3)).alias("company")
    each = lambda df: df.select("*", F.explode("hits").alias("h")).select("*", "h.*", company).select(*[c for c in df.columns if c != "hits"], "spelling", *[c.alias(k) for k, c in kind.items()])
    prior = F.when(F.col("near") == 0, 0.9).otherwise(0.5) * F.when(F.col("quoted"), 1 / 3).otherwise(1.0)
    spelled = each(train).groupBy("spelling", *kind).agg(F.sum("toxic").alias("t"), F.count("*").cast("double").alias("n"))
    classes = spelled.groupBy(*kind).agg(F.sum("t").alias("ct"), F.sum("n").alias("cn"))
    # the weights are dealt over salts, so that the hits of one common spelling are not one task's
    salt = F.pmod(F.xxhash64("row_id"), F.lit(_SALTS))
    hits = each(found.select("row_id", "hits")).withColumn("salt", salt)
    weights = spelled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)).cast("array<long>")))
    # classes has at most 96 rows (three edits, three yes-or-no marks, company of 0 to 3)
    weighed = hits.join(F.broadcast(classes), [*kind], "left").join(weights, ["spelling", *kind, "salt"], "left")
    zero = F.lit(0.0)
    of_class = (F.coalesce("ct", zero) + 10 * prior) / (F.coalesce("cn", zero) + 10)
    rate = (F.coalesce("t", zero) + 5 * of_class) / (F.coalesce("n", zero) + 5)
    lift = F.least(F.greatest((rate - base_rate) / (1 - base_rate), zero), F.lit(0.999))
    raised = weighed.groupBy("row_id").agg(F.sum(F.log1p(-lift)).alias("calm"))
    score = F.round(1 - (1 - base_rate) * F.exp(F.coalesce("calm", zero)), 9)
    scored = found.select("row_id", "doc_id", "held_out").join(raised, "row_id", "left").select("row_id", "doc_id", "held_out", score.alias("score"))
    out = cut(scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")), "toxicity-scores")
    discard(hit)
    return out


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows that are not predicted toxic, each judged by its own text whatever its doc_id.

    Nulls, repeated rows and empty tables as in :func:`score_toxicity`.
    """
    release(docs)
    keyed = with_row_keys(docs)
    scores = score_toxicity(keyed_texts(keyed), labels, threshold=threshold, key=ROW)
    hold(keyed, scores)
    return without_rows(keyed, scores.where("predicted = 1").select(F.col("row_id").alias(ROW)))
