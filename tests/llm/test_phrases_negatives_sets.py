"""Collocations, hard negatives and n-gram Jaccard joins against brute force, and on awkward tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import collocations, jaccard, negatives
from tests.llm.fixtures import documents, empty, prose, rows


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# -- collocations -------------------------------------------------------------------------


def plain_collocations(data, threshold, most_words, share, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            for n in range(1, most_words + 1):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = set()
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= threshold}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= share * a and inside(p, q) for q, b in found.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])}
    return out


@pytest.mark.parametrize(("threshold", "most_words", "block_bytes"), [(3, 4, 500), (10, 3, 6 << 20)])
def test_collocations_equal_brute_force(spark, threshold, most_words, block_bytes, monkeypatch):
    monkeypatch.setattr(collocations, "MASS_A_SHARD", 2000)
    data = [*rows(), *[(i, f"New York, big  {'the' if i % 2 else 'The'} red-hot\tpan.Old; {prose(i % 5, 20, 4)}", None, "s", 1) + (None,) * 9 for i in range(40)]]
    docs = spark.createDataFrame(data, documents(spark).schema).repartition(3)
    got = collocations.collocations(docs, threshold, most_words, 50, 30, block_bytes=block_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert set(map(tuple, got.collect())) == plain_collocations(data, threshold, most_words, 50, 30)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(empty(spark)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, " .. ", "en")], "doc_id long, text string, lang string")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 4 * 10**12 + 7, 9 * 10**13 + 1, 5 * 10**12 + 3
    table = spark.createDataFrame([("en", 2, "x y", a), ("en", 1, "x", left), ("en", 1, "y", right)], "lang string, n_words int, phrase string, f long")
    assert collocations.scored_phrases(table).first()["score"] == 10**6 * a * a // (left * right)


def test_a_phrase_inside_longer_ones_goes(spark):
    table = [("en", 3, "a b c", 50), ("en", 2, "a b", 100), ("en", 2, "b c", 101), ("en", 1, "a", 200), ("en", 1, "b", 200), ("en", 1, "c", 200)]
    found = collocations.scored_phrases(spark.createDataFrame(table, "lang string, n_words int, phrase string, f long"))
    assert {r["phrase"] for r in found.collect()} == {"a b c", "b c"}  # 100 * 50 >= 50 * 100 drops the first pair only


def test_summaries_lose_nothing_frequent():
    rng = np.random.default_rng(3)
    for capacity in (5, 50, 400):
        parts, truth = [], Counter()
        for _ in range(20):
            drawn = (rng.zipf(1.3, 500) % 900).astype(np.uint64)
            truth.update(drawn.tolist())
            parts.append(np.unique(drawn, return_counts=True))
        keys, counts, off = collocations.merge_summaries(parts, capacity)
        assert len(keys) <= capacity and off * (capacity + 1) <= sum(truth.values())
        have = dict(zip(keys.tolist(), counts.tolist(), strict=True))
        for k, n in truth.items():
            assert have.get(k, 0) <= n <= have.get(k, 0) + off


# -- hard negatives -----------------------------------------------------------------------


def plain_negatives(data, is_anchor, n_pos, n_neg, low, high, dim):
    kept = [(i, d, label, [int(np.floor(256 * float(x))) for x in v]) for i, (d, v, label) in enumerate(data) if d is not None and label is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, d, label, v in kept:
        if not is_anchor(d):
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=True))  # noqa: B023, E731
        scored = [(-score(w), e, j, x) for j, e, x, w in kept if j != i]
        for s, p, _, _ in sorted(x for x in scored if x[3] == label)[:n_pos]:
            inside = sorted(x for x in scored if x[3] != label and low * -s <= 100 * -x[0] <= high * -s)
            out += [(d, p, r, n, -s, -t) for r, (t, n, _, _) in enumerate(inside[:n_neg], 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, row string, v long, id long, i int"


def vectors(n, dim, labels=4, scale=1.0, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in (rng.standard_normal(dim) * scale).astype(np.float32)], int(rng.integers(0, labels))) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in data], VECTORS).repartition(3)


@pytest.mark.parametrize(("dim", "scale", "block"), [(8, 1.0, 1 << 22), (70, 0.3, 2000), (3, 3e5, 1 << 22)])
def test_hard_negatives_equal_brute_force(spark, dim, scale, block):
    data = vectors(150, dim, scale=scale)
    data += [(150, data[0][1], 2), (151, data[0][1], data[0][2]), (152, None, 1), (153, data[1][1], None), (None, data[2][1], 1), (154, [0.0] * dim, 3)]
    data += [(155, [float("nan")] + [1.0] * (dim - 1), 1), (156, [None] + [1.0] * (dim - 1), 1), (157, [1.0] * (dim + 1), 1), (158, [float("inf")] * dim, 1), (159, [], 0)]
    got = negatives.hard_negatives(frame(spark, data), F.col("vec_id") % 10 == 0, block_numbers=block)
    assert sorted(map(tuple, got.collect())) == plain_negatives(data, lambda d: d % 10 == 0, 5, 10, 30, 90, dim)


def test_repeated_anchors_and_ties(spark):
    one = [1.0, 0.0]
    data = [(10, one, 1), (10, one, 1), (3, one, 1), (4, [0.5, 0.0], 2), (5, [0.5, 1.0], 2), (2, [0.5, 2.0], 2)]
    got = negatives.hard_negatives(frame(spark, data), F.col("vec_id") % 10 == 0, positives=2, negatives=2)
    assert sorted(map(tuple, got.collect())) == plain_negatives(data, lambda d: d % 10 == 0, 2, 2, 30, 90, 2)


def test_hard_negatives_of_nothing(spark):
    assert negatives.hard_negatives(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(frame(spark, [(10, [1.0], 1)]), F.col("vec_id") % 10 == 0).count() == 0


def test_scores_beyond_64_bits_are_refused(spark):
    with pytest.raises(ValueError, match="64 bits"):
        negatives.hard_negatives(frame(spark, [(10, [1e12, 1.0], 1), (20, [2.0, 1.0], 1)]), F.col("vec_id") % 10 == 0)


def test_residues_give_back_signed_values():
    rng = np.random.default_rng(5)
    for limit in (1, 1000, 10**7, 10**14, 2**62):
        primes = negatives.primes_for(limit)
        values = np.concatenate([rng.integers(-limit, limit, 200, dtype=np.int64), [limit, -limit, 0, 1, -1]])
        assert (negatives.from_residues([values % p for p in primes], primes) == values).all()


def test_products_are_exact():
    rng = np.random.default_rng(6)
    a, b = rng.integers(-(10**6), 10**6, (7, 300)), rng.integers(-(10**6), 10**6, (9, 300))
    primes = negatives.primes_for(300 * 10**12)
    got = negatives.Residues(a, primes).scores(negatives.Residues(b, primes), slice(0, 7))
    assert (got == a @ b.T).all()


# -- n-gram Jaccard join ------------------------------------------------------------------


def plain_sets(text, size):
    w = [x for x in re.split("[ \t-\r]+", lowered(text)) if x]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain_components(data, size, percent):
    sets, root = [plain_sets(x[1], size) for x in data], list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, x in enumerate(data):
        if x[0] is not None:
            least[find(i)].append(x[0])
    return sorted(((x[0], len(sets[i]), min(least[find(i)], default=None)) for i, x in enumerate(data)), key=str)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        if not w:
            return "zz"
        at = rng.randrange(len(w))
        w[at : at + 1] = rng.choice([[], ["zz%d" % rng.randrange(50)], [w[at], "yy"]])
    return " ".join(w)


def near_copies(seed, n_texts, n_copies):
    """Texts of 1 to 300 words, each with copies of 0 to 12 edits, chains of edits, and a passage that all long ones share."""
    rng, out = random.Random(seed), []
    passage = prose(77, 30)
    for k in range(n_texts):
        base = prose(1000 * seed + k, rng.choice([1, 3, 5, 8, 9, 12, 20, 40, 100, 300]))
        if len(base.split()) > 30:
            base += " " + passage
        last = base
        for _ in range(n_copies):
            out.append(edited(rng, base, rng.randrange(12)) if rng.random() < 0.7 or not last.split() else (last := edited(rng, last, 2)))
    return [(i, x) for i, x in enumerate(out)]


@pytest.mark.parametrize(("size", "percent", "tile"), [(4, 85, 1024), (2, 70, 4), (1, 50, 8)])
def test_similar_documents_equal_brute_force(spark, size, percent, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "ROWS_A_GROUP", 40)
    monkeypatch.setattr(jaccard, "KEYS_A_SHARD", 500)
    data = near_copies(size + percent + tile, 24, 8)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = jaccard.similar_documents(docs, size, percent, block_bytes=4000)
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(data, size, percent)


def test_similar_documents_on_awkward_rows(spark):
    got = jaccard.similar_documents(documents(spark).withColumns({"node": F.lit(3), "n": F.lit("x")}), block_bytes=3000)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(rows(), 4, 85)
    assert jaccard.similar_documents(empty(spark)).count() == 0


def test_alike_sets_share_a_key():
    """Sets just at the limit, of all small sizes and some large ones, in both directions."""
    rng = np.random.default_rng(9)
    rule = jaccard.Rule(4, 85)
    bands = rule.bands(9000)
    for n in [*range(1, 120), 300, 1000, 5000]:
        for _ in range(4):
            s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            m = int(rng.integers(n, rule.most_partner(n) + 1))
            drop = max((d for d in range(n + 1) if 100 * (n - d) >= 85 * (m + d)), default=0) if m < 200 else (100 * n - 85 * m) // 185
            t = np.unique(np.concatenate([s[rng.permutation(n)[drop:]], rng.integers(0, 1 << 63, m - n + drop, dtype=np.uint64)]))
            if len(t) != m or (s.tolist() == t.tolist()):
                continue
            assert 100 * (n - drop) >= 85 * (m + drop)
            assert np.intersect1d(jaccard.part_keys(s, rule, bands), jaccard.part_keys(t, rule, bands)).size


def test_bitmaps_never_overstate_differences():
    rng = np.random.default_rng(4)
    for n, m in ((10, 12), (100, 300), (3000, 2600)):
        pool = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[: n // 2], pool[n : n + m - n // 2]]))
        x, y = jaccard.bitmap(a), jaccard.bitmap(b)
        size = min(len(x), len(y))
        differ = int(np.bitwise_count(jaccard.folded(x, size) ^ jaccard.folded(y, size)).sum())
        assert differ <= len(np.setxor1d(a, b))
