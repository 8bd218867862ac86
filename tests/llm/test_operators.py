"""Each operator against a brute-force version, and on empty and awkward tables."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import languages, mixing, neighbours, ngrams, pieces, quality, simhash, substrings, toxicity, warc
from ledgerline.llm import _tools as t
from ledgerline.llm._tools import crc_remainder, pack_counts, pack_sorted, unpack_counts, unpack_sorted
from ledgerline.llm.queries import vocabulary_file
from tests.llm.fixtures import documents, empty, rows


def words(text):
    return (text or "").encode().split()


# -- packing ------------------------------------------------------------------------------


def test_packing_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (unpack_sorted(pack_sorted(keys)) == keys).all()
        assert (unpack_counts(pack_counts(keys)) == keys).all()


# -- 1 mixing -----------------------------------------------------------------------------


def test_mixing_follows_rates_and_repeats_itself(spark):
    docs = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit(9).alias("copy")
    )
    mixed = mixing.mix_sources(docs, {"hot": 0.2, "b": 0.5}, rest=0.3)
    share = {r[0]: r[1] for r in mixed.groupBy("source").count().collect()}
    total = sum(share.values())
    assert abs(total - 20000) < 600 and mixed.columns.count("copy") == 1
    for source, want in (("hot", 0.2), ("b", 0.5), (None, 0.3)):
        assert abs(share[source] / total - want) < 0.02
    a, b = (sorted(map(tuple, m.collect()), key=str) for m in (mixed, mixing.mix_sources(docs.repartition(7), {"hot": 0.2, "b": 0.5}, rest=0.3)))
    assert a == b
    order = [r[0] for r in mixed.select("doc_id").collect()]
    assert np.corrcoef(order, range(len(order)))[0, 1] < 0.1
    plan = mixed._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_counts_are_poisson_quantiles(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    got = {r[0]: r[1] for r in mixing.mix_sources(docs, {"s": 1.0}, budget=900.0, seed=5).groupBy("doc_id").count().collect()}
    for i in range(300):
        u = int(hashlib.md5(f"5|{i}".encode()).hexdigest()[:13], 16) / 16**13
        n, p, total = 0, math.exp(-3.0), math.exp(-3.0)
        while total <= u:
            n += 1
            p *= 3.0 / n
            total += p
        assert got.get(i, 0) == n


def test_mixing_large_rates(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    n = mixing.mix_sources(docs, {"s": 1.0}, budget=40 * 5000.0).count()
    assert abs(n - 200_000) < 5 * math.sqrt(200_000)


def test_mixing_awkward_tables(spark):
    assert mixing.mix_sources(empty(spark), {"big": 1.0}).count() == 0
    out = mixing.mix_sources(documents(spark), {"big": 0.5, "absent": 0.1}, rest=0.4)
    assert out.columns == [c for c in documents(spark).columns if c != "copy"] + ["copy"] and out.count() > 0
    assert mixing.mix_sources(documents(spark), {"big": 1.0}).where("source <> 'big' or source is null").count() == 0
    names = ["_group", "_n", "_u", "_order", "_steps", "group", "rate", "row", "u", "n", "steps", "order", "a.b"]
    clash = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"), *[F.concat(F.lit(f"{c}:"), "id").alias(c) for c in names])
    mixed = mixing.mix_sources(clash, {"s": 1.0}, budget=200.0).collect()
    assert mixed and all(r[c] == f"{c}:{r['doc_id']}" for r in mixed for c in names)
    with pytest.raises(ValueError):
        mixing.mix_sources(documents(spark), {"big": -1.0})


# -- 2 SimHash ----------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items):
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(items):
        least[find(i)].append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(items))]


def test_simhash_documents(spark):
    data = [(r[0], plain_fingerprint(r[1])) for r in rows()]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(data, plain_components(data), strict=True)), key=str)
    got = simhash.near_duplicates(documents(spark)).select("doc_id", simhash.fingerprint_hex("fp"), "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one_each(documents(spark))
    assert kept.columns == documents(spark).columns
    named = {c for _, _, c in want}
    assert sorted(r[0] for r in kept.select("doc_id").distinct().collect() if r[0] is not None) == sorted(named)


@pytest.mark.parametrize("few", [4, 256])
def test_links_of_crowded_blocks(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", few)
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(60)}
    chain = rng.getrandbits(64)
    for b in range(20):
        chain ^= 1 << b
        prints.add(chain)
    prints = sorted(prints)
    want = plain_components([(i, f) for i, f in enumerate(prints)])
    df = spark.createDataFrame([(simhash._signed(f),) for f in prints], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    group = defaultdict(set)
    for f, c in zip(prints, want, strict=True):
        group[c].add(roots.get(simhash._signed(f), simhash._signed(f)))
    assert all(len(x) == 1 for x in group.values()) and len({min(x) for x in group.values()}) == len(group)


# -- 3 WARC -------------------------------------------------------------------------------


def pages(spark):
    html = ["<p>a</p>", "<p>a</p>", "", None, "é" * 500, "<p>a</p>", "x" * 100_000, "b\r\n\r\nc", "é" * 500]
    data = [(i, f"http://h/{i}\r\nX: 1" if i == 2 else f"http://h/{i}", h, "clash") for i, h in enumerate(html)]
    return spark.createDataFrame([*data, data[5], (None, None, "<p>a</p>", "clash")], "page_id long, url string, html string, address string")


@pytest.mark.parametrize("least", [0, 500])
def test_archive_round_trip(spark, least):
    table = [tuple(r) for r in pages(spark).collect()]
    archive = warc.write_archive(pages(spark), revisit_from=least)
    got = sorted((tuple(r)[:5] for r in warc.read_archive(archive).collect()), key=str)
    import base64

    want = []
    for i, _, h, _ in table:
        b = (h or "").encode()
        same = [j for j, _, x, _ in table if (x or "") == (h or "") and j is not None]
        revisit = i is not None and len(b) >= least and i < max(same)
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(want, key=str)
    assert archive.payloads.count() == len({h or "" for _, _, h, _ in table})
    records = {r["page_id"]: r for r in warc.read_records(archive).collect()}
    for i, u, h, _ in table:
        r = records[i]
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        assert bytes(r["payload"]) == (h or "").encode() and head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        length = int(head.rsplit(b"Content-Length: ", 1)[1])
        assert body[:-4] == (bytes(r["payload"]) if b"WARC-Type: response" in head else b"") and length == len(body) - 4


def test_records_have_ids_of_their_own_and_hot_payloads_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(warc, "HEADERS_A_TASK", 3)
    archive = warc.write_archive(pages(spark).unionByName(pages(spark)))
    heads = [r["header"] for r in warc.read_records(archive).collect()]
    ids = [h.split("WARC-Record-ID: ")[1].split("\r\n")[0] for h in heads]
    assert len(set(ids)) == len(ids) == 22
    assert {h.split("WARC-Refers-To: ")[1].split("\r\n")[0] for h in heads if "WARC-Refers-To" in h} <= set(ids)


def test_archive_refuses_damage_and_takes_nothing(spark):
    archive = warc.write_archive(pages(spark))
    bad = archive._replace(payloads=archive.payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(bad).collect()
    assert warc.read_archive(warc.write_archive(pages(spark).limit(0))).count() == 0


# -- 4 quality ----------------------------------------------------------------------------


def plain_counts(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    dup, seen = 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_counts(spark):
    extra = "a | b\na | b\n\n\na | b #x\n" + "the cat sat on the mat " * 3
    for r in [*rows(), (0, extra), (0, "a b c d e a b c d e a b c d f"), (0, " ".join(map(str, range(7000))) + " 1 2 3 4 5 6")]:
        assert quality.text_counts(r[1])[:5] == plain_counts(r[1])


def test_quality_sample_is_bounded(spark):
    stats = quality.text_statistics(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))).cache()
    labels = stats.select("doc_id", F.lit(1).alias("quality"))
    sizes = [quality.labelled_sample(stats, labels, n).count() for n in (4000, 1000, 1)]
    assert sizes[0] == 4000 and 800 <= sizes[1] <= 1000 and sizes[2] <= 1
    same = labels.withColumn("doc_id", F.lit(7).cast("long"))  # one document with every label
    assert quality.labelled_sample(stats, same, 1000).count() <= 1000


def test_quality_learns_ordered_rules(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta."]) + str(rng.randrange(500)) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(rng.choice(["###", "$$x", "&&y"]) + str(rng.randrange(500)) for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 150).cast("int").alias("quality"), F.lit("x").alias("n_words"))
    out = quality.quality_rules(docs, labels).collect()
    assert sum(r["kept"] == (r["doc_id"] < 150) for r in out) > 200 and not any(r["base_failed"] for r in out)
    assert [r["doc_id"] for r in quality.quality_rules(documents(spark), labels.limit(0)).where("kept and n_words < 10").collect()] == []
    assert quality.quality_rules(documents(spark), labels).count() == len(rows())
    assert quality.quality_rules(empty(spark), labels.limit(0)).count() == 0


def test_quality_verdict_equals_the_rules_applied_by_hand(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "beta.", "c1", "##", "it"]) + str(rng.randrange(40) or "") for _ in range(rng.randrange(4, 80))) for _ in range(260)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, "one two " * 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x.count("##") * 4 < len(x.split()))) for i, x in enumerate(texts)] + [(3, 0), (4, None), (None, 1), (7777, 0)], "doc_id long, quality int")
    rules = quality.fit_rules(quality.text_statistics(docs), labels)
    assert rules
    names = quality._COUNTS
    for r in quality.quality_rules(docs, labels).collect():
        x = dict(zip(names, quality.text_counts(texts[r["doc_id"]] if r["doc_id"] < 260 else {900: None, 901: "", 902: "one two " * 40}[r["doc_id"]]), strict=True))
        w, lines, chars = max(x["n_words"], 1), max(x["n_lines"], 1), max(x["word_chars"], 1)
        ratio = {
            "n_words": x["n_words"], "chars_per_word": x["word_chars"] / w, "symbols_per_word": x["n_symbols"] / w, "dup_lines": x["n_dup_lines"] / lines, "repeated": x["n_repeat_words"] / w, "words_per_line": x["n_words"] / lines,
            "distinct": x["n_distinct"] / w, "short": x["n_short"] / w, "marks": x["n_marks"] / w, "digits": x["n_digits"] / chars,
        }
        failed = x["n_words"] < 10 or 100 * x["n_repeat_words"] > 20 * x["n_words"]
        hit = any(all(ratio[c.feature] <= c.threshold if c.below else ratio[c.feature] > c.threshold for c in rule) for rule in rules)
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not hit)


# -- 5 nearest neighbours -----------------------------------------------------------------


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_nearest_recall_ties_and_unusable_vectors(spark, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1500, 24)) + 4 * rng.standard_normal((6, 24))[rng.integers(0, 6, 1500)]
    v[100:180] = v[100]
    data = [(i, [float(x) for x in np.float32(r)], "clash") for i, r in enumerate(v)]
    odd = [(5001, None, ""), (5002, [0.0] * 24, ""), (5003, [1.0] * 23 + [None], ""), (5004, [float("nan")] * 24, ""), (5005, [1.0], ""), (5006, [float("inf")] * 24, ""), (None, data[3][1], ""), data[7]]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, key string").repartition(6)
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, index_block=(64, 300), query_block=40).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    w = np.float32(v).astype(float)
    hits = 0
    for q in range(0, 1500, 20):
        s = w @ w[q]
        want = [i for i in np.lexsort((np.arange(1500), -np.round(s, 9))) if i != q][:20]
        assert len(got[q]) == 20 and all(abs(x - s[i]) < 1e-9 for i, x in got[q])
        hits += len(set(want) & {i for i, _ in got[q]})
    assert set(got) == set(range(0, 1500, 20)) and hits / (75 * 20) > 0.97
    few = neighbours.nearest(df.where("vec_id < 6 and vec_id >= 0"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4, 5]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.5, 0.5]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows_ = sorted(map(tuple, neighbours.nearest(twice, F.col("vec_id") == 1).collect()))
    assert rows_ == [(1, 1, 3, 1.0), (1, 2, 2, 0.5)]


def test_bounds_spare_most_vectors():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((4000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    turn = neighbours.rotation(64, 1)
    codes = neighbours.Codes(*neighbours.encode(v, np.zeros(64), turn), np.zeros(64), turn, 2.0)
    estimates, errors = codes.estimate(v[:50])
    exact = v[:50] @ v.T
    assert abs((estimates - exact).mean()) < 1e-3 and (abs(estimates - exact) <= errors).mean() > 0.94
    hits = scored = 0
    for i in range(50):
        chosen, score, n = neighbours.best_of(v[i], v, estimates[i], errors[i], 21)
        hits, scored = hits + len(set(chosen) & set(np.argsort(-exact[i])[:21])), scored + n
    assert hits / (50 * 21) > 0.96 and scored < 0.3 * 50 * 4000


# -- 6 toxicity ---------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def nearest_term(word, lexicon, roots):
    found = [(d, x, False) for x in lexicon if (d := distance(word, x)) <= toxicity.edits_allowed(x)]
    found += [(d, x, True) for x in roots if (d := min(distance(word[:k], x) for k in range(len(word) + 1))) <= toxicity.root_edits(x)]
    best = min(found, default=None)
    return best and (best[1], best[0], best[2])


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    lexicon, roots = toxicity.LEXICON, ["réeux", "achl", "bomen", "stup", "lowei"]
    auto = toxicity.LexiconAutomaton(lexicon, roots)
    for _ in range(900):
        w = list(rng.choice([*lexicon, *(r + rng.choice(["", "ment", "aux", "o"]) for r in roots)]))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "x", "é", "a", "1"])
        w = "".join(w)
        assert auto.find(w) == nearest_term(w, lexicon, roots), w
    assert auto.find("scvm") == ("scum", 1, False) and auto.find("réexment") == ("réeux", 1, True) and auto.find("acl") is None


def plain_toxicity(data, marked, roots):
    """Scores from their definition: (spelling, class) shares drawn towards class shares, combined as independent chances."""
    auto = toxicity.LexiconAutomaton(toxicity.LEXICON, roots)
    train = {i: y for i, y in marked.items() if zlib.crc32(str(i).encode()) % 3 != 1}
    hits = {}
    for i, text in data:
        found = toxicity.hits_in(text, auto)
        hits[i] = [(s, (min(d, 2), root, len(term) < 5, quoted, min(3, sum(h[2] == 0 and h[3] == root for h in found)))) for s, term, d, root, quoted in found]
    calm = [train[i] for i in train if not hits[i]]
    base = (sum(calm) + 1) / (len(calm) + 20)
    own, kinds = defaultdict(list), defaultdict(list)
    for i, y in train.items():
        for s, k in hits[i]:
            own[s, k].append(y)
            kinds[k].append(y)
    out = {}
    for i, _ in data:
        left = 1 - base
        for s, k in hits[i]:
            prior = (0.9 if k[0] == 0 else 0.5) * (1 / 3 if k[3] else 1)
            of_class = (sum(kinds[k]) + 10 * prior) / (len(kinds[k]) + 10)
            rate = (sum(own[s, k]) + 5 * of_class) / (len(own[s, k]) + 5)
            left *= 1 - min(max((rate - base) / (1 - base), 0), 0.999)
        out[i] = 1 - left
    return out


def test_toxicity_scores(spark):
    rng = random.Random(4)
    clean = [" ".join(rng.choice(["river", "stone", "wind", "paper"]) for _ in range(30)) for _ in range(300)]
    toxic = [c[:40] + " you stupid " + rng.choice(["idiot", "moron"]) + " " + c[40:] for c in clean[:100]]
    last = ["what a st1pid worthles thing", None, "", "STUPID!", 'they said "stupid" is a word']
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(toxic + clean + last)], "doc_id long, text string, score string")
    labels = docs.where("doc_id < 400").select("doc_id", (F.col("doc_id") < 100).cast("int").alias("toxic"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == 405 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["predicted"] == 1 for i in range(100)) and not any(got[i]["predicted"] for i in range(100, 400))
    assert got[403]["predicted"] == 1 and got[400]["score"] > got[401]["score"] and got[404]["score"] < got[403]["score"]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert toxicity.score_toxicity(empty(spark), labels.limit(0)).count() == 0
    assert toxicity.score_toxicity(documents(spark), labels).count() == len(rows())
    assert toxicity.reject_toxic(docs, labels).count() == sum(not r["predicted"] for r in got.values())


def test_scores_equal_brute_force_and_come_from_terms_and_roots(spark):
    rng = random.Random(5)
    word = lambda n=6: "".join(rng.choice("abcdefgh") for _ in range(n))
    bad = lambda: rng.choice([f"zlorm{word(rng.randrange(1, 4))}", "scum", "scvm", "worthles", 'said "idiot" today'])
    data = [(i, f"{word()} {bad()} {word()} {bad()} {word()}" if i < 120 else f"{word()} {word()} {word()}" + (" scam aile" if i % 9 == 0 else "")) for i in range(400)]
    data += [(400, "zlormxyz zlorq"), (401, "zlarmxyz and zlormb"), (402, ""), (403, None), (404, "copied zworp of a copied text")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    marked = {i: int(i < 120) for i, _ in data[:400]}
    labels = spark.createDataFrame([(i, y) for i, y in marked.items()] + [(7, None), (9999, 1)], "doc_id long, toxic int")
    train = labels.where("toxic is not null").where(crc_remainder(F.col("doc_id"), 3) != 1).select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("double").alias("toxic"))
    roots = toxicity.learn_roots(docs, train)
    assert any("zlorm".startswith(r) or r.startswith("zlorm") for r in roots) and toxicity.learn_roots(docs, train.limit(0)) == []
    want = plain_toxicity(data, marked, roots)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(abs(got[i] - want[i]) < 1e-8 for i in want)
    held = [i for i in marked if zlib.crc32(str(i).encode()) % 3 == 1]
    caught = lambda **kw: sum(r["predicted"] for r in toxicity.score_toxicity(docs, labels, **kw).where(F.col("doc_id").isin([i for i in held if i < 120])).collect())
    whole, none = caught(), caught(lexicon=["qqqqqqqq"], roots=[])
    assert whole > 0.9 * sum(i < 120 for i in held) and none == 0 and none < caught(roots=[]) < whole


def test_copies_of_a_text_are_no_evidence(spark):
    docs = spark.createDataFrame([(i, "copied zworpa zworpb zworpc of a copied text") for i in range(60)] + [(i, f"calm word{i} here") for i in range(60, 400)], "doc_id long, text string")
    marked = docs.select(F.col("doc_id").alias("label_id"), (F.col("doc_id") < 60).cast("double").alias("toxic"))
    assert toxicity.learn_roots(docs, marked) == []


# -- 7 languages --------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    table = languages.Pieces(["▁a", "a", "b", "ab", "▁ab", "▁"], np.array([[3.0, 1], [2, 1], [2, 5], [1, 1], [4, 1], [1, 1]]), 0.0)
    p = dict(zip(["▁a", "a", "b", "ab", "▁ab", "▁"], table.p, strict=False))

    def total(s):
        return 1.0 if not s else sum((p[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p), np.zeros(2))

    table.score(["ab", "abab", "abbabab", "ab" * 40])
    for w in ("ab", "abab", "abbabab"):
        assert np.allclose(table.rows[table.known[w]], np.log(total("▁" + w)))
    assert np.isfinite(table.rows[table.known["ab" * 40]]).all()


def test_long_unknown_words_keep_their_evidence():
    table = languages.Pieces(["▁a", "a", "b", "▁"], np.array([[3.0, 1], [2, 1], [2, 5], [1, 1]]), 0.1)
    words_ = ["aaaaa" + "x" * n for n in range(1, 101)]
    table.score(words_)
    gap = [np.subtract(*table.rows[table.known[w]]) for w in words_]
    assert np.ptp(gap) < 1e-9 and abs(gap[0]) > 1
    steps = np.diff([table.rows[table.known[w]][0] for w in words_])
    assert np.allclose(steps, math.log(1e-9))


def test_words_are_letters():
    assert languages.words_of("½ ² Ⅷ ① 12 _ -- ٣") == [] and languages.words_of("Éa²b x½ e\u0301t") == ["éa", "b", "x", "e\u0301t"]


def test_predictions_equal_brute_force(spark):
    """Every prediction and score from the definition: all segmentations of all words, by recursion."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=vocabulary_file())
    data = [(i, " ".join(["the cat", "le chat noir", "der hund"][i % 3] for _ in range(1 + i % 2)) + (" xq" if i % 5 == 0 else ""), ["en", "fr", "de"][i % 3]) for i in range(24)]
    train = [x for x in data if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    names, count = ["de", "en", "fr"], defaultdict(Counter)
    for _, text, lang in train:
        for w in text.split():
            count[lang].update(model.encode(w))
    n = model.get_piece_size()
    p = {x: [(count[x][i] + 0.1) / (sum(count[x].values()) + 0.1 * n) for i in range(n)] for x in names}
    ids = {model.id_to_piece(i): i for i in range(n) if i > 2 and not model.id_to_piece(i).startswith("<0x")}

    def total(s, x):
        out = 0.0 if s else 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in ids or k == 1:
                out += (p[x][ids[s[:k]]] if s[:k] in ids else 1e-9) * total(s[k:], x)
        return out

    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    for r in languages.identify_language(docs, vocabulary_file(), ~languages.held_out(F.col("doc_id"))).collect():
        logs = [sum(math.log(total("▁" + w, x)) for w in data[r["doc_id"]][1].split()) for x in names]
        assert r["lang_pred"] == names[int(np.argmax(logs))]
        assert r["score"] == pytest.approx(1 / sum(math.exp(x - max(logs)) for x in logs), rel=1e-4)


def test_language_held_out(spark):
    rng = random.Random(6)
    stock = {"en": ["the", "thing", "and", "with", "nation"], "de": ["der", "und", "schein", "keit", "über"], "fr": ["le", "été", "eaux", "vie", "ment"]}
    data = [(i, " ".join(rng.choice(stock[x]) + rng.choice(["", rng.choice(stock[x])]) for _ in range(20)), x) for i, x in enumerate(list(stock) * 60)]
    odd = [(900, None, "en"), (901, "", "en"), (902, "12 34 !!", "de"), (903, "the " * 3, None), (904, "x" * 5000, None)]
    docs = spark.createDataFrame(data + odd, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in languages.identify_language(docs, vocabulary_file(), ~languages.held_out(F.col("doc_id"))).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in data) and [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und"] * 3 + ["en"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 185
    assert {r["lang_pred"] for r in languages.identify_language(docs.limit(5), vocabulary_file(), F.lit(False)).collect()} == {"und"}
    assert languages.identify_language(empty(spark), vocabulary_file(), F.lit(True)).count() == 0
    assert languages.identify_language(documents(spark), vocabulary_file(), F.lit(True)).count() == len(rows())


# -- 8 substrings -------------------------------------------------------------------------


def plain_removal(data, size=20):
    ids = [(1 << 63) - 1 if d is None else d for d, _ in data]
    first = {}
    for d, t in sorted(zip(ids, [words(t) for _, t in data], strict=True), key=lambda x: x[0]):
        for i in range(len(t) - size + 1):
            w = tuple(t[i : i + size])
            first[w] = min(first.get(w, (d, i)), (d, i))
    out = []
    for (d, text), order in zip(data, ids, strict=True):
        t, gone = words(text), set()
        for i in range(len(t) - size + 1):
            if first[tuple(t[i : i + size])] < (order, i):
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(t) if i not in gone)
        out.append((d, len(t), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes,task", [(6 << 20, 1 << 25), (700, 64)])
def test_substrings(spark, monkeypatch, block_bytes, task):
    monkeypatch.setattr(substrings, "CELLS_A_TASK", 32 * task)
    monkeypatch.setattr(substrings, "WINDOWS_A_TASK", task)
    got = substrings.remove_repeats(documents(spark), block_bytes=block_bytes).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == plain_removal([(r[0], r[1]) for r in rows()])


def test_sketch_never_underestimates():
    rng = random.Random(7)
    plan = substrings.Plan(4, 12, 3, 1)
    texts = [[b"%d" % rng.randrange(6) for _ in range(rng.randrange(400))] for _ in range(9)]
    added, windows = np.zeros(2 << 12, int), Counter()
    blocks = []
    for words_ in texts:
        known: dict[bytes, int] = {}
        tokens = np.array([known.setdefault(w, len(known)) for w in words_], np.int32)
        blocks.append(t.Block(0, np.zeros(1, int), np.zeros(1, int), np.zeros(1, bool), np.array([len(words_)]), tokens, list(known)))
        cells, twice = substrings.sketch(blocks[-1], plan)
        added[cells.astype(int)] += 1 + twice
        windows.update(tuple(words_[i : i + 4]) for i in range(len(words_) - 3))
    for b, words_ in zip(blocks, texts, strict=True):
        w = substrings.windows_of(b, plan)
        estimate = added[w.cells.astype(int)][w.place].min(0) if len(w.cells) else []
        assert all(e >= min(2, windows[tuple(words_[i : i + 4])]) for i, e in enumerate(estimate))


def test_substrings_keep_columns(spark):
    assert substrings.remove_repeats(empty(spark)).count() == 0
    docs = documents(spark)
    out = substrings.drop_repeated_text(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    gone = {d for d, n, k, _ in plain_removal([(r[0], r[1]) for r in rows()]) if n and n == k and d is not None}
    assert {r[0] for r in out.select("doc_id").collect() if r[0] is not None} == {r[0] for r in rows() if r[0] is not None} - gone


# -- 9 pieces -----------------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    v = pieces.vocabulary(vocabulary_file())
    rng = random.Random(8)
    alphabet = "  aeiouthnrs.,▁é你😀\n\t\x00ßﬁ1"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(400)] + ["a" * 1000, " " * 70, "▁", "the" * 50]
    for text, (shown, ids) in zip(texts, v.encode(texts), strict=True):
        assert ids == v.library.encode(text, add_eos=True) and shown == " ".join(map(str, ids))
    for part in ["▁hello", "▁" * 40, "aaaaabbbbb", "▁international", "你好ß"]:
        assert v.by_heap(part) == v.together([part])[0]
    got = pieces.encode_documents(documents(spark), vocabulary_file())
    want = []
    for r in rows():
        ids = v.library.encode(r[1] or "", add_eos=True)
        text = v.library.decode(ids)
        want.append((r[0], len(ids), json.dumps(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), text, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(((r[0], r[1], json.dumps(r[2]), *r[3:]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert pieces.encode_documents(empty(spark), vocabulary_file()).count() == 0


def test_pieces_of_any_text_equal_the_library():
    v = pieces.MergeVocabulary(vocabulary_file())
    rng = random.Random(9)
    anything = [chr(c) for c in rng.sample([*range(0xD800), *range(0xE000, 0x110000)], 3000)] + ["\ufffe", "\uffff", "\ufffd", "\ufeff"]
    common = [*v.symbols, *" \n\t\x00'.,²1"]
    texts = ["".join(rng.choice(common if rng.random() < 0.8 else anything) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += ["don't,stop.\nNow!!", "x² ².", "</s><unk>", "▁▁ a▁", "", "\n\n", "the,the.the the"]
    for text, (shown, ids) in zip(texts, v.encode(texts), strict=True):
        assert ids == v.library.encode(text, add_eos=True) and shown == " ".join(map(str, ids))
        assert v.library.decode(ids) == text.replace("▁", " ")
    assert v.encode([""]) == [(str(v.end), [v.end])] and v.encode([]) == []


def test_pieces_are_the_same_after_parts_are_forgotten(monkeypatch):
    v = pieces.MergeVocabulary(vocabulary_file())
    monkeypatch.setattr(pieces, "_KNOWN", 20)
    for text in [*(f"part{i} the cat, {i} more" for i in range(40)), "a" * 100, "the cat"]:
        assert v.encode([text, text])[1][1] == v.library.encode(text, add_eos=True)
    assert len(v.known) < 40


class _Frame:
    """Gives back the function over batches that a table would be mapped by."""

    def select(self, *columns):
        return self

    def mapInArrow(self, work, schema):
        return work


def test_the_library_is_given_each_part_once(spark, monkeypatch):
    v = pieces.MergeVocabulary(vocabulary_file())
    library, given = v.library, []

    class Library:
        def encode(self, texts, **options):
            given.extend(texts)
            return library.encode(texts, **options)

        def __getattr__(self, name):
            return getattr(library, name)

    v.library = Library()
    monkeypatch.setattr(pieces, "vocabulary", lambda _: v)
    work = pieces.encode_documents(_Frame(), vocabulary_file())
    texts = [f"The cat, the dog and 你好.\nThe end of {i % 3}! " * 50 for i in range(30)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(30)), "text": texts})
    got = pa.Table.from_batches(work(iter([batch, batch])))
    assert got["ids"].to_pylist() == [library.encode(x, add_eos=True) for x in texts] * 2
    assert got["decoded"].to_pylist() == texts * 2
    assert len(given) == len(set(given)) and sum(map(len, given)) < 200
    # a part whose ids are wrong stops the task, and so do ids of another text
    v._forget()
    with monkeypatch.context() as m, pytest.raises(ValueError, match="differently"):
        m.setattr(v, "together", lambda parts: [(5,)] * len(parts))
        list(work(iter([batch])))
    with monkeypatch.context() as m, pytest.raises(ValueError, match="document 0 do not spell"):
        m.setattr(v, "encode", lambda texts, check: [("5", [5])] * len(texts))
        list(work(iter([batch])))


# -- 10 language model --------------------------------------------------------------------


def plain_model(data, order):
    """Modified Kneser-Ney by its definition: continuation counts below the highest order."""
    tokens = [([w.lower() for w in words(t)] + ["\n"], is_train) for t, is_train in data]
    padded = lambda t: ["\n\n"] * (order - 1) + t
    grams = lambda t, n: [tuple(padded(t)[i + order - n : i + order]) for i in range(len(t))]
    count = {n: Counter() for n in range(1, order + 1)}
    raw = Counter(w for t, is_train in tokens if is_train for w in t)
    for t, is_train in tokens:
        if is_train:
            count[order].update(grams(t, order))
    for n in range(order - 1, 0, -1):
        count[n] = Counter(g[1:] for g in count[n + 1])
    of = lambda values: [sum(x == k for x in values) for k in (1, 2, 3, 4)]
    d = {n: ngrams.discounts(*of(count[n].values())) for n in count}
    after = {n: defaultdict(list) for n in count}
    for n in count:
        for g, c in count[n].items():
            after[n][g[:-1]].append(c)
    total, vocabulary = sum(raw.values()), len(raw)

    def p(g):
        n, followers = len(g), after[len(g)][g[:-1]]
        low = p(g[1:]) if n > 1 else 1 / (vocabulary + 1)
        if not followers:
            return low
        c = count[n][g]
        return (max(c - d[n][min(c, 3)], 0) + sum(d[n][min(x, 3)] for x in followers) * low) / sum(followers)

    out = []
    for t, is_train in tokens:
        out.append((is_train, len(t), sum(raw[w] > 0 for w in t), total, sum(math.log10((raw[w] + 1) / (total + vocabulary + 1)) for w in t), sum(math.log10(p(g)) for g in grams(t, order))))
    some = next((g[:-1] for g in count[order]), None)
    assert some is None or abs(sum(p((*some, w)) for w in raw) + p((*some, "never seen")) - 1) < 1e-9
    return out


def plain_train(d):
    return zlib.crc32(str(d).encode()) % 7 != 2 if d is not None else True


def scored(rows_):
    return sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in rows_)


@pytest.mark.parametrize("order,block_bytes,shard", [(3, 6 << 20, 1 << 21), (3, 900, 500), (2, 900, 500), (1, 900, 500), (4, 2000, 900)])
def test_model_equals_brute_force(spark, monkeypatch, order, block_bytes, shard):
    monkeypatch.setattr(ngrams, "TOKENS_A_SHARD", shard)
    data = rows()
    want = plain_model([(r[1], plain_train(r[0])) for r in data], order)
    want = sorted((str(r[0]), *w[1:4], round(w[4], 6), round(w[5], 6)) for r, w in zip(data, want, strict=True))
    train = crc_remainder(F.col("doc_id"), 7) != 2
    got = ngrams.score_by_model(documents(spark), train, order, block_bytes).collect()
    assert scored(got) == want
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in got)
    if block_bytes == 900:
        model = ngrams.train_model(documents(spark), train, order, block_bytes)
        assert scored(ngrams.score_texts(documents(spark), model, 1500).collect()) == want


def test_model_without_training(spark):
    out = ngrams.score_by_model(documents(spark), F.lit(False)).collect()
    assert len(out) == len(rows()) and all(r["score"] == 0 and r["n_known"] == 0 for r in out)
    assert ngrams.score_by_model(empty(spark), F.lit(True)).count() == 0


def test_a_text_of_megabytes(spark):
    """One text much longer than a block, for the operators that work in blocks or batches."""
    rng = random.Random(11)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(400_000))
    docs = spark.createDataFrame([(1, long, "en"), (2, long[:3000], "en"), (3, "short", "en")], "doc_id long, text string, lang string")
    got = substrings.remove_repeats(docs, block_bytes=1 << 20).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == plain_removal([(1, long), (2, long[:3000]), (3, "short")])
    assert {r["doc_id"]: r["n_tokens"] for r in ngrams.score_by_model(docs, F.lit(True), block_bytes=1 << 20).collect()}[1] == 400_001
    assert languages.identify_language(docs, vocabulary_file(), F.lit(True)).where("lang_pred = 'en'").count() == 3
    v = pieces.vocabulary(vocabulary_file())
    assert {r["n_tokens"] for r in pieces.encode_documents(docs, vocabulary_file(), outputs=False).where("doc_id = 1").collect()} == {len(v.library.encode(long)) + 1}
