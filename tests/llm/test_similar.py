"""The near-dedup stage against brute-force shingle similarity."""

import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import _tools, similar
from ledgerline.llm.simhash import simhash
from tests.llm.fixtures import documents, empty


def text(rng, n=120):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(0, len(words), 6), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return words


def shingles(x):
    w = x.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_no_link_is_lost_and_no_other_made(spark):
    rng = random.Random(7)
    data, apart = [], []
    for i in range(120):
        words = text(rng, rng.choice([60, 120, 400]))
        copy, other = changed(rng, words, max(1, len(words) // 60)), changed(rng, words, len(words) // 7)
        data += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(copy)), (10 * i + 2, " ".join(other))]
        apart.append((10 * i + 2, max(jaccard(data[-1][1], data[-3][1]), jaccard(data[-1][1], data[-2][1]))))
    crowd = text(rng)
    data += [(5000 + i, " ".join(changed(rng, crowd, 1))) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    kept = {r[0] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    near = {10 * i + 1 for i in range(120) if jaccard(data[3 * i][1], data[3 * i + 1][1]) >= 0.8}
    assert len(near) > 100 and not near & kept
    assert {10 * i for i in range(120)} | {d for d, x in apart if x < 0.8} <= kept
    assert {d for d in kept if d >= 5000} == {5000}


def test_each_row_is_judged_by_itself(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    data = [(1, a), (1, a), (2, b), (1, b), (None, a), (None, "x y"), (None, "X  y"), (3, None), (None, ""), (0, "z")]
    out = similar.keep_one_similar(spark.createDataFrame(data, "doc_id long, text string").coalesce(1))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, a), (1, b), (None, "x y"), (3, None), (0, "z")], key=str)
    assert similar.keep_one_similar(empty(spark)).count() == 0
    assert similar.keep_one_similar(documents(spark)).columns == documents(spark).columns


def test_fingerprints_link_what_shingle_sets_do_not(spark):
    pairs = {3: 212, 589: 6676, 385: 4738}  # within two bits, of a shingle similarity of 0.57 to 0.74
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("doc_id").isin([*pairs, *pairs.values()]))
    texts = dict(docs.select("doc_id", "text").collect())
    for a, b in pairs.items():
        assert (simhash(texts[a]) ^ simhash(texts[b])).bit_count() <= 2 and jaccard(texts[a].lower(), texts[b].lower()) < 0.8
    assert {r["doc_id"] for r in similar.keep_one_similar(docs).collect()} == set(pairs)


def test_links_of_both_kinds_make_one_group(spark):
    rng = random.Random(11)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (589, 6676)")
    texts = dict(docs.select("doc_id", "text").collect())
    words = texts[6676].split()
    words[len(words) // 2] = "changed"
    data = [(5, texts[589]), (9, texts[6676]), (2, " ".join(words)), (7, "apart " + " ".join(text(rng))), (8, None), (4, " ")]
    assert jaccard(data[1][1].lower(), data[2][1].lower()) >= 0.8 > jaccard(data[0][1].lower(), data[2][1].lower())
    assert {r["doc_id"] for r in similar.keep_one_similar(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()} == {2, 4, 7}


def test_no_task_has_two_python_workers(spark, monkeypatch):
    rng, plans, write = random.Random(3), {}, _tools.cut
    words = [text(rng) for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join(changed(rng, words[i % 40], i // 40))) for i in range(120)], "doc_id long, text string")

    def cut(df, name, bucket=None):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, bucket)

    for module in (_tools, similar):
        monkeypatch.setattr(module, "cut", cut)
    assert similar.keep_one_similar(docs).count() == 40
    assert {"set-blocks", "shared-keys", "sets", "alike-pairs"} <= plans.keys()
    for name, made in plans.items():  # small joins are broadcast, so tests on pairs would stand in one task
        for plan in made:
            assert plan.count("ArrowEvalPython") <= 1, name


def test_a_worker_gives_back_what_it_freed():
    def held():
        return sum(int(x.split()[1]) for x in Path("/proc/self/smaps_rollup").read_text().splitlines() if x.startswith("Pss_Anon:")) // 1024

    def work(batches):
        arrays = [np.full(2000, i) for i in range(12_000)]  # 190 MB in pieces under the size that is mapped
        yield arrays[-1].copy(), held()
        del arrays

    before = held()
    kept = list(_tools.freeing_batches(work)(iter([])))
    assert kept[0][1] > before + 150 and held() < before + 50
    pieces = [np.zeros(2000) + i for i in range(12_000)]
    last = pieces[-1]  # what stands last would keep the rest
    del pieces
    assert _tools.freed(last) is last and held() < before + 50
