"""Every pipeline stage on awkward rows, on an empty table, and as a chain against plain versions."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import _tools, ngrams, pieces, substrings, toxicity
from ledgerline.llm._tools import cut, discard
from ledgerline.llm.queries import MIXTURE, MIXTURE_REST, MIXTURE_SEED, vocabulary_file
from tests.llm.fixtures import documents, empty, rows

SF = "/root/testdata/sf0.001"


def counts(table):
    return Counter(tuple(r) for r in table.collect())


def test_stages_take_awkward_and_empty_tables(spark):
    docs = documents(spark)
    whole = counts(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, empty(spark), SF)
        assert none.columns == docs.columns and none.count() == 0, name
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        if name in ("toxicity", "simhash"):  # rows are kept or not, none is changed
            assert not counts(out) - whole, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty(spark), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows())


def test_columns_of_any_name_keep_their_values(spark):
    named = {c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in ("_row_key", "_row", "copy", "copy_", "root", "group", "_kept", "n_words", "row_id")}
    docs = documents(spark).withColumns(named)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        for r in out.collect():
            assert all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for c in named), name
    assert substrings.remove_repeats(docs).count() == toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).count() == len(rows())
    assert ngrams.score_by_model(docs, F.lit(True)).count() == len(rows())


def test_stages_as_a_chain_delete_what_they_no_longer_read(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, SF), f"chain-{name}")
        held = [x._scratch[0] for x in _tools._HELD]
        assert len(held) <= 2, held  # those of this stage only
        if hasattr(before, "_scratch"):
            discard(before)
    assert counts(docs).total() > 0
    corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert not _tools._HELD


def test_clean_rows_pass_the_toxicity_stage(spark):
    kept = corpus_pipeline.drop_toxic(spark, documents(spark), SF)
    assert counts(kept) == counts(documents(spark))


def test_mixing_and_encoding_equal_plain_versions(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    group = lambda r: r["source"] if r["source"] in MIXTURE else None
    size = Counter()
    for r in docs:
        size[group(r)] += len((r["text"] or "").encode())
    weight = {**MIXTURE, None: MIXTURE_REST}
    want = Counter()
    for r in docs:
        rate = weight[group(r)] / sum(weight.values()) * sum(size.values()) / size[group(r)]
        u = int(hashlib.md5(f"{MIXTURE_SEED}|{r['doc_id']}".encode()).hexdigest()[:13], 16) / 16**13
        n, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        want[r["doc_id"]] += n
    mixed = corpus_pipeline.mix(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert Counter(r["doc_id"] for r in mixed.select("doc_id").collect()) == +want
    library = pieces.vocabulary(vocabulary_file()).library
    text = {r["doc_id"]: r["text"] or "" for r in docs}
    for r in corpus_pipeline.encode(spark, mixed, SF).collect():
        ids = library.encode(text[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
