"""The training-data pipeline: toxicity, near-dedup, substring dedup, mixing, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the next
table, which is written as Parquet in the shared folder and read again as the next one's docs.
All but the last return the columns of documents.  Every stage takes nulls in any column, texts of
any length, repeated rows and ids, and an empty table (which gives an empty one); rows are judged
one by one, whatever their doc_id, and columns of any name keep their values.  Tables that a stage's
lazy result reads are deleted when a later stage begins with that result written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import mixing, pieces, similar, substrings, toxicity
from ledgerline.llm._tools import cut, discard, release
from ledgerline.llm.queries import MIXTURE, MIXTURE_REST, MIXTURE_SEED, vocabulary_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity scores reject go; null and empty texts, which have no term, stay."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts stays that SimHash fingerprints within two bits, or a 5-word-shingle similarity of 0.8 or more, link; no link is lost.

    That of the least doc_id, of equal ones the first of the table; null and wordless texts are one group.
    """
    return similar.keep_one_similar(docs, size=5, similarity=0.8)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by 20-word windows that start earlier (smaller doc_id, or before in the document) go.

    Rows left without a word go; rows without words to begin with stay; null doc_ids come last.
    """
    return substrings.drop_repeated_text(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources take their target shares; null sources count among the rest.

    Rows of one doc_id draw the same count; a row drawn zero times is not in the mixture.  All
    columns keep their values, one named ``copy`` too.
    """
    release(docs)
    own = "copy_"
    while own in docs.columns:
        own += "_"
    mixed = mixing.mix_sources(docs.withColumnRenamed("copy", own), MIXTURE, rest=MIXTURE_REST, seed=MIXTURE_SEED)
    return mixed.select(*[F.col(f"`{own if c == 'copy' else c}`").alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, and the digests of ids and decoded texts, of every copy; a null text has the end id only."""
    release(docs)
    return pieces.encode_documents(docs, vocabulary_file()).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("mixing", mix),
    ("encoding", encode),
]

#: Scores learned from labels, rotations of fingerprints and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        before, written = written, cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        docs = written
    return STAGES[-1][1](spark, docs, sf_dir)
