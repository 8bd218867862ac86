"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import collocations, jaccard, languages, mixing, negatives, neighbours, ngrams, pieces, quality, simhash, substrings, toxicity, warc
from ledgerline.llm._tools import crc_remainder

#: Target shares of the mixture, in bytes of text: the heavy source is cut down, four are raised.
MIXTURE = {"src0": 0.20, "src1": 0.12, "src2": 0.12, "src3": 0.12, "src4": 0.12}
MIXTURE_REST = 0.32
MIXTURE_SEED = 17


@lru_cache
def vocabulary_file() -> str:
    """The fixed public vocabulary; installed at the same place on every node."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, MIXTURE, rest=MIXTURE_REST, seed=MIXTURE_SEED)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archive(warc.write_archive(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(_table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = languages.identify_language(docs, vocabulary_file(), train=~languages.held_out(F.col("doc_id")))
    return found.select("doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode_documents(_table(spark, sf_dir, "documents"), vocabulary_file(), outputs=False)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngrams.score_by_model(_table(spark, sf_dir, "documents"), train=crc_remainder(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), threshold=10, most_words=3, share=50, top=2000)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), is_anchor=F.col("vec_id") % 100 == 0, label=label)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_simhash,
        op3_warc,
        op4_quality_rules,
        op5_nearest,
        op6_toxicity,
        op7_language,
        op8_substrings,
        op9_pieces,
        op10_perplexity,
        op11_collocations,
        op12_hard_negatives,
        op13_jaccard,
    )
}

_WEIGHTS = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in {**MIXTURE, "other": MIXTURE_REST}.items())

ORACLES = {
    "op1_mix_sources": f"""
        WITH weights(g, w) AS (VALUES {_WEIGHTS}),
        named AS (SELECT *, CASE WHEN source IN ({", ".join(f"'{k}'" for k in MIXTURE)}) THEN source ELSE 'other' END AS g FROM documents),
        sizes AS (SELECT g, sum(strlen(coalesce(text, '')))::DOUBLE AS bytes FROM named GROUP BY g),
        rates AS (
            SELECT g, CASE WHEN bytes > 0 THEN w / {float(sum(MIXTURE.values()) + MIXTURE_REST)!r}::DOUBLE * (SELECT sum(bytes) FROM sizes) / bytes
                      ELSE (w > 0)::INT::DOUBLE END AS rate
            FROM sizes JOIN weights USING (g)),
        terms AS (
            SELECT g, k, CASE WHEN k = 0 THEN -rate ELSE k * ln(rate) - rate - lgamma(k + 1::DOUBLE) END AS log_p
            FROM rates, generate_series(0, 200) s(k) WHERE rate > 0),
        steps AS (SELECT g, k, sum(exp(log_p)) OVER (PARTITION BY g ORDER BY k) AS at_most FROM terms),
        lists AS (SELECT g, list(at_most ORDER BY k) AS steps FROM steps GROUP BY g),
        drawn AS (
            SELECT n.*, ('0x' || substr(md5('{MIXTURE_SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u
            FROM named n),
        counted AS (SELECT d.*, len(list_filter(steps, lambda p: p <= u)) AS n FROM drawn d JOIN lists USING (g))
        SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, n))::INT AS copy FROM counted WHERE n > 0
    """,
    "op3_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        b AS (
            SELECT *, list_aggregate(list_transform(generate_series(0, 31), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
                    ((('0x' || substr(h, 1 + ((5 * i) // 4)::INT, 2) )::BIGINT << 8 | ('0x' || rpad(substr(h, 3 + ((5 * i) // 4)::INT, 2), 2, '0'))::BIGINT)
                     >> (16 - 5 - (5 * i) % 4)::INT & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
                max(page_id) OVER (PARTITION BY h) AS largest FROM p)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < largest THEN largest END AS refers_to
        FROM b
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
        sizes(m) AS (VALUES (1), (2), (3)),
        grams AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM lists, sizes WHERE len(w) >= m),
        counts AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL),
        found AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 10),
        cuts AS (SELECT lang, m, phrase, f, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM found)),
        scored AS (
            SELECT c.lang, c.m, c.phrase, c.f, k, h.f AS l, s.f AS r, ((1000000::HUGEINT * c.f * c.f) // (h.f::HUGEINT * s.f))::BIGINT AS score
            FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts s ON s.lang = c.lang AND s.phrase = c.tail),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_ AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(f) AS around FROM (SELECT *, unnest([1, 2]) AS i FROM found WHERE m = 3) GROUP BY ALL),
        kept AS (SELECT x.* FROM lowest x LEFT JOIN inner_ y ON y.lang = x.lang AND y.phrase = x.phrase WHERE y.around IS NULL OR 100 * y.around < 50 * x.f),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, f AS a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (
            SELECT a.row, a.vec_id AS anchor_id, b.row AS other_row, b.vec_id AS other_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, other_id) <= 5),
        n AS (
            SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                row_number() OVER (PARTITION BY p.row, p.other_row ORDER BY n.score DESC, n.other_id)::INT AS rank
            FROM p JOIN s n ON n.row = p.row AND NOT n.alike AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
    "op13_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
        items AS (SELECT row, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (
            SELECT a.row AS u, b.row AS v FROM items a JOIN items b ON a.g = b.g AND a.row <> b.row AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
            GROUP BY a.row, b.row, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach(row, other) AS (SELECT row, row FROM words UNION SELECT r.row, l.v FROM reach r JOIN links l ON l.u = r.other)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM sets s JOIN (
            SELECT r.row, min(w.doc_id) AS component_id FROM reach r JOIN words w ON w.row = r.other GROUP BY r.row) c ON c.row = s.row
    """,
}
