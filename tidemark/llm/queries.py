"""The registered queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import embeddings, media, packing, pieces, pii, secrets, simhash, substrings, suffixes, toxicity
from tidemark.llm.durable import cut
from tidemark.llm.frames import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(table(spark, sf_dir, "documents")))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tied = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return tied.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_pieces = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(spark, cut(cut_pieces))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {
    "op1_media_columns": op1_media_columns,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_secret_scans": op3_secret_scans,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_personal_data": op7_personal_data,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
}

#: Brute force in DuckDB, where its SQL can express the operator.
ORACLES: dict[str, str] = {
    "op6_embedding_dedup": """
        WITH RECURSIVE e AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93
        ), r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
    """,
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
        f AS (SELECT k, min(doc_id) AS m FROM g GROUP BY k),
        c AS (SELECT DISTINCT doc_id, p + o AS q FROM (SELECT doc_id, p FROM g JOIN f USING (k) WHERE m < doc_id), range(13) t(o)),
        x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d),
        s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, q) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
    """,
}
