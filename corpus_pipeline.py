"""The corpus pipeline: toxicity, near copies, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.  All but the last return the columns of documents; ``n_chars``
follows the text.  Between stages the rows are written as Parquet and read again, which cuts lineage and
leaves nothing to compute again when executors are lost.

Defined results: a null text is an empty one to every stage and stays null where a stage keeps its row; a null id never trains, and comes after all
others where ids decide; of equal texts, and of repeated rows, one row stays; texts of any length are handled whole; an empty table
gives an empty one; other columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import neardup, packing, secrets, substrings, toxicity
from tidemark.llm.durable import cut, stored
from tidemark.llm.frames import table

#: DuckDB can express none of the classifier, the near-duplicate search and the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.unrejected_rows(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id."""
    return neardup.one_of_each_group(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows that an earlier document has go from the text."""
    return measured(substrings.without_repeated(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret becomes a mark."""
    return measured(secrets.redacted_rows(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its tokens, its sequence and its place there."""
    return packing.pack(spark, cut(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
