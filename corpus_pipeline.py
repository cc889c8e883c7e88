"""Corpus pipeline: documents to packed training sequences.

Five stages, each written as Parquet and read again as the next one's documents. Documents of a null id pass the filters: they
are in no group of copies. Rows that repeat an id are one document and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import staged
from tracelode.llm.packing import pack_documents
from tracelode.llm.secrets import find_secrets, redact
from tracelode.llm.shingles import near_copies
from tracelode.llm.suffix_dedup import deduplicate
from tracelode.llm.toxicity import THRESHOLD, score, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share four fifths of their shingles of so many words.
WORDS = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents, and keep those scored below the threshold."""
    model = train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs.select(*COLUMNS), model, "text", "__score").where(F.col("__score") < THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of copies."""
    found = near_copies(docs, size=WORDS)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove byte strings that occur elsewhere too, but no part of a character."""
    cut = deduplicate(docs, carry=("lang", "source"), whole_characters=True)
    return cut.withColumn("text", F.decode("kept", "UTF-8")).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mask in the place of every secret."""
    found = find_secrets(docs.select(*COLUMNS), "text", "__secrets")
    return found.withColumn("text", redact(F.col("text"), F.col("__secrets"))).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("suffix_array_dedup", cut_repeats), ("secret_scans", mask_secrets), ("best_fit_packing", pack)]
#: SQL cannot express the stages; the query is held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
