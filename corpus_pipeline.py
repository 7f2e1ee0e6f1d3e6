"""A training corpus from ``documents``: five stages, each over all that the one before it has kept.

1. toxicity: documents that the CRF scores at the threshold or over go;
2. near_dedup: of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays;
3. secrets: spans of secrets are replaced in the texts;
4. mixing: sources are drawn to their target weights. A document that is drawn several times is as many rows, and one
   that is drawn in part has the words drawn; rows lie by shard of the mix, in its order;
5. packing: the ids of the texts are packed into sequences, as the shards lie.

All but the last return the columns of documents (doc_id, text, lang, source, n_chars). n_chars follows a text that a stage has changed. Rows with nulls pass as
the operators say; a null or empty text stays through the first three stages, and is drawn 0 times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm.common import stored, table
from inkweave.llm.mixing import mixed_documents
from inkweave.llm.neardup import near_duplicates
from inkweave.llm.packing import pack_documents
from inkweave.llm.secrets import redacted
from inkweave.llm.tokens import vocabulary
from inkweave.llm.toxicity import drop_toxic

#: Words whose ids a worker keeps in packing, where op9_packing keeps 800,000: beside the other stages an executor has less room.
WORDS = 300_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat a doc_id are one document and go or stay together; rows without one stay."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.select(*COLUMNS).join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), words=WORDS)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
#: Trained models, sketches and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
