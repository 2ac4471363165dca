"""From documents to packed sequences in five stages.

Each stage works on all that the one before it kept; what it returns is
written as Parquet and read again, so a stage begins by giving up what the one
before it held.  All but the last return the columns of documents.  Nulls, empty
and very long texts, repeated rows, ties, clashing columns and empty tables are
treated as the operator of each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import release, table, work_dir
from tidemark.llm.lexical_packing import pack_documents
from tidemark.llm.mixing import take_mix
from tidemark.llm.probminhash import keep_one
from tidemark.llm.quality_rules import keep_good
from tidemark.llm.substring_dedup import drop_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the quality rules; frequent lines are removed."""
    release()
    return keep_good(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    release()
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of passages that start earlier; others' texts stay as they are."""
    release()
    return drop_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents by the sources' target weights, repeats as repeated rows."""
    release()
    return take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; one row per piece."""
    import public_tokenizers

    release()
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near", near), ("repeats", repeats), ("mix", mix), ("pack", pack)]

#: Tokenizing and retrieval have no SQL; a test holds every stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
