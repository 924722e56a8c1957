"""A corpus-cleaning pipeline: each stage applies one corpus operator to what the stage before it kept.

Stages take any columns besides doc_id and text along. Null texts count as empty; they are neither toxic nor contaminated
and hold no secret, but are alike, so that one of them stays. Rows without a doc_id are judged by their text alone and never
taken for copies. Repeated rows are judged alike: they go or stay together. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import written
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.packing import pack
from tidemark.llm.secret_scan import redact
from tidemark.llm.simhash_dedup import keep_one_each
from tidemark.llm.tokens import default_tokenizer
from tidemark.llm.toxicity import drop_toxic, labelled, train


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go. The model learns from labelled documents, about 24,000 at most."""
    model = train(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a Jaccard similarity of 0.8 or more over five words stays: that with
    the smallest doc_id. Rows that repeat its doc_id stay with it."""
    return keep_one_each(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, exact or edited, go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, as token pieces placed in training sequences of 4096."""
    return pack(docs, default_tokenizer(), capacity=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic_documents),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_copies),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: Learned models and fuzzy alignment decide here, which SQL cannot express; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
