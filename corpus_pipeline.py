"""From raw documents to token ids: each stage works on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rimeweave.llm import darts, exact, pieces, suffixes, toxic
from rimeweave.llm.common import written
from rimeweave.llm.queries import tokenizer_path


def _kept(docs: DataFrame, decide: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """The documents for which the operator's condition holds. Other columns travel packed: their names cannot clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*rest, F.lit(0)).alias("_rest"))
    out = decide(packed).filter(keep)
    return out.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    model = toxic.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(docs, lambda packed: toxic.classify(packed, model), "predicted = 0")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _kept(docs, exact.exact_duplicates, "kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return _kept(docs, darts.near_duplicates, "kept")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _kept(docs, lambda packed: suffixes.find_contamination(packed, benchmark), "not contaminated")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the SentencePiece ids and of the text they decode to."""
    model = tokenizer_path("piece_bpe_32k.model")
    return pieces.digests(pieces.encode_pieces(docs.select("doc_id", "text"), model, decode=True))


STAGES = [
    ("toxicity", drop_toxic), ("exact dedup", exact_dedup), ("near dedup", near_dedup),
    ("decontamination", decontaminate), ("sentencepiece", encode),
]

#: Compression lengths and SentencePiece ids have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
