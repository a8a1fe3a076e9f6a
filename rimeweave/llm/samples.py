"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import is_training, written

#: Bytes of text that a fit takes at most, besides its number of rows.
MOST_BYTES = 64 << 20


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, rows_per_class: dict[int, int],
    id_column: str = "doc_id", text_column: str = "text", most_bytes: int = MOST_BYTES,
) -> tuple[list[tuple[int, str]], float]:
    """Whole texts of training rows as (label, text), and the share of label 1 among all training labels.

    Of each class the ids with the smallest hashes are taken, so a repeated run takes the same rows. The sample ends
    where its texts reach `most_bytes`. Rows without id or label are ignored; of an id with several labels the largest
    counts. The share is NaN without any training label.
    """
    training = labels.select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("_label")).dropna()
    training = training.filter(is_training(F.col("_id"))).groupBy("_id").agg(F.max("_label").alias("_label"))
    training = training.withColumn("_order", F.xxhash64("_id"))
    counts = {row["_label"]: row["n"] for row in training.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for value, most in rows_per_class.items():
        part = training.filter(F.col("_label") == value).orderBy("_order", "_id").limit(most)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = documents.select(F.col(id_column).alias("_doc"), F.coalesce(text_column, F.lit("")).alias("_text"))
    met = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    sample = written(met.groupBy("_id", "_label", "_order").agg(F.min("_text").alias("_text")), "labelled")
    sizes = sample.select("_order", "_id", F.octet_length("_text").alias("size")).orderBy("_order", "_id").collect()
    held, last = 0, None
    for order, _, size in sizes:
        held += size
        if held > most_bytes:
            break
        last = order
    rows = [] if last is None else sample.filter(F.col("_order") <= last).orderBy("_order", "_id").select("_label", "_text").collect()
    total = sum(counts.values())
    return [(row["_label"], row["_text"]) for row in rows], counts.get(1, 0) / total if total else float("nan")
