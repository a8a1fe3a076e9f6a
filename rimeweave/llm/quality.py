"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import map_arrow, slices, texts_of
from .samples import labelled_sample

#: The bounded sample: rows of each class at most. So many labelled vectors are broadcast.
SAMPLE_ROWS = {0: 2000, 1: 2000}
#: Columns of the term matrix (hashed byte trigrams) and of the latent space: with float32 the model has about 1.2 MB.
TERMS, LATENT = 2048, 48
NEIGHBOURS, SHARPNESS = 31, 4
#: Documents whose products with all labelled vectors are in memory at once.
BLOCK = 256
THRESHOLD = 0.3


def term_counts(texts: Sequence[str]) -> np.ndarray:
    """Byte trigrams of each whole text, hashed to columns and counted."""
    counts = np.zeros((len(texts), TERMS), np.float32)
    for row, text in enumerate(texts):
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        if len(data) > 2:
            trigrams = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
            columns = trigrams * np.uint32(2654435761) >> np.uint32(32 - int(math.log2(TERMS)))
            counts[row] = np.bincount(columns, minlength=TERMS)
    return counts


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class QualityModel:
    """Term weights, mean and latent axes, and the labelled vectors with their labels."""

    weights: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    importance: np.ndarray
    share: float

    def latent(self, texts: Sequence[str]) -> np.ndarray:
        return unit((unit(np.log1p(term_counts(texts)) * self.weights) - self.mean) @ self.axes)

    def score(self, texts: Sequence[str]) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each weighted by a power of its cosine.

        Both classes weigh the same in the whole sample, however many rows they have.
        """
        scores = np.full(len(texts), self.share)
        nearest = min(NEIGHBOURS, len(self.labels))
        for start in range(0, len(texts) if nearest else 0, BLOCK):
            cosines = self.latent(texts[start : start + BLOCK]) @ self.vectors.T
            at = np.argpartition(-cosines, nearest - 1, axis=1)[:, :nearest]
            vote = np.maximum(np.take_along_axis(cosines, at, axis=1), 0).astype(np.float64) ** SHARPNESS
            vote *= self.importance[at]
            total = vote.sum(axis=1)
            voted = (vote * self.labels[at]).sum(axis=1) / np.maximum(total, 1e-12)
            scores[start : start + BLOCK] = np.where(total > 1e-12, voted, self.share)
        return np.clip(scores, 0.0, 1.0)


def fit(sample: Sequence[tuple[int, str]], share: float) -> QualityModel:
    """Latent space by randomised singular value decomposition of the weighted term matrix of the sample."""
    texts, labels = [text for _, text in sample], np.array([label for label, _ in sample], np.float64)
    share = 0.5 if math.isnan(share) else share
    sizes = np.where(labels == 1, labels.sum(), (1 - labels).sum())
    importance = len(labels) / (2 * np.maximum(sizes, 1))
    counts = term_counts(texts)
    weights = (np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    rows = unit(np.log1p(counts) * weights)
    mean = rows.mean(axis=0) if len(rows) else np.zeros(TERMS, np.float32)
    rows = rows - mean
    axes = np.zeros((TERMS, LATENT), np.float32)
    if len(rows):
        random = np.random.default_rng(0)
        basis = rows @ random.normal(size=(TERMS, LATENT + 16)).astype(np.float32)
        for _ in range(4):
            basis, _ = np.linalg.qr(rows @ (rows.T @ basis))
        right = np.linalg.svd(basis.T @ rows, full_matrices=False)[2][:LATENT]
        axes[:, : len(right)] = right.T
    return QualityModel(weights, mean.astype(np.float32), axes, unit(rows @ axes).astype(np.float32), labels, importance, share)


def _scored(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_text"):
        score = model.value.score(texts_of(part, "_text"))
        passed = [c for c in part.schema.names if c != "_text"]
        columns = [*(part.column(c) for c in passed), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, [*passed, "score", "predicted"])


def classify(df: DataFrame, model: QualityModel, text_column: str = "text") -> DataFrame:
    """Every row with `score`, the vote for label 1 for the whole text, and `predicted` (1 from 0.3 on).

    The labelled vectors are broadcast; each document meets all of them in exact cosine products, block by block.
    Missing, empty and other texts without a term have no direction: without a vote they score by the share of label 1.
    Ties between neighbours at the same cosine may fall either way. Very long texts, repeated rows and empty tables
    need no special care; columns `score` and `predicted` of the input are replaced.
    """
    passed = [c for c in df.columns if c not in ("score", "predicted")]
    frame = df.select(*(F.col(f"`{c}`") for c in passed), F.col(f"`{text_column}`").alias("_text"))
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    shared = df.sparkSession.sparkContext.broadcast(model)
    return map_arrow(frame, partial(_scored, shared), T.StructType([*frame.drop("_text").schema.fields, *added]))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    return fit(*labelled_sample(documents, labels, label, SAMPLE_ROWS))
