"""Toxicity by compression distance between two zstandard dictionaries."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .common import map_arrow, slices, texts_of
from .samples import labelled_sample

#: The bounded sample: rows of each class at most, and the part of them that calibrates.
SAMPLE_ROWS, CALIBRATES = {0: 8000, 1: 2000}, 4
#: Bytes of the ordinary dictionary and, at most, of the toxic one.
ORDINARY_BYTES, TOXIC_BYTES = 32 << 10, 16 << 10
#: Windows take whole words of about so many bytes; longer words are cut.
WINDOW, LONGEST = 48, 32
#: A byte sequence is typical of toxic text if in so many documents, and so many times likelier there.
GRAM, LEAST_DOCUMENTS, LEAST_RATIO = 5, 3, 20.0
#: Gains, in bytes a window, that are told apart.
GAINS = 12
THRESHOLD = 0.5
NO_WORD = re.compile(rb"[^0-9a-z\x80-\xff]+")


def words(text: str) -> bytes:
    """Lower-cased words with one blank around each."""
    return b" " + NO_WORD.sub(b" ", text.lower().encode()).strip() + b" "


def windows(text: str) -> list[bytes]:
    """All words of the text in order, cut at blanks into windows."""
    data, found, at = words(text), [], 0
    last = len(data) - 1 if data.strip() else 0
    while at < last:
        end = data.find(b" ", at + WINDOW, at + WINDOW + LONGEST)
        if end < 0:
            end = min(last, at + WINDOW + LONGEST)
        found.append(data[at : end + 1])
        at = end
    return found


@dataclass(frozen=True)
class ToxicityModel:
    """Two dictionaries and the weights that turn gains into a probability."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """With parameters that do not depend on the dictionary, so that lengths can be compared."""
    params = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=16, search_log=5, min_match=4, target_length=32,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False, write_checksum=False,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


@lru_cache(maxsize=2)
def _compressors(ordinary: bytes, toxic: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    """Ordinary text alone, and toxic before ordinary text. A filler keeps the distances of both equal."""
    return _compressor(bytes(len(toxic)) + ordinary), _compressor(toxic + ordinary)


def features(texts: Sequence[str], ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Per text: how many windows gain at least 1, 2, ... bytes, whether any does, and how many windows there are."""
    plain, both = _compressors(ordinary, toxic)
    cut = [windows(text) for text in texts]
    counts = np.zeros((len(texts), GAINS + 1))
    for row, found in enumerate(cut):
        for window in found:
            counts[row, min(GAINS, max(0, len(plain.compress(window)) - len(both.compress(window))))] += 1
    reached = counts[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
    total = np.log1p(counts.sum(axis=1, keepdims=True))
    return np.hstack([np.ones_like(total), np.log1p(reached), np.minimum(reached, 1), total])


def train_ordinary(texts: Sequence[str]) -> bytes:
    """A zstandard dictionary trained on ordinary text; plain text if there is too little to train on."""
    data = [words(text) for text in texts]
    samples = [one[at : at + 256] for one in data for at in range(0, len(one), 256)]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-ORDINARY_BYTES:] or b" "


def train_toxic(toxic: Sequence[str], ordinary: Sequence[str]) -> bytes:
    """The dictionary of toxic text: the parts of its words that are typical of it, the most frequent ones last.

    Trained without contrast, it would hold what both kinds of text share, and lengths would hardly differ.
    """

    def frequencies(texts: Sequence[str]) -> tuple[Counter, int]:
        found, size = Counter(), 0
        for text in texts:
            data = words(text)
            found.update(set(data.split()))
            size += len(data)
        return found, size

    def grams(word: bytes) -> list[bytes]:
        word = b" " + word[:256] + b" "
        return [word[at : at + GRAM] for at in range(len(word) - GRAM + 1)]

    (in_toxic, toxic_size), (in_ordinary, ordinary_size) = frequencies(toxic), frequencies(ordinary)
    seen: dict[bytes, list[int]] = {}
    for at, found in enumerate((in_toxic, in_ordinary)):
        for word, n in found.items():
            for gram in set(grams(word)):
                seen.setdefault(gram, [0, 0])[at] += n
    scale = toxic_size / max(1, ordinary_size)
    typical = {g for g, (t, o) in seen.items() if t >= LEAST_DOCUMENTS and t >= LEAST_RATIO * (o * scale + 0.25)}
    parts: Counter = Counter()
    for word, n in in_toxic.items():
        hit = [at for at, gram in enumerate(grams(word)) if gram in typical]
        if hit:
            parts[(b" " + word[:256] + b" ")[hit[0] : hit[-1] + GRAM]] += n
    ranked = sorted(((n, part) for part, n in parts.items() if n > 1), reverse=True)
    content = b""
    for _, part in ranked:
        if len(content) + len(part) > TOXIC_BYTES:
            break
        content = part + content
    return content


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps on scaled columns."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, beta = x / scale, np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge * beta)
        beta = beta + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return beta / scale


def fit(sample: Sequence[tuple[int, str]], share: float) -> ToxicityModel:
    """Dictionaries from three quarters of the sample, weights from the rest, for `share` of toxic documents.

    Without rows of both classes every score is the share (0.5 if that is unknown).
    """
    by = {label: [text for of, text in sample if of == label] for label in (0, 1)}
    base = min(max(0.5 if math.isnan(share) else share, 1e-6), 1 - 1e-6)
    blank = (math.log(base / (1 - base)), *([0.0] * (2 * GAINS + 1)))
    if min(len(by[0]), len(by[1])) < CALIBRATES:
        return ToxicityModel(b" ", b"", blank)
    held = {label: texts[::CALIBRATES] for label, texts in by.items()}
    learnt = {label: [t for at, t in enumerate(texts) if at % CALIBRATES] for label, texts in by.items()}
    ordinary, toxic = train_ordinary(learnt[0]), train_toxic(learnt[1], learnt[0])
    x = features(held[0] + held[1], ordinary, toxic)
    y = np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
    weight = np.where(y == 1, base * len(y) / len(held[1]), (1 - base) * len(y) / len(held[0]))
    return ToxicityModel(ordinary, toxic, tuple(logistic(x, y, weight)))


def _scored(model: ToxicityModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_text"):
        x = features(texts_of(part, "_text"), model.ordinary, model.toxic)
        score = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))
        passed = [c for c in part.schema.names if c != "_text"]
        columns = [*(part.column(c) for c in passed), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, [*passed, "score", "predicted"])


def classify(df: DataFrame, model: ToxicityModel, text_column: str = "text") -> DataFrame:
    """Every row with `score`, the probability of toxicity of the whole text, and `predicted` (1 from 0.5 on).

    Each window of a text is compressed with both dictionaries; the bytes that the toxic one saves decide. Missing and
    empty texts have no windows and score by the share alone. Very long words are cut into windows; repeated rows and
    empty tables need no special care; columns `score` and `predicted` of the input are replaced.
    """
    passed = [c for c in df.columns if c not in ("score", "predicted")]
    frame = df.select(*(F.col(f"`{c}`") for c in passed), F.col(f"`{text_column}`").alias("_text"))
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_arrow(frame, partial(_scored, model), T.StructType([*frame.drop("_text").schema.fields, *added]))


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicityModel:
    return fit(*labelled_sample(documents, labels, label, SAMPLE_ROWS))
