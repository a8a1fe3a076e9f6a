"""Benchmark decontamination with suffix arrays over the training texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import map_arrow, slices, texts_of

#: Words in a window; a shorter item is one window.
WINDOW = 10
#: Text of test items that is broadcast at once. More items are searched block after block.
BLOCK_BYTES = 8 << 20
#: fixed values: word characters are digits, ASCII letters (lower-cased) and everything beyond ASCII
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
MATCH = T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()),
    T.StructField("word", T.IntegerType()), T.StructField("length", T.IntegerType()),
])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class TestItems:
    """Words of the items as numbers from 1 (0 is any other word), and the suffixes to search for."""

    __test__ = False

    def __init__(self, items: Sequence[tuple[str, str]]):
        self.ids = [key for key, _ in items]
        words = [words_of(text) for _, text in items]
        self.vocabulary = {word: at for at, word in enumerate(sorted(set().union(*words)), 1)}
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.per_key = min(WINDOW, 63 // self.bits)
        item, place, size, rows = [], [], [], []
        for at, found in enumerate(words):
            numbers = [self.vocabulary[word] for word in found]
            length = min(WINDOW, len(numbers))
            for start in range(len(numbers) - length + 1 if numbers else 0):
                item.append(at)
                place.append(start)
                size.append(length)
                rows.append(numbers[start : start + length])
        self.item, self.place, self.size = (np.array(x, np.int64) for x in (item, place, size))
        self.shortest = int(self.size.min()) if len(item) else 0
        least, most = np.zeros((len(rows), WINDOW), np.int64), np.full((len(rows), WINDOW), (1 << self.bits) - 1)
        for at, row in enumerate(rows):
            least[at, : len(row)] = most[at, : len(row)] = row
        self.least, self.most = self.keys(least), self.keys(most)

    def keys(self, rows: np.ndarray) -> list[np.ndarray]:
        """Rows of word numbers packed into as few integers as possible, in the same order."""
        keys = []
        for start in range(0, WINDOW, self.per_key):
            key = np.zeros(len(rows), np.int64)
            for at in range(start, min(WINDOW, start + self.per_key)):
                key = key << self.bits | rows[:, at]
            keys.append(key)
        return keys


def bound(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of all wanted keys at once: first suffix that is not less (or is greater, with `after`)."""
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]))
    while (low < high).any():
        middle = np.minimum((low + high) // 2, len(keys[0]) - 1)
        less = np.full(len(low), after)
        for key, want in zip(reversed(keys), reversed(wanted)):
            less = (key[middle] < want) | ((key[middle] == want) & less)
        less &= low < high
        low, high = np.where(less, middle + 1, low), np.where(less | (low >= high), high, middle)
    return low


def search(numbers: np.ndarray, items: TestItems) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a shard and the test suffixes that occur there, through the suffix array of the shard.

    A suffix that meets an unknown word before the shortest window ends cannot match, so it is not in the array.
    """
    known = np.concatenate([numbers > 0, np.zeros(1, bool)])
    stops = np.flatnonzero(~known)
    run = stops[np.searchsorted(stops, np.arange(len(numbers)))] - np.arange(len(numbers))
    suffixes = np.flatnonzero(run >= max(1, items.shortest))
    padded = np.concatenate([numbers, np.zeros(WINDOW, np.int64)])
    keys = items.keys(padded[suffixes[:, None] + np.arange(WINDOW)])
    order = np.lexsort(keys[::-1])
    suffixes, keys = suffixes[order], [key[order] for key in keys]
    if not len(suffixes):
        return suffixes, suffixes
    first, last = bound(keys, items.least, False), bound(keys, items.most, True)
    counts = last - first
    which = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return suffixes[first[which] + inside], which


def longest(at: np.ndarray, which: np.ndarray, items: TestItems) -> list[tuple[int, int, int, int]]:
    """Windows that follow each other in text and item, joined: (position, item, word in the item, length)."""
    item, place = items.item[which], items.place[which]
    order = np.lexsort((at, at - place, item))
    at, item, place, size = at[order], item[order], place[order], items.size[which][order]
    if not len(at):
        return []
    joined = (np.diff(item) == 0) & (np.diff(at - place) == 0) & (np.diff(at) == 1)
    starts = np.flatnonzero(np.concatenate([[True], ~joined]))
    ends = np.concatenate([starts[1:], [len(at)]]) - 1
    return list(zip(*(x.tolist() for x in (at[starts], item[starts], place[starts], at[ends] + size[ends] - at[starts]))))


def _searched(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    items: TestItems = shared.value
    number = items.vocabulary.get
    for part in slices(batches, "_text"):
        words = [words_of(text) for text in texts_of(part, "_text")]
        counts = np.array([len(found) for found in words], np.int64)
        starts = np.cumsum(counts + 1) - counts - 1  # one word that matches nothing follows each text
        numbers = np.zeros(int((counts + 1).sum()), np.int64)
        for start, found in zip(starts, words):
            numbers[start : start + len(found)] = [number(word, 0) for word in found]
        matches = [list(old or []) for old in part.column("matches").to_pylist()]
        for at, item, place, length in longest(*search(numbers, items), items):
            row = int(np.searchsorted(starts, at, side="right")) - 1
            matches[row].append({"item_id": items.ids[item], "item_word": place, "word": int(at - starts[row]), "length": length})
        hit = []
        for found in matches:
            covered: set[int] = set()
            for match in found:
                covered.update(range(match["word"], match["word"] + match["length"]))
            hit.append(len(covered))
        made = {
            "matches": pa.array(matches, part.schema.field("matches").type), "n_words": pa.array(counts),
            "n_hit": pa.array(hit, pa.int64()),
        }
        yield pa.RecordBatch.from_arrays([made.get(c, part.column(c)) for c in part.schema.names], part.schema.names)


def find_contamination(
    df: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id",
    item_text_column: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Every row with `n_words`, `n_hit`, `items`, `contaminated`, and `matches`: where the longest verbatim matches lie.

    Each slice of training texts gets a suffix array over its words; every suffix of a test item is binary-searched in
    it for its first ten words (all of them, if the item has fewer), and occurrences that follow each other join into
    longest matches. Rows never shuffle. Test items are measured first and broadcast in blocks of a bounded size; each
    block is one more pass over the same rows. A single item larger than a block is a block of its own.

    Missing and empty texts have no words. Items without an id or without words are ignored; repeated items count once.
    Repeated rows, ties and very long texts need no special care; an empty table on either side finds nothing. Columns
    of the input with the names of added columns are replaced.
    """
    added = ("n_words", "n_hit", "items", "contaminated", "matches")
    passed = [c for c in df.columns if c not in added]
    tests = benchmark.select(F.col(item_column).cast("string").alias("id"), F.col(item_text_column).alias("text")).dropna()
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    frame = df.select(
        *(F.col(f"`{c}`") for c in passed), F.col(f"`{text_column}`").alias("_text"), F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"), F.array().cast(T.ArrayType(MATCH)).alias("matches"),
    )
    for block in range(blocks):
        rows = tests.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).distinct().orderBy("id", "text").collect()
        shared = df.sparkSession.sparkContext.broadcast(TestItems([tuple(row) for row in rows]))
        frame = map_arrow(frame, partial(_searched, shared), frame.schema)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return frame.select(
        *(F.col(f"`{c}`") for c in passed), "n_words", "n_hit", items.alias("items"),
        (F.col("n_hit") > 0).alias("contaminated"), "matches",
    )


def digest(items: Column) -> Column:
    """SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.concat_ws(",", items), 256)
