"""Blocked sparse products of documents by elements: overlap counts of all pairs of a block, inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SLICE_BYTES, attach, map_arrow, texts_of, written
from .exact import with_key_in
from .links import classes
from .shingles import U64, mix

#: Documents of a block, and elements of all its documents. Two blocks are in a task at once.
BLOCK_ROWS, BLOCK_ELEMENTS = 2048, 4_000_000
#: A row travels once per block of its class. A class of more than MANY blocks has blocks of up to WIDER times the rows.
MANY, WIDER = 8, 4
#: Rows of a strip of the product at most, cells of a strip, and cells of the dense piece that is multiplied at once.
STRIP, STRIP_CELLS, CELLS = 512, 2 << 20, 4_000_000

Sets = Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]]


def set_hashes(owners: np.ndarray, elements: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each of `count` sets."""
    sums = []
    for seed in (1, 2):
        total = np.zeros(count, U64)
        np.add.at(total, owners, mix(elements * U64(2 * seed + 1) + U64(seed)))
        sums.append(mix(total + np.bincount(owners, minlength=count).astype(U64)).view(np.int64))
    return sums[0], sums[1]


def roots(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """For each of `count` nodes the smallest one that the edges (a, b) connect it with."""
    low = np.arange(count)
    while True:
        least = np.minimum(low[a], low[b])
        after = low.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == low).all():
            return low
        low = after


def product_links(
    owners: np.ndarray, elements: np.ndarray, sides: np.ndarray, share: Fraction
) -> tuple[np.ndarray, np.ndarray]:
    """Root and number of links of each row of one block, or of two when `sides` has two values.

    The sets of all rows are an incidence matrix; its product with itself counts the elements that two rows share. Rows
    are taken by size, in strips: a strip meets only rows that are not too large for a Jaccard similarity of `share`.
    Elements of one row only are no columns. With two sides only pairs of different sides are linked.
    """
    count = len(sides)
    sizes = np.bincount(owners, minlength=count)
    by_size = np.argsort(sizes, kind="stable")
    place = np.empty(count, np.int64)
    place[by_size] = np.arange(count)
    sizes, sides = sizes[by_size], sides[by_size]
    crossed = bool((sides != sides[0]).any())
    _, column, found = np.unique(elements, return_inverse=True, return_counts=True)
    common = found[column] > 1
    row, column = place[owners[common]], column[common]
    order = np.lexsort((row, column))
    row, column = row[order], column[order]
    column = np.cumsum(np.concatenate([[0], np.diff(column) != 0])) if len(column) else column
    left, right, degree = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(count, np.int64)
    up, down = share.denominator, share.numerator
    columns = int(column[-1]) + 1 if len(column) else 0
    width = max(1, min(CELLS // count, columns))
    pieces = np.searchsorted(column, np.arange(0, columns + width, width))
    strip = max(1, min(STRIP, STRIP_CELLS // count))
    for start in range(0, count, strip):
        stop = min(count, start + strip)
        end = int(np.searchsorted(sizes, sizes[stop - 1] * up // down, "right"))
        shared = np.zeros((stop - start, end - start), np.float32)
        for at, (i, j) in enumerate(zip(pieces, pieces[1:])):
            here = (row[i:j] >= start) & (row[i:j] < end)
            if here.any():
                held = np.zeros((end - start, width), np.float32)
                held[row[i:j][here] - start, column[i:j][here] - at * width] = 1
                shared += held[: stop - start] @ held.T
        both = sizes[start:stop, None] + sizes[None, start:end]
        overlap = shared.astype(np.int64)
        linked = (overlap > 0) & (overlap * (up + down) >= both * down)
        if crossed:
            linked &= sides[start:stop, None] != sides[None, start:end]
        a, b = np.nonzero(linked)
        a, b = a[a < b] + start, b[a < b] + start
        degree += np.bincount(a, minlength=count) + np.bincount(b, minlength=count)
        root = roots(np.concatenate([left, a]), np.concatenate([right, b]), count)
        left = np.flatnonzero(root != np.arange(count))
        right = root[left]
    root = np.arange(count)
    root[left] = right
    return by_size[root[place]], degree[place]


def _linked(sets: Sets, share: Fraction, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by class and pair of blocks: for every linked row its root in the block and its number of links."""
    held: list[tuple] = []
    size, now, seen = 0, None, set()

    def multiplied() -> pa.RecordBatch:
        texts = [one[4] for one in held]
        owners, elements = sets(texts)
        hashes = zip(*(x.tolist() for x in set_hashes(owners, elements, len(texts))))
        right = np.array([one[2] is None or one[2:4] == found for one, found in zip(held, hashes)])
        begins = [at for at, one in enumerate(held) if not at or one[0] != held[at - 1][0]] + [len(held)]
        starts = np.searchsorted(owners, begins)
        keys, tops, links = [], [], []
        for (i, j), (e, f) in zip(zip(begins, begins[1:]), zip(starts, starts[1:])):
            fits = right[owners[e:f]]
            sides = np.array([one[5] for one in held[i:j]])
            root, degree = product_links(owners[e:f][fits] - i, elements[e:f][fits], sides, share)
            for at in np.flatnonzero(degree):
                keys.append(held[i + at][1])
                tops.append(held[i + root[at]][1])
                links.append(int(degree[at]))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(tops, pa.string()), pa.array(links, pa.int64())], ["a", "b", "n"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("class", "i", "j", "key", "c1", "c2", "block")]
        for class_, i, j, key, c1, c2, block, text in zip(*columns, texts_of(batch, "text")):
            if (class_, i, j) != now:
                if size > SLICE_BYTES:
                    yield multiplied()
                    held, size = [], 0
                now, seen = (class_, i, j), set()
            if (key, text) not in seen:
                seen.add((key, text))
                held.append((now, key, c1, c2, text, block))
                size += len(text)
    if held:
        yield multiplied()


def block_links(contents: DataFrame, texts: DataFrame, near: DataFrame, sets: Sets, share: Fraction) -> DataFrame:
    """Links (a, b, n) between contents whose sets have a Jaccard similarity of `share` or more, as stars.

    `contents` has a row (key, node, id, n, c1, c2) per distinct set: the two hashes of the set, a text key, the number
    that stands for it in `near`, the id of a row of `texts` (id, text) with this set, and its size; without hashes any
    text with the id will do. Other texts are left out by a filter before the join. `near` (a, b) connects nodes so that any two that can be linked are connected. What it connects is one class, cut into blocks of
    bounded size; every pair of blocks of a class is one product in one task. A row of the result says that `a` has `n`
    links in its product and is connected there with `b`, so its rows grow with contents and never with pairs.
    """
    found = classes(near).select(F.col("id").alias("node"), "class")
    known = written(contents.join(found, "node").select("class", "key", "id", "n", "c1", "c2"), "candidates")
    sized = known.groupBy("class").agg(F.count("*").alias("members"), F.sum("n").alias("elements")).filter("members > 1")
    total = max(1, known.count())
    met = attach(known, sized, "class", "members", total, "key").filter("members is not null")
    rows = F.greatest(F.least(F.ceil(F.col("members") / BLOCK_ROWS), F.lit(MANY)), F.ceil(F.col("members") / (WIDER * BLOCK_ROWS)))
    blocks = F.greatest(rows, F.ceil(F.col("elements") / BLOCK_ELEMENTS))
    met = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    met = met.select("class", "key", "id", "c1", "c2", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    met = met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    dealt = with_key_in(texts, "id", known, total).join(met, "id").select("class", "i", "j", "key", "c1", "c2", "block", "text")
    dealt = dealt.repartition("class", "i", "j").sortWithinPartitions("class", "i", "j")
    return written(map_arrow(dealt, partial(_linked, sets, share), "a string, b string, n long"), "links")
