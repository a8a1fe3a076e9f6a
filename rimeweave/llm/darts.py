"""Near-duplicates by DartMinHash signatures of weighted shingle sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .blocks import block_links, set_hashes
from .common import attach, map_arrow, slices, texts_of, written
from .links import classes, is_first, stars
from .shingles import U64, mix, weighted_sets

#: At a similarity of 0.8 a pair meets in at least one of 25 bands of 6 with a probability of 99.95 %.
BANDS, ROWS = 25, 6
SIMILARITY = 0.8


def signatures(owners: np.ndarray, elements: np.ndarray, weights: np.ndarray, count: int, size: int) -> np.ndarray:
    """DartMinHash of `count` weighted sets: for each of `size` coordinates the earliest dart, as a hash.

    The region of an element is as wide as its weight. It is cut into cells of width one, and into each cell darts fall
    at a rate of one per unit of time, at times, places and coordinates that the hashed cell fixes. A dart that lies
    beyond the weight in the last cell misses. Two sets share the darts in the overlap of their regions, so they agree in a
    coordinate with a probability of their weighted Jaccard similarity. Sets without weight have zeros.
    """
    cells = np.ceil(weights).astype(np.int64)
    owner, element = np.repeat(owners, cells), np.repeat(elements, cells)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
    width = np.minimum(1.0, np.repeat(weights, cells) - within)
    cell = mix(element + within.astype(U64) * U64(0xA24BAED4963EE407))
    mass = np.bincount(owner, width, minlength=count)
    until = np.where(mass > 0, size * (np.log(size) + 3) / np.maximum(mass, 1e-12), 0.0)
    time, throws = np.zeros(len(cell)), np.zeros(len(cell), np.int64)
    best_time, best = np.full(count * size, np.inf), np.zeros(count * size, U64)

    def throw(at: np.ndarray) -> None:
        throws[at] += 1
        chance = mix(cell[at] + throws[at].astype(U64) * U64(0x9FB21C651E98DF25))
        time[at] -= np.log(((chance >> U64(11)).astype(np.float64) + 1) / (1 << 53))

    active = np.arange(len(cell))
    throw(active)
    while True:
        thrown = active[time[active] <= until[owner[active]]]
        while len(thrown):
            dart = mix(cell[thrown] ^ (throws[thrown].astype(U64) * U64(0xE7037ED1A0B428DB)))
            hits = ((mix(dart + U64(1)) >> U64(11)).astype(np.float64) / (1 << 53)) < width[thrown]
            slot = owner[thrown[hits]] * size + (mix(dart[hits] + U64(2)) % U64(size)).astype(np.int64)
            when, which = time[thrown[hits]], dart[hits]
            order = np.lexsort((which, when, slot))
            slot, when, which = slot[order], when[order], which[order]
            lead = np.concatenate([[True], np.diff(slot) != 0]) if len(slot) else np.zeros(0, bool)
            slot, when, which = slot[lead], when[lead], which[lead]
            earlier = when < best_time[slot]
            best_time[slot[earlier]], best[slot[earlier]] = when[earlier], which[earlier]
            throw(thrown)
            thrown = thrown[time[thrown] <= until[owner[thrown]]]
        missing = np.isinf(best_time.reshape(count, size)).any(axis=1) & (mass > 0)
        if not missing.any():
            return best.reshape(count, size)
        until[missing] *= 2
        active = np.flatnonzero(missing[owner])


def numbered(owners: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of (element, number) with one number for each time an element is in a weighted set.

    The Jaccard similarity of these sets is the weighted one of the counts.
    """
    times = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(owners, counts), mix(np.repeat(hashes, counts) + times.astype(U64) * U64(0x8CB92BA72F3D8DD7))


def numbered_sets(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    return numbered(*weighted_sets(texts))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: two hashes of its weighted set (NULL without shingles), its weight, and the keys of its bands."""
    for part in slices(batches, "text"):
        texts = texts_of(part, "text")
        owners, hashes, counts = weighted_sets(texts)
        signed = signatures(owners, hashes, counts.astype(np.float64), len(texts), BANDS * ROWS)
        keys = np.zeros((len(texts), BANDS), U64)
        for at in range(ROWS):
            keys = mix(keys + signed[:, at::ROWS] + U64(at))
        keys = mix(keys + np.arange(BANDS, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))
        owners, elements = numbered(owners, hashes, counts)
        sizes = np.bincount(owners, minlength=len(texts))
        sums = [pa.array(x, mask=sizes == 0) for x in set_hashes(owners, elements, len(texts))]
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([part.column("id"), *sums, pa.array(sizes), bands], ["id", "c1", "c2", "weight", "bands"])


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = SIMILARITY
) -> DataFrame:
    """Every row with `class_id`, `class_size`, `n_links` and `kept` of its class of near-duplicates.

    A document is the multiset of its five-word shingles over lower-cased words; a shorter one is one shingle. Documents
    with equal multisets are collapsed first. Documents that share a band of their DartMinHash signatures are compared
    exactly, and a weighted Jaccard similarity of `threshold` or more links them; classes are what links connect. The
    smallest id of a class is its id and stays. `n_links` counts verified links of the collapsed document.

    Missing, empty and blank texts have no shingles: such rows are alone in a class. Rows that repeat an id are one
    document and share its class; rows without an id are alone and stay. Very long texts need no special care; an
    empty table gives an empty table. Columns of the input with the names of added columns are replaced.
    """
    added = ("class_id", "class_size", "n_links", "kept")
    passed = [F.col(f"`{c}`") for c in df.columns if c not in added]
    texts = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter("id is not null")
    kind = texts.schema["id"].dataType.simpleString()
    signed = map_arrow(texts, _signed, f"id {kind}, c1 long, c2 long, weight long, bands array<long>")
    signed = written(signed.filter("c1 is not null"), "signatures")
    first = F.min(F.struct("id", "weight", "bands")).alias("first")
    contents = written(signed.groupBy("c1", "c2").agg(first, F.count("*").alias("copies")), "contents")
    contents = contents.select(
        "c1", "c2", "first.id", F.col("first.weight").alias("n"), "first.bands", "copies",
        F.concat_ws("/", "c1", "c2").alias("key"), F.col("c1").alias("node"),
    )
    buckets = contents.select("node", F.explode("bands").alias("key"))
    near = stars(buckets, BANDS * max(1, contents.count()))
    links = block_links(contents.drop("bands", "copies"), texts, near, numbered_sets, Fraction(str(threshold)))
    found = classes(links.select("a", "b")).select(F.col("id").alias("key"), F.col("class").alias("_class"))
    ends = links.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    classed = contents.select("key", "id", "copies").join(found, "key", "left").join(ends, "key", "left")
    # tables between the steps: each `attach` takes its table twice and plans would multiply
    classed = written(classed.withColumn("_class", F.coalesce("_class", "key")), "classed")
    least = classed.groupBy("_class").agg(F.min("id").alias("class"), F.count("*").alias("_members"))
    classed = attach(classed, least, "_class", "_members", max(1, classed.count()), "key").select(
        F.col("key").alias("_key"), "class", F.col("copies").alias("n"), "n_links"
    )
    classed = written(classed, "first-ids")
    key = F.concat_ws("/", "c1", "c2")
    total = max(1, signed.count())
    members = attach(signed.select("id", key.alias("_key")), classed, "_key", "n", total, "id")
    members = written(members.groupBy("id").agg(F.min("class").alias("class"), F.max("n_links").alias("n_links")), "classes-of-ids")
    sizes = members.groupBy("class").agg(F.count("*").alias("class_size"))
    members = attach(members, sizes, "class", "class_size", total, "id").select(
        F.col("id").alias("_id"), F.col("class").alias("class_id"), "class_size", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    members = written(members.filter("class_size > 1"), "members")
    id_ = F.col(f"`{id_column}`")
    met = df.filter(id_.isNotNull()).select(*passed).join(members, id_ == F.col("_id"), "left").select(
        *passed, F.coalesce("class_id", id_).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), is_first(id_, F.col("class_id")).alias("kept"),
    )
    alone = df.filter(id_.isNull()).select(
        *passed, id_.alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept")
    )
    return met.unionByName(alone)
