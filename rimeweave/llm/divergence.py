"""Which sources of a language use words differently: divergence of smoothed term shares, by a quadtree."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_arrow, slices, texts_of, written

#: fixed values: a term is a run of letters, with A-Z in lower case
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
#: Documents of a language that a kept term is in, parts of a whole share, and ranks of terms.
LEAST_DOCUMENTS, PARTS, TOP = 10, 1_000_000_000, 10
#: Terms and groups of a tile of the matrix. A node of the quadtree has SPLIT x SPLIT quadrants.
TILE_TERMS, TILE_GROUPS, SPLIT = 4096, 64, 2
#: Distinct (group, term) counts that a task gathers before it sends them on.
GATHERED = 400_000


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, documents) of a task's texts, added up as far as memory is bounded."""
    uses: dict[tuple, Counter] = defaultdict(Counter)
    documents: dict[tuple, Counter] = defaultdict(Counter)

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), held in uses.items():
            names, count = list(held), len(held)
            group = [pa.array([one], pa.string()).take(pa.array(np.zeros(count, np.int32))) for one in (lang, source)]
            in_documents = documents[lang, source]
            counts = [pa.array(list(held.values()), pa.int64()), pa.array([in_documents[name] for name in names], pa.int64())]
            yield pa.RecordBatch.from_arrays([*group, pa.array(names, pa.string()), *counts], ["lang", "source", "term", "n", "documents"])
        uses.clear()
        documents.clear()

    for batch in batches:
        for part in slices(iter([batch]), "text"):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts_of(part, "text")):
                terms = terms_of(text)
                if terms:
                    uses[lang, source].update(terms)
                    documents[lang, source].update(set(terms))
            if sum(map(len, uses.values())) > GATHERED:
                yield from sent()
    yield from sent()


def zero_tree(rows: np.ndarray, columns: np.ndarray, height: int) -> list[np.ndarray]:
    """The K-squared tree of the nonzero cells: for each level, leaves first, the sorted numbers of nonzero quadrants.

    At level v a quadrant is SPLIT^v cells wide; its number is row block times 2^32 plus column block.
    """
    levels = []
    for _ in range(height + 1):
        codes = np.unique((rows << 32) | columns)
        levels.append(codes)
        rows, columns = (codes >> 32) // SPLIT, (codes & 0xFFFFFFFF) // SPLIT
    return levels


def _has(level: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    codes = (rows << 32) | columns
    at = np.minimum(np.searchsorted(level, codes), max(0, len(level) - 1))
    return level[at] == codes if len(level) else np.zeros(len(codes), bool)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares of up to 1e9 + 1 parts keep it within a long."""
    return (p - q) * (p - q) // (p + q)


def tile_sums(
    rows: np.ndarray, columns: np.ndarray, shares: np.ndarray, zero: np.ndarray, width: int, left: np.ndarray, right: np.ndarray
) -> np.ndarray:
    """Sum of `gap` over the `width` terms of a tile for each pair of groups in `left` x `right`.

    `shares` are those of the nonzero cells (rows, columns); a group has its share `zero` everywhere else. The tree is
    walked for two groups at once, from the root: where both have an all-zero quadrant, its terms are priced together as
    their number times the gap of the two zero shares; else their quadrants are entered, down to single cells.
    """
    groups = len(zero)
    height = 0
    while SPLIT**height < max(groups, width):
        height += 1
    levels = zero_tree(rows, columns, height)
    order = np.argsort((rows << 32) | columns)
    cells, worth = levels[0], shares[order]
    total = np.zeros((groups, groups), np.int64)
    empty = np.zeros((groups, groups), np.int64)
    wanted = np.zeros((groups, groups), bool)
    wanted[np.ix_(left, right)] = True
    a = b = c = np.zeros(1, np.int64)
    for level in range(height, -1, -1):
        span = SPLIT**level
        some = _has(levels[level], a, c) | _has(levels[level], b, c)
        terms = np.clip(width - c[~some] * span, 0, span)
        high = -(-groups // span)
        blocks = np.zeros((high, high), np.int64)
        np.add.at(blocks, (a[~some], b[~some]), terms)
        empty += np.kron(blocks, np.ones((span, span), np.int64))[:groups, :groups] if span < groups else blocks[0, 0]
        a, b, c = a[some], b[some], c[some]
        if level:
            deeper = np.indices((SPLIT,) * 3).reshape(3, 1, -1)
            a, b, c = ((SPLIT * one[:, None] + step).ravel() for one, step in zip((a, b, c), deeper))
            span //= SPLIT
            high = -(-groups // span)
            inside = (a < high) & (b < high) & (c * span < width)
            a, b, c = a[inside], b[inside], c[inside]
            block = np.zeros((high, high), bool)
            i, j = np.nonzero(wanted)
            block[i // span, j // span] = True
            used = block[a, b]
            a, b, c = a[used], b[used], c[used]

    def share(of: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(cells, (of << 32) | c), len(cells) - 1) if len(cells) else 0
        return np.where(_has(cells, of, c), worth[at] if len(cells) else 0, zero[of])

    np.add.at(total, (a, b), gap(share(a), share(b)))
    total += empty * gap(zero[:, None], zero[None, :])
    return total[np.ix_(left, right)]


def _tiles(in_block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, i, j, tile): sums of gaps of all pairs of groups of blocks i and j, one row per pair and
    task as long as the blocks stay the same."""
    held: list[pa.RecordBatch] = []
    now = None
    sums: dict = {}

    def add() -> None:
        rows = pa.Table.from_batches(held)
        g, p, widths = (rows.column(c).to_numpy() for c in ("g", "p", "width"))
        heads = rows.column("term").is_null().to_numpy()
        by_number = np.flatnonzero(heads)[np.argsort(g[heads])]
        numbers = g[by_number]
        names = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        places = np.searchsorted(numbers, g[~heads])
        left, right = (np.flatnonzero(numbers // in_block == block) for block in now[1:3])
        columns = names[~heads].astype(np.int64)
        found = tile_sums(places, columns, p[~heads], p[by_number], int(widths[by_number[0]]), left, right)
        key = (*now[:3], tuple(numbers[left].tolist()), tuple(numbers[right].tolist()))
        sums[key] = sums.get(key, 0) + found

    def sent() -> pa.RecordBatch:
        rows = [
            (lang, a, b, int(v)) for (lang, i, j, left, right), found in sums.items()
            for a, line in zip(left, found) for b, v in zip(right, line) if a < b
        ]
        sums.clear()
        columns = list(zip(*rows)) if rows else [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["lang", "a", "b", "value"])

    for batch in batches:
        if not batch.num_rows:
            continue
        lang = batch.column("lang").dictionary_encode()
        marks = np.stack([lang.indices.to_numpy(zero_copy_only=False), *(batch.column(c).to_numpy() for c in ("i", "j", "tile"))])
        edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            key = (lang.dictionary[int(marks[0, start])].as_py(), *marks[1:, start].tolist())
            if held and key != now:
                add()
                held = []
                if key[:3] != now[:3] and len(sums) >= 16:
                    yield sent()
            now = key
            held.append(batch.slice(start, end - start))
    if held:
        add()
        yield sent()


def _share(count: str, total: str, kept: str) -> F.Column:
    """1 + floor(PARTS * (count + 2) / (total + 2 * kept)), exact; NULL without kept terms."""
    return F.expr(
        f"cast(1 + ({PARTS} * cast({count} + 2 as decimal(28,0))) div nullif(cast({total} + 2 * {kept} as decimal(28,0)), 0) as bigint)"
    )


def source_divergence(df: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how the sources of a language differ, and by which terms.

    A language keeps the terms that are in `least_documents` of its documents or more. Shares of a group are smoothed
    by two and counted in whole parts of 1e9. Part `pair` sums `gap` over all kept terms for each other source of the
    language; part `term` has the `top` terms that the group uses and that have a larger share there than in the language.

    The matrix of groups by kept terms is cut into tiles by a hash of the term and by blocks of groups; a tile is one
    K-squared tree in a task (`tile_sums`). Groups need not fit anywhere, but the result has a row per pair of sources.
    Missing texts, languages and sources are ''. Texts without terms make a group all the same; a language without kept
    terms has pairs of value 0 and no terms. Repeated rows count as often as they are there. Very long texts count
    whole; an empty table gives an empty table. Only text, lang and source are read.
    """
    rows = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = map_arrow(rows, _counted, "lang string, source string, term string, n long, documents long")
    counts = written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("documents").alias("documents"))
    terms = terms.filter(F.col("documents") >= least_documents).drop("documents")
    kept = written(counts.drop("documents").join(terms, ["lang", "term"]), "kept")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.countDistinct("term").alias("v"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "lang_total", "v"]).withColumn("one", F.lit(0))
    numbered = groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    numbered = numbered.withColumn("zero", _share("0", "total", "v")).drop("one")
    numbered = written(numbered.withColumn("groups", F.count("*").over(Window.partitionBy("lang"))), "groups")

    cells = kept.join(numbered, ["lang", "source"])
    cells = cells.withColumn("p", _share("n", "total", "v")).withColumn("q", _share("all_n", "lang_total", "v"))
    value = F.expr("(p - q) * (p - q) div (p + q)")
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    shown = cells.filter("p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))
    shown = shown.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    tiles = F.greatest(F.lit(1), F.ceil(F.col("v") / TILE_TERMS)).cast("long")
    last = F.floor((F.col("groups") - 1) / TILE_GROUPS).cast("long")
    own = F.floor(F.col("g") / TILE_GROUPS).cast("long")

    def with_blocks(df: DataFrame) -> DataFrame:
        """A row per pair of blocks that the row's group is in."""
        df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        return df.withColumn("i", F.least(own, "other")).withColumn("j", F.greatest(own, "other"))

    tile = F.pmod(F.xxhash64("term"), tiles)
    widths = kept.select("lang", "term").distinct().join(numbered.select("lang", "v").distinct(), "lang")
    widths = widths.groupBy("lang", tile.alias("tile")).agg(F.count("*").alias("width"))
    heads = with_blocks(numbered.filter("v > 0").join(widths, "lang")).select(
        "lang", "i", "j", "tile", "g", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), "width"
    )
    body = with_blocks(cells.withColumn("tile", tile)).select("lang", "i", "j", "tile", "g", "term", "p", F.lit(0).cast("long").alias("width"))
    dealt = heads.unionByName(body).repartition("lang", "i", "j", "tile").sortWithinPartitions("lang", "i", "j", "tile")
    sums = map_arrow(dealt, partial(_tiles, TILE_GROUPS), "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = numbered.select("lang", "source", "g")
    others = numbered.select("lang", F.col("source").alias("item"), F.col("g").alias("b"))
    pairs = names.withColumnRenamed("g", "a").join(others, "lang").filter("a != b").join(both, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(shown.withColumn("part", F.lit("term")).select(*columns))
