"""Substring deduplication: repeated paragraphs by MinHash banding, and verbatim passages inside paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import attach, map_arrow, slices, texts_of, written
from .blocks import block_links
from .darts import SIMILARITY
from .links import classes
from .shingles import SHINGLE, U64, mix, powers, weighted_sets, word_hashes

#: Words that a paragraph or a verbatim passage has at least.
PASSAGE = 24
#: An anchor is the smallest hash of so many places in a row, so two texts that share 47 words share a passage.
ANCHORS = 24
#: Paragraphs or passages of a task that are folded together before rows leave it.
HELD = 200_000
#: At a similarity of 0.8 two paragraphs meet in at least one of 10 bands of 4 with a probability of 99.5 %.
BANDS, ROWS = 10, 4
WORD = re.compile(r"[^ \t-\r]+")
SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64))


def sums(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each run of words."""
    if not len(starts):
        return np.zeros(0, U64)
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.repeat(starts, lengths) + inside
    weighted = words[at] * powers(0xD6E8FEB86659FD93, int(lengths.max()))[inside]
    return mix(np.add.reduceat(weighted, np.cumsum(lengths) - lengths) + lengths.astype(U64))


def runs_of_lines(line_words: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """(first line, line after the last, words) of each paragraph of a text, from the words of its lines.

    A line of `PASSAGE` words or more is one. Shorter lines in a row are joined, from the first of them on, until they
    have as many; what is left before the next long line joins the last of them. Fewer words than that are none.
    """
    open_, words, last = 0, 0, None
    for at, n in enumerate([*line_words, None]):
        if n is None or n >= PASSAGE:
            if last is not None:
                yield last[0], at, last[2] + words
            if n is not None:
                yield at, at + 1, n
            open_, words, last = at + 1, 0, None
            continue
        words += n
        if words >= PASSAGE:
            if last is not None:
                yield last
            last, open_, words = (open_, at + 1, words), at + 1, 0


def paragraphs(texts: list[str], firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of each paragraph."""
    found = []
    for at, text in enumerate(texts):
        sizes = [len(line.split()) for line in text.encode("utf-8", "replace").split(b"\n")]
        places = np.concatenate([[0], np.cumsum(sizes)]) + int(firsts[at])
        found += [(at, int(places[start]), n) for start, _, n in runs_of_lines(sizes)]
    columns = np.array(found, np.int64).reshape(-1, 3)
    return columns[:, 0], columns[:, 1], columns[:, 2]


def bands(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Band keys of the shingles of each run of words."""
    counts = lengths - SHINGLE + 1
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(starts, counts) + inside
    weights, hashes = powers(0xA24BAED4963EE407, SHINGLE), np.zeros(len(at), U64)
    for k in range(SHINGLE):
        hashes += words[at + k] * weights[k]
    edges, keys = np.cumsum(counts) - counts, np.zeros((len(starts), BANDS), U64)
    for at, seed in enumerate(SEEDS):
        least = np.minimum.reduceat(mix(hashes ^ seed), edges)
        keys[:, at // ROWS] = mix(keys[:, at // ROWS] + least + U64(at))
    return keys


def anchors(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Places in all texts where a verbatim passage is taken, chosen by the words around them alone."""
    if len(words) < ANCHORS + 1:
        return np.zeros(0, np.int64)
    marks = mix(words[:-1] + mix(words[1:]))
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    runs = np.lib.stride_tricks.sliding_window_view(marks, ANCHORS)
    chosen = np.arange(len(runs)) + runs.argmin(axis=1)
    chosen = chosen[owner[: len(runs)] == owner[ANCHORS : ANCHORS + len(runs)]]
    chosen = np.unique(chosen)
    return chosen[chosen + PASSAGE <= firsts[1:][owner[chosen]]]


def _paragraph_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs of each text. Of the first place of a content `keys` and `near` are set, else NULL.

    Contents that share a band key within `HELD` paragraphs are tied at once: `near` names the smallest content of each
    such key, and only that one keeps the key. So a key that very many contents share leaves few rows.
    """
    held: list[tuple] = []

    def tied() -> pa.RecordBatch:
        ids = pa.concat_arrays([one[0] for one in held])
        word, length, content, keys = (np.concatenate([one[at] for one in held]) for at in range(1, 5))
        kinds, lead = np.unique(content, return_index=True)
        key, node = keys[lead].ravel(), np.repeat(np.arange(len(kinds)), BANDS)
        order = np.lexsort((node, key))
        top = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        least = np.empty(len(key), np.int64)
        least[order] = node[order][np.maximum.accumulate(np.where(top, np.arange(len(key)), 0))]
        kept = least == node
        pairs = np.unique(np.stack([node[~kept], least[~kept]]), axis=1)

        def lists(owner: np.ndarray, values: np.ndarray) -> pa.Array:
            counts = np.zeros(len(content), np.int64)
            counts[lead] = np.bincount(owner, minlength=len(kinds))
            by_row = np.argsort(lead[owner], kind="stable")
            edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(edges), pa.array(values[by_row]))

        columns = [ids, pa.array(word), pa.array(length), pa.array(content)]
        columns += [lists(node[kept], key[kept]), lists(pairs[0], kinds[pairs[1]])]
        return pa.RecordBatch.from_arrays(columns, ["id", "word", "length", "content", "keys", "near"])

    for part in slices(batches, "text"):
        texts = texts_of(part, "text")
        words, firsts = word_hashes(texts)
        owner, starts, lengths = paragraphs(texts, firsts)
        if not len(owner):
            continue
        content = sums(words, starts, lengths).view(np.int64)
        held.append((
            part.column("id").take(pa.array(owner)), (starts - firsts[owner]).astype(np.int32), lengths.astype(np.int32), content,
            bands(words, starts, lengths).view(np.int64),
        ))
        if sum(len(one[3]) for one in held) >= HELD:
            yield tied()
            held = []
    if held:
        yield tied()


def _key_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and node: a tie from each node of a key to the first one."""
    key, least = None, 0
    for batch in batches:
        keys, nodes = (batch.column(c).to_numpy() for c in ("key", "node"))
        if not len(keys):
            continue
        top = np.concatenate([[keys[0] != key if key is not None else True], keys[1:] != keys[:-1]])
        lead = np.maximum.accumulate(np.where(top, np.arange(len(keys)), -1))
        first = np.where(lead < 0, least, nodes[np.maximum(lead, 0)])
        key, least = keys[-1], first[-1]
        tied = first != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(first[tied])], ["a", "b"])


def _passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of each text. Of `HELD` passages and a content the first place stands for all; the others name it in `first`."""
    held: list[tuple] = []

    def led() -> pa.RecordBatch:
        ids = pa.concat_arrays([one[0] for one in held])
        word, content = (np.concatenate([one[at] for one in held]) for at in (1, 2))
        rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
        order = np.lexsort((word, rank, content))
        content, word, ids = content[order], word[order], ids.take(pa.array(order))
        lead = np.concatenate([[True], content[1:] != content[:-1]])
        edges = np.flatnonzero(lead)
        counts = np.diff(np.concatenate([edges, [len(content)]]))
        leader = np.repeat(edges, counts)
        n = np.where(lead, np.repeat(counts, counts), 0)
        # the others travel by a key of their own
        key = np.where(lead, content, mix(content + np.arange(len(content), dtype=U64) * U64(2) + U64(1)))
        return pa.RecordBatch.from_arrays(
            [
                ids, pa.array(word.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int32)),
                ids.take(pa.array(leader, mask=lead)), pa.array(word[leader].astype(np.int32), mask=lead),
            ],
            ["id", "word", "key", "n", "first_id", "first_word"],
        )

    for part in slices(batches, "text"):
        words, firsts = word_hashes(texts_of(part, "text"))
        at = anchors(words, firsts)
        if not len(at):
            continue
        owner = np.searchsorted(firsts, at, side="right") - 1
        held.append((part.column("id").take(pa.array(owner)), at - firsts[owner], sums(words, at, np.full(len(at), PASSAGE))))
        if sum(len(one[1]) for one in held) >= HELD:
            yield led()
            held = []
    if held:
        yield led()


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paragraphs of a text that start at the given words."""
    for part in slices(batches, "text"):
        ids, found = [], []
        for text, wanted in zip(texts_of(part, "text"), part.column("wanted").to_pylist()):
            by_word = {one["word"]: one["content"] for one in wanted}
            lines = text.split("\n")
            sizes = [len(WORD.findall(line)) for line in lines]
            places = np.concatenate([[0], np.cumsum(sizes)])
            for start, stop, _ in runs_of_lines(sizes):
                if places[start] in by_word:
                    ids.append(by_word[places[start]])
                    found.append("\n".join(lines[start:stop]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["id", "text"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the `ANCHORS` words before (nearest first) and after the passages that start at the given words."""
    for part in slices(batches, "text"):
        words, firsts = word_hashes(texts_of(part, "text"))
        words, wanted = words.view(np.int64), part.column("wanted").to_pylist()
        rows = [(at, word) for at, places in enumerate(wanted) for word in places]
        before, after = [], []
        for at, word in rows:
            place = firsts[at] + word
            before.append(words[max(firsts[at], place - ANCHORS) : place][::-1])
            after.append(words[place + PASSAGE : min(firsts[at + 1], place + PASSAGE + ANCHORS)])
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                part.column("id").take(pa.array([at for at, _ in rows], pa.int64())), pa.array([word for _, word in rows], pa.int32()),
                pa.array(before, longs), pa.array(after, longs),
            ],
            ["id", "word", "before", "after"],
        )


def shingle_sets(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    return weighted_sets(texts)[:2]


def repeated_paragraphs(texts: DataFrame, threshold: float) -> DataFrame:
    """(id, word, length, first, n) of paragraphs in classes of two or more; `first` is the first place (id, word).

    Equal paragraphs are one content. Contents that bands connect are compared by their exact shingle sets, in blocks;
    links make classes.
    """
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        texts.schema["id"], T.StructField("word", T.IntegerType()), T.StructField("length", T.IntegerType()),
        T.StructField("content", T.LongType()), T.StructField("keys", longs), T.StructField("near", longs),
    ])
    rows = written(map_arrow(texts, _paragraph_rows, schema), "paragraphs")
    total = max(1, rows.count())
    buckets = rows.select(F.explode("keys").alias("key"), F.col("content").alias("node"))
    runs = map_arrow(buckets.repartition("key").sortWithinPartitions("key", "node"), _key_runs, "a long, b long")
    near = runs.unionAll(rows.select(F.col("content").alias("a"), F.explode("near").alias("b")))
    near = written(near.distinct(), "near")
    met = near.select(F.explode(F.array("a", "b")).alias("content")).distinct()
    contents = rows.groupBy("content").agg(
        F.min("id").alias("id"), F.min_by("word", F.struct("id", "word")).alias("word"),
        F.min_by("length", F.struct("id", "word")).alias("length"), F.count("*").alias("n"),
    )
    contents = written(contents, "contents")
    met = written(contents.join(met, "content"), "met")
    wanted = met.groupBy("id").agg(F.collect_list(F.struct("word", "content")).alias("wanted"))
    lines = map_arrow(texts.join(wanted, "id").select("text", "wanted"), _lines, "id long, text string")
    none = F.lit(None).cast("long")
    compared = met.select(
        F.col("content").cast("string").alias("key"), F.col("content").alias("node"), F.col("content").alias("id"),
        F.col("length").cast("long").alias("n"), none.alias("c1"), none.alias("c2"),
    )
    links = block_links(compared, lines, near, shingle_sets, Fraction(str(threshold)))
    found = classes(links.select("a", "b")).select(F.col("id").cast("long").alias("id"), F.col("class").cast("long").alias("class"))

    classed = contents.join(found.withColumnRenamed("id", "_id"), F.col("content") == F.col("_id"), "left")
    classed = classed.select("content", "n", F.coalesce("class", "content").alias("class"))
    # tables between the steps: each `attach` takes its table twice and plans would multiply
    classed = written(classed, "classed")
    placed = written(attach(rows.drop("keys", "near"), classed, "content", "n", total, "id").select("id", "word", "length", "class"), "placed")
    firsts = placed.groupBy("class").agg(F.min(F.struct("id", "word")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    placed = attach(placed, firsts, "class", "n", total, "id").filter("first is not null")
    return placed.select("id", "word", "length", "first", "n")


def repeated_passages(texts: DataFrame) -> DataFrame:
    """The same for verbatim passages: one shuffle of a few numbers per passage.

    Of every `HELD` passages one row per content is sent with its count, so a passage that very many texts share is few rows.
    """
    kind = texts.schema["id"].dataType
    schema = T.StructType([
        texts.schema["id"], T.StructField("word", T.IntegerType()), T.StructField("key", T.LongType()),
        T.StructField("n", T.IntegerType()), T.StructField("first_id", kind), T.StructField("first_word", T.IntegerType()),
    ])
    rows = map_arrow(texts, _passage_rows, schema)
    same = Window.partitionBy("key")
    leads = F.col("n") > 0
    rows = rows.withColumn("all", F.sum("n").over(same)).withColumn(
        "least", F.min(F.when(leads, F.struct("id", "word"))).over(same)
    )
    repeated = written(rows.filter(~leads | (F.col("all") > 1)).drop("key", "all"), "passages")
    heads = repeated.filter(leads).select("id", "word", F.col("least").alias("first"))
    of = heads.select(F.col("id").alias("first_id"), F.col("word").alias("first_word"), "first")
    others = repeated.filter(~leads).join(of, ["first_id", "first_word"])
    places = written(heads.unionByName(others.select("id", "word", "first")), "places")
    found = places.select("id", "word", F.lit(PASSAGE).alias("length"), "first")
    return found.unionByName(run_ends(texts, places))


def run_ends(texts: DataFrame, places: DataFrame) -> DataFrame:
    """What a shared run has before its first and after its last passage, at the place and at its first place.

    A run shows a passage at least every `ANCHORS` words, so less than that is missing at its ends. Only places at a gap
    ask for the words around them, and around their first place.
    """
    by_word = Window.partitionBy("id").orderBy("word")
    places = places.withColumn("gap_before", F.coalesce(F.lag("word").over(by_word) + PASSAGE < F.col("word"), F.lit(True)))
    places = places.withColumn("gap_after", F.coalesce(F.lead("word").over(by_word) > F.col("word") + PASSAGE, F.lit(True)))
    copy = (F.col("first.id") != F.col("id")) | (F.col("first.word") != F.col("word"))
    of = F.concat_ws("/", F.col("first.id").cast("string"), "first.word")
    ends = written(places.filter(copy & (F.col("gap_before") | F.col("gap_after"))).withColumn("of", of), "ends")
    wanted = ends.select("id", "word").unionAll(ends.select("first.id", "first.word")).distinct()
    wanted = wanted.groupBy("id").agg(F.collect_list("word").alias("wanted"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        texts.schema["id"], T.StructField("word", T.IntegerType()), T.StructField("before", longs), T.StructField("after", longs),
    ])
    around = map_arrow(texts.join(wanted, "id").select("id", "text", "wanted"), _contexts, schema)
    around = written(around.dropDuplicates(["id", "word"]), "contexts")
    uses = ends.groupBy("of").agg(F.count("*").alias("n"))
    theirs = around.select(F.concat_ws("/", F.col("id").cast("string"), "word").alias("of"), F.col("before").alias("b"), F.col("after").alias("a"))
    met = attach(ends, theirs.join(uses, "of"), "of", "n", max(1, ends.count()), "id").join(around, ["id", "word"])

    def same(ours: str, other: str, gap: str) -> Column:
        """How many items at the start of both lists are equal."""
        differs = F.array_position(F.zip_with(ours, other, lambda x, y: x.eqNullSafe(y)), False)
        return F.when(F.col(gap), F.when(differs > 0, differs - 1).otherwise(F.size(ours))).otherwise(0).cast("int")

    met = met.select("id", "word", "first", same("before", "b", "gap_before").alias("left"), same("after", "a", "gap_after").alias("right"))
    # in one text a copy does not grow into its first place
    apart = F.greatest(F.col("word") - F.col("first.word") - PASSAGE, F.lit(0))
    met = met.withColumn("left", F.when(F.col("first.id") == F.col("id"), F.least("left", apart)).otherwise(F.col("left")))
    met = met.withColumn("length", F.col("left") + F.col("right") + PASSAGE).filter(F.col("length") > PASSAGE)
    first = F.struct(F.col("first.id").alias("id"), (F.col("first.word") - F.col("left")).alias("word")).alias("first")
    copies = written(met.select("id", (F.col("word") - F.col("left")).alias("word"), "length", first), "copies")
    return copies.unionByName(copies.select("first.id", "first.word", "length", "first").distinct())


SPAN = T.StructType([T.StructField("word", T.IntegerType()), T.StructField("length", T.IntegerType())])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, length) joined where they touch or overlap."""
    out: list[list[int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length - out[-1][0])
        else:
            out.append([start, length])
    return [tuple(span) for span in out]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_repeated", "n_removed", "removed", "copies_of"]
    for batch in batches:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("word", pa.int32()), ("length", pa.int32())])), pa.list_(batch.schema.field("id").type)]
        rows: list[list] = [[], [], [], []]
        for key, found in zip(batch.column("id").to_pylist(), batch.column("spans").to_pylist()):
            all_ = merged([(s["word"], s["length"]) for s in found])
            gone = merged([(s["word"], s["length"]) for s in found if (s["first"]["id"], s["first"]["word"]) != (key, s["word"])])
            rows[0].append(sum(length for _, length in all_))
            rows[1].append(sum(length for _, length in gone))
            rows[2].append([{"word": word, "length": length} for word, length in gone])
            rows[3].append(sorted({s["first"]["id"] for s in found} - {key}))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(r, k) for r, k in zip(rows, kinds))], ["id", *names])


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def find_repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per document: id, `n_repeated` and `n_removed` words, `removed` spans of words, `copies_of`, `text_hash`.

    A paragraph is a line of `PASSAGE` words or more, or shorter lines in a row with as many. Paragraphs with a Jaccard similarity of their five-word shingles
    of `threshold` or more are linked through MinHash bands, and classes of them are connected components. Verbatim
    passages are taken at places that the words around them choose, so that any 47 shared words in a row share one,
    wherever they stand in their lines, and extended as far as the words are those of the first place. Of each class, and of each passage, the first place (smallest id, then word)
    stays; the others are removed. `n_repeated` counts the words of places that stay as well; `copies_of` lists the
    documents with the first places, if they are others.

    Missing and empty texts and single short lines have nothing to repeat. Rows that repeat an id and its text are one
    document; of different texts with an id the one with the smallest `text_hash` is searched, the others have no
    removals. Rows without an id are left out of the search and have no removals. Very long texts need no special care;
    an empty table gives an empty table. Other columns are not read.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("text_hash", text_hash("text"))
    several = rows.filter("id is not null").groupBy("id").agg(F.min("text_hash").alias("searched"), F.max("text_hash").alias("most"))
    several = written(several.filter("searched != most").select(F.col("id").alias("_id"), "searched"), "several-texts")
    rows = rows.join(several, F.col("id") == F.col("_id"), "left").drop("_id")
    searched = F.col("id").isNotNull() & (F.col("searched").isNull() | (F.col("text_hash") == F.col("searched")))
    texts = rows.filter(searched).select("id", "text")
    lines = repeated_paragraphs(texts, threshold).select("id", "word", "length", "first")
    spans = lines.unionByName(repeated_passages(texts))
    spans = spans.groupBy("id").agg(F.collect_set(F.struct("word", "length", "first")).alias("spans"))
    schema = T.StructType([
        texts.schema["id"], T.StructField("n_repeated", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("removed", T.ArrayType(SPAN)), T.StructField("copies_of", T.ArrayType(texts.schema["id"].dataType)),
    ])
    summed = map_arrow(spans, _summed, schema).withColumnRenamed("id", "_id")
    all_ = rows.select("id", "text_hash", searched.alias("_searched"))
    all_ = all_.join(summed, (F.col("id") == F.col("_id")) & F.col("_searched"), "left")
    none = F.array()
    return all_.select(
        F.col("id").alias(id_column), F.coalesce("n_repeated", F.lit(0)).cast("long").alias("n_repeated"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", none.cast(schema["removed"].dataType)).alias("removed"),
        F.coalesce("copies_of", none.cast(schema["copies_of"].dataType)).alias("copies_of"), "text_hash",
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_text"):
        out = []
        for text, spans in zip(part.column("_text").to_pylist(), part.column("_removed").to_pylist()):
            if spans:
                places, kept, at = [m.span() for m in WORD.finditer(text)], [], 0
                for span in spans:
                    kept.append(text[at : places[span["word"]][0]])
                    at = places[span["word"] + span["length"] - 1][1]
                text = "".join([*kept, text[at:]])
            out.append(text)
        passed = [c for c in part.schema.names if c not in ("_text", "_removed")]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), pa.array(out, pa.string())], [*passed, "clean_text"])


def remove_repeats(df: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with `clean_text`: its text without the removed spans that `find_repeats` gave for its id and text."""
    spans = found.filter("n_removed > 0").select(
        F.col(id_column).alias("_id"), F.col("text_hash").alias("_hash"), F.col("removed").alias("_removed")
    ).dropDuplicates(["_id", "_hash"])
    passed = [F.col(f"`{c}`") for c in df.columns if c != "clean_text"]
    frame = df.select(*passed, F.col(f"`{text_column}`").alias("_text"), text_hash(text_column).alias("_text_hash"))
    frame = frame.join(spans, (F.col(f"`{id_column}`") == F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    frame = frame.drop("_id", "_hash", "_text_hash")
    schema = T.StructType([*frame.drop("_text", "_removed").schema.fields, T.StructField("clean_text", T.StringType())])
    return map_arrow(frame, _cut, schema)
