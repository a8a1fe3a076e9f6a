"""Token ids as length-delimited binary records with an offset index."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import map_arrow, slices, texts_of

#: Documents to a shard file.
DOCS_PER_SHARD = 4096
#: Bytes, about, of chunks that a Python worker remembers; beyond that it starts its table afresh.
MOST_CHUNK_BYTES = 128 << 20
#: Bytes of an entry besides its text and ids, and characters of a chunk that is not remembered.
ENTRY_BYTES, LONG_CHUNK = 200, 1000
# fixed values: constant and rotation that mask a checksum, as in common record files
MASK, TURN = 0xA282EAD8, 15
#: Totals of up to so many shards, a few bytes each, are broadcast; beyond that records meet them in a shuffle.
MOST_BROADCAST_SHARDS = 200_000
#: A record: length of the payload, checksum of the length, payload, checksum of the payload, line feed.
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")
#: A payload: document id, whether there is one, bytes per token id, then the ids, little-endian.
PAYLOAD = struct.Struct("<q?B")
INDEX_SCHEMA = "shard string, id long, offset long, length long, n_tokens long, tokens_before long"
#: A blank after one of these is the start of a new pre-token in any byte-level BPE, so it cannot be merged across.
NOT_SURE = re.compile(r" (?<![!-~A-Za-zÀ-ÖØ-öø-ɏ] )")
#: After letters these begin a pre-token of their own under the plain byte-level pattern (an apostrophe need not).
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def masked(data: bytes) -> int:
    """CRC-32 of the bytes, rotated and shifted, so that a checksum over checksums stays sound."""
    crc = zlib.crc32(data)
    return ((crc >> TURN | crc << (32 - TURN)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload)) + b"\n"


class Encoder:
    """Token ids of whole texts; a blank-separated chunk that comes again is not tokenized again.

    In byte-level BPE a pre-token takes at most one blank, its first character. So a text may be cut before a blank
    that follows a visible character. Where that is not plain from the character, the text is tokenized whole. Under
    the plain byte-level pattern a new chunk of letters with signs at its end is put together from both, so a word with
    other punctuation is not tokenized again. The table is bounded in bytes, and long chunks are not kept.
    """

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id) < 1 << 16 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        pieces = sorted(self.tokenizer.get_vocab().items(), key=lambda item: item[1])
        self.starts = np.zeros(pieces[-1][1] + 1, bool)  # tokens that begin with a blank
        self.starts[[at for piece, at in pieces if piece.startswith("Ġ")]] = True
        split = json.loads(self.tokenizer.to_str())
        split = (split.get("pre_tokenizer") or {}) if not split.get("normalizer") else {}
        self.fine = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, bytes] = {}  # of chunks with a blank before them
        self.tails: dict[str, bytes] = {}  # of pieces without one
        self.held = 0

    def _tokenized(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, self.kind).tobytes() for one in found]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Each chunk with a blank before it, tokenized as one text: a chunk starts where a token begins with a blank."""
        if not chunks:
            return []
        found = self.tokenizer.encode_batch_fast([" " + " ".join(chunks)], add_special_tokens=False)
        ids = np.array(found[0].ids, self.kind)
        at = np.flatnonzero(self.starts[ids])
        if len(at) != len(chunks) or at[0]:
            return self._tokenized([" " + chunk for chunk in chunks])
        packed, at = ids.tobytes(), (at * self.kind.itemsize).tolist()
        return [packed[i:j] for i, j in zip(at, [*at[1:], len(packed)])]

    def _keep(self, table: dict[str, bytes], keys: list[str], packed: list[bytes]) -> None:
        table.update(zip(keys, packed))
        self.held += ENTRY_BYTES * len(keys) + sum(map(len, keys)) + sum(map(len, packed))

    def _learn(self, new: set[str]) -> None:
        heads, several = new, []
        if self.fine:
            heads = set()
            for chunk in new:
                stem = chunk.rstrip(SIGNS)
                if stem is chunk or not stem.isalpha():
                    heads.add(chunk)
                else:
                    heads.add(stem)
                    several.append(chunk)
        wanted = list(heads.difference(self.ids))
        self._keep(self.ids, wanted, self._chunks(wanted))
        stems = [chunk.rstrip(SIGNS) for chunk in several]
        ends = [chunk[len(stem) :] for chunk, stem in zip(several, stems)]
        wanted = list(set(ends).difference(self.tails))
        self._keep(self.tails, wanted, self._tokenized(wanted))
        self._keep(self.ids, several, [self.ids[stem] + self.tails[end] for stem, end in zip(stems, ends)])

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > MOST_CHUNK_BYTES:
            self._forget()
        cut = [" " in text and not NOT_SURE.search(text + " ") for text in texts]
        chunks = pc.split_pattern(pa.array([t for t, c in zip(texts, cut) if c], pa.large_string()), " ")
        coded, edges = chunks.flatten().dictionary_encode(), chunks.offsets.to_pylist()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = set(known).difference(self.ids)
        self._learn(new)
        ids = pa.array(map(self.ids.__getitem__, known), pa.large_binary()).take(coded.indices)
        data, at = memoryview(ids.buffers()[2] or b""), np.frombuffer(ids.buffers()[1], np.int64)
        whole = [text if not c else text[: text.index(" ")] for text, c in zip(texts, cut)]
        heads = list(set(whole))
        first, packed, text_no = dict(zip(heads, self._tokenized(heads))), [], 0
        for head, c in zip(whole, cut):
            rest = data[at[edges[text_no] + 1] : at[edges[text_no + 1]]] if c else b""
            packed.append(b"".join((first[head], rest, self.end)))
            text_no += c
        if any(len(chunk) > LONG_CHUNK for chunk in new):
            for table in (self.ids, self.tails):
                for key in [key for key in table if len(key) > LONG_CHUNK]:
                    self.held -= ENTRY_BYTES + len(key) + len(table.pop(key))
        return packed


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def write_records(
    df: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text",
    docs_per_shard: int = DOCS_PER_SHARD,
) -> None:
    """Write each whole text as one record, in ascending id order over all shards, then the offset index.

    ``folder/data`` holds the shards, in the order of their names; ``folder/index`` a parquet row for each record:
    shard, id, offset and length of the record, tokens, and tokens of the same shard before it. The files come from
    Spark's writer and its commit protocol, so a lost executor leaves no part of a file behind; the index is read off
    the committed files.

    A missing text is empty: its record holds the end id alone. A missing id comes first and stays missing. Rows that
    repeat an id are all written, next to each other, ordered by text. An empty table gives no shard and an empty index.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    shards = max(1, -(-df.count() // docs_per_shard))
    ordered = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")

    framed = map_arrow(ordered, partial(_framed, tokenizer_path, end_id), "value binary")
    framed.select(F.col("value").cast("string")).write.option("compression", "none").text(f"{folder}/data")
    _scan(spark, folder, with_ids=False).write.parquet(f"{folder}/index")


def _framed(tokenizer_path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer_path, end_id)
    for batch in slices(batches, "text"):
        ids, packed = batch.column("id").to_pylist(), encode.encode(texts_of(batch, "text"))
        records = [frame(PAYLOAD.pack(i or 0, i is not None, encode.kind.itemsize) + p) for i, p in zip(ids, packed)]
        # the writer ends each row with the line feed
        yield pa.RecordBatch.from_arrays([pa.array([r[:-1] for r in records], pa.binary())], ["value"])


def parse(content: bytes) -> Iterator[tuple[int, int, int | None, int, memoryview]]:
    """Records of a shard: offset, length, id, bytes per token, packed ids. Raises ValueError on any damage."""
    view, at = memoryview(content), 0
    while at < len(view):
        if at + HEAD.size > len(view):
            raise ValueError(f"record at {at} is cut off")
        size, check = HEAD.unpack_from(view, at)
        start, end = at + HEAD.size, at + HEAD.size + size
        if masked(view[at : at + 8]) != check or end + TAIL.size + 1 > len(view):
            raise ValueError(f"record at {at} has a wrong length")
        payload = view[start:end]
        if masked(payload) != TAIL.unpack_from(view, end)[0] or view[end + TAIL.size] != 10:
            raise ValueError(f"record at {at} has a wrong checksum")
        key, has_key, width = PAYLOAD.unpack_from(payload)
        yield at, end + TAIL.size + 1 - at, key if has_key else None, width, payload[PAYLOAD.size :]
        at = end + TAIL.size + 1


def _scan(spark: SparkSession, folder: str, with_ids: bool) -> DataFrame:
    """A row per record of all shards; `with_ids` adds the token ids as packed little-endian 32-bit integers."""
    files = spark.read.format("binaryFile").load(f"{folder}/data").select("path", "content")
    return map_arrow(files, partial(_records, with_ids), INDEX_SCHEMA + ", ids binary" * with_ids)


def _records(with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in INDEX_SCHEMA.split(", ")]

    def batch(rows: list, ids: list) -> pa.RecordBatch:
        columns = [pa.array(c, pa.string() if n == "shard" else pa.int64()) for n, c in zip(names, zip(*rows))]
        packed = [pa.array(ids, pa.binary())] if with_ids else []
        return pa.RecordBatch.from_arrays([*columns, *packed], [*names, *["ids"] * with_ids])

    for files in batches:
        for at in range(files.num_rows):
            shard, before, rows, ids, held = files.column("path")[at].as_py().rpartition("/")[2], 0, [], [], 0
            for offset, length, key, width, packed in parse(files.column("content")[at].as_buffer()):
                n = len(packed) // width
                rows.append((shard, key, offset, length, n, before))
                before += n
                if with_ids:
                    ids.append(np.frombuffer(packed, f"<u{width}").astype("<u4").tobytes())
                    held += 4 * n
                if held > 8 << 20 or len(rows) > 50_000:
                    yield batch(rows, ids)
                    rows, ids, held = [], [], 0
            if rows:
                yield batch(rows, ids)


def shard_order(shard: str) -> list[Column]:
    """Order of shards: the number of the writer's task, then the name."""
    return [F.regexp_extract(shard, r"^part-(\d+)", 1).cast("long"), F.col(shard)]


def read_records(spark: SparkSession, folder: str, most_broadcast: int = MOST_BROADCAST_SHARDS) -> DataFrame:
    """All records with checked checksums: id, `start` (tokens of all records before), n_tokens, ids (packed 32-bit).

    One row per shard is summed up from the index and ordered by the number in its name (as text, 100000 would come
    before 99999). Shards are counted: up to `most_broadcast` their sums are broadcast, so no record leaves its task
    for `start`.
    """
    index = spark.read.parquet(f"{folder}/index")
    totals = index.groupBy(F.col("shard").alias("_shard")).agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy(*shard_order("_shard")).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if index.select("shard").distinct().count() <= most_broadcast:
        bases = F.broadcast(bases)
    records = _scan(spark, folder, with_ids=True)
    return records.join(bases, F.col("shard") == F.col("_shard")).select(
        "id", (F.col("base") + F.col("tokens_before")).alias("start"), "n_tokens", "ids", "shard", "offset", "length"
    )


def shuffled_read(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """Index rows in a random order that the seed fixes: the order in which a reader fetches records by offset."""
    return spark.read.parquet(f"{folder}/index").orderBy(F.xxhash64("shard", "offset", F.lit(seed)), "shard", "offset")
