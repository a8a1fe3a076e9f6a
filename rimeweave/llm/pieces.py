"""SentencePiece encoding and decoding by a table of distinct chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import map_arrow, slices

#: Chunks that a Python worker remembers; beyond that it starts its table afresh.
MOST_CHUNKS = 200_000
MARK = "▁"
#: A run of markers and what follows it up to the next one.
CHUNK = re.compile(" +[^ ]*")


class ChunkTable:
    """Ids of each distinct marked word, segmented once.

    No piece holds a marker after another character, so no merge crosses the start of a run of markers: the ids of a
    text are the ids of its chunks in order. The library adds one marker before each string it encodes, so a chunk is
    kept without its first marker.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("pieces of this model cross a whitespace marker")
        if self.model.encode("ﬁ  x ", out_type=str)[-1] != MARK or self.model.encode("ﬁ") == self.model.encode("fi"):
            raise ValueError("this model normalises text")
        self.ids: dict[str, bytes] = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        text = text.replace(MARK, " ")
        found = text.split(" ")
        return [chunk[1:] for chunk in CHUNK.findall(" " + text)] if "" in found else found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed 32-bit integers."""
        cut = [self.chunks(text) if text else [] for text in texts]
        if len(self.ids) > MOST_CHUNKS:
            self.ids = {}
        new = list(set().union(*cut).difference(self.ids))
        packed = [np.array(ids, np.int32).tobytes() for ids in self.model.encode(new, num_threads=1)]
        self.ids.update(zip(new, packed))
        if "" in self.ids:  # a single marker at the end of a text
            self.ids[""] = np.array([self.model.piece_to_id(MARK)], np.int32).tobytes()
        ids_of = self.ids.__getitem__
        return [b"".join(map(ids_of, chunks)) for chunks in cut]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@lru_cache(maxsize=2)
def chunk_table(model_path: str) -> ChunkTable:
    return ChunkTable(model_path)


def _mapped(df: DataFrame, source: str, added: list[T.StructField], work: Callable, path: str) -> DataFrame:
    """`df` with columns that `work` makes, slice by slice; input columns of the same names are replaced."""
    names = [field.name for field in added]
    passed = [c for c in df.columns if c not in names]
    frame = df.select(*(F.col(f"`{c}`") for c in passed), F.col(f"`{source}`").alias("_source"))
    schema = T.StructType([*frame.drop("_source").schema.fields, *added])
    return map_arrow(frame, partial(_run, work, path, names), schema)


def _run(work: Callable, path: str, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_source"):
        passed = [c for c in part.schema.names if c != "_source"]
        made = work(path, part.column("_source"))[: len(names)]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), *made], [*passed, *names])


def _packed(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, packed)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _encoded(path: str, texts: pa.Array) -> list[pa.Array]:
    return [_packed(chunk_table(path).encode([text or "" for text in texts.to_pylist()]))]


def _both(path: str, texts: pa.Array) -> list[pa.Array]:
    table = chunk_table(path)
    packed = table.encode([text or "" for text in texts.to_pylist()])
    return [_packed(packed), pa.array([table.decode(np.frombuffer(one, np.int32).tolist()) if one else "" for one in packed], pa.string())]


def _decoded(path: str, ids: pa.Array) -> list[pa.Array]:
    table = chunk_table(path)
    return [pa.array([table.decode(one.as_py()) if one.is_valid and len(one) else "" for one in ids], pa.string())]


IDS, DECODED = T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())


def encode_pieces(df: DataFrame, model_path: str, text_column: str = "text", decode: bool = False) -> DataFrame:
    """Add `ids` (array of int), what the library's encode() gives for each whole text, without begin or end ids.

    `decode` adds `decoded` as well, from the ids of the same pass. Missing and empty texts have no ids. Very long
    texts, repeated rows and empty tables need no special care; columns of the input with these names are replaced.
    """
    if decode:
        return _mapped(df, text_column, [IDS, DECODED], _both, model_path)
    return _mapped(df, text_column, [IDS], _encoded, model_path)


def decode_pieces(df: DataFrame, model_path: str, ids_column: str = "ids") -> DataFrame:
    """Add `decoded`, the text that the library's decode() gives for the ids; missing ids give an empty text."""
    return _mapped(df, ids_column, [DECODED], _decoded, model_path)


def digests(encoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Number and SHA-256 of the ids, and SHA-256 of the decoded text, of each row."""
    return encoded.select(
        F.col(id_column), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
