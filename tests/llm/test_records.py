import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from rimeweave.llm import records
from rimeweave.llm.common import shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    None, "", " ", "  ", " a", "a ", "a  b", "a\n b", "a\u00a0 b", "a\u2003 b", "don't  stop 's", "x\x1c y", "<|endoftext|> a", "日本 語 x",
    "e\u0301 a", "1 234 5", "a\r\n\t b", "w" * 20_000, "the of " * 30_000, "€ x € y", "ß ə ʰ x",
]


@pytest.fixture(scope="module")
def tokenizer():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return made


def test_round_trip(spark, documents, tokenizer):
    rng = random.Random(3)
    texts = HARD + ["".join(rng.choice("ab  é\n'1,\u2003日") for _ in range(rng.randrange(30))) for _ in range(300)]
    pairs = [(key * 3 - 50, text) for key, text in enumerate(texts)] + [(7, "again"), (7, "again")]
    folder = shared_folder(spark, "records-test")
    records.write_records(documents(*pairs), folder, PATH, 2, docs_per_shard=50)
    rows = sorted(records.read_records(spark, folder).collect(), key=lambda r: r.start)
    assert sorted(records.read_records(spark, folder, most_broadcast=0).collect(), key=lambda r: r.start) == rows
    start = 0
    for row, (key, text) in zip(rows, sorted(pairs, key=lambda p: (p[0], p[1] or "")), strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.id, row.start, row.n_tokens) == (key, start, len(ids))
        assert row.ids == np.array(ids, "<u4").tobytes()
        start += len(ids)
    for row in rows[::40]:  # a record is where the index says
        path = f"{folder.removeprefix('file:')}/data/{row.shard}"
        with open(path, "rb") as shard:
            shard.seek(row.offset)
            assert next(iter(records.parse(shard.read(row.length))))[2] == row.id
    order = [r.id for r in records.shuffled_read(spark, folder, 5).collect()]
    assert sorted(order) == sorted(k for k, _ in pairs) and order != sorted(order)


def test_missing_id_and_empty_table(spark, documents):
    folder = shared_folder(spark, "records-test")
    records.write_records(documents((None, "a"), (3, "b")), folder, PATH, 2)
    assert [r.id for r in sorted(records.read_records(spark, folder).collect(), key=lambda r: r.start)] == [None, 3]
    folder = shared_folder(spark, "records-test")
    records.write_records(documents((1, "a")).limit(0), folder, PATH, 2)
    assert records.read_records(spark, folder).count() == 0


def test_damage_is_found():
    good = records.frame(b"x" * 40)
    assert zlib.crc32(good[:8]) != int.from_bytes(good[8:12], "little")
    for at in (0, 9, 20, len(good) - 3, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(records.parse(bytes(bad)))
    with pytest.raises(ValueError):
        list(records.parse(good[:-5]))


def test_shards_are_ordered_by_number(spark):
    names = ["part-00002-x.txt", "part-100000-x.txt", "part-99999-x.txt"]
    rows = spark.createDataFrame([(n,) for n in names], "shard string").orderBy(*records.shard_order("shard")).collect()
    assert [r.shard for r in rows] == [names[0], names[2], names[1]]


def test_chunk_table_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(records, "MOST_CHUNK_BYTES", 2_000)
    made = records.Encoder(PATH, 2)
    rng = random.Random(5)
    for turn in range(20):
        words = ["".join(rng.choice("abcé,.!\n'1_") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
        texts = [" ".join(words), "x" * 3000 + " " + "y" * 3000 + "!!", ""]
        got = made.encode(texts)
        assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u2").tobytes() for t in texts]
        assert all(len(chunk) <= records.LONG_CHUNK for chunk in made.ids) and len(made.ids) < 200
