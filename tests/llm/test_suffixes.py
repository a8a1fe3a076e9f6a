import random
import re

import pytest

from rimeweave.llm.suffixes import find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = set()
    for key, text in items:
        found = words(text)
        size = min(10, len(found))
        if key is not None and found:
            windows |= {(str(key), tuple(found[at : at + size])) for at in range(len(found) - size + 1)}
    out = []
    for key, text in docs:
        found, hit, met = words(text), set(), set()
        for item, window in windows:
            for at in range(len(found) - len(window) + 1):
                if tuple(found[at : at + len(window)]) == window:
                    hit.update(range(at, at + len(window)))
                    met.add(item)
        out.append((key, len(found), len(hit), sorted(met), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_against_brute_force(spark, documents, block_bytes):
    rng = random.Random(7)
    vocabulary = ["a", "B", "c9", "é", "Ärger", "x-y", "日本"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, line(rng.choice([12, 15, 30]))) for k in range(12)] + [(20, "short Item"), (21, "one"), (22, ""), (23, None), (None, "b")]
    items += items[:2]
    docs = [(k, line(60) + " " + rng.choice(items[:12])[1].upper() + "," + line(5)) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "a SHORT\nitem!"), (103, "one"), (103, "one"), (104, line(20_000)), (105, "İ ß one")]
    df = find_contamination(documents(*docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_matches_are_longest_and_located(spark, documents):
    item = " ".join(f"w{k}" for k in range(30))
    text = "x y " + " ".join(f"w{k}" for k in range(5, 25)) + " z w0 w1"
    df = find_contamination(documents((1, text)), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert [tuple(m) for m in df.first().matches] == [("7", 5, 2, 20)]


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in find_contamination(documents((1, "a b")), none).collect()] == [False]
    assert find_contamination(documents((1, "a")).limit(0), none).count() == 0
