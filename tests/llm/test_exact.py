import hashlib
import random
import re

from rimeweave.llm.exact import exact_duplicates


def brute(pairs):
    groups = {}
    for key, text in pairs:
        text = text or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), key))
    return {
        (key, min(group)[1], len(group), key == min(group)[1], hashlib.sha256(plain.encode()).hexdigest())
        for plain, group in groups.items() for _, key in group
    }


def found(df):
    rows = exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    return {tuple(row) for row in rows}


def test_against_brute_force(documents):
    rng = random.Random(1)
    pairs = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "\x85"), (5, "ä b"), (6, "äb"), (7, "äb"), (8, "x" * 300_000)]
    pairs += [(key, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))) for key in range(10, 400)]
    pairs += [(key, "one hot  group" + " " * (key % 7)) for key in range(400, 700)]
    assert found(documents(*pairs)) == brute(pairs)


def test_repeated_rows_and_missing_ids(documents):
    rows = exact_duplicates(documents((1, "a"), (1, "a"), (None, "a"), (2, "b"))).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in rows) == [
        (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 1, True)
    ]


def test_empty_and_native(documents):
    df = exact_duplicates(documents((1, "a")).limit(0))
    assert df.count() == 0
    plan = exact_duplicates(documents((1, "a")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
