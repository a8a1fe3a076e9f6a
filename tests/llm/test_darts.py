import random
from collections import Counter

import numpy as np
import pytest

from rimeweave.llm import common, darts, links, shingles
from rimeweave.llm.darts import BANDS, ROWS, near_duplicates, signatures
from rimeweave.llm.links import classes, stars


def sets(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[at : at + 5]) for at in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_weighted_sets_are_the_shingles():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab é\n\t日".split(" ")) for _ in range(rng.randrange(30))) for _ in range(60)]
    texts += ["", "  ", "a", "a b c d", "A b C d", "a b c d e", "x" * 1000 + " b", " a"]
    owners, hashes, counts = shingles.weighted_sets(texts)
    for at, text in enumerate(texts):
        want = sets(text)
        assert sorted(counts[owners == at]) == sorted(want.values())
    for a in range(0, len(texts), 3):
        for b in range(0, len(texts), 5):
            got = shingles.weighted_jaccard(*((hashes[owners == t], counts[owners == t]) for t in (a, b)))
            assert got == pytest.approx(jaccard(sets(texts[a]), sets(texts[b])))


def test_signatures_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(9)
    shared, only = rng.integers(1, 2**62, 60).astype(np.uint64), rng.integers(1, 2**62, 40).astype(np.uint64)
    left, right = rng.uniform(0.2, 3.5, 60), rng.uniform(0.2, 3.5, 60)
    extra = rng.uniform(0.2, 2.0, 40)
    elements = np.concatenate([shared, only[:20], shared, only[20:]])
    weights = np.concatenate([left, extra[:20], right, extra[20:]])
    signed = signatures(np.repeat([0, 1], 80), elements, weights, 3, 4000)
    want = np.minimum(left, right).sum() / (np.maximum(left, right).sum() + extra.sum())
    assert abs((signed[0] == signed[1]).mean() - want) < 0.04
    assert (signed[:2] != 0).all() and (signed[2] == 0).all()


def test_against_brute_force(documents):
    rng = random.Random(10)
    line = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    pairs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "a b c d e"), (7, "A  b c\nd e"), (None, "a b c d e"), (8, "x" * 200_000)]
    for key in range(20, 60, 4):
        base = line(100)
        for at in range(4):
            copy = list(base)
            for _ in range(at):
                copy[rng.randrange(100)] = "new" + str(rng.randrange(99))
            pairs.append((key + at, " ".join(copy)))
    hot = line(120)
    for key in range(100, 160):
        copy = list(hot)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(120)] = "hot" + str(rng.randrange(999))
        pairs.append((key, " ".join(copy)))
    long = line(3000)
    pairs += [(200, " ".join(long)), (201, " ".join(long[:2900])), (202, " ".join(hot)), (203, "la la " * 300), (204, "la la " * 290), (205, "la la " * 100)]
    ids = [key for key, _ in pairs if key is not None]
    bags = {key: sets(text) for key, text in pairs if key is not None}
    edges = [(a, b) for a in ids for b in ids if a < b and bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= 0.8]
    want = components(ids, edges)
    rows = near_duplicates(documents(*pairs)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(pairs) and {k: got[k].class_id for k in ids} == want
    sizes = Counter(want.values())
    assert all(got[k].class_size == sizes[want[k]] and got[k].kept == (want[k] == k) for k in ids)
    assert got[None].kept and got[None].class_size == 1
    assert near_duplicates(documents((1, "a")).limit(0)).count() == 0


def test_repeated_rows(documents):
    rows = near_duplicates(documents((1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "z"))).collect()
    assert sorted((r.doc_id, r.class_id, r.kept) for r in rows) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_classes_of_chains_and_stars(spark):
    rng = random.Random(11)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 300)] + [(k, k) for k in (7, 500)]
    edges += [tuple(rng.sample(range(1000, 1100), 2)) for _ in range(60)]
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    got = classes(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["class"] for r in got} == components(nodes, [e for e in edges if e[0] != e[1]]) and len(got) == len(nodes)


def test_buckets_become_stars(spark):
    rows = [(k % 5, k) for k in range(200)] + [(9, k) for k in range(1000, 3000)] + [(10, 5000), (10, 5000), (11, 7)]
    edges = stars(spark.createDataFrame(rows, "key long, node long").repartition(4), len(rows)).collect()
    assert sorted((r.a, r.b) for r in edges) == sorted([(k, k % 5) for k in range(5, 200)] + [(k, 1000) for k in range(1001, 3000)])


def test_a_group_just_below_the_threshold_makes_no_pairs(spark, documents):
    """Copies of one text with four words changed each: most pairs are a little below 0.8, some are links."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for key in range(1, 601):
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append((key, " ".join(copy)))
    bags = {key: sets(text) for key, text in texts}
    edges = [(a, b) for a in bags for b in bags if a < b and jaccard(bags[a], bags[b]) >= 0.8]
    rows = near_duplicates(documents(*texts)).collect()
    got = {r.doc_id: r.class_id for r in rows}
    assert got == components(list(bags), edges)
    assert sum(r.n_links for r in rows) == 2 * len(edges)


def test_recall_of_the_bands():
    """The share of pairs at 0.8 that meet in a band, measured on signatures: 0.9 or more is asked for."""
    rng = np.random.default_rng(13)
    pool = rng.integers(1, 2**62, (300, 100)).astype(np.uint64)
    owners, elements = np.repeat(np.arange(600), 90), np.concatenate([np.stack([row[:90], row[10:]]).ravel() for row in pool])
    signed = signatures(owners, elements, np.ones(len(owners)), 600, BANDS * ROWS).reshape(300, 2, BANDS, ROWS, order="C")
    agree = np.stack([signed[:, 0].reshape(300, -1)[:, at::BANDS] for at in range(BANDS)], 1) == np.stack(
        [signed[:, 1].reshape(300, -1)[:, at::BANDS] for at in range(BANDS)], 1
    )
    assert agree.all(axis=2).any(axis=1).mean() > 0.98


def test_plans_stay_small(documents, monkeypatch):
    """The driver keeps and plans again, at each stage, what a table is made of: no table may repeat the steps before it."""
    sizes = []

    def measured(df, name):
        sizes.append((str(df._jdf.queryExecution().executedPlan().toString()).count("Exchange hashpartitioning"), name))
        return common.written(df, name)

    for module in (darts, links):
        monkeypatch.setattr(module, "written", measured)
    rng = random.Random(14)
    line = [f"w{rng.randrange(1000)}" for _ in range(60)]
    texts = [(key, " ".join([*line[: 58 + key % 3], str(key % 7)])) for key in range(30)]
    assert {r.class_id for r in near_duplicates(documents(*texts)).collect()} == {0}
    assert max(sizes)[0] <= 10, sorted(sizes)[-3:]
