"""Source divergence against plain whole numbers."""

import random
import re

import numpy as np
import pytest

from rimeweave.llm import divergence
from rimeweave.llm.divergence import gap, source_divergence, tile_sums

SCHEMA = "doc_id long, text string, lang string, source string, value string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(k, *row, "v", "r") for k, row in enumerate(rows)], SCHEMA).repartition(3)


def expected(rows, least=10, top=10):
    """Straight from the definition."""
    docs = [tuple(x or "" for x in row) for row in rows]
    found = []
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang in {d[1] for d in docs}:
        words = [(d[2], re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", d[0].translate(low))) for d in docs if d[1] == lang]
        kept = [t for t in {t for _, w in words for t in w} if sum(t in w for _, w in words) >= least]
        counts = {None: {t: sum(w.count(t) for _, w in words) for t in kept}}
        for source in {s for s, _ in words}:
            counts[source] = {t: sum(w.count(t) for s, w in words if s == source) for t in kept}
        shares = {
            key: {t: 1 + 10**9 * (n + 2) // (sum(held.values()) + 2 * len(kept)) for t, n in held.items()} for key, held in counts.items()
        }
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for source in set(counts) - {None}:
            p = shares[source]
            pairs = [(o, sum(f(p[t], shares[o][t]) for t in kept)) for o in set(counts) - {None, source}]
            terms = [(t, f(p[t], shares[None][t])) for t in kept if counts[source][t] and p[t] > shares[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                found += [(lang, source, part, item, value, at) for at, (item, value) in enumerate(ranked, 1)]
    return sorted(found)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, sources, words, count):
    draw = random.Random(seed)
    names = [f"é{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzABCD'[k // 100]}" for k in range(words)]
    rows = []
    for _ in range(count):
        source = draw.choice(sources)
        shift = len(source or "") * 7
        text = " ".join(names[min(words - 1, int(draw.expovariate(6 / words)) + shift) % words] for _ in range(draw.randrange(40)))
        rows.append((text, draw.choice(["en", "en", "fr", None]), source))
    return rows


@pytest.mark.parametrize("tile, groups", [(4096, 64), (5, 2), (16, 3)])
def test_against_the_definition(spark, monkeypatch, tile, groups):
    monkeypatch.setattr(divergence, "TILE_TERMS", tile)
    monkeypatch.setattr(divergence, "TILE_GROUPS", groups)
    rows = corpus(tile, ["a", "bb", "ccc", "dddd", "eeeee", None, "Z"], 120, 260)
    assert result(source_divergence(table(spark, rows))) == expected(rows)


def test_tile_prices_all_zero_quadrants():
    draw = np.random.default_rng(0)
    for groups, width in ((1, 1), (2, 9), (7, 64), (20, 300), (33, 3)):
        dense = np.where(draw.random((groups, width)) < 0.1, draw.integers(5, 10**9, (groups, width)), 0)
        zero = draw.integers(1, 5, groups)
        full = np.where(dense > 0, dense, zero[:, None])
        wanted = gap(full[:, None, :], full[None, :, :]).sum(axis=2)
        rows, columns = np.nonzero(dense)
        every = np.arange(groups)
        got = tile_sums(rows, columns, dense[rows, columns], zero, width, every, every)
        assert (got == wanted).all()
        half = every[: groups // 2 + 1]
        assert (tile_sums(rows, columns, dense[rows, columns], zero, width, half, every[1:]) == wanted[np.ix_(half, every[1:])]).all()


def test_edges(spark):
    rows = [("Abc abc", "en", "one")] * 10 + [("abc", "en", "two"), (None, "en", "three"), ("", "de", None), ("1 2 3 [ ]", None, "x")]
    rows += [("ÄB äB", "en", "one")] * 9 + [("lone", "xx", "only")]
    got = result(source_divergence(table(spark, rows)))
    assert got == expected(rows)
    assert {r[1] for r in got if r[2] == "pair"} == {"one", "two", "three"}
    assert result(source_divergence(table(spark, [(None, None, None)]))) == []
    assert result(source_divergence(table(spark, rows).limit(0))) == []


def test_long_text_and_large_counts(spark):
    rows = [("word " * 200_000 + "other", "en", "a"), ("other", "en", "b")]
    assert result(source_divergence(table(spark, rows), 1)) == expected(rows, 1)
