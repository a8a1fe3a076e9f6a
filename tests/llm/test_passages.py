import random
from fractions import Fraction

import pytest
import numpy as np
from pyspark.sql import functions as F

from rimeweave.llm import passages
from rimeweave.llm.blocks import product_links
from rimeweave.llm.darts import SIMILARITY, numbered_sets
from rimeweave.llm.passages import PASSAGE, find_repeats, merged, remove_repeats


def line(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def shingles(words):
    return {tuple(words[at : at + 5]) for at in range(len(words) - 4)}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(13)
    passage, common, para = line(rng, 55), line(rng, 13), line(rng, 80)
    near = list(para)
    near[40] = "changed"
    docs = {key: [line(rng, rng.randrange(20, 120)) for _ in range(3)] for key in range(60)}
    for key in range(10):  # inside other lines
        docs[key][1][9:9] = passage
    for key in range(10, 40):  # short lines that many share
        docs[key].append(common)
    for key in (41, 42, 43):
        docs[key].append(para if key < 43 else near)
    texts = {key: "\n".join(" ".join(one) for one in lines) for key, lines in docs.items()}
    return texts, passage, para, near


def test_planted_repeats(documents, corpus):
    texts, passage, para, near = corpus
    assert len(shingles(para) & shingles(near)) / len(shingles(para) | shingles(near)) >= SIMILARITY
    odd = [(100, None), (101, ""), (102, " \n"), (103, "x" * 50_000), (None, texts[0]), (104, texts[50]), (105, texts[50].upper())]
    df = documents(*texts.items(), *odd)
    found = find_repeats(df)
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == len(texts) + len(odd)
    clean = {r.doc_id: r.clean_text for r in remove_repeats(df, found).collect()}
    for key in range(1, 10):
        assert rows[key].copies_of == [0] and rows[key].n_removed == 55
        assert rows[key].n_removed == len(texts[key].split()) - len(clean[key].split())
        gone = [" ".join(texts[key].split()[s.word : s.word + s.length]) for s in rows[key].removed]
        assert all(g in " ".join(passage) for g in gone)
    assert rows[0].n_repeated == 55 and rows[0].n_removed == 0 and clean[0] == texts[0]
    assert [rows[k].n_removed for k in (41, 42, 43)] == [0, 80, 80] and rows[43].copies_of == [41]
    assert clean[42] == "\n".join(texts[42].split("\n")[:3]) + "\n"
    for key in [*range(10, 40), 40, *range(44, 50), *range(51, 60), 100, 101, 102, 103, None]:
        assert rows[key].n_repeated == 0
    for key in (104, 105):
        assert rows[key].copies_of == [50] and rows[key].n_removed >= len(texts[50].split()) - 47


def test_shared_runs_of_47_words_are_found_wherever_they_stand(documents):
    rng = random.Random(14)
    pairs = []
    for key in range(0, 120, 2):
        run = line(rng, 47)
        pairs += [(k, " ".join(line(rng, rng.randrange(40)) + run + line(rng, rng.randrange(40)))) for k in (key, key + 1)]
    rows = {r.doc_id: r for r in find_repeats(documents(*pairs)).collect()}
    assert all(47 <= rows[key + 1].n_removed <= 49 and rows[key + 1].copies_of == [key] for key in range(0, 120, 2))


def test_repeats_in_one_document_and_empty_table(documents):
    text = " ".join(line(random.Random(15), 100))
    rows = find_repeats(documents((1, text + "\n" + text), (1, text + "\n" + text))).collect()
    assert [(r.n_removed >= 100, r.copies_of) for r in rows] == [(True, []), (True, [])]
    assert find_repeats(documents((1, "a")).limit(0)).count() == 0
    assert merged([(5, 3), (0, 2), (7, 4), (2, 1)]) == [(0, 3), (5, 6)] and passages.SIMILARITY == 0.8


def test_paragraphs_are_compared_as_sets_of_shingles(documents):
    """The same phrase three times and twice: equal sets, apart from the few shingles of the seams."""
    phrase = line(random.Random(16), 40)
    texts = documents((1, " ".join(phrase * 3)), (2, " ".join(phrase * 2))).select(F.col("doc_id").alias("id"), "text")
    for sets, linked in ((passages.shingle_sets, True), (numbered_sets, False)):
        owners, elements = sets([r.text for r in texts.collect()])
        assert product_links(owners, elements, np.zeros(2, int), Fraction(4, 5))[1].tolist() == [linked, linked]
    rows = passages.repeated_paragraphs(texts, SIMILARITY).collect()
    assert {(r.id, r.first.id) for r in rows} == {(1, 1), (2, 1)}


def test_different_texts_with_one_id(documents):
    rng = random.Random(17)
    shared, other = line(rng, 90), line(rng, 7)
    df = documents((1, " ".join(shared)), (2, " ".join(shared)), (2, " ".join(other)))
    found = find_repeats(df)
    rows = {(r.doc_id, r.clean_text) for r in remove_repeats(df, found).collect()}
    assert (1, " ".join(shared)) in rows and (2, " ".join(other)) in rows and len(rows) == 3
    assert sorted(r.n_removed for r in found.collect()) in ([0, 0, 90], [0, 0, 0])


def test_short_lines_in_a_row_are_compared_together(documents):
    rng = random.Random(18)
    block = [line(rng, 20) for _ in range(4)]
    changed = [list(one) for one in block]
    changed[1][18] = changed[3][18] = "changed"
    texts = {key: "\n".join(" ".join(one) for one in [*lines, line(rng, 30)]) for key, lines in ((1, block), (2, changed))}
    rows = {r.doc_id: r for r in find_repeats(documents(*texts.items())).collect()}
    assert rows[2].n_removed >= 40 and rows[2].copies_of == [1] and rows[1].n_removed == 0
    assert list(passages.runs_of_lines([3, 10, 12, 20, 30, 5, 0, 24, 2])) == [(0, 4, 45), (4, 5, 30), (7, 8, 24)]
    assert list(passages.runs_of_lines([20, 20, 20, 20, 9])) == [(0, 2, 40), (2, 5, 49)]


def test_paragraph_classes_against_brute_force(documents):
    rng, lines = random.Random(19), []
    for _ in range(25):
        base = line(rng, rng.randrange(24, 90))
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"c{rng.randrange(99)}"
            lines.append(copy)
    rng.shuffle(lines)
    texts = documents(*((key, " ".join(one)) for key, one in enumerate(lines))).select(F.col("doc_id").alias("id"), "text")
    sets = [shingles(one) for one in lines]
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if one == old else one for one in root]
    want = {(key, one) for key, one in enumerate(root) if root.count(one) > 1}
    assert {(r.id, r.first.id) for r in passages.repeated_paragraphs(texts, SIMILARITY).collect()} == want


def test_copies_of_whole_documents(documents):
    rows = [(key, " ".join(line(random.Random(key % 7), 60))) for key in range(40)]
    want = {r.doc_id: (r.n_removed, r.copies_of) for r in find_repeats(documents(*rows)).collect()}
    assert all(want[key] == ((60, [key % 7]) if key >= 7 else (0, [])) for key, _ in rows)
