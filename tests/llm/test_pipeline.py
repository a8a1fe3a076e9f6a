import hashlib

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from rimeweave.llm import toxic
from tests.llm.test_darts import components, jaccard, sets
from tests.llm.test_exact import brute as exact_brute
from tests.llm.test_suffixes import words

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    """Every stage on the rows that the one before it kept, over the whole table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, state = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = corpus_pipeline.written(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        state[name] = before, {r.doc_id for r in docs.select("doc_id").collect()}
    before, kept = state["toxicity"]
    model = toxic.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = toxic.features([t for _, t in before], model.ordinary, model.toxic) @ model.weights
    assert kept == {k for (k, _), s in zip(before, scores) if s < 0}
    before, kept = state["exact dedup"]
    assert kept == {key for key, _, _, stays, _ in exact_brute(before) if stays}
    before, kept = state["near dedup"]
    bags, where = {k: sets(t) for k, t in before}, {}
    for key, bag in bags.items():
        for shingle in bag:
            where.setdefault(shingle, set()).add(key)
    near = {(min(a, b), max(a, b)) for a, bag in bags.items() for s in list(bag)[:400] for b in where[s] if a != b}
    edges = [(a, b) for a, b in near if jaccard(bags[a], bags[b]) >= 0.8]
    assert edges and kept == {k for k, c in components(bags, edges).items() if k == c}
    before, kept = state["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert kept == {row[0] for row in _leaks(before, items) if not row[1]}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(last) == sorted(whole)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(before)
    assert {r.doc_id for r in last} == kept
    for row in last:
        ids = model.encode(texts[row.doc_id])
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _leaks(docs, items):
    """(id, hit) by sets of ten-word windows."""
    windows, sizes = set(), set()
    for _, text in items:
        found = words(text)
        size = min(10, len(found))
        sizes |= {size} if size else set()
        windows |= {tuple(found[at : at + size]) for at in range(len(found) - size + 1)} if size else set()
    for key, text in docs:
        found = words(text)
        yield key, any(tuple(found[at : at + n]) in windows for n in sizes for at in range(len(found) - n + 1))


def test_stages_keep_clashing_columns_and_missing_values(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = documents((1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (4, "y " * 3000)).withColumn("predicted", F.lit(5))
    assert labels.count() > 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, SF), "stage")
        assert out.columns == docs.columns and 3 <= out.count() <= 6
        assert {(r.predicted, r.kept) for r in out.collect()} == {(5, "z")}
        assert stage(spark, docs.limit(0), SF).count() == 0
