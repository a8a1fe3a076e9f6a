import math
import random
import zlib


from rimeweave.llm import toxic
from rimeweave.llm.queries import op8_toxicity


def made(rng, bad):
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "ti", "es"]) for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    for at in rng.sample(range(120), 4 if bad else 0):
        words[at] = rng.choice(["blufox", "krumpig", "zwaddel"])
    return " ".join(words)


def test_windows_hold_the_whole_text():
    for text in ("", "a", "Ab  c!", "x" * 500, "the of " * 500, "é" * 300):
        joined = b"".join(w[1:] if i else w for i, w in enumerate(toxic.windows(text)))
        assert joined == (toxic.words(text) if toxic.words(text).strip() else b"")
        assert all(len(w) <= toxic.WINDOW + toxic.LONGEST + 1 for w in toxic.windows(text))


def test_held_out_rows_and_edge_cases(spark, documents):
    rng = random.Random(4)
    sample = [(int(k % 4 == 0), made(rng, k % 4 == 0)) for k in range(400)]
    model = toxic.fit(sample, 0.25)
    held = [(k, made(rng, k % 4 == 0)) for k in range(200)]
    extra = [(1000, None), (1001, ""), (1002, "!!"), (1003, "w" * 100_000), (1004, made(rng, False) * 300), (1004, "x")]
    rows = toxic.classify(documents(*held, *extra), model).collect()
    assert len(rows) == 206 and rows[0].kept == "z" and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in rows if r.doc_id < 1000) >= 190
    assert all(r.predicted == 0 for r in rows if r.doc_id >= 1000)
    assert toxic.classify(documents((1, "a")).limit(0), model).count() == 0


def test_without_labels(spark, documents):
    docs = documents((1, "a"), (2, None))
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert [r.score for r in toxic.classify(docs, toxic.train(docs, labels)).collect()] == [0.5, 0.5]


def test_sample_is_bounded_and_of_training_rows(spark, documents):
    docs = documents(*((k, f"text {k} " + "x" * 100) for k in range(200)), (5, "text 5 again"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    sample, share = toxic.labelled_sample(docs, labels, "toxic", {0: 30, 1: 10})
    assert sum(a for a, _ in sample) == 10 and len(sample) == 40 and 0.3 < share < 0.7
    assert all(zlib.crc32(t.split()[1].encode()) % 5 for _, t in sample)
    small, _ = toxic.labelled_sample(docs, labels, "toxic", {0: 30, 1: 10}, most_bytes=1000)
    assert 0 < len(small) < 10
    assert math.isnan(toxic.labelled_sample(docs, labels.limit(0), "toxic", {0: 3})[1])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    hit = got[got.toxic == 1].predicted.mean()
    wrong = got[got.toxic == 0].predicted.mean()
    assert hit > 0.45 and wrong < 0.02, (hit, wrong)  # a table of 340 toxic training rows; 0.93 with 2,000
    assert set(got.held_out) == {True}
