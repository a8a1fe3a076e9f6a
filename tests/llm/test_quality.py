import random

import numpy as np

from rimeweave.llm import quality
from rimeweave.llm.queries import op1_quality


def made(rng, good):
    words = [rng.choice(["the", "and", "river", "stone", "walks", "evening"]) for _ in range(60)]
    return " ".join(words) if good else " ".join(w + rng.choice(["$$$", "###", "!!"]) for w in words)


def test_blocked_votes_are_exact(monkeypatch):
    rng = random.Random(5)
    model = quality.fit([(k % 2, made(rng, k % 2)) for k in range(100)], 0.5)
    texts = [made(rng, k % 3) for k in range(50)] + ["", "ab", "x" * 50_000]
    cosines = model.latent(texts) @ model.vectors.T
    want = []
    for row in cosines:
        best = np.argsort(-row, kind="stable")[: quality.NEIGHBOURS]
        vote = np.maximum(row[best], 0).astype(float) ** quality.SHARPNESS * model.importance[best]
        want.append((vote * model.labels[best]).sum() / vote.sum() if vote.sum() > 1e-12 else 0.5)
    monkeypatch.setattr(quality, "BLOCK", 7)
    assert np.allclose(model.score(texts), want, atol=1e-3)


def test_edge_cases(spark, documents):
    rng = random.Random(6)
    model = quality.fit([(k % 2, made(rng, k % 2)) for k in range(200)], 0.5)
    rows = quality.classify(
        documents(*((k, made(rng, k % 2)) for k in range(50)), (90, None), (91, ""), (92, made(rng, 1) * 2000), (92, "a")), model
    ).collect()
    assert len(rows) == 54 and rows[0].kept == "z" and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id < 50)
    assert quality.classify(documents((1, "a")).limit(0), model).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    bare = quality.train(documents((1, "a")), nothing)
    assert [r.score for r in quality.classify(documents((1, "abc"), (2, None)), bare).collect()] == [0.5, 0.5]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    low, good = got[got.quality == 0], got[got.quality == 1]
    assert (low.predicted == 0).mean() > 0.85 and (good.predicted == 1).mean() > 0.93
    assert (low.score.to_numpy()[:, None] < good.score.to_numpy()[None, :]).mean() > 0.96
