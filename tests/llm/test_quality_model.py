"""The quality classifier: held-out ranking, both classes, and what attention adds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windowmill.llm import quality


def auc(score, label):
    score, label = np.asarray(score), np.asarray(label)
    good, bad = score[label == 1], score[label == 0]
    return ((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()).item()


@pytest.mark.parametrize("size, least", [("sf0.01", 0.97), ("sf0.1", 0.995)])
def test_held_out_ranking_and_recall(spark, size, least):
    labels = spark.read.parquet(f"/root/testdata/{size}/labels.parquet").select("doc_id", "quality")
    held = quality.query(spark, f"/root/testdata/{size}").filter("held_out").join(labels, "doc_id").collect()
    label, predicted = np.array([r.quality for r in held]), np.array([r.predicted for r in held])
    assert auc([r.score for r in held], label) >= least
    assert (predicted[label == 1] == 1).mean() >= 0.97 and (predicted[label == 0] == 0).mean() >= 0.8


def planted(rng, n):
    """Bags of 20 passages of noise; those of label 0 hold one passage that is marked."""
    x, label = rng.standard_normal((n, 20, 6)), rng.integers(0, 2, n)
    x[:, :, 0] = np.where(rng.random((n, 20)) < 0.5, 1.0, -1.0) * 0.3
    x[label == 0, 7, 0] = 3.0
    x[:, :, 1:] *= 2
    return x.reshape(-1, 6), np.repeat(np.arange(n), 20), label.astype(float)


def test_attention_finds_the_passage_that_decides():
    rng = np.random.default_rng(3)
    model = quality.Model(np.zeros(6), np.ones(6)).fit(*planted(rng, 600))
    x, owner, label = planted(rng, 400)
    *_, at, _, score = model.forward(x, owner, 400)
    weight = at.reshape(400, 20)
    assert auc(score, label) >= 0.95
    assert weight[label == 0, 7].mean() > 3 / 20  # well above an even share
    model.p[4] = np.zeros_like(model.p[4])  # even weights, as mean pooling has them
    assert auc(model.forward(x, owner, 400)[-1], label) < auc(score, label)


def test_scores_do_not_depend_on_other_rows():
    model = quality.Model(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES))
    texts = ["a b c", None, "", "word " * 5000, "a b c", " \n"]
    whole = model.score(texts)
    assert np.allclose(whole, [model.score([t])[0] for t in texts], atol=1e-9) and whole[0] == whole[4] and len({whole[1], whole[2], whole[5]}) == 1


def test_repeated_ids_count_once(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)] + [(3, "zzz")] * 3, "doc_id long, text string")
    once = docs.filter("text <> 'zzz'")
    a, b = quality.train(docs, labels), quality.train(once, labels)
    assert all((x == y).all() for x, y in zip(a.p, b.p, strict=True))


def test_the_fit_is_bounded_in_passages(spark, monkeypatch):
    """Documents that would bring the sample over the bound are left out, in the order of the hash; a null id is of no fold."""
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(64 * (50 if k == 3 else 2)))) for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality.Model, "fit", lambda self, x, owner, target: seen.append((len(x), len(target))) or self)
    for bound in (20, 10**6):
        monkeypatch.setattr(quality, "SAMPLE_PASSAGES", bound)
        quality.train(docs, labels)
    (few, n), (every, m) = seen
    assert few == 20 and n == 10 and every > 20 and m > 20
    assert spark.createDataFrame([(None,)], "doc_id long").select(quality.held_out(F.col("doc_id"))).first()[0] is False
