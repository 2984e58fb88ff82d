"""The fit of the quality classifier sees every passage of a labelled document."""

import numpy as np

from windowmill.llm import quality


def test_fit_sees_all_passages(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality.Model, "fit", lambda self, x, bag, target: seen.update(x=x, bag=bag) or self)
    ids = [i for i, in spark.range(20).filter(~quality.held_out(quality.F.col("id"))).collect()][:3]
    texts = {ids[0]: " ".join(f"word{k % 97}" for k in range(20_020)), ids[1]: "one short text", ids[2]: "A B C " * 1000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 0), (ids[2], 0)], "doc_id long, quality int")
    quality.train(docs, labels)
    whole = [quality.passages(texts[i]) for i in sorted(texts)]
    assert [len(x) for x in whole] == [313, 1, 47]
    assert np.bincount(seen["bag"]).tolist() == [313, 1, 47] and (seen["x"] == np.concatenate(whole)).all()
