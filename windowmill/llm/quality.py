"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded by a learned
layer over its hashed words and the shares of characters, word shapes and
repetitions in it; gated attention weights the passages, and the weighted sum is
scored. Nothing but the passages enters, and only document labels are used. All
parameters are fitted together by gradient descent on a bounded sample of labelled
rows; every document is scored on all its passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowmill.llm import common
from windowmill.llm.shingles import mix, word_hashes

PASSAGE = 64
#: The fit sees at most so many labelled documents, chosen by a hash of their id, and all passages of each, of which there may be so many:
#: 1,108 bytes each as features, so a few hundred megabytes on the driver however long the documents are.
SAMPLE_DOCS, SAMPLE_PASSAGES = 4000, 100_000
HIDDEN, ATTENTION, STEPS, RATE, DECAY, WORD_DECAY, SEED = 16, 12, 200, 0.03, 1e-6, 1e-5, 11
ACCEPT = 0.3
N_SHAPE, N_WORDS = 21, 256
N_FEATURES = N_SHAPE + N_WORDS
#: Hashed words are scaled alike, not to unit variance, so that 256 rare ones do not drown the shapes.
WORD_SCALE = 0.2

#: Byte classes. 0 other symbols, 1 lower case, 2 upper case, 3 digits, 4 space, 5 line feed, 6 full stop and comma, 7 non-ASCII.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[[46, 44]], _CLASS[128:] = 1, 2, 3, 4, 5, 6, 7
_CLASS[[9, 11, 12, 13]] = 4


def _spread(values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n * PASSAGE, values.dtype)
    out[: len(values)] = values
    return out.reshape(n, PASSAGE)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Shape features of each passage, and the bucket of each word; a text without words is one passage of zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    kind = _CLASS[raw]
    inside = (kind != 4) & (kind != 5)
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not len(edge):
        return np.zeros((1, N_SHAPE), np.float32), np.empty(0, np.uint8)
    starts, ends = edge[::2], edge[1::2]
    words, length, first = word_hashes(text), ends - starts, kind[starts]
    n = -(-len(starts) // PASSAGE)
    cut = starts[::PASSAGE]
    count = np.minimum(PASSAGE, len(starts) - PASSAGE * np.arange(n)).astype(float)
    chars = np.diff(np.append(cut, len(raw))).astype(float)
    shares = [np.add.reduceat((kind == k).astype(np.int64), cut) / chars for k in range(8)]
    mean = np.add.reduceat(length, np.arange(0, len(starts), PASSAGE)) / count
    square = np.add.reduceat(length.astype(float) ** 2, np.arange(0, len(starts), PASSAGE)) / count
    per_word = lambda flag: np.add.reduceat(flag.astype(float), np.arange(0, len(starts), PASSAGE)) / count
    grid = np.sort(_spread(words, n), axis=1)
    fresh = np.concatenate([np.ones((n, 1), bool), grid[:, 1:] != grid[:, :-1]], axis=1)
    distinct = (fresh & (grid != 0)).sum(axis=1) / count
    repeat = np.concatenate([[False], words[1:] == words[:-1]])
    last = kind[ends - 1]
    pair = mix(words[1:] + mix(words[:-1])) if len(words) > 1 else words
    again = np.ones(len(words))  # pairs of words that stand before in the document
    again[np.unique(pair, return_index=True)[1]] = 0
    again[len(pair) :] = 0
    bare = first == 0
    shape = np.column_stack(
        [*shares, mean / 10, np.sqrt(np.maximum(0, square - mean**2)) / 10, distinct, per_word(repeat), per_word(length <= 3), per_word((length == 1) & bare), per_word(first == 2),
         per_word(last == 0), per_word(last == 6), per_word(length >= 15), per_word(again), count / PASSAGE, np.ones(n)]
    ).astype(np.float32)
    return shape, (words >> np.uint64(56)).astype(np.uint8)


def features(shape: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Shape features and the share of each bucket of words, for each passage."""
    at = np.arange(len(buckets)) // PASSAGE * N_WORDS + buckets
    counts = np.bincount(at, minlength=len(shape) * N_WORDS)[: len(shape) * N_WORDS].reshape(len(shape), N_WORDS)
    return np.concatenate([shape, (counts / PASSAGE).astype(np.float32)], axis=1)


def passages(text: str | None) -> np.ndarray:
    return features(*bag(text))


class Model:
    """Standardised passage features, tanh layer, gated attention, logistic score."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.standard_normal((a, b)) / np.sqrt(a)
        self.centre, self.scale = centre.astype(np.float32), scale.astype(np.float32)
        self.p = [draw(len(centre), HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, ATTENTION), draw(HIDDEN, ATTENTION), draw(ATTENTION, 1)[:, 0], draw(HIDDEN, 1)[:, 0], np.zeros(1)]
        #: Pull of each parameter to zero: firm on hashed words, of which there are many.
        self.decay: list[np.ndarray | float] = [np.where(np.arange(len(centre)) < N_SHAPE, DECAY, WORD_DECAY)[:, None], *[DECAY] * 6]

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> tuple:
        """x: features of passages; bag: the document of each, ascending from 0 to n - 1."""
        w, b, v, u, a, c, d = self.p
        x = (x - self.centre) / self.scale
        h = np.tanh(x @ w + b)
        t, g = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * g) @ a
        e = np.exp(e - np.maximum.reduceat(e, np.searchsorted(bag, np.arange(n)))[bag])
        at = e / np.bincount(bag, e, n)[bag]
        z = np.add.reduceat(at[:, None] * h, np.searchsorted(bag, np.arange(n)), axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ c + d[0], -30, 30)))
        return x, h, t, g, at, z, y

    def gradients(self, x: np.ndarray, bag: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        n = len(target)
        _, _, v, u, a, c, _ = self.p
        x, h, t, g, at, z, y = self.forward(x, bag, n)
        dl = (y - target) / n
        dz = dl[:, None] * c
        back = dz[bag]
        da = (back * h).sum(axis=1)
        de = at * (da - np.bincount(bag, at * da, n)[bag])
        dtg = de[:, None] * a
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (at[:, None] * back + dt @ v.T + dg @ u.T) * (1 - h * h)
        return [x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ dl, np.array([dl.sum()])]

    def fit(self, x: np.ndarray, bag: np.ndarray, target: np.ndarray) -> Model:
        m, s = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for step in range(1, STEPS + 1):
            for i, g in enumerate(self.gradients(x, bag, target)):
                g = g + self.decay[i] * self.p[i]
                m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.999 * s[i] + 0.001 * g * g
                self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        found = [passages(t) for t in texts]
        if not found:
            return np.empty(0)
        owner = np.repeat(np.arange(len(found)), [len(b) for b in found])
        return self.forward(np.concatenate(found), owner, len(found))[-1]


def held_out(doc_id: Column) -> Column:
    """Is it of the fold that the fit does not see? A null id is of none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shape, buckets = zip(*map(bag, batch["text"].to_pylist()), strict=True) if len(batch) else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["target"], pa.array([x.tobytes() for x in shape], pa.binary()), pa.array([x.tobytes() for x in buckets], pa.binary()), pa.array([len(x) for x in shape], pa.int32())],
            ["doc_id", "target", "shape", "buckets", "passages"],
        )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on labelled documents outside the held-out fold.

    The sample is the ``SAMPLE_DOCS`` labelled ids of smallest hash, but those that
    would bring it over ``SAMPLE_PASSAGES``, in the order of the hash. All passages of
    the others reach the driver, 148 bytes for 64 words, and nothing else. Labels other
    than 0 and 1 and null ids are ignored; an id that is repeated counts once, with
    its smallest label and its smallest text. With no label, or one kind only, the
    score is the share of that kind.
    """
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("target")).filter("doc_id is not null and target in (0, 1)")
    usable = usable.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("target").alias("target"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("target").alias("target"), F.min("text").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    bags = common.materialize(texts.mapInArrow(_bags, f"doc_id {kind}, target int, shape binary, buckets binary, passages int"), "quality-bags")
    sizes = bags.select("doc_id", "passages").orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most SAMPLE_DOCS
    left, fit = SAMPLE_PASSAGES, []
    for r in sizes:
        if r.passages <= left:
            left -= r.passages
            fit.append(r.doc_id)
    if len(fit) < len(sizes):
        bags = bags.filter(F.col("doc_id").isin(fit))
    found = sorted(bags.collect(), key=lambda r: r.doc_id)
    if not found:
        found_x, target = [np.zeros((1, N_FEATURES), np.float32)], np.array([0.5])
    else:
        found_x = [features(np.frombuffer(r.shape, np.float32).reshape(-1, N_SHAPE), np.frombuffer(r.buckets, np.uint8)) for r in found]
        target = np.array([float(r.target) for r in found])
    x, owner = np.concatenate(found_x), np.repeat(np.arange(len(target)), [len(b) for b in found_x])
    scale = x.std(axis=0) + 1e-3
    scale[N_SHAPE:] = WORD_SCALE
    model = Model(x.mean(axis=0), scale)
    if target.min() == target.max():
        model.p[5][:], model.p[6][0] = 0, 4 * (2 * target[0] - 1)
        return model
    return model.fit(x, owner, target)


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and score, for every row, without a shuffle.

    A null or empty text is scored as one empty passage. Equal texts have equal
    scores up to rounding, whatever else is in the row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch[0].to_pylist(), []
            for a in range(0, len(texts), 128):
                out.append(model.score(texts[a : a + 128]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate([*out, np.empty(0)]))], [*batch.schema.names[1:], "score"])

    own = docs.select(F.col(text_col).alias("_text"), *keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:]), "score double"])
    return own.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: quality of all documents, learned from the labels outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, common.table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
