"""Whitening of embeddings along the leading components of their covariance, by LOBPCG.

No covariance matrix is made. Tasks multiply their centred rows with a block of
directions and back, and the partial products are added up: one pass over the rows for
each product of the covariance and a block. The driver holds blocks of dimension by
directions alone. Each round is a Rayleigh-Ritz step on the iterate, its residuals and
the previous directions, orthonormal to each other; it ends when the residuals, from a
product made anew, are at most TOLERANCE of the largest eigenvalue.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowmill.llm import common

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Directions iterated beside those asked for; they keep close eigenvalues apart.
GUARD = 8
TOLERANCE = 1e-12
#: What is smaller than this share of the largest eigenvalue is no component.
LEAST_SHARE = 1e-10
ROUNDS = 500
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Space:
    """The fit list of one dimension: rows, sums of their numbers, whether 64-bit integers hold n * x - S."""

    dim: int
    n: int
    sums: list[int]
    wide: bool


def numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim, x of the vectors that hold finite numbers only."""
    doubles = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), doubles.alias("v"))
    held = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < 2.0**52), F.lit(False)))  # beyond, no long holds x
    own = own.filter(F.coalesce(held, F.lit(False)) & (F.size("v") > 0))
    return own.select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per dimension and place: sums of the low and the high halves of x, and its range."""
    total: dict[int, list] = {}
    for batch in batches:
        dims = batch["dim"].to_numpy()
        for dim in np.unique(dims).tolist():
            x = batch["x"].filter(pa.array(dims == dim)).flatten().to_numpy().reshape(-1, dim)
            own = [(x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0), x.min(axis=0), x.max(axis=0), len(x)]
            had = total.get(dim)
            total[dim] = own if had is None else [had[0] + own[0], had[1] + own[1], np.minimum(had[2], own[2]), np.maximum(had[3], own[3]), had[4] + own[4]]
    for dim, (low, high, least, most, n) in total.items():
        columns = [np.full(dim, dim, np.int32), np.arange(dim, dtype=np.int32), low, high, least, most, np.full(dim, n)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "place", "low", "high", "least", "most", "n"])


def spaces(x: DataFrame) -> list[Space]:
    """One for each dimension; a row for each place comes to the driver."""
    part = x.select("dim", "x").mapInArrow(_sums, "dim int, place int, low long, high long, least long, most long, n long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found: dict[int, list] = {}
    for r in part.groupBy("dim", "place").agg(wide("low"), wide("high"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n")).orderBy("dim", "place").toLocalIterator():
        found.setdefault(r.dim, []).append((int(r.low) + (int(r.high) << 32), r.least, r.most, r.n))
    out = []
    for dim, rows in found.items():
        n = rows[0][3]
        most = max(max(n * top, abs(s), abs(n * top - s), abs(n * least - s), abs(n * least)) for s, least, top, _ in rows)
        out.append(Space(dim, n, [r[0] for r in rows], most >= 1 << 62))
    return out


def _centred(batch: pa.RecordBatch, space: Space) -> np.ndarray:
    """n * x - S of each row, exact."""
    x = batch["x"].flatten().to_numpy().reshape(-1, space.dim)
    kind = object if space.wide else np.int64
    return x.astype(kind) * space.n - np.array(space.sums, kind)


def _product(space: Space, block: np.ndarray):
    """The rows of a task to their share of covariance times block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(block)
        for batch in batches:
            if len(batch):
                y = _centred(batch, space).astype(np.float64) / space.n
                total += y.T @ (y @ block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel() / space.n)], ["place", "share"])

    return run


def _summed(shares: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape[0] * shape[1])
    for r in shares.groupBy("place").agg(F.sum("share").alias("share")).collect():  # dimension times directions
        out[r.place] = r.share
    return out.reshape(shape)


def _against(block: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what of the block is not in the bases; dependent directions go."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        for _ in range(2):
            for base in bases:
                block = block - base @ (base.T @ block)
        if not block.size:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(s[0], 1e-300)] if s[0] > 1e-13 else u[:, :0]
    return block


def lobpcg(multiply, dim: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading eigenvalues, eigenvectors and residual norms of a symmetric operator given by its products with blocks.

    Residuals are certified: they come from a product with the final block and not from
    updated ones. If they do not reach TOLERANCE within ROUNDS products, it is an error.
    """
    size = min(dim, wanted + GUARD)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, size)))[0]
    ax, p, ap = multiply(x), np.empty((dim, 0)), np.empty((dim, 0))
    fresh = True  # ax is a product and not an update
    for _ in range(ROUNDS):
        theta, c = np.linalg.eigh(0.5 * (x.T @ ax + ax.T @ x))
        order = np.argsort(theta)[::-1]
        theta, c = theta[order], c[:, order]
        x, ax = x @ c, ax @ c
        residual = ax - x * theta
        norms = np.linalg.norm(residual, axis=0)[:wanted]
        if (norms <= TOLERANCE * max(theta[0], 0)).all():
            if fresh:
                return theta[:wanted], x[:, :wanted], norms
            x = np.linalg.qr(x)[0]
            ax, p, ap, fresh = multiply(x), p[:, :0], ap[:, :0], True
            continue
        w = _against(residual, x, p)
        if not w.shape[1]:  # the block spans all that there is, up to rounding; a new product decides
            x = np.linalg.qr(x)[0]
            ax, p, ap, again = multiply(x), p[:, :0], ap[:, :0], fresh
            fresh = True
            if again and not (w := _against(np.random.default_rng(seed + 1).standard_normal((dim, size)), x)).shape[1]:
                break
            if not again:
                continue
        basis, image = np.concatenate([x, w, p], axis=1), np.concatenate([ax, multiply(w), ap], axis=1)
        gram = basis.T @ image
        _, c = np.linalg.eigh(0.5 * (gram + gram.T))
        c = c[:, ::-1][:, :size]
        rest = c.copy()
        rest[: x.shape[1]] = 0
        d = _against(rest, c)
        x, ax, p, ap, fresh = basis @ c, image @ c, basis @ d, image @ d, False
    raise RuntimeError(f"residuals of {norms.max():.2e} after {ROUNDS} products")


def _second_moments(space: Space, directions: np.ndarray):
    """The rows of a task to their share of the second moments of whitened rows, of their means, and of the trace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = directions.shape[1]
        total = np.zeros((k + 2, k))
        for batch in batches:
            if len(batch):
                y = _centred(batch, space).astype(np.float64) / space.n
                w = y @ directions
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
                total[k + 1, 0] += (y * y).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel() / space.n)], ["place", "share"])

    return run


def _rows(space: Space, directions: np.ndarray, explained: np.ndarray, identity_error: float):
    """vec_id, x to a row for each component."""
    import decimal

    k, limit = directions.shape[1], 10**38

    def deviations(c: np.ndarray) -> pa.Array:
        if not space.wide and space.dim * float(np.abs(c).max()) ** 2 < 2.0**62:
            whole = (c * c).sum(axis=1).tolist()
        else:
            whole = (c.astype(object) ** 2).sum(axis=1).tolist()
        return pa.array([decimal.Decimal(int(v)) if v < limit else None for v in whole], pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            c = _centred(batch, space)
            w, each = (c.astype(np.float64) / space.n) @ directions, np.repeat(np.arange(len(batch)), k)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))), pa.array(np.full(len(each), space.n)),
                 deviations(c).take(pa.array(each)), pa.array(w.ravel()), pa.array(np.tile(explained, len(batch))), pa.array(np.full(len(each), identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining vector and component; see SCHEMA.

    Vectors that are null or empty, or hold null, NaN, infinite or larger numbers than
    2**52, are dropped; so is nothing else: rows of a null or repeated id are kept and
    count each. Vectors of each dimension are a space of their own. There are at most
    as many components as dimensions, and none whose eigenvalue is under LEAST_SHARE of
    the largest: a space of one vector, or of equal ones, gives no rows. The sign of a
    component is arbitrary; of equal eigenvalues any basis. ``deviation`` is NULL where
    38 digits do not hold it. Other columns are ignored; an empty table gives no row.
    """
    spark = vectors.sparkSession
    x = common.materialize(numbers(vectors, id_col, vector_col), "whitening-numbers")
    out = spark.createDataFrame([], SCHEMA)
    for space in spaces(x):
        own = x.filter(F.col("dim") == space.dim)
        rows = own.select("x")
        product = lambda b: _summed(rows.mapInArrow(_product(space, b), "place int, share double"), b.shape)  # noqa: B023, E731
        values, directions, _ = lobpcg(product, space.dim, min(components, space.dim))
        keep = values > LEAST_SHARE * values[0] if values[0] > 0 else np.zeros(len(values), bool)
        if not keep.any():
            continue
        values, directions = values[keep], directions[:, keep] / np.sqrt(values[keep])
        moments = _summed(rows.mapInArrow(_second_moments(space, directions), "place int, share double"), (len(values) + 2, len(values)))
        covariance, trace = moments[:-2] - np.outer(moments[-2], moments[-2]), moments[-1, 0]
        identity_error = float(np.abs(covariance - np.eye(len(values))).max())
        out = out.unionByName(own.select("vec_id", "x").mapInArrow(_rows(space, directions, values / trace, identity_error), SCHEMA))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op13: eight components of all embeddings; a deviation beyond a long is NULL."""
    found = whiten(common.table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
