"""Near-duplicate vectors: random-hyperplane tables, exact cosine, components.

Each table hashes a vector to the signs of random hyperplanes. Two vectors at the
threshold agree in one sign with probability 1 - angle / pi. The number of signs of
a table follows from the number of vectors, so that unlike vectors rarely share a
bucket however many there are, and the number of tables follows from that, so that
all of them miss a pair at the threshold with probability 0.0005, and closer pairs
less often. Vectors that meet in a bucket are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowmill.llm import common
from windowmill.llm.components import components

SEED, MISSED = 20240229, 0.0005
#: Signs of a table at least and at most.
LEAST_BITS, MOST_BITS = 8, 40
BLOCK = 1024
_STRIP = 256


def tables(n: int, threshold: float, missed: float = MISSED) -> tuple[int, int]:
    """(tables, signs of each) for n vectors: a bucket holds about one unlike vector."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, n)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(missed) / math.log1p(-agree)), bits


def _unit(raw: list[bytes] | np.ndarray, dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), "<f8").reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _codes(count: int, bits: int):
    """cls, dim, copies, vector to these with the codes of all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, planes = 1 << np.arange(bits, dtype=np.int64), {}
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng(SEED + dim).standard_normal((dim, count * bits))
                vector = np.array(part["vector"].flatten().to_numpy(), "<f8").tobytes()
                signs = _unit([vector], dim) @ planes[dim] > 0
                codes = (signs.reshape(-1, count, bits) * weights).sum(axis=2)
                raw = [vector[i : i + 8 * dim] for i in range(0, len(vector), 8 * dim)]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, count, dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part["cls"], part["dim"], part["copies"], pa.array([c.astype("<i8").tobytes() for c in codes], pa.binary()), pa.array(raw, pa.binary()), listed], ["cls", "dim", "copies", "codes", "raw", "code"]
                )

    return run


def _compare(threshold: float, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for table, _, dim, lo, hi, own, cls, copies, codes, raw in common.grouped(batches, 5):
            t, d = int(table[0]), int(dim[0])
            unit, code = _unit(raw, d), np.frombuffer(b"".join(codes), "<i8").reshape(-1, count)[:, :t]
            left = np.flatnonzero(own == lo[0])
            right = left if lo[0] == hi[0] else np.flatnonzero(own == hi[0])
            links, root = np.zeros(len(cls), np.int64), cls.astype(np.int64).copy()
            pairs = []
            for a in range(0, len(left), _STRIP):
                i, j = np.nonzero(unit[left[a : a + _STRIP]] @ unit[right].T >= threshold)
                i, j = left[a + i], right[j]
                keep = i < j if left is right else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                pairs.append((i, j))
                if t:  # a pair counts in the first table that it shares
                    first = np.concatenate([~(code[i[k : k + 65536]] == code[j[k : k + 65536]]).any(axis=1) for k in range(0, len(i), 65536)])
                    i, j = i[first], j[first]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
            if not pairs:
                continue
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            while True:  # the smallest id that each row reaches within this block
                low = np.minimum(root[i], root[j])
                if (low == root[i]).all() and (low == root[j]).all():
                    break
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
            at = np.flatnonzero((links > 0) | (root != cls))
            out.append(np.stack([cls[at].astype(np.int64), root[at], links[at]]))
            if sum(x.shape[1] for x in out) >= 8192:
                yield _links(out)
                out = []
        if out:
            yield _links(out)

    return run


def _links(out: list[np.ndarray]) -> pa.RecordBatch:
    cls, root, links = np.concatenate(out, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(root), pa.array(links)], ["cls", "root", "links"])


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Exact copies of a vector form one class with a count and a number of its own, so
    that they are never paired among themselves. Buckets are split into pairs of
    bounded blocks. A block adds up the links of each class and gives one edge to the
    smallest class that it reaches there: its output grows with the rows, not the pairs.

    A vector that is null, empty, zero or has null or non-finite components, and
    a row of a null id, links with nothing: n_links 0, its own component, kept.
    Vectors of different dimension don't link. Where an id is repeated, each of its
    rows links by its own vector; component_id is the smallest id of any row that a
    row reaches. Other columns are ignored; an empty table gives no row.
    """
    numbers = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), numbers.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    keyed = own.select("vec_id", "vector", valid.alias("valid")).withColumns(
        {"key_a": F.when(F.col("valid"), F.xxhash64("vector")), "key_b": F.when(F.col("valid"), F.xxhash64(F.lit(7), "vector"))}
    )
    classes = keyed.filter("valid").groupBy("key_a", "key_b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = common.materialize(classes.withColumns({"dim": F.size("vector"), "cls": F.monotonically_increasing_id()}), "vector-classes")
    count, bits = tables(classes.count(), threshold)
    coded = classes.select("cls", "dim", "copies", "vector").mapInArrow(_codes(count, bits), "cls long, dim int, copies long, codes binary, raw binary, code array<long>")
    coded = common.materialize(coded, "vector-codes")
    rows = coded.select("cls", "dim", F.posexplode("code").alias("table", "bucket"))
    dealt = common.blocks(rows, ["table", "bucket", "dim"], "cls", F.lit(1), BLOCK)
    full = dealt.join(coded.select("cls", "copies", "codes", "raw"), "cls")
    keys = ["table", "bucket", "dim", "lo", "hi"]
    n = common.partitions(vectors.sparkSession)
    full = full.select(*keys, "own", "cls", "copies", "codes", "raw").repartition(n, *keys).sortWithinPartitions(*keys)
    found = common.materialize(full.mapInArrow(_compare(threshold, count), "cls long, root long, links long"), "vector-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    member = components(found, "cls", "root").select(F.col("id").alias("cls"), F.col("component_id").alias("root"))
    member = common.materialize(classes.select("cls", "rep").join(member, "cls").select("cls", "root", "rep"), "vector-members")
    member = member.join(member.groupBy("root").agg(F.min("rep").alias("lowest")), "root").select("cls", "lowest")
    by_class = classes.select("key_a", "key_b", "cls", "rep", "copies").join(links, "cls", "left").join(member, "cls", "left")
    by_class = by_class.select("key_a", "key_b", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lowest", "rep").alias("component_id"))
    out = keyed.select("vec_id", "key_a", "key_b").join(by_class, ["key_a", "key_b"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: links and components of all embeddings at cosine 0.95."""
    return near_vectors(common.table(spark, sf_dir, "embeddings"))
