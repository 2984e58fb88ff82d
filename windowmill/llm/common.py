"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by spark.checkpoint.dir.

    Only where the setting is absent and Spark runs on one machine, as in tests, a
    local folder is made; a cluster without the setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "windowmill-shared")
        os.makedirs(root, exist_ok=True)
        root = f"file://{root}"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write to the shared folder and read back; also the folder, for ``discard``."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    return stored(df, label)[0]


def broadcast_if_small(df: DataFrame, rows_: int) -> DataFrame:
    """A hint only where this very table has at most so many rows; it should be cheap to count."""
    return F.broadcast(df) if df.limit(rows_ + 1).count() <= rows_ else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, usable on driver and executors alike."""
    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return pafs.FileSystem.from_uri(uri)


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def discard(df_path: str) -> None:
    """Remove a scratch folder that no later step reads."""
    fs, path = filesystem(df_path)
    fs.delete_dir(path)


def blocks(rows_: DataFrame, keys: list[str], item: str, weight, limit: int) -> DataFrame:
    """Deal the members of each group to pairs of bounded parts.

    Groups of one row go. A group whose weight passes the limit is split by a
    hash of the item; a row goes to each pair of parts (lo, hi) that holds its
    own, so that every two rows of a group meet in at least one pair and no pair
    holds more than about two limits, however large the group. The sizes are written
    first, so that the join with them can split the rows of a large group.
    """
    sizes = rows_.groupBy(*keys).agg(F.count("*").alias("_rows"), F.sum(weight).alias("_weight")).filter("_rows > 1")
    sizes = sizes.select(*keys, F.greatest(F.lit(1), F.ceil(F.col("_weight") / limit)).cast("int").alias("_parts"))
    sizes = materialize(sizes, "group-sizes")
    own = F.pmod(F.xxhash64(item), F.col("_parts")).cast("int")
    dealt = rows_.join(sizes, keys).withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return dealt.withColumn("lo", F.least("own", "_other")).withColumn("hi", F.greatest("own", "_other")).drop("_other", "_parts")


def grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list]:
    """The columns of each run of equal leading keys, as arrays; input is sorted by them."""
    import numpy as np

    kept: list | None = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
        change = np.zeros(len(cols[0]) - 1, bool)
        for c in cols[:keys]:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield [c[a:b] for c in cols]
        kept = [c[cuts[-1] :] for c in cols]
    if kept is not None:
        yield kept
