"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowmill.llm import common

ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())


def _shuffled_anew(least: DataFrame) -> DataFrame:
    """The same rows by an expression of u, which no shuffle of the aggregate serves.

    Both sides of the join are then shuffles of their own, and the adaptive skew join
    can split a hub's edges.
    """
    return least.select(F.coalesce("u", "m").alias("u"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _shuffled_anew(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, are tied to the smallest of them."""
    least = _shuffled_anew(edges.groupBy("u").agg(F.min("v").alias("m")))
    tied = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id) for every id that has a link; component_id is its smallest id.

    Ids may be of any type that orders. Edges may be repeated, reversed or loops; those
    with a null end are ignored. Aggregates combine before they shuffle, and a hub's
    rows are split by the adaptive skew join, so that no component meets in one task.
    Each round is written to the shared folder, which cuts the lineage, and the round
    before it is removed. No edge gives no row.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} is not null and {b} is not null and u > v")
    state, folder = common.stored(pairs.distinct(), "components")
    seen = _state(state)
    for _ in range(ROUNDS):
        if not seen[0]:
            break
        before = folder
        state, folder = common.stored(_small_star(_large_star(state)).distinct(), "components")
        common.discard(before)
        now = _state(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    member = state.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return member.unionByName(state.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
