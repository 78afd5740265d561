"""Connected components of a link table by alternating large and small stars.

Every round is a few joins and aggregates; tables of a round are checkpointed in the shared folder, so a hub
with very many links is an ordinary skewed join, which the adaptive planner can split. Nothing but one row of
sums per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _lowest(pairs: DataFrame) -> DataFrame:
    return cut(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each node with a link to another node, the smallest node reachable.

    Repeated, reversed and self links are allowed; rows with a null end are ignored. Nodes are any ordered type.
    """
    pairs = cut(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    seen = None
    while True:
        state = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == state or not state["n"]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        seen = state
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(
            both.join(_lowest(both), "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = _lowest(large)
        pairs = cut(
            large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
