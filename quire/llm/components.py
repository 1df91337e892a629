"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import written

MAX_ROUNDS = 60


def _to_lowest(pairs: DataFrame) -> DataFrame:
    """``u, v, low``: beside each pair the lowest of ``u`` and all that ``u`` is paired with."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select(F.col("u").alias("_u"), F.least("u", "m").alias("low"))
    return pairs.join(low, F.col("u") == F.col("_u")).select("u", "v", "low")


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the lowest node of its component for every node in ``links``.

    ``links`` has columns ``a, b`` (bigint); nulls and loops are left out.
    Every round joins each node's neighbours to the lowest of them: first the
    higher ones, then the lower ones, until nothing changes. Rounds grow with
    the logarithm of the longest path, rows never exceed the links. Each round
    is written to the shared folder, so a lost executor costs one round at most.
    """
    stars = written(
        links.where("a <> b").select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
        ).distinct(),
        "links",
    )
    before = None
    for _ in range(MAX_ROUNDS):
        mark = stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == before or not mark[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        before = mark
        both = stars.unionByName(stars.selectExpr("v as u", "u as v"))
        higher = _to_lowest(both).where("v > u").selectExpr("v as u", "low as v").distinct()
        lower = _to_lowest(higher)
        moved = lower.where("v <> low").selectExpr("v as u", "low as v")
        stars = written(
            moved.unionByName(lower.selectExpr("u", "low as v")).where("u <> v").distinct(), "links"
        )
    raise RuntimeError(f"the components did not settle in {MAX_ROUNDS} rounds")
