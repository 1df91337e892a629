"""Dealing few and costly rows out evenly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dealt(rows: DataFrame, key: str, tasks: int) -> DataFrame:
    """The rows in ``tasks`` partitions that differ by few rows, the same at every run.

    Rows are counted off inside groups of their key's hash, and each group
    begins at another partition; hashing alone leaves partitions empty where
    rows are few.
    """
    groups = max(1, tasks // 8)
    hashed = rows.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)))
    order = Window.partitionBy("_group").orderBy(key)
    part = (F.row_number().over(order) - 1 + F.col("_group") * 7919) % tasks
    numbered = hashed.withColumn("_part", part.cast("int"))
    return numbered.repartitionById(tasks, F.col("_part")).drop("_group", "_part")


#: Hash groups in which weights are summed up, a power of two.
GROUPS = 1024


def dealt_by_weight(
    rows: DataFrame, key: str, weight: str, tasks: Callable[[int, float], int]
) -> DataFrame:
    """The rows in partitions of nearly equal weight, the same at every run.

    ``weight`` is SQL for what a row costs, ``tasks`` tells the number of
    partitions for a number of rows and their whole weight. Inside groups of
    their key's hash rows are laid one behind the other and cut at equal weights;
    a group has as many partitions as its share asks for. No partition exceeds
    an equal share by more than about its heaviest row, which can't be cut.
    ``rows`` are looked at twice: give a table.
    """
    weighed = rows.withColumn("_weight", F.expr(f"cast({weight} as double)"))
    weighed = weighed.withColumn("_hash", F.xxhash64(key))
    fine = F.shiftrightunsigned("_hash", 64 - (GROUPS.bit_length() - 1))
    sums = weighed.groupBy(fine.alias("g")).agg(F.count("*").alias("n"), F.sum("_weight").alias("w"))
    found = {r.g: (r.n, r.w) for r in sums.collect()}
    total = sum(w for _, w in found.values())
    parts = max(1, tasks(sum(n for n, _ in found.values()), total))
    # Few partitions: fewer groups, so that each of them has several.
    groups = min(GROUPS, 1 << max(0, (parts // 8).bit_length() - 1))
    merged = [0.0] * groups
    for g, (_, w) in found.items():
        merged[g * groups // GROUPS] += w
    share = total / parts if total else 1.0
    counts = [max(1, round(w / share)) for w in merged]
    starts = [sum(counts[:i]) for i in range(groups)]
    group = f"cast(shiftrightunsigned(_hash, {64 - groups.bit_length() + 1}) as int)" if groups > 1 else "0"
    array = lambda xs: f"array({', '.join(map(str, xs))})"
    order = Window.partitionBy("_group").orderBy("_hash", key).rowsBetween(Window.unboundedPreceding, -1)
    sizes = array(f"{max(w, 1e-9)!r}D" for w in merged)
    placed = (
        weighed.withColumn("_group", F.expr(group))
        .withColumn("_ahead", F.coalesce(F.sum("_weight").over(order), F.lit(0.0)))
        .withColumn("_part", F.expr(
            f"{array(starts)}[_group] + least({array(counts)}[_group] - 1, "
            f"cast(floor(_ahead / {sizes}[_group] * {array(counts)}[_group]) as int))"))
    )
    spread = placed.repartitionById(sum(counts), F.col("_part"))
    return spread.drop("_weight", "_hash", "_group", "_ahead", "_part")
