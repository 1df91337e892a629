"""Arrays to rows, and searches in sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_of(df: DataFrame, keep: list[str | Column], array: str, item: str, pos: str) -> DataFrame:
    """One row per item of the array column ``array``, with its position.

    An inner explode of a computed array makes the optimizer test the size of
    that array in a filter of its own, which computes it a second time (and
    pushes it below the projection that shares its parts). The outer form
    followed by a null test does not.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(
        F.col(pos).isNotNull()
    )


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed before anything else looks at it.

    A filter on a computed column is pushed below the projections that compute
    it, repeating their work inside the predicate; a filter on the output of a
    generator is not.
    """
    columns = ", ".join(f"`{c}`" for c in df.columns)
    return df.selectExpr(f"inline_outer(array(struct({columns})))")


def lower_bound(items: str, field: str, value: str) -> str:
    """Index of the first of ``items``, sorted by ``field``, that isn't below ``value``."""
    middle = "shiftright(s.low + s.high, 1)"
    return (
        f"aggregate(sequence(0, cast(log2(size({items}) + 1) as int)), "
        f"named_struct('low', 0, 'high', size({items})), (s, i) -> case when s.low >= s.high then s "
        f"when {items}[{middle}].{field} < {value} "
        f"then named_struct('low', {middle} + 1, 'high', s.high) "
        f"else named_struct('low', s.low, 'high', {middle}) end, s -> s.low)"
    )
