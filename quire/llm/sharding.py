"""Shards of nearly equal bytes: a minimax contiguous partition of groups of equal texts.

Groups are laid in a row by the hash of their text and cut into contiguous
shards. The least capacity is searched for by bisection: a capacity is feasible
if shards that are filled greedily, one after the other, take all groups. The
cuts are those of the least feasible capacity.

Sizes of groups are a table that may have billions of rows, so the search runs
on sums over ranges of the hash, some thousand at first. Taking each range as a
whole gives a capacity that is surely feasible, taking it as divisible one that
can't be undercut. Only ranges in which a cut may lie for a capacity between the
two are summed up more finely, until each of them is a single group. The result
is exact, and the driver only ever holds a bounded number of sums.

A group above an equal share of what is left gets a shard of its own, ahead of
the row; it would make every other shard as large as itself otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.tables import written

OVERHEAD = 8
#: The hash is cut into 2**12 ranges first, and a range into 2**6 more with each round.
FIRST_BITS = 12
MORE_BITS = 6
#: Rows in a row whose slots are numbered together, as a power of two.
PIECE_BITS = 14


@dataclass
class Ranges:
    """Hash ranges in order: first hash, bytes, whether it is one group only."""

    first: np.ndarray
    size: np.ndarray
    single: np.ndarray

    def __post_init__(self) -> None:
        self.ends = np.concatenate(([0], np.cumsum(self.size)))

    def filled(self, capacity: int, shards: int) -> list[int]:
        """First range after each shard, where a range is taken whole or not at all."""
        at, out = 0, []
        for _ in range(shards):
            at = int(np.searchsorted(self.ends, self.ends[at] + capacity, "right")) - 1
            out.append(at)
        return out

    def poured(self, capacity: int, shards: int) -> list[int]:
        """Range in which each shard ends, where all ranges but single groups are divisible."""
        level, out = 0, []
        for _ in range(shards):
            level = min(level + capacity, int(self.ends[-1]))
            at = int(np.searchsorted(self.ends, level, "right")) - 1
            if at < len(self.size) and self.single[at]:
                level = int(self.ends[at])
            out.append(at)
        return out

    def least(self, fill, shards: int, low: int) -> int:
        """The least capacity, ``low`` or more, with which ``fill`` reaches the end."""
        high = max(low, int(self.ends[-1]))
        while low < high:
            middle = (low + high) // 2
            if fill(middle, shards)[-1] >= len(self.size):
                high = middle
            else:
                low = middle + 1
        return low


def _summed(units: DataFrame, bits: int, within: tuple[int, list[int]] | None) -> list[tuple]:
    """Bytes and groups of the hash ranges of 2**bits values, of all or those in larger ranges."""
    if within:
        units = units.where(F.shiftright("unit", within[0]).isin(within[1]))
    sums = units.groupBy(F.shiftright("unit", bits).alias("at")).agg(
        F.sum("size").alias("size"), F.count("*").alias("n")
    )
    return [(r.at << bits, r["size"], r.n == 1) for r in sums.collect()]


def _ranges(rows: list[tuple]) -> Ranges:
    first, size, single = zip(*sorted(rows), strict=True)
    return Ranges(np.array(first, np.int64), np.array(size, np.int64), np.array(single))


def minimax_cuts(units: DataFrame, shards: int, largest: int) -> tuple[int, list[int]]:
    """The least capacity for ``shards`` shards, and the first hash of every shard but the first.

    ``units`` has columns ``unit`` (distinct hashes) and ``size``; ``largest`` is
    the greatest size. Shards that get nothing have no cut.
    """
    bits = 64 - FIRST_BITS
    ranges = _ranges(_summed(units, bits, None))
    while True:
        low = ranges.least(ranges.poured, shards, largest)
        high = ranges.least(ranges.filled, shards, largest)
        open_ = ~ranges.single & (ranges.size > low)
        span = zip(ranges.filled(low, shards), ranges.poured(high, shards), strict=True)
        for begin, end in span:
            open_[begin : end + 1] |= ~ranges.single[begin : end + 1]
        if not open_.any():
            cuts = [c for c in ranges.filled(high, shards)[:-1] if c < len(ranges.size)]
            return high, [int(x) for x in ranges.first[cuts]]
        finer = max(0, bits - MORE_BITS)
        inside = (bits, [int(x) >> bits for x in ranges.first[open_]])
        kept = zip(ranges.first[~open_], ranges.size[~open_], ranges.single[~open_], strict=True)
        more = _summed(units, finer, inside)
        if finer == 0:
            more = [(first, size, True) for first, size, _ in more]
        ranges = _ranges([(int(a), int(b), bool(c)) for a, b, c in kept] + more)
        bits = finer


def cut(units: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """Hashes of the groups with a shard of their own, and the first hashes of the other shards."""
    total = units.agg(F.sum("size")).first()[0]
    own: list[int] = []
    if total is None:
        return own, []
    top = units.orderBy(F.desc("size"), "unit").limit(shards).collect()
    largest = 0
    for group in top:
        largest = group["size"]
        if len(own) == shards - 1 or largest * (shards - len(own)) <= total:
            break
        own.append(group["unit"])
        total -= largest
    if total == 0:
        return own, []
    rest = units.where(~F.col("unit").isin(own)) if own else units
    return own, minimax_cuts(rest, shards - len(own), largest)[1]


def _shard(own: list[int], cuts: list[int]) -> Column:
    """The shard of a hash: at most as many comparisons as there are shards."""
    unit = F.col("unit")
    after = sum(((unit >= c).cast("int") for c in cuts), F.lit(len(own)))
    for i, hash_ in enumerate(own):
        after = F.when(unit == hash_, i).otherwise(after)
    return after.cast("int")


def _with_slots(rows: DataFrame) -> DataFrame:
    """``slot``: rows of a shard counted from 0 in the order of ``row_no``.

    Rows are counted in pieces of the order in which they were written, so that
    no shard and no text is numbered by one task; what comes before a piece is
    the sum over earlier pieces of its part, and over earlier parts.
    """
    placed = rows.withColumn("part", F.shiftright("row_no", 33)).withColumn(
        "piece", F.shiftright("row_no", PIECE_BITS)
    )
    ahead = (Window.unboundedPreceding, -1)
    pieces = placed.groupBy("shard", "part", "piece").agg(F.count("*").alias("n"))
    parts = pieces.groupBy("shard", "part").agg(F.sum("n").alias("n"))
    by_part = Window.partitionBy("shard").orderBy("part").rowsBetween(*ahead)
    parts = parts.select(
        F.col("shard").alias("s"), F.col("part").alias("p"),
        F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("base"),
    )
    by_piece = Window.partitionBy("shard", "part").orderBy("piece").rowsBetween(*ahead)
    within = F.coalesce(F.sum("n").over(by_piece), F.lit(0))
    pieces = pieces.withColumn("within", within).join(
        parts, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p"))
    )
    starts = pieces.select(
        F.col("shard").alias("s"), F.col("piece").alias("q"),
        (F.col("base") + F.col("within")).alias("start"),
    )
    order = Window.partitionBy("shard", "piece").orderBy("row_no")
    joined = placed.join(starts, (F.col("shard") == F.col("s")) & (F.col("piece") == F.col("q")))
    return joined.withColumn("slot", F.col("start") + F.row_number().over(order) - 1)


def sharded(docs: DataFrame, shards: int, overhead: int = OVERHEAD) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row.

    ``size`` is the UTF-8 bytes of the text and ``overhead``, ``text_crc32`` the
    unsigned CRC-32 of these bytes. Rows of equal text are never parted; the
    greatest shard is as small as contiguous cuts allow, shards of one group
    that is above an equal share aside. ``slot`` counts the rows of a shard from
    0 without gaps. Fewer groups than shards leave the last shards empty.

    A null text counts as an empty one, in one group with these. Null ids and
    repeated rows are rows of their own, an empty table has no rows, and other
    columns are not looked at. Only hashes and sizes are shuffled, not texts;
    equal texts are added up ahead of the shuffle.
    """
    if not 1 <= shards <= 1024:
        raise ValueError("shards must be from 1 to 1024")
    text = "coalesce(cast(text as string), '')"
    rows = docs.selectExpr(
        "cast(doc_id as bigint) as doc_id", f"{text} as text"
    ).selectExpr(
        "doc_id", f"cast(octet_length(text) as bigint) + {int(overhead)} as size",
        "crc32(text) as text_crc32", "xxhash64(text) as unit",
        "monotonically_increasing_id() as row_no",
    )
    rows = written(rows, "sizes")
    units = written(rows.groupBy("unit").agg(F.sum("size").alias("size")), "groups")
    own, cuts = cut(units, shards)
    return _with_slots(rows.withColumn("shard", _shard(own, cuts))).select(
        "doc_id", "size", "text_crc32", "shard", "slot"
    )
