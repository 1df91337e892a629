"""Mixing sources to target weights by temperature, as permutations of budgeted blocks.

A source's weight is its share of the tokens to the power ``alpha``, normalised.
With ``alpha`` 1 the sources keep their shares, with 0 all weigh the same; it is
bisected until the weights' entropy reaches a target, or to the lowest value at
which no document is repeated beyond a limit. Each source then deals out its
documents in one random order per epoch, and a block takes its part of the
block's tokens from each source; inside a block all sources are shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import words_of, written

#: A source's order is summed up in pieces of about so many documents.
PIECE_DOCS = 20_000
LEVELS = 6  # of the bisection, in one pass over the sources
PASSES = 5


@dataclass(frozen=True)
class Target:
    """``entropy``: a fraction of the highest possible one; ``max_repeats``: of any document.

    ``budget`` tokens come out; without it as many as hold every document once.
    """

    entropy: float | None = None
    max_repeats: float | None = 2.0
    budget: int | None = None


def shares(rows: DataFrame) -> DataFrame:
    """``source, tokens, docs, share``: a row per source; sources without tokens share 0."""
    by = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    share = f"tokens / {total}L" if total else "0D"
    return by.selectExpr("source", "tokens", "docs", f"{share} as share")


def exponent(by_source: DataFrame, target: Target) -> float:
    """The bisected ``alpha``; every pass over the sources settles ``LEVELS`` halvings."""
    some = by_source.where("share > 0")
    n, lowest, highest, tokens = some.selectExpr(
        "count(*)", "min(share)", "max(share)", "sum(tokens)"
    ).first()
    if n < 2:
        return 1.0

    def sums(alphas: list[float]) -> dict[float, tuple[float, float]]:
        """For each alpha the sum of share**alpha, and that of share**alpha * log(share)."""
        points = some.select("share", F.explode(F.array(*map(F.lit, alphas))).alias("a"))
        made = points.groupBy("a").agg(
            F.expr("sum(pow(share, a))"), F.expr("sum(pow(share, a) * ln(share))")
        )
        return {a: (z, s) for a, z, s in made.collect()}

    def flat_enough(a: float, z: float, s: float) -> bool:
        return math.log(z) - a * s / z >= target.entropy * math.log(n) - 1e-12

    def few_repeats(a: float, z: float, s: float) -> bool:
        most, least = lowest ** (a - 1) / z, highest ** (a - 1) / z  # weight over share
        times = most * target.budget / tokens if target.budget else most / least
        return times <= target.max_repeats + 1e-12

    def bisected(holds_high: bool, test) -> float:
        """Where ``test`` changes between 0 and 1; the end of the last interval that passes."""
        low, high = 0.0, 1.0
        ends = sums([low, high])
        if test(low, *ends[low]) and test(high, *ends[high]):
            return 0.0 if holds_high else 1.0
        if not test(high if holds_high else low, *ends[high if holds_high else low]):
            return 1.0 if holds_high else 0.0
        for _ in range(PASSES):
            steps = 1 << LEVELS
            grid = [low + (high - low) * i / steps for i in range(1, steps)]
            at = sums(grid)
            for _ in range(LEVELS):
                middle = grid[len(grid) // 2]
                if test(middle, *at[middle]) == holds_high:
                    high, grid = middle, grid[: len(grid) // 2]
                else:
                    low, grid = middle, grid[len(grid) // 2 + 1 :]
        return high if holds_high else low

    found = []
    if target.entropy is not None:
        found.append(bisected(False, flat_enough))
    if target.max_repeats is not None:
        found.append(bisected(True, few_repeats))
    return max(found, default=1.0)


def weights(rows: DataFrame, target: Target) -> DataFrame:
    """``source, tokens, docs, share, weight, quota``: tokens that each source is to give.

    A source without tokens has weight and quota 0.
    """
    by = written(shares(rows), "mixing-shares")
    alpha = exponent(by, target)
    raw = by.selectExpr("*", f"if(share > 0, pow(share, {alpha!r}D), 0D) as _p")
    z, most = raw.selectExpr("sum(_p)", "max(if(_p > 0, tokens / _p, 0D))").first()
    weight = f"_p / {z!r}D" if z else "0D"
    quota = f"_p / {z!r}D * {target.budget}D" if z and target.budget else f"_p * {most or 0.0!r}D"
    # Tokens are whole: a quota that only rounding takes off a whole number is that number.
    return raw.selectExpr(
        "source", "tokens", "docs", "share", f"{weight} as weight", f"{quota} as _q"
    ).selectExpr(
        "source", "tokens", "docs", "share", "weight",
        "if(abs(_q - round(_q)) <= 1e-12D * _q, round(_q), _q) as quota",
    )


def mixed(
    docs: DataFrame,
    target: Target | None = None,
    tokens: str | None = None,
    block_tokens: int = 1_000_000,
    seed: int = 17,
) -> DataFrame:
    """``doc_id, source, text_hash, n_tokens, epoch, block, position``: the mixture.

    ``tokens`` is SQL for the tokens of a row (default: the number of its
    words). A document stands in the mixture once per epoch that its source's
    quota reaches; the last one that begins within the quota is whole.
    ``position`` counts from 0 in each block.

    Rows that agree in ``doc_id``, ``source`` and text are one document, whose
    tokens count as often. Null ids and null sources are values like others. A
    null text has no words. Documents without tokens cost nothing and come
    along, also into the block, with the last one before them that has tokens;
    those of a source without tokens come once, in block 0. An empty table gives
    an empty one.

    No text is shuffled. A source's order is summed up in pieces, by the range
    of a hash, and so is a block's, so that no task holds more than a piece.
    """
    target = target or Target()
    counted = tokens or f"size({words_of('text')})"
    rows = docs.selectExpr(
        "cast(doc_id as bigint) as doc_id", "cast(source as string) as source",
        "xxhash64(coalesce(cast(text as string), '')) as text_hash",
        f"cast({counted} as bigint) as n_tokens",
    ).groupBy("doc_id", "source", "text_hash").agg(F.sum("n_tokens").alias("n_tokens"))
    rows = written(rows.withColumn("n_tokens", F.expr("coalesce(n_tokens, 0L)")), "mixing-rows")
    quotas = written(weights(rows, target), "mixing-quotas").withColumnRenamed("source", "_source")
    epochs = "greatest(1L, cast(ceil(quota / greatest(tokens, 1L)) as bigint))"
    dealt = (
        rows.join(quotas, F.expr("source <=> _source"))
        .selectExpr(
            "doc_id", "source", "text_hash", "n_tokens", "tokens", "quota",
            f"weight * {block_tokens} as _room",
            f"cast(ceil(docs / {PIECE_DOCS}) as bigint) as _pieces",
            f"explode(sequence(0L, {epochs} - 1L)) as epoch",
        )
        .selectExpr(
            "*",
            f"xxhash64({seed}L, epoch, doc_id, text_hash) as _order",
        )
        .selectExpr("*", "cast(pmod(shiftrightunsigned(_order, 1), _pieces) as bigint) as _piece")
    )
    ahead = dealt.groupBy("source", "epoch", "_piece").agg(
        F.sum("n_tokens").alias("_sum"),
        F.expr("max(struct(_order, doc_id, text_hash, n_tokens)) filter (where n_tokens > 0)")
        .getField("n_tokens").alias("_end"),
    )
    ahead = ahead.selectExpr(
        "source as _s", "epoch as _e", "_piece as _p",
        "sum(_sum) over (partition by source, epoch order by _piece) - _sum as _ahead",
        """last_value(_end) ignore nulls over (partition by source, epoch order by _piece
               rows between unbounded preceding and 1 preceding) as _earlier""",
    )
    placed = (
        dealt.selectExpr(
            "*",
            """sum(n_tokens) over (partition by source, epoch, _piece
                   order by _order, doc_id, text_hash rows unbounded preceding)
               - n_tokens as _inside""",
            """last_value(nullif(n_tokens, 0L)) ignore nulls over (partition by source, epoch, _piece
                   order by _order, doc_id, text_hash rows unbounded preceding) as _latest""",
        )
        .join(ahead, F.expr("source <=> _s and epoch = _e and _piece = _p"))
        .selectExpr("*", "epoch * tokens + _ahead + _inside as _end")
        # Where the document begins, or without tokens the last one before it that has some.
        .selectExpr(
            "*", "if(n_tokens > 0, _end, _end - coalesce(_latest, _earlier, 0L)) as _begin"
        )
        .where("_begin < quota or quota = 0")
        .selectExpr(
            "doc_id", "source", "text_hash", "n_tokens", "epoch",
            "if(_room > 0, cast(floor(_begin / _room) as bigint), 0L) as block",
        )
    )
    return _numbered(written(placed, "mixing-places"), seed)


def _numbered(placed: DataFrame, seed: int) -> DataFrame:
    """``position`` in each block, by a hash; a block of many documents is counted in pieces."""
    sizes = placed.groupBy("block").agg(F.count("*").alias("_n")).selectExpr(
        "block as _b", f"cast(ceil(_n / {PIECE_DOCS}) as bigint) as _cuts"
    )
    hashed = f"xxhash64({seed}L, block, epoch, doc_id, text_hash, source)"
    cut = placed.join(sizes, F.expr("block = _b")).selectExpr(
        *placed.columns, f"{hashed} as _order",
        f"cast(pmod(shiftrightunsigned({hashed}, 1), _cuts) as bigint) as _piece",
    )
    ahead = cut.groupBy("block", "_piece").agg(F.count("*").alias("_n")).selectExpr(
        "block as _b", "_piece as _p",
        "sum(_n) over (partition by block order by _piece) - _n as _ahead",
    )
    place = """row_number() over (partition by block, _piece
        order by _order, doc_id, epoch, text_hash, source)"""
    return cut.join(ahead, F.expr("block = _b and _piece = _p")).selectExpr(
        *placed.columns, f"cast(_ahead + {place} - 1 as bigint) as position"
    )


def mixed_documents(docs: DataFrame, target: Target | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mixture has them, in its order.

    Rows that agree in ``doc_id``, ``source`` and text come as often each. Null
    ids, sources and texts are values like others; rows without words come at
    least once. Other columns go along, whatever their names; an empty table
    gives an empty one.
    """
    places = mixed(docs, target).selectExpr(
        "doc_id as _id", "source as _source", "text_hash as _hash", "block", "position"
    )
    rows = docs.select(
        F.struct("*").alias("_row"),
        F.col("doc_id").cast("bigint").alias("_d"),
        F.col("source").cast("string").alias("_s"),
        F.expr("xxhash64(coalesce(cast(text as string), ''))").alias("_h"),
    )
    joined = rows.join(places, F.expr("_h = _hash and _d <=> _id and _s <=> _source"))
    ordered = joined.repartitionByRange("block", "position").sortWithinPartitions("block", "position")
    return ordered.select("_row.*")
