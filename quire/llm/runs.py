"""Periodic runs of words in every text, by joining suffix classes in falling order of LCP.

The suffixes of a text that share their first words form classes, which merge
as fewer words are asked for. Neighbours in suffix order are edges weighted by
their longest common prefix (LCP), and Kruskal's algorithm takes them from the
greatest on; the positions of a class are kept in order. Where two positions,
``d`` apart, become neighbours in their class at LCP ``l >= d``, the text has
period ``d`` from the first of them on for ``d + l`` words. Such a seed is the
whole run if the words ahead of both positions differ.

A run of period q and length >= 4q is always seeded by its first position s and
s + q: their LCP is length - q, and a position of their class between them would
give the run a period below q. So no run is missed, every one is found once, and
its period is its smallest. Classes are only followed down to the least LCP that
a run can have, and texts without such a repetition are never sorted.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import encoded, slices, text_rows
from quire.llm.hashing import mixed, runs, words_of
from quire.llm.tables import words_of as words_sql

MIN_LENGTH = 6
MIN_REPEATS = 4
SCHEMA = "runs array<struct<start: bigint, length: bigint, period: bigint>>"
_RUNS = pa.list_(
    pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
)


def least_lcp(min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> int:
    """The least LCP, length - period, of any run."""
    periods = range(1, max(2, min_length))
    return min(max(min_length - q, (min_repeats - 1) * q) for q in periods)


def _repeated(h: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """Positions whose next k words stand elsewhere in their text as well.

    Equal hashes of different words only add positions, which the sorting parts.
    """
    if len(h) < k:
        return np.zeros(0, np.int64)
    sizes = np.diff(begin)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(begin[1:], sizes) - np.arange(len(h))
    inside = np.flatnonzero(left[: len(h) - k + 1] >= k)
    keys = mixed(runs(h, k)[inside] + mixed(doc[inside] + 1))
    in_order = np.sort(keys)
    twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return inside[twice[at] == keys]


def _levels(symbols: np.ndarray) -> list[np.ndarray]:
    """For t = 0, 1, ...: ranks of all positions by their first 2**t symbols, until all differ."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.concatenate(([True], symbols[order][1:] != symbols[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels = [rank.astype(np.int32)]
    tied = _tied(rank, np.arange(n))
    step = 1
    while len(tied):
        # A tied position has step more symbols behind it: the last one of a text is its own.
        old, then = rank[tied], rank[np.minimum(tied + step, n - 1)]
        by = np.lexsort((then, old))
        old, then, tied = old[by], then[by], tied[by]
        place = np.arange(len(tied))
        group = np.concatenate(([True], old[1:] != old[:-1]))
        new = group | np.concatenate(([True], then[1:] != then[:-1]))
        from_group = np.maximum.accumulate(np.where(group, place, 0))
        rank[tied] = old + np.maximum.accumulate(np.where(new, place, 0)) - from_group
        levels.append(rank.astype(np.int32))
        tied = _tied(rank, tied)
        step *= 2
    return levels


def _tied(rank: np.ndarray, among: np.ndarray) -> np.ndarray:
    count = np.bincount(rank[among], minlength=len(rank))
    return among[count[rank[among]] > 1]


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix at the positions of each pair."""
    n = np.zeros(len(a), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        n += (levels[t][a + n] == levels[t][b + n]).astype(np.int64) << t
    return n


def _seeds(
    edges: Iterator[tuple[int, int, int]], size: int, min_length: int, min_repeats: int
) -> list[tuple[int, int, int]]:
    """Positions that become neighbours in their class close enough for a run, with the LCP.

    ``edges`` are pairs of positions below ``size``, by falling LCP. Members of
    the smaller class go over to the greater one, each to its place.
    """
    owner: list[list[int] | None] = [None] * size
    found = []
    for a, b, lcp in edges:
        big, small = owner[a] or [a], owner[b] or [b]
        if len(big) < len(small):
            big, small = small, big
        reach = min(lcp // (min_repeats - 1), lcp) if min_repeats > 1 else lcp
        least = min_length - lcp
        owner[big[0]] = big
        last = -1
        for i, x in enumerate(small):
            owner[x] = big
            at = bisect_left(big, x)
            if at and big[at - 1] != last and least <= x - big[at - 1] <= reach:
                found.append((big[at - 1], x, lcp))
            if at == len(big):
                big.append(x)
            else:
                y = big[at]
                own_next = i + 1 < len(small) and small[i + 1] < y
                if not own_next and least <= y - x <= reach:
                    found.append((x, y, lcp))
                big.insert(at, x)
            last = x
    return found


def runs_of(
    h: np.ndarray,
    begin: np.ndarray,
    min_length: int = MIN_LENGTH,
    min_repeats: int = MIN_REPEATS,
) -> np.ndarray:
    """Rows ``text, start, length, period`` of all runs, in that order, start counted in its text.

    ``h`` has the hashes of the words of many texts; the words of text i are
    those from ``begin[i]`` to before ``begin[i + 1]``.
    """
    none = np.zeros((0, 4), np.int64)
    k = least_lcp(min_length, min_repeats)
    hits = _repeated(h, begin, k)
    if not len(hits):
        return none
    # Only texts with repetitions, each followed by a symbol of its own; words of
    # different texts are different symbols.
    chosen = np.unique(np.searchsorted(begin, hits, "right") - 1)
    sizes = (begin[1:] - begin[:-1])[chosen]
    shift = begin[chosen] - np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    text = np.repeat(np.arange(len(chosen)), sizes + 1)
    place = np.arange(len(text)) + shift[text]
    is_end = np.zeros(len(text), bool)
    is_end[np.cumsum(sizes + 1) - 1] = True
    salt = mixed(text + 1)
    symbols = np.where(is_end, salt, mixed(h[np.where(is_end, 0, place)] + salt))
    levels = _levels(symbols)
    own = np.searchsorted(begin[chosen], hits, "right") - 1
    at = hits - shift[own]
    at = at[np.argsort(levels[-1][at])]
    a, b = np.minimum(at[:-1], at[1:]), np.maximum(at[:-1], at[1:])
    lcp = _common(levels, a, b)
    keep = lcp >= k
    a, b, lcp = a[keep], b[keep], lcp[keep]
    by = np.argsort(-lcp, kind="stable")
    edges = zip(a[by].tolist(), b[by].tolist(), lcp[by].tolist(), strict=True)
    seeds = _seeds(edges, len(text), min_length, min_repeats)
    if not seeds:
        return none
    i, j, n = np.array(seeds, np.int64).T
    first = np.concatenate(([True], is_end[:-1]))  # no word of the same text ahead
    whole = first[i] | (symbols[i - 1] != symbols[j - 1])
    i, j, n = i[whole], j[whole], n[whole]
    start = i + shift[text[i]] - begin[chosen[text[i]]]
    rows = np.stack([chosen[text[i]], start, j - i + n, j - i], axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _batch(batch: pa.RecordBatch, min_length: int, min_repeats: int) -> pa.RecordBatch:
    texts = encoded(batch.column(1))
    h, begin = words_of(texts)
    found = runs_of(h, begin, min_length, min_repeats)
    first = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    collapsed = []
    for i, text in enumerate(texts):
        words = text.split()
        if first[i] < first[i + 1]:
            mark = np.zeros(len(words) + 1, np.int64)
            _, start, length, period = found[first[i] : first[i + 1]].T
            np.add.at(mark, start + period, 1)
            np.add.at(mark, start + length, -1)
            kept = np.cumsum(mark)[:-1] == 0
            words = [w for w, stays in zip(words, kept.tolist(), strict=True) if stays]
        collapsed.append(b" ".join(words))
    structs = pa.StructArray.from_arrays(
        [pa.array(found[:, c]) for c in (1, 2, 3)], ["start", "length", "period"]
    )
    lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), structs).cast(_RUNS)
    texts_out = pa.array(collapsed, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [batch.column(0), lists, texts_out], ["doc_id", "runs", "collapsed"]
    )


def periodic_runs(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS
) -> DataFrame:
    """``doc_id, runs, collapsed``: the periodic runs of every text, and the text without them.

    Words are what stands between ASCII white space, numbered from 0. A run is
    a stretch of at least ``min_length`` words that holds its smallest period at
    least ``min_repeats`` times (4 or more: fewer need not have a seed of their
    own) and that neither neighbouring word goes on. ``runs`` has them by start
    and period. ``collapsed`` has the words, joined by one blank, that no run
    contains after its first period.

    A row for each row of ``docs``: null ids and repeated rows stay as they are,
    a null or empty text has no runs and an empty ``collapsed``. Other columns
    are not looked at. Nothing is shuffled; texts are worked on in slices of
    some megabytes, a longer text in one by itself.
    """
    if min_repeats < 4 or min_length < 2:
        raise ValueError("runs need at least 4 repeats and 2 words")

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _batch(batch, min_length, min_repeats)

    schema = f"doc_id bigint, {SCHEMA}, collapsed string"
    return text_rows(docs).mapInArrow(batches_of, schema)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a tenth of the texts made periodic from some word on.

    With h the CRC-32 of the decimal id and g = h div 10, a text of n > 0 words
    whose h is divisible by 10 repeats from word a = g % n on the 1 + (n - a) div
    (3 + g % 8) words that begin there. Rows without an id stay as they are.
    """
    hashed = "crc32(cast(cast(doc_id as bigint) as string))"
    at = f"cast(({hashed} div 10) % size(w) as int)"
    period = f"cast(1 + (size(w) - {at}) div (3 + ({hashed} div 10) % 8) as int)"
    # One-item arrays name the words, the start and the period, each made once.
    made = f"""get(transform(filter(array({words_sql("text")}), w -> size(w) > 0), w ->
        get(transform(array(struct({at} as a, {period} as p)), x -> array_join(concat(
            slice(w, 1, x.a),
            transform(sequence(x.a, size(w) - 1), i -> get(w, x.a + (i - x.a) % x.p))
        ), ' ')), 0)), 0)"""
    changed = F.expr(f"if({hashed} % 10 = 0, coalesce({made}, text), text)")
    return docs.select("doc_id", changed.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of the rows of ``periodic_runs``.

    Of runs of equal length the first one counts, of these the one of least
    period; without a run its four columns are null.
    """
    longest = "array_min(transform(runs, r -> struct(-r.length as n, r.start, r.period)))"
    printed = "transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n'))"
    return found.selectExpr(
        "doc_id", f"{longest} as top", f"sha2(array_join({printed}, ''), 256) as runs_sha256",
        "cast(size(runs) as bigint) as n_runs", "sha2(collapsed, 256) as collapsed_sha256",
    ).selectExpr(
        "doc_id", "n_runs", "top.start as start", "-top.n as length", "top.period as period",
        "(1000 * -top.n) div top.period as exponent_milli", "runs_sha256", "collapsed_sha256",
    )
