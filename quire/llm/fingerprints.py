"""Homomorphic multiset fingerprints: sums of wide vectors hashed from paragraphs.

A paragraph is what stands between two line ends. Its vector has 16 lanes of 64
bits, hashed from its bytes, and 256 lanes of 32 bits, into which each of its
words is hashed together with the word ahead of it, as +1 or -1. A text's
fingerprint is the sum of its paragraphs' vectors, lane by lane modulo 2**64 and
2**32, which no pair of words reaches in a text of less than 2**31 words. So the
order of paragraphs doesn't matter, and a paragraph is inserted or deleted by
adding or subtracting its vector.

Texts with the same paragraphs have equal fingerprints; others differ but for
odds of 2**-64 or less. The small lanes keep the size of a difference: half the
squared distance of two fingerprints estimates how many words were exchanged.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import text_rows
from quire.llm.hashing import mixed, words

WIDE, SMALL = 16, 256
_PAIR = np.uint64(0x9E3779B97F4A7C15)
Fingerprint = tuple[np.ndarray, np.ndarray]


def fingerprint(text: str) -> Fingerprint:
    data = text.encode()
    digests = b"".join(hashlib.shake_128(p).digest(WIDE * 8) for p in data.split(b"\n"))
    wide = np.frombuffer(digests, "<u8").reshape(-1, WIDE).sum(axis=0, dtype=np.uint64)
    h, starts, _ = words(data)
    small = np.zeros(SMALL, np.uint32)
    if len(h):
        line = np.searchsorted(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), starts)
        ahead = np.zeros_like(h)
        ahead[1:] = np.where(line[1:] == line[:-1], h[:-1], np.uint64(0))
        f = mixed(h * _PAIR + ahead)
        sign = 1 - 2 * ((f >> np.uint64(8)) & np.uint64(1)).astype(np.int64)
        lanes = np.bincount((f & np.uint64(SMALL - 1)).astype(np.int64), sign, SMALL)
        small = lanes.astype(np.int64).astype(np.uint32)
    return wide, small


def inserted(whole: Fingerprint, part: Fingerprint) -> Fingerprint:
    """The fingerprint with the paragraphs of ``part`` added."""
    return whole[0] + part[0], whole[1] + part[1]


def deleted(whole: Fingerprint, part: Fingerprint) -> Fingerprint:
    """The fingerprint with the paragraphs of ``part`` taken away."""
    return whole[0] - part[0], whole[1] - part[1]


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """1 for equal fingerprints, about the shared part of the words for others, 0 for none."""
    if np.array_equal(a[0], b[0]):
        return 1.0
    square = lambda x: float((x.view(np.int32).astype(np.float64) ** 2).sum())
    both = square(a[1]) + square(b[1])
    return min(1.0, max(0.0, 1.0 - square(a[1] - b[1]) / both)) if both else 0.0


def printed(f: Fingerprint) -> str:
    return base64.b64encode(f[0].astype("<u8").tobytes() + f[1].astype("<u4").tobytes()).decode()


def parsed(text: str) -> Fingerprint:
    data = base64.b64decode(text)
    return (np.frombuffer(data[: WIDE * 8], "<u8"), np.frombuffer(data[WIDE * 8 :], "<u4"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row, without a shuffle; a null text is empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [printed(fingerprint(x or "")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"]
            )

    return text_rows(docs).mapInArrow(each, "doc_id bigint, fingerprint string")


_LAST = -(1 << 63)
_TOP = (1 << 63) - 1


def _cuts(keys: DataFrame, n: int) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """Keys (id, hash) that end ``n`` ranges or so, the lowest first, and the highest key.

    A hash of ``_TOP`` stands for all rows of its id. An id that fills several
    ranges is cut at hashes of its texts, which are spread evenly.
    """
    steps = ", ".join(f"{i / n}D" for i in range(1, n))
    bounds = f"percentile_approx(_id, array({steps}), {max(10_000, 20 * n)})" if n > 1 else "array()"
    ids, top = keys.selectExpr(bounds, "max(_id)").first()
    if top is None:
        return [], None
    times = Counter(ids or [])
    heavy = sorted(c for c, k in times.items() if k > 1)
    cuts = [(c, _TOP) for c in times if c not in heavy and c < top]
    last = top, _TOP
    # Cuts inside an id are keys of its rows: the highest one up to each step of the hash.
    wanted = [
        (c, -(1 << 63) + (j << 64) // (times[c] + 1) if j <= times[c] else _TOP)
        for c in heavy for j in range(1, times[c] + 2)
    ]
    if wanted:
        found = keys.selectExpr(
            *(f"max(_hash) filter (where _id = {c}L and _hash <= {h}L) as c{i}"
              .replace(f"{_LAST}L", "(-9223372036854775807L - 1L)")
              for i, (c, h) in enumerate(wanted))
        ).first()
        inside = {(c, h) for (c, _), h in zip(wanted, found, strict=True) if h is not None}
        if top in heavy:
            last = max(x for x in inside if x[0] == top)
            inside.discard(last)
        cuts += inside
    return sorted(cuts), last


def with_next(docs: DataFrame) -> DataFrame:
    """``part, guest, doc_id, text``: ranges of rows, one to a partition, from the highest id down.

    A range ends with a ``guest``: the first row of the range below it, or of
    all rows for the lowest range. So each row's successor, around the end, is
    the row after it in the same partition, and texts are shuffled once. Rows
    with equal ids are in the order of a hash of their texts, rows without an id
    come last; either may fill many ranges, equal texts of one id stay in one.
    """
    spark = docs.sparkSession
    long = lambda x: f"{x}L" if x > _LAST else "(-9223372036854775807L - 1L)"
    keyed = text_rows(docs).selectExpr(
        "doc_id", "text", f"coalesce(doc_id, {long(_LAST)}) as _id",
        "xxhash64(coalesce(text, '')) as _hash",
    )
    cuts, last = _cuts(keyed.select("_id", "_hash"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    pair = lambda c: f"struct({long(c[0])} as c, {long(c[1])} as h)"
    array = f"filter(array({', '.join(map(pair, cuts or [(0, 0)]))}), x -> {bool(cuts)})"
    below = f"size(filter({array}, x -> x.c < _id or (x.c = _id and x.h < _hash)))"
    at = lambda x: f"({x}.c = _id and ({x}.h = {_TOP}L or {x}.h = _hash))"
    homes = f"""array_compact(array(
        struct({below} as part, false as guest),
        if(exists({array}, x -> {at("x")}), struct({below} + 1 as part, true as guest), null),
        if({at(pair(last)) if last else "false"}, struct(0 as part, true as guest), null)))"""
    placed = keyed.selectExpr(f"inline({homes})", "doc_id", "text", "_id", "_hash")
    dealt = placed.repartitionById(len(cuts) + 1, F.col("part"))
    return dealt.sortWithinPartitions(
        "guest", F.desc("_id"), F.desc("_hash"), F.desc_nulls_last("doc_id"), F.desc_nulls_last("text")
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint, and those of an edited text and of the next document.

    The next document is the one with the next lower id, after the last the
    first; the edited text has its last half (rounded down) replaced by the
    first as many code points of the next document's text, or all of them.
    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    A null text is empty. Rows with equal ids follow each other by a hash of
    their text, rows without an id come last; each row gets a row. A single row is its own next
    document. Other columns are not looked at; an empty table gives an empty one.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a row whose successor hasn't come yet
        for batch in batches:
            out = []
            for guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                own = fingerprint(text)
                if held is not None:
                    out.append(_compared(*held, text, own))
                if guest:
                    held = None
                    break
                held = doc_id, text, own
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
            if batch.num_rows and held is None:
                break
        for _ in batches:  # more rows that share the guest's id
            pass

    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double"
    )
    return with_next(docs).select("guest", "doc_id", "text").mapInArrow(follow, schema)


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
     ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
     ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _compared(doc_id, text: str, own: Fingerprint, after: str, other: Fingerprint) -> dict:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    changed = fingerprint(edited)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
        "fingerprint": printed(own),
        "edited_fingerprint": printed(changed),
        "near_edited": likeness(own, changed),
        "near_next": likeness(own, other),
    }
