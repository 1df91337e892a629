"""Substring dedup: seeds on winnowed anchors, extended to maximal repeats.

A window is ``length`` consecutive words. Its anchor is the k-word run with the
lowest hash among those inside it (the first one of equals), so that equal
windows have equal anchors at equal places. Consecutive windows mostly share an
anchor; together they make the anchor's span, the furthest that a repeat can
reach on both sides while this anchor leads to it.

* Seeds: documents are joined on anchors; those that occur once are out.
* Extension: occurrences whose spans are equal repeat over the whole span.
  Where an anchor has several different spans, one occurrence of each is
  extended window by window to the left and right of the anchor: what windows of
  two spans agree in is repeated, the others end the repeat.
* The repeated windows of a document run together to its maximal repeats, of
  ``length`` words or more each, and their words go.

Spans are counted before anything is joined, so an anchor or a passage that all
documents have costs a row per document at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import encoded, slices, text_rows
from quire.llm.hashing import runs, spans, words, words_of
from quire.llm.tables import written

LENGTH = 35
ANCHOR_WORDS = 6


def first_lowest(g: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values the place of its lowest one, the first of equals."""
    value, place, have = g, np.arange(len(g)), 1

    def lower(shift: int):
        a, b = value[: len(value) - shift], value[shift:]
        take = b < a
        where = np.where(take, place[shift:], place[: len(value) - shift])
        return np.where(take, b, a), where

    while 2 * have <= width:
        value, place = lower(have)
        have *= 2
    if have < width:
        value, place = lower(width - have)
    return place


def anchors_of(h: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, place, first and last window, and span hash of a text's anchors."""
    if len(h) < length:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty, np.zeros(0, np.uint64)
    g = runs(h, k)
    place = first_lowest(g, length - k + 1)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(place)])) - 1
    at = place[first]
    # The span's hash also has the anchor's distance from its beginning.
    span = spans(h, first, last + length) + (at - first).astype(np.uint64)
    return g[at], at, first, last, span


_ANCHORS = "_id bigint, _text_hash bigint, anchor bigint, span bigint, first int, last int"


def _anchor_rows(batches, length: int, k: int) -> Iterator[pa.RecordBatch]:
    names = ["_id", "_text_hash", "anchor", "span", "first", "last"]
    for batch in slices(batches):
        h, cuts = words_of(encoded(batch.column(1)))
        parts = [anchors_of(h[a:b], length, k) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        n = [len(p[0]) for p in parts]
        anchor, _, first, last, span = map(np.concatenate, zip(*parts, strict=True))
        owner = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(owner), batch.column(2).take(owner),
             pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64)),
             pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
            names,
        )


def _window_rows(batches, length: int) -> Iterator[pa.RecordBatch]:
    """The windows of the spans to be extended, from a row per document with its spans."""
    for batch in batches:
        rows = zip(encoded(batch.column(1)), batch.column(3).to_pylist(), strict=True)
        for i, (text, spans_of) in enumerate(rows):
            h, _, _ = words(text)
            all_windows = runs(h, length)
            starts = np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans_of])
            window = all_windows[starts]
            owner = pa.array(np.full(len(starts), i))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), batch.column(2).take(owner),
                 pa.array(window.view(np.int64)), pa.array(starts.astype(np.int32))],
                ["_id", "_text_hash", "window", "first"],
            )


def repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR_WORDS) -> DataFrame:
    """``_id, _text_hash, first, last``: runs of windows that also start elsewhere, by their starts.

    ``docs`` has ``_id, _text, _text_hash``.
    """
    rows = text_rows(docs.withColumnsRenamed({"_id": "doc_id", "_text": "text"}), "_text_hash")
    found = rows.mapInArrow(partial(_anchor_rows, length=length, k=k), _ANCHORS)
    # Tables that rows are filtered by are written first: small ones are broadcast then,
    # and beside large ones the rows of a hot key are split over tasks.
    often = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    often = written(often, "substring-anchors")
    seeds = written(found.join(often, "anchor", "left_semi"), "substring-seeds")

    of_span = seeds.groupBy("anchor", "span").agg(
        F.count("*").alias("n"), F.min(F.struct("_id", "_text_hash", "first", "last")).alias("one")
    )
    of_span = written(of_span, "substring-spans")
    whole = written(of_span.where("n > 1").select("anchor", "span"), "substring-whole")
    whole = seeds.join(whole, ["anchor", "span"], "left_semi").select(
        "_id", "_text_hash", "first", "last"
    )

    several = of_span.groupBy("anchor").agg(F.count("*").alias("spans")).where("spans > 1")
    ends = of_span.join(several, "anchor", "left_semi")
    of_doc = ends.groupBy("one._id", "one._text_hash").agg(
        F.collect_list(F.struct("one.first", "one.last")).alias("spans")
    )  # at most the anchors of one text
    of_doc = of_doc.withColumnsRenamed({"_id": "_i", "_text_hash": "_t"})
    extended = docs.join(of_doc, F.expr("_id <=> _i and _text_hash = _t"))
    windows = extended.select("_id", "_text", "_text_hash", "spans").mapInArrow(
        partial(_window_rows, length=length),
        "_id bigint, _text_hash bigint, window bigint, first int",
    )
    windows = written(windows.distinct(), "substring-windows")
    twice = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    twice = written(twice, "substring-twice")
    partly = windows.join(twice, "window", "left_semi").selectExpr(
        "_id", "_text_hash", "first", "first as last"
    )
    return whole.unionByName(partly)


_OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def _kept_rows(batches, length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, kept = [], [], []
        rows = zip(encoded(batch.column(1)), batch.column(2).to_pylist(), strict=True)
        for text, found in rows:
            _, starts, ends = words(text)
            edge = np.zeros(len(starts) + 1, np.int64)
            for r in found or ():
                edge[r["first"]] += 1
                edge[r["last"] + length] -= 1
            keep = np.cumsum(edge)[:-1] == 0
            counts.append(len(keep))
            removed.append(int(len(keep) - keep.sum()))
            kept.append(b" ".join(text[s:e] for s, e in zip(starts[keep], ends[keep], strict=True)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: every text without its repeated passages.

    A word goes if a window of ``length`` words that covers it has a word
    sequence that starts at any other place too, of the same text or another;
    all occurrences go, and windows are judged on the texts as they come. Kept
    words are joined by a blank.

    A null text has no words. Each of repeated rows counts as a text of its own,
    so all their windows are repeated; each gets a row. Null ids are values like
    others, extra columns aren't looked at, an empty table gives an empty one.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
    ).withColumn("_text_hash", F.xxhash64("_text"))
    found = repeats(rows, length, k).groupBy("_id", "_text_hash").agg(
        F.collect_set(F.struct("first", "last")).alias("_found")
    )  # at most the windows of one text
    found = found.withColumnsRenamed({"_id": "_i", "_text_hash": "_t"})
    joined = rows.join(found, F.expr("_id <=> _i and _text_hash = _t"), "left")
    return joined.select(F.col("_id").alias("doc_id"), "_text", "_found").mapInArrow(
        partial(_kept_rows, length=length), _OUT
    )
