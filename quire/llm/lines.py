"""Line dedup: lines whose normalised form stands in many documents are dropped everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.rows import computed_once
from quire.llm.tables import GAPS, written

#: A line found in at least so many documents goes.
MIN_DOCS = 10
MIN_CHARS = 1

# A-Z only; lower() changes nothing else in text of single bytes and is faster there.
FOLDED = """if(octet_length(_line) = length(_line), lower(_line), translate(_line,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"""


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line that has a key: document, position and 128 bits of the key's hash."""
    cut = rows.select(
        "_id", "_text_hash", F.posexplode(F.split("_text", "\n")).alias("_at", "_raw")
    )
    trimmed = cut.selectExpr("_id", "_text_hash", "_at", f"btrim(_raw, '{GAPS}') as _line")
    keyed = trimmed.where(f"length(_line) >= {max(1, min_chars)}").selectExpr(
        "_id", "_text_hash", "_at", f"{FOLDED} as _key"
    )
    return keyed.selectExpr(
        "_id", "_text_hash", "_at", "xxhash64(_key) as _h1", "xxhash64(7L, _key) as _h2"
    )


def deduplicated(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """The rows of ``docs`` as ``row``, with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    Lines are exploded and hashed, distinct documents counted per hash, and the
    hashes at or over ``min_docs`` joined back to the lines; a document's kept
    lines are put together by position. Texts are shuffled once, for that.

    Documents are told apart by ``doc_id`` (null is an id as well): repeated
    rows, and rows that share an id, count once for a line, and each of them
    loses its frequent lines. A null or empty text is one empty line; empty keys
    stay. Extra columns stay in ``row``. An empty table gives an empty one.
    """
    rows = docs.select(
        F.struct("*").alias("row"),
        F.struct(F.col("doc_id").cast("bigint").alias("id")).alias("_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
    ).withColumn("_text_hash", F.xxhash64("_text"))
    lines = _lines(rows, min_chars)
    frequent = (
        lines.groupBy("_h1", "_h2")
        .agg(F.count_distinct("_id").alias("_docs"))
        .where(F.col("_docs") >= min_docs)
        .select("_h1", "_h2")
    )
    # Written, it has a known size: it is broadcast if small, and a hot line of
    # the other side of the join is split over tasks if not.
    frequent = written(frequent, "frequent-lines")
    # At most the lines of one text to a group.
    dropped = (
        lines.join(frequent, ["_h1", "_h2"])
        .groupBy("_id", "_text_hash")
        .agg(F.collect_set("_at").alias("_gone"))
    )
    joined = rows.join(dropped, ["_id", "_text_hash"], "left").select("row", "_text", "_gone")
    cut = computed_once(joined.selectExpr("row", "_gone", "split(_text, '\\n') as _all"))
    kept = """if(_gone is null, _all, transform(
        array_except(sequence(0, size(_all) - 1), _gone), i -> _all[i]))"""
    return cut.selectExpr(
        "row",
        "cast(size(_all) as bigint) as n_lines",
        "cast(coalesce(size(_gone), 0) as bigint) as n_dropped",
        f"array_join({kept}, '\\n') as kept_text",
    )


def with_kept_text(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, ``text`` deduplicated and ``n_chars``, if there, to match."""
    new = {"text": "kept_text", "n_chars": "cast(length(kept_text) as bigint)"}
    made = deduplicated(docs)
    return made.selectExpr(
        *(f"{new[c]} as `{c}`" if c in new else f"row.`{c}`" for c in docs.columns)
    )
