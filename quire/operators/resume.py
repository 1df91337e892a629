"""Incremental runs: which documents are already done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import literal
from quire.operators.metadata import body_path


def matching_records(files: DataFrame, index: DataFrame, fingerprint: str) -> DataFrame:
    """``rel_key, checksum, output_path`` of the completed records that fit a file.

    Only of these need the outputs be looked up. The index has a record per key.
    """
    completed = index.where(f"status = 'completed' and fingerprint = {literal(fingerprint)}")
    records = completed.selectExpr("key as rel_key", "checksum", "output_path")
    return records.join(files.select("rel_key", "checksum"), ["rel_key", "checksum"], "left_semi")


def _done(index: DataFrame, fingerprint: str, existing_outputs: DataFrame) -> DataFrame:
    """Completed records of this fingerprint whose output still exists."""
    completed = index.where(f"status = 'completed' and fingerprint = {literal(fingerprint)}")
    records = completed.selectExpr("key as rel_key", "checksum", "output_path as cached_path")
    there = existing_outputs.selectExpr("output_path as cached_path")
    return records.join(there, "cached_path", "left_semi")


def plan_run(
    files: DataFrame,
    index: DataFrame,
    fingerprint: str,
    existing_outputs: DataFrame,
    reprocess: bool = False,
) -> DataFrame:
    """Add ``action`` (skip or convert) and ``cached_path`` to every file.

    A file is skipped iff the index holds a completed record of the same key,
    checksum and fingerprint whose output still exists. A file without a
    checksum (unreadable) is always converted, and fails there by itself.
    """
    if reprocess:
        return files.selectExpr("*", "'convert' as action", "cast(null as string) as cached_path")
    done = _done(index, fingerprint, existing_outputs)
    return files.join(done, ["rel_key", "checksum"], "left").selectExpr(
        *files.columns, "if(cached_path is null, 'convert', 'skip') as action", "cached_path"
    )


def pending(
    files: DataFrame,
    index: DataFrame,
    fingerprint: str,
    existing_outputs: DataFrame,
    reprocess: bool = False,
) -> DataFrame:
    """Only the files to convert, found by an anti join."""
    if reprocess:
        return files
    done = _done(index, fingerprint, existing_outputs).select("rel_key", "checksum")
    return files.join(done, ["rel_key", "checksum"], "left_anti").select(*files.columns)


def cached_outcomes(plan: DataFrame) -> DataFrame:
    """Skipped files as completed results with the path of their cached output."""
    return plan.where("action = 'skip'").selectExpr(
        "rel_key", "'completed' as status", "cached_path as output_path"
    )


def planned_collisions(plan: DataFrame, collation: str | None = None) -> DataFrame:
    """Add ``path_error``: a message where another key's output has the same path.

    Of the keys that share a path a skipped one keeps it, else the first in
    order; the others must not be converted. ``collation`` tells which paths a
    store holds for the same, for instance UNICODE_CI where letter case and
    Unicode forms don't count. Without ``action`` all keys are to be converted.
    """
    path = body_path("rel_key") + (f" collate {collation}" if collation else "")
    skipped = "action = 'skip'" if "action" in plan.columns else "false"
    ranked = plan.select("*", F.expr(path).alias("_path"))
    first = ranked.groupBy(F.col("_path").alias("_same")).agg(
        F.expr(f"min(struct({skipped} = false as _new, rel_key))").getField("rel_key").alias("_first"),
        F.count("*").alias("_keys"),
    ).where("_keys > 1")
    error = f"if(_first <> rel_key and not {skipped}, concat('output path belongs to ', _first), null)"
    joined = ranked.join(first, F.col("_path") == F.col("_same"), "left")
    return joined.selectExpr(*(f"`{c}`" for c in plan.columns), f"{error} as path_error")
