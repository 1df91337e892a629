"""Records of a run: paths, metadata, index, outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import literal

# --- fixed values ------------------------------------------------------------
CHECKSUM_PREFIX = "sha256:"
METADATA_COLUMNS = (
    "key",
    "status",
    "checksum",
    "model",
    "backend",
    "processing_time",
    "timestamp",
    "output_path",
    "pages",
    "error",
    "fingerprint",
)
# ---------------------------------------------------------------------------
# Stands for the bytes of an unreadable input; no real digest equals it.
UNREADABLE_CHECKSUM = CHECKSUM_PREFIX + "0" * 64


def output_folder(rel_key: str) -> str:
    """'<dir>/<stem>' of a key; only the last extension is cut."""
    extension = literal(r"(?<=[^/])\.[^./]*$")
    return f"regexp_replace({rel_key}, {extension}, '')"


def body_path(rel_key: str) -> str:
    """'<dir>/<stem>/<stem>.md'."""
    folder = output_folder(rel_key)
    stem = f"regexp_extract({folder}, '[^/]*$', 0)"
    return f"concat({folder}, '/', {stem}, '.md')"


def output_paths(docs: DataFrame) -> DataFrame:
    """Add ``output_path`` relative to the output root."""
    return docs.withColumn("output_path", F.expr(body_path("rel_key")))


def doc_metadata(docs: DataFrame, model: str, backend: str, fingerprint: str) -> DataFrame:
    """The metadata record of every document, failed ones included."""
    return docs.selectExpr(
        "rel_key as key",
        "status",
        f"coalesce(checksum, {literal(UNREADABLE_CHECKSUM)}) as checksum",
        f"{literal(model)} as model",
        f"{literal(backend)} as backend",
        "cast(processing_time as double) as processing_time",
        "current_timestamp() as timestamp",
        f"{body_path('rel_key')} as output_path",
        "cast(recovered as bigint) as pages",
        "if(status <> 'completed', error, null) as error",
        f"{literal(fingerprint)} as fingerprint",
    )


def upsert_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """The records of ``new`` and those of ``old`` whose keys it doesn't have.

    Both have one record per key, so an anti-join is all it takes: the records
    of a run are few beside the index, which isn't grouped or sorted for them.
    """
    columns = list(METADATA_COLUMNS)
    kept = old.select(*columns).join(new.select("key"), "key", "left_anti")
    return kept.select(*columns).unionByName(new.select(*columns))


def run_outcome(results: DataFrame) -> DataFrame:
    """One row: documents by status, total, and the exit code of the run."""
    counts = results.selectExpr(
        *(f"count_if(status = '{s}') as {s}" for s in ("completed", "partial", "failed")),
        "count(*) as total",
    )
    return counts.selectExpr("*", "if(failed + partial > 0, 1L, 0L) as exit_code")


def outcome_of(spark: SparkSession, completed: int, partial: int, failed: int) -> DataFrame:
    """The row of ``run_outcome`` from counts that are known."""
    total, code = completed + partial + failed, int(failed + partial > 0)
    names = "completed bigint, partial bigint, failed bigint, total bigint, exit_code bigint"
    return spark.createDataFrame([(completed, partial, failed, total, code)], names)


def written_outputs(results: DataFrame) -> DataFrame:
    """Body paths of all documents that did not fail, cached ones included."""
    return results.where("status <> 'failed'").select("rel_key", "output_path")
