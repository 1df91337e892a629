"""A whole run over a folder of documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.operators.convert import RunOptions, convert
from quire.operators.metadata import doc_metadata, outcome_of, written_outputs
from quire.operators.inventory import inventory, inventory_totals
from quire.operators.resume import (
    cached_outcomes,
    matching_records,
    plan_run,
    planned_collisions,
)
from quire.operators.selection import run_fingerprint
from quire.plans.documents import documents
from quire.sources.files import (
    OUTPUT_FOLDER,
    SUPPORTED,
    discover_files,
    is_file,
    path_exists,
    qualified,
    select_inputs,
    size_gate,
)
from quire.sources.index import read_index
from quire.sources.remote import with_existence, with_file_checksum
from quire.sources.sinks import write_run


# Documents and bytes one conversion task takes on; what a lost executor has to do again.
DOCUMENTS_PER_TASK = 200
BYTES_PER_TASK = 2 << 30
#: What converting a document costs: its pages where they are known, else its bytes.
COST = "coalesce(page_count * 1e5D, size_bytes, 0) + 1e5D"


STATUSES = ("completed", "partial", "failed")
#: What is counted while the plan is written, and while the documents are.
PLANNED = {
    "todo": "count_if(action = 'convert' and path_error is null)",
    "todo_bytes": "sum(if(action = 'convert' and path_error is null, size_bytes, 0))",
    "skipped": "count_if(action = 'skip')",
    "refused": "count_if(path_error is not null)",
}
SPENT = {
    "seconds": "sum(processing_time)",
    "pages": "sum(cast(recovered as bigint))",
    "figures": "sum(cast(size(pngs) as bigint))",
}


def _tasks(spark: SparkSession, documents_to_do: int, size: int) -> int:
    """Enough tasks to use every core, and no task too long."""
    cores = spark.sparkContext.defaultParallelism
    many = max(-(-documents_to_do // DOCUMENTS_PER_TASK), -(-size // BYTES_PER_TASK))
    return max(min(documents_to_do, cores), min(documents_to_do, many), 1)


@dataclass(frozen=True)
class RunReport:
    """What a run did. ``outcome`` is one row; ``outputs`` one row per usable body.

    ``outputs`` has ``output_path`` below the root and ``path`` in full; ``spent``
    the seconds of conversion, the pages and the figures of the run's documents.
    """

    outcome: DataFrame
    outputs: DataFrame
    metadata: DataFrame
    output_root: str
    run_dir: str
    spent: dict[str, float]


def fingerprint_options(spark: SparkSession, options: RunOptions) -> str:
    """The fingerprint recorded with every document of a run."""
    chosen = (options.model, options.backend, options.force_ocr, options.pages)
    return spark.range(1).selectExpr(run_fingerprint(*chosen)).first()[0]


def run(
    spark: SparkSession,
    input_path: str,
    converter_factory: Callable,
    output_root: str | None = None,
    options: RunOptions | None = None,
    reprocess: bool = False,
    export: bool = True,
    listing: DataFrame | None = None,
    collation: str | None = None,
    profile: ResourceProfile | None = None,
) -> RunReport:
    """Convert what is new or changed below ``input_path`` (a folder or one file).

    Folders are listed by tasks. A table of paths and sizes may take the place of
    that: ``listing`` with columns path and size_bytes (absolute URIs below
    ``input_path``), and page_count where it is known. Repeated paths count once.

    Of documents whose outputs would have one path (under ``collation``, if the
    store has such) one is converted; the others fail, with a message, and have
    no output. ``profile`` is for the converting stage alone.

    Counts are observed while tables are written; nothing is read to count it.

    The plan and the converted documents are written before anything reads
    them again: neither is a file hashed twice nor a document converted twice,
    and a lost executor repeats only its own tasks. Tables come first, then
    figures, bodies and records, and the index snapshot last: whatever an
    interrupted run has left out is converted again. Without ``export`` a
    completed record in the index is all that a document needs to be skipped.
    """
    options = options or RunOptions()
    found, root = _inputs(spark, input_path, output_root, listing)
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S")
    run_dir = f"{root}/_runs/{stamp}-{uuid.uuid4().hex[:8]}"

    fingerprint = fingerprint_options(spark, options)
    files = with_file_checksum(size_gate(found, options.max_file_mb))
    index = read_index(spark, root)
    # Hashed once: the plan and the look for outputs both read what is written here.
    files.write.mode("overwrite").parquet(f"{run_dir}/files")
    files = spark.read.parquet(f"{run_dir}/files")
    existing = matching_records(files, index, fingerprint).select("output_path")
    if export:  # without files a record in the index stands for the tables of its run
        existing = with_existence(existing, root)
    planned = plan_run(files, index, fingerprint, existing, reprocess)
    planned = planned_collisions(planned, collation)
    seen = Observation("plan")
    observed = planned.observe(
        seen, *(F.expr(f"{x} as {name}") for name, x in PLANNED.items())
    )
    observed.write.mode("overwrite").parquet(f"{run_dir}/plan")
    plan = spark.read.parquet(f"{run_dir}/plan")

    todo = plan.where("action = 'convert' and path_error is null")
    counts = seen.get
    tasks = _tasks(spark, counts["todo"] or 0, counts["todo_bytes"] or 0)
    images = f"{run_dir}/images"
    renders = convert(todo, converter_factory, options, tasks, COST, profile, images)
    made = Observation("documents")
    of_status = {s: f"count_if(status = '{s}')" for s in STATUSES}
    judged = documents(renders, options.pages).observe(
        made, *(F.expr(f"{x} as {name}") for name, x in {**of_status, **SPENT}.items())
    )
    judged.write.mode("overwrite").parquet(f"{run_dir}/documents")
    docs = spark.read.parquet(f"{run_dir}/documents")
    of_run = (options.model, options.backend, fingerprint)
    refused = plan.where("path_error is not null").selectExpr(
        "rel_key", "'failed' as status", "checksum", "0D as processing_time", "0L as recovered",
        "path_error as error",
    )
    none = F.lit(None).cast("string")
    records = doc_metadata(docs, *of_run).unionByName(
        doc_metadata(refused, *of_run).withColumn("output_path", none)
    )
    write_run(docs, records, root, run_dir, export)
    metadata = spark.read.parquet(f"{run_dir}/metadata")

    fresh = metadata.selectExpr("key as rel_key", "status", "output_path")
    results = fresh.unionByName(cached_outcomes(plan))
    outputs = written_outputs(results).withColumn("path", F.concat(F.lit(f"{root}/"), "output_path"))
    done = {s: made.get[s] or 0 for s in STATUSES}
    done["completed"] += counts["skipped"] or 0
    done["failed"] += counts["refused"] or 0
    spent = {name: made.get[name] or 0 for name in SPENT}
    outcome = outcome_of(spark, **done)
    return RunReport(outcome, outputs, metadata, root, run_dir, spent)


def preview(
    spark: SparkSession,
    input_path: str,
    output_root: str | None = None,
    listing: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """What a run would look at: a row per file, and their number and size. Converts nothing."""
    found, _ = _inputs(spark, input_path, output_root, listing)
    return inventory(found), inventory_totals(found)


def _inputs(
    spark: SparkSession, input_path: str, output_root: str | None, listing: DataFrame | None
) -> tuple[DataFrame, str]:
    """The inputs (``rel_key, path, size_bytes, page_count``) and the output root of a run."""
    if not path_exists(spark, input_path):
        raise ValueError(f"Input path does not exist: {input_path}")
    top = qualified(spark, input_path)
    single = is_file(spark, input_path)
    if single and listing is None and not top.lower().endswith(SUPPORTED):
        raise ValueError(f"Not a supported file: {input_path}")
    base = top.rsplit("/", 1)[0] if single else top
    root = qualified(spark, output_root) if output_root else f"{base}/{OUTPUT_FOLDER}"
    if listing is None:
        found = discover_files(spark, input_path, root)
    else:
        found = select_inputs(listing, base, root).dropDuplicates(["rel_key"])
    counted = "page_count" if "page_count" in found.columns else "cast(null as bigint) as page_count"
    return found.selectExpr("rel_key", "path", "size_bytes", counted), root
