"""Writing the tables of a run and the folder tree for consumers of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from quire.functions.page_text import FAILED_BODY, section
from quire.functions.text import literal
from quire.operators.metadata import body_path, output_folder
from quire.plans.documents import document_figures, document_pages
from quire.sources.index import append_index, compact_index
from quire.sources.remote import write_files


def write_tables(docs: DataFrame, metadata: DataFrame, run_dir: str) -> None:
    """Write pages, figures and metadata of ``documents`` below ``run_dir``."""
    document_pages(docs).write.mode("overwrite").parquet(f"{run_dir}/pages")
    document_figures(docs).write.mode("overwrite").parquet(f"{run_dir}/figures")
    metadata.write.mode("overwrite").parquet(f"{run_dir}/metadata")


def write_run(
    docs: DataFrame, metadata: DataFrame, root: str, run_dir: str, export: bool = False
) -> int:
    """All tables of a run, its files if ``export``, then its records in the index.

    The index alone makes the run count: whatever an interrupted run has left
    out, its documents are not in the index and are converted again. Failed
    documents are written like any other. Returns the number of the manifest.
    """
    spark = docs.sparkSession
    write_tables(docs, metadata, run_dir)
    fresh = spark.read.schema(metadata.schema).parquet(f"{run_dir}/metadata")
    if export:
        export_tree(docs, fresh, root)
    version = append_index(spark, fresh, root, run_dir.rsplit("/", 1)[1])
    compact_index(spark, root)
    return version


def document_bodies(docs: DataFrame) -> DataFrame:
    """The body of each of ``documents``, put together inside its row."""
    sections = f"transform(pages, p -> {section('p.page_no', 'p.text')})"
    body = f"if(size(pages) = 0, {literal(FAILED_BODY)}, array_join({sections}, ''))"
    return docs.selectExpr("rel_key", f"{body} as body")


def export_tree(docs: DataFrame, metadata: DataFrame, root: str) -> dict[str, int]:
    """Write '<dir>/<stem>/' with body, figures/*.png and metadata.json per document.

    Files are written by the tasks that hold their rows, each under its name
    only when complete; running again replaces them. Figures come first, then
    the bodies that link to them, then the records; one without an output path
    has no folder. Returns how many files of each kind were written.
    """
    bodies = document_bodies(docs).selectExpr(
        f"{body_path('rel_key')} as path", "body as data"
    )
    # Saved figures stand first and in the order of their PNGs.
    links = "slice(figures.link, 1, size(pngs))"
    beside = docs.schema["pngs"].dataType.elementType == StringType()  # paths instead of bytes
    data = "source" if beside else "data"
    pairs = f"zip_with({links}, pngs, (l, d) -> named_struct('link', l, '{data}', d))"
    images = docs.selectExpr("rel_key", f"inline({pairs})").selectExpr(
        f"concat({output_folder('rel_key')}, '/', substring(link, 3)) as path", data
    )
    columns = ", ".join(metadata.columns)
    options = "map('ignoreNullFields', 'false', 'pretty', 'true')"
    records = metadata.where("output_path is not null").selectExpr(
        f"concat({output_folder('key')}, '/metadata.json') as path",
        f"to_json(struct({columns}), {options}) as data",
    )
    return {
        "figures": write_files(images, root),
        "bodies": write_files(bodies, root),
        "metadata": write_files(records, root),
    }
