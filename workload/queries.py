"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import audit, figures, inventory, metadata, pages, resume, selection, status
from quire.operators.convert import Render, RunOptions, convert
from quire.plans.documents import document_figures, document_pages, documents
from quire.sources import files as file_ops
from quire.sources.index import append_index, compact_index, read_index
from quire.sources.scratch import scratch_dir
from quire.sources.ship import ship
from quire.sources.sinks import export_tree, write_run
from workload import fixtures as fx

MODEL, BACKEND, FINGERPRINT = "converter", "custom", "fp-now"
METADATA = ["key", "status", "checksum", "model", "backend", "output_path", "pages", "error",
            "fingerprint"]

Query = Callable[[SparkSession, str], DataFrame]


# --- shared inputs -----------------------------------------------------------


def doc_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.split_pages(fx.renders(spark, d))


def raw_figures(spark: SparkSession, d: str) -> DataFrame:
    return figures.parse_figure_key(figures.explode_images(fx.renders(spark, d)))


def linked_figures(spark: SparkSession, d: str) -> DataFrame:
    return figures.figure_links(figures.number_figures(raw_figures(spark, d)))


def doc_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents without their nested tables, oversized files among them."""
    converted = documents(fx.renders(spark, d)).select(
        "rel_key", "checksum", "page_count", "recovered", "status", "error"
    )
    refused = file_ops.size_gate(fx.files(spark, d)).where("size_error is not null")
    return converted.unionByName(
        refused.selectExpr(
            "rel_key", "checksum", "page_count", "0L as recovered", "'failed' as status",
            "size_error as error",
        )
    )


def records(spark: SparkSession, d: str) -> DataFrame:
    docs = doc_rows(spark, d).selectExpr("*", "0D as processing_time")
    made = metadata.doc_metadata(docs, MODEL, BACKEND, FINGERPRINT)
    return made.withColumn("timestamp", F.expr("timestamp'2024-01-02'"))


def old_records(spark: SparkSession, d: str) -> DataFrame:
    """The prior index in full, with records of keys that are gone since."""
    f = fx.files(spark, d)
    prior = fx.prior_index(f).selectExpr(
        "explode(if(conv_id % 4 = 0, array('', 'gone/'), array(''))) as folder", "*"
    )
    return prior.selectExpr(
        "concat(folder, key) as key",
        "status",
        "checksum",
        f"'{MODEL}' as model",
        f"'{BACKEND}' as backend",
        "1D as processing_time",
        "timestamp'2024-01-01' as timestamp",
        "concat(folder, output_path) as output_path",
        "1L as pages",
        "cast(null as string) as error",
        "fingerprint",
    )


# --- sources -----------------------------------------------------------------


def _varied_paths(spark, d):
    ext = "case conv_id % 4 when 0 then '.pdf' when 1 then '.PDF' when 2 then '.jpg' else '' end"
    folder = "case conv_id % 3 when 0 then 'ocr' when 1 then 'ocr-notes' else 'sub/ocr' end"
    return fx.files(spark, d).selectExpr(
        f"concat('/in/', {folder}, '/', regexp_replace(rel_key, '[.]pdf$', ''), {ext}) as path",
        "size_bytes",
    )


def discover_files(spark, d):
    """A listing of nested folders, mixed case and an output folder, as a run selects from it."""
    found = file_ops.select_inputs(_varied_paths(spark, d), "/in", "/in/ocr")
    return found.select("rel_key", "size_bytes")


def filter_supported(spark, d):
    return file_ops.filter_supported(_varied_paths(spark, d))


def exclude_output_subtree(spark, d):
    return file_ops.exclude_output_subtree(_varied_paths(spark, d), "/in/ocr")


def with_relative_key(spark, d):
    return file_ops.with_relative_key(_varied_paths(spark, d), "/in/")


def with_checksum(spark, d):
    docs = fx.table(spark, d, "documents").selectExpr("doc_id", "cast(text as binary) as content")
    return file_ops.with_checksum(docs).select("doc_id", "checksum")


def size_gate(spark, d):
    return file_ops.size_gate(fx.files(spark, d)).select("rel_key", "size_bytes", "size_error")


def read_index_(spark, d):
    root = scratch_dir(spark, "index")
    append_index(spark, old_records(spark, d), root)
    return read_index(spark, root).select(*METADATA)


# --- inventory, selection, planning ------------------------------------------


def inventory_(spark, d):
    known = F.expr("if(conv_id % 3 <> 0, page_count, null)")
    return inventory.inventory(fx.files(spark, d).withColumn("page_count", known))


def inventory_totals(spark, d):
    return inventory.inventory_totals(fx.files(spark, d))


def expand_page_specs(spark, d):
    return selection.expand_page_specs(fx.specs(fx.files(spark, d)))


def select_pages(spark, d):
    """Each document's own selection; one of them can't be read, one is for all pages."""
    return selection.select_pages(doc_pages(spark, d), fx.specs(fx.files(spark, d)))


def run_fingerprint(spark, d):
    parsed = selection.parse_page_specs(fx.specs(fx.files(spark, d)))
    fp = selection.fingerprint_of(f"'{MODEL}'", f"'{BACKEND}'", "conv_id % 2 = 0", "ranges")
    return parsed.selectExpr("rel_key", "spec_error", f"{fp} as fingerprint")


def _planning(spark, d):
    f = fx.files(spark, d)
    return f.drop("conv_id"), fx.prior_index(f), FINGERPRINT, fx.existing_outputs(f)


def plan_run(spark, d):
    return resume.plan_run(*_planning(spark, d)).select(
        "rel_key", "checksum", "action", "cached_path"
    )


def pending(spark, d):
    return resume.pending(*_planning(spark, d)).select("rel_key", "size_bytes")


def cached_outcomes(spark, d):
    return resume.cached_outcomes(resume.plan_run(*_planning(spark, d)))


# --- conversion --------------------------------------------------------------


def _stub_factory(told):
    """Stands in for a converter: lays its input's pages out as paginated text."""

    def converter(doc):
        bodies = doc["content"].decode().split("\f")
        if doc["rel_key"].endswith("7.pdf"):
            raise RuntimeError("cannot convert")
        text = "".join(f"\n\n{{{i}}}{fx.RULE}\n\n{b}" for i, b in enumerate(bodies))
        return Render(text, [("_page_0_Figure_0.png", "RGB", False, b"png")], len(bodies))

    return converter


def convert_(spark, d):
    docs = fx.volumes(spark, d).selectExpr(
        "rel_key", "cast(array_join(turns.text, '\f') as binary) as content"
    )
    ship(spark, "workload")
    made = convert(docs, _stub_factory, RunOptions())
    return made.selectExpr(
        "rel_key", "markdown", "error", "page_count", "cast(size(images) as bigint) as n_images",
        "processing_time >= 0 as timed",
    )


def flag_empty_renders(spark, d):
    return status.flag_empty_renders(fx.renders(spark, d)).select("rel_key", "error")


# --- pages -------------------------------------------------------------------


def fold_preamble(spark, d):
    return pages.fold_preamble(fx.renders(spark, d))


def unpaginated_fallback(spark, d):
    return pages.unpaginated_fallback(fx.renders(spark, d))


def page_stats(spark, d):
    return pages.page_stats(doc_pages(spark, d))


def page_numbers(spark, d):
    return pages.page_numbers(doc_pages(spark, d)).withColumn(
        "page_numbers", F.array_join("page_numbers", ",")
    )


def flat_text(spark, d):
    return pages.flat_text(doc_pages(spark, d))


def assemble_body(spark, d):
    return pages.assemble_body(doc_pages(spark, d), fx.renders(spark, d))


def parse_body(spark, d):
    return pages.parse_body(pages.assemble_body(doc_pages(spark, d)))


def split_books(spark, d):
    return pages.split_pages(fx.books(spark, d))


# --- validation and status ---------------------------------------------------


def expected_pages(spark, d):
    parsed = selection.parse_page_specs(fx.specs(fx.files(spark, d)))
    return status.expected_pages(parsed, ranges="ranges").select("rel_key", "expected")


def _judged_inputs(spark, d):
    """One row per document with what the status rules look at."""
    stats = pages.page_stats(doc_pages(spark, d))
    lost = figures.figure_failures(raw_figures(spark, d))
    docs = status.flag_empty_renders(fx.renders(spark, d)).select("rel_key", "error", "page_count")
    return (
        status.expected_pages(docs)
        .join(stats.selectExpr("rel_key", "page_count as recovered", "has_content"),
              "rel_key", "left")
        .join(lost.selectExpr("rel_key", "detail as figure_error"), "rel_key", "left")
        .withColumn("recovered", F.expr("coalesce(recovered, 0L)"))
    )


def flag_shortfall(spark, d):
    return status.flag_shortfall(_judged_inputs(spark, d)).select(
        "rel_key", "recovered", "expected", "page_error"
    )


def _classified(spark, d):
    return status.classify_status(
        status.flag_shortfall(_judged_inputs(spark, d)).withColumns(
            {
                "success": F.expr("error is null"),
                "degraded": F.expr("page_error is not null or figure_error is not null"),
            }
        )
    )


def classify_status(spark, d):
    return _classified(spark, d).select("rel_key", "recovered", "degraded", "status")


def compose_error(spark, d):
    return status.compose_error(_classified(spark, d)).select("rel_key", "status", "error")


# --- figures -----------------------------------------------------------------


def parse_figure_key(spark, d):
    return raw_figures(spark, d)


def number_figures(spark, d):
    return figures.number_figures(raw_figures(spark, d)).select(
        "rel_key", "img_key", "saved", "figure_no"
    )


def figure_links(spark, d):
    return linked_figures(spark, d).select("rel_key", "img_key", "link")


def figure_failures(spark, d):
    return figures.figure_failures(raw_figures(spark, d))


def rewrite_links(spark, d):
    return figures.rewrite_links(doc_pages(spark, d), linked_figures(spark, d))


def strip_links(spark, d):
    return figures.strip_links(doc_pages(spark, d), linked_figures(spark, d))


def extract_image_refs(spark, d):
    return figures.extract_image_refs(doc_pages(spark, d))


def relink_pages(spark, d):
    return figures.relink(doc_pages(spark, d), linked_figures(spark, d))


def relink_books(spark, d):
    return document_pages(documents(fx.books(spark, d)))


# --- metadata, sinks, roll-up ------------------------------------------------


def process_documents(spark, d):
    return documents(fx.renders(spark, d)).selectExpr(
        "rel_key", "expected", "recovered", "has_content", "degraded", "status", "error",
        "cast(size(pngs) as bigint) as figures_saved",
    )


def document_figures_(spark, d):
    return document_figures(documents(fx.renders(spark, d)))


def output_paths(spark, d):
    return metadata.output_paths(fx.files(spark, d)).select("rel_key", "output_path")


def doc_metadata(spark, d):
    return records(spark, d).select(*METADATA)


def _stored(spark, df, name):
    """The rows from a table of their own, so that they are made once."""
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upsert_index(spark, d):
    new = _stored(spark, records(spark, d), "records")
    return metadata.upsert_index(old_records(spark, d), new).select(*METADATA)


def compact_index_(spark, d):
    """Three runs' records, the last ones counting, with the deltas made a base in between."""
    root = scratch_dir(spark, "index")
    append_index(spark, old_records(spark, d), root)
    append_index(spark, old_records(spark, d).withColumn("error", F.lit("stale")), root)
    compact_index(spark, root, max_deltas=0)
    append_index(spark, records(spark, d), root)
    return read_index(spark, root).select(*METADATA)


def planned_collisions(spark, d):
    """A quarter of the keys has one that differs in its extension's letter case only."""
    f = fx.files(spark, d).selectExpr(
        "explode(if(conv_id % 4 = 0, array('pdf', 'PDF'), array('pdf'))) as ext", "rel_key", "conv_id"
    ).selectExpr(
        "regexp_replace(rel_key, 'pdf$', ext) as rel_key",
        "if(conv_id % 8 = 0 and ext = 'pdf', 'skip', 'convert') as action",
    )
    return resume.planned_collisions(f)


def _written(spark, d, folder):
    """Documents of a run as read back from their table."""
    docs = documents(fx.renders(spark, d)).selectExpr("*", "0D as processing_time")
    docs.write.parquet(f"{folder}/documents")
    return spark.read.parquet(f"{folder}/documents")


def write_run_(spark, d):
    """Writes all tables of a run and reads them back: a digest per table and document."""
    root = scratch_dir(spark, "run")
    run_dir = f"{root}/_runs/0"
    docs = _written(spark, d, run_dir)
    write_run(docs, metadata.doc_metadata(docs, MODEL, BACKEND, FINGERPRINT), root, run_dir)

    def of_rows(table, name, order, line):
        """Rows of a document in order, one line each; as many as one document has."""
        rows = spark.read.parquet(f"{run_dir}/{table}").selectExpr(
            "rel_key", f"struct({order}, concat_ws('|', {line}) as _line) as _r"
        )
        return rows.groupBy("rel_key").agg(
            F.expr("sha2(array_join(sort_array(collect_list(_r))._line, '\n'), 256) as digest")
        ).selectExpr(f"'{name}' as name", "rel_key as key", "digest")

    record = "sha2(concat_ws('|', status, checksum, output_path, pages, coalesce(error, '-')), 256)"
    of_record = lambda df, name: df.selectExpr(
        f"'{name}' as name", "key", f"{record} as digest"
    )
    parts = [
        of_rows("pages", "pages", "pos", "pos, page_no, text"),
        of_rows("figures", "figures", "img_key",
                "img_key, coalesce(cast(figure_no as string), '-'), coalesce(link, '-')"),
        of_record(spark.read.parquet(f"{run_dir}/metadata"), "metadata"),
        of_record(read_index(spark, root), "index"),
    ]
    return reduce(DataFrame.unionByName, parts)


def export_tree_(spark, d):
    """Exports the folder tree and lists it: path, size and digest of bodies and figures."""
    root = scratch_dir(spark, "tree")
    docs = _written(spark, d, root)
    tree = f"{root}/tree"
    export_tree(docs, metadata.doc_metadata(docs, MODEL, BACKEND, FINGERPRINT), tree)
    top = file_ops.qualified(spark, tree)
    listed = file_ops.with_relative_key(file_ops.scan_files(spark, top), top)
    found = file_ops.filter_supported(listed, {".md", ".png"})
    return file_ops.with_checksum(found).selectExpr("rel_key as path", "size_bytes", "checksum")


def _results(spark, d):
    """Results of an incremental run: pending documents anew, the others as cached."""
    plan = _stored(spark, resume.plan_run(*_planning(spark, d)), "plan")
    todo = plan.where("action = 'convert'").select("rel_key")
    done = doc_rows(spark, d).select("rel_key", "status").join(todo, "rel_key", "left_semi")
    fresh = metadata.output_paths(done).select("rel_key", "status", "output_path")
    return fresh.unionByName(resume.cached_outcomes(plan))


def run_outcome(spark, d):
    return metadata.run_outcome(_results(spark, d))


def written_outputs(spark, d):
    return metadata.written_outputs(_results(spark, d))


# --- audit -------------------------------------------------------------------


def dangling_links(spark, d):
    """After rewriting alone, the links of figures that were not saved dangle."""
    figs = linked_figures(spark, d)
    return audit.dangling_links(figures.rewrite_links(doc_pages(spark, d), figs), figs)


def page_tag_mismatch(spark, d):
    return audit.page_tag_mismatch(relink_pages(spark, d))


def expectation_diff(spark, d):
    """Documents of two narrow classes are not expected, or not recorded."""
    expected = fx.files(spark, d).where("conv_id % 17 <> 3").selectExpr(
        "rel_key",
        "if(conv_id % 11 <> 0, page_count, null) as pages",
        "if(conv_id % 10 = 3, 'failed', 'completed') as status",
    )
    return audit.expectation_diff(expected, records(spark, d).where("key not like 'd4/%7.pdf'"))


def figure_diff(spark, d):
    """Expects every assistant turn of a document with pages to give two figures, in order."""
    shown = fx.volumes(spark, d).where("cls not in (3, 6, 8, 9)").selectExpr(
        "rel_key", "posexplode(filter(turns, t -> t.role = 'assistant')) as (i, t)"
    )
    expected = shown.selectExpr(
        "rel_key", "explode(array(2L * i + 1L, 2L * i + 2L)) as figure_no", "t.turn + 1 as page_no"
    )
    return audit.figure_diff(expected, linked_figures(spark, d))


def _spoiled(spark, d):
    """All records, with damaged checksums and statuses among them."""
    checksum = """
        case when key like 'd0/%' then replace(checksum, 'sha256:', 'md5:')
             when key like 'd2/%' then 'sha256:' else checksum end"""
    status_ = "if(key like 'd3/%1.pdf', 'partial', status)"
    return records(spark, d).withColumns({"checksum": F.expr(checksum), "status": F.expr(status_)})


def bad_checksums(spark, d):
    return audit.bad_checksums(_spoiled(spark, d)).select("key", "checksum")


def index_vs_metadata(spark, d):
    """A narrow class of keys lacks in the index, another one in the records."""
    meta = records(spark, d).where("key not like 'd2/%0.pdf'")
    index = _spoiled(spark, d).where("key not like 'd1/%3.pdf'")
    return audit.index_vs_metadata(index, meta)


def path_collisions(spark, d):
    f = fx.files(spark, d).selectExpr(
        "explode(if(conv_id % 4 = 0, array('pdf', 'PDF'), array('pdf'))) as ext", "rel_key"
    )
    return audit.path_collisions(f.selectExpr("regexp_replace(rel_key, 'pdf$', ext) as rel_key"))


QUERIES: dict[str, Query] = {
    "discover_files": discover_files,
    "filter_supported": filter_supported,
    "exclude_output_subtree": exclude_output_subtree,
    "with_relative_key": with_relative_key,
    "with_checksum": with_checksum,
    "size_gate": size_gate,
    "read_index": read_index_,
    "inventory": inventory_,
    "inventory_totals": inventory_totals,
    "expand_page_specs": expand_page_specs,
    "select_pages": select_pages,
    "run_fingerprint": run_fingerprint,
    "plan_run": plan_run,
    "pending": pending,
    "cached_outcomes": cached_outcomes,
    "planned_collisions": planned_collisions,
    "convert": convert_,
    "flag_empty_renders": flag_empty_renders,
    "split_pages": doc_pages,
    "split_books": split_books,
    "fold_preamble": fold_preamble,
    "unpaginated_fallback": unpaginated_fallback,
    "page_stats": page_stats,
    "page_numbers": page_numbers,
    "flat_text": flat_text,
    "assemble_body": assemble_body,
    "parse_body": parse_body,
    "expected_pages": expected_pages,
    "flag_shortfall": flag_shortfall,
    "classify_status": classify_status,
    "compose_error": compose_error,
    "parse_figure_key": parse_figure_key,
    "number_figures": number_figures,
    "figure_links": figure_links,
    "figure_failures": figure_failures,
    "rewrite_links": rewrite_links,
    "strip_links": strip_links,
    "extract_image_refs": extract_image_refs,
    "relink_pages": relink_pages,
    "relink_books": relink_books,
    "process_documents": process_documents,
    "document_figures": document_figures_,
    "output_paths": output_paths,
    "doc_metadata": doc_metadata,
    "upsert_index": upsert_index,
    "compact_index": compact_index_,
    "write_run": write_run_,
    "export_tree": export_tree_,
    "run_outcome": run_outcome,
    "written_outputs": written_outputs,
    "dangling_links": dangling_links,
    "page_tag_mismatch": page_tag_mismatch,
    "expectation_diff": expectation_diff,
    "figure_diff": figure_diff,
    "bad_checksums": bad_checksums,
    "index_vs_metadata": index_vs_metadata,
    "path_collisions": path_collisions,
}
