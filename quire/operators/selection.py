"""Page selections of documents and the fingerprint of a run's options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.page_specs import (
    in_ranges,
    in_sorted_ranges,
    merge_pieces,
    parse_literal,
    parsed_pieces,
    pieces_invalid,
    range_literal,
    ranges_size,
)
from quire.functions.rows import rows_of
from quire.functions.text import literal

# Ids unfolded from one range struct at a time.
RANGE_STEP = 4096
# A selection of more pages than this is an error of its row: no document has so many.
MAX_PAGES = 1 << 31


def parse_page_specs(docs: DataFrame, spec: str = "spec") -> DataFrame:
    """Add ``ranges`` (null: all pages) and ``spec_error`` for a selection column."""
    return (
        docs.withColumn("_pieces", F.expr(parsed_pieces(spec)))
        .withColumn("_bad", F.expr(pieces_invalid("_pieces")))
        .withColumns(
            {
                "_ranges": F.expr(f"if(_bad, null, {merge_pieces('_pieces')})"),
            }
        )
        .withColumn("_many", F.expr(f"not coalesce({ranges_size('_ranges')} <= {MAX_PAGES}L, false)"))
        .withColumns(
            {
                "ranges": F.expr("if(_many, null, _ranges)"),
                "spec_error": F.expr(
                    f"""case when _bad then concat('not a page selection: ', {spec})
                             when _many and _ranges is not null
                             then concat('too many pages: ', {spec}) end"""
                ),
            }
        )
        .drop("_pieces", "_bad", "_ranges", "_many")
    )


def expand_page_specs(docs: DataFrame, spec: str | None = None) -> DataFrame:
    """One row per document and requested 0-based page id.

    ``spec`` is one selection for every document, checked here; without it
    each document's own ``spec`` column counts. The ranges are disjoint, so no
    distinct is needed; a long range unfolds in steps, never as one array. A
    selection in error has no rows here; ``parse_page_specs`` tells why.
    """
    if spec is None:
        ranged = parse_page_specs(docs)
    else:
        ranged = docs.withColumn("ranges", F.expr(range_literal(parse_literal(spec))))
    steps = rows_of(ranged, ["rel_key"], "ranges", "_r", "_no").selectExpr(
        "rel_key",
        "_r.last as _last",
        f"explode(sequence(_r.first, _r.last, {RANGE_STEP}L)) as _from",
    )
    return steps.selectExpr(
        "rel_key",
        f"explode(sequence(_from, least(_from + {RANGE_STEP - 1}L, _last))) as page_id",
    )


def select_pages(pages: DataFrame, spec: str | DataFrame | None) -> DataFrame:
    """Pages with a requested id, under their own numbers.

    ``spec`` is a selection for every document, or rows (rel_key, page_id), or
    rows (rel_key, spec) with the selection of each document: null for all pages,
    an unreadable one for none. Selections meet their documents' pages as ranges,
    whatever their length; no id is unfolded. Pages of a document without a row
    are not selected.
    """
    if isinstance(spec, DataFrame) and "spec" in spec.columns:
        ranged = parse_page_specs(spec.select("rel_key", "spec")).where("spec_error is null")
        ranged = ranged.selectExpr("rel_key as _key", "ranges as _ranges")
        inside = in_sorted_ranges("page_no - 1", "_ranges")
        return pages.join(ranged, F.expr(f"rel_key = _key and {inside}"), "left_semi")
    if isinstance(spec, DataFrame):
        wanted = spec.selectExpr("rel_key", "page_id + 1 as page_no")
        return pages.join(wanted, ["rel_key", "page_no"], "left_semi").select(*pages.columns)
    ranges = parse_literal(spec)
    if ranges is None:
        return pages
    return pages.where(in_ranges("page_no - 1", range_literal(ranges)))


def fingerprint_of(model: str, backend: str, force_ocr: str, ranges: str) -> str:
    """Hash of the options that change the output; equal selections hash alike."""
    options = (
        f"named_struct('model', {model}, 'backend', {backend}, "
        f"'force_ocr', {force_ocr}, 'pages', {ranges})"
    )
    return f"sha2(to_json({options}, map('ignoreNullFields', 'false')), 256)"


def run_fingerprint(model: str, backend: str, force_ocr: bool, pages: str | None) -> str:
    """Fingerprint of one run, as a constant expression."""
    return fingerprint_of(
        literal(model),
        literal(backend),
        "true" if force_ocr else "false",
        range_literal(parse_literal(pages)),
    )
