"""Everything that follows a conversion, inside one row per document.

A render row holds the text and all images of its document. Splitting,
numbering, linking and judging it there needs no shuffle at all, whatever the
number of documents and the length of each.

Arrays that later expressions use more than once are columns of their own, and
each is referred to at least twice: the optimizer then keeps it computed once
per row instead of folding it into a lambda.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.figure_keys import (
    by_key,
    failure_text,
    figure_link,
    has_odd_keys,
    key_block,
    key_page,
    linked_text,
    png_mode,
)
from quire.functions.page_text import with_page_array
from quire.functions.rows import computed_once, rows_of
from quire.functions.text import is_blank
from quire.operators.pages import explode_pages
from quire.operators.status import (
    classify_status,
    compose_error,
    expected_pages,
    flag_empty_renders,
    flag_shortfall,
)


def _with_figures(docs: DataFrame) -> DataFrame:
    """``figures`` in source order (saved ones numbered) and ``pngs`` by number.

    Of a document without pages nothing is written, so its images do not count.
    Images are sorted by their keys and places; the bytes are fetched at the end.
    """
    images = "if(size(pages) > 0, coalesce(images, array()), slice(images, 1, 0))"
    found = f"""
        coalesce(sort_array(transform({images}, (i, n) -> named_struct(
          'page_no', {key_page("i.key")}, 'block_id', {key_block("i.key")},
          'img_key', i.key, 'saved', i.png is not null,
          'png_mode', {png_mode("i.mode", "i.has_transparency")}, 'at', n))), array())"""

    def numbered(no: str, link: str) -> str:
        return (
            "named_struct('page_no', f.page_no, 'block_id', f.block_id, 'img_key', f.img_key, "
            f"'saved', f.saved, 'png_mode', f.png_mode, 'figure_no', cast({no} as bigint), "
            f"'link', cast({link} as string))"
        )

    kept = f"transform(_kept, (f, i) -> {numbered('i + 1', figure_link('i + 1', 'f.page_no'))})"
    lost = f"transform(_lost, f -> {numbered('null', 'null')})"
    return (
        docs.withColumn("_figs", F.expr(found))
        .withColumns(
            {
                "_kept": F.expr("filter(_figs, f -> f.saved)"),
                "_lost": F.expr("filter(_figs, f -> not f.saved)"),
            }
        )
        .withColumns(
            {
                "figures": F.expr(f"concat({kept}, {lost})"),
                "pngs": F.expr("transform(_kept, f -> images[f.at].png)"),
                "figure_error": F.expr(
                    f"if(size(_lost) > 0, {failure_text('_lost.img_key')}, null)"
                ),
            }
        )
        .drop("_figs", "_kept", "_lost")
    )


def _with_links(docs: DataFrame) -> DataFrame:
    """Set the links in ``pages``: each page's text is cut once, its pieces looked up in all keys."""
    linked = f"""
        transform(pages, p -> named_struct(
          'page_no', p.page_no, 'text', {linked_text("p.text", "_keys", "_odd")}))"""
    return (
        docs.withColumn("_keys", F.expr(f"sort_array(transform(figures, f -> {by_key('f')}))"))
        .withColumn("_odd", F.expr(has_odd_keys("_keys")))
        .withColumn("pages", F.expr(f"if(size(_keys) > 0, {linked}, pages)"))
        .drop("_keys", "_odd")
    )


def documents(renders: DataFrame, spec: str | None = None) -> DataFrame:
    """One row per render: pages, figures, diagnostics and status. No shuffle.

    ``spec`` is the page selection the renders were made with.
    """
    carried = [c for c in ("checksum", "processing_time") if c in renders.columns]
    split = with_page_array(flag_empty_renders(renders))
    counted = _with_figures(split).withColumns(
        {
            "recovered": F.expr("cast(size(pages) as bigint)"),
            "has_content": F.expr(f"exists(pages, p -> not {is_blank('p.text')})"),
            "success": F.expr("error is null"),
        }
    )
    checked = flag_shortfall(expected_pages(counted, spec))
    degraded = F.expr("page_error is not null or figure_error is not null")
    judged = compose_error(classify_status(checked.withColumn("degraded", degraded)))
    record = judged.select(
        "rel_key",
        *carried,
        "page_count",
        "expected",
        "recovered",
        "has_content",
        "degraded",
        "status",
        "error",
        "pages",
        "figures",
        "pngs",
    )
    return _with_links(computed_once(record))


def document_figures(docs: DataFrame) -> DataFrame:
    """The figure table of ``documents``."""
    return rows_of(docs, ["rel_key"], "figures", "_f", "_no").select("rel_key", "_f.*")


def document_pages(docs: DataFrame) -> DataFrame:
    """The page table of ``documents``, links set."""
    return explode_pages(docs)
