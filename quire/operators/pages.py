"""The page table: one row per page of a converted document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.page_text import (
    FAILED_BODY,
    section,
    with_page_array,
    with_section_array,
)
from quire.functions.rows import rows_of
from quire.functions.text import PAGE_BOUNDARY, is_blank, literal, strip


def explode_pages(docs: DataFrame, *carry: str) -> DataFrame:
    """``pages`` arrays as rows: rel_key, pos, page_no, text."""
    rows = rows_of(docs, ["rel_key", *carry], "pages", "_page", "pos")
    return rows.selectExpr(
        "rel_key", *carry, "cast(pos as bigint) as pos", "_page.page_no", "_page.text"
    )


def split_pages(renders: DataFrame) -> DataFrame:
    """Paginated text to page rows, without a shuffle."""
    return explode_pages(with_page_array(renders.select("rel_key", "markdown")))


def fold_preamble(renders: DataFrame) -> DataFrame:
    """First pages that took up text from ahead of the first boundary."""
    boundary = literal(PAGE_BOUNDARY)
    led = (
        renders.select("rel_key", "markdown")
        .where(f"not {is_blank('markdown')} and markdown rlike {boundary}")
        .withColumn("preamble", F.expr(strip(f"split(markdown, {boundary}, 2)[0]")))
        .where("preamble <> ''")
    )
    return with_page_array(led).selectExpr(
        "rel_key", "preamble", "pages[0].page_no as page_no", "pages[0].text as text"
    )


def unpaginated_fallback(renders: DataFrame) -> DataFrame:
    """Documents without any boundary: one page numbered 1 with the whole text."""
    boundary = literal(PAGE_BOUNDARY)
    return renders.where(
        f"not {is_blank('markdown')} and not markdown rlike {boundary}"
    ).selectExpr("rel_key", "1L as page_no", f"{strip('markdown')} as text")


def page_stats(pages: DataFrame) -> DataFrame:
    """Per document: page count, whether any page has text, lowest and highest number."""
    return pages.groupBy("rel_key").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.expr(f"max(not {is_blank('text')})").alias("has_content"),
        F.min("page_no").alias("first_page"),
        F.max("page_no").alias("last_page"),
    )


def _gathered(pages: DataFrame, value: str) -> DataFrame:
    """Values of the pages of a document, in the order of the text.

    A document's pages came out of one cell, so they fit in one again.
    """
    rows = pages.selectExpr("rel_key", f"struct(pos, {value} as v) as _p")
    return rows.groupBy("rel_key").agg(F.expr("sort_array(collect_list(_p)).v as _v"))


def page_numbers(pages: DataFrame) -> DataFrame:
    """Page numbers of every document in the order of the text."""
    return _gathered(pages, "page_no").selectExpr("rel_key", "_v as page_numbers")


def flat_text(pages: DataFrame) -> DataFrame:
    """Texts of a document's non-empty pages joined by blank lines."""
    texts = _gathered(pages.where("text <> ''"), "text")
    return texts.selectExpr("rel_key", "array_join(_v, '\\n\\n') as text")


def assemble_body(pages: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Markdown body per document: each page under its '## Page N' header.

    With ``docs`` given, its documents without pages get the placeholder body.
    """
    found = _gathered(pages, section("page_no", "text"))
    bodies = found.selectExpr("rel_key", "array_join(_v, '') as body")
    if docs is None:
        return bodies
    return (
        docs.select("rel_key")
        .join(bodies, "rel_key", "left")
        .selectExpr("rel_key", f"coalesce(body, {literal(FAILED_BODY)}) as body")
    )


def parse_body(bodies: DataFrame) -> DataFrame:
    """Page rows of assembled bodies; the inverse of ``assemble_body``."""
    return explode_pages(with_section_array(bodies.select("rel_key", "body")))
