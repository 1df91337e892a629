"""Splitting paginated text into pages and putting pages together again.

The splits run one regular expression over the whole text of a document and
zip its pieces; nothing is looked up by index inside a lambda, so the cost
stays linear in the length of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import (
    MAX_LONG,
    PAGE_BOUNDARY,
    PAGE_HEADER,
    is_blank,
    literal,
    long_or,
    source_page,
    strip,
)

# --- fixed values ------------------------------------------------------------
FAILED_BODY = "*[OCR Failed]*\n"
# ---------------------------------------------------------------------------

PAGE_ARRAY = "array<struct<page_no:bigint,text:string>>"


def _cut(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Add the page ids (_ids) and the texts around them (_cut, one more)."""
    return df.withColumns(
        {
            "_ids": F.expr(f"regexp_extract_all({text}, {literal(pattern)}, 1)"),
            "_cut": F.expr(f"split({text}, {literal(pattern)}, -1)"),
        }
    )


def with_page_array(df: DataFrame, text: str = "markdown", out: str = "pages") -> DataFrame:
    """Add ``out``: array<struct<page_no, text>> in the order of the text.

    Blank text has no pages; text without a boundary is one page; text ahead
    of the first boundary belongs to the first page.
    """
    lead, first = strip("_cut[0]"), strip("try_element_at(_cut, 2)")
    folded = (
        f"case when {lead} = '' then {first} when {first} = '' then {lead} "
        f"else concat({lead}, '\\n\\n', {first}) end"
    )
    later = f"transform(slice(_cut, 3, greatest(size(_cut) - 2, 0)), t -> {strip('t')})"
    pages = f"""
        case when {is_blank(text)} then cast(array() as {PAGE_ARRAY})
             when size(_ids) = 0 then array(named_struct('page_no', 1L, 'text', {lead}))
             else zip_with(_ids, concat(array({folded}), {later}),
                           (i, t) -> named_struct('page_no', {source_page("i")}, 'text', t))
        end"""
    return _cut(df, text, PAGE_BOUNDARY).withColumn(out, F.expr(pages)).drop("_ids", "_cut")


def with_section_array(df: DataFrame, text: str = "body", out: str = "pages") -> DataFrame:
    """Add ``out``: the pages found under the '## Page N' headers of a body."""
    sections = f"""
        zip_with(_ids, slice(_cut, 2, greatest(size(_cut) - 1, 0)), (i, t) ->
                 named_struct('page_no', {long_or("i", MAX_LONG)}, 'text', {strip("t")}))"""
    return _cut(df, text, PAGE_HEADER).withColumn(out, F.expr(sections)).drop("_ids", "_cut")


def section(page_no: str, text: str) -> str:
    """One page of a body: its header, a blank line, its text."""
    return f"concat('## Page ', cast({page_no} as string), '\\n\\n', {text}, '\\n\\n')"
