"""Validation of converted documents and their status.

All operators work on one row per document and add columns to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.page_specs import parse_literal, range_literal, ranges_size
from quire.functions.text import is_blank, literal

EMPTY_RENDER = "the conversion gave no text"
SHORTFALL = "pages incomplete: %d of %d came back"


def flag_empty_renders(renders: DataFrame) -> DataFrame:
    """Set ``error`` for renders without any text that carry no error yet."""
    empty = f"if({is_blank('markdown')}, {literal(EMPTY_RENDER)}, null)"
    return renders.withColumn("error", F.expr(f"coalesce(error, {empty})"))


def expected_pages(
    docs: DataFrame, spec: str | None = None, ranges: str | None = None
) -> DataFrame:
    """Add ``expected``: how many pages a full render has; null when unknown.

    With a selection it is the size of the selection and nothing else. The
    selection is ``spec`` for all documents, or their own column ``ranges``.
    """
    known = "nullif(page_count, 0)"
    if ranges is not None:
        chosen = f"if({ranges} is null, {known}, nullif({ranges_size(ranges)}, 0))"
    elif (parsed := parse_literal(spec)) is not None:
        chosen = f"nullif({ranges_size(range_literal(parsed))}, 0)"
    else:
        chosen = known
    return docs.withColumn("expected", F.expr(f"cast({chosen} as bigint)"))


def flag_shortfall(docs: DataFrame) -> DataFrame:
    """Add ``page_error`` where fewer pages came back than expected; more are fine.

    Documents without any page have failed already and get no such message.
    """
    said = f"format_string({literal(SHORTFALL)}, recovered, expected)"
    short = F.expr(f"if(recovered > 0 and recovered < expected, {said}, null)")
    return docs.withColumn("page_error", short)


def classify_status(docs: DataFrame) -> DataFrame:
    """Add ``status`` from recovered, has_content, degraded and success."""
    status = """
        case when not (recovered > 0 and coalesce(has_content, false)) then 'failed'
             when degraded then 'partial'
             when success then 'completed'
             else 'failed' end"""
    return docs.withColumn("status", F.expr(status))


def compose_error(docs: DataFrame) -> DataFrame:
    """Set ``error``: all diagnostics of a document; null for completed ones."""
    said = "nullif(concat_ws('; ', error, page_error, figure_error), '')"
    return docs.withColumn("error", F.expr(f"if(status <> 'completed', {said}, null)"))
