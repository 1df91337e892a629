"""Report of the files a run would see (dry run); never reads file contents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire.functions.text import human_size


def inventory(files: DataFrame) -> DataFrame:
    """One row per file: key, name, size text, page count or '-'."""
    return files.selectExpr(
        "rel_key",
        "regexp_extract(rel_key, '[^/]*$', 0) as name",
        f"{human_size('size_bytes')} as size",
        "coalesce(cast(page_count as string), '-') as pages",
    )


def inventory_totals(files: DataFrame) -> DataFrame:
    """Number of files and their total size, as number and as text."""
    totals = files.selectExpr(
        "count(*) as files", "cast(coalesce(sum(size_bytes), 0) as bigint) as total_bytes"
    )
    return totals.selectExpr("*", f"{human_size('total_bytes')} as total_size")
