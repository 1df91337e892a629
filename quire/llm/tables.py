"""Tables that are written once, in the shared folder of the session, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire.sources.scratch import scratch_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from storage: computed once, safe from lost executors, of known size."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: White space between words, as characters of a pattern and of a trim list.
GAP = r"[\\x20\\x09-\\x0D]+"
GAPS = r" \t\n\u000B\u000C\r"


def words_of(text: str) -> str:
    """SQL for the words of a text as an array; none for a null."""
    return f"array_remove(split(coalesce({text}, ''), '{GAP}'), '')"
