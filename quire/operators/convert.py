"""The conversion stage: a user-supplied function per document."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame

from quire.functions.page_specs import parse_literal
from quire.sources.files import MAX_FILE_MB
from quire.sources.remote import content_writer
from quire.sources.ship import ship
from quire.sources.spread import dealt, dealt_by_weight

def renders_schema(png: str = "binary") -> str:
    """Columns of renders; ``png`` is binary, or string for files that lie beside the rows."""
    return (
        "rel_key string, markdown string, error string, page_count bigint, "
        f"images array<struct<key:string,mode:string,has_transparency:boolean,png:{png}>>, "
        "checksum string, processing_time double"
    )


RENDERS = renders_schema()

IMAGE_FIELDS = ("key", "mode", "has_transparency", "png")

# Converted documents a task hands back at a time, by number and by size.
OUT_ROWS = 256
OUT_BYTES = 16 << 20


@dataclass(frozen=True)
class RunOptions:
    """Options of a run. Those of the first group change what an input gives."""

    pages: str | None = None
    force_ocr: bool = False
    model: str = "converter"
    backend: str = "custom"

    max_file_mb: float = MAX_FILE_MB

    def __post_init__(self) -> None:
        parse_literal(self.pages)  # an unreadable selection stops before any file

    @property
    def page_ranges(self) -> tuple[tuple[int, int], ...] | None:
        """The selection as sorted ranges of 0-based ids, ends included; None: all pages."""
        parsed = parse_literal(self.pages)
        return None if parsed is None else tuple(parsed)


@dataclass
class Render:
    """What a converter returns. ``images``: (key, mode, has_transparency, png or None).

    Images may come from a generator: they are taken one by one.
    """

    markdown: str | None
    images: Iterable[tuple[str, str | None, bool, bytes | None]] = ()
    page_count: int | None = None


def convert(
    files: DataFrame,
    converter_factory: Callable[[RunOptions], Callable[[dict[str, Any]], Render]],
    options: RunOptions | None = None,
    tasks: int | None = None,
    weight: str | None = None,
    profile: ResourceProfile | None = None,
    image_root: str | None = None,
) -> DataFrame:
    """Apply a converter to every file; one render row per file, failed ones included.

    The factory gets ``options`` and runs once per task, at its first document to
    convert, so a run with nothing to do loads no model; what it raises ends the
    run. What the converter raises becomes the ``error`` of its row. The
    converter gets the columns of its file as a dict, reads ``path`` by itself,
    and marks where pages begin. Files are few and costly: they are dealt evenly
    over ``tasks`` partitions, by number or by ``weight``, SQL for what a file
    costs. ``profile`` says what a task of this stage needs (memory, GPUs, cores);
    the other stages keep what the session has.

    With ``image_root`` a PNG is written below it, under the hash of its bytes,
    as soon as the converter hands it out, and the row has its path instead:
    rows then stay small however many pictures a document has.
    """
    told = options or RunOptions()
    spark = files.sparkSession
    ship(spark)
    if tasks is None:
        tasks = max(
            int(spark.conf.get("spark.sql.shuffle.partitions")),
            spark.sparkContext.defaultParallelism,
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        converter = None
        keep = content_writer(image_root) if image_root else None
        rows: list[dict[str, Any]] = []
        size = 0
        for batch in batches:
            for doc in batch.to_dict("records"):
                row = _untouched(doc)
                start = time.perf_counter()
                if row["error"] is None:
                    if converter is None:
                        converter = converter_factory(told)
                        start = time.perf_counter()
                    try:
                        size += _fill(row, converter(doc), keep)
                    except Exception as e:
                        row["error"] = str(e) or type(e).__name__
                row["processing_time"] = time.perf_counter() - start
                rows.append(row)
                if len(rows) >= OUT_ROWS or size >= OUT_BYTES:
                    yield _frame(rows)
                    rows, size = [], 0
        if rows:
            yield _frame(rows)

    if weight is None:
        spread = dealt(files, "rel_key", tasks)
    else:
        spread = dealt_by_weight(files, "rel_key", weight, lambda n, total: tasks)
    schema = renders_schema("string" if image_root else "binary")
    return spread.mapInPandas(run, schema, profile=profile)


def _untouched(doc: dict[str, Any]) -> dict[str, Any]:
    """The row of a document before its conversion."""
    known = doc.get("page_count")
    return {
        "rel_key": doc["rel_key"],
        "markdown": None,
        "error": doc.get("size_error"),
        "page_count": None if pd.isna(known) else known,
        "images": [],
        "checksum": doc.get("checksum"),
    }


def _fill(row: dict[str, Any], made: Render, keep: Callable[[bytes], str] | None) -> int:
    """Take over what the converter returned; its size in bytes, roughly."""
    images = []
    for given in made.images:
        image = dict(zip(IMAGE_FIELDS, given, strict=True))
        if keep is not None and image["png"] is not None:
            image["png"] = keep(image["png"])
        images.append(image)
    row["markdown"], row["images"] = made.markdown, images
    if made.page_count is not None:
        row["page_count"] = made.page_count
    return len(made.markdown or "") + sum(len(i["png"] or b"") for i in images)


def _frame(rows: list[dict[str, Any]]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"page_count": "Int64"})
