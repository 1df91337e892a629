"""Input files: discovery, and the predicates that make a file table."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import literal
from quire.sources.remote import list_folders, with_content
from quire.sources.scratch import checkpointed

# --- fixed values ------------------------------------------------------------
SUPPORTED = (".pdf",)
EXTENSION = r"[^/](\.[^./]+)$"
MAX_FILE_MB = 500.0
OUTPUT_FOLDER = "ocr"
#: Names that Spark's file scans pass over, folders or files.
HIDDEN = r"/(\.|_(?!(common_)?metadata)[^/=]*/|_[^/=]*$|[^/]*\._COPYING_(/|$))"
EMPTY_AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.\-]*):///"
# ---------------------------------------------------------------------------


FILE = "path string, size_bytes bigint, modified timestamp"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as the absolute URI under which Spark lists its files."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(jvm_path).toString().rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def is_file(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm_path) and fs.getFileStatus(jvm_path).isFile()


def plain_uri(path: str) -> str:
    """``file:///a`` as ``file:/a``, the form in which Spark lists it."""
    return re.sub(EMPTY_AUTHORITY, r"\1:/", path)


def _plain(path: str) -> str:
    """The same for a column."""
    return f"regexp_replace({path}, {literal(EMPTY_AUTHORITY)}, '$1:/')"


def filter_supported(files: DataFrame, exts: Iterable[str] = SUPPORTED) -> DataFrame:
    """Files whose extension is supported, in any letter case.

    A leading dot alone ('.pdf') makes no extension.
    """
    known = ", ".join(literal(e.lower()) for e in exts)
    found = f"lower(regexp_extract(path, {literal(EXTENSION)}, 1))"
    return files.where(f"{found} in ({known})")


def exclude_output_subtree(files: DataFrame, output_root: str) -> DataFrame:
    """Files outside the output root, so that a run never reads its own output."""
    below = literal(plain_uri(output_root).rstrip("/") + "/")
    return files.where(f"not startswith({_plain('path')}, {below})")


def with_relative_key(files: DataFrame, root: str) -> DataFrame:
    """Add ``rel_key``: the path below the scan root, the identity of a document.

    A path that isn't below the root has no key and ends the job, naming the path.
    """
    top = plain_uri(root).rstrip("/") + "/"
    key = f"substring({_plain('path')}, {len(top) + 1})"
    foreign = f"raise_error(concat('not below ', {literal(top)}, ': ', path))"
    return files.selectExpr(
        "*", f"if(startswith({_plain('path')}, {literal(top)}), {key}, {foreign}) as rel_key"
    )


def with_checksum(files: DataFrame) -> DataFrame:
    """Add ``checksum`` of the bytes; null where ``content`` is null (unreadable)."""
    return files.selectExpr("*", "concat('sha256:', sha2(content, 256)) as checksum")


def size_gate(files: DataFrame, max_mb: float = MAX_FILE_MB) -> DataFrame:
    """Add ``size_error``: a message for files over the limit, else null."""
    mb = "size_bytes / 1048576D"
    said = literal(f"too large: %.2f MB, limit {float(max_mb)} MB")
    return files.selectExpr(
        "*",
        f"if({mb} > {float(max_mb)}D, format_string({said}, bround({mb}, 2)), null) as size_error",
    )


def list_files(
    spark: SparkSession, root: str, skip: str | None = None, exts: Iterable[str] | None = None
) -> DataFrame:
    """Every file below ``root`` (or the one file ``root``): path, size_bytes, modified.

    With ``exts`` only files with one of these extensions.

    Unlike a file scan this sees empty files and names starting with '.' or
    '_', never enters the folder ``skip``, and keeps no listing on the driver:
    each level of folders is listed by tasks and written down.
    """
    if is_file(spark, root):
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(root)
        status = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jvm_path)
        seen = datetime.fromtimestamp(status.getModificationTime() / 1000, timezone.utc)
        return spark.createDataFrame([(root, status.getLen(), seen)], FILE)
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    folders = spark.createDataFrame([(root,)], "path string")
    levels = []
    while True:
        level = checkpointed(list_folders(folders, EXTENSION if exts else None, exts or ()))
        levels.append(level.where("not is_dir").drop("is_dir"))
        folders = level.where("is_dir")
        if skip is not None:
            folders = folders.where(f"path <> {literal(skip)}")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        folders = folders.repartition(tasks, "path")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Non-empty, not hidden files below ``root`` with their content.

    Listed by tasks like ``list_files``, so that the driver holds no listing,
    and dealt out by bytes. The content is read only by plans that select it.
    """
    if not path_exists(spark, root):
        raise FileNotFoundError(root)
    top = qualified(spark, root)
    found = list_files(spark, top).where("size_bytes > 0")
    if not is_file(spark, top):
        below = f"substring(path, {len(top) + 1})"
        found = found.where(f"not regexp_like({below}, {literal(HIDDEN)})")
    return with_content(found.withColumn("modified", F.date_trunc("millisecond", "modified")))


def select_inputs(
    listing: DataFrame, root: str, output_root: str, exts: Iterable[str] = SUPPORTED
) -> DataFrame:
    """Supported files of a listing outside the output root, with their keys."""
    files = filter_supported(listing, exts)
    return with_relative_key(exclude_output_subtree(files, output_root), root)


def discover_files(
    spark: SparkSession,
    root: str,
    output_root: str | None = None,
    exts: Iterable[str] = SUPPORTED,
) -> DataFrame:
    """Supported files below ``root`` outside ``output_root``, with their keys.

    The output root defaults to ``<root>/ocr`` and is compared by its full
    path, so an input folder that happens to be named alike stays in.
    """
    single = is_file(spark, root)
    top = qualified(spark, root)
    base = top.rsplit("/", 1)[0] if single else top
    out = qualified(spark, output_root) if output_root else f"{base}/{OUTPUT_FOLDER}"
    return select_inputs(list_files(spark, top, out, exts), base, out, exts)
