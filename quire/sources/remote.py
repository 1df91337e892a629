"""Reading and writing single files from inside tasks, on any shared storage."""

from __future__ import annotations

import hashlib
import math
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.ship import ship
from quire.sources.spread import dealt_by_weight

CHUNK = 1 << 20
#: Bytes that one task reads, and what opening a file costs in bytes.
TASK_BYTES = 256 << 20
OPEN_BYTES = 1 << 16
#: Bytes of whole files that are handed on together.
CONTENT_BYTES = 16 << 20
OBJECT_STORES = ("s3", "gcs", "abfs")
#: Names that Hadoop has for stores, and those that the file systems here go by.
SCHEMES = {
    "hdfs": "hdfs", "viewfs": "viewfs", "gs": "gs", "gcs": "gcs", "abfs": "abfs", "abfss": "abfss",
    "s3": "s3", "s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss",
}


def locate(uri: str):
    """File system and path of a URI as Spark prints it (unescaped).

    A store that isn't known raises; it is no fault of a single file.
    """
    from pyarrow import fs

    found = re.match(r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/]*))?(/.*)$", uri, re.DOTALL)
    if found is None or found[1] == "file":
        return fs.LocalFileSystem(), uri if found is None else found[3]
    if found[1].lower() not in SCHEMES:
        raise ValueError(f"no file system for {found[1]}: {uri}")
    store, base = fs.FileSystem.from_uri(f"{SCHEMES[found[1].lower()]}://{found[2] or ''}/")
    return store, base.rstrip("/") + found[3]


def file_checksum(uri: str) -> str | None:
    """Digest of a file read in chunks; None if it cannot be read."""
    digest = hashlib.sha256()
    store, path = locate(uri)
    try:
        with store.open_input_stream(path) as stream:
            while chunk := stream.read(CHUNK):
                digest.update(chunk)
    except OSError:
        return None
    return "sha256:" + digest.hexdigest()


def dealt_files(files: DataFrame) -> DataFrame:
    """The files dealt out by their bytes into as many tasks as these ask for.

    A listing has a folder's entries in one task.
    """
    ship(files.sparkSession)
    cores = files.sparkSession.sparkContext.defaultParallelism

    def tasks(n: int, total: float) -> int:
        return max(min(n, cores), math.ceil(total / TASK_BYTES))

    weight = f"coalesce(size_bytes, 0) + {OPEN_BYTES}"
    return dealt_by_weight(files, "path", weight, tasks)


def with_file_checksum(files: DataFrame) -> DataFrame:
    """Add ``checksum`` by streaming each file inside the tasks.

    Unlike the ``content`` of a file scan, no file is held in memory whole,
    and one that cannot be read gives null instead of failing the job.
    """

    @F.pandas_udf("string")
    def digest(paths: pd.Series) -> pd.Series:
        return paths.map(file_checksum)

    return dealt_files(files).withColumn("checksum", digest("path"))


def with_content(files: DataFrame) -> DataFrame:
    """Add ``content``, each file's bytes, read inside the tasks by plans that select it.

    A task holds about CONTENT_BYTES, or one file, at a time; a file that
    cannot be read fails the job.
    """

    @F.pandas_udf("binary")
    def content(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for paths in batches:
            held, size = [], 0
            for uri in paths:
                store, path = locate(uri)
                with store.open_input_stream(path) as stream:
                    held.append(stream.read())
                size += len(held[-1])
                if size >= CONTENT_BYTES:
                    yield pd.Series(held, dtype=object)
                    held, size = [], 0
            if held:
                yield pd.Series(held, dtype=object)

    return dealt_files(files).withColumn("content", content("path"))


LISTING = "path string, is_dir boolean, size_bytes bigint, modified timestamp"
#: Entries of a folder that are held at a time.
PAGE_ENTRIES = 10_000

Entry = tuple[str, bool, int, int | None]


def entries(uri: str) -> Iterator[Entry]:
    """Name, whether it is a folder, size and time of change (microseconds) of a folder's entries.

    Entries of a local or mounted folder come one by one, as the system reads
    them; other stores' clients give a folder at once.
    """
    from pyarrow import fs

    store, base = locate(uri)
    if isinstance(store, fs.LocalFileSystem):
        try:
            with os.scandir(base or "/") as found:
                for e in found:
                    try:
                        folder, seen = e.is_dir(), e.stat()
                    except FileNotFoundError:  # gone meanwhile, or a link to nothing
                        continue
                    yield e.name, folder, 0 if folder else seen.st_size, seen.st_mtime_ns // 1000
        except FileNotFoundError:
            return
        return
    for i in store.get_file_info(fs.FileSelector(base or "/", allow_not_found=True)):
        seen = i.mtime_ns // 1000 if i.mtime_ns else None
        yield i.base_name, i.type == fs.FileType.Directory, i.size or 0, seen


def entry_pages(uri: str, extension: str | None, exts: Iterable[str]) -> Iterator[list[Entry]]:
    """The folders and the files with one of the extensions (all without a pattern), page by page.

    ``extension`` is the pattern whose first group is a path's extension.
    """
    known, page = {e.lower() for e in exts}, []
    for entry in entries(uri):
        if extension and not entry[1]:
            found = re.search(extension, f"/{entry[0]}")
            if found is None or found[1].lower() not in known:
                continue
        page.append(entry)
        if len(page) == PAGE_ENTRIES:
            yield page
            page = []
    if page:
        yield page


def list_folders(folders: DataFrame, extension: str | None = None, exts: Iterable[str] = ()) -> DataFrame:
    """Entries of every folder (column ``path``), listed inside the tasks.

    With ``extension`` files of other extensions than ``exts`` don't leave the task.
    """
    ship(folders.sparkSession)
    wanted = tuple(exts)

    def frame(held: list[Entry]) -> pd.DataFrame:
        paths, is_dir, sizes, seen = zip(*held, strict=True)
        modified = pd.Series(np.array(seen, "datetime64[us]")).dt.tz_localize("UTC")
        return pd.DataFrame({"path": paths, "is_dir": is_dir, "size_bytes": sizes, "modified": modified})

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Entry] = []
        for batch in batches:
            for uri in batch["path"]:
                for page in entry_pages(uri, extension, wanted):
                    held += [(f"{uri}/{name}", *more) for name, *more in page]
                    if len(held) >= PAGE_ENTRIES:
                        yield frame(held)
                        held = []
        if held:
            yield frame(held)

    return folders.select("path").mapInPandas(listed, LISTING)


def with_existence(rows: DataFrame, root: str, path: str = "output_path") -> DataFrame:
    """Rows whose file ``root``/``path`` exists, looked up inside the tasks."""
    ship(rows.sparkSession)

    @F.pandas_udf("boolean")
    def there(paths: pd.Series) -> pd.Series:
        store, base = locate(root)
        infos = store.get_file_info([f"{base}/{p}" for p in paths])
        return pd.Series([i.is_file for i in infos])

    return rows.where(there(path))


def content_writer(root: str) -> Callable[[bytes], str]:
    """A function that stores bytes below ``root`` under their hash and returns the file's URI."""
    from pyarrow import fs

    store, base = locate(root)
    whole = store.type_name in OBJECT_STORES

    def keep(data: bytes) -> str:
        name = hashlib.sha256(data).hexdigest()
        folder, path = f"{base}/{name[:2]}", f"{base}/{name[:2]}/{name}.png"
        if store.get_file_info(path).type == fs.FileType.NotFound:
            if not whole:
                store.create_dir(folder, recursive=True)
            draft = path if whole else f"{folder}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as stream:
                stream.write(data)
            if not whole:
                store.move(draft, path)
        return f"{root}/{name[:2]}/{name}.png"

    return keep


def write_files(files: DataFrame, root: str) -> int:
    """Write rows (path, data) below ``root`` from the tasks; returns their number.

    ``data`` is the file's bytes, or in a column named ``source`` instead the URI
    of a file of the same store to copy. Every file appears under its name only
    when complete, so a repeated task replaces it by the same bytes.
    """
    ship(files.sparkSession)
    copied = "source" in files.columns

    def store_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = locate(root)
        # Object stores have no folders, and show an object only when it is whole.
        whole = store.type_name in OBJECT_STORES
        folder = None
        for batch in batches:
            for path, data in zip(batch["path"], batch["source" if copied else "data"], strict=True):
                target = f"{base}/{path}"
                above, name = target.rsplit("/", 1)
                if above != folder and not whole:
                    store.create_dir(above, recursive=True)
                    folder = above
                draft = target if whole else f"{above}/.{name}.{uuid.uuid4().hex}"
                if copied:
                    store.copy_file(locate(data)[1], draft)
                else:
                    with store.open_output_stream(draft) as stream:
                        stream.write(data)
                if not whole:
                    store.move(draft, target)
            yield pd.DataFrame({"n": [len(batch)]})

    data = F.col("source") if copied else F.col("data").cast("binary").alias("data")
    rows = files.select("path", data)
    return rows.mapInPandas(store_batches, "n bigint").agg(F.sum("n")).first()[0] or 0
