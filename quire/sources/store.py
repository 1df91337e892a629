"""Small files on shared storage, that are there whole or not at all."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

EXISTS = ("FileAlreadyExistsException", "PathExistsException")


class Taken(RuntimeError):
    """A file of that name exists already."""


def opened(spark: SparkSession, path: str):
    """The file system of a path and the path as it takes it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def listed(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """Path and time of change (milliseconds) of what a pattern finds, by name."""
    store, jvm_path = opened(spark, pattern)
    found = store.globStatus(jvm_path) or []
    return sorted((s.getPath().toString(), s.getModificationTime()) for s in found)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    store, jvm_path = opened(spark, path)
    stream = store.open(jvm_path)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def removed(spark: SparkSession, path: str) -> None:
    store, jvm_path = opened(spark, path)
    store.delete(jvm_path, True)


def publish(spark: SparkSession, path: str, data: bytes) -> None:
    """Show ``data`` under ``path``; raises ``Taken`` if something is there.

    It is written aside and then takes its name in one step, by a link on a
    local file system and by a rename that replaces nothing on others. So what
    is seen is whole, and of two writers of a name one gets it. Of a store that
    has no such rename only one writer at a time may use a folder.
    """
    store, target = opened(spark, path)
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    if store.getScheme() == "file":
        local = unquote(urlparse(store.makeQualified(target).toString()).path)
        aside = f"{os.path.dirname(local)}/{draft.rsplit('/', 1)[1]}"
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(aside, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(aside, local)
        except FileExistsError as e:
            raise Taken(path) from e
        finally:
            os.unlink(aside)
        return
    aside = spark._jvm.org.apache.hadoop.fs.Path(draft)
    stream = store.create(aside, False)
    stream.write(bytearray(data))
    stream.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
    try:
        context.rename(aside, target, options)
    except Py4JJavaError as e:
        store.delete(aside, False)
        if e.java_exception.getClass().getSimpleName() in EXISTS:
            raise Taken(path) from e
        raise
