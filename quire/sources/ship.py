"""Sending this package's code to the Python workers."""

from __future__ import annotations

import importlib
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[tuple[str, str]] = set()


def ship(spark: SparkSession, package: str = "quire") -> None:
    """Have the workers of this application import ``package``; once is enough.

    Functions run by tasks are sent by name, and an executor, or a driver
    started in another folder, does not find them otherwise.
    """
    context = spark.sparkContext
    if (context.applicationId, package) in _SHIPPED:
        return
    folder = os.path.dirname(os.path.abspath(importlib.import_module(package).__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="quire-code-"), f"{package}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for place, _, names in os.walk(folder):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(place, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(folder)))
    context.addPyFile(archive)
    _SHIPPED.add((context.applicationId, package))
