"""Sends the library to the executors, whose Python workers import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the library to the session's Python files, once a context: workers then
    find it whatever folder or path they were started with."""
    context = spark.sparkContext
    if getattr(context, "_verbatim_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="verbatim-code-"), "verbatim_spark.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(package)))
    context.addPyFile(path)
    context._verbatim_shipped = True
