"""Make this package importable in Python workers wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

import tessera


def ship(spark) -> None:
    """Send the package's sources to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(tessera.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._tessera_shipped = True
