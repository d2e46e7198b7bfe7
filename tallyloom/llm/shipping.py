"""Takes this package to the executors, for operators whose tasks run Python."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame

import tallyloom

_sent: set[tuple[str, str]] = set()


def shipped(frame: DataFrame) -> DataFrame:
    """``frame``, after Spark has been given the package's modules to hand to its workers.

    Executors need neither the repository nor a search path that leads to it. The archive is made once per
    application; Spark copies it from the driver to each executor.
    """
    context = frame.sparkSession.sparkContext
    root = os.path.dirname(os.path.abspath(tallyloom.__file__))
    files = sorted(os.path.join(top, name) for top, _, names in os.walk(root) for name in names if name.endswith(".py"))
    if not files:  # the package itself comes from an archive, which Spark has already
        return frame
    digest = hashlib.sha256()
    for path in files:
        with open(path, "rb") as file:
            digest.update(path.encode() + file.read())
    key = (context.applicationId, digest.hexdigest())
    if key not in _sent:
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"tallyloom-{key[1][:12]}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in files:
                out.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(archive)
        _sent.add(key)
    return frame
