"""Make this package importable in the Python workers of executors that were not started with it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[tuple[str, str]] = set()


def _is_local(context) -> bool:
    return context.master.startswith("local[") or context.master == "local"


def ship(spark: SparkSession, *files: str) -> None:
    """Send the package, and files that workers read, to the executors, once an application. Local mode needs nothing.

    Workers find a file by :func:`shipped`. One that is not there on the driver is expected at its path on executors.
    """
    context = spark.sparkContext
    if _is_local(context):
        return
    for f in files:
        if (context.applicationId, f) not in _shipped and os.path.exists(f):
            context.addFile(f)
            _shipped.add((context.applicationId, f))
    if (context.applicationId, "") in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    place = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom.zip")
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for f in names:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    context.addPyFile(place)
    _shipped.add((context.applicationId, ""))


def shipped(path: str) -> str:
    """On a worker: where a file sent by :func:`ship` lies, else the path itself."""
    from pyspark import SparkFiles

    try:
        here = SparkFiles.get(os.path.basename(path))
    except Exception:  # no files were sent to this worker
        return path
    return here if os.path.exists(here) else path
