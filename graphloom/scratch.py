"""Written intermediate tables: they cut the lineage of loops and survive the loss of executors.

Tables lie under the folder that the session names in ``spark.checkpoint.dir``. Where that is unset (tests, local
runs), one temporary folder per process is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections import Counter
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local: str | None = None


def root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    global _local
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a shared folder")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return _local


class Scratch:
    """The intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{root(spark)}/graphloom-{label}-{uuid.uuid4().hex[:12]}"
        self.made = 0  # tables written so far
        self.written: Counter[str] = Counter()  # of each name
        atexit.register(self._remove, self.folder)

    def _remove(self, place: str) -> None:
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        except Exception:  # the session may be gone; the cluster's folder is then swept by its owner
            pass

    def table(self, df: DataFrame, name: str = "t", **metrics: Column) -> DataFrame:
        """Write df and return it as read from its files. Its number of rows and further aggregates, all taken while
        writing and not by another job, are in ``row_count`` and ``metrics``."""
        self.made += 1
        self.written[name] += 1
        place = f"{self.folder}/{self.made:03d}-{name}"
        seen = Observation()
        with released_shuffles(self.spark):
            df.observe(seen, F.count(F.lit(1)).alias("_n"), *(c.alias(k) for k, c in metrics.items())).write.mode("overwrite").parquet(place)
        out = self.spark.read.schema(df.schema).parquet(place)
        out._graphloom_place, out.metrics = place, dict(seen.get)
        out.row_count = out.metrics.pop("_n")
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing needs any more."""
        for t in tables:
            place = getattr(t, "_graphloom_place", None)
            if place:
                self._remove(place)


@contextmanager
def released_shuffles(spark: SparkSession):
    """Let Spark remove the shuffle files of a query as soon as its result is written, where the version can."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    try:
        before = spark.conf.get(key, None)
        spark.conf.set(key, "true")
    except Exception:
        yield
        return
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
