"""A session with the settings that the plans assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Adaptive execution re-plans joins and splits skewed ones; Arrow carries batches; times are UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="shared")


def session(name: str = "arborlane", master: str | None = None, **settings: str) -> SparkSession:
    """The running session or a new one; settings override SETTINGS."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


#: Folders that `scratch` made and nothing removed yet.
_made: list[str] = []


def scratch(spark: SparkSession, kind: str) -> str:
    """The path of a new folder for tables that last as long as the plans that read them."""
    _made.append(f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}")
    return _made[-1]


def scratch_mark() -> int:
    """A point in the order of scratch folders, for `purge_scratch`."""
    return len(_made)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a scratch folder that no plan reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _made:
        _made.remove(folder)


def purge_scratch(spark: SparkSession, since: int = 0) -> int:
    """Deletes the scratch folders made since a mark, whose plans must have run; how many there were."""
    gone = _made[since:]
    for folder in gone:
        discard(spark, folder)
    return len(gone)
