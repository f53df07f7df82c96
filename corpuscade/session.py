"""Session building, the shared work folder, and cutting lineage through written tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "corpuscade", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes: UTC, AQE with skew handling, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent (tests, a laptop) a temporary folder is made, used for the
    life of the process and then removed.  On a cluster the setting must be present.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get(CHECKPOINT_KEY, None) or conf.get(CHECKPOINT_KEY)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="corpuscade-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set(CHECKPOINT_KEY, "file://" + own)
    return "file://" + own


#: Work paths made within the scratch scopes that are open.
_OPEN: list[list[str]] = []


def work_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/corpuscade/{tag}-{uuid.uuid4().hex[:12]}"
    for paths in _OPEN:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the work tables made within it at its end, so results must be written or collected there.

    ``with scratch(spark): pairs(...).write.parquet(target)``
    """
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN.remove(paths)
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return the reader of what was written.

    Unlike a cache it survives the loss of an executor, and later stages start from files.
    """
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str:
    """The path of a ``file:`` URI."""
    return os.path.abspath(uri.removeprefix("file://").removeprefix("file:"))


def located(uri: str):  # noqa: ANN201
    """The pyarrow file system of a URI, and the path there; a path without scheme is a local one."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), local_path(uri)
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


def scalars(one_row: DataFrame) -> dict[str, Column]:
    """The columns of a table of one row as scalar subqueries, to be used in another table's plan.

    Unlike a join with the row it can't multiply rows, and an empty table gives nulls.
    """
    row = one_row.select(F.struct(*one_row.columns).alias("row")).scalar()
    return {name: row.getField(name) for name in one_row.columns}


def clear_work(spark: SparkSession) -> None:
    """Remove all tables written into the shared folder; results that read them are gone too."""
    remove(spark, f"{shared_dir(spark)}/corpuscade")
