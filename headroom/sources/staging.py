"""Intermediate tables in the cluster's shared folder.

Steps exchange Parquet tables.  A staged table cuts lineage, survives the loss of any
executor, and, unlike a row-serialised checkpoint, keeps column pruning and filter
pushdown for whoever reads it next.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query are freed when it ends; those of a written table are not read again.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The JVM never compiles methods of more than 8,000 bytes.  Beyond this limit Spark generates small ones for each operator instead.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_LOCAL_FOLDERS: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Unset on a local master (unit tests), a temporary folder that goes away with the
    process stands in; unset on a cluster, that is an error, since executors could not
    see each other's local disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.TemporaryDirectory(prefix="headroom-")
    return _LOCAL_FOLDERS[app].name


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    return f"{shared_folder(spark)}/headroom/{name}-{uuid.uuid4().hex}"


@contextmanager
def with_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while."""
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def short_methods(spark: SparkSession):
    """For what is written with conditions so long that their code could exceed what the JVM compiles."""
    return with_settings(spark, {METHOD_LIMIT: "8000"})


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table."""
    path = fresh_path(df.sparkSession, name)
    with with_settings(df.sparkSession, {FREE_SHUFFLES: "true"}):
        df.write.parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)
