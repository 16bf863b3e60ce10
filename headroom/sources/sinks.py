"""Writing result tables.  A sink replaces what its path held before; predictions do so model by model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Options for rows of some MB: few in a row group, since readers decode up to a row group at once.
LONG_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1}


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, options: dict | None = None) -> str:
    writer = df.write.mode("overwrite").options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def by_time(features: DataFrame) -> DataFrame:
    """Feature rows in the layout to store them in: by time inside each file.

    Splits, folds and key searches filter on time, so their scans then skip most pages.
    The sort is local to a task; rows stay where the window put them.
    """
    return features.sortWithinPartitions("start_time")


def write_features(df: DataFrame, path: str) -> str:
    return write_parquet(by_time(df), path)


def write_predictions(df: DataFrame, path: str) -> str:
    """One Parquet table partitioned by model; only the models that ``df`` has are replaced.

    Rows gather by model first, and a large model is split again, so that files are few and
    of even size.  The new files are written beside the table and take the place of a model's
    old ones when all are complete; a write that fails leaves the table as it was.
    """
    writer = df.hint("rebalance", "model").write.mode("overwrite").partitionBy("model")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    return path


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written at the path to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def write_csv(df: DataFrame, path: str) -> str:
    """A headed CSV table; used for result tables of a few rows per model."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """One JSON object per row, NULL fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON string."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))
