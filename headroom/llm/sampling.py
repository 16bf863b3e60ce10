"""A bounded sample of labelled rows, to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_text``, the label ``y`` as a double, and ``_order``, a hash, of about ``rows`` labelled rows at most.

    The rows with the smallest hashes of the key are taken, so more data change none of their order.
    Only keys and labels of the sample are broadcast.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("y"), F.xxhash64(F.col(key)).alias("_order")).where("y is not null and _key is not null")
    count = known.count()
    if count > rows:
        # the share of the range of hashes that holds the rows wanted
        top = int(-(2**63) + 2**64 * (rows / count))
        known = known.where(F.col("_order") < F.lit(min(top, 2**63 - 1)).cast("long"))
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return texts.join(F.broadcast(known), "_key")
