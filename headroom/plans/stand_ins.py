"""Forecasters simple enough to state in SQL, used to check the policy operators.

Seven predictors in the shape of the forest variants' prediction table: earlier values, a
mean of them, a rolling mean, the earlier peak, the train mean and a fitted line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom import contracts as C
from headroom.operators.ordering import TimeSplit

MODELS = ["lag1", "lag2", "mean3", "roll6", "peak", "train_mean", "trend"]
REFERENCE_MODEL = "lag1"


def stand_in_predictions(split: TimeSplit) -> DataFrame:
    """Predictions of all stand-ins for the test rows, which are read once."""
    fit = split.train.agg(
        F.avg(C.TARGET).alias("mean"),
        F.regr_slope(C.TARGET, "avg_cpu_lag1").alias("slope"),
        F.regr_intercept(C.TARGET, "avg_cpu_lag1").alias("intercept"),
    ).first()
    lags = [F.col(f"avg_cpu_lag{k}") for k in (1, 2, 3)]
    predicted = [
        lags[0],
        lags[1],
        (lags[0] + lags[1] + lags[2]) / 3,
        F.col("avg_cpu_roll_mean6"),
        F.col("max_cpu_lag1"),
        F.lit(fit["mean"]),
        F.lit(fit["slope"]) * lags[0] + F.lit(fit["intercept"]),
    ]
    scored = F.explode(
        F.array(
            *[
                F.struct(F.lit(model).alias("model"), value.alias("predicted_cpu"))
                for model, value in zip(MODELS, predicted)
            ]
        )
    )
    return split.test.select("*", scored.alias("scored")).select(
        "scored.model",
        "start_time",
        "collection_id",
        "instance_index",
        "machine_id",
        F.col(C.TARGET).alias("actual_cpu"),
        "scored.predicted_cpu",
        "resource_request_cpu",
        "row_id",
    )
