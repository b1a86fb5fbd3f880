"""Standardisation fitted on training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAT = 1e-6


def standardise_fit(df: DataFrame, columns: Sequence[str], train: Column | None = None) -> DataFrame:
    """One row with ``mean__c`` and ``std__c`` (population) of the training rows; a flat column gets 1."""
    rows = df if train is None else df.where(train)
    parts = []
    for c in columns:
        spread = F.stddev_pop(c)
        parts += [F.avg(c).alias(f"mean__{c}"), F.when(spread < FLAT, F.lit(1.0)).otherwise(spread).alias(f"std__{c}")]
    return rows.agg(*parts)


def standardise_table(fit: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The fit as rows (feature, mean, std)."""
    triples = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"mean__{c}").alias("mean"), F.col(f"std__{c}").alias("std")) for c in columns])
    return fit.select(F.explode(triples).alias("t")).select("t.*")


def standardise_apply(df: DataFrame, fit: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / std on every row; the one-row fit is read as a scalar."""
    whole = fit.select(F.struct(*fit.columns).alias("fit")).scalar()
    staged = df.withColumn("_fit", whole)
    return staged.withColumns({c: (F.col(c) - F.col(f"_fit.mean__{c}")) / F.col(f"_fit.std__{c}") for c in columns}).drop("_fit")


def training_nodes(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Host rows of windows that contain at least one training flow."""
    windows = flows.where(F.col("split") == 0).select("window_id").distinct()
    return nodes.join(windows, "window_id", "left_semi")
