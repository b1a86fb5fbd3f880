"""Query of the license operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import read
from flowlens.llm.licenses import find_licenses


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_licenses(read(spark, sf_dir, "documents"))
    base = F.filter("spots", lambda s: s["phrase"])
    joined = lambda spots: F.array_join(F.array_sort(F.array_distinct(F.transform(spots, lambda s: s["label"]))), ",")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("spots")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spots", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op9_licenses": op9_licenses}
ORACLES: dict[str, str] = {}
