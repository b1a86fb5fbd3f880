"""Query of the whitening of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import read
from flowlens.llm.whitening import whiten


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(read(spark, sf_dir, "embeddings"), components=4, scale=256.0, weights="one")
    return out.withColumnRenamed("id", "vec_id").withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
