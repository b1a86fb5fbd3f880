"""Query of the toxicity score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import fold, read
from flowlens.llm.toxicity import toxicity, train


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = train(docs, read(spark, sf_dir, "labels"), ~held_out)
    out = toxicity(docs.select("doc_id", "text"), model, out="score")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
