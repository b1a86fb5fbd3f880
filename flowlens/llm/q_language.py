"""Query of language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import fold, read
from flowlens.llm.language_crf import identify, train


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = train(docs, ~held_out)
    out = identify(docs.select("doc_id", "text"), model, score="score")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language": op1_language}
ORACLES: dict[str, str] = {}
