"""Query of the BPE operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.bpe_automaton import encode_decode
from flowlens.llm.common import read

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(read(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE)
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op4_bpe": op4_bpe}
ORACLES: dict[str, str] = {}
