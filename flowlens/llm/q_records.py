"""Query of the record files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import read
from flowlens.llm.records import read_records, write_records

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_records(read(spark, sf_dir, "documents"), BYTE_BPE, END_ID)
    return read_records(spark, files).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op6_records": op6_records}
ORACLES: dict[str, str] = {}
