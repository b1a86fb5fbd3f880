"""From raw documents to token ids: language, near copies, secrets, mixture, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.bpe_automaton import encode_decode
from flowlens.llm.common import connected, packed
from flowlens.llm.language_crf import identify, train
from flowlens.llm.mixing import cut_table, random_key, with_taken, word_count
from flowlens.llm.secret_scan import find_secrets, redacted
from flowlens.llm.simhash import fingerprints, groups, similar_groups
from flowlens.tables import cut, new_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: A text in which no language reaches this share of the letters is rejected.
LEAST_SHARE = 0.3
#: Words of a shingle of the fingerprints, as in ``op5_simhash``.
WORDS = 3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that the labelled documents teach; a missing language is filled in.

    Rejected: null texts, texts without a letter, and texts no language has ``LEAST_SHARE`` of. Without any labelled document nothing
    can be predicted, and every text with a letter stays.
    """
    model = train(docs, F.lit(True))
    out = identify(packed(docs, "text", lang=F.col("lang")), model, "_text", lang="_lang_pred", score="_lang_score")
    known = F.col("_lang_pred") != "und"
    stays = known & (F.col("_lang_score") >= LEAST_SHARE) if model.langs else F.col("_text").rlike(r"\p{L}")
    lang = F.coalesce("lang", F.when(known, F.col("_lang_pred")))
    return out.where(stays).select(*[(lang if c == "lang" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Texts are linked if their fingerprints differ in at most 3 bits, found by the trees of ``op5_simhash``, and also if their shingle sets are
    similar, which fingerprints alone would miss. Groups are what both kinds of links connect.

    Rows without an id are told apart by their text and come after those with one; of rows that agree in id and text one stays.
    """
    lead = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))
    rows = packed(docs, "text", lead=lead)
    prints = cut(fingerprints(rows.select("lead", "_text"), ["lead"], "_text", WORDS), "prints")
    near = prints.join(groups(prints, "lead").withColumnRenamed("lead", "near"), "fp").select("lead", "near").distinct()
    alike = similar_groups(rows, "lead", "_text").distinct()
    both = cut(alike.join(near, "lead").select("lead", F.xxhash64("near").alias("a"), F.xxhash64("first").alias("b")), "both")
    roots = cut(connected(both.select("a", "b")), "united")  # a group stands under its first document
    placed = both.join(roots.select(F.col("node").alias("b"), "root"), "b", "left").select("lead", F.coalesce("root", "b").alias("root"))
    kept = cut(placed.groupBy("root").agg(F.min("lead").alias("lead")).select("lead"), "kept")
    others = [F.col(f"_row.`{c}`") for c in docs.columns if c != "text"]  # as JSON, since a map has no order
    first = F.row_number().over(Window.partitionBy("lead").orderBy(F.to_json(F.struct(*others))))
    stays = rows.select("_row", "lead").join(kept, "lead", "left_semi").withColumn("place", first).where(F.col("place") == 1)
    return stays.select("_row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by a mark; n_chars follows the text."""
    found = find_secrets(packed(docs, "text"), "_text", "_spans")
    hit = F.size("_spans") > 0
    clean = redacted(F.col("_text"), F.col("_spans"))
    found = found.select("_row", F.when(hit, clean).otherwise(F.col("_row.text")).alias("_clean"), hit.alias("_hit"))
    n_chars = F.when(F.col("_hit"), F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    new = {"text": F.col("_clean"), "n_chars": n_chars}
    return found.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: whole epochs, then in random order until the budget of words is full.

    Documents stay whole: the one at the cut is in if the mix takes at least half of it. Documents without a word are not taken.
    """
    size = word_count(F.col("text"))
    sized = packed(docs, "text", source=F.col("source"), size=size, key=random_key(F.col("doc_id"), size, "mix")).drop("_text")
    table = cut_table(cut(sized.select("source", "size", "key"), "sizes"))
    taken = with_taken(sized, table)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")).otherwise(0)
    copied = taken.select("_row", copies.alias("copies")).where(F.col("copies") > 0)
    return copied.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids of the text, and the text that they decode to."""
    return encode_decode(docs.select("doc_id", "lang", "source", "text"), WORD_BPE).drop("text")


STAGES = [("language", language), ("near_copies", near_copies), ("secrets", secrets), ("mixture", mixture), ("encoding", encoding)]

#: SQL can express neither the language model nor the groups of similar texts; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
