"""Corpus pipeline: language ID, exact dedup, near-duplicate removal, mixing
sources to target weights, BPE encoding.  Every stage reads the Parquet that
the stage before it wrote and works on all its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.llm import bpe, exact_dedup as ed, language_id as lid
from lakeward.llm.mixing import mix_sources
from lakeward.llm.ngram_join import near_duplicates
from lakeward.llm.queries import read, remainder, tokenizer_path, word_count
from lakeward.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A text that is null or has no letter, the only ones of score 0, is
    rejected; every other document stays, whatever its label, also when no
    labelled row is left to learn from.  A missing lang becomes the predicted
    one.  The model learns from the stage's own labelled rows."""
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = lid.train(docs, ~held)
    told = lid.predict_languages(docs.select(*COLUMNS), model).filter(F.col("lang_score") > 0)
    return told.withColumn("lang", F.coalesce("lang", F.nullif("lang_pred", F.lit(lid.UNDETERMINED)))).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return ed.exact_dedup(docs).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id stays."""
    lost = near_duplicates(docs).filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(lost, "doc_id", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, 0 to 3 times."""
    sized = docs.withColumn("size", word_count(F.col("text")))
    mixed = mix_sources(sized).filter("repetitions > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repetitions")))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian unsigned 32-bit) of every document."""
    out = bpe.encode_documents(docs, tokenizer_path(), keep=("lang", "source"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("ngram_jaccard", near_stage),
          ("source_mixing", mixing_stage), ("bpe_encoding", encoding_stage)]

# Language ID and BPE cannot be said in SQL; tests/llm checks the whole run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
