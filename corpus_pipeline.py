"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; the next stage reads
what it returned, written as Parquet.  The last stage returns the packed pieces, all others the columns of
``documents``.

Cases, for every stage: a row is told by its doc_id and its text, so rows with a null doc_id, and rows that share a doc_id,
are judged each by their own text; null and empty texts are clean; an empty table gives an empty table; columns beyond
those of ``documents`` pass through; texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundsmith.llm import decontaminate, neardup, packing, secrets, toxicity
from roundsmith.llm.common import stored
from roundsmith.llm.registry import tokenizer_path


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_hash", _text_hash())


def _named(found: DataFrame, *more: str) -> DataFrame:
    """(_to_id, _to_hash, ...) of rows (doc_id, text_hash, ...), each once."""
    return found.select(F.col("doc_id").alias("_to_id"), F.col("text_hash").alias("_to_hash"), *more).dropDuplicates(["_to_id", "_to_hash"])


def _same() -> Column:
    return F.col("_id").eqNullSafe(F.col("_to_id")) & (F.col("_hash") == F.col("_to_hash"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; repeated rows go together."""
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _keyed(docs).join(_named(scored.where("predicted = 1")), _same(), "left_anti").select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component stays, once: the smallest doc_id, null ones last, ties by text.

    Rows without words are no copies of each other and stay, but one of those that repeat a doc_id.
    """
    found = _named(neardup.near_duplicates(docs, shingle_words=5).where("first"), F.col("n_shingles").alias("_n"))
    left = _keyed(docs).join(found, _same())
    # A row that is told by nothing, neither doc_id nor words, is no repetition.
    tie = F.when(F.col("_id").isNull() & (F.col("_n") == 0), F.monotonically_increasing_id()).otherwise(F.lit(0))
    return left.withColumn("_tie", tie).dropDuplicates(["_id", "_hash", "_tie"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    # The operator names documents by one number: here the hash of doc_id and text.
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    texts = docs.select(key.alias("doc_id"), "text")
    found = decontaminate.overlaps(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_key")).distinct()
    return docs.withColumn("_key", key).join(found, "_key", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials of one owner are replaced in the text; every document stays."""
    found = secrets.scan_secrets(docs).where(F.exists("found", lambda f: f["verdict"] == "live"))
    joined = _keyed(docs).join(_named(found, F.col("found").alias("_found")), _same(), "left")
    clean = F.when(F.col("_found").isNotNull(), secrets.redact(F.col("text"), F.col("_found"))).otherwise(F.col("text"))
    joined = joined.withColumn("text", clean)
    return joined.withColumn("n_chars", F.when(F.col("_found").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document, packed into sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), "word", end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Nearest labelled examples and byte-pair encoding are beyond SQL; ``tests/llm/test_pipeline.py`` holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
