"""A corpus pipeline of five stages: quality rules, line dedup, near copies, mixing, tokenization.

Each stage takes the documents that the one before it kept, as Parquet, and its decisions take effect: rejected
documents go, later copies of line runs are cut from the texts, one document of each group of near copies stays, sources
are mixed to their target weights, and the last stage gives the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, jaccard_join, line_dedup, mixing, quality
from larkspur.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    verdicts = quality.quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["text", "source", "n_chars"])
    return verdicts.where("kept").select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of line runs; ``n_chars`` is that of the text that is left."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id, nulls last; texts without words stay, once for each id."""
    rows = written(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()))  # ids may repeat or be null
    found = jaccard_join.near_copies(rows.select(F.col("_row").alias("doc_id"), "text")).withColumnsRenamed({"doc_id": "_row", "component_id": "_group"})
    placed = found.join(rows.select("_row", "doc_id", F.xxhash64("text").alias("_name")), "_row")
    own = F.when((F.col("n_shingles") == 0) & F.col("doc_id").isNotNull(), F.col("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_name", "_row"))
    stays = placed.withColumn("_own", own).groupBy(F.when(own.isNull(), F.col("_group")).alias("_group"), "_own").agg(first.alias("_first"))
    return rows.join(stays.select("_first._row"), "_row").select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, those taken twice twice."""
    return mixing.mixed_documents(docs).select(COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document of the mix."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_copy_stage), ("mixing", mixing_stage), ("BPE", token_stage)]
ORACLE_SQL = None  # SQL cannot say the tokens; tests run the stages against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
