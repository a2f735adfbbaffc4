"""From raw documents to packed training sequences: five stages, each applying one operator to what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adatlas.llm import mixing, ngram_join, packing, secrets, toxicity
from adatlas.llm.common import stash


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored 0.7 or more.

    Null and empty texts score low and stay; repeated rows are judged each; columns of any name are kept; an empty
    table gives an empty result.
    """
    scored = toxicity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=True)
    return scored.where("score < 0.7").select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 80 % of its five-word shingles: that with the smallest id.

    Different texts under one id are apart, unless they link. Rows without words all stay, but for exact repeats (same
    id and text). Rows without an id take part; one stays of a group in which no row has an id. Columns of any name are
    kept; an empty table gives an empty result.
    """
    heads = ngram_join.join(docs, percent=80, shingle=5, heads=True).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.struct(*docs.columns).alias("row"))
    kept = own.join(heads, own["id"].eqNullSafe(heads["id"]) & (own["hash"] == heads["hash"]), "left_semi")
    return kept.dropDuplicates(["id", "hash"]).select("row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every row and column stays, null and empty texts as they are."""
    return secrets.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words and are not taken; a null source is a source of its own; repeated rows count
    each; columns of any name are kept; an empty table gives an empty result.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences.

    Null and empty texts are an end alone, null ids stay null, repeated rows are packed each, other columns go; an empty
    table gives an empty result.
    """
    return packing.pack(docs)


STAGES = [("toxicity", without_toxic), ("near_copies", without_near_copies), ("secrets", without_secrets), ("mixing", mixed_sources), ("packing", packed)]
#: Learned scores, tagging and tokenization can't be stated in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
