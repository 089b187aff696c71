"""Five stages over ``documents``, each written as Parquet and read again as the next one's input.

Part of the training-data operators: it goes where ``formline.llm`` goes.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm import byte_bpe, pii_crf, poisson_mix, quality_knn, trie_join
from formline.llm.common import NULL_ID, real_id, shared_root, unique_ids
from formline.llm.queries import MIX_WEIGHTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; labels of the tables teach it, on the learning split only.

    Texts that share an id, or have none, are judged each by itself.  Null and empty texts score 0 and go;
    repeated rows get one verdict, so they stay or go together.  Extra columns are dropped, an empty table stays empty.
    """
    scores = quality_knn.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), text_key=True)
    kept = scores.where("predicted = 1").select(F.col("doc_id").alias("_id"), "text_hash").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_hash"))
    return docs.join(kept, same, "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one that names its component.

    Different texts that share an id, or have none, are documents of their own; rows with equal id and text are one.
    Of a group the smallest id stays (null is the smallest).  Null and empty texts are near nothing and stay.
    """
    filled = {"doc_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "text": F.coalesce("text", F.lit("")), "_none": F.col("text").isNull()}
    keyed = unique_ids(docs.select(*COLUMNS).withColumns(filled))
    groups = trie_join.jaccard_components(keyed)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id")).distinct()
    kept = keyed.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.withColumns({"doc_id": real_id("given_id"), "text": F.when(~F.col("_none"), F.col("text"))}).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the new text.

    A null text stays null, with a null ``n_chars``; every row stays, repeated ones too.
    """
    return pii_crf.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target shares by Poisson replication, in random order.

    The null source and sources without a stated weight get weight 1.  Repeated rows have equal counts.
    """
    return poisson_mix.mix(docs, MIX_WEIGHTS).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy as token ids: count and digests of ids and of the decoded bytes; null and empty texts have none."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing to target weights", mixing),
    ("byte-level BPE", encoding),
]
#: Stages 1, 2, 3 and 5 can't be said in SQL; tests/llm hold the stages against what they say and the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_root(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
