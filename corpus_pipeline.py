"""Training-data pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Part of the subpackage ``opslake.llm`` (registered as query ``pipeline``).
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.llm import decontaminate, jaccard_join, lang_id, packing, quality
from opslake.llm.queries import TOKENIZER, crc_mod
from opslake.sources.sinks import materialize
from opslake.sources.tables import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3 stay; learned from the training part of ``labels``."""
    labels = table(spark, sf_dir, "labels").where(crc_mod(5) != 0).select("doc_id", F.col("quality").alias("label"))
    return quality.keep_good(docs, labels, threshold=0.3)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject stay."""
    return lang_id.keep_identified(docs, lang_id.fit(docs.where(crc_mod(4) != 2).select("doc_id", "text", "lang")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return jaccard_join.one_per_group(docs, ngram=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item (0.8 of its five-word shingles or more) go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' tokens in sequences of 2048."""
    pieces = packing.tokenize_pieces(docs, TOKENIZER, capacity=2048, end_id=1)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=2048)


def bounded(stage):
    """``stage`` with texts that reach Python in batches of a few MB.

    Spark's limit of 64 MB is held several times over by every task, in the executor and in its Python worker.  The
    setting stays after the call, as rows are computed then; one that the session has already is left as it is.
    """
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        conf = docs.sparkSession.conf
        if conf.get(jaccard_join.BATCH_SETTING, None) is None:
            conf.set(jaccard_join.BATCH_SETTING, str(jaccard_join.BATCH_BYTES))
        return stage(spark, docs, sf_dir)
    return run


STAGES = [(name, bounded(stage)) for name, stage in [
    ("quality", keep_quality), ("language", keep_languages), ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark), ("packing", pack)]]

#: the stages learn models and tokenise, which SQL does not express; see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with jaccard_join._small_batches(spark):
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
