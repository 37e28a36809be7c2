"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

All stages take any columns beside doc_id and text, whatever their names, and return them unchanged (the last one returns
pieces); whole texts are read, however long.  An empty table goes through to an empty result.  Repeated rows go the same
way, but that near_duplicates keeps one row of each text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm.common import materialize, table
from kvlake.llm.jaccard_join import Join
from kvlake.llm.language import keep_known
from kvlake.llm.packing import pack_documents
from kvlake.llm.pii import fit as fit_spans
from kvlake.llm.pii import mask
from kvlake.llm.quality import keep_good

#: Removed ids up to which they are broadcast; beyond, documents and ids are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts get a score as any other.  Documents with equal statistics stay or go together.  Without labels
    all documents stay.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts among them), and those without a prevailing known language, go.

    Where no document has a known language, all stay.  Equal texts stay or go together.
    """
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of 0.8 on 5-word shingles, the one of the smallest id stays.

    Null and empty texts link with nothing and stay.  Of rows with the same id and text one stays.
    """
    classes = materialize(Join(docs, 5, 80, 100).run(), "pipeline-classes")
    gone = classes.where("id <> component").select(F.col("id").alias("_gone"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    if not classes.groupBy("id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows the text.

    No document goes.  Null texts stay null, empty ones empty; spans that overlap become one.
    """
    out = mask(docs, fit_spans(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in their sequences.

    Null and empty texts are one piece with the end mark alone; repeated rows are packed once each.
    """
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The classifiers and the packing can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
