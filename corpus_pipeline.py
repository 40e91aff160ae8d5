"""A corpus pipeline: reject poor documents, keep one of each group of near copies, hide personal data, pack the rest.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menurank.llm import packing, pii, quality
from menurank.llm.common import stored, table
from menurank.llm.jaccard import BROADCAST_IDS, jaccard_classes
from menurank.operators.zipping import numbered

WIDTH, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It is trained on labelled rows of `documents` itself."""
    weights = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.scored(docs, weights).filter("predicted = 1").select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each component of 5-gram Jaccard links from 0.8.

    Documents without words stay, as do rows without doc_id. Rows that share a doc_id are documents each, unless they share
    the text as well: of those one stays, and of near copies among them the least text."""
    ids = docs.select("doc_id").filter("doc_id is not null").groupBy("doc_id").count()
    if ids.filter("count > 1").isEmpty():
        return _firsts(docs, docs.columns)
    place = next(c for c in ("near_row", *(f"near_row{i}" for i in range(len(docs.columns)))) if c not in docs.columns)
    rows, _ = numbered(docs.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]), ["doc_id", "text"], place)
    kept = _firsts(rows.withColumnsRenamed({"doc_id": "own_id", place: "doc_id"}), [F.col("own_id").alias("doc_id") if c == "doc_id" else c for c in docs.columns])
    return kept.unionByName(docs.filter("doc_id is null"))


def _firsts(docs: DataFrame, columns: list) -> DataFrame:
    """columns of those rows whose doc_id is the least of its component; doc_id tells rows apart."""
    classes = jaccard_classes(docs, WIDTH, PERCENT)
    lost = stored(classes.filter("component_id <> doc_id").select("doc_id").distinct())
    few = lost.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(lost) if few else lost, "doc_id", "left_anti").select(*columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and the terms that disclose it replaced."""
    return pii.sanitised(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.document_pieces(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: Training, components and packing aren't SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
