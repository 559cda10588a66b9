"""A corpus pipeline of five stages: each works on all that its predecessor kept, written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm.common import table
from strataspan.llm.decontaminate import excise
from strataspan.llm.langid import fit, identify
from strataspan.llm.order_minhash import keep_one
from strataspan.llm.pieces import digest, encode
from strataspan.llm.secrets import redact
from strataspan.plans.lineage import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted with enough confidence; the others go. Columns stay as they are, whatever their names.

    Null texts and texts without a letter go, too; repeated rows stay or go alike. Where no document has a label nothing is learned, and all stay. No documents give none.
    """
    model = fit(docs)
    if not model.langs:
        return docs
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = identify(docs, model, keep=tuple(docs.columns), prefix=prefix)
    return found.where(~F.col(f"{prefix}rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least doc_id, one row of equal ones; null texts stay."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the regions that hold benchmark items; clean ones stay as they are, null and empty texts, too."""
    return excise(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with live-looking credentials masked; those that many owners copy stay. Null and empty texts stay as they are."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_chunks, ids_hash, whole of each document; null and empty texts have no token."""
    return digest(encode(docs))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Learned models, sketches and alignments are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns lies as Parquet in the folder of spark.checkpoint.dir (in local mode, a temporary one if there is none)."""
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
