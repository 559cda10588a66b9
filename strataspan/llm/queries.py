"""The queries opN_<name>: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm.ann import nearest
from strataspan.llm.common import table
from strataspan.llm.decontaminate import contamination
from strataspan.llm.html import extract
from strataspan.llm.langid import fit, held_out, identify
from strataspan.llm.lines import dedup_lines
from strataspan.llm.order_minhash import near_duplicates
from strataspan.llm.pieces import digest, encode
from strataspan.llm.pii import pseudonyms
from strataspan.llm.secrets import scan_secrets, secrets_sql
from strataspan.llm.sharding import SHARD_SQL, shard_by_bytes


#: The setting that holds the secret key of pseudonyms, and what the query takes for tests and checks without it.
PII_KEY, DEMO_KEY = "spark.strataspan.pii.key", "not a secret: for tests"


def op1_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_regions, items (ids, ascending), regions (item:start:end:edits by start, comma-joined)."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    span = F.transform("regions", lambda s: F.concat_ws(":", *[s[k].cast("string") for k in ("item_id", "start", "end", "edits")]))
    items = F.array_sort(F.array_distinct(F.transform("regions", lambda s: s["item_id"])))
    return out.select("doc_id", F.size("regions").cast("long").alias("n_regions"), items.alias("items"), F.array_join(span, ",").alias("regions"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_spans, spans (kind:start:end:alias by start, comma-joined).

    The key is the session's setting PII_KEY; without it the published DEMO_KEY, which protects nothing and only makes results repeatable.
    """
    out = pseudonyms(table(spark, sf_dir, "documents"), (spark.conf.get(PII_KEY, None) or DEMO_KEY).encode())
    span = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), s["alias"]))
    return out.select("doc_id", "text", F.size("spans").cast("long").alias("n_spans"), F.array_join(span, ",").alias("spans"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode(table(spark, sf_dir, "documents")))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (what is left), n_removed, removed (start:end in the original, comma-joined)."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    span = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return out.select("doc_id", "text", "n_removed", F.array_join(span, ",").alias("removed"))


QUERIES = {f.__name__: f for f in (op1_extraction, op2_decontamination, op3_sharding, op4_ann, op5_language, op6_near_duplicates, op7_pii, op8_pieces, op9_substring, op10_secrets)}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op3_sharding": SHARD_SQL, "op10_secrets": secrets_sql()}
