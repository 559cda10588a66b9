"""The pipeline, stage by stage and in one, on the smallest tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from strataspan.llm import decontaminate, order_minhash, secrets
from strataspan.llm.common import table


def test_stages_take_effect(spark, sf):
    docs = table(spark, sf, "documents").withColumn("score", F.lit(1))
    columns, before = docs.columns, docs.count()
    named = dict(corpus_pipeline.STAGES)
    kept = named["language"](spark, docs, sf).cache()
    assert kept.columns == columns and kept.count() >= 0.97 * before
    unique = named["near_duplicates"](spark, kept, sf).cache()
    assert unique.columns == columns
    classes = order_minhash.near_duplicates(unique)
    assert classes.where("not kept").isEmpty() and unique.count() < kept.count()
    clean = named["decontamination"](spark, unique, sf).cache()
    bench = table(spark, sf, "benchmark")
    assert clean.count() == unique.count()
    assert decontaminate.contamination(clean, bench).where(F.size("regions") > 0).isEmpty()
    safe = named["secrets"](spark, clean, sf).cache()
    assert safe.count() == clean.count() and safe.columns == columns
    live = secrets.ownership(secrets.find_spans(clean)).where("verdict = 'live'")
    left = secrets.find_spans(safe).select(F.explode("found").alias("s")).select(F.xxhash64("s.value").alias("secret"))
    assert left.join(live, "secret").isEmpty()
    coded = named["tokens"](spark, safe, sf).cache()
    assert coded.count() == safe.count() and coded.where("not whole").isEmpty()


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() <= table(spark, sf, "documents").count() and "doc_id" in out.columns


CLASH = ("_lang_pred", "__rejected", "score", "class_id", "digest", "_regions", "__row", "found", "row", "chunk", "s")


def _rows(spark):
    rows = [(1, "the words of one text " * 9, "en", "a", 198), (1, "the words of one text " * 9, "en", "a", 198), (2, None, "en", "b", None), (3, "", None, "c", 0)]
    rows += [(4, "x", None, None, 1), (None, "a text that has no id at all but words", "en", "d", 38), (6, "token=abcdefghijkl0000 " + "long " * 40_000, "en", "e", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return df.selectExpr("*", *(f"{i} as {c}" for i, c in enumerate(CLASH)))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    docs = _rows(spark)
    sf = "/root/testdata/sf0.001"
    empty = stage(spark, docs.limit(0), sf)
    assert empty.isEmpty()
    out = stage(spark, docs, sf)
    rows = out.collect()
    if name == "tokens":
        assert len(rows) == 7 and all(r["whole"] for r in rows)
        return
    assert out.columns == docs.columns == empty.columns
    ids = sorted(r["doc_id"] or 0 for r in rows)
    assert {"near_duplicates": [0, 1, 2, 3, 4, 6], "decontamination": [0, 1, 1, 2, 3, 4, 6], "secrets": [0, 1, 1, 2, 3, 4, 6]}.get(name, ids) == ids
    if name == "secrets":
        assert {r["text"][:8] for r in rows if r["doc_id"] == 6} == {"[SECRET]"}


def test_language_stage_without_labels(spark):
    docs = _rows(spark).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, docs, "").count() == 7
