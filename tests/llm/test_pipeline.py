"""The pipeline's stages: columns, decisions that take effect, and clean documents that stay."""

import hashlib

import corpus_pipeline as P
from pyspark.sql import functions as F

from tidemark.llm import common, packing, quality, secrets


def test_stages(spark, sf, tmp_path):
    docs = common.table(spark, sf, "documents")
    seen = {"input": docs}
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != P.STAGES[-1][0]:
            assert docs.columns == list(P.COLUMNS)
    labels = common.table(spark, sf, "labels")
    good = labels.where("quality = 1").count()
    assert seen["quality"].join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * good
    assert seen["quality"].join(labels.where("quality = 0"), "doc_id").count() <= 0.1 * labels.where("quality = 0").count()
    texts = seen["near_duplicates"].groupBy("text").count().where("count > 1 AND length(text) > 0")
    assert texts.count() == 0
    assert secrets.secret_spans(seen["secrets"]).where("n_assign + n_access + n_hex > 0").count() == 0
    ids = [r[0] for r in seen["secrets"].select("doc_id").collect()]
    assert sorted(ids) == sorted(r[0] for r in seen["near_duplicates"].select("doc_id").collect())
    sizes = {r[0]: r[1] for r in seen["mixing"].groupBy("source").agg(F.sum(F.length("text"))).collect()}
    assert max(sizes.values()) < 4 * min(sizes.values())
    tokens = seen["packing"].agg(F.sum("length")).first()[0]
    assert tokens == seen["packing"].where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_run_and_empty(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        common.table(spark, sf, name).where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, sf, tmp_path):
    long = " ".join(hashlib.md5(str(i).encode()).hexdigest()[:7] for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", len(long)), (3, long, "en", "a", len(long)), (None, "a few words here", None, "b", 16)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = P.run(spark, str(tmp_path))
    assert "sequence_id" in out.columns and out.count() > 0
    assert packing.LONGEST >= out.agg(F.max("length")).first()[0] and quality.THRESHOLD == 0.3
