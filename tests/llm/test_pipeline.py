"""The pipeline's stages against their operators, and the queries against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before and after
        if k < 4:
            assert docs.columns == columns
            assert docs.where(F.col("n_chars") != F.char_length("text")).isEmpty()
    full = corpus_pipeline.run(spark, SF)
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert full.select(*keys).exceptAll(docs.select(*keys)).isEmpty() and full.count() == docs.count()


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_decontamination", "op4_line_dedup", "op5_near_dedup", "op8_sharding", "op9_secret_scan"])
def test_queries_against_sql(spark, name):
    from loomgraph.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
