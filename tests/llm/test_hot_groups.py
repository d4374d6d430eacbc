"""Groups that hold much of a table: common lines, copies, and documents drawn together by one passage."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import common, decontaminate, line_dedup, near_dedup
from test_operators import components, shingles


@pytest.mark.parametrize("hot_keys", [4096, 3, 1])
def test_join_hot(spark, monkeypatch, hot_keys):
    """However many keys count as hot, the rows are those of a join; hot ones aren't shuffled."""
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    rows = spark.createDataFrame([(i % 7 if i % 2 else 0, i) for i in range(200)] + [(None, -1)], "k int, v int")
    per_key = rows.groupBy("k").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n")).where("k <> 6")
    got = common.join_hot(rows, per_key, ["k"], "n", 201)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(per_key, "k").collect()))
    assert per_key.where(F.col("n") * hot_keys > 201).count() <= hot_keys


def test_common_line_is_not_shuffled_by_its_hash(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('a line that all documents have\\nline of its own ', id) as text")
    out = line_dedup.dedup_lines(docs)
    assert out.agg(F.sum("n_dropped")).first()[0] == 2999
    assert out.where("n_dropped = 0").select("doc_id").collect()[0][0] == 0


@pytest.mark.parametrize("few_blocks", [0, 4])
def test_documents_with_a_common_passage(spark, monkeypatch, few_blocks):
    """Alike in two thirds of their words, not in 85 %; among them chains of near copies, far from the smallest id."""
    monkeypatch.setattr(near_dedup, "FEW_BLOCKS", few_blocks)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 8)
    rng = random.Random(4)
    passage = [f"common{i}" for i in range(120)]
    texts = {}
    for i in range(70):
        own = [f"own{i}x{k}" for k in range(60)]
        texts[i] = passage + own
        if i % 5 == 0:
            for j in range(1, 4):  # a chain: each differs from the one before by a word or two
                own = list(own)
                own[rng.randrange(60)] = f"new{i}y{j}"
                texts[1000 - i * 10 - j] = passage + own
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == components({i: shingles(t) for i, t in rows})


def test_members_without_partners_go_before_blocks(spark):
    """Of a group whose members share a passage only, none is left to compare."""
    group = spark.createDataFrame([("h", i, 10, i) for i in range(50)], "_head string, _id int, _n int, _component int")
    shared = list(range(6))
    sets = spark.createDataFrame([(i, shared + [1000 * (i + 1) + k for k in range(7, 11)]) for i in range(48)] + [(48, list(range(10))), (49, list(range(9)) + [77])], "_id int, _set array<bigint>")
    left = near_dedup._with_partners(group, sets, 85)
    assert sorted(r["_id"] for r in left.collect()) == [48, 49]


def test_a_hot_bucket_is_split(spark):
    """Rows of a key that holds a third of them meet its aggregate in several tasks."""
    limits = {"skewJoin.skewedPartitionThresholdInBytes": "64KB", "advisoryPartitionSizeInBytes": "64KB", "skewJoin.skewedPartitionFactor": "1.5"}
    settings = {**{f"spark.sql.adaptive.{k}": v for k, v in limits.items()}, "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 200_000, 1, 8).selectExpr("id as v", "if(id % 3 = 0, 0, id div 2) as k")
        joined = rows.join(near_dedup._dealt(rows.groupBy("k").agg(F.min("v").alias("least")), "k"), "k")
        assert joined.agg(F.count("least")).first()[0] == 200_000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("block_words", [60, 400])
def test_blocks_write_their_hits_only(spark, monkeypatch, block_words):
    """Many blocks give what one gives, copies and null texts included, and no written table has a document's text."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    items = [(f"i{k}", " ".join(rng.choices(words, k=rng.choice([5, 13, 30])))) for k in range(40)]
    texts = [None, "", "w1 w2"] + [" ".join(rng.choices(words, k=50) + items[k % 40][1].split() + rng.choices(words, k=20) + items[k * 7 % 40][1].upper().split()) for k in range(60)]
    docs = spark.createDataFrame([(k, texts[k % 63], f"x{k}") for k in range(200)], "doc_id int, text string, _text string").repartition(5)
    table = spark.createDataFrame(items, "item_id string, text string")
    one = sorted(map(str, decontaminate.find_benchmark(docs, table).collect()))
    written, plain = [], decontaminate.materialize
    monkeypatch.setattr(decontaminate, "materialize", lambda df, name="table": written.append((name, df.columns)) or plain(df, name))
    assert sorted(map(str, decontaminate.find_benchmark(docs, table, block_words=block_words).collect())) == one
    hits = [columns for name, columns in written if name == "benchmark-hits"]
    assert len(hits) > 1 and all({"text", "_text", "_rest"}.isdisjoint(columns) for columns in hits)
