"""The operator's files: every row once, in its own shard."""

from collections import Counter, defaultdict

from loomgraph.llm import sharding


def test_write_shards_repeated_and_null_keys(spark, tmp_path):
    rows = [(1, f"text {i}", i) for i in range(40)] + [(None, f"none {i % 2}", i) for i in range(20)] + [(k, "word " * k, k) for k in range(2, 12)] + [(5, None, 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, more int")
    sharding.write_shards(docs, f"{tmp_path}/shards", max_bytes=60)
    back = spark.read.option("inferSchema", False).schema("doc_id long, text string, more int, shard string").parquet(f"{tmp_path}/shards").collect()
    assert Counter((r["doc_id"], r["text"], r["more"]) for r in back) == Counter(rows)
    sizes = defaultdict(list)
    for r in back:
        sizes[r["shard"]].append(len(r["text"] or ""))
    assert all(sum(x) <= 60 or len(x) == 1 for x in sizes.values())


def test_write_shards_clashing_names_long_text_and_empty_table(spark, tmp_path):
    rows = [(i, None if i % 3 == 0 else "t" * i, f"s{i}", i, "two") for i in range(30)] + [(99, "x" * 500, None, 99, None), (98, "", "s", 98, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Shard string, _row int, shard_2 string")
    column = sharding.write_shards(docs, f"{tmp_path}/shards", max_bytes=60)
    assert column == "shard_3"
    back = spark.read.schema("doc_id long, text string, Shard string, _row int, shard_2 string, shard_3 string").parquet(f"{tmp_path}/shards").collect()
    assert Counter(tuple(r)[:5] for r in back) == Counter(rows)
    sizes = defaultdict(list)
    for r in back:
        sizes[r["shard_3"]].append(len(r["text"] or ""))
    assert all(sum(x) <= 60 or len(x) == 1 for x in sizes.values()) and len(sizes) > 5
    assert sharding.write_shards(docs.limit(0).drop("Shard"), f"{tmp_path}/none") == "shard"
    assert [p for p in (tmp_path / "none").iterdir() if p.is_dir()] == []
