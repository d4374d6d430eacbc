"""Every operator on tables with clashing columns, nulls in any column, repeated rows and no rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, html_extract, line_dedup, near_dedup, packing, pii, quality_rules, secret_scan, sharding, toxicity
from test_operators import PROSE, TEXTS

#: Names that some operator adds or uses inside.
NAMES = (
    "kept n_words word_chars base_failed clean_text n_lines_removed n_hit items spans kept_text n_lines n_dropped component_id n_shingles pii score n_terms "
    "shard depth n_bytes findings blob piece start length ids_crc32 sequence_id offset n_chars _id _row _pos _line _key _h1 _h2 _first _n _dropped _lines "
    "_w _l _left _n_lines _hit _n_hit _rest _doc _bands _rep _text _row_of_text _s1 _s2 _group _rank _base _cell toxic label"
).split()
MODEL = toxicity.Model(["badword" + toxicity.END], [5.0], 0.7, 0.3, [-3.0, 1.0, 1.0, 1.0])


def items(spark):
    return spark.createDataFrame([(1, PROSE[:80], None), (None, PROSE, "x"), (3, None, "y")], "item_id int, text string, _hit string")


OPERATORS = {
    "quality": lambda d: quality_rules.apply_quality_rules(d).select("doc_id", "n_words", "clean_text", "kept"),
    "decontamination": lambda d: decontaminate.find_benchmark(d, items(d.sparkSession)).select("doc_id", "n_words", "n_hit", F.to_json("spans")),
    "packing": lambda d: packing.pack_documents(d).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "lines": lambda d: line_dedup.dedup_lines(d).select("doc_id", "kept_text", "n_lines", "n_dropped"),
    "near": lambda d: near_dedup.near_duplicates(d).select("doc_id", "n_shingles", "component_id", "kept"),
    "pii": lambda d: pii.find_pii(d).select("doc_id", F.to_json("pii")),
    "toxicity": lambda d: toxicity.score_toxicity(d, MODEL).select("doc_id", "score", "n_terms"),
    "sharding": lambda d: sharding.assign_shards(d.where("doc_id is null or doc_id <> 7"), max_bytes=300).select("doc_id", "shard", "n_bytes"),
    "secrets": lambda d: secret_scan.scan_versions(d)[0].select("doc_id", F.to_json("findings")),
    "html": lambda d: html_extract.extract_main_text(d.withColumnRenamed("text", "html")).select("doc_id", "text", "n_chars"),
}


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame([*TEXTS, (None, None), (3, None), (3, None)], "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_and_nulls(plain, name):
    run = OPERATORS[name]
    values = [F.lit(None).cast("string"), F.lit("x"), F.lit(7), F.array(F.lit(1))]
    odd = plain.select("*", *[values[i % 4].alias(n) for i, n in enumerate(NAMES)])
    count = lambda df: Counter(map(tuple, df.collect()))
    want = count(run(plain))
    assert count(run(odd)) == want and sum(want.values())
    assert run(odd.where("false")).collect() == [] and run(plain.where("false")).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_of_nulls(spark, name):
    rows = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert len(OPERATORS[name](rows).collect()) == 1


def test_other_columns_stay(plain):
    """Operators that give the table back keep columns they don't add, whatever their names."""
    odd = plain.withColumns({"_rest": F.lit("r"), "_hit": F.lit("h"), "_dropped": F.lit("d"), "_l": F.lit("l"), "with space": F.lit("s")})
    want = ("r", "h", "d", "l", "s")
    for out in (quality_rules.apply_quality_rules(odd), decontaminate.find_benchmark(odd, items(odd.sparkSession)), line_dedup.dedup_lines(odd), pii.find_pii(odd), toxicity.score_toxicity(odd, MODEL), secret_scan.scan_versions(odd)[0]):
        assert {tuple(r[c] for c in ("_rest", "_hit", "_dropped", "_l", "with space")) for r in out.collect()} == {want}
