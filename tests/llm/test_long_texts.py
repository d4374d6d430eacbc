"""Long and hostile texts, running sums, and the ledger kept in a folder."""

import itertools
import re
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import quality_rules, secret_scan
from loomgraph.llm.common import running_sum

MB = 1_000_000
HOSTILE = {
    "a word before a symbol": "a" * MB + " #", "spaces": " " * MB + "#x", "separators": "|" * MB, "marks": "!" * MB + " a!!",
    "scheme": "a" * MB + "://x", "user": "a://" + "x" * MB, "cue": "password" + " " * MB + "x", "key": "-----BEGIN " + "A " * (MB // 2),
    "token": "eyJ" * (MB // 3), "secrets": "0123456789abcdef " * (MB // 17), "lines": "x\n" * (MB // 2), "repeats": "a b c d e " * (MB // 10),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_megabyte(spark, name):
    one = spark.createDataFrame([(1, HOSTILE[name])], "doc_id int, text string")
    began = time.perf_counter()
    assert quality_rules.apply_quality_rules(one).select("n_words").first()[0] == len(HOSTILE[name].split())
    found = secret_scan.scan_new(one).first()["findings"]
    assert time.perf_counter() - began < 45  # the same texts took many minutes by patterns that start anew at every place
    if name == "secrets":
        assert [(s["start"], s["end"]) for s in found] == [(k * 17, k * 17 + 16) for k in range(MB // 17)]


def test_running_sum(spark):
    for n in (0, 1, 2, 5, 6, 256, 257, 1000):
        numbers = [(i * 7) % 13 for i in range(n)]
        frame = spark.createDataFrame([(numbers,)], "a array<int>").select(running_sum(F.col("a"), 5 if n < 20 else 256))
        assert frame.first()[0] == list(itertools.accumulate(numbers))


def test_ledger_in_a_folder(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/ledger"
    first = spark.createDataFrame([(1, "AKIA" + "B" * 16), (2, "clean"), (3, None)], "doc_id int, text string")
    second = first.union(spark.createDataFrame([(4, "clean"), (5, "xoxb-" + "1" * 12)], "doc_id int, text string"))
    assert secret_scan.read_ledger(spark, path) is None
    kinds = lambda report: {r["doc_id"]: [s["kind"] for s in r["findings"]] for r in report.collect()}
    assert kinds(secret_scan.scan_into_ledger(first, path)) == {1: ["access"], 2: [], 3: []}
    assert secret_scan.scan_new(second, secret_scan.read_ledger(spark, path)).count() == 1
    assert kinds(secret_scan.scan_into_ledger(second, path)) == {1: ["access"], 2: [], 3: [], 4: [], 5: ["chat"]}
    ledger = secret_scan.read_ledger(spark, path)
    assert ledger.count() == ledger.select("blob", "rule_version").distinct().count() == 4
    # another version of the rules is scanned and reported apart
    only = (secret_scan.Rule("clean", "clean"),)
    assert kinds(secret_scan.scan_into_ledger(second, path, rules=only, rule_version="2"))[4] == ["clean"]
    assert secret_scan.read_ledger(spark, path).groupBy("rule_version").count().collect() != []
    assert kinds(secret_scan.report_findings(second, secret_scan.read_ledger(spark, path)))[5] == ["chat"]


def test_secrets_of_all_documents_against_scan(spark):
    """Every rule's spans in every text of sf0.01 against Python's regular expressions."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    report, _ = secret_scan.scan_versions(docs)
    texts = dict(docs.collect())
    patterns = [(i, r, re.compile(r.plain or r.pattern, re.ASCII)) for i, r in enumerate(secret_scan.RULES)]
    n = 0
    for row in report.collect():
        text = texts[row["doc_id"]] or ""
        want = sorted(
            (m.start(), i, r.kind, m.end()) for i, r, p in patterns for m in p.finditer(text) if len(m[r.group]) >= r.min_chars
        )
        assert [(s["start"], s["kind_order"], s["kind"], s["end"]) for s in row["findings"]] == want
        n += len(want)
    assert n > 20
