"""Secrets of any length, and a ledger that was appended to twice."""

import random
import re
import time

from loomgraph.llm import secret_scan

PIECES = ["eyJ", "eyJabcdefgh", "eyJ-_000000.", "://u:p@", "x://u:", "abcdefgh", "a-b_c", "1", ".", ".", "..", "://", "://", ":", "@", "@", "/", " ", "user", "9+x", "http", "ey", "\n", "é"]


def spans(text, rule):
    return [(m.start(), m.end()) for m in re.finditer(rule.plain, text, re.ASCII)]


def test_runs_entered_once_find_what_the_plain_patterns_find(spark):
    rules = [r for r in secret_scan.RULES if r.plain]
    assert {r.kind for r in rules} == {"jwt", "login"}
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(3, 40))) for _ in range(3000)]
    texts += ["abc.eyJ12345678.eyJ12345678.abcdefghi", "eyJ1.eyJ12345678.eyJ12345678.abcdefgh.eyJ12345678.eyJ12345678.abcdefgh", "12http://u:p@x://u:p@"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r["doc_id"]: r["findings"] for r in secret_scan.scan_versions(rows)[0].collect()}
    n = 0
    for i, text in enumerate(texts):
        for r in rules:
            want = spans(text, r)
            n += len(want)
            assert [(s["start"], s["end"]) for s in found[i] if s["kind"] == r.kind] == want, text
    assert n > 100


def test_no_length_limit(spark):
    token = "eyJ" + "h" * 1000 + ".eyJ" + "p" * 2000 + "." + "s" * 1000
    scheme = "abcdefghijklmnopqrstuvwxyzabcd"
    text = f"a {token} b {scheme}://user:word@host"
    found = secret_scan.scan_new(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()["findings"]
    got = {s["kind"]: text[s["start"] : s["end"]] for s in found}
    assert got == {"jwt": token, "login": f"{scheme}://user:word@"}


def test_hostile_runs_of_a_megabyte(spark):
    mb = 1_000_000
    hostile = ["eyJ" * (mb // 3) + ".eyJ" + "a" * mb, "eyJ12345678." * (mb // 12), "ab.eyJ1234567." * (mb // 14), "a" * mb + "eyJ" + ".", "1." * mb + "://a:b",
               "a://b:" * (mb // 6), "x" * mb + "://" + "y" * mb + ":" + "z" * mb, "-_" * mb + "eyJ ://"]
    for text in hostile:
        began = time.perf_counter()
        secret_scan.scan_new(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
        assert time.perf_counter() - began < 20, text[:20]


def test_two_appends_of_the_same_rows(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    docs = spark.createDataFrame([(i, "AKIA" + "B" * 16 + str(i % 2)) for i in range(4)] + [(4, None)], "doc_id int, text string")
    fresh = secret_scan.scan_new(docs)
    for _ in range(2):  # two writers that both found the blobs unseen
        fresh.write.mode("append").partitionBy("rule_version").parquet(path)
    report = secret_scan.scan_into_ledger(docs, path)
    assert sorted((r["doc_id"], len(r["findings"])) for r in report.collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 0)]
    assert secret_scan.read_ledger(spark, path).count() == 3
    assert secret_scan.scan_into_ledger(docs.limit(0), path).collect() == []
