"""Each stage of the pipeline on its own input against brute force; odd tables; the whole against the chain."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import packing
from test_operators import LOWER, PROSE, TEXTS, components, quality_base, shingles, words

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
#: A column with a name that each operator adds itself.
CLASHING = "kept boolean, clean_text string, kept_text string, n_dropped int, items string, n_hit int, length int, component_id int, _n string"


@pytest.fixture(scope="module")
def docs(spark):
    found = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(10**6 + k, t, "en", "web", 3) for k, (_, t) in enumerate(TEXTS)], found.schema)
    again = found.where("doc_id % 40 = 0")  # repeated rows
    return found.union(more).union(again).repartition(5)


def rows_of(df):
    return Counter((r["doc_id"], r["text"], r["n_chars"]) for r in df.select("doc_id", "text", "n_chars").collect())


def line_fails(line):
    w = words(line)
    n, share = len(w), lambda k, part: k >= max(1, n * part)
    if not n:
        return False
    symbols = sum(bool(re.search("[#*$%&|<>]", x)) for x in w)
    shouts, marks = sum(x.endswith("!!") for x in w), sum(x in ("|", ">", "»", "·", "•", "/") for x in w)
    stock = (
        r"(?i)^[\x20\x09-\x0D]*(all rights reserved|licensed under|copyright (\(c\)|©|[0-9])|© ?[0-9]|(please )?(enable|turn on) javascript|"
        "(we|this (web)?site) uses? cookies|accept (all )?cookies|terms of (use|service)|privacy policy|skip to (main )?content|"
        "subscribe to our newsletter|click here to|sign in|log in|follow us on|share (this|on))"
    )
    return bool(
        share(symbols, 0.3) or share(shouts, 0.3) or n >= 20 and not re.search("[.!?…。！？؟।]", line)
        or n >= 10 and len(set(w)) < n * 0.4 or n > 2 and share(marks, 0.2) or re.search(stock, line)
    )


def quality(rows):
    out = Counter()
    for i, t, _ in rows:
        clean = "\n".join(x for x in (t or "").split("\n") if not line_fails(x))
        if not quality_base(t)[-1] and len(clean) >= 0.5 * len(t):
            out[i, clean, len(clean)] += rows[i, t, _]
    return out


def lines(rows):
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    holders, out = {}, Counter()
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(i)
    for (i, t, _), n in rows.items():
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(key(x)) < 10 or len(holders[key(x)]) == 1 or min(holders[key(x)]) == i]
        if len(kept) == len(all_lines) or words("\n".join(kept)):
            out[i, "\n".join(kept), len("\n".join(kept))] += n
    return out


def near(rows):
    component = components({i: shingles(t) for i, t, _ in rows})
    return Counter({(i, t, c): n for (i, t, c), n in rows.items() if component[i] == i})


def clean(rows, items):
    found = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = {tuple(w[k : k + 13]) for w in map(found, items) for k in range(max(1, len(w) - 12) if w else 0)}
    sizes, out = {len(x) for x in windows}, Counter()
    for (i, t, c), n in rows.items():
        w = found(t)
        hit = {k for s in sizes for a in range(len(w) - s + 1) if tuple(w[a : a + s]) in windows for k in range(a, a + s)}
        if not hit or 20 * len(hit) < len(w):
            out[i, t, c] += n
    return out


def test_quality_stage(spark, docs):
    assert rows_of(STAGES["quality_rules"](spark, docs, SF)) == quality(rows_of(docs))


def test_line_stage(spark, docs):
    assert rows_of(STAGES["line_dedup"](spark, docs, SF)) == lines(rows_of(docs))


def test_near_stage(spark, docs):
    assert rows_of(STAGES["near_dedup"](spark, docs, SF)) == near(rows_of(docs))


def test_decontamination_stage(spark, docs):
    items = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = rows_of(STAGES["decontamination"](spark, docs, SF))
    assert got == clean(rows_of(docs), items) and got != rows_of(docs)


def test_packing_stage(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for (i, t, _), n in rows_of(docs).items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        lo = k = 0
        while lo < len(ids):
            hi = lo + ((len(ids) - lo) % 1024 or 1024)
            want[i, k, lo, hi - lo, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[lo:hi]))] += n
            lo, k = hi, k + 1
    out = STAGES["packing"](spark, docs, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in out)
    for (s, at, n), (s2, at2, _) in zip(places, places[1:], strict=False):
        assert (at2 == at + n) if s == s2 else at2 == 0
        assert at + n <= packing.SEQUENCE


@pytest.mark.parametrize("name", STAGES)
def test_odd_tables(spark, docs, name):
    """Clashing columns stay as they are, an empty table stays empty, null ids and texts don't crash."""
    plain = spark.createDataFrame([(1, PROSE, 5), (2, None, None), (3, "", 0), (None, PROSE + " more", 5), (None, None, None)], "doc_id long, text string, n_chars long")
    odd = plain.select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in CLASHING.split(", ")])
    got, want = STAGES[name](spark, odd, SF), STAGES[name](spark, plain, SF)
    if name != "packing":
        assert got.columns == odd.columns and rows_of(got) == rows_of(want)
        assert got.where(F.coalesce(*[F.col(x.split()[0]).isNotNull() for x in CLASHING.split(", ")])).isEmpty()
    else:
        assert got.count() == want.count() == 5
    assert STAGES[name](spark, odd.where("false"), SF).isEmpty()


def test_run_is_the_chain(spark):
    rows = rows_of(spark.read.parquet(f"{SF}/documents.parquet"))
    items = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    left = clean(near(lines(quality(rows))), items)
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {i for i, _, _ in left}
    assert all(words(t) for _, t, _ in left)
