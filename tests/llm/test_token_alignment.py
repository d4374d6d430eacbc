"""Alignment against brute force with the whole-text tokenizers; fragments of any cut give the whole's groups."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import token_alignment as m

A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def _byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


BYTE_OF = _byte_of()


def sides(text):
    """(id, bytes) of both sides; none where either doesn't give back the bytes."""
    if not text:
        return [], []
    a = [(i, bytes(BYTE_OF[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def groups(text):
    a, b = sides(text)
    ends = []
    for side in (a, b):
        at, out = 0, []
        for i, raw in side:
            at += len(raw)
            out.append((i, at))
        ends.append(out)
    common = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
    out, low = [], 0
    for e in common:
        out.append(tuple([i for i, x in side if low < x <= e] for side in ends))
        low = e
    return out


def brute(rows):
    found = [(doc, groups(text)) for doc, text in rows]
    holders = Counter()
    for _, gs in found:
        holders.update({(x, y) for a, b in gs for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    out = Counter()
    for doc, gs in found:
        links = [(x, y) for a, b in gs for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out[
            doc, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links), sum(holders[x] == best[x[0]] for x in links),
            sum(holders[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if gs else "",
        ] += 1
    return out


ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "a▁b is no token"), (6, "<|endoftext|> <s> </s> <0x41> <unk>"), (7, "two  spaces\n\nand lines \n x\t\ty\r\nz "),
    (8, "  lead"), (9, "日本語のテキスト と 😀👍🏽 é é ﬁ"), (10, "it's we'll\n's x"), (None, "no id"), (11, "same"), (11, "same"), (12, "\0 nul \x1c fs \x85 nel \xa0nb   ls"),
    (13, "x\n y\n\nz"), (14, "\nstart"), (15, "end\n"), (16, "internationalization"), (17, "a" * 300), (18, "﻿bom ​zero"),
]


def long_texts():
    rng = random.Random(3)
    pool = ["the", "Schön", "internationalization", "x" * 40, "été", "a,b;c", "日本語", "1234567", "<0x0A>", "well-known"]
    text = lambda n: "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\n", "  ", "\n\n", "\t"]) for _ in range(n))
    return [(100 + k, text(n)) for k, n in enumerate((30, 90, 200, 400))] + [(110, "word" * 700 + " " + text(20)), (111, text(60) + "▁" + text(60)), (112, " ".join(["same words"] * 200)), (112, " ".join(["same words"] * 200))]


@pytest.mark.parametrize("range_size", [7, 333, 1 << 15])
def test_against_brute_force(spark, range_size):
    rows = ODD + long_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    odd = docs.select("*", *[F.lit("x").alias(c) for c in ("row", "k", "pair", "n", "best", "packet", "n_a", "docs")])
    assert Counter(map(tuple, m.align_tokens(odd, range_size=range_size, fan=4).collect())) == brute(rows)


def test_empty_table(spark):
    assert m.align_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_other_id_types(spark):
    out = m.align_tokens(spark.createDataFrame([("a", "some words"), ("b", "some words " * 30)], "name string, body string"), "name", "body", range_size=50)
    assert {(r["name"], r["n_groups"] > 0) for r in out.collect()} == {("a", True), ("b", True)}


@pytest.fixture(scope="module")
def segments():
    return m.Segments(*m._paths(m.A_VOCABULARY, m.B_VOCABULARY))


def test_segments_are_encoded_as_in_the_whole(segments):
    for _, text in ODD + long_texts():
        a, b = sides(text)
        if a:
            found = [segments.tokens([x])[0] for x in m.SAFE.split(" " + text) if x]
            assert [i for (s, _), _ in found for i, _ in s] == [i for i, _ in a] and [i for (_, s), _ in found for i, _ in s] == [i for i, _ in b]
            runs = [x if not spaced else " " + x for spaced, names in m.runs_of(" " + text) for x in names]
            assert "".join(runs) == " " + text


def test_compose_is_associative():
    """Any cut of the tokens, composed in any order, closes the groups of the whole."""
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(1, 30)
        cuts = [sorted({*rng.sample(range(1, n + 1), rng.randrange(0, n)), n}) for _ in range(2)]
        tokens = tuple(tuple((k, e) for k, e in enumerate(side)) for side in cuts)
        want, _ = m.groups_of(tokens)
        places = sorted(rng.sample(range(n + 1), min(n, rng.randrange(1, 6))))
        parts = []
        for lo, hi in zip([0, *places], [*places, n], strict=True):
            own = tuple(tuple(t for t, start in zip(side, (0, *(e for _, e in side)), strict=False) if lo <= start < hi) for side in tokens)
            parts.append(m.fragment_of(own))
        closed = [g for _, gs in parts for g in gs]
        level = [f for f, _ in parts]
        while len(level) > 1:
            k = rng.randrange(len(level) - 1)
            f, gs = m.compose(level[k], level[k + 1])
            closed += gs
            level[k : k + 2] = [f]
        assert sorted(closed + m.finish(level[0])) == sorted(want)
        f = level[0]
        assert m.compose(m.EMPTY, f) == (f, []) == m.compose(f, m.EMPTY)


def test_ranges_cover_the_text():
    for _, text in long_texts():
        for size in (7, 50, 10_000):
            text_bytes, end = (" " + text).encode(), 0
            for part, base, lo, hi in m.ranges(" " + text, size):
                assert lo == end and text_bytes[base : base + len(part.encode())] == part.encode() and base <= lo
                end = hi
            assert end == len(text_bytes)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(map(tuple, m.op13_token_alignment(spark, sf).collect())) == brute(rows)
