"""The lexicon's matches against brute force, what is learned, and quotation against abuse."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import toxicity
from loomgraph.llm.toxicity import END


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def nearest(word, terms, weights):
    """(edits) of the nearest term by trying all: whole words, and stems as beginnings."""
    exact = [t for t in terms if (word == t[:-1] if t.endswith(END) else word.startswith(t))]
    if exact:
        return 0
    if len(word) < 4:
        return None
    for t, w in zip(terms, weights, strict=True):
        if len(t) >= 6 and w >= toxicity.SURE:
            if t.endswith(END) and distance(word, t[:-1]) <= 1:
                return 1
            if not t.endswith(END) and any(distance(word[:k], t) <= 1 for k in range(len(t) - 1, min(len(word), len(t) + 1) + 1)):
                return 1
    return None


def test_matches_against_trying_all_terms():
    rng = random.Random(2)
    letters = "abcd"
    make = lambda low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    for _ in range(20):
        terms = list({make(3, 9) + rng.choice(["", END]) for _ in range(12)})
        weights = [rng.choice([2.0, 5.0]) for _ in terms]
        lexicon = toxicity.Lexicon(terms, weights)
        some = [t.rstrip(END) for t in terms]
        words = [make(1, 12) for _ in range(300)] + [t[:k] + rng.choice(letters) + t[k + rng.randint(0, 1) :] for t in some for k in range(len(t) + 1)] + [t + make(0, 60) for t in some]
        for word in words:
            found = lexicon.find(word)
            assert (found[1] if found else None) == nearest(word, terms, weights), (word, terms)


@pytest.mark.parametrize("length", [18, 60])
def test_long_words_are_terms(spark, length):
    """No length of a word is too great: learned, found, and found misspelled."""
    long = "x" + "yz" * (length // 2)
    rows = [(f"some words {long} number {i}", 1) for i in range(40)] + [(f"some words number {i} and more", 0) for i in range(160)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    finder = toxicity.Finder(model.terms, model.weights)
    assert finder.hits(f"a {long} b")[0] and finder.hits(f"a {long[:7]}q{long[8:]} b")[0]
    assert toxicity.Finder([long + END], [5.0]).hits(f"{long} {long}q {long}qq")[0] == [(0, 0, 0, 1), (0, 1, 0, 1)]


def test_copies_lend_no_support(spark):
    """A word that many copies of one text hold tells nothing; a word of many texts does."""
    rows = [("the copied sentence with oddword inside", 1)] * 60 + [(f"line {i} has badword in it", 1) for i in range(30)] + [(f"line {i} is fine", 0) for i in range(300)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int").withColumn("score", F.lit("clash")))
    assert any("badword".startswith(t.rstrip(END)) for t in model.terms)
    assert not any("oddword".startswith(t.rstrip(END)) for t in model.terms)


def test_quotation_is_told_from_abuse(spark):
    """Where quoted insults are labelled 0, the context window lowers what they count; texts with either score apart."""
    insults, rng = ["scoundrelly", "blockheaded", "numbskulled"], random.Random(1)
    fill = lambda: " ".join(rng.choice("the road goes on past a hill and down to water".split()) for _ in range(12))
    abuse = [(f"{fill()} you are {rng.choice(insults)} {fill()} {i}", 1) for i in range(120)]
    quoted = [(f'{fill()} the word "{rng.choice(insults)}" stands in old books {fill()} {i}', 0) for i in range(60)]
    plain = [(f"{fill()} {i}", 0) for i in range(400)]
    model = toxicity.fit(spark.createDataFrame(abuse + quoted + plain, "text string, toxic int"))
    assert model.quoted < 0.7
    finder = toxicity.Finder(model.terms, model.weights)
    score = lambda text: model.score(*finder.hits(text))
    assert score("see there, you are scoundrelly indeed, and so on") >= 0.3 > score('see there, the word "scoundrelly" is old, and so on')
    hits, _ = finder.hits('they said "a blockheaded plan" and left')
    assert hits[0][2] == 1


@pytest.mark.parametrize("text", ["a" * 10**6, "." * 10**6, "a" + "." * 10**6 + "a", "_a" * 500_000, "badword" * 150_000, "badword " * 120_000, '"badword" ' * 100_000, "b4dw0rd!" * 120_000])
def test_long_texts_take_linear_time(text):
    finder = toxicity.Finder(["badword" + END, "nastiest"], [5.0, 5.0])
    began = time.perf_counter()
    finder.hits(text)
    assert time.perf_counter() - began < 10


def test_long_tokens_are_learned_from_in_linear_time(spark):
    odd = ["1" * 300_000 + "a" + "1" * 300_000 + "a", "a" * 600_000]
    rows = [(f"{odd[i % 2]} bad{i % 3}word {i}", i % 2) for i in range(12)]
    began = time.perf_counter()
    toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert time.perf_counter() - began < 60


def test_all_words_of_three_letters_against_brute_force():
    terms, weights = ["aab" + END, "abc", "abcabc", "cabbaa" + END], [5.0] * 4
    lexicon = toxicity.Lexicon(terms, weights)
    for n in range(7):
        for word in map("".join, itertools.product("abc", repeat=n)):
            found = lexicon.find(word)
            assert (found[1] if found else None) == nearest(word, terms, weights)


def test_stems_of_any_length(spark):
    """A stem ends where its words part, however long it is; a megabyte in one word does no harm."""
    stem, giant = "abcdefghij" * 7, "z" * 1_000_000
    bad = [f"some words {stem}{'qwertyui'[i % 8]}tail{i} more {i}" for i in range(40)] + [f"{giant} {i}" for i in range(5)]
    fine = [f"some words of another kind {stem[:30]} and more {i}" for i in range(60)]
    rows = [(t, 1) for t in bad] + [(t, 0) for t in fine]
    terms, odds = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), "text", "toxic")
    assert stem in terms and min(odds) >= 1
    assert toxicity.Lexicon(terms, odds).exact(stem + "xyz") is not None
    assert toxicity.Lexicon(terms, odds).exact(stem[:60]) is None
