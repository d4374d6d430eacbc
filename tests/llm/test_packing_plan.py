"""The plan of the packing against an exact solver, the sum index against brute force, and the number of sequences."""

import itertools
import random
from collections import Counter

from loomgraph.llm import packing


def fewest(lengths, size):
    """The fewest sequences, by trying all places of every length, longest first."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if k == len(lengths):
            best = len(gaps)
            return
        for gap in set(gaps):
            if gap >= lengths[k]:
                left = list(gaps)
                left[left.index(gap)] -= lengths[k]
                place(k + 1, left)
        place(k + 1, [*gaps, size - lengths[k]])

    place(0, [])
    return best


def test_against_an_exact_solver():
    rng, more = random.Random(5), 0
    for _ in range(300):
        size = rng.choice([10, 24, 60])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 9))]
        plan = packing.plan_packing(Counter(lengths), size)
        assert Counter(x for n, xs in plan for x in xs for _ in range(n)) == Counter(lengths)
        assert all(sum(xs) <= size and n > 0 for n, xs in plan)
        n, exact = sum(n for n, _ in plan), fewest(lengths, size)
        assert n <= exact + 1
        more += n > exact
    assert more <= 9  # one more than the fewest in 3 % of these cases at most


def test_exact_fills_are_found():
    """Whenever one, two or three others fill the gap under the counts, the index finds some that do."""
    rng = random.Random(9)
    for _ in range(400):
        size = rng.randint(6, 30)
        counts = {x: rng.randint(1, 2) for x in rng.sample(range(1, size), rng.randint(1, min(7, size - 1)))}
        index, longest = packing.SumIndex(counts, size), max(counts)
        pool = Counter(counts) - Counter([longest])
        there = any(
            sum(c) == size - longest and not Counter(c) - pool
            for k in (1, 2, 3)
            for c in itertools.combinations_with_replacement(sorted(counts), k)
        )
        found = index.exact(longest)
        assert (found is not None) == there
        if found:
            assert sum(found) == size and not Counter(found) - Counter(counts) and found[0] == longest


def test_counts_of_any_size_make_a_short_plan():
    plan = packing.plan_packing({k: 10**9 + k for k in range(1, 1025)})
    assert len(plan) < 5_000
    total = sum(k * (10**9 + k) for k in range(1, 1025))
    assert sum(n for n, _ in plan) <= 1.001 * total / 1024


def test_number_of_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = packing.pack_documents(docs).selectExpr("count(distinct sequence_id) n", "sum(length) total").first()
    assert out["n"] <= 1.005 * -(-out["total"] // 1024)
