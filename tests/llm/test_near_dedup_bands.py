"""Bands of near dedup follow from the threshold."""

import numpy as np
import pytest

from loomgraph.llm import near_dedup


@pytest.mark.parametrize("percent", [1, 30, 50, 80, 85, 99, 100])
def test_bands_follow_from_threshold(percent):
    bands, rows = near_dedup.bands_for(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= near_dedup.MISS
    assert near_dedup.bands_for(85) == (24, 5) and near_dedup.bands_for(80) == (35, 5)


def test_pairs_at_a_low_threshold(spark):
    rng = np.random.default_rng(7)
    texts, want = [], {}
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 121)]
        other = words[:83] + [f"v{x}" for x in rng.integers(0, 10**9, 38)]  # 79 of 117 shingles each: 0.51
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k}
    out = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), percent=50).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == want
