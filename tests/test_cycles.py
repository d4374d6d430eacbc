"""Triangles on skewed graphs, the tree of hashes, and the sample by ranges of hashes."""

import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from loomgraph.operators import cycles, metrics, quality


def by_hand(pairs):
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return {frozenset((a, b, c)) for a in near for b, c in itertools.combinations(near[a], 2) if c in near[b]}


def test_triangles_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    pairs = [(0, i) for i in range(1, 120)] + [(i, 1) for i in range(2, 120, 2)]  # two hubs
    pairs += [(rng.randrange(60), rng.randrange(60)) for _ in range(300)] + [(5, 5), (None, 3), (4, None)]
    pairs += pairs[:50] + [(b, a) for a, b in pairs[:50]]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    rows = [tuple(r) for r in cycles.triangles(edges, f"{tmp_path}/a").collect()]
    want = by_hand(pairs)
    assert len(rows) == len(want) and {frozenset(r) for r in rows} == want
    counts = {r["uid"]: r["triangles"] for r in cycles.triangle_counts(edges, f"{tmp_path}/b").collect()}
    assert counts == Counter(v for t in want for v in t)


def test_a_hub_is_low_in_few_pairs(spark, tmp_path):
    """A wheel: the hub touches all of 2,000 nodes. Joined at the hub there were two million open pairs."""
    n = 2000
    edges = spark.range(n).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst")).union(spark.range(n).select(F.col("id"), (F.col("id") + 1) % n))
    ranked = cycles.ranked_pairs(edges, f"{tmp_path}/r")
    at = {r["low"]: r["count"] for r in ranked.groupBy("low").count().collect()}
    assert -1 not in at and max(at.values()) <= (2 * ranked.count()) ** 0.5
    assert cycles.triangles(edges, f"{tmp_path}/t").count() == n


def test_leaves_are_left_out(spark, tmp_path):
    """A star with one triangle: before, each of its 500 leaves was a pair that all joins carried along."""
    edges = spark.range(500).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst")).union(spark.createDataFrame([(0, 1)], "src long, dst long"))
    assert cycles.ranked_pairs(edges, f"{tmp_path}/r").count() == 3
    assert [sorted(r) for r in cycles.triangles(edges, f"{tmp_path}/t").collect()] == [[-1, 0, 1]]


def test_no_edges_no_triangles(spark, tmp_path):
    assert cycles.triangles(spark.createDataFrame([], "src string, dst string"), f"{tmp_path}/t").collect() == []


def test_tree_hash_tells_multisets_apart(spark):
    rows = [(f"k{i % 50}", f"line {i % 80}") for i in range(400)] + [(None, None), ("", ""), (None, "")]
    frame = lambda r: spark.createDataFrame(r, "uid string, line string")
    root = lambda r: tuple(quality.root_hash(frame(r)).first())
    whole = root(rows)
    assert whole[0] == len(rows) and whole == root(rows[::-1]) == tuple(quality.root_hash(frame(rows).repartition(3)).first())
    for other in (rows[1:], [*rows, rows[0]], [("k0", "line 1"), *rows[1:]], [*rows[:-1], ("", "")], [*rows[:-1], (None, None)]):
        assert root(other) != whole
    assert root([]) == (0, "d41d8cd98f00b204e9800998ecf8427e")
    assert quality.differing_ranges(frame(rows), frame(rows[::-1])).collect() == []
    for depth in (1, 2, 4):
        found = quality.differing_ranges(frame(rows), frame(rows[1:] + [("new", "x")]), depth=depth).collect()
        prefix = lambda k: frame([(k, "")]).select(F.substring(F.md5(F.lit("=" + k)), 1, depth)).first()[0]  # noqa: B023, E731
        assert {r["prefix"] for r in found} == {prefix("k0"), prefix("new")}
    one = quality.differing_ranges(frame([]), frame(rows[:1])).first()
    assert (one["n_a"], one["n_b"]) == (0, 1)


def test_sample_is_the_same_for_any_order_and_needs_no_window(spark):
    rows = [("A", f"a{i}", '{"x":1,"y":{"z":2}}' if i % 3 else "{}") for i in range(6000)] + [("B", "b", '{"x":1}'), ("B", None, None)]
    nodes = spark.createDataFrame(rows, "label string, uid string, props_json string")
    some = metrics.property_count(nodes, sample=600)
    assert "Window" not in some._jdf.queryExecution().executedPlan().toString()
    got = {r["label"]: (r["nodes"], r["properties"]) for r in some.collect()}
    again = {r["label"]: (r["nodes"], r["properties"]) for r in metrics.property_count(nodes.orderBy(F.desc("uid")).repartition(5), sample=600).collect()}
    assert got == again and got["B"] == (2, 1)
    assert got["A"][0] == 6000 and 10_500 < got["A"][1] < 13_500  # 12,000 keys in all
    assert {tuple(r) for r in metrics.property_count(nodes, sample=10**6).collect()} == {tuple(r) for r in metrics.property_count(nodes).collect()}


def test_triangles_of_kinds(spark, tmp_path):
    """Hubs of any kind, loops of kinds, repeated and turned edges; kinds that no three close are no part of the joins."""
    rng = random.Random(5)
    kind = lambda i: "abcde"[i % 5]
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(500)] + [(3, i) for i in range(90)] + [(i, 4) for i in range(0, 90, 2)]
    pairs = [(x, y) for x, y in pairs if {kind(x), kind(y)} not in ({"a", "b"}, {"a", "c"}, {"c"})] + [(200 + i, 300 + i) for i in range(50)]
    pairs += pairs[:40] + [(y, x) for x, y in pairs[:40]] + [(7, 7)]
    named = [(x, kind(x) if x < 200 else "leaf", y, kind(y) if y < 300 else "top") for x, y in pairs]
    edges = spark.createDataFrame(named, "src long, src_kind string, dst long, dst_kind string")
    want = by_hand(pairs)
    of = {v: k for x, j, y, k in named for v, k in ((x, j), (y, k))}
    by_kind = Counter(tuple(sorted(of[v] for v in t)) for t in want)
    assert {tuple(r["kinds"]): r["n"] for r in cycles.triangles_by_kind(edges, f"{tmp_path}/k").collect()} == by_kind
    rows = [frozenset(r) for r in cycles.triangles(edges, f"{tmp_path}/t").collect()]
    assert len(rows) == len(want) and set(rows) == want
    found = cycles.wedges(edges, f"{tmp_path}/w")
    assert not {"leaf", "top"} & {found.kinds[r[0]] for r in found.closing.select("kb").distinct().collect()}
    none = cycles.triangles_by_kind(edges.where("false"), f"{tmp_path}/n")
    assert none.collect() == []


def test_hubs_alone_are_counted(spark, tmp_path):
    """Before, every node's degree was written and met with all pairs; a star's hub is the one row now, and no two edges meet there."""
    star = spark.range(3000).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))
    found = cycles.wedges(star.union(spark.createDataFrame([(0, 1)], "src long, dst long")), f"{tmp_path}/s")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/s/hubs").collect()] == [(-1, "", 3000)]
    assert found.open_.count() == 1 and found.closing.count() == 3001
