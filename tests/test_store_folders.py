"""A stored graph's folders: what didn't change is neither joined nor written again, and goes when nothing needs it."""

import os
from collections import Counter

from pyspark.sql import functions as F

from loomgraph.operators import changes
from loomgraph.operators.model import Graph
from loomgraph.streaming import refresh

COMMON = "uid string, name string, namespace string, resource_version string"
TRIPLES = (("A", "To", "B"), ("B", "To", "odd: label/100%"), ("A", "Is", "A"))


def graph_of(spark, a, b=("b0", "b1"), more=(), swap=False):
    """``a``: uid -> size; ``swap`` gives a1 to B."""
    tables = {
        "A": spark.createDataFrame([(u, None, None, None, s) for u, s in a.items() if not (swap and u == "a1")], f"{COMMON}, size int"),
        "B": spark.createDataFrame([(u, "n", "ns", None) for u in (*b, *(["a1"] if swap else []))], COMMON),
        "odd: label/100%": spark.createDataFrame([("c0", "c", None, "1")], COMMON),
    }
    pairs = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    return Graph(tables, {TRIPLES[0]: pairs([(u, b[0]) for u in a]), TRIPLES[1]: pairs([(u, "c0") for u in b]), TRIPLES[2]: pairs([("a0", "a0"), *more])})


def content(store, version):
    return tuple(Counter(map(tuple, df.collect())) for df in store.read(version))


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_same_edges_meet_nothing(spark, tmp_path):
    old, new = graph_of(spark, {f"a{i}": 1 for i in range(300)}), graph_of(spark, {f"a{i}": 1 + (i == 7) for i in range(300)})
    same, also = changes.changed_edges(new.all_edges().repartition(3), old.all_edges(), f"{tmp_path}/e")
    assert same.isEmpty() and also.isEmpty()
    text = same._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in text or "Scan" not in text  # nothing is read to find no changes
    null = lambda rows: spark.createDataFrame([(a, "A", "To", b, "B") for a, b in rows], refresh.EDGES)
    assert changes.changed_edges(null([("x", None)]), null([(None, "x")]), f"{tmp_path}/x")[0].count() == 1


def test_compaction_names_folders_of_the_base_before(spark, tmp_path):
    v0 = graph_of(spark, {f"a{i}": 1 for i in range(50)})
    v1 = graph_of(spark, {f"a{i}": 1 + (i == 7) for i in range(50)}, more=[("a1", "a2")])
    store, fresh = refresh.GraphStore(spark, f"{tmp_path}/s"), refresh.GraphStore(spark, f"{tmp_path}/f")
    store.rebuild(0, v0)
    first = files(f"{store.path}/rows")
    assert store.update(1, v1)
    fresh.rebuild(1, v1)
    store.compact()
    new = files(f"{store.path}/rows") - first
    assert {x.split("/rows/")[1].split("/", 2)[2].rsplit("/", 1)[0] for x in new} == {"label=A", "src_label=A/etype=Is/dst_label=A"}
    assert content(store, 1) == content(fresh, 1)
    store.vacuum(1)
    left = files(f"{store.path}/rows")
    assert new < left and not any("label=A/part" in x and "src_label" not in x for x in left - new)
    assert content(store, 1) == content(fresh, 1) and not os.path.exists(f"{store.path}/base/v0")
    v2 = graph_of(spark, {"a0": 5}, b=("b1",))
    assert store.update(2, v2)
    fresh.rebuild(2, v2)
    store.compact()
    store.vacuum(2)
    assert content(store, 2) == content(fresh, 2)
    assert all("label=odd%3A label%2F100%25" in x for x in files(f"{store.path}/rows") & first)  # all else of the first base is gone
    store.compact()  # a base stays one
    store.rebuild(2, v0)
    fresh.rebuild(3, v0)
    assert content(store, 2) == content(fresh, 3)


def test_a_node_that_changes_its_label(spark, tmp_path):
    store, fresh = refresh.GraphStore(spark, f"{tmp_path}/s"), refresh.GraphStore(spark, f"{tmp_path}/f")
    sizes = {f"a{i}": 1 for i in range(5)}
    store.rebuild(0, graph_of(spark, sizes))
    for version, swap in ((1, True), (2, False)):
        g = graph_of(spark, sizes, swap=swap)
        assert store.update(version, g)
        fresh.rebuild(version, g)
        assert content(store, version) == content(fresh, version)
    assert store.read(1)[0].where(F.col("uid") == "a1").collect()[0]["label"] == "B"
