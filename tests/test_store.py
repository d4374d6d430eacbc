"""The stored graph's properties, its versions, ordered changes, and paths reduced by semi joins."""

import os
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.operators.match import Hop, Node, Rows
from loomgraph.operators.model import Graph
from loomgraph.sources import sinks
from loomgraph.streaming import refresh

TRIPLES = (("A", "To", "B"), ("B", "To", "C"))
COMMON = "uid string, name string, namespace string, resource_version string"


def graph_of(spark, sizes, edges, open_props=('{"k": 1, "q\'s": {"x": 2}}', "not json", None)):
    a = [(f"a{i}", f"n{i}", None, None, size, i * 0.5) for i, size in sizes.items()]
    tables = {
        "A": spark.createDataFrame(a, f"{COMMON}, size int, price double"),
        "B": spark.createDataFrame([(f"b{i}", None, "ns", "7", i, p) for i, p in enumerate(open_props)], f"{COMMON}, rank long, props string"),
        "C": spark.createDataFrame([("c0", "c", None, None)], COMMON),
    }
    pairs = spark.createDataFrame(edges, "src string, dst string")
    return Graph(tables, {TRIPLES[0]: pairs.where("src like 'a%'"), TRIPLES[1]: pairs.where("src like 'b%'")})


EDGES = [("a1", "b0"), ("a1", "b1"), ("a2", "b0"), ("b0", "c0")]


def matched(graph):
    rows = Rows(graph).match(Node("a", "A"), Hop("To"), Node("b", "B"), where=lambda v: v.a["size"] > 5)
    return Counter(map(tuple, rows.returns(lambda v: {"a": v.a["uid"], "price": v.a["price"], "rank": v.b["rank"], "k": v.b.get("k", "int")}).collect()))


def test_properties_survive_the_store(spark, tmp_path):
    g = graph_of(spark, {1: 7, 2: 9, 3: 1}, EDGES)
    sinks.write_graph(g, f"{tmp_path}/g")
    back = sinks.read_graph(spark, f"{tmp_path}/g")
    assert matched(back) == Counter([("a1", 0.5, 0, 1), ("a1", 0.5, 1, None), ("a2", 1.0, 0, 1)])
    assert back.node_tables["A"].schema == g.node_tables["A"].schema and back.node_tables["B"].schema["props"].dataType.typeName() == "variant"
    b = Rows(back).match(Node("b", "B"))
    got = b.returns(lambda v: {"rank": v.b["rank"], "q": v.b.get("q's", "string"), "none": v.b.get("z", "int"), "text": v.b["props"].cast("string")}).collect()
    assert {r["rank"]: (r["q"], r["none"], r["text"]) for r in got} == {0: ('{"x":2}', None, '{"k":1,"q\'s":{"x":2}}'), 1: (None, None, "not json"), 2: (None, None, None)}
    plan = Rows(back).match(Node("a", "A"), where=lambda v: v.a["size"] == 7).returns(lambda v: {"p": v.a["price"]})._jdf.queryExecution().toString()
    assert "EqualTo(size,7)" in plan and "ReadSchema: struct<size:int,price:double>" in plan


def test_unknown_property(spark):
    g = graph_of(spark, {1: 7}, EDGES)
    rows = Rows(g).match(Node("a", "A"))
    with pytest.raises(ValueError, match="no field colour"):
        rows.returns(lambda v: {"x": v.a["colour"]})
    assert rows.returns(lambda v: {"x": v.a.get("colour"), "s": v.a.get("size", "string")}).first() == (None, "7")
    assert Rows(g, compat=True).match(Node("a", "A")).returns(lambda v: {"x": v.a["colour"]}).first()[0] is None
    assert Rows(g).match(Node("b", "B")).returns(lambda v: {"k": v.b.get("k", "int")}).where("k = 1").count() == 1


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def content(store, version):
    nodes, edges = store.read(version)
    return Counter(map(tuple, nodes.collect())), Counter(map(tuple, edges.collect()))


def test_versions(spark, tmp_path):
    v0 = graph_of(spark, {i: 7 for i in range(200)}, [(f"a{i}", "b0") for i in range(200)] + EDGES[1::2])
    v1 = graph_of(spark, {i: 8 if i == 5 else 7 for i in range(201) if i != 6}, [(f"a{i}", "b0") for i in range(200)] + EDGES[1::2])  # a6's edges dangle
    store, fresh = refresh.GraphStore(spark, f"{tmp_path}/s"), refresh.GraphStore(spark, f"{tmp_path}/f")
    store.rebuild(0, v0)
    before = files(store.path)
    assert store.update(1, v1) and not store.update(2, v1.__class__(v1.node_tables, {t: e.where("src <> 'a6'") for t, e in v1.edge_tables.items()}))
    changed = spark.read.parquet(f"{store.path}/changes/nodes/version=1")
    assert sorted((r["uid"], r["op"]) for r in changed.collect()) == [("a200", "there"), ("a5", "there"), ("a6", "gone")]
    assert spark.read.parquet(f"{store.path}/changes/edges/version=1").count() == 1 and before < files(store.path)
    kept = Graph(v1.node_tables, {t: e.where("src <> 'a6'") for t, e in v1.edge_tables.items()})
    for k, g in ((0, v0), (1, kept)):
        fresh.rebuild(k, g)
        assert content(store, k) == content(fresh, k)
        assert matched(store.graph(k, v0)) == matched(g)
    # a driver lost between write and commit: the files are there, the version isn't
    v2 = graph_of(spark, {1: 1, 2: 2}, EDGES)
    commit, store._commit = store._commit, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.update(2, v2)
    store._commit = commit
    assert store.last() == 1 and content(store, 5) == content(fresh, 1)
    assert store.update(2, v2)
    fresh.rebuild(2, v2)
    assert content(store, 2) == content(fresh, 2)
    store.compact()
    store.vacuum(2)
    assert content(store, 2) == content(fresh, 2) and not os.path.exists(f"{store.path}/base/v0")
    with pytest.raises(ValueError, match="was dropped"):
        store.read(1)
    assert store.update(3, v0) and content(store, 3) == content(fresh, 0)


class Fake:
    """The handle, state and timers of one key."""

    def __init__(self, forget_ms=None):
        self.value, self.timers, self.now = None, [], 0
        self.processor = refresh._InOrder(forget_ms)
        self.processor.init(self)

    def getValueState(self, *_):
        return self

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    update = lambda self, value: setattr(self, "value", value)
    clear = lambda self: setattr(self, "value", None)
    listTimers = lambda self: iter(self.timers)
    deleteTimer = lambda self, t: self.timers.remove(t)
    registerTimer = lambda self, t: self.timers.append(t)
    getCurrentProcessingTimeInMs = lambda self: self.now

    def batch(self, *rows):
        frame = pd.DataFrame([(v, d) for v, d in rows], columns=["resource_version", "deleted"])
        return [tuple(r) for f in self.processor.handleInputRows(("u",), iter([frame]), self) for r in f.itertuples(index=False)]


def test_changes_in_order_of_version():
    history = [("9", False), ("10", False), ("11", True), ("100", False), ("101", True)]
    whole = Fake()
    want = whole.batch(*history)
    assert [op for _, op, _ in want] == ["added", "modified", "removed", "added", "removed"]
    for seed in range(20):
        given = history[:]
        random.Random(seed).shuffle(given)
        one = Fake()
        assert one.batch(*given) == want and one.value == whole.value  # a shuffled batch: the same changes
        many = Fake()
        out = [x for r in given for x in many.batch(r)]
        assert many.value == whole.value and (not out or out[-1][1] == "removed")  # late rows: the same end


def test_removed_uids_are_forgotten():
    fake = Fake(forget_ms=50)
    assert fake.batch(("1", False), ("2", True)) and fake.timers == [50]
    assert not fake.batch(("1", False)) and fake.value == ("2", True)
    list(fake.processor.handleExpiredTimer(("u",), fake, None))
    assert fake.value is None
    alive = Fake(forget_ms=50)
    alive.batch(("1", True), ("2", False))
    list(alive.processor.handleExpiredTimer(("u",), alive, None))
    assert alive.timers == [] and alive.value == ("2", False)


def test_paths_are_reduced(spark):
    """A hub with most of the edges, at either end and within, adds no rows; plans join no two edge tables."""
    edges = [(f"a{i}", "b0") for i in range(60)] + [("a60", "b1"), ("b0", "c0"), ("a61", "gone")]
    g = graph_of(spark, dict.fromkeys(range(63), 1), edges)
    rows, path = Rows(g).match(Node("a", "A")), (Node("a"), Hop("To"), Node(label="B"), Hop("To"), Node(label="C"))
    uids = lambda r: {x[0] for x in r.returns(lambda v: {"u": v.a["uid"]}).collect()}
    there = {f"a{i}" for i in range(60)}
    assert uids(rows.exists(*path)) == uids(rows.match(*path)) == there
    assert uids(rows.exists(Node(label="C"), Hop("To", "in"), Node(label="B"), Hop("To", "in"), Node("a"))) == there
    assert uids(rows.not_exists(*path)) == {"a60", "a61", "a62"}
    flags = rows.exists_flag("f", *path).returns(lambda v: {"u": v.a["uid"], "f": F.col("f")}).collect()
    assert {r["u"] for r in flags if r["f"]} == there and len(flags) == 63
    assert uids(rows.exists(Node("a"), Hop("To"), Node("x", "B"))) == there | {"a60"}  # a named node must be there
    plan = rows.exists(*path).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "Join Inner" not in plan
