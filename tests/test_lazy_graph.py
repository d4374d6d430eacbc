"""A graph whose tables are made when they are asked for, against the one that is built and stored at once."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.match import Hop, Node, Rows
from loomgraph.operators.nodes import build_graph
from loomgraph.plans import cluster
from loomgraph.sources.snapshot import SCHEMAS, schema_of

SF = "/root/testdata/sf0.001"


def _meta(uid, owners=(), name=None):
    return {"uid": uid, "name": name or uid, "namespace": "space", "ownerReferences": [{"kind": k, "uid": u} for k, u in owners]}


def _pod(uid, owners=(), claims=(), containers=("main",)):
    volumes = [{"name": f"v{i}", "persistentVolumeClaim": {"claimName": c}} for i, c in enumerate(claims)]
    return {"metadata": _meta(uid, owners), "spec": {"nodeName": "m", "containers": [{"name": c, "image": f"i{i}"} for i, c in enumerate(containers)], "volumes": volumes}}


END = {"addresses": ["10.1", "10.2", "10.1"], "targetRef": {"kind": "Pod", "uid": "p1"}}
OBJECTS = {
    "Cluster": [{"name": "c"}],
    "Namespace": [{"metadata": {"uid": "n", "name": "space"}}],
    "Node": [{"metadata": {"uid": "m", "name": "m", "namespace": "space"}}],  # no machine belongs to a namespace: a reject
    "ReplicaSet": [{"metadata": _meta("r", [("Deployment", "d"), ("Deployment", "d")])}],
    "Deployment": [{"metadata": _meta("d")}],
    "Job": [{"metadata": _meta("j")}],
    "Service": [{"metadata": _meta("s")}],
    "Pod": [
        _pod("p1", [("ReplicaSet", "r"), ("ReplicaSet", "gone"), ("Service", "s")], ["q", "q", "none"]),
        _pod("p2", [("Job", "Container:p2:standard:main"), ("Job", "j"), ("Gadget", "g")], containers=("main", "side", "main")),
        _pod("p3", [("Job", "e1"), ("Job", "r")]),
    ],
    "PersistentVolumeClaim": [{"metadata": _meta("q", [("Pod", "p1"), ("Pod", "p2")])}],
    "PersistentVolume": [{"metadata": {"uid": "v", "name": "v"}, "spec": {"storageClassName": "k", "claimRef": {"uid": "q"}}}, {"metadata": {"uid": "w", "name": "w"}, "spec": {"claimRef": {"uid": "e3"}}}],
    "StorageClass": [{"metadata": {"uid": "k", "name": "k"}, "provisioner": "prov"}],
    "EndpointSlice": [{"metadata": _meta("x", [("Service", "s")]), "addressType": "IPv4", "endpoints": [END, END, {**END, "targetRef": {"kind": "Pod", "uid": "x"}}, {**END, "targetRef": {"kind": "Pod", "uid": "gone"}}]}],
    "Event": [{"metadata": {"uid": f"e{i}", "name": f"e{i}"}, "regarding": {"kind": k, "uid": u}} for i, (k, u) in enumerate([("Pod", "p1"), ("Pod", "p3"), ("Job", "r"), ("PersistentVolume", "w"), ("Pod", "gone"), ("Gizmo", "z")])],
}


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    text = lambda rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "v string")
    made = {k: text(OBJECTS.get(k, [])).select(F.from_json("v", schema_of(k)).alias("o")).select("o.*") for k in SCHEMAS}
    at = str(tmp_path_factory.mktemp("graphs"))
    return at, build_graph(made, store=f"{at}/whole"), build_graph(made, store=f"{at}/lazy", distinct_uids=True)


def test_same_edges_nodes_and_rejects(both):
    _, (whole, lost), (lazy, lazy_lost) = both
    rows = lambda df: Counter(map(tuple, df.collect()))
    assert rows(lazy.all_edges()) == rows(whole.all_edges())
    assert max(rows(lazy.nodes().select("uid")).values()) == 1
    assert rows(lazy.nodes().select("uid", "label")) == rows(whole.nodes().select("uid", "label"))
    assert rows(lazy_lost) == rows(lost)


def test_same_matches(both):
    _, (whole, _), (lazy, _) = both
    hops = [(Node("a", "Pod"), Hop("Manages", "in"), Node("b")), (Node("a", "ReplicaSet"), Hop("Manages"), Node("b", "Pod")), (Node("a", "Container"), Hop(None, "both"), Node("b", "Pod")),
            (Node("a", "Pod"), Hop("Manages"), Node("b", "PersistentVolumeClaim")), (Node("a", "Event"), Hop("Concerns"), Node("b", "Pod")), (Node("a", "EndpointAddress"), Hop(), Node("b")),
            (Node("a", "Deployment"), Hop("Manages"), Node(label="ReplicaSet"), Hop("Manages"), Node("b", "Pod")), (Node("a", "PersistentVolumeClaim"), Hop("BoundTo"), Node("b"))]
    for pattern in hops:
        found = [Counter(map(tuple, Rows(g).match(*pattern).df.select("a__uid", "b__uid").collect())) for g in (whole, lazy)]
        assert found[0] == found[1] and found[0], pattern
        found = [Counter(map(tuple, Rows(g).match(pattern[0]).not_exists(Node("a"), pattern[1], Node(label=pattern[2].label)).df.select("a__uid").collect())) for g in (whole, lazy)]
        assert found[0] == found[1], pattern


def test_a_question_makes_only_the_tables_it_asks_for(spark, tmp_path):
    """Before, any question wrote all objects, nodes and edges first."""
    graph, _ = build_graph(cluster.cluster_snapshot(spark, SF), store=f"{tmp_path}/g", distinct_uids=cluster.keys_are_distinct(spark, SF))
    for name in ("e01", "e06", "m02", "m18", "m15", "h16"):
        found = cluster.QUESTIONS[name](graph, **({} if name in ("e01", "m18") else {"namespace": "NATION_6"}))
        assert "event_id" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert not os.path.exists(f"{tmp_path}/g")


def test_keys_that_come_twice_are_seen(spark, tmp_path):
    for f in os.listdir(SF):
        os.symlink(f"{SF}/{f}", tmp_path / f)
    assert cluster.keys_are_distinct(spark, str(tmp_path))
    os.unlink(tmp_path / "orders.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.union(orders.limit(1)).write.parquet(f"{tmp_path}/orders.parquet")
    assert not cluster.keys_are_distinct(spark, str(tmp_path))
