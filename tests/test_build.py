"""A small hand-written snapshot, from array files to the graph; every row of the result is known."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import edges, quality
from loomgraph.operators.nodes import build_graph, cleanup_metadata
from loomgraph.sources import sinks
from loomgraph.sources.snapshot import OPTIONAL, SCHEMAS, read_snapshot
from loomgraph.streaming.refresh import GraphStore


def meta(uid, name, namespace=None, owner=None, **more):
    owners = [{"kind": owner[0], "name": "x", "uid": owner[1]}] if owner else None
    return {"metadata": {"uid": uid, "name": name, "namespace": namespace, "resourceVersion": "1", "ownerReferences": owners, **more}}


def backend(service, port):
    return {"path": f"/{port}", "backend": {"service": {"name": service, "port": {"number": port}}}}


def endpoint(addresses, pod=None, kind="Pod"):
    return {"addresses": addresses, "conditions": {"ready": True}, "targetRef": {"kind": kind, "uid": pod} if pod else None}


FILES = {
    "Cluster": {**meta(None, None), "name": "c", "cluster_url": "https://c", "info": {"major": "1"}},
    "Namespace": [meta("n1", "default"), meta("n2", "other"), meta("n3", "other")],  # the last of a name counts
    "Deployment": [meta("d1", "web", "default"), meta("d2", "alone", "default")],
    "ReplicaSet": [meta("r1", "web-1", "default", ("Deployment", "d1"))],
    "Pod": [
        {**meta("p1", "old", "default", ("ReplicaSet", "r1")), "status": {"phase": "Pending"}},
        {**meta("p2", "two", "other", ("Gadget", "g1")), "spec": {"nodeName": "gone", "containers": [{"name": "main"}], "initContainers": [{"name": "main"}]}},
        {**meta("p1", "one", "default", ("ReplicaSet", "r1"), managedFields=[{"manager": "k"}], annotations={"kapp.k14s.io/original": "x", "mine": "y"}),
         "spec": {"nodeName": "m1", "containers": [{"name": "main"}, {"name": "side"}], "volumes": [{"name": "v", "persistentVolumeClaim": {"claimName": "data"}}, {"name": "w"}]}},
        {**meta("p3", "three", "nowhere", ("Service", "s1")), "spec": {"containers": [], "volumes": [{"name": "v", "persistentVolumeClaim": {"claimName": "missing"}}]}},
        meta(None, "nameless", "default"),
        meta("s2", "was a pod", "default"),  # its uid comes again as a service
    ],
    "Service": [meta("s1", "web", "default"), meta("s2", "web", "other")],
    "Ingress": [{**meta("i1", "in", "default"), "spec": {"rules": [{"host": "web.example.org", "http": {"paths": [backend("web", 80), backend("web", 81), backend("none", 82)]}}, {"http": None}]}}],
    "EndpointSlice": [{**meta("e1", "web-e", "default", ("Service", "s1")), "addressType": "IPv4", "endpoints": [endpoint(["10.0.0.2", "10.0.0.1"], "p1"), endpoint(["10.0.0.1", "10.0.0.2"], "p1"), endpoint(["10.0.0.9"], "m1", "Node")]}],
    "StorageClass": [{**meta("k1", "fast"), "provisioner": "csi"}],
    "PersistentVolume": [{**meta("v1", "vol"), "spec": {"storageClassName": "fast", "claimRef": {"uid": "c2"}}}, {**meta("v2", "bare"), "spec": {}}],
    "PersistentVolumeClaim": [meta("c1", "data", "other"), meta("c2", "data", "default", ("Pod", "p1"))],
    "Node": [meta("m1", "m1")],
    "Event": [{**meta("ev1", "e"), "type": "Warning", "regarding": {"kind": "Pod", "uid": "p1"}}, {**meta("ev2", "e"), "regarding": {"kind": "Gizmo", "uid": "x"}}, {**meta("ev3", "e"), "regarding": {"kind": "Pod", "uid": "gone"}}],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("snapshot")
    for kind, (name, _) in SCHEMAS.items():
        if kind in FILES or kind not in OPTIONAL:
            (path / f"{name}.json").write_text(json.dumps(FILES.get(kind, [])))
    return str(path)


@pytest.fixture(scope="module")
def built(spark, folder, tmp_path_factory):
    return build_graph(read_snapshot(spark, folder), store=f"{tmp_path_factory.mktemp('built')}/store")


def test_read(spark, folder):
    read = read_snapshot(spark, folder)
    assert {k: df.count() for k, df in read.items() if k in FILES} == {k: 1 if k == "Cluster" else len(v) for k, v in FILES.items()}
    assert read["ConfigMap"].isEmpty() and read_snapshot(spark, folder, namespace="other")["Pod"].count() == 1
    assert read_snapshot(spark, folder, namespace="other")["Node"].count() == 1


@pytest.mark.parametrize("form", ["json", "ndjson", "parquet"])
def test_write_and_read_again(spark, folder, tmp_path, form):
    read = read_snapshot(spark, folder)
    sinks.write_snapshot({k: df.repartition(3) for k, df in read.items()}, str(tmp_path / form), format=form)
    lines = lambda df: Counter(r[0] for r in df.select(F.to_json(F.struct(*df.columns))).collect())
    again = read_snapshot(spark, str(tmp_path / form), format=form)
    assert {k: lines(df) for k, df in again.items()} == {k: lines(df) for k, df in read.items()}


def test_nodes(built):
    graph, _ = built
    names = lambda label: sorted((r["uid"], r["name"]) for r in graph.nodes(label).select("uid", "name").collect())
    assert names("Pod") == [("p1", "one"), ("p2", "two"), ("p3", "three")]  # the last p1; s2 is a service
    assert names("Service") == [("s1", "web"), ("s2", "web")]
    assert names("Container") == [("Container:p1:standard:main", "main"), ("Container:p1:standard:side", "side"), ("Container:p2:init:main", "main"), ("Container:p2:standard:main", "main")]
    assert names("Host") == [("Host:i1:web.example.org", "web.example.org")]
    back = graph.nodes("IngressServiceBackend").select("name", "path").collect()
    assert sorted(map(tuple, back)) == [("none", "/82"), ("web", "/81")]  # two paths to a service are one, the last
    assert len(names("Endpoint")) == 2 and [n for _, n in names("EndpointAddress")].count("10.0.0.1") == 1
    kept = graph.nodes("Pod").where("uid = 'p1'").select("metadata").first()["metadata"]
    assert "managedFields" not in kept and kept["annotations"] == {"mine": "y"}
    assert names("Cluster") == [("Cluster:c", "c")] and names("Provisioner") == [("csi", "csi")]


def test_edges(built):
    graph, _ = built
    found = Counter((r["src"], r["etype"], r["dst"]) for r in graph.all_edges().where("etype not in ('PartOf', 'Runs', 'HasAddress', 'ListedIn', 'ContainsEndpoint')").collect())
    e = {r["name"]: r["uid"] for r in graph.nodes("EndpointAddress").collect()}
    assert set(found) == {
        ("d1", "Manages", "r1"), ("r1", "Manages", "p1"), ("s1", "Manages", "e1"), ("p1", "ClaimsVolume", "c2"),  # not Manages: the claim's rule comes later
        *[(x, "BelongsTo", "n1") for x in ("d1", "d2", "r1", "p1", "s1", "i1", "e1", "c2", "Container:p1:standard:main", "Container:p1:standard:side")],
        *[(x, "BelongsTo", "n3") for x in ("p2", "s2", "c1", "Container:p2:init:main", "Container:p2:standard:main")],
        ("p1", "RunsOn", "m1"), ("v1", "UsesStorageClass", "k1"), ("c2", "BoundTo", "v1"), ("k1", "UsesProvisioner", "csi"), ("i1", "DefinesBackend", "IngressServiceBackend:i1:web"),
        ("i1", "DefinesBackend", "IngressServiceBackend:i1:none"), ("IngressServiceBackend:i1:web", "TargetsService", "s1"), ("Host:i1:web.example.org", "IsClaimedBy", "i1"),
        (e["10.0.0.1"], "IsAddressOf", "p1"), (e["10.0.0.2"], "IsAddressOf", "p1"), ("ev1", "Concerns", "p1"),
    }
    assert max(found.values()) == 1


def test_rejects(built):
    _, rejects = built
    assert Counter((r["rule"], r["kind"], r["uid"]) for r in rejects.collect()) == Counter([
        ("uid", "Pod", "nameless"), ("Manages", "Gadget", "p2"), ("ClaimsVolume", "PersistentVolumeClaim", "p3"), ("Concerns", "Gizmo", "ev2"), ("schema", "Service Manages Pod", "s1")])


def test_lookup_by_name_in_both_modes(spark, folder, tmp_path):
    read = read_snapshot(spark, folder)
    found = lambda **o: sorted((tuple(r) for r in edges.name_lookup(read["PersistentVolumeClaim"], **o).collect()), key=str)
    assert found(by_namespace=True) == [("data", "default", "c2"), ("data", "other", "c1")]
    assert found(by_namespace=False) == [("data", "c2")]  # the last
    compat, _ = build_graph(read, compat=True, store=f"{tmp_path}/compat")
    target = compat.edges("TargetsService").collect()
    assert [(r["src"], r["dst"]) for r in target] == [("IngressServiceBackend:i1:web", "s2")]


def test_without_a_store_the_nodes_are_the_same(spark, folder, built):
    lazy, _ = build_graph(read_snapshot(spark, folder))
    ids = lambda g: Counter(map(tuple, g.nodes().select("label", "uid", "name").collect()))
    assert ids(lazy) == ids(built[0])


def test_store_rebuild_update_and_exports(spark, built, tmp_path):
    graph, _ = built
    store = GraphStore(spark, f"{tmp_path}/store")
    store.rebuild(0, graph)
    assert not store.update(1, graph) and store.last() == 0
    smaller, _ = build_graph(read_snapshot(spark, _folder(tmp_path)), store=f"{tmp_path}/b")
    assert store.update(1, smaller) and store.last() == 1
    nodes, links = store.read(1)
    assert Counter(r["uid"] for r in nodes.collect()) == Counter(r["uid"] for r in smaller.nodes().collect())
    assert Counter(map(tuple, links.collect())) == Counter(map(tuple, smaller.all_edges().collect()))
    sinks.write_canonical(graph, f"{tmp_path}/lines")
    lines = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/lines/nodes").collect()]
    assert {x["uid"] for x in lines} == {r["uid"] for r in graph.nodes().collect()} and list(lines[0]) == ["labels", "props", "uid"]
    vertices, arrows = sinks.directed_graph(graph)
    assert [r["id"] for r in vertices.collect()] == sorted(r["uid"] for r in graph.nodes().collect()) and arrows.count() == graph.all_edges().count()
    made = {(r["what"], r["name"]) for r in quality.metadata(graph.nodes(), graph.all_edges()).collect()}
    assert {("cluster", "c"), ("label", "Host"), ("edge", "Concerns")} <= made


def _folder(tmp_path):
    path = tmp_path / "smaller"
    path.mkdir()
    for kind, (name, _) in SCHEMAS.items():
        rows = FILES.get(kind, [])
        (path / f"{name}.json").write_text(json.dumps(rows[:1] if kind in ("Pod", "Event") else rows))
    return str(path)


def test_cleanup(spark, folder):
    pods = cleanup_metadata(read_snapshot(spark, folder)["Pod"])
    assert "managedFields" not in pods.schema["metadata"].dataType.fieldNames()


def test_arrays_are_written_in_few_frames_of_a_bounded_size(monkeypatch):
    """Before, each object was a frame of its own and a partition one array, however large."""
    import pandas as pd

    rows = [json.dumps({"i": i}) for i in range(5000)]
    batches = lambda: iter([pd.DataFrame({"line": rows[:2000]}), pd.DataFrame({"line": rows[2000:]})])
    frames = list(sinks._arrays(batches()))
    assert len(frames) == 1 and [x["i"] for x in json.loads(frames[0]["array"][0])] == list(range(5000))
    monkeypatch.setattr(sinks, "ARRAY_CHARS", 1000)
    parts = [json.loads(f["array"][0]) for f in sinks._arrays(batches())]
    assert len(parts) > 40 and [x["i"] for p in parts for x in p] == list(range(5000))
    assert [f["array"][0] for f in sinks._arrays(iter([]))] == ["[]"]
