"""Differences, their application, quality and metric jobs, sources and streams."""

import json

from pyspark.sql import functions as F

from loomgraph.operators import changes, edges, metrics, quality
from loomgraph.operators.nodes import build_graph
from loomgraph.plans import cluster
from loomgraph.plans.questions import QUESTIONS
from loomgraph.sources import sinks, snapshot
from loomgraph.streaming import refresh

SF = "/root/testdata/sf0.001"
NODE = "uid string, name string, namespace string, resource_version string, label string, props string"
EDGE = "src string, src_label string, etype string, dst string, dst_label string"


def ops(df):
    return sorted((r["uid"], r["op"]) for r in df.collect())


def test_diff_and_apply(spark):
    old = spark.createDataFrame([("a", "a", "n", "1", "Pod", "{}"), ("b", "b", "n", "1", "Pod", "{}"), ("c", "c", "n", None, "Host", "{}"), ("d", "d", "n", "1", "Pod", "{}")], NODE)
    new = spark.createDataFrame([("a", "a", "n", "1", "Pod", '{"x":1}'), ("b", "b", "n", "2", "Pod", "{}"), ("c", "c", "n", None, "Host", '{"x":1}'), ("e", "e", "n", "1", "Pod", "{}")], NODE)
    found = changes.node_diff(new, old)
    assert ops(found) == [("b", "modified"), ("c", "modified"), ("d", "removed"), ("e", "added")]
    old_edges = spark.createDataFrame([("a", "Pod", "T", "d", "Pod"), ("a", "Pod", "T", "b", "Pod")], EDGE)
    new_edges = spark.createDataFrame([("a", "Pod", "T", "b", "Pod"), ("e", "Pod", "T", "a", "Pod")], EDGE)
    between = changes.edge_diff(new_edges, old_edges)
    nodes, links = changes.apply_diff(old, old_edges, found, new, between)
    unchanged = new.where("uid <> 'a'")  # a's version is the same, so its content counts as unchanged
    assert nodes.where("uid <> 'a'").exceptAll(unchanged).isEmpty() and nodes.count() == 4
    assert links.exceptAll(new_edges).isEmpty() and links.count() == 2
    assert changes.is_empty(changes.node_diff(old, old), changes.edge_diff(old_edges, old_edges))


def test_snapshot_diff_summary(spark):
    old = spark.createDataFrame([("Pod", "a", "1"), ("Pod", "b", "1"), ("Job", "j", None), ("Pod", None, "1")], "kind string, uid string, resource_version string")
    new = spark.createDataFrame([("Pod", "a", "2"), ("Pod", "c", "1"), ("Job", "j", None)], "kind string, uid string, resource_version string")
    diff = changes.snapshot_diff(new, old)
    assert ops(diff) == [("a", "modified"), ("b", "removed"), ("c", "added")]
    assert [tuple(r) for r in changes.diff_summary(diff).collect()] == [("Pod", 1, 1, 1)]


def test_hash_ignores_order_and_sees_changes(spark):
    nodes = spark.createDataFrame([(f"u{i}", f"n{i}", None, "1", "Pod", "{}") for i in range(50)], NODE)
    none = spark.createDataFrame([], EDGE)
    digest = lambda n: quality.content_hash(quality.canonical_nodes(n), quality.canonical_edges(none)).first()["graph_hash"]
    assert digest(nodes) == digest(nodes.repartition(7).orderBy(F.desc("uid"))) != digest(nodes.where("uid <> 'u7'"))


def test_edges_last_rule_wins(spark):
    rows = [("p", "Pod", "Manages", "v", "PersistentVolumeClaim", 3), ("p", "Pod", "ClaimsVolume", "v", "PersistentVolumeClaim", 6)]
    out = edges.one_per_pair(spark.createDataFrame(rows, EDGE + ", ord int"))
    assert [r["etype"] for r in out.collect()] == ["ClaimsVolume"]


def test_metrics(spark):
    props = spark.createDataFrame([("Pod", '{"a":{"b":1,"c":"x:\\"y\\":"},"d":[{"e":2}]}'), ("Pod", "{}")], "label string, props_json string")
    assert tuple(metrics.property_count(props).first()) == ("Pod", 2, 5)
    assert tuple(metrics.property_count(props, sample=200).first()) == ("Pod", 2, 5)
    pulse = spark.createDataFrame([(i, "m", i * i) for i in range(14)], "batch_ts int, metric string, value int")
    history = {r["batch_ts"]: r["history"] for r in metrics.pulse_history(pulse).collect()}
    assert history[0] == [0] * 12 and history[13] == [x * x for x in range(2, 14)]
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, s string")
    assert metrics.results_match(a, a.select("s", "i", F.lit(1).alias("more"))) and not metrics.results_match(a, a.distinct())
    assert not metrics.results_match(a, a.select("i"))
    assert metrics.uniform_values(a.where("i = 1"), ["i", "s"]).first().asDict() == {"i": 1, "s": "x"}


def test_evaluations(spark, tmp_path):
    record = lambda q, valid, attempts, error=None, tokens=None: json.dumps({"model": "m", "question_id": q, "run_index": 1, "final": {"valid": valid, "execution_error": error}, "metrics": {"attempts": attempts, "latency_ms": 10, "total_tokens": tokens}})
    (tmp_path / "r.jsonl").write_text("\n".join([record("a", True, 1, tokens=5), "", "{broken", record("b", True, 2), record("b", False, 2, "boom")]))
    row = metrics.evaluation_summary(snapshot.read_evaluations(spark, str(tmp_path))).first()
    assert (row["records"], row["questions"], row["retry_success_pct"], row["mean_total_tokens"]) == (3, 2, 50.0, 5.0)
    assert round(row["valid_pct"], 2) == 66.67 and round(row["execution_error_pct"], 2) == 33.33


def test_questions_file(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"easy": [{"id": "e1", "question": "?", "tags": ["t"]}], "hard": [{"id": "h1", "question": "?"}]}))
    got = {r["id"]: r["tags"] for r in snapshot.read_questions(spark, str(tmp_path / "q.json")).collect()}
    assert got == {"e1": ["t", "difficulty:easy"], "h1": ["difficulty:hard"]}


def test_snapshot_round_trip_store_and_refresh(spark, tmp_path):
    made = cluster.cluster_snapshot(spark, SF)
    sinks.write_snapshot(made, f"{tmp_path}/s0", format="parquet")
    read = snapshot.read_snapshot(spark, f"{tmp_path}/s0", format="parquet")
    for kind in ("Pod", "Ingress", "EndpointSlice"):
        assert read[kind].count() == made[kind].count()
    scoped = snapshot.read_snapshot(spark, f"{tmp_path}/s0", namespace="NATION_6", format="parquet")
    assert scoped["Pod"].select("metadata.namespace").distinct().count() <= 1 and scoped["Node"].count() == made["Node"].count()
    assert "managedFields" not in snapshot.cleanup_metadata(read["Pod"]).schema["metadata"].dataType.fieldNames()

    small = {k: df.where("rand() < 2") for k, df in read.items()}
    graph, rejects = build_graph(small, store=f"{tmp_path}/built")
    assert {r["rule"] for r in rejects.select("rule").distinct().collect()} <= {"ClaimsVolume", "Concerns", "uid", "Manages", "schema"}
    assert len(QUESTIONS) == 60 and {f"q_cluster_{x}" for x in QUESTIONS} <= set(cluster.oracle_sql())

    def load(_, path):
        if path == "full":
            return graph
        smaller = build_graph({**small, "Event": small["Event"].limit(5)}, store=f"{tmp_path}/built2")[0]
        return smaller

    manifests = tmp_path / "manifests"
    manifests.mkdir()
    store = refresh.GraphStore(spark, f"{tmp_path}/store")
    counts = []
    for i, name in enumerate(("full", "few")):
        (manifests / f"{i}.json").write_text(json.dumps({"snapshot": name}))
        refresh.refresh_stream(spark, str(manifests), store.path, f"{tmp_path}/cp", load=load, available_now=True).awaitTermination()
        nodes, links = store.read(store.last())
        counts.append((nodes.count(), nodes.where("label = 'Event'").count(), links.where("etype = 'Concerns'").count()))
    assert store.last() == 1 and counts[0][0] - counts[1][0] == counts[0][1] - 5 and counts[1][2] <= 5


def test_change_stream(spark, tmp_path):
    schema = "uid string, resource_version string, deleted boolean"
    source = f"{tmp_path}/in"
    (tmp_path / "in").mkdir()
    found = refresh.detect_changes(spark.readStream.schema(schema).parquet(source))
    for k, rows in enumerate([[("a", "1", False), ("b", "1", False)], [("a", "2", False), ("b", "1", False)], [("a", None, True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        got = sorted((r["uid"], r["op"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        assert got == [[("a", "added"), ("b", "added")], [("a", "added"), ("a", "modified"), ("b", "added")], [("a", "added"), ("a", "modified"), ("a", "removed"), ("b", "added")]][k]
