"""The last object of a uid or a name is the same however the files are cut into tasks."""

import json
import random

from loomgraph.operators import edges
from loomgraph.operators.nodes import observed_nodes
from loomgraph.sources import sinks
from loomgraph.sources.snapshot import ORDINAL, SCHEMAS, read_snapshot


def test_last_in_the_files_wins_for_any_split(spark, tmp_path):
    rng = random.Random(11)
    claims = [{"metadata": {"name": f"n{rng.randrange(40)}", "namespace": rng.choice("xy"), "uid": f"u{rng.randrange(300)}", "resourceVersion": str(i)}} for i in range(900)]
    for name, _ in SCHEMAS.values():
        (tmp_path / "nd" / name).mkdir(parents=True)
    folder = tmp_path / "nd" / "persistentvolumeclaims"
    for k in range(3):
        (folder / f"part-{k}.json").write_text("\n".join(json.dumps(c) for c in claims[k * 300 : k * 300 + 300]))
    last = {c["metadata"]["uid"]: c["metadata"]["resourceVersion"] for c in claims}
    by_name = {c["metadata"]["name"]: c["metadata"]["uid"] for c in claims}
    by_both = {(c["metadata"]["name"], c["metadata"]["namespace"]): c["metadata"]["uid"] for c in claims}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "4k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = read_snapshot(spark, str(tmp_path / "nd"), format="ndjson", ordinals=True)["PersistentVolumeClaim"]
            assert size == "128m" or read.rdd.getNumPartitions() > 10
            for objects in (read, read.repartition(7)):  # dealt anew, the rows keep their places
                nodes = observed_nodes("PersistentVolumeClaim", objects)
                assert ORDINAL not in nodes.columns
                assert {r["uid"]: r["resource_version"] for r in nodes.select("uid", "resource_version").collect()} == last
                assert {r["_name"]: r["_uid"] for r in edges.name_lookup(objects, by_namespace=False).collect()} == by_name
                assert {(r["_name"], r["_ns"]): r["_uid"] for r in edges.name_lookup(objects, by_namespace=True).collect()} == by_both
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_places_are_not_written(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, _ in SCHEMAS.values():
        (tmp_path / "a" / f"{name}.json").write_text("[]")
    (tmp_path / "a" / "pods.json").write_text(json.dumps([{"metadata": {"uid": "p1", "name": "a"}}, {"metadata": {"uid": "p1", "name": "b"}}]))
    read = read_snapshot(spark, str(tmp_path / "a"), ordinals=True)
    assert [r["name"] for r in observed_nodes("Pod", read["Pod"]).collect()] == ["b"]
    sinks.write_snapshot({"Pod": read["Pod"]}, str(tmp_path / "out"))
    assert ORDINAL not in spark.read.json(str(tmp_path / "out" / "pods")).columns
