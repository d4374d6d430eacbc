"""The canonical export: lines in order, made after the sort, packed or not."""

import glob
import gzip
import json

from loomgraph.operators.model import Graph
from loomgraph.sources import sinks

COMMON = "uid string, name string, namespace string, resource_version string, size int"


def test_lines_are_made_after_the_sort(spark, tmp_path):
    """Before, the sort shuffled each line beside the columns it is made of, and the files couldn't be packed."""
    nodes = spark.createDataFrame([(f"a{i * 7 % 50}", "n", None, None, i) for i in range(50)], COMMON)
    edges = spark.createDataFrame([(f"a{i * 3 % 50}", f"a{i * 7 % 50}") for i in range(50)], "src string, dst string")
    graph = Graph({"A": nodes}, {("A", "To", "A"): edges, ("A", "Is", "A"): edges.limit(20)})
    for lines in sinks.canonical_lines(graph).values():
        plan = lines._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index(" AS line") < plan.index("Sort [") and " AS line" not in plan[plan.index("Sort [") :]
    sinks.write_canonical(graph, f"{tmp_path}/plain")
    sinks.write_canonical(graph, f"{tmp_path}/packed", compression="gzip")
    for what, key in (("nodes", lambda x: x["uid"]), ("edges", lambda x: (x["src"], x["rel"], x["dst"]))):
        plain = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/plain/{what}/part-*.txt")))
        packed = "".join(gzip.open(f, "rt").read() for f in sorted(glob.glob(f"{tmp_path}/packed/{what}/part-*.txt.gz")))
        rows = [json.loads(x) for x in plain.splitlines()]
        assert plain == packed and len(rows) == (50 if what == "nodes" else 70) and rows == sorted(rows, key=key)
        assert spark.read.text(f"{tmp_path}/packed/{what}").count() == len(rows)
