"""Writing snapshots, graphs and canonical exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.model import EDGE_COLUMNS, Graph
from loomgraph.operators.quality import canonical_edges, canonical_nodes
from loomgraph.sources.snapshot import ORDINAL, SCHEMAS


#: Characters of a JSON array's objects after which the next array begins, so that a reader holds no more.
ARRAY_CHARS = 32 << 20


def _arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The partition's objects as JSON arrays, each a value of its own; at least one."""
    whole = lambda x: pd.DataFrame({"array": ["[" + ",\n".join(x) + "]"]})
    held, size, any_ = [], 0, False
    for batch in batches:
        for row in batch["line"]:
            held.append(row)
            size += len(row)
            if size >= ARRAY_CHARS:
                yield whole(held)
                held, size, any_ = [], 0, True
    if held or not any_:
        yield whole(held)


def write_snapshot(snapshot: dict[str, DataFrame], path: str, *, format: str = "ndjson") -> None:
    """One folder per kind, as ``read_snapshot`` reads it: JSON lines or Parquet, which are read back in
    parallel, or, as ``json``, files with an array each, one or more per partition."""
    for kind, df in snapshot.items():
        df = df.drop(ORDINAL)
        target = f"{path}/{SCHEMAS[kind][0]}"
        if format == "json":
            arrays = df.select(F.to_json(F.struct(*df.columns)).alias("line")).mapInPandas(_arrays, "array string")
            arrays.write.mode("overwrite").option("maxRecordsPerFile", 1).text(f"{target}.json")
        elif format == "ndjson":
            df.write.mode("overwrite").option("ignoreNullFields", "true").json(target)
        else:
            df.write.mode("overwrite").parquet(target)


def write_graph(graph: Graph, path: str) -> None:
    """The store: a table per label with its typed columns, edges partitioned by type, and a table of what is there.

    Filters and column pruning on properties reach the files. A ``props`` column of JSON text becomes a VARIANT,
    whose keys ``Var.get`` reads without parsing; text that isn't JSON stays a VARIANT of that text. The table of labels
    and triples is written last: without it there is no graph at ``path``.
    """
    for label, table in graph.node_tables.items():
        if "props" in table.columns and table.schema["props"].dataType.typeName() == "string":
            table = table.withColumn("props", F.coalesce(F.try_parse_json("props"), F.col("props").cast("variant")))
        table.write.mode("overwrite").parquet(f"{path}/nodes/{label}")
    graph.all_edges().write.mode("overwrite").partitionBy("etype").parquet(f"{path}/edges")
    known = [("label", x, None, None) for x in graph.node_tables]
    rows = graph.spark.createDataFrame(known + [("triple", *t) for t in graph.edge_tables], "what string, a string, b string, c string")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/graph")


def read_graph(spark: SparkSession, path: str) -> Graph:
    """The graph that ``write_graph`` stored, with the types that its columns had."""
    known = spark.read.parquet(f"{path}/graph").collect()  # a row per label and per triple of the schema
    tables = {r["a"]: spark.read.parquet(f"{path}/nodes/{r['a']}") for r in known if r["what"] == "label"}
    triples = [(r["a"], r["b"], r["c"]) for r in known if r["what"] == "triple"]
    return Graph(tables, dict.fromkeys(triples), spark.read.parquet(f"{path}/edges").select(*EDGE_COLUMNS))


def directed_graph(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Vertices by id and edges by source, target and type."""
    vertices = graph.nodes().select(F.col("uid").alias("id"), "name", "namespace", F.col("resource_version").alias("version"), F.col("label").alias("type"))
    edges = graph.all_edges().select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("etype").alias("type"))
    return vertices.orderBy("id"), edges.orderBy("source", "target", "type")


def canonical_lines(graph: Graph) -> dict[str, DataFrame]:
    """``line`` of all nodes in order of uid, and of all edges in order of source, type and target.

    What is sorted is the columns; each line is made of them afterwards, so that no text is shuffled twice.
    """
    nodes = canonical_nodes(graph.nodes().select("uid", "label", "props").orderBy("uid", "label"))
    edges = canonical_edges(graph.all_edges().select("src", "etype", "dst").orderBy("src", "etype", "dst"))
    return {"nodes": nodes.select("line"), "edges": edges.select("line")}


def write_canonical(graph: Graph, path: str, *, compression: str | None = None) -> None:
    """Canonical JSON lines for hashing outside; ``compression`` is that of Spark's text writer."""
    for what, lines in canonical_lines(graph).items():
        lines.write.mode("overwrite").text(f"{path}/{what}", compression=compression)
