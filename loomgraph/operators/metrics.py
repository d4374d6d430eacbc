"""Counts, histories and evaluation summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.model import Graph, union_all

#: Ranges of a sample's hash, a power of 16: that many counts per label at most are gathered.
SAMPLE_RANGES = 16**3


def label_counts(graph: Graph) -> DataFrame:
    """``(label, n)``; each label's table is counted by itself, so no column of it is read."""
    return union_all([t.agg(F.lit(x).alias("label"), F.count(F.lit(1)).alias("n")) for x, t in graph.node_tables.items()])


def out_degrees(graph: Graph, label: str, etype: str) -> DataFrame:
    """``(uid, degree)`` of all nodes of a label, those without such edges included."""
    edges = graph.edges(etype, src_label=label).groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
    nodes = graph.nodes(label).select("uid")
    return nodes.join(edges, F.col("uid") == F.col("src"), "left").select("uid", F.coalesce("_d", F.lit(0)).alias("degree"))


def property_count(nodes: DataFrame, *, sample: int | None = None) -> DataFrame:
    """``(label, nodes, properties)``: the keys, nested ones too, of ``props_json``.

    In JSON text every key is a string followed by a colon, so they are counted by a pattern that steps
    over strings. With ``sample`` the mean of at least that many nodes per label, or of all, is scaled up:
    nodes fall into ranges of a hash of their ``uid`` (of the properties, where there is none), which are
    counted on the map side, and of each label the first ranges that hold enough nodes are the sample. So it is the
    same whatever the order of the rows, and goes beyond ``sample`` by less than one range of ``SAMPLE_RANGES``.
    """
    keys = F.regexp_count("props_json", F.lit('"(?:[^"\\\\]|\\\\.)*"\\s*:')).cast("long")
    if sample is None:
        return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.sum(keys).alias("properties"))
    by = F.coalesce(F.col("uid" if "uid" in nodes.columns else "props_json").cast("string"), F.lit(""))
    digits = int(math.log(SAMPLE_RANGES, 16))
    ranges = nodes.groupBy("label", F.substring(F.md5(by.cast("binary")), 1, digits).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum(keys).alias("k"))
    listed = ranges.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("r", "n", "k"))).alias("_r"), F.sum("n").alias("nodes"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))
    more = lambda got, x: F.struct((got["n"] + x["n"]).alias("n"), (got["k"] + F.coalesce(x["k"], F.lit(0))).alias("k"))
    some = F.aggregate("_r", none, lambda got, x: F.when(got["n"] < sample, more(got, x)).otherwise(got))
    mean = F.try_divide(some["k"].cast("double"), some["n"])
    return listed.select("label", "nodes", F.round(F.col("nodes") * mean).cast("long").alias("properties"))


def pulse_history(metrics: DataFrame, *, length: int = 12, fill: bool = True) -> DataFrame:
    """Add ``history``, the last ``length`` values of each ``metric`` by ``batch_ts``. With ``fill`` the first
    value stands for those before it."""
    by_metric = Window.partitionBy("metric").orderBy("batch_ts")
    last = F.collect_list("value").over(by_metric.rowsBetween(-(length - 1), 0))
    out = metrics.withColumn("history", last)
    if fill:
        first = F.first("value").over(by_metric.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("history", F.concat(F.array_repeat(first, F.lit(length) - F.size("history")), F.col("history")))
    return out


def evaluation_summary(records: DataFrame) -> DataFrame:
    """Per model: records, questions, shares of valid, failed and retried records in percent, and means."""
    valid = F.coalesce(F.col("final.valid"), F.lit(False))
    failed = F.coalesce(F.length("final.execution_error") > 0, F.lit(False))
    retried = F.coalesce(F.col("metrics.attempts") > 1, F.lit(False))
    percent = lambda part, of: F.try_divide(100.0 * F.count_if(part), F.count_if(of))
    every = F.lit(True)
    return (
        records.groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count_distinct("question_id").alias("questions"),
            percent(valid, every).alias("valid_pct"),
            percent(failed, every).alias("execution_error_pct"),
            percent(retried, every).alias("retry_pct"),
            percent(retried & valid, retried).alias("retry_success_pct"),
            F.avg("metrics.attempts").alias("mean_attempts"),
            F.avg("metrics.latency_ms").alias("mean_latency_ms"),
            F.avg("metrics.total_tokens").alias("mean_total_tokens"),
            F.avg("metrics.total_prompt_tokens").alias("mean_prompt_tokens"),
            F.avg("metrics.total_output_tokens").alias("mean_output_tokens"),
        )
        .orderBy(F.desc("valid_pct"), F.asc("execution_error_pct"), F.asc("mean_latency_ms"), F.asc("model"))
    )


def multiset_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, with ``n``, that one side has more often than the other: counts of both sides are added up with
    opposite signs, one shuffle of pre-aggregated rows."""
    signed = a.select(*columns, F.lit(1).alias("_s")).unionByName(b.select(*columns, F.lit(-1).alias("_s")))
    return signed.groupBy(*columns).agg(F.sum("_s").alias("n")).where("n <> 0")


def results_match(expected: DataFrame, result: DataFrame, *, order_col: str | None = None) -> bool:
    """Do the expected columns agree, as multisets or, with ``order_col`` (a position in both), row by row?
    A result without all the columns doesn't match."""
    columns = [c for c in expected.columns if c != order_col]
    if not set(columns) <= set(result.columns):
        return False
    return multiset_difference(expected, result, columns + ([order_col] if order_col else [])).isEmpty()


def uniform_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column the value that all rows share, else null. Nulls are values."""
    return rows.agg(
        *[
            F.when((F.count(c) == F.count(F.lit(1))) & F.min(c).eqNullSafe(F.max(c)), F.min(c)).alias(c)
            for c in columns
        ]
    )
