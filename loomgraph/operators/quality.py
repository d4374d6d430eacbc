"""Schema conformance, canonical rows and content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPLE = ["src_label", "etype", "dst_label"]


def unknown_triples(edges: DataFrame, triples: DataFrame) -> DataFrame:
    """Edges whose triple isn't allowed, one row per triple with their number.

    Counted first: the anti join only sees as many rows as there are triples.
    """
    return edges.groupBy(*TRIPLE).agg(F.count(F.lit(1)).alias("n")).join(triples, TRIPLE, "left_anti")


def observed_triples(edges: DataFrame) -> DataFrame:
    return edges.select(*TRIPLE).distinct()


def allowed_pairs(triples: DataFrame) -> DataFrame:
    """Per edge type the sorted list of ``source->target``."""
    pair = F.concat(F.col("src_label"), F.lit("->"), F.col("dst_label"))
    return triples.groupBy("etype").agg(F.array_sort(F.collect_set(pair)).alias("pairs"))


def pattern_conformance(patterns: DataFrame, triples: DataFrame, *, labels: list[str] | None = None) -> DataFrame:
    """Judge patterns ``(pattern_id, left_label, etype, direction, right_label)`` against the triples.

    Adds ``ok`` and ``issue``. A pattern is fine if some triple allows it in its direction, or in either
    for ``both``; types match without regard to case, a missing label or type is any. With ``labels`` an
    unknown label is an issue of its own. The triples are a few dozen rows, so their broadcast is bounded.
    """
    t = F.broadcast(triples.select(*[F.col(c).alias(f"_{c}") for c in TRIPLE]).distinct())
    fits = lambda a, b: (F.col(a).isNull() | (F.col(a) == F.col("_src_label"))) & (F.col(b).isNull() | (F.col(b) == F.col("_dst_label")))
    out, back = fits("left_label", "right_label"), fits("right_label", "left_label")
    way = F.col("direction")
    known = F.col("etype").isNull() | (F.lower("etype") == F.lower("_etype"))
    met = ((way != "in") & out) | ((way != "out") & back)
    same_type = patterns.join(t, known, "left_semi").select("pattern_id").withColumn("_type_known", F.lit(True))
    allowed = patterns.join(t, known & met, "left_semi").select("pattern_id").withColumn("_ok", F.lit(True))
    judged = patterns.join(same_type, "pattern_id", "left").join(allowed, "pattern_id", "left")
    bad_label = F.lit(False)
    if labels is not None:
        for side in ("left_label", "right_label"):
            bad_label = bad_label | (F.col(side).isNotNull() & ~F.col(side).isin(*labels))
    issue = F.when(bad_label, "unknown label").when(F.col("_type_known").isNull(), "unknown type").when(F.col("_ok").isNull(), "not allowed")
    return judged.select(*patterns.columns, issue.isNull().alias("ok"), issue.alias("issue"))


def unknown_references(refs: DataFrame, labels: list[str]) -> DataFrame:
    """References ``(rule, kind, uid)`` of kinds outside the labels, counted by rule and kind."""
    return refs.where(~F.coalesce(F.col("kind").isin(*labels), F.lit(False))).groupBy("rule", "kind").agg(F.count(F.lit(1)).alias("n"))


def property_schema(nodes: DataFrame, props: str = "props") -> DataFrame:
    """Per label the merged schema of the JSON properties."""
    return nodes.groupBy("label").agg(F.schema_of_variant_agg(F.parse_json(F.coalesce(props, F.lit("{}")))).alias("schema"))


def metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels and edge types in use and the cluster: ``(what, name)``."""
    named = lambda df, what, column: df.select(F.lit(what).alias("what"), F.col(column).alias("name"))
    used = named(nodes, "label", "label").distinct().unionByName(named(edges, "edge", "etype").distinct())
    return used.unionByName(named(nodes.where(F.col("label") == "Cluster"), "cluster", "name"))


def canonical_nodes(nodes: DataFrame) -> DataFrame:
    """``(uid, line)``: a JSON line per node with its keys in order."""
    line = F.to_json(F.struct(F.array("label").alias("labels"), F.col("props"), F.col("uid")))
    return nodes.select("uid", line.alias("line"))


def canonical_edges(edges: DataFrame) -> DataFrame:
    line = F.to_json(F.struct(F.col("dst"), F.lit("{}").alias("props"), F.col("etype").alias("rel"), F.col("src")))
    return edges.select("src", F.col("etype").alias("rel"), "dst", line.alias("line"))


def content_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row that tells two stored graphs apart, whatever the order of their rows: counts, and for the
    canonical lines the exclusive or and the sum of their hashes."""

    def digest(lines: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64("line")
        return lines.agg(
            F.count(F.lit(1)).alias(f"{name}_count"),
            F.coalesce(F.bit_xor(h), F.lit(0)).alias(f"{name}_xor"),
            F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"{name}_sum"),
        )

    both = digest(nodes, "node").crossJoin(digest(edges, "edge"))  # two single rows
    return both.withColumn("graph_hash", F.sha2(F.concat_ws("|", *both.columns), 256))


def leaf_hashes(rows: DataFrame, key: str = "uid", line: str = "line", *, depth: int = 3) -> DataFrame:
    """``(prefix, n, hash)`` of each range of keys: rows whose key's MD5 begins with ``prefix``, ``depth`` hex digits.

    The hash is of the number of lines and of two sums of 60 bits of their MD5, so it depends on the rows as
    a multiset, in any order, and is combined on the map side, however many rows a key has. Null keys and
    lines differ from empty ones. Depths of 3 to 6 suit 4,096 to 16 million ranges.
    """
    digest = lambda c: F.md5(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")).cast("binary"))
    bits = lambda at: F.conv(F.substring("_m", at, 15), 16, 10).cast("decimal(38,0)")
    hashed = rows.select(F.substring(digest(key), 1, depth).alias("prefix"), digest(line).alias("_m"))
    summed = hashed.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.sum(bits(1)).alias("_s"), F.sum(bits(16)).alias("_t"))
    return summed.select("prefix", "n", F.md5(F.concat_ws(":", "n", "_s", "_t").cast("binary")).alias("hash"))


def parent_hashes(children: DataFrame) -> DataFrame:
    """One level up the tree: ranges a hex digit shorter, hashed from their children, at most 16, in order."""
    entry = F.struct("prefix", F.concat_ws(":", "prefix", "hash").alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["line"]), ",")
    up = F.expr("left(prefix, length(prefix) - 1)").alias("_up")
    return children.groupBy(up).agg(F.sum("n").alias("n"), F.md5(joined.cast("binary")).alias("hash")).withColumnRenamed("_up", "prefix")


def root_hash(rows: DataFrame, key: str = "uid", line: str = "line", *, depth: int = 3) -> DataFrame:
    """``(n, hash)`` of a whole table, one row: equal for tables that hold the same lines equally often. No
    rows give n = 0 and the MD5 of the empty text."""
    level = leaf_hashes(rows, key, line, depth=depth)
    for _ in range(depth):
        level = parent_hashes(level)
    return level.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("hash"), F.md5(F.lit("").cast("binary"))).alias("hash"))


def differing_ranges(a: DataFrame, b: DataFrame, key: str = "uid", line: str = "line", *, depth: int = 3) -> DataFrame:
    """``(prefix, n_a, n_b)`` of the ranges of keys where two tables differ; only hashes of ranges meet."""
    side = lambda df, x: leaf_hashes(df, key, line, depth=depth).select("prefix", F.col("n").alias(f"n_{x}"), F.col("hash").alias(f"_{x}"))
    met = side(a, "a").join(side(b, "b"), "prefix", "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return met.select("prefix", *[F.coalesce(f"n_{x}", F.lit(0)).alias(f"n_{x}") for x in "ab"])
