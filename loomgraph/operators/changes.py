"""Snapshot differences and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.scratch import stored

OPS = ("added", "removed", "modified")
EDGE_KEY = ("src", "src_label", "etype", "dst", "dst_label")


def _diff(current: DataFrame, previous: DataFrame, keys: list[str], changed: Column) -> DataFrame:
    """Full outer join on the keys; ``changed`` compares ``_new`` and ``_old``."""
    a = current.where(F.col("uid").isNotNull()).select(*keys, F.lit(True).alias("_in_new"), F.col("_mark").alias("_new"))
    b = previous.where(F.col("uid").isNotNull()).select(*keys, F.lit(True).alias("_in_old"), F.col("_mark").alias("_old"))
    op = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(changed, "modified")
    return a.join(b, keys, "full_outer").select(*keys, op.alias("op")).where(F.col("op").isNotNull())


def snapshot_diff(current: DataFrame, previous: DataFrame, *, kind_col: str = "kind") -> DataFrame:
    """``(kind, uid, op)`` by uid within each kind: modified where the resource version differs. Rows without
    uid are ignored. Both frames need ``kind``, ``uid`` and ``resource_version``."""
    mark = lambda df: df.withColumn("_mark", F.col("resource_version"))
    return _diff(mark(current), mark(previous), [kind_col, "uid"], ~F.col("_new").eqNullSafe(F.col("_old")))


def diff_summary(diff: DataFrame, *, kind_col: str = "kind") -> DataFrame:
    """Per kind with changes the number of each operation."""
    counts = [F.count_if(F.col("op") == x).alias(x) for x in OPS]
    return diff.groupBy(kind_col).agg(*counts)


def node_diff(current: DataFrame, previous: DataFrame, *, observed_labels: list[str] | None = None) -> DataFrame:
    """``(label, uid, op)`` over all nodes of a graph, each uid once.

    The resource version decides for observed labels (all that have one, by default); derived nodes are
    compared by their content, of which only a hash is shuffled. ``props`` is a JSON text column.
    """
    found = node_changes(current, previous, observed_labels=observed_labels)
    return found.select(F.greatest("now", "was").alias("label"), "uid", "op")


def _mark(current: DataFrame, previous: DataFrame, observed_labels: list[str] | None = None) -> Column:
    """What tells two versions of a node apart."""
    by_version = F.col("label").isin(*observed_labels) if observed_labels else F.col("resource_version").isNotNull()
    more = ["typed"] if "typed" in current.columns and "typed" in previous.columns else []
    content = F.xxhash64("name", "namespace", "props", *more).cast("string")
    return F.when(by_version, F.concat(F.lit("v"), F.coalesce("resource_version", F.lit("")))).otherwise(F.concat(F.lit("h"), content))


def node_changes(current: DataFrame, previous: DataFrame, *, observed_labels: list[str] | None = None) -> DataFrame:
    """``node_diff`` with the label that each version gives a node: ``(now, was, uid, op)``."""
    mark = _mark(current, previous, observed_labels)
    side = lambda df, as_: df.where(F.col("uid").isNotNull()).select("uid", F.struct("label", mark.alias("mark")).alias(as_))
    found = side(current, "_new").join(side(previous, "_old"), "uid", "full_outer")
    op = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_new.mark") != F.col("_old.mark"), "modified")
    return found.select(F.col("_new.label").alias("now"), F.col("_old.label").alias("was"), "uid", op.alias("op")).where(F.col("op").isNotNull())


def edge_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The edges of either version that the other lacks, with ``op``."""
    keys = [k for k in EDGE_KEY if k in current.columns]
    a, b = current.select(*keys).distinct(), previous.select(*keys).distinct()
    return (
        a.join(b, keys, "left_anti").withColumn("op", F.lit("added"))
        .unionByName(b.join(a, keys, "left_anti").withColumn("op", F.lit("removed")))
    )


#: Ranges of hashes that the rows of a label or triple are compared by before any of them meet.
RANGES = 1024
NODE_GROUP, EDGE_GROUP = ("label",), ("src_label", "etype", "dst_label")


def group_text(names: list[str | None]) -> str:
    return "\x1f".join("\x00" if x is None else x for x in names)


def group_of(columns: tuple[str, ...]) -> Column:
    """A row's label or triple as ``group_text``; it chooses folders where tables are partitioned by the columns."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("\x00")) for c in columns])


def _narrowed(current: DataFrame, previous: DataFrame, by: tuple[str, ...], key: list[str], more: list[Column], store: str) -> tuple[DataFrame, DataFrame]:
    """Both frames without the ranges of a label or triple in which they hold the same rows equally often.

    A range, of hashes of ``key``, is judged by the number of its rows and the sums of two 64-bit hashes of their key and ``more``, which are
    combined on the map side, so nothing is shuffled for what didn't change. The ranges, at most ``RANGES`` for each label
    or triple, are written to ``store``; only names of labels and triples come to the driver.
    """
    hashed = lambda seed, *of: F.xxhash64(F.lit(seed), *[x for c in of for x in (c.isNull(), c)])  # noqa: E731  a hash passes nulls over
    of_key = [F.col(c) for c in key]
    place = F.pmod(hashed(0, *of_key), F.lit(RANGES)).cast("int")
    met_by = [f"_by{i}" for i in range(len(by))] + ["_range"]

    def digest(df: DataFrame, as_: str) -> DataFrame:
        rows = df.select(*[F.coalesce(c, F.lit("\x00")).alias(f"_by{i}") for i, c in enumerate(by)], place.alias("_range"), *[hashed(i, *of_key, *more).alias(f"_h{i}") for i in (0, 1)])
        halves = [half for h in ("_h0", "_h1") for half in (F.shiftright(h, 32), F.col(h).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))]
        summed = rows.groupBy(*met_by).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(x).alias(f"_s{i}") for i, x in enumerate(halves)])
        return summed.select(*met_by, F.struct("_n", *[f"_s{i}" for i in range(len(halves))]).alias(as_))

    met = digest(current, "_a").join(digest(previous, "_b"), met_by, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    ranges = stored(met.select(F.concat_ws("\x1f", *met_by[:-1]).alias("_group"), "_range"), store)
    names = [r[0] for r in ranges.select("_group").distinct().collect()]  # labels or triples
    same = (group_of(by) == F.col("_group")) & (place == F.col("_range"))
    left = lambda df: df.where(group_of(by).isin(names)).join(F.broadcast(ranges), same, "left_semi")
    return left(current), left(previous)


def changed_edges(current: DataFrame, previous: DataFrame, store: str) -> tuple[DataFrame, DataFrame]:
    """The edges of both versions without ranges that are the same."""
    return _narrowed(current.select(*EDGE_KEY), previous.select(*EDGE_KEY), EDGE_GROUP, ["src", "dst"], [], store)


def is_empty(node_changes: DataFrame, edge_changes: DataFrame) -> bool:
    return node_changes.isEmpty() and edge_changes.isEmpty()


def apply_diff(
    nodes: DataFrame, edges: DataFrame, node_changes: DataFrame, new_nodes: DataFrame, edge_changes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The next version of (nodes, edges).

    Removed edges go first, then removed nodes with all their edges, then added and modified nodes come in
    from ``new_nodes``, then added edges; an edge that is there stays one.
    """
    gone = node_changes.where(F.col("op") != "added").select("uid")
    come = node_changes.where(F.col("op") != "removed").select("uid")
    kept = nodes.join(gone, "uid", "left_anti")
    next_nodes = kept.unionByName(new_nodes.join(come, "uid", "left_semi").select(*nodes.columns))
    keys = [k for k in EDGE_KEY if k in edges.columns]
    dead = node_changes.where(F.col("op") == "removed").select("uid")
    left = edges.select(*keys).join(edge_changes.where(F.col("op") == "removed").select(*keys), keys, "left_anti")
    for end in ("src", "dst"):
        left = left.join(dead.withColumnRenamed("uid", end), end, "left_anti").select(*keys)
    next_edges = left.unionByName(edge_changes.where(F.col("op") == "added").select(*keys)).distinct()
    return next_nodes, next_edges
