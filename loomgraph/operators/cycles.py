"""Triangles of the undirected graph behind an edge table, with rows bounded on hubs."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.scratch import stored


def ranked_pairs(edges: DataFrame, store: str) -> DataFrame:
    """``(low, high, high_degree)``: every pair of different nodes with an edge in either direction, once, from
    the node of fewer neighbours to that of more; ids decide ties. Pairs with a node of no other neighbour, which is
    in no triangle, are left out.

    A node is ``low`` in at most the root of twice the number of pairs, however many neighbours it has, as
    each of those ``high`` has as many neighbours as it at least. Pairs and degrees are written below ``store``,
    so that the joins with them, where a hub is a hot key, can be split.
    """
    several = edges.where(F.col("src") != F.col("dst"))  # null ends go too
    pairs = stored(several.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), f"{store}/pairs")
    degrees = stored(pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d")).where("d > 1"), f"{store}/degrees")
    of = lambda end: degrees.select(F.col("v").alias(end), F.struct(F.col("d"), F.col("v")).alias(f"_{end}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    low, high = F.least("_a", "_b"), F.greatest("_a", "_b")
    return stored(met.select(low["v"].alias("low"), high["v"].alias("high"), high["d"].alias("high_degree")), f"{store}/ranked")


def closed_triples(pairs: set[tuple[str, str]]) -> set[tuple[str, str, str]]:
    """All ``(x, y, z)``, in any order, of kinds that are joined pairwise: the kinds that the corners of a triangle can have."""
    both = pairs | {(y, x) for x, y in pairs}
    kinds = {x for x, _ in both}
    return {(x, y, z) for x, y in both for z in kinds if (x, z) in both and (y, z) in both}


@dataclass
class Wedges:
    """Two edges that meet in their lowest node, ``(a, ka, b, kb, c, kc)``, and the edges ``(b, kb, c, kc)`` that may close
    them; kinds are numbers of ``kinds``."""

    open_: DataFrame
    closing: DataFrame
    kinds: list[str]
    triples: set[tuple[int, int, int]]


def wedges(edges: DataFrame, store: str) -> Wedges:
    """Of edges ``(src, dst)``, with ``src_kind`` and ``dst_kind`` if a node's kind is known; there are few kinds.

    Nodes are ordered by whether they are hubs, with more edges than the root of the number of ends, among those by their
    edges, else by kind, those of few edges first, and id. So a node is the lowest of as many edges as that root at most: a hub
    that all nodes touch is never where two edges meet. There are no more hubs than that root, so they are broadcast, and no
    other node's degree is met with the edges. Hubs are counted among the nodes whose range of hashes has as many ends.

    Which kinds meet says what an edge can be for: one that no three kinds close is left out, and one whose lower end can't
    be the lowest corner, or can't be another, isn't shuffled for that. Edges are written below ``store``, each as it comes.
    """
    known = "src_kind" in edges.columns
    kind = lambda end: (F.col(f"{end}_kind") if known else F.lit("")).alias(f"{end}_kind")
    pairs = stored(edges.where(F.col("src") != F.col("dst")).select("src", kind("src"), "dst", kind("dst")), f"{store}/pairs", compression="zstd")  # null ends go too
    ends = pairs.select(F.col("src").alias("v"), F.col("src_kind").alias("k")).unionAll(pairs.select("dst", "dst_kind"))
    root = max(1, math.isqrt(2 * pairs.count()))
    place = F.pmod(F.xxhash64("v"), F.lit(4 * root))
    full = ends.groupBy(place.alias("_place")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > root)
    counted = ends.join(F.broadcast(full), place == F.col("_place"), "left_semi").groupBy("v", "k").agg(F.count(F.lit(1)).alias("d"))
    hubs = stored(counted.where(F.col("d") > root), f"{store}/hubs")

    per_kind = ends.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("v").alias("d")).collect()  # a row per kind
    kinds = [r["k"] for r in sorted(per_kind, key=lambda r: (r["n"] / max(r["d"], 1), r["k"]))]
    number, size = {k: i for i, k in enumerate(kinds)}, len(kinds)
    met = pairs.select("src_kind", "dst_kind").distinct().collect()  # kinds
    triples = closed_triples({(number[x], number[y]) for x, y in met})
    with_hubs = {number[r[0]] for r in hubs.select("k").distinct().collect()}  # kinds

    of = lambda end: hubs.select(F.col("v").alias(end), F.col("k").alias(f"{end}_kind"), F.col("d").alias(f"_{end}"))
    rows = pairs
    for end in ("src", "dst"):
        rows = rows.join(F.broadcast(of(end)), [end, f"{end}_kind"], "left")
    numbers = F.create_map(*[F.lit(x) for k, i in number.items() for x in (k, i)]) if kinds else F.lit(None).cast("map<string,int>")
    node = lambda end: F.struct(F.coalesce(f"_{end}", F.lit(0)).alias("d"), numbers[F.col(f"{end}_kind")].alias("k"), F.col(end).alias("v"))
    ranked = rows.select(F.least(node("src"), node("dst")).alias("x"), F.greatest(node("src"), node("dst")).alias("y"))
    ranked = ranked.select(F.col("x.v").alias("low"), F.col("x.k").alias("kl"), F.col("x.d").alias("dl"), F.col("y.v").alias("high"), F.col("y.k").alias("kh"), F.col("y.d").alias("dh"))

    def among(light: set, hub: set) -> Column:
        """Kinds of edges for a lower end that is a hub or not."""
        code = F.col("kl") * size + F.col("kh")
        of = lambda some: code.isin([x * size + y for x, y in some])
        return F.when(F.col("dl") == 0, of(light)).otherwise(of(hub))

    arm = among({(x, y) for x, y, z in triples if z >= x or z in with_hubs}, {(x, y) for x, y, z in triples if z in with_hubs})
    close = among({(x, y) for x, y, z in triples if z <= x}, {(x, y) for x, y, _ in triples})
    # an edge that comes again meets itself in its lower end's task, so ends are shuffled once; a node has few arms, so a list holds them
    arms = ranked.where(arm).select(F.col("low").alias("a"), F.col("kl").alias("ka"), "dh", "kh", "high").repartition("a").distinct()
    met_at = arms.groupBy("a", "ka").agg(F.collect_list(F.struct("dh", "kh", "high")).alias("_all")).where(F.size("_all") > 1)
    one = met_at.select("a", "ka", "_all", F.explode("_all").alias("_b"))
    code = (F.col("ka") * size + F.col("_b.kh")) * size + F.col("_c.kh")
    open_ = one.select("a", "ka", "_b", F.explode(F.filter("_all", lambda x: x > F.col("_b"))).alias("_c")).where(code.isin([(x * size + y) * size + z for x, y, z in triples]))
    open_ = open_.select("a", "ka", F.col("_b.high").alias("b"), F.col("_b.kh").alias("kb"), F.col("_c.high").alias("c"), F.col("_c.kh").alias("kc"))
    closing = ranked.where(close).select(F.col("low").alias("b"), F.col("kl").alias("kb"), F.col("high").alias("c"), F.col("kh").alias("kc"))
    return Wedges(open_, closing, kinds, triples)


def triangles(edges: DataFrame, store: str) -> DataFrame:
    """``(a, b, c)``: each three nodes that are joined pairwise by edges of any direction and type, once, in the order of
    ``wedges``. Loops and edges with a null end count for nothing, repeated edges once.

    At most the power of 3/2 of the number of edges is looked at.
    """
    found = wedges(edges, store)
    return found.open_.join(found.closing, ["b", "c"], "left_semi").select("a", "b", "c")


def triangles_by_kind(edges: DataFrame, store: str) -> DataFrame:
    """``(kinds, n)``: the number of triangles by their corners' kinds in order. Pairs of edges are counted by their ends
    before these meet the edge that closes them, so no triangle is listed."""
    found = wedges(edges, store)
    keys = ["b", "kb", "c", "kc", "ka"]
    counted = found.open_.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    size = len(found.kinds)
    code = F.col("kb") * size + F.col("kc")
    lowest = [F.when(code.isin([y * size + z for x, y, z in found.triples if x == i]), F.lit(i)) for i in range(size)]
    closing = found.closing.withColumn("ka", F.explode(F.array_compact(F.array(*lowest).cast("array<int>"))))
    per_kind = counted.join(closing, keys, "left_semi").groupBy("ka", "kb", "kc").agg(F.sum("n").alias("n"))
    name = F.array(*[F.lit(k) for k in found.kinds]).cast("array<string>")
    corners = F.array_sort(F.array(*[F.get(name, F.col(c)) for c in ("ka", "kb", "kc")]))
    return per_kind.groupBy(corners.alias("kinds")).agg(F.sum("n").alias("n"))


def triangle_counts(edges: DataFrame, store: str) -> DataFrame:
    """``(uid, triangles)`` of the nodes that are in one."""
    corners = triangles(edges, store).select(F.explode(F.array("a", "b", "c")).alias("uid"))
    return corners.groupBy("uid").agg(F.count(F.lit(1)).alias("triangles"))
