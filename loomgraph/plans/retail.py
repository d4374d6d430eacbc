"""The retail tables as a property graph, and named queries over it with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import exprs as X
from loomgraph.operators import changes, edges, metrics, nodes, quality
from loomgraph.operators.match import Hop, Node, Rows, collect
from loomgraph.operators.model import Graph, triples_frame
from loomgraph.sources import sinks
from loomgraph.sources.scratch import scratch, scratch_dir, stored
from loomgraph.sources.snapshot import ORDINAL
from loomgraph.streaming.refresh import GraphStore

TRIPLES = (
    ("Nation", "PartOf", "Region"),
    ("Customer", "BelongsTo", "Nation"),
    ("Supplier", "BelongsTo", "Nation"),
    ("Customer", "Manages", "Order"),
    ("Order", "Contains", "Part"),
    ("Supplier", "Supplies", "Part"),
    ("Event", "Concerns", "Customer"),
)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query(sql: str | None = None, *, text_ids: bool = False):
    """Register a query over the graph with numbers for ids, or with texts, for what is stored or shown by id."""

    def register(f):
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: f(retail_graph(spark, sf_dir, text_ids=text_ids))
        if sql:
            _SQL[name] = sql
        return f

    return register


#: The label's number stands in the last bits of a numeric id.
LABEL_BITS = 3
LABEL_NUMBERS = {"Region": 0, "Nation": 1, "Customer": 2, "Supplier": 3, "Part": 4, "Order": 5, "Event": 6}


def text_id(label: str, key: str) -> Column:
    return F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))


def number_id(label: str, key: str) -> Column:
    """One long that no node of another label has: joins hash and shuffle it instead of a text."""
    return F.shiftleft(F.col(key).cast("long"), LABEL_BITS) + F.lit(LABEL_NUMBERS[label]).cast("long")


def retail_graph(spark: SparkSession, sf_dir: str, *, text_ids: bool = False) -> Graph:
    uid = text_id if text_ids else number_id
    t = {x: spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in "region nation customer supplier part orders lineitem events".split()}

    def table_of(label: str, table: str, key: str, name: str | None, namespace: Column | None = None, **props: str) -> DataFrame:
        none = F.lit(None).cast("string")
        return t[table].select(
            uid(label, key).alias("uid"),
            (F.col(name) if name else F.col(key).cast("string")).alias("name"),
            (none if namespace is None else namespace).alias("namespace"),
            none.alias("resource_version"),
            *[F.col(c).alias(p) for p, c in props.items()],
        )

    t["nation"] = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    node_tables = {
        "Region": table_of("Region", "region", "r_regionkey", "r_name"),
        "Nation": table_of("Nation", "nation", "n_nationkey", "n_name", F.col("r_name")),
        "Customer": table_of("Customer", "customer", "c_custkey", "c_name", acctbal="c_acctbal", segment="c_mktsegment"),
        "Supplier": table_of("Supplier", "supplier", "s_suppkey", "s_name", acctbal="s_acctbal"),
        "Part": table_of("Part", "part", "p_partkey", "p_name", brand="p_brand", type="p_type", size="p_size", price="p_retailprice"),
        "Order": table_of("Order", "orders", "o_orderkey", None, status="o_orderstatus", totalprice="o_totalprice", date="o_orderdate", priority="o_orderpriority"),
        "Event": table_of("Event", "events", "event_id", None, ts="ts", type="event_type", value="value", props="props"),
    }

    def link(table: str, src: Column, dst: Column) -> DataFrame:
        return t[table].select(src.alias("src"), dst.alias("dst"))

    # line items repeat pairs: one edge per pair. Distinct on the long keys, before the ids become text.
    pairs = lambda a, b: t["lineitem"].select(a, b).distinct()
    edge_tables = {
        TRIPLES[0]: link("nation", uid("Nation", "n_nationkey"), uid("Region", "n_regionkey")),
        TRIPLES[1]: link("customer", uid("Customer", "c_custkey"), uid("Nation", "c_nationkey")),
        TRIPLES[2]: link("supplier", uid("Supplier", "s_suppkey"), uid("Nation", "s_nationkey")),
        TRIPLES[3]: link("orders", uid("Customer", "o_custkey"), uid("Order", "o_orderkey")),
        TRIPLES[4]: pairs("l_orderkey", "l_partkey").select(uid("Order", "l_orderkey").alias("src"), uid("Part", "l_partkey").alias("dst")),
        TRIPLES[5]: pairs("l_suppkey", "l_partkey").select(uid("Supplier", "l_suppkey").alias("src"), uid("Part", "l_partkey").alias("dst")),
        TRIPLES[6]: link("events", uid("Event", "event_id"), uid("Customer", "user_id")),
    }
    return Graph(node_tables, edge_tables)


def key_of(v) -> Column:
    """The table's key in a node's numeric id."""
    return F.shiftright(v["uid"], LABEL_BITS)


def rows_counted() -> dict[str, Column]:
    return {"n": F.count(F.lit(1))}


ORDERS = "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem"


# ---- scans and hops --------------------------------------------------------------------------------------


@query("SELECT n_name AS nation, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey "
       "JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY orders DESC, nation LIMIT 5")
def q_topk_nations(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("o", "Order"), Hop("Manages", "in"), Node("c", "Customer"), Hop("BelongsTo"), Node("n", "Nation"))
    return rows.returns(lambda v: {"nation": v.n["name"]}, {"orders": F.count(F.lit(1))}, order_by=[F.desc("orders"), F.asc("nation")], limit=5)


@query("SELECT count(*) AS n FROM customer")
def q_label_scan_count(g: Graph) -> DataFrame:
    return Rows(g).match(Node("c", "Customer")).returns(aggs=rows_counted())


@query(" UNION ALL ".join(f"SELECT '{x}' AS label, count(*) AS n FROM {t}" for x, t in (("Region", "region"), ("Nation", "nation"),
       ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders"), ("Event", "events"))))
def q_full_scan_by_label(g: Graph) -> DataFrame:
    return metrics.label_counts(g)


@query("SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_hop_out(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("c", "Customer"), Hop("BelongsTo"), Node("n", "Nation"))
    return rows.returns(lambda v: {"customer": v.c["name"], "nation": v.n["name"]})


@query("SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey "
       "UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def q_hop_out_all(g: Graph) -> DataFrame:
    """A first node without label: every label that the hop allows."""
    rows = Rows(g).match(Node("c"), Hop("BelongsTo"), Node("n", "Nation"))
    return rows.returns(lambda v: {"customer": v.c["name"], "nation": v.n["name"]})


@query("SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def q_hop_in(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("o", "Order"), Hop("manages", "in"), Node("c", "Customer"))
    return rows.returns(lambda v: {"segment": v.c["segment"], "status": v.o["status"]}, rows_counted())


@query("WITH b AS (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier), "
       "u AS (SELECT 'Nation:' || k AS a FROM b UNION ALL SELECT 'Customer:' || c_custkey FROM customer "
       "UNION ALL SELECT 'Supplier:' || s_suppkey FROM supplier) SELECT count(*) AS n, count(DISTINCT a) AS ends FROM u")
def q_hop_both(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("a"), Hop("BelongsTo", "both"), Node("b"))
    return rows.returns(aggs=lambda v: {**rows_counted(), "ends": F.count_distinct(v.a["uid"])})


@query("SELECT 'BelongsTo' AS type, 'Customer' AS source_type, 'Nation' AS target_type, count(*) AS n FROM customer "
       "UNION ALL SELECT 'Manages', 'Customer', 'Order', count(*) FROM orders")
def q_untyped_hop(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("c", "Customer"), Hop(var="r"), Node())
    return rows.returns(lambda v: {k: v.r[k] for k in ("type", "source_type", "target_type")}, rows_counted())


@query("SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey "
       "JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
def q_path3_region_orders(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("r", "Region"), Hop("PartOf", "in"), Node(label="Nation"), Hop("BelongsTo", "in"),
                         Node(label="Customer"), Hop("Manages"), Node("o", "Order"))
    return rows.returns(lambda v: {"region": v.r["name"]}, rows_counted())


@query(f"WITH e AS ({ORDERS}) SELECT o_custkey AS customer, count(*) AS n FROM e JOIN part ON l_partkey = p_partkey "
       "JOIN orders ON l_orderkey = o_orderkey WHERE p_size = 7 AND o_orderstatus = 'O' GROUP BY o_custkey")
def q_shared_part_customers(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("o", "Order"), Hop("Contains"), Node("p", "Part"), where=lambda v: v.p["size"] == 7)
    rows = rows.match(Node("c", "Customer"), Hop("Manages"), Node("o"), where=lambda v: v.o["status"] == "O")
    return rows.returns(lambda v: {"customer": key_of(v.c)}, rows_counted())


@query(f"WITH e AS ({ORDERS}) SELECT a.l_partkey AS part, count(*) AS pairs FROM e a JOIN e b ON a.l_partkey = b.l_partkey "
       "AND a.l_orderkey <> b.l_orderkey GROUP BY a.l_partkey")
def q_unique_edges(g: Graph) -> DataFrame:
    # pairs of different edges into a part are only counted, so their number follows from that of the edges
    rows = Rows(g).match(Node(label="Order"), Hop("Contains"), Node("p", "Part"))
    rows = rows.with_(lambda v: {"part": key_of(v.p)}, rows_counted(), where=lambda v: F.col("n") > 1)
    return rows.returns({"part": F.col("part"), "pairs": F.col("n") * (F.col("n") - 1)})


@query("SELECT a.o_custkey AS customer, count(*) AS pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey "
       "WHERE a.o_orderstatus = 'P' GROUP BY a.o_custkey")
def q_unique_edges_path(g: Graph) -> DataFrame:
    """Out to a customer and back by another edge than the one that led there."""
    rows = Rows(g).match(Node("a", "Order"), Hop("Manages", "in"), Node("c", "Customer"), Hop("Manages"), Node(label="Order"),
                         where=lambda v: v.a["status"] == "P", unique_edges=True)
    return rows.returns(lambda v: {"customer": key_of(v.c)}, {"pairs": F.count(F.lit(1))})


@query("SELECT c_name AS customer, s_name AS supplier FROM customer, supplier WHERE c_custkey = s_suppkey")
def q_cross_match(g: Graph) -> DataFrame:
    """Two patterns that share no variable; the condition relates them, so Catalyst makes an equi-join of it."""
    rows = Rows(g).match(Node("c", "Customer")).match(Node("s", "Supplier"), where=lambda v: key_of(v.c) == key_of(v.s), allow_cross=True)
    return rows.returns(lambda v: {"customer": v.c["name"], "supplier": v.s["name"]})


@query("SELECT c_custkey AS customer FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey "
       "JOIN part ON l_partkey = p_partkey WHERE o_custkey = c_custkey)")
def q_first_match(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("c", "Customer")).match(Node("c"), Hop("Manages"), Node(label="Order"), Hop("Contains"), Node(label="Part"))
    return rows.returns(lambda v: {"customer": key_of(v.c)})


@query("SELECT count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON c_nationkey = n_nationkey")
def q_cycle_close(g: Graph) -> DataFrame:
    """Customers and suppliers that meet in a nation, closing on the customer again. They are only counted, so
    the number of pairs follows from those of either side."""

    def per_nation(label: str, n: str) -> Rows:
        rows = Rows(g).match(Node("x", label), Hop("BelongsTo"), Node("n", "Nation")).match(Node("x"), Hop("BelongsTo"), Node("n"))
        return rows.with_(lambda v: {f"{n}_nation": v.n["uid"]}, {n: F.count(F.lit(1))})

    both = per_nation("Customer", "customers").df.join(per_nation("Supplier", "suppliers").df, F.col("customers_nation") == F.col("suppliers_nation"))
    return both.agg(F.coalesce(F.sum(F.col("customers") * F.col("suppliers")), F.lit(0)).alias("n"))


@query(f"WITH e AS ({ORDERS}), f AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT c_custkey AS customer, count(*) AS n FROM customer "
       "JOIN orders ON o_custkey = c_custkey JOIN e ON e.l_orderkey = o_orderkey JOIN part ON e.l_partkey = p_partkey JOIN f ON f.l_partkey = p_partkey "
       "JOIN supplier ON f.l_suppkey = s_suppkey AND s_nationkey = c_nationkey GROUP BY c_custkey")
def q_cycle_close_all(g: Graph) -> DataFrame:
    """Customer, order, part, supplier, nation and back to the customer, over all rows."""
    rows = Rows(g).match(Node("n", "Nation"), Hop("BelongsTo", "in"), Node("c", "Customer"), Hop("Manages"), Node(label="Order"), Hop("Contains"), Node("p", "Part"))
    rows = rows.match(Node("p"), Hop("Supplies", "in"), Node("s", "Supplier"), Hop("BelongsTo"), Node("n"))
    return rows.returns(lambda v: {"customer": key_of(v.c)}, rows_counted())


@query("SELECT c_custkey AS customer, o_orderkey AS orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000")
def q_bound_relationship(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("c", "Customer"), Hop("Manages", var="r"), Node("o", "Order"), where=lambda v: v.o["totalprice"] > 400000)
    rows = rows.match(Node("c"), Hop("Manages", var="r"), Node("o"))
    return rows.returns(lambda v: {"customer": key_of(v.c), "orderkey": key_of(v.o)})


# ---- optional, exists ------------------------------------------------------------------------------------


@query(f"WITH e AS ({ORDERS}) SELECT o_orderkey AS orderkey, count(l_partkey) AS parts FROM orders LEFT JOIN e ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def q_optional_orders_parts(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("o", "Order")).match(Node("o"), Hop("Contains"), Node("p", "Part"), optional=True)
    return rows.returns(lambda v: {"orderkey": v.o["name"].cast("long")}, lambda v: {"parts": F.count(v.p["uid"])})


def _optional_where(g: Graph, compat: bool) -> DataFrame:
    rows = Rows(g, compat=compat).match(Node("o", "Order"))
    rows = rows.match(Node("o"), Hop("Contains"), Node("p", "Part"), optional=True, where=lambda v: v.p["size"] > 45)
    return rows.returns(lambda v: {"status": v.o["status"]}, lambda v: {"orders": F.count_distinct(v.o["uid"]), "parts": F.count(v.p["uid"])})


@query(f"WITH e AS ({ORDERS}), p AS (SELECT * FROM e JOIN part ON l_partkey = p_partkey WHERE p_size > 45) SELECT o_orderstatus AS status, "
       "count(DISTINCT o_orderkey) AS orders, count(p_partkey) AS parts FROM orders LEFT JOIN p ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def q_optional_where(g: Graph) -> DataFrame:
    return _optional_where(g, False)


@query(f"WITH e AS ({ORDERS}) SELECT o_orderstatus AS status, count(DISTINCT o_orderkey) AS orders, count(p_partkey) AS parts FROM orders "
       "LEFT JOIN e ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey WHERE p_size > 45 GROUP BY o_orderstatus")
def q_optional_where_compat(g: Graph) -> DataFrame:
    return _optional_where(g, True)


@query("SELECT c_custkey AS customer FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40 AND o_orderstatus = 'F')")
def q_exists_where(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("c", "Customer")).exists(
        Node("c"), Hop("Manages"), Node("o", "Order"), where=lambda v: (v.o["totalprice"] > v.c["acctbal"] * 40) & (v.o["status"] == "F")
    )
    return rows.returns(lambda v: {"customer": key_of(v.c)})


@query("SELECT o_orderkey AS orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q_not_exists(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("o", "Order")).not_exists(Node("o"), Hop("Contains"), Node(label="Part"))
    return rows.returns(lambda v: {"orderkey": v.o["name"].cast("long")})


@query("SELECT there, count(*) AS n FROM (SELECT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS there FROM orders) GROUP BY there")
def q_exists_flag(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("o", "Order")).exists_flag("there", Node("o"), Hop("Contains"), Node(label="Part"))
    return rows.returns(lambda v: {"there": F.col("there")}, rows_counted())


@query("SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = c_custkey AND p_retailprice < 0.3 * c_acctbal)")
def q_exists_node(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("c", "Customer"))
    rows = rows.exists(Node("p", "Part"), where=lambda v: (key_of(v.p) == key_of(v.c)) & (v.p["price"] < 0.3 * v.c["acctbal"]))
    return rows.returns(aggs=rows_counted())


@query("SELECT c_custkey AS customer, c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50) AS there FROM customer")
def q_exists_outer(g: Graph) -> DataFrame:
    """EXISTS with an outer variable inside a larger boolean expression."""
    rows = Rows(g).match(Node("c", "Customer")).exists_flag(
        "_there", Node("c"), Hop("Manages"), Node("o", "Order"), where=lambda v: v.o["totalprice"] > v.c["acctbal"] * 50, outer=True
    )
    return rows.returns(lambda v: {"customer": key_of(v.c), "there": (v.c["acctbal"] < 0) | F.col("_there")})


@query("SELECT c_custkey AS customer, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 450000 GROUP BY c_custkey")
def q_bound_recheck(g: Graph) -> DataFrame:
    """A variable that an optional part left null is bound no more: the node is asked for again."""
    rows = Rows(g).match(Node("c", "Customer"))
    rows = rows.match(Node("c"), Hop("Manages"), Node("o", "Order"), optional=True, where=lambda v: v.o["totalprice"] > 450000)
    return rows.match(Node("o", "Order")).returns(lambda v: {"customer": key_of(v.c)}, rows_counted())


@query("SELECT 'Customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Order', count(*) FROM orders")
def q_label_or(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("n")).where(lambda v: v.n["label"].isin("Customer", "Order"))
    return rows.returns(lambda v: {"label": v.n["label"]}, rows_counted())


# ---- clauses and aggregation -----------------------------------------------------------------------------


@query("SELECT c_name AS customer, x FROM customer, (SELECT unnest([1, 2, 3]) AS x)")
def q_unwind_literal(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("c", "Customer")).unwind(F.array(F.lit(1), F.lit(2), F.lit(3)), "x")
    return rows.returns(lambda v: {"customer": v.c["name"], "x": F.col("x")})


@query("SELECT DISTINCT n_name AS nation, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_unwind_collect(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("c", "Customer"), Hop("BelongsTo"), Node("n", "Nation"))
    rows = rows.with_(lambda v: {"nation": v.n["name"], "segment": v.c["segment"]}, distinct=True)  # a few segments each
    rows = rows.with_({"nation": F.col("nation")}, {"segments": collect(F.col("segment"), F.col("segment"))})
    return rows.unwind(F.col("segments"), "segment").returns({"nation": F.col("nation"), "segment": F.col("segment")})


@query("SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > (SELECT count(*) / 25 FROM customer)")
def q_with_having(g: Graph) -> DataFrame:
    mean = Rows(g).match(Node("c", "Customer")).with_(aggs={"mean": F.count(F.lit(1)) / 25})
    rows = Rows(g).match(Node("c", "Customer"), Hop("BelongsTo"), Node("n", "Nation")).with_(lambda v: {"nation": v.n["name"]}, rows_counted())
    both = rows.df.crossJoin(F.broadcast(mean.df))
    return Rows(g, both, (*rows.variables, *mean.variables)).where(F.col("n") > F.col("mean")).returns({"nation": F.col("nation"), "n": F.col("n")})


def _limit_where(g: Graph, compat: bool) -> DataFrame:
    rows = Rows(g, compat=compat).match(Node("o", "Order"))
    rows = rows.with_(lambda v: {"orderkey": v.o["name"].cast("long"), "price": v.o["totalprice"]},
                      order_by=[F.desc("price"), F.asc("orderkey")], limit=40, where=lambda v: F.col("orderkey") % 2 == 0)
    return rows.returns({"orderkey": F.col("orderkey")})


@query("SELECT orderkey FROM (SELECT o_orderkey AS orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40) WHERE orderkey % 2 = 0")
def q_with_limit_where(g: Graph) -> DataFrame:
    return _limit_where(g, False)


@query("SELECT o_orderkey AS orderkey FROM orders WHERE o_orderkey % 2 = 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def q_with_limit_where_compat(g: Graph) -> DataFrame:
    return _limit_where(g, True)


@query("SELECT DISTINCT c_mktsegment AS segment, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_distinct(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("c", "Customer"), Hop("BelongsTo"), Node(label="Nation"), Hop("PartOf"), Node("r", "Region"))
    return rows.returns(lambda v: {"segment": v.c["segment"], "region": key_of(v.r).cast("int")}, distinct=True)


@query("SELECT o_orderkey AS orderkey, o_totalprice AS price FROM orders ORDER BY price DESC, orderkey LIMIT 10")
def q_topk(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("o", "Order"))
    return rows.returns(lambda v: {"orderkey": v.o["name"].cast("long"), "price": v.o["totalprice"]}, order_by=[F.desc("price"), F.asc("orderkey")], limit=10)


@query("SELECT c_custkey AS customer FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 15")
def q_skip_limit(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("c", "Customer"))
    rows = rows.with_(lambda v: {"customer": key_of(v.c), "bal": v.c["acctbal"]},
                      order_by=[F.asc("bal"), F.asc("customer")], skip=15, limit=20)
    return rows.returns({"customer": F.col("customer")})


@query("SELECT p_partkey AS part, x FROM (SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS x FROM part) "
       "ORDER BY x ASC NULLS FIRST, part LIMIT 12")
def q_null_order(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("p", "Part"))
    return rows.returns(lambda v: {"part": key_of(v.p), "x": F.when(v.p["size"] <= 40, v.p["size"])},
                        order_by=[F.asc("x"), F.asc("part")], limit=12)


def params_query(g: Graph, segment: str, least: float) -> DataFrame:
    """Parameters are arguments."""
    rows = Rows(g).match(Node("c", "Customer"), where=lambda v: (v.c["segment"] == segment) & (v.c["acctbal"] >= least))
    return rows.returns(lambda v: {"customer": key_of(v.c)})


@query("SELECT c_custkey AS customer FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 5000")
def q_params(g: Graph) -> DataFrame:
    return params_query(g, "BUILDING", 5000.0)


@query("SELECT k, count(*) AS n FROM (SELECT CASE WHEN p_size < 25 THEN p_brand END AS k FROM part) GROUP BY k")
def q_group_null(g: Graph) -> DataFrame:
    return Rows(g).match(Node("p", "Part")).returns(lambda v: {"k": F.when(v.p["size"] < 25, v.p["brand"])}, rows_counted())


def _global_empty(g: Graph, compat: bool) -> DataFrame:
    rows = Rows(g, compat=compat).match(Node("p", "Part"), where=lambda v: v.p["size"] < 0)
    return rows.returns(aggs=lambda v: {"n": F.count(F.lit(1)), "total": F.sum(v.p["price"])})


@query("SELECT count(*) AS n, sum(p_retailprice) AS total FROM part WHERE p_size < 0")
def q_global_empty(g: Graph) -> DataFrame:
    return _global_empty(g, False)


@query("SELECT count(*) AS n, sum(p_retailprice) AS total FROM part WHERE p_size < 0 HAVING count(*) > 0")
def q_global_empty_compat(g: Graph) -> DataFrame:
    return _global_empty(g, True)


@query("SELECT c_mktsegment AS segment, count(*) AS n, count(DISTINCT c_nationkey) AS nations, round(sum(c_acctbal), 4) AS total, "
       "round(avg(c_acctbal), 2) AS mean, min(c_acctbal) AS least, max(c_name) AS last FROM customer GROUP BY c_mktsegment")
def q_aggs(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("c", "Customer"), Hop("BelongsTo"), Node("n", "Nation"))
    return rows.returns(lambda v: {"segment": v.c["segment"]}, lambda v: {
        "n": F.count(v.c["uid"]), "nations": F.count_distinct(v.n["uid"]), "total": F.round(F.sum(v.c["acctbal"].cast("double")), 4),
        "mean": F.round(F.avg(v.c["acctbal"]), 2), "least": F.min(v.c["acctbal"]), "last": F.max(v.c["name"])})


@query("SELECT brand, l[1] AS first_type, l[3] AS third_type, l[99] AS none, array_to_string(l[2:4], ',') AS part, len(l) AS n FROM "
       "(SELECT p_brand AS brand, list(DISTINCT p_type ORDER BY p_type) AS l FROM part GROUP BY p_brand)")
def q_collect_slice_index(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("p", "Part")).with_(lambda v: {"brand": v.p["brand"], "type": v.p["type"]}, distinct=True)
    rows = rows.with_({"brand": F.col("brand")}, {"l": collect(F.col("type"), F.col("type"))})
    at = lambda i: X.index(F.col("l"), F.lit(i))
    return rows.returns({"brand": F.col("brand"), "first_type": at(0), "third_type": at(2), "none": at(98),
                         "part": F.array_join(X.slice_(F.col("l"), F.lit(1), F.lit(4)), ","), "n": X.size(F.col("l"))})


@query("SELECT p_partkey AS part, p_size AS found, CAST(NULL AS INTEGER) AS missing FROM part")
def q_map_index(g: Graph) -> DataFrame:
    made = F.create_map(F.col("p__brand"), F.col("p__size"))
    rows = Rows(g).match(Node("p", "Part"))
    return rows.returns(lambda v: {"part": key_of(v.p), "found": X.index(made, v.p["brand"], "map"), "missing": X.index(made, F.lit("no such key"), "map")})


@query('SELECT c_mktsegment AS segment, count(*) AS count, min(c_acctbal) AS min, max(c_acctbal) - min(c_acctbal) AS expr_3 FROM customer GROUP BY c_mktsegment')
def q_default_names(g: Graph) -> DataFrame:
    """Results without names: a property's key, a function, a place."""
    rows = Rows(g).match(Node("c", "Customer"))
    balance = lambda v: v.c["acctbal"]
    return rows.returns(lambda v: [v.c["segment"]], lambda v: [F.count(F.lit(1)), F.min(balance(v)), F.max(balance(v)) - F.min(balance(v))])


@query("SELECT c_mktsegment AS segment, abs(count(DISTINCT c_custkey) - count(*)) <= 0.1 * count(DISTINCT c_custkey) AS close FROM customer GROUP BY c_mktsegment")
def q_approx_distinct(g: Graph) -> DataFrame:
    """The sketch is within a tenth of the exact number."""
    rows = Rows(g).match(Node("c", "Customer"))
    exact, sketch = (lambda v: X.count_distinct(v.c["uid"])), (lambda v: X.count_distinct(v.c["uid"], approx=True))
    return rows.returns(lambda v: {"segment": v.c["segment"]}, lambda v: {"close": F.abs(sketch(v) - exact(v)) <= 0.1 * exact(v)})


@query("SELECT p_brand AS brand, round(sum(p_retailprice) / 1024, 6) AS k, count(*) + 1 AS n1, max(p_size) - min(p_size) > 45 AS wide FROM part GROUP BY p_brand")
def q_agg_arith(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("p", "Part"))
    return rows.returns(lambda v: {"brand": v.p["brand"]}, lambda v: {
        "k": F.round(X.divide(F.sum(v.p["price"]), F.lit(1024)), 6), "n1": F.count(F.lit(1)) + 1, "wide": F.max(v.p["size"]) - F.min(v.p["size"]) > 45})


# ---- expressions -----------------------------------------------------------------------------------------


@query("WITH t AS (SELECT p_partkey AS part, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS a, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 20 END AS b FROM part) "
       "SELECT part, a IS NOT DISTINCT FROM b AS eq, a IS DISTINCT FROM b AS ne, b IS NOT NULL AND (a IS NULL OR a < b) AS lt, "
       "a IS NOT NULL AND (b IS NULL OR a > b) AS gt, a IS NULL OR (b IS NOT NULL AND a <= b) AS le, b IS NULL OR (a IS NOT NULL AND a >= b) AS ge FROM t")
def q_compare_compat(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("p", "Part"))
    a = F.when(F.col("p__size") % 3 != 0, F.col("p__size"))
    b = F.when(F.col("p__size") % 5 != 0, F.lit(20))
    made = {f.__name__: f(a, b, compat=True) for f in (X.eq, X.ne, X.lt, X.gt, X.le, X.ge)}
    return rows.returns(lambda v: {"part": key_of(v.p), **made})


@query("WITH t AS (SELECT p_partkey AS part, p_size > 10 AS a, CASE WHEN p_size % 2 = 0 THEN p_size > 30 END AS b FROM part) SELECT part, a AND b AS both, a OR b AS either, "
       "NOT b AS neither, coalesce(a, false) <> coalesce(b, false) AS x, NOT coalesce(b, false) AS n2 FROM t")
def q_bool_ops(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("p", "Part"))
    a, b = F.col("p__size") > 10, F.when(F.col("p__size") % 2 == 0, F.col("p__size") > 30)
    return rows.returns(lambda v: {"part": key_of(v.p), "both": X.and_(a, b), "either": X.or_(a, b), "neither": X.not_(b),
                                   "x": X.xor(a, b, compat=True), "n2": X.not_(b, compat=True)})


@query("SELECT p_partkey AS part, p_size IN (1, 3, 30) AS has, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END IN (2, 4), false) AS has2 FROM part")
def q_in(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("p", "Part"))
    items, size = (lambda *a: F.array(*map(F.lit, a))), F.col("p__size")
    return rows.returns(lambda v: {"part": key_of(v.p), "has": X.in_list(size, items(1, 3, 30)), "has2": X.in_list(F.when(size % 2 == 0, size), items(2, 4), compat=True)})


@query("SELECT p_partkey AS part, starts_with(p_name, 's') AS s, suffix(p_name, 'g') AS e, contains(p_name, 'in') AS c, lower(p_type) AS l, upper(lower(p_name)) AS u, "
       "replace(p_name, 'a', '_') AS r FROM part")
def q_string_pred(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("p", "Part"))
    name, lit = F.col("p__name"), F.lit
    return rows.returns(lambda v: {"part": key_of(v.p), "s": X.starts_with(name, lit("s")), "e": X.ends_with(name, lit("g"), compat=True), "c": X.contains(name, lit("in")),
                                   "l": X.lower(v.p["type"], compat=True), "u": X.upper(X.lower(name)), "r": X.replace(name, lit("a"), lit("_"))})


@query("SELECT p_partkey AS part, p_size + p_retailprice AS a, p_size - p_retailprice AS s, p_size * 2.0::DOUBLE AS m, round(p_retailprice / nullif(p_size - 10, 0), 6) AS d, "
       "CAST(p_size AS DOUBLE) % nullif(CAST(p_partkey % 7 AS DOUBLE), 0) AS r, pow(CAST(p_size AS DOUBLE), 2) AS w, -CAST(p_size AS DOUBLE) AS g, "
       "coalesce(CASE WHEN p_size > 25 THEN CAST(p_size AS DOUBLE) END, 0) + 1 AS z FROM part")
def q_arith(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("p", "Part"))
    size, price, part = F.col("p__size"), F.col("p__price"), key_of({"uid": F.col("p__uid")})
    return rows.returns({"part": part, "a": X.add(size, price), "s": X.subtract(size, price), "m": X.multiply(size, F.lit(2)), "d": F.round(X.divide(price, size - 10), 6),
                         "r": X.modulo(size, part % 7), "w": X.power(size, F.lit(2)), "g": X.negate(size), "z": X.add(F.when(size > 25, size), F.lit(1), compat=True)})


@query("SELECT o_orderkey AS orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' END AS band, "
       "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
def q_case(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("o", "Order"))
    price, status = F.col("o__totalprice"), F.col("o__status")
    return rows.returns({"orderkey": F.col("o__name").cast("long"), "band": F.when(price > 300000, "big").when(price > 100000, "mid"),
                         "code": X.case_value(status, [(F.lit("F"), F.lit(1)), (F.lit("O"), F.lit(2))], F.lit(0))})


@query("SELECT p_partkey AS part, CAST(list_sum(list_transform(list_filter(l, lambda x: x > 10), lambda x: x * 2)) AS BIGINT) AS total, len(list_filter(l, lambda x: x > 10)) AS n FROM "
       "(SELECT p_partkey, [p_size, p_size - 10, 5] AS l FROM part)")
def q_list_comp(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("p", "Part"))
    size = F.col("p__size")
    doubled = X.comprehension(F.array(size, size - 10, F.lit(5)), lambda x: x > 10, lambda x: x * 2)
    total = F.when(F.size(doubled) > 0, F.aggregate(doubled, F.lit(0), lambda a, x: a + x)).cast("bigint")
    return rows.returns({"part": key_of({"uid": F.col("p__uid")}), "total": total, "n": X.size(doubled)})


@query("SELECT p_partkey AS part, len(list_filter(l, lambda x: x > 20)) > 0 AS a, len(list_filter(l, lambda x: x > 20)) = len(l) AS b, len(list_filter(l, lambda x: x > 20)) = 0 AS c, "
       "len(list_filter(l, lambda x: x > 20)) = 1 AS d FROM (SELECT p_partkey, [p_size, p_size - 10, 25] AS l FROM part)")
def q_quantifiers(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("p", "Part"))
    size = F.col("p__size")
    items, p = F.array(size, size - 10, F.lit(25)), lambda x: x > 20
    return rows.returns({"part": key_of({"uid": F.col("p__uid")}), "a": X.any_(items, p), "b": X.all_(items, p), "c": X.none(items, p), "d": X.single(items, p)})


@query("SELECT p_partkey AS part, CAST(length(p_name) AS BIGINT) AS chars, coalesce(CASE WHEN p_size > 25 THEN p_brand END, p_type) AS c, CAST(p_size AS VARCHAR) AS s, "
       "TRY_CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT) AS i, CAST(0 AS BIGINT) AS bad, TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS f, 'Part' AS label FROM part")
def q_functions(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("p", "Part"))
    brand, size = F.col("p__brand"), F.col("p__size")
    return rows.returns(lambda v: {
        "part": key_of(v.p), "chars": X.size(v.p["name"], "string"), "c": F.coalesce(F.when(size > 25, brand), v.p["type"]),
        "s": X.to_string(size), "i": X.to_integer(F.regexp_replace(brand, "[^0-9]", "")), "bad": X.to_integer(F.concat(brand, F.lit(" x")), compat=True),
        "f": X.to_float(F.substring(brand, 7, 20)), "label": F.get(X.labels(v.p["label"]), F.lit(0))})


@query("WITH t AS (SELECT p_partkey AS part, p_size AS n, p_partkey % 5 AS k FROM part) SELECT part, CASE k WHEN 0 THEN n WHEN 1 THEN n * 1024.0 WHEN 2 THEN round(n * 1000000 / 1048576.0, 6) "
       "WHEN 3 THEN round(n / 1000.0 / 1048576, 12) END AS mib, CASE k WHEN 0 THEN n WHEN 1 THEN n * 1024.0 ELSE 0 END AS old FROM t")
def q_quantity(g: Graph) -> DataFrame:
    part = key_of({"uid": F.col("p__uid")})
    suffix = X.case_value(part % 5, [(F.lit(0), F.lit("Mi")), (F.lit(1), F.lit("Gi")), (F.lit(2), F.lit("M")), (F.lit(3), F.lit("m"))], F.lit("??"))
    text = F.concat(F.col("p__size").cast("string"), suffix)
    value = X.quantity(text, "Mi")
    rows = Rows(g).match(Node("p", "Part"))
    return rows.returns({"part": part, "mib": F.when(part % 5 == 3, F.round(value, 12)).otherwise(F.round(value, 6)), "old": X.quantity(text, legacy=True)})


@query("SELECT event_id AS event, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def q_property_json(g: Graph) -> DataFrame:
    k = X.to_integer(F.get_json_object(F.col("e__props"), "$.k"))
    rows = Rows(g).match(Node("e", "Event"), where=lambda v: k > 50)
    return rows.returns({"event": F.col("e__name").cast("long"), "k": k, "none": F.get_json_object(F.col("e__props"), "$.none")})


# ---- change data, quality, metrics -----------------------------------------------------------------------


def order_versions(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Two versions of the orders, by rules on the key: 0 is removed, 1 added, 2 modified."""
    key = F.col("name").cast("long") % 10
    base = g.node_tables["Order"].select("uid", "name", F.lit("Order").alias("kind"), F.lit("1").alias("resource_version"))
    return base.where(key != 1), base.where(key != 0).withColumn("resource_version", F.when(key == 2, "2").otherwise("1"))


@query("SELECT 'Order:' || o_orderkey AS uid, 'Order' AS kind, CASE o_orderkey % 10 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' ELSE 'modified' END AS op FROM orders WHERE o_orderkey % 10 IN (0, 1, 2)", text_ids=True)
def q_snapshot_diff(g: Graph) -> DataFrame:
    old, new = order_versions(g)
    return changes.snapshot_diff(new, old).select("uid", "kind", "op")


@query("SELECT 'Order' AS kind, count(*) FILTER (o_orderkey % 10 = 1) AS added, count(*) FILTER (o_orderkey % 10 = 0) AS removed, count(*) FILTER (o_orderkey % 10 = 2) AS modified FROM orders")
def q_diff_summary(g: Graph) -> DataFrame:
    old, new = order_versions(g)
    return changes.diff_summary(changes.snapshot_diff(new, old))


def edge_versions(g: Graph) -> tuple[DataFrame, DataFrame]:
    e = g.edges("Manages")
    key = F.substring_index("dst", ":", -1).cast("long") % 10
    return e.where(key != 1), e.where(key != 0)


@query("SELECT 'Customer:' || o_custkey AS src, 'Manages' AS etype, 'Order:' || o_orderkey AS dst, CASE o_orderkey % 10 WHEN 0 THEN 'removed' ELSE 'added' END AS op FROM orders WHERE o_orderkey % 10 IN (0, 1)", text_ids=True)
def q_edge_diff(g: Graph) -> DataFrame:
    old, new = edge_versions(g)
    return changes.edge_diff(new, old).select("src", "etype", "dst", "op")


@query("SELECT 'node' AS what, 'Order:' || o_orderkey AS uid, CASE WHEN o_orderkey % 10 = 2 THEN '2' ELSE '1' END AS more FROM orders WHERE o_orderkey % 10 <> 0 "
       "UNION ALL SELECT 'edge', 'Customer:' || o_custkey, 'Order:' || o_orderkey FROM orders WHERE o_orderkey % 10 <> 0", text_ids=True)
def q_apply_diff(g: Graph) -> DataFrame:
    old, new = order_versions(g)
    old_edges, new_edges = edge_versions(g)
    next_nodes, links = changes.apply_diff(old, old_edges, changes.snapshot_diff(new, old), new, changes.edge_diff(new_edges, old_edges))
    return next_nodes.select(F.lit("node").alias("what"), "uid", F.col("resource_version").alias("more")).unionByName(
        links.select(F.lit("edge").alias("what"), F.col("src").alias("uid"), F.col("dst").alias("more"))
    )


@query("SELECT 'Customer:' || c_custkey AS uid, CASE c_custkey % 10 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' ELSE 'modified' END AS op FROM customer WHERE c_custkey % 10 IN (0, 1, 3)", text_ids=True)
def q_node_diff(g: Graph) -> DataFrame:
    """Nodes without a version are compared by their content: of ten one is gone, one new, one has another balance."""
    key = F.substring_index("uid", ":", -1).cast("long") % 10
    base = g.node_tables["Customer"]
    props = lambda df: F.to_json(F.struct("acctbal", "segment"))
    version = lambda df: df.select("uid", "name", "namespace", "resource_version", F.lit("Customer").alias("label"), props(df).alias("props"))
    old = version(base.where(key != 1))
    new = version(base.where(key != 0).withColumn("acctbal", F.when(key == 3, F.col("acctbal") + 1).otherwise(F.col("acctbal"))))
    return changes.node_diff(new, old).select("uid", "op")


@query("SELECT 'Order:' || o_orderkey AS uid, CASE WHEN o_orderkey % 4 = 1 THEN '2' ELSE '1' END AS resource_version, count(*) AS n FROM orders GROUP BY ALL", text_ids=True)
def q_node_upsert(g: Graph) -> DataFrame:
    """Of the rows of a uid the last one stays."""
    first = g.node_tables["Order"].select("uid", "name", F.lit("1").alias("resource_version"), F.lit(1).alias("_at"))
    again = first.where(F.col("name").cast("long") % 4 == 1).withColumns({"resource_version": F.lit("2"), "_at": F.lit(2)})
    out = nodes.upsert(first.unionByName(again), F.col("_at"))
    return out.groupBy("uid", "resource_version").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(*) AS same, count(DISTINCT o_custkey) AS hashes FROM orders", text_ids=True)
def q_endpoint_hash(g: Graph) -> DataFrame:
    """The hash of an endpoint doesn't know the order of its addresses and zones, but does know the target."""
    none = F.lit(None).cast("string")

    def made(addresses: Column, zones: Column) -> Column:
        return nodes.endpoint_hash(F.struct(
            addresses.alias("addresses"), F.struct(F.lit(True).alias("ready"), F.lit(True).alias("serving"), F.lit(None).cast("boolean").alias("terminating")).alias("conditions"),
            F.struct(F.transform(zones, lambda z: F.struct(z.alias("name"))).alias("forZones")).alias("hints"), none.alias("hostname"), none.alias("nodeName"), none.alias("zone"),
            F.struct(F.lit("Pod").alias("kind"), none.alias("namespace"), none.alias("name"), F.col("src").alias("uid")).alias("targetRef")))

    a, b = F.concat(F.lit("10."), F.col("src")), F.concat(F.lit("fd."), F.col("src"))
    both = g.edges("Manages").select(made(F.array(a, b), F.array(F.lit("x"), F.lit("y"))).alias("h"), made(F.array(b, a), F.array(F.lit("y"), F.lit("x"))).alias("k"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("h") == F.col("k")).alias("same"), F.count_distinct("h").alias("hashes"))


@query("SELECT 'schema' AS rule, 'Customer Manages Order' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'schema', 'Event Concerns Customer', count(*) FROM events")
def q_schema_rejects(g: Graph) -> DataFrame:
    """Edges of triples that the schema lacks are left out and reported."""
    allowed = triples_frame(g.spark, [t for t in TRIPLES if t[1] not in ("Manages", "Concerns")])
    return edges.outside_schema(g.all_edges(), allowed).groupBy("rule", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'about' AS rule, event_type AS kind, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type")
def q_unknown_references(g: Graph) -> DataFrame:
    refs = g.node_tables["Event"].select(F.lit("about").alias("rule"), F.col("type").alias("kind"), "uid")
    return quality.unknown_references(refs, ["click", "view"])


_LABELS = (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders"), ("Event", "events"))
_LINKS = {
    ("Nation", "PartOf", "Region"): "nation", ("Customer", "BelongsTo", "Nation"): "customer", ("Supplier", "BelongsTo", "Nation"): "supplier", ("Customer", "Manages", "Order"): "orders",
    ("Order", "Contains", "Part"): f"({ORDERS})", ("Supplier", "Supplies", "Part"): "(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)", ("Event", "Concerns", "Customer"): "events",
}
_NODE_COUNTS = " UNION ALL ".join(f"SELECT 'node' AS what, '{x}' AS name, count(*) AS n FROM {t}" for x, t in _LABELS)
_EDGE_COUNTS = "SELECT 'edge' AS what, name, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS name, count(*) AS n FROM {t}" for (_, b, _), t in _LINKS.items()) + ") GROUP BY name"
_OBSERVED = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS e, '{c}' AS b, count(*) AS n FROM {t}" for (a, b, c), t in _LINKS.items()) + ") WHERE n > 0"


def _counted(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """``(what, name, n)`` of tables with ``name``."""
    per = lambda df, what: df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "name", "n")
    return per(vertices, "node").unionByName(per(links, "edge"))


@query(f"{_NODE_COUNTS} UNION ALL {_EDGE_COUNTS}", text_ids=True)
def q_graph_store(g: Graph) -> DataFrame:
    """Written to the store and read back, as vertices and edges of a directed graph."""
    path = f"{scratch_dir(g.spark)}/store"
    sinks.write_graph(g, path)
    vertices, links = sinks.directed_graph(sinks.read_graph(g.spark, path))
    return _counted(vertices.select(F.col("type").alias("name")), links.select(F.col("type").alias("name")))


def _kept(g: Graph) -> Graph:
    path = f"{scratch_dir(g.spark)}/store"
    sinks.write_graph(g, path)
    return sinks.read_graph(g.spark, path)


@query(f"WITH e AS ({ORDERS}) SELECT p_brand AS brand, o_orderstatus AS status, o_orderdate AS date, count(*) AS n, min(p_retailprice) AS least, min(o_totalprice) AS total "
       "FROM e JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_size = 7 GROUP BY ALL")
def q_store_properties(g: Graph) -> DataFrame:
    """A pattern on typed properties of a graph that was written and read back: filters, keys and values."""
    rows = Rows(_kept(g)).match(Node("o", "Order"), Hop("Contains"), Node("p", "Part"), where=lambda v: v.p["size"] == 7)
    return rows.returns(
        lambda v: {"brand": v.p["brand"], "status": v.o["status"], "date": v.o["date"]},
        lambda v: {**rows_counted(), "least": F.min(v.p["price"]), "total": F.min(v.o["totalprice"])},
    )


@query("SELECT e.event_type AS type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT c_custkey) AS customers, CAST(NULL AS VARCHAR) AS missing "
       "FROM events e JOIN customer ON user_id = c_custkey GROUP BY ALL")
def q_store_open_properties(g: Graph) -> DataFrame:
    """Keys of properties of open shape, which the store holds as VARIANT, beside typed columns; one that no node has."""
    rows = Rows(_kept(g)).match(Node("e", "Event"), Hop("Concerns"), Node("c", "Customer"))
    return rows.returns(
        lambda v: {"type": v.e["type"], "k": v.e.get("k", "bigint"), "missing": v.e.get("no such key")},
        lambda v: {**rows_counted(), "customers": F.count_distinct(v.c["uid"])},
    )


@query(f"{_NODE_COUNTS} UNION ALL {_EDGE_COUNTS}", text_ids=True)
def q_canonical_export(g: Graph) -> DataFrame:
    """The canonical lines, read back and parsed."""
    path = f"{scratch_dir(g.spark)}/canonical"
    sinks.write_canonical(g, path, compression="gzip")
    field = lambda what, name: g.spark.read.text(f"{path}/{what}").select(F.get_json_object("value", name).alias("name"))
    return _counted(field("nodes", "$.labels[0]"), field("edges", "$.rel"))


@query(f"{_NODE_COUNTS} UNION ALL {_EDGE_COUNTS} UNION ALL SELECT 'version', 'last', 0", text_ids=True)
def q_store_rebuild(g: Graph) -> DataFrame:
    """The fallback writes everything; an update with the same graph then finds nothing to do and writes no version."""
    store = GraphStore(g.spark, f"{scratch_dir(g.spark)}/versions")
    store.rebuild(0, g)
    store.update(1, g)
    vertices, links = store.read(0)
    last = g.spark.range(1).select(F.lit("version").alias("what"), F.lit("last").alias("name"), F.lit(store.last()).cast("bigint").alias("n"))
    return _counted(vertices.select(F.col("label").alias("name")), links.select(F.col("etype").alias("name"))).unionByName(last)


_VERSION = ("SELECT {v} AS version, {status} AS status, count(*) AS n, min(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE {where} GROUP BY ALL")
_LATER = {"status": "CASE WHEN o_orderkey % 100 = 0 THEN 'X' ELSE o_orderstatus END", "where": "c_custkey % 50 <> 1"}


@query(" UNION ALL ".join([_VERSION.format(v=0, status="o_orderstatus", where="true"), *(_VERSION.format(v=v, **_LATER) for v in (1, 2))]), text_ids=True)
def q_delta_store(g: Graph) -> DataFrame:
    """Two versions in a store of a base and changes, each matched on; the second also after it became a base of its own
    and the first was dropped (told as version 2). Orders change, customers go and take their edges along."""
    tables, orders, customers = dict(g.node_tables), g.node_tables["Order"], g.node_tables["Customer"]
    tables["Order"] = orders.withColumn("status", F.when(F.col("uid").rlike(":(0|[0-9]*00)$"), "X").otherwise(F.col("status")))
    tables["Customer"] = customers.where(~F.col("uid").rlike(":(1|[0-9]*[05]1)$"))
    store = GraphStore(g.spark, f"{scratch_dir(g.spark)}/versions")
    store.rebuild(0, g)
    store.update(1, Graph(tables, g.edge_tables))

    def told(version: int, name: int) -> DataFrame:
        rows = Rows(store.graph(version, g)).match(Node("c", "Customer"), Hop("Manages"), Node("o", "Order"))
        return rows.returns(lambda v: {"version": F.lit(name), "status": v.o["status"]}, lambda v: {**rows_counted(), "total": F.min(v.o["totalprice"])})

    with scratch(g.spark) as kept:  # written before the store drops what they read
        both = stored(told(0, 0).unionByName(told(1, 1)), f"{kept}/both")
        first = g.spark.createDataFrame(both.collect(), both.schema)  # a row per version and status
    store.compact()
    store.vacuum(1)
    return first.unionByName(told(1, 2))


@query(f"SELECT what, name FROM ({_NODE_COUNTS.replace(chr(39) + 'node' + chr(39), chr(39) + 'label' + chr(39))} UNION ALL {_EDGE_COUNTS}) WHERE n > 0", text_ids=True)
def q_metadata(g: Graph) -> DataFrame:
    return quality.metadata(g.nodes(), g.all_edges())


@query("SELECT label, schema FROM (SELECT 'Customer' AS label, 'OBJECT<acctbal: DOUBLE, segment: STRING>' AS schema, count(*) AS n FROM customer "
       "UNION ALL SELECT 'Supplier', 'OBJECT<acctbal: DOUBLE>', count(*) FROM supplier UNION ALL SELECT 'Event', 'OBJECT<k: BIGINT>', count(*) FROM events) WHERE n > 0", text_ids=True)
def q_property_schema(g: Graph) -> DataFrame:
    """JSON numbers with and without a fraction meet in one type, so it is asked for as text of the merged schema."""
    found = quality.property_schema(g.nodes().where(F.col("label").isin("Customer", "Supplier", "Event")))
    return found.select("label", F.regexp_replace("schema", "DECIMAL\\([0-9,]+\\)", "DOUBLE").alias("schema"))


@query("SELECT 'Customer:' || o_custkey AS src, 'Order:' || o_orderkey AS dst, CASE WHEN o_orderkey % 3 = 0 THEN 'Returned' ELSE 'Manages' END AS etype FROM orders", text_ids=True)
def q_edge_dedupe(g: Graph) -> DataFrame:
    first = g.edges("Manages").withColumn("ord", F.lit(1))
    again = first.where(F.substring_index("dst", ":", -1).cast("long") % 3 == 0).withColumns({"etype": F.lit("Returned"), "ord": F.lit(2)})
    return edges.one_per_pair(first.unionByName(again)).select("src", "dst", "etype")


@query("SELECT 'Supplier' AS src_label, 'Supplies' AS etype, 'Part' AS dst_label, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
def q_schema_conformance(g: Graph) -> DataFrame:
    allowed = triples_frame(g.spark, [t for t in TRIPLES if t[1] != "Supplies"])
    return quality.unknown_triples(g.all_edges(), allowed)


_PATTERNS = [
    (1, "Customer", "Manages", "out", "Order"), (2, "Order", "Manages", "out", "Customer"), (3, "Order", "manages", "in", "Customer"),
    (4, "Order", "Manages", "both", "Customer"), (5, None, "Manages", "out", "Order"), (6, "Customer", "Nothing", "out", "Order"),
]
_PATTERN_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in p) + ")" for p in _PATTERNS)


@query(f"SELECT pattern_id, EXISTS (SELECT 1 FROM ({_OBSERVED}) o WHERE lower(o.e) = lower(p.e) AND ((p.way <> 'in' AND coalesce(p.l, o.a) = o.a AND coalesce(p.r, o.b) = o.b) "
       f"OR (p.way <> 'out' AND coalesce(p.l, o.b) = o.b AND coalesce(p.r, o.a) = o.a))) AS ok FROM (VALUES {_PATTERN_ROWS}) p(pattern_id, l, e, way, r)")
def q_pattern_conformance(g: Graph) -> DataFrame:
    patterns = g.spark.createDataFrame(_PATTERNS, "pattern_id int, left_label string, etype string, direction string, right_label string")
    return quality.pattern_conformance(patterns, quality.observed_triples(g.all_edges())).select("pattern_id", "ok")


@query(f"SELECT e AS etype, string_agg(a || '->' || b, ',' ORDER BY a || '->' || b) AS pairs FROM ({_OBSERVED}) GROUP BY e")
def q_allowed_pairs(g: Graph) -> DataFrame:
    return quality.allowed_pairs(quality.observed_triples(g.all_edges())).select("etype", F.array_join("pairs", ",").alias("pairs"))


@query(f"WITH e AS ({ORDERS}), d AS (SELECT o_orderkey AS k, count(l_partkey) AS d FROM orders LEFT JOIN e ON l_orderkey = o_orderkey GROUP BY o_orderkey) "
       "SELECT 'Order' AS label, count(*) AS nodes, max(d) AS most, CAST(sum(d) AS BIGINT) AS edges FROM d")
def q_degree_metrics(g: Graph) -> DataFrame:
    return metrics.out_degrees(g, "Order", "Contains").agg(
        F.lit("Order").alias("label"), F.count(F.lit(1)).alias("nodes"), F.max("degree").alias("most"), F.sum("degree").alias("edges"))


@query("SELECT 'Event' AS label, count(*) AS nodes, CAST(sum(len(json_keys(props))) AS BIGINT) AS properties FROM events")
def q_property_count(g: Graph) -> DataFrame:
    return metrics.property_count(g.node_tables["Event"].select(F.lit("Event").alias("label"), F.col("props").alias("props_json")))


@query(text_ids=True)
def q_content_hash(g: Graph) -> DataFrame:
    return quality.content_hash(quality.canonical_nodes(g.nodes()), quality.canonical_edges(g.all_edges()))


@query("SELECT (SELECT sum(n) FROM (" + _NODE_COUNTS + "))::BIGINT AS node_count, (SELECT sum(n) FROM (" + _EDGE_COUNTS + "))::BIGINT AS edge_count, true AS same, false AS other", text_ids=True)
def q_content_hash_compare(g: Graph) -> DataFrame:
    """The hash stays when the rows are dealt anew and changes with one edge type less."""
    lines, links = quality.canonical_nodes(g.nodes()), quality.canonical_edges(g.all_edges())
    whole = quality.content_hash(lines, links).select("node_count", "edge_count", F.col("graph_hash").alias("_a"))
    again = quality.content_hash(lines.repartition(7, "line"), links.repartition(5, "dst")).select(F.col("graph_hash").alias("_b"))
    less = quality.content_hash(lines, links.where("rel <> 'PartOf'")).select(F.col("graph_hash").alias("_c"))
    # three single rows
    return whole.crossJoin(again).crossJoin(less).select("node_count", "edge_count", (F.col("_a") == F.col("_b")).alias("same"), (F.col("_a") == F.col("_c")).alias("other"))


@query("WITH c AS (SELECT substr(md5('Customer:' || c_custkey), 1, 3) AS r, 1 + CAST(c_acctbal > 0 AS INTEGER) AS k FROM customer), "
       "g AS (SELECT r, count(*) AS n, sum(k) AS k FROM c GROUP BY r), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g), "
       "a AS (SELECT sum(n) AS n FROM g) SELECT 'Customer' AS label, CAST(any_value(a.n) AS BIGINT) AS nodes, "
       "CAST(round(any_value(a.n) * (CAST(sum(b.k) AS DOUBLE) / sum(b.n))) AS BIGINT) AS properties FROM b, a WHERE before < 50", text_ids=True)
def q_property_sample(g: Graph) -> DataFrame:
    """Scaled up from the first ranges of hashes that hold 50 customers; the sampling is the feature."""
    props = F.to_json(F.struct("name", F.when(F.col("acctbal") > 0, F.lit("yes")).alias("credit")))
    return metrics.property_count(g.node_tables["Customer"].select(F.lit("Customer").alias("label"), "uid", props.alias("props_json")), sample=50)


# every edge by its key and canonical line, and the sums of each range
_LINKS = " UNION ALL ".join(
    f"SELECT '{a}:' || {x} AS k, '{{\"dst\":\"{b}:' || {y} || '\",\"props\":\"{{}}\",\"rel\":\"{e}\",\"src\":\"{a}:' || {x} || '\"}}' AS line, '{e}' AS rel, {y} AS y FROM {t}"
    for (a, e, b), x, y, t in zip(
        TRIPLES,
        ("n_nationkey", "c_custkey", "s_suppkey", "o_custkey", "l_orderkey", "l_suppkey", "event_id"),
        ("n_regionkey", "c_nationkey", "s_nationkey", "o_orderkey", "l_partkey", "l_partkey", "user_id"),
        ("nation", "customer", "supplier", "orders", f"({ORDERS})", "(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)", "events"),
        strict=True,
    )
)
_UP = "SELECT left(p, {0}) AS p, sum(n) AS n, md5(string_agg(p || ':' || h, ',' ORDER BY p)) AS h FROM {1} GROUP BY 1"


@query(f"WITH e AS ({_LINKS}), h AS (SELECT substr(md5('=' || k), 1, 3) AS p, md5('=' || line) AS m FROM e), "
       "s AS (SELECT p, count(*) AS n, sum(CAST(CAST('0x' || substr(m, 1, 15) AS BIGINT) AS HUGEINT)) AS s, sum(CAST(CAST('0x' || substr(m, 16, 15) AS BIGINT) AS HUGEINT)) AS t FROM h GROUP BY p), "
       f"l AS (SELECT p, n, md5(n || ':' || s || ':' || t) AS h FROM s), l2 AS ({_UP.format(2, 'l')}), l1 AS ({_UP.format(1, 'l2')}), l0 AS ({_UP.format(0, 'l1')}) "
       "SELECT CAST(n AS BIGINT) AS n, h AS hash FROM l0", text_ids=True)
def q_tree_hash(g: Graph) -> DataFrame:
    """The root of the tree of hashes over all edges."""
    return quality.root_hash(quality.canonical_edges(g.all_edges()), "src")


@query(f"WITH e AS ({_LINKS}), s AS (SELECT substr(md5('=' || k), 1, 3) AS prefix, count(*) AS n_a, count(*) FILTER (NOT (rel = 'Manages' AND y % 97 = 0)) AS n_b FROM e GROUP BY 1) "
       "SELECT * FROM s WHERE n_a <> n_b", text_ids=True)
def q_tree_hash_ranges(g: Graph) -> DataFrame:
    """Where the edges differ from those without every 97th order."""
    lines = quality.canonical_edges(g.all_edges())
    gone = (F.col("rel") == "Manages") & (F.substring_index("dst", ":", -1).cast("long") % 97 == 0)
    return quality.differing_ranges(lines, lines.where(~gone), "src")


_CLAIMS = "SELECT c_mktsegment AS name, n_name AS namespace, 'c' || c_custkey AS uid, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(f"WITH c AS ({_CLAIMS}) SELECT name, namespace, arg_max(uid, k) AS uid FROM c GROUP BY ALL UNION ALL SELECT name, NULL, arg_max(uid, k) FROM c GROUP BY name")
def q_last_by_name(g: Graph) -> DataFrame:
    """The last object of a name in its place in the source, by namespace and, with a null one, across them."""
    rows = Rows(g).match(Node("c", "Customer"), Hop("BelongsTo"), Node("n", "Nation"))
    given = rows.returns(lambda v: {"name": v.c["segment"], "namespace": v.n["name"], "_at": key_of(v.c)})
    named = F.struct("name", "namespace", F.concat(F.lit("c"), F.col("_at").cast("string")).alias("uid"))
    items = given.select(named.alias("metadata"), F.col("_at").alias(ORDINAL))
    found = edges.name_lookup(items, by_namespace=True).unionByName(edges.name_lookup(items, by_namespace=False), allowMissingColumns=True)
    return found.select(F.col("_name").alias("name"), F.col("_ns").alias("namespace"), F.col("_uid").alias("uid"))


@query("WITH d AS (SELECT CAST(ts AS DATE) AS batch_ts, count(*) AS v FROM events GROUP BY 1) SELECT CAST(batch_ts AS VARCHAR) AS batch_ts, v AS value, "
       "array_to_string(list(v) OVER (ORDER BY batch_ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), ',') AS history FROM d")
def q_pulse_history(g: Graph) -> DataFrame:
    daily = g.node_tables["Event"].groupBy(F.to_date("ts").alias("batch_ts")).agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("events"))
    out = metrics.pulse_history(daily, fill=False)
    return out.select(F.col("batch_ts").cast("string").alias("batch_ts"), "value", F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"))


@query("WITH a AS (SELECT c_custkey, c_mktsegment FROM customer) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM a)) = 0 AS same, "
       "(SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM a WHERE c_mktsegment <> 'BUILDING')) = 0 AS other")
def q_result_match(g: Graph) -> DataFrame:
    a = g.node_tables["Customer"].select("uid", "segment")
    b = g.node_tables["Customer"].select("segment", "uid", "name").repartition(4, "segment")
    same = metrics.multiset_difference(a, b, ["uid", "segment"]).agg((F.count(F.lit(1)) == 0).alias("same"))
    other = metrics.multiset_difference(a, b.where(F.col("segment") != "BUILDING"), ["uid", "segment"]).agg((F.count(F.lit(1)) == 0).alias("other"))
    return same.crossJoin(other)


@query("SELECT count(DISTINCT c_mktsegment) = 1 AS uniform, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN min(c_mktsegment) END AS value FROM customer WHERE c_mktsegment = 'BUILDING'")
def q_uniform_value(g: Graph) -> DataFrame:
    return metrics.uniform_values(g.node_tables["Customer"].where("segment = 'BUILDING'"), ["segment"]).select(
        F.col("segment").isNotNull().alias("uniform"), F.col("segment").alias("value"))


