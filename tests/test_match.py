"""Pattern matching and clauses on tiny hand-built graphs."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.match import Hop, Node, Rows, collect
from loomgraph.operators.model import EDGE_TYPES, LABELS, LOGICAL_LABELS, SCHEMA_TRIPLES, Graph


def graph(spark, nodes, edges):
    tables = {}
    for label in {n[1] for n in nodes}:
        rows = [(u, name, ns) for u, x, name, ns in nodes if x == label]
        tables[label] = spark.createDataFrame(rows, "uid string, name string, namespace string").withColumn("resource_version", F.lit("1"))
    label_of = {u: x for u, x, _, _ in nodes}
    made = {}
    for s, t, d in edges:
        made.setdefault((label_of[s], t, label_of[d]), []).append((s, d))
    return Graph(tables, {k: spark.createDataFrame(v, "src string, dst string") for k, v in made.items()})


@pytest.fixture(scope="module")
def chain(spark):
    nodes = [("d1", "Deployment", "deploy", "ns1"), ("d2", "Deployment", "alone", "ns1"), ("r1", "ReplicaSet", "rs", "ns1"), ("r2", "ReplicaSet", "rs2", "ns2"),
             ("p1", "Pod", "alpha", "ns1"), ("p2", "Pod", "beta", "ns2"), ("p3", "Pod", "gamma", None)]
    return graph(spark, nodes, [("d1", "Manages", "r1"), ("r1", "Manages", "p1"), ("r2", "Manages", "p2"), ("p3", "Links", "p3"), ("p3", "Sees", "p1")])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def names(r, *variables):
    return rows(r.returns(lambda v: {x: v[x]["name"] for x in variables}))


def test_scan_filter_count(chain):
    r = Rows(chain).match(Node("p", "Pod"))
    assert rows(r.returns(aggs={"n": F.count(F.lit(1))})) == [(3,)]
    assert names(r.where(lambda v: v.p["namespace"] == "ns2"), "p") == [("beta",)]


def test_one_and_two_hops(chain):
    assert names(Rows(chain).match(Node("d", "Deployment"), Hop("manages"), Node("r", "ReplicaSet")), "d", "r") == [("deploy", "rs")]
    path = (Node("d", "Deployment"), Hop("Manages"), Node(label="ReplicaSet"), Hop("Manages"), Node("p", "Pod"))
    assert names(Rows(chain).match(*path), "d", "p") == [("deploy", "alpha")]
    assert names(Rows(chain).match(Node("p", "Pod"), Hop("Manages", "in"), Node("r", "ReplicaSet")), "p", "r") == [("alpha", "rs"), ("beta", "rs2")]


def test_undirected_self_loop_gives_two_rows(chain):
    assert len(names(Rows(chain).match(Node("a", "Pod"), Hop("Links", "both"), Node("b", "Pod")), "a", "b")) == 2


def test_relationship_variable(chain):
    r = Rows(chain).match(Node("p", "Pod"), Hop(var="r", direction="in"), Node("q", "ReplicaSet"))
    got = rows(r.returns(lambda v: {k: v.r[k] for k in ("type", "source", "target", "source_type", "target_type")}))
    assert got == [("Manages", "p1", "r1", "ReplicaSet", "Pod"), ("Manages", "p2", "r2", "ReplicaSet", "Pod")]
    again = r.match(Node("p"), Hop(var="r", direction="in"), Node("q"))
    assert names(again, "p") == [("alpha",), ("beta",)]


def test_cross_needs_consent(chain):
    r = Rows(chain).match(Node("a", "Pod"))
    with pytest.raises(ValueError, match="allow_cross"):
        r.match(Node("b", "Deployment"))
    assert len(names(r.match(Node("b", "Deployment"), allow_cross=True), "a", "b")) == 6


def test_unknown_names(chain):
    with pytest.raises(ValueError, match="unknown label"):
        Rows(chain).match(Node("x", "Nope"))
    with pytest.raises(ValueError, match="unknown edge type"):
        Rows(chain).match(Node("p", "Pod"), Hop("Nope"), Node("q", "Pod"))
    assert names(Rows(chain, compat=True).match(Node("p", "Pod"), Hop("Nope"), Node("q", "Pod")), "p") == []


def test_first_match_only_filters(chain):
    r = Rows(chain).match(Node("d", "Deployment")).match(Node("d"), Hop("Manages"), Node(label="ReplicaSet"), Hop("Manages"), Node(label="Pod"))
    assert names(r, "d") == [("deploy",)]


def test_exists_and_not_exists(chain):
    r = Rows(chain).match(Node("d", "Deployment"))
    hop = (Node("d"), Hop("Manages"), Node("r", "ReplicaSet"))
    assert names(r.exists(*hop), "d") == [("deploy",)]
    assert names(r.not_exists(*hop), "d") == [("alone",)]
    assert names(r.exists(*hop, where=lambda v: v.r["namespace"] != v.d["namespace"]), "d") == []
    flagged = r.exists_flag("has", *hop)
    assert rows(flagged.returns(lambda v: {"d": v.d["name"], "has": F.col("has")})) == [("alone", False), ("deploy", True)]


def test_optional_where_in_both_modes(chain):
    for compat, want in ((False, [("alone", None), ("deploy", None)]), (True, [])):
        r = Rows(chain, compat=compat).match(Node("d", "Deployment"))
        r = r.match(Node("d"), Hop("Manages"), Node("r", "ReplicaSet"), optional=True, where=lambda v: v.r["name"] == "other")
        assert names(r, "d", "r") == want


def test_cycle_and_shared_variable(chain):
    r = Rows(chain).match(Node("a", "Pod"), Hop("Links"), Node("a"))
    assert names(r, "a") == [("gamma",)]
    r = Rows(chain).match(Node("a", "Pod"), Hop("Sees"), Node("b", "Pod")).match(Node("r", "ReplicaSet"), Hop("Manages"), Node("b"))
    assert names(r, "a", "b", "r") == [("gamma", "alpha", "rs")]


def test_unique_edges(chain):
    path = (Node("a", "ReplicaSet"), Hop("Manages"), Node(label="Pod"), Hop("Manages", "in"), Node("b", "ReplicaSet"))
    assert len(names(Rows(chain).match(*path), "a", "b")) == 2
    assert names(Rows(chain).match(*path, unique_edges=True), "a", "b") == []


def test_unwind(chain):
    assert rows(Rows(chain).unwind(F.array(F.lit(1), F.lit(2)), "x").returns({"x": F.col("x")})) == [(1,), (2,)]
    assert rows(Rows(chain).unwind(F.array().cast("array<int>"), "x").returns({"x": F.col("x")})) == []
    assert rows(Rows(chain).unwind(F.lit(5), "x").returns({"x": F.col("x")})) == [(5,)]
    assert rows(Rows(chain).unwind(F.lit(None).cast("int"), "x").returns({"x": F.col("x")})) == []


def test_clause_order_and_empty_aggregate_in_both_modes(chain):
    for compat, want, empty in ((False, [], [(0,)]), (True, [("beta",)], [])):
        r = Rows(chain, compat=compat).match(Node("p", "Pod"))
        out = r.with_(lambda v: {"name": v.p["name"]}, order_by=[F.asc("name")], limit=1, where=lambda v: F.col("name") == "beta")
        assert rows(out.returns({"name": F.col("name")})) == want
        none = r.where(lambda v: v.p["name"] == "zzz")
        assert rows(none.returns(aggs={"n": F.count(F.lit(1))})) == empty


def test_collect_keeps_order_and_nulls(chain):
    r = Rows(chain).match(Node("p", "Pod"))
    out = r.returns(aggs=lambda v: {"a": collect(v.p["namespace"], v.p["name"]), "b": collect(v.p["namespace"], v.p["name"], keep_nulls=True)})
    assert rows(out) == [(["ns1", "ns2"], ["ns1", "ns2", None])]


def test_whole_variables_and_paging(chain):
    out = Rows(chain).match(Node("p", "Pod")).returns(lambda v: {"p": v.p}, order_by=[F.asc("p__name")], skip=1, limit=1).first()
    assert (out["p"]["uid"], out["p"]["label"]) == ("p2", "Pod")


def test_schema_triples():
    known = set(LABELS) | set(LOGICAL_LABELS)
    assert len(SCHEMA_TRIPLES) == 77 == len(set(SCHEMA_TRIPLES))
    assert all(s in known and d in known and t in EDGE_TYPES for s, t, d in SCHEMA_TRIPLES)


def test_source_less_pipeline(chain):
    """Before any clause there is one row."""
    assert rows(Rows(chain).returns({"x": F.lit(1), "y": F.lit("a")})) == [(1, "a")]
    assert rows(Rows(chain).returns(aggs={"n": F.count(F.lit(1))})) == [(1,)]
    assert rows(Rows(chain).where(F.lit(False)).returns({"x": F.lit(1)})) == []
    assert rows(Rows(chain).with_({"x": F.lit(2)}).unwind(F.array(F.col("x"), F.lit(3)), "y").returns({"x": F.col("x"), "y": F.col("y")})) == [(2, 2), (2, 3)]


def test_default_names(chain):
    r = Rows(chain).match(Node("p", "Pod"))
    out = r.returns(lambda v: [v.p, v.p["name"], F.upper(v.p["namespace"]), v.p["namespace"] == "ns1"])
    assert out.columns == ["p", "name", "upper", "expr_3"]
    assert r.returns(lambda v: [v.p["namespace"]], lambda v: [F.count(F.lit(1)), F.min(v.p["name"])]).columns == ["namespace", "count", "min"]
    renamed = r.with_(lambda v: {"q": v.p, "m": F.create_map(F.lit("k"), v.p["name"])})
    assert renamed.returns(lambda v: [v.q["name"], F.col("m"), F.lit(1) + F.lit(2)]).columns == ["name", "m", "expr_2"]
    with pytest.raises(ValueError, match="called name"):
        r.returns(lambda v: [v.p["name"], v.p["name"]])
    twice = Rows(chain, compat=True).match(Node("p", "Pod"), Hop("Sees"), Node("q", "Pod")).returns(lambda v: [v.p["name"], v.q["name"]])
    assert twice.columns == ["name"] and rows(twice) == [("alpha",)]


def test_exists_of_a_node(chain):
    """Any node of the label will do; its condition may use the rows' variables."""
    r = Rows(chain).match(Node("d", "Deployment"))
    assert names(r.exists(Node(label="Pod")), "d") == [("alone",), ("deploy",)]
    assert names(r.exists(Node("p", "Pod"), where=lambda v: v.p["name"] == "nobody"), "d") == []
    assert names(r.exists(Node("q", "ReplicaSet"), where=lambda v: (v.q["namespace"] == v.d["namespace"]) & (v.d["name"] == "deploy")), "d") == [("deploy",)]
    assert names(r.not_exists(Node("q", "Pod"), where=lambda v: v.q["namespace"] == v.d["namespace"]), "d") == []
    bound = Rows(chain).match(Node("p", "Pod"))
    assert names(bound.exists(Node("p", "Pod"), where=lambda v: v.p["name"] != "beta"), "p") == [("alpha",), ("gamma",)]


def test_exists_in_an_expression_with_outer_variables(chain):
    r = Rows(chain).match(Node("d", "Deployment"))
    hop = (Node("d"), Hop("Manages"), Node("r", "ReplicaSet"))
    flagged = r.exists_flag("same", *hop, where=lambda v: v.r["namespace"] == v.d["namespace"], outer=True)
    out = flagged.returns(lambda v: {"d": v.d["name"], "x": F.col("same") | (v.d["name"] == "alone")})
    assert rows(out) == [("alone", True), ("deploy", True)]
    other = r.exists_flag("other", *hop, where=lambda v: v.r["namespace"] != v.d["namespace"], outer=True)
    assert rows(other.returns(lambda v: {"d": v.d["name"], "other": F.col("other")})) == [("alone", False), ("deploy", False)]


def test_bound_node_is_checked_again(chain):
    r = Rows(chain).match(Node("d", "Deployment")).match(Node("d"), Hop("Manages"), Node("r", "ReplicaSet"), optional=True)
    assert names(r.match(Node("d", "Deployment")), "d") == [("alone",), ("deploy",)]
    assert names(r.match(Node("r", "ReplicaSet")), "d") == [("deploy",)]  # a null binding goes
    assert names(r.match(Node("d", "Pod")), "d") == []  # the label has to fit


def test_a_node_without_label_scans_what_its_hops_allow(spark, chain):
    assert chain.end_labels("manages", "out", None, None) == ({"Deployment", "ReplicaSet"}, {"ReplicaSet", "Pod"})
    assert chain.end_labels("Links", "both", None, None) == ({"Pod"}, {"Pod"})
    assert chain.end_labels("Manages", "in", "Pod", None) == ({"Pod"}, {"ReplicaSet"})
    assert names(Rows(chain).match(Node("a"), Hop("Manages"), Node("b"), Hop("Manages"), Node("c")), "a", "b", "c") == [("deploy", "rs", "alpha")]
    assert names(Rows(chain).match(Node("a"), Hop("Manages", "both"), Node("p", "Pod")), "a", "p") == [("rs", "alpha"), ("rs2", "beta")]
    assert names(Rows(chain).match(Node("a"), Hop(), Node("b")), "a", "b") == sorted(
        [("deploy", "rs"), ("rs", "alpha"), ("rs2", "beta"), ("gamma", "gamma"), ("gamma", "alpha")], key=str)
    # no edge of the type into that label: no rows, whatever is scanned
    assert names(Rows(chain).match(Node("a"), Hop("Sees"), Node("b", "Deployment")), "a") == []


def test_unlabelled_ends_leave_other_tables_unread(spark):
    from loomgraph.plans import retail

    plan = retail.queries()["q_hop_both"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" in plan and "s_suppkey" in plan
    assert not any(x in plan for x in ("o_orderkey", "p_partkey", "event_id"))


def test_keys_in_a_condition_are_joined_on(spark):
    """A condition that relates two nodes is no nested loop; where it is null, nothing is met."""
    people = spark.createDataFrame([(1, "a", None, None, 5), (2, "b", None, None, None), (None, "c", None, None, 9)], "uid long, name string, namespace string, resource_version string, k int")
    things = spark.createDataFrame([(11, "x", None, None, 5), (12, "y", None, None, None), (13, "z", None, None, 7)], "uid long, name string, namespace string, resource_version string, k int")
    rows, same = Rows(Graph({"A": people, "B": things})).match(Node("a", "A")), lambda v: v.a["k"] == v.b["k"]
    names = lambda r: sorted(x[0] for x in r.df.select("a__name").collect())
    for found, want in ((rows.exists(Node("b", "B"), where=same), ["a"]), (rows.not_exists(Node("b", "B"), where=same), ["b", "c"]),
                        (rows.match(Node("b", "B"), where=same, optional=True, allow_cross=True), ["a", "b", "c"])):
        assert "NestedLoop" not in found.df._jdf.queryExecution().executedPlan().toString()
        assert names(found) == want
