"""The evaluation's questions about a cluster as named queries over its graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.exprs import quantity
from loomgraph.operators.match import Hop, Node, Rows
from loomgraph.operators.model import Graph

QUESTIONS: dict[str, Callable[..., DataFrame]] = {}
#: The namespace that a question is about unless told otherwise: the one that every cluster has.
NAMESPACE = "default"


def _ask(name: str):
    def register(f):
        QUESTIONS[name] = f
        return f

    return register


def _inside(g: Graph, var: str, label: str, namespace: str) -> Rows:
    """Objects of a label in a namespace, filtered before any hop."""
    return Rows(g).match(Node(var, label), where=lambda v: v[var]["namespace"] == namespace)


def _names(rows: Rows, **columns: str) -> DataFrame:
    return rows.returns(lambda v: {k: v[x]["name"] for k, x in columns.items()})


# easy: all of a label, in the cluster or in a namespace
for _id, _label in {"e01": "Namespace", "e07": "Node", "e08": "StorageClass", "e09": "PersistentVolume"}.items():
    QUESTIONS[_id] = lambda g, _label=_label: _names(Rows(g).match(Node("x", _label)), name="x")
for _id, _label in {"e03": "Pod", "e04": "Service", "e05": "Ingress", "e06": "EndpointSlice", "e10": "ServiceAccount",
                    "e11": "Deployment", "e12": "ReplicaSet", "e13": "StatefulSet", "e14": "DaemonSet", "e15": "Job",
                    "e16": "PersistentVolumeClaim", "e18": "ConfigMap", "e19": "NetworkPolicy", "e20": "Container"}.items():
    QUESTIONS[_id] = lambda g, namespace=NAMESPACE, _label=_label: _names(_inside(g, "x", _label, namespace), name="x")
QUESTIONS["e02"] = lambda g: Rows(g).match(Node("x", "Namespace")).returns(aggs={"n": F.count(F.lit(1))})
QUESTIONS["e17"] = lambda g, namespace=NAMESPACE: _inside(g, "x", "Pod", namespace).returns(aggs={"n": F.count(F.lit(1))})

# medium: one hop from a label in a namespace to another
for _id, (_a, _hop, _b) in {
    "m01": ("Deployment", Hop("Manages"), "ReplicaSet"), "m02": ("ReplicaSet", Hop("Manages"), "Pod"),
    "m03": ("DaemonSet", Hop("Manages"), "Pod"), "m04": ("StatefulSet", Hop("Manages"), "Pod"), "m05": ("Job", Hop("Manages"), "Pod"),
    "m06": ("Service", Hop("Manages"), "EndpointSlice"), "m09": ("PersistentVolumeClaim", Hop("BoundTo"), "PersistentVolume"),
    "m11": ("Pod", Hop("RunsOn"), "Node"), "m12": ("Pod", Hop("ClaimsVolume"), "PersistentVolumeClaim"),
    "m13": ("Container", Hop("Runs"), "Pod"), "m17": ("Service", Hop("Concerns", "in"), "Event"),
}.items():
    QUESTIONS[_id] = lambda g, namespace=NAMESPACE, _a=_a, _hop=_hop, _b=_b: _names(_inside(g, "a", _a, namespace).match(Node("a"), _hop, Node("b", _b)), a="a", b="b")

_TO_PODS = (Hop("Manages"), Node(label="EndpointSlice"), Hop("ContainsEndpoint"), Node(label="Endpoint"), Hop("HasAddress"),
            Node(label="EndpointAddress"), Hop("IsAddressOf"), Node("p", "Pod"))
_TO_SERVICE = (Hop("DefinesBackend"), Node("b", "IngressServiceBackend"), Hop("TargetsService"), Node("s", "Service"))


@_ask("m07")
def service_pods(g: Graph, namespace: str = NAMESPACE) -> DataFrame:
    rows = _inside(g, "s", "Service", namespace).match(Node("s"), *_TO_PODS)
    return rows.returns(lambda v: {"service": v.s["name"], "pod": v.p["name"]}, distinct=True)


@_ask("m08")
def pods_on_node(g: Graph, node: str) -> DataFrame:
    return _names(Rows(g).match(Node("n", "Node"), where=lambda v: v.n["name"] == node).match(Node("p", "Pod"), Hop("RunsOn"), Node("n")), pod="p")


@_ask("m10")
def pod_events(g: Graph, namespace: str = NAMESPACE) -> DataFrame:
    rows = _inside(g, "p", "Pod", namespace).match(Node("e", "Event"), Hop("Concerns"), Node("p"))
    return rows.returns(lambda v: {"pod": v.p["name"], "reason": v.e["reason"]})


@_ask("m14")
def container_logs(g: Graph, namespace: str = NAMESPACE) -> DataFrame:
    """Logs are no part of the graph: always null."""
    return _inside(g, "c", "Container", namespace).returns(lambda v: {"container": v.c["name"], "log": F.lit(None).cast("string")})


@_ask("m15")
def ingress_services(g: Graph, namespace: str = NAMESPACE) -> DataFrame:
    rows = _inside(g, "i", "Ingress", namespace).match(Node("i"), *_TO_SERVICE)
    return rows.returns(lambda v: {"ingress": v.i["name"], "service": v.s["name"]}, distinct=True)


@_ask("m16")
def slice_pods(g: Graph, namespace: str = NAMESPACE) -> DataFrame:
    rows = _inside(g, "x", "EndpointSlice", namespace).match(Node("x"), *_TO_PODS[2:])
    return rows.returns(lambda v: {"slice": v.x["name"], "pod": v.p["name"]}, distinct=True)


@_ask("m18")
def volume_classes(g: Graph) -> DataFrame:
    return _names(Rows(g).match(Node("v", "PersistentVolume"), Hop("UsesStorageClass"), Node("c", "StorageClass")), volume="v", storage_class="c")


def _count_per(g: Graph, label: str, hop: Hop, other: str) -> Rows:
    """Per node of a label the number of others, 0 included."""
    rows = Rows(g).match(Node("x", label)).match(Node("x"), hop, Node("y", other), optional=True)
    return rows.with_(lambda v: {"uid": v.x["uid"], "name": v.x["name"]}, lambda v: {"n": F.count(v.y["uid"])})


def _name_count(rows: Rows, **options) -> DataFrame:
    return rows.returns({"name": F.col("name"), "n": F.col("n")}, **options)


QUESTIONS["m19"] = lambda g: _name_count(_count_per(g, "Node", Hop("RunsOn", "in"), "Pod"))
QUESTIONS["m20"] = lambda g: _name_count(_count_per(g, "Namespace", Hop("BelongsTo", "in"), "Service"))


@_ask("h01")
def top_namespaces(g: Graph, k: int = 5) -> DataFrame:
    return _name_count(_count_per(g, "Namespace", Hop("BelongsTo", "in"), "Pod"), order_by=[F.desc("n"), F.asc("name")], limit=k)


@_ask("h02")
def busy_nodes(g: Graph, more_than: int = 50) -> DataFrame:
    return _name_count(_count_per(g, "Node", Hop("RunsOn", "in"), "Pod").where(F.col("n") > more_than))


@_ask("h03")
def namespace_memory(g: Graph) -> DataFrame:
    """Requested and limit memory in MiB over all containers of pods, by namespace."""
    rows = Rows(g).match(Node("c", "Container"), Hop("Runs"), Node(label="Pod"), Hop("BelongsTo"), Node("n", "Namespace"))
    mib = lambda kind: F.sum(quantity(F.col(f"c__resources.{kind}")["memory"], "Mi"))
    return rows.returns(lambda v: {"namespace": v.n["name"]}, {"requests_mib": mib("requests"), "limits_mib": mib("limits")})


@_ask("h04")
def services_without_slices(g: Graph, namespace: str = NAMESPACE) -> DataFrame:
    return _names(_inside(g, "s", "Service", namespace).not_exists(Node("s"), Hop("Manages"), Node(label="EndpointSlice")), service="s")


QUESTIONS["h11"] = lambda g, namespace=NAMESPACE: services_without_slices(g, namespace)


@_ask("h05")
def ingresses_with_endpoints(g: Graph, namespace: str = NAMESPACE) -> DataFrame:
    rows = _inside(g, "i", "Ingress", namespace).exists(Node("i"), *_TO_SERVICE, *_TO_PODS[:4])
    return _names(rows, ingress="i")


@_ask("h06")
def host_pods(g: Graph, host: str) -> DataFrame:
    rows = Rows(g).match(Node("h", "Host"), where=lambda v: v.h["name"] == host)
    rows = rows.match(Node("h"), Hop("IsClaimedBy"), Node(label="Ingress"), *_TO_SERVICE, *_TO_PODS)
    return rows.returns(lambda v: {"service": v.s["name"], "pod": v.p["name"]}, distinct=True)


@_ask("h07")
def service_ip_count(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("s", "Service")).match(Node("s"), *_TO_PODS, optional=True)
    return rows.returns(lambda v: {"uid": v.s["uid"], "service": v.s["name"]}, lambda v: {"ips": F.count_distinct(_field(v.p["status"], "podIP"))}).drop("uid")


def _field(struct: Column, name: str) -> Column:
    return struct.getField(name)


@_ask("h08")
def unready_deployments(g: Graph) -> DataFrame:
    ready = lambda v: F.coalesce(_field(v.d["status"], "readyReplicas"), F.lit(0)) < F.coalesce(_field(v.d["spec"], "replicas"), F.lit(1))
    return _names(Rows(g).match(Node("d", "Deployment"), where=ready), deployment="d")


@_ask("h09")
def bare_pods(g: Graph, namespace: str = NAMESPACE) -> DataFrame:
    rows = _inside(g, "p", "Pod", namespace)
    for kind in ("Deployment", "StatefulSet", "DaemonSet", "Job", "ReplicaSet"):
        rows = rows.not_exists(Node("p"), Hop("Manages", "in"), Node(label=kind))
    return _names(rows, pod="p")


@_ask("h10")
def claim_volumes(g: Graph, namespace: str = NAMESPACE) -> DataFrame:
    rows = _inside(g, "c", "PersistentVolumeClaim", namespace).match(Node("c"), Hop("BoundTo"), Node("v", "PersistentVolume"), optional=True)
    rows = rows.match(Node("v"), Hop("UsesStorageClass"), Node("k", "StorageClass"), optional=True)
    return _names(rows, claim="c", volume="v", storage_class="k")


@_ask("h12")
def backends_without_slices(g: Graph, namespace: str = NAMESPACE) -> DataFrame:
    rows = _inside(g, "i", "Ingress", namespace).match(Node("i"), *_TO_SERVICE)
    rows = rows.not_exists(Node("s"), Hop("Manages"), Node(label="EndpointSlice"))
    return rows.returns(lambda v: {"ingress": v.i["name"], "service": v.s["name"]}, distinct=True)


@_ask("h13")
def unbound_claims(g: Graph, namespace: str = NAMESPACE) -> DataFrame:
    return _names(_inside(g, "c", "PersistentVolumeClaim", namespace).not_exists(Node("c"), Hop("BoundTo"), Node(label="PersistentVolume")), claim="c")


@_ask("h14")
def pods_without_class(g: Graph, namespace: str = NAMESPACE) -> DataFrame:
    rows = _inside(g, "p", "Pod", namespace).match(Node("p"), Hop("ClaimsVolume"), Node(label="PersistentVolumeClaim"), Hop("BoundTo"), Node("v", "PersistentVolume"))
    rows = rows.not_exists(Node("v"), Hop("UsesStorageClass"), Node(label="StorageClass"))
    return rows.returns(lambda v: {"pod": v.p["name"]}, distinct=True)


@_ask("h15")
def spread_nodes(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("x", "Node"), Hop("RunsOn", "in"), Node(label="Pod"), Hop("BelongsTo"), Node("n", "Namespace"))
    rows = rows.with_(lambda v: {"name": v.x["name"]}, lambda v: {"n": F.count_distinct(v.n["uid"])})
    return _name_count(rows.where(F.col("n") > 1))


@_ask("h16")
def deployment_pods(g: Graph, namespace: str = NAMESPACE) -> DataFrame:
    rows = _inside(g, "d", "Deployment", namespace)
    rows = rows.match(Node("d"), Hop("Manages"), Node(label="ReplicaSet"), Hop("Manages"), Node("p", "Pod"), optional=True)
    return rows.returns(lambda v: {"deployment": v.d["name"]}, lambda v: {"n": F.count(v.p["uid"])})


@_ask("h17")
def warned_pods(g: Graph, namespace: str = NAMESPACE) -> DataFrame:
    return _names(_inside(g, "p", "Pod", namespace).exists(Node("e", "Event"), Hop("Concerns"), Node("p"), where=lambda v: v.e["type"] == "Warning"), pod="p")


@_ask("h18")
def namespaces_idle_services(g: Graph) -> DataFrame:
    idle = Rows(g).match(Node("s", "Service")).not_exists(Node("s"), Hop("Manages"), Node(label="EndpointSlice"))
    idle = idle.match(Node("s"), Hop("BelongsTo"), Node("m", "Namespace")).with_(lambda v: {"_of": v.m["uid"]}, {"_n": F.count(F.lit(1))})
    every = Rows(g).match(Node("x", "Namespace")).with_(lambda v: {"uid": v.x["uid"], "name": v.x["name"]})
    return every.df.join(idle.df, F.col("uid") == F.col("_of"), "left").select("name", F.coalesce("_n", F.lit(0)).alias("n"))


@_ask("h19")
def host_services(g: Graph) -> DataFrame:
    rows = Rows(g).match(Node("h", "Host"), Hop("IsClaimedBy"), Node(label="Ingress"), *_TO_SERVICE)
    return rows.returns(lambda v: {"host": v.h["name"], "service": v.s["name"]}, distinct=True)


@_ask("h20")
def service_phases(g: Graph, namespace: str = NAMESPACE) -> DataFrame:
    rows = _inside(g, "s", "Service", namespace).match(Node("s"), *_TO_PODS)
    return rows.returns(lambda v: {"service": v.s["name"], "phase": _field(v.p["status"], "phase")}, lambda v: {"n": F.count_distinct(v.p["uid"])})
