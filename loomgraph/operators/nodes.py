"""Node construction from an observed snapshot."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.model import Graph, Tables, union_all
from loomgraph.sources.scratch import stored
from loomgraph.sources.snapshot import ORDINAL, cleanup_metadata, place


def meta(name: str) -> Column:
    return F.col(f"metadata.{name}")


class Derived:
    """The nodes that objects imply, with the links by which their edges are built; each table is made when it is
    asked for. With ``store`` the endpoints, which need shuffles, are written there and read back."""

    def __init__(self, snapshot: dict[str, DataFrame], store: str | None = None):
        self.snapshot, self.store = snapshot, store

    @cached_property
    def containers(self) -> DataFrame:
        return containers(self.snapshot["Pod"])

    @cached_property
    def hosts(self) -> DataFrame:
        return hosts(self.snapshot["Ingress"])

    @cached_property
    def backends(self) -> DataFrame:
        return backends(self.snapshot["Ingress"])

    @cached_property
    def endpoints(self) -> DataFrame:
        made = endpoints(self.snapshot["EndpointSlice"])
        return stored(made, f"{self.store}/endpoints", compression="zstd") if self.store else made

    @cached_property
    def addresses(self) -> DataFrame:
        return addresses(self.endpoints)

    @cached_property
    def provisioners(self) -> DataFrame:
        return self.snapshot["StorageClass"].where("provisioner is not null").select(F.col("provisioner").alias("uid"), F.col("provisioner").alias("name")).distinct()


def containers(pods: DataFrame) -> DataFrame:
    """One node per init and standard container of pods with name, namespace, uid and spec; of a pod's several of a name the last."""
    mark = lambda items, kind: F.transform(F.coalesce(items, F.array()), lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("c")))
    both = F.concat(mark(F.col("spec.initContainers"), "init"), mark(F.col("spec.containers"), "standard"))
    again = lambda x, y: x["kind"].eqNullSafe(y["kind"]) & x["c"]["name"].eqNullSafe(y["c"]["name"])
    last = F.filter(both, lambda x, i: ~F.exists(F.slice(both, i + 2, F.size(both)), lambda later: again(x, later)))
    both = F.when(F.size(both) < 2, both).otherwise(last)
    whole = meta("name").isNotNull() & meta("namespace").isNotNull() & meta("uid").isNotNull() & F.col("spec").isNotNull()
    rows = pods.where(whole).select(meta("uid").alias("pod_uid"), meta("name").alias("pod_name"), meta("namespace").alias("namespace"), F.explode(both).alias("x"))
    return rows.select(
        F.concat_ws(":", F.lit("Container"), "pod_uid", "x.kind", "x.c.name").alias("uid"),
        F.col("x.c.name").alias("name"),
        "namespace",
        F.initcap("x.kind").alias("container_type"),
        "pod_uid",
        "pod_name",
        F.col("x.c.image").alias("image"),
        F.col("x.c.resources").alias("resources"),
    )


def hosts(ingresses: DataFrame) -> DataFrame:
    """One node per ingress rule with a host."""
    rules = ingresses.select(meta("uid").alias("ingress_uid"), meta("namespace").alias("namespace"), F.explode("spec.rules").alias("rule"))
    return rules.where(F.col("rule.host").isNotNull()).select(
        F.concat_ws(":", F.lit("Host"), "ingress_uid", "rule.host").alias("uid"), F.col("rule.host").alias("name"), "namespace", "ingress_uid"
    ).distinct()


def backends(ingresses: DataFrame) -> DataFrame:
    """One node per ingress and service; of several paths to it the last one counts."""
    rules = ingresses.select(meta("uid").alias("ingress_uid"), meta("namespace").alias("namespace"), F.posexplode("spec.rules").alias("_r", "rule"))
    paths = rules.select("ingress_uid", "namespace", "_r", F.posexplode("rule.http.paths").alias("_p", "path"))
    service = F.col("path.backend.service")
    rows = paths.where(service.isNotNull()).select("ingress_uid", "namespace", service["name"].alias("name"), F.struct("_r", "_p").alias("_o"), service["port"].alias("port"), F.col("path.path").alias("path"))
    last = rows.groupBy("ingress_uid", "namespace", "name").agg(F.max_by(F.struct("port", "path"), "_o").alias("x"))
    return last.select(F.concat_ws(":", F.lit("IngressServiceBackend"), "ingress_uid", "name").alias("uid"), "name", "namespace", "ingress_uid", "x.*")


def endpoint_hash(e: Column) -> Column:
    """The same for any order of the addresses; nulls and separators keep the fields apart."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit("\x00"))
    zones = F.transform(e["hints"]["forZones"], lambda z: z["name"])
    target = e["targetRef"]
    return F.xxhash64(
        F.array_join(F.sort_array(e["addresses"]), "\x1f"),
        *[text(e["conditions"][c]) for c in ("ready", "serving", "terminating")],
        F.coalesce(F.array_join(F.sort_array(zones), "\x1f"), F.lit("\x00")),
        *[text(e[c]) for c in ("hostname", "nodeName", "zone")],
        *[text(target[c]) for c in ("kind", "namespace", "name", "uid")],
    )


def endpoints(slices: DataFrame) -> DataFrame:
    rows = slices.select(meta("uid").alias("slice_uid"), meta("namespace").alias("namespace"), "addressType", F.explode("endpoints").alias("e"))
    uid = F.concat_ws(":", F.lit("Endpoint"), "slice_uid", "addressType", endpoint_hash(F.col("e")).cast("string"))
    return rows.select(uid.alias("uid"), F.lit("").alias("name"), "namespace", "slice_uid", "e").dropDuplicates(["uid"])


def addresses(found: DataFrame) -> DataFrame:
    """One node per address of ``endpoints``, whose uids are distinct; only a pod as target gives a ``pod_uid``."""
    target = F.col("e.targetRef")
    rows = found.select(F.col("uid").alias("endpoint_uid"), "namespace", "slice_uid", F.when(target["kind"] == "Pod", target["uid"]).alias("pod_uid"), F.explode(F.array_distinct("e.addresses")).alias("address"))
    return rows.select(F.concat_ws(":", F.lit("EndpointAddress"), "endpoint_uid", "address").alias("uid"), F.col("address").alias("name"), "namespace", "endpoint_uid", "slice_uid", "pod_uid")


def observed_nodes(kind: str, objects: DataFrame, *, unique: bool = False) -> DataFrame:
    """Objects of a kind as nodes with their typed fields and cleaned metadata; of those of one uid the last
    in the order of the objects; ``unique`` says that there is one each. Those without uid are left to
    ``without_uid``."""
    objects = cleanup_metadata(objects)
    version = F.lit(None).cast("string") if kind == "Event" else meta("resourceVersion")
    nodes = objects.where(meta("uid").isNotNull()).select(
        meta("uid").alias("uid"), meta("name").alias("name"), meta("namespace").alias("namespace"), version.alias("resource_version"),
        *[c for c in objects.columns if c not in ("metadata", ORDINAL)], F.col("metadata"), place(objects).alias("_at"),
    )
    return nodes.drop("_at") if unique else upsert(nodes, F.col("_at")).drop("_at")


def without_uid(snapshot: dict[str, DataFrame]) -> DataFrame:
    """Rejected objects: ``(rule, kind, uid)`` with the name in place of the uid."""
    return union_all([df.where(meta("uid").isNull()).select(F.lit("uid").alias("rule"), F.lit(k).alias("kind"), meta("name").alias("uid"))
                      for k, df in snapshot.items() if k != "Cluster"])


def cluster_node(cluster: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return cluster.select(F.concat(F.lit("Cluster:"), F.col("name")).alias("uid"), "name", none.alias("namespace"), none.alias("resource_version"), "cluster_url", "info")


def upsert(nodes: DataFrame, order: Column) -> DataFrame:
    """Of several rows of a uid the last by ``order``."""
    rest = [c for c in nodes.columns if c != "uid"]
    return nodes.groupBy("uid").agg(F.max_by(F.struct(*rest), order).alias("_x")).select("uid", "_x.*").select(*nodes.columns)


def one_label_per_uid(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A uid under several labels stays under the last of them, in the order of the tables.

    Only uids are shuffled; the few that come again are taken out of the tables where they lose.
    """
    places = union_all([t.select("uid", F.lit(i).alias("_i")) for i, t in enumerate(tables.values())])
    again = places.groupBy("uid").agg(F.max("_i").alias("_last"), F.min("_i").alias("_first")).where("_first <> _last")
    loses = lambda i: again.where((F.col("_first") <= i) & (F.col("_last") > i)).select("uid")
    return {label: t.join(loses(i), "uid", "left_anti") for i, (label, t) in enumerate(tables.items())}


def kinds_with_repeated_uids(snapshot: dict[str, DataFrame]) -> set[str]:
    """The kinds that hold a uid that comes again, in them or in another; only uids are shuffled."""
    uids = union_all([df.select(meta("uid").alias("uid"), F.lit(k).alias("kind")) for k, df in snapshot.items() if k != "Cluster"])
    again = uids.where("uid is not null").groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.collect_set("kind").alias("kinds")).where("n > 1")
    return {r[0] for r in again.select(F.explode("kinds")).distinct().collect()}  # names of kinds


def derived_tables(derived: Derived) -> dict[str, Callable[[], DataFrame]]:
    """The tables of the nodes that objects imply, by label."""
    links = {"pod_uid", "ingress_uid", "slice_uid", "endpoint_uid", "e"}
    found = {"Container": "containers", "Host": "hosts", "IngressServiceBackend": "backends", "Endpoint": "endpoints", "EndpointAddress": "addresses", "Provisioner": "provisioners"}

    def table(label: str) -> DataFrame:
        df, none = getattr(derived, found[label]), F.lit(None).cast("string")
        namespace = F.col("namespace") if "namespace" in df.columns else none
        more = [c for c in df.columns if c not in {"uid", "name", "namespace", *links}]
        if label == "Endpoint":
            more = [F.col("e.nodeName").alias("node_name"), F.col("e.targetRef").alias("target_ref"), F.col("e.addresses").alias("addresses")]
        return df.select("uid", "name", namespace.alias("namespace"), none.alias("resource_version"), *more)

    return {label: lambda label=label: table(label) for label in found}


def node_tables(snapshot: dict[str, DataFrame], derived: Derived, repeated: set[str]) -> dict[str, DataFrame]:
    """All node tables by label, each uid once. ``repeated`` names the kinds where uids come again."""
    tables = {k: observed_nodes(k, df, unique=k not in repeated) for k, df in snapshot.items() if k != "Cluster"}
    if repeated:
        tables |= one_label_per_uid({k: t for k, t in tables.items() if k in repeated})
    tables["Cluster"] = cluster_node(snapshot["Cluster"])
    return tables | {label: made() for label, made in derived_tables(derived).items()}


def build_graph(snapshot: dict[str, DataFrame], *, compat: bool = False, store: str | None = None, distinct_uids: bool = False) -> tuple[Graph, DataFrame]:
    """The graph of a snapshot, and what was rejected: ``(rule, kind, uid)``.

    With ``store``, a path, the objects, the nodes and the edges are written there and read back, which keeps
    later plans short; else all is lazy but for a look at the uids. Rejected are objects without uid, references that lead nowhere
    and edges whose triple the schema doesn't have.

    ``distinct_uids`` says that no uid comes twice, in the objects and in what they imply. Then every table is made from the
    objects when a pattern asks for it, and only endpoints and checked edges are kept in ``store``.
    """
    from loomgraph.operators import edges as rules
    from loomgraph.operators.model import SCHEMA_TRIPLES

    if distinct_uids:
        derived = Derived(snapshot, store)
        made = {k: lambda k=k: observed_nodes(k, snapshot[k], unique=True) for k in snapshot if k != "Cluster"}
        tables = Tables({**made, "Cluster": lambda: cluster_node(snapshot["Cluster"]), **derived_tables(derived)})
        lazy = rules.LazyEdges(snapshot, derived, tables, compat=compat, store=store)
        graph = Graph(tables, lazy.raw_tables(), claims=rules.CLAIMS, checked=lazy.checked)
        return graph, lazy.rejects().unionByName(without_uid(snapshot))
    keep = (lambda df, name: stored(df, f"{store}/{name}")) if store else (lambda df, name: df)
    snapshot = {k: keep(df, f"objects/{k}") for k, df in snapshot.items()}
    derived = Derived(snapshot, store)
    repeated = kinds_with_repeated_uids(snapshot)
    tables = node_tables(snapshot, derived, repeated)
    tables |= {k: keep(tables[k], f"tables/{k}") for k in repeated}
    nodes = keep(union_all([t.select("uid", "name", "namespace", F.lit(x).alias("label")) for x, t in tables.items()]), "identities")
    found = rules.build_edges(snapshot, derived, nodes, compat=compat)
    graph = Graph(tables, dict.fromkeys(SCHEMA_TRIPLES), keep(found.edges, "edges"))
    return graph, found.rejects.unionByName(without_uid(snapshot))
