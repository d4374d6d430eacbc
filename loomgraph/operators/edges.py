"""Edge rules of the cluster inventory, and the filters that every edge passes."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.model import EDGE_COLUMNS, LABELS, LOGICAL_LABELS, SCHEMA_TRIPLES, Tables, triples_frame, union_all
from loomgraph.operators.nodes import Derived, meta
from loomgraph.sources.scratch import stored
from loomgraph.sources.snapshot import place

OWNED = ("Pod", "ReplicaSet", "StatefulSet", "DaemonSet", "Deployment", "EndpointSlice", "PersistentVolumeClaim", "Ingress")
NOT_PART_OF = ("Event", "Cluster", "Host", "IngressServiceBackend", "Endpoint", "EndpointAddress")


def edge(src: Column, src_label: str | Column, etype: str, dst: Column, dst_label: str | Column) -> list[Column]:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    made = (src, as_column(src_label), F.lit(etype), dst, as_column(dst_label))
    return [*[c.alias(n) for c, n in zip(made, EDGE_COLUMNS, strict=True)], F.lit(RULES.index(etype) + 1).alias("ord")]


def name_lookup(items: DataFrame, *, by_namespace: bool) -> DataFrame:
    """``(_name, [_ns,] _uid)``: of several objects of a name the last in their order. Without ``by_namespace`` names
    are looked up across namespaces, as the embedded engine does."""
    keys = [F.col("metadata.name").alias("_name")] + [F.col("metadata.namespace").alias("_ns")] * by_namespace
    named = items.where(meta("name").isNotNull() & meta("uid").isNotNull())
    placed = named.select(*keys, meta("uid").alias("_uid"), place(items).alias("_at"))
    return placed.groupBy(*[c for c in placed.columns if c not in ("_uid", "_at")]).agg(F.max_by("_uid", "_at").alias("_uid"))


@dataclass
class EdgeSet:
    """The edges that pass all filters, and references that led nowhere: ``(rule, kind, uid)``."""

    edges: DataFrame
    rejects: DataFrame


#: The rules by edge type; of several edges between two nodes that of the last rule here counts.
RULES = ("PartOf", "BelongsTo", "Manages", "Runs", "RunsOn", "ClaimsVolume", "UsesStorageClass", "BoundTo", "UsesProvisioner", "DefinesBackend",
         "TargetsService", "IsClaimedBy", "ContainsEndpoint", "HasAddress", "ListedIn", "IsAddressOf", "Concerns")
#: The rules that take an end and its label from what an object says: which end of ``(src, dst)``, and the labels a node
#: there must have for a later rule to give an edge between the same two nodes. All other ends are nodes by themselves.
CLAIMS: dict[str, tuple[int, frozenset[str]]] = {
    "Manages": (0, frozenset(("Container", "Pod", "Host", "EndpointAddress", "Event"))),
    "BoundTo": (0, frozenset(("EndpointAddress", "Event"))),
    "IsAddressOf": (1, frozenset()),
    "Concerns": (1, frozenset()),
}


def rules(snapshot: dict[str, DataFrame], derived: Derived, nodes: Callable[[str | None], DataFrame], *, compat: bool = False, once: bool = False) -> dict[str, Callable[[str | None, str | None], DataFrame]]:
    """Edge type -> function of a source and a target label (None: any) that gives the rule's edges with ``ord``.

    Only rules with several triples look at the labels. ``nodes`` gives ``uid``, ``namespace`` and ``label`` of the nodes
    of a label, or of all. Ends that an object claims needn't be there. With ``once`` no two edges that one object gives
    are between the same two nodes.
    """

    def part_of(src: str | None, _: str | None) -> DataFrame:
        cluster = F.broadcast(nodes("Cluster").select(F.col("uid").alias("_cluster")))  # one row
        part = nodes(src).where(~F.col("label").isin(*NOT_PART_OF)).crossJoin(cluster)
        return part.select(*edge(F.col("uid"), F.col("label"), "PartOf", F.col("_cluster"), "Cluster"))

    def belongs_to(src: str | None, _: str | None) -> DataFrame:
        spaces = name_lookup(snapshot["Namespace"], by_namespace=False)
        inside = nodes(src).where(F.col("namespace").isNotNull() & ~F.col("label").isin("Event", *LOGICAL_LABELS[:5]))
        return inside.join(spaces, F.col("namespace") == F.col("_name")).select(*edge(F.col("uid"), F.col("label"), "BelongsTo", F.col("_uid"), "Namespace"))

    def manages(src: str | None, dst: str | None) -> DataFrame:
        found = []
        for kind in OWNED if dst is None else [dst]:
            # of an object's owners of one uid the last whose kind may own it
            allowed = [s for s, t, d in SCHEMA_TRIPLES if (t, d) == ("Manages", kind)]
            own = F.filter("metadata.ownerReferences", lambda o: o["kind"].isin(*allowed))  # noqa: B023
            last = F.filter(own, lambda o, i: ~F.exists(F.slice(own, i + 2, F.size(own)), lambda later: later["uid"].eqNullSafe(o["uid"])))  # noqa: B023
            owners = snapshot[kind].select(meta("uid").alias("_item"), F.explode(F.when(F.size(own) < 2, own).otherwise(last) if once else own).alias("_o"))
            owners = owners if src is None else owners.where(F.col("_o.kind") == src)
            found.append(owners.select(*edge(F.col("_o.uid"), F.col("_o.kind"), "Manages", F.col("_item"), kind)))
        return union_all(found)

    def runs(*_) -> DataFrame:
        return derived.containers.select(*edge(F.col("uid"), "Container", "Runs", F.col("pod_uid"), "Pod"))

    def runs_on(*_) -> DataFrame:
        machines = name_lookup(snapshot["Node"], by_namespace=False)
        return snapshot["Pod"].join(machines, F.col("spec.nodeName") == F.col("_name")).select(*edge(meta("uid"), "Pod", "RunsOn", F.col("_uid"), "Node"))

    def claims_volume(*_) -> DataFrame:
        met = claims(snapshot, compat=compat, once=once).where(F.col("_uid").isNotNull())
        return met.select(*edge(F.col("_pod"), "Pod", "ClaimsVolume", F.col("_uid"), "PersistentVolumeClaim"))

    def uses_storage_class(*_) -> DataFrame:
        classes = name_lookup(snapshot["StorageClass"], by_namespace=False)
        met = snapshot["PersistentVolume"].join(classes, F.col("spec.storageClassName") == F.col("_name"))
        return met.select(*edge(meta("uid"), "PersistentVolume", "UsesStorageClass", F.col("_uid"), "StorageClass"))

    def bound_to(*_) -> DataFrame:
        return snapshot["PersistentVolume"].select(*edge(F.col("spec.claimRef.uid"), "PersistentVolumeClaim", "BoundTo", meta("uid"), "PersistentVolume"))

    def uses_provisioner(*_) -> DataFrame:
        return snapshot["StorageClass"].select(*edge(meta("uid"), "StorageClass", "UsesProvisioner", F.col("provisioner"), "Provisioner"))

    def defines_backend(*_) -> DataFrame:
        return derived.backends.select(*edge(F.col("ingress_uid"), "Ingress", "DefinesBackend", F.col("uid"), "IngressServiceBackend"))

    def targets_service(*_) -> DataFrame:
        services = name_lookup(snapshot["Service"], by_namespace=not compat)
        same = (F.col("name") == F.col("_name")) if compat else (F.col("name") == F.col("_name")) & (F.col("namespace") == F.col("_ns"))
        return derived.backends.join(services, same).select(*edge(F.col("uid"), "IngressServiceBackend", "TargetsService", F.col("_uid"), "Service"))

    def is_claimed_by(*_) -> DataFrame:
        return derived.hosts.select(*edge(F.col("uid"), "Host", "IsClaimedBy", F.col("ingress_uid"), "Ingress"))

    def contains_endpoint(*_) -> DataFrame:
        return derived.endpoints.select(*edge(F.col("slice_uid"), "EndpointSlice", "ContainsEndpoint", F.col("uid"), "Endpoint"))

    def has_address(*_) -> DataFrame:
        return derived.addresses.select(*edge(F.col("endpoint_uid"), "Endpoint", "HasAddress", F.col("uid"), "EndpointAddress"))

    def listed_in(*_) -> DataFrame:
        own = derived.addresses
        own = own.where(~F.col("pod_uid").eqNullSafe(F.col("slice_uid"))) if once else own  # there ``is_address_of`` comes later
        return own.select(*edge(F.col("uid"), "EndpointAddress", "ListedIn", F.col("slice_uid"), "EndpointSlice"))

    def is_address_of(*_) -> DataFrame:
        return derived.addresses.select(*edge(F.col("uid"), "EndpointAddress", "IsAddressOf", F.col("pod_uid"), "Pod"))

    def concerns(_: str | None, dst: str | None) -> DataFrame:
        about = F.col("regarding.kind")
        made = snapshot["Event"].where(about.isin(*LABELS) if dst is None else about == dst)
        return made.select(*edge(meta("uid"), "Event", "Concerns", F.col("regarding.uid"), about))

    made = (part_of, belongs_to, manages, runs, runs_on, claims_volume, uses_storage_class, bound_to, uses_provisioner, defines_backend,
            targets_service, is_claimed_by, contains_endpoint, has_address, listed_in, is_address_of, concerns)
    both = F.col("src").isNotNull() & F.col("dst").isNotNull()
    return {etype: lambda src=None, dst=None, rule=rule: rule(src, dst).where(both) for etype, rule in zip(RULES, made, strict=True)}


def claims(snapshot: dict[str, DataFrame], *, compat: bool, once: bool) -> DataFrame:
    """The claims that pods name, with ``_uid`` null where there is none; ``once`` takes a name once per pod."""
    names = F.transform("spec.volumes", lambda v: v["persistentVolumeClaim"]["claimName"])
    named = snapshot["Pod"].select(meta("uid").alias("_pod"), meta("namespace").alias("_in"), F.explode(F.array_distinct(names) if once else names).alias("_claim"))
    volumes = name_lookup(snapshot["PersistentVolumeClaim"], by_namespace=not compat)
    same = (F.col("_claim") == F.col("_name")) if compat else (F.col("_claim") == F.col("_name")) & (F.col("_in") == F.col("_ns"))
    return named.where(F.col("_claim").isNotNull()).join(volumes, same, "left")


def lost_references(snapshot: dict[str, DataFrame], every: DataFrame, *, compat: bool = False) -> DataFrame:
    """References that lead nowhere, and those of ``every`` whose triple the schema doesn't have: ``(rule, kind, uid)``."""
    known, rejects = F.col("_o.kind").isin(*LABELS), []
    for kind in OWNED:
        owners = snapshot[kind].select(meta("uid").alias("_item"), F.explode("metadata.ownerReferences").alias("_o"))
        rejects.append(owners.where(~known).select(F.lit("Manages").alias("rule"), F.col("_o.kind").alias("kind"), F.col("_item").alias("uid")))
        ours = [s for s, t, d in SCHEMA_TRIPLES if (t, d) == ("Manages", kind)]
        outside = owners.where(known & ~F.col("_o.kind").isin(*ours) & F.col("_o.uid").isNotNull() & F.col("_item").isNotNull())
        rejects.append(outside.select(F.lit("schema").alias("rule"), F.concat_ws(" ", "_o.kind", F.lit("Manages"), F.lit(kind)).alias("kind"), F.col("_o.uid").alias("uid")))
    found = claims(snapshot, compat=compat, once=False).where(F.col("_uid").isNull())
    rejects.append(found.select(F.lit("ClaimsVolume").alias("rule"), F.lit("PersistentVolumeClaim").alias("kind"), F.col("_pod").alias("uid")))
    about = snapshot["Event"].where(F.col("regarding.uid").isNotNull() & ~F.col("regarding.kind").isin(*LABELS))
    rejects.append(about.select(F.lit("Concerns").alias("rule"), F.col("regarding.kind").alias("kind"), meta("uid").alias("uid")))
    return union_all([*rejects, outside_schema(every, triples_frame(every.sparkSession, SCHEMA_TRIPLES))])


def build_edges(snapshot: dict[str, DataFrame], derived: Derived, nodes: DataFrame, *, compat: bool = False, multi: bool = False) -> EdgeSet:
    """All rules over an observed snapshot, in the reference order of precedence.

    ``compat`` looks services and claims up by name only. ``multi`` keeps several types between two nodes;
    else the last rule wins.
    """
    made = rules(snapshot, derived, lambda label: nodes if label is None else nodes.where(F.col("label") == label), compat=compat)
    every = union_all([rule() for rule in made.values()])
    triples = triples_frame(nodes.sparkSession, SCHEMA_TRIPLES)
    kept = without_dangling(only_known(every, triples), nodes)
    lost = lost_references(snapshot, union_all([rule() for etype, rule in made.items() if etype != "Manages"]), compat=compat)
    return EdgeSet((kept.drop("ord").distinct() if multi else one_per_pair(kept)).select(*EDGE_COLUMNS), lost)


class LazyEdges:
    """The edges of a snapshot whose uids are all distinct, each table made when it is asked for.

    Rules whose ends are nodes by themselves give no edge twice and none that another rule gives, so nothing is
    shuffled for them. An end that an object claims (``CLAIMS``) is met with the nodes by ``checked``, unless the
    reader of the table does that anyway.
    """

    def __init__(self, snapshot: dict[str, DataFrame], derived: Derived, tables: Mapping[str, DataFrame], *, compat: bool = False, store: str | None = None):
        self.tables, self.store, self.snapshot, self.compat = tables, store, snapshot, compat
        self.rules = rules(snapshot, derived, self.identities, compat=compat, once=True)
        self._checked: dict[str, DataFrame] = {}

    def identities(self, label: str | None = None) -> DataFrame:
        of = lambda x: self.tables[x].select("uid", "namespace", F.lit(x).alias("label"))
        return of(label) if label is not None else union_all([of(x) for x in self.tables])

    def raw(self, src: str, etype: str, dst: str) -> DataFrame:
        """The edges of a triple, with claimed ends as they are; no rows for labels that no table or rule has."""
        there = etype in self.rules and (etype not in ("PartOf", "BelongsTo") or src in self.tables) and (etype != "Manages" or dst in OWNED)
        if there:
            return self.rules[etype](src, dst).select("src", "dst")
        return next(iter(self.snapshot.values())).sparkSession.createDataFrame([], "src string, dst string")

    def raw_tables(self) -> Tables:
        return Tables({x: lambda x=x: self.raw(*x) for x in SCHEMA_TRIPLES})

    def checked(self, etype: str) -> DataFrame:
        """The edges of a rule with claims: claimed ends are nodes, and no later rule has an edge of the same two."""
        if etype not in self._checked:
            end = EDGE_COLUMNS[3 * CLAIMS[etype][0]]
            ids = self.identities().select(F.col("uid").alias("_uid"), F.col("label").alias("_label"))
            made = only_known(self.rules[etype](), triples_frame(ids.sparkSession, SCHEMA_TRIPLES)).select(*EDGE_COLUMNS)
            met = made.join(ids, F.col(end) == F.col("_uid")).select(*EDGE_COLUMNS, "_label")
            met = stored(met, f"{self.store}/checked/{etype}") if self.store else met
            twice = F.col("_label").isin(*CLAIMS[etype][1])
            if CLAIMS[etype][1] and not met.where(twice).isEmpty():
                later = [self.checked(t) if t in CLAIMS else self.rules[t]() for t in RULES[RULES.index(etype) + 1 :]]
                left = met.where(twice).join(union_all([x.select("src", "dst") for x in later]), ["src", "dst"], "left_anti")
                met = met.where(~twice).unionByName(left.select(*met.columns))
            self._checked[etype] = met.select(*EDGE_COLUMNS)
        return self._checked[etype]

    def rejects(self) -> DataFrame:
        """Fixed triples are all in the schema, so of the rules two can go beyond it."""
        spaced = [x for x in self.tables if (x, "BelongsTo", "Namespace") not in SCHEMA_TRIPLES]
        parts = [x for x in self.tables if (x, "PartOf", "Cluster") not in SCHEMA_TRIPLES and x not in NOT_PART_OF]
        odd = [self.rules["BelongsTo"](x) for x in spaced if x not in ("Event", *LOGICAL_LABELS[:5])] + [self.rules["PartOf"](x) for x in parts]
        return lost_references(self.snapshot, union_all([self.rules["Concerns"](), *odd]), compat=self.compat)


def only_known(edges: DataFrame, triples: DataFrame) -> DataFrame:
    """Edges of allowed triples; there are a few dozen of those, so their broadcast is bounded."""
    return edges.join(F.broadcast(triples), ["src_label", "etype", "dst_label"], "left_semi")


def outside_schema(edges: DataFrame, triples: DataFrame) -> DataFrame:
    """The edges that ``only_known`` drops, as rejects: their triple as the kind, their source as the uid."""
    left = edges.join(F.broadcast(triples), ["src_label", "etype", "dst_label"], "left_anti")
    return left.select(F.lit("schema").alias("rule"), F.concat_ws(" ", "src_label", "etype", "dst_label").alias("kind"), F.col("src").alias("uid"))


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes. No aggregate stands beside the joins, so that a hub's edges can be split."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("uid").alias(end)), end, "left_semi")
    return edges


def one_per_pair(edges: DataFrame) -> DataFrame:
    """One edge per ordered pair of nodes: the one of the highest ``ord``. Combined on the map side, so a hub
    with many edges to one node is no hot key."""
    last = F.max_by(F.struct("src_label", "etype", "dst_label"), F.struct("ord", "etype"))
    return edges.groupBy("src", "dst").agg(last.alias("_e")).select("src", "dst", "_e.*")
