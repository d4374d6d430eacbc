"""The property graph: one typed table per node label, one edge table per (source, type, target) triple."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The labels, edge types and allowed triples of the cluster-inventory graph.
LABELS = (
    "Pod", "Deployment", "StatefulSet", "ReplicaSet", "DaemonSet", "Job",
    "Ingress", "Service", "EndpointSlice", "NetworkPolicy", "ConfigMap",
    "Provisioner", "StorageClass", "PersistentVolumeClaim", "PersistentVolume",
    "Node", "Namespace", "ServiceAccount", "Event", "AWX",
)
LOGICAL_LABELS = ("IngressServiceBackend", "EndpointAddress", "Endpoint", "Host", "Cluster", "Container")
EDGE_TYPES = (
    "PartOf", "BelongsTo", "Manages", "RunsOn", "Runs", "DefinesBackend", "TargetsService", "IsClaimedBy",
    "ListedIn", "IsAddressOf", "MountsConfig", "InjectsConfig", "UsesIdentity", "ClaimsVolume", "BoundTo",
    "UsesProvisioner", "UsesStorageClass", "AppliesTo", "Concerns", "ContainsEndpoint", "HasAddress",
)

Triple = tuple[str, str, str]
# What may point to what, as (source label, edge type, target label).
SCHEMA_TRIPLES: tuple[Triple, ...] = (
    ("AWX", "Manages", "Deployment"),
    ("AWX", "Manages", "Ingress"),
    ("ConfigMap", "PartOf", "Cluster"),
    ("ConfigMap", "BelongsTo", "Namespace"),
    ("Container", "PartOf", "Cluster"),
    ("Container", "BelongsTo", "Namespace"),
    ("Container", "Runs", "Pod"),
    ("DaemonSet", "PartOf", "Cluster"),
    ("DaemonSet", "BelongsTo", "Namespace"),
    ("DaemonSet", "Manages", "Pod"),
    ("Deployment", "Manages", "DaemonSet"),
    ("Deployment", "PartOf", "Cluster"),
    ("Deployment", "BelongsTo", "Namespace"),
    ("Deployment", "Manages", "ReplicaSet"),
    ("Deployment", "Manages", "Deployment"),
    ("Endpoint", "HasAddress", "EndpointAddress"),
    ("EndpointAddress", "ListedIn", "EndpointSlice"),
    ("EndpointAddress", "IsAddressOf", "Pod"),
    ("EndpointSlice", "PartOf", "Cluster"),
    ("EndpointSlice", "ContainsEndpoint", "Endpoint"),
    ("EndpointSlice", "BelongsTo", "Namespace"),
    ("Host", "IsClaimedBy", "Ingress"),
    ("Ingress", "PartOf", "Cluster"),
    ("Ingress", "DefinesBackend", "IngressServiceBackend"),
    ("Ingress", "BelongsTo", "Namespace"),
    ("IngressServiceBackend", "TargetsService", "Service"),
    ("Job", "PartOf", "Cluster"),
    ("Job", "BelongsTo", "Namespace"),
    ("Job", "Manages", "Pod"),
    ("Namespace", "PartOf", "Cluster"),
    ("NetworkPolicy", "PartOf", "Cluster"),
    ("NetworkPolicy", "BelongsTo", "Namespace"),
    ("Node", "PartOf", "Cluster"),
    ("Node", "Manages", "Pod"),
    ("PersistentVolume", "PartOf", "Cluster"),
    ("PersistentVolume", "UsesStorageClass", "StorageClass"),
    ("PersistentVolumeClaim", "PartOf", "Cluster"),
    ("PersistentVolumeClaim", "BelongsTo", "Namespace"),
    ("PersistentVolumeClaim", "BoundTo", "PersistentVolume"),
    ("Pod", "PartOf", "Cluster"),
    ("Pod", "BelongsTo", "Namespace"),
    ("Pod", "RunsOn", "Node"),
    ("Pod", "ClaimsVolume", "PersistentVolumeClaim"),
    ("Pod", "Manages", "PersistentVolumeClaim"),
    ("Provisioner", "PartOf", "Cluster"),
    ("ReplicaSet", "PartOf", "Cluster"),
    ("ReplicaSet", "BelongsTo", "Namespace"),
    ("ReplicaSet", "Manages", "Pod"),
    ("Service", "PartOf", "Cluster"),
    ("Service", "Manages", "EndpointSlice"),
    ("Service", "BelongsTo", "Namespace"),
    ("ServiceAccount", "PartOf", "Cluster"),
    ("ServiceAccount", "BelongsTo", "Namespace"),
    ("StatefulSet", "PartOf", "Cluster"),
    ("StatefulSet", "BelongsTo", "Namespace"),
    ("StatefulSet", "Manages", "Pod"),
    ("StorageClass", "PartOf", "Cluster"),
    ("StorageClass", "UsesProvisioner", "Provisioner"),
    ("Event", "Concerns", "Pod"),
    ("Event", "Concerns", "Deployment"),
    ("Event", "Concerns", "StatefulSet"),
    ("Event", "Concerns", "ReplicaSet"),
    ("Event", "Concerns", "DaemonSet"),
    ("Event", "Concerns", "Job"),
    ("Event", "Concerns", "Ingress"),
    ("Event", "Concerns", "Service"),
    ("Event", "Concerns", "EndpointSlice"),
    ("Event", "Concerns", "NetworkPolicy"),
    ("Event", "Concerns", "ConfigMap"),
    ("Event", "Concerns", "Provisioner"),
    ("Event", "Concerns", "StorageClass"),
    ("Event", "Concerns", "PersistentVolumeClaim"),
    ("Event", "Concerns", "PersistentVolume"),
    ("Event", "Concerns", "Node"),
    ("Event", "Concerns", "Namespace"),
    ("Event", "Concerns", "ServiceAccount"),
    ("Event", "Concerns", "AWX"),
)

NODE_COLUMNS = ("uid", "name", "namespace", "resource_version")
EDGE_COLUMNS = ("src", "src_label", "etype", "dst", "dst_label")


#: Times in JSON text keep their microseconds.
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _typed(table: DataFrame) -> Column:
    """The typed columns as JSON text."""
    more = [c for c in table.columns if c not in NODE_COLUMNS and c != "props"]
    return F.to_json(F.struct(*[f"`{c}`" for c in more]), MICROS) if more else F.lit("{}")


def _props(table: DataFrame) -> Column:
    """A node's properties as JSON text: its own ``props``, text or VARIANT, else its typed columns."""
    if "props" not in table.columns:
        return _typed(table)
    return F.to_json("props") if table.schema["props"].dataType.typeName() == "variant" else F.col("props")


def triples_frame(spark: SparkSession, triples: Iterable[Triple] = SCHEMA_TRIPLES) -> DataFrame:
    return spark.createDataFrame(list(triples), "src_label string, etype string, dst_label string")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class Tables(Mapping):
    """Tables by name, each made by its function when it is first asked for."""

    def __init__(self, made: dict[object, Callable[[], DataFrame]]):
        self._made, self._kept = made, {}

    def __getitem__(self, key) -> DataFrame:
        if key not in self._kept:
            self._kept[key] = self._made[key]()
        return self._kept[key]

    def __iter__(self) -> Iterator:
        return iter(self._made)

    def __len__(self) -> int:
        return len(self._made)


@dataclass
class Graph:
    """Node tables by label and edge tables by triple.

    A node table has ``uid``, ``name``, ``namespace`` and ``resource_version`` and any typed property columns;
    an edge table has ``src`` and ``dst``. A scan of a label or a hop of a type touches its tables only, and
    the properties keep their types, so filters and column pruning reach the files.
    """

    node_tables: Mapping[str, DataFrame]
    edge_tables: Mapping[Triple, DataFrame] = field(default_factory=dict)
    edge_table: DataFrame | None = None
    #: Edge types with an end, 0 the source and 1 the target, that ``edge_tables`` hold unchecked, and the labels of nodes there
    #: whose edges need a check nevertheless; ``checked`` gives all edges of such a type.
    claims: dict[str, tuple[int, frozenset[str]]] = field(default_factory=dict)
    checked: Callable[[str], DataFrame] | None = None

    @classmethod
    def from_tables(
        cls, nodes: DataFrame, edges: DataFrame, labels: Iterable[str], triples: Iterable[Triple], properties: dict[str, str] | None = None
    ) -> Graph:
        """From one ``nodes`` table (with ``label``) and one ``edges`` table, best partitioned by label and type.

        A scan or hop filters the one table, so a plan holds it once; ``triples`` are those a hop may use.
        ``properties`` gives labels typed columns (label -> DDL) that are read from ``stored_nodes``' JSON text.
        """
        tables = {x: nodes.where(F.col("label") == x).drop("label") for x in labels}
        for label, ddl in (properties or {}).items():
            table = tables[label]
            text = F.coalesce("typed", "props") if "typed" in table.columns else F.col("props")
            types = table.select(F.from_json(text, ddl).alias("_t")).schema["_t"].dataType
            # times are read apart from the rest, which needs no formats: a query that asks for no time doesn't read any
            part = lambda f: int("timestamp" in f.dataType.simpleString())
            fields = {i: [f for f in types if part(f) == i] for i in (0, 1)}
            schema = lambda i: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields[i])  # noqa: B023, E731
            read = table.withColumns({f"_typed{i}": F.from_json(text, schema(i), MICROS if i else {}) for i in (0, 1) if fields[i]})
            own = ["props"] if "typed" in table.columns and "props" in types.names else []
            named = [F.col(f"_typed{part(f)}.`{f.name}`").alias(f.name) for f in types if f.name not in own]
            tables[label] = read.select(*NODE_COLUMNS, *named, *own)
        return cls(tables, dict.fromkeys(triples), edges.select(*EDGE_COLUMNS))

    def properties(self) -> dict[str, str]:
        """Label -> DDL of its typed columns, for ``from_tables``."""
        more = {x: t.drop(*NODE_COLUMNS).schema for x, t in self.node_tables.items()}
        return {x: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) for x, schema in more.items() if schema}

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.node_tables.values())).sparkSession

    def check_label(self, label: str | None) -> None:
        if label is not None and label not in self.node_tables:
            raise ValueError(f"unknown label: {label}")

    def check_types(self, types: str | list[str] | None) -> None:
        """A type that no triple has, in any case of its letters, is an error."""
        known = {t.lower() for _, t, _ in self.edge_tables}
        for t in [types] if isinstance(types, str) else types or []:
            if t.lower() not in known:
                raise ValueError(f"unknown edge type: {t}")

    def nodes(self, label: str | None = None, among: Iterable[str] | None = None) -> DataFrame:
        """The nodes of a label with their properties, or all nodes, or those of the labels ``among``, with the
        common columns and ``props``."""
        self.check_label(label)
        if label is not None:
            return self.node_tables[label].withColumn("label", F.lit(label))
        kept = set(self.node_tables if among is None else among)
        return union_all([self._common(x) for x in self.node_tables if x in kept])

    def _common(self, label: str) -> DataFrame:
        table = self.node_tables[label]
        return table.select(*NODE_COLUMNS, F.lit(label).alias("label"), _props(table).alias("props"))

    def stored_nodes(self) -> DataFrame:
        """All nodes as ``nodes()``, and as ``typed`` the typed columns, as JSON text, of tables that have ``props`` beside them."""
        return union_all([
            t.select(*NODE_COLUMNS, F.lit(x).alias("label"), _props(t).alias("props"), (_typed(t) if "props" in t.columns else F.lit(None).cast("string")).alias("typed"))
            for x, t in self.node_tables.items()
        ])

    def _allowed(self, types: str | list[str] | None, src_label: str | None, dst_label: str | None) -> list[Triple]:
        wanted = None if types is None else {t.lower() for t in ([types] if isinstance(types, str) else types)}
        return [
            (s, t, d)
            for s, t, d in self.edge_tables
            if (wanted is None or t.lower() in wanted) and src_label in (None, s) and dst_label in (None, d)
        ]

    def end_labels(
        self, types: str | list[str] | None, direction: str, left: str | None, right: str | None
    ) -> tuple[set[str], set[str]]:
        """The labels that either end of a hop can have; types match as in ``edges``."""
        out = [(s, d) for s, _, d in self._allowed(types, left, right)] if direction != "in" else []
        back = [(d, s) for s, _, d in self._allowed(types, right, left)] if direction != "out" else []
        return {x for x, _ in out + back}, {x for _, x in out + back}

    def true_end(self, types: str | list[str] | None, direction: str, left: str | None, right: str | None) -> str | None:
        """The label that all nodes at the right of a hop have, if the edges' tables tell: it is one, and claimed by none."""
        labels = self.end_labels(types, direction, left, right)[1]
        out = self._allowed(types, left, right) if direction != "in" else []
        back = self._allowed(types, right, left) if direction != "out" else []
        claimed = any(self.claims.get(t, (None,))[0] == 1 for _, t, _ in out) or any(self.claims.get(t, (None,))[0] == 0 for _, t, _ in back)
        return min(labels) if len(labels) == 1 and self.claims and not claimed else None

    def edges(
        self, types: str | list[str] | None = None, src_label: str | None = None, dst_label: str | None = None, met: tuple[str | None, str | None] = (None, None)
    ) -> DataFrame | None:
        """All edges that the arguments allow, as ``EDGE_COLUMNS``; None where no triple does.

        Type names match without regard to case. ``met`` says of source and target that the caller joins them with
        the nodes of a label.
        """
        chosen = self._allowed(types, src_label, dst_label)
        if not chosen:
            return None
        if self.edge_table is not None:
            out = self.edge_table
            for column, i, given in (("etype", 1, types), ("src_label", 0, src_label), ("dst_label", 2, dst_label)):
                if given is not None:
                    out = out.where(F.col(column).isin(*sorted({t[i] for t in chosen})))
            return out
        found = []
        for t in dict.fromkeys(t for _, t, _ in chosen):
            ends = [(s, d) for s, e, d in chosen if e == t]
            end, twice = self.claims.get(t, (0, frozenset()))
            if t in self.claims and (met[end] is None or met[end] in twice):
                pairs = [f"{s} {d}" for s, d in ends]
                found.append(self.checked(t).where(F.concat_ws(" ", "src_label", "dst_label").isin(*pairs)).select(*EDGE_COLUMNS))
            else:
                found += [self.edge_tables[s, t, d].select("src", F.lit(s).alias("src_label"), F.lit(t).alias("etype"), "dst", F.lit(d).alias("dst_label")) for s, d in ends]
        return union_all(found)

    def all_edges(self) -> DataFrame:
        found = self.edges()
        return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in EDGE_COLUMNS)) if found is None else found
