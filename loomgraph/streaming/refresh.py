"""Keeping a stored graph up to date from a stream of snapshots or of object changes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomgraph.operators import changes
from loomgraph.operators.model import EDGE_COLUMNS, Graph, union_all
from loomgraph.operators.nodes import build_graph
from loomgraph.sources.scratch import drop_dir, list_dir, scratch, stored
from loomgraph.sources.snapshot import read_snapshot

NODES = "uid string, name string, namespace string, resource_version string, label string, props string, typed string"
EDGES = ", ".join(f"{c} string" for c in EDGE_COLUMNS)
CHANGE = "op string, version long"
PARTS = "what string, folder string, names array<string>"
#: Schema, key, and the columns by which folders are named, of either table.
TABLES = {"nodes": (NODES, ["label", "uid"], changes.NODE_GROUP), "edges": (EDGES, list(EDGE_COLUMNS), changes.EDGE_GROUP)}
MANIFEST = "snapshot string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GraphStore:
    """Versions of (nodes, edges) below a path: a base now and then, and between bases what each version changes.

    Nodes lie in a folder per label, edges in one per triple, so a pattern reads the folders it names. A base is a list of such
    folders: one of a compacted version has new folders for what changed and names those of the base before for all else. What no
    version touched passes by the joins with changes. A version is its base with the last change of each node and edge since.
    It counts once its row in ``commits`` is written, which is the last thing written; what a lost driver left half done isn't
    read, and is written again under the same number. ``compact`` writes a new base, ``vacuum`` drops what no kept version needs.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> DataFrame:
        return self.spark.read.schema("version long, kind string").parquet(f"{self.path}/commits")

    def _latest(self, condition: Column) -> int | None:
        try:
            return self._commits().where(condition).agg(F.max("version")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _commit(self, version: int, kind: str) -> None:
        row = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(kind).alias("kind"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def last(self, before: int | None = None) -> int | None:
        counts = F.col("kind") != "floor"
        return self._latest(counts if before is None else counts & (F.col("version") < before))

    def read(self, version: int | None) -> tuple[DataFrame, DataFrame]:
        """The nodes and edges of a committed version; none of either for None."""
        if version is None:
            return self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES)
        upto = F.col("version") <= version
        if version < (self._latest(F.col("kind") == "floor") or 0):
            raise ValueError(f"version {version} was dropped")
        base = self._latest((F.col("kind") == "base") & upto)
        held = {} if base is None else self._held(base)
        changed = self._changed(base, version)
        return tuple(_merged(self._rows(what, held.get(what, {})), rows, touched, what)[0] for what, (rows, touched) in changed.items())

    def _held(self, base: int) -> dict[str, dict[str, list[list[str | None]]]]:
        """Table -> folder -> the names of labels or triples that a base has there."""
        out: dict = {}
        for what, folder, names in self.spark.read.schema(PARTS).parquet(f"{self.path}/base/v{base}/parts").collect():  # labels and triples
            out.setdefault(what, {}).setdefault(folder, []).append(names)
        return out

    def _rows(self, what: str, held: dict[str, list[list[str | None]]]) -> DataFrame:
        """A base's rows."""
        schema, _, by = TABLES[what]
        group = changes.group_of(by)
        read = lambda folder: self.spark.read.schema(schema).parquet(f"{self.path}/rows/{what}/{folder}").select(*_names(schema))
        found = [read(folder).where(group.isin([changes.group_text(x) for x in names])) for folder, names in held.items()]
        return union_all(found) if found else self.spark.createDataFrame([], schema)

    def _changed(self, base: int | None, version: int) -> dict[str, tuple[DataFrame | None, list[str]]]:
        """Table -> its changes after a base up to a version, and the labels or triples that have some."""
        since = (F.col("version") <= version) & (F.col("version") > F.lit(-1 if base is None else base))
        counted = self._commits().where(since & (F.col("kind") == "change")).select("version").distinct()
        if counted.isEmpty():
            return dict.fromkeys(TABLES, (None, []))
        out = {}
        for what, (schema, _, by) in TABLES.items():
            rows = self.spark.read.schema(f"{schema}, {CHANGE}").parquet(f"{self.path}/changes/{what}").where(since).join(counted, "version", "left_semi")
            out[what] = rows, [r[0] for r in rows.select(changes.group_of(by)).distinct().collect()]  # labels or triples
        return out

    def graph(self, version: int | None, like: Graph) -> Graph:
        """A version to match on, with the labels, triples and typed properties that ``like`` has."""
        return Graph.from_tables(*self.read(version), like.node_tables, like.edge_tables, like.properties())

    def write(self, version: int, nodes: DataFrame, edges: DataFrame) -> None:
        """A base, all in new folders."""
        self._write_base(version, {"nodes": nodes.select(*[c for c in _names(NODES) if c in nodes.columns]), "edges": edges.select(*EDGE_COLUMNS)}, {})

    def _write_base(self, version: int, new: dict[str, DataFrame], parts: dict[str, dict[str, list[list[str | None]]]]) -> None:
        """New folders for the rows ``new``, and a list of them and of the ``parts`` that are there."""
        listed = [(what, folder, x) for what, held in parts.items() for folder, names in held.items() for x in names]
        for what, rows in new.items():
            schema, _, by = TABLES[what]
            folder = f"v{version}-{uuid.uuid4().hex}"
            _write(rows, by, f"{self.path}/rows/{what}/{folder}")
            made = self.spark.read.schema(schema).parquet(f"{self.path}/rows/{what}/{folder}").select(*by).distinct().collect()  # labels or triples
            listed += [(what, folder, list(x)) for x in made]
        self.spark.createDataFrame(listed, PARTS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base/v{version}/parts")
        self._commit(version, "base")

    def update(self, version: int, graph: Graph) -> bool:
        """Bring the last version before ``version`` to ``graph``, writing what changes; False, and nothing written, if nothing does."""
        old_nodes, old_edges = self.read(self.last(before=version))
        with scratch(self.spark) as work:  # each difference is made once: it is looked at first, then written
            new_nodes = graph.stored_nodes().select(*old_nodes.columns)
            node_changes = stored(changes.node_changes(new_nodes, old_nodes), f"{work}/nodes")
            edge_changes = stored(changes.edge_diff(*changes.changed_edges(graph.all_edges(), old_edges, f"{work}/edge_ranges")), f"{work}/edges")
            if changes.is_empty(node_changes, edge_changes):
                return False
            self.apply(version, old_edges, node_changes, new_nodes, edge_changes)
        return True

    def apply(self, version: int, old_edges: DataFrame, node_changes: DataFrame, new_nodes: DataFrame, edge_changes: DataFrame) -> None:
        """Write a version's changes: ``changes.apply_diff``'s rules, as rows of what goes and what comes. ``node_changes`` are
        those of ``changes.node_changes``: a node that changed its label goes from the old one."""
        come = node_changes.where(F.col("op") != "removed").select("uid")
        dead = node_changes.where(F.col("op") == "removed").select("uid")
        left = node_changes.where(F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("now"))).select(F.col("was").alias("label"), "uid")
        upserts = new_nodes.join(_few(come), "uid", "left_semi").withColumn("op", F.lit("there"))
        nodes = upserts.unionByName(left.withColumn("op", F.lit("gone")), allowMissingColumns=True)
        keys = list(EDGE_COLUMNS)
        gone = edge_changes.where(F.col("op") == "removed").select(*keys)
        if not dead.isEmpty():
            met, dead = old_edges, _few(dead)
            for end in ("src", "dst"):  # a removed node takes its edges along
                met = met.join(dead.select(F.col("uid").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
            gone = gone.unionByName(met.where(F.col("_src") | F.col("_dst")).select(*keys))
        added = edge_changes.where(F.col("op") == "added").select(*keys)
        edges = gone.distinct().withColumn("op", F.lit("gone")).unionByName(added.withColumn("op", F.lit("there")))
        for name, rows, by in (("nodes", nodes, changes.NODE_GROUP), ("edges", edges, changes.EDGE_GROUP)):
            _write(rows, by, f"{self.path}/changes/{name}/version={version}")
        self._commit(version, "change")

    def rebuild(self, version: int, graph: Graph) -> None:
        """The fallback: write everything anew."""
        self.write(version, graph.stored_nodes(), graph.all_edges())

    def compact(self, version: int | None = None) -> None:
        """Make a version, by default the last one, a base: what changed since the base before is written, else its folders are named."""
        version = self.last() if version is None else version
        base = None if version is None else self._latest((F.col("kind") == "base") & (F.col("version") <= version))
        if version is None or base == version:
            return
        held = {} if base is None else self._held(base)
        new = {}
        for what, (rows, touched) in self._changed(base, version).items():
            new[what] = _merged(self._rows(what, held.get(what, {})), rows, touched, what)[1]
            held[what] = {folder: left for folder, names in held.get(what, {}).items() if (left := [x for x in names if changes.group_text(x) not in touched])}
        self._write_base(version, {what: rows for what, rows in new.items() if rows is not None}, held)

    def vacuum(self, keep: int) -> None:
        """Drop bases and changes that versions from ``keep`` on don't need; reading an older one is an error then.

        That is said first, so that no half dropped version is ever read.
        """
        base = self._latest((F.col("kind") == "base") & (F.col("version") <= keep))
        if base is None:
            return
        self._commit(base, "floor")
        bases = {r["version"] for r in self._commits().where(F.col("kind") == "base").select("version").distinct().collect()}  # versions, not data
        old = [v for v in sorted(bases) if v < base and list_dir(self.spark, f"{self.path}/base/v{v}")]
        was, kept = ([(what, folder, tuple(x)) for v in versions for what, held in self._held(v).items() for folder, names in held.items() for x in names]
                     for versions in (old, [v for v in bases if v >= base]))
        for what, folder, names in set(was) - set(kept):
            at = "/".join(f"{c}={_escaped(x)}" for c, x in zip(TABLES[what][2], names, strict=True))
            drop_dir(self.spark, f"{self.path}/rows/{what}/{folder}/{at}")
        for what in TABLES:
            needed = {folder for x, folder, _ in kept if x == what}
            for folder in set(list_dir(self.spark, f"{self.path}/rows/{what}")) - needed:
                drop_dir(self.spark, f"{self.path}/rows/{what}/{folder}")
        for v in old:
            drop_dir(self.spark, f"{self.path}/base/v{v}")
        for row in self._commits().where(F.col("version") <= base).select("version").distinct().toLocalIterator():
            for what in TABLES:
                drop_dir(self.spark, f"{self.path}/changes/{what}/version={row['version']}")


def _escaped(name: str | None) -> str:
    """A value as Spark names its folder."""
    return "__HIVE_DEFAULT_PARTITION__" if name is None else re.sub(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", name)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _write(rows: DataFrame, by: tuple[str, ...], path: str) -> None:
    rows.write.mode("overwrite").partitionBy(*by).option("compression", "zstd").parquet(path)


#: So many keys at most are broadcast, whatever the session's threshold.
FEW_KEYS = 1 << 17


def _few(keys: DataFrame) -> DataFrame:
    """Keys of a stored table, to be broadcast if they are few, so that the rows they meet aren't shuffled."""
    return F.broadcast(keys) if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS else keys


def _merged(base: DataFrame, changed: DataFrame | None, touched: list[str], what: str) -> tuple[DataFrame, DataFrame | None]:
    """The base's rows whose key isn't changed, and the last of each changed key's, unless that is gone; and of those the rows of
    the labels or triples that were touched.

    Changes alone are grouped; the base meets their keys, by broadcast where they are few. Labels or triples without
    changes, told by their names, meet nothing.
    """
    _, keys, by = TABLES[what]
    if changed is None:
        return base, None
    ours = changes.group_of(by).isin(touched)
    last = changed.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in changed.columns if c not in (*keys, "version")]), "version").alias("_last"))
    kept = base.where(ours).join(last.select(*keys), keys, "left_anti")
    there = last.where(F.col("_last.op") == "there")
    found = kept.select(*base.columns).unionByName(there.select(*[F.col(c if c in keys else f"_last.{c}").alias(c) for c in base.columns]))
    return base.where(~ours).unionByName(found), found


def refresh_stream(
    spark: SparkSession,
    manifests: str,
    store: str,
    checkpoint: str,
    *,
    load: Callable[[SparkSession, str], Graph] | None = None,
    every: str = "5 seconds",
    available_now: bool = False,
) -> StreamingQuery:
    """For each manifest, a JSON file ``{"snapshot": path}``, build the snapshot's graph, compare it with the
    last committed version and write the next one. One manifest a batch; the batch number is the version, so
    a batch that runs again after a failure writes the same version again."""
    load = load or (lambda s, path: build_graph(read_snapshot(s, path, ordinals=True))[0])
    target = GraphStore(spark, store)

    def step(batch: DataFrame, number: int) -> None:
        row = batch.select("snapshot").where("snapshot is not null").first()  # one file of one row
        if row is not None:
            target.update(number, load(batch.sparkSession, row["snapshot"]))

    stream = spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", 1).json(manifests)
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


class _InOrder(StatefulProcessor):
    """The last version of a uid; a removed one is remembered until its timer, if any is asked for, clears it."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "version string, deleted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        given = [r for batch in rows for r in zip(batch["resource_version"], batch["deleted"], strict=True)]
        given.sort(key=lambda r: (r[0] is None, _order(r[0]), bool(r[1])))
        seen = self.seen.get() if self.seen.exists() else None
        version, deleted = seen if seen else (None, True)
        new, out = seen is None, []
        for at, gone in given:
            if not new and at is not None and version is not None and _order(at) < _order(version):
                continue  # overtaken by a later version
            if gone:
                if not deleted:
                    out.append((key[0], "removed", at))
                version, deleted, new = version if at is None else at, True, False
            elif deleted:
                if new or at is None or version is None or _order(at) > _order(version):
                    out.append((key[0], "added", at))
                    version, deleted, new = at, False, False
            elif at != version:
                out.append((key[0], "modified", at))
                version = at
        if not new:
            self.seen.update((version, deleted))
            if self.forget_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            if deleted and self.forget_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_ms)
        yield pd.DataFrame(out, columns=["uid", "op", "resource_version"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.seen.exists() and self.seen.get()[1]:
            self.seen.clear()
        yield pd.DataFrame([], columns=["uid", "op", "resource_version"])

    def close(self) -> None:
        pass


def _order(version: str | None) -> tuple:
    """Versions are counters written as text; others are ordered as text, after them."""
    text = version or ""
    return (0, int(text), "") if text.isdecimal() else (1, 0, text)


def detect_changes(objects: DataFrame, *, forget_ms: int | None = None) -> DataFrame:
    """``(uid, op, resource_version)`` from a stream of ``(uid, resource_version, deleted)``: added when a uid
    is new, modified when its version is later than the last one seen, removed when a deletion arrives.

    Changes are taken in the order of their versions, not of arrival: those of a batch are sorted, and one that was
    overtaken by a later version of its uid is dropped, also after a deletion. So input in any order ends in the
    same state. A deletion without version is the last of its batch. State is kept in RocksDB, which this
    session's streams use from now on.

    With ``forget_ms`` a removed uid is forgotten after that much processing time, by a timer, and its state goes; an older
    version that comes later still adds it again. A stream with such timers is never idle: run it with a
    processing-time trigger, one that takes what is available now wouldn't end.
    """
    objects.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return objects.groupBy("uid").transformWithStateInPandas(
        _InOrder(forget_ms), "uid string, op string, resource_version string", "append", "None" if forget_ms is None else "ProcessingTime"
    )
