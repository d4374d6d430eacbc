"""Pattern matching and clause-style row pipelines, each step a DataFrame transformation."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.model import Graph, union_all

REL_FIELDS = ("type", "source", "target", "source_type", "target_type")


@dataclass(frozen=True)
class Node:
    """A node of a pattern; unnamed ones are not bound."""

    var: str | None = None
    label: str | None = None


@dataclass(frozen=True)
class Hop:
    """An edge of a pattern: ``direction`` is out, in or both; ``type`` a name, a list of names or None for any."""

    type: str | list[str] | None = None
    direction: str = "out"
    var: str | None = None


class Var:
    """A bound variable: ``v["field"]`` is a column, ``v.get("field", type)`` one that may be missing.

    A field that the variable doesn't have is an error, or null if the variable is ``lenient``, as under ``compat``.
    """

    def __init__(self, name: str, fields: tuple[str, ...], kind: str = "node", lenient: bool = False, text: bool = False, label: str | None = None):
        self.name, self.fields, self.kind, self.lenient, self.text, self.label = name, fields, kind, lenient, text, label

    def __getitem__(self, key: str) -> Column:
        if self.kind == "value":
            return F.col(self.name)[key]
        if key in self.fields:
            return F.col(self.column(key))
        if self.lenient:
            return F.lit(None)
        raise ValueError(f"{self.name} has no field {key}; get() reads properties of open shape and those that may be missing")

    def get(self, key: str, type: str = "string") -> Column:
        """A property as ``type``, null if it is missing or is no such value: a typed column, else a key of the open
        ``props``, a VARIANT or (``text``) JSON text that is parsed here, else null."""
        if key in self.fields:
            return F.col(self.column(key)).try_cast(type)
        if "props" not in self.fields:
            return F.lit(None).cast(type)
        props = F.col(self.column("props"))
        quote = '"' if "'" in key else "'"
        return F.try_variant_get(F.try_parse_json(props) if self.text else props, f"$[{quote}{key}{quote}]", type)

    def column(self, key: str) -> str:
        return self.name if self.kind == "value" else f"{self.name}__{key}"

    def columns(self) -> list[str]:
        return [self.name] if self.kind == "value" else [self.column(k) for k in self.fields]

    def value(self) -> Column:
        """The whole value: one struct."""
        return F.col(self.name) if self.kind == "value" else F.struct(*[self[k].alias(k) for k in self.fields])


class Scope:
    """The bound variables, as attributes or by key."""

    def __init__(self, variables: dict[str, Var]):
        self._vars = variables

    def __getattr__(self, name: str) -> Var:
        return self[name]

    def __getitem__(self, name: str) -> Var:
        if name not in self._vars:
            raise ValueError(f"unknown variable: {name}")
        return self._vars[name]


Where = Callable[[Scope], Column]
Items = dict[str, "Column | Var"] | list["Column | Var"]


def default_name(item: Column | Var, index: int) -> str:
    """The name of a result that has none: of a variable its name, of a property its key, of a call the
    function, else ``expr_<index>``."""
    if isinstance(item, Var):
        return item.name
    text = re.fullmatch(r"Column<'(.*)'>", str(item), re.DOTALL)[1]
    if found := re.fullmatch(r"(?:\w+?__)?(\w+)(?:\[\w+\])*", text):
        return re.findall(r"\w+", text)[-1] if "[" in text else found[1]
    call = re.fullmatch(r"(\w+)\(.*\)", text, re.DOTALL)
    return call[1].lower() if call else f"expr_{index}"


def _named(items: Items | None, start: int, compat: bool) -> dict[str, Column | Var]:
    """Items by name. A list's items get default names; a name that comes again is an error, or, under
    ``compat``, stands for the last of its items."""
    if not isinstance(items, list):
        return dict(items or {})
    out: dict[str, Column | Var] = {}
    for i, x in enumerate(items, start):
        name = default_name(x, i)
        if name in out and not compat:
            raise ValueError(f"two results are called {name}: name them")
        out[name] = x
    return out


@dataclass(frozen=True)
class Rows:
    """Bindings: a DataFrame with flat columns ``variable__field``; ``df`` gives it.

    ``compat=True`` reproduces the embedded engine's rules where they differ from openCypher's.
    """

    graph: Graph
    df: DataFrame | None = None
    variables: tuple[Var, ...] = ()
    compat: bool = False

    @property
    def _source(self) -> DataFrame:
        """The rows so far; before any clause one row without columns."""
        return self.graph.spark.range(1).select() if self.df is None else self.df

    @property
    def scope(self) -> Scope:
        return Scope({v.name: v for v in self.variables})

    def _bound(self) -> dict[str, Var]:
        return {v.name: v for v in self.variables}

    # ---- patterns -------------------------------------------------------------------------------------

    def match(
        self,
        *pattern: Node | Hop,
        where: Where | None = None,
        optional: bool = False,
        unique_edges: bool = False,
        allow_cross: bool = False,
    ) -> Rows:
        """Bind a path: nodes and hops in turn.

        Variables bound before are joined on. With ``optional`` rows without a match stay, the new variables
        null; ``where`` belongs to the optional part (after it under ``compat``). A path of two hops or more
        that binds nothing new only filters. A pattern that shares nothing with the rows multiplies them:
        it needs ``allow_cross``, best with a ``where`` that relates the two.
        """
        path = _Path(self, pattern, unique_edges)
        bound = self._bound()
        fresh = tuple(v for v in path.variables if v.name not in bound)
        shared = [k for k in path.keys if k in bound]
        if self.df is None:
            if optional:
                unit = Rows(self.graph, self._source, (), self.compat)
                return unit.match(*pattern, where=where, optional=True, unique_edges=unique_edges, allow_cross=True)
            return Rows(self.graph, path.df.select(*path.bound_columns()), path.variables, self.compat).where(where)
        if path.hops and not fresh and not optional and path.names_all_bound(bound):
            return self.exists(*pattern, where=where) if path.hops > 1 or not path.both_ways() else self._join(path, where, ())
        if not shared and not allow_cross:
            raise ValueError("the pattern shares no variable with the rows; pass allow_cross=True for their product")
        if not optional:
            return self._join(path, where, fresh)
        inside = None if self.compat else where
        out = Rows(self.graph, self._with_path(path, fresh, "left", inside), self.variables + fresh, self.compat)
        return out.where(where) if self.compat else out

    def _join(self, path: _Path, where: Where | None, fresh: tuple[Var, ...]) -> Rows:
        out = self._with_path(path, fresh, "inner", None)
        return Rows(self.graph, out, self.variables + fresh, self.compat).where(where)

    def _with_path(self, path: _Path, fresh: tuple[Var, ...], how: str, where: Where | None) -> DataFrame:
        right, conditions = path.renamed()
        if where is not None:
            both = Scope({**{v.name: v for v in path.variables}, **self._bound()})
            conditions = [*conditions, where(both)]  # as it is: inside another function Catalyst finds no keys in it
        condition = conditions[0] if conditions else F.lit(True)
        for c in conditions[1:]:
            condition = condition & c
        semi = how in ("left_semi", "left_anti")
        joined = self.df.join(right, condition, how) if conditions or semi else self.df.crossJoin(right)
        if semi:
            return joined
        return joined.select(*self.df.columns, *[c for v in fresh for c in v.columns()])

    def exists(self, *pattern: Node | Hop, where: Where | None = None) -> Rows:
        """Keep rows for which the pattern has a match; ``where`` may use outer and inner variables."""
        return self._semi(pattern, where, "left_semi")

    def not_exists(self, *pattern: Node | Hop, where: Where | None = None) -> Rows:
        return self._semi(pattern, where, "left_anti")

    def _semi(self, pattern, where: Where | None, how: str) -> Rows:
        path = _Path(self, pattern, False)
        if where is None and (found := path.reduced()) is not None:
            name, ends = found
            return replace(self, df=self.df.join(ends, F.col(f"{name}__uid") == F.col("_end"), how))
        return replace(self, df=self._with_path(path, (), how, where))

    def exists_flag(self, name: str, *pattern: Node | Hop, where: Where | None = None, outer: bool = False) -> Rows:
        """Bind a boolean: does the pattern have a match? ``where`` may use outer variables if ``outer`` is
        set; the rows are then told apart by a semi and an anti join instead of one join with marks."""
        if outer:
            there = self.exists(*pattern, where=where).df.withColumn(name, F.lit(True))
            flagged = there.unionByName(self.not_exists(*pattern, where=where).df.withColumn(name, F.lit(False)))
            return replace(self, df=flagged, variables=(*self.variables, Var(name, (), "value")))
        path = _Path(self, pattern, False)
        if where is None and (found := path.reduced()) is not None:
            marks = found[1].withColumn("_there", F.lit(True))
            flagged = self.df.join(marks, F.col(f"{found[0]}__uid") == F.col("_end"), "left")
            flagged = flagged.select(*self.df.columns, F.coalesce("_there", F.lit(False)).alias(name))
            return replace(self, df=flagged, variables=(*self.variables, Var(name, (), "value")))
        keys = [k for k in path.keys if k in self._bound()]
        inner = Rows(self.graph, path.df, path.variables, self.compat).where(where).df
        marks = inner.select(*[F.col(path.keys[k]).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct().withColumn("_there", F.lit(True))
        condition = F.lit(True)
        for i, k in enumerate(keys):
            condition = condition & (F.col(f"{k}__uid") == F.col(f"_k{i}"))
        flagged = self.df.join(marks, condition, "left").select(*self.df.columns, F.coalesce("_there", F.lit(False)).alias(name))
        return replace(self, df=flagged, variables=(*self.variables, Var(name, (), "value")))

    # ---- clauses --------------------------------------------------------------------------------------

    def where(self, condition: Where | Column | None) -> Rows:
        """Keep rows for which the condition is true (neither false nor null)."""
        if condition is None:
            return self
        return replace(self, df=self._source.where(condition if isinstance(condition, Column) else condition(self.scope)))

    def unwind(self, values: Column | Callable[[Scope], Column], name: str) -> Rows:
        """One row per element; null and empty arrays give none, another value gives one row."""
        df = self._source
        values = values if isinstance(values, Column) else values(self.scope)
        kind = df.select(values.alias("_x")).schema["_x"].dataType.typeName()
        if kind == "array":
            out = df.select(*df.columns, F.explode(values).alias(name))
        else:
            out = df.select(*df.columns, values.alias(name)).where(F.col(name).isNotNull())
        return replace(self, df=out, variables=(*self.variables, Var(name, (), "value")))

    def with_(
        self,
        items: Items | Callable[[Scope], Items] | None = None,
        aggs: Items | Callable[[Scope], Items] | None = None,
        *,
        distinct: bool = False,
        where: Where | None = None,
        order_by: list[Column] | None = None,
        skip: int | None = None,
        limit: int | None = None,
    ) -> Rows:
        """Project to ``items``; with ``aggs`` the items are the grouping keys. Then distinct, order, skip and
        limit, and last ``where`` (before the order under ``compat``). ``items=None`` keeps all variables.
        Items and aggregates in a list get their default names (see ``default_name``).

        Without items an aggregation gives one row; under ``compat`` none if there are no rows.
        """
        items = items(self.scope) if callable(items) else items
        aggs = aggs(self.scope) if callable(aggs) else aggs
        source = self._source
        if items is None and aggs is None:
            chosen, variables = [F.col(c) for c in source.columns], self.variables
        else:
            chosen, variables = [], ()
            items = _named(items, 0, self.compat)
            if aggs is not None:
                aggs = _named(aggs, len(items), self.compat)
                if both := (items.keys() & aggs.keys()):
                    if not self.compat:
                        raise ValueError(f"two results are called {min(both)}: name them")
                    items = {k: v for k, v in items.items() if k not in both}
            for name, x in items.items():
                if isinstance(x, Var):
                    v = Var(name, x.fields, x.kind, x.lenient, x.text, x.label)
                    chosen += [F.col(a).alias(b) for a, b in zip(x.columns(), v.columns(), strict=True)]
                else:
                    v = Var(name, (), "value")
                    chosen.append(x.alias(name))
                variables += (v,)
        if aggs is None:
            df = source.select(*chosen)
        else:
            made = [c.alias(n) for n, c in aggs.items()]
            if chosen:
                df = source.groupBy(*chosen).agg(*made)
            elif self.compat:
                df = source.agg(*made, F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")
            else:
                df = source.agg(*made)
            variables += tuple(Var(n, (), "value") for n in aggs)
        out = replace(self, df=df.distinct() if distinct else df, variables=variables)
        if self.compat:
            out = out.where(where)
        df = out.df.orderBy(*order_by) if order_by else out.df
        df = df.offset(skip) if skip and skip > 0 else df
        df = df.limit(max(0, limit)) if limit is not None else df
        out = replace(out, df=df)
        return out if self.compat else out.where(where)

    def returns(self, items=None, aggs=None, **options) -> DataFrame:
        """The result: ``with_`` as a DataFrame; whole variables become structs."""
        out = self.with_(items, aggs, **options)
        return out.df.select(*[v.value().alias(v.name) for v in out.variables])


def collect(value: Column, order_by: Column, *, keep_nulls: bool = False) -> Column:
    """Aggregate: the values as a list in the order given. Nulls go unless they are to be kept."""
    pair = F.struct(order_by.alias("o"), value.alias("x"))
    rows = F.collect_list(pair if keep_nulls else F.when(value.isNotNull(), pair))
    return F.transform(F.array_sort(rows), lambda r: r["x"])


class _Path:
    """A pattern's own matches: nodes joined through edges; columns of its variables and of its keys.

    ``keys`` has, for each named node, the column of its uid. Nodes bound by the rows outside need no scan
    when an edge tells their uid and label.
    """

    def __init__(self, rows: Rows, pattern: tuple[Node | Hop, ...], unique_edges: bool):
        nodes, hops = list(pattern[::2]), list(pattern[1::2])
        if len(pattern) % 2 == 0 or not all(isinstance(n, Node) for n in nodes) or not all(isinstance(h, Hop) for h in hops):
            raise ValueError("a pattern is nodes and hops in turn")
        self.graph, self.outer, self.compat = rows.graph, rows._bound(), rows.compat
        for n in nodes:
            self.graph.check_label(n.label)
        if not rows.compat:  # the embedded engine finds nothing for a type that it doesn't know
            for h in hops:
                self.graph.check_types(h.type)
        self.hops, self.pattern, self.variables, self.keys = len(hops), pattern, (), {}
        self.rel_keys: dict[str, dict[str, str]] = {}
        self.df: DataFrame | None = None
        self._count, self._edges = 0, []
        self._reached: str | None = None  # the label of the node that the last hop has led to, if its edges tell
        among = self._labels(nodes, hops)
        here = self._start(nodes[0], bool(hops), among[0])
        for i, hop in enumerate(hops):
            here = self._hop(nodes[i], here, hop, nodes[i + 1], i, among[i + 1])
        if unique_edges:
            for i, a in enumerate(self._edges):
                for b in self._edges[:i]:
                    self.df = self.df.where(~((F.col(f"{a}s") == F.col(f"{b}s")) & (F.col(f"{a}d") == F.col(f"{b}d")) & (F.col(f"{a}t") == F.col(f"{b}t"))))

    def _name(self) -> str:
        self._count += 1
        return f"_p{self._count}"

    def _labels(self, nodes: list[Node], hops: list[Hop]) -> list[set[str] | None]:
        """For each node the labels that the hops beside it leave, so that a node without a label scans the
        tables of those only; None where all are left, or none (no rows then, whatever is scanned)."""
        left: list[set[str] | None] = [None] * len(nodes)
        for i, hop in enumerate(hops):
            ends = self.graph.end_labels(hop.type, hop.direction, nodes[i].label, nodes[i + 1].label)
            for j, found in zip((i, i + 1), ends, strict=True):
                left[j] = found if left[j] is None else left[j] & found
        return [(x & self.graph.node_tables.keys()) or None if x is not None else None for x in left]

    def _scan(self, node: Node, name: str, among: set[str] | None) -> DataFrame:
        table = self.graph.nodes(node.label, among)
        return table.select(*[F.col(c).alias(f"{name}__{c}") for c in table.columns])

    def _needs_scan(self, node: Node) -> bool:
        return node.var is not None and node.var not in self.outer and node.var not in self.keys

    def _met(self, node: Node) -> str | None:
        """The label of the table that a named node's uid is joined with, outside or in this pattern."""
        if node.var is None:
            return None
        bound = self.outer.get(node.var) or next((v for v in self.variables if v.name == node.var), None)
        return node.label if bound is None else bound.label

    def _bind(self, node: Node, name: str, df: DataFrame) -> None:
        fields = tuple(c[len(name) + 2 :] for c in df.columns if c.startswith(f"{name}__"))
        text = "props" in fields and df.schema[f"{name}__props"].dataType.typeName() == "string"
        self.variables += (Var(node.var, fields, lenient=self.compat, text=text, label=node.label),)
        self.keys[node.var] = f"{name}__uid"

    def _start(self, node: Node, more: bool, among: set[str] | None) -> str:
        """The column with the first node's uid; for an unnamed or bound first node the edge will give it."""
        if more and not self._needs_scan(node):
            return ""
        name = node.var if self._needs_scan(node) else self._name()
        self.df = self._scan(node, name, among)
        if node.var is not None:
            if self._needs_scan(node):
                self._bind(node, name, self.df)
            else:
                self.keys[node.var] = f"{name}__uid"
        return f"{name}__uid"

    def _hop(self, left: Node, here: str, hop: Hop, right: Node, number: int, among: set[str] | None) -> str:
        step, e = self._oriented(left.label, hop, right.label, (self._met(left) or self._reached, self._met(right))), f"_e{number}"
        self._reached = self.graph.true_end(hop.type, hop.direction, left.label, right.label)
        step = step.select(*[F.col(c).alias(f"{e}{c}") for c in ("from", "to", "t", "sl", "dl", "s", "d")])
        if self.df is None:
            self.df = step
            if left.var is not None:
                self.keys[left.var] = f"{e}from"
        else:
            self.df = self.df.join(step, F.col(here) == F.col(f"{e}from"))
        self._edges.append(e)
        if hop.var is not None:
            made = dict(zip(REL_FIELDS, (f"{e}t", f"{e}from", f"{e}to", f"{e}sl", f"{e}dl"), strict=True))
            if hop.var in self.outer or hop.var in {v.name for v in self.variables}:
                self.rel_keys[hop.var] = made
            else:
                for k, c in made.items():
                    self.df = self.df.withColumn(f"{hop.var}__{k}", F.col(c))
                self.variables += (Var(hop.var, REL_FIELDS, "rel", self.compat),)
        there = f"{e}to"
        if right.var is not None and right.var in self.keys:  # met before in this pattern: close the cycle
            self.df = self.df.where(F.col(there) == F.col(self.keys[right.var]))
        elif self._needs_scan(right):
            scan = self._scan(right, right.var, among)
            self.df = self.df.join(scan, F.col(there) == F.col(f"{right.var}__uid"))
            self._bind(right, right.var, scan)
        elif right.var is not None:
            self.keys[right.var] = there
        return there

    def _oriented(self, left: str | None, hop: Hop, right: str | None, met: tuple[str | None, str | None]) -> DataFrame:
        """Edges seen along the pattern: ``from`` and ``to``; type, labels and ends of the real edge beside. ``met`` are
        the labels of the tables that the pattern joins left and right with."""
        if hop.direction not in ("out", "in", "both"):
            raise ValueError(f"unknown direction: {hop.direction}")
        real = [F.col("etype").alias("t"), F.col("src_label").alias("sl"), F.col("dst_label").alias("dl"), F.col("src").alias("s"), F.col("dst").alias("d")]
        parts = []
        if hop.direction != "in" and (x := self.graph.edges(hop.type, left, right, met)) is not None:
            parts.append(x.select(F.col("src").alias("from"), F.col("dst").alias("to"), *real))
        if hop.direction != "out" and (x := self.graph.edges(hop.type, right, left, met[::-1])) is not None:
            parts.append(x.select(F.col("dst").alias("from"), F.col("src").alias("to"), *real))
        if not parts:  # no such edge type between these labels: no rows
            return self.graph.spark.createDataFrame([], "`from` string, `to` string, t string, sl string, dl string, s string, d string")
        return union_all(parts)

    def reduced(self) -> tuple[str, DataFrame] | None:
        """The variable at one end of the path, bound outside, and, as ``_end``, the distinct uids it may have.

        The path is reduced from its far end: each hop keeps the edges whose end is among the distinct uids left
        so far, so no two edges are ever joined and a hub adds no rows. None where that isn't the whole condition:
        more than one bound node, a cycle, a bound edge, no hop.
        """
        nodes, hops = list(self.pattern[::2]), list(self.pattern[1::2])
        names = [x.var for x in self.pattern if x.var is not None]
        outside = [x for x in names if x in self.outer]
        if not hops or len(outside) != 1 or len(set(names)) < len(names):
            return None
        among = self._labels(nodes, hops)
        if nodes[0].var != outside[0]:
            if nodes[-1].var != outside[0]:
                return None
            turned = {"in": "out", "out": "in", "both": "both"}
            nodes, among, hops = nodes[::-1], among[::-1], [replace(h, direction=turned[h.direction]) for h in hops[::-1]]
        ends = None
        for i in range(len(hops) - 1, -1, -1):
            right = nodes[i + 1]
            # the left node of the first hop is bound outside, that of another is where the hop before it ends
            before = self.graph.true_end(hops[i - 1].type, hops[i - 1].direction, nodes[i - 1].label, nodes[i].label) if i else None
            step = self._oriented(nodes[i].label, hops[i], right.label, (self._met(nodes[i]) or before, self._met(right))).select("from", "to")
            if right.var is not None:
                there = self.graph.nodes(right.label, among[i + 1]).select(F.col("uid").alias("_uid"))
                step = step.join(there, F.col("to") == F.col("_uid"), "left_semi")
            if ends is not None:
                step = step.join(ends, F.col("to") == F.col("_end"), "left_semi")
            ends = step.select(F.col("from").alias("_end")).distinct()
        return outside[0], ends

    def bound_columns(self) -> list[str]:
        return [c for v in self.variables for c in v.columns()]

    def names_all_bound(self, bound: dict[str, Var]) -> bool:
        """Every named variable is bound outside, and there is one (an edge variable must be free)."""
        names = [x.var for x in self.pattern if x.var is not None]
        return bool(names) and all(n in bound for n in names) and not self.rel_keys

    def both_ways(self) -> bool:
        return any(isinstance(h, Hop) and h.direction == "both" for h in self.pattern)

    def renamed(self) -> tuple[DataFrame, list[Column]]:
        """The matches under names that clash with none outside, and the conditions on shared variables."""
        conditions, columns, i = [], [], 0
        for name, column in self.keys.items():
            if name in self.outer:
                columns.append(F.col(column).alias(f"_j{i}"))
                conditions.append(F.col(f"{name}__uid") == F.col(f"_j{i}"))
                i += 1
        for name, made in self.rel_keys.items():
            for key in ("type", "source", "target"):
                columns.append(F.col(made[key]).alias(f"_j{i}"))
                conditions.append(F.col(f"{name}__{key}") == F.col(f"_j{i}"))
                i += 1
        return self.df.select(*columns, *self.bound_columns()), conditions
