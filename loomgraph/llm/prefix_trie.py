"""Prefix trie of conversations, from adaptive radix trees over sorted runs.

A turn's id is the 128-bit digest of its role and text, 16 bytes in big-endian order; a conversation's key is the
ids of its turns. Keys are sorted by range into runs of bounded size, so that any number of conversations may share
a prefix, and a task builds the radix tree of its run. Nodes that neither the run's first nor its last key passes
through are whole and are emitted. What is known of the others, the open ones, goes on as two entries, which are keys
of the next and much smaller level; the level that is a single run leaves no node open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import drop_dir, join_hot, words_of, write_table

#: Bytes of a turn's id; only depths that are multiples of it are nodes.
TURN = 16
#: Keys and bytes of a run, about; a single key of any length is in one run.
RUN_KEYS, RUN_BYTES = 4096, 8 << 20
#: Conversations of a block take their first turns from its first one.
BLOCK, HEAD = 20, 3
NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---- the tree -------------------------------------------------------------------------------------------------


class Sorted:
    """Up to 4, then up to 16 children: their bytes and, beside them, the children."""

    __slots__ = ("keys", "kids", "room")

    def __init__(self, room: int = 4):
        self.keys, self.kids, self.room = bytearray(), [], room

    def find(self, byte: int):
        at = self.keys.find(byte)
        return None if at < 0 else self.kids[at]

    def put(self, byte: int, child):
        """Add or replace; returns the layout that holds the children from now on."""
        at = self.keys.find(byte)
        if at >= 0:
            self.kids[at] = child
            return self
        if len(self.keys) == self.room:
            if self.room == 16:
                return Indexed(zip(self.keys, self.kids, strict=True)).put(byte, child)
            self.room = 16
        self.keys.append(byte)
        self.kids.append(child)
        return self


class Indexed:
    """Up to 48 children, found by a table of 256 places."""

    __slots__ = ("kids", "places")

    def __init__(self, given):
        self.places, self.kids = bytearray(256), []
        for byte, child in given:
            self.put(byte, child)

    def find(self, byte: int):
        at = self.places[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, child):
        if at := self.places[byte]:
            self.kids[at - 1] = child
            return self
        if len(self.kids) == 48:
            return Full((b, self.kids[at - 1]) for b, at in enumerate(self.places) if at).put(byte, child)
        self.kids.append(child)
        self.places[byte] = len(self.kids)
        return self


class Full:
    """A place for each of 256 bytes."""

    __slots__ = ("places",)

    def __init__(self, given):
        self.places = [None] * 256
        for byte, child in given:
            self.places[byte] = child

    @property
    def kids(self):
        return [x for x in self.places if x is not None]

    def find(self, byte: int):
        return self.places[byte]

    def put(self, byte: int, child):
        self.places[byte] = child
        return self


class Node:
    """``path``: the bytes below the one that leads here. ``row``: a key that passes. ``own``: what is added at its end."""

    __slots__ = ("below", "own", "path", "row")

    def __init__(self, path: bytes, row: int):
        self.path, self.row, self.below, self.own = path, row, Sorted(), None


def _shared(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``path`` the key has from ``at``."""
    part = key[at : at + len(path)]
    if part == path:
        return len(path)
    n = min(len(part), len(path))
    differ = int.from_bytes(part[:n], "big") ^ int.from_bytes(path[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class RadixTree:
    def __init__(self):
        self.root = Node(b"", 0)

    def node(self, key: bytes, row: int) -> Node:
        """The node at which ``key`` ends, made if it isn't there."""
        above, byte, here, at = None, 0, self.root, 0
        while True:
            n = _shared(here.path, key, at)
            if n < len(here.path):
                upper = Node(here.path[:n], here.row)
                upper.below = upper.below.put(here.path[n], here)
                here.path = here.path[n + 1 :]
                above.below = above.below.put(byte, upper)
                here = upper
            at += n
            if at == len(key):
                return here
            above, byte = here, key[at]
            here, at = above.below.find(byte), at + 1
            if here is None:
                leaf = Node(key[at:], row)
                above.below = above.below.put(byte, leaf)
                return leaf


# what is added up at a node: members, smallest member, children, leaves, saved tokens
_NONE = (0, None, 0, 0, 0)


def _plus(x: tuple, y: tuple) -> tuple:
    low = y[1] if x[1] is None else x[1] if y[1] is None else min(x[1], y[1])
    return x[0] + y[0], low, x[2] + y[2], x[3] + y[3], x[4] + y[4]


class Turn:
    """A node of the trie: a turn-aligned depth of the tree."""

    __slots__ = ("depth", "digest", "own", "parent", "row", "sides", "total")

    def __init__(self, depth: int, row: int, own: tuple, total: tuple):
        self.depth, self.row, self.own, self.total = depth, row, own, total
        self.parent, self.digest, self.sides = None, None, (False, False)  # sides: is it on the run's first, last key

    @property
    def is_open(self) -> bool:
        return any(self.sides)


def turn_nodes(tree: RadixTree, words: list) -> list[Turn]:
    """All turn-aligned depths of the tree, children before parents, with their totals."""
    out: list[Turn] = []
    above: list = []  # for each tree node that is being worked on: sums from below, turns that wait for their parent
    stack = [(tree.root, 0, False)]
    while stack:
        node, start, done = stack.pop()
        end = start + len(node.path)
        if not done:
            stack.append((node, start, True))
            above.append([_NONE, []])
            stack.extend((child, end + 1, False) for child in node.below.kids)
            continue
        total, waiting = above.pop()
        own = node.own or _NONE
        top = (start + TURN - 1) // TURN if node is not tree.root else 0
        for depth in range(end // TURN, top - 1, -1):
            own = own if depth * TURN == end else _NONE
            n, low, kids, leaves, saved = _plus(total, own)
            spared = (n - 1) * words[node.row][depth - 1] if depth else 0
            total = (n, low, kids, leaves if kids else 1, saved + spared)
            turn = Turn(depth, node.row, own, total)
            for child in waiting:
                child.parent = turn
            out.append(turn)
            waiting, total = [turn], (total[0], total[1], 1, total[3], total[4])
        if above:
            above[-1][0] = _plus(above[-1][0], total)
            kept = above[-1][1]
            if len(kept) < len(waiting):
                kept, waiting = waiting, kept
            kept.extend(waiting)
            above[-1][1] = kept
    return out


# ---- runs -----------------------------------------------------------------------------------------------------

_COLUMNS = {
    "kind": pa.int32(), "node": pa.binary(), "parent": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(),
    "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "key": pa.binary(), "words": pa.list_(pa.int32()),
    "depths": pa.list_(pa.int32()), "sums": pa.list_(pa.int64()),
}
_DDL = (
    "kind int, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, key binary, words array<int>, depths array<int>, sums array<long>"
)
NODE, ENTRY, END = 0, 1, 2


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in _COLUMNS.items()], list(_COLUMNS))


def _ends(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else NO_ENDS


def run_rows(keys: list[bytes], words: list, adds: list, ids: list[int] | None, last_level: bool) -> Iterator[dict]:
    """What a sorted run gives: rows of whole nodes, entries of the next level, and ids that end at open nodes.

    ``adds`` holds for each key (depth, sums) pairs. ``ids``: the conversations of the keys, ascending for the
    same key, at the first level; none later, where nodes are named by their digests instead.
    """
    tree, ends = RadixTree(), {}
    for row, key in enumerate(keys):
        tree.node(key, row)
        for depth, sums in adds[row]:
            node = tree.node(key[: depth * TURN], row)
            node.own = _plus(node.own or _NONE, sums)
        if ids is not None:
            ends.setdefault(key, []).append(ids[row])
    turns = turn_nodes(tree, words)
    sides = () if last_level else (keys[0], keys[-1])
    for t in reversed(turns):  # parents first
        above = t.parent
        if above is None:
            t.sides, t.digest = (bool(sides), bool(sides)), hashlib.md5()
            continue
        part = slice((t.depth - 1) * TURN, t.depth * TURN)
        own = keys[t.row][part]
        if above.is_open:
            t.sides = tuple(was and side[part] == own for was, side in zip(above.sides, sides, strict=True))
        if t.is_open or ids is None:
            t.digest = above.digest.copy()
            t.digest.update(own)
    sums = {id(t): t.own for t in turns if t.is_open}
    for t in turns:
        if t.parent is not None and t.parent.is_open and not t.is_open:
            n, low, _, leaves, saved = t.total
            sums[id(t.parent)] = _plus(sums[id(t.parent)], (n, low, 1, leaves, saved))
    opened = sorted((t for t in turns if t.is_open), key=lambda t: t.depth)
    for row, path in ((0, [t for t in opened if t.sides[0]]), (len(keys) - 1, [t for t in opened if not t.sides[0]])):
        if path:
            told = [(t.depth, sums[id(t)]) for t in path if sums[id(t)] != _NONE]
            yield {"kind": ENTRY, "key": keys[row], "words": words[row], "depths": [d for d, _ in told], "sums": [x for _, s in told for x in s]}
    for t in turns:
        at_end = ends.get(keys[t.row][: t.depth * TURN], []) if ids is not None and t.own[0] else []
        if t.is_open:
            for conv in at_end:
                yield {"kind": END, "node": t.digest.digest(), "conv_id": conv}
            continue
        n, low, kids, leaves, saved = t.total
        above = t.parent
        yield {
            "kind": NODE, "node": t.digest.digest() if ids is None else None, "conv_id": low, "depth": t.depth,
            "parent": above.digest.digest() if above is not None and above.is_open else None,
            "parent_conv_id": None if above is None or above.is_open else above.total[1],
            "n_convs": n, "n_children": kids, "n_leaves": leaves, "saved_tokens": saved,
            "ends_sha256": _ends(at_end) if ids is not None else None,
        }


def _level(entries: DataFrame, runs: int, first: bool) -> DataFrame:
    order = ["key", "conv_id"] if first else ["key"]
    dealt = entries.repartitionByRange(runs, *order) if runs > 1 else entries.repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, adds, ids = [], [], [], [] if first else None
        for batch in batches:
            at = batch.schema.get_field_index
            keys += batch.column(at("key")).to_pylist()
            words += batch.column(at("words")).to_pylist()
            if first:
                convs = batch.column(at("conv_id")).to_pylist()
                ids += convs
                adds += [[(len(key) // TURN, (1, conv, 0, 0, 0))] for key, conv in zip(keys[-len(convs) :] if convs else [], convs, strict=True)]
            else:
                for depths, sums in zip(batch.column(at("depths")).to_pylist(), batch.column(at("sums")).to_pylist(), strict=True):
                    adds.append([(d, tuple(sums[5 * k : 5 * k + 5])) for k, d in enumerate(depths)])
        if not keys:
            return
        rows = []
        for row in run_rows(keys, words, adds, ids, runs == 1):
            rows.append(row)
            if len(rows) == 4096:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return dealt.sortWithinPartitions(*order).mapInArrow(run, _DDL)


def _ends_of(rows: DataFrame) -> DataFrame:
    """``node``, ``ends_sha256``: the ids stream through the digest in order, so a task holds none of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        names, told = ["node", "ends_sha256"], lambda: [pa.array([node], pa.binary()), pa.array([digest.hexdigest()])]
        for batch in batches:
            for at, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == node:
                    digest.update(f",{conv}".encode())
                    continue
                if node is not None:
                    yield pa.RecordBatch.from_arrays(told(), names)
                node, digest = at, hashlib.sha256(str(conv).encode())
        if node is not None:
            yield pa.RecordBatch.from_arrays(told(), names)

    return rows.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(run, "node binary, ends_sha256 string")


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def build_trie(keys: DataFrame, *, run_keys: int = RUN_KEYS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """A row per distinct turn-aligned prefix of ``keys`` (``conv_id``, ``key``, ``words`` of each turn), see ``RESULT``.

    Keys may repeat (their conversations end at one node) and may be empty (they end at the root). Without
    keys there is no node. A task holds one run: about ``run_keys`` keys or ``run_bytes``. Of each run at most two
    entries go on to the next level, so levels shrink by thousands. The ids that end at an open node are narrow
    rows that are streamed in order.
    """
    entries, scratch = write_table(keys.select("conv_id", "key", "words"), "keys")
    nodes, ends, first = [], None, True
    while True:
        weight = F.octet_length("key") + 4 * F.size("words") + (F.lit(0) if first else 8 * F.size("sums"))
        count, size = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
        # at least eight entries to a run on average, so that a level is smaller than the one before it
        runs = max(1, min(max(-(-count // run_keys), -(-size // run_bytes)), count // 8))
        done, _ = write_table(_level(entries, runs, first), "level")
        nodes.append(done.where(F.col("kind") == NODE))
        if first:
            ends = done.where(F.col("kind") == END)
            drop_dir(keys.sparkSession, scratch)
        if runs == 1:
            break
        entries, first = done.where(F.col("kind") == ENTRY).select("key", "words", "depths", "sums"), False
    if len(nodes) == 1:
        return nodes[0].select(*RESULT)
    late = nodes[1]
    for more in nodes[2:]:
        late = late.unionByName(more)
    digests = _ends_of(ends.select("node", "conv_id"))
    late = late.drop("ends_sha256").join(digests, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    late, _ = write_table(late, "late-nodes")
    both = nodes[0].select("parent", *RESULT).unionByName(late.select("parent", *RESULT))
    waiting = both.where(F.col("parent").isNotNull()).drop("parent_conv_id")
    kids, _ = write_table(waiting.groupBy("parent").agg(F.count(F.lit(1)).alias("_kids")), "waiting")
    total = kids.agg(F.coalesce(F.sum("_kids"), F.lit(0))).first()[0]
    known = late.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")).join(kids, "parent")
    met = join_hot(waiting, write_table(known, "parents")[0], ["parent"], "_kids", total)
    return both.where(F.col("parent").isNull()).select(*RESULT).unionByName(met.select(*RESULT))


# ---- conversations --------------------------------------------------------------------------------------------


def rebuilt_keys(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``key`` and ``words`` per turn of every rebuilt conversation (the contract's rule).

    Turns are ordered by ``turn``, null first, then role, then digest. Null role and text are empty. Rows without
    a ``conv_id`` belong to no conversation. Texts become digests and word counts before anything is shuffled;
    a task holds the ids of one conversation at a time.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.md5(F.concat(F.char_length(role), F.lit(":"), role, text))
    conv = F.col("conv_id").cast("long")
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        (conv - conv % BLOCK).alias("block"), conv.alias("conv_id"), F.struct("turn", role.alias("role"), told.alias("id"), F.size(words_of(text)).alias("words")).alias("t")
    )
    own = rows.repartition("block").groupBy("block", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    head = F.first(F.when(F.col("conv_id") == F.col("block"), F.slice("own", 1, HEAD)), ignorenulls=True).over(Window.partitionBy("block"))
    none = F.slice("own", 1, 0)
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    n = F.size("own")
    whole = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(n - F.col("h"), F.lit(0))))
    made = own.withColumns({"head": head, "h": h}).select("conv_id", whole.alias("r"))
    return made.select(
        "conv_id", F.unhex(F.array_join(F.transform("r", lambda t: t["id"]), "")).alias("key"), F.transform("r", lambda t: t["words"]).alias("words")
    )


def conversation_trie(turns: DataFrame, **options) -> DataFrame:
    """The trie of the rebuilt conversations of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``; others are ignored)."""
    return build_trie(rebuilt_keys(turns), **options)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = """
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as id,
                  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''),
                                     md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as p
           from conversations where conv_id is not null),
c as (select conv_id, (4294967295 - list_reduce(list_concat([cast(4294967295 as bigint)], flatten(list_transform(range(1, length(conv_id::varchar) + 1),
               lambda k: list_transform([0, 4], lambda shift: cast((ascii(substr(conv_id::varchar, cast(k as int), 1)) >> cast(shift as int)) & 15 as bigint))))),
             lambda crc, x: xor(crc >> 4, cast([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580,
               3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][1 + cast(xor(crc & 15, x) as int)] as bigint)))) % 4 as h
      from (select distinct conv_id from t)),
r as (select c.conv_id, 0 as part, b.p, b.id, b.text from c join t b on b.conv_id = c.conv_id - c.conv_id % 20 and b.p <= c.h
      union all select c.conv_id, 1, t.p, t.id, t.text from c join t on t.conv_id = c.conv_id and t.p > c.h),
n as (select conv_id, row_number() over w as depth, md5(string_agg(id, '') over w) as node,
             len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as words
      from r window w as (partition by conv_id order by part, p rows unbounded preceding)),
p as (select conv_id, 0 as depth, 'root' as node, 0 as words, null as parent from c
      union all select conv_id, depth, node, words, lag(node, 1, 'root') over (partition by conv_id order by depth) from n),
ends as (select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from
         (select conv_id, arg_max(node, depth) as node from p group by conv_id) group by node),
nodes as (select node, any_value(depth) as depth, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words from p group by node),
kids as (select parent as node, count(*) as n_children from nodes where parent is not null group by parent),
told as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (node)),
sums as (select p.node, sum(case when told.n_children = 0 then 1 else 0 end) as n_leaves, sum((told.n_convs - 1) * told.words) as saved_tokens
         from told join p on p.conv_id = told.conv_id and p.depth <= told.depth group by p.node)
select told.conv_id, cast(told.depth as bigint) as depth, up.conv_id as parent_conv_id, told.n_convs, told.n_children,
       cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
from told join sums using (node) left join ends using (node) left join nodes up on up.node = told.parent
"""
