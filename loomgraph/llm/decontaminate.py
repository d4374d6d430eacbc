"""Benchmark decontamination with an FM-index per shard of the training texts.

Each task indexes the words of the shard in hand: suffix array, Burrows-Wheeler transform, a wavelet
matrix for ranks. Windows of the benchmark items are searched backwards, all at once; occurrences are
located through sampled suffix positions and merged to spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize, put_back, set_aside, two_hashes

WINDOW = 13
SHARD_BITS = 20
SAMPLE = 16
#: Benchmark words in one block; a larger benchmark is searched block after block.
BLOCK_WORDS = 500_000
#: Words of an item that stay together; longer items are cut with an overlap in which every window is whole.
PART_WORDS = 1 << 16

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    # all bytes of a non-ASCII character are 0x80 and more, so splitting bytes splits characters alike
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class FMIndex:
    """FM-index of an integer sequence of fewer than 2**SHARD_BITS symbols, 0 < symbol; 0 separates."""

    def __init__(self, sequence: np.ndarray):
        self.n = len(sequence) + 1
        seq = np.append(sequence + 1, 0).astype(np.int64)  # the end sorts before all and occurs once
        order = self._suffixes(seq)
        bwt = seq[order - 1]
        self.levels = max(1, int(seq.max()).bit_length())
        self.first = np.zeros(int(seq.max()) + 2, dtype=np.int64)
        np.cumsum(np.bincount(seq, minlength=len(self.first) - 1), out=self.first[1:])
        self.ones, self.zeros, column = [], [], bwt
        for level in range(self.levels - 1, -1, -1):  # wavelet matrix: a stable split by each bit
            bit = (column >> level) & 1 == 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(self.n - int(bit.sum()))
            column = np.concatenate((column[~bit], column[bit]))
        sampled = order % SAMPLE == 0
        self.sample_rank = np.concatenate(([0], np.cumsum(sampled)))
        self.sampled, self.samples = sampled, order[sampled]

    @staticmethod
    def _suffixes(seq: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling; only suffixes that still tie are sorted again."""
        n, bits = len(seq), max(1, int(seq.max()).bit_length())
        at = np.arange(n, dtype=np.uint64)
        low = np.uint64(SHARD_BITS + 1)
        mask = np.uint64((1 << (SHARD_BITS + 1)) - 1)
        depth = max(1, (63 - SHARD_BITS - 1) // bits)
        key = np.zeros(n, dtype=np.uint64)
        for k in range(depth):
            key <<= np.uint64(bits)
            key[: max(0, n - k)] |= seq[k:].astype(np.uint64)
        both = np.sort((key << low) | at)
        order = (both & mask).astype(np.int64)
        rank = np.empty(n, dtype=np.int64)
        slots = np.arange(n, dtype=np.int64)

        def settle(key: np.ndarray, order_at: np.ndarray, slots: np.ndarray) -> np.ndarray:
            """Write the ranks; the slots whose suffixes still tie with a neighbour."""
            new = np.concatenate(([True], key[1:] != key[:-1]))
            rank[order_at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            alone = new & np.concatenate((new[1:], [True]))
            return slots[~alone]

        open_slots = settle(both >> low, order, slots)
        step = depth
        while len(open_slots):
            pos = order[open_slots]
            ahead = pos + step
            after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0).astype(np.uint64)
            group = rank[pos].astype(np.uint64)
            # (group, after) in two sorts of one word each: first by what follows, then, stable, by group
            by_after = (np.sort((after << low) | np.arange(len(pos), dtype=np.uint64)) & mask).astype(np.int64)
            by_group = np.sort((group[by_after] << low) | np.arange(len(pos), dtype=np.uint64))
            pick = by_after[(by_group & mask).astype(np.int64)]
            order[open_slots] = pos[pick]
            open_slots = settle((group[pick] << low) | after[pick], pos[pick], open_slots)
            step *= 2
        return order

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each row."""
        start = np.zeros_like(row)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - level)) & 1 == 1
            start = np.where(bit, zeros + ones[start], start - ones[start])
            row = np.where(bit, zeros + ones[row], row - ones[row])
        return row - start

    def symbol(self, row: np.ndarray) -> np.ndarray:
        out = np.zeros_like(row)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[row + 1] - ones[row]
            out = out * 2 + bit
            row = np.where(bit == 1, zeros + ones[row], row - ones[row])
        return out

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all patterns (rows, filled from the left) at once: which occur, and their rows."""
        alive = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for step in range(patterns.shape[1]):
            now = alive[lengths[alive] > step]
            if not len(now):
                break
            symbol = patterns[now, lengths[now] - 1 - step] + 1
            known = symbol < len(self.first) - 1
            high[now[~known]] = low[now[~known]] = 0
            now, symbol = now[known], symbol[known]
            low[now] = self.first[symbol] + self.rank(symbol, low[now])
            high[now] = self.first[symbol] + self.rank(symbol, high[now])
            alive = alive[low[alive] < high[alive]]
        return alive, low[alive], high[alive]

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The position of each row: walk back to a sampled one."""
        steps, out, at = np.zeros_like(row), np.empty_like(row), np.arange(len(row))
        while len(at):
            known = self.sampled[row]
            out[at[known]] = self.samples[self.sample_rank[row[known]]] + steps[at[known]]
            at, row = at[~known], row[~known]
            symbol = self.symbol(row)
            row = self.first[symbol] + self.rank(symbol, row)
            steps[at] += 1
        return out


class Windows:
    """The distinct windows of a block of items, as symbols of the block's vocabulary."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.symbols: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        found: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            coded = tuple(self.symbols.setdefault(w, len(self.symbols) + 1) for w in text)
            for k in range(max(1, len(coded) - window + 1) if coded else 0):
                found.setdefault(coded[k : k + window], set()).add(number[name])
        self.lengths = np.array([len(w) for w in found], dtype=np.int64)
        self.patterns = np.zeros((len(found), window), dtype=np.int32)
        for i, w in enumerate(found):
            self.patterns[i, : len(w)] = w
        self.items = [sorted(x) for x in found.values()]
        self.shortest = int(self.lengths.min()) if found else 0
        self.longest = int(self.lengths.max()) if found else 0

    def find(self, docs: list[list[bytes]]) -> tuple[dict[int, np.ndarray], dict[int, set[int]]]:
        """Per document with hits: the word numbers that are hit, and the items (numbers into ``names``)."""
        hit: dict[int, list[np.ndarray]] = {}
        items: dict[int, set[int]] = {}
        if not len(self.lengths):
            return {}, {}
        for sequence, doc_of, word_of in self._shards(docs):
            index = FMIndex(sequence)
            which, low, high = index.search(self.patterns, self.lengths)
            if not len(which):
                continue
            count = high - low
            rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            at, pattern = index.locate(rows), np.repeat(which, count)
            edges = np.zeros(len(sequence) + 1, dtype=np.int64)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + self.lengths[pattern], -1)
            inside = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
            some, at_doc = np.unique(doc_of[inside], return_index=True)  # a shard holds documents in order
            for d, x in zip(some.tolist(), np.split(word_of[inside], at_doc[1:]), strict=True):
                hit.setdefault(d, []).append(x)
            pairs = np.unique(np.stack((doc_of[at], pattern), axis=1), axis=0)
            for d, p in pairs.tolist():
                items.setdefault(d, set()).update(self.items[p])
        return {d: np.unique(np.concatenate(x)) for d, x in hit.items()}, items

    def _shards(self, docs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Sequences of under 2**SHARD_BITS symbols with the document and word of each.

        A window holds benchmark words only, so runs of them that are shorter than the shortest window
        are left out, and one separator stands for everything between runs. Longer runs than a shard are
        cut with an overlap in which every window is whole.
        """
        room, get = (1 << SHARD_BITS) - 2, self.symbols.get
        parts, held = [], 0
        for d, text in enumerate(docs):
            coded = np.fromiter((get(w, 0) for w in text), dtype=np.int64, count=len(text))
            edge = np.flatnonzero(np.diff(np.concatenate(([0], coded != 0, [0]))))
            for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if hi - lo < self.shortest:
                    continue
                for a in range(lo, max(lo + 1, hi - self.longest + 1), room - self.longest):
                    b = min(hi, a + room - 1)
                    if held + b - a + 1 > room:
                        yield self._join(parts)
                        parts, held = [], 0
                    parts.append((d, a, coded[a:b]))
                    held += b - a + 1
        if parts:
            yield self._join(parts)

    @staticmethod
    def _join(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) + 1 for _, _, x in parts])
        sequence = np.concatenate([y for _, _, x in parts for y in (x, [0])])
        doc_of = np.repeat(np.array([d for d, _, _ in parts]), sizes)
        word_of = np.concatenate([np.arange(a, a + len(x) + 1) for _, a, x in parts])
        return sequence, doc_of, word_of


def _blocks(items: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> DataFrame:
    """The benchmark's windows in blocks of bounded size, a pickled ``Windows`` a row.

    Tasks cut the items and build the blocks; the driver only counts words and hands one block on at a time.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(PART_WORDS, block_words))
        for batch in batches:
            names, parts, sizes = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(text) if name is not None else []
                for a in range(0, max(len(found) and 1, len(found) - window + 1), step):
                    part = found[a : a + step + window - 1]
                    names.append(name)
                    parts.append(b" ".join(part).decode("utf-8", "surrogatepass"))
                    sizes.append(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.string()), pa.array(sizes, pa.int64())], ["name", "part", "n"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(block: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(Windows(block, window))], pa.binary())], ["block"])

        block, held = [], 0
        for batch in batches:
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(part)
                if block and held + len(found) > block_words:
                    yield packed(block)
                    block, held = [], 0
                block.append((name, found))
                held += len(found)
        if block:
            yield packed(block)

    named = items.select(F.col(item_col).cast("string"), text_col)
    parts = materialize(named.mapInArrow(cut, "name string, part string, n long"), "benchmark-parts")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = parts.select("name", "part").repartition(total // block_words + 1)
    return materialize(dealt.mapInArrow(build, "block binary"), "benchmark-blocks")


def find_benchmark(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    *,
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep_text: bool = True,
) -> DataFrame:
    """Find where windows of benchmark items occur in the documents.

    Words are runs of digits, letters and non-ASCII characters with A-Z lower-cased. A window is
    ``window`` consecutive words of an item; an item with fewer words, but not none, is one window.

    Adds ``n_words`` and ``n_hit`` (long; words inside an occurrence of any window), ``items`` (array of the
    item ids, as strings, sorted, that have an occurring window) and ``spans`` (array of {start, end} in
    code points, merged, end exclusive). Columns of these names in the input are replaced. With
    ``keep_text=False`` the text column is left out of the result.

    Null and empty texts have no words, no hits and empty arrays. Items without words or id are skipped;
    with none left nothing is hit. Repeated rows are looked at one by one; an empty table gives an empty
    table. Texts are searched whole: those longer than a shard in overlapping parts.

    With one block no document is shuffled. Only a block of the benchmark, of at most ``block_words`` words (and a part of
    an item), is sent to the tasks. With more than one block each is a pass that reads the texts and writes
    its hits only, by the text's 128-bit hash, and the last pass is joined with them; so one block is held at
    a time, on the driver and on the executors, and the documents themselves are never written.
    """
    spark = docs.sparkSession
    columns = docs.drop("n_words", "n_hit", "items", "spans").columns
    plain = set_aside(docs.select(*[F.col(f"`{c}`") for c in columns]), text_col)
    out = plain.select(
        *[F.col(f"`{c}`") for c in plain.columns],
        F.expr("cast(null as bigint) as n_words"),
        F.expr("cast(array() as array<string>) as items"),
        F.expr("cast(array() as array<int>) as _hit"),
    )
    blocks = _blocks(items, item_col, item_text_col, window, block_words)
    left, earlier = blocks.count(), []
    if not left:
        out = _search(out, text_col, spark.sparkContext.broadcast(cloudpickle.dumps(Windows([], window))))
    texts = plain.select(F.col(f"`{text_col}`").alias("_text"))
    for row in blocks.toLocalIterator():
        block = spark.sparkContext.broadcast(bytes(row["block"]))
        left -= 1
        if left:
            earlier.append(materialize(_hits(texts, block), "benchmark-hits"))
            block.destroy()
        else:
            out = _search(out, text_col, block)
    if earlier:
        out = _with_hits(out, text_col, reduce(DataFrame.unionByName, earlier))
    out = _spans(out, text_col)
    keep = [c for c in columns if keep_text or c != text_col]
    return out.select(*put_back(keep, text_col), "n_words", F.col("_n_hit").alias("n_hit"), "items", "spans")


def _search(docs: DataFrame, text_col: str, block) -> DataFrame:
    """One pass: ``n_words``, ``items`` and ``_hit`` (the numbers of hit words) with this block's hits added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = cloudpickle.loads(block.value)
        for batch in batches:
            names = batch.schema.names
            texts = [words(x) for x in batch.column(names.index(text_col)).to_pylist()]
            hit, found = windows.find(texts)
            columns = dict(zip(names, batch.columns, strict=True))
            columns["n_words"] = pa.array([len(x) for x in texts], pa.int64())
            if found:
                items, marks = columns["items"].to_pylist(), columns["_hit"].to_pylist()
                for d, x in found.items():
                    items[d] = sorted({*items[d], *(windows.names[i] for i in x)}, key=lambda s: s.encode())
                    marks[d] = sorted({*marks[d], *hit[d].tolist()})
                columns["items"] = pa.array(items, batch.schema.field("items").type)
                columns["_hit"] = pa.array(marks, batch.schema.field("_hit").type)
            yield pa.RecordBatch.from_arrays([columns[x] for x in names], names)

    return docs.mapInArrow(run, docs.schema)


def _hits(texts: DataFrame, block) -> DataFrame:
    """What one block hits, a row per distinct text that it hits: the text's hashes, ``items``, ``_hit``."""
    from_none = [F.expr("cast(null as bigint) as n_words"), F.expr("cast(array() as array<string>) as items"), F.expr("cast(array() as array<int>) as _hit")]
    hit = _search(texts.select("_text", *from_none), "_text", block).where(F.size("_hit") > 0)
    h1, h2 = two_hashes(F.col("_text"))
    return hit.select(h1.alias("_h1"), h2.alias("_h2"), "items", "_hit").dropDuplicates(["_h1", "_h2"])


def _with_hits(docs: DataFrame, text_col: str, hits: DataFrame) -> DataFrame:
    """``items`` and ``_hit`` with the hits of the blocks before added, which have a row per text and block at most."""
    gathered = lambda c: F.flatten(F.collect_list(c)).alias(f"{c}_before")
    before = materialize(hits.groupBy("_h1", "_h2").agg(gathered("items"), gathered("_hit")), "benchmark-hits")
    h1, h2 = two_hashes(F.col(f"`{text_col}`"))
    met = docs.join(before, (before["_h1"] == h1) & (before["_h2"] == h2), "left")
    both = lambda c: F.array_sort(F.array_union(c, F.coalesce(f"{c}_before", F.slice(c, 1, 0)))).alias(c)
    return met.select(*[both(c) if c in ("items", "_hit") else F.col(f"`{c}`") for c in docs.columns])


def _spans(docs: DataFrame, text_col: str) -> DataFrame:
    """``_n_hit`` and ``spans`` from the hit words; only texts with hits reach Python."""
    span_type = "array<struct<start:int,end:int>>"

    @F.pandas_udf(span_type)
    def merge(texts, hits):
        import pandas as pd

        out = []
        for text, hit in zip(texts, hits, strict=True):
            spans = []
            if hit is not None and len(hit):
                marked, last = set(map(int, hit)), -2
                for i, m in enumerate(_WORD.finditer(text)):
                    if i in marked:
                        if last == i - 1:
                            spans[-1]["end"] = m.end()
                        else:
                            spans.append({"start": m.start(), "end": m.end()})
                        last = i
            out.append(spans)
        return pd.Series(out)

    hit_text = F.when(F.size("_hit") > 0, F.col(text_col))
    return docs.withColumns({"_n_hit": F.size("_hit").cast("long"), "spans": merge(hit_text, F.col("_hit"))})


def remove_spans(text, spans):
    """The text without the given spans, by built-in functions: what stands between them, joined."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    parts = F.transform(
        starts,
        lambda a, i: F.substring(
            text, a + 1, F.coalesce(F.get(F.transform(spans, lambda s: s["start"]), i), F.char_length(text)) - a
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(parts, ""))


def contaminated():
    """The contract's rule: hits are a twentieth of the words at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_benchmark(docs, items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
OP2_SQL = f"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g, least(len(w), 13) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, {_SQL_WORDS} AS w FROM documents
), ks AS (
  SELECT DISTINCT k FROM bw
), dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), h AS (
  SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k
), n AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM h, (SELECT unnest(range(0, 13)) AS o) WHERE o < k GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
