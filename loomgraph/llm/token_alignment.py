"""Alignment of two tokenizers' tokens over the same text, and how often their ids meet in a corpus.

Tokens of both sides that end at the same byte cut a text into groups. Texts are encoded segment by segment: before a
single space or around a single newline, between characters that aren't white space, tokens of both sides end, so
segments are encoded apart and remembered.

A long text is cut into byte ranges, wherever that falls, and its ranges are encoded by many tasks. Each gives a
fragment: the tokens before its first common end (open prefix), its closed groups, the tokens after its last one (open
suffix). Fragments compose associatively (``compose``): the left one's suffix and the right one's prefix close
groups between them. Rounds of composition reduce the fragments of a text as a tree; only open ends move, closed groups stay where
they are.

Corpus-wide counts never meet a text: tasks write packets of documents with their id pairs numbered, packets ask for
the counts of the pairs that they hold, and sums are made packet by packet.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import drop_dir, write_table

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k", "piece_bpe_32k"
#: Bytes of a range of a long text; texts up to that are not cut.
RANGE = 1 << 15
#: Characters of text in a packet, about.
PACKET = 1 << 20
#: Fragments that one task composes, one after the other, to one.
FAN = 64
#: Segments that a worker remembers before it starts afresh.
MEMO = 100_000

#: Where a text may be cut: tokens of both sides end there.
SAFE = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
ODD = re.compile(r"[^\S \n]").search
INNER = re.compile(r"\s").search
#: A group with more links than that isn't spelt out link by link.
LARGE = 10_000


# ---- fragments ------------------------------------------------------------------------------------------------

Tokens = tuple[tuple[tuple[int, int], ...], tuple[tuple[int, int], ...]]  # of A and of B: (id, byte at which it ends)
NO_TOKENS: Tokens = ((), ())


@dataclass(frozen=True)
class Fragment:
    """Open ends of a byte range. ``solid``: it has no common end, and all its tokens are in ``prefix``."""

    prefix: Tokens = NO_TOKENS
    suffix: Tokens = NO_TOKENS
    solid: bool = True
    ok: bool = True


EMPTY = Fragment()
#: A range that begins and ends where tokens of both sides end, its groups told elsewhere.
WHOLE = Fragment(solid=False)


def _joined(x: Tokens, y: Tokens) -> Tokens:
    return x[0] + y[0], x[1] + y[1]


def groups_of(tokens: Tokens) -> tuple[list[Tokens], Tokens]:
    """Groups that end at common ends, and the tokens after the last of those."""
    a, b = tokens
    closed, i, j, p, q = [], 0, 0, 0, 0
    while i < len(a) and j < len(b):
        if a[i][1] < b[j][1]:
            i += 1
        elif a[i][1] > b[j][1]:
            j += 1
        else:
            i, j = i + 1, j + 1
            closed.append((a[p:i], b[q:j]))
            p, q = i, j
    return closed, (a[p:], b[q:])


def fragment_of(tokens: Tokens, ok: bool = True) -> tuple[Fragment, list[Tokens]]:
    """The fragment of a range's tokens, and the groups that are closed in it."""
    closed, rest = groups_of(tokens)
    if not closed:
        return Fragment(prefix=tokens, ok=ok), []
    return Fragment(closed[0], rest, False, ok), closed[1:]


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, list[Tokens]]:
    """The fragment of two ranges that follow each other, and the groups that close between them."""
    ok = left.ok and right.ok
    closed, rest = groups_of(_joined(left.prefix if left.solid else left.suffix, right.prefix))
    if not right.solid:  # its prefix ends at a common end, so nothing is left over
        closed, rest = closed + [rest] * any(rest), right.suffix
    if not left.solid:
        return Fragment(left.prefix, rest, False, ok), closed
    if not right.solid:
        return Fragment(closed[0] if closed else NO_TOKENS, rest, False, ok), closed[1:]
    return (Fragment(closed[0], rest, False, ok), closed[1:]) if closed else (Fragment(rest, ok=ok), [])


def finish(whole: Fragment) -> list[Tokens]:
    """The groups that are still open in the fragment of a whole text: those at its beginning and end."""
    out = []
    for tokens in (whole.prefix, whole.suffix):
        closed, rest = groups_of(tokens)
        out += closed + [rest] * any(rest)
    return out


# ---- segments -------------------------------------------------------------------------------------------------


def _end(group: Tokens) -> int:
    return max(side[-1][1] for side in group if side)


def told(group: Tokens) -> str:
    return ",".join(str(i) for i, _ in group[0]) + "|" + ",".join(str(i) for i, _ in group[1])


class Segments:
    """Numbered segments with what is to be known of each; numbered id pairs.

    ``spaced`` holds segments by what follows their leading space, ``plain`` those without one.
    """

    def __init__(self, a_path: str, a_pattern: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as f:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.a_bytes = dict(map(reversed, ranks.items()))
        encoding = tiktoken.Encoding("a", pat_str=a_pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode_a, self.whole_a = encoding.encode_ordinary, encoding.encode_to_numpy
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if odd := [x for x in pieces if "\n" in x or re.search("[^▁]▁", x)]:
            raise ValueError(f"pieces that go on over a safe cut: {odd[:3]}")
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.a_size, self.b_size = np.zeros(max(self.a_bytes) + 1, np.int64), np.array([len(x) for x in self.b_bytes])
        for i, x in self.a_bytes.items():
            self.a_size[i] = len(x)
        self.written = [f"{i}{x}".encode() for n, ends in ((len(self.a_size), ",|"), (len(self.b_size), ",;\n")) for x in ends for i in range(n)]
        self.forget()

    def forget(self) -> None:
        self.spaced, self.plain, self.pairs = {}, {}, {}
        self.texts, self.ok = [], []
        self.stats, self.slots, self.weights, self.ends = array("q"), array("q"), array("q"), array("q", [0])

    def tokens(self, segments: list[str], base: int = 0) -> list[tuple[Tokens, bool]]:
        """Tokens of segments, each from byte ``base`` on, and whether both sides give back its bytes."""
        lead = [0 if s.startswith(" ") else 2 for s in segments]  # tokens of "\\n" before it, which keeps B's own space away
        found = self.b.encode([s[1:] if not k else "\n" + s for s, k in zip(segments, lead, strict=True)], num_threads=1)
        out = []
        for segment, k, b_ids in zip(segments, lead, found, strict=True):
            raw, sides, ok = segment.encode(), [], True
            for ids, known in ((self.encode_a(segment), self.a_bytes), (b_ids[k:], self.b_bytes)):
                parts, at, side = [known[i] for i in ids], base, []
                for i, part in zip(ids, parts, strict=True):
                    at += len(part)
                    side.append((i, at))
                sides.append(tuple(side))
                ok = ok and b"".join(parts) == raw
            out.append(((sides[0], sides[1]), ok))
        return out

    def add(self, groups: Iterable[Tokens], ok: bool = True) -> int:
        """Number closed groups as a segment."""
        groups = list(groups)
        n_links, links = 0, Counter()
        for a, b in groups:
            n_links += len(a) * len(b)
            if len(a) == 1 and len(b) == 1:
                links[a[0][0] << 32 | b[0][0]] += 1
                continue
            for x, m in Counter(i for i, _ in a).items():
                for y, n in Counter(i for i, _ in b).items():
                    links[x << 32 | y] += m * n
        pairs = self.pairs
        self.slots.extend([pairs.setdefault(x, len(pairs)) for x in links])
        self.weights.extend(links.values())
        self.ends.append(len(self.slots))
        self.texts.append(";".join(map(told, groups)).encode())
        self.stats.extend((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), n_links))
        self.ok.append(ok)
        return len(self.texts) - 1

    def encode_all(self, names: list[str], lead: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A for all segments, how many each has, and the same of B."""
        plain = [i for i, x in enumerate(names) if not INNER(x)]
        # a newline between them is a token of its own, so segments without white space are encoded in one call
        text = "\n".join([lead + names[i] for i in plain])
        ids = self.whole_a(text, allowed_special=set(), disallowed_special=()).astype(np.int64) if plain else np.zeros(0, np.int64)
        at = np.cumsum(self.a_size[ids])
        ends = np.cumsum([len((lead + names[i]).encode()) + 1 for i in plain]) - 1
        upto = np.searchsorted(at, ends, "right")  # tokens up to a segment's end; the newline's follows
        n_a = np.zeros(len(names), np.int64)
        n_a[plain] = np.diff(upto, prepend=-1) - 1
        ids = np.delete(ids, upto[:-1])
        if len(plain) < len(names):
            given = dict(zip(plain, np.split(ids, np.cumsum(n_a[plain])[:-1]), strict=True)) if plain else {}
            for i in set(range(len(names))).difference(plain):
                given[i] = np.array(self.encode_a(lead + names[i]), np.int64)
                n_a[i] = len(given[i])
            ids = np.concatenate([given[i] for i in range(len(names))])
        skip = 0 if lead else 2  # tokens of a newline before it, which keeps B's own space away
        found = self.b.encode(names if lead else ["\n" + x for x in names], num_threads=1)
        n_b = np.fromiter(map(len, found), np.int64, len(found))
        ids_b = np.fromiter(chain.from_iterable(found), np.int64, int(n_b.sum()))
        if skip:
            first = np.cumsum(n_b) - n_b
            ids_b = np.delete(ids_b, np.concatenate([first, first + 1]))
        return ids, n_a, ids_b, n_b - skip

    def learn(self, known: dict, names: set, lead: str) -> None:
        """Number new segments, all at once; those with very large groups one by one (``add``)."""
        new = [x for x in names if x not in known]
        if not new:
            return
        raw = [(lead + x).encode() for x in new]
        a, n_a, b, n_b = self.encode_all(new, lead)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        size_a, size_b = (_sums(sizes[ids], n) for sizes, ids, n in ((self.a_size, a, n_a), (self.b_size, b, n_b)))
        good = (size_a == size) & (size_b == size)
        joined = lambda ids, n, k, side: b"".join([side[i] for i in ids[np.repeat(k, n)].tolist()])
        text = b"".join([x for x, k in zip(raw, good, strict=True) if k])
        if joined(a, n_a, good, self.a_bytes) != text or joined(b, n_b, good, self.b_bytes) != text:
            for i in np.flatnonzero(good):
                one = np.arange(len(raw)) == i
                good[i] = joined(a, n_a, one, self.a_bytes) == raw[i] == joined(b, n_b, one, self.b_bytes)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        end_a, end_b, ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.cumsum(size[good])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b, segment = np.searchsorted(common, end_a), np.searchsorted(common, end_b), np.searchsorted(ends, common)
        in_a, in_b = np.bincount(of_a, minlength=len(common)), np.bincount(of_b, minlength=len(common))
        large = np.zeros(len(ends), bool)
        large[segment[in_a * in_b > LARGE]] = True
        # links: each token of A with all tokens of B of its group
        times = np.where(large[segment[of_a]], 0, in_b[of_a]) if len(a) else in_b[of_a]
        first_b = np.cumsum(in_b) - in_b
        place = np.repeat(first_b[of_a] - np.cumsum(times) + times, times) + np.arange(times.sum())
        codes, slots = np.unique(np.repeat(a, times) << 32 | b[place], return_inverse=True)
        pairs = self.pairs
        numbers = np.fromiter((pairs.setdefault(x, len(pairs)) for x in codes.tolist()), np.int64, len(codes))[slots]
        links = np.bincount(np.repeat(segment[of_a], times), minlength=len(ends))
        # groups as text: the tokens in order, each with what follows it
        last_a, last_b = np.diff(of_a, append=-1) != 0, np.diff(of_b, append=-1) != 0
        seg_end = np.diff(segment, append=-1) != 0
        follows_b = np.where(last_b, np.where(seg_end[of_b], 2, 1), 0)
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        written = np.concatenate([a + last_a * len(self.a_size), b + 2 * len(self.a_size) + follows_b * len(self.b_size)])[order]
        texts = b"".join(map(self.written.__getitem__, written.tolist())).split(b"\n")
        counts = [np.bincount(x, minlength=len(ends)) for x in (segment[of_a], segment[of_b], segment)]
        where = np.full(len(raw), -1)
        where[good] = np.arange(len(ends))
        base = len(self.slots)
        self.slots.frombytes(numbers.tobytes())
        self.weights.frombytes(np.ones(len(numbers), np.int64).tobytes())
        stats = np.zeros((len(raw), 4), np.int64)
        stats[good] = np.stack([*counts, links], axis=1)
        self.stats.frombytes(stats.tobytes())
        per_name = np.zeros(len(raw), np.int64)
        per_name[good] = links
        self.ends.frombytes((base + np.cumsum(per_name)).tobytes())
        begin = len(self.texts)
        self.texts.extend([texts[k] if k >= 0 else b"" for k in where.tolist()])
        self.ok.extend(good.tolist())
        known.update(zip(new, range(begin, begin + len(new)), strict=True))
        for i in np.flatnonzero(good):
            if large[where[i]]:
                ((tokens, ok),) = self.tokens([lead + new[i]])
                known[new[i]] = self.add(groups_of(tokens)[0], ok)

    def numbers(self, texts: list[list[tuple[bool, list[str]]]]) -> list[list[int]]:
        """The numbers of the segments of texts, given as runs of (spaced, names)."""
        for spaced, known, lead in ((True, self.spaced, " "), (False, self.plain, "")):
            self.learn(known, set().union(*(names for runs in texts for s, names in runs if s is spaced)), lead)
        out = []
        for runs in texts:
            ids: list[int] = []
            for spaced, names in runs:
                ids += map((self.spaced if spaced else self.plain).__getitem__, names)
            out.append(ids)
        return out


def _named(segment: str) -> tuple[bool, list[str]]:
    return segment.startswith(" "), [segment.removeprefix(" ")]


def runs_of(text: str) -> list[tuple[bool, list[str]]]:
    """The segments of a text that begins with a space, as runs of (spaced, names)."""
    body = text[1:]
    if not body or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or body[-1] in " \n" or ODD(body):
        return [_named(x) for x in SAFE.split(text) if x]
    first, *lines = body.split("\n")
    out = [(True, first.split(" "))]
    for line in lines:
        head, *names = line.split(" ")
        out += [(False, ["\n", head]), (True, names)]
    return out


# ---- packets --------------------------------------------------------------------------------------------------


@dataclass
class Unit:
    """Closed groups of a document: all of them, or those of a part. ``at`` orders the parts."""

    numbers: list[int]
    doc: object = None
    row: int | None = None
    at: int = 0


@dataclass
class Packer:
    """Gathers units and makes packets of them; ``parts``: units are parts of documents, else whole ones."""

    segments: Segments
    name: str
    parts: bool
    units: list[Unit] = field(default_factory=list)
    made: int = 0

    def packet(self) -> dict:
        s, units = self.segments, self.units
        good = [all(map(s.ok.__getitem__, u.numbers)) for u in units]
        numbers = [np.array(u.numbers if g else [], dtype=np.int64) for u, g in zip(units, good, strict=True)]
        per_unit = np.array([len(x) for x in numbers], dtype=np.int64)
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        unit = np.repeat(np.arange(len(units)), per_unit)
        stats = _sums(_view(s.stats).reshape(-1, 4)[flat], per_unit)
        # distinct segments of each unit, then their pairs, then distinct pairs
        key, times = np.unique(unit * len(s.texts) + flat, return_counts=True)
        unit, flat = np.divmod(key, max(len(s.texts), 1))
        ends = _view(s.ends)
        size = ends[flat + 1] - ends[flat]
        place = np.repeat(ends[flat] - np.cumsum(size) + size, size) + np.arange(size.sum())
        n_pairs = max(len(s.pairs), 1)
        key = np.repeat(unit, size) * n_pairs + _view(s.slots)[place]
        weight = _view(s.weights)[place] * np.repeat(times, size)
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        weight = np.add.reduceat(weight, first) if len(first) else weight[:0]
        unit, slot = np.divmod(key[first], n_pairs)
        used, slot, holders = np.unique(slot, return_inverse=True, return_counts=True)
        codes = np.fromiter(s.pairs, dtype=np.int64, count=len(s.pairs))[used]
        per_unit = np.bincount(unit, minlength=len(units))
        delta = np.diff(slot, prepend=0)
        raw = b"".join(x.astype("<i8" if x is weight or x is stats else "<i4").tobytes() for x in (per_unit, delta, weight, stats))
        out = {
            "packet": f"{self.name}-{self.made}", "pairs": codes, "holders": holders.astype(np.int32) if not self.parts else np.zeros(len(codes), np.int32),
            "blob": zstandard.ZstdCompressor(level=1).compress(raw), "sizes": [len(units), len(slot)],
            "docs": [u.doc for u in units], "rows": [u.row for u in units],
        }
        texts = [b";".join(map(s.texts.__getitem__, u.numbers)) if g else b"" for u, g in zip(units, good, strict=True)]
        if self.parts:
            out |= {"at": [u.at for u in units], "texts": texts, "held_rows": np.array([u.row for u in units], np.int64)[unit], "held": codes[slot]}
        else:
            out["sha"] = [hashlib.sha256(x).hexdigest() if x else "" for x in texts]
        self.units, self.made = [], self.made + 1
        if len(s.texts) > MEMO:
            s.forget()
        return out


def _view(numbers: array) -> np.ndarray:
    return np.frombuffer(numbers, np.int64) if numbers else np.zeros(0, np.int64)


def _sums(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive ``counts`` rows; 0 for none."""
    total = np.concatenate([np.zeros((1, *rows.shape[1:]), rows.dtype), np.cumsum(rows, axis=0)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


def _opened(blob: bytes, sizes: list[int]) -> tuple[np.ndarray, ...]:
    units, entries = sizes
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for n, kind in ((units, "<i4"), (entries, "<i4"), (entries, "<i8"), (4 * units, "<i8")):
        part = np.frombuffer(raw, kind, n, at)
        out.append(part)
        at += part.nbytes
    return out[0].astype(np.int64), np.cumsum(out[1].astype(np.int64)), out[2], out[3].reshape(-1, 4)


_LISTS = {"pairs": pa.int64(), "holders": pa.int32(), "sizes": pa.int64(), "rows": pa.int64(), "sha": pa.string(), "at": pa.int64(), "texts": pa.binary(), "held_rows": pa.int64(), "held": pa.int64()}
_SIDES = ("prefix_a", "prefix_b", "suffix_a", "suffix_b")  # (id, end) pairs, flattened


def _schema(id_type: pa.DataType) -> pa.Schema:
    out = [("packet", pa.string()), ("blob", pa.binary()), ("docs", pa.list_(id_type)), *((k, pa.list_(t)) for k, t in _LISTS.items())]
    out += [("row", pa.int64()), ("doc", id_type), ("k", pa.int64()), ("solid", pa.bool_()), ("ok", pa.bool_()), *((k, pa.list_(pa.int64())) for k in _SIDES)]
    return pa.schema(out)


def _ddl(id_type: str) -> str:
    kinds = {"int64": "long", "int32": "int", "string": "string", "binary": "binary"}
    lists = ", ".join(f"{k} array<{kinds[str(t)]}>" for k, t in _LISTS.items())
    sides = ", ".join(f"{k} array<long>" for k in _SIDES)
    return f"packet string, blob binary, docs array<{id_type}>, {lists}, row long, doc {id_type}, k long, solid boolean, ok boolean, {sides}"


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _fragment_row(row: int, doc, k: int, f: Fragment) -> dict:
    flat = [[v for pair in side for v in pair] for side in (*f.prefix, *f.suffix)]
    return {"row": row, "doc": doc, "k": k, "solid": f.solid, "ok": f.ok} | dict(zip(_SIDES, flat, strict=True))


def _fragment_from(r: dict) -> Fragment:
    a, b, c, d = (tuple(zip(r[k][::2], r[k][1::2], strict=True)) for k in _SIDES)
    return Fragment((a, b), (c, d), r["solid"], r["ok"])


# ---- long texts -----------------------------------------------------------------------------------------------


def _around(text: str, at: int, most: int) -> tuple[int, int] | None:
    """The last safe cut at or before ``at`` and the first at or after it, none if they are over ``most`` apart."""
    width = 256
    while True:
        width = min(width, most)
        low, high = max(0, at - width), min(len(text), at + width)
        cuts = [m.start() for m in SAFE.finditer(text, low, min(len(text), high + 2))]
        left = max((x for x in cuts if low + 1 < x <= at), default=0 if not low else None)
        right = min((x for x in cuts if x >= at), default=len(text) if high == len(text) else None)
        if left is not None and right is not None:
            return (left, right) if right - left <= most else None
        if width == most:
            return None
        width *= 4


def ranges(text: str, size: int) -> Iterator[tuple[str, int, int, int]]:
    """(text, first byte, from, to): the segments that meet a range, the byte they begin at, and the range in bytes.

    Ranges begin every ``size`` characters, inside segments as it comes; a segment longer than that is not cut.
    """
    places = [(0, 0, 0)]
    places += [(around[0], at, around[1]) for at in range(size, len(text), size) if (around := _around(text, at, size))]
    places.append((len(text), len(text), len(text)))
    base, lo = 0, 0
    for (left, start, _), (next_left, end, right) in zip(places, places[1:], strict=False):
        hi = lo + len(text[start:end].encode())
        yield text[left:right], base, lo, hi
        base, lo = hi - len(text[next_left:end].encode()), hi


def range_fragment(s: Segments, text: str, base: int, lo: int, hi: int) -> tuple[Fragment, list[tuple[int, list[int]]]]:
    """A range's fragment and its closed groups as (order, segment numbers)."""
    names = [x for x in SAFE.split(text) if x]
    sizes = [len(x.encode()) for x in names]
    closed: list[tuple[int, list[int]]] = []

    def edge(name: str, at: int) -> tuple[Tokens, bool]:
        """The tokens of a segment that begin in the range."""
        ((tokens, ok),) = s.tokens([name], at)
        begins = [(at, *(end for _, end in side)) for side in tokens]
        own = [tuple(t for t, start in zip(side, starts, strict=False) if lo <= start < hi) for side, starts in zip(tokens, begins, strict=True)]
        return (own[0], own[1]), ok

    def keep(groups: list[Tokens]) -> None:
        if groups:
            closed.append((2 * _end(groups[-1]), [s.add(groups)]))

    whole, at = WHOLE, base
    if first := base < lo:
        (tokens, ok), at = edge(names[0], at), at + sizes[0]
        whole, groups = fragment_of(tokens, ok)
        keep(groups)
        if at <= hi:
            whole, groups = compose(whole, WHOLE)
            keep(groups)
    last = len(names) > first and base + sum(sizes) > hi
    if middle := names[first : len(names) - last]:
        (numbers,) = s.numbers([[_named(x) for x in middle]])
        whole = Fragment(whole.prefix, NO_TOKENS, False, whole.ok and all(s.ok[i] for i in numbers))
        closed.append((2 * at + 1, numbers))
        at += sum(sizes[first : len(names) - last])
    if last:  # it begins where tokens of both sides end
        tokens, ok = edge(names[-1], at)
        groups, rest = groups_of(tokens)
        whole = Fragment(whole.prefix, rest, False, whole.ok and ok)
        keep(groups)
    return whole, closed


# ---- the corpus -----------------------------------------------------------------------------------------------


def _paths(a_vocabulary: str, b_vocabulary: str) -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path(f"{a_vocabulary}.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path(f"{b_vocabulary}.model")


def _short(docs: DataFrame, id_type: str, paths: tuple) -> DataFrame:
    """Packets of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, schema = Segments(*paths), None
        packer = Packer(segments, f"d{TaskContext.get().partitionId()}", False)
        for batch in batches:
            schema = schema or _schema(batch.schema.field(0).type)
            waiting, size = [], 0
            for at in range(0, batch.num_rows, 64):  # a few texts at a time become Python's
                for doc, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    waiting.append((doc, runs_of(" " + text) if text else []))
                    size += len(text or "") + 64
                if size > PACKET:
                    yield _packed(packer, waiting, schema)
                    waiting, size = [], 0
            if waiting:
                yield _packed(packer, waiting, schema)

    return docs.mapInArrow(run, _ddl(id_type))


def _packed(packer: Packer, waiting: list, schema: pa.Schema) -> pa.RecordBatch:
    numbers = packer.segments.numbers([runs for _, runs in waiting])
    packer.units = [Unit(ids, doc=doc) for ids, (doc, _) in zip(numbers, waiting, strict=True)]
    return _batch([packer.packet()], schema)


def _cut(docs: DataFrame, id_type: str, size: int) -> DataFrame:
    """Ranges of long texts, dealt out by hash whatever text they are of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*batch.columns, strict=True):
                found = [(row.as_py(), doc.as_py(), k, *r) for k, r in enumerate(ranges(" " + text.as_py(), size))]
                for at in range(0, len(found), 64):
                    kinds = (pa.int64(), doc.type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                    columns = zip(*found[at : at + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["row", "doc", "k", "text", "base", "lo", "hi"])

    cut = docs.mapInArrow(run, f"row long, doc {id_type}, k long, text string, base long, lo long, hi long")
    return cut.repartition(F.xxhash64("row", "k"))


def _fragments(cut: DataFrame, id_type: str, paths: tuple) -> DataFrame:
    """Packets of closed groups, and a fragment per range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(*paths)
        packer, size, out = Packer(segments, f"r{TaskContext.get().partitionId()}", True), 0, []
        schema = None
        for batch in batches:
            schema = schema or _schema(batch.schema.field(1).type)
            for row, doc, k, text, base, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole, closed = range_fragment(segments, text, base, lo, hi)
                packer.units += [Unit(numbers, row=row, at=at) for at, numbers in closed]
                out.append(_fragment_row(row, doc, k, whole))
                size += len(text)
                if size > PACKET:
                    yield _batch([*out, packer.packet()], schema)
                    size, out = 0, []
        if out:
            yield _batch([*out, packer.packet()], schema)

    return cut.mapInArrow(run, _ddl(id_type))


def _round(fragments: DataFrame, id_type: str, fan: int, number: int, last: bool, paths: tuple) -> DataFrame:
    """Compose each ``fan`` fragments that follow each other; the last round closes what is open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(*paths)
        packer, schema = Packer(segments, f"s{number}-{TaskContext.get().partitionId()}", True), None
        at, doc, whole, out = None, None, EMPTY, []

        def keep(row: int, groups: list[Tokens]) -> None:
            if groups:
                packer.units.append(Unit([segments.add(groups)], row=row, at=2 * _end(groups[-1])))

        def done() -> None:
            for group in finish(whole) if last else ():  # one by one: its beginning and its end lie apart
                keep(at[0], [group])
            out.append(_fragment_row(at[0], doc, at[1], Fragment(ok=whole.ok) if last else whole))

        for batch in batches:
            schema = schema or _schema(batch.schema.field(1).type)
            for r in batch.to_pylist():
                here = (r["row"], r["k"] // fan)
                if here != at:
                    if at is not None:
                        done()
                    at, doc, whole = here, r["doc"], EMPTY
                whole, groups = compose(whole, _fragment_from(r))
                keep(here[0], groups)
            if len(packer.units) > 10_000:
                yield _batch([*out, packer.packet()], schema)
                out = []
        if at is not None:
            done()
            yield _batch([*out, packer.packet()], schema)

    dealt = fragments.select("row", "doc", "k", "solid", "ok", *_SIDES).repartition("row", F.floor(F.col("k") / fan))
    return dealt.sortWithinPartitions("row", "k").mapInArrow(run, _ddl(id_type))


def _digests(parts: DataFrame) -> DataFrame:
    """``row``, ``sha``: the groups of a long text stream through the digest in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, digest = None, None
        tell = lambda: pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([digest.hexdigest()])], ["row", "sha"])
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at != row:
                    if row is not None:
                        yield tell()
                    row, digest = at, hashlib.sha256()
                else:
                    digest.update(b";")
                digest.update(text.as_buffer())
        if row is not None:
            yield tell()

    dealt = parts.where(F.octet_length("text") > 0).repartition("row").sortWithinPartitions("row", "at").select("row", "text")
    return dealt.mapInArrow(run, "row long, sha string")


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _summed(packets: DataFrame, id_type: str) -> DataFrame:
    """A row per unit with its sums, from packets that have met the counts of their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                of = lambda c: batch.column(names.index(c))[i]  # noqa: B023, E731
                per_unit, slot, weight, stats = _opened(of("blob").as_py(), of("sizes").as_py())
                n, best = (of(c).values.to_numpy(zero_copy_only=False) if of(c).is_valid else np.zeros(0, np.int64) for c in ("n", "best"))
                sums = [*stats.T, _sums(weight * best[slot], per_unit), _sums(weight * n[slot], per_unit)]
                docs, rows = of("docs").values, of("rows").values
                sha = of("sha").values if of("sha").is_valid else pa.nulls(len(docs), pa.string())
                yield pa.RecordBatch.from_arrays([docs, rows, sha, *(pa.array(x, pa.int64()) for x in sums)], ["doc", "row", "sha", *COUNTS])

    wanted = packets.select("blob", "sizes", "docs", "rows", "sha", "n", "best")
    return wanted.mapInArrow(run, f"doc {id_type}, row long, sha string, " + ", ".join(f"{c} long" for c in COUNTS))


def align_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    a_vocabulary: str = A_VOCABULARY,
    b_vocabulary: str = B_VOCABULARY,
    range_size: int = RANGE,
    fan: int = FAN,
) -> DataFrame:
    """A row per row of ``docs``: ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A is a byte-level BPE given the text with a space before it, B a sentencepiece model given the text. Null and
    empty texts, and those that either side doesn't give back byte for byte, have no tokens: zeros and ''. Rows that
    repeat count as documents of their own. Of the input only the id and the text are read, so other columns
    may have any name; an empty table gives an empty table. Texts are encoded whole, however long: those of over
    ``range_size`` bytes by several tasks, of which ``fan`` ranges' open ends are composed by one at a time. A
    segment without a safe cut, such as a megabyte without white space, is encoded by one task.
    """
    paths = _paths(a_vocabulary, b_vocabulary)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > range_size, F.lit(False))
    short, _ = write_table(_short(rows.where(~is_long), id_type, paths), "packets")
    numbered = rows.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc", "text")
    cut, cut_at = write_table(_cut(numbered, id_type, range_size), "ranges")
    fragments, _ = write_table(_fragments(cut, id_type, paths), "fragments")
    drop_dir(docs.sparkSession, cut_at)
    parts, number = fragments, 0
    while True:
        longest = fragments.agg(F.max("k")).first()[0] or 0
        last, number = longest < fan, number + 1
        fragments, _ = write_table(_round(fragments.where(F.col("row").isNotNull()), id_type, fan, number, last, paths), "composed")
        parts = parts.unionByName(fragments)
        if last:
            break
    verdicts = fragments.where(F.col("row").isNotNull()).select("row", "doc", "ok")
    good = verdicts.where("ok").select("row")
    parts = parts.where(F.col("packet").isNotNull())
    packets = short.unionByName(parts)

    held = parts.select(F.explode(F.arrays_zip("held_rows", "held")).alias("p")).select(F.col("p.held_rows").alias("row"), F.col("p.held").alias("pair"))
    holders = short.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.holders").cast("long").alias("n"))
    holders = holders.unionByName(held.join(good, "row", "left_semi").distinct().select("pair", F.lit(1).cast("long").alias("n")))
    a = F.shiftright("pair", 32)
    counts = holders.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("best", (F.col("n") == F.max("n").over(Window.partitionBy(a))).cast("long"))
    asked = packets.select("packet", F.posexplode("pairs").alias("pos", "pair"))
    known = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "best")]  # pairs that no document with tokens holds
    answers = asked.join(counts, "pair", "left").groupBy("packet").agg(F.sort_array(F.collect_list(F.struct("pos", *known))).alias("found"))
    answers = answers.select("packet", F.col("found.n").alias("n"), F.col("found.best").alias("best"))
    summed, _ = write_table(_summed(packets.join(answers, "packet", "left"), id_type), "sums")

    text_parts = parts.select(F.explode(F.arrays_zip("rows", "at", "texts")).alias("p")).select("p.rows", "p.at", F.col("p.texts").alias("text")).withColumnRenamed("rows", "row")
    per_row = summed.where(F.col("row").isNotNull()).groupBy("row").agg(*[F.sum(c).alias(c) for c in COUNTS])
    long = verdicts.join(per_row, "row", "left").join(_digests(text_parts), "row", "left")
    told_of = lambda c, none: F.when(F.col("ok"), F.coalesce(c, F.lit(none))).otherwise(F.lit(none)).alias(c)
    long = long.select("doc", *[told_of(c, 0) for c in COUNTS], told_of("sha", ""))
    whole = summed.where(F.col("row").isNull()).select("doc", *COUNTS, "sha").unionByName(long)
    return whole.select(F.col("doc").alias(id_col), *[F.col(c).cast("long").alias(c) for c in COUNTS], F.col("sha").alias("groups_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
