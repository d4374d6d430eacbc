"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most one sequence; the counts of the piece lengths, at most
``size`` numbers whatever the corpus, are packed on the driver: hash tables from sums to one, two and three
lengths give what fills a gap exactly, which is used up first; best fit takes the rest. Pieces then find their place by their
rank within their length.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize

SEQUENCE = 1024
END_ID = 2
#: Rows that are ranked together; a length with more pieces is dealt into several groups.
RANK_GROUP = 1024
#: Distinct words whose ids a worker remembers; then it starts afresh.
MEMO = 400_000


class _Memo(dict):
    """Word -> its ids as little-endian unsigned 32-bit, encoded once when first met."""

    def __init__(self, encode, lead: str):
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = np.array(self.encode(self.lead + word), dtype="<u4").tobytes()
        return out


class TextEncoder:
    """Byte-level BPE ids of texts, word by word.

    Between two characters that aren't white space, a single space always starts a new pre-token and a
    single newline is one of its own, so words can be encoded apart and remembered. Texts with other
    white space or runs of it are encoded whole. The ids are those of the ``.json`` tokenizer file, whose
    vocabulary the rank file holds; a text is split at the file's added tokens, ``added``, which have their own ids.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int]):
        import re

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.mid, self.head = _Memo(self.whole, " "), _Memo(self.whole, "")
        self.newline = np.array(self.whole("\n"), dtype="<u4").tobytes()
        self.odd = re.compile(r"[^\S \n]").search
        self.added = {k: np.array([v], dtype="<u4").tobytes() for k, v in added.items()}
        longest = "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True))
        self.split = re.compile(f"({longest})").split if added else lambda text: [text]

    def ids(self, text: str) -> bytes:
        parts = self.split(text)
        if len(parts) == 1:
            return self.ordinary(text)
        return b"".join(self.added[x] if k % 2 else self.ordinary(x) for k, x in enumerate(parts))

    def ordinary(self, text: str) -> bytes:
        if (
            not text
            or "  " in text
            or "\n\n" in text
            or " \n" in text
            or "\n " in text
            or text[0] in " \n"
            or text[-1] in " \n"
            or self.odd(text)
        ):
            return np.array(self.whole(text), dtype="<u4").tobytes()
        parts, mid, head = [], self.mid.__getitem__, self.head.__getitem__
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            parts.append(head(first))
            parts.extend(map(mid, rest))
            parts.append(self.newline)
        parts.pop()
        return b"".join(parts)


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file, which are found in the text itself, and their ids."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if odd := [x["content"] for x in tokens if x["single_word"] or x["lstrip"] or x["rstrip"]]:
        raise ValueError(f"added tokens that look at their surroundings: {odd}")
    return {x["content"]: x["id"] for x in tokens}


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    size: int = SEQUENCE,
    end_id: int = END_ID,
    vocabulary: str = "byte_bpe_50k",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``.

    A document is its ids and ``end_id``. One of over ``size`` ids is cut into pieces of ``size``, of which
    the first may be shorter. Null and empty texts are ``end_id`` alone; repeated rows are told in full each;
    an empty table gives an empty table. Texts are encoded whole, however long. Of the input only the id
    and the text are read, so other columns may have any name.
    """
    import public_tokenizers

    path, pattern = public_tokenizers.path(f"{vocabulary}.tiktoken"), public_tokenizers.PATTERN
    added = added_tokens(public_tokenizers.path(f"{vocabulary}.json"))
    end = np.array([end_id], dtype="<u4").tobytes()
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(path, pattern, added)
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = encoder.ids(text or "") + end
                n = len(raw) // 4
                lo, k = 0, 0
                while lo < n:
                    hi = lo + ((n - lo) % size or size)
                    part = raw[4 * lo : 4 * hi]
                    at.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                    lo, k = hi, k + 1
            columns = [
                batch.column(0).take(pa.array(at, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ] + [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class SumIndex:
    """Hash tables from a sum to the single, pair and triple lengths that have it, with the counts left.

    Counts only fall, so a pair that has run out is taken off its list for good, and a lookup reads what
    is still there. Within a list the larger lengths come first: they are harder to place.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.left = size, [0] * (size + 1)
        for length, n in counts.items():
            self.left[length] = n
        lengths = sorted((x for x in counts if x < size and counts[x]), reverse=True)
        self.single = {x: x for x in lengths}
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        for small in lengths:  # the last of a list is looked at first: the one with the largest length
            for big in reversed(lengths):
                if big >= small and big + small < size:
                    self.pairs.setdefault(big + small, []).append((big, small))
        for found in self.pairs.values():
            found.sort()
        self.triples: dict[int, list[tuple[int, int]]] = {}  # (one length, the sum of the other two)
        for one in reversed(lengths):
            for rest in self.pairs:
                if one + rest < size:
                    self.triples.setdefault(one + rest, []).append((one, rest))

    def has(self, lengths: list[int]) -> int:
        """How often these lengths can be taken together."""
        return min(self.left[x] // lengths.count(x) for x in set(lengths))

    def take(self, lengths: list[int], times: int) -> None:
        for x in lengths:
            self.left[x] -= times

    def exact(self, longest: int) -> list[int] | None:
        """``longest`` and a single, a pair or a triple that fill a sequence exactly."""
        gap = self.size - longest
        if gap in self.single and self.has([longest, gap]):
            return [longest, gap]
        if pair := self._pair(gap, [longest]):
            return [longest, *pair]
        for one, rest in reversed(self.triples.get(gap, ())):
            if self.has([longest, one]) and (pair := self._pair(rest, [longest, one])):
                return [longest, one, *pair]
        return None

    def _pair(self, total: int, beside: list[int]) -> tuple[int, int] | None:
        found = self.pairs.get(total, [])
        while found and not self.has(list(found[-1])):
            found.pop()
        return next((p for p in reversed(found) if self.has([*beside, *p])), None)

    def best_fit(self, longest: int) -> list[int]:
        """``longest`` and, again and again, the longest length that still fits."""
        out, gap = [longest], self.size - longest
        while gap:
            x = next((x for x in range(gap, 0, -1) if self.left[x] > out.count(x)), 0)
            if not x:
                break
            out.append(x)
            gap -= x
        return out


def _plan(counts: dict[int, int], size: int, exact_up_to: int) -> list[tuple[int, list[int]]]:
    index, plan = SumIndex(counts, size), []
    for longest in range(size, 0, -1):
        while index.left[longest]:
            fills = longest == size or longest > exact_up_to
            lengths = (None if fills else index.exact(longest)) or index.best_fit(longest)
            n = index.has(lengths)
            index.take(lengths, n)
            plan.append((n, lengths))
    return plan


def plan_packing(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """(how many sequences, lengths in each) for a histogram of piece lengths.

    From the longest length down, a sequence is filled exactly where the sum index has a way to, else by
    best fit; every use takes as many as are available, so a step uses up some length and the plan is
    short whatever the counts. An exact pair or triple may take the short lengths that longer ones need:
    of three plans, whose exact fills begin at the longest length, at three quarters and at half of it
    (above, best fit takes the exact single if there is one), the one with the fewest sequences is taken.
    """
    plans = [_plan(counts, size, cut) for cut in (size, size * 3 // 4, size // 2)]
    return min(plans, key=lambda plan: sum(n for n, _ in plan))


def pack(pieces: DataFrame, id_col: str = "doc_id", *, size: int = SEQUENCE) -> DataFrame:
    """Give each piece its ``sequence_id`` and ``offset``; the other columns stay.

    ``pieces`` needs ``piece`` and ``length`` beside the id. Pieces of one length are interchangeable:
    they are numbered by (id, piece) within groups of about ``RANK_GROUP`` rows, dealt by hash, so that
    a length that a third of all pieces has is no single task, and the groups' sizes are summed up
    before. An empty table gives an empty table. Null ids are packed like others; repeated rows are
    pieces of their own.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces.drop("sequence_id", "offset"), "pieces")
    n = pieces.count()
    groups = n // RANK_GROUP + 1
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(id_col, "piece"), F.lit(groups)))
    sizes = materialize(dealt.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("_n")).collect()}  # at most ``size`` rows
    slots, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for times, lengths in plan_packing(histogram, size):
        offset = 0
        for length in lengths:
            slots.append((length, taken[length], taken[length] + times, sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    places = spark.createDataFrame(slots, "length long, _from long, _to long, _sequence long, offset long")
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_group").orderBy(id_col, "piece", "ids_crc32"))
    ranked = (
        dealt.withColumn("_rank", rank)
        .join(starts, ["length", "_group"])
        .withColumn("_rank", F.col("_before") + F.col("_rank") - 1)
    )
    # the places are a few for each of at most ``size`` lengths, so their broadcast is bounded
    met = (ranked["length"] == places["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(places), met).select(
        *[ranked[c] for c in pieces.columns],
        (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"),
        "offset",
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Tokenize, cut and pack: one row per piece with its place (see ``token_pieces`` and ``pack``)."""
    return pack(token_pieces(docs, id_col, text_col, **options), id_col, size=options.get("size", SEQUENCE))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
