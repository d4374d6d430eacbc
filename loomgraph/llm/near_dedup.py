"""MinHash near-dedup with a circulant signature and exact verification.

One permutation scatters a document's shingles, a second one, shifted circularly once per coordinate,
gives the whole signature. Documents that share a band are candidates; links are confirmed on the full
shingle sets, and a component keeps its smallest id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import join_hot, materialize

SHINGLE = 5
#: Rows of a band at most, and the bands up to which that many are taken.
ROWS, MOST_BANDS = 5, 128
#: The probability at most that a pair at the threshold shares no band.
MISS = 1e-6
#: Bytes of text that are hashed together.
CHUNK = 1 << 20

_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _constants(seed: int, n: int) -> np.ndarray:
    """Odd numbers that look random, from a seed."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_OF_BYTE = _constants(1, 256)
_OF_WORD = _constants(2, SHINGLE)
_OF_SHORT = _constants(3, SHINGLE)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def bands_for(percent: int, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows, so that a pair at ``percent`` hundredths shares no band with a probability of ``miss`` at most.

    At 85 there are 24 bands of 5 rows, at 80 35. Low thresholds take fewer rows, and one row as many bands as needed.
    """
    if not 0 < percent <= 100 or not 0 < miss < 1:
        raise ValueError(f"percent is 1 to 100 and miss between 0 and 1, not {percent} and {miss}")
    for rows in range(ROWS, 0, -1):
        same = (percent / 100) ** rows
        bands = 1 if same == 1 else math.ceil(math.log(miss) / math.log1p(-same))
        if bands <= MOST_BANDS or rows == 1:
            break
    return bands, rows


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of normalised bytes, and where they start: a polynomial per word."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = data != 0x20
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.empty(0, np.uint64), starts
    first = np.zeros(len(data), dtype=np.int64)
    first[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(first)
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, dtype=np.uint64))
    values = np.where(inside, _OF_BYTE[data] * powers[place], np.uint64(0))
    return _mix(np.add.reduceat(values, starts)), starts


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of words, A-Z lower-cased.

    A text of fewer words than a shingle is one shingle of all its words; without words the set is empty.
    """
    raws = [x.encode("utf-8", "surrogatepass").translate(_BYTES) if x else b"" for x in texts]
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(raws):
        hi, held = lo, 0
        while hi < len(raws) and (hi == lo or held + len(raws[hi]) < CHUNK):
            held += len(raws[hi]) + 1
            hi += 1
        words, starts = _word_hashes(b" ".join(raws[lo:hi]) + b" ")
        bounds = np.cumsum([0] + [len(x) + 1 for x in raws[lo:hi]])
        edges = np.searchsorted(starts, bounds)
        n = max(0, len(words) - shingle + 1)
        mixed = np.zeros(n, dtype=np.uint64)
        for k in range(shingle):
            mixed += words[k : k + n] * _OF_WORD[k]
        mixed = _mix(mixed)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= shingle:
                out.append(np.unique(mixed[a : b - shingle + 1]))
            elif b > a:
                whole = (words[a:b] * _OF_WORD[: b - a]).sum(dtype=np.uint64, keepdims=True) + _OF_SHORT[b - a - 1]
                out.append(_mix(whole))
            else:
                out.append(np.empty(0, np.uint64))
        lo = hi
    return out


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """C-MinHash: the smallest of the second permutation, shifted once more for each coordinate."""
    scattered = (_mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(scattered), 1024):
        x = scattered[None, a : a + 1024] + shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = len(sig) // bands
    terms = (sig.astype(np.uint64) + np.uint64(1)) * _constants(4, len(sig))
    return _mix(terms.reshape(bands, rows).sum(axis=1, dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 85, miss: float = MISS) -> DataFrame:
    """``id_col``, ``n_shingles``, ``_s1`` and ``_s2`` (128 bits that tell the set) and ``_bands`` of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_shingles long, _s1 long, _s2 long, _bands array<long>"
    count, rows = bands_for(percent, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist())
            sums = [
                [_mix(s ^ np.uint64(seed)).sum(dtype=np.uint64).view(np.int64) for s in sets]
                for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
            ]
            bands = [band_hashes(signature(s, count * rows), count) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *[pa.array(x, pa.int64()) for x in sums],
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                [id_col, "n_shingles", "_s1", "_s2", "_bands"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def full_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id`` and ``_set``, the sorted shingle hashes, of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["_id", "_set"])

    return docs.select(id_col, text_col).mapInArrow(run, f"_id {kind}, _set array<long>")


def _dealt(per_key: DataFrame, key: str) -> DataFrame:
    """An aggregate by ``key``, dealt out by a hash of it.

    A join on the key then shuffles it like the other side, and adaptive execution can split a hot key's rows; an
    aggregate that lies as the join wants it keeps them in one task.
    """
    return per_key.repartition(F.xxhash64(key))


def components(links: DataFrame) -> DataFrame:
    """Connected components of (``a``, ``b``) as (``node``, ``component``): its smallest node.

    Alternating large and small stars: each step hangs neighbours to the smallest of them, by a minimum
    and a join, until nothing moves; long chains shrink to half and less in a step. Every step's edges
    are written, so lineage stays short; only two sums per step reach the driver.
    """

    def digest(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = digest(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(_dealt(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(_dealt(least, "a"), "a")
        small = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = materialize(small.distinct(), "links")
        after = digest(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def _enough(inter, n, m, percent: int):
    return 100 * inter >= percent * (n + m - inter)


def _sizes_allow(n, m, percent: int):
    """Two sets can't be as similar as that if one is too small."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


#: Members of a group, and bytes of their sets, that are compared in one task.
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20
#: A group of more blocks than this is first rid of the members that can't have a partner in it.
FEW_BLOCKS = 4


def _links_in_block(percent: int):
    """For two blocks of a group: a spanning forest of the links between members not yet known to be connected."""

    def run(table: pa.Table) -> pa.Table:
        ids, block, known, size = (table.column(c).to_numpy() for c in ("_id", "_block", "_component", "_n"))
        far = table.column("_far").to_numpy()
        pair = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        sets = table.column("_set").combine_chunks()
        flat, bounds = sets.flatten().to_numpy(), np.diff(sets.offsets.to_numpy())
        row = np.repeat(np.arange(len(ids)), bounds)
        _, token = np.unique(flat, return_inverse=True)
        order = np.argsort(token, kind="stable")
        token, row = token[order], row[order]
        left, right = np.flatnonzero(block == pair[0]), np.flatnonzero(block == pair[1])
        inter = np.zeros((len(left), len(right)), dtype=np.float32)
        at = np.full(len(ids), -1)
        edges = np.searchsorted(token, np.arange(0, (token[-1] + 1 if len(token) else 0) + 4096, 4096))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo < hi:
                dense = np.zeros((len(ids), 4096), dtype=np.float32)
                dense[row[lo:hi], token[lo:hi] % 4096] = 1
                inter += dense[left] @ dense[right].T
        n, m = size[left][:, None], size[right][None, :]
        ok = 100 * inter.astype(np.int64) >= percent * (n + m - inter.astype(np.int64))
        ok &= known[left][:, None] != known[right][None, :]
        ok &= ~(np.abs(far[left][:, None] - far[right][None, :]) > 1 - percent / 100 + 1e-9)  # null: no distance known
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        a, b = [], []
        for i, j in zip(*np.nonzero(ok), strict=True):
            x, y = root(known[left[i]]), root(known[right[j]])
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(ids[left[i]])
                b.append(ids[right[j]])
        kind = table.schema.field("_id").type
        return pa.table([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    return run


def _with_partners(group: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members (``_head``, ``_id``) that can have a partner in their group.

    A partner outside the own component holds ``percent`` hundredths of a member's shingles at least, so
    as many of them have to occur in some other component of the group. Exact, and what a common passage
    drew together without being alike goes here, in work that grows with its shingles.
    """
    rows = materialize(
        group.join(sets, "_id").select("_head", "_id", "_n", "_component", F.explode("_set").alias("_token")), "group-shingles"
    )
    where = rows.groupBy("_head", "_token").agg(
        F.min("_component").alias("_lo"), F.max("_component").alias("_hi"), F.count(F.lit(1)).alias("_rows")
    )
    where = materialize(where.select("_head", "_token", "_rows", (F.col("_lo") != F.col("_hi")).alias("_both")), "shared-shingles")
    met = join_hot(rows.select("_head", "_token", "_id", "_n"), where, ["_head", "_token"], "_rows", rows.count())
    shared = met.groupBy("_head", "_id", "_n").agg(F.sum(F.col("_both").cast("long")).alias("_shared"))
    return shared.where(100 * F.col("_shared") >= percent * F.col("_n")).select("_head", "_id")


def _rest(stars: DataFrame, compared: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among those that share a bucket's head, but not, as far as known, its component."""
    apart = F.when(F.col("_inter").isNotNull(), 1 - F.col("_inter") / (F.col("_n") + F.col("_head_n") - F.col("_inter")))
    group = (
        stars.join(compared.select("_head", "_id", "_inter"), ["_head", "_id"], "left")
        .join(known, F.col("_id") == F.col("node"), "left")
        .select(
            "_head",
            "_id",
            "_n",
            F.coalesce(apart, F.lit(float("nan"))).alias("_far"),  # no distance: nothing follows from it
            F.coalesce("component", "_id").alias("_component"),
        )
    )
    group = materialize(group, "groups")

    def in_blocks(group: DataFrame) -> DataFrame:
        return (
            group.groupBy("_head")
            .agg(
                F.min("_component").alias("_lo"),
                F.max("_component").alias("_hi"),
                F.count(F.lit(1)).alias("_members"),
                F.sum(F.col("_n") * 8).alias("_bytes"),
            )
            .where("_lo <> _hi")
            .select(
                "_head",
                F.greatest(F.ceil(F.col("_members") / BLOCK_ROWS), F.ceil(F.col("_bytes") / BLOCK_BYTES)).cast("int").alias("_blocks"),
            )
        )

    mixed = materialize(in_blocks(group), "mixed-groups")
    wide = mixed.where(F.col("_blocks") > FEW_BLOCKS).select("_head")
    if not wide.isEmpty():
        left = _with_partners(group.join(wide, "_head"), sets, percent)
        narrow = group.join(mixed.where(F.col("_blocks") <= FEW_BLOCKS).select("_head"), "_head")
        group = materialize(narrow.unionByName(group.join(left, ["_head", "_id"], "left_semi")), "groups")
        mixed = in_blocks(group)
    dealt = group.join(mixed, "_head").withColumn("_block", F.pmod(F.xxhash64("_id"), "_blocks").cast("int"))
    meeting = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    pairs = dealt.withColumn("_other", meeting).select(
        "_head",
        F.least("_block", "_other").alias("_i"),
        F.greatest("_block", "_other").alias("_j"),
        "_block",
        "_id",
        "_n",
        "_far",
        "_component",
    )
    kind = stars.schema["_id"].dataType.simpleString()
    return (
        pairs.join(sets, "_id").groupBy("_head", "_i", "_j").applyInArrow(_links_in_block(percent), f"a {kind}, b {kind}")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 85, miss: float = MISS
) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of ``percent`` hundredths at least.

    Returns one row per input row: ``id_col``, ``n_shingles`` (size of its set of distinct shingles of five
    words, A-Z lower-cased), ``component_id`` (the smallest id it is linked to, directly or not) and
    ``kept`` (it is that document itself).

    The bands follow from ``percent`` and ``miss``, the probability that a pair at the threshold isn't found.

    Null and empty texts, and texts without words, have an empty set and are linked with nothing. Texts of
    fewer than five words are one shingle. Rows with a null id are linked with nothing (null) and kept.
    Ids stand for texts: a row that repeats both gets the same result, kept or not. An empty table gives an
    empty table. Texts count whole, however long; sets are compared by 64-bit hashes of the shingles.

    Documents with equal sets are one node from the start, whatever their number. Per band and bucket
    every node is first compared with the smallest one, which finds most components; what of a bucket is
    still apart is then, in large groups after those that share too few shingles with any other, compared
    in blocks, all with all, in tasks of bounded size that give back a spanning forest, so no link between different texts that share a band is lost, and no list of pairs
    of a group is ever written. The text is shuffled once, for the documents with candidates.
    """
    plain = docs.select(id_col, text_col)
    sig = materialize(signatures(plain, id_col, text_col, percent=percent, miss=miss), "signatures")
    some = sig.where((F.col("n_shingles") > 0) & F.col(id_col).isNotNull())
    same = ["_s1", "_s2", "n_shingles"]
    classes = materialize(some.groupBy(*same).agg(F.min(id_col).alias("_rep"), F.count(F.lit(1)).alias("_rows")), "classes")
    # one row of each class, found by its id, so that the rows of a hot class never meet
    nodes = materialize(
        some.join(classes.drop("_rows").withColumn(id_col, F.col("_rep")), [id_col, *same], "left_semi")
        .select(F.col(id_col).alias("_id"), F.col("n_shingles").alias("_n"), "_bands")
        .dropDuplicates(["_id", "_n"]),
        "nodes",
    )
    # a band's hash tells its band too, so a bucket is one number
    buckets = nodes.select("_id", F.explode("_bands").alias("_bucket"))
    heads = (
        buckets.groupBy("_bucket")
        .agg(F.min("_id").alias("_head"), F.max("_id").alias("_last"))
        .where("_head <> _last")
        .drop("_last")
    )
    met = buckets.join(_dealt(heads, "_bucket"), "_bucket").where("_id <> _head").select("_head", "_id").distinct()
    size = nodes.select("_id", "_n")
    stars = materialize(
        met.join(size, "_id").join(size.select(F.col("_id").alias("_head"), F.col("_n").alias("_head_n")), "_head"), "stars"
    )
    needed = stars.select("_id").union(stars.select(F.col("_head").alias("_id"))).distinct()
    # the ids grow with the corpus, so this is a shuffle join whatever their number; repeated rows go here
    wanted = plain.join(needed.hint("merge"), plain[id_col] == needed["_id"], "left_semi").dropDuplicates([id_col, text_col])
    sets = materialize(full_sets(wanted, id_col, text_col), "sets")
    inter = F.size(F.array_intersect("_set", "_head_set"))
    compared = materialize(
        stars.where(_sizes_allow(F.col("_n"), F.col("_head_n"), percent))
        .join(sets, "_id")
        .join(sets.select(F.col("_id").alias("_head"), F.col("_set").alias("_head_set")), "_head")
        .select("_head", "_id", "_n", "_head_n", inter.alias("_inter")),
        "compared",
    )
    first_links = compared.where(_enough(F.col("_inter"), F.col("_n"), F.col("_head_n"), percent)).select(
        F.col("_head").alias("a"), F.col("_id").alias("b")
    )
    known = materialize(components(first_links), "components")
    links = first_links.unionByName(_rest(stars, compared, known, sets, percent))
    final = components(links)
    whole = classes.join(final, F.col("_rep") == F.col("node"), "left").select(
        *same, "_rows", F.coalesce("component", "_rep").alias("component_id")
    )
    linked = join_hot(some.select(id_col, *same), materialize(whole, "class-components"), same, "_rows", some.count())
    linked = linked.select(id_col, "n_shingles", "component_id", (F.col("component_id") == F.col(id_col)).alias("kept"))
    alone = sig.where((F.col("n_shingles") == 0) | F.col(id_col).isNull()).select(
        id_col, "n_shingles", F.col(id_col).alias("component_id"), F.lit(True).alias("kept")
    )
    return linked.unionByName(alone)


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x20\\x09-\\x0D]+')"
)
OP5_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_SQL_WORDS} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, node) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.node = e.a
), c AS (
  SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
