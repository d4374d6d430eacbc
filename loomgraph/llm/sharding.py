"""Sharding by extendible hashing.

A directory of hash-prefix bits; only buckets over the byte limit are split on another bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize, put_back, set_aside

LEVEL_BITS = 60
SHARD_BYTES = 16 * 1024 * 1024
#: The limit of the registered query: small, so that tables of any size split.
QUERY_BYTES = 1024 * 1024


def hash_bits(text: Column) -> Column:
    """The first 60 bits of the MD5 as a non-negative long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _chunk(level: Column, offset: int, step: int) -> Column:
    return F.shiftright(level, LEVEL_BITS - offset - step).bitwiseAND(F.lit((1 << step) - 1))


def _bits(value: Column, width: Column) -> Column:
    return F.when(width == 0, F.lit("")).otherwise(F.lpad(F.bin(value), width, F.lit("0")))


def assign_shards(
    docs: DataFrame,
    key_col: str = "doc_id",
    text_col: str = "text",
    *,
    max_bytes: int = SHARD_BYTES,
    step: int = 8,
) -> DataFrame:
    """Give every row its shard: the shortest hash prefix whose bucket holds at most ``max_bytes``.

    Returns one row per input row: ``key_col``, ``shard`` (the prefix as a string of 0 and 1; '' when one
    shard holds all), ``depth`` (its bits), ``n_bytes`` (UTF-8 bytes of the text), ``shard_bytes`` and
    ``shard_rows``.

    The hash is that of the key; rows that agree in all 60 bits (one hot key) go on splitting on the hash
    of their text, and whole repeated rows on a third level, a number given to each row, so that no key
    and no group of copies is too large to split. A bucket of one row is final even where that row alone
    is over the limit, however long its text. Null keys hash as one key of their own, null texts have 0
    bytes. Of the input only the key and the text are read, so other columns may have any name. An empty
    table gives an empty table.

    Plan: one narrow table (key, three hashes, bytes) is written; per pass the bytes are summed in
    cells of ``step`` more bits with map-side combine, the directory is found on the cells, and rows
    meet their cell in one equi-join. The directory stays a distributed table. The first pass is made
    wide enough for the whole table, so that later ones only see hot keys.
    """
    return _assign(docs, key_col, text_col, max_bytes, step).drop("_row")


def _assign(docs: DataFrame, key_col: str, text_col: str, max_bytes: int, step: int, row: Column | None = None) -> DataFrame:
    """``assign_shards`` with ``_row``, a column that comes back beside its row's shard."""
    key = F.coalesce(F.concat(F.lit("k"), F.col(key_col).cast("string")), F.lit("null"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(key_col).alias("_key"),
            *([] if row is None else [row.alias("_row")]),
            hash_bits(F.coalesce(F.col(key_col).cast("string"), F.lit("null"))).alias("_h0"),
            hash_bits(F.concat(key, F.md5(text.cast("binary")))).alias("_h1"),
            hash_bits(F.monotonically_increasing_id().cast("string")).alias("_h2"),
            F.octet_length(text).cast("long").alias("_bytes"),
            F.lit("").alias("_base"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    width = min(24, max(step, math.ceil(math.log2(max(1, total / max_bytes))) + 3))
    out, level, offset = None, 0, 0
    while True:
        width = min(width, LEVEL_BITS - offset)
        last = level == 2 and offset + width == LEVEL_BITS
        cells, placed, active = _split(rows, level, offset, width, max_bytes, last)
        out = placed if out is None else out.unionByName(placed)
        if last or cells.where(F.col("_shard").isNull()).isEmpty():
            break
        rows = materialize(active, "shard-hot-rows")
        offset, width = offset + width, step
        if offset == LEVEL_BITS:
            level, offset = level + 1, 0
    return out.withColumnRenamed("_key", key_col)


def _split(rows: DataFrame, level: int, offset: int, width: int, max_bytes: int, last: bool):
    """One pass over the bits offset..offset+width: the cells, the rows that found their shard, the others."""
    chunked = rows.withColumn("_cell", _chunk(F.col(f"_h{level}"), offset, width))
    cells = materialize(
        chunked.groupBy("_base", "_cell").agg(F.sum("_bytes").alias("_sum"), F.count(F.lit(1)).alias("_n")), "cells"
    )
    depths = cells.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(width)))).withColumn(
        "_pre", F.call_function("shiftright", F.col("_cell"), (F.lit(width) - F.col("_d")).cast("int"))
    )
    buckets = (
        depths.groupBy("_base", "_d", "_pre")
        .agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
        .where((F.col("_sum") <= max_bytes) | (F.col("_n") == 1) | (F.lit(last) & (F.col("_d") == width)))
    )
    found = (
        depths.select("_base", "_cell", "_d", "_pre")
        .join(buckets, ["_base", "_d", "_pre"])
        .groupBy("_base", "_cell")
        .agg(F.min_by(F.struct("_d", "_pre", "_sum", "_n"), "_d").alias("_b"))
    )
    cells = materialize(
        cells.select("_base", "_cell")
        .join(found, ["_base", "_cell"], "left")
        .select(
            "_base",
            "_cell",
            F.concat("_base", _bits(F.col("_b._pre"), F.col("_b._d"))).alias("_shard"),
            F.col("_b._sum").alias("shard_bytes"),
            F.col("_b._n").alias("shard_rows"),
        ),
        "directory",
    )
    met = chunked.join(cells, ["_base", "_cell"])
    ids = [c for c in ("_key", "_row") if c in rows.columns]
    placed = met.where(F.col("_shard").isNotNull()).select(
        *ids,
        F.col("_shard").alias("shard"),
        F.length("_shard").alias("depth"),
        F.col("_bytes").alias("n_bytes"),
        "shard_bytes",
        "shard_rows",
    )
    active = met.where(F.col("_shard").isNull()).select(
        *ids, "_h0", "_h1", "_h2", "_bytes", F.concat("_base", _bits(F.col("_cell"), F.lit(width))).alias("_base")
    )
    return cells, placed, active


def write_shards(
    docs: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text", *, max_bytes: int = SHARD_BYTES, step: int = 8
) -> str:
    """Write ``docs`` below ``path`` as one Parquet folder per shard, every row once; returns the name of the
    folders' column: ``shard``, or ``shard_2`` and so on where ``docs`` has a column of that name.

    All columns of ``docs`` come back, whatever their names. Keys may repeat or be null: a row is found
    again by a number that is written once with it. Null and empty texts have 0 bytes; a row whose text is
    over the limit is a shard of its own. Where one shard holds all, its name, '', reads back as null.
    Names are bits, so read them with a schema that says string. An empty table writes no folder.
    """
    names, column, n = {c.lower() for c in docs.columns}, "shard", 2
    while column in names:
        column, n = f"shard_{n}", n + 1
    numbered = materialize(set_aside(docs).withColumn("_row", F.monotonically_increasing_id()), "shard-input")
    field = lambda c: F.col(f"_rest.`{c}`")
    keyed = numbered.select("_row", field(key_col).alias("_key"), field(text_col).alias("_text"))
    shards = _assign(keyed, "_key", "_text", max_bytes, step, F.col("_row")).select("_row", F.col("shard").alias("_shard"))
    placed = numbered.join(shards, "_row").repartition("_shard")
    placed.select(*put_back(docs.columns), F.col("_shard").alias(column)).write.partitionBy(column).parquet(path)
    return column


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(docs, max_bytes=QUERY_BYTES)


OP8_SQL = f"""
WITH r AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents
), p AS (
  SELECT doc_id, n_bytes, d, h >> (60 - d) AS pre FROM r, (SELECT unnest(range(0, 25)) AS d)
), s AS (
  SELECT d, pre, sum(n_bytes) AS b, count(*) AS n FROM p GROUP BY d, pre
), m AS (
  SELECT p.doc_id, p.n_bytes, min(p.d) AS depth, arg_min(p.pre, p.d) AS pre, arg_min(s.b, p.d) AS b, arg_min(s.n, p.d) AS n
  FROM p JOIN s USING (d, pre) WHERE s.b <= {QUERY_BYTES} OR s.n = 1 GROUP BY p.doc_id, p.n_bytes
)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(pre), CAST(depth AS INTEGER), '0') END AS shard,
       CAST(depth AS INTEGER) AS depth, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(b AS BIGINT) AS shard_bytes, n AS shard_rows
FROM m
"""
