"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import TRIM_CHARS, ascii_lower, join_hot, materialize, put_back, set_aside, two_hashes


def lines_of(text: Column) -> Column:
    """The text split at newlines; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(TRIM_CHARS)))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    min_chars: int = 10,
    min_docs: int = 2,
) -> DataFrame:
    """Drop repeated lines everywhere but in the first document that holds them.

    A line's key (see ``line_key``) of at least ``min_chars`` code points that is found in at least
    ``min_docs`` distinct documents loses all its lines, except in the smallest ``id_col`` holding it.

    Returns the columns of ``docs`` plus ``kept_text``, ``n_lines`` (before) and ``n_dropped``; columns
    of these names in the input are replaced, others may have any name.

    Null text: one empty line, nothing dropped, ``kept_text`` ''. Null ids together are one document,
    sorted after all others. Rows that repeat an id are one document: a key repeated only among them
    is not dropped, and each row is rebuilt from its own text. A document that loses all lines gets ''.
    An empty table gives an empty table.

    Plan: lines are exploded once as (hash, id, position), 40 bytes each, never with their text, and
    written. Per hash only count-like aggregates are kept, so a line found in every document is combined
    on the map side; on the way back hot lines meet their key by broadcast (see ``join_hot``). The text
    itself is shuffled once, to meet the positions, which are a written table, too.
    """
    src = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(F.col(text_col)).alias("_row"),
        F.posexplode(lines_of(F.col(text_col))).alias("_pos", "_line"),
    )
    key = line_key(F.col("_line"))
    h1, h2 = two_hashes(F.col("_key"))
    lines = materialize(
        src.select("_id", "_row", "_pos", key.alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_row", "_pos", h1.alias("_h1"), h2.alias("_h2")),
        "lines",
    )
    of_key = [F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")]
    if min_docs == 2:  # two documents: smallest and largest id differ; no distinct count to shuffle
        per_key = lines.groupBy("_h1", "_h2").agg(
            *of_key, F.max("_id").alias("_last"), F.max(F.col("_id").isNull()).alias("_null")
        )
        repeated = per_key.where((F.col("_first") != F.col("_last")) | (F.col("_null") & F.col("_first").isNotNull()))
    else:
        per_doc = lines.groupBy("_h1", "_h2", "_id").agg(F.count(F.lit(1)).alias("_lines"))
        repeated = (
            per_doc.groupBy("_h1", "_h2")
            .agg(F.min("_id").alias("_first"), F.sum("_lines").alias("_n"), F.count(F.lit(1)).alias("_docs"))
            .where(F.col("_docs") >= min_docs)
        )
    repeated = materialize(repeated.select("_h1", "_h2", "_first", "_n"), "repeated-lines")
    dropped = materialize(
        join_hot(lines, repeated, ["_h1", "_h2"], "_n", lines.count())
        .where(~F.col("_id").eqNullSafe(F.col("_first")))
        .groupBy("_id", "_row")
        .agg(F.collect_set("_pos").alias("_dropped")),
        "dropped-lines",
    )
    columns = docs.drop("kept_text", "n_lines", "n_dropped").columns
    keyed = set_aside(docs.select(*[F.col(f"`{c}`") for c in columns]), id_col, text_col).withColumn("_row_of_text", F.xxhash64(F.col(text_col)))
    both = keyed.join(
        dropped,
        keyed[id_col].eqNullSafe(dropped["_id"]) & (keyed["_row_of_text"] == dropped["_row"]),
        "left",
    ).withColumn("_lines", lines_of(F.col(text_col)))
    n = F.size("_lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_dropped"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")
    # in two steps: beside columns of any name, a lambda's names could be taken for theirs
    made = both.select(
        *keyed.drop("_row_of_text").columns,
        F.when(F.col("_dropped").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept).alias("kept_text"),
        n.cast("long").alias("n_lines"),
        F.when(F.col("_dropped").isNull(), 0).otherwise(F.size("_dropped")).cast("long").alias("n_dropped"),
    )
    return made.select(*put_back(columns, id_col, text_col), "kept_text", "n_lines", "n_dropped")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), rep AS (
  SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.*, rep.key IS NOT NULL AND k.doc_id <> rep.first_id AS gone FROM k LEFT JOIN rep ON k.key = rep.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
