"""From raw documents to packed training sequences: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of ``documents``, with ``text`` and ``n_chars`` as the stage leaves them.

Every stage works on rows of ``docs`` whatever else they hold: further columns stay (also ones that have
the name of a column that an operator adds: the input's value stays), whole texts count however long, and
an empty table gives an empty table. What each does with null and empty texts, ties and repeated rows
stands with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD, scratch_dir
from loomgraph.llm.decontaminate import contaminated, find_benchmark
from loomgraph.llm.line_dedup import dedup_lines
from loomgraph.llm.near_dedup import near_duplicates
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.quality_rules import apply_quality_rules


def _bare(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and, out of the way of an operator's own columns, the others in ``_doc``."""
    rest = [f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest).alias("_doc") if rest else F.lit(0).alias("_doc"))


def _whole(found: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of ``documents`` again, some of them new."""
    plain = {"doc_id": F.col("doc_id"), "text": F.col("text")} | new
    return found.select(*[plain.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in columns])


def _with_text(found: DataFrame, columns: list[str], text: str) -> DataFrame:
    return _whole(found, columns, text=F.col(text), n_chars=F.char_length(text).cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; rejected documents go.

    Null and empty texts have too few words and go. Each row is judged alone, so repeated rows share their
    fate.
    """
    return _with_text(apply_quality_rules(_bare(docs)).where("kept"), docs.columns, "clean_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated across documents stay in the first of them only; a document that loses all its words goes.

    Null and empty texts lose no line and stay, null as ''. Of documents with the same line the smallest
    id keeps it; rows that repeat an id are one document.
    """
    some_left = (F.col("n_dropped") == 0) | F.col("kept_text").rlike(WORD)
    return _with_text(dedup_lines(_bare(docs)).where(some_left), docs.columns, "kept_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, as it is.

    Null and empty texts, and rows without an id, are copies of nothing and stay. Rows that repeat an id
    stay or go together.
    """
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; those with fewer hits stay as they are.

    Null and empty texts have no hits and stay. Each row is searched alone.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _whole(find_benchmark(_bare(docs), items).where(~contaminated()), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and place in it.

    Null and empty texts are the end token alone. Repeated rows are pieces of their own.
    """
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Signatures and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch_dir(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
