"""Shared column expressions and table plumbing of the text operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
TRIM_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once: the optimizer never copies a lambda variable's input."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sum(numbers: Column, chunk: int = 256) -> Column:
    """Array of the sums of the first, the first two, ... numbers (ints).

    Appending copies an array, so sums are made within chunks and of the chunks, not in one run.
    """

    def summed(part: Column) -> Column:
        none = F.expr("cast(array() as array<int>)")
        last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
        return F.aggregate(part, none, lambda a, x: F.array_append(a, last(a) + x))

    def joined(parts: Column) -> Column:
        totals = summed(F.transform(parts, lambda p: F.try_element_at(p, F.lit(-1))))
        shifted = lambda before: F.transform(parts, lambda p, k: F.transform(p, lambda x: x + F.coalesce(F.get(before, k - 1), F.lit(0))))
        return F.flatten(let(totals, shifted))

    n = F.size(numbers)
    starts = F.when(n == 0, F.expr("cast(array() as array<int>)")).otherwise(F.sequence(F.lit(1), n, F.lit(chunk)))
    return let(F.transform(starts, lambda k: summed(F.slice(numbers, k, chunk))), joined)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. All-ASCII strings (as many bytes as code points) take the fast built-in."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words_of(text: Column) -> Column:
    """Array of the words (maximal runs without white space); null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def set_aside(df: DataFrame, *kept: str) -> DataFrame:
    """``kept`` and, in one struct ``_rest``, all other columns, so that none has a name that an operator uses."""
    rest = [f"`{c}`" for c in df.columns if c not in kept]
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(kept)], *[F.struct(*rest).alias("_rest")] * bool(rest))


def put_back(columns: list[str], *kept: str) -> list[Column]:
    """The columns that ``set_aside`` was given, under their names."""
    return [F.col(f"`{c}`" if c in kept else f"_rest.`{c}`").alias(c) for c in columns]


def two_hashes(col: Column) -> list[Column]:
    """128 bits as two longs from differently seeded hashes; 64 would collide at 10^12 keys."""
    return [F.xxhash64(col), F.xxhash64(F.lit(1), col)]


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``; only where that is unset, as in
    tests, a temporary folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isEmpty() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = given.get() if given.isDefined() else tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/loomgraph-{uuid.uuid4().hex}"
    atexit.register(drop_dir, spark, path)
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder; silent when the session has ended."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read back, and the folder's path."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage by ``write_table``; unlike a local checkpoint the copy outlives the executors that wrote it."""
    return write_table(df, name)[0]


#: Keys at most that are met by broadcast because they are hot: each holds over 1 / HOT_KEYS of all rows.
HOT_KEYS = 4096


def join_hot(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has a row per key and, as ``count``, how many rows have it.

    A key of over 1 / HOT_KEYS of ``total``, the number of rows, would be one large task of a shuffle join. There
    are fewer than HOT_KEYS such keys whatever the data, so they are broadcast and their rows stay where
    they are; the others are shuffled. ``per_key`` should be a written table, it is read three times.
    """
    is_hot = F.col(count) * HOT_KEYS > F.lit(total)
    hot, cold = F.broadcast(per_key.where(is_hot)), per_key.where(~is_hot)
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys))
