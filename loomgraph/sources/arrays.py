"""JSON array files of any size, read by many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file that a task reads, and those that it holds at once beside the object it is in.
RANGE_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20

_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_MARKED = _STEP != 0
_MARKED[_QUOTE] = True


def file_size(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """The file's full path and its size; None if there is no such file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    given = jvm.org.apache.hadoop.fs.Path(path)
    system = given.getFileSystem(conf)
    if not system.exists(given) or not system.getFileStatus(given).isFile():
        return None
    return system.makeQualified(given).toString(), system.getFileStatus(given).getLen()


def _opened(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[len("file:") :].lstrip("/"))
    system, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(name)


def _slashes_before(file: pa.NativeFile, at: int) -> int:
    """1 if an odd number of backslashes ends right before this place, so that it is escaped."""
    n = 0
    while at > n:
        size = min(1024, at - n)
        file.seek(at - n - size)
        part = file.read(size)
        run = len(part) - len(part.rstrip(b"\\"))
        n += run
        if run < size:
            break
    return n % 2


def _brackets(file: pa.NativeFile, start: int, end: int | None = None) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Chunk by chunk: its place, its bytes, the places of brackets in it, the quotes before each since ``start``,
    its step in depth, and the quotes up to the chunk's end. Escaped quotes don't count."""
    escaped, quotes = _slashes_before(file, start), 0
    file.seek(start)
    while data := file.read(CHUNK_BYTES if end is None else min(CHUNK_BYTES, end - start)):
        b = np.frombuffer(b"\\" * escaped + data, np.uint8)
        at = np.flatnonzero(_MARKED[b])
        quote = b[at] == _QUOTE
        shift, slash = escaped, b == _BACKSLASH
        escaped = 0
        if slash.any():
            # the last byte up to each place that is no backslash, -1 where all are
            other = np.maximum.accumulate(np.where(slash, -1, np.arange(len(b))))
            before = np.where(at > 0, at - 1 - other[at - 1], 0)
            real = ~(quote & (before % 2 == 1))
            at, quote = at[real], quote[real]
            escaped = int(len(b) - 1 - other[-1]) % 2
        seen = quotes + np.cumsum(quote)
        quotes = int(seen[-1]) if len(seen) else quotes
        yield start, data, at[~quote] - shift, seen[~quote], _STEP[b[at[~quote]]].astype(np.int64), quotes
        start += len(data)


def _summary(path: str, start: int, end: int) -> tuple[int, int, int]:
    """What a range does to the state, whatever that is at its start: whether it holds an odd number of quotes, and
    its step in depth if it starts outside a string and if it starts inside one."""
    odd, outside, inside = 0, 0, 0
    with _opened(path) as file:
        for _, _, _, seen, step, quotes in _brackets(file, start, end):
            outside += int(step[seen % 2 == 0].sum())
            inside += int(step[seen % 2 == 1].sum())
            odd = quotes % 2
    return odd, outside, inside


def _objects(path: str, start: int, end: int, inside: int, depth: int, base: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the objects at depth ``base`` that begin in the range, read to their ends beyond it."""
    began, parts = None, []
    with _opened(path) as file:
        for at, data, places, seen, step, _ in _brackets(file, start):
            out = (seen + inside) % 2 == 0
            places, step = places[out], step[out]
            after = depth + np.cumsum(step)
            depth = int(after[-1]) if len(after) else depth
            edge = np.where(step > 0, after - 1, after) == base
            from_here = 0
            for k in places[edge].tolist():
                if began is None and data[k] == ord("{"):
                    if at + k >= end:
                        return
                    began, from_here = at + k, k
                elif began is not None and data[k] == ord("}"):
                    yield began, b"".join([*parts, data[from_here : k + 1]])
                    began, parts = None, []
            if began is None and at + len(data) >= end:
                return
            if began is not None:
                parts.append(data[from_here:])
    if began is not None:  # the file ends inside it
        yield began, b"".join(parts)


def read_array(spark: SparkSession, path: str, schema: T.StructType | str, *, range_bytes: int = RANGE_BYTES, ordinal: str | None = None) -> DataFrame:
    """The objects of a UTF-8 file that holds one JSON array (or one object), a row each, read by a task per range of bytes.

    Whether a range begins inside a string, and how deep, follows from what the ranges before it do, so a
    first pass sums each of them up (three numbers a range reach the driver) and a second one reads the
    objects that begin in it. Braces and quotes in strings, escapes, and objects longer than a range are no
    matter. A task holds a chunk and one object.

    An empty file or array gives no rows; array elements that are no objects are passed over; missing fields
    are null; an object that can't be parsed, or that the file's end cuts off, is a row of nulls.
    ``ordinal`` names a column for the objects' places: file, byte, zero.
    """
    found = file_size(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    full, size = found
    n = max(1, -(-size // range_bytes))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                base = -1
                if i == 0:
                    with _opened(full) as file:
                        head = b" "
                        while head and not head.strip(b"\xef\xbb\xbf \t\r\n"):
                            head = file.read(1024)
                        base = int(head.strip(b"\xef\xbb\xbf \t\r\n")[:1] == b"[")
                row = (i, *_summary(full, i * range_bytes, min(size, (i + 1) * range_bytes)), base)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], ["i", "odd", "out", "in", "base"])

    ranges = spark.range(0, n if size else 0, 1, n)
    rows = sorted(ranges.mapInArrow(summed, "i long, odd long, out long, in long, base long").collect())
    base = rows[0]["base"] if rows else 0
    states, inside, depth = [], 0, 0
    for r in rows:
        states.append((inside, depth))
        depth += r["in"] if inside else r["out"]
        inside ^= r["odd"]
    shared = spark.sparkContext.broadcast(states)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                places, texts, held = [], [], 0
                packed = lambda: pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(texts, pa.binary())], ["place", "object"])  # noqa: B023, E731
                for place, text in _objects(full, i * range_bytes, min(size, (i + 1) * range_bytes), *shared.value[i], base):
                    places.append(place)
                    texts.append(text)
                    held += len(text)
                    if held >= CHUNK_BYTES:
                        yield packed()
                        places, texts, held = [], [], 0
                yield packed()

    objects = ranges.mapInArrow(read, "place long, object binary")
    at = F.struct(F.lit(full).alias("file"), F.col("place").alias("block"), F.lit(0).cast("long").alias("row"))
    parsed = objects.select(F.from_json(F.col("object").cast("string"), schema).alias("_o"), at.alias("_p"))
    return parsed.select("_o.*", F.col("_p").alias(ordinal)) if ordinal else parsed.select("_o.*")
