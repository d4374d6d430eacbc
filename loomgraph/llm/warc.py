"""WARC archives compressed with a shared Zstandard dictionary.

An archive is a ``.warc.zst`` file: first a skippable frame with the dictionary, then each record in a frame of
its own, so that any record can be read alone. Of records with equal payloads one is written whole (``response``),
the others are ``revisit`` records that name it and carry the HTTP headers only.

Spark's own file writer makes the files, one per task, and commits them: each row is a frame, and the line
separator between rows is an empty skippable frame, which decoders pass over.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import HOT_KEYS, drop_dir, join_hot, scratch_dir, write_table

# Fixed values of the archive format.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\0\0\0\0"  # skippable frame 0x184D2A50 of no bytes
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE_16_DIGITS, BASE_32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

#: Payload bytes of an archive, about; a record is never split.
ARCHIVE_BYTES = 64 << 20
#: The dictionary is built from this many pieces of the archived records, of PIECE characters at most.
SAMPLE_PIECES, PIECE = 2000, 8192
DICTIONARY_BYTES = 112_640
LEVEL = 6

READ_SCHEMA = (
    "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, "
    "record_id string, archive string, offset long, payload binary"
)


def base32_digest(text: Column) -> Column:
    """Upper-case base32 SHA-1 of a text's UTF-8 bytes: 160 bits are four times 40 bits, eight digits each."""
    digest = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), BASE_16_DIGITS, BASE_32_DIGITS)


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), html.alias("html"))
    return rows.withColumns({"_digest": base32_digest(F.col("html")), "_bytes": F.octet_length("html").cast("long")})


def count_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Narrow table: ``_digest``, ``_bytes``, ``page_id``, ``url`` and ``_copies``, how many rows have all of them."""
    rows = _pages(pages, id_col, url_col, html_col)
    return rows.groupBy("_digest", "_bytes", "page_id", "url").agg(F.count(F.lit(1)).alias("_copies"))


def plan_responses(counted: DataFrame) -> DataFrame:
    """A row per payload: how many rows have it, ``_n``, and which is its response.

    That is the row with the smallest id, rows without an id last; among rows that share the id the smallest url.
    """
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url", "_copies")
    first = counted.groupBy("_digest").agg(F.sum("_copies").alias("_n"), F.max("_bytes").alias("_each"), F.min(order).alias("_f"))
    return first.select(
        "_digest", "_n", "_each", F.col("_f.page_id").alias("_first_id"), F.col("_f.url").alias("_first_url"), F.col("_f._copies").alias("_first_copies")
    )


def _identity(digest: str, page_id: int | None, url: str | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, repr((digest, page_id, url, copy)))}>"


def _header(lines: list[tuple[str, str]], first: str) -> bytes:
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")  # noqa: E731  a line end in a value would end the field
    return "".join([first, "\r\n", *(f"{k}: {clean(v)}\r\n" for k, v in lines), "\r\n"]).encode()


def record_bytes(digest, n_bytes, page_id, url, copy, first_id, first_url, payload: bytes | None, date: str) -> bytes:
    """One record; ``payload`` is None for a revisit, whose block is the HTTP headers alone."""
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", n_bytes)], "HTTP/1.1 200 OK")
    block = http + (payload or b"")
    fields = [
        ("WARC-Type", "revisit" if payload is None else "response"),
        ("WARC-Record-ID", _identity(digest, page_id, url, copy)),
        ("WARC-Date", date),
    ]
    fields += [("WARC-Target-URI", url)] * (url is not None) + [("Page-ID", page_id)] * (page_id is not None)
    if payload is None:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", _identity(digest, first_id, first_url, 0))]
        fields += [("Refers-To-Page-ID", first_id)] * (first_id is not None)
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return _header(fields, "WARC/1.1") + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained on the samples; where they are too few for that, their own bytes."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, dict_id=0x57415243).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def build_dictionary(pages: DataFrame, html_col: str = "html", *, total: int, pieces: int = SAMPLE_PIECES) -> bytes:
    """Dictionary from ``pieces`` pieces of the records, picked by hash from all over the whole texts.

    One task holds at most ``pieces`` times ``PIECE`` characters; the driver gets the dictionary alone. Only the
    size of the archives depends on it.
    """
    text = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    share = max(1, total // (4 * pieces))  # about four times as many texts as pieces, so that short tables give enough
    picked = pages.select(text.alias("t")).where((F.octet_length("t") > 0) & (F.pmod(F.xxhash64("t"), F.lit(share)) == 0))
    last = F.char_length("t") - 1
    cut = picked.select(F.explode(F.sequence(F.lit(0), last, F.lit(PIECE))).alias("at"), "t").select(
        F.substring("t", F.col("at") + 1, F.lit(PIECE)).alias("piece")
    )
    few = cut.orderBy(F.xxhash64("piece"), "piece").limit(pieces)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [x.encode() for batch in batches for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_dictionary(samples)], pa.binary())], ["dictionary"])

    return bytes(few.repartition(1).mapInArrow(train, "dictionary binary").first()[0])


def _dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    *,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a record per row of ``pages`` below ``path``, as ``.warc.zst`` files of about ``archive_bytes`` of payload.

    Null texts are empty payloads, which repeat each other like any; rows without id or url have records without
    these fields; repeated rows are records of their own. An empty table gives no archive. Other columns may have
    any name. Payloads are shuffled once, those of much repeated texts (``join_hot``) not at all; revisits are made of
    the narrow counts. Tasks that are run again write the same records, and a file counts when its task is committed.
    """
    spark = pages.sparkSession
    counted, counts_at = write_table(count_rows(pages, id_col, url_col, html_col), "rows")
    plan, plan_at = write_table(plan_responses(counted), "payloads")
    copied = F.coalesce(F.max("_first_copies"), F.lit(0))
    total, size, copies = plan.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_each"), F.lit(0)), copied).first()
    dictionary = build_dictionary(pages, html_col, total=total) if total else b""
    payload = F.col("html").cast("binary").alias("payload")
    columns = ["_digest", "_bytes", "page_id", "url", "_copy", "_first_id", "_first_url"]
    is_first = F.col("page_id").eqNullSafe(F.col("_first_id")) & F.col("url").eqNullSafe(F.col("_first_url"))
    rows = _pages(pages, id_col, url_col, html_col)
    # as in join_hot, but the payloads that are shuffled, once, go to as many tasks as there are to be archives
    is_hot = F.col("_n") * HOT_KEYS > F.lit(total)
    hot, cold = F.broadcast(plan.where(is_hot)), plan.where(~is_hot)
    dealt = rows.join(hot.select("_digest"), "_digest", "left_anti").repartition(size // archive_bytes + 1, "_digest")
    first = rows.join(hot, "_digest").unionByName(dealt.join(cold, "_digest")).where(is_first).withColumn("_copy", F.lit(0))
    records = first.where("_first_copies = 1").select(*columns, payload)
    if copies > 1:  # rows alike in all: one of them
        alike = first.where("_first_copies > 1").dropDuplicates(["_digest"])
        records = records.unionByName(alike.select(*columns, payload))
    others = join_hot(counted, plan, ["_digest"], "_n", total)
    others = others.withColumn("_copy", F.explode(F.expr("sequence(0, cast(_copies as int) - 1)"))).where(~is_first | (F.col("_copy") > 0))
    records = records.unionByName(others.select(*columns, F.lit(None).cast("binary").alias("payload")))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        lead = _dictionary_frame(dictionary)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            frames = [press.compress(record_bytes(*row, date)) for row in rows]
            if frames:
                frames[0], lead = lead + frames[0], b""
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    frames = records.mapInArrow(compress, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option("compression", "none").text(path)
    _name_archives(spark, path)
    for done in (counts_at, plan_at):
        drop_dir(spark, done)


def _name_archives(spark: SparkSession, path: str) -> None:
    """Give the committed files their ending; ``read_archives`` reads them under either name. Empty ones go."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.listStatus(there):
        name = found.getPath().getName()
        if not found.getLen():  # of a task without rows
            files.delete(found.getPath(), False)
        elif name.startswith("part-") and name.endswith(".txt"):
            files.rename(found.getPath(), found.getPath().getParent().suffix(f"/{name[:-4]}.warc.zst"))


def frames_of(data: memoryview) -> Iterator[tuple[int, memoryview, bool]]:
    """(offset, frame, whether it is skippable) of a file, by the sizes in block headers, without decompressing."""
    at = 0
    while at < len(data):
        skippable = int.from_bytes(data[at : at + 4], "little") & 0xFFFFFFF0 == 0x184D2A50
        if skippable:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        else:
            end, last = at + zstandard.frame_header_size(data[at : at + 18]), 0
            while not last and end < len(data):
                block = int.from_bytes(data[end : end + 3], "little")
                last, kind = block & 1, block >> 1 & 3
                end += 3 + (1 if kind == 1 else block >> 3)
            end += 4 * zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
        if end > len(data):
            raise ValueError(f"the frame at {at} goes beyond the file")
        yield at, data[at:end], skippable
        at = end


def _fields(head: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines if k}


def parse_record(record: bytes) -> tuple:
    """(page_id, url, record_type, digest, payload_bytes, refers_to, record_id, payload); checks lengths and digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(_fields(http)["content-length"])
    whole = fields["warc-type"] == "response"
    if len(rest) != len(block) + 4 or whole and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("page-id"), fields.get("warc-target-uri"), fields["warc-type"], digest, size, number("refers-to-page-id"), fields["warc-record-id"], payload if whole else None


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of the archives below ``path`` (``READ_SCHEMA``), each response checked against its digest.

    A task reads an archive at a time and decompresses a record at a time, by the dictionary at the archive's
    head. Line ends in urls come back as %0D and %0A.
    """
    names = [x.split(" ")[0] for x in READ_SCHEMA.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()], strict=True)))
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                name, data = archive.as_py(), memoryview(content.as_buffer())
                opened, out, held = zstandard.ZstdDecompressor(), [], 0
                for at, frame, skippable in frames_of(data):
                    if skippable:
                        if at == 0 and int.from_bytes(frame[:4], "little") == DICTIONARY_MAGIC:
                            packed = bytes(frame[8:])
                            raw = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == b"\x28\xb5\x2f\xfd" else packed
                            opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                        continue
                    record = opened.stream_reader(io.BytesIO(frame)).read()
                    *found, payload = parse_record(record)
                    out.append((*found, name, at, payload if payloads else None))
                    held += len(record)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(read, READ_SCHEMA)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives in the shared folder, and what the archives say of it when read back."""
    path = f"{scratch_dir(spark)}/archives"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as hex,
             row_number() over (partition by html order by page_id nulls last) as k,
             first_value(page_id) over (partition by html order by page_id nulls last) as first_id from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + cast((cast('0x' || substr(hex, 1 + 10 * cast(floor(i / 8) as int), 10) as ubigint) >> cast(35 - 5 * (i % 8) as int)) & 31 as int), 1)),
         'string_agg', '') as payload_digest,
       case when k = 1 then 'response' else 'revisit' end as record_type,
       case when k > 1 then first_id end as refers_to
from d
"""
