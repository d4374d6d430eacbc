"""Archives: a round trip of every payload, the shared dictionary, revisits, odd rows."""

import base64
import glob
import hashlib
import io
from collections import Counter, defaultdict

import pytest
import zstandard

from loomgraph.llm import warc

PAGE = "<html><body>" + "".join(f"<p class='t{i % 7}'>paragraph {i}</p>" for i in range(60)) + "</body></html>"
ROWS = [(i, f"http://x/{i}", PAGE + str(i % 40)) for i in range(90)] + [
    (100, "u", None), (101, "u", ""), (102, None, "é\r\n\r\nWARC/1.1 \0"), (None, "n", PAGE), (None, "n", PAGE), (103, "v", PAGE),
    (104, "twice", "same row"), (104, "twice", "same row"), (104, "other", "same row"), (105, "twice", "same row"),
    (None, "z", "no id at all"), (None, "y", "no id at all"), (106, "long", "x" * 3_000_000), (107, "line\r\nend", warc.EMPTY_FRAME),
]


def expected(rows):
    groups = defaultdict(list)
    for page_id, url, html in rows:
        groups[html or ""].append((page_id is None, page_id, url is None, url))
    out = Counter()
    for html, found in groups.items():
        raw = html.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first, *others = sorted(found)
        out[first[1], first[3], len(raw), digest, "response", None, raw] += 1
        for x in others:
            out[x[1], x[3], len(raw), digest, "revisit", first[1], None] += 1
    return out


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('warc')}/a"
    odd = spark.createDataFrame([(*r, "c", 1) for r in ROWS], "page_id long, url string, html string, _digest string, payload int").repartition(3)
    warc.write_archives(odd, path, archive_bytes=1 << 16)
    return path


def test_round_trip(spark, archives):
    rows = warc.read_archives(spark, archives).collect()
    got = Counter((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in rows)
    want = Counter({(p, u and u.replace("\r", "%0D").replace("\n", "%0A"), n, d, t, f, x): c for (p, u, n, d, t, f, x), c in expected(ROWS).items()})
    assert got == want
    assert len({r["record_id"] for r in rows}) == len(rows)  # also of rows alike in all


def test_files_are_plain_zstandard(archives):
    """Any decoder that is given the leading frame's dictionary reads the whole file, and single frames."""
    files = glob.glob(f"{archives}/*.warc.zst")
    assert len(files) > 1
    for name in files:
        with open(name, "rb") as f:
            data = f.read()
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
        n = int.from_bytes(data[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + n]))
        reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(data[8 + n :]), read_across_frames=True)
        text = reader.read()
        assert text.count(b"WARC/1.1\r\nWARC-Type:") == sum(not s for _, _, s in warc.frames_of(memoryview(data)))


def test_dictionary_is_trained_and_helps(spark):
    pages = spark.createDataFrame([(i, "u", PAGE.replace("paragraph", f"word{i} of")) for i in range(400)], "page_id long, url string, html string")
    dictionary = warc.build_dictionary(pages, total=400)
    assert dictionary[:4] == b"\x37\xa4\x30\xec"  # a trained one has this magic number
    page = PAGE.replace("paragraph", "word999 of").encode()
    with_it = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(page)
    assert 1.5 * len(with_it) < len(zstandard.ZstdCompressor().compress(page))


def test_empty_and_null_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(empty, f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").collect() == []
    warc.write_archives(spark.createDataFrame([(None, None, None)], empty.schema), f"{tmp_path}/one")
    row = warc.read_archives(spark, f"{tmp_path}/one").first()
    assert (row["page_id"], row["url"], row["payload_bytes"], row["record_type"], bytes(row["payload"])) == (None, None, 0, "response", b"")


def test_damage_is_told(spark, archives, tmp_path):
    name = max(glob.glob(f"{archives}/*.warc.zst"))
    with open(name, "rb") as f:
        data = f.read()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.warc.zst").write_bytes(data[:-40])
    with pytest.raises(Exception, match="beyond the file|damaged"):
        warc.read_archives(spark, str(tmp_path / "bad")).collect()


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = Counter({(k[0], *k[2:6]): n for k, n in expected([(r["page_id"], r["url"], r["html"]) for r in pages]).items()})
    assert Counter(map(tuple, warc.op12_warc(spark, sf).collect())) == want
