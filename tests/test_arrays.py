"""JSON array files cut into ranges of bytes, against Spark's reader that takes a file in one task."""

import json
import random

import pytest

from loomgraph.sources import arrays, snapshot

SCHEMA = "a string, n long, deep struct<list:array<string>, more:map<string,string>>"
ODD = ['plain', '"', "\\", '\\"', '}{][', 'x\\\\', '"}, {"a": "', "é ü 漢字 \U0001f600", "", "\n\t", "\\" * 9, '{"a": [1, 2]}']


def objects(rng, n):
    text = lambda: "".join(rng.choices(ODD, k=rng.randint(0, 4)))
    for k in range(n):
        yield rng.choice([{}, {"a": text(), "n": k}, {"n": k, "deep": {"list": [text() for _ in range(3)], "more": {text(): text()}}, "other": [[{}], {"a": text()}]}])


def plain(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize(("range_bytes", "chunk"), [(37, 5), (200, 64), (1000, 4 << 20), (1 << 20, 11)])
def test_any_ranges_give_the_same_rows(spark, tmp_path, monkeypatch, indent, range_bytes, chunk):
    monkeypatch.setattr(arrays, "CHUNK_BYTES", chunk)
    rng = random.Random(range_bytes)
    file = tmp_path / "things.json"
    file.write_text(" \n" + json.dumps(list(objects(rng, 25)), indent=indent, ensure_ascii=False), encoding="utf-8")
    whole = spark.read.schema(SCHEMA).json(str(file), multiLine=True)
    assert plain(arrays.read_array(spark, str(file), SCHEMA, range_bytes=range_bytes)) == plain(whole)


@pytest.mark.parametrize("range_bytes", [1, 2, 3, 7])
def test_borders_inside_escapes(tmp_path, range_bytes):
    """Every border of a range, inside a run of backslashes too."""
    file, values = tmp_path / "x.json", [{"a": "\\" * k + '"' * (k % 3) + "}"} for k in range(5)]
    file.write_text(json.dumps(values))
    size, state, got = file.stat().st_size, (0, 0), []
    for start in range(0, size, range_bytes):
        end = min(size, start + range_bytes)
        got += [json.loads(x) for _, x in arrays._objects(f"file:{file}", start, end, *state, 1)]
        odd, out, inside = arrays._summary(f"file:{file}", start, end)
        state = state[0] ^ odd, state[1] + (inside if state[0] else out)
    assert got == values and state == (0, 0)


@pytest.mark.parametrize(("text", "rows"), [("", 0), ("  ", 0), ("[]", 0), ('{"a": "one"}', 1), ('[{"a": "x"}, 3, null, [{"a": "y"}]]', 1), ('[{"a": "x"}, {"a": "cut', 2)])
def test_odd_files(spark, tmp_path, text, rows):
    file = tmp_path / "x.json"
    file.write_text(text)
    for size in (3, 100):
        assert arrays.read_array(spark, str(file), SCHEMA, range_bytes=size).count() == rows


def test_a_large_kind_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """The snapshot's reader cuts a file beyond the limit; objects keep the order of the file."""
    monkeypatch.setattr(arrays, "RANGE_BYTES", 4096)
    pods = [{"metadata": {"name": f"pod-{k}", "uid": f"u{k}", "labels": {"q": '"}{'}}, "spec": {"nodeName": "n"}, "status": {"phase": "Running"}} for k in range(500)]
    (tmp_path / "pods.json").write_text(json.dumps(pods))
    df = snapshot.read_kind(spark, str(tmp_path), "Pod", ordinals=True)
    assert df.rdd.getNumPartitions() == -(-(tmp_path / "pods.json").stat().st_size // 4096) > 10
    assert [r["metadata"]["name"] for r in df.orderBy(snapshot.ORDINAL).collect()] == [f"pod-{k}" for k in range(500)]
    monkeypatch.setattr(arrays, "RANGE_BYTES", 1 << 30)
    assert plain(df.drop(snapshot.ORDINAL)) == plain(snapshot.read_kind(spark, str(tmp_path), "Pod"))


def test_no_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        arrays.read_array(spark, str(tmp_path / "none.json"), SCHEMA)
