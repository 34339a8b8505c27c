import gzip
import io

import pytest
from pyspark.sql import functions as F

from tillroll.llm import warc
from tillroll.plans.oracle_compare import compare, duck

D = "/root/testdata/sf0.01"


def test_query_equals_its_sql(spark):
    res = compare(spark, duck(D), "op1", warc.op1_warc, warc.OP1_SQL, D)
    assert res["ok"], res


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>{i % 5} é\r\n\r\nWARC/1.1\r\n" * (i % 5), "x") for i in range(40)]
    rows += [(50, None, None, None), (51, "u\r\nInjected: 1", "", None), (None, "n", "only", None), (60, "big", "z" * 3_000_000, None), (70, "twice", "once", None), (70, "twice", "once", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    path = str(tmp_path_factory.mktemp("warc") / "out")
    warc.write_pages(df, path)
    return rows, path


def test_round_trip(spark, archive):
    rows, path = archive
    out = warc.read_records(spark, path).collect()
    assert len(out) == len(rows)
    keeper = {}
    for r in rows:
        if r[0] is not None:
            keeper[r[2] or ""] = max(keeper.get(r[2] or "", r[0]), r[0])
    by_id = {r.record_id: r for r in out}
    for i, url, html, _ in rows:
        html = html or ""
        r = by_id[f"urn:page:{'' if i is None else i}"]
        assert r.payload_length == len(html.encode()) and r.payload_digest == warc.base32_sha1(html.encode())
        if i == keeper.get(html, i):
            assert r.record_type == "response" and bytes(r.payload) == html.encode() and r.refers_to is None
        else:
            assert r.record_type == "revisit" and r.payload is None and r.refers_to == f"urn:page:{keeper[html]}"
        assert "injected" not in r.headers


def test_small_ranges_lose_and_repeat_nothing(spark, archive):
    rows, path = archive
    warc.register(spark)
    for size in (100, 1000, 10 ** 9):
        got = spark.read.format("warc").option("splitBytes", size).load(path).select("record_id").collect()
        assert len(got) == len(rows)


def test_filters_are_pushed(spark, archive):
    rows, path = archive
    read = warc.read_records(spark, path)
    some = read.where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://h1."))
    assert some.count() == sum(r.record_type == "response" and (r.target_uri or "").startswith("http://h1.") for r in read.collect())
    reader = warc.WarcReader({"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("http_status",), 200)]))
    assert len(left) == 1 and reader.filters == [("record_type", "in", ("revisit",))]
    assert all(b.column("record_type").to_pylist() == ["revisit"] * len(b) for p in reader.partitions() for b in reader.read(p))


def test_repeated_rows_are_all_responses(spark, archive):
    _, path = archive
    twice = warc.read_records(spark, path).where("record_id = 'urn:page:70'").collect()
    assert [(r.record_type, bytes(r.payload)) for r in twice] == [("response", b"once")] * 2


def test_unwanted_payloads_stay_packed(monkeypatch):
    data = warc.member(warc.record({"WARC-Type": "response", "Content-Type": "text/plain"}, bytes(range(256)) * 20000))
    items = []
    first = warc.Member.__init__
    monkeypatch.setattr(warc.Member, "__init__", lambda self, *a: (items.append(self), first(self, *a))[1])
    stream = io.BytesIO(data * 3)
    assert list(warc.records(stream, len(data) * 3, 0, len(data) * 3, [("record_type", "in", ("request",))], True)) == []
    assert len(items) == 3 and all(len(x.out) < 10000 for x in items)


def test_other_writers_files(spark, tmp_path):
    a = warc.record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:a>", "Content-Type": "application/warc-fields"}, b"software: x\r\n")
    b = warc.record({"WARC-Type": "resource", "WARC-Record-ID": "<urn:b>", "WARC-Target-URI": "u:1"}, b"hello\r\n\r\nWARC/1.0")
    (tmp_path / "plain.warc").write_bytes(a + b)
    (tmp_path / "packed.warc.gz").write_bytes(gzip.compress(a) + gzip.compress(b))
    got = warc.read_records(spark, str(tmp_path)).orderBy("file", "offset").collect()
    assert [(r.record_type, bytes(r.payload)) for r in got] == [("warcinfo", b"software: x\r\n"), ("resource", b"hello\r\n\r\nWARC/1.0")] * 2
    assert warc.read_records(spark, str(tmp_path), payload=False).where("payload IS NOT NULL").count() == 0


def test_broken_record_names_its_place(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(warc.member(b"WARC/1.1\r\nno end"))
    with pytest.raises(Exception, match="x.warc.gz"):
        warc.read_records(spark, str(tmp_path)).collect()


def test_least_bytes_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    types = {r.record_id: r.record_type for r in warc.page_records(df, least_bytes=5).collect()}
    assert [types[f"urn:page:{i}"] for i in (1, 2, 3, 4)] == ["response", "response", "revisit", "response"]
    warc.write_pages(df.limit(0), str(tmp_path / "none"))
    assert warc.read_records(spark, str(tmp_path / "none")).count() == 0


def member(name, payload, level, length_field=False):
    record = (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{name}>\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n")
    whole = gzip.compress(record, level, mtime=0)
    if not length_field:
        return whole
    extra = b"sl" + (8).to_bytes(2, "little")
    total = len(whole) + 2 + len(extra) + 8
    return whole[:3] + bytes([whole[3] | 4]) + whole[4:10] + (len(extra) + 8).to_bytes(2, "little") + extra + total.to_bytes(4, "little") + (0).to_bytes(4, "little") + whole[10:]


@pytest.mark.parametrize("length_field", [False, True])
@pytest.mark.parametrize("inner_size", [3, 400])
def test_an_archive_inside_a_payload_is_no_record_at_any_split(tmp_path, length_field, inner_size):
    """The payload is stored uncompressed, so the inner records stand in the file as they are."""
    import random

    r = random.Random(inner_size)
    noise = lambda n: bytes(r.randrange(256) for _ in range(n))
    inner = b"".join(member(f"inner{i}", noise(400), 6, length_field) for i in range(inner_size))
    outer = [member("a", b"first " * 50, 6, length_field), member("b", inner, 0, length_field), member("c", noise(70_000), 6, length_field),
             member("d", inner[:900], 0, length_field), member("e", b"", 6, length_field)]
    for tail in (b"", b"\0" * 512):
        data = b"".join(outer) + tail
        size, stream = len(data), io.BytesIO(data)
        starts = [sum(map(len, outer[:i])) for i in range(len(outer))]
        probes = {p + d for p in starts for d in (-1, 0, 1)} | set(range(1, size, max(1, size // 60)))
        for p in sorted(x for x in probes if 0 <= x < size):
            want = next((s for s in starts if s >= p), size)
            assert warc.next_member(stream, p, size) == want, p
        for step in (700, 5000, 100_000):
            got = [x["record_id"] for a in range(0, size, step) for x in warc.records(stream, size, a, min(a + step, size), [], True)]
            assert got == ["urn:a", "urn:b", "urn:c", "urn:d", "urn:e"], step
