import gzip
import hashlib
from collections import defaultdict

from changelens.llm import warc

SCHEMA = "page_id long, url string, html string"


def _pages():
    long = "<p>é</p>" * 200
    rows = [(i, f"http://h{i % 3}.org/{i}", f"<html>{i}</html>" * (i % 200)) for i in range(40)]
    rows += [(100 + i, "http://copy.org/ x", long) for i in range(30)] + [(129, "http://copy.org/", long)]
    rows += [(200, None, None), (201, "u", ""), (None, "u", long), (None, "u", "short"), (202, "u", "short"),
             (203, "u", "x" * 999), (204, "u", "x" * 999), (205, "u", "x" * 1000), (206, "u", "x" * 1000),
             (207, "u", "z" * 2_000_000)]
    return rows


def test_write_and_read_back(spark, tmp_path):
    rows = _pages()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS same", "3 AS kind")
    manifest = warc.write_warc(df, f"file://{tmp_path}/a", roll_bytes=2000)
    got = warc.read_warc(manifest, with_payload=True).collect()
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    expected = []
    for text, ids in groups.items():
        data = text.encode()
        top = max((i for i in ids if i is not None), default=None)
        responses = 0
        for i in ids:
            first = len(data) < 1000 or i == top and not responses
            responses += i == top and len(data) >= 1000
            expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if first else "revisit",
                             None if first else top, data if first else None))
    key = lambda r: repr(r[:5])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                    None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(expected, key=key)
    files = manifest.collect()
    assert len(files) > 8 and sum(f.records for f in files) == len(rows)
    assert not list(tmp_path.glob("a/.*.tmp"))
    for f in files:
        data = open(f.path.removeprefix("file://"), "rb").read()
        assert (len(data), hashlib.sha1(data).hexdigest()) == (f.bytes, f.sha1)
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    again = warc.write_warc(df, f"file://{tmp_path}/b", roll_bytes=2000).collect()
    assert sorted(f.sha1 for f in again) == sorted(f.sha1 for f in files)  # the same rows, the same bytes


def test_a_renamed_file_stays(tmp_path):
    import pyarrow as pa
    (tmp_path / "x.gz").write_bytes(b"12345")
    row = {"temporary": f"{tmp_path}/gone", "path": f"{tmp_path}/x.gz", "records": 1, "bytes": 5, "sha1": "-"}
    assert [b.num_rows for b in warc._commit([pa.RecordBatch.from_pylist([row])])] == [1]


def test_no_pages(spark, tmp_path):
    manifest = warc.write_warc(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/a")
    assert warc.read_warc(manifest).collect() == []
