import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from wikiloom.llm.queries import op13_warc
from wikiloom.llm.warc import archive, read_archives, record_chunks, record_kinds, unpacked, write_archives
from wikiloom.plans.shared import shared_table

SCHEMA = "page_id long, url string, html string, chunk int, body string, record string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(data, least=0):
    first = {}
    for row in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(row[2] or "", row[0])
    seen, out = set(), []
    for row in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        text = row[2] or ""
        again = text in seen and len(text.encode()) >= least
        seen.add(text)
        out.append((row[0], len(text.encode()), digest(text), "revisit" if again else "response", first[text] if again else None))
    return sorted(out, key=str)


def pages():
    long = "ö<b>" * 50_000
    texts = [(3, "same"), (1, "same"), (2, "same"), (5, None), (4, ""), (6, long), (7, long), (8, "WARC/1.1\r\n\r\n\r\n\r\n"), (9, "a"), (9, "a"), (9, "b"), (None, "same"), (None, "alone"), (-3, "å" * 40)]
    return [(i, None if i == 4 else f"http://x/{i} y\r\nz", t, 1, "b", "r") for i, t in texts]


def table(spark, data, parts=3):
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


@pytest.mark.parametrize("least", [0, 10])
def test_records(spark, least, tmp_path):
    data = pages() + [(100 + i, "u", "a page that many pages repeat", 0, "", "") for i in range(300)]
    where = f"file://{tmp_path}/archives"
    got = archive(table(spark, data), least=least, path=where, size=1000)
    assert sorted(map(tuple, got.collect()), key=str) == brute(data, least)
    assert all(x.endswith(".warc.gz") for x in os.listdir(tmp_path / "archives"))  # no attempts are left
    # Payloads as they are read back, chunk by chunk.
    parts = read_archives(spark, where).where("kind = 'response'").groupBy("id", "uri").agg(F.array_sort(F.collect_list(F.struct("chunk", "body"))).alias("b"))
    texts = {b"".join(bytes(x["body"]) for x in r["b"]).decode() for r in parts.where("id IN (6, 8, -3)").collect()}
    assert texts == {"ö<b>" * 50_000, "WARC/1.1\r\n\r\n\r\n\r\n", "å" * 40}


def test_archives_are_warc(spark, tmp_path):
    """Read without the reader: one gzip member a record, header, block of Content-Length, two line ends."""
    where = f"{tmp_path}/archives"
    archive(table(spark, pages(), 1).coalesce(1), path=where).count()
    kinds = []
    for name in os.listdir(where):
        data = gzip.open(f"{where}/{name}").read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= fields.keys()
            size = int(fields["Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            if fields["WARC-Type"] == "response":
                _, _, payload = rest[:size].partition(b"\r\n\r\n")
                assert fields["WARC-Payload-Digest"] == f"sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}"
            if fields["WARC-Type"] == "revisit":
                assert fields["WARC-Profile"].endswith("identical-payload-digest") and fields["WARC-Refers-To"]
            kinds.append(fields["WARC-Type"])
            data = rest[size + 4 :]
    assert kinds.count("response") + kinds.count("revisit") == len(pages())


def test_chunks_carry_digests(spark):
    text = "é" * 1250
    rows = sorted(record_chunks(table(spark, [(1, "u", text, 0, "", ""), (2, "u", "", 0, "", ""), (3, "u", "x" * 1000, 0, "", "")], 1), "page_id", "html", "url", 1000).collect(), key=lambda r: (r["id"], r["chunk"]))
    assert b"".join(unpacked(bytes(r["packed"]), r["size"]) for r in rows[:3]).decode() == text
    assert [(r["id"], r["chunk"], r["size"], r["bytes"], r["last"]) for r in rows] == [("1", 0, 1000, 1000, False), ("1", 1, 1000, 2000, False), ("1", 2, 500, 2500, True), ("2", 0, 0, 0, True), ("3", 0, 1000, 1000, True)]
    for r in rows[:3]:
        assert bytes(r["sha1"]) == hashlib.sha1(text.encode()[: r["bytes"]]).digest()


def test_archives_roll_and_damage_shows(spark, tmp_path):
    where = f"{tmp_path}/archives"
    chunks = shared_table(record_chunks(table(spark, [(i, "u", os.urandom(2000).hex(), 0, "", "") for i in range(40)], 1), "page_id", "html"), "t")
    heads = record_kinds(chunks)
    write_archives(chunks, heads, where)
    assert read_archives(spark, where, bodies=False).count() == 40
    name = os.listdir(where)[0]
    with gzip.open(f"{where}/{name}") as f:
        data = f.read()
    with gzip.open(f"{where}/{name}", "w") as f:
        at = data.rindex(b"\r\n\r\n", 0, -4) + 10
        f.write(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(Exception, match="digest"):
        read_archives(spark, where).count()


def test_empty_and_query(spark, tmp_path):
    assert archive(spark.createDataFrame([], SCHEMA)).count() == 0
    table(spark, pages()).write.parquet(f"{tmp_path}/pages.parquet")
    got = op13_warc(spark, str(tmp_path))
    assert got.dtypes == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(pages())
