"""ZIP packages against the standard library's ZIP files, and pages through packages and back."""

from __future__ import annotations

import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from plinth.llm import warc


def reader(data: bytes):
    return lambda at, n: data[at : at + n]


def packed(names, method=zipfile.ZIP_STORED, comment=b"", prefix=b""):
    file = io.BytesIO()
    file.write(prefix)
    with zipfile.ZipFile(file, "a" if prefix else "w", method) as z:
        for name, body in names.items():
            z.writestr(name, body)
        z.comment = comment
    return file.getvalue()


@pytest.mark.parametrize("comment", [b"", b"note", b"PK\x05\x06" + b"x" * 40, b"x" * 65535])
@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_directory_equals_zipfile(comment, method):
    names = {"a.txt": b"one", "é/b.bin": bytes(1000), "empty": b""}
    data = packed(names, method, comment)
    found = warc.directory(reader(data), len(data))
    assert {m.name: warc.content(reader(data), m) for m in found} == names


def test_bytes_in_front_of_the_archive():
    plain = packed({"a": b"body"})
    data = b"#!/bin/sh\n" * 100 + plain
    (member,) = warc.directory(reader(data), len(data))
    assert warc.content(reader(data), member) == b"body"


def test_more_members_than_sixteen_bits_count():
    data = packed({str(i): b"%d" % i for i in range(70_000)})
    found = warc.directory(reader(data), len(data))
    assert len(found) == 70_000 and warc.content(reader(data), found[69_999]) == b"69999"
    shifted = b"front" + data
    again = warc.directory(reader(shifted), len(shifted))
    assert warc.content(reader(shifted), again[12_345]) == b"12345"


def test_members_beyond_four_gigabytes(tmp_path):
    path = tmp_path / "wide.zip"
    with open(path, "wb") as f:
        f.truncate(5 << 30)  # a hole, no bytes on disk
    with zipfile.ZipFile(path, "a", zipfile.ZIP_STORED) as z:
        z.writestr("archive/far", b"far away")
    with open(path, "rb") as f:
        def read(at, n):
            f.seek(at)
            return f.read(n)

        (member,) = warc.directory(read, path.stat().st_size)
        assert member.header == 5 << 30 and warc.content(read, member) == b"far away"


def test_sizes_from_the_wide_field():
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as z, z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as f:
        f.write(b"body")
    data = file.getvalue()
    (member,) = warc.directory(reader(data), len(data))
    assert warc.content(reader(data), member) == b"body"
    assert warc._wide(b"\x09\x00\x01\x00z" + b"\x01\x00\x10\x00" + (5 << 32).to_bytes(8, "little") + (6 << 32).to_bytes(8, "little"), 0xFFFFFFFF, 7, 0xFFFFFFFF) == (5 << 32, 7, 6 << 32)


@pytest.mark.parametrize("data", [b"", b"no archive" * 100, packed({"a": b"b"})[:-1]])
def test_other_files_are_refused(data):
    with pytest.raises(ValueError):
        warc.directory(reader(data), len(data))


def test_packed_archives_have_no_ranges():
    data = packed({"archive/data.warc.gz": b"x" * 100}, zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError):
        list(warc.package_records(reader(data), len(data)))


@pytest.mark.parametrize("step", [1, 50, 1 << 20])
def test_walk_finds_records_without_an_index(monkeypatch, step):
    monkeypatch.setattr(warc, "STEP_BYTES", step)
    bodies = [random.Random(i).randbytes(i * 40) for i in range(12)]
    parts = [warc.record(str(i), None, b, warc.payload_digest(b), len(b), None) for i, b in enumerate(bodies)]
    data = packed({"archive/data.warc.gz": b"".join(parts)})
    found = list(warc.package_records(reader(data), len(data)))
    assert [warc.parsed(data[at : at + n])["payload"] for _, at, n in found] == bodies
    with pytest.raises(ValueError):
        list(warc.walk(reader(parts[3][:-3]), 0, len(parts[3]) - 3))


def test_a_changed_payload_is_noticed():
    good = zlib.decompress(warc.record("1", "http://x/", b"body", warc.payload_digest(b"body"), 4, None), 31)
    machine = zlib.compressobj(1, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        warc.parsed(machine.compress(good.replace(b"body", b"boby")) + machine.flush())


def test_records_carry_their_fields():
    digest = warc.payload_digest(b"1\r\n\r\n2")
    got = warc.parsed(warc.record("a b>", "http://x/ü\r\nEvil: 1", b"1\r\n\r\n2", digest, 6, None))
    assert (got["page"], got["payload"], got["size"], got["record_type"]) == ("a b>", b"1\r\n\r\n2", 6, "response")
    assert got["url"] == "http://x/%C3%BC%0D%0AEvil:%201"
    again = warc.parsed(warc.record(None, None, None, digest, 6, "17"))
    assert (again["page"], again["refers"], again["size"], again["digest"], again["record_type"]) == (None, "17", 6, digest, "revisit")


ROWS = [
    (1, "http://a/", "same"), (2, None, "same"), (9, "http://b/x?y", "same"), (3, "http://c/", None), (4, "http://c/", ""), (5, "x://[bad", "ü" * 200_000),
    (None, "http://d/", "same"), (None, "http://d/", "alone"), (7, "http://e/", "twice"), (7, "http://f/", "twice"),
]


@pytest.mark.parametrize("package_bytes", [1, 1 << 30])
def test_round_trip_equals_brute_force(spark, tmp_path, package_bytes, monkeypatch):
    monkeypatch.setattr(warc.pack, "__defaults__", (package_bytes,))
    pages = spark.createDataFrame([(*r, "own", "own", 1) for r in ROWS], "page_id bigint, url string, html string, page string, refers string, n int")
    got = warc.round_trip(pages, folder=str(tmp_path)).collect()
    wanted = []
    for page, _, html in ROWS:
        body = (html or "").encode()
        most = max((p for p, _, h in ROWS if (h or "") == (html or "") and p is not None), default=None)
        wanted.append((page, len(body), warc.payload_digest(body), "response" if page == most else "revisit", None if page == most else most))
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)
    files = list(tmp_path.glob("*.wacz"))
    assert len(files) <= len(ROWS) and (package_bytes > 1 or len(files) == len(ROWS))
    for file in files:
        assert zipfile.ZipFile(file).testzip() is None


def test_records_give_payloads_by_ranges(spark, tmp_path):
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.repeat(F.col("id").cast("string"), 300).cast("binary").alias("payload"))
    packages = warc.pack(pages.coalesce(2), str(tmp_path), 20_000)
    assert packages.count() > 2 and packages.selectExpr("sum(n_records)").first()[0] == 500
    assert warc.locate(packages, 4_000).count() > packages.count()
    found = warc.records(packages, run_bytes=4_000)
    assert {(r.page, bytes(r.payload)) for r in found.collect()} == {(str(i), str(i).encode() * 300) for i in range(500)}


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(pages, folder=str(tmp_path)).count() == 0
