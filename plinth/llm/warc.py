"""WARC archives in ZIP packages: written by tasks, found by their directories, read by ranges.

A package is a ZIP file with stored (uncompressed) members: `archive/data.warc.gz`, one gzip member a
record, `indexes/index.cdxj`, one line a record, and `datapackage.json`. The reader takes the end of
the file, the central directory and, past 4 GiB or 65,535 members, the ZIP64 records and extra
fields; so it knows where each member's bytes lie in the package. Index lines then give each record's
range, and tasks read these ranges, many neighbours at once; nothing is extracted.

Records with equal payloads are written once: that with the largest page id is the response, the
others are revisits that refer to it and carry its HTTP headers and payload digest, not its bytes.

Packages lie in a folder that all executors share, opened by `pyarrow.fs` (local paths, HDFS, S3, ...).
A task names its packages at random and reports them when they are whole, so those of lost tasks are
never read.

Defined cases: NULL payloads are empty, and empty payloads are equal payloads as any other; rows that
share the largest page id and the payload are all responses; a NULL page id is smaller than any, and
is a response if its payload has no other; a NULL URL becomes a urn of the page; a very long payload
is one record, in memory once; an empty table gives no packages and no rows; other columns are not
read, so they never clash.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zipfile
import zlib
from base64 import b32encode
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha1, sha256
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import map_arrow, map_tables, over_equals, written
from plinth.session import checkpoint_root

# Fixed values of the formats.
ARCHIVES, INDEXES = "archive/", "indexes/"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_END, _LOCATOR, _END64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF

#: Bytes of records after which a package is closed, of one range read, and of one step of a walk.
PACKAGE_BYTES = 256 << 20
RUN_BYTES = 4 << 20
STEP_BYTES = 1 << 20
LEVEL = 3

Read = Callable[[int, int], bytes]


def payload_digest(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


# ---- ZIP packages ----


@dataclass
class Member:
    """A member of a package: its name, how it is stored, and where its local header starts."""

    name: str
    method: int
    flags: int
    packed: int
    size: int
    header: int


def _wide(extra: bytes, size: int, packed: int, header: int) -> tuple[int, int, int]:
    """Sizes and offset with those that do not fit in 32 bits taken from the ZIP64 field, in its order."""
    at = 0
    while at + 4 <= len(extra):
        tag, length = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            values = iter(struct.unpack(f"<{length // 8}Q", extra[at + 4 : at + 4 + length // 8 * 8]))
            size, packed, header = (next(values) if x == _FULL32 else x for x in (size, packed, header))
        at += 4 + length
    return size, packed, header


def directory(read: Read, size: int) -> list[Member]:
    """The members of a ZIP file of `size` bytes, from its central directory."""
    begin = max(0, size - (22 + _FULL16))
    tail = read(begin, size - begin)
    at = tail.rfind(_END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP file")
    disk, first, _, count, length, offset, _ = struct.unpack_from("<4H2LH", tail, at + 4)
    end = begin + at
    wide = _FULL16 in (disk, first, count) or _FULL32 in (length, offset)
    locator = read(end - 20, 20) if wide and end >= 20 else b""
    if locator[:4] == _LOCATOR:
        place = struct.unpack_from("<Q", locator, 8)[0]
        # Bytes in front of the archive move everything: the record may lie just before its locator instead.
        record = read(place, 56)
        if record[:4] != _END64:
            place = end - 20 - 56
            record = read(place, 56)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 end of a central directory where its locator points")
        disk, first, _, count, length, offset = struct.unpack_from("<2L4Q", record, 16)
        end = place
    if disk or first:
        raise ValueError("ZIP files over several disks are not read")
    shift = end - length - offset
    body, members, at = read(offset + shift, length), [], 0
    for _ in range(count):
        if body[at : at + 4] != _ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<2H", body, at + 8)
        packed, whole, names, extras, notes = struct.unpack_from("<2L3H", body, at + 20)
        header = struct.unpack_from("<L", body, at + 42)[0]
        name = body[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra = body[at + 46 + names : at + 46 + names + extras]
        whole, packed, header = _wide(extra, whole, packed, header)
        members.append(Member(name, method, flags, packed, whole, header + shift))
        at += 46 + names + extras + notes
    return members


def data_offset(read: Read, member: Member) -> int:
    """Where the bytes of a member start; its local header may be longer than its entry in the directory."""
    head = read(member.header, 30)
    if head[:4] != _LOCAL:
        raise ValueError(f"no local header of {member.name}")
    names, extras = struct.unpack_from("<2H", head, 26)
    return member.header + 30 + names + extras


def stored_offset(read: Read, member: Member) -> int:
    if member.method or member.flags & 1:
        raise ValueError(f"{member.name} is not a stored member, so its records have no ranges")
    return data_offset(read, member)


def content(read: Read, member: Member) -> bytes:
    """A small member as a whole, stored or deflated."""
    if member.flags & 1 or member.method not in (0, 8):
        raise ValueError(f"{member.name} is encrypted or packed in another way")
    data = read(data_offset(read, member), member.packed)
    return zlib.decompress(data, -15) if member.method else data


def walk(read: Read, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each gzip member in a range, for archives without an index."""
    at = begin = start
    machine, rest = zlib.decompressobj(31), b""
    while at < start + size or rest:
        if not rest:
            rest = read(at, min(STEP_BYTES, start + size - at))
            at += len(rest)
        machine.decompress(rest)
        rest = machine.unused_data
        if machine.eof:
            yield begin - start, at - len(rest) - begin
            begin, machine = at - len(rest), zlib.decompressobj(31)
    if begin != start + size:
        raise ValueError("archive ends within a record")


def package_records(read: Read, size: int) -> Iterator[tuple[str, int, int]]:
    """Archive member, offset in the package and length of every record of a package."""
    members = {m.name: m for m in directory(read, size)}
    archives = {n.removeprefix(ARCHIVES): stored_offset(read, m) for n, m in members.items() if n.startswith(ARCHIVES) and n.endswith(".warc.gz")}
    listed: set[str] = set()
    for name, member in members.items():
        if name.startswith(INDEXES) and name.endswith(".cdxj"):
            for line in content(read, member).splitlines():
                entry = json.loads(line[line.index(b"{") :])
                listed.add(entry["filename"])
                yield entry["filename"], archives[entry["filename"]] + int(entry["offset"]), int(entry["length"])
    for name in archives.keys() - listed:
        for offset, length in walk(read, archives[name], members[ARCHIVES + name].packed):
            yield name, archives[name] + offset, length


# ---- WARC records ----


def _clean(value: str) -> str:
    """A header value without control characters and spaces."""
    return quote(value, safe="".join(map(chr, range(33, 127))))


def sort_key(url: str) -> str:
    """The host turned round, then the path: neighbours of one site lie together in the index."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "") if host else url


def record(page: str | None, url: str | None, payload: bytes | None, digest: str, size: int, refers: str | None) -> bytes:
    """One WARC record, as a response or, without payload, as a revisit of `refers`."""
    name = lambda p: f"<urn:page:{quote(p, safe='')}>" if p is not None else "<urn:page>"
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url) if url else name(page)[1:-1]}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers)}"]
    body = http + (payload or b"")
    head.append(f"Content-Length: {len(body)}")
    machine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return machine.compress("\r\n".join(head).encode() + b"\r\n\r\n") + machine.compress(body) + machine.compress(b"\r\n\r\n") + machine.flush()


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _page(record_id: str | None) -> str | None:
    """The page of a record id that `record` made."""
    from urllib.parse import unquote

    found = re.fullmatch("<urn:page:(.*)>", record_id or "")
    return unquote(found[1]) if found else None


def parsed(packed: bytes) -> dict:
    """Type, ids, URI, digest, size and payload of one packed record. A response must match its digest."""
    data = zlib.decompress(packed, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response" and digest != payload_digest(payload):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return {
        "record_type": fields["warc-type"], "page": _page(fields["warc-record-id"]), "refers": _page(fields.get("warc-refers-to")),
        "url": fields.get("warc-target-uri"), "digest": digest, "payload": payload,
        # A revisit keeps the headers of the response it stands for, so also the length.
        "size": int(_fields(http)["content-length"]) if fields["warc-type"] == "revisit" else len(payload),
    }


# ---- Spark jobs ----


class Package:
    """A package that is being written, front to back."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, inner = opened(self.path)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.file = system.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVES + "data.warc.gz"), "w", force_zip64=True)
        self.size, self.hash, self.lines = 0, sha256(), []

    def add(self, packed: bytes, url: str, kind: str, digest: str) -> None:
        self.archive.write(packed)
        self.hash.update(packed)
        entry = {"url": url, "mime": "warc/revisit" if kind == "revisit" else "text/html", "status": "200", "digest": f"sha1:{digest}", "length": str(len(packed)), "offset": str(self.size), "filename": "data.warc.gz"}
        self.lines.append(f"{_clean(sort_key(url))} {re.sub('[^0-9]', '', DATE)} {json.dumps(entry)}\n")
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.archive.close()
        index = "".join(sorted(self.lines)).encode()
        self.zip.writestr(INDEXES + "index.cdxj", index)
        resources = [
            {"name": name.rsplit("/", 1)[1], "path": name, "hash": f"sha256:{digest}", "bytes": size}
            for name, digest, size in ((ARCHIVES + "data.warc.gz", self.hash.hexdigest(), self.size), (INDEXES + "index.cdxj", sha256(index).hexdigest(), len(index)))
        ]
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": resources}))
        self.zip.close()
        self.file.close()
        return self.path, len(self.lines), self.size


def with_responses(pages: DataFrame) -> DataFrame:
    """page, url, payload and, for revisits, `refers`: the largest page id of the same payload."""
    keyed = pages.select("page_id", "url", "payload", F.unhex(F.sha2("payload", 256)).alias("same"))
    found = over_equals(keyed.select("page_id", "same"), "same", "page_id", most=(F.max, "page_id"))
    other = found.where("most is not null and not (page_id <=> most)")
    # Rows equal in page and payload have one answer. Only revisits are joined back.
    refers = written(other.groupBy("same", "page_id").agg(F.first("most").alias("refers")))
    refers = refers.select(F.col("same").alias("_same"), F.col("page_id").alias("_page"), "refers")
    joined = keyed.join(refers, (F.col("same") == F.col("_same")) & F.col("page_id").eqNullSafe(F.col("_page")), "left")
    return joined.select("page_id", "url", "payload", "refers")


def pack(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Packages of all rows of page_id, url, payload (binary): path, n_records, n_bytes; written as the job runs."""
    source = with_responses(pages).select(F.col("page_id").cast("string").alias("page"), F.col("url").cast("string").alias("url"), "payload", F.col("refers").cast("string").alias("refers"))

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        package, done = None, []
        for rows in tables:
            for page, url, payload, refers in zip(*(rows[c] for c in ("page", "url", "payload", "refers"))):
                page, url, payload, refers = page.as_py(), url.as_py(), payload.as_py(), refers.as_py()
                package = package or Package(folder)
                digest, kind = payload_digest(payload), "response" if refers is None else "revisit"
                packed = record(page, url, payload if refers is None else None, digest, len(payload), refers)
                package.add(packed, url or f"urn:page:{page or ''}", kind, digest)
                if package.size >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            path, records, size = zip(*done)
            yield pa.table({"path": pa.array(path), "n_records": pa.array(records, pa.int64()), "n_bytes": pa.array(size, pa.int64())})

    return written(map_tables(source, run, "path string, n_records bigint, n_bytes bigint"))


def _reader(path: str):
    system, inner = opened(path)
    return system.open_input_file(inner)


def locate(packages: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Runs of neighbouring records: path, start, and the offset and length of each record in the package."""
    tasks = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for path in rows["path"].to_pylist():
            with _reader(path) as file:
                found = sorted(package_records(lambda at, n: file.read_at(n, at), file.size()), key=lambda r: r[1])
            part: list[dict] = []
            for _, offset, length in found:
                if part and offset + length - part[0]["offset"] > run_bytes:
                    out.append((path, part[0]["offset"], part))
                    part = []
                part.append({"offset": offset, "length": length})
            if part:
                out.append((path, part[0]["offset"], part))
        columns = list(zip(*out)) or [(), (), ()]
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
        return pa.table([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], kind)], names=["path", "start", "records"])

    # One row a package: dealt by path, so that tasks share the directories.
    return map_arrow(packages.select("path").repartition(tasks, "path"), run, "path string, start bigint, records array<struct<offset:bigint,length:bigint>>")


def records(packages: DataFrame, payload: bool = True, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Every record of the packages: path, record_offset, page, record_type, refers, url, digest, size and, if wanted, payload."""
    tasks = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts, numbers = ["page", "record_type", "refers", "url", "digest"], ["size"]

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in tables:
            for path, start, found in zip(*(rows[c].to_pylist() for c in ("path", "start", "records"))):
                with _reader(path) as file:
                    data = memoryview(file.read_at(max(r["offset"] + r["length"] for r in found) - start, start))
                got = [parsed(data[r["offset"] - start : r["offset"] - start + r["length"]]) for r in found]
                columns = {"path": pa.array([path] * len(got), pa.string()), "record_offset": pa.array([r["offset"] for r in found], pa.int64())}
                columns |= {c: pa.array([g[c] for g in got], pa.string()) for c in texts} | {c: pa.array([g[c] for g in got], pa.int64()) for c in numbers}
                yield pa.table(columns | ({"payload": pa.array([g["payload"] for g in got], pa.binary())} if payload else {}))

    schema = "path string, record_offset bigint, " + ", ".join(f"{c} string" for c in texts) + ", size bigint" + (", payload binary" if payload else "")
    return map_tables(locate(packages, run_bytes).repartition(tasks, "path", "start"), run, schema)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Pages written to packages and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    kind = source.schema["page_id"].dataType
    folder = folder or f"{checkpoint_root(pages.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    found = records(pack(source, folder), payload=False)
    return found.select(
        F.col("page").cast(kind).alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", F.col("refers").cast(kind).alias("refers_to"),
    )
