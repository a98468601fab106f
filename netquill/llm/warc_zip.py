"""WARC records in ZIP-packaged archives: write, and read by range without extracting.

A package is a ZIP file whose members are *stored*: ``archive/data.warc.gz`` (a gzip member for each record) and
``indexes/index.cdxj`` (offset, length and page of each record). The reader finds the end record at the file's
end, follows the ZIP64 locator where there is one, parses the central directory, finds where each member's data
begin from its local header, and then reads single records by their place in the file.

Of records with equal payloads of at least ``least`` bytes that with the smallest page identifier is a response,
the others are revisits that refer to it and carry no payload. The packages go to the cluster's shared folder
under a name of the task attempt's own; only those that a finished task has reported are read back.

Cases: a null page is an empty payload; a null url is left out, control characters in a url are percent-encoded;
rows whose identifier equals the response's are responses too; a row without identifier is a revisit if its group
has one with; payload bytes are kept as they are; an empty table gives no package and an empty table; only the
named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.llm.common import materialize, scratch, shared

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PACKAGE_BYTES = 256 << 20
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122


# --- records


def _record_id(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page}')}>"


def record(page, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A gzipped WARC record; ``refers_to``: the response's page for a revisit, else None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {json.dumps(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page: {json.dumps(page)}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def parse(data: bytes) -> dict:
    """The record in one gzip member: its WARC headers, its HTTP headers and its payload (None for a revisit)."""
    z = zlib.decompressobj(31)
    raw = z.decompress(data) + z.flush()
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not z.eof:
        raise ValueError("not a WARC record")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    if len(block) != int(warc["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("WARC record of another length than its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"warc": warc, "http": _headers(http), "payload": None if warc["warc-type"] == "revisit" else payload}


# --- ZIP directories


class ZipMembers:
    """The members of a ZIP file of ``size`` bytes that ``read(offset, length)`` gives parts of."""

    def __init__(self, size: int, read: Callable[[int, int], bytes]):
        self.read = read
        tail = read(max(0, size - 65_557), min(size, 65_557))
        at = len(tail)
        while (at := tail.rfind(b"PK\x05\x06", 0, at)) >= 0:
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
        if at < 0:
            raise ValueError("no end of central directory")
        entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
        end = size - len(tail) + at
        if end >= 20 and (where := read(end - 20, 20)).startswith(b"PK\x06\x07"):
            z64 = read(struct.unpack_from("<Q", where, 8)[0], 56)
            if not z64.startswith(b"PK\x06\x06"):
                raise ValueError("no ZIP64 end of central directory where its locator says")
            entries, length, offset = struct.unpack_from("<QQQ", z64, 32)
        self.members = dict(self._directory(read(offset, length), entries))

    @staticmethod
    def _directory(raw: bytes, entries: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        at = 0
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
            offset = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while k + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, k)
                if kind == 1:  # ZIP64: those of the sizes and the offset that don't fit, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                k += 4 + n
            if method == 0 and not flags & 1:  # only what is stored and not encrypted can be read by range
                yield name, (offset, packed, plain)
            at += 46 + n_name + n_extra + n_comment

    def place(self, name: str) -> tuple[int, int]:
        """Where in the file the data of a stored member begin, and their length."""
        if name not in self.members:
            raise ValueError(f"no stored member {name}")
        offset, packed, _ = self.members[name]
        local = self.read(offset, 30)
        if not local.startswith(b"PK\x03\x04"):
            raise ValueError("no local header where the directory says")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return offset + 30 + n_name + n_extra, packed


# --- packages


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Package:
    """A package being written; the stream isn't sought in, so sizes follow the data and the directory is ZIP64-ready."""

    def __init__(self, uri: str):
        self.uri = uri
        fs, path = _filesystem(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.raw = fs.open_output_stream(path, compression=None)
        self.zip = zipfile.ZipFile(_Sink(self.raw), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, page, data: bytes) -> None:
        self.data.write(data)
        self.index.append(f"{self.at} {len(data)} {json.dumps(page)}")
        self.at += len(data)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(INDEX, "".join(x + "\n" for x in self.index))
        self.zip.close()
        self.raw.close()
        return self.uri, len(self.index), self.at


class _Sink:
    """What zipfile needs of a stream that can't be sought."""

    def __init__(self, raw):
        self.write, self.flush = raw.write, raw.flush


def records_of(uri: str) -> Iterator[dict]:
    """Every record that a package's index lists, each read by its range."""
    fs, path = _filesystem(uri)
    with fs.open_input_file(path) as f:
        members = ZipMembers(f.size(), lambda offset, length: f.read_at(length, offset))
        begin, _ = members.place(DATA)
        at, n = members.place(INDEX)
        for line in f.read_at(n, at).decode().splitlines():
            offset, length, _ = line.split(" ", 2)
            yield parse(f.read_at(int(length), begin + int(offset)))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write the rows' records to packages in the shared folder; (path, records, bytes, id_kind) of each package."""
    spark = pages.sparkSession
    p = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    twice = p.where(F.col("size") >= least).groupBy("digest").agg(F.min("page").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keep")
    p = p.join(shared(materialize(twice, "warc-twice")), "digest", "left").select("page", "url", "payload", "digest", F.when(~F.col("page").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers"))
    to = scratch(spark, "warc")

    def run(batches):
        task, k, package = TaskContext.get(), 0, None
        for batch in batches:
            done = []
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is None:
                    package, k = Package(f"{to}/{task.partitionId():06d}-{task.taskAttemptId()}-{k}.wacz"), k + 1
                package.add(page, record(page, url, payload, digest, refers))
                if package.at >= package_bytes:
                    done, package = [*done, package.close()], None
            yield _manifest(done)
        if package is not None:
            yield _manifest([package.close()])

    whole = pages.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    return materialize(p.mapInArrow(run, "path string, records long, bytes long").withColumn("id_kind", F.lit("long" if whole else "string")), "warc-manifest")


def _manifest(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["path", "records", "bytes"])


def read(spark: SparkSession, manifest: DataFrame, id_kind: str | None = None, id_col: str = "page_id") -> DataFrame:
    """(id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record; the digest of a response is
    computed from what was read and must be that of its header. ``manifest``: has a column path and, unless ``id_kind`` (long or
    string) is given, one that says which identifiers are."""
    if id_kind is None:
        first = manifest.select("id_kind").first()
        id_kind = first[0] if first else "long"
    kind = pa.int64() if id_kind == "long" else pa.string()

    def batch_of(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [kind, pa.string(), pa.int64(), pa.string(), pa.string(), kind, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [id_col, "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                for r in records_of(uri):
                    warc, payload = r["warc"], r["payload"]
                    digest = warc["warc-payload-digest"].removeprefix("sha256:")
                    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{uri}: a payload of another digest than its header says")
                    size = int(r["http"]["content-length"]) if payload is None else len(payload)
                    refers = warc.get("x-refers-to-page")
                    rows.append((json.loads(warc["x-page"]), warc.get("warc-target-uri"), size, digest, warc["warc-type"], json.loads(refers) if refers else None, payload))
                    held += size
                    if held >= 4 << 20 or len(rows) >= 1000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    sql = "long" if kind == pa.int64() else "string"
    paths = manifest.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(run, f"`{id_col}` {sql}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {sql}, payload binary")
