"""WARC records in ZIP-packaged archives: written by Spark tasks, read back in ranges without extraction.

An archive is a ZIP file with stored members below ``archive/`` (one gzip member for each record) and indexes below
``indexes/`` (CDXJ: a line for each record with its key, its time and, in JSON, the file, the offset and the length). The
reader parses the end record, its ZIP64 form and the central directory, reads every index that the directory lists
(stored or deflated, gzipped or not), follows the file names in it, and reads each record as one range of its member.

Defined cases: a null payload is empty; payloads shorter than ``least`` bytes are all responses; of equal longer
payloads every row with the largest id is a response (repeated rows: each of them), the others revisit it; a null id
never is the largest unless all are null, and then all are responses; a null url is the empty string, and urls are percent-encoded where
needed; an empty table
gives no archive and an empty result. Of packages made elsewhere all records that an index names are read; those without a
page id of ours have none. A task that fails and runs again writes archives of new names; only those of the
attempt that Spark keeps are in the manifest.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zipfile
import zlib
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialise, small_batches, spread

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE, STAMP = "1970-01-01T00:00:00Z", "19700101000000"
#: Where members of a package lie, and the endings of indexes (fixed values).
ARCHIVES, INDEXES, INDEX_ENDS = "archive/", "indexes/", (".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")
#: Bytes of record data after which a task starts another archive.
ARCHIVE_BYTES = 16 << 20

#: Layouts of the ZIP format (fixed values).
END, END_SIZE = b"PK\x05\x06", 22
END64, LOCATOR64, LOCATOR64_SIZE = b"PK\x06\x06", b"PK\x06\x07", 20
CENTRAL, CENTRAL_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
STORED, DEFLATED = 0, 8


def encoded(url: str) -> str:
    """The url with spaces, control and non-ASCII characters percent-encoded."""
    return quote(url, safe="".join(map(chr, range(0x21, 0x7F))), errors="replace")


def _headers(first: str, pairs: list[tuple[str, object]]) -> bytes:
    return ("\r\n".join([first, *[f"{k}: {v}" for k, v in pairs if v is not None]]) + "\r\n\r\n").encode("utf-8")


def record(page_id, url: str, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """A response, or a revisit (no payload; the HTTP headers tell its length) if ``refers_to`` is given."""
    http = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)])
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = _headers("WARC/1.1", [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", encoded(url)), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", f"<urn:page:{refers_to}>" if revisit else None),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block)),
    ])
    return gzip.compress(head + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(data: bytes) -> dict:
    """Headers (lower-cased names), HTTP headers and payload of one record, gzipped or plain."""
    raw = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    payload, own = rest[: int(headers["content-length"])], {}
    if headers.get("content-type", "").startswith("application/http"):
        http, _, payload = payload.partition(b"\r\n\r\n")
        own = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode("utf-8", "replace").split("\r\n")[1:])}
    return {"headers": headers, "http": own, "payload": payload}


def _name(urn: str | None) -> int | None:
    body = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(body) if body.lstrip("-").isdigit() else None


class ZipPackage:
    """Access to the members of a ZIP file that can be read in ranges: stored ones at any place, deflated ones as a whole."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        self.members = {}
        for name, method, length, offset in self._directory(size):
            if method in (STORED, DEFLATED):
                self.members[name] = (offset, length, method)

    def _range(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(size)
        if len(data) < size:
            raise ValueError("the archive ends early")
        return data

    def _directory(self, size: int):
        tail_size = min(size, END_SIZE + FULL16)
        tail = self._range(size - tail_size, tail_size)
        at = tail.rfind(END)
        if at < 0:
            raise ValueError("no end record: this isn't a ZIP file")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if FULL16 == count or FULL32 in (length, start):
            spot = size - tail_size + at - LOCATOR64_SIZE
            locator = self._range(spot, LOCATOR64_SIZE)
            if locator[:4] != LOCATOR64:
                raise ValueError("the ZIP64 locator is missing")
            end = self._range(struct.unpack("<Q", locator[8:16])[0], 56)
            if end[:4] != END64:
                raise ValueError("the ZIP64 end record is missing")
            count, length, start = struct.unpack("<QQQ", end[32:56])
        directory, at = self._range(start, length), 0
        for _ in range(count):
            if directory[at : at + 4] != CENTRAL:
                raise ValueError("the central directory is damaged")
            method = struct.unpack("<H", directory[at + 10 : at + 12])[0]
            packed, full = struct.unpack("<II", directory[at + 20 : at + 28])
            name_size, extra_size, comment_size = struct.unpack("<HHH", directory[at + 28 : at + 34])
            offset = struct.unpack("<I", directory[at + 42 : at + 46])[0]
            name = directory[at + CENTRAL_SIZE : at + CENTRAL_SIZE + name_size].decode("utf-8")
            extra = directory[at + CENTRAL_SIZE + name_size :][:extra_size]
            while len(extra) >= 4:
                kind, n = struct.unpack("<HH", extra[:4])
                if kind == 1:  # 64-bit values of the fields that are full, in this order
                    wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    full = wide.pop(0) if full == FULL32 else full
                    packed = wide.pop(0) if packed == FULL32 else packed
                    offset = wide.pop(0) if offset == FULL32 else offset
                extra = extra[4 + n :]
            yield name, method, packed, offset
            at += CENTRAL_SIZE + name_size + extra_size + comment_size

    def start(self, name: str) -> int:
        """Where the member's data begins."""
        offset = self.members[name][0]
        local = self._range(offset, LOCAL_SIZE)
        if local[:4] != LOCAL:
            raise ValueError("the local header is damaged")
        return offset + LOCAL_SIZE + sum(struct.unpack("<HH", local[26:30]))

    def read(self, name: str) -> bytes:
        data = self._range(self.start(name), self.members[name][1])
        return zlib.decompress(data, -15) if self.members[name][2] == DEFLATED else data

    def ranges(self, name: str, places):
        """The bytes of each (offset, length) within a stored member."""
        start, (_, size, method) = self.start(name), self.members[name]
        if method != STORED:
            raise ValueError("the member isn't stored: it can't be read in ranges")
        for offset, length in places:
            if offset + length > size:
                raise ValueError("a record lies outside its member")
            yield self._range(start + offset, length)

    def index(self) -> dict[str, list[tuple[int, int]]]:
        """(offset, length) of every record that the indexes name, by member; records named twice are read once."""
        places: dict[str, dict[tuple[int, int], None]] = {}
        for name in sorted(n for n in self.members if n.startswith(INDEXES) and n.endswith(INDEX_ENDS)):
            data = self.read(name)
            for line in (zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data).decode("utf-8").split("\n"):
                if " {" in line:
                    own = json.loads(line[line.index(" {") + 1 :])
                    file = own["filename"]
                    member = file if file in self.members else ARCHIVES + file.rsplit("/", 1)[-1]
                    places.setdefault(member, {})[int(own["offset"]), int(own["length"])] = None
        return {member: list(own) for member, own in places.items()}


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """``page_id, url, payload, size, digest, refers_to``: a page refers to the largest id with its payload, if that isn't its own."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    keepers = own.filter(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = own.join(spread(keepers), "digest", "left")
    refers = F.when((F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "size", "digest", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write what ``classify`` returns; the manifest ``path, records, bytes`` is materialised before it is returned."""

    def write(batches):
        filesystem, base = arrow_fs.FileSystem.from_uri(folder)
        data, index = io.BytesIO(), []

        def finish() -> pd.DataFrame:
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_STORED) as z:
                z.writestr(zipfile.ZipInfo(DATA), data.getvalue())
                z.writestr(zipfile.ZipInfo(INDEX), "".join(index))
            name = f"{uuid.uuid4().hex}.wacz"
            filesystem.create_dir(base, recursive=True)
            with filesystem.open_output_stream(f"{base}/{name}") as out:
                out.write(packed.getbuffer())
            row = pd.DataFrame({"path": [f"{folder}/{name}"], "records": [len(index)], "bytes": [packed.tell()]})
            data.seek(0)
            data.truncate()
            index.clear()
            return row

        for pdf in batches:
            refers = pdf["refers_to"].astype("Int64")
            ids = pdf["page_id"].astype("Int64")
            for page_id, url, payload, size, digest, to in zip(ids, pdf["url"], pdf["payload"], pdf["size"], pdf["digest"], refers, strict=True):
                own_id = None if page_id is pd.NA else int(page_id)
                packed = record(own_id, url, payload, int(size), digest, None if to is pd.NA else int(to))
                where = {"url": encoded(url), "digest": f"sha1:{digest}", "length": str(len(packed)), "offset": str(data.tell()), "filename": DATA.removeprefix(ARCHIVES)}
                index.append(f"{encoded(url) or '-'} {STAMP} {json.dumps(where)}\n")
                data.write(packed)
                if data.tell() >= archive_bytes:
                    yield finish()
        if index:
            yield finish()

    return materialise(small_batches(records).mapInPandas(write, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives in ``path``: ``page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to``.

    ``payload`` is null for revisits; their length and digest are those of the payload that they refer to.
    """

    def read(batches):
        for pdf in batches:
            for path in pdf["path"]:
                filesystem, name = arrow_fs.FileSystem.from_uri(path)
                with filesystem.open_input_file(name) as source:
                    package = ZipPackage(source, source.size())
                    rows = []
                    for member, places in package.index().items():
                        for data in package.ranges(member, places):
                            rec = parse_record(data)
                            head, revisit = rec["headers"], rec["headers"]["warc-type"] == "revisit"
                            size = int(rec["http"].get("content-length", len(rec["payload"])))
                            rows.append((_name(head.get("warc-record-id")), head.get("warc-target-uri", ""), head["warc-type"], None if revisit else rec["payload"], size, head.get("warc-payload-digest", "").removeprefix("sha1:"), _name(head.get("warc-refers-to"))))
                            if len(rows) == 500:
                                yield _frame(rows)
                                rows = []
                    if rows:
                        yield _frame(rows)

    count = manifest.count()
    return manifest.repartition(max(1, min(count, 20_000))).mapInPandas(read, SCHEMA)


SCHEMA = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    for c in ("page_id", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def archive_folder(spark) -> str:
    return fresh_path(spark, "warc")
