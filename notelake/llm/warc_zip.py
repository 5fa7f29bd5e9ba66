"""Web archives packed in ZIP files: writing, and reading by ranges without extraction.

An archive holds stored (uncompressed) members: WARC data below ``archive/``, whose records may be
gzip members of their own, and CDXJ indexes below ``indexes/``, which name each record's member and
place. The reader parses the central directory, in its ZIP64 form where present, finds the data and
index members in it, and reads only the byte ranges of the records it wants.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .store import materialize, new_path

#: Members that the writer makes. The reader takes whatever members the patterns below find.
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
IS_DATA, IS_INDEX = re.compile(r"(?:^|/)archive/.*\.warc(?:\.gz)?$"), re.compile(r"(?:^|/)indexes/.*\.(?:cdxj?|idx)(?:\.gz)?$")
#: Payloads under so many bytes are never replaced by a revisit record.
LEAST_REVISIT = 100
ARCHIVE_BYTES, READ_BYTES = 32_000_000, 4_000_000
MOST_TASKS = 10_000
EPOCH = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = StructType([StructField("archive", StringType()), StructField("records", LongType()), StructField("bytes", LongType())])
RECORDS = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("record_type", StringType()), StructField("payload", BinaryType()), StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()), StructField("refers_to", LongType())])


# --- records ------------------------------------------------------------------------------


def surt(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then the path; "-" for none."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)(?::\d+)?([^#]*)", (url or "").strip().lower())
    if not m or not m[1]:
        return "-"
    return re.sub(r"\s", "%20", f"{','.join(reversed(m[1].removeprefix('www.').split('.')))}){m[2] or '/'}")


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, record_id: str | None = None) -> bytes:
    """One WARC record: a response with the payload, or a revisit with its HTTP header only.

    Record ids are unique, also where page ids are null or repeat; page ids travel in fields of their own.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{record_id or uuid.uuid4()}>", f"WARC-Date: {EPOCH}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c >= " " else f"%{ord(c):02X}" for c in url))
    block = http + payload
    if refers_to is not None:
        lines += [f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
        block = http
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.lstrip("-").isdigit() else None


def _content_length(head: bytes) -> int:
    """Bytes of the block after a record's header."""
    found = _number(_headers(head.split(b"\r\n")[1:]).get("content-length"))
    if found is None or found < 0:
        raise ValueError("a record without content-length")
    return found


def parse_record(record: bytes) -> dict:
    """Fields of one uncompressed WARC record, of any type and writer; fields it doesn't have are null."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    own = _headers(lines)
    for needed in ("content-length", "warc-type"):
        if needed not in own:
            raise ValueError(f"a record without {needed}")
    block = rest[: int(own["content-length"])]
    http: dict[str, str] = {}
    if own.get("content-type", "").startswith("application/http"):
        head, _, block = block.partition(b"\r\n\r\n")
        http = _headers(head.split(b"\r\n")[1:])
    revisit = own["warc-type"] == "revisit"
    size = _number(http.get("content-length")) if revisit else len(block)
    return {
        "page_id": _number(own.get("x-page-id")),
        "record_type": own["warc-type"],
        "payload": None if revisit else block,
        "payload_bytes": size,
        "payload_digest": own["warc-payload-digest"].rpartition(":")[2] if "warc-payload-digest" in own else None,
        "refers_to": _number(own.get("x-refers-to-page-id")),
        "url": own.get("warc-target-uri"),
    }


# --- archives -----------------------------------------------------------------------------


class ArchiveWriter:
    """Streams records into one archive; nothing but the index is held."""

    def __init__(self, uri: str, zip64: bool = True) -> None:
        self.uri, self.zip64 = uri, zip64
        self.system, path = fs.FileSystem.from_uri(uri)
        self.system.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = self.system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self._member(DATA)
        self.index: list[str] = []
        self.space = uuid.uuid4()
        self.records = self.bytes = 0

    def _member(self, name: str):
        return self.zip.open(zipfile.ZipInfo(name), "w", force_zip64=self.zip64)

    def next_id(self) -> str:
        return str(uuid.uuid5(self.space, str(self.records)))

    def add(self, page_id: int | None, url: str | None, record: bytes) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.data.write(packed)
        entry = {"url": url, "offset": str(self.bytes), "length": str(len(packed)), "filename": DATA.rpartition("/")[2], "page_id": page_id}
        self.index.append(f"{surt(url)} {re.sub(r'[^0-9]', '', EPOCH)} {json.dumps(entry)}\n")
        self.records += 1
        self.bytes += len(packed)

    def close(self) -> None:
        self.data.close()
        for name, content in ((INDEX, "".join(sorted(self.index)).encode()), (PACKAGE, json.dumps({"profile": "data-package", "records": self.records}).encode())):
            with self._member(name) as member:
                member.write(content)
        self.zip.close()
        self.sink.close()


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


class ArchiveReader:
    """Directory and byte ranges of a ZIP file at a URI, or of any file opened for random access."""

    def __init__(self, source) -> None:
        if isinstance(source, str):
            system, path = fs.FileSystem.from_uri(source)
            source = system.open_input_file(path)
        self.file = source
        self.members = {m.name: m for m in self._directory()}

    def close(self) -> None:
        self.file.close()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the archive is cut short")
        return data

    def _directory(self) -> Iterator[Member]:
        size = self.file.size() if callable(getattr(self.file, "size", None)) else self.file.seek(0, 2)
        tail = self._read(max(0, size - 65_557), min(size, 65_557))
        at = tail.rfind(b"PK\5\6")
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
            at = tail.rfind(b"PK\5\6", 0, at)  # the signature may also occur in a comment
        if at < 0:
            raise ValueError("not a ZIP file: it has no end of central directory")
        entries, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        end = size - len(tail) + at
        if end >= 20 and (locator := self._read(end - 20, 20))[:4] == b"PK\6\7":
            record = self._read(struct.unpack("<Q", locator[8:16])[0], 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("the ZIP64 locator points to no directory record")
            entries, length, start = struct.unpack("<QQQ", record[32:56])
        data, pos = self._read(start, length), 0
        for _ in range(entries):
            if data[pos : pos + 4] != b"PK\1\2":
                raise ValueError("the central directory is damaged")
            method = int.from_bytes(data[pos + 10 : pos + 12], "little")
            packed, full = struct.unpack("<II", data[pos + 20 : pos + 28])
            name_n, extra_n, comment_n = struct.unpack("<HHH", data[pos + 28 : pos + 34])
            header = int.from_bytes(data[pos + 42 : pos + 46], "little")
            name = data[pos + 46 : pos + 46 + name_n].decode("utf-8", "replace")
            extra, pos = data[pos + 46 + name_n : pos + 46 + name_n + extra_n], pos + 46 + name_n + extra_n + comment_n
            while len(extra) >= 4:
                tag, n = struct.unpack("<HH", extra[:4])
                if tag == 1:  # ZIP64: values in this order, each only where the 32-bit field is full
                    values = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    full = next(values) if full == 0xFFFFFFFF else full
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    header = next(values) if header == 0xFFFFFFFF else header
                extra = extra[4 + n :]
            yield Member(name, method, packed, header)

    def start(self, member: Member) -> int:
        """Offset of a stored member's first byte."""
        if member.method != 0:
            raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
        head = self._read(member.header, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"{member.name} has no local header")
        return member.header + 30 + sum(struct.unpack("<HH", head[26:30]))

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        """A range of a stored member."""
        member = self.members[name]
        n = member.size - at if n is None else n
        if at < 0 or n < 0 or at + n > member.size:
            raise ValueError(f"the range lies outside {name}")
        return self._read(self.start(member) + at, n)

    def _data_member(self, filename: str | None) -> str:
        """The member that an index entry means: by full name, by its end, or the only one."""
        names = [n for n in self.members if IS_DATA.search(n)]
        found = [n for n in names if filename is None or n == filename or n.endswith("/" + filename)]
        if len(found) != 1:
            raise ValueError(f"the index names {filename}, which is {'no member' if not found else 'more than one member'}")
        return found[0]

    def index(self) -> list[dict]:
        """Records' places (member, offset, length, url, page_id), by member and offset.

        They come from all index members (CDXJ lines, gzipped or not); an archive without any is
        walked through record by record.
        """
        entries, indexes = [], [n for n in self.members if IS_INDEX.search(n)]
        for name in indexes:
            data = self.read(name)
            for line in (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).splitlines():
                at = line.find(b"{")
                if at < 0:
                    continue
                own = json.loads(line[at:])
                if "offset" not in own or "length" not in own:  # a line of a compressed index's summary
                    continue
                page_id = own.get("page_id")
                entries.append({"member": self._data_member(own.get("filename")), "offset": int(own["offset"]), "length": int(own["length"]), "url": own.get("url"), "page_id": page_id})
        if not indexes:
            entries = [e for n in sorted(self.members) if IS_DATA.search(n) for e in self._walk(n)]
        return sorted(entries, key=lambda e: (e["member"], e["offset"], e.get("inside", 0)))

    def _walk(self, name: str) -> Iterator[dict]:
        """Places of all records of a data member, found by reading it once in ranges.

        A gzip member may hold one record or many; of many, ``inside`` tells each one's place in it.
        """
        size, at = self.members[name].size, 0
        while at < size:
            if name.endswith(".gz"):
                inside = []
                for begin, record, end in self._unpacked(name, at, keep=False):
                    inside.append((begin, record))
                own = {"member": name, "offset": at, "length": end - at, "url": None, "page_id": None}
                yield from ([own] if len(inside) == 1 else [own | {"inside": begin} for begin, _ in inside])
            else:
                head, pos = b"", at
                while b"\r\n\r\n" not in head:
                    if pos >= size:
                        raise ValueError(f"{name} ends within a record")
                    part = self.read(name, pos, min(65_536, size - pos))
                    head, pos = head + part, pos + len(part)
                start = head.index(b"\r\n\r\n") + 4
                end = min(size, at + start + _content_length(head[:start]) + 4)
                yield {"member": name, "offset": at, "length": end - at, "url": None, "page_id": None}
            at = end

    def _unpacked(self, name: str, at: int, keep: bool = True) -> Iterator[tuple[int, bytes, int]]:
        """(place inside, record, end of the gzip member) of the records of the gzip member at ``at``, unpacked bit by bit.

        Without ``keep`` the records are left empty, so memory is that of one range. The end is right with the last one.
        """
        size, pos, unpack = self.members[name].size, at, zlib.decompressobj(31)
        held, begin, needed, inside = b"", 0, 0, False  # of the present record: what is held, its place, what is missing, whether its header is through
        found: list[tuple[int, bytes]] = []
        while not unpack.eof:
            if pos >= size:
                raise ValueError(f"{name} ends within a record")
            part = self.read(name, pos, min(READ_BYTES if keep else 1_000_000, size - pos))
            pos += len(part)
            held += unpack.decompress(part)
            while True:
                if not inside:
                    stop = held.find(b"\r\n\r\n")
                    if stop < 0:
                        break
                    needed, inside = stop + 4 + _content_length(held[: stop + 4]) + 4, True
                    total = needed
                if keep and len(held) < needed:
                    break
                if not keep and len(held) < needed:  # only its length counts
                    needed, held = needed - len(held), b""
                    break
                found.append((begin, held[:needed] if keep else b""))
                held, begin, inside = held[needed:], begin + total, False
            if not unpack.eof:
                yield from ((*f, pos) for f in found[:-1])
                found = found[-1:]
        end = pos - len(unpack.unused_data)
        if inside and needed <= 4:  # the last record may lack the lines after it
            found.append((begin, b""))
        elif inside and keep and len(held) >= needed - 4:
            found.append((begin, held))
        elif inside or held.strip():
            raise ValueError(f"{name} ends within a record")
        yield from ((*f, end) for f in found)

    def records(self, entries: list[dict] | None = None, most: int = READ_BYTES) -> Iterator[dict]:
        """The records of index entries (all, if not given); neighbours are read together, up to ``most`` bytes."""
        entries = self.index() if entries is None else entries
        at = 0
        while at < len(entries):
            first, end, upto = entries[at], entries[at]["offset"] + entries[at]["length"], at + 1
            if "inside" in first:  # records of one gzip member, which is unpacked once for all of them that are asked for
                while upto < len(entries) and (entries[upto]["member"], entries[upto]["offset"]) == (first["member"], first["offset"]):
                    upto += 1
                wanted = {e["inside"]: e for e in entries[at:upto]}
                for begin, record, _ in self._unpacked(first["member"], first["offset"]):
                    if begin in wanted:
                        own = parse_record(record)
                        yield own | {"url": own["url"] if wanted[begin]["url"] is None else wanted[begin]["url"]}
                at = upto
                continue
            while upto < len(entries) and (entries[upto]["member"], entries[upto]["offset"]) == (first["member"], end) and end + entries[upto]["length"] - first["offset"] <= most:
                end += entries[upto]["length"]
                upto += 1
            data = self.read(first["member"], first["offset"], end - first["offset"])
            for e in entries[at:upto]:
                begin = e["offset"] - first["offset"]
                record = data[begin : begin + e["length"]]
                own = parse_record(zlib.decompress(record, 31) if record[:2] == b"\x1f\x8b" else record)
                yield own | {"url": e["url"] if e["url"] is not None else own["url"]}
            at = upto


# --- tables -------------------------------------------------------------------------------


def _with_revisits(pages: DataFrame, least: int) -> DataFrame:
    """Add refers_to: the smallest id with the same payload, for rows with a larger one and enough bytes."""
    keyed = materialize(pages.select("page_id", "digest", F.octet_length("payload").alias("n")).filter((F.col("n") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest"), "digests")
    firsts = materialize(keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").select("digest", "first"), "firsts")
    again = materialize(keyed.join(firsts, "digest").filter("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct(), "revisits")
    # merged at every size: the table of revisits grows with the input
    return pages.join(again.hint("merge"), ["page_id", "digest"], "left")


def write_archives(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, least_revisit: int = LEAST_REVISIT, zip64: bool = True) -> DataFrame:
    """Write a WARC record per row into archives below ``folder``; returns the manifest (archive, records, bytes).

    The payload is the html in UTF-8, empty for null. Of records with equal payloads of at least
    ``least_revisit`` bytes the one with the smallest id is a response and the others revisit it; rows
    that repeat that smallest id are all responses. A null id is always a response. Archives end at
    ``archive_bytes``. Every attempt of a task writes files of its own and the manifest names those of
    the attempt that Spark committed, so lost executors leave unused files but no wrong ones. ``folder``
    must be a URI that all executors reach; by default it lies in the shared folder. An empty table
    gives an empty manifest. A task holds one payload of a batch at a time besides the index of its
    archive, so very long payloads are bounded by the memory of one. Other columns are never read.
    """
    target = folder or new_path(df.sparkSession, "archives")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    arrow = to_arrow_schema(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, written = None, []

        def close() -> None:
            writer.close()
            written.append({"archive": writer.uri, "records": writer.records, "bytes": writer.bytes})

        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "payload", "digest", "refers_to")]
            for k in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[k].as_py() for c in columns)
                writer = writer or ArchiveWriter(f"{target}/{uuid.uuid4().hex}.zip", zip64)
                writer.add(page_id, url, build_record(page_id, url, payload, digest, refers_to, writer.next_id()))
                if writer.bytes >= archive_bytes:
                    close()
                    writer = None
        if writer:
            close()
        yield pa.RecordBatch.from_pylist(written, schema=arrow)

    return materialize(_with_revisits(pages, least_revisit).mapInArrow(run, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, wanted: Callable[[dict], bool] | None = None) -> DataFrame:
    """The records of the archives that column ``archive`` names, read in place.

    ``wanted`` picks index entries (member, offset, length, url, page_id); other records are never read.
    Archives of other writers can be read too: members are found in the directory, and what their
    records don't tell is null.
    Columns: page_id, url, record_type, payload (null for revisits), payload_bytes and
    payload_digest (both of the full payload), refers_to.
    """
    arrow = to_arrow_schema(RECORDS)
    archives = manifest.select("archive").distinct()
    tasks = max(1, min(archives.count(), MOST_TASKS))  # a stated number, as so small a table would else become one task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                reader = ArchiveReader(uri)
                held, size = [], 0
                for record in reader.records([e for e in reader.index() if wanted is None or wanted(e)]):
                    held.append(record)
                    size += len(record["payload"] or b"")
                    if size >= READ_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
                reader.close()
                yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return archives.repartition(tasks, "archive").mapInArrow(run, RECORDS)
