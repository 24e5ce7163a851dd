"""Legacy web archives to WARC.

An ARC file starts with a version block, ``filedesc://name ip date type length``
and, in it, the version number and the names of the fields in every header
line: five of them in version 1, ten in version 2.  A record is a header line,
the declared number of bytes and a line feed.  Records are compressed one by
one, so that a file can be read from any of them.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import again, committed, file_system, pick, scratch, stored, table

#: Fixed by the ARC file format: the names in the version block and their order.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
LENGTH = "Archive-length"
#: Fixed by the WARC format: what a record that repeats a payload declares.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "19700101000000"
#: Payload bytes after which a writer begins the next file.
FILE_BYTES = 32 << 20
LEVEL = 1
HERE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the RFC 4122 name space for URLs


class ArcRecord(NamedTuple):
    offset: int
    fields: dict[str, str]
    content: bytes


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _squeeze(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream: BinaryIO, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member, one in memory at a time."""
    at, held, rest = 0, [], b""
    z = zlib.decompressobj(31)
    start = 0
    while True:
        data = rest or stream.read(chunk)
        if not data:
            break
        at += 0 if rest else len(data)
        held.append(z.decompress(data))
        rest = b""
        if z.eof:
            rest = z.unused_data
            yield start, b"".join(held)
            start = at - len(rest)
            held, z = [], zlib.decompressobj(31)
    if held and any(held):
        raise ValueError("the last record is cut off")


def inflated(stream: BinaryIO, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a plain file, or of all members of a gzip file, a piece at a time."""
    data = stream.read(chunk)
    if not data.startswith(b"\x1f\x8b"):
        while data:
            yield data
            data = stream.read(chunk)
        return
    z, begun = zlib.decompressobj(31), False
    while data or begun:
        out = z.decompress(data, chunk)
        if out:
            yield out
        if not (data or out or z.eof):
            raise ValueError("the last member is cut off")
        data, begun = (z.unused_data, False) if z.eof else (z.unconsumed_tail, True)
        if not begun:
            z = zlib.decompressobj(31)
        data = data or stream.read(chunk)


def arc_header(version: int, url: str, date: str, kind: str, length: int, name: str, offset: int) -> bytes:
    """A header line; white space inside a field would split it, so it is escaped."""
    url = "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url) or "-"
    if version == 1:
        return f"{url} 0.0.0.0 {date} {kind} {length}\n".encode()
    return f"{url} 0.0.0.0 {date} {kind} 200 - - {offset} {name} {length}\n".encode()


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 crawl\n{ARC_FIELDS[version]}\n".encode()
    if version == 1:
        return f"filedesc://{name} 0.0.0.0 {EPOCH} text/plain {len(body)}\n".encode() + body + b"\n"
    return f"filedesc://{name} 0.0.0.0 {EPOCH} text/plain 200 - - 0 {name} {len(body)}\n".encode() + body + b"\n"


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """Records of an ARC file of either version, the version block left out.

    The version block names the fields of the header lines; these and the
    declared lengths say where records are, so that it makes no difference how
    the file is compressed.  Bytes that are no record are an error.  Offsets
    count uncompressed bytes.
    """
    names: list[str] | None = None
    chunks, held, offset = inflated(stream), bytearray(), 0

    def more() -> bool:
        held.extend(got := next(chunks, b""))
        return bool(got)

    while True:
        while held[:1] in (b"\n", b"\r") or not held and more():
            n = next((i for i, c in enumerate(held) if c not in b"\r\n"), len(held))
            del held[:n]
            offset += n
            if n == 0:
                break
        if not held:
            return
        while (end := held.find(b"\n")) < 0:
            if not more():
                raise ValueError(f"bytes at {offset} are no record")
        fields = held[:end].decode().rstrip("\r").split(" ")
        where = -1 if names is None else names.index(LENGTH)
        if names is not None and len(fields) != len(names):
            raise ValueError(f"record at {offset} has {len(fields)} header fields, not {len(names)}")
        if not fields[where].isdecimal():
            raise ValueError(f"bytes at {offset} are no record")
        length, place = int(fields[where]), offset
        while len(held) < end + 1 + length:
            if not more():
                raise ValueError(f"record at {place} declares {length} bytes and has {len(held) - end - 1}")
        content = bytes(held[end + 1 : end + 1 + length])
        del held[: end + 1 + length]
        offset += end + 1 + length
        if names is None:
            if not fields[0].startswith("filedesc://"):
                raise ValueError("no version block")
            version, declared = int(content.split(b" ", 1)[0]), content.decode().split("\n")[1:2]
            # The block names the fields of every header line; one that doesn't has those of its version.
            names = (declared[0].strip() if declared and LENGTH in declared[0].split() else ARC_FIELDS[version]).split()
            continue
        yield ArcRecord(place, dict(zip(names, fields, strict=True)), content)


def http_parts(content: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head with its blank line, payload, and header fields; without a head all is payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content, {}
    head, blank, payload = content.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return head + blank, payload, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def warc_date(arc: str) -> str:
    """A 14-digit ARC date (12 digits and unreadable ones too) as WARC writes it."""
    try:
        at = datetime.datetime.strptime(arc.ljust(14, "0")[:14], "%Y%m%d%H%M%S")
    except ValueError:
        at = datetime.datetime(1970, 1, 1)
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(arc_path: str, offset: int) -> str:
    """Same file and place, same identifier: a repeated attempt changes nothing."""
    return f"<urn:uuid:{uuid.uuid5(HERE, f'{arc_path.rpartition("/")[2]}#{offset}')}>"


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return _squeeze(head.encode() + block + b"\r\n\r\n")


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    for offset, data in members(stream):
        head, _, rest = data.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {offset}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        yield fields, rest[: int(fields["content-length"])]


def write_arc(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", date_column: str | None = None) -> DataFrame:
    """Pages as ARC files, versions 1 and 2 by turns; returns ``path, records``, a row a file.

    A null payload is empty and a null URL is ``-``.  The page's id (none if
    null) is a field of the archived HTTP head.  ``date_column`` has the time
    of capture (UTC); without one, and for nulls, it is the epoch.
    """
    rows = pick(pages, page_id=id_column, url=url_column, html=html_column, **({"at": date_column} if date_column else {}))
    at = F.date_format(F.to_utc_timestamp(F.col("at").cast("timestamp"), F.current_timezone()), "yyyyMMddHHmmss") if date_column else F.lit(None).cast("string")
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"), F.coalesce(at, F.lit(EPOCH)).alias("at"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        pages = ((b.column("page_id")[i].as_py(), b.column("url")[i].as_py(), b.column("payload")[i].as_py(), b.column("at")[i].as_py()) for b in batches for i in range(b.num_rows))
        page = next(pages, None)
        while page is not None:
            version, name = 1 + (part + k) % 2, f"part-{part:06d}-{k:05d}.arc.gz"
            at = records = held = 0
            with committed(f"{folder}/{name}") as out:
                data = _squeeze(arc_version_block(version, name))
                out.write(data)
                at += len(data)
                while page is not None and held < FILE_BYTES:
                    page_id, url, payload, date = page
                    mark = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
                    content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + mark + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
                    data = _squeeze(arc_header(version, url, date, "text/html", len(content), name, at) + content + b"\n")
                    out.write(data)
                    at, records, held = at + len(data), records + 1, held + len(payload)
                    page = next(pages, None)
            k += 1
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [records]})

    return stored(rows.mapInArrow(write, "path string, records long"), "arc-files")


def _tasks(files: DataFrame) -> int:
    """As many tasks as files; files have bounded sizes."""
    return max(1, min(files.count(), 50_000))


def _spread(files: DataFrame) -> DataFrame:
    """A task for each file, as far as hashing allows."""
    return files.select("path").repartition(_tasks(files), "path")


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows, or none, as a batch of a schema of longs and strings."""
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.record_batch([pa.array(c, pa.int64() if t == "long" else pa.string()) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def convert(files: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """ARC files (``path``) as WARC files; returns ``path, records``, a row a file.

    The first pass parses every record and takes the digest of its payload.
    Of records with equal payloads of at least ``min_payload`` bytes, the one
    with the smallest page id (a null id comes last, then by file and place)
    is a response, the others revisit it.  The second pass reads each ARC file
    once more and writes its records in order; an archive without records
    becomes one with the description of the file alone.
    """
    schema = "path string, offset long, page_id long, bytes long, digest string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, p = file_system(path)
                rows = []
                with files.open_input_stream(p, compression=None) as f:
                    for r in read_arc(f):
                        _, payload, head = http_parts(r.content)
                        page = head.get("x-page-id")
                        rows.append((path, r.offset, None if page is None else int(page), len(payload), digest(payload)))
                yield _columns(rows, schema)

    parsed = stored(_spread(files).mapInArrow(parse, schema), "arc-records")
    rank = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "path", "offset")
    firsts = parsed.filter(F.col("bytes") >= min_payload).groupBy("digest", "bytes").agg(F.min(rank).alias("first"))
    firsts = firsts.select("digest", again("bytes").alias("bytes"), F.col("first.path").alias("to_path"), F.col("first.offset").alias("to_offset"), F.col("first.page_id").alias("to_page"))
    plan = parsed.join(firsts, ["digest", "bytes"], "left").select("path", "offset", "digest", "to_path", "to_offset", "to_page")

    def write(key: tuple, plan: pa.Table) -> pa.Table:
        path = key[0].as_py()
        names = ("offset", "digest", "to_path", "to_offset", "to_page")
        todo = {o: rest for o, *rest in zip(*(plan.column(c).to_pylist() for c in names), strict=True)}
        name = path.rpartition("/")[2].replace(".arc.gz", ".warc.gz")
        files, p = file_system(path)
        n = 0
        with files.open_input_stream(p, compression=None) as f, committed(f"{folder}/{name}") as out:
            info = f"software: arc converter\r\nformat: WARC File Format 1.1\r\nconverted-from: {path.rpartition('/')[2]}\r\n".encode()
            out.write(warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(path, -1), "WARC-Date": warc_date(EPOCH), "WARC-Filename": name, "Content-Type": "application/warc-fields"}, info))
            for r in read_arc(f):
                head, payload, _ = http_parts(r.content)
                sha, to_path, to_offset, to_page = todo[r.offset]
                same = to_path is None or (to_path, to_offset) == (path, r.offset)
                fields = {"WARC-Type": "response" if same else "revisit", "WARC-Record-ID": record_id(path, r.offset), "WARC-Date": warc_date(r.fields["Archive-date"]), "WARC-Target-URI": r.fields["URL"], "WARC-IP-Address": r.fields["IP-address"], "WARC-Payload-Digest": f"sha1:{sha}"}
                block = r.content if same else head
                fields |= {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response" if head else r.fields["Content-type"]}
                if not same:
                    fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(to_path, to_offset)}
                    if to_page is not None:
                        fields["X-Refers-To-Page-Id"] = str(to_page)
                out.write(warc_record(fields, block))
                n += 1
        return pa.table({"path": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})

    # The plan is light, the files behind it are not: a task for each file, not for so many bytes of plan.
    # A file without records has a row too.
    plan = files.select("path").join(plan, "path", "left").repartition(_tasks(files), "path")
    return stored(plan.groupBy("path").applyInArrow(write, "path string, records long"), "warc-files")


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, target_uri string, warc_date string"


def read_archives(files: DataFrame) -> DataFrame:
    """A row for each response and revisit record of WARC files (``path``).

    Length and digest are those of the full payload: a response is measured
    and must agree with its declared digest, a revisit declares both.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, p = file_system(path)
                rows = []
                with files.open_input_stream(p, compression=None) as f:
                    for fields, block in read_warc(f):
                        if fields["warc-type"] not in ("response", "revisit"):
                            continue
                        _, payload, head = http_parts(block)
                        sha = fields["warc-payload-digest"].removeprefix("sha1:")
                        n = len(payload)
                        if fields["warc-type"] == "revisit":
                            n = int(head["content-length"])
                        elif digest(payload) != sha:
                            raise ValueError(f"a payload in {path} differs from its digest")
                        number = [int(x) if x is not None else None for x in (head.get("x-page-id"), fields.get("x-refers-to-page-id"))]
                        rows.append((number[0], n, sha, fields["warc-type"], number[1], fields["warc-record-id"], fields.get("warc-refers-to"), fields["warc-target-uri"], fields["warc-date"]))
                yield _columns(rows, READ_SCHEMA)

    return _spread(files).mapInArrow(read, READ_SCHEMA)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, converted and read back.

    Null payloads are empty; empty payloads repeat each other as any others do.
    Very long ones are taken whole, one in memory at a time.  A null page id
    stays null.  Repeated ids keep their rows.  No pages, no files, no rows.
    Other columns are ignored.
    """
    arcs = write_arc(table(spark, sf_dir, "pages"), scratch(spark, "arc"))
    records = read_archives(convert(arcs, scratch(spark, "warc")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
