"""Web archives packaged in ZIP files, read by ranges.

An archive is a ZIP file with WARC members under ``archive/`` and CDXJ members
under ``indexes/`` that give records' members, offsets and lengths.  The reader
parses the end record, the ZIP64 locator and end record where there are any, and
the central directory with its ZIP64 fields; finds the data of the stored
members; reads the indexes; and then each task reads ranges of records, several
neighbours at once, and unpacks only those.  Nothing is extracted.  The ranges
are spread over as many tasks as their bytes ask for.

Records of stored members may be gzipped one by one or plain.  What no index
entry covers is walked: gzip members by unpacking them, plain records by their
headers.  A member that the ZIP itself compresses has no ranges; one task
unpacks it as a stream and takes its records one after the other.

Every record of every type comes with its type, date and headers.  Of a response
the body is that of the message, without chunked transfer encoding and without
gzip or deflate content encoding; other content encodings stay as they are.

Defined cases: indexes may be stored, deflated or gzipped; an empty archive gives
no records; an index entry that lies outside its member, or damage of any kind,
raises ValueError.  The writer keeps null ids, urls and texts apart from empty
ones, writes repeated rows as records of their own, and ignores extra columns; an
empty table gives archives without records.
"""

from __future__ import annotations

import functools
import gzip
import json
import math
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import col
from .storage import new_path, written

READ = "path string, member string, id string, url string, type string, date string, headers map<string, string>, nulls string, body binary"
RANGE, TASK = 4 << 20, 32 << 20
_END, _LOCATOR, _END64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
ReadAt = Callable[[int, int], bytes]


def _sound(f):
    """What a damaged archive raises becomes ValueError."""
    if "Iterator" in str(f.__annotations__.get("return")):

        @functools.wraps(f)
        def each(*args):
            try:
                yield from f(*args)
            except (struct.error, KeyError, IndexError, TypeError, zlib.error, gzip.BadGzipFile, EOFError) as e:
                raise ValueError(f"damaged archive: {e!r}") from e

        return each

    @functools.wraps(f)
    def once(*args):
        try:
            return f(*args)
        except (struct.error, KeyError, IndexError, TypeError, zlib.error, gzip.BadGzipFile, EOFError) as e:
            raise ValueError(f"damaged archive: {e!r}") from e

    return once


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or of an absolute path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


@_sound
def directory(read_at: ReadAt, size: int) -> list[tuple[str, int, int, int, int]]:
    """Name, method, offset of the local header, stored size and full size of each member."""
    tail_at = max(0, size - 65557)
    tail = read_at(tail_at, size - tail_at)
    k = tail.rfind(_END)
    while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
        k = tail.rfind(_END, 0, k)
    if k < 0:
        raise ValueError("no end record: not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, k + 10)
    at = tail_at + k
    if at >= 20 and (locator := read_at(at - 20, 20))[:4] == _LOCATOR:
        end64 = struct.unpack_from("<Q", locator, 8)[0]
        head = read_at(end64, 56)
        if head[:4] != _END64:
            raise ValueError("the ZIP64 locator points nowhere")
        count, length, start = struct.unpack_from("<QQQ", head, 32)
    data = read_at(start, length)
    out, p = [], 0
    for _ in range(count):
        if data[p : p + 4] != _CENTRAL:
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", data, p + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, p + 20)
        header = struct.unpack_from("<I", data, p + 42)[0]
        name = data[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        q, end = p + 46 + n_name, p + 46 + n_name + n_extra
        while q + 4 <= end:
            tag, n = struct.unpack_from("<HH", data, q)
            if tag == 1:  # in this order, and only the fields that don't fit above
                r = q + 4
                if full == 0xFFFFFFFF:
                    full, r = struct.unpack_from("<Q", data, r)[0], r + 8
                if packed == 0xFFFFFFFF:
                    packed, r = struct.unpack_from("<Q", data, r)[0], r + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", data, r)[0]
            q += 4 + n
        out.append((name, method, header, packed, full))
        p = end + n_comment
    return out


@_sound
def data_offset(read_at: ReadAt, header: int) -> int:
    """Where a member's data begins."""
    local = read_at(header, 30)
    if local[:4] != _LOCAL:
        raise ValueError("a local header is damaged")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return header + 30 + n_name + n_extra


@_sound
def _content(read_at: ReadAt, member: tuple[str, int, int, int, int]) -> bytes:
    name, method, header, packed, _ = member
    raw = read_at(data_offset(read_at, header), packed)
    if method == 8:
        raw = zlib.decompress(raw, -15)
    elif method:
        raise ValueError(f"{name}: compression method {method}")
    return gzip.decompress(raw) if name.endswith(".gz") else raw


@_sound
def walked(read_at: ReadAt, start: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Offset and length of each gzip member in a range."""
    at = begin = 0
    z = zlib.decompressobj(31)
    held = b""
    while at < size or held:
        if not held:
            held = read_at(start + at, min(step, size - at))
            at += len(held)
        z.decompress(held)
        held = z.unused_data
        if z.eof:
            end = at - len(held)
            yield begin, end - begin
            begin, z = end, zlib.decompressobj(31)
        else:
            held = b""
    if begin != size:
        raise ValueError("the last record is cut off")


def walked_plain(read_at: ReadAt, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each plain record in a range."""
    at = 0
    while at < size:
        head, more = b"", 4096
        while b"\r\n\r\n" not in head:
            if len(head) == size - at:
                raise ValueError("the last record is cut off")
            head = read_at(start + at, min(more, size - at))
            more *= 4
        end = head.index(b"\r\n\r\n") + 4
        n = min(end + _content_length(head[: end - 4]) + 4, size - at)
        yield at, n
        at += n


@_sound
def _content_length(head: bytes) -> int:
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            n = int(value)
            if n >= 0:
                return n
    raise ValueError("a record without a length")


@_sound
def located(read_at: ReadAt, size: int) -> Iterator[tuple[str, str, int, int]]:
    """Member, kind (gzip, plain or packed), absolute offset and length of every record of an archive, by offset; a packed member is one range."""
    members = [m for m in directory(read_at, size) if m[0].startswith("archive/") and not m[0].endswith("/")]
    known: dict[str, list[tuple[int, int]]] = {}
    for m in directory(read_at, size):
        if m[0].startswith("indexes/") and m[0].endswith((".cdxj", ".cdx", ".cdx.gz", ".cdxj.gz")):
            for line in _content(read_at, m).decode().splitlines():
                if "{" in line:
                    x = json.loads(line[line.index("{") :])
                    known.setdefault(x["filename"], []).append((int(x["offset"]), int(x["length"])))
    for name, method, header, length, full in sorted(members, key=lambda m: m[2]):
        start = data_offset(read_at, header)
        if method == 8:
            yield name, "packed", start, length
            continue
        if method:
            raise ValueError(f"{name}: compression method {method}")
        if length != full or start + length > size:
            raise ValueError(f"{name}: its sizes are wrong")
        gzipped = length > 1 and read_at(start, 2) == b"\x1f\x8b"
        kind, walk, at = ("gzip", walked, 0) if gzipped else ("plain", walked_plain, 0)
        for offset, n in [*sorted(set(known.get(name.split("/", 1)[1], ()))), (length, 0)]:
            if offset < at or n < 0 or offset + n > length:
                raise ValueError(f"{name}: an index entry lies outside")
            if offset > at:  # records that no index names
                for a, k in walk(read_at, start + at, offset - at):
                    yield name, kind, start + at + a, k
            if n:
                yield name, kind, start + offset, n
            at = offset + n


def _plain_stream(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The unpacked bytes of a content that may be a row of gzip members."""
    z, first, gzipped, is_open = zlib.decompressobj(31), b"", None, False
    for piece in pieces:
        if gzipped is None:
            first += piece
            if len(first) < 2:
                continue
            gzipped, piece = first[:2] == b"\x1f\x8b", first
        if not gzipped:
            yield piece
            continue
        while piece:
            yield z.decompress(piece)
            piece, is_open = z.unused_data, not z.eof
            if z.eof:
                z = zlib.decompressobj(31)
    if gzipped is None and first or is_open:
        raise ValueError("the last record is cut off")


@_sound
def streamed(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a member's content, gzipped one by one or plain, from a stream of pieces."""
    held: list[bytes] = []
    size, needed = 0, 0
    for piece in _plain_stream(pieces):
        held.append(piece)
        size += len(piece)
        if size < needed:
            continue
        data, at = b"".join(held), 0
        while True:
            head = data.find(b"\r\n\r\n", at)
            needed = head + 8 + _content_length(data[at:head]) if head >= 0 else 0
            if head < 0 or needed > len(data):
                break
            yield data[at:needed]
            at = needed
        held, size, needed = [data[at:]], len(data) - at, max(0, needed - at)
    rest = b"".join(held)
    if rest.strip(b"\r\n"):
        head = rest.find(b"\r\n\r\n")
        if head < 0 or head + 4 + _content_length(rest[:head]) > len(rest):
            raise ValueError("the last record is cut off")
        yield rest


def _inflated(read_at: ReadAt, start: int, size: int, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a deflated member, piece by piece."""
    z = zlib.decompressobj(-15)
    for at in range(0, size, step):
        data = read_at(start + at, min(step, size - at))
        while data:
            yield z.decompress(data, step)
            data = z.unconsumed_tail
    yield z.flush()
    if not z.eof:
        raise ValueError("a compressed member is cut off")


@_sound
def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and body of an unpacked WARC record; of a response, the body of the message."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    if "content-length" not in headers:
        raise ValueError("a record without a length")
    size = int(headers["content-length"])
    if not 0 <= size <= len(rest):
        raise ValueError("a record is cut off")
    body = rest[:size]
    if headers.get("warc-type") == "response" and body.startswith(b"HTTP/"):
        body = _message(body)
    return headers, body


def _message(response: bytes) -> bytes:
    """The decoded body of an HTTP response."""
    head, _, body = response.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip().lower()
    if "chunked" in fields.get("transfer-encoding", ""):
        out, at = [], 0
        while True:
            line = body.index(b"\r\n", at)
            n = int(body[at:line].split(b";")[0], 16)
            if not n:
                break
            out.append(body[line + 2 : line + 2 + n])
            at = line + 2 + n + 2
        body = b"".join(out)
    for coding in reversed(fields.get("content-encoding", "").replace(" ", "").split(",")):
        if coding in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif coding == "deflate":
            try:
                body = zlib.decompress(body)
            except zlib.error:
                body = zlib.decompress(body, -15)
    return body


def make_record(page_id: object, url: str | None, body: bytes | None) -> bytes:
    """An unpacked WARC resource record."""
    nulls = ",".join(n for n, v in (("id", page_id), ("url", url), ("body", body)) if v is None)
    clean = (url or "").replace("%0A", "%250A").replace("%0D", "%250D").replace("\n", "%0A").replace("\r", "%0D")
    lines = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", "Content-Type: text/html"]
    if nulls:
        lines.append(f"X-Null: {nulls}")
    return "\r\n".join([*lines, f"Content-Length: {len(body or b'')}"]).encode() + b"\r\n\r\n" + (body or b"") + b"\r\n\r\n"


def sort_key(url: str) -> str:
    """The key of a CDXJ line: reversed host and path."""
    try:
        u = urlsplit(url)
        return ",".join(reversed((u.hostname or "").split("."))) + ")" + (u.path or "/").replace(" ", "%20")
    except ValueError:
        return ")"


def _write(folder: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = opened(folder)
        fs.create_dir(base)
        final = f"{base}/part-{task.partitionId():06d}.wacz"
        draft = f"{final}.{task.taskAttemptId()}"
        lines, at = [], 0
        with fs.open_output_stream(draft) as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED) as z:
            with z.open("archive/data.warc.gz", "w", force_zip64=True) as out:
                for batch in batches:
                    for page_id, url, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        packed = gzip.compress(make_record(page_id, url, None if body is None else body.encode()), level, mtime=0)
                        out.write(packed)
                        lines.append(f"{sort_key(url or '')} 20240101000000 " + json.dumps({"url": url, "filename": "data.warc.gz", "offset": str(at), "length": str(len(packed))}))
                        at += len(packed)
            z.writestr("indexes/index.cdxj", "\n".join(sorted(lines)))
        fs.move(draft, final)
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/part-{task.partitionId():06d}.wacz"], "records": pa.array([len(lines)], pa.int64())})

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", level: int = 1) -> list[str]:
    """An archive a partition of ``pages`` in a folder that all executors reach; their paths."""
    rows = pages.select(*(col(c).cast("string").alias(n) for n, c in (("id", id_col), ("url", url_col), ("body", body_col))))
    return sorted(r.path for r in rows.mapInArrow(_write(folder, level), "path string, records long").collect())  # a row a partition


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From paths to ranges of neighbouring records of about ``RANGE`` bytes."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, p = opened(path)
            with fs.open_input_file(p) as f:
                read_at = lambda at, n: f.read_at(n, at)  # noqa: B023, E731
                member, kind, start, sizes, end = "", "", 0, [], -1
                for name, what, offset, n in located(read_at, f.size()):
                    if sizes and (name != member or offset != end or end - start >= RANGE):
                        yield _range_row(path, member, kind, start, sizes)
                        sizes = []
                    if not sizes:
                        member, kind, start = name, what, offset
                    sizes.append(n)
                    end = offset + n
                if sizes:
                    yield _range_row(path, member, kind, start, sizes)


def _range_row(path: str, member: str, kind: str, start: int, sizes: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [path], "member": [member], "kind": [kind], "start": pa.array([start], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64()))})


def _unpacked(x: dict, read_at: ReadAt) -> Iterator[bytes]:
    """The unpacked records of a range."""
    if x["kind"] == "packed":
        yield from streamed(_inflated(read_at, x["start"], x["sizes"][0]))
        return
    data, at = read_at(x["start"], sum(x["sizes"])), 0
    for n in x["sizes"]:
        yield gzip.decompress(data[at : at + n]) if x["kind"] == "gzip" else data[at : at + n]
        at += n


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            fs, p = opened(x["path"])
            with fs.open_input_file(p) as f:
                rows, held = [], 0
                for record in _checked(x, lambda at, n: f.read_at(n, at)):  # noqa: B023
                    headers, body = parse_record(record)
                    page = headers.get("warc-record-id", "").removeprefix("<").removesuffix(">").removeprefix("urn:page:")
                    url = headers.get("warc-target-uri", "").replace("%0A", "\n").replace("%0D", "\r").replace("%250A", "%0A").replace("%250D", "%0D")
                    rows.append((x["path"], x["member"], page, url, headers.get("warc-type"), headers.get("warc-date"), list(headers.items()), headers.get("x-null", ""), body))
                    held += len(body)
                    if held >= RANGE:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)


@_sound
def _checked(x: dict, read_at: ReadAt) -> Iterator[bytes]:
    yield from _unpacked(x, read_at)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]
    names = ["path", "member", "id", "url", "type", "date", "headers", "nulls", "body"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Columns path, member, id, url, type, date, headers, nulls, body of every record; a task reads about ``TASK`` bytes of ranges."""
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 10_000)))
    ranges = written(listed.mapInArrow(_ranges, "path string, member string, kind string, start long, sizes array<long>"), "ranges")
    there = ranges.agg(F.count("*").alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)).alias("bytes")).first()
    tasks = max(1, min(there.n, max(spark.sparkContext.defaultParallelism, math.ceil((there.bytes or 0) / TASK))))
    return ranges.repartition(tasks).mapInArrow(_records, READ)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Pages packed into archives in the shared folder, and all records read back: page_id, url, html."""
    spark = pages.sparkSession
    paths = write_archives(pages, new_path(spark, "wacz"), id_col, url_col, body_col)
    r = read_archives(spark, paths)
    absent = lambda name: F.array_contains(F.split("nulls", ","), name)
    kind = pages.schema[id_col].dataType
    return r.select(
        F.when(~absent("id"), F.col("id").cast(kind)).alias("page_id"),
        F.when(~absent("url"), F.col("url")).alias("url"),
        F.when(~absent("body"), F.col("body").cast("string")).alias("html"),
    )
