"""WARC archives: a writer of gzip members, and a reader that salvages what a damaged file still holds.

Every record is one gzip member.  The reader walks from member to member (or from version line to version
line in plain files).  Where a record fails a check, it searches byte by byte for the next place at which a
whole valid record starts, goes on there and reports the gap.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.store import kept, partitions
from parley.session import work_dir

MAGIC, VERSION, END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
ROLL_BYTES = 32 << 20  # a task starts a new file after this many bytes
STEP = 1 << 14  # bytes read at a time inside a record
SCAN = 1 << 20  # bytes read at a time while searching

GAPS = "file string, start long, end long, reason string"
RECORDS = "file string, start long, end long, type string, headers map<string,string>, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: 5 hexadecimal digits are 4 letters."""
    code = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(code, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def verdicts(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, n, digest, type, refers_to): what each page's record will be.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is the
    response and the others refer to it; repeated rows of that page_id are responses too, as are pages that have
    equals only without a page_id.  Null html is an empty payload.  A revisit carries no payload.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("payload")).withColumns(
        {"n": F.length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    best = rows.filter(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("best"))
    # the same plan at every size: the payloads are dealt by digest, and a hot digest is split by the join
    own = rows.join(best.hint("merge"), ["digest", "n"], "left")
    first = F.col("best").isNull() | F.col("best").eqNullSafe(F.col("page_id"))
    return own.select("page_id", "url", F.when(first, F.col("payload")).alias("payload"), "n", "digest",
                      F.when(first, "response").otherwise("revisit").alias("type"), F.when(~first, F.col("best")).alias("refers_to"))


def _line(value: str) -> bytes:
    return value.replace("\r", "%0D").replace("\n", "%0A").encode()


def record(page: int | None, url: str | None, payload: bytes | None, digest: str, kind: str, refers: int | None) -> bytes:
    """One WARC record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload or b"")
    name = f"urn:page:{page}" if page is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}"
    head = [VERSION + b"1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + name.encode() + b">",
            b"WARC-Date: 1970-01-01T00:00:00Z", b"Content-Type: application/http;msgtype=response",
            b"WARC-Payload-Digest: sha1:" + digest.encode(), b"WARC-Block-Digest: sha1:" + _digest(block).encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _line(url))
    if kind == "revisit":
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(b"WARC-Refers-To: <urn:page:%d>" % refers)
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + END + block + END


def write_archives(rows: DataFrame, folder: str | None = None, level: int = 4) -> DataFrame:
    """Writes the rows of :func:`verdicts` and returns (file, records, bytes) of the files that count.

    Each task writes files of its own name under the shared folder.  Only files named in the returned table,
    which is written by Spark itself, are read later, so what a lost or repeated task left does no harm.
    """
    folder = folder or f"{work_dir(rows.sparkSession)}-warc"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        out, name, count, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [count], "bytes": [size]})

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "type", "refers_to")), strict=True):
                if out is None:
                    name, count, size = f"{folder}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None)
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = member.compress(record(*r)) + member.flush()
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ROLL_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return kept(rows.select("page_id", "url", "payload", "digest", "type", "refers_to").mapInArrow(run, "file string, records long, bytes long"), "archives")


class _Damaged(Exception):
    pass


def _member(f, pos: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``pos``."""
    d, out, p = zlib.decompressobj(31), [], pos
    while not d.eof:
        chunk = f.read_at(STEP, p)
        if not chunk:
            raise _Damaged("the member has no end")
        try:
            out.append(d.decompress(chunk))
        except zlib.error as e:
            raise _Damaged(f"the member is broken: {e}") from None
        p += len(chunk)
    return b"".join(out), p - len(d.unused_data)


def _plain(f, pos: int, size: int) -> tuple[bytes, int]:
    """Bytes and end of the record whose version line is at ``pos``."""
    head, p = b"", pos
    while END not in head:
        chunk = f.read_at(STEP, p)
        if not chunk:
            raise _Damaged("the header has no end")
        head, p = head + chunk, p + len(chunk)
    start = head.index(END) + 4
    stop = pos + start + _length(_headers(head[:start])) + 4
    if stop > size:
        raise _Damaged("the block has no end")
    return f.read_at(stop - pos, pos), stop


def _headers(head: bytes) -> dict[str, str]:
    first, *lines = head.rstrip(b"\r\n").split(b"\r\n")
    if not first.startswith(VERSION):
        raise _Damaged("no version line")
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Damaged("a header line without a colon")
        out[name.decode("utf-8", "replace").strip()] = value.decode("utf-8", "replace").strip()
    return out


def _length(headers: dict[str, str]) -> int:
    n = headers.get("Content-Length", "")
    if not n.isdecimal():
        raise _Damaged("no content length")
    return int(n)


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record that passes all checks."""
    head, found, rest = data.partition(END)
    if not found:
        raise _Damaged("the header has no end")
    headers = _headers(head)
    n = _length(headers)
    block = rest[:n]
    if len(block) < n or rest[n:] != END:
        raise _Damaged("the block does not end where it should")
    if (want := headers.get("WARC-Block-Digest")) and want != f"sha1:{_digest(block)}":
        raise _Damaged("the block digest differs")
    http = headers.get("Content-Type", "").startswith("application/http")
    payload = block.partition(END)[2] if http else block
    kind = headers.get("WARC-Type")
    if kind != "revisit" and (want := headers.get("WARC-Payload-Digest")) and want != f"sha1:{_digest(payload)}":
        raise _Damaged("the payload digest differs")
    return headers, payload


def _at(f, pos: int, size: int) -> tuple[dict[str, str], bytes, int]:
    start = f.read_at(8, pos)
    if start.startswith(MAGIC):
        data, end = _member(f, pos)
    elif start.startswith(VERSION):
        data, end = _plain(f, pos, size)
    else:
        raise _Damaged("neither a member nor a version line")
    return *_parse(data), end


def _next(f, pos: int, size: int) -> int:
    """The next place after ``pos`` where a whole valid record starts, or the end of the file."""
    while pos < size:
        window = f.read_at(SCAN + 8, pos)
        here = sorted(i for mark in (MAGIC, VERSION) for i in _all(window, mark) if i < SCAN)
        for i in here:
            try:
                _at(f, pos + i, size)
            except _Damaged:
                continue
            return pos + i
        pos += SCAN
    return size


def _all(window: bytes, mark: bytes) -> Iterator[int]:
    i = window.find(mark)
    while i >= 0:
        yield i
        i = window.find(mark, i + 1)


def salvage(f, size: int) -> Iterator[tuple]:
    """('record', start, end, headers, payload) and ('gap', start, end, reason) of an open file, in order."""
    pos = 0
    while pos < size:
        try:
            headers, payload, end = _at(f, pos, size)
            yield "record", pos, end, headers, payload
            pos = end
        except _Damaged as e:
            end = _next(f, pos + 1, size)
            yield "gap", pos, end, str(e)
            pos = end


def read_archives(files: DataFrame, payloads: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records and gaps of the archives named in column ``file``.

    Records: (file, start, end, type, headers, payload_bytes, payload_digest, payload); of a revisit the payload
    columns are null and the digest is the one its header names.  Gaps: (file, start, end, reason).  A file is read in
    steps by one task, so memory holds one record; a file that cannot be opened fails the job.
    """
    dealt = files.select("file").repartition(partitions(files.sparkSession), "file")
    schema = f"kind string, {RECORDS}, reason string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        kind = pa.schema([("kind", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()),
                          ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                          ("payload", pa.binary()), ("reason", pa.string())])

        def rows(name: str) -> Iterator[dict]:
            fs, path = pafs.FileSystem.from_uri(name) if ":/" in name else (pafs.LocalFileSystem(), name)
            with fs.open_input_file(path) as f:
                for what, start, end, *more in salvage(f, f.size()):
                    base = {"kind": what, "file": name, "start": start, "end": end}
                    if what == "gap":
                        yield base | {"reason": more[0]}
                        continue
                    headers, payload = more
                    own = headers.get("WARC-Type") != "revisit"
                    named = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                    yield base | {"type": headers.get("WARC-Type"), "headers": list(headers.items()), "payload_bytes": len(payload) if own else None,
                                  "payload_digest": _digest(payload) if own else named, "payload": payload if own and payloads else None}

        for batch in batches:
            for name in batch.column("file").to_pylist():
                held, size = [], 0
                for r in rows(name):
                    held.append(r)
                    size += 500 + len(r.get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, kind)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, kind)

    all_ = dealt.mapInArrow(run, schema)
    return all_.filter("kind = 'record'").drop("kind", "reason"), all_.filter("kind = 'gap'").select("file", "start", "end", "reason")


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records that pages were written as.

    A revisit's size is that of the response it refers to.
    """
    number = lambda h: F.regexp_extract(F.col("headers")[h], r"<urn:page:(-?\d+)>", 1)
    rows = records.select(
        F.when(number("WARC-Record-ID") != "", number("WARC-Record-ID").cast("long")).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", number("WARC-Refers-To").cast("long")).alias("refers_to"))
    full = rows.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("full"))
    return rows.join(full, "payload_digest", "left").select(
        "page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
