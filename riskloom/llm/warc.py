"""Web archives (WARC 1.1): a writer and a reader that salvages damaged files.

The writer makes a gzip member per record and bundles members into files of
bounded size through Spark's own text writer, so any file system that Spark
reaches will do.  The reader checks gzip checksums, lengths, block and payload
digests.  Where a check fails it searches for the next place at which a member
or a version line begins and that passes the checks, goes on there, and logs
the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import fresh, new_path, slices, sole

BUNDLE_BYTES = 16 << 20
FEED = 1 << 14
# A member that inflates to more is taken as damaged: its records up to there are returned, the rest is a gap.
MOST_INFLATED = 1 << 30
# The end of a header is searched for in so many bytes, then, if these begin with a version line, in all that follow.
FIRST_TRY, VERSION_LINE = 1 << 16, 64
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, VERSION, CRLF, END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n", b"\r\n\r\n"
_NEXT = re.compile(re.escape(MAGIC) + b"|" + re.escape(VERSION))


def digest32(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, uri: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC record; a revisit, without the payload, where `refers_to` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if uri is not None:
        fields.insert(2, ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    return b"WARC/1.1\r\n" + head + CRLF + block + END


def member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(Exception):
    pass


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at `at` and where it ends; Damaged if a check fails."""
    if not data.startswith(VERSION, at):
        raise Damaged("no version line")
    stop = data.find(END, at, at + FIRST_TRY)
    if stop < 0 and data.find(CRLF, at, at + VERSION_LINE) >= 0:  # a url may be of any length, a version line not
        stop = data.find(END, at + FIRST_TRY - len(END) + 1)
    if stop < 0:
        raise Damaged("no end of header")
    fields: dict[str, str] = {}
    for line in data[at:stop].split(CRLF)[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "surrogateescape")
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Damaged("no content length")
    first, last = stop + 4, stop + 4 + int(size)
    if data[last : last + 4] != END:
        raise Damaged("record cut short or wrong length")
    block = data[first:last]
    said = fields.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != digest32(block):
        raise Damaged("block digest differs")
    head, mark, payload = block.partition(END)
    if not mark:
        head, payload = b"", block
    said, kind = fields.get("warc-payload-digest", ""), fields.get("warc-type", "")
    if kind == "revisit":
        found = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        n = int(found[1]) if found else 0
    else:
        n = len(payload)
        if said.startswith("sha1:") and said[5:] != digest32(payload):
            raise Damaged("payload digest differs")
    ident = lambda s: m[1] if (m := re.fullmatch(r"<urn:page:(.*)>", s or "")) else s
    return {"record_type": kind, "page_id": ident(fields.get("warc-record-id")), "refers_to": ident(fields.get("warc-refers-to")), "uri": fields.get("warc-target-uri"), "payload_digest": said.removeprefix("sha1:") or digest32(payload), "payload_bytes": n, "payload": payload}, last + 4


def inflate(data: memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member that begins at `at`, and where it ends."""
    z, out, pos, size = zlib.decompressobj(31), [], at, 0
    try:
        while not z.eof:
            if pos >= len(data):
                raise Damaged("member cut short")
            part = data[pos : pos + FEED]
            out.append(z.decompress(part))
            pos, size = pos + len(part), size + len(out[-1])
            if size > MOST_INFLATED:
                raise Damaged(f"member inflates to more than {MOST_INFLATED} bytes")
    except zlib.error as e:
        raise Damaged(f"member: {e}") from None
    return b"".join(out), pos - len(z.unused_data)


def rescue(data: memoryview, at: int, most: int | None = None) -> tuple[bytes, int]:
    """What the failed member at `at` gives before it fails, or its first `most` bytes, and where what gives them ends."""
    z, out, size, pos, step = zlib.decompressobj(31), [], 0, at, FEED
    while pos < len(data) and not z.eof and (size < most if most is not None else size <= MOST_INFLATED):
        before = z.copy() if step > 1 else None
        try:
            got = z.decompress(data[pos : pos + step])
        except zlib.error:
            got = None
        if step > 1 and (got is None or (most is not None and size + len(got) >= most)):
            z, step = before, 1  # the last part byte by byte
            continue
        if got is None:
            break
        out.append(got)
        size, pos = size + len(got), pos + step
    return b"".join(out), min(pos, len(data))


def _records(inner: bytes) -> tuple[list[dict], int, list[str]]:
    """The good records in a member's bytes, where the last one ends, and what is wrong with which of its bytes."""
    found, last, faults, pos = [], 0, [], 0
    while pos < len(inner):
        try:
            rec, pos = parse(inner, pos)
            found.append(rec)
            last = pos
        except Damaged as e:  # in the member, the next version line that passes the checks goes on
            first, why = pos, str(e)
            while (pos := inner.find(VERSION, pos + 1)) >= 0:
                try:
                    parse(inner, pos)
                    break
                except Damaged:
                    pass
            pos = pos if pos >= 0 else len(inner)
            faults.append(f"{why}: {pos - first} bytes from {first} on in the member")
    return found, last, faults


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(offset, length, record, None) of each good record and (offset, length, None, reason) of each gap.

    The records of one member share its offset and length.  Zeros and line
    ends between members are padding.  A member that holds damaged records
    gives its other records and a gap each for the damaged ones, whose reason says which of its bytes it is.  So does a member that fails, as far
    as it can be decompressed; its records' length goes to the end of the last one, and the
    rest is a gap of its own.  No digest covers such a record's header, as in a plain archive:
    a gap at a record's offset says so.
    """
    view, at, gap, why = memoryview(data), 0, -1, None
    while at < len(data):
        if data[at] in b"\x00\r\n" and gap < 0:
            at += 1
            continue
        found, faults = [], []
        try:
            if data.startswith(MAGIC, at):
                inner, end = inflate(view, at)
                found, _, faults = _records(inner)
            else:
                rec, end = parse(data, at)
                found.append(rec)
        except Damaged as e:
            start = at + 1
            if data.startswith(MAGIC, at):
                found, last, _ = _records(rescue(view, at)[0])
            if found:  # what gave these records is done with; the rest of the member is a gap too
                start = rescue(view, at, last)[1]
                if gap >= 0:
                    yield gap, at - gap, None, why
                yield at, start - at, None, str(e)
                for rec in found:
                    yield at, start - at, rec, None
                gap, why = start, str(e)
            elif gap < 0:
                gap, why = at, str(e)
            nxt = _NEXT.search(data, start)
            at = nxt.start() if nxt else len(data)
            if at == gap:
                gap = -1
            continue
        if gap >= 0:
            yield gap, at - gap, None, why
            gap = -1
        for fault in faults:
            yield at, end - at, None, fault
        for rec in found:
            yield at, end - at, rec, None
        at = end
    if gap >= 0:
        yield gap, len(data) - gap, None, why


def write_archive(df: DataFrame, path: str, id_col: str, uri_col: str, payload_col: str, refers_col: str, bundle: int = BUNDLE_BYTES) -> None:
    """Write a record per row to gzip archives of about `bundle` bytes or one record each.

    Spark's text writer puts a separator after each value; it is a zero byte, which takes
    the place of a last zero of the bundle's own trailer or pads it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole()
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            data = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([data[:-1] if data.endswith(b"\x00") else data], pa.binary())], names=["data"])

        for part in slices(batches, payload_col):
            cols = [part.column(c).to_pylist() for c in (id_col, uri_col, payload_col, refers_col)]
            for i, uri, payload, refers in zip(*cols):
                held.append(member(record(i, uri, (payload or "").encode("utf-8", "surrogatepass"), refers)))
                size += len(held[-1])
                if size >= bundle:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    rows = df.select(id_col, uri_col, payload_col, refers_col).mapInArrow(run, "data binary")
    rows.select(F.col("data").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


READ_SCHEMA = "archive string, offset long, length long, reason string, record_type string, page_id string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary"


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record, and a row with a reason and no record type per quarantined gap."""
    names = [f.name for f in T.StructType.fromDDL(READ_SCHEMA)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, data = batch.column("path")[k].as_py(), batch.column("content")[k].as_py()
                rows = []
                for offset, length, rec, reason in salvage(data):
                    row = {"archive": name, "offset": offset, "length": length, "reason": reason} | (rec or {})
                    if not payloads:
                        row.pop("payload", None)
                    rows.append(row)
                cols = zip(names, (pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in cols], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, READ_SCHEMA)


def revisits(df: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """All columns of `df` and the id that a row's record refers to: null for a response.

    Of equal payloads of at least `least_bytes` bytes, the one with the
    largest id is the response.  Rows that repeat that id and payload are responses too.
    """
    refers, digest, r_id, r_digest = fresh(df, "refers_to", "digest", "r_id", "r_digest")
    raw = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keyed = df.withColumn(digest, F.sha1(raw))
    ids = keyed.where(F.octet_length(raw) >= least_bytes).select(F.col(id_col).alias(r_id), F.col(digest).alias(r_digest))
    top = ids.groupBy(r_digest).agg(F.max(r_id).alias(refers), F.count("*").alias("n")).where("n > 1").drop("n")
    later = ids.join(top, r_digest).where(F.coalesce(F.col(r_id) < F.col(refers), F.col(refers).isNotNull())).distinct()
    return keyed.join(later, F.col(id_col).eqNullSafe(F.col(r_id)) & (F.col(digest) == F.col(r_digest)), "left").select(*df.columns, refers)


def archive_pages(df: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Archive a row each under `path` (by default in the shared folder) and read all back.

    Returns the rows of `read_archive` without payloads.  Null payloads
    are empty, and empty payloads are equal; a null id is written as an empty
    one; repeated rows are written as often as they occur; further columns, whatever their names,
    are ignored; urls and payloads of any length are whole (a record of more than MOST_INFLATED bytes is read as a gap);
    an empty table gives an archive without records.
    """
    spark = df.sparkSession
    path = path or new_path(spark, "warc")
    pages = df.select(id_col, uri_col, payload_col)
    rows = revisits(pages, id_col, payload_col, least_bytes)
    write_archive(rows, path, id_col, uri_col, payload_col, rows.columns[-1])
    return read_archive(spark, path, payloads=False)
