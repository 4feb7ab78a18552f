"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Records are gzip members of their own. The reader checks every member, header, length and digest.
After a failed check it looks for the next member or version line that is valid, goes on there and
reports the bytes in between as a gap. It does the same inside a member that holds several records,
and keeps what a damaged member still gives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litvec.llm.common import text_or_empty
from litvec.runtime import stage, staging_path

FILE_BYTES = 64 << 20  # of payload, then a task starts another archive
LONGEST_HEADER = 64 << 20  # of an uncompressed archive; in a member a header may be as long as the member
_CHUNK = 1 << 20
_LINE = b"\r\n"
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_VERSION_LINE = re.compile(rb"WARC/1\.")
_DATE = "2020-01-01T00:00:00Z"  # the tables name no time of capture


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder every executor can reach, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode(), b"", b""]
    return _LINE.join(lines) + block + _LINE + _LINE


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit without the payload if ``refers_to`` names its response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"),
        ("WARC-Date", _DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
    ]
    if url:
        # White space and control characters would end the header line.
        target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        headers.append(("WARC-Target-URI", target))
    if refers_to is not None:
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        headers.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        return _record(headers, http)
    return _record(headers, http + payload)


class Damaged(Exception):
    pass


class _File:
    """Random access with a window, so that nothing but the record at hand is held."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.held = source, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.source.seek(at)
            self.held, self.at = self.source.read(min(max(n, _CHUNK), self.size - at)), at
        return self.held[at - self.at : at - self.at + n]


def _member(file: _File, at: int) -> tuple[bytes, int | None, str | None, bool]:
    """What the gzip member at ``at`` holds and where it ends; if it is damaged no end, but the reason, and whether it is only cut off."""
    inflate, out, position = zlib.decompressobj(31), [], at
    while not inflate.eof:
        data = file.read(position, _CHUNK // 4)
        if not data:
            return b"".join(out), None, "member is cut off", True
        try:
            out.append(inflate.decompress(data))
        except zlib.error as error:
            return b"".join(out) + _before_error(file, at, position), None, f"member: {error}", False
        position += len(data)
    return b"".join(out), position - len(inflate.unused_data), None, False


def _before_error(file: _File, at: int, position: int) -> bytes:
    """What the bytes from ``position`` on give before inflating them fails."""
    inflate = zlib.decompressobj(31)
    for start in range(at, position, _CHUNK // 4):
        inflate.decompress(file.read(start, min(_CHUNK // 4, position - start)))
    out, data = [], file.read(position, _CHUNK // 4)
    for i in range(0, len(data), 64):
        try:
            out.append(inflate.decompress(data[i : i + 64]))
        except zlib.error:
            break
    return b"".join(out)


def _head(data: bytes) -> tuple[dict[str, str], int]:
    """Header fields of a record, by lower-case name, and where its block starts."""
    end = data.find(_LINE + _LINE)
    if end < 0 or not re.match(rb"WARC/1\.\d\r\n", data):
        raise Damaged("no header")
    fields = {}
    for line in data[:end].split(_LINE)[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a name")
        fields[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no content length")
    return fields, end + 4


def _checked(fields: dict[str, str], block: bytes) -> dict:
    """The record's values; its payload has to agree with its digest."""
    kind = fields.get("warc-type", "")
    http = block.find(_LINE + _LINE) if "application/http" in fields.get("content-type", "") else -4
    payload = block
    if "application/http" in fields.get("content-type", ""):
        payload = block.partition(_LINE + _LINE)[2]
    declared = fields.get("warc-payload-digest", "").partition(":")[2]
    size = len(payload)
    if kind == "revisit":
        found = re.search(rb"(?im)^content-length:\s*(\d+)", block)
        payload, size = None, int(found[1]) if found else None
    elif declared and declared != base32_sha1(payload):
        raise Damaged("payload digest differs")
    return {
        "record_id": fields.get("warc-record-id"),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"),
        "payload_digest": declared or (base32_sha1(payload) if payload is not None else None),
        "payload_bytes": size,
        "payload": payload,
    }


def _plain(file: _File, at: int) -> tuple[dict, int]:
    """The uncompressed record at ``at`` and where it ends."""
    size = 8192
    while True:
        data = file.read(at, size)
        if _LINE + _LINE in data or len(data) < size or size >= LONGEST_HEADER and file.source:
            break
        size *= 4
    fields, start = _head(data)
    length = int(fields["content-length"])
    if at + start + length + 4 > file.size:
        raise Damaged("block is cut off")
    if file.read(at + start + length, 4) != _LINE + _LINE:
        raise Damaged("no end behind the block")
    return _checked(fields, file.read(at + start, length)), at + start + length + 4


def _inside(data: bytes, checked: bool) -> list[dict]:
    """Records and gaps of an inflated member, with their places in it; without its checksum only records that a digest confirms."""
    inner = _File(None, len(data))
    inner.held = data

    def read(file: _File, at: int) -> tuple[list[dict], int, None]:
        record, end = _plain(file, at)
        if not checked and record["payload"] is None:
            raise Damaged("no digest confirms the record")
        return [record], end, None

    return [e | {"inner_start": e["start"], "inner_end": e["end"]} for e in _walk(inner, read, _VERSION_LINE)]


def _entries_at(file: _File, at: int) -> tuple[list[dict], int | None, str | None]:
    """What the member, or the uncompressed record, that starts at ``at`` gives, and its end; the reason where it is damaged."""
    start = file.read(at, 8)
    if start.startswith(b"WARC/1."):
        record, end = _plain(file, at)
        return [record], end, None
    if not start.startswith(b"\x1f\x8b\x08"):
        raise Damaged("neither member nor version line")
    data, end, reason, cut = _member(file, at)
    entries = _inside(data, reason is None or cut)
    # Nothing stands behind the last bytes of a damaged member, so a record that reaches them counts as damaged.
    found = [e for e in entries if not e["gap"] and (reason is None or e["inner_end"] < len(data))]
    if entries and not found:
        raise Damaged(reason or entries[0]["gap"])
    if reason is None:
        return entries, end, None
    # The rest of a damaged member is part of its gap in the file.
    return entries[: entries.index(found[-1]) + 1] if found else [], None, reason


def _walk(file: _File, read, candidate: re.Pattern) -> Iterator[dict]:
    """Entries and gaps from the start to the end of ``file``; ``read`` gives what starts at a place, or part of it and no end."""
    at, broken = 0, None
    while at < file.size:
        try:
            entries, end, reason = read(file, at)
        except Damaged as damage:
            entries, end, reason = [], None, str(damage)
        if broken and (entries or end is not None):
            yield {"start": broken[0], "end": at, "gap": broken[1]}
            broken = None
        for entry in entries:
            yield {"gap": None} | entry | {"start": at, "end": at if end is None else end}
        if end is not None:
            at = end
            continue
        broken = broken or (at, reason)
        at += 1
        while at < file.size:
            data = file.read(at, _CHUNK)
            found = candidate.search(data)
            if found:
                at += found.start()
                break
            at += max(1, len(data) - 6)
        at = min(at, file.size)
    if broken:
        yield {"start": broken[0], "end": file.size, "gap": broken[1]}


def salvage(source, size: int) -> Iterator[dict]:
    """Records and gaps of an archive in their order, each with ``start`` and ``end`` in the file.

    A member or record that fails a check becomes part of a gap with the first reason found. Records
    and gaps of a compressed member have their place in it as ``inner_start`` and ``inner_end`` too. Of a member that is cut
    off or corrupt, the records before the last bytes that it gives are kept, of a corrupt one those with a digest; their
    ``end`` is their ``start``, as the bytes of the member are a gap.
    """
    return _walk(_File(source, size), _entries_at, _CANDIDATE)


def _responses(df: DataFrame, least: int) -> DataFrame:
    """Payload digest and size of what several rows share, with the page that keeps the payload."""
    return (
        df.where(F.col("size") >= least)
        .groupBy(F.col("sha1").alias("shared_sha1"), F.col("size").alias("shared_size"))
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .where("n > 1 and keeper is not null")
        .select("shared_sha1", "shared_size", "keeper")
    )


def write_archives(
    df: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0
) -> DataFrame:
    """Write a record per row into archives in a shared folder; returns their ``path, records, bytes``.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest id is the
    response, the others revisit it; rows that repeat that id are responses too. A null html is an
    empty payload, a null url is left out, a row with a null id is written without one. An empty
    table gives no archive. A task writes files of bounded size under names of its attempt, and
    only files of finished tasks are listed, so repeated tasks do no harm.
    """
    spark = df.sparkSession
    folder = folder or staging_path(spark, "warc")
    pages = df.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), text_or_empty(html).alias("html")
    ).withColumns({"sha1": F.sha1("html"), "size": F.octet_length("html")})
    shared = stage(_responses(pages.select("page_id", "sha1", "size"), least), "shared-payloads")
    same = (F.col("sha1") == F.col("shared_sha1")) & (F.col("size") == F.col("shared_size"))
    keeper = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    rows = pages.join(shared, same, "left").select("page_id", "url", F.col("html").cast("binary"), keeper.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = open_folder(folder)
        out = path = None
        records = written = payload = 0
        done = []

        def close() -> None:
            nonlocal out, records, written, payload
            if out is not None:
                out.close()
                done.append((f"{folder}/{path}", records, written))
            out, records, written, payload = None, 0, 0, 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    files.create_dir(where, recursive=True)
                    out = files.open_output_stream(f"{where}/{path}", compression=None)
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = deflate.compress(page_record(*row)) + deflate.flush()
                out.write(member)
                records, written, payload = records + 1, written + len(member), payload + len(row[2])
                if payload >= FILE_BYTES:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"]
            )

    return stage(rows.mapInArrow(write, "path string, records long, bytes long"), "archives")


READ = (
    "path string, start long, end long, inner_start long, inner_end long, gap string, record_id string, record_type string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary"
)
_KINDS = [pa.string(), *[pa.int64()] * 4, *[pa.string()] * 6, pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in READ.split(", ")]


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives in the column ``path``.

    A gap has its bytes (start, end, and the place in a member that is otherwise whole) and the reason in
    ``gap``; nothing else is set. ``payloads``
    false leaves the payloads out after they were checked. A null path gives no row, an empty
    file none, a path that comes twice is read twice. A file is read as a stream by one task.
    """
    listed = paths.where("path is not null").select("path")
    files = listed.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                folder, _, name = path.rpartition("/")
                system, where = open_folder(folder)
                size = system.get_file_info(f"{where}/{name}").size
                rows, held = [], 0
                with system.open_input_file(f"{where}/{name}") as source:
                    for record in salvage(source, size):
                        if not payloads:
                            record.pop("payload", None)
                        rows.append((path, *(record.get(k) for k in _NAMES[1:])))
                        held += len(record.get("payload") or b"") + 500
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return listed.repartition(max(1, files)).mapInArrow(read, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)
