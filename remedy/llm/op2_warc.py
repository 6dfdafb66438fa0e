"""WARC archives: writer with revisit records, and a reader that salvages damaged files.

Writing: each record is its own gzip member. Of records with equal payloads of at least
``min_bytes`` bytes the one with the smallest id is a response; the others are revisits
that name it and carry only the HTTP header. An archive is closed at ARCHIVE_BYTES, so a
task holds one archive at a time. Archives travel as rows (archive, content).

Reading: a member must inflate, pass its CRC, start with a version line, have a header
end and a Content-Length equal to the block that follows; a response must also match its
payload digest. When a check fails the reader searches for the next place where a gzip
member with a WARC version line inflates, or a plain version line stands, continues
there, and logs the skipped bytes as a gap (archive, start, end, reason). In a member of
several records the search is for the next version line among its inflated bytes, up to
where a damaged member stops; its gaps have the range of the member and name the inflated
bytes. The only record of a damaged member stands or falls with it.

Defined cases: a null payload is written as an empty one; rows repeating the smallest id
of a payload are responses too; a null id is written as ``null`` and read back as null,
and is a response only where all ids of the payload are null; header values have line
breaks percent-coded; an empty table gives no archive; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedy.llm.common import written
from remedy.sources.tables import table

ARCHIVE_BYTES = 8 * 1024 * 1024
MIN_BYTES = 0
LEVEL = 1
# Fixed values of the WARC format.
VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MAGIC = b"\x1f\x8b\x08"
RECORD = "archive string, at long, page_id long, url string, record_type string, refers_to long, " \
         "payload_bytes long, payload_digest string, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}"]
    if url is not None:
        clean = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
        head.append(f"WARC-Target-URI: {clean}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {name(refers)}", f"WARC-Profile: {IDENTICAL}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                   min_bytes: int = MIN_BYTES, path: str | None = None) -> DataFrame:
    """Archives (archive, content) of ``pages``, written to the shared folder and read back."""
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.withColumn("sha", F.sha1("body"))
    first = rows.filter(F.octet_length("body") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first"))
    # a payload shared by a third of the pages is one hot digest: a sort-merge join, which
    # AQE splits; the aggregate above collapses it before its shuffle
    paired = rows.join(first.hint("merge"), "sha", "left")
    paired = paired.select("id", "url", "body", "sha", "first", (
        F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))).alias("revisit"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buf, seq, task = bytearray(), 0, uuid.uuid4().hex

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"{task}-{seq:05d}.warc.gz"],
                                               "content": pa.array([bytes(buf)], pa.binary())})
        for b in batches:
            cols = [b.column(c) for c in range(6)]
            for i in range(b.num_rows):
                ident, link, body, sha, fst, rev = (c[i].as_py() for c in cols)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                buf += z.compress(_record(ident, link, bytes(body), digest, fst, rev)) + z.flush()
                if len(buf) >= ARCHIVE_BYTES:
                    yield close()
                    buf, seq = bytearray(), seq + 1
        if buf:
            yield close()

    archives = paired.mapInArrow(pack, "archive string, content binary")
    if path is None:
        return written(archives, "warc")
    archives.write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").splitlines()[1:]:
        k, sep, v = line.partition(":")
        if sep:
            out.setdefault(k.strip().lower(), v.strip())
    return out


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at ``at`` of inflated bytes and its end; ValueError if a check fails."""
    m = VERSION_LINE.match(data, at)
    if not m:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        raise ValueError("no header end")
    head = _headers(data[at:end])
    if not head.get("content-length", "").isdigit():
        raise ValueError("no content length")
    start, stop = end + 4, end + 4 + int(head["content-length"])
    if stop > len(data):
        raise ValueError("block is cut off")
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError("block does not end where its length says")
    kind, block = head.get("warc-type", ""), data[start:stop]
    cut = block.find(b"\r\n\r\n") + 4
    http = _headers(block[:cut]) if cut > 3 else {}
    payload = block[cut:] if cut > 3 else block
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest and payload_digest(payload) != digest:
        raise ValueError("payload digest differs")
    if kind == "revisit" and not http.get("content-length", "").isdigit():
        raise ValueError("revisit without payload length")

    def number(key: str) -> int | None:
        x = re.fullmatch(r"<urn:page:(-?\d+)>", head.get(key, ""))
        return int(x[1]) if x else None

    url = head.get("warc-target-uri")
    return {"page_id": number("warc-record-id"), "record_type": kind, "payload_digest": digest or None,
            "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
            "refers_to": number("warc-refers-to"), "payload": payload if kind != "revisit" else None,
            "payload_bytes": int(http["content-length"]) if kind == "revisit" else len(payload)}, stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What inflates of the gzip member at ``at``, its end, and the reason if it is damaged."""
    z, out = zlib.decompressobj(31), bytearray()
    while at < len(data) and not z.eof:  # in slices: what follows the member is copied back
        piece, before = data[at:at + 65536], z.copy()
        try:
            out += z.decompress(piece)
        except zlib.error as e:
            try:
                for i in range(len(piece)):  # byte by byte up to the damage
                    out += before.decompress(piece[i:i + 1])
            except zlib.error:
                pass
            return bytes(out), at, str(e)
        at += len(piece)
    return bytes(out), at - len(z.unused_data), None if z.eof else "member is cut off"


def _records(data: bytes) -> Iterator[dict | tuple[int, int, str]]:
    """Sound records of inflated bytes, (start, end, reason) for what lies between them."""
    at = 0
    while at < len(data):
        try:
            rec, at = _parse(data, at)
            yield rec
        except ValueError as e:
            m = VERSION_LINE.search(data, at + 1)
            end = m.start() if m else len(data)
            yield at, end, str(e)
            at = end


def _starts_record(data: bytes, at: int) -> bool:
    if data.startswith(GZIP_MAGIC, at):
        try:
            return bool(VERSION_LINE.match(zlib.decompressobj(31).decompress(memoryview(data)[at:at + 512], 16)))
        except zlib.error:
            return False
    return bool(VERSION_LINE.match(data, at))


def _resume(data: bytes, at: int, seen: bytes = b"") -> int:
    """Next place after ``at`` where a member or a version line starts a record, or the end.
    Records of ``seen`` (stored in a member without compression) are passed over."""
    for m in re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n").finditer(data, at):
        if _starts_record(data, m.start()) and not (
                seen and m[0] != GZIP_MAGIC and data[m.start():m.start() + 256] in seen):
            return m.start()
    return len(data)


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record) for each sound record, (start, end, reason) for each gap."""
    at = 0
    while at < len(data):
        if not data.startswith(GZIP_MAGIC, at):
            try:
                rec, end = _parse(data, at)
                yield at, end, rec
            except ValueError as e:
                end = _resume(data, at + 1)
                yield at, end, str(e)
            at = end
            continue
        inner, end, damage = _member(data, at)
        found = list(_records(inner))
        sound = any(isinstance(x, dict) for x in found) and not (damage and len(found) == 1)
        if damage:
            end = _resume(data, at + 1, inner if sound else b"")
        if sound:
            for x in found:
                yield at, end, x if isinstance(x, dict) else f"{x[2]} (inflated bytes {x[0]} to {x[1]})"
            if damage:
                yield at, end, f"{damage} (after {len(inner)} inflated bytes)"
        elif damage or found:
            yield at, end, damage or found[0][2]
        at = end


def _read(archives: DataFrame, want: str, schema: str, payloads: bool) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]])
                           for n, c in zip(names, schema.split(", "))])
        for b in batches:
            for i in range(b.num_rows):
                archive, content, rows, held = b.column(0)[i].as_py(), b.column(1)[i].as_py() or b"", [], 0
                for start, end, x in salvage(bytes(content)):
                    if want == "gaps" and isinstance(x, str):
                        rows.append({"archive": archive, "gap_start": start, "gap_end": end, "reason": x})
                    elif want == "records" and not isinstance(x, str):
                        if not payloads:
                            x["payload"] = None
                        rows.append({"archive": archive, "at": start, **x})
                        held += len(x["payload"] or b"")
                    if held > ARCHIVE_BYTES or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], types)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], types)

    return archives.select("archive", "content").mapInArrow(run, schema)


def read_records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Sound records of ``archives`` (archive, content), payloads on request."""
    return _read(archives, "records", RECORD, payloads)


def read_gaps(archives: DataFrame) -> DataFrame:
    """Quarantine log: byte ranges that belong to no sound record, with the failed check."""
    return _read(archives, "gaps", "archive string, gap_start long, gap_end long, reason string", False)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_records(archives, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# DuckDB hashes SHA-1 to hex only; base32 is taken 5 bits at a time.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first FROM h GROUP BY 1)
SELECT page_id, payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1) FOR i IN range(0, 32)],
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM h JOIN f USING (hex)"""

QUERIES = {"op2_warc": op2_warc}
ORACLE = {"op2_warc": SQL}
