"""WARC archives: a writer of gzip members and a reader that salvages damaged files.

Reader. Each position must hold a gzip member or a plain record that passes every check: the
member's CRC and end, the version line, the header's fields, a whole block, the closing blank lines
and, where given, the block digest. Numbers are read up to 64 bits and members one level deep. After a failed check the reader searches for the next gzip magic
or version line from which a record passes all of these, goes on there, and logs the bytes between
as a gap. A member that unpacks but holds damaged records is searched in the same way inside.

Defined results: a null payload is an empty one; a null id gives a record without an id field, read
back as null; a null or odd URL is percent-encoded as far as a header line needs it; an empty table
gives no archive, and an empty or null archive no rows. Of rows with equal payloads (at least
min_revisit_bytes long) the one with the smallest id is the response and every other row revisits it;
rows that share this smallest id are responses too, and a group without any id has responses only.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.session import materialize

ARCHIVE_SCHEMA = "archive_id string, data binary"
RECORD_SCHEMA = (
    "archive_id string, kind string, offset long, length long, reason string, record_type string, page_id long, "
    "refers_to long, target_uri string, payload_bytes long, payload_digest string, payload binary"
)

_VERSION = b"WARC/1."
_MAGIC = b"\x1f\x8b\x08"
_FEED = 1 << 16
#: A version line is 'WARC/1.1'; header fields after it may be of any length.
_VERSION_LINE = 16
_DATE = "2000-01-01T00:00:00Z"
_BROADCAST_ROWS, _SALTS = 300_000, 32
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Damaged(Exception):
    """A check that a member or record did not pass."""


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One uncompressed record; with refers_to a revisit, which keeps the headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = http if refers_to is not None else http + (payload or b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Date", _DATE)]
    if page_id is not None:
        fields.append(("WARC-Record-ID", f"<urn:x-page:{page_id}>"))
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]-._~")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), ("WARC-Profile", _PROFILE)]
    fields += [
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _parse(buf: bytes, at: int) -> tuple[dict, int]:
    """The record at a position of plain bytes and where it ends."""
    if buf[at : at + len(_VERSION)] != _VERSION:
        raise Damaged("no version line")
    end = buf.find(b"\r\n", at, at + _VERSION_LINE)
    if end < 0:
        raise Damaged("version line without end")
    head: dict[str, str] = {}
    while buf[end : end + 4] != b"\r\n\r\n":
        line_at, end = end + 2, buf.find(b"\r\n", end + 2)
        if end < 0:
            raise Damaged("header without end")
        key, colon, value = bytes(buf[line_at:end]).partition(b":")
        if not colon:
            raise Damaged("header field without colon")
        name = key.decode("latin-1").strip().lower()
        if name == "warc-type" and name in head:
            raise Damaged("header runs into another")
        head[name] = value.decode("utf-8", "replace").strip()
    size = _number(head.get("content-length", ""))
    if size is None or size < 0:
        raise Damaged("no content length")
    start = end + 4
    stop = start + size
    if buf[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("block without closing lines")
    block = buf[start:stop]
    said = head.get("warc-block-digest", "")
    if said.startswith("sha256:") and hashlib.sha256(block).hexdigest() != said[7:]:
        raise Damaged("block digest differs")
    return {"head": head, "block": block}, stop + 4


def _unpack(buf: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at a position and where it ends."""
    z, parts, fed = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if fed >= len(buf):
                raise Damaged("member cut short")
            parts.append(z.decompress(buf[fed : fed + _FEED]))
            fed = min(len(buf), fed + _FEED)
    except zlib.error as e:
        raise Damaged("member fails to unpack") from e
    return b"".join(parts), fed - len(z.unused_data)


def _entry(buf: bytes, view: memoryview, at: int, inside: bool) -> tuple[list[dict], list[tuple[int, int, str]], int]:
    """Records (and gaps inside a member) of what stands at a position, and its end."""
    if buf[at : at + 3] != _MAGIC:
        found, end = _parse(buf, at)
        return [found], [], end
    if inside:
        raise Damaged("member inside a member")
    plain, end = _unpack(view, at)
    records, gaps = [], []
    for kind, start, stop, what in _walk(plain, True):
        if kind == "gap":
            gaps.append((start, stop, what))
        else:
            records.append(what)
    if not records:
        raise Damaged("member without record")
    return records, gaps, end


def _next(buf: bytes, at: int) -> int:
    """The next place where a member or record may start, or the end."""
    found = [i for i in (buf.find(_MAGIC, at), buf.find(_VERSION, at)) if i >= 0]
    return min(found, default=len(buf))


def _walk(buf: bytes, inside: bool = False) -> Iterator[tuple[str, int, int, object]]:
    """('record', start, end, record) and ('gap', start, end, reason) in order, covering the buffer.

    inside: the buffer is what a member held; members in it are gaps.
    """
    at, view, bad, why = 0, memoryview(buf), None, ""
    while at < len(buf):
        try:
            records, inner, end = _entry(buf, view, at, inside)
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            at = _next(buf, at + 1)
            continue
        if bad is not None:
            yield "gap", bad, at, why
            bad = None
        for r in records:
            yield "record", at, end, r
        for start, stop, reason in inner:
            yield "gap", at, end, f"inside the member, bytes {start} to {stop}: {reason}"
        at = end
    if bad is not None:
        yield "gap", bad, len(buf), why


def _number(text: str | bytes) -> int | None:
    """A whole number of 64 bits in ASCII digits; null for anything else."""
    text = text.decode("latin-1") if isinstance(text, bytes) else text
    parts = re.fullmatch(r"[ \t]*(-?)0*([0-9]{1,19})[ \t]*", text)
    found = int(parts[1] + parts[2]) if parts else None
    return found if found is not None and -(1 << 63) <= found < 1 << 63 else None


def _page(uri: str | None) -> int | None:
    return _number((uri or "").removeprefix("<urn:x-page:").removesuffix(">"))


def _row(name: str, start: int, end: int, found: dict, with_payload: bool) -> tuple:
    head, block = found["head"], found["block"]
    http, _, payload = bytes(block).partition(b"\r\n\r\n")
    kind = head.get("warc-type")
    if kind == "revisit":
        size = next((n for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:") and (n := _number(x[15:])) is not None), None)
        digest, payload = head.get("warc-payload-digest", "").removeprefix("sha256:") or None, None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    uri = head.get("warc-target-uri")
    return (
        name, "record", start, end - start, None, kind, _page(head.get("warc-record-id")), _page(head.get("warc-refers-to")),
        None if uri is None else unquote(uri), size, digest, payload if with_payload else None,
    )


def salvage(name: str, data: bytes | None, with_payload: bool = True) -> Iterator[tuple]:
    """Rows of RECORD_SCHEMA for one archive: its records and its gaps."""
    for kind, start, end, what in _walk(data or b""):
        if kind == "record":
            yield _row(name, start, end, what, with_payload)
        else:
            yield (name, "gap", start, end - start, what, None, None, None, None, None, None, None)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Rows of RECORD_SCHEMA for a table of (archive_id, data); one archive is held at a time."""
    columns = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["archive_id"], frame["data"]):
                rows, held = [], 0
                for row in salvage(name, data, with_payload):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= 4096 or held > 1 << 25:
                        yield _frame(rows, columns)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, columns)

    return archives.select("archive_id", "data").mapInPandas(read, RECORD_SCHEMA)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns, dtype=object)
    return frame.astype({c: "Int64" for c in ("offset", "length", "page_id", "refers_to", "payload_bytes")})


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_revisit_bytes: int = 100) -> DataFrame:
    """(page_id, url, text, digest, n_bytes, refers_to) for each page.

    Only ids, digests and sizes are shuffled to find equal payloads; the texts then meet a table of
    the payloads that several rows have. It is sent to all tasks up to _BROADCAST_ROWS rows (of some 100
    bytes); beyond, rows meet it by digest and a salt, so that a payload that many pages share is dealt
    to many tasks.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text.alias("text"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    shared = (
        base.where(F.col("n_bytes") >= min_revisit_bytes)
        .groupBy(F.col("digest").alias("shared_digest"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"))
        .where((F.col("n_rows") > 1) & F.col("first_id").isNotNull())
        .drop("n_rows")
    )
    shared = materialize(shared, "shared")
    if shared.count() <= _BROADCAST_ROWS:
        found = base.join(F.broadcast(shared), F.col("digest") == F.col("shared_digest"), "left")
    else:
        shared = shared.withColumn("shared_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS))
        found = base.withColumn("salt", salt).join(shared, (F.col("digest") == F.col("shared_digest")) & (F.col("salt") == F.col("shared_salt")), "left")
    return found.select(
        "page_id", "url", "text", "digest", "n_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")
    )


def write_archives(marked: DataFrame, archive_bytes: int = 8 << 20, level: int = 4) -> DataFrame:
    """(archive_id, data): archives of about archive_bytes of plain records, each record its own member."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n, parts, held = TaskContext.get().partitionId(), 0, [], 0
        for frame in frames:
            ids, refers = frame["page_id"].tolist(), frame["refers_to"].tolist()
            for page_id, url, text, digest, size, to in zip(ids, frame["url"], frame["text"], frame["digest"], frame["n_bytes"], refers):
                raw = record(_int(page_id), url, text.encode(), digest, int(size), _int(to))
                parts.append(member(raw, level))
                held += len(raw)
                if held >= archive_bytes:
                    yield pd.DataFrame({"archive_id": [f"{part:06d}-{n:06d}"], "data": [b"".join(parts)]})
                    n, parts, held = n + 1, [], 0
        if parts:
            yield pd.DataFrame({"archive_id": [f"{part:06d}-{n:06d}"], "data": [b"".join(parts)]})

    # ids travel as text, so that pandas keeps long integers beside nulls exact
    return marked.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")}).mapInPandas(write, ARCHIVE_SCHEMA)


def _int(x: object) -> int | None:
    return int(x) if isinstance(x, str) else None
