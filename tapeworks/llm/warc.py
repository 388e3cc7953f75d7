"""WARC archives: a writer of response and revisit records, and a salvage reader.

Writing. Every record is a gzip member of its own, as the format asks. Payloads of at least ``min_bytes`` that several rows
share are stored once, in the row with the largest id; the others become revisit records that refer to it. Digests are
counted with partial sums and only ids and digests are joined to find the revisits; the compressed members meet their
record type in one join by id. Files are written by Spark's text sink, so its commit protocol covers lost executors: its
line separator is an empty gzip member, which every reader skips.

Reading. Files are read by Spark's binary source. A record counts as sound if its member's checksum, its version line, its
headers, its length and its digests are right. After a failed check the reader searches for the next gzip member that
decompresses, or in a plain file for the next version line, goes on from there, and logs the bytes in between as a
quarantined gap. So one damaged record never costs another, and sound records plus gaps cover a file exactly. Where the headers
of a damaged record are sound and its stated end is followed by another record, the search goes on there, so that a record
inside its payload is not taken for one of the archive. Digests are SHA-1 in hexadecimal or base 32.
Inside a member that holds several records it searches for the next version line too: such a gap has length 0 in the file, and
its reason names the inflated bytes. Of a damaged member, which is a gap, the records that inflate and whose own block digests
hold are sound, but not one that ends exactly where the file cuts its member.

Defined results: a null payload is empty. A null url gives a record without a target. Rows with equal ids and payloads are
all of the same type. A null id counts as smaller than any other. An empty table gives an empty folder of archives. Other columns
of the pages are not written. Files must fit in memory (the writer's partitions bound them).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NULL_ID, id_key, shared_path

VERSION = b"WARC/1.1\r\n"
#: An empty gzip member.
_EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_BYTES = 1000
_STEP = 1 << 15
_DIGEST = re.compile(rb"(?i)\r\nwarc-block-digest:[ \t]*(?-i:sha1):(?:[0-9a-f]{40}|(?-i:[A-Z2-7]{32}))[ \t]*\r\n")
RECORD = "path string, offset long, kind string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"
GAP = "path string, start long, length long, reason string"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _record(kind: str, page_id: int, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None = None) -> bytes:
    """An uncompressed record; a revisit's block is the HTTP header alone."""
    block = _HTTP.format(n_bytes).encode() + payload
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:x-page:{page_id}>", "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else quote(url, safe="/:?#[]@!$&'()*+,;=~"), "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}", "X-Payload-Length": str(n_bytes),
        "WARC-Profile": _PROFILE if kind == "revisit" else None, "WARC-Refers-To": None if refers_to is None else f"<urn:x-page:{refers_to}>",
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's response record as a gzip member."""
    for batch in batches:
        ids, urls, payloads, digests, sizes = (batch.column(k) for k in range(5))
        made = [_member(_record("response", i.as_py(), u.as_py(), p.as_py(), d.as_py(), n.as_py())) for i, u, p, d, n in zip(ids, urls, payloads, digests, sizes)]
        yield pa.RecordBatch.from_arrays([ids, urls, digests, sizes, pa.array(made, pa.binary())], ["_tw_id", "_tw_url", "_tw_digest", "_tw_bytes", "_tw_member"])


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of responses as they are; revisits, which have a _tw_refers, are made here."""
    for batch in batches:
        out = []
        for i, u, d, n, m, r in zip(*(batch.column(k) for k in range(6))):
            out.append(_member(_record("revisit", i.as_py(), u.as_py(), b"", d.as_py(), n.as_py(), r.as_py())) if r.is_valid else m.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """One record for each row, into a folder of archives."""
    body = F.coalesce(F.col(payload).cast("string").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(id_key(page_id).alias("_tw_id"), F.col(url).cast("string").alias("_tw_url"), body.alias("_tw_payload"))
    rows = rows.withColumns({"_tw_digest": F.sha1("_tw_payload"), "_tw_bytes": F.octet_length("_tw_payload").cast("long")})
    small = rows.select("_tw_id", "_tw_digest", "_tw_bytes").filter(F.col("_tw_bytes") >= min_bytes)
    first = small.groupBy("_tw_digest", "_tw_bytes").agg(F.max("_tw_id").alias("_tw_refers"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = small.join(first, ["_tw_digest", "_tw_bytes"]).filter("_tw_id <> _tw_refers").select("_tw_id", "_tw_digest", "_tw_refers").distinct()
    members = rows.select("_tw_id", "_tw_url", "_tw_payload", "_tw_digest", "_tw_bytes").mapInArrow(_members, "_tw_id long, _tw_url string, _tw_digest string, _tw_bytes long, _tw_member binary")
    typed = members.join(revisits, ["_tw_id", "_tw_digest"], "left").select("_tw_id", "_tw_url", "_tw_digest", "_tw_bytes", "_tw_member", "_tw_refers")
    out = typed.mapInArrow(_final, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def _digest(header: str) -> str | None:
    """The hexadecimal form of a ``sha1:`` header, empty if it is damaged; None for no or another digest."""
    if not header.startswith("sha1:"):
        return None
    said = header.removeprefix("sha1:")
    if re.fullmatch("[A-Z2-7]{32}", said):
        return base64.b32decode(said).hex()
    return said.lower() if re.fullmatch("[0-9a-fA-F]{40}", said) else ""


def _headers(data: bytes, at: int) -> tuple[dict, int, int] | str:
    """(headers, start and end of the block) of the record at ``at``, or why there is none."""
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at):
        return "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return "headers do not end"
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    if not head.get(b"content-length", "").isdigit():
        return "no length"
    return head, end + 4, end + 4 + int(head[b"content-length"])


def _resume(data: bytes, at: int) -> int:
    """Where to search on after a damaged record: its stated end if a record or nothing follows there, else right behind its start."""
    said = _headers(data, at)
    if not isinstance(said, str):
        end = said[2] + 4
        if data[end - 4 : end] == b"\r\n\r\n" and (end == len(data) or data.startswith((b"WARC/1.", b"\x1f\x8b\x08"), end)):
            return end
    return at + 1


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int] | str:
    """(fields, end) of the record at ``at``, or why there is none."""
    said = _headers(data, at)
    if isinstance(said, str):
        return said
    head, start, stop = said
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "wrong length"
    block = data[start:stop]
    if (want := _digest(head.get(b"warc-block-digest", ""))) is not None and want != hashlib.sha1(block).hexdigest():
        return "wrong block digest"
    http = block.find(b"\r\n\r\n") if "application/http" in head.get(b"content-type", "") else -4
    payload = block[http + 4 :]
    kind, digest = head.get(b"warc-type", ""), _digest(head.get(b"warc-payload-digest", ""))
    if kind != "revisit" and digest is not None and digest != hashlib.sha1(payload).hexdigest():
        return "wrong payload digest"
    known = lambda name: int(v[12:-1]) if (v := head.get(name, "")).startswith("<urn:x-page:") else None
    if kind == "revisit" and http < 0:
        return "no HTTP header"
    size, uri = head.get(b"x-payload-length", ""), head.get(b"warc-target-uri")
    return {
        "kind": kind, "page_id": known(b"warc-record-id"), "url": None if uri is None else unquote(uri), "payload": payload if kind != "revisit" else None,
        "payload_bytes": int(size) if size.isdigit() else len(payload), "payload_digest": digest or hashlib.sha1(payload).hexdigest(), "refers_to": known(b"warc-refers-to"),
    }, stop + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, bool | None]:
    """What the member at ``at`` inflates to, where that ends, and if it is whole and its checksum right; None if the file ends in it."""
    d, parts, k = zlib.decompressobj(31), [], at
    try:
        for k in range(at, len(data), _STEP):
            parts.append(d.decompress(data[k : k + _STEP]))
            if d.eof:
                return b"".join(parts), min(k + _STEP, len(data)) - len(d.unused_data), True
        return b"".join(parts), len(data), None
    except zlib.error:
        pass
    d = zlib.decompressobj(31)  # again, for what precedes the damage in the step that failed
    for x in range(at, k, _STEP):
        d.decompress(data[x : x + _STEP])
    try:
        for k in range(k, min(k + _STEP, len(data))):
            parts.append(d.decompress(data[k : k + 1]))
    except zlib.error:
        pass
    return b"".join(parts), k, False


def _inside(body: bytes, whole: bool | None) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """Sound records of an inflated body, and (start, stop, reason) of what is between; of a damaged member only those with a digest."""
    records, between, pos, bad, reason = [], [], 0, None, ""
    while pos < len(body):
        one = parse_record(body, pos)
        if not isinstance(one, str) and not whole and not _DIGEST.search(body, pos, body.find(b"\r\n\r\n", pos) + 2):
            one = "no block digest in a bad member"
        if not isinstance(one, str) and whole is None and one[1] == len(body):
            one = "ends where the member is cut"
        if isinstance(one, str):
            if bad is None:
                bad, reason = pos, one
            pos = body.find(b"WARC/1.", _resume(body, pos))
            pos = len(body) if pos < 0 else pos
            continue
        if bad is not None:
            between.append((bad, pos, reason))
            bad = None
        records.append(one[0])
        pos = one[1]
    if bad is not None:
        between.append((bad, len(body), reason))
    return records, between


def salvage(data: bytes) -> Iterator[tuple[str, int, object]]:
    """("record", offset, fields) and ("gap", start, (length, reason)) in file order, covering all bytes."""
    at, n, zipped = 0, len(data), data[:2] == b"\x1f\x8b"
    bad, reason = None, ""
    seen = 0  # plain records before it were inflated with a bad member

    def gap(stop):
        return "gap", bad, (stop - bad, reason)

    while at < n:
        found, records, between = None, [], []
        if data[at : at + 3] == b"\x1f\x8b\x08":
            body, stop, whole = _inflate(data, at)
            records, between = _inside(body, whole)
            if whole and (records or not body):
                found = records, stop
            else:
                why = between[0][2] if whole else "bad member"
                if records:
                    seen = max(seen, stop)
        else:
            one = parse_record(data, at) if data[at : at + 5] == b"WARC/" else "no member" if zipped else "no version line"
            if isinstance(one, str):
                why = one
            else:
                found = [one[0]], one[1]
        if found:
            if bad is not None:
                yield gap(at)
                bad = None
            for r in found[0]:
                yield "record", at, r
            for start, stop, why in between:
                yield "gap", at, (0, f"inflated bytes {start} to {stop}: {why}")
            at = found[1]
            continue
        if bad is None:
            bad, reason = at, why
        for r in records:
            yield "record", at, r
        on = _resume(data, at)
        marks = [m for m in (data.find(b"\x1f\x8b\x08", on), data.find(b"WARC/1.", max(on, seen))) if m >= 0]
        at = min(marks, default=n)
    if bad is not None:
        yield gap(n)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")][2:]
    kinds = {"page_id": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}

    def out(rows):
        columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())]
        columns += [pa.array([r[2].get(k) if isinstance(r[2], dict) else None for r in rows], kinds.get(k, pa.string())) for k in names]
        columns += [pa.array([None if isinstance(r[2], dict) else r[2][0] for r in rows], pa.int64()), pa.array([None if isinstance(r[2], dict) else r[2][1] for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["path", "offset", *names, "gap_bytes", "reason"])

    for batch in batches:
        for path, data in zip(batch.column(0), batch.column(1)):
            rows, size = [], 0
            for _, at, what in salvage(data.as_py()):
                rows.append((path.as_py(), at, what))
                size += len(what.get("payload") or b"") if isinstance(what, dict) else 0
                if size > 1 << 22 or len(rows) >= 5000:
                    yield out(rows)
                    rows, size = [], 0
            yield out(rows)


def read_warc(spark, path: str) -> DataFrame:
    """Sound records (RECORD) and quarantined gaps: rows with ``gap_bytes`` and ``reason`` are gaps, ``offset`` their start."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(_read, RECORD + ", gap_bytes long, reason string")


def records(found: DataFrame) -> DataFrame:
    return found.filter("gap_bytes is null").drop("gap_bytes", "reason")


def gaps(found: DataFrame) -> DataFrame:
    return found.filter("gap_bytes is not null").select("path", F.col("offset").alias("start"), F.col("gap_bytes").alias("length"), "reason")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    from .common import read

    path = shared_path(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), path)
    whole = F.when(F.col("page_id") != NULL_ID, F.col("page_id"))
    return records(read_warc(spark, path)).select(whole.alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


SQL = {
    "op4_warc": """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
    w AS (SELECT d, n, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d, n)
    SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
           CASE WHEN w.last IS NULL OR w.last = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN w.last IS NULL OR w.last = p.page_id THEN NULL ELSE w.last END AS refers_to
    FROM p LEFT JOIN w ON p.d = w.d AND p.n = w.n"""
}
