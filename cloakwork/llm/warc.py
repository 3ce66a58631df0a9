"""WARC archives: a writer with revisit records, and a salvage reader.

*Writer.* One record per row, each a gzip member of its own. Of rows with equal payloads of at
least ``min_bytes`` bytes the one with the smallest id is a response, the others are revisits
that refer to it and carry no payload; smaller payloads are always responses. Rows with the same
smallest id are all responses; rows with a null id are responses that none refers to. Null
payloads are empty. Archives are written by Spark's own writer, so they can be in any store and a
lost executor's files are written anew.

*Reader.* Checks each member or record in turn: the gzip CRC, the version line, Content-Length,
the block's digest. After a failed check it searches for the next valid member (gzip header) or
version line, goes on there, and logs the bytes between as a quarantined gap. A member with damage inside gives its good records and
a gap for the rest. An archive is searched once, however many false starts it has, without a copy; a task holds one archive and one member's content.

Rows that repeat are records of their own; payloads of any length are taken whole. Columns other than the id, the payload and the URI are not
read, so their names can clash with nothing.
"""

from __future__ import annotations

import hashlib
import logging
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, dropped, new_path, slices, utf8, written

MIN_BYTES = 100
VERSION = b"WARC/1.1\r\n"
_VERSIONS = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = re.compile(rb"\x1f\x8b\x08")
_HEAD_END = re.compile(rb"\r\n\r\n")
_URN = "urn:page:"
_EPOCH = b"2024-01-01T00:00:00Z"


def record(kind: str, record_id: int | None, payload: bytes, digest: str, size: int, uri: str = "", refers_to: int | None = None) -> bytes:
    """One WARC record; a revisit has no block."""
    block = payload if kind == "response" else b""
    lines = [b"WARC-Type: " + kind.encode(), b"WARC-Date: " + _EPOCH, b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Payload-Length: %d" % size]
    if record_id is not None:
        lines.append(f"WARC-Record-ID: <{_URN}{record_id}>".encode())
    if uri := re.sub(r"[\r\n\t ]", "%20", uri):
        lines.append(b"WARC-Target-URI: " + uri.encode())
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_URN}{refers_to}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(b"Content-Length: %d" % len(block))
    return VERSION + b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    """A gzip member; its last byte is 0 (after 16 MB of content an empty member follows)."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(raw) + z.flush()
    if out[-1]:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += z.flush()
    return out


def parse_record(raw, at: int) -> tuple[dict, int] | None:
    """The record that begins at ``at`` of a bytes-like object: its fields and its end; None if a check fails."""
    if not _VERSIONS.match(raw, at):
        return None
    head = _HEAD_END.search(raw, at)
    if not head:
        return None
    fields = {}
    for line in bytes(raw[at : head.start()]).split(b"\r\n")[1:]:
        key, sep, value = line.partition(b":")
        if not sep:
            return None
        fields[key.strip().lower().decode("latin-1")] = value.strip()
    try:
        size, full = int(fields["content-length"]), int(fields["x-payload-length"]) if "x-payload-length" in fields else None
    except (KeyError, ValueError):
        return None
    end = head.end() + size
    if size < 0 or bytes(raw[end : end + 4]) != b"\r\n\r\n":
        return None
    block = bytes(raw[head.end() : end])
    kind, digest = fields.get("warc-type", b"").decode("latin-1"), fields.get("warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:")
    checked = kind != "revisit" and bool(digest)
    if checked and hashlib.sha256(block).hexdigest() != digest:
        return None

    def page(name: str) -> int | None:
        m = re.fullmatch(rf"<{_URN}(-?\d+)>".encode(), fields.get(name, b""))
        return int(m[1]) if m else None

    return {"id": page("warc-record-id"), "kind": kind, "digest": digest, "size": len(block) if full is None else full, "refers_to": page("warc-refers-to"), "uri": fields.get("warc-target-uri", b"").decode("utf-8", "replace"), "block": block, "checked": checked}, end + 4


def inflate(raw, at: int) -> tuple[bytes, int, bool]:
    """What a gzip member at ``at`` holds, the byte after it, and whether it is whole; of a damaged one what comes before the damage."""
    z, out, step, before = zlib.decompressobj(31), [], 1 << 12, None
    while at < len(raw) and not z.eof:
        part = raw[at : at + step]
        if out:  # the state to go back to; at first a new one does
            before = z.copy()
        try:
            out.append(z.decompress(part))
        except zlib.error:
            before = before or zlib.decompressobj(31)
            try:
                for i in range(0, len(part), 64):
                    out.append(before.decompress(part[i : i + 64]))
            except zlib.error:
                pass
            return b"".join(out), at, False
        at += len(part)
        step = min(step * 4, 1 << 22)
    return b"".join(out), at - len(z.unused_data), z.eof


class _Next:
    """Where a pattern occurs next; what was found is kept, so a whole archive is searched once."""

    def __init__(self, pattern: re.Pattern, raw):
        self.pattern, self.raw, self.at = pattern, raw, -1

    def after(self, at: int) -> int:
        if self.at < at:
            m = self.pattern.search(self.raw, at)
            self.at = m.start() if m else len(self.raw)
        return self.at


def salvage(raw) -> Iterator[tuple[str, int, int, dict]]:
    """("record" or "gap", first byte, byte after the last, fields) over a whole archive (bytes-like), in order.

    Archives may be gzip members, plain records or both in turn. A gap's fields name the check
    that failed first. Of a member that is not whole, or holds damaged records, the good records come back (of one
    that is not whole only those whose digest is right); its gap's fields have the first and last byte of the damage in what it holds.
    """
    at, bad, why, n = 0, None, "", len(raw)
    magic, version = _Next(_MAGIC, raw), _Next(_VERSIONS, raw)
    while at < n:
        found, lost, end, reason = [], [], at, "no version line"
        if _MAGIC.match(raw, at):
            body, end, whole = inflate(raw, at)
            parts = list(_records(body))
            reason = "damaged record in a member" if whole else "damaged member"
            found = [x for kind, _, _, x in parts if kind == "record" and (whole or x["checked"])]
            lost = [(a, b) for kind, a, b, x in parts if kind == "gap" or not (whole or x["checked"])]
            if not whole:
                end = min(magic.after(at + 1), version.after(at + 1))
                lost.append((len(body), len(body)))
            elif not parts:
                found = [None]  # an empty member: neither a record nor damage
        elif _VERSIONS.match(raw, at):
            one = parse_record(raw, at)
            reason = "damaged record"
            if one:
                found, end = [one[0]], one[1]
        if not found:
            if bad is None:
                bad, why = at, reason
            at = min(magic.after(at + 1), version.after(at + 1))
            continue
        if bad is not None:
            yield "gap", bad, at, {"why": why}
            bad = None
        for fields in found:
            if fields:
                yield "record", at, end, fields
        for first, last in lost:
            yield "gap", at, end, {"why": reason, "inner_first": first, "inner_end": last}
        at = end
    if bad is not None:
        yield "gap", bad, n, {"why": why}


def _records(body: bytes) -> Iterator[tuple[str, int, int, dict]]:
    """Records and gaps of what a member holds."""
    at, bad, version = 0, None, _Next(_VERSIONS, body)
    while at < len(body):
        one = parse_record(body, at)
        if one is None:
            bad = at if bad is None else bad
            at = version.after(at + 1)
            continue
        if bad is not None:
            yield "gap", bad, at, {}
            bad = None
        yield "record", at, one[1], one[0]
        at = one[1]
    if bad is not None:
        yield "gap", bad, len(body), {}


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url", min_bytes: int = MIN_BYTES) -> None:
    """Archives of all rows of ``pages`` under ``path``."""
    uri = F.coalesce(F.col(uri_col).cast("string"), F.lit("")) if uri_col else F.lit("")
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), uri.alias("uri"), body.alias("body"))
    keys = rows.select("id", F.octet_length("body").alias("size"), F.sha2("body", 256).alias("digest")).filter(F.col("size") >= min_bytes)
    # the ids of revisits and what they refer to: the only rows that are joined by digest
    first = written(keys.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n"), "op10-first")
    revisits = keys.join(first, "digest").filter("id > first").groupBy("id", "digest").agg(F.min("first").alias("first"))
    revisits = written(revisits, "op10-revisits")
    marked = rows.withColumn("digest", F.sha2("body", 256)).join(revisits, ["id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            ids, uris, bodies, digests, firsts = (batch.column(i) for i in range(5))
            out = [member(record("response" if first is None else "revisit", i, body, digest, len(body), u, first)) for i, u, body, digest, first in zip(ids.to_pylist(), uris.to_pylist(), utf8(bodies), digests.to_pylist(), firsts.to_pylist(), strict=True)]
            # the writer below ends each row with the member's last byte, which is always 0
            yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary())], names=["raw"])

    made = marked.select("id", "uri", "body", "digest", "first").mapInArrow(run, "raw binary")
    made.select(F.col("raw").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)
    dropped(first, revisits)


FIELDS = {
    "file": pa.string(), "first_byte": pa.int64(), "end_byte": pa.int64(), "kind": pa.string(), "id": pa.int64(), "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(),
    "refers_to": pa.int64(), "uri": pa.string(), "block": pa.binary(), "why": pa.string(), "inner_first": pa.int64(), "inner_end": pa.int64(),
}
RECORDS = ", ".join(f"{k} {'long' if t == pa.int64() else t}" for k, t in FIELDS.items())


def read_warc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """All records and gaps of the archives under ``path``: kind is ``record`` or ``gap``."""
    schema = pa.schema(list(FIELDS.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for kind, first, end, x in salvage(memoryview(content.as_buffer())):
                    row = {"file": file, "first_byte": first, "end_byte": end, "kind": kind, "record_type": x.get("kind"), "payload_digest": x.get("digest"), "payload_bytes": x.get("size")}
                    row |= {k: x.get(k) for k in ("id", "refers_to", "uri", "why", "inner_first", "inner_end")}
                    row["block"] = x.get("block") if blocks else None
                    rows.append(row)
                    held += len(row["block"] or b"")
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url") -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and returns what the salvage reader finds there; gaps are counted in the log."""
    spark = pages.sparkSession
    path = new_path(spark, "op10-warc")
    write_warc(pages, path, id_col, payload_col, uri_col)
    rows = written(read_warc(spark, path, blocks=False), "op10-records")
    drop_path(spark, path)
    if gaps := rows.filter("kind = 'gap'").count():
        logging.getLogger(__name__).warning("%d quarantined gaps in the archives of %s", gaps, path)
    found = rows.filter("kind = 'record'")
    return found.select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
    FROM f"""
