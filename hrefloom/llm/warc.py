"""WARC archives written and read by Spark's own sinks and sources.

Writing: one text row is one WARC record (a header, an empty line, a block),
and the sink's line separator is the record's end.  Payloads longer than
``segment_bytes`` become a first record and continuation records, so no row
of an archive is larger.  Files are gzipped; a gzip file is not split, so one
task reads a file from its start to its end.

Reading: lines go through a parser that holds a header or one chunk at most.
It gives rows of record id and chunk number, with the SHA-256 of the payload
up to and with that chunk.  A payload is never held whole.  The parser goes by
Content-Length, so payloads may hold anything, record headers included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_BYTES = 1 << 20
CHUNK_BYTES = 1 << 16
# a header that goes on beyond this is none
HEAD_BYTES = 1 << 18
# payloads shorter than this are stored again rather than revisited
LEAST_REVISIT = 100

_EOL = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_SCHEMA = (
    "archive STRING, record_no BIGINT, record_id STRING, record_type STRING, target_uri STRING, refers_to STRING, "
    "declared_digest STRING, declared_bytes BIGINT, chunk_no BIGINT, chunk BINARY, payload_bytes BIGINT, "
    "payload_digest STRING, last BOOLEAN, error STRING"
)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def mark_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` -> ``page_id, url, payload, payload_bytes, payload_digest, refers_to``.

    Of equal payloads of ``LEAST_REVISIT`` bytes or more the one with the
    smallest ``page_id`` (null last) is kept, the others refer to it.  Rows
    that share that smallest id are all kept.  Only digests and ids are
    aggregated; payloads are joined to the digests that occur more than once.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("bigint")).withColumn("payload_digest", F.sha2("payload", 256))
    large = rows.where(F.col("payload_bytes") >= LEAST_REVISIT)
    firsts = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select("payload_digest", "first_id")
    other = (F.col("payload_bytes") >= LEAST_REVISIT) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    joined = rows.join(firsts, "payload_digest", "left").withColumn("refers_to", F.when(other, F.col("first_id")))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)), F.lit(""))


def records(marked: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``mark_revisits`` rows -> ``value``: the records of the archives as text rows."""
    rid = record_id(F.col("page_id"))
    # a line break in a URL must not end its header
    uri = F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(_EOL * 2),
    )
    count = F.when(revisit, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / segment_bytes))).cast("int")
    rows = marked.select(
        "*", rid.alias("rid"), uri.alias("uri"), revisit.alias("revisit"), http.alias("http"), count.alias("segments")
    ).withColumn("segment", F.explode(F.sequence(F.lit(1), F.col("segments"))))
    piece = F.when(F.col("segments") == 1, F.col("payload")).otherwise(
        F.substring(F.col("payload"), (F.col("segment") - 1) * segment_bytes + 1, F.lit(segment_bytes))
    )
    body = F.when(F.col("revisit"), F.lit("")).otherwise(piece.cast("string"))
    first = F.col("segment") == 1
    block = F.when(first, F.concat("http", body)).otherwise(body)
    own_id = F.when(first, F.col("rid")).otherwise(F.concat(F.regexp_replace("rid", ">$", ":segment:"), F.col("segment").cast("string"), F.lit(">")))
    kind = F.when(F.col("revisit"), "revisit").when(first, "response").otherwise("continuation")
    cut = F.col("segments") > 1
    whole = F.col("payload_bytes") + F.octet_length("http")
    header = F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", own_id),
        _header("WARC-Target-URI", F.when(F.col("uri") != "", F.col("uri"))),
        F.lit(f"WARC-Date: 2024-01-01T00:00:00Z{_EOL}"),
        _header("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), F.col("payload_digest")))),
        _header("WARC-Refers-To", F.when(F.col("revisit"), record_id(F.col("refers_to")))),
        _header("WARC-Profile", F.when(F.col("revisit"), F.lit(_PROFILE))),
        _header("WARC-Segment-Number", F.when(cut, F.col("segment").cast("string"))),
        _header("WARC-Segment-Origin-ID", F.when(cut & ~first, F.col("rid"))),
        _header("WARC-Segment-Total-Length", F.when(cut & (F.col("segment") == F.col("segments")), whole.cast("string"))),
        _header("Content-Type", F.when(first, F.lit("application/http;msgtype=response"))),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_EOL),
    )
    return rows.select(F.concat(header, block).alias("value"))


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """``page_id, url, html`` -> gzipped WARC files under ``path``, a record per row.

    A null html is an empty payload, a null url leaves its header out.  An
    empty table makes archives without records.
    """
    out = records(mark_revisits(pages), segment_bytes)
    out.write.mode("overwrite").option("lineSep", _EOL * 2).option("compression", "gzip").text(path)


class ChunkParser:
    """Bytes of one archive in, chunk rows out; holds ``HEAD_BYTES`` or a chunk at most, and what it is fed at once.

    A search for the end of a header goes on where the last one stopped, so it
    is linear.  A record header of more than ``HEAD_BYTES`` is none: it is
    marked, and what follows is dropped up to the next record's first line.  An
    HTTP block whose header has no end, within that bound or at all, is payload
    from its first byte on, and is marked as well.
    """

    def __init__(self, archive: str, chunk_bytes: int):
        self.archive, self.chunk_bytes = archive, chunk_bytes
        self.buffer = bytearray()
        self.state, self.left, self.record_no, self.searched = "header", 0, -1, 0
        self.open: dict | None = None  # the payload that is being read

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.buffer += data
        while True:
            if self.state == "header":
                # separators before a record are not part of it
                lead = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
                del self.buffer[:lead]
                if lead:
                    self.searched = 0
                end = self._end_of_head(len(self.buffer))
                if end < 0 and len(self.buffer) < HEAD_BYTES:
                    return
                if end < 0:
                    yield from self._lose()
                    continue
                head = bytes(self.buffer[:end])
                del self.buffer[: end + 4]
                yield from self._begin(head)
            elif self.state == "lost":
                at = self.buffer.find(b"\r\n\r\nWARC/")
                if at < 0:
                    # the mark may be cut by the end of what was fed
                    del self.buffer[: max(0, len(self.buffer) - 8)]
                    return
                del self.buffer[: at + 4]
                self.state, self.searched = "header", 0
            elif self.state == "http":
                end = self._end_of_head(self.left)
                if end < 0 and len(self.buffer) < min(self.left, HEAD_BYTES):
                    return
                if end < 0:
                    self.open["error"] = self.open["error"] or "no end of http header"
                else:
                    self._http(bytes(self.buffer[: end + 4]))
                    del self.buffer[: end + 4]
                    self.left -= end + 4
                self.state, self.searched = "block", 0
            else:
                size = min(self.left, self.chunk_bytes - len(self.open["chunk"]))
                if len(self.buffer) < size:
                    return
                self._take(bytes(self.buffer[:size]))
                del self.buffer[:size]
                self.left -= size
                if self.left == 0:
                    self.state = "header"
                    if not self.open["more"]:
                        yield from self._close()
                elif len(self.open["chunk"]) >= self.chunk_bytes:
                    yield self._row(False)

    def _end_of_head(self, upto: int) -> int:
        end = self.buffer.find(b"\r\n\r\n", self.searched, min(upto, HEAD_BYTES))
        self.searched = 0 if end >= 0 else max(0, min(len(self.buffer), upto) - 3)
        return end

    def _lose(self) -> Iterator[tuple]:
        """A header that does not end: what was open before it is closed, and it is a record of its own."""
        if self.open is not None:
            self.open["error"] = "segments missing"
            yield from self._close()
        self.record_no += 1
        yield (self.archive, self.record_no, None, None, None, None, None, None, 0, b"", 0, None, True, "header too long")
        self.state = "lost"

    def finish(self) -> Iterator[tuple]:
        """At the end of the archive: what is open there was cut off."""
        while self.state in ("block", "http") and self.buffer:
            size = self.chunk_bytes - len(self.open["chunk"])
            self._take(bytes(self.buffer[:size]))
            del self.buffer[:size]
            if self.buffer:
                yield self._row(False)
        if self.open is not None:
            self.open["error"] = self.open["error"] or "cut off"
            yield from self._close()
        elif self.state == "header" and self.buffer.strip():
            self.record_no += 1
            yield (self.archive, self.record_no, None, None, None, None, None, None, 0, b"", 0, None, True, "no header")

    def _begin(self, head: bytes) -> Iterator[tuple]:
        lines = head.decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = fields.get("content-length", "")
        self.left = int(length) if length.isdigit() else 0
        kind = fields.get("warc-type")
        if kind == "continuation" and self.open and self.open["id"] == fields.get("warc-segment-origin-id"):
            self.open["more"] = "warc-segment-total-length" not in fields
            self.state = "block"
            return
        if self.open is not None:
            self.open["error"] = "segments missing"
            yield from self._close()
        self.record_no += 1
        error = None if lines[0].startswith("WARC/") and length.isdigit() else "bad header"
        if kind == "continuation":
            error = "origin not in this archive"
        digest = fields.get("warc-payload-digest", "")
        self.open = {
            "id": fields.get("warc-record-id"), "type": kind, "uri": fields.get("warc-target-uri"),
            "refers": fields.get("warc-refers-to"), "digest": digest.rpartition(":")[2] or None, "declared": None,
            "more": fields.get("warc-segment-number") == "1", "error": error,
            "chunk": bytearray(), "chunk_no": 0, "bytes": 0, "sha": hashlib.sha256(),
        }
        http = fields.get("content-type", "").replace(" ", "").lower().startswith("application/http")
        self.state = "http" if http and kind != "continuation" else "block"

    def _http(self, head: bytes) -> None:
        for line in head.split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            if k.strip().lower() == b"content-length" and v.strip().isdigit():
                self.open["declared"] = int(v)

    def _take(self, data: bytes) -> None:
        self.open["chunk"] += data
        self.open["sha"].update(data)
        self.open["bytes"] += len(data)

    def _row(self, last: bool) -> tuple:
        o = self.open
        row = (
            self.archive, self.record_no, o["id"], o["type"], o["uri"], o["refers"], o["digest"], o["declared"],
            o["chunk_no"], bytes(o["chunk"]), o["bytes"], o["sha"].hexdigest(), last, o["error"],
        )
        o["chunk"].clear()
        o["chunk_no"] += 1
        return row

    def _close(self) -> Iterator[tuple]:
        yield self._row(True)
        self.open = None


_ARROW = pa.schema([
    ("archive", pa.string()), ("record_no", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
    ("target_uri", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()),
    ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("last", pa.bool_()), ("error", pa.string()),
])
# rows of one Arrow batch hold about this many bytes at most
_BATCH_BYTES = 4 << 20


def _chunks(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, rows, held = None, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(_ARROW.names, zip(*rows))}, schema=_ARROW)

        def lines() -> Iterator[tuple[str, bytes]]:
            for b in batches:
                for name, line in zip(b.column(0), b.column(1)):
                    yield name.as_py(), line.as_py()

        def parsed() -> Iterator[tuple]:
            nonlocal parser
            for name, line in lines():
                if parser is None or parser.archive != name:
                    if parser is not None:
                        yield from parser.finish()
                    parser = ChunkParser(name, chunk_bytes)
                yield from parser.feed(line + b"\n")
            if parser is not None:
                yield from parser.finish()

        for row in parsed():
            rows.append(row)
            held += len(row[9]) + 400
            if held >= _BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    return run


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Gzipped WARC files -> a row per chunk of each record's payload (``CHUNK_SCHEMA``).

    ``chunk_no`` counts from 0; ``payload_bytes`` and ``payload_digest`` run up
    to and with the chunk, so the row marked ``last`` has the record's.  A
    record without payload has one empty chunk.  Content encodings are left as
    they are.  Segments are joined where they follow each other in one file;
    one whose first part is elsewhere, a header that does not parse, and a
    record cut off by the end of its file are marked in ``error``.  Files are
    read by lines, so a task holds the longest run of bytes without a line feed;
    segments keep those of our own archives short.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_name").alias("archive"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_chunks(chunk_bytes), CHUNK_SCHEMA)


def read_records(chunks: DataFrame) -> DataFrame:
    """Chunk rows -> a row per record: ``record_id, record_type, payload_bytes, payload_digest, refers_to``.

    A revisit has no payload of its own: its length is the one its stored HTTP
    header declares, its digest the one in its record header.
    """
    revisit = F.col("record_type") == "revisit"
    return chunks.where("last").select(
        "record_id", "record_type",
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "refers_to", "declared_digest", "error",
    )


def page_of(record: Column) -> Column:
    """The page a record id names."""
    return F.regexp_extract(record, "^<urn:page:(-?[0-9]+)", 1).try_cast("bigint")
