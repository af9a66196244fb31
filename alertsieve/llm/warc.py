"""WARC archives of page payloads, as a chunked record table.

Writing is a map over the pages: a payload becomes one row a segment of at
most ``segment_bytes`` (the first a ``response`` record, the others the
format's own ``continuation`` records), or one ``revisit`` record without a
payload where an equal one is stored elsewhere.  Reading streams each file: a
payload comes back as rows (record id, chunk number, bytes) that carry the
digest of the payload up to that chunk, so the last chunk's digest is the
payload's.  No step holds a whole record: a payload whose segments lie in
several files is put together from its chunk rows, in order, by a running
digest.

The files are written through Spark's text sink (a record a row; the sink adds
the line end that closes it), gzip-compressed, so they reach any Hadoop file
system and are committed task by task.  A file holds ``FILE_RECORDS`` physical
records at most, which bounds its size.
"""

from __future__ import annotations

import hashlib
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertsieve.llm.common import paths_table

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
SEGMENT_BYTES = 256 << 10
FILE_RECORDS = 2048
#: Payload bytes in a row of the chunk table.
CHUNK_BYTES = 64 << 10
#: A repeated payload's rows are joined in so many salted parts.
SALTS = 16

_READ_BYTES = 1 << 20


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate([(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)])
                                           for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def _order(page: Column, url: Column) -> Column:
    """Smallest page id first, null ids last, then by url."""
    return F.struct(page.isNull().alias("no_page"), page.alias("page"), url.isNull().alias("no_url"), url.alias("url"))


def repeated_payloads(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``digest, first, firsts, copies``: payloads found more than once, the
    row that keeps each (smallest page id) and how many rows equal that row.
    Counted with a map-side part, so that a payload on a third of all pages is
    a row a task."""
    per_row = (pages.where(F.col("bytes") >= min_bytes).groupBy("digest", "page_id", "url")
               .agg(F.count(F.lit(1)).alias("n")))
    per_payload = per_row.groupBy("digest").agg(
        F.min(F.struct(_order(F.col("page_id"), F.col("url")).alias("key"), "n")).alias("first"),
        F.sum("n").alias("copies"))
    return per_payload.where("copies > 1").select(
        "digest", F.col("first.key").alias("first"), F.col("first.n").alias("firsts"), "copies")


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                 min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """One row a page: ``page_id, url, record_id, record_type, refers_to``
    (record id), ``digest, bytes, payload`` (null for revisits)."""
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    base = base.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    known = paths_table(repeated_payloads(base.drop("payload"), min_bytes), "warc-repeated")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = (base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
            .join(salted, ["digest", "salt"], "left"))
    large = F.col("bytes") >= min_bytes
    of_payload = _uuid(F.lit("payload"), F.col("digest"))
    own = _uuid(F.lit("row"), F.col("digest"), F.col("page_id").cast("string"), F.monotonically_increasing_id().cast("string"))
    is_first = F.col("first").isNull() | (_order(F.col("page_id"), F.col("url")) == F.col("first"))
    # rows equal to the keeper: one of them keeps the payload (below), the others revisit it
    tied = F.coalesce(F.col("firsts"), F.lit(1)) > 1
    keeps = is_first & ~tied
    out = rows.where(~(is_first & tied)).select(
        "page_id", "url", F.when(keeps & large, of_payload).otherwise(own).alias("record_id"),
        F.when(keeps, "response").otherwise("revisit").alias("record_type"),
        F.when(~keeps, of_payload).alias("refers_to"), "digest", "bytes",
        F.when(keeps, F.col("payload")).alias("payload"))
    if known.where("firsts > 1").isEmpty():
        return out
    ties = known.where("firsts > 1").select("digest", "firsts", F.col("first.page").alias("page_id"),
                                            F.col("first.url").alias("url"))
    kept = (rows.where(is_first & tied).groupBy("digest").agg(F.first("payload").alias("payload"), F.first("bytes").alias("bytes"))
            .join(ties, "digest"))
    again = ties.join(kept.select("digest", "bytes"), "digest").withColumn(
        "copy", F.explode(F.sequence(F.lit(2), F.col("firsts").cast("int"))))
    return out.unionByName(kept.select(
        "page_id", "url", of_payload.alias("record_id"), F.lit("response").alias("record_type"),
        F.lit(None).cast("string").alias("refers_to"), "digest", "bytes", "payload")).unionByName(again.select(
            "page_id", "url", _uuid(F.lit("copy"), F.col("digest"), F.col("copy").cast("string")).alias("record_id"),
            F.lit("revisit").alias("record_type"), of_payload.alias("refers_to"), "digest", "bytes",
            F.lit(None).cast("binary").alias("payload")))


def _header(name: str, value: Column) -> Column:
    """A header line; nothing for a null value.  Line ends in a value are percent-coded."""
    clean = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id",
                   url_col: str = "url", payload_col: str = "html", min_bytes: int = REVISIT_BYTES,
                   segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write a record for each row of ``pages`` to gzip-compressed WARC files.

    Payloads are the UTF-8 bytes of ``payload_col`` (null: empty).  Of rows
    with equal payloads of ``min_bytes`` or more, the one with the smallest
    page id (null ids last; then by url; equal rows: one of them) is the
    response and the others revisit it; smaller payloads are stored each time.
    Repeated rows are all written; other columns are not.  ``date`` is the
    records' date (the table holds none).  An empty table writes no record.
    """
    records = plan_records(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, min_bytes=min_bytes)
    last = F.greatest(F.lit(0), F.floor((F.col("bytes") - 1) / segment_bytes)).cast("int")
    segments = records.withColumn("parts", F.when(F.col("record_type") == "revisit", 1).otherwise(last + 1)).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
    part, parts = F.col("part"), F.col("parts")
    first = part == 1
    data = F.when(parts == 1, F.coalesce("payload", F.lit(b""))).otherwise(
        F.substring("payload", (part - 1) * segment_bytes + 1, F.lit(segment_bytes)))
    block = F.when(first, F.concat(F.lit(HTTP_HEAD.encode()), data)).otherwise(data)
    several = parts > 1
    segments = segments.withColumn("block", block)
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _header("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        _header("WARC-Record-ID", F.when(first, F.col("record_id")).otherwise(
            _uuid(F.lit("part"), F.col("record_id"), part.cast("string")))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.when(first, F.col("url"))),
        _header("X-Page-ID", F.when(first, F.col("page_id"))),
        _header("WARC-Refers-To", F.when(first, F.col("refers_to"))),
        _header("WARC-Profile", F.when(first & (F.col("record_type") == "revisit"), REVISIT_PROFILE)),
        _header("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), F.col("digest")))),
        _header("WARC-Segment-Number", F.when(several, part)),
        _header("WARC-Segment-Origin-ID", F.when(several & ~first, F.col("record_id"))),
        _header("WARC-Segment-Total-Length", F.when(several & (part == parts), F.col("bytes") + len(HTTP_HEAD))),
        _header("Content-Type", F.when(first, "application/http; msgtype=response")),
        _header("Content-Length", F.octet_length("block")), F.lit("\r\n"))
    content = F.concat(F.encode(head, "UTF-8"), F.col("block"), F.lit(b"\r\n\r"))  # the sink adds the last "\n"
    (segments.select(content.cast("string").alias("value"))
     .write.option("maxRecordsPerFile", file_records).option("compression", "gzip").text(path))


class RecordStream:
    """Records of one file, from its bytes in any pieces.

    ``feed`` yields (headers, bytes of the block, whether the record ends) as
    they come; a block arrives in pieces of at most those fed.
    """

    def __init__(self):
        self.held, self.headers, self.left, self.gap = b"", None, 0, 0

    def feed(self, piece: bytes):
        self.held += piece
        while True:
            if self.gap:  # the two line ends behind a block
                n = min(self.gap, len(self.held))
                if self.held[:n] != b"\r\n\r\n"[4 - self.gap:4 - self.gap + n]:
                    raise ValueError("a record does not end where its length says")
                self.held, self.gap = self.held[n:], self.gap - n
                if self.gap:
                    return
            if self.headers is None:
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                lines = self.held[:end].decode("utf-8").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"not a record: {lines[0][:40]!r}")
                self.headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                self.left = int(self.headers["content-length"])
                self.held = self.held[end + 4:]
            n = min(self.left, len(self.held))
            if not n and self.left:
                return
            data, self.held, self.left = self.held[:n], self.held[n:], self.left - n
            yield self.headers, data, not self.left
            if not self.left:
                self.headers, self.gap = None, 4

    def close(self) -> None:
        if self.held or self.headers is not None or self.gap:
            raise ValueError("the file ends within a record")


def file_pieces(content: bytes, piece: int = _READ_BYTES):
    """A file's bytes piece by piece; gzip members are unpacked on the way."""
    if content[:2] != b"\x1f\x8b":
        for a in range(0, len(content), piece):
            yield content[a:a + piece]
        return
    view, at = memoryview(content), 0
    while at < len(content):
        stream = zlib.decompressobj(wbits=31)
        while not stream.eof:
            feed = stream.unconsumed_tail
            if not feed:
                feed = view[at:at + piece]
                at += len(feed)
            out = stream.decompress(feed, piece)
            if not (out or len(feed) or stream.eof):
                raise ValueError("the file ends within a gzip member")
            yield out
        at -= len(stream.unused_data)


_CHUNK = ("record_id string, record_type string, page_id long, url string, refers_to string, stated_digest string, "
          "segment int, chunk int, data binary, bytes long, digest string, last boolean")
_HTTP_END = re.compile(rb"\r\n\r\n")


class _Payloads:
    """Chunk rows of one file's records, in their order.

    The digest runs on through segments that follow each other; rows of a
    segment that does not follow its predecessor carry none.
    """

    def __init__(self, chunk_bytes: int):
        self.chunk_bytes = chunk_bytes
        self.state = None  # (record id, next segment, running digest, bytes so far)
        self.rows: list[tuple] = []
        self.open = None

    def take(self, headers: dict, data: bytes, ends: bool) -> None:
        if self.open is None:
            self._begin(headers)
        o = self.open
        if o["http"]:  # the payload begins behind the HTTP head
            o["buffer"] += data
            end = _HTTP_END.search(o["buffer"])
            if end:
                o["http"], o["buffer"] = False, o["buffer"][end.end():]
            elif ends:
                o["http"], o["buffer"] = False, b""
        else:
            o["buffer"] += data
        while not o["http"] and len(o["buffer"]) >= self.chunk_bytes and not (ends and len(o["buffer"]) == self.chunk_bytes):
            self._chunk(o["buffer"][:self.chunk_bytes], False)
            o["buffer"] = o["buffer"][self.chunk_bytes:]
        if ends:
            self._chunk(o["buffer"], True)
            self.open = None

    def _begin(self, headers: dict) -> None:
        kind = headers["warc-type"]
        segment = int(headers.get("warc-segment-number", 1))
        origin = headers.get("warc-segment-origin-id", headers["warc-record-id"])
        if kind != "continuation":
            self.state = [origin, 1, hashlib.sha256(), 0]
        elif not self.state or self.state[0] != origin or self.state[1] != segment:
            self.state = None
        page = headers.get("x-page-id")
        several = "warc-segment-number" in headers
        method, _, stated = (headers.get("warc-payload-digest") or ":").partition(":")
        self.open = {"id": origin, "kind": None if kind == "continuation" else kind, "segment": segment,
                     "page": int(page) if page else None, "url": headers.get("warc-target-uri"),
                     "to": headers.get("warc-refers-to"),
                     "stated": stated if method == "sha256" else None,
                     "final": not several or "warc-segment-total-length" in headers,
                     "http": headers.get("content-type", "").startswith("application/http"), "buffer": b"", "chunk": 0}

    def _chunk(self, data: bytes, ends: bool) -> None:
        o, bytes_, digest = self.open, None, None
        if self.state:
            self.state[2].update(data)
            self.state[3] += len(data)
            bytes_, digest = self.state[3], self.state[2].hexdigest()
        self.rows.append((o["id"], o["kind"], o["page"], o["url"], o["to"], o["stated"], o["segment"], o["chunk"],
                          data, bytes_, digest, ends and o["final"]))
        o["chunk"] += 1
        if ends and self.state:
            self.state = None if o["final"] else [o["id"], o["segment"] + 1, *self.state[2:]]


def _chunk_rows(content: bytes, chunk_bytes: int):
    """Chunk rows of one file, a few at a time."""
    stream, payloads = RecordStream(), _Payloads(chunk_bytes)
    for piece in file_pieces(content):
        for headers, data, ends in stream.feed(piece):
            payloads.take(headers, data, ends)
        if payloads.rows:
            yield payloads.rows
            payloads.rows = []
    stream.close()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _arrow(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _schema():
    import pyarrow as pa

    s, i, n, b = pa.string(), pa.int32(), pa.int64(), pa.binary()
    names = [c.split()[0] for c in _CHUNK.split(", ")]
    return pa.schema(list(zip(names, [s, s, n, s, s, s, i, i, b, n, s, pa.bool_()])))


def read_chunks(spark: SparkSession, path: str, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of the archives at ``path``.

    One row a chunk: ``record_id, record_type, page_id, url, refers_to`` (a
    record id), ``stated_digest`` (the header's; these five on a record's first
    segment), ``segment, chunk`` (number in the segment), ``data``, ``bytes``
    and ``digest`` (SHA-256, both of the payload up to and with this chunk;
    null where an earlier segment lies in another file), ``last``.
    """
    def read(batches):
        schema = _schema()
        for batch in batches:
            for i in range(batch.num_rows):
                for rows in _chunk_rows(batch["content"][i].as_py(), chunk_bytes):
                    yield _arrow(rows, schema)

    return _files(spark, path).mapInArrow(read, _CHUNK)


def read_records(spark: SparkSession, path: str, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a record: ``record_id, record_type, page_id, url, refers_to``
    (the page id that a revisit's record stands for), ``payload_bytes,
    payload_digest`` (of the full payload; a revisit's is its response's).

    Records of other types than response and revisit are passed over.  A stored
    payload that differs from its stated SHA-256 raises, and so does a revisit
    of a record that is not there or has another digest.
    """
    def summarise(batches):
        """A record that lies whole in a file: its last row, without bytes;
        of others, all chunk rows."""
        schema = _schema()
        for batch in batches:
            for i in range(batch.num_rows):
                head, waiting = None, []
                for rows in _chunk_rows(batch["content"][i].as_py(), chunk_bytes):
                    out = []
                    for r in rows:
                        if r[6] == 1 and r[7] == 0:
                            out += waiting  # the record before did not end in this file
                            head, waiting = r, []
                        if head is None or head[0] != r[0]:
                            out.append(r)
                        elif r[11] and r[10]:
                            out.append((*head[:8], None, r[9], r[10], True))
                            head, waiting = None, []
                        else:
                            waiting.append(r)
                            if len(waiting) * chunk_bytes > _READ_BYTES * 16:
                                # too long to wait for its end: an oversized record goes on as chunks
                                out += waiting
                                head, waiting = None, []
                    if out:
                        yield _arrow(out, schema)
                if waiting:
                    yield _arrow(waiting, schema)

    read = paths_table(_files(spark, path).mapInArrow(summarise, _CHUNK), "warc-records")
    done = F.col("data").isNull()

    def join_chunks(batches):
        """The running digest over chunk rows in order; one row a record."""
        schema = _schema()
        head, sha, size, spot = None, None, 0, None
        for batch in batches:
            out = []
            for r in zip(*(batch[i].to_pylist() for i in range(len(schema)))):
                if head is None or head[0] != r[0]:
                    if head is not None:
                        raise ValueError(f"record {head[0]} has no end")
                    if r[6] != 1 or r[7] != 0:
                        raise ValueError(f"record {r[0]} has no beginning")
                    head, sha, size, spot = r, hashlib.sha256(), 0, (1, -1)
                if (r[6], r[7]) not in ((spot[0], spot[1] + 1), (spot[0] + 1, 0)):
                    raise ValueError(f"record {r[0]} lacks a chunk before {r[6]}/{r[7]}")
                spot = (r[6], r[7])
                sha.update(r[8])
                size += len(r[8])
                if r[11]:
                    out.append((*head[:8], None, size, sha.hexdigest(), True))
                    head = None
            if out:
                yield _arrow(out, schema)
        if head is not None:
            raise ValueError(f"record {head[0]} has no end")

    whole = read.where(done)
    if not read.where(~done).isEmpty():
        whole = whole.unionByName(read.where(~done).repartition("record_id").sortWithinPartitions(
            "record_id", "segment", "chunk").mapInArrow(join_chunks, _CHUNK))
    stated = F.col("stated_digest")
    is_response = F.col("record_type") == "response"
    checked = whole.select("record_id", "record_type", "page_id", "url", "refers_to", stated, F.col("bytes"), F.when(
        ~is_response | stated.isNull() | (stated == F.col("digest")), F.col("digest")).otherwise(
            F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("record_id")))).alias("digest"))
    revisits = checked.where("record_type = 'revisit'")
    sought = revisits.select(F.col("refers_to").alias("record_id")).distinct()
    targets = checked.where(is_response).join(sought, "record_id", "left_semi").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"), F.col("bytes").alias("to_bytes"),
        F.col("digest").alias("to_digest"))
    found = revisits.join(targets, "refers_to", "left").select(
        "record_id", "record_type", "page_id", "url", F.col("to_page").alias("refers_to"),
        F.col("to_bytes").alias("payload_bytes"),
        F.when(F.col("to_digest") == F.coalesce("stated_digest", "to_digest"), F.col("to_digest")).otherwise(F.raise_error(
            F.concat(F.lit("revisit without its response: "), F.col("record_id")))).alias("payload_digest"))
    return checked.where(is_response).select(
        "record_id", "record_type", "page_id", "url", F.lit(None).cast("long").alias("refers_to"),
        F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest")).unionByName(found)
