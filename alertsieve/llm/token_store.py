"""Token-id files: one concatenated id array, Elias-Fano document boundaries.

Documents are range-partitioned and sorted by id, encoded (see
:mod:`tokens`), closed with an end id and written as binary files of up to
``SEGMENT_IDS`` ids (a longer document has a file of its own).  A file is

    magic "TOKS1\\0", id width (1 byte), 1 zero byte
    documents, ids (big-endian unsigned 64-bit each)
    ids (little-endian), document ids (int64) and their null flags (1 byte each)
    Elias-Fano coding of the documents + 1 boundaries
    one "\\n"

The files are written through Spark's text sink (the bytes as they are, one
record a file), so they reach any Hadoop file system and are committed task by
task; their names ``part-<task>-...-c<number>`` carry the order.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertsieve.llm.common import paths_table
from alertsieve.llm.elias_fano import EliasFano
from alertsieve.llm.tokens import ship_definition, text_batches, worker_encoder
from alertsieve.operators.drift import running_counts

MAGIC = b"TOKS1\0"
HEAD = 24
SEGMENT_IDS = 1 << 22
_ORDER = r"part-(\d+)-.*-c(\d+)"


def segment_bytes(ids: list[bytes], doc_ids: list, width: int) -> bytes:
    """One file's content (without the line end that the sink adds)."""
    ends = np.cumsum([0] + [len(b) // width for b in ids])
    return b"".join([MAGIC, bytes([width, 0]), struct.pack(">QQ", len(ids), int(ends[-1])), *ids,
                     np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
                     bytes(d is None for d in doc_ids), EliasFano.encode(ends).to_bytes()])


class Segment:
    """A file's content, opened: documents by position through ``select``."""

    def __init__(self, content: bytes):
        if content[:6] != MAGIC:
            raise ValueError("not a token-id file")
        width = content[6]
        self.n_docs, self.n_ids = struct.unpack_from(">QQ", content, 8)
        self.ids = np.frombuffer(content, f"<u{width}", self.n_ids, HEAD)
        at = HEAD + width * self.n_ids
        ids = np.frombuffer(content, "<i8", self.n_docs, at).tolist()
        null = content[at + 8 * self.n_docs:at + 9 * self.n_docs]
        self.doc_ids = [None if x else d for d, x in zip(ids, null)]
        self.bounds, _ = EliasFano.from_bytes(content, at + 9 * self.n_docs)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i):self.bounds.select(i + 1)]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, id_col: str = "doc_id",
                      text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every text with the ``tokenizers`` file ``tokenizer`` and write
    the files to ``path`` in ascending id order.

    A null text counts as empty: its document is the end id alone.  Null ids
    come first; rows with the same id follow each other (by a hash of their
    text) and are all kept.  An empty table writes no file with documents.
    Ids take 2 bytes if the vocabulary allows, else 4.
    """
    spark = docs.sparkSession
    definition = ship_definition(spark, tokenizer)

    def encode(batches):
        import pyarrow as pa

        enc = worker_encoder(definition.value)
        width = enc.dtype.itemsize
        if not 0 <= end_id < 1 << (8 * width):
            raise ValueError(f"end id {end_id} does not fit")
        end = end_id.to_bytes(width, "little")
        ids, names, held = [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([segment_bytes(ids, names, width)], pa.binary())], ["content"])

        for whole in batches:
            for batch in text_batches(whole):
                for name, got in zip(batch["id"].to_pylist(), enc.encode(batch["text"])):
                    if ids and held + len(got) // width + 1 > segment_ids:
                        yield flush()
                        ids, names, held = [], [], 0
                    ids.append(got + end)
                    names.append(name)
                    held += len(got) // width + 1
        if ids:
            yield flush()

    ordered = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
               .withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie")
               .sortWithinPartitions("id", "tie").select("id", "text"))
    (ordered.mapInArrow(encode, "content binary").select(F.col("content").cast("string"))
     .write.option("maxRecordsPerFile", 1).text(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``task, number, content`` of the files that hold documents."""
    name = F.element_at(F.split("path", "/"), -1)
    return (spark.read.format("binaryFile").load(path)
            .select(F.regexp_extract(name, _ORDER, 1).cast("long").alias("task"),
                    F.regexp_extract(name, _ORDER, 2).cast("long").alias("number"), "content"))


def _placed(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` of files (``task, number, start`` in the file) with ``start``
    counted over all files; ``sizes`` has each file's ids ``n``.

    The files' places are a prefix sum over range partitions; nothing is
    gathered by file, and Spark broadcasts the table of places if it is small.
    """
    order = (F.col("task") * (1 << 20) + F.col("number")).cast("double")  # exact up to 2^33 tasks
    counts = paths_table(sizes.select("task", "number", F.lit("ids").alias("feature"), order.alias("value"),
                                      F.col("n").alias("c1"), F.lit(0).alias("c2")), "token-sizes")
    before = running_counts(counts).select("value", (F.col("cum1") - F.col("c1")).alias("__before"))
    places = paths_table(counts.join(before, "value").select("task", "number", "__before"), "token-places")
    return (rows.join(places, ["task", "number"]).withColumn("start", F.col("start") + F.col("__before"))
            .drop("task", "number", "__before"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files at ``path``: ``doc_id``, ``start`` (ids of all
    documents before), ``n_tokens`` and ``ids`` (little-endian unsigned 32 bit).
    """
    files = _files(spark, path)
    # from the headers
    sizes = (files.where(F.octet_length("content") > HEAD)
             .select("task", "number", F.conv(F.hex(F.substring("content", 17, 8)), 16, 10).cast("long").alias("n")))

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for task, number, content in zip(*(batch[i].to_pylist() for i in range(3))):
                for names, part, ids in _documents(content):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([task] * len(names), pa.int64()), pa.array([number] * len(names), pa.int64()),
                        pa.array(names, pa.int64()), pa.array(part[:-1]), pa.array(np.diff(part)),
                        pa.array([ids[x:y].astype("<u4").tobytes() for x, y in zip(part, part[1:])], pa.binary()),
                    ], ["task", "number", "doc_id", "start", "n_tokens", "ids"])

    rows = files.mapInArrow(decode, "task long, number long, doc_id long, start long, n_tokens long, ids binary")
    return _placed(rows, sizes).select("doc_id", "start", "n_tokens", "ids")


def _documents(content: bytes):
    """A file's documents, a thousand at a time: ids of documents, their
    boundaries (through ``select``) and the file's id array."""
    if len(content) <= HEAD:
        return
    seg = Segment(content)
    for a in range(0, seg.n_docs, 1000):
        part = np.asarray(seg.bounds.select_range(a, min(a + 1000, seg.n_docs) + 1), dtype=np.int64)
        yield seg.doc_ids[a:a + 1000], part, seg.ids


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_token_files`, with each document's checksum
    ``ids_crc32`` in place of its ids.  Every file is read once."""
    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for task, number, content in zip(*(batch[i].to_pylist() for i in range(3))):
                for names, part, ids in _documents(content):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([task] * len(names), pa.int64()), pa.array([number] * len(names), pa.int64()),
                        pa.array(names, pa.int64()), pa.array(part[:-1]), pa.array(np.diff(part)),
                        pa.array([crc32_of_ids(ids[x:y]) for x, y in zip(part, part[1:])], pa.int64()),
                    ], ["task", "number", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = paths_table(_files(spark, path).mapInArrow(
        decode, "task long, number long, doc_id long, start long, n_tokens long, ids_crc32 long"), "token-index")
    sizes = rows.groupBy("task", "number").agg(F.sum("n_tokens").alias("n"))
    return _placed(rows, sizes).select("doc_id", "start", "n_tokens", "ids_crc32")


def crc32_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
