"""Packing documents into windows by the sum-of-squares online rule.

A document's ids (closed with an end id) are cut at multiples of the window
only; full pieces are windows of their own, each rest is placed online.  The
state is one array: how many windows are filled up to each level.  A piece
goes to the level (or a new window) that makes the sum of squared counts of
partially filled windows smallest; of equal choices the fullest window.

Scale: texts are encoded where they are read and only narrow piece rows move.
Pieces are dealt by hash into blocks of about ``block_rows``, each packed by
one task with 2 x ``window`` counters.  In a block the longest pieces arrive
first, which leaves the short ones to fill the gaps; what a block leaves open
at its end is a few windows, however many pieces it has.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertsieve.llm.common import hash128, paths_table
from alertsieve.llm.tokens import ship_definition, text_batches, worker_encoder

WINDOW = 2048
BLOCK_ROWS = 50_000
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def sum_of_squares_pack(sizes: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece, in the order given.

    Sizes are 1 to ``window``.  ``counts[h]`` is the number of windows filled
    up to ``h``; full windows are not counted.
    """
    counts = np.zeros(window + 1, dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(window)]
    numbers, offsets, made = [], [], 0
    for s in sizes:
        best_level, best = 0, 2 * int(counts[s]) + 1 if s < window else 0
        most = window - s
        if most:
            # change of the squares when a window moves from level h to h + s
            change = counts[s + 1:window + 1] - counts[1:most + 1]
            change = 2 * change + 2
            change[-1] = 1 - 2 * counts[most]  # the window becomes full and counts no more
            change[counts[1:most + 1] == 0] = np.iinfo(np.int64).max
            at = most - 1 - int(np.argmin(change[::-1]))
            if change[at] <= best:
                best_level = at + 1
        if best_level:
            number = waiting[best_level].pop()
            counts[best_level] -= 1
        else:
            number, made = made, made + 1
        numbers.append(number)
        offsets.append(best_level)
        if best_level + s < window:
            counts[best_level + s] += 1
            waiting[best_level + s].append(number)
    return numbers, offsets


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int, *, window: int = WINDOW,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's pieces: ``doc_id, start, length, ids_crc32, doc_tokens``.

    A null text is empty, so its one piece is the end id.  Rows are taken as
    they come: repeated rows give repeated pieces.
    """
    definition = ship_definition(docs.sparkSession, tokenizer)

    def encode(batches):
        import pyarrow as pa

        enc = worker_encoder(definition.value)
        for whole in batches:
            for batch in text_batches(whole):
                out = [[] for _ in range(5)]
                for name, got in zip(batch["id"].to_pylist(), enc.encode(batch["text"])):
                    ids = np.empty(len(got) // enc.dtype.itemsize + 1, dtype="<u4")
                    ids[:-1], ids[-1] = np.frombuffer(got, enc.dtype), end_id
                    for a in range(0, len(ids), window):
                        piece = ids[a:a + window]
                        for column, value in zip(out, (name, a, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(encode, _PIECE)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, *, window: int = WINDOW, seed: int = 11,
                   block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into windows of at most ``window`` ids.

    Returns one row a piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.  ``sequence_id`` is unique (block x 2^32 + number);
    offsets in a sequence have no gaps.  Null ids and repeated rows are packed
    like others; an empty table gives an empty result.  The same rows, seed
    and block size give the same packing.
    """
    pieces = paths_table(document_pieces(docs, tokenizer, end_id, window=window, id_col=id_col, text_col=text_col),
                         "pack-pieces")
    n_blocks = max(1, -(-pieces.count() // block_rows))
    cols = pieces.columns
    # equal pieces of repeated rows are told apart by a copy number, so that they spread over the blocks
    copies = (pieces.groupBy(*cols).agg(F.count(F.lit(1)).alias("m"))
              .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))))
    a, b = hash128(F.lit(seed), *[F.col(c) for c in (*cols, "copy")])
    dealt = copies.select(*cols, a.alias("a"), F.pmod(b, F.lit(n_blocks)).cast("int").alias("block"))

    def pack(block):
        import pyarrow as pa

        block = block.sort_by([("length", "descending"), *((c, "ascending") for c in ("a", "doc_id", "start"))])
        numbers, offsets = sum_of_squares_pack(block["length"].to_pylist(), window)
        first = (block["block"][0].as_py() if block.num_rows else 0) << 32
        return (block.select(cols).append_column("sequence_id", pa.array(np.array(numbers, dtype=np.int64) + first))
                .append_column("offset", pa.array(np.array(offsets, dtype=np.int64))))

    return dealt.groupBy("block").applyInArrow(pack, f"{_PIECE}, sequence_id long, offset long")
