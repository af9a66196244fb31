"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint takes each bit's majority over the 64-bit hashes of
its word shingles.  Fingerprints that differ in at most ``radius`` bits link;
documents reachable over links form a group.

Two fingerprints within the radius agree on at least one of ``radius + 1``
bit blocks, so only fingerprints that share a block meet.  A bucket of more
than ``bucket_rows`` distinct fingerprints is divided again by blocks of its
remaining bits, by the same argument without loss, until every bucket is
small or there are ``MAX_PATHS`` ways of division (at radius 2: five levels,
after which a bucket has 9 free bits and so at most 512 fingerprints; buckets
that are still larger at a wide radius are compared as they are, block by
block).  Inside a task the sorted
fingerprints are stored vertically, one bit plane a row of 64-bit words; each
fingerprint is compared with 64 others at a time, their distances counted in
carry-save bit counters that overflow into an "exceeded" mask, and a word is
abandoned as soon as all of its lanes are over the radius.

Scale: equal fingerprints are aggregated map-side before anything else, so a
group of copies is one row.  A bucket yields the links of a spanning forest,
never all pairs.  Only narrow rows of fingerprints are shuffled.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertsieve.llm.common import hash128, paths_table
from alertsieve.llm.components import smallest_reachable
from alertsieve.llm.tokens import text_batches

BUCKET_ROWS = 20_000
MAX_PATHS = 500
_TASK_WORDS = 1 << 16
_LOOK = 8  # bit planes between two looks at the exceeded lanes
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """Fingerprint of a UTF-8 text (A-Z lower-cased here); no words: 0."""
    import xxhash

    words = raw.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[-n:].tolist()
    parts = [flat[a:b] for a, b in zip(starts, ends)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), "<u8", n)
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[a:a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's bits as a long) and the row key
    ``k1``, ``k2`` of every row; a null text has no words."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in text_batches(whole):
                found = np.fromiter((fingerprint(t or b"", shingle) for t in batch["text"].to_pylist()),
                                    np.uint64, batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array(found.view(np.int64)), batch["k1"], batch["k2"]],
                    ["doc_id", "fp", "k1", "k2"])

    k1, k2 = hash128(F.col(id_col), F.col(text_col))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
                         k1.alias("k1"), k2.alias("k2"))
    return narrow.mapInArrow(run, "doc_id long, fp long, k1 long, k2 long")


def bit_blocks(bits: list[int], n: int) -> list[int]:
    """``n`` masks that divide the bit positions ``bits`` evenly."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), n)]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (each node's root) after joining the pairs."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def bucket_links(fps: np.ndarray, ends: np.ndarray, radius: int, task_words: int = _TASK_WORDS) -> np.ndarray:
    """Spanning links among rows of the same bucket within the radius.

    ``fps`` (uint64) lies bucket by bucket, ``ends[i]`` is the end of row i's
    bucket.  Returns the root row of each row.
    """
    n = len(fps)
    words = -(-n // 64)
    padded = np.zeros(words * 64, dtype=np.uint64)
    padded[:n] = fps
    planes = np.empty((64, words), dtype=np.uint64)
    for b in range(64):
        planes[b] = np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(bool), bitorder="little").view("<u8")
    first = (np.arange(n) + 1) // 64
    last = (ends - 1) // 64
    per_row = np.where(ends > np.arange(n) + 1, last - first + 1, 0)
    upto = np.cumsum(per_row)
    parent = np.arange(n)
    total = int(upto[-1]) if n else 0
    bits = max(1, radius.bit_length())
    for at in range(0, total, task_words):
        task = np.arange(at, min(total, at + task_words))
        row = np.searchsorted(upto, task, side="right")
        word = first[row] + task - (upto[row] - per_row[row])
        low = np.maximum(row + 1 - 64 * word, 0).astype(np.uint64)
        high = np.minimum(ends[row] - 64 * word, 64).astype(np.uint64)
        lanes = (FULL << low) & (FULL >> (np.uint64(64) - high))
        counter = [np.zeros(len(row), dtype=np.uint64) for _ in range(bits)]
        over = np.zeros(len(row), dtype=np.uint64)
        for b in range(64):
            own = np.uint64(0) - ((fps[row] >> np.uint64(b)) & np.uint64(1))
            carry = planes[b][word] ^ own
            for j in range(bits):
                counter[j], carry = counter[j] ^ carry, counter[j] & carry
            over |= carry
            if b % _LOOK == _LOOK - 1:
                more, same = np.zeros_like(over), np.full_like(over, FULL)
                for j in reversed(range(bits)):
                    if radius >> j & 1:
                        same &= counter[j]
                    else:
                        more |= same & counter[j]
                        same &= ~counter[j]
                alive = lanes & ~(over | more)
                stay = alive != 0
                if not stay.all():
                    row, word, lanes, over, alive = row[stay], word[stay], lanes[stay], over[stay], alive[stay]
                    counter = [c[stay] for c in counter]
                lanes = alive
                if not len(row):
                    break
        if len(row):
            which, lane = np.nonzero(np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 8), axis=1,
                                                   bitorder="little"))
            parent = _unite(parent, row[which], word[which] * 64 + lane)
    return parent


def _scan(batches, radius: int, rows: int = 1 << 17):
    """Links of a partition sorted by (path, key, fp); whole buckets at a time."""
    import pyarrow as pa

    held = [np.empty((3, 0), dtype=np.int64)]
    size = 0

    def links(block):
        path, key, fp = block
        new = np.ones(len(fp), dtype=bool)
        new[1:] = (path[1:] != path[:-1]) | (key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fp)))
        pick = np.repeat(sizes > 1, sizes)  # a lone fingerprint meets nobody
        sizes = sizes[sizes > 1]
        fps = np.ascontiguousarray(fp[pick]).view(np.uint64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        root = bucket_links(fps, ends, radius)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(fps[linked].view(np.int64)),
                                           pa.array(fps[root[linked]].view(np.int64))], ["a", "b"])

    for batch in batches:
        held.append(np.array([batch[c].to_numpy(zero_copy_only=False) for c in ("path", "key", "fp")], dtype=np.int64))
        size += batch.num_rows
        if size < rows:
            continue
        block = np.concatenate(held, axis=1)
        change = np.flatnonzero((block[0, 1:] != block[0, :-1]) | (block[1, 1:] != block[1, :-1]))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield links(block[:, :cut])
        held, size = [block[:, cut:]], block.shape[1] - cut
        rows = max(rows, 2 * size)
    yield links(np.concatenate(held, axis=1))


def hamming_links(distinct: DataFrame, radius: int, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``a``, ``b`` among distinct fingerprints ``fp``: enough of the
    pairs within ``radius`` bits to connect all that they connect."""
    if not 0 <= radius < 16:
        raise ValueError("radius must be 0 to 15 bits")
    bits = list(range(64))
    masks = dict(enumerate(bit_blocks(bits, radius + 1)))  # path -> bits that agree
    parents: dict[int, list[int]] = {-1: list(masks)}
    rows, found = distinct.select("fp", F.lit(-1).alias("path")), None
    while True:
        # each row goes to every path below its own; the key is the bits that must agree
        options = F.array(*[F.struct(F.lit(up).alias("up"), F.lit(p).alias("path"), _long(masks[p]).alias("mask"))
                            for up, below in parents.items() for p in below])
        spread = (rows.withColumnRenamed("path", "was").withColumn("o", F.explode(options))
                  .where("o.up = was")
                  .select(F.col("o.path").alias("path"), F.col("fp").bitwiseAND(F.col("o.mask")).alias("key"), "fp"))
        spread = paths_table(spread, "simhash-keys")
        paths = []
        if len(masks) * (radius + 1) <= MAX_PATHS:
            hot = paths_table(spread.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n"))
                              .where(F.col("n") > bucket_rows).select("path", "key"), "simhash-hot")
            paths = [r.path for r in hot.select("path").distinct().collect()]
        cold = spread.join(hot, ["path", "key"], "left_anti") if paths else spread
        pairs = (cold.repartition("path", "key").sortWithinPartitions("path", "key", "fp")
                 .mapInArrow(lambda batches: _scan(batches, radius), "a long, b long"))
        found = pairs if found is None else found.unionByName(pairs)
        if not paths:
            return found
        rows = spread.join(hot, ["path", "key"], "left_semi").select("fp", "path")
        parents = {}
        for p in paths:
            left = [b for b in bits if not masks[p] >> b & 1]
            parents[p] = []
            for block in bit_blocks(left, min(radius + 1, len(left))):
                masks[len(masks)] = masks[p] | block
                parents[p].append(len(masks) - 1)


def _long(mask: int):
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprint and group of every row: ``doc_id``, ``fp`` (long),
    ``component_id`` (the smallest id reachable over links), ``k1``, ``k2``
    (the row's key).

    Texts without words (null, empty) have fingerprint 0 and link like others.
    Texts shorter than a shingle are one shingle.  Repeated rows and ids are
    all returned; a group of null ids only has a null ``component_id``; an
    empty table gives an empty result.
    """
    marked = paths_table(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "simhash-fp")
    classes = paths_table(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = smallest_reachable(hamming_links(classes, radius, bucket_rows=bucket_rows))
    rooted = (classes.join(roots, classes.fp == roots.node, "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return marked.join(groups, "fp").select("doc_id", "fp", "component_id", "k1", "k2", "root")


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with
    the smallest id stays (null ids last; of rows equal in id and text, one)."""
    marked = near_duplicates(docs, shingle=shingle, radius=radius, id_col=id_col, text_col=text_col)
    best = marked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2"))
                                      .alias("best"))
    keep = best.select(F.col("best.k1").alias("__k1"), F.col("best.k2").alias("__k2"))
    k1, k2 = hash128(F.col(id_col), F.col(text_col))
    return (docs.select("*", k1.alias("__k1"), k2.alias("__k2")).join(keep.hint("shuffle_hash"), ["__k1", "__k2"])
            .dropDuplicates(["__k1", "__k2"]).select(*[f"`{c}`" for c in docs.columns]))
