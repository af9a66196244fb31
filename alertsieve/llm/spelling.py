"""Spelling variants: words one edit apart, found through Bloom filters.

Every word generates its edits (all deletions; all replacements of a code point
by a greater one) and probes blocked Bloom filters of the vocabulary, one shard
a word length.  Whatever is near to a word is a deletion or a greater
replacement of one of the two, so probing one direction finds every pair.  Only
positives leave the probing task; an exact join with the vocabulary and the
edit distance itself remove the false ones.

An edit's hash comes from the word's in one step (a polynomial hash, modulo
2^64), so no edited string is built.  A Bloom block is one 64-bit word.

Scale: a filter shard covers about ``shard_words`` words of one length and is
built by one task.  The shards are broadcast ``filter_bytes`` at a time: with a
larger vocabulary there are several passes, each of which probes its own
lengths (and hash ranges) only, so no edit is probed twice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertsieve.llm.common import paths_table
from alertsieve.llm.hashing import BASE, mix, powers

#: Filter bits a word; five of a block's 64 bits are set for each.
BITS_PER_WORD = 24
SHARD_WORDS = 1 << 14
#: Filter bytes in one broadcast.
FILTER_BYTES = 32 << 20
#: Edits that a task holds at once.
EDITS_AT_ONCE = 1 << 20
#: Words whose edits one task probes (about ten microseconds each).
PROBE_WORDS = 50_000


def code_points(words: list[str], size: int) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat.reshape(len(words), size).astype(np.uint64)


def word_hashes(points: np.ndarray) -> np.ndarray:
    return (points * powers(points.shape[1])[::-1]).sum(axis=1, dtype=np.uint64)


def edits(points: np.ndarray, alphabet: np.ndarray, at_once: int = EDITS_AT_ONCE):
    """Hashes of all edits of words of one length, in parts: (row numbers,
    hashes, length of the edited words).  Rows of several parts may repeat."""
    m, size = points.shape
    power = powers(size + 1)
    whole = word_hashes(points)
    step = max(1, at_once // max(1, m))
    # deletion at i: the points before i move one place to the front of the rest
    before = np.zeros(m, dtype=np.uint64)
    after = whole.copy()
    for a in range(0, size, step):
        rows, hashes = [], []
        for i in range(a, min(a + step, size)):
            after = after - points[:, i] * power[size - 1 - i]
            one = np.ones(m, dtype=bool) if i == 0 else points[:, i] != points[:, i - 1]  # of equal neighbours, the first
            rows.append(np.flatnonzero(one))
            hashes.append((before * power[size - 1 - i] + after)[one])
            before = before * BASE + points[:, i]
        yield np.concatenate(rows), np.concatenate(hashes), size - 1
    for x in alphabet.astype(np.uint64):
        for a in range(0, size, step):
            part = points[:, a:a + step]
            rows, cols = np.nonzero(part < x)
            yield rows, whole[rows] + (x - part[rows, cols]) * power[size - 1 - a - cols], size


def _bits(z: np.ndarray) -> np.ndarray:
    """Five of 64 bits, from the low half of a mixed hash."""
    one, out = np.uint64(1), np.zeros(len(z), dtype=np.uint64)
    for shift in (0, 6, 12, 18, 24):
        out |= one << ((z >> np.uint64(shift)) & np.uint64(63))
    return out


def _block(z: np.ndarray, blocks) -> np.ndarray:
    """Block number, from the high half of a mixed hash."""
    return ((z >> np.uint64(32)) * blocks) >> np.uint64(32)


def part_of(h: np.ndarray, parts) -> np.ndarray:
    """Shard of a hash among those of its word length."""
    return ((mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def build_filter(h: np.ndarray, bits_per_word: int = BITS_PER_WORD) -> np.ndarray:
    """The blocks of one shard."""
    z = mix(h)
    out = np.zeros(max(1, -(-len(h) * bits_per_word // 64)), dtype=np.uint64)
    np.bitwise_or.at(out, _block(z, np.uint64(len(out))).astype(np.int64), _bits(z))
    return out


@dataclass
class Filters:
    """The shards of one pass: for each word length the number of its shards,
    the first and last of them that are here, their places and sizes."""

    lengths: dict[int, tuple[int, int, np.ndarray, np.ndarray]]
    blocks: np.ndarray

    @classmethod
    def of(cls, shards: list[tuple[int, int, int, bytes]]) -> "Filters":
        """From rows (length, shards of that length, shard, blocks), in order."""
        arrays = [np.frombuffer(s[3], "<u8") for s in shards]
        starts = np.cumsum([0] + [len(a) for a in arrays])
        lengths: dict[int, tuple] = {}
        for (size, parts, part, _), start, array in zip(shards, starts.tolist(), arrays):
            _, _, places, sizes = lengths.setdefault(size, (parts, part, [], []))
            places.append(start)
            sizes.append(len(array))
        return cls({k: (n, first, np.array(p, dtype=np.int64), np.array(s, dtype=np.uint64))
                    for k, (n, first, p, s) in lengths.items()},
                   np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64))

    def has(self, h: np.ndarray, size: int) -> np.ndarray:
        """Positions of ``h`` that may be words of length ``size``; hashes that
        belong to shards of another pass are left to it."""
        if size not in self.lengths or not len(h):
            return np.zeros(0, dtype=np.int64)
        parts, first, places, sizes = self.lengths[size]
        here = None
        if parts > 1:
            shard = part_of(h, parts).astype(np.int64) - first
            here = np.flatnonzero((shard >= 0) & (shard < len(places)))
            h, shard = h[here], shard[here]
            start, blocks = places[shard], sizes[shard]
        else:
            start, blocks = places[0], sizes[0]
        z = mix(h)
        want = _bits(z)
        hit = np.flatnonzero((self.blocks[start + _block(z, blocks).astype(np.int64)] & want) == want)
        return hit if here is None else here[hit]


def vocabulary(words: DataFrame, *, word_col: str = "word", n_col: str = "n") -> DataFrame:
    """``word, n, size, h``: one row a word, counts of repeated rows added up."""
    counted = (words.where(F.col(word_col).isNotNull() & (F.length(word_col) > 0))
               .groupBy(F.col(word_col).alias("word")).agg(F.sum(F.col(n_col)).cast("long").alias("n"))
               .where(F.col("n") >= 1))

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            words = batch["word"].to_pylist()
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            h = np.zeros(len(words), dtype=np.uint64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                for a in range(0, len(at), max(1, EDITS_AT_ONCE // size)):
                    some = at[a:a + max(1, EDITS_AT_ONCE // size)]
                    h[some] = word_hashes(code_points([words[i] for i in some], size))
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(sizes), pa.array(h.view(np.int64))],
                                             ["word", "n", "size", "h"])

    return counted.mapInArrow(hashed, "word string, n long, size long, h long")


def _filter_table(words: DataFrame, shard_words: int, bits_per_word: int) -> tuple[DataFrame, list]:
    """The written shards, and (length, shards, shard, bytes) of each in order."""
    counts = sorted((r["size"], r["count"]) for r in words.groupBy("size").count().collect())
    parts = {size: -(-n // shard_words) for size, n in counts}

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            h = batch["h"].to_numpy().view(np.uint64)
            n = np.array([parts[s] for s in batch["size"].to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch["size"], pa.array(n.astype(np.int64)), pa.array(part_of(h, n).astype(np.int64)), batch["h"]],
                ["size", "parts", "part", "h"])

    def build(shard):
        import pyarrow as pa

        blocks = build_filter(shard["h"].to_numpy().view(np.uint64), bits_per_word)
        first = shard.slice(0, 1)
        return pa.table([first["size"], first["parts"], first["part"], pa.array([len(blocks) * 8], pa.int64()),
                         pa.array([blocks.astype("<u8").tobytes()], pa.binary())],
                        names=["size", "parts", "part", "bytes", "blocks"])

    table = paths_table(
        words.select("size", "h").mapInArrow(deal, "size long, parts long, part long, h long")
        .groupBy("size", "part").applyInArrow(build, "size long, parts long, part long, bytes long, blocks binary"),
        "spelling-filters")
    sizes = sorted(tuple(r) for r in table.select("size", "part", "bytes").collect())
    return table, sizes


def _passes(sizes: list[tuple[int, int, int]], filter_bytes: int) -> list[list[tuple[int, int]]]:
    """Shards in order, in groups of ``filter_bytes`` (one larger shard: alone)."""
    groups, held = [], 0
    for size, part, n in sizes:
        if not groups or held + n > filter_bytes:
            groups.append([])
            held = 0
        groups[-1].append((size, part))
        held += n
    return groups


def _positives(words: DataFrame, table: DataFrame, group: list[tuple[int, int]], alphabet: np.ndarray) -> DataFrame:
    """``word, n, near_size, near_h``: edits that one pass's filters know."""
    spark = words.sparkSession
    low, high = group[0], group[-1]
    after = (F.col("size") > low[0]) | ((F.col("size") == low[0]) & (F.col("part") >= low[1]))
    until = (F.col("size") < high[0]) | ((F.col("size") == high[0]) & (F.col("part") <= high[1]))
    rows = table.where(after & until).select("size", "parts", "part", "blocks").collect()
    shipped = spark.sparkContext.broadcast(Filters.of(sorted((r[0], r[1], r[2], bytes(r[3])) for r in rows)))
    letters = spark.sparkContext.broadcast(alphabet)

    def probe(batches):
        import pyarrow as pa

        filters, letters_ = shipped.value, letters.value
        for batch in batches:
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes).tolist():
                if size not in filters.lengths and size - 1 not in filters.lengths:
                    continue
                at = np.flatnonzero(sizes == size)
                for a in range(0, len(at), max(1, EDITS_AT_ONCE // size)):
                    some = batch.take(pa.array(at[a:a + max(1, EDITS_AT_ONCE // size)]))
                    found = []
                    for rows, h, edited in edits(code_points(some["word"].to_pylist(), size), letters_):
                        hit = filters.has(h, edited)
                        if len(hit):
                            found.append((rows[hit], h[hit], np.full(len(hit), edited)))
                    if not found:
                        continue
                    rows, h, edited = (np.concatenate(x) for x in zip(*found))
                    # equal hashes of one word's edits would join the same words twice
                    one = _distinct(rows, h, edited)
                    rows, h, edited = rows[one], h[one], edited[one]
                    part = some.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [part["word"], part["n"], pa.array(edited.astype(np.int64)), pa.array(h.view(np.int64))],
                        ["word", "n", "near_size", "near_h"])

    return words.select("word", "n", "size").mapInArrow(
        probe, "word string, n long, near_size long, near_h long")


def _distinct(rows: np.ndarray, h: np.ndarray, edited: np.ndarray) -> np.ndarray:
    order = np.lexsort((h, edited, rows))
    r, x, e = rows[order], h[order], edited[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1]) | (e[1:] != e[:-1])
    return order[new]


def near_pairs(words: DataFrame, *, bits_per_word: int = BITS_PER_WORD, shard_words: int = SHARD_WORDS,
               filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``word, n, near, near_n``: each pair of words one edit apart, once.

    ``words`` is a written :func:`vocabulary`.  The alphabet of replacements is
    the vocabulary's own (at most one row a code point is fetched).
    """
    table, sizes = _filter_table(words, shard_words, bits_per_word)
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r.c) for r in letters.collect()), dtype=np.uint64)
    found = None
    spread = words.repartition(-(-words.count() // PROBE_WORDS) or 1, "h")
    for group in _passes(sizes, filter_bytes):
        part = _positives(spread, table, group, alphabet)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where(F.lit(False))
    exact = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("size").alias("near_size"),
                         F.col("h").alias("near_h"))
    return (found.join(exact, ["near_size", "near_h"])
            .where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n"))


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """``word, root``: the end of each chain word -> form -> ..., by doubling.

    ``steps`` bounds the chains' length."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        at = paths_table(at, "spelling-roots")
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return at


def variant_groups(words: DataFrame, *, ratio: int = 10, word_col: str = "word", n_col: str = "n",
                   bits_per_word: int = BITS_PER_WORD, shard_words: int = SHARD_WORDS,
                   filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Each word's usual form and the root of its chain of forms.

    ``words`` holds words and counts; null and empty words and those without
    a count of 1 or more take no part, rows of one word are added up.  Two words are near if one
    inserted, deleted or replaced code point makes them equal.  The form is
    the near word of largest count (ties: smallest in code-point order) if
    that count is at least ``ratio`` (2 or more) times the word's own.

    Returns ``word, form, root, n, n_near, form_n``; an empty table gives an
    empty result.  A chain is short (each step multiplies the count by
    ``ratio``), and a word has at most some hundred near words for each of its
    letters, so no group grows with the corpus.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = paths_table(vocabulary(words, word_col=word_col, n_col=n_col), "spelling-words")
    both = (near_pairs(words, bits_per_word=bits_per_word, shard_words=shard_words, filter_bytes=filter_bytes)
            .select(F.explode(F.array(
                F.struct("word", F.col("near").alias("near"), F.col("near_n").alias("near_n")),
                F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
                .alias("p")).select("p.*"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    judged = paths_table(
        words.select("word", "n").join(best, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(is_form, F.col("best.near")).alias("form"),
                F.when(is_form, -F.col("best.less")).cast("long").alias("form_n")), "spelling-forms")
    most = judged.agg(F.max("n").alias("hi"), F.min(F.greatest("n", F.lit(1))).alias("lo")).first()
    steps = int(math.log(most.hi / most.lo, ratio) + 1e-9) if most.hi and most.hi > most.lo else 0
    roots = _roots(judged.where(F.col("form").isNotNull()), steps)
    return (judged.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
