"""Exact ranked lexical search over bit-sliced Bloom signatures.

Index: documents of like size form blocks.  A document's signature is a Bloom
filter of its (term, level) pairs, one for each level that the term's count
reaches (1, 2, 3, 4, 6, 8, 12, ...).  A block stores signatures by bit
position: row p holds bit p of all its documents, so the documents that may
hold a term are the AND of a few rows.

Search: a term's rows overestimate in which documents, and how often, it
occurs.  Weighted sums of them bound every document's score from above.  The
documents of greatest bound are scored exactly first; their k-th best score is
a floor, and every document whose bound reaches the floor of an item is scored
exactly.  What is left out is proven to rank lower.

Scale: the index is written once, map-side, without a shuffle.  Items are
searched in passes of bounded size; per pass the documents are read for exact
document frequencies and for the texts of candidates only.  Term frequencies
are counted on the bytes of whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alertsieve.llm.common import ascii_lower, hash128, paths_table
from alertsieve.llm.hashing import TermSet, mix, text_bytes, text_terms
from alertsieve.llm.tokens import text_batches

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents in a block, and bytes of its bit rows.
BLOCK_DOCS = 1024
BLOCK_BYTES = 4 << 20
#: Signature bits for each (term, level) pair of the largest document, and bits set for each.
BITS_PER_PAIR = 20
PROBES = 6
#: Rows of a block; a document with more pairs than that allows has looser bounds.
MOST_ROWS = 1 << 22
#: Items and distinct terms searched in one pass.
PASS_ITEMS = 512
PASS_TERMS = 16_384
#: Up to so many candidates (16 bytes each) go to the documents as a broadcast; more are joined by shuffle.
BROADCAST_KEYS = 250_000

_INDEX = "docs int, rows int, most long, terms long, keys binary, sizes binary, bits binary"


def levels(most: int) -> list[int]:
    """Counts that have pairs of their own: 1, 2, 3, 4, 6, 8, 12, 16, ..."""
    out, i = [1], 1
    while out[-1] < most:
        out.append(1 << i)
        out.append(3 << (i - 1))
        i += 1
    return [x for x in sorted(out) if x <= most]


def _rows(h: np.ndarray, level: np.ndarray | int, rows: int) -> np.ndarray:
    """The bit rows of (term hash, level number) pairs: pairs x ``PROBES``."""
    z = mix(h + np.uint64(0x632BE59BD9B4E019) * np.asarray(level, dtype=np.uint64))
    a, b = z & np.uint64(0xFFFFFFFF), (z >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(rows)).astype(np.int64)


def _counts(data: np.ndarray, offsets: np.ndarray):
    """(text number, term hash, count) of all distinct terms, by text; and each text's terms."""
    parts = [(t, h) for t, h, _, _ in text_terms(data, offsets)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    text, h = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])]) if len(text) else np.zeros(0, np.int64)
    return text[new], h[new], np.diff(np.r_[new, len(text)]), np.bincount(text, minlength=len(offsets) - 1)


class _Block:
    """Signatures of one size class, until the block is full."""

    def __init__(self):
        self.docs, self.pairs = [], 0  # (key, size, term hashes, counts)

    def add(self, key: bytes, size: int, h: np.ndarray, counts: np.ndarray, pairs: int) -> None:
        self.docs.append((key, size, h, counts))
        self.pairs = max(self.pairs, pairs)

    def full(self) -> bool:
        return len(self.docs) >= BLOCK_DOCS or self.pairs * BITS_PER_PAIR * (len(self.docs) // 8 + 1) > BLOCK_BYTES

    def row(self) -> dict:
        n, most = len(self.docs), max(int(c.max()) for *_, c in self.docs)
        rows = min(MOST_ROWS, max(64, self.pairs * BITS_PER_PAIR))
        bits = np.zeros((rows, -(-n // 8)), dtype=np.uint8)
        doc = np.repeat(np.arange(n), [len(h) for _, _, h, _ in self.docs])
        h = np.concatenate([h for _, _, h, _ in self.docs])
        counts = np.concatenate([c for *_, c in self.docs])
        for i, least in enumerate(levels(most)):
            some = counts >= least
            doc, h, counts = doc[some], h[some], counts[some]
            for at in _rows(h, i, rows).T:
                np.bitwise_or.at(bits, (at, doc >> 3), (128 >> (doc & 7)).astype(np.uint8))
        sizes = np.array([s for _, s, _, _ in self.docs], dtype="<i8")
        return {"docs": n, "rows": rows, "most": most, "terms": int(sizes.sum()),
                "keys": b"".join(k for k, *_ in self.docs), "sizes": sizes.tobytes(), "bits": bits.tobytes()}


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, k1, k2``: equal rows share a key."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    a, b = hash128(F.col("id"), F.col("text"))
    return narrow.select("id", "text", a.alias("k1"), b.alias("k2"))


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index: one row a block.  Documents without a term are left out."""

    def index(batches):
        import pyarrow as pa

        def batch_of(row):
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(
                [("docs", pa.int32()), ("rows", pa.int32()), ("most", pa.int64()), ("terms", pa.int64()),
                 ("keys", pa.binary()), ("sizes", pa.binary()), ("bits", pa.binary())]))

        blocks: dict[int, _Block] = {}
        for whole in batches:
            for batch in text_batches(whole, most=1 << 20):
                keys = np.stack([batch[k].to_numpy(zero_copy_only=False) for k in ("k1", "k2")], axis=1).astype("<i8")
                text, h, counts, sizes = _counts(*text_bytes(batch["text"]))
                bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
                ladder = np.array(levels(int(counts.max()) if len(counts) else 1))
                reached = np.concatenate([[0], np.cumsum(np.searchsorted(ladder, counts, side="right"))])
                pairs = (reached[bounds[1:]] - reached[bounds[:-1]]).tolist()
                for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    if a == b:
                        continue
                    kind = int(2 * math.log2(pairs[i]))
                    block = blocks.setdefault(kind, _Block())
                    block.add(keys[i].tobytes(), int(sizes[i]), h[a:b].copy(), counts[a:b].copy(), pairs[i])
                    if block.full():
                        yield batch_of(blocks.pop(kind).row())
        for block in blocks.values():
            yield batch_of(block.row())

    return paths_table(_keyed(docs, id_col, text_col).select("k1", "k2", "text").mapInArrow(index, _INDEX), "lexical-index")


@dataclass
class Plan:
    """One pass: its items and terms with weights, and the corpus's size."""

    items: list[int]
    terms: TermSet
    weights: np.ndarray  # of each term
    of_item: list[np.ndarray]  # term numbers of each item
    docs: int
    words: int

    def length_part(self, sizes: np.ndarray) -> np.ndarray:
        """``m`` of documents with so many terms."""
        return 50 + (50 * sizes * self.docs) // self.words

    def matrix(self) -> np.ndarray:
        exact = max((int(self.weights[t].sum()) for t in self.of_item), default=0) < 1 << 24
        out = np.zeros((len(self.items), len(self.weights)), dtype=np.float32 if exact else np.float64)
        for i, t in enumerate(self.of_item):
            out[i, t] = self.weights[t]
        return out


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term counts in a document, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def upper_bounds(plan: Plan, weights: np.ndarray, n: int, rows: int, most: int, sizes: np.ndarray,
                 bits: np.ndarray) -> np.ndarray:
    """Items x documents of a block: no document scores more."""
    bits = bits.reshape(rows, -1)
    m, ladder = plan.length_part(sizes), levels(most)
    out = np.zeros((len(weights), n))
    alive, last = np.flatnonzero(plan.weights > 0), np.zeros(n, dtype=np.int64)
    for i in range(len(ladder)):
        at = _rows(plan.terms.hashes[alive], i, rows)
        there = bits[at[:, 0]]
        for p in range(1, PROBES):
            there &= bits[at[:, p]]
        some = there.any(axis=1)
        alive, there = alive[some], there[some]
        if not len(alive):
            break
        least_next = ladder[i + 1] if i + 1 < len(ladder) else most + 1
        top = part(np.maximum(np.minimum(least_next - 1, sizes), 1), m)
        gain = (top - last).astype(np.float64)
        last = top
        for a in range(0, len(alive), 2048):
            held = np.unpackbits(there[a:a + 2048], axis=1)[:, :n].astype(weights.dtype)
            out += (weights[:, alive[a:a + 2048]] @ held) * gain
    return out


def _blocks(batches):
    for batch in batches:
        cols = [batch[c] for c in ("docs", "rows", "most", "keys", "sizes", "bits")]
        for i in range(batch.num_rows):
            n, rows, most, keys, sizes, bits = (c[i] for c in cols)
            yield (n.as_py(), rows.as_py(), most.as_py(), np.frombuffer(keys.as_buffer(), "<i8").reshape(-1, 2),
                   np.frombuffer(sizes.as_buffer(), "<i8"), np.frombuffer(bits.as_buffer(), np.uint8))


def _candidates(index: DataFrame, plan, keep: int | None, floor: list[int] | None) -> DataFrame:
    """``item, k1, k2, bound``: each task's ``keep`` greatest bounds an item,
    or all that reach the item's floor."""

    def search(batches):
        import pyarrow as pa

        held = plan.value
        weights = held.matrix()
        least = np.maximum(np.array(floor if floor else [1] * len(held.items), dtype=np.float64), 1)[:, None]

        def rows(item, keys, bound):
            return pa.RecordBatch.from_arrays(
                [pa.array(item.astype(np.int64)), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                 pa.array(bound.astype(np.int64))], ["item", "k1", "k2", "bound"])

        best = np.zeros((len(held.items), 0))
        names = np.zeros((len(held.items), 0, 2), dtype=np.int64)
        for n, height, most, keys, sizes, bits in _blocks(batches):
            bound = upper_bounds(held, weights, n, height, most, sizes, bits)
            if keep is None:
                item, doc = np.nonzero(bound >= least)
                if len(item):
                    yield rows(item, keys[doc], bound[item, doc])
                continue
            best = np.concatenate([best, bound], axis=1)
            names = np.concatenate([names, np.broadcast_to(keys, (len(best), *keys.shape))], axis=1)
            if best.shape[1] > keep:
                top = np.argpartition(best, best.shape[1] - keep, axis=1)[:, -keep:]
                best = np.take_along_axis(best, top, axis=1)
                names = np.take_along_axis(names, top[:, :, None], axis=1)
        if keep is not None and best.size:
            item, at = np.nonzero(best >= least)
            yield rows(item, names[item, at], best[item, at])

    return index.select("docs", "rows", "most", "keys", "sizes", "bits").mapInArrow(
        search, "item long, k1 long, k2 long, bound long")


def document_frequencies(docs: DataFrame, terms, id_col: str, text_col: str) -> DataFrame:
    """``term, df``: in how many documents each term of the set occurs (0: no row)."""

    def count(batches):
        import pyarrow as pa

        wanted = terms.value
        total = np.zeros(len(wanted.terms), dtype=np.int64)
        for whole in batches:
            for batch in text_batches(whole, most=1 << 20):
                data, offsets = text_bytes(batch["text"])
                seen = [wanted.find(data, *p) for p in text_terms(data, offsets)]
                if seen:
                    text, term = (np.concatenate(x) for x in zip(*seen))
                    total += np.bincount(np.unique(text * len(total) + term) % len(total), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    return (docs.select(F.col(text_col).alias("text")).mapInArrow(count, "term long, df long")
            .groupBy("term").agg(F.sum("df").alias("df")))


def _scores(docs: DataFrame, wanted: DataFrame, plan, id_col: str, text_col: str) -> DataFrame:
    """``item, id, score, copies`` of the candidates ``item, k1, k2``, exactly."""
    asked = paths_table(wanted.groupBy("k1", "k2", "item").agg(F.count(F.lit(1)).alias("copies"))
                        .groupBy("k1", "k2").agg(F.collect_list(F.struct("item", "copies")).alias("asked")),
                        "lexical-candidates")
    keys = asked.select("k1", "k2")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    texts = _keyed(docs, id_col, text_col).join(keys, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    rows = texts.join(asked, ["k1", "k2"]).select(
        "id", "text", F.transform("asked", lambda x: x["item"]).alias("items"),
        F.transform("asked", lambda x: x["copies"]).alias("copies"))

    def score(batches):
        import pyarrow as pa

        held = plan.value
        for whole in batches:
            for batch in text_batches(whole, most=1 << 20):
                data, offsets = text_bytes(batch["text"])
                sizes, seen = np.zeros(batch.num_rows, dtype=np.int64), []
                for p in text_terms(data, offsets):
                    sizes += np.bincount(p[0], minlength=batch.num_rows)
                    seen.append(held.terms.find(data, *p))
                text, term = (np.concatenate(x) for x in zip(*seen)) if seen else (np.zeros(0, np.int64),) * 2
                order = np.argsort(text, kind="stable")
                bounds, term = np.searchsorted(text[order], np.arange(batch.num_rows + 1)), term[order]
                m = held.length_part(sizes)
                out = [[], [], [], []]
                for i, (name, items, copies) in enumerate(zip(*(batch[c].to_pylist() for c in ("id", "items", "copies")))):
                    tf = np.bincount(term[bounds[i]:bounds[i + 1]], minlength=len(held.weights))
                    worth = held.weights * part(tf, m[i])
                    for item, c in zip(items, copies):
                        for column, v in zip(out, (item, name, int(worth[held.of_item[item]].sum()), c)):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["item", "id", "score", "copies"])

    return rows.mapInArrow(score, "item long, id long, score long, copies long")


def _best(scored: DataFrame, k: int) -> DataFrame:
    """``item, rank, id, score``: the ``k`` best rows of each item."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    each = scored.where("score > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    return (each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item", "rank", "id", "score"))


def _search_pass(docs: DataFrame, index: DataFrame, rows: list, n_docs: int, n_terms: int, k: int, seeds: int,
                 id_col: str, text_col: str) -> DataFrame:
    """``no, rank, id, score`` of the items ``rows`` (number, terms)."""
    spark = docs.sparkSession
    terms = TermSet(sorted({t for r in rows for t in r["words"]}))
    number = {t: i for i, t in enumerate(terms.terms)}
    found = document_frequencies(docs, spark.sparkContext.broadcast(terms), id_col, text_col).collect()
    weights = np.zeros(len(number), dtype=np.int64)
    for r in found:
        weights[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    of_item = [np.array([number[t.encode()] for t in r["words"]], dtype=np.int64) for r in rows]
    plan = spark.sparkContext.broadcast(Plan([r["no"] for r in rows], terms, weights, of_item, n_docs, n_terms))
    # the floor: the k-th best exact score among the documents of greatest bound
    top = Window.partitionBy("item").orderBy(F.desc("bound"), "k1", "k2")
    first = (_candidates(index, plan, seeds, None).withColumn("r", F.row_number().over(top))
             .where(F.col("r") <= seeds).select("item", "k1", "k2"))
    known = _best(_scores(docs, first, plan, id_col, text_col), k).where(F.col("rank") == k)
    floor = [0] * len(rows)
    for r in known.select("item", "score").collect():
        floor[r["item"]] = r["score"]
    scored = _scores(docs, _candidates(index, plan, None, floor).select("item", "k1", "k2"), plan, id_col, text_col)
    names = spark.createDataFrame([(i, r["no"]) for i, r in enumerate(rows)], "item long, no long")
    return paths_table(_best(scored, k).join(names, "item").select("no", "rank", "id", "score"), "lexical-best")


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 50, seeds: int | None = None, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                   index: DataFrame | None = None, pass_items: int = PASS_ITEMS, pass_terms: int = PASS_TERMS) -> DataFrame:
    """The ``k`` best documents for each item: ``item_id, rank, doc_id, score``
    (named by ``item_col`` and ``id_col``).

    Every row of ``docs`` is a document and every row of ``items`` an item,
    repeated rows included; two items of one id have ranks of their own.  Null
    and empty texts have no terms: such items give no rows, such documents no
    score.  Equal scores rank by ascending document id, null ids last.  Empty
    tables give an empty result.  ``seeds`` (default 2 ``k``) documents an item
    set the floor; their number changes the work, not the result.
    """
    spark = docs.sparkSession
    index = build_index(docs, id_col=id_col, text_col=text_col) if index is None else index
    n_docs, n_terms = (x or 0 for x in index.agg(F.sum("docs"), F.sum("terms")).first())
    asked = paths_table(items.select(
        F.col(item_col).alias("item_name"),
        F.array_distinct(F.regexp_extract_all(ascii_lower(F.col(item_text_col)), F.lit(f"({TERM})"), 1)).alias("words"))
        .where(F.size("words") > 0).withColumn("no", F.monotonically_increasing_id()), "lexical-items")
    n_items, words = asked.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    empty = spark.createDataFrame([], "no long, rank int, id long, score long")
    passes = max(-(-n_items // pass_items), -(-(words or 0) // pass_terms)) if n_docs else 0
    found = []
    for p in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("no"), F.lit(passes)) == p).select("no", "words").collect()
        if rows:
            found.append(_search_pass(docs, index, rows, n_docs, n_terms, k, seeds or 2 * k, id_col, text_col))
    best = empty
    for one in found:
        best = best.unionByName(one)
    return best.join(asked.select("no", "item_name"), "no").select(
        F.col("item_name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
