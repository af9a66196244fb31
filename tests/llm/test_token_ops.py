"""Token files, packing, mixing and sharding: round trips and brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alertsieve.llm import catalog, mixing, packing, sharding, token_store
from alertsieve.llm.elias_fano import EliasFano
from alertsieve.llm.tokens import Encoder
from alertsieve.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  two  spaces ", "a \n b\n\n c\t d ", "don't, we'll. 's", "x<|endoftext|> y", "é\u00a0ü \u3000 z",
       "tail ", "\n", "word," * 3000, "a,. b.c, D.", "1 2,3 4.", "\x1c x \x1d  y", "𝄞 𝄞, x"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(catalog.tokenizer_path())


def rows(df):
    return [tuple(r) for r in df.collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_the_library(spark, tokenizer):
    texts = [t or "" for t in ODD] + [r.text for r in catalog.table(spark, SF, "documents").collect()]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    with open(catalog.tokenizer_path()) as f:
        definition = f.read()
    for limit in (0, 100, 10**6):
        enc = Encoder(definition, cache_segments=limit)
        for _ in range(2):
            assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabZé.,'1\u00a0#", max_size=30), max_size=5))
def test_encoder_on_random_texts(texts):
    global _ENCODER
    if "_ENCODER" not in globals():
        with open(catalog.tokenizer_path()) as f:
            _ENCODER = Encoder(f.read())
    want = [e.ids for e in _ENCODER.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u2").tolist() for b in _ENCODER.encode(texts)] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano(steps):
    values = np.cumsum([0, *steps])
    coded, end = EliasFano.from_bytes(b"xyz" + EliasFano.encode(values).to_bytes(), 3)
    assert coded.all().tolist() == values.tolist() == [coded.select(i) for i in range(len(values))]
    assert end == 3 + len(EliasFano.encode(values).to_bytes())
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(0, 2000, 100_000))
    assert len(EliasFano.encode(values).to_bytes()) * 8 < 100_000 * 14.5  # 64 each in a plain table


def test_token_files(spark, tokenizer, tmp_path):
    data = [(i * 3 % 17, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "x"), (2, "again", "x"), (2, "again", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids string").repartition(3)
    path = f"{ensure_checkpoint_dir(spark)}/tokens-test-{id(data)}"
    token_store.write_token_files(docs, path, catalog.tokenizer_path(), 2, segment_ids=50)
    got = sorted(rows(token_store.read_token_files(spark, path).select("start", "doc_id", "n_tokens", "ids")))
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, _ in data)
    assert Counter((i, tuple(np.frombuffer(b, "<u4").tolist())) for _, i, _, b in got) == want
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    ids = [i for _, i, _, _ in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    assert len(files) > 3
    seg = token_store.Segment(bytes(max(files, key=lambda r: r.content.count(b"\x02\x00")).content))
    assert [len(seg.document(i)) for i in range(seg.n_docs)] == np.diff(seg.bounds.all()).tolist()
    token_store.write_token_files(docs.where("false"), path + "-none", catalog.tokenizer_path(), 2)
    assert token_store.read_index(spark, path + "-none").count() == 0


def test_token_query(spark, tokenizer):
    docs = sorted(rows(catalog.table(spark, SF, "documents").select("doc_id", "text")))
    want, at = [], 0
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(rows(catalog.QUERIES["op4_token_ids"](spark, SF))) == want


# ---------------------------------------------------------------- packing --

def check_packing(got, docs, tokenizer, window=2048):
    """Every id once, offsets without gaps; returns the share of padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc_id, start, length, ids_crc, doc_tokens, seq, offset in got:
        pieces[doc_id].append((start, length, ids_crc, doc_tokens))
        sequences[seq].append((offset, length))
    want = defaultdict(list)
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want[i].append(ids)
    assert set(pieces) == set(want)
    for i, texts in want.items():
        expected = Counter()
        for ids in texts:
            for a in range(0, len(ids), window):
                expected[(a, len(ids[a:a + window]), crc(ids[a:a + window]), len(ids))] += 1
        assert Counter(pieces[i]) == expected
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= window
        padding += window - at
    return padding / (len(sequences) * window)


def test_packing_query(spark, tokenizer):
    docs = rows(catalog.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text"))
    got = rows(catalog.QUERIES["op9_pack"](spark, "/root/testdata/sf0.01"))
    assert check_packing(got, docs, tokenizer) < 0.02


def test_packing_edge_cases(spark, tokenizer):
    data = [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (None, None), (3, "same"), (3, "same"), (3, "other")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in data], "doc_id long, text string, offset int")
    for window, block in ((2048, 50_000), (7, 4), (1, 100)):
        out = packing.pack_documents(docs, catalog.tokenizer_path(), 1, window=window, block_rows=block)
        check_packing(rows(out), data, tokenizer, window)
    assert packing.pack_documents(docs.where("false"), catalog.tokenizer_path(), 1).count() == 0


def test_sum_of_squares_rule():
    """The level array gives the choice of a plain search over all levels."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 21, 400).tolist()
    numbers, offsets = packing.sum_of_squares_pack(sizes, 20)
    fill, counts = {}, Counter()
    for s, number, offset in zip(sizes, numbers, offsets):
        cost = {}
        for h in [0, *[h for h in counts if counts[h] and h + s <= 20]]:
            after = counts.copy()
            if h:
                after[h] -= 1
            if h + s < 20:
                after[h + s] += 1
            cost[h] = sum(v * v for v in after.values())
        best = min(cost.values())
        assert cost[offset] == best and offset == max(h for h, c in cost.items() if c == best)
        assert fill.get(number, 0) == offset
        fill[number] = offset + s
        if offset:
            counts[offset] -= 1
        if offset + s < 20:
            counts[offset + s] += 1


# ----------------------------------------------------------------- mixing --

def brute_targets(sizes, weights, budget=1.5, epochs=2):
    total, open_, target = sum(sizes.values()) * budget, set(sizes), {}
    while open_:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > epochs * sizes[s]}
        if not over:
            target.update({s: weights[s] * level for s in open_})
            break
        target.update({s: epochs * sizes[s] for s in over})
        open_ -= over
    return target


def test_mix_query(spark):
    docs = catalog.table(spark, SF, "documents")
    got = rows(catalog.QUERIES["op6_mix_sources"](spark, SF))
    sources = {r.doc_id: r.source for r in docs.collect()}
    size, taken, target = Counter(), Counter(), {}
    for i, n, source_size, t, took in got:
        size[sources[i]] += n
        taken[sources[i]] += took
        target[sources[i]] = t
        assert 0 <= took <= 2 * n
    names = sorted(size)
    want = brute_targets(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 1
    assert sorted(got) == sorted(rows(catalog.QUERIES["op6_mix_sources"](spark, SF)))


def test_mix_documents(spark):
    data = [(i, f" w{i}  " + "x\ty " * (i % 7), ("a", "b", None)[i % 3]) for i in range(60)]
    data += [(100, None, "a"), (101, "", "c"), (102, " ", None), (None, "n u l l", "b"), (7, data[7][1], "b"),
             (7, data[7][1], "b")]
    docs = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, source string, size int")
    weights = mixing.pattern_weights(docs)
    plan = mixing.mix_plan(docs, weights)
    taken = defaultdict(int)
    for r in plan.collect():
        taken[(r.doc_id, r.source)] += r.rows * (r.whole * r.size + r.extra)
    out = mixing.mix_documents(docs, weights)
    assert out.columns == docs.columns
    words, texts = defaultdict(int), {(i, s): t for i, t, s in data}
    for i, t, s, _ in rows(out):
        n = len(t.split())
        words[(i, s)] += n
        assert texts[(i, s)].split()[:n] == t.split() and t.rstrip() in texts[(i, s)]
    assert dict(words) == {k: v for k, v in taken.items() if v}
    assert mixing.mix_documents(docs.where("false"), weights).count() == 0
    assert mixing.mix_documents(docs, weights.where("false")).count() == 0  # no weights: nothing is taken


def test_water_fill_caps(spark):
    table = spark.createDataFrame([("a", 10, 5), ("b", 1000, 1), ("c", 0, 9), ("d", 20, None), ("e", 5, -1)],
                                  "source string, source_size long, weight long")
    got = {r.source: r.target for r in mixing.water_fill(table).collect()}
    assert got == {"a": 20.0, "b": pytest.approx(1035 * 1.5 - 20), "c": 0.0, "d": 0.0, "e": 0.0}
    got = {r.source: r.target for r in mixing.water_fill(table, budget=(5, 1)).collect()}
    assert got == {"a": 20.0, "b": 2000.0, "c": 0.0, "d": 0.0, "e": 0.0}
    assert mixing.water_fill(table.where("false")).count() == 0


# --------------------------------------------------------------- sharding --

def check_shards(got, n_shards):
    slots = defaultdict(list)
    for shard, slot in got:
        slots[shard].append(slot)
    assert set(slots) <= set(range(n_shards))
    sizes = [len(slots[s]) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_shard_query(spark):
    docs = {r.doc_id: r.text for r in catalog.table(spark, SF, "documents").collect()}
    got = rows(catalog.QUERIES["op8_shard"](spark, SF))
    assert len(got) == len(docs)
    for i, size, text_crc, law, _, _, grown in got:
        raw = (docs[i] or "").encode()
        assert (size, text_crc, law, grown) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    check_shards([(r[4], r[5]) for r in got], 24)
    assert sorted(got) == sorted(rows(catalog.QUERIES["op8_shard"](spark, SF)))


def test_shard_edge_cases(spark):
    data = [(i, "t" * (i % 3)) for i in range(300)] + [(1, "same")] * 400 + [(None, None)] * 30
    docs = spark.createDataFrame([(*d, 0) for d in data], "doc_id long, text string, slot int")
    out = sharding.shuffle_documents(docs, 7, block_rows=20)
    assert out.columns == ["doc_id", "text", "shard", "slot"]
    got = rows(out)
    assert Counter(r[:2] for r in got) == Counter(data)
    check_shards([r[2:] for r in got], 7)
    few = sharding.assign_shards(docs.select("doc_id").limit(3), 24)
    check_shards(rows(few.select("shard", "slot")), 24)
    assert sharding.assign_shards(docs.select("doc_id").where("false"), 24).count() == 0


def test_communication_matrix_law():
    """Sums are exact, and one cell follows the hypergeometric mean and variance."""
    cells = np.array([sharding.communication_matrix([30, 50, 20], 4, seed)[0, 0] for seed in range(3000)])
    for seed in range(20):
        m = sharding.communication_matrix([30, 50, 21, 0], 4, seed)
        assert m.sum(axis=1).tolist() == [30, 50, 21, 0] and m.sum(axis=0).tolist() == [26, 25, 25, 25]
    n, k, total = 30, 25, 100
    assert cells.mean() == pytest.approx(n * k / total, abs=0.15)
    assert cells.var() == pytest.approx(n * k / total * (1 - k / total) * (total - n) / (total - 1), rel=0.12)


def test_shuffle_is_uniform(spark):
    """Neighbouring ids fall into the same shard as often as chance says."""
    ids = spark.range(24_000).withColumnRenamed("id", "doc_id")
    shard = [s for _, s in sorted(rows(sharding.assign_shards(ids, 24, block_rows=2000).select("doc_id", "shard")))]
    same = sum(a == b for a, b in zip(shard, shard[1:])) / (len(shard) - 1)
    assert same == pytest.approx(1 / 24, abs=0.006)
    got = sharding.assign_shards(ids, 24, block_rows=2000).select(F.corr("slot", "doc_id")).first()[0]
    assert abs(got) < 0.03
