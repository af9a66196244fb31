"""Spelling variants, ranked search and WARC archives against brute force."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertsieve.llm import catalog, hashing, lexical, spelling, warc
from alertsieve.session import ensure_checkpoint_dir


def rows(df):
    return [tuple(r) for r in df.collect()]


# -------------------------------------------------------------- spelling --

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words, ratio):
    out = {}
    for w, n in words.items():
        others = sorted(((-m, v) for v, m in words.items() if near(w, v)))
        form = others[0][1] if others and -others[0][0] >= ratio * n else None
        out[w] = [form, w, n, len(others), words[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {(w, *v) for w, v in out.items()}


def random_words(rng, n, alphabet, most):
    words = {}
    for _ in range(n):
        w = "".join(rng.choices(alphabet, k=rng.randint(1, most)))
        words[w] = rng.choice([1, 2, 3, 20, 40, 400, 5000])
    return words


@pytest.mark.parametrize("shard_words, filter_bytes, bits", [(1 << 16, 1 << 20, 24), (20, 64, 24), (7, 1, 4)])
def test_variants_equal_brute_force(spark, shard_words, filter_bytes, bits):
    """Also with many shards and passes, and with filters that let much through."""
    rng = random.Random(shard_words)
    words = random_words(rng, 250, "abcñ𝄞", 5) | {"x" * 400: 3, "x" * 401: 900, "y" + "x" * 400: 2, "a" * 9: 2, "a" * 8: 30}
    data = [(w, n, "z") for w, n in words.items()]
    data += [(None, 5, ""), ("", 5, ""), ("none", None, ""), ("zero", 0, ""), (data[0][0], 0, "again")]
    table = spark.createDataFrame(data, "word string, n long, h string").repartition(3)
    got = rows(spelling.variant_groups(table, ratio=10, shard_words=shard_words, filter_bytes=filter_bytes,
                                       bits_per_word=bits))
    assert len(got) == len(words)
    assert set(got) == brute_variants(words, 10)


def test_variant_chains_and_empty_tables(spark):
    chain = {"aaaa": 1, "aaab": 2, "aabb": 4, "abbb": 8, "bbbb": 16, "bbbc": 32, "bbcc": 64, "bccc": 128, "cccc": 256}
    table = spark.createDataFrame(list(chain.items()), "word string, n long")
    got = rows(spelling.variant_groups(table, ratio=2))
    assert set(got) == brute_variants(chain, 2)
    assert {r[2] for r in got} == {"cccc"}
    assert rows(spelling.variant_groups(table.where("false"))) == []
    one = rows(spelling.variant_groups(table.where("word = 'aaaa'")))
    assert one == [("aaaa", None, "aaaa", 1, 0, None)]
    with pytest.raises(ValueError):
        spelling.variant_groups(table, ratio=1)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abé\U0001D11E", min_size=1, max_size=8))
def test_edit_hashes(word):
    """All deletions and all greater replacements, each once, with the hash of the edited word."""
    def h(w):
        return int(spelling.word_hashes(spelling.code_points([w], len(w)))[0]) if w else 0

    letters = "abcé\U0001D11E"
    got = Counter((int(x), size) for r, hs, size in spelling.edits(
        spelling.code_points([word], len(word)), np.array(sorted(map(ord, letters)), dtype=np.uint64), 3) for x in hs)
    want = {word[:i] + word[i + 1:] for i in range(len(word))}
    want |= {word[:i] + x + word[i + 1:] for i in range(len(word)) for x in letters if ord(x) > ord(word[i])}
    assert got == Counter((h(w), len(w)) for w in want)


def test_filters_hold_their_words():
    h = hashing.mix(np.arange(5000, dtype=np.uint64))
    parts = 3
    shards = [(9, parts, p, spelling.build_filter(h[spelling.part_of(h, parts) == p]).tobytes()) for p in range(parts)]
    everything = spelling.Filters.of(shards)
    assert everything.has(h, 9).tolist() == list(range(5000))
    others = hashing.mix(np.arange(10**6, 10**6 + 10**5, dtype=np.uint64))
    assert len(everything.has(others, 9)) < 0.01 * len(others)
    assert len(everything.has(h, 8)) == 0
    some = [spelling.Filters.of(shards[:1]).has(h, 9), spelling.Filters.of(shards[1:]).has(h, 9)]
    assert sorted(np.concatenate(some).tolist()) == list(range(5000))


def test_misspelt_words(spark):
    texts = ["Spelling spelling SPELLING, naïveté!naïveté", None, "", "short words", "Österreich" + "x" * 30000, "ÀÿÀÿÀÿÀ " * 40]
    data = [(i, t, 1) for i, t in enumerate(texts * 12)] + [(None, "Wonderful wonderful", 2)] * 2
    docs = spark.createDataFrame(data, "doc_id long, text string, word int").repartition(3)
    want = Counter()
    for i, t, _ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            want[run] += len(run) >= 7
    assert dict(rows(catalog.misspelt_words(docs))) == {w: n for w, n in want.items() if n >= 2}


# ---------------------------------------------------------- ranked search --

def terms_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_ranks(docs, items, k):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for name, text in items:
        scored = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(terms_of(text)) if c[t])
            if s:
                scored.append((-s, i is None, i, s))
        out += [(name, r + 1, i, s) for r, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return out


def search_case(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["W", "é", "7x", "中"]) + str(i) for i in range(300)]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, [1 / (j + 1) for j in range(300)], k=rng.randint(0, 40))))
            for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "., !"), (n + 3, " ".join(vocabulary) * 40), (None, docs[3][1]), (None, None)]
    docs += [(n + 4, docs[5][1])] * 70 + [(5, docs[5][1])] * 3 + [(7, "w1 w1 W1 other"), (n + 5, "w" * 50000 + " w1")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "unheardof"), (3, docs[5][1]), (3, docs[5][1]), (None, "w1 W1")]
    return docs, items


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"pass_items": 4, "seeds": 1}), (3, {"pass_terms": 20})])
def test_ranks_equal_brute_force(spark, seed, options):
    docs, items = search_case(seed)
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, k1 string").repartition(4)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    for k in (1, 50):
        got = rows(lexical.rank_documents(d, q, k=k, **options))
        assert Counter(got) == Counter(brute_ranks(docs, items, k))
    assert rows(lexical.rank_documents(d.where("false"), q)) == []
    assert rows(lexical.rank_documents(d, q.where("false"))) == []


def test_no_score_exceeds_its_bound(spark):
    """And documents are left out: the bounds are close, not merely safe."""
    docs, items = search_case(4)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    index = lexical.build_index(d)
    blocks = index.collect()
    counts = [Counter(terms_of(t)) for _, t in docs if terms_of(t)]
    assert sum(b.docs for b in blocks) == len(counts) and sum(b.terms for b in blocks) == sum(map(lambda c: sum(c.values()), counts))
    n_docs, n_terms = len(counts), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    terms = hashing.TermSet(sorted({t for _, x in items for t in terms_of(x)} & set(df)))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t.decode()] + 1))) for t in terms.terms])
    plan = lexical.Plan([0], terms, weights, [np.arange(len(weights))], n_docs, n_terms)
    truth = defaultdict(set)
    for c in counts:
        tf = np.array([c[t.decode()] for t in terms.terms])
        m = plan.length_part(np.array([sum(c.values())]))
        truth[sum(c.values())].add(int((weights * lexical.part(tf, m)).sum()))
    slack = []
    for b in blocks:
        sizes = np.frombuffer(b.sizes, "<i8")
        bound = lexical.upper_bounds(plan, plan.matrix(), b.docs, b.rows, b.most, sizes, np.frombuffer(b.bits, np.uint8))[0]
        for n, x in zip(sizes.tolist(), bound):
            assert any(s <= x for s in truth[n])
            slack.append(min((x - s) / max(x, 1) for s in truth[n] if s <= x))
    assert np.median(slack) < 0.05


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abAZ é9 .中x", max_size=40), max_size=6), st.sampled_from([1, 4, 9, 1 << 20]))
def test_terms_of_bytes(texts, window):
    data, offsets = hashing.text_bytes(pa.array([None, *texts], pa.string())[1:])
    parts = list(hashing.text_terms(data, offsets, window))
    got = [(int(i), int(h)) for p in parts for i, h in zip(p[0], p[1])]
    assert got == [(i, hashing.term_hash(t)) for i, x in enumerate(texts) for t in terms_of(x)]
    wanted = hashing.TermSet(["ab", "中", "zz", "x9"])
    found = Counter((int(i), wanted.terms[j].decode()) for p in parts for i, j in zip(*wanted.find(data, *p)))
    assert found == Counter((i, t) for i, x in enumerate(texts) for t in terms_of(x) if t.encode() in wanted.terms)


# ------------------------------------------------------------------- WARC --

def brute_warc(pages):
    groups = defaultdict(list)
    for page, url, html in pages:
        groups[(html or "").encode()].append((page is None, page, url is None, url or ""))
    out = Counter()
    for data, found in groups.items():
        found.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        digest = hashlib.sha256(data).hexdigest()
        for i, (_, page, _, _) in enumerate(found):
            again = i > 0 and len(data) >= 100
            out[(page, len(data), digest, "revisit" if again else "response", found[0][1] if again else None)] += 1
    return out


def warc_case():
    long_text = "é\r\n\r\nWARC/1.1\r\n" * 3000
    pages = [(i, f"http://x/{i}", f"<p>page {i}</p>" * (i % 30)) for i in range(200)]
    pages += [(300 + i, "http://x/same", "shared " * 40) for i in range(60)]
    pages += [(9, "u", None), (10, "u", ""), (None, None, "shared " * 40), (None, "v", "lonely " * 40), (None, None, "lonely " * 40)]
    pages += [(20, "a", long_text), (19, "a", long_text), (19, "a", long_text), (19, "b\r\nX-Page-ID: 7", long_text)]
    pages += [(5, "t", "tiny"), (5, "t", "tiny"), (6, "c", "x" * 99), (7, "c", "x" * 99), (8, "c", "y" * 100), (8, None, "y" * 100)]
    return pages


@pytest.mark.parametrize("segment, records, chunk", [(256 << 10, 2048, 64 << 10), (1000, 7, 300), (50, 3, 50)])
def test_archives_round_trip(spark, segment, records, chunk):
    """Also with payloads cut into many segments that lie in several files."""
    pages = warc_case() if segment > 50 else [p for p in warc_case() if len(p[2] or "") < 3000] + [(20, "a", "z" * 4000)]
    df = spark.createDataFrame([(*p, "0") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    path = f"{ensure_checkpoint_dir(spark)}/warc-test-{segment}-{id(pages)}"
    warc.write_archives(df, path, segment_bytes=segment, file_records=records)
    back = warc.read_records(spark, path, chunk_bytes=chunk)
    got = Counter(rows(back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")))
    assert got == brute_warc(pages)
    assert back.select("record_id").distinct().count() == len(pages)
    chunks = warc.read_chunks(spark, path, chunk_bytes=chunk)
    payloads = defaultdict(list)
    for r in chunks.collect():
        payloads[r.record_id].append(r)
        assert len(r.data) <= chunk
    for parts in payloads.values():
        parts.sort(key=lambda r: (r.segment, r.chunk))
        whole = b""
        for r in parts:
            whole += r.data
            if r.digest:
                assert (r.digest, r.bytes) == (hashlib.sha256(whole).hexdigest(), len(whole))
        assert [r.last for r in parts] == [False] * (len(parts) - 1) + [True]
        if parts[0].record_type == "response":
            assert hashlib.sha256(whole).hexdigest() == parts[0].stated_digest


def test_archives_are_plain_warc(spark):
    """A plain reader of the format finds every record where its length says."""
    pages = warc_case()
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    path = f"{ensure_checkpoint_dir(spark)}/warc-plain-{id(pages)}"
    warc.write_archives(df, path, segment_bytes=5000)
    kinds = Counter()
    for f in spark.read.format("binaryFile").load(path).collect():
        data = gzip.decompress(bytes(f.content))
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
            n = int(fields["Content-Length"])
            assert rest[n:n + 4] == b"\r\n\r\n"
            data = rest[n + 4:]
            kinds[fields["WARC-Type"]] += 1
    assert kinds["response"] + kinds["revisit"] == len(pages) and kinds["continuation"] > 5


def test_archive_errors_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "u", "payload " * 50)], "page_id long, url string, html string")
    root = f"{ensure_checkpoint_dir(spark)}/warc-errors-{id(df)}"
    warc.write_archives(df.where("false"), root + "/none")
    assert rows(warc.read_records(spark, root + "/none")) == []
    warc.write_archives(df, root + "/good")
    content = gzip.decompress(bytes(spark.read.format("binaryFile").load(root + "/good").where("length > 30").first().content))

    def read(data, name):
        spark.createDataFrame([(bytearray(data[:-1]),)], "v binary").select(F.col("v").cast("string")).coalesce(1).write.text(
            f"{root}/{name}")
        return rows(warc.read_records(spark, f"{root}/{name}"))

    assert len(read(content, "plain")) == 1
    for name, bad in (("changed", content.replace(b"payload payload", b"payload PAYLOAD", 1)), ("short", content[:-40] + b"\n"),
                      ("type", content.replace(b"WARC-Type: response", b"WARC-Type: revisit\r\nWARC-Refers-To: <x>"))):
        with pytest.raises(Exception):
            read(bad, name)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=200), max_size=5), st.integers(1, 40))
def test_gzip_members_in_pieces(parts, piece):
    data = b"".join(gzip.compress(p) for p in parts)
    assert b"".join(warc.file_pieces(data, piece)) == b"".join(parts)


# ------------------------------------------- earlier operators, mended parts --

def test_hypergeometric_law():
    """Against the exact probabilities, small and large."""
    from alertsieve.llm.sharding import hypergeometric

    rng = np.random.default_rng(0)
    for good, bad, n in ((5, 9, 6), (40, 3, 20), (30, 70, 50)):
        got = Counter(hypergeometric(good, bad, n, rng) for _ in range(20_000))
        for x in range(max(0, n - bad), min(n, good) + 1):
            p = math.comb(good, x) * math.comb(bad, n - x) / math.comb(good + bad, n)
            assert abs(got[x] / 20_000 - p) < 5 * math.sqrt(p * (1 - p) / 20_000) + 1e-4
    big = [hypergeometric(10**11 // 24, 10**11 - 10**11 // 24, 200_000, rng) for _ in range(2000)]
    mean, sd = 200_000 / 24, math.sqrt(200_000 / 24 * 23 / 24)
    assert abs(np.mean(big) - mean) < 5 * sd / math.sqrt(2000) and abs(np.std(big) / sd - 1) < 0.1
    assert hypergeometric(0, 7, 3, rng) == 0 and hypergeometric(7, 0, 3, rng) == 3 and hypergeometric(4, 4, 8, rng) == 4


def test_matrix_of_a_hundred_billion_rows():
    from alertsieve.llm import sharding

    sizes = [10**11 // 40] * 40
    m = sharding.communication_matrix(sizes, 24, 3)
    assert m.sum(axis=1).tolist() == sizes and max(m.sum(axis=0)) - min(m.sum(axis=0)) <= 1
    assert sharding._blocks(10**12, 200_000) == sharding.MOST_BLOCKS


def test_repeated_labels_certify_nothing(spark):
    """60 labelled documents stay 60, however often they are given."""
    from alertsieve.llm import quality_rules

    rng = random.Random(1)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(80))
    docs = [(i, prose(), "en") for i in range(60)]
    labels = [(i, 1) for i in range(60)]

    def certified(d, lab):
        df = spark.createDataFrame(d, "doc_id long, text string, lang string")
        counted = quality_rules.count_texts(df, id_col="doc_id", text_col="text", stratum_col="lang")
        return quality_rules.calibrate(counted, spark.createDataFrame(lab, "doc_id long, quality int"))

    more = [(i, prose(), "en") for i in range(60, 400)]
    assert certified(docs, labels) == certified(docs * 5, labels * 5) == certified(docs, labels * 5) == []
    full = certified(docs + more, [(i, 1) for i in range(400)])
    assert full and full == certified(docs + more, [(i, 1) for i in range(400)] * 2)
    # an id given as good and as bad is not labelled
    assert certified(docs + more, [(i, 1) for i in range(400)] + [(i, 0) for i in range(350)]) == []


def test_alarms_are_counted_by_document(spark, monkeypatch):
    """Many proposals in one document are one trial."""
    from alertsieve.llm import pii

    seen = []
    monkeypatch.setattr(pii, "upper_bound", lambda k, n, delta: seen.append(n) or 1.0)
    schema = "k1 long, k2 long, kind string, start long, end long, label double, f_x double"
    proposals = spark.createDataFrame([(i // 20, 0, "ip", i, i + 7, float(i % 4 == 0), float(i % 4 == 0)) for i in range(4000)],
                                      schema)
    pii._additions(proposals, fit_rows=200, limit=0.02, delta=0.05, seed=5)
    held = F.pmod(F.xxhash64(F.lit(5), "k1", "k2"), F.lit(3)) == 0
    assert set(seen) == {proposals.where(held).select("k1").distinct().count()}
