"""Exact search and SimHash against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from alertsieve.llm import catalog, cover_tree, simhash
from alertsieve.llm.components import smallest_reachable

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


# ----------------------------------------------------------- exact search --

def brute_top(vectors, queries, k):
    out = []
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


def test_top_k_against_brute_force(spark):
    """Clustered vectors, a third of them equal; many cells, blocks and chunks."""
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(6, 8))
    data = {i: (centers[i % 6] * (1 + i % 3) + 0.1 * rng.normal(size=8)).round(3).tolist() for i in range(500)}
    data |= {i: [0.5] * 8 for i in range(500, 750)}
    table = spark.createDataFrame(list(data.items()), "vec_id long, embedding array<float>").repartition(5)
    whole = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in data.items()}
    for options in ({}, {"block_rows": 40, "chunk_rows": 7, "sample_rows": 100}):
        got = rows(cover_tree.top_k(table, F.col("vec_id") % 50 == 0, k=5, **options))
        assert sorted(got) == brute_top(whole, range(0, 750, 50), 5)


def test_top_k_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0], "a"), (0, [1.0, 2.0], "b"), (1, [1.0, None], "a"), (2, [nan, 1.0], "a"), (3, [inf, 1.0], "a"),
            (4, None, "a"), (None, [1.0, 1.0], "a"), (5, [1.0, 1.0], "a"), (6, [1.0, 1.0], "a"), (7, [3.0], "a"),
            (8, [], "a"), (50, None, "a"), (9, [1.0, 5.0], "a"), (9, [1.0, -5.0], "a")]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string")
    got = sorted(rows(cover_tree.top_k(table, F.col("vec_id") % 50 == 0, k=5)))
    s = 256 * 256
    assert got == [(0, 1, 5, 3 * s), (0, 2, 6, 3 * s), (0, 3, 7, 3 * s), (0, 4, 8, 0), (0, 5, 9, -9 * s)]
    query = F.col("vec_id") % 50 == 0
    assert cover_tree.top_k(table.where("false"), query).count() == 0
    assert cover_tree.top_k(table.where("vec_id = 5"), query).count() == 0
    assert cover_tree.top_k(table.where("vec_id = 0"), query).count() == 0  # nothing but its own row
    big = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [1e9, 1.0])], "vec_id long, embedding array<double>")
    score = (256 * 10**9) ** 2
    most = 2**63 - 1
    assert rows(cover_tree.top_k(big, query))[0][2:] == (1, min(score + 2 * s, most))


def test_cover_tree_covers():
    points = np.random.default_rng(1).normal(size=(300, 5))
    tree = cover_tree.CoverTree(points, leaf=4)
    assert sorted(tree.below(0).tolist()) == list(range(300))
    for node in range(len(tree.center)):
        reach = np.linalg.norm(points[tree.below(node)] - tree.centers[node], axis=1).max()
        assert reach <= tree.radius[node] + 1e-9
        for child in range(tree.first[node], tree.first[node] + tree.count[node]):
            assert tree.radius[child] <= tree.radius[node] / 2 + 1e-9


def test_search_prunes():
    """Well separated clusters: most products are never made."""
    rng = np.random.default_rng(2)
    data = (rng.integers(0, 20, 2000)[:, None] == np.arange(20)) * 1000 + rng.integers(0, 20, (2000, 20))
    made = []
    original = cover_tree.products
    cover_tree.products = lambda a, b: made.append(len(a) * len(b)) or original(a, b)
    try:
        search = cover_tree.DualSearch(np.arange(100), data[:100], np.arange(2000), data, 5, np.full(100, cover_tree.NO_SCORE))
        search.run()
    finally:
        cover_tree.products = original
    assert sum(made) < 100 * 2000 / 2


# ---------------------------------------------------------------- SimHash --

def brute_fingerprint(text, k=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, radius):
    """{position: positions reachable} by plain search."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_simhash_query(spark):
    docs = rows(catalog.table(spark, SF, "documents").select("doc_id", "text"))
    docs.sort()
    fps = [brute_fingerprint(t) for _, t in docs]
    groups = brute_groups(fps, 2)
    want = {(i, f"{f:016x}", docs[g][0]) for (i, _), f, g in zip(docs, fps, groups)}
    got = rows(catalog.QUERIES["op10_simhash"](spark, SF))
    assert set(got) == want and len(got) == len(docs)
    assert any(i != c for i, _, c in got)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6])
def test_links_against_brute_force(spark, radius):
    """Chains of near fingerprints; small buckets force every way of division."""
    rng = random.Random(radius)
    fps = {0, 2**64 - 1}
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(f)
            for _ in range(rng.randint(1, radius + 1)):
                f ^= 1 << rng.randrange(64)
    fps |= {0xABCD << 48 | rng.getrandbits(12) for _ in range(150)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = brute_groups(fps, radius)
    for bucket_rows in (20_000, 16):
        links = simhash.hamming_links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius,
                                      bucket_rows=bucket_rows)
        found = rows(links.select("a", "b"))
        at = {f: i for i, f in enumerate(signed)}
        parent = list(range(len(fps)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in found:
            parent[max(root(at[a]), root(at[b]))] = min(root(at[a]), root(at[b]))
        assert [root(i) for i in range(len(fps))] == want


def test_simhash_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    data = [(5, None), (4, ""), (9, " \n"), (None, ""), (1, "Two Words"), (2, "two words"), (2, "two words"),
            (3, long), (8, long + " end"), (None, "alone null id"), (7, "\u00a0"), (6, "É x y"), (10, "é x y")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, fp int")
    out = simhash.near_duplicates(docs)
    fp = {(r.doc_id, r.fp & (2**64 - 1)) for r in out.collect()}
    assert fp == {(i, brute_fingerprint(t)) for i, t in data}
    group = {r.doc_id: r.component_id for r in out.where("doc_id is not null").collect()}
    assert group == {5: 4, 4: 4, 9: 4, 1: 1, 2: 1, 3: 3, 8: 3, 7: 7, 6: 6, 10: 10}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([4, 1, 3, 7, 6, 10, None], key=str)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_components(spark):
    """A long chain, a star and a cycle."""
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200),
                                                                                   (300, 300)]
    random.Random(0).shuffle(links)
    got = dict(rows(smallest_reachable(spark.createDataFrame(links, "a long, b long"))))
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)} | {201: 200, 202: 200}
    assert got == want
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0
