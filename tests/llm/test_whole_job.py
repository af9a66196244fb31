"""What earlier versions of the corpus operators left out."""

import random

import numpy as np
from pyspark.sql import functions as F

from alertsieve.llm import pii, quality_rules, token_store
from alertsieve.llm.elias_fano import EliasFano


# -------------------------------------------------------------------- PII --

def planted(rng, n):
    """Texts with one well-formed or failing number each."""
    def card(sep, good=True):
        while True:
            d = "4" + "".join(rng.choices("0123456789", k=15))
            total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1])))
            if (total % 10 == 0) == good:
                return sep.join(d[i:i + 4] for i in range(0, 16, 4))

    make = [lambda: card(" "), lambda: card(" ", False), lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
            lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
            lambda: ".".join(str(rng.randint(300, 999)) for _ in range(4))]
    return [f"some words before {make[i % 5]()} and after" for i in range(n)]


def test_a_neighbouring_number_hides_none(spark):
    """A phone number that runs on into an address (over 15 digits: no base
    span) is proposed without it, and both of two such numbers stay."""
    texts = planted(random.Random(2), 1500)
    phone, other = "+1 (826) 555-4081", "+1 (843) 555-7672"
    texts += [f"before {phone} 190.137.223.204 after", f"before {phone} 190.137.223.204 {other} 170.106.47.218 after"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.document_spans(docs).where("doc_id >= 1500").collect()}
    for i, wanted in ((1500, {phone}), (1501, {phone, other})):
        text = texts[i]
        found = {text[s["start"]:s["end"]] for s in got[i].pii_spans if s["kind"] == pii.KINDS.index("phone") + 1}
        assert found == wanted


def test_proposals_are_all_runs_of_groups(spark):
    text = "12 (826) 555-4081 33 x1 😀 555 123 4567 bob [at] ex [dot] org. We"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = pii._matches(docs, "doc_id", "text").where("proposed").collect()
    assert all(text[r.start:r.end] == r.match for r in rows)
    assert all(text[:r.start].endswith(r.before) and text[r.end:].startswith(r.after) for r in rows)
    assert all(len(r.before) == min(r.start, pii.CONTEXT) for r in rows)
    assert {r.match for r in rows if r.kind == "phone"} == {
        "12 (826) 555", "12 (826) 555-4081", "12 (826) 555-4081 33", "(826) 555-4081", "(826) 555-4081 33",
        "555-4081 33", "555 123 4567"}
    assert {r.match for r in rows if r.kind == "email"} == {"bob [at] ex [dot] org", "bob [at] ex [dot] org. We"}


def test_of_overlapping_spans_the_best_stay(spark):
    spans = spark.createDataFrame([(1, 1, "phone", 0, 10, 0.9), (1, 1, "phone", 8, 18, 0.95), (1, 1, "card", 16, 30, 0.9),
                                   (1, 1, "phone", 28, 33, 0.8), (1, 1, "phone", 30, 35, 0.7), (1, 2, "ip", 0, 3, 0.6)],
                                  "k1 long, k2 long, kind string, start long, end long, score double")
    got = {(r.k2, r.start, r.end) for r in pii._best(spans).collect()}
    assert got == {(1, 8, 18), (1, 28, 33), (2, 0, 3)}


def test_the_cutoff_counts_all_held_out_proposals(spark, monkeypatch):
    """The sample for the trees does not bound the rows of the calibration."""
    seen = []
    monkeypatch.setattr(pii, "upper_bound", lambda k, n, delta: seen.append(n) or 1.0)
    schema = "k1 long, k2 long, kind string, start long, end long, label double, f_x double"
    proposals = spark.createDataFrame([(i, i, "ip", 0, 7, float(i % 4 == 0), float(i % 4 == 0)) for i in range(4000)],
                                      schema)
    assert pii._additions(proposals, fit_rows=200, limit=0.02, delta=0.05, seed=5) is None
    held = F.pmod(F.xxhash64(F.lit(5), "k1", "k2"), F.lit(3)) == 0
    assert set(seen) == {proposals.where(held & (F.col("label") == 0)).count()}
    assert seen[0] > 900


# ---------------------------------------------------------- quality rules --

def test_small_strata_reject_too(spark):
    """300 good labels a stratum certify nothing rule by rule, but together."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(3000)]

    def prose(junk):
        return " ".join(w + "###" * junk for w in rng.choices(vocabulary, k=80))

    data = [(i, prose(i % 10 == 0), "abcd"[i % 4], int(i % 10 != 0)) for i in range(1600)]
    docs = spark.createDataFrame([d[:3] for d in data], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(d[0], d[3]) for d in data], "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()}
    assert not any(d[0] in kept for d in data if not d[3])
    good = [d[0] for d in data if d[3]]
    assert sum(i not in kept for i in good) / len(good) <= quality_rules.MAX_FALSE_REJECTION


def test_joint_sequence_stops_at_the_first_failure():
    grid = {"r": [3.0, 2.0, 1.0], "s": [5.0, 4.0]}
    assert quality_rules.joint_path(grid) == [{"r": 3.0, "s": 5.0}, {"r": 2.0, "s": 5.0}, {"r": 1.0, "s": 4.0}]
    assert quality_rules.choose_joint([0, 0, 99], 217, 4, grid=grid) == {"r": 2.0, "s": 5.0}
    assert quality_rules.choose_joint([0, 0, 0], 216, 4, grid=grid) == {}
    assert quality_rules.choose_joint([99, 0, 0], 217, 4, grid=grid) == {}


# ------------------------------------------------------------ token files --

def test_a_run_of_offsets_by_select():
    rng = np.random.default_rng(1)
    for gaps in (rng.integers(0, 3000, 5000), np.zeros(700, int), np.array([0, 10**7, 0, 1, 10**9]), np.ones(1, int)):
        values = np.cumsum(gaps)
        coded, _ = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
        n = len(values)
        for a, b in [(0, n), (0, 0), (n, n), (n - 1, n), *np.sort(rng.integers(0, n + 1, (50, 2)), axis=1).tolist()]:
            assert coded.select_range(a, b).tolist() == values[a:b].tolist()


def test_files_are_read_through_select(spark, tmp_path):
    """Reading a file's documents does not expand its whole coding of offsets."""
    path = str(tmp_path / "f")
    content = token_store.segment_bytes([bytes(2 * (i % 5)) for i in range(2500)], list(range(2500)), 2)
    spark.createDataFrame([(bytearray(content),)], "c binary").select(F.col("c").cast("string")).coalesce(1).write.option(
        "maxRecordsPerFile", 1).text(path)
    read = token_store.read_token_files
    code = read.__code__.co_consts
    assert not any("all" in c.co_names for c in code if hasattr(c, "co_names"))
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in read(spark, path).collect())
    ends = np.cumsum([0] + [i % 5 for i in range(2500)])
    assert got == [(i, ends[i], i % 5) for i in range(2500)]
