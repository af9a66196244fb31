"""URL filter, line dedup, quality rules and PII against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from alertsieve.llm import binomial, catalog, line_dedup, pii, quality_rules, url_filter

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [tuple(r) for r in df.collect()]


# ------------------------------------------------------------- URL filter --

URLS = ["https://WWW.Example.com/en/a", "http://example.com/en/x?y#z", "http://a.b.example.com/fr", "http://com",
        "http://com/", "ftp://shop.net/es/1", "http://shop.net/es", "http://notexample.com/en/", None, "", "no scheme",
        "http://", "x://y://z/en/", "http://h.com?q=/en/", "http://net/fr/#/", "http://example.com:80/en/",
        "http://" + ".".join("abcdefgh") + ".example.com/en/" + "p" * 5000, "http://net/fr/", "http://net/fr/"]


def judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[2], best[3] if best else default


def test_urls_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(URLS)] + [(None, URLS[0], "kept")],
                                  "page_id long, url string, Rule string")
    rules = spark.createDataFrame(catalog.URL_RULES, "action string, host string, path string")
    out = url_filter.filter_urls(pages, rules)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    got = sorted(rows(out.select("page_id", "host", "path", "rule", "verdict")), key=str)
    want = [(i, *judge(u, catalog.URL_RULES)) for i, u in enumerate(URLS)] + [(None, *judge(URLS[0], catalog.URL_RULES))]
    assert got == sorted(want, key=str)


def test_url_rules_edge_cases(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c/d")], "page_id long, url string")
    schema = "action string, host string, path string"
    verdict = lambda r: url_filter.filter_urls(pages, spark.createDataFrame(r, schema)).first().verdict
    assert verdict([]) == "allow"
    assert verdict([("allow", "b", "/c/d"), ("block", "a.b", "/c")]) == "block"  # same length: the longer host
    assert verdict([("allow", "b", None), ("block", "b", "")]) == "block"
    assert verdict([(None, "B", "/c")]) == "block"
    assert verdict([("block", None, "/c"), ("block", "", "/")]) == "allow"
    none = url_filter.filter_urls(pages.where("false"), spark.createDataFrame(catalog.URL_RULES, schema))
    assert none.count() == 0


# ------------------------------------------------------------- line dedup --

def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def lines_brute(docs, min_docs, min_chars=1):
    where = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            where[key_of(line)].add(i)
    bad = {k for k, d in where.items() if len(k) >= min_chars and len(d) >= min_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key_of(x) not in bad]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


LINES = [(1, "a\nB \n\nc"), (2, "b\nx\n"), (3, "\tb\r\nÉ\né"), (4, None), (5, ""), (6, "\n\n"), (6, "b\nsame id"),
         (7, "é\nq\nq\nq"), (None, "b"), (None, "B\nz"), (8, "b\nq"), (8, "b\nq"), (9, "\u00a0b"), (10, "B\n" * 20000)]


def test_lines_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in LINES], "doc_id long, text string, n_dropped long")
    for min_docs, min_chars in ((2, 1), (3, 1), (5, 1), (1, 1), (2, 2)):
        out = line_dedup.dedup_lines(docs, min_docs=min_docs, min_chars=min_chars)
        assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
        assert sorted(rows(out), key=str) == sorted(lines_brute(LINES, min_docs, min_chars), key=str)
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_lines_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in catalog.table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in lines_brute(docs, 10)}
    assert set(rows(catalog.QUERIES["op3_line_dedup"](spark, SF))) == want
    assert any(w[2] for w in want)


# ---------------------------------------------------------- quality rules --

def counts_brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if tri[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


TEXTS = [None, "", " \n\t", "one", "a b c a b c", "a a a a", "x y\nx y\n x y\n\n\n", "é # $ ü\u00a0v", "w " * 60,
         " ".join(f"w{i}" for i in range(60)), "z" * 200000]


def test_counts_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)] + [(None, "a b c a b c", None)],
                                 "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.count_texts(docs).collect()}
    for i, t in [*enumerate(TEXTS), (None, "a b c a b c")]:
        n, chars, symbols, dup, rep = counts_brute(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)


def test_quality_query(spark):
    texts = {r.doc_id: r.text for r in catalog.table(spark, SF, "documents").collect()}
    got = rows(catalog.QUERIES["op5_quality_rules"](spark, SF))
    assert len(got) == len(texts)
    for i, *counts, failed, kept in got:
        assert tuple(counts) == counts_brute(texts[i])
        assert not (failed and kept)


def test_binomial_bound():
    # closed forms: no failure in n rows, and all of them
    for n, delta in ((10, 0.05), (500, 0.003)):
        assert binomial.upper_bound(0, n, delta) == pytest.approx(1 - delta ** (1 / n), rel=1e-9)
        assert binomial.upper_bound(n, n, delta) == 1.0
        need = binomial.rows_needed(0.01, delta)
        assert binomial.upper_bound(0, need, delta) <= 0.01 < binomial.upper_bound(0, need - 1, delta)
    from math import comb
    for k, n, p in ((3, 20, 0.2), (19, 20, 0.9), (0, 5, 0.5)):
        assert binomial.cdf(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_cutoffs_hold_out_and_reject(spark):
    """Planted: good prose and symbol-ridden junk; the cutoffs reject the junk
    and at most the allowed share of good documents outside the labels."""
    import random

    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(3000)]

    def prose(junk):
        words = rng.choices(vocabulary, k=80)
        return " ".join(w + "###" if junk and i % 2 else w for i, w in enumerate(words))

    data = [(i, prose(i % 10 == 0), "en" if i % 3 else None, int(i % 10 != 0)) for i in range(9000)]
    docs = spark.createDataFrame([d[:3] for d in data], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(d[0], d[3] if d[0] % 7 else None) for d in data if d[0] < 6000] + [(None, 1)],
                                   "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()}
    good = [d[0] for d in data if d[3] and d[0] >= 6000]
    assert sum(i not in kept for i in good) / len(good) <= quality_rules.MAX_FALSE_REJECTION
    assert not any(i in kept for i, *_, q in data if not q)
    # nothing is certified without labels: all that the base rules keep stays
    assert quality_rules.keep_good(docs, labels.where("false")).count() == len(data)


def test_choose_cutoffs_stops_at_the_first_failure():
    grid = {"r": [3.0, 2.0, 1.0]}
    assert quality_rules.choose_cutoffs({"r": [0, 0, 999]}, 1000, 1, grid=grid) == {"r": 2.0}
    assert quality_rules.choose_cutoffs({"r": [999, 0, 0]}, 1000, 1, grid=grid) == {}
    assert quality_rules.choose_cutoffs({"r": [0, 0, 0]}, 10, 1, grid=grid) == {}


# -------------------------------------------------------------------- PII --

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def base_brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                    "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PII = [None, "", "none here", "a@b.c_d@e.f", "x@y x@y.z.", "é𝄞 mail bob@ex.org, 1.2.3.4.5.6.7.8", "300.1.1.1 001.02.3.255",
       "1.2.3.99999999999999999999", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111",
       "+1 (988) 555-2485 +12 3 +1234567890123456", "+1-(2) 3.4 55667 788", "1" * 3000, "@" * 50 + "a@b.c",
       "a@b.c" * 400, "9 " * 5000, "+1 555 123 4567\n" * 300, "x." * 20000, "bob [at] ex [dot] org"]


def test_base_spans_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(PII)] + [(3, PII[3], 2), (None, PII[5], 3)],
                                 "doc_id long, text string, kind int")
    out = pii.document_spans(docs).select("doc_id", "text", "kind", pii.span_text(
        F.filter("pii_spans", lambda s: s["base"])).alias("base"))
    got = rows(out)
    assert len(got) == len(PII) + 2
    for _, t, _, base in got:
        assert base == ",".join(base_brute(t)), t and t[:60]
    assert pii.document_spans(docs.where("false")).count() == 0


def test_pii_query(spark):
    texts = {r.doc_id: r.text for r in catalog.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = rows(catalog.QUERIES["op7_pii"](spark, "/root/testdata/sf0.01"))
    assert len(got) == len(texts)
    for i, n_email, n_ip, n_card, n_phone, sha, spans in got:
        want = base_brute(texts[i])
        kinds = Counter(w.split(":")[0] for w in want)
        assert (n_email, n_ip, n_card, n_phone) == tuple(kinds[k] for k in BASE)
        assert sha == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(spans.split(",")) | {""}


def test_trees_add_unusual_forms_and_leave_numbers_alone(spark):
    """Planted cards with dots between the groups (no base form) are added;
    version numbers and failing cards are not."""
    import random

    rng = random.Random(1)

    def card(sep):
        while True:
            d = "4" + "".join(rng.choices("0123456789", k=15))
            if luhn(d):
                return sep.join(d[i:i + 4] for i in range(0, 16, 4))

    def broken():
        while True:
            d = "4" + "".join(rng.choices("0123456789", k=15))
            if not luhn(d):
                return " ".join(d[i:i + 4] for i in range(0, 16, 4))

    ip = lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))
    make = [lambda: card(" "), broken, ip, lambda: card("-"),
            lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
            lambda: ".".join(str(rng.randint(300, 999)) for _ in range(4))]
    data = [(i, f"some words before {make[i % 6]()} and after") for i in range(1800)]
    data += [(5000 + i, f"some words before {card('.')} and after") for i in range(20)]
    spans = {r.doc_id: r.pii_spans for r in pii.document_spans(
        spark.createDataFrame(data, "doc_id long, text string")).collect()}
    added = [i for i, s in spans.items() if any(not x["base"] for x in s)]
    assert sum(5000 <= i for i in added) >= 15
    wrong = [(i, x["kind"], data[i][1][x["start"]:x["end"]]) for i in added if i < 5000 for x in spans[i] if not x["base"]]
    assert not wrong


def test_redact(spark):
    docs = spark.createDataFrame([(1, "é bob@ex.org und +1 555 123 4567."), (2, None), (3, "clean")],
                                 "doc_id long, text string")
    out = dict(rows(pii.document_spans(docs).select("doc_id", pii.redact(F.col("text"), F.col("pii_spans")))))
    assert out == {1: "é [email] und [phone].", 2: None, 3: "clean"}
