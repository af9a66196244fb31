"""The numbered queries of the corpus operators and their DuckDB twins.

A query applies its operator, with production parameters, to a whole table and
derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertsieve.llm import (cover_tree, lexical, line_dedup, mixing, packing, pii, quality_rules, sharding, simhash, spelling,
                            token_store, url_filter, warc)
from alertsieve.llm.common import ascii_lower
from alertsieve.session import ensure_checkpoint_dir, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)
        build.__name__, build.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------- URL filter --

#: Fixed values of the contract: (action, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

_RULES_SQL = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)
SQL_URL = rf"""
WITH rules(action, r_host, r_path) AS (VALUES {_RULES_SQL}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
         FROM pages),
split AS (SELECT row_number() OVER () AS rid, page_id,
                 translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r, '^([^/?#]*)([^?#]*)', 2) AS path FROM rest),
fits AS (SELECT s.rid, max(struct_pack(n := length(r_host) + length(r_path), h := length(r_host),
                                       rule := r_host || r_path, action := action)) AS best
         FROM split s JOIN rules ON (s.host = r_host OR ends_with(s.host, '.' || r_host))
                                AND starts_with(s.path, r_path) GROUP BY s.rid)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict
FROM split LEFT JOIN fits USING (rid)
"""


@query("op1_url_filter", SQL_URL)
def op1_url_filter(spark, sf_dir):
    """Every page's URL against the contract's five rules."""
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


# ----------------------------------------------------------- exact search --

SQL_TOPK = r"""
WITH vecs AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
           FROM vecs q JOIN vecs c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


@query("op2_top_k", SQL_TOPK)
def op2_top_k(spark, sf_dir):
    """The 5 best rows of all embeddings for each row whose id is divisible by 50."""
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


# ------------------------------------------------------------- line dedup --

SQL_LINES = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM (SELECT DISTINCT key, doc_id FROM keyed WHERE length(key) >= 1)
             GROUP BY key HAVING count(*) >= 10),
marked AS (SELECT rid, doc_id, line, pos, key IN (SELECT key FROM frequent) AS bad FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""


@query("op3_line_dedup", SQL_LINES)
def op3_line_dedup(spark, sf_dir):
    """Line dedup of all documents: keys of 1 code point or more in 10 documents or more go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


# ---------------------------------------------------------- quality rules --

@query("op5_quality_rules")
def op5_quality_rules(spark, sf_dir):
    """Counts and verdicts of all documents; cutoffs from all labels, a stratum for each language."""
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


# ----------------------------------------------------------------- mixing --

MIX_WEIGHTS = (5, 2, 1)
MIX_BUDGET = (3, 2)
MIX_EPOCHS = 2

SQL_MIX = r"""
WITH rows_ AS (SELECT doc_id, source, md5(coalesce(text, '')) AS t, text IS NULL AS no_text,
                      coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, count(*) AS m
               FROM documents GROUP BY ALL),
sized AS (SELECT source, sum(size * m)::HUGEINT AS s FROM rows_ GROUP BY source),
ranked AS (SELECT source, s, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS w
           FROM sized),
tot AS (SELECT sum(s) AS s, sum(w) AS w FROM ranked),
walk AS (SELECT r.*, 3 * tot.s - 2 * coalesce(sum(2 * r.s) OVER o, 0) AS a,
                2 * (tot.w - coalesce(sum(r.w) OVER o, 0)) AS b
         FROM ranked r, tot
         WINDOW o AS (ORDER BY r.s::DOUBLE / r.w::DOUBLE, r.source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
full_ AS (SELECT *, w * a > 2 * s * b AS capped FROM walk),
level AS (SELECT 3 * (SELECT s FROM tot) - 2 * coalesce(sum(2 * s) FILTER (WHERE capped), 0) AS a,
                 2 * sum(w) FILTER (WHERE NOT capped) AS b FROM full_),
targets AS (SELECT source, s::BIGINT AS source_size,
                   CASE WHEN capped THEN (2 * s)::DOUBLE ELSE (w * level.a)::DOUBLE / level.b::DOUBLE END AS target
            FROM full_, level),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole
         FROM targets),
got AS (SELECT r.*, p.source_size, p.target, p.whole,
               greatest(0, least(r.size * r.m, floor(p.target + 0.5)::BIGINT - p.whole * p.source_size
                   - coalesce(sum(r.size * r.m) OVER (PARTITION BY r.source
                         ORDER BY md5('mix:' || coalesce(r.doc_id::VARCHAR, '')), r.doc_id NULLS FIRST, r.size, r.t
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS extra
        FROM rows_ r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + extra // m)::BIGINT AS taken
FROM (SELECT *, unnest(range(m)) AS copy_ FROM got)
"""


@query("op6_mix_sources", SQL_MIX)
def op6_mix_sources(spark, sf_dir):
    """All documents mixed to weights 5, 2, 1 at 150 % of their words, at most two epochs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = mixing.mix_plan(docs, mixing.pattern_weights(docs, MIX_WEIGHTS), budget=MIX_BUDGET, max_epochs=MIX_EPOCHS)
    return (plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
            .select("doc_id", "size", "source_size", "target",
                    (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken")))


# -------------------------------------------------------------------- PII --

@query("op7_pii")
def op7_pii(spark, sf_dir):
    """Personal data in all documents: base spans and those the boosted trees add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.document_spans(docs).select("doc_id", "pii_spans")
    base = F.filter("pii_spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(pii.KINDS.index(kind) + 1))).cast("long").alias(f"n_{kind}")
              for kind in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.span_text(base).cast("binary"), 256).alias("base_sha256"),
                      pii.span_text(F.col("pii_spans")).alias("spans"))


# --------------------------------------------------------------- sharding --

@query("op8_shard")
def op8_shard(spark, sf_dir):
    """All documents shuffled uniformly into 24 shards of equal row counts."""
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"))
    out = sharding.assign_shards(rows, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


# ----------------------------------------------------------- token output --

def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_token_ids")
def op4_token_ids(spark, sf_dir):
    """All documents as token-id files, read back document by document."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/alertsieve/token-ids-{uuid.uuid4().hex}"
    token_store.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return token_store.read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


# ---------------------------------------------------------------- packing --

@query("op9_pack")
def op9_pack(spark, sf_dir):
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, window=2048)


# ---------------------------------------------------------------- SimHash --

@query("op10_simhash")
def op10_simhash(spark, sf_dir):
    """Fingerprints and near-duplicate groups of all documents: 3-word shingles, 2 bits."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ------------------------------------------------------ spelling variants --

SQL_SPELLING = r"""
WITH RECURSIVE bits(i, c, k) AS (
    SELECT i, i, 0 FROM range(256) r(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS m, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x
            FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, m, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2),
               lambda j: 16 * (instr('0123456789ABCDEF', x[2 * j + 1]) - 1) + instr('0123456789ABCDEF', x[2 * j + 2]) - 1)),
               lambda h, b: xor(h >> 8, t[xor(h & 255, b) + 1]))) AS h FROM counted, crc),
vocab AS (SELECT word, sum(m)::BIGINT AS n
          FROM (SELECT m, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT)
                                   || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
          WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i::INT) AS a, substr(word, i::INT + 2) AS b
        FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocab)),
pairs AS (SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y
              ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
          UNION SELECT c.word, v.word, v.n FROM cut c JOIN vocab v ON v.word = c.a || c.b
          UNION SELECT v.word, c.word, c.n FROM cut c JOIN vocab v ON v.word = c.a || c.b),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -near_n, near := near)) AS best
         FROM pairs GROUP BY word),
judged AS (SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near,
                  CASE WHEN -best.less >= 10 * n THEN best.near END AS form,
                  CASE WHEN -best.less >= 10 * n THEN -best.less END::BIGINT AS form_n
           FROM vocab v LEFT JOIN best USING (word)),
chain(word, spot) AS (SELECT word, word FROM judged
                    UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON j.word = c.spot WHERE j.form IS NOT NULL),
ends AS (SELECT c.word, c.spot AS root FROM chain c JOIN judged j ON j.word = c.spot WHERE j.form IS NULL)
SELECT j.word, j.form, e.root, j.n, j.n_near, j.form_n FROM judged j JOIN ends e USING (word)
"""


def misspelt_words(docs: DataFrame, *, min_chars: int = 7, min_count: int = 2, one_in: int = 31) -> DataFrame:
    """The contract's vocabulary of ``documents``: ``word, n``.

    Runs of letters, A-Z lower-cased; where ``one_in`` divides the checksum of
    id and run, the run lost one code point.  Shorter runs than ``min_chars``
    cannot become words and are passed over.
    """
    run, h = F.col("run"), F.col("h")
    place = (h % F.length("run")).cast("int")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(
        "text", F.lit(rf"([A-Za-z\u00C0-\u00FF]{{{min_chars},}})"), 1)).alias("run"))
    hashed = runs.select(ascii_lower(run).alias("run"), "doc_id").select(
        "run", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run)
                       .cast("binary")).alias("h"))
    word = F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), place),
                                            F.substring(run, place + 2, F.length("run")))).otherwise(run)
    return (hashed.select(word.alias("word")).where(F.length("word") >= min_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


@query("op11_spelling", SQL_SPELLING)
def op11_spelling(spark, sf_dir):
    """Spelling variants among the words of all documents."""
    return spelling.variant_groups(misspelt_words(table(spark, sf_dir, "documents")), ratio=10)


# ---------------------------------------------------------- ranked search --

SQL_LEXICAL = r"""
WITH terms AS (SELECT rid, doc_id, unnest(words) AS term
               FROM (SELECT row_number() OVER () AS rid, doc_id,
                            regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents)),
tf AS (SELECT rid, doc_id, term, count(*)::BIGINT AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
corpus AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
asked AS (SELECT DISTINCT iid, item_id, unnest(words) AS term
          FROM (SELECT row_number() OVER () AS iid, item_id,
                       regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark)),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM tf, corpus WHERE term IN (SELECT term FROM asked) GROUP BY term),
scored AS (SELECT iid, item_id, rid, doc_id,
                  sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l))))::BIGINT AS score
           FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (rid), corpus
           GROUP BY iid, item_id, rid, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50
"""


@query("op12_lexical", SQL_LEXICAL)
def op12_lexical(spark, sf_dir):
    """The 50 best of all documents for each benchmark item."""
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


# ------------------------------------------------------------------- WARC --

SQL_WARC = r"""
WITH p AS (SELECT row_number() OVER (ORDER BY page_id NULLS LAST, url NULLS LAST) AS rid, page_id,
                  coalesce(html, '') AS html FROM pages),
d AS (SELECT rid, page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(rid) OVER (PARTITION BY payload_digest) AS keeper,
             first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY rid) AS to_page FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND rid <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND rid <> keeper THEN to_page END AS refers_to
FROM f
"""


@query("op13_warc", SQL_WARC)
def op13_warc(spark, sf_dir):
    """All pages as WARC archives, read back record by record."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/alertsieve/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
