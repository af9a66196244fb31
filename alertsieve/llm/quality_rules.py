"""Quality rules with risk-controlled cutoffs.

Each rule is a statistic of the text (symbols a word, share of repeated lines,
share of repeated words, characters a word); a document is rejected when one
exceeds its stratum's cutoff.  Cutoffs come from labelled documents: along a
fixed grid from lenient to strict, the good documents a cutoff would reject
are counted, and a cutoff holds as long as the exact binomial upper bound of
that rate stays within the rule's share of the allowed false rejection.  The
first failure ends a rule's sequence (fixed-sequence testing), and the error
probability is divided by the number of rules and strata (Bonferroni), so with
probability ``1 - delta`` no stratum loses more than ``max_false_rejection``
of its good documents to the method.  A stratum with too few labelled good
documents for a share of the rate to each rule tests all rules together
instead: along one fixed path of cutoff vectors, the documents that any rule
would reject are counted against the whole rate.  Which way a stratum takes
depends on its number of labels alone, so the guarantee is the same.  A stratum
with too few of them for that too keeps all that the base rules keep.

Scale: statistics are computed where the texts are read; only narrow rows are
written, joined with the labels and counted.  The driver gets one row of
counts per certifiable stratum.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertsieve.llm.binomial import rows_needed, upper_bound
from alertsieve.llm.common import SPACES, hash128, paths_table
from alertsieve.llm.tokens import text_batches

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_FALSE_REJECTION = 0.02
DELTA = 0.05

#: Cutoffs of each rule, lenient to strict; part of the method, not of the data.
GRID = {
    "symbols_per_word": [round(1.0 - 0.05 * i, 2) for i in range(19)],
    "dup_line_share": [round(0.9 - 0.05 * i, 2) for i in range(17)],
    "repeat_share": [round(0.5 - 0.025 * i, 3) for i in range(19)],
    "chars_per_word": [round(16.0 - 0.25 * i, 2) for i in range(45)],
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n + 2).view(np.uint64)
    code = h[:n] * np.uint64(0x9E3779B97F4A7C15) + h[1:n + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    maybe = order[np.append(same, False) | np.insert(same, 0, False)].tolist()
    windows = [(words[i], words[i + 1], words[i + 2]) for i in maybe]
    seen = Counter(windows)
    covered = np.zeros(n + 2, dtype=bool)
    starts = np.array([i for i, w in zip(maybe, windows) if seen[w] > 1], dtype=np.int64)
    for shift in range(3):
        covered[starts + shift] = True
    return int(covered.sum())


def text_counts(text: str) -> tuple:
    """The counts named in ``COUNTS``."""
    words = text.encode().split()  # bytes split at ASCII white space alone
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines))


def count_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                stratum_col: str = "lang") -> DataFrame:
    """``doc_id, stratum, k1, k2`` (the row's key), the ``COUNTS`` and
    ``base_failed`` of every row; a null text has no words."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in text_batches(whole):
                found = np.array([text_counts(t or "") for t in batch["text"].to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c] for c in ("doc_id", "stratum", "k1", "k2")),
                     *(pa.array(found[:, i]) for i in range(len(COUNTS)))],
                    ["doc_id", "stratum", "k1", "k2", *COUNTS])

    k1, k2 = hash128(F.col(id_col), F.col(text_col), F.col(stratum_col))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
                         k1.alias("k1"), k2.alias("k2"))
    out = narrow.mapInArrow(run, "doc_id long, stratum string, k1 long, k2 long, "
                            + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def statistics() -> dict:
    """Rule statistics as columns over the counts (0 without words or lines)."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {"symbols_per_word": F.col("n_symbols") / words,
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / words,
            "chars_per_word": F.col("word_chars") / words}


def choose_cutoffs(counts: dict, n_good: int, n_strata: int, *, limit: float = MAX_FALSE_REJECTION,
                   delta: float = DELTA, grid: dict = GRID) -> dict:
    """Strictest certified cutoff of each rule in one stratum.

    ``counts[rule][i]``: good documents that the i-th cutoff would reject.
    Rules without a certified cutoff are left out.
    """
    share, level = limit / len(grid), delta / (len(grid) * n_strata)
    found = {}
    for rule, cutoffs in grid.items():
        for cutoff, k in zip(cutoffs, counts[rule]):
            if upper_bound(int(k), n_good, level) > share:
                break
            found[rule] = cutoff
    return found


def joint_path(grid: dict = GRID) -> list[dict]:
    """Cutoffs of all rules together, lenient to strict: each rule goes through
    its grid in as many steps as the longest has."""
    steps = max(map(len, grid.values()))
    return [{r: c[i * (len(c) - 1) // max(1, steps - 1)] for r, c in grid.items()} for i in range(steps)]


def choose_joint(counts: list, n_good: int, n_strata: int, *, limit: float = MAX_FALSE_REJECTION,
                 delta: float = DELTA, grid: dict = GRID) -> dict:
    """Strictest certified step of the joint path in one stratum, or ``{}``.

    ``counts[i]``: good documents that any cutoff of the i-th step would reject.
    """
    found = {}
    for cutoffs, k in zip(joint_path(grid), counts):
        if upper_bound(int(k), n_good, delta / n_strata) > limit:
            break
        found = cutoffs
    return found


def calibrate(counted: DataFrame, labels: DataFrame, *, limit: float = MAX_FALSE_REJECTION, delta: float = DELTA,
              grid: dict = GRID) -> list[tuple]:
    """Cutoffs ``(stratum, one value a rule or None)`` from all labelled rows.

    ``labels`` has ``doc_id`` and ``quality`` (1: good; null: not labelled).
    An id has one label however often it is given; one given as good and as
    bad has none.  A good id counts once a stratum, if the base rules keep it;
    of several documents of an id the worst value of each rule counts.
    """
    measured = statistics()
    agreed = (labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
              .where("least = 1 AND most = 1").select("doc_id"))
    good = (counted.where(~F.col("base_failed")).join(agreed, "doc_id").groupBy("stratum", "doc_id")
            .agg(*[F.max(value).alias(f"__{rule}") for rule, value in measured.items()]))
    rules = {rule: F.col(f"__{rule}") for rule in measured}
    sums = [F.array(*[F.count(F.when(rules[r] > F.lit(float(c)), 1)) for c in cutoffs]).alias(r)
            for r, cutoffs in grid.items()]
    steps = [F.count(F.when(reduce(or_, [rules[r] > F.lit(float(c)) for r, c in step.items()]), 1))
             for step in joint_path(grid)]
    per = paths_table(good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums,
                                                  F.array(*steps).alias("__joint")), "quality-strata")
    n_strata = max(1, per.count())
    # one row a stratum that can certify something at all
    rows = per.where(F.col("n") >= rows_needed(limit, delta / n_strata)).collect()
    out = []
    for row in sorted(rows, key=lambda r: r["stratum"]):
        options = {"limit": limit, "delta": delta, "grid": grid}
        if row["n"] >= rows_needed(limit / len(grid), delta / (len(grid) * n_strata)):
            cut = choose_cutoffs({r: row[r] for r in grid}, row["n"], n_strata, **options)
        else:
            cut = choose_joint(row["__joint"], row["n"], n_strata, **options)
        out.append((row["stratum"], *[cut.get(r) for r in grid]))
    return out


def judge(docs: DataFrame, labels: DataFrame, *, limit: float = MAX_FALSE_REJECTION, delta: float = DELTA,
          id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Counts and verdict of every row: ``doc_id, k1, k2``, the ``COUNTS``,
    ``base_failed`` and ``kept``.

    Null or wordless texts fail the base rules.  A null stratum is the stratum
    of the empty name.  Repeated rows are judged alike and all returned; an
    empty table gives an empty result, empty labels certify no cutoff.
    """
    spark = docs.sparkSession
    counted = paths_table(count_texts(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col), "quality")
    cutoffs = calibrate(counted, labels, limit=limit, delta=delta)
    table = spark.createDataFrame(cutoffs, "stratum string, " + ", ".join(f"`max_{r}` double" for r in GRID))
    # a certifiable stratum has over a hundred labelled documents; send the table along only while it is small
    table = F.broadcast(table) if len(cutoffs) <= 10_000 else table
    passed = F.lit(True)
    for rule, value in statistics().items():
        passed = passed & F.coalesce(value <= F.col(f"max_{rule}"), F.lit(True))
    return (counted.join(table, "stratum", "left").withColumn("kept", ~F.col("base_failed") & passed)
            .select("doc_id", "k1", "k2", *COUNTS, "base_failed", "kept"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
              stratum_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their columns."""
    kept = (judge(docs, labels, id_col=id_col, text_col=text_col, stratum_col=stratum_col, **options).where("kept")
            .select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct())
    k1, k2 = hash128(F.col(id_col), F.col(text_col), F.col(stratum_col))
    return (docs.select("*", k1.alias("__k1"), k2.alias("__k2"))
            .join(kept.hint("shuffle_hash"), ["__k1", "__k2"], "left_semi").drop("__k1", "__k2"))
