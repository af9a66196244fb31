"""URL filter: host-suffix and path-prefix expressions against a rule table.

Each distinct URL is expanded into the expressions ``host suffix + path
prefix`` that a rule could equal.  Expressions meet the rules in an equi-join
on a short hash prefix (the only thing a large rule list has to ship), the
survivors are confirmed on the full digest and on the text, and the longest
rule decides.  Everything is DataFrame functions.

Scale: expressions are made per *distinct* URL, so a URL or host that holds a
third of all pages is judged once; verdicts return to the pages by an
equi-join on the URL's 128-bit key, unique on the verdict side (AQE splits a
hot page side).  An URL yields at most (labels of the longest rule host) x
(distinct rule path lengths) expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.llm.common import ascii_lower, hash128, paths_table, with_columns

PREFIX_HEX = 8  # 32 bits of the digest travel through the join


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)),
            F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules ``(action, host, path)`` as digests.

    Nulls in host or path count as empty, a null action drops nothing: it is a
    block.  The same rule given twice is one rule; given with both actions it
    blocks.  A rule with an empty host fits no host and is left out.
    """
    host, path = (F.coalesce(F.col(c), F.lit("")) for c in ("host", "path"))
    allow = F.coalesce(F.col("action") == "allow", F.lit(False))
    return (rules.select(ascii_lower(host).alias("r_host"), path.alias("r_path"), allow.alias("allow"))
            .where("r_host <> ''")
            .groupBy("r_host", "r_path").agg(F.min("allow").alias("allow"))
            .withColumn("digest", _digest(F.col("r_host"), F.col("r_path")))
            .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX)))


def _digest(host: Column, path: Column) -> Column:
    # the zero byte keeps ("a", "b/") and ("ab", "/") apart: neither side may hold it unescaped
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """Judge every row of ``pages`` by its URL.

    Appends ``host``, ``path``, ``rule`` (``host || path`` of the longest
    fitting rule, else null) and ``verdict`` (the rule's action, else
    ``default``); columns of ``pages`` with these names give way.  A rule fits
    its host and all subdomains when the path starts with the rule's path.
    The longest rule string wins, of equally long ones the longer host.
    Null or ``://``-less URLs have an empty host, which no rule fits.  Repeated
    rows are judged alike and all kept; empty tables give empty results; no
    rules: every row gets ``default``.
    """
    prepared = prepare_rules(rules)
    shape = prepared.agg(F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
                         F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths")).first()
    labels, lengths = shape["labels"] or 0, list(shape["lengths"] or [])
    k1, k2 = hash128(F.col(url_col))
    keyed = pages.withColumns({"__u1": k1, "__u2": k2})
    host, path = host_path(F.col(url_col))
    distinct = (keyed.select("__u1", "__u2", host.alias("host"), path.alias("path")).distinct()
                .where("host <> ''"))
    parts = F.split("host", r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - F.lit(max(labels, 1) - 1)), n),
                           lambda i: F.array_join(F.slice(F.split(F.col("host"), r"\."), i, n), "."))
    fits = F.array(*[F.lit(int(x)) for x in lengths]) if lengths else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(fits, lambda x: x <= F.length("path")),
                           lambda x: F.substring(F.col("path"), F.lit(1), x))
    expressions = (distinct.select("__u1", "__u2", F.explode(suffixes).alias("e_host"), "path")
                   .select("__u1", "__u2", "e_host", F.explode(prefixes).alias("e_path"))
                   .withColumn("e_digest", _digest(F.col("e_host"), F.col("e_path")))
                   .withColumn("prefix", F.substring("e_digest", 1, PREFIX_HEX)))
    hits = (expressions.join(prepared, "prefix")
            .where("e_digest = digest AND e_host = r_host AND e_path = r_path"))
    best = F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"),
                          F.concat("r_host", "r_path").alias("rule"), "allow"))
    # written, so that the join deals both its sides anew and AQE may split a hot URL's pages
    verdicts = paths_table(hits.groupBy("__u1", "__u2").agg(best.alias("__best")), "url-verdicts")
    joined = keyed.join(verdicts, ["__u1", "__u2"], "left").drop("__u1", "__u2")
    out = with_columns(joined, host=host, path=path, rule=F.col("__best.rule"),
                       verdict=F.when(F.col("__best.rule").isNull(), F.lit(default))
                       .when(F.col("__best.allow"), F.lit("allow")).otherwise(F.lit("block")))
    return out.drop("__best")
