"""Mixing sources to target weights: capped water-filling, seeded repetition.

Every source gets its share of the budget by weight; sources whose share is
above ``max_epochs`` times their size are clamped there and the excess goes to
the others by weight, until none is above.  A source's target is then taken as
whole repetitions of all its documents plus one fractional pass: documents in
seeded hash order until the rest of the target is used up, the last of them in
part.

Scale: sources are aggregated map-side; the water-filling loop moves two
numbers per round to the driver, however many sources there are.  The
fractional pass is a prefix sum in hash order: sums per (source, 1/4096 of the
hash range) give every range its start, and the row-level window runs inside
one such range, so a source with a third of all rows is split 4096 ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertsieve.llm.common import hash128, paths_table, with_columns, word_count

_BIG = "decimal(38,0)"


def water_fill(sources: DataFrame, *, budget: tuple[int, int] = (3, 2), max_epochs: int = 2) -> DataFrame:
    """Targets of ``sources`` (columns ``source_size``, ``weight`` long).

    ``budget`` is the share of all sizes to hand out, as a fraction.  Appends
    ``target`` (double).  Null or non-positive weights take nothing; if the
    budget is more than every cap together, all sources stop at their caps.
    """
    up, down = budget
    weight = F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)).cast("long")
    cap = (F.col("source_size") * max_epochs).cast(_BIG)
    state = paths_table(sources.withColumn("__w", weight).withColumn("__cap", cap), "mix-sources")
    total = int(state.agg(F.sum("source_size")).first()[0] or 0)
    open_ = F.col("__w") > 0
    capped = F.lit(False)
    while True:
        got = state.select(open_.alias("o"), capped.alias("c"), "__w", "__cap").agg(
            F.sum(F.when(F.col("o") & ~F.col("c"), F.col("__w"))).alias("w"),
            F.sum(F.when(F.col("c"), F.col("__cap"))).alias("full"),
            F.count(F.when(F.col("c"), 1)).alias("n")).first()
        # level = share / unit words for each unit of weight, kept as whole numbers
        unit = int(got["w"] or 0) * down
        share = up * total - down * int(got["full"] or 0)
        now = open_ & (capped | (F.col("__w").cast(_BIG) * F.lit(share).cast(_BIG)
                                 > F.col("__cap") * F.lit(unit).cast(_BIG)))
        if not unit or state.where(now).count() == got["n"]:
            break
        # clamped sources stay clamped: the level only rises as others are
        capped = now
    level = (F.col("__w") * F.lit(share).cast(_BIG)).cast("double") / F.lit(float(max(unit, 1)))
    return (state.withColumn("target", F.when(~open_, F.lit(0.0)).when(capped, F.col("__cap").cast("double"))
                             .otherwise(level)).drop("__w", "__cap"))


def mix_plan(docs: DataFrame, weights: DataFrame, *, budget: tuple[int, int] = (3, 2), max_epochs: int = 2,
             seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """How much of every document the mix takes.

    ``weights`` has ``source`` (null is a source too) and ``weight``.  Returns
    one row per class of rows equal in id, source and text: ``__k1``, ``__k2``
    (its key), ``doc_id``, ``source``, ``size``, ``rows``, ``source_size``,
    ``target``, ``whole`` (full repetitions) and ``extra`` (words of one more,
    partial or full).  Sizes are words; a null or wordless text has size 0 and
    takes nothing.  Equal rows share their part of the fractional pass evenly.
    Sources without a weight take nothing.
    """
    k1, k2 = hash128(F.col(id_col), F.col(source_col), F.col(text_col))
    rows = paths_table(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                    word_count(F.col(text_col)).alias("size"), k1.alias("__k1"), k2.alias("__k2"),
                    F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("__t"))
        .groupBy("doc_id", "source", "size", "__k1", "__k2", "__t").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
                                 .cast("binary"))), "mix-rows")
    rows = rows.withColumn("__bucket", F.substring("__h", 1, 3))
    sums = paths_table(rows.groupBy("source", "__bucket").agg(F.sum(F.col("size") * F.col("rows")).alias("words")),
                       "mix-buckets")
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    weighed = sizes.join(weights.select(F.col("source").alias("__s"), "weight"),
                         F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    targets = water_fill(weighed, budget=budget, max_epochs=max_epochs)
    quota = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    targets = targets.select(
        F.col("source").alias("__s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size"))
        .otherwise(0).cast("long").alias("whole"), quota.alias("__quota"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sums.withColumn("__start", F.coalesce(F.sum("words").over(before), F.lit(0)))
              .join(targets, F.col("source").eqNullSafe(F.col("__s")))
              .select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), "source_size", "target", "whole",
                      (F.col("__quota") - F.col("whole") * F.col("source_size") - F.col("__start")).alias("__left")))
    inside = (Window.partitionBy("source", "__bucket").orderBy("__h", "doc_id", "size", "__t")
              .rowsBetween(Window.unboundedPreceding, -1))
    words = F.col("size") * F.col("rows")
    got = rows.withColumn("__before", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    got = got.join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    extra = F.greatest(F.lit(0), F.least(words, F.col("__left") - F.col("__before")))
    return (got.withColumn("__extra", extra.cast("long"))
            .withColumn("extra", F.expr("__extra div rows"))
            .select("__k1", "__k2", "doc_id", "source", "size", "rows", "source_size", "target", "whole", "extra"))


def mix_documents(docs: DataFrame, weights: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the plan takes it.

    A partial repetition holds the document's first words, with the white
    space between them.  Documents the mix does not take are left out; the
    columns are those of ``docs``.  Options as in :func:`mix_plan`.
    """
    names = {k: options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    text = F.col(names["text_col"])
    k1, k2 = hash128(F.col(names["id_col"]), F.col(names["source_col"]), text)
    plan = mix_plan(docs, weights, **options).select("__k1", "__k2", "size", "whole", "extra").withColumnsRenamed(
        {"size": "__size", "whole": "__whole", "extra": "__extra"})
    taken = (plan.where((F.col("__size") > 0) & ((F.col("__whole") > 0) | (F.col("__extra") > 0)))
             .withColumn("__times", (F.col("__whole") + (F.col("__extra") > 0).cast("long")).cast("int")))
    joined = docs.select("*", k1.alias("__k1"), k2.alias("__k2")).join(taken.hint("shuffle_hash"), ["__k1", "__k2"])
    copies = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    # pieces are a word with the white space behind it; white space before the first word is a piece of its own
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    part = F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), F.col("__extra").cast("int") + lead), ""),
                            r"[\x20\x09-\x0D]+$", "")
    partial = (F.col("__copy") > F.col("__whole")) & (F.col("__extra") < F.col("__size"))
    out = with_columns(copies, **{names["text_col"]: F.when(partial, part).otherwise(text)})
    return out.select(*[f"`{c}`" for c in docs.columns])


def pattern_weights(docs: DataFrame, pattern: tuple[int, ...] = (5, 2, 1), source_col: str = "source") -> DataFrame:
    """Weights by the sources' code-point order (null last), ``pattern``
    repeating.  The ranking runs over one row per distinct source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (docs.select(F.col(source_col).alias("source")).distinct()
              .withColumn("__i", (F.row_number().over(order) - 1) % len(pattern)))
    return ranked.select("source", F.element_at(F.array(*[F.lit(int(w)) for w in pattern]),
                                                F.col("__i") + 1).cast("long").alias("weight"))
