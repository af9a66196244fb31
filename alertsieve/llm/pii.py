"""Personal data by candidate generation and gradient boosting.

Base rules find well-formed e-mail addresses, IP addresses, payment cards
(Luhn) and international phone numbers; their spans always stay.  Beside them,
high-recall generators propose overlapping spans of each kind (other
separators, missing prefixes, bracketed "at"): from every digit group, or local
part of an address, every number of further groups that the kind allows, so a
neighbouring number hides none.  Boosted trees score every proposal from its
format and context; they learn from proposals that the base rules settle (a
proposal of the digits or the text of a base span of its kind is one, any other
that overlaps a base span or fails a check is none).  The score cutoff is
calibrated on held-out settled proposals with an exact binomial bound on false
alarms; unsettled proposals above it are added, the best first, each unless it
overlaps one already added.

Everything is DataFrame functions and Spark ML trees.  Offsets are code
points: the lengths of what lies between matches, summed in a window over the
matches of one document.

Scale: a cheap test per kind keeps most texts away from the patterns; all
patterns run in time linear in the text.  Only narrow match rows are shuffled;
a group starts at most eight proposals of a kind.
The trees are fitted on about ``fit_rows`` settled proposals at most, chosen by
hash; the cutoff counts the false alarms among all held-out ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertsieve.llm.binomial import upper_bound
from alertsieve.llm.common import hash128, paths_table

KINDS = ("email", "ip", "card", "phone")
FIT_ROWS = 20_000
MAX_FALSE_ALARM = 0.02
DELTA = 0.05
CONTEXT = 24

#: Base patterns, as the contract fixes them; possessive repeats and the start
#: conditions only spare the engine the starts and retries that cannot match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_TEST = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
_AT = r"\x20?(?:@|[\[(]\x20?at\x20?[\])])\x20?[A-Za-z0-9-]{1,63}+"
_DOT = r"(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]{1,63}+)"
_PHONE = r"(?:(?:[\x20./-]{1,2}|(?<=\)))\(?[0-9]{2,4}\)?)"
_ALONE = r"(?![0-9A-Za-z])"
#: Generators: overlapping, generous forms.  Of each kind: what may not stand
#: before, the first piece, the further pieces and how few and many of them
#: (or a form of its own without any), what may not follow.
FORMS = {
    "email": (r"(?<![A-Za-z0-9._%+-])", r"[A-Za-z0-9._%+-]{1,64}+", _AT, _DOT, 1, 8, None, ""),
    "ip": (r"(?<![0-9A-Za-z])", r"[0-9]{1,6}", "", r"(?:\.[0-9]{1,6})", 3, 3, None, _ALONE),
    "card": (r"(?<![0-9A-Za-z])", r"[0-9]{3,19}", "", r"(?:[\x20./-]{1,2}[0-9]{2,6})", 0, 5, None, _ALONE),
    "phone": (r"(?<![0-9A-Za-z])", r"\+?\(?[0-9]{1,4}", r"\)?", _PHONE, 2, 5, r"\+?[0-9]{7,15}", _ALONE),
}
AFTER = 8
#: Digits that a card or phone number may have.
DIGITS = {"card": (13, 19), "phone": (7, 15)}
#: Any code point; the last one, written out, has Java count code points when it looks back.
_ANY = "[\\x00-\U0010FFFF]"


def _generator(kind: str) -> str:
    """Matches the first piece of a proposal.  Group 1 is the text from there
    to the end of its longest form and of the context behind it, group 2 the
    context before."""
    before, first, joint, more, least, most, bare, end = FORMS[kind]
    form = f"{first}{joint}{more}{{{least},{most}}}"
    form = f"(?:{bare}{end}|{form})" if bare else form
    digits = f"(?=(?:[^0-9A-Za-z]{{0,4}}[0-9]){{{DIGITS[kind][0]}}})" if kind in DIGITS else ""
    taken = first if kind == "email" else r"\+?\(?[0-9]+"
    context = rf"(?<=(\A{_ANY}{{0,{CONTEXT - 1}}}|{_ANY}{{{CONTEXT}}}))"
    return f"{before}{digits}(?=({form}{_ANY}{{0,{AFTER}}})){context}{taken}"


GENERATORS = {k: _generator(k) for k in KINDS}
GENERATOR_TEST = {"email": r"@|[\[(]\x20?at\x20?[\])]", "ip": r"[0-9]\.[0-9]",
                  "card": r"[0-9](?:[^0-9A-Za-z]{0,2}[0-9]){11}", "phone": r"[0-9](?:[^0-9A-Za-z]{0,4}[0-9]){6}"}
CUES = {"email": r"e-?mail|contact|write", "ip": r"\bip\b|address|server|host", "card": r"card|visa|credit|pay",
        "phone": r"tel|phone|call|mobile|fax"}


def _matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every match of every pattern: ``k1, k2, kind, proposed, start, end`` and
    its text and context."""
    text = F.col(text_col)
    k1, k2 = hash128(F.col(id_col), text)

    def cut(kind, proposed, pattern, test):
        test = text.contains("@") if test == "@" else text.rlike(test)
        group = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
        none = F.array().cast("array<string>")
        return F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(proposed).alias("proposed"),
                                     F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
                                     group(0).alias("hits"), (group(1) if proposed else none).alias("seen"),
                                     (group(2) if proposed else none).alias("before")))

    cuts = [cut(k, False, BASE[k], BASE_TEST[k]) for k in KINDS]
    cuts += [cut(k, True, GENERATORS[k], GENERATOR_TEST[k]) for k in KINDS]
    # a match lies between the gap of its number and the next
    zipped = F.arrays_zip(F.slice("gaps", F.lit(1), F.size("hits")).alias("gap"), F.col("hits").alias("match"),
                          "seen", "before")
    rows = (docs.where(text.contains("@") | text.rlike(r"[0-9]|[\[(]\x20?at\x20?[\])]"))
            .select(k1.alias("k1"), k2.alias("k2"), F.explode(F.array(*cuts)).alias("c"))
            .where("size(c.hits) > 0").select("k1", "k2", "c.*")
            .select("k1", "k2", "kind", "proposed", F.posexplode(zipped).alias("i", "m"))
            .select("k1", "k2", "kind", "proposed", "i", "m.*").distinct())
    order = (Window.partitionBy("k1", "k2", "kind", "proposed").orderBy("i")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    size = F.length("match")
    placed = rows.withColumn("start", F.sum(F.col("gap") + size).over(order) - size)
    forms = F.when(~F.col("proposed"), F.array("match"))
    for kind in KINDS:
        forms = forms.when(F.col("kind") == kind, _forms(kind, F.col("seen")))
    m = F.col("match")
    return (placed.withColumn("match", F.explode(forms)).withColumn("end", F.col("start") + F.length(m))
            .select("k1", "k2", "kind", "proposed", "start", "end", "match", "before",
                    F.substring(F.col("seen"), F.length(m) + 1, F.lit(AFTER)).alias("after")))


def _forms(kind: str, seen: Column) -> Column:
    """The proposals of a kind that begin where ``seen`` does, an array."""
    _, first, joint, more, least, most, bare, end = FORMS[kind]
    patterns = [f"^{first}{joint}{more}{{{n}}}{end}" for n in range(least, most + 1)] + ([f"^{bare}{end}"] if bare else [])
    found = F.array(*[F.regexp_extract(seen, p, 0) for p in patterns])
    low, high = DIGITS.get(kind, (0, None))
    fits = lambda m: (m != "") & (F.length(_digits(m)).between(low, high) if high else F.lit(True))
    return F.filter(found, fits)


def _digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _ip_parts_ok(match: Column) -> Column:
    def small(part):
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(match, r"\."), small)


def valid(kind: Column, match: Column) -> Column:
    """The base rules' second step."""
    digits = _digits(match)
    n = F.length(digits)
    card = F.when(n.between(16, 19), luhn(digits)).otherwise(F.lit(False))
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", _ip_parts_ok(match))
            .when(kind == "card", card).otherwise(n.between(8, 15)))


def _features() -> dict[str, Column]:
    m, before, after = F.col("match"), F.col("before"), F.col("after")
    digits = _digits(m)
    n = F.length(digits)
    flag = lambda c: c.cast("double")
    out = {f"is_{k}": flag(F.col("kind") == k) for k in KINDS}
    out |= {
        "length": F.length(m).cast("double"), "digits": n.cast("double"),
        "distinct_digits": F.size(F.array_distinct(F.split(digits, ""))).cast("double"),
        "separators": F.length(F.regexp_replace(m, "[0-9A-Za-z]", "")).cast("double"),
        "groups": F.size(F.split(m, "[^0-9A-Za-z]+")).cast("double"),
        "dots": F.length(F.regexp_replace(m, r"[^.]", "")).cast("double"),
        "at_sign": flag(m.contains("@")), "plus": flag(m.startswith("+") | before.rlike(r"\+[0-9]{0,3}\x20?$")),
        "paren": flag(m.contains("(")), "spaces": flag(m.contains(" ")),
        "luhn": flag(F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False))),
        "parts_ok": flag(F.when(m.rlike(r"^[0-9]+(\.[0-9]+){3}$"), _ip_parts_ok(m)).otherwise(F.lit(False))),
        "glued_before": flag(before.rlike(r"[^\x20\n(,:;]$")), "glued_after": flag(after.rlike(r"^[^\x20\n),.:;]")),
        "cue": flag(F.coalesce(*[F.when(F.col("kind") == k, F.lower(before).rlike(c)) for k, c in CUES.items()])),
        "line_start": flag(before.rlike(r"(^|\n)\x20*$")),
    }
    return out


def _clusters(spans: DataFrame) -> DataFrame:
    """Number the clusters of overlapping spans within each document."""
    order = Window.partitionBy("k1", "k2").orderBy("start", "end", "kind", "proposed")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    return (spans.withColumn("__new", fresh)
            .withColumn("cluster", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new"))


def _best(spans: DataFrame) -> DataFrame:
    """Of overlapping spans the best: by score and length, each stays unless
    it overlaps a better one that stays."""
    rank = F.struct("score", (F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("early"),
                    "kind", "start", "end")
    kind = "array<struct<score:double,size:bigint,early:bigint,kind:string,start:bigint,end:bigint>>"

    def keep(stay, x):
        hit = F.exists(stay, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        return F.when(hit, stay).otherwise(F.concat(stay, F.array(x)))

    ranked = F.sort_array(F.collect_list(rank).cast(kind), asc=False)
    return (_clusters(spans.withColumn("proposed", F.lit(True))).groupBy("k1", "k2", "cluster").agg(ranked.alias("all"))
            .select("k1", "k2", F.explode(F.aggregate("all", F.array().cast(kind), keep)).alias("b"))
            .select("k1", "k2", "b.kind", "b.start", "b.end"))


def _settled(spans: DataFrame) -> DataFrame:
    """Proposals with their features and ``label``: 1, 0, or null (unsettled)."""
    # what a proposal says: the digits of a number, an address as it is
    said = F.when(F.col("kind") == "email", F.col("match")).otherwise(_digits(F.col("match")))
    # base spans of a kind do not overlap: the last that starts before a proposal's end reaches farthest
    place = F.when(F.col("proposed"), F.col("end")).otherwise(F.col("start"))
    order = (Window.partitionBy("k1", "k2").orderBy(place, F.desc("proposed"))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = [F.max(F.when(~F.col("proposed") & (F.col("kind") == k), F.struct("start", "end", "said"))).over(order)
            .alias(f"last_{k}") for k in KINDS]
    seen = spans.where("good or proposed").withColumn("said", said).select("*", *last).where("proposed")
    meets = {k: F.coalesce(F.col(f"last_{k}.end") > F.col("start"), F.lit(False)) for k in KINDS}
    same = F.lit(False)
    for k in KINDS:
        same = same | ((F.col("kind") == k) & meets[k] & (F.col(f"last_{k}.said") == F.col("said")))
    overlaps = meets["email"] | meets["ip"] | meets["card"] | meets["phone"]
    m, kind = F.col("match"), F.col("kind")
    n = F.length(_digits(m))
    breaks = (((kind == "ip") & m.rlike(r"^[0-9.]+$") & ~(m.rlike(r"^[0-9]+(\.[0-9]+){3}$") & _ip_parts_ok(m)))
              | ((kind == "card") & ~F.when(n.between(13, 19), luhn(_digits(m))).otherwise(F.lit(False)))
              | ((kind == "phone") & ~n.between(7, 15)))
    label = F.when(same, 1.0).when(overlaps, 0.0).when(breaks, 0.0)
    return seen.withColumn("label", label).select(
        "k1", "k2", "kind", "start", "end", "match", "label", *[c.alias(f"f_{n}") for n, c in _features().items()])


def _additions(proposals: DataFrame, *, fit_rows: int, limit: float, delta: float, seed: int) -> DataFrame | None:
    """Unsettled proposals that the calibrated trees accept, or None if there
    is nothing to learn from or no cutoff can be certified.

    The bound is on documents with a false alarm, among held-out documents with
    a settled negative; settled proposals themselves are never added, so it
    carries over to unsettled ones as far as those look alike."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = [c for c in proposals.columns if c.startswith("f_")]
    vector = VectorAssembler(inputCols=names, outputCol="features")
    # a document is fitted on or held out as a whole: its proposals are not independent
    settled = proposals.where("label is not null").withColumn(
        "held", F.pmod(F.xxhash64(F.lit(seed), "k1", "k2"), F.lit(3)) == 0)
    sizes = {(r.label, r.held): r["count"] for r in settled.groupBy("label", "held").count().collect()}
    if min(sizes.get((x, h), 0) for x in (0.0, 1.0) for h in (True, False)) == 0:
        return None
    # the trees see about fit_rows // 2 of either label, by hash; the cutoff all that is held out
    pick = F.pmod(F.xxhash64(F.lit(seed + 1), "k1", "k2", "kind", "start", "end"), F.lit(1 << 40))
    share = {x: min(1.0, (fit_rows // 2) / sizes[(x, False)]) for x in (0.0, 1.0)}
    bound = F.when(F.col("label") == 1, int(share[1.0] * (1 << 40))).otherwise(int(share[0.0] * (1 << 40)))
    chosen = paths_table(settled.where(~F.col("held") & (pick < bound)), "pii-fit")
    model = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=seed).fit(
        vector.transform(chosen).select("features", "label").coalesce(2).cache())
    score = vector_to_array("probability")[1]
    steps = [round(0.5 + 0.05 * i, 2) for i in range(10)]  # lenient to strict
    held = vector.transform(settled.where("held and label = 0"))
    # a document is one trial, whatever its number of proposals: they are not independent
    worst = model.transform(held).select("k1", "k2", score.alias("s")).groupBy("k1", "k2").agg(F.max("s").alias("s"))
    alarms = worst.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("s") >= t, 1)).alias(f"c{i}")
                                                       for i, t in enumerate(steps)]).first()
    cutoff = None
    for i, t in reversed(list(enumerate(steps))):  # strict to lenient, until a step fails
        if upper_bound(alarms[f"c{i}"], alarms["n"], delta) > limit:
            break
        cutoff = t
    if cutoff is None:
        return None
    scored = model.transform(vector.transform(proposals.where("label is null")))
    return (scored.withColumn("score", score).where(F.col("score") >= cutoff)
            .select("k1", "k2", "kind", "start", "end", "score"))


def find_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS,
               limit: float = MAX_FALSE_ALARM, delta: float = DELTA, seed: int = 5) -> DataFrame:
    """Spans of personal data: ``k1, k2`` (the key of rows equal in id and
    text), ``kind``, ``start``, ``end`` (code points, end exclusive), ``base``.

    Null and empty texts have none; repeated rows share their spans; an empty
    table gives an empty result.
    """
    spans = paths_table(_matches(docs, id_col, text_col).withColumn(
        "good", F.when(F.col("proposed"), F.lit(False)).otherwise(valid(F.col("kind"), F.col("match")))), "pii-matches")
    base = spans.where("good and not proposed").select("k1", "k2", "kind", "start", "end", F.lit(True).alias("base"))
    proposals = paths_table(_settled(spans), "pii-proposals")
    added = _additions(proposals, fit_rows=fit_rows, limit=limit, delta=delta, seed=seed)
    if added is None:
        return base
    return base.unionByName(_best(added).withColumn("base", F.lit(False)))


def document_spans(docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` with its sorted spans appended: ``pii_spans``, an
    array of ``(kind number, start, end, base)``, empty if there are none."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    per = (find_spans(docs, **options).groupBy("k1", "k2")
           .agg(F.sort_array(F.collect_list(F.struct(number.alias("kind"), "start", "end", "base"))).alias("__spans"))
           .withColumnsRenamed({"k1": "__k1", "k2": "__k2"}))
    k1, k2 = hash128(F.col(id_col), F.col(text_col))
    stay = [f"`{c}`" for c in docs.columns if c.lower() != "pii_spans"]
    empty = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean>>")
    return (docs.select("*", k1.alias("__k1"), k2.alias("__k2")).join(per, ["__k1", "__k2"], "left")
            .select(*stay, F.coalesce("__spans", empty).alias("pii_spans")))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by ``[kind]``; of overlapping spans
    the first hides the others' common part."""
    names = F.array(*[F.lit(k) for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc, s):
        lies = s["start"] < acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        out = F.when(lies, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit("["),
                                                          F.element_at(names, s["kind"]), F.lit("]")))
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                                  s["kind"].alias("kind"))))
    return F.aggregate(by_place, start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
