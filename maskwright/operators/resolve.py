"""Overlap resolution on a document's array of candidates: row-local, so the whole chain needs no shuffle.

Candidates are structs as in detect.CANDIDATE. Where order matters, ties go to the earlier candidate of the array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import let, overlap
from ..functions.text import gender_suffix, trim_bounds
from .detect import CANDIDATE

REVIEW_BELOW = 0.85
#: methods and their rank; an unknown method counts as a library
PRIORITY = {"glossary": 4, "regex": 3, "library": 3, "eupii": 2, "gliner": 1}
#: fixed values: types found before the token classifier, which it must not cut into
PROTECTED = ("AHV_NUMBER", "UID_NUMBER", "ADDRESS", "IBAN_CODE", "EMAIL_ADDRESS", "PHONE_NUMBER", "URL", "DATE_TIME")


def priority(method: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))[method], F.lit(3))


def numbered(spans: Column) -> Column:
    """The array with seq as the place in it."""
    return F.transform(spans, lambda s, i: s.withField("seq", i))


def trimmed(spans: Column, text: Column) -> Column:
    """Spans without tags, markdown and punctuation at their ends; those with nothing left go."""

    def one(s: Column) -> Column:
        start, end = trim_bounds(s["value"], s["start"], s["end"])
        return s.withField("start", start).withField("end", end).withField("value", text.substr(start + 1, F.greatest(end - start, F.lit(0))))

    return F.filter(F.transform(spans, one), lambda s: s["end"] > s["start"])


def enabled(spans: Column, general: list[str] | None, glossary: list[str] | None) -> Column:
    """Type gates: None lets all types through, an empty list none; glossary hits have a gate of their own."""
    gate = lambda s, types: F.lit(True) if types is None else s["entity_type"].isin(types) if types else F.lit(False)
    return F.filter(spans, lambda s: F.when(s["method"] == "glossary", gate(s, glossary)).otherwise(gate(s, general)))


def allowed_by_mode(spans: Column, modes: dict[str, str]) -> Column:
    """Four modes by type: off nothing, explicit_only the glossary, explicit_eupii also the token classifier, all everything."""
    mode_of = F.create_map(*(F.lit(x) for pair in modes.items() for x in pair)) if modes else F.create_map(F.lit(""), F.lit("all"))

    def passes(s: Column) -> Column:
        mode = F.coalesce(mode_of[s["entity_type"]], F.lit("all"))
        return (mode == "all") | ((mode != "off") & (s["method"] == "glossary")) | ((mode == "explicit_eupii") & (s["method"] == "eupii"))

    return F.filter(spans, passes)


def ignoring(spans: Column, user: Column, default: Column) -> Column:
    """Anti-join: an overlap with a user's ignore span kills any candidate, one with a default span spares glossary hits."""
    hit = lambda s, blockers: F.exists(blockers, lambda b: overlap(s, b))
    return F.filter(spans, lambda s: ~hit(s, user) & ~(hit(s, default) & (s["method"] != "glossary")))


def without(spans: Column, blockers: Column) -> Column:
    """Interval anti-join: spans that share no character with a blocker."""
    return F.filter(spans, lambda s: ~F.exists(blockers, lambda b: overlap(s, b)))


def with_gender_suffix(spans: Column, text: Column) -> Column:
    """Spans extended by a gender suffix; stray suffixes found as entities of their own go."""

    def one(s: Column) -> Column:
        end = s["end"] + gender_suffix(text.substr(s["end"] + 1, F.lit(12)))
        return s.withField("end", end).withField("value", text.substr(s["start"] + 1, end - s["start"]))

    stray = lambda s: F.lower(F.trim(s["value"])).isin("in", "innen", ":in", ":innen", "*in", "*innen") & (s["start"] > 0) & text.substr(s["start"], F.lit(1)).isin(":", "*", "_", "/", " ")
    return F.filter(F.transform(spans, one), lambda s: ~stray(s))


def absorbed(spans: Column) -> Column:
    """A glossary hit strictly inside another detector's span takes the smallest such span's bounds; that span goes."""
    size = lambda m: m["end"] - m["start"]

    def of(spans: Column) -> Column:
        others = F.filter(spans, lambda s: s["method"] != "glossary")

        def around(g: Column) -> Column:
            inside = F.filter(spans, lambda m: (m["method"] != "glossary") & (m["start"] <= g["start"]) & (g["end"] <= m["end"]) & (size(m) > size(g)))
            return F.array_min(F.transform(inside, lambda m: F.struct(size(m).alias("n"), m["seq"].alias("k"), m.alias("m"))))["m"]

        def grown(x: Column) -> Column:
            g, m = x["g"], x["m"]
            return F.when(m.isNull(), g).otherwise(g.withField("start", m["start"]).withField("end", m["end"]).withField("value", m["value"]))

        pairs = F.transform(F.filter(spans, lambda s: s["method"] == "glossary"), lambda g: F.struct(g.alias("g"), around(g).alias("m")))
        return let(pairs, lambda p: F.concat(F.transform(p, grown), F.filter(others, lambda m: ~F.exists(p, lambda x: x["m"]["seq"].eqNullSafe(m["seq"])))))

    return let(numbered(spans), of)


def packed(spans: Column, *keys: str) -> Column:
    """Greedy interval packing: in order of the keys (priority, length, score; all descending), what overlaps an accepted span goes."""
    order = {"priority": lambda s: -priority(s["method"]), "length": lambda s: s["start"] - s["end"], "score": lambda s: -s["score"]}
    ranked = F.array_sort(F.transform(numbered(spans), lambda s: F.struct(*(order[k](s).alias(f"k{n}") for n, k in enumerate(keys)), s["seq"].alias("seq"), s.alias("s"))))
    return F.aggregate(F.transform(ranked, lambda x: x["s"]), F.expr(f"cast(array() as array<{CANDIDATE}>)"), lambda acc, s: F.when(F.exists(acc, lambda a: overlap(a, s)), acc).otherwise(F.array_append(acc, s)))


def without_contained(spans: Column) -> Column:
    """Drops a span inside another of the same type with a higher score, or with the same score and more length."""
    beats = lambda o, s: (o["entity_type"] == s["entity_type"]) & (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & ((o["score"] > s["score"]) | ((o["score"] == s["score"]) & ((o["end"] - o["start"] > s["end"] - s["start"]) | ((o["start"] == s["start"]) & (o["end"] == s["end"]) & (o["seq"] < s["seq"])))))
    return let(numbered(spans), lambda spans: F.filter(spans, lambda s: ~F.exists(spans, lambda o: beats(o, s))))


def whole_words(spans: Column, text: Column) -> Column:
    """Rejects spans cut out of a word: letters or digits on both sides of an edge."""
    part = lambda c: c.rlike(r"(?U)^[\p{Alnum}]$")
    at = lambda k: text.substr(k, F.lit(1))
    cut = lambda s: ((s["start"] > 0) & part(at(s["start"])) & part(at(s["start"] + 1))) | (part(at(s["end"])) & part(at(s["end"] + 1)))
    return F.filter(spans, lambda s: ~F.coalesce(cut(s), F.lit(False)))


def merged_persons(spans: Column, text: Column) -> Column:
    """Adjacent PERSON spans of two words in all, only white space between, become one with the smaller score. Compares with the merged row."""
    words = lambda s: F.size(F.split(F.trim(text.substr(s["start"] + 1, s["end"] - s["start"])), r"\s+"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["seq"].alias("c"), s.alias("s"))))

    def step(acc: Column, x: Column) -> Column:
        s, last = x["s"], F.try_element_at(acc, F.lit(-1))
        gap = text.substr(last["end"] + 1, s["start"] - last["end"])
        joins = (F.size(acc) > 0) & (s["entity_type"] == "PERSON") & (last["entity_type"] == "PERSON") & (s["start"] >= last["end"]) & (F.length(F.regexp_replace(gap, r"\s", "")) == 0) & (words(last) + words(s) <= 2)
        grown = last.withField("end", s["end"]).withField("score", F.least(last["score"], s["score"])).withField("value", text.substr(last["start"] + 1, s["end"] - last["start"]))
        return F.when(F.coalesce(joins, F.lit(False)), F.array_append(F.slice(acc, 1, F.size(acc) - 1), grown)).otherwise(F.array_append(acc, s))

    return F.aggregate(ordered, F.expr(f"cast(array() as array<{CANDIDATE}>)"), step)


def genitives(accepted: DataFrame, ignored: DataFrame | None = None, terms: list[str] | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """accepted(doc, text, spans) with the genitives of accepted persons' name parts found elsewhere in the text, as further persons.

    Row-local: parts become one alternation per row, matches that overlap an accepted or ignored span are dropped.
    """
    parts = F.array_distinct(F.flatten(F.transform(F.filter("spans", lambda s: s["entity_type"] == "PERSON"), lambda s: F.transform(F.filter(F.regexp_extract_all(s["value"], F.lit(r"(?U)\b[A-ZÄÖÜ][a-zäöüßA-ZÄÖÜ-]+\b"), F.lit(0)), lambda p: F.length(p) >= 3), lambda p: F.struct(p.alias("part"), F.least(s["score"], F.lit(REVIEW_BELOW)).alias("score"))))))
    if terms:
        parts = F.filter(parts, lambda p: ~F.lower(p["part"]).isin([t.strip().lower() for t in terms]))
    rows = accepted.withColumn("_p", F.explode(parts)).withColumn("_re", F.concat(F.lit(r"(?U)\b"), F.col("_p.part"), F.lit(r"(?:'s|’s|s)\b")))
    found = rows.withColumn("_m", F.regexp_extract_all(text, F.col("_re"), F.lit(0))).where(F.size("_m") > 0)
    gaps = F.split(F.col(text), F.col("_re"), -1)
    upto = lambda arr, k: F.aggregate(F.slice(arr, 1, k), F.lit(0), lambda a, x: a + F.length(x))
    hits = found.select(doc, "spans", "_m", gaps.alias("_g"), F.col("_p.score").alias("score"), F.posexplode("_m").alias("k", "value"))
    start = upto(F.col("_g"), F.col("k") + 1) + upto(F.col("_m"), F.col("k"))
    free = hits.withColumn("start", start.cast("int")).withColumn("end", F.col("start") + F.length("value"))
    free = free.where(~F.exists("spans", lambda s: (s["end"] > F.col("start")) & (s["start"] < F.col("end"))))
    if ignored is not None:
        blocked = ignored.select(F.col(doc).alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        free = free.join(blocked, (free[doc] == blocked["_d"]) & (free["start"] < blocked["_e"]) & (free["end"] > blocked["_s"]), "left_anti")
    first = Window.partitionBy(doc, "start").orderBy(F.desc("score"))
    return free.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(doc, "start", "end", "value", F.lit("PERSON").alias("entity_type"), "score")


def interval_anti_join(spans: DataFrame, blockers: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The same anti-join for spans and blockers that come as tables: equal documents, no shared character."""
    b = blockers.select(F.col(doc).alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return spans.join(b, (spans[doc] == b["_d"]) & (spans["start"] < b["_e"]) & (spans["end"] > b["_s"]), "left_anti")


def resolve(spans: Column, text: Column, user: Column | None = None, default: Column | None = None, general: list[str] | None = None, glossary: list[str] | None = None, modes: dict[str, str] | None = None) -> Column:
    """The whole chain: trim, gates, ignore spans, gender suffixes, absorption, packing by source, length and score; sorted by start."""
    none = F.expr(f"cast(array() as array<{CANDIDATE}>)")
    steps = [without_contained, lambda x: trimmed(x, text), lambda x: enabled(x, general, glossary)]
    if modes:
        steps.append(lambda x: allowed_by_mode(x, modes))
    if user is not None or default is not None:
        steps.append(lambda x: ignoring(x, user if user is not None else none, default if default is not None else none))
    steps += [lambda x: with_gender_suffix(x, text), absorbed, lambda x: packed(x, "priority", "length", "score"), by_start]
    for step in steps:
        spans = let(spans, step)
    return spans


def by_start(spans: Column) -> Column:
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("k"), s.alias("s")))), lambda x: x["s"])
