"""Numbering, roles, placeholders, substitution and restoring. Placeholders are numbered within a document.

Where spans come with `text_key`, a hash of the text they were found in (as Engine.detect gives them), a document is an id
and a text: rows that share an id, or have none, each keep their own spans. Without it a document is its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import blocks, let
from ..functions.text import clean_tag, stripped
from ..shipping import sound_unions
from .resolve import REVIEW_BELOW

MODES = ("numbered", "numbered_role", "role_only")
#: fixed values: a placeholder right before a capitalised word
RESIDUE = r"(\[[A-Z0-9_ÄÖÜ]+\])\s+([A-ZÄÖÜ][a-zäöüßA-ZÄÖÜ\-]{2,})"
KEY = "text_key"


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _keys(spans: DataFrame, doc: str) -> list[str]:
    return [doc, KEY] if KEY in spans.columns else [doc]


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys, nulls being equal; right's keys go."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys]
    return left.join(named, on, how).drop(*(f"_r_{k}" for k in keys))


def terms(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, entity_type, norm_term, first_start, n, min_score, max_score): the distinct terms of each document."""
    norm = F.lower(stripped(F.col("value"))).alias("norm_term")
    summary = [F.min("start").alias("first_start"), F.count(F.lit(1)).alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score")]
    return spans.groupBy(*_keys(spans, doc), "entity_type", norm).agg(*summary)


def numbered(found: DataFrame, links: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """terms with entity_id: by type in order of first appearance. Linked terms share their parent's number and come after all others."""
    keys = [*_keys(found, doc), "entity_type"]
    if links is None:
        order = Window.partitionBy(*keys).orderBy("first_start", "norm_term")
        none = F.lit(None).cast("string")
        return found.withColumn("entity_id", F.row_number().over(order)).withColumn("surface_tag", none).withColumn("parent_term", none)
    sound_unions(found.sparkSession)
    linked = links.select(doc, F.col("child_term").alias("norm_term"), "parent_term", F.col("surface_tag").alias("tag"))
    child = F.col("parent_term").isNotNull() & (F.col("parent_term") != F.col("norm_term"))
    marked = join_on(found, linked, [doc, "norm_term"], "left").withColumn("is_child", child)
    masters = marked.where(~F.col("is_child")).select(*keys, F.col("norm_term").alias("parent_term"), F.lit(True).alias("has_parent"))
    placed = join_on(marked, masters, [*keys, "parent_term"], "left").withColumn("follows", F.col("is_child") & F.coalesce("has_parent", F.lit(False)))
    order = Window.partitionBy(*keys).orderBy("is_child", "first_start", "norm_term")
    own = placed.where(~F.col("follows")).withColumn("entity_id", F.row_number().over(order))
    ids = own.where(~F.col("is_child")).select(*keys, F.col("norm_term").alias("parent_term"), "entity_id")
    inherited = join_on(placed.where("follows"), ids, [*keys, "parent_term"])
    tag = F.when(F.col("is_child"), F.coalesce(F.nullif("tag", F.lit("")), F.lit("VARIANT"))).otherwise(F.col("tag"))
    return own.unionByName(inherited).withColumn("surface_tag", tag).drop("tag", "has_parent", "follows", "is_child")


def collisions(labelled: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, entity_type, role_tag): roles that entities of different numbers share."""
    keys = [*_keys(labelled, doc), "entity_type", "role_tag"]
    tagged = labelled.withColumn("role_tag", clean_tag(F.col("role"))).where("role_tag <> ''")
    return tagged.groupBy(*keys).agg(F.countDistinct("entity_id").alias("n_ids")).where("n_ids > 1").select(*keys)


def placeholder(entity_type: Column, number: Column, role_tag: Column, surface: Column, mode: str, colliding: Column | None = None, collision_adds_role: bool = True) -> Column:
    """[TYPE_N], [TYPE_N_ROLE] or [TYPE_ROLE], with a surface tag. A shared role falls back to the numbered form.

    collision_adds_role: with shared roles the role also shows in mode numbered, as in documents; previews don't.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    shared = colliding if colliding is not None else F.lit(False)
    has_role, tag = F.length(role_tag) > 0, F.when(F.length(surface) > 0, F.concat(F.lit("_"), surface)).otherwise("")
    plain = F.concat(F.lit("["), entity_type, F.lit("_"), number.cast("string"), tag, F.lit("]"))
    with_both = F.concat(F.lit("["), entity_type, F.lit("_"), number.cast("string"), F.lit("_"), role_tag, tag, F.lit("]"))
    role_alone = F.concat(F.lit("["), entity_type, F.lit("_"), role_tag, tag, F.lit("]"))
    if mode == "numbered":
        return F.when(has_role & shared & F.lit(collision_adds_role), with_both).otherwise(plain)
    if mode == "numbered_role":
        return F.when(has_role, with_both).otherwise(plain)
    return F.when(has_role & ~shared, role_alone).when(has_role, with_both).otherwise(plain)


def label(spans: DataFrame, mode: str = "numbered", roles: DataFrame | None = None, links: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """spans with entity_id, role, surface_tag, placeholder and needs_review. One shuffle by document serves all of it."""
    if roles is None and links is None:
        return _labelled_in_place(spans, mode, doc)
    found = numbered(terms(spans, doc), links, doc)
    if roles is not None:
        own = roles.select(doc, F.col("norm_term").alias("rt"), "role")
        found = join_on(found, own.withColumnRenamed("rt", "norm_term"), [doc, "norm_term"], "left")
        of_parent = own.select(doc, F.col("rt").alias("parent_term"), F.col("role").alias("parent_role"))
        found = join_on(found, of_parent.where("parent_term is not null"), [doc, "parent_term"], "left")
        found = found.withColumn("role", F.coalesce(F.nullif("parent_role", F.lit("")), "role")).drop("parent_role")
        found = _with_collisions(found, doc)
    else:
        found = found.withColumn("role", F.lit(None).cast("string")).withColumn("shared", F.lit(False))
    made = placeholder(F.col("entity_type"), F.col("entity_id"), clean_tag(F.col("role")), clean_tag(F.col("surface_tag")), mode, F.col("shared"))
    keys = [*_keys(spans, doc), "entity_type", "norm_term"]
    named = found.withColumn("placeholder", made).select(*keys, "entity_id", "role", "surface_tag", "placeholder")
    keyed = spans.withColumn("norm_term", F.lower(stripped(F.col("value"))))
    return join_on(keyed, named, keys).withColumn("needs_review", F.col("score") < REVIEW_BELOW)


def _labelled_in_place(spans: DataFrame, mode: str, doc: str) -> DataFrame:
    """Without roles and links: numbers by two windows over one partitioning by document, no join, spans read once."""
    keys = _keys(spans, doc)
    keyed = spans.withColumn("norm_term", F.lower(stripped(F.col("value"))))
    first = F.min("start").over(Window.partitionBy(*keys, "entity_type", "norm_term"))
    number = F.dense_rank().over(Window.partitionBy(*keys, "entity_type").orderBy("_first", "norm_term"))
    named = keyed.repartition(*keys).withColumn("_first", first).withColumn("entity_id", number).drop("_first")
    none = F.lit(None).cast("string")
    named = named.withColumn("role", none).withColumn("surface_tag", none)
    made = placeholder(F.col("entity_type"), F.col("entity_id"), F.lit(""), F.lit(""), mode)
    return named.withColumn("placeholder", made).withColumn("needs_review", F.col("score") < REVIEW_BELOW)


def _with_collisions(found: DataFrame, doc: str) -> DataFrame:
    shared = collisions(found, doc).withColumn("shared", F.lit(True))
    tagged = found.withColumn("role_tag", clean_tag(F.col("role")))
    return join_on(tagged, shared, [*_keys(found, doc), "entity_type", "role_tag"], "left").withColumn("shared", F.coalesce("shared", F.lit(False))).drop("role_tag")


def mapping(labelled: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, placeholder, original): the first occurrence's text of each term; of terms that share a placeholder, the last one's."""
    keys = [*_keys(labelled, doc), "placeholder"]
    first = labelled.groupBy(*keys, "norm_term").agg(F.min_by("value", "start").alias("original"), F.min("start").alias("at"))
    return first.groupBy(*keys).agg(F.max_by("original", "at").alias("original"))


def render(text: Column, spans: Column) -> Column:
    """Text with each span (start, end, placeholder; disjoint, sorted) replaced: kept pieces and placeholders joined once."""
    chained = F.transform(spans, lambda s, i: F.struct(F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)).alias("after"), s["start"].alias("start"), s["end"].alias("end"), s["placeholder"].alias("placeholder")))

    def pieces(part: Column) -> Column:
        low = F.get(part, F.lit(0))["after"]
        # places are counted from the beginning of a string, so a block of spans looks at its own part of the text only
        of = lambda x: F.transform(part, lambda s: F.concat(x["t"].substr(s["after"] - x["low"] + 1, s["start"] - s["after"]), s["placeholder"]))
        return let(F.struct(low.alias("low"), text.substr(low + 1, F.element_at(part, -1)["end"] - low).alias("t")), of)

    joined = lambda chained: F.concat(F.array_join(F.flatten(F.transform(blocks(chained), pieces)), ""), text.substr(F.element_at(chained, -1)["end"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(let(chained, joined))


def per_text(docs: DataFrame, of: DataFrame, doc: str, text: str) -> tuple[DataFrame, list[str]]:
    """docs with the keys that spans or mappings `of` have. If that is the id alone, it must tell texts apart."""
    if KEY in of.columns:
        return docs.withColumn(KEY, text_key(F.col(text))), [doc, KEY]
    unclear = docs.groupBy(doc).agg((F.countDistinct(F.xxhash64(text)) > 1).alias("_unclear"))
    return join_on(docs, unclear.where("_unclear"), [doc], "left"), [doc]


def sure(result: Column, rows: DataFrame) -> Column:
    if "_unclear" not in rows.columns:
        return result
    return F.when(F.col("_unclear"), F.raise_error(F.lit("several texts share an id, and spans don't say by text_key which they belong to"))).otherwise(result)


def anonymize(docs: DataFrame, labelled: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with anonymized_text: the spans of a document meet its text in one join. Null ids are one id."""
    rows, keys = per_text(docs, labelled, doc, text)
    per_doc = labelled.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start", "end", "placeholder"))).alias("_spans"))
    joined = join_on(rows, per_doc, keys, "left")
    made = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(render(F.col(text), F.col("_spans")))
    return joined.withColumn("anonymized_text", sure(made, joined)).drop("_spans", "_unclear", *(c for c in (KEY,) if c not in docs.columns and KEY not in labelled.columns))


def swapped(text: Column, mapping: Column) -> Column:
    """Text with every bracketed key that the mapping holds replaced, in one pass; without a mapping unchanged."""
    key = r"\[[^\[\]]+\]"
    pieces = F.zip_with(F.split(text, key, -1), F.regexp_extract_all(text, F.lit(key), F.lit(0)), lambda gap, k: F.concat(gap, F.coalesce(mapping[k], k, F.lit(""))))
    return F.when(F.coalesce(F.size(mapping), F.lit(0)) < 1, text).otherwise(F.array_join(pieces, ""))


def restore(docs: DataFrame, mapped: DataFrame, doc: str = "doc_id", text: str = "anonymized_text") -> DataFrame:
    """docs with restored_text: one pass over bracketed keys, so that an original that looks like a key is not replaced again.

    docs must hold text_key if the mapping does, as the anonymised text no longer tells it.
    """
    keys = [c for c in _keys(mapped, doc) if c in docs.columns]
    if keys != _keys(mapped, doc):
        raise ValueError(f"the mapping goes by {KEY}, which the documents lack")
    rows = docs if KEY in keys else per_text(docs, mapped, doc, text)[0]
    per_doc = mapped.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("_map"))
    joined = join_on(rows, per_doc, keys, "left")
    return joined.withColumn("restored_text", sure(swapped(F.col(text), F.col("_map")), joined)).drop("_map", "_unclear")


def residues_of(text: Column) -> Column:
    """array<struct<placeholder, word>>: placeholders right before a capitalised word left in the text."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(RESIDUE), F.lit(1)).alias("placeholder"), F.regexp_extract_all(text, F.lit(RESIDUE), F.lit(2)).alias("word"))


def residues(anonymized: DataFrame, doc: str = "doc_id", text: str = "anonymized_text") -> DataFrame:
    """(doc, placeholder, trailing_word): the first such word of each placeholder."""
    rows = anonymized.select(doc, F.posexplode(residues_of(F.col(text))).alias("k", "x"))
    return rows.groupBy(doc, F.col("x.placeholder").alias("placeholder")).agg(F.min_by("x.word", "k").alias("trailing_word"))


def segments(labelled: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, raw_start, raw_end, anon_start, anon_end): what stays between placeholders, by a running sum of length changes."""
    sound_unions(docs.sparkSession)
    keys = _keys(labelled, doc)
    ids = [F.col(doc), *([text_key(F.col(text)).alias(KEY)] if KEY in keys else [])]
    ends = docs.select(*ids, F.length(text).alias("start"), F.length(text).alias("end"), F.lit("").alias("placeholder"), F.lit(1).alias("last")).distinct()
    rows = labelled.select(*keys, "start", "end", "placeholder", F.lit(0).alias("last")).distinct().unionByName(ends)
    order = Window.partitionBy(*keys).orderBy("start", "last")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.length("placeholder") - (F.col("end") - F.col("start"))).over(before), F.lit(0))
    raw = rows.select(*keys, F.coalesce(F.lag("end").over(order), F.lit(0)).alias("raw_start"), F.col("start").alias("raw_end"), shift.cast("int").alias("shift"))
    shifted = [(F.col(c) + F.col("shift")).alias(f"anon_{c.removeprefix('raw_')}") for c in ("raw_start", "raw_end")]
    return raw.where("raw_end > raw_start").select(*keys, "raw_start", "raw_end", *shifted)
