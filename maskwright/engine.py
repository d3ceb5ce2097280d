"""The engine: documents in, entities, anonymised texts, mappings and reports out.

Detection, resolution, numbering and rendering are row-local column expressions in anonymize(): numbers are worked out
within a row's array of entities. The relational forms take one shuffle by document.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.spans import held, let
from .functions.text import clean_tag, stripped
from .operators import detect, label, resolve
from .shipping import sound_unions


@dataclass(frozen=True)
class Config:
    """None lets all entity types through, an empty tuple none."""

    detectors: Sequence[str] | None = None
    entity_types: Sequence[str] | None = None
    glossary: tuple[tuple[str, str], ...] = ()  #: (term, entity type)
    glossary_types: Sequence[str] | None = None
    user_ignore: tuple[str, ...] = ()
    default_ignore: tuple[str, ...] = ()
    modes: dict[str, str] = field(default_factory=dict)
    review_below: float = resolve.REVIEW_BELOW
    placeholders: str = "numbered"  #: one of label.MODES
    roles: dict[str, str] = field(default_factory=dict)  #: term -> role
    links: dict[str, tuple[str, str]] = field(default_factory=dict)  #: variant -> (its main term, tag)

    def __post_init__(self) -> None:
        for t in [*(self.entity_types or ()), *(t for _, t in self.glossary)]:
            if t not in detect.ENTITY_TYPES:
                warnings.warn(f"unknown entity type {t}", UserWarning, stacklevel=3)


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        sound_unions(spark)

    def with_spans(self, docs: DataFrame, into: str = "spans", external: DataFrame | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """docs with a column of the resolved entities of each text, sorted by start: an array of candidates.

        external: spans found elsewhere, say by a model: (doc, entity_type, start, end, score, method, recognizer), and
        text_key where an id has several texts. They meet the texts in a join by document; without them all is row-local.
        Spans that do not lie within the text go.
        """
        c = self.config
        found = [detect.spans_array(text, c.detectors, c.entity_types)]
        by_type: dict[str, list[str]] = {}
        for term, kind in c.glossary:
            by_type.setdefault(kind, []).append(term)
        found += [detect.term_spans(text, terms, kind, "glossary") for kind, terms in by_type.items()]
        if external is not None:
            docs = _with_external(docs, external, doc, text)
            found.append(F.col("_mw_external"))
        ignored = lambda terms: detect.term_spans(text, terms) if terms else None
        types = lambda names: None if names is None else list(names)
        rows = docs.withColumn(into, F.concat(*found) if len(found) > 1 else found[0]).drop("_mw_external")
        return rows.withColumn(into, held(resolve.resolve(F.col(into), F.col(text), ignored(c.user_ignore), ignored(c.default_ignore), types(c.entity_types), types(c.glossary_types), dict(c.modes) or None)))

    def detect(self, docs: DataFrame, doc: str = "doc_id", text: str = "text", external: DataFrame | None = None) -> DataFrame:
        """A row per entity: doc, text_key, start, end, value, entity_type, score, recognizer, method, seq."""
        rows = self.with_spans(docs.select(doc, text), "_mw_spans", external, doc, text)
        return rows.select(doc, label.text_key(F.col(text)).alias(label.KEY), F.explode("_mw_spans").alias("s")).select(doc, label.KEY, "s.*")

    def entities(self, docs: DataFrame, mode: str = "numbered", roles: DataFrame | None = None, links: DataFrame | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per entity with its placeholder; roles and links come as tables by document."""
        return label.label(self.detect(docs, doc, text), mode, roles, links, doc)

    def anonymize(self, docs: DataFrame, doc: str = "doc_id", text: str = "text", external: DataFrame | None = None) -> DataFrame:
        """docs with entities, anonymized_text, mapping and residues; narrow from scan to sink, but for external spans.

        residues are placeholders right before a capitalised word, a sign of a name found in part: their entities need
        review, as do those of a low score. Of terms that share a placeholder, mapping holds the first one's text.
        Columns of docs with these names are replaced.
        """
        c = self.config
        named = self.with_spans(docs, "entities", external, doc, text).withColumn("entities", held(numbered_in_row(F.col("entities"), c)))
        out = named.withColumn("anonymized_text", F.when(F.size("entities") == 0, F.col(text)).otherwise(label.render(F.col(text), F.col("entities"))))
        placed = F.array_sort(F.transform("entities", lambda e, i: F.struct(e["placeholder"].alias("key"), i.alias("i"), e["value"].alias("value"))))
        firsts = let(placed, lambda rows: F.filter(rows, lambda x, i: (i == 0) | (F.get(rows, i - 1)["key"] != x["key"])))
        out = out.withColumn("mapping", F.map_from_entries(F.transform(firsts, lambda x: F.struct(x["key"], x["value"]))))
        none = F.expr("cast(array() as array<struct<placeholder:string,word:string>>)")
        out = out.withColumn("residues", F.when(F.coalesce(F.size("entities"), F.lit(0)) == 0, none).otherwise(label.residues_of(F.col("anonymized_text"))))
        left_over = lambda e: F.exists("residues", lambda x: x["placeholder"] == e["placeholder"])
        return out.withColumn("entities", held(F.transform("entities", lambda e: e.withField("needs_review", e["needs_review"] | left_over(e)))))

    def restore(self, docs: DataFrame, text: str = "anonymized_text", mapping: str = "mapping") -> DataFrame:
        """docs with restored_text, from a mapping held in a column."""
        return docs.withColumn("restored_text", label.swapped(F.col(text), F.col(mapping)))


def _with_external(docs: DataFrame, external: DataFrame, doc: str, text: str) -> DataFrame:
    """docs with _mw_external, the candidates that the table external has for each text."""
    rows, keys = label.per_text(docs, external, doc, text)
    one = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "entity_type", F.col("score").cast("double").alias("score"), "recognizer", "method")
    grouped = external.groupBy(*keys).agg(F.array_sort(F.collect_set(one)).alias("_mw_external"))
    joined = label.join_on(rows, grouped, keys, "left")
    inside = F.filter("_mw_external", lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)))
    value = lambda s: F.col(text).substr(s["start"] + 1, s["end"] - s["start"])
    made = F.transform(inside, lambda s: F.struct(s["start"], s["end"], value(s), s["entity_type"], s["score"], s["recognizer"], s["method"], F.lit(0)).cast(detect.CANDIDATE))
    sure = label.sure(F.coalesce(made, F.expr(f"cast(array() as array<{detect.CANDIDATE}>)")), joined)
    return joined.withColumn("_mw_external", sure).drop("_unclear", *(c for c in (label.KEY,) if c not in docs.columns))


def numbered_in_row(spans: Column, config: Config) -> Column:
    """Entities with placeholders, as label.label gives them, within one row: spans are sorted by start.

    Terms are numbered by type in order of first appearance; variants come after all others, or share the number of their
    main term where the text holds it.
    """
    look = lambda pairs: F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)) if pairs else None
    parents = look({k: p for k, (p, _) in config.links.items() if k != p})
    tags, roles = look({k: t for k, (_, t) in config.links.items()}), look(config.roles)
    nothing = F.lit(None).cast("string")
    of = lambda table, term: nothing if table is None else table[term]
    key = lambda kind, term: F.concat(kind, F.lit("\0"), term)
    term_of = lambda k: F.substring_index(k, "\0", -1)
    variant = lambda term: of(parents, term).isNotNull()

    def numbers(keys: Column, kinds: Column) -> Column:
        """key -> number."""

        def of_kind(kind: Column) -> Column:
            own = F.filter(keys, lambda k: k.startswith(F.concat(kind, F.lit("\0"))))
            if parents is None:
                return F.transform(own, lambda k, i: F.struct(k.alias("k"), (i + 1).alias("n")))

            def both(own: Column) -> Column:
                mains = F.filter(own, lambda k: ~variant(term_of(k)))

                def placed(mains: Column) -> Column:
                    parent = lambda k: key(kind, of(parents, term_of(k)))
                    follows = lambda k: F.array_contains(mains, parent(k))
                    variants = F.filter(own, lambda k: variant(term_of(k)))
                    fresh = F.concat(mains, F.filter(variants, lambda k: ~follows(k)))
                    shared = F.transform(F.filter(variants, follows), lambda k: F.struct(k.alias("k"), F.array_position(mains, parent(k)).cast("int").alias("n")))
                    return F.concat(F.transform(fresh, lambda k, i: F.struct(k.alias("k"), (i + 1).alias("n"))), shared)

                return let(mains, placed)

            return let(own, both)

        return F.map_from_entries(F.flatten(F.transform(kinds, of_kind)))

    def named(rows: Column) -> Column:
        def one(r: Column, number: Column) -> Column:
            n, tag = number[key(r["entity_type"], r["term"])], of(tags, r["term"])
            tag = F.when(variant(r["term"]), F.coalesce(F.nullif(tag, F.lit("")), F.lit("VARIANT"))).otherwise(tag)
            role = F.coalesce(F.nullif(of(roles, of(parents, r["term"])) if parents is not None else nothing, F.lit("")), of(roles, r["term"]))
            return r.withField("n", n).withField("tag", clean_tag(tag)).withField("role", clean_tag(role))

        def written(done: Column) -> Column:
            head = lambda r: F.concat(r["entity_type"], F.lit("\0"), r["role"], F.lit("\0"))
            holders = F.array_distinct(F.transform(done, lambda r: F.concat(head(r), r["n"].cast("string"))))

            def out(holders: Column | None) -> Column:
                shared = lambda r: F.lit(False) if holders is None else F.size(F.filter(holders, lambda h: h.startswith(head(r)))) > 1
                place = lambda r: label.placeholder(r["entity_type"], r["n"], r["role"], r["tag"], config.placeholders, shared(r))
                fields = ("start", "end", "value", "entity_type", "score")
                return F.transform(done, lambda r: F.struct(*(r[f].alias(f) for f in fields), place(r).alias("placeholder"), (r["score"] < config.review_below).alias("needs_review")))

            return out(None) if roles is None else let(holders, out)

        keys = F.array_distinct(F.transform(rows, lambda r: key(r["entity_type"], r["term"])))
        kinds = F.array_distinct(F.transform(rows, lambda r: r["entity_type"]))
        table = let(F.struct(keys.alias("keys"), kinds.alias("kinds")), lambda x: numbers(x["keys"], x["kinds"]))
        return let(let(table, lambda number: F.transform(rows, lambda r: one(r, number))), written)

    return let(F.transform(spans, lambda s: s.withField("term", F.lower(stripped(s["value"])))), named)


def report(labelled: DataFrame, with_originals: bool = True, doc: str = "doc_id") -> DataFrame:
    """Report rows; without a mapping every original is redacted."""
    original = F.col("value") if with_originals else F.lit("[REDACTED]")
    return labelled.select(doc, "entity_type", original.alias("original"), "placeholder", "start", "end", F.round("score", 3).alias("score"), "needs_review")
