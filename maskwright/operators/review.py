"""Review state: groups of occurrences, links between names, trees, homonyms, overrides, actions, sort orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import sound_unions

#: fixed values: titles before a name
HONORIFICS = ("frau", "herr", "herrn", "dr", "dr.", "prof", "prof.", "prof. dr.", "dozent", "dozentin", "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "miss", "sir", "madam")


def groups(occurrences: DataFrame, keys: list[str]) -> DataFrame:
    return occurrences.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.bool_or("needs_review").alias("needs_review"), F.min("start").alias("first_start"))


#: tags of the rules by rank
RULES = ("GENITIV", "VORNAME", "NACHNAME", "ANREDE")


def link_proposals(people: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """people(id, name, entity_type, parent_id[, scope]) -> proposals: one candidate is proposed, several are listed.

    Four rules on name parts, each candidate once under its first rule: genitive stem, first name, last name, title.
    Candidates are counted and listed once for each name part, and an id looks its parts up: its candidates are those of
    the stem and those of the name, less those of both. So no pairs of ids and candidates are made, however many share a
    part. Only ids that stand for several names have theirs brought together one by one.
    """
    sound_unions(people.sparkSession)
    scope = scope or []
    free = people.where((F.col("entity_type") == "PERSON") & (F.coalesce("parent_id", F.lit("")) == ""))
    named = free.where("id is not null and name is not null").select(*scope, "id", F.trim("name").alias("name"))
    held = named.groupBy(*scope, "id").agg(F.min("name").alias("name"), F.max("name").alias("other"))
    parts = _candidates_by_part(named, scope)
    keys = parts.groupBy(*scope, "kind", "part").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("candidate", "rank")).alias("best"), F.collect_set("candidate").alias("all"))

    asks = _asks(held.where("name = other"), scope)
    both = asks.where("stem is not null").select(*scope, "stem", "part").distinct()
    both = _meet(both, parts.where("kind = 'name'").select(*scope, "part", "candidate"), [*scope, "part"], "inner")
    both = _meet(both, parts.where("kind = 'word'").select(*scope, F.col("part").alias("stem"), "candidate"), [*scope, "stem", "candidate"], "inner")
    both = both.groupBy(*scope, "stem", "part").agg(F.count(F.lit(1)).alias("twice"))
    stems = keys.where("kind = 'word'").select(*scope, F.col("part").alias("stem"), F.col("n").alias("stem_n"), F.col("best").alias("stem_best"), F.col("all").alias("stem_all"))
    met = _meet(_meet(_meet(asks, stems, [*scope, "stem"]), keys.where("kind <> 'word'"), [*scope, "kind", "part"]), both, [*scope, "stem", "part"])
    zero, none = F.lit(0), F.array().cast(keys.schema["all"].dataType)
    counted = met.select(
        *scope,
        "id",
        (F.coalesce("stem_n", zero) + F.coalesce("n", zero) - F.coalesce("twice", zero)).alias("n_candidates"),
        F.coalesce("stem_best", "best").alias("best"),
        F.array_union(F.coalesce("stem_all", none), F.coalesce("all", none)).alias("all"),
    ).where("n_candidates > 0")

    several = _meet(named, held.where("name <> other").select(*scope, "id"), [*scope, "id"], "inner").distinct()
    sought = _asks(several, scope).select(*scope, "id", F.explode(F.array(F.struct("kind", "part"), F.struct(F.lit("word").alias("kind"), F.col("stem").alias("part")))).alias("x")).select(*scope, "id", "x.kind", "x.part")
    pairs = _meet(sought, parts, [*scope, "kind", "part"], "inner").where("id <> candidate").groupBy(*scope, "id", "candidate").agg(F.min("rank").alias("rank"))
    paired = pairs.groupBy(*scope, "id").agg(F.count(F.lit(1)).alias("n_candidates"), F.min(F.struct("candidate", "rank")).alias("best"), F.collect_set("candidate").alias("all"))

    one = lambda c: F.when(F.col("n_candidates") == 1, c)
    tag = F.get(F.array(*map(F.lit, RULES)), F.col("best.rank"))
    return counted.unionByName(paired).select(*scope, "id", "n_candidates", one(F.col("best.candidate")).alias("proposed_parent"), one(tag).alias("proposed_tag"), F.when(F.col("n_candidates") > 1, F.array_sort("all")).alias("candidates"))


def _words(names: DataFrame) -> tuple[DataFrame, Column, Column, Column, Column]:
    """names(name) with ws, and how many words, the first, the last, and whether the first is a title."""
    first, last = F.rtrim(F.lower(F.get("ws", F.lit(0))), F.lit(".")), F.lower(F.element_at("ws", -1))
    return names.withColumn("ws", F.split("name", r"\s+")), F.size("ws"), first, last, first.isin(*HONORIFICS)


def _candidates_by_part(named: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, kind, part, candidate, rank): each id under its words, under its first and last name, and for titles under its last name."""
    rows, n, first, last, titled = _words(named)
    entry = lambda kind, part, rank: F.struct(F.lit(kind).alias("kind"), part.alias("part"), F.lit(rank).alias("rank"))
    full = F.when(n > 1, F.array(entry("name", first, 1)))
    family = F.when((n > 1) & ~titled, F.array(entry("name", last, 2), entry("title", last, 3)))
    words = F.transform("ws", lambda x: entry("word", F.lower(x), 0))
    empty = F.array().cast("array<struct<kind: string, part: string, rank: int>>")
    found = rows.select(*scope, F.col("id").alias("candidate"), F.explode(F.concat(words, F.coalesce(full, empty), F.coalesce(family, empty))).alias("x"))
    return found.groupBy(*scope, F.col("x.kind").alias("kind"), F.col("x.part").alias("part"), "candidate").agg(F.min("x.rank").alias("rank"))


def _asks(names: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, id, kind, part, stem): single words ask for names and, unless equal or empty, by their genitive stem; titles ask for last names."""
    rows, n, first, last, titled = _words(names)
    low, stem = F.lower("name"), F.lower(F.trim(F.regexp_replace("name", "(?i)(s|'s|’s)$", "")))
    single = n == 1
    return rows.where(single | titled).select(*scope, "id", F.when(single, "name").otherwise("title").alias("kind"), F.when(single, low).otherwise(last).alias("part"), F.when(single & (F.length(stem) > 0) & (stem != low), stem).alias("stem"))


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """An equi-join in which null scopes are equal; right's keys go."""
    known = right.select(*(F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns))
    parts = ("kind", "part", "stem", "candidate")
    on = [left[c] == known[f"_{c}"] if c in parts else left[c].eqNullSafe(known[f"_{c}"]) for c in keys]
    return left.join(known, on, how).drop(*(f"_{c}" for c in keys))


def tree(items: DataFrame) -> DataFrame:
    """items(id, name, parent_id): roots with their children's names. A missing or own parent makes a root; one level deep."""
    parents = items.select(F.col("id").alias("pid"))
    marked = items.join(parents, (items["parent_id"] == parents["pid"]) & (items["parent_id"] != items["id"]), "left")
    children = marked.where("pid is not null").groupBy("pid").agg(F.array_sort(F.collect_list("name")).alias("children"))
    roots = marked.where("pid is null").select("id", "name")
    return roots.join(children, roots["id"] == children["pid"], "left").select("id", "name", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def homonyms(occurrences: DataFrame) -> DataFrame:
    """Texts of a document that stand for more than one group, in order of first sight."""
    return occurrences.groupBy("doc_id", "text_key").agg(F.countDistinct("group_id").alias("n_nodes"), F.min("start").alias("first_seen")).where("n_nodes > 1")


def rebind(overrides: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Overrides(fp, target, expected, entity_type, role) found again in occurrences(occ_id, fp, value, base) after a new analysis.

    Fingerprints must be unique on both sides and texts equal; a target's overrides must agree and not hit a base group's id.
    """
    once = lambda rows: rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("fp"))).where("_n = 1").drop("_n")
    v, o = once(overrides.where("target is not null and target <> ''")), once(occurrences)
    hit = v.join(o, (v["fp"] == o["fp"]) & (v["expected"] == o["value"])).select("occ_id", "target", "entity_type", "role")
    agreed = hit.groupBy("target").agg(F.countDistinct(F.struct("entity_type", F.coalesce("role", F.lit("")).alias("r"))).alias("n")).where("n = 1").select("target")
    return hit.join(agreed, "target", "left_semi").join(occurrences.select(F.col("base").alias("target")), "target", "left_anti")


def apply_actions(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """Group actions as a keyed update: enable, disable, accept_link (payload: parent), unlink, mark_manual, to_glossary.

    A parent that gets a child and has no tag is the full name.
    """
    parents = actions.where("action = 'accept_link'").select(F.col("payload").alias("group_id"), F.lit(True).alias("is_parent")).distinct()
    j = rows.join(actions, "group_id", "left").join(parents, "group_id", "left")
    on = lambda *names: F.coalesce(F.col("action").isin(*names), F.lit(False))
    return j.select(
        "group_id",
        F.when(on("disable", "ignore"), False).when(on("enable", "mark_manual", "to_glossary"), True).otherwise(F.col("enabled")).alias("enabled"),
        F.when(on("accept_link"), F.col("payload")).when(~on("unlink"), F.col("parent_id")).alias("parent_id"),
        F.when(on("accept_link"), F.coalesce("surface_tag", F.lit("VORNAME"))).when(on("unlink"), None).when(F.coalesce("is_parent", F.lit(False)), F.coalesce("surface_tag", F.lit("VOLLNAME"))).otherwise(F.col("surface_tag")).alias("surface_tag"),
        F.when(on("mark_manual"), "manual").when(on("to_glossary"), "glossary").otherwise(F.col("method")).alias("method"),
        F.when(on("mark_manual"), False).otherwise(F.col("needs_review")).alias("needs_review"),
    )


def ranked(groups_: DataFrame, doc: str = "doc_id") -> DataFrame:
    """groups(doc, text_key, group_id, entity_type, n, needs_review, first_start) with its place in five review orders; ties end in text and id."""
    last = ("text_key", "group_id")
    orders = {
        "alphabetical": last,
        "by_first": ("first_start", *last),
        "by_frequency": (F.desc("n"), "first_start", *last),
        "by_type": ("entity_type", *last),
        "review_first": (F.desc("needs_review"), F.desc("n"), "first_start", *last),
    }
    return groups_.withColumns({k: F.row_number().over(Window.partitionBy(doc).orderBy(*o)) for k, o in orders.items()})


def link_label(text: Column, entity_type: Column, role: Column, group_id: Column, text_key: Column, n: Column) -> Column:
    """A group as shown where links are chosen: text, type, role, base or a short id of a split-off group, and its count."""
    kind = F.when(group_id == text_key, "base").otherwise(F.concat(F.lit("split "), F.substring(F.replace(group_id, F.lit("split_"), F.lit("")), 1, 6)))
    parts = F.concat_ws(", ", entity_type, F.nullif(role, F.lit("")), kind, F.concat(n.cast("string"), F.lit("x")))
    return F.concat(text, F.lit(" ("), parts, F.lit(")"))


def source_class(method: Column, glossary_match: Column) -> Column:
    """Where an occurrence comes from: glossary hits by kind of match, unknown methods as library."""
    return F.when(method == "glossary", F.concat(F.lit("glossary_"), F.coalesce(glossary_match, F.lit("direct")))).when(method.isin("regex", "eupii", "gliner", "manual", "library"), method).otherwise("library")


def split_occurrence(occurrences: DataFrame, moves: DataFrame) -> DataFrame:
    """occurrences(occ_id, group_id) moved by moves(occ_id, target); a null target takes an occurrence back to its base group."""
    m = moves.withColumn("_moved", F.lit(True))
    return occurrences.join(m, "occ_id", "left").withColumn("group_id", F.when(F.col("_moved") & F.col("target").isNull(), F.col("base")).otherwise(F.coalesce("target", "group_id"))).drop("target", "_moved")
