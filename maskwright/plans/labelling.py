"""Queries over numbering, placeholders, substitution, restoring, links and review state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import engine
from ..functions import text as T
from ..operators import detect, label, resolve, review
from .detection import EVENT_SPANS, SCANNED, event_spans, scan_sql
from .registry import documents, inline, inline_sql, query, table

KINDS = ("email", "ip", "card", "phone")
TYPES = {"email": "EMAIL_ADDRESS", "ip": "IP_ADDRESS", "card": "CREDIT_CARD", "phone": "PHONE_NUMBER"}
#: the documents' entities for the oracle: found, resolved by type order and length, numbered by first appearance
CHAIN = f"""{", ".join(scan_sql(*SCANNED[k], name=k) for k in KINDS)},
    every AS ({" UNION ALL ".join(f"SELECT doc_id, '{TYPES[k]}' AS entity_type, {n} AS seq, \"start\", \"end\", value FROM {k}" for n, k in enumerate(KINDS))}),
    spans AS (SELECT * FROM every a WHERE NOT EXISTS (SELECT 1 FROM every b WHERE b.doc_id = a.doc_id AND b."start" < a."end" AND b."end" > a."start"
        AND (b."end" - b."start" > a."end" - a."start" OR (b."end" - b."start" = a."end" - a."start" AND b.seq < a.seq)))),
    firsts AS (SELECT doc_id, entity_type, lower(value) AS term, min("start") AS f FROM spans GROUP BY ALL),
    ids AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY f) AS n FROM firsts),
    named AS (SELECT s.*, i.n, '[' || s.entity_type || '_' || i.n || ']' AS placeholder FROM spans s JOIN ids i ON s.doc_id = i.doc_id AND s.entity_type = i.entity_type AND lower(s.value) = i.term)"""
TEXTS = f"""{CHAIN}, cut AS (SELECT n.doc_id, n."start", n.placeholder, substr(d.text, coalesce(lag(n."end") OVER w, 0) + 1, n."start" - coalesce(lag(n."end") OVER w, 0)) AS before
        FROM named n JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY n.doc_id ORDER BY n."start")),
    tails AS (SELECT doc_id, max("end") AS e FROM named GROUP BY doc_id),
    built AS (SELECT doc_id, string_agg(before || placeholder, '' ORDER BY "start") AS head FROM cut GROUP BY doc_id),
    result AS (SELECT d.doc_id, d.text, coalesce(b.head || substr(d.text, t.e + 1), d.text) AS anonymized_text FROM documents d LEFT JOIN built b USING (doc_id) LEFT JOIN tails t USING (doc_id))"""
CONFIG = engine.Config(detectors=KINDS)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.Engine(spark, CONFIG).entities(documents(spark, sf_dir))


@query(f"""WITH RECURSIVE {CHAIN} SELECT doc_id, entity_type, "start", "end", value, placeholder FROM named""")
def anonymize_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", "entity_type", "start", "end", "value", "placeholder")


@query(f"""WITH RECURSIVE {TEXTS} SELECT doc_id, anonymized_text, length(anonymized_text) AS n_chars FROM result""")
def anonymize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine.Engine(spark, CONFIG).anonymize(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "anonymized_text", F.length("anonymized_text").cast("long").alias("n_chars"))


@query("SELECT doc_id, text AS restored_text FROM documents")
def restore_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine.Engine(spark, CONFIG)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return e.restore(e.anonymize(docs).select("doc_id", "anonymized_text", "mapping")).select("doc_id", "restored_text")


@query(f"""WITH RECURSIVE {CHAIN} SELECT doc_id, placeholder, arg_min(value, "start") AS original FROM named GROUP BY doc_id, placeholder""")
def mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.mapping(labelled(spark, sf_dir)).drop(label.KEY)


@query(f"""WITH RECURSIVE {CHAIN} SELECT doc_id, entity_type, placeholder, '[REDACTED]' AS original, count(*) AS n FROM named GROUP BY ALL""")
def report_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.report(labelled(spark, sf_dir), with_originals=False).groupBy("doc_id", "entity_type", "placeholder", "original").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {TEXTS}, e AS (SELECT doc_id, "start", "end", length(placeholder) AS p, 0 AS last FROM named UNION ALL SELECT doc_id, length(text), length(text), 0, 1 FROM documents),
    s AS (SELECT doc_id, coalesce(lag("end") OVER w, 0) AS raw_start, "start" AS raw_end, coalesce(sum(p - ("end" - "start")) OVER (PARTITION BY doc_id ORDER BY "start", last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY "start", last))
    SELECT doc_id, raw_start::INT AS raw_start, raw_end::INT AS raw_end, (raw_start + shift)::INT AS anon_start, (raw_end + shift)::INT AS anon_end FROM s WHERE raw_end > raw_start""")
def unchanged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.segments(labelled(spark, sf_dir), documents(spark, sf_dir)).drop(label.KEY)


@query(f"""WITH s AS ({EVENT_SPANS}) SELECT doc_id, entity_type, event_id % 7 AS grp, count(*) AS n, min(score) AS min_score, max(score) AS max_score, bool_or(score < 0.85) AS needs_review, min("start") AS first_start FROM s GROUP BY ALL""")
def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_spans(spark, sf_dir).withColumn("grp", F.col("event_id") % 7).withColumn("needs_review", F.col("score") < 0.85)
    return review.groups(rows, ["doc_id", "entity_type", "grp"])


NUMBERED_SQL = f"""s AS ({EVENT_SPANS}), t AS (SELECT doc_id, entity_type, 'name ' || (event_id % 9) AS norm_term, min("start") AS first_start FROM s GROUP BY ALL)"""


def event_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = event_spans(spark, sf_dir).withColumn("value", F.concat(F.lit("Name "), F.col("event_id") % 9))
    return label.terms(spans)


@query(f"""WITH {NUMBERED_SQL} SELECT doc_id, entity_type, norm_term, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY first_start, norm_term)::INT AS entity_id FROM t""")
def first_appearance_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.numbered(event_terms(spark, sf_dir)).select("doc_id", "entity_type", "norm_term", "entity_id")


LINKS = "('name 1', 'name 2', 'VORNAME'), ('name 3', 'name 2', ''), ('name 4', 'nobody', 'NACHNAME'), ('name 5', 'name 5', 'VOLLNAME')"


@query(f"""WITH {NUMBERED_SQL}, {inline_sql("l", "child, parent, tag", LINKS)},
    m AS (SELECT t.*, l.parent, l.tag, coalesce(l.parent <> t.norm_term, false) AS is_child FROM t LEFT JOIN l ON l.child = t.norm_term),
    f AS (SELECT m.*, EXISTS (SELECT 1 FROM m p WHERE p.doc_id = m.doc_id AND p.entity_type = m.entity_type AND p.norm_term = m.parent AND NOT p.is_child) AND is_child AS follows FROM m),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY is_child, first_start, norm_term) AS id FROM f WHERE NOT follows)
    SELECT doc_id, entity_type, norm_term, id::INT AS entity_id, CASE WHEN is_child THEN coalesce(nullif(tag, ''), 'VARIANT') ELSE tag END AS surface_tag FROM o
    UNION ALL SELECT f.doc_id, f.entity_type, f.norm_term, o.id::INT, coalesce(nullif(f.tag, ''), 'VARIANT') FROM f JOIN o ON o.doc_id = f.doc_id AND o.entity_type = f.entity_type AND o.norm_term = f.parent AND NOT o.is_child WHERE f.follows""")
def linked_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_terms(spark, sf_dir)
    links = found.select("doc_id").distinct().crossJoin(F.broadcast(inline(spark, "child_term, parent_term, surface_tag", LINKS)))
    return label.numbered(found, links).select("doc_id", "entity_type", "norm_term", "entity_id", "surface_tag")


CUSTOMERS = """SELECT c_nationkey AS doc_id, 'PERSON' AS entity_type, lower(c_name) AS norm_term, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INT AS entity_id,
    CASE c_custkey % 4 WHEN 0 THEN ' student/in ' WHEN 1 THEN 'Prüfer' WHEN 2 THEN 'Role ' || c_custkey ELSE NULL END AS role, CASE WHEN c_custkey % 5 = 0 THEN 'vor name' END AS surface_tag FROM customer"""


def customer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("mw_customer")
    return spark.sql(CUSTOMERS.replace("FROM customer", "FROM mw_customer").replace("::INT", ""))


_TAG = "trim(regexp_replace(upper(trim(coalesce({c}, ''))), '[^A-Za-z0-9_ÄÖÜäöüß]+', '_', 'g'), '_')"
_ROLE, _SURFACE = _TAG.format(c="role"), _TAG.format(c="surface_tag")
COLLIDING = f"""c AS ({CUSTOMERS}), r AS (SELECT *, {_ROLE} AS rt, {_SURFACE} AS st FROM c),
    x AS (SELECT doc_id, entity_type, rt FROM r WHERE rt <> '' GROUP BY ALL HAVING count(DISTINCT entity_id) > 1)"""


@query(f"WITH {COLLIDING} SELECT doc_id, entity_type, rt AS role_tag FROM x")
def role_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.collisions(customer_roles(spark, sf_dir))


@query(f"""WITH {COLLIDING}, y AS (SELECT r.*, x.rt IS NOT NULL AS shared, CASE WHEN st = '' THEN '' ELSE '_' || st END AS tag FROM r LEFT JOIN x ON x.doc_id = r.doc_id AND x.rt = r.rt),
    z AS (SELECT *, '[PERSON_' || entity_id || tag || ']' AS plain, '[PERSON_' || entity_id || '_' || rt || tag || ']' AS both_, '[PERSON_' || rt || tag || ']' AS alone FROM y)
    SELECT doc_id, norm_term, CASE WHEN rt <> '' AND shared THEN both_ ELSE plain END AS numbered, CASE WHEN rt <> '' THEN both_ ELSE plain END AS numbered_role,
        CASE WHEN rt = '' THEN plain WHEN shared THEN both_ ELSE alone END AS role_only, plain AS preview FROM z""")
def placeholder_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label._with_collisions(customer_roles(spark, sf_dir), "doc_id")
    named = lambda mode, adds=True: label.placeholder(F.col("entity_type"), F.col("entity_id"), T.clean_tag(F.col("role")), T.clean_tag(F.col("surface_tag")), mode, F.col("shared"), adds)
    return rows.select("doc_id", "norm_term", *(named(m).alias(m) for m in label.MODES), named("numbered", False).alias("preview"))


RESIDUE_TEXTS = "(1, '[PERSON_1] Meier kam. [PERSON_1] Huber [PERSON_2] und'), (2, 'nichts'), (3, '[A_B_1]  Ort [A_B_1] Xyz'), (4, '[PERSON_1] in Bern')"


@query(f"""WITH {inline_sql("t", "doc_id, anonymized_text", RESIDUE_TEXTS)}, p AS (SELECT doc_id, unnest(regexp_extract_all(anonymized_text, '(\\[[A-Z0-9_ÄÖÜ]+\\])\\s+([A-ZÄÖÜ][a-zäöüßA-ZÄÖÜ\\-]{{2,}})', 1)) AS placeholder,
        unnest(regexp_extract_all(anonymized_text, '(\\[[A-Z0-9_ÄÖÜ]+\\])\\s+([A-ZÄÖÜ][a-zäöüßA-ZÄÖÜ\\-]{{2,}})', 2)) AS w, generate_subscripts(regexp_extract_all(anonymized_text, '(\\[[A-Z0-9_ÄÖÜ]+\\])\\s+([A-ZÄÖÜ][a-zäöüßA-ZÄÖÜ\\-]{{2,}})', 2), 1) AS k FROM t)
    SELECT doc_id, placeholder, arg_min(w, k) AS trailing_word FROM p GROUP BY doc_id, placeholder""")
def residue_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.residues(inline(spark, "doc_id, anonymized_text", RESIDUE_TEXTS))


NAMES = """('a', 'Julia Meier', 0), ('b', 'Frau Meier', 0), ('c', 'Julias', 0), ('d', 'Mr. Smith', 0), ('e', 'John Smith', 0), ('f', 'Julia', 0), ('g', 'Smith', 0), ('h', 'Anna Smith', 0), ('i', 'Bern', 0)"""
_PEOPLE = f"""SELECT id, name, 'PERSON' AS entity_type, '' AS parent_id, k FROM (SELECT * FROM (VALUES {NAMES}) AS t(id, name, k)) AS t
    UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Herr Nach' || (c_custkey % 40) WHEN c_custkey % 3 = 1 THEN 'Vor' || c_custkey || ' Nach' || (c_custkey % 50) ELSE 'Vor' || (c_custkey - 1) || 's' END, 'PERSON', '', c_custkey FROM customer"""
_HONORIFIC = "('frau','herr','herrn','dr','dr.','prof','prof.','prof. dr.','dozent','dozentin','mr','mr.','mrs','mrs.','ms','ms.','miss','sir','madam')"


@query(f"""WITH p AS ({_PEOPLE}), w AS (SELECT id, name, lower(name) AS low, string_split(name, ' ') AS ws FROM p),
    words AS (SELECT DISTINCT id, low, lower(unnest(ws)) AS key FROM w), firsts AS (SELECT id, low, rtrim(lower(ws[1]), '.') AS key FROM w WHERE len(ws) > 1),
    lasts AS (SELECT id, low, lower(ws[len(ws)]) AS key FROM w WHERE len(ws) > 1 AND rtrim(lower(ws[1]), '.') NOT IN {_HONORIFIC}),
    stems AS (SELECT id, low, lower(regexp_replace(name, '(s|''s|’s)$', '', 'i')) AS key FROM w WHERE len(ws) = 1),
    c AS (SELECT s.id, x.id AS cand, 1 AS rule, 'GENITIV' AS tag FROM stems s JOIN words x ON x.key = s.key WHERE s.key <> s.low AND x.id <> s.id AND x.low <> s.low
        UNION ALL SELECT s.id, x.id, 2, 'VORNAME' FROM w s JOIN firsts x ON x.key = s.low WHERE len(s.ws) = 1 AND x.id <> s.id AND x.low <> s.low
        UNION ALL SELECT s.id, x.id, 3, 'NACHNAME' FROM w s JOIN lasts x ON x.key = s.low WHERE len(s.ws) = 1 AND x.id <> s.id AND x.low <> s.low
        UNION ALL SELECT s.id, x.id, 4, 'ANREDE' FROM w s JOIN lasts x ON x.key = lower(s.ws[len(s.ws)]) WHERE len(s.ws) >= 2 AND rtrim(lower(s.ws[1]), '.') IN {_HONORIFIC} AND x.id <> s.id AND x.low <> s.low),
    u AS (SELECT id, cand, arg_min(tag, rule) AS tag FROM c GROUP BY id, cand)
    SELECT id, count(*) AS n_candidates, CASE WHEN count(*) = 1 THEN min(cand) END AS proposed_parent, CASE WHEN count(*) = 1 THEN min(tag) END AS proposed_tag FROM u GROUP BY id""")
def link_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("mw_customer")
    people = spark.sql(_PEOPLE.replace("FROM customer", "FROM mw_customer"))
    return review.link_proposals(people).select("id", "n_candidates", "proposed_parent", "proposed_tag")


TREE = "('1', 'A', NULL), ('2', 'B', '1'), ('3', 'C', '1'), ('4', 'D', '9'), ('5', 'E', '5')"


@query(f"""WITH {inline_sql("t", "id, name, parent_id", TREE)}, r AS (SELECT t.*, p.id IS NOT NULL AND t.parent_id <> t.id AS child FROM t LEFT JOIN t p ON p.id = t.parent_id)
    SELECT r.id, r.name, count(c.id) AS n_children, string_agg(c.name, ',' ORDER BY c.name) AS children FROM r LEFT JOIN r c ON c.child AND c.parent_id = r.id WHERE NOT r.child GROUP BY r.id, r.name""")
def entity_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.tree(inline(spark, "id, name, parent_id", TREE)).select("id", "name", F.size("children").cast("long").alias("n_children"), F.when(F.size("children") > 0, F.array_join("children", ",")).alias("children"))


@query(f"""WITH s AS ({EVENT_SPANS}) SELECT doc_id, 'key' || (event_id % 5) AS text_key, count(DISTINCT event_id % 10) AS n_nodes, min("start") AS first_seen FROM s GROUP BY ALL HAVING count(DISTINCT event_id % 10) > 1""")
def homonym_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_spans(spark, sf_dir).select("doc_id", F.concat(F.lit("key"), F.col("event_id") % 5).alias("text_key"), (F.col("event_id") % 10).alias("group_id"), "start")
    return review.homonyms(rows)


GROUPED = f"""g AS (SELECT doc_id, 'name ' || (event_id % 6) AS text_key, CASE WHEN event_id % 4 = 0 THEN 'split_' || (event_id % 12) ELSE 'name ' || (event_id % 6) END AS group_id, min(entity_type) AS entity_type, count(*) AS n, bool_or(score < 0.6) AS needs_review, min("start") AS first_start FROM ({EVENT_SPANS}) GROUP BY ALL)"""


def grouped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    key = F.concat(F.lit("name "), (e % 6).cast("string"))
    rows = event_spans(spark, sf_dir).withColumn("text_key", key).withColumn("group_id", F.when(e % 4 == 0, F.concat(F.lit("split_"), (e % 12).cast("string"))).otherwise(key))
    return rows.groupBy("doc_id", "text_key", "group_id").agg(F.min("entity_type").alias("entity_type"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("score") < 0.6).alias("needs_review"), F.min("start").alias("first_start"))


def _place(order: str) -> str:
    return f"row_number() OVER (PARTITION BY doc_id ORDER BY {order})::INT"


@query(f"""WITH {GROUPED} SELECT doc_id, text_key, group_id, {_place("text_key, group_id")} AS alphabetical, {_place("first_start, text_key, group_id")} AS by_first, {_place("n DESC, first_start, text_key, group_id")} AS by_frequency,
    {_place("entity_type, text_key, group_id")} AS by_type, {_place("needs_review DESC, n DESC, first_start, text_key, group_id")} AS review_first FROM g""")
def review_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.ranked(grouped_events(spark, sf_dir)).select("doc_id", "text_key", "group_id", "alphabetical", "by_first", "by_frequency", "by_type", "review_first")


@query(f"""WITH {GROUPED} SELECT doc_id, group_id, text_key || ' (' || entity_type || ', ' || CASE WHEN n > 3 THEN 'often, ' ELSE '' END || CASE WHEN group_id = text_key THEN 'base' ELSE 'split ' || substr(replace(group_id, 'split_', ''), 1, 6) END || ', ' || n || 'x)' AS label FROM g""")
def link_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return grouped_events(spark, sf_dir).select("doc_id", "group_id", review.link_label(c("text_key"), c("entity_type"), F.when(c("n") > 3, "often"), c("group_id"), c("text_key"), c("n")).alias("label"))


@query("""WITH e AS (SELECT doc_id, text, (doc_id % 40)::INT AS s, (doc_id % 40 + 6)::INT AS e FROM documents)
    SELECT doc_id, md5(concat_ws('|', substr(text, greatest(s - 50, 0) + 1, s - greatest(s - 50, 0)), substr(text, s + 1, e - s), substr(text, e + 1, 50))) AS fingerprint FROM e""")
def context_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("doc_id") % 40).cast("int")
    return documents(spark, sf_dir).select("doc_id", T.fingerprint(F.col("text"), at, at + 6).alias("fingerprint"))


OVERRIDES = "('f1', 'g1', 'Weber', 'PERSON', 'chef'), ('f2', 'g2', 'Weber', 'PERSON', NULL), ('f2', 'g3', 'Weber', 'PERSON', NULL), ('f3', 'g4', 'Huber', 'PERSON', NULL), ('f4', 'b2', 'Moser', 'PERSON', NULL), ('f5', 'g5', 'Roth', 'PERSON', 'x'), ('f6', 'g5', 'Roth', 'PERSON', 'y'), ('f7', 'g7', 'Frei', 'ORGANIZATION', NULL)"
OCCURRENCES = "('o1', 'f1', 'Weber', 'b1'), ('o2', 'f2', 'Weber', 'b1'), ('o3', 'f3', 'Meier', 'b2'), ('o4', 'f4', 'Moser', 'b3'), ('o5', 'f5', 'Roth', 'b4'), ('o6', 'f6', 'Roth', 'b4'), ('o7', 'f7', 'Frei', 'b5'), ('o8', 'f7', 'Frei', 'b5')"


@query(f"""WITH {inline_sql("v", "fp, target, expected, entity_type, role", OVERRIDES)}, {inline_sql("o", "occ_id, fp, value, base", OCCURRENCES)},
    j AS (SELECT o.occ_id, v.target, v.entity_type, v.role FROM v JOIN o ON o.fp = v.fp AND o.value = v.expected WHERE v.fp IN (SELECT fp FROM v GROUP BY fp HAVING count(*) = 1) AND o.fp IN (SELECT fp FROM o GROUP BY fp HAVING count(*) = 1)),
    k AS (SELECT target FROM j GROUP BY target HAVING count(DISTINCT (entity_type, coalesce(role, ''))) = 1)
    SELECT occ_id, target, role FROM j WHERE target IN (SELECT target FROM k) AND target NOT IN (SELECT base FROM o) AND target <> ''""")
def fingerprint_rebind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.rebind(inline(spark, "fp, target, expected, entity_type, role", OVERRIDES), inline(spark, "occ_id, fp, value, base", OCCURRENCES)).select("occ_id", "target", "role")


ACTIONS = "('g1', 'disable', NULL), ('g2', 'accept_link', 'g3'), ('g4', 'unlink', NULL), ('g5', 'mark_manual', NULL), ('g6', 'to_glossary', NULL)"
GROUPS = "('g1', true, NULL, NULL, 'regex', true), ('g2', true, NULL, NULL, 'gliner', true), ('g3', true, NULL, NULL, 'gliner', false), ('g4', true, 'g3', 'VORNAME', 'gliner', true), ('g5', false, NULL, NULL, 'gliner', true), ('g6', false, NULL, NULL, 'library', true)"


@query("""SELECT * FROM (VALUES ('g1', false, NULL, NULL, 'regex', true), ('g2', true, 'g3', 'VORNAME', 'gliner', true), ('g3', true, NULL, 'VOLLNAME', 'gliner', false), ('g4', true, NULL, NULL, 'gliner', true), ('g5', true, NULL, NULL, 'manual', false), ('g6', true, NULL, NULL, 'glossary', true)) AS t(group_id, enabled, parent_id, surface_tag, method, needs_review)""")
def group_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.apply_actions(inline(spark, "group_id, enabled, parent_id, surface_tag, method, needs_review", GROUPS), inline(spark, "group_id, action, payload", ACTIONS))


@query(f"""WITH s AS ({EVENT_SPANS}) SELECT method, count(*) AS n, CASE method WHEN 'glossary' THEN 'glossary_direct' WHEN 'regex' THEN 'regex' WHEN 'eupii' THEN 'eupii' ELSE 'gliner' END AS source FROM s GROUP BY method""")
def source_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_spans(spark, sf_dir).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("method", "n", review.source_class(F.col("method"), F.lit("direct")).alias("source"))


_ESCAPED = "replace(replace(replace(replace(replace(translate({c}, chr(13) || chr(10), '  '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"


@query(f"""WITH RECURSIVE {CHAIN}, p AS (SELECT n.doc_id, n."start" AS s, n."end" AS e, d.text, length(d.text) AS l FROM named n JOIN documents d USING (doc_id)),
    a1 AS (SELECT *, greatest(s - 150, 0) AS a0, least(e + 150, l) AS b0 FROM p),
    a2 AS (SELECT *, a0 - length(regexp_extract(substr(text, greatest(s - 250, 0) + 1, a0 - greatest(s - 250, 0)), '[^.!?\\n]*$')) AS a, b0 + length(regexp_extract(substr(text, b0 + 1, least(e + 250, l) - b0), '^[^.!?\\n]*')) AS b FROM a1),
    a3 AS (SELECT *, CASE WHEN a > 0 AND substr(text, a + 1, 1) IN (' ', chr(10)) THEN a + 1 ELSE a END AS x, CASE WHEN b < l AND substr(text, b + 1, 1) IN ('.', '!', '?') THEN b + 1 ELSE b END AS y FROM a2)
    SELECT doc_id, s AS "start", CASE WHEN x > 0 THEN '…' ELSE '' END || {_ESCAPED.format(c="substr(text, x + 1, s - x)")} || '<b>' || {_ESCAPED.format(c="substr(text, s + 1, e - s)")} || '</b>' || {_ESCAPED.format(c="substr(text, e + 1, y - e)")} || CASE WHEN y < l THEN '…' ELSE '' END AS snippet FROM a3""")
def context_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id").select("doc_id", "start", T.snippet(F.col("text"), F.col("start"), F.col("end")).alias("snippet"))


PEOPLE = "Anna Thin, Ernst Ber und Julia Onre: Annas Hund, Bers Haus, Julia's Ring; nicht Thinsel."


@query(f"""WITH d AS (SELECT doc_id, length(text) + 1 AS shift FROM documents)
    SELECT doc_id, (shift + k)::INT AS "start", value FROM d, (VALUES ({PEOPLE.index("Annas")}, 'Annas'), ({PEOPLE.index("Bers")}, 'Bers'), ({PEOPLE.index("Julia's")}, 'Julia''s')) AS t(k, value)""")
def genitive_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" "), F.lit(PEOPLE)).alias("text"))
    docs = docs.withColumn("spans", detect.term_spans("text", ["Anna Thin", "Ernst Ber", "Julia Onre"], "PERSON"))
    return resolve.genitives(docs).select("doc_id", "start", "value")


NAMED = "'Benjamin Kaegi Egzona Musliu, Christoph'"


@query("""SELECT * FROM (VALUES ('Benjamin Kaegi', 0, 14), ('Egzona Musliu', 15, 28), ('Christoph', 30, 39)) AS t(value, "start", "end")""")
def person_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit("PERSON").alias("entity_type"), F.lit(0.9).alias("score"), F.lit("gliner").alias("recognizer"), F.lit("gliner").alias("method"), F.lit(0).alias("seq"))
    rows = spark.sql(f"SELECT {NAMED} AS text").withColumn("spans", F.transform(detect.match_spans("text", "[A-Z][a-z]+"), one))
    return rows.select(F.explode(resolve.merged_persons(F.col("spans"), F.col("text"))).alias("s")).select("s.value", "s.start", "s.end")


@query(f"""WITH RECURSIVE {CHAIN}, t AS (SELECT d.doc_id, d.text, unnest(list_filter(range(1, length(d.text) - 2), lambda i: lower(substr(d.text, i, 4)) = 'from')) AS p FROM documents d WHERE contains(lower(d.text), 'from'))
    SELECT doc_id, (p - 1)::INT AS "start" FROM t WHERE NOT regexp_matches(substr(text, p - 1, CASE WHEN p > 1 THEN 1 ELSE 0 END), '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(substr(text, p + 4, 1), '[\\p{{L}}\\p{{N}}_]')
        AND NOT EXISTS (SELECT 1 FROM named n WHERE n.doc_id = t.doc_id AND n."start" < p + 3 AND n."end" > p - 1)""")
def manual_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = engine.Engine(spark, CONFIG).with_spans(documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select("doc_id", F.explode(detect.mark_term("from", "text", "spans", "ROLE")).alias("s")).select("doc_id", "s.start")
