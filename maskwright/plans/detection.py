"""Queries over detectors, checksums and interval resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..operators import detect, glossary, resolve
from .registry import ORACLES, QUERIES, documents, inline, inline_sql, query, table

#: detector -> the same pattern for the oracle's expression engine, and a predicate on a match
SCANNED = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "true"),
    "ip": (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "len(list_filter(string_split(value, '.'), lambda o: o::INT > 255)) = 0"),
    "card": (r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", "luhn(value) = 0"),
    "phone": (r"(?:\+\d{1,2}|\b0)[ ]?(?:\(\d{2,4}\)|\d{2,3})(?:[ -]\d{2,4}){2,4}\b", "true"),
}
LUHN = "(list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (substr(d, len(d) - i + 1, 1)::INT * 2) // 10 + (substr(d, len(d) - i + 1, 1)::INT * 2) % 10 ELSE substr(d, len(d) - i + 1, 1)::INT END)) % 10)"


def scan_sql(pattern: str, valid: str, name: str = "found") -> str:
    """Common table expressions that walk over a pattern's matches in order, each located after the end of the one before."""
    check = valid.replace("luhn(value) = 0", "(SELECT " + LUHN + " FROM (SELECT regexp_replace(value, '[^0-9]', '', 'g') AS d)) = 0")
    return f"""m_{name} AS (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS ms FROM documents WHERE regexp_matches(text, '{pattern}')),
        w_{name}(doc_id, text, ms, k, s, e) AS (
            SELECT doc_id, text, ms, 1, strpos(text, ms[1]) - 1, strpos(text, ms[1]) - 1 + length(ms[1]) FROM m_{name}
            UNION ALL SELECT doc_id, text, ms, k + 1, e + strpos(substr(text, e + 1), ms[k + 1]) - 1, e + strpos(substr(text, e + 1), ms[k + 1]) - 1 + length(ms[k + 1]) FROM w_{name} WHERE k < len(ms)),
        {name} AS (SELECT doc_id, s::INT AS "start", e::INT AS "end", ms[k] AS value FROM w_{name} WHERE (SELECT {check} FROM (SELECT ms[k] AS value)))"""


def _scan(kind: str) -> None:
    pattern, valid = SCANNED[kind]

    @query(f"WITH RECURSIVE {scan_sql(pattern, valid)} SELECT * FROM found", name=f"scan_{kind}_spans")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detect.detect(documents(spark, sf_dir), [kind]).select("doc_id", "start", "end", "value")


for _kind in SCANNED:
    _scan(_kind)


@query(
    f"""WITH c AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\b\\d{{16}}\\b')) AS value FROM documents)
        SELECT value, {LUHN.replace("len(d)", "16").replace("(d,", "(value,")} = 0 AS valid FROM c"""
)
def card_luhn_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"\b\d{16}\b"), F.lit(0))).alias("value")).distinct()
    return values.select("value", checks.luhn_valid(F.col("value")).alias("valid"))


def _digits_sql(column: str, weights: list[int]) -> str:
    return " + ".join(f"substr({column}, {k + 1}, 1)::INT * {w}" for k, w in enumerate(weights))


@query(f"""WITH c AS (SELECT c_custkey, printf('756%010d', (c_custkey * 7919 + 13) % 10000000000) AS d FROM customer)
    SELECT c_custkey, substr(d, 1, 3) || '.' || substr(d, 4, 4) || '.' || substr(d, 8, 4) || '.' || substr(d, 12, 2) AS ahv,
        (10 - ({_digits_sql("d", [1, 3] * 6)}) % 10) % 10 = substr(d, 13, 1)::INT AS valid FROM c""")
def ahv_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.concat(F.lit("756"), F.lpad(((F.col("c_custkey") * 7919 + 13) % F.lit(10_000_000_000)).cast("string"), 10, "0"))
    ahv = F.regexp_replace(d, r"^(\d{3})(\d{4})(\d{4})(\d{2})$", "$1.$2.$3.$4")
    return table(spark, sf_dir, "customer").select("c_custkey", ahv.alias("ahv")).select("c_custkey", "ahv", checks.ahv_valid(F.col("ahv")).alias("valid"))


@query(f"""WITH c AS (SELECT s_suppkey, printf('%09d', (s_suppkey * 104729 + 7) % 1000000000) AS d FROM supplier),
    k AS (SELECT *, 11 - ({_digits_sql("d", [5, 4, 3, 2, 7, 6, 5, 4])}) % 11 AS x FROM c)
    SELECT s_suppkey, 'CHE-' || substr(d, 1, 3) || '.' || substr(d, 4, 3) || '.' || substr(d, 7, 3) AS uid,
        CASE WHEN x = 10 THEN false ELSE (CASE WHEN x = 11 THEN 0 ELSE x END) = substr(d, 9, 1)::INT END AS valid FROM k""")
def uid_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.lpad(((F.col("s_suppkey") * 104729 + 7) % 1_000_000_000).cast("string"), 9, "0")
    uid = F.regexp_replace(d, r"^(\d{3})(\d{3})(\d{3})$", "CHE-$1.$2.$3")
    return table(spark, sf_dir, "supplier").select("s_suppkey", uid.alias("uid")).select("s_suppkey", "uid", checks.uid_valid(F.col("uid")).alias("valid"))


@query("""WITH c AS (SELECT o_orderkey, 'CH' || printf('%02d', o_orderkey % 97 + 2) || printf('%017d', o_orderkey) AS iban FROM orders)
    SELECT o_orderkey, iban, (substr(iban, 5) || '1217' || substr(iban, 3, 2))::HUGEINT % 97 = 1 AS valid FROM c""")
def iban_mod97(spark: SparkSession, sf_dir: str) -> DataFrame:
    iban = F.concat(F.lit("CH"), F.lpad((F.col("o_orderkey") % 97 + 2).cast("string"), 2, "0"), F.lpad(F.col("o_orderkey").cast("string"), 17, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", iban.alias("iban")).select("o_orderkey", "iban", checks.iban_valid(F.col("iban")).alias("valid"))


ADDRESSES = """(1, 'Stand: 2026 Zuerich'), (2, '8001 Zuerich'), (3, 'Bahnhofstrasse 12a, 8001 Zuerich'), (4, 'Bahnhofstrasse 12, 1999 Genf'), (5, '10115 Berlin'), (6, 'Im Jahr 1950 Bern')"""


@query(f"""WITH {inline_sql("t", "id, text", ADDRESSES)},
    g AS (SELECT id, text, regexp_extract(text, '(\\d{{4,5}}) [A-Z][a-z]+', 1) AS code, regexp_matches(text, '[a-z]strasse \\d+[a-z]?, \\d{{4}} ') AS street FROM t
          UNION ALL SELECT n_nationkey + 100, (1850 + n_nationkey * 10)::VARCHAR || ' ' || upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)), (1850 + n_nationkey * 10)::VARCHAR, false FROM nation)
    SELECT id, (street OR length(code) = 5 OR code::INT < 1900 OR code::INT > 2099) AS found FROM g""")
def address_year_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("id"), F.concat((F.col("n_nationkey") * 10 + 1850).cast("string"), F.lit(" "), F.upper(F.substring("n_name", 1, 1)), F.lower(F.substring("n_name", 2, 50))).alias("text"))
    rows = inline(spark, "id, text", ADDRESSES).unionByName(nations)
    names = ["address_full", "address_street", "address_town"]
    return rows.select("id", (F.size(detect.spans_array("text", names)) > 0).alias("found"))


TERMS = ("the", "ertion", "en", "E-Mail")
_TERM_VALUES = ", ".join(f"('{t}')" for t in TERMS)
_WORD = r"[\p{L}\p{N}_\p{M}]"
EXACT_SQL = f"""WITH {inline_sql("terms", "term", _TERM_VALUES)},
    hits AS (SELECT doc_id, term, text, unnest(list_filter(range(1, length(text) - length(term) + 2), lambda i: lower(substr(text, i, length(term))) = lower(term))) AS p
             FROM documents, terms WHERE contains(lower(text), lower(term)) AND doc_id < 1000000000)
    SELECT doc_id, term, (p - 1)::INT AS "start", (p - 1 + length(term))::INT AS "end" FROM hits
    WHERE NOT regexp_matches(substr(text, p - 1, CASE WHEN p > 1 THEN 1 ELSE 0 END), '{_WORD}') AND NOT regexp_matches(substr(text, p + length(term), 1), '{_WORD}')"""


@query(EXACT_SQL.replace(" AND doc_id < 1000000000", ""))
def glossary_exact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.term_spans("text", TERMS)
    rows = documents(spark, sf_dir).select("doc_id", F.explode(found).alias("s"))
    return rows.select("doc_id", F.element_at(F.array(*map(F.lit, TERMS)), F.col("s.seq") + 1).alias("term"), "s.start", "s.end")


IGNORED = ("that", "with", "les")


@query(EXACT_SQL.replace(_TERM_VALUES, ", ".join(f"('{t}')" for t in IGNORED)).replace(" AND doc_id < 1000000000", "").replace("SELECT doc_id, term, (p", "SELECT doc_id, (p"))
def ignore_term_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(detect.term_spans("text", IGNORED)).alias("s")).select("doc_id", "s.start", "s.end")


FUZZY = "('Zentralbank', 'ORGANIZATION'), ('eClaims', 'IT_SYSTEM'), ('ZHAW', 'ORGANIZATION'), ('thereon', 'ROLE')"


@query()
def glossary_fuzzy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested in tests/ against a dynamic-programming similarity; the longest common subsequence isn't expressible in plain SQL."""
    words = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"(?U)\b[\w.-]+\b"), F.lit(0))).alias("token")).distinct()
    return glossary.fuzzy_matches(words, inline(spark, "term, entity_type", FUZZY))


#: spans made from the table events: documents are users, starts follow the event id, lengths and scores its value
EVENT_SPANS = """SELECT user_id AS doc_id, event_id, ((event_id * 37) % 400)::INT AS "start", ((event_id * 37) % 400 + 3 + (event_id * 11) % 23)::INT AS "end",
    CASE event_id % 4 WHEN 0 THEN 'glossary' WHEN 1 THEN 'regex' WHEN 2 THEN 'eupii' ELSE 'gliner' END AS method, ((event_id * 7) % 50 + 50) / 100.0::DOUBLE AS score,
    CASE event_id % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOCATION' ELSE 'ORGANIZATION' END AS entity_type FROM events"""


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, at = F.col("event_id"), (F.col("event_id") * 37 % 400).cast("int")
    pick = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (e % k + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), "event_id", at.alias("start"), (at + 3 + e * 11 % 23).cast("int").alias("end"), pick(4, "glossary", "regex", "eupii", "gliner").alias("method"), ((e * 7 % 50 + 50) / 100.0).cast("double").alias("score"), pick(3, "PERSON", "LOCATION", "ORGANIZATION").alias("entity_type")
    )


def span_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, spans) of event_spans as arrays of candidates in order of the event id; values hold the id."""
    one = F.struct("event_id", F.struct("start", "end", F.col("event_id").cast("string").alias("value"), "entity_type", "score", F.col("method").alias("recognizer"), "method", F.lit(0).alias("seq")).alias("s"))
    return event_spans(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("x")).select("doc_id", resolve.numbered(F.transform("x", lambda x: x["s"])).alias("spans"))


def _out(rows: DataFrame, spans: object) -> DataFrame:
    return rows.select("doc_id", F.explode(spans).alias("s")).select("doc_id", F.col("s.value").cast("long").alias("event_id"), "s.start", "s.end", "s.entity_type")


@query(f"""WITH s AS ({EVENT_SPANS}) SELECT doc_id, event_id, "start", "end" FROM s WHERE event_id % 5 <> 0 AND NOT EXISTS
    (SELECT 1 FROM s b WHERE b.event_id % 5 = 0 AND b.doc_id = s.doc_id AND b."start" < s."end" AND b."end" > s."start")""")
def interval_anti_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = event_spans(spark, sf_dir)
    return resolve.interval_anti_join(spans.where("event_id % 5 <> 0"), spans.where("event_id % 5 = 0")).select("doc_id", "event_id", "start", "end")


@query(f"""WITH s AS ({EVENT_SPANS}), g AS (SELECT * FROM s WHERE method = 'glossary'), o AS (SELECT * FROM s WHERE method <> 'glossary'),
    c AS (SELECT g.doc_id, g.event_id, g.entity_type, o.event_id AS oid, o."start", o."end", row_number() OVER (PARTITION BY g.doc_id, g.event_id ORDER BY o."end" - o."start", o.event_id) AS r
          FROM g JOIN o ON g.doc_id = o.doc_id AND o."start" <= g."start" AND g."end" <= o."end" AND o."end" - o."start" > g."end" - g."start"),
    best AS (SELECT * FROM c WHERE r = 1)
    SELECT g.doc_id, g.event_id, coalesce(b."start", g."start") AS "start", coalesce(b."end", g."end") AS "end", g.entity_type FROM g LEFT JOIN best b ON g.doc_id = b.doc_id AND g.event_id = b.event_id
    UNION ALL SELECT doc_id, event_id, "start", "end", entity_type FROM o WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.doc_id = o.doc_id AND b.oid = o.event_id)""")
def containment_absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = span_arrays(spark, sf_dir)
    # values of glossary hits must stay theirs: the container's value is taken over with its bounds, so ids travel in the recognizer
    marked = F.transform("spans", lambda s: s.withField("recognizer", s["value"]))
    found = rows.select("doc_id", F.explode(resolve.absorbed(marked)).alias("s"))
    return found.select("doc_id", F.col("s.recognizer").cast("long").alias("event_id"), "s.start", "s.end", "s.entity_type")


PACK_SQL = """WITH RECURSIVE s AS ({spans}),
    q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS r FROM s),
    walk(doc_id, r, taken) AS (SELECT DISTINCT doc_id, 0::BIGINT, []::STRUCT(s INT, e INT, i BIGINT)[] FROM q
        UNION ALL SELECT w.doc_id, q.r, CASE WHEN len(list_filter(w.taken, lambda t: t.e > q."start" AND t.s < q."end")) > 0 THEN w.taken ELSE list_append(w.taken, {{'s': q."start", 'e': q."end", 'i': q.event_id}}) END
        FROM walk w JOIN q ON q.doc_id = w.doc_id AND q.r = w.r + 1),
    final AS (SELECT doc_id, arg_max(taken, r) AS taken FROM walk GROUP BY doc_id),
    ids AS (SELECT doc_id, unnest(taken).i AS event_id FROM final)
    SELECT q.doc_id, q.event_id, q."start", q."end", q.entity_type FROM q JOIN ids USING (doc_id, event_id)"""
_RANK = "CASE method WHEN 'glossary' THEN 4 WHEN 'regex' THEN 3 WHEN 'eupii' THEN 2 ELSE 1 END DESC"


@query(PACK_SQL.format(spans=EVENT_SPANS, order=f'{_RANK}, "end" - "start" DESC, score DESC, event_id'))
def greedy_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(span_arrays(spark, sf_dir), resolve.packed(F.col("spans"), "priority", "length", "score"))


@query(PACK_SQL.format(spans=EVENT_SPANS, order='score DESC, "end" - "start" DESC, event_id'))
def greedy_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(span_arrays(spark, sf_dir), resolve.packed(F.col("spans"), "score", "length"))


@query(f"""WITH s AS ({EVENT_SPANS}) SELECT doc_id, event_id, "start", "end", entity_type FROM s WHERE method = 'eupii' AND NOT EXISTS
    (SELECT 1 FROM s b WHERE b.method = 'regex' AND b.doc_id = s.doc_id AND b."start" < s."end" AND b."end" > s."start")""")
def protected_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda m: F.filter("spans", lambda s: s["method"] == m)
    return _out(span_arrays(spark, sf_dir), resolve.without(of("eupii"), of("regex")))


@query(f"""WITH s AS ({EVENT_SPANS}) SELECT doc_id, event_id, "start", "end", entity_type FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.entity_type = s.entity_type AND o."start" <= s."start" AND o."end" >= s."end"
    AND (o.score > s.score OR (o.score = s.score AND (o."end" - o."start" > s."end" - s."start" OR (o."start" = s."start" AND o."end" = s."end" AND o.event_id < s.event_id)))))""")
def contained_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(span_arrays(spark, sf_dir), resolve.without_contained(F.col("spans")))


@query(f"""WITH s AS ({EVENT_SPANS}) SELECT doc_id, event_id, "start", "end", entity_type FROM s
    WHERE method <> 'gliner' AND (CASE WHEN method = 'glossary' THEN entity_type = 'PERSON' ELSE entity_type IN ('PERSON', 'LOCATION') END) AND score >= 0.55""")
def type_and_score_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = resolve.enabled(F.col("spans"), ["PERSON", "LOCATION"], ["PERSON"])
    return _out(span_arrays(spark, sf_dir), F.filter(gated, lambda s: (s["score"] >= 0.55) & (s["method"] != "gliner")))


@query(f"""WITH s AS ({EVENT_SPANS}) SELECT doc_id, event_id, "start", "end", entity_type FROM s
    WHERE (entity_type = 'PERSON' AND method IN ('glossary', 'eupii')) OR (entity_type = 'LOCATION' AND method = 'glossary') OR entity_type NOT IN ('PERSON', 'LOCATION', 'ORGANIZATION')""")
def mode_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(span_arrays(spark, sf_dir), resolve.allowed_by_mode(F.col("spans"), {"PERSON": "explicit_eupii", "LOCATION": "explicit_only", "ORGANIZATION": "off"}))


@query(f"""WITH RECURSIVE {", ".join(scan_sql(*SCANNED[k], name=k) for k in ("email", "ip", "card", "phone"))}
    SELECT entity_type, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM (SELECT 'EMAIL_ADDRESS' AS entity_type, doc_id FROM email UNION ALL SELECT 'IP_ADDRESS', doc_id FROM ip
        UNION ALL SELECT 'CREDIT_CARD', doc_id FROM card UNION ALL SELECT 'PHONE_NUMBER', doc_id FROM phone) GROUP BY entity_type""")
def detector_union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect(documents(spark, sf_dir), list(SCANNED))
    return found.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"""WITH s AS ({EVENT_SPANS}) SELECT entity_type, count(*) AS entity_count, count(*) FILTER (score < 0.85) AS review_count, count(DISTINCT doc_id) AS n_docs FROM s GROUP BY entity_type""")
def review_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_spans(spark, sf_dir)
    return s.groupBy("entity_type").agg(F.count(F.lit(1)).alias("entity_count"), F.count_if(F.col("score") < resolve.REVIEW_BELOW).alias("review_count"), F.countDistinct("doc_id").alias("n_docs"))


__all__ = ["ORACLES", "QUERIES"]
