"""Golden cases of detection, resolution, labelling, restoring, links, configuration, files, streams."""

import html
import io
import random
import re
import threading
import warnings
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright import cli
from maskwright.engine import Config, Engine, report
from maskwright.functions import checks, sentences
from maskwright.functions import text as T
from maskwright.functions.spans import match_spans
from maskwright.operators import assist, config, detect, glossary, label, provider, resolve, review, tokens
from maskwright.sources import files
from maskwright.streaming import anonymize_stream, drop_stale, write_stream


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(spark, text, **config_):
    return [(s.value, s.entity_type) for s in Engine(spark, Config(**config_)).detect(rows(spark, [text])).orderBy("start").collect()]


def spans(spark, text, items):
    """A row of text with spans given as (start, end, type, score, method)."""
    values = [(a, b, text[a:b], t, float(s), m, m, k) for k, (a, b, t, s, m) in enumerate(items)]
    return spark.createDataFrame([(0, text, values)], f"doc_id long, text string, spans array<{detect.CANDIDATE}>")


def resolved(spark, text, items, **more):
    df = spans(spark, text, items).select(F.explode(resolve.resolve(F.col("spans"), F.col("text"), **more)).alias("s"))
    return [(r.s.value, r.s.entity_type) for r in df.collect()]


# detectors


def test_offsets_follow_code_points(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for pattern in (r"[A-Za-z]+ing\b", r"\d{3,}", r"é[a-zé]*"):
        got = {(r.doc_id, r.s.start, r.s.end, r.s.value) for r in docs.select("doc_id", F.explode(match_spans("text", pattern)).alias("s")).collect()}
        want = {(r.doc_id, *m.span(), m.group()) for r in docs.collect() for m in re.finditer(pattern, r.text, re.ASCII)}
        assert got == want


def test_address_cases(spark):
    names = ("address_full", "address_street", "address_town")
    assert found(spark, "Besuch: Bahnhofstrasse 12a, 8001 Zürich", detectors=names) == [("Bahnhofstrasse 12a, 8001 Zürich", "ADDRESS")]
    assert found(spark, "Büro: Hauptstraße 7, 10115 Berlin", detectors=names) == [("Hauptstraße 7, 10115 Berlin", "ADDRESS")]
    assert found(spark, "Stand: 2026 Zürich", detectors=names) == []


@pytest.mark.parametrize("value,ok", [("756.3047.5009.62", True), ("756.3047.5009.63", False), ("755.3047.5009.62", False), ("756", False), (None, False)])
def test_ahv(spark, value, ok):
    assert spark.createDataFrame([(value,)], "v string").select(checks.ahv_valid(F.col("v"))).first()[0] is ok


@pytest.mark.parametrize("value,ok", [("CHE-105.816.788", True), ("CHE-105.816.789", False), ("CHE-1", False)])
def test_uid(spark, value, ok):
    assert spark.createDataFrame([(value,)], "v string").select(checks.uid_valid(F.col("v"))).first()[0] is ok


@pytest.mark.parametrize("value,ok", [("CH9300762011623852957", True), ("CH9300762011623852958", False), ("DE89370400440532013000", True), ("X", False)])
def test_iban(spark, value, ok):
    assert spark.createDataFrame([(value,)], "v string").select(checks.iban_valid(F.col("v"))).first()[0] is ok


def test_phones_score_by_plan(spark):
    got = {r.value: r.score for r in detect.detect(rows(spark, ["+41 44 123 45 67 und 044 123 45 67"]), ["phone"]).collect()}
    assert got == {"+41 44 123 45 67": 1.0, "044 123 45 67": 1.0}


def test_mixed_text(spark):
    text = "AHV 756.3047.5009.62, UID CHE-105.816.788, a.b@c.ch, https://x.ch/y, 10.0.0.1, 300.1.1.1, 4111111111111111, 4111111111111112"
    assert found(spark, text, detectors=("ahv", "uid", "email", "url", "ip", "card")) == [("756.3047.5009.62", "AHV_NUMBER"), ("CHE-105.816.788", "UID_NUMBER"), ("a.b@c.ch", "EMAIL_ADDRESS"), ("https://x.ch/y", "URL"), ("10.0.0.1", "IP_ADDRESS"), ("4111111111111111", "CREDIT_CARD")]


def test_terms_with_punctuation(spark):
    assert found(spark, "Das System eClaims+ wurde ECLAIMS+x.", detectors=(), glossary=(("eClaims+", "IT_SYSTEM"),)) == [("eClaims+", "IT_SYSTEM")]
    assert found(spark, "Die ZHAW und die ZHW", detectors=(), glossary=(("zhaw", "ORGANIZATION"),)) == [("ZHAW", "ORGANIZATION")]


def test_type_lists_none_and_empty(spark):
    assert found(spark, "SAP a@b.ch", entity_types=()) == []
    assert found(spark, "SAP a@b.ch", entity_types=(), glossary=(("SAP", "IT_SYSTEM"),)) == [("SAP", "IT_SYSTEM")]
    assert found(spark, "SAP a@b.ch", entity_types=(), glossary=(("SAP", "IT_SYSTEM"),), glossary_types=()) == []
    with pytest.warns(UserWarning):
        Config(entity_types=("NONSENSE",))


def test_ignore_precedence(spark):
    g = (("App", "IT_SYSTEM"), ("Claims", "IT_SYSTEM"))
    assert found(spark, "App und Claims", detectors=(), glossary=g, default_ignore=("App",), user_ignore=("Claims",)) == [("App", "IT_SYSTEM")]
    assert found(spark, "x a@b.ch", detectors=("email",), default_ignore=("b.ch",)) == []


def test_fuzzy_ratio(spark):
    assert glossary.similarity("zhaw", "zhw") == pytest.approx(200 * 3 / 7) and glossary.similarity("", "") == 100 and glossary.similarity("abc", "xyz") == 0

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for a, b in (("kitten", "sitting"), ("abcabba", "cbabac"), ("straße", "strasse"), ("a", "")):
        assert glossary.similarity(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))
    t = spark.createDataFrame([("ZHW",), ("zhaw",), ("Zentralbnk",), ("xx",), (None,)], "token string")
    g = spark.createDataFrame([("ZHAW", "ORGANIZATION"), ("Zentralbank", "ORGANIZATION")], "term string, entity_type string")
    got = {(r.token, r.term): (r.score, r.kind) for r in glossary.fuzzy_matches(t, g).collect()}
    assert got == {("ZHW", "ZHAW"): (0.8, "fuzzy"), ("zhaw", "ZHAW"): (1.0, "direct"), ("Zentralbnk", "Zentralbank"): (0.95, "fuzzy")}


def test_token_ngrams(spark):
    got = rows(spark, ["Die ZHAW-x lebt."]).select(F.explode(glossary.token_ngrams("text", 2)).alias("s")).collect()
    assert [r.s.value for r in got] == ["Die", "ZHAW-x", "lebt", "Die ZHAW-x", "ZHAW-x lebt"]


# resolution


def test_source_priority(spark):
    assert resolved(spark, "756.3047.5009.62", [(0, 16, "AHV_NUMBER", 0.8, "regex"), (0, 16, "ID_NUMBER", 0.99, "eupii")]) == [("756.3047.5009.62", "AHV_NUMBER")]
    assert resolved(spark, "CHE-105.816.788", [(0, 15, "UID_NUMBER", 1, "regex"), (0, 15, "ROLE", 1, "glossary")]) == [("CHE-105.816.788", "ROLE")]


def test_absorption(spark):
    text = "Remo Weiersmueller und Remo"
    assert resolved(spark, text, [(0, 18, "ORGANIZATION", 0.6, "gliner"), (0, 4, "PERSON", 1, "glossary"), (23, 27, "PERSON", 1, "glossary")]) == [("Remo Weiersmueller", "PERSON"), ("Remo", "PERSON")]


def test_trimming_and_gender_suffixes(spark):
    text = "<br>Dr. Andreas Schönenberger<br> **Julia Meier** Sachbearbeiter:innen Kund*innen in"
    at = lambda s: (text.index(s), text.index(s) + len(s))
    items = [(*at("<br>Dr. Andreas Schönenberger<br>"), "PERSON", 0.9, "gliner"), (*at("**Julia Meier**"), "PERSON", 0.9, "gliner"), (*at("Sachbearbeiter"), "ROLE", 0.9, "gliner"), (*at("Kund"), "ROLE", 0.9, "gliner"), (len(text) - 2, len(text), "PERSON", 0.9, "gliner"), (0, 4, "PERSON", 0.9, "gliner")]
    assert resolved(spark, text, items) == [("Dr. Andreas Schönenberger", "PERSON"), ("Julia Meier", "PERSON"), ("Sachbearbeiter:innen", "ROLE"), ("Kund*innen", "ROLE")]


def test_modes_gate_sources(spark):
    items = [(0, 1, "PERSON", 1, "glossary"), (2, 3, "PERSON", 1, "eupii"), (4, 5, "PERSON", 1, "gliner")]
    for mode, want in (("off", ""), ("explicit_only", "a"), ("explicit_eupii", "ab"), ("all", "abc")):
        assert "".join(v for v, _ in resolved(spark, "a b c", items, modes={"PERSON": mode})) == want


def test_genitives(spark):
    text = "Julia Meier sah Julias Hund, Meiers Auto und Julia's Markt, Studiums Julias"
    df = spans(spark, text, [(0, 11, "PERSON", 0.95, "gliner")])
    got = {(r.value, r.start, r.score) for r in resolve.genitives(df).collect()}
    assert got == {("Julias", 16, 0.85), ("Meiers", 29, 0.85), ("Julia's", 45, 0.85), ("Julias", 69, 0.85)}
    ignored = spark.createDataFrame([(0, 29, 35)], "doc_id long, start int, end int")
    assert {r.value for r in resolve.genitives(df, ignored, ["Julia"]).collect()} == set()


def test_persons_merge_in_pairs(spark):
    text = "Benjamin Kägi Egzona Musliu Christoph Jampen"
    items = [(m.start(), m.end(), "PERSON", 0.9 - k / 100, "gliner") for k, m in enumerate(re.finditer(r"\S+", text))]
    got = spans(spark, text, items).select(F.explode(resolve.merged_persons(F.col("spans"), F.col("text"))).alias("s")).collect()
    assert [(r.s.value, round(r.s.score, 2)) for r in got] == [("Benjamin Kägi", 0.89), ("Egzona Musliu", 0.87), ("Christoph Jampen", 0.85)]


def test_fragments_of_words(spark):
    got = spans(spark, "abc12 def", [(0, 3, "X", 1, "eupii"), (0, 5, "X", 1, "eupii"), (6, 9, "X", 1, "eupii"), (7, 9, "X", 1, "eupii")]).select(F.explode(resolve.whole_words(F.col("spans"), F.col("text"))).alias("s")).collect()
    assert [r.s.value for r in got] == ["abc12", "def"]


# labelling


def labelled(spark, items, **more):
    df = spark.createDataFrame([(0, a, a + len(v), v, t, 0.9) for a, v, t in items], "doc_id long, start int, end int, value string, entity_type string, score double")
    return {r.start: r.placeholder for r in label.label(df, **more).collect()}


def test_three_modes_and_collisions(spark):
    roles = spark.createDataFrame([(0, "anna", "Student"), (0, "bob", "Student"), (0, "eth", "Hochschule")], "doc_id long, norm_term string, role string")
    one = [(0, "Anna", "PERSON"), (10, "ETH", "ORGANIZATION")]
    assert labelled(spark, one, mode="numbered", roles=roles) == {0: "[PERSON_1]", 10: "[ORGANIZATION_1]"}
    assert labelled(spark, one, mode="numbered_role", roles=roles) == {0: "[PERSON_1_STUDENT]", 10: "[ORGANIZATION_1_HOCHSCHULE]"}
    assert labelled(spark, one, mode="role_only", roles=roles) == {0: "[PERSON_STUDENT]", 10: "[ORGANIZATION_HOCHSCHULE]"}
    two = [*one, (20, "Bob", "PERSON"), (30, "ANNA", "PERSON")]
    assert labelled(spark, two, mode="role_only", roles=roles) == {0: "[PERSON_1_STUDENT]", 10: "[ORGANIZATION_HOCHSCHULE]", 20: "[PERSON_2_STUDENT]", 30: "[PERSON_1_STUDENT]"}
    with pytest.raises(ValueError):
        labelled(spark, one, mode="other")


def test_links_share_numbers(spark):
    links = spark.createDataFrame([(0, "julia", "julia meier", "VORNAME"), (0, "meier", "julia meier", ""), (0, "max", "nobody", "X")], "doc_id long, child_term string, parent_term string, surface_tag string")
    items = [(0, "Julia", "PERSON"), (10, "Julia Meier", "PERSON"), (30, "Meier", "PERSON"), (40, "Max", "PERSON"), (50, "Eva", "PERSON")]
    assert labelled(spark, items, links=links) == {0: "[PERSON_1_VORNAME]", 10: "[PERSON_1]", 30: "[PERSON_1_VARIANT]", 40: "[PERSON_3_X]", 50: "[PERSON_2]"}


def test_round_trip_and_cascades(spark):
    e = Engine(spark, Config(detectors=("email", "ip")))
    docs = rows(spark, ["a@b.ch x 10.0.0.1 y a@b.ch é A@B.ch", "", None, "nothing"])
    out = {r.doc_id: r for r in e.restore(e.anonymize(docs)).collect()}
    assert out[0].anonymized_text == "[EMAIL_ADDRESS_1] x [IP_ADDRESS_1] y [EMAIL_ADDRESS_1] é [EMAIL_ADDRESS_1]"
    assert [out[k].restored_text for k in range(1, 4)] == ["", None, "nothing"] and out[0].restored_text.lower() == out[0].text.lower()
    df = spark.createDataFrame([(1, "x [PERSON_1] [PERSON_2] [Z]", {"[PERSON_1]": "Anna [PERSON_2]", "[PERSON_2]": "Bob"})], "doc_id long, anonymized_text string, mapping map<string,string>")
    assert e.restore(df).first().restored_text == "x Anna [PERSON_2] Bob [Z]"
    assert next(files.restored(iter([df.toPandas()]))).restored_text[0] == "x Anna [PERSON_2] Bob [Z]"


def test_relational_and_row_forms_agree(spark, sf_dir):
    e = Engine(spark, Config(detectors=("email", "ip", "card", "phone")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    named = e.entities(docs)
    a = {r.doc_id: r.anonymized_text for r in label.anonymize(docs, named).collect()}
    assert a == {r.doc_id: r.anonymized_text for r in e.anonymize(docs).collect()}
    back = label.restore(label.anonymize(docs, named).select("doc_id", label.KEY, "anonymized_text"), label.mapping(named))
    assert {r.doc_id: r.restored_text for r in back.collect()} == {r.doc_id: r.text for r in docs.collect()}
    assert {r.original for r in report(named, False).collect()} <= {"[REDACTED]"}


def test_scan_stays_narrow(spark, sf_dir):
    plan = Engine(spark, Config(detectors=("email",))).anonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_segments(spark):
    docs = rows(spark, ["Hallo Anna und Bob!"])
    named = spark.createDataFrame([(0, 6, 10, "[PERSON_1]"), (0, 15, 18, "[PERSON_2]")], "doc_id long, start int, end int, placeholder string")
    assert [tuple(r)[1:] for r in label.segments(named, docs).orderBy("raw_start").collect()] == [(0, 6, 0, 6), (10, 15, 16, 21), (18, 19, 31, 32)]


def test_segments_of_documents_dealt_by_id(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = rows(spark, [f"x a@b{k}.ch y {k}" for k in range(200)]).repartition(n, "doc_id")
    got = label.segments(Engine(spark, Config(detectors=("email",))).entities(docs), docs).groupBy("doc_id").agg(F.sum(F.col("raw_end") - F.col("raw_start")).alias("kept"), F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == 200 and all(r.n == 2 and r.kept == len(f"x  y {r.doc_id}") for r in got)


def test_snippets_reach_sentence_ends(spark):
    text = "x" * 90 + ". " + "y" * 200 + "\n<&'\">Anna " + "z" * 160 + "! Rest"
    a = text.index("Anna")
    s = rows(spark, [text]).select(T.snippet(F.col("text"), F.lit(a), F.lit(a + 4))).first()[0]
    assert s == "…" + html.escape(("y" * 200 + " <&'\">")) + "<b>Anna</b> " + "z" * 160 + "!…"


# review and configuration


def test_occurrences_move(spark):
    o = spark.createDataFrame([("a", "g", "b"), ("c", "g", "b")], "occ_id string, group_id string, base string")
    m = spark.createDataFrame([("a", "new"), ("c", None)], "occ_id string, target string")
    assert {r.occ_id: r.group_id for r in review.split_occurrence(o, m).collect()} == {"a": "new", "c": "b"}


def _proposals_brute(people):
    """Of (id, name): the candidates of each id with their first rule, over all pairs."""
    found = {}
    for i, name in people:
        for j, other in people:
            if None in (i, j, name, other) or i == j:
                continue
            name, other = name.strip(" "), other.strip(" ")
            low, ws, known = name.lower(), re.split(r"[ \t]+", name.lower()), re.split(r"[ \t]+", other.lower())
            first, last = known[0].rstrip("."), known[-1]
            stem = re.sub("(?i)(s|'s|’s)$", "", name).strip(" ").lower()
            full, family = len(known) > 1, len(known) > 1 and first not in review.HONORIFICS
            titled = len(ws) > 1 and ws[0].rstrip(".") in review.HONORIFICS
            single = len(ws) == 1
            rules = (single and stem not in ("", low) and stem in known, single and full and low == first, single and family and low == last, titled and family and ws[-1] == last)
            if low != other.lower() and any(rules):
                at = found.setdefault(i, {})
                at[j] = min(rules.index(True), at.get(j, 9))
    tag = lambda c: review.RULES[min(c.values())] if len(c) == 1 else None
    return {(i, len(c), min(c) if len(c) == 1 else None, tag(c), tuple(sorted(c)) if len(c) > 1 else None) for i, c in found.items()}


def test_link_proposals_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["Julia", "julias", "Hans", "Han", "hans's", "Meier", "MEIER", "Meier’s", "Dr.", "Frau", "prof.", "Mr.", "S", "'s", "...", "", "Bern"]
    name = lambda: rng.choice(["", " "]) + rng.choice([" ", "  ", "\t"]).join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3])))
    for ids in (200, 70):  # an id each, and ids that stand for several names
        people = [(f"i{k % ids}", name()) for k in range(120)] + [(None, "Hans Meier"), ("none", None)]
        df = spark.createDataFrame([(i, n, "PERSON", rng.choice([None, ""])) for i, n in people] + [("o", "Hans Meier", "ORG", ""), ("p", "Hans Meier", "PERSON", "x")], "id string, name string, entity_type string, parent_id string")
        got = review.link_proposals(df).collect()
        want = _proposals_brute(people)
        assert len(got) == len(want) > 20 and {(r.id, r.n_candidates, r.proposed_parent, r.proposed_tag, r.candidates and tuple(r.candidates)) for r in got} == want
    scoped = spark.createDataFrame([("a", "Hans Meier", s) for s in ("x", None)] + [("b", "Hans", s) for s in ("x", "y", None)], "id string, name string, s string").selectExpr("*", "'PERSON' AS entity_type", "'' AS parent_id")
    assert {(r.s, r.id, r.proposed_parent) for r in review.link_proposals(scoped, ["s"]).collect()} == {("x", "b", "a"), (None, "b", "a")}


def test_link_proposals_make_no_pairs(spark):
    n = 60_000  # of whom half ask for the other half: 900 million pairs
    people = spark.range(n).selectExpr("id", "if(id % 2 = 0, 'Herr Meier', concat('Vor', id, ' Meier')) AS name", "'PERSON' AS entity_type", "'' AS parent_id")
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = review.link_proposals(people).groupBy("n_candidates").count().collect()
    finally:
        stop.cancel()
    assert [tuple(r) for r in got] == [(n // 2, n // 2)]


def test_project_store(tmp_path):
    store = config.ProjectStore(tmp_path)
    first = store.save(config.Project("default"))
    other = store.save(config.Project("Ärzte", modes={"PERSON": "off"}, ignore=("x",)))
    assert [p.name for p in store.list()] == ["default", "Ärzte"] and store.load(other.project_id) == other and other.revision == 1
    with pytest.raises(config.RevisionConflict):
        store.save(config.Project("Ärzte", other.project_id, 0))
    with pytest.raises(ValueError):
        store.save(config.Project("äRZTE "))
    with pytest.raises(ValueError):
        store.delete(first.project_id)
    modes = store.apply_template(other, "builtin-ch-standard").modes
    assert modes["HEALTH_DATA"] == "explicit_eupii" and modes["IT_SYSTEM"] == "off" and len(modes) == 23
    assert "IT_SYSTEM" not in config.engine_arguments(modes)["glossary_types"] and "ROLE" not in config.engine_arguments(modes)["entity_types"]
    assert config.application_settings({"model": "x:Cloud", "modes": {"URL": "off", "Z": "off", "ROLE": "no"}}, "d") == {"model": "d", "modes": {"URL": "off"}}
    (tmp_path / f"{other.project_id}.json").write_text('{"name": "x", "extra": 1}')
    with pytest.raises(ValueError):
        store.load(other.project_id)
    for bad in ({"name": ""}, {"name": "x", "revision": True}, {"name": "x", "modes": {"A": "b"}}):
        with pytest.raises(ValueError):
            config.Project(**bad)
    assert config.snapshot_hash({"b": 1, "a": "é"}) == config.snapshot_hash({"a": "é", "b": 1}) and config.term_key(" Straße ") == "strasse"


def test_batches_hold_all_in_order(spark):
    c = spark.createDataFrame([(k % 2, f"o{k}", k, "c" * 500, None, "t") for k in range(50)], "doc_id long, occ_id string, position int, context string, role string, text string")
    got = assist.triage_batches(c, most_tokens=400, most_items=10).orderBy("doc_id", "position").collect()
    assert len(got) == 50 and [r.batch for r in got] == sorted(r.batch for r in got if r.doc_id == 0) + sorted(r.batch for r in got if r.doc_id == 1) and got[0].batch == 1
    with pytest.raises(ValueError):
        assist.triage_batches(c, most_tokens=100)


def test_commands_are_all_or_nothing(spark):
    o = spark.createDataFrame([("a",), ("b",)], "occ_id string")
    c = lambda *ids: spark.createDataFrame([(i,) for i in ids], "occ_id string")
    assert assist.valid_commands(o, c("a"), "h", "h") and not assist.valid_commands(o, c("a"), "h", "g") and not assist.valid_commands(o, c("z"), "h", "h") and not assist.valid_commands(o, c("a", "a"), "h", "h")


def test_model_plug_in(spark):
    out = tokens.model_spans(rows(spark, ["Anna", None]), lambda texts: [[("PERSON", 0, len(t), 0.9)] if t else [] for t in texts]).collect()
    assert [(r.doc_id, r.entity_type, r.end) for r in out] == [(0, "PERSON", 4)]


# text and files


def test_sentence_boundaries():
    text = "Prof. Dr. Max wohnt in der Bahnhofstr. 12 am 14. Juli. Das ist super."
    assert [sentences.ends_sentence(text, m.start(), m.end()) for m in re.finditer(r"[.!?]+", text)][:5] == [False, False, False, False, True]
    assert [text[a:b] for a, b in sentences.sentences(text)] == [text[:54], text[54:]]


def test_chunks_cover_the_text():
    text = "Kurz.\n" * 40 + ("Ein Satz mit Wörtern. " * 60) + "\n\nEnde"
    got = sentences.chunks(text, 100)
    assert "".join(text[a:b] for a, b in got) == text and all(b - a <= 100 for a, b in got) and sentences.chunks("", 10) == [] and sentences.chunks("x" * 50, 10) == [(0, 50)]


def test_decoding():
    assert files.decode("Müller äöü €".encode("cp1252")) == "Müller äöü €" and files.decode(b"\xef\xbb\xbfx") == "x" and files.decode(b"\x81") == "\x81"
    assert files.json_text(b"{bad") == "{bad"


def test_csv():
    assert files.csv_markdown("Name,Rolle,Hochschule\nA,B,C\nD,E\n,,\n".encode()) == "| Name | Rolle | Hochschule |\n| :--- | :--- | :--- |\n| A | B | C |\n| D | E |  |"
    assert len(files.csv_markdown(b'a,b\n"x\ny",1\n"p|q",2').split("\n")) == 4 and files.csv_markdown(b" ") == ""


def test_pdf_markdown():
    text = "<u>Titel</u> GmbH<br>x\n<!-- Start of picture text -->WandhovenWolfgang<br>LinkedIn<!-- End of picture text -->\n| A | B |\n|---|---|\n| Doku-<br>scan | -<br>Punkt |\n| 1 | Inh | alt | 7 |\n\n\n\nEnde <!-- weg -->"
    want = "Titel GmbH\nx\n\nWandhoven Wolfgang\nLinked In\n\n| A | B |\n| --- | --- |\n| Dokuscan | - Punkt |\n| 1 | | Inhalt | 7 |\n\nEnde"
    assert files.pdf_markdown(text) == want
    assert "Wandhoven" not in files.pdf_markdown(text, pictures=False) and files.pdf_markdown(None) == ""


def test_docx_round_trip(spark, tmp_path):
    raw = files.markdown_docx("# Titel\nText & mehr")
    assert files.docx_markdown(raw) == "# Titel\n\nText & mehr" and zipfile.is_zipfile(io.BytesIO(raw))
    (tmp_path / "a.docx").write_bytes(raw)
    (tmp_path / "b.TXT").write_text("<u>x</u> a@b.ch")
    (tmp_path / "c.exe").write_text("x")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("# Titel\n\nText & mehr", None), "b.TXT": ("x a@b.ch", None), "c.exe": (None, "unsupported")}
    with pytest.raises(files.UnsupportedFormat):
        files.extract("exe", b"")


def test_docx_rules():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, props="", run="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"
    body = p("Kopf", '<w:outlineLvl w:val="2"/>') + p("Punkt", '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>') + p("Eins", '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="2"/></w:numPr>') + p("Zitiert", '<w:pStyle w:val="Q"/>') + p("Gross", run='<w:b/><w:sz w:val="32"/>') + p("fett", run="<w:b/><w:i/>") + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr><w:tr><w:tc>" + p("1") + "</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="Q"><w:name w:val="Intense Quote"/></w:style></w:styles>')
        z.writestr("word/numbering.xml", f'<w:numbering {w}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="5"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="5"/></w:num></w:numbering>')
        z.writestr("word/header1.xml", f"<w:hdr {w}>{p('Kopfzeile')}</w:hdr>")
    want = "### Kopf\n\n- Punkt\n\n1. Eins\n\n> Zitiert\n\n## Gross\n\n***fett***\n\n| a | b |\n| :--- | :--- |\n| 1 |  |"
    assert files.docx_markdown(out.getvalue()) == want and files.docx_markdown(out.getvalue(), margins=True) == "Kopfzeile\n\n" + want


def test_sessions_and_migration(tmp_path):
    store = config.ProjectStore(tmp_path / "s")
    a, b = store.save(config.Project("default", glossary={"SAP": "IT_SYSTEM"})), store.save(config.Project("b"))
    session = config.Session(store, a.project_id)
    session.mark("Sap", "ORGANIZATION")
    assert session.glossary() == {"sap": "ORGANIZATION"}
    with pytest.raises(config.UnsavedChanges):
        session.switch(b.project_id)
    with pytest.raises(PermissionError):
        session.mark_system("x", "ROLE")
    assert session.switch(b.project_id, discard=True) == b and session.glossary() == {}
    old, new = tmp_path / "old.json", config.ProjectStore(tmp_path / "n")
    old.write_text('{"entities": ["PERSON", "URL"], "glossary": {"A": "ROLE"}}')
    done = config.migrate(old, new)
    assert (done.modes["PERSON"], done.modes["URL"], done.modes["ROLE"]) == ("explicit_eupii", "all", "off") and not old.exists()
    assert config.migrate(old, new) == done
    old.write_text("{}")
    with pytest.raises(ValueError):
        config.migrate(old, new)


def test_model_server_rules():
    class Fake:
        def __init__(self):
            self.bodies = []

        def post(self, url, body):
            self.bodies.append(body)
            return (422, []) if "reasoning_effort" in body else (200, [b'{"choices": [{"finish_reason": "length", ', b'"message": {"content": "x"}}]}'])

    fake = Fake()
    assert provider.complete(fake, "u", {"reasoning_effort": "low", "m": 1}) == "x" and fake.bodies[1] == {"m": 1}
    with pytest.raises(ValueError):
        provider.complete(fake, "u", {}, must_stop=True)
    with pytest.raises(ValueError):
        provider.limited_json([b"x" * 10], 5)
    assert provider.root_url("http://localhost:1/v1/") == "http://localhost:1"
    valid = lambda n: ":cloud" not in n
    assert provider.model_status(lambda: (200, [b'{"models": [{"name": "a"}, {"name": "b:cloud"}]}']), valid) == ("success", ["a"])
    assert [provider.model_status(f, valid)[0] for f in (lambda: (404, []), lambda: (200, [b"x"]), lambda: (200, [b'{"models": []}']), lambda: (_ for _ in ()).throw(TimeoutError()), lambda: (_ for _ in ()).throw(OSError()))] == ["unsupported", "invalid_response", "empty", "timeout", "unreachable"]


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Mail a@b.ch")
    (tmp_path / "config.json").write_text('{"detectors": ["email"], "glossary": {"Mail": "ROLE"}, "ignore_terms": []}')
    assert cli.main(["anonymize", str(tmp_path / "in"), str(tmp_path / "out"), "--config", str(tmp_path / "config.json")]) == 0
    assert spark.read.parquet(str(tmp_path / "out/anonymized")).first().anonymized_text == "[ROLE_1] [EMAIL_ADDRESS_1]"
    assert cli.main(["restore", str(tmp_path / "out"), str(tmp_path / "back")]) == 0
    assert spark.read.parquet(str(tmp_path / "back")).first().restored_text == "Mail a@b.ch"
    assert cli.main(["anonymize", str(tmp_path / "in"), str(tmp_path / "no"), "--no-mapping"]) == 0
    assert not (tmp_path / "no/mapping").exists() and "[REDACTED]" in "".join(p.read_text() for p in (tmp_path / "no/report").glob("*.json"))


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    c = Config(detectors=("email", "ip"))
    q = write_stream(anonymize_stream(spark, str(tmp_path / "in"), docs.schema, c, most_files=1), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    want = {tuple(r) for r in Engine(spark, c).anonymize(docs).select("doc_id", "anonymized_text").collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "anonymized_text").collect()} == want
    r = spark.createDataFrame([("a", 1, "h"), ("b", 1, "h")], "request_id string, revision int, document_hash string")
    assert drop_stale(r, r.where("request_id = 'a'")).count() == 1


def test_no_warnings_for_known_types():
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        Config(entity_types=("PERSON",))


def test_row_form_of_roles_and_links(spark):
    roles, links = {"a@b.ch": "Prof"}, {"c@d.ch": ("a@b.ch", ""), "e@f.ch": ("x@y.ch", "ALT")}
    e = Engine(spark, Config(detectors=("email",), roles=roles, links=links, placeholders="numbered_role"))
    docs = rows(spark, ["c@d.ch g@h.ch a@b.ch e@f.ch", "nothing", None])
    out = {r.doc_id: r for r in e.anonymize(docs).collect()}
    own = spark.createDataFrame([(0, k, v) for k, v in roles.items()], "doc_id long, norm_term string, role string")
    linked = spark.createDataFrame([(0, k, *v) for k, v in links.items()], "doc_id long, child_term string, parent_term string, surface_tag string")
    named = {r.start: r.placeholder for r in e.entities(docs, "numbered_role", own, linked).collect()}
    assert {x.start: x.placeholder for x in out[0].entities} == named
    assert out[1].anonymized_text == "nothing" and out[2].anonymized_text is None


def test_texts_of_one_id_and_of_none_keep_their_own_spans(spark):
    e = Engine(spark, Config(detectors=("email",)))
    docs = spark.createDataFrame([(None, "mail a@example.com now"), (7, "hello x@y.ch"), (7, "other and longer z@y.ch, q@y.ch")], "doc_id long, text string")
    named = e.entities(docs)
    assert {r.text: r.anonymized_text for r in label.anonymize(docs, named).collect()} == {r.text: r.anonymized_text for r in e.anonymize(docs).collect()}
    done = label.anonymize(docs, named)
    assert all("@" not in r.anonymized_text for r in done.collect())
    assert all(r.restored_text == r.text for r in label.restore(done, label.mapping(named)).collect())
    with pytest.raises(Exception, match="several texts share an id"):
        label.anonymize(docs, named.drop(label.KEY)).collect()


def test_external_spans_and_residues(spark):
    docs = rows(spark, ["Anna Meier schrieb a@b.ch", "leer"])
    external = spark.createDataFrame([(0, "PERSON", 0, 4, 0.95, "model", "gliner"), (0, "PERSON", 90, 99, 0.9, "model", "gliner")], "doc_id long, entity_type string, start int, end int, score double, recognizer string, method string")
    out = {r.doc_id: r for r in Engine(spark, Config(detectors=("email",))).anonymize(docs, external=external).collect()}
    assert out[0].anonymized_text == "[PERSON_1] Meier schrieb [EMAIL_ADDRESS_1]" and out[1].anonymized_text == "leer"
    assert [(x.placeholder, x.word) for x in out[0].residues] == [("[PERSON_1]", "Meier")]
    assert [x.needs_review for x in out[0].entities] == [True, False]


def test_filters_on_entities_are_planned(spark):
    out = Engine(spark, Config(detectors=("email", "ip"))).anonymize(rows(spark, ["a@b.ch", "x"]))
    assert out.where("size(entities) > 0").count() == 1
