"""Detectors: each turns a text into spans. All pattern detectors run in one scan, without shuffle and without Python.

A detector may also be a table of spans from elsewhere (a model, a reviewer): `with_external` brings those in by document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.spans import let, match_spans, overlap

CANDIDATE = "struct<start:int,end:int,value:string,entity_type:string,score:double,recognizer:string,method:string,seq:int>"

#: fixed values: the canonical entity types
ENTITY_TYPES = (
    "ADDRESS", "AHV_NUMBER", "BANK_ACCOUNT", "CREDIT_CARD", "CRYPTO", "DATE_TIME", "EMAIL_ADDRESS", "FINANCIAL_DATA", "HEALTH_DATA", "IBAN_CODE", "ID_NUMBER", "IP_ADDRESS",
    "IT_SYSTEM", "LOCATION", "MAC_ADDRESS", "MEDICAL_LICENSE", "ORGANIZATION", "PERSON", "PHONE_NUMBER", "ROLE", "UID_NUMBER", "URL", "USERNAME",
)

#: fixed values: parts of addresses
_STREET = r"\b[A-ZÄÖÜ][\wäöüßÄÖÜéèàÉÈÀ-]*(?:strasse|straße|str\.|weg|gasse|platz|allee|ring)\s+\d+[a-z]?\b"
_TOWN_CH = r"\d{4}\s+[A-ZÄÖÜ][\wäöüéèàßÄÖÜÉÈÀ-]+\b"
_TOWN_DE = r"\d{5}\s+[A-ZÄÖÜ][\wäöüßÄÖÜ-]+\b"


@dataclass(frozen=True)
class Detector:
    """A pattern with a score; `valid` drops matches, `rescored` gives a score of its own."""

    name: str
    entity_type: str
    pattern: str
    score: float
    method: str = "regex"
    valid: Callable[[Column], Column] | None = None
    rescored: Callable[[Column], Column] | None = None
    hint: str = ""  #: what every match holds

    def spans(self, text: str, seq: int) -> Column:
        found = match_spans(text, self.pattern, self.hint)
        if self.valid:
            found = F.filter(found, lambda s: self.valid(s["value"]))
        score = self.rescored or (lambda _: F.lit(self.score))
        return F.transform(
            found,
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(self.entity_type).alias("entity_type"), score(s["value"]).cast("double").alias("score"), F.lit(self.name).alias("recognizer"), F.lit(self.method).alias("method"), F.lit(seq).alias("seq")
            ),
        )


def phone_score(value: Column) -> Column:
    """Approximation of a numbering plan: 1.0 if country and length fit, 0.8 if the length may, else 0.4."""
    d = checks.digits(value)
    international = value.startswith("+") & (((d.startswith("1")) & (F.length(d) == 11)) | (d.rlike("^4[139]") & F.length(d).between(10, 13)) | (d.rlike("^44") & (F.length(d) == 12)) | (d.rlike("^3[39]") & F.length(d).between(11, 12)))
    national = ~value.startswith("+") & d.startswith("0") & (F.length(d) == 10)
    return F.when(international | national, 1.0).when(F.length(d).between(7, 15), 0.8).otherwise(0.4)


#: patterns and scores; those of Swiss numbers and addresses are fixed values
DETECTORS: dict[str, Detector] = {
    d.name: d
    for d in (
        Detector("email", "EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0, hint="@"),
        Detector("url", "URL", r"https?://[^\s<>\"]+", 0.6, hint="://"),
        Detector("ip", "IP_ADDRESS", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.95, valid=checks.ip_valid),
        Detector("mac", "MAC_ADDRESS", r"\b[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}\b", 0.95, hint=":"),
        Detector("card", "CREDIT_CARD", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", 1.0, valid=checks.luhn_valid),
        Detector("iban", "IBAN_CODE", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 1.0, valid=checks.iban_valid),
        Detector("date", "DATE_TIME", r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})\b", 0.6),
        Detector("phone", "PHONE_NUMBER", r"(?:\+\d{1,2}|\b0)[ ]?(?:\(\d{2,4}\)|\d{2,3})(?:[ -]\d{2,4}){2,4}\b", 1.0, method="library", rescored=phone_score),
        Detector("crypto", "CRYPTO", r"\b(?:[13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[02-9ac-hj-np-z]{11,71})\b", 1.0, valid=checks.crypto_valid),
        Detector("licence", "MEDICAL_LICENSE", r"\b[A-HJ-MPRSTUXa-hj-mprstux][A-Za-z9]\d{7}\b", 1.0, valid=checks.licence_valid),
        Detector("ahv", "AHV_NUMBER", r"\b756\.\d{4}\.\d{4}\.\d{2}\b", 1.0, valid=checks.ahv_valid, hint="756."),
        Detector("uid", "UID_NUMBER", r"\bCHE-\d{3}\.\d{3}\.\d{3}\b", 1.0, valid=checks.uid_valid, hint="CHE-"),
        Detector("address_full", "ADDRESS", rf"(?iU){_STREET}(?:\s*,\s*|\s+)(?:{_TOWN_CH}|{_TOWN_DE})", 1.0),
        Detector("address_street", "ADDRESS", rf"(?iU){_STREET}", 1.0),
        Detector("address_town", "ADDRESS", rf"(?iU)\b(?:{_TOWN_CH}|{_TOWN_DE})", 1.0, valid=lambda v: ~checks.bare_year_town(v)),
    )
}


def register(detector: Detector) -> None:
    """Adds a detector to those that run by default, or replaces the one of its name."""
    DETECTORS[detector.name] = detector


def unregister(name: str) -> None:
    """Takes a detector out of those that run by default; unknown names are ignored."""
    DETECTORS.pop(name, None)


def spans_array(text: str, names: Sequence[str | Detector] | None = None, enabled: Sequence[str] | None = None) -> Column:
    """All candidates of the detectors, named or given (None: all registered), with an enabled entity type (None: all, empty: none)."""
    chosen = [n if isinstance(n, Detector) else DETECTORS[n] for n in (names if names is not None else DETECTORS)]
    chosen = [d for d in chosen if enabled is None or d.entity_type in enabled]
    if not chosen:
        return F.expr(f"cast(array() as array<{CANDIDATE}>)")
    return F.concat(*(d.spans(text, k) for k, d in enumerate(chosen)))


def detect(docs: DataFrame, names: Sequence[str] | None = None, enabled: Sequence[str] | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per candidate: doc, start, end, value, entity_type, score, recognizer, method, seq."""
    return docs.select(doc, F.explode(spans_array(text, names, enabled)).alias("s")).select(doc, "s.*")


FEW_TERMS = 16  #: up to so many terms each is looked for by itself, more by windows over the text's parts


def term_spans(text: str, terms: Sequence[str], entity_type: str = "", recognizer: str = "terms") -> Column:
    """Whole-word occurrences of terms, any case; terms may hold or end in punctuation. seq is the term's place."""
    wanted = [t.strip() for t in terms if t.strip()]
    if not wanted:
        return F.expr(f"cast(array() as array<{CANDIDATE}>)")
    if len(wanted) > FEW_TERMS:
        return _window_spans(text, wanted, entity_type, recognizer)
    found = [match_spans(text, rf"(?iuU)(?<!\w){_java_quoted(t)}(?!\w)") for t in wanted]
    return F.concat(*(F.transform(x, _labelled(F.lit(k), entity_type, recognizer)) for k, x in enumerate(found)))


_PART = r"(?U)\w+|\W"


def _window_spans(text: str, wanted: list[str], entity_type: str, recognizer: str) -> Column:
    """The same for many terms: the text is cut once into words and single other characters; windows of as many parts as
    terms have are looked up in a hash set, so time grows with the text and not with the number of terms."""
    lowered = [t.lower() for t in wanted]
    sizes: dict[int, list[str]] = {}
    for t in lowered:
        sizes.setdefault(len(re.findall(r"\w+|\W", t)), []).append(t)
    place = F.array(*map(F.lit, lowered))
    word = lambda p: p.rlike(r"(?U)^\w")

    def of(parts: Column) -> Column:
        def found(low: Column, n: int, some: list[str]) -> Column:
            """Occurrences of the terms of n parts."""
            key = lambda i: F.get(low, i) if n == 1 else F.concat(*(F.get(low, i + k) for k in range(n)))
            # a term that begins or ends in another character must not touch a word there
            begins = lambda i: word(F.get(low, i)) | ~F.coalesce(word(F.get(low, i - 1)), F.lit(False))
            ends = lambda i: word(F.get(low, i + n - 1)) | ~F.coalesce(word(F.get(low, i + n)), F.lit(False))
            places = F.filter(F.transform(parts, lambda _, i: i), lambda i: F.coalesce(key(i).isin(*some), F.lit(False)))

            def span(i: Column) -> Column:
                value = F.concat(*(F.get(parts, i + k)["value"] for k in range(n)))
                bounds = F.struct(F.get(parts, i)["start"].alias("start"), F.get(parts, i + n - 1)["end"].alias("end"), value.alias("value"))
                return _labelled((F.array_position(place, key(i)) - 1).cast("int"), entity_type, recognizer)(bounds)

            return F.transform(F.filter(places, lambda i: begins(i) & ends(i)), span)

        low = F.transform(parts, lambda p: F.lower(p["value"]))
        return let(low, lambda low: F.concat(*(found(low, n, some) for n, some in sorted(sizes.items()))))

    return let(match_spans(text, _PART), of)


def mark_term(term: str, text: str, spans: str, entity_type: str) -> Column:
    """A reviewer's mark: all whole-word occurrences of a term that touch no span of the column of spans; score 1."""
    return F.filter(term_spans(text, [term], entity_type, "manual"), lambda s: ~F.exists(F.col(spans), lambda o: overlap(o, s)))


def _labelled(place: Column, entity_type: str, recognizer: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(entity_type).alias("entity_type"), F.lit(1.0).alias("score"), F.lit(recognizer).alias("recognizer"), F.lit("glossary").alias("method"), place.alias("seq"))


def _java_quoted(term: str) -> str:
    return "".join(c if c.isalnum() or c.isspace() or c == "_" else "\\" + c for c in term)


def with_external(found: DataFrame, external: DataFrame) -> DataFrame:
    """Bag union with spans that come as a table."""
    return found.unionByName(external, allowMissingColumns=True)

