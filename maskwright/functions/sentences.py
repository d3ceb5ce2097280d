"""Sentences and chunks with offsets; rules need both sides of a stop, so they run in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship

#: fixed values: abbreviations and months that a full stop may follow within a sentence
ABBREVIATIONS = frozenset("dr prof hr fr frau herr nr st bzw etc z.b u.a d.h inkl ca vgl abs art jan feb mär apr jun jul aug sep okt nov dez univ ass dipl ing mag bsc msc phd co gmbh ag inc ltd".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep okt nov dez".split())
_STOP, _PARAGRAPH = re.compile(r"[.!?]+"), re.compile(r"[^\r\n]+(?:\r?\n)?|\r?\n")


def ends_sentence(text: str, start: int, end: int) -> bool:
    """Whether the stops text[start:end] end a sentence: white space or nothing follows, no abbreviation, ordinal date or lower-case word."""
    rest = text[end:]
    if rest and not rest[0].isspace():
        return False
    words = text[max(0, start - 200) : start].split()
    if not words:
        return False
    word, rest = words[-1].lower().rstrip(".!?"), rest.lstrip()
    if word in ABBREVIATIONS or word.endswith(("str", "str.")) or rest[:1].islower():
        return False
    return not (word.isdigit() and rest and rest.split(maxsplit=1)[0].lower().rstrip(",;.:") in MONTHS)


def sentences(text: str) -> list[tuple[int, int]]:
    cuts = [m.end() for m in _STOP.finditer(text) if ends_sentence(text, m.start(), m.end())]
    return list(zip([0, *cuts], [*cuts, len(text)], strict=True))[: len(cuts) + (not cuts or cuts[-1] < len(text))]


def _packed(parts: Iterator[tuple[int, int]], most: int) -> Iterator[tuple[int, int]]:
    begin = end = None
    for a, b in parts:
        if begin is not None and b - begin > most:
            yield begin, end
            begin = None
        begin, end = (a if begin is None else begin), b
    if begin is not None:
        yield begin, end


def chunks(text: str, most: int = 800) -> list[tuple[int, int]]:
    """Paragraphs packed up to `most` characters; a longer paragraph is packed from its sentences, which are never cut."""
    if len(text) <= most:
        return [(0, len(text))] if text else []
    out: list[tuple[int, int]] = []
    short: list[tuple[int, int]] = []
    for m in _PARAGRAPH.finditer(text):
        if m.end() - m.start() <= most:
            short.append(m.span())
            continue
        out += _packed(iter(short), most)
        short = []
        out += _packed(((m.start() + a, m.start() + b) for a, b in sentences(m.group())), most)
    return [*out, *_packed(iter(short), most)]


def spans_of(docs: DataFrame, what: str, most: int = 800, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, k, start, end) of the sentences or chunks of each text."""
    ship(docs.sparkSession)
    find = sentences if what == "sentences" else lambda t: chunks(t, most)
    kind = docs.schema[doc].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(d, k, a, b) for d, t in zip(f[doc], f[text].fillna(""), strict=True) for k, (a, b) in enumerate(find(t))], columns=[doc, "k", "start", "end"])

    return docs.select(doc, text).mapInPandas(run, f"{doc} {kind}, k int, start int, end int")
