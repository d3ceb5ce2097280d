"""Glossary matching: exact terms, folded n-grams, and fuzzy similarity by longest common subsequence."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import match_spans
from ..shipping import ship

HIGH, REVIEW = 90.0, 75.0
TOKEN = r"(?U)\b[\w.-]+\b"


def folded(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


def similarity(a: str, b: str) -> float:
    """200 * LCS / (len a + len b); LCS by bit vectors, one word operation a character."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def token_ngrams(text: str, most_words: int) -> Column:
    """array<struct<start, end, value>> of windows of 1..most_words tokens."""
    tokens = match_spans(text, TOKEN)
    of_size = lambda n: F.transform(F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["i"] + n <= F.size(tokens)), lambda x: F.struct(x["t"]["start"].alias("start"), F.element_at(tokens, x["i"] + n)["end"].alias("end")))
    spans = F.concat(*(of_size(n) for n in range(1, most_words + 1)))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.col(text).substr(s["start"] + 1, s["end"] - s["start"]).alias("value")))


def fuzzy_matches(tokens: DataFrame, terms: DataFrame, high: float = HIGH, review: float = REVIEW, most_terms: int = 10_000) -> DataFrame:
    """(token, term, entity_type, ratio, score, kind) for similar pairs of tokens(token) and terms(term, entity_type).

    A glossary is a configuration: up to `most_terms` it is broadcast and pairs are joined on lengths that can reach the
    threshold, in buckets of length; a larger one takes the same equi-join without the broadcast. Levenshtein distance is at
    most the indel distance, so its bound is a sound filter before the exact ratio.
    """
    ship(tokens.sparkSession)
    normal = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else folded(x)), "string")
    ratio = F.pandas_udf(lambda a, b: pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)]), "double")
    t = tokens.where("token is not null").select("token", normal("token").alias("tn")).withColumn("tl", F.length("tn"))
    low, up = review / (200 - review), (200 - review) / review
    g = terms.select("term", "entity_type", normal("term").alias("gn")).withColumn("gl", F.length("gn"))
    g = g.withColumn("tl", F.explode(F.sequence(F.ceil(F.col("gl") * low).cast("int"), F.floor(F.col("gl") * up).cast("int"))))
    if terms.limit(most_terms + 1).count() <= most_terms:
        g = F.broadcast(g)
    near = t.join(g, "tl").where((F.length("token") >= 3) | (F.length("term") >= 3)).where(F.levenshtein("tn", "gn") <= (1 - review / 100) * (F.col("tl") + F.col("gl")))
    scored = near.withColumn("ratio", F.when(F.col("tn") == F.col("gn"), 100.0).otherwise(ratio("tn", "gn"))).where(F.col("ratio") >= review)
    kind = F.when(F.col("tn") == F.col("gn"), "direct").otherwise("fuzzy")
    return scored.select("token", "term", "entity_type", F.round("ratio", 6).alias("ratio"), F.when(kind == "direct", 1.0).when(F.col("ratio") >= high, 0.95).otherwise(0.80).alias("score"), kind.alias("kind"))
