"""Post-processing of a token classifier's predictions, which come as a table (the model is a plug-in)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: the classifier's labels and the entity types they stand for
LABELS = {
    "PERSON_NAME": "PERSON", "PROPER_NAME": "PERSON", "PERSON_ALIAS": "PERSON", "LOCATION": "LOCATION", "POSTAL_ADDRESS": "LOCATION", "GEO_LOCATION": "LOCATION",
    "DOCUMENT_IDENTIFIER": "ID_NUMBER", "DOCUMENT_REFERENCE": "ID_NUMBER", "PERSON_IDENTIFIER": "ID_NUMBER", "BANK_ACCOUNT_IDENTIFIER": "ID_NUMBER", "ACCOUNT_IDENTIFIER": "ID_NUMBER",
    "ORGANIZATION_IDENTIFIER": "ID_NUMBER", "DEVICE_IDENTIFIER": "ID_NUMBER", "VEHICLE_IDENTIFIER": "ID_NUMBER", "HEALTH_DATA": "HEALTH_DATA",
}


def windows(token_counts: DataFrame, size: int = 384, stride: int = 64, doc: str = "doc_id") -> DataFrame:
    """token_counts(doc, n) -> (doc, window, first, last): windows of `size` tokens that share `stride` with the one before."""
    step = size - stride
    count = F.greatest(F.lit(1), F.ceil((F.col("n") - size) / step).cast("int") + 1)
    rows = token_counts.where("n > 0").select(doc, "n", F.explode(F.sequence(F.lit(0), count - 1)).alias("window"))
    return rows.select(doc, "window", (F.col("window") * step).cast("int").alias("first"), F.least(F.col("window") * step + size, F.col("n")).cast("int").alias("last"))


def bio_spans(predictions: DataFrame, threshold: float = 0.5, doc: str = "doc_id", with_count: bool = False) -> DataFrame:
    """predictions(doc, window, pos, start, end, label, score) -> spans with the mean token score, by gaps and islands.

    An entity goes on with the same type, by an I- label or as a piece glued to the token before; O and empty tokens end it.
    """
    names = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    raw = F.substring("label", 3, 100)
    t = predictions.withColumn("kind", F.when((F.col("label") != "O") & (F.col("end") > F.col("start")), F.coalesce(names[raw], raw)))
    order = Window.partitionBy(doc, "window").orderBy("pos")
    goes_on = (F.lag("kind").over(order) == F.col("kind")) & (F.col("label").startswith("I") | (F.lag("end").over(order) == F.col("start")))
    t = t.withColumn("fresh", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("fresh").over(order))
    spans = t.where("kind is not null").groupBy(doc, "window", "island").agg(F.first("kind").alias("entity_type"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))
    return spans.where(F.col("score") >= threshold).select(doc, "window", "entity_type", "start", "end", F.round("score", 3).alias("score"), *(["n"] if with_count else []))


def model_spans(docs: DataFrame, model: Callable[[list[str]], list[list[tuple[str, int, int, float]]]], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The plug-in: a model called on lists of texts in executors, giving (entity_type, start, end, score) for each text."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, *s) for d, spans in zip(f[doc], model(f[text].fillna("").tolist()), strict=True) for s in spans]
            yield pd.DataFrame(rows, columns=[doc, "entity_type", "start", "end", "score"])

    return docs.select(doc, text).mapInPandas(run, f"{doc} {kind}, entity_type string, start int, end int, score double")
