"""Row-wise operators over Arrow batches that keep the input's columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .store import prepare


def reserved(fields: T.StructType) -> T.StructType:
    """Fields under names that no caller's column has."""
    return T.StructType([T.StructField(f"_mw_{f.name}", f.dataType) for f in fields])


def add_columns(df: DataFrame, new: T.StructType, make: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """df with the columns `new`, made batch by batch; an input column of such a name is replaced."""
    prepare(df.sparkSession)
    df = df.drop(*new.names)
    schema = T.StructType([*df.schema.fields, *new.fields])
    kinds = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = [x.cast(k) if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(make(batch), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return df.mapInArrow(run, schema)


def join_classes(rows: DataFrame, classes: DataFrame, key: str, n: str, hot: int = 1000) -> DataFrame:
    """rows joined with classes(key, n, ...), one row a key, n being the key's rows; a key may hold any share of rows.

    Keys of more than a `hot`-th of all rows, of which there are fewer than `hot`, are broadcast; only the others are dealt.
    """
    total = classes.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) > F.lit(max(1, total // hot))
    few = classes.where(often).drop(n)
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(few.select(key)), key, "left_anti").join(classes.where(~often).drop(n), key))


def code_points(data: bytes | np.ndarray) -> np.ndarray:
    """Code points before each byte offset 0..len(data) of UTF-8 bytes."""
    b = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    return np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
