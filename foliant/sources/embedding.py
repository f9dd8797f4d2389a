"""Vectors of texts from a model that is called with batches and may fail: all rows get one, or nothing is kept."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.sources.files import Folder

BATCH, ATTEMPTS, WAIT = 100, 3, 1.0
Model = Callable[[list[str]], Sequence[Sequence[float]]]


def called(model: Model, texts: list[str], attempts: int = ATTEMPTS, wait: float = WAIT) -> list[list[float]]:
    """One vector a text. A call that fails, or answers with another number of vectors, is made again after 1, 2, ... times ``wait`` seconds; the last failure is raised."""
    for attempt in range(1, attempts + 1):
        try:
            got = model(texts)
            if got is None or len(got) != len(texts):
                raise ValueError(f"expected {len(texts)} vectors, got {0 if got is None else len(got)}")
            return [[float(x) for x in v] for v in got]
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(attempt * wait)
    raise ValueError("no attempt")


def embedded(df: DataFrame, text: str, model: Model, name: str = "values", size: int = BATCH, attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """``df`` with vectors; null texts count as empty. A batch that fails for good fails the job."""
    columns, at = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                vectors = called(model, [t or "" for t in part.column(at).to_pylist()], attempts, wait)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], [*columns, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))]))


def commit_embedded(df: DataFrame, folder: str, name: str, text: str, model: Model, **how) -> DataFrame:
    """Embed ``df`` into the table ``name`` of ``folder``, which appears only once every row of ``df`` has its vector there.

    The rows are written under another name, counted against ``df`` and then renamed; a failure leaves nothing.
    """
    spark, draft = df.sparkSession, f"{name}.part"
    place = Folder(spark, folder)
    if name in place.names():
        raise FileExistsError(f"{folder}/{name}")
    place.delete(draft)
    try:
        embedded(df, text, model, **how).write.parquet(f"{place.path}/{draft}")
        got, want = spark.read.parquet(f"{place.path}/{draft}").count(), df.count()
        if got != want:
            raise ValueError(f"{want} rows, {got} vectors")
        place.move(draft, name)
    except Exception:
        place.delete(draft)
        raise
    return spark.read.parquet(f"{place.path}/{name}")
