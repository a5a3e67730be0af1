"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import stream_folder

WHITE_SPACE = b" \t\n\v\f\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, by whatever path Spark can read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write a result once to the cluster's shared folder and read it back.

    Cuts the lineage: a lost executor repeats its own tasks on the written table only.
    """
    path = stream_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str) -> Column:
    """A text column, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow text column."""
    return column.cast(pa.binary()).to_pylist()


def by_record(work: Callable[..., Iterator[tuple]], names: list[str]) -> Callable:
    """Turn a function over one batch's columns into one for mapInArrow; it returns columns in the order of names."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(work(*[batch.column(i) for i in range(batch.num_columns)]), names=names)

    return run


def merge_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after joining the components of each pair; a label is the smallest position of its component."""
    while True:
        a, b = labels[left], labels[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_pairs = low < high
        if not open_pairs.any():
            return labels
        left, right = left[open_pairs], right[open_pairs]
        np.minimum.at(labels, high[open_pairs], low[open_pairs])
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped
