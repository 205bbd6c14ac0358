"""Small helpers for functions that run over Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Any) -> DataFrame:
    """(doc_id, text as UTF-8 bytes, more): nothing else of the input goes to Python."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *more)


def pairs(batch: pa.RecordBatch) -> Iterator[tuple[Any, bytes | None]]:
    """(doc_id, text) of each row; texts are made one at a time."""
    ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
    for i, doc_id in enumerate(ids):
        yield doc_id, texts[i].as_py()


def batch_of(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)
