"""Helpers of the operators: whole texts as bytes, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def shared_path(spark, name: str) -> str:
    """A new path in the folder that all executors see."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder once and read them from there."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def whole(text: str | Column) -> Column:
    """A text with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def each_text(texts: pa.Array) -> Iterator[str]:
    """The texts of a batch one at a time, so that no second copy of the batch is held; then free memory goes back."""
    for text in texts:
        yield text.as_py()
    pa.default_memory_pool().release_unused()


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of the rows' own (case is ignored)."""
    taken = {c.lower() for c in rows.columns}
    return [next(n for i in range(len(taken) + 1) if (n := f"_{name}{i or ''}").lower() not in taken) for name in names]
