"""Extractor registry and fallback merge (UDF-01..04, JOIN-25, PRJ-10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Error categories of an extractor.
ERRORS = (
    "configuration", "authentication", "rate_limit", "timeout", "unavailable", "invalid_response", "unexpected",
)


class ExtractionFailure(Exception):
    """Raised by an extractor for one row; it never fails the job."""

    def __init__(self, category: str, message: str):
        super().__init__(message)
        self.category = category if category in ERRORS else "unexpected"


@dataclass(frozen=True)
class Extractor:
    name: str
    version: str
    schema: str
    function: Callable[[pd.Series], pd.DataFrame]


_registry: dict[str, Extractor] = {}


def register_extractor(name: str, version: str, schema: str, function) -> Extractor:
    """UDF-01: `function` maps one text to a dict of the declared fields."""
    _registry[name] = Extractor(name, version, schema, function)
    return _registry[name]


def get_extractor(name: str) -> Extractor:
    if name not in _registry:
        raise KeyError(f"extractor {name!r} is not registered")
    return _registry[name]


def run_extractor(rows: DataFrame, name: str, key: str, text: str) -> DataFrame:
    """key, result struct (NULL on failure), error_category, error_message, provider, version."""
    extractor = get_extractor(name)
    key_type = rows.schema[key].dataType
    result = T.StructType.fromDDL(extractor.schema)
    schema = T.StructType(
        [T.StructField(key, key_type), T.StructField("result", result),
         T.StructField("error_category", T.StringType()), T.StructField("error_message", T.StringType())]
    )
    function, fields = extractor.function, result.names

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch[text]):
                try:
                    value = function(t)
                    out.append((k, {f: value.get(f) for f in fields}, None, None))
                except ExtractionFailure as failure:
                    out.append((k, None, failure.category, str(failure)))
                except Exception as failure:  # a broken row is data, not a broken job
                    out.append((k, None, "unexpected", str(failure)))
            yield pd.DataFrame(out, columns=[key, "result", "error_category", "error_message"])

    return rows.select(key, text).mapInPandas(apply, schema).withColumns(
        {"provider": F.lit(extractor.name), "version": F.lit(extractor.version)}
    )


def with_defaults(struct: Column, defaults: dict[str, Column]) -> Column:
    """PRJ-10: a full record from a partial one."""
    return F.struct(*[F.coalesce(struct[name], value).alias(name) for name, value in defaults.items()])


def merge_fallback(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """JOIN-25: primary result, else fallback with warnings, else a manual stub; attempts are logged.

    Both: key, result, warnings, error_category, error_message, provider.
    """
    side = lambda df, p: df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in ("result", "warnings", "error_category", "error_message", "provider")])
    rows = side(primary, "a").join(side(fallback, "b"), key, "left")
    good, spare = F.col("a_result").isNotNull(), F.col("b_result").isNotNull()
    issue = lambda who, p: F.concat(
        F.lit(f"{who} extractor issue ("), F.col(f"{p}_error_category"), F.lit("): "), F.col(f"{p}_error_message")
    )
    attempt = lambda p: F.struct(
        F.col(f"{p}_provider").alias("provider"), F.col(f"{p}_result").isNotNull().alias("ok"),
        F.coalesce(F.col(f"{p}_error_category"), F.lit("")).alias("error_category"),
    )
    empty = F.array().cast("array<string>")
    warnings = (
        F.when(good, F.coalesce("a_warnings", empty))
        .when(spare, F.concat(F.array(F.lit("fallback_used"), issue("Primary", "a")), F.coalesce("b_warnings", empty)))
        .otherwise(F.array_compact(F.array(F.lit("manual_review"), issue("Primary", "a"), issue("Fallback", "b"))))
    )
    return rows.select(
        key,
        F.coalesce("a_result", "b_result").alias("result"),
        F.when(good, "primary_success").when(spare, "fallback_success").otherwise("all_extractors_failed").alias("status"),
        (~good & spare).alias("fallback_used"),
        (~good & ~spare).alias("manual_review"),
        warnings.alias("warnings"),
        F.when(good, F.array(attempt("a"))).otherwise(F.array(attempt("a"), attempt("b"))).alias("attempts"),
    )
