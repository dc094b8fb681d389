"""Labelled case folders and text documents (SRC-03, SRC-07, FLT-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bounded_document, strip


def decoded(content: Column) -> Column:
    """A file's bytes as text: bytes that are no UTF-8 become replacement characters, a leading mark is dropped."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\ufeff", "")


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """folder, path and decoded text of each file below `root` whose name has the pattern; a folder `x=1` is called 1."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return rows.select(F.regexp_extract("path", "([^/=]+)/[^/]+$", 1).alias("folder"), "path", decoded(F.col("content")).alias("text"))


def case_folder(spark: SparkSession, root: str, schema: str, text_file: str, truth_file: str = "ground-truth.json") -> DataFrame:
    """SRC-03: ground truth in JSON beside a text file in one directory per case.

    The id inside the JSON must be the directory's name; anything else fails the read.
    """
    truth = files(spark, root, truth_file).select("folder", F.from_json("text", schema).alias("t")).select("folder", "t.*")
    texts = files(spark, root, text_file).select("folder", strip(F.col("text")).alias("text"))
    cases = truth.join(texts, "folder", "left")
    problem = (
        F.when(F.col("case_id").isNull() | (F.col("case_id") != F.col("folder")), "case id differs from its folder")
        .when(F.coalesce("text", F.lit("")) == "", "case has no text")
    )
    guard = F.when(problem.isNotNull(), F.raise_error(F.concat_ws(": ", "folder", problem)).cast("boolean"))
    return cases.where(F.coalesce(guard, F.lit(True))).drop("folder")


def select_cases(cases: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """FLT-14: the asked-for cases, named in a list or in a table's case_id; an unknown id is an error. An empty list asks for all."""
    if isinstance(ids, list):
        if not ids:
            return cases
        ids = cases.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "case_id string")
    wanted = ids.select("case_id").distinct()
    unknown = [r["case_id"] for r in wanted.join(cases, "case_id", "left_anti").orderBy("case_id").limit(20).collect()]
    if unknown:
        raise ValueError(f"unknown cases: {', '.join(unknown)}")
    return cases.join(wanted, "case_id", "left_semi")


def text_documents(spark: SparkSession, root: str, pattern: str = "*.txt", limit: int | None = None) -> DataFrame:
    """SRC-07: one row per file, normalised; with a limit, a longer text is cut to it and carries a warning."""
    rows = files(spark, root, pattern)
    text, warnings = bounded_document(F.col("text"), limit)
    return rows.select("folder", "path", text.alias("text"), warnings.alias("warnings"))
