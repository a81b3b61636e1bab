"""Helpers that the operators of this package share."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.session import fresh_path, materialise, ship_package

__all__ = ["SPACES", "WORD", "arrow_map", "fresh_path", "materialise", "read_table", "word_count"]

#: A word: a run of characters other than ASCII white space (fixed by the data contract).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. Each word becomes one mark, white space goes, marks are counted."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marks, SPACES, "")).cast("long")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(rows: DataFrame, run, schema) -> DataFrame:
    """rows.mapInArrow, with this package sent to the workers first."""
    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, schema)
