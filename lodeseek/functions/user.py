"""Functions of a caller's own in SQL: scalar ones over Arrow batches, and table functions."""

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf

from lodeseek.session import ship_package


def register_scalar(spark: SparkSession, name: str, f: Callable[..., pa.Array], returns: str) -> None:
    """Registers f(*arrays) -> array, which gets whole Arrow batches of its arguments, under a name for SQL."""
    ship_package(spark)
    spark.udf.register(name, arrow_udf(f, returns))


def register_rows(spark: SparkSession, name: str, f: Callable[..., Iterable[tuple]], returns: str) -> None:
    """Registers f(*values) -> rows as a table function, for FROM name(...) and LATERAL joins; rows are sent in Arrow batches."""
    ship_package(spark)

    class Rows:
        def eval(self, *values):
            yield from f(*values)

    spark.udtf.register(name, udtf(Rows, returnType=returns, useArrow=True))
