"""Value sampling: which columns hold few distinct values, and which values (V1 to V4)."""

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.text import PERSONAL, looks_personal

#: Fixed values of the rules.
TYPES = r"(?i)^(varchar|varchar2|nvarchar|nvarchar2|char|nchar|text|string)(\((\d+)[^)]*\))?$"
WIDTH = 40
DISTINCT = 25
RATIO = 5
BUDGET_SECONDS = 30.0


def is_candidate(name: Column, type: Column, pk: Column, roles: Column, deny: tuple[str, ...] = PERSONAL) -> Column:
    """Whether a column may be sampled (V1): text of a declared width of 40 or less or none, no key, not restricted, no personal name."""
    width = F.regexp_extract(type, TYPES, 3)
    short = (width == "") | (width.cast("int") <= WIDTH)
    free = F.size(F.coalesce(roles, F.array().cast("array<string>"))) == 0
    return ~F.coalesce(pk, F.lit(False)) & free & ~looks_personal(name, deny) & type.rlike(TYPES) & short


def sample_values(table: DataFrame, columns: list[str], most: int = DISTINCT) -> DataFrame:
    """column and values (sorted text) of the columns with few distinct values (V2, V3).

    One pass over the table for all columns: distinct counts are approximated first with a bounded state,
    and the values of the columns that may qualify are gathered in a second pass. A column qualifies with
    1 to `most` values, none longer than 40 characters, and fewer than a fifth as many values as rows.
    """
    if not columns:
        return table.sparkSession.createDataFrame([], "column string, values array<string>")
    guess = table.agg(*[F.approx_count_distinct(F.col(c), 0.02).alias(c) for c in columns]).first()
    # The estimate's error is far below this margin, so no column that qualifies is left out.
    likely = [c for c in columns if 0 < guess[c] <= 2 * most]
    if not likely:
        return table.sparkSession.createDataFrame([], "column string, values array<string>")
    pairs = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in likely])).alias("p"))
    pairs = pairs.groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
    counts = pairs.groupBy("column").agg(F.sum("n").alias("rows"), F.array_sort(F.collect_set("value")).alias("values"))
    short = F.forall("values", lambda v: F.length(v) <= WIDTH)
    fits = (F.size("values") >= 1) & (F.size("values") <= most) & short & ((F.size("values") * RATIO < F.col("rows")) | (F.col("rows") == 0))
    return counts.where(fits).select("column", "values")


def sample_catalog(objects: DataFrame, tables: dict[str, DataFrame], deny: tuple[str, ...] | None = None, budget: float = BUDGET_SECONDS) -> DataFrame:
    """objects with sampled values in their columns. tables: by qname. No table is begun after the budget; one that fails is left out."""
    from lodeseek.model import qname

    names = PERSONAL if deny is None else tuple(deny)
    cols = objects.select(qname().alias("q"), F.explode("columns").alias("c")).where(
        is_candidate(F.col("c.name"), F.col("c.type"), F.col("c.pk"), F.col("c.roles"), names)
    )
    wanted: dict[str, list[str]] = {}
    for r in cols.select("q", F.col("c.name").alias("name")).collect():
        wanted.setdefault(r["q"], []).append(r["name"])
    began, found = time.monotonic(), []
    for q, names_ in wanted.items():
        if q not in tables or time.monotonic() - began > budget:
            continue
        try:
            found += [(q, r["column"], r["values"]) for r in sample_values(tables[q], names_).collect()]
        except Exception as e:  # noqa: BLE001  a table that can't be read has no values
            found.append((q, "", [str(type(e).__name__)]))
    rows = objects.sparkSession.createDataFrame([f for f in found if f[1]], "q string, column string, values array<string>")
    by_q = rows.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("column", "values"))).alias("sampled"))
    value = lambda c: F.coalesce(F.element_at("sampled", c["name"]), c["values"])
    columns = F.when(F.col("sampled").isNull(), F.col("columns")).otherwise(F.transform("columns", lambda c: c.withField("values", value(c))))
    return objects.withColumn("q", qname()).join(by_q, "q", "left").withColumn("columns", columns).select(*objects.columns)
