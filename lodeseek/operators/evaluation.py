"""Evaluation of selections against gold sets (Q1 to Q6), as aggregates over questions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.text import estimate_tokens


def set_recall(rows: DataFrame) -> DataFrame:
    """recall: found over gold of all questions (Q1). rows: picked and gold arrays."""
    found = F.sum(F.size(F.array_intersect("picked", "gold")))
    return rows.agg((found / F.sum(F.size("gold"))).alias("recall"))


def recall_at_k(rows: DataFrame, k: int) -> DataFrame:
    """all_gold and per_table: the share of questions with all gold among the first k, and the mean share found (Q2)."""
    low = lambda c: F.transform(c, lambda x: F.lower(F.substring_index(x, ".", -1)))
    first, gold = F.slice(low(F.col("picked")), 1, k), low(F.col("gold"))
    missed = F.size(F.array_except(gold, first))
    return rows.where(F.size("gold") > 0).agg(
        F.avg((missed == 0).cast("double")).alias("all_gold"), F.avg(1 - missed / F.size(F.array_distinct(gold))).alias("per_table")
    )


def any_hit(picked: Column, gold: Column) -> Column:
    """Whether one of the gold set was picked (Q3)."""
    return F.arrays_overlap(picked, gold)


def beats_decoy(picked: Column, want: Column, decoy: Column) -> Column:
    """Whether the wanted object is there, and its decoy is not or comes later (Q4)."""
    at, other = F.array_position(picked, want), F.array_position(picked, decoy)
    return (at > 0) & ((other == 0) | (at < other))


def gold_tables(sql: Column) -> Column:
    """Bare names of the tables that SQL text reads, without its CTE names (Q5); a wildcard suffix is cut."""
    low = F.lower(sql)
    names = F.regexp_extract_all(low, F.lit(r"\b(?:from|join)\s+[`\"\[]?([a-z0-9_.$*-]+)"), 1)
    ctes = F.regexp_extract_all(low, F.lit(r"(?:\bwith|,)\s+([a-z0-9_]+)\s+as\s*\("), 1)
    bare = F.transform(names, lambda n: F.regexp_replace(F.substring_index(n, ".", -1), r"_?\*$", ""))
    return F.array_sort(F.array_except(F.filter(bare, lambda n: n != ""), ctes))


def token_reduction(rows: DataFrame) -> DataFrame:
    """reduction: 1 - the mean of the selected tokens over the full ones (Q6). rows: selected and full texts."""
    return rows.agg((1 - F.avg(estimate_tokens(F.col("selected"))) / F.avg(estimate_tokens(F.col("full")))).alias("reduction"))
