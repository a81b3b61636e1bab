"""Line deduplication by overlapping three-line windows.

Lines without a word are passed over; each three consecutive others are a window, named by two 64-bit
hashes of its lines. A window that occurs more than once in the corpus is kept at its first place, by id
and position, and its other occurrences are removed: the positions they cover, blank lines in between
included, are merged for each document, and the lines at these positions go.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import SPACES, materialise

WINDOW = 3
SALT = 7919


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _windows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """One row per window: id, mark (hash of the text), first and last line, and two hashes."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), _lines(F.col(text_col)).alias("lines"))
    numbered = F.transform("lines", lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    worded = F.filter(numbered, lambda x: F.length(F.translate(x["line"], SPACES, "")) > 0)
    rows = rows.select("id", "mark", F.transform(worded, lambda x: F.struct(x["i"], F.xxhash64(x["line"]).alias("h"), F.xxhash64(F.lit(SALT), x["line"]).alias("g"))).alias("l"))
    rows = rows.where(F.size("l") >= width)
    at = lambda k, field: ", ".join(f"element_at(l, k + {j}).{field}" for j in range(k, k + width))
    windows = F.expr(
        f"transform(sequence(0, size(l) - {width}), k -> struct(element_at(l, k + 1).i AS first, element_at(l, k + {width}).i AS last,"
        f" xxhash64({at(1, 'h')}) AS h, xxhash64({at(1, 'g')}) AS g))"
    )
    return rows.select("id", "mark", F.explode(windows).alias("w")).select("id", "mark", "w.*")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per input row: row (all input columns), n_lines, n_removed and clean (the text that stays).

    Null ids come first in order. A null text stays null and has one empty line; a text of fewer than
    `width` lines with words has no window and stays whole. Repeated rows (same id and text) are one place:
    they keep or lose the same lines. No input rows give no rows.
    """
    windows = _windows(docs, id_col, text_col, width)
    place = F.struct("id", "mark", "first")
    repeated = windows.groupBy("h", "g").agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("times")).where("times > 1")
    # Written first: both sides of the join are then plain exchanges, and a hot window can be split.
    repeated = materialise(repeated.select("h", "g", "kept"), "op2-repeated")
    later = windows.join(repeated, ["h", "g"]).where(place != F.col("kept"))
    covered = later.groupBy("id", "mark").agg(
        F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last")))).alias("covered")
    )
    covered = covered.select(F.col("id").alias("c_id"), F.col("mark").alias("c_mark"), "covered")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"))
    rows = rows.join(covered, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("mark") == F.col("c_mark")), "left")
    text = F.col("row")[text_col]
    lines = _lines(text)
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.transform(F.array_except(places, "covered"), lambda i: F.element_at(lines, i + 1))
    return rows.select(
        "row",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("covered").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("clean"),
    )
