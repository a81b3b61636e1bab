"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and get
integer names; adjacent names are paired, the distinct pairs are sorted and named in turn, and so on
until each document has one name. Two documents of the same number of rounds have the same last name
exactly if their bytes are equal: equal names stand for equal contents in each round, without hashing.

Blocks are named where they are told apart by their bytes. Rows then look their names up by the block's
SHA-256, so that contents cross one shuffle only, copies of a block combined before it. Should two different
blocks ever have one digest, names are looked up by content instead: the result never rests on a hash.

Tables of names are written before rows are joined with them, so adaptive execution can split a block or a
pair that very many documents hold (a group of copies may be a third of all rows).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.session import Scratch

BLOCK_BYTES = 2048


def _named(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Integer names for distinct keys: partition number and rank in the sorted partition."""
    return distinct.sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())


def _blocks(docs: DataFrame, id_col: str, text_col: str, size: int, keyed: bool) -> DataFrame:
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    count = F.greatest(F.lit(1), F.ceil(F.length("data") / F.lit(size))).cast("int")
    cols = [data.alias("data")]
    if keyed:
        cols += [
            F.monotonically_increasing_id().alias("rid"),
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(data, 256)).alias("sha"),
        ]
    cut = F.expr(f"transform(sequence(0, n - 1), i -> substring(data, i * {size} + 1, {size}))")
    rows = docs.select(*cols).withColumn("n", count)
    if not keyed:
        return rows.select(F.explode(cut).alias("block"))
    return rows.select("rid", "id", "sha", "n", F.posexplode(cut).alias("pos", "block"))


def _digest(block: Column) -> Column:
    return F.unhex(F.sha2(block, 256))


def _first_names(docs: DataFrame, id_col: str, text_col: str, size: int, write) -> DataFrame:
    """One row per block: rid, id and sha (first block only), n, pos, name."""
    digest = _digest(F.col("block")).alias("key")
    distinct = _blocks(docs, id_col, text_col, size, keyed=False).select(digest, "block").distinct()
    names = write(_named(distinct, ["block"], "name").select("key", "name"), "op5-blocks")
    key = digest
    if not names.groupBy("key").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").isEmpty():
        key = F.col("block").alias("key")
        names = write(_named(distinct.select(key), ["key"], "name"), "op5-blocks")
    rows = _blocks(docs, id_col, text_col, size, keyed=True)
    first = F.col("pos") == 0
    rows = rows.select("rid", F.when(first, F.col("id")).alias("id"), F.when(first, F.col("sha")).alias("sha"), "n", "pos", key)
    return rows.join(names, "key").select("rid", "id", "sha", "n", "pos", "name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Name the texts of docs and choose the row that stays of each group of equal texts.

    Returns one row per input row: id, keep_id (largest id of the group), group_size, kept, text_sha256.
    Texts are compared unchanged; a null text counts as empty. A null id is smaller than any other, so
    such a row stays only if its group has no other ids. Of repeated rows (same id and text) all are
    counted and exactly one stays. No input rows give no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    first = scratch.write(_first_names(docs, id_col, text_col, block_bytes, scratch.write), "op5-names")
    base = first.where("pos = 0").select("rid", "id", "sha")
    most, blocks = first.agg(F.max("n"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0))).first()
    most, blocks = most or 1, blocks or 0
    done = [first.where("n = 1").select("rid", F.lit(0).alias("level"), "name")]
    now, level = first.where("n > 1").select("rid", "n", "pos", "name"), 0
    while most > 1:
        # Each round has at most half of the blocks of the one before, and one more for each document.
        level, most = level + 1, (most + 1) // 2
        pairs = now.groupBy("rid", F.shiftright("pos", 1).alias("pos")).agg(
            F.max("n").alias("n"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.max(F.when(F.col("pos") % 2 == 1, F.struct("name"))).alias("b"),
        )
        # The flag keeps a missing right neighbour apart from every name.
        pairs = pairs.select(
            "rid", "pos", F.shiftright(F.col("n") + 1, 1).alias("n"), "a",
            F.coalesce(F.col("b.name"), F.lit(0)).alias("b"), F.col("b").isNotNull().alias("two"),
        )
        names = scratch.write(_named(pairs.select("a", "b", "two").distinct(), ["a", "b", "two"], "name"), "op5-pairs", blocks)
        step = scratch.write(pairs.join(names, ["a", "b", "two"]).select("rid", "n", "pos", "name"), "op5-round", blocks)
        done.append(step.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        now = step.where("n > 1")
    named = done[0]
    for part in done[1:]:
        named = named.unionByName(part)
    rows = scratch.write(base.join(named, "rid"), "op5-rows")
    groups = rows.groupBy("level", "name").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "rid")).alias("keep")
    )
    groups = scratch.write(groups, "op5-groups")
    scratch.clear(rows, groups)
    return rows.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
