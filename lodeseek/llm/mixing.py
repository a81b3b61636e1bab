"""Mixing sources to target weights.

Sizes are summed for each source, the repetition rate of a source is its target over its size, and
each document is emitted floor(rate) times plus once more with probability equal to the fraction,
drawn from a hash of seed and id, so that reruns agree.
"""

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import materialise, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Names of sources are broadcast up to these bounds; beyond them the join is salted.
BROADCAST_SOURCES = 100_000
BROADCAST_BYTES = 8 << 20
SALTS = 64


def _in_turn(by_source: DataFrame, weights: tuple, write) -> DataFrame:
    """by_source with the weight of each source: they take the weights in turn, in code point order, null last.

    The place of a source is its place in a range of sources and the number of sources in earlier ranges; one
    number for each range comes to the driver.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranges = by_source.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of a row in its range stands in the lower 33 bits.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = write(ranges.select("*", F.spark_partition_id().alias("range"), place.alias("place")), "op6-sources")
    counts = sorted((r["range"], r["count"]) for r in ranges.groupBy("range").count().collect())
    begins = dict(zip((k for k, _ in counts), itertools.accumulate((n for _, n in counts), initial=0), strict=False))
    if not begins:
        return ranges.withColumn("weight", F.lit(0.0))
    begin = F.element_at(F.create_map(*[F.lit(x) for pair in begins.items() for x in pair]), F.col("range"))
    turn = F.pmod(begin + F.col("place"), F.lit(len(weights))) + 1
    return ranges.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, write=materialise) -> DataFrame:
    """Targets of the sources of sized (source, size): source, source_size, target.

    Sources in code point order, null last, take the weights in turn. They share `share` times all
    sizes by weight; none gets more than `most` times its size, and the excess is shared again by
    weight until none is above. A round of that sums over the sources in all tasks; two numbers of each come
    to the driver, and the sources themselves stay where they are, however many they are.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = _in_turn(by_source, weights, write).withColumn("full", F.col("source_size") * F.lit(float(most)))
    total, weight = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    total, left, weights_left = (total or 0) * share, (total or 0) * share, weight or 0.0
    while weights_left > 0:
        # Sources are full if what they would get is no less than what they may.
        is_full = F.col("full") * F.lit(weights_left) <= F.lit(left) * F.col("weight")
        taken, gone = rows.where(is_full).agg(F.sum("full"), F.sum("weight")).first()
        before, left, weights_left = weights_left, total - (taken or 0.0), weight - (gone or 0.0)
        if weights_left == before:
            break
    reached = F.lit(left) * F.col("weight") / F.lit(weights_left) if weights_left > 0 else F.col("full")
    return rows.select("source", "source_size", F.least("full", reached).alias("target"))


def _unit(seed: str):
    """A number in [0, 1) from seed and id, with 52 bits."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
) -> DataFrame:
    """One row per input row: row (all input columns), size, source_size, target and copies.

    A null text has size 0; a null source is a source of its own, last in order; rows without an id
    share one draw, as do repeated rows. A source of size 0 has target 0 and no copies. No document
    is copied more than ceil(most) times. No input rows give no rows.
    """
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    sized = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    targets = source_targets(sized, weights, share, most).select(F.col("source").alias("s"), "source_size", "target")
    n, length = targets.agg(F.count(F.lit(1)), F.sum(F.octet_length("s"))).first()
    same = F.col("source").eqNullSafe(F.col("s"))
    if n <= BROADCAST_SOURCES and (length or 0) <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(targets), same)
    else:
        salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("own_salt", F.pmod(F.xxhash64("id", "size"), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, same & (F.col("own_salt") == F.col("salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + F.when(_unit(seed) < rate - whole, 1).otherwise(0)).cast("int")
    return rows.select("row", "id", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as its rate and its draw say.

    Nulls, repeated rows and ties as in mix_plan; an empty table gives no rows.
    """
    return (
        mix_plan(docs, **options).where("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
    )
