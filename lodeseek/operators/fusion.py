"""Fusion of ranked channels, penalties and boosts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions import text as X

#: Fixed values of the ranking.
RRF_K = 60
NAME_WEIGHT = 1.0
PROSE_WEIGHT = 1.0
SHADOW_PENALTY = 0.5
NAMED_BOOST = 4.0
CHANNELS = ("vector", "body", "name", "prose")


def allowed(roles: Column, user_roles: list[str] | None) -> Column:
    """Whether a caller may see what has these roles (S1): no roles, or one in common. None is an anonymous caller."""
    free = F.size(F.coalesce(roles, F.array().cast("array<string>"))) == 0
    if user_roles is None:
        return free
    return free | F.arrays_overlap(roles, F.array(*[F.lit(r) for r in sorted(user_roles)]).cast("array<string>"))


def vector_ranks(distances: DataFrame, visible: DataFrame, max_distance: float = 2.0) -> DataFrame:
    """qid, channel, ordinal, rank (from 0) of visible objects by distance (S3)."""
    near = distances.where(F.col("distance") <= max_distance).join(visible.select("ordinal"), "ordinal", "left_semi")
    order = Window.partitionBy("qid").orderBy("distance", "ordinal")
    return near.select("qid", F.lit("vector").alias("channel"), "ordinal", (F.row_number().over(order) - 1).alias("rank"))


def lexical_ranks(scores: DataFrame, visible: DataFrame) -> DataFrame:
    """qid, channel (the field), ordinal, rank of visible objects with a score over 0."""
    hits = scores.where("score > 0").join(visible.select("ordinal"), "ordinal", "left_semi")
    order = Window.partitionBy("qid", "field").orderBy(F.desc("score"), "ordinal")
    return hits.select("qid", F.col("field").alias("channel"), "ordinal", (F.row_number().over(order) - 1).alias("rank"))


def fuse(ranks: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """qid, ordinal, score and the channels: weighted reciprocal ranks, added in the order of CHANNELS (S5). Scores of 0 are dropped."""
    w = {c: 1.0 for c in CHANNELS} | {"name": NAME_WEIGHT, "prose": PROSE_WEIGHT} | (weights or {})
    parts = {c: F.sum(F.when(F.col("channel") == c, F.lit(float(w[c])) / (F.lit(RRF_K + 1) + F.col("rank")))) for c in w}
    fused = ranks.groupBy("qid", "ordinal").agg(*[p.alias(c) for c, p in parts.items()])
    score = F.lit(0.0)
    for c in parts:
        score = score + F.coalesce(F.col(c), F.lit(0.0))
    return fused.select("qid", "ordinal", score.alias("score"), *[F.col(c).isNotNull().alias(f"in_{c}") for c in parts]).where("score <> 0")


def tokens_of(rows: DataFrame, text: str, kept: str) -> Column:
    """Tokens of a text column, or those that the rows have already."""
    return F.col(kept) if kept in rows.columns else X.tokenize(F.col(text))


def named_objects(questions: DataFrame, visible: DataFrame) -> DataFrame:
    """qid, ordinal of visible objects that a question names, without those whose name begins that of another one."""
    q = questions.select("qid", tokens_of(questions, "question", "tokens").alias("tokens"))
    names = visible.select("ordinal", tokens_of(visible, "name", "name_tokens").alias("name_tokens")).where(F.size("name_tokens") > 0)
    # A named object's first token is in the question: an equi-join, not all questions by all objects.
    words = q.select("qid", "tokens", F.explode(F.array_distinct("tokens")).alias("first"))
    hits = words.join(names.withColumn("first", F.element_at("name_tokens", 1)), "first").where(X.named_in(F.col("tokens"), F.col("name_tokens")))
    hits = hits.select("qid", "ordinal", "name_tokens", "first")
    longer = hits.select("qid", "first", F.col("name_tokens").alias("longer"))
    begins = (F.size("longer") > F.size("name_tokens")) & (F.slice("longer", F.lit(1), F.size("name_tokens")) == F.col("name_tokens"))
    covered = hits.join(longer, ["qid", "first"]).where(begins).select("qid", "ordinal").distinct()
    return hits.select("qid", "ordinal").join(covered, ["qid", "ordinal"], "left_anti")


def adjust(fused: DataFrame, visible: DataFrame, shadows: DataFrame, objects: DataFrame, questions: DataFrame) -> DataFrame:
    """fused with the penalty of shadows and the boost of named objects.

    shadows has ordinal and base (a qname, or a bare stem). A shadow is penalised if its base is visible or
    not in the catalog at all, unless the question names it.
    """
    named_any = F.coalesce(F.col("named_any"), F.lit(False))
    best = named_objects(questions, visible).withColumn("best", F.lit(True))
    q = questions.select("qid", tokens_of(questions, "question", "tokens").alias("tokens"))
    known = objects.select(F.col("qname").alias("base"), F.lit(True).alias("known"))
    seen = visible.select(F.col("qname").alias("base"), F.lit(True).alias("seen"))
    bases = shadows.join(known, "base", "left").join(seen, "base", "left")
    bases = bases.select("ordinal", (F.col("seen").isNotNull() | F.col("known").isNull()).alias("demoted"))
    rows = fused.join(visible.select("ordinal", tokens_of(visible, "name", "name_tokens").alias("name_tokens")), "ordinal").join(q, "qid")
    rows = rows.withColumn("named_any", X.named_in(F.col("tokens"), F.col("name_tokens"))).drop("tokens", "name_tokens")
    rows = rows.join(bases, "ordinal", "left").join(best, ["qid", "ordinal"], "left")
    score = F.col("score") * F.when(F.coalesce("demoted", F.lit(False)) & ~named_any, SHADOW_PENALTY).otherwise(1.0)
    score = score * F.when(F.col("best").isNotNull(), NAMED_BOOST).otherwise(1.0)
    return rows.withColumn("score", score).drop("named_any", "demoted", "best")


def ranked(scored: DataFrame) -> DataFrame:
    """scored with its place, from 1, by score and then ordinal."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "ordinal")
    return scored.withColumn("place", F.row_number().over(order))


def reason(in_vector: Column, in_body: Column) -> Column:
    """hybrid if both channels ranked it, vector if that one did, else lexical."""
    return F.when(in_vector & in_body, "hybrid").when(in_vector, "vector").otherwise("lexical")
