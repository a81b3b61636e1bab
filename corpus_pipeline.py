"""A corpus from documents to tokens: quality rules, line dedup, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the
columns of documents; a text that a stage has changed has its n_chars counted anew.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.bpe import bpe_round_trip
from lodeseek.llm.common import fresh_path, read_table, word_count
from lodeseek.llm.jaccard import ngram_jaccard_join, row_mark
from lodeseek.llm.line_dedup import line_dedup
from lodeseek.llm.mixing import mix
from lodeseek.llm.quality import quality_filter, train


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_filter(docs, train(docs, read_table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three lines; one that had words and keeps none goes."""
    rows = line_dedup(docs).where((F.col("n_removed") == 0) | (word_count(F.col("clean")) > 0))
    changed = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; repeated rows of it stay once."""
    stays = ngram_jaccard_join(docs).where("stays").select("mark").distinct()
    marked = docs.withColumn("mark", row_mark(F.col("doc_id"), F.col("text")))
    return marked.join(stays, "mark", "left_semi").dropDuplicates(["mark"]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with digests of the ids and of the text they decode to."""
    return bpe_round_trip(docs, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: SQL cannot express the trained model of the first stage; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
