"""The opN queries: each applies its operator to its whole table with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.bpe import bpe_round_trip
from lodeseek.llm.common import fresh_path, read_table
from lodeseek.llm.exact_dedup import exact_dedup
from lodeseek.llm.html_text import extract_text
from lodeseek.llm.jaccard import ngram_jaccard_join
from lodeseek.llm.licences import licence_scan
from lodeseek.llm.line_dedup import line_dedup
from lodeseek.llm.mixing import mix_plan
from lodeseek.llm.quality import quality_rules, train
from lodeseek.llm.url_filters import host_of, url_filter
from lodeseek.llm.warc import read_warc, resolved, write_warc


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    records = resolved(read_warc(write_warc(pages, fresh_path(spark, "warc"))))
    kind = pages.schema["page_id"].dataType
    return records.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(read_table(spark, sf_dir, "documents"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.col("clean").alias("text"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licence_scan(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_known"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"),
    )


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_table(spark, sf_dir, "documents"))


#: Fixed entries of the spam list: name of the domain, day it is added, day it is removed.
SPAM = [
    ("cheap-pills", "2024-01-01", None),
    ("casino-win", "2024-02-01", "2024-09-01"),
    ("ads-track", "2024-03-01", None),
    ("free-bets", "2024-01-15", "2024-06-15"),
    ("adult-x", "2023-06-01", None),
    ("spam-farm", "2024-05-01", "2024-11-01"),
]


def url_list(pages: DataFrame) -> DataFrame:
    """Dated entries: the spam list, and a list of hosts of pages that are blocked for a while, by a hash of the host.

    A seventh of the hosts is blocked, for 90 days from a day of 2024; every third of the others is on an
    allow list from July on.
    """
    spark = pages.sparkSession
    spam = []
    for name, since, until in SPAM:
        for zone in ("com", "net", "org"):
            spam.append(("spam", f"d:{name}.example.{zone}", "block", since, "add"))
            if until:
                spam.append(("spam", f"d:{name}.example.{zone}", "block", until, "remove"))
    fixed = spark.createDataFrame(spam, "list string, key string, verdict string, day string, action string")
    fixed = fixed.select("list", "key", "verdict", F.to_timestamp("day").alias("at"), "action")
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    number = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int")
    start = F.lit("2024-01-01").cast("timestamp")
    day = lambda n: start + F.make_dt_interval(n)
    hosts = hosts.select(F.concat(F.lit("d:"), "host").alias("key"), number.alias("n"))
    block = hosts.where("n % 7 = 0").select(
        F.lit("hosts").alias("list"), "key", F.lit("block").alias("verdict"),
        F.explode(F.array(F.struct(day(F.col("n") % 180).alias("at"), F.lit("add").alias("action")), F.struct(day(F.col("n") % 180 + 90).alias("at"), F.lit("remove").alias("action")))).alias("e"),
    ).select("list", "key", "verdict", "e.at", "e.action")
    allow = hosts.where("n % 7 <> 0 AND n % 3 = 0").select(
        F.lit("allowed").alias("list"), "key", F.lit("allow").alias("verdict"), day(F.lit(182)).alias("at"), F.lit("add").alias("action")
    )
    return fixed.unionByName(block).unionByName(allow)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no fetch time: a page counts as fetched page_id % 366 days into 2024."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("page_id") % 366).cast("int"))
    rows = url_filter(pages.withColumn("fetched", fetched), url_list(pages))
    return rows.select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "n_active", "matched", "blocked")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_rules(docs, train(docs, read_table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_line_dedup": op2_line_dedup,
    "op3_licences": op3_licences,
    "op4_html_text": op4_html_text,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_mixing": op6_mixing,
    "op7_bpe": op7_bpe,
    "op8_url_filter": op8_url_filter,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_quality_rules": op10_quality_rules,
}
