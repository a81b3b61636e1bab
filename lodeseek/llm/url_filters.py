"""URL filters by a temporal list join.

Dated entries of lists (a key is added or removed at a time) become validity intervals, and every capture
is evaluated against the entries that are active when it was fetched. A key is a domain, which covers its
subdomains, or a host with a path, which covers all paths below it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import materialise

#: Intervals are broadcast up to these bounds; beyond them the join is a shuffle that can be split.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port or a last full stop; empty if there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit(""))), r"\.$", "")


def lookup_keys(url: Column) -> Column:
    """All keys that cover a URL: d: and each suffix of the host, p: and the host with each prefix of the path."""
    host, path = host_of(url), F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    paths = F.when(
        F.size(parts) > 0,
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(domains, paths)).otherwise(F.array().cast("array<string>"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """list, key, verdict, since, until of entries (list, key, verdict, at, action add or remove).

    An entry holds until the next one of its list and key, or for ever. Of entries of the same time the
    removal counts, else the verdict that is last by name. Entries without key, time or action are left out.
    """
    dated = entries.where("key IS NOT NULL AND at IS NOT NULL AND action IS NOT NULL")
    dated = dated.groupBy("list", "key", "at").agg(F.max(F.struct("action", "verdict")).alias("e"))
    turn = Window.partitionBy("list", "key").orderBy("at")
    dated = dated.select("list", "key", "e.action", "e.verdict", F.col("at").alias("since"), F.lead("at").over(turn).alias("until"))
    return dated.where("action = 'add'").drop("action")


def url_filter(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """One row per capture: row (all its columns), n_active, matched (key) and blocked.

    Of the active entries that cover a capture the longest key decides, a path before a domain; of equal
    keys, allow before block, then the list that is first by name. A capture is blocked if that entry's
    verdict is block. Without url or time nothing is active. Repeated captures get the same verdict.
    """
    spans = validity_intervals(entries)
    n, size = spans.agg(F.count(F.lit(1)), F.sum(F.octet_length("key") + F.coalesce(F.octet_length("list"), F.lit(0)) + 64)).first()
    if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES:
        spans = F.broadcast(spans)
    seen = captures.select(F.col(url_col).alias("u"), F.col(time_col).alias("t")).where("u IS NOT NULL AND t IS NOT NULL").distinct()
    looked = seen.select("u", "t", F.explode(lookup_keys(F.col("u"))).alias("key"))
    active = looked.join(spans, "key").where("since <= t AND (until IS NULL OR t < until)")
    rank = F.struct(F.when(F.col("key").startswith("p:"), 0).otherwise(1).alias("kind"), (-F.length("key")).alias("length"), "verdict", "list", "key")
    verdicts = active.groupBy("u", "t").agg(F.count(F.lit(1)).alias("n_active"), F.min(rank).alias("top"))
    verdicts = materialise(verdicts.select("u", "t", "n_active", "top.key", "top.verdict"), "op8-verdicts")
    rows = captures.select(F.struct("*").alias("row"), F.col(url_col).alias("own_url"), F.col(time_col).alias("own_time"))
    rows = rows.join(verdicts, (F.col("own_url") == F.col("u")) & (F.col("own_time") == F.col("t")), "left")
    return rows.select(
        "row", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("key").alias("matched"),
        F.coalesce(F.col("verdict") == "block", F.lit(False)).alias("blocked"),
    )
