"""More queries of the engine's operators over whole tables, and their DuckDB SQL: catalogs and questions that are made from tables, the store, streams, functions and files."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions import text as X
from lodeseek.functions import user
from lodeseek.functions.vectors import CallableEmbedder
from lodeseek.model import FIELDS, OBJECTS
from lodeseek.operators import fusion, graph, lexical, sampling, store
from lodeseek.operators.select import expand_glossary
from lodeseek.plans.engine_queries import FOLD, QUESTION_SQL, QUESTIONS, TABLES, TOKENS, _bm25_sql, read
from lodeseek.session import fresh_path
from lodeseek.sources.files import read_files, write_files
from lodeseek.sources.reflect import reflect_parquet
from lodeseek.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


# A catalog with an object for each part, in three schemas (one of them null). The last digit of the key tells
# what it is: 7 a copy by suffix, 8 one by prefix, 9 a partition (each of the part three before), 3 a backup
# whose base is gone, any other a table of its own.

_K = "p_partkey"
_NAME = f"""CASE {_K} % 10 WHEN 7 THEN 'item' || ({_K} - 3) || '_bkp' WHEN 8 THEN 'stg_item' || ({_K} - 3) WHEN 9 THEN 'item' || ({_K} - 3) || '_2026_07'
WHEN 3 THEN 'gone' || {_K} || '_bak_20260101' ELSE 'item' || {_K} END"""
_SCHEMA = f"CASE WHEN {_K} % 3 <> 0 THEN 's' || ({_K} % 3) END"


def _parts(spark, sf_dir) -> DataFrame:
    half = "CAST(floor(p_partkey / 2) AS BIGINT)"
    col = lambda name, pk: f"named_struct('name', {name}, 'type', 'int', 'nullable', true, 'comment', CAST(NULL AS STRING), 'pk', {pk}, 'roles', CAST(NULL AS ARRAY<STRING>), 'values', CAST(NULL AS ARRAY<STRING>))"
    key = lambda name, ref: f"named_struct('columns', array({name}), 'ref_table', {ref}, 'ref_columns', array('id'), 'inferred', false)"
    parent, hub = f"concat('item', {half}, '_id')", "concat('item', CAST(floor(p_partkey / 10) AS BIGINT))"
    columns = f"array({col(repr('id'), 'true')}, {col(parent, 'false')}, {col(chr(39) + 'fk_item' + chr(39) + ' || (p_partkey - 3)', 'false')}, {col(repr('hub'), 'false')})"
    keys = f"CASE WHEN p_partkey % 5 = 0 THEN array({key(repr('hub'), hub)}, {key(parent, f'concat({chr(39)}item{chr(39)}, {half})')}) ELSE array({key(repr('hub'), hub)}) END"
    rows = read(spark, sf_dir, "part").selectExpr(
        f"{_K} AS ordinal", f"{_NAME} AS name", f"{_SCHEMA} AS schema", "'TABLE' AS kind", "CAST(NULL AS STRING) AS description", "CAST(NULL AS STRING) AS hint",
        f"{columns} AS columns", f"{keys} AS foreign_keys", "CAST(NULL AS BIGINT) AS row_estimate", "CAST(NULL AS STRING) AS definition",
        "CAST(NULL AS ARRAY<STRING>) AS roles", "CAST(NULL AS MAP<STRING, STRING>) AS extra",
    )
    return spark.createDataFrame([], OBJECTS).unionByName(rows)


_PARTS_SQL = f"""WITH o AS (SELECT {_K} AS ordinal, {_NAME} AS name, {_SCHEMA} AS schema, p_partkey // 2 AS half, p_partkey // 10 AS hub FROM part),
c AS (SELECT *, coalesce(schema || '.', '') || name AS q FROM o)"""


@query("parts_fk_infer", _PARTS_SQL + """, keys AS (SELECT ordinal, name, q, schema, name AS v FROM c UNION SELECT ordinal, name, q, schema, split_part(name, '_', -1) FROM c WHERE contains(name, '_')),
cols AS (SELECT ordinal, schema, 1 AS pos, 'item' || half || '_id' AS col, 'item' || half AS stem FROM c WHERE ordinal % 5 <> 0
UNION ALL SELECT ordinal, schema, 2, 'fk_item' || (ordinal - 3), 'item' || (ordinal - 3) FROM c),
hits AS (SELECT cols.ordinal, pos, col, count(DISTINCT q) AS n, min(keys.ordinal) AS t, min(name) AS name FROM cols JOIN keys ON keys.schema IS NOT DISTINCT FROM cols.schema AND v = stem GROUP BY 1, 2, 3)
SELECT ordinal, col AS key_column, name AS target FROM hits WHERE n = 1 AND t <> ordinal""")
def parts_fk_infer(spark, sf_dir):
    """Joins that are not declared (G1): a staging copy or another schema makes a key ambiguous or unknown."""
    found = graph.infer_foreign_keys(_parts(spark, sf_dir))
    return found.select("ordinal", F.col("column").alias("key_column"), F.col("ref_table").alias("target"))


@query("parts_dimensions", _PARTS_SQL + """, refs AS (SELECT ordinal AS source, 'item' || hub AS ref FROM c UNION SELECT ordinal, 'item' || half FROM c WHERE ordinal % 5 = 0),
hits AS (SELECT source, ref, min(c.ordinal) AS ordinal FROM refs JOIN c ON name = ref AND c.ordinal <> source GROUP BY 1, 2)
SELECT ordinal, count(*) AS in_degree FROM hits GROUP BY 1 HAVING count(*) >= 2""")
def parts_dimensions(spark, sf_dir):
    return graph.dimensions(_parts(spark, sf_dir)).select("ordinal", "in_degree")


@query("parts_shadows", _PARTS_SQL + f""", s AS (SELECT unnest([{", ".join(repr(x) for x in graph.SHADOW_SUFFIXES)}]) AS suffix), p AS (SELECT unnest([{", ".join(repr(x) for x in graph.SHADOW_PREFIXES)}]) AS prefix),
suffixed AS (SELECT c.ordinal, b.q AS base FROM c JOIN s ON ends_with(c.name, suffix) JOIN c b ON b.schema IS NOT DISTINCT FROM c.schema AND b.name = left(c.name, length(c.name) - length(suffix))),
prefixed AS (SELECT c.ordinal, min(b.q) AS base FROM c JOIN p ON starts_with(c.name, prefix) JOIN c b ON b.schema IS NOT DISTINCT FROM c.schema AND b.name = substr(c.name, length(prefix) + 1) GROUP BY 1),
parted AS (SELECT c.ordinal, b.q AS base FROM c JOIN c b ON b.schema IS NOT DISTINCT FROM c.schema AND regexp_matches(c.name, '_[0-9]{{4}}_[0-9]{{2}}$') AND b.name = regexp_replace(c.name, '_[0-9]{{4}}_[0-9]{{2}}$', '')),
kept AS (SELECT ordinal, regexp_replace(name, '_bak_[0-9]{{8}}$', '') AS base FROM c WHERE regexp_matches(name, '_bak_[0-9]{{8}}$'))
SELECT * FROM suffixed UNION ALL SELECT * FROM prefixed UNION ALL SELECT * FROM parted UNION ALL SELECT * FROM kept""")
def parts_shadows(spark, sf_dir):
    """Copies by suffix and prefix, partitions and backups."""
    return graph.shadows(_parts(spark, sf_dir)).select("ordinal", "base")


# Texts of objects and questions


@query("object_texts", f"""WITH c AS (SELECT table_name AS name, ordinal_position AS k, column_name AS c FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)}))
SELECT name, concat_ws(' ' || chr(10), replace(name, '_', ' '), name, string_agg(replace(c, '_', ' '), ' ' || chr(10) ORDER BY k)) AS body, name || ' ' || replace(name, '_', ' ') AS name_text FROM c GROUP BY name""")
def object_texts(spark, sf_dir):
    """The indexed texts of the tables as they are reflected, columns in order."""
    rows = [tuple({"ordinal": k, **o}[f.split(" ")[0]] for f in "ordinal,name,schema,kind,description,hint,columns,foreign_keys,row_estimate,definition,roles,extra".split(",")) for k, o in enumerate(reflect_parquet(spark, sf_dir, TABLES))]
    rows = spark.createDataFrame(rows, OBJECTS).withColumn("schema", F.lit(None).cast("string"))
    return rows.select("name", FIELDS["body"]().alias("body"), FIELDS["name"]().alias("name_text"))


@query("reflect_columns", f"""SELECT table_name AS name, column_name AS column, ordinal_position::INT AS place,
CASE WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'int' WHEN data_type = 'DOUBLE' THEN 'double' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' ELSE 'array' END AS type
FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)})""")
def reflect_columns(spark, sf_dir):
    """Columns, their order and types, of all tables."""
    rows = [(o["name"], c["name"], k, c["type"].split("<")[0].replace("timestamp_ntz", "timestamp")) for o in reflect_parquet(spark, sf_dir, TABLES) for k, c in enumerate(o["columns"], 1)]
    return spark.createDataFrame(rows, "name string, column string, place int, type string")


@query("sample_candidates_own_rule", f"""SELECT table_name AS name, column_name AS column FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)}) AND data_type = 'VARCHAR'
AND NOT contains(column_name, 'text') AND NOT contains(column_name, 'url')""")
def sample_candidates_own_rule(spark, sf_dir):
    """Which columns may be sampled when the caller gives fragments of names of its own (V4)."""
    rows = [(o["name"], c["name"], c["type"], bool(c["pk"])) for o in reflect_parquet(spark, sf_dir, TABLES) for c in o["columns"]]
    rows = spark.createDataFrame(rows, "name string, column string, type string, pk boolean")
    free = F.lit(None).cast("array<string>")
    return rows.where(sampling.is_candidate(F.col("column"), F.col("type"), F.col("pk"), free, ("text", "url"))).select("name", "column")


_CJK_FROM, _CJK_TO = "aeiou", "売上明細東"
_CJK = f"translate(coalesce(text, ''), '{_CJK_FROM}', '{_CJK_TO}')"
_CJK_RUN = "regexp_matches(r, '[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]')"


@query("tokenize_cjk", f"""WITH r AS (SELECT item_id, regexp_extract_all(lower(regexp_replace({_CJK}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[\\p{{L}}\\p{{N}}]+') AS runs FROM benchmark)
SELECT item_id, md5(array_to_string(flatten(list_transform(runs, lambda r: CASE WHEN {_CJK_RUN} THEN list_concat(string_split(r, ''), list_transform(range(1, length(r)), lambda i: r[i:i + 1])) ELSE [{FOLD.format('r')}] END)), ' ')) AS tokens_md5 FROM r""")
def tokenize_cjk(spark, sf_dir):
    """Texts whose vowels are made Chinese characters: runs with one give single characters, then pairs."""
    text = F.translate(F.coalesce("text", F.lit("")), _CJK_FROM, _CJK_TO)
    return read(spark, sf_dir, "benchmark").select("item_id", F.md5(F.array_join(X.tokenize(text), " ")).alias("tokens_md5"))


@query("named_in", f"""WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents), n AS (SELECT doc_id, t, CASE WHEN doc_id % 2 = 0 THEN t[3:4] ELSE list_reverse(t[3:4]) END AS name FROM t)
SELECT doc_id, len(name) > 0 AND contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(name, ' ') || ' ') AS named FROM n""")
def named_in(spark, sf_dir):
    """Whether the third and fourth word of a text, turned round for odd ids, stand next to one another in it."""
    rows = read(spark, sf_dir, "documents").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    two = F.slice("t", 3, 2)
    return rows.select("doc_id", X.named_in(F.col("t"), F.when(F.col("doc_id") % 2 == 0, two).otherwise(F.reverse(two))).alias("named"))


_IDENT = "list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*'), lambda w: length(w) >= 3 AND NOT list_contains(keywords, lower(w)))"


@query("text_identifiers", f"""WITH k AS (SELECT [{", ".join(f"'{w}'" for w in sorted(set(X.KEYWORDS)))}] AS keywords), w AS (SELECT item_id, {_IDENT} AS w FROM benchmark, k),
f AS (SELECT item_id, list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i) AS w FROM w)
SELECT item_id, left(array_to_string(flatten(list_transform(w, lambda x: [replace(x, '_', ' '), x])), ' '), 1200) AS identifiers FROM f""")
def text_identifiers(spark, sf_dir):
    """Identifiers of texts as of view SQL: each once, spaced and as it stands, up to the limit."""
    return read(spark, sf_dir, "benchmark").select("item_id", X.identifiers(F.col("text")).alias("identifiers"))


@query("parse_choice", r"""WITH r AS (SELECT conv_id, turn, list_filter(regexp_extract_all(coalesce(text, ''), '[\w.]+'), lambda x: regexp_matches(x, '^[0-9]{1,9}(\.|$)')) AS r FROM conversations),
n AS (SELECT conv_id, turn, list_filter(list_transform(r, lambda x: regexp_extract(x, '^[0-9]+')::BIGINT), lambda x: x BETWEEN 1 AND 20) AS n FROM r),
d AS (SELECT conv_id, turn, list_filter(n, lambda x, i: list_position(n, x) = i)[1:5] AS d FROM n) SELECT conv_id, turn, coalesce(array_to_string(d, ','), '') AS choice FROM d""")
def parse_choice(spark, sf_dir):
    """Numbers that a reply chooses, in its order."""
    rows = read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.array_join(X.parse_choice(F.col("text"), F.lit(20), F.lit(5)).cast("array<string>"), ",").alias("choice"))


_TERMS_SQL = r"""t AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), terms AS (SELECT w[1] AS term, 'm' || item_id AS meaning FROM t WHERE regexp_full_match(w[1], '[A-Za-z]+')
UNION ALL SELECT w[2] || ' ' || w[3], 'n' || item_id FROM t WHERE regexp_full_match(w[2], '[A-Za-z]+') AND regexp_full_match(w[3], '[A-Za-z]+'))"""


@query("benchmark_glossary", f"""WITH {_TERMS_SQL}, q AS (SELECT item_id, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM benchmark),
runs AS (SELECT DISTINCT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1]))) AS key FROM q),
hits AS (SELECT DISTINCT item_id, term, meaning FROM runs JOIN terms ON lower(replace(term, ' ', '')) = key), more AS (SELECT item_id, string_agg(meaning, ' ' ORDER BY term, meaning) AS more FROM hits GROUP BY 1)
SELECT q.item_id AS qid, md5(concat_ws(' ', text, more)) AS question_md5 FROM q LEFT JOIN more USING (item_id)""")
def benchmark_glossary(spark, sf_dir):
    """Benchmark texts with the meanings of terms that are words, and pairs of words, of all of them."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", "text", F.split("text", " ").alias("w"))
    is_word = lambda i: F.get("w", F.lit(i)).rlike("^[A-Za-z]+$")
    one = rows.where(is_word(0)).select(F.get("w", F.lit(0)).alias("term"), F.concat(F.lit("m"), "item_id").alias("meaning"))
    two = rows.where(is_word(1) & is_word(2)).select(F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(2))).alias("term"), F.concat(F.lit("n"), "item_id").alias("meaning"))
    asked = expand_glossary(rows.select(F.col("item_id").alias("qid"), F.col("text").alias("question")), one.unionByName(two))
    return asked.select("qid", F.md5("question").alias("question_md5"))


# Vectors, store and fusion


@query("callable_embed", "SELECT p_partkey, length(p_name)::DOUBLE AS x, (length(p_name) - length(replace(p_name, 'e', '')))::DOUBLE AS y FROM part")
def callable_embed(spark, sf_dir):
    """Vectors from a caller's own function, each text sent once (E5)."""
    own = CallableEmbedder(lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts], 2, normalise=False)
    rows = own.embed_column(read(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_name"))
    return rows.select("p_partkey", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


@query("store_rows", """WITH e AS (SELECT vec_id, label::VARCHAR AS ns, embedding[1]::DOUBLE AS first FROM embeddings)
SELECT ns, vec_id::VARCHAR AS key, round(CASE WHEN vec_id % 3 = 0 THEN first * 2 ELSE first END, 6) AS first, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS state, CASE WHEN vec_id % 2 = 1 THEN 's' END AS scope
FROM e WHERE ns <> (SELECT min(ns) FROM e)""")
def store_rows(spark, sf_dir):
    """Vectors written to a store, a third of them written anew, and one namespace purged."""
    e = read(spark, sf_dir, "embeddings")
    rows = e.select(
        F.col("label").cast("string").alias("ns"), F.col("vec_id").cast("string").alias("key"), F.col("embedding").cast("array<double>").alias("vec"),
        F.create_map(F.lit("state"), F.lit("old")).alias("payload"), F.when(F.col("vec_id") % 2 == 1, "s").alias("scope"), "vec_id",
    )
    s = store.ParquetStore(spark, fresh_path(spark, "store"))
    s.upsert(rows)
    twice = F.transform("vec", lambda x: x * 2)
    s.upsert(rows.where("vec_id % 3 = 0").withColumns({"vec": twice, "payload": F.create_map(F.lit("state"), F.lit("new"))}))
    s.purge(rows.agg(F.min("ns")).first()[0])
    return s.rows().select("ns", "key", F.round(F.col("vec")[0], 6).alias("first"), F.col("payload")["state"].alias("state"), "scope")


@query("store_counts", """SELECT label::VARCHAR AS ns, count(*) AS n, count(*) FILTER (WHERE vec_id % 2 = 0) AS free FROM embeddings GROUP BY 1""")
def store_counts(spark, sf_dir):
    """Counts of each namespace of a store, in a scope and without (K4)."""
    rows = read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("ns"), F.col("vec_id").cast("string").alias("key"), F.col("embedding").cast("array<double>").alias("vec"),
        F.lit(None).cast("map<string,string>").alias("payload"), F.when(F.col("vec_id") % 2 == 1, "s").alias("scope"),
    )
    s = store.ParquetStore(spark, fresh_path(spark, "store"), buckets=4)
    s.upsert(rows)
    names = [r["ns"] for r in s.rows().select("ns").distinct().collect()]
    return spark.createDataFrame([(n, s.count(n, "s"), s.count(n)) for n in names], "ns string, n long, free long")


_VECTOR_SQL = """, near AS (SELECT q.vec_id // 100 AS qid, e.vec_id AS doc_id, round(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id // 100 BETWEEN 1 AND 4),
r AS (SELECT qid, field, doc_id, row_number() OVER (PARTITION BY qid, field ORDER BY score DESC, doc_id) - 1 AS rank FROM scores WHERE score > 0
UNION ALL SELECT qid, 'vector', doc_id, row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id) - 1 FROM near WHERE distance <= 2),
f AS (SELECT qid, doc_id, coalesce(sum(1.0 / (61 + rank)) FILTER (WHERE field = 'vector'), 0) + coalesce(sum(1.0 / (61 + rank)) FILTER (WHERE field = 'body'), 0) AS score FROM r GROUP BY 1, 2)
SELECT qid, doc_id, round(score, 9) AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS INT) AS place FROM f) WHERE place <= 50"""


@query("rrf_vector", _bm25_sql(QUESTION_SQL, {"body": "source"}) + _VECTOR_SQL)
def rrf_vector(spark, sf_dir):
    """The vector and a lexical channel fused (S3, S4, S5, S8): the question n goes with the vector of id 100 n."""
    docs, e = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    questions = spark.createDataFrame(QUESTIONS, "qid int, question string")
    index = lexical.build_index(docs, {"body": F.col("source")}, "doc_id", only=lexical.question_words(questions).select("term").distinct())
    free = F.lit(None).cast("string")
    asked = e.where("vec_id % 100 = 0 AND vec_id div 100 BETWEEN 1 AND 4").select(F.expr("CAST(vec_id div 100 AS INT)").alias("qid"), F.col("embedding").alias("qvec"), free.alias("qscope"))
    near = store.all_distances(asked, e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), free.alias("scope")), places=6).withColumnRenamed("key", "ordinal")
    scores = lexical.bm25_scores(questions, index).withColumn("score", F.round("score", 6))
    every = docs.select(F.col("doc_id").alias("ordinal")).union(e.select("vec_id")).distinct()
    ranks = fusion.vector_ranks(near, every).unionByName(fusion.lexical_ranks(scores, every))
    fused = fusion.fuse(ranks).withColumn("score", F.round("score", 9))
    return fusion.ranked(fused).where("place <= 50").select("qid", F.col("ordinal").alias("doc_id"), "score", "place")


@query("rank_adjust", """WITH n AS (SELECT n_nationkey AS k, n_nationkey % 6 <> 5 AS seen FROM nation), q AS (SELECT r_regionkey AS qid FROM region),
f AS (SELECT qid, k, 1.0::DOUBLE / (61 + (k * 7 + qid * 3) % 25) AS score, k = qid OR k = 10 + qid AS named, (k % 4 = 1 AND (k - 1) % 6 <> 5) OR k % 4 = 3 AS demoted FROM n, q WHERE seen)
SELECT qid, k AS ordinal, round(score * CASE WHEN demoted AND NOT named THEN 0.5 ELSE 1 END * CASE WHEN named THEN 4 ELSE 1 END, 9) AS score FROM f""")
def rank_adjust(spark, sf_dir):
    """Copies lose, named objects gain (S6, S7): nations as objects, of which some are hidden, some copies of the one before, some of one that is gone."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("ordinal"), F.col("n_name").alias("name"), F.col("n_name").alias("qname"))
    visible = n.where("ordinal % 6 <> 5")
    copies = n.where("ordinal % 4 IN (1, 3)").select("ordinal", F.when(F.col("ordinal") % 4 == 1, F.concat(F.lit("NATION_"), F.col("ordinal") - 1)).otherwise(F.concat(F.lit("GONE_"), "ordinal")).alias("base"))
    r = F.col("r_regionkey")
    asked = read(spark, sf_dir, "region").select(r.alias("qid"), F.concat(F.lit("sales of nation "), r, F.lit(" and Nation_1"), r).alias("question"))
    fused = visible.join(F.broadcast(asked)).select("qid", "ordinal", (F.lit(1.0) / (61 + (F.col("ordinal") * 7 + F.col("qid") * 3) % 25)).alias("score"))
    return fusion.adjust(fused, visible, copies, n, asked).select("qid", "ordinal", F.round("score", 9).alias("score"))


# Streams


def _stream(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark, rows: DataFrame, mode: str = "complete") -> DataFrame:
    return windows.run_once(rows, fresh_path(spark, "stream"), fresh_path(spark, "stream-state"), mode)


def _wall(name: str, more: str = "") -> Column:
    """A time as the clock of the table has it, whatever the zone of the session."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss" + more).alias(name)


def _totals() -> dict:
    return {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)}


@query("stream_tumbling", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS since, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """Events of each hour and type, from a stream."""
    rows = windows.windowed(_stream(spark, sf_dir), _totals(), "1 hour", by=("event_type",))
    return _run(spark, rows).select(_wall("since"), "event_type", "n", "total")


@query("stream_sliding", """WITH e AS (SELECT *, unnest([0, 1, 2]) AS k FROM events), w AS (SELECT strftime(time_bucket(INTERVAL '20 minutes', ts) - to_minutes(k * 20), '%Y-%m-%d %H:%M:%S') AS since, value FROM e)
SELECT since, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1""")
def stream_sliding(spark, sf_dir):
    """Events of each hour, every 20 minutes: each event is in three windows."""
    rows = windows.windowed(_stream(spark, sf_dir), _totals(), "1 hour", "20 minutes")
    return _run(spark, rows).select(_wall("since"), "n", "total")


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, value, ts >= lag(ts) OVER w + INTERVAL '2 hours' OR lag(ts) OVER w IS NULL AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS since, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    """Sessions of users that end after two hours without an event, from a stream."""
    rows = windows.sessions(_stream(spark, sf_dir), _totals(), "2 hours", ("user_id",))
    return _run(spark, rows).select("user_id", _wall("since", ".SSSSSS"), "n", "total")


@query("stream_without_repeats", "SELECT DISTINCT user_id, event_type FROM events")
def stream_without_repeats(spark, sf_dir):
    """The users and types of events, each once, from a stream whose watermark is longer than the data."""
    rows = windows.without_repeats(_stream(spark, sf_dir), ["user_id", "event_type"], late="100 days").select("user_id", "event_type")
    return _run(spark, rows, "append").select("user_id", "event_type")


# Functions, maps and files


@query("udf_scalar", "SELECT p_partkey, reverse(p_name) AS turned FROM part")
def udf_scalar(spark, sf_dir):
    """A caller's own function over Arrow batches, in SQL."""
    import pyarrow.compute as pc

    user.register_scalar(spark, "turned", lambda names: pc.utf8_reverse(names), "string")
    read(spark, sf_dir, "part").createOrReplaceTempView("udf_part")
    return spark.sql("SELECT p_partkey, turned(p_name) AS turned FROM udf_part")


@query("udtf_rows", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(range(len(string_split(p_name, ' '))))::INT AS place FROM part")
def udtf_rows(spark, sf_dir):
    """A caller's own table function, joined to each row."""
    user.register_rows(spark, "words_of", lambda name: ((w, k) for k, w in enumerate(name.split(" "))), "word string, place int")
    read(spark, sf_dir, "part").createOrReplaceTempView("udf_part")
    return spark.sql("SELECT p_partkey, w.word, w.place FROM udf_part, LATERAL words_of(p_name) w")


@query("map_counts", """SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE event_type = 'click') AS clicks, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events GROUP BY 1""")
def map_counts(spark, sf_dir):
    """Counts of each user's events as a map, and what is read from it."""
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.size("m").cast("long").alias("kinds"), F.coalesce(F.col("m")["click"], F.lit(0)).cast("long").alias("clicks"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"))


@query("scan_formats", """SELECT f AS format, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer, (SELECT unnest(['parquet', 'orc', 'json', 'csv']) AS f)""")
def scan_formats(spark, sf_dir):
    """A table written in each format and read again."""
    rows, out = read(spark, sf_dir, "customer"), None
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    for kind in ("parquet", "orc", "json", "csv"):
        path = f"{fresh_path(spark, 'scan')}.{kind}"
        write_files(rows, path)
        back = read_files(spark, path, schema=schema).select(F.lit(kind).alias("format"), *rows.columns)
        out = back if out is None else out.unionByName(back)
    return out
