"""Queries of the engine's own operators over the tables, and DuckDB SQL for those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions import text as X
from lodeseek.functions.vectors import HashingEmbedder
from lodeseek.model import OBJECTS, column, foreign_key, obj
from lodeseek.operators import access, evaluation, fusion, graph, lexical, sampling, store
from lodeseek.operators.select import Catalog, expand_glossary
from lodeseek.plans.guard import GuardedSession
from lodeseek.session import materialise, spread
from lodeseek.sources.demo import demo_objects
from lodeseek.sources.reflect import matches, reflect_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Text

FOLD = "strip_accents(replace(replace(replace(replace(replace({0}, 'ß', 'ss'), 'ø', 'o'), 'æ', 'ae'), 'đ', 'd'), 'ł', 'l'))"
TOKENS = (
    "list_filter(list_transform(regexp_extract_all(lower(regexp_replace(coalesce({0}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[\\p{{L}}\\p{{N}}]+'), "
    "lambda x: " + FOLD.format("x").replace("{", "{{").replace("}", "}}") + "), lambda x: x <> '')"
)
STEM = (
    "CASE WHEN length({0}) > 4 AND {0} LIKE '%ies' THEN left({0}, -3) || 'y' WHEN length({0}) > 4 AND {0} LIKE '%es' AND {0} NOT LIKE '%ses' THEN left({0}, -2) "
    "WHEN length({0}) > 3 AND {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN left({0}, -1) ELSE {0} END"
)


@query("tokenize_docs", f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)""")
def tokenize_docs(spark, sf_dir):
    rows = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("stem_terms", f"SELECT term, {STEM.format('term')} AS stem, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS term FROM conversations) GROUP BY term")
def stem_terms(spark, sf_dir):
    terms = read(spark, sf_dir, "conversations").select(F.explode(X.tokenize(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn("stem", X.stem(F.col("term")))


@query("expand_joins", f"""SELECT item_id, array_to_string(list_filter(list_transform(range(1, len(t)), lambda i: CASE WHEN regexp_full_match(t[i], '\\p{{L}}+') AND regexp_full_match(t[i + 1], '\\p{{L}}+')
AND length(t[i]) + length(t[i + 1]) <= 14 THEN t[i] || t[i + 1] END), lambda x: x IS NOT NULL), ' ') AS joins FROM (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark)""")
def expand_joins(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select("item_id", X.tokenize(F.col("text")).alias("t"))
    return rows.select("item_id", F.array_join(F.slice(X.expand_joins(F.col("t")), F.size("t") + 1, F.greatest(F.lit(1), F.size("t"))), " ").alias("joins"))


@query("token_estimate", """SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z\\s]'),
lambda p: CASE WHEN regexp_full_match(p, '[A-Za-z]+') THEN greatest(1, round_even(length(p) / 4.0, 0)) ELSE 1 END)), 0)::BIGINT AS tokens FROM documents""")
def token_estimate(spark, sf_dir):
    rows = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("description_checks", """SELECT conv_id, turn, left(text, 0) || trim(string_split(coalesce(text, ''), ' | ')[1]) AS sentence,
trim(coalesce(text, '')) = '' OR (NOT regexp_matches(trim(coalesce(text, '')), '[.!?]$') AND NOT contains(text, '|') AND len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda w: w <> '')) < 12) AS truncated
FROM conversations""")
def description_checks(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", X.sentence(F.col("text")).alias("sentence"), X.looks_truncated(F.col("text")).alias("truncated"))


VIEW_SQL = [
    (1, "SELECT c.cust_id, SUM(o.total_net) AS revenue FROM crm_customer c JOIN sales_order o ON o.cust_id = c.cust_id GROUP BY c.cust_id"),
    (2, "select reorder_point, Reorder_Point, qty FROM inv_stock_level WHERE qty < reorder_point"),
]


@query("view_identifiers", """SELECT * FROM (VALUES (1, 'cust id cust_id total net total_net revenue revenue crm customer crm_customer sales order sales_order'),
(2, 'reorder point reorder_point qty qty inv stock level inv_stock_level')) t(view_id, identifiers)""")
def view_identifiers(spark, sf_dir):
    rows = spark.createDataFrame(VIEW_SQL, "view_id int, sql string")
    return rows.select("view_id", X.identifiers(F.col("sql")).alias("identifiers"))


# Lexical index


def _bm25_sql(questions: str, fields: dict[str, str]) -> str:
    """CTEs up to scores(qid, field, doc_id, score) for questions(qid, question)."""
    parts = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {TOKENS.format(c)} AS t FROM documents" for f, c in fields.items())
    alpha = "regexp_full_match({0}, '\\p{{L}}+')"
    joined = f"list_filter(list_transform(range(1, len(t)), lambda i: CASE WHEN {alpha.format('t[i]')} AND {alpha.format('t[i + 1]')} AND length(t[i]) + length(t[i + 1]) <= 14 THEN t[i] || t[i + 1] END), lambda x: x IS NOT NULL)"
    runs = ", ".join(
        f"list_filter(list_transform(range(1, len(t) - {n} + 2), lambda i: CASE WHEN len(list_filter(t[i:i + {n - 1}], lambda x: NOT {alpha.format('x')})) = 0 THEN array_to_string(list_transform(t[i:i + {n - 1}], lambda x: x[1]), '') END), lambda x: x IS NOT NULL)"
        for n in range(2, 6)
    )
    return f"""WITH d AS ({parts}), lens AS (SELECT field, doc_id, len(t) AS len FROM d), totals AS (SELECT field, count(*) AS n, avg(len) AS avg FROM lens GROUP BY field),
raw AS (SELECT field, doc_id, unnest(t) AS w FROM d), post AS (SELECT field, doc_id, {STEM.format('w')} AS term, count(*) AS tf FROM raw GROUP BY 1, 2, 3),
terms AS (SELECT p.field, term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post p JOIN totals USING (field) GROUP BY p.field, term, n),
q0 AS ({questions}), q AS (SELECT qid, {TOKENS.format('question')} AS t FROM q0),
q1 AS (SELECT qid, t, list_transform(list_concat(t, {joined}), lambda w: {STEM.format('w')}) AS s FROM q),
acr AS (SELECT qid, s, list_distinct(flatten([{runs}])) AS a FROM q1),
qt AS (SELECT qid, unnest(s) AS term FROM q1 UNION ALL SELECT qid, term FROM (SELECT qid, s, unnest(a) AS term FROM acr) WHERE NOT list_contains(s, term)),
scores AS (SELECT qid, p.field, p.doc_id, round(sum(idf * tf * 2.4 / (tf + 1.4 * (1 - 0.72 + 0.72 * len / CASE WHEN avg = 0 THEN 1 ELSE avg END))), 6) AS score
FROM qt JOIN terms USING (term) JOIN post p ON p.field = terms.field AND p.term = qt.term JOIN lens l ON l.field = p.field AND l.doc_id = p.doc_id JOIN totals x ON x.field = p.field GROUP BY 1, 2, 3)"""


QUESTIONS = [(1, "the and of src0"), (2, "de la que src1 es"), (3, "and therhean is the"), (4, "src3 en"), (5, "")]
QUESTION_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ") v(qid, question)"


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.round("score", 6))


@query("idf_table", f"""WITH d AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents), raw AS (SELECT doc_id, unnest(t) AS w FROM d),
p AS (SELECT DISTINCT doc_id, {STEM.format('w')} AS term FROM raw) SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5)), 9) AS idf FROM p GROUP BY term""")
def idf_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return lexical.build_index(docs, {"body": F.col("text")}, "doc_id").terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query("bm25_topk", _bm25_sql("SELECT item_id AS qid, text AS question FROM benchmark", {"body": "text"}) + """ SELECT qid, doc_id, score, rank FROM
(SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores) WHERE rank <= 10""")
def bm25_topk(spark, sf_dir):
    """Every benchmark text as a question against all documents; the ten best of each."""
    asked = read(spark, sf_dir, "benchmark")
    words = materialise(lexical.question_words(asked, "item_id", "text"), "words")
    index = lexical.build_index(read(spark, sf_dir, "documents"), {"body": F.col("text")}, "doc_id", only=words.select("term").distinct())
    top = lexical.bm25_top(asked, index, 10, "item_id", "text", places=6, words=words)
    return top.select("qid", F.col("ordinal").alias("doc_id"), "score", "rank")


FIELDS = {"body": "text", "name": "source", "prose": "lang"}


@query("rrf_hybrid", _bm25_sql(QUESTION_SQL, FIELDS) + """, r AS (SELECT *, row_number() OVER (PARTITION BY qid, field ORDER BY score DESC, doc_id) - 1 AS rank FROM scores WHERE score > 0),
f AS (SELECT qid, doc_id, round(coalesce(sum(1.0 / (61 + rank)) FILTER (WHERE field = 'body'), 0) + coalesce(sum(1.0 / (61 + rank)) FILTER (WHERE field = 'name'), 0) + coalesce(sum(1.0 / (61 + rank)) FILTER (WHERE field = 'prose'), 0), 9) AS score
FROM r GROUP BY 1, 2) SELECT qid, doc_id, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS place FROM f) WHERE place <= 20""")
def rrf_hybrid(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    questions = spark.createDataFrame(QUESTIONS, "qid int, question string")
    only = lexical.question_words(questions).select("term").distinct()
    index = lexical.build_index(docs, {f: F.col(c) for f, c in FIELDS.items()}, "doc_id", only=only)
    scores = _rounded(lexical.bm25_scores(questions, index))
    ranks = fusion.lexical_ranks(scores, docs.select(F.col("doc_id").alias("ordinal")))
    fused = fusion.fuse(ranks).withColumn("score", F.round("score", 9))
    return fusion.ranked(fused).where("place <= 20").select("qid", F.col("ordinal").alias("doc_id"), "score", "place")


# Vectors

NEAREST = {"cosine_topk": ("COSINE", "list_cosine_distance(a, b)"), "l2_topk": ("EUCLIDEAN", "list_distance(a, b)"), "dot_topk": ("DOT", "-list_inner_product(a, b)"),
           "manhattan_topk": ("MANHATTAN", "list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2])))")}


def _knn(metric: str, scoped: bool):
    def run(spark, sf_dir):
        """Every vector whose id is divisible by 100 against all; the six nearest of each."""
        rows = read(spark, sf_dir, "embeddings").select(
            F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vec"), (F.when(F.col("label") % 2 == 0, F.col("label")) if scoped else F.lit(None)).cast("string").alias("scope")
        )
        asked = read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(
            F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("qvec"), F.col("label").cast("string").alias("qscope")
        )
        return store.nearest_many(asked, rows, 6, float("inf"), metric, places=6)

    return run


for _name, (_metric, _sql) in NEAREST.items():
    query(_name, f"""SELECT qid, key, distance, rank FROM (SELECT qid, key, round({_sql}, 6) AS distance, CAST(row_number() OVER (PARTITION BY qid ORDER BY round({_sql}, 6), key) AS INT) AS rank FROM
(SELECT q.vec_id AS qid, e.vec_id AS key, e.embedding::DOUBLE[] AS a, q.embedding::DOUBLE[] AS b FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)) WHERE rank <= 6""")(_knn(_metric, False))
query("scope_filter_knn", """SELECT qid, key, distance, rank FROM (SELECT qid, key, round(list_cosine_distance(a, b), 6) AS distance, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_distance(a, b), 6), key) AS INT) AS rank
FROM (SELECT q.vec_id AS qid, e.vec_id AS key, e.embedding::DOUBLE[] AS a, q.embedding::DOUBLE[] AS b FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND (e.label % 2 <> 0 OR e.label = q.label))) WHERE rank <= 6""")(_knn("COSINE", True))


@query("store_scope_counts", "SELECT label AS ns, count(*) AS n, count(*) FILTER (WHERE vec_id % 2 = 0) AS open FROM embeddings GROUP BY label")
def store_scope_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("ns"), F.when(F.col("vec_id") % 2 == 1, F.lit("s")).alias("scope"))
    return rows.groupBy("ns").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(store.in_scope(None), 1)).alias("open"))


@query("hash_embed_knn")
def hash_embed_knn(spark, sf_dir):
    """Names of parts as hashed vectors; those with a key divisible by 100 are asked against all."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_name")
    rows = HashingEmbedder(128).embed_column(parts, F.col("p_name")).withColumn("scope", F.lit(None).cast("string"))
    asked = rows.where("key % 100 = 0").select(F.col("key").alias("qid"), F.col("vec").alias("qvec"), F.lit(None).cast("string").alias("qscope"))
    return store.nearest_many(asked, rows, 6, 2.0, places=6)


# Access

ROLES = "CASE WHEN c_custkey % 3 = 0 THEN CAST(array() AS array<string>) WHEN c_custkey % 3 = 1 THEN array(concat('r', c_custkey % 5)) END"


@query("acl_visible", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 1 OR c_custkey % 5 IN (1, 4)")
def acl_visible(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").withColumn("roles", F.expr(ROLES))
    return access.visible_objects(rows, ["r1", "r4"]).select("c_custkey", "c_name")


@query("acl_anonymous", "SELECT count(*) AS n FROM customer WHERE c_custkey % 3 <> 1")
def acl_anonymous(spark, sf_dir):
    return access.visible_objects(read(spark, sf_dir, "customer").withColumn("roles", F.expr(ROLES)), None).agg(F.count(F.lit(1)).alias("n"))


SECRET = ["c_acctbal", "s_acctbal", "html", "o_totalprice"]


def _reflected(spark, sf_dir) -> DataFrame:
    rows = [{"ordinal": k, **o} for k, o in enumerate(reflect_parquet(spark, sf_dir, TABLES))]
    for r in rows:
        r["columns"] = [c | {"roles": ["finance"] if c["name"] in SECRET else None} for c in r["columns"]]
    names = [f.split(" ")[0] for f in "ordinal,name,schema,kind,description,hint,columns,foreign_keys,row_estimate,definition,roles,extra".split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], OBJECTS)


@query("acl_columns", f"""SELECT table_name AS name, column_name AS column FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)})
AND column_name NOT IN ({", ".join(f"'{c}'" for c in SECRET)})""")
def acl_columns(spark, sf_dir):
    rows = access.visible_columns(_reflected(spark, sf_dir), None)
    return rows.select("name", F.explode("columns").alias("c")).select("name", F.col("c.name").alias("column"))


@query("audit_counts", f"""SELECT table_name AS name, count(*) FILTER (WHERE column_name NOT IN ({", ".join(f"'{c}'" for c in SECRET)})) AS shown,
count(*) FILTER (WHERE column_name IN ({", ".join(f"'{c}'" for c in SECRET)})) AS withheld FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)}) GROUP BY 1""")
def audit_counts(spark, sf_dir):
    rows = _reflected(spark, sf_dir)
    shown = access.visible_columns(rows, None).select("name", F.size("columns").cast("long").alias("shown"))
    return rows.join(shown, "name").select("name", "shown", (F.size("columns") - F.col("shown")).alias("withheld"))


@query("glob_filter", f"""SELECT table_name AS name FROM information_schema.tables WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)}) AND (table_name LIKE 'p%' OR table_name LIKE '%s')""")
def glob_filter(spark, sf_dir):
    return _reflected(spark, sf_dir).where(matches(F.col("name"), ["P%", "*s"])).select("name")


# Role n of a nation inherits from role n // 2: a tree under 0, with a cycle from 24 back to 3.
GRAPH_SQL = "SELECT n_nationkey // 2 AS role, n_nationkey AS inheritor FROM nation WHERE n_nationkey > 0 UNION ALL SELECT 24, 3"


def _graph(spark, sf_dir) -> DataFrame:
    n = read(spark, sf_dir, "nation").where("n_nationkey > 0")
    return n.select(F.expr("n_nationkey div 2").cast("int").alias("role"), F.col("n_nationkey").alias("inheritor")).union(spark.createDataFrame([(24, 3)], "role int, inheritor int"))


@query("role_closure", f"""WITH RECURSIVE g(role, inheritor) AS ({GRAPH_SQL}), c(object, role) AS (SELECT r_name, r_regionkey FROM region UNION SELECT c.object, g.inheritor FROM c JOIN g ON g.role = c.role)
SELECT object, role FROM c""")
def role_closure(spark, sf_dir):
    direct = read(spark, sf_dir, "region").select(F.col("r_name").alias("object"), F.col("r_regionkey").alias("role"))
    return graph.expand_roles(direct, _graph(spark, sf_dir))


@query("restrict_from_grants", f"""WITH RECURSIVE g(role, inheritor) AS ({GRAPH_SQL}), direct AS (SELECT n_name AS object, n_regionkey + 5 AS role FROM nation WHERE n_nationkey % 4 <> 3),
c(object, role) AS (SELECT * FROM direct UNION SELECT c.object, g.inheritor FROM c JOIN g ON g.role = c.role), roles AS (SELECT object, array_to_string(list_sort(list_distinct(list(role::VARCHAR))), ',') AS roles FROM c GROUP BY object)
SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE coalesce(roles, '') END AS roles FROM nation LEFT JOIN roles ON object = n_name""")
def restrict_from_grants(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    objects = nation.select(F.col("n_nationkey").cast("long").alias("ordinal"), F.lit(None).cast("string").alias("schema"), F.col("n_name").alias("name"), F.lit(None).cast("array<string>").alias("roles"))
    grants = nation.where("n_nationkey % 4 <> 3").select(F.lit(None).cast("string").alias("schema"), F.upper("n_name").alias("object"), (F.col("n_regionkey") + 5).cast("string").alias("grantee"))
    public = nation.where("n_nationkey % 5 = 0").select(F.lit(None).cast("string").alias("schema"), F.col("n_name").alias("object"), F.lit("public").alias("grantee"))
    roles = _graph(spark, sf_dir).select(F.col("role").cast("string").alias("role"), F.col("inheritor").cast("string").alias("inheritor"))
    out, _ = access.apply_grants(objects, grants.unionByName(public), roles)
    return out.select("name", F.coalesce(F.array_join("roles", ","), F.lit("")).alias("roles"))


# Graph, on a literal catalog

CATALOG = [
    obj("crm_customer", "app", columns=[column("id", "int", pk=True)]),
    obj("sales_order", "app", columns=[column("id", "int", pk=True), column("id_customer", "int"), column("warehouse_key", "int")]),
    obj("sales_order_line", "app", columns=[column("id", "int", pk=True), column("order_id", "int"), column("CUSTOMER_ID", "int")]),
    obj("warehouses", "app", columns=[column("id", "int", pk=True)]),
    obj("sales_order_bkp", "app", columns=[column("id", "int", pk=True)]),
    obj("stg_customer", "app", columns=[column("id", "int", pk=True)]),
    obj("events", "app", columns=[column("id", "int", pk=True)]),
    obj("events_2026_07", "app", columns=[column("id", "int", pk=True)]),
    obj("events_p12", "app", columns=[column("id", "int", pk=True)]),
    obj("ledger_bak_20260101", "fin", columns=[column("id", "int", pk=True)]),
    obj("entry", "fin", columns=[column("a", "int", pk=True), column("b", "int", pk=True)]),
    obj("posting", "fin", columns=[column("id", "int", pk=True), column("entry_id", "int"), column("customer_id", "int")]),
    obj("invoice", None, columns=[column("id", "int", pk=True)]),
    obj("payment", None, columns=[column("id", "int", pk=True), column("fk_invoice", "int"), column("invoice_id", "int")], foreign_keys=[foreign_key(["invoice_id"], "invoice", ["id"])]),
    obj("refund", None, columns=[column("id", "int", pk=True), column("invoice_fk", "int")]),
]


def _catalog(spark) -> DataFrame:
    return Catalog(spark).add_all(CATALOG).objects()


@query("fk_infer", """SELECT * FROM (VALUES ('sales_order', 'warehouse_key', 'warehouses'), ('sales_order_line', 'order_id', 'sales_order'), ('payment', 'fk_invoice', 'invoice'), ('refund', 'invoice_fk', 'invoice')) t(name, key_column, target)""")
def fk_infer(spark, sf_dir):
    """A customer key has two plausible targets (crm_customer and its staging copy), none in the other schema, and an entry has a key of two columns: none of these is inferred. Only sales_order ends in order."""
    rows = _catalog(spark)
    return graph.infer_foreign_keys(rows).join(rows.select("ordinal", "name"), "ordinal").select("name", F.col("column").alias("key_column"), F.col("ref_table").alias("target"))


@query("dimensions", "SELECT * FROM (VALUES ('invoice', 2::BIGINT)) t(name, in_degree)")
def dimensions(spark, sf_dir):
    rows = graph.with_inferred(_catalog(spark))
    return graph.dimensions(rows).join(rows.select("ordinal", "name"), "ordinal").select("name", "in_degree")


_CATALOG_SQL = "(VALUES " + ", ".join(f"({k}, {repr(o['schema']) if o['schema'] else 'NULL'}, '{o['name']}')" for k, o in enumerate(CATALOG)) + ") t(ordinal, schema, name)"


@query("shadow_detect", f"""WITH c AS (SELECT *, coalesce(schema || '.', '') || name AS q FROM {_CATALOG_SQL}),
suffix AS (SELECT c.name, b.q AS base FROM c JOIN c b ON b.schema IS NOT DISTINCT FROM c.schema AND c.name IN (SELECT b.name || '_' || unnest(string_split('{" ".join(s[1:] for s in graph.SHADOW_SUFFIXES)}', ' ')))),
prefix AS (SELECT c.name, b.q AS base FROM c JOIN c b ON b.schema IS NOT DISTINCT FROM c.schema AND b.q <> c.q AND regexp_matches(c.name, '^({"|".join(p[:-1] for p in graph.SHADOW_PREFIXES)})_') AND NOT regexp_matches(b.name, '^({"|".join(p[:-1] for p in graph.SHADOW_PREFIXES)})_')
AND regexp_replace(c.name, '^[a-z]+_', '') IN (b.name, regexp_replace(b.name, '^[a-z]+_', ''))),
part AS (SELECT c.name, b.q AS base FROM c JOIN c b ON b.schema IS NOT DISTINCT FROM c.schema AND regexp_matches(c.name, '_(p[0-9]+|[0-9]{{4}}(_?[0-9]{{2}}){{0,2}})$') AND b.name = regexp_replace(c.name, '_(p[0-9]+|[0-9]{{4}}(_?[0-9]{{2}}){{0,2}})$', '')),
backup AS (SELECT name, regexp_replace(name, '_(bak|bkp|backup)(_[0-9]{{6,8}})?$', '') AS base FROM c WHERE regexp_matches(name, '_(bak|bkp|backup)(_[0-9]{{6,8}})?$') AND name NOT IN (SELECT name FROM suffix))
SELECT * FROM suffix UNION ALL SELECT * FROM prefix UNION ALL SELECT * FROM part UNION ALL SELECT * FROM backup""")
def shadow_detect(spark, sf_dir):
    rows = _catalog(spark)
    return graph.shadows(rows).join(rows.select("ordinal", "name"), "ordinal").select("name", "base")


@query("fk_expand", """SELECT * FROM (VALUES ('payment', 'payment'), ('payment', 'invoice')) t(asked, name)""")
def fk_expand(spark, sf_dir):
    picked = Catalog(spark).add_all(CATALOG).select("payment", top_k=1)
    return spark.createDataFrame([("payment", h.row["name"]) for h in picked.hits], "asked string, name string")


@query("catalog_select")
def catalog_select(spark, sf_dir):
    """The whole ranking (vector, three lexical fields, shadows, names) over the demo catalog for a set of questions."""
    c = Catalog(spark).add_all(demo_objects())
    c.infer_foreign_keys()
    questions = [(1, "Which invoices are still unpaid?"), (2, "stock on hand by warehouse"), (3, "sales order"), (4, "")]
    return c.select_many(spark.createDataFrame(questions, "qid int, question string"), 5).withColumn("score", F.round("score", 9))


@query("glossary_expand", "SELECT * FROM (VALUES (1, 'What is our churn rate? customers who left'), (2, 'netrevenue by month total minus tax'), (3, 'nothing here')) t(qid, question)")
def glossary_expand(spark, sf_dir):
    q = spark.createDataFrame([(1, "What is our churn rate?"), (2, "netrevenue by month"), (3, "nothing here")], "qid int, question string")
    return expand_glossary(q, spark.createDataFrame([("Churn", "customers who left"), ("net revenue", "total minus tax")], "term string, meaning string"))


# Sampling

SAMPLED = {"orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "customer": ["c_mktsegment"], "part": ["p_type", "p_brand"], "events": ["event_type", "props"], "documents": ["lang", "source"]}


def _sample_sql() -> str:
    one = lambda t, c: f"SELECT '{t}' AS name, '{c}' AS column, string_agg(v, '|' ORDER BY v) AS values FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL) HAVING count(*) BETWEEN 1 AND 25 AND max(length(v)) <= 40 AND count(*) * 5 < (SELECT count(*) FROM {t})"
    return " UNION ALL ".join(one(t, c) for t, cols in SAMPLED.items() for c in cols)


@query("sample_values", _sample_sql())
def sample_values(spark, sf_dir):
    out = None
    for t, cols in SAMPLED.items():
        rows = sampling.sample_values(read(spark, sf_dir, t), cols).select(F.lit(t).alias("name"), "column", F.array_join("values", "|").alias("values"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("sample_candidates", f"""SELECT table_name AS name, column_name AS column FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)}) AND data_type = 'VARCHAR'
AND column_name NOT IN ('html') AND NOT regexp_matches(column_name, 'name|address|email|phone|ssn|dob|birth|passport')""")
def sample_candidates(spark, sf_dir):
    rows = _reflected(spark, sf_dir).select("name", F.explode("columns").alias("c"))
    return rows.where(sampling.is_candidate(F.col("c.name"), F.col("c.type"), F.col("c.pk"), F.col("c.roles"))).select("name", F.col("c.name").alias("column"))


# Evaluation: for each customer, the priorities of its first five orders against a gold set by its key

_PICKED_SQL = """WITH r AS (SELECT o_custkey, list(left(o_orderpriority, 1) ORDER BY o_orderdate, o_orderkey) AS picked FROM orders GROUP BY o_custkey),
x AS (SELECT o_custkey, picked, [(o_custkey % 5 + 1)::VARCHAR, (o_custkey % 3 + 1)::VARCHAR] AS gold FROM r)"""


def _picked(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("p")))).alias("l"))
    digit = lambda m: (F.col("o_custkey") % m + 1).cast("string")
    return rows.select("o_custkey", F.transform("l", lambda x: x["p"]).alias("picked"), F.array(digit(5), digit(3)).alias("gold"))


@query("eval_set_recall", _PICKED_SQL + " SELECT round(sum(len(list_intersect(list_distinct(picked), gold))) / sum(len(gold)), 9) AS recall FROM x")
def eval_set_recall(spark, sf_dir):
    return evaluation.set_recall(_picked(spark, sf_dir)).select(F.round("recall", 9).alias("recall"))


@query("eval_recall_at_k", _PICKED_SQL + """, m AS (SELECT len(list_filter(list_distinct(gold), lambda g: NOT list_contains(picked[1:5], g))) AS missed, len(list_distinct(gold)) AS n FROM x)
SELECT round(avg((missed = 0)::INT), 9) AS all_gold, round(avg(1 - missed / n), 9) AS per_table FROM m""")
def eval_recall_at_k(spark, sf_dir):
    return evaluation.recall_at_k(_picked(spark, sf_dir), 5).select(F.round("all_gold", 9).alias("all_gold"), F.round("per_table", 9).alias("per_table"))


@query("eval_hits_and_decoys", _PICKED_SQL + """ SELECT o_custkey, len(list_filter(gold, lambda g: list_contains(picked, g))) > 0 AS any_hit,
list_contains(picked, gold[1]) AND (NOT list_contains(picked, gold[2]) OR list_position(picked, gold[1]) < list_position(picked, gold[2])) AS beats FROM x""")
def eval_hits_and_decoys(spark, sf_dir):
    rows = _picked(spark, sf_dir)
    gold = F.col("gold")
    return rows.select("o_custkey", evaluation.any_hit(F.col("picked"), gold).alias("any_hit"), evaluation.beats_decoy(F.col("picked"), gold[0], gold[1]).alias("beats"))


@query("eval_gold_tables", "SELECT * FROM (VALUES (1, 'a,b'), (2, 'events,users'), (3, 'daily')) t(sql_id, tables)")
def eval_gold_tables(spark, sf_dir):
    sql = [(1, "SELECT * FROM a JOIN s.b ON a.k = b.k"), (2, "WITH x AS (SELECT * FROM `p.d.events_*`) SELECT * FROM x JOIN users USING (k)"), (3, "select count(*) from db.daily")]
    rows = spark.createDataFrame(sql, "sql_id int, sql string")
    return rows.select("sql_id", F.array_join(evaluation.gold_tables(F.col("sql")), ",").alias("tables"))


@query("prompt_savings", """WITH t AS (SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z\\s]'), lambda p: CASE WHEN regexp_full_match(p, '[A-Za-z]+') THEN greatest(1, round_even(length(p) / 4.0, 0)) ELSE 1 END)), 0) AS full_,
coalesce(list_sum(list_transform(regexp_extract_all(split_part(coalesce(text, ''), chr(10), 1), '[A-Za-z]+|[^A-Za-z\\s]'), lambda p: CASE WHEN regexp_full_match(p, '[A-Za-z]+') THEN greatest(1, round_even(length(p) / 4.0, 0)) ELSE 1 END)), 0) AS part FROM documents)
SELECT round(1 - avg(part) / avg(full_), 9) AS reduction FROM t""")
def prompt_savings(spark, sf_dir):
    """How much shorter the first line of each document is than the whole, in estimated tokens."""
    rows = read(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("full"))
    rows = rows.select("full", F.substring_index("full", "\n", 1).alias("selected"))
    return evaluation.token_reduction(rows).select(F.round("reduction", 9).alias("reduction"))


# Guarded SQL

GUARDED = {
    "guarded_sql_join": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "guarded_sql_window": "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE k = 1",
    "guarded_sql_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
}


def _guarded(sql: str):
    def run(spark, sf_dir):
        tables = {t: read(spark, sf_dir, t) for t in ("customer", "nation", "orders", "supplier")}
        objects = [r for r in _reflected(spark, sf_dir).collect() if r["name"] in tables]
        return GuardedSession(spark, objects, tables).sql(sql)

    return run


for _name, _sql in GUARDED.items():
    query(_name, _sql)(_guarded(_sql))
