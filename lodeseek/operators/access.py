"""Access by grants, roles and columns."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.operators.fusion import allowed
from lodeseek.operators.graph import expand_roles


@dataclass
class GrantReport:
    restricted: int = 0
    public: int = 0
    untouched: int = 0
    unmatched: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def visible_objects(objects: DataFrame, user_roles) -> DataFrame:
    """Objects a caller may see."""
    return objects.where(allowed(F.col("roles"), None if user_roles is None else list(user_roles)))


def visible_columns(objects: DataFrame, user_roles) -> DataFrame:
    """objects whose columns are those the caller may see; the others are absent."""
    roles = None if user_roles is None else list(user_roles)
    return objects.withColumn("columns", F.filter("columns", lambda c: allowed(c["roles"], roles)))


def apply_grants(
    objects: DataFrame, grants: DataFrame, graph: DataFrame | None = None, public_grantees: tuple[str, ...] = ("PUBLIC",)
) -> tuple[DataFrame, GrantReport]:
    """objects with roles taken from grants (C1), and what was done.

    grants: schema, object, grantee; graph: role, inheritor. Names are matched in lower case by schema and
    object, else by object with a null schema. An object without grants is left as it is and reported; one
    granted to a public grantee has no roles; any other has all roles that inherit a grant, sorted.
    """
    report = GrantReport()
    if graph is None:
        report.warnings.append("no role graph: only direct grants count")
    g = grants.select(F.lower("schema").alias("g_schema"), F.lower("object").alias("g_object"), "grantee").distinct()
    o = objects.select("ordinal", F.lower("schema").alias("o_schema"), F.lower("name").alias("o_name"))
    exact = o.join(g, o.o_schema.eqNullSafe(g.g_schema) & (o.o_name == g.g_object)).select("ordinal", "grantee")
    loose = o.join(exact.select("ordinal").distinct(), "ordinal", "left_anti").join(g.where("g_schema IS NULL"), o.o_name == F.col("g_object"))
    direct = exact.unionByName(loose.select("ordinal", "grantee"))
    closed = direct.select(F.col("ordinal").alias("object"), F.col("grantee").alias("role"))
    if graph is not None:
        closed = expand_roles(closed, graph)
    public = direct.where(F.lower("grantee").isin([p.lower() for p in public_grantees])).select("ordinal").distinct().withColumn("public", F.lit(True))
    found = closed.groupBy(F.col("object").alias("ordinal")).agg(F.array_sort(F.collect_set("role")).alias("found"))
    out = objects.join(found, "ordinal", "left").join(public, "ordinal", "left")
    none = F.lit(None).cast("array<string>")
    roles = F.when(F.col("public"), none).when(F.col("found").isNotNull(), F.col("found")).otherwise(F.col("roles"))
    counts = out.groupBy(F.when(F.col("public"), "public").when(F.col("found").isNotNull(), "restricted").otherwise("untouched").alias("k")).count()
    for r in counts.collect():
        setattr(report, r["k"], r["count"])
    report.unmatched = [r[0] for r in out.where("found IS NULL").orderBy("ordinal").select("name").collect()]
    return out.withColumn("roles", roles).select(*objects.columns), report


#: Queries that read grants through JDBC; run in the source by the option "query".
GRANT_QUERIES = {
    "postgresql": """SELECT n.nspname AS "schema", c.relname AS object, CASE WHEN a.grantee = 0 THEN 'PUBLIC' ELSE pg_get_userbyid(a.grantee) END AS grantee
FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace CROSS JOIN LATERAL aclexplode(c.relacl) a WHERE a.privilege_type = 'SELECT'
UNION SELECT n.nspname, c.relname, pg_get_userbyid(c.relowner) FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind IN ('r', 'v', 'm', 'p', 'f')""",
    "oracle": """SELECT table_schema AS "schema", table_name AS object, grantee FROM all_tab_privs WHERE privilege IN ('SELECT', 'READ')
UNION SELECT owner, table_name, owner FROM all_tables UNION SELECT owner, view_name, owner FROM all_views""",
}
ROLE_QUERIES = {
    "postgresql": "SELECT pg_get_userbyid(roleid) AS role, pg_get_userbyid(member) AS inheritor FROM pg_auth_members",
    "oracle": "SELECT granted_role AS role, grantee AS inheritor FROM dba_role_privs",
}


def read_grants(spark: SparkSession, dialect: str, url: str, **options) -> tuple[DataFrame, DataFrame]:
    """Grants and role graph of a database."""
    if dialect not in GRANT_QUERIES:
        raise ValueError(f"no grant reader for {dialect}")
    read = lambda q: spark.read.format("jdbc").options(url=url, query=q, **options).load()
    return read(GRANT_QUERIES[dialect]), read(ROLE_QUERIES[dialect])
