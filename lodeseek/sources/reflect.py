"""Reflection: objects from Spark's catalog, from Parquet folders and from databases through JDBC."""

import fnmatch
import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.model import column, foreign_key, obj

# Schemas that belong to the database itself.
SYSTEM_SCHEMAS = frozenset(
    """information_schema pg_catalog pg_toast sys mysql performance_schema sysaux system audsys ctxsys mdsys olapsys ordsys xdb wmsys dbsnmp outln
    lbacsys dvsys gsmadmin_internal appqossys global_temp""".split()
)


def glob_pattern(pattern: str) -> str:
    """A regular expression for a glob without regard to case; % means * and _ is itself."""
    return "(?i)^" + fnmatch.translate(pattern.replace("%", "*")).removesuffix(r"\Z").removesuffix(r"\z").removeprefix("(?s:").removesuffix(")") + "$"


def matches(name: Column, patterns: Iterable[str] | None) -> Column:
    """Whether a name matches one of the patterns; no patterns match all."""
    found = [name.rlike(glob_pattern(p)) for p in patterns or []]
    out = found[0] if found else F.lit(True)
    for f in found[1:]:
        out = out | f
    return out


def matches_text(name: str, patterns: Iterable[str] | None) -> bool:
    patterns = list(patterns or [])
    return not patterns or any(re.match(glob_pattern(p), name) for p in patterns)


def internal_schema(name: str, dialect: str = "spark") -> bool:
    """Whether a schema is the system's own."""
    return name.lower() in SYSTEM_SCHEMAS or HOOKS.get(dialect, Hooks()).is_internal_schema(name)


class Hooks:
    """What a dialect knows of its own objects; a hook that fails excludes nothing."""

    objects_query: str | None = None
    types_query: str | None = None

    def is_internal_schema(self, name: str) -> bool:
        return False

    def maintained(self, spark: SparkSession, url: str, **options) -> set[tuple[str, str | None]]:
        """(schema, object) that the vendor or an extension owns; a null object stands for the whole schema."""
        if not self.objects_query:
            return set()
        try:
            rows = spark.read.format("jdbc").options(url=url, query=self.objects_query, **options).load().collect()
        except Exception:  # noqa: BLE001
            return set()
        return {(r[0].lower(), r[1].lower() if r[1] else None) for r in rows}


    def queries(self) -> dict[str, str]:
        """The queries of columns, keys and views, in the columns of INFORMATION."""
        return INFORMATION

    def types(self, spark: SparkSession, url: str, **options) -> dict[str, str]:
        """What a type is in full, by its name or by schema.table.column; empty if the query fails."""
        if not self.types_query:
            return {}
        try:
            rows = spark.read.format("jdbc").options(url=url, query=self.types_query, **options).load().collect()
        except Exception:  # noqa: BLE001
            return {}
        return {r[0].lower(): r[1] for r in rows if r[0] and r[1]}


#: Types that tell nothing, for which a column's own entry is looked up.
UNKNOWN_TYPES = frozenset({"", "null", "undefined", "user-defined", "other"})


def fill_unknown_types(objects: list[dict], types: dict[str, str]) -> int:
    """Gives columns the full text of their type where types has its name, or has the column of an unknown type; returns how many."""
    filled = 0
    for o in objects:
        for c in o["columns"]:
            own = (c["type"] or "").lower()
            at = f"{o['schema'] or ''}.{o['name']}.{c['name']}".lower()
            text = types.get(at) if own in UNKNOWN_TYPES else types.get(own)
            if text and text != c["type"]:
                c["type"] = text
                filled += 1
    return filled


class PostgreSQL(Hooks):
    objects_query = """SELECT n.nspname, c.relname FROM pg_depend d JOIN pg_class c ON c.oid = d.objid JOIN pg_namespace n ON n.oid = c.relnamespace
WHERE d.deptype = 'e' AND d.classid = 'pg_class'::regclass
UNION SELECT n.nspname, NULL FROM pg_depend d JOIN pg_namespace n ON n.oid = d.objid WHERE d.deptype = 'e' AND d.classid = 'pg_namespace'::regclass"""
    types_query = """SELECT t.typname, CASE t.typtype WHEN 'e' THEN (SELECT 'ENUM(' || string_agg(quote_literal(e.enumlabel), ', ' ORDER BY e.enumsortorder) || ')'
FROM pg_enum e WHERE e.enumtypid = t.oid) ELSE 'DOMAIN OVER ' || format_type(t.typbasetype, t.typtypmod) END AS text FROM pg_type t WHERE t.typtype IN ('e', 'd')"""

    def is_internal_schema(self, name: str) -> bool:
        return name.lower().startswith(("pg_", "_timescaledb_", "crdb_"))

    def queries(self) -> dict[str, str]:
        """Enums and domains by their own names, so that the query of types can tell what they are."""
        named = "coalesce(domain_name, CASE WHEN data_type = 'USER-DEFINED' THEN udt_name ELSE data_type END) AS type"
        return INFORMATION | {"columns": INFORMATION["columns"].replace("data_type AS type", named)}


class Oracle(Hooks):
    objects_query = "SELECT username, NULL FROM all_users WHERE oracle_maintained = 'Y'"
    types_query = """SELECT owner || '.' || table_name || '.' || column_name, CASE WHEN data_type LIKE '%CHAR%' THEN data_type || '(' || char_length || ')'
WHEN data_type = 'NUMBER' AND data_precision IS NOT NULL THEN 'NUMBER(' || data_precision || ',' || data_scale || ')' ELSE data_type END FROM all_tab_columns"""

    def is_internal_schema(self, name: str) -> bool:
        return "$" in name or name.lower().startswith(("apex_", "flows_", "ords_"))

    def queries(self) -> dict[str, str]:
        """The dictionary views in place of an information schema. A key's target is found by its constraint."""
        seen = "NOT IN (SELECT username FROM all_users WHERE oracle_maintained = 'Y')"
        return {
            "columns": f"SELECT owner AS s, table_name AS t, column_name AS c, data_type AS type, CASE nullable WHEN 'N' THEN 'NO' ELSE 'YES' END AS n, column_id AS p FROM all_tab_columns WHERE owner {seen}",
            "keys": f"""SELECT c.owner AS s, c.table_name AS t, k.column_name AS c, CASE c.constraint_type WHEN 'P' THEN 'PRIMARY KEY' ELSE 'FOREIGN KEY' END AS kind,
c.constraint_name AS name, k.position AS p, r.table_name AS rt, r.column_name AS rc FROM all_constraints c
JOIN all_cons_columns k ON k.owner = c.owner AND k.constraint_name = c.constraint_name
LEFT JOIN all_cons_columns r ON r.owner = c.r_owner AND r.constraint_name = c.r_constraint_name AND r.position = k.position
WHERE c.constraint_type IN ('P', 'R') AND c.owner {seen}""",
            "views": f"SELECT owner AS s, view_name AS t, text_vc AS d FROM all_views WHERE owner {seen}",
        }

    def types(self, spark: SparkSession, url: str, **options) -> dict[str, str]:
        """One query a database and session: its answer is kept for later calls."""
        if url not in self._kept:
            self._kept[url] = super().types(spark, url, **options)
        return self._kept[url]

    def __init__(self):
        self._kept: dict[str, dict[str, str]] = {}


HOOKS: dict[str, Hooks] = {"postgresql": PostgreSQL(), "oracle": Oracle()}


def reflect_catalog(spark: SparkSession, include=None, exclude=None, schemas=None, include_views: bool = True) -> list[dict]:
    """Objects of Spark's own catalog: the current database first, then by database, tables before views.

    Objects without columns are left out, and so is a second one of a schema and name.
    """
    home = spark.catalog.currentDatabase()
    wanted = [d.name for d in spark.catalog.listDatabases() if not internal_schema(d.name) and (not schemas or d.name in schemas)]
    out, seen = [], set()
    for db in sorted(wanted, key=lambda d: (d != home, d)):
        tables = [t for t in spark.catalog.listTables(db) if include_views or "VIEW" not in t.tableType and not t.isTemporary]
        for t in sorted(tables, key=lambda t: ("VIEW" in t.tableType or t.isTemporary, t.name)):
            schema = None if t.isTemporary else db
            if (schema, t.name) in seen or not matches_text(t.name, include) or (exclude and matches_text(t.name, exclude)):
                continue
            full = f"`{t.name}`" if t.isTemporary else f"`{db}`.`{t.name}`"
            fields = spark.table(full).schema.fields
            if not fields:
                continue
            seen.add((schema, t.name))
            view = t.isTemporary or "VIEW" in t.tableType
            cols = [column(f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("comment")) for f in fields]
            out.append(obj(t.name, schema, "VIEW" if view else "TABLE", t.description, columns=cols, definition=_definition(spark, full) if view and not t.isTemporary else None))
    return out


def _definition(spark: SparkSession, full: str) -> str | None:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {full}").where("col_name = 'View Text'").collect()
    return rows[0]["data_type"] if rows else None


def reflect_parquet(spark: SparkSession, folder: str, names: Iterable[str], schema: str | None = None, include=None, exclude=None) -> list[dict]:
    """Objects of the Parquet tables of a folder; only footers are read."""
    out = []
    for name in names:
        if not matches_text(name, include) or (exclude and matches_text(name, exclude)):
            continue
        fields = spark.read.parquet(f"{folder}/{name}.parquet").schema.fields
        if fields:
            out.append(obj(name, schema, columns=[column(f.name, f.dataType.simpleString(), f.nullable) for f in fields]))
    return out


#: One query for each kind of metadata, whatever the number of tables (R2).
INFORMATION = {
    "columns": "SELECT table_schema AS s, table_name AS t, column_name AS c, data_type AS type, is_nullable AS n, ordinal_position AS p FROM information_schema.columns",
    "keys": """SELECT k.table_schema AS s, k.table_name AS t, k.column_name AS c, tc.constraint_type AS kind, tc.constraint_name AS name, k.ordinal_position AS p,
u.table_name AS rt, u.column_name AS rc FROM information_schema.table_constraints tc JOIN information_schema.key_column_usage k
ON k.constraint_schema = tc.constraint_schema AND k.constraint_name = tc.constraint_name LEFT JOIN information_schema.referential_constraints r
ON r.constraint_schema = tc.constraint_schema AND r.constraint_name = tc.constraint_name LEFT JOIN information_schema.key_column_usage u
ON u.constraint_schema = r.unique_constraint_schema AND u.constraint_name = r.unique_constraint_name AND u.ordinal_position = k.position_in_unique_constraint
WHERE tc.constraint_type IN ('PRIMARY KEY', 'FOREIGN KEY')""",
    "views": "SELECT table_schema AS s, table_name AS t, view_definition AS d FROM information_schema.views",
}


def reflect_jdbc(spark: SparkSession, url: str, dialect: str, default_schema: str | None = None, include=None, exclude=None, schemas=None, include_views=True, load=None, **options) -> list[dict]:
    """Objects of a database, by three queries of its dialect, with types in full where a query of types has them.

    load(query) gives the rows of a query; by default it reads over JDBC.
    """
    hooks = HOOKS.get(dialect, Hooks())
    load = load or (lambda query: spark.read.format("jdbc").options(url=url, query=query, **options).load())
    found = {k: lower_names(load(q)) for k, q in hooks.queries().items()}
    gone = hooks.maintained(spark, url, **options)
    rows = assemble(found["columns"], found["keys"], found["views"])
    fill_unknown_types(rows, hooks.types(spark, url, **options))
    keep = lambda o: (
        not internal_schema(o["schema"], dialect) and (not schemas or o["schema"] in schemas) and not {(o["schema"].lower(), None), (o["schema"].lower(), o["name"].lower())} & gone
        and matches_text(o["name"], include) and not (exclude and matches_text(o["name"], exclude)) and (include_views or o["kind"] == "TABLE")
    )
    return sorted(filter(keep, rows), key=lambda o: (o["schema"] != default_schema, o["schema"], o["kind"], o["name"]))


def lower_names(rows: DataFrame) -> DataFrame:
    """Columns by lower-case names: some databases give aliases in capitals."""
    return rows.toDF(*[c.lower() for c in rows.columns])


def assemble(columns: DataFrame, keys: DataFrame, views: DataFrame) -> list[dict]:
    """Objects from the rows of INFORMATION's queries, joined by schema and table."""
    pks = keys.where("kind = 'PRIMARY KEY'").select("s", "t", "c", F.lit(True).alias("pk"))
    cols = columns.join(pks, ["s", "t", "c"], "left").groupBy("s", "t").agg(F.array_sort(F.collect_list(F.struct("p", "c", "type", "n", "pk"))).alias("cols"))
    fks = keys.where("kind = 'FOREIGN KEY'").groupBy("s", "t", "name", "rt").agg(F.array_sort(F.collect_list(F.struct("p", "c", "rc"))).alias("parts"))
    fks = fks.groupBy("s", "t").agg(F.array_sort(F.collect_list(F.struct("name", "rt", "parts"))).alias("fks"))
    out = []
    for r in cols.join(fks, ["s", "t"], "left").join(views, ["s", "t"], "left").collect():
        out.append(
            obj(
                r["t"], r["s"], "VIEW" if r["d"] is not None else "TABLE", definition=r["d"],
                columns=[column(c["c"], c["type"], str(c["n"]).upper() != "NO", pk=bool(c["pk"])) for c in r["cols"]],
                foreign_keys=[foreign_key([p["c"] for p in k["parts"]], k["rt"], [p["rc"] for p in k["parts"]]) for k in r["fks"] or []],
            )
        )
    return out


def options_from_env(explicit: dict | None = None, name: str = "LODESEEK_CONNECT_OPTIONS") -> dict:
    """Connection options as JSON from the environment; explicit ones win by key, and malformed JSON raises."""
    import json

    text = os.environ.get(name, "")
    try:
        found = json.loads(text) if text.strip() else {}
    except ValueError as e:
        raise ValueError(f"{name} is not JSON") from e
    if not isinstance(found, dict):
        raise ValueError(f"{name} is not a JSON object")
    return found | (explicit or {})
