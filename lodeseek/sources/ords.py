"""Objects over HTTPS from a REST data service: dictionary statements in one request."""

import base64
import json
import urllib.request
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodeseek.model import column, foreign_key, obj

#: Dictionary statements, all sent in one request.
STATEMENTS = {
    "tables": "SELECT table_name AS t, num_rows AS n FROM user_tables",
    "views": "SELECT view_name AS t, text_vc AS d FROM user_views",
    "columns": "SELECT table_name AS t, column_name AS c, data_type AS type, nullable AS n, column_id AS p FROM user_tab_columns",
    "comments": "SELECT table_name AS t, comments AS d FROM user_tab_comments WHERE comments IS NOT NULL",
    "column_comments": "SELECT table_name AS t, column_name AS c, comments AS d FROM user_col_comments WHERE comments IS NOT NULL",
    "keys": "SELECT c.table_name AS t, k.column_name AS c FROM user_constraints c JOIN user_cons_columns k ON k.constraint_name = c.constraint_name WHERE c.constraint_type = 'P'",
    "foreign": """SELECT c.table_name AS t, k.column_name AS c, r.table_name AS rt, rk.column_name AS rc, k.position AS p FROM user_constraints c
JOIN user_cons_columns k ON k.constraint_name = c.constraint_name JOIN user_constraints r ON r.constraint_name = c.r_constraint_name
JOIN user_cons_columns rk ON rk.constraint_name = r.constraint_name AND rk.position = k.position WHERE c.constraint_type = 'R'""",
}


def base_url(url: str, schema: str) -> str:
    """The SQL endpoint of a service, whatever part of its address was given."""
    text = url.strip().rstrip("/")
    if not text.lower().startswith("https://"):
        raise ValueError("only https is used")
    if text.endswith("/_/sql"):
        return text
    return text + ("" if text.lower().endswith("/" + schema.lower()) else "/" + schema.lower()) + "/_/sql"


def run_statements(url: str, user: str, password: str, statements: dict[str, str], timeout: float = 30.0) -> dict[str, list[dict]]:
    """Rows of each statement, with lower-case names; an error of one raises."""
    body = ";\n".join(statements.values()) + ";"
    auth = base64.b64encode(f"{user}:{password}".encode()).decode()
    request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/sql", "Authorization": f"Basic {auth}"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        items = json.load(reply)["items"]
    out = {}
    for name, item in zip(statements, items, strict=True):
        if item.get("errorDetails"):
            raise RuntimeError(f"{name}: {item['errorDetails'][:200]}")
        out[name] = [{k.lower(): v for k, v in r.items()} for r in item.get("resultSet", {}).get("items", [])]
    return out


def reflect_ords(spark: SparkSession, url: str, schema: str, user: str, password: str, include_views: bool = True, timeout: float = 30.0, run: Callable = run_statements) -> list[dict]:
    """Objects of a schema; no rows are read. Foreign keys are grouped by the table they point at."""
    found = run(base_url(url, schema), user, password, STATEMENTS, timeout)
    frame = lambda name, cols: spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in cols.split()) for r in found[name]], ", ".join(f"{c} string" for c in cols.split()))
    cols = frame("columns", "t c type n p").join(frame("column_comments", "t c d"), ["t", "c"], "left")
    cols = cols.join(frame("keys", "t c").withColumn("pk", F.lit(True)), ["t", "c"], "left")
    cols = cols.groupBy("t").agg(F.array_sort(F.collect_list(F.struct(F.col("p").cast("int").alias("p"), "c", "type", "n", "d", "pk"))).alias("cols"))
    fks = frame("foreign", "t c rt rc p").groupBy("t", "rt").agg(F.array_sort(F.collect_list(F.struct(F.col("p").cast("int").alias("p"), "c", "rc"))).alias("parts"))
    fks = fks.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("rt", "parts"))).alias("fks"))
    views = {r["t"]: r.get("d") for r in found["views"]}
    about = {r["t"]: r["d"] for r in found["comments"]}
    sizes = {r["t"]: r.get("n") for r in found["tables"]}
    out = []
    for r in cols.join(fks, "t", "left").orderBy("t").collect():
        if r["t"] in views and not include_views or r["t"] not in views and r["t"] not in sizes:
            continue
        out.append(
            obj(
                r["t"], schema, "VIEW" if r["t"] in views else "TABLE", about.get(r["t"]), definition=views.get(r["t"]), row_estimate=sizes.get(r["t"]),
                columns=[column(c["c"], c["type"], c["n"] != "N", c["d"], bool(c["pk"])) for c in r["cols"]],
                foreign_keys=[foreign_key([p["c"] for p in k["parts"]], k["rt"], [p["rc"] for p in k["parts"]]) for k in r["fks"] or []],
            )
        )
    return out
