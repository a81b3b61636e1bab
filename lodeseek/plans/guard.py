"""Guarded SQL: one read-only statement, over objects and columns that the caller may see.

Text is judged by Spark's own parser: the plan has to be a query, may not run scripts, may not call functions
that reach outside, and each relation has to resolve to a visible object. It runs in a session of its own in
which only views of visible objects exist, without their restricted columns.
"""

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodeseek.operators.render import may_see, qname_of

#: Fixed limits.
MAX_SQL = 20_000
MAX_QUESTION = 2_000
MAX_TOP_K = 50
MAX_ROLES = 100
DEFAULT_ROWS = 50
MAX_ROWS = 200
#: Functions that call into the machine, read files or outside services, or tell of the session.
REFUSED = frozenset(
    """reflect java_method try_reflect read_files from_avro to_avro schema_of_avro input_file_name input_file_block_start input_file_block_length
    current_user session_user user current_catalog current_database current_schema version raise_error assert_true http_request ai_query
    sql_keywords spark_partition_id collations python_worker_logs""".split()
)
QUERY_NODES = frozenset(
    """Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Join Union Intersect Except UnresolvedWith SubqueryAlias UnresolvedSubqueryColumnAliases
    UnresolvedRelation UnresolvedInlineTable LocalRelation OneRowRelation Generate UnresolvedHaving WithWindowDefinition Pivot Unpivot LateralJoin Sample
    UnresolvedTableValuedFunction UnresolvedTVFAliases Range ResolvedInlineTable View WithCTE UnresolvedOrdinal RepartitionByExpression AsOfJoin Window
    UnresolvedHint""".split()
)


class UnsafeSQL(ValueError):
    pass


def strip_fences(sql: str) -> str:
    """Text without a code fence around it and a semicolon at its end."""
    text = (sql or "").strip()
    fenced = re.match(r"^```[a-zA-Z]*\s*\n(.*?)\n?```\s*$", text, re.S)
    return (fenced[1] if fenced else text).strip().rstrip(";").strip()


def parse(spark: SparkSession, sql: str):
    """The parsed plan of one statement."""
    if len(sql) > MAX_SQL:
        raise UnsafeSQL(f"more than {MAX_SQL} characters")
    text = strip_fences(sql)
    if not text:
        raise UnsafeSQL("no statement")
    try:
        return text, spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise UnsafeSQL("not one SQL statement: " + str(e).split("\n")[0][:200]) from None


def _walk(plan):
    """Each node (True) and expression (False) of a plan, of its subqueries and of its CTEs."""
    seq = lambda s: [s.apply(i) for i in range(s.length())]
    todo = [plan]
    while todo:
        node = todo.pop()
        yield True, node
        todo += seq(node.children())
        if node.nodeName() == "UnresolvedWith":
            todo += [c._2() for c in seq(node.cteRelations())]
        exprs = seq(node.expressions())
        while exprs:
            e = exprs.pop()
            exprs += seq(e.children())
            if hasattr(e, "plan") and e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
                todo.append(e.plan())
            yield False, e


def check_read_only(spark: SparkSession, sql: str) -> str:
    """The statement if it is a single read, else UnsafeSQL."""
    text, plan = parse(spark, sql)
    for is_node, x in _walk(plan):
        kind = x.getClass().getSimpleName()
        if is_node and kind not in QUERY_NODES:
            raise UnsafeSQL(f"not a read: {kind}")
        name = None
        if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            parts = x.nameParts() if kind == "UnresolvedFunction" else x.name()
            name = [parts.apply(i).lower() for i in range(parts.length())]
        if name and (name[-1] in REFUSED or len(name) > 1):
            raise UnsafeSQL(f"function not allowed: {'.'.join(name)}")
    return text


def referenced(spark: SparkSession, sql: str) -> set[str]:
    """Names of all relations a statement reads, in lower case, without its CTE names."""
    _, plan = parse(spark, sql)
    names, ctes = set(), set()
    for _, x in _walk(plan):
        kind = x.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = x.multipartIdentifier()
            names.add(".".join(parts.apply(i).lower() for i in range(parts.length())))
        elif kind == "UnresolvedWith":
            ctes |= {x.cteRelations().apply(i)._1().lower() for i in range(x.cteRelations().length())}
    return names - ctes


@dataclass
class Result:
    columns: list[str]
    rows: list[tuple]
    truncated: bool = False
    error: str | None = None


class GuardedSession:
    """Views of the objects that a caller may see, and nothing else, in a session of its own."""

    def __init__(self, spark: SparkSession, objects: list, tables: dict[str, DataFrame], principal=None):
        """objects: rows of the catalog; tables: their data by qname."""
        if principal is not None and len(principal.roles) > MAX_ROLES:
            raise ValueError(f"more than {MAX_ROLES} roles")
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        for k, v in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))):
            self.session.conf.set(k, v)
        self.names: dict[str, str] = {}
        bare: dict[str, int] = {}
        shown = [o for o in objects if may_see(o["roles"], principal) and qname_of(o) in tables]
        for o in shown:
            bare[o["name"].lower()] = bare.get(o["name"].lower(), 0) + 1
        for o in shown:
            q = qname_of(o)
            hidden = {c["name"].lower() for c in o["columns"] if not may_see(c["roles"], principal)}
            df = tables[q]
            view = "v" + uuid.uuid4().hex
            plan = df.select(*[df[c] for c in df.columns if c.lower() not in hidden])
            plan.createOrReplaceTempView(view)
            self._adopt(spark, view)
            # A qualified name has to match whole; a bare one only if it is not ambiguous.
            self.names[q.lower()] = view
            if bare[o["name"].lower()] == 1:
                self.names[o["name"].lower()] = view

    def _adopt(self, spark: SparkSession, view: str) -> None:
        """Moves a view to this session."""
        jdf = spark.table(view)._jdf.logicalPlan()
        own = self.session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.session._jsparkSession, jdf)
        own.createOrReplaceTempView(view)
        spark.catalog.dropTempView(view)

    def check(self, sql: str) -> str:
        """The statement, if it is a read of visible objects (C4)."""
        text = check_read_only(self.session, sql)
        for name in referenced(self.session, text):
            if name not in self.names:
                raise UnsafeSQL(f"not an object you can read: {name}")
        return text

    def sql(self, sql: str) -> DataFrame:
        text = self.check(sql)
        for name, view in self.names.items():
            if "." not in name:
                DataFrame(self.session.table(view)._jdf, self.session).createOrReplaceTempView(name)
        for name in {n for n in self.names if "." in n}:
            text = self._qualified(text, name)
        return self.session.sql(text)

    def _qualified(self, text: str, name: str) -> str:
        parts = [rf"`?{re.escape(p)}`?" for p in name.split(".")]
        # String literals are passed over.
        found = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|((?<![\w.`])" + r"\s*\.\s*".join(parts) + r"(?![\w`]))"
        return re.sub(found, lambda m: self.names[name] if m[1] else m[0], text, flags=re.I)

    def run(self, sql: str, limit: int = DEFAULT_ROWS) -> Result:
        """Rows of a statement, at most limit; one more is fetched to tell whether there are more."""
        limit = max(1, min(limit, MAX_ROWS))
        try:
            df = self.sql(sql)
            rows = [tuple(r) for r in df.limit(limit + 1).collect()]
        except UnsafeSQL as e:
            return Result([], [], error=str(e))
        except Exception as e:  # noqa: BLE001  what Spark says of a caller's statement goes to the caller
            return Result([], [], error=str(e).split("\n")[0][:300])
        return Result(df.columns, rows[:limit], truncated=len(rows) > limit)
