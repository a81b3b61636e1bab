import pytest

from lodeseek.model import Principal, column, obj
from lodeseek.plans.answer import CallableProvider, generate_sql
from lodeseek.plans.guard import GuardedSession, UnsafeSQL, check_read_only, referenced

READS = [
    "SELECT 1", "select a, sum(b) from t group by a having sum(b) > 1 order by 1 limit 3", "WITH x AS (SELECT * FROM t) SELECT * FROM x;",
    "SELECT replace(a, 'x', 'y') FROM t", "SELECT updated_at, 'drop table t' FROM deleted_rows", "```sql\nSELECT * FROM t\n```",
    "SELECT extract(year FROM d) FROM t", "SELECT * FROM t JOIN u USING (k) WHERE EXISTS (SELECT 1 FROM w)", "VALUES (1), (2)",
    "SELECT lag(a) OVER (PARTITION BY b ORDER BY c) FROM t UNION ALL SELECT 1", "SELECT * FROM t -- note\n",
]
WRITES = [
    "", "INSERT INTO t VALUES (1)", "DELETE FROM t", "DROP TABLE t", "CREATE TABLE t AS SELECT 1", "SELECT 1; SELECT 2", "SET x = 1", "TRUNCATE TABLE t",
    "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT java_method('java.util.UUID', 'randomUUID')", "SELECT TRANSFORM(a) USING 'cat' FROM t",
    "SELECT * FROM (SELECT java_method('a', 'b') FROM t)", "WITH x AS (SELECT reflect('a', 'b')) SELECT * FROM x", "SELECT * FROM t WHERE a IN (SELECT reflect('a', 'b'))",
    "CACHE TABLE t", "DESCRIBE t", "not sql", "SELECT my.fn(a) FROM t", "EXPLAIN SELECT 1", "MERGE INTO t USING u ON t.a = u.a WHEN MATCHED THEN DELETE",
]


@pytest.mark.parametrize("sql", READS)
def test_reads_pass(spark, sql):
    assert check_read_only(spark, sql)


@pytest.mark.parametrize("sql", WRITES)
def test_everything_else_is_refused(spark, sql):
    with pytest.raises(UnsafeSQL):
        check_read_only(spark, sql)


def test_all_relations_are_found(spark):
    sql = "WITH c AS (SELECT * FROM a) SELECT (SELECT max(x) FROM b), k FROM c, `D` WHERE EXISTS (SELECT 1 FROM s.e) AND k IN (SELECT k FROM f)"
    assert referenced(spark, sql) == {"a", "b", "d", "s.e", "f"}


@pytest.fixture(scope="module")
def guarded(spark):
    cols = [column("k", "int"), column("ssn", "string", roles=["hr"])]
    objects = [obj("open", "app", columns=cols), obj("account", "crm", columns=cols), obj("account", "sec", columns=cols, roles=["admin"])]
    data = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "k int, ssn string")
    tables = {"app.open": data, "crm.account": data, "sec.account": data}
    return lambda p=None: GuardedSession(spark, objects, tables, p)


def test_rows_and_truncation(guarded):
    got = guarded().run("SELECT k FROM open ORDER BY k", 3)
    assert (got.columns, got.rows, got.truncated, got.error) == (["k"], [(0,), (1,), (2,)], True, None)
    assert guarded().run("SELECT count(*) n, 'app.open' s FROM app.open").rows == [(5, "app.open")]


@pytest.mark.parametrize(
    "sql",
    ["SELECT * FROM sec.account", "SELECT * FROM open, sec.account", "SELECT * FROM `sec`.`account`", "WITH account AS (SELECT * FROM sec.account) SELECT * FROM account",
     "SELECT ssn FROM open", "SELECT * FROM parquet.`/tmp`", "SELECT * FROM nowhere", "SELECT (SELECT max(k) FROM sec.account)"],
)
def test_what_is_hidden_stays_hidden(guarded, sql):
    assert guarded().run(sql).error


def test_roles_open_objects_and_columns(guarded):
    s = guarded(Principal("u:1", {"admin", "hr"}))
    assert s.run("SELECT max(ssn) FROM sec.account").rows == [("s4",)]
    assert s.run("SELECT * FROM account").error  # two of that name


def test_generate(spark):
    replies = iter(["INSUFFICIENT", "```sql\nSELECT 1\n```"])
    assert generate_sql(spark, CallableProvider(lambda *a: next(replies)), "q", "f") == "SELECT 1"
    with pytest.raises(UnsafeSQL):
        generate_sql(spark, CallableProvider(lambda *a: "INSUFFICIENT"), "q", "f")
    with pytest.raises(UnsafeSQL):
        generate_sql(spark, CallableProvider(lambda *a: "DROP TABLE t"), "q", "f")
