"""Contracts of the engine's operators, on literal cases."""

import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import text as X
from lodeseek.functions.vectors import CallableEmbedder, HashingEmbedder
from lodeseek.model import Principal, column, foreign_key, obj
from lodeseek.operators import access, graph
from lodeseek.operators.describe import DescriptionCache, Describer, clean_description, is_usable, looks_truncated
from lodeseek.operators.render import estimate, format_rows, render_ddl
from lodeseek.operators.select import Catalog, choose, rerank_prompt
from lodeseek.operators.store import local_store
from lodeseek.plans import relational
from lodeseek.service import Tools, retriever, serve
from lodeseek.sources import config, connect, demo, ords, reflect
from lodeseek.streaming.changes import upsert_stream


def value(spark, expr, kind="string", *rows):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_tokens_stems_and_folds(spark):
    assert value(spark, X.tokenize, "string", "customerOrders_2x", "facturación Straße", "売上明細 ab", None, "--") == [["customer", "orders", "2x"], ["facturacion", "strasse"], ["売", "上", "明", "細", "売上", "上明", "明細", "ab"], [], []]
    assert value(spark, X.stem, "string", "queries", "boxes", "classes", "glass", "orders", "bus", "ties") == ["query", "box", "classe", "glass", "order", "bus", "tie"]
    assert value(spark, X.expand_joins, "array<string>", ["ware", "house", "2"], ["internationalisation", "x"]) == [["ware", "house", "2", "warehouse"], ["internationalisation", "x"]]
    assert value(spark, X.acronyms, "array<string>", ["net", "asset", "value", "7"]) == [["na", "av", "nav"]]
    assert value(spark, lambda c: X.parse_choice(c, F.lit(20), F.lit(3)), "string", "**3**, 7 and main.t3, tbl_183, 7, 47, 1 2", None) == [[3, 7, 1], []]
    assert value(spark, X.estimate_tokens, "string", "abcdefghij a 12!", None) == [6, 0]
    assert estimate("abcdefghij a 12!") == 6 and choose("3, t.4, 99, 3 1", 5, 9) == [3, 1]


def test_principal():
    p = Principal("oidc:ann", {"hr"})
    assert len(p.scope()) == 16
    p.require("hr", "x")
    with pytest.raises(PermissionError):
        p.require("admin")
    for bad in ("ann", ":x", "a:", ""):
        with pytest.raises(ValueError):
            Principal(bad)


def test_vectors(spark):
    df = spark.createDataFrame([(1, "customer order"), (2, ""), (3, None)], "k int, t string")
    got = {r.k: r.vec for r in HashingEmbedder(64).embed_column(df, F.col("t")).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1) and not any(got[2]) and not any(got[3])
    assert got[1] == pytest.approx(HashingEmbedder(64).vector(["customer", "order"]))
    with pytest.raises(ValueError):
        HashingEmbedder(16)
    call = CallableEmbedder(lambda ts: [[float(len(t)), 1.0] for t in ts], 2)
    assert len(call.embed_column(df, F.col("t")).collect()) == 3
    with pytest.raises(ValueError):
        CallableEmbedder(lambda ts: [[1.0]] * len(ts), 2)._vectors(["a"])


def test_store(spark, tmp_path):
    s = local_store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", "k1", [1.0, 0.0], None, None), ("a", "k2", [0.0, 1.0], None, "s1"), ("b", "k1", [1.0, 0.0], {"x": "y"}, None)], "ns string, key string, vec array<double>, payload map<string,string>, scope string")
    s.upsert(rows)
    s.upsert(rows.where("ns = 'a' AND key = 'k1'").withColumn("vec", F.array(F.lit(0.6), F.lit(0.8))))
    assert s.count("a") == 1 and s.count("a", "s1") == 2
    assert [r.key for r in s.search("a", [0.0, 1.0], 5, 2.0, "s1").collect()] == ["k2", "k1"]
    assert s.get("a", "k2") is None and s.get("a", "k2", "s1").vec == [0.0, 1.0]
    assert s.purge("a") == 2 and s.count("b") == 1
    src = tmp_path / "src"
    rows.write.parquet(str(src))
    q = upsert_stream(spark.readStream.schema(rows.schema).parquet(str(src)), s, str(tmp_path / "cp"))
    q.awaitTermination()
    assert s.count("a", "s1") == 2


@pytest.fixture(scope="module")
def shop(spark):
    c = Catalog(spark).add_all(demo.demo_objects())
    c.infer_foreign_keys()
    return c


def test_selection(spark, shop):
    for q, gold in demo.GOLDEN.items():
        assert gold <= set(shop.select(q).table_names()), q
    assert shop.shadows() == {"sales_order_bkp": "sales_order"}
    names = shop.select("sales order", top_k=3).table_names()
    assert names[0] == "sales_order" and shop.select("x", top_k=0, expand_fks=False).hits == []
    hidden = shop.select("compensation", top_k=20)
    assert "hr_compensation" not in hidden.table_names() and "hr_compensation" not in hidden.prompt_fragment()
    assert "hr_compensation" in shop.select("compensation", principal=Principal("u:1", {"payroll"})).table_names()
    pinned = shop.select("stock", top_k=1, pin=["hr_employee", "cat_product"], expand_fks=False)
    assert pinned.table_names() == ["hr_employee", "cat_product"] and pinned.hits[0].reason == "pinned"
    picked = shop.select("stock on hand", reranker=lambda p: "2", expand_fks=False)
    assert picked.table_names()[0] == shop.select("stock on hand", expand_fks=False).table_names()[1]
    assert shop.select("stock", reranker=lambda p: 1 / 0).table_names() == shop.select("stock").table_names()
    assert any(h.reason == "fk" for h in shop.select("billing invoice", top_k=1).hits)
    assert json.loads(hidden.to_json())["roles"] == [] and 0 < shop.select("stock").savings() < 1
    assert "1. " in rerank_prompt("q", shop._index[0].limit(1).collect())


def test_edits_and_rendering(spark):
    c = Catalog(spark).add(obj("t", "s", columns=[column("a", "int", False, "note", True), column("b", "text", roles=["x"], values=["u"])], foreign_keys=[foreign_key(["b"], "r"), foreign_key(["a"], "r")], description="Things | stuff"))
    c.add(obj("r", "s", columns=[column("id", "int")], roles=["x"]))
    row = c.objects().first()
    assert render_ddl(row) == "-- Things\nTABLE s.t (\n  a int PK NOT NULL  -- note\n)\n-- FK t(a) -> r"
    assert render_ddl(row, hidden=frozenset({"r"})).endswith(")") and "one of: 'u'" in render_ddl(row, Principal("u:1", {"x"}))
    c.restrict_column("t", "A", ["y"])
    assert "a int" not in render_ddl(c.objects().first())
    c.hint("t", ["one", "two"])
    assert c.find("s.t")["hint"] == "one, two" and c.describe({"r": "Refs."}) == 1
    with pytest.raises(KeyError):
        c.restrict("nowhere", ["x"])
    assert format_rows(["a", "long"], [(1, "x" * 40), (None, "y")]).splitlines()[1].endswith("…")


def test_grants(spark):
    objects = spark.createDataFrame([(0, "S", "T", None), (1, "s", "u", ["old"]), (2, None, "v", None)], "ordinal long, schema string, name string, roles array<string>")
    grants = spark.createDataFrame([("s", "t", "a"), (None, "v", "PUBLIC"), (None, "v", "b")], "schema string, object string, grantee string")
    roles = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "role string, inheritor string")
    out, report = access.apply_grants(objects, grants, roles)
    assert {r.name: r.roles for r in out.collect()} == {"T": ["a", "b", "c"], "u": ["old"], "v": None}
    assert (report.restricted, report.public, report.untouched, report.unmatched) == (1, 1, 1, ["u"])
    assert access.apply_grants(objects, grants)[1].warnings


def test_backups_and_partitions(spark):
    names = ["_backup", "led_bak_2026_01_02", "ev", "ev_p7", "ev_y2025m03", "ev_2026", "dim_member", "stg_member", "x_v2", "x"]
    rows = Catalog(spark).add_all([obj(n, columns=[column("id")]) for n in names]).objects()
    got = {names[r.ordinal]: r.base for r in graph.shadows(rows).collect()}
    assert got == {"led_bak_2026_01_02": "led", "ev_p7": "ev", "ev_y2025m03": "ev", "ev_2026": "ev", "stg_member": "dim_member", "x_v2": "x"}


def test_descriptions(spark, tmp_path):
    text = clean_description("Sure! Here is the description: **The cust_ord table holds** one row per order line. | orders, qty, sales lines; orders", ("s.cust_ord", "cust_ord"), frozenset({"qty"}))
    assert text == "One row per order line. | orders, sales lines"
    assert looks_truncated("cut off") and not looks_truncated("Done.") and not is_usable("cust_ord.", ("cust_ord",)) and clean_description(None) == ""
    assert clean_description("Okay. Answer: - orders - by day | `Orders`, a list of far too many words, orders") == "Orders - by day | orders"
    assert clean_description("Here are the facts about it: The shop view lists 1. things", ("shop",)) == "1. things"
    assert clean_description("Results of all tests, sure: kept.") == "Results of all tests, sure: kept." and clean_description("w " * 70) == "W" + " w" * 59
    assert is_usable("Rows of it. | a", require_aliases=True) and not is_usable("Rows of it.", require_aliases=True)
    c = Catalog(spark).add(obj("a", columns=[column("id")])).add(obj("b", columns=[column("id")]))
    path = str(tmp_path / "cache.json")
    d = Describer(lambda p: "Rows of things. | words" if " a:" in p else 1 / 0, cache=DescriptionCache(path))
    assert d.describe(c.objects()) == {"a": "Rows of things. | words"} and d.failures == ["b"]
    assert Describer(lambda p: 1 / 0, cache=DescriptionCache(path)).describe(c.objects().limit(1)) == {"a": "Rows of things. | words"}
    (tmp_path / "bad.json").write_text("{")
    assert DescriptionCache(str(tmp_path / "bad.json")).found == {}


def test_connections(tmp_path):
    c = connect.resolve("postgres+psycopg://ann:p%40ss@db:5433/shop?sslmode=require")
    assert c.jdbc()[0] == "jdbc:postgresql://db:5433/shop" and c.jdbc()[1]["password"] == "p@ss" and c.jdbc()[1]["sslmode"] == "require"
    assert connect.resolve("jdbc:sqlserver://h:1;databaseName=d;user=u;password=p").jdbc()[0] == "jdbc:sqlserver://h:1;databaseName=d"
    assert connect.resolve("jdbc:oracle:thin:u/p@//h:1521/svc").jdbc()[0] == "jdbc:oracle:thin:@//h:1521/svc"
    assert connect.resolve({"kind": "mysql", "host": "h", "database": "d"}).jdbc()[0] == "jdbc:mysql://h:3306/d"
    assert "p@ss" not in connect.redact("postgresql://ann:pass1@db password=hunter22 p@ss", "p@ss") and "hunter22" not in connect.redact("password=hunter22")
    with pytest.raises(ValueError):
        connect.resolve("foo://x")
    (tmp_path / "tnsnames.ora").write_text("db_high = (DESC...)\n")
    assert connect.oracle_wallet(str(tmp_path), "DB_HIGH").options["oracle.net.tns_admin"] == str(tmp_path)


def test_sources(spark, tmp_path, monkeypatch):
    spark.sql("CREATE OR REPLACE TEMP VIEW seen AS SELECT 1 AS a, 'x' AS b")
    found = {o["name"]: o for o in reflect.reflect_catalog(spark, include=["S%"])}
    assert [c["name"] for c in found["seen"]["columns"]] == ["a", "b"] and found["seen"]["kind"] == "VIEW"
    assert reflect.matches_text("A_b", ["a_%"]) and not reflect.matches_text("axb", ["a_b"]) and reflect.internal_schema("PG_catalog") and reflect.internal_schema("X$Y", "oracle")
    cols = spark.createDataFrame([("s", "t", "id", "int", "NO", 1), ("s", "t", "r", "int", "YES", 2)], "s string, t string, c string, type string, n string, p int")
    keys = spark.createDataFrame([("s", "t", "id", "PRIMARY KEY", "k", 1, None, None), ("s", "t", "r", "FOREIGN KEY", "f", 1, "ref", "id")], "s string, t string, c string, kind string, name string, p int, rt string, rc string")
    views = spark.createDataFrame([("s", "v", "SELECT 1")], "s string, t string, d string")
    (t,) = reflect.assemble(cols, keys, views)
    assert t["columns"][0]["pk"] and not t["columns"][0]["nullable"] and t["foreign_keys"][0]["ref_table"] == "ref"
    reply = {"tables": [{"t": "T", "n": 5}], "views": [], "columns": [{"t": "T", "c": "ID", "type": "NUMBER", "n": "N", "p": 1}], "comments": [], "column_comments": [], "keys": [{"t": "T", "c": "ID"}], "foreign": []}
    (o,) = ords.reflect_ords(spark, "https://h/ords", "app", "u", "p", run=lambda *a: reply)
    assert o["columns"][0]["pk"] and ords.base_url("https://h/ords/", "app") == "https://h/ords/app/_/sql"
    with pytest.raises(ValueError):
        ords.base_url("http://h", "a")
    monkeypatch.setenv("LODESEEK_CONNECT_OPTIONS", '{"a": 1, "b": 2}')
    assert reflect.options_from_env({"b": 3}) == {"a": 1, "b": 3}
    monkeypatch.setenv("LODESEEK_CONNECT_OPTIONS", "{")
    with pytest.raises(ValueError):
        reflect.options_from_env()
    c = Catalog(spark).add(obj("t", columns=[column("a")]))
    assert config.load(str(tmp_path / "none")) == {} and config.apply(c, {"hint": {"t": "h", "u": "x"}, "restrict": {"t:a": ["r"], "t": ["q"]}}) == ["u"]
    config.merge_descriptions(str(tmp_path / "c.json"), {"t": "D"})
    assert config.load(str(tmp_path / "c.json")) == {"describe": {"t": "D"}}


def test_service(spark, shop):
    tables = demo.demo_tables(spark)
    build = lambda: (shop, tables)
    from lodeseek.plans.answer import CallableProvider

    tools = Tools(spark, build, CallableProvider(lambda *a: "SELECT count(*) AS n FROM sales_order"), {"unpaid": "status open"})
    assert tools.call("answer", {"question": "How many orders?"})["rows"] == [[3]]
    assert "error" in tools.call("run_query", {"sql": "SELECT * FROM hr_compensation"}) and "error" in tools.call("nope") and "error" in tools.call("list_objects", {"subject": "bad"})
    assert "hr_compensation" not in tools.call("list_objects")["objects"] and "error" in tools.call("describe_object", {"name": "hr_compensation"})
    assert retriever(tools)("stock on hand")[0]["metadata"]["object"]
    server = serve(tools)
    got = urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/health").read()
    assert json.loads(got)["objects"] == len(shop) and threading.active_count() > 1
    server.shutdown()


def test_searches_in_blocks_agree(spark, monkeypatch):
    """Blocks of any size, and few rows at a time, give what the distances of column expressions give."""
    from lodeseek.functions.vectors import DISTANCES
    from lodeseek.operators import nearest

    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0] if k else [0.0] * 3, None if k % 3 else "s") for k in range(60)], "key long, vec array<double>, scope string")
    rows = rows.unionByName(rows.where("key < 4"))
    asked = rows.where("key % 4 = 0").distinct().select(F.col("key").cast("int").alias("qid"), F.col("vec").alias("qvec"), F.when(F.col("key") > 8, "s").alias("qscope"))
    pairs = asked.crossJoin(rows).where("scope IS NULL OR scope = qscope")
    for metric, distance in DISTANCES.items():
        want = {}
        for r in pairs.select("qid", "key", F.round(distance(F.col("vec"), F.col("qvec")), 9).alias("d")).collect():
            want.setdefault(r.qid, []).append((r.d + 0.0, r.key))
        want = {q: [x for x in sorted(v)[:4] if x[0] <= 2.0] for q, v in want.items()}
        for size, held in ((1 << 20, 1 << 20), (48, 1 << 20), (1 << 20, 1)):
            monkeypatch.setattr(nearest, "HELD", held)
            got = {}
            for r in nearest.nearest_many(asked, rows, 4, 2.0, metric, places=9, block_bytes=size).orderBy("qid", "rank").collect():
                got.setdefault(r.qid, []).append((r.distance, r.key))
            assert got == {q: v for q, v in want.items() if v}, metric
    assert nearest.nearest_many(asked.limit(0), rows).count() == 0 == nearest.nearest_many(asked, rows.limit(0)).count()


def test_store_survives_a_failed_write(spark, tmp_path):
    s = local_store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", f"k{i}", [float(i)], {"b": "2", "a": str(i)}, None) for i in range(40)], "ns string, key string, vec array<double>, payload map<string,string>, scope string")
    s.upsert(rows)
    before = s._parts()
    s._commit, kept = lambda *a: 1 / 0, s._commit
    with pytest.raises(ZeroDivisionError):
        s.upsert(rows.withColumn("vec", F.array(F.lit(9.0))))
    s._commit = kept
    assert s.count("a") == 40 and s.get("a", "k7").vec == [7.0]
    # Another writer in between is noticed.
    with pytest.raises(RuntimeError):
        s._commit(before, 0)
    s.upsert(rows.where("key = 'k7'").withColumn("vec", F.array(F.lit(8.0))))
    changed = {k for k, v in s._parts().items() if before[k] != v}
    assert len(changed) == 1 and s.get("a", "k7").vec == [8.0] and s.count("a") == 40
    twice = rows.where("key = 'k1'").unionByName(rows.where("key = 'k1'").withColumn("payload", F.create_map(F.lit("z"), F.lit("1"))))
    for again in (twice, twice.orderBy(F.desc(F.to_json("payload")))):
        s.upsert(again)
        assert s.get("a", "k1").payload == {"z": "1"}
    assert len(s._versions()) == 2 and s.purge("a") == 40 and s.count("a") == 0 and s.purge("a") == 0


def test_rel_json_parses_every_event(spark, tmp_path):
    rows = [(k, json.dumps({"k": k, "x": [1]})) for k in (0, 499, 500, 501, 9999, 10**9)] + [(700, None), (701, '{"x": 1}'), (702, "no json"), (703, '{"k": "a b"}')]
    spark.createDataFrame(rows, "event_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.k, r.no_props) for r in relational.QUERIES["rel_json"](spark, str(tmp_path)).collect()}
    assert got == {k: (str(k), False) for k in (0, 499, 500, 501, 9999, 10**9)} | {700: (None, True), 701: (None, False), 702: (None, False), 703: ("a b", False)}


def test_one_question_ranks_like_many(spark, shop):
    """The driver's ranking is that of the plan for many questions: places, scores and channels, for each caller."""
    from lodeseek.operators.select import Catalog as C

    names = ["net_asset_value", "warehouse_count", "ärzte_daten", "売上_明細", "sales_order", "order", "queries_of_classes", "orders_bak_20260101", "straße"]
    other = C(spark).add_all([obj(n, "s" if k % 2 else None, columns=[column("id", pk=True), column(f"{n}_id")], description=f"All of {n} | {n[:4]} things", roles=["r"] if k == 4 else None) for k, n in enumerate(names)])
    asked = [*demo.GOLDEN, *demo.PARAPHRASES, "", "sales order", "NAV of the ware house", "net asset value", "売上 detail of Ärzte", "orders orders classes", "STRASSE order", "hr compensation", "bak 2026"]
    for c, roles in ((shop, None), (shop, ["payroll"]), (other, None), (other, ["r"])):
        rows = c.scores(spark.createDataFrame(list(enumerate(asked)), "qid int, question string"), roles).collect()
        want = {}
        for r in sorted(rows, key=lambda r: (r.qid, r.place)):
            want.setdefault(r.qid, []).append((r.ordinal, round(r.score, 12), r.in_vector, r.in_body))
        c._indexed()
        seen = {k for k, r in c._by_ordinal().items() if not r["roles"] or set(r["roles"]) & set(roles or [])}
        for k, q in enumerate(asked):
            got = c._ranking(q, X.words_of(q), roles, seen, {"vector": 1.0, "body": 1.0})
            assert [(r.ordinal, round(r.score, 12), r.in_vector, r.in_body) for r in got] == want.get(k, []), q


def test_driver_forms_of_text_functions(spark):
    texts = ["customerOrders_2x", "facturación Straße Øre ǆ ﬁn ½", "売上明細ab ＡＢ", "", "a b c 1 d e f g", "net asset value of classes ties queries boxes bus", "İstanbul ΑΣ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.tokenize(F.col("t")).alias("w"))
    for r in rows.select("*", X.expand_joins(F.col("w")).alias("j"), X.acronyms(F.col("w")).alias("a"), F.transform("w", X.stem).alias("s")).collect():
        assert X.words_of(r.t) == r.w, r.t
        assert (X.with_joins(r.w), X.initials(r.w), [X.stem_word(w) for w in r.w]) == (r.j, r.a, r.s)
