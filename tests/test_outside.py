"""What stands at the edge of the engine: providers, kept connections, dialects, commands, routes, files and streams."""

import json
import os
import stat
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from lodeseek import cli
from lodeseek.model import column, obj
from lodeseek.operators.select import Catalog
from lodeseek.plans.answer import CallableProvider
from lodeseek.plans.providers import HttpProvider, auto_provider, available_providers
from lodeseek.service import Tools, serve
from lodeseek.sources import reflect
from lodeseek.sources.files import read_files, write_files
from lodeseek.sources.remember import ConnectionMemory
from lodeseek.streaming import windows


def test_providers():
    replies = {
        "chat": {"choices": [{"message": {"content": "said"}}]}, "messages": {"content": [{"type": "text", "text": "sa"}, {"text": "id"}]},
        "contents": {"candidates": [{"content": {"parts": [{"text": "said"}]}}]},
    }
    for form, reply in replies.items():
        seen = []
        p = HttpProvider("http://h/x", "m", form, "k1", {"X-More": "1"}, post=lambda *a, reply=reply, seen=seen: seen.append(a) or reply)
        assert p.complete("sys", "ask", 7) == "said"
        url, headers, body = seen[0]
        assert url == "http://h/x" and headers["X-More"] == "1" and any("k1" in v for v in headers.values())
        assert "k1" not in json.dumps(body) and all(x in json.dumps(body) for x in ("sys", "ask", "7"))
        with pytest.raises(RuntimeError, match="another form"):
            HttpProvider("http://h", "m", form, post=lambda *a: {"no": 1}).complete("", "")
    with pytest.raises(NotImplementedError):
        p.embed(["a"])
    e = HttpProvider("u", "m", embed_url="v", post=lambda *a: {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})
    assert e.embed(["a", "b"]) == [[1.0], [2.0]]

    def failing(*a):
        raise OSError("refused with secret-key-1")

    with pytest.raises(RuntimeError) as told:
        HttpProvider("u", "m", key="secret-key-1", post=failing).complete("", "")
    assert "secret-key-1" not in str(told.value)
    with pytest.raises(ValueError):
        HttpProvider("u", "m", "other")
    env = {"LODESEEK_MODEL_URL": "http://h", "LODESEEK_MODEL": "m", "LODESEEK_LOCAL_MODEL": "x"}
    assert available_providers(env) == ["http", "local"] and auto_provider(env).url == "http://h" and auto_provider({}) is None and auto_provider({"LODESEEK_LOCAL_MODEL": "x"}).name == "x"


def test_memory(tmp_path):
    path = str(tmp_path / "own" / "c.json")
    assert not ConnectionMemory(path).save("a", {"host": "h"}) and not os.path.exists(path)
    m = ConnectionMemory(path, True)
    assert m.all() == {} and m.save("a", {"host": "h", "password": "p", "api_key": "no", "port": None}) and m.save("b", {"url": "u"}) and not m.save("c", {"api_key": "x"})
    assert m.all() == {"a": {"host": "h", "password": "p"}, "b": {"url": "u"}} and stat.S_IMODE(os.stat(path).st_mode) == 0o600
    assert m.forget("a") and not m.forget("a") and list(m.all()) == ["b"]
    for text, want in (('{"version": 1, "connection": {"host": "h", "model": "x"}}', {"default": {"host": "h"}}), ("{", {}), ("[]", {}), ('{"connections": 3}', {})):
        with open(path, "w") as f:
            f.write(text)
        assert m.all() == want


def test_dialects(spark, monkeypatch):
    def load(query):
        low = query.lower()
        if "all_tab_columns" in low or "information_schema.columns" in low:
            rows = [("APP", "ORD", "ID", "NUMBER", "NO", 1), ("APP", "ORD", "STATE", "mood", "YES", 2), ("APP", "ORD", "X", "UNDEFINED", "YES", 3), ("APP", "CUST", "ID", "NUMBER", "NO", 1), ("SYS$A", "T", "ID", "NUMBER", "NO", 1)]
            return spark.createDataFrame(rows, "S string, T string, C string, TYPE string, N string, P int")
        if "all_constraints" in low or "table_constraints" in low:
            return spark.createDataFrame([("APP", "ORD", "ID", "PRIMARY KEY", "PK", 1, None, None), ("APP", "ORD", "X", "FOREIGN KEY", "FK", 1, "CUST", "ID")], "S string, T string, C string, KIND string, NAME string, P int, RT string, RC string")
        return spark.createDataFrame([], "S string, T string, D string")

    for dialect in ("oracle", "postgresql"):
        hooks = type(reflect.HOOKS[dialect])()
        monkeypatch.setitem(reflect.HOOKS, dialect, hooks)
        monkeypatch.setattr(hooks, "types", lambda *a, **k: {"mood": "ENUM('a', 'b')", "app.ord.x": "GEOMETRY", "number": "NUMBER"})
        found = {o["name"]: o for o in reflect.reflect_jdbc(spark, "jdbc:none", dialect, load=load)}
        assert set(found) == ({"ORD", "CUST"} if dialect == "oracle" else {"ORD", "CUST", "T"})
        assert [c["type"] for c in found["ORD"]["columns"]] == ["NUMBER", "ENUM('a', 'b')", "GEOMETRY"] and found["ORD"]["columns"][0]["pk"]
        assert found["ORD"]["foreign_keys"][0]["ref_table"] == "CUST"
    # A query that fails leaves types as they are.
    assert reflect.PostgreSQL().types(spark, "jdbc:none:x") == {} and "udt_name" in reflect.PostgreSQL().queries()["columns"]


def test_commands(spark, capsys, monkeypatch):
    c = Catalog(spark).add(obj("t", columns=[column("a")])).add(obj("u", columns=[column("b")], description="There. | x"))
    assert cli.describe(c) == 0 and "TABLE t: a" in capsys.readouterr().out
    assert cli.describe(c, provider=CallableProvider(lambda *a: "Rows of things, one a day. | words")) == 0
    assert c.find("t")["description"] == "Rows of things, one a day. | words" and c.find("u")["description"] == "There. | x"


def test_routes(spark, tmp_path):
    def build():
        c = Catalog(spark).add(obj("shop_order", columns=[column("id", "int", pk=True)])).add(obj("hidden", columns=[column("x")], roles=["r"]))
        return c, {"shop_order": spark.range(3).toDF("id"), "hidden": spark.range(1).toDF("x")}

    memory = ConnectionMemory(str(tmp_path / "c.json"), True)
    tools = Tools(spark, build, CallableProvider(lambda *a: "Orders of the shop, a row each. | sales"))
    server = serve(tools, memory=memory, connect=lambda body: build())
    base = f"http://127.0.0.1:{server.server_port}"

    def get(path):
        return urllib.request.urlopen(base + path).read().decode()

    def post(path, body):
        try:
            return json.loads(urllib.request.urlopen(urllib.request.Request(base + path, body if isinstance(body, bytes) else json.dumps(body).encode(), method="POST")).read())
        except urllib.error.HTTPError as e:
            return {"code": e.code}

    assert "shop_order" in get("/") and "hidden" not in get("/") and json.loads(get("/api/objects"))["total"] == 2
    assert json.loads(get("/api/settings"))["described"] == 0 and json.loads(get("/api/health"))["objects"] == 2
    assert post("/api/hints", {"hints": {"shop_order": "sales of the shop", "nowhere": "x"}}) == {"hints": {"shop_order": "sales of the shop"}}
    assert "shop_order" in post("/api/select", {"question": "sales"})["ddl"] and post("/api/settings", {"top_k": 900})["top_k"] <= 50
    said = post("/api/describe", {"names": ["shop_order"]})["descriptions"]
    assert said == {"shop_order": "Orders of the shop, a row each. | sales"} and post("/api/apply-descriptions", {"descriptions": said}) == {"applied": 1}
    assert post("/api/resync", {})["hints"] == 1 and tools.catalog.find("shop_order")["description"] and tools.catalog.find("shop_order")["hint"]
    assert post("/api/glossary", {"glossary": {"takings": "sales", "": "x"}}) == {"glossary": {"takings": "sales"}}
    assert post("/api/connect", {"name": "a", "host": "h", "password": "p", "remember": True}) == {"objects": 2, "remembered": True}
    assert post("/api/connections", {}) == {"connections": [{"name": "a", "kind": None, "host": "h"}]} and post("/api/connections", {"forget": "a"}) == {"connections": []}
    assert post("/api/models", {})["configured"] and post("/api/nope", {})["code"] == 404 and post("/api/select", b"{")["code"] == 400 and post("/api/select", b"[]")["code"] == 400
    assert post("/api/apply-descriptions", {})["code"] == 400 and "error" in post("/api/run_query", {"sql": "DROP TABLE shop_order"})
    server.shutdown()


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,\n\"b\"", 1.5), (2, None, None)], "k int, t string, x double")
    for kind in ("parquet", "orc", "json"):
        write_files(rows, f"{tmp_path}/t.{kind}")
        assert sorted(map(tuple, read_files(spark, f"{tmp_path}/t.{kind}", schema="k int, t string, x double").collect())) == sorted(map(tuple, rows.collect()))
    write_files(rows.select("k", "x"), f"{tmp_path}/t.csv")
    assert {tuple(r) for r in read_files(spark, f"{tmp_path}/t.csv").collect()} == {(1, 1.5), (2, None)}
    write_files(rows.select("t").where("t IS NOT NULL"), f"{tmp_path}/t.txt")
    assert read_files(spark, f"{tmp_path}/t.txt").count() == 2
    with pytest.raises(ValueError):
        read_files(spark, "t.xml")


def test_late_events_are_dropped(spark, tmp_path):
    """Two batches: a row later than the watermark allows does not count, one within it does."""
    folder, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    counts = {"n": F.count(F.lit(1))}
    batch = lambda rows: spark.createDataFrame(rows, "ts string, u int").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(folder)
    batch([("2024-01-01 00:01:00", 1), ("2024-01-01 02:00:00", 1)])
    stream = lambda: windows.windowed(spark.readStream.schema("ts timestamp, u int").parquet(folder), counts, "10 minutes", late="30 minutes")
    windows.run_once(stream(), out, state, "append")
    batch([("2024-01-01 00:02:00", 2), ("2024-01-01 01:45:00", 2), ("2024-01-01 05:00:00", 2)])
    got = windows.run_once(stream(), out, state, "append")
    assert {(r.since.strftime("%H:%M"), r.n) for r in got.collect()} == {("00:00", 1), ("01:40", 1), ("02:00", 1)}


def test_shared_folder(spark, monkeypatch):
    from lodeseek import session

    path = session.fresh_path(spark, "sweep-test")
    spark.range(3).write.parquet(path)
    other = session.shared_dir(spark) + "/not-ours"
    spark.range(3).write.mode("overwrite").parquet(other)
    assert session.sweep(spark, 24) == 0 and spark.read.parquet(path).count() == 3
    scratch = session.Scratch(spark)
    kept, gone = scratch.write(spark.range(5).toDF("id"), "kept", 5), scratch.write(spark.range(5).toDF("id"), "gone")
    scratch.clear(kept)
    assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)not.exist|no such file"):
        gone.count()
    session.remove(spark, path)
    session.remove(spark, other)

    class Far:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Far())
