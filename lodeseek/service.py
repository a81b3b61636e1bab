"""Operations for callers: tools by name, and the same over HTTP."""

import html
import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from lodeseek.model import Principal
from lodeseek.operators.describe import Describer
from lodeseek.operators.render import may_see, qname_of, render_ddl
from lodeseek.operators.select import Catalog, expand_glossary
from lodeseek.plans.answer import Provider, generate_sql
from lodeseek.plans.guard import MAX_QUESTION, MAX_TOP_K, GuardedSession
from lodeseek.plans.providers import available_providers
from lodeseek.sources.remember import ConnectionMemory


class Tools:
    """select_schema, list_objects, describe_object, run_query, answer, refresh_catalog and health (U2). Errors are returned, not raised."""

    def __init__(self, spark, build: Callable[[], tuple[Catalog, dict]], provider: Provider | None = None, glossary: dict[str, str] | None = None):
        self.spark, self.build, self.provider, self.glossary = spark, build, provider, glossary or {}
        self._lock = threading.Lock()
        self.catalog, self.tables = build()

    NAMES = ("select_schema", "list_objects", "describe_object", "run_query", "answer", "refresh_catalog", "health")

    def call(self, tool: str, arguments: dict | None = None) -> dict:
        try:
            if tool not in self.NAMES:
                raise ValueError(f"no tool {tool}")
            args = dict(arguments or {})
            subject, roles = args.pop("subject", None), args.pop("roles", None) or []
            who = Principal(subject, frozenset(roles)) if subject else None
            return getattr(self, tool)(who, **args)
        except Exception as e:  # noqa: BLE001
            return {"error": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"}

    def _asked(self, question: str) -> str:
        text = question[:MAX_QUESTION]
        if not self.glossary:
            return text
        terms = self.spark.createDataFrame(list(self.glossary.items()), "term string, meaning string")
        return expand_glossary(self.spark.createDataFrame([(0, text)], "qid long, question string"), terms).first()["question"]

    def select_schema(self, who, question: str, top_k: int = 6) -> dict:
        picked = self.catalog.select(self._asked(question), top_k=max(1, min(int(top_k), MAX_TOP_K)), principal=who)
        return {"ddl": picked.prompt_fragment(), "audit": picked.to_dict(), "savings": picked.savings()}

    def list_objects(self, who) -> dict:
        return {"objects": [qname_of(r) for r in self.catalog.objects().orderBy("ordinal").collect() if may_see(r["roles"], who)]}

    def describe_object(self, who, name: str) -> dict:
        for r in self.catalog.objects().orderBy("ordinal").collect():
            if name.lower() in (qname_of(r).lower(), r["name"].lower()) and may_see(r["roles"], who):
                return {"ddl": render_ddl(r, who)}
        return {"error": f"no object {name}"}

    def run_query(self, who, sql: str, limit: int = 50) -> dict:
        got = GuardedSession(self.spark, self.catalog.objects().collect(), self.tables, who).run(sql, int(limit))
        return {"error": got.error} if got.error else {"columns": got.columns, "rows": [list(r) for r in got.rows], "truncated": got.truncated}

    def answer(self, who, question: str, top_k: int | None = None) -> dict:
        if self.provider is None:
            return {"error": "no model is configured"}
        make = lambda picked: generate_sql(self.spark, self.provider, question, picked.prompt_fragment())
        caveat = None
        try:
            sql = make(self.catalog.select(self._asked(question), top_k=top_k or 6, principal=who))
        except ValueError:
            # Once more with more objects, unless the caller has said how many.
            if top_k is not None:
                raise
            caveat = "more objects than usual were needed"
            sql = make(self.catalog.select(self._asked(question), top_k=15, principal=who))
        return {"sql": sql, "caveat": caveat, **self.run_query(who, sql)}

    def refresh_catalog(self, who=None) -> dict:
        """Builds anew; the former catalog stays if that fails. Descriptions are carried over."""
        with self._lock:
            fresh, tables = self.build()
            old = {q: r["description"] for q, r in self.catalog._rows.items() if r["description"]}
            fresh.describe(old)
            self.catalog, self.tables = fresh, tables
        return {"objects": len(self.catalog)}

    def health(self, who=None) -> dict:
        return {"objects": len(self.catalog), "stale": self.catalog._stale}


def retriever(tools: Tools, top_k: int = 6, principal: Principal | None = None) -> Callable[[str], list[dict]]:
    """A callable from a question to documents (U5), rendered for the caller."""

    def retrieve(question: str) -> list[dict]:
        picked = tools.catalog.select(question, top_k=top_k, principal=principal)
        return [{"page_content": render_ddl(h.row, principal, hidden=picked.hidden), "metadata": {"object": qname_of(h.row), "score": h.score, "reason": h.reason}} for h in picked.hits]

    return retrieve


class Studio:
    """What the HTTP routes do beside the tools (U3, U4): settings, hints, a glossary, descriptions, connections and models."""

    def __init__(self, tools: Tools, memory: ConnectionMemory | None = None, connect: Callable[[dict], tuple[Catalog, dict]] | None = None):
        self.tools, self.memory, self.connector = tools, memory, connect
        self.hinted: dict[str, str] = {}
        self.options = {"top_k": 6}

    def objects(self) -> dict:
        rows = sorted(self.tools.catalog._rows.values(), key=lambda r: (r["schema"] or "", r["name"]))
        told = lambda r: (r["hint"] or r["description"] or "").split(" | ")[0]
        return {"total": len(rows), "objects": [{"name": qname_of(r), "kind": r["kind"].lower(), "schema": r["schema"] or "", "columns": len(r["columns"]), "description": told(r)} for r in rows if not r["roles"]]}

    def settings(self, body: dict | None = None) -> dict:
        if body:
            if "top_k" in body:
                self.options["top_k"] = max(1, min(int(body["top_k"]), MAX_TOP_K))
        rows = self.tools.catalog._rows.values()
        return self.options | {
            "objects": len(rows), "described": sum(bool(r["description"]) for r in rows), "has_model": self.tools.provider is not None,
            "allow_connect": self.connector is not None, "remembers": bool(self.memory and self.memory.allowed),
        }

    def select(self, body: dict) -> dict:
        return self.tools.call("select_schema", {"top_k": self.options["top_k"]} | body)

    def answer(self, body: dict) -> dict:
        return self.tools.call("answer", body)

    def resync(self, body: dict) -> dict:
        """Builds the catalog anew; descriptions and hints are carried over."""
        out = self.tools.call("refresh_catalog")
        return out if "error" in out else out | {"hints": len(self.hints({"hints": self.hinted})["hints"])}

    def hints(self, body: dict) -> dict:
        """Hints by object; those of objects that are not there are left out."""
        for name, text in (body.get("hints") or {}).items():
            try:
                self.tools.catalog.hint(name, text)
                self.hinted[name] = text
            except KeyError:
                continue
        return {"hints": dict(self.hinted)}

    def glossary(self, body: dict) -> dict:
        if "glossary" in body:
            self.tools.glossary = {str(k): str(v) for k, v in body["glossary"].items() if str(k).strip() and str(v).strip()}
        return {"glossary": self.tools.glossary}

    def describe(self, body: dict) -> dict:
        """Descriptions by the model, for the caller to look at; nothing is changed."""
        if self.tools.provider is None:
            return {"error": "no model is configured"}
        provider = self.tools.provider
        worker = Describer(lambda prompt: provider.complete("You describe database objects in plain words.", prompt, 200))
        rows = self.tools.catalog.objects().where("description IS NULL")
        names = body.get("names")
        found = worker.describe(rows.where(F.col("name").isin(list(names))) if names else rows)
        return {"descriptions": found, "failed": worker.failures, "truncated": worker.truncated}

    def apply_descriptions(self, body: dict) -> dict:
        return {"applied": self.tools.catalog.describe(dict(body["descriptions"]), only_missing=not body.get("replace"))}

    def connect(self, body: dict) -> dict:
        if self.connector is None:
            return {"error": "connections are not allowed here"}
        catalog, tables = self.connector(body)
        self.tools.build = lambda: self.connector(body)
        self.tools.catalog, self.tools.tables = catalog, tables
        kept = bool(self.memory and body.get("remember") and self.memory.save(str(body.get("name") or "default"), body))
        return {"objects": len(catalog), "remembered": kept}

    def connections(self, body: dict) -> dict:
        """Names and kinds of connections that are kept, never their secrets; forget removes one."""
        if self.memory is None:
            return {"connections": []}
        if body.get("forget"):
            self.memory.forget(str(body["forget"]))
        return {"connections": [{"name": n, "kind": c.get("kind"), "host": c.get("host")} for n, c in self.memory.all().items()]}

    def models(self, body: dict) -> dict:
        return {"available": available_providers(), "configured": self.tools.provider is not None}

    POSTS = ("select", "answer", "settings", "describe", "apply-descriptions", "connect", "resync", "connections", "models", "hints", "glossary")

    def page(self) -> str:
        rows = "".join(f"<tr><td>{html.escape(o['name'])}</td><td>{o['kind']}</td><td>{o['columns']}</td><td>{html.escape(o['description'])}</td></tr>" for o in self.objects()["objects"])
        return f"""<!doctype html><meta charset="utf-8"><title>lodeseek</title><h1>{len(self.tools.catalog)} objects</h1>
<form onsubmit="fetch('/api/select',{{method:'POST',body:JSON.stringify({{question:q.value}})}}).then(r=>r.json()).then(r=>out.textContent=r.ddl||r.error);return false">
<input id="q" size="60" placeholder="A question"><button>Select</button></form><pre id="out"></pre>
<table><tr><th>name<th>kind<th>columns<th>about</tr>{rows}</table>"""


def serve(tools: Tools, port: int = 0, memory: ConnectionMemory | None = None, connect: Callable[[dict], tuple[Catalog, dict]] | None = None) -> ThreadingHTTPServer:
    """GET /, /api/objects, /api/health and /api/settings; POST /api/ and a name of Studio.POSTS or of a tool, with a JSON object."""
    studio = Studio(tools, memory, connect)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, data: bytes, kind: str, code: int) -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.send_header("Cache-Control", "no-store")
            self.end_headers()
            self.wfile.write(data)

        def _reply(self, value: dict, code: int = 200) -> None:
            self._send(json.dumps(value, default=str).encode(), "application/json; charset=utf-8", code)

        def do_GET(self) -> None:
            if self.path in ("/", "/index.html"):
                return self._send(studio.page().encode(), "text/html; charset=utf-8", 200)
            got = {"/api/objects": studio.objects, "/api/health": lambda: tools.call("health"), "/api/settings": studio.settings}.get(self.path)
            self._reply(got() if got else {"error": "not found"}, 200 if got else 404)

        def do_POST(self) -> None:
            name = self.path.removeprefix("/api/")
            if name not in (*Studio.POSTS, *Tools.NAMES):
                return self._reply({"error": "not found"}, 404)
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                return self._reply({"error": "not JSON"}, 400)
            if not isinstance(body, dict):
                return self._reply({"error": "not a JSON object"}, 400)
            try:
                self._reply(getattr(studio, name.replace("-", "_"))(body) if name in Studio.POSTS else tools.call(name, body))
            except (ValueError, TypeError, KeyError) as e:
                self._reply({"error": f"{type(e).__name__}: {e}"}, 400)
            except Exception as e:  # noqa: BLE001
                self._reply({"error": type(e).__name__}, 500)

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
