"""Command line: demo, select, sql, describe, studio, certify."""

import argparse
import contextlib
import sys
import threading

from lodeseek.model import Principal
from lodeseek.operators.describe import DescriptionCache, Describer, describe_prompt
from lodeseek.operators.select import Catalog
from lodeseek.plans.guard import MAX_QUESTION, MAX_TOP_K, GuardedSession
from lodeseek.plans.providers import auto_provider
from lodeseek.service import Tools, serve
from lodeseek.session import get_spark
from lodeseek.sources import demo, reflect


def demo_catalog(spark) -> Catalog:
    catalog = Catalog(spark).add_all(demo.demo_objects())
    catalog.infer_foreign_keys()
    return catalog


def certify(spark) -> list[tuple[str, bool]]:
    """Checks of the engine on the demo (U6): name and whether it held."""
    c = demo_catalog(spark)
    rows = c.objects().collect()
    anyone, payroll = None, Principal("certify:1", {"payroll"})
    names = lambda p, q: c.select(q, principal=p).table_names()
    open_, opened = GuardedSession(spark, rows, demo.demo_tables(spark), anyone), GuardedSession(spark, rows, demo.demo_tables(spark), payroll)
    checks = [
        ("objects are found", len(c) == len(demo.demo_objects())),
        ("joins are inferred", any(k["inferred"] for r in rows for k in r["foreign_keys"])),
        ("a copy is recognised", c.shadows().get("sales_order_bkp") == "sales_order"),
        ("a question finds its table", "billing_invoice" in names(anyone, "Which invoices are still unpaid?")),
        ("a restricted table is hidden", "hr_compensation" not in names(anyone, "compensation by pay grade")),
        ("its role sees it", "hr_compensation" in names(payroll, "compensation by pay grade")),
        ("a read runs", open_.run("SELECT count(*) FROM sales_order").rows == [(3,)]),
        ("a write is refused", bool(open_.run("DROP TABLE sales_order").error)),
        ("a hidden table can't be read", bool(open_.run("SELECT * FROM hr_compensation").error)),
        ("its role can read it", opened.run("SELECT * FROM hr_compensation").error is None),
    ]
    return checks


def describe(catalog: Catalog, cache: str | None = None, provider=None) -> int:
    """Descriptions of the objects that have none, by the model of the environment; without one, what it would be asked."""
    provider = provider or auto_provider()
    rows = catalog.objects().where("description IS NULL")
    if provider is None:
        print("\n\n".join(describe_prompt(r) for r in rows.orderBy("ordinal").collect()))
        return 0
    worker = Describer(lambda prompt: provider.complete("You describe database objects in plain words.", prompt, 200), cache=DescriptionCache(cache))
    found = worker.describe(rows)
    print("\n".join(f"{q}: {text}" for q, text in found.items()))
    print(f"{catalog.describe(found)} described, {len(worker.failures)} failed, {len(worker.truncated)} cut off", file=sys.stderr)
    return int(bool(worker.failures))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodeseek")
    p.add_argument("command", choices=["demo", "select", "sql", "describe", "studio", "certify"])
    p.add_argument("text", nargs="?", default="")
    p.add_argument("--parquet", help="folder of tables; the demo if not given")
    p.add_argument("--tables", default="", help="names of the tables of the folder")
    p.add_argument("--top-k", type=int, default=6)
    p.add_argument("--as", dest="subject")
    p.add_argument("--roles", default="")
    p.add_argument("--port", type=int, default=8000, help="of studio; 0 takes any")
    p.add_argument("--cache", help="file that keeps descriptions")
    a = p.parse_args(argv)
    spark = get_spark()
    who = Principal(a.subject, set(filter(None, a.roles.split(",")))) if a.subject else None
    if a.command == "certify":
        found = certify(spark)
        print("\n".join(f"{'ok  ' if ok else 'FAIL'} {name}" for name, ok in found))
        return int(not all(ok for _, ok in found))
    if a.parquet:
        names = list(filter(None, a.tables.split(",")))
        catalog = Catalog(spark).add_all(reflect.reflect_parquet(spark, a.parquet, names))
        tables = {n: spark.read.parquet(f"{a.parquet}/{n}.parquet") for n in names}
    else:
        catalog, tables = demo_catalog(spark), demo.demo_tables(spark)
    if a.command == "sql":
        from lodeseek.operators.render import format_rows

        got = GuardedSession(spark, catalog.objects().collect(), tables, who).run(a.text)
        print(got.error or format_rows(got.columns, got.rows))
        return int(bool(got.error))
    if a.command == "describe":
        return describe(catalog, a.cache)
    if a.command == "studio":
        server = serve(Tools(spark, lambda: (catalog, tables), auto_provider()), a.port)
        print(f"http://127.0.0.1:{server.server_port}/")
        with contextlib.suppress(KeyboardInterrupt):
            threading.Event().wait()
        server.shutdown()
        return 0
    for q in [a.text[:MAX_QUESTION]] if a.command == "select" else demo.GOLDEN:
        picked = catalog.select(q, top_k=max(1, min(a.top_k, MAX_TOP_K)), principal=who)
        print(f"{q}\n{picked.explain()}\n\n{picked.prompt_fragment()}\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
