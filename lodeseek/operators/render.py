"""Rendering and audit of objects and selections."""

import re

from pyspark.sql import Row

MAX_COLUMNS = 40


def may_see(roles, principal) -> bool:
    return not roles or (principal is not None and bool(set(roles) & principal.roles))


def _line(text: str | None) -> str:
    return " ".join((text or "").split())


def qname_of(row) -> str:
    return f"{row['schema']}.{row['name']}" if row["schema"] else row["name"]


def render_ddl(row: Row, principal=None, max_columns: int = MAX_COLUMNS, hidden: frozenset = frozenset()) -> str:
    """The DDL of an object as a caller may see it.

    Columns that are restricted are absent; so are foreign keys that use one, or that point at a name in
    hidden (lower-case bare names of which the caller sees no object).
    """
    note = _line(row["hint"] or (row["description"] or "").split(" | ")[0])
    shown = [c for c in row["columns"] if may_see(c["roles"], principal)]
    body = []
    for k, c in enumerate(shown[:max_columns]):
        words = [c["name"], c["type"], *(["PK"] if c["pk"] else []), *([] if c["nullable"] else ["NOT NULL"])]
        remarks = ["one of: " + ", ".join(map(repr, c["values"]))] if c["values"] else []
        remarks += [_line(c["comment"])] if _line(c["comment"]) else []
        last = k == len(shown) - 1
        body.append("  " + " ".join(words) + ("" if last else ",") + ("  -- " + "; ".join(remarks) if remarks else ""))
    if len(shown) > max_columns:
        body.append(f"  -- ...{len(shown) - max_columns} more columns")
    names = {c["name"] for c in shown}
    keys = [
        f"-- FK {row['name']}({','.join(k['columns'])}) -> {k['ref_table']}" + ("  (inferred from the column name, not declared)" if k["inferred"] else "")
        for k in row["foreign_keys"]
        if set(k["columns"]) <= names and (k["ref_table"] or "").lower() not in hidden
    ]
    return "\n".join([*([f"-- {note}"] if note else []), f"{row['kind']} {qname_of(row)} (", *body, ")", *keys])


def estimate(text: str) -> int:
    """The driver's form of the token estimate."""
    return sum(max(1, round(len(p) / 4)) if p.isalpha() else 1 for p in re.findall(r"[A-Za-z]+|[^A-Za-z\s]", text))


def format_rows(columns: list[str], rows: list[tuple], width: int = 28) -> str:
    """Rows as text of fixed width; a longer value ends in an ellipsis."""
    cell = lambda v: (s := "" if v is None else str(v)) and (s if len(s) <= width else s[: width - 1] + "…")
    table = [list(columns), *[[cell(v) for v in r] for r in rows]]
    sizes = [max(len(r[k]) for r in table) for k in range(len(columns))]
    return "\n".join("  ".join(v.ljust(n) for v, n in zip(r, sizes, strict=True)).rstrip() for r in table)
