"""Schemas of the catalog tables, callers, and the texts derived from an object."""

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import text as X

COLUMN = "name: string, type: string, nullable: boolean, comment: string, pk: boolean, roles: array<string>, values: array<string>"
FOREIGN_KEY = "columns: array<string>, ref_table: string, ref_columns: array<string>, inferred: boolean"
#: One row for each table or view; ordinal is the order of insertion and breaks ties.
OBJECTS = (
    "ordinal long, name string, schema string, kind string, description string, hint string, "
    f"columns array<struct<{COLUMN}>>, foreign_keys array<struct<{FOREIGN_KEY}>>, row_estimate long, "
    "definition string, roles array<string>, extra map<string,string>"
)
KINDS = ("TABLE", "VIEW", "ENDPOINT")
_SUBJECT = re.compile(r"^[A-Za-z0-9_.-]+:[^\s:][^\s]*$")


@dataclass(frozen=True)
class Principal:
    """A caller: "<source>:<id>" and its roles."""

    subject: str
    roles: frozenset = field(default_factory=frozenset)

    def __post_init__(self):
        if not _SUBJECT.match(self.subject or ""):
            raise ValueError("a subject has the form source:id")
        object.__setattr__(self, "roles", frozenset(self.roles))

    def scope(self) -> str:
        """16 hexadecimal digits that stand for the subject."""
        return hashlib.sha256(self.subject.encode()).hexdigest()[:16]

    def require(self, *roles: str) -> None:
        if not self.roles & set(roles):
            raise PermissionError(f"{self.subject} has none of the roles needed")


def column(name: str, type: str = "", nullable: bool = True, comment: str | None = None, pk: bool = False, roles=None, values=None) -> dict:
    return dict(name=name, type=type, nullable=nullable, comment=comment, pk=pk, roles=roles, values=values)


def foreign_key(columns: list[str], ref_table: str, ref_columns: list[str] | None = None, inferred: bool = False) -> dict:
    return dict(columns=list(columns), ref_table=ref_table, ref_columns=list(ref_columns or []), inferred=inferred)


def one_text(value) -> str | None:
    """Free text that came as a list, set, dict or number, as one line."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, dict):
        return ", ".join(f"{k}: {v}" for k, v in value.items())
    if isinstance(value, (set, frozenset)):
        return ", ".join(sorted(map(str, value)))
    if isinstance(value, (list, tuple)):
        return ", ".join(map(str, value))
    return str(value)


def obj(name: str, schema: str | None = None, kind: str = "TABLE", description=None, hint=None, columns=(), foreign_keys=(), row_estimate=None, definition=None, roles=None, extra=None) -> dict:
    """A row of OBJECTS without its ordinal."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    return dict(
        name=name, schema=schema, kind=kind, description=one_text(description), hint=one_text(hint), columns=list(columns), foreign_keys=list(foreign_keys),
        row_estimate=row_estimate, definition=definition, roles=list(roles) if roles else None, extra=dict(extra or {}),
    )


def qname(schema: Column | None = None, name: Column | None = None) -> Column:
    """schema.name, or name where the schema is null or empty."""
    schema = F.col("schema") if schema is None else schema
    name = F.col("name") if name is None else name
    return F.when(schema.isNull() | (schema == ""), name).otherwise(F.concat_ws(".", schema, name))


def body_text() -> Column:
    """The text that is embedded and indexed."""
    parts = F.concat(
        F.array(X.spaced(F.col("name")), "name", "hint", "description"),
        F.transform("columns", lambda c: X.spaced(c["name"])),
        F.transform("columns", lambda c: c["comment"]),
        F.array(X.identifiers(F.col("definition"))),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " \n")


def name_text() -> Column:
    """Schema, name and spaced name."""
    return F.concat_ws(" ", "schema", "name", X.spaced(F.col("name")))


def prose_text() -> Column:
    """Hint, description and column comments."""
    return F.concat_ws(" ", "hint", "description", F.array_join(F.filter(F.transform("columns", lambda c: c["comment"]), lambda c: c.isNotNull()), " "))


FIELDS = {"body": body_text, "name": name_text, "prose": prose_text}


def with_fields(objects: DataFrame) -> DataFrame:
    """objects with qname and the three indexed texts."""
    return objects.withColumn("qname", qname()).withColumns({f"{k}_text": v() for k, v in FIELDS.items()})
