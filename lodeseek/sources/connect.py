"""Connection strings: URLs of several kinds to JDBC, and text without secrets."""

import os
import re
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, quote, unquote, urlsplit

# Schemes by kind, JDBC prefixes, default ports and driver classes.
SCHEMES = {"postgres": "postgresql", "postgresql": "postgresql", "oracle": "oracle", "mssql": "mssql", "sqlserver": "mssql", "mysql": "mysql", "mariadb": "mysql", "sqlite": "sqlite"}
PORTS = {"postgresql": 5432, "oracle": 1521, "mssql": 1433, "mysql": 3306}
DRIVERS = {
    "postgresql": "org.postgresql.Driver", "oracle": "oracle.jdbc.OracleDriver", "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "mysql": "com.mysql.cj.jdbc.Driver", "sqlite": "org.sqlite.JDBC",
}
TIMEOUT = 20
_SECRET = re.compile(r"(?i)\b(password|passwd|pwd|secret|token|api[_-]?key|wallet_password)\b(\s*[=:]\s*)([^\s;,&'\"]+)")


@dataclass
class Connection:
    kind: str
    host: str = ""
    port: int | None = None
    database: str = ""
    user: str | None = None
    password: str | None = None
    options: dict = field(default_factory=dict)

    def jdbc(self) -> tuple[str, dict]:
        """The JDBC URL and properties, with a timeout to connect."""
        at = f"{self.host}:{self.port or PORTS.get(self.kind, '')}".rstrip(":")
        url, extra = {
            "postgresql": (f"jdbc:postgresql://{at}/{self.database}", {"connectTimeout": str(TIMEOUT)}),
            "mysql": (f"jdbc:mysql://{at}/{self.database}", {"connectTimeout": str(TIMEOUT * 1000)}),
            "mssql": (f"jdbc:sqlserver://{at};databaseName={self.database}", {"loginTimeout": str(TIMEOUT)}),
            "oracle": (f"jdbc:oracle:thin:@{self.database if not self.host else f'//{at}/{self.database}'}", {"oracle.net.CONNECT_TIMEOUT": str(TIMEOUT * 1000)}),
            "sqlite": (f"jdbc:sqlite:{self.database}", {}),
        }[self.kind]
        props = {"driver": DRIVERS[self.kind], **extra, **self.options}
        if self.user:
            props["user"] = self.user
        if self.password:
            props["password"] = self.password
        return url, props

    def url(self) -> str:
        who = "" if not self.user else quote(self.user, safe="") + (f":{quote(self.password, safe='')}" if self.password else "") + "@"
        return f"{self.kind}://{who}{self.host}{f':{self.port}' if self.port else ''}/{self.database}"


def kind_of(scheme: str) -> str:
    """postgresql, oracle, mssql, mysql or sqlite of a scheme with or without a driver."""
    base = scheme.lower().split("+")[0]
    if base not in SCHEMES:
        raise ValueError(f"unknown kind of database: {base}")
    return SCHEMES[base]


def resolve(spec) -> Connection:
    """A connection from a URL, a JDBC URL, or a form (a dict with kind, host, ...)."""
    if isinstance(spec, dict):
        form = {k: v for k, v in spec.items() if v not in (None, "")}
        if "wallet" in form:
            return oracle_wallet(form["wallet"], form.get("alias", ""), form.get("user"), form.get("password"), form.get("wallet_password"))
        own = ("host", "database", "user", "password", "options")
        return Connection(kind_of(form["kind"]), port=int(form["port"]) if "port" in form else None, **{k: form[k] for k in own if k in form})
    text = spec.strip()
    if text.lower().startswith("jdbc:"):
        return _from_jdbc(text)
    u = urlsplit(text)
    kind = kind_of(u.scheme)
    if kind == "sqlite":
        return Connection("sqlite", database=text.split("://", 1)[1].removeprefix("/"))
    plain = lambda x: unquote(x) if x is not None else None
    options = dict(parse_qsl(u.query))
    database = u.path.lstrip("/") or options.pop("service_name", "")
    return Connection(kind, u.hostname or "", u.port, database, plain(u.username), plain(u.password), options)


def _from_jdbc(text: str) -> Connection:
    rest = text[5:]
    if rest.lower().startswith("oracle:thin:"):
        body = rest[12:]
        who, _, at = body.rpartition("@")
        user, _, password = who.partition("/")
        m = re.match(r"^(?://)?([^:/]+):(\d+)[:/](.+)$", at)
        host, port, database = (m[1], int(m[2]), m[3]) if m else ("", None, at)
        return Connection("oracle", host, port, database, user or None, password or None)
    if rest.lower().startswith("sqlserver:"):
        head, *parts = rest[10:].lstrip("/").split(";")
        props = dict(p.split("=", 1) for p in parts if "=" in p)
        low = {k.lower(): k for k in props}
        take = lambda *names: next((props.pop(low[n]) for n in names if n in low), None)
        host, _, port = head.partition(":")
        return Connection("mssql", host, int(port) if port else None, take("databasename", "database") or "", take("user", "username"), take("password"), props)
    if rest.lower().startswith("sqlite:"):
        return Connection("sqlite", database=rest[7:])
    c = resolve(rest)
    c.user, c.password = c.user or c.options.pop("user", None), c.password or c.options.pop("password", None)
    return c


def tns_aliases(wallet: str) -> list[str]:
    """Names in the tnsnames.ora of an unpacked wallet."""
    with open(os.path.join(wallet, "tnsnames.ora"), encoding="utf-8", errors="replace") as f:
        return re.findall(r"^\s*([A-Za-z][\w.-]*)\s*=\s*\(", f.read(), re.M)


def oracle_wallet(wallet: str, alias: str, user: str | None = None, password: str | None = None, wallet_password: str | None = None) -> Connection:
    found = tns_aliases(wallet)
    if alias and alias.lower() not in [a.lower() for a in found]:
        raise ValueError(f"the wallet has no {alias}; it has {', '.join(found)}")
    options = {"oracle.net.tns_admin": wallet}
    if wallet_password:
        options["oracle.net.wallet_password"] = wallet_password
    return Connection("oracle", database=alias or found[0], user=user, password=password, options=options)


def redact(text: str, *secrets: str | None) -> str:
    """Text without passwords: in URLs, in settings, and the given ones of four characters or more."""
    out = re.sub(r"(://[^:/@\s]+):[^@\s]+@", r"\1:***@", str(text))
    out = re.sub(r"(thin:[^/@\s]+)/[^@\s]+@", r"\1/***@", out)
    out = _SECRET.sub(r"\1\2***", out)
    for s in sorted({s for s in secrets if s and len(s) >= 4}, key=len, reverse=True):
        for form in (s, quote(s, safe="")):
            out = out.replace(form, "***")
    return out


def safe_error(e: BaseException, *secrets: str | None) -> str:
    return f"{type(e).__name__}: {redact(str(e).splitlines()[0] if str(e) else '', *secrets)}"


def driver_hint(kind: str) -> str:
    """What a reader of this kind needs on the class path."""
    return f"put the JDBC driver with {DRIVERS[kind]} on spark.jars"
