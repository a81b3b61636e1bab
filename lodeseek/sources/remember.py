"""Connections that a caller wants kept, by name, in a file that only its owner can read."""

import contextlib
import json
import os
import tempfile

# The fields of a connection that may be kept.
FIELDS = (
    "kind", "url", "jdbc", "wallet", "alias", "wallet_password", "host", "port", "database", "service_name", "driver", "user", "password",
    "schema", "schemas", "restrict_from_grants", "sample_values",
)
VERSION = 2


class ConnectionMemory:
    """Named connections in a JSON file. Nothing is written unless it is allowed, and no field but those of FIELDS.

    A damaged file counts as empty. A file of version 1, which held one connection without a name, is read as
    one named default. A file is replaced as a whole, by one that has been created for its owner alone.
    """

    def __init__(self, path: str, allowed: bool = False):
        self.path, self.allowed = path, allowed

    def all(self) -> dict[str, dict]:
        try:
            with open(self.path, encoding="utf-8") as f:
                found = json.load(f)
        except (OSError, ValueError):
            return {}
        if not isinstance(found, dict):
            return {}
        if found.get("version") == 1:
            found = {"connections": {"default": found.get("connection")}}
        named = found.get("connections")
        return {str(n): self._kept(c) for n, c in named.items() if isinstance(c, dict)} if isinstance(named, dict) else {}

    def save(self, name: str, connection: dict) -> bool:
        """Keeps a connection; False if that is not allowed, if it has nothing to keep, or if the file can't be written."""
        kept = self._kept(connection)
        return bool(self.allowed and kept) and self._write(self.all() | {name: kept})

    def forget(self, name: str) -> bool:
        found = self.all()
        return found.pop(name, None) is not None and self._write(found)

    @staticmethod
    def _kept(connection: dict) -> dict:
        return {k: connection[k] for k in FIELDS if connection.get(k) not in (None, "", [], {})}

    def _write(self, connections: dict[str, dict]) -> bool:
        folder = os.path.dirname(os.path.abspath(self.path))
        try:
            os.makedirs(folder, mode=0o700, exist_ok=True)
            # mkstemp gives a file of mode 0600.
            handle, draft = tempfile.mkstemp(dir=folder)
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                json.dump({"version": VERSION, "connections": connections}, f, indent=1)
            os.replace(draft, self.path)
        except OSError:
            with contextlib.suppress(OSError, UnboundLocalError):
                os.unlink(draft)
            return False
        return True
