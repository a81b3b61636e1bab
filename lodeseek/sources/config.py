"""Catalog settings in a JSON file: restrict, hint and describe blocks."""

import json
import os


def load(path: str) -> dict:
    """The settings; a missing file has none."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def apply(catalog, settings: dict) -> list[str]:
    """Applies settings to a catalog, and returns the names it doesn't have."""
    missing = []
    for block in ("restrict", "hint", "describe"):
        for name, value in settings.get(block, {}).items():
            try:
                if block == "restrict":
                    table, _, col = name.rpartition(":")
                    catalog.restrict_column(table, col, value) if table else catalog.restrict(name, value)
                elif block == "hint":
                    catalog.hint(name, value)
                else:
                    catalog.find(name)["description"] = value
                    catalog._stale = True
            except KeyError:
                missing.append(name)
    return missing


def merge_descriptions(path: str, texts: dict[str, str]) -> None:
    """Adds descriptions to the file and replaces it as a whole."""
    settings = load(path)
    settings["describe"] = settings.get("describe", {}) | texts
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(settings, f, indent=2, sort_keys=True)
    os.replace(path + ".tmp", path)
