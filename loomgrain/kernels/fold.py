"""Items of several vocabularies folded into records, and values inside them."""

from __future__ import annotations

import json
from typing import Any

IDENTITY = ("@id", "url", "sku", "gtin", "gtin8", "gtin12", "gtin13", "gtin14", "mpn", "name", "headline")


def _one(a: dict[str, Any], b: dict[str, Any]) -> bool:
    """Whether two folded records are one thing: they share a name of it and differ on none."""
    shared = False
    for key in IDENTITY:
        x, y = a.get(key), b.get(key)
        x, y = x and x[0], y and y[0]
        if isinstance(x, str) and isinstance(y, str):
            if " ".join(x.split()).casefold() != " ".join(y.split()).casefold():
                return False
            shared = True
    return shared


def fold(items: list[dict[str, Any]], about: list[dict[str, Any]], readers: tuple[str, ...]) -> tuple[list[dict[str, Any]], list[tuple[int, str, str, str]]]:
    """Records (types, source, fields: name to (value, source)) and the values that were set aside, as (record, key, value, source).

    Items come with reader, types and json; ``about`` has the document's fields by reader order. A record of earlier readers takes
    one item of each later reader that shares a type with it; fields fill gaps only. The document's fields go to the first record.
    """
    records: list[dict[str, Any]] = []
    aside: list[tuple[int, str, str, str]] = []
    for reader in readers:
        free = list(range(len(records)))
        for item in (x for x in items if x["reader"] == reader):
            fields = {k: (v, reader) for k, v in json.loads(item["json"]).items() if not k.startswith("@")}
            own = {"types": list(item["types"]), "source": reader, "fields": fields}
            at = next((k for k in free if set(records[k]["types"]) & set(own["types"])), None)
            if at is None:
                records.append(own)
                continue
            free.remove(at)
            held = records[at]["fields"]
            one = _one(held, fields)
            for key, value in fields.items():
                kept = held.setdefault(key, value)
                if one and kept is not value and kept[0] != value[0]:
                    aside.append((at, key, _text(value[0]), reader))
    if about:
        if not records:
            records.append({"types": [], "source": None, "fields": {}})
        for x in about:
            if x["value"]:
                records[0]["fields"].setdefault(x["key"], (x["value"], x["reader"]))
    return [r for r in records if r["fields"]], aside


def _text(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def leaves(value: Any, path: str, out: list[tuple[str, str]]) -> None:
    """(dotted path, text) of every text inside a value."""
    if isinstance(value, dict):
        for k, v in value.items():
            leaves(v, f"{path}.{k}" if path else k, out)
    elif isinstance(value, list):
        for k, v in enumerate(value):
            leaves(v, f"{path}[{k}]", out)
    else:
        out.append((path, str(value)))
