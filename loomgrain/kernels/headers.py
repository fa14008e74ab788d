"""Response headers: links, robots directives, reservations and usage preferences."""

from __future__ import annotations

import re

_AGENT = re.compile(r"^\s*([A-Za-z][\w.-]*)\s*:\s*(.+)$")
#: Directives whose own value follows a colon, which is no agent's name.
_VALUED = frozenset("max-snippet max-image-preview max-video-preview unavailable_after".split())
_TOKEN = re.compile(r"""\s*([^\s;=,<>"]+)\s*(?:=\s*(?:"((?:\\.|[^"\\])*)"|([^\s;,"]*)))?\s*""")


def lowered(headers: list[tuple[str, str]]) -> dict[str, str]:
    """Headers by lower-case name, repeated ones joined by commas."""
    out: dict[str, str] = {}
    for name, value in headers:
        key = name.strip().lower()
        out[key] = f"{out[key]}, {value.strip()}" if key in out else value.strip()
    return out


def links(value: str) -> list[dict[str, str]]:
    """Targets with their parameters of a Link header; what is broken ends the reading."""
    out, at = [], 0
    while True:
        opened = re.compile(r"[\s,]*<([^>]*)>").match(value, at)
        if not opened:
            return out
        at = opened.end()
        link = {"target": opened[1].strip()}
        while (sep := re.compile(r"\s*;").match(value, at)) is not None:
            at = sep.end()
            told = _TOKEN.match(value, at)
            if not told:
                break
            at = told.end()
            text = re.sub(r"\\(.)", r"\1", told[2]) if told[2] is not None else told[3] or ""
            link.setdefault(told[1].lower(), text)
        out.append(link)


def robots(value: str) -> list[tuple[str, str]]:
    """(agent, directive) of an X-Robots-Tag; a directive without an agent's prefix is for all that follow the last prefix."""
    out, agent = [], "*"
    for part in value.split(","):
        found = _AGENT.match(part)
        if found and found[1].lower() not in _VALUED:
            agent, part = found[1].lower(), found[2]
        if part.strip():
            out.append((agent, part.strip().lower()))
    return out


def usage(value: str) -> dict[str, str]:
    """Categories with ``y`` or ``n`` of a Content-Usage header; a member of another form is passed over."""
    out: dict[str, str] = {}
    for part in value.split(","):
        key, _, said = part.split(";", 1)[0].partition("=")
        if re.fullmatch(r"\s*[a-z*][a-z0-9_.*-]*\s*", key) and said.strip() in ("y", "n"):
            out[key.strip()] = said.strip()
    return out


def charset(value: str | None) -> str | None:
    found = re.search(r"""(?i);\s*charset\s*=\s*["']?([\w.:-]+)""", value or "")
    return found[1].lower() if found else None
