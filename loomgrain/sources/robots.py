"""robots.txt and tdmrep.json as tables of rules, and what they say of an address."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RULES = pa.schema([("site", pa.string()), ("grp", pa.int32()), ("agent", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("ord", pa.int32())])


def _robots(text: str) -> list[tuple[int, str, str, str]]:
    """(group, agent, kind, value) of a file: a run of user-agent lines opens a group; unknown lines are passed over."""
    out: list[tuple[int, str, str, str]] = []
    agents: list[str] = []
    group, open_run = -1, False
    for line in text.lstrip("﻿").splitlines():
        name, found, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not found:
            continue
        if name == "user-agent":
            if not open_run:
                group, agents, open_run = group + 1, [], True
            agents.append(value.lower())
            out.append((group, value.lower(), "agent", ""))
        elif name == "sitemap":
            out.append((-1, "", "sitemap", value))
        elif name in ("allow", "disallow", "crawl-delay", "content-usage", "content-signal") and agents:
            open_run = False
            out += [(group, a, name, value) for a in agents]
    return out


def robots_rules(files: DataFrame) -> DataFrame:
    """site, grp, agent, kind, value, ord of robots.txt texts (columns site and text); a sitemap's agent is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, *r[:1], *r[1:], k) for s, t in zip(batch.column("site").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, r in enumerate(_robots(t or ""))]
            yield pa.RecordBatch.from_pylist([dict(zip(_RULES.names, r, strict=True)) for r in rows], schema=_RULES)

    return files.select("site", "text").mapInArrow(run, "site string, grp int, agent string, kind string, value string, ord int")


def path_matches(target: Column, pattern: Column) -> Column:
    """Whether a path with its query fits a pattern of ``*`` and a final ``$``. Pieces between stars are looked for in turn, so no pattern costs more than its length."""
    anchored = pattern.endswith("$")
    pieces = F.split(F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(F.concat(pattern, F.lit("*"))), r"\*", -1)
    last = F.size(pieces) - 1

    def step(at: Column, x: Column) -> Column:
        piece, k = x["p"], x["k"]
        found = F.position(piece, target, at + 1)
        end = F.length(target) - F.length(piece)
        return (
            F.when(at < 0, at)
            .when(k == 0, F.when(target.startswith(piece) & ((last > 0) | (F.length(piece) == F.length(target))), F.length(piece)).otherwise(-1))
            .when(k == last, F.when((piece == "") | (target.endswith(piece) & (end >= at)), F.length(target)).otherwise(-1))
            .otherwise(F.when(found > 0, found - 1 + F.length(piece)).otherwise(-1))
        )

    return F.aggregate(F.transform(pieces, lambda p, k: F.struct(p.alias("p"), k.alias("k"))), F.lit(0), step) >= 0


def target_of(url: Column) -> Column:
    """The path of an address with its query."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def verdicts(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """url, site and allowed of every address: the group of the longest agent name that ``agent`` begins with, else ``*``;
    in it the longest pattern that fits, an allow before a disallow of the same length. Without one, allowed.
    """
    own = rules.where(F.lit(agent.lower()).startswith(F.col("agent")) & (F.col("agent") != "") | (F.col("agent") == "*"))
    chosen = own.groupBy("site").agg(F.max_by("agent", F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))).alias("agent"))
    held = rules.join(chosen, ["site", "agent"], "left_semi").where(F.col("kind").isin("allow", "disallow") & (F.col("value") != ""))
    patterns = held.groupBy("site").agg(F.collect_set(F.struct("kind", "value")).alias("patterns"))
    target = target_of(F.col("url"))
    fitting = F.transform(F.filter("patterns", lambda p: path_matches(F.col("target"), p["value"])), lambda p: F.struct(F.length(p["value"]).alias("n"), (p["kind"] == "allow").alias("allow")))
    joined = urls.select("url", "site", target.alias("target")).join(patterns, "site", "left")
    return joined.select("url", "site", F.coalesce(F.array_max(fitting)["allow"], F.lit(True)).alias("allowed"))


def delays(rules: DataFrame, agent: str) -> DataFrame:
    """site and delay (seconds) that robots.txt asks of ``agent``."""
    own = rules.where((F.col("kind") == "crawl-delay") & (F.lit(agent.lower()).startswith(F.col("agent")) | (F.col("agent") == "*")))
    return own.groupBy("site").agg(F.max_by(F.col("value").try_cast("double"), F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))).alias("delay"))


_TDM = pa.schema([("site", pa.string()), ("ord", pa.int32()), ("location", pa.string()), ("reservation", pa.string()), ("policy", pa.string())])


def _tdm(text: str | None) -> list[dict]:
    try:
        told = json.loads(text or "")
    except (ValueError, RecursionError):
        return []
    rules = []
    for x in told if isinstance(told, list) else []:
        if isinstance(x, dict) and isinstance(x.get("location"), str) and x["location"] and x.get("tdm-reservation") in (0, 1, "0", "1") and not isinstance(x.get("tdm-reservation"), bool):
            rules.append({"location": x["location"], "reservation": str(x["tdm-reservation"]), "policy": x["tdm-policy"] if isinstance(x.get("tdm-policy"), str) else None})
    return rules


def tdm_rules(files: DataFrame) -> DataFrame:
    """site, ord, location, reservation and policy of tdmrep.json texts (columns site and text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"site": s, "ord": k, **r} for s, t in zip(batch.column("site").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, r in enumerate(_tdm(t))]
            yield pa.RecordBatch.from_pylist(rows, schema=_TDM)

    return files.select("site", "text").mapInArrow(run, "site string, ord int, location string, reservation string, policy string")


def tdm_reserved(urls: DataFrame, rules: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """url, reserved, policy and source: the file's first rule that fits, then the page's header, then its metas.

    ``declared`` has url, place (``header`` or ``meta``), reservation and policy. Addresses of which nothing speaks are left out.
    """
    of_site = rules.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("ord", "location", "reservation", "policy"))).alias("rules"))
    hit = F.get(F.filter("rules", lambda r: path_matches(F.col("target"), r["location"])), F.lit(0))
    said = urls.select("url", "site", target_of(F.col("url")).alias("target")).join(of_site, "site").select("url", hit.alias("r")).where("r is not null").select("url", F.lit(0).alias("rank"), F.lit("tdmrep.json").alias("source"), "r.reservation", "r.policy")
    if declared is not None:
        rank = F.when(F.col("place") == "header", 1).otherwise(2)
        said = said.unionByName(declared.select("url", rank.alias("rank"), F.col("place").alias("source"), "reservation", "policy"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("rank")))
    known = said.groupBy("url").agg(last("reservation").alias("reservation"), last("policy").alias("policy"), F.max_by("source", F.when(F.col("reservation").isNotNull(), F.col("rank"))).alias("source"))
    return known.where("reservation is not null").select("url", (F.col("reservation") == "1").alias("reserved"), "policy", "source")
