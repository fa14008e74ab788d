"""Candidates for the fixed questions of a page, each with its rank; the best one is a relational choice."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from decimal import Decimal
from typing import Any

#: The questions in their order.
QUESTIONS = (
    "title description url image author published modified language site_name publisher type price price_regular price_low price_high currency availability"
    " brand sku gtin mpn rating rating_best rating_count breadcrumb"
).split()

THINGS = ("jsonld", "microdata", "microformats", "rdfa")
#: Types that a page can be about, that stand around its subject, and that are its site or people; names of nobody.
_SUBJECTS = frozenset("Product ProductGroup Recipe Event JobPosting Book Movie TVSeries TVEpisode Course SoftwareApplication MobileApplication WebApplication VideoGame Dataset HowTo Review Hotel Restaurant LocalBusiness Offer MusicAlbum MusicRecording PodcastEpisode".split())
_AROUND = frozenset("BreadcrumbList ListItem ItemList SearchAction SiteNavigationElement WPHeader WPFooter WPSideBar ImageObject EntryPoint".split())
_SITE = frozenset("WebSite Organization Person Corporation Periodical Newspaper".split())
_NOBODY = frozenset("admin administrator root webmaster editor staff anonymous unknown guest".split())
_LISTING = 3

Record = dict[str, Any]


def text_of(value: Any) -> str | None:
    """The first text in a value: itself, of a list the first one, of an object its name."""
    if isinstance(value, str):
        return " ".join(value.split()) or None
    if isinstance(value, list):
        return next((t for v in value if (t := text_of(v))), None)
    if isinstance(value, dict):
        return text_of(value.get("name"))
    return None


def listed(value: Any) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def address_of(value: Any) -> str | None:
    if isinstance(value, list):
        return next((t for v in value if (t := address_of(v))), None)
    if isinstance(value, dict):
        return next((t for k in ("url", "contentUrl", "@id") if (t := address_of(value.get(k)))), None)
    return value.strip() or None if isinstance(value, str) else None


def names_of(value: Any) -> str | None:
    found = [t for v in (value if isinstance(value, list) else [value]) if (t := text_of(v))]
    return ", ".join(dict.fromkeys(found)) or None


def _rank(types: list[str]) -> int | None:
    if not types or any(t in _SITE or t.endswith("Organization") for t in types):
        return None
    ranks = [0 if t in _SUBJECTS or t.endswith(("Article", "Posting")) or t == "Report" else 2 if t.endswith("Page") else 1 for t in types if t not in _AROUND]
    return min(ranks) if ranks else None


def subject(records: list[Record], names: set[str]) -> Record | None:
    """The record a page is about. A type of three records or more is a listing, unless one name or one offer tells its record."""
    counts = Counter(t for r in records for t in set(r["types"]))

    def one(name: str) -> Record | None:
        same = [r for r in records if name in r["types"]]
        said = {text_of(r["fields"]["name"][0]) if "name" in r["fields"] else None for r in same}
        if len(said) == 1 and None not in said:
            return same[0]
        offered = [r for r in same if "offers" in r["fields"]]
        return offered[0] if len(offered) == 1 else None

    chosen = {t: one(t) for t, n in counts.items() if n >= _LISTING}
    left = [(rank, k, r) for k, r in enumerate(records) if (rank := _rank(r["types"])) is not None and all(counts[t] < _LISTING or chosen[t] is r for t in r["types"])]
    if not left:
        return None
    article = any(t.endswith(("Article", "Posting")) for _, _, r in left for t in r["types"])
    named = lambda r: bool(article and "name" in r["fields"] and (text_of(r["fields"]["name"][0]) or "").casefold() in names)
    best = min(left, key=lambda x: (x[0], named(x[2]), x[1]))[2]
    entity = best["fields"].get("mainEntity")
    if entity and entity[1] in THINGS and isinstance(entity[0], dict):
        types = listed(entity[0].get("@type"))
        rank, own = _rank(types), _rank(best["types"])
        if rank is not None and (own is None or rank < own):
            return {"types": types, "source": entity[1], "fields": {k: (v, entity[1]) for k, v in entity[0].items() if not k.startswith("@")}}
    return best


def twins(about: Record | None, records: list[Record]) -> list[Record]:
    """Other records of the subject's types and name, where a listing's worth of them stand on the page: one thing told of once a colour or size."""
    name = _said(about, "name", text_of)
    found = [r for r in records if r is not about and about is not None and set(r["types"]) == set(about["types"]) and _said(r, "name", text_of) == name]
    return found if name is not None and len(found) + 1 >= _LISTING else []


def members(about: Record | None, records: list[Record]) -> list[Record]:
    """The variants of a group of products: those it lists, or else the records that name it by its id, or by its name."""
    if about is None:
        return []
    listed_in, thing = about["fields"].get("hasVariant"), (about["types"] or ["Thing"])[0]
    if listed_in and listed_in[1] in THINGS:
        value, source = listed_in
        path = f"{thing}.hasVariant[{{}}]" if isinstance(value, list) else f"{thing}.hasVariant"
        return [{"types": [path.format(k)], "source": source, "fields": {n: (v, source) for n, v in x.items() if not n.startswith("@")}} for k, x in enumerate(listed(value)) if isinstance(x, dict)]
    if "ProductGroup" not in about["types"]:
        return []
    group, name = _said(about, "productGroupID", text_of), _said(about, "name", text_of)

    def of_it(r: Record) -> bool:
        own = _said(r, "inProductGroupWithID", text_of)
        parent = r["fields"].get("isVariantOf")
        if group is not None and own is not None:
            return own == group
        if not parent or parent[1] not in THINGS:
            return False
        if not isinstance(parent[0], dict):
            return group is not None and text_of(parent[0]) == group
        if group is not None and "productGroupID" in parent[0]:
            return text_of(parent[0]["productGroupID"]) == group
        return name is not None and text_of(parent[0].get("name")) == name

    return [r for r in records if r is not about and of_it(r)]


def _said(record: Record | None, key: str, read) -> str | None:
    held = record["fields"].get(key) if record else None
    return read(held[0]) if held and held[1] in THINGS else None


def _priced(record: Record) -> dict[str, tuple[str, str]]:
    """prices() of a record, with the thing in each path."""
    held = record["fields"].get("offers")
    thing = record["types"][0] if record["types"] else "Thing"
    return {q: (v, f"{thing}.{at}") for q, (v, at) in prices(held[0]).items()} if held and held[1] in THINGS else {}


_MONEY = ("price", "price_regular", "price_low", "price_high", "currency", "availability")


def _shared(answers: list[dict[str, tuple[str, str]]]) -> dict[str, tuple[str, str]]:
    """The first's answers that all of them give."""
    return {q: answers[0][q] for q in _MONEY if answers and q in answers[0] and all(q in a and a[q][0] == answers[0][q][0] for a in answers)}


def _plain_amount(text: str) -> Decimal | None:
    """The number of a text that holds one; a separator before three digits at the end is a decimal point only if another kind stands before it."""
    found = _NUMBER.findall(text)
    if len(found) != 1:
        return None
    number = re.sub(r"[\s']", "", found[0])
    last = max(number.rfind("."), number.rfind(","))
    if last >= 0:
        sign, tail = number[last], number[last + 1 :]
        other = "," if sign == "." else "."
        grouped = number.count(sign) > 1 or (sign == "," and len(tail) == 3 and other not in number)
        number = re.sub("[.,]", "", number) if grouped else re.sub("[.,]", "", number[:last]) + "." + tail
    try:
        return Decimal(number)
    except ArithmeticError:
        return None


def _across(each: list[dict[str, tuple[str, str]]]) -> dict[str, tuple[str, str]]:
    """What variants say together: what all say alike; of prices that differ the range, if they are amounts of one currency."""
    out = _shared(each)
    sold = [a for a in each if "price" in a]
    currencies = {a["currency"][0] if "currency" in a else None for a in sold}
    if len(currencies) == 1 and "currency" in sold[0]:
        out.setdefault("currency", sold[0]["currency"])
    for q in ("price_low", "price_high"):
        out.pop(q, None)
    if "price" not in out:
        out.pop("price_regular", None)
        amounts = [(_plain_amount(one_number(a["price"][0]) or ""), k) for k, a in enumerate(sold)]
        if len(sold) > 1 and len(currencies) == 1 and all(n is not None for n, _ in amounts):
            out["price_low"] = sold[min(amounts)[1]]["price"]
            out["price_high"] = sold[max(amounts, key=lambda x: (x[0], -x[1]))[1]]["price"]
        else:
            out.pop("currency", None)
    return out


def _offers(value: Any, path: str) -> list[tuple[dict, str]]:
    found: list[tuple[dict, str]] = []
    for k, item in enumerate(value if isinstance(value, list) else [value]):
        if isinstance(item, dict):
            here = f"{path}[{k}]" if isinstance(value, list) else path
            found.append((item, here))
            if "offers" in item:
                found += _offers(item["offers"], f"{here}.offers")
    return found


def _kind(spec: dict) -> str:
    if spec.get("validForMemberTier") is not None:
        return "other"
    said = (text_of(spec.get("priceType")) or "").rstrip("/").rsplit("/", 1)[-1].lower()
    return "active" if not said else "regular" if said in ("strikethroughprice", "listprice") else "other"


_NUMBER = re.compile(r"\d(?:[\d.,'\s]*\d)?(?:[eE][+-]?\d+)?")


def one_number(text: str | None) -> str | None:
    return text if text is not None and len(_NUMBER.findall(text)) == 1 else None


def prices(offers: Any) -> dict[str, tuple[str, str]]:
    """Prices by their question, with the path each was read at; currency and availability of the offer that has the price."""
    found, out = _offers(offers, "offers"), {}

    def put(question: str, value: Any, path: str) -> bool:
        said = text_of(value)
        if said and question not in out:
            out[question] = (said, path)
        return bool(said)

    for offer, path in found:
        specs = [(offer, path)]
        more = offer.get("priceSpecification")
        specs += [(s, f"{path}.priceSpecification[{k}]" if isinstance(more, list) else f"{path}.priceSpecification") for k, s in enumerate(more if isinstance(more, list) else [more]) if isinstance(s, dict)]
        for spec, at in specs:
            if "price" in spec and _kind(spec) == "active" and "price" not in out:
                if put("price", spec["price"], f"{at}.price"):
                    put("currency", spec.get("priceCurrency"), f"{at}.priceCurrency") or put("currency", offer.get("priceCurrency"), f"{path}.priceCurrency")
            elif "price" in spec and _kind(spec) == "regular":
                put("price_regular", spec["price"], f"{at}.price")
        if "price" in out:
            put("availability", offer.get("availability"), f"{path}.availability")
            break
        out.pop("price_regular", None)
    for offer, path in found:
        if "price_low" not in out and "price_high" not in out:
            put("price_low", offer.get("lowPrice"), f"{path}.lowPrice")
            put("price_high", offer.get("highPrice"), f"{path}.highPrice")
            if "price" not in out and ("price_low" in out or "price_high" in out):
                put("currency", offer.get("priceCurrency"), f"{path}.priceCurrency")
    for offer, path in found:
        put("availability", offer.get("availability"), f"{path}.availability")
        if not {"price", "price_low", "price_high"} & set(out):
            put("currency", offer.get("priceCurrency"), f"{path}.priceCurrency")
    return out


def short(text: str | None) -> str | None:
    """A schema.org address as its last word."""
    return re.sub(r"^https?://schema\.org/", "", text.strip()) or None if text else None


def _crumbs(records: list[Record]) -> str | None:
    lists = [r for r in records if "BreadcrumbList" in r["types"] and "itemListElement" in r["fields"]]
    if not lists:
        return None
    value, named = lists[-1]["fields"]["itemListElement"][0], []
    for order, item in enumerate(value if isinstance(value, list) else [value]):
        if not isinstance(item, dict):
            continue
        said = next((t for v in (item.get("name"), item.get("item")) if (t := text_of(v)) and not re.match(r"^(https?:)?//", t)), None)
        try:
            at = float(item.get("position", order))
        except (TypeError, ValueError):
            at = float(order)
        if said:
            named.append((at if math.isfinite(at) else float(order), order, said))
    return " > ".join(s for _, _, s in sorted(named)) or None


def host(url: str | None) -> set[str]:
    found = re.match(r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", (url or "").lower())
    return {found[1], found[1].removeprefix("www.")} if found else set()


def candidates(page: dict[str, Any], records: list[Record], doc: dict[tuple[str, str], str]) -> list[tuple[str, int, str, str, str]]:
    """(question, rank, value, source, key) of every declaration that answers a question, in the order they are asked."""
    out: list[tuple[str, int, str, str, str]] = []
    rank = Counter()

    def add(question: str, value: str | None, source: str, key: str) -> None:
        rank[question] += 1
        value = " ".join(value.split()) if value else None
        if value:
            out.append((question, rank[question], value, source, key))

    def meta(question: str, reader: str, key: str, how=lambda t: t) -> None:
        value = how(doc.get((reader, key)))
        if not value:
            rank[question] += 1
            return
        shown = {"opengraph": "" if key.startswith(("article:", "product:", "book:", "profile:", "video:", "music:")) else "og:", "twitter": "twitter:", "dublincore": "dc.", "html": "meta name="}[reader]
        add(question, value, reader, shown + key)

    def of(record: Record | None, question: str, key: str, read=text_of) -> None:
        held = record["fields"].get(key) if record else None
        said = read(held[0]) if held and held[1] in THINGS else None
        if said and held[1] == "jsonld":
            said = entities.unescape(said)
        add(question, said, held[1] if held else "", f"{record['types'][0] if record and record['types'] else 'Thing'}.{key}")

    site = next((r for r in records if "WebSite" in r["types"]), None)
    organisation = next((r for r in records if set(r["types"]) & {"Organization", "Corporation"}), None)
    meta("site_name", "opengraph", "site_name")
    of(site, "site_name", "name")
    meta("site_name", "html", "application-name")
    names = {v.casefold() for q, _, v, _, _ in out if q == "site_name"} | host(page["url"])
    publishers = {t.casefold() for r in records if any(x in _SITE or x.endswith("Organization") for x in r["types"]) and "name" in r["fields"] and (t := text_of(r["fields"]["name"][0]))}
    about = subject(records, names | publishers)
    others, variants = twins(about, records), members(about, records)

    def own(q: str, k: str, read=text_of) -> None:
        said = _said(about, k, read)
        if said is None and variants:
            answers = {_said(v, k, read) for v in variants}
            of(variants[0] if len(answers) == 1 else None, q, k, read)
        elif any(_said(x, k, read) != said for x in others):
            of(None, q, k, read)  # it is one variant's, and not the thing's
        else:
            of(about, q, k, read)


    headline = (doc.get(("opengraph", "title")) or page["title"] or "").casefold()
    order = ("headline", "name")
    if about and all(k in about["fields"] for k in order):
        said = [(text_of(about["fields"][k][0]) or "").casefold() for k in order]
        if headline and said[1] and headline.startswith(said[1]) and not headline.startswith(said[0]):
            order = order[::-1]
    for k in order:
        own("title", k)
    meta("title", "opengraph", "title")
    meta("title", "twitter", "title")
    meta("title", "dublincore", "title")
    add("title", page["title"], "html", "<title>")
    own("description", "description")
    for reader in ("opengraph", "twitter", "html"):
        meta("description", reader, "description")
    meta("description", "dublincore", "description")
    add("url", page["canonical"], "html", "link rel=canonical")
    meta("url", "opengraph", "url")
    own("url", "url", address_of)
    own("image", "image", address_of)
    for k in ("image", "image:url", "image:secure_url"):
        meta("image", "opengraph", k)
    meta("image", "twitter", "image")
    own("image", "thumbnailUrl", address_of)

    before = len(out)
    own("author", "author", names_of)
    own("author", "creator", names_of)
    meta("author", "html", "author", lambda t: re.sub(r"(?i)^by\s+", "", t) if t else t)
    meta("author", "dublincore", "creator")
    meta("author", "opengraph", "article:author", lambda t: None if t and re.match(r"^(https?:)?//", t) else t)
    people = {t.casefold() for r in records if "publisher" in r["fields"] for p in [r["fields"]["publisher"][0]] if isinstance(p, dict) and "Person" in listed(p.get("@type")) and (t := text_of(p))}
    out[before:] = [c for c in out[before:] if (c[2].casefold() not in names or c[2].casefold() in people) and c[2].casefold() not in _NOBODY and any(x.isalpha() for x in c[2])]

    for k in ("datePublished", "uploadDate", "dateCreated"):
        own("published", k)
    meta("published", "opengraph", "article:published_time")
    for k in ("date.issued", "issued", "date", "created"):
        meta("published", "dublincore", k)
    own("modified", "dateModified")
    meta("modified", "opengraph", "article:modified_time")
    meta("modified", "opengraph", "updated_time")
    meta("modified", "dublincore", "modified")
    add("language", page["lang"], "html", "html lang")
    own("language", "inLanguage")
    meta("language", "opengraph", "locale", lambda t: t.replace("_", "-") if t else t)
    meta("language", "dublincore", "language")
    own("publisher", "publisher", names_of)
    meta("publisher", "dublincore", "publisher")
    of(organisation, "publisher", "name")
    add("type", about["types"][0] if about and about["types"] else None, about["source"] if about else "", "@type")
    meta("type", "opengraph", "type")

    held = about["fields"].get("offers") if about else None
    priced = _priced(about) if about else {}
    if others:
        common = _shared([priced, *map(_priced, others)])
        priced = {q: v for q, v in priced.items() if q in common}
    if held is None and variants:
        priced, held = _across([_priced(v) for v in variants]), (None, variants[0]["source"])
    thing = about["types"][0] if about and about["types"] else "Thing"
    for q in ("price", "price_regular", "price_low", "price_high"):
        said = priced.get(q)
        add(q, one_number(said[0]) if said else None, held[1] if held else "", said[1] if said else "")
    for k in ("price:amount", "product:price:amount"):
        meta("price", "opengraph", k, one_number)
    for q, keys in (("currency", ("price:currency", "product:price:currency")), ("availability", ("availability", "product:availability"))):
        said = priced.get(q)
        add(q, (short(said[0]) if q == "availability" else said[0]) if said else None, held[1] if held else "", said[1] if said else "")
        for k in keys:
            meta(q, "opengraph", k, short if q == "availability" else (lambda t: t))
    own("brand", "brand", names_of)
    meta("brand", "opengraph", "brand")
    meta("brand", "opengraph", "product:brand")
    own("sku", "sku")
    own("sku", "productID")
    for k in ("product:retailer_item_id", "sku", "product:sku"):
        meta("sku", "opengraph", k)
    for k in ("gtin14", "gtin13", "gtin12", "gtin8", "gtin", "isbn"):
        own("gtin", k)
    own("mpn", "mpn")
    rating = about["fields"].get("aggregateRating") if about else None
    if rating and rating[1] in THINGS:
        value = next((v for v in (rating[0] if isinstance(rating[0], list) else [rating[0]]) if isinstance(v, dict)), {})
        for q, keys in (("rating", ("ratingValue",)), ("rating_best", ("bestRating",)), ("rating_count", ("ratingCount", "reviewCount"))):
            for k in keys:
                add(q, text_of(value.get(k)), rating[1], f"{thing}.aggregateRating.{k}")
    add("breadcrumb", _crumbs(records), "jsonld", "BreadcrumbList.itemListElement")
    return out
