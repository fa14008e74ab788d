"""A crawl over pages that are already there: breadth first, admitted in one order, resumed by an anti join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions import scalars
from loomgrain.sources.tables import kept, shared_path

_TAKEN = "address string, depth int, found_on string, place long"


def admitted(address: Column, site: str | None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether the rules let an address in: on the site, fitting an ``include`` if there are some, no ``exclude``, and no file."""
    # the patterns first: they are cheaper to ask than what takes an address apart
    ok = address.isNotNull()
    if include:
        ok &= reduce(lambda a, b: a | b, (address.rlike(p) for p in include))
    for pattern in exclude:
        ok &= ~address.rlike(pattern)
    ok &= ~F.coalesce(scalars.names_a_file(address), F.lit(False))
    return ok if site is None else ok & (scalars.site(address) == site)


def crawl(links: DataFrame, start: str, max_pages: int | None = 100, max_depth: int = 3, allowed: Column | None = None, also: DataFrame | None = None) -> DataFrame:
    """address, depth, found_on and place (rising in the order of admission) of every address that a crawl takes.

    ``links`` has source, ord and target, normalised. ``allowed`` is a condition on ``target``. ``also`` has address and other: the names under which a
    page that was taken is known too (where it landed, its canonical), which aren't taken again. An address is taken from the first page, in order,
    and the first place on it that links to it. One anti join and one aggregation a level; the order within a level is a range sort's, whose
    row ids rise with it, so that no level meets in one task. Levels are written to the shared folder: what is known is one table however deep
    the crawl went, and an id that was given stays. ``max_pages`` is the crawl's own limit; None takes all.
    """
    spark = links.sparkSession
    folder = shared_path(spark, "crawl")
    edges = links.select("source", "ord", "target").where("target is not null")
    if allowed is not None:
        edges = edges.where(allowed)
    level = spark.createDataFrame([(start, 0, None, 0)], _TAKEN)
    level.write.parquet(f"{folder}/taken/level=0")
    _known(level, also).write.parquet(f"{folder}/known/level=0")
    count = 1
    for depth in range(1, max_depth + 1):
        left = None if max_pages is None else max_pages - count
        if left is not None and left <= 0:
            break
        known = spark.read.schema("address string").parquet(f"{folder}/known")
        found = level.select(F.col("address").alias("source"), F.col("place").alias("from")).join(edges, "source").groupBy("target").agg(F.min(F.struct("from", "ord", "source")).alias("first"))
        new = found.join(known.select(F.col("address").alias("target")), "target", "left_anti").select(F.col("target").alias("address"), F.lit(depth).alias("depth"), F.col("first.source").alias("found_on"), "first")
        ordered = new.orderBy("first") if left is None else new.orderBy("first").limit(left)
        # ids of a sorted frame rise with its order; those of a level begin behind the last one's
        ordered.select("address", "depth", "found_on", (F.monotonically_increasing_id() + (depth << 50)).alias("place")).write.parquet(f"{folder}/taken/level={depth}")
        level = spark.read.schema(_TAKEN).parquet(f"{folder}/taken/level={depth}")
        n = level.count()
        if not n:
            break
        count += n
        _known(level, also).write.parquet(f"{folder}/known/level={depth}")
    return spark.read.schema(_TAKEN).parquet(f"{folder}/taken")


def _known(level: DataFrame, also: DataFrame | None) -> DataFrame:
    own = level.select("address")
    return own if also is None else own.unionByName(level.select("address").join(also, "address").select(F.col("other").alias("address")))


def in_batch(urls: DataFrame) -> DataFrame:
    """ord and address of listed addresses, each once at its first place; what is no address of a page is left out."""
    # an address that is listed again as it stands is taken apart once
    once = urls.groupBy("url").agg(F.min("ord").alias("ord"))
    rows = once.select("ord", scalars.normalised_url(F.col("url")).alias("address")).where("address is not null")
    return rows.groupBy("address").agg(F.min("ord").alias("ord")).select("ord", "address")


def unfinished(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """What a run that goes on still has to take: the addresses of ``wanted`` that ``done`` hasn't."""
    return wanted.join(done.select("address"), "address", "left_anti")


def map_site(sitemaps: DataFrame, start: list[str], site: str, most: int = 100) -> DataFrame:
    """address and modified that a site's sitemaps list, indexes followed on the same site; each file once, ``most`` files at most.

    ``sitemaps`` is sitemap_urls()'s of all files that are there.
    """
    spark = sitemaps.sparkSession
    known = level = spark.createDataFrame([(x,) for x in start[:most]], "file string")
    n = len(start[:most])
    while n < most:
        more = sitemaps.where("kind = 'sitemap'").join(level, "file").select(F.col("address").alias("file"), "ord").where(scalars.site(F.col("file")) == site)
        more = more.join(known, "file", "left_anti").groupBy("file").agg(F.min("ord").alias("ord")).orderBy("ord", "file").limit(most - n).select("file")
        level = kept(more)
        found = level.count()
        if not found:
            break
        n += found
        known = known.unionByName(level)
    urls = sitemaps.where("kind = 'url'").join(known, "file").where(scalars.site(F.col("address")) == site)
    return urls.groupBy("address").agg(F.max("modified").alias("modified"))


def visited(wanted: DataFrame, pages: DataFrame, site: str | None = None, denied: DataFrame | None = None) -> DataFrame:
    """address, landed, status, html and error of every wanted address, from pages that are already there.

    ``wanted`` has address; ``pages`` url, status, landed (where redirects ended, null for where they began) and html; ``denied`` the addresses that robots.txt or
    a reservation of rights keeps out. error, the first that holds: ``denied``, ``missing`` (no such page), ``off-site`` (it landed elsewhere), ``http`` (a
    status from 400 on), ``empty`` (no html), or null; html is null where there is one. Of pages of one address that with the least status and html counts.
    """
    own = pages.select(scalars.normalised_url(F.col("url")).alias("address"), F.coalesce(scalars.normalised_url(F.col("landed")), scalars.normalised_url(F.col("url"))).alias("landed"), "status", "html")
    one = own.where("address is not null").groupBy("address").agg(F.min(F.struct("status", "landed", "html")).alias("p"), F.lit(True).alias("there"))
    rows = wanted.select("address").distinct().join(one, "address", "left")
    kept_out = F.lit(False)
    if denied is not None:
        rows = rows.join(denied.select("address").distinct().withColumn("denied", F.lit(True)), "address", "left")
        kept_out = F.coalesce("denied", F.lit(False))
    away = (scalars.site(F.col("p.landed")) != site) if site is not None else (scalars.site(F.col("p.landed")) != scalars.site(F.col("address")))
    error = F.when(kept_out, "denied").when(F.col("there").isNull(), "missing").when(away, "off-site").when(F.col("p.status") >= 400, "http").when(F.coalesce(F.trim("p.html"), F.lit("")) == "", "empty")
    told = rows.withColumn("error", error)
    seen = F.col("error").isNull() | ~F.col("error").isin("denied", "missing")
    return told.select("address", F.when(seen, F.col("p.landed")).alias("landed"), F.when(seen, F.col("p.status")).alias("status"), F.when(F.col("error").isNull(), F.col("p.html")).alias("html"), "error")


def sitemap_crawl(sitemaps: DataFrame, start: list[str], site: str, pages: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), most: int = 100, denied: DataFrame | None = None) -> DataFrame:
    """visited() of all addresses that a site's sitemaps list and the patterns admit; robots.txt's sitemaps are the ``start``."""
    listed = map_site(sitemaps, start, site, most).where(admitted(F.col("address"), site, include, exclude))
    return visited(listed, pages, site, denied)


def cached(captures: DataFrame, wanted: DataFrame, oldest: float) -> DataFrame:
    """as_of() with stale: whether the capture is older than ``oldest`` seconds, or there is none, so that the page is to be fetched again."""
    found = as_of(captures, wanted)
    age = F.col("at").cast("double") - F.col("ts").cast("double")
    return found.withColumn("stale", F.coalesce(age > oldest, F.lit(True)))


def rungs(fetches: DataFrame, first: int = 0) -> DataFrame:
    """site and rung at which a site's next fetch begins: the rung of its last fetch that worked, or one above its last that didn't if nothing worked since.

    ``fetches`` has site, at (rising), rung (0 is the cheapest) and ok.
    """
    each = fetches.groupBy("site").agg(F.max_by("rung", F.when(F.col("ok"), F.col("at"))).alias("good"), F.max(F.when(F.col("ok"), F.col("at"))).alias("good_at"), F.max_by("rung", F.when(~F.col("ok"), F.col("at"))).alias("bad"), F.max(F.when(~F.col("ok"), F.col("at"))).alias("bad_at"))
    failed_since = F.col("bad_at").isNotNull() & (F.col("good_at").isNull() | (F.col("bad_at") > F.col("good_at")))
    return each.select("site", F.when(failed_since, F.greatest(F.col("bad") + 1, F.lit(first))).otherwise(F.coalesce("good", F.lit(first))).alias("rung"))


def scheduled(tasks: DataFrame, delays: DataFrame, least: float = 1.0) -> DataFrame:
    """site, seq, ready and start of every task, one at a time for each site, its delay apart.

    ``tasks`` has site, seq and ready (seconds). With a delay of d, task i starts at the latest of ready[j] + (i - j) d over all j up to i,
    which is a running maximum; a site's tasks are one order by nature.
    """
    order = Window.partitionBy("site").orderBy("seq")
    d = F.greatest(F.coalesce("delay", F.lit(least)), F.lit(least))
    t = tasks.join(delays, "site", "left").select("site", "seq", "ready", d.alias("d"), F.row_number().over(order).alias("i"))
    latest = F.max(F.col("ready") - F.col("i") * F.col("d")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return t.select("site", "seq", "ready", (latest + F.col("i") * F.col("d")).alias("start"))


def retried(fetches: DataFrame, most: int = 3, first: float = 1.0, ceiling: float = 60.0) -> DataFrame:
    """address, attempt, status, retry and wait (seconds): whether an answer is asked for again, after a pause that doubles up to a ceiling.

    ``fetches`` has address, attempt (from 1), status (null where nothing answered) and retry_after (seconds, may be null).
    """
    worth = F.col("status").isNull() | F.col("status").isin(429, 500, 502, 503, 504)
    wait = F.least(F.coalesce(F.col("retry_after").cast("double"), F.lit(first) * F.pow(F.lit(2.0), F.col("attempt") - 1)), F.lit(ceiling))
    retry = worth & (F.col("attempt") < most)
    return fetches.select("address", "attempt", "status", retry.alias("retry"), F.when(retry, wait).alias("wait"))


def as_of(captures: DataFrame, wanted: DataFrame) -> DataFrame:
    """url, at, ts and the capture: of each wanted address the last capture no later than ``at``; null where there is none.

    ``captures`` has url, ts and capture; ``wanted`` url and at. Per address one sorted pass, by a window over both sides together.
    """
    both = captures.select("url", F.col("ts").alias("t"), F.lit(0).alias("side"), F.struct("ts", "capture").alias("c")).unionByName(
        wanted.select("url", F.col("at").alias("t"), F.lit(1).alias("side"), F.lit(None).cast(f"struct<ts:{captures.schema['ts'].dataType.simpleString()},capture:{captures.schema['capture'].dataType.simpleString()}>").alias("c"))
    )
    held = F.last("c", ignorenulls=True).over(Window.partitionBy("url").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("held", held).where("side = 1").select("url", F.col("t").alias("at"), "held.ts", "held.capture")


# --- decisions about fetched pages

REFUSING = (401, 403, 407, 429)
TEXT_FLOOR, MARKUP_CEILING, CHALLENGE_CEILING = 200, 2000, 1500
#: Titles and marks of pages that stand before the content.
CHALLENGE_TITLES = ("just a moment", "attention required! | cloudflare", "ddos-guard", "client challenge", "making sure you're not a bot!", "one moment, please")
CHALLENGE_MARKS = ("cf-challenge", "challenge-platform", "just a moment", "checking your browser", "__cf_chl", "enable javascript and cookies to continue", "/_fs-ch-", "/_incapsula_resource", "px-captcha", "anubis_challenge")


def visible_text(html: Column) -> Column:
    """A page without scripts, styles and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(bare, r"<[^>]*>", " "))


def why_climb(fetched: DataFrame) -> DataFrame:
    """url and reason why a page needs a better way to be fetched: ``challenge``, ``refused``, ``skeletal``, ``script``, or null.

    ``fetched`` has url, status, html and declares (whether it says something about a thing).
    """
    title = F.rtrim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1), r"\s+", " "))), "[.… ]+$", ""))
    t = fetched.select("url", "status", "html", "declares", title.alias("title"), F.length(visible_text(F.col("html"))).alias("n"))
    lower = F.lower("html")
    marked = reduce(lambda a, b: a | b, (lower.contains(m) for m in CHALLENGE_MARKS))
    challenge = F.col("title").isin(*CHALLENGE_TITLES) | F.col("title").startswith("checking your browser") | (~F.col("declares") & (F.col("n") < CHALLENGE_CEILING) & marked)
    script = F.col("html").rlike(r"""(?i)<script\b(?![^>]*\btype\s*=\s*["']?application/(?:ld\+)?json)[^>]*>""")
    reason = (
        F.when(challenge, "challenge")
        .when(F.col("status").isin(*REFUSING), "refused")
        .when((F.col("status") >= 400) | F.col("declares") | (F.col("n") >= TEXT_FLOOR), None)
        .when(F.length("html") > MARKUP_CEILING, "skeletal")
        .when(script, "script")
    )
    return t.select("url", reason.alias("reason"))


def within_budget(rows: DataFrame, key: str, order: str, size: Column, most: int) -> DataFrame:
    """Rows of each ``key`` in ``order`` while their sizes sum up to ``most`` or less, with n_left_out: how many of the key aren't given."""
    w = Window.partitionBy(key).orderBy(order)
    t = rows.withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_fits", F.col("_sum") <= most)
    out = F.count_if(~F.col("_fits")).over(Window.partitionBy(key))
    return t.withColumn("n_left_out", out).where("_fits").drop("_sum", "_fits")
