"""Secrets in texts, and which of them are widely copied examples, in DataFrame functions alone.

Patterns give candidates with their places. The places come from the lengths of the matches and of the pieces
between them, summed along the text by a window over the text's own rows. Then ownership frequency over the whole corpus
parts the candidates: a value's hash is aggregated by distinct owners and repositories, in steps that each combine before
they shuffle. A value of more than OWNERS owners, of whom none has SHARE of its repositories, is an ``example``: it was copied from
one to another. One of few owners, or of many that mostly copied one owner's, is ``live``, unless it is made of placeholder words.

``assign``, ``access`` and ``hex`` always stay in the spans. The method adds two kinds where ownership makes them live: ``format``, tokens
of known issuers, and ``entropy``, runs of mixed letters and digits with ENTROPY bits a letter that no other kind covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.llm.shared import written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is long enough is found whole; no shorter run hides one.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
FORMAT = (
    r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
)
RANDOM = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "format", "entropy")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, FORMAT, RANDOM), strict=True))
ADDED = ("format", "entropy")
ASSIGNED = 8
ENTROPY = 3.8
#: A value of more owners than this is an example, if no owner has this share of its repositories.
OWNERS = 3
SHARE = 0.5
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]?|xxxx|1234567890|0{8}"


def _pieces(text: Column, kind: str) -> Column:
    """The lengths of the pieces between the matches of a kind and the matches, null where there is none."""
    pattern = PATTERNS[kind]
    said = text.contains("AKIA") if kind == "access" else text.rlike(pattern)
    return F.when(
        said,
        F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gaps"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        ),
    )


def _mixed(value: Column) -> Column:
    """Whether letters of both cases and digits are in it, and enough bits in each of its letters."""
    n = F.length(value)
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda told, c: told - share(c) * F.log2(share(c)))
    return F.when(value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]"), bits >= ENTROPY).otherwise(False)


def _candidates(docs: DataFrame, repository: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (row, doc_id), and the candidates: row, kind, begin, end, value, repository, owner."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"),
        F.array_compact(F.array(*(_pieces(text, kind) for kind in KINDS))).alias("kinds"),
    )
    read = written(read, "secret-pieces")  # from here on a row keeps its number
    each = read.where(F.size("kinds") > 0).select("row", "repository", "owner", F.explode("kinds").alias("k"))
    each = each.select("row", "repository", "owner", F.col("k.kind").alias("kind"), F.col("k.gaps").alias("gaps"), F.posexplode("k.found").alias("nth", "said"))
    each = each.withColumn("gap", F.element_at("gaps", F.col("nth") + 1)).drop("gaps")
    along = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("gap").cast("long") + F.length("said")).over(along)).withColumn("begin", F.col("end") - F.length("said"))
    value = F.when(F.col("kind") == 0, F.regexp_extract("said", ASSIGN, 2)).otherwise(F.col("said"))
    placed = placed.withColumn("value", value).where(F.when(F.col("kind") == 0, F.length("value") >= ASSIGNED).when(F.col("kind") == KINDS.index("entropy"), _mixed(F.col("value"))).otherwise(True))
    before = Window.partitionBy("row").orderBy("begin", "kind").rowsBetween(Window.unboundedPreceding, -1)
    is_random = F.col("kind") == KINDS.index("entropy")
    covered = F.coalesce(F.max(F.when(~is_random, F.col("end"))).over(before) >= F.col("end"), F.lit(False))
    placed = placed.withColumn("covered", covered).where(~(is_random & F.col("covered")))
    return read.select("row", "doc_id"), placed.select("row", "repository", "owner", "kind", "begin", "end", "value")


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories and most (of one owner's repositories) of every candidate value; nulls count as one owner or repository."""
    each = candidates.groupBy("hash", "owner", "repository").agg(F.first("placeholder").alias("placeholder"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.first("placeholder").alias("placeholder"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"), F.max("n").alias("most"), F.first("placeholder").alias("placeholder"))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", owners: int = OWNERS) -> tuple[DataFrame, DataFrame]:
    """All rows (row, doc_id), and their spans: row, kind, begin, end, hash, n_owners, n_repositories and verdict.

    A null or empty text has no spans; each of repeated rows has its own. Begin and end are code points, end exclusive.
    """
    rows, found = _candidates(docs, repository, owner)
    found = written(found.withColumn("hash", F.sha2("value", 256)).withColumn("placeholder", F.col("value").rlike(PLACEHOLDER)).drop("value"), "secret-candidates")
    known = ownership(found)
    copied = (F.col("n_owners") > owners) & (F.col("most") < SHARE * F.col("n_repositories"))
    verdict = F.when(copied | F.col("placeholder"), "example").otherwise("live")
    spans = found.drop("placeholder", "repository", "owner").join(known, "hash").withColumn("verdict", verdict).drop("placeholder", "most")
    added = [KINDS.index(k) for k in ADDED]
    return rows, spans.where(~F.col("kind").isin(added) | (F.col("verdict") == "live"))


def digest(docs: DataFrame, **options) -> DataFrame:
    """Per document its counts, the digest of the base spans, all spans, how many of them look live, and verdict:n_owners:n_repositories of each.

    A row for each row of ``docs``, repeated ones too; a null or empty text has counts of 0 and no spans, and an empty table gives no rows.
    """
    rows, spans = scan(docs, **options)
    names = F.array(*(F.lit(k) for k in KINDS))
    told = F.array_sort(F.collect_list(F.struct("begin", "kind", "end", "verdict", "n_owners", "n_repositories")))
    listed = spans.groupBy("row").agg(told.alias("s"))

    def joined(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["begin"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("s", lambda x: x["kind"] == KINDS.index(kind))), F.lit(0)).cast("long").alias(f"n_{kind}")

    empty = F.array().cast("array<struct<begin:bigint,kind:int,end:bigint,verdict:string,n_owners:bigint,n_repositories:bigint>>")
    found = rows.join(listed, "row", "left").withColumn("s", F.coalesce("s", empty))
    base = F.filter("s", lambda x: ~x["kind"].isin([KINDS.index(k) for k in ADDED]))
    return found.select(
        "doc_id",
        *(count(k) for k in KINDS[:3]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("s")).alias("spans"),
        F.size(F.filter("s", lambda x: x["verdict"] == "live")).cast("long").alias("n_live"),
        F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["verdict"], x["n_owners"], x["n_repositories"])), ",").alias("ownership"),
    )


def _sql() -> str:
    """The query in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    told = " union all ".join(
        f"select row, doc_id, source, {k} as kind, '{kind}' as name, string_split_regex(t, {quoted(PATTERNS[kind])}) as gaps, regexp_extract_all(t, {quoted(PATTERNS[kind])}) as found from d"
        for k, kind in enumerate(KINDS)
    )
    random, added = KINDS.index("entropy"), ", ".join(quoted(k) for k in ADDED)
    return f"""
with d as (select row_number() over () as row, doc_id, source, coalesce(text, '') as t from documents),
each as ({told}),
one as (select row, doc_id, source, kind, name, gaps, found, unnest(range(1, len(found) + 1)) as nth from each),
placed as (
  select row, doc_id, source, kind, name, found[nth] as said, length(array_to_string(gaps[1:nth], '')) + length(array_to_string(found[1:nth], '')) as e,
    case when kind = 0 then regexp_extract(found[nth], {quoted(ASSIGN)}, 2) else found[nth] end as value
  from one),
fit as (
  select *, e - length(said) as b from placed
  where case when kind = 0 then length(value) >= {ASSIGNED}
    when kind = {random} then regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[0-9]') and list_aggregate(string_split(value, ''), 'entropy') >= {ENTROPY}
    else true end),
cover as (select *, max(case when kind <> {random} then e end) over (partition by row order by b, kind rows between unbounded preceding and 1 preceding) as over_end from fit),
c as (select * from cover where not (kind = {random} and coalesce(over_end >= e, false))),
by_owner as (select value, coalesce(source, '<null>') as owner, count(distinct coalesce(cast(doc_id as varchar), '<null>')) as n from c group by all),
known as (select value, count(*) as n_owners, sum(n) as n_repositories, max(n) as most from by_owner group by value),
judged as (
  select c.row, kind, name, b, e, n_owners, n_repositories,
    case when (n_owners > {OWNERS} and most < {SHARE} * n_repositories) or regexp_matches(c.value, {quoted(PLACEHOLDER)}) then 'example' else 'live' end as verdict
  from c join known using (value)),
kept as (select * from judged where name not in ({added}) or verdict = 'live'),
listed as (
  select row, count(*) filter (name = 'assign') as n_assign, count(*) filter (name = 'access') as n_access, count(*) filter (name = 'hex') as n_hex,
    string_agg(concat_ws(':', name, b, e), ',' order by b, kind, e) filter (name not in ({added})) as base,
    string_agg(concat_ws(':', name, b, e), ',' order by b, kind, e) as spans, count(*) filter (verdict = 'live') as n_live,
    string_agg(concat_ws(':', verdict, n_owners, n_repositories), ',' order by b, kind, e) as ownership
  from kept group by row)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(ownership, '') as ownership
from d left join listed using (row)"""


SQL = _sql()
