import hashlib
import random
import re

from loomgrain.llm import secret_scan as ss
from loomgrain.sources.tables import table
from tests.llm.helpers import LONG, ODD, docs, empty

BASE = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def slow(text):
    spans = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            if {"assign": len(m[2]) >= 8 if kind == "assign" else 0, "access": len(m[0]) >= 16, "hex": len(m[0]) >= 32}[kind]:
                spans.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]


def want(rows):
    out = []
    for doc, text, *_ in rows:
        spans = slow(text)
        count = [sum(s.startswith(k) for s in spans) for k in BASE]
        out.append((doc, *count, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in ss.digest(df).collect()), key=str)


def test_odd_rows(spark):
    rnd = random.Random(2)
    bits = ["password", "API_KEY", "apikey", "Token", "secret", "=", ":", " ", '"', "'", "abcdefgh", "abc", "AKIA", "ABCDEFGHIJKL", "deadbeef" * 4, "deadbeef", "😀", "é", "\n", "ſecret", "toKen", "-", "."]
    rows = [*ODD, *((50 + k, "".join(rnd.choices(bits, k=rnd.randrange(60)))) for k in range(300))]
    rows += [(1000, "deadbeef" * 5 + " x " + "0f" * 16), (1000, "deadbeef" * 5 + " x " + "0f" * 16), (1001, LONG + "token=abcdefgh" * 500)]
    df = docs(spark, rows, ["row", "kind", "begin", "hash", "owner"])
    assert got(df) == want(rows)
    assert ss.digest(empty(spark)).count() == 0


def test_a_table(spark, tiny):
    documents = table(spark, tiny, "documents")
    assert got(documents) == want([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_owners_part_examples_from_live_secrets(spark):
    copied, own = "ghp_" + "Zq3" * 13, "ghp_" + "Kp7" * 13
    rows = [(k, f"see {copied} here", None, f"owner{k}") for k in range(6)] + [(10, f"mine {own}", None, "one"), (11, f"again {own}", None, "one"), (12, "token=example1234567", None, None)]
    rows_, spans = ss.scan(docs(spark, rows))
    assert rows_.count() == 9
    told = {(r["kind"], r["verdict"], r["n_owners"], r["n_repositories"]) for r in spans.collect()}
    assert told == {(3, "live", 1, 2), (0, "example", 1, 1)}
    by = {r["doc_id"]: r for r in ss.digest(docs(spark, rows)).collect()}
    assert by[10]["spans"] == f"format:5:{5 + len(own)}" and by[10]["n_live"] == 1 and by[0]["spans"] == ""
    assert by[10]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[12]["ownership"] == "example:1:1" and by[10]["ownership"] == "live:1:2"


SECRET = "kX9mQ2vLpR7tYw4zB8nC"


def spans_of(spark, rows):
    return {r["doc_id"]: (r["spans"], r["ownership"]) for r in ss.digest(docs(spark, rows)).collect()}


def test_the_same_text_is_live_or_an_example_by_who_has_it(spark):
    """One text; only the owners of the other documents that hold its value differ."""
    line = f"connect with {SECRET} now"
    span = f"entropy:13:{13 + len(SECRET)}"
    many = [(k, line, None, f"owner{k}") for k in range(5)]
    assert set(spans_of(spark, many).values()) == {("", "")}
    assert set(spans_of(spark, many[:3]).values()) == {(span, "live:3:3")}
    # five owners, but one of them has most of the repositories: the others copied it
    leaked = many + [(10 + k, line, None, "owner0") for k in range(6)]
    assert set(spans_of(spark, leaked).values()) == {(span, "live:5:11")}
    # a base span stays whatever the verdict, which tells of copies without the keyword too
    keyed = [*many, (9, f"token={SECRET}", None, "owner0")]
    assert spans_of(spark, keyed)[9] == (f"assign:0:{6 + len(SECRET)}", "example:5:6")
    assert spans_of(spark, keyed[4:])[9] == (f"assign:0:{6 + len(SECRET)}", "live:2:2")


def test_what_is_random_enough(spark):
    rows = [(1, "aA1" * 10), (2, "thisisonelongwordofsmallletters"), (3, SECRET[:19]), (4, f"x{SECRET}"), (5, f"[{SECRET}] and {SECRET[::-1]}"), (6, "A" * 50_000 + SECRET)]
    found = spans_of(spark, rows)
    assert sorted(k for k in found if found[k][0]) == [4, 5] and found[5][0] == "entropy:1:21,entropy:27:47"


def test_one_value_in_a_third_of_all_rows(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr(f"case when id % 3 = 0 then 'see {SECRET}' when id % 3 = 1 then concat('token=', md5(string(id))) else 'none' end").alias("text"), F.expr("concat('owner', id % 700)").alias("source"))
    found = ss.digest(df).groupBy("ownership").count().collect()
    assert {r["ownership"]: r["count"] for r in found} == {"": 2000, "live:1:1,live:1:1": 1000}


def test_the_sql_twin(spark, tmp_path):
    import duckdb

    rnd = random.Random(4)
    values = ["".join(rnd.choices("abcDEF0123456789xyzQRS", k=24)) for _ in range(6)] + [SECRET, "deadbeef" * 4, "AKIA" + "Z" * 12, "ghp_" + "Kp7" * 13, "x" * 30]
    rows = [*ODD, *((50 + k, " ".join(rnd.choice([rnd.choice(values), f"token={rnd.choice(values)}", "é", "\n", "word"]) for _ in range(rnd.randrange(12))), None, f"o{rnd.randrange(6)}") for k in range(200))]
    df = docs(spark, rows)
    df.write.parquet(f"{tmp_path}/documents")
    told = duckdb.connect()
    told.sql(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    theirs = told.sql(ss.SQL)
    ours = ss.digest(df)
    assert sorted(theirs.columns) == sorted(ours.columns)
    order = sorted(ours.columns)
    assert sorted((tuple(r[c] for c in order) for r in ours.collect()), key=str) == sorted(theirs.select(*order).fetchall(), key=str)


def test_main_path_is_native(spark, tiny):
    plan = ss.digest(table(spark, tiny, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
