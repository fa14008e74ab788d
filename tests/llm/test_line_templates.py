from collections import defaultdict

from pyspark.sql import functions as F

from loomgrain.llm import line_templates as lt
from loomgrain.llm.shared import written
from loomgrain.sources.tables import table
from tests.llm.helpers import LONG, ODD, docs, empty


def cut(line):
    """The template of a line as it is."""
    words = [w for w in line.replace("\t", " ").replace("\r", " ").split(" ") if w]
    masked = ["<*>" if any(c in "0123456789" for c in w) else w for w in words]
    return tuple(words if 2 * masked.count("<*>") > len(words) else masked)


def slow(rows):
    """(doc_id, kept text, n_lines, n_dropped) by hand."""
    lines = []
    for n, (doc, text, *_) in enumerate(rows):
        key = (doc is None, -1 if doc is None else doc, text or "")
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            if len(cut(line)) > 1:
                lines.append((n, key, pos, cut(line)))

    def recurring(found, enough):
        owners = defaultdict(set)
        for _, key, _, t in found:
            owners[t].add(key)
        return {t: min(k) for t, k in owners.items() if len(k) >= enough(t)}

    gone, same = defaultdict(set), recurring(lines, lambda t: 2 if len(t) >= 50 else 3 if len(t) >= 5 else 10)
    for n, key, pos, t in lines:
        if t in same and key != same[t]:
            gone[n].add(pos)
    single = [x for x in lines if x[3] not in same and len(x[3]) >= 5 and not any(c in "0123456789" for w in x[3] for c in w)]
    leaves, words = defaultdict(int), defaultdict(int)
    leaf = lambda t: (len(t), t[: lt.DEPTH])
    for _, _, _, t in single:
        leaves[leaf(t)] += 1
        for at, w in enumerate(t):
            words[leaf(t), at, w] += 1
    general = set()
    for n, key, pos, t in single:
        for enough in (*lt.SUPPORTS, max(lt.MIN_DOCS, lt.COMMON * leaves[leaf(t)])):
            fixed = [w != "<*>" and words[leaf(t), at, w] >= enough for at, w in enumerate(t)]
            if leaves[leaf(t)] >= 3 and any(w != "<*>" for w in t) and sum(fixed) >= lt.CONSTANT * sum(w != "<*>" for w in t):
                general.add((n, key, pos, tuple(w if f else None for w, f in zip(t, fixed))))
    forms = recurring(general, lambda t: 3)
    for n, key, pos, t in general:
        if t in forms and key != forms[t]:
            gone[n].add(pos)
    out = []
    for n, (doc, text, *_) in enumerate(rows):
        every = [] if text is None else text.split("\n")
        kept = text if not gone[n] else "\n".join(x for i, x in enumerate(every) if i not in gone[n])
        out.append((doc, kept, len(every), len(gone[n])))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in lt.dedup(df).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str)


def test_templates_of_variable_fields(spark):
    names = "ada bea cid dov eva fay gus hal ivo jan".split()
    rows = [(10 - k, f"a line of its own number {'abcdefghij'[k]} with words\nUser {name} signed in from the office at the front desk on day {k}\nshort one") for k, name in enumerate(names)]
    found = got(docs(spark, rows))
    assert found == slow(rows)
    # all but the first document lose the line, whose name and number vary
    assert [x[3] for x in found if x[0] == 1] == [0]
    assert all(x[3] >= 1 for x in found if x[0] != 1)


def test_prose_stays(spark):
    rows = [(k, f"the river runs {w} past {x} banks and {y} fields") for k, (w, x, y) in enumerate(zip("abcdefg", "hijklmn", "opqrstu"))]
    assert all(x[3] == 0 for x in got(docs(spark, rows)))


def test_odd_rows(spark):
    same = "this very line stands in many of the documents"
    rows = [*ODD, (30, same), (31, same + "\n" + same), (31, same + "\n" + same), (32, f"x\n  {same.replace(' ', '  ')}\ty\n{same}"), (None, same), (33, f"{same}\n\n"), (34, LONG + "\n" + same)]
    df = docs(spark, rows, ["k", "pos", "gone", "own_key", "n_lines", "masked", "template"])
    assert got(df) == slow(rows)
    assert set(lt.dedup(df).columns) == {*df.columns, "n_dropped"}
    assert lt.dedup(empty(spark)).count() == 0


def test_a_table(spark, tiny):
    documents = table(spark, tiny, "documents")
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert got(documents) == slow(rows)
    assert got(documents.repartition(7)) == slow(rows)


def test_main_path_is_native(spark, tiny):
    plan = lt.dedup(table(spark, tiny, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert lt.dedup(table(spark, tiny, "documents")).where(F.col("n_dropped") > 0).count() > 0


def test_other_lines_of_the_leaf_do_not_decide(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(letters[n // 26**k % 26] for k in range(4))
    names = [word(n) for n in range(3000, 3020)]
    small = [(n, f"User has now {x} signed in at the front desk today") for n, x in enumerate(names)]
    prose = [(100 + n, "User has now " + " ".join(word(1000 + 7 * n + k) for k in range(7))) for n in range(1000)]
    found = got(docs(spark, small + [(d, t) for d, t in prose]))
    assert sorted(x[0] for x in found if x[3]) == list(range(1, 20))


def test_digit_fields_do_not_count_against_a_template(spark):
    rows = [(n, f"job 1{n} took 2{n} ms on host {x} with 3{n} and 4{n} errors") for n, x in enumerate("ada bea cid dov eva".split())]
    assert [x[3] for x in got(docs(spark, rows))] == [0, 1, 1, 1, 1]


def test_a_template_in_a_hot_leaf(spark):
    """A template of 100 documents is found among 100,000 other lines of its leaf."""
    spread = F.expr("concat_ws(' ', transform(sequence(1, 7), i -> translate(conv(abs(xxhash64(id, i)) % 500000, 10, 26), '0123456789', 'qrstuvwxyz')))")
    others = spark.range(1000, 101_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("User has now "), spread).alias("text"))
    name = F.expr("concat(translate(conv(id + 700, 10, 26), '0123456789', 'qrstuvwxyz'), 'x')")
    planted = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("User has now "), name, F.lit(" signed in at the desk")).alias("text"))
    found = lt.recurring_lines(others.unionByName(planted)).where("doc_id < 1000").collect()
    assert sorted(r["doc_id"] for r in found) == list(range(1, 100))


def test_long_and_short_lines_and_rows_of_numbers(spark):
    passage = " ".join(f"{w}tion" for w in "abcdefghijklmnopqrstuvwxyz") + " " + " ".join(f"un{w}" for w in "abcdefghijklmnopqrstuvwxyz")
    rows = [(k, f"{k} {k + 1} {k * 7} {k * 9} {k + 3}\nRead more\nMenu" + (f"\n{passage}" if k in (3, 6) else "")) for k in range(12)]
    found = got(docs(spark, rows))
    assert found == slow(rows)
    kept = {x[0]: x[1] for x in found}
    assert [k for k in kept if "Read more" in kept[k]] == [0] and all("Menu" in t and t[0].isdigit() for t in kept.values())
    assert [k for k in kept if passage in kept[k]] == [3]


def test_a_text_of_very_many_dropped_lines(spark):
    text = "\n".join(f"line of the log that recurs in all of them {'abcdefghij'[k % 10]}" + "\nown" * (k % 1000 == 0) for k in range(20_000))
    found = {x[0]: x for x in got(docs(spark, [(k, text) for k in range(3)]))}
    assert found[0][3] == 0 and found[1][3] == found[2][3] == 20_000 and found[2][1] == "\n".join(["own"] * 20)


def test_a_line_is_looked_through_once_a_pass(spark, monkeypatch):
    plans = {}

    def noted(df, tag):
        plans[tag] = df._jdf.queryExecution().optimizedPlan().toString()
        return written(df, tag)

    monkeypatch.setattr(lt, "written", noted)
    rows = [(k, f"this line is in every  document\tnumber {k}\n1 2 3 4 5 {k} and six\r") for k in range(5)]
    got = {r["doc_id"]: r["text"] for r in lt.dedup(docs(spark, rows)).collect()}
    assert got == {r[0]: r[1] for r in rows[:1]} | {k: f"1 2 3 4 5 {k} and six\r" for k in range(1, 5)}
    assert [plans[x].count("RLIKE") for x in ("lines", "line-words")] == [1, 1]


def test_lines_that_are_alone_are_counted_and_not_joined(spark):
    """No join of theirs may shuffle them, however small the tables are that Spark broadcasts."""
    word = lambda n: "".join("abcdefghijklmnopqrstuvwxyz"[(n * 7919 + 17) // 26**k % 26] for k in range(5))
    alone = [(n, "\n".join(" ".join(word(n * 100 + 10 * at + k) for k in range(8)) for at in range(10))) for n in range(400)]
    same = "User has now been signed out of the office"
    shared = [(1000 + n, f"{same}\nUser has now {word(n)} signed in at the desk\n{same}") for n in range(20)]
    rows = [*alone, *shared]
    store, before = spark.sparkContext._jsc.sc().statusStore(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last = max(stages(), default=-1)
        found = got(docs(spark, rows))
        shuffled = sum(n for k, n in stages().items() if k > last)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == slow(rows)
    # once by template, once by leaf; the rest is the documents' and the shared lines'
    assert 2 * 4000 <= shuffled < 3 * 4000


def test_rows_that_repeat_a_document_lose_their_lines(spark):
    rows = [(n, f"User has now {x} signed in at the desk\nnote {'abcdefg'[n]} of its own") for n, x in enumerate("ada bea cid dov eva".split())]
    rows = [*rows, rows[0], rows[3], rows[4]]
    found = got(docs(spark, rows))
    assert found == slow(rows)
    assert [x[3] for x in found] == [0, 0, 1, 1, 1, 1, 1, 1]
