import random
from collections import Counter, defaultdict

import numpy as np

from loomgrain.llm import decontaminate as dc
from loomgrain.sources.tables import table
from tests.llm.helpers import LONG, ODD, docs, empty

ITEMS = [
    (1, "A train leaves Boston with 40 passengers and travels 120 km in 3 hours. How fast does the train go if 40 passengers stay on board?"),
    (2, "Someone buys 12 apples for 5 dollars and gives 12 apples to the neighbours before noon on that day."),
    (3, "too short"),
    (4, None),
    (5, "Is it true that water boils at lower heat on high mountains than by the sea shore"),
]


def bench(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 as doc_id", "1 as kind")


def found(spark, rows, items=ITEMS):
    return sorted((r["doc_id"], r["item_id"], r["kind"]) for r in dc.leaks(docs(spark, rows, ["kind", "item_id"]), bench(spark, items)).collect())


def test_copies_and_new_parameters(spark):
    talk = "some words before it, and then "
    other = ITEMS[0][1].replace("Boston", "Denver").replace("40", "55").replace("120", "300").replace("3 hours", "5 hours")
    mixed = ITEMS[0][1].replace("40 passengers and", "55 passengers and").replace("Boston", "Denver")
    rows = [
        (1, talk + ITEMS[0][1] + " and after"),
        (2, talk + other),
        (3, talk + ITEMS[1][1].upper()),
        (4, ITEMS[4][1].replace(" ", "\n ") + "?"),
        (5, ITEMS[0][1][:60]),
        (6, mixed),
    ]
    got = found(spark, rows)
    assert (1, 1, "exact") in got and (2, 1, "reparameterised") in got and (4, 5, "exact") in got
    assert not any(x[0] == 5 for x in got)
    # 40 stands once for 55 and once for itself: most slots agree, but the item is told from a copy
    assert (6, 1, "exact") not in got


def test_inconsistent_slots_are_no_leak(spark):
    item = [(9, "add 7 to 7 then take 7 from 7 and put 7 on 7 so that 7 is with 7 at once")]
    rows = [(1, item[0][1].replace("7", "4")), (2, "add 1 to 2 then take 3 from 4 and put 5 on 6 so that 8 is with 9 at once")]
    # six of ten words of a window are literals, so the windows match in both
    assert found(spark, rows, item) == [(1, 9, "reparameterised")]


def test_odd_rows(spark):
    rows = [*ODD, (20, ITEMS[4][1]), (20, ITEMS[4][1]), (21, LONG + ITEMS[4][1])]
    assert found(spark, rows) == [(20, 5, "exact"), (20, 5, "exact"), (21, 5, "exact")]
    assert found(spark, rows, []) == []
    assert dc.leaks(empty(spark), bench(spark)).count() == 0
    df = docs(spark, rows, ["kind"])
    kept = dc.clean(df, bench(spark))
    assert kept.columns == df.columns and kept.count() == len(ODD)


def kinds_of(text):
    """(template word, bare word) of each word: straight from the rules, without arrays."""
    out, begin = [], True
    for w in text.split():
        bare = dc._EDGES.sub("", w)
        if not bare:
            continue
        if dc._NUMBER.fullmatch(bare):
            t = "<num>"
        elif bare.lower() in dc.UNITS:
            t = "<unit>"
        elif bare[0].isupper() and not begin:
            t = "<name>"
        else:
            t = bare.lower()
        out.append((t, bare.lower(), bare.casefold()))
        begin = w.rstrip("\"')]»”").endswith((".", "!", "?", ":"))
    return out


def brute(rows, items):
    """(doc_id, item_id, kind) by comparing every window of every text with every window of every item."""
    got = set()
    slot = lambda t: t.startswith("<")
    for doc, text, *_ in rows:
        d = kinds_of(text or "")
        for name, item in items:
            i = kinds_of(item or "")
            if not i:
                continue
            reach = 2 * max(5, len(i))
            wide = min(5, len(i))

            def windows(of, template, first_is_name=False):
                of = [("<name>", *of[0][1:]), *of[1:]] if first_is_name else of
                made = [tuple(x[0 if template else 2] for x in of[k : k + (5 if template else wide)]) for k in range(len(of) - (5 if template else wide) + 1)]
                return {k: w for k, w in enumerate(made) if not template or sum(not slot(x) for x in w) >= 3}

            for template in (True, False):
                mine = {(k, w) for k, w in windows(i, template).items()}
                if template and len(i) >= 5 and not slot(i[0][0]) and item.split()[0][:1].isupper():
                    mine |= {(k, w) for k, w in windows(i, True, True).items() if k == 0}
                need = len({k for k, _ in mine})
                hits = [(p, k) for p, w in windows(d, template).items() for k, v in mine if v == w]
                for begin, _ in hits:
                    near = [(p, k) for p, k in hits if begin <= p < begin + reach]
                    if need and len({k for _, k in near}) >= 0.8 * need:
                        if not template:
                            if not any(x[:2] == (doc, name) for x in got):
                                got.add((doc, name, "exact"))
                            continue
                        shift = Counter(p - k for p, k in near)
                        at = {}
                        for p, k in sorted(near, key=lambda x: (x[1], -shift[x[0] - x[1]], x[0])):
                            at.setdefault(k, p)
                        pairs = {(k + j, p + j) for k, p in sorted(at.items(), reverse=True) for j in range(5) if slot(i[k + j][0])}
                        pairs = {a: b for a, b in sorted(pairs, key=lambda x: (x[0], -x[1]))}
                        told = defaultdict(Counter)
                        for a, b in pairs.items():
                            told[i[a][1]][d[b][1]] += 1
                        total = sum(map(Counter.total, told.values()))
                        if sum(max(c.values()) for c in told.values()) >= 0.8 * total:
                            same = all(max(c, key=lambda x: (c[x], x)) == v for v, c in told.items())
                            got.add((doc, name, "exact" if same else "reparameterised"))
    return got


def test_against_brute_force(spark):
    rnd = random.Random(8)
    words = "the of river goes under old stone bridge where many people walk each day with small boats and nets by night".split()
    fill = lambda: rnd.choice([rnd.choice(words), str(rnd.randrange(9)), rnd.choice(["Ada", "Bea", "Cid"]), rnd.choice(["km", "kg"])])
    items = [(k, " ".join(["Stem", *words[:6], *(fill() if rnd.random() < 0.4 else rnd.choice(words) for _ in range(rnd.randrange(2, 25)))])) for k in range(25)] + [(30, "Ada has 3 km"), (31, "boats")]
    rows = []
    for k in range(120):
        text = [rnd.choice(words[:-3]) for _ in range(rnd.randrange(0, 30))]
        if k % 3:
            own = rnd.choice(items)[1].split()
            swap = {w: fill() for w in set(own) if w.isdigit() or w in ("Ada", "Bea", "Cid")}
            own = [swap.get(w, w) if k % 2 else w for w in own]
            own = [fill() if rnd.random() < 0.04 else w for w in own]
            text += own[: len(own) // 2] + [rnd.choice(words) for _ in range(rnd.choice([0, 0, 0, 60]))] + own[len(own) // 2 :]
        rows.append((k, " ".join(text)))
    got = found(spark, rows, items)
    want = brute(rows, items)
    assert {x[:2] for x in got} == {x[:2] for x in want} and len(got) > 50
    # a pair may have stretches of both kinds
    assert set(got) <= want | {(*x[:2], "exact") for x in want}


def test_a_stem_that_all_items_share(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEMS_AT_ONCE", 7)
    stem = "which of the following answers about the old stone bridge is the right one to give here"
    rnd = random.Random(2)
    items = [(k, f"{stem} {' '.join(f'w{rnd.randrange(10**6)}x' for _ in range(25))}") for k in range(200)]
    _, windows = dc.item_windows(bench(spark, items))
    rare = dc._rarest(windows)
    assert rare.groupBy("hash").count().where("count > 1").count() == 0
    rows = [(k, f"before {items[k][1]} after") for k in range(40)] + [(1000 + k, stem) for k in range(300)]
    rows.append((2000, " and ".join(t for _, t in items)))
    assert found(spark, rows, items) == [(k, k, "exact") for k in range(40)] + [(2000, k, "exact") for k in range(200)]


def test_scattered_windows_are_no_leak(spark):
    words = ITEMS[4][1].split()
    far = (" " + " ".join(f"z{k}z" for k in range(100)) + " ").join(" ".join(words[k : k + 6]) for k in range(len(words) - 5))
    assert found(spark, [(1, far), (2, ITEMS[4][1])]) == [(2, 5, "exact")]


def test_planted_passages_of_a_table(spark, tiny):
    documents, items = table(spark, tiny, "documents"), table(spark, tiny, "benchmark")
    want = {(d["doc_id"], b["item_id"]) for d in documents.collect() for b in items.collect() if b["text"] in d["text"]}
    assert want == {(r["doc_id"], r["item_id"]) for r in dc.leaks(documents, items).collect()}


def test_literal_copies_without_template_windows(spark):
    items = [(1, "What is 12 + 7 * 3 - 4 * 9 + 15 / 5 ?"), (2, "Solve 3x + 5 = 20"), (3, ITEMS[1][1]), (4, "Die Katze von Anna Maria Schmidt sitzt auf der Straße vor dem Haus"), (5, ""), (6, "12 13 14 15 16")]
    rows = [(10 + k, f"some talk first {t} and talk behind") for k, t in items if t]
    rows += [(23, ITEMS[1][1].upper()), (24, items[3][1].lower()), (34, items[3][1].upper()), (40, "What is 12 + 8 * 2 ?"), (41, "Solve 3x + 6 = 20"), (42, "")]
    want = [(11, 1), (12, 2), (13, 3), (14, 4), (16, 6), (23, 3), (24, 4), (34, 4)]
    assert [x[:2] for x in found(spark, rows, items)] == want
    assert sorted(r["doc_id"] for r in dc.clean(docs(spark, rows), bench(spark, items)).collect()) == [40, 41, 42]
    # an item does not begin in one document and end in the next
    assert found(spark, [(1, "Solve 3x +"), (2, "5 = 20")], items) == []


def test_words_that_stand_once_are_not_remembered(monkeypatch):
    once = [f"{chr(97 + k % 26)}once{k}" for k in range(500)]
    words = ["Boston", "40", *once, "hours."]
    times = np.array([3, 2, *[1] * len(once), 5])
    told = dc._Told()
    first = told.of(words, times)
    assert set(told.known) == {"Boston", "40", "hours."} and all(len(c) == 3 for c in told.columns)
    backward = told.of(words[::-1], times[::-1])
    assert all((a == b[::-1]).all() for a, b in zip(first, backward, strict=True))
    want = [(*dc._read(w, dc._bare(w)), dc.xxhash.xxh64_intdigest(dc._bare(w).casefold(), 2), bool(dc._bare(w))) for w in words]
    assert [tuple(map(int, row)) for row in zip(*first, strict=True)] == [tuple(map(int, row)) for row in want]
    monkeypatch.setattr(dc, "REMEMBERED", 2)
    again = told.of(words[:2], times[:2])
    assert set(told.known) == {"Boston", "40"} and all((a == b[:2]).all() for a, b in zip(again, first, strict=True))
