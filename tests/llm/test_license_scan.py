import random

import pytest

from loomgrain.llm import license_scan as ls
from tests.llm.helpers import ODD, docs, empty

WORDS = [f"w{k}" for k in range(4000)]


def brute(text, templates):
    """(license) of every template of whose shingles some stretch of up to twice its length has enough."""
    strip = lambda x: ls._EDGES.sub("", x).lower()
    words = [w for w in map(strip, text.split()) if w]
    out = set()
    for name, template in templates:
        t = [w for w in map(strip, template.split()) if w]
        need = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        own = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        if need and any(len(need & set(own[i : i + max(1, len(t) - 4)])) >= 0.8 * len(need) for i in range(len(own))):
            out.add(name)
    return out


def test_bands_are_sure_enough():
    assert all(ls.collision(ls.least_similarity(n)) >= ls.COLLISION for n in range(1, 2000))


def test_planted_templates(spark):
    rnd = random.Random(3)
    templates = [(f"t{n}", " ".join(rnd.sample(WORDS, n))) for n in (5, 6, 9, 12, 20, 33, 70, 150)]
    rows = []
    for k in range(150):
        text = rnd.choices(WORDS, k=rnd.randrange(0, 100))
        for _, t in rnd.sample(templates, rnd.randrange(0, 3)):
            t = t.split()
            if len(t) > 30 and rnd.random() < 0.5:
                t[len(t) // 2] = "other"
            text += [w.upper() + "," if rnd.random() < 0.1 else w for w in t] + rnd.choices(WORDS, k=rnd.randrange(0, 100))
        rows.append((k, "  ".join(text)))
    got = {}
    for r in ls.scan(docs(spark, rows), templates).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert {k: found for k, t in rows if (found := brute(t, templates))} == got


def test_query_on_odd_rows(spark):
    rows = [*ODD, (20, "Released under the MIT License."), (20, "Released under the MIT License."), (21, "so\nThis work is LICENSED under the GNU General Public License, version 3."), (22, "MIT License")]
    got = sorted((r["doc_id"], r["license"], r["begin"], r["end"]) for r in ls.scan(docs(spark, rows, ["license", "begin"])).collect())
    assert got == [(20, "MIT", 0, 5), (20, "MIT", 0, 5), (21, "GPL-3.0", 1, 13)]
    assert ls.scan(empty(spark)).count() == 0 and ls.scan(docs(spark, rows), []).count() == 0


def test_overlaps_are_settled_among_all_templates(spark):
    """Of a template and one that holds it and more, the better match stays, whatever stands between them in the list."""
    body = " ".join(WORDS[:40])
    other = " ".join(WORDS[100:110])
    fillers = [(f"f{k}", " ".join(random.Random(k).sample(WORDS[200:], 12))) for k in range(300)]
    first, second = ("whole", body), ("part", " ".join([*WORDS[:33], *WORDS[150:157]]))
    for templates in ([first, second, *fillers], [first, *fillers, second], [second, *fillers, first]):
        rows = ls.scan(docs(spark, [(1, f"{other} {body} {other}")]), templates).collect()
        assert [(r["license"], r["containment"]) for r in rows] == [("whole", 1.0)]


def test_too_many_templates_are_refused(spark, monkeypatch):
    monkeypatch.setattr(ls, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="templates"):
        ls.scan(docs(spark, [(1, "a")]))


def test_full_texts_and_headers_by_the_query(spark, tmp_path):
    from loomgrain.llm import queries

    texts = [(f.name.removesuffix(".txt").removesuffix(".header"), f.read_text()) for f in sorted(ls.FOLDER.glob("*.txt"))]
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0"} <= {n for n, _ in texts}
    rnd = random.Random(5)
    rows = []
    for k, (_, text) in enumerate(texts):
        for j, talk in enumerate((0, 30, 700)):
            around = lambda: " ".join(rnd.choices(WORDS, k=talk))
            rows.append((10 * k + j, f"{around()}\n{text}\n{around()}"))
    rows.append((-1, " ".join(rnd.choices(WORDS, k=3000))))
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in queries.op5_license_scan(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got == {k: {texts[k // 10][0]} for k, _ in rows if k >= 0}
