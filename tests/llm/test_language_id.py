import itertools
from zlib import crc32

import numpy as np
import pytest

from loomgrain.llm import language_id as li
from loomgrain.sources.tables import table
from tests.llm.helpers import ODD, docs, empty

TALK = {
    "en": "the weather is nice today and we shall go to the market with our friends because they want some bread and cheese",
    "de": "das wetter ist heute schön und wir werden mit unseren freunden auf den markt gehen weil sie brot und käse wollen",
    "ru": "сегодня хорошая погода и мы пойдём на рынок с друзьями потому что они хотят хлеба и сыра",
    "ja": "今日は天気がいいので友達と一緒に市場へ行きますパンとチーズがほしいからです",
}


def model(spark):
    return li.train(docs(spark, [(k, text, lang) for k, (lang, text) in enumerate([*TALK.items()] * 3)]))


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(100):
        lengths = rng.integers(0, 6, int(rng.integers(1, 6)))
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        scores = (-3 * rng.random((max(1, lengths.sum()), 3))).astype(np.float32)
        label = li.viterbi(scores, np.arange(lengths.sum()), offsets, 1.0)
        for a, b in itertools.pairwise(offsets):
            value = lambda path, s=scores[a:b]: sum(s[i, x] for i, x in enumerate(path)) - sum(x != y for x, y in itertools.pairwise(path))
            if a < b:
                assert value(label[a:b]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=b - a))), abs=1e-4)


def test_scripts_and_spans(spark):
    own = model(spark)
    assert own.languages == ("de", "en", "ja", "ru")
    mixed = TALK["en"] + " " + TALK["de"] + " " + TALK["ru"]
    got = li.spans(docs(spark, [(1, mixed), (2, None), (3, "12"), (4, TALK["ja"])]), own).collect()
    assert [(r["doc_id"], r["lang"]) for r in got] == [(1, "en"), (1, "de"), (1, "ru"), (4, "ja")]
    for r in got[:3]:
        assert abs(mixed[r["begin"] : r["end"]].count(" ") - TALK[r["lang"]].count(" ")) <= 2
    assert got[2]["begin"] >= mixed.index("сегодня") and got[2]["end"] == len(mixed)


def test_query_on_odd_rows(spark):
    rows = [*ODD, *((100 + k, text, lang) for k, (lang, text) in enumerate([*TALK.items()] * 6))]
    got = li.digest(docs(spark, rows, ["score", "lang_pred"])).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (0, 1, 2, 3))
    assert all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert all(by[100 + k]["lang_pred"] == lang for k, (lang, _) in enumerate([*TALK.items()] * 6))
    assert li.digest(empty(spark)).count() == 0
    nothing = li.predict(docs(spark, ODD), li.train(empty(spark))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_unseen_script_gets_a_learned_language(spark):
    got = li.predict(docs(spark, [(1, "γειά σου κόσμε")]), model(spark)).first()
    assert got["lang_pred"] in TALK


def test_held_out_rows_teach_nothing(spark):
    held = [k for k in range(200) if crc32(str(k).encode()) % 4 == 2]
    rows = [(k, TALK["en"], "en") for k in range(200) if k not in held][:50] + [(k, TALK["de"], "de") for k in held]
    assert {r["lang_pred"] for r in li.digest(docs(spark, rows)).collect()} == {"en"}


def test_accuracy_on_what_was_held_out(spark, tiny):
    documents = table(spark, tiny, "documents")
    got = li.digest(documents).where("held_out").join(documents, "doc_id").selectExpr("avg(cast(lang = lang_pred as int))").first()[0]
    assert got > 0.95


def test_accepted_keeps_columns(spark):
    df = docs(spark, ODD, ["lang_pred"])
    kept = li.accepted(df, model(spark))
    assert kept.columns == df.columns and kept.where("doc_id in (0, 1, 2, 3)").count() == 0 and kept.where("doc_id = 4").count() == 2
