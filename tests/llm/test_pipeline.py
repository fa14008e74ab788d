import hashlib

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from loomgrain.llm import bpe, decontaminate, language_id
from loomgrain.llm.shared import turn, written
from loomgrain.sources.tables import table
from tests.llm.helpers import ODD, docs, empty
from tests.llm.test_line_templates import slow as slow_lines
from tests.llm.test_simhash_dedup import by_hand


def brute(spark, documents, items):
    """The rows of run(), of plain Python but for the language model, whose rejections are taken as they are."""
    accepted = language_id.accepted(documents, language_id.train(documents))
    rows = [(r["doc_id"], r["text"]) for r in accepted.collect()]
    rows = [(d, t) for d, t, _, n in slow_lines(rows) if not n or t.strip(" ")]
    rows = [r for r, (d, _, c) in zip(sorted(rows, key=lambda r: r[0]), sorted(by_hand(rows), key=lambda x: x[0])) if d == c]
    rows = [(d, t) for d, t in rows if not any(b in t for b in items)]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return sorted((d, len(own.encode(t).ids), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)


def test_as_by_hand(spark, tiny):
    items = [r["text"] for r in table(spark, tiny, "benchmark").collect()]
    got = corpus_pipeline.run(spark, tiny).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got) == brute(spark, table(spark, tiny, "documents"), items)


def test_stages_on_odd_rows(spark, tiny):
    for rows in (docs(spark, ODD, ["gone", "fp"]), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, rows, tiny), f"test-{name}")
            if name != "bpe":
                assert out.columns == corpus_pipeline.COLUMNS
                rows = out
        assert out.count() <= len(ODD)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "simhash", "decontaminate", "bpe"]


def test_a_worker_remembers_one_operator_at_a_time():
    own = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.encode("once") and own.known
    turn("bpe", bpe.load.cache_clear)
    turn("decontaminate", decontaminate._forget)
    assert bpe.load.cache_info().currsize == 0
    decontaminate._forget()
    decontaminate._templates(pa.array(["twice twice once"]))
    turn("decontaminate", decontaminate._forget)
    assert set(decontaminate._TOLD.known) == {"twice"}
    turn("simhash")
    assert not decontaminate._TOLD.known and not any(map(len, decontaminate._TOLD.columns))
