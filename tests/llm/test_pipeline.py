import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline

from .test_simhash import plain_groups
from .test_spans import plain_base

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, documents, data):
    """The table before and after each stage, each written and read again."""
    from sylvastack.llm.workspace import materialize

    tables = [documents.select(*COLUMNS)]
    for _, f in pipeline.STAGES:
        tables.append(materialize(f(spark, tables[-1], data)))
    return tables


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "packing"]
    assert all(t.columns == COLUMNS and t.dtypes == stages[0].dtypes for t in stages[1:-1])


def test_language_stage_keeps_documents_with_a_language(spark, stages, data, odd):
    before, after = rows(stages[0]), rows(stages[1])
    assert len(after) >= 0.98 * len(before)
    assert all(after[i].text == before[i].text and after[i].lang in ("en", "de", "fr", "es") for i in after)
    assert np.mean([after[i].lang == before[i].lang for i in after]) >= 0.97
    some = odd.select(*COLUMNS).where("doc_id in (1, 2, 3, 8)")
    assert pipeline.keep_languages(spark, some, data).collect() == []


def test_near_duplicate_stage_equals_brute_force(stages):
    want = plain_groups([(i, r.text) for i, r in rows(stages[1]).items()])
    assert set(rows(stages[2])) == {i for i, root in want.items() if i == root}


def test_near_duplicate_stage_loses_no_text_of_a_repeated_id(spark, data):
    b = "a text of its own that is not like any other one in this little table of rows"
    c = "yet another text with quite different words so that nothing here can be taken for it"
    rows = [(2, "some words that stand here alone"), (5, "some words that stand here alone"), (5, b), (7, b + " x"), (8, c), (8, c), (None, c), (None, "left without an id"), (None, "left without an id"), (None, "and one more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id or 0, r.text) for r in pipeline.drop_near_duplicates(spark, docs, data).collect())
    assert kept == [(0, "and one more"), (0, "left without an id"), (2, rows[0][1]), (5, b), (8, c)]


def test_personal_data_stage_leaves_no_base_span(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert set(before) == set(after)
    found = 0
    for i, r in after.items():
        base = plain_base(before[i].text)
        found += bool(base)
        assert not plain_base(r.text) and r.n_chars == len(r.text)
        if not base and r.text != before[i].text:
            assert "<" in r.text
    assert found and np.mean([after[i].text == before[i].text for i in after if not plain_base(before[i].text)]) >= 0.99


def test_mixing_stage_keeps_every_document(stages):
    before, after = rows(stages[3]), stages[4].collect()
    assert {r.doc_id for r in after} == set(before) and all(r == before[r.doc_id] for r in after)


def test_packing_stage_holds_all_tokens(stages):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mixed = stages[4].collect()
    ids = {r.doc_id: np.array(coder.encode(r.text, add_special_tokens=False).ids + [0], "<u4") for r in mixed}
    pieces = stages[5].collect()
    assert sum(p.length for p in pieces) == sum(len(ids[r.doc_id]) for r in mixed)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    assert len({(p.row, p.start) for p in pieces}) == len(pieces) and len({p.row for p in pieces}) == len(mixed)


def test_the_pipeline_runs_from_a_folder(spark, data):
    assert pipeline.run(spark, data).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", "sequence_id", "offset"]


def test_odd_documents_pass_all_stages(spark, odd, data):
    docs = odd.select(*COLUMNS)
    for _, f in pipeline.STAGES:
        docs = f(spark, docs, data)
    assert {r.doc_id for r in docs.collect()} <= {4, 5, 6, 7, 9, None}
    empty = odd.select(*COLUMNS).where("false")
    for _, f in pipeline.STAGES:
        empty = f(spark, empty, data)
    assert empty.collect() == []
