import re

import public_tokenizers
import pytest
from fixtures_llm import FOLDER, awkward, empty, given, have_given
from test_minhash import brute
from test_packing import expected
from test_rules import base_of
from test_secrets import spans_of
from tokenizers import Tokenizer

import corpus_pipeline
from terrastat.llm.rules import quality_rules
from terrastat.llm.secrets import RULES

pytestmark = pytest.mark.skipif(not have_given(), reason="no tables")
STAGE = dict(corpus_pipeline.STAGES)


def redact(text):
    out, at = "", 0
    extra = [(m.start(), k, m.end(), r.kind) for k, r in enumerate(RULES) if not r.base for m in re.finditer(r.pattern, text)]
    for a, _, b, _ in sorted(spans_of(text) + extra):
        out += (text[at:a] + "[SECRET]") if a >= at else ""
        at = max(at, b)
    return out + text[at:]


def test_every_stage_against_plain_loops(spark):
    docs = given(spark)
    items = [r.text for r in given(spark, "benchmark").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    verdict = {r.doc_id: r for r in quality_rules(docs, given(spark, "labels")).collect()}
    kept = STAGE["quality_rules"](spark, docs, FOLDER)
    assert kept.columns == docs.columns
    left = {r.doc_id: r for r in kept.collect()}
    assert set(left) == {d for d in rows if not base_of(rows[d].text)[-1] and not verdict[d].rejected_by} and all(left[d] == rows[d] for d in left)
    once = STAGE["near_duplicates"](spark, kept, FOLDER)
    want = {d for d, _, _, k in brute([(d, r.text) for d, r in left.items()], 5) if k}
    assert {r.doc_id for r in once.collect()} == want and once.columns == docs.columns
    clean = STAGE["benchmark_decontamination"](spark, once, FOLDER)
    want = {d for d in want if not any(x in rows[d].text for x in items)}
    assert {r.doc_id for r in clean.collect()} == want and clean.columns == docs.columns
    safe = STAGE["secret_scans"](spark, clean, FOLDER)
    assert safe.columns == docs.columns and [f.dataType for f in safe.schema] == [f.dataType for f in docs.schema]
    texts = {d: redact(rows[d].text) for d in want}
    got = {r.doc_id: r for r in safe.collect()}
    assert {d: r.text for d, r in got.items()} == texts and all(r.n_chars == len(r.text) for r in got.values())
    packed = STAGE["packing"](spark, safe, FOLDER).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed], key=repr) == expected(list(texts.items()), tokenizer)
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.ids_crc32) for r in packed)


@pytest.mark.parametrize("make", [awkward, empty])
def test_stages_take_awkward_and_empty_tables(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER)
        if name != "packing":
            assert after.columns == docs.columns
        assert after.count() <= docs.count() or name == "packing"
