import hashlib
import re

import pytest
from fixtures_llm import awkward, empty, given, have_given

from terrastat.llm.secrets import RULES, redacted, secret_report, trigram_query


def spans_of(text):
    """Leftmost, non-overlapping matches by the contract's own expressions, then the least lengths."""
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return out


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


@pytest.mark.parametrize("table", ["awkward", "given"])
def test_spans_equal_plain_search(spark, table):
    if table == "given" and not have_given():
        pytest.skip("no tables")
    docs = awkward(spark) if table == "awkward" else given(spark)
    got = sorted(map(tuple, secret_report(docs).collect()), key=repr)
    want = []
    for r in docs.select("doc_id", "text").collect():
        base = spans_of(r.text or "")
        extra = [(m.start(), k, m.end(), rule.kind) for k, rule in enumerate(RULES) if not rule.base for m in re.finditer(rule.pattern, r.text or "")]
        n = [sum(s[3] == k for s in base) for k in ("assign", "access", "hex")]
        want.append((r.doc_id, *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + extra)))
    assert got == sorted(want, key=repr)
    if table == "awkward":
        assert sum(w[1] for w in want) >= 4 and sum(w[2] for w in want) == 2 and sum(w[3] for w in want) >= 1


def test_queries_are_necessary_and_hex_has_none():
    by_kind = {r.kind: trigram_query(r.pattern) for r in RULES}
    assert by_kind["hex"] is None
    assert {"pas", "ass", "ssw", "swo", "wor", "ord"} in by_kind["assign"] and len(by_kind["assign"]) == 6
    assert by_kind["access"] == [frozenset({"aki", "kia"})]
    assert trigram_query("ab+c") is None and trigram_query("(abcd|x)") is None
    assert trigram_query("abc+d") == [frozenset({"abc"})]


def test_redaction_keeps_the_rest(spark):
    docs = awkward(spark)
    got = {r.doc_id: r for r in redacted(docs).where("doc_id is not null").collect()}
    for r in docs.where("doc_id is not null").collect():
        text, out, at = r.text, "", 0
        if text is not None:
            spans = sorted(spans_of(text) + [(m.start(), k, m.end(), rule.kind) for k, rule in enumerate(RULES) if not rule.base for m in re.finditer(rule.pattern, text)])
            for a, _, b, _ in spans:
                out += (text[at:a] + "[SECRET]") if a >= at else ""
                at = max(at, b)
            text = out + text[at:]
        assert got[r.doc_id].text == text
    assert redacted(docs).columns == docs.columns


def test_empty_table(spark):
    assert secret_report(empty(spark)).count() == 0
