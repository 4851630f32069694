import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures_llm import awkward, empty, given, have_given
from tokenizers import Tokenizer

from terrastat.llm.packing import binary_pieces, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, tokenizer):
    out = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for n in binary_pieces(len(ids)):
            out.append((doc_id, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
            at += n
        assert at == len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize("table", ["awkward", "given"])
def test_pieces_equal_plain_tokenizing(spark, table):
    if table == "given" and not have_given():
        pytest.skip("no tables")
    docs = awkward(spark) if table == "awkward" else given(spark)
    rows = pack(docs, PATH).collect()
    want = expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], Tokenizer.from_file(PATH))
    assert sorted([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows], key=repr) == want
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        assert r.length == 1 << r.bucket <= 4096 and r.offset == 0
        assert zlib.crc32(np.array(r.tokens, "<u4").tobytes()) == r.ids_crc32


def test_empty_table(spark):
    assert pack(empty(spark), PATH).count() == 0


def test_binary_pieces():
    for n in (1, 2, 3, 4095, 4096, 4097, 20000):
        got = binary_pieces(n)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 4096 for x in got) and got == sorted(got, reverse=True)
