import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmill.llm import bpe

LIB = Tokenizer.from_file(bpe.default_vocabulary())
CODEC = bpe.codec(bpe.default_vocabulary())


@pytest.mark.parametrize("text", ["", "a", "  a", "a  b", "a \nb", "a\n \nb", "x\n y", "x \n", "x  ", " x", "x\x1cy \x1c z", "a\x85b \x85", "a b　 c 　", "<|endoftext|>a <|endoftext|> b<|endoftext|>", "it's we'll 'tis", "１２ ³½ 中文", "á", "ab" * 5000, "\t\t x\t y", "a\xa0b \xa0 c", " " * 50, "\x00 \x01"])
def test_equals_library(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    assert CODEC.encode([text])[0].tolist() == ids
    assert CODEC.decode(ids) == LIB.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aeth  \n\t'sXÉ9.-日<|")), max_size=40), max_size=5))
def test_any_text_equals_library(texts):
    assert [x.tolist() for x in CODEC.encode(texts)] == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


def test_documents(awkward, empty):
    got = sorted(bpe.round_trip(awkward, bpe.default_vocabulary()).collect())
    want = []
    for r in awkward.select("doc_id", "text").collect():
        ids = LIB.encode(r.text or "", add_special_tokens=False).ids
        back = LIB.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want)
    coded = bpe.encode_documents(awkward, bpe.default_vocabulary())
    back = bpe.decode_documents(coded, bpe.default_vocabulary())
    assert sorted(map(tuple, back.collect())) == sorted((r.doc_id, r.text or "") for r in awkward.collect())
    assert bpe.round_trip(empty, bpe.default_vocabulary()).count() == 0


def test_words_table_is_bounded():
    c = bpe.Codec(bpe.default_vocabulary(), words=50)
    for i in range(20):
        c.encode([" ".join(f"word{i}x{j}" for j in range(40))])
    assert len(c.units) <= 50 + 40 and len(c.pieces) <= 50 + 200
