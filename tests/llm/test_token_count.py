import random

import pytest
from tokenizers import Tokenizer

from quillmill.llm import bpe, token_count

PATH = bpe.default_vocabulary()
LIB = Tokenizer.from_file(PATH)


def n(text):
    return len(LIB.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(6))
def test_spliced_chunks_equal_the_whole(seed):
    rng = random.Random(seed)
    c = token_count.TokenCounter(PATH, chunk=60, overlap=12)
    parts = ["the ", "house", "\n", "  ", "'s", "été ", "<|endoftext|>", "日本", "12 ", "x" * 40, " " * 30, "!?", "\t"]
    for _ in range(40):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 120)))
        assert c.huge(text) == n(text)
    assert c.widened > 0


def test_one_huge_piece():
    c = token_count.TokenCounter(PATH, chunk=500, overlap=20)
    text = "a b " + "x" * 3000 + " c d" * 400
    assert c.huge(text) == n(text) and c.widened > 1


def test_documents(awkward, empty):
    rows = token_count.count_tokens(awkward, PATH).collect()
    got = sorted(tuple(r)[:4] for r in rows)
    assert {r.doc_id for r in rows if r.chunks > 1} == {7}  # the long one is spliced; a single long word has no boundary
    want = sorted((r.doc_id, len((r.text or "").encode()), n(r.text or ""), n(r.text or "") > 512) for r in awkward.collect())
    assert got == want
    assert token_count.count_tokens(empty, PATH).count() == 0
