import random

import pytest
from tokenizers import Tokenizer

from quillmill.llm import bpe
from quillmill.llm.token_ids import Encoder

PATH = bpe.default_vocabulary()
LIB = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("seed", range(4))
def test_ids_equal_the_library(seed):
    """Also while stretches are forgotten, in any order of texts."""
    rng = random.Random(seed)
    parts = ["the", "house", "a\nb", "\n", "été", "日本", "<|endoftext|>", "x" * 70, "\t", "12", "'s", "", "Ġ", " "]
    e = Encoder(PATH, words=6)
    for _ in range(30):
        texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 20))]
        assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in LIB.encode_batch(texts, add_special_tokens=False)]


def test_nothing_to_encode():
    assert Encoder(PATH).encode([]) == []
    assert [len(x) for x in Encoder(PATH).encode(["", ""])] == [0, 0]


def test_stretches_met_again_are_kept():
    e = Encoder(PATH, words=100)
    often = " ".join(f"w{i}" for i in range(31))
    for k in range(3):
        e.encode([(often if k < 2 else "") + " " + " ".join(f"n{k}x{i}" for i in range(40))])  # memory is full after the second one
    assert "w30" in e.known and "n0x0" not in e.known and "n2x0" in e.known
    got = e.encode([often + " n0x0 n1x1 n2x2"])[0].tolist()
    assert got == LIB.encode(often + " n0x0 n1x1 n2x2", add_special_tokens=False).ids
