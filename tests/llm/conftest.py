import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, size string, component_id string, bucket string, _h int, extra string, ids string, score string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty, blank, very long and repeated texts, and extra columns with clashing names."""
    rng = random.Random(7)
    words = ["the", "house", "of", "river", "stone", "et", "la", "maison", "Ünder", "123", "don't", "a  b", "x\ny", "日本語", "<|endoftext|>"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, base, "en", "a"), (5, base, "fr", "b"), (6, " ".join(near), "en", None), (7, text(30_000), "fr", "b"), (8, "x" * 100_000, None, "c"), (9, "one two", "en", "c"), (10, "ONE two", "fr", "c"), (11, "... 123 !!", "en", "a")]
    rows += [(20 + i, text(rng.randint(1, 60)), rng.choice(["en", "fr"]), rng.choice(["a", "b", "c", None])) for i in range(60)]
    rows.append(rows[-1])
    return spark.createDataFrame([(*r, None, 1, "k", "s", "c", "b", 5, "e", "i", None) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
