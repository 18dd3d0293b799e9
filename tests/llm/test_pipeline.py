import hashlib
import random
from collections import Counter
from itertools import combinations

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillmill.llm import bpe, langid
from test_simhash import least_reachable, slow

WORDS = {"en": "the house of river stone with another thing upon water under light".split(), "fr": "la maison de eau pierre avec une autre chose sous rivière lumière".split()}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's result over a small table with copies, near copies, nulls, junk and a hot source."""
    rng = random.Random(3)
    text = lambda lang, n: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    rows = [(i, text(lang := rng.choice(["en", "fr"]), rng.randint(30, 120)), lang, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(160)]
    rows += [(200 + i, rows[i % 3][1], "en", "b") for i in range(9)]
    near = rows[5][1].split()
    near[3] = "changed"
    rows += [(300, " ".join(near), "en", "c"), (301, None, "en", "a"), (302, "", None, None), (303, "... 123 !!", "en", "a"), (None, text("en", 50), "en", "b"), (304, text("fr", 9000), None, "c")]
    rows.append(rows[7])
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(path / "documents.parquet"))
    docs, out = spark.read.parquet(str(path / "documents.parquet")), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(path)).persist()
        out.append(docs)
    return str(path), out


def rows_of(df):
    return Counter(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))


def test_the_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "mixing", "BPE"]


def test_language(spark, stages):
    before, after = stages[1][0], stages[1][1]
    model = langid.fit(before, ~langid.held_out(before["doc_id"]))
    said = {r.text: r for r in before.select("text").distinct().collect()}
    langs = dict(zip(said, zip(*model.predict([t or "" for t in said]))))
    gone = rows_of(before) - rows_of(after)
    assert not rows_of(after) - rows_of(before) and after.columns == before.columns
    assert {r[1] for r in gone} >= {None, "", "... 123 !!"}
    assert all(langs[r[1]][0] == "und" or langs[r[1]][1] <= 1 for r in gone) and sum(gone.values()) <= 6


def test_near_duplicates(stages):
    before, after = rows_of(stages[1][1]), rows_of(stages[1][2])
    rows = sorted(before, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    prints = {i: slow(r[1]) for i, r in enumerate(rows)}
    root = least_reachable([(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4], prints)
    assert after == Counter(rows[i] for i in {root[i] for i in prints})


def test_mixing(stages):
    before, after = rows_of(stages[1][2]), rows_of(stages[1][3])
    assert set(after) <= set(before) and all(n <= 3 for n in after.values())
    size = lambda r: len((r[1] or "").split())
    have, got = Counter(), Counter()
    for r in before:
        have[r[3]] += size(r)
    for r, n in after.items():
        got[r[3]] += n * size(r)
    goal, left, open_ = {}, float(sum(have.values())), sorted(have, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(open_)}
    while open_:  # capped water-filling
        each = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if each * weight[s] > 3 * have[s]]
        for s in full or open_:
            goal[s] = 3.0 * have[s] if full else each * weight[s]
            left -= goal[s]
        open_ = [s for s in open_ if s not in goal]
    longest = max(map(size, before))
    assert all(abs(got[s] - goal[s]) <= longest for s in have), (got, goal)


def test_tokens_and_run(spark, stages):
    path, made = stages
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    want = Counter()
    for r, n in rows_of(made[3]).items():
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += n
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, made[4].select(*columns).collect())) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, path).select(*columns).collect())) == want


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
