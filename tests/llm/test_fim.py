import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillmill.llm import fim


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id, text):
    """The contract by plain slices."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
        return (len(t), "plain", None, None, t)
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    pre, mid, suf = t[:a], t[a:b], t[b:]
    return (len(t), "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 20 else (len(t), "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


def test_rows_equal_plain_slices(spark, awkward):
    rng = random.Random(3)
    odd = [(1000 + i, "".join(rng.choice("<PSM>aé😀́ \n") for _ in range(rng.choice([1, 2, 3, 8, 40])))) for i in range(300)]
    odd += [(2000, "a<S>b"), (2001, "<P"), (None, "no id"), (2002, "x" * (3 * fim.STEP + 5))]
    df = awkward.select("doc_id", "text", "ids").unionByName(spark.createDataFrame([(*r, None) for r in odd], "doc_id long, text string, ids string"))
    made = fim.fill_in_middle(df)
    want = sorted(((r.doc_id or -1, *plainly(r.doc_id, r.text)) for r in df.collect()), key=str)
    got = made.collect()
    assert sorted(((r.doc_id or -1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == want
    assert all(r.output_sha256 == sha(r.output) for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    back = fim.restore(made, keep=("doc_id",)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((r.doc_id or -1, r.text or "") for r in df.collect())
    assert all(r.restored_sha256 == sha(r.text) for r in back)


def test_descriptors_tell_the_output(spark):
    text = "abcdefghij" * 5
    rows = fim.fill_in_middle(spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string"), share=100).collect()
    buffers = (text, *fim.SENTINELS)
    for r in rows:
        assert "".join(buffers[p.buffer][p.start : p.start + p.length] for p in r.pieces) == r.output
        assert len(r.pieces) == 6 and sum(p.length for p in r.pieces if p.buffer == 0) == r.n


def test_cuts_share_buffers():
    t = fim.PieceTable.whole("hello world")
    assert t.cut(5) == 1 and t.cut(11) == 2 and t.pieces == [(0, 0, 5), (0, 5, 6), (0, 11, 0)]
    assert t.arrange((2, 0, 1)).text() == "<S><P>hello<M> world"
    assert t.permute((2, 0, 1)).permute(fim.inverse((2, 0, 1))).pieces == t.pieces
    with pytest.raises(IndexError):
        t.cut(12)


def test_empty_tables_and_bad_sentinels(spark, empty):
    assert fim.fill_in_middle(empty).count() == 0 and fim.restore(fim.fill_in_middle(empty)).count() == 0
    for bad in (("<A>", "<A>", "<B>"), ("ab", "bc", "cd"), ("", "<A>", "<B>"), ("<A>", "x<A>", "<B>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(empty, sentinels=bad)


def test_long_text_among_other_columns(spark):
    df = spark.createDataFrame([(7, "é" * 400_000, "k", 1)], "doc_id long, text string, key string, form int").withColumn("n", F.lit(0))
    r = fim.fill_in_middle(df, share=100).first()
    assert r.n == 400_000 and len(r.output) == r.n + 9
