import re
from collections import defaultdict

import pytest

from quillmill.llm import mixing


def water(sizes, weights, epochs, total):
    """Targets by hand: clamp what is over its limit, share the rest again."""
    clamped = {}
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(clamped.values())
        goal = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = {s: epochs * sizes[s] for s in free if goal[s] > epochs * sizes[s]}
        if not over:
            return clamped | goal
        clamped |= over


@pytest.mark.parametrize("bucket", [20_000, 5])
def test_awkward_rows(awkward, bucket, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rows = mixing.mix(awkward, mixing.cycle_weights([5, 2, 1])).collect()
    again = mixing.mix(awkward.repartition(7), mixing.cycle_weights([5, 2, 1])).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == awkward.count()
    sizes, text = defaultdict(int), {r.doc_id: r.text for r in awkward.collect()}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id] or ""))
        sizes[r.source] += r.size
    order = sorted((s for s in sizes if s is not None)) + [None]
    goal = water(sizes, {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}, 3, sum(sizes.values()))
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and 0 <= r.taken <= 3 * r.size
    for s in sizes:  # documents stay whole: one that outweighs the rest of its source leaves half its size at most
        assert abs(taken[s] - goal[s]) <= max(3, 0.02 * goal[s], max(r.size for r in rows if r.source == s) / 2 * (max(r.size for r in rows if r.source == s) > sizes[s] / 2))


def test_documents_repeat(awkward, empty):
    one = awkward.dropDuplicates(["doc_id"])
    times = {r.doc_id: r.times for r in mixing.mix(one, mixing.cycle_weights([5, 2, 1])).collect()}
    got = mixing.repeat_documents(one, mixing.cycle_weights([5, 2, 1]))
    assert got.columns == awkward.columns
    count = defaultdict(int)
    for r in got.collect():
        count[r.doc_id] += 1
    assert count == {d: n for d, n in times.items() if n}
    assert mixing.mix(empty, mixing.cycle_weights([5, 2, 1])).count() == 0


def test_clamped_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "tiny" if i < 2 else "big") for i in range(40)], "doc_id long, text string, source string")
    got = {r.source: r.target for r in mixing.mix(docs, mixing.cycle_weights([1, 50])).collect()}
    assert got == pytest.approx({"tiny": 60.0, "big": 340.0})


def test_null_and_shared_ids_are_repeated_row_by_row(spark):
    big = (1 << 60) + 1
    rows = [(None, "a b c", "x"), (None, "d e", "x"), (7, "f g h i", "x"), (7, "j", "x"), (big, "k l", "x"), (big, "k l", "x"), (1, "m n o", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share in (1.0, 0.6, 2.0):
        taken = mixing.mix(df, mixing.cycle_weights([1]), share=share).collect()
        got = mixing.repeat_documents(df, mixing.cycle_weights([1]), share=share).collect()
        assert len(taken) == len(rows) and len(got) == sum(r.times for r in taken)
        assert {r.doc_id for r in taken} == {None, 7, big, 1}
        count = lambda items: {k: items.count(k) for k in items}
        assert count([(r.doc_id, len(r.text.split())) for r in got]) == count([(r.doc_id, r.size) for r in taken for _ in range(r.times)])
