import random
import re
from itertools import combinations

import xxhash

from quillmill.llm import components, simhash


def slow(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_awkward_rows_equal_brute_force(awkward):
    docs = {r.doc_id: slow(r.text) for r in awkward.select("doc_id", "text").collect()}
    want = least_reachable([(a, b) for a, b in combinations(docs, 2) if (docs[a] ^ docs[b]).bit_count() <= 4], docs)
    got = simhash.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{f:016x}", want[d]) for d, f in docs.items()}
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d in docs if want[d] == d)


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).columns == empty.columns


def test_every_link_meets_at_an_anchor(spark, monkeypatch):
    rng = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(5):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}  # fuller anchors than a chunk holds
    monkeypatch.setattr(simhash, "CHUNK", 16)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = components.connected_components(simhash.links(df)).collect()
    want = least_reachable([(signed(a), signed(b)) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4], [signed(x) for x in fps])
    got = {r.node: r.root for r in roots}
    assert {n: got.get(n, n) for n in want} == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_null_and_shared_ids_stay(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    big = (1 << 60) + 1
    rows = [(None, text(1), "a"), (None, text(2), "b"), (None, text(2), "b"), (7, text(3), "a"), (7, text(4), "a"), (None, text(3), "a"), (big, text(5), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = {(None, text(1), "a"), (None, text(2), "b"), (7, text(3), "a"), (7, text(4), "a"), (big, text(5), None)}
    got = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert len(got) == len(want) and set(got) == want


def test_exploded_anchors_are_never_broadcast(spark, tmp_path):
    """Spark takes the anchors, and the salted minima of components, for as small as what they were made of."""
    spark.createDataFrame([(k * 977,) for k in range(300)], "fp long").write.parquet(str(tmp_path / "fp"))
    plan = simhash.links(spark.read.parquet(str(tmp_path / "fp")))._jdf.queryExecution().toString()
    salted = components._lower_all(spark.read.parquet(str(tmp_path / "fp")).selectExpr("fp as u", "fp + 1 as v"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "SortMergeJoin" in salted and "Broadcast" not in plan + salted
