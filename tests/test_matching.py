import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import linguistic, matching, validation


def test_slots_equal_the_loop(spark):
    """The loop over the whole pool, without pruning."""
    rng = random.Random(1)
    quotas = {"x": 1, "y": 2}
    pool = [(g, f"{g}{i:03}", rng.randint(50, 90), rng.choice([0.0, 0.1, 0.2]), rng.random() < 0.5, rng.choice(["x", "y", "z", "q", None])) for g in "ab" for i in range(60)] + [("c", "c1", 5, 0.0, True, None)]
    targets = [(g, i, t) for g in "abc" for i, t in enumerate([55, 60, 60, 80])]
    p = spark.createDataFrame(pool, "g string, id string, n int, cost double, pref boolean, grade string")
    got = matching.select_slots(p, spark.createDataFrame(targets, "g string, i int, target long"), "g", "id", "n", F.col("cost"), F.col("pref"), F.col("grade"), quotas, 4, salts=3)
    want = set()
    for g in "abc":
        left, taken, out = [r for r in pool if r[0] == g], {}, 0
        for _, i, t in [r for r in targets if r[0] == g]:
            if not left:
                break
            rich = [r for r in left if r[4]]

            def total(r):
                have = taken.get(r[5], 0)
                extra = 0.16 + max(0, have - 9) * 2 if r[5] is None else 0.12 if r[5] not in quotas else 0.28 + (have - quotas[r[5]]) * 0.08 if have >= quotas[r[5]] else 0.0
                return (r[3] + abs(r[2] - t) / max(t, 1) + extra, r[1])

            best = min(rich if len(rich) >= 4 - out else left, key=total)
            left.remove(best)
            taken[best[5]], out = taken.get(best[5], 0) + 1, out + 1
            want.add((g, i, t, best[1]))
    assert set(map(tuple, got.collect())) == want


def test_matching_without_replacement(spark):
    rng = np.random.default_rng(0)
    assert matching.match_lengths({10: 1, 20: 1}, [11, 11, 11], rng) == {10: 1, 20: 1}
    assert matching.match_lengths({10: 5, 30: 5}, [12, 29], rng) == {10: 1, 30: 1}
    ties = [next(iter(matching.match_lengths({10: 3, 20: 1}, [15], rng))) for _ in range(400)]
    assert 0.65 < ties.count(10) / 400 < 0.85


def test_length_matched(spark):
    pool = [("g", i, n, float(i)) for i, n in enumerate([10, 10, 10, 20, 20, 90])] + [("g", 99, None, 1.0), (None, 98, 10, 1.0)]
    wanted = [("g", i, n, 10.0) for i, n in enumerate([10, 10, 20])]
    schema = "g string, id long, n long, x double"
    r = matching.length_matched(spark.createDataFrame(pool, schema), spark.createDataFrame(wanted, schema), "g", "id", "n", "x", 300).collect()
    assert len(r) == 1 and r[0].iterations == 300 and r[0].length_gap == 0
    assert r[0].difference == pytest.approx(10 - (1 + 1 + 3.5) / 3, abs=0.1)


def test_ranges_equal_the_whole_in_any_order():
    """The sequential matcher over all lengths, and over each range with its own part of the order."""
    rng = random.Random(7)
    cut = 0
    for _ in range(400):
        have = {rng.randint(1, 40): rng.randint(1, 9) for _ in range(rng.randint(2, 30))}
        order = [rng.choice([*have, rng.randint(0, 42)]) for _ in range(rng.randint(1, max(1, min(12, sum(have.values()) - 1))))]
        lengths = np.array(sorted(have))
        wanted = np.array(sorted(set(order)))
        starts = matching.cut_ranges(lengths, np.array([have[n] for n in lengths.tolist()]), wanted, np.array([order.count(n) for n in wanted.tolist()]))
        edges = [-1, *lengths[starts][1:].tolist(), 10**9]
        cut += len(starts) > 1
        draw = lambda a, b: a * 3 >= b * 2
        parts = {}
        for low, high in zip(edges, edges[1:]):
            parts |= matching.take_nearest({n: c for n, c in have.items() if low <= n < high}, [x for x in order if low <= x < high], draw)
        assert parts == matching.take_nearest(have, order, draw)
    assert cut > 100


def test_a_hot_group_is_many_ranges(spark):
    """A third of all rows in one group, with a short supply in one place: its rows for Spark are ranges, not the group."""
    rng = np.random.default_rng(2)
    n = rng.integers(100, 400, 40_000)
    pool = spark.createDataFrame([("hot", i, int(x), float(x % 7)) for i, x in enumerate(n)] + [("b", 10**6 + i, 5, 1.0) for i in range(50)], "g string, id long, n long, x double")
    wanted = spark.createDataFrame([("hot", i, int(x), 1.0) for i, x in enumerate([*rng.integers(100, 400, 2000), *[401] * 300])] + [("b", i, 5, 3.0) for i in range(60)] + [("c", 1, 5, 1.0)], "g string, id long, n long, x double")
    sides = pool.select("g", "n", F.lit(1).alias("have"), F.lit(0).alias("want")).unionByName(wanted.select("g", "n", F.lit(0).alias("have"), F.lit(1).alias("want")))
    h = sides.groupBy("g", "n").agg(F.sum("have").alias("have"), F.sum("want").alias("want")).toPandas()
    parts = matching._ranges(h[h["g"] == "hot"])
    assert len(parts) > 200 and sum(map(sum, parts["want"])) == 2300
    got = {r.g: r for r in matching.length_matched(pool, wanted, "g", "id", "n", "x", 50).collect()}
    assert set(got) == {"hot", "b"} and got["b"].difference == 2.0 and got["b"].length_gap == 0.0 and got["hot"].iterations == 50
    plain = []
    have = {int(k): int(v) for k, v in zip(*np.unique(n, return_counts=True))}
    want = [r.n for r in wanted.where("g = 'hot'").collect()]
    for it in range(20):
        taken = matching.match_lengths(have, want, np.random.default_rng(it))
        plain.append(np.mean(want) - sum(k * v for k, v in taken.items()) / sum(taken.values()))
    assert got["hot"].length_gap == pytest.approx(np.mean(plain), abs=0.02)


def test_idioms_and_cover(spark):
    docs = spark.createDataFrame([(1, "not only red but also blue. not only green."), (2, None), (3, "but also x not only y not only z.")], "doc_id long, text string")
    idioms = spark.createDataFrame([("i", "not only", "but also")], "idiom string, first string, second string")
    assert sorted(map(tuple, linguistic.two_part_idioms(docs, idioms).collect())) == [(1, "i", 1), (3, "i", 1)]
    lexicon = spark.createDataFrame([("neg", "not only"), ("add", "but also")], "feature string, term string")
    got = {r.doc_id: r for r in linguistic.compound_sentences(docs, lexicon).collect()}
    assert (got[1].relation_sentences, got[1].compound, got[1].relations) == (3, 2, 2)
    free = {r.doc_id: (r.free_u, r.free_n) for r in linguistic.uncovered(docs, linguistic.lexicon_spans(docs, lexicon), ["u", "n"]).collect()}
    assert free == {1: (1, 1), 3: (3, 0)}  # red; blue (green is tagged v)


def test_checks(spark):
    df = spark.createDataFrame([("t", "admin", 10), ("t", "ok", 1), ("", "ok", 10), ("t", "ok", None), ("t", "ok", 10)], "body string, title string, n int")
    reason = validation.first_failure(validation.article_checks(F.col("body"), F.col("title"), ["admin"], F.col("n"), 5, 50))
    assert [r[0] for r in df.select(reason).collect()] == ["excluded", "too short", "empty", "too short", None]
    page = spark.createDataFrame([(1, '<li><a href="u1">A</a></li><li>none</li><i>p=3</i><i>p=12</i>'), (2, None)], "page_id long, html string")
    rows = validation.listing(page, "html", "<li>.*?</li>", {"url": 'href="([^"]*)"'}).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "u1"), (1, 1, "")]
    assert [r[0] for r in page.select(validation.last_page(F.col("html"), r"p=(\d+)")).collect()] == [12, 1]


def test_slot_cost(spark):
    rows = [(t, d, p, s) for t in ("exact", "near", "extended", "broad", "mismatch", None) for d in ("1990-01-01", "2015-05", "2000", "undated", None) for p in (True, False, None) for s in (None, 20, 400)]
    df = spark.createDataFrame(rows, "t string, d string, p boolean, s long")
    got = [r[0] for r in df.select(matching.slot_cost(F.col("t"), F.col("d"), F.col("p"), F.col("s"), 1995, 2005)).collect()]
    for (t, d, p, s), c in zip(rows, got):
        tier = {"exact": 0.0, "near": 0.16, "extended": 0.38, "broad": 0.68}.get(t)
        year = int(d[:4]) if d and d[:4].isdigit() else None
        years = 0.2 if year is None else 0.0 if 1995 <= year <= 2005 else min(0.35, 0.02 * min(abs(year - 2005), 15))
        assert c == (None if tier is None else pytest.approx(tier + years + (0 if p else 0.55) - min(s or 0, 140) / 3000))


def test_blocks_by_depth(spark):
    html = """<ul><li class="x item"><h2><a href="/1?a=1&amp;b" title="t">One <b>two</b></a></h2><span>2001</span>
      <div>text <ul><li class=item><a href=/in>Inner</a></li></ul> tail</div><p class="sum"> A &lt; B<br>c </p></li>
      <li>no item</li><li class="item"><script>var x = "<a href=no>";</script><p class=sum>open<li class="item"><a>bare</a></ul><div class=item>other tag</div>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    fields = {"url": ("a", None, "href"), "title": ("a", None, None), "sum": ("p", "sum", None), "date": ("span", None, None)}
    got = [tuple(r) for r in validation.listing_blocks(pages, "page_id", "html", ("li", "item"), fields).orderBy("position").collect()]
    assert got == [
        (1, 0, 0, "/1?a=1&b", "One two", "A < Bc", "2001"), (1, 1, 1, "/in", "Inner", "", ""), (1, 2, 0, "", "", "open", ""), (1, 3, 1, "", "bare", "", ""),
    ]


def test_listed_topics_drop_what_matches_no_rule(spark):
    from quillmill.operators.topics import Rule

    html = "".join(f"<div class=b><a href='/{i}'>{t}</a><p>{e}</p></div>" for i, (t, e) in enumerate([("big water", "the end"), ("none", "none"), ("a thing", "the river")]))
    pages = spark.createDataFrame([("k", html)], "page string, html string")
    blocks = validation.listing_blocks(pages, "page", "html", ("div", "b"), {"url": ("a", None, "href"), "title": ("a", None, None), "text": ("p", None, None)})
    rules = [Rule("w", exact=("water",), context=("the",)), Rule("t", exact=("thing", "river"), context=("the",))]
    got = {(r.position, r.code, r.tier, r.url) for r in validation.listed_topics(blocks, "page", "title", "text", rules).collect()}
    assert got == {(0, "w", "exact", "/0"), (2, "t", "exact", "/2")}


def test_scores_in_the_range_or_joined_are_the_same(spark, monkeypatch):
    """No row for each length and iteration reaches a join where a range's scores fit; either way, the same sums."""
    rng = np.random.default_rng(5)
    rows = lambda first, count, top: spark.createDataFrame([(g, first + i, int(n), float(n % 7 + i % 3)) for g in "ab" for i, n in enumerate(rng.integers(1, top, count))], "g string, id long, n long, x double")
    pool, wanted = rows(0, 300, 60), rows(10_000, 120, 70)
    tell = lambda: sorted(map(tuple, matching.length_matched(pool, wanted, "g", "id", "n", "x", 70).collect()))
    held = tell()
    monkeypatch.setattr(matching, "HELD", 20)
    some = tell()
    monkeypatch.setattr(matching, "HELD", 0)
    for a, b, c in zip(held, some, tell()):
        assert a[0] == b[0] == c[0] and b[1:] == pytest.approx(a[1:]) and c[1:] == pytest.approx(a[1:]) and a[-1] == 70
