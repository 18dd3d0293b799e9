import numpy as np

from quillmill.llm import chroma


def tune(seed, notes=60):
    rng = np.random.default_rng(seed)
    t = np.arange(500) / chroma.RATE
    return np.concatenate([9000 * np.sin(2 * np.pi * 110 * 2 ** (n / 12) * t) for n in rng.integers(0, 24, notes)]).astype("<i2")


def prints(pcm):
    return chroma.fingerprint(chroma.chroma(pcm))


def test_integral_image_equals_direct_sums():
    x = np.random.default_rng(0).random((40, 12))
    widest = max(chroma.areas(k)[3] for k in range(chroma.FILTERS))
    around = np.concatenate([x, x[:, :10]], axis=1)
    kind, p, h, w = chroma.areas(0)
    assert kind == 0
    a = np.array([around[i : i + w // 2, p : p + h].sum() for i in range(len(x) - widest + 1)])
    b = np.array([around[i + w // 2 : i + w, p : p + h].sum() for i in range(len(x) - widest + 1)])
    want = chroma.GRAY[np.digitize(np.log((1 + a) / (1 + b)), (-0.2, 0.0, 0.2))]
    assert np.array_equal(chroma.fingerprint(x) >> 30, want)


def test_alignment_finds_the_offset():
    a = tune(1)
    rng = np.random.default_rng(5)
    noisy = (a + rng.normal(0, 300, len(a))).astype("<i2")
    offset, hits, error = chroma.align(prints(a[chroma.HOP * 20 :]), prints(noisy))
    assert offset == 20 and hits > 20 and error < 0.1
    other = chroma.align(prints(a), prints(tune(2)))
    assert other is None or other[2] > 0.25 or other[1] < 8


def test_recordings(spark):
    a, b = tune(1), tune(2)
    noisy = (a + np.random.default_rng(5).normal(0, 300, len(a))).astype("<i2")
    rows = [(50, a), (51, a), (52, noisy), (53, b), (100, b[chroma.HOP * 30 :]), (54, a[:10]), (55, None), (56, tune(9)), (51, a)]
    df = spark.createDataFrame([(i, None if p is None else bytearray(p.tobytes()), "x", 1) for i, p in rows], "media_id long, pcm binary, print string, links int")
    got = {r.media_id: r for r in chroma.align_queries(chroma.fingerprints(df)).collect()}
    assert chroma.align_queries(chroma.fingerprints(df)).count() == len(rows)
    assert got[50].class_id == got[51].class_id == 50 and got[51].links == 0
    assert (got[52].match_id, got[52].offset, got[52].links) == (50, 0, 1)
    assert (got[53].match_id, got[53].offset) == (100, -30)
    assert got[54].class_id == got[55].class_id == 54 and got[54].links == got[56].links == 0 and got[56].match_id is None
    assert chroma.align_queries(chroma.fingerprints(df.limit(0))).count() == 0


def test_offsets_equal_all_pairs(monkeypatch):
    monkeypatch.setattr(chroma, "PAIRS", 50)
    rng = np.random.default_rng(4)
    for n, m, top in ((30, 50, 5), (400, 300, 2), (1, 1, 1), (700, 3, 3), (0, 5, 2)):
        a, b = rng.integers(0, top, n).astype(np.uint32), rng.integers(0, top, m).astype(np.uint32)
        want = np.zeros(max(0, n + m - 1) if n and m else 0, int)
        for i in range(n):
            for j in range(m):
                want[j - i + n - 1] += a[i] == b[j]
        assert np.array_equal(chroma.offsets(a, b), want)


def test_hours_of_silence_stay_small():
    a = prints(np.zeros(chroma.RATE * 1800, "<i2"))
    assert chroma.align(a, a) == (0, len(a), 0.0)


def test_quotes_are_found_as_by_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.125, 64).tolist(), "x") for i in range(150)] + [(150, None, "x"), (151, [], "x"), (153, rng.normal(0, 0.125, 64).tolist(), "x")]
    df = spark.createDataFrame(rows, "media_id long, embedding array<double>, print string")
    made = chroma.fingerprints(chroma.melodies(chroma.with_quotes(df)))
    p = {r.media_id: np.frombuffer(bytes(r.print), "<u4") for r in made.collect()}
    want = {}
    for i in p:
        near = [(q, got) for q in (0, 50, 100) if q != i and len(p[i]) and (got := chroma.align(p[i], p[q])) and got[1] >= 8 and got[2] <= 0.25]
        want[i] = len(near)
    got = {r.media_id: r for r in chroma.align_queries(made).collect()}
    assert {i: r.links for i, r in got.items()} == want
    quoting = [i for i in range(150) if i % 4 == 1 and i % 50]
    found = [i for i in quoting if got[i].match_id == i // 50 * 50]
    assert len(found) >= 0.9 * len(quoting) and sum(want.values()) <= 1.1 * len(quoting), (len(found), len(quoting), sum(want.values()))


def test_pages_are_bounded_in_bytes_and_lose_nothing(spark, monkeypatch):
    """A page is one task's; no row that meets it holds more than one recording."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 0.125, 64).tolist()) for i in range(203)] + [(203, None)]
    made = chroma.with_quotes(spark.createDataFrame(rows, "media_id long, embedding array<double>"))
    prints = chroma.melody_fingerprints(made)
    assert sorted(map(tuple, prints.collect())) == sorted(map(tuple, chroma.fingerprints(chroma.melodies(made)).collect()))
    whole = sorted(map(tuple, chroma.align_queries(prints).collect()), key=str)
    monkeypatch.setattr(chroma, "PAGE", 4000)
    monkeypatch.setattr(chroma, "PAIRS", 64)
    got = chroma.align_queries(prints)
    assert sorted(map(tuple, got.collect()), key=str) == whole and sum(r[2] for r in whole) >= 40


def test_sharing_equals_counts_of_pairs():
    rng = np.random.default_rng(3)
    own = [rng.integers(0, 9, n).astype(np.uint32) for n in (5, 1, 30, 7, 12)]
    p = rng.integers(0, 9, 6).astype(np.uint32)
    page = chroma.Page(list(range(5)), own)
    for least in (1, 4, 8, 20):
        assert page.sharing(p, least).tolist() == [k for k, x in enumerate(own) if (x[:, None] == p[None, :]).sum() >= least]
    assert chroma.Page([], []).sharing(p, 1).tolist() == []
