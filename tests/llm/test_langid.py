import numpy as np
from pyspark.sql import functions as F

from quillmill.llm import langid


def corpus(spark, n=240):
    rng = np.random.default_rng(1)
    parts = {"aa": ["tho", "wer", "ing", "sha"], "bb": ["eau", "oui", "ch", "lle"], "cc": ["sch", "ung", "keit", "zu"]}
    rows = []
    for i in range(n):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(rng.integers(1, 40))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_rejection(spark):
    docs = corpus(spark)
    model = langid.fit(docs, ~langid.held_out(F.col("doc_id")), per_language=100, bits=12)
    rows = langid.predict(docs, model).join(docs, "doc_id").where(langid.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.drop_rejected(docs, model).count() >= 0.97 * docs.count()


def test_awkward_rows(spark, awkward, empty):
    model = langid.fit(awkward, ~langid.held_out(F.col("doc_id")), bits=12)
    rows = {r.doc_id: r for r in langid.predict(awkward, model).collect()}
    assert len(rows) == awkward.select("doc_id").distinct().count()
    for d in (1, 2, 3, 11):
        assert (rows[d].lang_pred, rows[d].score, rows[d].rejected) == ("und", 0.0, True)
    assert {r.lang_pred for r in rows.values()} <= {"en", "fr", "und"}
    kept = langid.drop_rejected(awkward, model)
    assert kept.columns == awkward.columns and not {1, 2, 3, 11} & {r.doc_id for r in kept.collect()}
    none = langid.fit(empty, F.lit(True), bits=12)
    assert langid.predict(empty, none).count() == 0
    assert {r.lang_pred for r in langid.predict(awkward, none).collect()} == {"und"}


def test_fit_is_reproducible(spark):
    docs = corpus(spark)
    a, b = (langid.fit(d, F.lit(True), bits=12) for d in (docs, docs.repartition(5)))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_subwords_do_not_cross_words():
    rows, of = langid.subwords(["ab", "c"], 16, 3)
    alone = [langid.subwords([w], 16, 3)[0] for w in ("ab", "c")]
    for i in (0, 1):
        assert sorted(rows[of == i]) == sorted(alone[i])
