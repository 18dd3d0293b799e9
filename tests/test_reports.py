import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import reports


def test_one_to_one(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.25)], "k int, v double")
    assert reports.one_to_one(a, a.select("k", F.col("v").alias("w")), ["k"]).count() == 2 and reports.greatest_error(a, a, ["k"], "v") == 0
    for wrong in (a.where("k = 1"), a.union(a), spark.createDataFrame([(1, 0.0), (None, 1.0)], "k int, v double")):
        with pytest.raises(ValueError):
            reports.one_to_one(a, wrong.select("k", F.col("v").alias("w")), ["k"])
    with pytest.raises(ValueError):
        reports.greatest_error(a, a.withColumn("v", F.col("v") + 1), ["k"], "v")


def test_unions_and_override(spark):
    a = spark.createDataFrame([("f", "x")], "feature string, term string")
    b = spark.createDataFrame([("g", "y")], "feature string, term string")
    assert reports.lexicon_union(a, b, ["f", "g"]).count() == 2
    for x, y, names in ((a, a, ["f"]), (a, b, ["f"]), (a, b, ["f", "g", "h"])):
        with pytest.raises(ValueError):
            reports.lexicon_union(x, y, names)
    assert sorted(r.source for r in reports.labelled_union({"p": a, "q": b}).collect()) == ["p", "q"]
    pages = spark.createDataFrame([("u", "g1", "t"), ("v", "g1", "t")], "url string, grade string, genre string")
    listed = spark.createDataFrame([("u", True, "g2", ""), ("v", False, "g3", "x")], "url string, ok boolean, grade string, genre string")
    assert sorted(map(tuple, reports.override(pages, listed, "url", "ok", ["grade", "genre"]).collect())) == [("u", "g2", "t"), ("v", "g1", "t")]


def test_loadings_and_representatives(spark):
    l = spark.createDataFrame([("a", "1", 0.5), ("a", "2", -0.9), ("b", "1", 0.4), ("b", "2", 0.1)], "feature string, factor string, loading double")
    assert sorted((r.feature, r.main, r.main_loading) for r in reports.main_loadings(l, ["1", "2"]).collect()) == [("a", "2", -0.9), ("b", "1", 0.4)]
    assert sorted((r.factor, r.sign, r.place, r.feature) for r in reports.top_loadings(l).collect()) == [("1", 1, 1, "a"), ("1", 1, 2, "b"), ("2", -1, 1, "a")]
    s = spark.createDataFrame([(i, float(i), float(10 - i)) for i in range(11)], "id long, x double, y double")
    got = [tuple(r)[:3] for r in reports.representatives(s, "id", ["x", "y"], {"low": 0.1, "high": 0.9}).collect()]
    assert got == [("x", "low", 1), ("x", "high", 9), ("y", "low", 8), ("y", "high", 0)]


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(T.body_lines(lit("200105 x.12\n 1234567 title.1 a\nTitle: y\n\nbody\n(A1) （B2）"))) == "200105 x.12\n\nbody" or one(T.body_lines(lit("1234567 t.1\nTitle: y\n\nbody\n(A1) （B2）"))) == "\nbody"
    assert tuple(one(T.level_parts(lit("4（5）（6）")))) == ("4", "5|6", "middle") and one(T.level_parts(lit("（5）"))) is None and tuple(one(T.level_parts(lit("7-9")))) == ("7-9", "", "advanced")
    assert one(T.absolute_url(lit("/a/1"))) == "https://www.example.com/a/1" and one(T.is_article_url(lit("https://www.example.com/a/12345.shtml"))) and not one(T.is_article_url(lit("https://other.com/a/12345")))
    assert one(T.source_label(lit(" 来源：  the  paper | "), ["editor"])) == "the paper" and one(T.nominal_length(lit("x_500字"))) == 500
    assert one(T.p_text(lit(0.0001))) == "<.001" and one(T.p_text(lit(0.0321))) == ".032"
    assert one(T.whole_score(lit(" 85.0 "))) == 85 and one(T.whole_score(lit("x"))) is None and one(T.sheet_title(lit("J1-On rain"), lit("J1"))) == "On rain"
    body = "My title\nline  one\nscan the code below\n\n\n\nline two\nGreen School class 3\n\n"
    assert one(T.clean_body(lit(body), lit("my TITLE"), ["scan the code.*"], ["^dropped"], "[A-Z][a-z]+ School.*")) == "line one\n\nline two"
    assert [one(T.effect_label(lit(x))) for x in (0.1, -0.3, 0.6, 2.0)] == ["negligible", "small", "medium", "large"]
    assert one(T.leftover_markers(lit("a [Bx] b {Cyy} [Bx]"))) == ["[Bx]", "{Cyy}"]


def test_numbers_and_gaps(spark):
    df = spark.createDataFrame([("J", 5), ("J", 3), ("K", 1)], "code string, n int")
    assert sorted(r.filename for r in reports.numbered(df, "code", ["n"]).collect()) == ["J_001", "J_002", "K_001"]
    assert sorted(map(tuple, reports.serial_gaps(spark.createDataFrame([(1,), (3,), (3,), (9,)], "s int"), "s", 4).collect())) == [(2, 0), (3, 2), (4, 0), (9, 1)]
    assert reports.chosen_columns(spark.createDataFrame([(1, 2, 3)], "id int, a int, b int"), ["id"], spark.createDataFrame([("f", "b;a")], "feature string, columns string"), ["f"]) == ["id", "a", "b"]
    assert reports.direct_metrics(["x rate", "y", "z ratio"], "rate", ["ratio"], ["z ratio"], {"x rate": "c", "z ratio": "c"}, ["c"]) == ["x rate"]
