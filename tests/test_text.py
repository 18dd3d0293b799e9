import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw,want", [("榜[b棒]样", "榜样"), ("他{CQ的}书", "他的书"), ("a［BQ，］b", "a，b"), ("x[BC。]y", "xy"), ("{CP他{CC了去}走P}", "他走"), ("a]b[", "a]b["), ("keep [1] it", "keep [1] it"), ("{CJ-zy我}好", "我好"), ("{CJ+buy他}好", "好"), ("", ""), ("{CPa" * 6 + "zP}" + "P}" * 5, "a" * 6 + "z"), ("[BQ" * 40 + "x" + "]" * 40, "x"), ("{ [BQa] (b", "{ a (b"), ("{Wx}{wx}", "{wx}")])
def test_annotations(spark, raw, want):
    assert one(spark, raw, T.clean_annotations) == want


@pytest.mark.parametrize("raw,want", [("  a \t b　c \r\n\n\n\n d\n", "a b c\n\nd\n"), ("", ""), (" \n ", "")])
def test_space(spark, raw, want):
    assert one(spark, raw, T.normalize_space) == want


def test_small_functions(spark):
    assert one(spark, "他说“好”和「是」 \"a\" “x\ny”", T.count_direct_quotes) == 4
    assert one(spark, "aabaa", lambda c: T.occurrences(c, ["a", "aa"])) == 2
    assert one(spark, "2010-02-03", T.publication_year) == 2010 and one(spark, None, T.publication_year) == 9999
    assert one(spark, "我的家（二）_500字", T.base_title) == "我的家"
    assert one(spark, "http://m.example.com/a/b?x=1", T.normalize_url) == "https://www.example.com/a/b"
    assert one(spark, "http://other.org/a?x", T.normalize_url) == "https://other.org/a?x"
    assert one(spark, "x" * 50 + "。" + "y" * 120 + "。", T.excerpt) == "y" * 120 + "。"
    assert one(spark, "短", T.excerpt) == "短"
    assert one(spark, "土家族", lambda c: T.exclusion_reason(c, ["香港"])) == "minority" and one(spark, " ", lambda c: T.exclusion_reason(c, ["香港"])) == "missing"
    assert one(spark, "法国", lambda c: T.exclusion_reason(c, ["香港"])) is None


@pytest.mark.parametrize("score", ["2.5", None, "", "7", "x"])
def test_a_score_of_no_stratum_is_an_error(spark, score):
    assert one(spark, " 60.0", lambda c: T.stratum_score(c, [60, 65])) == 60
    with pytest.raises(Exception, match="no stratum"):
        one(spark, score, lambda c: T.stratum_score(c, [60, 65]))
