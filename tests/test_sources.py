import pytest
from pyspark.sql import functions as F

from quillmill.operators import validation
from quillmill.sources import io


def test_corpus_and_pages(spark, tmp_path):
    (tmp_path / "c" / "J1").mkdir(parents=True)
    (tmp_path / "c" / "J1" / "a1.txt").write_text("一\n二\n", encoding="utf-8")
    assert tuple(io.read_corpus(spark, str(tmp_path / "c")).first()) == ("J1", "a1", "一\n二\n")
    page = '<meta charset="%s">中文'
    rows = [("u", (page % "utf-8").encode()), ("g", (page % "gb2312").encode("gb18030")), ("x", b"\xff\xfe\x81"), ("n", None)]
    got = {r.url: r for r in io.decode_pages(spark.createDataFrame([(u, None if c is None else bytearray(c)) for u, c in rows], "url string, content binary")).collect()}
    assert got["u"].text.endswith("中文") and got["g"].text.endswith("中文") and got["g"].encoding == "gb18030" and got["n"].text == ""


def test_lexicon_payload_resume(spark, tmp_path):
    (tmp_path / "l.csv").write_text("﻿大类,特征名,词项,允许词性前缀,来源说明\n连接,因果,因为,c|p,x\n连接,因果,所以,,y\n", encoding="utf-8")
    lex = {r.term: r.prefixes for r in io.read_lexicon(spark, str(tmp_path / "l.csv")).collect()}
    assert lex == {"因为": ["c", "p"], "所以": []}
    body = '{"code":1,"data":{"items":[{"data_type":"article","target_url":"http://a.example.com/1","title":"t"},{"data_type":"video","target_url":"http://a.example.com/2"}]}}'
    assert [r.title for r in io.parse_search(spark.createDataFrame([(body,)], "j string"), "j", "example.com").collect()] == ["t"]
    a = spark.range(5)
    assert io.pending(a, a.where("id < 3"), "id").count() == 2
    df = spark.createDataFrame([(float("nan"), 1)], "x double, k int")
    io.write_payload(df, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).select(F.col("k")).first()[0] == 1
    io.write_table(df, str(tmp_path / "t"))
    io.write_texts(spark.createDataFrame([("J1", "t")], "code string, text string"), str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 1


def test_tables_and_payloads(spark, tmp_path):
    import json

    (tmp_path / "i.csv").write_text("\ufeffkind,first,second,source\np,b, ,x\nq,a,c,\n,,,\n", encoding="utf-8")
    assert [tuple(r)[:3] for r in io.read_idioms(spark, str(tmp_path / "i.csv"), ["p", "q"], "q").collect()] == [("p", "b", None), ("q", "a", "c")]
    with pytest.raises(ValueError):
        io.read_idioms(spark, str(tmp_path / "i.csv"), ["p"], "q")
    (tmp_path / "v.csv").write_text("word,level,tags\nw,1,n/v\nw,7-9,\n", encoding="utf-8")
    assert sorted((r.word, r.level, tuple(r.tags)) for r in io.read_vocabulary(spark, str(tmp_path / "v.csv"), ["1", "7-9"]).collect()) == [("w", "1", ("n", "v")), ("w", "7-9", ())]
    (tmp_path / "r.csv").write_text("code,url,decision,reason\nA,http://x/1,exclude,old\n", encoding="utf-8")
    assert io.read_reviews(spark, str(tmp_path / "r.csv"), ["A"]).first().decision == "exclude"
    with pytest.raises(ValueError):
        io.read_reviews(spark, str(tmp_path / "r.csv"), ["B"])
    df = spark.createDataFrame([("k", json.dumps({"code": 200, "data": " text"}), json.dumps({"headers": ["a", "b"], "rows": [["1", None], ["2", "x"]]}), json.dumps({"groups": {"A": [{"n": 1}, {"n": 2}]}}))], "key string, t string, p string, g string")
    assert io.parse_text(df, "t", ["key"]).first().text == " text"
    assert sorted(map(tuple, io.payload_table(io.parse_payload(df, "p", "key"), "key", ["a", "b"]).collect()), key=str) == [("k", 0, "1", None), ("k", 1, "2", "x")]
    assert sorted(map(tuple, io.parse_samples(df, "g", "n:int").collect())) == [("A", 1), ("A", 2)]
    io.write_sheets({"s": spark.createDataFrame([(1, float("nan"))], "a int, b double")}, str(tmp_path / "sheets"), {"v": "1"})
    got = spark.read.json(str(tmp_path / "sheets")).where("sheet = 's'").first()
    assert got["columns"] == ["a", "b"] and got["row"] == ["1", None]


def test_pruning_and_text_files(spark, tmp_path):
    df = spark.createDataFrame([("A", "1", "x"), ("A", "2", "y"), ("B", "3", "z"), ("C", "4", "w")], "code string, doc_id string, text string")
    io.write_texts(df, str(tmp_path / "t"))
    read = lambda: spark.read.schema("doc_id string, text string, code string").parquet(str(tmp_path / "t"))
    assert io.prune(read(), df.where("doc_id = '1'"), ["code", "doc_id"], str(tmp_path / "t"), ["A", "B"]) == 2
    assert sorted(r.doc_id for r in read().collect()) == ["1", "4"]
    io.write_text_files(df, str(tmp_path / "f"))
    assert [p.read_text() for p in (tmp_path / "f").glob("code=A/doc_id=2/part*.txt")] == ["y\n"]
    io.write_tables({"one": df, "failures": df.limit(0)}, str(tmp_path / "csv"))
    assert (tmp_path / "csv/one").is_dir() and not (tmp_path / "csv/failures").exists()


def test_articles(spark):
    page = '<html><head><title>Fallback</title></head><body><div class="path">Home &gt; Senior essays</div><h1>My day_500字</h1><div class="meta">2010-2-3 Source: The Paper editor</div><div class="con"><p>First  line.</p><p>My day_500字</p>Second<br>third<script>x("</p>")</script><p>scan code</p></div><div>after</div></body></html>'
    df = spark.createDataFrame([(1, "http://x/a/123456.shtml", page), (2, "http://x/y", None)], "id long, url string, html string")
    rules = {"title": ("h1", None), "page_title": ("title", None), "breadcrumb": ("div", "path"), "meta": ("div", "meta"), "body": ("div", "con")}
    a, b = validation.articles(df, "id", "url", "html", rules, ["Senior"], "Senior|Junior", ["scan code"], [], "", ["editor"]).orderBy("id").collect()
    assert (a.title, a.breadcrumb, a.published, a.source, a.grade, a.genre, a.article_id) == ("My day_500字", "Home > Senior essays", "2010-02-03", "The Paper", "Senior", "Senior", "123456")
    assert a.clean_text.split() == ["First", "line.", "Second", "third"] and a.letters == 20 and a.failed is None and b.failed == "no body" and len(b.article_id) == 16
    c = spark.createDataFrame([("Senior essays", "Story", "text", 50), ("Junior", "Story", "text", 50), ("Senior unit", "X", "so thus", 50), ("Senior", "bad Story", "t", 50), ("Senior", "Story", "t", 99)], "b string, t string, x string, n int")
    checks = validation.genre_checks(F.col("t"), F.col("b"), F.col("x"), ["Senior"], ["bad"], "argument", {"narrative": ["Tale"], "argument": ["Story"]}, ["unit"], F.lit(True), ["so", "thus"], F.col("n"), 10, 60, 0.1)
    assert [r[0] for r in c.select(validation.first_failure(checks)).collect()] == [None, "stage", None, "excluded", "length"]
