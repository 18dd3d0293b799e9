"""Sources and sinks: corpora of text files, master tables, lexicons, vocabularies, JSON payloads, stored pages; texts,
result tables, payloads, resume and pruning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """*/*.txt, a file each document: code (folder), doc_id (file's stem), text."""
    name = F.col("_metadata.file_path")
    return spark.read.text(f"{path}/*/*.txt", wholetext=True).select(F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("code"), F.regexp_extract(name, r"([^/]+)\.txt$", 1).alias("doc_id"), F.col("value").alias("text"))


def read_master(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    df = spark.read.csv(path, header=True)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    df = df.select([F.trim(c).alias(c) for c in df.columns]).replace("", None).dropna(how="all")
    return df.withColumn("filename", F.regexp_replace("filename", r"\.txt$", "")) if "filename" in df.columns else df


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """category, feature, term, prefixes; blank or repeated (feature, term) rows are an error."""
    df = spark.read.csv(path, header=True).toDF("category", "feature", "term", "prefixes", "note")
    df = df.select(*[F.trim(c).alias(c) for c in df.columns]).withColumn("prefixes", F.filter(F.split(F.coalesce("prefixes", F.lit("")), r"\|"), lambda p: p != ""))
    bad = df.groupBy("feature", "term").count().where("count > 1 or term is null or term = '' or feature is null").limit(1).count()
    if bad:
        raise ValueError("blank or repeated lexicon entries")
    return df


def _table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A CSV table with a header row (UTF-8, with or without BOM) under these names; cells trimmed, blank rows dropped."""
    df = spark.read.csv(path, header=True)
    if len(df.columns) != len(names):
        raise ValueError(f"{len(names)} columns expected, found {df.columns}")
    df = df.toDF(*names)
    return df.select(*[F.trim(c).alias(c) for c in names]).replace("", None).dropna(how="all")


def _reject(bad: DataFrame, what: str) -> None:
    rows = bad.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {[tuple(r) for r in rows]}")


def read_idioms(spark: SparkSession, path: str, kinds: list[str], two_part: str) -> DataFrame:
    """kind, first, second (null but for kind `two_part`, which needs it), source; other kinds, blank and repeated rows are
    an error. Sorted by kind, first, second."""
    df = _table(spark, path, ["kind", "first", "second", "source"])
    _reject(df.where(~F.coalesce(F.col("kind").isin(kinds), F.lit(False)) | F.col("first").isNull() | ((F.col("kind") == two_part) == F.col("second").isNull())), "wrong idiom rows")
    _reject(df.groupBy("kind", "first", "second").count().where("count > 1"), "repeated idioms")
    return df.orderBy("kind", "first", "second")


def read_vocabulary(spark: SparkSession, path: str, levels: list[str]) -> DataFrame:
    """word, level, tags (letters of word classes, `n/v` or `n、v` split); other levels and blank words are an error."""
    df = _table(spark, path, ["word", "level", "tags"])
    _reject(df.where(F.col("word").isNull() | ~F.coalesce(F.col("level").isin(levels), F.lit(False))), "wrong vocabulary rows")
    return df.withColumn("tags", F.filter(F.split(F.coalesce("tags", F.lit("")), r"[/、,，;；\s]+"), lambda t: t != "")).distinct()


def read_reviews(spark: SparkSession, path: str, codes: list[str]) -> DataFrame:
    """code, url, decision (exclude or keep), reason of pages that people looked at; anything else is an error."""
    df = _table(spark, path, ["code", "url", "decision", "reason"])
    ok = F.col("code").isin(codes) & F.col("url").rlike("^https?://") & F.col("decision").isin("exclude", "keep")
    _reject(df.where(~F.coalesce(ok, F.lit(False))), "wrong review rows")
    return df.groupBy("code", "url").agg(F.max_by(F.struct("decision", "reason"), F.struct("decision", "reason")).alias("d")).select("code", "url", "d.*")


def check_features(lexicon: DataFrame, features: list[str]) -> DataFrame:
    """lexicon, if all its features are known ones."""
    _reject(lexicon.where(~F.coalesce(F.col("feature").isin(features), F.lit(False))).select("feature", "term"), "unknown features")
    return lexicon


def parse_text(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Text-service payloads {code, data: text} → keep, text; another code than 200, or no text, gives null."""
    parsed = F.from_json(column, "struct<code:int,data:string>")
    return df.select(*keep, F.when((parsed["code"] == 200) & (F.trim(parsed["data"]) != ""), parsed["data"]).alias("text"))


def parse_samples(df: DataFrame, column: str, fields: str) -> DataFrame:
    """Documents {groups: {code: [sample, …]}} → code and a row for each sample, with fields as a DDL string tells."""
    parsed = F.from_json(column, f"struct<groups:map<string,array<struct<{fields}>>>>")
    return df.select(F.explode(parsed["groups"]).alias("code", "samples")).select("code", F.inline("samples"))


def parse_payload(df: DataFrame, column: str, key: str) -> DataFrame:
    """Payloads {headers: […], rows: [[…], …]} → (key, row, header, value): one row for each cell; a row of another length
    than the headers is an error when it is read."""
    parsed = F.from_json(column, "struct<headers:array<string>,rows:array<array<string>>>")
    rows = df.select(key, parsed["headers"].alias("h"), F.posexplode(parsed["rows"]).alias("row", "r"))
    checked = F.when(F.size("h") == F.size("r"), F.arrays_zip(F.col("h").alias("header"), F.col("r").alias("value"))).otherwise(F.raise_error(F.lit("a row's length differs from the headers'")).cast("array<struct<header:string,value:string>>"))
    return rows.select(key, "row", F.inline(checked))


def payload_table(cells: DataFrame, key: str, headers: list[str]) -> DataFrame:
    """The cells of `parse_payload` as a table with the headers as columns."""
    return cells.groupBy(key, "row").agg(*[F.max(F.when(F.col("header") == h, F.col("value"))).alias(h) for h in headers])


def parse_search(df: DataFrame, column: str, own: str) -> DataFrame:
    """Search payloads {code, data: {items: [...]}} → one row for each article of the own site."""
    item = "struct<data_type:string,target_url:string,title:string,content:string,ctime:string,copy_from:string>"
    parsed = F.from_json(column, f"struct<code:int,data:struct<items:array<{item}>>>")
    return df.select(F.explode(parsed["data"]["items"]).alias("i")).select("i.*").where((F.col("data_type") == "article") & F.col("target_url").contains(own))


def decode_pages(pages: DataFrame) -> DataFrame:
    """pages (url, content binary) → url, text, encoding: the declared charset (gb2312 and gbk read as gb18030), then
    utf-8, gb18030, else utf-8 with replacement."""
    import re

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for url, raw in zip(d["url"], d["content"]):
                raw = bytes(raw or b"")
                said = re.search(rb"charset\s*=\s*[\"']?([\w-]+)", raw[:4096], re.I)
                said = said[1].decode().lower() if said else "utf-8"
                for name in ("gb18030" if said in ("gb2312", "gbk") else said, "utf-8", "gb18030"):
                    try:
                        out.append((url, raw.decode(name), name))
                        break
                    except (UnicodeDecodeError, LookupError):
                        continue
                else:
                    out.append((url, raw.decode("utf-8", "replace"), "utf-8"))
            yield pd.DataFrame(out, columns=["url", "text", "encoding"])

    return pages.select("url", "content").mapInPandas(run, "url string, text string, encoding string")


def pending(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose output does not exist yet."""
    return source.join(done.select(key), key, "left_anti")


def write_texts(df: DataFrame, path: str) -> None:
    """Texts under their code's folder; Spark's commit makes a folder appear whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("code").parquet(path)


def write_text_files(df: DataFrame, path: str) -> None:
    """df (code, doc_id, text): one text file in a folder for each document, path/code=…/doc_id=…; written by the tasks,
    whatever their number, and replaced folder by folder."""
    df.select("code", "doc_id", F.col("text").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("code", "doc_id").text(path)


def prune(written: DataFrame, expected: DataFrame, keys: list[str], path: str, codes: list[str]) -> int:
    """Rewrites the folders of `codes` under path without rows whose keys are not expected; how many rows went. Other
    folders stay as they are. What is kept is written to the shared folder first, since a table can't be overwritten while
    it is read."""
    from quillmill.plans.scratch import drop, materialize

    mine = written.where(F.col("code").isin(codes))
    kept = materialize(mine.join(expected.select(*keys).distinct(), keys, "left_semi"), "kept")
    stale = mine.count() - kept.count()
    if stale:
        empty = [c for (c,) in mine.select("code").distinct().exceptAll(kept.select("code").distinct()).collect()]  # a row for each folder
        write_texts(kept, path)
        for c in empty:
            jvm = written.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(f"{path}/code={c}")
            place.getFileSystem(written.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    drop(kept)
    return stale


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV in a folder of its name; a table without rows leaves none, as failures and audits do."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if df.limit(1).count():
            write_table(df, f"{path}/{name}")
        else:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities become null."""
    return df.select(*[F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_payload(df: DataFrame, path: str) -> None:
    """JSON lines; NaN and infinities become null."""
    finite(df).write.mode("overwrite").json(path)


def write_sheets(sheets: dict[str, DataFrame], path: str, metadata: dict[str, str]) -> None:
    """JSON lines of metadata, one, and of sheets: {sheet, columns, row}, one for each row, nulls kept; each sheet's rows
    are written by its own tasks."""
    spark = next(iter(sheets.values())).sparkSession
    out = spark.createDataFrame([(None, None, None, metadata)], "sheet string, columns array<string>, row array<string>, metadata map<string,string>")
    for name, df in sheets.items():
        d = finite(df)
        out = out.unionByName(d.select(F.lit(name).alias("sheet"), F.array(*[F.lit(c) for c in d.columns]).alias("columns"), F.array(*[F.col(c).cast("string") for c in d.columns]).alias("row"), F.lit(None).cast("map<string,string>").alias("metadata")))
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)
