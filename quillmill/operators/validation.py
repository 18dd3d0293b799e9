"""Ordered checks of pages and candidates, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without an end tag.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The reason of the first check that does not hold (a null does not), null if all do."""
    out = F.lit(None).cast("string")
    for reason, holds in reversed(checks):
        out = F.when(~F.coalesce(holds, F.lit(False)), reason).otherwise(out)
    return out


def signals(text: Column, markers: list[str]) -> Column:
    """How many of the markers occur in text."""
    return sum((F.coalesce(F.contains(text, F.lit(m)), F.lit(False)).cast("int") for m in markers), F.lit(0))


def article_checks(text: Column, title: Column, excluded: list[str], letters: Column, low: int, high: int) -> list[tuple[str, Column]]:
    """Checks of an article, in order: no excluded term in its title, a length in range, a body that is not empty."""
    return [("excluded", signals(F.coalesce(title, F.lit("")), excluded) == 0), ("too short", letters >= low), ("too long", letters <= high), ("empty", F.length(F.trim(text)) > 0)]


def candidate_status(failed: Column, reason: Column, decision: Column, tier: Column) -> tuple[Column, Column]:
    """(status, why): a page that could not be read, then an invalid one, then one that a person excluded, then one off
    topic; others are candidates. Reasons are cut to 240 characters."""
    status = F.when(failed.isNotNull(), "failed").when(reason.isNotNull(), "invalid").when(decision == "exclude", "excluded").when(tier == "mismatch", "off topic").otherwise("candidate")
    return status, F.substring(F.coalesce(failed, reason), 1, 240)


def review(candidates: DataFrame, manual: DataFrame, keys: list[str]) -> DataFrame:
    """candidates with the decision of `manual`, a table of the few cases that people looked at."""
    return candidates.join(manual.select(*keys, "decision").distinct(), keys, "left")


def listing(pages: DataFrame, html: str, block: str, fields: dict[str, str]) -> DataFrame:
    """One row for each repeated block of a listing page (null pages have none): its number, and each field's first
    group, '' where it does not match."""
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.regexp_extract_all(html, F.lit(block), F.lit(0))).alias("position", "_block"))
    return rows.select(*[c for c in rows.columns if c != "_block"], *[F.regexp_extract("_block", p, 1).alias(name) for name, p in fields.items()])


def last_page(html: Column, pattern: str) -> Column:
    """The greatest page number that pattern's group finds, 1 if none."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda n: n.try_cast("int"))), F.lit(1))


class Blocks(HTMLParser):
    """Repeated blocks of a page by a stack of its open elements: a block begins where an element of its tag and class does and
    ends where that one is closed, at whatever depth, so blocks may stand in one another; what stands in an inner block is not
    the outer one's. Of each block, every field takes the first element of its tag and class: an attribute, or its text."""

    def __init__(self, block: tuple[str, str | None], fields: dict[str, tuple[str, str | None, str | None]]):
        super().__init__(convert_charrefs=True)
        self.block, self.fields = block, fields
        self.stack: list[tuple[str, dict | None, list[str]]] = []  # tag, block that begins there, fields that it fills
        self.open: list[dict] = []
        self.out: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = {k: v or "" for k, v in attrs}
        classes = found.get("class", "").split()
        fits = lambda t, c: t == tag and (c is None or c in classes)
        began = None
        if fits(*self.block) and tag not in VOID:
            began = {"depth": len(self.open), "parts": {}, "filling": set()}
            self.open.append(began)
            self.out.append(began)
        filled = []
        if self.open:
            now = self.open[-1]
            for name, (t, c, attribute) in self.fields.items():
                if name in now["parts"] or not fits(t, c):
                    continue
                now["parts"][name] = [found.get(attribute, "")] if attribute else []
                if not attribute and tag not in VOID:
                    now["filling"].add(name)
                    filled.append(name)
        if tag not in VOID:
            self.stack.append((tag, began, filled))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.stack):
            return
        while True:  # elements that were left open end with the one around them
            t, began, filled = self.stack.pop()
            if self.open:
                self.open[-1]["filling"].difference_update(filled)
            if began is not None:
                self.open.pop()
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.open and (not self.stack or self.stack[-1][0] not in ("script", "style")):
            for name in self.open[-1]["filling"]:
                self.open[-1]["parts"][name].append(data)


def listing_blocks(pages: DataFrame, key: str, html: str, block: tuple[str, str | None], fields: dict[str, tuple[str, str | None, str | None]]) -> DataFrame:
    """key, position (of the block in its page), depth (blocks around it) and each field (tag, class or None, attribute or
    None for the text; white space collapsed), '' where a block has none; pages without html have no row. Pages are read
    where they lie."""
    names = list(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, page in zip(b["key"], b["html"]):
                found = Blocks(block, fields)
                found.feed(page or "")
                found.close()
                rows += [(k, i, r["depth"], *(" ".join("".join(r["parts"].get(n, [])).split()) for n in names)) for i, r in enumerate(found.out)]
            yield pd.DataFrame(rows, columns=["key", "position", "depth", *names]).astype({n: object for n in names})

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {kind}, position int, depth int, " + ", ".join(f"`{n}` string" for n in names))
    return out.withColumnRenamed("key", key)


def listed_topics(blocks: DataFrame, key: str, title: str, excerpt: str, rules: list, head: int = 260) -> DataFrame:
    """`listing_blocks` with code, tier and score: a row for each rule that the title and excerpt of a block match; the others
    are dropped."""
    from quillmill.operators.topics import topics

    whole = F.struct(*[F.col(c) for c in blocks.columns])
    told = topics(blocks.select(whole.alias("doc_id"), F.concat_ws(" ", title, excerpt).alias("text")), rules, head)
    return told.where("tier <> 'mismatch'").select("doc_id.*", "code", "tier", "score")


class Places(HTMLParser):
    """Texts of the places that `rules` (name → (tag, class or None)) mark, to the end of the element; line ends for br, p
    and div."""

    def __init__(self, rules: dict[str, tuple[str, str | None]]):
        super().__init__(convert_charrefs=True)
        self.rules, self.out, self.open, self.depth, self.skip = rules, {n: [] for n in rules}, {}, 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        classes = (dict(attrs).get("class") or "").split()
        if tag in ("br", "p", "div"):
            for n in self.open:
                self.out[n].append("\n")
        if tag in VOID:
            return
        self.depth += 1
        self.skip += tag in ("script", "style")
        for n, (t, c) in self.rules.items():
            if n not in self.open and not self.out[n] and t == tag and (c is None or c in classes):
                self.open[n] = self.depth

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag in ("p", "div"):
            for n in self.open:
                self.out[n].append("\n")
        self.skip -= tag in ("script", "style") and self.skip > 0
        for n in [n for n, d in self.open.items() if d == self.depth]:
            del self.open[n]
        self.depth -= 1

    def handle_data(self, data: str) -> None:
        if not self.skip:
            for n in self.open:
                self.out[n].append(data)


def page_places(pages: DataFrame, key: str, html: str, rules: dict[str, tuple[str, str | None]]) -> DataFrame:
    """key and the text of each place of every page, '' where there is none; null html has none. Pages are read in Arrow
    batches where they lie."""
    names = list(rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, page in zip(b["key"], b["html"]):
                found = Places(rules)
                found.feed(page or "")
                found.close()
                rows.append((k, *("".join(found.out[n]) for n in names)))
            yield pd.DataFrame(rows, columns=["key", *names])

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {kind}, " + ", ".join(f"`{n}` string" for n in names))
    return out.withColumnRenamed("key", key)


def articles(pages: DataFrame, key: str, url: str, html: str, rules: dict[str, tuple[str, str | None]], genres: list[str], grades: str, boilerplate: list[str], dropped: list[str], tail: str, markers: list[str]) -> DataFrame:
    """Fields of each page's article: title (the place title, else the page's title), breadcrumb, published (a date in the
    place meta, else in the url, else ''), source (a label in meta), grade (first match of `grades` in breadcrumb and
    title, else ''), genre (the first of `genres` in them, else ''), article_id (digits in the url, else the start of its
    SHA-1), raw_text, clean_text, letters, text_hash (SHA-256 without white space), and failed: why there is no article.

    `rules` names the places title, page_title, breadcrumb, meta and body.
    """
    from quillmill.functions import text as T

    p = pages.select(key, F.col(url).alias("url")).join(page_places(pages, key, html, rules), key)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    p = p.select(key, "url", squeeze(F.when(squeeze(F.col("title")) != "", F.col("title")).otherwise(F.col("page_title"))).alias("title"), squeeze(F.col("breadcrumb")).alias("breadcrumb"), squeeze(F.col("meta")).alias("meta"), F.trim(F.regexp_replace("body", r"^\s+|\s+$", "")).alias("raw_text"))
    date = r"(\d{4})[-/年.](\d{1,2})[-/月.](\d{1,2})"
    day = lambda c: F.when(c.rlike(date), F.concat_ws("-", F.regexp_extract(c, date, 1), F.lpad(F.regexp_extract(c, date, 2), 2, "0"), F.lpad(F.regexp_extract(c, date, 3), 2, "0")))
    header = F.concat_ws(" ", "breadcrumb", "title")
    genre = F.lit("")
    for g in reversed(genres):
        genre = F.when(F.contains(header, F.lit(g)), g).otherwise(genre)
    number = F.regexp_extract("url", r"/(\d{3,})(?:\.\w+)?/?(?:[?#].*)?$", 1)
    p = p.select(
        key, "url", "title", "breadcrumb", "raw_text", F.coalesce(day(F.col("meta")), day(F.col("url")), F.lit("")).alias("published"), T.source_label(F.regexp_extract("meta", r"((?:来源|[Ss]ource)[:：]\s*\S+(?:\s*\S+)?)", 1), markers).alias("source"),
        F.regexp_extract(header, grades, 0).alias("grade"), genre.alias("genre"), F.when(number != "", number).otherwise(F.substring(F.sha1("url"), 1, 16)).alias("article_id"), T.clean_body(F.col("raw_text"), F.col("title"), boilerplate, dropped, tail).alias("clean_text"),
    )
    return p.withColumns({"letters": F.regexp_count("clean_text", F.lit(r"\p{L}")).cast("long"), "text_hash": F.sha2(F.regexp_replace("clean_text", r"(?U)\s+", ""), 256), "failed": F.when(F.col("raw_text") == "", "no body")})


def genre_checks(header: Column, breadcrumb: Column, text: Column, stages: list[str], excluded: list[str], genre: str, named: dict[str, list[str]], units: list[str], on_topic: Column, markers: list[str], letters: Column, low: int, high: int, tolerance: float = 0.0) -> list[tuple[str, Column]]:
    """Ordered checks of an article: a stage in its breadcrumb, no excluded term in its header, its genre by a name in the
    header (`named`), or, in pages of a unit, by topic for the first genre and by two or more `markers` for the others, a
    length from low to floor(high * (1 + tolerance)), and a text."""
    any_in = lambda c, terms: signals(c, terms) > 0
    inferred = on_topic if genre == next(iter(named)) else signals(text, markers) >= 2
    return [
        ("stage", any_in(breadcrumb, stages)), ("excluded", ~any_in(header, excluded)), ("genre", any_in(header, named[genre]) | (any_in(breadcrumb, units) & inferred)),
        ("length", letters.between(low, int(high * (1 + tolerance)))), ("empty", F.length(F.trim(text)) > 0),
    ]
