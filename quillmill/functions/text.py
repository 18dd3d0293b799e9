"""Text functions as column expressions: annotation cleaning, white space, titles, URLs, quotes, excerpts, topics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Annotation codes of learner-corpus texts. Codes whose payload stays, codes that go with it, and the
#: letters that begin other codes that go. In square brackets these letters count in either case.
FULLWIDTH = str.maketrans("［］｛｝", "[]{}")
SQUARE_KEPT, SQUARE_DROPPED = ("BQ",), ("BC", "BD", "#")
CURLY_KEPT, CURLY_DROPPED = ("CQ", "BQ"), ("CC", "CLH", "CD", "CJ", "WWJ", "BC", "BD", "#")
LETTERS = "CBLDFYP"
HIT = "\ue002"


def _marker(text: str, a: int, z: int) -> tuple[str, int, int]:
    """What becomes of the marker whose brackets stand at a and z: drop, keep (its payload, from and to), or literal."""
    square, head = text[a] == "[", text[a + 1 : min(z, a + 2)]
    begins = lambda codes: next((c for c in codes if text.startswith(c, a + 1) and a + len(c) < z), None)
    if not square and begins(("CP",)):
        return "keep", a + 3, z - (text[z - 1] == "P" and z - 1 >= a + 3)
    if not square and begins(("CJ-",)):
        at = a + 4
        while at < z and text[at].isascii() and text[at].isalpha():
            at += 1
        return "keep", at, z
    if code := begins(SQUARE_KEPT if square else CURLY_KEPT):
        return "keep", a + 1 + len(code), z
    if begins(SQUARE_DROPPED if square else CURLY_DROPPED) or (head and head in LETTERS + (LETTERS.lower() if square else "")):
        return "drop", z, z
    if not square and head == "W":
        follows = text[a + 2 : min(z, a + 3)]
        if not follows or follows.isdigit() or not follows.islower():
            return "drop", z, z
    return ("drop" if head.isupper() else "literal"), z, z


def without_annotations(text: str) -> str:
    """One pass finds each bracket's partner, whatever the depth; a second one copies what stays."""
    text = text.translate(FULLWIDTH)
    partner, open_ = {}, []
    for i, c in enumerate(text):
        if c in "[{":
            open_.append(i)
        elif c in "]}" and open_ and text[open_[-1]] + c in ("[]", "{}"):
            partner[open_.pop()] = i
    out, skip, i = [], set(), 0
    while i < len(text):
        z = partner.get(i)
        if z is None:
            if i not in skip:
                out.append(text[i])
            i += 1
            continue
        what, start, end = _marker(text, i, z)
        if what == "drop":
            i = z + 1
        elif what == "keep":
            skip.update(range(end, z + 1))
            i = start
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


@F.pandas_udf(StringType())
def clean_annotations(text: pd.Series) -> pd.Series:
    """Payloads of kept codes stay, dropped codes and unknown upper-case ones go, brackets around other text are literal
    and stay. Unmatched brackets stay. Markers nest to any depth. Null stays null."""
    return text.map(without_annotations, na_action="ignore")


def leftover_markers(text: Column, most: int = 10) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\[{][A-Z#][^\[\]{}\s]*[\]}]?"), F.lit(0))), 1, most)


def normalize_space(text: Column) -> Column:
    """Runs of spaces, tabs and U+3000 become one space, lines are trimmed, blank lines collapse, one final newline."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t　]+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^[\n ]+|[\n ]+$", "")
    return F.when(out == "", "").otherwise(F.concat(out, F.lit("\n")))


def count_direct_quotes(text: Column) -> Column:
    return sum((F.regexp_count(text, F.lit(p)) for p in ("“[^”]*”", "「[^」]*」", "『[^』]*』", '"[^"\n]*"')), F.lit(0))


def normalize_url(url: Column, own: str = "example.com") -> Column:
    """Own hosts: https, www host, path without query; other http addresses become https; blank becomes null."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1))
    path = F.regexp_extract(url, r"^https?://[^/?#]+(/[^?#]*)", 1)
    ours = (host == own) | host.endswith("." + own)
    return F.when(F.trim(url) == "", None).when(ours, F.concat(F.lit(f"https://www.{own}"), F.when(path == "", "/").otherwise(path))).otherwise(F.regexp_replace(url, "^http://", "https://"))


def publication_year(date: Column) -> Column:
    return F.coalesce(F.regexp_extract(date, r"^(\d{4})", 1).try_cast("int"), F.lit(9999))


def base_title(title: Column) -> Column:
    """Without tags, a length suffix like _500字, a series number at the end, and all that is not a letter or digit."""
    out = F.regexp_replace(title, "<[^>]*>", "")
    out = F.regexp_replace(out, r"_?\d+字$", "")
    out = F.regexp_replace(out, r"[（(][一二三四五六七八九十\d]+[)）]$|[\s_-]*\d+$", "")
    return F.lower(F.regexp_replace(out, r"[^\p{L}\p{N}]+", ""))


def occurrences(text: Column, terms: list[str]) -> Column:
    """Non-overlapping occurrences of any term, the longest terms first."""
    out = text
    for t in sorted(terms, key=lambda t: (-len(t), t)):
        out = F.replace(out, F.lit(t), F.lit(HIT))
    return F.length(out) - F.length(F.replace(out, F.lit(HIT), F.lit("")))


def topic_tier(text: Column, exact: list[str], near: list[str], broad: list[str], head: int = 260) -> tuple[Column, Column]:
    """(tier, score): exact terms in the head, else 2 near terms, else 3 occurrences of broad ones, else mismatch."""
    start = F.lower(F.substring(text, 1, head))
    hits = lambda terms: sum((F.contains(start, F.lit(t)).cast("int") for t in terms), F.lit(0))
    n = occurrences(F.lower(text), broad)
    tier = F.when(hits(exact) >= 1, "exact").when(hits(near) >= 2, "near").when(n >= 3, "broad").otherwise("mismatch")
    return tier, (hits(exact) * 10 + hits(near) * 5 + F.least(n, F.lit(20))).cast("long")


def excerpt(text: Column, target: int = 130, low: int = 45, high: int = 180) -> Column:
    """The sentence of low to high characters without white space whose length is nearest to target, else the start;
    over 160 characters are cut to 158 and an ellipsis."""
    bare = F.regexp_replace(text, r"\s+", "")
    some = F.filter(F.split(bare, r"(?<=[.!?。！？])"), lambda s: F.length(s).between(low, high))
    ranked = F.array_sort(F.transform(some, lambda s, i: F.struct(F.abs(F.length(s) - target).alias("d"), i.alias("i"), s.alias("s"))))
    out = F.when(F.size(ranked) > 0, ranked[0]["s"]).otherwise(F.substring(bare, 1, target))
    return F.when(F.length(out) > 160, F.concat(F.substring(out, 1, 158), F.lit("……"))).otherwise(out)


def effect_label(g: Column) -> Column:
    return F.when(F.abs(g) < 0.2, "negligible").when(F.abs(g) < 0.5, "small").when(F.abs(g) < 0.8, "medium").otherwise("large")


def exclusion_reason(country: Column, regions: list[str]) -> Column:
    return F.when(F.coalesce(F.trim(country), F.lit("")) == "", "missing").when(country.isin(regions), country).when(country.contains("少数民族") | country.endswith("族"), "minority")


#: The line that tells a text's number, and lines of bracketed codes at its end.
META, FOOTER = r"^\s*\d{6,7}[^。\n]{0,80}\.\d+.*$", r"^([（(][A-Za-z0-9]+[）)]\s*)+$"


def body_lines(text: Column) -> Column:
    """Text without its first meta line, lines that begin with "title", and lines of codes; blank lines are empty."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    meta = F.array_position(F.transform(lines, lambda x: x.rlike(META)), True)
    bare = F.transform(lines, lambda x, i: F.struct(x.alias("x"), F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).alias("t"), (i + 1 == meta).alias("meta")))
    kept = F.filter(bare, lambda x: (x["t"] == "") | ~(x["meta"] | F.lower(x["t"]).startswith("title") | x["t"].rlike(FOOTER)))
    return F.array_join(F.transform(kept, lambda x: F.when(x["t"] == "", "").otherwise(x["x"])), "\n")


def absolute_url(url: Column, own: str = "example.com") -> Column:
    """As `normalize_url`, and paths belong to the own host."""
    bare = F.trim(url)
    return F.when(bare.startswith("/"), F.concat(F.lit(f"https://www.{own}"), bare)).otherwise(normalize_url(bare, own))


def is_article_url(url: Column, own: str = "example.com", pattern: str = r"/\d{3,}") -> Column:
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))
    return host.isin(own, f"www.{own}") & F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1).rlike(pattern)


def source_label(value: Column, markers: list[str]) -> Column:
    """White space collapsed, a leading "source:" taken off, cut before each marker in turn, separators at the end off."""
    out = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    out = F.regexp_replace(out, r"(?i)^(来源|source)[:：]\s*", "")
    for m in markers:
        out = F.trim(F.substring_index(out, m, 1))
    return F.trim(F.regexp_replace(out, r"(?U)[|｜/\s]+$", ""))


def nominal_length(title: Column) -> Column:
    return F.regexp_extract(title, r"_(\d{2,4})字", 1).try_cast("int")


def clean_body(text: Column, title: Column, boilerplate: list[str], dropped: list[str], tail: str) -> Column:
    """Lines of a page's body: white space collapsed, the title's line gone, patterns of `boilerplate` taken out of each,
    lines that match one of `dropped` gone, lines at the end that match `tail` (with blank ones after them) gone, blank
    lines collapsed. Null stays null."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "[ \t　]+", " ")))
    lines = F.filter(lines, lambda x: (x == "") | (base_title(x) != base_title(title)) | (base_title(x) == ""))

    def without(x: Column) -> Column:
        for p in boilerplate:
            x = F.trim(F.regexp_replace(x, p, ""))
        return x

    cleaned = F.transform(lines, lambda x: F.struct((x == "").alias("blank"), without(x).alias("x")))
    kept = F.filter(cleaned, lambda x: x["blank"] | ((x["x"] != "") & ~_any(x["x"], dropped)))
    joined = F.array_join(F.transform(kept, lambda x: x["x"]), "\n")
    ended = F.regexp_replace(joined, rf"(?m)(\n*^({tail})$\n*)+\z", "") if tail else joined
    return F.trim(F.regexp_replace(F.regexp_replace(ended, r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""))


def _any(x: Column, patterns: list[str]) -> Column:
    return x.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def level_parts(level: Column) -> Column:
    """`4（5）` → main 4, extra 5 (several joined by |), group elementary (1 to 3), middle (4 to 6), advanced (7-9) or
    other; null where the text has another form."""
    ok = level.rlike(r"^([^（）]+)((（[^（）]+）)*)$")
    main = F.regexp_extract(level, r"^([^（）]+)", 1)
    group = F.when(main.isin("1", "2", "3"), "elementary").when(main.isin("4", "5", "6"), "middle").when(main == "7-9", "advanced").otherwise("other")
    return F.when(ok, F.struct(main.alias("main"), F.array_join(F.regexp_extract_all(level, F.lit("（([^）]+)）"), F.lit(1)), "|").alias("extra"), group.alias("group")))


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, "<.001").otherwise(F.regexp_replace(F.format_number(p, 3), "^0", ""))


def whole_score(score: Column) -> Column:
    """A score as a whole number, null where it is none."""
    d = F.trim(score.cast("string")).try_cast("double")
    return F.when(d == F.floor(d), d.cast("int"))


def stratum_score(score: Column, strata: list[int]) -> Column:
    """A score that must be a whole number and one of the strata; any other one, and a missing one, is an error."""
    whole = whole_score(score)
    return F.when(whole.isin(strata), whole).otherwise(F.raise_error(F.concat(F.lit("no stratum: "), F.coalesce(score.cast("string"), F.lit("missing")))).cast("int"))


def sheet_title(sheet: Column, code: Column) -> Column:
    """A sheet's name without the code and separators before it."""
    return F.when(sheet.startswith(code), F.trim(F.regexp_replace(F.substring(sheet, F.length(code) + 1, F.length(sheet)), r"^[\s_\-—:：]+", ""))).otherwise(F.trim(sheet))
