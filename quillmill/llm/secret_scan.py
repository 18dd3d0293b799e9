"""Secret scans with corpus-wide ownership frequency.

A pass over the texts finds base spans by three patterns, which are always reported, and further candidates: credentials
of known formats, and long opaque tokens. What is no use alone, since opaque tokens are everywhere, is told apart by who
holds them: hashes of the values are counted by distinct owners and distinct repositories of the whole corpus. A value that
several owners hold was copied from somewhere (a manual, a tutorial, a test key): an example. One that a single owner
holds and that looks random is that owner's live credential, in however many of their repositories and copies it stands.

Only hashes of values, never values or texts, are shuffled. Occurrences are first reduced to one row a hash and
owner, with their repositories, so a value in a third of all rows is a few rows when it is counted. The counts get back to
the spans by a join on the hash; hashes with over a thousandth of all occurrences (a thousand, at most, and HOT
occurrences at least) are broadcast instead, so no hot value is one task's work.

Defined results: a null text is empty; a null owner or repository is one of its own; spans are code points, end exclusive;
repeated rows each get a row, and copies of a text count by where they stand; texts of any length are scanned whole; an
empty table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.plans.scratch import materialize

#: Base patterns, by kind.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
#: Public formats of credentials, by kind, each with a word that its matches hold.
FORMATS = {
    "private_key": ("PRIVATE KEY-----", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,]|-(?!----))+-----END (?:[A-Z]+ )*PRIVATE KEY-----")),
    "jwt": ("eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}")),
    "github": ("gh", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,})")),
    "slack": ("xox", re.compile(r"\bxox[abeprs]-[A-Za-z0-9-]{16,}")),
    "google": ("AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35}")),
    "stripe": ("k_live_", re.compile(r"\b[rs]k_live_[A-Za-z0-9]{16,}")),
    "login": ("://", re.compile(r"(?<=://)[A-Za-z0-9_.~%+-]+:[^\s/@:\"'<>]{6,}(?=@[A-Za-z0-9])")),
}
OPAQUE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
PARTS = re.compile(r"[A-Za-z0-9+]+")
#: Words of values that stand for a secret to be filled in.
PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|changeme|change_me|redacted|your[-_]?|xxxx|\*\*\*\*|0000000|1234567|abcdefg|foobar|insert", re.I | re.A)
#: Kinds in the order in which spans of one start are told.
KINDS = ["assign", "access", "hex", *FORMATS, "opaque"]
#: Occurrences below which no hash is hot.
HOT = 10_000
SPAN = "struct<start: long, end: long, kind: string, base: boolean, live: boolean, hash: string>"


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    """Whether a value could be a generated one: no placeholder, and as varied as random characters are."""
    return len(value) >= 8 and not PLACEHOLDER.search(value) and entropy(value) >= min(3.0, 0.7 * math.log2(len(value)))


def looks_opaque(value: str) -> bool:
    """Whether a run of characters holds a generated token: 16 characters together, with digits and letters of both cases,
    and near to random."""
    if entropy(value) < 3.7:
        return False
    for part in PARTS.findall(value):
        if len(part) >= 16 and any(c.isdigit() for c in part) and any(c.islower() for c in part) and any(c.isupper() for c in part):
            return True
    return False


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base patterns: per kind leftmost and non-overlapping, too short ones dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if LONG_HEX.search(text):
        out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return out


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if starts and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def candidates(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Further spans that overlap neither a base span nor one another; formats go before opaque tokens."""
    out: list[tuple[int, int, str, str]] = []
    starts, ends = _merged([(a, b) for a, b, *_ in taken])

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)  # the last of those before i begins before b
        return i == 0 or ends[i - 1] <= a

    for kind, (word, pattern) in FORMATS.items():
        if word in text and (found := [m for m in pattern.finditer(text) if free(*m.span())]):
            out += [(*m.span(), kind, "".join(m[0].split())) for m in found]
            starts, ends = _merged([*zip(starts, ends), *(m.span() for m in found)])
    return out + [(*m.span(), "opaque", m[0]) for m in OPAQUE.finditer(text) if looks_opaque(m[0]) and free(*m.span())]


def detect(text: str) -> list[dict]:
    base = base_spans(text)
    found = [(*s, True) for s in base] + [(*s, False) for s in candidates(text, base)]
    digest = lambda v: hashlib.blake2b(v.encode(), digest_size=16).hexdigest()
    return [{"start": a, "end": b, "kind": k, "base": is_base, "live": looks_live(v), "hash": digest(v)} for a, b, k, v, is_base in sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))]


def find_spans(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """docs (doc_id, text) → doc_id, owner, repository, spans: one pass, whole texts."""
    rows = docs.select("doc_id", owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("live", pa.bool_()), ("hash", pa.string())]))
        for b in batches:
            yield pa.record_batch([*b.columns[:3], pa.array([detect(t or "") for t in b.column(3).to_pylist()], kind)], names=["doc_id", "owner", "repository", "spans"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, owner string, repository string, spans array<{SPAN}>")


def ownership(found: DataFrame) -> DataFrame:
    """find_spans' rows → hash, places (occurrences), owners, repositories (of all owners): one row for each value."""
    cells = found.select("owner", "repository", F.explode("spans.hash").alias("hash"))
    held = cells.groupBy("hash", "owner", "repository").agg(F.count("*").alias("places"))
    held = held.groupBy("hash", "owner").agg(F.sum("places").alias("places"), F.count("*").alias("repositories"))
    return held.groupBy("hash").agg(F.sum("places").alias("places"), F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def scan(docs: DataFrame, owner: Column, repository: Column, wide: int = 3) -> DataFrame:
    """docs (doc_id, text, and what owner and repository read) → doc_id, spans: start, end, kind, base, owners, repositories,
    class and reported, by start, then by kind.

    class: `example` where `wide` owners hold the value, or two owners in `2 * wide` repositories; `live` where one owner
    holds it and it looks generated; else `unclear`. Reported are base spans, known formats that are no examples, and opaque
    tokens that are live.
    """
    found = materialize(find_spans(docs, owner, repository).withColumn("row", F.monotonically_increasing_id()), "secret-spans")  # written once, so that a row keeps its number
    counts = materialize(ownership(found), "secret-counts")
    least = max(HOT, (counts.agg(F.sum("places")).first()[0] or 0) // 1000)
    hot = counts.where(F.col("places") > least)  # fewer than a thousand
    cells = found.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s.*")
    known = cells.join(F.broadcast(hot), "hash")
    rest = cells.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(counts.where(F.col("places") <= least), "hash")
    told = known.unionByName(rest)
    example = (F.col("owners") >= wide) | ((F.col("owners") > 1) & (F.col("repositories") >= 2 * wide))
    sort = F.when(example, "example").when((F.col("owners") == 1) & F.col("live"), "live").otherwise("unclear")
    told = told.withColumn("class", sort)
    reported = F.col("base") | F.when(F.col("kind") == "opaque", F.col("class") == "live").otherwise((F.col("class") != "example") & F.col("live"))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", place.alias("place"), "end", "kind", "base", "owners", "repositories", "class", reported.alias("reported"))
    spans = told.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("told"))
    kept = F.transform("told", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "kind", "base", "owners", "repositories", "class", "reported")]))
    held = found.where(F.size("spans") > 0).select("row", "doc_id").join(spans, "row").select("doc_id", kept.alias("spans"))
    none = found.where(F.size("spans") == 0).select("doc_id", F.array().cast(held.schema["spans"].dataType).alias("spans"))
    return held.unionByName(none)


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The table tells a document's source and language: the source is its owner, and what a source holds in one language
    a repository of that owner."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, F.col("source"), F.col("lang"))
    base, reported = F.filter("spans", lambda s: s["base"]), F.filter("spans", lambda s: s["reported"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda c, v: F.size(F.filter("spans", lambda s: s["reported"] & (s[c] == v))).cast("long")
    return found.select("doc_id", *[count("kind", k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(text(base), 256).alias("base_sha256"), text(reported).alias("spans"), *[count("class", c).alias(f"n_{c}") for c in ("live", "example")])
