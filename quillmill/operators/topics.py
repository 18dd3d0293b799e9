"""Topics of texts by rules of five term sets, all rules in one pass.

One automaton over the terms of all rules reads each text once, without white space. Where a term first ends tells whether
the title or the head holds it; all its places, the longest terms first and the leftmost, without overlap, are its set's
occurrences. A text takes a row for each rule; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = re.compile(r"\s+")
#: Occurrences in the whole text that stand for a term in the title, by tier; scores' bases, what a term of
#: the tier adds, how many of them count at most, and how many occurrences and context occurrences do.
LEAST = {"exact": 2, "near": 3, "extended": 3, "broad": 3}
BASE = {"exact": 100, "near": 70, "extended": 40, "broad": 20}
EACH = {"exact": 8, "near": 6, "extended": 3, "broad": 2}
MOST_TERMS, MOST_EXTENDED, MOST_OCCURRENCES, MOST_CONTEXT = 5, 4, 8, 5
#: What a term of each set adds to the score of a mismatch.
MISMATCH = {"exact": 8, "near": 5, "extended": 1, "broad": 1, "context": 1}
SETS = ("exact", "near", "extended", "broad", "context")


@dataclass(frozen=True)
class Rule:
    """`bare`: exact terms count without any context."""

    code: str
    exact: Sequence[str] = ()
    near: Sequence[str] = ()
    extended: Sequence[str] = ()
    broad: Sequence[str] = ()
    context: Sequence[str] = ()
    bare: bool = False


def apart(places: dict[str, list[int]], terms: set[str]) -> int:
    """Occurrences of the terms without overlap: longer terms first, each from the left."""
    starts: list[int] = []  # of what is taken, in order, and the ends by start
    ends: dict[int, int] = {}
    for t in sorted(terms & places.keys(), key=lambda t: (-len(t), t)):
        free = 0
        for a in places[t]:
            if a < free:
                continue
            free = a + len(t)
            i = bisect_left(starts, free)
            if i == 0 or ends[starts[i - 1]] <= a:
                insort(starts, a)
                ends[a] = free
    return len(starts)


def read(text: str, machine, head: int) -> tuple[dict[str, list[int]], int, int]:
    """Places of every term in the text without white space, and where its title and its head end there. The title is the
    first line, the head that and `head` characters more; a text of one line is all title."""
    title, line, body = text.partition("\n")
    size = len(SPACE.sub("", title))
    bare = SPACE.sub("", text)
    end = size + len(SPACE.sub("", body[:head])) if line else len(bare)
    places: dict[str, list[int]] = {}
    for last, t in machine.iter(bare):
        places.setdefault(t, []).append(last + 1 - len(t))
    return places, size if line else len(bare), end


def classify(rule: Rule, places: dict[str, list[int]], title: int, head: int) -> tuple[str, int]:
    """(tier, score) of a text by one rule."""
    first = lambda t: places[t][0] + len(t) if t in places else None
    within = lambda name, end: sum(f is not None and f <= end for f in map(first, getattr(rule, name)))
    hits = {s: within(s, head) for s in SETS}
    if not any(hits.values()):
        return "mismatch", 0
    named = {s: within(s, title) > 0 for s in LEAST}
    topic = apart(places, {*rule.exact, *rule.near, *rule.extended})
    times = {"exact": topic, "near": topic, "extended": topic, "broad": apart(places, set(rule.broad))}
    around = apart(places, set(rule.context))
    rich = lambda s: hits["context"] >= 2 or (named[s] and around >= 2)
    told = {"exact": hits["context"] > 0 or rule.bare, "near": hits["context"] > 0 or hits["extended"] > 0, "extended": rich("extended"), "broad": rich("broad")}
    for s in LEAST:
        if hits[s] and (named[s] or times[s] >= LEAST[s]) and told[s]:
            score = BASE[s] + EACH[s] * (hits[s] if s in ("exact", "near") else min(hits[s], MOST_TERMS)) + hits["context"] + min(times[s], MOST_OCCURRENCES)
            if s == "near":
                score += min(hits["extended"], MOST_EXTENDED)
            if s in ("extended", "broad"):
                score += min(around, MOST_CONTEXT)
            return s, score
    return "mismatch", sum(MISMATCH[s] * hits[s] for s in SETS)


def topics(docs: DataFrame, rules: Sequence[Rule], head: int = 260) -> DataFrame:
    """docs (doc_id, text) → doc_id, code, tier (exact, near, extended, broad, mismatch), score: a row for each text and rule;
    a null text is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    terms = sorted({t for r in rules for s in SETS for t in getattr(r, s)})
    if any(not t or SPACE.search(t) for t in terms):
        raise ValueError("terms are not empty and hold no white space")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for t in terms:
            machine.add_word(t, t)
        machine.make_automaton()
        for b in batches:
            found = []
            for text in b.column(1).to_pylist():
                read_ = read(text or "", machine, head) if terms else ({}, 0, 0)
                found += [(r.code, *classify(r, *read_)) for r in rules]
            ids = b.column(0).take(pa.array([i for i in range(b.num_rows) for _ in rules], pa.int64()))
            columns = list(zip(*found)) or [()] * 3
            yield pa.record_batch([ids, *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))]], names=["doc_id", "code", "tier", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, code string, tier string, score long")


def best_topics(found: DataFrame) -> DataFrame:
    """`topics` → each text's best rule: the highest tier, then score, then the smaller code; none that mismatches."""
    from pyspark.sql import functions as F

    order = F.array_position(F.array(*map(F.lit, LEAST)), F.col("tier"))
    return found.where("tier <> 'mismatch'").groupBy("doc_id").agg(F.min_by(F.struct("code", "tier", "score"), F.struct(order, -F.col("score"), "code")).alias("m")).select("doc_id", "m.*")
