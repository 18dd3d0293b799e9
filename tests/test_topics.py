import random
import re

from quillmill.operators.topics import Rule, best_topics, topics


def occurrences(text, terms):
    taken = []
    for t in sorted(set(terms), key=lambda t: (-len(t), t)):
        for m in re.finditer(re.escape(t), text):
            if all(m.end() <= a or b <= m.start() for a, b in taken):
                taken.append(m.span())
    return len(taken)


def plainly(text, r, head):
    """The surveyed rule, set by set."""
    squeeze = lambda s: "".join(s.split())
    title, line, body = text.partition("\n")
    focus, whole, title = squeeze(title + body[:head]) if line else squeeze(text), squeeze(text), squeeze(title)
    n = {s: sum(t in focus for t in getattr(r, s)) for s in ("exact", "near", "extended", "broad", "context")}
    at = {s: any(t in title for t in getattr(r, s)) for s in n}
    topic, context, broad = occurrences(whole, [*r.exact, *r.near, *r.extended]), occurrences(whole, r.context), occurrences(whole, r.broad)
    if n["exact"] and (at["exact"] or topic >= 2) and (n["context"] or r.bare):
        return "exact", 100 + 8 * n["exact"] + n["context"] + min(topic, 8)
    if n["near"] and (at["near"] or topic >= 3) and (n["context"] or n["extended"]):
        return "near", 70 + 6 * n["near"] + n["context"] + min(n["extended"], 4) + min(topic, 8)
    if n["extended"] and (at["extended"] or topic >= 3) and (n["context"] >= 2 or at["extended"] and context >= 2):
        return "extended", 40 + 3 * min(n["extended"], 5) + n["context"] + min(topic, 8) + min(context, 5)
    if n["broad"] and (at["broad"] or broad >= 3) and (n["context"] >= 2 or at["broad"] and context >= 2):
        return "broad", 20 + 2 * min(n["broad"], 5) + n["context"] + min(broad, 8) + min(context, 5)
    return "mismatch", 8 * n["exact"] + 5 * n["near"] + n["extended"] + n["broad"] + n["context"]


def test_all_rules_equal_the_plain_rule(spark):
    rng = random.Random(3)
    piece = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = lambda n: tuple(piece(rng.randint(2, 5)) for _ in range(rng.randint(0, n)))
    rules = [Rule(f"r{i}", terms(2), terms(3), terms(6), terms(6), terms(4), i % 3 == 0) for i in range(8)] + [Rule("none"), Rule("aa", ("aa", "aa"), ("aab",), (), (), ("ba",))]
    texts = ["".join(rng.choice("abcxyz  \n\t") for _ in range(rng.choice([5, 30, 120]))) for _ in range(120)] + ["", "\n", "aaaaa", "no line " * 50, "t\n" + "ab c" * 5000]
    df = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string")
    got = {(r.doc_id, r.code): (r.tier, r.score) for r in topics(df, rules, head=20).collect()}
    want = {(i, r.code): plainly(t or "", r, 20) for i, t in [*enumerate(texts), (900, "")] for r in rules}
    assert got == want and {t for t, _ in got.values()} == {"exact", "near", "extended", "broad", "mismatch"}
    best = {r.doc_id: (r.code, r.tier, r.score) for r in best_topics(topics(df, rules, head=20)).collect()}
    order = ["exact", "near", "extended", "broad"]
    for i in range(len(texts)):
        rows = sorted((order.index(t), -s, c) for (d, c), (t, s) in want.items() if d == i and t != "mismatch")
        assert best.get(i) == ((rows[0][2], order[rows[0][0]], -rows[0][1]) if rows else None)
    assert topics(df.limit(0), rules).count() == 0 and topics(df, []).count() == 0
