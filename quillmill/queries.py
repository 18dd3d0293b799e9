"""Registered queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import correlation, dedup, factors, linguistic, matching, reports, selection, similarity, statistics, topics, validation
from quillmill.operators.topics import Rule
from quillmill.plans.scratch import materialize

FEATURES = ["rate_a", "rate_n", "rate_u", "rate_v", "rate_wd", "rate_wj", "ttr", "guiraud", "top10_share", "mean_length", "mattr"]
RELATIONS = [("cause", "car"), ("cause", "denn"), ("addition", "and"), ("addition", "und"), ("addition", "et"), ("addition", "y"), ("contrast", "that"), ("contrast", "mais")]
IDIOMS = [("both", "the", "of"), ("chain", "of", "and"), ("pair", "la", "de"), ("case", "der", "und")]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
VOCABULARY = [("the", 1, None), ("of", 1, None), ("and", 1, None), ("der", 1, None), ("que", 2, None), ("la", 2, None), ("de", 1, "u"), ("de", 2, "n"), ("ering", 3, None), ("that", 2, None), ("with", 2, "n"), ("with", 3, "v"), ("thing", 3, None)]
LEXICON = [("cohesion", "and"), ("cohesion", "of the"), ("cohesion", "the"), ("cohesion", "the of the"), ("stance", "that"), ("stance", "it was"), ("stance", "was"), ("stance", "de la"), ("stance", "la")]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as sampling rows: segment is the code, nation the country, the balance's thousand the score."""
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return c.select("c_custkey", F.col("c_mktsegment").alias("code"), F.col("n_name").alias("country"), F.floor(F.col("c_acctbal") / 1000).cast("int").alias("score"), "c_acctbal")


SEGMENTS = "SELECT c_custkey, c_mktsegment AS code, n_name AS country, CAST(floor(c_acctbal / 1000) AS INTEGER) AS score, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey"
TOK = r"""tok AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS tok_idx, lower(unnest(l)) AS word
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\p{L}+|[^\p{L}\s]') AS l FROM documents))"""
TAG = r"""CASE WHEN regexp_matches(word, '^[.!?。！？]$') THEN 'wj' WHEN NOT regexp_matches(word, '^\p{L}') THEN CASE WHEN regexp_matches(word, '^\p{N}$') THEN 'm' ELSE 'wd' END
  WHEN length(word) <= 3 THEN 'u' WHEN regexp_matches(word, '(ing|ed|er|en|ir)$') THEN 'v' WHEN regexp_matches(word, '(ly|ble|ous|lich|eux)$') THEN 'a' ELSE 'n' END"""
PARTS = r"""part AS (SELECT doc_id, generate_subscripts(l, 1) AS p, unnest(l) AS line FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\n'), lambda x: trim(x) <> '') AS l FROM documents)),
  tok AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) - 1 AS tok_idx, word FROM (SELECT doc_id, p, generate_subscripts(l, 1) AS k, lower(unnest(l)) AS word FROM (SELECT doc_id, p, regexp_extract_all(line, '\p{L}+|[^\p{L}\s]') AS l FROM part)))"""
TAGGED = f"{TOK}, t AS (SELECT *, {TAG} AS tag FROM tok)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("lexical_diversity", rf"""WITH {TOK}, w AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY tok_idx) - 1 AS j, count(*) OVER (PARTITION BY doc_id) AS n FROM tok WHERE regexp_matches(word, '^\p{{L}}')),
p AS (SELECT *, least(50, n) AS w, coalesce(lag(j) OVER (PARTITION BY doc_id, word ORDER BY j), -1) AS p FROM w),
f AS (SELECT doc_id, word, count(*) AS c, sum(greatest(0, least(j, n - w) - greatest(0, j - w + 1, p + 1) + 1)) AS firsts FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, word) AS r FROM f),
g AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS tokens, count(*) AS types, CAST(sum(CAST(c = 1 AS INT)) AS BIGINT) AS hapax, sum(CASE WHEN r <= 10 THEN c ELSE 0 END) AS top10, sum(c * length(word)) AS letters, sum(firsts) AS firsts FROM r GROUP BY doc_id)
SELECT doc_id, tokens, types, hapax, round(types / tokens, 6) AS ttr, round(types / sqrt(tokens), 6) AS guiraud, round(top10 / tokens, 6) AS top10_share, round(letters / tokens, 6) AS mean_length,
round(firsts / (least(50, tokens) * (tokens - least(50, tokens) + 1)), 6) AS mattr FROM g""")  # fmt: skip
def _(spark, sf):
    return linguistic.lexical_diversity(table(spark, sf, "documents"))


@query("sentence_structure", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?。！？]+'), lambda x: len(regexp_extract_all(x, '\p{L}'))), lambda n: n > 0) AS s,
len(list_filter(regexp_split_to_array(coalesce(text, ''), '[,，;；:：.!?。！？]+'), lambda x: regexp_matches(x, '\p{L}'))) AS clauses, len(regexp_extract_all(coalesce(text, ''), '[,，]')) AS commas FROM documents)
SELECT doc_id, clauses, commas, len(s) AS sentences, round(coalesce(list_avg(s), 0), 6) AS mean_length, round(coalesce(list_aggregate(s, 'quantile_cont', 0.5), 0), 6) AS median_length, round(coalesce(list_aggregate(s, 'stddev_pop'), 0), 6) AS sd_length,
CAST(coalesce(list_max(s), 0) AS BIGINT) AS longest, round(CASE WHEN len(s) = 0 THEN 0 ELSE len(list_filter(s, lambda n: n > 30)) / len(s) END, 6) AS long_share, round(CASE WHEN len(s) = 0 THEN 0 ELSE clauses / len(s) END, 6) AS clauses_per_sentence FROM s""")  # fmt: skip
def _(spark, sf):
    return linguistic.sentence_structure(table(spark, sf, "documents"))


@query("tag_counts", rf"""WITH {TAGGED}, g AS (SELECT doc_id, CAST(sum(CASE WHEN regexp_matches(word, '^\p{{L}}') THEN length(word) ELSE 0 END) AS BIGINT) AS letters, {', '.join(f"CAST(sum(CAST(tag = '{x}' AS INT)) AS BIGINT) AS n_{x}" for x in linguistic.TAGS)} FROM t GROUP BY doc_id)
SELECT *, {', '.join(f'round(CASE WHEN letters = 0 THEN 0 ELSE n_{x} * 1000 / letters END, 6) AS rate_{x}' for x in linguistic.TAGS)} FROM g""")  # fmt: skip
def _(spark, sf):
    return linguistic.tag_counts(table(spark, sf, "documents"))


@query("verb_runs", f"""WITH {TAGGED}, v AS (SELECT doc_id, tok_idx - row_number() OVER (PARTITION BY doc_id ORDER BY tok_idx) AS island FROM t WHERE tag = 'v'), r AS (SELECT doc_id, island, count(*) AS c FROM v GROUP BY ALL)
SELECT doc_id, CAST(sum(CAST(c >= 2 AS INT)) AS BIGINT) AS runs, max(c) AS longest_run FROM r GROUP BY doc_id""")  # fmt: skip
def _(spark, sf):
    return linguistic.verb_runs(table(spark, sf, "documents"))


@query("adjective_before_verb", f"""WITH {PARTS}, t AS (SELECT *, {TAG} AS tag FROM tok), n AS (SELECT doc_id, tag, lead(tag) OVER (PARTITION BY doc_id, p ORDER BY tok_idx) AS nxt FROM t)
SELECT doc_id, CAST(coalesce(sum(CASE WHEN tag = 'a' THEN CASE WHEN nxt = 'v' THEN 1 WHEN nxt IS NULL THEN NULL ELSE 0 END ELSE 0 END), 0) AS BIGINT) AS adjective_verb FROM n GROUP BY doc_id""")  # fmt: skip
def _(spark, sf):
    return linguistic.adjective_before_verb(table(spark, sf, "documents"))


@query("sentence_classes", rf"""WITH {TAGGED}, s AS (SELECT *, coalesce(sum(CAST(tag = 'wj' AS INT)) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM t),
f AS (SELECT doc_id, sentence, bool_or(word IN ('?', '？')) AS q, bool_or(word IN ('!', '！')) AS e FROM s GROUP BY ALL HAVING bool_or(regexp_matches(word, '^\p{{L}}')))
SELECT doc_id, count(*) AS sentences, CAST(sum(CAST(q AS INT)) AS BIGINT) AS questions, CAST(sum(CAST(NOT q AND e AS INT)) AS BIGINT) AS exclamations FROM f GROUP BY doc_id""")  # fmt: skip
def _(spark, sf):
    return linguistic.sentence_classes(table(spark, sf, "documents")).select("doc_id", "sentences", "questions", "exclamations")


_VOC = ", ".join(f"('{w}', {k}, {'NULL' if t is None else repr(t)})" for w, k, t in VOCABULARY)


@query("vocabulary_levels", rf"""WITH {TAGGED}, v(word, level, vtag) AS (VALUES {_VOC}), e AS (SELECT word, min(level) AS low, count(DISTINCT level) AS levels FROM v GROUP BY word),
m AS (SELECT t.doc_id, t.tok_idx, t.word, e.low, e.levels, count(DISTINCT v.level) AS fits, min(v.level) AS fit FROM t LEFT JOIN e ON t.word = e.word LEFT JOIN v ON v.word = t.word AND v.vtag = t.tag WHERE regexp_matches(t.word, '^\p{{L}}') GROUP BY ALL),
l AS (SELECT *, CASE WHEN levels = 1 THEN low WHEN fits = 1 THEN fit ELSE low END AS level FROM m)
SELECT doc_id, count(*) AS words, {', '.join(f'count(*) FILTER (level = {k}) AS level_{k}' for k in (1, 2, 3))}, count(DISTINCT word) FILTER (level IS NOT NULL) AS known_types, round(count(level) / count(*), 6) AS coverage FROM l GROUP BY doc_id""")  # fmt: skip
def _(spark, sf):
    return linguistic.vocabulary_levels(table(spark, sf, "documents"), spark.createDataFrame(VOCABULARY, "word string, level int, tag string"))


_LEX = ", ".join(f"('{f}', '{t}')" for f, t in LEXICON)


@query("lexicon_features", rf"""WITH {PARTS}, g AS (SELECT doc_id, tok_idx, word AS a, lead(word, 1) OVER w AS b, lead(word, 2) OVER w AS c FROM tok WINDOW w AS (PARTITION BY doc_id, p ORDER BY tok_idx)),
n AS (SELECT doc_id, tok_idx, 1 AS n, a AS term FROM g UNION ALL SELECT doc_id, tok_idx, 2, a || ' ' || b FROM g WHERE b IS NOT NULL UNION ALL SELECT doc_id, tok_idx, 3, a || ' ' || b || ' ' || c FROM g WHERE c IS NOT NULL),
l(feature, term) AS (VALUES {_LEX}), h AS (SELECT doc_id, feature, tok_idx AS s, max(tok_idx + n.n) AS e, arg_max(n.term, n.n) AS term FROM n JOIN l ON l.term = n.term GROUP BY ALL),
f AS (SELECT doc_id, feature, list_reduce(list({{'s': s, 'e': e, 'n': 1, 't': [term]}} ORDER BY s), lambda a, x: CASE WHEN x.s >= a.e THEN {{'s': x.s, 'e': x.e, 'n': a.n + 1, 't': list_append(a.t, x.t[1])}} ELSE a END) AS m FROM h GROUP BY ALL)
SELECT doc_id, feature, CAST(m.n AS BIGINT) AS matches, len(list_distinct(m.t)) AS terms FROM f""")
def _(spark, sf):
    return linguistic.lexicon_features(linguistic.lexicon_spans(table(spark, sf, "documents"), spark.createDataFrame(LEXICON, "feature string, term string")))


@query("terms_in_corpus", """WITH t AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS term FROM benchmark) SELECT term FROM t WHERE length(term) >= 3 AND EXISTS (SELECT 1 FROM documents WHERE contains(text, term))""")
def _(spark, sf):
    terms = table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("term")).distinct()
    return linguistic.terms_in_corpus(table(spark, sf, "documents"), terms)


@query("text_scalars", r"""SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[ \t\n\r\f]', '', 'g')) AS chars, len(regexp_extract_all(coalesce(text, ''), '\p{L}')) AS letters,
len(regexp_extract_all(coalesce(text, ''), '“[^”]*”')) + len(regexp_extract_all(coalesce(text, ''), '「[^」]*」')) + len(regexp_extract_all(coalesce(text, ''), '『[^』]*』')) + len(regexp_extract_all(coalesce(text, ''), '"[^"' || chr(10) || ']*"')) AS quotes,
length(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), 'then', chr(1), 'g'), 'and', chr(1), 'g'), 'the', chr(1), 'g')) - length(replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), 'then', chr(1), 'g'), 'and', chr(1), 'g'), 'the', chr(1), 'g'), chr(1), '')) AS hits FROM documents""")  # fmt: skip
def _(spark, sf):
    return linguistic.scalars(table(spark, sf, "documents"))


@query("topic_tiers", """WITH h AS (SELECT doc_id, lower(coalesce(text, '')) AS t, lower(substring(coalesce(text, ''), 1, 260)) AS s FROM documents),
c AS (SELECT doc_id, CAST(contains(s, 'water') AS INT) + CAST(contains(s, 'thing') AS INT) AS e, CAST(contains(s, 'ther') AS INT) + CAST(contains(s, 'ing') AS INT) + CAST(contains(s, 'tion') AS INT) AS n, len(regexp_extract_all(t, 'ment')) AS b FROM h)
SELECT doc_id, CASE WHEN e >= 1 THEN 'exact' WHEN n >= 2 THEN 'near' WHEN b >= 3 THEN 'broad' ELSE 'mismatch' END AS tier, CAST(e * 10 + n * 5 + least(b, 20) AS BIGINT) AS score FROM c""")
def _(spark, sf):
    tier, score = T.topic_tier(F.coalesce("text", F.lit("")), ["water", "thing"], ["ther", "ing", "tion"], ["ment"])
    return table(spark, sf, "documents").select("doc_id", tier.alias("tier"), score.alias("score"))


#: Term sets over the documents' words; none overlaps itself, so SQL can count occurrences by replacing the longest first.
RULES = [
    Rule("r1", ("water", "thing"), ("ther", "tion"), ("ment", "ing"), ("schen", "ble"), ("the", "and")),
    Rule("r2", ("ción", "lich"), ("que", "der"), ("los", "und", "von"), ("ver", "ión"), ("de", "la"), True),
    Rule("r3", ("wherever",), ("nowhere",), ("eaux", "lement", "oi"), ("pour", "dans", "ou"), ("les", "est", "que")),
]


def _rule_sql(r: Rule) -> str:
    hits = lambda s, where: "(" + (" + ".join(f"CAST(contains({where}, '{t}') AS INT)" for t in getattr(r, s)) or "0") + ")"

    def times(*sets: str) -> str:
        x = "w"
        for t in sorted({t for s in sets for t in getattr(r, s)}, key=lambda t: (-len(t), t)):
            x = f"replace({x}, '{t}', chr(1))"
        return f"(length({x}) - length(replace({x}, chr(1), '')))"

    cols = ", ".join(f"{hits(s, 'f')} AS n_{s}, {hits(s, 't')} > 0 AS at_{s}" for s in ("exact", "near", "extended", "broad", "context"))
    return f"""SELECT doc_id, '{r.code}' AS code, tier, CAST(CASE tier WHEN 'exact' THEN 100 + 8 * n_exact + n_context + least(k, 8) WHEN 'near' THEN 70 + 6 * n_near + n_context + least(n_extended, 4) + least(k, 8)
  WHEN 'extended' THEN 40 + 3 * least(n_extended, 5) + n_context + least(k, 8) + least(c, 5) WHEN 'broad' THEN 20 + 2 * least(n_broad, 5) + n_context + least(b, 8) + least(c, 5) ELSE 8 * n_exact + 5 * n_near + n_extended + n_broad + n_context END AS BIGINT) AS score
  FROM (SELECT *, CASE WHEN n_exact > 0 AND (at_exact OR k >= 2) AND (n_context > 0 OR {r.bare}) THEN 'exact' WHEN n_near > 0 AND (at_near OR k >= 3) AND (n_context > 0 OR n_extended > 0) THEN 'near'
    WHEN n_extended > 0 AND (at_extended OR k >= 3) AND (n_context >= 2 OR at_extended AND c >= 2) THEN 'extended' WHEN n_broad > 0 AND (at_broad OR b >= 3) AND (n_context >= 2 OR at_broad AND c >= 2) THEN 'broad' ELSE 'mismatch' END AS tier
    FROM (SELECT doc_id, {cols}, {times('exact', 'near', 'extended')} AS k, {times('context')} AS c, {times('broad')} AS b FROM s))"""


@query("topic_rules", r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, strpos(coalesce(text, ''), chr(10)) AS p FROM documents),
s AS (SELECT doc_id, regexp_replace(x, '\s+', '', 'g') AS w, regexp_replace(CASE WHEN p > 0 THEN substring(x, 1, p - 1) ELSE x END, '\s+', '', 'g') AS t, regexp_replace(CASE WHEN p > 0 THEN substring(x, 1, p - 1) || substring(x, p + 1, 260) ELSE x END, '\s+', '', 'g') AS f FROM d)
""" + " UNION ALL ".join(map(_rule_sql, RULES)))
def _(spark, sf):
    return topics.topics(table(spark, sf, "documents"), RULES)


@query("normalized_urls", r"""SELECT page_id, CASE WHEN trim(url) = '' THEN NULL WHEN h = 'example.com' OR h LIKE '%.example.com' THEN 'https://www.example.com' || CASE WHEN p = '' THEN '/' ELSE p END ELSE regexp_replace(url, '^http://', 'https://') END AS url
FROM (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS h, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS p FROM pages)""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_url(F.col("url")).alias("url"))


@query("page_titles", r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, lower(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[（(][一二三四五六七八九十\d]+[)）]$|[\s_-]*\d+$', ''), '[^\p{L}\p{N}]+', '', 'g')) AS base, CAST(coalesce(try_cast(nullif(regexp_extract(url, '/(\d{1,6})', 1), '') AS INTEGER), 9999) AS INTEGER) AS number FROM pages""")
def _(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf, "pages").select("page_id", title.alias("title"), T.base_title(title).alias("base"), F.coalesce(F.regexp_extract("url", r"/(\d{1,6})", 1).try_cast("int"), F.lit(9999)).alias("number"))


@query("near_duplicate_pairs", r"""WITH d AS (SELECT source, min(doc_id) AS id, b FROM (SELECT source, doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B　]+', '', 'g') AS b FROM documents) GROUP BY source, b),
g AS (SELECT DISTINCT source, id, g FROM (SELECT source, id, CASE WHEN length(b) <= 5 THEN b ELSE substring(b, CAST(i AS BIGINT), 5) END AS g FROM d, unnest(range(1, greatest(length(b) - 3, 2))) AS u(i))),
n AS (SELECT source, id, count(*) AS n FROM g GROUP BY ALL),
p AS (SELECT x.source, x.id AS a, y.id AS b, count(*) AS s FROM g x JOIN g y ON x.source = y.source AND x.g = y.g AND x.id < y.id GROUP BY ALL)
SELECT p.source, a, b, round(s / (na.n + nb.n - s), 6) AS jaccard FROM p JOIN n na ON na.source = p.source AND na.id = a JOIN n nb ON nb.source = p.source AND nb.id = b WHERE s / (na.n + nb.n - s) >= 0.85 - 1e-9""")
def _(spark, sf):
    return dedup.jaccard_pairs(table(spark, sf, "documents"), "source").withColumn("jaccard", F.round("jaccard", 6))


@query("near_families", r"""WITH RECURSIVE x AS (SELECT source, doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B　]+', '', 'g') AS b FROM documents), d AS (SELECT source, min(doc_id) AS id, b FROM x GROUP BY source, b),
g AS (SELECT DISTINCT source, id, g FROM (SELECT source, id, CASE WHEN length(b) <= 5 THEN b ELSE substring(b, CAST(i AS BIGINT), 5) END AS g FROM d, unnest(range(1, greatest(length(b) - 3, 2))) AS u(i))),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id), p AS (SELECT y.id AS a, z.id AS b, count(*) AS s FROM g y JOIN g z ON y.source = z.source AND y.g = z.g AND y.id < z.id GROUP BY ALL),
q AS (SELECT a, b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE s / (na.n + nb.n - s) >= 0.85 - 1e-9), w AS (SELECT a, b FROM q UNION ALL SELECT b, a FROM q),
r(id, root) AS (SELECT a, a FROM w UNION SELECT w.b, r.root FROM r JOIN w ON w.a = r.id), f AS (SELECT id, min(root) AS family FROM r GROUP BY id), l AS (SELECT a AS id, count(*) AS links FROM w GROUP BY a)
SELECT x.doc_id, d.id AS representative, coalesce(f.family, d.id) AS family, coalesce(l.links, 0) AS links FROM x JOIN d ON x.source IS NOT DISTINCT FROM d.source AND x.b = d.b LEFT JOIN f ON f.id = d.id LEFT JOIN l ON l.id = d.id""")
def _(spark, sf):
    return similarity.near_families(table(spark, sf, "documents"), "source")


#: Documents in the order of removal, one step each; `kept` is the list of the places kept so far.
@query("deduplicated", r"""WITH RECURSIVE x AS (SELECT source, doc_id, row_number() OVER (ORDER BY length(coalesce(text, '')) DESC, doc_id) AS rn, regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B　]+', '', 'g') AS b FROM documents),
d AS (SELECT source, min(doc_id) AS id, b FROM x GROUP BY source, b), x2 AS (SELECT x.source, x.doc_id, x.rn, d.id FROM x JOIN d ON d.source = x.source AND d.b = x.b),
g AS (SELECT DISTINCT source, id, g FROM (SELECT source, id, CASE WHEN length(b) <= 5 THEN b ELSE substring(b, CAST(i AS BIGINT), 5) END AS g FROM d, unnest(range(1, greatest(length(b) - 3, 2))) AS u(i))),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id), p AS (SELECT y.id AS a, z.id AS b, count(*) AS s FROM g y JOIN g z ON y.source = z.source AND y.g = z.g AND y.id < z.id GROUP BY ALL),
q AS (SELECT a, b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE s / (na.n + nb.n - s) >= 0.85 - 1e-9), w AS (SELECT a, b FROM q UNION ALL SELECT b, a FROM q),
h AS (SELECT y.rn, list(z.rn) AS same FROM x2 y JOIN x2 z ON z.id = y.id AND z.rn <> y.rn GROUP BY y.rn), m AS (SELECT y.rn, list(z.rn) AS near FROM x2 y JOIN w ON w.a = y.id JOIN x2 z ON z.id = w.b GROUP BY y.rn),
o AS (SELECT x2.doc_id, x2.rn, coalesce(same, []) AS same, coalesce(near, []) AS near FROM x2 LEFT JOIN h ON h.rn = x2.rn LEFT JOIN m ON m.rn = x2.rn),
r(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT i + 1, CASE WHEN len(list_intersect(kept, list_concat(same, near))) = 0 THEN list_append(kept, rn) ELSE kept END FROM r JOIN o ON o.rn = i + 1),
k AS (SELECT kept FROM r ORDER BY i DESC LIMIT 1), f AS (SELECT doc_id, list_contains(kept, rn) AS kept, list_min(list_filter(list_intersect(same, kept), lambda v: v < rn)) AS hs, list_min(list_filter(list_intersect(near, kept), lambda v: v < rn)) AS ns FROM o, k)
SELECT f.doc_id, f.kept, CASE WHEN f.kept THEN NULL WHEN hs IS NOT NULL THEN 'hash' ELSE 'near' END AS reason, CASE WHEN f.kept THEN NULL ELSE o.doc_id END AS winner FROM f LEFT JOIN o ON o.rn = coalesce(hs, ns)""")
def _(spark, sf):
    return dedup.deduplicate(table(spark, sf, "documents"))


@query("exclusion_reasons", "SELECT CASE WHEN coalesce(trim(n_name), '') = '' THEN 'missing' WHEN n_name IN ('CHINA', 'JAPAN') THEN n_name ELSE 'kept' END AS reason, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, sf):
    return segments(spark, sf).groupBy(F.coalesce(T.exclusion_reason(F.col("country"), ["CHINA", "JAPAN"]), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("equal_strata", f"WITH s AS ({SEGMENTS}), g AS (SELECT * FROM (SELECT DISTINCT score FROM s) CROSS JOIN (SELECT DISTINCT code FROM s)) SELECT score, min(n) AS n FROM (SELECT g.score, g.code, count(s.c_custkey) AS n FROM g LEFT JOIN s ON s.score = g.score AND s.code = g.code GROUP BY ALL) GROUP BY score")
def _(spark, sf):
    return selection.equal_sizes(segments(spark, sf), "score", "code")


@query("balanced_quota", f"""WITH s AS ({SEGMENTS}), c AS (SELECT code, score, country, count(*) AS n FROM s GROUP BY ALL), a AS (SELECT country, sum(n) AS total FROM c GROUP BY country),
t AS (SELECT c.*, total, unnest(range(1, least(n, 10) + 1)) AS k FROM c JOIN a USING (country)), r AS (SELECT *, row_number() OVER (PARTITION BY code, score ORDER BY k, total, country) AS r FROM t)
SELECT code, score, country, count(*) AS quota FROM r WHERE r <= 10 GROUP BY ALL""")
def _(spark, sf):
    return selection.least_taken_first(segments(spark, sf).groupBy("code", "score", "country").agg(F.count("*").alias("n")), ["code", "score"], "country", 10)


@query("balanced_sample")
def _(spark, sf):
    s = segments(spark, sf)
    quota = selection.balanced_quota(s.groupBy("code", "score", "country").agg(F.count("*").alias("n")), ["code", "score"], "country", 10)
    return selection.draw(s, quota, ["code", "score", "country"], "c_custkey")


@query("sample_summary", "SELECT source, count(*) AS n, round(avg(quality), 6) AS mean_quality, round(stddev_samp(quality), 6) AS sd_quality, round(avg(n_chars), 6) AS mean_length, round(quantile_cont(n_chars, 0.5), 6) AS median_length, count(DISTINCT lang) AS langs FROM documents JOIN labels USING (doc_id) GROUP BY source")
def _(spark, sf):
    d = scored(spark, sf)
    out = d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.round(F.stddev_samp("quality"), 6).alias("sd_quality"), F.round(F.avg("n_chars"), 6).alias("mean_length"), F.countDistinct("lang").alias("langs"))
    return reports.with_median(out, d, "source", "n_chars").withColumn("median_length", F.round("median_length", 6))


@query("crosstab", "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).count().na.fill(0)


_LONG = f"SELECT l_returnflag, l_linestatus, variable, x FROM (SELECT l_returnflag, l_linestatus, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in NUMBERS)} FROM lineitem) UNPIVOT (x FOR variable IN ({', '.join(NUMBERS)}))"


@query("descriptives", f"SELECT l_returnflag, variable, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) AS iqr FROM ({_LONG}) GROUP BY ALL")
def _(spark, sf):
    return statistics.descriptives(table(spark, sf, "lineitem"), "l_returnflag", NUMBERS)


_MOMENTS = f"m AS (SELECT l_returnflag AS g, variable, count(x) AS n, avg(x) AS mean, var_samp(x) AS var FROM ({_LONG}) GROUP BY ALL)"
_WELCH = f"""WITH {_MOMENTS}, w AS (SELECT a.variable, a.g AS a, b.g AS b, a.mean - b.mean AS d, a.var / a.n AS sa, b.var / b.n AS sb, a.n AS na, b.n AS nb, sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)) AS p FROM m a JOIN m b ON a.variable = b.variable AND a.g < b.g)"""


@query("welch_tests", _WELCH + " SELECT variable, a, b, round(d, 4) + 0.0 AS difference, round(d / sqrt(sa + sb), 4) AS t, round(power(sa + sb, 2) / (power(sa, 2) / (na - 1) + power(sb, 2) / (nb - 1)), 2) AS df, round(d / p * (1 - 3 / (4 * (na + nb) - 9)), 6) AS g FROM w")
def _(spark, sf):
    r = lambda c, n: F.round(c, n).alias(c)
    return statistics.welch(table(spark, sf, "lineitem"), "l_returnflag", NUMBERS).select("variable", "a", "b", (F.round("difference", 4) + 0.0).alias("difference"), r("t", 4), r("df", 2), r("g", 6))


@query("adjusted_tests", """WITH s AS (SELECT c_mktsegment AS family, c_custkey AS test, round(abs(c_acctbal) / 10000, 6) AS p FROM customer), i AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test) AS i, count(*) OVER (PARTITION BY family) AS m FROM s)
SELECT family, test, p, round(least(1, max((m - i + 1) * p) OVER (PARTITION BY family ORDER BY i)), 6) AS holm, round(least(1, min(m / i * p) OVER (PARTITION BY family ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh FROM i""")
def _(spark, sf):
    """Balances scaled to 0 to 1 stand for given p values."""
    t = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("family"), F.col("c_custkey").alias("test"), F.round(F.abs("c_acctbal").cast("double") / 10000, 6).alias("p"))
    r = lambda c: F.round(c, 6).alias(c)
    return statistics.adjust(t, "family", "p", ["test"]).select("family", "test", "p", r("holm"), r("bh"))


@query("welch_p")
def _(spark, sf):
    """Tests of all pairs of groups with their p values, corrected within each variable."""
    t = statistics.welch(table(spark, sf, "lineitem"), "l_returnflag", NUMBERS)
    return statistics.adjust(t, "variable", "p", ["a", "b"])


@query("welch_anova", f"""WITH {_MOMENTS}, w AS (SELECT *, n / var AS w FROM m), t AS (SELECT variable, count(*) AS k, sum(w) AS sw, sum(w * mean) / sum(w) AS grand, sum(n) AS rows, sum((n - 1) * var) AS ssw, sum(n * mean) / sum(n) AS plain FROM w GROUP BY variable),
f AS (SELECT variable, k, rows, ssw, sum(w * power(mean - grand, 2)) AS b, sum(n * power(mean - plain, 2)) AS ssb, sum(power(1 - w / sw, 2) / (n - 1)) AS l FROM w JOIN t USING (variable) GROUP BY ALL)
SELECT variable, round(b / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * l), 4) AS f, k - 1 AS df1, round((k * k - 1) / (3 * l), 4) AS df2, round(greatest(0, (ssb - (k - 1) * ssw / (rows - k)) / (ssb + ssw + ssw / (rows - k))), 6) AS omega2 FROM f""")
def _(spark, sf):
    out = statistics.welch_anova(table(spark, sf, "lineitem"), "l_returnflag", NUMBERS)
    return out.select("variable", F.round("f", 4).alias("f"), "df1", F.round("df2", 4).alias("df2"), F.round("omega2", 6).alias("omega2"))


@query("correlations", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def _(spark, sf):
    return statistics.correlation(table(spark, sf, "lineitem"), NUMBERS).select("x", "y", F.round("r", 6).alias("r"))


#: The components of the vectors, as a wide table.
WIDE = [f"e{i:02d}" for i in range(64)]
_CELLS = "e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings WHERE len(embedding) = 64)"
_PAIRS = "SELECT format('e{:02d}', a.i) AS x, format('e{:02d}', b.i) AS y, count(*) AS n, round(corr(a.v, b.v), 6) AS r FROM c AS a JOIN c AS b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i"


def components(spark, sf):
    return table(spark, sf, "embeddings").where(F.size("embedding") == 64).select(*[F.col("embedding")[i].alias(c) for i, c in enumerate(WIDE)])


@query("wide_correlations", f"WITH {_CELLS}, c AS (SELECT vec_id, i, v::DOUBLE AS v FROM e) {_PAIRS}")
def _(spark, sf):
    return correlation.pearson(components(spark, sf), WIDE).withColumn("r", F.round("r", 6))


@query("wide_spearman", f"WITH {_CELLS}, c AS (SELECT vec_id, i, rank() OVER (PARTITION BY i ORDER BY v) + (count(*) OVER (PARTITION BY i, v) - 1) / 2 AS v FROM e) {_PAIRS}")
def _(spark, sf):
    return correlation.spearman_all(components(spark, sf), WIDE).withColumn("r", F.round("r", 6))


@query("spearman", """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS y FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY l_returnflag""")
def _(spark, sf):
    return statistics.spearman(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_discount")


@query("feature_screen", " UNION ALL ".join(f"SELECT '{c}' AS variable, round(avg(CAST({c} = 0 AS DOUBLE)), 6) AS zeros, round(stddev_samp({c}), 4) AS sd, stddev_samp({c}) > 1e-12 AND avg(CAST({c} = 0 AS DOUBLE)) < 0.95 AS kept FROM lineitem" for c in NUMBERS))
def _(spark, sf):
    return statistics.screen(table(spark, sf, "lineitem"), NUMBERS)


@query("projection", """WITH p AS (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents WHERE lang = 'en') SELECT doc_id, round((n_chars - m) / s, 4) AS score FROM documents, p WHERE lang <> 'en'""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return statistics.project(d.where("lang <> 'en'"), d.where("lang = 'en'"), "doc_id", {"n_chars": 1})


@query("ols_hc3", """WITH b AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS b0, var_pop(l_quantity) * count(*) AS sxx FROM lineitem),
e AS (SELECT l_quantity - mx AS dx, power((l_extendedprice - b0 - b1 * l_quantity) / (1 - 1 / n - power(l_quantity - mx, 2) / sxx), 2) AS e, n, mx, sxx, b0, b1 FROM lineitem, b),
v AS (SELECT n, b0, b1, sqrt(sum(power(dx / sxx, 2) * e)) AS s1, sqrt(sum(power(1 / n - mx * dx / sxx, 2) * e)) AS s0 FROM e GROUP BY ALL)
SELECT 'intercept' AS term, round(b0, 2) AS coef, round(s0, 3) AS se, n FROM v UNION ALL SELECT 'l_quantity', round(b1, 2), round(s1, 3), n FROM v""")
def _(spark, sf):
    return statistics.ols_hc3(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"]).select("term", F.round("coef", 2).alias("coef"), F.round("se", 3).alias("se"), "n")


@query("bootstrap_difference")
def _(spark, sf):
    return statistics.bootstrap_difference(table(spark, sf, "lineitem"), "l_returnflag", "A", "N", "l_extendedprice")


@query("quantile_targets", "SELECT source, CAST(i AS INTEGER) AS i, CAST(round_even(round(quantile_cont(n_chars, [0.1, 0.3, 0.5, 0.7, 0.9])[i + 1], 6), 0) AS BIGINT) AS target FROM documents, range(5) AS r(i) GROUP BY source, i")
def _(spark, sf):
    return selection.quantile_targets(table(spark, sf, "documents"), "source", "n_chars", 5)


@query("best_candidates", "SELECT conv_id, turn, role, length(text) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) WHERE r = 1")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("score", F.length("text").cast("long"))
    return selection.best_candidates(c, ["conv_id"], "score", "turn").select("conv_id", "turn", "role", "score")


@query("first_valid", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE lang = 'en') WHERE r <= 5")
def _(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars", (F.col("lang") == "en").alias("valid"))
    return selection.first_valid(d, "source", "valid", [F.desc("n_chars"), F.col("doc_id")], 5).select("source", "doc_id", "n_chars")


@query("merged_sources", """WITH r AS (SELECT conv_id, list({'p': turn, 'score': length(text), 'verified': role = 'system', 'hint': contains(text, '?'), 'backup': turn % 5 = 4} ORDER BY turn) AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, m.p, m.score, m.verified, m.hint, m.backup FROM (SELECT conv_id, list_reduce(l, lambda a, x: CASE WHEN CASE WHEN x.backup <> a.backup THEN a.backup WHEN x.verified <> a.verified THEN x.verified WHEN x.hint AND NOT a.hint THEN true ELSE x.score > a.score END THEN x ELSE a END) AS m FROM r)""")
def _(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("score"), (F.col("role") == "system").alias("verified"), F.contains("text", F.lit("?")).alias("hint"), (F.col("turn") % 5 == 4).alias("backup"))
    return selection.merge_sources(c, ["conv_id"], "turn")


@query("pending_orders", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def _(spark, sf):
    from quillmill.sources.io import pending

    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return pending(table(spark, sf, "orders"), done, "o_orderkey").select("o_orderkey", "o_custkey")


@query("quality_checks", "SELECT 'positive' AS \"check\", count(*) FILTER (NOT coalesce(l_quantity > 0, false)) AS violations FROM lineitem UNION ALL SELECT 'discounted', count(*) FILTER (NOT coalesce(l_discount BETWEEN 0.02 AND 0.08, false)) FROM lineitem")
def _(spark, sf):
    return selection.violations(table(spark, sf, "lineitem"), {"positive": "l_quantity > 0", "discounted": "l_discount between 0.02 and 0.08"})


@query("top_by_effect", "SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 6")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return reports.strongest(d, "l_extendedprice", ["l_orderkey", "l_linenumber"], 6, "l_returnflag")


@query("source_share", "SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def _(spark, sf):
    g = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("extremes", "SELECT lang, arg_max(source, (m, source)) AS highest, arg_min(source, (m, source)) AS lowest FROM (SELECT lang, source, avg(n_chars) AS m FROM documents GROUP BY ALL) GROUP BY lang")
def _(spark, sf):
    m = table(spark, sf, "documents").groupBy("lang", "source").agg(F.avg("n_chars").alias("m"))
    return m.groupBy("lang").agg(F.max_by("source", F.struct("m", "source")).alias("highest"), F.min_by("source", F.struct("m", "source")).alias("lowest"))


@query("congruence", """WITH d AS (SELECT source AS feature, lang AS factor, CAST(count(*) AS DOUBLE) AS loading FROM documents GROUP BY ALL UNION ALL SELECT 'other', 'apart', 1), e AS (SELECT source AS feature, 'q' || quality AS factor, CAST(count(*) AS DOUBLE) AS loading FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
x AS (SELECT factor, sum(loading * loading) AS n FROM d GROUP BY factor), y AS (SELECT factor, sum(loading * loading) AS n FROM e GROUP BY factor),
p AS (SELECT d.factor AS a, e.factor AS b, sum(d.loading * e.loading) AS s FROM d JOIN e USING (feature) GROUP BY ALL)
SELECT x.factor AS factor_a, y.factor AS factor_b, round(coalesce(s, 0) / sqrt(x.n * y.n), 6) AS c FROM x CROSS JOIN y LEFT JOIN p ON p.a = x.factor AND p.b = y.factor""")
def _(spark, sf):
    a = table(spark, sf, "documents").groupBy(F.col("source").alias("feature"), F.col("lang").alias("factor")).agg(F.count("*").cast("double").alias("loading"))
    a = a.unionByName(spark.createDataFrame([("other", "apart", 1.0)], "feature string, factor string, loading double"))  # shares no feature
    b = scored(spark, sf).groupBy(F.col("source").alias("feature"), F.concat(F.lit("q"), "quality").alias("factor")).agg(F.count("*").cast("double").alias("loading"))
    return statistics.congruence(a, b).withColumn("c", F.round("c", 6))


#: The best partners by trying all of them: four factors take one each of the five.
_PARTNERS = ["q0", "q1", "t0", "t1"]


@query("assigned_factors", f"""WITH d AS (SELECT source AS feature, lang AS factor, CAST(count(*) AS DOUBLE) AS loading FROM documents GROUP BY ALL UNION ALL SELECT 'other', 'apart', 1),
e AS (SELECT source AS feature, 'q' || quality AS factor, CAST(count(*) AS DOUBLE) AS loading FROM documents JOIN labels USING (doc_id) GROUP BY ALL UNION ALL SELECT source, 't' || toxic, CAST(count(*) AS DOUBLE) FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
x AS (SELECT factor, sum(loading * loading) AS n FROM d GROUP BY factor), y AS (SELECT factor, sum(loading * loading) AS n FROM e GROUP BY factor), p AS (SELECT d.factor AS a, e.factor AS b, sum(d.loading * e.loading) AS s FROM d JOIN e USING (feature) GROUP BY ALL),
c AS (SELECT x.factor AS a, y.factor AS b, coalesce(s, 0) / sqrt(x.n * y.n) AS c FROM x CROSS JOIN y LEFT JOIN p ON p.a = x.factor AND p.b = y.factor),
best AS (SELECT {', '.join(f'k{i}.a AS a{i}, k{i}.c AS c{i}' for i in range(4))} FROM {', '.join(f'c AS k{i}' for i in range(4))} WHERE {' AND '.join(f"k{i}.b = '{b}'" for i, b in enumerate(_PARTNERS))}
  AND {' AND '.join(f'k{i}.a <> k{j}.a' for i in range(4) for j in range(i))} ORDER BY {' + '.join(f'abs(k{i}.c)' for i in range(4))} DESC LIMIT 1)
""" + " UNION ALL ".join(f"SELECT a{i} AS factor_a, '{b}' AS factor_b, round(c{i}, 6) AS c FROM best" for i, b in enumerate(_PARTNERS)))
def _(spark, sf):
    a = table(spark, sf, "documents").groupBy(F.col("source").alias("feature"), F.col("lang").alias("factor")).agg(F.count("*").cast("double").alias("loading"))
    a = a.unionByName(spark.createDataFrame([("other", "apart", 1.0)], "feature string, factor string, loading double"))
    sides = [scored(spark, sf).groupBy(F.col("source").alias("feature"), F.concat(F.lit(n), c).alias("factor")).agg(F.count("*").cast("double").alias("loading")) for n, c in (("q", "quality"), ("t", "toxic"))]
    return statistics.assigned(statistics.congruence(a, sides[0].unionByName(sides[1]))).withColumn("c", F.round("c", 6))


@query("compound_sentences", rf"""WITH {TAGGED}, s AS (SELECT *, coalesce(sum(CAST(tag = 'wj' AS INT)) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM t),
r(relation, marker) AS (VALUES {', '.join(map(repr, RELATIONS))}), h AS (SELECT DISTINCT doc_id, relation, sentence FROM s JOIN r ON word = marker)
SELECT doc_id, count(*) AS relation_sentences, count(DISTINCT sentence) AS compound, count(DISTINCT relation) AS relations FROM h GROUP BY doc_id""")
def _(spark, sf):
    return linguistic.compound_sentences(table(spark, sf, "documents"), spark.createDataFrame(RELATIONS, "feature string, term string"))


@query("two_part_idioms", rf"""WITH {TAGGED}, s AS (SELECT *, coalesce(sum(CAST(tag = 'wj' AS INT)) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM t),
r(idiom, a, b) AS (VALUES {', '.join(map(repr, IDIOMS))}), h AS (SELECT doc_id, sentence, idiom FROM s JOIN r ON word IN (a, b) GROUP BY doc_id, sentence, idiom HAVING bool_or(word = a) AND bool_or(word = b)),
i AS (SELECT doc_id, idiom, count(*) AS hits FROM h GROUP BY ALL) SELECT doc_id, CAST(sum(hits) AS BIGINT) AS idioms, count(*) AS different, round(count(*) / sum(hits), 6) AS diversity FROM i GROUP BY doc_id""")
def _(spark, sf):
    return linguistic.idiom_diversity(linguistic.two_part_idioms(table(spark, sf, "documents"), spark.createDataFrame(IDIOMS, "idiom string, first string, second string")))


@query("uncovered_words", rf"""WITH {TAGGED} SELECT doc_id, CAST(sum(CAST(tag = 'u' AND word NOT IN ('the', 'and', 'la') AS INT)) AS BIGINT) AS free_u, CAST(sum(CAST(tag = 'n' AND word NOT IN ('that', 'with') AS INT)) AS BIGINT) AS free_n FROM t WHERE tag IN ('u', 'n') GROUP BY doc_id""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    marks = spark.createDataFrame([("marks", w) for w in ("the", "and", "la", "that", "with")], "feature string, term string")
    return linguistic.uncovered(d, linguistic.lexicon_spans(d, marks), ["u", "n"])


@query("article_status", r"""WITH p AS (SELECT page_id, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g'), '\p{L}')) AS letters FROM pages),
r AS (SELECT *, CASE WHEN contains(title, 'admin') OR contains(title, 'login') THEN 'excluded' WHEN letters < 600 THEN 'too short' WHEN letters > 4000 THEN 'too long' WHEN length(trim(coalesce(html, ''))) = 0 THEN 'empty' END AS reason FROM p)
SELECT page_id, CASE WHEN html IS NULL THEN 'failed' WHEN reason IS NOT NULL THEN 'invalid' WHEN NOT contains(lower(html), 'ment') THEN 'off topic' ELSE 'candidate' END AS status, CASE WHEN html IS NULL THEN 'no page' ELSE reason END AS why FROM r""")
def _(spark, sf):
    body = F.coalesce("html", F.lit(""))
    letters = F.regexp_count(F.regexp_replace(body, "<[^>]*>", ""), F.lit(r"\p{L}"))
    reason = validation.first_failure(validation.article_checks(body, F.regexp_extract(body, "<title>([^<]*)</title>", 1), ["admin", "login"], letters, 600, 4000))
    tier = F.when(F.contains(F.lower(body), F.lit("ment")), "broad").otherwise("mismatch")
    status, why = validation.candidate_status(F.when(F.col("html").isNull(), "no page"), reason, F.lit(None).cast("string"), tier)
    return table(spark, sf, "pages").select("page_id", status.alias("status"), why.alias("why"))


@query("page_links", r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS position, regexp_extract(l[i], 'href="([^"]*)"', 1) AS target, regexp_extract(l[i], '>([^<]*)<', 1) AS label
FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*>[^<]*</a>') AS l FROM pages WHERE html IS NOT NULL))""")
def _(spark, sf):
    return validation.listing(table(spark, sf, "pages").select("page_id", "html"), "html", "<a [^>]*>[^<]*</a>", {"target": 'href="([^"]*)"', "label": ">([^<]*)<"})


_ITEMS = r"""i AS (SELECT page_id, CAST(k - 1 AS INTEGER) AS position, replace(regexp_extract(l[k], 'href="([^"]*)"', 1), '&amp;', '&') AS target, replace(regexp_extract(l[k], '>([^<>]*)</a>', 1), '&amp;', '&') AS label
FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '<li><a [^>]*>[^<]*</a></li>') AS l FROM pages WHERE html IS NOT NULL)))"""


def items(spark, sf) -> DataFrame:
    return validation.listing_blocks(table(spark, sf, "pages"), "page_id", "html", ("li", None), {"target": ("a", None, "href"), "label": ("a", None, None)})


@query("listing_blocks", f"WITH {_ITEMS} SELECT page_id, position, 0 AS depth, target, label FROM i")
def _(spark, sf):
    return items(spark, sf)


@query("listed_topics", f"""WITH {_ITEMS}, s AS (SELECT page_id * 1000 + position AS doc_id, regexp_replace(label || ' ' || target, '\\s+', '', 'g') AS w, w AS t, w AS f FROM i),
r AS ({" UNION ALL ".join(map(_rule_sql, RULES))}) SELECT doc_id // 1000 AS page_id, CAST(doc_id % 1000 AS INTEGER) AS position, code, tier, score FROM r WHERE tier <> 'mismatch'""")
def _(spark, sf):
    return validation.listed_topics(items(spark, sf), "page_id", "label", "target", RULES).select("page_id", "position", "code", "tier", "score")


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Rates and diversity of each document with words, written once: the factor queries read it several times."""
    d = table(spark, sf, "documents")
    return materialize(linguistic.tag_counts(d).join(linguistic.lexical_diversity(d), "doc_id").select("doc_id", *FEATURES), "features")


@query("sampling_adequacy")
def _(spark, sf):
    return factors.adequacy(features(spark, sf), FEATURES)


@query("parallel_analysis")
def _(spark, sf):
    return factors.parallel_analysis(features(spark, sf), FEATURES)


@query("factor_models")
def _(spark, sf):
    return factors.factor_models(features(spark, sf), FEATURES, [1, 2, 3])


@query("model_summary")
def _(spark, sf):
    return factors.model_summary(factors.factor_models(features(spark, sf), FEATURES, [1, 2, 3]))


@query("factor_stability")
def _(spark, sf):
    return factors.factor_stability(features(spark, sf), FEATURES, 2)


@query("slot_selection")
def _(spark, sf):
    pool = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    targets = selection.quantile_targets(table(spark, sf, "documents"), "source", "n_chars", 5)
    return matching.select_slots(pool, targets, "source", "doc_id", "n_chars", F.col("toxic") * 0.38, F.col("quality") == 1, F.col("lang"), {"en": 2, "fr": 2, "de": 1}, 5)


_SLOT = {"en": 2, "fr": 2, "de": 1}


def slots(spark, sf) -> dict:
    """Documents as a pool: their topic by the first rule, a date from orders, and labels of quality as the stage."""
    d = table(spark, sf, "documents")
    found = topics.topics(d, RULES[:1]).select("doc_id", "tier", "score")
    dates = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("string").alias("day"))
    pool = d.join(found, "doc_id").where("tier <> 'mismatch'").join(table(spark, sf, "labels"), "doc_id", "left").join(dates, "doc_id", "left")
    targets = selection.quantile_targets(d, "source", "n_chars", 5)
    stage = F.col("quality") == 1
    return dict(pool=pool, targets=targets, group="source", key="doc_id", length="n_chars", cost=matching.slot_cost(F.col("tier"), F.col("day"), stage, F.col("score"), 1994, 1996), preferred=stage, grade=F.col("lang"), quotas=_SLOT, count=5)


_SLOT_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, strpos(coalesce(text, ''), chr(10)) AS p FROM documents),
s AS (SELECT doc_id, regexp_replace(x, '\\s+', '', 'g') AS w, regexp_replace(CASE WHEN p > 0 THEN substring(x, 1, p - 1) ELSE x END, '\\s+', '', 'g') AS t, regexp_replace(CASE WHEN p > 0 THEN substring(x, 1, p - 1) || substring(x, p + 1, 260) ELSE x END, '\\s+', '', 'g') AS f FROM d),
r AS ({_rule_sql(RULES[0])}),
q AS (SELECT source, CAST(i AS INTEGER) AS i, CAST(round_even(round(quantile_cont(n_chars, [0.1, 0.3, 0.5, 0.7, 0.9])[i + 1], 6), 0) AS BIGINT) AS target FROM documents, range(5) AS r(i) GROUP BY source, i),
p AS (SELECT d.source, d.doc_id, d.n_chars, coalesce(l.quality = 1, false) AS preferred, CASE WHEN d.lang IS NULL THEN '?' WHEN d.lang IN ('en', 'fr', 'de') THEN d.lang ELSE 'other' END AS grade, coalesce(try_cast(substr(CAST(o.o_orderdate AS VARCHAR), 1, 4) AS INT), 9999) AS y,
  CASE r.tier WHEN 'exact' THEN 0.0 WHEN 'near' THEN 0.16 WHEN 'extended' THEN 0.38 ELSE 0.68 END AS tc, r.score FROM documents d JOIN r USING (doc_id) LEFT JOIN labels l USING (doc_id) LEFT JOIN orders o ON o.o_orderkey = d.doc_id WHERE r.tier <> 'mismatch'),
c AS (SELECT *, tc + CASE WHEN y BETWEEN 1994 AND 1996 THEN 0 WHEN y = 9999 THEN 0.2 ELSE least(0.35, 0.02 * least(abs(y - 1996), 15)) END + CASE WHEN preferred THEN 0 ELSE 0.55 END - least(score, 140) / 3000.0 AS c FROM p),
t AS (SELECT c.source, q.i, q.target, preferred, grade, doc_id, c + abs(n_chars - target) / greatest(target, 1) AS total FROM c JOIN q ON q.source = c.source)
SELECT source, i, target, preferred, grade, doc_id, round(total, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY source, i, preferred, grade ORDER BY total, doc_id) AS k FROM t) WHERE k = 1"""


@query("slot_candidates", _SLOT_SQL)
def _(spark, sf):
    d = matching.slot_candidates(**(slots(spark, sf) | {"count": 5}))
    best = d.groupBy("g", "i", "target", "preferred", "grade").agg(F.min(F.struct("c", "key")).alias("m"))
    return best.select(F.col("g").alias("source"), "i", "target", "preferred", "grade", F.col("m.key").alias("doc_id"), F.round("m.c", 6).alias("cost"))


@query("slots_by_topic")
def _(spark, sf):
    return matching.select_slots(**slots(spark, sf))


@query("length_matched")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("words", F.size(F.split("text", " ")))
    return matching.length_matched(d.where("lang = 'en'"), d.where("lang <> 'en'"), "source", "doc_id", "n_chars", "words")


_SENT = f"{TAGGED}, s AS (SELECT *, coalesce(sum(CAST(tag = 'wj' AS INT)) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM t)"


@query("diversity_by_tag", rf"""WITH {TAGGED}, c AS (SELECT doc_id, word, tag, count(*) AS n FROM t WHERE regexp_matches(word, '^\p{{L}}') GROUP BY ALL)
SELECT doc_id, {', '.join(f"CAST(coalesce(sum(n) FILTER (tag = '{x}'), 0) AS BIGINT) AS n_{x}, count(*) FILTER (tag = '{x}') AS types_{x}, round(CASE WHEN coalesce(sum(n) FILTER (tag = '{x}'), 0) = 0 THEN 0 ELSE count(*) FILTER (tag = '{x}') / sum(n) FILTER (tag = '{x}') END, 6) AS ttr_{x}" for x in 'nva')}, round(count(*) FILTER (n = 1) / count(*), 6) AS hapax_share FROM c GROUP BY doc_id""")
def _(spark, sf):
    return linguistic.diversity_by_tag(table(spark, sf, "documents"))


@query("token_sizes", f"""WITH {TAGGED} SELECT d.doc_id, count(t.word) AS tokens, count(t.word) FILTER (t.tag NOT LIKE 'w%') AS words, count(DISTINCT t.word) FILTER (t.tag NOT LIKE 'w%') AS distinct_words FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id""")
def _(spark, sf):
    return linguistic.sizes(table(spark, sf, "documents"))


@query("density", rf"""WITH {TAGGED}, w AS (SELECT *, CASE WHEN regexp_full_match(word, '\p{{L}}+') THEN least(length(word), 3) END AS l FROM t WHERE tag NOT LIKE 'w%'),
c AS (SELECT d.doc_id, count(word) AS words, count(word) FILTER (tag IN ('n', 'v', 'a')) AS content, count(word) FILTER (tag IN ('n', 'v', 'a', 'm')) AS "real", count(word) FILTER (tag = 'u') AS functional, CAST(0 AS BIGINT) AS other, coalesce(sum(length(word)), 0) AS chars, count(*) FILTER (l = 1) AS one, count(*) FILTER (l = 2) AS two, count(*) FILTER (l = 3) AS three FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, words, content, "real", functional, other, {', '.join(f'round(CASE WHEN {b} = 0 THEN 0 ELSE {a} / {b} END, 6) AS {n}' for a, b, n in (('content', 'words', 'density'), ('"real"', 'words', 'real_share'), ('"real"', 'functional', 'real_per_function'), ('chars', 'words', 'mean_length'), ('one', '(one + two + three)', 'share_one'), ('two', '(one + two + three)', 'share_two'), ('three', '(one + two + three)', 'share_three')))}, one, two, three FROM c""")
def _(spark, sf):
    return linguistic.density(table(spark, sf, "documents"))


@query("class_counts", f"""WITH {TAGGED} SELECT d.doc_id, {', '.join(f"count(tag) FILTER (tag LIKE '{x}%') AS {n}" for x, n in (('n', 'noun'), ('v', 'verb'), ('a', 'adjective'), ('m', 'numeral'), ('u', 'particle'), ('w', 'punctuation_mark'), ('a', 'adjectives'), ('nr', 'persons')))} FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id""")
def _(spark, sf):
    return linguistic.other_classes(linguistic.class_counts(table(spark, sf, "documents"))).select("doc_id", "noun", "verb", "adjective", "numeral", "particle", "punctuation_mark", "adjectives", "persons")


@query("paragraph_structure", rf"""WITH {_SENT}, g AS (SELECT doc_id, sentence, count(*) AS n FROM s GROUP BY ALL HAVING bool_or(regexp_matches(word, '^\p{{L}}'))),
l AS (SELECT doc_id, avg(n) AS mean, quantile_cont(n, 0.5) AS med, stddev_pop(n) AS sd, max(n) AS longest FROM g GROUP BY doc_id), k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (tag LIKE 'w%') AS marks FROM t GROUP BY doc_id),
p AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\n'), lambda x: trim(x) <> '')) AS p, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS chars FROM documents)
SELECT p.doc_id, CAST(p AS BIGINT) AS paragraphs, round(CASE WHEN p = 0 THEN 0 ELSE chars / p END, 6) AS paragraph_chars, round(CASE WHEN p = 0 THEN 0 ELSE coalesce(k.n, 0) / p END, 6) AS paragraph_tokens, round(coalesce(mean, 0), 6) AS mean_tokens, round(coalesce(med, 0), 6) AS median_tokens, round(coalesce(sd, 0), 6) AS sd_tokens, coalesce(longest, 0) AS longest_tokens, round(coalesce(marks / k.n, 0), 6) AS punctuation_share
FROM p LEFT JOIN l ON l.doc_id = p.doc_id LEFT JOIN k ON k.doc_id = p.doc_id""")
def _(spark, sf):
    return linguistic.paragraph_structure(table(spark, sf, "documents"))


@query("level_profile", rf"""WITH {TAGGED}, v(word, level, vtag) AS (VALUES {_VOC}), e AS (SELECT word, min(level) AS low, count(DISTINCT level) AS levels FROM v GROUP BY word),
m AS (SELECT t.doc_id, t.tok_idx, t.word, t.tag, e.low, e.levels, count(DISTINCT v.level) AS fits, min(v.level) AS fit FROM t LEFT JOIN e ON t.word = e.word LEFT JOIN v ON v.word = t.word AND v.vtag = t.tag WHERE regexp_matches(t.word, '^\p{{L}}') GROUP BY ALL),
l AS (SELECT doc_id, word, CASE WHEN levels = 1 THEN low WHEN fits = 1 THEN fit ELSE low END AS level FROM m),
k AS (SELECT doc_id, word, 'level' AS kind, CAST(level AS VARCHAR) AS name FROM l WHERE level IS NOT NULL UNION ALL SELECT doc_id, word, 'group', CASE WHEN level = 1 THEN 'low' ELSE 'high' END FROM l WHERE level IS NOT NULL
UNION ALL SELECT doc_id, word, 'outside', 'all' FROM l WHERE level IS NULL UNION ALL SELECT doc_id, word, 'outside', CASE WHEN regexp_matches(word, '[A-Za-z]') THEN 'letters' ELSE 'other' END FROM l WHERE level IS NULL), n AS (SELECT doc_id, count(*) AS words FROM l GROUP BY doc_id)
SELECT k.doc_id, kind, name, count(*) AS n, round(count(*) / any_value(words), 6) AS share, count(DISTINCT word) AS types, round(count(DISTINCT word) / count(*), 6) AS ttr FROM k JOIN n ON n.doc_id = k.doc_id GROUP BY k.doc_id, kind, name""")
def _(spark, sf):
    return linguistic.level_profile(table(spark, sf, "documents"), spark.createDataFrame(VOCABULARY, "word string, level int, tag string"), {"low": [1], "high": [2, 3]})


@query("joined_labels", "SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def _(spark, sf):
    labels = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "source").join(labels.select("doc_id"), "doc_id", "left_semi")
    return reports.one_to_one(d, labels.select("doc_id", "quality", "toxic"), ["doc_id"])


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the median and sd of their source's lengths as target and scale."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return d.join(d.groupBy("source").agg(F.percentile("n_chars", 0.5).alias("target"), F.stddev_samp("n_chars").alias("sd")), "source")


_MEASURED = "m AS (SELECT source, quantile_cont(n_chars, 0.5) AS target, stddev_samp(n_chars) AS sd FROM documents GROUP BY source), d AS (SELECT doc_id, d.source, lang, n_chars, target, sd, abs(n_chars - target) / greatest(target, 1) AS r, abs(n_chars - target) / greatest(sd, 1) AS z FROM documents d JOIN m ON m.source = d.source)"


@query("deviations", f"WITH {_MEASURED} SELECT doc_id, round(r, 6) AS relative_deviation, round(z, 6) AS sd_deviation, r > 0.5 AS far, z > 1 AS wide, (r > 0.5 AND z > 1) OR r > 2 AS out_of_range FROM d")
def _(spark, sf):
    return reports.deviations(measured(spark, sf), "n_chars", "target", "sd", (0.5, 1.0, 2.0)).select("doc_id", F.round("relative_deviation", 6).alias("relative_deviation"), F.round("sd_deviation", 6).alias("sd_deviation"), "far", "wide", "out_of_range")


@query("sampling_audit", f"WITH {_MEASURED} SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean_length, quantile_cont(n_chars, 0.5) AS median_length, count(*) FILTER (lang = 'en') AS tier_en, count(*) FILTER (lang = 'fr') AS tier_fr, count(*) FILTER (z > 1) AS flagged, round(avg(r), 6) AS mean_deviation FROM d GROUP BY source")
def _(spark, sf):
    d = reports.deviations(measured(spark, sf), "n_chars", "target", "sd", (0.5, 1.0, 2.0))
    r = lambda c: F.round(c, 6).alias(c)
    return reports.sampling_audit(d, "source", "n_chars", "lang", ["en", "fr"], F.col("wide"), "relative_deviation").select("source", "n", r("mean_length"), "median_length", "tier_en", "tier_fr", "flagged", r("mean_deviation"))


@query("selection_summary", "WITH c AS (SELECT * FROM documents JOIN labels USING (doc_id) WHERE quality = 1), a AS (SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, min(doc_id) AS first_year, max(doc_id) AS last_year, avg(n_chars) AS m, var_samp(n_chars) AS v, quantile_cont(n_chars, 0.5) AS median_length FROM c GROUP BY source), b AS (SELECT source, count(*) AS n, avg(n_chars) AS m, var_samp(n_chars) AS v FROM documents GROUP BY source) SELECT a.source, a.n, en, de, first_year, last_year, round(a.m, 6) AS mean_length, median_length, round((a.m - b.m) / sqrt((a.v + b.v) / 2), 6) AS length_difference FROM a JOIN b USING (source)")
def _(spark, sf):
    d = table(spark, sf, "documents")
    s = reports.selection_summary(scored(spark, sf).where("quality = 1"), d, "source", "n_chars", "doc_id", {"lang": ["en", "de"]})
    return s.select("source", "n", F.col("lang")["en"].alias("en"), F.col("lang")["de"].alias("de"), "first_year", "last_year", F.round("mean_length", 6).alias("mean_length"), "median_length", F.round("length_difference", 6).alias("length_difference"))


@query("numbered_files", "SELECT doc_id, source || '_' || lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS VARCHAR), 6, '0') AS filename FROM documents")
def _(spark, sf):
    return reports.numbered(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source", ["n_chars", "doc_id"], width=6).select("doc_id", "filename")


@query("profiles", "SELECT 0 AS level, source, NULL AS lang, round(avg(n_chars), 6) AS n_chars FROM documents GROUP BY source UNION ALL SELECT 1, source, lang, round(avg(n_chars), 6) FROM documents GROUP BY source, lang")
def _(spark, sf):
    return reports.profile(table(spark, sf, "documents"), [["source"], ["source", "lang"]], ["n_chars"]).withColumn("n_chars", F.round("n_chars", 6))


LOADINGS = [("l_quantity", "f1", 0.8), ("l_quantity", "f2", 0.1), ("l_extendedprice", "f1", 0.7), ("l_extendedprice", "f2", -0.2), ("l_discount", "f1", 0.2), ("l_discount", "f2", -0.6), ("l_tax", "f1", 0.1), ("l_tax", "f2", 0.2)]


@query("dimension_scores", """WITH p AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_extendedprice) AS me, stddev_samp(l_extendedprice) AS se, avg(l_discount) AS md, stddev_samp(l_discount) AS sd FROM lineitem),
r AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_quantity - mq) / sq + (l_extendedprice - me) / se AS f1, -(l_discount - md) / sd AS f2 FROM lineitem, p), z AS (SELECT avg(f1) AS a1, stddev_samp(f1) AS s1, avg(f2) AS a2, stddev_samp(f2) AS s2 FROM r)
SELECT id, 'f1' AS factor, round(f1, 4) + 0.0 AS raw, round((f1 - a1) / s1, 4) + 0.0 AS score FROM r, z UNION ALL SELECT id, 'f2', round(f2, 4) + 0.0, round((f2 - a2) / s2, 4) + 0.0 FROM r, z""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    s = statistics.dimension_scores(d, spark.createDataFrame(LOADINGS, "feature string, factor string, loading double"), "id")
    return s.select("id", "factor", (F.round("raw", 4) + 0.0).alias("raw"), (F.round("score", 4) + 0.0).alias("score"))


@query("scaled_projection", """WITH p AS (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents WHERE lang = 'en') SELECT doc_id, round((n_chars - m) / s, 4) + 0.0 AS score FROM documents, p WHERE lang = 'fr'""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    p = statistics.projection_parameters(d.where("lang = 'en'"), {"n_chars": 1})
    return statistics.project_scaled(d.where("lang = 'fr'"), p, "doc_id").select("doc_id", (F.round("score", 4) + 0.0).alias("score"))


@query("sensitivity", "WITH d AS (SELECT * FROM documents JOIN labels USING (doc_id)), g AS (SELECT DISTINCT source FROM d) " + " UNION ALL ".join(f"SELECT '{n}' AS sample, g.source, 'n_chars' AS variable, round(avg(n_chars) FILTER (quality = 1) - avg(n_chars) FILTER (quality = 0), 4) AS difference FROM g LEFT JOIN d ON d.source = g.source AND {c} GROUP BY g.source" for n, c in (("all", "true"), ("short", "n_chars < 500"), ("none", "false"))))
def _(spark, sf):
    samples = {"all": F.lit(True), "short": F.col("n_chars") < 500, "none": F.lit(False)}
    return statistics.sensitivity(scored(spark, sf), samples, "source", F.col("quality") == 1, ["n_chars"]).withColumn("difference", F.round("difference", 4))


@query("table_checks", "SELECT 'unique doc_id' AS \"check\", CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'chars', count(*) FILTER (NOT coalesce(n_chars = length(text), false)) FROM documents UNION ALL SELECT 'equal source', count(*) FILTER (n <> m) FROM (SELECT n, max(n) OVER () AS m FROM (SELECT source, count(*) AS n FROM documents GROUP BY source))")
def _(spark, sf):
    return selection.table_checks(table(spark, sf, "documents"), [["doc_id"]], {"chars": ("n_chars", "length(text)")}, ["source"])


@query("frequent_values", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name LIMIT 15")
def _(spark, sf):
    return reports.frequent(segments(spark, sf).withColumnRenamed("country", "n_name"), "n_name")


@query("group_examples", r"SELECT source, doc_id, CASE WHEN length(e) > 18 THEN substring(e, 1, 18) || '…' ELSE e END AS excerpt FROM (SELECT *, regexp_extract(trim(coalesce(text, '')), '^[^.!?。！？\n]*[.!?。！？]?') AS e, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def _(spark, sf):
    return reports.examples(table(spark, sf, "documents"), "source", [F.desc("n_chars"), "doc_id"], "text").select("source", "doc_id", "excerpt")


@query("serial_gaps", "WITH k AS (SELECT o_orderkey AS s FROM orders WHERE o_orderkey % 7 <> 3) SELECT CAST(i AS BIGINT) AS serial, CAST(0 AS BIGINT) AS n FROM range(1, 2001) AS r(i) WHERE i NOT IN (SELECT s FROM k) UNION ALL SELECT s, count(*) FROM k GROUP BY s HAVING count(*) > 1 OR s NOT BETWEEN 1 AND 2000")
def _(spark, sf):
    return reports.serial_gaps(table(spark, sf, "orders").where("o_orderkey % 7 <> 3"), "o_orderkey", 2000)


@query("representatives", """WITH q AS (SELECT quantile_cont(n_chars, 0.1) AS a, quantile_cont(n_chars, 0.9) AS b FROM documents), l AS (SELECT doc_id, n_chars FROM documents, q ORDER BY abs(n_chars - a), doc_id LIMIT 1),
h AS (SELECT doc_id, n_chars FROM documents, q WHERE doc_id NOT IN (SELECT doc_id FROM l) ORDER BY abs(n_chars - b), doc_id LIMIT 1)
SELECT 'n_chars' AS dimension, 'low' AS pole, doc_id, CAST(n_chars AS DOUBLE) AS score FROM l UNION ALL SELECT 'n_chars', 'high', doc_id, CAST(n_chars AS DOUBLE) FROM h""")
def _(spark, sf):
    return reports.representatives(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", ["n_chars"], {"low": 0.1, "high": 0.9})


_R = "r AS (SELECT " + ", ".join(f"corr({a}, {b}) AS r{i}{j}" for i, a in enumerate(NUMBERS) for j, b in enumerate(NUMBERS) if i < j) + " FROM lineitem)"
_KEPT = [f"coalesce(NOT ({' OR '.join(f'(k{i} AND abs(r{i}{j}) >= 0.85)' for i in range(j))}), true)" for j in range(1, 4)]


@query("correlation_filter", f"WITH {_R}, a AS (SELECT *, true AS k0 FROM r), b AS (SELECT *, {_KEPT[0]} AS k1 FROM a), c AS (SELECT *, {_KEPT[1]} AS k2 FROM b), d AS (SELECT *, {_KEPT[2]} AS k3 FROM c) " + " UNION ALL ".join(f"SELECT '{v}' AS variable, k{j} AS kept FROM d" for j, v in enumerate(NUMBERS)))
def _(spark, sf):
    return statistics.correlation_filter(table(spark, sf, "lineitem"), NUMBERS).select("variable", "kept")


#: As `deduplicated`, with conflicts between sources alone; near texts are told by their rarest grams first.
@query("deduplicated_across", r"""WITH RECURSIVE x AS (SELECT source, doc_id, row_number() OVER (ORDER BY length(coalesce(text, '')) DESC, doc_id) AS rn, regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B　]+', '', 'g') AS b FROM documents),
d AS (SELECT min(doc_id) AS id, b FROM x GROUP BY b), x2 AS (SELECT x.source, x.doc_id, x.rn, d.id FROM x JOIN d ON d.b = x.b),
g AS (SELECT DISTINCT id, g FROM (SELECT id, CASE WHEN length(b) <= 5 THEN b ELSE substring(b, CAST(i AS BIGINT), 5) END AS g FROM d, unnest(range(1, greatest(length(b) - 3, 2))) AS u(i))),
v AS (SELECT id, list(g) AS gs, count(*) AS n FROM g GROUP BY id), c AS (SELECT id, g, row_number() OVER (PARTITION BY id ORDER BY df, g) AS r FROM (SELECT id, g, count(*) OVER (PARTITION BY g) AS df FROM g)),
pf AS (SELECT c.id, g FROM c JOIN v ON v.id = c.id WHERE r <= n - ceil(0.85 * n - 1e-9) + 1), t AS (SELECT DISTINCT y.id AS a, z.id AS b FROM pf y JOIN pf z ON y.g = z.g AND y.id < z.id),
q AS (SELECT a, b FROM (SELECT a, b, len(list_intersect(va.gs, vb.gs)) AS s, va.n AS na, vb.n AS nb FROM t JOIN v va ON va.id = a JOIN v vb ON vb.id = b WHERE va.n >= 0.85 * vb.n - 1e-9 AND vb.n >= 0.85 * va.n - 1e-9) WHERE s / (na + nb - s) >= 0.85 - 1e-9), w AS (SELECT a, b FROM q UNION ALL SELECT b, a FROM q),
h AS (SELECT y.rn, list(z.rn) AS same FROM x2 y JOIN x2 z ON z.id = y.id AND z.source IS DISTINCT FROM y.source GROUP BY y.rn), m AS (SELECT y.rn, list(z.rn) AS near FROM x2 y JOIN w ON w.a = y.id JOIN x2 z ON z.id = w.b AND z.source IS DISTINCT FROM y.source GROUP BY y.rn),
o AS (SELECT x2.source, x2.doc_id, x2.rn, coalesce(same, []) AS same, coalesce(near, []) AS near FROM x2 LEFT JOIN h ON h.rn = x2.rn LEFT JOIN m ON m.rn = x2.rn),
r(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT i + 1, CASE WHEN len(list_intersect(kept, list_concat(same, near))) = 0 THEN list_append(kept, rn) ELSE kept END FROM r JOIN o ON o.rn = i + 1),
k AS (SELECT kept FROM r ORDER BY i DESC LIMIT 1), f AS (SELECT doc_id, list_contains(kept, rn) AS kept, list_min(list_filter(list_intersect(same, kept), lambda v: v < rn)) AS hs, list_min(list_filter(list_intersect(near, kept), lambda v: v < rn)) AS ns FROM o, k)
SELECT f.doc_id, f.kept, CASE WHEN f.kept THEN NULL WHEN hs IS NOT NULL THEN 'hash' ELSE 'near' END AS reason, CASE WHEN f.kept THEN NULL ELSE o.doc_id END AS winner, CASE WHEN f.kept THEN NULL ELSE o.source END AS winner_group FROM f LEFT JOIN o ON o.rn = coalesce(hs, ns)""")
def _(spark, sf):
    return dedup.deduplicate_across(table(spark, sf, "documents"))


@query("source_labels", r"SELECT page_id, rtrim(trim(regexp_replace(split_part(regexp_replace(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')), '^(来源|source)[:：]\s*', '', 'i'), ' the', 1), '[|｜/\s]+$', ''))) AS label FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.source_label(F.regexp_extract("html", "<title>([^<]*)</title>", 1), [" the"]).alias("label"))


_H = {"title": ("h1", None), "page_title": ("title", None), "breadcrumb": ("nav", None), "meta": ("footer", None), "body": ("article", None)}


@query("page_articles")
def _(spark, sf):
    """Fields of every page's article."""
    return validation.articles(table(spark, sf, "pages"), "page_id", "url", "html", _H, ["en", "fr"], "[A-Z]", [r"track\(.*"], [], "", ["&"])


@query("idiom_counts", f"""WITH {PARTS}, t AS (SELECT *, {TAG} AS tag FROM tok), s AS (SELECT *, coalesce(sum(CAST(tag = 'wj' AS INT)) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM t), r(a, b) AS (VALUES ('la', 'de'), ('the', 'of')),
x AS (SELECT doc_id, sentence, a FROM s JOIN r ON word IN (a, b) GROUP BY doc_id, sentence, a, b HAVING bool_or(word = a) AND bool_or(word = b)), n AS (SELECT doc_id, word || ' ' || lead(word) OVER (PARTITION BY doc_id, p ORDER BY tok_idx) AS term FROM tok),
u AS (SELECT doc_id, 'pair' AS kind, a AS term, count(*) AS hits FROM x GROUP BY ALL UNION ALL SELECT doc_id, 'fixed', term, count(*) FROM n WHERE term IN ('of the', 'de la') GROUP BY ALL)
SELECT doc_id, {', '.join(f"CAST(coalesce(sum(hits) FILTER (kind = '{k}'), 0) AS BIGINT) AS n_{i}, count(*) FILTER (kind = '{k}') AS different_{i}" for i, k in enumerate(('pair', 'fixed')))}, CAST(sum(hits) AS BIGINT) AS idioms, count(*) AS different, round(count(*) / sum(hits), 6) AS diversity FROM u GROUP BY doc_id""")
def _(spark, sf):
    idioms = spark.createDataFrame([("pair", "la", "de"), ("pair", "the", "of"), ("fixed", "of the", None), ("fixed", "de la", None)], "kind string, first string, second string")
    return linguistic.idiom_counts(table(spark, sf, "documents"), idioms, ["pair", "fixed"], "fixed", [])


@query("narrative_marks", rf"""WITH {TAGGED} SELECT d.doc_id, count(tag) FILTER (tag IN ('v', 'a')) AS acts, count(tag) FILTER (word = 'the' AND tag = 'u') AS the_u, count(tag) FILTER (tag = 'n' AND word NOT IN ('that', 'with')) AS free_n, count(tag) FILTER (word IN ('that', 'with')) AS links,
any_value(len(regexp_extract_all(coalesce(d.text, ''), '“[^”]*”')) + len(regexp_extract_all(coalesce(d.text, ''), '「[^」]*」')) + len(regexp_extract_all(coalesce(d.text, ''), '『[^』]*』')) + len(regexp_extract_all(coalesce(d.text, ''), '"[^"' || chr(10) || ']*"'))) AS quotes, 0.0::DOUBLE AS first_person FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    spans = linguistic.lexicon_spans(d, spark.createDataFrame([("w", "that"), ("w", "with")], "feature string, term string"))
    return linguistic.narrative(d, spans, {"links": ["w"]}, {"acts": ["v", "a"]}, {"the_u": ("the", "u")}, ["n"], ["i"])


@query("labelled_rows", "SELECT 'orders' AS source, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def _(spark, sf):
    parts = {"orders": table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), "lineitem": table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))}
    return reports.labelled_union(parts).groupBy("source").agg(F.count("*").alias("n"))


@query("main_loadings", "WITH c AS (SELECT source, lang, count(*) / 100.0 AS l FROM documents GROUP BY ALL), m AS (SELECT source, max(l) FILTER (lang = 'en') AS fen, max(l) FILTER (lang = 'fr') AS ffr, arg_max(lang, (l, lang)) AS main, max(l) AS main_loading FROM c GROUP BY source) SELECT source AS feature, round(fen, 4) AS fen, round(ffr, 4) AS ffr, main, round(main_loading, 4) AS main_loading FROM m")
def _(spark, sf):
    c = table(spark, sf, "documents").groupBy(F.col("source").alias("feature"), F.col("lang").alias("factor")).agg((F.count("*") / 100.0).cast("double").alias("loading"))
    m = reports.main_loadings(c, ["en", "fr"])
    return m.select("feature", F.round("fen", 4).alias("fen"), F.round("ffr", 4).alias("ffr"), "main", F.round("main_loading", 4).alias("main_loading"))


@query("top_loadings", "WITH c AS (SELECT source AS feature, lang AS factor, round(count(*) / 100.0, 4) AS loading FROM documents GROUP BY ALL) SELECT factor, 1 AS sign, CAST(r AS INTEGER) AS place, feature, loading FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY loading DESC, feature) AS r FROM c WHERE loading >= 0.05) WHERE r <= 6")
def _(spark, sf):
    c = table(spark, sf, "documents").groupBy(F.col("source").alias("feature"), F.col("lang").alias("factor")).agg(F.round((F.count("*") / 100.0).cast("double"), 4).alias("loading"))
    return reports.top_loadings(c, 0.05)


@query("segmented_lines", rf"""WITH {PARTS}, l AS (SELECT doc_id, p, string_agg(word || '/' || {TAG}, ' ' ORDER BY tok_idx) AS line FROM tok GROUP BY doc_id, p), g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS segmented FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(segmented, '') AS segmented FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id""")
def _(spark, sf):
    return linguistic.segmented_lines(table(spark, sf, "documents"))


@query("grammar_marks", rf"""WITH {TAGGED} SELECT d.doc_id, count(tag) FILTER (tag = 'u') AS exact_u, count(tag) FILTER (tag = 'm') AS exact_m, count(tag) FILTER (word = 'the' AND tag LIKE 'u%') AS the_u, count(tag) FILTER (word = 'with' AND tag LIKE 'n%') AS with_n, count(tag) FILTER (tag LIKE 'w%' AND tag <> 'wj') AS other_w, count(tag) FILTER (tag = 'wj') AS stops
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id""")
def _(spark, sf):
    return linguistic.grammar_marks(table(spark, sf, "documents"), {"exact_u": "u", "exact_m": "m", "stops": "wj"}, {"the_u": ("the", "u"), "with_n": ("with", "n")}, {"other_w": "w"})


#: Every way that a sentence is classed by: what asks for a thing, what asks yes or no, and marks.
@query("sentence_kinds", rf"""WITH {TAGGED}, s AS (SELECT *, coalesce(sum(CAST(tag = 'wj' AS INT)) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM t),
f AS (SELECT doc_id, sentence, bool_or(word IN ('?', '？')) AS q, bool_or(word IN ('!', '！')) AS e, bool_or(word IN ('que', 'was', 'the')) AS wh, contains(string_agg(word, '' ORDER BY tok_idx), 'ent') AS yn, bool_or(tag LIKE 'v%') AS verbs FROM s GROUP BY ALL HAVING bool_or(regexp_matches(word, '^\p{{L}}')))
SELECT doc_id, count(*) AS sentences, {", ".join(f"CAST(sum(CAST({c} AS INT)) AS BIGINT) AS {n}" for c, n in (("q", "questions"), ("(NOT q AND e)", "exclamations"), ("e", "all_exclamations"), ("(q AND wh)", "wh_questions"), ("(q AND NOT wh AND yn)", "yes_no_questions"), ("verbs", "with_verbs")))} FROM f GROUP BY doc_id""")
def _(spark, sf):
    return linguistic.sentence_classes(table(spark, sf, "documents"), ["que", "was", "the"], ["ent"], [], {"with_verbs": "v"})


#: First person among pronouns, by a segmenter that tags some words as pronouns.
def _pronouns(line: str) -> list[tuple[str, str]]:
    return [(w, "r" if w in ("the", "la", "it") else linguistic.rule_tag(w)) for w in linguistic.TOKEN.findall(line.lower())]


@query("first_person", rf"""WITH {TAGGED} SELECT d.doc_id, count(tag) FILTER (word NOT IN ('the', 'la', 'it') AND tag = 'n') AS nouns, round(coalesce(count(tag) FILTER (word = 'it') / nullif(count(tag) FILTER (word IN ('the', 'la', 'it')), 0), 0), 6) AS first_person FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    nothing = linguistic.lexicon_spans(d, spark.createDataFrame([("w", "no such word")], "feature string, term string"), _pronouns)
    return linguistic.narrative(d, nothing, {}, {"nouns": ["n"]}, {}, [], ["it"], _pronouns).select("doc_id", "nouns", "first_person")


@query("excerpts", r"""WITH b AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS b FROM documents), l AS (SELECT doc_id, b, regexp_extract_all(b, '[^.!?。！？]*[.!?。！？]|[^.!?。！？]+$') AS s FROM b),
s AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM l), m AS (SELECT doc_id, arg_min(s, (abs(length(s) - 130), i)) AS s FROM s WHERE length(s) BETWEEN 45 AND 180 GROUP BY doc_id),
e AS (SELECT l.doc_id, coalesce(m.s, substring(b, 1, 130)) AS e FROM l LEFT JOIN m ON m.doc_id = l.doc_id) SELECT doc_id, CASE WHEN length(e) > 160 THEN substring(e, 1, 158) || '……' ELSE e END AS excerpt FROM e""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.excerpt(F.coalesce("text", F.lit(""))).alias("excerpt"))


@query("normalized_space", r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t　]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS t FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^[\n ]+|[\n ]+$', '', 'g') AS t FROM a)
SELECT doc_id, CASE WHEN t = '' THEN '' ELSE t || chr(10) END AS text FROM b""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_space(F.col("text")).alias("text"))


@query("body_lines", r"""WITH l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS x, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM (SELECT doc_id, '1234567 codes .12 of' || chr(10) || ' Title: one' || chr(10) || coalesce(text, '') || chr(10) || '（AB）(c1)' AS x FROM documents))
SELECT doc_id, string_agg(CASE WHEN trim(regexp_replace(x, '\s+', ' ', 'g')) = '' THEN '' ELSE x END, chr(10) ORDER BY i) AS body FROM l WHERE i > 1 AND NOT starts_with(lower(trim(regexp_replace(x, '^\s+', ''))), 'title') AND NOT regexp_matches(trim(x), '^([（(][A-Za-z0-9]+[）)]\s*)+$') GROUP BY doc_id""")
def _(spark, sf):
    x = F.concat(F.lit("1234567 codes .12 of\n Title: one\n"), F.coalesce("text", F.lit("")), F.lit("\n（AB）(c1)"))
    return table(spark, sf, "documents").select("doc_id", T.body_lines(x).alias("body"))


@query("article_urls", r"""SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) IN ('blog.tionsh.example.net', 'www.blog.tionsh.example.net') AND regexp_matches(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/\d{3,}') AS is_article FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.is_article_url(F.col("url"), "blog.tionsh.example.net").alias("is_article"))


@query("effect_labels", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount * 10) < 0.2 THEN 'negligible' WHEN abs(l_discount * 10) < 0.5 THEN 'small' WHEN abs(l_discount * 10) < 0.8 THEN 'medium' ELSE 'large' END AS effect, CASE WHEN l_tax < 0.001 THEN '<.001' ELSE regexp_replace(printf('%.3f', CAST(l_tax AS DOUBLE)), '^0', '') END AS p FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.effect_label(F.col("l_discount") * 10).alias("effect"), T.p_text(F.col("l_tax").cast("double")).alias("p"))


@query("score_forms", r"""SELECT c_custkey, CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(c_acctbal AS INTEGER) END AS score, CAST(c_custkey % 9 AS VARCHAR) AS main, CAST(c_nationkey AS VARCHAR) || '|x' AS extra, CASE WHEN c_custkey % 9 BETWEEN 1 AND 3 THEN 'elementary' WHEN c_custkey % 9 BETWEEN 4 AND 6 THEN 'middle' ELSE 'other' END AS level_group,
c_mktsegment AS sheet, CASE WHEN c_custkey BETWEEN 10 AND 9999 THEN CAST(c_custkey AS INTEGER) WHEN c_custkey > 9999 THEN NULL END AS nominal FROM customer""")
def _(spark, sf):
    level = T.level_parts(F.concat((F.col("c_custkey") % 9).cast("string"), F.lit("（"), F.col("c_nationkey").cast("string"), F.lit("）（x）")))
    c = table(spark, sf, "customer").withColumn("level", level)
    sheet = T.sheet_title(F.concat(F.col("c_nationkey").cast("string"), F.lit(" - "), "c_mktsegment"), F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", T.whole_score(F.col("c_acctbal")).alias("score"), "level.main", "level.extra", F.col("level.group").alias("level_group"), sheet.alias("sheet"), T.nominal_length(F.concat(F.lit("t_"), F.col("c_custkey").cast("string"), F.lit("字"))).alias("nominal"))


@query("agreement", "SELECT count(*) AS n, round(corr(a, b), 6) AS r, max(abs(a - b)) AS greatest_error FROM (SELECT CAST(n_chars AS DOUBLE) AS a, CAST(len(string_split(text, ' ')) AS DOUBLE) AS b FROM documents)")
def _(spark, sf):
    d = table(spark, sf, "documents")
    a, b = d.select("doc_id", F.col("n_chars").cast("double").alias("x")), d.select("doc_id", F.size(F.split("text", " ")).cast("double").alias("x"))
    return statistics.agreement(a, b, ["doc_id"], "x").withColumn("r", F.round("r", 6))


@query("mapped_priorities", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END AS rank FROM orders")
def _(spark, sf):
    return reports.mapped(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", {"1-URGENT": 1, "2-HIGH": 2}, "rank").select("o_orderkey", "rank")


@query("reviewed", "SELECT doc_id, source, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'exclude' END AS decision FROM documents")
def _(spark, sf):
    manual = table(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit("exclude").alias("decision"))
    return validation.review(table(spark, sf, "documents").select("doc_id", "source"), manual, ["doc_id"])


@query("overridden", "SELECT doc_id, CASE WHEN quality = 1 AND o_orderstatus <> 'O' THEN o_orderstatus ELSE d.source END AS source, d.lang FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN orders o ON o.o_orderkey = d.doc_id")
def _(spark, sf):
    """A document's source is that of its order, where a label verifies it and it is told."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).otherwise("").alias("source"))
    listed = o.join(table(spark, sf, "labels"), "doc_id").select("doc_id", "source", (F.col("quality") == 1).alias("verified"))
    return reports.override(table(spark, sf, "documents").select("doc_id", "source", "lang"), listed, "doc_id", "verified", ["source"])


@query("publication_years", "SELECT o_orderkey, CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INTEGER) AS year, 9999 AS none FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.publication_year(F.col("o_orderdate").cast("string")).alias("year"), T.publication_year(F.col("o_orderpriority")).alias("none"))


#: Marks of annotation set into the texts: a code that goes, one whose payload stays, one around a word, one in another.
@query("cleaned_annotations", r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\[\]{}（）［］｛｝]', '', 'g') AS x FROM documents)
SELECT doc_id, substring(x, 1, 20) || substring(x, 21, 20) || '，的走' || substring(x, 41) AS text, '[B|{C' AS leftover FROM d""")
def _(spark, sf):
    x = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\[\]{}（）［］｛｝]", "")
    marked = F.concat(F.substring(x, 1, 20), F.lit("[b棒]"), F.substring(x, 21, 20), F.lit("［BQ，］{CQ的}{CP{CC了去}走P}"), F.expr("substring(regexp_replace(coalesce(text, ''), '[\\\\[\\\\]{}（）［］｛｝]', ''), 41)"))
    left = F.array_join(T.leftover_markers(F.concat(F.lit("[B {C "), x)), "|")
    return table(spark, sf, "documents").select("doc_id", T.clean_annotations(marked).alias("text"), left.alias("leftover"))


@query("document_idioms", rf"""WITH {TOK}, r(idiom, a, b) AS (VALUES {', '.join(map(repr, IDIOMS))}) SELECT doc_id, idiom, CAST(1 AS BIGINT) AS hits FROM tok JOIN r ON word IN (a, b) GROUP BY doc_id, idiom HAVING bool_or(word = a) AND bool_or(word = b)""")
def _(spark, sf):
    return linguistic.two_part_idioms(table(spark, sf, "documents"), spark.createDataFrame(IDIOMS, "idiom string, first string, second string"), within="document")


@query("verified_pages", """WITH p AS (SELECT d.doc_id, d.lang AS breadcrumb, '' AS grade, d.source AS genre, d.source, CASE WHEN d.doc_id % 3 > 0 THEN 'y' || d.n_chars ELSE '' END AS published, coalesce(l.quality = 1, false) AS v, 'g' || l.toxic AS g, CASE WHEN l.doc_id % 2 = 0 THEN 'even' ELSE '' END AS n, 'd' || l.doc_id AS day FROM documents d LEFT JOIN labels l USING (doc_id)),
q AS (SELECT doc_id, CASE WHEN v THEN 'all > ' || g || ' > ' || n ELSE breadcrumb END AS breadcrumb, CASE WHEN v THEN g ELSE grade END AS grade, CASE WHEN v AND n <> '' THEN n ELSE genre END AS genre, CASE WHEN NOT v THEN source WHEN source = 'src1' THEN 'src1' ELSE 'src1（' || source || '）' END AS source, CASE WHEN published <> '' THEN published ELSE day END AS published FROM p)
SELECT *, CASE WHEN contains(breadcrumb, 'g1') OR contains(breadcrumb, 'fr') THEN 'first' WHEN contains(breadcrumb, 'g0') THEN 'second' ELSE 'unverified' END AS stage FROM q""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    pages = d.select("doc_id", F.col("lang").alias("breadcrumb"), F.lit("").alias("grade"), F.col("source").alias("genre"), "source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("y"), "n_chars")).otherwise("").alias("published"))
    l = table(spark, sf, "labels")
    listed = l.select("doc_id", (F.col("quality") == 1).alias("verified"), F.concat(F.lit("g"), "toxic").alias("grade"), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("").alias("genre"), F.concat(F.lit("d"), "doc_id").alias("day"))
    return reports.verified_pages(pages, listed, "doc_id", "src1", ["all"], {"first": ["g1", "fr"], "second": ["g0"]})


@query("stratum_scores", "SELECT doc_id, CAST(quality AS INTEGER) AS score FROM labels")
def _(spark, sf):
    return table(spark, sf, "labels").select("doc_id", T.stratum_score(F.concat(F.lit(" "), F.col("quality").cast("string"), F.lit(".0")), [0, 1]).alias("score"))
