"""Main text of web pages; site templates are found by counting hashed subtrees over the pages of each host.

A page is read into elements and blocks. Its main mass is its article, or the element that holds most of its text.
Subtrees beside the main mass are hashed by their shape: their place, elements and classes, without texts, which change
from page to page in menus, adverts and footers. Block elements inside it are hashed with their texts, and those that a
class names as furniture or that mostly hold links by their shape, too. Spark counts, for each host, in how many different
texts each hash occurs; subtrees recurring in at least `share` of them, `least` at least, are templates.

On hosts of `least` texts or more the counts decide, and no rule by markup does: the whole page without its templates is
the text, inside the article and beside it. Only where what is left beside the main mass is under BESIDE of all that is
left, it is odd furniture of that one page and goes, too. Hosts with fewer texts can't be counted; there, rules for
furniture by markup (menus, headers, footers, sidebars, notices, adverts, forms, comments) take it from the main mass, and
in an article they only know containers of adverts, links and comments.

Copies and near copies of an article count once, so that they don't make it a template: pages with the same main text are
one, and a page of whose word pairs less than OWN are found on no other text of its host is a near copy, which counts
together with those that agree on the least hash of the other pairs. A page whose template is that much longer than its own
text looks the same; then the template stays, and no text is lost.

Defined results: null and empty html give an empty text; broken markup is read as far as it goes; repeated rows each
get a row; an empty table gives an empty result; pages without a host form a host of their own; pages are read whole,
whatever their length; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.plans.scratch import materialize

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?](?:[^>"']|"[^"]*"|'[^']*')*+>|<[a-zA-Z/!?][^>]*+(?:>|\Z)|[^<]+|<""", re.S | re.I)
NAME = re.compile(r"</?\s*([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: HTML's elements without content, and those that begin a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements, and words of class, id and role attributes, that mark furniture.
DROP = set("nav footer aside form head button select option input label dialog object canvas audio video map menu fieldset".split())
MARKS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer colophon sidebar aside widget widgets cookie cookies consent gdpr notice notices banner popup modal overlay alert newsletter subscribe subscription signup login ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion share sharing social comment comments commentlist reply replies respond disqus related recommended recommendations form search searchbox pagination pager toolbar skip contentinfo complementary dialog".split()
)
#: Those that count inside an article, and there on containers alone: a paragraph may be of class "notice".
MARKS_INSIDE = MARKS - set("header masthead topbar footer colophon aside notice notices banner popup modal overlay alert form search searchbox skip contentinfo complementary dialog".split())
CONTAINERS = set("div section ul ol aside details menu nav footer header table span".split())
WORDS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")
#: Words after a mark that leave it one ("share-box"), those that only do without other words ("share-wrapper"), and
#: those that tell about a page with or without the furniture ("no-sidebar").
PARTS = set("bar bars block blocks bottom box button buttons feed icon icons item items left link links list panel right slot top unit".split())
WRAPS = set("area container group holder inner outer section wrap wrapper".split())
STATES = set("no not non with without has have is enabled disabled on off open closed".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    __slots__ = ("name", "parent", "mark", "drop", "main", "label", "parts", "hash", "size", "links", "cut", "made")

    def __init__(self, name: str, parent: Node | None, mark: int, main: bool, label: str):
        self.name, self.parent, self.mark, self.drop, self.main, self.label = name, parent, mark, False, main, label
        self.parts: list[Node | str | None] = []  # children, text, and None where a block ends
        self.hash = 0
        self.size = self.links = 0  # characters of text, and of those in links
        self.cut = False  # a template takes it
        self.made: list[Node] = []  # of the root: all elements, parents before their children


#: What markup says of an element: nothing, furniture unless the page's own text is in it, never shown.
PLAIN, MARKED, HIDDEN = 0, 1, 2


def _is_mark(token: str, inside_main: bool) -> bool:
    """Whether one class, id or role names furniture: its last word does, apart from words for parts and wrappers."""
    ws = WORDS.findall(token)
    if not STATES.isdisjoint(ws):
        return False
    n, wrapped = len(ws), False
    while n > 1 and (ws[n - 1] in PARTS or ws[n - 1] in WRAPS):
        n, wrapped = n - 1, wrapped or ws[n - 1] in WRAPS
    if n == 0 or ws[n - 1] not in (MARKS_INSIDE if inside_main else MARKS):
        return False
    return not wrapped or MARKS.issuperset(ws[:n])


def _mark(name: str, attributes: dict[str, str], inside_main: bool) -> int:
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
        return HIDDEN
    if name in DROP or (name == "header" and not inside_main):
        return HIDDEN if name in ("head", "select", "option") else MARKED
    if name in ("html", "body", "main", "article", "h1") or (inside_main and name not in CONTAINERS):
        return PLAIN
    return MARKED if any(_is_mark(t, inside_main) for k in ("class", "id", "role") if k in attributes for t in attributes[k].split()) else PLAIN


def _settle(made: list[Node]) -> None:
    """Sets drop. A marked element stays if it holds the page's main element, its only h1, or its article.

    Articles in marked elements are cards or comments if an article with text lies outside of them, or if the text
    outside is longer than theirs. `made` has parents before their children.
    """
    out = {}  # nodes outside of marked and hidden elements
    for n in made:
        out[n] = n.mark == PLAIN and (n.parent is None or out[n.parent])
    inside = {"article", "main", "h1"}
    if any(n.mark == MARKED for n in made):
        holds: dict[Node, set[str]] = {}
        size: dict[Node, int] = {}  # characters of text, without hidden elements
        plain: dict[Node, int] = {}  # characters of text outside of marked elements
        for n in reversed(made):
            own = sum(len(x.strip()) for x in n.parts if isinstance(x, str)) if n.mark != HIDDEN else 0
            size[n] = own + size.get(n, 0) if n.mark != HIDDEN else 0
            plain[n] = own + plain.get(n, 0) if out[n] else 0
            kinds = holds.setdefault(n, set())
            if n.mark == HIDDEN:
                kinds.clear()
            elif n.name in inside or n.main and not (n.parent and n.parent.main):
                kinds.add(n.name if n.name in inside else "main")
            if n.parent is not None:
                size[n.parent] = size.get(n.parent, 0) + size[n]
                plain[n.parent] = plain.get(n.parent, 0) + plain[n]
                holds.setdefault(n.parent, set()).update(kinds)
        h1 = any(out[n] and n.name == "h1" for n in made)
        article = any(out[n] and n.name == "article" and plain[n] for n in made)
        for n in made:
            if n.mark == MARKED:
                kinds = holds[n]
                if "main" in kinds or ("h1" in kinds and not h1) or ("article" in kinds and not article and size[n] >= plain[made[0]]):
                    n.mark = PLAIN
    for n in made:
        n.drop = n.mark != PLAIN or (n.parent is not None and n.parent.drop)


def parse(page: str) -> Node:
    root = here = Node("", None, PLAIN, False, "")
    made = [root]
    for m in TOKEN.finditer(page):
        t = m[0]
        if t[0] != "<" or t == "<":
            here.parts.append(t)
            continue
        if m[1] or t[1] in "!?" or not (n := NAME.match(t)):
            continue  # comments, declarations, and elements whose content is not text
        name = n[1].lower()
        if t[1] == "/":
            at = here
            while at.parent is not None and at.name != name:
                at = at.parent
            if at.parent is not None and (name in BLOCK or here.name not in BLOCK or at is here):
                here = at.parent
                if name in BLOCK:
                    here.parts.append(None)
            continue
        if name == "br":
            here.parts.append(None)
            continue
        if name in VOID:
            if name == "hr":
                here.parts.append(None)
            continue
        if name in BLOCK:  # a block ends an open paragraph, whatever inline elements are open in it
            at = here
            while at.parent is not None and at.name not in BLOCK:
                at = at.parent
            if at.name == "p":
                here = at.parent
            shut = CLOSES.get(name)
            if shut:
                at = here
                while at.parent is not None and at.name not in ("ul", "ol", "dl", "table", "select") and at.name not in shut:
                    at = at.parent
                if at.name in shut:
                    here = at.parent
        found = {a.lower(): v.strip("\"'").lower() for a, v in ATTRIBUTE.findall(t[n.end() : -1])}
        main = here.main or name in ("article", "main") or found.get("role") == "main"
        child = Node(name, here, _mark(name, found, here.main), main, f"{name}.{found.get('class', '')}#{found.get('id', '')}")
        if name in BLOCK:
            here.parts.append(None)
        here.parts.append(child)
        made.append(child)
        if not t.endswith("/>") or name in BLOCK:
            here = child
    _settle(made)
    root.made = made
    return root


def measure(root: Node) -> None:
    """Sets size and links of every element that is shown."""
    for n in reversed(root.made):
        if n.mark == HIDDEN:
            n.size = n.links = 0
            continue
        for x in n.parts:
            if type(x) is str:
                n.size += len(x.strip())
        if n.name == "a":
            n.links = n.size
        if n.parent is not None:
            n.parent.size += n.size
            n.parent.links += n.links


def beside(root: Node, tops: list[Node]) -> list[tuple[Node, str]]:
    """Topmost shown blocks with text outside of the page's main mass, and the path that leads to each.

    The main mass is `tops`, or, if that is the whole page, what one gets to by going into the block that holds more than
    half of the text. There, subtrees count only if a rule marks them or half of their text is links; a subtree with the
    page's h1 never does.
    """
    marked_only = tops == [root]
    mass = set(map(id, tops))
    if marked_only:
        at = root
        while (inner := next((c for c in at.parts if isinstance(c, Node) and c.name in BLOCK and c.mark == PLAIN and 2 * c.size > at.size), None)) is not None:
            at = inner
        mass = {id(at)}
        tops = [at]
    above: set[int] = set()
    for t in tops:
        at = t.parent
        while at is not None and id(at) not in above:
            above.add(id(at))
            at = at.parent
    out, todo = [], [(root, "")]
    while todo:
        n, path = todo.pop()
        for c in n.parts:
            if not isinstance(c, Node) or c.mark == HIDDEN or not c.size or id(c) in mass:
                continue
            if id(c) in above:
                todo.append((c, f"{path}/{c.label}"))
            elif c.name in BLOCK and not _holds(c, "h1") and (not marked_only or c.mark == MARKED or 2 * c.links >= c.size):
                out.append((c, path))
    return out


def _holds(top: Node, name: str) -> bool:
    todo = [top]
    while todo:
        n = todo.pop()
        if n.name == name:
            return True
        todo += [c for c in n.parts if isinstance(c, Node)]
    return False


def shape(top: Node, path: str) -> int:
    """Hash of a subtree's place, elements and classes. Texts only count as there or not, numbers in names not at all,
    and children of one shape that follow one another are one."""
    order, todo = [], [top]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in n.parts if isinstance(c, Node) and c.mark != HIDDEN]
    told: dict[int, str] = {}
    for n in reversed(order):
        inner: list[str] = []
        for c in n.parts:
            x = told.get(id(c), "") if isinstance(c, Node) else "t" if c and not c.isspace() else ""
            if x and (not inner or inner[-1] != x):
                inner.append(x)
        told[id(n)] = DIGITS.sub("#", n.label) + "(" + " ".join(inner) + ")"
    return _signed("shape " + DIGITS.sub("#", path) + "\x00" + told[id(top)])


def inside(tops: list[Node]) -> Iterator[tuple[Node, list[int]]]:
    """Shown blocks of the main mass, outer ones first, and the hashes by which each may be a template. Whoever reads this
    may set `cut`; what stands in a cut block is left out."""
    todo, mass = [c for t in tops for c in t.parts if isinstance(c, Node)], sum(t.size for t in tops)
    while todo:
        n = todo.pop()
        if n.drop or n.cut:
            continue
        if n.name in BLOCK and n.hash:
            furniture = n.name in CONTAINERS and 0 < 2 * n.size < mass and (n.mark == MARKED or 2 * n.links >= n.size) and not _holds(n, "h1")
            yield n, [n.hash, shape(n, "inside")] if furniture else [n.hash]
        if not n.cut:
            todo += [c for c in n.parts if isinstance(c, Node)]


def show(root: Node) -> None:
    """Forgets what rules say of the page: only what is never shown stays dropped."""
    for n in root.made:
        n.drop = n.mark == HIDDEN or (n.parent is not None and n.parent.drop)


def _main(root: Node) -> list[Node]:
    """The outermost article elements, else main, else the whole page."""
    for wanted in ("article", "main"):
        todo, out = [root], []
        while todo:
            n = todo.pop()
            if n.drop:
                continue
            if n.name == wanted:
                out.append(n)
            else:
                todo += [c for c in reversed(n.parts) if isinstance(c, Node)]
        if out:
            return out
    return [root]


def _signed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _hash(top: Node) -> None:
    """Hash of every kept element with its subtree, from the leaves up; white space does not count."""
    order, todo = [], [top]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in n.parts if isinstance(c, Node) and not c.drop]
    for n in reversed(order):
        inner = [str(c.hash) if isinstance(c, Node) else " ".join(c.split()) for c in n.parts if c is not None and not (isinstance(c, Node) and c.drop)]
        n.hash = _signed(n.label + "\x00" + "\x01".join(x for x in inner if x)) if any(inner) else 0


def blocks(tops: list[Node]) -> list[str]:
    """Non-empty blocks in page order, without dropped elements and template subtrees."""
    out, now = [], []

    def end() -> None:
        if text := " ".join(references.unescape("".join(now)).split()):
            out.append(text)
        now.clear()

    todo: list[Node | str | None] = list(reversed([x for t in tops for x in (t, None)]))
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif not x.drop and not x.cut:
            todo += [*([None] if x.name in BLOCK else []), *reversed(x.parts)]
        elif x.name in BLOCK:
            end()
    end()
    return out


#: Word pairs of a page in its sketch, about (all of a shorter page's, under twice as many of any), and the share of them
#: that makes a text its own. A changed word makes two pairs, which no sketch takes for a text of its own.
SKETCH, OWN = 24, 0.15


def sketch(texts: list[str]) -> list[int]:
    """Hashes of the word pairs within blocks, of long pages those below a limit that halves with twice the pairs."""
    found = set()
    for t in texts:
        ws = t.split()
        found.update(map(xxhash.xxh64_intdigest, map(" ".join, zip(ws, ws[1:])) if len(ws) > 1 else ws))
    level = max(0, (len(found) // SKETCH).bit_length() - 1)
    return sorted(x - (1 << 63) for x in found if not x >> (64 - level))[:63]


def subtrees(page: str) -> tuple[int, list[int], list[int]]:
    """Hash of the main text, hashes of the subtrees that may be templates (all different), and sketch."""
    root = parse(page)
    measure(root)
    tops = _main(root)
    texts = blocks(tops)  # as rules have it, for what tells one text from another
    show(root)
    for t in tops:
        _hash(t)
    found = {shape(n, path) for n, path in beside(root, tops)} | {h for _, hs in inside(tops) for h in hs}
    return _signed("\n".join(texts)), sorted(found - {0}), sketch(texts)


#: What is left beside the main mass goes if it is less than this share of all that is left.
BESIDE = 0.05


def _left(tops: list[Node], apart: list[Node]) -> int:
    """Characters of text without cut and dropped subtrees, and without those of `apart`."""
    size, todo, beyond = 0, list(tops), set(map(id, apart))
    while todo:
        n = todo.pop()
        if not n.cut and not n.drop and id(n) not in beyond:
            size += sum(len(x.strip()) for x in n.parts if isinstance(x, str))
            todo += [c for c in n.parts if isinstance(c, Node)]
    return size


def extract(page: str, templates: frozenset[int] | set[int] | None = None) -> tuple[str, int]:
    """(main text, subtrees that templates took). Without `templates`, rules by markup decide; else these alone."""
    root = parse(page)
    tops = _main(root)
    if templates is None:
        return "\n".join(blocks(tops)), 0
    measure(root)
    show(root)
    for t in tops:
        _hash(t)
    taken = 0
    for n, path in beside(root, tops):
        n.cut = shape(n, path) in templates
        taken += n.cut
    for n, hashes in inside(tops):
        n.cut = not templates.isdisjoint(hashes)
        taken += n.cut
    if tops != [root] and (odd := _left([root], tops)) and odd >= BESIDE * (odd + _left(tops, [])):
        tops = [root]
    return "\n".join(blocks(tops)), taken


def _template_counts(pages: DataFrame, share: float, least: int) -> DataFrame:
    """(host, hash, texts): for each host of `least` texts a row with hash 0, and one for each of its templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [subtrees(p or "") for p in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[i] for g in got], pa.list_(pa.int64())) for i in (1, 2))]
            yield pa.record_batch(columns, names=["host", "main", "hashes", "sketch"])

    found = materialize(pages.select("host", "html").mapInArrow(run, "host string, main long, hashes array<long>, sketch array<long>"), "html-subtrees")
    found = found.select("host", F.xxhash64("host", "main").alias("main"), "hashes", "sketch")
    # pages with one main text have one sketch: a pair of words that one text alone has tells that text
    pairs = found.select("host", "main", F.posexplode("sketch").alias("at", "pair")).select(F.xxhash64("host", "pair").alias("pair"), "main", "at")
    alone = pairs.groupBy("pair").agg(F.min("main").alias("main"), F.max("main").alias("other"), F.min("at").alias("at")).where("main = other")
    own = alone.groupBy("main").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("own"))
    mask = F.coalesce("own", F.lit(0).cast("long"))
    near = F.bit_count(mask) < OWN * F.size("sketch")
    shared = F.array_min(F.filter("sketch", lambda x, i: F.getbit(mask, i) == 0))
    named = found.groupBy("main").agg(F.first("host").alias("host"), F.first("sketch").alias("sketch")).join(own, "main", "left")
    named = named.select("main", "host", F.when(near, shared).otherwise(F.col("main")).alias("text"))
    # one row for the text itself (hash 0) and one for each subtree; copies and near copies fall together
    rows = found.select("main", F.explode(F.concat("hashes", F.array(F.lit(0).cast("long")))).alias("hash")).distinct()
    rows = rows.join(named, "main").select("host", "text", "hash").distinct()
    counts = materialize(rows.groupBy("host", "hash").agg(F.count("*").alias("texts")).where(F.col("texts") >= least), "html-counts")
    totals = counts.where("hash = 0").select("host", F.col("texts").alias("all_texts"))
    return counts.join(totals, "host").where((F.col("hash") == 0) | (F.col("texts") >= share * F.col("all_texts"))).select("host", "hash", "texts")


def site_templates(pages: DataFrame, share: float = 0.25, least: int = 5) -> DataFrame:
    """(host, hash): block subtrees that recur across the texts of a host, of which there are `least` at least."""
    return _template_counts(pages, share, least).where("hash <> 0").select("host", "hash")


#: Template subtrees, at most, that are broadcast to the pages (some 10 MB); more of them are joined by a merge.
TABLE = 500_000


def main_text(pages: DataFrame, share: float = 0.25, least: int = 5) -> DataFrame:
    """pages (page_id, url, html) → page_id, url, text, n_chars, n_templates (subtrees that templates took)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    found = materialize(_template_counts(pages, share, least), "html-templates")
    of = found.groupBy("host").agg(F.collect_set("hash").alias("templates"))  # at most all subtrees that recur in a quarter of a host's texts
    few = found.limit(TABLE + 1).count() <= TABLE
    pages = pages.join(F.broadcast(of) if few else of.hint("merge"), "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(p or "", None if t is None else frozenset(t)) for p, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            text = [t for t, _ in got]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array([n for _, n in got], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_templates"])

    return pages.select("page_id", "url", "html", "templates").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_templates long")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
