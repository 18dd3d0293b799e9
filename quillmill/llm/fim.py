"""Fill-in-middle documents by piece tables.

A document is a list of descriptors (buffer, start, length) over buffers that never change: its text, and one buffer for
each sentinel. A cut splits a descriptor, an arrangement permutes descriptors and puts sentinels between them, the inverse
permutation restores the order; no step copies text. A hash is streamed over the descriptors in pieces of STEP characters,
and text is only put together where an output column needs it.

A document's cuts and form come from a hash of its id, so they don't depend on how rows are dealt out, and reruns agree.
Every row is transformed on its own, in Arrow batches; nothing is shuffled.

Defined results: a null text is the empty text; empty texts and those that hold a sentinel are left plain; a null doc_id
counts as the empty string; repeated rows each get a row (the same one); texts of any length are cut as a whole; an empty
table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Sentinels before the prefix, the middle and the suffix.
SENTINELS = ("<P>", "<M>", "<S>")
#: Characters that a hash takes at once.
STEP = 1 << 16
#: Parts in the order in which each form shows them; each stands after its sentinel.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}


class PieceTable:
    """Descriptors (buffer, start, length), in order; `buffers` are immutable strings that many tables may share."""

    __slots__ = ("buffers", "pieces")

    def __init__(self, buffers: tuple[str, ...], pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def whole(cls, text: str, sentinels: tuple[str, ...] = SENTINELS) -> PieceTable:
        return cls((text, *sentinels), [(0, 0, len(text))])

    def cut(self, at: int) -> int:
        """Splits the descriptor in which character `at` of the document lies; the place of the descriptor that starts
        there. A cut at either end of a descriptor makes an empty one, so two cuts always make three parts."""
        for i, (buffer, start, length) in enumerate(self.pieces):
            if at <= length:
                self.pieces[i : i + 1] = [(buffer, start, at), (buffer, start + at, length - at)]
                return i + 1
            at -= length
        raise IndexError("beyond the document's end")

    def arrange(self, order: tuple[int, ...]) -> PieceTable:
        """Descriptors in that order, each after its sentinel (buffer 1 + its old place)."""
        out = []
        for i in order:
            out += [(1 + i, 0, len(self.buffers[1 + i])), self.pieces[i]]
        return PieceTable(self.buffers, out)

    def permute(self, order: tuple[int, ...]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def text(self) -> str:
        return "".join(self.buffers[b][s : s + n] for b, s, n in self.pieces)

    def sha256(self) -> str:
        h = hashlib.sha256()
        for b, start, n in self.pieces:
            buffer = self.buffers[b]
            for at in range(start, start + n, STEP):
                h.update(buffer[at : min(at + STEP, start + n)].encode())
        return h.hexdigest()


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    out = [0] * len(order)
    for place, i in enumerate(order):
        out[i] = place
    return tuple(out)


def numbers(key: str, seed: int = 1) -> list[int]:
    """Four numbers below 2^32 from the hash of seed and key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(key: str, text: str, seed: int = 1, share: int = 90, suffix_first: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[str, int | None, int | None, PieceTable]:
    """(form, prefix's characters, middle's characters, output)."""
    table = PieceTable.whole(text, sentinels)
    h = numbers(key, seed)
    if not text or h[2] % 100 >= share or any(s in text for s in sentinels):
        return "plain", None, None, table
    first, second = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    table.cut(first)
    table.cut(second)
    form = "spm" if h[3] % 100 < suffix_first else "psm"
    return form, first, second - first, table.arrange(ORDERS[form])


def restored(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> PieceTable:
    """The text's table over the output as its buffer. No part holds a sentinel, and no sentinel's end begins another
    one, so each sentinel stands exactly where the arrangement put it."""
    table = PieceTable.whole(output, sentinels)
    if form == "plain":
        return table
    order = ORDERS[form]
    at, starts = 0, []
    for i in order:
        at = output.index(sentinels[i], at)
        starts.append(at)
        at += len(sentinels[i])
    ends = [*starts[1:], len(output)]
    parts = [(0, s + len(sentinels[i]), e - s - len(sentinels[i])) for s, e, i in zip(starts, ends, order)]
    return PieceTable(table.buffers, parts).permute(inverse(order))


PIECES = "array<struct<buffer: int, start: long, length: long>>"


def fill_in_middle(docs: DataFrame, seed: int = 1, share: int = 90, suffix_first: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs (doc_id, text) → doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain), pieces (the
    output's descriptors: buffer 0 is the text, 1 to 3 the sentinels), output, output_sha256.

    `share` in a hundred documents are transformed, `suffix_first` in a hundred of those with the suffix before the prefix.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    if len(set(sentinels)) != 3 or any(not s for s in sentinels) or any(a.endswith(b[:k]) for a in sentinels for b in sentinels for k in range(1, len(b))) or any(a != b and a in b for a in sentinels for b in sentinels):
        raise ValueError("sentinels must differ, and none may hold or overlap another")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
        for b in batches:
            out = []
            for key, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                text = text or ""
                form, prefix, middle, table = transform(key, text, seed, share, suffix_first, sentinels)
                out.append((len(text), form, prefix, middle, [{"buffer": x, "start": s, "length": n} for x, s, n in table.pieces], table.text(), table.sha256()))
            columns = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), piece, pa.string(), pa.string()]
            yield pa.record_batch([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"])

    rows = docs.selectExpr("doc_id", "coalesce(cast(doc_id AS string), '') AS key", "text")
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, pieces {PIECES}, output string, output_sha256 string")


def restore(rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, keep: tuple[str, ...] = (), text: bool = True) -> DataFrame:
    """rows (output, form, and the columns named by `keep`) → those of `keep`, text (unless not wanted), restored_sha256."""
    fields = [rows.schema[k] for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables = [restored(o, f, sentinels) for o, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            made = [pa.array([t.text() for t in tables], pa.string())] if text else []
            made.append(pa.array([t.sha256() for t in tables], pa.string()))
            yield pa.record_batch([*b.columns[2:], *made], names=[*keep, *(["text"] if text else []), "restored_sha256"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(["text string"] if text else []), "restored_sha256 string"])
    return rows.select("output", "form", *keep).mapInArrow(run, schema)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = restore(made, keep=("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"), text=False)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
