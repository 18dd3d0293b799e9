"""Byte-level BPE encoding and decoding; the merges run on a segment tree over the ranks of adjacent pairs.

The tree's root is the lowest rank, and the descent to its leftmost leaf finds the pair. A merge rewrites one symbol
and updates three leaves, each in logarithmic time, until the root holds no mergeable pair. Words recur, so a task
keeps a bounded table of encoded words; decoding goes from ids to bytes and knows nothing of the words.

Defined results: a null text is encoded as the empty text (no ids, digests of the empty string); texts of any length
are encoded whole; repeated rows each get a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that byte-level BPE vocabularies of this family split texts with before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept encoded in a task, at most.
WORDS = 300_000
#: Documents whose ids a task holds at once.
ROWS = 256


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself where it is visible Latin-1,
    the others from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file; ids are int32 arrays."""

    def __init__(self, path: str, words: int = WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        chars = byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.byte_id = np.array([vocab[c] for c in chars], np.int32)
        self.none = len(merges)
        self.merged = np.array([vocab[a + b] for a, b in merges] + [-1], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self.keys, first = np.unique(keys, return_index=True)
        self.ranks = np.append(first, self.none).astype(np.int32)
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        top = max([*vocab.values(), *self.specials.values()])
        self.bytes_of = [b""] * (top + 1)
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        for t, i in self.specials.items():
            self.bytes_of[i] = t.encode()
        self.digits = [str(i) for i in range(top + 1)]
        self.find = regex.compile(PATTERN).findall
        self.loose = re.compile(r" \s").search
        #: Ids, as bytes, of stretches that follow a space and of single pieces of the pattern.
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.words = words

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; `none` where they don't merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], self.none).astype(np.int32)

    def merge(self, block: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of up to the same power of two in length, each with a segment tree of its own; the trees take
        their merges side by side.

        Leaf i of a tree is the rank of the pair that starts at symbol i, every node the least below it. A merge takes
        the leftmost leaf that equals the root, joins its symbols, and sets three leaves and what is above them.
        """
        n, length = len(block), np.array([len(p) for p in block])
        size = 1 << max(1, int(length.max() - 1).bit_length())
        depth = size.bit_length() - 1
        ids = np.full((n, size + 1), -1, np.int32)  # the last column stands for what is beside a piece
        ids[:, :size][np.arange(size) < length[:, None]] = self.byte_id[np.frombuffer(b"".join(block), np.uint8)]
        low = np.full((n, 2 * size), self.none, np.int32)
        low[:, size:] = self.rank(ids[:, :-1], ids[:, 1:])
        for i in range(size - 1, 0, -1):
            np.minimum(low[:, 2 * i], low[:, 2 * i + 1], out=low[:, i])
        after = np.tile(np.append(np.arange(1, size + 1), size).astype(np.int32), (n, 1))
        before = np.tile(np.append(size, np.arange(size)).astype(np.int32), (n, 1))
        after[:, :size][np.arange(1, size + 1) >= length[:, None]] = size
        rows = np.flatnonzero(low[:, 1] < self.none)
        while len(rows):
            root = low[rows, 1]
            i = np.ones(len(rows), np.int64)
            for _ in range(depth):
                i *= 2
                i += low[rows, i] != root
            i -= size
            j = after[rows, i]
            k = after[rows, j]
            h = before[rows, i]
            new = self.merged[root]
            ids[rows, i] = new
            ids[rows, j] = -1
            after[rows, i] = k
            before[rows, k] = i
            before[rows, size] = size
            after[rows, size] = size
            low[rows, size + j] = self.none
            low[rows, size + i] = self.rank(new, ids[rows, k])
            g = np.where(h < size, h, i)
            low[rows, size + g] = np.where(h < size, self.rank(ids[rows, h], new), low[rows, size + i])
            for at in (j.astype(np.int64) + size, i + size, g + size):
                for _ in range(depth):
                    at >>= 1
                    low[rows, at] = np.minimum(low[rows, 2 * at], low[rows, 2 * at + 1])
            rows = rows[low[rows, 1] < self.none]
        return [x[x >= 0] for x in ids]

    def merge_long(self, piece: bytes) -> np.ndarray:
        """As merge, for one piece that has no like to share the work with."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        low = self.rank(ids[:-1], ids[1:]).tolist()
        n, size, none, merged = len(ids), 1 << (len(low) - 1).bit_length(), self.none, self.merged.tolist()
        low += [none] * (size - len(low))
        level = low
        while len(level) > 1:
            level = list(map(min, level[::2], level[1::2]))
            low = level + low
        low.insert(0, none)
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], int] = {}

        def put(i: int, a: int, b: int) -> None:
            if (rank := known.get((a, b))) is None:
                rank = known[a, b] = none if b < 0 else int(self.rank(np.array([a]), np.array([b]))[0])
            i += size
            low[i] = rank
            while i > 1:
                i >>= 1
                low[i] = min(low[2 * i], low[2 * i + 1])

        while (root := low[1]) < none:
            i = 1
            while i < size:
                i *= 2
                i += low[i] != root
            i -= size
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j] = merged[root], -1
            if k < n:
                before[k] = i
                put(j, -1, -1)
            put(i, ids[i], ids[k] if k < n else -1)
            if before[i] >= 0:
                put(before[i], ids[before[i]], ids[i])
        return np.array([i for i in ids if i >= 0], np.int32)

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        by: dict[int, list[str]] = {}
        for p in pieces:
            by.setdefault((len(p.encode()) - 1).bit_length(), []).append(p)
        out = {}
        for bits, some in by.items():
            if bits > 8:
                out.update((p, self.merge_long(p.encode()).tobytes()) for p in some)
                continue
            step = max(1, (1 << 18) >> bits)  # so many that the trees stay in the caches
            for k in range(0, len(some), step):
                part = some[k : k + step]
                out.update(zip(part, (x.tobytes() for x in self.merge([p.encode() for p in part]))))
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids, as bytes, of texts without special tokens.

        The pattern never joins what stands before a space with what follows it, unless more white space follows;
        so texts without such places are cut at their spaces, which is faster and finds the same pieces.
        """
        units, pieces = self.units, self.pieces
        if len(units) > self.words:
            units.clear()
        if len(pieces) > self.words:
            pieces.clear()
        firsts, rests, unknown = [], [], set()
        for t in texts:
            if t.endswith(" ") or self.loose(t):
                firsts.append(self.find(t))
                rests.append([])
            else:
                first, *rest = t.split(" ")
                firsts.append(self.find(first))
                rests.append(rest)
                unknown.update(filterfalse(units.__contains__, rest))
        found = {u: self.find(" " + u) for u in unknown}
        new = set(filterfalse(pieces.__contains__, chain(chain.from_iterable(found.values()), chain.from_iterable(firsts))))
        learnt = self._learn(new)
        pieces.update(learnt)
        for u, ps in found.items():
            units[u] = b"".join(map(pieces.__getitem__, ps))
        out = [b"".join(chain(map(pieces.__getitem__, f), map(units.__getitem__, r))) for f, r in zip(firsts, rests)]
        for p in learnt:  # long stretches hardly recur
            if len(p) > 64:
                del pieces[p]
        for u in found:
            if len(u) > 64:
                del units[u]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; strings of special tokens in them become those tokens."""
        parts, plan = [], []
        for t in texts:
            own: list[bytes | int] = []
            at = 0
            if self.special is not None and any(s in t for s in self.specials):
                for m in self.special.finditer(t):
                    own += [len(parts), np.int32(self.specials[m[0]]).tobytes()]
                    parts.append(t[at : m.start()])
                    at = m.end()
            own.append(len(parts))
            parts.append(t[at:] if at else t)
            plan.append(own)
        got = self._plain(parts)
        return [np.frombuffer(b"".join(x if isinstance(x, bytes) else got[x] for x in own), np.int32) for own in plan]

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                ids = pa.array(encode([t or "" for t in part.column(1).to_pylist()]), pa.list_(pa.int32()))
                yield pa.record_batch([part.column(0), ids], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for every row of encoded (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                text = pa.array([decode(x.as_py() or []) for x in part.column(1)], pa.string())
                yield pa.record_batch([part.column(0), text], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens long, ids_sha256, decoded_sha256): encodes each whole text, decodes the ids, and digests both
    in one pass, so that neither ids nor decoded texts leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path), hashlib.sha256
        for b in batches:
            n, a, d = [], [], []
            for k in range(0, b.num_rows, ROWS):
                for x in c.encode([t or "" for t in b.column(1).slice(k, ROWS).to_pylist()]):
                    ids = x.tolist()
                    n.append(len(ids))
                    a.append(sha(",".join(map(c.digits.__getitem__, ids)).encode()).hexdigest())
                    d.append(sha(c.decode(ids).encode()).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
