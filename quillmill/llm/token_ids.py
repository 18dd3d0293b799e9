"""Ids of whole texts by the tokenizers library, each distinct stretch looked up once.

Texts are cut before single spaces, where the pre-tokenizer of byte-level BPE always starts a new piece unless more
white space follows; others go to the library whole. Arrow splits the texts and numbers their distinct stretches, so
Python sees a stretch once a batch and the library sees it once while the task remembers it. Unknown stretches go to the
library many at a time: those of Latin letters, ASCII marks and single line ends are cut into pieces here and only
merged there (its own pre-tokenizer costs about as much as its merges); the others pass its whole pipeline.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stretches whose ids a task keeps, about, and ids kept for each: beyond them it keeps those that it met again.
WORDS, EACH = 800_000, 8
#: Stretches that the library takes at once.
JOINED = 512
#: Characters that are split at once, about.
BATCH = 8_000_000
#: Stretches whose ids are put together at once: their arrays stay in the processor's cache.
SLICE = 1 << 15
#: A stretch whose pieces are told without the library: letters and the marks after them, twice if a line ends within.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
PLAIN = rf"\A[{LETTERS}]+[{MARKS}]*(?:\n[{LETTERS}]+[{MARKS}]*)?\z"
PIECES = re.compile(rf" ?[{LETTERS}]+|[{MARKS}]+|\n").findall


def byte_letters() -> dict[int, str]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others count up
    from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}


#: By byte; NUL stays: it cuts pieces.
WRITTEN = np.array([ord(c) if b else 0 for b, c in sorted(byte_letters().items())], "<u2")


class Encoder:
    def __init__(self, path: str, words: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.specials = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.loose = re.compile(r" \s").search
        vocabulary = self.lib.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids of tokens that begin with a space
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.most = max(1, words)
        self.known: dict[str, int] = {}
        self.pool, self.width, self.again = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
        self.merger = None
        said = json.loads(self.lib.to_str())
        cut, model = said["pre_tokenizer"] or {}, said["model"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if model["type"] == "BPE" and plain and said["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space"):
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.merger = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))  # stretches come once: no cache
            self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\0")

    def forget(self) -> None:
        """Stretches that no later batch held go; all do, if the others would fill half the memory."""
        kept = np.flatnonzero(self.again)
        if len(kept) > self.most // 2 or self.width[kept].sum() > EACH * self.most // 2:
            kept = kept[:0]
            self.again[:] = False
        self.known = dict(zip(compress(self.known, self.again.tolist()), range(len(kept))))  # in order of their places
        self.pool, self.width, self.again = self.pool[np.repeat(self.again, self.width)], self.width[kept], np.zeros(len(kept), bool)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and their numbers of ids."""
        out = [np.zeros(0, np.int32)]
        for k in range(0, len(texts), 8192):
            out += [np.array(e.ids, np.int32) for e in self.lib.encode_batch_fast(texts[k : k + 8192], add_special_tokens=False)]
        return np.concatenate(out), np.fromiter(map(len, out[1:]), np.int32, len(texts))

    def _run(self, lib, part: list[str], text: str) -> tuple[np.ndarray, np.ndarray]:
        """As `whole`, of stretches behind spaces that stand one after another in `text`: only their spaces begin tokens."""
        ids = np.array(lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(part):  # not a byte-level vocabulary
            return self.whole([" " + w for w in part])
        return ids, np.diff(starts, append=len(ids)).astype(np.int32)

    def plain(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "\0".join(PIECES(" " + " ".join(part)))
        return self._run(self.merger, part, text.replace(" ", "Ġ").replace("\n", "Ċ") if text.isascii() else WRITTEN.take(np.frombuffer(text.encode(), np.uint8)).tobytes().decode("utf-16-le"))

    def other(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._run(self.lib, part, " " + " ".join(part))

    def words(self, stretches: list[str]) -> np.ndarray:
        """Places in the pool of these distinct stretches behind a space."""
        if len(self.known) > self.most or len(self.pool) > EACH * self.most:
            self.forget()
        at = np.fromiter(map(self.known.get, stretches, repeat(-1)), np.int64, len(stretches))
        self.again[at[at >= 0]] = True
        names = [stretches[i] for i in np.flatnonzero(at < 0).tolist()]
        if names:
            is_simple = pc.match_substring_regex(pa.array(names), PLAIN).to_pylist() if self.merger else [False] * len(names)
            simple, rest = list(compress(names, is_simple)), [w for w, s in zip(names, is_simple) if not s]
            found = [(f, ws[k : k + JOINED]) for f, ws in ((self.plain, simple), (self.other, rest)) for k in range(0, len(ws), JOINED)]
            ids, width = zip((self.pool, self.width), *[f(ws) for f, ws in found])
            n = len(self.width)
            self.pool, self.width = np.concatenate(ids), np.concatenate(width)
            self.again = np.concatenate([self.again, np.zeros(len(names), bool)])
            self.known.update(zip(simple + rest, range(n, n + len(names))))
            missing = np.flatnonzero(at < 0)
            at[missing] = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        return at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """int32 ids of each text as the library gives them."""
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= BATCH:
                out += self._encode(part)
                part, size = [], 0
        return out + self._encode(part) if part else out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [not (t.endswith(" ") or self.loose(t) or any(s in t for s in self.specials)) for t in texts]
        split = pc.split_pattern(pa.array([t if c else "" for t, c in zip(texts, cut)], pa.large_string()), " ")
        offsets = split.offsets.to_numpy()
        numbered = split.flatten().dictionary_encode()
        index = numbered.indices.to_numpy()
        # a text's first stretch has no space before it: the library takes it alone, behind the pool
        heads, head_width = self.whole([t.split(" ", 1)[0] if c else t for t, c in zip(texts, cut)])
        named = np.ones(len(index), bool)
        named[offsets[:-1]] = False
        seen = np.zeros(len(numbered.dictionary), bool)
        seen[index[named]] = True
        places = np.zeros(len(seen), np.int64)
        places[seen] = self.words(numbered.dictionary.filter(pa.array(seen)).to_numpy(zero_copy_only=False).tolist())
        sizes, pool = np.concatenate([self.width, head_width]), np.concatenate([self.pool, heads])
        first = (np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.int32)
        at = places[index]
        at[offsets[:-1]] = len(self.width) + np.arange(len(texts))
        width, start = sizes[at], first[at]
        ends = np.cumsum(width, dtype=np.int64)
        ids = np.empty(ends[-1], np.int32)
        for k in range(0, len(at), SLICE):
            w = width[k : k + SLICE]
            end = np.cumsum(w, dtype=np.int32)
            from_ = np.repeat(start[k : k + SLICE] - end + w, w)
            from_ += np.arange(len(from_), dtype=np.int32)
            np.take(pool, from_, out=ids[ends[k] - w[0] : ends[k] - w[0] + len(from_)])
        return np.split(ids, ends[offsets[1:] - 1][:-1])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
