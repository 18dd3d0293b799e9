"""Token counts of whole texts by the tokenizers library, with overlap resynchronisation for huge documents.

A huge document is encoded in chunks that overlap, with offsets. Two neighbours are spliced where both begin a piece of
the pre-tokenizer at the same character, far enough from the earlier chunk's cut: the pattern reads from left to right
and looks one character ahead at most, so from a shared start on both find what the whole text gives. If an overlap
holds no such place, it is doubled until it does or the text ends. So no more than a few chunks are in memory at once.

Shorter texts are cut at their spaces, and the library encodes each distinct stretch once (`token_ids`).

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows each get a row; an empty table gives an
empty result; other columns are not read; texts of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quillmill.llm.token_ids import WORDS, Encoder

#: Characters of a chunk and of the first overlap; texts of over two chunks are huge.
CHUNK, OVERLAP = 8_192, 256


class TokenCounter:
    def __init__(self, path: str, words: int = WORDS, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.ids = Encoder(path, words)
        self.lib = self.ids.lib
        self.margin = max([1, *map(len, self.ids.specials)]) + 2
        self.chunk, self.overlap = chunk, overlap
        #: How often an overlap was widened.
        self.widened = 0
        #: Chunks of the last huge document.
        self.chunks = 0

    def _starts(self, text: str, a: int, b: int) -> tuple[list[int], list[bool]]:
        """For each token of text[a:b]: the character at which it starts, and whether a piece starts with it."""
        e = self.lib.encode(text[a:b], add_special_tokens=False)
        pieces = e.word_ids
        return [a + s for s, _ in e.offsets], [i == 0 or p is None or p != pieces[i - 1] for i, p in enumerate(pieces)]

    def huge(self, text: str) -> int:
        end, size = len(text), self.chunk + self.overlap
        at, reach, total, done = 0, min(end, size), 0, 0
        starts, first = self._starts(text, at, reach)  # done: index of the first token not yet counted
        self.chunks = 1
        following = self.chunk
        while reach < end:
            stop = min(end, following + size)
            later, later_first = self._starts(text, following, stop)
            places = {s: i for i, (s, f) in enumerate(zip(later, later_first)) if f and s >= following + self.margin}
            most = min(reach, stop) - self.margin
            found = next((i for i in range(done + 1, len(starts)) if first[i] and starts[i] <= most and starts[i] in places), None)
            if found is not None:
                total += found - done
                done = places[starts[found]]
                starts, first, at, reach = later, later_first, following, stop
                self.chunks += 1
                following = max(following + 1, reach - self.overlap)
                continue
            self.widened += 1  # no common boundary: twice the overlap
            reach = min(end, reach + max(self.overlap, reach - following))
            kept = starts[done]
            starts, first = self._starts(text, at, reach)
            done = starts.index(kept)
            if reach > stop:
                following = max(following + 1, min(stop, reach) - self.overlap)
        return total + len(starts) - done

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, chunks) of each text."""
        short = [t for t in texts if len(t) <= 2 * self.chunk]
        sizes = iter(map(len, self.ids.encode(short)))
        return [(next(sizes), 1) if len(t) <= 2 * self.chunk else (self.huge(t), self.chunks) for t in texts]


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """docs (doc_id, text) → doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), chunks (how many were spliced)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = c.count(texts)
                size = [len(t.encode()) for t in texts]
                yield pa.record_batch([part.column(0), pa.array(size, pa.int64()), pa.array([x for x, _ in n], pa.int64()), pa.array([x > limit for x, _ in n], pa.bool_()), pa.array([c for _, c in n], pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "chunks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, chunks long")


def op3_token_count(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
