"""Chroma audio fingerprints of media columns, and their alignment.

A recording's frames give energies of the 12 pitch classes. Integral-image filters over frames x pitch classes compare
neighbouring areas, and each answer is quantised to two bits: 16 filters make one packed 32-bit integer a frame.
Two recordings are aligned by an offset histogram of the integers they share, and the share of differing bits at the
fullest offset tells how well they agree.

On Spark: recordings with equal fingerprints form a class; classes lie in pages of about PAGE bytes, and a stated set of
query classes streams past each page; each recording gets its class's row. Nothing pairs up copies.

Defined results: null, empty and too short recordings have an empty fingerprint, are a class of their own and align
with nothing; repeated rows each get a row; equal counts of offsets go to the smaller offset; an empty table gives an
empty result; other columns are not read. Frames of a recording are computed in pieces, and offsets of an integer that
fills much of both recordings (silence, a held tone) are counted by convolution, so hours of sound stay in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.plans.scratch import materialize

RATE, FRAME, HOP = 4000, 1024, 256
FILTERS = 16
#: Bytes of the fingerprints that a task holds, about.
PAGE = 4 << 20
#: Frames that are transformed at once, and pairs of frames that are listed at once.
FRAMES, PAIRS = 4096, 1 << 18
GRAY = np.array([0, 1, 3, 2], np.uint32)


def pitch_classes(frame: int = FRAME, rate: int = RATE, low: float = 55.0, high: float = 1800.0) -> np.ndarray:
    """(bins, 12): the pitch class of each frequency bin between low and high."""
    hz = np.fft.rfftfreq(frame, 1 / rate)
    out, some = np.zeros((len(hz), 12)), (hz >= low) & (hz <= high)
    out[np.flatnonzero(some), np.round(12 * np.log2(hz[some] / 440.0)).astype(int) % 12] = 1
    return out


CLASSES, WINDOW = pitch_classes(), np.hanning(FRAME)


def chroma(pcm: np.ndarray) -> np.ndarray:
    """(frames, 12) of 16-bit samples: energies of the pitch classes, each frame of length 1 (or 0 in silence)."""
    n = (len(pcm) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(pcm, FRAME)[::HOP][:n]
    x = np.concatenate([np.abs(np.fft.rfft(frames[k : k + FRAMES].astype(np.float32) * WINDOW, axis=1)) ** 2 @ CLASSES for k in range(0, n, FRAMES)])
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(size > 1e-6, x / np.maximum(size, 1e-6), 0.0)


def areas(k: int) -> tuple[int, int, int, int]:
    """Filter k: its kind (0 to 3), first pitch class, height in pitch classes and width in frames."""
    return k % 4, 3 * k % 10, (2, 4, 3, 6)[k // 4], (4, 8, 6, 12)[(k + k // 4) % 4]


def fingerprint(x: np.ndarray) -> np.ndarray:
    """Packed integers of chroma frames x, one for each frame at which the widest filter fits."""
    widest = max(areas(k)[3] for k in range(FILTERS))
    n = len(x) - widest + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    around = np.concatenate([x, x[:, :10]], axis=1)  # pitch classes go round
    image = np.zeros((len(x) + 1, around.shape[1] + 1))
    image[1:, 1:] = around.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def box(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t + t1, p1] - image[t + t0, p1] - image[t + t1, p0] + image[t + t0, p0]

    out = np.zeros(n, np.uint32)
    for k in range(FILTERS):
        kind, p, h, w = areas(k)
        half, mid = w // 2, p + h // 2
        if kind == 0:  # earlier against later
            a, b = box(0, half, p, p + h), box(half, w, p, p + h)
        elif kind == 1:  # lower against higher
            a, b = box(0, w, p, mid), box(0, w, mid, p + h)
        elif kind == 2:  # one diagonal against the other
            a, b = box(0, half, p, mid) + box(half, w, mid, p + h), box(half, w, p, mid) + box(0, half, mid, p + h)
        else:  # the middle against both sides
            third = w // 3
            a, b = 2 * box(third, w - third, p, p + h), box(0, third, p, p + h) + box(w - third, w, p, p + h)
        answer = np.log((1 + a) / (1 + b))
        out = out << np.uint32(2) | GRAY[np.digitize(answer, (-0.2, 0.0, 0.2))]
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float] | None:
    """(offset, hits, bit error) of a in b: a[i] goes with b[i + offset]; None if they share no integer. The error is that
    of the passage that agrees: the stretch where most frames differ in fewer than a quarter of their bits, by the
    greatest sum of what they stay under it."""
    hits = offsets(a, b)
    if not hits.any():
        return None
    best = int(hits.argmax()) - len(a) + 1
    x, y = (a[max(0, -best) :], b[max(0, best) :])
    size = min(len(x), len(y))
    wrong = np.bitwise_count(x[:size] ^ y[:size]).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(8 - wrong)])
    low = np.minimum.accumulate(upto)
    end = int((upto - low).argmax())
    start = int(upto[: end + 1].argmin())
    end = max(end, start + 1)
    return best, int(hits.max()), float(wrong[start:end].sum() / (32 * (end - start)))


def offsets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many equal integers a[i] == b[j] lie at each offset j - i, from 1 - len(a) on."""
    out = np.zeros(len(a) + len(b) - 1 if len(a) and len(b) else 0, np.int64)
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    values, from_a, in_a = np.unique(a[order_a], return_index=True, return_counts=True)
    from_b = np.searchsorted(b[order_b], values, "left")
    in_b = np.searchsorted(b[order_b], values, "right") - from_b
    often = in_a * in_b > 64 * (len(a) + len(b))  # cheaper by convolution, whose sums are exact well below 2^53
    for k in np.flatnonzero(often):
        n = 1 << (len(a) + len(b)).bit_length()
        x, y = np.fft.rfft(a[::-1] == values[k], n), np.fft.rfft(b == values[k], n)
        out += np.rint(np.fft.irfft(x * y, n)[: len(out)]).astype(np.int64)
    some = np.flatnonzero((in_b > 0) & ~often)
    rows = np.repeat(some, in_a[some])  # a row for each such frame of a
    at = order_a[np.repeat(from_a[some] - np.cumsum(in_a[some]) + in_a[some], in_a[some]) + np.arange(len(rows))]
    pairs = np.cumsum(in_b[rows])
    for k in np.split(np.arange(len(rows)), np.searchsorted(pairs, np.arange(PAIRS, pairs[-1] if len(pairs) else 0, PAIRS))):
        n = in_b[rows[k]]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        j = order_b[np.repeat(from_b[rows[k]], n) + within]
        out += np.bincount(j - np.repeat(at[k], n) + len(a) - 1, minlength=len(out))
    return out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = [fingerprint(chroma(np.frombuffer(p[: len(p) // 2 * 2] or b"", "<i2"))).astype("<u4").tobytes() for p in (x.as_py() or b"" for x in b.column(1))]
        yield pa.record_batch([b.column(0), pa.array(prints, pa.binary())], names=["media_id", "print"])


def fingerprints(media: DataFrame) -> DataFrame:
    """media (media_id long, pcm binary: 16-bit little-endian samples at RATE) → media_id, print binary."""
    return media.select("media_id", "pcm").mapInArrow(_prints, "media_id long, print binary")


class Page:
    """Fingerprints (ids, prints) with an index of their integers."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]) -> None:
        self.ids, self.prints = ids, prints
        values = np.concatenate([np.zeros(0, np.uint32), *prints])
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.who = np.repeat(np.arange(len(prints), dtype=np.int32), list(map(len, prints)))[order]

    def sharing(self, p: np.ndarray, least_hits: int) -> np.ndarray:
        """Places of those that share enough integers with p to reach least_hits at all."""
        u, times = np.unique(p, return_counts=True)
        lo, hi = np.searchsorted(self.values, u, "left"), np.searchsorted(self.values, u, "right")
        shared = np.zeros(len(self.prints), np.int64)
        some = np.flatnonzero(hi > lo)
        lo, n, times = lo[some], (hi - lo)[some], times[some]
        ends = np.cumsum(n)
        for k in np.split(np.arange(len(some)), np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS))):
            within = np.arange(n[k].sum()) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
            shared += np.bincount(self.who[np.repeat(lo[k], n[k]) + within], np.repeat(times[k], n[k]), len(shared)).astype(np.int64)
        return np.flatnonzero(shared >= least_hits)


def align_queries(prints: DataFrame, every: int = 50, least_hits: int = 8, most_error: float = 0.25) -> DataFrame:
    """prints (media_id, print) → one row for each recording: media_id, class_id (the smallest id with the same
    fingerprint), links (query classes that align with its class, its own not counted), and of the best of them
    match_id, offset, hits and bit_error. Query classes hold an id divisible by `every`.

    Two classes align if at least least_hits of the integers they share lie at one offset and at most most_error of
    the bits there differ.
    """
    prints = materialize(prints, "prints")
    classes = prints.groupBy("print").agg(F.min("media_id").alias("class_id"), F.max((F.col("media_id") % every == 0).cast("int")).alias("query"))
    classes = materialize(classes, "print-classes")
    some = classes.where("class_id is not null and length(print) > 0").select("class_id", "print", "query")
    pages = max(1, -(-(some.agg(F.sum(F.length("print"))).first()[0] or 0) // PAGE))
    # a page's classes, then every query, stream through one task; only the page is held
    page = F.pmod(F.xxhash64("class_id"), F.lit(pages)).cast("int")
    held = some.select(page.alias("page"), F.lit(0).alias("asks"), "class_id", "print")
    asked = some.where("query = 1").select(F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page"), F.lit(1).alias("asks"), "class_id", "print")
    meet = held.unionByName(asked).repartition("page").sortWithinPartitions("page", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, own, index = None, [], [], None
        for b in batches:
            out = []
            for k, asks, i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if k != at:
                    at, ids, own, index = k, [], [], None
                p = np.frombuffer(p.as_py(), "<u4")
                if not asks:
                    ids.append(i)
                    own.append(p)
                    continue
                index = index or Page(ids, own)
                for j in index.sharing(p, least_hits):
                    if ids[j] != i and (got := align(own[j], p)) and got[1] >= least_hits and got[2] <= most_error:
                        out.append((ids[j], i, *got))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.record_batch([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["class_id", "match_id", "offset", "hits", "bit_error"])

    found = meet.mapInArrow(run, "class_id long, match_id long, offset long, hits long, bit_error double")
    best = found.groupBy("class_id").agg(F.count("*").alias("links"), F.min(F.struct("bit_error", (-F.col("hits")).alias("less"), "match_id", "offset", "hits")).alias("b"))
    best = best.select("class_id", "links", "b.match_id", "b.offset", "b.hits", "b.bit_error")
    of = materialize(classes.join(best.hint("merge"), "class_id", "left").fillna({"links": 0}).drop("query"), "print-rows")
    return prints.join(of.hint("merge"), "print").select("media_id", "class_id", "links", "match_id", "offset", "hits", "bit_error")


def _melodies(batches: Iterator[pa.RecordBatch], note: float, spread: float) -> Iterator[pa.RecordBatch]:
    t = np.arange(int(note * RATE)) / RATE
    hz = 110.0 * 2 ** (np.arange(24) / 12)
    tones = (12_000 * np.sin(2 * np.pi * hz[:, None] * t) * np.hanning(len(t)) ** 0.25).astype("<i2")
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part, pcm = b.slice(k, 256), []
            for v, q in zip(part.column(1), part.column(2)):
                x = [0.0 if c is None or not np.isfinite(c) else c for c in (q.as_py() or []) + (v.as_py() or [])]
                pcm.append(tones[np.clip((np.array(x) / spread + 1) * 12, 0, 23).astype(int)].tobytes() if x else b"")
            yield pa.record_batch([part.column(0), pa.array(pcm, pa.binary())], names=["media_id", "pcm"])


def melodies(vectors: DataFrame, note: float = 0.128, spread: float = 0.25) -> DataFrame:
    """A media column derived from vectors (media_id, embedding, quoted or null): each component is a note of an 8-second
    recording (for 64 components; notes last two hops), its pitch one of 24 semitones by the component's value; the notes of `quoted` stand
    before them. 16-bit samples at RATE."""
    return vectors.select("media_id", "embedding", "quoted").mapInArrow(lambda batches: _melodies(batches, note, spread), "media_id long, pcm binary")


def melody_fingerprints(vectors: DataFrame, note: float = 0.128, spread: float = 0.25) -> DataFrame:
    """`fingerprints` of `melodies`, with the samples of a few recordings held at a time: they don't leave the task."""
    return vectors.select("media_id", "embedding", "quoted").mapInArrow(lambda batches: _prints(_melodies(batches, note, spread)), "media_id long, print binary")


def with_quotes(vectors: DataFrame, every: int = 50) -> DataFrame:
    """vectors (media_id, embedding) with quoted: in one recording of four, a passage of the query `every` * (id // every),
    from a place that depends on the id."""
    theme = vectors.where(F.col("media_id") % every == 0).groupBy("media_id").agg(F.first("embedding").alias("theme")).select(F.col("media_id").alias("_of"), "theme")
    of = (F.floor(F.col("media_id") / every) * every).cast("long")
    j = vectors.withColumn("_of", of).join(theme, "_of", "left")
    passage = F.slice("theme", (F.col("media_id") % 16 + 1).cast("int"), 40)
    return j.select("media_id", "embedding", F.when((F.col("media_id") % 4 == 1) & (F.col("media_id") % every != 0) & F.col("theme").isNotNull(), passage).alias("quoted"))


def op9_chroma(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("media_id"), "embedding")
    return align_queries(melody_fingerprints(with_quotes(vectors)))
