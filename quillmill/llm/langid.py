"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient
descent in numpy, with temperature-calibrated scores and rejection.

A text is the bag of the character n-grams of its lower-cased words. Each n-gram is hashed to a row of an embedding
table, the rows are averaged, and a linear softmax reads the average. Training takes about `per_language` documents of
each language, drawn by hash; their n-gram counts come from the executors, so what the driver holds is bounded by that
number and the table size. Since both layers are linear, prediction uses the product of table and softmax weights.

Defined results: a null text, or one without letters, is `und` with score 0 and is rejected; rows with a null language
are predicted but not learnt from; repeated rows each get a row; an empty table, or one without labels, trains nothing
and every text is `und`; of equal scores the first language by name is told; texts of any length are read whole; other
columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UND = "und"
NOT_LETTERS = regex.compile(r"[^\p{L}\n]+")
#: Words whose sums a task keeps, at most.
WORDS = 200_000


def subwords(words: list[str], bits: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the table, index of the word each belongs to) for all n-grams of <word>, n from 1 to longest."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    rows, of, h = [], [], codes + np.uint64(0x9E3779B9)
    for n in range(1, longest + 1):
        if n > 1:
            h = (h[:-1] * np.uint64(0x100000001B3)) ^ codes[n - 1 :]
        inside = owner[: len(h)] == owner[n - 1 :]
        mixed = (h[inside] ^ (h[inside] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        rows.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
        of.append(owner[: len(h)][inside])
    return np.concatenate(rows), np.concatenate(of)


def letters(tokens: list[str]) -> list[str]:
    """The letters of each token in lower case; tokens must hold no line feed."""
    return NOT_LETTERS.sub("", "\n".join(tokens)).lower().split("\n")


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # 2 ** bits rows, one column for each language
    bias: np.ndarray
    bits: int
    longest: int
    temperature: float = 1.0
    threshold: float = 0.0
    known: dict[str, int] = field(default_factory=dict, repr=False)
    sums: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "sums": None}

    def _rows(self, words: list[str]) -> np.ndarray:
        """For each word, the sum of its n-grams' weights, and their number."""
        out = np.zeros((len(words), len(self.langs) + 1))
        clean = letters(words)
        some = [i for i, w in enumerate(clean) if w]
        if some:
            rows, of = subwords([clean[i] for i in some], self.bits, self.longest)
            at = np.array(some)[of]
            for k in range(len(self.langs)):
                out[:, k] = np.bincount(at, self.weights[rows, k], len(words))
            out[:, -1] = np.bincount(at, minlength=len(words))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Languages and calibrated probabilities."""
        if not self.langs:
            return [UND] * len(texts), [0.0] * len(texts)
        split = [t.split() for t in texts]
        if self.sums is None or len(self.known) > WORDS:
            self.known, self.sums = {}, np.zeros((0, len(self.langs) + 1))
        new = list({w for words in split for w in words if w not in self.known})
        n = len(self.sums)
        if n + len(new) > len(self.known):
            self.sums = np.concatenate([self.sums, *(self._rows(new[k : k + 20_000]) for k in range(0, len(new), 20_000))])
            self.known.update(zip(new, range(n, n + len(new))))
        total = np.array([self.sums[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0) for words in split]).reshape(len(texts), -1)
        count = total[:, -1]
        p = softmax((total[:, :-1] / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        ok = count > 0
        return [self.langs[b] if o else UND for b, o in zip(best, ok)], np.where(ok, p.max(axis=1), 0.0).tolist()


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(bags: list[tuple[str, np.ndarray, np.ndarray, bool]], bits: int, longest: int, dim: int = 16, epochs: int = 4, rate: float = 0.5, keep: float = 0.999, at_most: float = 0.5, seed: int = 42) -> Model:
    """bags: (language, table rows, their counts, whether for calibration).

    The temperature minimises the log loss of the calibration bags, which training does not see. The rejection
    threshold is the score that a share `keep` of them reaches, but at_most at most.
    """
    bags = sorted(bags, key=lambda b: (b[0], len(b[1]), b[1].tobytes(), b[2].tobytes()))
    langs = sorted({b[0] for b in bags})
    rng = np.random.default_rng(seed)
    table, out, bias = rng.normal(0, 1 / dim, (1 << bits, dim)), np.zeros((dim, len(langs))), np.zeros(len(langs))
    fit = [b for b in bags if not b[3]] or bags
    steps, step = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            lang, rows, counts, _held = fit[i]
            w = counts / counts.sum()
            h = w @ table[rows]
            g = softmax(h @ out + bias)
            g[langs.index(lang)] -= 1
            r = rate * (1 - step / steps)
            back = out @ g
            out -= r * np.outer(h, g)
            bias -= 0.1 * r * g
            table[rows] -= r * np.outer(w * min(len(rows), 50), back)
            step += 1
    model = Model(langs, table @ out, bias, bits, longest)
    held = [b for b in bags if b[3]]
    if held and langs:
        z = np.array([(c / c.sum()) @ model.weights[r] + bias for _, r, c, _ in held])
        y = np.array([langs.index(b[0]) for b in held])
        grid = np.geomspace(0.2, 5, 41)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        model.threshold = float(min(at_most, np.quantile(softmax(z / model.temperature).max(axis=1), 1 - keep)))
    return model


def fit(docs: DataFrame, learn: Column, per_language: int = 600, bits: int = 16, longest: int = 4, seed: int = 42, **options) -> Model:
    """Model of the rows of docs (doc_id, text, lang) for which `learn` holds and lang is not null.

    per_language bounds the sample: each language gives about that many documents, those with the lowest hashes.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().withColumn("share", per_language / F.col("count")).select("lang", "share")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    counts = docs.sparkSession.createDataFrame(counts.collect(), "lang string, share double")  # one row for each language
    sample = rows.select("doc_id", "text", "lang", draw.alias("draw")).join(F.broadcast(counts), "lang").where("draw < share")
    held = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed + 1)), F.lit(4)) == 0

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, held_out, found = [], [], []
            for name, text, h in zip(*(b.column(k).to_pylist() for k in range(3))):
                words = [w for w in letters(text.split()) if w]
                if words:
                    count = np.bincount(subwords(words, bits, longest)[0], minlength=1 << bits)
                    at = np.flatnonzero(count)
                    lang.append(name), held_out.append(h), found.append((at, count[at]))
            yield pa.record_batch(
                [pa.array(lang, pa.string()), pa.array(held_out, pa.bool_()), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int32()))],
                names=["lang", "held", "at", "count"],
            )

    got = sample.select("lang", "text", held.alias("held")).mapInArrow(bag, "lang string, held boolean, at array<int>, count array<int>").toArrow()
    bags = [(g.as_py(), at.values.to_numpy(), n.values.to_numpy(), h.as_py()) for g, at, n, h in zip(*(got.column(c) for c in ("lang", "at", "count", "held")))]
    return train(bags, bits, longest, seed=seed, **options)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) → doc_id, lang_pred, score, rejected (und, or a score below the model's threshold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                lang, score = model.predict([t or "" for t in part.column(1).to_pylist()])
                out = [x == UND or s < model.threshold for x, s in zip(lang, score)]
                yield pa.record_batch([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text the model does not reject; no shuffle, since texts are judged where they are read."""

    @F.pandas_udf("boolean")
    def accepted(texts):
        import pandas as pd

        kept = []
        for k in range(0, len(texts), 1024):
            part = [t if isinstance(t, str) else "" for t in texts.iloc[k : k + 1024]]
            kept += [x != UND and s >= model.threshold for x, s in zip(*model.predict(part))]
        return pd.Series(kept, dtype=bool)

    return docs.where(accepted("text"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, ~held_out(F.col("doc_id")))
    is_out = held_out(F.col("doc_id")).alias("held_out")
    return predict(docs, model).select("doc_id", is_out, "lang_pred", "score", "rejected")
