"""Near-duplicates by 64-bit SimHash, found at the codewords of a covering code (anchor points).

Each half of a fingerprint gives a 31-bit word. The anchors are the codewords of the binary Hamming code [31, 26],
whose balls of radius 1 cover all words. Two fingerprints at 4 or fewer differing bits differ at 2 or fewer in one
half, so in that half some word lies at 1 or less from both, and the anchor covering it at 2 or less from both: every
fingerprint is replicated to all anchors within covering radius + half the half's threshold (16 a half at most), and
each linked pair meets at an anchor at least once. All 64 bits are compared there.

Defined results: null, empty and blank texts have fingerprint 0 and link to one another; repeated rows each get a row;
a null doc_id comes after all others, and a component of such rows alone has a null component_id; different texts may
share a doc_id; an empty table gives an empty result; near_duplicates reads no columns but doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.components import connected_components
from quillmill.plans.scratch import ROW_KEY, materialize, with_row_key

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Fingerprints compared in one call at most; fuller anchors are cut into pairs of such chunks.
CHUNK = 256


def fingerprint(text: bytes | None, n: int = 4, seed: int = 42) -> int:
    """SimHash of the n-word shingles of a UTF-8 text as a signed 64-bit integer."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    n, joined = min(n, len(words)), b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n + 1].tolist()
    ends = ends[n - 1 :].tolist()
    ones, total, digest = np.zeros(64, np.int64), len(starts), xxhash.xxh64_intdigest
    for k in range(0, total, 1 << 15):  # so that a very long text needs little memory
        h = [digest(joined[a:b], seed) for a, b in zip(starts[k : k + (1 << 15)], ends[k : k + (1 << 15)])]
        ones += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprints(docs: DataFrame, n: int = 4, seed: int = 42, carry: list[str] = []) -> DataFrame:
    """(doc_id, fp long) and the long columns `carry` for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py(), n, seed) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *carry])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.encode("text", "UTF-8").alias("text"), *carry).mapInArrow(run, ", ".join([f"doc_id {kind}, fp long", *(f"{c} long" for c in carry)]))


def _coset_masks() -> list[list[int]]:
    """For each syndrome of the Hamming code [31, 26], all error words of weight 2 or less that have it."""
    out = []
    for s in range(32):
        masks = [0] if s == 0 else [1 << (s - 1)]
        masks += [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s)] if s else []
        out.append(masks)
    return out


def _anchors(half: Column) -> Column:
    """The codewords within 2 of a 31-bit word: bit i - 1 of the word is column i of the parity check."""
    parity = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]
    syndrome = sum((F.bit_count(half.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)) * (1 << k) for k, m in enumerate(parity)), F.lit(0))
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in _coset_masks()])
    return F.transform(F.element_at(masks, syndrome.cast("int") + 1), lambda m: half.bitwiseXOR(m))


def anchor_table(distinct: DataFrame) -> DataFrame:
    """(fp, key): each fingerprint at every anchor it is replicated to; the key's bit 32 tells the half."""
    low31 = F.lit((1 << 31) - 1)
    low = F.col("fp").bitwiseAND(low31)
    high = F.shiftrightunsigned("fp", 32).bitwiseAND(low31)
    keys = F.concat(_anchors(low), F.transform(_anchors(high), lambda k: k.bitwiseOR(F.lit(1 << 32))))
    return distinct.select("fp", F.explode(keys).alias("key"))


def _forest(group: list[int], max_bits: int) -> list[tuple[int, int]]:
    """Links that join all members of a group that linked pairs connect: one fewer than members at most."""
    x, out = np.array(sorted(set(group)), np.int64).view(np.uint64), []
    left = np.arange(len(x))
    while len(left):  # breadth first: each member is compared with those not yet reached
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(x[front][:, None] ^ x[left][None, :]) <= max_bits
            hit = near.any(axis=0)
            out += zip(x[front[near.argmax(axis=0)[hit]]].view(np.int64).tolist(), x[left[hit]].view(np.int64).tolist())
            front, left = left[hit], left[~hit]
    return out


def links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b): links among distinct fingerprints (fp) whose components are those of all pairs at max_bits or fewer
    (4 at most, the reach of the anchors).

    No anchor's pairs are emitted: each comparison returns a spanning forest. Anchors with over CHUNK members are
    dealt out as pairs of chunks, so no task holds a hot anchor, and none of its pairs goes uncompared.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the anchors reach 4 differing bits")
    at = anchor_table(distinct)  # up to 32 rows a fingerprint, which Spark counts as one: its join is never broadcast
    full = at.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    dealt = at.join(full.hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    groups = dealt.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("members"))

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def forest(members: pd.Series) -> pd.Series:
        def one(m: np.ndarray) -> list[dict]:
            if len(m) == 2:
                a, b = int(m[0]), int(m[1])
                return [{"a": a, "b": b}] if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= max_bits else []
            return [{"a": a, "b": b} for a, b in _forest(list(m), max_bits)]

        return members.map(one)

    return groups.select(F.explode(forest("members")).alias("e")).select("e.a", "e.b").distinct()


def _rooted(of: DataFrame, max_bits: int) -> DataFrame:
    """(fp, first, root): the distinct fingerprints of `of`, their smallest doc_id and the root of their component."""
    distinct = materialize(of.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected_components(links(distinct.select("fp"), max_bits))
    return distinct.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, max_bits: int = 4, n: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable over links)."""
    of = materialize(fingerprints(docs, n, seed), "simhash")
    named = _rooted(of, max_bits)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(named.join(least.hint("merge"), "root").select("fp", "component_id"), "simhash-components")
    return of.join(named.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_bits: int = 4, n: int = 4, seed: int = 42) -> DataFrame:
    """The rows of docs, one of each component: the one with the smallest doc_id, rows without one last; among equal
    ids the least row key decides, so the same rows stay in any run. Ids need not be unique; a repeated row stays once."""
    keyed = with_row_key(docs)
    of = materialize(fingerprints(keyed, n, seed, ROW_KEY), "simhash")
    named = materialize(_rooted(of, max_bits).select("fp", "root"), "simhash-components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW_KEY)
    kept = of.join(named.hint("merge"), "fp").groupBy("root").agg(F.min(order).alias("best")).select(*(f"best.{k}" for k in ROW_KEY)).distinct()
    rows = keyed.join(materialize(kept, "simhash-kept").hint("merge"), ROW_KEY, "left_semi").dropDuplicates(ROW_KEY)
    return rows.select(*docs.columns)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
