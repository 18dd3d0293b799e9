import glob
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quillmill.llm import bpe, idcodec
from quillmill.llm.token_ids import encoder

PATH = bpe.default_vocabulary()


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000, 300_000])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n).clip(0, 50_256).astype(np.int32)
    ids[n // 2 :] = np.tile([7, 8, 9, 50_256], n)[: n - n // 2]
    assert np.array_equal(idcodec.read_shard(idcodec.write_shard(ids, b"abc"))[0], ids)
    assert idcodec.read_shard(idcodec.write_shard(ids, b"abc"))[1] == b"abc"


def test_extreme_ids_round_trip():
    for ids in (np.full(3000, (1 << 22) - 1), np.zeros(3000), np.random.default_rng(0).integers(0, 1 << 22, 100_000), np.tile(np.arange(3000), 40)):
        ids = ids.astype(np.int32)
        assert np.array_equal(idcodec.read_shard(idcodec.write_shard(ids))[0], ids)
    with pytest.raises(ValueError):
        idcodec.write_shard(np.array([1 << 22], np.int32))


def test_real_ids_take_less_than_order_0():
    """Ids of the given texts: fewer bits than the entropy of single ids and than zlib over 16-bit ids."""
    found = sorted(glob.glob("/root/testdata/sf0.01/documents.parquet"))
    if not found:
        pytest.skip("no test data")
    texts = pq.read_table(found[0], columns=["text"])["text"].to_pylist()
    ids = np.concatenate([np.append(x, 2) for x in encoder(PATH).encode([t or "" for t in texts])]).astype(np.int32)
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    shard = idcodec.write_shard(ids)
    bits = 8 * len(shard) / len(ids)
    assert bits < entropy - 1 and len(shard) < 0.9 * len(zlib.compress(ids.astype("<u2").tobytes(), 6)), bits
    assert np.array_equal(idcodec.read_shard(shard)[0], ids)


@pytest.mark.parametrize("n,most", [(2_000, 9.0), (20_000, 8.2), (100_000, 7.3), (984_065, 6.2)])
def test_bits_of_shards_of_any_size(n, most):
    """Small shards, too, stay under zlib over 16-bit ids: nothing but a short head stands before the ids."""
    found = sorted(glob.glob("/root/testdata/sf0.01/documents.parquet"))
    if not found:
        pytest.skip("no test data")
    rows = pq.read_table(found[0], columns=["doc_id", "text"]).sort_by("doc_id")["text"].to_pylist()
    ids = np.concatenate([np.append(x, 2) for x in encoder(PATH).encode([t or "" for t in rows])]).astype(np.int32)[:n]
    shard = idcodec.write_shard(ids)
    assert len(shard) < len(zlib.compress(ids.astype("<u2").tobytes(), 6)) and 8 * len(shard) / len(ids) <= most
    assert np.array_equal(idcodec.read_shard(shard)[0], ids)


def test_counts_adapt():
    """The second half has other ids than the first: what is learnt on the way brings them near their entropy."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 256, 30_000), rng.integers(40_000, 40_256, 30_000)
    one = np.concatenate([a, b]).astype(np.int32)
    assert 8 * len(idcodec.write_shard(one)) / len(one) < 10.5 < np.log2(512) + 2
    assert 8 * len(idcodec.write_shard(a.astype(np.int32))) / len(a) < 8.8


@pytest.mark.parametrize("block", [1 << 22, 5000, 999])
def test_blocks_stand_alone(block, monkeypatch):
    monkeypatch.setattr(idcodec, "BLOCK", block)
    ids = np.random.default_rng(7).zipf(1.4, 12_345).clip(0, 50_000).astype(np.int32)
    shard = idcodec.write_shard(ids, b"x")
    assert np.array_equal(idcodec.read_shard(shard)[0], ids)
    at = ids[:block]
    assert np.array_equal(idcodec.decode_block(idcodec.encode_block(at), len(at)), at)


def test_history_pays():
    """A passage that a block repeats costs next to nothing, though the counts see only chance."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1500, (400, 128)).astype(np.int32)
    assert len(idcodec.write_shard(np.concatenate([x, x], axis=1).ravel())) < 0.9 * len(idcodec.write_shard(rng.permutation(np.concatenate([x, x], axis=1).ravel())))


@pytest.mark.parametrize("at", [5, 12, 30, 60, 400, -3])
def test_damage_is_found(at):
    shard = bytearray(idcodec.write_shard(np.arange(1000, dtype=np.int32), b"documents"))
    shard[at] ^= 1
    with pytest.raises(ValueError):
        idcodec.read_shard(bytes(shard))


def test_other_files_are_refused():
    for other in (b"", b"XXXX" + bytes(60)):
        with pytest.raises(ValueError):
            idcodec.read_shard(other)


@pytest.mark.parametrize("shard", [1 << 21, 300])
def test_documents(awkward, empty, shard, monkeypatch):
    monkeypatch.setattr(idcodec, "SHARD", shard)
    lib, want, start = Tokenizer.from_file(PATH), [], 0
    for r in sorted(awkward.select("doc_id", "text").collect()):
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = idcodec.read_documents(idcodec.write_documents(awkward, PATH)).collect()
    assert sorted(map(tuple, got)) == want
    assert idcodec.read_documents(idcodec.write_documents(empty, PATH)).count() == 0


def test_any_kind_of_doc_id(spark):
    docs = spark.createDataFrame([("b", "two words", 1), (None, "x", 2), ("a", None, 3), ("b", "two words", 1), ("c", "y " * 40_000, 4)], "doc_id string, text string, start long")
    got = idcodec.read_documents(idcodec.write_documents(docs, PATH), "string").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, "a", "b", "b", "c"]
    assert [r.start for r in got[1:]] == np.cumsum([r.n_tokens for r in got])[:-1].tolist()


def test_no_part_ends_in_a_small_shard(spark, monkeypatch):
    """A rest after full shards would learn anew from few ids, at several times the cost of an id."""
    monkeypatch.setattr(idcodec, "SHARD", 300)
    docs = spark.createDataFrame([(i, "a " * 99) for i in range(10)], "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        shards = idcodec.write_documents(docs, PATH)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sizes = [r.ids for r in shards.orderBy("seq").collect()]
    total = sum(r.n_tokens for r in idcodec.read_documents(shards).collect())
    assert sum(sizes) == total > 900 and min(sizes) >= 150 and max(sizes) <= 600, sizes
