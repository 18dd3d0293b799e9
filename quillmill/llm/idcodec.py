"""Token ids as compressed binary shards: an adaptive context-mixing range coder over independent, checksummed blocks.

A block is coded in lanes, stretches of its ids that take their steps side by side in numpy, and all lanes share what the
block has learnt. Nothing is known at its start, and nothing but its own ids tells the model: as a lane moves on, the counts
of order 2 (after two frequent ids), of order 1 (after one) and of order 0 are made anew from all ids that the lanes
have coded so far, at steps that grow in proportion; ids never seen take classes of size, whose shares are learnt, too. Beside
the counts, each lane has its own order-2 history: the id that last followed the same two ids, in slots with a check. The
chance that this guess holds mixes, in the logistic domain and with weights learnt at every step, how often guesses held in
this state with what the counts say of it; it is coded first, and the counts code what it doesn't settle. A block can be
decoded alone: the decoder learns what the encoder learnt.

Shard format, little-endian: the fixed head (HEADER) and the packed documents (an Arrow stream of doc_id and length); for
each block its bytes u32 and crc32 u32; crc32 of all that u32; the blocks: words of each lane u32, then the lanes' words.

Defined results: a null text is encoded as empty and so holds the end id alone; documents with equal doc_id follow one
another; rows without doc_id come first; texts of any length are one document of one shard; columns other than doc_id
and text are not read; an empty table writes no shard; a damaged block or head raises ValueError.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.plans.scratch import materialize

MAGIC, VERSION = b"QMID", 4
#: Magic, version, ids, ids of a block, blocks, bytes of the documents.
HEADER = struct.Struct("<4sBQIII")
#: Ids of a shard, about (a document never spans two shards; a part's last shard has up to a third more), and of a block.
SHARD, BLOCK = 3 << 20, 4 << 20
#: Lanes of a block, at most, and steps from which a block has more than one.
LANES, STEPS = 4096, 1024
#: Fixed values of the format: kinds of ids (the last stands for all but the most frequent), contexts of two ids at most,
#: slots of a lane's history, bits of a chance, of a count, of a mixing weight, and of the shares of classes of size.
KINDS, PAIRS, SLOTS, CHANCE, COUNT, WEIGHT, CLASS = 2048, 2047, 512, 12, 10, 16, 12
#: Fixed values of the format: how often contexts of one and of two ids, and ids in them, must have been seen to count.
SINGLE, PAIR, LEAST = 6, 10, 2
#: Fixed values of the format: what each entry of a context costs its chance, when asked first and when asked again.
COST, COST2 = 0.6, 0.1
#: An id beyond all: what stands before a lane.
NONE, IDS = 1 << 22, 22
#: States (the last three outcomes of the history, as bits) in which it is in use, and the logits they begin with.
IN_USE = np.array([0, 1, 0, 1, 0, 1, 1, 1], bool)
BEGIN = np.array([-550, -320, -270, 80, -150, 270, 190, 500])
#: Steps that the encoder looks up together, at least, and about how many ids.
CHUNK, TOGETHER = 8, 1 << 16
#: Lanes that are turned from rows to columns together, for the processor's cache.
TILE = 16
WORD, BOTTOM, LOW = np.uint64(32), np.uint64(1 << 32), np.uint64(0xFFFFFFFF)
FULL = 1 << CHANCE
_p = np.arange(FULL) + 0.5
#: Logit of a chance in 256ths, and back.
STRETCH = np.rint(np.log(_p / (FULL - _p)) * 256).astype(np.int64)
MIDDLE = 2047
SQUASH = np.clip(np.rint(FULL / (1 + np.exp(-np.arange(-MIDDLE, MIDDLE + 1) / 256))), 32, FULL - 32).astype(np.int64)


def _spread(counts: np.ndarray, owner: np.ndarray, total: int) -> np.ndarray:
    """Whole shares of `total`, 1 at least, of the counts of each owner (sorted); what is left goes to its greatest one."""
    if not len(counts):
        return counts
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.diff(first, append=len(owner))
    sums = np.add.reduceat(counts, first)
    share = counts * np.repeat(total - sizes, sizes) // np.repeat(sums, sizes) + 1
    top = np.flatnonzero(counts == np.repeat(np.maximum.reduceat(counts, first), sizes))
    top = top[np.r_[True, owner[top[1:]] != owner[top[:-1]]]]
    share[top] += total - np.add.reduceat(share, first)
    return share


def _runs(values: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different values (below 2^31), in order, and how often each is there, if each counts `times`."""
    if times is None:
        v = np.sort(values.ravel())
    else:
        both = np.sort(values << 32 | times)
        v, times = both >> 32, both & 0xFFFFFFFF
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
    return v[first].astype(np.int64), np.diff(first, append=len(v)) if times is None else np.add.reduceat(times, first) if len(v) else first


class Tables:
    """Large tables that the counts of a task's blocks fill one after another."""

    def __init__(self):
        self.entry_of = np.full((1 + KINDS + PAIRS) * KINDS, -1, np.int32)
        self.slot = np.zeros(KINDS * KINDS, np.int16)
        self.entries = np.zeros(0, np.int64)

    def begin(self) -> Tables:
        """For another block."""
        self.often, self.counted = np.zeros(1, np.int64), 0
        return self

    def count(self, x: np.ndarray) -> np.ndarray:
        """How often each id is in x, which only grows."""
        new = np.bincount(x[self.counted :].ravel(), minlength=len(self.often))
        new[: len(self.often)] += self.often
        self.often, self.counted = new, len(x)
        return new

    def fill(self, one: np.ndarray, pairs: np.ndarray) -> None:
        """Slots of contexts: those of one id, then those of two."""
        self.slot.reshape(KINDS, KINDS)[:] = one[:, None]
        self.slot[pairs] = one.max() + 1 + np.arange(len(pairs))

    def hold(self, entries: np.ndarray) -> None:
        self.entry_of[self.entries] = -1
        self.entries = entries
        self.entry_of[entries] = np.arange(len(entries))


@lru_cache(maxsize=1)
def _tables() -> Tables:
    return Tables()


class Counts:
    """What the ids coded so far, x (steps, lanes), say of the next ones; with no steps, nothing."""

    def __init__(self, x: np.ndarray, tables: Tables):
        often = tables.count(x)
        seen_ids = np.flatnonzero(often)
        self.limit = len(often)
        order = np.argsort(-often, kind="stable")[: KINDS - 1]
        self.top = order[often[order] > 0]
        self.kind = np.full(self.limit + 1, KINDS - 1, np.int16)
        self.kind[self.top] = np.arange(len(self.top))
        c = self.kind.take(x)
        before = np.full((2, x.shape[1]), KINDS - 1, np.int16)
        before = np.concatenate([before, c])[: len(c) + 1]
        context = (before[1 : len(c) + 1].astype(np.int32) << 11) + before[: len(c)]
        pairs, at_pair = _runs(context)
        at_one = np.bincount(pairs >> 11, at_pair, KINDS)
        singles = np.flatnonzero(at_one >= SINGLE)
        often_pair = at_pair >= PAIR
        pairs, at_pair = pairs[often_pair], at_pair[often_pair]
        if len(pairs) > PAIRS:
            pairs = np.sort(pairs[np.argsort(-at_pair, kind="stable")[:PAIRS]])
        one = np.zeros(KINDS, np.int16)
        one[singles] = 1 + np.arange(len(singles))
        tables.fill(one, pairs)
        self.slot = tables.slot
        slots, self.singles = 1 + len(singles) + len(pairs), len(singles)
        self.one = one
        # from here on, the different kinds of each slot and their counts stand for the ids
        key = self.slot.take(context).astype(np.int32)
        key <<= 11
        key += c
        key, at_key = _runs(key)
        slot, paired = key >> 11, np.searchsorted(key, (1 + len(singles)) << 11)
        last = one.take(pairs >> 11).astype(np.int64).take(slot[paired:] - 1 - len(singles))  # of contexts of two, that of one
        key1 = (last << 11) + (key[paired:] & KINDS - 1)
        entries, counts = _runs(np.concatenate([key[:paired], key1]), at_key)
        entries, counts = np.concatenate([entries, key[paired:]]), np.concatenate([counts, at_key[paired:]])
        owner = entries >> 11
        known = (counts >= LEAST) & (entries & KINDS - 1 != KINDS - 1)
        entries, counts, owner = entries[known], counts[known], owner[known]
        # of more entries than half a slot's units, the rarest go to order 0
        large = np.flatnonzero(np.bincount(owner) > 1 << COUNT - 1)
        if len(large):
            kept = np.ones(len(owner), bool)
            for first, end in zip(np.searchsorted(owner, large), np.searchsorted(owner, large, "right")):
                kept[first + np.argsort(-counts[first:end], kind="stable")[1 << COUNT - 1 :]] = False
            entries, counts, owner = entries[kept], counts[kept], owner[kept]
        held = np.bincount(owner, minlength=slots)
        tables.hold(entries)
        self.entry_of = tables.entry_of
        missed = self.entry_of.take(key) < 0
        again = np.flatnonzero(missed[paired:])  # asked once more after one id
        last, found, at_again = last[again], self.entry_of.take(key1[again]) >= 0, at_key[paired:][again]
        # a context's ids hold less often than they did: each of its entries costs it a part of one
        chance = lambda total, hits, cost: np.where(held > 0, np.clip(np.maximum(hits - cost * held, 0.2) / (total + 0.4) * FULL, 1, FULL - 32), 0).astype(np.int64)
        self.chance = chance(np.bincount(slot, at_key, slots), np.bincount(slot[~missed], at_key[~missed], slots), COST)
        self.chance2 = chance(np.bincount(last, at_again, slots), np.bincount(last[found], at_again[found], slots), COST2)
        missed[paired + again] = ~found
        # order 0: ids by how often no context held them, and the share of ids never seen, by those seen once
        escaped = often.copy()
        escaped[self.top] = np.bincount(key[missed] & KINDS - 1, at_key[missed], KINDS)[: len(self.top)]
        escaped = escaped[seen_ids]
        weight = np.append(2 * escaped + 1, 2 * int((often == 1).sum()) + 1)
        self.bits = max(16, int(2 * len(weight)).bit_length())
        share0 = _spread(weight, np.zeros(len(weight), np.int64), 1 << self.bits)
        share = _spread(counts, owner, 1 << COUNT)
        upto = np.cumsum(share)
        # shares of a slot add up to 1 << COUNT, so empty slots are taken out of the running sum
        start = upto - share - ((np.cumsum(held > 0) - 1)[owner] << COUNT)
        #: Of each entry, start << 32 | width; entries are those of the slots, of order 0, and that of ids never seen.
        self.width = np.concatenate([share, share0])
        self.span = (np.concatenate([start, np.cumsum(share0) - share0]) << 32 | self.width).astype(np.uint64)
        self.first_rare, self.novel = len(entries), len(entries) + len(seen_ids)
        self.entry0 = np.full(self.limit + 1, self.novel, np.int32)
        self.entry0[seen_ids] = np.arange(self.first_rare, self.novel)
        self.ids = np.concatenate([self.top[entries % KINDS] if len(entries) else entries, seen_ids, [0]])
        self.full = held > 0
        classes = np.minimum(np.arange(IDS + 1) + 1, 16) + 4 * np.bincount(_class(seen_ids), minlength=IDS + 1)
        self.class_share = _spread(classes, np.zeros(len(classes), np.int64), 1 << CLASS).astype(np.uint64)
        self.class_start = np.cumsum(self.class_share) - self.class_share

    def kinds(self, ids: np.ndarray) -> np.ndarray:
        return self.kind.take(np.minimum(ids, self.limit))

    def order0(self, ids: np.ndarray) -> np.ndarray:
        """Entries of order 0, that of ids never seen for others."""
        return self.entry0.take(np.minimum(ids, self.limit))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each unit of each slot with entries, and then of each unit of order 0; where each slot's units begin."""
        begin = np.where(self.full, np.cumsum(self.full) - 1 << COUNT, 0)
        return np.repeat(np.arange(len(self.width), dtype=np.int32), self.width), begin


def _class(ids: np.ndarray) -> np.ndarray:
    """The class of an id never seen: the bits of id + 1, less one."""
    return np.frexp((np.asarray(ids) + 1).astype(float))[1] - 1


def _rows(chosen: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Places of what is true, row by row, and where each row's begin among them."""
    return np.flatnonzero(chosen), [0, *np.cumsum(np.count_nonzero(chosen, axis=1)).tolist()]


def turns(lanes: int, steps: int) -> list[int]:
    """Steps at which the counts are made anew: each time that the lanes have coded twice as much (a quarter more in
    blocks of fewer lanes), if they have a fair part still to go."""
    out, t = [], 0
    while t < steps and (not out or steps - t > t // 8):
        out.append(t)
        t = max(t + 1, t * 2 if lanes >= 1024 else t * 5 // 4)
    return out


class History:
    """The lanes' own order-2 histories and their logistic mixers; all lanes stand at the same step."""

    def __init__(self, lanes: int):
        self.held = np.zeros(lanes * SLOTS, np.int32)  # of each slot, check and id
        self.logit = np.tile(BEGIN, lanes)
        self.weight = np.full(lanes, 1 << WEIGHT - 2)
        self.row8, self.place = np.arange(lanes) * 8, np.arange(lanes) * SLOTS

    def slots(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot and check (as it stands above an id) of the two ids before, a the last one."""
        mix = a * np.int64(0x9E3779B1)
        mix ^= b * np.int64(0x85EBCA77)
        at = mix >> 13
        at &= SLOTS - 1
        at += self.place
        mix >>= 33
        return at, (mix & 255 | 1).astype(np.int32) << IDS

    def guess(self, go: np.ndarray, at: np.ndarray, said: np.ndarray) -> np.ndarray:
        """Chances that the guesses of lanes `go` hold; `at`: lane and state; `said`: logits of the chances by the counts."""
        self.go, self.at, self.said = go, at, said
        self.own, self.by = self.logit.take(at), self.weight.take(go)
        mixed = self.by * said
        mixed >>= WEIGHT
        mixed += self.own
        mixed += MIDDLE
        self.mixed = SQUASH.take(mixed, mode="clip")
        return self.mixed

    def learn(self, hit: np.ndarray) -> None:
        """Of the guesses just made."""
        error = (hit << CHANCE) - self.mixed
        self.logit[self.at] = self.own + (error >> 5)
        error *= self.said
        error >>= 10
        error += self.by
        self.weight[self.go] = error


def _lanes(n: int) -> tuple[int, int]:
    """(lanes, steps) of n ids."""
    lanes = int(np.clip(n // STEPS, 1, LANES))
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray) -> bytes:
    n = len(ids)
    lanes, steps = _lanes(n)
    rows = np.full(lanes * steps, ids[-1], np.int32)
    rows[:n] = ids
    rows = rows.reshape(lanes, steps)
    x = np.full((steps + 2, lanes), NONE, np.int32)  # two rows before the first step
    for k in range(0, lanes, TILE):
        x[2:, k : k + TILE] = rows[k : k + TILE].T
    h = History(lanes)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    before = np.zeros((3, lanes), np.int8)  # whether the last guesses held
    # lanes stand side by side in each row of words, so those that write together write near one another
    out = np.zeros((2 * steps + 8, lanes), np.uint32)
    flat, end = out.ravel(), np.arange(lanes)
    chance_bits, count_bits, class_bits = np.uint64(CHANCE), np.uint64(COUNT), np.uint64(CLASS)

    def carry(go: np.ndarray) -> None:
        at = end.take(go)
        while len(at):  # a carry runs back through words of ones
            at -= lanes
            word = flat.take(at) + np.uint32(1)
            flat[at] = word
            at = at[word == 0]

    def shift(go: np.ndarray) -> None:
        own, at = low.take(go), end.take(go)
        flat[at] = own >> WORD
        end[go] = at + lanes
        low[go] = own << WORD
        size[go] = size.take(go) << WORD

    def put(go: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        """Narrows these lanes to `length` from `begin` on."""
        from_ = low.take(go) + begin
        low[go], size[go] = from_, length
        carry(go[from_ < begin])
        short = go[length < BOTTOM]
        if len(short):
            shift(short)

    starts, tables = turns(lanes, steps), _tables().begin()
    chunk = max(CHUNK, TOGETHER // lanes)
    for t0, t1 in zip(starts, [*starts[1:], steps]):
        m = Counts(x[2 : 2 + t0], tables)
        order0 = np.uint64(m.bits)
        for c0 in range(t0, t1, chunk):
            c1 = min(c0 + chunk, t1)
            now = x[c0 + 2 : c1 + 2]
            # what the lanes' histories guess, and whether it holds
            place, check = h.slots(x[c0 + 1 : c1 + 1].astype(np.int64), x[c0:c1].astype(np.int64))
            new, old = check | now, np.empty_like(check)
            for t in range(c1 - c0):
                at = place[t]
                h.held.take(at, out=old[t], mode="wrap")
                h.held[at] = new[t]
            held = old == new
            state = np.concatenate([before, held])
            before = state[-3:]
            state = state[:-3] << 2 | state[1:-2] << 1 | state[2:-1]
            guessed = IN_USE.take(state)
            guessed &= old ^ check < NONE
            kinds = m.kinds(x[c0 : c1 + 2])
            slot = m.slot.take((kinds[1:-1].astype(np.int32) << 11) + kinds[:-2]).astype(np.int32)
            entry = m.entry_of.take((slot << 11) + kinds[2:])
            span, chance = m.span.take(entry, mode="clip"), m.chance.take(slot)
            start, width, chance64 = span >> WORD, span & LOW, chance.view(np.uint64)
            go, go_from = _rows(guessed)
            go_lane = go % lanes
            e = m.entry_of.take((slot.take(go) << 11) + m.kinds(old.take(go) & NONE - 1))
            said = STRETCH.take((e >= 0) * chance.take(go) * m.width.take(e, mode="clip") >> COUNT)
            at8, hits = h.row8.take(go_lane) + state.take(go), held.take(go)
            # what the first context doesn't hold: after one id, if that was after two, and then order 0
            held &= guessed
            rare, rare_from = _rows((entry < 0) & ~held)
            rare_lane = rare % lanes
            last = m.one.take(kinds[1:-1].take(rare)).astype(np.int32)
            chance2 = np.where(slot.take(rare) > m.singles, m.chance2.take(last), 0)
            entry2 = np.where(chance2 > 0, m.entry_of.take((last << 11) + kinds[2:].take(rare)), -1)
            base2, chance2 = np.flatnonzero(entry2 < 0), chance2.astype(np.uint64)
            entry2[base2] = m.order0(now.take(rare[base2]))
            span2, plain2 = m.span.take(entry2), entry2 >= m.first_rare
            start2, width2, bits2 = span2 >> WORD, span2 & LOW, np.where(plain2, order0, count_bits)
            novel = entry2 == m.novel
            for t in range(c1 - c0):
                g, r = slice(go_from[t], go_from[t + 1]), slice(rare_from[t], rare_from[t + 1])
                go = done = go_lane[g]
                if len(go):
                    p, hit, own = h.guess(go, at8[g], said[g]).view(np.uint64), hits[g], size.take(go)
                    bound = (own >> chance_bits) * p
                    begin = bound * ~hit
                    length, from_ = np.where(hit, bound, own - bound), low.take(go) + begin
                    size[go], low[go] = length, from_
                    carry(go[from_ < begin])
                    h.learn(hit)
                    short = go[length < BOTTOM]
                    if len(short):
                        shift(short)
                    done = go[hit]
                    kept = size.take(done)
                bound = size >> chance_bits
                bound *= chance64[t]
                unit = bound >> count_bits
                begin = start[t] * unit
                unit *= width[t]
                rare = rare_lane[r]
                if len(rare):
                    begin[rare] = own = bound.take(rare)
                    unit[rare] = size.take(rare) - own
                size = unit
                if len(done):
                    begin[done], size[done] = 0, kept
                low += begin
                over = np.flatnonzero(low < begin)
                if len(over):
                    carry(over)
                short = np.flatnonzero(size < BOTTOM)
                if len(short):
                    shift(short)
                if not len(rare):
                    continue
                plain, own = plain2[r], size.take(rare)
                bound = (own >> chance_bits) * chance2[r]
                unit = np.where(plain, own - bound, bound) >> bits2[r]
                put(rare, start2[r] * unit + bound * plain, width2[r] * unit)
                new_ids = rare[novel[r]]
                if len(new_ids):
                    v = now[t].take(new_ids)
                    k = _class(v)
                    unit = size.take(new_ids) >> class_bits
                    put(new_ids, m.class_start[k] * unit, m.class_share[k] * unit)
                    unit = size.take(new_ids) >> k.astype(np.uint64)
                    put(new_ids, (v + 1 - (1 << k)).astype(np.uint64) * unit, unit)
    flat[end] = low >> WORD
    flat[end + lanes] = low & LOW
    # of the last words, as many as tell the lane's interval
    last = end // lanes + 2
    words = out[: last.max()].T
    return last.astype("<u4").tobytes() + words[np.arange(words.shape[1]) < last[:, None]].astype("<u4").tobytes()


def decode_block(payload: bytes, n: int) -> np.ndarray:
    lanes, steps = _lanes(n)
    last = np.frombuffer(payload, "<u4", lanes).astype(np.int64)
    body = np.frombuffer(payload, "<u4", offset=4 * lanes)
    if len(body) != last.sum():
        raise ValueError("a block's lanes don't fill it")
    words = np.zeros((lanes, int(last.max()) + 4), np.uint32)
    words[np.arange(words.shape[1]) < last[:, None]] = body
    code = words[:, 0].astype(np.uint64) << WORD | words[:, 1]  # less the start of the interval
    flat, at_word = np.ascontiguousarray(words.T).ravel(), np.arange(lanes) + 2 * lanes  # as the encoder's
    size = np.full(lanes, (1 << 64) - 1, np.uint64)
    x = np.full((steps + 2, lanes), NONE, np.int32)
    h = History(lanes)
    state = np.zeros(lanes, np.int64)
    found = earlier = np.full(lanes, NONE)  # the last two ids
    chance_bits, count_bits, class_bits = np.uint64(CHANCE), np.uint64(COUNT), np.uint64(CLASS)
    id_bits, width_bits = np.uint64(NONE - 1), np.uint64((1 << COUNT + 1) - 1)
    most, most_class = np.uint64((1 << COUNT) - 1), np.uint64((1 << CLASS) - 1)

    def shift(go: np.ndarray) -> None:
        at = at_word.take(go)
        code[go] = code.take(go) << WORD | flat.take(at, mode="clip")
        at_word[go] = at + lanes
        size[go] = size.take(go) << WORD

    starts, tables = turns(lanes, steps), _tables().begin()
    for t0, t1 in zip(starts, [*starts[1:], steps]):
        m = Counts(x[2 : 2 + t0], tables)
        order0, (places, unit_from) = np.uint64(m.bits), m.places()
        most0, first0 = np.uint64((1 << m.bits) - 1), np.count_nonzero(m.full) << COUNT
        told = (m.span >> WORD << np.uint64(COUNT + 1) | m.span & LOW) << np.uint64(IDS) | m.ids.astype(np.uint64)  # of contexts
        classes = np.repeat(np.arange(IDS + 1), m.class_share.astype(np.int64))
        a, b = (m.kinds(v).astype(np.int64) for v in (found, earlier))
        for t in range(t0, t1):
            slot = m.slot.take((a << 11) + b).astype(np.int64)
            chance = m.chance.take(slot)
            at, check = h.slots(found, earlier)
            old = h.held.take(at)
            go = np.flatnonzero(IN_USE.take(state) & (old ^ check < NONE))
            done = go[:0]
            if len(go):
                guessed = old.take(go) & NONE - 1
                e = m.entry_of.take((slot.take(go) << 11) + m.kinds(guessed))
                said = STRETCH.take((e >= 0) * chance.take(go) * m.width.take(e, mode="clip") >> COUNT)
                p = h.guess(go, h.row8.take(go) + state.take(go), said).view(np.uint64)
                own, mine = size.take(go), code.take(go)
                bound = (own >> chance_bits) * p
                hit = mine < bound
                new = np.where(hit, bound, own - bound)
                size[go], code[go] = new, mine - bound * ~hit
                h.learn(hit)
                short = go[new < BOTTOM]
                if len(short):
                    shift(short)
                done = go[hit]
                kept = size.take(done), code.take(done)
            bound = (size >> chance_bits) * chance.view(np.uint64)
            missed = code >= bound
            missed[done] = False
            rare = np.flatnonzero(missed)
            unit = np.maximum(bound >> count_bits, np.uint64(1))  # without a context, or where the guess held: not used
            d = np.minimum(code // unit, most)
            d[rare] = 0
            one = told.take(places.take(unit_from.take(slot) + d.view(np.int64)))
            found, earlier = (one & id_bits).view(np.int64), found
            one >>= np.uint64(IDS)
            length = (one & width_bits) * unit
            one >>= np.uint64(COUNT + 1)
            begin = one * unit
            begin[rare] = own = bound.take(rare)
            length[rare] = size.take(rare) - own
            code -= begin
            size = length
            if len(done):
                size[done], code[done] = kept
                found[done] = guessed[hit]
            short = np.flatnonzero(size < BOTTOM)
            if len(short):
                shift(short)
            new_ids = rare
            if len(rare):
                last = m.one.take(a.take(rare)).astype(np.int64)
                own, mine = size.take(rare), code.take(rare)
                bound = (own >> chance_bits) * np.where(slot.take(rare) > m.singles, m.chance2.take(last), 0).astype(np.uint64)
                plain = mine >= bound
                unit = np.maximum(np.where(plain, own - bound >> order0, bound >> count_bits), np.uint64(1))
                mine -= np.where(plain, bound, np.uint64(0))
                d = np.minimum(mine // unit, np.where(plain, most0, most)).view(np.int64)
                e = places.take(np.where(plain, first0, unit_from.take(last)) + d)
                span = m.span.take(e)
                code[rare] = mine - (span >> WORD) * unit
                size[rare] = length = (span & LOW) * unit
                found[rare] = m.ids.take(e)
                short = rare[length < BOTTOM]
                if len(short):
                    shift(short)
                new_ids = rare[e == m.novel]
            if len(new_ids):
                unit = size.take(new_ids) >> class_bits
                k = classes.take(np.minimum(code.take(new_ids) // unit, most_class).view(np.int64))
                code[new_ids] -= m.class_start[k] * unit
                size[new_ids] = width = m.class_share[k] * unit
                short = new_ids[width < BOTTOM]
                if len(short):
                    shift(short)
                wide = k.astype(np.uint64)
                unit = size.take(new_ids) >> wide
                off = np.minimum(code.take(new_ids) // unit, (np.uint64(1) << wide) - np.uint64(1))
                code[new_ids] -= off * unit
                size[new_ids] = unit
                short = new_ids[unit < BOTTOM]
                if len(short):
                    shift(short)
                found[new_ids] = off.view(np.int64) + (1 << k) - 1
            x[t + 2] = found
            new = check | x[t + 2]
            state <<= 1
            state &= 7
            state += old == new
            h.held[at] = new
            a, b = m.kinds(found).astype(np.int64), a
    rows = np.empty((lanes, steps), np.int32)
    for k in range(0, lanes, TILE):
        rows[k : k + TILE] = x[2:, k : k + TILE].T
    return rows.ravel()[:n]


def write_shard(ids: np.ndarray, documents: bytes = b"") -> bytes:
    """A shard of non-negative ids below 2^22, and whatever bytes tell its documents."""
    if ids.max(initial=0) >> IDS or ids.min(initial=0) < 0:
        raise ValueError("ids below 0, of 2^22 and more do not fit the format")
    block = max(1, -(-len(ids) // max(1, -(-len(ids) // BLOCK))))  # blocks of one size
    blocks = [encode_block(ids[at : at + block]) for at in range(0, len(ids), block)]
    packed = zlib.compress(documents)
    table = b"".join(struct.pack("<II", len(b), zlib.crc32(b)) for b in blocks)
    head = HEADER.pack(MAGIC, VERSION, len(ids), block, len(blocks), len(packed)) + packed + table
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)


def read_shard(shard: bytes) -> tuple[np.ndarray, bytes]:
    """(ids, the bytes that tell the documents)."""
    if len(shard) < HEADER.size or shard[:4] != MAGIC or shard[4] != VERSION:
        raise ValueError("not a shard of this format")
    _, _, n, block, blocks, packed = HEADER.unpack_from(shard)
    at = HEADER.size + packed
    end = at + 8 * blocks + 4
    if len(shard) < end or zlib.crc32(shard[: end - 4]) != struct.unpack_from("<I", shard, end - 4)[0]:
        raise ValueError("the head is damaged")
    found = [np.zeros(0, np.int32)]
    for i in range(blocks):
        size, own = struct.unpack_from("<II", shard, at + 8 * i)
        payload = shard[end : end + size]
        if len(payload) != size or zlib.crc32(payload) != own:
            raise ValueError(f"block {i} is damaged")
        found.append(decode_block(payload, min(block, n - i * block)))
        end += size
    return np.concatenate(found), zlib.decompress(shard[HEADER.size : HEADER.size + packed])


def write_documents(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Shards of the ids of docs (doc_id, text), an end id after each document, in ascending doc_id order.

    One row for each shard: part and seq (their order), before (ids of the part's earlier shards), ids (its own), shard.
    Texts, not ids, are range-partitioned; the rows are written to the shared folder by Spark's own writer. A shard
    itself tells its documents' ids, of whatever type, and lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillmill.llm.token_ids import encoder

        encode, end = encoder(path).encode, np.array([end_id], np.int32)
        names, kept, size, before, seq, part = [], [], 0, 0, 0, None

        def flush(least: int) -> pa.RecordBatch:
            """A shard of the first documents, as few as hold so many ids."""
            nonlocal names, kept, size, before, seq
            lengths = np.fromiter(map(len, kept), np.int64, len(kept))
            k = int(np.searchsorted(np.cumsum(lengths), least)) + 1
            held, all_names, ids, rest = lengths[:k].sum(), pa.concat_arrays(names), np.concatenate(kept[:k]), kept[k:]
            told = pa.record_batch([all_names[:k], pa.array(lengths[:k])], names=["doc_id", "length"])
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, told.schema) as stream:
                stream.write_batch(told)
            row = [[part], [seq], [before], [held], [write_shard(ids, sink.getvalue())]]
            names, kept, before, seq, size = [all_names[k:]], rest, before + held, seq + 1, size - held
            return pa.record_batch([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "seq", "before", "ids", "shard"])

        for b in batches:
            for k in range(0, b.num_rows, 2048):
                piece = b.slice(k, 2048)
                part, taken = piece.column(2)[0].as_py(), 0
                for i, ids in enumerate(encode([t or "" for t in piece.column(1).to_pylist()]), 1):
                    kept.append(np.concatenate([ids, end]))
                    size += len(kept[-1])
                    if size >= 2 * SHARD:
                        names.append(piece.column(0).slice(taken, i - taken))
                        taken = i
                        yield flush(SHARD)
                if taken < piece.num_rows:
                    names.append(piece.column(0).slice(taken))
        while kept:  # no small rest: it would learn anew from few ids
            yield flush(-(-size // 2) if size > SHARD * 4 // 3 else size)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    rows = dealt.withColumn("part", F.spark_partition_id()).mapInArrow(run, "part int, seq int, before long, ids long, shard binary")
    return materialize(rows, "id-shards")


def read_documents(shards: DataFrame, kind: str = "long") -> DataFrame:
    """doc_id (of type `kind`), start (ids of all documents before it), n_tokens, ids_crc32, from the shards' bytes; only
    the numbers of ids that come before each shard stand beside them."""
    parts = shards.groupBy("part").agg(F.sum("ids")).collect()  # one row for each partition
    upto = sorted(map(tuple, parts))
    starts = dict(zip((p for p, _ in upto), np.cumsum([0] + [n for _, n in upto]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                part, before, shard = (b.column(c)[r].as_py() for c in range(3))
                ids, told = read_shard(shard)
                names, lengths = pa.ipc.open_stream(told).read_next_batch().columns
                ends, raw = np.cumsum(lengths.to_numpy()), ids.astype("<u4", copy=False).data
                first = ends - lengths.to_numpy()
                crc = [zlib.crc32(raw[a:z]) for a, z in zip(first.tolist(), ends.tolist())]
                yield pa.record_batch([names, pa.array(first + before + starts[part], pa.int64()), lengths, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "before", "shard").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op10_id_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_documents(write_documents(docs, public_tokenizers.path("byte_bpe_50k.json")), docs.schema["doc_id"].dataType.simpleString())
