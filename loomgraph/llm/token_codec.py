"""Token ids in binary files, packed by a range coder over mixed, adaptive context predictions.

Model: order 0 counts the ids of the block so far, order 1 the ids that followed the last one, and order 2 foresees one id from the last two (e2, in hashed slots, with a
confidence that grows on hits and falls on misses). P(x) = w1 P1(x) + w0 P0(x) is mixed exactly: the shares of both lie in one piece for each id, in the order of numbers, and
one step codes the id; e2 has a share w2 of its own before them (what orders 1 and 0 give e2 besides is not added to it, the one departure from a full mix: it costs size only, for ids that e2
foresaw with little confidence). The weights are learnt for each state: e2's confidence and how often the last id was followed. P0 keeps a share for ids not met
yet, as large as in the last window; which ids these are stands in a list of each stream, coded ahead by a fixed distribution over all 16-bit ids. The range coder holds 63 bits and
carries exactly. Everything is integer arithmetic, so that any machine decodes what another has written.

The model moves between windows of ids (a quarter of what the block has coded, 512 steps at most) and is fixed within them; a writer thus looks up whole windows at once. Blocks of BLOCK ids are
independent: each begins with an empty model and has a CRC-32 of its ids. A block is dealt to STREAMS streams, which share its model and have a coder each; numpy codes the same position of all streams of many blocks at once.

File: ``CMR2``, then for each section its length as u32. Section 1 is JSON (block size, counts), section 2 the document ids
(i64), validity (u8) and lengths (u32), deflated, with a CRC-32; then one section for each block: u32 ids, u32 crc of the ids as little-endian
u32, u32 words of 32 bits, which begin with u16 words, then u16 new ids of each stream that has ids. Files are real files in the shared folder, named by the attempt that wrote them; a saved manifest lists the
ones that count, with their order, so retries leave stray files but no wrong ones. Ids fit into 16 bits.

Defined results: a null text is empty, and every document ends with the end id, so an empty one has one id; a null document id comes
first; rows that repeat an id follow each other in the order of their texts. An empty table makes no file. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"CMR2"
BLOCK = 65_536
#: Streams that a block is dealt to: they share its model and are coded side by side.
STREAMS = 32
#: Ids of a stream, at least: a stream costs 12 bytes.
LEAST = 256
#: Characters of a text that deal the rows of one id to tasks.
PREFIX = 64
#: Blocks coded side by side, at most; bounds memory at about 3 MB each.
BESIDE = 64
#: Ids in a file, about.
FILE_IDS = 6_000_000
END_ID = 2
#: Words that a worker keeps, and the characters of the longest one kept. Forgetting costs time and changes no result.
KEPT_WORDS, KEPT_LENGTH = 600_000, 64

_SLOTS = 15
_STATES = 8 * 8
#: Shares of an id are of 2^28, those in the lists of new ids of 2^24.
_BITS, _ONE, _NEW_BITS = 28, 1 << 28, 24
_LEAST, _WORD, _TOP = 1 << 31, (1 << 31) - 1, (1 << 63) - 1
_SURE, _OFTEN = np.arange(_STATES) >> 3, np.arange(_STATES) & 7
#: Hits of order 2, order 1 and order 0 that each state begins with; order 2 does not count without confidence, nor order 1 after an id not followed yet.
_PRIOR = np.stack((1 + 2 * _SURE, 1 + _OFTEN, 4 + 0 * _SURE), axis=1)
_ALLOWED = np.stack((_SURE > 0, _OFTEN > 0), axis=1)
#: log2 of how often an id was followed, 1 to 7 from once on.
_BUCKET = np.concatenate(([0], np.minimum(1 + np.floor(np.log2(np.arange(1, 128))).astype(np.int64), 7)))
#: Where the share of each id begins in the lists of new ids: frequent ids are small in vocabularies that are numbered by merges.
_NEW = np.concatenate(([0], np.cumsum(64 + (1 << 20) // (np.arange(1 << 16) + 128))))


class FormatError(ValueError):
    """A file that breaks the format or fails a checksum."""


class _Model:
    """The adaptive predictions of a number of blocks, whose streams are lanes.

    They change between windows of ids only, so that a writer looks up a whole window at once; `update` learns a window that both sides know.
    Ids met before are numbered within a block by the windows that they came in, and by size within a window; `cap` stands for an id not met yet, -1 for the beginning of a stream.
    """

    def __init__(self, blocks: int, writer: bool):
        self.blocks, lanes = blocks, blocks * STREAMS
        self.of = np.repeat(np.arange(blocks, dtype=np.int64), STREAMS)
        self.two = np.zeros(blocks << _SLOTS, dtype=np.int64)  # number << 3 | confidence, after the last two ids
        self.hits = np.tile(_PRIOR, (blocks, 1, 1))  # ids that order 2, else order 1, else order 0 alone foresaw, by state
        self.cap = 256
        self.counts = np.zeros((blocks, self.cap), dtype=np.int64)
        self.followed = np.zeros((blocks, self.cap + 3), dtype=np.int64)  # pairs by the first number, from -1 on
        self.names = np.zeros((blocks, self.cap), dtype=np.int64)
        self.met = np.zeros(blocks, dtype=np.int64)
        self.numbers = np.zeros(blocks << 16, dtype=np.int32) if writer else None
        self.seen, self.width, self.fresh = np.zeros(blocks, dtype=np.int64), np.ones(blocks, dtype=np.int64), np.zeros(blocks, dtype=np.int64)
        self.last, self.before, self.context = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64), np.full(lanes, -1, dtype=np.int64)
        self.pairs, self.times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)  # (block, number, next number) in order, and how often
        self.prepare()

    def prepare(self) -> None:
        """Shares for the next window."""
        total = self.seen + 1 + self.fresh * self.seen // self.width  # new ids weigh as many as the last window met
        below = np.zeros((self.blocks, self.cap + 2), dtype=np.int64)
        np.cumsum(self.counts, axis=1, out=below[:, 1:-1])
        below[:, -1] = total
        self.row, self.below = self.of * (self.cap + 2), below.ravel()
        w2, w1 = (self.hits[:, :, k] * (_ONE - _ONE // 256) // self.hits.sum(axis=2) * _ALLOWED[:, k] for k in (0, 1))
        self.w2, self.w1, self.unit = w2.ravel(), w1.ravel(), ((_ONE - w2 - w1) // total[:, None]).ravel()
        self.state, self.slots = self.of * _STATES, self.of << _SLOTS
        # Pairs of each number lie together: where they begin, what comes before them, and their order-0 shares.
        self.follow = self.of * (self.cap + 3) + 1
        self.begin = np.concatenate(([0], np.cumsum(self.followed)))
        self.sums = np.concatenate(([0], np.cumsum(self.times)))
        self.before_pair = self.sums.take(self.begin)
        self.next = np.concatenate((self.pairs & 0xFFFF, [0]))
        self.mixed = self.sums << 20
        self.mixed[:-1] += self.below.take((self.pairs >> 33) * (self.cap + 2) + self.next[:-1])

    def predict(self, last: np.ndarray, before: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, ...]:
        """(slot, what it holds, foreseen number, state, first pair, pairs, sum before them, weight of order 2, unit of order 1, unit of order 0); the last axis is that of lanes."""
        at = ((last * 0x3D4D51 + before * 0x5F356495 >> 13) & (1 << _SLOTS) - 1) + self.slots
        held = self.two.take(at)
        row = self.follow + context
        first, base = self.begin.take(row), self.before_pair.take(row)
        row += 1
        count, often = self.begin.take(row) - first, self.before_pair.take(row) - base
        state = ((held & 7) << 3) + _BUCKET.take(often, mode="clip") + self.state
        return at, held, held >> 3, state, first, count, base, self.w2.take(state), self.w1.take(state) // np.maximum(often, 1), self.unit.take(state)

    def update(self, ids: np.ndarray, x: np.ndarray, found: np.ndarray, predicted: tuple[np.ndarray, ...], live: np.ndarray | None) -> None:
        """Learn a window (steps, lanes) of ids and their numbers, and whether their pairs were known; new ids get numbers now. Lanes that have ended are not live."""
        at, held, e2, state = predicted[:4]
        new = x == self.cap if live is None else (x == self.cap) & live
        step, lane = np.nonzero(new)
        of = self.of.take(lane)
        fresh, back = np.unique(ids[step, lane] + (of << 16), return_inverse=True)
        self.fresh = np.bincount(of, minlength=self.blocks)
        if len(fresh):
            of = fresh >> 16
            number = np.arange(len(fresh)) - np.searchsorted(of, of) + self.met[of]
            self.met += np.bincount(of, minlength=self.blocks)
            x[step, lane] = number[back]
            if (most := int(self.met.max())) > self.cap:
                more = np.zeros((self.blocks, max(most, 2 * self.cap) - self.cap), dtype=np.int64)
                self.counts, self.names, self.followed = (np.concatenate((a, more), axis=1) for a in (self.counts, self.names, self.followed))
                self.cap += more.shape[1]
            self.names[of, number] = fresh & 0xFFFF
            if self.numbers is not None:
                self.numbers[fresh] = number + 1
        context = np.concatenate((self.context[None], x[:-1]))
        self.last, self.before, self.context = ids[-1], (ids[-2] if len(ids) > 1 else self.last), x[-1]
        key = ((self.of << 17) + context + 1 << 16) + x
        if live is not None:
            at, held, e2, state, x, found, key = (a[live] for a in (at, held, e2, state, x, found, key))
        at, held, e2, state, x, found, key = (a.ravel() for a in (at, held, e2, state, x, found, key))
        conf = held & 7
        hit = (x == e2) & (conf > 0)
        two, one = state[hit], state[found & ~hit]
        first, second = (np.bincount(k, minlength=self.blocks * _STATES) for k in (two, one))
        self.hits += np.stack((first, second, np.bincount(state, minlength=self.blocks * _STATES) - first - second), axis=1).reshape(self.hits.shape)
        # Of several ids after the same two ids in a window the last one is kept.
        value = x << 3 | 1
        kept = np.flatnonzero((conf > 2) & ~hit)
        value[kept] = held[kept] - 2
        kept = np.flatnonzero(hit)
        value[kept] = held[kept] + (conf[kept] < 7)
        self.two[at] = value
        keys, times = np.unique(key, return_counts=True)
        self.counts += np.bincount((keys >> 33) * self.cap + (keys & 0xFFFF), times, self.counts.size).astype(np.int64).reshape(self.counts.shape)
        self.width = np.maximum(1, seen := self.counts.sum(axis=1) - self.seen)
        self.seen = self.seen + seen
        place = np.searchsorted(self.pairs, keys)
        known = self.pairs.take(place, mode="clip") == keys if len(self.pairs) else np.zeros(len(keys), dtype=bool)
        self.times[place[known]] += times[known]
        place, keys = place[~known], keys[~known]
        self.pairs, self.times = np.insert(self.pairs, place, keys), np.insert(self.times, place, times[~known])
        self.followed += np.bincount((keys >> 33) * (self.cap + 3) + (keys >> 16 & 0x1FFFF), minlength=self.followed.size).reshape(self.followed.shape)
        self.prepare()


def _windows(steps: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < steps:
        to = min(steps, at + min(512, max(8, at // 4)))
        yield at, to
        at = to


class _Encoder:
    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, dtype=np.int64)
        self.range = np.full(lanes, _TOP, dtype=np.int64)
        self.out = np.zeros((lanes, 64), dtype=np.uint32)
        self.at = np.zeros(lanes, dtype=np.int64)

    def room(self, words: int) -> None:
        """Make room for so many more words in each lane."""
        if self.at.max() + words > self.out.shape[1]:
            self.out = np.concatenate((self.out, np.zeros((len(self.out), self.out.shape[1] // 2 + words), dtype=np.uint32)), axis=1)

    def put(self, start: np.ndarray, size: np.ndarray, bits: int = _BITS) -> None:
        """Narrow every lane's interval to a share of it. A carry waits in the sign bit of low until a word goes out."""
        unit = self.range >> bits
        start *= unit
        self.low += start
        self.range = width = np.multiply(unit, size, out=unit)
        few = np.flatnonzero(width < _LEAST)
        if len(few):
            low, at = self.low[few], self.at[few]
            self.out[few, at] = low >> 31 & 0xFFFFFFFF
            if (over := low < 0).any():
                self._carry(few[over])
            self.at[few] = at + 1
            self.low[few] = (low & _WORD) << 32
            width[few] <<= 32

    def _carry(self, lanes: np.ndarray) -> None:
        at = self.at[lanes]
        while len(lanes):
            at = at - 1
            self.out[lanes, at] += np.uint32(1)
            on = self.out[lanes, at] == 0
            lanes, at = lanes[on], at[on]

    def finish(self) -> list[bytes]:
        lanes = np.arange(len(self.low))
        self.room(2)
        self.out[lanes, self.at] = self.low >> 31 & 0xFFFFFFFF
        self._carry(np.flatnonzero(self.low < 0))
        self.out[lanes, self.at + 1] = (self.low & _WORD) << 1
        return [self.out[i, : n + 2].astype("<u4").tobytes() for i, n in enumerate(self.at.tolist())]


class _Decoder:
    def __init__(self, data: list[bytes]):
        words = [np.frombuffer(d, dtype="<u4") for d in data]
        self.words = np.zeros((len(words), max(map(len, words)) + 2), dtype=np.int64)
        for i, w in enumerate(words):
            self.words[i, : len(w)] = w
        # The interval has 63 bits: what is read after the first word is one bit off the words.
        self.words[:, 1:-1] = (self.words[:, 1:-1] & 1) << 31 | self.words[:, 2:] >> 1
        self.range = np.full(len(words), _TOP, dtype=np.int64)
        first = [int.from_bytes(d[4:8].ljust(4, b"\0"), "little") >> 1 for d in data]
        self.code = self.words[:, 0] << 31 | np.array(first, dtype=np.int64)  # the coded number less the interval's beginning
        self.flat, self.next = self.words.ravel(), np.arange(len(words)) * self.words.shape[1] + 1
        self.end = self.next + self.words.shape[1] - 2

    def value(self, bits: int = _BITS) -> np.ndarray:
        """Where in each interval the coded number is, of 2^bits."""
        self.unit = self.range >> bits
        found = np.floor_divide(self.code.view(np.uint64), self.unit.view(np.uint64)).view(np.int64)
        return np.minimum(found, (1 << bits) - 1, out=found)

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        """Narrow the intervals to the shares that the values lie in."""
        self.code -= np.multiply(start, self.unit, out=start)
        self.range = width = np.multiply(size, self.unit, out=size)
        few = np.flatnonzero(width < _LEAST)
        if len(few):
            at = self.next[few]
            self.code[few] = self.code[few] << 32 | self.flat[at]
            width[few] <<= 32
            self.next[few] = np.minimum(at + 1, self.end[few])


def _lengths(sizes: np.ndarray) -> np.ndarray:
    """Ids of each stream: a block is dealt to its streams in even pieces of LEAST ids or more, the last ones shorter or empty."""
    piece = np.maximum(LEAST, -(-sizes // STREAMS))
    return np.clip(sizes[:, None] - np.arange(STREAMS) * piece[:, None], 0, piece[:, None]).ravel()


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of 16-bit ids, packed: the u16 words of each stream that has ids, their u16 new ids, then the words of the streams. Blocks of one call are coded side by side and do not know of each other."""
    if not blocks:
        return []
    length = _lengths(np.array([len(b) for b in blocks]))
    steps, shortest, lanes = int(length.max()), int(length.min()), len(length)
    ids = np.zeros((steps, lanes), dtype=np.uint16)
    for i, b in enumerate(blocks):
        at = 0
        for lane in range(i * STREAMS, (i + 1) * STREAMS):
            ids[: length[lane], lane] = b[at : at + length[lane]]
            at += length[lane]
    model = _Model(len(blocks), True)
    starts, widths = np.zeros((steps, lanes), dtype=np.int32), np.full((steps, lanes), _ONE, dtype=np.int32)
    new_of, new_ids = [], []
    for at, to in _windows(steps):
        now = ids[at:to].astype(np.int64)
        last = np.concatenate((model.last[None], now[:-1]))
        before = np.concatenate((model.before[None], last[:-1]))
        x = model.numbers.take(now + (model.of << 16)).astype(np.int64) - 1
        x[x < 0] = model.cap
        context = np.concatenate((model.context[None], x[:-1]))
        seen = model.predict(last, before, context)
        _, held, e2, _, _, _, base, w2, unit1, unit0 = seen
        key = ((model.of << 17) + context + 1 << 16) + x
        distinct, back = np.unique(key, return_inverse=True)
        place = np.searchsorted(model.pairs, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        if len(model.pairs):
            known = model.pairs.take(place, mode="clip") == distinct
        back = back.reshape(key.shape)
        place, found = place.take(back), known.take(back) & (x < model.cap)
        sums, row = model.sums.take(place), model.row + x
        lo = model.below.take(row)
        times = (model.sums.take(place + 1, mode="clip") - sums) * found
        start = w2 + (sums - base) * unit1 + lo * unit0
        size = times * unit1 + (model.below.take(row + 1) - lo) * unit0
        two = ((held & 7) > 0) & (x == e2)
        start[two], size[two] = 0, w2[two]
        live = None
        if to > shortest:
            live = np.arange(at, to)[:, None] < length
            start[~live], size[~live] = 0, _ONE
        starts[at:to], widths[at:to] = start, size
        new = x == model.cap if live is None else (x == model.cap) & live
        new_of.append(np.broadcast_to(np.arange(lanes), new.shape)[new])
        new_ids.append(now[new])
        model.update(now, x, found, seen, live)
    out = _Encoder(lanes)
    # New ids come first, stream by stream.
    of, named = np.concatenate(new_of), np.concatenate(new_ids)
    order = np.argsort(of, kind="stable")
    of, named, fresh = of[order], named[order], np.bincount(of, minlength=lanes)
    listed = np.full((lanes, int(fresh.max())), -1, dtype=np.int64)
    listed[of, np.arange(len(of)) - np.searchsorted(of, of)] = named
    for i in listed.T:
        out.room(2)
        out.put(_NEW.take(i) * (i >= 0), np.where(i >= 0, _NEW.take(i + 1) - _NEW.take(i), 1 << _NEW_BITS), _NEW_BITS)
    for t in range(steps):
        if t % 64 == 0:
            out.room(66)
        out.put(starts[t].astype(np.int64), widths[t])
    words = out.finish()
    back = []
    for i in range(len(blocks)):
        some = slice(i * STREAMS, i * STREAMS + np.count_nonzero(length[i * STREAMS : (i + 1) * STREAMS]))
        back.append(np.stack(([len(w) // 4 for w in words[some]], fresh[some])).astype("<u2").tobytes() + b"".join(words[some]))
    return back


def decode_blocks(data: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each packed block."""
    if not data:
        return []
    length = _lengths(np.array(sizes))
    steps, shortest, lanes = int(length.max()), int(length.min()), len(length)
    streams, fresh = [], []
    for d, n in zip(data, np.count_nonzero(length.reshape(-1, STREAMS), axis=1).tolist(), strict=True):
        heads = np.frombuffer(d[: 4 * n], dtype="<u2").astype(np.int64)
        if len(heads) != 2 * n or 4 * (n + heads[:n].sum()) != len(d):
            raise FormatError("a block does not match its length")
        ends = (4 * (n + np.cumsum(heads[:n]))).tolist()
        streams += [d[lo:hi] for lo, hi in zip([4 * n, *ends[:-1]], ends, strict=True)] + [b""] * (STREAMS - n)
        fresh.append(np.concatenate((heads[n:], np.zeros(STREAMS - n, dtype=np.int64))))
    fresh = np.concatenate(fresh)
    source, model = _Decoder(streams), _Model(len(data), False)
    listed = np.zeros((lanes, int(fresh.max()) + 1), dtype=np.int64)
    for k in range(int(fresh.max())):
        i = np.searchsorted(_NEW, np.minimum(source.value(_NEW_BITS), _NEW[-1] - 1), "right") - 1
        idle = fresh <= k
        listed[:, k] = i
        source.take(np.where(idle, 0, _NEW[i]), np.where(idle, 1 << _NEW_BITS, _NEW[i + 1] - _NEW[i]))
    listed, width, taken = listed.ravel(), listed.shape[1], np.arange(lanes) * listed.shape[1]
    most = taken + fresh
    ids = np.zeros((steps, lanes), dtype=np.uint16)
    for at, to in _windows(steps):
        cap, row, below, mixed, following = model.cap, model.row, model.below, model.mixed, model.next
        mixed_before = np.concatenate(([1 << 62], mixed))
        mid, entry, share = (np.empty(lanes, dtype=np.int64) for _ in range(3))
        # The number at each place of the counted part of order 0, block by block.
        held0 = np.repeat(np.tile(np.arange(cap), len(data)), model.counts.ravel())
        counted = model.seen[model.of]
        base0 = (np.cumsum(model.seen) - model.seen)[model.of]
        names, named = model.names.ravel(), model.of * cap
        last, before, context = model.last, model.before, model.context
        now, numbers, known, kept = np.zeros((to - at, lanes), dtype=np.int64), np.zeros((to - at, lanes), dtype=np.int64), np.zeros((to - at, lanes), dtype=bool), []
        for t in range(to - at):
            seen = model.predict(last, before, context)
            _, held, e2, _, first, count, base, w2, unit1, unit0 = seen
            v = source.value()
            two = v < w2
            v -= w2
            # The last pair whose share does not begin after v: shares of pairs and of the ids between them are in the order of numbers.
            shifted, lo, last_pair = v + base * unit1, first.copy(), first + count
            for bit in reversed(range(int(count.max()).bit_length())):
                np.add(lo, 1 << bit, out=mid)
                np.minimum(mid, last_pair, out=mid)
                mixed_before.take(mid, out=entry, mode="clip")
                np.bitwise_and(entry, 0xFFFFF, out=share)
                entry >>= 20
                entry *= unit1
                share *= unit0
                entry += share
                np.copyto(lo, mid, where=entry <= shifted)
            any_pair = lo > first
            pair = lo - 1
            number = following.take(pair, mode="clip")
            sums = mixed.take(lo, mode="clip") >> 20  # of all pairs up to it
            # Either v lies in the share of that pair's id, or in that of an id which has no pair.
            beside = shifted - sums * unit1
            place = beside // unit0
            r = row + number
            inside = any_pair & (place < below.take(r + 1))
            x = np.where(inside, number, held0.take(base0 + np.minimum(place, counted - 1), mode="clip") if len(held0) else cap)
            x[~inside & (place >= counted)] = cap
            r = row + x
            low = below.take(r)
            before_it = np.where(inside, mixed.take(pair, mode="clip") >> 20, sums)
            start = w2 + (before_it - base) * unit1 + low * unit0
            size = (sums - before_it) * unit1 + (below.take(r + 1) - low) * unit0
            x = np.where(two, e2, x)
            start, size = np.where(two, 0, start), np.where(two, w2, size)
            if to > shortest:
                live = length > at + t
                start, size, x = np.where(live, start, 0), np.where(live, size, _ONE), np.where(live, x, 0)
            source.take(start, size)
            i = names.take(named + x, mode="clip")
            new = np.flatnonzero(x == cap)
            if len(new):
                next_new = taken[new]
                i[new] = listed.take(next_new)
                taken[new] = np.minimum(next_new + 1, most[new])
            now[t], numbers[t], known[t] = i, x, inside
            kept.append(seen[:4])
            last, before, context = i, last, x
        ids[at:to] = now
        live = np.arange(at, to)[:, None] < length if to > shortest else None
        model.update(now, numbers, known, tuple(np.stack(c) for c in zip(*kept, strict=True)), live)
    back = []
    for i in range(len(data)):
        some = range(i * STREAMS, (i + 1) * STREAMS)
        back.append(np.concatenate([ids[: length[lane], lane] for lane in some]))
    return back


def _section(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data


def write_file(out, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
    """Write documents and their concatenated ids."""
    blocks = [ids[at : at + BLOCK] for at in range(0, len(ids), BLOCK)]
    head = {"block": BLOCK, "documents": len(doc_ids), "ids": len(ids), "blocks": len(blocks)}
    index = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes() + np.array([d is not None for d in doc_ids], dtype=np.uint8).tobytes() + np.array(lengths, dtype="<u4").tobytes()
    packed = zlib.compress(index, 6)
    out.write(MAGIC + _section(json.dumps(head).encode()) + _section(struct.pack("<I", zlib.crc32(index)) + packed))
    for at in range(0, len(blocks), BESIDE):
        some = blocks[at : at + BESIDE]
        for block, words in zip(some, encode_blocks(some), strict=True):
            out.write(_section(struct.pack("<III", len(block), zlib.crc32(block.astype("<u4").tobytes()), len(words) // 4) + words))


def read_file(f) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, concatenated ids as u32) of a file, all checksums held against the content."""

    def section() -> bytes:
        size = f.read(4)
        data = f.read(n := struct.unpack("<I", size)[0]) if len(size) == 4 else b""
        if len(size) != 4 or len(data) != n:
            raise FormatError("the file ends within a section")
        return data

    if f.read(4) != MAGIC:
        raise FormatError("not a file of this format")
    head = json.loads(section())
    data = section()
    index = zlib.decompress(data[4:])
    n = head["documents"]
    if zlib.crc32(index) != struct.unpack("<I", data[:4])[0] or len(index) != 13 * n:
        raise FormatError("the document index fails its checksum")
    doc_ids, valid, lengths = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, 8 * n), np.frombuffer(index, "<u4", n, 9 * n).astype(np.int64)
    parts: list[np.ndarray] = []
    for at in range(0, head["blocks"], BESIDE):
        held = [section() for _ in range(min(BESIDE, head["blocks"] - at))]
        heads = [struct.unpack("<III", h[:12]) for h in held]
        if any(12 + 4 * w != len(h) or not 0 < size <= head["block"] for h, (size, _, w) in zip(held, heads, strict=True)):
            raise FormatError("a block does not match its length")
        for (_, crc, _), ids in zip(heads, decode_blocks([h[12:] for h in held], [size for size, _, _ in heads]), strict=True):
            parts.append(ids.astype("<u4"))
            if zlib.crc32(parts[-1].tobytes()) != crc:
                raise FormatError("a block fails its checksum")
    ids = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
    if len(ids) != head["ids"] or lengths.sum() != len(ids):
        raise FormatError("the ids do not match the document index")
    return [d if v else None for d, v in zip(doc_ids.tolist(), valid.tolist(), strict=True)], lengths, ids


class LibraryWords:
    """Ids of texts by the tokenizers library, which is asked for each distinct word once.

    A byte-level tokenizer's own splitter begins a word at every space before another character, so the pieces between such spaces have ids of their own. Texts in which
    a space meets other white space, and those with special strings, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_padding()
        self._library.no_truncation()
        if self._library.get_vocab_size() > 1 << 16:
            raise FormatError(f"{path} has {self._library.get_vocab_size()} ids; the format holds ids of 16 bits")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        self._cut = split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True) and not spec["normalizer"]
        self._special = [t["content"] for t in spec["added_tokens"]]
        self._line = self._library.encode("\n", add_special_tokens=False).ids
        self._first: dict[str, bytes | None] = {}  # pieces at the beginning of a text
        self._kept: dict[str, bytes | None] = {}  # those after a space; None for what must not be cut

    def _ask(self, texts: list[str]) -> Iterator[bytes]:
        for e in self._library.encode_batch_fast(texts, add_special_tokens=False):
            ids = array("H", e.ids)
            if sys.byteorder == "big":
                ids.byteswap()
            yield ids.tobytes()

    def _ask_words(self, words: list[str], space: str) -> Iterator[bytes]:
        """Ids of words without line ends: a line end is a word and a token of its own between them, so many words go to the library as one text."""
        if len(self._line) != 1:
            yield from self._ask([space + w for w in words])
            return
        groups = [words[at : at + 4000] for at in range(0, len(words), 4000)]
        for some, data in zip(groups, self._ask([space + f"\n{space}".join(g) for g in groups]), strict=True):
            cut = [-1, *np.flatnonzero(np.frombuffer(data, "<u2") == self._line[0]).tolist(), len(data) // 2]
            if len(cut) == len(some) + 1:
                yield from (data[2 * lo + 2 : 2 * hi] for lo, hi in zip(cut[:-1], cut[1:], strict=True))
            else:
                yield from self._ask([space + w for w in some])

    def _learn(self, kept: dict[str, bytes | None], words: set[str], space: str) -> list[str]:
        """Make kept hold the ids of all these words; returns the long ones, which must go again."""
        new = [w for w in words if w not in kept]
        if len(kept) + len(new) > KEPT_WORDS:
            used = {w: kept[w] for w in words if w in kept}
            kept.clear()
            kept.update(used)
        kept.update(dict.fromkeys(new))
        # Words that end in white space, or begin with it after a space, must not be cut off.
        new = [w for w in new if w and not w[-1].isspace() and not (space and w[0].isspace())]
        short = [w for w in new if len(w) <= KEPT_LENGTH and "\n" not in w]
        kept.update(zip(short, self._ask_words(short, space), strict=True))
        other = [w for w in new if not (len(w) <= KEPT_LENGTH and "\n" not in w)]
        kept.update(zip(other, self._ask([space + w for w in other]), strict=True))
        return [w for w in other if len(w) > KEPT_LENGTH]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        cut = [None if not self._cut or any(m in t for m in self._special) else t.split(" ") for t in texts]
        first, kept = self._first, self._kept
        long = self._learn(first, {p[0] for p in cut if p}, ""), self._learn(kept, set().union(*(p[1:] for p in cut if p)), " ")
        out: list[bytes] = [b""] * len(texts)
        whole = []
        for i, p in enumerate(cut):
            try:
                out[i] = first[p[0]] + b"".join(map(kept.__getitem__, p[1:]))
            except TypeError:  # no pieces, or one that must not be cut
                whole.append(i)
        for i, ids in zip(whole, self._ask([texts[i] for i in whole]), strict=True):
            out[i] = ids
        for known, words in zip((first, kept), long, strict=True):
            for w in words:
                known.pop(w, None)
        return out


_encoders: dict[str, LibraryWords] = {}


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode all texts and write their ids in ascending order of document ids; returns the saved manifest (file, documents, ids, start), start counting the ids in files before."""
    spark = docs.sparkSession
    common.ship(spark)
    end = struct.pack("<H", end_id)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = common.filesystem(folder)
        fs.create_dir(root, recursive=True)
        if tokenizer not in _encoders:
            _encoders[tokenizer] = LibraryWords(tokenizer)
        library = _encoders[tokenizer]
        names, data, size, number = [], [], 0, 0

        def close():
            nonlocal size, number
            file = f"ids-{part:06d}-{number:06d}-{uuid.uuid4().hex}.cmr"
            lengths = [len(d) // 2 for d in data]
            ids = np.frombuffer(b"".join(data), dtype="<u2")
            with fs.open_output_stream(f"{root}/{file}", compression=None) as out:
                write_file(out, names, lengths, ids)
            made = pa.RecordBatch.from_arrays([pa.array([file]), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64())], ["file", "part", "number", "documents", "ids"])
            names.clear()
            data.clear()
            size, number = 0, number + 1
            return made

        for b in batches:
            texts, of = b.column(1).to_pylist(), b.column(0).to_pylist()
            at = 0
            while at < len(texts):
                to, n = at, 0
                while to < len(texts) and (n < 1_000_000 or to == at):
                    n += len(texts[to] or "")
                    to += 1
                for d, ids in zip(of[at:to], library.encode_batch([t or "" for t in texts[at:to]]), strict=True):
                    names.append(d)
                    data.append(ids + end)
                    size += len(ids) // 2 + 1
                at = to
                if size >= FILE_IDS:
                    yield close()
        if names:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # By ids and the beginnings of texts, whose order is that of the texts, so that an id with many rows fills several tasks.
    rows = rows.repartitionByRange(common.partitions(spark), F.col("id"), F.substring("text", 1, PREFIX)).sortWithinPartitions("id", "text")
    manifest = common.saved(rows.mapInArrow(run, "file string, part int, number int, documents long, ids long"), "codec-manifest")
    # One row for each file of millions of ids: the only table that is summed in one task.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("file", "documents", "ids", "start")


def read_tokens(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files of a manifest."""
    common.ship(manifest.sparkSession)
    names = [id_col, "start", "n_tokens", "ids_crc32"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(folder)
        for b in batches:
            for file, documents, total, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(f"{root}/{file}") as f:
                    doc_ids, lengths, ids = read_file(f)
                if len(doc_ids) != documents or len(ids) != total:
                    raise FormatError(f"{file} does not match the manifest")
                at = np.concatenate(([0], np.cumsum(lengths)))
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(at[:-1] + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names)

    dealt = manifest.select("file", "documents", "ids", "start").repartition(4 * common.partitions(manifest.sparkSession))
    return dealt.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
