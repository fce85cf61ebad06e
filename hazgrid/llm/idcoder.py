"""Adaptive context-mixing range coder for token ids of 16 bits.

Ids are cut into blocks of BLOCK ids. Every block starts from the same state and carries a checksum, so any block can be
read alone. Within a block three orders predict the next id. Orders 2 and 1 remember the id that followed the last two ids
and the last one, each with a confidence. Order 0 has the frequency of every id that the block has shown, as a power of two
that grows as its count doubles. Which of them predicts is coded first, with frequencies mixed from two adaptive tables
(one by the confidences, one by the last two outcomes); an id that order 0 predicts then follows with its own frequency,
and an id that is new to the block as such. A carry-propagating range coder with 32-bit digits writes each block.

Blocks are independent, so all blocks of a segment advance together, one id a step, as lanes of numpy arrays. Within a
block an id goes by the number of ids that came before its first: lanes then need no table as long as the vocabulary. Order
0 holds these numbers ordered by frequency, with a border between frequencies, so that cumulative frequencies follow from
a place and the borders, and a doubled frequency is one exchange at a border.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 512
LANES = 6_144
MAGIC = b"HGT2"
_NEAR = 128
#: Doublings of a frequency, so that the largest is 2 ** DOUBLINGS.
DOUBLINGS = 3
#: Slots of order 2; bits of an outcome's scale; and of the span below which a digit leaves.
_SLOTS2, _SCALE, _LOW = 1024, 13, 30
_TOP = _LOW + 32
_WHOLE = np.uint16((1 << _SCALE) - 1)
#: Three cumulative frequencies in one number, from its second 16 bits on, their rate of adaption, and the least frequency.
_FIELD, _RATE, _LEAST = 16, 5, 16


def _packed(*fields: int) -> int:
    return sum(f << _FIELD * (k + 1) for k, f in enumerate(fields))


_SHIFTED = _packed(*[(1 << 11) - 1] * 3)
_FLOOR = _packed(_LEAST, 2 * _LEAST, 3 * _LEAST)
_START = _packed(500, 1000, 2200)
#: What a table's cumulative frequencies gain for each outcome: 126 is the largest step that leaves room for all floors.
_TOWARDS = np.array([_packed(*(126 * (outcome <= k) for k in range(3))) for outcome in range(4)], np.int64)
#: The doubling that a count brings, and bits that say which counts bring one.
_DOUBLES = {2 << k: k for k in range(DOUBLINGS)}
_DOUBLING = np.uint16(sum(1 << count for count in _DOUBLES))
_WHICH = np.array([_DOUBLES.get(count, 0) for count in range(max(_DOUBLES) + 1)], np.int64)
#: Entries of orders 1 and 2 are 16 bits: a confidence, and a number within the block, from 1 on.
_NUMBER, _SURE, _SURER = np.uint16(0xFFF), np.uint16(0x1000), np.uint16(0x2000)
_HASH1, _HASH2 = np.uint16(40503), np.uint16(30011)


class CorruptIds(ValueError):
    """A segment's bytes don't hold the ids that its checksums say."""


class _Model:
    """The predictions of all lanes, and what they learn from the ids that come. Only places in tables and what is as long
    as the range are 64 bits wide."""

    def __init__(self, lanes: int):
        self.n = lanes
        self.lane = np.arange(lanes, dtype=np.int64)
        self.base, self.base2, self.base4 = self.lane * BLOCK, self.lane * _SLOTS2, self.lane * 4
        # What is known of each number of a lane, in one word: its entry of order 1 (16 bits), its count (16), its id.
        self.base1 = self.lane * (BLOCK + 1)
        self.known, self.here = np.zeros(lanes * (BLOCK + 1), np.int64), np.zeros(lanes, np.int64)
        self.after2 = np.zeros(lanes * _SLOTS2, np.uint16)
        self.mix_a, self.mix_b = np.full(32 * lanes, _START, np.int64), np.full(16 * lanes, _START, np.int64)  # by state, then lane
        self.order = np.tile(np.arange(BLOCK, dtype=np.uint16), lanes)
        self.place = self.order.copy()
        self.borders = np.zeros((DOUBLINGS, lanes), np.uint16)
        self.shown, self.weight = np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint16)
        # Before the first id, the last one is a number that no id has.
        self.last, self.before, self.outcomes = np.full(lanes, BLOCK, np.uint16), np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint8)
        self.i1 = self.base1 + BLOCK

    def predict(self) -> np.ndarray:
        """Cumulative frequencies (4 a lane, from 0; the scale comes last) of: order 2 right, order 1 right, order 0, new to the
        block. p1 and p2 are what orders 1 and 2 predict, one more than the number."""
        self.i2 = self.base2 + ((self.last * _HASH1 ^ self.before * _HASH2) >> 5 & (_SLOTS2 - 1))
        self.e1, self.e2 = self.here.astype(np.uint16), self.after2.take(self.i2)
        self.p1, self.p2 = self.e1 & _NUMBER, self.e2 & _NUMBER
        self.a = ((self.e2 >> 12 << 3) + (self.e1 >> 12 << 1) + (self.p1 == self.p2)) * np.int64(self.n)
        self.a += self.lane
        self.b = self.outcomes * np.int64(self.n)
        self.b += self.lane
        self.wa, self.wb = self.mix_a.take(self.a), self.mix_b.take(self.b)
        w = self.wa + self.wb
        w += _FLOOR
        return w.view(np.uint16)

    def frequency(self, who: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order 0's cumulative frequency and frequency of the ids at ``place`` of lanes ``who``."""
        below, size = place.copy(), np.ones(len(who), np.uint16)
        for k in range(DOUBLINGS):
            border = self.borders[k].take(who)
            below += np.minimum(place, border) << k
            size <<= place < border
        return below, size

    def at(self, who: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The places that hold cumulative frequency ``below`` of lanes ``who``."""
        rest = below.astype(np.int16)
        place = rest >> DOUBLINGS
        for k in range(DOUBLINGS - 1, -1, -1):  # frequency 2 ** k: what lies at or after the border of the next higher one
            border = self.borders[k].take(who).view(np.int16)
            rest = rest - (border << k)
            place = np.where(place < border, place, rest >> k)
        return place

    def learn(self, ids: np.ndarray, outcome: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """Learn ``ids``, numbers within the block, and give the true ones; ``fresh`` has set those that are new. wide:
        ``outcome`` in 64 bits."""
        gain = _TOWARDS.take(wide)
        for table, at, w in ((self.mix_a, self.a, self.wa), (self.mix_b, self.b, self.wb)):
            less = w >> _RATE
            less &= _SHIFTED
            w -= less
            w += gain
            table[at] = w
        number = ids + np.uint16(1)
        entry = number + _SURE
        self.after2[self.i2] = entry + (self.p2 == number) * np.minimum(self.e2 - self.p2, _SURER)
        self.here.view(np.uint16)[::4] = entry + (self.p1 == number) * np.minimum(self.e1 - self.p1, _SURER)
        self.known[self.i1] = self.here
        self.i1 = self.base1 + ids
        self.here = self.known.take(self.i1)
        self.here += 1 << 16  # goes back to its place with what comes after it
        new = outcome == 3
        self.shown += new
        self.weight += new
        count = self.here.view(np.uint16)[1::4]
        who = np.flatnonzero(_DOUBLING >> np.minimum(count, np.uint16(15)) & np.uint16(1))
        if len(who):
            k, base, ids_of = _WHICH[count[who]], self.base[who], ids[who]
            at = base + ids_of
            flat = k * self.n + who
            borders = self.borders.reshape(-1)
            to = borders[flat]
            here, there = self.place[at], base + to
            other = self.order[there]
            self.order[there], self.order[base + here] = ids_of, other
            self.place[base + other], self.place[at] = here, to
            borders[flat] = to + np.uint16(1)
            self.weight[who] += np.left_shift(1, k).astype(np.uint16)
        self.before, self.last = self.last, ids
        self.outcomes = (self.outcomes & np.uint8(3)) << 2 | outcome
        return self.here.view(np.uint16)[2::4]

    def fresh(self, who: np.ndarray, ids: np.ndarray, true: np.ndarray) -> None:
        """Lanes ``who`` show ``true`` ids for the first time, as numbers ``ids``."""
        self.known[self.base1[who] + ids] = true << 32


def _numbered(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number within its lane, whether it is the first of its kind) of each id, both step by step: lanes are columns."""
    number, new = np.empty(lanes.shape[::-1], np.uint16), np.empty(lanes.shape[::-1], bool)
    for k in range(0, len(lanes), _NEAR):  # as many lanes as the nearest caches hold
        number[:, k : k + _NEAR], new[:, k : k + _NEAR] = (x.T for x in _numbered_few(lanes[k : k + _NEAR]))
    return number, new


def _numbered_few(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, size = lanes.shape
    ranked = np.sort((lanes.astype(np.uint32) << 16) | np.arange(size, dtype=np.uint32), axis=1)
    starts = np.ones(lanes.shape, bool)
    starts[:, 1:] = (ranked[:, 1:] ^ ranked[:, :-1]) >> 16 != 0
    at = ((ranked & 0xFFFF).view(np.int32) + np.int32(size) * np.arange(n, dtype=np.int32)[:, None]).reshape(-1)
    first = np.flatnonzero(starts)
    new = np.zeros(lanes.shape, bool)
    new.reshape(-1)[at[first]] = True
    number = np.cumsum(new, axis=1, dtype=np.uint16) - np.uint16(1)
    out = np.empty(n * size, np.uint16)
    out[at] = np.repeat(number.reshape(-1)[at[first]], np.diff(np.append(first, n * size)))
    return out.reshape(lanes.shape), new


def _encode_lanes(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digits (lanes x most) and their number, of ids (lanes x BLOCK)."""
    n = len(lanes)
    model = _Model(n)
    numbers, fresh = _numbered(lanes)
    fresh, columns = fresh.view(np.uint8), np.ascontiguousarray(lanes.T)
    digits = np.zeros((BLOCK + 8, n), np.uint64)
    flat = digits.reshape(-1)
    place = model.lane.copy()  # in the row of the next digit
    low, span = np.zeros(n, np.int64), np.full(n, (1 << _TOP) - 1, np.int64)
    for step in range(BLOCK):
        ids, new = numbers[step], fresh[step]
        c = model.predict()
        number = ids + np.uint16(1)
        wrong2, wrong1 = (model.p2 != number).view(np.uint8), (model.p1 != number).view(np.uint8)
        outcome = wrong2 + wrong2 * wrong1 * (np.uint8(1) + new)
        wide = outcome.astype(np.int64)
        at = model.base4 + wide
        begin = c.take(at)
        at += 1  # past a lane's last one lies the next lane's 0, which is the scale to the mask
        size = c.take(at, mode="wrap") - begin & _WHOLE
        r = span >> _SCALE
        low += begin * r
        span = size * r
        who = np.flatnonzero(outcome == 2)
        if len(who):
            begin, size = model.frequency(who, model.place.take(model.base[who] + ids[who]))
            r = span[who] // model.weight[who]
            low[who] += begin * r
            span[who] = size * r
        who = np.flatnonzero(outcome == 3)
        if len(who):
            r = span[who] >> 16
            low[who] += columns[step][who].astype(np.int64) * r
            span[who] = r
        over = np.flatnonzero(low >> _TOP)
        if len(over):
            flat[place[over] - n] += 1
            low[over] &= (1 << _TOP) - 1
        small = np.flatnonzero(span < 1 << _LOW)
        if len(small):
            out = low[small]
            flat[place[small]] = out >> _LOW
            place[small] += n
            low[small] = (out & (1 << _LOW) - 1) << 32
            span[small] <<= 32
        model.learn(ids, outcome, wide)
    flat[place], flat[place + n] = low >> _LOW, (low & (1 << _LOW) - 1) << 2
    sizes = place // n + 2
    digits = digits[: sizes.max()]
    for k in range(len(digits) - 1, 0, -1):
        digits[k - 1] += digits[k] >> np.uint64(32)
    return np.ascontiguousarray(digits.astype("<u4").T), sizes


def _decode_lanes(digits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ids (lanes x BLOCK) from the joined digits of all lanes; starts: of each lane in them."""
    n = len(starts)
    model = _Model(n)
    digits = np.append(digits, np.zeros(4, np.uint32)).astype(np.int64)
    place = starts.astype(np.int64)
    # The register holds 62 bits: a digit, and the first 30 bits of the next; two bits of it wait to come in.
    value, span = digits[place] << _LOW | digits[place + 1] >> 2, np.full(n, (1 << _TOP) - 1, np.int64)
    place += 1
    most = len(digits) - 2
    out = np.empty((BLOCK, n), np.uint16)
    for step in range(BLOCK):
        c = model.predict()
        r = span >> _SCALE
        q = (value // r).astype(np.uint16)
        outcome = (q >= c[1::4]).view(np.uint8) + (q >= c[2::4])
        outcome += q >= c[3::4]
        wide = outcome.astype(np.int64)
        at = model.base4 + wide
        begin = c.take(at)
        at += 1
        size = c.take(at, mode="wrap") - begin & _WHOLE
        value -= begin * r
        span = size * r
        ids = np.where(outcome == 0, model.p2, model.p1)
        ids -= ids > 0
        who = np.flatnonzero(outcome == 2)
        if len(who):
            weight = model.weight[who]
            r = span[who] // np.maximum(weight, 1)
            spot = model.at(who, np.minimum(value[who] // r, np.maximum(weight, 1) - np.int64(1)))
            begin, size = model.frequency(who, spot.view(np.uint16))
            value[who] -= begin * r
            span[who] = size * r
            ids[who] = model.order.take(model.base[who] + spot)
        who = np.flatnonzero(outcome == 3)
        if len(who):
            r = span[who] >> 16
            q = np.minimum(value[who] // r, 0xFFFF)
            value[who] -= q * r
            span[who] = r
            ids[who] = np.minimum(model.shown[who], BLOCK - 1)
            model.fresh(who, ids[who], q)
        small = np.flatnonzero(span < 1 << _LOW)
        if len(small):
            now = np.minimum(place[small], most)
            value[small] = value[small] << 32 | (digits[now] & 3) << _LOW | digits[now + 1] >> 2
            place[small] += 1
            span[small] <<= 32
        out[step] = model.learn(ids, outcome, wide)
    return out.T


def encode_segment(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment's bytes: documents of ``lengths`` ids each, whose ``ids`` follow one another."""
    ids = np.ascontiguousarray(ids, "<u2")
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(n_blocks * BLOCK, "<u2")
    padded[: len(ids)] = ids
    lanes = padded.reshape(n_blocks, BLOCK)
    sizes, payload = [], []
    for at in range(0, n_blocks, LANES):
        digits, size = _encode_lanes(lanes[at : at + LANES])
        sizes.append(size)
        payload += [digits[k, :s].tobytes() for k, s in enumerate(size.tolist())]
    sums = np.array([zlib.crc32(lane.tobytes()) for lane in lanes], "<u4")
    head = struct.pack("<4sIQI", MAGIC, len(lengths), len(ids), n_blocks) + np.asarray(lengths, "<u4").tobytes() + np.concatenate([*sizes, np.empty(0, np.int64)]).astype("<u4").tobytes() + sums.tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(payload)


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, ids) of a segment; raises CorruptIds where a checksum differs."""
    if len(data) < 24 or data[:4] != MAGIC:
        raise CorruptIds("no segment")
    _, n_docs, n_ids, n_blocks = struct.unpack_from("<4sIQI", data)
    end = 20 + 4 * n_docs + 8 * n_blocks
    if len(data) < end + 4 or zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
        raise CorruptIds("the segment's head is damaged")
    lengths = np.frombuffer(data, "<u4", n_docs, 20)
    sizes = np.frombuffer(data, "<u4", n_blocks, 20 + 4 * n_docs).astype(np.int64)
    sums = np.frombuffer(data, "<u4", n_blocks, 20 + 4 * n_docs + 4 * n_blocks)
    if len(data) - end - 4 != 4 * sizes.sum():
        raise CorruptIds("the segment is cut off")
    digits = np.frombuffer(data, "<u4", offset=end + 4)
    starts = np.cumsum(sizes) - sizes
    parts = []
    for at in range(0, n_blocks, LANES):
        s, e = starts[at], starts[at + LANES] if at + LANES < n_blocks else len(digits)
        parts.append(_decode_lanes(digits[s:e], starts[at : at + LANES] - s))
    lanes = np.concatenate([*parts, np.empty((0, BLOCK), np.uint16)]).astype("<u2")
    for k, lane in enumerate(lanes):
        if zlib.crc32(lane.tobytes()) != sums[k]:
            raise CorruptIds(f"block {k} is damaged")
    return lengths, lanes.reshape(-1)[:n_ids]
