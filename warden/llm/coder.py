"""Adaptive context-mixing range coder for token ids, in blocks that are reset and checksummed on their own.

Three predictions are made for each id: the one that last followed the two ids before (order 2), the one that last
followed the id before (order 1), and the ids lately seen in a small table of the block (order 0). A symbol says which
of them is right first, or that none is; its distribution mixes the counts of the whole block with those of the present
state of confidence, by a weight that moves towards whichever did better. Order 0 adds the place in its table, a miss
the id itself. All symbols go through one range coder with 16-bit words.

Blocks do not depend on each other, so many are coded side by side as lanes of numpy arrays.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"IDRC"
VERSION = 1
BLOCK = 2048
#: Lanes at a time; bounds the memory of tables and words.
LANES = 2048
SLOT_BITS = 11
RECENT = 256
#: Counts of the four symbols are four 16-bit fields of one word; a weighted sum of two such words stays in its fields.
STEP, MOST = 24, 1000
_HEADER = struct.Struct("<4sBBIQI")
_K1, _K2, _K3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_SLOT = np.uint32(32 - SLOT_BITS)
_FIELD = np.uint64(0xFFFF)
_ONES, _HALF = np.uint64(0x0001000100010001), np.uint64(0x7FFF7FFF7FFF7FFF)
_U1, _U16, _U32, _U48 = np.uint64(1), np.uint64(16), np.uint64(32), np.uint64(48)
_LOW, _TOP = (1 << 32) - 1, 1 << 32


class Damaged(ValueError):
    """A block does not give the ids it was written from."""


class _Model:
    """What the lanes have learned; both directions run through the same steps."""

    def __init__(self, lanes: int, wide: bool):
        kind = np.int64 if wide else np.int32
        self.one = np.zeros(lanes << SLOT_BITS, kind)   # (id + 1) * 4 + confidence of the order-1 prediction
        self.two = np.zeros(lanes << SLOT_BITS, kind)
        self.recent = np.full(lanes * RECENT, -1, kind)
        self.lane = np.arange(lanes)
        self.all = np.full(lanes, 8, np.uint64) * _ONES
        self.state = np.full(lanes * 16, 4, np.uint64) * _ONES
        self.weight = np.full(lanes, 8, np.uint64)
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self._bases()

    def _bases(self):
        self.slots, self.states, self.places = self.lane << SLOT_BITS, self.lane * 16, self.lane * RECENT

    def narrow(self, n: int) -> None:
        """Go on with the first n lanes; the last block of all may be shorter."""
        self.lane, self.all, self.weight = self.lane[:n], self.all[:n], self.weight[:n]
        self.last, self.before = self.last[:n], self.before[:n]
        self._bases()

    def predict(self) -> None:
        """Predicted ids, the mixed frequencies `mix` and their running sums `ends`, field by field."""
        mixed = self.last * _K1
        self.at1 = self.slots + (mixed >> _SLOT)
        self.at2 = self.slots + (((self.before + _K3) * _K2 ^ mixed) * _K1 >> _SLOT)
        one, two = self.one.take(self.at1), self.two.take(self.at2)
        self.sure1, self.sure2 = one & 3, two & 3
        self.id1, self.id2 = (one >> 2) - 1, (two >> 2) - 1
        self.at3 = self.states + (self.sure2 * 4 + self.sure1)
        self.seen = self.state.take(self.at3)
        self.mix = self.all * self.weight + self.seen * (_U16 - self.weight)
        self.ends = self.mix * _ONES

    def update(self, symbol: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """Learn the ids; `at` is 16 times the symbol."""
        for table, place, old, sure, right in ((self.one, self.at1, self.id1, self.sure1, self.id1 == ids),
                                               (self.two, self.at2, self.id2, self.sure2, symbol == 0)):
            known = np.where(right | (sure > 0), old, ids) + 1
            table[place] = known * 4 + np.clip(sure + (2 * right.astype(sure.dtype) - 1), 0, 3)
        self.recent[self.places + _place(ids)] = ids
        better = (self.seen >> at & _FIELD) > (self.all >> at & _FIELD)
        self.weight = np.where(better, np.maximum(self.weight - _U1, _U1), np.minimum(self.weight + _U1, _U16 - _U1))
        more = np.uint64(STEP) << at
        for counts in (self.all, self.seen):
            counts += more
            full = np.flatnonzero((counts >> at & _FIELD) > MOST)
            if len(full):
                counts[full] = (counts[full] >> _U1 & _HALF) + _ONES
        self.state[self.at3] = self.seen
        self.before, self.last = self.last, ids.astype(np.uint32)


def _place(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.uint32) * _K2 >> np.uint32(24)


def _unit(span: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The span's share of one count; a little under the quotient, the same in both directions."""
    return (span / (ends >> _U48).astype(np.float64)).astype(np.int64) - 1


def _encode_lanes(ids: np.ndarray, lengths: np.ndarray, wide: bool) -> list[bytes]:
    """Words of each lane; `ids` is (step, lane), the lanes in falling order of length."""
    lanes, steps = ids.shape[1], int(lengths.max())
    model = _Model(lanes, wide)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    words = np.zeros((steps * (6 if wide else 4) + 3) * lanes, np.uint32)
    write = np.arange(lanes)  # where a lane's next word goes

    def shift(m):
        here = low.take(m)
        at = write.take(m)
        words[at] = here >> 32
        write[m] = at + lanes
        low[m] = (here & _LOW) << 16
        span[m] = span.take(m) << 16

    live = lanes
    for t, n in enumerate((lengths[:, None] > np.arange(steps)).sum(axis=0).tolist()):
        if n < live:
            model.narrow(n)
            live = n
        now = ids[t, :n]
        model.predict()
        place = _place(now)
        miss = np.where(model.recent.take(model.places + place) == now, 2, 3)
        symbol = np.where(model.id2 == now, 0, np.where(model.id1 == now, 1, miss))
        at = (symbol << 4).astype(np.uint64)
        part = (model.mix >> at & _FIELD).astype(np.int64)
        end = (model.ends >> at & _FIELD).astype(np.int64)
        unit = _unit(span[:n], model.ends)
        low[:n] += unit * (end - part)
        span[:n] = unit * part
        shift(np.flatnonzero(span[:n] < _TOP))
        # The place in the order-0 table, or the id itself.
        m = np.flatnonzero(symbol >= 2)
        literal = symbol.take(m) == 3
        for level in (1, 0) if wide else (0,):
            k, lit = (m[literal], True) if level else (m, literal)
            own = span.take(k) >> np.where(lit, 16, 8)
            low[k] += own * np.where(lit, now.take(k) >> 16 * level & 0xFFFF, place.take(k).astype(np.int64))
            span[k] = own
            shift(k[own < _TOP])
        model.update(symbol, now, at)
    for _ in range(3):
        words[write] = low >> 32
        write += lanes
        low = (low & _LOW) << 16
    words = words.reshape(-1, lanes)[:int(write.max()) // lanes]
    while True:  # a sum that went over 16 bits belongs to the word before
        over = words >> np.uint32(16)
        if not over.any():
            break
        words &= np.uint32(0xFFFF)
        words[:-1] += over[1:]
    flat = np.ascontiguousarray(words.T.astype("<u2"))
    return [flat[i, :c].tobytes() for i, c in enumerate((write // lanes).tolist())]


def _decode_lanes(parts: list[bytes], lengths: np.ndarray, wide: bool) -> np.ndarray:
    """(step, lane) ids from the words of each lane."""
    lanes, steps = len(parts), int(lengths.max())
    model = _Model(lanes, wide)
    size = max(map(len, parts)) // 2 + 2
    words = np.zeros((lanes, size), np.uint16)
    for i, part in enumerate(parts):
        words[i, :len(part) // 2] = np.frombuffer(part, "<u2", len(part) // 2)
    words = np.ascontiguousarray(words.T).reshape(-1)
    off = sum(words[k * lanes:(k + 1) * lanes].astype(np.int64) << 32 - 16 * k for k in range(3))
    span, read = np.full(lanes, 1 << 48, np.int64), np.arange(lanes) + 3 * lanes
    out = np.zeros((steps, lanes), model.one.dtype)

    def shift(m):
        at = read.take(m)
        off[m] = off.take(m) << 16 | words.take(at, mode="clip")
        read[m] = at + lanes
        span[m] = span.take(m) << 16

    live = lanes
    for t, n in enumerate((lengths[:, None] > np.arange(steps)).sum(axis=0).tolist()):
        if n < live:
            model.narrow(n)
            live = n
        model.predict()
        unit = _unit(span[:n], model.ends)
        here = off[:n]
        symbol = sum((here >= unit * (model.ends >> np.uint64(k) & _FIELD).astype(np.int64)).astype(np.int64)
                     for k in (0, 16, 32))
        at = (symbol << 4).astype(np.uint64)
        part = (model.mix >> at & _FIELD).astype(np.int64)
        end = (model.ends >> at & _FIELD).astype(np.int64)
        off[:n] -= unit * (end - part)
        span[:n] = unit * part
        shift(np.flatnonzero(span[:n] < _TOP))
        now = np.where(symbol == 0, model.id2, model.id1)
        m = np.flatnonzero(symbol >= 2)
        literal = symbol.take(m) == 3
        value = np.zeros(len(m), np.int64)
        for level in (1, 0) if wide else (0,):
            k, lit = (m[literal], True) if level else (m, literal)
            own = np.maximum(span.take(k) >> np.where(lit, 16, 8), 1)
            got = np.clip(off.take(k) // own, 0, np.where(lit, 0xFFFF, 0xFF))
            off[k] -= own * got
            span[k] = own
            shift(k[own < _TOP])
            if level:
                value[literal] = got << 16
            else:
                value += got
        place = model.places.take(m) + (value & RECENT - 1)
        now[m] = np.where(literal, value, model.recent.take(place))
        np.maximum(now, 0, out=now)
        out[t, :n] = now
        model.update(symbol, now, at)
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Ids (0 to 2**32 - 3) as a container: header, word counts and checksums of the blocks, their words."""
    ids = np.asarray(ids, np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() > 2 ** 32 - 3):
        raise ValueError("ids must be 0 to 2**32 - 3")
    wide = bool(len(ids) and ids.max() > 0xFFFF)
    n_blocks = -(-len(ids) // block)
    parts, sums = [], []
    for first in range(0, n_blocks, LANES):
        own = ids[first * block:(first + LANES) * block]
        lanes = -(-len(own) // block)
        lengths = np.full(lanes, block)
        lengths[-1] = len(own) - (lanes - 1) * block
        padded = np.zeros(lanes * block, np.int64 if wide else np.int32)
        padded[:len(own)] = own
        parts += _encode_lanes(np.ascontiguousarray(padded.reshape(lanes, block).T), lengths, wide)
        plain = own.astype("<u4")
        sums += [zlib.crc32(plain[k:k + block].tobytes()) for k in range(0, len(plain), block)]
    head = _HEADER.pack(MAGIC, VERSION, wide, block, len(ids), n_blocks)
    return b"".join([head, np.array([len(p) // 2 for p in parts], "<u4").tobytes(), np.array(sums, "<u4").tobytes(),
                     *parts])


def decode(data: bytes) -> np.ndarray:
    """The ids of a container as little-endian unsigned 32-bit numbers; raises Damaged where a checksum does not hold."""
    if len(data) < _HEADER.size:
        raise Damaged("header cut off")
    magic, version, wide, block, n, n_blocks = _HEADER.unpack_from(data)
    at = _HEADER.size + 8 * n_blocks
    if magic != MAGIC or version != VERSION or block < 1 or n_blocks != -(-n // block) or len(data) < at:
        raise Damaged("not a container of this format")
    counts = np.frombuffer(data, "<u4", n_blocks, _HEADER.size)
    sums = np.frombuffer(data, "<u4", n_blocks, _HEADER.size + 4 * n_blocks)
    ends = at + 2 * np.cumsum(counts, dtype=np.int64)
    if len(data) != (ends[-1] if n_blocks else at):
        raise Damaged("words cut off")
    out = np.zeros(n, "<u4")
    for first in range(0, n_blocks, LANES):
        lanes = min(LANES, n_blocks - first)
        lengths = np.full(lanes, block)
        if first + lanes == n_blocks:
            lengths[-1] = n - (n_blocks - 1) * block
        parts = [data[ends[i] - 2 * int(counts[i]):ends[i]] for i in range(first, first + lanes)]
        rows = np.ascontiguousarray(_decode_lanes(parts, lengths, bool(wide)).T).reshape(-1)
        out[first * block:first * block + lengths.sum()] = rows[:lengths.sum()]
    for i in range(n_blocks):
        if zlib.crc32(out[i * block:(i + 1) * block].tobytes()) != sums[i]:
            raise Damaged(f"block {i} does not match its checksum")
    return out
