"""Adaptive context-mixing range coder for sequences of ids.

An id is coded under a mixture of three predictions: the id that the same two ids were last followed by (order 2), the
id that the same one was (order 1), and an order-0 distribution over the whole vocabulary. An entry of a context table
also holds how sure it is, and every pair of such confidences has mixing weights that adapt to how often orders 2 and 1
came true under it. Order 0 adapts to the ids that the higher orders missed. A 64-bit range coder emits 32-bit words.

A block is coded on its own: all state is reset at its start, and it carries its length and a checksum. Inside a block,
up to LANES stretches are coded side by side, a step of array operations for the next id of each, under one model that
learns from all of them after every step; its distributions are renewed every RENEW steps. So array operations are long,
and yet all statistics of a block serve each of its ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U = np.uint64
SHIFT, LEAST, LAST = U(32), U(1 << 32), U((1 << 32) - 1)
#: Ids of a block; lanes of a block at most; steps of a lane that more lanes are worth; steps between renewals.
BLOCK, LANES, STEPS, RENEW = 1 << 20, 2048, 128, 16
#: Slots of the order-2 table; units of the order-0 distribution; parts that mixing weights count in.
SLOT_BITS, UNIT_BITS, WEIGHT_BITS = 18, 20, 9
TOTAL_BITS, WHOLE = UNIT_BITS + WEIGHT_BITS, 1 << WEIGHT_BITS
#: An entry is an id, and below it a confidence from 0 (nothing seen) to SURE: of order 2 in the bits TWO, of order 1 in the
#: bits ONE. With three more bits (both name the same id; order 2 was right; order 1 was right) these make up a case.
ENTRY_BITS, TWO, ONE, SAME, SURE = 9, 6, 3, 4, 7
CASES = 1 << ENTRY_BITS
HEAD = struct.Struct("<III")  # crc32 of what follows, ids, lanes


def _cases() -> tuple[np.ndarray, ...]:
    """Of each case: the confidences, and whether order 2, order 1 was right."""
    c = np.arange(CASES)
    return c >> TWO, c >> ONE & SURE, (c & 2) > 0, (c & 1) > 0


def _change(sure: np.ndarray, right: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """What an entry gains by case, and whether it is replaced: what was wrong loses half of its confidence, and its place at 1."""
    return np.where(right, sure < SURE, -(sure >> 1)) << bit, ~right & (sure < 2)


TWO_SURE, ONE_SURE, TWO_RIGHT, ONE_RIGHT = _cases()
TWO_GAIN, TWO_NEW = _change(TWO_SURE, TWO_RIGHT, TWO)
ONE_GAIN, ONE_NEW = _change(ONE_SURE, ONE_RIGHT, ONE)


class _Model:
    """What a block has taught so far."""

    def __init__(self, vocabulary: int):
        if vocabulary > 1 << UNIT_BITS - 1:
            raise ValueError(f"at most {1 << UNIT_BITS - 1} ids")
        self.none = vocabulary  # stands for the id where orders 2 or 1 gave it
        self.one, self.two = np.zeros(vocabulary, np.int64), np.zeros(1 << SLOT_BITS, np.int64)
        # low ids are frequent ones in vocabularies made by merging; the scale of this start is learned away
        self.count = 4096.0 / (np.arange(vocabulary) + 64.0)
        two, one = TWO_SURE / (SURE + 1.0), ONE_SURE / (SURE + 1.0)
        self.came = 0.02 + np.where(TWO_RIGHT, two, (1 - two) * np.where(ONE_RIGHT, one, 1 - one))
        self.told: list[tuple[np.ndarray, np.ndarray]] = []
        self.renew()

    def renew(self) -> None:
        """The distributions from all that was learned. Floating-point steps are single, exactly rounded operations."""
        if self.told:
            self.came += np.bincount(np.concatenate([c for c, _ in self.told]), minlength=CASES)
            self.count += np.bincount(np.concatenate([m for _, m in self.told]), minlength=self.none + 1)[:-1]
            self.told = []
        neither, one, two, both = self.came.reshape(-1, 4).T
        total = (neither + one) + (two + both)
        w2 = 1 + ((two + both) / total * (WHOLE - 3)).astype(np.int64)
        w1 = 1 + (one / total * (WHOLE - 3)).astype(np.int64)
        self.w2, self.w12 = np.repeat(w2, 4), np.repeat(w2 + w1, 4)
        # where a case's part of the range begins, and its width in parts
        self.base = np.stack([w2 + w1, w2, 0 * w2, 0 * w2], axis=1).ravel() << UNIT_BITS
        self.part = np.stack([WHOLE - w1 - w2, w1, w2, w2], axis=1).ravel()
        spare = (1 << UNIT_BITS) - self.none
        units = (self.count * (spare / np.cumsum(self.count)[-1])).astype(np.int64) + 1
        units[0] += (1 << UNIT_BITS) - units.sum()
        ends = np.cumsum(units)
        self.units, self.start = np.r_[units, 1 << UNIT_BITS], np.r_[ends - units, 0]

    def predict(self, a: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, ...]:
        """Entries of both orders, their ids, and the case but for what was right."""
        e1, e2 = self.one[a], self.two[slot]
        g1, g2 = e1 >> ENTRY_BITS, e2 >> ENTRY_BITS
        case = (e2 & SURE << TWO) | (e1 & SURE << ONE)
        case += (g1 == g2).view(np.int8) * np.int8(SAME)
        return e1, e2, g1, g2, case

    def learn(self, a: np.ndarray, slot: np.ndarray, e1: np.ndarray, e2: np.ndarray, case: np.ndarray, ids: np.ndarray, missed: np.ndarray) -> None:
        fresh = ids << ENTRY_BITS
        e1 += ONE_GAIN[case]
        np.copyto(e1, fresh + (1 << ONE), where=ONE_NEW[case])
        self.one[a] = e1
        e2 += TWO_GAIN[case]
        np.copyto(e2, fresh + (1 << TWO), where=TWO_NEW[case])
        self.two[slot] = e2
        self.told.append((case, missed))


def _right(case: np.ndarray, g1: np.ndarray, g2: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Completes the case; where neither order was right."""
    right = (g2 == ids).view(np.int8) * np.int8(2) + (g1 == ids).view(np.int8)
    case += right
    return right == 0


def _due(step: int) -> bool:
    return step % RENEW == 0 or step < RENEW and step & step - 1 == 0


def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place in the order-2 table of the context "b, then a"."""
    return (a * 0x9E3779B1 + b * 0x85EBCA77 & 0xFFFFFFFF) >> 32 - SLOT_BITS


def _lanes(n: int) -> tuple[int, int]:
    """Lanes of a block of n ids, and steps of each. The last lanes end in zeros, which soon cost next to nothing."""
    lanes = min(LANES, -(-n // STEPS))
    return lanes, -(-n // lanes)


def _add(low: np.ndarray, more: np.ndarray, flat: np.ndarray, pos: np.ndarray) -> None:
    """low += more; what overflows is carried into the words before."""
    low += more
    at = pos[low < more] - 1
    while len(at):
        flat[at] += np.uint32(1)
        at = at[flat[at] == 0] - 1


def _encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    lanes, steps = _lanes(len(ids))
    padded = np.zeros(lanes * steps, np.int64)
    padded[: len(ids)] = ids
    grid = np.concatenate([np.zeros((2, lanes), np.int64), padded.reshape(lanes, steps).T])  # after two ids of context
    model, low, rng = _Model(vocabulary), np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    flat, first = np.zeros(lanes * (steps + 2), np.uint32), np.arange(lanes) * (steps + 2)
    pos = first.copy()
    for t in range(steps):
        if _due(t):
            model.renew()
        before, a, now = grid[t : t + 3]
        slot = _slots(a, before)
        e1, e2, g1, g2, case = model.predict(a, slot)
        missed = np.where(_right(case, g1, g2, now), now, model.none)
        part = model.part[case]
        rng >>= U(TOTAL_BITS)
        _add(low, (model.base[case] + model.start[missed] * part).view(U) * rng, flat, pos)
        rng *= (model.units[missed] * part).view(U)
        todo = np.flatnonzero(rng < LEAST)
        at, x = pos[todo], low[todo]
        flat[at] = x >> SHIFT
        low[todo] = x << SHIFT
        rng[todo] <<= SHIFT
        pos[todo] = at + 1
        model.learn(a, slot, e1, e2, case, now, missed)
    # one word that all values beginning with it lie in the range, or else the whole low end
    wide = rng >= LEAST + LEAST
    _add(low, np.where(wide, LEAST, U(0)), flat, pos)
    flat[pos], flat[pos + 1] = low >> SHIFT, low & LAST
    count = pos + np.where(wide, 1, 2) - first
    words = flat.reshape(lanes, -1)[np.arange(steps + 2) < count[:, None]]
    block = bytearray(HEAD.pack(0, len(ids), lanes) + count.astype("<u2").tobytes() + words.astype("<u4").tobytes())
    struct.pack_into("<I", block, 0, zlib.crc32(memoryview(block)[4:]))
    return bytes(block)


def _decode_block(block: bytes, vocabulary: int) -> np.ndarray:
    _, n, lanes = HEAD.unpack_from(block)
    steps = -(-n // lanes)
    count = np.frombuffer(block, "<u2", lanes, HEAD.size).astype(np.int64)
    words = np.concatenate([np.frombuffer(block, "<u4", offset=HEAD.size + 2 * lanes), np.zeros(2, np.uint32)]).astype(U)
    pos = np.cumsum(count) - count
    code = (words[pos] << SHIFT) | words[pos + 1]  # less the range's low end, from here on
    pos += 2
    model, rng = _Model(vocabulary), np.full(lanes, 2**64 - 1, U)
    grid, every = np.zeros((steps + 2, lanes), np.int64), np.arange(vocabulary + 1, dtype=np.int32)
    for t in range(steps):
        if _due(t):
            model.renew()
            of_unit = np.repeat(every, np.r_[model.units[:-1], 1])
        before, a, now = grid[t : t + 3]
        slot = _slots(a, before)
        e1, e2, g1, g2, case = model.predict(a, slot)
        rng >>= U(TOTAL_BITS)
        value = (code // rng).view(np.int64)
        part, upto = value >> UNIT_BITS, model.w12[case]
        given = part < upto
        unit = (value - (upto << UNIT_BITS)) // (WHOLE - upto)
        unit[given] = 1 << UNIT_BITS
        now[:] = np.where(given, np.where(part < model.w2[case], g2, g1), of_unit[unit])
        missed = np.where(_right(case, g1, g2, now), now, model.none)
        part = model.part[case]
        code -= (model.base[case] + model.start[missed] * part).view(U) * rng
        rng *= (model.units[missed] * part).view(U)
        todo = np.flatnonzero(rng < LEAST)
        at = pos[todo]
        code[todo] = (code[todo] << SHIFT) | words.take(at, mode="clip")
        rng[todo] <<= SHIFT
        pos[todo] = at + 1
        model.learn(a, slot, e1, e2, case, now, missed)
    return grid[2:].T.ravel()[:n].astype(np.int32)


def encode(ids: np.ndarray, vocabulary: int, length: int = BLOCK) -> list[bytes]:
    """Blocks of ids (0 <= id < vocabulary): as few as hold ``length`` ids at most, of like lengths."""
    n = -(-len(ids) // length)
    return [_encode_block(ids[len(ids) * i // n : len(ids) * (i + 1) // n], vocabulary) for i in range(n)]


def decode(blocks: list[bytes], vocabulary: int) -> np.ndarray:
    """The ids of consecutive blocks; any block can be read alone."""
    for i, b in enumerate(blocks):
        if len(b) < HEAD.size or zlib.crc32(memoryview(b)[4:]) != HEAD.unpack_from(b)[0]:
            raise ValueError(f"block {i} is damaged: its checksum does not match")
    return np.concatenate([np.zeros(0, np.int32), *[_decode_block(b, vocabulary) for b in blocks]])
