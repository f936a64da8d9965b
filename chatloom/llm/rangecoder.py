"""Adaptive range coder for blocks of token ids: symbol ranking with escapes, no mixing of distributions.

Every block starts from an empty model and is coded on its own. Orders two and one
predict the id that last followed the same two ids or the same id, with a
confidence that rises and falls with its hits; order zero is the distribution of
the ids of the block so far (renewed at every doubling of their number). The
weights of the orders are counts kept for each pair of confidences: they price the
choice of the order that is right, and arithmetic coding spends those bits. An id that no order
knows is written plainly.

A block of ids is one lane of numpy arrays, kept step by step. All lanes of a group take the same
step at once, so the coder runs over thousands of blocks side by side while each
of them stays independent.
"""

from __future__ import annotations

import zlib

import numpy as np

#: ids of a block
BLOCK = 4096
#: blocks that are coded side by side
LANES = 2048
MAGIC = b"TIDS"
_HEADER = np.dtype([("magic", "S4"), ("version", "u1"), ("wide", "u1"), ("n", "<u2"), ("crc", "<u4")])

_TABLE = 2048
_TOP = 4  # confidences 0..3
_STEP = 24
_MOST = 1 << 13
_FIRST = 64  # ids before order zero takes part
_U = np.uint64
_LOW32 = _U(0xFFFFFFFF)
_ONE32 = _U(1 << 32)


class _Model:
    """Predictions and weights of all lanes; an entry is an id and, in its two low bits, the confidence."""

    def __init__(self, lanes: int, wide: bool):
        self.table = [np.zeros(lanes * _TABLE, np.uint64 if wide else np.uint32) for _ in range(2)]
        self.count = np.ones((lanes * _TOP * _TOP, 4), np.uint64)
        self.flat = self.count.reshape(-1)
        self.lane = np.arange(lanes, dtype=np.int64)
        self.row = self.lane * _TABLE

    def look(self, n: int, one: np.ndarray, two: np.ndarray) -> None:
        """Predictions of the first ``n`` lanes after the ids ``two``, ``one``."""
        first = one * 40503
        mixed = (first + (two * 30011 >> 3)) >> 2
        self.at = (self.row[:n] + (mixed & (_TABLE - 1)), self.row[:n] + ((first >> 5) & (_TABLE - 1)))
        self.entry = [self.table[k].take(self.at[k]) for k in (0, 1)]
        self.guess = [e >> 2 for e in self.entry]
        self.conf = [e & 3 for e in self.entry]
        self.base = self.lane[:n] * (_TOP * _TOP) + (self.conf[0] * _TOP + self.conf[1]).astype(np.int64)
        self.size = self.count.take(self.base, axis=0)
        # where each order starts, and the end of the last
        self.edge = np.empty((n, 4), np.uint64)
        self.edge[:, 0] = 0
        for k in (1, 2, 3):
            np.add(self.edge[:, k - 1], self.size[:, k - 1], out=self.edge[:, k])
        self.total = self.edge[:, 3] + self.size[:, 3]

    def hits(self, ids: np.ndarray) -> list[np.ndarray]:
        return [(self.guess[k] == ids) & (self.conf[k] > 0) for k in (0, 1)]

    def learn(self, order: np.ndarray, ids: np.ndarray, hits: list[np.ndarray]) -> None:
        new = (ids << 2 | 1).astype(self.table[0].dtype)
        for k in (0, 1):
            conf, entry = self.conf[k], self.entry[k]
            # a hit adds confidence, a miss takes some or, at the last, the place
            self.table[k][self.at[k]] = np.where(hits[k], entry + (conf < _TOP - 1), np.where(conf > 1, entry - 1, new))
        self.flat[self.base * 4 + order] += _U(_STEP)
        full = np.flatnonzero(self.total > _MOST)
        if len(full):
            at = self.base[full]
            self.count[at] = (self.count[at] >> _U(1)) + _U(1)


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a // b``, exact for a below 2**48: the error of a quotient is below 1 / b there."""
    return (a.astype(np.float64) / b.astype(np.float64)).astype(np.uint64)


def _history(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ids of each lane and the slots [low, high) of the id in each slot."""
    rows = np.sort(np.ascontiguousarray(ids), axis=1)
    n = rows.shape[1]
    slot = np.arange(n, dtype=np.int32)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    low = np.maximum.accumulate(np.where(new, slot, 0), axis=1)
    last = np.ones(rows.shape, bool)
    last[:, :-1] = new[:, 1:]
    high = np.minimum.accumulate(np.where(last, slot + 1, n)[:, ::-1], axis=1)[:, ::-1]
    return rows, low, high


class _Coder:
    """Interval state of all lanes: 48 bits, written or read 16 at a time."""

    def __init__(self, lanes: int, words: np.ndarray):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 1 << 48, np.uint64)
        self.words = words
        self.at = np.zeros(lanes, np.int64)

    def shift(self, lanes: np.ndarray) -> None:
        raise NotImplementedError

    def narrow(self, n: int, step: np.ndarray, low: np.ndarray, size: np.ndarray, lanes: np.ndarray | None = None) -> None:
        """Keep [low, low + size) times ``step`` of the interval, then renew ranges that got small."""
        if lanes is None:
            self.low[:n] += step * low
            self.range[:n] = step * size
            small = np.flatnonzero(self.range[:n] < _ONE32)
        else:
            self.low[lanes] += step * low
            left = step * size
            self.range[lanes] = left
            small = lanes[left < _ONE32]
        while len(small):
            low, left = self.low[small], self.range[small]
            split = (low >> _U(32)) != ((low + left - _U(1)) >> _U(32))
            if split.any():  # end the interval where its leading word changes
                left = np.where(split, _ONE32 - (low & _LOW32), left)
            self.shift(small)
            self.low[small] = (low & _LOW32) << _U(16)
            left <<= _U(16)
            self.range[small] = left
            small = small[left < _ONE32]


class _Writer(_Coder):
    def shift(self, lanes):
        self.words[lanes, self.at[lanes]] = self.low[lanes] >> _U(32)
        self.at[lanes] += 1

    def finish(self) -> None:
        for k in (32, 16, 0):
            self.words[np.arange(len(self.at)), self.at] = (self.low >> _U(k)) & _U(0xFFFF)
            self.at += 1


class _Reader(_Coder):
    def __init__(self, lanes: int, words: np.ndarray):
        super().__init__(lanes, words)
        self.code = np.zeros(lanes, np.uint64)
        for _ in range(3):
            self.shift(np.arange(lanes))

    def shift(self, lanes):
        self.code[lanes] = ((self.code[lanes] & _LOW32) << _U(16)) | self.words[lanes, self.at[lanes]]
        self.at[lanes] += 1

    def slot(self, step: np.ndarray, total: int, lanes: np.ndarray) -> np.ndarray:
        inside = self.code[lanes] - self.low[lanes]
        return np.minimum(_divide(inside, step), _U(total - 1)).astype(np.int64)


def _run(lengths: np.ndarray, wide: bool, coder: _Coder, ids: np.ndarray, reading: bool) -> None:
    """Steps of all lanes, longest lanes first; fills ``ids`` when reading."""
    lanes, most = ids.shape
    model = _Model(lanes, wide)
    one, two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    active = np.searchsorted(-lengths, -np.arange(most), side="left")  # lanes longer than the step
    size = 0
    rows = low = high = known = e_low = e_high = None
    for t in range(most):
        n = int(active[t])
        if t >= _FIRST and t & (t - 1) == 0:
            size = t
            shift = _U(t.bit_length() - 1)
            rows, low, high = _history(ids[:n, :t])
            if not reading:
                ahead = ids[:n, t : 2 * t]
                base = (np.arange(n, dtype=np.int64) << 32)[:, None]
                flat = (rows + base).ravel()
                place = np.minimum(np.searchsorted(flat, (ahead + base).ravel()), len(flat) - 1)
                known = flat[place] == (ahead + base).ravel()
                e_low, e_high = low.ravel()[place], high.ravel()[place]
                # a step takes the same place of all lanes
                known, e_low, e_high = (np.ascontiguousarray(c.reshape(ahead.shape).T) for c in (known, e_low, e_high))
        model.look(n, one[:n], two[:n])
        step = _divide(coder.range[:n], model.total)
        if reading:
            v = _divide(coder.code[:n] - coder.low[:n], step)
            order = (v >= model.edge[:, 1]).astype(np.int64) + (v >= model.edge[:, 2]) + (v >= model.edge[:, 3])
        else:
            sym = ids[:n, t]
            hits = model.hits(sym)
            order = np.where(known[t - size, :n], 2, 3) if size else np.full(n, 3)
            order[hits[1]] = 1
            order[hits[0]] = 0
        place = (model.lane[:n] << 2) + order
        coder.narrow(n, step, model.edge.reshape(-1).take(place), model.size.reshape(-1).take(place))
        if reading:
            sym = np.where(order == 0, model.guess[0], model.guess[1]).astype(np.int64)
        at = np.flatnonzero(order == 2)
        if len(at):
            step = coder.range[at] >> shift
            if reading:
                v = coder.slot(step, size, at)
                sym[at] = rows[at, v]
                a, b = low[at, v], high[at, v]
            else:
                a, b = e_low[t - size, at], e_high[t - size, at]
            coder.narrow(n, step, a.astype(np.uint64), (b - a).astype(np.uint64), at)
        at = np.flatnonzero(order == 3)
        if len(at):
            plain = np.zeros(len(at), np.int64)
            for half in (16, 0) if wide else (0,):
                step = coder.range[at] >> _U(16)
                v = coder.slot(step, 1 << 16, at) if reading else (sym[at] >> half) & 0xFFFF
                plain |= v << half
                coder.narrow(n, step, v.astype(np.uint64), np.ones(len(at), np.uint64), at)
            if reading:
                sym[at] = plain
        if reading:
            ids[:n, t] = sym
            hits = model.hits(sym)
        model.learn(order, sym, hits)
        two[:n] = one[:n]
        one[:n] = sym


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Payload of each block of at most 65,535 ids (32-bit, not negative)."""
    out: list[bytes] = []
    for a in range(0, len(blocks), LANES):
        group = blocks[a : a + LANES]
        order = sorted(range(len(group)), key=lambda i: -len(group[i]))
        lengths = np.array([len(group[i]) for i in order], np.int64)
        ids = np.zeros((int(lengths[0]), len(group)), np.int64).T
        for k, i in enumerate(order):
            ids[k, : lengths[k]] = group[i]
        wide = bool(ids.max(initial=0) > 0xFFFF)
        coder = _Writer(len(group), np.zeros((len(group), (4 if wide else 3) * ids.shape[1] + 64), np.uint16))
        _run(lengths, wide, coder, ids, reading=False)
        coder.finish()
        done = [b""] * len(group)
        for k, i in enumerate(order):
            head = np.zeros(1, _HEADER)
            head["magic"], head["version"], head["wide"], head["n"] = MAGIC, 1, wide, lengths[k]
            head["crc"] = zlib.crc32(np.ascontiguousarray(group[i], "<u4").tobytes())
            done[i] = head.tobytes() + coder.words[k, : coder.at[k]].astype("<u2").tobytes()
        out += done
    return out


def decode_blocks(payloads: list[bytes]) -> list[np.ndarray]:
    """Ids of each payload; raises where a checksum does not fit."""
    heads = [np.frombuffer(p[: _HEADER.itemsize], _HEADER)[0] for p in payloads]
    if any(h["magic"] != MAGIC or h["version"] != 1 for h in heads):
        raise ValueError("not a block of token ids")
    out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(payloads)
    for wide in (0, 1):
        mine = sorted((i for i, h in enumerate(heads) if h["wide"] == wide), key=lambda i: -int(heads[i]["n"]))
        for a in range(0, len(mine), LANES):
            group = mine[a : a + LANES]
            lengths = np.array([heads[i]["n"] for i in group], np.int64)
            coded = [np.frombuffer(payloads[i][_HEADER.itemsize :], "<u2") for i in group]
            most = (4 if wide else 3) * int(lengths[0]) + 64  # what coding takes at most, so a broken block ends too
            words = np.zeros((len(group), max(most, *map(len, coded), 3)), np.uint16)
            for k, w in enumerate(coded):
                words[k, : len(w)] = w
            ids = np.zeros((int(lengths[0]), len(group)), np.int64).T
            _run(lengths, bool(wide), _Reader(len(group), words), ids, reading=True)
            for k, i in enumerate(group):
                out[i] = ids[k, : lengths[k]].astype("<u4")
                if zlib.crc32(out[i].tobytes()) != heads[i]["crc"]:
                    raise ValueError("checksum of a block of token ids does not fit")
    return out
