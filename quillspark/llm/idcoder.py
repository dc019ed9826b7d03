"""A context-mixing range coder for 16-bit ids, many blocks in step.

Three predictions are mixed linearly. Order 0 gives every id its share in the
segment: ids are put into classes of near equal frequency, whose counts stand
in the segment's header. Order 1 and order 2 each name the id which followed
the last one or two ids, with a confidence. The weights of order 1 and order 2
adapt, for each pair of confidences, to how often each has been right; the rest
is order 0's. So

    P(x) = w2 [x = guess2] + w1 [x = guess1] + (1 - w1 - w2) P0(x)

drives a range coder with 32-bit words and carries. Every block starts anew: no
guesses or weights of one block are seen by another. A numpy lane codes a block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
#: Slots of the tables which hold the guesses of order 1 and order 2.
SLOTS = (1 << 10, 1 << 10)
#: Probabilities are parts of 2**TOTAL; order 0's are parts of 2**SHARES.
TOTAL, SHARES = 28, 20
#: What a unit of an order's 15-bit weight is worth, so that order 0 keeps a sixteenth at least.
_WEIGHT = (1 << TOTAL - 15) * 15 // 16
_CONFIDENCES = 8
_WORD = np.uint64(32)
_END = np.uint64(1 << 32)

# A first guess of the weights: how often a guess of each confidence is right.
_RIGHT = np.array([0.02, 0.2, 0.45, 0.62, 0.74, 0.81, 0.86, 0.93])
# The next confidence, shifted to its place in a slot, by hit * 8 + confidence.
_NEXT = np.array([c >> 1 for c in range(8)] + [min(c + 1, 7) for c in range(8)], np.int32) << 16


def _class_starts(n: int) -> np.ndarray:
    """First rank of each class: one rank each at first, then about a sixteenth of the ranks before."""
    starts, r = [], 0
    while r < max(n, 1):
        starts.append(r)
        r += 1 << max(1, r // 16).bit_length() - 1
    return np.array(starts, np.int32)


class Alphabet:
    """The ids of a segment by class, most frequent first, and the classes' counts."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids, counts
        n = max(1, len(ids))
        members = np.diff(np.append(_class_starts(n), n)).astype(np.int64)
        parts, scale = members * max(1, int(counts.sum())), 1 << SHARES
        # each id has a part at least; what those cost is taken from all, until they fit
        while (over := int((members * (share := np.maximum(1, counts * scale // parts))).sum()) - (1 << SHARES)) > 0:
            scale -= over
        self.share = np.repeat(share, members).astype(np.int32)
        self.end = self.share.cumsum(dtype=np.int32)
        self.begin = self.end - self.share

    def rank_at(self) -> np.ndarray:
        """The rank which has each part; parts without one belong to the last."""
        at = np.repeat(np.arange(len(self.share)).astype(np.uint16), self.share)
        return np.append(at, np.full((1 << SHARES) + 1 - len(at), len(self.share) - 1, np.uint16))

    @classmethod
    def of(cls, ids: np.ndarray) -> Alphabet:
        n = np.bincount(ids, minlength=1 << 16)
        held = np.flatnonzero(n)
        held = held[np.lexsort((held, -n[held]))]
        starts = _class_starts(len(held))
        ends = np.append(starts[1:], len(held)) if len(held) else starts
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            held[a:b] = np.sort(held[a:b])
        counts = np.add.reduceat(n[held], starts) if len(held) else np.zeros(1, np.int64)
        return cls(held.astype(np.uint16), counts)

    def to_bytes(self) -> bytes:
        gaps = np.diff(self.ids.astype(np.int32), prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2)
        packed = zlib.compress(np.ascontiguousarray(gaps.T).tobytes() + self.counts.astype("<u4").tobytes(), 9)
        return struct.pack("<II", len(self.ids), len(packed)) + packed

    @classmethod
    def from_bytes(cls, data: bytes, at: int) -> tuple[Alphabet, int]:
        n, size = struct.unpack_from("<II", data, at)
        raw = zlib.decompress(data[at + 8 : at + 8 + size])
        gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 2 * n).reshape(2, n).T).view("<u2").reshape(-1)
        counts = np.frombuffer(raw, "<u4", offset=2 * n).astype(np.int64)
        return cls(np.cumsum(gaps.astype(np.int64)).astype(np.uint16), counts), at + 8 + size

    def ranks(self, ids: np.ndarray) -> np.ndarray:
        to = np.zeros(1 << 16, np.uint16)
        to[self.ids] = np.arange(len(self.ids))
        return to[ids]


class _Model:
    """The guesses and weights of all lanes; ids are ranks of the alphabet."""

    def __init__(self, lanes: int):
        row = np.arange(lanes)
        self.slot_base = [row * s for s in SLOTS]
        self.slots = [np.zeros(lanes * s, np.int32) for s in SLOTS]
        self.mix_base = row * (2 * _CONFIDENCES**2)
        two, one, same = np.meshgrid(_RIGHT, _RIGHT, [False, True], indexing="ij")
        w2 = np.where(same, np.maximum(one, two), two)
        w1 = np.where(same, 0, (1 - two) * one)
        # the weight of order 2 above that of order 1
        self.weight = np.tile(((w2 * 32767).astype(np.int32) << 16 | (w1 * 32767).astype(np.int32)).reshape(-1), lanes)
        self.last = [np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)]

    def look(self, m: int) -> None:
        """The guesses of orders 1 and 2 in the first ``m`` lanes, what each adds, and what a part of order 0 is worth."""
        one, two = self.last[0][:m], self.last[1][:m]
        mixed = one * 40503
        self.at = [self.slot_base[0][:m] + (mixed >> 5 & SLOTS[0] - 1), self.slot_base[1][:m] + (mixed + two * 30011 >> 4 & SLOTS[1] - 1)]
        held = [self.slots[k].take(self.at[k], mode="clip") for k in range(2)]
        self.guess = [h & 0xFFFF for h in held]
        self.sure = [h >> 16 for h in held]
        self.same = self.guess[0] == self.guess[1]
        self.context = self.mix_base[:m] + ((self.sure[1] << 4) + (self.sure[0] << 1) + self.same)
        packed = self.weight.take(self.context, mode="clip")
        self.w = [packed & 0xFFFF, packed >> 16]
        self.adds = [w * _WEIGHT for w in self.w]
        self.unit = ((1 << TOTAL) - self.adds[0] - self.adds[1]) >> SHARES

    def place(self, x: np.ndarray, begin: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of ranks ``x`` in the mix, from those which order 0 has for them."""
        (one, two), (add1, add2) = self.guess, self.adds
        self.hit = [one == x, two == x]
        at = self.unit * begin
        at += add1 * (one < x)
        at += add2 * (two < x)
        width = self.unit * share
        width += add1 * self.hit[0]
        width += add2 * self.hit[1]
        return at, width

    def find(self, value: np.ndarray, a: Alphabet, rank_at: np.ndarray) -> np.ndarray:
        """The ranks whose ranges in the mix hold ``value``: what the guesses add is taken out, the lesser one's first."""
        (one, two), (add1, add2) = self.guess, self.adds
        swap = one > two
        for g, add in ((np.minimum(one, two), np.where(swap, add2, add1)), (np.maximum(one, two), np.where(swap, add1, add2))):
            last = self.unit * a.end.take(g, mode="clip")
            last -= 1  # of the guess's own part; what is added comes after it
            value = np.minimum(value, np.maximum(value - add, last))
        # exact: a quotient of such numbers is not so near below a whole one
        return rank_at.take((value / self.unit).astype(np.int64), mode="clip")

    def learn(self, m: int, x: np.ndarray) -> None:
        """``x``: ranks whose place was asked for."""
        for k in range(2):
            sure = self.sure[k]
            self.slots[k][self.at[k]] = np.where(sure > 1, self.guess[k], x) | _NEXT.take((self.hit[k].view(np.int8) << 3) + sure, mode="clip")
        w1, w2 = self.w
        w1 += ((self.hit[0] > self.same) * np.int32(32767) - w1) >> 4
        w2 += (self.hit[1] * np.int32(32767) - w2) >> 4
        self.weight[self.context] = w2 << 16 | w1
        self.last = [x.astype(np.int64), self.last[0][:m]]


def _sizes(n: int, block: int) -> list[int]:
    return [min(block, n - a) for a in range(0, n, block)]


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, list[bytes]]:
    """The alphabet of ``ids`` (uint16) and the code of each block of them."""
    alphabet = Alphabet.of(ids)
    sizes = _sizes(len(ids), block)
    lanes = len(sizes)
    if not lanes:
        return alphabet.to_bytes(), []
    grid = np.zeros((lanes, block), np.uint16)
    grid.reshape(-1)[: len(ids)] = alphabet.ranks(ids)
    grid = np.ascontiguousarray(grid.T)
    model = _Model(lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    room = sizes[0] + 3  # no id takes more than a word
    out, size = np.zeros(lanes * room, np.uint32), np.arange(lanes) * room
    first = size.copy()
    for t in range(sizes[0]):
        m = lanes if t < sizes[-1] else lanes - 1  # only the last block is shorter
        x = grid[t, :m].astype(np.int32)
        model.look(m)
        begin, part = model.place(x, alphabet.begin.take(x, mode="clip"), alphabet.share.take(x, mode="clip"))
        model.learn(m, x)
        r = width[:m] >> np.uint64(TOTAL)
        add = r * begin.astype(np.uint64)
        low[:m] += add
        width[:m] = r * part.astype(np.uint64)
        carry = size[:m][low[:m] < add]
        while len(carry):
            carry = carry - 1
            out[carry] += np.uint32(1)
            carry = carry[out[carry] == 0]
        go = np.flatnonzero(width[:m] < _END)
        at = size[go]
        word = low[go]
        out[at] = word >> _WORD
        size[go] = at + 1
        low[go] = word << _WORD
        width[go] <<= _WORD
    tail = low.astype(">u8")
    out = out.astype(">u4", copy=False)
    return alphabet.to_bytes(), [out[a:b].tobytes() + tail[k : k + 1].tobytes() for k, (a, b) in enumerate(zip(first.tolist(), size.tolist(), strict=True))]


def decode(alphabet: Alphabet, parts: list[bytes], n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of a segment's blocks. Damaged code gives other ids, which the checksums find."""
    sizes = _sizes(n, block)
    lanes = len(sizes)
    if not lanes:
        return np.zeros(0, np.uint16)
    most = max(map(len, parts)) // 4 + sizes[0] + 2
    words = np.zeros((lanes, most), np.uint32)
    for k, p in enumerate(parts):
        words[k, : len(p) // 4] = np.frombuffer(p, ">u4", len(p) // 4)
    words, at = words.reshape(-1), np.arange(lanes) * most
    width = np.full(lanes, (1 << 64) - 1, np.uint64)
    code = words[at].astype(np.uint64) << _WORD | words[at + 1].astype(np.uint64)
    at += 2
    model, rank_at = _Model(lanes), alphabet.rank_at()
    grid = np.zeros((sizes[0], lanes), np.uint16)
    limit = np.uint64((1 << TOTAL) - 1)
    for t in range(sizes[0]):
        m = lanes if t < sizes[-1] else lanes - 1
        model.look(m)
        r = width[:m] >> np.uint64(TOTAL)
        value = np.minimum(code[:m] // r, limit).astype(np.int32)
        found = model.find(value, alphabet, rank_at)
        grid[t, :m] = found
        x = found.astype(np.int32)
        begin, part = model.place(x, alphabet.begin.take(x, mode="clip"), alphabet.share.take(x, mode="clip"))
        model.learn(m, x)
        code[:m] -= r * begin.astype(np.uint64)
        width[:m] = r * part.astype(np.uint64)
        go = np.flatnonzero(width[:m] < _END)
        i = at[go]
        code[go] = code[go] << _WORD | words.take(i, mode="clip")
        at[go] = i + 1
        width[go] <<= _WORD
    ranks = grid.T.reshape(-1)[:n] if n == lanes * sizes[0] else np.concatenate([grid[:s, k] for k, s in enumerate(sizes)])
    ids = np.zeros(1 << 16, np.uint16)
    ids[: len(alphabet.ids)] = alphabet.ids
    return ids[ranks]
