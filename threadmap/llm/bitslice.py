"""Bit-sliced comparison of 64-bit fingerprints.

Members of a group stand in blocks of 64. A block is kept as 64 words, one for each
bit of the fingerprints, with a member in each bit position. A query is compared with
a whole block at a time: the differing bits of all members are added up by carry-save
counters, one word for each bit of the count, and rows of which every member exceeds
the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
ZERO, ONE = np.uint64(0), np.uint64(1)
#: Rows (query, block) that are compared in one sweep.
SWEEP = 1 << 16


class Blocks:
    """Fingerprints, sorted by group, cut into blocks of one group each."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        n = len(fps)
        self.fps = fps
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, n])
        #: Position of each member in its group, and the first member of its group.
        self.first = np.repeat(first, sizes)
        self.at = np.arange(n) - self.first
        per_group = (sizes + 63) // 64
        self.group_block = np.repeat(np.cumsum(per_group) - per_group, sizes)
        self.blocks_of = np.repeat(per_group, sizes)
        self.block = self.group_block + self.at // 64
        count = int(per_group.sum())
        bit = (self.at % 64).astype(np.uint64)
        self.start = np.zeros(count, np.int64)
        head = np.flatnonzero(self.at % 64 == 0)
        self.start[self.block[head]] = head
        self.filled = np.zeros(count, np.uint64)
        np.bitwise_or.at(self.filled, self.block, ONE << bit)
        self.planes = np.zeros((64, count), np.uint64)
        for b in range(64):
            np.bitwise_or.at(self.planes[b], self.block, ((fps >> np.uint64(b)) & ONE) << bit)

    def compare(self, query: np.ndarray, block: np.ndarray, allowed: np.ndarray, radius: int):
        """hits, distance, nearest: the members of each row within the radius; the least distance; its first member.

        distance and nearest hold only where hits is not zero.
        """
        rows = len(query)
        hits, distance, nearest = np.zeros(rows, np.uint64), np.full(rows, 99, np.int16), np.zeros(rows, np.int64)
        for at in range(0, rows, SWEEP):
            part = slice(at, min(rows, at + SWEEP))
            hits[part], distance[part], nearest[part] = self._sweep(query[part], block[part], allowed[part], radius)
        return hits, distance, nearest

    def _sweep(self, query, block, allowed, radius):
        width = max(1, int(radius).bit_length())
        live = np.flatnonzero(allowed)
        hits, distance, nearest = np.zeros(len(query), np.uint64), np.full(len(query), 99, np.int16), np.zeros(len(query), np.int64)
        fp, own, keep = self.fps[query[live]], block[live], allowed[live]
        counts, over = [np.zeros(len(live), np.uint64) for _ in range(width)], np.zeros(len(live), np.uint64)
        for b in range(64):
            carry = self.planes[b][own] ^ (ZERO - ((fp >> np.uint64(b)) & ONE))
            for k in range(width):
                counts[k], carry = counts[k] ^ carry, counts[k] & carry
            over |= carry
            if b % 8 == 7:
                near = keep & ~self._exceeds(counts, over, radius)
                still = near != 0
                if not still.all():
                    live, fp, own, keep, over, near = (x[still] for x in (live, fp, own, keep, over, near))
                    counts = [c[still] for c in counts]
                if not len(live):
                    return hits, distance, nearest
        least, found = np.zeros(len(live), np.int16), near
        for k in reversed(range(width)):
            smaller = found & ~counts[k]
            some = smaller != 0
            found = np.where(some, smaller, found)
            least += np.where(some, 0, 1 << k).astype(np.int16)
        low = found & (ZERO - found)
        hits[live], distance[live] = near, least
        nearest[live] = self.start[own] + np.bitwise_count(low - ONE)
        return hits, distance, nearest

    @staticmethod
    def _exceeds(counts, over, radius):
        greater, equal = over.copy(), ~over
        for k in reversed(range(len(counts))):
            if radius >> k & 1:
                equal &= counts[k]
            else:
                greater |= equal & counts[k]
                equal &= ~counts[k]
        return greater


def roots(fps: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For each member the first member of its component under links within the radius in its group."""
    b = Blocks(fps, group)
    label = np.arange(len(fps))
    times = b.blocks_of
    query = np.repeat(np.arange(len(fps)), times)
    block = np.repeat(b.group_block, times) + (np.arange(len(query)) - np.repeat(np.cumsum(times) - times, times))
    hits, _, _ = b.compare(query, block, b.filled[block], radius)
    some = np.flatnonzero(hits)
    query, block, hits = query[some], block[some], hits[some]
    most = int(np.bitwise_or.reduce(hits)).bit_length() if len(hits) else 0
    while True:
        before = label.copy()
        for bit in range(most):
            on = np.flatnonzero((hits >> np.uint64(bit)) & ONE)
            member, q = b.start[block[on]] + bit, query[on]
            least = np.minimum(label[member], label[q])
            np.minimum.at(label, member, least)
            np.minimum.at(label, q, least)
        label = label[label]
        if (label == before).all():
            return label


def nearest_earlier(fps: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For each member the nearest one in the first block before it that has any within the radius, else -1."""
    b = Blocks(fps, group)
    found = np.full(len(fps), -1, np.int64)
    wave = 0
    while True:
        open_ = np.flatnonzero((found < 0) & (b.at >= 1) & (b.at > wave * 64))
        if not len(open_):
            return found
        block = b.group_block[open_] + wave
        position = b.at[open_] - wave * 64
        before = np.where(position >= 64, FULL, (ONE << np.minimum(position, 63).astype(np.uint64)) - ONE)
        hits, _, nearest = b.compare(open_, block, b.filled[block] & before, radius)
        some = hits != 0
        found[open_[some]] = nearest[some]
        wave += 1


def earlier_hits(fps: np.ndarray, group: np.ndarray, radius: int, label: np.ndarray, done: np.ndarray, most: int, fits: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """member, other, done: members before each one in its group, within the radius and of another label.

    Each member goes on from the position done of its group, gives up to most others, and
    its new position is returned; that is its own where none are left. Of those within the
    radius only those that fits(member, other) leaves count, where it is given.
    """
    b = Blocks(fps, group)
    done, left = np.array(done, np.int64), np.full(len(fps), most, np.int64)
    # the members of each block by label, as masks
    names, label = np.unique(label, return_inverse=True)
    code = b.block * (len(names) + 1) + label
    codes, place = np.unique(code, return_inverse=True)
    same = np.zeros(len(codes), np.uint64)
    np.bitwise_or.at(same, place, ONE << (b.at % 64).astype(np.uint64))
    members, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        open_ = np.flatnonzero((done < b.at) & (left > 0))
        if not len(open_):
            return np.concatenate(members), np.concatenate(others), done
        wave = done[open_] // 64
        block, position = b.group_block[open_] + wave, b.at[open_] - wave * 64
        before = np.where(position >= 64, FULL, (ONE << np.minimum(position, 63).astype(np.uint64)) - ONE)
        want = block * (len(names) + 1) + label[open_]
        at = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
        own = np.where(codes[at] == want, same[at], ZERO)
        allowed = b.filled[block] & before & ~own & (FULL << (done[open_] % 64).astype(np.uint64))
        hits, _, _ = b.compare(open_, block, allowed, radius)
        done[open_] = np.minimum(b.at[open_], (wave + 1) * 64)
        rows = np.flatnonzero(hits)
        for at in range(0, len(rows) if fits else 0, SWEEP // 8):
            some = rows[at : at + SWEEP // 8]
            bits = np.unpackbits(hits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, bit = np.nonzero(bits)
            bits[i, bit] = fits(open_[some[i]], b.start[block[some[i]]] + bit)
            hits[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
        rows = rows[hits[rows] != 0]
        while len(rows):
            low = hits[rows] & (ZERO - hits[rows])
            bit = np.bitwise_count(low - ONE).astype(np.int64)
            q = open_[rows]
            members.append(q)
            others.append(b.start[block[rows]] + bit)
            hits[rows] ^= low
            left[q] -= 1
            full = left[q] == 0
            done[q[full]] = np.minimum(b.at[q], wave[rows] * 64 + bit + 1)[full]
            rows = rows[(hits[rows] != 0) & ~full]
