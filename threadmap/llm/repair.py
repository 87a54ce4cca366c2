"""Re-Pair grammar compression of id sequences.

Frequent pairs of adjacent symbols are replaced by nonterminals, round after round, until
no pair is frequent. A round counts pairs, gives a nonterminal to each frequent one, and
replaces their occurrences from the left where they overlap; a pair that others leave too
few places gets none in that round. Rules keep the length of what they expand to, so any
range of ids can be decoded without expanding what is before it.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass
from functools import cached_property

import numpy as np

MAGIC = b"RPG1"
#: Disjoint occurrences that a pair needs to become a rule.
LEAST_COUNT = 48
_BUCKETS = 21
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Grammar:
    """symbols: the compressed sequence; rule i rewrites symbol base + i as (left[i], right[i])."""

    base: int
    left: np.ndarray
    right: np.ndarray
    symbols: np.ndarray

    @cached_property
    def lengths(self) -> np.ndarray:
        """The number of ids that each rule expands to."""
        out = [1] * len(self.left)
        for i, (a, b) in enumerate(zip((self.left - self.base).tolist(), (self.right - self.base).tolist())):
            out[i] = (out[a] if a >= 0 else 1) + (out[b] if b >= 0 else 1)
        return np.array(out, np.int64)


def _frequent(key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each key the number of its value among those that occur so often, or -1; and these values."""
    bits = min(_BUCKETS, max(8, len(key).bit_length()))
    bucket = ((key * _MIX) >> np.uint64(64 - bits)).astype(np.int32)
    heavy = (np.bincount(bucket, minlength=1 << bits) >= least)[bucket]
    at = np.flatnonzero(heavy)
    own = key[at]
    ordered = np.sort(own)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    pairs = ordered[first[np.diff(np.r_[first, len(ordered)]) >= least]]
    number = np.full(len(key), -1, np.int32)
    if len(pairs):
        slot = np.full(1 << bits, -1, np.int32)  # of pairs in one bucket the last has it; the others are searched
        place = ((pairs * _MIX) >> np.uint64(64 - bits)).astype(np.int32)
        slot[place] = np.arange(len(pairs))
        shared = np.flatnonzero(slot[place] != np.arange(len(pairs)))
        found = slot[bucket[at]]
        found[pairs[found] != own] = -1
        if len(shared):
            left = np.flatnonzero((found < 0) & np.isin(bucket[at], place[shared]))
            other = np.minimum(np.searchsorted(pairs, own[left]), len(pairs) - 1)
            found[left] = np.where(pairs[other] == own[left], other, -1)
        number[at] = found
    return number, pairs


def _disjoint(at: np.ndarray) -> np.ndarray:
    """Which of the places are taken where neighbours can't both be: every second one of a run, from the left."""
    fresh = np.r_[True, np.diff(at) != 1]
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    return (np.arange(len(at)) - start) % 2 == 0


def compress(ids: np.ndarray, base: int, stop: int | None = None, least: int = LEAST_COUNT) -> Grammar:
    """The grammar of ids, which are less than base. No rule begins with the id stop, so none crosses it.

    A round replaces all pairs that occur ``least`` times, so what can be frequent in the next
    one holds a nonterminal of this one, and only those places are counted. Where none is left,
    all places are counted again, and that ends it only where no pair is frequent.
    """
    seq, lefts, rights, rules = ids.astype(np.int32), [], [], 0
    fresh = 0  # symbols from here on are new to the count
    while len(seq) > 1:
        usable = seq[:-1] != stop if stop is not None else np.ones(len(seq) - 1, bool)
        if fresh:
            new = seq >= fresh
            usable &= new[:-1] | new[1:]
        place = np.flatnonzero(usable)
        wide = seq.view(np.uint32).astype(np.uint64)
        number, pairs = _frequent((wide[:-1] << np.uint64(32) | wide[1:])[place], least)
        some = np.flatnonzero(number >= 0)
        at, which = place[some], number[some]
        took = _disjoint(at) if len(at) else np.zeros(0, bool)
        enough = np.bincount(which[took], minlength=len(pairs)) >= least
        if len(pairs) and not enough.any():  # pairs took places from each other: the most frequent one alone
            alone = which == np.bincount(which).argmax()
            at, which = at[alone], which[alone]
            took = _disjoint(at)
            enough = np.bincount(which[took], minlength=len(pairs)) >= least
        if not enough.any():
            if not fresh:
                break
            fresh = 0
            continue
        took &= enough[which]
        at, which = at[took], which[took]
        name = np.cumsum(enough) - 1
        lefts.append((pairs[enough] >> np.uint64(32)).astype(np.int64))
        rights.append((pairs[enough] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        fresh = base + rules
        seq[at] = fresh + name[which]
        kept = np.ones(len(seq), bool)
        kept[at + 1] = False
        seq, rules = seq[kept], rules + int(enough.sum())
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Grammar(base, join(lefts), join(rights), seq.astype(np.int64))


def _tables(g: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length in a flat table of what each rule expands to."""
    lengths = g.lengths
    starts = np.cumsum(lengths) - lengths
    flat: list[int] = []
    first = starts.tolist()
    size = lengths.tolist()
    for pair in zip(g.left.tolist(), g.right.tolist()):
        for s in pair:
            r = s - g.base
            if r < 0:
                flat.append(s)
            else:
                flat += flat[first[r] : first[r] + size[r]]
    return starts, lengths, np.array(flat, np.int64)


def expand(g: Grammar, symbols: np.ndarray | None = None) -> np.ndarray:
    """The ids that the symbols, all of them if none are given, stand for."""
    symbols = g.symbols if symbols is None else symbols
    starts, lengths, flat = _tables(g)
    rule = symbols - g.base
    is_rule = rule >= 0
    size = np.ones(len(symbols), np.int64)
    size[is_rule] = lengths[rule[is_rule]]
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    out[(ends - size)[~is_rule]] = symbols[~is_rule]
    at, n = (ends - size)[is_rule], size[is_rule]
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(at, n) + offset] = flat[np.repeat(starts[rule[is_rule]], n) + offset]
    return out


def decode_range(g: Grammar, start: int, stop: int) -> np.ndarray:
    """The ids from start up to stop: symbols before them are skipped by their lengths."""
    lengths = np.r_[g.lengths, 1]
    ends = np.cumsum(np.where(g.symbols >= g.base, lengths[np.clip(g.symbols - g.base, 0, len(lengths) - 1)], 1))
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    before = int(ends[first - 1]) if first else 0
    return expand(g, g.symbols[first : last + 1])[start - before : stop - before]


def dump(g: Grammar, documents: dict[str, np.ndarray]) -> bytes:
    """A file: magic, header, rules with their lengths, per-document columns, symbols."""
    wide = "<u2" if g.base + len(g.left) <= 1 << 16 else "<u4"
    parts = [g.left.astype("<u4"), g.right.astype("<u4"), g.lengths.astype("<u4"), *documents.values(), g.symbols.astype(wide)]
    columns = [(name, v.dtype.str, len(v)) for name, v in documents.items()]
    head = json.dumps({"base": g.base, "rules": len(g.left), "columns": columns, "symbols": [wide, len(g.symbols)]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(p.tobytes() for p in parts)


def load(data: bytes) -> tuple[Grammar, dict[str, np.ndarray]]:
    if data[:4] != MAGIC:
        raise ValueError("not a grammar file")
    size = struct.unpack("<I", data[4:8])[0]
    head, at = json.loads(data[8 : 8 + size]), 8 + size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    n = head["rules"]
    left, right, lengths = (take("<u4", n).astype(np.int64) for _ in range(3))
    documents = {name: take(kind, m) for name, kind, m in head["columns"]}
    g = Grammar(head["base"], left, right, take(*head["symbols"]).astype(np.int64))
    if (g.lengths != lengths).any():
        raise ValueError("expansion lengths differ")
    return g, documents
