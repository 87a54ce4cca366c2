"""Texts as codes of their distinct words, and what was worked out for words, kept by code.

Texts are split and their distinct words found by Arrow. A worker keeps, up to a number of
words, the code of each word that it met and the ids that the word stands for, so that only
new words are encoded, and the ids of texts are put together by numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at once; one longer text is split alone.
SLICE_BYTES = 1 << 23


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of slices of the column of about so many bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, stop
        at = stop


def split_at_spaces(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs between spaces, empty ones included, of all texts, and how many each text has. Null is empty."""
    lists = pc.split_pattern(pc.fill_null(column, ""), " ")
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def split_at_white_space(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words between 0x20 and 0x09 to 0x0D of all texts, and how many each text has. Null is empty."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    flat = lists.flatten()
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.r_[0, np.cumsum(some)]
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    counts = np.diff(np.r_[0, before[ends]])
    return flat.filter(pa.array(some)), counts


def distinct(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each value among the distinct ones, and these."""
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


class Table:
    """Codes of words, and the ids of each code in one flat array.

    ids_of gives for new words all their ids and the number of ids of each. The table starts
    anew where it has more words than ``most`` when the next texts come.
    """

    def __init__(self, ids_of: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int, kind: str = "<u4"):
        self.ids_of, self.most, self.kind = ids_of, most, kind
        self.clear()

    def clear(self) -> None:
        self.code: dict = {}
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.kind)
        self.used = 0

    def room(self) -> bool:
        """Starts anew if the table is full; whether it did."""
        full = len(self.code) > self.most
        if full:
            self.clear()
        return full

    def codes(self, words: list) -> np.ndarray:
        """The codes of the words, which are learned where they are new. Words may be repeated."""
        code = self.code
        found = [*map(code.get, words)]
        if None in found:
            new = list(dict.fromkeys(w for w, c in zip(words, found) if c is None))
            ids, sizes = self.ids_of(new)
            n = len(code)
            code.update(zip(new, range(n, n + len(new))))
            self.starts = _put(self.starts, n, self.used + np.cumsum(sizes) - sizes)
            self.sizes = _put(self.sizes, n, sizes)
            self.flat = _put(self.flat, self.used, ids)
            self.used += len(ids)
            found = [code[w] if c is None else c for w, c in zip(words, found)]
        return np.array(found, np.int64)

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the codes in a row, and the number of ids of each."""
        sizes = self.sizes[codes]
        return self.flat[ranges(self.starts[codes], sizes)], sizes


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """The array, in a larger copy where it is too small, with the values at a place."""
    if at + len(values) > len(array):
        array = np.concatenate([array[:at], np.zeros(max(at, len(values)) + len(values), array.dtype)])
    array[at : at + len(values)] = values
    return array


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of so many values; 0 for empty runs."""
    total = np.r_[np.zeros(1, values.dtype), np.cumsum(values)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
