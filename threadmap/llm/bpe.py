"""BPE encoding with a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of the tree are the symbols of a word; a leaf holds the rank of the merge of
its symbol with the next one, and its position. The root is the leftmost of the merges
of lowest rank. A merge changes three leaves, so each is a few updates of logarithmic
length, until no pair can be merged. Many words of one padded length are merged in step,
as rows of numpy arrays; a long one is merged alone. What was encoded is kept by word, up to
a fixed number of words.

Defined cases: a null text counts as empty and has no ids. The special tokens' strings
in a text become special ids, as the library has it by default. Texts may be of any
length; a word of any length is encoded whole. Repeated rows each give a row; a null
doc_id stays null. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Table, distinct, ranges, slices, split_at_white_space, sums

#: Words that are kept with their ids in each worker, and cells of one step's arrays.
KEPT_WORDS, CELLS = 350_000, 1 << 20
#: Letters of a piece, rounded up to a power of two, above which it is merged alone.
LONG = 512
NONE = np.int32((1 << 31) - 1)
_RARE = re.compile("[\x1c-\x1f\x85\xa0\u0250-\U0010ffff]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merges of one tokenizer file, and the merging of words."""

    def __init__(self, path: str, most_merges: int | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if most_merges is not None:  # the first merges alone, and the symbols that they make
            model["merges"] = model["merges"][:most_merges]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        missing = -2
        self.first = np.array([self.vocab.get(letters[b], missing) for b in range(256)], np.int32)
        self.last = np.array([self.vocab.get(letters[b] + self.suffix, missing) for b in range(256)], np.int32)
        pairs = [(self.vocab[a] << 32 | self.vocab[b], rank, self.vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])]
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.ranks = np.array([p[1] for p in pairs], np.int32)
        self.made = np.zeros(len(pairs), np.int32)
        self.made[self.ranks] = [p[2] for p in pairs]
        self.rank_of: dict[int, int] = {}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; -1 where a pair has none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, each of which is merged on its own, and the number of ids of each."""
        sizes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p:
                sizes.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        order, ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for width, which in sizes.items():
            step = max(1, CELLS // width)
            for at in range(0, len(which), step):
                part = which[at : at + step]
                if width > LONG:
                    own = [self._merge_long(pieces[i], width) for i in part]
                    got = np.array([x for o in own for x in o], np.int32), np.array([*map(len, own)], np.int64)
                else:
                    got = self._merge([pieces[i] for i in part], width)
                order.append(np.array(part))
                ids.append(got[0])
                counts.append(got[1])
        joined, each = np.concatenate(order), np.concatenate(counts)
        size, start = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        size[joined], start[joined] = each, np.cumsum(each) - each
        return np.concatenate(ids)[ranges(start, size)], size

    def _merge(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Many pieces in step: row after row of arrays, a tree in each."""
        rows = len(pieces)
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        symbol = np.full((rows, width + 1), -1, np.int32)
        place = np.arange(width, dtype=np.int32)
        inside = place < size[:, None]
        symbol[:, :width] = np.where(inside, self.first[raw], -1)
        symbol[np.arange(rows), size - 1] = self.last[raw[np.arange(rows), size - 1]]
        after = np.tile(place + 1, (rows, 1))
        before = np.tile(np.r_[place - 1, np.int32(width - 1)], (rows, 1))
        alive = inside.copy()

        tree = np.full((rows, 2 * width), NONE, np.int32)
        rank = self._rank(symbol[:, :width], symbol[:, 1:])
        tree[:, width:] = np.where(rank >= 0, rank * width + place, NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            best = tree[row, 1]
            i = best % width
            j = after[row, i]
            k = after[row, j]
            p = before[row, i]
            symbol[row, i] = new = self.made[best // width]
            after[row, i] = k
            before[row, k] = i
            alive[row, j] = False
            right = self._rank(new, np.where(k < width, symbol[row, k], -1))
            left = self._rank(np.where(p >= 0, symbol[row, p], -1), new)
            tree[row, width + j] = NONE
            tree[row, width + i] = np.where(right >= 0, right * width + i, NONE)
            held = p >= 0
            tree[row[held], width + p[held]] = np.where(left >= 0, left * width + p, NONE)[held]
            nodes = [width + i, width + j, width + np.maximum(p, 0)]
            for _ in range(width.bit_length() - 1):
                for n in range(3):
                    nodes[n] = up = nodes[n] >> 1
                    tree[row, up] = np.minimum(tree[row, 2 * up], tree[row, 2 * up + 1])
            row = row[tree[row, 1] < NONE]
        kept = alive & (symbol[:, :width] >= 0)
        return symbol[:, :width][kept], kept.sum(1)

    def _merge_long(self, piece: bytes, width: int) -> list[int]:
        """One long piece, whose tree is a list: a merge is some steps up from three leaves."""
        if not self.rank_of:
            self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        rank_of, made, none = self.rank_of, self.made, 1 << 62
        symbol = self.first[np.frombuffer(piece, np.uint8)].tolist()
        symbol[-1] = int(self.last[piece[-1]])
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(i: int, j: int) -> int:
            rank = rank_of.get(symbol[i] << 32 | symbol[j]) if 0 <= i and j < n and symbol[i] >= 0 and symbol[j] >= 0 else None
            return none if rank is None else rank * width + i

        tree = [none] * width + [leaf(i, i + 1) for i in range(n)] + [none] * (width - n)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j, p = after[i], before[i]
            k = after[j]
            symbol[i], symbol[j] = int(made[rank]), -1
            after[i] = k
            if k < n:
                before[k] = i
            put(j, none)
            put(i, leaf(i, k))
            if p >= 0:
                put(p, leaf(p, i))
        return [x for x in symbol if x >= 0]


class WordEncoder:
    """Encodes texts with a vocabulary of word ends: lower case, white space dropped.

    Texts are split at white space; words and the pieces that they are cut into are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        library = Tokenizer.from_file(path)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        self.byte_of = {letter: b for b, letter in byte_letters().items()}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(f"{pattern}| ")  # spaces part the words of a joined text
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")")
        top = max(self.merges.tokens) + 1
        self.decimal = [b"%d " % i for i in range(top)]
        self.token = [(self.merges.tokens.get(i, "") + " ").encode() for i in range(top)]
        self.pieces = Table(lambda new: self.merges.encode_pieces([p if isinstance(p, bytes) else p.encode() for p in new]), KEPT_WORDS, "<i4")
        self.words = Table(self._of_words, KEPT_WORDS, "<i4")
        self._start()

    def _start(self) -> None:
        #: Decimal ids and tokens of each word, each with a space after it.
        self.decimals: list[bytes] = []
        self.decoded: list[bytes] = []

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [w for w in words if w.isascii() and "<|" not in w and not _RARE.search(w)]
        wide = [w for w in words if not w.isascii() and "<|" not in w and not _RARE.search(w)]
        norm = dict(zip(plain, " ".join(plain).lower().split(" ")))
        norm.update(zip(wide, self.normalizer.normalize_str(" ".join(wide)).split(" ")))
        cut: list = []
        if norm:
            cut = self.pattern.findall(" ".join(norm.values()))
        gap = np.fromiter((p == " " for p in cut), bool, len(cut))
        self.pieces.room()
        ids, sizes = self.pieces.ids(self.pieces.codes([p for p in cut if p != " "]))
        size = np.zeros(len(cut), np.int64)
        size[~gap] = sizes
        per_word = np.diff(np.r_[0, np.cumsum(size)[gap], size.sum()]) if norm else np.zeros(0, np.int64)
        found = {}
        if len(norm) < len(words):  # specials' strings, and letters whose classes differ between versions of Unicode
            ends = np.cumsum(per_word)
            found = {w: ids[e - n : e] for w, e, n in zip(norm, ends.tolist(), per_word.tolist())}
            for w in words:
                if w not in found:
                    found[w] = self._by_library(w)
            ids, per_word = np.concatenate([found[w] for w in words]), np.array([len(found[w]) for w in words], np.int64)
        elif wide:
            at = dict(zip(norm, range(len(norm))))
            order = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
            ids, per_word = ids[ranges((np.cumsum(per_word) - per_word)[order], per_word[order])], per_word[order]
        at = 0
        listed = ids.tolist()
        for n in per_word.tolist():
            own = listed[at : at + n]
            at += n
            self.decimals.append(b"".join([self.decimal[i] for i in own]))
            self.decoded.append(b"".join([self.token[i] for i in own]))
        return ids, per_word

    def _by_library(self, word: str) -> np.ndarray:
        out = []
        for part in self.special.split(word):
            if part in self.merges.special:
                out.append(np.array([self.merges.special[part]], np.int32))
            elif part:
                cut = self.cutter.pre_tokenize_str(self.normalizer.normalize_str(part))
                out.append(self.merges.encode_pieces([bytes(self.byte_of[c] for c in p) for p, _ in cut])[0])
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]]:
        """For each slice of the texts all their ids, the number of ids of each text, its ids as decimals, and its tokens."""
        for a, b in slices(column):
            flat, counts = split_at_white_space(column.slice(a, b - a))
            which, words = distinct(flat)
            if self.words.room():
                self._start()
            codes = self.words.codes(words.to_pylist())[which]
            ids, sizes = self.words.ids(codes)
            listed, ends = codes.tolist(), np.cumsum(counts).tolist()
            spans = list(zip([0, *ends], ends))
            decimals, decoded = self.decimals.__getitem__, self.decoded.__getitem__
            yield (
                ids,
                sums(sizes, counts),
                [b"".join(map(decimals, listed[p:q]))[:-1] for p, q in spans],
                [b"".join(map(decoded, listed[p:q]))[:-1] for p, q in spans],
            )


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def decode(ids: list[int], path: str) -> str:
    """The tokens of the ids, joined by spaces, as the library does for a file without a decoder."""
    tokens = encoder(path).merges.tokens
    return " ".join(tokens[i] for i in ids if i in tokens)


def encoded(docs: DataFrame, path: str, ids: bool = True, decoded: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, as asked for, ids and the decoded text of each row."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            at = 0
            for flat, sizes, decimals, tokens in enc.encode(batch.column(1)):
                columns = [
                    batch.column(0).slice(at, len(sizes)),
                    pa.array(sizes),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decimals]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in tokens]),
                ]
                at += len(sizes)
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat)))
                if decoded:
                    columns.append(pa.array([x.decode() for x in tokens]))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
