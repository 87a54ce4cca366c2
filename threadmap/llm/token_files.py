"""Token-id files: documents in the order of doc_id, encoded, and compressed by Re-Pair.

Documents are dealt to tasks by ranges of doc_id and sorted there; equal ids are ordered
by text. Each task encodes its texts with the tokenizers library, appends the end id to
each, and writes shards of a bounded number of ids, each compressed on its own. Writers
give each attempt's file its own name, and only files of the saved manifest are read.

What the library's pattern cuts is encoded piece by piece by the library's model, and kept by
the piece, up to a number of pieces. The cuts stand before a space, unless white space stands
next to it, so each distinct run of text between spaces is cut once.

Defined cases: a null text counts as empty, so it is the end id alone. Null doc_ids come
first. Strings of special tokens become special ids, as the library has it by default.
Repeated rows are documents of their own. An empty table gives no files. Texts of any
length are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repair
from .bpe import byte_letters
from .common import filesystem, partitions, save, scratch
from .words import Table, distinct, ranges, slices, split_at_spaces, sums

END_ID, SHARD_IDS, KEPT = 0, 2_000_000, 1_000_000
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_RARE = re.compile("[\x1c-\x1f\x85\u0250-\U0010ffff]")
#: The cut of byte-level vocabularies of this kind, a fixed value.
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class RunEncoder:
    """Encodes texts with a byte-level vocabulary: the library's model on each piece of the library's cut.

    Texts are split at spaces; each distinct run is cut once, and the ids of pieces are kept.
    A run that is empty, or begins or ends with white space, can't stand alone; a text with one
    is cut whole. Texts with characters whose classes differ between versions of Unicode, or
    with a special token's string, go to the library.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()] if special else []
        self.size = self.library.get_vocab_size()
        self.letters = byte_letters()
        self.pieces = Table(self._of_pieces, KEPT)

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, sizes, tokenize = array("I"), [], self.model.tokenize
        for p in pieces:
            letters = p.replace(" ", "\u0120") if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in tokenize(letters)]
            out.extend(ids)
            sizes.append(len(ids))
        return np.array(out, "<u4"), np.array(sizes, np.int64)

    def _of_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs that follow a space. A space begins each of them in their joined text, so their cuts are told apart."""
        if not runs:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        pieces = _CUT.findall(" " + " ".join(runs))
        first = np.flatnonzero(np.fromiter((p[0] == " " for p in pieces), bool, len(pieces)))
        ids, sizes = self._ids_of(pieces)
        return ids, np.add.reduceat(sizes, first)

    def _ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.pieces.room()
        return self.pieces.ids(self.pieces.codes(pieces))

    def _one(self, text: str) -> np.ndarray:
        """The ids of a text that is cut whole."""
        plain = not any(s in text for s in self.special) and not (_ODD_SPACE if text.isascii() else _RARE).search(text)
        if plain:
            return self._ids_of(_CUT.findall(text))[0]
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _entangled(self, runs: pa.Array) -> np.ndarray:
        """Which runs are empty, begin or end with white space, or have rare characters or a special token's string."""
        offsets = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset : runs.offset + len(runs) + 1].astype(np.int64)
        data = np.frombuffer(runs.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        # from 0xC9 on characters from U+0240 on begin; 0xC2 begins U+0085 and U+00A0, which are white space
        odd = (data >= 0xC9) | ((data >= 0x1C) & (data <= 0x1F))
        odd[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        before = np.r_[0, np.cumsum(odd)]
        out = before[offsets[1:]] > before[offsets[:-1]]
        out |= offsets[1:] == offsets[:-1]
        some = np.flatnonzero(~out)
        white = np.zeros(256, bool)
        white[[0x20, *range(0x09, 0x0E)]] = True
        out[some] = white[data[offsets[:-1][some]]] | white[data[offsets[1:][some] - 1]]
        for s in self.special:
            out |= pc.match_substring(runs, s).to_numpy(zero_copy_only=False)
        return out

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice of the texts, in order, all their ids and the number of ids of each text."""
        for a, b in slices(column):
            texts = column.slice(a, b - a)
            flat, counts = split_at_spaces(texts)
            which, found = distinct(flat)
            ends = np.cumsum(counts)
            after = np.ones(len(which), bool)
            after[ends - counts] = False
            # the first run of a text follows no space; rare and entangled runs make their text one that is cut whole
            alone = ~self._entangled(found)
            runs = found.to_pylist()
            whole = np.zeros(len(counts), bool)
            whole[np.repeat(np.arange(len(counts)), counts)[~alone[which]]] = True
            first = which[ends - counts]
            later = which[after & np.repeat(~whole, counts)]
            used = np.zeros(len(runs), bool)
            used[later] = True
            own_ids, own_sizes = self._of_runs([r for r, u in zip(runs, used.tolist()) if u])
            number = (np.cumsum(used) - 1)[later]
            sizes = own_sizes[number]
            ids = own_ids[ranges((np.cumsum(own_sizes) - own_sizes)[number], sizes)]
            of_text = np.zeros(len(counts), np.int64)
            of_text[~whole] = sums(sizes, counts[~whole] - 1)
            cut = [_CUT.findall(runs[f]) for f in first[~whole].tolist()]
            own_ids, own_sizes = self._ids_of([p for pieces in cut for p in pieces])
            of_first = np.zeros(len(counts), np.int64)
            of_first[~whole] = sums(own_sizes, np.array([*map(len, cut)], np.int64))
            at, own, parts, out = 0, 0, [], of_first + of_text
            for i, (m, n) in enumerate(zip(of_first.tolist(), of_text.tolist())):
                if whole[i]:
                    parts.append(self._one(texts[i].as_py() or ""))
                    out[i] = len(parts[-1])
                    continue
                parts += [own_ids[own : own + m], ids[at : at + n]]
                own, at = own + m, at + n
            yield np.concatenate(parts) if parts else np.zeros(0, "<u4"), out


_encoders: dict[str, RunEncoder] = {}


def encoder_of(path: str) -> RunEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = RunEncoder(path)
    return _encoders[path]


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes the files; the saved manifest (part, shard, path, documents, ids), which has them in order of (part, shard)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    base = scratch(docs.sparkSession, "token-files")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        fs, root = filesystem(base)
        fs.create_dir(root, recursive=True)
        end, part = np.array([end_id], "<u4"), TaskContext.get().partitionId()
        kept: list[np.ndarray] = []
        numbers: list[int | None] = []
        held, done = 0, []

        def flush() -> None:
            nonlocal held
            ids = np.concatenate(kept)
            grammar = repair.compress(ids, encoder.size, end_id)
            columns = {
                "doc_id": np.array([n or 0 for n in numbers], "<i8"),
                "no_id": np.array([n is None for n in numbers], "u1"),
                "n_tokens": np.array([len(k) for k in kept], "<i8"),
            }
            name = f"{uuid.uuid4().hex}.rpg"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(repair.dump(grammar, columns))
            done.append((part, len(done), f"{base}/{name}", len(kept), len(ids)))
            kept.clear()
            numbers.clear()
            held = 0

        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for ids, sizes in encoder.encode(batch.column(1)):
                at = 0
                for n in sizes.tolist():
                    kept.append(np.concatenate([ids[at : at + n], end]))
                    numbers.append(next(names))
                    at += n
                    held += n + 1
                    if held >= SHARD_IDS:
                        flush()
        if kept:
            flush()
        yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["part", "shard", "path", "documents", "ids"]).astype({"path": str}), preserve_index=False)

    return save(rows.mapInArrow(files, "part long, shard long, path string, documents long, ids long"), "token-manifest")


def offsets(manifest: DataFrame) -> DataFrame:
    """The manifest with first: the ids in all files before. Parts are summed first, so one task sees a row for each part."""
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("own"))
    before = F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("of_part"))
    within = F.sum("ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("of_shard", F.coalesce(within, F.lit(0))).join(parts, "part").withColumn("first", F.col("of_part") + F.col("of_shard"))


def read(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of each document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for listed in batches:
            for path, first, expected in zip(listed["path"], listed["first"], listed["ids"]):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as stream:
                    grammar, columns = repair.load(stream.read())
                flat = repair.expand(grammar).astype("<u4")
                if len(flat) != expected or columns["n_tokens"].sum() != expected:
                    raise ValueError(f"{path} has {len(flat)} ids, not {expected}")
                ends = np.cumsum(columns["n_tokens"])
                starts = ends - columns["n_tokens"]
                raw = memoryview(flat.tobytes())
                frame = pd.DataFrame({
                    "doc_id": pd.array(np.where(columns["no_id"], None, columns["doc_id"]), "Int64"),
                    "start": starts + first,
                    "n_tokens": columns["n_tokens"],
                    "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())],
                })
                if ids:
                    frame["ids"] = [flat[a:b].astype(np.int64) for a, b in zip(starts, ends)]
                yield frame

    return offsets(manifest).repartition(partitions(manifest.sparkSession), "path").mapInPandas(scan, schema)
