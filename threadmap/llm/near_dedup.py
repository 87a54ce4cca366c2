"""SimHash near-deduplication with bit-sliced comparison.

``components_within`` links documents whose fingerprints differ in at most ``radius``
bits. Candidates share three of five bit blocks: with two differing bits at least
three blocks are equal, so no link is missed. A group that shares three blocks and is
large is keyed again by two of four blocks of its other bits; what then meets differs
in at most 13 bits, so no group can exceed 2**13 distinct fingerprints. Only distinct
fingerprints are compared, and a group yields links to its component's first member,
never all pairs.

``near_duplicates`` is the deduplication of texts at a similarity: word shingles meet in
buckets of equal minima, are compared there by fingerprint within a wide radius, and
the pairs that are found are verified by the Jaccard similarity of their shingle sets.
Pairs whose sets' bitmaps differ in more bits than sets at the similarity can are never
written; that bound is exact, so it loses no pair.

Defined cases: a null text counts as empty. Texts without words have fingerprint zero,
which links like any other; in ``near_duplicates`` texts without words are never
duplicates. Texts of fewer words than a shingle are one shingle. Rows that repeat link
to each other. A null doc_id is linked by its text and never is a component's name unless all
of its ids are null. Rows of one doc_id with other texts are documents of their own: ``drop_near_duplicates``
compares and drops rows, whose ids may be null or repeated, and rows of equal doc_id and text stay or go together;
``near_duplicates`` lists by their ids those that have one. Empty tables give empty results. Other columns are
ignored, or returned unchanged by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import bitslice, graph
from .common import LOWER, UPPER, join_counted, partitions, save, small_batches
from .words import slices

SHINGLE_SEED = 42
#: Groups with more distinct fingerprints are keyed again by further bits.
LARGE_GROUP = 2048
#: Fingerprint distance up to which pairs of the similarity join are verified. At a similarity of 0.8
#: bits differ with a chance of 0.152, and with 0.188 in texts of five shingles.
VERIFY_RADIUS = 30
#: Candidates of a document and bucket in the second round, and how many times more in each further one.
FIRST, MORE = 4, 8
#: Tables of the similarity join, and minima that make up a key: at a similarity of
#: 0.8 a pair meets in one of them but for a chance of (1 - 0.8**2)**16, 8e-8.
TABLES, MINIMA = 16, 2

#: Bits of the bitmap of a shingle set of up to 256 shingles, doubled with them, at most; so sets that differ in a few in a hundred more than may be are told apart.
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 16
#: Pairs whose bitmaps are compared in one sweep.
PAIRS = 1 << 15
#: Bytes of texts whose shingles a worker holds at once; one longer text is held alone.
HELD_BYTES = 1 << 21

_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
_PIECE = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """Words of the text as UTF-8 with A-Z in lower case, split at 0x20 and 0x09-0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of width words, repeats included; the whole where there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SHINGLE_SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]]
    spans = zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())
    return np.fromiter((digest(joined[a:b], SHINGLE_SEED) for a, b in spans), np.uint64, len(words) - width + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit b is 1 where over half of the hashes have it; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PIECE):
        part = hashes[at : at + _PIECE]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist())


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp: the fingerprint of each row's whole text, as a signed long."""

    @pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(_signed([fingerprint_of(shingle_hashes(words_of(x), width)) for x in texts]))

    return docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp"))


def _masks(blocks: int, bits: list[int], equal: int) -> list[int]:
    """The masks of each choice of equal blocks, where bits are dealt to so many blocks."""
    parts = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), blocks)]
    return [sum(choice) for choice in itertools.combinations(parts, equal)]


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(fps: DataFrame, masks: list[int], name: str, more: list[str]) -> DataFrame:
    keys = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("k")) for i, m in enumerate(masks)))
    return fps.withColumn("e", F.explode(keys)).select("fp", *more, F.col("e.i").alias(f"{name}_i"), F.col("e.k").alias(f"{name}_k"))


def _streamed_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups, from a stream that is sorted by keys."""
    kept: list[pd.DataFrame] = []
    for frame in batches:
        if not len(frame):
            continue
        last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(frame) if last.all() else int(np.flatnonzero(~last)[-1]) + 1
        if last.all() and kept and (kept[-1][keys].iloc[-1] == frame[keys].iloc[0]).all():
            kept.append(frame)
            continue
        if last.all():
            if kept:
                yield pd.concat(kept)
            kept = [frame]
            continue
        yield pd.concat([*kept, frame.iloc[:cut]])
        kept = [frame.iloc[cut:]]
    if kept:
        yield pd.concat(kept)


def _group_numbers(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    changed = np.zeros(len(frame), bool)
    for k in keys:
        v = frame[k].to_numpy()
        changed[1:] |= v[1:] != v[:-1]
    return np.cumsum(changed)


def links(fps: DataFrame, radius: int = 2, large: int = LARGE_GROUP) -> DataFrame:
    """a, b: links between distinct fingerprints whose components are those of all pairs within the radius."""
    if not 0 <= radius <= 2:
        raise ValueError("the block keys guarantee a radius of 0 to 2")
    masks = _masks(5, list(range(64)), 3)
    keyed = _keyed(fps, masks, "p", [])
    sizes = keyed.groupBy("p_i", "p_k").agg(F.count("*").alias("n")).where("n > 1")
    shared = save(keyed.join(sizes, ["p_i", "p_k"]), "shared-blocks")
    rest = [_masks(4, [b for b in range(64) if not m >> b & 1], 2) for m in masks]
    small = shared.where(F.col("n") <= large).select("fp", "p_i", "p_k", F.lit(0).alias("q_i"), F.lit(0).cast("long").alias("q_k"))
    hot = [_keyed(shared.where((F.col("n") > large) & (F.col("p_i") == i)), rest[i], "q", ["p_i", "p_k"]).select(*small.columns) for i in range(len(masks))]
    for part in hot:
        small = small.union(part)
    keys = ["p_i", "p_k", "q_i", "q_k"]
    dealt = small.repartition(partitions(fps.sparkSession), *keys).sortWithinPartitions(*keys, "fp")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _streamed_groups(batches, keys):
            fp = frame["fp"].to_numpy()
            root = bitslice.roots(fp.view(np.uint64), _group_numbers(frame, keys), radius)
            linked = root != np.arange(len(fp))
            yield pd.DataFrame({"a": fp[linked], "b": fp[root[linked]]})

    return dealt.mapInPandas(compare, "a long, b long")


def components_within(docs: DataFrame, width: int = 3, radius: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the least doc_id that links reach) for each row."""
    rows = save(fingerprints(docs, width, text, doc_id), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = graph.components(links(distinct.select("fp"), radius))
    member = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = save(member, "members")
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    names = member.join(named, "root").select("fp", "component_id")
    return rows.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _minima(hashes: np.ndarray) -> np.ndarray:
    """The keys of a shingle set: one for each table, of MINIMA minima each."""
    rng = np.random.default_rng(7)
    multiply = rng.integers(1, 1 << 63, TABLES * MINIMA, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, TABLES * MINIMA, dtype=np.uint64)
    low = np.empty(TABLES * MINIMA, np.uint64)
    for i in range(TABLES * MINIMA):
        x = hashes * multiply[i] + add[i]
        low[i] = (x ^ (x >> np.uint64(29))).min()
    low = low.reshape(TABLES, MINIMA)
    key = low[:, 0]
    for i in range(1, MINIMA):
        key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ low[:, i]
    return key


def bitmap_of(hashes: np.ndarray) -> bytes:
    """For each cell of a set's distinct hashes whether it holds an odd number; four cells a hash or more, but for very large sets."""
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < 4 * len(hashes):
        bits *= 2
    cells = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(cells.astype(np.uint8) & 1, bitorder="little").tobytes()


class Fits:
    """Which pairs of sets can be that similar, by their sizes and bitmaps.

    Sets differ in as many hashes as their bitmaps in bits, at least, and a bitmap of half the size is both halves laid over each
    other. Bitmaps that are further apart in size are not compared, as that decides no more than the sets' sizes.
    """

    def __init__(self, n: np.ndarray, bitmaps: list[bytes], similarity: float):
        self.n, self.similarity = n.astype(np.int64), similarity
        self.width = np.fromiter(map(len, bitmaps), np.int64, len(bitmaps))
        #: For each size of bitmaps its sets' ones and those of the next size laid over: rows, and the row of each set.
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.width).tolist():
            own, next_ = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            rows = [np.frombuffer(b"".join(bitmaps[i] for i in own.tolist()), np.uint64).reshape(len(own), -1)]
            if len(next_):
                both = np.frombuffer(b"".join(bitmaps[i] for i in next_.tolist()), np.uint64).reshape(len(next_), 2, -1)
                rows.append(both[:, 0] ^ both[:, 1])
            row = np.zeros(len(bitmaps), np.int64)
            row[own], row[next_] = np.arange(len(own)), len(own) + np.arange(len(next_))
            self.held[w] = np.concatenate(rows), row

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fit = np.ones(len(a), bool)
        for at in range(0, len(a), PAIRS):
            fit[at : at + PAIRS] = self._fit(a[at : at + PAIRS], b[at : at + PAIRS])
        return fit

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        na, nb, least = self.n[a], self.n[b], np.minimum(self.width[a], self.width[b])
        fit = np.minimum(na, nb) >= self.similarity * np.maximum(na, nb) - 1e-6
        met = fit & (np.maximum(self.width[a], self.width[b]) <= 2 * least)
        for w in np.unique(least[met]).tolist():
            some = np.flatnonzero(met & (least == w))
            rows, row = self.held[w]
            apart = np.bitwise_count(rows[row[a[some]]] ^ rows[row[b[some]]]).sum(1, dtype=np.int64)
            both = na[some] + nb[some]
            fit[some] = (both - apart) * (1 + self.similarity) >= 2 * self.similarity * both - 1e-6
        return fit


def _few_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of batches (doc_id, text), so many at a time that what is made of them stays small, however many rows a batch has."""
    for batch in batches:
        for a, b in slices(batch.column(1), HELD_BYTES):
            yield batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)


def _text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def linked_rows(docs: DataFrame, width: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, h (the text's hash), component (a number), for rows that are linked to another whose shingle sets are that similar.

    Nodes are distinct shingle sets, by numbers, so ids may be null or repeated. The first round tries one
    near fingerprint of each set and bucket; the further ones try all others that aren't in
    the set's component by then, MORE times as many in each round, until none is left. Of all
    these only pairs that sizes and bitmaps leave are written and verified.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in _few_texts(batches):
            rows, fps, keys, sets, sizes, bits = [], [], [], [], [], []
            for i, x in enumerate(texts.to_pylist()):
                h = np.unique(shingle_hashes(words_of(x), width))
                if len(h):
                    rows.append(i)
                    fps.append(fingerprint_of(h))
                    keys.append(_minima(h).view(np.int64))
                    sets.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    sizes.append(len(h))
                    bits.append(bitmap_of(h))
            own = held.take(pa.array(rows, pa.int64()))
            columns = [own.field(0), own.field(1), pa.array(_signed(fps)), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "fp", "keys", "same", "n", "bits"])

    spark = docs.sparkSession
    source = docs.select(F.struct(F.col(doc_id).cast("long").alias("doc_id"), _text_hash(text).alias("h")).alias("own"), F.col(text).alias("text"))
    with small_batches(spark):
        sketches = save(source.mapInArrow(sketch, "doc_id long, h long, fp long, keys array<long>, same binary, n long, bits binary"), "sketches")
    alone = sketches.groupBy("same").agg(F.min(F.struct("doc_id", "h")).alias("own"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("times"))
    alone = save(alone.withColumn("node", F.monotonically_increasing_id()), "distinct-sets")

    keyed = alone.select("node", "fp", F.posexplode("keys").alias("t", "k"))
    crowded = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1").select("t", "k")
    members = save(keyed.join(crowded, ["t", "k"]).withColumn("done", F.lit(0).cast("long")), "buckets")

    def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _few_texts(batches):
            sets = [np.unique(shingle_hashes(words_of(x), width)).tobytes() for x in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.binary())], names=["node", "s"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                near.append(common >= similarity * (len(p) + len(q) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def compare(most: int):
        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in _streamed_groups(batches, ["t", "k"]):
                ids, fps, group = frame["node"].to_numpy(), frame["fp"].to_numpy().view(np.uint64), _group_numbers(frame, ["t", "k"])
                done, fits = frame["done"].to_numpy(), Fits(frame["n"].to_numpy(), frame["bits"].tolist(), similarity)
                if most:
                    member, other, done = bitslice.earlier_hits(fps, group, VERIFY_RADIUS, frame["root"].to_numpy(), done, most, fits)
                else:
                    hit = bitslice.nearest_earlier(fps, group, VERIFY_RADIUS)
                    member = np.flatnonzero(hit >= 0)
                    member = member[fits(member, hit[member])]
                    other = hit[member]
                first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                at = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)]))
                pair = pd.DataFrame({"a": np.maximum(ids[member], ids[other]), "b": np.minimum(ids[member], ids[other])})
                state = frame[["t", "k", "node", "fp"]].assign(done=done, open=done < at)
                yield pd.concat([pair, state]).astype({c: "Int64" for c in ("a", "b", "t", "k", "node", "fp", "done")} | {"open": "boolean"})

        return near

    found, tried, most = spark.createDataFrame([], "node long, root long"), None, 0
    while not members.isEmpty():
        rooted = members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = rooted.groupBy("t", "k").agg(F.min("root").alias("l"), F.max("root").alias("m")).where("l < m").select("t", "k")
        held = rooted.join(mixed, ["t", "k"]).withColumn("o", F.xxhash64("node", "t")).join(alone.select("node", "n", "bits"), "node")
        dealt = held.repartition(partitions(spark), "t", "k").sortWithinPartitions("t", "k", "o", "node")
        out = save(dealt.mapInPandas(compare(most), "a long, b long, t long, k long, node long, fp long, done long, open boolean"), "near-round")
        pairs = out.where("a <> b").select("a", "b").distinct()
        pairs = save(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        tried = pairs if tried is None else tried.union(pairs)

        ids = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = alone.join(ids, "node").select("node", F.col("own.doc_id").alias("d"), F.col("own.h").alias("g"))
        same_row = F.col("own.doc_id").eqNullSafe(F.col("d")) & (F.col("own.h") == F.col("g"))
        texts = source.join(wanted, same_row).select("node", "text").dropDuplicates(["node"])
        with small_batches(spark):
            sets = save(texts.mapInArrow(shingle_sets, "node long, s binary"), "shingle-sets")
            left = sets.select(F.col("node").alias("a"), F.col("s").alias("s_a"))
            right = sets.select(F.col("node").alias("b"), F.col("s").alias("s_b"))
            verified = save(pairs.join(right, "b").join(left, "a").select("a", "b", "s_a", "s_b").mapInArrow(similar, "a long, b long"), "verified")
        found = save(graph.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified)), "components")
        state = out.where("t is not null").select("t", "k", "node", "fp", "done", "open")
        still = state.groupBy("t", "k").agg(F.max("open").alias("some")).where("some").select("t", "k")
        members = save(state.join(still, ["t", "k"]).select("node", "fp", "t", "k", "done"), "buckets")
        most = most * MORE or FIRST

    of = found.union(found.select("root", "root").distinct())
    several = alone.select("node", "same", "times").join(of, "node", "left").where("times > 1 or root is not null")
    several = save(several.select("same", F.coalesce("root", "node").alias("component"), "times"), "linked-sets")
    return save(join_counted(sketches.select("doc_id", "h", "same"), several, ["same"], "times").select("doc_id", "h", "component"), "linked-rows")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, component_id (the least doc_id that links reach), for documents that are linked to another one of lesser id."""
    rows = linked_rows(docs, width, similarity, text, doc_id)
    named = save(rows.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")), "named-components")
    return join_counted(rows, named, ["component"], "rows").where("doc_id <> component_id").select("doc_id", "component_id").distinct()


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs without those that have a near duplicate of lesser doc_id in their component; null is the largest, and of one id the text of least hash comes first."""
    rows = linked_rows(docs, width, similarity, text, doc_id)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "h")
    first = save(rows.groupBy("component").agg(F.min(row).alias("first"), F.count("*").alias("rows")), "kept-rows")
    gone = join_counted(rows, first, ["component"], "rows").where(row != F.col("first")).select(F.col("doc_id").alias("gone"), F.col("h").alias("gone_h")).distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["gone"]) & (_text_hash(text) == gone["gone_h"]), "left_anti")
