"""Similarity join of texts by the Jaccard similarity of their word n-grams, by vertical partitioning.

All n-grams have one global order: n-grams that few texts hold come first. A text is the sorted
row of its n-grams' places in that order. The order is cut into fragments of about equal
weight; for a pair of texts each fragment's overlap is counted on its own, as a row of its own,
and the sum per pair decides. So a long text, or one that meets very many others, is spread over fragments.

Which pairs are counted:

1. Equal sets are one. Two sets at the similarity share some n-grams (SHARED, if their overlap has so many)
   among the first of each in the global order, so sets meet by these, unless length, place or a bitmap of
   either set rule the pair out (all three are bounds that no pair at the similarity exceeds).
2. Pairs that meet often enough where at most SMALL sets meet are compared at once. In larger groups every set is compared with
   the group's leaders only, in STARS rounds. What is linked by then is one component.
3. In groups that still have several components a few pairs of each set with another one are
   tried, and then all pairs of different components are compared, in cells of bounded size. So the components are those of all links, while a group of near
   copies costs about as many pairs as it has members.

The global order comes from counts over all texts in CELLS cells; any order is right, and
a rough count only makes groups larger. N-grams are 64-bit keys: 8 bits of count class and 56 of hash.

Defined cases: a null text counts as empty. A text without words has no n-gram, links with nothing and is
its own component. A text of fewer words than an n-gram is one n-gram. Equal texts, and texts of equal sets,
link. Rows that repeat a doc_id count as rows of their own; a null doc_id links by its
text and names a component only if all its ids are null. An empty table gives no rows. Other columns
are ignored. Long texts are taken whole; a batch is cut into slices of about 2 MB of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, words
from .common import HOT_KEYS, join_counted, partitions, save

WIDTH, PERCENT = 4, 85
#: Cells in which n-grams are counted, and classes of counts for each doubling.
CELLS, CLASSES = 1 << 20, 8
FRAGMENTS = 4
#: N-grams that two sets at the similarity share among their first ones, if their overlap has so many.
SHARED = 3
#: Sets of a group up to which all its pairs are compared at once, and rounds in which larger groups meet their leaders.
SMALL, STARS = 8, 2
#: Partners of a set in another component that are tried before all are.
FEW = 2
#: Sets of a block, in groups whose pairs are compared in cells.
BLOCK = 1024
#: Bits of a set's bitmap.
BITS = 1024
#: Texts whose sets are asked for are found by a broadcast of so many ids at most, and else by shuffle.
MOST_BROADCAST = 500_000
#: Bytes of text whose words are hashed at once.
SLICE_BYTES = 1 << 21
_BLOCK_CELLS = 4096
_U = np.uint64


def lowered(column: pa.Array) -> pa.Array:
    """A-Z in lower case; null is empty. Works on bytes, as those of other letters are all above 0x7F."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    filled = pa.concat_arrays([filled])  # so that it starts at the buffers' start
    _, offsets, data = filled.buffers()
    if data is None:
        return filled
    raw = np.frombuffer(data, np.uint8)
    return pa.LargeStringArray.from_buffers(len(filled), offsets, pa.py_buffer(raw + np.uint8(32) * ((raw >= 65) & (raw <= 90))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text its distinct n-grams as sorted 64-bit hashes."""
    multiply = np.random.default_rng(12).integers(1, 1 << 63, width + 1, dtype=np.uint64) * _U(2) + _U(1)
    for start, stop in words.slices(column, SLICE_BYTES):
        flat, counts = words.split_at_white_space(lowered(column.slice(start, stop - start)))
        number, found = words.distinct(flat)
        hashed = np.array([xxhash.xxh64_intdigest(w.as_buffer()) for w in found], np.uint64)[number] if len(found) else np.zeros(0, np.uint64)
        ends = np.cumsum(counts)
        runs = np.zeros(max(0, len(hashed) - width + 1), np.uint64)
        for i in range(width):
            runs += hashed[i : i + len(runs)] * multiply[i]
        runs = _mixed(runs)
        for a, b in zip((ends - counts).tolist(), ends.tolist()):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                yield _mixed((hashed[a:b] * multiply[: b - a]).sum(keepdims=True, dtype=np.uint64) + multiply[width:] * _U(b - a))
            else:
                yield np.zeros(0, np.uint64)
        del flat, counts, number, found, hashed, runs
        pa.default_memory_pool().release_unused()


@dataclass
class Order:
    """The global order: the count class of each cell, and the keys at which fragments begin."""

    classes: np.ndarray
    pivots: np.ndarray

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """The places of the hashes in the order, sorted."""
        of = self.classes[(hashes & _U(len(self.classes) - 1)).astype(np.int64)].astype(np.uint64)
        return np.sort(of << _U(56) | hashes >> _U(8))

    def class_above(self, count: float) -> int:
        """The least class whose n-grams may be in more texts than that."""
        return min(256, int(np.floor(CLASSES * np.log2(max(count, 1)))) + 1)

    def fragments(self, keys: np.ndarray) -> list[np.ndarray]:
        return np.split(keys, np.searchsorted(keys, self.pivots[1:]))


def order_of(docs: DataFrame, width: int = WIDTH, cells: int = CELLS, fragments: int = FRAGMENTS, text: str = "text") -> Order:
    """The order by how many texts hold the n-grams of a cell, over all texts. cells: a power of two; a table of that size goes to all tasks."""
    size = min(_BLOCK_CELLS, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for h in shingle_sets(batch.column(0), width):
                np.add.at(total, (h & _U(cells - 1)).astype(np.int64), 1)
        some = np.flatnonzero(total.reshape(-1, size).any(1))
        if len(some):
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array([total[i * size : (i + 1) * size].tobytes() for i in some], pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_py(), np.int64)
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    total = np.zeros(cells, np.int64)
    for r in counted.collect():  # the cells, whose number is a parameter
        total[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["counts"], np.int64)
    classes = np.minimum(255, np.floor(CLASSES * np.log2(np.maximum(total, 1)))).astype(np.uint8)
    weight = np.bincount(classes, weights=total, minlength=256)
    ends = np.cumsum(weight)
    pivots = [0]
    for part in range(1, fragments):
        aim = ends[-1] * part / fragments
        c = min(int(np.searchsorted(ends, aim)), 255)
        share = (aim - (ends[c] - weight[c])) / weight[c] if weight[c] else 0.0
        pivots.append((c << 56) + int(share * ((1 << 56) - 1)))
    return Order(classes, np.array(pivots, np.uint64))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many of its first n-grams a set needs to share SHARED, or all of the overlap if that is less, with any set at the similarity."""
    return min(n, n - (percent * n + 99) // 100 + SHARED)


def set_rows(docs: DataFrame, order: Order, width: int = WIDTH, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n, same (a digest of the set; null for none), bitmap, prefix (the first places in the order): a saved row for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            n, same, bits, prefix = [], [], [], []
            for h in shingle_sets(batch.column(1), width):
                keys = order.keys(h)
                n.append(len(keys))
                same.append(hashlib.blake2b(keys.tobytes(), digest_size=16).digest() if len(keys) else None)
                bits.append(np.packbits(np.bincount((keys & _U(BITS - 1)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes() if len(keys) else None)
                prefix.append(keys[: prefix_length(len(keys), percent)].view(np.int64) if len(keys) else None)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(bits, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], ["doc_id", "n", "same", "bitmap", "prefix"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return save(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, f"doc_id {kind}, n long, same binary, bitmap binary, prefix array<long>"), "sets")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """node, same, least (the least doc_id), times, n, bitmap, prefix: each set that is not empty once, saved."""
    of = rows.where("n > 0").groupBy("same").agg(F.min("doc_id").alias("least"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.first("prefix").alias("prefix"))
    return save(of.withColumn("node", F.monotonically_increasing_id()), "distinct-sets")


def meetings(sets: DataFrame, order: Order) -> DataFrame:
    """key, node, n, at, size: where a set has an n-gram of another one's first ones among its own; size is how many do. Saved.

    N-grams that so many sets may have that one task shouldn't get them all, by the counts of the order, are counted first
    and joined to their counts; all others, whose groups are bounded by that, are dealt once and counted as they stand in order.
    """
    spark = sets.sparkSession
    first = sets.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "key"))
    hot = F.shiftrightunsigned("key", 56) >= order.class_above(sets.count() / HOT_KEYS)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key = rows.column("key").to_numpy()
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            size = np.repeat(sizes, sizes)
            some = size > 1
            if some.any():
                yield from rows.append_column("size", pa.array(size)).filter(pa.array(some)).combine_chunks().to_batches()

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            key = rows.column("key").to_numpy()
            if len(key):
                cut = len(key) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
                kept = rows.slice(cut)
                if cut:
                    yield from counted(rows.slice(0, cut))
        if kept is not None and len(kept):
            yield from counted(kept)

    dealt = first.where(~hot).select("key", "node", "n", "at").repartition(partitions(spark), "key").sortWithinPartitions("key")
    cold = dealt.mapInArrow(shared, "key long, node long, n int, at int, size long")
    many = first.where(hot)
    sizes = many.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = cold.unionByName(many.join(sizes, "key").select("key", "node", "n", "at", "size"))
    return save(met.withColumn("n", F.col("n").cast("long")), "meetings")


def _within(n, m, percent: int):
    return F.least(n, m) * 100 >= percent * F.greatest(n, m)


def _reachable(n, i, m, j, percent: int):
    """Whether sets that first meet at these places can still have the overlap."""
    return F.least(n - i, m - j) * (100 + percent) >= percent * (n + m)


def small_pairs(met: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a < b, na, nb: pairs that meet in SHARED small groups, or in as many as their overlap needs, and that length and place leave.

    Pairs that meet in fewer can only be similar if they meet in a large group too, where they are compared.
    """
    group = met.where(F.col("size") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "n", "at"))).alias("g"))  # of SMALL entries at most
    each = group.select("g", F.posexplode("g").alias("i", "x")).select("x", F.explode(F.slice("g", F.col("i") + 2, SMALL)).alias("y"))
    na, nb = F.col("x.n"), F.col("y.n")
    fit = each.where(_within(na, nb, percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), na.alias("na"), nb.alias("nb"), _reachable(na, F.col("x.at"), nb, F.col("y.at"), percent).alias("fit"))
    need = F.least(F.lit(SHARED), F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent)))
    return fit.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("times"), F.bool_or("fit").alias("fit")).where(F.col("fit") & (F.col("times") >= need)).select("a", "b", "na", "nb")


def star_pairs(open_: DataFrame, seed: int, percent: int = PERCENT) -> DataFrame:
    """a < b, na, nb: members (key, node, n, root) of groups with the leader of those of about their length, if not in one component."""
    step = -np.log(percent / 100) or 1.0
    banded = open_.withColumn("band", F.floor(F.log("n") / F.lit(float(step)) + F.lit(0.5 * (seed % 2))))
    leaders = banded.groupBy("key", "band").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "node").alias("h"), F.col("node").alias("leader"), F.col("n").alias("m"), F.col("root").alias("of"))).alias("l"))
    met = banded.join(leaders.select("key", "band", "l.leader", "l.m", "l.of"), ["key", "band"]).where((F.col("root") != F.col("of")) & _within(F.col("n"), F.col("m"), percent))
    first = F.col("node") < F.col("leader")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), pick("n", "m").alias("na"), pick("m", "n").alias("nb")).distinct()


def cell_pairs(open_: DataFrame, sets: DataFrame, percent: int = PERCENT, most: int = 0) -> DataFrame:
    """a < b, na, nb: pairs of groups' members (key, node, n, root) of different components that length and bitmap leave.

    A group is cut into blocks of about BLOCK sets, and two blocks meet in one cell. A pair that meets in several of these
    groups is compared in that of the least key. With most, each set gets that many partners of another component in a cell
    at most, which is for rounds before the one that compares all.
    """
    sizes = open_.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    keys = open_.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # no more than a set's first n-grams
    own = open_.join(sizes, "key").join(sets.select("node", "bitmap"), "node").join(keys, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "node", "n", "root", "bitmap", "keys")
    spark = open_.sparkSession
    dealt = cells.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "node")

    def pairs_of(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        i, block, node, n, root = (cell.column(c).to_numpy().astype(np.int64) for c in ("i", "block", "node", "n", "root"))
        bits = np.frombuffer(b"".join(cell.column("bitmap").to_pylist()), np.uint64).reshape(len(node), -1)
        listed, key = cell.column("keys").combine_chunks(), cell.column("key")[0].as_py()
        flat = listed.flatten().to_numpy()
        ends = np.r_[0, np.cumsum(pc.list_value_length(listed).to_numpy())]
        # of each member the keys before this one, at which it has met others already
        before = [flat[a : a + int(np.searchsorted(flat[a:b], key))] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        half = int((block == i).sum())
        alone = bool((cell.column("j").to_numpy() == i).all())
        for x in range(half):
            y = np.arange(x + 1 if alone else half, len(node))
            y = y[(root[y] != root[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
            if len(y):  # sets differ in as many n-grams as their bitmaps in bits, at least
                apart = np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype=np.int64)
                y = y[(n[y] + n[x] - apart) * (100 + percent) >= 2 * percent * (n[y] + n[x])]
            if len(y) and len(before[x]):
                met = set(before[x].tolist())
                y = y[[met.isdisjoint(before[v].tolist()) for v in y]]
            if most and len(y):
                order = np.argsort(root[y], kind="stable")
                of = root[y][order]
                y = y[order[np.arange(len(y)) - np.searchsorted(of, of) < most]]
            if len(y):
                low = node[y] < node[x]
                yield pa.record_batch([pa.array(np.minimum(node[y], node[x])), pa.array(np.maximum(node[y], node[x])), pa.array(np.where(low, n[y], n[x])), pa.array(np.where(low, n[x], n[y]))], ["a", "b", "na", "nb"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            of = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(0)) + 1).tolist(), len(batch)]
            for start, stop in zip(cuts, cuts[1:]):
                piece = batch.slice(start, stop - start)
                if kept and any(kept[0].column(c)[0] != piece.column(c)[0] for c in ("key", "i", "j")):
                    yield from pairs_of(pa.Table.from_batches(kept).combine_chunks())
                    kept = []
                kept.append(piece)
        if kept:
            yield from pairs_of(pa.Table.from_batches(kept).combine_chunks())

    return dealt.mapInArrow(compare, "a long, b long, na long, nb long").distinct()


def bounded(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that bitmaps leave: sets differ in as many n-grams as their bitmaps in bits, at least. Saved."""
    left, right = (sets.select(F.col("node").alias(c), F.col("bitmap").alias(f"bits_{c}")) for c in ("a", "b"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(batch), -1) for c in ("bits_a", "bits_b"))
                apart = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
                fit = (na + nb - apart) * (100 + percent) >= 2 * percent * (na + nb)
                yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(fit))

    return save(pairs.join(left, "a").join(right, "b").mapInArrow(keep, "a long, b long, na long, nb long"), "candidates")


class Segments:
    """The segments (node, fragment, keys) of the sets that were asked for so far, made from the texts when a set is first asked for."""

    def __init__(self, docs: DataFrame, sets: DataFrame, order: Order, width: int, text: str, doc_id: str):
        self.docs, self.sets, self.order, self.width = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), sets, order, width
        self.nodes: DataFrame | None = None
        self.saved: DataFrame | None = None

    def of(self, pairs: DataFrame) -> DataFrame | None:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if self.nodes is not None:
            asked = asked.join(self.nodes, "node", "left_anti")
        wanted = save(self.sets.join(asked, "node", "left_semi").select("node", "same", F.col("least").alias("doc_id")), "wanted-sets")
        many = wanted.count()
        if many:
            new = self._made(F.broadcast(wanted) if many <= MOST_BROADCAST else wanted)
            self.saved = new if self.saved is None else self.saved.union(new)
            self.nodes = wanted.select("node") if self.nodes is None else self.nodes.union(wanted.select("node"))
        return self.saved

    def _made(self, wanted: DataFrame) -> DataFrame:
        shared, width = self.docs.sparkSession.sparkContext.broadcast(self.order), self.width
        held = self.docs.join(wanted.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of"))).select("node", "same", "text")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order = shared.value
            for batch in batches:
                out: tuple[list, list, list] = ([], [], [])
                for node, same, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), width)):
                    keys = order.keys(h)
                    if hashlib.blake2b(keys.tobytes(), digest_size=16).digest() == same:  # ids may be shared by texts
                        for f, part in enumerate(order.fragments(keys)):
                            if len(part):
                                for column, value in zip(out, (node, f, part.tobytes())):
                                    column.append(value)
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["node", "fragment", "keys"])

        made = save(held.mapInArrow(cut, "node long, fragment int, keys binary"), "segments")
        repeated = made.groupBy("node", "fragment").agg(F.count("*").alias("c")).where("c > 1")
        return made if repeated.isEmpty() else save(made.dropDuplicates(["node", "fragment"]), "segments")  # rows that repeat id and text


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """a, b, na, nb, overlap: the fragments' overlaps, each counted by itself, summed per pair."""
    right = segments.select(F.col("node").alias("b"), "fragment", F.col("keys").alias("keys_b"))
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("keys").alias("keys_a"))
    met = pairs.join(right, "b").join(left, ["a", "fragment"]).select("a", "b", "na", "nb", "keys_a", "keys_b")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)) for x, y in zip(batch.column(4), batch.column(5))]
            yield pa.record_batch([*batch.columns[:4], pa.array(common, pa.int64())], ["a", "b", "na", "nb", "common"])

    counted = met.mapInArrow(partial, "a long, b long, na long, nb long, common long")
    return counted.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("overlap"))


def linked(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, cells: int = CELLS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) of each row: texts whose n-gram sets have that Jaccard similarity, in percent, are linked."""
    order = order_of(docs, width, cells, text=text)
    rows = set_rows(docs, order, width, percent, text, doc_id)
    sets = distinct_sets(rows)
    met = meetings(sets, order)
    segments = Segments(docs, sets, order, width, text, doc_id)
    found: DataFrame | None = None

    def verify(pairs: DataFrame) -> None:
        nonlocal found
        left = bounded(pairs, sets, percent)
        held = segments.of(left)
        if held is None or left.isEmpty():
            return
        new = overlaps(left, held).where(F.col("overlap") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")
        found = save(graph.components(new if found is None else found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new)), "components")

    def still_open() -> DataFrame:
        large = met.where(F.col("size") > SMALL)
        rooted = large.withColumn("root", F.col("node")) if found is None else large.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("l"), F.max("root").alias("m")).where("l < m").select("key")
        return save(rooted.join(mixed, "key").select("key", "node", "n", "root"), "open-groups")

    verify(small_pairs(met, percent))
    for seed in range(STARS):
        open_ = still_open()
        if open_.isEmpty():
            break
        verify(star_pairs(open_, seed, percent))
    for most in (FEW, 0):
        open_ = still_open()
        if open_.isEmpty():
            break
        verify(cell_pairs(open_, sets, percent, most))

    named = sets.select("same", "node", "least", "times")
    named = named.withColumn("root", F.col("node")) if found is None else named.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = save(named, "roots")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    keyed = save(named.join(names, "root").select("same", "times", "component_id"), "names")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return join_counted(rows.where("n > 0").select("doc_id", "n", "same"), keyed, ["same"], "times").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
