"""Finds passages of benchmark items in documents.

A window of a document is as long as an item. It matches where the weighted Jaccard
similarity of the five-word shingles of both, with their counts as weights, is at
least 0.8. Such a window holds all but a fifth of the item's shingles by weight, so it holds
at least one of a few anchor shingles of the item, those that fewest items have, whose weight
exceeds that. Where a document has an anchor of an item, all places of the item's shingles in
it are found, and windows are laid at every place where enough of them stand, in whatever
order they do. Each window gets a SimHash of its shingles. Windows meet an item in a
multi-index of fingerprint blocks: with one more block than the radius, fingerprints within
the radius agree in one block. What is within the radius is verified by the weights of the
shingles that both have, which are held as 64-bit hashes.

All work is DataFrame operations. Anchors, the shingles of items and the keys of documents
with anchors are broadcast only where their number is checked to be small; else they are
joined by hash. The words of a text are held once for each item that it may match.

Defined cases: null texts count as empty; empty texts and items match nothing. An item
of fewer than five words is one shingle. A text shorter than an item is one window.
Repeated rows give equal results once for each doc_id; rows of null doc_id are searched
under that id. Repeated items count as one by their item_id and words. Empty tables
give empty results. Other columns are ignored, or returned unchanged by
``drop_contaminated``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, ascii_lower, save

WIDTH = 5
SIMILARITY = 0.8
#: Differing bits up to which a window is verified. Bits differ one as another, with a chance that is largest
#: where a text lacks one of an item's five shingles: 0.1875. Then over 40 of 64 differ with a chance of 2e-15.
RADIUS = 40
#: Anchors, shingles of items, and keys of documents up to which each of these is broadcast: some 50 bytes each.
BROADCAST_ROWS = 200_000
KEY = ["doc_id", "row_hash", "item_id", "start"]


def words(text: Column) -> Column:
    """The words of the text, A-Z in lower case."""
    plain = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, f"{SPACE_CLASS}+"))


def _shingles(array: Column, width: Column) -> Column:
    """All runs of width words, joined by spaces."""
    count = F.size(array) - width + 1
    return F.when(count >= 1, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(array, i, width), " "))).otherwise(
        F.array(F.array_join(array, " "))
    )


def _items(benchmark: DataFrame, width: int, similarity: float) -> DataFrame:
    """item_id, words, n, k (shingle width), shingles, total (their number), slack (the weight that may miss)."""
    tidy = benchmark.select(F.col("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    sized = tidy.withColumn("n", F.size("words")).withColumn("k", F.least(F.lit(width), F.col("n")))
    full = sized.withColumn("shingles", _shingles(F.col("words"), F.col("k"))).withColumn("total", F.size("shingles"))
    return full.withColumn("slack", F.floor(F.col("total") * (1 - similarity) + 1e-9).cast("int"))


def _fingerprints(rows: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """keys, fp: the SimHash over an array of hashes. Two bits are counted in each sum, 32 bits apart."""
    lanes = [F.sum(F.shiftrightunsigned("h", r).bitwiseAND(F.lit(0x100000001))).alias(f"s{r}") for r in range(32)]
    sums = rows.select(*keys, F.explode(hashes).alias("h")).groupBy(*keys).agg(F.count("*").alias("c"), *lanes)
    bits = []
    for b in range(64):
        ones = F.col(f"s{b}").bitwiseAND(F.lit(0xFFFFFFFF)) if b < 32 else F.shiftrightunsigned(f"s{b - 32}", 32)
        bits.append(F.shiftleft((2 * ones > F.col("c")).cast("long"), b))
    return sums.select(*keys, reduce(Column.bitwiseOR, bits).alias("fp"))


def _blocks(fp: str, radius: int) -> Column:
    """The block index entries of a fingerprint: radius + 1 blocks of its bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    parts = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:])]
    return F.array(*(F.struct(F.lit(i).alias("i"), p.alias("v")) for i, p in enumerate(parts)))


def _small(rows: DataFrame) -> DataFrame:
    """The rows, to be broadcast where they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _probes(texts: DataFrame, wanted: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, row_hash, size, pos and the columns of wanted (h, k, ...): where runs of k words of texts (doc_id, row_hash, w) hash to h."""
    placed = texts.select("doc_id", "row_hash", "w", F.posexplode("w").alias("pos", "first"))
    found = []
    for k in widths:
        run = F.concat_ws(" ", "first", *(F.get("w", F.col("pos") + j) for j in range(1, k)))
        probes = placed.where(F.col("pos") + k <= F.size("w")).select("doc_id", "row_hash", F.size("w").alias("size"), "pos", F.xxhash64(run).alias("h"))
        found.append(probes.join(_small(wanted.where(F.col("k") == k)), "h"))
    return reduce(DataFrame.unionByName, found)


def matches(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, row_hash (of the text), item_id, start, n, similarity: the windows that match."""
    items = save(_items(benchmark, width, similarity), "items")
    listed = items.select("item_id", "n", "k", "total", F.explode("shingles").alias("shingle"))
    weights = save(listed.groupBy("item_id", "n", "k", "total", "shingle").agg(F.count("*").alias("weight")), "item-shingles")
    shingles = weights.select(F.xxhash64("shingle").alias("h"), "item_id", "n", "k", "total")
    rarity = weights.groupBy("shingle").agg(F.count("*").alias("items"))
    rarest = Window.partitionBy("item_id", "n", "total").orderBy("items", F.xxhash64("shingle"), "shingle").rowsBetween(Window.unboundedPreceding, -1)
    chosen = weights.join(rarity, "shingle").withColumn("before", F.coalesce(F.sum("weight").over(rarest), F.lit(0)))
    chosen = chosen.where(F.col("before") <= F.floor(F.col("total") * (1 - similarity) + 1e-9))
    anchors = save(chosen.select(F.xxhash64("shingle").alias("h"), "item_id", "n", "k"), "anchors")
    widths = sorted(r[0] for r in anchors.select("k").distinct().collect())
    if not widths:
        return docs.sparkSession.createDataFrame([], "doc_id long, row_hash long, item_id long, start int, n int, similarity double")

    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row_hash"), F.col(text).alias("text"))
    found = _probes(source.select("doc_id", "row_hash", words(F.col("text")).alias("w")), anchors, widths)
    pairs = save(found.select("doc_id", "row_hash", "item_id", "n").distinct(), "pairs")
    suspects = pairs.select(F.col("doc_id").alias("d"), F.col("row_hash").alias("r")).distinct()
    own = source["doc_id"].eqNullSafe(F.col("d")) & (source["row_hash"] == F.col("r"))
    texts = source.join(_small(suspects), own, "left_semi").dropDuplicates(["doc_id", "row_hash"])
    texts = save(texts.select("doc_id", "row_hash", words(F.col("text")).alias("w")), "suspects")

    hits = _probes(texts, shingles, widths)
    pair = [hits[c].eqNullSafe(pairs[c]) for c in ("doc_id", "row_hash", "item_id", "n")]
    hits = hits.join(pairs, pair, "left_semi").groupBy("doc_id", "row_hash", "item_id", "n", "k", "total", "size").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    whole = F.col("size") >= F.col("n")
    held = F.when(whole, F.col("total")).otherwise(F.col("size") - F.col("k") + 1)
    least = F.ceil(similarity * (held + F.col("total")) / (1 + similarity) - 1e-9).cast("int")
    hits = hits.withColumn("least", least).where(F.size("p") >= F.col("least"))

    def begins(i: Column) -> Column:
        """The windows whose first place of a shingle is number i, and which hold enough of them."""
        place = lambda j: F.get("p", j)
        low = F.greatest(F.coalesce(place(i - 1), F.lit(-1)) + 1, place(i + F.col("least") - 1) - F.col("total").cast("int") + 1)
        high = F.least(place(i), F.col("size") - F.col("n"))
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    starts = F.when(whole, F.flatten(F.transform(F.sequence(F.lit(0), F.size("p") - F.col("least")), begins))).otherwise(F.array(F.lit(0)))
    laid = hits.select("doc_id", "row_hash", "item_id", "n", "k", starts.alias("starts")).where(F.size("starts") > 0)
    where = texts.select(F.col("doc_id").alias("d"), F.col("row_hash").alias("r"), "w")
    placed = laid.join(where, laid["doc_id"].eqNullSafe(where["d"]) & (laid["row_hash"] == where["r"]))
    windows = placed.withColumn("start", F.explode("starts")).select(*KEY, "n", "k", F.slice("w", F.col("start") + 1, F.col("n")).alias("window"))
    hashed = F.transform(_shingles(F.col("window"), F.col("k")), lambda s: F.xxhash64(s))
    windows = save(windows.select(*KEY, "n", hashed.alias("hs")), "windows")
    own = _fingerprints(windows, [*KEY, "n"], "hs")
    of_items = _fingerprints(items.withColumn("hs", F.transform("shingles", lambda s: F.xxhash64(s))), ["item_id", "n"], "hs").withColumnRenamed("fp", "item_fp")
    left = own.select(*KEY, "n", "fp", F.explode(_blocks("fp", radius)).alias("e")).select(*KEY, "n", "fp", "e.i", "e.v")
    right = of_items.select("item_id", "n", "item_fp", F.explode(_blocks("item_fp", radius)).alias("e")).select("item_id", "n", "item_fp", "e.i", "e.v")
    met = left.join(right, ["item_id", "n", "i", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    candidates = met.select(*KEY, "n").distinct()

    same = [windows[c].eqNullSafe(candidates[c]) for c in (*KEY, "n")]
    counted = windows.join(candidates, same, "left_semi").select(*KEY, "n", F.size("hs").alias("size"), F.explode("hs").alias("h"))
    counted = counted.groupBy(*KEY, "n", "size", "h").agg(F.count("*").alias("c"))
    of_item = weights.select("item_id", "n", "total", F.xxhash64("shingle").alias("h"), "weight")
    shared = counted.join(of_item, ["item_id", "n", "h"]).groupBy(*KEY, "n", "size", "total").agg(F.sum(F.least("c", "weight")).alias("common"))
    scored = shared.withColumn("similarity", F.col("common") / (F.col("size") + F.col("total") - F.col("common")))
    return scored.where(F.col("similarity") >= similarity - 1e-9).select(*KEY, "n", "similarity")


def contaminations(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: the best window of each document and item that match."""
    found = matches(docs, benchmark, width, similarity, radius, text, doc_id)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), F.col("n").alias("n_words"))).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.back")).alias("start"), "m.n_words", F.round("m.similarity", 6).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs in which no item was found; rows of one doc_id, or of none, go by their own texts."""
    gone = matches(docs, benchmark, text=text, doc_id=doc_id, **options).select(F.col("doc_id").alias("gone"), "row_hash").distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["gone"]) & (F.xxhash64(docs[text]) == gone["row_hash"]), "left_anti")
