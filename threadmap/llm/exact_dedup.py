"""Exact deduplication over an extendible-hash index in the shared folder.

The leading bits of a text's 64-bit hash lead through a directory to a bucket. The directory
doubles while a bucket holds more keys than its capacity: the bucket is split by one more bit
until it fits or the depth limit is reached. Every row is sent through the directory to its
bucket; within a bucket, texts that meet under one key are chained, byte-equal ones as one
entry. Entries are saved as Parquet in order of bucket and key, so that the tasks that own
them hold ranges of keys. Rows then look up their entry by bucket and key, and walk the chain
to the entry with their own bytes' digest.

All work is DataFrame operations. Copies of a text are combined on the map side before the
shuffle, so a group that holds a third of all rows costs its owner task one row for each map
task. Entries with many rows are looked up through a broadcast, as there are few of them.

Defined cases: a null text counts as empty, and all empty texts are equal. A null doc_id is
kept as a row and never wins against another id. Rows that repeat in all columns are one group
and each is returned; ``drop_duplicates`` keeps one of them. An empty table gives an empty
result. Further columns of the input are ignored, or returned unchanged by
``drop_duplicates``, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, save

#: Keys that a bucket of the directory may hold before it is split.
BUCKET_CAPACITY = 50_000
#: Bits of the key that the directory may use, so it has at most 2**MAX_DEPTH slots.
MAX_DEPTH = 16
#: Rows from which an entry is looked up by broadcast, and such entries up to which that is done (some 100 bytes each).
MANY_ROWS, MOST_BROADCAST = 10_000, 100_000


def normalised(text: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def slot(key: Column, depth: int = MAX_DEPTH) -> Column:
    """The leading bits of the key as a number from 0."""
    return F.shiftrightunsigned(key, 64 - depth).cast("int")


def directory(keys: DataFrame, capacity: int = BUCKET_CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The directory (slot, bucket, local_depth) after all splits; at most 2**max_depth rows.

    Distinct keys are counted by their max_depth leading bits once. Of these counts come those of
    the directory at each depth, which doubles from one to the next; a slot's bucket is the
    one at the first depth that isn't overfull, so only overfull buckets are split.
    """
    counts = keys.select("key").distinct().groupBy(slot(F.col("key"), max_depth).alias("slot")).count()
    spark = keys.sparkSession
    slots = spark.range(1 << max_depth).select(F.col("id").cast("int").alias("slot")).join(F.broadcast(counts), "slot", "left")
    slots = save(slots.select("slot", F.coalesce("count", F.lit(0)).alias("n")), "directory-counts")
    at = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth - 1))).alias("d")).withColumn("p", F.expr(f"shiftright(slot, {max_depth} - d)"))
    fitting = at.groupBy("d", "p").agg(F.sum("n").alias("n")).where(F.col("n") <= capacity).select("d", "p")
    least = at.join(fitting, ["d", "p"]).groupBy("slot").agg(F.min("d").alias("d"))
    table = slots.join(least, "slot", "left").select("slot", F.coalesce("d", F.lit(max_depth)).alias("local_depth"))
    first = F.expr(f"shiftleft(shiftright(slot, {max_depth} - local_depth), {max_depth} - local_depth)")
    return save(table.select("slot", first.cast("int").alias("bucket"), "local_depth"), "directory")


def routed(rows: DataFrame, slots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The rows with the bucket that the directory has for their key."""
    return rows.withColumn("slot", slot(F.col("key"), max_depth)).join(F.broadcast(slots.select("slot", "bucket")), "slot").drop("slot")


def build_index(docs: DataFrame, slots: DataFrame, max_depth: int = MAX_DEPTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The saved index: one entry (bucket, key, chain, sha256, keep_id, group_size) for each distinct text.

    Texts meet by bucket and key, and are one entry where their bytes are equal.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm")).withColumn("key", F.xxhash64("norm"))
    entries = (
        routed(rows, slots, max_depth)
        .groupBy("bucket", "key", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("bucket", "key", F.sha2(F.col("norm").cast("binary"), 256).alias("sha256"), "keep_id", "group_size")
    )
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha256")) - 1
    index = save(entries, "index-entries").withColumn("chain", chain)
    return save(index.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "chain"), "index")


def lookups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key, sha256 of each row, saved."""
    norm = normalised(text)
    return save(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(norm).alias("key"), F.sha2(norm.cast("binary"), 256).alias("sha256")), "lookups")


def found(rows: DataFrame, index: DataFrame, slots: DataFrame, max_depth: int = MAX_DEPTH, how: str = "inner") -> DataFrame:
    """Rows (key, sha256, ...) with the entry of their bucket, key and digest."""
    by = ["bucket", "key", "sha256"]
    index = index.select(*by, *[c for c in ("keep_id", "group_size", "wanted") if c in index.columns])
    many = index.where(F.col("group_size") >= MANY_ROWS)
    rows = routed(rows, slots, max_depth)
    if many.isEmpty() or many.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        return rows.join(index, by, how)
    few = index.where(F.col("group_size") < MANY_ROWS)
    apart = rows.join(F.broadcast(many.select(*by)), by, "left_anti").join(few, by, how)
    return rows.join(F.broadcast(many), by, how).unionByName(apart)


def duplicates(docs: DataFrame, capacity: int = BUCKET_CAPACITY, max_depth: int = MAX_DEPTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = lookups(docs, text, doc_id)
    slots = directory(rows, capacity, max_depth)
    index = build_index(docs, slots, max_depth, text, doc_id)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found(rows, index, slots, max_depth).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha256").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, capacity: int = BUCKET_CAPACITY, max_depth: int = MAX_DEPTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay: of each group of equal texts the one with the largest doc_id.

    Where several rows have that doc_id, or all of a group are without one, one of them stays.
    """
    rows = lookups(docs, text, doc_id)
    slots = directory(rows, capacity, max_depth)
    index = build_index(docs, slots, max_depth, text, doc_id)
    # groups in which more than one row could stay
    same = found(rows, index.where("group_size > 1"), slots, max_depth).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    repeated = save(same.groupBy("key", "sha256").agg(F.count("*").alias("n")).where("n > 1").select("key", "sha256"), "repeated")

    norm = normalised(text)
    own = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.xxhash64(norm).alias("key"), F.sha2(norm.cast("binary"), 256).alias("sha256"))
    wanted = index.select("bucket", "key", "sha256", "group_size", F.struct("keep_id").alias("wanted"))
    kept = found(own, wanted, slots, max_depth).where(F.col("doc_id").eqNullSafe(F.col("wanted.keep_id"))).select("key", "sha256", "row")
    if not repeated.isEmpty():
        alone = kept.join(repeated, ["key", "sha256"], "left_anti")
        first = kept.join(repeated, ["key", "sha256"]).groupBy("key", "sha256").agg(F.first("row").alias("row"))
        kept = alone.unionByName(first)
    return kept.select("row.*")
