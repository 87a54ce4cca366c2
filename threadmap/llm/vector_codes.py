"""Product codes of integer vectors, found by partial-distance search.

Vectors become integers and are cut into equal consecutive parts; each part position has
a codebook of a few entries, improved in rounds. A round is one pass over the saved integer
rows: every task assigns its parts and adds them up by entry, and only those sums, whose
number the codebooks bound, are shuffled and brought to the driver.

The nearest entry of a part is found dimension by dimension, in the order of falling
variance among the codebook's entries. For each entry a mask keeps the rows whose
accumulated distance doesn't exceed that of the best entry so far, so most entries
are given up after a few dimensions. All is integer arithmetic, so ties are exact and
go to the lower index.

Defined cases: rows whose vector is null or holds a null or a component that isn't finite are
dropped. Rows with a null id come last where the first entries are chosen, and rows that share
an id are ordered by their integers; repeated rows are coded each. Null labels are one
label. With fewer rows than entries the codebooks are that much smaller. An empty table gives
no rows. Vectors of different widths, or of one that the number of parts doesn't divide, and integers
of LARGEST or more raise ValueError. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite_vectors, join_counted, matrix, save

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers below this keep all sums of squares of up to 8,192 dimensions within 63 bits.
LARGEST = 1 << 24
#: Rows that are compared at once.
BLOCK_ROWS = 8192


def integers(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, x: the saved rows with floor(scale * component) for finite vectors."""
    kept = finite_vectors(rows, vector)
    x = F.transform(F.col(vector), lambda v: F.floor(scale * v.cast("double")).cast("long"))
    return save(kept.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), x.alias("x")), "integers")


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows x of one part the index of the nearest entry of book, ties to the lower one, and its squared distance."""
    order = np.argsort(-book.astype(float).var(0), kind="stable")
    columns = np.ascontiguousarray(x.T)
    best = ((x - book[0]) ** 2).sum(1)
    code = np.zeros(len(x), np.int64)
    for e in range(1, len(book)):
        live, sums = np.arange(len(x)), np.zeros(len(x), np.int64)
        for d in order:
            sums = sums + (columns[d, live] - book[e, d]) ** 2
            within = sums <= best[live]
            live, sums = live[within], sums[within]
        nearer = sums < best[live]
        best[live[nearer]] = sums[nearer]
        code[live[nearer]] = e
    return code, best


def codes(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows x the entry of each part, and the squared distances. books: parts x entries x width."""
    parts, _, width = books.shape
    code, away = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for at in range(0, len(x), BLOCK_ROWS):
        block = slice(at, at + BLOCK_ROWS)
        for p in range(parts):
            code[block, p], away[block, p] = nearest_entries(x[block, p * width : (p + 1) * width], books[p])
    return code, away


def _round(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floored mean of its parts, unused ones as they were."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, total = shared.value, np.zeros((parts, entries, width + 1), np.int64)  # the last column counts
        for batch in batches:
            x = matrix(batch.column(0))
            code, _ = codes(x, books)
            for p in range(parts):
                np.add.at(total[p, :, :width], code[:, p], x[:, p * width : (p + 1) * width])
                total[p, :, width] += np.bincount(code[:, p], minlength=entries)
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "s"])

    summed = rows.select("x").mapInArrow(sums, "at long, s long").groupBy("at").agg(F.sum("s").alias("s")).collect()  # one row a place in the codebooks
    total = np.zeros(parts * entries * (width + 1), np.int64)
    for r in summed:
        total[r["at"]] = r["s"]
    total = total.reshape(parts, entries, width + 1)
    counts = total[:, :, width:]
    return np.where(counts > 0, total[:, :, :width] // np.maximum(counts, 1), books)


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """The codebooks (parts x entries x width) of saved integer rows (vec_id, x); None where there is no row."""
    most = F.array_max(F.transform("x", F.abs))
    seen = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.max(most).alias("largest")).first()
    if seen["least"] is None:
        return None
    if seen["least"] != seen["most"] or seen["least"] < parts or seen["least"] % parts:
        raise ValueError(f"vectors of one width that {parts} divides are asked for, not {seen['least']} to {seen['most']}")
    if seen["largest"] >= LARGEST:
        raise ValueError(f"integers of {LARGEST} or more")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _round(rows, books)
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part), error: integer rows by their nearest entries."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value.shape[0]
        for batch in batches:
            code, away = codes(matrix(batch.column(2)), shared.value)
            text = code.astype(np.uint8).tobytes().hex()
            hexed = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(hexed, pa.string()), pa.array(away.sum(1))], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("vec_id", "label", "x").mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decoded(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """coded with x: the entries that the codes name, one part after the other."""
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    tables = [F.array(*(F.array(*(F.lit(int(v)) for v in row)) for row in book)) for book in books]
    return coded.withColumn("x", F.concat(*(F.get(table, entry(p)) for p, table in enumerate(tables))))


def digest_of(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (summed over rows of the same label), codebooks_sha256 of each row with a finite vector."""
    own = integers(rows, vector, vec_id, label)
    books = trained(own)
    if books is None:
        return own.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = save(encoded(own, books), "codes")
    by_label = save(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "label-errors")
    return join_counted(coded, by_label, ["label"], "rows").select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))
