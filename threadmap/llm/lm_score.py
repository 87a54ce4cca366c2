"""Scores of texts under a causal self-attention model of subword ids, beside a word-count base.

Texts are words, A-Z in lower case, and one end. Words are counted over all training texts.
The base is the sum of log10((c + 1) / (N + V + 1)) over tokens. The score is the log10 of a
probability: each token has

    a * P(token | its times among the text's words before it) + b * c / N + (1 - a - b) * P(ids)

where P(ids) is the model's probability of the token's subword ids and of a word's end after
them, given that a word begins. So the three parts are distributions over words, or parts of
one, and their mixture is no more than one. a is left out at a text's first word. a and b are parameters.

All training texts teach the model. Its tables of ids after ids come from the counts of all
words; its weights are trained on windows that hold every id of every training text once as what is
predicted. A round takes its part of all windows; in it each task goes over its share from the
same weights, and the results are averaged by windows.
Counts of the HEAD most frequent words are held by all tasks, those of all others are joined
to the words of the texts, for the base and the score alike; so HEAD changes no result.

Defined cases: a null text counts as empty and is its end alone. A null doc_id is scored,
held_out is null, and it isn't trained on. Repeated rows each get a row. An empty table
gives an empty result; without training texts the model has its start weights. Words and
texts may be of any length and are scored whole. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .bpe import byte_letters
from .common import crc_of, save
from .words import Table, distinct, ranges, slices, split_at_white_space, sums

#: Merges of the tokenizer that are used, so ids are few and a text's words share them.
MERGES = 768
#: One of so many windows of each training text trains the weights, all of them where this is 1, and the words from which one of windows_of is cut.
EVERY, WINDOW_WORDS = 1, 8
#: Rounds of training, which share all windows, the windows that a task goes over in each, and the rate of the first.
ROUNDS, TASK_WINDOWS, RATE = 3, 30_000, 0.01
#: The shares a and b.
RECENT, COUNTED = 0.12, 0.35
#: Most frequent words that every task holds, at most (some 20 MB there).
HEAD = 200_000
KEPT_WORDS = 350_000
#: The end of a text among the words. No word has a space.
END = b" "
_LOG10 = float(np.log(10))


class Ids:
    """Ids of words under the first merges of a tokenizer; those that begin a word, and the end, come first."""

    def __init__(self, path: str, merges: int = MERGES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["model"]["merges"] = spec["model"]["merges"][:merges]
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.letters = {b: letter for b, letter in letters.items()}
        self.model = Tokenizer.from_str(json.dumps(spec)).model
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        used = {*letters.values(), *(a + b for a, b in pairs)}
        space = letters[0x20]
        starts, others = sorted(t for t in used if t[0] == space), sorted(t for t in used if t[0] != space)
        self.place = np.zeros(max(vocab.values()) + 1, np.int16)
        for i, t in enumerate(starts):
            self.place[vocab[t]] = i
        for i, t in enumerate(others):
            self.place[vocab[t]] = len(starts) + 1 + i
        self.end, self.space = len(starts), space
        self.shape = attention.Shape(len(used) + 1, len(starts) + 1)
        self.table = Table(self._of_words, KEPT_WORDS, "<i2")

    def _of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out, sizes, tokenize = [], [], self.model.tokenize
        for w in words:
            if w == END:
                own = [-1]
            else:
                own = [t.id for t in tokenize(self.space + (w.decode() if w.isascii() and w.isalnum() else w.decode("latin-1").translate(self.letters)))]
            out += own
            sizes.append(len(own))
        ids = np.array(out, np.int64)
        return np.where(ids < 0, self.end, self.place[ids]).astype(np.int16), np.array(sizes, np.int64)


def words_and_counts(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The number of each word among the distinct ones, these as bytes, and the words of each text."""
    flat, counts = split_at_white_space(pc.ascii_lower(texts))
    which, found = distinct(flat.cast(pa.binary()))
    return which, found, counts


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), c: the tokens of docs (doc_id, text) whose crc32(doc_id) mod 7 is not 2."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "c"]
        for batch in batches:
            for a, b in slices(batch.column(0)):
                which, found, _ = words_and_counts(batch.column(0).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([found, pa.array(np.bincount(which, minlength=len(found)).astype(np.int64))], names=names)
                yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([b - a], pa.int64())], names=names)

    training = docs.where(crc_of("doc_id") % 7 != 2).select("text")
    return training.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def follow_counts(counts: DataFrame, tokenizer: str, shape: attention.Shape) -> tuple[np.ndarray, np.ndarray]:
    """follows and ends of corpus_tables, from all words and their counts; ids**2 numbers at most reach the driver."""
    v = shape.ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total = Ids(tokenizer), np.zeros((v + 1) * (v + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                part = batch.slice(at, 50_000)
                flat, sizes = ids._of_words(part.column(0).to_pylist())
                flat, c = flat.astype(np.int64), part.column(1).to_numpy()
                before = np.r_[v, flat[:-1]]
                before[np.cumsum(sizes) - sizes] = v
                total += np.bincount(before * (v + 1) + flat, np.repeat(c, sizes), len(total))
                total += np.bincount(flat[np.cumsum(sizes) - 1] * (v + 1) + v, c, len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    rows = counts.mapInArrow(count, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((v + 1) * (v + 1))
    table[rows["at"].to_numpy()] = rows["n"].to_numpy()
    table = table.reshape(v + 1, v + 1)
    table[ids_end(shape), v] = 0  # nothing follows a text's end
    return table[:, :v], table[:v, v]


def ids_end(shape: attention.Shape) -> int:
    """The id of a text's end: the last of those that begin a word."""
    return shape.starts - 1


def windows_of(docs: DataFrame, tokenizer: str, every: int) -> DataFrame:
    """w: one of so many windows of each text that begin at every WINDOW_WORDS-th word, as 16-bit ids, -1 after the text's end; ids beyond are left out, so ``scored`` has id_windows."""
    size = attention.WINDOW + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(tokenizer)
        start = ids.shape.ids
        for batch in batches:
            for a, b in slices(batch.column(0)):
                words, counts = split_at_white_space(pc.ascii_lower(batch.column(0).slice(a, b - a)))
                ids.table.room()
                pieces = counts // WINDOW_WORDS + 1  # the text's end is a token of the last one
                text = np.repeat(np.arange(len(counts)), pieces)
                number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                # a text's length in words deals where its windows begin
                chosen = (number + text_hash(counts)[text]) % every == 0
                text, number = text[chosen], number[chosen]
                first = (np.cumsum(counts) - counts)[text] + number * WINDOW_WORDS
                n = np.minimum(counts[text] - number * WINDOW_WORDS, WINDOW_WORDS)
                which, found = distinct(words.take(pa.array(ranges(first, n))).cast(pa.binary()))
                flat, sizes = ids.table.ids(ids.table.codes(found.to_pylist())[which])
                per = sums(sizes, n)
                out = np.full((len(text), size + 1), -1, np.int16)
                begin = (number == 0).astype(np.int64)
                out[begin == 1, 0] = start
                take = np.minimum(per, size - begin)
                rows = np.repeat(np.arange(len(text)), take)
                source = ranges(np.cumsum(per) - per, take)
                out[rows, ranges(begin, take)] = flat[source]
                ended = (n < WINDOW_WORDS) & (per + begin < size)
                out[ended, (per + begin)[ended]] = ids.end
                out = out[(out[:, 1] >= 0)][:, :size]
                yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in out], pa.binary())], names=["w"])

    return docs.where(crc_of("doc_id") % 7 != 2).select("text").mapInArrow(cut, "w binary")


def text_hash(counts: np.ndarray) -> np.ndarray:
    return (counts * 2654435761 >> 7) & 0xFFFF


def id_windows(docs: DataFrame, tokenizer: str, every: int = 1) -> DataFrame:
    """w, h: the windows of each training text, as 16-bit ids, -1 after the text's end, and a hash of the document and the window's number.

    A window begins with the last id of the one before, or the start id, so each id is predicted in one of them. All are
    returned unless one of so many is asked for.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(tokenizer)
        start, size = ids.shape.ids, attention.WINDOW
        for batch in batches:
            for a, b in slices(batch.column(1)):
                which, found, counts = words_and_counts(batch.column(1).slice(a, b - a))
                ids.table.room()
                own = ids.table.codes([*found.to_pylist(), END])
                sizes = counts + 1
                of_word = np.full(int(sizes.sum()), len(found), np.int64)
                inner = np.ones(len(of_word), bool)
                inner[np.cumsum(sizes) - 1] = False
                of_word[inner] = which
                flat, per_token = ids.table.ids(own[of_word])
                per_text = sums(per_token, sizes)
                n = -(-per_text // size)  # the end is an id, so there is a window at least
                text = np.repeat(np.arange(len(n)), n)
                number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
                if every > 1:
                    chosen = (number + text_hash(counts)[text]) % every == 0
                    text, number = text[chosen], number[chosen]
                begin = (np.cumsum(per_text) - per_text)[text] + number * size
                take = np.minimum(per_text[text] - number * size, size)
                out = np.full((len(text), size + 1), -1, np.int16)
                out[:, 0] = np.where(number == 0, start, flat[np.maximum(begin - 1, 0)])
                out[np.repeat(np.arange(len(text)), take), ranges(np.ones(len(text), np.int64), take)] = flat[ranges(begin, take)]
                doc = batch.column(0).slice(a, b - a).to_numpy()[text].astype(np.uint64)
                h = (doc * np.uint64(0x9E3779B97F4A7C15)) ^ (number.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * size + 2), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([rows, pa.array((h ^ (h >> np.uint64(32))).view(np.int64))], names=["w", "h"])

    return docs.where(crc_of("doc_id") % 7 != 2).select("doc_id", "text").mapInArrow(cut, "w binary, h long")


def trained(windows: DataFrame, about: int, shape: attention.Shape, base: np.ndarray, rounds: int, per_task: int) -> dict[str, np.ndarray]:
    """Weights after so many rounds over windows (w, h), of which there are about so many. A row for each weight comes from each task."""
    spark, w = windows.sparkSession, attention.start_weights(shape)
    dealt = save(windows.repartition(max(1, -(-about // (per_task * rounds))), "h").sortWithinPartitions("h", "w").select("w"), "lm-windows")
    names, sizes = [*w], [p.size for p in w.values()]
    for r in range(rounds):
        shared, rate = spark.sparkContext.broadcast((w, base)), RATE * (1 - r / rounds)

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, tables = shared.value
            parts, at = [], 0
            for batch in batches:
                # the round's part of all windows
                mine = batch.column(0).take(pa.array(np.arange((r - at) % rounds, batch.num_rows, rounds)))
                parts.append(np.frombuffer(b"".join(mine.to_pylist()), np.int16).reshape(len(mine), attention.WINDOW + 1))
                at += batch.num_rows
            rows = np.concatenate(parts) if parts else np.zeros((0, 0), np.int16)
            if not len(rows):
                return
            after = attention.descend(dict(own), tables, shape, rows, rate)
            flat = np.concatenate([after[n].ravel() for n in names]).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * len(rows)), pa.array(np.full(len(flat), len(rows)))], names=["i", "x", "n"])

        mean = dealt.mapInArrow(go, "i long, x double, n long").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas().sort_values("i")
        shared.unpersist()
        if len(mean):
            parts = np.split(mean["x"].to_numpy(np.float32), np.cumsum(sizes)[:-1])
            w = {n: x.reshape(w[n].shape) for n, x in zip(names, parts)}
    return w


def recency(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For all tokens of texts of these sizes the token's share of those before it in its text; none for the end."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(text * (int(codes.max(initial=0)) + 1) + codes, kind="stable")
    fresh = np.r_[True, (codes[order][1:] != codes[order][:-1]) | (text[order][1:] != text[order][:-1])][: len(order)]
    before = np.empty(len(order))
    before[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return before / np.maximum(place, 1)


def token_probabilities(model: attention.Model, flat: np.ndarray, per_token: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """P(ids) of all tokens of texts of so many tokens each: of its ids and a word's end, given that a word begins."""
    own, begins = model.score(flat, sums(per_token, sizes))
    first = np.cumsum(per_token) - per_token
    log_p = np.add.reduceat(own.astype(float), first) if len(first) else np.zeros(0)
    follow = np.zeros(len(log_p))
    follow[:-1] = begins[first[1:]]
    follow[np.cumsum(sizes) - 1] = 0  # nothing follows the end of a text
    return np.exp(log_p + follow)


def scored(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = save(word_counts(source), "word-counts")
    total, distinct_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    sizes = counts.groupBy("c").agg(F.count("*").alias("words")).orderBy(F.desc("c"))
    least, held = None, 0
    for c, n in sizes.toLocalIterator():
        if held + n > HEAD:
            break
        least, held = c, held + n
    head = {bytes(r["word"]): r["c"] for r in counts.where(F.col("c") >= least).collect()} if least else {}

    shape = Ids(tokenizer).shape
    follows, ends = follow_counts(counts, tokenizer, shape)
    base, within = attention.corpus_tables(shape, follows, ends)
    weights = trained(id_windows(source, tokenizer, EVERY), int(follows.sum()) // (attention.WINDOW * EVERY), shape, base, ROUNDS, TASK_WINDOWS)
    counted = COUNTED if total else 0.0
    shared = spark.sparkContext.broadcast((head, attention.Model(shape, base, within, weights)))
    at_least = max(1, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = shared.value
        ids = Ids(tokenizer)
        c_of = np.zeros(0, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 22):
                which, found, counts_ = words_and_counts(batch.column(1).slice(a, b - a))
                if ids.table.room():
                    c_of = np.zeros(0, np.int64)
                words = [*found.to_pylist(), END]
                own = ids.table.codes(words)
                if len(c_of) < len(ids.table.code):
                    met = list(ids.table.code)[len(c_of) :]
                    c_of = np.r_[c_of, np.fromiter((table.get(w, 0) for w in met), np.int64, len(met))]
                sizes = counts_ + 1
                ends = np.cumsum(sizes) - 1
                of_word = np.full(int(sizes.sum()), len(found), np.int64)
                inner = np.ones(len(of_word), bool)
                inner[ends] = False
                of_word[inner] = which
                codes = own[of_word]
                flat, per_token = ids.table.ids(codes)
                by_ids = token_probabilities(model, flat.astype(np.int64), per_token, sizes)
                c = c_of[codes]
                first = np.cumsum(sizes) - sizes
                recent = np.full(len(codes), RECENT)
                recent[first] = 0
                scale = (1 - recent) / (1 - RECENT)
                mass = recent * recency(codes, sizes) + scale * (1 - RECENT - counted) * by_ids
                known = c > 0
                p = np.log(np.maximum(mass + scale * counted * c / at_least, 1e-300)) / _LOG10
                rare = np.flatnonzero(~known)
                bounds = pa.array(np.r_[0, np.cumsum(sums((~known).astype(np.int64), sizes))].astype(np.int32))
                dictionary = pa.concat_arrays([found, pa.array([END], pa.binary())])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(sizes),
                        pa.array(sums(known.astype(np.int64), sizes)),
                        pa.array(np.add.reduceat(np.log10(c + 1.0), first)),
                        pa.array(np.add.reduceat(p, first)),
                        pa.ListArray.from_arrays(bounds, dictionary.take(pa.array(of_word[rare]))),
                        pa.ListArray.from_arrays(bounds, pa.array(scale[rare] * counted / at_least / np.maximum(mass[rare], 1e-300))),
                    ],
                    names=["doc_id", "n_tokens", "known", "logs", "score", "words", "gains"],
                )

    schema = "doc_id long, n_tokens long, known long, logs double, score double, words array<binary>, gains array<double>"
    rows = save(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    # Explodes pairs of a word and what each time it was counted adds to its probability; words that were never counted add nothing.
    rare = rows.select("row", F.explode(F.arrays_zip("words", "gains")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.gains").alias("gain"))
    tail = counts.where(F.col("c") < least) if least else counts
    found = rare.join(tail, "word").groupBy("row").agg(
        F.count("*").alias("rare_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("rare_logs"), F.sum(F.log10(1 + F.col("gain") * F.col("c"))).alias("rare_score")
    )
    joined = rows.drop("words", "gains").join(found, "row", "left")
    base_score = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct_words + 1)))
    return joined.select(
        "doc_id",
        (crc_of("doc_id") % 7 == 2).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base_score.alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
