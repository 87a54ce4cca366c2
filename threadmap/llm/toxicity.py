"""Toxicity scores over texts that a noisy-channel decoder has restored.

Words that look disguised (digits or signs among letters, letters repeated, separators
between letters) and runs of single letters become a lattice of readings; a space within a
run may be one that was put in, or the end of a word. A Viterbi search picks the reading
that is likeliest under a character trigram model and the costs of the channel. The trigrams
are counted over all texts. Words and word beginnings of a
bounded sample of labelled rows are evidence for the label; a document's score is a
logistic function of the evidence of its distinct words, raw and restored. Labels, and no
columns but the text, decide the score.

Defined cases: null and empty texts have no evidence and get the score of no evidence. A
label that is null is not learned from; a doc_id with several labels counts as each. With
no labels at all every score is 0. Null doc_ids are scored like others, held_out null.
Repeated rows each get a row. Very long words and runs are decoded in pieces, in time that is linear
in their length. Empty tables give empty results. Other columns are ignored,
or returned unchanged by ``drop_toxic``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, crc_of, save

#: Labelled rows that the classifier is fitted on, at most: those of least hash of doc_id.
SAMPLE_ROWS = 20_000
#: Lengths of the beginnings that are evidence beside whole words.
BEGINNINGS = (4, 5, 6)
#: Toxic rows of the sample that a word must be in, at least, and their share.
LEAST_ROWS, LEAST_SHARE = 3, 0.01
#: Log odds that a word needs to count as evidence: so much less than the most that a
#: sample of its size can give to a word, which it has in no clean row; and the least.
WEIGHT_RANGE, LEAST_WEIGHT = 5.0, 3.0
#: Evidence above which a row counts as having so much, when the logistic function is fitted.
FITTED_EVIDENCE = 60.0
THRESHOLD = 0.7

#: The letters that a sign may stand for.
READINGS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
SIGN_COST, DROP_COST, REPEAT_COST = 1.0, 0.5, 1.0
#: Single letters in a row that are read as a run.
LEAST_RUN = 3

_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Classes of characters: 0 for a word's edge, 1-26 a-z, 27-59 the letters 0xDF to 0xFF, 60 others.
CLASSES = 61
_EDGE = ".,;:?\"'`)[]{}*#%&~^<>=/\\_-"
_DISGUISE = re.compile(r"[^\W\d_][\d@$!|+(€]|[\d@$!|+(€][^\W\d_]|([^\W\d_])\1\1|^(?:[^\W_][.\-_*]){3,}[^\W_]$")
_NUMBER = re.compile(r"\d[\d.,:+-]*")
_LONG_RUN = re.compile(r"(.)\1{16,}", re.DOTALL)
#: Characters of a word or run that are decoded at once; a longer one goes on from the likeliest reading of what came before.
PIECE = 1024


def class_table() -> np.ndarray:
    table = np.full(0x110000, CLASSES - 1, np.uint8)
    table[[*range(0x21), 0x7F]] = 0
    table[97:123] = table[65:91] = np.arange(1, 27)
    table[0xDF:0x100] = np.arange(27, 60)
    return table


def trigram_counts(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Counts of each three classes in a row, the edges of texts included."""
    counts = np.zeros(CLASSES**3, np.int64)
    for at in range(0, len(texts), 64):
        joined = "  " + "  ".join(texts[at : at + 64]) + "  "
        c = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
        counts += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    return counts


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(c | a, b) of classes, from all texts; CLASSES**3 counts at most reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, total = class_table(), np.zeros(CLASSES**3, np.int64)
        for frame in batches:
            total += trigram_counts([x for x in frame["text"] if x], table)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"g": some, "n": total[some]})

    rows = docs.select(F.col(text).alias("text")).mapInPandas(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(CLASSES**3)
    for g, c in rows:
        n[g] = c
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    pairs = n.sum(0) + 0.1
    lower = pairs / pairs.sum(1, keepdims=True)
    return np.log((n + 5 * lower) / (n.sum(2, keepdims=True) + 5)).astype(np.float32)


class Decoder:
    """Restores disguised words by a Viterbi search over their lattice."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.low = class_table()[:0x250].tolist()  # all others are of the last class

    def _class(self, letter: str) -> int:
        o = ord(letter)
        return self.low[o] if o < 0x250 else CLASSES - 1

    def _steps(self, word: str, i: int, run: int) -> list[tuple[int, str, float]]:
        """The readings at a place, from which on a character is repeated run times: where each goes on, what it emits, what it costs."""
        c = word[i]
        if c == " ":
            return [(i + 1, "", 0.0), (i + 1, " ", 0.0)]
        steps = [(i + 1, c, 0.0)] if c.isalnum() else [(i + 1, "", DROP_COST)]
        steps += [(i + 1, x, SIGN_COST) for x in READINGS.get(c, "")]
        if run >= 3:
            for x in (c if c.isalpha() else "") + READINGS.get(c, ""):
                own = REPEAT_COST + SIGN_COST * (x != c)
                steps += [(i + run, x, own), (i + run, x + x, own + 0.5)]
        return steps

    def restore(self, word: str) -> str:
        """The likeliest reading of the word, or of a run of letters with a space between each two.

        Of over 16 equal characters in a row 16 are read: reading more of them is never likelier. Time is linear in the length.
        """
        word = _LONG_RUN.sub(lambda m: m[1] * 16, word)
        read, state = [], (0, 0)
        for at in range(0, len(word), PIECE):
            text, state = self._piece(word[at : at + PIECE], state, at + PIECE >= len(word))
            read.append(text)
        return "".join(read)

    def _piece(self, word: str, state: tuple[int, int], last: bool) -> tuple[str, tuple[int, int]]:
        """The likeliest reading of a piece that begins after two classes, and the two that it ends with."""
        runs = [1] * len(word)
        for i in range(len(word) - 2, -1, -1):
            if word[i] == word[i + 1]:
                runs[i] = runs[i + 1] + 1
        best: list[dict] = [{} for _ in range(len(word) + 1)]
        best[0][state] = (0.0, None, "")
        for i in range(len(word)):
            steps = self._steps(word, i, runs[i]) if best[i] else ()
            for (a, b), (score, _, _) in best[i].items():
                for to, out, cost in steps:
                    p, q, s = a, b, score - cost
                    for letter in out:
                        c = self._class(letter)
                        s += self.model[p][q][c]
                        p, q = q, c
                    if (p, q) not in best[to] or s > best[to][(p, q)][0]:
                        best[to][(p, q)] = (s, (i, a, b), out)
        ends = [(s + (self.model[p][q][0] if last else 0.0), (len(word), p, q)) for (p, q), (s, _, _) in best[-1].items()]
        at, read = max(ends)[1], []
        end = at[1:]
        while at:
            i, p, q = at
            _, at, out = best[i][(p, q)]
            read.append(out)
        return "".join(reversed(read)), end


def core(word: str) -> str:
    """The word without signs at its edges that are punctuation."""
    w = word.strip(_EDGE)
    if w and w[-1] in "$@+!(|":
        rest = w.rstrip(w[-1])
        if w[-1] == "!" or len(w) - len(rest) > 1:
            w = rest
    return w.strip(_EDGE)


def address(word: str) -> bool:
    """Whether the word is a mail or web address, or a number with signs about it."""
    at = word.find("@")
    if "://" in word or (at >= 0 and word.rfind(".") >= at + 2):
        return True
    letters = [i for i, c in enumerate(word) if c.isalnum() or c == "_"]
    return bool(letters) and bool(_NUMBER.fullmatch(word[letters[0] : letters[-1] + 1]))


def disguised(word: str) -> bool:
    return bool(_DISGUISE.search(word)) and not address(word)


def spaced(words: list[bytes]) -> list[str]:
    """Runs of single letters, with a space between each two."""
    if sum(map((1).__eq__, map(len, words))) < LEAST_RUN:
        return []
    out, run = [], []
    for w in [*words, b"  "]:
        if len(w) == 1 and (w.isalnum() or w in b"@$!|+("):
            run.append(w.decode())
            continue
        if len(run) >= LEAST_RUN:
            out.append(" ".join(run))
        run = []
    return out


def features(word: str) -> list[str]:
    """The evidence that a word can be: itself and its beginnings."""
    return ["=" + word, *("^" + word[:n] for n in BEGINNINGS if len(word) > n)]


@dataclass
class Model:
    letters: np.ndarray
    lexicon: dict[str, float]
    bias: float
    slope: float


class Scorer:
    """Scores texts in a worker; keeps the evidence of words that it has seen, up to a number and a length of each."""

    KEPT, LONGEST_KEPT = 400_000, 64

    def __init__(self, model: Model):
        self.model, self.decoder = model, Decoder(model.letters)
        self.weights: dict[bytes, float] = {}

    def forms(self, word: str) -> set[str]:
        """The word's plain core and, where it looks disguised, what it is read as."""
        w = core(word)
        return {w, self.decoder.restore(w)} if disguised(w) else {w}

    def weight(self, word: str) -> float:
        get = self.model.lexicon.get
        return max((get(f, 0.0) for form in self.forms(word) for f in features(form)), default=0.0)

    def evidence(self, text: str | None) -> float:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()
        kept, total = self.weights, 0.0
        if len(kept) > self.KEPT:
            kept.clear()
        for w in set(words):
            x = kept.get(w)
            if x is None:
                x = self.weight(w.decode("utf-8", "replace"))
                if len(w) <= self.LONGEST_KEPT:
                    kept[w] = x
            if x:
                total += x
        return total + sum(map(self.weight_of_run, set(spaced(words))))

    def weight_of_run(self, run: str) -> float:
        """The evidence of a run's words: those of its likeliest reading, or all its letters as one."""
        get = self.model.lexicon.get
        best = lambda w: max(get(f, 0.0) for f in features(w))
        return max(sum(map(best, set(self.decoder.restore(run).split()))), best(run.replace(" ", "")))

    def score(self, text: str | None) -> float:
        z = self.model.bias + self.model.slope * self.evidence(text)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _distinct_words(text: str | None, decoder: Decoder) -> set[str]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()
    out = set()
    for w in {core(w.decode("utf-8", "replace")) for w in set(words)}:
        out.add(w)
        if disguised(w):
            out.add(decoder.restore(w))
    return out | {w for run in spaced(words) for w in decoder.restore(run).split()}


def _least(toxic: int, clean: int) -> tuple[float, float]:
    """The toxic rows and the log odds that a word needs, at least."""
    return max(LEAST_ROWS, LEAST_SHARE * toxic), max(LEAST_WEIGHT, math.log(2 * (clean + 1)) - WEIGHT_RANGE)


def _lexicon(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    least, floor = _least(toxic, clean)
    weights = {f: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) for f, (t, c) in counts.items() if t >= least}
    return {f: w for f, w in weights.items() if w >= floor}


def _strong(t: Column, c: Column, toxic: int, clean: int) -> Column:
    """Whether a word of so many toxic and clean rows is in the lexicon; a little more than those."""
    least, floor = _least(toxic, clean)
    return (t >= least) & (F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1)) >= floor - 1e-6)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """bias and slope by Newton's method, with a weak prior."""
    if not len(x):
        return -50.0, 0.0
    design, theta = np.c_[np.ones(len(x)), x / 10], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1e-3, 1e-2])
        theta -= np.linalg.solve(hessian, design.T @ (p - y) + np.array([1e-3, 1e-2]) * theta)
    return float(theta[0]), float(theta[1] / 10)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of all texts and of the labelled rows whose crc32(doc_id) mod 3 is not 1.

    The evidence is counted in two halves of the sample. The logistic function is fitted
    on each half with the evidence that the other gives, and the model keeps both.
    """
    letters = language_model(docs, text)
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    usable = usable.where(crc_of("doc_id") % 3 != 1).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sample = source.join(F.broadcast(usable), "doc_id").withColumn("half", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).cast("int"))
    shared = spark.sparkContext.broadcast(letters)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(shared.value)
        for frame in batches:
            counts: Counter = Counter()
            for t, y, h in zip(frame["text"], frame["toxic"], frame["half"]):
                found = {f for w in _distinct_words(t, decoder) for f in features(w)}
                counts.update((f, y, h) for f in found)
                counts["", y, h] += 1
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["f", "y", "h", "n"]).astype({"n": np.int64})

    cell = lambda y, h: F.sum(F.when((F.col("y") == y) & (F.col("h") == h), F.col("n")).otherwise(0)).alias(f"n{y}{h}")
    table = sample.select("text", "toxic", "half").mapInPandas(count, "f string, y int, h int, n long").groupBy("f").agg(*(cell(y, h) for y in (1, 0) for h in (0, 1)))
    table = save(table.where((F.col("n10") + F.col("n11") >= LEAST_ROWS) | (F.col("f") == "")), "evidence")
    totals = table.where(F.col("f") == "").first()
    if totals is None or not totals["n10"] + totals["n11"]:
        return Model(letters, {}, -50.0, 0.0)
    # a word of a lexicon is in a hundredth of the sample's toxic rows, so there are a hundred times as many as such a row has, at most
    both = lambda y: F.col(f"n{y}0") + F.col(f"n{y}1")
    strong = _strong(both(1), both(0), totals["n10"] + totals["n11"], totals["n00"] + totals["n01"])
    for h in (0, 1):
        strong |= _strong(F.col(f"n1{h}"), F.col(f"n0{h}"), totals[f"n1{h}"], totals[f"n0{h}"])
    rows = table.where((F.col("f") != "") & strong).collect()
    halves = [_lexicon({r["f"]: (r[f"n1{h}"], r[f"n0{h}"]) for r in rows}, totals[f"n1{h}"], totals[f"n0{h}"]) for h in (0, 1)]
    lexicon = _lexicon({r["f"]: (r["n10"] + r["n11"], r["n00"] + r["n01"]) for r in rows}, totals["n10"] + totals["n11"], totals["n00"] + totals["n01"])
    crossed = spark.sparkContext.broadcast([Model(letters, lex, 0.0, 1.0) for lex in halves])

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(m) for m in crossed.value]
        for frame in batches:
            x = [min(scorers[1 - h].evidence(t), FITTED_EVIDENCE) for t, h in zip(frame["text"], frame["half"])]
            yield pd.DataFrame({"x": x, "y": frame["toxic"].astype(float)})

    points = sample.select("text", "toxic", "half").mapInPandas(evidence, "x double, y double").toPandas()
    bias, slope = _logistic(points["x"].to_numpy(), points["y"].to_numpy())
    return Model(letters, lexicon, bias, slope)


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text, doc_id))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model.value)
        for frame in batches:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": [scorer.score(t) for t in frame["text"]]})

    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, score double")
    return out.select("doc_id", (crc_of("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose text scores below the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text, doc_id))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.value)
        for part in texts:
            yield pd.Series([scorer.score(t) for t in part], dtype=float)

    return docs.where(score(F.col(text)) < THRESHOLD)


def restored(texts: list[str], model: Model) -> list[str]:
    """The texts with their disguised words and runs of letters restored."""
    decoder, out = Scorer(model).decoder, []
    for t in texts:
        words = t.split()
        for run in spaced([w.encode() for w in words]):
            letters = run.split(" ")
            at = next(i for i in range(len(words)) if words[i : i + len(letters)] == letters)
            words[at : at + len(letters)] = [decoder.restore(run)]
        out.append(" ".join(decoder.restore(core(w)) if " " not in w and disguised(core(w)) else w for w in words))
    return out
