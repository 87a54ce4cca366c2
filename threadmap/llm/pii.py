"""Personal data: base patterns, and terms that disclose the protected entities.

Base spans are email addresses, IP addresses, card and phone numbers. Each found value is
a protected entity. Terms near its mentions are weighed by what the corpus tells: with p(t)
the share of distinct texts that hold a term, p(e) that of those that hold the entity, and
p(t, e) that of those in which both meet in a context, the term gives
log2(p(t,e) / (p(t) p(e))) of the -log2 p(e) bits that name the entity. A term that gives at
least the share REMOVE of these is removed, one that gives at least GENERALISE is replaced by
its kind. Copies of a text count once in each of the shares, so they change none of them. An
entity of a single text is judged like any other. All counts are over all texts.

Defined cases: a null text counts as empty and has no spans. Repeated rows get equal
results each; rows of null doc_id are kept. Offsets are code points, the end exclusive.
Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, save

KINDS = ["email", "ip", "card", "phone", "term"]
#: Words on either side of a mention that are its context.
CONTEXT_WORDS = 12
GENERALISE, REMOVE = 0.75, 0.9
#: Candidate terms up to which they are sent to all tasks (some 20 MB); more are counted by a shuffle.
BROADCAST_TERMS = 200_000
#: Disclosing terms, each with its entity, up to which they are sent to all tasks (some 30 MB); more are joined by a shuffle.
BROADCAST_TOLD = 200_000
#: Texts with copies up to which their hashes are sent to all tasks (some 30 MB); more are joined by a shuffle.
BROADCAST_COPIES = 1_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can't begin within a run of digits that it didn't begin with, so the look-behind changes nothing but the time.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'`()[]{}<>*#%&$|~^=/\\+-_@"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses from left to right: the run before each @ that a domain follows."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """start, number of the kind, end, value, in order."""
    if not _ANY.search(text):
        return []
    out = [(a, 0, b, text[a:b].translate(LOWER_TABLE)) for a, b in emails(text)]
    out += [(m.start(), 1, m.end(), m[0]) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m[0]))
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), digits))
    for m in _PHONE.finditer(text) if "+" in text else ():
        digits = "".join(_DIGITS.findall(m[0]))
        if 10 <= len(digits) <= 15:
            out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def term_of(word: str) -> str:
    return word.strip(_EDGE).lower()


def contexts(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[str, str, int, int]]:
    """entity, term, start, end: the terms around each mention that no base span covers."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    taken: list[list[int]] = []  # what base spans cover, in order
    for a, _, b, _ in spans:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    taken_ends = [t[1] for t in taken]
    terms: dict[int, tuple[str, int, int] | None] = {}

    def term_at(i: int) -> tuple[str, int, int] | None:
        p, q = words[i]
        raw = text[p:q]
        p += len(raw) - len(raw.lstrip(_EDGE))
        q = p + len(raw.strip(_EDGE))
        term = term_of(raw)
        at = bisect_right(taken_ends, p)
        covered = at < len(taken) and taken[at][0] < q
        return (term, p, q) if any(map(str.isalnum, term)) and not covered else None

    out = []
    for a, kind, b, value in spans:
        entity = f"{KINDS[kind]}:{value}"
        first = bisect_right(ends, a)
        last = bisect_left(starts, b, first)
        for i in [*range(max(0, first - CONTEXT_WORDS), first), *range(last, min(len(words), last + CONTEXT_WORDS))]:
            if i not in terms:
                terms[i] = term_at(i)
            if terms[i]:
                out.append((entity, *terms[i]))
    return out


_FOUND = "doc_id long, row_hash long, base array<struct<start:int,kind:int,end:int>>, entities array<string>, terms array<struct<entity:string,term:string,start:int,end:int>>"


def _hash(text: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def found(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The base spans of each row, its distinct entities, and the terms in their contexts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            spans = [base_spans(t or "") for t in frame["text"]]
            yield frame[["doc_id", "row_hash"]].assign(
                base=[[{"start": a, "kind": k, "end": b} for a, k, b, _ in s] for s in spans],
                entities=[sorted({f"{KINDS[k]}:{v}" for _, k, _, v in s}) for s in spans],
                terms=[[dict(zip(("entity", "term", "start", "end"), c)) for c in contexts(t, s)] if s else [] for t, s in zip(frame["text"], spans)],
            )

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _hash(text).alias("row_hash"), F.col(text).alias("text"))
    return source.mapInPandas(scan, _FOUND)


def term_counts(docs: DataFrame, terms: DataFrame, copied: DataFrame, text: str = "text") -> DataFrame:
    """term, texts: in how many distinct texts each of the terms is. copied (row_hash, times) has the texts with copies."""
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    chosen = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in terms.collect()) if few else None)
    if copied.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES:
        copied = F.broadcast(copied)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = chosen.value
        for frame in batches:
            counts: Counter = Counter()
            for t, times in zip(frame["text"], frame["times"]):
                own = {term_of(w) for w in set((t or "").split())}
                counts.update(((w, times) for w in own) if wanted is None else ((w, times) for w in own & wanted))
            yield pd.DataFrame([(w, n, times) for (w, times), n in counts.items()], columns=["term", "rows", "times"]).astype({"term": str, "rows": "int64", "times": "int64"})

    source = docs.select(F.col(text).alias("text"), _hash(text).alias("row_hash")).join(copied, "row_hash", "left").select("text", F.coalesce("times", F.lit(1)).alias("times"))
    counted = source.mapInPandas(count, "term string, rows long, times long").groupBy("term", "times").agg(F.sum("rows").alias("rows"))
    counted = counted.groupBy("term").agg(F.sum(F.expr("rows div times")).alias("texts"))  # all copies of a text hold the term, so nothing remains
    return counted.join(terms, "term", "left_semi")


def disclosures(docs: DataFrame, rows: DataFrame, text: str = "text") -> DataFrame:
    """entity, term, share: the terms that disclose an entity, with the share of its bits that they give."""
    texts = rows.groupBy("row_hash").agg(F.count("*").alias("times"))
    total = texts.count()
    copied = save(texts.where("times > 1"), "pii-copied")
    met = rows.select("row_hash", F.explode("terms").alias("t")).select("t.entity", "t.term", "row_hash").distinct()
    pairs = save(met.groupBy("entity", "term").agg(F.count("*").alias("both")), "pii-pairs")
    of_entity = rows.select("row_hash", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("of_entity"))
    of_term = term_counts(docs, pairs.select("term").distinct(), copied, text)
    bits = F.log2(total / F.col("of_entity"))
    given = F.log2(F.col("both") * total / (F.col("texts") * F.col("of_entity")))
    share = F.when(bits > 0, given / bits).otherwise(0.0)
    return pairs.join(of_entity, "entity").join(of_term, "term").withColumn("share", share).where(F.col("share") >= GENERALISE).select("entity", "term", "share")


def _everything(base, added: list[tuple[int, int, float]]) -> list[dict]:
    """Base spans and terms (start, end, share) in order."""
    own = [(x["start"], x["kind"], x["end"], 1.0) for x in base]
    return [dict(zip(("start", "kind", "end", "share"), x)) for x in sorted([*own, *((a, 4, b, share) for a, b, share in added)])]


def _replaced(text: str, found) -> str:
    """The text with base spans replaced by their kind, terms generalised to [TERM] or removed."""
    out, at = [], 0
    for x in found:
        if x["start"] < at:
            continue
        out.append(text[at : x["start"]])
        out.append(f"[{KINDS[x['kind']].upper()}]" if x["kind"] < 4 or x["share"] < REMOVE else "")
        at = x["end"]
    return "".join([*out, text[at:]])


_SPAN = "struct<start:int,kind:int,end:int>"
_APPLIED = f"doc_id long, base array<{_SPAN}>, all array<{_SPAN[:-1]},share:double>>, text string"


def sanitised(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, base, all, text of each row: base spans and all spans (start, kind, end[, share]) in order, kind numbering KINDS.

    In the text base spans are replaced by their kind, and disclosing terms generalised to [TERM] or removed.
    """
    rows = save(found(docs, text, doc_id), "pii-found")
    told = save(disclosures(docs, rows, text), "pii-disclosures")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _hash(text).alias("row_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if told.limit(BROADCAST_TOLD + 1).count() <= BROADCAST_TOLD:
        shared = docs.sparkSession.sparkContext.broadcast({(r["entity"], r["term"]): r["share"] for r in told.collect()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shares = shared.value
            for frame in batches:
                out = []
                for t in frame["text"]:
                    spans, best = base_spans(t), {}
                    for entity, term, a, b in contexts(t, spans) if spans else ():
                        share = shares.get((entity, term))
                        if share is not None:
                            best[a, b] = max(share, best.get((a, b), 0.0))
                    base = [{"start": a, "kind": k, "end": b} for a, k, b, _ in spans]
                    every = _everything(base, [(a, b, x) for (a, b), x in best.items()])
                    out.append((base, every, _replaced(t, every)))
                base, every, texts = zip(*out) if out else ((), (), ())
                yield pd.DataFrame({"doc_id": frame["doc_id"], "base": base, "all": every, "text": texts})

        return source.select("doc_id", "text").mapInPandas(run, _APPLIED)
    own = spans_joined(rows, told).dropDuplicates(["doc_id", "row_hash"])
    both = source.join(own.withColumnRenamed("doc_id", "d"), source["doc_id"].eqNullSafe(F.col("d")) & (source["row_hash"] == own["row_hash"]))
    replaced = F.pandas_udf(lambda texts, every: pd.Series([_replaced(t, e) for t, e in zip(texts, every)]), "string")
    return both.select("doc_id", "base", "all", replaced("text", "all").alias("text"))


def spans_joined(rows: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, row_hash, base and all of each of the found rows, where the terms that were told are too many for one task."""
    places = rows.select("doc_id", "row_hash", F.explode("terms").alias("t")).select("doc_id", "row_hash", "t.entity", "t.term", "t.start", "t.end").distinct()
    added = places.join(told, ["entity", "term"]).groupBy("doc_id", "row_hash", "start", "end").agg(F.max("share").alias("share"))
    added = added.groupBy(F.col("doc_id").alias("d"), F.col("row_hash").alias("h")).agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "share")).alias("added"))
    joined = rows.join(added, rows["doc_id"].eqNullSafe(added["d"]) & (rows["row_hash"] == added["h"]), "left")
    own = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(1.0).alias("share")))
    everything = F.array_sort(F.concat(own, F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int,share:double>>"))))
    return joined.select("doc_id", "row_hash", "base", everything.alias("all"))


def listed(spans) -> F.Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
