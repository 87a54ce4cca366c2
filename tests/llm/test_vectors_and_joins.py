import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadmap.llm import ngram_join, vector_codes, whitening
from threadmap.llm.common import join_counted, save

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def vectors(n, d=16, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0, 0.4, d).astype(np.float32).tolist(), int(rng.integers(0, 3)) if i % 5 else None) for i in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int"


# product codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in rows if r[1] and all(v is not None and np.isfinite(v) for v in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(4096 * np.array([r[1] for r in kept], np.float64)).astype(np.int64)
    cut = x.reshape(len(x), parts, -1)
    books = cut[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((cut[:, :, None, :] - books[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2).sum(1)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = cut[code[:, p] == e, p]
                if len(own):
                    books[p, e] = [int(s) // len(own) for s in own.sum(0)]
    code, error = assign()
    of_label = Counter()
    for r, e in zip(kept, error.tolist()):
        of_label[r[2]] += e
    digest = vector_codes.digest_of(books)
    return sorted((str(r[0]), bytes(c.tolist()).hex(), e, of_label[r[2]], digest) for r, c, e in zip(kept, code.astype(np.uint8), error.tolist()))


def coded(spark, rows):
    got = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got)


def test_codes_equal_plain_rounds_over_several_tasks(spark):
    rows = vectors(300)
    rows += [(1000 + i, rows[7][1], 1) for i in range(40)] + [(7, rows[7][1], 2), (None, rows[9][1], 2)]  # copies, a repeated and a null id
    rows += [(2000, None, 1), (2001, [None, *rows[0][1][1:]], 1), (2002, [float("nan"), *rows[0][1][1:]], 1), (2003, [float("-inf"), *rows[0][1][1:]], 1), (2004, [], 1)]
    got = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("x", F.lit("clash")).withColumn("error", F.lit(1)))
    assert sorted(tuple([str(r["vec_id"]), *r[1:]]) for r in got.collect()) == plain_codes(rows)


@pytest.mark.parametrize("seed", range(4))
def test_partial_distances_find_the_first_nearest_entry(seed):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-3, 4, (500, 6)), rng.integers(-3, 4, (16, 6))  # many ties
    code, away = vector_codes.nearest_entries(x, book)
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (code == d.argmin(1)).all() and (away == d.min(1)).all()


def test_few_rows_empty_tables_and_odd_widths(spark):
    rows = vectors(5)
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []
    with pytest.raises(ValueError, match="width"):
        coded(spark, [(1, [0.5] * 12, 1)])
    with pytest.raises(ValueError, match="width"):
        coded(spark, [(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)])
    with pytest.raises(ValueError, match="integers"):
        coded(spark, [(1, [1e9] * 8, 1)])


def test_decoded_codes_are_as_far_off_as_their_error(spark):
    own = vector_codes.integers(spark.createDataFrame(vectors(60), SCHEMA))
    books = vector_codes.trained(own)
    back = vector_codes.decoded(vector_codes.encoded(own, books), books).withColumnRenamed("x", "y")
    off = back.join(own.select("vec_id", "x"), "vec_id").select("error", F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0).cast("long"), lambda s, v: s + v).alias("d"))
    assert off.count() == 60 and off.where("error <> d").isEmpty()


def test_keys_that_hold_most_rows_meet_by_broadcast(spark):
    rows = save(spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2500).alias("k"), "id"), "rows")
    keyed = save(rows.groupBy("k").agg(F.count("*").alias("times"), F.max("id").alias("top")), "keyed")
    got = join_counted(rows, keyed, ["k"], "times")
    assert got.columns == ["k", "id", "times", "top"] and got.count() == 5000
    assert got.agg(F.sum("top")).first()[0] == keyed.agg(F.sum(F.col("times") * F.col("top"))).first()[0]


# whitening


def test_whitening_equals_a_plain_one(spark):
    rows = vectors(400, 24, 3)
    rows += [(9000 + i, rows[0][1], 0) for i in range(30)] + [(None, rows[1][1], 0), (5, None, 0), (6, [None] * 24, 0), (7, [float("inf")] * 24, 0)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("w", F.lit(1))).toPandas()
    kept = [r for r in rows if r[1] and all(v is not None and np.isfinite(v) for v in r[1])]
    x = np.floor(1024 * np.array([r[1] for r in kept], float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    values, axes = np.linalg.eigh(np.cov((x - s / n).T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    want = (x - s / n) @ axes[:, :8] / np.sqrt(values[:8])
    assert len(got) == 8 * n and (got["n"] == n).all() and got["identity_error"].max() < 1e-9
    assert got.drop_duplicates("component").sort_values("component")["explained"].to_numpy() == pytest.approx(values[:8] / values.sum(), rel=1e-9)
    exact = {r[0]: int(v) for r, v in zip(kept, ((n * x - s) ** 2).sum(1))}
    at = {r[0]: i for i, r in enumerate(kept)}
    sign = {}
    for r in got[got["vec_id"].notna()].itertuples():
        assert r.deviation == exact[int(r.vec_id)]
        w = want[at[int(r.vec_id)], r.component - 1]
        if abs(w) > 1e-6:
            assert sign.setdefault(r.component, np.sign(w * r.whitened)) * r.whitened == pytest.approx(w, abs=1e-9)


def test_tiles_that_do_not_divide_the_dimensions(spark):
    rows = spark.createDataFrame(vectors(90, 11, 5), SCHEMA).repartition(4)
    own = whitening.whole_numbers(rows)
    of = whitening.sums(own)
    x = np.array([r["x"] for r in own.collect()])
    assert whitening.tiled_covariance(own, of, tile=4) == pytest.approx(np.cov(x.T, bias=True))


def test_whitening_of_odd_tables(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.25], 0)], SCHEMA)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whitened(spark.createDataFrame([(i, [0.1 * i, 0.5], 0) for i in range(6)], SCHEMA)).collect()  # the second dimension is constant
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and flat[0]["identity_error"] < 1e-9
    with pytest.raises(Exception, match="widths"):
        whitening.whitened(spark.createDataFrame([(1, [0.5, 0.25], 0), (2, [0.5], 0)], SCHEMA))
    with pytest.raises(Exception, match="or more|overflow"):
        whitening.whitened(spark.createDataFrame([(1, [1e30, 0.25], 0)], SCHEMA))


def test_deviations_beyond_64_bits_are_exact():
    of = whitening.Sums(1 << 33, [3 << 33, -(5 << 33) + 7])
    x = np.array([[1_000_003, -123_456], [3, -5]])
    assert of.deviations(x) == [sum((of.n * int(v) - s) ** 2 for v, s in zip(row, of.s)) for row in x]
    assert of.deviations(x)[0] > 1 << 64


# n-gram join


def plain_set(text, width=4):
    words = (text or "").encode().translate(LOWER).split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def plain_components(docs, percent=85):
    sets = [plain_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holders.get(g, []))
        for j, o in common.items():
            if 100 * o >= percent * (len(s) + len(sets[j]) - o):
                root[find(i)] = find(j)
        for g in s:
            holders.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return sorted((str(d), len(s), str(least[find(i)])) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def joined(spark, docs, **more):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.linked(frame, cells=1 << 12, **more).collect())


def family(rng, size, words, edits, common=()):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join([*own, *common])


def test_components_are_those_of_all_links(spark):
    rng = random.Random(4)
    common = [f"common{i}" for i in range(30)]
    texts = [t for words, edits in ((40, 1), (60, 2), (100, 4), (35, 2), (200, 7)) for t in family(rng, 60, words, edits, common if words > 50 else ())]
    texts += [" ".join(f"x{rng.randrange(50)}" for _ in range(rng.randrange(1, 80))) for _ in range(150)]
    texts += texts[:40] + [texts[0].upper()] * 30
    docs = list(enumerate(rng.sample(texts, len(texts))))
    want = plain_components(docs)
    assert len({c for _, _, c in want}) < len(docs) - 100
    assert joined(spark, docs) == want


def test_groups_larger_than_a_block_are_compared_in_cells(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "STARS", 1)
    docs = list(enumerate(family(rng, 150, 40, 3)))  # most pairs lie about the similarity
    want = plain_components(docs)
    assert len({c for _, _, c in want}) > 1
    assert joined(spark, docs) == want
    monkeypatch.setattr(ngram_join, "HOT_KEYS", 10)  # most groups count as hot
    assert joined(spark, docs) == want


def test_links_at_the_similarity_itself_and_just_under_it(spark):
    words = [f"w{i}" for i in range(103)]  # 100 n-grams
    at = words[:-15]  # 85 of 100
    under = words[:-16]
    docs = [(1, " ".join(words)), (2, " ".join(at)), (3, "a b c d e f"), (4, "A B\tC\x0bD e F")]
    assert joined(spark, docs) == sorted([("1", 100, "1"), ("2", 85, "1"), ("3", 3, "3"), ("4", 3, "3")])
    assert joined(spark, [(1, " ".join(words)), (2, " ".join(under))]) == [("1", 100, "1"), ("2", 84, "2")]


def test_odd_rows_of_the_join(spark):
    long = " ".join(f"t{i % 9973}" for i in range(120_000))
    docs = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two  three"), (None, "one"), (None, None), (8, "é É"), (9, "É é"), (10, long), (11, long + " end"), (12, "one"), (12, "other words stand here now"), (12, "one")]
    assert joined(spark, docs) == plain_components(docs)
    assert joined(spark, []) == []
    clash = spark.createDataFrame([(1, "a b c d", 5, "x")], "doc_id long, text string, n long, same string")
    assert [tuple(r) for r in ngram_join.linked(clash, cells=64).collect()] == [(1, 1, 1)]


def test_fragments_hold_each_place_once():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    order = ngram_join.Order(np.zeros(4, np.uint8), np.array([0, 1 << 61, 1 << 62, 3 << 62], np.uint64))
    parts = order.fragments(keys)
    assert len(parts) == 4 and (np.concatenate(parts) == keys).all()


def test_letters_outside_ascii_stay_in_lowering():
    column = pa.array(["ÀB c", None, "Zz", "x"]).slice(1, 2)
    assert ngram_join.lowered(column).to_pylist() == ["", "zz"]
    assert ngram_join.lowered(pa.array(["ÀB c"])).to_pylist() == ["Àb c"]
