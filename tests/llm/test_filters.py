"""Toxicity, exact and near deduplication, decontamination: brute force, planted cases, odd rows."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmap.llm import bitslice, decontaminate, exact_dedup, graph, near_dedup, toxicity
from threadmap.llm.common import LOWER_TABLE

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, key long"


def documents(spark, texts, ids=None):
    """Documents with further columns, two of which have names that operators use."""
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 8) for i, t in zip(ids, texts)], DOCS)


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


ODD = ["", None, " \t\n", "a", "A", "a b", "É é", prose(1, 3000), prose(1, 3000), "a b", None, "\x00 b", "a\x0bb"]


# ---- exact dedup -------------------------------------------------------------------------


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER_TABLE), []).append(i)
    return {i: (max(g), len(g)) for g in groups.values() for i in g}


@pytest.mark.parametrize("capacity", [1, 50_000])
def test_exact_dedup_agrees_with_brute_force(spark, capacity):
    got = exact_dedup.duplicates(documents(spark, ODD), capacity=capacity, max_depth=6).collect()
    want = brute_exact(enumerate(ODD))
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got) and len(got) == len(ODD)


def test_exact_dedup_with_one_large_group_and_no_rows(spark):
    docs = documents(spark, ["same"] * 500 + ["Same"] * 200 + [f"t{i}" for i in range(300)])
    got = exact_dedup.duplicates(docs)
    assert got.where("group_size = 700").count() == 700 and got.where("kept").count() == 301
    assert exact_dedup.duplicates(docs.limit(0)).count() == 0
    assert sorted(exact_dedup.drop_duplicates(docs).columns) == sorted(docs.columns)


def test_exact_dedup_keeps_rows_of_null_ids_and_repeated_rows(spark):
    got = exact_dedup.duplicates(documents(spark, ["x", "x", "y", "y", "z"], [None, 3, 5, 5, None])).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"]) for r in got) == [(-1, -1, 1), (-1, 3, 2), (3, 3, 2), (5, 5, 2), (5, 5, 2)]


def test_exact_dedup_filter_keeps_clean_rows_without_id(spark):
    docs = documents(spark, ["x", "x", "y", "Y", "z", None, "w"], [None, 3, 5, 6, None, 9, 3])
    got = exact_dedup.drop_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got.where("text is not null").collect()) == [(-1, "z"), (3, "w"), (3, "x"), (6, "Y")]
    assert got.where("text is null").count() == 1


def test_exact_dedup_filter_keeps_one_of_repeated_rows(spark):
    docs = documents(spark, ["x", "X", "x", "y", "y", "z", "q", "q"], [4, 4, 2, None, None, None, 1, 1])
    got = exact_dedup.drop_duplicates(docs)
    assert sorted((r["doc_id"] or -1, r["text"].lower()) for r in got.collect()) == [(-1, "y"), (-1, "z"), (1, "q"), (4, "x")]


def test_exact_dedup_comes_through_directory_and_chain(spark, monkeypatch):
    """Rows that the directory sends to another bucket, or entries with other bytes, are not found."""
    docs = documents(spark, [f"t{i % 40}" for i in range(80)])
    rows = exact_dedup.lookups(docs)
    slots = exact_dedup.directory(rows, capacity=2, max_depth=6)
    index = exact_dedup.build_index(docs, slots, 6)
    assert index.select("bucket").distinct().count() > 8 and index.where("chain <> 0").count() == 0
    assert exact_dedup.found(rows, index, slots, 6).count() == 80
    wrong = slots.withColumn("bucket", F.col("bucket") + 1)
    assert exact_dedup.found(rows, index, wrong, 6).count() < 80
    assert exact_dedup.found(rows, index.withColumn("sha256", F.reverse("sha256")), slots, 6).count() == 0
    # texts that meet under one key are chained
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    rows = exact_dedup.lookups(docs)
    slots = exact_dedup.directory(rows, capacity=2, max_depth=6)
    index = exact_dedup.build_index(docs, slots, 6)
    assert sorted(r["chain"] for r in index.collect()) == list(range(40))
    assert exact_dedup.found(rows, index, slots, 6).where("group_size = 2").count() == 80
    monkeypatch.setattr(exact_dedup, "MANY_ROWS", 2)
    assert exact_dedup.found(rows, index, slots, 6).where("group_size = 2").count() == 80


def test_directory_splits_only_overfull_buckets(spark):
    keys = [i << 60 for i in range(4)] + [(1 << 62) + i for i in range(3)]
    entries = spark.createDataFrame([(k,) for k in keys], "key long")
    rows = exact_dedup.directory(entries, capacity=2, max_depth=4).orderBy("slot").collect()
    depth = {r["slot"]: r["local_depth"] for r in rows}
    assert len(rows) == 16 and depth[8] == 1 and depth[4] == 4 and depth[0] == 3


# ---- bit slices and SimHash --------------------------------------------------------------


@pytest.mark.parametrize("radius", [0, 2, 3, 7, 20])
def test_blocks_find_what_popcounts_find(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(5))])
    group = np.sort(rng.integers(0, 3, len(fps)))
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).astype(int)
    near = (apart <= radius) & (group[:, None] == group[None])
    got, want = bitslice.roots(fps, group, radius), np.arange(len(fps))
    for _ in range(len(fps)):
        want = np.array([want[near[i]].min() for i in range(len(fps))])
    assert (got == want).all()
    first = bitslice.nearest_earlier(fps, group, radius)
    for i in range(len(fps)):
        earlier = np.flatnonzero(near[i, :i])
        assert (first[i] >= 0) == bool(len(earlier)) and (first[i] < 0 or near[i, first[i]])


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, None)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_simhash_components_agree_with_brute_force(spark):
    long = prose(3, 800)
    texts = ODD + [long, long + " tail", long.replace("w5 ", "w6 ", 1), prose(4, 60), prose(4, 60).upper()]
    got = near_dedup.components_within(documents(spark, texts)).orderBy("doc_id").collect()
    fps = np.array([near_dedup.fingerprint_of(near_dedup.shingle_hashes(near_dedup.words_of(t), 3)) for t in texts], np.uint64)
    assert [r["fingerprint"] for r in got] == [f"{f:016x}" for f in fps.tolist()]
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    label = np.arange(len(texts))
    for _ in texts:
        label = np.array([label[near[i]].min() for i in range(len(texts))])
    assert [r["component_id"] for r in got] == label.tolist()


def test_large_groups_are_keyed_again_without_loss(spark):
    rng = np.random.default_rng(0)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ int(m) for m in rng.integers(0, 1 << 9, 300)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in graph.components(near_dedup.links(frame, 2, large=4)).collect()}
    assert len({roots.get(f, f) for f in fps}) == 1


def test_near_duplicates_are_found_and_others_left(spark):
    base = [prose(10 + i, 200) for i in range(8)]
    edited = [" ".join(w if j % 90 else "changed" for j, w in enumerate(t.split(), 1)) for t in base]
    other = [" ".join(t.split()[:100] + prose(50 + i, 100).split()) for i, t in enumerate(base)]
    docs = documents(spark, [*base, *edited, *other, "", None, base[0]])
    kept = {r["doc_id"] for r in near_dedup.drop_near_duplicates(docs).collect()}
    assert kept == {*range(8), *range(16, 26)}


def test_near_duplicates_within_families_that_are_just_below_the_similarity(spark):
    texts = []
    for f in range(6):
        base = prose(100 + f, 104, 10**6)  # 100 shingles, and as many more as the tail has words
        texts += [f"{base} {prose(1000 * f + i, 12 if i in (20, 40) else 14, 10**6)}" for i in range(42)]
    sets = [set(near_dedup.shingle_hashes(near_dedup.words_of(t), 5).tolist()) for t in texts]
    pairs = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert pairs == {(42 * f + 20, 42 * f + 40) for f in range(6)}
    got = {(r["component_id"], r["doc_id"]) for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert got == pairs


def test_earlier_hits_are_all_of_other_labels():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 4, dtype=np.uint64)[rng.integers(0, 4, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    group, label, done = np.sort(rng.integers(0, 3, 300)), rng.integers(0, 9, 300), np.zeros(300, np.int64)
    want = {(i, j) for i in range(300) for j in range(i) if group[i] == group[j] and label[i] != label[j] and int(fps[i] ^ fps[j]).bit_count() <= 2}
    got = []
    for most in (1, 3, 200):
        member, other, done = bitslice.earlier_hits(fps, group, 2, label, done, most)
        assert np.bincount(member).max() <= most
        got += zip(member.tolist(), other.tolist())
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("edits", [(2, 3), (2, 2), (1, 4)])
def test_near_duplicates_lose_no_pair_of_edited_copies(spark, edits):
    """Clusters of copies with edits here and there, whose similarities lie about the threshold; compared with all pairs."""
    rng = np.random.default_rng(sum(edits))
    texts = []
    for c in range(40):
        base = prose(500 + c, 240, 3000).split()
        for k in range(10):
            words = list(base)
            for at in rng.integers(0, 240, edits[k % 2]):
                words[at] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    sets = [set(near_dedup.shingle_hashes(near_dedup.words_of(t), 5).tolist()) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    label = np.arange(len(texts))
    for _ in range(20):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert len(pairs) > 300 and [got.get(i, i) for i in range(len(texts))] == label.tolist()


# ---- decontamination ---------------------------------------------------------------------


def brute_contaminations(texts, items, similarity=0.8, width=5):
    from collections import Counter

    out = {}
    for d, t in enumerate(texts):
        w = (t or "").translate(LOWER_TABLE).split()
        for i, item in items:
            v = (item or "").translate(LOWER_TABLE).split()
            if not v or not w:
                continue
            k, n = min(width, len(v)), len(v)
            grams = lambda x: Counter(" ".join(x[j : j + k]) for j in range(max(1, len(x) - k + 1)))  # noqa: B023, E731
            want = grams(v)
            for s in range(max(1, len(w) - n + 1)):
                own = grams(w[s : s + n])
                common = sum((want & own).values())
                score = common / (sum(want.values()) + sum(own.values()) - common)
                if score >= similarity - 1e-9 and score > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (round(score, 6), s)
    return out


def test_decontamination_agrees_with_brute_force(spark):
    items = [(i, prose(100 + i, n)) for i, n in enumerate([3, 5, 9, 40, 60])] + [(7, ""), (8, None)]
    passage = items[4][1].split()
    missing_word = passage[:30] + passage[31:]
    texts = ODD + [
        prose(5, 50) + " " + items[3][1].upper() + "\n" + prose(6, 30), prose(7, 20) + " " + " ".join(missing_word) + " " + prose(8, 70),
        items[0][1], "x " + items[1][1], " ".join(passage[:55]), " ".join(passage[:20]), items[2][1] + " " + items[2][1], prose(9, 300),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminations(documents(spark, texts), benchmark).collect()
    want = brute_contaminations(texts, items)
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in got} == want and len(want) >= 6
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(documents(spark, texts), benchmark).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}


def test_decontamination_finds_swapped_short_repeated_and_long_texts(spark):
    """Blocks in another order, texts shorter than an item, words that repeat without end, and very long texts."""
    sixty, nine = prose(31, 60).split(), prose(32, 9).split()
    items = [(1, " ".join(sixty)), (2, " ".join(nine)), (3, "ha " * 60), (4, "ho hum " * 20), (5, " ".join(sixty[:40] + prose(33, 20).split())), (1, prose(34, 12))]
    texts = [
        prose(35, 30) + " " + " ".join(sixty[30:] + sixty[:30]) + " " + prose(36, 9), " ".join(nine[:8]), " ".join(nine[:7]), "ha " * 1000, "hum " + "ho hum " * 30 + "ha " * 20,
        prose(37, 10_000) + " " + " ".join(sixty[:20] + ["new"] + sixty[20:]) + " " + prose(38, 10_000), " ".join(sixty[20:40] + sixty[:20] + sixty[40:]), " ".join(sixty[:50]),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontaminate.contaminations(documents(spark, texts), benchmark).collect():
        got[r["doc_id"], r["item_id"]] = max(got.get((r["doc_id"], r["item_id"]), (0, 0)), (r["similarity"], -r["start"]))
    want = {}
    for name, text in items:
        for (d, i), (score, start) in brute_contaminations(texts, [(name, text)]).items():
            want[d, i] = max(want.get((d, i), (0, 0)), (score, -start))
    assert got == want and {(0, 1), (1, 2), (3, 3), (5, 1)} <= set(want) and (2, 2) not in want


def test_decontamination_without_items_or_documents(spark):
    items = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert decontaminate.contaminations(documents(spark, ODD), items).count() == 0
    assert decontaminate.drop_contaminated(documents(spark, ODD), items).count() == len(ODD)
    real = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    assert decontaminate.contaminations(documents(spark, ODD).limit(0), real).count() == 0


# ---- toxicity ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for i in range(400):
        words = prose(1000 + i, 40).replace("w", "word").split()
        bad = i % 4 == 0
        if bad:
            words[3], words[20] = rng.choice(["stupid", "idiot", "moron"], 2)
        texts.append(" ".join(words))
        labels.append((i, None if i == 7 else int(bad)))
    return texts, labels


def test_toxicity_on_held_out_and_disguised_texts(spark, toxic_corpus):
    texts, labels = toxic_corpus
    disguised = ["word5 1d10t word9 stup1d", "word8 m0r0n word4 i d i o t word2", "word3 stuuuupid word1 idi0t."]
    docs = documents(spark, [*texts, *disguised, "", None])
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(docs, frame).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(400))
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.97
    assert [got[400 + i]["predicted"] for i in range(5)] == [1, 1, 1, 0, 0]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.drop_toxic(docs, frame)
    assert kept.columns == docs.columns and kept.where("doc_id >= 400").count() == 2


def letters_of(texts):
    """The language model of texts, counted plainly."""
    table = toxicity.class_table()
    n = toxicity.trigram_counts(texts, table).astype(float).reshape((toxicity.CLASSES,) * 3)
    pairs = n.sum(0) + 0.1
    return np.log((n + 5 * pairs / pairs.sum(1, keepdims=True)) / (n.sum(2, keepdims=True) + 5)).astype(np.float32)


def every_reading(decoder, word):
    """All paths through the word's lattice: what each reads as, and its score."""
    paths = [(0, "", 0.0)]
    while any(i < len(word) for i, _, _ in paths):
        paths = [(to, read + out, s - cost) for i, read, s in paths for to, out, cost in (decoder._steps(word, i, len(word) - i - len(word[i:].lstrip(word[i]))) if i < len(word) else [(i, "", 0.0)])]
    out = {}
    for _, read, s in paths:
        classes = [0, 0, *map(decoder._class, read), 0]
        s += sum(decoder.model[p][q][r] for p, q, r in zip(classes, classes[1:], classes[2:]))
        out[read] = max(out.get(read, -1e9), s)
    return out


def test_viterbi_search_agrees_with_all_paths():
    decoder = toxicity.Decoder(letters_of(["you idiot", "an ass is not stupid", "a toad sat", "the idiots said so", "less is more"] * 30))
    for word in ["1d10t", "a$$", "stuuupid", "y o u", "i d i o t", "a s s", "7h3", "l3ss!!!", "m.0.r.e", "(@t", "oooo", "x"]:
        every = every_reading(decoder, word)
        assert every[decoder.restore(word)] == pytest.approx(max(every.values()), abs=1e-3), word
    assert decoder.restore("y o u i d i o t") == "you idiot" and decoder.restore("a s s") == "ass"


def test_spaced_letters_are_read_and_columns_stay(spark, toxic_corpus):
    texts, labels = toxic_corpus
    spaced = ["word5 y o u i d i o t word9", "word8 m o r o n", "a b c word7 word1"]
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = documents(spark, [*(t.replace("idiot", "you idiot") for t in texts), *spaced]).withColumn("__score", F.lit(7)).withColumn("score", F.lit("x"))
    kept = toxicity.drop_toxic(docs, frame)
    assert kept.columns == docs.columns and kept.where("__score = 7 and score = 'x'").count() == kept.count()
    assert [r["doc_id"] for r in kept.where("doc_id >= 400").collect()] == [402]


def test_toxicity_without_labels_or_documents(spark, toxic_corpus):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(documents(spark, ODD), none).agg(F.max("predicted")).first()[0] == 0
    assert toxicity.scored(documents(spark, ODD).limit(0), none).count() == 0


# ---- short items and long words ------------------------------------------------------------


def test_short_items_whose_fingerprints_lie_far_off_are_found(spark):
    """Nine words and their first eight are at a similarity of exactly 0.8; fingerprints of 20 in 200,000 such pairs differ in over 24 bits."""
    nine = spark.range(200_000).select("id", F.transform(F.sequence(F.lit(0), F.lit(8)), lambda j: F.concat(F.lit("w"), F.pmod(F.xxhash64(j, F.col("id")), F.lit(10**9)).cast("string"))).alias("w"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 5), " ")))
    whole, part = (decontaminate._fingerprints(nine.withColumn("hs", runs(n)), ["id"], "hs") for n in (5, 4))
    far = whole.join(part.withColumnRenamed("fp", "other").drop("c"), "id").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) > 24).select("id")
    held = far.join(nine, "id").select("id", F.array_join("w", " ").alias("item"), F.array_join(F.slice("w", 1, 8), " ").alias("text")).collect()
    assert len(held) >= 10
    benchmark = spark.createDataFrame([(r["id"], r["item"]) for r in held], "item_id long, text string")
    docs = spark.createDataFrame([(r["id"], r["text"]) for r in held], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["similarity"]) for r in decontaminate.contaminations(docs, benchmark).collect()}
    assert got == {(r["id"], r["id"], 0.8) for r in held}


def test_long_words_take_time_in_proportion():
    import time

    decoder = toxicity.Decoder(letters_of(["you idiot", "an ass is not stupid", "a toad sat"] * 30))
    scorer = toxicity.Scorer(toxicity.Model(np.array(decoder.model), {}, 0.0, 0.0))
    n = 300_000
    for text in ("a" * n, "!" * n, "!" * n + "x", "@" * n + "x", "1" + "." * n + "a", " ".join("idiot" * (n // 5)), "a1" * (n // 2)):
        began = time.time()
        scorer.score(text)
        assert time.time() - began < 12, text[:10]
    assert decoder.restore("a" * 5000) == decoder.restore("a" * 16)
    assert len(decoder.restore("xyz" * 1000)) == 3000  # pieces are put together


def test_edges_and_addresses_are_told_as_before():
    sign, mark = re.compile(r"([$@+!(|])\1+$|!+$"), re.compile(r"@.+\.|://|^\W*\d[\d.,:+-]*\W*$")
    rng = random.Random(6)
    for _ in range(4000):
        word = "".join(rng.choice("ab1.@!$+-:/(|_") for _ in range(rng.randrange(9)))
        assert toxicity.core(word) == sign.sub("", word.strip(toxicity._EDGE)).strip(toxicity._EDGE), word
        assert toxicity.address(word) == bool(mark.search(word)), word


def test_near_duplicates_hold_few_texts_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(near_dedup, "HELD_BYTES", 1000)
    texts = ["x" * 400, None, "y" * 5000, "", *(["z" * 300] * 7)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    parts = list(near_dedup._few_texts([batch]))
    assert [i for ids, _ in parts for i in ids.to_pylist()] == list(range(len(texts)))
    assert [t for _, part in parts for t in part.to_pylist()] == texts
    assert all(len(part) == 1 or sum(len(t or "") for t in part.to_pylist()) <= 1000 for _, part in parts)


def test_texts_and_sets_of_near_dedup_reach_python_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    from threadmap.llm import common

    name, seen, own = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, near_dedup.save

    def save(df, tag):
        seen.setdefault(tag, set()).add(int(spark.conf.get(name)))
        return own(df, tag)

    monkeypatch.setattr(near_dedup, "save", save)
    before = spark.conf.get(name)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, "a b c d e f g"), (4, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(2, 1)}
    for tag in ("sketches", "shingle-sets", "verified"):
        assert max(seen[tag]) <= 500, tag  # 10,000 rows before, of which both sides held tens of MB in each task
    assert spark.conf.get(name) == before

    with common.small_batches(spark, rows=7):
        sizes = spark.range(100).mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) == 100 and max(r["n"] for r in sizes) <= 7


def test_bitmaps_rule_out_no_pair_at_the_similarity():
    rng = np.random.default_rng(8)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 3, 200, 257, 300, 512, 513, 5000, 20_000)]
    for base in list(sets):
        for share in (0.02, 0.1, 0.11, 0.12, 0.3):
            kept = base[int(share * len(base)) :]
            sets += [kept, np.r_[kept, rng.integers(0, 1 << 63, len(base) - len(kept), dtype=np.uint64)]]
    a, b = (v.ravel() for v in np.indices((len(sets), len(sets))))
    common = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)])
    n = np.array([len(s) for s in sets])
    similarity = common / (n[a] + n[b] - common)
    bits = [near_dedup.bitmap_of(s) for s in sets]
    assert len({len(v) for v in bits}) > 3
    for least in (0.8, 0.5, 0.2):
        fit = near_dedup.Fits(n, bits, least)(a, b)
        assert fit[similarity >= least].all()
        assert least < 0.8 or not fit[similarity < 0.75].any()


def test_near_dedup_writes_no_pairs_of_families_below_the_similarity(spark, monkeypatch):
    """Texts of a family share two thirds of their shingles: 44,850 pairs met before, of which each was verified."""
    base = prose(7, 204, 10**6)
    texts = [f"{base} {prose(2000 + i, 50, 10**6)}" for i in range(300)] + [f"{base} {prose(2000, 49, 10**6)}"]
    written, own = [], near_dedup.save

    def save(df, tag):
        out = own(df, tag)
        if tag == "near-pairs":
            written.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "save", save)
    got = {(r["component_id"], r["doc_id"]) for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert got == {(0, 300)} and sum(written) <= len(texts)


def test_near_dedup_compares_rows_without_id_and_texts_of_one_id(spark):
    base = [prose(3000 + i, 200, 10**6) for i in range(4)]
    near = [f"{t} tail{i}" for i, t in enumerate(base)]
    texts = [base[0], near[0], base[1], near[1], base[2], prose(3010, 200, 10**6), near[2], base[3], near[3], prose(3011, 200, 10**6), None, ""]
    ids = [None, None, None, 5, 7, 7, 6, 8, 8, None, None, 9]
    docs = documents(spark, texts, ids)
    kept = near_dedup.drop_near_duplicates(docs)
    left = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert kept.columns == docs.columns and kept.count() == len(left) == 8
    assert {(5, near[1]), (7, texts[5]), (6, near[2]), (None, texts[9]), (None, None), (9, "")} < left
    assert len(left & {(None, base[0]), (None, near[0])}) == len(left & {(8, base[3]), (8, near[3])}) == 1
    assert {tuple(r) for r in near_dedup.near_duplicates(docs).collect()} == {(7, 6)}


def test_near_dedup_compares_all_texts_of_ids_that_all_rows_share(spark):
    base = [prose(3100 + i, 200, 10**6) for i in range(6)]
    docs = documents(spark, [*base, *(f"{t} tail" for t in base)], [1] * 12)
    assert near_dedup.drop_near_duplicates(docs).count() == 6


def test_decontamination_drops_rows_by_their_own_texts(spark):
    passage = prose(3200, 40, 10**6)
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    texts = [f"before {passage} after", prose(3201, 60), None, f"{passage} x", prose(3202, 60)]
    left = decontaminate.drop_contaminated(documents(spark, texts, [None, None, None, 4, 4]), benchmark)
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == {(None, texts[1]), (None, None), (4, texts[4])}


def test_all_evidence_of_a_text_counts():
    counts = {f"=word{i}": (30, 0) for i in range(25_000)}
    assert len(toxicity._lexicon(counts, 1000, 100_000)) == 25_000
    scorer = toxicity.Scorer(toxicity.Model(letters_of(["a b"]), {f"=word{i}": 5.0 for i in range(40)}, -5.0, 0.05))
    assert scorer.score(" ".join(f"word{i}" for i in range(40))) > toxicity.THRESHOLD > 0.2 > scorer.score("word1")
