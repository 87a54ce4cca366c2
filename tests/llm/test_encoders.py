"""Tokenizers, token files, chats, archives, personal data, language-model scores."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from threadmap.llm import attention, bpe, chat, lm_score, pii, repair, token_files, warc
from threadmap.llm.common import LOWER_TABLE
from threadmap.llm.queries import CONTROL_TEXT, tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, words long, start long"
ODD = ["", None, " ", "a", " a ", "a  b", "a \n b", "Don't 'S", "É é Å İx ΟΔΟΣ", "x" * 3000, "12ab!!!", "<|endoftext|> a<|startoftext|>", "a\x1cb \x85c", "日本語 🎉👨‍👩‍👧", "a b", "the the the", "the the the"]


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def noise(seed, n=200):
    r = random.Random(seed)
    return ["".join(r.choice("abé1 .\n\t'<|!0") for _ in range(r.randrange(60))) for _ in range(n)]


# ---- BPE ---------------------------------------------------------------------------------


def test_bpe_agrees_with_the_library(spark):
    t, texts = library(WORD), ODD + noise(1)
    got = {r["doc_id"]: r for r in bpe.encoded(documents(spark, texts), WORD, decoded=True).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == t.decode(ids, skip_special_tokens=False) == bpe.decode(ids, WORD)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encoded(documents(spark, ODD).limit(0), WORD).count() == 0


def test_segment_tree_merges_leftmost_lowest_rank():
    m = bpe.Merges(BYTE)
    for piece in [b"aaaaaaa", b" thethethe", bytes(range(33, 127)), b"z", b""]:
        symbols = [m.tokens[m.first[c]] for c in piece]
        rank = {(k >> 32, k & 0xFFFFFFFF): r for k, r in zip(m.keys.tolist(), m.ranks.tolist())}
        while True:
            found = [(rank[p], i) for i, p in enumerate(zip([m.vocab[s] for s in symbols], [m.vocab[s] for s in symbols[1:]])) if p in rank]
            if not found:
                break
            _, i = min(found)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        assert m.encode_pieces([piece])[0].tolist() == [m.vocab[s] for s in symbols]
        if piece:
            assert m._merge_long(piece, max(2, 1 << (len(piece) - 1).bit_length())) == [m.vocab[s] for s in symbols]


# ---- token files -------------------------------------------------------------------------


def test_token_files_round_trip(spark):
    t, texts = library(BYTE), ODD + noise(2) + ["again and again " * 500]
    manifest = token_files.write(documents(spark, texts), BYTE)
    got = {r["doc_id"]: r for r in token_files.read(manifest, ids=True).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.read(token_files.write(documents(spark, ODD).limit(0), BYTE)).count() == 0


def test_token_files_of_null_and_repeated_ids(spark):
    rows = token_files.read(token_files.write(documents(spark, ["a", "b", "c"], [4, None, 4]), BYTE)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 4, 4] and [r["start"] for r in rows] == [0, 2, 4]


@pytest.mark.parametrize("seed", range(4))
def test_grammars_expand_to_what_they_compress(seed):
    rng = np.random.default_rng(seed)
    ids = rng.choice([0, 1, 1, 1, 2, 3, 9], 5000) if seed else np.array([5] * 1001)
    g = repair.compress(ids, 10, stop=0, least=4)
    assert len(g.left) and len(g.symbols) < len(ids) and (repair.expand(g) == ids).all() and 0 not in g.left
    left = Counter()
    last = {}
    for i, pair in enumerate(zip(g.symbols.tolist(), g.symbols[1:].tolist())):
        if pair[0] and last.get(pair) != i - 1:  # disjoint occurrences
            left[pair] += 1
            last[pair] = i
    assert max(left.values()) < 4  # no pair is frequent any more
    for a, b in [(0, 1), (17, 600), (len(ids) - 3, len(ids)), (8, 8)]:
        assert (repair.decode_range(g, a, b) == ids[a:b]).all()
    again, columns = repair.load(repair.dump(g, {"n": np.array([1, 2], "<i8")}))
    assert (again.symbols == g.symbols).all() and columns["n"].tolist() == [1, 2]


# ---- chats -------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, at long"


def chats():
    shared = [("system", "be kind"), ("user", "hello ### user: </turn>\n")]
    rows = []
    for c in range(12):
        own = shared[: c % 3] + [("user", f"question {c % 4}"), ("assistant", f"answer\\ {c} é🎉"), ("assistant", "")]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(own)]
    rows += [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT), (30, 5, None, None), (30, None, "odd:role", "first"), (None, 1, "user", "x"), (31, 0, "user", "r"), (31, 0, "user", "r")]
    return rows


def test_chats_read_back(spark):
    rows = chats()
    frame = spark.createDataFrame([(*r, 5) for r in rows], TURNS)
    manifest = chat.write(frame, BYTE)
    got = {r["conv_id"]: r for r in chat.read(manifest, BYTE).collect()}
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(chat.header(a) + chat.escape(b) + chat.END) for _, a, b in turns)
    assert chat.read(chat.write(frame.limit(0), BYTE), BYTE).count() == 0


def test_shared_turns_are_emitted_once_and_attend_to_their_ancestors(spark):
    import gzip
    import json

    frame = spark.createDataFrame([(*r, 5) for r in chats()], TURNS)
    nodes = shared = 0
    for m in chat.write(frame, BYTE).collect():
        lines = [json.loads(x) for x in gzip.open(m["path"].removeprefix("file://"))]
        tree = {x["node"]: x for x in lines if "ids" in x}
        at = 0
        for x in tree.values():
            path, p = [], x["parent"]
            while p >= 0:
                path.append(tree[p])
                p = tree[p]["parent"]
            covered = {i for a, b in x["attend"] for i in range(a, b)}
            assert covered == {i for y in path for i in range(y["start"], y["start"] + len(y["ids"]))}
            assert x["position"] == len(covered) and x["start"] == at
            at += len(x["ids"])
        keys = Counter((x["parent"], tuple(x["ids"])) for x in tree.values())
        assert max(keys.values()) == 1 or any(x["parent"] >= 0 for x in tree.values())
        nodes += len(tree)
        shared += sum(1 for x in lines if "end" in x)
    assert nodes < len(chats()) and shared == 16


def test_trees_of_random_conversations_share_every_turn_of_a_shard(spark):
    """Prefixes of others, equal ones, deep and wide forks: each node once, each path as it was, whatever the shards."""
    import gzip
    import json

    r = random.Random(3)
    talks = [[(r.choice(["user", "assistant"]), r.choice("xyz" if i % 3 else "x")) for _ in range(r.randrange(1, 9))] for i in range(250)]
    talks += [t[: r.randrange(1, len(t) + 1)] for t in talks[:60]]
    rows = [(c, i, *turn, 5) for c, t in enumerate(talks) for i, turn in enumerate(t)]
    manifest = chat.write(spark.createDataFrame(rows, TURNS), BYTE)
    seen = {}
    for m in manifest.collect():
        lines = [json.loads(x) for x in gzip.open(m["path"].removeprefix("file://"))]
        tree = {x["node"]: x for x in lines if "end" not in x}
        keys = Counter((x["parent"], tuple(x["ids"])) for x in tree.values())
        assert max(keys.values()) == 1
        for x in tree.values():
            above, p = set(), x["parent"]
            while p >= 0:
                above |= set(range(tree[p]["start"], tree[p]["start"] + len(tree[p]["ids"])))
                p = tree[p]["parent"]
            assert above == {i for a, b in x["attend"] for i in range(a, b)} and len(above) == x["position"]
        seen.update((x["end"], m["path"]) for x in lines if "end" in x)
    assert len(seen) == len(talks)
    got = {x["conv_id"]: x["turns_sha256"] for x in chat.read(manifest, BYTE).collect()}
    assert got == {c: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest() for c, t in enumerate(talks)}


def test_escapes_are_undone():
    for text in [CONTROL_TEXT, "\\", "\\\\###</turn>", "####", "</turn></turn>", "a\\\n"]:
        assert chat.unescape(chat.escape(text)) == text
        assert not re.search(r"(?<!\\)(\\\\)*(#|</turn>)", chat.escape(text))


# ---- WARC --------------------------------------------------------------------------------


def test_archives_read_back(spark):
    long = "é<p>" * 200_000
    pages = [(i, f"http://e/{i}\n x" if i % 2 else None, h) for i, h in enumerate(["a", "b", "a", None, "", long, "a", "c\r\n\r\nd", long])]
    frame = spark.createDataFrame([(*p, 1) for p in [*pages, (None, "u", "n"), (6, None, "a")]], "page_id long, url string, html string, kept long")
    rows = warc.read(warc.write(frame)).collect()
    assert len(rows) == 11
    largest = {}
    for i, _, h in pages:
        largest[h or ""] = max(i, largest.get(h or "", -1))
    for r in rows:
        if r["page_id"] is None:
            assert r["record_type"] == "response"
            continue
        h = pages[r["page_id"]][2] or ""
        keep = largest[h]
        assert r["payload_bytes"] == len(h.encode()) and r["payload_digest"] == warc.base32_sha1(h.encode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keep == r["page_id"] else ("revisit", keep))
        assert r["html"] == (h if keep == r["page_id"] else None)
    assert warc.read(warc.write(frame.limit(0))).count() == 0


def test_small_payloads_are_responses(spark):
    frame = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa")], "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.read(warc.write(frame, min_bytes=3)).collect()} == {"response"}


def test_broken_archives_are_refused():
    import io

    good = warc.record(1, "u", b"payload", None)
    assert list(warc.members(io.BytesIO(warc.member(good) + warc.member(good)))) == [good, good]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(warc.member(good)[:-9])))
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r", b"pAyload\r"))
    with pytest.raises(ValueError):
        warc.parse(good[:-1])


# ---- personal data -----------------------------------------------------------------------


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_agree_with_the_patterns():
    r = random.Random(0)
    texts = ["a@b.c@d.e f@g", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.999", "4539 1488 0343 6467", "+1 (743) 555-3824", "x" * 5000 + "@", "@a.b", "..@a-.b.c", "9" * 5000]
    texts += ["".join(r.choice("aZ.@-+ ()0123456789%_é") for _ in range(80)) for _ in range(400)]
    for t in texts:
        assert [s[:3] for s in pii.base_spans(t)] == brute_spans(t), t


def test_disclosing_terms_are_found_and_texts_sanitised(spark, monkeypatch):
    filler = [" ".join(f"word{chr(97 + (i * 7 + j) % 26)}{chr(97 + j % 26)}" for j in range(30)) + " common" for i in range(200)]
    secret = [f"{filler[i][:40]} zorblax {filler[i + 1][:30]} call +1 (743) 555-3824 common {filler[i + 2][:40]}" for i in range(6)]
    docs = documents(spark, [*filler, *secret, secret[0], "", None], [*range(208), None])
    found = pii.found(docs)
    told = {r["term"] for r in pii.disclosures(docs, found).collect()}
    assert "zorblax" in told and "common" not in told
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert all("zorblax" not in out[i] and "[PHONE]" in out[i] and "555" not in out[i] for i in range(200, 206))
    assert all(out[i] == filler[i] for i in range(200)) and out[207] == "" and out[None] == ""
    assert pii.sanitised(docs).count() == 209 and pii.sanitised(docs.limit(0)).count() == 0
    few = {r["doc_id"]: (r["text"], r["base"], r["all"]) for r in pii.sanitised(docs).collect()}
    monkeypatch.setattr(pii, "BROADCAST_TOLD", 0)  # more terms than that are joined, to the same end
    assert {r["doc_id"]: (r["text"], r["base"], r["all"]) for r in pii.sanitised(docs).collect()} == few


def test_contexts_agree_with_a_plain_search_and_are_linear():
    import time

    def plain(text, spans):
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        out = []
        for a, kind, b, value in spans:
            first = next((i for i, w in enumerate(words) if w[1] > a), len(words))
            last = next((i for i in range(first, len(words)) if words[i][0] >= b), len(words))
            for p, q in [*words[max(0, first - pii.CONTEXT_WORDS) : first], *words[last : last + pii.CONTEXT_WORDS]]:
                raw = text[p:q]
                p += len(raw) - len(raw.lstrip(pii._EDGE))
                q = p + len(raw.strip(pii._EDGE))
                if any(map(str.isalnum, pii.term_of(raw))) and not any(p < e and s < q for s, _, e, _ in spans):
                    out.append((f"{pii.KINDS[kind]}:{value}", pii.term_of(raw), p, q))
        return out

    r = random.Random(5)
    for _ in range(150):
        t = " ".join(r.choice(["a@b.c", "1.2.3.4", "+1 (743) 555-3824", "o'neil", "(word)", "...", "4539 1488 0343 6467", "x,a@b.c;y"]) for _ in range(30))
        assert pii.contexts(t, pii.base_spans(t)) == plain(t, pii.base_spans(t)), t
    long = " ".join(f"name{i} user{i}@example.org said {i % 9}" for i in range(20_000))
    began = time.time()
    assert len(pii.contexts(long, pii.base_spans(long))) > 200_000 and time.time() - began < 20


def test_copies_leave_shares_and_rare_entities_are_judged(spark):
    filler = [f"common {' '.join(f'w{i % 40}x{j}' for j in range(20))} {i}" for i in range(300)]
    often = [f"common quibble +1 (743) 555-3824 ask {i} common" for i in range(3)]
    once = ["common flat 7b of ostrander at jo@example.org common"]
    shares = []
    for copies in (0, 400):
        docs = documents(spark, [*filler, *often, *once, *[often[0]] * copies])
        shares.append({(r["entity"], r["term"]): round(r["share"], 9) for r in pii.disclosures(docs, pii.found(docs)).collect()})
    assert shares[0] == shares[1]
    assert shares[0]["phone:17435553824", "quibble"] == 1
    assert shares[0]["email:jo@example.org", "ostrander"] == 1 and shares[0]["email:jo@example.org", "7b"] == 1
    assert "common" not in {t for _, t in shares[0]}


# ---- language model ----------------------------------------------------------------------


def small_model():
    rng = np.random.default_rng(0)
    shape = attention.Shape(70, 20)
    follows, ends = rng.integers(0, 9, (71, 70)).astype(float), rng.integers(0, 9, 70).astype(float)
    follows[:70, :20] = follows[70, 20:] = 0
    w = {n: p + 0.2 * rng.standard_normal(p.shape).astype(np.float32) for n, p in attention.start_weights(shape, 1).items()}
    return attention.Model(shape, *attention.corpus_tables(shape, follows, ends), w), rng.integers(0, 70, 130), np.array([1, 60, 0 + 24, 45])


def test_each_id_is_scored_once_as_a_softmax_over_all_ids():
    model, ids, lengths = small_model()
    got, begins = model.score(ids, lengths)
    start, back = 70, attention.WINDOW - attention.STRIDE
    first = np.cumsum(lengths) - lengths
    for t, n in enumerate(lengths):
        own = ids[first[t] : first[t] + n]
        for i in range(n):
            j = i // attention.STRIDE * attention.STRIDE
            place = j - back + np.arange(attention.WINDOW)
            before = np.array([[own[p - 1] if 0 < p < n else start for p in place]])
            z, _ = attention._body(model.weights, before)
            row = np.repeat(z[0, i - j + back][None], 70, 0)
            every, begin = model.log_probabilities(row, np.full(70, before[0, i - j + back]), np.arange(70))
            assert got[first[t] + i] == pytest.approx(every[own[i]], abs=1e-4)
            assert begins[first[t] + i] == pytest.approx(begin[0], abs=1e-4)
            p = np.exp(every.astype(float))
            assert p[:20].sum() == pytest.approx(1, abs=1e-4)
            assert p[:20].sum() * np.exp(begin[0]) + p[20:].sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("context", [[], [[3, 40], [5]], [[1, 30, 31, 32]] * 9])
def test_masses_of_words_add_up_to_one_at_most(context):
    """All words of one, two or three ids after a context, and the end of the text."""
    model, _, _ = small_model()
    rest = range(20, 70)
    words = [[s] for s in range(19)] + [[s, o] for s in range(19) for o in rest] + [[2, o, p] for o in rest for p in rest]
    texts = [[*context, w, [19]] for w in words]
    per_token = np.array([len(x) for t in texts for x in t])
    p = lm_score.token_probabilities(model, np.array([i for t in texts for x in t for i in x]), per_token, np.array([len(t) for t in texts]))
    at = np.cumsum([len(t) for t in texts]) - 2
    end = lm_score.token_probabilities(model, np.array([i for x in [*context, [19]] for i in x]), np.array([len(x) for x in [*context, [19]]]), np.array([len(context) + 1]))[-1]
    assert 0.1 < p[at].sum() + end < 1 + 1e-5


def test_gradients_agree_with_differences():
    model, ids, _ = small_model()
    w, base = {n: p.astype(np.float64) for n, p in model.weights.items()}, model.base.astype(np.float64)
    before, targets = ids[:96].reshape(4, 24), model.cluster[ids[1:97]].reshape(4, 24)
    used = np.ones((4, 24), bool)
    used[0, 5] = False
    _, g = attention.gradients(w, base, before, targets, used)
    rng = np.random.default_rng(1)
    for n in w:
        at = tuple(rng.integers(0, s) for s in w[n].shape)
        if n == "embed":
            at = (int(before[1, 3]), at[1])
        old = w[n][at]
        values = []
        for step in (1e-4, -1e-4):
            w[n][at] = old + step
            values.append(attention.gradients(w, base, before, targets, used)[0])
        w[n][at] = old
        assert (values[0] - values[1]) / 2e-4 == pytest.approx(g[n][at], abs=2e-4), n


def test_training_windows_are_parts_of_the_texts(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate([0, 1, 7, 8, 9, 40, 100])] + [None]
    docs = documents(spark, texts).select("doc_id", "text")
    got = [np.frombuffer(r["w"], np.int16).tolist() for r in lm_score.windows_of(docs, BYTE, 1).collect()]
    ids = lm_score.Ids(BYTE)
    expected = []
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            words = [*(t or "").encode().split(), lm_score.END]
            for at in range(0, len(words), lm_score.WINDOW_WORDS):
                own = [] if at else [ids.shape.ids]
                own += ids._of_words(words[at : at + lm_score.WINDOW_WORDS])[0].tolist()
                own = (own + [-1] * attention.WINDOW)[: attention.WINDOW + 1]
                if own[1] >= 0:
                    expected.append(own)
    assert sorted(got) == sorted(expected)


def test_scores_agree_with_counts_and_learn(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "EVERY", 2)
    rng = np.random.default_rng(0)
    syllables = ["ba", "re", "ti", "on", "ka", "lu"]
    texts = [" ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(60)) for _ in range(120)] + ["", None, "É A a"]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in lm_score.scored(docs, BYTE).collect()}
    words = [[*(t or "").translate(LOWER_TABLE).split(), " "] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    total, distinct = sum(c.values()), len(c)
    for i, ws in enumerate(words):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (total + distinct + 1)) for w in ws))
        assert r["score"] < 0
    out = [i for i in range(120) if held[i]]
    # A vocabulary this small suits counts best.
    assert sum(got[i]["score"] for i in out) > 1.05 * sum(got[i]["base_score"] for i in out)
    assert lm_score.scored(docs.limit(0), BYTE).count() == 0
    monkeypatch.setattr(lm_score, "HEAD", 30)
    for r in lm_score.scored(docs, BYTE).collect():  # the counts that are joined change nothing
        assert r["score"] == pytest.approx(got[r["doc_id"]]["score"], abs=1e-4) and r["n_known"] == got[r["doc_id"]]["n_known"]


def test_scores_of_empty_tables_and_odd_columns(spark):
    odd = spark.createDataFrame([(1, "a b", "x", 3), (2, None, "y", 4), (None, "a b", "z", 5), (1, "a b", "x", 3)], "doc_id long, text string, word string, row long")
    got = lm_score.scored(odd, BYTE)
    assert sorted(r["n_tokens"] for r in got.collect()) == [1, 3, 3, 3]
    assert lm_score.scored(odd.limit(0), BYTE).count() == 0


def test_every_id_of_every_training_text_is_predicted_in_one_window(spark):
    texts = [" ".join(f"w{i}x{j}" * (1 + j % 9) for j in range(n)) for i, n in enumerate([0, 1, 7, 8, 9, 40, 100])] + [None]
    docs = documents(spark, texts).select("doc_id", "text")
    ids = lm_score.Ids(BYTE)
    assert lm_score.EVERY == 1
    got = [np.frombuffer(r["w"], np.int16).tolist() for r in lm_score.id_windows(docs, BYTE, lm_score.EVERY).collect()]
    expected = []
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            own = [ids.shape.ids, *ids._of_words([*(t or "").encode().split(), lm_score.END])[0].tolist()]
            windows = [own[at : at + attention.WINDOW + 1] for at in range(0, len(own) - 1, attention.WINDOW)]
            assert [x for w in windows for x in w[1:]] == own[1:]
            expected += [(w + [-1] * attention.WINDOW)[: attention.WINDOW + 1] for w in windows]
    assert sorted(got) == sorted(expected)


def test_all_windows_train_the_weights(spark):
    shape = lm_score.Ids(BYTE).shape
    rows = [(np.full(attention.WINDOW + 1, i, np.int16).tobytes(), i) for i in range(50)]
    base = np.zeros((shape.ids + 1, shape.clusters), np.float32)
    made = lm_score.trained(spark.createDataFrame(rows, "w binary, h long"), 50, shape, base, 3, 5)
    moved = np.abs(made["embed"] - attention.start_weights(shape)["embed"]).max(1) > 0
    assert moved[:50].all() and not moved[50:].any()
