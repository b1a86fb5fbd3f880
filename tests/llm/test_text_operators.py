"""Encoding, records, licences, secrets, language and toxicity against the library, brute force and plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlens.llm import bpe_automaton as B
from flowlens.llm import language_crf as L
from flowlens.llm import licenses as C
from flowlens.llm import records as R
from flowlens.llm import secret_scan as S
from flowlens.llm import toxicity as X
from flowlens.llm.common import utf8
from flowlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _text string, score string, ids int, spans int, _row int"
ODD = [
    (1, None, None, None, None, "x", "y", 1, 1, 1), (None, "", "en", "a", 0, None, None, None, None, None), (2, " \n ", "en", "a", 1, "x", "y", 1, 1, 1),
    (2, " \n ", "en", "a", 1, "x", "y", 1, 1, 1), (3, "the " * 30_000, "en", "a", 1, "x", "y", 1, 1, 1), (4, "ab" * 50_000, "en", None, 1, "x", "y", 1, 1, 1),
    (5, "token = abcdefgh0123 licensed under cc by", "en", "a", 1, "x", "y", 1, 1, 1),
]
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def encoder():
    return B.Encoder(B.load(WORD))


def same_as_library(encoder, texts):
    tokenizer = Tokenizer.from_file(WORD)
    ids, at, back = encoder.encode(texts)
    for i, (t, e) in enumerate(zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False))):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids, t
        assert back[i] == tokenizer.decode(e.ids, skip_special_tokens=False)


def test_bpe_equals_library(encoder):
    rng = random.Random(1)
    pool = "aeiothn'srveld  \n\t\"!.12éßΣİσ中́‍<|>endoftext"
    same_as_library(encoder, ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(800)])
    same_as_library(encoder, ["", "don't I'll he's 'sam ''s", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|startoftext|>", "ΣΑΣ Σ ǅ", "\U0001f600 हिन्दी 中文", "a" * 3000])


def test_bpe_every_character(encoder):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same_as_library(encoder, ["".join(points[i : i + 500]) for i in range(0, len(points), 500)])


def test_automaton_of_small_merges():
    """Every word over a small alphabet against merging by rank."""
    merges = [(0, 1, 2), (0, 0, 3), (2, 1, 4), (3, 2, 5), (1, 1, 6), (4, 6, 7)]
    a = B.compile_merges(8, merges)
    spelled = ["a", "b", "ab", "aa", "abb", "aaab", "bb", "abbbb"]

    def by_rank(word):
        seq = [spelled.index(c) for c in word]
        while True:
            found = [(r, i) for r, (u, v, _) in enumerate(merges) for i in range(len(seq) - 1) if (seq[i], seq[i + 1]) == (u, v)]
            if not found:
                return seq
            r, i = min(found)
            seq[i : i + 2] = [merges[r][2]]

    def by_paths(word, state=0):
        if not word:
            return [[]]
        return [[t, *rest] for t, s in enumerate(spelled) if a.target[t] >= 0 and word.startswith(s) and B.allowed(a, state, t) for rest in by_paths(word[len(s) :], a.target[t])]

    for n in range(1, 9):
        for k in range(2**n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert by_paths(word) == [by_rank(word)]


def test_transitions_equal_the_automaton(encoder):
    """The answers from spines against the states of the gadgets one by one, for pairs that rules join, that share a part, and at random."""
    a, r = encoder.a, encoder.transition
    reached = np.flatnonzero(np.array(a.target) >= 0)
    made = reached[r.rank[reached] >= 0]
    rng = np.random.default_rng(2)
    z, w = rng.choice(made, 3000), rng.choice(reached, 3000)
    x = np.concatenate((r.left[z], r.right[z], z, r.left[z], w))
    y = np.concatenate((r.right[z], z, r.left[z], z, rng.permutation(w)))
    want = np.array([B.allowed(a, a.target[u], v) for u, v in zip(x.tolist(), y.tolist())])
    assert 0.1 < want.mean() < 0.9
    assert (r.computed(x, y) == want).all() and (r(x, y) == want).all() and (r(x, y) == want).all()


@pytest.mark.parametrize("cells,lane", [(1 << 21, 128), (40, 6)])
def test_bpe_lanes_of_any_size(encoder, cells, lane, monkeypatch):
    monkeypatch.setattr(B, "CELLS", cells)
    monkeypatch.setattr(B, "LANE", lane)
    rng = random.Random(3)
    same_as_library(encoder, ["".join(rng.choice(["l", "ll", "he", "r", "ñ", "an", "ing", "  ", "1", "s", "'", "é"]) for _ in range(rng.randint(0, 90))) for _ in range(400)] + ["", "x" * 500])


def test_bpe_query_and_odd_rows(spark, odd):
    tokenizer = Tokenizer.from_file(WORD)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op4_bpe"](spark, SF).collect():
        ids = tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    out = B.encode_decode(odd, WORD)
    assert out.columns == [c for c in odd.columns if c != "ids"] + ["ids", "decoded"] and out.count() == len(ODD)
    assert B.encode_decode(odd.limit(0), WORD).count() == 0


def test_record_pieces_equal_library():
    rng = random.Random(3)
    pool = ["a", "the ", " ", "  ", "\n", " ", " ", "　", "\u0085", "\x1c", "'s", "'", "é", "中", "!", ",", "12", "<|endoftext|>", "<|", "x"]
    texts = ["", None] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(6000)]
    library = R.Library(BYTE)
    ids, at = library.encode(*utf8(pa.array(texts)))
    for i, e in enumerate(library.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids


def test_record_files(spark, odd, tmp_path):
    tokenizer = Tokenizer.from_file(BYTE)
    files = R.write_records(odd, BYTE, 2, folder=f"file://{tmp_path}/records")
    got = R.read_records(spark, files).orderBy("start").collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.id for r in got] == [r[0] for r in order]
    start = 0
    for r, row in zip(got, order):
        want = tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (start, len(want), want)
        start += len(want)
    one = files.orderBy("part").first()
    assert [x[1].tolist() for x in R.read_at(one.path, [one.records - 1, 0])][1] == np.frombuffer(got[0].ids, "<u4").tolist()
    path = one.path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        R.read_at(one.path, [0])
    assert R.read_records(spark, R.write_records(odd.limit(0), BYTE, 2)).count() == 0


def test_records_query(spark):
    tokenizer = Tokenizer.from_file(BYTE)
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op6_records"](spark, SF).collect()}
    start = 0
    for doc_id, text in docs:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_licenses(text):
    w, spots, half = WORDS.findall(lower(text)), set(), C.BLOCK // 2
    for label, phrase in C.PHRASES.items():
        p = phrase.split()
        spots |= {(i, i + len(p), label, 1.0, True) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p}
    for label, notice in C.NOTICES:
        t = set(WORDS.findall(lower(notice)))
        for b in range(-1, len(w) // half + 2):
            lo = b * half
            share = len(set(w[max(0, lo) : max(0, lo + C.BLOCK)]) & t) / len(t)
            if share >= C.THRESHOLD - 1e-9:
                spots.add((max(0, lo), min(lo + C.BLOCK, len(w)), label, share, False))
    return len(w), sorted(spots)


@pytest.mark.parametrize("piece", [C.PIECE, 300])
def test_licenses_equal_brute_force(spark, piece, monkeypatch):
    monkeypatch.setattr(C, "PIECE", piece)
    rng = random.Random(2)
    vocabulary = C.Index(C.PHRASES, C.NOTICES, C.THRESHOLD, C.BLOCK).vocabulary
    texts = [None, "", "é", "cc by", "CC  BY\ncc-by all rights reserved cc", "general public license" * 3]
    for _ in range(150):
        x: list[str] = []
        while len(x) < rng.choice([1, 5, 40, 200, 600]):
            r = rng.random()
            x += rng.choice(C.NOTICES)[1].split() if r < 0.1 else rng.choice(list(C.PHRASES.values())).split() if r < 0.13 else [rng.choice([*vocabulary, "ümlaut", "xyz", "Zed" * 9])]
        texts.append(rng.choice([" ", "\n", ", "]).join(x))
    got = {r.id: r for r in C.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, [tuple(s) for s in got[i].spots]) == brute_licenses(t or "")


def test_licenses_odd_rows_and_query(spark, odd):
    assert C.find_licenses(odd).count() == len(ODD) and C.find_licenses(odd.limit(0)).count() == 0
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op9_licenses"](spark, SF).collect():
        n, spots = brute_licenses(docs[r.doc_id])
        base = [s for s in spots if s[4]]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min([s[0] for s in base], default=None), max([s[0] for s in base], default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted({s[2] for s in base})), ",".join(sorted({s[2] for s in spots})))
        assert r.score == max([s[3] for s in spots], default=0.0)


def brute_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(S.ASSIGN, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    for m in re.finditer(S.CANDIDATE, t):
        c = m[0]
        if re.search(S.ALLOWED, c):
            continue
        path = re.match(S.PATH, c)
        allowed = set(range(path.end() if path else 0))
        for k in range(1, S.UNITS + 1):
            for q in range(len(c) - S.TIMES * k + 1):
                if c[q : q + S.TIMES * k] == c[q : q + k] * S.TIMES:
                    allowed |= set(range(q, q + S.TIMES * k))
        for word in S.WORDS:
            for q in range(len(c)):
                if c.startswith(word, q):
                    allowed |= set(range(q, q + len(word)))
        least, spans = next(b for p, b in S.LEAST_BITS if re.search(p, c)), []
        for i in range(len(c) - S.WINDOW + 1):
            w = c[i : i + S.WINDOW]
            if not allowed & set(range(i, i + S.WINDOW)) and -sum(w.count(x) / S.WINDOW * math.log2(w.count(x) / S.WINDOW) for x in set(w)) >= least - 1e-9:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + S.WINDOW
                else:
                    spans.append([i, i + S.WINDOW])
        out += [(m.start() + a, 3, m.start() + b) for a, b in spans]
    return sorted(out)


RANDOM = "9f8Kq2ZxL0pWv7RtYbN3mD5sHj1cGa"
BESIDE = ["-----" + RANDOM, "aws_path_xxxx" + RANDOM, RANDOM + "EXAMPLE", "/home/user/keys/9f8kq2zxl0pwv7rtybn3md5shj1cga", "AAAAAAAA" + RANDOM + "abcabcabcabcabc", RANDOM[:10] + "00000" + RANDOM[10:], RANDOM]


def test_secrets_beside_allowed_stretches(spark):
    """What an allowed stretch stands beside is still found, and nothing of the stretch is."""
    rows = spark.createDataFrame(list(enumerate(BESIDE)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 3] for r in S.find_secrets(rows).collect()}
    assert got[0] == [(5, 35)] and got[1] == [(13, 43)] and got[2] == [(0, 30)] and got[3] == [(16, 46)] and got[4] == [(8, 38)] and got[6] == [(0, 30)]
    assert got[5] == [(15, 35)]
    for i, t in enumerate(BESIDE):
        assert got[i] == [(a, b) for a, k, b in brute_secrets(t) if k == 3]


def test_secrets_equal_brute_force(spark):
    rng = random.Random(5)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    some = lambda s, n: "".join(rng.choice(s) for _ in range(n))

    def piece():
        r = rng.random()
        if r < 0.12:
            return rng.choice(["password", "PASSWD", "Secret", "api_key", "ApiKey"]) + rng.choice(["=", ": ", " = ", "\"=' ", "=="]) + some(b64 + "=.", rng.choice([1, 5, 6, 20, 40]))
        if r < 0.2:
            return "AKIA" + some(b64[:26] + "0123456789", rng.choice([3, 15, 16, 30]))
        if r < 0.3:
            return some("abcdef0123456789", rng.choice([5, 23, 24, 40, 300]))
        if r < 0.4:
            return some(b64, rng.choice([19, 20, 21, 44, 200])) + rng.choice(["", "=", "=="])
        if r < 0.43:
            return rng.choice(BESIDE)
        if r < 0.45:
            return rng.choice(["ab1" * 20, "123e4567-e89b-12d3-a456-426614174000", "/usr/local/share/lib/python3", "token=token:abcdefgh", "a" * 24 + "1b2c3d4e5f6g7h8i9j0k"])
        return rng.choice(["the", "é中\U0001f600", "ſecret=abcdefgh", "toKen=abcdefg", " ", "\n", "words", "=", ":"])

    texts = [None, "", "x"] + ["".join(piece() + rng.choice(["", " "]) for _ in range(rng.choice([1, 5, 30]))) for _ in range(250)]
    texts.append(" ".join("password=abc%06d" % i for i in range(700)))
    rows = S.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumn("clean", S.redacted(F.col("text"), F.col("spans"))).collect()
    for r in rows:
        t, want = texts[r.doc_id] or "", brute_secrets(texts[r.doc_id] or "")
        assert [(s.start, s.kind, s.end) for s in r.spans] == want
        parts, at = [], 0
        for a, _, b in want:
            if a > at or at == 0:
                parts += [t[at:a], "[SECRET]"]
            at = max(at, b)
        assert (r.clean or "") == "".join(parts) + t[at:]


def test_secrets_odd_rows(odd):
    out = S.find_secrets(odd)
    assert out.columns == [c for c in odd.columns if c != "spans"] + ["spans"] and out.count() == len(ODD)
    assert "op8_secrets" in ORACLES and S.find_secrets(odd.limit(0)).count() == 0


def test_forward_backward_equals_one_pass():
    rng = np.random.default_rng(0)
    for n, k in ((1, 3), (5, 3), (300, 4), (1000, 2)):
        score, move, begin = rng.normal(size=(n, k)) * 2, rng.normal(size=(k, k)), rng.normal(size=k)
        fresh = rng.random(n) < 0.1
        fresh[0] = True
        got, moved = L.forward_backward(score, move, begin, fresh, True)
        want, pairs, edges = np.zeros((n, k)), np.zeros((k, k)), [*np.flatnonzero(fresh), n]
        for a, z in zip(edges[:-1], edges[1:]):
            alpha = [np.exp(begin + score[a])]
            for i in range(a + 1, z):
                v = (alpha[-1] @ np.exp(move)) * np.exp(score[i])
                alpha.append(v / v.sum())
            beta = [np.ones(k)]
            for i in range(z - 1, a, -1):
                v = np.exp(move) @ (np.exp(score[i]) * beta[-1])
                beta.append(v / v.sum())
            beta = beta[::-1]
            for i in range(a, z):
                want[i] = alpha[i - a] * beta[i - a] / (alpha[i - a] * beta[i - a]).sum()
            for i in range(a + 1, z):
                x = alpha[i - 1 - a][:, None] * np.exp(move) * (np.exp(score[i]) * beta[i - a])[None]
                pairs += x / x.sum()
        assert np.allclose(got, want) and np.allclose(moved, pairs)


def test_labelled_sample_loses_no_row(spark):
    """All rows of a label that has no more than the bound; exactly the bound of any other, whatever repeats."""
    rows = [(i, "text %d" % i, "a" if i < 100 else "b" if i < 150 else "c") for i in range(5150)] + [(None, "none %d" % i, "d") for i in range(40)] + [(9000, "twice", "d")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    told = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    got = L.labelled_sample(docs, told, "doc_id", "text", 100)
    count = {k: sum(r.label == k for r in got) for k in "abcd"}
    assert count == {"a": 100, "b": 50, "c": 100, "d": 2}
    assert len({(r.label, r.id) for r in got}) == 252 and got == L.labelled_sample(docs, told, "doc_id", "text", 100)
    assert L.labelled_sample(docs.limit(0), told.limit(0), "doc_id", "text", 100) == []


def plain_marginals(model, text):
    """Letters' shares of a whole text from word scores and one unscaled pass in each direction."""
    w = L.features([text], model.lexicon)
    score = L.emissions(w, model.weights)
    n, k = score.shape
    alpha, beta = np.zeros((n, k)), np.zeros((n, k))
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
    alpha[0] = model.initial + score[0]
    for i in range(1, n):
        alpha[i] = score[i] + lse(alpha[i - 1][:, None] + model.transition, 0)
    for i in range(n - 2, -1, -1):
        beta[i] = lse(model.transition + (score[i + 1] + beta[i + 1])[None], 1)
    p = np.exp(alpha + beta - lse(alpha[-1], 0))
    return (p * w.letters[:, None]).sum(0) / w.letters.sum()


def test_language_query_recomputed(spark, monkeypatch):
    """Predictions and scores of the query from the learned model, text by text, without lanes, blocks or batches."""
    seen = []
    train = L.train
    from flowlens.llm import q_language

    monkeypatch.setattr(q_language, "train", lambda *a, **b: seen.append(train(*a, **b)) or seen[-1])
    got = {r.doc_id: r for r in q_language.op1_language(spark, SF).collect()}
    model = seen[0]
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        share = plain_marginals(model, r.text)
        assert got[r.doc_id].lang_pred == model.langs[int(share.argmax())] and got[r.doc_id].score == pytest.approx(float(share.max()), abs=1e-5)


def test_language_held_out(spark, odd):
    out = QUERIES["op1_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("right"), "score").collect()
    assert len(held) > 100 and np.mean([r.right for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in held)
    model = L.fit(["the cat and the dog\nof the", "der hund und die katze\nnicht der"] * 5, ["en", "de"] * 5)
    got = L.identify(odd, model, score="score", mixture="shares").collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if not (r.text or "").strip()} == {"und"}
    mixed = L.identify(spark.createDataFrame([("the cat and the dog und der hund und die katze",)], "text string"), model, mixture="shares").first()
    assert 0.2 < mixed.shares["de"] < 0.8
    assert L.identify(odd.limit(0), model).count() == 0
    nothing = L.fit([], [])
    assert {r.lang_pred for r in L.identify(odd, nothing).collect()} == {"und"}


def test_toxicity_query_recomputed(spark, monkeypatch):
    """Scores of the query from the learned dictionaries, each window compressed on its own by the plain interface."""
    import zstandard

    from flowlens.llm import q_toxicity

    seen = []
    train = X.train
    monkeypatch.setattr(q_toxicity, "train", lambda *a, **b: seen.append(train(*a, **b)) or seen[-1])
    got = {r.doc_id: r for r in q_toxicity.op3_toxicity(spark, SF).collect()}
    m = seen[0]

    def length(window, content):
        p = zstandard.ZstdCompressionParameters.from_level(3, dict_size=len(content), source_size=X.WINDOW, min_match=X.MATCH, strategy=zstandard.STRATEGY_FAST, write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(compression_params=p, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(window))

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for r in docs[:60]:
        parts = X.windows((r.text or "").encode())
        assert b"".join(parts) == re.sub(rb"[A-Z]", lambda c: c[0].lower(), (r.text or "").encode())
        gain = [length(w, m.ordinary) - length(w, m.ordinary + m.toxic) for w in parts] if m.ordinary and m.toxic else []
        if gain:
            top = sorted((max(g, 0) for g in gain), reverse=True)[:3]
            over = [sum(g >= t for g in gain) for t in X.GAINS]
            x = [*top, *[0] * (3 - len(top)), sum(gain) / len(gain), *np.log1p(over), *[o / len(gain) for o in over]]
        else:
            x = [0.0] * (4 + 2 * len(X.GAINS))
        z = ((np.array(x) - m.mean) / m.scale) @ m.weights[:-1] + m.weights[-1]
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def test_toxicity_held_out(spark, odd):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op3_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").toPandas()
    assert held.predicted[held.toxic == 0].mean() < 0.03
    english = held[(held.toxic == 1) & (held.lang == "en")]
    assert english.predicted.mean() > 0.45 and held.score.between(0, 1).all()
    order = held.score.rank()
    n1, n0 = (held.toxic == 1).sum(), (held.toxic == 0).sum()
    assert (order[held.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.85
    model = X.fit([b"plain words of ordinary text " * 20, b"other lines without any harm " * 20] * 10 + [b"plain words of a vilething text " * 9, b"a vilething without other lines " * 9] * 10, [0] * 20 + [1] * 20, 0.5)
    got = X.toxicity(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.toxicity <= 1 for r in got)
    assert X.toxicity(odd, X.fit([], [], 0.0)).count() == len(ODD) and X.toxicity(odd.limit(0), model).count() == 0


def test_toxicity_ranks_with_few_labels(spark):
    """Six toxic texts to learn from: texts with the words that they repeat stand above the others, none is scored alike for want of a dictionary."""
    sf = "/root/testdata/sf0.001"
    held = QUERIES["op3_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    order, n1, n0 = held.score.rank(), (held.toxic == 1).sum(), (held.toxic == 0).sum()
    assert (order[held.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.7


def test_toxicity_learns_beginnings_of_words():
    """The toxic words share their beginning only; as whole words each stands in one text."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(40)).encode() for _ in range(60)]
    texts += [" ".join([word() for _ in range(20)] + ["vilethi" + word() for _ in range(3)] + [word() for _ in range(20)]).encode() for _ in range(30)]
    model = X.fit(texts, [0] * 60 + [1] * 30, 0.3)
    meter = X.Meter(model.ordinary, model.toxic)
    calm, toxic = " ".join(word() for _ in range(40)), " ".join([word() for _ in range(38)] + ["vilethi" + word()])
    assert b" vilethi" in model.toxic and X.score(model, meter, toxic.encode()) > X.score(model, meter, calm.encode())
