"""SimHash groups against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from flowlens.llm import simhash as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def brute_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("piece", [S.PIECE, 20])
def test_fingerprints(piece, monkeypatch):
    monkeypatch.setattr(S, "PIECE", piece)
    rng = random.Random(1)
    words = ["The", "a", "é", "中文", "x1", "\x1c", " ", "ÀB", "zz"]
    texts = ["", " \n\t", "one", "one two", "a b c", None] + ["".join(rng.choice(words) + rng.choice([" ", "\n", "  \r"]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    for t in texts:
        for n in (1, 3, 5):
            assert S.fingerprint_of(t and t.encode(), n) & (2**64 - 1) == brute_fingerprint(t, n)


@pytest.mark.parametrize("tree,held", [(50_000, 200_000), (3, 200_000), (3, 10)])
def test_links_equal_brute_force(spark, tree, held, monkeypatch):
    monkeypatch.setattr(S, "HELD", held)
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    want = brute_components(fps, 3)
    rows = spark.createDataFrame([(i, S._signed(x)) for i, x in enumerate(fps)], "lead long, fp long")
    got = {r.fp: r.lead for r in S.groups(rows, "lead", 3, 5, tree).collect()}
    assert [got[S._signed(x)] for x in fps] == want


def test_components_of_texts(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [
        (3, base, "en", "a", 1), (7, base, None, None, None), (5, base.upper().lower(), "en", "b", 1), (9, None, None, None, None),
        (8, "", "en", "a", 0), (None, base, "en", "a", 1), (7, base, None, None, None), (2, "nothing like it at all here", "en", "a", 1),
    ]
    got = sorted((str(r.id), r.component_id) for r in S.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=3).collect())
    assert got == sorted([("3", 3), ("7", 3), ("7", 3), ("5", 3), ("None", 3), ("9", 8), ("8", 8), ("2", 2)])
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_similar_texts(spark):
    rng = random.Random(3)
    rows, family = [], {}
    for f in range(12):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
        for c in range(6):
            own = list(words)
            if c:
                own[rng.randint(0, 299)] = f"other{c}"
            i = f * 6 + c
            family[i] = f * 6
            rows.append((i, " ".join(own)))
    rows += [(1000, None), (1001, "  "), (1002, "just two")]
    got = dict((r.lead, r.first) for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect())
    assert all(got[i] == f for i, f in family.items())
    assert got[1000] == got[1001] == 1000 and got[1002] == 1002


def brute_similar(texts, similarity=0.8, n=5):
    """The smallest position of every text's component over exact Jaccard similarities of shingle sets."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in words]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def similar(spark, texts, parts=3):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    got = dict((r.lead, r.first) for r in S.similar_groups(rows, "doc_id").collect())
    return [got[i] for i in range(len(texts))]


def test_similar_chain(spark):
    rng, texts = random.Random(5), []
    for length in (1300, 300):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(150)]
        for _ in range(length):
            words[rng.randint(0, 149)] = f"w{rng.randint(0, 10**9)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    want = brute_similar(texts)
    assert len(set(want)) == 2
    assert similar(spark, texts) == want


def test_every_row_of_a_shard_searches(spark, monkeypatch):
    """One shard; the link between two large groups joins two rows that earlier rows have linked."""
    same = {"x": [1] * 63, "b": [1] * 32 + [2] * 31, "c": [3] * 32 + [2] * 31, "y": [3] * 32 + [4] * 31}
    kinds: dict[int, str] = {}
    monkeypatch.setattr(S, "band_of", lambda similarity: 65)
    monkeypatch.setattr(S, "sketch_of", lambda hashes: np.array([0] * 65 + same[kinds[int(hashes[0][0])]], np.uint32))
    rng = random.Random(8)

    def changed(words, places):
        new = {at: f"w{rng.randint(0, 10**9)}" for at in places}
        return [new.get(at, w) for at, w in enumerate(words)]

    signs: list[bool] = []
    while signs != [True, False, False, True]:  # b and c come last in the order of fingerprints
        x = changed([""] * 300, range(300))
        b = changed(x, [0, *range(10, 260, 50)])
        c = changed(b, [0, *range(20, 270, 50)])
        y = changed(c, [0, *range(30, 280, 50)])
        signs = [S.fingerprint_of(" ".join(w).encode(), 5) < 0 for w in (x, b, c, y)]
    texts = []
    for name, words, count in (("x", x, 300), ("b", b, 1), ("c", c, 1), ("y", y, 300)):
        kinds[int(next(S.shingle_hashes(" ".join(words).encode(), 5))[0])] = name
        texts += [" ".join(words)] + [" ".join(changed(words, [285 + i % 10])) for i in range(count - 1)]
    want = brute_similar(texts)
    assert set(want) == {0}
    assert similar(spark, texts) == want


def test_similar_by_sets_not_counts(spark):
    rng, texts = random.Random(6), []
    for _ in range(40):
        lines = [" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(10)) for _ in range(20)]
        texts += ["\n".join(lines[:8] + lines[8:10] * n + lines[10:]) for n in (1, 60)]
    assert similar(spark, texts) == brute_similar(texts) == [i - i % 2 for i in range(80)]


def test_similar_near_the_threshold(spark):
    rng, texts = random.Random(7), []
    for f in range(60):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(300)]
        texts.append(" ".join(words))
        for changed in (3, 5, 6, 7, 8, 10, 12)[f % 7 :][: 1 + f % 3]:
            own = list(words)
            for at in range(7, 300, 23)[:changed]:
                own[at] = f"w{rng.randint(0, 10**9)}"
            texts.append(" ".join(own))
    want = brute_similar(texts)
    assert 60 < len(set(want)) < len(texts) - 20
    assert similar(spark, texts) == want


def test_bands_follow_the_similarity(spark):
    assert S.band_of(0.8) == 5
    for similarity in (0.3, 0.5, 0.65, 0.9, 1.0):
        band = S.band_of(similarity)
        assert (1 - similarity**band) ** (S.SKETCH // band) <= S.MISSED
    with pytest.raises(ValueError):
        S.band_of(0.01)
    rng, texts = random.Random(9), []
    for f in range(25):  # pairs at about one half
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(200)]
        own = [f"w{rng.randint(0, 10**9)}" if i % 24 == 3 else w for i, w in enumerate(words)][: 190 if f % 2 else 200]
        texts += [" ".join(words), " ".join(own)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict((r.lead, r.first) for r in S.similar_groups(rows, "doc_id", similarity=0.5).collect())
    assert [got[i] for i in range(len(texts))] == brute_similar(texts, 0.5)


@pytest.mark.parametrize("held", [S.HELD_SHINGLES, 900])
def test_undecided_rows_send_no_pairs(spark, monkeypatch, held):
    """A group whose members are 0.7 alike, with some links among them: many candidates, few links, no row per pair."""
    monkeypatch.setattr(S, "HELD_SHINGLES", held)
    rng = random.Random(10)
    words = [f"w{rng.randint(0, 10**9)}" for _ in range(250)]
    texts = []
    for i in range(160):
        own = list(words)
        for at in rng.sample(range(0, 250, 6), 8):
            own[at] = f"w{rng.randint(0, 10**9)}"
        texts.append(" ".join(own))
        if i % 4 == 0:
            own[rng.randint(0, 249)] = "changed"
            texts.append(" ".join(own))
    want = brute_similar(texts)
    assert 20 < len(set(want)) < len(texts)
    assert similar(spark, texts) == want
    shingles = [S.shingle_set(list(S.shingle_hashes(t.encode(), 5))).view(np.int64) for t in texts]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array([S.sketch_of([s.view(np.uint64)]).tobytes() for s in shingles]), pa.array(shingles, pa.list_(pa.int64()))], names=["label", "sketch", "shingles"],
    )
    sent = S.Undecided(batch, 0.8, 0.66).found()
    assert sent.num_rows == len(texts) - len(set(want))


def test_forest_finds_all():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**63, 500, dtype=np.uint64) & np.uint64(0xFFF0F)
    fps = np.unique(fps)
    forest = S.Forest(np.zeros(len(fps), np.int64), fps)
    found = {(q, n) for a, b in forest.search(fps, np.full(len(fps), forest.first[0]), 2) for q, n in zip(a.tolist(), b.tolist())}
    assert found == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}
