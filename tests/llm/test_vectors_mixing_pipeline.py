"""Vector operators and the mixture against brute force; the pipeline stage by stage."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm.kmeans_tree import nearest
from flowlens.llm.mixing import mix
from flowlens.llm.pq_dedup import near_vectors
from flowlens.llm.queries import ORACLES, QUERIES

VEC = "vec_id long, embedding array<float>, label int, score string, list int"


def vectors(seed=1, groups=25, each=12, dim=16):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for _ in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(each):
            rows.append((i, (centre + rng.normal(size=dim) * rng.choice([0.0, 0.02, 0.2])).astype(np.float32).tolist(), int(rng.integers(0, 2)), "s", 1))
            i += 1
    odd = [
        (i, None, 0, "s", 1), (i + 1, [0.0] * dim, 0, "s", 1), (i + 2, [math.nan] + [1.0] * (dim - 1), 0, "s", 1), (i + 3, [None] + [1.0] * (dim - 1), 0, "s", 1),
        (i + 4, [math.inf] + [1.0] * (dim - 1), 0, None, None), (i + 5, rows[0][1], None, "s", 1), (i + 6, [1.0], 0, "s", 1), (None, rows[0][1], 0, "s", 1),
        (i + 7, rows[0][1], rows[0][2], "s", 1), (i + 7, rows[0][1], rows[0][2], "s", 1),
    ]
    return rows + odd, dim


def good(r, dim):
    v = r[1]
    return r[0] is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("list_size,block", [(4096, 4096), (10, 4096), (20, 7)])
def test_near_vectors_equal_brute_force(spark, list_size, block):
    rows, dim = vectors()
    got = near_vectors(spark.createDataFrame(rows, VEC), list_size=list_size, block=block).collect()
    x = {k: np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) for k, r in enumerate(rows) if good(r, dim) and r[2] is not None}
    parent = {k: k for k in x}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = Counter()
    for a in x:
        for b in x:
            if a < b and rows[a][2] == rows[b][2] and x[a] @ x[b] >= 0.98:
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k in x:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    want = Counter()
    for k, r in enumerate(rows):
        component = least[find(k)] if k in x else r[0]
        want[(r[0], links[k], component, None if r[0] is None else r[0] == component)] += 1
    assert Counter((r.id, r.n_links, r.component_id, r.kept) for r in got) == want
    assert near_vectors(spark.createDataFrame([], VEC)).count() == 0


def test_near_vectors_query(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(ORACLES["op7_pq_dedup"]).fetchall()
    assert sorted(map(tuple, QUERIES["op7_pq_dedup"](spark, sf).collect())) == sorted(want)


@pytest.mark.parametrize("leaf,block", [(10, 16_384), (10, 15), (10_000, 16_384)])
def test_nearest_recall_and_scores(spark, leaf, block):
    rows, dim = vectors(2)
    rows += [(10_000 + i, rows[3][1], 0, "s", 1) for i in range(60)]  # a vector that many rows share
    got = nearest(spark.createDataFrame(rows, VEC), F.col("id") % 20 == 0, leaf=leaf, block=block, calibration=16).collect()
    x = {k: np.array(r[1], float) for k, r in enumerate(rows) if good(r, dim)}
    by, hits, total = {}, 0, 0
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    queries = [k for k in x if rows[k][0] % 20 == 0]
    assert set(by) == {rows[k][0] for k in queries}
    for k in queries:
        true = sorted(((-float(x[k] @ v), rows[j][0]) for j, v in x.items() if rows[j][0] != rows[k][0]))[:20]
        mine = sorted(by[rows[k][0]], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(any(abs(float(x[k] @ v) - r.score) < 1e-12 for j, v in x.items() if rows[j][0] == r.vec_id) for r in mine)
        hits, total = hits + len({r.vec_id for r in mine} & {i for _, i in true}), total + 20
    assert hits / total >= 0.9
    few = nearest(spark.createDataFrame(rows[:5], VEC), F.col("id") == 0).collect()
    assert len(few) == 4 and nearest(spark.createDataFrame([], VEC), F.col("id") == 0).count() == 0


def test_nearest_of_repeated_queries(spark):
    """An id asks once: repeated rows bring no answer twice, and of two vectors the lesser one is asked."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (0, x[0].tolist()), (20, x[3].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in sorted(nearest(table, F.col("id") % 20 == 0, leaf=8, recall=1.0).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    asked = {0: x[0], 20: min(x[3], x[20], key=lambda v: v.tolist()), 40: x[40]}
    assert got.keys() == asked.keys()
    for q, v in asked.items():
        scores = sorted((-float(np.float64(v) @ np.float64(w)), i) for i, w in rows if i != q)
        assert [i for _, i in got[q]] == [i for _, i in scores[:20]] and [k for k, _ in got[q]] == list(range(1, 21))


def test_nearest_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.values
    got = QUERIES["op10_ann"](spark, sf).toPandas().groupby("query_id").vec_id.apply(set)
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        recall.append(len(set(ids[np.lexsort((ids, -s))[:20]]) & got[ids[i]]) / 20)
    assert np.mean(recall) >= 0.9


DOC = "doc_id long, text string, lang string, source string, n_chars int"


def test_mixture(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), "en", rng.choice(["a", "b", "b", "b", "é", None]), 1) for i in range(300)]
    rows += [(400, None, "en", "z", 1), (401, "", "en", "z", 1), (None, "one two", "en", "a", 1), (None, "one two", "en", "a", 1), (5, rows[5][1], "en", rows[5][3], 1)]
    got = mix(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == len(rows)
    total, per = Counter(), {}
    for r in got:
        total[r.source] += r.taken
        per[r.source] = (r.source_size, r.target)
        assert 0 <= r.taken <= 3 * r.size
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight, open_, target, left = {s: i % 3 + 1 for i, s in enumerate(names)}, set(names), {}, sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= over
    for s in names:
        assert per[s][0] == sizes[s] and per[s][1] == pytest.approx(target[s]) and abs(total[s] - target[s]) <= 2
    again = mix(spark.createDataFrame(rows[::-1], DOC).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.parametrize("name", ["op2_mixing", "op8_secrets"])
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(ORACLES[name]).fetchdf()
    got = QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)


WIDE = DOC + ", _text string, size int, spans int, lang_pred string, ids int, lead int, copies int, target double"


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(6)
    sentence = lambda lang: " ".join(rng.choice({"en": ["the", "and", "house", "water", "thing"], "de": ["der", "und", "wasser", "haus", "nicht"]}[lang]) + str(rng.randint(0, 99)) * 0 + rng.choice(["ing", "er", "ung", ""]) for _ in range(60))
    more = ("x", 1, 2, "zz", 3, 4, 5, 6.0)
    rows = [(i, sentence(lang := rng.choice(["en", "de"])), lang, rng.choice(["a", "b", "b"]), 300, *more) for i in range(80)]
    copy = rows[7][1]
    rows += [(100 + i, copy, "en", "b", 300, *more) for i in range(5)] + [(100, copy, "en", "b", 300, *more)]
    rows += [(200, None, None, None, None, *[None] * 8), (201, "", "en", "a", 0, *more), (202, "12 !!", "en", "a", 5, *more), (None, sentence("en"), None, None, None, *more)]
    rows += [(203, sentence("en") + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "en", "a", 400, *more)]
    docs = spark.createDataFrame(rows, WIDE).repartition(3)
    outs = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, "")
        if name != "encoding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outs[name] = docs.collect()
    ids = lambda name: sorted((r.doc_id for r in outs[name]), key=lambda x: (x is None, x))
    assert ids("language") == sorted([*range(80), *range(100, 105), 100, 203]) + [None]
    assert ids("near_copies") == [*range(80), 203, None]
    clean = {r.doc_id: r for r in outs["secrets"]}
    assert "24be64439e" not in clean[203].text and "[SECRET]" in clean[203].text and clean[203].n_chars == len(clean[203].text)
    before = {r.doc_id: r for r in outs["near_copies"]}
    assert all(clean[i] == before[i] for i in before if i != 203)
    taken = Counter(r.doc_id for r in outs["mixture"])
    assert set(taken) <= set(clean) and max(taken.values()) <= 3
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(words(r.text) for r in outs["secrets"])
    assert abs(sum(words(r.text) for r in outs["mixture"]) - total) < 0.2 * total
    assert Counter(r.doc_id for r in outs["encoding"]) == taken and all(r.ids and r.decoded for r in outs["encoding"])
    empty = spark.createDataFrame([], WIDE)
    for _, stage in P.STAGES:
        assert stage(spark, empty, "").count() == 0
    unlabelled = P.language(spark, spark.createDataFrame([(1, "a b", None, None, None), (2, "1", None, None, None)], DOC), "")
    assert [r.doc_id for r in unlabelled.collect()] == [1]


def test_pipeline_run(spark):
    import corpus_pipeline as P

    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "lang", "source", "ids", "decoded"] and 100 < out.count() < 400


def test_near_copies_links_fingerprints_and_sets(spark):
    """Long repetition with other tails: fingerprints differ in few bits, shingle sets are not similar. Both kinds of links make one group."""
    import corpus_pipeline as P
    from flowlens.llm.simhash import fingerprint_of, shingle_hashes, shingle_set

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    line = " ".join(word() for _ in range(7))
    tail = lambda n: " ".join(word() for _ in range(n))
    one, two = (" ".join([line] * 60) + " " + tail(40) for _ in range(2))
    like_two = two + " " + tail(5)
    alone = [tail(50) for _ in range(6)]
    sets = [set(shingle_set(list(shingle_hashes(t.encode(), 5))).tolist()) for t in (one, two, like_two)]
    jaccard = lambda x, y: len(x & y) / len(x | y)
    assert jaccard(sets[0], sets[1]) < 0.5 and jaccard(sets[1], sets[2]) >= 0.8
    bits = lambda x, y: bin((fingerprint_of(x.encode(), 3) ^ fingerprint_of(y.encode(), 3)) & (2**64 - 1)).count("1")
    assert bits(one, two) <= 3
    rows = [(5, one, "en", "a", 1), (3, two, "en", "a", 1), (9, like_two, "en", "a", 1), (None, one, "en", "a", 1)] + [(20 + i, t, "en", "a", 1) for i, t in enumerate(alone)]
    out = P.near_copies(spark, spark.createDataFrame(rows, DOC), "")
    assert sorted(r.doc_id for r in out.collect()) == [3, *range(20, 26)]
