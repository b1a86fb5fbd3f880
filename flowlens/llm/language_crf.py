"""Language of text by a linear-chain conditional random field over words."""

from __future__ import annotations

import unicodedata
from collections import namedtuple
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import packed, unpacked
from flowlens.tables import cut

#: Labelled rows that a language is learned from, at most; words of the lexicon; rounds of fitting and their rate.
PER_LANGUAGE, LEXICON, ROUNDS, RATE = 100, 20_000, 30, 1.0
#: Orders of the n-grams (with both word ends marked, so that the ones at an end are affixes), bits of their tables.
ORDERS, BITS = (2, 3, 4), 16
#: Characters worked on at once, and chains that run side by side.
BLOCK, LANES = 1 << 18, 1024

UNKNOWN = "und"
Model = namedtuple("Model", "langs weights lexicon transition initial")
Words = namedtuple("Words", "slots start lexical letters text")


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """1 for letters, 2 for marks that stand on them; no letter has a number of 0x32000 or more."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x32000)]
    return np.array([1 if k == "L" else 2 if k == "M" else 0 for k in kinds], np.uint8)


def features(texts: list[str], lexicon: np.ndarray) -> Words:
    """Words of the texts, with the table rows of their n-grams (0: none), the row of their lexicon entry (-1: none), letters, and text.

    A word is a run of letters and the marks on them. ``slots`` has a row per order and a column per place of the words, each
    word with a mark before and one behind; ``start`` is where a word begins there.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = letter_table()[np.minimum(points, 0x31FFF)] * (points < 0x32000)
    inside = kind > 0
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with_letter = np.add.reduceat((kind == 1).astype(np.int64), begin) > 0 if len(begin) else np.zeros(0, bool)
    if not with_letter.all():
        for a, b in zip(begin[~with_letter].tolist(), end[~with_letter].tolist()):
            inside[a:b] = False
        begin, end = begin[with_letter], end[with_letter]
    size = end - begin
    start = np.cumsum(size + 2) - size - 2
    n = int((size + 2).sum())
    code = np.empty(n, np.uint32)
    is_char = np.ones(n, bool)
    is_char[start] = is_char[start + size + 1] = False
    code[start], code[start + size + 1] = 1, 2
    code[is_char] = points[inside]
    slots = np.zeros((len(ORDERS), n), np.int32)
    h = code * np.uint32(2654435761)
    crosses = np.zeros(n, bool)
    for step in range(1, max(ORDERS)):
        length = n - step
        if length <= 0:
            break
        h = (h[:length] ^ (h[:length] >> np.uint32(15))) * np.uint32(2246822519) + code[step:] * np.uint32(3266489917)
        crosses = crosses[:length] | (code[step - 1 : step - 1 + length] == 2)
        if step + 1 in ORDERS:
            o = ORDERS.index(step + 1)
            slots[o, :length] = np.where(crosses, 0, (h >> np.uint32(32 - BITS)).astype(np.int32) + 1 + (o << BITS))
    place = np.arange(n) - np.repeat(start, size + 2)
    power = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
    hashed = np.add.reduceat((code.astype(np.uint64) + np.uint64(77)) * power[place & 4095], start) if len(start) else np.zeros(0, np.uint64)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, hashed), len(lexicon) - 1)
        lexical = np.where(lexicon[at] == hashed, at, -1)
    else:
        lexical = np.full(len(hashed), -1)
    lengths = np.cumsum([len(t) + 1 for t in lowered])
    return Words(slots, start, (lexical, hashed), size, np.searchsorted(lengths, begin, "right"))


def emissions(w: Words, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of all features of every word."""
    if not len(w.start):
        return np.zeros((0, weights.shape[1]), np.float32)
    per = weights[w.slots[0]]
    for s in w.slots[1:]:
        per += weights[s]
    out = np.add.reduceat(per, w.start, axis=0)
    lexical = w.lexical[0]
    known = lexical >= 0
    out[known] += weights[1 + (len(ORDERS) << BITS) + lexical[known]]
    return out


def forward_backward(score: np.ndarray, transition: np.ndarray, initial: np.ndarray, fresh: np.ndarray, pairs: bool = False):
    """Label probabilities of every word of chains laid end to end; ``fresh`` marks the first word of a chain.

    The row of words is cut into lanes that run side by side: the product of a lane's matrices carries the messages from lane to
    lane, so the result is that of one pass over the whole row. With ``pairs`` also the expected transitions.
    """
    n, k = score.shape
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    e = np.ones((lanes * steps, k))
    e[:n] = np.exp(score - score.max(1, keepdims=True))
    new = np.zeros(lanes * steps, bool)
    new[:n], new[n:] = fresh, True  # what fills the last lane stands for itself
    e = np.ascontiguousarray(e.reshape(lanes, steps, k).transpose(1, 0, 2))
    new = np.ascontiguousarray(new.reshape(lanes, steps).T)
    a, start = np.exp(transition), np.exp(initial - initial.max())
    any_new = new.any(1)
    product = np.broadcast_to(np.eye(k), (lanes, k, k)).copy()
    for t in range(steps):
        moved = product @ a
        if any_new[t]:
            moved[new[t]] = product[new[t]].sum(2, keepdims=True) * start
        product = moved * e[t][:, None, :]
        product /= product.sum((1, 2), keepdims=True)
    first, last = np.empty((lanes, k)), np.empty((lanes, k))
    v = np.full(k, 1 / k)
    for i in range(lanes):
        first[i] = v
        v = v @ product[i]
        v = v / v.sum()
    v = np.ones(k)
    for i in range(lanes - 1, -1, -1):
        last[i] = v
        v = product[i] @ v
        v = v / v.sum()
    alpha, beta = np.empty_like(e), np.empty_like(e)
    v = first
    for t in range(steps):
        v = v @ a
        if any_new[t]:
            v[new[t]] = start
        v = v * e[t]
        v /= v.sum(1, keepdims=True)
        alpha[t] = v
    v = last
    for t in range(steps - 1, -1, -1):
        beta[t] = v
        ahead = e[t] * v
        v = ahead @ a.T
        if any_new[t]:
            v[new[t]] = (ahead[new[t]] @ start)[:, None]
        v = v / v.sum(1, keepdims=True)
    flat = lambda x: x.transpose(1, 0, 2).reshape(-1, k)[:n]
    alpha, beta, e = flat(alpha), flat(beta), flat(e)
    marginal = alpha * beta
    marginal /= marginal.sum(1, keepdims=True)
    if not pairs:
        return marginal
    ahead = (e * beta)[1:]
    weight = 1 / ((alpha[:-1] @ a) * ahead).sum(1)
    weight[np.asarray(fresh)[1:]] = 0
    return marginal, ((alpha[:-1] * weight[:, None]).T @ ahead) * a


def fit(texts: list[str], labels: list[str], rounds: int = ROUNDS, seed: int = 11) -> Model:
    """Learn feature and transition weights by gradient ascent on the conditional likelihood.

    The lines of the texts are chained in random order, each word labelled with the language of its text: so there are
    switches to learn transitions from.
    """
    langs = sorted(set(labels))
    k = len(langs)
    lines = [(line, langs.index(lang)) for t, lang in zip(texts, labels) for line in t.split("\n") if line]
    order = np.random.default_rng(seed).permutation(len(lines))
    lines = [lines[i] for i in order]
    w = features([x for x, _ in lines], np.zeros(0, np.uint64))
    if not len(w.start) or k < 2:
        return Model(langs, np.zeros((1 + (len(ORDERS) << BITS), max(k, 1)), np.float32), np.zeros(0, np.uint64), np.zeros((k, k)), np.zeros(k))
    gold = np.array([y for _, y in lines])[w.text]
    hashed, lead, inverse, count = np.unique(w.lexical[1], return_index=True, return_inverse=True, return_counts=True)
    common = np.sort(np.argsort(-count, kind="stable")[:LEXICON])
    common = common[count[common] > 1]
    lexicon, base = hashed[common], 1 + (len(ORDERS) << BITS)
    entry = np.full(len(hashed), 0)
    entry[common] = base + np.arange(len(common))
    # Features of the distinct words, as (word, row) pairs.
    span = w.letters[lead] + 2
    word = np.repeat(np.arange(len(lead)), span)
    place = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + np.repeat(w.start[lead], span)
    row = np.concatenate([s[place] for s in w.slots] + [entry])
    word = np.concatenate([word] * len(ORDERS) + [np.arange(len(lead))])
    word, row = word[row > 0], row[row > 0]
    order = np.argsort(word, kind="stable")
    word, row = word[order], row[order]
    at = np.searchsorted(word, np.arange(len(lead)))
    weights = np.zeros((base + len(common), k))
    transition, initial = np.zeros((k, k)), np.zeros(k)
    seen_w, seen_t = np.full_like(weights, 1e-6), np.full_like(transition, 1e-6)
    fresh = np.zeros(len(gold), bool)
    fresh[0] = True
    told = np.zeros((k, k))
    np.add.at(told, (gold[:-1], gold[1:]), 1)
    hot = np.eye(k)[gold]
    for _ in range(rounds):
        score = np.add.reduceat(weights[row], at, axis=0)[inverse]
        marginal, expected = forward_backward(score, transition, initial, fresh, True)
        gap = hot - marginal
        per = np.stack([np.bincount(inverse, weights=g, minlength=len(lead)) for g in gap.T], 1)
        grad = np.stack([np.bincount(row, weights=g, minlength=len(weights)) for g in per[word].T], 1) - 0.1 * weights
        seen_w += grad**2
        weights += RATE * grad / np.sqrt(seen_w)
        grad = told - expected - 0.1 * transition
        seen_t += grad**2
        transition += RATE * grad / np.sqrt(seen_t)
    return Model(langs, weights.astype(np.float32), lexicon, transition, initial)


def predict(model: Model, texts: list[str]) -> tuple[list[str], list[float], np.ndarray]:
    """Per text the language that most of its letters are labelled with, the expected share of those letters, and all shares."""
    langs = model.langs
    share = np.zeros((len(texts), max(1, len(langs))))
    letters = np.zeros(len(texts), np.int64)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BLOCK):
            size += len(texts[hi])
            hi += 1
        w = features(texts[lo:hi], model.lexicon)
        if len(w.start):
            fresh = np.ones(len(w.text), bool)
            fresh[1:] = w.text[1:] != w.text[:-1]
            if len(langs) > 1:
                marginal = forward_backward(emissions(w, model.weights), model.transition, model.initial, fresh)
            else:
                marginal = np.ones((len(w.text), 1))
            for j in range(marginal.shape[1]):
                share[lo:hi, j] = np.bincount(w.text, weights=marginal[:, j] * w.letters, minlength=hi - lo)
            letters[lo:hi] = np.bincount(w.text, weights=w.letters, minlength=hi - lo)
        lo = hi
    share /= np.maximum(letters, 1)[:, None]
    top = share.argmax(1)
    known = (letters > 0) & (len(langs) > 0)
    names = [langs[t] if ok else UNKNOWN for t, ok in zip(top.tolist(), known.tolist())]
    return names, np.clip(np.where(known, share[np.arange(len(top)), top], 0.0), 0, 1).tolist(), share


def labelled_sample(docs: DataFrame, told: DataFrame, id_col: str, text_col: str, per_label: int) -> list:
    """(id, label, text) of at most ``per_label`` rows of each label of ``told`` (id, label): all of them if they are no more, else those of least hash.

    The rows are chosen by their ids alone, in two pre-aggregated steps: the number of ids of a label, to within a few hundredths, says below which hash
    about three times as many lie as are wanted, and only these are ordered. The texts are then looked up for the chosen ones, whose number is bounded.
    A row whose id is null or stands twice under one label counts once.
    """
    steps = 1 << 30
    sizes = cut(told.groupBy("label").agg(F.approx_count_distinct("id", 0.02).alias("n")), "labels")
    hashed = told.select("id", "label", F.xxhash64(F.lit("order"), "id").alias("h")).join(sizes, "label")
    near = hashed.where(F.pmod("h", F.lit(steps)) < F.lit(float(steps)) * F.least(F.lit(1.0), 3.0 * per_label / F.greatest("n", F.lit(1))))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("h", F.lit(steps)), "h", "id"))
    chosen = near.select("id", "label", "h").distinct().withColumn("place", place).where(F.col("place") <= per_label)
    chosen = cut(chosen.select(F.col("id").alias("_id"), F.col("label").alias("_label")), "sample")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(chosen, F.col("id").eqNullSafe(F.col("_id"))).where(F.col("text").isNotNull()).select("id", F.col("_label").alias("label"), "text")
    return sorted(rows.dropDuplicates(["label", "id"]).collect(), key=lambda r: (r.label, str(r.id), r.text))


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model learned from the rows where ``learn`` holds: whole texts of at most ``per_language`` of them for each language."""
    told = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("label"))
    rows = labelled_sample(docs, told, id_col, text_col, per_language)
    return fit([r.text for r in rows], [r.label for r in rows])


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "lang_score", mixture: str | None = None) -> DataFrame:
    """``docs`` with the predicted language and its score, the share of letters that it gets, 0 to 1.

    Only the text is looked at. Null text, text without a letter, and every text if the model has no language are ``und`` with
    score 0. ``mixture`` names a column for the shares of all languages. Rows are independent, so repeated rows, missing ids and ties change nothing;
    an empty table stays empty; columns named like new ones are replaced. A tie between languages goes to the smaller code. A text longer than a
    block is worked on alone and whole, with memory in proportion to its length.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    new = [c for c in (lang, score, mixture) if c]
    source = packed(docs, text_col, tuple(new))
    kinds = [T.StringType(), T.DoubleType(), T.MapType(T.StringType(), T.DoubleType())]
    schema = T.StructType([source.schema["_row"], *[T.StructField(n, k) for n, k in zip(new, kinds)]])

    def work(batches):
        model = held.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                got, sure, share = predict(model, part.column("_text").to_pylist())
                out = [part.column("_row"), pa.array(got, pa.string()), pa.array(sure, pa.float64())]
                if mixture:
                    out.append(pa.array([list(zip(model.langs, s)) for s in share.tolist()], pa.map_(pa.string(), pa.float64())))
                yield pa.RecordBatch.from_arrays(out, names=["_row", *new])

    return unpacked(source.mapInArrow(work, schema), *new)
