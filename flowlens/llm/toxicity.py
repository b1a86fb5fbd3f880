"""Toxicity of text by compression distance: windows are compressed with an ordinary and with a toxic zstandard dictionary."""

from __future__ import annotations

import math
import zlib
from collections import Counter, namedtuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import LOWER_ASCII, packed, unpacked
from flowlens.llm.language_crf import labelled_sample
from flowlens.tables import cut

#: Labelled rows of a class that are learned from, at most; parts into which they are dealt for the calibration.
PER_CLASS, PARTS = 1500, 3
#: Bytes of a window, of the ordinary dictionary, and of the toxic one; shortest match that the compressor takes.
WINDOW, ORDINARY, TOXIC, MATCH = 48, 32_768, 16_384, 6
#: A toxic segment stands in this share of the toxic texts at least, and so many times more often in them than in ordinary ones.
SUPPORT, CONTRAST, LEAST, LONGEST = 0.01, 20, 3, 16
#: How strongly weights are drawn to which slope, and the least spread by which a gain is scaled.
RIDGE, SLOPE, FLAT = 0.5, 0.2, 0.01
#: Gains, in bytes, from which windows are counted.
GAINS = (2, 3, 4, 5, 6)

Model = namedtuple("Model", "ordinary toxic mean scale weights")


def windows(text: bytes) -> list[bytes]:
    """The whole text, lower-cased, in windows that end before a space where one is near."""
    text = text.translate(LOWER_ASCII)
    out, i, n = [], 0, len(text)
    while i < n:
        j = i + WINDOW
        if j < n:
            k = text.find(b" ", j, j + WINDOW)
            j = k if k >= 0 else j
        out.append(text[i:j])
        i = j
    return out


def words(text: bytes) -> set[bytes]:
    """Distinct words of four bytes or more: runs of letters, other bytes than ASCII counting as such."""
    kept = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in LOWER_ASCII)
    return {w for w in text.translate(kept).split() if len(w) > 3}


def apart(texts: list[bytes], bits: int = 8192) -> list[bytes]:
    """The texts without near copies of earlier ones, so that what a group of copies repeats does not look frequent."""
    marks = np.zeros((len(texts), bits), np.float32)
    for i, t in enumerate(texts):
        marks[i, [zlib.crc32(w) % bits for w in words(t)]] = 1
    size, common = marks.sum(1), marks @ marks.T
    kept: list[int] = []
    for i in range(len(texts)):
        if not kept or (common[i, kept] < 0.6 * np.maximum(1, np.minimum(size[i], size[kept]))).all():
            kept.append(i)
    return [texts[i] for i in kept]


def ordinary_dictionary(texts: list[bytes], seed: int = 3) -> bytes:
    pieces = [w for t in texts for w in windows(t)]
    pieces = [pieces[i] for i in np.random.default_rng(seed).permutation(len(pieces))[:20_000]]
    try:
        return zstandard.train_dictionary(ORDINARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(pieces)[-ORDINARY:]


def beginnings(text: bytes) -> set[bytes]:
    """Distinct beginnings of words, each behind the byte that a word starts after: all of MATCH bytes or more, whole characters, and the words."""
    out = set()
    for w in words(text):
        w = b" " + w
        out.add(w + b" ")
        out.update(w[:j] for j in range(MATCH, min(len(w), LONGEST) + 1) if j == len(w) or w[j] & 0xC0 != 0x80)
    return out


def toxic_dictionary(seen: Counter, other: Counter, n_toxic: int, n_ordinary: int) -> bytes:
    """Beginnings of words and whole words that toxic texts repeat and ordinary ones do not, most frequent last, where it is nearest.

    So many toxic texts must hold a segment that about one of all segments would do so by chance. If none does, what stands in ``LEAST`` of
    them is taken, else in two, else in one. A segment that another one begins with is left out: it is found there. ``seen`` and ``other`` say
    in how many of the ``n_toxic`` and ``n_ordinary`` texts a segment stands.
    """
    rare = [s for s, c in seen.items() if c * n_ordinary > CONTRAST * other[s] * n_toxic]
    chance = math.log(max(2, len(seen))) / math.log(1 + n_ordinary / max(1, n_toxic)) if n_ordinary else 0
    chosen: list[bytes] = []
    for least in (max(LEAST, SUPPORT * n_toxic, chance), LEAST, 2, 1):
        chosen = chosen or sorted(s for s in rare if seen[s] >= least)
    kept: dict[bytes, int] = {}
    for s, after in zip(chosen, [*chosen[1:], b""]):
        most = max(seen[s], kept.pop(b"", 0))
        if after.startswith(s):
            kept[b""] = most  # handed on to the longer one
        else:
            kept[s] = most
    return b"".join(sorted(kept, key=lambda s: (kept[s], s)))[-TOXIC:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    p = zstandard.ZstdCompressionParameters.from_level(
        3, dict_size=len(content), source_size=WINDOW, min_match=MATCH, strategy=zstandard.STRATEGY_FAST, write_checksum=False, write_content_size=False, write_dict_id=False
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(compression_params=p, dict_data=held)


class Meter:
    """How much shorter the windows of a text get when the toxic dictionary stands behind the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain = compressor(ordinary).compress if ordinary and toxic else None
        self.both = compressor(ordinary + toxic).compress if ordinary and toxic else None

    def features(self, text: bytes) -> list[float]:
        parts = windows(text)
        if not parts or self.plain is None:
            return [0.0] * (4 + 2 * len(GAINS))
        plain, both = self.plain, self.both
        gain = np.array([len(plain(w)) - len(both(w)) for w in parts])
        top = np.sort(gain)[::-1][:3].clip(0).tolist() + [0, 0]
        counts = [(gain >= g).sum() for g in GAINS]
        return [*top[:3], gain.mean(), *np.log1p(counts), *[c / len(gain) for c in counts]]


def fit(texts: list[bytes], toxic: list[int], rate: float) -> Model:
    """Dictionaries from the rows, and a logistic calibration of the gains of rows that are not in the dictionaries at hand.

    The rows are dealt into ``PARTS``, class by class; the gains of a part are measured with dictionaries of the other parts, so that every row
    is learned from and calibrates. ``rate`` is the share of toxic rows where the scores are to hold: the rows count accordingly.
    The weights are drawn to a small positive slope and not to zero, so that with few rows more gain still is a higher score.
    """
    is_toxic = np.array(toxic, bool)
    part = np.zeros(len(texts), int)
    for c in (False, True):
        mine = np.flatnonzero(is_toxic == c)
        part[mine] = np.arange(len(mine)) % PARTS
    first = set(apart([t for t, c in zip(texts, is_toxic) if c]))
    toxic_parts = [[t for t, c, p in zip(texts, is_toxic, part) if c and p == k and t in first] for k in range(PARTS)]
    plain_parts = [[t for t, c, p in zip(texts, is_toxic, part) if not c and p == k] for k in range(PARTS)]
    seen = [Counter(s for t in held for s in beginnings(t)) for held in toxic_parts]
    some = set().union(*seen)
    other = [Counter(s for t in held for s in beginnings(t) if s in some) for held in plain_parts]

    def made(k: int) -> tuple[bytes, bytes]:
        """The ordinary and the toxic dictionary of all parts but ``k``."""
        rest = [i for i in range(PARTS) if i != k]
        joined = [Counter(), Counter()]
        for total, counts in zip(joined, (seen, other)):
            for i in rest:
                total.update(counts[i])
        sizes = [sum(len(held[i]) for i in rest) for held in (toxic_parts, plain_parts)]
        return ordinary_dictionary([t for i in rest for t in plain_parts[i]]), toxic_dictionary(*joined, *sizes)

    x = np.zeros((len(texts), 4 + 2 * len(GAINS)))
    for k in range(PARTS):
        meter = Meter(*made(k))
        for i in np.flatnonzero(part == k):
            x[i] = meter.features(texts[i])
    y = is_toxic
    mean, scale = (x.mean(0), np.maximum(x.std(0), FLAT)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.concatenate(((x - mean) / scale, np.ones((len(x), 1))), 1)
    drawn_to = np.append(np.full(x.shape[1], SLOPE), 0.0)
    w = drawn_to.copy()
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    w[-1] = np.log(rate / (1 - rate))
    if y.any() and not y.all():
        weight = np.where(y, rate / y.mean(), (1 - rate) / (1 - y.mean()))
        ridge = np.full(len(w), RIDGE)
        ridge[-1] = 1e-6
        sign = np.where(y, 1.0, -1.0)
        loss = lambda w: (weight * np.logaddexp(0, -sign * (z @ w))).sum() + (ridge * (w - drawn_to) ** 2).sum() / 2
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(hessian, z.T @ (weight * (p - y)) + ridge * (w - drawn_to))
            now, share = loss(w), 1.0
            while share > 1e-6 and not loss(w - share * step) <= now:  # a whole step may go past the least loss
                share /= 2
            if share <= 1e-6:
                break
            w = w - share * step
    return Model(*made(PARTS), mean, scale, w)


def score(model: Model, meter: Meter, text: bytes) -> float:
    z = (np.array(meter.features(text)) - model.mean) / model.scale
    return float(1 / (1 + np.exp(-np.clip(z @ model.weights[:-1] + model.weights[-1], -30, 30))))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """A model learned from whole texts of at most ``per_class`` labelled rows of each class, where ``learn`` holds."""
    told = labels.where(F.col(label_col).isin(0, 1) & learn & F.col(id_col).isNotNull())
    told = cut(told.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")), "told")
    rate = told.agg(F.avg("label")).first()[0]
    rows = sorted(labelled_sample(docs, told, id_col, text_col, per_class), key=lambda r: zlib.crc32(r.text.encode()))
    distinct = {r.text: r.label for r in rows}
    return fit([t.encode() for t in distinct], list(distinct.values()), rate or 0.0)


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a score ``out`` from 0 to 1 for the whole text.

    Null and empty text get the score of a text without any gain. Rows are independent: repeated rows, missing ids and ties change
    nothing; an empty table stays empty; a column named like ``out`` is replaced. A long text is compressed window by window.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = packed(docs, text_col, (out,))

    def work(batches):
        model = held.value
        meter = Meter(model.ordinary, model.toxic)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                scores = [score(model, meter, t.encode()) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(scores, pa.float64())], names=["_row", out])

    return unpacked(source.mapInArrow(work, T.StructType([source.schema["_row"], T.StructField(out, T.DoubleType())])), out)
