"""Secrets in text: known shapes, and strings of high sliding-window entropy. Built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import packed, unpacked

# The shapes. Every key word is matched in either case.
_KEYS = ["password", "passwd", "secret", "token", "api_?key"]
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in _KEYS)
ASSIGN = rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]

#: Strings whose entropy is looked at, the characters of a window, and the least bits per character by the class of the
#: string: hexadecimal digits, capitals and digits, anything else.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
LEAST_BITS = [(r"^[0-9a-f]+$|^[0-9A-F]+$", 2.95), (r"^[A-Z0-9]+$", 3.35), (r"", 3.75)]
#: Candidates that are never reported: no digit or no letter, a UUID.
ALLOWED = (
    r"^[^0-9]+$|^[^A-Za-z]+$"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
)
#: Allowed stretches of a candidate, of which no reported window holds a character: a path of words at its start, one to four characters
#: five times in a row, and words that say the text is none. What stands beside them is looked at like anything else.
PATH = r"^/?[a-z_-]+(?:/[a-z_-]+){2,}/?"
UNITS, TIMES = 4, 5
WORDS = ["EXAMPLE", "example", "placeholder", "changeme", "xxxx", "XXXX"]
_STRETCH = PATH + r"|(.{1,%d})\1{%d,}|" % (UNITS, TIMES - 1) + "|".join(WORDS)
_SCALE = 10**9
_CHUNK = 256


def _grow(acc: Column, x: Column) -> Column:
    return F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["at"], F.array(acc["sum"])).alias("at"))


def _zero() -> Column:
    return F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("at"))


def sums_before(lengths: Column) -> Column:
    """For every number of an array the sum of those before it, in two levels, so that no long array is copied per element."""
    chunks = F.transform(
        F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")),
        lambda c: F.aggregate(F.slice(lengths, c * _CHUNK + 1, F.lit(_CHUNK)), _zero(), _grow),
    )
    starts = F.aggregate(chunks, _zero(), lambda acc, c: _grow(acc, c["sum"]))["at"]
    return F.flatten(F.zip_with(chunks, starts, lambda c, s: F.transform(c["at"], lambda x: x + s)))


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,kind:int>>")


def _with_matches(df: DataFrame, name: str, pattern: str, may: Column) -> DataFrame:
    """Add the matches ``_<name>`` of a pattern in ``_text`` and their start positions ``_<name>_at``, in code points.

    Matches and the texts between them alternate, so a match starts behind the lengths of all before it.
    """
    p = F.lit(pattern)
    df = df.withColumn(f"_{name}", F.when(may, F.regexp_extract_all("_text", p, F.lit(0))).otherwise(F.array().cast("array<string>")))
    some = F.size(f"_{name}") > 0
    gaps = F.transform(F.slice(F.split("_text", pattern, -1), F.lit(1), F.size(f"_{name}")), lambda g: F.length(g))
    df = df.withColumn(f"_{name}_gap", F.when(some, gaps))
    both = F.zip_with(f"_{name}_gap", F.transform(f"_{name}", lambda m: F.length(m)), lambda g, m: g + m)
    starts = F.zip_with(sums_before(both), f"_{name}_gap", lambda s, g: s + g)
    return df.withColumn(f"_{name}_at", F.when(some, starts).otherwise(F.array().cast("array<int>")))


def _as_spans(name: str, kind: int) -> Column:
    return F.zip_with(
        f"_{name}", f"_{name}_at",
        lambda m, at: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), F.lit(kind).alias("kind")),
    )


def _limit(bits: float) -> int:
    """The entropy of a window is log2(W) - sum(n log2 n) / W; in whole billionths, the largest sum that is enough."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * _SCALE)


def allowed_stretches(text: Column) -> Column:
    """(start, end) of the stretches of a candidate that may stand in no reported window; they may overlap."""
    def places(size: int, holds) -> Column:
        at = F.when(F.length(text) >= size, F.sequence(F.lit(0), F.length(text) - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(at, holds), lambda q: F.struct(q.alias("start"), (q + size).alias("end")))

    part = lambda q, n: F.substring(text, q + 1, F.lit(n))
    is_unit = lambda k: lambda q: part(q, (TIMES - 1) * k) == part(q + k, (TIMES - 1) * k)
    is_word = lambda w: lambda q: part(q, len(w)) == F.lit(w)
    repeated = [places(TIMES * k, is_unit(k)) for k in range(1, UNITS + 1)]
    words = [places(len(w), is_word(w)) for w in WORDS]
    path = F.length(F.regexp_extract(text, PATH, 0))
    return F.concat(F.array(F.struct(F.lit(0).alias("start"), path.alias("end"))), *repeated, *words)


def entropy_windows(text: Column) -> Column:
    """Merged (start, end) of the windows of a candidate whose entropy suffices for its class and that touch no allowed stretch.

    One step per character: the counts of the entering and the leaving character change by one, and with them the sum of
    n log2 n, taken from a table in whole billionths, so that the sum is exact however long the candidate is.
    """
    table = F.array(*[F.lit(round(n * math.log2(n) * _SCALE) if n else 0).cast("bigint") for n in range(WINDOW + 2)])
    most = F.when(text.rlike(LEAST_BITS[0][0]), F.lit(_limit(LEAST_BITS[0][1]))).when(
        text.rlike(LEAST_BITS[1][0]), F.lit(_limit(LEAST_BITS[1][1]))
    ).otherwise(F.lit(_limit(LEAST_BITS[2][1]))).cast("bigint")
    value = lambda n: F.element_at(table, n + 1)
    empty = F.array().cast("array<struct<start:int,end:int>>")
    code = lambda i: F.ascii(F.substring(text, i + 1, F.lit(1)))
    allowed = F.when(text.rlike(_STRETCH), allowed_stretches(text)).otherwise(empty)
    first = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("i"), empty.alias("spans"), allowed.alias("allowed"))

    def step(acc: Column, new: Column) -> Column:
        i, counts = acc["i"], acc["counts"]
        old = F.when(i >= WINDOW, code(i - WINDOW)).otherwise(F.lit(-1))
        n = F.element_at(counts, new + 1)
        m = F.when(old >= 0, F.element_at(counts, F.greatest(old, F.lit(0)) + 1) + (old == new).cast("int"))
        total = acc["sum"] + value(n + 1) - value(n) + F.when(old >= 0, value(m - 1) - value(m)).otherwise(F.lit(0).cast("bigint"))
        moved = F.transform(counts, lambda c, j: c + (j == new).cast("int") - (j == old).cast("int"))
        start, end = i - (WINDOW - 1), i + 1
        last = F.try_element_at(acc["spans"], F.lit(-1))
        longer = F.concat(
            F.slice(acc["spans"], F.lit(1), F.greatest(F.size(acc["spans"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), end.alias("end")))
        )
        appended = F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        touched = F.exists(acc["allowed"], lambda s: (s["start"] < end) & (s["end"] > start))
        spans = F.when((start < 0) | (total > most) | touched, acc["spans"]).when(last["end"] >= start, longer).otherwise(appended)
        return F.struct(moved.alias("counts"), total.alias("sum"), (i + 1).alias("i"), spans.alias("spans"), acc["allowed"].alias("allowed"))

    chars = F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda i: code(i))
    return F.when(text.rlike(ALLOWED), empty).otherwise(F.aggregate(chars, first, step)["spans"])


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with an array ``out`` of (start, end, kind) per row, code points, end exclusive, by start and then kind.

    kind counts KINDS: an assignment of six or more characters to a key word, an access key, 24 or more hexadecimal digits, and stretches
    of high entropy, which may lie inside the others. Assignments are matched leftmost and without overlap before the short ones are dropped.

    Null text has the empty array. Rows are independent: repeated rows, missing ids and ties change nothing; an empty table stays
    empty; other columns stay, except one named like ``out``, which is replaced. Texts of any length are scanned whole.
    """
    text = F.col("_text")
    df = packed(docs, text_col, (out,))
    lowered = text.rlike(f"{_EITHER}")
    df = _with_matches(df, "assign", ASSIGN, lowered)
    value = F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(2))
    df = df.withColumn("_value", F.when(F.size("_assign") > 0, F.transform(value, lambda v: F.length(v))).otherwise(F.array().cast("array<int>")))
    df = _with_matches(df, "access", ACCESS, text.contains("AKIA"))
    df = _with_matches(df, "candidate", CANDIDATE, F.lit(True))
    df = _with_matches(df, "hex", HEX, F.lit(True))
    long_enough = F.transform(
        F.filter(F.zip_with(_as_spans("assign", 0), "_value", lambda s, v: F.struct(s.alias("s"), v.alias("v"))), lambda x: x["v"] >= 6), lambda x: x["s"]
    )
    found = F.flatten(
        F.zip_with(
            "_candidate", "_candidate_at",
            lambda c, at: F.transform(entropy_windows(c), lambda w: F.struct((at + w["start"]).alias("start"), (at + w["end"]).alias("end"), F.lit(3).alias("kind"))),
        )
    )
    df = df.select("_row", *[x.alias(f"_s{i}") for i, x in enumerate((long_enough, _as_spans("access", 1), _as_spans("hex", 2), found))])
    order = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    ordered = F.array_sort(F.transform(F.concat(*[F.coalesce(f"_s{i}", _no_spans()) for i in range(4)]), order))
    back = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    return unpacked(df.select("_row", F.transform(ordered, back).alias(out)), out)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by one mark."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        parts = F.when((s["start"] < acc["at"]) | ((s["start"] == acc["at"]) & (acc["at"] > 0)), acc["parts"]).otherwise(F.concat(acc["parts"], F.array(gap, F.lit(mark))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    done = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, first, step, done)).otherwise(text)
