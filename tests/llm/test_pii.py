"""Personal data against plain regular expressions, and the query against its SQL."""

from __future__ import annotations

import random
import re

import duckdb

from flowlens.llm import pii_anchors as P
from flowlens.llm.q_pii import SQL, op13_pii
from flowlens.llm.queries import QUERIES

BASE = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    f"(?i:{'|'.join(sorted(P.SCHEMES, key=len, reverse=True))})://{P.USER_HOST}", f"(?i:iban){P.IBAN_TAIL}", f"(?i:{'|'.join(P.CUES)}){P.ACCOUNT_TAIL}",
]


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m[0])
    if kind == P.IP:
        return all(int(p) <= 255 for p in m[0].split("."))
    if kind == P.CARD:
        d = [int(c) for c in digits[::-1]]
        return 12 <= len(d) <= 19 and (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0
    if kind == P.PHONE:
        return 9 <= len(digits) <= 15
    if kind == P.IBAN:
        code = m[1].replace(" ", "")
        value = 0
        for c in code[4:] + code[:4]:
            value = (value * (100 if c.isalpha() else 10) + int(c, 36)) % 97
        return value == 1
    return kind != P.ACCOUNT or 6 <= len(m[1].replace("-", "")) <= 18


def brute(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text, re.ASCII):
            if passes(kind, m):
                out.append((m.start(1) if kind > P.LOGIN else m.start(), kind, m.end(1) if kind > P.LOGIN else m.end()))
    return sorted(out)


KNOWN = [
    ("mail a.b+c@x-y.example.org, 1.2.3.4, 4111 1111 1111 1111, +49 (30) 123.456-7", [0, 1, 2, 3]),
    ("é a@b.c_x@d.e a@b.c-x@d.e @x.y a@b ... a@b. ", [0, 0, 0]), ("999.1.2.3.4.5.6.7.8 1.2.3.256", [1]), ("0001.2.3.4", [1]),
    ("HTTPS://me:pw@host.example. sftp://a@b ftp://@c", [0, 4, 4]), ("IBAN: DE89 3704 0044 0532 0130 00, iban DE88 3704 0044 0532 0130 00", [5]),
    ("Account no: 12345678 acct 12-34 SSN 078-05-1120 passport1234567", [6, 6, 6]), ("+1 2 (3) +123456789. +1234567890123456", [3]),
]


def test_spans_equal_regular_expressions():
    anchors = P.automaton()
    for text, kinds in KNOWN:
        assert P.spans_of(text, anchors) == brute(text)
        assert sorted(k for _, k, _ in P.spans_of(text, anchors)) == kinds, text
    rng = random.Random(1)
    pool = ["@", ".", "+", " ", "-", "a", "Z9", "_", "é", "İ", "12", "0", "255.", "4111 1111", "http://", "sFTP://", "ftp://", ":", "(", ")", "iban ", "IBAN", "GB82 WEST 1234 5698 7654 32", "ssn ", "Account", " no ", "konto:", "😀", "b.c"]
    for _ in range(20_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        assert P.spans_of(text, anchors) == brute(text), text


def test_odd_rows(spark):
    schema = "doc_id long, text string, spans int, _row int, _text string, kind int"
    rows = [(1, None, 1, 1, "x", 1), (None, "", None, None, None, None), (2, "a@b.co " * 30_000, 1, 1, "x", 1), (3, "1" * 200_000, 1, 1, "x", 1), (4, "a" * 200_000 + "@", 1, 1, "x", 1)]
    rows += [(5, "x@y.zz", 1, 1, "x", 1)] * 2
    out = P.find_personal(spark.createDataFrame(rows, schema).repartition(3))
    assert out.columns == ["doc_id", "text", "_row", "_text", "kind", "spans"]
    got = sorted(((r.doc_id, len(r.spans)) for r in out.collect()), key=str)
    assert got == sorted([(1, 0), (None, 0), (2, 30_000), (3, 0), (4, 0), (5, 1), (5, 1)], key=str)
    assert P.find_personal(spark.createDataFrame([], schema)).count() == 0


def test_query_equals_sql(spark, tmp_path):
    texts = [t for t, _ in KNOWN] + [None, "", "é" * 50 + " a@b.cc", "tel +49 30 1234567 iban GB82 WEST 1234 5698 7654 32 x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for sf, files in ((str(tmp_path), "documents.parquet/*.parquet"), ("/root/testdata/sf0.001", "documents.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/{files}'")
        want = con.execute(SQL).fetchdf()
        got = op13_pii(spark, sf).toPandas()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        rows = lambda d: sorted(map(repr, d[columns].astype(object).values.tolist()))
        assert rows(got) == rows(want)
    assert "op13_pii" in QUERIES
