"""Personal data in text by anchor expansion: an Aho-Corasick automaton finds the places, small parsers find the borders.

One pass of the automaton over a text gives its anchors: at-signs, plus signs, digits, schemes (``https://``) and identifier cues
(``iban``, ``account``). Each anchor is expanded to the left and to the right by the parser of its kind, and what it finds is validated.
Every parser is linear, and a parser that has passed a stretch of a text does not look at it again.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowlens.llm.common import LOWER_ASCII, packed, unpacked

KINDS = ["email", "ip", "card", "phone", "login", "iban", "account"]
EMAIL, IP, CARD, PHONE, LOGIN, IBAN, ACCOUNT = range(7)
DIGITS = 7  # an anchor of two kinds: addresses of numbers, and cards

# Schemes in front of a user name, and words in front of an account number, in lower case.
SCHEMES = ["http", "https", "ftp", "ftps", "sftp", "ssh", "git", "postgres", "postgresql", "mysql", "mongodb", "redis", "amqp", "ldap", "ldaps", "smb"]
CUES = ["account", "acct", "passport", "ssn", "social security", "tax id", "konto", "cuenta", "compte"]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: What stands behind an anchor. The last group of those with a cue is what is reported.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
PHONE_TAIL = re.compile(r"[0-9][\x20().0-9-]+[0-9]")
USER_HOST = r"[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9.-]*[A-Za-z0-9]"
IBAN_TAIL = r"[\x20:#.]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)\b"
ACCOUNT_TAIL = r"(?:\x20(?:number|no|nr|num))?[\x20.:#=]{0,4}([0-9][0-9-]{4,20}[0-9])"
_AFTER = {LOGIN: re.compile(USER_HOST), IBAN: re.compile(IBAN_TAIL, re.ASCII), ACCOUNT: re.compile(ACCOUNT_TAIL)}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban_checks(code: str) -> bool:
    """Is the number of the code, its first four characters moved to the end and letters read as 10 to 35, one more than a multiple of 97?"""
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def automaton():
    """The anchors, in lower case, with their kind and length."""
    import ahocorasick

    found = ahocorasick.Automaton()
    words = [("@", EMAIL), ("+", PHONE), ("iban", IBAN), *[(d, DIGITS) for d in "0123456789"], *[(f"{s}://", LOGIN) for s in SCHEMES], *[(c, ACCOUNT) for c in CUES]]
    for word, kind in words:
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """A-Z in lower case, every other character as it is, so that positions stay."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).decode("utf-8", "surrogatepass")


def spans_of(text: str, anchors) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all finds of a text, in code points, by start and then kind.

    ``done`` holds, by kind, the end of the last match: matches of a kind come from left to right and do not overlap. A match
    that fails its validation is dropped and what it covered is not tried again.
    """
    out: list[tuple[int, int, int]] = []
    done = [0] * (DIGITS + 1)
    for end, (kind, length) in anchors.iter(lowered(text)):
        start = end + 1 - length
        if kind == DIGITS:
            if start >= done[IP]:
                numbers = NUMBERS.match(text, start)
                done[IP] = numbers.end()
                parts, at = numbers.group().split("."), start
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    stop = at + sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                        out.append((at, IP, stop))
                    at = stop + 1
            if start >= done[CARD]:
                card = CARD_DIGITS.match(text, start)
                done[CARD] = card.end()
                digits = card.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((start, CARD, card.end()))
        elif start < done[kind]:
            continue
        elif kind == EMAIL:
            domain = DOMAIN.match(text, end + 1)
            if domain:
                at = start
                while at > done[EMAIL] and text[at - 1] in LOCAL:
                    at -= 1
                if at < start:
                    out.append((at, EMAIL, domain.end()))
                    done[EMAIL] = domain.end()
        elif kind == PHONE:
            phone = PHONE_TAIL.match(text, end + 1)
            if phone:
                done[PHONE] = phone.end()
                if 9 <= sum(c.isdigit() for c in phone.group()) <= 15:
                    out.append((start, PHONE, phone.end()))
        else:
            found = _AFTER[kind].match(text, end + 1)
            if found:
                done[kind] = found.end()
                if kind == LOGIN:
                    out.append((start, kind, found.end()))
                elif iban_checks(found[1]) if kind == IBAN else 6 <= len(found[1].replace("-", "")) <= 18:
                    out.append((found.start(1), kind, found.end(1)))
    return sorted(out)


_ANCHORS: list = []  # built once in a worker


def find_personal(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with an array ``out`` of (start, end, kind) per row, code points, end exclusive, by start and then kind.

    kind counts KINDS: mail addresses; addresses of four numbers up to 255; 12 to 19 digits with the check digit of cards; international
    phone numbers of 9 to 15 digits; scheme, user and host of an address that names a user; account codes behind ``iban`` whose check
    digits are right; numbers of 6 to 18 digits behind a word for an account or a document. Kinds may overlap each other.

    Null text counts as empty and has the empty array. Rows are independent: repeated rows, missing ids and ties change nothing; an
    empty table stays empty; other columns stay, except one named like ``out``, which is replaced. A text of any length is
    scanned whole, in time proportional to its length; a task holds one batch of texts.
    """
    source = packed(docs, text_col, (out,))
    span = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "kind")])
    schema = T.StructType([source.schema["_row"], T.StructField(out, T.ArrayType(span))])

    def work(batches):
        if not _ANCHORS:
            _ANCHORS.append(automaton())
        for b in batches:
            found = [spans_of(t, _ANCHORS[0]) for t in b.column("_text").to_pylist()]
            flat = [x for spans in found for x in spans]
            offsets = [0]
            for spans in found:
                offsets.append(offsets[-1] + len(spans))
            columns = [pa.array([x[i] for x in flat], pa.int32()) for i in (0, 2, 1)]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["start", "end", "kind"]))
            yield pa.RecordBatch.from_arrays([b.column("_row"), lists], names=["_row", out])

    return unpacked(source.mapInArrow(work, schema), out)
