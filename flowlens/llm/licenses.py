"""License notices in text, found by an exact set-similarity join with templates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import LOWER_ASCII, utf8
from flowlens.tables import cut

# Phrases of which every place counts, and notices as their licences word them.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
]

#: A text block is so many words; blocks overlap by half. A notice counts from this share of its distinct words.
BLOCK, THRESHOLD = 64, 0.8
#: Bytes of text worked on at once.
PIECE = 1 << 22

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.frombuffer(LOWER_ASCII, np.uint8)
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]


def words_of(text: str) -> list[str]:
    """Words as the operator takes them, for templates and tests."""
    data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    return bytes(np.where(_WORD[data], data, 32).astype(np.uint8)).decode().split(" ") if text else []


class Index:
    """Templates with their tokens in global order, rarest first, and the tokens that can open a match."""

    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str]], threshold: float, block: int):
        self.block, self.stride = block, block // 2
        split = lambda t: [w for w in words_of(t) if w]
        self.templates = [(label, split(t), 1.0, True) for label, t in phrases.items()] + [(label, split(t), threshold, False) for label, t in notices]
        if max(len(t[1]) for t in self.templates) > self.stride:
            raise ValueError("a template must fit into half a block")
        self.vocabulary = sorted({w for t in self.templates for w in t[1]})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.phrase_tokens = [[number[w] for w in t[1]] for t in self.templates]
        encoded = [w.encode() for w in self.vocabulary]
        self.longest = max(map(len, encoded))
        self.parts = -(-self.longest // 8)
        padded = [w.ljust(8 * self.parts, b"\0") for w in encoded]
        self.keys = np.array([[int.from_bytes(w[8 * k : 8 * k + 8], "little") for k in range(self.parts)] for w in padded], np.uint64)
        hashed = self.hash(self.keys.T)
        self.order = np.argsort(hashed)
        self.hashed = hashed[self.order]
        if len(np.unique(hashed)) < len(hashed):
            raise ValueError("two template words have one hash")

    @staticmethod
    def hash(keys) -> np.ndarray:
        out = np.zeros(len(keys[0]), np.uint64)
        for k, m in zip(keys, _MIX):
            out = (out ^ k) * m
            out ^= out >> np.uint64(29)
        return out

    def sort(self, frequency: dict[int, int]) -> None:
        """Fix the global order from the frequency of every template word in the corpus."""
        order = sorted(range(len(self.vocabulary)), key=lambda i: (frequency.get(i, 0), self.vocabulary[i]))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        n, v = len(self.templates), len(order)
        self.member = np.zeros((n, v), bool)
        self.need = np.zeros(n, np.int64)
        opens: list[list[int]] = [[] for _ in range(v)]
        for i, (_, _, share, _) in enumerate(self.templates):
            ranks = sorted({int(self.rank[t]) for t in self.phrase_tokens[i]})
            self.member[i, ranks] = True
            self.need[i] = math.ceil(share * len(ranks) - 1e-9)
            for r in ranks[: len(ranks) - self.need[i] + 1]:
                opens[r].append(i)
        self.size = self.member.sum(1)
        self.open_n = np.array([len(o) for o in opens], np.int64)
        self.open_at = np.cumsum(self.open_n) - self.open_n
        self.open_t = np.array([t for o in opens for t in o], np.int64)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Template words in the texts: text, word position, token; and the number of words of every text."""
        n = len(offsets) - 1
        words = np.zeros(n, np.int64)
        found = []
        lo = int(offsets[0]) if n else 0
        total = int(offsets[-1]) if n else 0
        while lo < total:
            hi = min(total, lo + PIECE)
            while hi < total and _WORD[_LOWER[data[hi]]]:  # a piece ends after a word
                hi += 1
            low = np.concatenate((_LOWER[data[lo:hi]], np.zeros(8 * self.parts, np.uint8)))
            inside = _WORD[low]
            first, last = np.searchsorted(offsets, [lo, hi], "right") - 1
            edges = offsets[first : last + 2]
            edges = edges[(edges >= lo) & (edges < hi)] - lo
            begin = inside.copy()
            begin[1:] &= ~inside[:-1]
            begin[edges] = inside[edges]
            stop = inside[:-1] & ~inside[1:]
            stop[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
            start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
            text = np.searchsorted(offsets, start + lo, "right") - 1
            per = np.bincount(text - first, minlength=last - first + 1)[: n - first]
            before = np.cumsum(per) - per
            position = np.arange(len(start)) - before[text - first] + words[text] if len(start) else start
            words[first : first + len(per)] += per
            size = end - start
            short = np.flatnonzero(size <= self.longest)
            at, size = start[short], size[short]
            every = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
            keys = []
            for k in range(self.parts):
                bits = np.clip(size - 8 * k, 0, 8).astype(np.uint64) * np.uint64(8)
                mask = np.where(bits == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (bits % np.uint64(64))) - np.uint64(1))
                keys.append(every[at + 8 * k] & mask)
            hashed = self.hash(keys)
            place = np.minimum(np.searchsorted(self.hashed, hashed), len(self.hashed) - 1)
            token = self.order[place]
            same = self.hashed[place] == hashed
            for k in range(self.parts):
                same &= self.keys[token, k] == keys[k]
            found.append((text[short][same], position[short][same], token[same]))
            lo = hi
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), words
        text, position, token = (np.concatenate(x) for x in zip(*found))
        return text, position, token, words

    def join(self, text, position, token, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, share) of every block that holds enough of a template; ``line`` gives words their place over all texts."""
        base = (-(-words // self.stride) + 2) * self.stride
        base = np.cumsum(base) - base + self.stride
        line, rank = base[text] + position, self.rank[token]
        self.base, self.line = base, line
        n = self.open_n[rank]
        hit = np.repeat(np.arange(len(rank)), n)
        template = self.open_t[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.open_at[rank], n)]
        block = line[hit] // self.stride
        pair = np.unique(np.concatenate((block, block - 1)) * len(self.templates) + np.concatenate((template, template)))
        block, template = pair // len(self.templates), pair % len(self.templates)
        blocks, where = np.unique(block, return_inverse=True)
        lo, hi = np.searchsorted(line, blocks * self.stride), np.searchsorted(line, blocks * self.stride + self.block)
        holds = np.zeros((len(blocks), len(self.rank)), bool)
        n = hi - lo
        holds[np.repeat(np.arange(len(blocks)), n), rank[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]] = True
        need = self.need[template]
        keep = holds.sum(1)[where] >= need  # length filter
        template, where, need = template[keep], where[keep], need[keep]
        after = holds[:, ::-1].cumsum(1)[:, ::-1]
        first = (holds[where] & self.member[template]).argmax(1) if len(where) else where
        left = np.minimum(after[where, first], self.member[:, ::-1].cumsum(1)[:, ::-1][template, first])
        keep = left >= need  # positional filter
        template, where, need = template[keep], where[keep], need[keep]
        both = (holds[where] & self.member[template]).sum(1)
        keep = both >= need
        return blocks[where[keep]], template[keep], both[keep] / self.size[template[keep]]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, list]:
        text, position, token, words = self.find(data, offsets)
        block, template, share = self.join(text, position, token, words)
        n = len(words)
        owner = np.searchsorted(self.base, block * self.stride + self.stride, "right") - 1
        spots: list[list[tuple[int, int, str, float, bool]]] = [[] for _ in range(n)]
        for o, b, t, s in zip(owner.tolist(), block.tolist(), template.tolist(), share.tolist()):
            label, _, _, phrase = self.templates[t]
            start = b * self.stride - int(self.base[o])
            if not phrase:
                spots[o].append((max(start, 0), min(start + self.block, int(words[o])), label, s, False))
                continue
            lo, hi = np.searchsorted(self.line, [b * self.stride, b * self.stride + self.block])
            line, tok = self.line[lo:hi], token[lo:hi]
            want = self.phrase_tokens[t]
            for i in range(hi - lo - len(want) + 1):
                if line[i + len(want) - 1] - line[i] == len(want) - 1 and tok[i : i + len(want)].tolist() == want:
                    at = int(line[i] - self.base[o])
                    spots[o].append((at, at + len(want), label, 1.0, True))
        return {"n_words": words.tolist(), "spots": [sorted(set(s)) for s in spots]}


def find_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
    notices: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, block: int = BLOCK,
) -> DataFrame:
    """(id, n_words, spots): of each row the places of the phrases and the blocks that hold enough of a notice.

    spots: array of (start, end, label, share, phrase), word positions, end exclusive, in order. A block of words matches a
    notice if it holds at least ``threshold`` of its distinct words; it matches a phrase if its words stand in it
    one after another, which is looked up in the blocks that hold all of them. Every match is found: a block with enough
    of a template has one of the template's rarest words, rarest by the counts of all texts. Templates and their counts are of
    fixed size and go to the tasks in the closure.

    Null and empty text: no words, no spots. Rows are independent, so repeated rows, missing ids and ties change nothing; an empty table
    gives an empty result. Long texts are read in pieces, of which only template words are kept.
    """
    index = Index(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices, threshold, block)
    texts = docs.select(F.col(text_col).alias("_text"))

    def count(batches):
        total = np.zeros(len(index.vocabulary), np.int64)
        for b in batches:
            total += np.bincount(index.find(*utf8(b.column(0)))[2], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["token", "n"])

    counted = cut(texts.mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")), "frequency")
    index.sort({r.token: r.n for r in counted.collect()})  # one row per template word

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    spot = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64()), ("phrase", pa.bool_())]))

    def work(batches):
        for b in batches:
            data, offsets = utf8(b.column("_text"))
            lo = 0
            while lo < len(offsets) - 1:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
                got = index.scan(data, offsets[lo : hi + 1])
                rows = [[dict(zip(("start", "end", "label", "share", "phrase"), s)) for s in spots] for spots in got["spots"]]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), pa.array(got["n_words"], pa.int64()), pa.array(rows, spot)], names=["id", "n_words", "spots"]
                )
                lo = hi

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(work, f"id {kind}, n_words bigint, spots array<struct<start: bigint, end: bigint, label: string, share: double, phrase: boolean>>")
