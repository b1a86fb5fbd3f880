"""BPE encoding and decoding with an automaton compiled from the merges."""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections import namedtuple
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowlens.llm.common import packed, unpacked

#: The split pattern of the vocabularies that this encoder reads, and its contractions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHORT, LONG = "stmd", ("re", "ve", "ll")
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Characters worked on at once, bytes of the words that run through the tables side by side (longer ones run alone), and cells of such a run.
BLOCK, LANE, CELLS = 1 << 19, 128, 1 << 20
#: Answers of the transition test that are kept: 2^KEPT slots, in each the last one that fell there.
KEPT = 19

Automaton = namedtuple("Automaton", "left rank parent created excluded target")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


def allowed(a, state: int, token: int) -> bool:
    """Has ``state`` a transition on ``token``?

    The start state has all. A state made by the rule (u, v) is a copy of its parent without v. A token that is newer
    than the state was added to it if and only if the state had the left part of the token.
    """
    while state:
        if a.rank[token] < a.created[state]:
            if token == a.excluded[state]:
                return False
            state = a.parent[state]
        else:
            token = a.left[token]
    return True


def compile_merges(n_tokens: int, merges: list[tuple[int, int, int]]) -> Automaton:
    """The automaton whose paths are exactly the token sequences that the merges produce.

    At first one state loops on every base symbol. The gadget of the rule (u, v) -> t, in order of the merges, copies the
    state that u leads to without its transition on v, lets u lead to the copy, and adds t wherever u can be read,
    leading where v led. Every token leads to one state, so a rule adds one state; copies share what they have in common through their parent.
    """
    a = Automaton([-1] * n_tokens, [-1] * n_tokens, [0], [-1], [-1], [0] * n_tokens)
    made = [False] * n_tokens
    for rank, (u, v, t) in enumerate(merges):
        if made[t] or a.rank[u] >= rank or a.rank[v] >= rank:
            raise ValueError("a merge stands before its parts or makes a token a second time")
        a.left[t], a.rank[t], made[t] = u, rank, True
    for rank, (u, v, t) in enumerate(merges):
        if a.target[u] < 0 or a.target[v] < 0 or not allowed(a, a.target[u], v):
            a.target[t] = -1  # its parts never meet
            continue
        a.target[t] = a.target[v]
        a.parent.append(a.target[u])
        a.created.append(rank)
        a.excluded.append(v)
        a.target[u] = len(a.parent) - 1
    return a


class Transitions:
    """Has the state behind a token a transition on another token? The automaton's answers, without walking its states one by one.

    The states behind token x are copies that the rules (x, v) made, on top of the state that the right part of x led to when x was made. So
    a transition on y is missing if and only if a rule joins a token of the right spine of x with one of the left spine of
    y before the rules that hide these two: going down from (x, y), the younger of the two is taken apart, and a rule for the pair that is
    left counts if it is older than what was taken apart last. The rule that made y counts too (of three equal symbols the first two are
    joined), the one that made x does not. Answers are kept in a table of fixed size.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.left, self.right, self.rank, self.n = left, right, rank, len(rank)
        made = np.flatnonzero(rank >= 0)
        key = left[made] * self.n + right[made]
        order = np.argsort(key)
        self.rule, self.when = np.append(key[order], -1), np.append(rank[made][order], 0)
        self.keys, self.answers = np.full(1 << KEPT, -1, np.int64), np.zeros(1 << KEPT, bool)

    def computed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        at, limit = np.arange(len(x)), np.full(len(x), self.n, np.int64)
        while len(at):
            key = x * self.n + y
            place = np.searchsorted(self.rule[:-1], key)
            missing = (self.rule[place] == key) & (self.when[place] < limit)
            out[at[missing]] = False
            a, b = self.rank[x], self.rank[y]
            on = ~missing & ((a >= 0) | (b >= 0))
            at, x, y, a, b = at[on], x[on], y[on], a[on], b[on]
            first = a > b
            x, y, limit = np.where(first, self.right[x], x), np.where(first, y, self.left[y]), np.where(first, a, b + 1)
        return out

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """x = -1 is the start state, which has all transitions."""
        key = x.astype(np.int64) * self.n + y
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KEPT)).astype(np.int64)
        out = self.answers[slot] | (x < 0)
        new = np.flatnonzero((self.keys[slot] != key) & (x >= 0))
        if len(new):
            distinct, inverse = np.unique(key[new], return_inverse=True)
            answer = self.computed(distinct // self.n, distinct % self.n)
            out[new] = answer[inverse]
            self.keys[slot[new]], self.answers[slot[new]] = key[new], out[new]
        return out


class Ends:
    """Which tokens end at a place of a word: flat tables over the tokens' bytes.

    A state is the longest stretch of a word read so far with which a token begins. ``step`` holds the next state by the row of a state and the class
    of the byte, ``closing`` the state in which a word ends, ``longest`` the longest token that ends in a state, and ``shorter``, by token,
    the longest one that ends it.
    """

    def __init__(self, tokens: list[tuple[bytes, bool, int]], n_tokens: int):
        trie: dict[int, int] = {}  # by state and symbol
        parent, symbol, depth, own = [0], [0], [0], [-1]
        for body, last, token in tokens:
            at = 0
            for c in [*body, 256] if last else body:
                key = at * 257 + c
                if key not in trie:
                    trie[key] = len(own)
                    parent.append(at)
                    symbol.append(c)
                    depth.append(depth[at] + 1)
                    own.append(-1)
                at = trie[key]
            own[at] = token
        parent, symbol, depth = np.array(parent), np.array(symbol), np.array(depth)
        inside = symbol < 256  # a word's end leads nowhere
        number = np.cumsum(inside) - 1
        n = int(inside.sum())
        # Bytes that only begin tokens lead to one state from everywhere.
        deep = np.unique(symbol[(depth > 1) & inside])
        self.kind = np.full(256, len(deep), np.int64)
        self.kind[deep] = np.arange(len(deep))
        self.begins = np.zeros(256, np.int32)
        roots = (depth == 1) & inside
        self.begins[symbol[roots]] = number[roots]
        self.step = np.zeros((n, len(deep) + 1), np.int32)
        self.closing = np.full(n, -1, np.int32)
        end_of = np.full(n, -1, np.int32)  # the final token whose body is the path of the state
        fail = np.zeros(n, np.int32)
        self.longest = np.full(n, -1, np.int32)
        self.shorter = np.full(n_tokens, -1, np.int32)
        self.length = np.zeros(n_tokens, np.int64)
        own = np.array(own)
        leads = ~inside
        end_of[number[parent[leads]]] = own[leads]
        self.step[0, self.kind[symbol[roots]]] = number[roots]
        self.step[0, len(deep)] = 0
        for d in range(int(depth.max()) + 1):
            level = np.flatnonzero((depth == d) & inside)
            here, up = number[level], number[parent[level]]
            if d > 1:
                fail[here] = self.step[fail[up], self.kind[symbol[level]]]
            if d:
                self.step[here] = self.step[fail[here]]
            below = np.flatnonzero((depth == d + 1) & inside)
            if d:
                self.step[number[parent[below]], self.kind[symbol[below]]] = number[below]
            inner, final = own[level], end_of[here]
            inner = np.where(level > 0, inner, -1)
            back = self.longest[fail[here]] if d else np.full(len(here), -1)
            close = self.closing[fail[here]] if d else np.full(len(here), -1)
            self.longest[here] = np.where(inner >= 0, inner, back)
            self.closing[here] = np.where(final >= 0, final, close)
            self.shorter[inner[inner >= 0]] = back[inner >= 0]
            self.shorter[final[final >= 0]] = close[final >= 0]
            self.length[inner[inner >= 0]] = d
            self.length[final[final >= 0]] = d

        # A state that nothing goes on from has the row of the longest stretch that ends it.
        inner = np.zeros(n, bool)
        inner[number[parent[inside]]] = True
        self.row = (np.cumsum(inner) - 1).astype(np.int32)
        for d in range(1, int(depth.max()) + 1):
            last = number[np.flatnonzero((depth == d) & inside)]
            last = last[~inner[last]]
            self.row[last] = self.row[fail[last]]
        self.step = self.step[inner]

    def after(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        kind = self.kind[byte]
        return np.where(kind == self.step.shape[1] - 1, self.begins[byte], self.step[self.row[state], kind])


@lru_cache(maxsize=2)
def load(path: str) -> dict:
    """Tables of a tokenizer file, compiled: automaton, token bytes, labels, special tokens, character classes."""
    from tokenizers import Regex, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    if split != PATTERN or not end or spec["decoder"] is not None or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: another kind of tokenizer")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    merges = [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs]
    size = max([*vocab.values(), *[t["id"] for t in spec["added_tokens"]]]) + 1
    labels = [""] * size
    for token, i in [*vocab.items(), *[(t["content"], t["id"]) for t in spec["added_tokens"]]]:
        labels[i] = token
    # The class of every character as the library's own pattern has it: does it join a letter, join a mark, stand alone?
    # Private characters and the planes that Unicode has not begun to fill are marks.
    points = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Co", "Cs") and (ord(c) < 0x40000 or unicodedata.category(c) != "Cn")]
    splitter = pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True)
    classes = np.full(0x110000, OTHER, np.uint8)
    classes[[ord(c) for c in points]] = SPACE
    place = np.zeros(0x110000, np.int64)
    for lo in range(0, len(points), 20_000):
        for piece, _ in splitter.pre_tokenize_str("".join(f"{c}a\n!{c}\n" for c in points[lo : lo + 20_000])):
            if len(piece) == 1:
                place[ord(piece)] += 1
            elif piece[1] == "a":
                classes[ord(piece[0])] = LETTER
            else:
                classes[ord(piece[1])] = OTHER
    alone = (place > 0) & (classes == SPACE)
    classes[alone] = NUMBER
    parts = np.full((3, size), -1, np.int64)
    for rank, (u, v, t) in enumerate(merges):
        parts[:, t] = u, v, rank
    return {"automaton": compile_merges(size, merges), "parts": parts, "vocab": vocab, "end": end, "labels": labels, "classes": classes.tobytes(),
            "special": {t["content"]: t["id"] for t in spec["added_tokens"]}, "normalizer": json.dumps(spec["normalizer"])}


class Encoder:
    """Encodes and decodes with the compiled tables; built once in a worker."""

    def __init__(self, tables: dict):
        from tokenizers import Tokenizer

        self.a, self.labels = tables["automaton"], tables["labels"]
        self.classes = np.frombuffer(tables["classes"], np.uint8)
        byte = {s: b for b, s in enumerate(byte_symbols())}
        end = tables["end"]
        tokens = []
        for token, i in tables["vocab"].items():
            if self.a.target[i] >= 0:
                last = token.endswith(end) and len(token) > len(end)
                body = token[: -len(end)] if last else token
                if all(c in byte for c in body):
                    tokens.append((bytes(byte[c] for c in body), last, i))
        self.ends, self.transition = Ends(tokens, len(self.labels)), Transitions(*tables["parts"])
        self.special = tables["special"]
        spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": json.loads(tables["normalizer"]), "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}
        self.normal = Tokenizer.from_str(json.dumps(spec)).normalizer

    def _lanes(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paths of words that are sorted by size, longest first: their tokens one behind another, and how many each word has.

        The path of a prefix is a prefix of paths, so one token per place is enough: that one of the tokens ending there which the
        state at its start has a transition on, longest first. All words take a step at once.
        """
        m, most, ends = len(size), int(size[0]), self.ends
        token = np.full((most + 1, m), -1, np.int32)
        state = np.zeros(m, np.int32)
        active = np.searchsorted(-size, -np.arange(most + 2), "right")  # words of at least so many bytes
        for i in range(1, most + 1):
            k, on = active[i], active[i + 1]
            state = ends.after(state[:k], data[start[:k] + (i - 1)])
            found = np.concatenate((ends.longest[state[:on]], ends.closing[state[on:k]]))
            lane = np.arange(k)
            while len(lane):
                if found.min() < 0:
                    at = lane[found.argmin()]
                    raise ValueError(f"no path for {data[start[at] : start[at] + size[at]].tobytes()!r}")
                fits = self.transition(token[i - ends.length[found], lane], found)
                token[i, lane[fits]] = found[fits]
                lane, found = lane[~fits], ends.shorter[found[~fits]]
        steps, lane, place = [], np.arange(m), size.copy()
        while len(lane):
            t = token[place, lane]
            row = np.full(m, -1, np.int32)
            row[lane] = t
            steps.append(row)
            place = place - ends.length[t]
            lane, place = lane[place > 0], place[place > 0]
        paths = np.stack(steps[::-1], 1)
        return paths[paths >= 0], (paths >= 0).sum(1)

    def _alone(self, word: np.ndarray) -> np.ndarray:
        """The path of one long word."""
        ends, n = self.ends, len(word)
        token, state = [-1], 0
        kept: dict[tuple[int, int], bool] = {}
        for i, c in enumerate(word.tolist(), 1):
            kind = ends.kind[c]
            state = ends.begins[c] if kind == ends.step.shape[1] - 1 else ends.step[ends.row[state], kind]
            t = int((ends.longest if i < n else ends.closing)[state])
            while True:
                if t < 0:
                    raise ValueError(f"no path for {word.tobytes()[:100]!r}")
                before = token[i - int(ends.length[t])]
                if (before, t) not in kept:
                    kept[before, t] = bool(self.transition(np.array([before]), np.array([t]))[0])
                if kept[before, t]:
                    break
                t = int(ends.shorter[t])
            token.append(t)
        path = []
        while n:
            path.append(token[n])
            n -= int(ends.length[token[n]])
        return np.array(path[::-1], np.int32)

    def paths(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, the only path of the automaton that spells it; the words lie in ``data`` between the places ``at``.

        Returns the tokens of all paths one behind another and where each word's begin.
        """
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        flat, count = [], np.zeros(len(size), np.int64)
        lo = int((size[order] > LANE).sum())
        for w in order[:lo].tolist():
            flat.append(self._alone(data[at[w] : at[w + 1]]))
            count[w] = len(flat[-1])
        while lo < len(order):
            hi = lo + max(1, CELLS // (int(size[order[lo]]) + 1))
            some = order[lo:hi]
            path, count[some] = self._lanes(data, at[some], size[some])
            flat.append(path)
            lo = hi
        # The paths stand in the order of sizes; each moves to its word's place.
        begin = np.concatenate(([0], np.cumsum(count)))
        own = count[order]
        out = np.zeros(begin[-1], np.int32)
        if len(own):
            out[np.arange(begin[-1]) - np.repeat(np.cumsum(own) - own, own) + np.repeat(begin[order], own)] = np.concatenate(flat)
        return out, begin

    def normalise(self, text: str) -> str:
        return text.lower() if text.isascii() else self.normal.normalize_str(text)

    def pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All pieces of normalised texts, spaces included, as one array over their bytes; is each a word; the first piece of each text."""
        joined = "".join(texts)
        data = joined.encode("utf-8", "surrogatepass")
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        kind = self.classes[points]
        begin = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        start = np.ones(n + 1, bool)
        start[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        start[begin] = True
        at = np.flatnonzero(points == 39)
        at = at[start[at] & (kind[at] == OTHER)]
        at = at[start[at + 1]]  # the apostrophe is a run of its own
        room = begin[np.searchsorted(begin, at, "right")] - at - 1 if len(at) else at
        padded = np.concatenate((points, np.zeros(3, np.uint32)))
        one, two = padded[at + 1], padded[at + 2]
        size = np.where((room >= 1) & np.isin(one, [ord(c) for c in SHORT]), 2, 0)
        for a, b in LONG:
            size = np.where((room >= 2) & (one == ord(a)) & (two == ord(b)), 3, size)
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        start[at + size] = True
        cut = np.flatnonzero(start)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.concatenate(([0], np.cumsum(width)))[cut]
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(place.astype(np.int64)), pa.py_buffer(data)])
        return pieces, kind[cut[:-1]] != SPACE, np.searchsorted(cut, begin)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts, where each text begins in them, and the decoded texts."""
        segments, owner, ids_of = [], [], []
        for i, text in enumerate(texts):
            for part in self._parts(text):
                special = self.special.get(part)
                ids_of.append(special)
                segments.append("" if special is not None else self.normalise(part))
                owner.append(i)
        pieces, word, first = self.pieces(segments)
        coded = pieces.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        used = np.zeros(len(coded.dictionary), bool)
        used[code[word]] = True
        flat, begin = self.paths(*binary(coded.dictionary.filter(pa.array(used))))
        n_of = np.zeros(len(used), np.int64)
        n_of[used] = np.diff(begin)
        begin = np.cumsum(n_of) - n_of
        n = np.where(word, n_of[code], 0) if len(code) else np.zeros(0, np.int64)
        before = np.concatenate(([0], np.cumsum(n)))
        out = flat[np.arange(before[-1]) - np.repeat(before[:-1], n) + np.repeat(begin[code], n)] if len(code) else flat
        per = before[first]  # where each segment begins
        at = [(k, i) for k, i in enumerate(ids_of) if i is not None]
        owner = np.array(owner, np.int64)
        count = np.diff(per)
        for k, _ in at:
            count[k] = 1
        total = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        if at:
            out = np.insert(out, per[[k for k, _ in at]], [i for _, i in at])
        offsets = np.concatenate(([0], np.cumsum(total)))
        return out, offsets, self.decode(out, offsets)

    def _parts(self, text: str) -> list[str]:
        """The text cut at special tokens, which stand for themselves."""
        if not any(s in text for s in self.special):
            return [text]
        import regex

        return [p for p in regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text) if p] or [""]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The labels of the arcs, with a space between two."""
        if not hasattr(self, "spaced"):
            self.spaced = pa.array([x + " " for x in self.labels], pa.large_string())
        text = self.spaced.take(pa.array(ids))
        place = np.frombuffer(text.buffers()[1], np.int64)[offsets]
        data = memoryview(text.buffers()[2]) if len(ids) else memoryview(b"")
        return [str(data[a : max(a, b - 1)], "utf-8") for a, b in zip(place[:-1].tolist(), place[1:].tolist())]


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of large binary values and where each begins in them."""
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8), at


_ENCODERS: dict[str, Encoder] = {}


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the token ids of every whole text (array<int>) and the text that decoding them gives.

    The driver compiles the file at ``path``; the tables, whose size is that of the vocabulary, are broadcast. Null and empty
    texts have no ids and decode to the empty text. Special tokens of the file that stand in a text are encoded as such.
    Rows are independent: repeated rows and rows without an id are encoded alike, an empty table stays empty. An existing column
    named like a new one is replaced. A very long text is worked on alone, in time proportional to its length.
    """
    tables = docs.sparkSession.sparkContext.broadcast(load(path))
    key = uuid.uuid4().hex
    source = packed(docs, text_col, (ids, decoded))
    schema = T.StructType([source.schema["_row"], T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def work(batches):
        encoder = _ENCODERS.get(key)
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[key] = Encoder(tables.value)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = part.column("_text").to_pylist()
                at = 0
                while at < len(texts):
                    end, size = at, 0
                    while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
                        size += len(texts[end])
                        end += 1
                    got, offsets, back = encoder.encode(texts[at:end])
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(got, pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column("_row").slice(at, end - at), lists, pa.array(back, pa.string())], names=["_row", ids, decoded])
                    at = end

    return unpacked(source.mapInArrow(work, schema), ids, decoded)
