"""Token ids in files of length-delimited, checksummed binary records with an offset index.

A data file is a row of records, each

    length of the payload (u64) | masked checksum of these 8 bytes (u32) | payload | masked checksum of the payload (u32)

and a payload is

    1 if the document has an id, else 0 (u8) | id (i64) | bytes per token id, 2 or 4 (u8) | token ids

all little-endian. The checksum is CRC-32, masked as ((c >> 15) | (c << 17)) + 0xA282EAD8, so that a checksum of
data that holds checksums stays meaningful. The index of a data file holds, for every record, its byte offset and the number of token ids
before it in the file (u64 each): a reader in shuffled order seeks with it.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.common import utf8
from flowlens.tables import cut, new_path

_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b",.;:!?\"$%&*#)(/+-")] = True
_LETTER[65:91] = _LETTER[97:123] = True
HEAD = struct.Struct("<QI")
START = struct.Struct("<BqB")
#: Distinct pieces of text whose ids a worker remembers, bytes of text worked on at once, and bytes a reader holds.
PIECES, BLOCK, HELD = 200_000, 1 << 20, 1 << 23


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def payload_of(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return START.pack(doc_id is not None, doc_id or 0, width) + ids.astype("<u2" if width == 2 else "<u4").tobytes()


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = START.unpack_from(payload)
    return doc_id if known else None, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=START.size)


def read_one(stream) -> bytes | None:
    """The payload of the next record; None at the end. Damage and cut-off files raise."""
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("the file ends inside a record")
    size, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("the length of a record is damaged")
    payload = stream.read(size)
    tail = stream.read(4)
    if len(payload) < size or len(tail) < 4:
        raise ValueError("the file ends inside a record")
    if masked(payload) != struct.unpack("<I", tail)[0]:
        raise ValueError("a record is damaged")
    return payload


def read_at(path: str, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records of one file with the given numbers, in that order, by way of the offset index."""
    store, place = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(place + ".idx") as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    out = []
    with store.open_input_file(place) as f:
        for n in numbers:
            f.seek(int(index[n, 0]))
            out.append(parse(read_one(f)))
    return out


class Library:
    """Ids of texts by the tokenizers library, each distinct piece of a text encoded once.

    A text is cut where white space follows something else, and where a mark follows a letter. No token of the byte-level
    split crosses such a place, and the split of a piece depends on nothing outside it, so the ids of a text are those of its
    pieces in a row. New pieces that begin with white space are given to the library in a row as well; the bytes that
    each token stands for tell where one ends. Pieces are remembered in two generations, so that frequent ones stay known.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = len(token)  # one character of a byte-level token per byte
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.bytes[i] = len(token.content.encode())
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def cuts(data: np.ndarray) -> np.ndarray:
        """Where ASCII white space follows a character that is no white space of any kind, or a mark follows an ASCII letter.

        The apostrophe can begin a contraction and the bar can stand inside a special token, so they do not count as marks.
        """
        space = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
        p1, p2, p3 = (np.concatenate((np.zeros(k, np.uint8), data))[: len(data)] for k in (1, 2, 3))
        wide = ((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))) | (((p3 >= 0xE1) & (p3 <= 0xE3)) & np.isin(p2, (0x80, 0x81, 0x9A)))
        before = np.concatenate(([False], ~space[:-1]))
        return np.flatnonzero((space & before & ~wide) | (_MARK[data] & _LETTER[p1]))

    def look_up(self, new: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, as unsigned 32-bit numbers."""
        out = [b""] * len(new)
        row = [i for i, p in enumerate(new) if p[:1].isspace() and not p.decode()[-1].isspace() and p[-1] > 31]
        rest = set(range(len(new))) - set(row)
        for i in rest:
            out[i] = np.array(self._ids(new[i]), "<u4").tobytes()
        for lo in range(0, len(row), 4096):
            part = row[lo : lo + 4096]
            ids = np.array(self._ids(b"".join(new[i] for i in part)), "<u4")
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(new[i]) for i in part])) + 1
            data = ids.tobytes()
            for i, a, b in zip(part, [0, *(ends[:-1] * 4).tolist()], (ends * 4).tolist()):
                out[i] = data[a:b]
        return out

    def _ids(self, text: bytes) -> list[int]:
        return self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``data`` and the offsets of the texts in them."""
        lo = int(offsets[0])
        data, offsets = data[lo : int(offsets[-1])], offsets - lo
        mark = np.zeros(len(data) + 1, bool)
        mark[self.cuts(data)] = True
        mark[offsets] = True
        edges = np.flatnonzero(mark)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data.tobytes())])
        coded = pieces.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = coded.dictionary.to_pylist()
        ids = [self.known.get(p) for p in distinct]
        new = []
        for i in [i for i, found in enumerate(ids) if found is None]:
            if (found := self.older.get(distinct[i])) is None:
                new.append(i)
            else:
                ids[i] = self.known[distinct[i]] = found
        for i, found in zip(new, self.look_up([distinct[i] for i in new])):
            ids[i] = found
            if len(distinct[i]) <= 64:
                self.known[distinct[i]] = found
        if len(self.known) > PIECES:
            self.known, self.older = {}, self.known
        flat = np.frombuffer(b"".join(ids), "<u4")
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        n = count[code]
        before = np.concatenate(([0], np.cumsum(n)))
        begin = np.cumsum(count) - count
        out = flat[np.arange(before[-1]) - np.repeat(before[:-1], n) + np.repeat(begin[code], n)]
        return out, before[np.searchsorted(edges, offsets)]


_LIBRARIES: dict[str, Library] = {}


def library_of(path: str) -> Library:
    """The worker's own library, with what it remembers from earlier tasks."""
    if path not in _LIBRARIES:
        _LIBRARIES.clear()
        _LIBRARIES[path] = Library(path)
    return _LIBRARIES[path]


def write_records(
    docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """Write the token ids of every whole text in ascending id order; returns the written files, one row each.

    Rows are range-partitioned by id and, within one id, by a hash of the text, and sorted, so that rows of one id or without an id are no single task; a task encodes its range, block by block, and writes one data file and its index under
    names of its own, so that a repeated attempt disturbs nothing: only the files that the result names count. Result: (part,
    path, records, tokens, start), ``start`` counting the ids in all files before. ``folder`` may be on any store that pyarrow
    opens; the default is the shared checkpoint folder. The tokenizer file must be readable on every executor.

    Null text counts as empty; ``end_id`` closes every document, also an empty one. Rows without an id come first. Rows
    of one id are ordered by the hash of their text, then by text. An empty table writes no file. A text is encoded block by block, but the ids of one
    document are held together until its record is framed.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "records")
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    ordered = narrow.repartitionByRange("id", F.xxhash64("_text")).sortWithinPartitions("id", F.xxhash64("_text"), "_text")

    def write(batches):
        library, out, index, records, tokens, place = None, None, None, 0, 0, 0
        path = f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        for b in batches:
            data, offsets = utf8(b.column("_text"))
            names = b.column("id").to_pylist()
            lo = 0
            while lo < len(names):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1)
                if library is None:
                    library = library_of(tokenizer)
                    width = 2 if library.tokenizer.get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
                    store, where = pafs.FileSystem.from_uri(path)
                    store.create_dir(where.rpartition("/")[0], recursive=True)
                    out, index = store.open_output_stream(where), store.open_output_stream(where + ".idx")
                ids, at = library.encode(data, offsets[lo : hi + 1])
                for i in range(lo, hi):
                    mine = ids[at[i - lo] : at[i - lo + 1]]
                    if end_id is not None:
                        mine = np.append(mine, np.uint32(end_id))
                    record = frame(payload_of(names[i], mine, width))
                    index.write(struct.pack("<QQ", place, tokens))
                    out.write(record)
                    place, tokens, records = place + len(record), tokens + len(mine), records + 1
                lo = hi
        if records:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [path], "records": [records], "tokens": [tokens]})

    files = cut(ordered.mapInArrow(write, "part bigint, path string, records bigint, tokens bigint"), "files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_records(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids) of every record of the files, one task per file; ids as unsigned 32-bit little-endian numbers.

    Every record's checksums are verified. A reader holds a few records at a time.
    """
    files = cut(files.select("path", "start", "records", "tokens"), "files")
    n = files.count()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c, d = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    def records(path: str, start: int) -> Iterator[tuple]:
        store, where = pafs.FileSystem.from_uri(path)
        with store.open_input_stream(where, buffer_size=1 << 20) as stream:
            while (payload := read_one(stream)) is not None:
                doc_id, ids = parse(payload)
                yield doc_id, start, len(ids), ids.astype("<u4").tobytes()
                start += len(ids)

    def work(batches):
        for b in batches:
            for path, start, count, tokens in zip(*(b.column(i).to_pylist() for i in range(4))):
                rows, held, seen, total = [], 0, 0, 0
                for row in records(path, start):
                    rows.append(row)
                    held, seen, total = held + 4 * row[2], seen + 1, total + row[2]
                    if held >= HELD:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)
                if (seen, total) != (count, tokens):
                    raise ValueError(f"{path} holds {seen} records with {total} ids, {count} with {tokens} were written")

    return files.repartition(max(n, 1)).mapInArrow(work, "id bigint, start bigint, n_tokens bigint, ids binary")
