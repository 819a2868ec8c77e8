"""Sum-of-squares online packing of token ids into windows.

Each task packs the documents of its partition in the order they come; nothing is shuffled. ``open_at[h]`` counts
the partly filled windows of level h. A piece of s tokens goes where it adds least to the sum of squares of those
counts: from level h to h + s it adds 2 * (open_at[h + s] - open_at[h] + 1), a new window 2 * open_at[s] + 1, and
filling one up -2 * open_at[h] + 1. What is open when the partition ends is cut to fill up all but one window, and
the rest of that one into powers of two, which take no padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import kept, rows_of, text_batches, thrifty

WINDOW = 4096
END_ID = 2

PIECES = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


class Encoder:
    """ids of a text as little-endian unsigned 32-bit bytes, equal to the tokenizer's.

    The tokenizer encodes each pre-token by itself, so ids of pre-tokens are remembered. Texts with characters
    beyond the set for which normalisation and splitting are restated here go to the tokenizer whole.
    """

    #: Pre-tokens remembered in each of two generations; the older one is forgotten when the newer one is full.
    REMEMBER = 120_000

    def __init__(self, path: str):
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        #: whether an id ends a pre-token
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.plain = re.compile(r"[\t\n\r\x20-\x7e\xc0-\xff]*").fullmatch
        #: Fixed value: the splitting pattern of the vocabulary file, over the plain characters.
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z\xdf-\xf6\xf8-\xff0-9]+").findall

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.plain(text):
            return self.whole(text)
        parts = self.split(text.lower())
        if new := set(parts).difference(self.known):
            if len(self.known) > self.REMEMBER:
                self.older, self.known, new = self.known, {}, set(parts)
            self.learn(new)
        return b"".join(map(self.known.__getitem__, parts))

    def learn(self, parts: set[str]) -> None:
        new = []
        for part in parts:
            if (code := self.older.get(part)) is not None:
                self.known[part] = code
            else:
                new.append(part)
        # one call for all: white space between pre-tokens is dropped, and each one's last id is marked
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4") if new else np.zeros(0, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(new):
            self.known.update((x, self.whole(x)) for x in new)
            return
        data, begin = ids.tobytes(), 0
        for part, stop in zip(new, (4 * stops).tolist(), strict=True):
            self.known[part] = data[begin:stop]
            begin = stop


def encoder(path: str) -> Encoder:
    """One for each Python worker: what a task has learned serves the next ones of this operator."""
    return kept("packing", path, lambda: Encoder(path))


class Piece:
    """Tokens [start, start + length) of a document."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, size: int) -> tuple[Piece, Piece]:
        """The first ``size`` tokens, and the rest."""
        return Piece(self.doc, self.start, self.ids[: 4 * size], self.total), Piece(self.doc, self.start + size, self.ids[4 * size :], self.total)


class Packer:
    """Sum-of-squares packing of a stream; ``done`` gets finished windows as lists of pieces."""

    def __init__(self, window: int = WINDOW, max_open: int | None = None):
        self.window, self.max_open = window, max_open
        self.open_at = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.count = 0
        self.done: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        while len(piece) > self.window:
            full, piece = piece.cut(self.window)
            self.done.append([full])
        level = self.level(len(piece))
        held = self.take(level) if level else []
        held.append(piece)
        self.put(level + len(piece), held)
        if self.max_open is not None and self.count > self.max_open:
            self.fill_up(self.max_open // 2)

    def level(self, size: int) -> int:
        """The level to put ``size`` tokens on; the fullest of equals, 0 for a new window."""
        counts, top = self.open_at, self.window - size
        cost = np.full(top + 1, np.iinfo(np.int64).max)
        levels = np.flatnonzero(counts[1 : top + 1]) + 1
        cost[levels] = 2 * (counts[levels + size] - counts[levels] + 1)
        if top and counts[top]:
            cost[top] = 1 - 2 * counts[top]
        cost[0] = 2 * counts[size] + 1 if top else 0
        return top - int(cost[::-1].argmin())

    def take(self, level: int) -> list[Piece]:
        self.open_at[level] -= 1
        self.count -= 1
        return self.open[level].pop()

    def put(self, level: int, held: list[Piece]) -> None:
        if level == self.window:
            self.done.append(held)
        else:
            self.open_at[level] += 1
            self.count += 1
            self.open.setdefault(level, []).append(held)

    def fill_up(self, keep: int) -> None:
        """Cuts what the emptiest windows hold to fill the fullest, until ``keep`` are open."""
        levels = np.repeat(np.arange(self.window + 1), self.open_at).tolist()
        low, high = 0, len(levels) - 1
        spare: list[Piece] = []
        while high - low + 1 > keep and high >= low:
            held, room = self.take(levels[high]), self.window - levels[high]
            high -= 1
            while room and (spare or low <= high):
                if not spare:
                    spare = self.take(levels[low])[::-1]
                    low += 1
                piece = spare.pop()
                if len(piece) > room:
                    piece, rest = piece.cut(room)
                    spare.append(rest)
                held.append(piece)
                room -= len(piece)
            self.put(self.window - room, held)
        if spare:
            self.put(sum(map(len, spare)), spare[::-1])

    def close(self) -> None:
        """Finishes every window: full ones, then powers of two."""
        self.fill_up(0)
        if self.count:
            self.fill_up(1)
        rest = [x for held in self.open.values() for pieces in held for x in pieces][::-1]
        self.open, self.count = {}, 0
        self.open_at[:] = 0
        left = sum(map(len, rest))
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            held = []
            while room:
                piece = rest.pop()
                if len(piece) > room:
                    piece, after = piece.cut(room)
                    rest.append(after)
                held.append(piece)
                room -= len(piece)
            self.done.append(held)

    def finished(self) -> list[list[Piece]]:
        out, self.done = self.done, []
        return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, max_open: int | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A null or empty text is the end id alone. Repeated rows are packed as often as they come, an empty table gives
    an empty result, and other columns are not read. Sequences belong to one partition: its number fills the upper
    bits of sequence_id. A task holds its open windows, at most the tokens of its own partition; with ``max_open`` it
    fills up all but half of them by cutting whenever more are open. Ties go to the fullest window. Rows without an id
    are packed like others.
    """
    text_batches(docs.sparkSession)
    import pyarrow as pa

    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *PIECES.fields]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)
    end = int(end_id).to_bytes(4, "little")

    def rows(windows: list[list[Piece]], base: int) -> list[list]:
        out = []
        for k, held in enumerate(windows, base):
            offset = 0
            for x in held:
                row = [x.doc, x.start, len(x), zlib.crc32(x.ids), x.total, k, offset]
                out.append(row + [np.frombuffer(x.ids, "<u4").astype(np.int64).tolist()] * with_ids)
                offset += len(x)
        return out

    def run(batches: Iterator) -> Iterator:
        encode, packer = encoder(tokenizer_path), Packer(window, max_open)
        number = TaskContext.get().partitionId() << 40
        id_type = types = None

        def told():
            nonlocal number
            windows = packer.finished()
            out = rows(windows, number)
            number += len(windows)
            columns = list(zip(*out, strict=True)) or [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)

        for batch in batches:
            id_type = id_type or batch.schema.field(0).type
            types = [id_type, *[pa.int64()] * 6, *[pa.list_(pa.int64())] * with_ids]
            for doc, text in rows_of(batch, id_col, text_col):
                ids = encode(text or "") + end
                packer.add(Piece(doc, 0, ids, len(ids) // 4))
            yield told()
        if types:
            packer.close()
            yield told()

    return docs.select(id_col, text_col).mapInArrow(thrifty(run, "packing"), schema)
