"""Hierarchical packing of tokenised documents into sequences of several context sizes.

A document longer than the longest context gives full windows of it; what is left of it, like any shorter document, goes to the smallest
tier that holds it. Each tier's documents open windows of its size. A window's gap takes the longest waiting documents of shorter tiers
that fit, and last the first part of one that doesn't, so every window is full. What a task has left at its end is one run of tokens,
cut into windows of falling powers of two: no padding at all.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, bisect_right, insort
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import WordTable, remembered, sliced, text_bytes, tidy

CONTEXT = 4096
TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens of the sequences that make up one step.
STEP_TOKENS = 8 * CONTEXT
#: Bytes of words and their ids that a worker process remembers, whatever the words' lengths.
CACHE_BYTES = 192 << 20


def lower(text: bytes) -> bytes:
    """A-Z in lower case, as the vocabulary's own normaliser would: fewer words to remember. Special tokens are told by case."""
    return text if b"<|" in text else text.lower()


def by_word(vocabulary: dict) -> bool:
    """Whether a vocabulary's own file says that it lower cases, keeps no white space and so merges nothing across it."""
    steps = lambda part, name: [x for x in [part or {}] for x in x.get(name, [x])]
    normal = [x.get("type") for x in steps(vocabulary["normalizer"], "normalizers")]
    split = steps(vocabulary["pre_tokenizer"], "pretokenizers")[0]
    drops = split.get("type") == "Whitespace" or (split.get("type") == "Split" and (split.get("behavior"), split.get("invert")) == ("Removed", True) and not any(regex.search(split["pattern"]["Regex"], x) for x in " \t\n\r\x0b\x0c"))
    return "Lowercase" in normal and set(normal) <= {"NFC", "Replace", "Lowercase"} and drops and not any(x["lstrip"] or x["rstrip"] for x in vocabulary["added_tokens"])


_encoders: dict[tuple[str, int], WordEncoder] = remembered(__name__)


class WordEncoder:
    """Token ids of whole texts by way of a bounded table of the words met.

    For vocabularies that lower case, drop white space and merge nothing across it, which is read from the vocabulary's file: the ids of a text are those
    of its words, one after another. With any other vocabulary whole texts are encoded.
    """

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.by_word = by_word(json.loads(self.tokenizer.to_str()))
        self.table = WordTable(self._learn, self.kind, limit)

    @classmethod
    def of(cls, path: str, limit: int = CACHE_BYTES) -> WordEncoder:
        """The encoder of this process: tasks that follow one another share what was learnt."""
        if (path, limit) not in _encoders:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker is one core's
            _encoders[path, limit] = cls(path, limit)
        return _encoders[path, limit]

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)]
        many = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), self.kind, int(many.sum())), many, np.ones(len(got), bool)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows end to end, each row's followed by END_ID, and the rows' n + 1 offsets."""
        raw, at = text_bytes(column)
        parts, counts = [], []
        lo, n = 0, len(at) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 20), side="right")) - 1)
            texts = [raw[at[i] : at[i + 1]].tobytes() for i in range(lo, hi)]
            if self.by_word:
                rows = [lower(t).split() for t in texts]
                flat, ends = self.table.ids(self.table.find([w for r in rows for w in r]))
                row_end = ends[np.cumsum([len(r) for r in rows])]
            else:
                flat, many, _ = self._learn(texts)
                row_end = np.cumsum(many)
            parts.append(np.insert(flat, row_end, END_ID))
            counts.append(np.diff(np.concatenate([[0], row_end])) + 1)
            lo = hi
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        return np.concatenate(parts).astype("<u4"), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


class Packer:
    """Packs documents as they come. sequences: lists of (document, start, length), every list a full window."""

    def __init__(self, context: int = CONTEXT, tiers: tuple[int, ...] = TIERS):
        self.context, self.tiers = context, tiers
        self.waiting: list[tuple[int, int, int]] = []  # (length, document, start), ascending
        self.sequences: list[list[tuple[int, int, int]]] = []

    def add(self, document: int, length: int) -> None:
        start = 0
        while length - start >= self.context:
            self.sequences.append([(document, start, self.context)])
            start += self.context
        if length > start:
            insort(self.waiting, (length - start, document, start))

    def pack(self) -> None:
        """Packs windows as long as what waits can fill them."""
        total = sum(x[0] for x in self.waiting)
        while self.waiting and total >= (tier := next(t for t in self.tiers if t >= self.waiting[-1][0])):
            window, gap = [], tier
            while gap:
                k = bisect_right(self.waiting, (gap, 1 << 62, 0))
                if k:
                    size, document, start = self.waiting.pop(k - 1)
                    window.append((document, start, size))
                else:  # none fits: the first part of the shortest
                    rest, document, start = self.waiting.pop(0)
                    size = gap
                    window.append((document, start, size))
                    insort(self.waiting, (rest - size, document, start + size))
                gap -= size
            total -= tier
            self.sequences.append(window)

    def finish(self) -> None:
        left = sum(x[0] for x in self.waiting)
        for bit in range(left.bit_length() - 1, -1, -1):
            if gap := left & (1 << bit):
                window = []
                while gap:
                    size, document, start = self.waiting.pop()
                    take = min(size, gap)
                    window.append((document, start, take))
                    if take < size:
                        self.waiting.append((size - take, document, start + take))
                    gap -= take
                self.sequences.append(window)


class Steps:
    """Deals sequences into groups of STEP_TOKENS, longest first, each into the fullest group that it fits.

    Sizes are powers of two, so groups close exactly: of a task's groups, all but at most one for each size have STEP_TOKENS.
    """

    def __init__(self):
        self.groups = 0
        self.open: list[tuple[int, int]] = []  # (room, group), ascending

    def deal(self, sizes: list[int]) -> list[int]:
        out = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            k = bisect_left(self.open, (sizes[i], -1))
            if k < len(self.open):
                room, out[i] = self.open.pop(k)
            else:
                room, out[i] = STEP_TOKENS, self.groups
                self.groups += 1
            if room > sizes[i]:
                insort(self.open, (room - sizes[i], out[i]))
        return out


def pack(documents: DataFrame, tokenizer: str, key: str = "doc_id", context: int = CONTEXT, tiers: tuple[int, ...] = TIERS, with_ids: bool = False, remember: int = CACHE_BYTES) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group (and ids, if asked for).

    Each task packs the documents of its own partition, so nothing is shuffled, and a task that runs again packs alike. Null and empty texts
    are one token, the end. Repeated rows are packed as often as they come; a null key stays null. A worker process remembers words
    of so many bytes for its tasks.
    """

    def packed(batches):
        encoder, first = WordEncoder.of(tokenizer, remember), TaskContext.get().partitionId() << 33
        steps, number = Steps(), 0
        held: dict[int, tuple] = {}  # documents not wholly packed: number to (key, ids)
        packer = Packer(context, tiers)

        def closed():
            nonlocal number
            rows: list[tuple] = []
            for s, (window, group) in enumerate(zip(packer.sequences, steps.deal([sum(p[2] for p in w) for w in packer.sequences]), strict=True)):
                offset, size = 0, sum(p[2] for p in window)
                for document, start, length in window:
                    name, ids = held[document]
                    piece = ids[start : start + length]
                    rows.append((name, start, length, zlib.crc32(piece), len(ids), first + number + s, offset, size, first + group, piece))
                    offset += length
            number += len(packer.sequences)
            packer.sequences = []
            for document in held.keys() - {x[1] for x in packer.waiting}:
                del held[document]
            for lo in range(0, len(rows), 20_000):
                part = rows[lo : lo + 20_000]
                columns = [pa.array([x[0] for x in part], kind)] + [pa.array([x[i] for x in part], pa.int64()) for i in range(1, 9)]
                if with_ids:
                    columns.append(pa.array([x[9].astype(np.int32) for x in part], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

        count, kind = 0, pa.int64()
        for b in batches:
            kind = b.schema.field(key).type
            for part in sliced(b, limit=2 << 20):
                keys = part.column(key).to_pylist()
                ids, at = encoder.encode(part.column("text"))
                for i, name in enumerate(keys):
                    held[count] = name, ids[at[i] : at[i + 1]].copy()
                    packer.add(count, int(at[i + 1] - at[i]))
                    count += 1
                packer.pack()
                yield from closed()
        packer.finish()
        yield from closed()

    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids
    kind = documents.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"`{x}` long" for x in names[1:9]) + (", ids array<int>" if with_ids else "")
    return documents.select(key, "text").mapInArrow(tidy(packed), schema)
