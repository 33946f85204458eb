"""SentencePiece models on the tokenizers library: the model file is parsed here, and texts are encoded and decoded by a tokenizer rebuilt from it.

The normaliser, the marker for spaces, the scores (of unigram models; of BPE models, as the order of merges) and byte fallback are taken from
the model. Parity with the reference implementation of the format is checked for every text, not assumed.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import WordTable, remembered, sliced, text_bytes

MARK = "▁"
#: Bytes of words and their ids that a worker process remembers, whatever the words' lengths.
CACHE_BYTES = 320 << 20
#: Words encoded as one stretch: no piece goes on from one into the next.
STRETCH = 128
# fixed values of the format: kinds of pieces, and the numbers of its fields
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECE, TRAINER, NORMALIZER = 1, 2, 3
UNIGRAM, BPE = 1, 2


def fields(raw: bytes):
    """(number, value) of each field of a protobuf message: an int, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if kind == 2:
            size = varint()
        if size is None:
            raise ValueError(f"field {tag >> 3} has wire type {kind}")
        yield tag >> 3, raw[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True

    @property
    def unk_id(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def parse(raw: bytes) -> Model:
    out = Model()
    for number, value in fields(raw):
        if number == PIECE:
            p = dict(fields(value))
            out.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif number == TRAINER:
            t = dict(fields(value))
            out.kind, out.byte_fallback = t.get(3, UNIGRAM), bool(t.get(35, 0))
        elif number == NORMALIZER:
            t = dict(fields(value))
            out.charsmap, out.dummy_prefix, out.trim, out.escape = t.get(2, b""), bool(t.get(3, 1)), bool(t.get(4, 1)), bool(t.get(5, 1))
    return out


def build(model: Model, whole: bool = True):
    """The tokenizer of the model. whole: for texts, with normaliser and decoder; else for stretches that are normalised already."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        merges = []
        for piece, score, kind in model.pieces:
            if kind in (NORMAL, USER_DEFINED) and len(piece) > 1:
                merges += [(-score, vocab[piece], i, piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in vocab and piece[i:] in vocab]
        merges.sort()
        core = models.BPE(vocab=vocab, merges=[m[3:] for m in merges], unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    out = Tokenizer(core)
    if whole:
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.trim:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if model.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if model.escape else " "))
        if model.escape:
            steps.append(normalizers.Replace(" ", MARK))
        out.normalizer = normalizers.Sequence(steps)
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return out


def _words(text: bytes) -> list[bytes]:
    """The words of a text with a space put before it, each with the spaces before it but one."""
    if b"  " in text or text[:1] == b" " or text[-1:] == b" ":
        return [w[1:] for w in re.findall(rb" +[^ ]*", b" " + text)]
    return text.split(b" ") if text else []


_codecs: dict[str, Codec] = remembered(__name__)


class Codec:
    """Encodes and decodes whole texts. Where no piece goes on past a word into the next space, words are encoded once and remembered."""

    def __init__(self, raw: bytes):
        self.model = parse(raw)
        self.tokenizer = build(self.model)
        m = self.model
        self.by_word = any(p == MARK for p, _, _ in m.pieces) and not m.charsmap and not m.trim and m.dummy_prefix and m.escape and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, k in m.pieces if k in (NORMAL, USER_DEFINED))
        self.words = build(self.model, whole=False) if self.by_word else None
        self.table = WordTable(self._learn, np.int32, CACHE_BYTES)  # the flag of a word: whether its ids decode to it
        self.starts = np.array([p.startswith(MARK) for p, _, _ in m.pieces], bool)

    @classmethod
    def of(cls, path: str, threads: int = 1) -> Codec:
        """The codec of this process: tasks that follow one another share what was learnt. Batches are encoded by so many threads."""
        if path not in _codecs:
            os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
            with open(path, "rb") as f:
                _codecs[path] = cls(f.read())
        return _codecs[path]

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words end to end, how many each has, and whether they decode to it."""
        plain = [w.decode("utf-8") for w in words]
        one = np.fromiter((w != "" and " " not in w for w in plain), bool, len(words))  # words whose first piece alone starts with the mark
        order = np.concatenate([np.flatnonzero(one), np.flatnonzero(~one)]).tolist()
        n = int(one.sum())
        stretches = [order[i : min(i + STRETCH, n)] for i in range(0, n, STRETCH)]
        joint = len(stretches)
        stretches += [[i] for i in order[n:]]
        got = [e.ids for e in self.words.encode_batch_fast(["".join(MARK + plain[i].replace(" ", MARK) for i in s) for s in stretches], add_special_tokens=False)]
        many = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.int32, int(many.sum()))
        back = self.tokenizer.decode_batch(got, skip_special_tokens=False)  # the decoder takes the space before a text away
        good = np.ones(len(words), bool)
        for s, g, b in zip(stretches, got, back, strict=True):
            if b != " ".join(plain[i] for i in s):  # some word's ids decode to something else
                edges = [*np.flatnonzero(self.starts[g]).tolist(), len(g)] if len(s) > 1 else [0, len(g)]
                each = self.tokenizer.decode_batch([g[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)], skip_special_tokens=False)
                good[s] = [x == plain[i] for x, i in zip(each, s, strict=True)]
        past = np.concatenate([[0], np.cumsum(many)])[joint:]  # where the joint stretches end, and each other one
        at = np.concatenate([np.flatnonzero(self.starts[flat[: past[0]]]), past])
        size = np.diff(at)
        if len(size) != len(words):
            raise ValueError("a word's pieces don't start where the word does")
        # from the order of encoding back to that of the words
        rank = np.argsort(order)
        ends = np.concatenate([[0], np.cumsum(size[rank])])
        return flat[np.arange(len(flat)) + np.repeat(at[:-1][rank] - ends[:-1], size[rank])], size[rank], good

    def encode(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """int32 ids of each text (UTF-8), and whether they decode to it. An empty text has none.

        A text's words decode one by one: no character's bytes, and no piece, are in two of them.
        """
        if not self.by_word:
            plain = [t.decode("utf-8") for t in texts]
            ids = [np.array(e.ids, np.int32) if t else np.zeros(0, np.int32) for t, e in zip(texts, self.tokenizer.encode_batch(plain, add_special_tokens=False), strict=True)]
            return ids, np.array([d == p.replace(MARK, " ") for d, p in zip(self.decode(ids), plain, strict=True)], bool)
        mark = MARK.encode()
        rows = [_words(t.replace(mark, b" ")) for t in texts]
        index = self.table.find([w for r in rows for w in r])
        flat, ends = self.table.ids(index)
        at = ends[np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)]
        good = np.ones(len(texts), bool)
        good[np.repeat(np.arange(len(rows)), [len(r) for r in rows])[~self.table.good[index]]] = False
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], good

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


def encode(documents: DataFrame, path: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_crc32, round_trip, parity (and ids, decoded, if asked for) of every row; a null text is empty.

    round_trip: decoding gives the text back, its spaces' marker read as a space. parity: the format's own library gives the same ids.
    """

    def encoded(batches):
        import sentencepiece

        threads = TaskContext.get().cpus()  # as many as the cluster gives a task
        codec, judge = Codec.of(path, threads), sentencepiece.SentencePieceProcessor(model_file=path)
        for b in batches:
            for part in sliced(b, limit=1 << 20):
                raw, at = text_bytes(part.column("text"))
                texts = [raw[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)]
                ids, good = codec.encode(texts)
                plain = [t.decode("utf-8") for t in texts]
                other = judge.encode(plain, num_threads=threads)
                columns = [
                    part.column(key), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64()),
                    pa.array(good), pa.array([x.tolist() == y for x, y in zip(ids, other, strict=True)]),
                ]
                if with_ids:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(codec.decode(ids), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "n_tokens", "ids_crc32", "round_trip", "parity"] + ["ids", "decoded"] * with_ids
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean" + (", ids array<int>, decoded string" if with_ids else "")
    return documents.select(key, "text").mapInArrow(encoded, schema)
