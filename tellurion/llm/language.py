"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to MAX_ORDER. The frozen counts of a tree give every byte of a text an exact
code length: -log2 of its share among the bytes seen in the longest known context, or an escape to the next shorter context
(method C: as many escapes as there are distinct bytes there), down to equal shares of all 256 bytes. The language whose tree
codes the text shortest is predicted.

Scoring walks no tree: the code lengths of every gram that any tree has seen are worked out once, for all languages, and kept in a table of
hashes; a text's bytes are looked up there all at once, first with the longest context, then those not found with shorter ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import U64, sliced, text_bytes, tidy

MAX_ORDER = 4
#: About as many documents of a language, and bytes of them, are learnt from at most, chosen by the hash of their ids.
TRAIN_ROWS, TRAIN_BYTES = 1_500, 6_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(33), *range(33, 65), *range(91, 97), *range(123, 128)]] = 32  # digits, signs and white space tell no language


def fold(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, every run of bytes that are no letters one space, and a space before each text."""
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1)
    out = np.full(len(raw) + n, 32, np.uint8)
    mark = np.ones(len(out), bool)
    mark[at[:-1]] = False
    out[mark] = _FOLD[raw]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[at[:-1]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def _grams(b: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """order + 1 bytes as a number, of every place in a text that has so many before it."""
    if len(b) <= order:
        return np.zeros(0, np.int64)
    key = np.zeros(len(b) - order, np.int64)
    for j in range(order + 1):
        key = key << 8 | b[j : len(b) - order + j]
    row = np.searchsorted(at, np.arange(len(b)), side="right")
    return key[row[order:] == row[: len(b) - order]]


def count_grams(langs: list[str]):
    """(lang, order, gram, n) partial counts of each batch; lang is the place in langs."""

    def run(batches):
        for b in (x for whole in batches for x in sliced(whole, limit=1 << 20)):
            of = np.array([langs.index(x) for x in b.column("lang").to_pylist()])
            for lang in np.unique(of).tolist():
                bytes_, at = fold(*text_bytes(b.column("text").filter(pa.array(of == lang))))
                for order in range(MAX_ORDER + 1):
                    gram, n = np.unique(_grams(bytes_, at, order), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), lang, np.int32)), pa.array(np.full(len(gram), order, np.int32)), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "order", "gram", "n"])

    return run


class Hashed:
    """Where each of some distinct numbers stands, by open addressing in a table at most half full."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        waiting, cell = np.arange(len(keys)), self._cell(keys)
        while len(waiting):
            free = self.at[cell] < 0
            self.at[cell[free]] = waiting[free]  # of several for one cell, one stays
            won = self.at[cell] == waiting
            self.keys[cell[won]] = keys[waiting[won]]
            waiting, cell = waiting[~won], cell[~won] + 1 & self.mask

    def _cell(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(U64) * U64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number, -1 for those that aren't there."""
        cell = self._cell(keys)
        there = self.keys[cell]
        out = np.where(there == keys, self.at[cell], np.int32(-1))
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            cell_ = cell[rest] = cell[rest] + 1 & self.mask
            there = self.keys[cell_]
            hit = there == keys[rest]
            out[rest[hit]] = self.at[cell_[hit]]
            rest = rest[~hit & (there >= 0)]
        return out


class Trees:
    """The frozen trees of all languages. By order: the grams that any has seen, with their code lengths in bits by language; and the contexts, with
    the lengths of their escapes. A gram that a language hasn't seen after its context costs an escape and what the shorter context gives."""

    def __init__(self, langs: list[str], grams: list[list[tuple[np.ndarray, np.ndarray]]]):
        """grams[language][order]: ascending grams and their counts."""
        self.langs = langs
        self.cost, self.escape, self.grams, self.contexts = [], [], [], []
        keys = None
        for order in range(MAX_ORDER + 1 if langs else 0):
            shorter, keys = keys, np.unique(np.concatenate([per[order][0] for per in grams]))
            context = np.unique(keys >> 8)
            cost = np.full((len(keys), len(langs)), 8.0) if not order else self.cost[-1][np.searchsorted(shorter, keys & ((1 << 8 * order) - 1))].astype(float)
            escape = np.zeros((len(context), len(langs)))
            of = np.searchsorted(context, keys >> 8)
            for li, per in enumerate(grams):
                gram, n = per[order]
                own = np.searchsorted(context, gram >> 8)
                total, kinds = np.bincount(own, n, minlength=len(context)), np.bincount(own, minlength=len(context))
                known = total > 0
                escape[known, li] = -np.log2(kinds[known] / (total[known] + kinds[known]))
                cost[:, li] += escape[of, li]
                cost[np.searchsorted(keys, gram), li] = -np.log2(n / (total[own] + kinds[own]))
            self.cost.append(cost.astype(np.float32))
            self.escape.append(escape.astype(np.float32))
            self.grams.append(Hashed(keys))
            self.contexts.append(Hashed(context))

    def lengths(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(bits a row and language, coded bytes a row) of whole texts."""
        raw, offsets = text_bytes(column)
        b, at = fold(raw, offsets)
        n = len(at) - 1
        out = np.zeros((n, len(self.langs)))
        if not len(b) or not self.langs:
            return out, np.diff(at)
        lo = 0
        while lo < n:  # a few texts at a time, so that tables stay near
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 200_000, side="right")) - 1)
            x, start = b[at[lo] : at[hi]], at[lo:hi] - at[lo]
            bits = self._bits(x, start)
            bits[start] = 0  # the space put before each text
            out[lo:hi] = np.add.reduceat(bits, start, axis=0, dtype=np.float64)
            lo = hi
        return out, np.diff(at) - 1

    def _bits(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """(bytes, languages): the code length of each byte."""
        key = np.zeros(len(x), np.int64)
        for j in range(MAX_ORDER + 1):
            key[j:] |= x[: len(x) - j].astype(np.int64) << 8 * j
        reach = np.full(len(x), MAX_ORDER)  # bytes of its text before each
        for j in range(MAX_ORDER):
            at = start + j
            reach[at[at < np.append(start[1:], len(x))]] = j
        bits = np.zeros((len(x), len(self.langs)), np.float32)
        left = np.arange(len(x))
        for order in range(MAX_ORDER, -1, -1):
            able = left if order == 0 else left[reach[left] >= order]
            gram = key[able] & ((1 << 8 * order + 8) - 1)
            found = self.grams[order].find(gram)
            hit = found >= 0
            bits[able[hit]] += self.cost[order][found[hit]]
            lost = able[~hit]
            context = self.contexts[order].find(gram[~hit] >> 8)
            known = context >= 0
            bits[lost[known]] += self.escape[order][context[known]]
            left = lost if len(able) == len(left) else np.concatenate([left[reach[left] < order], lost])
        bits[left] += 8
        return bits


def fit(documents: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Trees:
    """Trees from documents (doc_id, text, lang). Rows with a null in any of them teach nothing.

    How many rows and bytes a language has sets the share of its ids that are learnt from, so about train_rows of each, or train_bytes, whatever the
    size. Every gram of so bounded a sample is counted, in parallel, and gathered.
    """
    rows = documents.select("doc_id", "lang", "text").where("doc_id is not null and lang is not null and text is not null")
    share = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    langs = sorted(r["lang"] for r in share)
    if not langs:
        return Trees([], [])
    rate = F.create_map(*[F.lit(x) for r in share for x in (r["lang"], min(1.0, train_rows / r["n"], train_bytes / max(1, r["size"])))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30))
    grams = sample.select("lang", "text").mapInArrow(tidy(count_grams(langs)), "lang int, order int, gram long, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    lang, order, gram, n = (c.to_numpy() for c in grams.toArrow().columns)
    out = []
    for li in range(len(langs)):
        per = []
        for k in range(MAX_ORDER + 1):
            at = np.flatnonzero((lang == li) & (order == k))
            at = at[np.argsort(gram[at])]
            per.append((gram[at], n[at]))
        out.append(per)
    return Trees(langs, out)


def predict(documents: DataFrame, trees: Trees, keep: list[str]) -> DataFrame:
    """keep's columns, then lang_pred string, score double (posterior of the language under equal priors), bits_per_byte double.

    lang_pred is `und` with score 0 where the text is null or has no letter, or nothing was learnt.
    """
    shared = documents.sparkSession.sparkContext.broadcast(trees)  # the grams of a bounded sample

    def predicted(batches):
        model = shared.value
        for b in (x for whole in batches for x in sliced(whole)):
            bits, n = model.lengths(b.column("text"))
            if model.langs:
                best = bits.argmin(1)
                score = 1 / np.exp2(np.clip(bits.min(1)[:, None] - bits, -1000, 0)).sum(1)
                least = bits.min(1)
            else:
                best, score, least = np.zeros(len(n), int), np.zeros(len(n)), np.zeros(len(n))
            letter = _has_letter(b.column("text"))
            ok = letter & bool(model.langs)
            names = [model.langs[i] if k else "und" for i, k in zip(best, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(names, pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(np.where(ok, least / np.maximum(1, n), 0.0))], names=[*keep, "lang_pred", "score", "bits_per_byte"])

    source = documents.select(*dict.fromkeys([*keep, "text"]))
    return source.mapInArrow(tidy(predicted), StructType([*(source.schema[c] for c in keep), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_byte", DoubleType())]))


def _has_letter(column) -> np.ndarray:
    raw, at = text_bytes(column)
    plain = ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122))
    run = np.concatenate([[0], np.cumsum(plain)])
    has = run[at[1:]] > run[at[:-1]]
    for i in np.flatnonzero(~has & (np.diff(at) > 0)):  # letters beyond ASCII: few texts have only those
        has[i] = any(c.isalpha() for c in raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return has
