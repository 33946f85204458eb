"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and L1 leave few non-zero weights; those alone go to the scoring tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import U64, mix, row_of, sliced, tidy, word_hashes

BITS = 22
#: No more labelled documents than this are learnt from, and no more than so many bytes of their features: those whose id hashes lowest.
TRAIN_ROWS, TRAIN_BYTES = 16_000, 400_000_000
EPOCHS = 3
#: Texts whose features are held at a time, in bytes: a byte of text has some 60 bytes of features and keys.
PART_BYTES = 1 << 18
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1.5, 0.2
#: (distance of each word from the first) of the features: words, pairs, and pairs that skip one or two words.
SHAPES = ((0,), (0, 1), (0, 2), (0, 3))
#: Beside the whole words, their first so many bytes, for inflected forms that were never seen.
PREFIXES = (4, 5, 6)


def features(column, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every feature of every whole text; a feature may come more than once."""
    h, offsets, heads = word_hashes(column, PREFIXES)
    row = row_of(offsets)
    rows, index = [], []
    for head in heads:
        has = head != 0
        rows.append(row[has])
        index.append((head[has] >> U64(64 - bits)).astype(np.int32))
    for k, shape in enumerate(SHAPES):
        reach = shape[-1]
        if len(h) <= reach:
            continue
        same = row[: len(h) - reach] == row[reach:]
        x = h[: len(h) - reach] + U64(k)
        for d in shape[1:]:
            x = x * U64(0x9E3779B97F4A7C15) + h[d : len(h) - reach + d]
        x = mix(x) if reach else x
        rows.append(row[: len(h) - reach][same])
        index.append((x[same] >> U64(64 - bits)).astype(np.int32))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(rows), np.concatenate(index)


def fit_ftrl(examples: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of binary features: (indices, values, bias). The bias has no L1."""
    size = 1 << bits
    z, n = np.zeros(size, np.float32), np.zeros(size, np.float32)
    zb = nb = 0.0
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            x, y = examples[i], labels[i]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
            wb = -zb / ((BETA + np.sqrt(nb)) / ALPHA + L2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
            n[x] = nx + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * wb
            nb += g * g
    index = np.flatnonzero(np.abs(z) > L1)  # the others are 0: no array of all weights is made
    z, n = z[index], n[index]
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return index.astype(np.int32), w.astype(np.float32), float(-zb / ((BETA + np.sqrt(nb)) / ALPHA + L2))


def _distinct(key: np.ndarray) -> np.ndarray:
    """The distinct keys, ascending; key is sorted in place, for which np.unique would take several times its memory."""
    key.sort()
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return key[new]


def _examples(batches):
    for b in (x for whole in batches for x in sliced(whole, limit=PART_BYTES)):
        key, index = features(b.column("text"))
        key <<= 32
        key |= index
        key = _distinct(key)
        ends = np.searchsorted(key >> 32, np.arange(b.num_rows + 1))
        index = (key & 0xFFFFFFFF).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("rank"), b.column("y"), pa.array([index[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["rank", "y", "x"])


def _train(train_bytes: int):
    """Learns from rows of (rank, y, x) sorted by rank, up to train_bytes."""

    def run(batches):
        y, x, size = [], [], 0
        for b in batches:
            _, offsets, data = b.column("x").buffers()  # read in place
            at = np.frombuffer(offsets, np.int32)[b.column("x").offset : b.column("x").offset + b.num_rows + 1]
            for label, s, e in zip(b.column("y").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                size += e - s
                if size <= train_bytes or not y:
                    y.append(label)
                    x.append(np.frombuffer(data, np.int32, (e - s) // 4, s) if e > s else np.zeros(0, np.int32))
        index, weight, bias = fit_ftrl(x, np.array(y, float)) if y else (np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([index.tobytes()]), pa.array([weight.tobytes()]), pa.array([bias])], names=["index", "weight", "bias"])

    return run


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> tuple[np.ndarray, np.ndarray, float]:
    """Learns from labels (doc_id, toxic) of documents (doc_id, text), at most train_rows ids by lowest hash.

    Null ids and labels are passed over; an id labelled twice counts as toxic if any label says so; one that stands for several
    texts is learnt by its first text in order. One task learns; its input is bounded by train_rows and train_bytes, its output by the hash size.
    """
    rank = F.xxhash64(F.col("doc_id").cast("long"))
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    chosen = chosen.orderBy(rank, "doc_id").limit(train_rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    shaped = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select(rank.alias("rank"), "y", "text").mapInArrow(tidy(_examples), "rank long, y int, x binary")
    best = shaped.repartition(1).sortWithinPartitions("rank").mapInArrow(tidy(_train(train_bytes)), "index binary, weight binary, bias double").first()
    return (np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0) if best is None else (np.frombuffer(best["index"], np.int32), np.frombuffer(best["weight"], np.float32), best["bias"])


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str], bits: int = BITS) -> DataFrame:
    """keep's columns of every document, then score double and predicted int. A null or empty text has the score of the bias."""
    index, weight, bias = model
    shared = documents.sparkSession.sparkContext.broadcast((index, weight))  # at most 2**bits weights

    def scored(batches):
        dense = np.zeros(1 << bits, np.float32)
        at, value = shared.value
        dense[at] = value
        for b in (x for whole in batches for x in sliced(whole, limit=PART_BYTES)):
            total = np.full(b.num_rows, bias)
            row, ix = features(b.column("text"))
            hit = np.flatnonzero(dense[ix])
            key = _distinct(row[hit] << bits | ix[hit])
            np.add.at(total, key >> bits, dense[key & ((1 << bits) - 1)].astype(float))
            p = 1 / (1 + np.exp(-np.clip(total, -700, 700)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    source = documents.select(*dict.fromkeys([*keep, "text"]))
    fields = [source.schema[c] for c in keep]
    return source.mapInArrow(tidy(scored), StructType([*fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
