"""Document fingerprints by consistent weighted sampling.

A document is a bag of words. For each of SAMPLES seeds, every word draws r and c from Gamma(2, 1) and b from U(0, 1) by hash alone; at
weight w it has t = floor(ln w / r + b) and the key ln c - r (t - b + 1), and the word of the least key is the sample, with its t. Two
documents have the same sample with the probability of their generalised Jaccard similarity, sum of least over sum of largest weights.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, order_by, row_of, sliced, word_hashes

SAMPLES = 64
_STEP = U64(0x9E3779B97F4A7C15)


def _uniform(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers in (0, 1) from the top bits of x."""
    return ((x >> U64(64 - bits)).astype(np.float64) + 0.5) * 2.0**-bits


def _gamma(x: np.ndarray) -> np.ndarray:
    """Gamma(2, 1) from the two 32-bit halves of x: the sum of two exponentials."""
    return -np.log(_uniform(x, 32) * _uniform(x << U64(32), 32))


def signatures(column) -> np.ndarray:
    """(rows, SAMPLES) 16-bit samples of whole texts. A text without words has zeros."""
    h, offsets = word_hashes(column)
    n = len(offsets) - 1
    out = np.zeros((n, SAMPLES), np.uint16)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + 60_000, side="right")) - 1)
        _sign(h[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], out[lo:hi])
        lo = hi
    return out


def _sign(h: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    if not len(h):
        return
    row = row_of(offsets)
    order = order_by(h, row)
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(h)))
    term, row = h[first], row[first]
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    rows = row[start]
    log_w = np.log(weight)
    size = np.diff(np.append(start, len(term)))
    for k in range(SAMPLES):
        # r, c and b are a word's own for each seed: 64 bits of hash each
        x = mix(term ^ U64(k * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        r, b = _gamma(x), _uniform(mix(x + _STEP), 53)
        t = np.floor(log_w / r + b)
        key = np.log(_gamma(mix(x ^ ~_STEP))) - r * (t - b + 1)
        hit = np.flatnonzero(key == np.repeat(np.minimum.reduceat(key, start), size))
        at = hit[np.searchsorted(hit, start)]
        out[rows, k] = (mix(term[at] ^ (t[at].astype(np.int64).astype(U64) * _STEP) ^ U64(k)) >> U64(48)).astype(np.uint16)


def as_text(signature: np.ndarray) -> list[str]:
    raw = signature.astype(">u2").tobytes().hex()
    step = 4 * SAMPLES
    return [raw[i : i + step] for i in range(0, len(raw), step)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples; 16 bits of each agree by chance too seldom to matter."""
    return (a == b).mean(axis=1)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(documents: DataFrame) -> DataFrame:
    """(spare, doc_id, text): each partition a range of doc_id in descending order, and after it, spare, the row that follows its last one.

    Ranges are bounded by quantiles of doc_id over all rows, each an id that is there, so none is empty; as many as the session's shuffle
    partitions. Rows of one id stay together, ordered by their text's hash; null ids come last. Each text moves once.
    """
    spark = documents.sparkSession
    low = F.lit(-(1 << 63)).cast("long")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("place", F.coalesce("doc_id", low)).withColumn("hash", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("place", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0]
    if cuts is None:
        return rows.select(F.lit(False).alias("spare"), "doc_id", "text")
    bounds = sorted(set(cuts))
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    upto = lambda a: F.size(F.filter(a, lambda x: x <= F.col("place")))
    block = upto(longs([b[0] for b in blocks]))
    bucket = F.when(block == 0, 0).otherwise((block - 1) * step + upto(F.element_at(F.array(*map(longs, blocks)), F.greatest(block, F.lit(1)))))
    rows = rows.withColumn("bucket", bucket)
    tops = {r["bucket"]: tuple(r["top"]) for r in rows.groupBy("bucket").agg(F.max(F.struct("place", "hash")).alias("top")).collect()}
    order = sorted(tops)  # a range each: the first row of one follows the last row of the next, and the very first the very last
    table = spark.createDataFrame([(b, i, tops[b][0], tops[b][1], (i + 1) % len(order)) for i, b in enumerate(order)], "bucket int, part int, top long, top_hash long, follows int")
    dealt = rows.join(F.broadcast(table), "bucket")
    own = F.struct("part", F.lit(False).alias("spare"))
    both = F.array(own, F.struct(F.col("follows").alias("part"), F.lit(True).alias("spare")))
    dealt = dealt.withColumn("deal", F.explode(F.when((F.col("place") == F.col("top")) & (F.col("hash") == F.col("top_hash")), both).otherwise(F.array(own))))
    dealt = dealt.select("deal.part", "deal.spare", "place", "hash", "doc_id", "text").repartitionById(len(order), "part")
    return dealt.sortWithinPartitions("spare", F.desc("place"), F.desc("hash"), F.desc("text")).select("spare", "doc_id", "text")


def _compare(batches):
    held: list[tuple] = []

    def rows(pairs):
        texts = [t for _, _, t in pairs]
        own = signatures(pa.array(texts, pa.large_string()))
        mine = pairs[:-1]
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts[:-1], texts[1:], strict=True)]
        other = signatures(pa.array(edited, pa.large_string()))
        columns = [
            pa.array([d for _, d, _ in mine], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(as_text(own[:-1]), pa.string()), pa.array(as_text(other), pa.string()),
            pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:])),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _OUT.split(", ")])

    done = False
    for b in batches:
        for part in sliced(b, limit=1 << 20):
            for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).fill_null("").to_pylist(), strict=True):
                if not done:
                    held.append(row)
                    done = row[0]  # rows with the spare's id and hash are alike
            if len(held) > 1:
                yield rows(held)
                held = held[-1:]


def fingerprint(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document (doc_id, text).

    The edited text is the document's with its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next document in
    descending doc_id; the first follows the last. A null text is empty. An empty text's fingerprint is all zeros, like only to another such.
    """
    return neighbours(documents).mapInArrow(_compare, _OUT)
