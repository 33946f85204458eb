"""Approximate nearest neighbours by multi-index hashing.

Vectors are centred, turned by learned rotations (iterative quantisation) and cut to a bit a coordinate. A code is split into substrings, and
each substring value indexes the codes that have it. Two codes within r bits have a substring within r // substrings bits, so
probing every substring's values at that distance retrieves every code within r, whatever the data; those are ranked by their floats.

Queries meet the indexed rows block by block: each block has its own index in memory, answers all queries of a query block with its nearest
K, and those are merged. Equal vectors are indexed once, with as many of their smallest ids as can be asked for.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, binary, groups, stash

#: Rotations learned, and so bits a coordinate.
ROTATIONS = 2
#: Rows that the rotations are fitted on at most, those whose ids hash lowest; every row is indexed.
FIT_ROWS = 5_000
ITERATIONS = 30
SUBSTRING_BITS = 8
#: The radius is that within which so large a share of the nearest K of some of the sample's rows are: wide where vectors have no structure, else narrow.
RECALL, ASKED = 0.98, 250
#: Rows of a block of the index, and of a block of queries, about.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 4_096


class Coder:
    """Learned rotated binary codes."""

    def __init__(self, sample: np.ndarray, rotations: int = ROTATIONS):
        self.mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
        x = sample - self.mean
        dim = x.shape[1]
        self.turn = []
        for k in range(rotations):
            r = np.linalg.qr(np.random.default_rng(k).normal(size=(dim, dim)))[0]
            for _ in range(ITERATIONS if len(x) > dim else 0):
                b = np.where(x @ r > 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(x.T @ b)
                r = u @ v
            self.turn.append(r)
        self.bits = -(-dim * rotations // 8) * 8

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, bits / 8) bytes: each a substring."""
        return np.packbits(np.concatenate([(x - self.mean) @ r > 0 for r in self.turn], axis=1), axis=1)


def fitted_radius(coder: Coder, sample: np.ndarray, k: int) -> int:
    """The bits within which RECALL of the k nearest rows of the sample are, of up to ASKED of its rows. In a whole table the nearest are nearer still."""
    n = len(sample)
    if n < 2:
        return coder.bits
    codes = coder.codes(sample)
    bits = []
    for q in range(0, n, max(1, n // ASKED)):
        d = ((sample - sample[q]) ** 2).sum(1)
        d[q] = np.inf
        near = np.argpartition(d, min(k, n - 1) - 1)[: min(k, n - 1)]
        bits.append(_POP[codes[near] ^ codes[q]].sum(1, dtype=np.int64))
    return int(np.quantile(np.concatenate(bits), RECALL, method="higher"))


_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Index:
    """For each substring, the codes by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.starts = np.stack([np.searchsorted(codes[self.order[:, j], j], np.arange(257)) for j in range(codes.shape[1])]) if len(codes) else np.zeros((codes.shape[1], 257), int)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows with a code at most radius bits from code: all of them, by the pigeonhole principle."""
        near = radius // len(code)
        seen = np.zeros(len(self.codes), bool)
        for j, c in enumerate(code.tolist()):
            values = np.flatnonzero(_POP[np.arange(256) ^ c] <= near)
            s, e = self.starts[j, values], self.starts[j, values + 1]
            size = e - s
            ends = np.cumsum(size)
            seen[self.order[np.arange(ends[-1]) + np.repeat(s - ends + size, size), j]] = True
        rows = np.flatnonzero(seen)
        return rows[_POP[self.codes[rows] ^ code].sum(1, dtype=np.int64) <= radius]


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part: with an id, and with a vector not null, empty, zero or holding null or non-finite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    return rows.where(fine)


def _matrix(column) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def search(embeddings: DataFrame, is_query, k: int = 10, radius: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query holds for, the k nearest found of all other rows, by Euclidean distance.

    Ties go to the smaller vec_id. score is the distance of the original vectors in double precision. Where fewer than k lie within the radius (bits of
    the codes, fitted to the sample unless given) of a query in all, and there are more candidates, it is asked again without a radius, so every query has
    min(k, candidates) rows. Rows of one vec_id with several vectors count by each; a row is no candidate of its own id. Only vectors of one length have
    a distance: those of each length are searched by themselves.
    """
    rows = stash(valid(embeddings))
    lengths = sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect())
    found = [_search(rows.where(F.size("vector") == n), is_query, k, radius) for n in lengths]
    return functools.reduce(DataFrame.unionByName, found) if found else embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(rows: DataFrame, is_query, k: int, radius: int | None) -> DataFrame:
    spark = rows.sparkSession
    sample = rows.groupBy(F.xxhash64("vector").alias("h")).agg(F.first("vector").alias("vector")).orderBy("h").limit(FIT_ROWS).select("vector").toArrow()
    x = _matrix(sample.column(0))
    coder = Coder(x)
    reach = fitted_radius(coder, x, k) if radius is None else radius
    # one row for equal vectors, with the smallest ids: one more than can be asked for, as one may be the query's own
    ids = rows.groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    heads = rows.select("vec_id", "vector").distinct()
    single = ids.where("n = 1").select("vector", F.array("least").alias("ids"))
    many = _smallest(heads.join(ids.where("n > 1").select("vector"), "vector"), k + 1)
    distinct = stash(single.unionByName(many))
    total = distinct.count()
    blocks = max(1, -(-total // BLOCK_ROWS))
    queries = heads.where(is_query)
    n_queries = queries.count()
    q_blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    none = F.lit(None).cast("long")

    def ask(asked: DataFrame, limit: int) -> DataFrame:
        left = distinct.select(place("vector", blocks).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("b"), F.lit(0).alias("side"), none.alias("query_id"), "ids", "vector")
        right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("a"), place("vec_id", q_blocks).alias("b"), F.lit(1).alias("side"), F.col("vec_id").alias("query_id"), F.lit(None).cast("array<bigint>").alias("ids"), "vector")
        both = left.unionByName(right).repartition(max(1, min(blocks * q_blocks, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), "a", "b").sortWithinPartitions("a", "b", "side")
        found = both.mapInArrow(_answer(coder, limit, k), "query_id long, near array<struct<score:double,vec_id:long>>")
        merged = found.groupBy("query_id").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))  # k a block
        return merged

    first = stash(ask(queries, reach))
    full = stash(first.where(F.size("near") >= k))
    asked_again = queries.join(full.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    if not asked_again.isEmpty():
        full = full.unionByName(ask(asked_again, coder.bits))
    return full.select("query_id", F.posexplode("near")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))


def _smallest(rows: DataFrame, k: int) -> DataFrame:
    """vector and its k smallest ids, at first within salted parts, so that a vector's rows needn't meet."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    cut = salted
    from pyspark.sql import Window

    cut = cut.withColumn("r", F.row_number().over(Window.partitionBy("vector", "salt").orderBy("vec_id"))).where(F.col("r") <= k)
    return cut.groupBy("vector").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k).alias("ids"))


def _answer(coder: Coder, radius: int, k: int):
    kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))

    def run(batches):
        for _, t in groups(batches, 2):
            side = t.column("side").to_numpy()
            n = int((side == 0).sum())
            if not n or n == len(side):
                continue
            x = _matrix(t.column("vector"))
            ids = t.column("ids").slice(0, n).to_pylist()
            index = Index(coder.codes(x[:n]))
            names, near = [], []
            for q, code in zip(range(n, len(x)), coder.codes(x[n:]), strict=True):
                me = t.column("query_id")[q].as_py()
                rows = index.within(code, radius)
                d = np.sqrt(((x[rows] - x[q]) ** 2).sum(1))
                best = []
                if len(rows) > 2 * k:
                    kth = np.partition(d, k)[k]  # one of the nearest may be the query itself
                    rows, d = rows[d <= kth], d[d <= kth]
                for r, s in zip(rows.tolist(), d.tolist(), strict=True):
                    best += [(s, i) for i in ids[r] if i != me]
                if best:
                    names.append(me)
                    near.append([{"score": s, "vec_id": i} for s, i in sorted(best)[:k]])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(near, kind)], names=["query_id", "near"])

    return run
