"""What the corpus operators share: shared-folder tables, vectorised word hashes and connected components."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.sources.shared import discard, stash

U64 = np.uint64
_P = 0xD6E8FEB86659FD93  # odd, so that its powers can be divided out modulo 2**64
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 1 << 20
_powers = np.ones(1, dtype=U64)


# ---------------------------------------------------------------- tables


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


_remembered: dict[str, dict] = {}


def remembered(module: str) -> dict:
    """What a worker process remembers from task to task of a module; a tidy task of another module has it forgotten."""
    return _remembered.setdefault(module, {})


def forget_others(module: str) -> None:
    """Empties what modules other than this one remember in this process: a worker that served one operator may serve another next."""
    kept = [x for name, x in _remembered.items() if x and name != module]
    for x in kept:
        x.clear()
    if kept:
        give_back()


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(f):
    """f, a function over the Arrow batches of a task, without what other operators remember in the worker, and giving free memory back when the task
    ends: idle workers share a machine with busy ones."""
    module = f.__module__

    def run(batches):
        forget_others(module)  # a function of a module is pickled by name, so this is the worker's own table
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


#: What a roomy task's process may keep of freed memory at its heap's end, and the size from which an array is mapped by itself.
ROOM, MAPPED = 64 << 20, 32 << 20


def keep_freed() -> bool:
    """Whether memory that is freed now stays with this process, ROOM bytes at most: by default the C library gives it back and has its pages zeroed anew,
    again and again, where arrays of some 100 KB to megabytes come and go."""
    import ctypes

    choose = getattr(ctypes.CDLL(None), "mallopt", None)  # not every C library has it
    return choose is not None and choose(-3, MAPPED) == 1 and choose(-1, ROOM) == 1  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD


def roomy(f):
    """f, a function over the Arrow batches of a task, in a process that keeps freed memory."""

    def run(batches):
        keep_freed()
        yield from f(batches)

    return run


# ---------------------------------------------------------------- words


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser over 64-bit integers: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * _M1
    h ^= h >> U64(29)
    h *= _M2
    h ^= h >> U64(32)
    return h


def within(x: np.ndarray, low: int, high: int) -> np.ndarray:
    """Which bytes lie from low to high: a few passes over bytes take a fifth of the time of a look-up by byte."""
    return x - np.uint8(low) <= np.uint8(high - low)


def lower(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return raw + (within(raw, 65, 90).view(np.uint8) << np.uint8(5))


def space(x: np.ndarray) -> np.ndarray:
    return within(x, 0x09, 0x0D) | (x == 32)


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, _CHUNK + 4096)
        out = np.full(size, _P, dtype=U64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _powers = out
    return _powers


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column end to end, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_hashes(column, prefixes: tuple[int, ...] = ()) -> tuple:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of every whole text, A-Z in lower case, and the n + 1 offsets of the rows' words.

    A word's hash is a polynomial in its bytes, read off a running sum over a stretch of text, so no Python object is made for a word.
    With prefixes, a third array follows: a row for each length, with the hash of so many first bytes of each word, 0 where it has no more.
    """
    raw, at = text_bytes(column)
    n = len(raw)
    hashes, begins, heads = [], [], []
    first = np.zeros(n + 1, dtype=bool)
    first[at] = True
    lo = 0
    while lo < n:
        hi = min(n, lo + _CHUNK)
        while hi < n and not SPACE[raw[hi]] and not first[hi]:  # a stretch ends where no word goes on
            step = SPACE[raw[hi : hi + 4096]] | first[hi : min(n, hi + 4096)]
            hi = hi + int(step.argmax()) if step.any() else min(n, hi + 4096)
        b = lower(raw[lo:hi])
        ink = ~space(b)
        start = ink.copy()
        start[1:] &= ~ink[:-1] | first[lo + 1 : hi]
        end = ink.copy()
        end[:-1] &= ~ink[1:] | first[lo + 1 : hi]
        s, e = np.flatnonzero(start), np.flatnonzero(end)
        if len(s):
            power = _pow(len(b) + 1)
            run = np.cumsum((b.astype(U64) + U64(1)) * power[: len(b)], dtype=U64)
            total = run.take(e)
            total[1:] -= run.take(s[1:] - 1)
            if s[0]:
                total[:1] -= run[s[0] - 1]
            hashes.append(mix(total * power.take(len(b) - s) * _inverse(len(b))))
            begins.append(s + lo)
            if prefixes:
                before = np.where(s > 0, run[s - 1], U64(0))
                scale = power[len(b) - s] * _inverse(len(b))
                heads.append(np.stack([np.where(e >= s + k, mix((run[np.minimum(s + k - 1, e)] - before) * scale + U64(k)), U64(0)) for k in prefixes]))
        lo = hi
    if not hashes:
        empty = np.zeros(0, U64), np.zeros(len(at), np.int64)
        return (*empty, np.zeros((len(prefixes), 0), U64)) if prefixes else empty
    out = np.concatenate(hashes), np.searchsorted(np.concatenate(begins), at)
    return (*out, np.concatenate(heads, axis=1)) if prefixes else out


def _inverse(n: int) -> np.uint64:
    """P to the power -n, so that a hash doesn't depend on where its stretch ended."""
    return U64(pow(pow(_P, -1, 1 << 64), n, 1 << 64))


def sliced(batch, column: str = "text", limit: int = 1 << 19):
    """Stretches of a batch with about so many bytes of text, a row at least: what is worked out from texts is held for no more at once."""
    texts = batch.column(column)
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    lo = 0
    while lo < batch.num_rows:
        before = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of each item, from the rows' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct n-word shingles, ascending by hash, and the rows' offsets. Fewer than n words count as one shingle; no words, as none."""
    words = np.diff(offsets)
    if not len(hashes):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    k = np.zeros(len(hashes), U64)
    for j in range(n):
        k[: len(hashes) - j] = k[: len(hashes) - j] * U64(0x9E3779B97F4A7C15) + hashes[j:]
        k ^= k >> U64(31)
    k = mix(k)
    count = np.where(words >= n, words - n + 1, 0)
    valid = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(valid, offsets[:-1], 1)
    np.add.at(valid, offsets[:-1] + count, -1)
    k, row = k[np.cumsum(valid)[:-1] > 0], np.repeat(np.arange(len(words)), count)
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        ones = np.array([_whole(hashes[offsets[i] : offsets[i + 1]]) for i in short], U64)
        k, row = np.concatenate([k, ones]), np.concatenate([row, short])
    order = order_by(k, row) if len(short) else None
    if order is None:  # rows are in order: sort within each
        bounds = np.concatenate([[0], np.cumsum(count)])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            k[a:b].sort()
    else:
        k, row = k[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (row[1:] != row[:-1])
    return k[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(words)))]).astype(np.int64)


def _whole(h: np.ndarray) -> int:
    out = len(h)
    for x in h.tolist():
        out = ((out ^ x) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF
        out ^= out >> 29
    return out


def order_by(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The order by row, then hash: two sorts of one key each, the second of small numbers, are much faster than one of two."""
    order = np.argsort(hashes)
    small = rows.astype(np.uint16) if not len(rows) or rows.max() < 1 << 16 else rows
    return order[np.argsort(small[order], kind="stable")]


#: What a remembered word takes beside its bytes and ids: its object and its places in the tables.
_ENTRY_BYTES = 120


class WordTable:
    """Ids of the words that a worker process has met, held to so many bytes: of a full table the half met first, which holds the common ones, stays.

    learn gives the ids of new words end to end, how many each has, and a flag each. A word's ids are pool[bounds[k] : bounds[k + 1]], its flag good[k].
    """

    def __init__(self, learn: Callable, kind, limit: int):
        self.learn, self.limit = learn, limit
        self.place: dict[bytes, int] = {}
        self.pool, self.bounds, self.good = np.zeros(0, kind), np.zeros(1, np.int64), np.zeros(0, bool)
        self.cost = np.zeros(1, np.int64)  # bytes of the words up to each

    def _shrink(self) -> None:
        keep = int(np.searchsorted(self.cost, self.limit // 2, side="right")) - 1
        self.place = dict(islice(self.place.items(), keep))
        self.bounds, self.cost = self.bounds[: keep + 1].copy(), self.cost[: keep + 1].copy()
        self.pool, self.good = self.pool[: self.bounds[-1]].copy(), self.good[:keep].copy()

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in the table, which learns those that it lacks; numbers hold until the next call."""
        if self.cost[-1] > self.limit:  # the words of one call were too many
            self._shrink()
        found = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        lacking = np.flatnonzero(found < 0)
        if not len(lacking):
            return found
        lost = [words[i] for i in lacking.tolist()]
        new = list(dict.fromkeys(lost))
        size = np.fromiter(map(len, new), np.int64, len(new)) + _ENTRY_BYTES
        if self.cost[-1] + size.sum() > self.limit and self.cost[-1] > self.limit // 2:
            self._shrink()
            return self.find(words)
        flat, many, good = self.learn(new)
        base = len(self.place)
        self.place.update(zip(new, range(base, base + len(new)), strict=True))
        self.pool, self.good = np.concatenate([self.pool, flat.astype(self.pool.dtype)]), np.concatenate([self.good, good])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(many)])
        self.cost = np.concatenate([self.cost, self.cost[-1] + np.cumsum(size + self.pool.itemsize * many)])
        found[lacking] = np.fromiter(map(self.place.__getitem__, lost), np.int64, len(lost))
        return found

    def ids(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of these numbers end to end, and the n + 1 offsets of the words' ids."""
        start, size = self.bounds[index], self.bounds[index + 1] - self.bounds[index]
        ends = np.concatenate([[0], np.cumsum(size)])
        kind = np.int32 if len(self.pool) + ends[-1] < 1 << 31 else np.int64
        place = np.repeat((start - ends[:-1]).astype(kind), size)
        place += np.arange(len(place), dtype=kind)
        return self.pool[place], ends


def binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes() for x in parts], pa.binary())


def groups(batches, n_keys: int):
    """(key, table) of each group of a stream sorted by its first n_keys columns; no more than a group and a batch are held."""
    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i) for i in range(n_keys)]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            x = c.to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            at = tuple(c[lo].as_py() for c in columns)
            if at != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = at
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def overlap_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
    """How many elements each set of left has in common with each of right. same: left is right, and only i < j is needed."""
    counts = np.zeros((len(left), len(right)), np.int32)
    if len(left) <= 6 and len(right) <= 6:
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                if not same or i < j:
                    counts[i, j] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        return counts
    size = len(sets)
    row = np.repeat(np.arange(size), [len(s) for s in sets])
    at = np.concatenate(sets)
    order = order_by(at, np.zeros(len(at), np.uint16))
    at, row = at[order], row[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    n = np.diff(np.append(first, len(at)))
    of, many = np.repeat(np.arange(len(n)), n), np.repeat(n, n)
    full = np.zeros(size * size, np.int32)
    # elements of few sets: the pairs of each
    few = (many > 1) & (many <= 32)
    r, o = row[few], of[few]
    for d in range(1, 32):
        hit = o[d:] == o[:-d]
        if not hit.any():
            break
        a, b = r[:-d][hit], r[d:][hit]
        np.add.at(full, np.minimum(a, b) * size + np.maximum(a, b), 1)
    full = full.reshape(size, size)
    full = full + full.T
    counts += full[np.ix_(left, right)]
    # elements of many: a product of matrices
    r, o = row[many > 32], of[many > 32]
    _, o = np.unique(o, return_inverse=True)
    step = 2048
    for lo in range(0, int(o[-1]) + 1 if len(o) else 0, step):
        s, e = np.searchsorted(o, [lo, lo + step])
        have = np.zeros((size, step), np.float32)
        have[r[s:e], o[s:e] - lo] = 1
        counts += (have[left] @ have[right].T).astype(np.int32)
    return counts


# ---------------------------------------------------------------- union-find


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of the graph with edges a-b, for every node but the smallest ones themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        low = np.minimum(px, py)
        if (px == py).all():
            break
        np.minimum.at(parent, px, low)
        np.minimum.at(parent, py, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        keep = parent[x] != parent[y]
        x, y = x[keep], y[keep]
        if not len(x):
            break
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _contract(batches):
    """Replaces the edges of a partition, some at a time, by a forest over the same nodes."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        u, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        held = forest(np.concatenate([held[0], u]), np.concatenate([held[1], v]))
        if len(held[0]) > 2_000_000:  # memory is bounded: what is held goes on as it is
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], schema=_EDGES)
            held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(held[0]):
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], schema=_EDGES)


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges to (node, component), the smallest node reachable, for every node of an edge between two nodes.

    Union-find within partitions first shrinks the edges to forests. Alternating large-star and small-star steps then join the
    forests; each is a partial-aggregated min and an equi-join, so a hub's edges spread over tasks, and each is written to the
    shared folder, so a lost executor costs one step. It ends after a step that changes nothing.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    edges = stash(edges.mapInArrow(tidy(_contract), "u long, v long"))  # v < u in each

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        last, edges = edges, stash(small)
        discard(last)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
