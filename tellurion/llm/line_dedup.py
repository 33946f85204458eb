"""Fuzzy line de-duplication by MinHash.

A line is known by the hash of its trimmed bytes, so equal lines are one from the start. Its character shingles are hashed once and dealt into
ROWS * BANDS bins, whose minima are its signature; an empty bin takes that of a bin picked by hash. Lines that share a band key are a bucket.

Verification is exact, and linear where lines are alike: every line of a bucket is first compared with the bucket's least line, and the links are
joined by union-find. Only buckets whose lines are then still of several components are looked at again: their lines that aren't of the commonest
component are compared with all the others, chunk by block. So every two lines that share a bucket end in one component or have been compared.
Of each component the first occurrence, by doc_id and place, stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, binary, components, forest, mix, sliced, stash, text_bytes, tidy

SHINGLE = 6
PERCENT = 80
#: Recall of a pair of similarity 0.8: 1 - (1 - 0.8**5)**16 = 0.998.
BANDS, ROWS = 16, 5
#: Lines that one is compared with at a time; groups of no more than FEW lines are compared many at once.
BLOCK, FEW = 1024, 16
#: The candidates' table has 2**CELL_BITS bits: 8 MB.
CELL_BITS = 26
#: A name that no table has.
_REMOVED = "tellurion removed"
_TRIM = " \t\r\x0b\x0c"
_BINS = BANDS * ROWS
_PICK = np.random.default_rng(11).integers(0, _BINS, (400, _BINS))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column) -> Column:
    """The hash that a line is known by; null for a blank line."""
    trimmed = F.btrim(line, F.lit(_TRIM))
    return F.when(trimmed != "", F.xxhash64(trimmed))


def _distinct(batches):
    """(hashes, lines) of stretches of texts: each distinct line that isn't blank, leaving out those met shortly before."""
    import xxhash

    met: set[int] = set()
    for b in (x for whole in batches for x in sliced(whole, limit=1 << 18)):
        raw, at = text_bytes(b.column("text"))
        out: dict[int, bytes] = {}
        for i in range(len(at) - 1):
            for line in raw[at[i] : at[i + 1]].tobytes().split(b"\n"):
                if line := line.strip(_TRIM.encode()):
                    h = xxhash.xxh64_intdigest(line, 42)
                    if h not in met:
                        out[h] = line
        if len(met) > 200_000:
            met.clear()
        met.update(out)
        if out:
            yield np.array(list(out), U64), list(out.values())


_BASE, _BASE_2, _BASE_4 = (U64(pow(0x9E3779B97F4A7C15, n, 1 << 64)) for n in (1, 2, 4))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(how many each line has, hashes end to end) of the character shingles of each line, A-Z in lower case; a line shorter than a shingle is one."""
    chars = np.frombuffer(b"\n".join(texts).lower().decode("utf-8").encode("utf-32-le"), np.uint32)
    ends = np.append(np.flatnonzero(chars == 10), len(chars))
    size = np.diff(ends, prepend=-1) - 1
    c = chars.astype(U64)
    c += U64(1)
    n = max(0, len(c) - SHINGLE + 1)
    two = c[:-1] * _BASE  # the polynomial of six characters from those of two
    two += c[1:]
    k = two[:n] * _BASE_4
    k += two[2 : n + 2] * _BASE_2
    k += two[4 : n + 4]
    over = (ends[:, None] - np.arange(SHINGLE)[None, :]).ravel()  # what begins here isn't within a line
    inside = np.ones(n, bool)
    inside[over[(over >= 0) & (over < n)]] = False
    hashes, many = mix(k[inside]), np.maximum(size - SHINGLE + 1, 0)
    short = np.flatnonzero(size < SHINGLE)
    if len(short):
        import xxhash

        hashes = np.insert(hashes, np.cumsum(many)[short], np.array([xxhash.xxh64_intdigest(texts[i].lower()) for i in short], U64))
        many[short] = 1
    return many, hashes


def band_keys(texts: list[bytes]) -> np.ndarray:
    """(lines, BANDS) 64-bit keys."""
    many, h = shingles(texts)
    empty = np.uint32(0xFFFFFFFF)
    sig = np.full(len(texts) * _BINS, empty, np.uint32)
    low = h.astype(np.uint32)
    np.minimum(low, np.uint32(0xFFFFFFFE), out=low)
    h >>= U64(32)
    h *= U64(_BINS)
    h >>= U64(32)
    bins = h.view(np.int64)
    bins += np.repeat(np.arange(len(texts)) * _BINS, many)
    np.minimum.at(sig, bins, low)
    sig = sig.reshape(-1, _BINS)
    own, filled = sig, sig.copy()
    rows = np.flatnonzero((sig == empty).any(1))
    for pick in _PICK:  # rows that have no gap left drop out
        if not len(rows):
            break
        part = filled[rows]
        part = np.where(part == empty, own[rows][:, pick], part)
        filled[rows] = part
        rows = rows[(part == empty).any(1)]
    sig = filled
    key = np.zeros((len(texts), BANDS), U64)
    parts = sig.reshape(-1, BANDS, ROWS).astype(U64)
    for r in range(ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, r] + U64(r + 1))
    return mix(key + np.arange(BANDS, dtype=U64) * U64(0x632BE59BD9B4E019))


def _band_blocks(bits: int):
    def run(batches):
        keys, names, size = [], [], 0

        def out():
            k, h = np.concatenate(keys), np.concatenate(names)
            order = np.argsort(k)
            k, h = k[order], h[order]
            at = np.searchsorted(k, np.arange(1 << bits, dtype=U64) << U64(64 - bits))
            ends = np.append(at[1:], len(k))
            low = (k >> U64(32 - bits)).astype(np.uint32)
            some = np.flatnonzero(ends > at)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), binary([low[at[i] : ends[i]] for i in some]), binary([h[at[i] : ends[i]] for i in some])], names=["part", "keys", "lines"])

        for h, texts in _distinct(batches):
            keys.append(band_keys(texts).ravel())
            names.append(np.repeat(h, BANDS))
            size += len(h)
            if size > 60_000:
                yield from out()
                keys, names, size = [], [], 0
        if size:
            yield from out()

    return run


_MET = "bucket long, node long, least long, n int"


def _meetings(batches):
    """(bucket, node, least, n) of every line but the least of each bucket of n lines. Buckets with the same lines are one: they ask the same."""
    by: dict[int, list] = {}
    for b in batches:
        for part, keys, names in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            by.setdefault(part, []).append((np.frombuffer(keys, np.uint32), np.frombuffer(names, np.int64)))
    for part in sorted(by):
        got = by.pop(part)
        k, h = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
        order = np.argsort(k, kind="stable")
        k, h = k[order], h[order]
        shared = np.append(k[1:] == k[:-1], False) | np.append(False, k[1:] == k[:-1])
        k, h = k[shared], h[shared]
        order = np.lexsort((h, k))
        k, h = k[order], h[order]
        new = np.append(True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])) if len(k) else np.zeros(0, bool)
        k, h = k[new], h[new]  # a line met by several tasks is there once
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
        size = np.diff(np.append(first, len(k)))
        some = size > 1
        bucket = np.add.reduceat(mix(h.view(U64)), first) if len(first) else np.zeros(0, U64)  # a digest of the lines
        _, at = np.unique(bucket[some], return_index=True)
        keep = np.zeros(len(first), bool)
        keep[np.flatnonzero(some)[at]] = True
        rest = np.repeat(keep, size)
        rest[first] = False
        of = np.repeat(np.arange(len(first)), size)[rest]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[of].view(np.int64)), pa.array(h[rest]), pa.array(h[first[of]]), pa.array(size[of].astype(np.int32))], names=[x.split()[0] for x in _MET.split(", ")])


def _bitmap(spark, members: DataFrame) -> np.ndarray:
    """A bit for each cell of hashes that has a member; a part of the cells comes from each task."""
    parts = 64
    width = (1 << CELL_BITS) // parts

    def run(batches):
        cells: dict[int, np.ndarray] = {}
        for b in batches:
            c = (b.column(0).to_numpy().view(U64) >> U64(64 - CELL_BITS)).astype(np.int64)
            for part in np.unique(c // width).tolist():
                own = cells.setdefault(part, np.zeros(width, bool))
                own[c[c // width == part] - part * width] = True
        if cells:
            yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.int32()), binary([np.packbits(x) for x in cells.values()])], names=["part", "bits"])

    cell = F.expr(f"cast(shiftrightunsigned(node, {64 - 6}) as int)")
    out = np.zeros((1 << CELL_BITS) // 8, np.uint8)
    for r in members.select("node").repartition(parts, cell).mapInArrow(tidy(run), "part int, bits binary").toLocalIterator():
        out[r["part"] * width // 8 : (r["part"] + 1) * width // 8] |= np.frombuffer(r["bits"], np.uint8)
    return out


def _shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, sizes, bits): the distinct shingles of all lines as ascending numbers, the line above so many bits of the shingle's hash."""
    many, h = shingles(texts)
    row = np.repeat(np.arange(len(texts)), many)
    bits = 64 - max(1, (len(texts) - 1).bit_length())
    key = np.sort(row.astype(U64) << U64(bits) | h >> U64(64 - bits))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key, np.bincount((key >> U64(bits)).astype(np.int64), minlength=len(texts)), bits


def _alike(common, a, b):
    return 100 * common >= PERCENT * (a + b - common)


def _star_links(texts: list[bytes], centre: np.ndarray) -> np.ndarray:
    """The places of the lines that are alike enough to the last centre before them."""
    key, size, bits = _shingle_sets(texts)
    heads = np.flatnonzero(centre)
    head = heads[np.cumsum(centre) - 1]  # of each line
    own = (key >> U64(bits)).astype(np.int64)
    asked = ~centre[own]
    of = own[asked]
    want = key[asked] & U64((1 << bits) - 1) | head[of].astype(U64) << U64(bits)
    known = key[~asked]
    at = np.minimum(np.searchsorted(known, want), max(0, len(known) - 1))
    common = np.bincount(of, known[at] == want if len(known) else None, minlength=len(texts)).astype(np.int64)
    return np.flatnonzero(~centre & _alike(common, size, size[head]))


def _numbered(h: np.ndarray) -> np.ndarray:
    """Ascending numbers from 0 for the distinct values of the sorted h."""
    return np.cumsum(np.append(False, h[1:] != h[:-1])) if len(h) else h.astype(np.int64)


def _block_links(texts: list[bytes], left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place of left, place of the others) that are alike enough, by products of matrices over some shingles at a time."""
    key, size, bits = _shingle_sets(texts)
    row = (key >> U64(bits)).astype(np.int64)
    h = key & U64((1 << bits) - 1)
    order = np.argsort(h)
    row, h = row[order], _numbered(h[order])
    l, r = np.flatnonzero(left), np.flatnonzero(~left)  # noqa: E741
    common = np.zeros((len(l), len(r)), np.int64)
    met = (np.bincount(h, left[row]) > 0) & (np.bincount(h, ~left[row]) > 0)  # the others are in no pair
    row, h = row[met[h]], _numbered(h[met[h]])
    step = 2048
    for lo in range(0, int(h[-1]) + 1 if len(h) else 0, step):
        s, e = np.searchsorted(h, [lo, lo + step])
        have = np.zeros((len(texts), min(step, int(h[-1]) + 1 - lo)), np.float32)
        have[row[s:e], h[s:e] - lo] = 1
        common += (have[l] @ have[r].T).astype(np.int64)
    i, j = np.nonzero((common > 0) & _alike(common, size[l][:, None], size[r][None, :]))
    return l[i], r[j]


def _few_links(texts: list[bytes], group: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for many groups of a few lines at once, one after another: by runs of equal shingles within a group."""
    key, size, bits = _shingle_sets(texts)
    low = 64 - bits  # of the line's place
    row = (key >> U64(bits)).astype(np.int64)
    key = np.sort(mix(key & U64((1 << bits) - 1) ^ mix(group.astype(U64))[row]) >> U64(low) << U64(low) | row.astype(U64))
    row, run = (key & U64((1 << low) - 1)).astype(np.int64), key >> U64(low)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    many = np.diff(np.append(first, len(group)))
    base = np.cumsum(many * many) - many * many  # a cell for each two lines of a group
    place = np.arange(len(group)) - first[group]
    cells = int((many * many).sum())
    common = np.zeros(cells, np.int64)
    for d in range(1, int(many.max())):
        hit = np.flatnonzero(run[d:] == run[:-d])
        if not len(hit):
            break
        a, b = row[hit], row[hit + d]  # ascending
        common += np.bincount(base[group[a]] + place[a] * many[group[a]] + place[b], minlength=cells)
    at = np.flatnonzero(common)
    of = np.searchsorted(base, at, side="right") - 1
    a, b = first[of] + (at - base[of]) // many[of], first[of] + (at - base[of]) % many[of]
    good = (left[a] != left[b]) & _alike(common[at], size[a], size[b])
    return a[good], b[good]


_ROW = "centre long, block int, head boolean, id long, text binary"


def _star_compare(batches):
    """Links of lines with their group's centre, from rows of _ROW sorted by centre and block, a group's head first."""
    last = None  # the head of the group that goes on in the next rows
    for b in (x for whole in batches for x in sliced(whole, limit=1 << 18)):
        centre, block = b.column("centre").to_numpy(), b.column("block").to_numpy()
        ids, texts = b.column("id").to_numpy(), b.column("text").to_pylist()
        head = b.column("head").to_numpy(zero_copy_only=False)
        if not head[0]:  # the group's head came before
            centre, block, ids, head = np.append(last[0], centre), np.append(last[1], block), np.append(last[0], ids), np.append(True, head)
            texts = [last[2], *texts]
        at = int(np.flatnonzero(head)[-1])
        last = centre[at], block[at], texts[at]
        hit = _star_links(texts, head)
        yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(centre[hit])], names=["u", "v"])


_PAIR = "bucket long, chunk int, block int, side int, id long, text binary"


def _whole(batches):
    """Tables of whole groups, rows with the same first three columns, of about 256 KB of text or a group."""
    held: list[pa.RecordBatch] = []
    tail = None  # the group of the last row held
    for b in (x for whole in batches for x in sliced(whole, limit=1 << 18)):
        keys = [b.column(i).to_numpy() for i in range(3)]
        before, tail = tail, tuple(k[-1] for k in keys)
        other = np.flatnonzero(np.logical_or.reduce([k != t for k, t in zip(keys, tail, strict=True)]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut or before != tail:
            if held or cut:
                yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _block_compare(batches):
    """Links between the lines of a chunk (side 0) and those of a block (side 1), as forests: rows of _PAIR sorted by bucket, chunk, block and side."""
    for t in _whole(batches):
        ids, left, texts = t.column("id").to_numpy(), t.column("side").to_numpy() == 0, t.column("text").to_pylist()
        change = np.logical_or.reduce([k[1:] != k[:-1] for k in (t.column(i).to_numpy() for i in range(3))])
        group = np.cumsum(np.append(False, change))
        ends = np.cumsum(np.bincount(group))
        few = (np.bincount(group) <= FEW)[group]
        links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        at = np.flatnonzero(few)
        if len(at):
            i, j = _few_links([texts[k] for k in at.tolist()], np.unique(group[at], return_inverse=True)[1], left[at])
            links.append((at[i], at[j]))
        for g in np.unique(group[~few]).tolist():
            lo, hi = ends[g - 1] if g else 0, ends[g]
            if left[lo:hi].any() and not left[lo:hi].all():
                i, j = _block_links(texts[lo:hi], left[lo:hi])
                links.append((lo + i, lo + j))
        i, j = (np.concatenate([x[k] for x in links]) for k in range(2))
        u, v = forest(ids[i], ids[j])
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _texts(bitmap):
    def run(batches):
        table = bitmap.value
        for h, texts in _distinct(batches):
            cell = (h >> U64(64 - CELL_BITS)).astype(np.int64)
            hit = np.flatnonzero(table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), pa.array([texts[i] for i in hit], pa.binary())], names=["id", "text"])

    return run


def similar_lines(documents: DataFrame) -> DataFrame:
    """(node, component): lines by hash that others resemble, and the least hash of their component."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, (4 * parts - 1).bit_length())
    texts = documents.select("text")
    met = stash(texts.mapInArrow(tidy(_band_blocks(bits)), "part int, keys binary, lines binary").repartition(parts, "part").mapInArrow(tidy(_meetings), _MET))
    # every line with the least of its buckets; a hub's lines are split into blocks that have the hub each
    pairs = met.groupBy("node", "least").agg(F.lit(1).alias("one")).drop("one")
    hubs = pairs.groupBy("least").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    heads = hubs.select(F.col("least").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("head"), F.col("least").alias("node"))
    large = hubs.where("blocks > 1")
    others = pairs.join(large, "least", "left").select(F.col("least").alias("centre"), F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"), F.lit(False).alias("head"), "node")
    bitmap = spark.sparkContext.broadcast(_bitmap(spark, pairs.select("node").unionByName(hubs.select(F.col("least").alias("node")))))
    found = stash(texts.mapInArrow(tidy(_texts(bitmap)), "id long, text binary").groupBy("id").agg(F.first("text").alias("text")))
    rows = heads.unionByName(others).join(found, F.col("node") == F.col("id")).select("centre", "block", "head", "id", "text")
    stars = stash(rows.repartition(parts, "centre", "block").sortWithinPartitions("centre", "block", F.desc("head"), "id").mapInArrow(tidy(_star_compare), "u long, v long"))
    return _resolved(met, stars, found, parts)


def _resolved(met: DataFrame, links: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """The components of the links, and of those between lines of a bucket of three or more that the links leave in several components."""
    known = components(links)
    label = known.select("node", F.col("component").alias("label"))
    many = met.where("n > 2").select("bucket", "node", "least").distinct()
    members = many.select("bucket", "node").unionByName(many.select("bucket", F.col("least").alias("node")).distinct())
    members = members.join(label, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    counts = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    mixed = mixed.select("bucket", F.col("top.label").alias("top"), F.ceil(F.col("all") / F.lit(BLOCK)).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("top.n")) / F.lit(BLOCK)).cast("int").alias("chunks"))
    asked = stash(members.join(mixed, "bucket"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.where("label <> top").select("bucket", place("chunks").alias("chunk"), upto("blocks").alias("block"), F.lit(0).alias("side"), "node")
    right = asked.select("bucket", upto("chunks").alias("chunk"), place("blocks").alias("block"), F.lit(1).alias("side"), "node")
    rows = left.unionByName(right).join(found, F.col("node") == F.col("id")).select("bucket", "chunk", "block", "side", "id", "text")
    more = rows.repartition(parts, "bucket", "chunk", "block").sortWithinPartitions("bucket", "chunk", "block", "side", "id").mapInArrow(tidy(_block_compare), "u long, v long")
    return components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))


def _hashed(batches):
    """(doc_id, hashes): what line_hash gives for each line of each text."""
    import xxhash

    trim = _TRIM.encode()
    for b in (x for whole in batches for x in sliced(whole)):
        raw, at = text_bytes(b.column("text"))
        rows = [raw[lo:hi].tobytes().split(b"\n") for lo, hi in zip(at[:-1], at[1:], strict=True)]
        flat = [line.strip(trim) for row in rows for line in row]
        digests = np.frombuffer(b"".join([xxhash.xxh64_digest(line, 42) for line in flat]), ">i8").astype(np.int64)
        hashes = pa.array(digests, mask=np.fromiter(map(len, flat), np.int64, len(flat)) == 0)
        ends = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), hashes)], names=["doc_id", "hashes"])


def line_hashes(documents: DataFrame) -> DataFrame:
    """(doc_id, hashes array<long>) of every row: the hash of each line, null for a blank one."""
    return documents.select("doc_id", "text").mapInArrow(tidy(_hashed), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, hashes array<bigint>")


def removed_lines(documents: DataFrame, hashes: DataFrame) -> DataFrame:
    """(doc_id, array<struct<line_no, hash>>): the lines of each document that repeat or resemble one before them, by doc_id and place."""
    places = hashes.where("doc_id is not null").select("doc_id", F.posexplode("hashes").alias("line_no", "hash")).where("hash is not null")
    first = places.groupBy("hash").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    alike = stash(similar_lines(documents))
    first = first.join(alike.select(F.col("node").alias("hash"), "component"), "hash", "left").withColumn("class", F.coalesce("component", "hash"))
    roots = alike.select(F.col("component").alias("class")).distinct()
    grouped = first.join(roots, "class", "left_semi").groupBy("class").agg(F.min("first").alias("keep"))
    doubled = first.join(grouped, "class", "left").select("hash", "first", F.coalesce("keep", "first").alias("keep"), "n").where("n > 1 or keep <> first").select("hash", "keep")
    out = places.join(doubled, "hash").where(F.struct("doc_id", "line_no") != F.col("keep"))
    return out.groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "hash")).alias(_REMOVED))


def _gone(hashes: Column) -> Column:
    """The removed places that have the hash they were removed for: it tells the texts of one doc_id apart."""
    gone = F.filter(_REMOVED, lambda r: F.get(hashes, r["line_no"]) == r["hash"])
    return F.when(F.col(_REMOVED).isNull(), F.array().cast("array<int>")).otherwise(F.sort_array(F.transform(gone, lambda r: r["line_no"])))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept, removed_lines array<int> of every row, as dedup has them; no text is moved."""
    hashes = stash(line_hashes(documents))
    rows = hashes.join(removed_lines(documents, hashes), "doc_id", "left")
    out = rows.select("doc_id", F.size("hashes").alias("n_lines"), _gone(F.col("hashes")).alias("removed_lines"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("removed_lines")).alias("n_kept"), "removed_lines")


def dedup(documents: DataFrame) -> DataFrame:
    """documents with text less the lines removed, and n_lines, n_kept, removed_lines array<int>.

    Of lines that are equal once trimmed, or whose sets of 6-character shingles have a Jaccard similarity of 0.8 or more, directly or by way of others,
    the first by doc_id and place stays. Blank lines stay, as do the lines of a row without doc_id; a null text stays null. Rows of one doc_id count as
    one document: a line at the same place in several of them stays in all or in none. Columns of documents called like the new ones are replaced.
    """
    new = ("n_lines", "n_kept", "removed_lines")
    kept_columns = [c for c in documents.columns if c not in new]
    rows = documents.select(*kept_columns).join(removed_lines(documents.select("doc_id", "text"), stash(line_hashes(documents))), "doc_id", "left")
    all_lines = lines(F.col("text"))
    gone = _gone(F.transform(all_lines, line_hash))
    out = rows.withColumn("n_lines", F.size(all_lines)).withColumn("removed_lines", gone)
    kept = F.filter(all_lines, lambda _, i: ~F.array_contains("removed_lines", i))
    text = F.when(F.size("removed_lines") == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.withColumn("text", text).withColumn("n_kept", F.col("n_lines") - F.size("removed_lines")).select(*kept_columns, *new)
