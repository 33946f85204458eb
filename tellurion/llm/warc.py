"""WARC archives of pages, and the globally ordered index of their captures.

Writing: equal payloads of some size are archived once and revisited by the others. Records are text with CRLF line ends, so Spark's
own writer puts them into files of any store. Reading: each file is parsed by its records' Content-Length, whatever the payloads hold,
and gives one capture run, sorted by URL key and timestamp. The runs are cut at common bounds, and each range is merged from its
runs' slices by a loser tree, so the ranges one after another are the whole ordered index.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.sources.shared import new_path

from .common import stash

MIN_REVISIT_BYTES = 1000
RECORDS_PER_FILE = 1000
#: Index entries that one merging task takes, about.
RANGE_ENTRIES = 200_000
INDEX = "url_key string, capture_ts string, page_id long, url string, archive string, record_offset long, record_length long, record_type string, payload_bytes long, payload_digest string, refers_to long"
_ENTRY = pa.schema([("url_key", pa.string()), ("capture_ts", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("record_offset", pa.int64()), ("record_length", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """A WARC record for each row of pages (page_id, url, html, capture_ts timestamp, may be null).

    A null html is an empty payload. Of equal payloads of at least min_revisit_bytes, those of the largest page_id are responses and
    the others revisit it; a null page_id is the smallest. A row that is there twice is archived twice.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(F.date_format("capture_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z")).alias("at"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = rows.select("page_id", "bytes", "digest").where(F.col("bytes") >= min_revisit_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(groups, ["digest", "bytes"], "left").withColumn("revisit", F.col("keeper").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("keeper"), F.lit(False)))
    crlf = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("bytes").cast("string"), F.lit(crlf + crlf))
    block = F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    clean = F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "")  # a header is one line
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{crlf}WARC-Record-ID: <urn:page:"), page, F.lit(f">{crlf}WARC-Date: "), F.col("at"),
        F.coalesce(F.concat(F.lit(f"{crlf}WARC-Target-URI: "), clean), F.lit("")),
        F.when(F.col("revisit"), F.concat(F.lit(f"{crlf}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{crlf}WARC-Refers-To: <urn:page:"), F.col("keeper").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit(f"{crlf}Content-Type: application/http; msgtype=response{crlf}Content-Length: "), F.col("n").cast("string"), F.lit(crlf + crlf),
    )
    # the writer ends each row with a line feed, the last byte of the record
    record = rows.withColumn("block", block).withColumn("n", F.octet_length("block")).select(F.concat(head, "block", F.lit("\r\n\r")).alias("value"))
    record.write.option("maxRecordsPerFile", records_per_file).option("lineSep", "\n").option("compression", "gzip").text(folder)


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers by lower-case name, block) of each record of an archive, unpacked; offsets are in the unpacked archive."""
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        lines = data[at : body - 4].decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        end = body + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield at, end + 4 - at, headers, data[body:end]
        at = end + 4


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, then path and query: captures of a site and a page stand together. Null and '' are ''."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + ")" + parts.path + (f"?{parts.query}" if parts.query else "")


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[4], entry[5]


def _runs(batches):
    """One sorted run of index entries for each archive."""
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content"), strict=True):
            run, name = [], path.as_py().rpartition("/")[2]
            for at, length, h, block in parse_records(gzip.decompress(content.as_py())):
                head, _, payload = block.partition(b"\r\n\r\n")
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                revisit = h["warc-type"] == "revisit"
                size = int(head.rpartition(b"Content-Length: ")[2])
                if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"the payload at byte {at} of {name} isn't what its headers say")
                url = h.get("warc-target-uri")
                run.append((url_key(url), h["warc-date"], _page(h["warc-record-id"]), url, name, at, length, h["warc-type"], size, digest, _page(h["warc-refers-to"]) if revisit else None))
            run.sort(key=_order)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in run], f.type) for i, f in enumerate(_ENTRY)], schema=_ENTRY)


def capture_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The index entries of the archives in folder, each archive's in order."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(folder).select("path", "content").mapInArrow(_runs, INDEX)


class LoserTree:
    """Merges sorted lists: each inner node holds the loser of its match, so the next entry costs one match a level."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * len(runs)
        self.front = [key(r[0]) if r else None for r in runs] or [None]
        self.tree = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.front[a], self.front[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def __iter__(self):
        while (win := self.tree[0]) < len(self.runs) and self.front[win] is not None:
            run = self.runs[win]
            yield run[self.at[win]]
            self.at[win] += 1
            self.front[win] = self.key(run[self.at[win]]) if self.at[win] < len(run) else None
            node = (win + self.k) // 2
            while node:
                if self._before(self.tree[node], win):
                    self.tree[node], win = win, self.tree[node]
                node //= 2
            self.tree[0] = win


def merge_runs(runs: DataFrame) -> DataFrame:
    """The runs' entries with range_id int and position long: (range_id, position) is the order by URL key, timestamp and page.

    Bounds come from keys picked by hash, so no task sorts or holds the whole index. Entries with equal keys, even a third of all, differ
    in timestamp, page or place, and so are split like any others.
    """
    spark = runs.sparkSession
    runs = stash(runs)
    total = runs.count()
    n = max(1, -(-total // RANGE_ENTRIES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 2000)))
    picked = runs.where(F.pmod(F.xxhash64("archive", "record_offset"), F.lit(max(1, total // (12 * n)))) == 0).select(*_ENTRY.names[:6]).collect()
    keys = sorted(_order(tuple(r)) for r in picked)
    bounds = [keys[len(keys) * i // n] for i in range(1, n)] if len(keys) >= n else keys

    def slices(batches):
        from bisect import bisect_right

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            order = [_order(x) for x in zip(*columns, strict=True)]
            part = [bisect_right(bounds, o) for o in order]
            lo = 0
            for i in range(1, len(order) + 1):  # a slice ends with its range or its run
                if i == len(order) or part[i] != part[lo] or order[i] < order[i - 1]:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, b.schema) as out:
                        out.write_batch(b.slice(lo, i - lo))
                    yield pa.RecordBatch.from_arrays([pa.array([part[lo]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["range_id", "slice"])
                    lo = i

    def merged(batches):
        by: dict[int, list] = {}
        for b in batches:
            for k, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = pa.ipc.open_stream(s.as_buffer()).read_all()
                by.setdefault(k, []).append(list(zip(*(c.to_pylist() for c in t.columns), strict=True)))
        for k in sorted(by):
            rows = list(LoserTree(sorted(by[k], key=lambda r: _order(r[0])), _order))
            for lo in range(0, len(rows), 10_000):
                part = rows[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(np.arange(lo, lo + len(part))), *(pa.array([x[i] for x in part], f.type) for i, f in enumerate(_ENTRY))], names=["range_id", "position", *_ENTRY.names])

    return runs.mapInArrow(slices, "range_id int, slice binary").repartitionById(n, "range_id").mapInArrow(merged, f"range_id int, position long, {INDEX}")


def archive(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder, reads them back and returns their merged index."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write_archives(pages, folder)
    return merge_runs(capture_runs(spark, folder))
