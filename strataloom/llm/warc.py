"""WARC archives with revisit records, and a globally ordered capture index (operator 9).

Spark's text sink writes the archives: a record ends with two line breaks, which is the sink's
line separator.  Each archive that is read back gives a run of captures sorted by URL key and
time.  The runs are written, dealt out by ranges of the key that hold a bounded number of
captures, and each range merges its parts of the runs by a loser tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .shared import lean, written

LINE = "\r\n"
#: An archive is read whole by one task: pages of up to so many bytes go so many to a file, larger ones alone.
FILES = ((1 << 16, 500), (1 << 21, 16))
#: Captures that a range of the index holds, about.
CAPTURES_PER_RANGE = 50_000
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: base32
_FIRST_CAPTURE = 1_704_067_200


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: each 5 hexadecimal digits are 4 letters."""
    digest = F.sha1(data.cast("binary"))
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_ALPHABET), F.shiftright(bits, 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in (3, 2, 1, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One WARC record a page, as text without its final line breaks (value), and the bytes of its payload.

    Of pages with equal payloads of ``least_bytes`` bytes or more, that with the largest page_id
    becomes a response and the others revisit it; all others are responses.  A null html is an
    empty payload, a null url the URN of the page; rows with a null page_id are left out, rows that
    repeat a page_id and its html have the same record type, and a page_id of several payloads has
    a record for each.
    """
    own = pages.where("page_id is not null").select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.regexp_replace("url", r"[\r\n]+", "%0A"), F.concat(F.lit("urn:page:"), F.col("page_id"))).alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    )
    own = own.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload"))
    # counted map-side; only payloads of several pages are joined back, and by their written size
    # Spark chooses between sending these to all tasks and dealing out all pages (with skew join)
    last = own.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("last"), F.min("page_id").alias("first"))
    own = own.join(written(last.where("first < last.page_id").select("digest", "last"), "repeated-payloads"), "digest", "left")
    revisit = F.coalesce(F.col("last.page_id") > F.col("page_id"), F.lit(False))
    date = F.date_format(F.timestamp_seconds(F.pmod("page_id", F.lit(1_000_000_000)) + _FIRST_CAPTURE), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("bytes"), F.lit(LINE * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    refers = F.concat(
        F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{LINE}WARC-Refers-To: <urn:page:"),
        F.col("last.page_id"), F.lit(f">{LINE}WARC-Refers-To-Target-URI: "), F.col("last.url"), F.lit(LINE),
    )
    text = F.concat(
        F.lit(f"WARC/1.1{LINE}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{LINE}WARC-Record-ID: <urn:page:"), F.col("page_id"), F.lit(f">{LINE}WARC-Date: "), date,
        F.lit(f"{LINE}WARC-Target-URI: "), F.col("url"), F.lit(f"{LINE}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(LINE),
        F.when(revisit, refers).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{LINE}Content-Length: "), F.octet_length(block), F.lit(LINE * 2), block,
    )
    return own.select(text.alias("value"), "bytes")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, files: tuple[tuple[int, int], ...] = FILES) -> None:
    """Archives in folders by the size of their pages, so that no file grows beyond some 32 MB but for a single larger page."""
    own = records(pages, least_bytes)
    size = F.lit(len(files))
    for k, (most, _) in reversed(list(enumerate(files))):
        size = F.when(F.col("bytes") <= most, k).otherwise(size)
    present = [r.k for r in pages.where("page_id is not null").select(F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes")).groupBy(size.alias("k")).count().collect()]
    for k in sorted(present) or [0]:
        count = files[k][1] if k < len(files) else 1
        own.where(size == k).select("value").write.option("lineSep", LINE * 2).option("maxRecordsPerFile", count).text(f"{path}/size-{k}")


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """Headers, offset, length and block of each record of an archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split(LINE)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        end = head + 4 + int(fields["Content-Length"])
        yield fields, at, end + 4 - at, data[head + 4 : end]
        at = end + 4


def url_key(url: str) -> str:
    """Sort-friendly key: the host's labels reversed, then the path, in lower case and without scheme."""
    rest = url.split("://", 1)[-1].lower()
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.split(":")[0].split("."))) + ")/" + path


_CAPTURE = "url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, header_digest string, archive string, offset long, length long"
_NAMES = [c.split()[0] for c in _CAPTURE.split(", ")]
_TYPES = [pa.int64() if c.split()[1] == "long" else pa.string() for c in _CAPTURE.split(", ")]


def _captures(data: bytes, archive: str) -> list[tuple]:
    out = []
    for fields, offset, length, block in parsed(data):
        head, _, payload = block.partition(b"\r\n\r\n")
        number = lambda name: int(fields[name].removesuffix(">").rpartition(":")[2])
        header = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "revisit":  # the payload is another record's; its headers say which
            size = re.search(rb"(?im)^content-length: *(\d+)", head)
            own = "revisit", number("WARC-Refers-To"), int(size[1]) if size else None, header
        else:
            own = "response", None, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], number("WARC-Record-ID"), fields["WARC-Target-URI"], *own, header, archive, offset, length))
    return sorted(out, key=lambda c: c[:3])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives under the path; those of one archive are a sorted run.

    Payload size and digest are computed from the bytes of a response, and read from the headers of
    a revisit, so that no record is looked up by another one's key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if rows := _captures(data.as_py(), archive):
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(lean(run), _CAPTURE)


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of their match, so a step replays one path."""

    def __init__(self, runs: list[list[tuple]], key=lambda x: x):
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.k = max(1, len(runs))
        self.nodes = [-1] * self.k
        self.heads = [self._head(i) for i in range(len(runs))]
        for i in range(len(runs)):
            self._play(i)

    def _head(self, run: int):
        rows = self.runs[run]
        return (0, self.key(rows[self.at[run]])) if self.at[run] < len(rows) else (1,)

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node > 0:
            other = self.nodes[node]
            if other < 0:  # the first to come waits for its opponent
                self.nodes[node] = run
                return
            if (self.heads[other], other) < (self.heads[run], run):
                self.nodes[node], run = run, other
            node //= 2
        self.nodes[0] = run

    def __iter__(self) -> Iterator[tuple]:
        if not self.runs:
            return
        if self.k == 1:
            yield from self.runs[0]
            return
        while True:
            run = self.nodes[0]
            if self.heads[run] == (1,):
                return
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.heads[run] = self._head(run)
            node = (run + self.k) // 2
            while node > 0:
                other = self.nodes[node]
                if (self.heads[other], other) < (self.heads[run], run):
                    self.nodes[node], run = run, other
                node //= 2
            self.nodes[0] = run


def merged_index(runs: DataFrame, captures_per_range: int = CAPTURES_PER_RANGE) -> DataFrame:
    """All captures with their ``position`` (from 0) in the order of URL key, time and page.

    Ranges of the whole key are dealt out, so a URL of very many captures spans several ranges, and
    there are as many as keep each near ``captures_per_range``, which bounds what a task holds.
    Only the number of captures in each range comes to the driver.
    """
    runs = written(runs, "runs")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        by_run: dict[str, list[tuple]] = defaultdict(list)
        for row, key in enumerate(zip(*(table.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "archive", "offset")), strict=True)):
            by_run[key[3]].append((*key, row))
        parts = [by_run[name] for name in sorted(by_run)]
        for part in parts:
            if any(a > b for a, b in zip(part, part[1:], strict=False)):  # the blocks of a run were fetched out of turn
                part.sort()
        order = np.fromiter((key[5] for key in LoserTree(parts)), dtype=np.int64, count=table.num_rows)
        this = TaskContext.get().partitionId()
        for first in range(0, len(order), 10_000):
            out = table.take(pa.array(order[first : first + 10_000]))
            n = out.num_rows
            out = out.append_column("range", pa.array(np.full(n, this, dtype=np.int64))).append_column("local", pa.array(np.arange(first, first + n)))
            yield from out.combine_chunks().to_batches()

    ranges = max(1, -(-runs.count() // captures_per_range))
    out = written(runs.repartitionByRange(ranges, "url_key", "captured", "page_id").mapInArrow(lean(merge), f"{_CAPTURE}, range long, local long"), "capture-index")
    sizes = {r["range"]: r["n"] for r in out.groupBy("range").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    offset = F.element_at(F.lit(before or [0]), (F.col("range") + 1).cast("int")).cast("long")
    return out.select(*_NAMES, (offset + F.col("local")).alias("position"))
