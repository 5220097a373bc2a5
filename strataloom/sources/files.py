"""File sources: type detection, Office packages, HTML, and a content-addressed store."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The parts that tell Office packages apart, and limits against bombs.
OFFICE = {"word/document.xml": "docx", "xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx"}
MOST_MEMBERS, MOST_BYTES, MOST_RATIO, MOST_CELLS = 10_000, 1 << 30, 200, 500_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def read_files(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """(path, content, size_bytes, sha256) of the files under a path, those over the cap left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select("path", "content", F.col("length").alias("size_bytes"))
    if most_bytes is not None:
        rows = rows.where(F.col("size_bytes") <= most_bytes)
    return rows.withColumn("sha256", F.sha2("content", 256))


def file_type(content):
    """Type by the first 1024 bytes; packages are ``zip`` until ``package_type`` looks inside."""
    head = F.hex(F.substring(content, 1, 1024))
    starts = lambda *magic: head.rlike("^(?:" + "|".join(magic) + ")")
    return (
        F.when(F.instr(head, F.hex(F.lit("%PDF-"))) % 2 == 1, "pdf").when(starts("89504E470D0A1A0A"), "png").when(starts("FFD8FF"), "jpeg")
        .when(starts("49492A00", "4D4D002A"), "tiff").when(starts("504B0304"), "zip").when(starts("D0CF11E0A1B11AE1"), "legacy_office").otherwise("unknown_type")
    )


def package_type(data: bytes) -> str:
    """docx, xlsx, pptx, or why not."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
            if len(infos) > MOST_MEMBERS or sum(i.file_size for i in infos) > MOST_BYTES or any(i.file_size > MOST_RATIO * max(i.compress_size, 1) and i.file_size > 1 << 20 for i in infos):
                return "suspicious_package"
            names = {i.filename for i in infos}
    except zipfile.BadZipFile:
        return "unknown_type"
    return next((kind for part, kind in OFFICE.items() if part in names), "unknown_type")


def _docx(z: zipfile.ZipFile) -> Iterator[tuple[int, dict]]:
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    for e in body if body is not None else []:
        text = lambda x: "".join(t.text or "" for t in x.iter(f"{_W}t")).strip()
        if e.tag == f"{_W}p" and text(e):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"(?i)heading\s*(\d)", style.get(f"{_W}val", "") if style is not None else "")
            yield 1, {"kind": "heading" if level else "paragraph", "text": text(e), "level": int(level[1]) if level else None}
        elif e.tag == f"{_W}tbl":
            rows = [[text(c) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            heads = sum(1 for r in e.iter(f"{_W}tr") if r.find(f"{_W}trPr/{_W}tblHeader") is not None)
            yield 1, {"kind": "table", "rows": rows, "header_rows": heads}


def _xlsx(z: zipfile.ZipFile) -> Iterator[tuple[int, dict]]:
    strings = []
    if "xl/sharedStrings.xml" in z.namelist():
        strings = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    for page, name in enumerate(sheets, 1):
        rows, cells = [], 0
        for r in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
            row: list[str] = []
            for c in r.findall(f"{_S}c"):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = len(row)
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                v = c.find(f"{_S}v")
                value = strings[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else "".join(t.text or "" for t in c.iter(f"{_S}t"))
                row += [""] * (at - len(row)) + [value or ""]
            while row and not row[-1]:
                row.pop()
            cells += len(row)
            if cells > MOST_CELLS:
                raise ValueError("sheet_too_large")
            if row:
                rows.append(row)
        notes = 0
        while notes < len(rows) and sum(map(bool, rows[notes])) < 2:
            yield page, {"kind": "paragraph", "text": " ".join(filter(None, rows[notes]))}
            notes += 1
        if rows[notes:]:
            width = max(map(len, rows[notes:]))
            yield page, {"kind": "table", "rows": [r + [""] * (width - len(r)) for r in rows[notes:]], "header_rows": 1}


def _pptx(z: zipfile.ZipFile) -> Iterator[tuple[int, dict]]:
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    for page, name in enumerate(slides, 1):
        for n, p in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{_A}p")):
            text = "".join(t.text or "" for t in p.iter(f"{_A}t")).strip()
            if text:
                yield page, {"kind": "heading" if n == 0 else "paragraph", "text": text, "level": 2 if n == 0 else None}


def image_pages(files: DataFrame) -> DataFrame:
    """(path, page, kind, text, issue): pictures are one page without text each."""
    pictures = files.where(file_type(F.col("content")).isin("png", "jpeg", "tiff"))
    return pictures.select("path", F.lit(1).alias("page"), F.lit("page").alias("kind"), F.lit("").alias("text"), F.lit("no_text").alias("issue"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that don't fit the schema are an error, as a question set must be whole."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


BLOCKS = "path string, page int, idx int, kind string, text string, level int, rows array<array<string>>, header_rows int, failure string"


def office_blocks(files: DataFrame) -> DataFrame:
    """Blocks of the Office packages among (path, content) rows; a package that fails gives one row with the reason."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                kind = package_type(data)
                try:
                    if kind not in ("docx", "xlsx", "pptx"):
                        raise ValueError(kind)
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for idx, (page, b) in enumerate({"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}[kind](z)):
                            rows.append((path, page, idx, b["kind"], b.get("text"), b.get("level"), b.get("rows"), b.get("header_rows", 0), None))
                except (ValueError, KeyError, ElementTree.ParseError) as e:
                    rows.append((path, None, None, None, None, None, None, None, str(e)[:200]))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int32" for c in ("page", "idx", "level", "header_rows")})

    return files.where(file_type(F.col("content")) == "zip").select("path", "content").mapInPandas(run, BLOCKS)


class _Text(HTMLParser):
    SKIP = {"script", "style", "head", "noscript", "template"}
    BREAK = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "blockquote", "pre"}

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in self.SKIP))
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def html_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(parser.out).split("\n"))
    return "\n".join(line for line in lines if line)


def html_to_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the visible text of their HTML instead of it."""
    rest = [c for c in pages.columns if c not in (html, "text")]
    schema = pages.select(*rest, F.lit("").alias("text")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[rest].assign(text=[html_text(h) for h in frame[html]])

    return pages.select(*rest, html).mapInPandas(run, schema)


class BlobStore:
    """Contents by their hash in a folder: put, read, list, delete and age.

    Each change is a batch of its own: contents in ``blobs``, and in ``entries`` what it adds or
    deletes, written last.  So a change that is broken off counts for nothing, readers see whole
    changes only, and writers at the same time don't disturb each other: the same content put twice is
    two rows of one hash, of which one counts.  A hash is there if its newest entry isn't a deletion;
    what was deleted keeps its bytes until the folder of its batch is removed.
    """

    ENTRIES = "sha256 string, size_bytes long, batch string, at timestamp, deleted boolean"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.ENTRIES).parquet(f"{self.path}/entries")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.ENTRIES)

    def list(self) -> DataFrame:
        """(sha256, size_bytes, batch, since) of what is there; ``since`` is when the content came after its last deletion."""
        own = self._entries()
        gone = own.where("deleted").groupBy("sha256").agg(F.max("at").alias("gone"))
        live = own.where("not deleted").join(gone, "sha256", "left").where("gone is null or at > gone")
        return live.groupBy("sha256").agg(F.max("size_bytes").alias("size_bytes"), F.min("batch").alias("batch"), F.min("at").alias("since"))

    def aged(self, before) -> DataFrame:
        """What is there since before a time."""
        return self.list().where(F.col("since") < F.lit(before))

    def put(self, files: DataFrame, at=None) -> None:
        """Add the contents of (content) rows; those that are there aren't written again."""
        batch, folder = uuid.uuid4().hex, f"{self.path}/blobs"
        new = files.where("content is not null").select(F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"), "content").dropDuplicates(["sha256"])
        new = new.join(self.list().select("sha256"), "sha256", "left_anti")
        new.withColumn("shard", F.substring("sha256", 1, 2)).write.partitionBy("shard").parquet(f"{folder}/batch={batch}")
        wide = "sha256 string, size_bytes long"
        added = self.spark.read.schema(wide + ", shard string").parquet(f"{folder}/batch={batch}").select("sha256", "size_bytes")
        self._enter(added, batch, at, False)

    def delete(self, hashes: DataFrame, at=None) -> None:
        """Take away contents by (sha256); what isn't there is left out."""
        self._enter(self.list().join(hashes.select("sha256").distinct(), "sha256", "left_semi").select("sha256", "size_bytes"), uuid.uuid4().hex, at, True)

    def _enter(self, rows: DataFrame, batch: str, at, deleted: bool) -> None:
        moment = F.lit(at).cast("timestamp") if at is not None else F.current_timestamp()
        entries = rows.select("sha256", "size_bytes", F.lit(batch).alias("batch"), moment.alias("at"), F.lit(deleted).alias("deleted"))
        # a batch's entries become visible when their write is committed
        entries.write.mode("append").parquet(f"{self.path}/entries")

    def read(self, hashes: DataFrame | None = None) -> DataFrame:
        """(sha256, size_bytes, content) of what is there, once each; of given (sha256) rows only if they are named."""
        wanted = self.list() if hashes is None else self.list().join(hashes.select("sha256").distinct(), "sha256", "left_semi")
        try:
            blobs = self.spark.read.schema("sha256 string, content binary, shard string, batch string").parquet(f"{self.path}/blobs")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            blobs = self.spark.createDataFrame([], "sha256 string, content binary, shard string, batch string")
        return wanted.join(blobs.withColumn("shard", F.col("shard").cast("string")), ["sha256", "batch"]).select("sha256", "size_bytes", "content")
