"""Lines, blocks, chunks, sources and streams."""

import hashlib
import io
import json
import random
import time
import zipfile

from pyspark.sql import functions as F

from strataloom.functions import text
from strataloom.operators import chunking, entities, evaluation, kernels, retrieval
from strataloom.sources import files, layout
from strataloom.streaming import ingest


def test_lines_become_blocks(spark):
    lines = "Chapter 1\nGeneral Rules\nThis is the first sen-\ntence of it. It goes\non here.\nA new one begins.\n\n- item one\n- item two\nwhich goes on\nArticle 5 The text of the article runs on, as\narticles do.\nNumber 12-\n34 stays one."
    rows = chunking.line_blocks(spark.createDataFrame([(1, 1, lines), (1, 2, ""), (2, 1, None)], "key long, page int, text string")).orderBy("key", "page", "idx").collect()
    assert [(r.kind, r.level, r.text) for r in rows] == [
        ("heading", 2, "Chapter 1 General Rules"), ("paragraph", None, "This is the first sentence of it. It goes on here."), ("paragraph", None, "A new one begins."),
        ("list_item", None, "- item one"), ("list_item", None, "- item two which goes on"), ("paragraph", 3, "Article 5 The text of the article runs on, as articles do."), ("paragraph", None, "Number 12-34 stays one."),
    ]
    cut = chunking.chunks(chunking.gathered(spark.createDataFrame([tuple(r) for r in rows], "key long, page int, idx int, kind string, text string, level int"))).collect()
    assert cut[0].heading_path == ["Chapter 1 General Rules"] and "first sentence" in cut[0].text


def test_chunks_keep_every_word_and_the_limits(spark):
    rng = random.Random(8)
    limits, number = chunking.Limits(), iter(range(10**6))
    for _ in range(40):
        blocks, words = [], []
        for k in range(rng.randint(1, 25)):
            kind = rng.choice(["paragraph", "paragraph", "paragraph", "heading", "table"])
            own = [f"w{next(number)}" for _ in range(rng.choice([3, 20, 200, 900]))]
            if kind == "table":
                rows = [own[i : i + 3] for i in range(0, len(own), 3)]
                blocks.append({"kind": kind, "text": None, "page": k + 1, "level": None, "label": None, "rows": [r + [""] * (3 - len(r)) for r in rows], "header_rows": rng.randint(0, 1)})
            else:
                own = own[:5] if kind == "heading" else own
                blocks.append({"kind": kind, "text": " ".join(own) + ".", "page": k + 1, "level": rng.randint(1, 4) if kind == "heading" else None, "label": None, "rows": None, "header_rows": 0})
                if kind == "paragraph":
                    words += own
        out = chunking.chunk_blocks(blocks, limits)
        made = " ".join(c["text"] for c in out if c["kind"] == "text").replace(".", "").split()
        assert [w for w in made if w in set(words)] == words
        assert all(c["tokens"] <= limits.most for c in out if c["kind"] != "text" or "\n" not in c["text"]) and [c["ordinal"] for c in out] == list(range(len(out)))
        assert all(c["page_start"] <= c["page_end"] for c in out)


def test_joined_tables_and_summaries():
    t = lambda page, rows, head=1: {"kind": "table", "text": None, "page": page, "level": None, "label": None, "rows": rows, "header_rows": head}
    joined = chunking.joined_tables([t(1, [["h", "i"], ["1", "2"]]), t(2, [["h", "i"], ["3", "4"]]), t(3, [["5", "6"]], 0), t(5, [["7", "8"]], 0)])
    assert [b["rows"] for b in joined] == [[["h", "i"], ["1", "2"], ["3", "4"], ["5", "6"]], [["7", "8"]]] and joined[0]["last_page"] == 3
    big = chunking.table_chunks([["name", "v"], *[[f"row {k} " + "x" * 50, str(k)] for k in range(100)]], 1, chunking.Limits())
    assert big[-1][0] == "table_summary" and all(text.startswith("name | v\n") for kind, text in big[:-1]) and sum(text.count("row ") for kind, text in big[:-1]) == 100


def test_identifiers_first_and_ties(spark):
    asked = spark.createDataFrame([(1, "number", "12/3"), (1, "date", "2020-01-01")], "query_id long, kind string, value string")
    held = spark.createDataFrame([(10, "number", "12/3"), (11, "number", "12/3"), (11, "date", "2020-01-01"), (12, "date", "1999-01-01")], "key long, kind string, value string")
    ranked = spark.createDataFrame([(1, 12, 1), (1, 10, 2), (1, 13, 3)], "query_id long, key long, rank int")
    assert [(r.key, r.held) for r in retrieval.by_identifiers(asked, held, ranked).orderBy("rank").collect()] == [(11, 2), (10, 1), (12, 0), (13, 0)]
    re = spark.createDataFrame([(1, 1, 1, 5.0), (1, 2, 2, 4.8), (1, 3, 3, 3.0)], "query_id long, key long, rank int, score double")
    holds = spark.createDataFrame([(1, 2), (1, 3)], "query_id long, key long")
    assert [r.key for r in retrieval.identifier_tie_break(re, holds).orderBy("final_rank").collect()] == [2, 1, 3]
    chunks = spark.createDataFrame([(1, 7, 1, 2, ["a"]), (2, 7, 5, 5, ["b"])], "key long, document long, page_start int, page_end int, heading_path array<string>")
    pages = spark.createDataFrame([(7, 1, ["z", "a"]), (7, 2, ["a"]), (7, 4, ["q"])], "document long, page int, uncertain array<string>")
    got = retrieval.rank_details(re.select("query_id", "key", "rank"), chunks, pages).orderBy("key").collect()
    assert [(r.key, r.heading_path, r.uncertain) for r in got] == [(1, ["a"], ["a", "z"]), (2, ["b"], [])]


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def test_sources(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = package({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    data = {"a.pdf": b"xx %PDF-1.7", "b.png": b"\x89PNG\r\n\x1a\nrest", "c.docx": docx, "d.bin": b"nothing", "e.zip": package({"x": "y"}), "f.jpg": b"\xff\xd8\xffx"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    read = files.read_files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.t for r in read.select("path", files.file_type(F.col("content")).alias("t")).collect()} == {"a.pdf": "pdf", "b.png": "png", "c.docx": "zip", "d.bin": "unknown_type", "e.zip": "zip", "f.jpg": "jpeg"}
    blocks = files.office_blocks(read).orderBy("path", "idx").collect()
    assert [(b.kind, b.text, b.level) for b in blocks if b.path.endswith("c.docx")] == [("heading", "Title", 1), ("paragraph", "Body", None), ("table", None, None)]
    assert [b.failure for b in blocks if b.path.endswith("e.zip")] == ["unknown_type"]
    cells = "".join("<row>" + f"<c><v>{n % 7}</v></c>" * 1000 + "</row>" for n in range(501))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("xl/workbook.xml", "<x/>")
        z.writestr("xl/worksheets/sheet1.xml", f'<s xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{cells}</s>')
    big = spark.createDataFrame([("big.xlsx", buffer.getvalue())], "path string, content binary")
    assert [b.failure for b in files.office_blocks(big).collect()] == ["sheet_too_large"]
    assert files.read_files(spark, str(tmp_path / "a.pdf"), most_bytes=3).count() == 0


def test_blob_store(spark, tmp_path):
    import datetime

    day = lambda n: datetime.datetime(2024, 1, n)
    contents = lambda *x: spark.createDataFrame([(c.encode(),) for c in x], "content binary")
    hashes = lambda *x: spark.createDataFrame([(hashlib.sha256(c.encode()).hexdigest(),) for c in x], "sha256 string")
    store = files.BlobStore(spark, str(tmp_path / "store"))
    there = lambda: sorted(r.content.decode() for r in store.read().collect())
    assert store.list().count() == 0 and there() == []
    store.put(contents("a", "b", "a"), day(1))
    store.put(contents("b", "c"), day(2))
    assert there() == ["a", "b", "c"] and store.list().where("size_bytes = 1").count() == 3
    assert spark.read.parquet(f"{store.path}/blobs").count() == 3
    store.delete(hashes("a", "zz"), day(3))
    assert there() == ["b", "c"] and [r.content for r in store.read(hashes("a", "b")).collect()] == [b"b"]
    assert store.aged(day(2)).count() == 1
    store.put(contents("a"), day(4))
    assert there() == ["a", "b", "c"] and store.list().agg(F.max("since")).first()[0] == day(4)
    # two writers that don't see each other leave one copy; a put that breaks off before its entries leaves none
    one, two = files.BlobStore(spark, store.path), files.BlobStore(spark, store.path)
    seen = spark.createDataFrame(one.list().collect(), one.list().schema)
    one.list = two.list = lambda: seen
    one.put(contents("d"), day(5))
    two.put(contents("d", "e"), day(5))
    assert there() == ["a", "b", "c", "d", "e"]
    two._enter = lambda *a: None
    two.put(contents("f"))
    assert there() == ["a", "b", "c", "d", "e"]


def test_sentences_end_at_stops_before_capitals():
    text = 'He said "Nay." Then Dr. Who left, e.g. Today. A. B. Smith came at 5. 12 men... "Why?" he asked. (Yes.) End'
    assert chunking.sentences(text) == ['He said "Nay."', "Then Dr. Who left, e.g. Today.", "A. B. Smith came at 5.", '12 men...', '"Why?" he asked.', "(Yes.)", "End"]
    assert chunking.sentences("") == [] and chunking.sentences("  one  ") == ["one"]
    began = time.time()
    assert len(chunking.sentences("It ended here. " * 70_000)) == 70_000 and time.time() - began < 2


def test_texts_are_chunked_by_their_blocks(spark):
    rows = [(1, "Chapter 1\nGeneral Rules\nThe first sen-\ntence goes\non here.\n\nAnother one."), (2, ""), (3, None), (4, " \n ")]
    got = chunking.text_chunks(spark.createDataFrame(rows, "key long, text string")).collect()
    assert [(r.key, r.heading_path, r.text) for r in got] == [(1, ["Chapter 1 General Rules"], "Chapter 1 General Rules\nThe first sentence goes on here.\nAnother one.")]


def test_layout_blocks(spark):
    text = lambda t, label="text", **x: {"label": label, "text": t, **x}
    page = lambda n: [{"page_no": n}]
    refs = lambda *r: [{"$ref": f"#/{x}"} for x in r]
    cell = lambda r, c, t, head=False, end=None: {"start_row_offset_idx": r, "end_row_offset_idx": end or r + 1, "start_col_offset_idx": c, "text": t, "column_header": head}
    doc = {
        "body": {"children": refs("texts/1", "groups/0", "pictures/0", "tables/0", "texts/6", "tables/1", "texts/99")}, "pages": {"4": {"page_no": 4}, "12": {"page_no": 12}},
        "texts": [
            text("in  the\nlist", "list_item", marker="1.", prov=page(5)), text("A Title", "title", children=refs("texts/2")), text("below it"), text("gone", content_layer="furniture", children=refs("texts/5")), text("caption", prov=page(6)), text("gone too"), text("page 1", "page_header"),
        ],
        "groups": [{"children": refs("texts/0", "texts/3", "groups/1")}, {"children": refs("texts/6")}], "pictures": [{"children": refs("texts/4", "tables/0"), "prov": page(6)}],
        "tables": [{"prov": page(7), "data": {"num_rows": 3, "num_cols": 2, "table_cells": [cell(0, 0, "h", True), cell(0, 1, " i ", True), cell(1, 1, "x"), cell(2, 0, "y"), cell(9, 0, "out")]}}, {"data": {"num_rows": 1, "num_cols": 1, "table_cells": []}}],
    }
    rows = [(1, json.dumps(doc)), (2, "{broken"), (3, None), (4, "{}"), (5, json.dumps({"body": {"children": refs("texts/0")}, "texts": [text("only")]}))]
    got = layout.layout_blocks(spark.createDataFrame(rows, "key long, json string")).orderBy("key", "idx").collect()
    assert [(r.key, r.idx, r.kind, r.text, r.page, r.level) for r in got] == [
        (1, 0, "heading", "A Title", 4, 1), (1, 1, "paragraph", "below it", 4, None), (1, 2, "list_item", "1. in the list", 5, None), (1, 3, "figure_text", "caption", 6, None), (1, 4, "table", "", 7, None), (5, 0, "paragraph", "only", 1, None),
    ]
    assert got[4].rows == [["h", "i"], ["", "x"], ["y", ""]] and got[4].header_rows == 1


def test_samples_are_the_same_on_any_partitioning(spark):
    rows = spark.createDataFrame([(q, k) for q in range(5) for k in range(50)], "query_id long, key long")
    one = {(r.query_id, r.place): r.key for r in evaluation.bottom_k(rows.repartition(7), "query_id", "key", 4).collect()}
    assert one == {(r.query_id, r.place): r.key for r in evaluation.bottom_k(rows.coalesce(1), "query_id", "key", 4).collect()} and len(one) == 20
    order = lambda q, k: hashlib.sha256(f"7:{q}:{k}".encode()).hexdigest()
    assert all([one[q, p] for p in range(1, 5)] == sorted(range(50), key=lambda k, q=q: order(q, k))[:4] for q in range(5))
    holding = spark.createDataFrame([(1, 0, 10, False), (1, 0, 11, True), (1, 0, 12, True), (1, 1, 11, True)], "query_id long, piece int, key long, answers boolean")
    ranked = spark.createDataFrame([(1, 12, 1), (1, 20, 2), (1, 21, 3), (2, 30, 1)], "query_id long, key long, rank int")
    got = evaluation.context_samples(holding, ranked, sources=3).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.key) for r in got] == [(1, k) for k in sorted([11, 12, 20], key=lambda k: order(1, k))] + [(2, 30)]


def test_answers_are_judged_by_their_sources(spark):
    answers = spark.createDataFrame([(1, "t", "ok", True), (2, "t", "ok", False), (3, "t", "no", False)], "query_id long, type string, status string, correct boolean")
    spans = "query_id long, document long, page_start int, page_end int"
    evidence = spark.createDataFrame([(1, 0, 5, 3), (1, 1, 6, 1), (2, 0, 5, 3), (3, 0, 5, 3)], "query_id long, piece int, document long, page int")
    cited = spark.createDataFrame([(1, 5, 1, 4), (2, 5, 4, 9)], spans)
    found = spark.createDataFrame([(1, 5, 1, 4), (1, 6, 1, 1), (2, 5, 3, 3)], spans)
    r = evaluation.judged_answers(answers, cited, found, evidence, ["ok", "no"]).first()
    assert (r.questions, r.correct, r.cited, r.found, r.ok, r.no) == (3, 0.333333, 0.0, 0.666667, 2, 1)


def test_entities_claim_intervals(spark):
    text = "Docket E. 2023/123 and K.: 2024/7, order no 55, of 2021/9; 2020/1/2 isn't one. Article 3, 31.02.2020, 5.3.2021 cost 1.234,50 eur. Block 12 parcel 7"
    got = [(r.kind, r.value, r.written) for r in entities.extract(spark.createDataFrame([(1, text), (2, None), (3, "none")], "key long, text string")).orderBy("start").collect()]
    assert got == [
        ("number", "E.2023/123", "E. 2023/123"), ("number", "K.2024/7", "K.: 2024/7"), ("number", "55", "order no 55"), ("number", "2021/9", "2021/9"), ("article", "3", "Article 3"), ("date", "2021-03-05", "5.3.2021"),
        ("amount", "1234.50 EUR", "1.234,50 eur"), ("parcel", "12/7", "Block 12 parcel 7"),
    ]
    rng, own, plain = random.Random(5), entities.Claims(), []
    for _ in range(500):
        s = rng.randrange(300)
        e = s + rng.randrange(1, 9)
        assert own.free(s, e) == (not any(s < b and a < e for a, b in plain))
        if own.free(s, e):
            own.take(s, e)
            plain.append((s, e))


def test_bootstrap_covers_the_mean_on_any_partitioning(spark):
    rng = random.Random(9)
    values = [rng.gauss(10, 3) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, x double")
    one, two = (evaluation.bootstrap(df.repartition(n), "x").first() for n in (1, 7))
    mean, error = sum(values) / 2000, 3 / 2000**0.5
    assert abs(one.mean - mean) < 1e-9 and abs(one.low - two.low) < 1e-9 and abs(one.high - two.high) < 1e-9
    assert abs(one.low - (mean - 1.96 * error)) < 0.4 * error and abs(one.high - (mean + 1.96 * error)) < 0.4 * error


def test_stream_of_documents_is_indexed_once(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([(1, 1, "First words here."), (2, 1, "  ")], "key long, version int, text string").write.parquet(source)
    ingest.start(spark, source, target, check).awaitTermination()
    spark.createDataFrame([(1, 2, "Second words here.")], "key long, version int, text string").write.mode("append").parquet(source)
    for _ in range(2):
        ingest.start(spark, source, target, check).awaitTermination()
    assert [(r.key, r.version, r.text) for r in ingest.searchable(spark, target).collect()] == [(1, 2, "Second words here.")]


def test_reading_order_and_beam():
    boxes = [(0.55, 0.1 * k, 0.95, 0.1 * k + 0.05) for k in range(8)] + [(0.05, 0.1 * k, 0.45, 0.1 * k + 0.05) for k in range(8)]
    assert kernels.reading_order(boxes) == [*range(8, 16), *range(8)]
    frames = [[0.1, 0.8, 0.1], [0.6, 0.3, 0.1], [0.1, 0.1, 0.8]]
    assert kernels.beam_ctc(frames, ["", "a", "b"]) == kernels.greedy_ctc(frames, ["", "a", "b"]) == "ab"
    assert kernels.without_tail_loop("x" * 9000 + "ab " * 40).count("ab ") <= 2


def test_text_functions_and_small_sources(spark, tmp_path):
    rows = ["e\u0301te\u0301\r\n\u200bx ", "plain", None, "a" * 139 + " bcd ef", "x" * 200]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k long, t string")
    got = df.select(text.clean(F.col("t")).alias("c"), text.opening(F.col("t")).alias("o"), text.plain_letters(F.col("t"), "x", "y").alias("p")).collect()
    assert [r.c for r in got[:3]] == ["\u00e9t\u00e9\nx", "plain", None] and got[3].o == "a" * 139 and got[4].o == "x" * 141 and got[4].p == "y" * 200
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-")
    assert [(r.page, r.issue) for r in files.image_pages(files.read_files(spark, str(tmp_path))).collect()] == [(1, "no_text")]
    (tmp_path / "q.jsonl").write_text('{"id": 1, "q": "a"}\n{"id": 2, "q": null}\n')
    assert files.read_json_lines(spark, f"{tmp_path}/q.jsonl", "id long, q string").count() == 2


def test_entities_of_places_and_articles(spark):
    t = "See the 12th article and Article 5/2, block 120 parcel 7, parcel 9; paid 1.250,50 EUR on 31.2.2020 and 3 May 2021."
    found = entities.extract(spark.createDataFrame([(1, t)], "key long, text string")).orderBy("start").collect()
    assert [(r.kind, r.value) for r in found] == [("article", "12"), ("article", "5/2"), ("parcel", "120/7"), ("parcel", "9"), ("amount", "1250.50 EUR"), ("date", "2021-05-03")]
    assert all(t[r.start :].startswith(r.written) for r in found)
