"""Blocks from the JSON that layout models write: items that refer to each other by JSON pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import ENGLISH, Language
from ..operators.chunking import section_level
from ..operators.relational import paths
from ..operators.tables import written

_REF = "array<struct<`$ref`:string>>"
_ITEM = f"content_layer:string,children:{_REF},prov:array<struct<page_no:int>>"
_CELL = "struct<text:string,start_row_offset_idx:int,end_row_offset_idx:int,start_col_offset_idx:int,column_header:boolean>"
SCHEMA = (
    f"struct<body:struct<children:{_REF}>,pages:map<string,struct<page_no:int>>,texts:array<struct<{_ITEM},label:string,text:string,marker:string>>,groups:array<struct<{_ITEM}>>,"
    f"tables:array<struct<{_ITEM},data:struct<num_rows:int,num_cols:int,table_cells:array<{_CELL}>>>>,pictures:array<struct<{_ITEM}>>>"
)
# Labels of text items that give no block, and kinds of those that aren't paragraphs.
SKIPPED = ("page_header", "page_footer")
KINDS = {"list_item": "list_item", "caption": "caption", "footnote": "footnote", "code": "code", "formula": "formula"}
TITLES = ("title", "section_header")


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _items(docs: DataFrame) -> DataFrame:
    """(key, ref, name, item): one row an item, its pointer and the list in which it stands."""
    none = lambda kind: F.lit(None).cast(kind)
    out = None
    for name in ("texts", "groups", "tables", "pictures"):
        each = docs.select("key", F.posexplode(F.col(f"doc.{name}")).alias("n", "x"))
        text, data = name == "texts", name == "tables"
        one = each.select(
            "key", F.concat(F.lit(f"#/{name}/"), F.col("n")).alias("ref"), F.lit(name).alias("name"), F.coalesce(F.col("x.content_layer") == "furniture", F.lit(False)).alias("furniture"),
            F.transform("x.children", lambda c: c["$ref"]).alias("children"), F.get("x.prov", F.lit(0))["page_no"].alias("page"), *((F.col(f"x.{c}") if text else none("string")).alias(c) for c in ("label", "text", "marker")),
            (F.col("x.data") if data else none(f"struct<num_rows:int,num_cols:int,table_cells:array<{_CELL}>>")).alias("data"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def _tables(items: DataFrame) -> DataFrame:
    """(key, ref, rows, header_rows): cells in their rows and columns; rows whose cells are all headers lead the table.

    Cells are dealt to rows and a row is filled at once, so a table costs as much as its cells.
    """
    own = items.where("name = 'tables'").select("key", "ref", F.coalesce("data.num_rows", F.lit(0)).alias("n_rows"), F.coalesce("data.num_cols", F.lit(0)).alias("n_cols"), "data.table_cells")
    cells = own.select("key", "ref", "n_rows", F.explode("table_cells").alias("c")).select("key", "ref", "n_rows", "c.*")
    spanned = cells.select("key", "ref", F.explode(F.sequence("start_row_offset_idx", F.greatest(F.col("end_row_offset_idx") - 1, "start_row_offset_idx"))).alias("row"), F.coalesce("column_header", F.lit(False)).alias("head"))
    heads = spanned.groupBy("key", "ref", "row").agg(F.bool_and("head").alias("head"))
    filled = cells.groupBy("key", "ref", F.col("start_row_offset_idx").alias("row")).agg(F.array_sort(F.collect_list(F.struct(F.col("start_col_offset_idx").alias("column"), _plain(F.col("text")).alias("text")))).alias("cells"))
    grid = own.where("n_rows > 0").select("key", "ref", "n_rows", "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row")).join(filled, ["key", "ref", "row"], "left").join(heads, ["key", "ref", "row"], "left")
    # the texts of a row's cells by column, with nothing where there is none
    columns = F.when(F.col("n_cols") > 0, F.sequence(F.lit(0), F.col("n_cols") - 1)).otherwise(F.array().cast("array<int>"))
    by_column = F.map_from_entries(F.array_sort(F.transform(F.array_distinct(F.transform(F.coalesce("cells", F.array()), lambda c: c["column"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter("cells", lambda c: c["column"] == k), -1)["text"].alias("value")))))
    line = F.transform(columns, lambda k: F.coalesce(F.get(F.map_values(F.map_filter(by_column, lambda a, b: a == k)), F.lit(0)), F.lit("")))
    lined = grid.select("key", "ref", "n_rows", F.struct("row", line.alias("line"), F.coalesce("head", F.lit(True)).alias("head")).alias("r"))
    whole = lined.groupBy("key", "ref", "n_rows").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    first_body = F.coalesce(F.get(F.filter("rows", lambda r: ~r["head"]), F.lit(0))["row"], F.col("n_rows"))
    return whole.select("key", "ref", F.transform("rows", lambda r: r["line"]).alias("rows"), F.least(first_body, F.col("n_rows") - 1).alias("header_rows")).where(F.exists("rows", lambda r: F.exists(r, lambda c: c != "")))


def layout_blocks(docs: DataFrame, language: Language = ENGLISH) -> DataFrame:
    """(key, idx, kind, text, page, level, rows, header_rows) of (key, json) rows, in reading order.

    The body and its children form a tree: references are edges, resolved by joins, and an item's place
    is the path of child numbers from the body, so order is the order of paths, at any depth.  Furniture
    gives nothing, nor does what lies below it; the texts of a picture are one block of their own.  An item
    without a page is on that of the block before it, the first on the first page of the document.  Broken
    references and broken JSON give nothing; an item has one place (that of the least child number, then
    of the least pointer of the item above it).
    """
    parsed = written(docs.select("key", F.from_json("json", SCHEMA).alias("doc")).where("doc is not null"), "layout")
    items = written(_items(parsed), "layout-items")
    kids = items.where("not furniture and name in ('groups', 'texts')").select("key", "ref", "children")
    edges = parsed.select("key", F.lit("#/body").alias("ref"), F.transform("doc.body.children", lambda c: c["$ref"]).alias("children")).unionByName(kids).select("key", F.col("ref").alias("up"), F.posexplode("children").alias("n", "ref"))
    edges = edges.groupBy("key", "ref").agg(F.min(F.struct("n", "up")).alias("e")).select("key", "ref", "e.n", "e.up")
    node = lambda c: F.concat_ws("\n", F.col("key").cast("string"), c)
    nodes = edges.select(node(F.col("ref")).alias("id"), node(F.col("up")).alias("parent"), F.lpad(F.col("n").cast("string"), 9, "0").alias("name"))
    nodes = nodes.unionByName(parsed.select(node(F.lit("#/body")).alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("body").alias("name")))
    placed = paths(nodes, "/").where("path like 'body/%'").select("id", "path")
    own = items.where("not furniture").withColumn("id", node(F.col("ref"))).join(placed, "id")

    text, marker = _plain(F.col("text")), _plain(F.col("marker"))
    text = F.when((marker != "") & (text != "") & ~text.startswith(marker), F.concat(marker, F.lit(" "), text)).otherwise(text)
    level = section_level(F.col("text"), language)
    title = F.col("label").isin(*TITLES) & (F.length("text") <= 120) & ~F.col("text").rlike("[.;,]$")
    kind = F.when(title, "heading")
    for label, name in KINDS.items():
        kind = kind.when(F.col("label") == label, name)
    texts = own.where("name = 'texts'").withColumn("text", text).where((F.col("text") != "") & ~F.coalesce(F.col("label").isin(*SKIPPED), F.lit(False)))
    texts = texts.select("key", "path", "page", kind.otherwise(F.when(level.isNotNull(), "heading").otherwise("paragraph")).alias("kind"), "text", F.coalesce(level, F.when(title, F.when(F.col("label") == "title", 1).otherwise(2))).cast("int").alias("level"))
    captions = items.where("name = 'texts'").select("key", F.col("ref").alias("child"), _plain(F.col("text")).alias("part"))
    inside = own.where("name = 'pictures'").select("key", "path", "page", F.posexplode("children").alias("n", "child")).join(captions, ["key", "child"]).where("part <> ''")
    figures = inside.groupBy("key", "path", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n").alias("text"))
    tables = own.where("name = 'tables'").select("key", "ref", "path", "page").join(_tables(items), ["key", "ref"])
    none = lambda c, k: F.lit(None).cast(k).alias(c)
    rows, heads = none("rows", "array<array<string>>"), F.lit(0).alias("header_rows")
    out = texts.select("*", rows, heads).unionByName(figures.select("key", "path", "page", F.lit("figure_text").alias("kind"), "text", none("level", "int"), rows, heads))
    out = out.unionByName(tables.select("key", "path", "page", F.lit("table").alias("kind"), F.lit("").alias("text"), none("level", "int"), "rows", "header_rows"))
    w = Window.partitionBy("key").orderBy("path")
    firsts = parsed.select("key", F.coalesce(F.array_min(F.transform(F.map_keys("doc.pages"), lambda p: p.cast("int"))), F.lit(1)).alias("_first"))
    out = out.join(firsts, "key").withColumn("page", F.coalesce(F.last("page", ignorenulls=True).over(w), F.col("_first")))
    return out.select("key", (F.row_number().over(w) - 1).alias("idx"), "kind", "text", "page", "level", "rows", "header_rows")
